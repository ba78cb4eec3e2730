"""Personal data by weak supervision.

Regular expressions, gazetteers and context words are labelers: each votes for, against or not at all on every candidate
span (strict matches and looser look-alikes). Expectation-maximisation over the vote counts of the whole corpus estimates
how reliable each labeler is and how likely each candidate is personal data; a logistic span classifier is trained
on these soft labels and decides which look-alikes join the strict matches, which always stay.

Votes and features are small integers, so what the corpus has to tell is a table of counts with a bounded number of cells; only that
table reaches the driver, and no row is shuffled.

Defined results: null text is empty; empty text has no spans; repeated rows are scanned one by one; spans of one kind
never overlap (strict ones first, then leftmost); offsets are code points, ends exclusive; an empty table gives an empty
result, and an untrained model adds nothing.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.arrow import TextBlock, blocks, map_blocks

KINDS = ("email", "ip", "card", "phone")
#: The gazetteers of the labelers.
TOP_DOMAINS = frozenset("com org net edu gov mil int info biz io co me tv app dev ai eu de fr es it uk nl be ch at pl se no fi dk pt ie us ca mx br ar cl jp cn in kr au nz za ru ua tr".split())
CALLING_CODES = frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
CARD_PREFIX = re.compile(r"4|5[1-5]|2[2-7]|3[47]|6011|65|35|30|36|38")
CONTEXT_FOR = {
    "email": frozenset("email mail contact correo courriel write reach address".split()),
    "ip": frozenset("ip host server address addr client login".split()),
    "card": frozenset("card visa mastercard amex credit debit payment karte carte tarjeta".split()),
    "phone": frozenset("phone tel telephone call mobile cell fax telefon téléphone teléfono".split()),
}
CONTEXT_AGAINST = frozenset("version ver v release build isbn issn order invoice id ref serial section figure chapter".split())

_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# Possessive and behind a look-behind, so that long digit runs take linear time; the matches are those of the plain patterns.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_LOOSE_EMAIL = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?[\[(] ?at ?[\])] ?[A-Za-z0-9-]{1,63}(?: ?[\[(] ?dot ?[\])] ?[A-Za-z0-9-]{1,63})+", re.IGNORECASE | re.ASCII)
_LOOSE_PHONE = re.compile(r"(?<![0-9A-Za-z+.-])(?:\([0-9]{2,4}\) ?|[0-9]{2,4}[ .-])[0-9]{3,4}[ .-][0-9]{3,4}(?![0-9A-Za-z.-])")
_WORD = re.compile(r"[^\W\d_]+")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping matches of local@domain, in time linear in the text: every match holds an @, and begins
    where the run of local characters before it begins."""
    at, floor = text.find("@"), 0
    while at >= 0:
        begin = at
        while begin > floor and text[begin - 1] in _LOCAL:
            begin -= 1
        m = _DOMAIN.match(text, at + 1) if begin < at else None
        if m:
            yield begin, m.end()
        floor = m.end() if m else at + 1
        at = text.find("@", floor)


def strict(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the base spans, and those of well-formed matches that fail their check as (kind + 10, ...)."""
    out = [(0, a, b) for a, b in emails(text)] if "@" in text else []
    if not _DIGIT.search(text):
        return out
    if "." in text:
        for m in _IP.finditer(text):
            ok = all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split("."))
            out.append((1 if ok else 11, m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19:
                out.append((2 if luhn(digits) else 12, m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdecimal() for c in m[0]) <= 15:
                out.append((3, m.start(), m.end()))
    return out


#: Votes: for, against, none. Features: separators, length bucket, neighbours that are letters or digits, line position.
_CELLS = ("kind", "regex", "gazetteer", "context", "shape", "f1", "f2", "f3")


def candidates(text: str) -> list[tuple[int, int, int, bool, tuple[int, ...]]]:
    """(kind, start, end, strict, votes and features) of every candidate span."""
    found = [(k % 10, a, b, k < 10) for k, a, b in strict(text)]
    low = "at" in text or "AT" in text
    if low and ("(" in text or "[" in text):
        found += [(0, m.start(), m.end(), False) for m in _LOOSE_EMAIL.finditer(text)]
    if _DIGIT.search(text):
        found += [(3, m.start(), m.end(), False) for m in _LOOSE_PHONE.finditer(text)]
    out = []
    for kind, a, b, sure in found:
        s, before = text[a:b], text[max(0, a - 48) : a]
        digits = re.sub(r"[^0-9]", "", s)
        near = [w.lower() for w in _WORD.findall(before)[-4:]]
        regex = 1 if sure else -1 if kind in (1, 2) else 0
        if kind == 0:
            gazetteer = 1 if re.split(r"[^A-Za-z0-9-]+", s.rstrip(")] "))[-1].lower() in TOP_DOMAINS else -1
            shape = -1 if ".." in s or s[0] in ".-%+" else 1
        elif kind == 1:
            gazetteer = -1 if s.startswith(("0.", "255.")) else 0
            shape = -1 if len(digits) <= 4 else 1
        elif kind == 2:
            gazetteer = 1 if CARD_PREFIX.match(digits) else -1
            shape = 1 if len(digits) in (15, 16) and len(set(digits)) > 2 else -1
        else:
            gazetteer = (1 if any(digits.startswith(c) for c in (digits[:1], digits[:2]) if c in CALLING_CODES) else -1) if s[0] == "+" else 0
            shape = 1 if 9 <= len(digits) <= 13 else -1
        context = 1 if any(w in CONTEXT_FOR[KINDS[kind]] for w in near) else -1 if near and near[-1] in CONTEXT_AGAINST else 0
        joined = int(a > 0 and text[a - 1].isalnum()) + 2 * int(b < len(text) and text[b].isalnum())
        separators = min(3, len(re.findall(r"[ ().-]", s)))
        out.append((kind, a, b, sure, (kind, regex, gazetteer, context, shape, separators, min(3, len(s) // 8), joined)))
    return out


@dataclass
class Model:
    """`reliability[kind]`: P(vote | label) by labeler; `weights[kind]`: the span classifier."""

    reliability: dict[int, np.ndarray] = field(default_factory=dict)
    prior: dict[int, float] = field(default_factory=dict)
    weights: dict[int, np.ndarray] = field(default_factory=dict)

    def probability(self, cell: tuple[int, ...]) -> float:
        w = self.weights.get(cell[0])
        return 0.0 if w is None else float(1 / (1 + np.exp(-np.clip(_features(cell) @ w, -30, 30))))


def _features(cell: tuple[int, ...]) -> np.ndarray:
    x = np.zeros(1 + 3 * 4 + 4 + 4 + 4)
    x[0] = 1
    for k, v in enumerate(cell[1:5]):
        x[1 + 3 * k + v + 1] = 1
    for k, v in enumerate(cell[5:8]):
        x[13 + 4 * k + v] = 1
    return x


def fit(counts: dict[tuple[int, ...], int], rounds: int = 60, steps: int = 300) -> Model:
    """Expectation-maximisation over vote counts, then a logistic classifier on the soft labels."""
    model = Model()
    for kind in range(len(KINDS)):
        cells = sorted(c for c in counts if c[0] == kind)
        if not cells:
            continue
        votes = np.array([c[1:5] for c in cells]) + 1
        n = np.array([counts[c] for c in cells], float)
        q = 1 / (1 + np.exp(-1.5 * (votes - 1).sum(1)))  # the majority's view, to begin with
        for _ in range(rounds):
            prior = float(np.clip((n * q).sum() / n.sum(), 0.02, 0.98))
            theta = np.ones((2, 4, 3)) * 0.5
            # a labeler is taken to be better than chance, before any vote is seen
            theta[1, :, 2] += 2
            theta[0, :, 0] += 2
            for j in range(4):
                for y, w in ((1, n * q), (0, n * (1 - q))):
                    theta[y, j] += np.bincount(votes[:, j], weights=w / max(1.0, n.sum()) * 200, minlength=3)
            theta /= theta.sum(2, keepdims=True)
            logit = np.log(prior / (1 - prior)) + sum(np.log(theta[1, j, votes[:, j]] / theta[0, j, votes[:, j]]) for j in range(4))
            q = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        x = np.stack([_features(c) for c in cells])
        share, w = n / n.sum(), np.zeros(x.shape[1])
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            w -= 2.0 * (x.T @ (share * (p - q)) + 1e-4 * w)
        model.reliability[kind], model.prior[kind], model.weights[kind] = theta, prior, w
    return model


_COUNT = pa.schema([(c, pa.int32()) for c in _CELLS] + [("n", pa.int64())])


def vote_counts(docs: DataFrame, text: str = "text") -> dict[tuple[int, ...], int]:
    """How many candidates of all documents have each combination of votes and features (at most 4 * 3**4 * 64 cells)."""

    def work(found: Iterator[TextBlock]) -> Iterator[dict]:
        seen: Counter = Counter()
        for block in found:
            for t in block.texts():
                seen.update(c[4] for c in candidates(t))
        yield {c: [cell[k] for cell in seen] for k, c in enumerate(_CELLS)} | {"n": list(seen.values())}

    rows = map_blocks(docs, None, text, ", ".join(f"{c} int" for c in _CELLS) + ", n long", work, _COUNT).groupBy(*_CELLS).agg(F.sum("n").alias("n"))
    return {tuple(r[c] for c in _CELLS): r["n"] for r in rows.collect()}


def spans(text: str, model: Model, least: float = 0.5) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and all spans, as (kind, start, end) in order."""
    found = candidates(text)
    base = sorted(c[:3] for c in found if c[3])
    out = list(base)
    for kind, a, b, sure, cell in sorted(c for c in found if not c[3]):
        if model.probability(cell) >= least and not any(a < y and x < b for k, x, y in out if k == kind):
            out.append((kind, a, b))
    return base, sorted(out)


_SCHEMA = pa.schema([("doc_id", pa.int64()), *[(f"n_{k}", pa.int64()) for k in KINDS], ("base_sha256", pa.string()), ("spans", pa.string()), ("n_spans", pa.int64())])


def detect(docs: DataFrame, model: Model | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, counts and digest of the base spans, and all spans as kind:start:end."""
    model = model or fit(vote_counts(docs, text))

    def work(found: Iterator[TextBlock]) -> Iterator[dict]:
        for block in found:
            out: dict[str, list] = {f.name: [] for f in _SCHEMA}
            for t in block.texts():
                base, every = spans(t, model)
                counts = Counter(s[0] for s in base)
                for k, name in enumerate(KINDS):
                    out[f"n_{name}"].append(counts[k])
                out["base_sha256"].append(hashlib.sha256(",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in base).encode()).hexdigest())
                out["spans"].append(",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in every))
                out["n_spans"].append(len(every))
            yield out | {"doc_id": block.rows.column(1)}

    ddl = "doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string, n_spans long"
    return map_blocks(docs, key, text, ddl, work, _SCHEMA)


def masked(text: str, model: Model) -> str:
    """The text with every span replaced by its kind in angle brackets; of overlapping spans one mark stays."""
    out, at = [], 0
    for a, b, kind in sorted((a, b, k) for k, a, b in spans(text, model)[1]):
        if b <= at:
            continue
        if a >= at:
            out += [text[at:a], f"<{KINDS[kind].upper()}>"]
        at = b
    return "".join([*out, text[at:]]) if out else text


def redact(docs: DataFrame, model: Model | None = None, text: str = "text", length: str = "n_chars") -> DataFrame:
    """`docs` with personal data masked in `text` (and `length`, if there is such a column, brought up to date); other columns stay."""
    model = model or fit(vote_counts(docs, text))
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, text):
            was = block.rows.column(names.index(text))
            now = [t if t is None else masked(t, model) for t in was.to_pylist()]
            columns = [pa.array(now, was.type) if n == text else c for n, c in zip(names, block.rows.columns, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, schema=block.rows.schema)

    out = docs.mapInArrow(run, docs.schema)
    if length in names:
        out = out.withColumn(length, F.when(F.col(text).isNull(), F.col(length)).otherwise(F.length(text)).cast(docs.schema[length].dataType))
    return out
