"""Secret scan through a trigram inverted index.

Each rule's regular expression is read into a Boolean trigram query: an OR of clauses, each an AND of the trigrams that
every match of that branch holds. A segment of documents (one Arrow slice) gets postings for the trigrams that the
queries name; clauses intersect postings, rules unite clauses, and only the documents that remain are verified with the
rule's regular expression. Rules without mandatory trigrams (hexadecimal runs) scan every document. Segments are
independent, so nothing is shuffled and a lost task repeats only its own segments.

Defined results: null text is empty; empty text has no spans; repeated rows are scanned one by one; matches of one kind
never overlap and are taken leftmost first; spans are ordered by start, then by the order of RULES, then by end; an empty table gives an
empty result. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from folio.llm.arrow import TextBlock, map_blocks

try:
    from re import _constants as sre
    from re import _parser as sre_parse
except ImportError:  # before Python 3.11
    import sre_constants as sre
    import sre_parse


@dataclass(frozen=True)
class Rule:
    """`group` and `least`: the group that must have so many characters, else the match is dropped."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    flags: int = re.ASCII

    def compiled(self) -> re.Pattern:
        return re.compile(self.pattern, self.flags)


BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, re.ASCII | re.IGNORECASE),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24),
)
#: Kinds that the method adds.
MORE = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 0, 15),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 40),
)
RULES = BASE + MORE
#: A regular expression is expanded into at most so many alternatives while its trigrams are derived.
MOST_BRANCHES = 64


def _strings(tree, fold: bool) -> list[list[str]]:
    """Alternatives of the pattern, each a list of literal runs that stand in every match of it."""
    done: list[list[str]] = [[""]]

    def close() -> None:
        for x in done:
            if x[-1]:
                x.append("")

    for op, arg in tree:
        inner, joined = None, True
        if op is sre.LITERAL:
            inner = [[chr(arg).lower() if fold else chr(arg)]]
        elif op is sre.SUBPATTERN:
            inner = _strings(arg[-1], fold)
        elif op is sre.BRANCH:
            inner = [s for part in arg[1] for s in _strings(part, fold)]
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[:2] == (0, 1):
            inner = [*_strings(arg[2], fold), [""]]
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[0] >= 1:
            inner, joined = _strings(arg[2], fold), False
        elif op is sre.IN and all(o is sre.LITERAL for o, _ in arg):
            inner = [[chr(a).lower() if fold else chr(a)] for _, a in arg]
        elif op is sre.AT:
            continue
        if inner is not None and len(done) * len(inner) <= MOST_BRANCHES:
            done = _crossed(done, inner, joined)
        else:  # anything may stand here, so the runs on its two sides are not joined
            close()
    return done


def _crossed(left: list[list[str]], right: list[list[str]], joined: bool) -> list[list[str]]:
    out = []
    for a in left:
        for b in right:
            if len(b) == 1 and joined:
                out.append([*a[:-1], a[-1] + b[0]])
            else:
                out.append([*a[:-1], a[-1] + b[0], *b[1:]] if joined else [*a[:-1], a[-1] + b[0], "", *b[1:], ""])
    return out


def trigram_query(rule: Rule) -> list[frozenset[bytes]]:
    """Clauses of lower-case trigrams: a matching text holds all trigrams of one clause. No clauses: scan fully."""
    tree = sre_parse.parse(rule.pattern, rule.flags)
    clauses = set()
    for runs in _strings(list(tree), bool(rule.flags & re.IGNORECASE)):
        grams = frozenset(run.lower().encode()[i : i + 3] for run in runs for i in range(len(run.lower().encode()) - 2))
        if not grams:
            return []
        clauses.add(grams)
    return [c for c in clauses if not any(other < c for other in clauses)]


class SegmentIndex:
    """Postings of chosen trigrams in one segment, over its text with A-Z in lower case."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, grams: list[bytes]):
        self.n = len(offsets) - 1
        fold = np.arange(256, dtype=np.uint8)
        fold[65:91] += 32
        low = fold[data].astype(np.uint32)
        code = (low[:-2] << 16) | (low[1:-1] << 8) | low[2:] if len(low) > 2 else np.zeros(0, np.uint32)
        keys = np.array(sorted(int.from_bytes(g, "big") for g in grams), np.uint32)
        table = _table(tuple(keys.tolist()))
        where = np.flatnonzero(table[code])
        row = np.searchsorted(offsets, where, side="right") - 1
        inside = where + 3 <= offsets[row + 1]
        where, row = where[inside], row[inside]
        pairs = np.unique((code[where].astype(np.int64) << 32) | row)
        gram, doc = pairs >> 32, pairs & 0xFFFFFFFF
        cuts = np.searchsorted(gram, [*keys.tolist(), 1 << 40])
        self.postings = {int(k).to_bytes(3, "big"): doc[a:b] for k, a, b in zip(keys, cuts, cuts[1:], strict=False)}

    def matching(self, clauses: list[frozenset[bytes]]) -> np.ndarray:
        if not clauses:
            return np.arange(self.n)
        found = np.zeros(self.n, bool)
        for clause in clauses:
            lists = sorted((self.postings[g] for g in clause), key=len)
            docs = lists[0]
            for more in lists[1:]:
                docs = np.intersect1d(docs, more, assume_unique=True)
            found[docs] = True
        return np.flatnonzero(found)


_TABLES: dict[tuple[int, ...], np.ndarray] = {}


def _table(keys: tuple[int, ...]) -> np.ndarray:
    if keys not in _TABLES:
        _TABLES[keys] = np.zeros(1 << 24, bool)
        _TABLES[keys][list(keys)] = True
    return _TABLES[keys]


_SCHEMA = pa.schema([("doc_id", pa.int64()), *[(f"n_{r.kind}", pa.int64()) for r in BASE], ("base_sha256", pa.string()), ("spans", pa.string()), ("n_spans", pa.int64())])
_DDL = "doc_id long, " + ", ".join(f"n_{r.kind} long" for r in BASE) + ", base_sha256 string, spans string, n_spans long"


def _verifier(rule: Rule) -> re.Pattern:
    """Hexadecimal runs may ask for their length at once: the runs of one class are maximal either way."""
    if m := re.fullmatch(r"(\[[^\]]+\])\+", rule.pattern):
        return re.compile(f"{m[1]}{{{rule.least},}}", rule.flags)
    return rule.compiled()


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, counts and digest of the base kinds, and all spans as kind:start:end."""
    queries = [trigram_query(r) for r in rules]
    grams = sorted({g for q in queries for c in q for g in c})
    base = len(BASE)

    def work(found: Iterator[TextBlock]) -> Iterator[dict]:
        compiled = [_verifier(r) for r in rules]
        for block in found:
            index, texts = SegmentIndex(block.data, block.offsets, grams), block.texts()
            hits: list[list[tuple[int, int, int]]] = [[] for _ in texts]
            for k, rule in enumerate(rules):
                group, least, finditer = rule.group, rule.least, compiled[k].finditer
                for d in index.matching(queries[k]).tolist():
                    for m in finditer(texts[d]):
                        if m.end(group) - m.start(group) >= least:
                            hits[d].append((m.start(), k, m.end()))
            out: dict[str, list] = {f.name: [] for f in _SCHEMA}
            for spans in hits:
                spans.sort()
                said = [f"{rules[k].kind}:{a}:{b}" for a, k, b in spans]
                first = [s for s, x in zip(said, spans, strict=True) if x[1] < base]
                for k in range(base):
                    out[f"n_{rules[k].kind}"].append(sum(x[1] == k for x in spans))
                out["base_sha256"].append(hashlib.sha256(",".join(first).encode()).hexdigest())
                out["spans"].append(",".join(said))
                out["n_spans"].append(len(spans))
            yield out | {"doc_id": block.rows.column(1)}

    return map_blocks(docs, key, text, _DDL, work, _SCHEMA)
