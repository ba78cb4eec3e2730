"""Document fingerprints: improbable-feature digests.

Every 32-byte window of a text gets the entropy of its bytes; a window is the rarer the fewer windows of the corpus
share its entropy level (a histogram over all documents). In each run of 64 neighbouring windows the rarest one gets a
vote; windows with enough votes are features. Features go into Bloom filters of 2048 bits, a new filter being chained on when
one has taken its share. Two digests are compared by the filters' common bits beyond what chance gives, normalised to 0..1.

Defined results: null text is empty; texts shorter than a window are one feature of their own; empty text has an empty
digest, which is like another empty one (1.0) and unlike all else (0.0); equal texts have equal digests; rows that share
an id keep one order (by the text's hash, then text); rows with a null id come after all others, in that order too; a single row is its own
next document; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm import words
from folio.llm.arrow import TextBlock, blocks, map_blocks

WINDOW = 32
RUN = 64
LEVELS = 256


@dataclass(frozen=True)
class FingerprintConfig:
    """`votes` of `RUN`: how many runs must choose a window; `load`: features per filter of `bits` bits."""

    votes: int = 16
    bits: int = 2048
    hashes: int = 5
    load: int = 160


#: c * log2(c) in units of 2**-16, for a count c of one byte value within a window.
_CLOG = np.round(np.array([0.0, *(c * np.log2(c) for c in range(1, WINDOW + 1))]) * 65536).astype(np.int64)
_MORE = np.diff(_CLOG)
_LESS = -_MORE
_FULL = int(WINDOW * np.log2(WINDOW) * 65536)


def entropy_levels(data: np.ndarray) -> np.ndarray:
    """Level 0..255 of the entropy of data[i:i + WINDOW], for every i; exact integer arithmetic."""
    n = len(data)
    if n < WINDOW:
        return np.zeros(0, np.uint8)
    back = np.zeros(n, np.uint8)  # equal bytes among the WINDOW - 1 before
    ahead = np.zeros(n, np.uint8)  # equal bytes among the WINDOW - 1 after
    step = 1 << 16
    for a in range(0, n, step):  # blocks that stay in the cache
        b = min(n, a + step)
        for d in range(1, WINDOW):
            lo = max(a, d)
            if lo < b:
                same = (data[lo:b] == data[lo - d : b - d]).view(np.uint8)
                back[lo:b] += same
                ahead[lo - d : b - d] += same
    change = np.empty(n - WINDOW + 1, np.int64)
    first = np.bincount(data[:WINDOW], minlength=256)
    change[0] = _CLOG[first].sum()
    # the byte that leaves has itself and its equals ahead in the old window; the one that enters has its equals among the WINDOW - 1 before
    change[1:] = _LESS[ahead[: n - WINDOW]] + _MORE[back[WINDOW:]]
    total = np.cumsum(change)
    return ((_FULL - total) * (LEVELS - 1) // _FULL).clip(0, LEVELS - 1).astype(np.uint8)


def features(data: np.ndarray, offsets: np.ndarray, rarity: np.ndarray, votes: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and row of every chosen window; rows shorter than a window have none."""
    n = len(data)
    if n < WINDOW:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    rank = rarity[entropy_levels(data)]
    w = len(rank)
    row = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(offsets))
    ok = row[:w] == row[WINDOW - 1 :]
    # smallest rank wins, the leftmost of equals; windows that reach into the next row never win against one that does not
    shift, kind = (22, np.uint32) if w < 1 << 22 else (40, np.uint64)
    value = np.where(ok, rank, LEVELS).astype(kind) << kind(shift)
    value |= np.arange(w, dtype=kind)
    size = 1
    while size < RUN:
        take = min(size, RUN - size)
        value = np.minimum(value[:-take], value[take:]) if len(value) > take else value[:0]
        size += take
    # a run lies within one row; so its winners ascend with it and their votes are lengths of equal stretches
    ends = np.arange(len(value)) + RUN - 1
    inside = ok[ends] & (row[: len(value)] == row[ends]) if len(value) else np.zeros(0, bool)
    winner = (value & kind((1 << shift) - 1))[inside]
    new = np.flatnonzero(np.concatenate([[True], winner[1:] != winner[:-1]])) if len(winner) else np.zeros(0, np.int64)
    count = np.diff(np.concatenate([new, [len(winner)]]))
    picked = winner[new].astype(np.int64)[count >= votes]
    have = np.zeros(len(offsets) - 1, bool)
    have[row[picked]] = True
    need = np.flatnonzero(~have & (np.diff(offsets) >= WINDOW))
    extra = []
    for r in need.tolist():  # fewer windows than a run, or no window with enough votes: its rarest window
        a, b = int(offsets[r]), int(offsets[r + 1]) - WINDOW + 1
        extra.append(a + int(np.argmin(rank[a:b])))
    starts = np.concatenate([picked, np.array(extra, np.int64)]).astype(np.int64)
    return starts, row[starts]


def digests(data: np.ndarray, offsets: np.ndarray, rarity: np.ndarray, config: FingerprintConfig) -> list[np.ndarray]:
    """For each row its chain of filters, as an array of shape (filters, bits / 8); empty rows have none."""
    n = len(offsets) - 1
    starts, row = features(data, offsets, rarity, config.votes)
    short = np.flatnonzero((np.diff(offsets) > 0) & (np.diff(offsets) < WINDOW))
    h = words.hashes(data, np.concatenate([starts, offsets[short]]), np.concatenate([starts + WINDOW, offsets[short + 1]]))
    row, at = np.concatenate([row, short]), np.concatenate([starts, offsets[short]])
    order = np.lexsort((at, row))
    h, row = h[order], row[order]
    count = np.bincount(row, minlength=n)
    begin = np.concatenate([[0], np.cumsum(count)])
    filters = -(-count // config.load)
    fbegin = np.concatenate([[0], np.cumsum(filters)])
    chain = fbegin[row] + (np.arange(len(h)) - begin[row]) // config.load
    bits = np.zeros((int(fbegin[-1]), config.bits), bool)
    for k in range(config.hashes):
        bits[chain, (words.mixed(h + np.uint64(k * 0x632BE59BD9B4E019 & (2**64 - 1))) % np.uint64(config.bits)).astype(np.int64)] = True
    packed = np.packbits(bits, axis=1)
    return [packed[a:b] for a, b in zip(fbegin, fbegin[1:], strict=False)]


def likeness(a: np.ndarray, b: np.ndarray, bits: int) -> float:
    """Mean over the shorter chain's filters of the best normalised overlap with the other chain's filters."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    if len(a) > len(b):
        a, b = b, a
    na, nb = np.bitwise_count(a).sum(1, dtype=np.int64), np.bitwise_count(b).sum(1, dtype=np.int64)
    common = np.stack([np.bitwise_count(x & b).sum(1, dtype=np.int64) for x in a])
    chance = na[:, None] * nb[None, :] / bits
    most = np.minimum(na[:, None], nb[None, :])
    score = np.where(most > chance, (common - chance) / np.maximum(most - chance, 1e-9), 0.0)
    best = float(np.clip(score, 0, 1).max(1).mean())
    if len(a) == len(b):  # the smaller chain's view must not depend on the order of the two
        best = max(best, float(np.clip(score, 0, 1).max(0).mean()))
    return best


def encoded(filters: np.ndarray) -> str:
    return base64.b64encode(filters.tobytes()).decode()


_LEVEL = pa.schema([("level", pa.int32()), ("n", pa.int64())])


def rarity_table(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Rank of each entropy level: 0 for the level that the fewest windows of all documents have (levels without any come last)."""

    def work(found: Iterator[TextBlock]) -> Iterator[dict]:
        total = np.zeros(LEVELS, np.int64)
        for block in found:
            if len(block.data) >= WINDOW:
                row = np.repeat(np.arange(len(block)), np.diff(block.offsets))
                ok = row[: len(row) - WINDOW + 1] == row[WINDOW - 1 :]
                total += np.bincount(entropy_levels(block.data)[ok], minlength=LEVELS)
        seen = np.flatnonzero(total)
        yield {"level": seen.astype(np.int32), "n": total[seen]}

    count = np.zeros(LEVELS, np.int64)
    for r in map_blocks(docs, None, text, "level int, n long", work, _LEVEL).groupBy("level").agg(F.sum("n").alias("n")).collect():  # LEVELS rows at most
        count[r["level"]] = r["n"]
    order = sorted(range(LEVELS), key=lambda k: (count[k] == 0, count[k], k))
    rank = np.empty(LEVELS, np.uint16)
    rank[order] = np.arange(LEVELS)
    return rank


def fingerprints(docs: DataFrame, rarity: np.ndarray, config: FingerprintConfig = FingerprintConfig(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and fingerprint of every row; no shuffle."""

    def work(found: Iterator[TextBlock]) -> Iterator[dict]:
        for block in found:
            yield {"doc_id": block.rows.column(1), "fingerprint": [encoded(f) for f in digests(block.data, block.offsets, rarity, config)]}

    return map_blocks(docs, key, text, "doc_id long, fingerprint string", work, pa.schema([("doc_id", pa.int64()), ("fingerprint", pa.string())]))


#: Bytes of text in a range at most; smaller tables are dealt to as many ranges as there are shuffle partitions, of SMALL bytes at least.
RANGE, SMALL = 256 << 20, 4 << 20


def _places(first, second) -> np.ndarray:
    """Pairs of signed numbers as byte strings that compare like them."""
    both = np.stack([np.asarray(first, np.int64), np.asarray(second, np.int64)], axis=1)
    return (both.view(np.uint64) ^ np.uint64(1 << 63)).astype(">u8").reshape(-1, 2).copy().view("S16").ravel()


def range_cuts(rows: DataFrame, parts: int) -> list[tuple[int, int]]:
    """Where ranges of (ord, h) begin: quantiles of ord; an ord that is several quantiles (many rows share an id, or have none) is cut by h."""
    if parts < 2:
        return []
    found = rows.agg(F.percentile_approx("ord", [k / parts for k in range(1, parts)], max(10_000, 20 * parts)).alias("q")).first()["q"] or []
    times: dict[int, int] = {}
    for c in found:
        times[int(c)] = times.get(int(c), 0) + 1
    return sorted((c, -(2**63) + k * (2**64 // n)) for c, n in times.items() for k in range(n))


def with_next(docs: DataFrame, key: str = "doc_id", text: str = "text", parts: int | None = None) -> DataFrame:
    """Rows dealt to ranges of descending id, each range followed by the first row of the next one (`own` false); the last range
    by the very first row. Columns ord, h, key, text, part, own; within a partition sorted for reading.

    The number of ranges follows the bytes of text. Only bounds and each range's first place travel to the driver and back, in broadcasts of 16 bytes a range.
    Rows that are equal in id and text stay in one range.
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.bitwise_not(F.col(f"`{key}`").cast("long")), F.lit(2**63 - 1)).alias("ord"), F.col(f"`{key}`").cast("long").alias("key"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("h", F.xxhash64("text"))
    if parts is None:
        size = rows.agg(F.sum(F.octet_length("text").cast("long")).alias("n")).first()["n"] or 0
        parts = max(1, -(-size // RANGE), min(int(spark.conf.get("spark.sql.shuffle.partitions")), size // SMALL))
    cuts = range_cuts(rows, parts)
    bounds = spark.sparkContext.broadcast(_places([c[0] for c in cuts], [c[1] for c in cuts]) if cuts else np.zeros(0, "S16"))

    @F.pandas_udf("int")
    def part_of(first: pd.Series, second: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds.value, _places(first, second), side="right").astype(np.int32))

    tagged = rows.withColumn("part", part_of("ord", "h"))
    heads = sorted((r["part"], r["at"]["ord"], r["at"]["h"]) for r in tagged.groupBy("part").agg(F.min(F.struct("ord", "h")).alias("at")).collect())  # one row a range
    if not heads:
        return tagged.withColumn("own", F.lit(True))
    begins = spark.sparkContext.broadcast((_places([x[1] for x in heads], [x[2] for x in heads]), np.roll([x[0] for x in heads], 1).astype(np.int32)))

    @F.pandas_udf("int")
    def closes(first: pd.Series, second: pd.Series) -> pd.Series:
        """The range that a row is the end of, if it is the first of the next one (the very first row closes the last range)."""
        places, prior = begins.value
        at = _places(first, second)
        k = np.minimum(np.searchsorted(places, at), len(places) - 1)
        return pd.Series(np.where(places[k] == at, prior[k], -1))

    both = tagged.withColumn("_closes", closes("ord", "h"))
    own, other = F.struct(F.col("part"), F.lit(True).alias("own")), F.struct(F.col("_closes").alias("part"), F.lit(False).alias("own"))
    sent = both.select("ord", "h", "key", "text", F.explode(F.when(F.col("_closes") >= 0, F.array(own, other)).otherwise(F.array(own))).alias("c")).select("ord", "h", "key", "text", "c.part", "c.own")
    return sent.repartitionById(len(cuts) + 1, "part").sortWithinPartitions("part", F.desc("own"), "ord", "h", "text")


_PAIRED = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("n_filters", pa.int64())])
_PAIRED_DDL = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_filters long"


def edited(text: str, following: str) -> str:
    """The last third of `text` (rounded down, code points) replaced by the beginning of `following`."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


def compared(docs: DataFrame, config: FingerprintConfig = FingerprintConfig(), key: str = "doc_id", text: str = "text", parts: int | None = None) -> DataFrame:
    """Fingerprints of every text and its edited text, and their likeness to it and to the next document's."""
    rarity = rarity_table(docs, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: tuple | None = None  # the last own row: it still lacks its next document

        def flush(group: list[tuple], following: str, after: np.ndarray) -> pa.RecordBatch:
            texts = [g[1] for g in group]
            nexts = [*texts[1:], following]
            changed = [edited(a, b) for a, b in zip(texts, nexts, strict=True)]
            raw = [c.encode() for c in changed]
            data = np.frombuffer(b"".join(raw), np.uint8)
            prints = digests(data, np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64), rarity, config)
            own = [g[2] for g in group]
            rows = {
                "doc_id": [g[0] for g in group], "n_chars": [len(t) for t in texts],
                "edited_sha256": [hashlib.sha256(x).hexdigest() for x in raw],
                "fingerprint": [encoded(f) for f in own], "edited_fingerprint": [encoded(f) for f in prints],
                "near_edited": [1.0 if a == b else likeness(x, y, config.bits) for a, b, x, y in zip(texts, changed, own, prints, strict=True)],
                "near_next": [1.0 if a == b else likeness(x, y, config.bits) for a, b, x, y in zip(texts, nexts, own, [*own[1:], after], strict=True)],
                "n_filters": [len(f) for f in own],
            }
            return pa.RecordBatch.from_arrays([pa.array(rows[f.name], f.type) for f in _PAIRED], schema=_PAIRED)

        part = None
        for block in blocks(batches):
            cols = {n: block.rows.column(k).to_pylist() for k, n in enumerate(block.rows.schema.names) if n in ("key", "part", "own")}
            prints, texts, group = digests(block.data, block.offsets, rarity, config), block.texts(), [waiting] if waiting else []
            waiting = None
            for k, words_ in enumerate(texts):
                if cols["part"][k] != part:
                    part, group = cols["part"][k], []
                if cols["own"][k]:
                    group.append((cols["key"][k], words_, prints[k]))
                elif group:  # the first row of the range that follows
                    yield flush(group, words_, prints[k])
                    group = []
            if len(group) > 1:
                yield flush(group[:-1], group[-1][1], group[-1][2])
            waiting = group[-1] if group else None

    return with_next(docs, key, text, parts).mapInArrow(run, _PAIRED_DDL)
