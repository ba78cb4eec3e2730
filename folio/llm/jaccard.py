"""N-gram Jaccard self-join by a token-group matrix: exact components of documents whose shingle sets are alike.

Sets that look alike are dealt to groups of bounded size, and each group's token union is stored. A query set is held against the stored
unions first: how many of its tokens a union holds is an upper bound of what any member shares with it. Only groups whose bound reaches
what a link needs are opened, and their members compared.

1. Every document is hashed into its set (profiles): size and two checksums; equal profiles are one class.
2. Tokens have a common order: those that many documents hold (hot ones, a bounded list that is broadcast) come last, others by hash. The
   first half of each set leads. Of a set that links, at least (half of it less the quarter that may be missing) of its leading tokens
   lead in its partner too. Buckets count the cold leading tokens that a class has in common with any other; hot ones need no counting and do
   not travel. A class with fewer common tokens has no partner; the others' sets are kept.
3. Groups: a set with enough hot leading tokens goes to the first of them, else to the most frequent cold leading token that it shares, among
   those that fit a group. Groups hold sets of one band of sizes (linked sets are in the same band or in neighbouring ones); larger ones are cut by
   hash. The most central sets that lead with a group's token (those with the largest share of hot tokens, which copies are made
   from rather than others) are guests in all parts of it. All members of a group are compared by one product of incidence matrices; what
   links becomes a component. The union of the members' leading tokens is stored.
4. The matrix: stored unions and queries' leading tokens meet by token; a hot token's queries are spread over several tasks, to each of
   which the unions that hold it are sent. Counted are pairs of a query and a group of a band in reach that holds a member of a larger component
   (of two components the smaller one asks). Pairs whose count reaches the bound are asked: the group is opened and its members are compared
   with the query.

Every pair that could link thus is in one component already, in one group, or verified; links inside a component that is known need no further
proof, so a large group of copies costs groups, not all its pairs. Where very many sets of like size share more than half of their tokens but do not
link, each still asks all groups of the others: pairs of sets and groups then grow with the square of their number over `cell`.

Sets are sets of 64-bit hashes of shingles, classes are told apart by size and 128 bits of checksum; links are exact for the hashes. That a
collision changes a document's links is less likely than one in a million for 10**11 documents, as several of its tokens would have to collide.

Defined results: null or empty text, or text without words, has n_shingles 0 and is its own component; fewer words than the width give
one shingle; rows with a null id have a null component and link with nothing; rows that share an id count as one document with the
links of all their texts; repeated rows are alike and change nothing; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.arrow import TextBlock, map_blocks
from folio.llm.components import Forest, connected
from folio.llm.scratch import dropped, saved
from folio.llm.words import lowered, mixed, shingle_sets


@dataclass(frozen=True)
class JaccardConfig:
    """Link where 100 * intersection >= percent * union. `lead`: percent of a set's tokens that are searched by; `cell` and
    `cell_tokens`: members of a group and their tokens; `bucket`: leading tokens of a bucket; `hot`: a token may be put last in the order from so
    many documents on, `hot_most`: but so many tokens at most (the most frequent ones), whatever the size of the corpus."""

    width: int = 5
    percent: int = 75
    lead: int = 50
    cell: int = 768
    cell_tokens: int = 2_000_000
    bucket: int = 200_000
    hot: int = 64
    hot_most: int = 400_000


def _least(n: np.ndarray | int, percent: int):
    """The smallest overlap that a set of n tokens has with any set it links with."""
    return (percent * n + 99) // 100


def _lead(n, config: JaccardConfig, larger=np.maximum):
    """How many tokens a set of n is searched by: no fewer than any two linked sets need to share one."""
    return larger(n - _least(n, config.percent) + 1, (config.lead * n + 99) // 100)


def fewest_shared(n: int, config: JaccardConfig) -> int:
    """A lower bound of the leading tokens that a set of n shares with the leading tokens of any set it links with.

    Of two linked sets take the one whose leading tokens end first in the order, of size m: those of them that the other holds lead there
    too, and all but m - least(m) are held. m is no smaller than least(n); the bound for that size may exceed that for larger ones by 1.
    """
    m = _least(n, config.percent)
    return max(1, _lead(m, config, max) - (m - _least(m, config.percent)) - 1)


def _sets(block: TextBlock, width: int) -> tuple[np.ndarray, np.ndarray]:
    return shingle_sets(lowered(block.data), block.offsets, width)


def _sums(tokens: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two checksums of each set."""
    out = []
    for seed in (0x243F6A8885A308D3, 0x13198A2E03707344):
        total = np.zeros(len(tokens) + 1, np.uint64)
        np.cumsum(mixed(tokens + np.uint64(seed)), out=total[1:])
        out.append((total[at[1:]] - total[at[:-1]]).view(np.int64))
    return out[0], out[1]


_PROFILE = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("tokens", pa.binary()), ("counts", pa.binary())])


#: Tokens whose counts a task keeps at most; beyond it drops the least frequent ones.
TALLY = 1 << 20


class Tally:
    """Counts of the tokens that several sets of a block hold, over all blocks of a task."""

    def __init__(self) -> None:
        self.tokens, self.counts, self.floor = np.zeros(0, np.uint64), np.zeros(0, np.int64), 2

    def add(self, tokens: np.ndarray) -> None:
        value, count = np.unique(tokens, return_counts=True)
        value, count = value[count > 1], count[count > 1]
        self.tokens, where = np.unique(np.concatenate([self.tokens, value]), return_inverse=True)
        self.counts = np.bincount(where, weights=np.concatenate([self.counts, count])).astype(np.int64)
        while len(self.tokens) > TALLY:
            self.floor *= 2
            self.tokens, self.counts = self.tokens[self.counts >= self.floor], self.counts[self.counts >= self.floor]


def profiles(docs: DataFrame, config: JaccardConfig, key: str, text: str) -> DataFrame:
    """Per row: id, size of its set and checksums; on the last block's first row also the tokens that three sets of the task or more hold, as far as
    several of them are in one block. So tokens of about one document in a thousand or more are found, which is what `hot_tokens` is for."""

    def work(found: Iterator[TextBlock]) -> Iterator[dict]:
        tally, waiting = Tally(), None
        for block in found:
            tokens, at = _sets(block, config.width)
            n = np.diff(at)
            h1, h2 = _sums(tokens, at)
            _, once = np.unique(h1, return_index=True)
            chosen = np.zeros(len(n), bool)
            chosen[once] = True  # copies count once
            tally.add(tokens[np.repeat(chosen, n)])
            if waiting:
                yield waiting
            none = [None] * len(n)
            waiting = {"doc_id": block.rows.column(1), "n": n, "h1": h1, "h2": h2, "tokens": none, "counts": none}
        if waiting:
            many = tally.counts >= 3
            rest = waiting["tokens"][1:]
            yield waiting | {"tokens": [tally.tokens[many].tobytes(), *rest], "counts": [tally.counts[many].tobytes(), *rest]}

    return map_blocks(docs, key, text, "doc_id long, n long, h1 long, h2 long, tokens binary, counts binary", work, _PROFILE)


def hot_tokens(profile: DataFrame, config: JaccardConfig) -> tuple[np.ndarray, np.ndarray]:
    """Tokens that many documents hold, and how many: all from a power of two on, the least that `hot` and `hot_most` allow."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(t, np.int64)), pa.array(np.frombuffer(c, np.int64))], names=["token", "n"])

    counted = profile.where("tokens is not null").select("tokens", "counts").mapInArrow(unpack, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    counted = saved(counted.where(F.col("n") >= config.hot).withColumn("power", F.floor(F.log2("n")).cast("int")), "frequent-tokens")
    least, room = 64, config.hot_most
    for r in sorted(counted.groupBy("power").count().collect(), reverse=True):  # 64 rows at most
        if room < r["count"]:
            break
        least, room = r["power"], room - r["count"]
    found = sorted((r["token"] % (1 << 64), r["n"]) for r in counted.where(F.col("power") >= least).select("token", "n").collect())  # hot_most rows at most
    dropped(counted)
    return np.array([t for t, _ in found], np.uint64), np.array([n for _, n in found], np.int64)


def arranged(tokens: np.ndarray, at: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's tokens in the common order, and how many of them are cold."""
    n = np.diff(at)
    if not len(hot) or not len(tokens):
        return tokens, n
    is_hot = hot[np.minimum(np.searchsorted(hot, tokens), len(hot) - 1)] == tokens
    if not is_hot.any():
        return tokens, n
    row = np.repeat(np.arange(len(n)), n)
    return tokens[np.argsort(2 * row + is_hot, kind="stable")], n - np.bincount(row[is_hot], minlength=len(n))


#: Lower bytes of a token that travel beside its bucket, which is named by upper bits; tokens that are equal in these only make candidates, which are verified.
TOKEN_BYTES = 6


def _short(tokens: np.ndarray) -> bytes:
    return np.ascontiguousarray(tokens.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :TOKEN_BYTES]).tobytes()


def _long(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // TOKEN_BYTES, 8), np.uint8)
    out[:, :TOKEN_BYTES] = np.frombuffer(raw, np.uint8).reshape(-1, TOKEN_BYTES)
    return out.view("<u8").ravel()


_DEALT = pa.schema([("bucket", pa.int64()), ("side", pa.int32()), ("tokens", pa.binary()), ("ids", pa.binary()), ("marks", pa.binary()), ("places", pa.binary())])
_DEALT_DDL = "bucket long, side int, tokens binary, ids binary, marks binary, places binary"
#: Tokens that a task deals out at once.
DEAL = 1 << 20


class Dealer:
    """Collects tokens with the ids that hold them (and a mark of each id) and gives rows by bucket: distinct ids, and for each token its id's place."""

    def __init__(self, side: int = 0):
        self.side, self.kept, self.size = side, [], 0

    def add(self, bucket: np.ndarray, tokens: np.ndarray, ids: np.ndarray, marks: np.ndarray) -> Iterator[dict]:
        self.kept.append((bucket, tokens, ids, marks))
        self.size += len(tokens)
        if self.size >= DEAL:
            yield self.rows()

    def rows(self) -> dict:
        bucket, tokens, ids, marks = (np.concatenate(x) for x in zip(*self.kept, strict=True))
        self.kept, self.size = [], 0
        order = np.argsort(bucket, kind="stable")
        bucket, tokens, ids, marks = bucket[order], tokens[order], ids[order], marks[order]
        first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
        out: dict = {"bucket": bucket[first], "side": np.full(len(first), self.side, np.int32), "tokens": [], "ids": [], "marks": [], "places": []}
        for a, b in zip(first.tolist(), [*first[1:].tolist(), len(bucket)], strict=True):
            known, one, place = np.unique(ids[a:b], return_index=True, return_inverse=True)
            out["tokens"].append(_short(tokens[a:b]))
            out["ids"].append(known.tobytes())
            out["marks"].append(marks[a:b][one].tobytes())
            out["places"].append(place.astype(np.uint16 if len(known) < 1 << 16 else np.uint32).tobytes())
        return out

    def rest(self) -> Iterator[dict]:
        if self.size:
            yield self.rows()


def _batch(columns: dict, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


def _held(group: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of dealt rows: tokens, the place of each one's id, the distinct ids and their marks."""
    rows = list(zip(*(group.column(c).to_pylist() for c in ("tokens", "ids", "marks", "places")), strict=True))
    if not rows:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    known, marks = [np.frombuffer(r[1], np.int64) for r in rows], [np.frombuffer(r[2], np.int64) for r in rows]
    ids, one, where = np.unique(np.concatenate(known), return_index=True, return_inverse=True)
    at = np.cumsum([0, *map(len, known)])
    places = np.concatenate([where[a + np.frombuffer(r[3], np.uint16 if len(k) < 1 << 16 else np.uint32)] for r, k, a in zip(rows, known, at, strict=False)])
    return np.concatenate([_long(r[0]) for r in rows]), places, ids, np.concatenate(marks)[one]


def _common(tokens: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct pairs of token and id, by token, of tokens that two ids or more have."""
    for distinct in (False, True):
        order = np.lexsort((places, tokens)) if distinct else np.argsort(tokens, kind="stable")
        tokens, places = tokens[order], places[order]
        if distinct:
            new = np.ones(len(tokens), bool)
            new[1:] = (tokens[1:] != tokens[:-1]) | (places[1:] != places[:-1])
            tokens, places = tokens[new], places[new]
        same, often = tokens[1:] == tokens[:-1], np.zeros(len(tokens), bool)
        often[1:] |= same
        often[:-1] |= same
        tokens, places = tokens[often], places[often]
    return tokens, places


def _bucket_of(tokens: np.ndarray, bits: int) -> np.ndarray:
    return (tokens >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(tokens), np.int64)


def _pieces(ids: np.ndarray, bits: int) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Where ascending unsigned ids are cut by their upper bits: the pieces' names and stretches."""
    piece = _bucket_of(ids, bits)
    first = np.flatnonzero(np.concatenate([[True], piece[1:] != piece[:-1]])) if len(ids) else np.zeros(0, np.int64)
    return piece[first], list(zip(first.tolist(), [*first[1:].tolist(), len(ids)], strict=True)) if len(ids) else []


# --- which classes can have a partner --------------------------------------------------------------------------------------------


def leading_blocks(docs: DataFrame, hot: np.ndarray, bits: int, pieces: int, config: JaccardConfig, key: str, text: str) -> DataFrame:
    """Cold leading tokens of all documents by bucket, with the sets' first checksums as ids; buckets below 0 (by pieces of the ids) say how many
    hot tokens a set leads with."""

    def work(found: Iterator[TextBlock]) -> Iterator[dict]:
        cold_ones, hot_ones, seen = Dealer(), Dealer(1), set()
        for block in found:
            tokens, at = _sets(block, config.width)
            sums, ok, n = _sums(tokens, at)[0], np.asarray(block.rows.column(1).is_valid()), np.diff(at)
            tokens, cold = arranged(tokens, at, hot)
            fresh = np.zeros(len(n), bool)
            for k in np.flatnonzero(ok & (n > 0)).tolist():  # copies count once
                if (h := int(sums[k])) not in seen:
                    seen.add(h)
                    fresh[k] = True
            lead = np.where(fresh, _lead(n, config), 0)
            mine = np.minimum(lead, cold)
            place = np.arange(len(tokens)) - np.repeat(at[:-1], n) < np.repeat(mine, n)
            sent = tokens[place]
            yield from cold_ones.add(_bucket_of(sent, bits), sent, np.repeat(sums, n)[place], np.zeros(len(sent), np.int64))
            more = np.flatnonzero(lead > mine)
            if len(more):
                ids = sums[more]
                yield from hot_ones.add(-1 - _bucket_of(ids.view(np.uint64), pieces), np.zeros(len(ids), np.uint64), ids, (lead - mine)[more])
            if len(seen) > DEAL:
                seen.clear()
        yield from cold_ones.rest()
        yield from hot_ones.rest()

    return map_blocks(docs, key, text, _DEALT_DDL, work, _DEALT)


_COUNTS = pa.schema([("piece", pa.int64()), ("ids", pa.binary()), ("values", pa.binary()), ("tokens", pa.binary())])
_COUNTS_DDL = "piece long, ids binary, values binary, tokens binary"


def _cut(ids: np.ndarray, values: np.ndarray, tokens: np.ndarray | None, bits: int) -> pa.Table:
    order = np.argsort(ids.view(np.uint64))  # unsigned, so that pieces are stretches
    ids, values = ids[order], values[order].astype(np.int64)
    names, cuts = _pieces(ids.view(np.uint64), bits)
    own = [tokens[order][a:b].tobytes() for a, b in cuts] if tokens is not None else [None] * len(cuts)
    return pa.table({"piece": pa.array(names, pa.int64()), "ids": pa.array([ids[a:b].tobytes() for a, b in cuts], pa.binary()), "values": pa.array([values[a:b].tobytes() for a, b in cuts], pa.binary()), "tokens": pa.array(own, pa.binary())}, schema=_COUNTS)


def _shared(bits: int) -> Callable[[pa.Table], pa.Table]:
    """How many tokens of a bucket each class has in common with any other; a row for each piece (the id's upper bits) that has any."""

    def run(group: pa.Table) -> pa.Table:
        tokens, places, ids, marks = _held(group)
        if group.column("bucket")[0].as_py() < 0:
            return _cut(ids, marks, None, bits)
        count = np.bincount(_common(tokens, places)[1], minlength=len(ids))
        return _cut(ids[count > 0], count[count > 0], None, bits)

    return run


_SUMS = pa.schema([("h1", pa.int64()), ("_s", pa.int64())])


def _summed(group: pa.Table) -> pa.Table:
    """The classes of a piece with the sums of their counts."""
    ids = np.concatenate([np.frombuffer(x, np.int64) for x in group.column("ids").to_pylist()])
    values = np.concatenate([np.frombuffer(x, np.int64) for x in group.column("values").to_pylist()])
    known, place = np.unique(ids, return_inverse=True)
    return pa.table({"h1": pa.array(known, pa.int64()), "_s": pa.array(np.bincount(place, weights=values).astype(np.int64), pa.int64())}, schema=_SUMS)


# --- sets and their groups ---------------------------------------------------------------------------------------------------------

_SET = pa.schema([("doc_id", pa.int64()), ("sid", pa.int64()), ("n", pa.int64()), ("tokens", pa.binary()), ("cold", pa.int64()), ("home", pa.int64()), ("heads", pa.list_(pa.int64())), ("central", pa.float64())])
_SET_DDL = "doc_id long, sid long, n long, tokens binary, cold long, home long, heads array<long>, central double"
#: Hot leading tokens in whose groups a set may be a guest, and guests of a group by band.
HEADS, GUESTS = 8, 3
#: Groups that are cut into parts are broadcast up to this number of them, and joined beyond it.
BROADCAST_GROUPS = 1_000_000


def _full_sets(docs: DataFrame, hot: np.ndarray, config: JaccardConfig) -> DataFrame:
    """Sets in the common order, how many of their leading tokens are cold, the group of those with enough hot leading tokens, and the share of hot ones."""

    def work(found: Iterator[TextBlock]) -> Iterator[dict]:
        for block in found:
            tokens, at = _sets(block, config.width)
            sums, n = _sums(tokens, at)[0], np.diff(at)
            tokens, cold = arranged(tokens, at, hot)
            lead = _lead(n, config)
            mine, home = np.minimum(lead, cold), np.zeros(len(n), np.int64)
            known, heads = np.zeros(len(n), bool), [None] * len(n)
            for k in np.flatnonzero(lead > mine).tolist():
                if lead[k] - mine[k] >= fewest_shared(int(n[k]), config):
                    token = tokens[at[k] + cold[k]]
                    known[k], home[k] = True, np.int64(token.view(np.int64))
                    heads[k] = tokens[at[k] + cold[k] : at[k] + min(lead[k], cold[k] + HEADS)].view(np.int64)
            yield {
                "doc_id": block.rows.column(1), "sid": sums, "n": n, "tokens": [tokens[a:b].tobytes() for a, b in zip(at, at[1:], strict=False)],
                "cold": mine, "home": pa.array(home, pa.int64(), mask=~known), "heads": heads, "central": (n - cold) / np.maximum(n, 1),
            }

    return map_blocks(docs, "key", "text", _SET_DDL, work, _SET)


def _flat(batch: pa.RecordBatch, step: int = 512) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of a batch with their `tokens` in one array, and where each row's begin."""
    for start in range(0, batch.num_rows, step):
        part = batch.slice(start, step)
        raw = part.column(part.schema.get_field_index("tokens")).to_pylist()
        yield part, np.frombuffer(b"".join(raw), np.uint64), np.cumsum([0, *(len(r) // 8 for r in raw)])


def _home_blocks(sets: DataFrame, bits: int) -> DataFrame:
    """Cold leading tokens of sets by bucket."""

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dealer = Dealer()
        for b in found:
            for part, tokens, at in _flat(b):
                n, sids = np.diff(at), part.column(0).to_numpy()
                place = np.arange(len(tokens)) - np.repeat(at[:-1], n) < np.repeat(part.column(2).to_numpy(), n)
                sent = tokens[place]
                for out in dealer.add(_bucket_of(sent, bits), sent, np.repeat(sids, n)[place], np.zeros(len(sent), np.int64)):
                    yield _batch(out, _DEALT)
        for out in dealer.rest():
            yield _batch(out, _DEALT)

    return sets.where("home is null").select("sid", "tokens", "cold").mapInArrow(run, _DEALT_DDL)


def _best(ids: np.ndarray, score: np.ndarray, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each id the token with the highest score, the smallest of equals."""
    order = np.lexsort((tokens, -score, ids))
    first = order[np.flatnonzero(np.concatenate([[True], ids[order][1:] != ids[order][:-1]]))] if len(ids) else order
    return ids[first], score[first], tokens[first]


def _votes(bits: int, cell: int) -> Callable[[pa.Table], pa.Table]:
    """The token of a bucket that each set would be grouped by: the most frequent of those that fit a group, else the rarest."""

    def run(group: pa.Table) -> pa.Table:
        held, places, ids, _ = _held(group)
        tokens, places = _common(held, places)
        if not len(tokens):
            return _cut(ids[:0], ids[:0], held[:0], bits)
        first = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
        size = np.diff([*first.tolist(), len(tokens)])
        return _cut(*_best(ids[places], np.repeat(np.where(size <= cell, size, -size), size), tokens), bits)

    return run


_HOMES = pa.schema([("sid", pa.int64()), ("voted", pa.int64())])


def _elected(group: pa.Table) -> pa.Table:
    ids, score, tokens = (np.concatenate([np.frombuffer(x, kind) for x in group.column(c).to_pylist()]) for c, kind in (("ids", np.int64), ("values", np.int64), ("tokens", np.uint64)))
    ids, _, tokens = _best(ids, score, tokens)
    return pa.table({"sid": pa.array(ids, pa.int64()), "voted": pa.array(tokens.view(np.int64), pa.int64())}, schema=_HOMES)


def overlaps(left: list[np.ndarray], right: list[np.ndarray], step: int = 8192) -> np.ndarray:
    """Sizes of all intersections of sets left[i] and right[j], by products of incidence matrices over their common tokens."""
    out = np.zeros((len(left), len(right)))
    lt, rt = np.concatenate(left), np.concatenate(right)
    if left is right:
        common, times = np.unique(lt, return_counts=True)
        common = common[times > 1]  # the diagonal is not asked for
    else:
        common = np.intersect1d(lt, rt)
    if not len(common):
        return out

    def cells(sets: list[np.ndarray], flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        col = np.minimum(np.searchsorted(common, flat), len(common) - 1)
        hit = common[col] == flat
        return row[hit], col[hit]

    (lr, lc), (rr, rc) = cells(left, lt), cells(right, rt)
    for a in range(0, len(common), step):
        b = min(a + step, len(common))
        m, k = np.zeros((len(left), b - a), np.float32), np.zeros((len(right), b - a), np.float32)
        x, y = (lc >= a) & (lc < b), (rc >= a) & (rc < b)
        m[lr[x], lc[x] - a] = 1
        k[rr[y], rc[y] - a] = 1
        out += m @ k.T
    return out


_LINK = pa.schema([("src", pa.int64()), ("dst", pa.int64()), ("union", pa.binary())])
_LINK_DDL = "src long, dst long, union binary"


def _columns(group: pa.Table) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    ids = group.column("doc_id").to_numpy()
    return ids, group.column("n").to_numpy(), [np.frombuffer(t, np.uint64) for t in group.column("tokens").to_pylist()]


def _links(pairs: list[tuple[int, int]], union: tuple[int, bytes] | None = None) -> pa.Table:
    """Rows of links; the last row may be a group and its union."""
    a, b, u = [p[0] for p in pairs], [p[1] for p in pairs], [None] * len(pairs)
    if union:
        a, b, u = [*a, union[0]], [*b, None], [*u, union[1]]
    return pa.table({"src": pa.array(a, pa.int64()), "dst": pa.array(b, pa.int64()), "union": pa.array(u, pa.binary())}, schema=_LINK)


def _grouped(config: JaccardConfig) -> Callable[[pa.Table], pa.Table]:
    """Links within a group, and the union of its members' leading tokens."""

    def run(group: pa.Table) -> pa.Table:
        ids, n, sets = _columns(group)
        guest = group.column("guest").to_numpy(zero_copy_only=False)
        common = overlaps(sets, sets)
        i, j = np.nonzero(np.triu(100 * common >= config.percent * (n[:, None] + n[None, :] - common), 1))
        f = Forest()
        pairs = [(a, b) for a, b in zip(ids[i].tolist(), ids[j].tolist(), strict=True) if a != b and f.join(a, b)]
        lead = _lead(n, config)
        union = np.unique(np.concatenate([s[:k] for s, k, g in zip(sets, lead.tolist(), guest.tolist(), strict=True) if not g]))
        return _links(pairs, (group.column("gid")[0].as_py(), union.tobytes()))

    return run


# --- the matrix of tokens and groups ------------------------------------------------------------------------------------------------


def _matrix_blocks(rows: DataFrame, side: int, hot: np.ndarray, hot_n: np.ndarray, bits: int, config: JaccardConfig) -> DataFrame:
    """Tokens of queries (side 0: id, tokens, rank, how many lead) or of unions (side 1: all lead) by bucket. A hot token that many documents hold has buckets
    of its own: one query is in one of them, a union in all."""
    heavy = np.maximum(1, hot_n * 4 // config.bucket)
    base = np.concatenate([[0], np.cumsum(heavy)])

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dealer = Dealer(side)
        for b in found:
            for part, tokens, at in _flat(b):
                n = np.diff(at)
                place = np.arange(len(tokens)) - np.repeat(at[:-1], n) < np.repeat(part.column(3).to_numpy(), n)
                sent, ids, marks = tokens[place], np.repeat(part.column(0).to_numpy(), n)[place], np.repeat(part.column(2).to_numpy(), n)[place]
                bucket = _bucket_of(sent, bits)
                if len(hot):
                    k = np.minimum(np.searchsorted(hot, sent), len(hot) - 1)
                    many = (hot[k] == sent) & (heavy[k] > 1)
                    k = k[many]
                    if side:
                        salts = heavy[k]
                        own = np.repeat(base[k], salts) + np.arange(int(salts.sum())) - np.repeat(np.concatenate([[0], np.cumsum(salts)[:-1]]), salts) if len(k) else k
                        sent, ids, marks = (np.concatenate([x[~many], np.repeat(x[many], salts)]) for x in (sent, ids, marks))
                    else:
                        own = base[k] + mixed(ids[many].view(np.uint64)) % heavy[k].astype(np.uint64)
                        sent, ids, marks = (np.concatenate([x[~many], x[many]]) for x in (sent, ids, marks))
                    bucket = np.concatenate([bucket[~many], -1 - own.astype(np.int64)])
                for out in dealer.add(bucket, sent, ids, marks):
                    yield _batch(out, _DEALT)
        for out in dealer.rest():
            yield _batch(out, _DEALT)

    return rows.mapInArrow(run, _DEALT_DDL)


#: Lower bits of a rank, which hold the band of sizes.
BAND_BITS = 7
_MET = pa.schema([("piece", pa.int64()), ("pairs", pa.binary()), ("counts", pa.binary())])
_PAIRS = pa.schema([("sid", pa.int64()), ("gid", pa.int64()), ("_s", pa.int64())])
#: Pairs of a query's token and a group that are expanded at once.
EXPAND = 1 << 22


def _met(pieces: int) -> Callable[[pa.Table], pa.Table]:
    """For each query and group how many tokens of this bucket both have, where the group holds a component of higher rank and its band is in reach;
    a row for each piece of queries (their ids' upper bits)."""

    def run(group: pa.Table) -> pa.Table:
        sides = group.column("side").to_numpy()
        qt, qp, qid, rank = _held(group.filter(pa.array(sides == 0)))
        gt, gp, gid, top = _held(group.filter(pa.array(sides == 1)))
        if not len(qt) or not len(gt):
            return _MET.empty_table()
        (rank, own), (top, band) = ((x >> BAND_BITS, x & ((1 << BAND_BITS) - 1)) for x in (rank, top))
        order = np.argsort(gt, kind="stable")
        gt, gp = gt[order], gp[order]
        first = np.flatnonzero(np.concatenate([[True], gt[1:] != gt[:-1]]))
        known, size, most = gt[first], np.diff([*first.tolist(), len(gt)]), np.maximum.reduceat(top[gp], first)
        k = np.minimum(np.searchsorted(known, qt), len(known) - 1)
        able = (known[k] == qt) & (rank[qp] < most[k])
        k, q = k[able], qp[able]
        total, a = np.cumsum(size[k]), 0
        kept = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        while a < len(k):
            b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + EXPAND, side="right")))
            times = size[k[a:b]]
            within = np.arange(int(times.sum())) - np.repeat(np.concatenate([[0], np.cumsum(times)[:-1]]), times)
            x, y = np.repeat(q[a:b], times), gp[np.repeat(first[k[a:b]], times) + within]
            above = (rank[x] < top[y]) & (np.abs(own[x] - band[y]) <= 1)
            kept.append(np.unique(x[above] * len(gid) + y[above], return_counts=True))
            a = b
        pair, where = np.unique(np.concatenate([p for p, _ in kept]), return_inverse=True)
        count = np.bincount(where, weights=np.concatenate([c for _, c in kept]), minlength=len(pair)).astype(np.int64)
        sid, other = qid[pair // len(gid)], gid[pair % len(gid)]
        order = np.argsort(sid.view(np.uint64), kind="stable")
        sid, both, count = sid[order], np.stack([sid[order], other[order]], axis=1), count[order]
        names, cuts = _pieces(sid.view(np.uint64), pieces)
        return pa.table({"piece": pa.array(names, pa.int64()), "pairs": pa.array([both[a:b].tobytes() for a, b in cuts], pa.binary()), "counts": pa.array([count[a:b].tobytes() for a, b in cuts], pa.binary())}, schema=_MET)

    return run


def _total(group: pa.Table) -> pa.Table:
    """Pairs of a piece's queries and groups with the sums of their counts."""
    pairs = np.frombuffer(b"".join(group.column("pairs").to_pylist()), np.int64).reshape(-1, 2)
    count = np.frombuffer(b"".join(group.column("counts").to_pylist()), np.int64)
    order = np.lexsort((pairs[:, 1], pairs[:, 0]))
    pairs, count = pairs[order], count[order]
    first = np.flatnonzero(np.concatenate([[True], (pairs[1:] != pairs[:-1]).any(1)]))
    return pa.table({"sid": pa.array(pairs[first, 0], pa.int64()), "gid": pa.array(pairs[first, 1], pa.int64()), "_s": pa.array(np.add.reduceat(count, first), pa.int64())}, schema=_PAIRS)


def _opened(percent: int) -> Callable[[pa.Table], pa.Table]:
    """Links between queries and members of other components."""

    def run(group: pa.Table) -> pa.Table:
        asks = group.column("ask").to_numpy(zero_copy_only=False)
        parts = [group.filter(pa.array(asks)), group.filter(pa.array(~asks))]
        if not all(p.num_rows for p in parts):
            return _links([])
        (qi, qn, qs), (mi, mn, ms) = (_columns(p) for p in parts)
        qc, mc = (p.column("component").to_numpy() for p in parts)
        common = overlaps(qs, ms)
        i, j = np.nonzero((100 * common >= percent * (qn[:, None] + mn[None, :] - common)) & (qc[:, None] != mc[None, :]))
        f = Forest()
        return _links([(int(qi[a]), int(mi[b])) for a, b in zip(i.tolist(), j.tolist(), strict=True) if f.join(int(qc[a]), int(mc[b]))])

    return run


#: Copies from which on a class may count as very large.
COPIES = 1000


def components(docs: DataFrame, config: JaccardConfig = JaccardConfig(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id of every row."""
    profile = saved(profiles(docs, config, key, text), "profiles")
    rows = profile.where("doc_id is not null and n > 0")
    total = rows.agg(F.count("*").alias("docs"), F.sum(F.expr(f"greatest(n - (({config.percent} * n + 99) div 100) + 1, ({config.lead} * n + 99) div 100)")).alias("lead")).first()
    hot, hot_n = hot_tokens(profile, config)
    bits = max(0, int(total["lead"] or 0) // config.bucket).bit_length()
    classes = rows.groupBy("n", "h1", "h2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
    # an id with several texts ties their classes together
    with_more = rows.groupBy(F.col("doc_id").alias("_id")).agg(F.min("h1").alias("_lo"), F.max("h1").alias("_hi")).where("_lo <> _hi").select("_id")
    tied = saved(rows.join(with_more, F.col("doc_id") == F.col("_id"), "left_semi").select("doc_id", "n", "h1", "h2").join(classes, ["n", "h1", "h2"]).select(F.col("doc_id").alias("src"), F.col("rep").alias("dst")), "tied")

    least = F.expr(f"(({config.percent} * n + 99) div 100)")
    far_least = F.floor((config.percent * least + 99) / 100)
    fewest = F.greatest(F.lit(1), F.greatest(least - far_least + 1, F.floor((config.lead * least + 99) / 100)) - (least - far_least) - 1)
    pieces = (int(total["docs"]) // 50_000).bit_length()
    counts = leading_blocks(docs, hot, bits, pieces, config, key, text).groupBy("bucket").applyInArrow(_shared(pieces), _COUNTS_DDL)
    counts = counts.groupBy("piece").applyInArrow(_summed, "h1 long, _s long")
    able = saved(counts.join(classes, "h1").where(F.col("_s") >= fewest).select(F.col("rep").alias("key")).distinct(), "able")
    texts = docs.select(F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{text}`").cast("string").alias("text"))
    sets = saved(_full_sets(texts.join(able, "key", "left_semi"), hot, config), "sets")
    found = sets.where("n > 0")
    dropped(able)

    # groups
    led = int(found.agg(F.sum(F.expr(f"({config.lead} * n + 99) div 100")).alias("led")).first()["led"] or 0)
    bits = max(0, 2 * led // config.bucket).bit_length()
    voted = _home_blocks(found, bits).groupBy("bucket").applyInArrow(_votes(pieces, config.cell), _COUNTS_DDL).groupBy("piece").applyInArrow(_elected, "sid long, voted long")
    band = F.floor(F.log("n") / F.log(F.lit(100 / config.percent))).cast("long")  # of linked sets no two are further apart than one
    placed = found.select("sid", "doc_id", "n", "home", "central").distinct().join(voted, "sid", "left")
    placed = saved(placed.select("sid", "doc_id", "n", band.alias("band"), "central", F.coalesce("home", "voted", "sid").alias("home")), "homes")
    large = placed.groupBy("home", "band").agg(F.ceil(F.greatest(F.count("*") / config.cell, F.sum("n") / config.cell_tokens)).cast("int").alias("parts")).where("parts > 1")
    large = saved(large, "large-groups")
    part = placed.join(F.broadcast(large) if large.count() <= BROADCAST_GROUPS else large, ["home", "band"], "left").withColumn("part", F.pmod(F.xxhash64("sid", F.lit(1)), F.coalesce("parts", F.lit(1))).cast("int"))
    cells = saved(part.select("sid", "doc_id", "n", "band", "home", F.xxhash64("home", "band", "part").alias("gid")), "cells")
    dropped(large)
    able_guests = found.where("home is not null").select(F.explode("heads").alias("home"), band.alias("band"), F.pmod("sid", F.lit(GUESTS)).alias("slot"), "central", "sid", "doc_id")
    able_guests = able_guests.unionByName(placed.select("home", "band", F.lit(0).cast("long").alias("slot"), "central", "sid", "doc_id"))
    guests = able_guests.groupBy("home", "band", "slot").agg(F.max(F.struct("central", "sid", "doc_id")).alias("g"))
    several = cells.groupBy("home").agg(F.min("gid").alias("lo"), F.max("gid").alias("hi")).where("lo <> hi").select("home")
    guests = guests.join(several, "home").select("home", F.col("g.sid").alias("sid"), F.col("g.doc_id").alias("doc_id"), F.explode(F.sequence(F.col("band") - 1, F.col("band") + 1)).alias("band")).distinct()
    guests = cells.select("home", "band", "gid").distinct().join(guests, ["home", "band"]).select("sid", "doc_id", "gid", F.lit(True).alias("guest"))
    seats = cells.select("sid", "doc_id", "gid", F.lit(False).alias("guest")).unionByName(guests).groupBy("sid", "doc_id", "gid").agg(F.min("guest").alias("guest"))
    unique = found.select("sid", "doc_id", "n", "tokens").dropDuplicates(["sid", "doc_id"])
    near = saved(seats.join(unique, ["sid", "doc_id"]).select("gid", "guest", "doc_id", "n", "tokens").groupBy("gid").applyInArrow(_grouped(config), _LINK_DDL), "groups")
    near_links, unions = near.where("union is null").select("src", "dst"), near.where("union is not null").select(F.col("src").alias("gid"), F.col("union").alias("tokens"))
    first = connected(near_links.unionByName(tied))

    # the matrix: which groups hold enough of a query's leading tokens
    weight = first.groupBy("component").agg(F.count("*").alias("weight"))
    ranked = first.join(weight, "component").select(F.col("node").alias("doc_id"), "component", F.floor(F.log2("weight")).cast("long").alias("power"))
    # the power of a component's size, a hash of it (which tells components of like size apart), and the band
    rank = F.shiftleft(F.coalesce("power", F.lit(0).cast("long")), 57).bitwiseOR(F.shiftleft(F.shiftrightunsigned(F.xxhash64("component"), 7 + BAND_BITS), BAND_BITS)).bitwiseOR(F.least("band", F.lit((1 << BAND_BITS) - 1)))
    members = cells.join(ranked, "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    members = saved(members.select("sid", "doc_id", "n", "gid", "component", rank.alias("rank")), "members")
    dropped(cells)
    dropped(placed)
    tops = members.groupBy("gid").agg(F.max("rank").alias("rank"))
    held = unions.join(tops, "gid").select("gid", "tokens", "rank", (F.octet_length("tokens") / 8).cast("long").alias("lead"))
    asking = members.groupBy("sid").agg(F.min("rank").alias("rank")).join(found.select("sid", "n", "tokens").dropDuplicates(["sid"]), "sid")
    lead = F.expr(f"greatest(n - (({config.percent} * n + 99) div 100) + 1, ({config.lead} * n + 99) div 100)")
    blocks = _matrix_blocks(asking.select("sid", "tokens", "rank", lead.cast("long").alias("lead")), 0, hot, hot_n, bits, config).unionByName(_matrix_blocks(held, 1, hot, hot_n, bits, config))
    met = blocks.groupBy("bucket").applyInArrow(_met(pieces), "piece long, pairs binary, counts binary").groupBy("piece").applyInArrow(_total, "sid long, gid long, _s long")
    asked = met.join(members.withColumnRenamed("gid", "own"), "sid").where((F.col("_s") >= fewest) & (F.col("gid") != F.col("own")))
    asked = saved(asked.select("sid", "doc_id", "n", "component", "gid"), "asked")

    # groups that are asked are opened
    salts = asked.groupBy("gid").agg(F.ceil(F.greatest(F.count("*") / config.cell, F.sum("n") / config.cell_tokens)).cast("int").alias("salts"))
    queries = asked.join(salts, "gid").select("sid", "doc_id", "component", "gid", F.pmod(F.xxhash64("sid"), F.col("salts")).cast("int").alias("salt"), F.lit(True).alias("ask"))
    inside = members.join(salts, "gid").select("sid", "doc_id", "component", "gid", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(False).alias("ask"))
    both = queries.unionByName(inside).join(unique, ["sid", "doc_id"]).select("gid", "salt", "ask", "component", "doc_id", "n", "tokens")
    far = saved(both.groupBy("gid", "salt").applyInArrow(_opened(config.percent), _LINK_DDL).select("src", "dst"), "opened-links")
    final = connected(near_links.unionByName(far).unionByName(tied))
    for old in (sets, near, members, asked, far, tied, first):
        dropped(old)

    mapped = classes.join(final, F.col("rep") == F.col("node"), "left").select(F.col("n").alias("_n"), F.col("h1").alias("_h1"), F.col("h2").alias("_h2"), F.coalesce("component", "rep").alias("_component"), "copies")
    # classes of very many copies are few (100,000 at most), so they are broadcast and their rows are not dealt by class
    many = max(COPIES, total["docs"] // 100_000)
    same = (F.col("n") == F.col("_n")) & (F.col("h1") == F.col("_h1")) & (F.col("h2") == F.col("_h2"))
    ids = profile.select("doc_id", "n", "h1", "h2")
    large = F.broadcast(saved(mapped.where(F.col("copies") >= many), "large-classes"))
    component = F.when(F.col("doc_id").isNotNull(), F.when(F.col("n") > 0, F.least("_component", "doc_id")).otherwise(F.col("doc_id")))
    parts = [ids.join(large, same), ids.join(large, same, "left_anti").join(mapped.where(F.col("copies") < many), same, "left")]
    return parts[0].select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id")).unionByName(parts[1].select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id")))


SQL = """
with recursive docs as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as w from documents),
sh as (select doc_id, unnest(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
         else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) end) as s from docs),
ds as (select distinct doc_id, s from sh),
n as (select doc_id, count(*) as n from ds group by 1),
links as (select a.doc_id as x, b.doc_id as y from ds a join ds b on a.s = b.s and a.doc_id < b.doc_id join n p on p.doc_id = a.doc_id join n q on q.doc_id = b.doc_id
          group by 1, 2, p.n, q.n having 100 * count(*) >= 75 * (p.n + q.n - count(*))),
sym as (select x, y from links union all select y, x from links),
reach(x, y) as (select doc_id, doc_id from docs union select r.x, b.y from reach r join sym b on r.y = b.x)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, min(r.y)::bigint as component_id from docs d left join n using (doc_id) join reach r on r.x = d.doc_id group by 1, 2
"""
