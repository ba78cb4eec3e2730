"""Communities: pruning, modularity optimisation, components, representatives, reports, global search."""

from __future__ import annotations

import tempfile
from array import array
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from folio.lineage import saved
from folio.operators.graph import both_ways
from folio.operators.ranking import top_k


def prune(nodes: DataFrame, edges: DataFrame, min_mentions: int = 2) -> tuple[DataFrame, DataFrame]:
    """Without rare entities and those that then have no edge."""
    often = nodes.where(F.col("n_mentions") >= min_mentions)
    kept = edges
    for end in ("src", "dst"):
        kept = kept.join(often.select(F.col("entity_id").alias(end)), end, "left_semi")
    ends = kept.select(F.col("src").alias("entity_id")).unionByName(kept.select(F.col("dst").alias("entity_id"))).distinct()
    return often.join(ends, "entity_id", "left_semi"), kept


def weighted_degree(edges: DataFrame) -> DataFrame:
    return both_ways(edges).groupBy(F.col("src").alias("entity_id")).agg(F.sum("weight").alias("degree"))


def modularity_terms(edges: DataFrame, members: DataFrame) -> DataFrame:
    """Per community: internal weight, total degree, and its share of the modularity at resolution 1."""
    total = edges.agg(F.sum("weight").cast("double").alias("m"))
    inside = edges.join(members.select(F.col("entity_id").alias("src"), F.col("community").alias("c1")), "src").join(members.select(F.col("entity_id").alias("dst"), F.col("community").alias("c2")), "dst")
    inner = inside.where("c1 = c2").groupBy(F.col("c1").alias("community")).agg(F.sum("weight").alias("internal"), F.count("*").alias("internal_edges"))
    degree = members.join(weighted_degree(edges), "entity_id").groupBy("community").agg(F.sum("degree").alias("degree"), F.count("*").alias("size"))
    out = degree.join(inner, "community", "left").crossJoin(F.broadcast(total))
    internal = F.coalesce("internal", F.lit(0))
    share = internal / F.col("m") - F.pow(F.col("degree") / (2 * F.col("m")), 2)
    return out.select("community", "size", internal.cast("long").alias("internal"), F.coalesce("internal_edges", F.lit(0)).cast("long").alias("internal_edges"), F.col("degree").cast("long").alias("degree"), F.round(share, 6).alias("modularity"))


def local_moves(edges: list[tuple[str, str, float]], resolution: float = 1.0, total: float | None = None) -> dict[str, str]:
    """Modularity optimisation by local moves and contraction, in sorted order, without randomness. `total`: the weight of a graph of which these edges are a part."""
    graph: dict[str, dict[str, float]] = defaultdict(dict)
    for u, v, w in edges:
        graph[u][v] = graph[u].get(v, 0.0) + w
        if u != v:
            graph[v][u] = graph[v].get(u, 0.0) + w
    total = total or sum(w for u, line in graph.items() for v, w in line.items() if u <= v)
    home = {n: n for n in graph}
    while total:
        degree = {n: sum(line.values()) + line.get(n, 0.0) for n, line in graph.items()}
        where, mass, moved, ever = {n: n for n in graph}, dict(degree), True, False
        while moved:
            moved = False
            for n in sorted(graph):
                to: dict[str, float] = defaultdict(float)
                for v, w in graph[n].items():
                    if v != n:
                        to[where[v]] += w
                mass[where[n]] -= degree[n]
                gain = lambda c, n=n, to=to: to.get(c, 0.0) - resolution * degree[n] * mass[c] / (2 * total)
                best, value = where[n], gain(where[n])
                for c in sorted(to):
                    if gain(c) > value + 1e-12:
                        best, value = c, gain(c)
                if best != where[n]:
                    where[n], moved, ever = best, True, True
                mass[best] += degree[n]
        if not ever:
            break
        home = {n: where[c] for n, c in home.items()}
        merged: dict[str, dict[str, float]] = defaultdict(dict)
        for u, line in graph.items():
            for v, w in line.items():
                if u <= v:
                    a, b = where[u], where[v]
                    merged[a][b] = merged[a].get(b, 0.0) + w
                    if a != b:
                        merged[b][a] = merged[b].get(a, 0.0) + w
        graph = merged
    return home


#: Entries of adjacency lists that are read at once, that are merged at once, and bytes of them that are kept in memory before they go to a temporary file.
BLOCK, MERGED, HELD = 1 << 19, 1 << 21, 32 << 20
#: Lists from this length on are summed by arrays.
LONG = 128
ENTRY = np.dtype([("u", np.int32), ("v", np.int32), ("w", np.float64)])
SUM = np.dtype([("key", np.int64), ("w", np.float64)])


class Lines:
    """Adjacency lists (both directions, loops once) of nodes 0..n-1 in order, appended once and then read in blocks. In memory are sizes alone, one number a node."""

    def __init__(self, block: int, held: int) -> None:
        self.block, self.file, self.runs = block, tempfile.SpooledTemporaryFile(held), []

    def append(self, u: np.ndarray, v: np.ndarray, w: np.ndarray) -> None:
        for at in range(0, len(u), self.block):
            rows = np.empty(len(u[at : at + self.block]), ENTRY)
            rows["u"], rows["v"], rows["w"] = u[at : at + self.block], v[at : at + self.block], w[at : at + self.block]
            self.file.write(rows.tobytes())
            self.runs.append(np.unique(rows["u"], return_counts=True))

    def close(self) -> Lines:
        nodes, counts = (np.concatenate(x) for x in zip(*self.runs, strict=True))
        self.sizes, self.runs = np.bincount(nodes, counts).astype(np.int64), []
        self.ends = np.concatenate([[0], np.cumsum(self.sizes)])
        return self

    def blocks(self) -> Iterator[tuple[int, int, np.ndarray]]:
        """(a, b, entries of nodes a..b-1)"""
        self.file.seek(0)
        a, n = 0, len(self.sizes)
        while a < n:
            b = max(a + 1, int(np.searchsorted(self.ends, self.ends[a] + self.block, side="right")) - 1)
            yield a, b, np.frombuffer(self.file.read(int(self.ends[b] - self.ends[a]) * ENTRY.itemsize), ENTRY)
            a = b


def _summed(key: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return key[first], np.add.reduceat(w[order], first)


def _contracted(lines: Lines, code: np.ndarray, n: int, merged: int, held: int) -> Lines:
    """The lists between communities: sums of each block go to files by ranges of communities, each file is then summed."""
    shelf = np.cumsum(np.bincount(code, lines.sizes, n)).astype(np.int64) // merged
    files = {}
    for _, _, e in lines.blocks():
        x, y = code[e["u"]], code[e["v"]]
        once = (x != y) | (e["u"] <= e["v"])
        if not once.any():
            continue
        key, w = _summed(x[once] * n + y[once], e["w"][once])
        at = shelf[key // n]
        for f in np.unique(at):
            rows = np.empty(int((at == f).sum()), SUM)
            rows["key"], rows["w"] = key[at == f], w[at == f]
            files.setdefault(int(f), tempfile.SpooledTemporaryFile(held // 8)).write(rows.tobytes())
    out = Lines(lines.block, held)
    lines.file.close()
    for _, file in sorted(files.items()):
        file.seek(0)
        key, w = np.empty(0, np.int64), np.empty(0)
        while part := file.read(lines.block * SUM.itemsize):
            rows = np.frombuffer(part, SUM)
            key, w = _summed(np.concatenate([key, rows["key"]]), np.concatenate([w, rows["w"]]))
        file.close()
        out.append(key // n, key % n, w)
    return out.close()


def stored_moves(lines: Lines, resolution: float = 1.0, total: float | None = None, merged: int = MERGED, held: int = HELD) -> np.ndarray:
    """local_moves over lists in a file: the home of each node. Nodes are numbered in the order of their names, so that moves and ties are the same; memory is by nodes and blocks, not by edges."""
    names = home = np.arange(len(lines.sizes))
    total = total or float(sum(e["w"][e["u"] <= e["v"]].sum() for _, _, e in lines.blocks()))
    while total:
        n, twice = len(lines.sizes), 2 * total
        degree = np.zeros(n)
        for a, b, e in lines.blocks():
            degree[a:b] = np.bincount(e["u"] - a, np.where(e["u"] == e["v"], 2 * e["w"], e["w"]), b - a)
        where, mass, degrees = array("q", range(n)), array("d", degree.tobytes()), degree.tolist()
        homes, masses = np.frombuffer(where, np.int64), np.frombuffer(mass, np.float64)
        moved, ever = True, False
        while moved:
            moved = False
            for a, b, e in lines.blocks():
                ends, vs, ws = (lines.ends[a : b + 1] - lines.ends[a]).tolist(), e["v"], e["w"]
                v, w = vs.tolist(), ws.tolist()
                for node, i, j in zip(range(a, b), ends, ends[1:], strict=False):
                    own, pull = where[node], resolution * degrees[node]
                    mass[own] -= degrees[node]
                    if j - i < LONG:
                        to = {}
                        for x, y in zip(v[i:j], w[i:j], strict=True):
                            if x != node:
                                c = where[x]
                                to[c] = to.get(c, 0.0) + y
                        best, value = own, to.get(own, 0.0) - pull * mass[own] / twice
                        better = sorted((c, g) for c, y in to.items() if (g := y - pull * mass[c] / twice) > value + 1e-12)
                    else:
                        other = vs[i:j] != node
                        c, at = np.unique(homes[vs[i:j][other]], return_inverse=True)
                        y = np.bincount(at, ws[i:j][other], len(c))
                        best, value = own, float(y[c == own].sum()) - pull * mass[own] / twice
                        gains = y - pull * masses[c] / twice
                        some = gains > value + 1e-12
                        better = list(zip(c[some].tolist(), gains[some].tolist(), strict=True))
                    for c, g in better:
                        if g > value + 1e-12:
                            best, value = c, g
                    if best != own:
                        where[node], moved, ever = best, True, True
                    mass[best] += degrees[node]
        if not ever:
            break
        left, code = np.unique(homes, return_inverse=True)
        names, home = names[left], code[home]
        lines = _contracted(lines, code, len(left), merged, held)
    lines.file.close()
    return names[home]


def _moves_of_parts(resolution: float, total: float | None, block: int, merged: int, held: int, schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (part, u, v, w) sorted by part and u; each part goes to a file as it comes and is moved when the next begins."""

    def finished(part: object, lines: Lines) -> Iterator[pa.RecordBatch]:
        home = stored_moves(lines.close(), resolution, total, merged, held)
        for at in range(0, len(home), 1 << 16):
            some = home[at : at + (1 << 16)].astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array([part] * len(some), schema.field(0).type), pa.array(np.arange(at, at + len(some), dtype=np.int32)), pa.array(some)], schema=schema)

    def moves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, lines = None, None
        for b in batches:
            runs = pc.run_end_encode(b.column(0))
            u, v, w = (b.column(k).to_numpy(zero_copy_only=False) for k in (1, 2, 3))
            begin = 0
            for end, p in zip(runs.run_ends.to_pylist(), runs.values.to_pylist(), strict=True):
                if lines is None or p != part:
                    if lines is not None:
                        yield from finished(part, lines)
                    part, lines = p, Lines(block, held)
                lines.append(u[begin:end], v[begin:end], w[begin:end])
                begin = end
        if lines is not None:
            yield from finished(part, lines)

    return moves


def louvain(edges: DataFrame, group: str | None = None, resolution: float = 1.0) -> DataFrame:
    """(group, entity_id, label). One task per group, or per connected part where there are no groups: no community reaches over parts,
    and moves within a part depend on the others by the total weight alone, which is sent along. A task gets numbers for names and keeps edges in a file."""
    total, named = None, edges.select((F.col(group) if group else F.lit("")).cast("string").alias("_g"), "src", "dst", F.col("weight").cast("double").alias("w"))
    ends = named.select("_g", F.col("src").alias("entity_id")).unionByName(named.select("_g", F.col("dst").alias("entity_id"))).distinct().withColumn("_part", F.col("_g"))
    if group is None:
        ends = components(edges, ends.select("entity_id", F.lit("").alias("label"))).select(F.lit("").alias("_g"), "entity_id", F.col("component").cast("string").alias("_part"))
        total = float(named.agg(F.sum("w").alias("w")).first()["w"] or 0.0)
    number = F.row_number().over(Window.partitionBy("_part").orderBy("entity_id")) - 1
    nodes = saved(ends.select("_g", "_part", "entity_id", number.cast("int").alias("_n")), "numbers")
    for end, at in (("src", "u"), ("dst", "v")):
        side = nodes.select(F.col("_g").alias("_side"), F.col("entity_id").alias(end), F.col("_n").alias(at), *["_part"] * (at == "u"))
        named = named.join(side, (named[end] == side[end]) & named["_g"].eqNullSafe(side["_side"])).drop(side[end], side["_side"])
    lines = named.select("_part", "u", "v", "w").unionByName(named.where("u <> v").select("_part", F.col("v").alias("u"), F.col("u").alias("v"), "w"))
    shape = StructType([StructField("_in", StringType()), StructField("_u", IntegerType()), StructField("_c", IntegerType())])
    found = lines.repartition("_part").sortWithinPartitions("_part", "u", "v").mapInArrow(_moves_of_parts(resolution, total, BLOCK, MERGED, HELD, to_arrow_schema(shape)), shape)
    for at, into in (("_u", "entity_id"), ("_c", "label")):
        side = nodes.select(F.col("_part"), "_n", F.col("entity_id").alias(into))
        found = found.join(side, found["_in"].eqNullSafe(side["_part"]) & (found[at] == side["_n"])).drop("_part", "_n")
    return found.select(*[F.col("_in").alias(group)] if group else [], "entity_id", "label")


def components(edges: DataFrame, members: DataFrame) -> DataFrame:
    """(entity_id, component): the smallest id reachable inside one label; min-label propagation with pointer jumping until nothing changes."""
    inside = edges.join(members.select(F.col("entity_id").alias("src"), F.col("label").alias("l1")), "src").join(members.select(F.col("entity_id").alias("dst"), F.col("label").alias("l2")), "dst").where("l1 = l2")
    near = saved(both_ways(inside.withColumn("weight", F.lit(1))).select("src", "dst").distinct(), "edges")
    labels = members.select("entity_id", F.col("entity_id").alias("component"))
    while True:
        heard = near.join(labels.withColumnRenamed("entity_id", "dst"), "dst").groupBy(F.col("src").alias("entity_id")).agg(F.min("component").alias("_heard"))
        fresh = labels.join(heard, "entity_id", "left").select("entity_id", F.least("component", F.coalesce("_heard", "component")).alias("component"))
        jump = fresh.select(F.col("entity_id").alias("component"), F.col("component").alias("_up"))
        fresh = saved(fresh.join(jump, "component", "left").select("entity_id", F.coalesce("_up", "component").alias("component")), "labels")
        changed = fresh.join(labels.withColumnRenamed("component", "_was"), "entity_id").where("component <> _was").limit(1).count()
        labels = fresh
        if not changed:
            return labels


def communities(nodes: DataFrame, edges: DataFrame, min_size: int = 3, min_mentions: int = 2, resolution: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """(entity_id, community, size) of communities of `min_size` or more, c000 being the largest; and the entities of the rest."""
    kept = saved(prune(nodes, edges, min_mentions)[1], "kept-edges")  # read by each of the following steps
    label = saved(louvain(kept, resolution=resolution), "labels")
    parts = components(kept, label)
    size = parts.groupBy("component").agg(F.count("*").alias("size"))
    large = size.where(F.col("size") >= min_size)
    order = Window.orderBy(F.desc("size"), "component")  # communities, not entities: few
    named = large.withColumn("community", F.format_string("c%03d", F.row_number().over(order) - 1))
    return parts.join(named, "component").select("entity_id", "community", "size"), parts.join(large, "component", "left_anti").select("entity_id")


def representatives(members: DataFrame, mentions: DataFrame, edges: DataFrame, n: int = 3) -> DataFrame:
    """Per community the chunks whose entities have the largest total degree; equal ones by key."""
    score = members.join(mentions, "entity_id").join(weighted_degree(edges), "entity_id", "left").groupBy("community", "chunk_key").agg(F.sum(F.coalesce("degree", F.lit(0))).alias("score"))
    return top_k(score, n, "community", F.desc("score"), F.col("chunk_key"))


def select_reports(scores: DataFrame, m: int = 6, query: str = "query_id") -> DataFrame:
    """The m most similar reports of each question, no threshold."""
    return top_k(scores, m, query, F.desc("score"), F.col("community"))


def map_scores(points: Column, similarity: Column) -> Column:
    """The best point's score; without points the similarity in percent."""
    return F.coalesce(F.array_max(F.transform(points, lambda p: p["score"])), F.bround(100 * similarity).cast("int"))


def global_points(selected: DataFrame, reports: DataFrame, chunks: DataFrame, per_community: int = 2, least: int | None = None, query: str = "query_id") -> DataFrame:
    """Report A, its passages, report B and so on; a passage stays with the first community that has it.

    selected: (query, community, score, rank); with `least` only scores (0..100) from there, best first.
    reports: (community, text, chunk_keys); chunks: (chunk_key, text).
    """
    if least is not None:
        selected = selected.where(F.col("score") >= least)
        selected = selected.withColumn("rank", F.row_number().over(Window.partitionBy(query).orderBy(F.desc("score"), "rank")))
    head = selected.join(reports, "community")
    own = head.select(query, "rank", "community", F.lit(0).alias("part"), F.lit("community").alias("kind"), F.lit(None).cast("string").alias("chunk_key"), "text", "score")
    wanted = head.select(query, "rank", "community", "score", F.posexplode(F.slice("chunk_keys", 1, per_community)).alias("k", "chunk_key"))
    first = top_k(wanted, 1, [query, "chunk_key"], F.col("rank"), F.col("k"), rank="_one")
    passages = first.join(chunks.select("chunk_key", "text"), "chunk_key").select(query, "rank", "community", (F.col("k") + 1).alias("part"), F.lit("chunk").alias("kind"), "chunk_key", "text", "score")
    every = own.unionByName(passages)
    return every.withColumn("marker", F.row_number().over(Window.partitionBy(query).orderBy("rank", "part"))).drop("rank", "part")


def ordered_entities(members: DataFrame, edges: DataFrame) -> DataFrame:
    """(community, entities): each community's entities by weighted degree, equal ones by id."""
    ranked = members.join(weighted_degree(edges), "entity_id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    lists = ranked.groupBy("community").agg(F.array_sort(F.collect_list(F.struct((-F.col("degree")).alias("d"), "entity_id"))).alias("l"))
    return lists.select("community", F.transform("l", lambda x: x["entity_id"]).alias("entities"))


def report_edges(members: DataFrame, edges: DataFrame, most: int = 60) -> DataFrame:
    """(community, rank, src, dst, weight): the heaviest edges inside each community, equal ones by their ends."""
    one, two = (members.select(F.col("entity_id").alias(end), F.col("community").alias(f"_{end}")) for end in ("src", "dst"))
    inside = edges.join(one, "src").join(two, "dst").where(F.col("_src") == F.col("_dst")).withColumnRenamed("_src", "community").drop("_dst")
    return top_k(inside, most, "community", F.desc("weight"), F.col("src"), F.col("dst")).select("community", "rank", "src", "dst", "weight")


def union_indexes(indexes: dict[str, DataFrame]) -> DataFrame:
    """Several groups' community reports as one table, ids and entities told apart by their group."""
    every = None
    for group, t in sorted(indexes.items()):
        named = t.withColumn("community", F.concat(F.lit(f"{group}/"), F.col("community")))
        if "entities" in named.columns:
            named = named.withColumn("_group", F.lit(f"{group}/")).withColumn("entities", F.transform("entities", lambda e: F.concat(F.col("_group"), e))).drop("_group")
        every = named if every is None else every.unionByName(named, allowMissingColumns=True)
    return every
