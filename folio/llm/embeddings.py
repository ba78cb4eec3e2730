"""Embedding near-duplicates: PCA-ordered tiled comparison with suffix-norm bounds.

Vectors that are equal within a label are one class. Principal axes of all classes (sums over the whole table) give an
orthonormal basis in which the first coordinates hold most of the variance. Classes are dealt to tiles of bounded size by label and
first coordinate; tiles further apart on it than any linked pair can be are not compared. Within a pair of tiles products are summed over
leading dimensions first; a pair is given up as soon as that sum plus the product of what is left of both norms cannot reach
the threshold. Pairs that remain are decided by the cosine of the original vectors in double precision.

Per class only sums of links and spanning links leave a tile pair, never all pairs. A tile holds up to `tile_bytes` of vectors and is compared
block by block, so that what is shuffled (each tile once for each tile it is compared with) falls with the tile's size: by vectors of a label over
vectors of a tile. As every link of a vector is counted, the work within a label stays quadratic where the bounds do not stop it.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components, and rows with a null label or null
id, link with nothing (n_links 0, component_id their own id); vectors of different lengths do not link; equal vectors of one label link
with each other; rows that share an id count as several vectors of one component; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.components import Forest, connected
from folio.llm.scratch import saved


@dataclass(frozen=True)
class EmbeddingConfig:
    """`tile_bytes`: vectors of a tile, in double precision; `block`: rows of it that are compared at once; `step`: dimensions between two bounds."""

    threshold: float = 0.93
    tile_bytes: int = 4 << 20
    block: int = 768
    step: int = 16


def _doubles(batch: pa.RecordBatch, name: str) -> list[np.ndarray]:
    column = batch.column(batch.schema.get_field_index(name))
    flat, at = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    return [flat[a:b] for a, b in zip(at, at[1:], strict=False)]


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per vector length and task: the sum of outer products of its unit vectors."""
    total: dict[int, np.ndarray] = {}
    for b in batches:
        vectors = _doubles(b, "v")
        for d in {len(v) for v in vectors}:
            m = np.stack([v for v in vectors if len(v) == d])
            m = m / np.linalg.norm(m, axis=1, keepdims=True)
            total[d] = total.get(d, 0) + m.T @ m
    if total:
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([t.ravel().tolist() for t in total.values()], pa.list_(pa.float64()))], names=["dim", "m"])


def principal_axes(classes: DataFrame) -> dict[int, np.ndarray]:
    """For each vector length an orthonormal basis, axes of largest moment first."""
    sums = classes.select("v").mapInArrow(_moments, "dim int, m array<double>").select("dim", F.posexplode("m").alias("k", "x")).groupBy("dim", "k").agg(F.sum("x").alias("x"))
    found: dict[int, np.ndarray] = {}
    lines = sums.groupBy("dim", (F.col("k") / F.col("dim")).cast("int").alias("line")).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "x"))), lambda c: c["x"]).alias("x"))
    for r in lines.collect():  # as many rows of as many numbers as a vector has components, whatever the number of vectors
        found.setdefault(r["dim"], np.zeros((r["dim"], r["dim"])))[r["line"]] = r["x"]
    return {d: np.linalg.eigh(m)[1][:, ::-1].copy() for d, m in found.items()}


def _usable(column: F.Column) -> F.Column:
    finite = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(column.isNotNull() & (F.size(column) > 0) & finite & F.exists(column, lambda x: x != 0), F.lit(False))


_TILE = pa.schema([("label", pa.string()), ("dim", pa.int32()), ("cell", pa.int32()), ("sub", pa.int32()), ("reps", pa.binary()), ("sizes", pa.binary()), ("v", pa.binary())])


def _packed(group: pa.Table) -> pa.Table:
    g = group.combine_chunks()
    flat = g.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    head = [pa.array([g.column(n)[0].as_py()], _TILE.field(n).type) for n in ("label", "dim", "cell", "sub")]
    raw = [pa.array([np.ascontiguousarray(x).tobytes()], pa.binary()) for x in (g.column("rep").to_numpy(), g.column("size").to_numpy(), flat.astype(np.float64))]
    return pa.table([*head, *raw], schema=_TILE)


def linked_pairs(a: np.ndarray, b: np.ndarray, axes: np.ndarray, threshold: float, step: int, block: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i, j) with cosine(a[i], b[j]) >= threshold, by blocks of rows; of a tile with itself only pairs with i < j."""
    for p in range(0, len(a), block):
        for q in range(p if a is b else 0, len(b), block):
            i, j = _linked(a[p : p + block], b[q : q + block], axes, threshold, step)
            if a is b and p == q:
                i, j = i[i < j], j[i < j]
            yield i + p, j + q


def _linked(a: np.ndarray, b: np.ndarray, axes: np.ndarray, threshold: float, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (i, j) with cosine(a[i], b[j]) >= threshold."""
    na, nb = np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1)
    x, y = (a / na[:, None]) @ axes, (b / nb[:, None]) @ axes
    low, dims = threshold - 1e-9, a.shape[1]
    rest = lambda m: np.sqrt(np.cumsum((m * m)[:, ::-1], axis=1)[:, ::-1])
    rx, ry = (np.hstack([rest(m), np.zeros((len(m), 1))]) for m in (x, y))
    at = min(step, dims)
    total = x[:, :at] @ y[:, :at].T
    i, j = np.nonzero(total + rx[:, at][:, None] * ry[:, at][None, :] >= low)
    total = total[i, j]
    while at < dims and len(i):
        to = min(at + step, dims)
        if 4 * len(i) > len(a) * len(b):  # most pairs are alive: whole products are cheaper
            total = total + (x[:, at:to] @ y[:, at:to].T)[i, j]
        else:
            total = total + np.einsum("ij,ij->i", x[i, at:to], y[j, at:to])
        alive = total + rx[i, to] * ry[j, to] >= low
        i, j, total, at = i[alive], j[alive], total[alive], to
    if len(i):
        good = np.concatenate([np.einsum("ij,ij->i", a[p], b[q]) / (na[p] * nb[q]) >= threshold for p, q in zip(np.array_split(i, 1 + len(i) // 65536), np.array_split(j, 1 + len(j) // 65536), strict=True)])
        i, j = i[good], j[good]
    return i, j


_OUT = pa.schema([("edge", pa.bool_()), ("a", pa.int64()), ("b", pa.int64())])


def _compare(axes: dict[int, np.ndarray], config: EmbeddingConfig):
    def run(group: pa.Table) -> pa.Table:
        rows = sorted(group.to_pylist(), key=lambda r: r["side"])
        dim = rows[0]["dim"]
        sides = [(np.frombuffer(r["reps"], np.int64), np.frombuffer(r["sizes"], np.int64), np.frombuffer(r["v"], np.float64).reshape(-1, dim)) for r in rows]
        (ra, sa, va), (rb, sb, vb) = sides[0], sides[-1]
        f, edges, la, lb = Forest(), [], np.zeros(len(ra)), np.zeros(len(rb))
        for i, j in linked_pairs(va, vb, axes[dim], config.threshold, config.step, config.block):
            edges += [(p, q) for p, q in zip(ra[i].tolist(), rb[j].tolist(), strict=True) if f.join(p, q)]
            la += np.bincount(i, weights=sb[j], minlength=len(ra))
            lb += np.bincount(j, weights=sa[i], minlength=len(rb))
        ids, n = np.concatenate([ra, rb]), np.concatenate([la, lb]).astype(np.int64)
        ids, n = ids[n > 0], n[n > 0]
        return pa.table({"edge": pa.array([False] * len(ids) + [True] * len(edges)), "a": pa.array([*ids.tolist(), *(e[0] for e in edges)], pa.int64()), "b": pa.array([*n.tolist(), *(e[1] for e in edges)], pa.int64())}, schema=_OUT)

    return run


def links(vectors: DataFrame, config: EmbeddingConfig = EmbeddingConfig(), key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """vec_id, n_links, component_id and kept of every row."""
    rows = vectors.select(F.col(f"`{key}`").cast("long").alias("vec_id"), F.col(f"`{vector}`").cast("array<double>").alias("v"), F.col(f"`{label}`").cast("string").alias("label"))
    rows = rows.withColumn("k1", F.xxhash64("label", "v")).withColumn("k2", F.xxhash64("v", F.lit(7), "label"))
    rows = rows.withColumn("usable", _usable(F.col("v")) & F.col("label").isNotNull() & F.col("vec_id").isNotNull())
    grouped = rows.where("usable").groupBy("label", F.size("v").alias("dim"), "k1", "k2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("size"), F.first("v").alias("v"))
    classes = saved(grouped, "vector-classes")
    axes = principal_axes(classes)

    radius = math.sqrt(max(0.0, 2 - 2 * config.threshold)) + 1e-9
    first = {d: (b[:, 0] / radius).tolist() for d, b in axes.items()}
    place = F.lit(None).cast("double")
    for d, axis in first.items():
        dot = F.aggregate(F.zip_with("v", F.array(*map(F.lit, axis)), lambda p, q: p * q), F.lit(0.0), lambda s, p: s + p)
        norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, p: s + p * p))
        place = F.when(F.col("dim") == d, dot / norm).otherwise(place)
    spread = classes.select("label", "dim", "rep", "size", "v", F.floor(place).cast("int").alias("cell"))
    counts = spread.groupBy("label", "dim", "cell").agg(F.ceil(F.sum(8.0 * F.col("dim")) / config.tile_bytes).cast("int").alias("subs"))
    spread = spread.join(counts, ["label", "dim", "cell"]).withColumn("sub", F.pmod(F.xxhash64("rep"), F.col("subs")).cast("int"))
    tiles = saved(spread.select("label", "dim", "cell", "sub", "rep", "size", "v").groupBy("label", "dim", "cell", "sub").applyInArrow(_packed, "label string, dim int, cell int, sub int, reps binary, sizes binary, v binary"), "tiles")

    # pairs of tiles with equal labels whose cells touch, each pair once
    names = tiles.select("label", "dim", "cell", "sub")
    other = names.select(F.col("label").alias("l2"), F.col("dim").alias("d2"), F.col("cell").alias("c2"), F.col("sub").alias("s2"))
    reach = names.withColumn("c1", F.explode(F.array("cell", F.col("cell") + 1)))
    pairs = reach.join(other, (F.col("label") == F.col("l2")) & (F.col("dim") == F.col("d2")) & (F.col("c1") == F.col("c2"))).where((F.col("c2") > F.col("cell")) | (F.col("sub") <= F.col("s2")))
    pairs = pairs.select("label", "dim", "cell", "sub", "c2", "s2")
    one = F.struct(F.lit(0).alias("side"), F.col("cell").alias("tc"), F.col("sub").alias("ts"))
    two = F.struct(F.lit(1).alias("side"), F.col("c2").alias("tc"), F.col("s2").alias("ts"))
    alone = (F.col("cell") == F.col("c2")) & (F.col("sub") == F.col("s2"))
    asked = pairs.select("label", "dim", F.col("cell").alias("pc"), F.col("sub").alias("ps"), F.col("c2").alias("qc"), F.col("s2").alias("qs"), F.explode(F.when(alone, F.array(one)).otherwise(F.array(one, two))).alias("t"))
    asked = asked.select("label", "dim", "pc", "ps", "qc", "qs", "t.side", F.col("t.tc").alias("cell"), F.col("t.ts").alias("sub"))
    brought = asked.join(tiles, ["label", "dim", "cell", "sub"]).select("label", "dim", "pc", "ps", "qc", "qs", "side", "reps", "sizes", "v")
    found = saved(brought.groupBy("label", "dim", "pc", "ps", "qc", "qs").applyInArrow(_compare(axes, config), "edge boolean, a long, b long"), "vector-links")

    sums = found.where("not edge").groupBy(F.col("a").alias("rep")).agg(F.sum("b").alias("others"))
    parts = connected(found.where("edge").select(F.col("a").alias("src"), F.col("b").alias("dst"))).withColumnRenamed("node", "rep")
    known = classes.select("label", "k1", "k2", "rep", "size").join(sums, "rep", "left").join(parts, "rep", "left")
    known = known.select(F.col("label").alias("l2"), F.col("k1").alias("j1"), F.col("k2").alias("j2"), (F.col("size") - 1 + F.coalesce("others", F.lit(0))).alias("n"), F.coalesce("component", "rep").alias("c"))
    out = rows.join(known, F.col("usable") & (F.col("label") == F.col("l2")) & (F.col("k1") == F.col("j1")) & (F.col("k2") == F.col("j2")), "left")
    component = F.coalesce("c", "vec_id")
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


SQL = """
with recursive e as (select vec_id, label, embedding::double[] as v from embeddings),
ok as (select vec_id, label, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) as norm from e
       where label is not null and vec_id is not null and v is not null and len(v) > 0 and len(list_filter(v, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(v, lambda x: x <> 0)) > 0),
links as (select a.vec_id as x, b.vec_id as y from ok a join ok b on a.label = b.label and len(a.v) = len(b.v) and a.vec_id <> b.vec_id where list_dot_product(a.v, b.v) / (a.norm * b.norm) >= 0.93),
reach(x, y) as (select vec_id, vec_id from e union select r.x, l.y from reach r join links l on r.y = l.x),
comp as (select x, min(y) as c from reach group by 1), n as (select x, count(*) as n from links group by 1)
select e.vec_id, coalesce(n.n, 0)::bigint as n_links, comp.c::bigint as component_id, e.vec_id = comp.c as kept from e left join n on n.x = e.vec_id join comp on comp.x = e.vec_id
"""
