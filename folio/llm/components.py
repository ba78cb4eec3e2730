"""Connected components of a link table, by contraction; every step is a join or an aggregation of narrow rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.scratch import dropped, saved


class Forest:
    """Union-find over any hashable ids; the smaller id is the root."""

    def __init__(self) -> None:
        self.up: dict = {}

    def root(self, x):
        up = self.up
        while (p := up.get(x, x)) != x:
            up[x] = x = up.get(p, p)
        return x

    def join(self, a, b) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        if b < a:
            a, b = b, a
        self.up[b] = a
        return True


_EDGE = pa.schema([("src", pa.int64()), ("dst", pa.int64())])


def _thinned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each batch only links that join something; as links to the smallest id."""
    for b in batches:
        f = Forest()
        for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            f.join(x, y)
        far = list(f.up)
        yield pa.RecordBatch.from_arrays([pa.array([f.root(x) for x in far], pa.int64()), pa.array(far, pa.int64())], schema=_EDGE)


def connected(edges: DataFrame, a: str = "src", b: str = "dst") -> DataFrame:
    """(node, component) for every id in a link; component is the smallest id that links reach.

    Each round points every id at its smallest neighbour, follows the pointers a few steps and contracts the links; the number of ids
    with links left falls at least by half.
    """
    e = edges.select(F.least(a, b).alias("src"), F.greatest(a, b).alias("dst")).where("src < dst").mapInArrow(_thinned, "src long, dst long").distinct()
    e = saved(e, "links")
    labels: DataFrame | None = None
    while not e.isEmpty():
        p = e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("parent"))
        p = saved(p.select("node", F.least("node", "parent").alias("parent")), "parents")
        far = p
        for k in range(2):
            q = p.select(F.col("node").alias(f"n{k}"), F.col("parent").alias(f"p{k}"))
            far = far.join(q, F.col("parent") == F.col(f"n{k}")).select("node", F.col(f"p{k}").alias("parent"))
        far = saved(far, "hops")
        x, y = (far.select(F.col("node").alias(f"n{c}"), F.col("parent").alias(f"p{c}")) for c in "xy")
        contracted = e.join(x, F.col("src") == F.col("nx")).join(y, F.col("dst") == F.col("ny")).select(F.col("px").alias("u"), F.col("py").alias("v"))
        onward = far.select(F.col("parent").alias("u")).distinct().join(x, F.col("u") == F.col("nx")).select("u", F.col("px").alias("v"))
        fresh = contracted.unionByName(onward).where("u <> v").select(F.least("u", "v").alias("src"), F.greatest("u", "v").alias("dst")).distinct()
        fresh = saved(fresh, "links")
        if labels is None:
            new = far.select("node", F.col("parent").alias("component"))
        else:
            new = labels.join(x, F.col("component") == F.col("nx"), "left").select("node", F.coalesce("px", "component").alias("component"))
        new = saved(new, "labels")
        for old in (e, p, far, labels):
            if old is not None:
                dropped(old)
        e, labels = fresh, new
    if labels is None:
        labels = e.select(F.col("src").alias("node"), F.col("dst").alias("component"))
    return labels


def spanning(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Of the links a[i]-b[i] those that join something not joined before."""
    f = Forest()
    return [(x, y) for x, y in zip(a.tolist(), b.tolist(), strict=True) if f.join(x, y)]
