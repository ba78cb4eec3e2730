"""Range operators: overlap join, as-of join, merging of spans."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def overlap_join(left: DataFrame, right: DataFrame, on: str, width: int, start: str = "char_start", end: str = "char_end", right_start: str = "span_start", right_end: str = "span_end") -> DataFrame:
    """Pairs of rows with equal `on` whose half-open ranges overlap; null bounds never do.

    Ranges are cut into buckets of `width`, so the join is an equi-join on (on, bucket) and a book of any length is spread over many
    keys; a pair is kept in the first bucket that both reach only.
    """
    cut = lambda df, a, b: df.where(F.col(a).isNotNull() & (F.col(b) > F.col(a))).withColumn("_bucket", F.explode(F.sequence(F.floor(F.col(a) / width), F.floor((F.col(b) - 1) / width))))
    joined = cut(left, start, end).join(cut(right, right_start, right_end), [on, "_bucket"])
    first = F.col("_bucket") == F.floor(F.greatest(F.col(start), F.col(right_start)) / width)
    return joined.where((F.col(start) < F.col(right_end)) & (F.col(right_start) < F.col(end)) & first).drop("_bucket")


def as_of(rows: DataFrame, events: DataFrame, on: str, at: str, event_at: str, value: str, name: str) -> DataFrame:
    """Each row with the `value` of the last event at or before it; null before the first. Union and running last value, so nothing is multiplied."""
    own = [c for c in rows.columns]
    every = rows.withColumn("_at", F.col(at)).withColumn("_kind", F.lit(1)).withColumn(name, F.lit(None).cast(events.schema[value].dataType))
    marks = events.select(F.col(on), F.col(event_at).alias("_at"), F.lit(0).alias("_kind"), F.col(value).alias(name))
    running = Window.partitionBy(on).orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    return every.unionByName(marks, allowMissingColumns=True).withColumn(name, F.last(name, ignorenulls=True).over(running)).where("_kind = 1").select(*own, name)


def merge_spans(spans: DataFrame, by: str, start: str = "char_start", end: str = "char_end") -> DataFrame:
    """Overlapping or touching spans as one. A null bound opens no island but the first: such a span goes with the one before it, nulls being last."""
    order = Window.partitionBy(by).orderBy(F.asc_nulls_last(start), F.asc_nulls_last(end))
    before, upto = (order.rowsBetween(Window.unboundedPreceding, k) for k in (-1, 0))
    fresh = F.when((F.col(start) > F.max(end).over(before)) | (F.row_number().over(order) == 1), 1).otherwise(0)
    islands = spans.withColumn("_new", fresh).withColumn("_island", F.sum("_new").over(upto))
    return islands.groupBy(by, "_island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_island")
