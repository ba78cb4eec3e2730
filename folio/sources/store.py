"""The chunk store: a Parquet table partitioned by group, with keyed merges. Every change rewrites only the groups it touches."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from folio.schemas import CHUNK, names
from folio.sources.files import replace_table


def chunk_key(book: Column, index: Column) -> Column:
    return F.concat_ws(":", book, index.cast("string"))


def split_key(key: Column) -> tuple[Column, Column]:
    """Book and index of a chunk key, cut at its last colon."""
    return F.regexp_extract(key, r"(?s)^(.*):([^:]*)$", 1), F.regexp_extract(key, r"(?s)^(.*):([^:]*)$", 2).try_cast("int")


def point_ids(namespace: str):
    """External ids: name-based UUIDs, the same for the same key."""
    space = uuid.UUID(namespace)

    @F.pandas_udf(StringType())
    def named(keys: pd.Series) -> pd.Series:
        return keys.map(lambda k: None if k is None else str(uuid.uuid5(space, k)))

    return named


def merged(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows replace old ones of the same key; of new rows with equal keys one stays. Idempotent."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new.dropDuplicates(keys), allowMissingColumns=True)


def patched(old: DataFrame, fields: DataFrame, keys: list[str]) -> DataFrame:
    """Only the named columns of the rows that `fields` has are set, also to null."""
    names = [c for c in fields.columns if c not in keys]
    new = fields.select(*keys, *[F.col(c).alias(f"_{c}") for c in names], F.lit(True).alias("_has"))
    out = old.join(new, keys, "left")
    for c in names:
        kept = F.col(c) if c in old.columns else F.lit(None)
        out = out.withColumn(c, F.when(F.col("_has"), F.col(f"_{c}")).otherwise(kept))
    return out.drop("_has", *[f"_{c}" for c in names])


class ChunkStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def exists(self) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return bool(at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at))

    def ensure(self) -> None:
        if not self.exists():
            self.spark.createDataFrame([], CHUNK).write.partitionBy("group_id").parquet(self.path)

    def scan(self, group: str | None = None, vectors: bool = False) -> DataFrame:
        """All chunks, of one group if given (partition pruning); vectors are read only on demand."""
        out = self.spark.read.schema(CHUNK).parquet(self.path)
        out = out.where(F.col("group_id") == group) if group else out
        return out if vectors else out.drop("vector")

    def fetch(self, keys: DataFrame, vectors: bool = False) -> DataFrame:
        """Chunks of the given keys; missing ones are silently absent."""
        return self.scan(vectors=vectors).join(keys.select("chunk_key").distinct(), "chunk_key", "left_semi")

    def _rewrite(self, rows: DataFrame) -> None:
        replace_partitions(rows, self.path)

    def upsert(self, points: DataFrame) -> int:
        """Idempotent by chunk key. Returns how many rows were given."""
        self.ensure()
        points = self.spark.createDataFrame([], CHUNK).unionByName(points, allowMissingColumns=True)
        touched = points.select("group_id").distinct()
        old = self.scan(vectors=True).join(touched, "group_id", "left_semi")
        self._rewrite(merged(old, points, ["chunk_key"]))
        return points.count()

    def replace_books(self, books: DataFrame, points: DataFrame | None = None) -> None:
        """The books' old chunks (column book_id) go and `points` come, in one rewrite of the groups that either is in."""
        self.ensure()
        every, none = self.scan(vectors=True), self.spark.createDataFrame([], CHUNK)
        fresh = none if points is None else none.unionByName(points, allowMissingColumns=True)
        gone = books.select("book_id").distinct()
        touched = every.join(gone, "book_id", "left_semi").select("group_id").unionByName(fresh.select("group_id")).distinct()
        left = every.join(touched, "group_id", "left_semi").join(gone, "book_id", "left_anti").select(*names(CHUNK)).unionByName(fresh.select(*names(CHUNK)))
        empty = [r["group_id"] for r in touched.join(left.select("group_id").distinct(), "group_id", "left_anti").collect()]  # groups without any other book
        self._rewrite(left)
        for g in empty:
            at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/group_id={g}")
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)

    def delete_book(self, book: str) -> None:
        self.replace_books(self.spark.createDataFrame([(book,)], "book_id string"))

    def set_payload(self, fields: DataFrame) -> None:
        """Rewrites the groups that have one of the keys."""
        every = self.scan(vectors=True)
        touched = every.join(fields.select("chunk_key"), "chunk_key", "left_semi").select("group_id").distinct()
        self._rewrite(patched(every.join(touched, "group_id", "left_semi"), fields, ["chunk_key"]).select(*names(CHUNK)))


def replace_partitions(rows: DataFrame, path: str) -> None:
    """Overwrites only the group partitions that `rows` has, by way of a staging table (rows may come from `path` itself)."""
    spark, staging = rows.sparkSession, f"{path}.staging-{uuid.uuid4().hex}"
    rows.write.partitionBy("group_id").parquet(staging)
    spark.read.schema(rows.schema).parquet(staging).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("group_id").parquet(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(staging)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


__all__ = ["ChunkStore", "chunk_key", "merged", "patched", "point_ids", "replace_table", "split_key"]
