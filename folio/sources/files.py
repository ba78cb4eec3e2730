"""Files: texts in any encoding, JSON lines with last-row-wins keys, CSV, vectors, server-sent events."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


@F.pandas_udf(StringType())
def decoded(raw: pd.Series) -> pd.Series:
    """Text of bytes: UTF-8 where valid, else the best guess of charset detection (if installed), else UTF-8 with replacements."""
    try:
        from charset_normalizer import from_bytes
    except ImportError:
        from_bytes = None

    def one(b):
        if b is None:
            return None
        try:
            return bytes(b).decode("utf-8")
        except UnicodeDecodeError:
            best = from_bytes(bytes(b)).best() if from_bytes else None
            return str(best) if best is not None else bytes(b).decode("utf-8", "replace")

    return raw.map(one)


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """path, title (file stem), sha256, text of every file."""
    files = spark.read.format("binaryFile").load(path)
    stem = F.regexp_extract("path", r"([^/]*?)(?:\.[^./]*)?$", 1)
    return files.select("path", stem.alias("title"), F.sha2("content", 256).alias("file_hash"), decoded("content").alias("text"))


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of JSON lines; blank and broken lines are left out."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    row = F.from_json("value", schema, {"mode": "PERMISSIVE"})
    return lines.where(F.get_json_object("value", "$").isNotNull()).select(row.alias("r")).select("r.*")


def last_wins(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Of rows with equal keys the last one; one aggregation, no window."""
    names = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*names), F.col(order)).alias("_r")).select(key, *[F.col(f"_r.{n}").alias(n) for n in names])


def read_checkpoint(spark: SparkSession, path: str, schema: str, key: str) -> DataFrame:
    """A resumable job's rows: files in order of name, lines in order."""
    lines = spark.read.text(path).where(F.trim("value") != "").withColumn("_file", F.input_file_name()).withColumn("_line", F.monotonically_increasing_id())
    rows = lines.select(F.from_json("value", schema).alias("r"), F.struct("_file", "_line").alias("_at")).where(F.col(f"r.{key}").isNotNull()).select("r.*", "_at")
    return last_wins(rows, key, "_at").drop("_at")


def todo(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What a checkpoint does not hold yet."""
    return rows.join(done.select(key).distinct(), key, "left_anti")


def append_jsonl(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(path)


def replace_table(rows: DataFrame, path: str, staging: str) -> None:
    """Writes beside the table, then swaps by renaming: a reader sees the old rows or the new ones."""
    spark = rows.sparkSession
    rows.write.mode("overwrite").parquet(staging)
    jvm, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    old, new = jvm.Path(path), jvm.Path(staging)
    fs = old.getFileSystem(conf)
    aside = jvm.Path(path + ".old")
    fs.delete(aside, True)
    if fs.exists(old):
        fs.rename(old, aside)
    if not fs.rename(new, old):
        fs.rename(aside, old)
        raise OSError(f"{staging} could not be moved to {path}")
    fs.delete(aside, True)


def save_vectors(vectors: DataFrame | None, path: str, spark: SparkSession) -> None:
    """(id, vector) as Parquet; without vectors, stale ones are removed."""
    if vectors is None:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    else:
        vectors.select("id", "vector").write.mode("overwrite").parquet(path)


DELTA = "choices array<struct<delta:struct<content:string>>>, usage struct<prompt_tokens:bigint,completion_tokens:bigint>"


def sse_deltas(lines: DataFrame, stream: str = "stream_id", seq: str = "seq", line: str = "line") -> DataFrame:
    """(stream, seq, delta, usage) of a token stream's lines: only data lines before [DONE] that hold JSON."""
    data = lines.where(F.col(line).startswith("data:")).withColumn("_d", F.trim(F.substr(F.col(line), F.lit(6))))
    end = F.min(F.when(F.col("_d") == "[DONE]", F.col(seq))).over(Window.partitionBy(stream))
    open_ = data.withColumn("_end", end).where(F.col("_end").isNull() | (F.col(seq) < F.col("_end")))
    parsed = open_.withColumn("_j", F.from_json("_d", DELTA)).where(F.get_json_object("_d", "$").isNotNull())
    return parsed.select(stream, seq, F.try_element_at(F.col("_j.choices.delta.content"), F.lit(1)).alias("delta"), F.col("_j.usage").alias("usage"))


def sse_event(event: Column, payload: Column) -> Column:
    return F.concat(F.lit("event: "), event, F.lit("\ndata: "), payload, F.lit("\n\n"))


def sse_blocks(text: Column) -> Column:
    """array<struct<event,data>> of a whole stream's text; what follows the last blank line is incomplete and left out."""
    blocks = F.split(text, "\n\n")
    whole = F.slice(blocks, F.lit(1), F.size(blocks) - 1)
    field = lambda b, name: F.regexp_extract(b, rf"(?m)^{name}: ?(.*)$", 1)
    return F.transform(F.filter(whole, lambda b: F.trim(b) != ""), lambda b: F.struct(field(b, "event").alias("event"), field(b, "data").alias("data")))


# --- graphs and community indexes ---------------------------------------------------------------------------------------------

_GRAPH_ORDER = {"nodes": ["entity_id"], "edges": ["src", "dst"], "mentions": ["entity_id", "chunk_key"], "merges": ["entity_id"], "ambiguous": ["entity_id"]}


def save_graph(g, path: str) -> None:
    """A graph's tables as JSON lines under one folder, each sorted by its key, so that equal graphs give equal files."""
    for name, keys in _GRAPH_ORDER.items():
        getattr(g, name).orderBy(*keys).write.mode("overwrite").json(f"{path}/{name}")


def load_graph(spark: SparkSession, path: str):
    """What `save_graph` wrote. Columns that had no value in any row are typed as in a graph that is built."""
    from folio.operators.graph import Graph

    kinds = {
        "nodes": "entity_id string, name string, type string, aliases array<string>, desc string, n_mentions long, idf double",
        "edges": "src string, dst string, weight long, rels array<struct<rel:string,chunk:string>>", "mentions": "entity_id string, chunk_key string",
        "merges": "entity_id string, target string", "ambiguous": "entity_id string, candidates array<string>",
    }
    return Graph(**{name: spark.read.schema(kind).json(f"{path}/{name}") for name, kind in kinds.items()})


def save_partition(members: DataFrame, path: str) -> None:
    """Communities as JSON lines: community, size and entities in order."""
    lists = members.groupBy("community").agg(F.count("*").alias("size"), F.array_sort(F.collect_list("entity_id")).alias("entities"))
    lists.orderBy("community").write.mode("overwrite").json(path)


def load_partition(spark: SparkSession, path: str) -> DataFrame:
    """(entity_id, community, size) of what `save_partition` wrote."""
    return spark.read.schema("community string, size long, entities array<string>").json(path).select(F.explode("entities").alias("entity_id"), "community", "size")


def graph_exists(spark: SparkSession, path: str) -> bool:
    """Whether a graph was saved there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/nodes")
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
