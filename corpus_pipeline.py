"""The corpus pipeline: quality classifier, near-duplicate removal, personal data, packing.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet
and read again as the next one's docs. All but the last return the columns of documents.

Rejected documents go at the first stage; of each group of near-duplicates the document with the smallest id stays, and of rows with equal
id and text one (rows that share an id but not the text both stay); personal data are masked in the text; what is left is packed into sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm import jaccard, packing, pii, quality
from folio.llm.queries import table, vocabulary
from folio.llm.scratch import saved

#: So many ids are broadcast at most.
BROADCAST_IDS = 1_000_000


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = jaccard.components(docs)
    surplus = found.where(F.col("component_id") < F.col("doc_id")).select("doc_id").distinct()
    kept = docs.join(surplus, "doc_id", "left_anti").select(*docs.columns)
    # rows that repeat an id are none or few: only their texts are shuffled; those without an id are compared by text
    again = saved(kept.groupBy("doc_id").agg(F.count("*").alias("_rows")).where("_rows > 1").select(F.col("doc_id").alias("_again")), "repeated-ids")
    n = again.count()
    if not n:
        return kept
    again = F.broadcast(again) if n <= BROADCAST_IDS else again
    same = F.col("doc_id").eqNullSafe(F.col("_again"))
    return kept.join(again, same, "left_anti").unionByName(kept.join(again, same, "left_semi").dropDuplicates(["doc_id", "text"]))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, vocabulary("byte_bpe_50k.json"), vocabulary("byte_bpe_50k.tiktoken"))


STAGES = [
    ("quality", keep_quality),
    ("near-duplicates", drop_near_duplicates),
    ("personal-data", mask_personal_data),
    ("packing", pack_sequences),
]
#: The classifier, the span model and the tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = saved(docs, f"stage-{name}")
    return docs
