"""The registered queries of this subpackage, each over its whole table with production parameters, and their SQL."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from folio.llm import bpe, chat, embeddings, fingerprint, jaccard, licenses, packing, pii, quality, secrets

#: A folder of the public tokenizers' files, if they are not to be taken from where their package is.
TOKENIZERS = os.environ.get("FOLIO_TOKENIZERS")


def vocabulary(name: str) -> str:
    """The path of a public tokenizer's file."""
    if TOKENIZERS:
        return os.path.join(TOKENIZERS, name)
    import public_tokenizers

    return str(public_tokenizers.path(name))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detect(table(spark, sf_dir, "documents"))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op5_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.components(table(spark, sf_dir, "documents"))


def op6_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.links(table(spark, sf_dir, "embeddings"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digested(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotate(table(spark, sf_dir, "conversations"))


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.compared(table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), vocabulary("byte_bpe_50k.tiktoken"))


QUERIES = {f.__name__: f for f in (op1_quality, op2_pii, op3_licenses, op4_secrets, op5_jaccard, op6_embeddings, op7_bpe, op8_chat, op9_fingerprints, op10_packing)}
SQL = {"op3_licenses": licenses.SQL, "op5_jaccard": jaccard.SQL, "op6_embeddings": embeddings.SQL, "op8_chat": chat.SQL}
