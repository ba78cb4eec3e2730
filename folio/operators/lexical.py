"""Lexical retrieval over postings: BM25 and learned sparse weights."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.lineage import saved
from folio.operators.ranking import small, top_k

#: Fixed value: what a word is in lower case, if it has two characters or more.
_WORD = re.compile("[a-zäöüß0-9]+")
#: Rows whose words are counted at once.
ROWS = 256

K1, B, EPSILON = 1.5, 0.75, 0.25


def counted(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term, tf, dl) of every row, dl being its words; terms are counted where the row is, in Arrow batches, so nothing is shuffled."""
    kind = docs.schema[key].dataType

    def words(text: str | None) -> Counter:
        return Counter(w for w in _WORD.findall((text or "").lower()) if len(w) > 1)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start in range(0, b.num_rows, ROWS):
                part = b.slice(start, ROWS)
                found = [words(t) for t in part.column(1).to_pylist()]
                many = [len(c) for c in found]
                keys = part.column(0).take(pa.array(np.repeat(np.arange(len(found)), many)))
                columns = [pa.array([w for c in found for w in c], pa.string()), pa.array([n for c in found for n in c.values()], pa.int64()), pa.array(np.repeat([c.total() for c in found], many), pa.int64())]
                yield pa.RecordBatch.from_arrays([keys, *columns], names=["key", "term", "tf", "dl"])

    return docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(count, f"key {kind.simpleString()}, term string, tf long, dl long").withColumnRenamed("key", key)


def postings(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term, tf) of every row."""
    return counted(docs, key, text).drop("dl")


def document_frequency(posts: DataFrame, key: str) -> DataFrame:
    return posts.groupBy("term").agg(F.count(key).alias("df"))


def idf_table(df: DataFrame, n_docs: int) -> DataFrame:
    """ln((N - n + 0.5) / (n + 0.5)); negative ones become EPSILON times the mean over all terms."""
    raw = df.withColumn("raw", F.log((F.lit(n_docs) - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    mean = raw.agg(F.avg("raw").alias("mean_idf"))
    return raw.crossJoin(F.broadcast(mean)).select("term", F.when(F.col("raw") < 0, EPSILON * F.col("mean_idf")).otherwise(F.col("raw")).alias("idf"))


def bm25(docs: DataFrame, queries: DataFrame, k: int, key: str = "doc_id", text: str = "text", query: str = "query_id", query_text: str = "query") -> DataFrame:
    """Okapi ranking with positive scores only; equal scores by key. Of the postings only those of query terms are joined, and the query terms are broadcast while they are few."""
    posts = counted(docs, key, text)
    terms = saved(posts.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("n")), "terms")
    n, words = docs.count(), terms.agg(F.sum("n").alias("n")).first()["n"] or 0
    asked = saved(postings(queries, query, query_text).withColumnRenamed("tf", "qtf").join(idf_table(terms.select("term", "df"), n), "term"), "query-terms")
    hits = posts.join(F.broadcast(asked) if small(asked, 1_000_000) else asked, "term")
    part = F.col("qtf") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.lit(float(words / n if words else 1))))
    scores = hits.groupBy(query, key).agg(F.round(F.sum(part), 6).alias("score")).where("score > 0")
    return top_k(scores, k, query, F.desc("score"), F.col(key))


def sparse_top_k(docs: DataFrame, queries: DataFrame, k: int, key: str = "chunk_key", query: str = "query_id", weights: str = "weights") -> DataFrame:
    """Dot product of token-weight maps, by a join on the token; only positive scores rank."""
    left = docs.select(key, F.explode(weights).alias("token", "w"))
    right = queries.select(query, F.explode(weights).alias("token", "qw"))
    scores = left.join(F.broadcast(right) if small(right, 1_000_000) else right, "token").groupBy(query, key).agg(F.round(F.sum(F.col("w") * F.col("qw")), 6).alias("score")).where("score > 0")
    return top_k(scores, k, query, F.desc("score"), F.col(key))
