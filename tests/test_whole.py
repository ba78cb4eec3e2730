"""Operators and queries leave nothing out: beyond one broadcast, beyond the sample that SQL is held against, beyond a prefix."""

import random
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from folio.functions import text as T
from folio.models import lexical_score
from folio.operators import communities, ranking
from folio.plans import answer as A
from folio.plans import queries as Q


def test_matrix_ranking_of_many_queries(spark, monkeypatch):
    v = lambda k: [float(k % 3), 1.0, float(k % 5)]
    chunks = spark.createDataFrame([(f"c{k}", v(k)) for k in range(20)], "chunk_key string, vector array<double>")
    queries = spark.createDataFrame([(k, v(k)) for k in range(12)], "query_id int, query_vector array<double>")
    want = {(r["query_id"], r["rank"]): (r["chunk_key"], r["score"]) for r in ranking.dense_top_k(chunks, queries, 3).collect()}
    for rows in (5, 12, 100):
        monkeypatch.setattr(ranking, "BROADCAST_ROWS", rows)
        monkeypatch.setattr(ranking, "small", lambda df, rows=rows: df.limit(rows + 1).count() <= rows)
        assert {(r["query_id"], r["rank"]): (r["chunk_key"], r["score"]) for r in ranking.dense_top_k_blocks(chunks, queries, 3, 3).collect()} == want
    assert len(want) == 36
    assert ranking.dense_top_k_blocks(chunks, queries.where("false"), 3, 3).count() == 0


@pytest.fixture(scope="module")
def nearest_edges(spark, sf_dir):
    """Edges to the most similar other vector by brute force over all vectors."""
    rows = sorted(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").collect())
    ids, m = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float64)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    scores = np.round(m @ m.T, 6)
    np.fill_diagonal(scores, -2)
    return ids, {tuple(sorted((f"v{a:06d}", f"v{b:06d}"))) for a, b in zip(ids, ids[scores.argmax(1)], strict=True)}


def test_every_vector_is_node_and_candidate(spark, sf_dir, nearest_edges):
    ids, want = nearest_edges
    assert {(r["src"], r["dst"]) for r in Q.nearest(spark, sf_dir).collect()} == want
    assert {r["entity_id"] for r in Q.QUERIES["connected_components"](spark, sf_dir).collect()} == {f"v{k:06d}" for k in ids}
    assert Q.QUERIES["modularity_terms"](spark, sf_dir).agg(F.sum("size")).first()[0] == len(ids)


def test_global_search_ranks_passages_over_all_vectors(spark, sf_dir, nearest_edges):
    degree = Counter(v for edge in nearest_edges[1] for v in edge)
    score = Counter()
    for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label").collect():
        score[f"c{r['label']:03d}", f"k{r['vec_id'] % 13}"] += degree[f"v{r['vec_id']:06d}"]
    best = {c: [k for (_, k), _ in sorted(((x, n) for x, n in score.items() if x[0] == c), key=lambda x: (-x[1], x[0][1]))[:2]] for c, _ in score}
    first = Q.QUERIES["global_search"](spark, sf_dir).where("marker <= 3 and kind = 'chunk'").collect()
    top = {r["query_id"]: r["community"] for r in Q.QUERIES["global_search"](spark, sf_dir).where("marker = 1").collect()}
    found = {q: [r["chunk_key"] for r in sorted(first, key=lambda r: r["marker"]) if r["query_id"] == q and r["community"] == c] for q, c in top.items()}
    assert found == {q: best[c] for q, c in top.items()}


def test_every_vector_is_in_the_graph_pool(spark, sf_dir):
    c = Q.chunks(spark, sf_dir)
    rows = c.select("vec_id", "chunk_key", "chunk_index").collect()
    got = {r["chunk_key"] for r in Q.QUERIES["fuse_scores"](spark, sf_dir).where("query_id = 0 and graph_score > 0").collect()}
    pool = sorted((r for r in rows if r["vec_id"] != 0), key=lambda r: (-(r["chunk_index"] % 7), r["chunk_key"]))[:40]
    assert {r["chunk_key"] for r in pool[:20]} <= got and any(r["vec_id"] % 3 for r in pool[:20])


def test_every_paragraph_is_flagged(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id").collect()
    got = [r["para"] for r in Q.QUERIES["heading_flags"](spark, sf_dir).collect()]
    assert sorted(got) == sorted(r[0] for r in docs) and any(k % 2 == 0 for k in got)


def test_graph_is_built_from_all_words(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    words = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("[A-Z][a-z]{5,}"), F.lit(0))).alias("w"))
    keyed = words.select("doc_id", T.entity_key(F.col("w"), F.lit("PERSON")).alias("e")).where("e <> 'PERSON:'").distinct()
    want = {r["e"]: r["count"] for r in keyed.groupBy("e").count().collect()}
    rows = Q.QUERIES["graph_build"](spark, sf_dir).collect()
    assert {r["entity_id"]: r["n_mentions"] for r in rows} == want
    assert keyed.groupBy("doc_id").count().agg(F.max("count")).first()[0] > 8


def test_extraction_and_calibration_take_whole_texts(spark, sf_dir, tmp_path):
    names = ["Bcdefg", "Cdefgh", "Defghi", "Efghij", "Fghijk", "Ghijkl", "Hijklm"]
    spark.createDataFrame([(2, " ".join(["Abcdef"] * 12 + names))], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert Q.QUERIES["extraction_parse"](spark, str(tmp_path)).first()["n_entities"] == 8
    texts = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()}
    assert {r["item_id"]: r["answer"] for r in Q.QUERIES["calibration_pairs"](spark, sf_dir).collect()} == texts


def test_communities_use_edges_of_single_documents(spark, sf_dir):
    nodes, edges, _, _ = Q.entity_graph(spark, sf_dir)
    often = {r["entity_id"] for r in nodes.where("n_mentions >= 2").collect()}
    kept = [(r["src"], r["dst"], float(r["weight"])) for r in edges.collect() if {r["src"], r["dst"]} <= often]
    home = communities.local_moves(kept)
    up = {n: n for n in home}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b, _ in kept:
        if home[a] == home[b]:
            up[max(root(a), root(b))] = min(root(a), root(b))
    size = Counter(root(n) for n in home)
    want = {n: size[root(n)] for n in home if size[root(n)] >= 3}
    rows = Q.QUERIES["louvain_communities"](spark, sf_dir).collect()
    assert {r["entity_id"]: r["size"] for r in rows} == want
    assert len({(r["community"], root(r["entity_id"])) for r in rows}) == len({r["community"] for r in rows}) == len({root(n) for n in want})
    assert any(w == 1 and a in want for a, _, w in kept)


def test_support_late_in_a_long_passage(spark):
    bounded = lambda premise, said: lexical_score(F.array_join(F.slice(F.split(premise, " "), 1, 381), " "), said)
    long = " ".join(["nothing"] * 1300) + " the red fox ran"
    hits = spark.createDataFrame([(1, 1, long, 0.5), (1, 2, "a blue whale", 0.4), (1, 3, None, 0.3)], "query_id int, rank int, text string, score double")
    answers = spark.createDataFrame([(1, "The red fox ran [1]. A blue whale swam [2]. Unknown words [3].")], "query_id int, answer string")
    sources = A.faithfulness(A.cited_sources(answers, hits), answers, bounded).collect()
    assert {r["marker"]: r["supported"] for r in sources} == {1: True, 2: True, 3: False}
    one = spark.createDataFrame([(1, "The red fox ran [1].")], "query_id int, answer string")
    assert A.answer_faithfulness(one, hits.where("rank = 1"), bounded).first()["faithfulness"] == 1.0
    assert A.answer_faithfulness(one, hits.where("rank > 9"), bounded).first()["faithfulness"] == 0.0


def test_islands_of_fractions_and_nulls_are_those_of_sql(spark, tmp_path):
    rng = random.Random(6)
    rows = [(o, rng.choice([*range(1, 8), None]) if o % 3 else n, rng.choice([24.5, 25.5, 24.4, 0.5, 60.0, None])) for o in range(60) for n in range(1, rng.randrange(2, 8))]
    rows = sorted({(o, n): (o, n, q) for o, n, q in rows}.values(), key=str)  # no equal spans: their order is open in SQL
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    db = duckdb.connect()
    db.execute(f"create view lineitem as select * from '{tmp_path}/lineitem.parquet/*.parquet'")
    want = Counter(db.execute(Q.SQL["span_merge_islands"]).fetchall())
    assert Counter(map(tuple, Q.QUERIES["span_merge_islands"](spark, str(tmp_path)).collect())) == want
