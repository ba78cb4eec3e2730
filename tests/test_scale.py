"""No row for every pair of query and chunk, and the same results without it."""

import random

import numpy as np
import pytest

from folio.models import HashEmbedder, embed
from folio.operators import communities, graph, ranking
from folio.plans import ingest as I
from folio.plans.queries import QUERIES


@pytest.mark.parametrize("name", ["graph_expand", "service_answers", "fuse_scores", "graph_link", "hit_mrr_by_k", "interleave_rankings", "paired_rank_sign_test", "span_coverage", "rerank_topk", "rrf_hybrid"])
def test_no_row_for_every_pair(spark, sf_dir, monkeypatch, name):
    def refuse(*_, **__):
        raise AssertionError("pair by pair")

    scores = graph.chunk_scores
    monkeypatch.setattr(ranking, "pair_scores", refuse)
    monkeypatch.setattr(graph, "chunk_scores", lambda *a, **b: scores(*a, **b) if len(a) > 5 or b.get("pairs") is not None else refuse())
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_matrix_ranking_is_that_of_pairs(spark):
    rng = random.Random(3)
    some = lambda: rng.choice([None, [], [1.0], [None, 1.0, 0.0], [float("nan"), 0.0, 0.0], [0.0, 0.0, 0.0], [-1e-9, 0.0, 0.0], *[[rng.uniform(-1, 1) for _ in range(3)] for _ in range(9)], *[[0.6, 0.8, 0.0]] * 5])
    chunks = spark.createDataFrame([(rng.choice([None, *range(40)]), f"k{n:03d}", rng.choice([None, "a", "b"]), some()) for n in range(90)], "vec_id long, chunk_key string, group_id string, vector array<double>").repartition(3)
    queries = spark.createDataFrame([(n, some(), rng.choice([None, ["a"], ["a", None], []])) for n in range(0, 40, 2)], "query_id long, query_vector array<double>, group_ids array<string>")
    rows = lambda df: sorted(map(str, df.select("query_id", "rank", "chunk_key", "score").collect()))
    for k in (1, 7, 200):
        want = rows(ranking.dense_top_k(chunks, queries, k, on=ranking.F.expr("vec_id <> query_id and (group_ids is null or array_contains(group_ids, group_id))")))
        assert want and rows(ranking.dense_top_k(chunks, queries, k, other="vec_id", groups="group_ids")) == want
    assert rows(ranking.dense_top_k(chunks, queries, 4)) == rows(ranking.dense_top_k(chunks, queries, 4, on=ranking.F.lit(True)))


def test_best_chunks_of_a_graph_are_those_of_all_scores(spark, monkeypatch):
    rng = random.Random(5)
    nodes = spark.createDataFrame([(f"e{e}", rng.choice([0.0, 0.5, 1.25, 2.0])) for e in range(12)], "entity_id string, idf double")
    mentions = spark.createDataFrame(sorted({(f"e{rng.randrange(12)}", f"c{rng.randrange(60):02d}") for _ in range(200)}), "entity_id string, chunk_key string")
    active = spark.createDataFrame(sorted({(q, f"e{rng.randrange(14)}"): round(rng.random(), 2) for q in range(25) for _ in range(4)}.items()), "k struct<query_id: int, entity_id: string>, activation double").select("k.*", "activation")
    rows = lambda df: sorted(map(tuple, df.select("query_id", "rank", "chunk_key", "graph_score", "n_shared").collect()))
    for shared in (1, 2):
        want = rows(ranking.top_k(graph.chunk_scores(active, mentions, nodes, shared), 6, "query_id", ranking.F.desc("graph_score"), ranking.F.col("chunk_key")))
        for cells, most in ((1 << 22, 20_000), (40, 7)):
            monkeypatch.setattr(graph, "CELLS", cells)
            monkeypatch.setattr(ranking, "BROADCAST_ROWS", most)
            assert want and rows(graph.top_chunks(active, mentions, nodes, 6, shared)) == want


def test_scores_of_all_pairs_shuffle_no_pair(spark, monkeypatch):
    rng = random.Random(7)
    idf = {f"e{e}": rng.choice([0.0, 0.5, 1.25, 2.0]) for e in range(12)}
    held = [(f"e{rng.randrange(13)}", rng.choice([None, *(f"c{c:02d}" for c in range(40))])) for _ in range(200)]  # some twice
    active = {(rng.choice([None, *range(25)]), f"e{rng.randrange(14)}"): round(rng.random(), 2) for _ in range(90)}
    want = {}
    for (q, e), a in active.items():
        for f, c in held:
            if e == f and a * idf.get(e, 0) > 0:
                total, n = want.get((q, c), (0.0, 0))
                want[q, c] = total + a * idf[e], n + 1
    nodes, mentions = spark.createDataFrame(list(idf.items()), "entity_id string, idf double"), spark.createDataFrame(held, "entity_id string, chunk_key string")
    asking = spark.createDataFrame([(*k, a) for k, a in active.items()], "query_id int, entity_id string, activation double")
    for cells, most in ((1 << 22, 20_000), (40, 7)):
        monkeypatch.setattr(graph, "CELLS", cells)
        monkeypatch.setattr(ranking, "BROADCAST_ROWS", most)
        for shared in (1, 2):
            out = graph.chunk_scores(asking, mentions, nodes, shared)
            plan = out._jdf.queryExecution().optimizedPlan().toString()
            assert "Join" not in plan and "Aggregate" not in plan
            got = {(r["query_id"], r["chunk_key"]): (r["graph_score"], r["n_shared"]) for r in out.collect()}
            assert got == {k: (pytest.approx(s, abs=2e-6), n) for k, (s, n) in want.items() if n >= shared}


def test_moves_over_a_file_are_those_of_the_whole_graph(spark, monkeypatch):
    rng = random.Random(9)
    for trial in range(60):
        n = rng.choice([1, 2, 12, 60])
        edges = [(f"n{rng.randrange(n):02d}", f"n{min(n - 1, int(rng.random() ** 2 * n)):02d}", float(rng.choice([0, 1, 1, 1, 2, 7]))) for _ in range(rng.choice([1, 3, 40, 300]))]
        names = sorted({x for e in edges for x in e[:2]})
        at = {x: k for k, x in enumerate(names)}
        rows = sorted([(at[u], at[v], w) for u, v, w in edges] + [(at[v], at[u], w) for u, v, w in edges if u != v])
        block, merged, held = rng.choice([(1, 1, 1), (7, 20, 64), (1 << 19, 1 << 21, 32 << 20)])
        monkeypatch.setattr(communities, "LONG", rng.choice([1, 5, 128]))
        lines, (total, resolution) = communities.Lines(block, held), rng.choice([(None, 1.0), (500.0, 1.0), (None, 2.5)])
        for k in range(0, len(rows), 11):
            lines.append(*map(np.array, zip(*rows[k : k + 11], strict=True)))
        home = communities.stored_moves(lines.close(), resolution, total, merged, held)
        assert {x: names[h] for x, h in zip(names, home, strict=True)} == communities.local_moves(edges, resolution, total)
    edges = [(g, f"{c}{a}", f"{c}{b}", 1) for g in ("x", "y", None) for c in "pq" for a in range(9) for b in range(a, 9) if a // 3 == b // 3 or rng.random() < 0.1]
    df = spark.createDataFrame(edges, "g string, src string, dst string, weight long").repartition(3)
    out = communities.louvain(df, "g")
    assert "FlatMapGroups" not in out._jdf.queryExecution().optimizedPlan().toString()  # no task holds a group's edges
    want = {(g, x): c for g in ("x", "y", None) for x, c in communities.local_moves([(u, v, float(w)) for k, u, v, w in edges if k == g]).items()}
    assert {(r["g"], r["entity_id"]): r["label"] for r in out.collect()} == want and out.count() == len(want)


def test_no_window_over_a_book_holds_its_texts(spark, sf_dir):
    def nodes(plan):
        yield plan
        for k in range(plan.children().size()):
            yield from nodes(plan.children().apply(k))

    windows = [n.output().mkString(",") for n in nodes(QUERIES["heading_flags"](spark, sf_dir)._jdf.queryExecution().optimizedPlan()) if n.nodeName() == "Window"]
    assert windows and not [w for w in windows if "text#" in w or "paragraph#" in w]


WORDS = ["Haus", "wald", "Ab-\nsatz", "été", "ﬁne", "“q”", "x\x07y", "  ", "\t", "\n", "\n\n", "\r\n", "\r", "\n 17 \n", "wort-\nteil", "…", "�", "CHAPTER 3\n\n", "\n\nTHE SCAR\n\n", "\n\nIV\n\n", " ", "CHAPTER I CHAPTER II CHAPTER III", "\x0b"]


def test_books_in_parts_are_those_of_whole_texts(spark):
    rng = random.Random(8)
    texts = {}
    for b in range(14):
        texts[f"b{b}"] = ["".join(rng.choice(WORDS) + rng.choice([" ", " ", ""]) for _ in range(rng.choice([0, 1, 3, 60, 200]))) for _ in range(rng.randrange(1, 9))]
    texts["b1"][0] = " \x0bTitle: Ein Buch\nAuthor:\n\n Jemand\n*** START OF THE PROJECT GUTENBERG EBOOK X *** a " + texts["b1"][0]
    texts["b1"].append("some more text here\n*** END OF THE PROJECT GUTENBERG EBOOK X ***\nlicence")
    texts["b2"] = ["one *** START OF THIS PROJECT GUTENBERG E *** in *** END OF THIS PROJECT GUTENBERG E *** out"]
    texts["b3"] = [" ", "", "\n"]
    texts["b4"].insert(0, "*** END OF THE PROJECT GUTENBERG E ***")
    texts["b4"].append("*** START OF THE PROJECT GUTENBERG E ***")
    parts = spark.createDataFrame([(b, k, x) for b, l in texts.items() for k, x in enumerate(l)], "book_id string, part long, text string").repartition(3)
    books = spark.createDataFrame([(b, "g", f"t {b}") for b in texts], "book_id string, group_id string, title string")
    whole = spark.createDataFrame([(b, "\n\n".join(l)) for b, l in texts.items()], "book_id string, text string").join(books, "book_id")
    report, made = I.ingest(whole, embed(HashEmbedder()))
    report2, made2, cleaned = I.ingest_parts(parts, books, embed(HashEmbedder()))
    columns = ["book_id", "had_frame", "book_title", "author", "meta_language", "original_chars", "cleaned_chars", "control_chars_removed", "special_chars_normalized", "lines_merged", "pagenumber_lines_removed", "nonascii_ratio_after", "dropped_ratio", "before_sample", "after_sample", "warnings", "errors"]
    rows = lambda df, c: sorted(map(str, df.select(c).collect()))
    assert rows(report2, columns) == rows(report, columns)
    columns = ["chunk_key", "group_id", "chapter", "char_start", "char_end", "book_chars", "text", "vector"]
    assert rows(made, columns) == rows(made2, columns) and made.count() > 10
    columns = ["book_id", "chapter", "chunk_index", "text", "char_start", "char_end"]
    assert rows(I.chunk_parts(cleaned, 60, 20), columns) == rows(I.chunk_books(report, 60, 20), columns)


def test_later_rows_are_those_that_reach_the_best(spark, monkeypatch):
    """Small tiles and batches, many ties, null scores, excluded rows and groups: the ranking is that of pairs, and every core has rows."""
    rng = random.Random(12)
    some = lambda: rng.choice([None, [1.0], [float("nan"), 0.0, 0.0], *[[rng.uniform(-1, 1) for _ in range(3)] for _ in range(9)], *[[0.6, 0.8, 0.0]] * 3])
    chunks = spark.createDataFrame([(rng.choice([None, *range(900)]), f"k{n:04d}", rng.choice([None, "a", "b"]), some()) for n in range(700)], "vec_id long, chunk_key string, group_id string, vector array<double>").coalesce(1)
    queries = spark.createDataFrame([(n, some(), rng.choice([None, None, ["a"], ["a", "b"], []])) for n in range(0, 40, 2)], "query_id long, query_vector array<double>, group_ids array<string>")
    rows = lambda df: sorted(map(str, df.select("query_id", "rank", "chunk_key", "score").collect()))
    want = {k: rows(ranking.dense_top_k(chunks, queries, k, on=ranking.F.expr("vec_id <> query_id and (group_ids is null or array_contains(group_ids, group_id))"))) for k in (1, 5, 60)}
    assert ranking.spread(chunks).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    monkeypatch.setattr(ranking, "STRIP", 3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "40")
    try:
        for tile, held in ((4, 1 << 22), (16, 1 << 22), (4, 0)):
            monkeypatch.setattr(ranking, "TILE", tile)
            monkeypatch.setattr(ranking, "HELD", held)
            for k, w in want.items():
                assert w and rows(ranking.dense_top_k(chunks, queries, k, other="vec_id", groups="group_ids")) == w
        # one task, rows from best to worst: what comes after the first batch is not passed on
        monkeypatch.setattr(ranking, "HELD", 1 << 22)
        monkeypatch.setattr(ranking, "spread", lambda df: df.coalesce(1))
        made = []
        monkeypatch.setattr(ranking, "top_k", lambda df, *_, **__: made.append(df.count()) or df)
        line = spark.createDataFrame([(n, f"k{n:04d}", [1.0 - n / 1000]) for n in range(400)], "vec_id long, chunk_key string, vector array<double>").coalesce(1)
        ranking.dense_top_k(line, spark.createDataFrame([(-1, [1.0])], "query_id long, query_vector array<double>"), 5, other="vec_id")
        assert made == [5]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("name", ["rrf_hybrid", "paired_rank_sign_test", "graph_link", "service_answers"])
def test_vectors_are_numbered_once(spark, sf_dir, name):
    assert "label" not in QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["paired_rank_sign_test"])
def test_both_arms_are_of_one_ranking(spark, sf_dir, monkeypatch, name):
    asked, rank = [], ranking.dense_top_k
    monkeypatch.setattr(ranking, "dense_top_k", lambda *a, **b: asked.append(a[2]) or rank(*a, **b))
    assert QUERIES[name](spark, sf_dir).count() == 1 and asked == [16]


def test_every_core_scores_passages_of_a_graph(spark):
    one = lambda rows, kinds: spark.createDataFrame(rows, kinds).coalesce(1)
    active, nodes = one([(1, "e", 0.5)], "query_id int, entity_id string, activation double"), one([("e", 2.0)], "entity_id string, idf double")
    part = [spark.createDataFrame([(1, [("e", 1.0)])], "query_id int, _a array<struct<entity_id: string, _w: double>>").first()]
    lists = one([(f"c{n:02d}", ["e"]) for n in range(40)], "chunk_key string, _e array<string>")
    scored = graph._scored_batches(lists, active.select("query_id"), part, 3, 1)
    assert scored.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    best = graph.top_chunks(active, one([(f"c{n:02d}", "e") for n in range(40)], "chunk_key string, entity_id string"), nodes, 3)
    assert [tuple(r) for r in best.select("rank", "chunk_key", "graph_score").orderBy("rank").collect()] == [(1, "c00", 1.0), (2, "c01", 1.0), (3, "c02", 1.0)]
