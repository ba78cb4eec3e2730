"""Operators on small tables with known results."""

import json
import random

import pytest
from pyspark.sql import functions as F

from folio.config import Settings
from folio.functions import json as J
from folio.functions import text as T
from folio.functions.vectors import cosine, l2_normalize
from folio.models import HashEmbedder, complete, embed, lexical_score, windows
from folio.operators import catalog, communities, evaluation, graph, intervals, ranking
from folio.plans import answer as A
from folio.plans import ingest as I
from folio.sources import files, store
from folio.streaming import events as E


def values(spark, texts, f):
    rows = spark.createDataFrame([(k, x) for k, x in enumerate(texts)], "k int, x string")
    return [r[0] for r in rows.select("k", f(F.col("x")).alias("y")).orderBy("k").select("y").collect()]


# --- functions ----------------------------------------------------------------------------------------------------------------


def test_names_and_slugs(spark):
    names = ["Count Dracula", "Dr. John Seward", "Bistriţa", "Landlord's wife", "The Count", "Mr. Mr. X"]
    assert values(spark, names, T.normalize_name) == ["dracula", "john seward", "bistrita", "landlord wife", "", "x"]
    assert values(spark, ["Härry Pötter!", "", "--"], T.slugify) == ["harry-potter", "gruppe", "gruppe"]


def test_cleaning(spark):
    text = "“Smart” quo­te…\r\nsecond li-\nne here\n  17  \nend\n\n\n\nﬁne  text\x07​"
    assert values(spark, [text], T.clean) == ['"Smart" quo­te... second line here end\n\nfine text']
    row = I.clean_report(spark.createDataFrame([(text,)], "body string")).first()
    assert (row["pagenumber_lines_removed"], row["lines_merged"], row["control_chars_removed"]) == (1, 3, 1)
    assert row["special_chars_normalized"] == 5 and row["warnings"] == []
    assert values(spark, ["a-\nb", "a-\nB", "x\n\n5\n\ny", "Wort-\nöl"], T.clean) == ["ab", "a- B", "x\n\ny", "Wortöl"]


def test_headings_markers_contents(spark):
    assert values(spark, ["CHAPTER I", "Chapters", "Kapitel 3: x", "chapter 1"], T.is_heading) == [True, False, True, False]
    assert values(spark, ["THE SCAR", "WHAM!", "A B", "Bran"], T.is_caps_heading) == [True, False, False, False]
    assert values(spark, ["IV", "- 12", "***", "Page | 19"], T.is_marker) == [True, True, True, False]
    assert values(spark, ["CHAPTER I CHAPTER II CHAPTER III", "CHAPTER I"], T.is_contents) == [True, False]
    assert values(spark, ["THE END OF IV", "Mixed Case"], T.pretty_chapter) == ["The End Of IV", "Mixed Case"]


def test_answers_and_questions(spark):
    assert values(spark, ["a [2] b [1][2] [9] [x]"], lambda c: T.citations(c, 4)) == [[1, 2]]
    assert values(spark, ["Dazu steht in den Quellen nichts. " + "x" * 300 + "[1]", "short", "x" * 300, "fine [1]"], T.is_refusal) == [True, True, False, False]
    assert values(spark, ["Welche Rolle spielt er?", "Wann war das?", "Ist das so?"], T.route) == ["global", "local", None]
    assert values(spark, ["x", "a" * 2001, "ok\x01", "gut"], T.question_errors) == [["too_short"], ["too_long"], ["control_characters"], []]
    assert values(spark, ["7.6B", "137M", "x", None], T.parameter_count) == [7_600_000_000, 137_000_000, None, None]
    assert values(spark, ["Eins. Zwei! Drei"], T.sentences) == [["Eins.", "Zwei!", "Drei"]]
    row = spark.range(1).select(T.position_percent(F.lit(50), F.lit(80)).alias("a"), T.position_percent(F.lit(5), F.lit(0)).alias("b"), T.position_percent(F.lit(500), F.lit(80)).alias("c")).first()
    assert (row["a"], row["b"], row["c"]) == (62, None, 100)


def test_model_output(spark):
    good = '```json\n{"entities":[{"name":" Ann  Lee ","type":"character","desc":"d"},{"name":"ann lee","type":"place"},{"name":"Rome","type":"geo"}],"relations":[{"source":"Ann Lee","target":"rome","rel":"in"},{"source":"Ann Lee","target":"Bob","rel":"x"},{"source":"Rome","target":"ROME"}]}\n```'
    cut = '{"entities":[{"name":"A","type":"PERSON","desc":""},{"name":"B","type":"odd","desc":""},{"name":"C","ty'
    many = json.dumps({"entities": [{"name": f"N{k}", "type": "PERSON"} for k in range(12)], "relations": []})
    rows = spark.createDataFrame([(k, r) for k, r in enumerate([good, cut, "no object", many, "text " + many + " more"])], "k int, raw string")
    got = {r["k"]: r["extraction"] for r in J.parse_extractions(rows).collect()}
    assert [(e["name"], e["type"]) for e in got[0]["entities"]] == [("Ann Lee", "PERSON"), ("Rome", "PLACE")] and len(got[0]["relations"]) == 1
    assert got[1]["truncated"] and [e["type"] for e in got[1]["entities"]] == ["PERSON", "OTHER"]
    assert got[2]["error"] and not got[2]["entities"] and len(got[3]["entities"]) == len(got[4]["entities"]) == 8
    assert values(spark, ['{"relevant": [2, 1, 2, 9, "3"]}', '{"relevant": 3}', "x"], lambda c: J.grade(c, F.lit(4))) == [[2, 1, 3], None, None]
    points = values(spark, ['{"points":[{"description":" a  b ","score":"130"},{"description":"","score":3},{"description":"c"}]}'], J.map_points)[0]
    assert [(p["description"], p["score"]) for p in points] == [("a b", 100), ("c", 0)]
    report = values(spark, ['x {"title":"T","summary":"S","findings":["one",{"summary":"two","explanation":"e"},{}]} y', '{"title":"T"}'], J.report)
    assert report[1] is None and [(f["summary"], f["explanation"]) for f in report[0]["findings"]] == [("one", ""), ("two", "e")]
    assert values(spark, ['{"title":"T","summary":"S","findings":["one"]}'], lambda c: J.report_text(J.report(c))) == ["T\n\nS\n\nKey findings:\n- one"]


def test_vectors(spark):
    row = spark.range(1).select(l2_normalize(F.array(F.lit(3.0), F.lit(4.0))).alias("u"), l2_normalize(F.array(F.lit(0.0), F.lit(0.0))).alias("z"), cosine(F.array(F.lit(1.0)), F.array(F.lit(-2.0))).alias("c")).first()
    assert row["u"] == [0.6, 0.8] and row["z"] == [0.0, 0.0] and row["c"] == -1.0


def test_windows_cover_the_end(spark):
    got = spark.range(1).select(windows(F.sequence(F.lit(1), F.lit(1300))).alias("w"), windows(F.sequence(F.lit(1), F.lit(100))).alias("one")).first()
    assert got["w"][0] == list(range(1, 381)) and got["w"][1][0] == 191 and got["w"][-1][-1] == 1300 and len(got["one"]) == 1


# --- ranking ------------------------------------------------------------------------------------------------------------------

HIT = "query_id int, rank int, book_id string, char_start long, char_end long, chunk_key string"


def ranked(spark, hits):
    return spark.createDataFrame([(1, k + 1, b, s, e, f"{b}:{s}") for k, (b, s, e) in enumerate(hits)], HIT)


def test_dedup_overlaps(spark):
    hits = ranked(spark, [("a", 0, 10), ("a", 5, 15), ("b", 5, 15), ("a", 10, 20), ("a", None, None), ("a", None, None)])
    keys = lambda df: [(r["rank"], r["book_id"], r["char_start"]) for r in df.orderBy("rank").collect()]
    assert keys(ranking.dedup_overlaps(hits, 3)) == [(1, "a", 0), (2, "b", 5), (3, "a", 10)]
    assert len(keys(ranking.dedup_overlaps(hits, 0))) == 5


def test_expand_and_merge(spark):
    text = "abcdefghijklmnopqrstuvwxyz"
    cut = [(0, 0, 6), (1, 4, 10), (2, 8, 14), (3, 16, 20)]
    chunks = spark.createDataFrame([("a", i, s, e, text[s:e], f"a:{i}") for i, s, e in cut], "book_id string, chunk_index int, char_start long, char_end long, text string, chunk_key string")
    hits = chunks.where("chunk_index in (1, 2, 3)").withColumn("query_id", F.lit(1)).withColumn("rank", F.element_at(F.array(F.lit(1), F.lit(2), F.lit(3)), F.col("chunk_index")))
    got = [(r["chunk_key"], r["text"], r["expanded"]) for r in ranking.expand(hits, chunks, 1, 1).orderBy("rank").collect()]
    assert got == [("a:1", text[0:14], True), ("a:3", text[16:20], False)]
    last = ranking.expand(hits.where("chunk_index = 3").withColumn("rank", F.lit(1)), chunks, 1, 3).first()
    assert last["text"] == text[8:14] + ranking.GAP + text[16:20] and last["char_start"] == 8
    assert not any(r["expanded"] for r in ranking.expand(hits, chunks, 0, 3).collect())


def test_interleave_and_fusion(spark):
    lists = [spark.createDataFrame([(1, r + 1, k) for r, k in enumerate(x)], "query_id int, rank int, chunk_key string") for x in (["1", "2", "3"], ["1", "7", "8"])]
    assert [r["chunk_key"] for r in ranking.interleave(lists).orderBy("rank").limit(4).collect()] == ["1", "2", "7", "3"]
    fused = [(r["chunk_key"], r["score"]) for r in ranking.rrf(lists, 3).orderBy("rank").collect()]
    assert fused[0] == ("1", round(2 / 61, 6)) and [k for k, _ in fused[1:]] == ["2", "7"]


def test_group_filter(spark):
    df = spark.createDataFrame([("a",), ("b",)], "group_id string")
    assert ranking.group_filter(df, "a", ["b"]).first()[0] == "b" and ranking.group_filter(df, "a", []).first()[0] == "a" and ranking.group_filter(df).count() == 2


def test_large_query_sets_travel_in_blocks(spark, monkeypatch):
    v = lambda k: [float(k % 3), 1.0, float(k % 5)]
    chunks = spark.createDataFrame([(f"c{k}", v(k)) for k in range(20)], "chunk_key string, vector array<double>")
    queries = spark.createDataFrame([(k, v(k)) for k in range(12)], "query_id int, query_vector array<double>")
    want = {(r["query_id"], r["rank"]): r["chunk_key"] for r in ranking.dense_top_k(chunks, queries, 3).collect()}
    monkeypatch.setattr(ranking, "BROADCAST_ROWS", 5)
    monkeypatch.setattr(ranking, "small", lambda df, rows=5: df.limit(6).count() <= 5)
    assert {(r["query_id"], r["rank"]): r["chunk_key"] for r in ranking.dense_top_k(chunks, queries, 3).collect()} == want


# --- ranges -------------------------------------------------------------------------------------------------------------------


def test_ranges_against_brute_force(spark):
    rng = random.Random(2)
    make = lambda n: [(rng.choice("ab"), s, s + rng.randrange(1, 40), k) for k in range(n) for s in [rng.randrange(200)]]
    left, right = make(40), make(30)
    a = spark.createDataFrame(left, "b string, char_start long, char_end long, i int")
    r = spark.createDataFrame(right, "b string, span_start long, span_end long, j int")
    got = sorted((x["i"], x["j"]) for x in intervals.overlap_join(a, r, "b", 15).collect())
    assert got == sorted((x[3], y[3]) for x in left for y in right if x[0] == y[0] and x[1] < y[2] and y[1] < x[2])
    merged = sorted((x["b"], x["char_start"], x["char_end"]) for x in intervals.merge_spans(a, "b").collect())
    want = []
    for b, s, e, _ in sorted(left):
        if want and want[-1][0] == b and s <= want[-1][2]:
            want[-1] = (b, want[-1][1], max(e, want[-1][2]))
        else:
            want.append((b, s, e))
    assert merged == want


def test_as_of(spark):
    rows = spark.createDataFrame([("x", 0), ("x", 5), ("x", 9), ("y", 3)], "book string, at long")
    marks = spark.createDataFrame([("x", 5, "one"), ("x", 7, "two")], "book string, offset long, title string")
    got = {(r["book"], r["at"]): r["chapter"] for r in intervals.as_of(rows, marks, "book", "at", "offset", "title", "chapter").collect()}
    assert got == {("x", 0): None, ("x", 5): "one", ("x", 9): "two", ("y", 3): None}


# --- graph --------------------------------------------------------------------------------------------------------------------


def rows_of_four(spark):
    e = lambda name, kind="PERSON", desc="": (name, kind, desc)
    rows = [
        ("b1:0", "b1", [e("Count Dracula", desc="vampire"), e("Lucy")], [("Count Dracula", "Lucy", "bites")], None),
        ("b1:1", "b1", [e("Dracula"), e("Lucy Westenra"), e("wolves", "OBJECT")], [("Dracula", "Lucy Westenra", "knows"), ("Dracula", "wolves", "commands")], None),
        ("b1:2", "b1", [e("Dracula"), e("Whitby", "PLACE")], [("Dracula", "Whitby", "arrives"), ("Dracula", "Nobody", "x")], None),
        ("b1:3", "b1", [e("Dracula"), e("The Count")], [], "bad"),
    ]
    return spark.createDataFrame(rows, "key string, book_id string, entities array<struct<name:string,type:string,desc:string>>, relations array<struct<source:string,target:string,rel:string>>, error string")


def test_graph_of_four_chunks(spark):
    g = graph.build(rows_of_four(spark), 4)
    nodes = {r["entity_id"]: r for r in g.nodes.collect()}
    assert set(nodes) == {"PERSON:dracula", "PERSON:lucy westenra", "PLACE:whitby"}
    assert nodes["PERSON:dracula"]["idf"] == 0.0 and nodes["PLACE:whitby"]["idf"] == 1.3863
    assert nodes["PERSON:dracula"]["name"] == "Dracula" and nodes["PERSON:dracula"]["aliases"] == ["Count Dracula"] and nodes["PERSON:dracula"]["desc"] == "vampire"
    edges = {(r["src"], r["dst"]): r for r in g.edges.collect()}
    assert edges["PERSON:dracula", "PERSON:lucy westenra"]["weight"] == 2 and [x["rel"] for x in edges["PERSON:dracula", "PERSON:lucy westenra"]["rels"]] == ["bites", "knows"]
    assert graph.stats(g).first().asDict() == {"n_nodes": 3, "n_edges": 2, "isolated": 0, "chunks_with_entities": 4}
    linked = spark.createDataFrame([(1, "PLACE:whitby", 0.9)], "query_id int, entity_id string, score double")
    act = graph.hop_activations(linked, g.edges)
    assert {r["entity_id"]: r["activation"] for r in act.collect()} == {"PLACE:whitby": 0.9, "PERSON:dracula": 0.45}
    scores = {r["chunk_key"]: r["graph_score"] for r in graph.chunk_scores(act, g.mentions, g.nodes).collect()}
    assert scores == {"b1:2": pytest.approx(0.9 * 1.3863, abs=1e-5)}
    both = graph.union({"g1": g, "g2": g})
    assert both.nodes.count() == 6 and both.edges.where("src like 'g1/%'").count() == 2


def test_alias_rules(spark):
    keys = ["PERSON:lucy", "PERSON:lucy westenra", "PERSON:van helsing", "PERSON:abraham van helsing", "PERSON:harker", "PERSON:jonathan harker", "PERSON:mina harker", "PLACE:whitby", "PLACE:whitby harbour"]
    merges, ambiguous = graph.merge_aliases(spark.createDataFrame([(k,) for k in keys], "entity_id string"))
    assert {r["entity_id"]: r["target"] for r in merges.collect()} == {"PERSON:lucy": "PERSON:lucy westenra", "PERSON:van helsing": "PERSON:abraham van helsing"}
    assert [(r["entity_id"], r["candidates"]) for r in ambiguous.collect()] == [("PERSON:harker", ["PERSON:jonathan harker", "PERSON:mina harker"])]
    chain, _ = graph.merge_aliases(spark.createDataFrame([("PERSON:a b",), ("PERSON:a b c",), ("PERSON:a b c d",)], "entity_id string"))
    assert {r["entity_id"]: r["target"] for r in chain.collect()} == {"PERSON:a b c": "PERSON:a b c d"}


def test_links_seeds_and_fusion(spark):
    scores = spark.createDataFrame([(1, f"e{k}", s) for k, s in enumerate([0.9, 0.5, 0.44, 0.6])], "query_id int, entity_id string, score double")
    assert [r["entity_id"] for r in graph.link_entities(scores).orderBy("rank").collect()] == ["e0", "e3", "e1"]
    hit = lambda i, s: (1, f"b:{i}", "b", i, 100 * i, 100 * i + 90, s)
    columns = "query_id int, chunk_key string, book_id string, chunk_index int, char_start long, char_end long, score double"
    dense = spark.createDataFrame([hit(0, 0.80), hit(1, 0.78), hit(3, 0.70)], columns).withColumn("rank", F.when(F.col("chunk_index") == 0, 1).when(F.col("chunk_index") == 1, 2).otherwise(3))
    every = dense.drop("rank").unionByName(spark.createDataFrame([hit(2, 0.69)], columns))
    g = spark.createDataFrame([(1, "b:2", 2.0)], "query_id int, chunk_key string, graph_score double")
    order = lambda alpha, k: [r["chunk_index"] for r in graph.fuse(dense, g, every, k, graph.GraphParams(alpha=alpha)).orderBy("rank").collect()]
    assert order(0.10, 2) == [0, 2] and order(0.0, 3) == [0, 1, 3]
    mentions = spark.createDataFrame([("x", "b:0"), ("y", "b:0"), ("x", "b:1")], "entity_id string, chunk_key string")
    nodes = spark.createDataFrame([("x", "X", 1.0), ("y", "Y", 0.5)], "entity_id string, name string, idf double")
    seeds = graph.seeds_from_dense(dense, mentions, nodes)
    assert {r["entity_id"]: r["activation"] for r in seeds.collect()} == {"x": 1.5, "y": 1.0}
    assert {r["chunk_key"]: r["graph_entities"] for r in graph.annotate(dense, seeds, mentions, nodes).collect()} == {"b:0": ["X", "Y"], "b:1": ["X"], "b:3": []}


def cliques():
    edges = [(f"{c}{i}", f"{c}{j}", 3) for c in "AB" for i in range(4) for j in range(i + 1, 4)] + [("A0", "B0", 1), ("A1", "Rare", 1)]
    nodes = [(f"{c}{i}", 3) for c in "AB" for i in range(4)] + [("Rare", 1)]
    return nodes, edges


def test_two_cliques(spark):
    nodes, edges = cliques()
    n, e = spark.createDataFrame(nodes, "entity_id string, n_mentions int"), spark.createDataFrame(edges, "src string, dst string, weight int")
    pruned, kept = communities.prune(n, e)
    assert pruned.count() == 8 and kept.count() == 13
    members, rest = communities.communities(n, e)
    got = {r["entity_id"]: r["community"] for r in members.collect()}
    assert rest.count() == 0 and {got[f"A{i}"] for i in range(4)} == {"c000"} and {got[f"B{i}"] for i in range(4)} == {"c001"}
    assert sum(r["modularity"] for r in communities.modularity_terms(kept, members).collect()) > 0.3
    assert communities.local_moves([(u, v, float(w)) for u, v, w in edges]) == communities.local_moves([(u, v, float(w)) for u, v, w in reversed(edges)])


def test_global_points(spark):
    reports = spark.createDataFrame([("c0", "R0", ["k1", "k2", "k3"]), ("c1", "R1", ["k2", "k4"])], "community string, text string, chunk_keys array<string>")
    chunks = spark.createDataFrame([(f"k{i}", f"t{i}") for i in range(5)], "chunk_key string, text string")
    chosen = spark.createDataFrame([(1, "c0", 0.5, 1), (1, "c1", 0.9, 2)], "query_id int, community string, score double, rank int")
    text = lambda df: [r["text"] for r in df.orderBy("marker").collect()]
    assert text(communities.global_points(chosen, reports, chunks)) == ["R0", "t1", "t2", "R1", "t4"]
    mapped = chosen.withColumn("score", F.when(F.col("community") == "c0", 10).otherwise(80))
    assert text(communities.global_points(mapped, reports, chunks, least=20)) == ["R1", "t2", "t4"]
    row = spark.range(1).select(communities.map_scores(F.array().cast("array<struct<score:int>>"), F.lit(0.456)).alias("a"), communities.map_scores(F.array(F.struct(F.lit(7).alias("score")), F.struct(F.lit(9).alias("score"))), F.lit(0.4)).alias("b")).first()
    assert (row["a"], row["b"]) == (46, 9)


# --- evaluation ---------------------------------------------------------------------------------------------------------------


def test_statistics(spark):
    p = [r[0] for r in spark.createDataFrame([(0, 0), (3, 4), (8, 0), (10, 2)], "b int, w int").select(evaluation.sign_test(F.col("b"), F.col("w"))).collect()]
    assert p == [1.0, 1.0, pytest.approx(2 / 256), pytest.approx(2 * 79 / 4096)]
    many = spark.createDataFrame([(2000, 1500)], "b int, w int").select(evaluation.sign_test(F.col("b"), F.col("w"))).first()[0]
    assert 0 < many < 1e-15
    row = spark.createDataFrame([(x,) for x in [5.0, 1.0, 3.0, 2.0, None]], "x double").agg(evaluation.upper_median("x").alias("m"), evaluation.percentile("x", 0.5).alias("p"), evaluation.distinct_with_null("x").alias("d")).first()
    assert (row["m"], row["p"], row["d"]) == (3.0, 2.5, 5)
    k = evaluation.kappa(spark.createDataFrame([(True, True)] * 4 + [(False, False)] * 4 + [(True, False)] * 2, "a boolean, b boolean"), "a", "b").first()
    assert (k["agreement"], k["kappa"]) == (0.8, 0.615385)
    assert evaluation.kappa(spark.createDataFrame([(True, True)], "a boolean, b boolean"), "a", "b").first()["kappa"] == 1.0


def test_answer_metrics(spark):
    rows = spark.createDataFrame([("the cat sat", "The cat, sat!"), ("a b c", "c b a"), ("", "x"), ("the the cat", "the cat")], "p string, g string")
    got = [(r[0], r[1]) for r in rows.select(evaluation.token_f1(T.answer_tokens(F.col("p")), T.answer_tokens(F.col("g"))), evaluation.rouge_l("p", "g")).collect()]
    assert got == [(1.0, 1.0), (1.0, pytest.approx(1 / 3)), (0.0, 0.0), (0.8, pytest.approx(0.8))]
    rate = values(spark, ["A long sentence here [1]. And another one without it. Short.", "Hm."], evaluation.citation_rate)
    assert rate == [0.5, None]
    v = spark.createDataFrame([(0.2, 7, 0.6, 0.6, 0.0, 1.0), (0.2, 7, 0.6, 0.6, 0.5, 1.0), (-0.1, 0, 0.6, 0.6, 0.0, 1.0), (0.1, 7, 0.6, 0.6, None, None)], "g double, b int, f double, fb double, lo double, hi double")
    assert [r[0] for r in v.select(evaluation.verdict(*map(F.col, ["g", "b", "f", "fb", "lo", "hi"]))).collect()] == ["POSITIVE", "UNCALIBRATED", "NEGATIVE", "MIXED"]


# --- catalog, sources -----------------------------------------------------------------------------------------------------------


def test_catalog_changes(spark):
    groups = spark.createDataFrame([(1, "a", "A"), (2, "b", "B")], "id long, slug string, name string")
    coll = spark.createDataFrame([(1, "all", "All")], "id long, slug string, name string")
    members = spark.createDataFrame([(1, 1, 1), (2, 1, 2)], "id long, collection_id long, group_id long")
    new = spark.createDataFrame([("All", None), ("B2", "b"), (" ", None), ("New", "new")], "name string, slug string")
    made, refused = catalog.create_group(groups, coll, new)
    assert {r["slug"] for r in made.collect()} == {"a", "b", "all-2", "new"} and {r["error"] for r in refused.collect()} == {"conflict", "invalid"}
    c2, m2 = catalog.create_collection("All", ["a"], groups, coll, members)
    assert {r["slug"] for r in c2.collect()} == {"all", "all-2"} and m2.count() == 3
    with pytest.raises(ValueError, match="nope"):
        catalog.create_collection("X", ["nope"], groups, coll, members)
    asked = spark.createDataFrame([("all",), ("a",), ("zzz",)], "slug string")
    assert {r["slug"]: r["group_ids"] for r in catalog.expand_slugs(asked, groups, coll, members).collect()} == {"all": ["a", "b"], "a": ["a"], "zzz": ["zzz"]}
    left = catalog.delete_collections(spark.createDataFrame([("all",)], "slug string"), coll, members)
    assert left["collections"].count() == 0 and left["members"].count() == 0
    conv = spark.createDataFrame([("1", "old", None)], "id string, title string, group_id string").withColumn("created_at", F.lit("2020-01-01").cast("timestamp_ntz")).withColumn("updated_at", F.col("created_at"))
    got = {r["id"]: r for r in catalog.ensure_conversations(conv, spark.createDataFrame([("1", "again", "g"), ("2", "q" * 100, "g")], "id string, question string, group_id string"), F.lit("2021-01-01").cast("timestamp_ntz")).collect()}
    assert got["1"]["title"] == "old" and got["1"]["updated_at"].year == 2021 and got["2"]["title"] == "q" * 80
    models = spark.createDataFrame([("m", ["completion"], 0), ("M", None, 1), ("e", ["embedding"], 2)], "name string, capabilities array<string>, place int")
    assert catalog.chat_models(models).count() == 2
    assert {r["wanted"]: r["model"] for r in catalog.default_model(spark.createDataFrame([("M",), ("q",)], "wanted string"), models, "d").collect()} == {"M": "m", "q": "d"}
    labels = catalog.conversation_labels(spark.createDataFrame([("x", "a"), ("y", "gone"), ("z", None)], "id string, group_id string"), groups, coll, "?")
    assert {r["id"]: r["label"] for r in labels.collect()} == {"x": "A", "y": "gone", "z": "?"}


def test_chunk_store(spark, tmp_path):
    s = store.ChunkStore(spark, str(tmp_path / "chunks"))
    point = lambda key, group, text: (key, text, key.rpartition(":")[0], group, int(key.rpartition(":")[2]), [1.0, 2.0])
    rows = lambda *p: spark.createDataFrame(list(p), "chunk_key string, text string, book_id string, group_id string, chunk_index int, vector array<float>")
    assert not s.exists()
    assert s.upsert(rows(point("a:0", "g", "x"), point("a:1", "g", "y"), point("b:0", "h", "z"))) == 3
    s.upsert(rows(point("a:1", "g", "new")))
    assert {r["chunk_key"]: r["text"] for r in s.scan().collect()} == {"a:0": "x", "a:1": "new", "b:0": "z"}
    assert s.scan("h").count() == 1 and "vector" not in s.scan().columns
    s.set_payload(spark.createDataFrame([("a:0", "IV")], "chunk_key string, chapter string"))
    assert {r["chunk_key"]: r["chapter"] for r in s.scan().collect()} == {"a:0": "IV", "a:1": None, "b:0": None}
    assert s.fetch(spark.createDataFrame([("a:0",), ("zz:9",)], "chunk_key string")).count() == 1
    s.delete_book("b")
    assert {r["chunk_key"] for r in s.scan().collect()} == {"a:0", "a:1"}
    book, index = store.split_key(F.lit("a:b:7"))
    assert spark.range(1).select(book.alias("b"), index.alias("i")).first() == ("a:b", 7)
    ids = spark.createDataFrame([("a:0",)], "k string").select(store.point_ids("6ba7b810-9dad-11d1-80b4-00c04fd430c8")("k")).first()[0]
    assert ids.count("-") == 4 and ids[14] == "5"


def test_files(spark, tmp_path):
    (tmp_path / "book one.txt").write_bytes("grün".encode())
    got = files.read_texts(spark, str(tmp_path / "*.txt")).first()
    assert got["text"] == "grün" and got["title"] == "book one" and len(got["file_hash"]) == 64
    (tmp_path / "c.jsonl").write_text('{"key":"a","n":1}\n\n{"key":"b","n":2}\nbroken\n{"key":"a","n":3}\n')
    assert {r["key"]: r["n"] for r in files.read_checkpoint(spark, str(tmp_path / "c.jsonl"), "key string, n int", "key").collect()} == {"a": 3, "b": 2}
    assert files.read_jsonl(spark, str(tmp_path / "c.jsonl"), "key string, n int").count() == 3
    df = spark.createDataFrame([(1, "x")], "a int, b string")
    files.write_csv(df, str(tmp_path / "out"))
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).first()["b"] == "x"
    for n in (1, 2):
        files.replace_table(spark.range(n), str(tmp_path / "t"), str(tmp_path / "t.new"))
        assert spark.read.parquet(str(tmp_path / "t")).count() == n
    lines = [(1, k, x) for k, x in enumerate(['data: {"choices":[{"delta":{"content":"He"}}]}', ": ping", "data: {bad", 'data: {"choices":[],"usage":{"prompt_tokens":3,"completion_tokens":4}}', "data: [DONE]", 'data: {"choices":[{"delta":{"content":"late"}}]}'])]
    got = files.sse_deltas(spark.createDataFrame(lines, "stream_id int, seq int, line string")).orderBy("seq").collect()
    assert [(r["delta"], r["usage"] and r["usage"]["completion_tokens"]) for r in got] == [("He", None), (None, 4)]
    blocks = values(spark, ["event: token\ndata: {}\n\nevent: done\ndata: 1\n\nevent: par"], files.sse_blocks)[0]
    assert [(b["event"], b["data"]) for b in blocks] == [("token", "{}"), ("done", "1")]


# --- whole jobs ---------------------------------------------------------------------------------------------------------------


def book(headings=True):
    parts = []
    for c in range(3):
        parts.append(f"CHAPTER {c + 1}" if headings else f"TITLE NUMBER {'ABC'[c]}")
        parts += [f"Chapter {c} paragraph {k} " + "word " * (20 + 7 * k) + "end." for k in range(12)]
    return "\n\n".join(parts)


def test_chunks_are_pieces_of_the_text(spark):
    books = spark.createDataFrame([("b1", T_clean(book())), ("b2", "No heading here.\n\n" + "A paragraph. " * 30)], "book_id string, cleaned string")
    got = I.chunk_books(books, 600, 100).orderBy("book_id", "chunk_index").collect()
    one = [r for r in got if r["book_id"] == "b1"]
    text = T_clean(book())
    assert [r["chunk_index"] for r in one] == list(range(len(one))) and {r["chapter"] for r in one} == {"CHAPTER 1", "CHAPTER 2", "CHAPTER 3"}
    assert all(r["text"] == text[r["char_start"] : r["char_end"]] and "CHAPTER" not in r["text"] for r in one)
    for a, b in zip(one, one[1:]):
        if a["chapter"] == b["chapter"]:
            assert a["char_start"] < b["char_start"] < a["char_end"]
    assert [r["chapter"] for r in got if r["book_id"] == "b2"] == [None]


def T_clean(text):
    return "\n\n".join(" ".join(p.split()) for p in text.split("\n\n"))


def test_caps_headings_only_after_markers(spark):
    paras = ["I", "THE RIDDLE HOUSE", "Text of the first part.", "WHAM", "More text."] + ["Page | 19 Foot", "Some text."] * 5 + ["Page | 20 Foot", "THE SCAR", "End."]
    df = I.paragraphs(spark.createDataFrame([("b", "\n\n".join(paras))], "book_id string, cleaned string"))
    got = [r["paragraph"] for r in I.heading_flags(df).where("heading").orderBy("para").collect()]
    assert got == ["THE RIDDLE HOUSE", "THE SCAR"]


def test_ingest_report_and_backfill(spark, tmp_path):
    framed = "Title: My Book\nAuthor: Me\n*** START OF THE PROJECT GUTENBERG EBOOK X ***\n" + book() + "\n*** END OF THE PROJECT GUTENBERG EBOOK X ***\ntail"
    texts = spark.createDataFrame([("b1", "g", "file", framed), ("b2", "g", "short", "too short")], "book_id string, group_id string, title string, text string")
    s = store.ChunkStore(spark, str(tmp_path / "store"))
    report, points = I.ingest(texts, embed(HashEmbedder(16)), s)
    rows = {r["book_id"]: r for r in report.collect()}
    assert rows["b1"]["book_title"] == "My Book" and rows["b1"]["had_frame"] and rows["b2"]["errors"] == ["too_short"] and rows["b2"]["book_title"] == "short"
    stored = s.scan(vectors=True)
    assert stored.count() == points.count() > 3 and all(abs(sum(x * x for x in r["vector"]) - 1) < 1e-5 for r in stored.collect())
    again, _ = I.ingest(texts, embed(HashEmbedder(16)), s)
    stored = s.scan(vectors=True)
    assert stored.count() == points.count()
    whole = report.where("book_id = 'b1'").select("book_id", "cleaned")
    fixed = I.backfill_chapters(stored.withColumn("chapter", F.lit(None).cast("string")), whole)
    assert {r["chunk_key"]: r["chapter"] for r in fixed.collect()} == {r["chunk_key"]: r["chapter"] for r in stored.collect()}
    with pytest.raises(ValueError, match="differ"):
        I.backfill_chapters(stored.withColumn("text", F.lit("x")), whole)
    assert I.ingest(texts, embed(HashEmbedder(16)), dry_run=True)[1].count() == 0


def test_prompts_citations_faithfulness(spark):
    hits = spark.createDataFrame([(1, 1, "the red fox ran", 0.51239), (1, 2, "a blue whale", 0.4)], "query_id int, rank int, text string, score double")
    history = A.history_turns(spark.createDataFrame([(1, k, "assistant" if k % 2 else "user", f"t{k} [1]") for k in range(6)], "query_id int, turn int, role string, content string"))
    row = A.build_messages(spark.createDataFrame([(1, "Who ran?")], "query_id int, question string"), A.context_blocks(hits), history, "SYS", "Answer.").first()
    assert [m["role"] for m in row["messages"]] == ["system", "user", "assistant", "user", "assistant", "user"] and row["messages"][2]["content"] == "t3" and row["messages"][1]["content"] == "t2 [1]"
    assert "[1] the red fox ran\n\n[2] a blue whale" in row["messages"][-1]["content"]
    answers = spark.createDataFrame([(1, "The red fox ran [1]. Nothing here at all [2]. See [7].")], "query_id int, answer string")
    sources = A.faithfulness(A.cited_sources(answers, hits), answers, lexical_score)
    assert {r["marker"]: (r["supported"], r["score"]) for r in sources.collect()} == {1: (True, 0.5124), 2: (False, 0.4)}
    assert A.answer_faithfulness(answers, hits, lexical_score).first()["faithfulness"] == 0.5


def crag(spark, grades, settings=None, queries=("q",)):
    texts = {"q": [0, 1, 2], "new": [3, 1]}

    def search(q):
        hit = F.posexplode(F.when(F.col("query") == "q", F.array(*map(F.lit, texts["q"]))).otherwise(F.array(*map(F.lit, texts["new"]))))
        out = q.select("query_id", hit.alias("p", "i"))
        return out.select("query_id", (F.col("p") + 1).alias("rank"), F.concat(F.lit("b:"), "i").alias("chunk_key"), F.lit("b").alias("book_id"), (1000 * F.col("i")).cast("long").alias("char_start"), (1000 * F.col("i") + 500).cast("long").alias("char_end"), F.concat(F.lit("text "), "i").alias("text"), (1.0 - 0.1 * F.col("p")).alias("score"))

    grader = lambda question, passages: F.when(passages.contains("text 0"), F.lit(grades[0])).otherwise(F.lit(grades[1]))
    rewriter = complete(lambda s: s.map(lambda _: '"new"\nmore'))
    return A.corrective_retrieval(spark.createDataFrame([(1, "q")], "query_id int, question string"), search, grader, rewriter, settings or Settings(top_k=4)).first()


def test_corrective_loop(spark):
    keys = lambda r: [c["chunk_key"] for c in r["context"] or []]
    enough = crag(spark, ['{"relevant":[1,3]}', "-"])
    assert (enough["decision"], enough["attempts"], keys(enough)) == ("generate", 1, ["b:0", "b:1", "b:2"])
    none = crag(spark, ['{"relevant":[]}', '{"relevant":[]}'])
    assert (none["decision"], none["attempts"], none["queries"]) == ("refuse", 2, ["q", 'new"']) and none["context"] is None
    retry = crag(spark, ['{"relevant":[1]}', '{"relevant":[1]}'])
    assert (retry["decision"], retry["n_relevant"], keys(retry)) == ("generate", 2, ["b:0", "b:3", "b:1", "b:2"])
    filtered = crag(spark, ['{"relevant":[1]}', '{"relevant":[1]}'], Settings(top_k=4, crag_strategy="filter"))
    assert keys(filtered) == ["b:0", "b:3"]
    broken = crag(spark, ["not json", "-"])
    assert (broken["decision"], broken["n_relevant"]) == ("generate", 3)


def test_after_check(spark):
    s = Settings()
    rows = spark.createDataFrame([(0, 0, 0), (4, 3, 0), (4, 2, 0), (4, 4, 1)], "n int, u int, r int")
    assert [r[0] for r in rows.select(A.after_check(F.col("n"), F.col("u"), F.col("r"), s)).collect()] == ["end", "generate", "end", "end"]


def test_events_and_streams(spark, tmp_path):
    ev = [(1, 1, "token", "bad"), (1, 2, "reset", ""), (1, 3, "token", "Hel"), (1, 4, "token", "lo"), (1, 5, "done", ""), (2, 1, "error", "x")]
    rows = spark.createDataFrame(ev, "query_id int, seq long, event string, payload string").withColumn("ts", F.timestamp_seconds(F.col("seq")))
    got = {r["query_id"]: r for r in E.answers(rows).collect()}
    assert got[1]["answer"] == "Hello" and got[1]["first_token_ts"].second == 3 and got[1]["done"] and got[2]["failed"] and got[2]["answer"] == ""
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([("a", 1), ("a", 1), ("b", 2)], "key string, n int").write.json(src)
    schema = "key string, n int"
    spark.createDataFrame([], schema).write.parquet(out)
    run = lambda: E.incremental(spark.readStream.schema(schema).json(src), lambda d: d, lambda: spark.read.schema(schema).parquet(out), lambda d: d.write.mode("append").parquet(out), "key", str(tmp_path / "ck")).awaitTermination()
    run()
    spark.createDataFrame([("b", 2), ("c", 3)], schema).write.mode("append").json(src)
    run()
    assert sorted(r["key"] for r in spark.read.parquet(out).collect()) == ["a", "b", "c"]
    (tmp_path / "ev").mkdir()
    live = spark.readStream.schema("ts timestamp, kind string, value double").json(str(tmp_path / "ev"))
    stream = E.windowed(live, "kind", "10 minutes", "5 minutes", "1 minute")
    assert stream.isStreaming and "window_start" in stream.columns
