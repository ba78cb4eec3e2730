"""Whole plans against plain loops: graph retrieval, checked answers, extraction and reports with a second try, files of graphs, and queries that SQL does not cover."""

import json
import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from folio.config import Settings
from folio.operators import communities, evaluation, graph
from folio.plans import generation as G
from folio.plans import ingest as I
from folio.plans import queries as Q
from folio.plans import retrieval as R
from folio.sources import files
from tests_plain import plain_ranges


def _deduped(hits, k):
    kept = []
    for h in hits:
        if len(kept) < k and not any(h["book"] == x["book"] and h["a"] < x["b"] and x["a"] < h["b"] for x in kept):
            kept.append(h)
    return kept


@pytest.fixture(scope="module")
def plain_graph(spark, sf_dir):
    rows = sorted(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label").collect())
    place, out = Counter(), {}
    for r in rows:
        v, i = np.array(r["embedding"], float), place[r["label"]]
        place[r["label"]] += 1
        out[r["vec_id"]] = {"key": f"b{r['label']}:{i}", "book": r["label"], "a": 1600 * i, "b": 1600 * i + 1800, "v": v / np.linalg.norm(v), "ents": (f"e{r['vec_id'] % 17}", f"f{r['vec_id'] % 23}")}
    return out


@pytest.mark.parametrize("mode", ["link", "expand", "graph_only"])
def test_graph_retrieval_against_loops(spark, sf_dir, plain_graph, mode):
    chunks, p = plain_graph, graph.GraphParams(min_sim=0.1)
    mentions, weight = defaultdict(list), Counter()
    for k, c in chunks.items():
        weight[tuple(sorted(c["ents"]))] += 1
        for e in c["ents"]:
            mentions[e].append(k)
    idf = {e: round(math.log(len(chunks) / len(m)), 4) for e, m in mentions.items()}
    vector = {e: chunks[min(m)]["v"] for e, m in mentions.items()}
    want = {}
    for q in (k for k in chunks if k % 20 == 0):
        cos = {k: round(float(c["v"] @ chunks[q]["v"]), 6) for k, c in chunks.items()}
        dense = sorted(chunks, key=lambda k: (-cos[k], chunks[k]["key"]))[: max(13, 16) if mode == "expand" else 13]
        act = {}
        if mode == "expand":
            seeds = Counter()
            for rank, h in enumerate(_deduped([chunks[k] for k in dense], 16)[:3], 1):
                for e in h["ents"]:
                    seeds[e] += 1 / rank
            act = {e: round(w, 6) for e, w in seeds.items()}
            act = dict(sorted(act.items(), key=lambda x: (-x[1] * idf[x[0]], x[0]))[:8])
        else:
            sims = sorted(((round(float(v @ chunks[q]["v"]), 6), e) for e, v in vector.items()), key=lambda x: (-x[0], x[1]))[: p.top_m]
            linked = {e: s for s, e in sims if s >= p.min_sim}
            act = dict(linked)
            for e, s in linked.items():
                near = sorted(((w, (set(pair) - {e}).pop()) for pair, w in weight.items() if e in pair), key=lambda x: (-x[0], x[1]))[: p.hop_neighbours]
                for _, o in near:
                    if o not in linked:
                        act[o] = max(act.get(o, 0), p.hop_decay * s)
            act = {e: round(a, 6) for e, a in act.items()}
        scores = {}
        for k, c in chunks.items():
            worth = [act[e] * idf[e] for e in c["ents"] if act.get(e, 0) * idf[e] > 0]
            if len(worth) >= (p.expand_min_shared if mode == "expand" else 1):
                scores[k] = round(sum(worth), 6)
        most = max(scores.values(), default=0)
        by_score = sorted(scores, key=lambda k: (-scores[k], chunks[k]["key"]))
        if mode == "graph_only":
            hits = _deduped([chunks[k] | {"s": round(scores[k] / most, 6)} for k in by_score[:13]], 5)
        else:
            pool = [k for k in by_score[: p.pool] if k not in dense[:13]]
            fused = [(round(cos[k] + p.alpha * scores.get(k, 0) / (most or 1), 6), n, r, k) for n, part in enumerate((dense[:13], pool)) for r, k in enumerate(part)]
            hits = _deduped([chunks[k] | {"s": s} for s, _, _, k in sorted(fused, key=lambda x: (-x[0], x[1], x[2]))], 5)
        want[q] = [(h["key"], h["s"]) for h in hits]
    got = defaultdict(list)
    c = Q.chunks(spark, sf_dir)
    g, vectors = Q.chunk_graph(c)
    for r in sorted(R.graph_hits(Q.asked(c).select("query_id", "query_vector"), c, g, vectors, 5, mode, p).collect(), key=lambda r: r["rank"]):
        got[r["query_id"]].append((r["chunk_key"], r["score"]))
    for q, hits in want.items():
        assert [x[1] for x in got[q]] == pytest.approx([x[1] for x in hits], abs=2e-5)
        sure = [k for k, s in hits if sum(abs(s - o) < 3e-5 for _, o in hits) == 1]
        assert set(sure[:-1]) <= {k for k, _ in got[q]}


def test_answers_are_checked_and_given_again(spark):
    questions = spark.createDataFrame([(1, "good?"), (2, "bad?"), (3, "never?"), (4, "nothing?")], "query_id int, question string")
    hits = spark.createDataFrame([(q, r, f"c{q}{r}", f"text {q}", 0.5) for q in (1, 2, 3) for r in (1, 2)], "query_id int, rank int, chunk_key string, text string, score double")
    model = lambda p: F.when(p.contains("good?"), "fine [1].").when(p.contains("bad?") & p.contains("STRICT"), "better [2].").when(p.contains("bad?"), "wrong [1]. wrong [2].").otherwise("wrong [1].")
    entails = lambda premise, said: F.when(said.contains("wrong"), 0.0).otherwise(1.0)
    answers, sources = G.checked_answers(questions, hits, model, entails, Settings(), "sys ", "do", "STRICT")
    got = {r["query_id"]: (r["answer"], r["regen"], r["n_sources"], r["unsupported"], r["llm_calls"]) for r in answers.collect()}
    assert got == {1: ("fine [1].", 0, 1, 0, 1), 2: ("better [2].", 1, 1, 0, 2), 3: ("wrong [1].", 1, 1, 1, 2), 4: ("Dazu steht in den Quellen nichts.", 0, 0, 0, 0)}
    saved = {r["query_id"]: json.loads(r["sources"]) for r in G.assistant_messages(answers, sources, "m").collect()}
    assert [s["chunk_key"] for s in saved[2]] == ["c22"] and saved[4] == [] and saved[3][0]["supported"] is False
    with pytest.raises(ValueError, match="context"):
        G.check_context(questions.select(F.array(F.struct(F.lit("user").alias("role"), F.lit("x" * 200).alias("content"))).alias("messages")), 40)


def test_extraction_and_reports_try_twice(spark):
    chunks = spark.createDataFrame([(f"b:{k}", "b", k, None, f"text {k} " + "z" * 3000) for k in range(4)], "chunk_key string, book_id string, chunk_index int, chapter string, text string")
    good = '{"entities":[{"name":"Ann","type":"character","desc":"d"}],"relations":[]}'
    seen = lambda p: F.when(F.length(p) > 2500, "too long").when(p.contains("text 1 "), F.when(p.contains("AGAIN"), F.lit(good)).otherwise("none")).when(p.contains("text 2 "), "none").otherwise(F.lit(good))
    rows = {r["key"]: r for r in G.extraction_rows(chunks, spark.createDataFrame([("b:3",)], "key string"), seen, lambda t: t, " AGAIN").collect()}
    assert set(rows) == {"b:0", "b:1", "b:2"} and rows["b:2"]["error"] and rows["b:2"]["retried"] and rows["b:1"]["retried"] and not rows["b:0"]["retried"]
    assert rows["b:1"]["entities"][0]["type"] == "PERSON"
    prompts = spark.createDataFrame([("c0", "p0"), ("c1", "p1"), ("c2", "p2")], "community string, prompt string")
    said = lambda p: F.when(p.startswith("p0") | p.contains("ONLY"), F.when(p.startswith("p2"), "raw  words").otherwise('{"title":"T","summary":"S"}')).otherwise("no")
    got = {r["community"]: (r["report"]["title"], r["report"]["summary"], r["raw_fallback"]) for r in G.reports(prompts, said).collect()}
    assert got == {"c0": ("T", "S", False), "c1": ("T", "S", False), "c2": ("Untitled community", "raw words", True)}


def test_routes_services_and_sources(spark):
    df = spark.createDataFrame([("Wer ist das?",), ("Ist das so?",), ("Und nun?",)], "q string")
    model = lambda q: F.when(q.contains("nun"), " Global.").otherwise("weiter")
    assert [r[0] for r in df.select(G.route_of(F.col("q"), model)).collect()] == ["local", "local", "global"]
    m = spark.createDataFrame([("global", True, True), ("global", True, False), ("local", False, True)], "mode string, g boolean, i boolean")
    assert [r[0] for r in m.select(R.chosen_service(F.col("mode"), False, F.col("g"), F.col("i"))).collect()] == ["global", "graph", "dense"]
    s = spark.createDataFrame([("community",), ("chunk",), (None,)], "kind string")
    assert G.passages_only(s).count() == 2
    a = spark.createDataFrame([("x", "p", 1), ("y", "q", 1), ("z", "r", 2)], "item_id string, answer string, attempts int")
    assert tuple(G.identical_answers(a, a.withColumn("answer", F.when(F.col("item_id") == "y", "other").otherwise(F.col("answer")))).first()) == (2, 1)


def test_graph_and_partition_files(spark, tmp_path):
    rows = spark.createDataFrame([("b:0", "b", [("Count Dracula", "PERSON", "x"), ("Lucy", "PERSON", "")], [("Lucy", "Count Dracula", "knows")]), ("b:1", "b", [("Dracula", "PERSON", "y")], [])], "key string, book_id string, entities array<struct<name:string,type:string,desc:string>>, relations array<struct<source:string,target:string,rel:string>>")
    g, at = graph.build(rows, 2), f"file://{tmp_path}/g"
    assert not files.graph_exists(spark, at)
    files.save_graph(g, at)
    back = files.load_graph(spark, at)
    assert files.graph_exists(spark, at) and sorted(back.nodes.collect()) == sorted(g.nodes.select(*back.nodes.columns).collect()) and back.edges.count() == 1
    members = spark.createDataFrame([("a", "c000", 2), ("b", "c000", 2), ("z", "c001", 1)], "entity_id string, community string, size long")
    files.save_partition(members, f"{at}/p")
    assert sorted(files.load_partition(spark, f"{at}/p").collect()) == sorted(members.collect())
    index = members.select("community").distinct().withColumn("entities", F.array(F.lit("a")))
    assert {(r["community"], r["entities"][0]) for r in communities.union_indexes({"g": index, "h": index}).collect()} == {(f"{x}/c00{k}", f"{x}/a") for x in "gh" for k in (0, 1)}


def test_projection_gold_and_health(spark):
    m = np.random.default_rng(1).standard_normal((60, 5)) * [5, 1, 3, 0.1, 0.2]
    got, shares = evaluation.projection(spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(m)], "k int, vector array<double>"))
    centred = m - m.mean(0)
    u, s, vt = np.linalg.svd(centred, full_matrices=False)
    points = np.array([r["point"] for r in sorted(got.collect(), key=lambda r: r["k"])])
    assert np.allclose(np.abs(points), np.abs(centred @ vt[:2].T), atol=1e-4) and np.allclose(shares, (s**2 / (s**2).sum())[:2])
    items = spark.createDataFrame([(f"i{k}", ("global", "fact", "multi")[k % 3], f"a{k}", None) for k in range(12)], "id string, qtype string, answer string, rubric array<string>")
    gold = evaluation.gold_with_controls(items, ["i2"], 3).collect()
    assert sum(r["control"] for r in gold) == 3 and any(r["id"] == "i2" and r["rubric"] == ["a2"] for r in gold) and sum(not r["control"] for r in gold) == 4
    assert tuple(evaluation.health({"books": items}, {"store": True, "model": False}).first()) == (False, True, "degraded", 12)


def test_rouge_l_query_against_plain_subsequences(spark, sf_dir):
    pairs = {(r["conv_id"], r["turn"]): (r["pred"], r["gold"]) for r in Q._pairs(spark, sf_dir).collect()}
    for r in Q.QUERIES["rouge_l"](spark, sf_dir).collect():
        a, b = (__import__("re").findall("[a-z0-9]+", (x or "").lower()) for x in pairs[r["conv_id"], r["turn"]])
        row = [0] * (len(b) + 1)
        for x in a:
            last = 0
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
        p, c = (row[-1] / len(z) if z else 0.0 for z in (a, b))
        assert r["rouge_l"] == pytest.approx(2 * p * c / (p + c) if p + c else 0.0, abs=2e-6)


def test_chunk_book_and_points_against_the_rule(spark, sf_dir):
    """Passages of every book from its cleaned text, by plain loops over its paragraphs."""
    report, _ = I.ingest(Q._books(spark, sf_dir), Q.embed(Q.HashEmbedder()), dry_run=True)
    want = {}
    for r in report.select("book_id", "cleaned").collect():
        at, chapter, part, parts = 0, None, [], []
        for p in r["cleaned"].split("\n\n"):
            heading = p.startswith("CHAPTER ") and len(p) <= 80
            if heading:
                parts.append((chapter, part))
                chapter, part = p.strip(), []
            elif p.strip():
                part.append((at, p))
            at += len(p) + 2
        parts.append((chapter, part))
        n = 0
        for chapter, part in parts:
            for a, b in plain_ranges([len(p) for _, p in part], 1800, 200) if part else []:
                want[r["book_id"], n] = (chapter, part[a][0], part[b - 1][0] + len(part[b - 1][1]))
                n += 1
    got = {(r["book_id"], r["chunk_index"]): (r["chapter"], r["char_start"], r["char_end"]) for r in Q.QUERIES["chunk_book"](spark, sf_dir).collect()}
    assert got == want
    points = {r["chunk_key"]: (r["chapter"], r["char_start"], r["char_end"], r["dims"]) for r in Q.QUERIES["ingest_points"](spark, sf_dir).collect()}
    assert points == {f"{b}:{i}": (*v, 64) for (b, i), v in want.items()}


def test_graph_build_and_extraction_queries_against_loops(spark, sf_dir):
    import re

    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    held, near = defaultdict(set), defaultdict(set)
    for k, text in docs.items():
        words = list(dict.fromkeys(re.findall("[A-Z][a-z]{5,}", text)))
        for w in words:
            held[w.lower()].add(k)
        for w in words[1:]:
            if w.lower() != words[0].lower():
                near[tuple(sorted((w.lower(), words[0].lower())))].add(k)
    degree = Counter()
    for (a, b), ks in near.items():
        degree[a] += len(ks)
        degree[b] += len(ks)
    got = {r["entity_id"].partition(":")[2]: (r["n_mentions"], r["idf"], r["degree"]) for r in Q.QUERIES["graph_build"](spark, sf_dir).collect()}
    assert got == {w: (len(ks), round(math.log(len(docs) / len(ks)), 4), degree[w]) for w, ks in held.items()}
    for r in Q.QUERIES["extraction_parse"](spark, sf_dir).collect():
        k, words = r["doc_id"], re.findall("[A-Z][a-z]{5,}", docs[r["doc_id"]])
        names = list(dict.fromkeys(w.lower() for w in words))
        assert r["n_relations"] <= 0
        if k % 4 in (0, 2):
            assert (r["n_entities"], r["truncated"], r["error"]) == (min(8, len(names)), False, None)
        elif k % 4 == 3:
            assert (r["n_entities"], r["error"]) == (0, "no JSON object")
