"""Questions to answers: prompts, citations, faithfulness, the corrective loop; batches of questions as tables.

Models come as column functions (see folio.models); what they return is only text to these plans.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.config import Settings
from folio.functions import text as T
from folio.functions.json import grade as parsed_grade
from folio.lineage import saved
from folio.models import windows
from folio.operators.ranking import dedup_overlaps, dense_top_k, expand, interleave, rerank, small, top_k

Model = Callable[[Column], Column]
NOTHING_FOUND = "Dazu steht in den Quellen nichts."


def context_blocks(hits: DataFrame, query: str = "query_id") -> DataFrame:
    """(query, context, n_sources): hits numbered from 1, in order of rank."""
    lists = hits.groupBy(query).agg(F.array_sort(F.collect_list(F.struct("rank", "text"))).alias("_h"))
    block = F.transform("_h", lambda h, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), F.coalesce(h["text"], F.lit(""))))
    return lists.select(query, F.array_join(block, "\n\n").alias("context"), F.size("_h").alias("n_sources"))


def history_turns(messages: DataFrame, n: int = 4, query: str = "query_id") -> DataFrame:
    """(query, history): the last n turns, without citation marks in what the assistant said."""
    last = top_k(messages, n, query, F.desc("turn"), rank="_n")
    said = F.when(F.col("role") == "assistant", T.without_citations(F.col("content"))).otherwise(F.col("content"))
    lists = last.groupBy(query).agg(F.array_sort(F.collect_list(F.struct("turn", "role", said.alias("content")))).alias("h"))
    return lists.select(query, F.transform("h", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("history"))


def build_messages(questions: DataFrame, contexts: DataFrame, history: DataFrame | None, system: str, instruction: str, hint: str | None = None, extra: str = "", query: str = "query_id") -> DataFrame:
    """Adds `messages`: system, history, then the numbered sources and the question."""
    out = questions.join(contexts, query, "left")
    out = out.join(history, query, "left") if history is not None else out.withColumn("history", F.lit(None).cast("array<struct<role:string,content:string>>"))
    hinted = F.coalesce(F.concat(F.col(hint), F.lit("\n\n")), F.lit("")) if hint else F.lit("")
    asked = F.concat(F.lit("Quellen:\n"), F.coalesce("context", F.lit("")), F.lit("\n\n"), hinted, F.lit("Frage: "), F.col("question"), F.lit("\n\n" + instruction))
    one = lambda role, content: F.array(F.struct(F.lit(role).alias("role"), content.alias("content")))
    empty = F.array().cast("array<struct<role:string,content:string>>")
    return out.withColumn("messages", F.concat(one("system", F.lit(system + extra)), F.coalesce("history", empty), one("user", asked)))


def prompt_chars(messages: Column) -> Column:
    return F.aggregate(messages, F.lit(0), lambda s, m: s + F.length(m["content"]))


def cited_sources(answers: DataFrame, hits: DataFrame, query: str = "query_id") -> DataFrame:
    """One row per source that an answer cites: its marker and the hit it stands for."""
    n = hits.groupBy(query).agg(F.max("rank").alias("_n"))
    marked = answers.join(n, query).select(query, F.explode(T.citations(F.col("answer"), F.col("_n"))).alias("marker"))
    found = marked.join(hits.withColumnRenamed("rank", "marker"), [query, "marker"])
    return found.withColumn("score", F.round("score", 4)) if "score" in found.columns else found


def word_windows(text: Column) -> Column:
    """A passage as overlapping windows that a model of bounded input can read whole; a short or null one as it is."""
    words = F.regexp_extract_all(text, F.lit(r"\s*\S+"), F.lit(0))
    return F.when(F.size(words) > 380, F.transform(windows(words), lambda w: F.array_join(w, ""))).otherwise(F.array(text))


def faithfulness(sources: DataFrame, answers: DataFrame, entails: Callable[[Column, Column], Column], threshold: float = 0.5, query: str = "query_id") -> DataFrame:
    """Adds supported and support_score: the best entailment, by any window of the source, of a sentence that cites it (else of the whole answer)."""
    said = sources.join(answers.select(query, F.col("answer").alias("_answer")), query)
    mark = F.concat(F.lit("["), F.col("marker").cast("string"), F.lit("]"))
    citing = F.filter(T.sentences(F.col("_answer")), lambda s: s.contains(mark))
    lines = said.select(query, "marker", "text", F.explode(F.when(F.size(citing) > 0, citing).otherwise(F.array("_answer"))).alias("_s"))
    lines = lines.withColumn("text", F.explode(word_windows(F.col("text"))))
    best = lines.groupBy(query, "marker").agg(F.max(entails(F.col("text"), F.col("_s"))).alias("_best"))
    return sources.join(best, [query, "marker"]).withColumn("supported", F.col("_best") >= threshold).withColumn("support_score", F.round("_best", 3)).drop("_best")


def answer_faithfulness(answers: DataFrame, hits: DataFrame, entails: Callable[[Column, Column], Column], passages: int = 5, threshold: float = 0.5, query: str = "query_id") -> DataFrame:
    """Share of sentences over 15 characters that a window of one of the first five passages supports; 0 without such sentences."""
    lines = answers.select(query, F.posexplode(F.filter(T.sentences(T.without_citations(F.col("answer"))), lambda s: F.length(s) > 15)).alias("k", "s"))
    pairs = lines.join(hits.where(F.col("rank") <= passages).select(query, F.explode(word_windows(F.col("text"))).alias("text")), query, "left")
    best = pairs.groupBy(query, "k").agg(F.max(F.coalesce(entails(F.col("text"), F.col("s")), F.lit(0.0))).alias("best"))
    share = best.groupBy(query).agg(F.avg((F.col("best") >= threshold).cast("double")).alias("faithfulness"))
    return answers.select(query).join(share, query, "left").withColumn("faithfulness", F.round(F.coalesce("faithfulness", F.lit(0.0)), 6))


def with_texts(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Hits with the texts of their chunks. Few hits are broadcast, so that the texts are not shuffled."""
    hits = saved(hits, "hits")
    return chunks.select("chunk_key", "text").join(F.broadcast(hits) if small(hits) else hits, "chunk_key")


def select_hits(questions: DataFrame, chunks: DataFrame, settings: Settings, relevance: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """Dense retrieval, optional re-ranking, then optional small-to-big: in this order.

    questions: query_id, question, query_vector, group_ids (null: all groups). chunks: the store's rows with vectors.
    """
    fetch = settings.rerank_candidates if settings.rerank else settings.top_k
    asked = questions.select("query_id", "question", "query_vector", "group_ids")
    found = dense_top_k(chunks.select("chunk_key", "book_id", "group_id", "chunk_index", "char_start", "char_end", "vector"), asked, fetch + 8, groups="group_ids")
    hits = dedup_overlaps(found.select("query_id", "rank", "score", "chunk_key", "book_id", "chunk_index", "char_start", "char_end", "question"), fetch)
    hits = with_texts(hits, chunks)
    if settings.rerank and relevance is not None:
        hits = rerank(hits, hits.select("query_id", "chunk_key", relevance(F.col("text"), F.col("question")).alias("rerank_score")), settings.top_k)
    hits = hits.drop("question").where(F.col("rank") <= settings.top_k)
    return expand(hits, chunks, settings.window, settings.expand_top_n) if settings.small_to_big else hits


def condensed(questions: DataFrame, history: DataFrame, model: Model, query: str = "query_id") -> DataFrame:
    """Adds retrieval_query: a follow-up rewritten to stand alone; the question itself without history or after an error."""
    out = questions.join(history, query, "left")
    turns = F.array_join(F.transform("history", lambda h: F.concat(h["role"], F.lit(": "), h["content"])), "\n")
    asked = F.when(F.size("history") > 0, T.strip(model(F.concat(turns, F.lit("\n"), F.col("question")))))
    return out.withColumn("retrieval_query", F.coalesce(F.nullif(asked, F.lit("")), F.col("question"))).drop("history")


# --- the corrective loop ------------------------------------------------------------------------------------------------------


def after_grade(n_relevant: Column, attempts: Column, settings: Settings) -> Column:
    """Enough relevant passages: generate; else rewrite while searches are left; else generate from any, or refuse."""
    return F.when(n_relevant >= settings.crag_min_relevant, "generate").when(attempts <= settings.crag_max_retries, "rewrite").when(n_relevant > 0, "generate").otherwise("refuse")


def after_check(n_sources: Column, unsupported: Column, regen: Column, settings: Settings) -> Column:
    share = F.try_divide(unsupported, n_sources)
    return F.when((n_sources == 0) | (regen >= settings.crag_max_regen), "end").when(share > settings.crag_unsupported_max, "generate").otherwise("end")


def corrective_retrieval(questions: DataFrame, search: Callable[[DataFrame], DataFrame], grader: Callable[[Column, Column], Column], rewriter: Model, settings: Settings) -> DataFrame:
    """The loop of search, grading and rewriting, unrolled: each stage works on the questions that are still open.

    questions: query_id, question. search: (query_id, query) -> ranking with chunk_key, book_id, char_start, char_end, text, score.
    grader: (question, numbered passages) -> JSON. Returns one row per question: attempts, n_relevant, decision, queries, and
    `context`, the ranked passages that go into the prompt.
    """
    hit = ["query_id", "rank", "chunk_key", "book_id", "char_start", "char_end", "text", "score"]
    open_ = questions.select("query_id", "question", F.col("question").alias("query"), F.array("question").alias("queries"))
    rankings, relevant, graded, closed = [], None, None, None
    for attempt in range(1, settings.crag_max_retries + 2):
        found = search(open_.select("query_id", "query")).select(*hit).persist()
        rankings.append(found)
        fresh = found if graded is None else found.join(graded.select("query_id", "chunk_key"), ["query_id", "chunk_key"], "left_anti")
        if relevant is not None:  # nothing that overlaps a passage already kept
            near = fresh.alias("f").join(relevant.alias("r"), (F.col("f.query_id") == F.col("r.query_id")) & (F.col("f.book_id") == F.col("r.book_id")) & (F.col("f.char_start") < F.col("r.char_end")) & (F.col("r.char_start") < F.col("f.char_end"))).select("f.query_id", "f.chunk_key")
            fresh = fresh.join(near, ["query_id", "chunk_key"], "left_anti")
        fresh = fresh.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))
        lists = context_blocks(fresh.withColumn("text", F.substring("text", 1, settings.grade_chars)))
        judged = open_.join(lists, "query_id").select("query_id", F.col("n_sources").alias("_n"), parsed_grade(grader(F.col("question"), F.col("context")), F.col("n_sources")).alias("_keep"))
        marked = fresh.join(judged, "query_id").withColumn("relevant", F.coalesce(F.array_contains("_keep", F.col("rank")), F.lit(True))).withColumn("attempt", F.lit(attempt)).drop("_n", "_keep")
        marked = marked.select(*hit, "relevant", "attempt").persist()
        graded = marked if graded is None else graded.unionByName(marked)
        good = marked.where("relevant").select(*hit)
        relevant = good if relevant is None else relevant.unionByName(good)
        counts = relevant.groupBy("query_id").agg(F.count("*").alias("n_relevant"))
        state = open_.join(counts, "query_id", "left").withColumn("n_relevant", F.coalesce("n_relevant", F.lit(0))).withColumn("attempts", F.lit(attempt))
        state = state.withColumn("decision", after_grade(F.col("n_relevant"), F.col("attempts"), settings)).persist()
        done = state.where("decision <> 'rewrite'").select("query_id", "attempts", "n_relevant", "decision", "queries")
        closed = done if closed is None else closed.unionByName(done)
        rewritten = T.strip(F.split(F.regexp_replace(T.strip(rewriter(F.concat(F.col("question"), F.lit("\n"), F.array_join(F.col("queries"), "\n")))), '^"+|"+$', ""), "\n")[0])
        open_ = state.where("decision = 'rewrite'").withColumn("query", F.coalesce(F.nullif(rewritten, F.lit("")), "question")).withColumn("queries", F.array_append("queries", F.col("query"))).select("query_id", "question", "query", "queries")
    if settings.crag_strategy == "trigger":
        context = dedup_overlaps(interleave(rankings).select(*hit), settings.top_k)
    else:
        context = top_k(relevant.withColumnRenamed("rank", "_was"), settings.top_k, "query_id", F.desc("score"), F.col("_was"), F.col("chunk_key")).drop("_was")
    packed = context.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "chunk_key", "text", "score"))).alias("context"))
    out = closed.join(packed, "query_id", "left")
    return out.withColumn("context", F.when(F.col("decision") == "generate", F.col("context")))


def grader_calibration(graded: DataFrame, truth: DataFrame, query: str = "query_id") -> DataFrame:
    """Confusion of graded passages against gold spans of answerable questions, and counts on unanswerable ones. truth: (query, chunk_key, hit) and answerable per question."""
    out = graded.join(truth, [query, "chunk_key"])
    hit, kept, open_ = F.col("hit"), F.col("relevant"), F.col("answerable")
    return out.agg(
        F.count_if(open_ & kept & hit).alias("tp"), F.count_if(open_ & kept & ~hit).alias("fp"), F.count_if(open_ & ~kept & hit).alias("fn"), F.count_if(open_ & ~kept & ~hit).alias("tn"),
        F.count_if(~open_).alias("graded_on_unanswerable"), F.count_if(~open_ & kept).alias("relevant_on_unanswerable"),
    ).withColumn("precision", F.try_divide("tp", F.col("tp") + F.col("fp"))).withColumn("recall", F.try_divide("tp", F.col("tp") + F.col("fn")))


#: Characters of a report's prompt, entities and relations in it at most, and when it has to be shortened at least.
PROMPT_CHARS, MOST_ENTITIES, MOST_RELATIONS, LEAST_LINES = 18_000, 40, 60, 10


def _halves(first: Column, most: int) -> list[Column]:
    """A number and what halving makes of it, down to LEAST_LINES."""
    out = [first]
    while most > LEAST_LINES:
        out.append(F.greatest(F.least(out[-1], F.lit(LEAST_LINES)), F.floor(out[-1] / 2).cast("int")))
        most //= 2
    return out


def report_prompt(members: Column, relations: Column, excerpts: Column, budget: int = PROMPT_CHARS) -> Column:
    """Text for a community report. While it is too long, the last excerpt goes; then relations are halved, then entities, neither below ten lines."""
    part = lambda lines, n, by: F.coalesce(F.nullif(F.array_join(F.slice(lines, F.lit(1), n), by), F.lit("")), F.lit("-"))
    text = lambda e, r, x: F.concat_ws("\n\n", F.lit("Entities:"), part(members, e, "\n"), F.lit("Relations:"), part(relations, r, "\n"), F.lit("Excerpts:"), part(excerpts, x, "\n\n"))
    entities, edges = F.least(F.size(members), F.lit(MOST_ENTITIES)), F.least(F.size(relations), F.lit(MOST_RELATIONS))
    size = lambda e, r, x: F.struct(e.alias("e"), r.alias("r"), x.alias("x"))
    fewer_edges, fewer = _halves(edges, MOST_RELATIONS), _halves(entities, MOST_ENTITIES)
    shapes = F.concat(
        F.transform(F.sequence(F.size(excerpts), F.lit(0), F.lit(-1)), lambda x: size(entities, edges, x)),
        F.array(*[size(entities, r, F.lit(0)) for r in fewer_edges[1:]], *[size(e, fewer_edges[-1], F.lit(0)) for e in fewer[1:]]),
    )
    good = F.filter(shapes, lambda s: F.length(text(s["e"], s["r"], s["x"])) <= budget)
    chosen = F.transform(F.array(F.coalesce(F.get(good, F.lit(0)), F.element_at(shapes, -1))), lambda s: text(s["e"], s["r"], s["x"]))
    return F.element_at(chosen, 1)
