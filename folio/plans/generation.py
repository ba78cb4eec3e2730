"""What language models are asked for in batches: answers that are checked and given again, extraction rows, community reports, routes and verdicts.

Models are column functions (see folio.models); null means that the call failed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.config import Settings
from folio.functions import json as J
from folio.functions import text as T
from folio.lineage import saved
from folio.plans.answer import NOTHING_FOUND, Model, after_check, build_messages, cited_sources, context_blocks, faithfulness, prompt_chars

#: Characters of a passage that an extraction or a context is made from.
PASSAGE_CHARS = 2400


def prompt_text(messages: Column) -> Column:
    """Messages as one text, a line with the role before each."""
    return F.array_join(F.transform(messages, lambda m: F.concat(F.lit("### "), m["role"], F.lit("\n"), m["content"])), "\n")


def check_context(messages: DataFrame, least: int = 8000, column: str = "messages") -> None:
    """Refuses a batch if a prompt would not fit into a model's context of `least` tokens, at four characters a token."""
    most = messages.agg(F.max(prompt_chars(F.col(column))).alias("n")).first()["n"] or 0
    if most > 4 * least:
        raise ValueError(f"a prompt has {most} characters, more than a context of {least} tokens holds")


def checked_answers(
    questions: DataFrame, hits: DataFrame, model: Model, entails: Callable[[Column, Column], Column] | None, settings: Settings, system: str, instruction: str, strict: str,
    history: DataFrame | None = None, query: str = "query_id",
) -> tuple[DataFrame, DataFrame]:
    """(answers, sources): each question's answer from its hits, generated again with a stricter system text while too many of its sources are unsupported.

    answers: query, answer, regen, n_sources, unsupported, llm_calls. Questions without hits get a fixed answer and no call. sources: what each answer cites.
    """
    contexts = context_blocks(hits, query)
    empty = questions.join(contexts.select(query), query, "left_anti")
    refused = empty.select(query, F.lit(NOTHING_FOUND).alias("answer"), F.lit(0).alias("regen"), F.lit(0).cast("long").alias("n_sources"), F.lit(0).cast("long").alias("unsupported"), F.lit(0).alias("llm_calls"))
    open_, done, cited = questions.join(contexts.select(query), query, "left_semi"), refused, None
    for regen in range(settings.crag_max_regen + 1):
        asked = build_messages(open_, contexts, history, system, instruction, extra=strict if regen else "", query=query)
        said = saved(asked.select(query, F.coalesce(model(prompt_text(F.col("messages"))), F.lit("")).alias("answer")), "answers")
        sources = cited_sources(said, hits, query)
        sources = faithfulness(sources, said, entails, settings.faithfulness_threshold, query) if entails else sources.withColumn("supported", F.lit(None).cast("boolean")).withColumn("support_score", F.lit(None).cast("double"))
        sources = saved(sources, "sources")
        counts = sources.groupBy(query).agg(F.count("*").alias("n_sources"), F.count_if(~F.col("supported")).alias("unsupported"))
        state = said.join(counts, query, "left").na.fill(0, ["n_sources", "unsupported"])
        state = state.withColumn("_next", after_check(F.col("n_sources"), F.col("unsupported"), F.lit(regen), settings))
        finished = state.where("_next = 'end'").select(query, "answer", F.lit(regen).alias("regen"), "n_sources", "unsupported", F.lit(regen + 1).alias("llm_calls"))
        kept = sources.join(finished.select(query), query, "left_semi")
        done, cited = done.unionByName(finished), kept if cited is None else cited.unionByName(kept)
        open_ = open_.join(state.where("_next <> 'end'").select(query), query, "left_semi")
    return done, cited


def assistant_messages(answers: DataFrame, sources: DataFrame, model: str, query: str = "query_id") -> DataFrame:
    """Rows to append to the messages of conversations: the answer and its sources as JSON, in order of their markers (an empty list without any)."""
    fields = [c for c in sources.columns if c != query]
    lists = sources.groupBy(query).agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("marker", F.struct(*fields).alias("s")))), lambda x: x["s"])).alias("sources"))
    return answers.join(lists, query, "left").select(query, F.lit("assistant").alias("role"), F.col("answer").alias("content"), F.lit(model).alias("model"), F.coalesce("sources", F.lit("[]")).alias("sources"))


def extraction_rows(chunks: DataFrame, known: DataFrame, model: Model, prompt: Callable[[Column], Column], again: str) -> DataFrame:
    """Extraction rows of chunks that `known` (key) has not: parsed answers, asked once more where the first one cannot be read.

    chunks: chunk_key, book_id, chunk_index, chapter, text. Result: key, book_id, chunk_index, chapter, entities, relations, truncated, error, retried.
    """
    todo = chunks.join(known.select(F.col("key").alias("chunk_key")).distinct(), "chunk_key", "left_anti")
    todo = todo.withColumn("_prompt", prompt(F.substring("text", 1, PASSAGE_CHARS)))
    first = saved(J.parse_extractions(todo.withColumn("raw", model(F.col("_prompt"))), out="x"), "extractions")
    failed = first.where("x.error is not null").drop("raw", "x")
    second = J.parse_extractions(failed.withColumn("raw", model(F.concat("_prompt", F.lit(again)))), out="x").withColumn("retried", F.lit(True))
    every = first.where("x.error is null").withColumn("retried", F.lit(False)).unionByName(second)
    return every.select(F.col("chunk_key").alias("key"), "book_id", "chunk_index", "chapter", "x.entities", "x.relations", "x.truncated", "x.error", "retried")


def extraction_summary(rows: DataFrame) -> DataFrame:
    """One row: rows, errors and their share, repaired ones, entities and relations a row, milliseconds of those that say any."""
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    return rows.agg(
        F.count("*").alias("n_rows"), F.count("error").alias("errors"), F.round(F.try_divide(F.count("error"), F.count("*")), 6).alias("error_rate"), F.count_if("truncated").alias("repaired"),
        F.round(F.avg(size("entities")), 6).alias("avg_entities"), F.round(F.avg(size("relations")), 6).alias("avg_relations"), F.round(F.avg(F.nullif("ms", F.lit(0))), 6).alias("avg_ms"),
    )


def reports(prompts: DataFrame, model: Model, again: str = "\nReturn ONLY valid JSON.", key: str = "community") -> DataFrame:
    """(community, report, raw_fallback): a report that cannot be read is asked for once more; then its raw text is the summary."""
    first = saved(prompts.select(key, "prompt", J.report(model(F.col("prompt"))).alias("report")), "reports")
    second = saved(first.where("report is null").select(key, model(F.concat("prompt", F.lit(again))).alias("raw")), "reports")
    empty = F.array().cast("array<struct<summary:string,explanation:string>>")
    raw = F.struct(F.lit("Untitled community").alias("title"), T.collapse(F.coalesce("raw", F.lit("")), 2000).alias("summary"), empty.alias("findings"))
    parsed = J.report(F.col("raw"))
    mended = second.select(key, F.coalesce(parsed, raw).alias("report"), parsed.isNull().alias("raw_fallback"))
    return first.where("report is not null").select(key, "report", F.lit(False).alias("raw_fallback")).unionByName(mended)


def route_of(question: Column, model: Model | None = None) -> Column:
    """global or local: by the question's words, else by the model's one word, else local."""
    said = F.when(F.upper(model(question)).contains("GLOBAL"), "global") if model else F.lit(None).cast("string")
    return F.coalesce(T.route(question), said, F.lit("local"))


def says_yes(answer: Column) -> Column:
    """A judge's verdict; a failed call is no verdict."""
    return F.upper(F.trim(answer)).startswith("JA")


def rubric_coverage(verdicts: DataFrame, by: list[str]) -> DataFrame:
    """Share of rubric points that a judge saw in an answer (verdicts: by, present; null is no)."""
    return verdicts.groupBy(*by).agg(F.count("*").alias("points"), F.round(F.avg(F.coalesce("present", F.lit(False)).cast("double")), 6).alias("coverage"))


def blind_order(tasks: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """Tasks in an order that tells nothing of their arms: by a hash of key and seed."""
    return tasks.orderBy(F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}"))), key)


def trace_counts(traces: DataFrame, trace: str = "trace") -> DataFrame:
    """Adds llm_calls, retries and regens from a list of nodes: calls are made by grading, rewriting and generating."""
    count = lambda *names: F.size(F.filter(trace, lambda x: x["node"].isin(*names)))
    return traces.withColumn("llm_calls", count("grade", "rewrite", "generate")).withColumn("retries", count("rewrite")).withColumn("regens", F.greatest(count("generate") - 1, F.lit(0)))


def identical_answers(a: DataFrame, b: DataFrame, key: str = "item_id") -> DataFrame:
    """Of items that both arms answered at the first attempt, how many have the same answer: a check that arms differ by their loop alone."""
    one = a.where("attempts = 1").select(key, F.col("answer").alias("_a")).join(b.select(key, F.col("answer").alias("_b")), key)
    return one.agg(F.count("*").alias("n"), F.count_if(F.col("_a") == F.col("_b")).alias("identical"))


def source_label(chapter: Column, title: Column, position: Column) -> Column:
    """What a source is called: its chapter, else its book and place."""
    book = F.coalesce(title, F.lit("Quelle"))
    return F.coalesce(F.nullif(T.pretty_chapter(chapter), F.lit("")), F.when(position.isNotNull(), F.concat(book, F.lit(" · bei "), position.cast("string"), F.lit(" %"))), book)


def passages_only(sources: DataFrame) -> DataFrame:
    """Sources that are passages, not community reports."""
    return sources.where(~F.col("kind").eqNullSafe(F.lit("community")))
