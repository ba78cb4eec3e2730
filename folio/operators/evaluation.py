"""Evaluation: ranking metrics, answer metrics, paired statistics."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from folio.functions.text import sentences


def ratio(a: Column, b: Column, digits: int = 6) -> Column:
    return F.round(F.try_divide(a, b), digits)


def first_hits(hits: DataFrame, items: DataFrame, item: str = "item_id", arm: str | None = None) -> DataFrame:
    """Every item (of every arm) with the rank of its first relevant hit, null without one."""
    keys = [item] + ([arm] if arm else [])
    found = hits.where("hit").groupBy(*keys).agg(F.min("rank").alias("first_rank"))
    return items.join(found, keys, "left")


def hit_and_mrr(first: DataFrame, by: list[str], cuts: tuple[int, ...] = (1, 3, 5, 8)) -> DataFrame:
    """Hit@k and mean reciprocal rank; an item without a hit counts 0."""
    shares = [F.round(F.avg(F.when(F.col("first_rank") <= k, 1.0).otherwise(0.0)), 6).alias(f"hit_{k}") for k in cuts]
    mrr = F.round(F.avg(F.coalesce(1.0 / F.col("first_rank"), F.lit(0.0))), 6).alias("mrr")
    return (first.groupBy(*by) if by else first).agg(F.count("*").alias("n"), *shares, mrr)


def span_coverage(found: DataFrame, spans: DataFrame, item: str = "item_id", span: str = "span_no") -> DataFrame:
    """Per item the share of its gold spans that some hit overlaps."""
    got = found.select(item, span).distinct().withColumn("_got", F.lit(1))
    return spans.join(got, [item, span], "left").groupBy(item).agg(F.count("*").alias("n_spans"), F.count("_got").alias("covered"), F.round(F.count("_got") / F.count("*"), 6).alias("coverage"))


def distinct_with_null(c: str) -> Column:
    """Distinct values, null being one."""
    return F.count_distinct(c) + F.max(F.col(c).isNull().cast("int"))


def upper_median(c: str) -> Column:
    """The value at place n div 2 (from 0) of the sorted values: the lower half's end, seen from above. Counts values, gathers no lists."""
    return F.expr(f"percentile_disc(0.5) within group (order by `{c}` desc)")


def percentile(c: str, q: float) -> Column:
    """Linear interpolation; 0 without values."""
    return F.coalesce(F.percentile(c, F.lit(q)), F.lit(0.0))


def token_f1(predicted: Column, gold: Column) -> Column:
    """F1 of two word multisets, given as arrays (see functions.text.answer_tokens). Give columns, not expressions: the arrays are read once a word."""
    count = lambda words, w: F.size(F.filter(words, lambda x: x == w))
    common = F.aggregate(F.array_distinct(predicted), F.lit(0), lambda s, w: s + F.least(count(predicted, w), count(gold, w)))
    return F.when((F.size(predicted) == 0) | (F.size(gold) == 0) | (common == 0), F.lit(0.0)).otherwise(2.0 * common / (F.size(predicted) + F.size(gold)))


@F.pandas_udf(DoubleType())
def rouge_l(predicted: pd.Series, gold: pd.Series) -> pd.Series:
    """F-measure of the longest common subsequence of lower-case [a-z0-9]+ tokens, one bit row a token."""
    import re

    def one(a, b):
        x, y = (re.findall("[a-z0-9]+", (t or "").lower()) for t in (a, b))
        if not x or not y:
            return 0.0
        where: dict[str, int] = {}
        for k, w in enumerate(y):
            where[w] = where.get(w, 0) | 1 << k
        row, full = (1 << len(y)) - 1, (1 << len(y)) - 1
        for w in x:  # bit-parallel: zeros of the row are matches so far
            u = row & where.get(w, 0)
            row = ((row + u) | (row - u)) & full
        n = len(y) - bin(row).count("1")
        return 0.0 if not n else 2 * n / (len(x) + len(y))

    return pd.Series([one(a, b) for a, b in zip(predicted, gold, strict=True)], dtype="float64")


def citation_rate(answer: Column) -> Column:
    """Share of sentences over 15 characters that cite a source; null without such sentences."""
    long = F.filter(sentences(answer), lambda s: F.length(s) > 15)
    return F.try_divide(F.size(F.filter(long, lambda s: s.rlike(r"\[\d+\]"))), F.size(long))


def paired(left: DataFrame, right: DataFrame, item: str, value: str, by: list[str] | None = None, tolerance: float = 1e-9) -> DataFrame:
    """How many items get better, worse or stay, of those that both arms have a value for; and the sign test's p."""
    a = left.select(item, *(by or []), F.col(value).alias("_a")).where(F.col("_a").isNotNull())
    b = right.select(item, *(by or []), F.col(value).alias("_b")).where(F.col("_b").isNotNull())
    d = F.col("_b") - F.col("_a")
    joined = a.join(b, [item, *(by or [])])
    out = (joined.groupBy(*by) if by else joined).agg(F.count_if(d > tolerance).alias("better"), F.count_if(d < -tolerance).alias("worse"), F.count_if(F.abs(d) <= tolerance).alias("same"))
    return out.withColumn("p", F.round(sign_test(F.col("better"), F.col("worse")), 6))


def sign_test(better: Column, worse: Column) -> Column:
    """Two-sided exact binomial test of better against worse; 1 without pairs. Terms are summed in logarithms."""
    n, least = (better + worse).cast("int"), F.least(better, worse).cast("int")
    start = F.struct(F.lit(0.0).alias("log"), F.lit(0.0).alias("sum"))
    log_half = F.lit(-math.log(2.0)) * n

    def step(acc: Column, k: Column) -> Column:
        log = F.when(k == 0, F.lit(0.0)).otherwise(acc["log"] + F.log((n - k + 1).cast("double")) - F.log(F.greatest(k, F.lit(1)).cast("double")))
        return F.struct(log.alias("log"), (acc["sum"] + F.exp(log + log_half)).alias("sum"))

    tail = F.aggregate(F.sequence(F.lit(0), least), start, step)["sum"]
    return F.when(n == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), 2 * tail))


def kappa(df: DataFrame, a: str, b: str, by: list[str] | None = None) -> DataFrame:
    """Cohen's kappa of two yes/no judges, and their raw agreement; 1 where chance alone agrees."""
    x, y = F.col(a).cast("double"), F.col(b).cast("double")
    out = (df.groupBy(*by) if by else df).agg(F.count("*").alias("n"), F.avg((F.col(a) == F.col(b)).cast("double")).alias("_po"), F.avg(x).alias("_pa"), F.avg(y).alias("_pb"))
    pe = F.col("_pa") * F.col("_pb") + (1 - F.col("_pa")) * (1 - F.col("_pb"))
    value = F.when(pe >= 1, F.lit(1.0)).otherwise((F.col("_po") - pe) / (1 - pe))
    return out.select(*(by or []), "n", F.round("_po", 6).alias("agreement"), F.round(value, 6).alias("kappa"))


def confusion(df: DataFrame, predicted: str, truth: str, by: list[str] | None = None) -> DataFrame:
    p, t = F.col(predicted), F.col(truth)
    out = (df.groupBy(*by) if by else df).agg(F.count_if(p & t).alias("tp"), F.count_if(p & ~t).alias("fp"), F.count_if(~p & t).alias("fn"), F.count_if(~p & ~t).alias("tn"))
    return out.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn")))


def answer_summary(answers: DataFrame, by: list[str]) -> DataFrame:
    """Refusals of unanswerable items, false refusals and correct answers of answerable ones (a refusal is not correct)."""
    open_ = ~F.col("qtype").eqNullSafe("unanswerable")
    share = lambda c, where: F.round(F.avg(F.when(where, c.cast("double"))), 6)
    return answers.groupBy(*by).agg(
        F.count("*").alias("n"), share(F.col("refused"), ~open_).alias("refusal_rate"), share(F.col("refused"), open_).alias("false_refusal_rate"),
        share(F.col("correct") & ~F.col("refused"), open_).alias("correct_rate"),
    )


def calibration_pairs(items: DataFrame, order: str = "item_id", answer: str = "answer") -> DataFrame:
    """Each item with the next item's reference answer, the last one with the first's; items are few (a gold set)."""
    w = Window.orderBy(order)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return items.withColumn("other_answer", F.coalesce(F.lead(answer).over(w), F.first(answer).over(whole)))


def load_summary(requests: DataFrame, by: list[str], wall: str) -> DataFrame:
    """Requests, successes, latency percentiles, mean throughput, and tokens per second of wall time."""
    good = F.col("ok")
    only = lambda c: F.when(good, F.col(c))
    frame = requests.withColumn("_ttft", only("ttft_s")).withColumn("_e2e", only("e2e_s")).withColumn("_tps", only("tps"))
    return frame.groupBy(*by).agg(
        F.count("*").alias("requests"), F.count_if(good).alias("ok"), F.count_if(~good).alias("failed"),
        *[F.round(percentile(c, q), 3).alias(f"{n}_p{int(100 * q)}") for c, n in (("_ttft", "ttft"), ("_e2e", "e2e")) for q in (0.5, 0.95)],
        F.round(F.coalesce(F.avg("_tps"), F.lit(0.0)), 1).alias("mean_tps"),
        F.round(F.coalesce(F.try_divide(F.sum(F.when(good, F.col("completion_tokens")).otherwise(0)), F.nullif(F.max(wall), F.lit(0.0))), F.lit(0.0)), 1).alias("tokens_per_s"),
    )


def timings(ttft_ms: Column, e2e_ms: Column, tokens: Column) -> Column:
    """Tokens per second while decoding."""
    return F.when(tokens > 0, tokens / F.greatest((e2e_ms - ttft_ms) / 1000.0, F.lit(1e-6))).otherwise(F.lit(0.0))


def verdict(gain: Column, better: Column, faithful: Column, faithful_base: Column, calibrated_low: Column, calibrated_high: Column) -> Column:
    """What a comparison of coverage says: nothing if the judge is outside its band, else by gain, items won and faithfulness kept."""
    void = calibrated_low.isNotNull() & ((calibrated_low > 0.2) | (F.coalesce(calibrated_high, F.lit(0.0)) < 0.8))
    kept = faithful.isNull() | faithful_base.isNull() | (faithful >= faithful_base - 0.15)
    return F.when(void, "UNCALIBRATED").when((gain >= 0.15) & (better >= 6) & kept, "POSITIVE").when((gain <= 0) | (faithful < 0.35), "NEGATIVE").otherwise("MIXED")


def chapter_statistics(chunks: DataFrame) -> DataFrame:
    """Chunks of each chapter (one without a chapter is a group of its own), their mean and largest length, and where the book ends."""
    size = F.col("char_end") - F.col("char_start")
    return chunks.groupBy("book_id", "chapter").agg(F.count("*").alias("n_chunks"), F.round(F.avg(size), 6).alias("mean_chars"), F.max(size).alias("most_chars"), F.max("char_end").alias("extent"))


def chapter_coverage(items: DataFrame, chunks: DataFrame, item: str = "item_id") -> DataFrame:
    """For each item with a set of chapters, how many chunks are in one of them."""
    wanted = items.select(item, F.explode(F.array_distinct("chapters")).alias("chapter"))
    per = chunks.groupBy("chapter").agg(F.count("*").alias("n"))
    return items.select(item).join(wanted.join(per, "chapter").groupBy(item).agg(F.sum("n").alias("n_chunks")), item, "left").withColumn("n_chunks", F.coalesce("n_chunks", F.lit(0)))


def gold_with_controls(items: DataFrame, fixed: list[str], n: int, seed: int = 42) -> DataFrame:
    """Items about the whole book, and `n` control items: those with fixed ids first, then facts in an order of hashes; a control's rubric is its answer."""
    facts = items.where((F.col("qtype") == "fact") | F.col("id").isin(fixed))
    order = Window.orderBy(F.when(F.col("id").isin(fixed), 0).otherwise(1), F.md5(F.concat("id", F.lit(f":{seed}"))))  # a gold set has tens of items
    control = facts.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= n).drop("_k").withColumn("rubric", F.array("answer")).withColumn("control", F.lit(True))
    return items.where("qtype = 'global'").withColumn("control", F.lit(False)).unionByName(control, allowMissingColumns=True)


def model_name(name: Column) -> Column:
    """A model's name for tables: without its size tag's suffixes."""
    return F.regexp_replace(F.regexp_replace(name, r"^.*/", ""), r"-(instruct|it)\b.*$", "")


def projection(vectors: DataFrame, dims: int = 2, vector: str = "vector") -> tuple[DataFrame, list[float]]:
    """(rows with `point`, share of variance of each axis): principal axes of the centred vectors; moments are summed in the tables, axes found on the driver.

    An axis points to where its largest component is positive.
    """
    spots = vectors.select(F.posexplode(vector).alias("i", "x"))
    mean = spots.groupBy("i").agg(F.avg("x").alias("m"))
    centre = np.array([r["m"] for r in sorted(mean.collect())])  # as many as a vector has components
    shifted = F.zip_with(F.col(vector).cast("array<double>"), F.array(*[F.lit(float(c)) for c in centre]), lambda a, b: a - b)
    rows = vectors.withColumn("_v", shifted)
    lines = rows.select(F.posexplode("_v").alias("i", "a"), "_v").select("i", F.transform("_v", lambda b: F.col("a") * b).alias("p")).select("i", F.posexplode("p").alias("j", "p")).groupBy("i", "j").agg(F.sum("p").alias("p"))
    moments = np.zeros((len(centre), len(centre)))
    for r in lines.collect():  # the square of the number of components
        moments[r["i"], r["j"]] = r["p"]
    values, axes = np.linalg.eigh(moments)
    axes = axes[:, ::-1][:, :dims].T
    axes = [a * np.sign(a[np.argmax(np.abs(a))]) for a in axes]
    along = [F.round(F.aggregate(F.zip_with("_v", F.array(*[F.lit(float(c)) for c in a]), lambda p, q: p * q), F.lit(0.0), lambda s, p: s + p), 6) for a in axes]
    total = float(values.sum()) or 1.0
    return rows.withColumn("point", F.array(*along)).drop("_v"), [float(v) / total for v in values[::-1][:dims]]


def health(tables: dict[str, DataFrame], services: dict[str, bool]) -> DataFrame:
    """One row of what is there: how many rows each table has, which services answer, and ok if all do."""
    spark = next(iter(tables.values())).sparkSession
    out = spark.range(1).select(*[F.lit(up).alias(f"{name}_up") for name, up in sorted(services.items())], F.lit("ok" if all(services.values()) else "degraded").alias("status"))
    for name, t in sorted(tables.items()):
        out = out.crossJoin(t.agg(F.count("*").alias(f"n_{name}")))
    return out
