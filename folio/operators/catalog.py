"""The catalog: groups, books, collections, conversations, models, telemetry; queries and changes as joins.

Changes return the new tables; writing them is the caller's (see sources.files.replace_table).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.functions.text import parameter_count, slugify
from folio.operators.ranking import top_k

# --- reading ------------------------------------------------------------------------------------------------------------------


def book_counts(groups: DataFrame, books: DataFrame) -> DataFrame:
    """Every group with its number of books, also 0; books are counted before the join."""
    n = books.groupBy(F.col("group_id").alias("id")).agg(F.count("*").alias("n_books"))
    return groups.join(n, "id", "left").withColumn("n_books", F.coalesce("n_books", F.lit(0)))


def collection_counts(collections: DataFrame, members: DataFrame, books: DataFrame) -> DataFrame:
    """Per collection the numbers of groups and books."""
    n = books.groupBy("group_id").agg(F.count("*").alias("n"))
    inside = members.join(n, "group_id", "left").groupBy(F.col("collection_id").alias("id")).agg(F.count("*").alias("n_groups"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_books"))
    return collections.join(inside, "id", "left").na.fill(0, ["n_groups", "n_books"])


def expand_slugs(slugs: DataFrame, groups: DataFrame, collections: DataFrame, members: DataFrame) -> DataFrame:
    """(slug, group_ids) of what is asked for: a collection's groups, else the slug itself (which then finds what it names, or nothing)."""
    inside = collections.select("slug", F.col("id").alias("collection_id")).join(members, "collection_id").join(groups.select(F.col("id").alias("group_id"), F.col("slug").alias("member")), "group_id")
    lists = inside.groupBy("slug").agg(F.array_sort(F.collect_set("member")).alias("group_ids"))
    return slugs.join(lists, "slug", "left").withColumn("group_ids", F.coalesce("group_ids", F.array("slug")))


def missing(requested: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    return requested.join(existing.select(key), key, "left_anti")


def unique_slugs(names: DataFrame, taken: DataFrame, name: str = "name") -> DataFrame:
    """A free slug for each name, different ones for names that give the same: the slug, else with -2, -3 and so on. A number is also left out if it would make what another
    of the names gives."""
    base = names.withColumn("_base", slugify(F.col(name)))
    base = base.withColumn("_k", F.row_number().over(Window.partitionBy("_base").orderBy(F.col(name))))
    number = r"-([1-9]\d*)$"
    words = taken.select("slug", F.lit(1).alias("_own")).unionByName(base.select(F.col("_base").alias("slug"), F.lit(0).alias("_own"))).groupBy("slug").agg(F.max("_own").alias("_own"))
    used = words.where("_own = 1").select(F.col("slug").alias("_base"), F.lit(1).alias("_n"))
    used = used.unionByName(words.select(F.regexp_replace("slug", number, "").alias("_base"), F.regexp_extract("slug", number, 1).try_cast("int").alias("_n")).where("_n > 1"))
    used = used.groupBy("_base").agg(F.collect_set("_n").alias("_used"))
    none = F.coalesce("_used", F.array().cast("array<int>"))
    # of the first (used + k) numbers k are free at least
    tries = base.join(used, "_base", "left").withColumn("_free", F.element_at(F.array_except(F.sequence(F.lit(1), F.size(none) + F.col("_k")), none), F.col("_k")))
    return tries.withColumn("slug", F.when(F.col("_free") == 1, F.col("_base")).otherwise(F.concat_ws("-", "_base", F.col("_free").cast("string")))).drop("_base", "_k", "_used", "_free")


def chat_models(models: DataFrame) -> DataFrame:
    """Models that complete text, or do not say what they can."""
    return models.where(F.col("capabilities").isNull() | F.array_contains("capabilities", "completion"))


def default_model(wanted: DataFrame, models: DataFrame, default: str) -> DataFrame:
    """(wanted, model): the first name equal but for case, else the default."""
    found = wanted.join(models.select("name", "place"), F.lower("wanted") == F.lower("name"), "left")
    return found.groupBy("wanted").agg(F.coalesce(F.min_by("name", "place"), F.lit(default)).alias("model"))


def conversations_by_date(conversations: DataFrame) -> DataFrame:
    return conversations.orderBy(F.desc("updated_at"), "id")


def last_turns(messages: DataFrame, n: int, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """The last n messages of each conversation."""
    return top_k(messages, n, conv, F.desc(turn), rank="_n").drop("_n")


def conversation_labels(conversations: DataFrame, groups: DataFrame, collections: DataFrame, unknown: str) -> DataFrame:
    """Names of what conversations are about: group or collection by slug, else the slug, else a fixed label."""
    names = groups.select("slug", "name").unionByName(collections.select("slug", "name"))
    names = names.groupBy("slug").agg(F.min("name").alias("label"))
    return conversations.join(names.withColumnRenamed("slug", "group_id"), "group_id", "left").withColumn("label", F.coalesce("label", "group_id", F.lit(unknown)))


# --- telemetry ----------------------------------------------------------------------------------------------------------------


def telemetry(log: DataFrame, by: str = "model") -> DataFrame:
    return log.groupBy(by).agg(
        F.count("*").alias("queries"), F.round(F.avg("ttft_ms"), 1).alias("avg_ttft_ms"), F.round(F.avg("tps"), 1).alias("avg_tps"), F.round(F.avg("completion_tokens"), 1).alias("avg_completion_tokens")
    )


def bars(values: DataFrame, value: str) -> DataFrame:
    """Positive values and their share of the largest in percent."""
    positive = F.when(F.col(value) > 0, F.col(value))
    most = values.agg(F.max(positive).alias("_max"))
    return values.crossJoin(F.broadcast(most)).select(*[c for c in values.columns if c != value], positive.alias(value), F.coalesce(F.round(100.0 * positive / F.col("_max"), 6), F.lit(0.0)).alias("pct"))


def with_metrics(models: DataFrame, metrics: DataFrame) -> DataFrame:
    return models.join(metrics.withColumnRenamed("model", "name"), "name", "left")


# --- changing -----------------------------------------------------------------------------------------------------------------


def create_group(groups: DataFrame, collections: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(groups with the new ones, refused ones with `error`). An explicit slug must be free among groups; else one is made that is free among both."""
    blank = F.trim(F.coalesce("name", F.lit(""))) == ""
    given, unnamed = new.where(~blank & F.col("slug").isNotNull()), new.where(~blank & F.col("slug").isNull()).drop("slug")
    clash = given.join(groups.select("slug"), "slug", "left_semi").withColumn("error", F.lit("conflict"))
    made = unique_slugs(unnamed, groups.select("slug").unionByName(collections.select("slug")))
    good = given.join(groups.select("slug"), "slug", "left_anti").unionByName(made)
    return groups.unionByName(good, allowMissingColumns=True), clash.unionByName(new.where(blank).withColumn("error", F.lit("invalid")))


def delete_groups(slugs: DataFrame, groups: DataFrame, books: DataFrame, members: DataFrame, chunks: DataFrame) -> dict[str, DataFrame]:
    """All four tables without the groups and what hangs on them."""
    gone = groups.join(slugs, "slug", "left_semi").select(F.col("id").alias("group_id"), "slug")
    return {
        "chunks": chunks.join(gone.select(F.col("slug").alias("group_id")), "group_id", "left_anti"), "books": books.join(gone, "group_id", "left_anti"),
        "members": members.join(gone, "group_id", "left_anti"), "groups": groups.join(slugs, "slug", "left_anti"),
    }


def delete_books(keys: DataFrame, books: DataFrame, chunks: DataFrame) -> dict[str, DataFrame]:
    return {"books": books.join(keys, "book_key", "left_anti"), "chunks": chunks.join(keys.withColumnRenamed("book_key", "book_id"), "book_id", "left_anti")}


def create_collection(name: str, slugs: list[str], groups: DataFrame, collections: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(collections, members) with the new one; unknown groups are an error."""
    spark = groups.sparkSession
    wanted = spark.createDataFrame([(s,) for s in slugs], "slug string")
    unknown = [r["slug"] for r in missing(wanted, groups, "slug").collect()]  # at most the slugs given
    if unknown or not slugs:
        raise ValueError(f"unknown groups: {sorted(unknown)}")
    made = unique_slugs(spark.createDataFrame([(name,)], "name string"), groups.select("slug").unionByName(collections.select("slug")))
    number = collections.agg((F.coalesce(F.max("id"), F.lit(0)) + 1).alias("id"))
    row = made.crossJoin(number)
    start = members.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_m"))
    inside = groups.join(wanted, "slug", "left_semi").select(F.col("id").alias("group_id")).crossJoin(row.select(F.col("id").alias("collection_id"))).crossJoin(start)
    numbered = inside.withColumn("id", F.col("_m") + F.row_number().over(Window.orderBy("group_id"))).drop("_m")
    return collections.unionByName(row, allowMissingColumns=True), members.unionByName(numbered, allowMissingColumns=True)


def delete_collections(slugs: DataFrame, collections: DataFrame, members: DataFrame) -> dict[str, DataFrame]:
    gone = collections.join(slugs, "slug", "left_semi").select(F.col("id").alias("collection_id"))
    return {"collections": collections.join(slugs, "slug", "left_anti"), "members": members.join(gone, "collection_id", "left_anti")}


def delete_conversations(ids: DataFrame, conversations: DataFrame, messages: DataFrame) -> dict[str, DataFrame]:
    return {"conversations": conversations.join(ids, "id", "left_anti"), "messages": messages.join(ids.withColumnRenamed("id", "conversation_id"), "conversation_id", "left_anti")}


def ensure_conversations(conversations: DataFrame, asked: DataFrame, now: Column) -> DataFrame:
    """(id, question, group_id) asked: new conversations titled by the first 80 characters, known ones brought up to date."""
    new = asked.select("id", F.substring("question", 1, 80).alias("_title"), F.col("group_id").alias("_group"), F.lit(True).alias("_asked"))
    out = conversations.join(new, "id", "full")
    return out.select(
        "id", F.coalesce("title", "_title").alias("title"), F.coalesce("group_id", "_group").alias("group_id"),
        F.coalesce("created_at", now).alias("created_at"), F.when(F.col("_asked"), now).otherwise(F.col("updated_at")).alias("updated_at"),
    )


def sync_models(known: DataFrame, found: DataFrame, now: Column) -> DataFrame:
    """Found columns replace known ones; curated ones (cutoff date, a parameter count that is set) stay; models not found any more stay too."""
    f = found.select("name", *[F.col(c).alias(f"_{c}") for c in ("family", "parameter_size", "quantization", "context_length")], F.lit(True).alias("_seen"))
    out = known.join(f, "name", "full")
    pick = lambda c: F.when(F.col("_seen"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c)
    source = F.when(F.col("cutoff_date").isNotNull(), "ollama+kuratiert").otherwise("ollama")
    return out.select(
        "name", pick("family"), pick("parameter_size"), F.coalesce("parameter_count", F.when(F.col("_seen"), parameter_count(F.col("_parameter_size")))).alias("parameter_count"),
        pick("quantization"), pick("context_length"), "cutoff_date", F.when(F.col("_seen"), source).otherwise(F.col("source")).alias("source"),
        F.when(F.col("_seen"), now).otherwise(F.col("updated_at")).alias("updated_at"),
    )
