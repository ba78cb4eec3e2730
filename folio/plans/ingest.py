"""Documents to an index: strip the frame, clean, check, cut into overlapping passages, embed, upsert."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.functions import text as T
from folio.functions.vectors import l2_normalize
from folio.lineage import saved
from folio.operators.intervals import as_of
from folio.sources.store import chunk_key

_FRAME = r"(?i)\*\*\* ?{} OF (?:THE|THIS) PROJECT GUTENBERG[^\n]*?\*\*\*"


def parse_frame(texts: DataFrame, text: str = "text") -> DataFrame:
    """Adds body, meta_title, meta_author, meta_language, had_frame: what stands between the frame's lines, if both do and in order."""
    t = F.col(text)
    start_mark, end_mark = _FRAME.format("START"), _FRAME.format("END")
    start, end = F.regexp_instr(t, F.lit(start_mark)), F.regexp_instr(t, F.lit(end_mark))
    after = start + F.length(F.regexp_substr(t, F.lit(start_mark)))
    framed = F.coalesce((start > 0) & (end > 0) & (after <= end), F.lit(False))
    out = texts.withColumn("had_frame", framed).withColumn("body", T.strip(F.when(framed, F.substr(t, after, end - after)).otherwise(t)))
    header = F.substring(t, 1, 5000)
    for name in ("Title", "Author", "Language"):
        out = out.withColumn(f"meta_{name.lower()}", F.nullif(T.strip(F.regexp_extract(header, rf"(?m)^{name}:\s*([^\n]+)$", 1)), F.lit("")))
    return out


def clean_report(texts: DataFrame, text: str = "body", compose: bool = True, most_dropped: float = 0.4) -> DataFrame:
    """Adds `cleaned` and the counters, ratios, samples and warnings of cleaning."""
    first = T.nfc(F.col(text)) if compose else F.col(text)
    out = texts.withColumn("_nfc", first)
    free = T.without_controls(F.col("_nfc"))
    out = out.withColumn("control_chars_removed", T.control_count(F.col("_nfc"))).withColumn("special_chars_normalized", T.special_count(free)).withColumn("_lines", T.unix_lines(T.plain_characters(free)))
    out = out.withColumn("lines_merged", T.joined_count(F.col("_lines"))).withColumn("pagenumber_lines_removed", T.number_lines(F.col("_lines"))).withColumn("cleaned", T.smoothed(T.dewrap(F.col("_lines"))))
    original, now = F.length(text), F.length("cleaned")
    out = out.withColumn("original_chars", original).withColumn("cleaned_chars", now).withColumn("nonascii_ratio_after", T.share_not_ascii(F.col("cleaned")))
    out = out.withColumn("dropped_ratio", F.round(1 - now / F.greatest(original, F.lit(1)), 4)).withColumn("before_sample", T.sample(F.col(text))).withColumn("after_sample", T.sample(F.col("cleaned")))
    return out.withColumn("warnings", T.cleaning_warnings(F.col("dropped_ratio"), F.col("nonascii_ratio_after"), most_dropped)).drop("_nfc", "_lines")


def paragraphs(texts: DataFrame, key: str = "book_id", text: str = "cleaned") -> DataFrame:
    """(key, para, start, paragraph) of texts with blank lines between paragraphs; blank parts are skipped."""
    parts = texts.select(key, F.posexplode(F.split(text, "\n\n", -1)).alias("para", "paragraph"))
    before = Window.partitionBy(key).orderBy("para").rowsBetween(Window.unboundedPreceding, -1)
    placed = parts.withColumn("start", F.coalesce(F.sum(F.length("paragraph") + 2).over(before), F.lit(0)))
    return placed.where(T.strip(F.col("paragraph")) != "")


def heading_marks(paras: DataFrame) -> DataFrame:
    """Adds what heading_rule asks of each paragraph, so that it needs no texts."""
    p = F.col("paragraph")
    norm = T.boilerplate_key(p)
    marks = {"_word": T.is_heading(p), "_caps": T.is_caps_heading(p), "_marker": T.is_marker(p), "_short": F.length(p) <= 150, "_norm": F.sha2(norm, 256), "_named": norm != ""}
    return paras.withColumns(marks)


def heading_rule(marked: DataFrame, key: str = "book_id") -> DataFrame:
    """Adds `heading` to rows of heading_marks and drops the marks. Books go through windows: rows should not carry texts."""
    order = Window.partitionBy(key).orderBy("para")
    out = marked.withColumn("_times", F.count(F.when(F.col("_short"), F.lit(1))).over(Window.partitionBy(key, "_norm"))).withColumn("_any", F.max("_word").over(Window.partitionBy(key)))
    after = F.lag("_marker").over(order) | ((F.lag("_times").over(order) >= 5) & F.lag("_named").over(order))
    caps = F.col("_caps") & F.coalesce(after, F.lit(False))
    return out.withColumn("heading", F.when(F.col("_any"), F.col("_word")).otherwise(caps)).drop("_word", "_caps", "_marker", "_short", "_norm", "_named", "_times", "_any")


def heading_flags(paras: DataFrame, key: str = "book_id") -> DataFrame:
    """Adds `heading`: paragraphs with a chapter word; in books without any, capitals right after a number or a recurring line."""
    return heading_rule(heading_marks(paras), key)


def chapter_starts(flagged: DataFrame, key: str = "book_id") -> DataFrame:
    """(key, offset, title) of headings that are no table of contents."""
    return flagged.where(F.col("heading") & ~T.is_contents(F.col("paragraph"))).select(key, F.col("start").alias("offset"), T.strip(F.col("paragraph")).alias("title"))


def passage_ranges(sizes: np.ndarray, target: int, overlap: int) -> Iterator[tuple[int, int]]:
    """Half-open ranges of paragraphs: each the shortest from its start whose characters, and two more a paragraph, reach `target`; the next one starts
    so far back that `overlap` characters are taken up again, but not as far as the start before. By binary search in running sums."""
    filled, plain = (np.concatenate([[0], np.cumsum(sizes + extra)]) for extra in (2, 0))
    start, n = 0, len(sizes)
    while start < n:
        end = min(n, int(np.searchsorted(filled, filled[start] + target)))
        end = max(end, start + 1)
        yield start, end
        if end == n:
            return
        back = int(np.searchsorted(plain, plain[end] - overlap, side="right")) - 1
        start = min(end, max(start + 1, back))


def _packer(target: int, overlap: int):
    """Ranges of one chapter's paragraphs by their sizes: each passage's start depends on the one before, so a window cannot say it."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("para")
        paras, starts, sizes = (pdf[c].to_numpy() for c in ("para", "start", "size"))
        ranges = list(passage_ranges(sizes.astype(np.int64), target, overlap))
        return pd.DataFrame({
            "book_id": pdf["book_id"].iloc[0], "chapter_no": pdf["chapter_no"].iloc[0], "paras": [paras[a:b] for a, b in ranges],
            "char_start": [starts[a] for a, _ in ranges], "char_end": [starts[b - 1] + sizes[b - 1] for _, b in ranges],
            "chapter": pdf["chapter"].iloc[0], "piece": np.arange(len(ranges)),
        })

    return pack


def _flagged_sizes(paras: DataFrame, key: str) -> DataFrame:
    """Paragraphs without their texts: place, size, `heading` (by the rule of heading_flags), title of those that may be one, `contents`."""
    p = F.col("paragraph")
    norm = T.boilerplate_key(p)
    slim = paras.select(
        key, "para", "start", F.length(p).alias("size"), T.is_heading(p).alias("_word"), T.is_caps_heading(p).alias("_caps"), T.is_marker(p).alias("_marker"), T.is_contents(p).alias("contents"),
        F.md5(norm).alias("_norm"), (norm != "").alias("_named"), F.when(T.is_heading(p) | T.is_caps_heading(p), T.strip(p)).alias("title"),
    )
    words = slim.groupBy(key).agg(F.max("_word").alias("_any"))
    times = slim.groupBy(key, "_norm").agg(F.count(F.when(F.col("size") <= 150, F.lit(1))).alias("_times"))
    slim = slim.join(times, [key, "_norm"]).join(words, key)
    order = Window.partitionBy(key).orderBy("para")
    after = F.lag("_marker").over(order) | ((F.lag("_times").over(order) >= 5) & F.lag("_named").over(order))
    caps = F.col("_caps") & F.coalesce(after, F.lit(False))
    return slim.withColumn("heading", F.when(F.col("_any"), F.col("_word")).otherwise(caps)).select(key, "para", "start", "size", "heading", "title", "contents")


def chunk_paragraphs(paras: DataFrame, target: int = 1800, overlap: int = 200, key: str = "book_id") -> DataFrame:
    """Passages of (key, para, start, paragraph). Headings, chapters and ranges are found by sizes and flags alone; texts are joined to their passages last, so that no
    task holds the text of a book or a chapter."""
    paras = paras.withColumnRenamed(key, "book_id").withColumn("book_id", F.col("book_id").cast("string"))
    flagged = _flagged_sizes(paras, "book_id").where(~F.col("contents"))
    upto = Window.partitionBy("book_id").orderBy("para").rowsBetween(Window.unboundedPreceding, 0)
    title = F.last(F.when(F.col("heading"), F.col("title")), ignorenulls=True).over(upto)
    number = F.count(F.when(F.col("heading"), F.lit(1))).over(upto)
    body = flagged.withColumn("chapter", title).withColumn("chapter_no", number).where(~F.col("heading")).select("book_id", "chapter_no", "chapter", "para", "start", "size")
    shape = "book_id string, chapter_no long, paras array<long>, char_start long, char_end long, chapter string, piece long"
    packed = saved(body.withColumn("para", F.col("para").cast("long")).groupBy("book_id", "chapter_no").applyInPandas(_packer(target, overlap), shape), "ranges")
    counts = packed.groupBy("book_id", "chapter_no").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("book_id").orderBy("chapter_no").rowsBetween(Window.unboundedPreceding, -1)
    offset = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    place = ["book_id", "chapter_no", "piece"]
    lines = packed.select(*place, F.explode("paras").alias("para")).join(paras.select("book_id", F.col("para").cast("long").alias("para"), "paragraph"), ["book_id", "para"])
    lists = lines.groupBy(*place).agg(F.array_sort(F.collect_list(F.struct("para", "paragraph"))).alias("_l"))
    texts = lists.select(*place, F.array_join(F.transform("_l", lambda x: x["paragraph"]), "\n\n").alias("text"))
    out = packed.drop("paras").join(offset, ["book_id", "chapter_no"]).join(texts, place)
    return out.select("book_id", "chapter", (F.col("_before") + F.col("piece")).cast("int").alias("chunk_index"), "text", "char_start", "char_end")


def chunk_books(books: DataFrame, target: int = 1800, overlap: int = 200, key: str = "book_id", text: str = "cleaned") -> DataFrame:
    """(book_id, chapter, chunk_index, text, char_start, char_end): paragraphs packed to about `target` characters within chapters,
    the last ones (`overlap` characters) taken up again."""
    return chunk_paragraphs(paragraphs(books, key, text), target, overlap, key)


def chunk_parts(parts: DataFrame, target: int = 1800, overlap: int = 200) -> DataFrame:
    """The same of books that come in parts (see ingest_parts)."""
    return chunk_paragraphs(paragraphs_of_parts(parts), target, overlap)


def embedding_text(text: Column, context: Column) -> Column:
    return F.when(F.coalesce(context, F.lit("")) != "", F.concat(context, F.lit("\n\n"), text)).otherwise(text)


def points(chunks: DataFrame, books: DataFrame, embed: Callable[[Column], Column], context: Callable[[Column], Column] | None = None) -> DataFrame:
    """Rows of the chunk store: vectors of (contextual) texts at unit length, and what is known of the book."""
    out = chunks.join(books.select("book_id", "group_id", "book_title", "author", (F.col("cleaned_chars") if "cleaned" not in books.columns else F.length("cleaned")).cast("long").alias("book_chars")), "book_id")
    said = F.coalesce(context(F.substring("text", 1, 2400)), F.lit("")) if context else F.lit("")
    out = out.withColumn("context", F.nullif(said, F.lit("")))
    out = out.withColumn("_raw", embed(embedding_text(F.col("text"), F.col("context")))).withColumn("vector", l2_normalize(F.col("_raw")).cast("array<float>")).drop("_raw")
    return out.withColumn("chunk_key", chunk_key(F.col("book_id"), F.col("chunk_index")))


def ingest(texts: DataFrame, embed: Callable[[Column], Column], store=None, context=None, dry_run: bool = False, compose: bool = True) -> tuple[DataFrame, DataFrame]:
    """(report of every book, points of those that pass). texts: book_id, group_id, text, and title as fallback.

    With a store, a book's old points are replaced by its new ones in one rewrite of the groups concerned, once the new ones are there; a dry run makes no points.
    """
    report = clean_report(parse_frame(texts), compose=compose)
    report = report.withColumn("errors", T.document_errors(F.col("cleaned"))).withColumn("book_title", F.coalesce("meta_title", "title")).withColumnRenamed("meta_author", "author")
    good = report.where((F.size("errors") == 0) & F.lit(not dry_run))
    made = points(chunk_books(good), good, embed, context)
    if store is not None and not dry_run:
        made = saved(made, "points")
        store.replace_books(good.select("book_id").distinct(), made)
    return report, made


# --- books in parts -----------------------------------------------------------------------------------------------------------


def _starts(sizes: DataFrame) -> DataFrame:
    """Where each part begins in its book, two characters standing between parts. sizes: book_id, part, size."""
    before = Window.partitionBy("book_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.withColumn("start", F.coalesce(F.sum(F.col("size") + 2).over(before), F.lit(0)))


def _heads(parts: DataFrame, text: str, n: int, name: str) -> DataFrame:
    """(book_id, name): the first n characters of each book; only parts that begin within them are gathered."""
    first = _starts(parts.select("book_id", "part", F.length(text).alias("size"))).where(F.col("start") < n).select("book_id", "part")
    lists = parts.select("book_id", "part", F.substring(text, 1, n).alias("_t")).join(first, ["book_id", "part"]).groupBy("book_id").agg(F.array_sort(F.collect_list(F.struct("part", "_t"))).alias("_l"))
    return lists.select("book_id", F.substring(F.array_join(F.transform("_l", lambda x: x["_t"]), "\n\n"), 1, n).alias(name))


def parse_frame_parts(parts: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """parse_frame for books in parts: (parts with `body`, books with meta_title, meta_author, meta_language, had_frame). A line of the frame stands in one part."""
    t = F.col(text)
    start_mark, end_mark = _FRAME.format("START"), _FRAME.format("END")
    start, end = F.regexp_instr(t, F.lit(start_mark)), F.regexp_instr(t, F.lit(end_mark))
    at = parts.groupBy("book_id").agg(
        F.min(F.when(start > 0, F.struct("part", (start + F.length(F.regexp_substr(t, F.lit(start_mark)))).alias("at")))).alias("_s"),
        F.min(F.when(end > 0, F.struct("part", end.alias("at")))).alias("_e"),
    ).withColumn("had_frame", F.coalesce((F.col("_s.part") < F.col("_e.part")) | ((F.col("_s.part") == F.col("_e.part")) & (F.col("_s.at") <= F.col("_e.at"))), F.lit(False)))
    cut = parts.join(at, "book_id")
    low, high = (F.when(F.col("part") == F.col(f"_{x}.part"), F.col(f"_{x}.at")) for x in "se")
    inside = F.substr(t, F.coalesce(low, F.lit(1)), F.coalesce(high, F.length(t) + 1) - F.coalesce(low, F.lit(1)))
    cut = cut.where(~F.col("had_frame") | F.col("part").between(F.col("_s.part"), F.col("_e.part"))).withColumn("body", F.when(F.col("had_frame"), inside).otherwise(t)).select(*parts.columns, "body")
    # white space goes at both ends of the book, so blank parts there too
    ends = cut.where(T.strip(F.col("body")) != "").groupBy("book_id").agg(F.min("part").alias("_a"), F.max("part").alias("_b"))
    cut = cut.join(ends, "book_id").where(F.col("part").between(F.col("_a"), F.col("_b")))
    cut = cut.withColumn("body", F.when(F.col("part") == F.col("_a"), F.regexp_replace("body", r"(?U)^\s+", "")).otherwise(F.col("body")))
    cut = cut.withColumn("body", F.when(F.col("part") == F.col("_b"), F.regexp_replace("body", r"(?U)\s+$", "")).otherwise(F.col("body"))).drop("_a", "_b")
    books = at.select("book_id", "had_frame").join(_heads(parts, text, 5000, "_head"), "book_id")
    for name in ("Title", "Author", "Language"):
        books = books.withColumn(f"meta_{name.lower()}", F.nullif(T.strip(F.regexp_extract("_head", rf"(?m)^{name}:\s*([^\n]+)$", 1)), F.lit("")))
    return cut, books.drop("_head")


def clean_report_parts(parts: DataFrame, compose: bool = True, most_dropped: float = 0.4) -> tuple[DataFrame, DataFrame]:
    """clean_report and document_errors for books in parts: (parts with `cleaned`, blank ones left out; books with the report's columns but `cleaned`).

    Every rule of cleaning ends at a blank line, and one stands between parts; so parts are cleaned one by one and their counts are summed.
    """
    summed = ["control_chars_removed", "special_chars_normalized", "lines_merged", "pagenumber_lines_removed"]
    c = F.col("cleaned")
    counts = {"cleaned_chars": F.length(c), "_ascii": F.regexp_count(c, F.lit(r"[^\x00-\x7f]")), "_dense": F.length(F.regexp_replace(c, r"(?U)\s+", "")), "_garbled": F.regexp_count(c, F.lit("\ufffd")), "_letters": F.regexp_count(c, F.lit(r"\p{L}"))}
    done = clean_report(parts, compose=compose).select("book_id", "part", "cleaned", "original_chars", F.substring("body", 1, 300).alias("_body"), *summed)
    done = saved(done, "cleaned").select("*", *[v.alias(k) for k, v in counts.items()])  # counted after saving: cleaning would be done again for each count
    total = lambda x: F.sum(x).alias(x)
    joined = lambda x, n: (F.sum(x) + 2 * F.greatest(n - 1, F.lit(0))).alias(x)  # noqa: E731  blank lines between parts
    books = done.groupBy("book_id").agg(*[total(x) for x in (*summed, *counts) if x != "cleaned_chars"], joined("original_chars", F.count("*")), joined("cleaned_chars", F.count_if(F.col("cleaned_chars") > 0)))
    size = F.col("cleaned_chars")
    books = books.withColumn("nonascii_ratio_after", F.round(F.col("_ascii") / F.greatest(size, F.lit(1)), 4)).withColumn("dropped_ratio", F.round(1 - size / F.greatest("original_chars", F.lit(1)), 4))
    books = books.withColumn("warnings", T.cleaning_warnings(F.col("dropped_ratio"), F.col("nonascii_ratio_after"), most_dropped))
    books = books.withColumn("errors", T.counted_errors(size, F.col("_garbled"), F.col("_letters"), F.col("_dense"))).drop(*[x for x in counts if x != "cleaned_chars"])
    kept = done.where("cleaned <> ''").select("book_id", "part", "cleaned")
    for name, df, text in (("before_sample", done.withColumn("_t", F.col("_body")), "_t"), ("after_sample", kept, "cleaned")):
        books = books.join(_heads(df, text, 300, name), "book_id", "left").withColumn(name, T.collapse(F.coalesce(name, F.lit(""))))
    return kept, books


def paragraphs_of_parts(parts: DataFrame) -> DataFrame:
    """`paragraphs` of books in parts: (book_id, para, start, paragraph)."""
    split = F.split("cleaned", "\n\n", -1)
    order = Window.partitionBy("book_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    placed = _starts(parts.select("book_id", "part", F.length("cleaned").alias("size"), F.size(split).alias("_n"))).withColumn("_para", F.coalesce(F.sum("_n").over(order), F.lit(0)))
    pieces = parts.join(placed.select("book_id", "part", F.col("start").alias("_at"), "_para"), ["book_id", "part"]).select("book_id", "part", "_at", "_para", F.posexplode(split).alias("_i", "paragraph"))
    within = Window.partitionBy("book_id", "part").orderBy("_i").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.withColumn("start", F.col("_at") + F.coalesce(F.sum(F.length("paragraph") + 2).over(within), F.lit(0)))
    return pieces.select("book_id", (F.col("_para") + F.col("_i")).alias("para"), "start", "paragraph").where(T.strip(F.col("paragraph")) != "")


def ingest_parts(parts: DataFrame, books: DataFrame, embed: Callable[[Column], Column], store=None, context=None, dry_run: bool = False, compose: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """`ingest` for books of any length: (report of every book, points of those that pass, cleaned parts of all).

    parts: book_id, part (ascending, one row each), text; a book's text is its parts with a blank line between them. books: book_id, group_id, title. No task holds a whole book's text.
    """
    framed, meta = parse_frame_parts(parts.where("text is not null"))
    cleaned, counted = clean_report_parts(framed, compose=compose)
    report = books.join(meta, "book_id").join(counted, "book_id", "left")
    # a book of blank parts alone is an empty text
    empty = {"before_sample": F.lit(""), "after_sample": F.lit(""), "nonascii_ratio_after": F.lit(0.0), "dropped_ratio": F.lit(1.0), "warnings": T.cleaning_warnings(F.lit(1.0), F.lit(0.0)), "errors": F.array(F.lit("too_short"))}
    report = report.select(*[c for c in report.columns if c not in counted.columns or c == "book_id"], *[F.coalesce(c, empty.get(c, F.lit(0))).alias(c) for c in counted.columns if c != "book_id"])
    report = saved(report.withColumn("book_title", F.coalesce("meta_title", "title")).withColumnRenamed("meta_author", "author"), "report")
    good = report.where((F.size("errors") == 0) & F.lit(not dry_run))
    made = points(chunk_parts(cleaned.join(good.select("book_id"), "book_id", "left_semi")), good, embed, context) if not dry_run else None
    if store is not None and not dry_run:
        made = saved(made, "points")
        store.replace_books(good.select("book_id").distinct(), made)
    return report, made, cleaned


def reembed(chunks: DataFrame, contexts: DataFrame, embed: Callable[[Column], Column]) -> DataFrame:
    """Chunks with contexts from a checkpoint and vectors made anew."""
    out = chunks.drop("context", "vector").join(contexts.select("chunk_key", "context"), "chunk_key", "left")
    return out.withColumn("_raw", embed(embedding_text(F.col("text"), F.col("context")))).withColumn("vector", l2_normalize(F.col("_raw")).cast("array<float>")).drop("_raw")


def text_mismatches(chunks: DataFrame, books: DataFrame) -> DataFrame:
    """Chunks whose text is not what the book has at their offsets."""
    whole = books.select("book_id", F.col("cleaned").alias("_book"))
    there = F.substr(F.col("_book"), (F.col("char_start") + 1).cast("int"), (F.col("char_end") - F.col("char_start")).cast("int"))
    return chunks.join(whole, "book_id").where(F.col("text") != there).drop("_book")


def backfill_chapters(chunks: DataFrame, books: DataFrame) -> DataFrame:
    """Chapters of stored chunks by the last heading at or before their start; refuses books whose text has changed. Books without headings only get their length."""
    wrong = text_mismatches(chunks, books).count()
    if wrong:
        raise ValueError(f"{wrong} chunks differ from the book's text")
    heads = chapter_starts(heading_flags(paragraphs(books)))
    dated = as_of(chunks.drop("chapter", "book_chars"), heads, "book_id", "char_start", "offset", "title", "chapter")
    old = chunks.select("chunk_key", F.col("chapter").alias("_old"))
    sizes = books.select("book_id", F.length("cleaned").cast("long").alias("book_chars"))
    has = heads.select("book_id", F.lit(True).alias("_has")).distinct()
    out = dated.join(sizes, "book_id").join(has, "book_id", "left").join(old, "chunk_key")
    return out.withColumn("chapter", F.when(F.col("_has"), F.col("chapter")).otherwise(F.col("_old"))).drop("_old", "_has")
