"""Registered queries over the fixture tables, each with the SQL that gives the same rows.

The adapters below turn the tables into what the operators work on: vectors into chunks of books, documents into paragraphs
of books, events into telemetry, and so on. In SQL they are common table expressions of the same names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folio.config import Settings
from folio.functions import json as J
from folio.functions import text as T
from folio.functions.vectors import l2_normalize
from folio.lineage import saved
from folio.models import HashEmbedder, complete, embed, lexical_score
from folio.operators import catalog, communities, evaluation, graph, intervals, lexical, ranking
from folio.operators.ranking import top_k
from folio.plans import answer as A
from folio.plans import generation as G
from folio.plans import ingest as I
from folio.plans import retrieval as R
from folio.sources import files, store
from folio.streaming import events as E

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# --- adapters -----------------------------------------------------------------------------------------------------------------


def chunks(spark: SparkSession, d: str) -> DataFrame:
    """Vectors as chunks: a label is a book, neighbours overlap by 200 characters."""
    order = Window.partitionBy("label").orderBy("vec_id")
    out = t(spark, d, "embeddings").withColumn("chunk_index", (F.row_number().over(order) - 1).cast("long"))
    return out.select(
        "vec_id", F.concat(F.lit("b"), "label").alias("book_id"), F.concat(F.lit("g"), F.col("label") % 4).alias("group_id"), "chunk_index",
        F.concat(F.lit("b"), F.col("label"), F.lit(":"), F.col("chunk_index")).alias("chunk_key"), (1600 * F.col("chunk_index")).alias("char_start"),
        (1600 * F.col("chunk_index") + 1800).alias("char_end"), l2_normalize(F.col("embedding")).alias("vector"),
    )


def chunks_once(spark: SparkSession, d: str) -> DataFrame:
    """The same, saved: for queries that read them several times, as each reading would number and normalise them anew."""
    return saved(chunks(spark, d), "chunks")


def asked(c: DataFrame) -> DataFrame:
    """Every vector whose id is divisible by 20 asks; its own chunk is no candidate."""
    return c.where(F.col("vec_id") % 20 == 0).select(F.col("vec_id").alias("query_id"), F.col("vector").alias("query_vector"), F.col("book_id").alias("query_book"), F.col("chunk_index").alias("query_index"))


OTHER = "vec_id"
OTHERS = f"{OTHER} <> query_id"

CHUNKS = """
ch as (select vec_id, 'b' || label as book_id, 'g' || (label % 4) as group_id, ci as chunk_index, 'b' || label || ':' || ci as chunk_key, 1600 * ci as char_start, 1600 * ci + 1800 as char_end,
        list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) as vector
      from (select *, embedding::double[] as v, row_number() over (partition by label order by vec_id) - 1 as ci from embeddings)),
qs as (select vec_id as query_id, vector as query_vector, book_id as query_book, chunk_index as query_index from ch where vec_id % 20 = 0),
sc as (select query_id, query_book, query_index, ch.* exclude (vector), round(list_dot_product(vector, query_vector), 6) as score from ch, qs where vec_id <> query_id)"""


def ranked_sql(k: int, where: str = "true") -> str:
    return f"select * from (select *, row_number() over (partition by query_id order by score desc, chunk_key) as rank from sc where {where}) where rank <= {k}"


FOLD = """(select query_id, unnest(list_transform(range(1, len(kept) + 1), lambda i: {'p': i, 'h': kept[i]}), recursive := false) as u from
  (select query_id, list_reduce(list_prepend([]::struct(rank bigint, chunk_key varchar, book_id varchar, chunk_index bigint, char_start bigint, char_end bigint)[], list_transform(hits, lambda h: [h])),
     lambda acc, x: case when len(acc) >= {LIMIT} or len(list_filter(acc, lambda y: y.book_id = x[1].book_id and y.char_start < x[1].char_end and x[1].char_start < y.char_end)) > 0 then acc else list_concat(acc, x) end) as kept
   from (select query_id, list({'rank': rank, 'chunk_key': chunk_key, 'book_id': book_id, 'chunk_index': chunk_index, 'char_start': char_start, 'char_end': char_end} order by rank) as hits from rk group by query_id)))"""


def dedup_sql(limit: int) -> str:
    return f"select query_id, u.p as rank, u.h.chunk_key as chunk_key, u.h.book_id as book_id, u.h.chunk_index as chunk_index, u.h.char_start as char_start, u.h.char_end as char_end from {FOLD.replace('{LIMIT}', str(limit))}"


def paragraphs_of_books(spark: SparkSession, d: str) -> DataFrame:
    """Documents as paragraphs: a source is a book, its documents in order of id are its paragraphs."""
    docs = t(spark, d, "documents").select(F.col("source").alias("book_id"), F.col("doc_id").alias("para"), F.replace(F.col("text"), F.lit("\n"), F.lit(" ")).alias("paragraph"))
    before = Window.partitionBy("book_id").orderBy("para").rowsBetween(Window.unboundedPreceding, -1)
    return docs.withColumn("start", F.coalesce(F.sum(F.length("paragraph") + 2).over(before), F.lit(0)))


PARAS = """
pa as (select source as book_id, doc_id as para, replace(text, chr(10), ' ') as paragraph,
        coalesce(sum(length(text) + 2) over (partition by source order by doc_id rows between unbounded preceding and 1 preceding), 0)::bigint as start from documents)"""


def query_log(spark: SparkSession, d: str) -> DataFrame:
    tokens = F.get_json_object("props", "$.k").cast("long")
    return t(spark, d, "events").select("event_id", "ts", F.col("event_type").alias("model"), F.when(F.col("user_id") % 11 > 0, F.col("value")).alias("ttft_ms"), tokens.alias("completion_tokens"), (tokens / 8.0).alias("tps"), (F.col("value") * 3).alias("e2e_ms"), "user_id")


LOG = """
lg as (select event_id, ts, event_type as model, case when user_id % 11 > 0 then value end as ttft_ms, (props->>'$.k')::bigint as completion_tokens, (props->>'$.k')::bigint / 8.0::double as tps, value * 3 as e2e_ms, user_id from events)"""


def cited_answers(spark: SparkSession, d: str) -> DataFrame:
    c = t(spark, d, "conversations").where("role = 'assistant'")
    return c.select("conv_id", "turn", F.concat("text", F.lit(" ["), (F.col("turn") % 9).cast("string"), F.lit("] Und [2].")).alias("answer"))


ANSWERS = """
an as (select conv_id, turn, text || ' [' || (turn % 9) || '] Und [2].' as answer from conversations where role = 'assistant')"""


def entity_graph(spark: SparkSession, d: str, once: bool = False) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """Capitalised words of six letters or more are entities of a document, one after the other in the alphabet related. `once`: the words are saved, as texts are else searched for every use."""
    docs = t(spark, d, "documents")
    words = F.array_sort(F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Z][a-z]{5,}"), F.lit(0))))
    lists = docs.select(F.col("doc_id").alias("chunk_key"), words.alias("w"))
    lists = saved(lists, "words") if once else lists
    mentions = lists.select("chunk_key", F.explode("w").alias("entity_id"))
    n = docs.count()
    nodes = mentions.groupBy("entity_id").agg(F.count("*").alias("n_mentions")).withColumn("idf", graph.idf(F.col("n_mentions"), n))
    pair = F.transform(F.sequence(F.lit(1), F.size("w") - 1), lambda i: F.struct(F.get("w", i - 1).alias("src"), F.get("w", i).alias("dst")))
    edges = lists.where(F.size("w") > 1).select(F.explode(pair).alias("p")).groupBy("p.src", "p.dst").agg(F.count("*").alias("weight"))
    return nodes, edges, mentions, n


ENTITIES = """
li as (select doc_id as chunk_key, list_sort(list_distinct(regexp_extract_all(text, '[A-Z][a-z]{5,}'))) as w from documents),
me as (select chunk_key, unnest(w) as entity_id from li),
no as (select entity_id, count(*) as n_mentions, round(ln((select count(*) from documents)::double / count(*)), 4) as idf from me group by 1),
ed as (select src, dst, count(*) as weight from (select unnest(w[1:len(w) - 1]) as src, unnest(w[2:]) as dst from li where len(w) > 1) group by 1, 2),
bo as (select src, dst, weight from ed union all select dst, src, weight from ed)"""


def linked_entities(spark: SparkSession, d: str, mentions: DataFrame) -> DataFrame:
    """Documents whose id is divisible by 20 ask; an entity of theirs is the more alike the more letters it has."""
    scores = mentions.where(F.col("chunk_key") % 20 == 0).select(F.col("chunk_key").alias("query_id"), "entity_id", F.round(0.30 + 0.05 * (F.length("entity_id") % 9), 6).alias("score"))
    return graph.link_entities(scores)


LINKED = ENTITIES + """,
ln as (select * exclude (rank) from (select chunk_key as query_id, entity_id, round(0.30 + 0.05 * (length(entity_id) % 9), 6)::double as score,
         row_number() over (partition by chunk_key order by round(0.30 + 0.05 * (length(entity_id) % 9), 6) desc, entity_id) as rank from me where chunk_key % 20 = 0) where rank <= 5 and score >= 0.45),
nb as (select * from (select *, row_number() over (partition by src order by weight desc, dst) as n from bo) where n <= 3),
ac as (select query_id, entity_id, round(max(a), 6) as activation from (
         select query_id, entity_id, score as a from ln union all
         select l.query_id, nb.dst, 0.5 * l.score from ln l join nb on l.entity_id = nb.src where not exists (select 1 from ln x where x.query_id = l.query_id and x.entity_id = nb.dst)) group by 1, 2)"""


def nearest(spark: SparkSession, d: str) -> DataFrame:
    """Each vector with its most similar other one: edges of a graph. Of the first two one at most is the vector itself. Saved, as callers read it several times."""
    c = chunks(spark, d)
    q = c.select(F.col("vec_id").alias("query_id"), F.col("vector").alias("query_vector"))
    two = ranking.dense_top_k_blocks(c, q, 2, 64, key="vec_id").drop("rank").where(OTHERS)
    best = top_k(two, 1, "query_id", F.desc("score"), F.col("vec_id"))
    name = lambda x: F.format_string("v%06d", x)
    return saved(best.select(name(F.least("query_id", "vec_id")).alias("src"), name(F.greatest("query_id", "vec_id")).alias("dst"), F.lit(1).alias("weight")).distinct(), "nearest")


NEAREST = """
cv as (select vec_id, label, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) as vector from (select *, embedding::double[] as v from embeddings)),
ps as (select q.vec_id as query_id, c.vec_id, round(list_dot_product(c.vector, q.vector), 6) as score from cv c, cv q where c.vec_id <> q.vec_id),
ne as (select distinct printf('v%06d', least(query_id, vec_id)) as src, printf('v%06d', greatest(query_id, vec_id)) as dst, 1 as weight from
        (select *, row_number() over (partition by query_id order by score desc, vec_id) as r from ps) where r = 1)"""

# --- retrieval ----------------------------------------------------------------------------------------------------------------


@query(f"with {CHUNKS} select query_id, rank, chunk_key, score from ({ranked_sql(8)})")
def dense_topk(spark, d):
    c = chunks(spark, d)
    return ranking.dense_top_k(c, asked(c), 8, other=OTHER).select("query_id", "rank", "chunk_key", "score")


@query(f"with {CHUNKS} select query_id, rank, chunk_key, score from (select *, row_number() over (partition by query_id order by score desc, chunk_key) as rank from (select q.query_id, c.chunk_key, round(list_dot_product(c.vector, q.query_vector), 6) as score from ch c, qs q)) where rank <= 5")
def dense_topk_blocks(spark, d):
    c = chunks(spark, d)
    return ranking.dense_top_k_blocks(c, asked(c), 5, 64).select("query_id", "rank", "chunk_key", "score")


@query(f"with {CHUNKS}, rk as ({ranked_sql(16)}) {dedup_sql(8)}")
def dense_dedup(spark, d):
    c = chunks(spark, d)
    return ranking.retrieve(c, asked(c), 8, other=OTHER).select("query_id", "rank", "chunk_key", "book_id", "chunk_index", "char_start", "char_end")


@query(f"""with {CHUNKS} select query_id, rank, chunk_key, group_id from ({ranked_sql(5, "group_id in ('g0', 'g2')")})""")
def dense_group_filter(spark, d):
    c = chunks(spark, d)
    few = ranking.group_filter(c, group="g1", groups=["g0", "g2"])
    return ranking.dense_top_k(few, asked(c), 5, other=OTHER).select("query_id", "rank", "chunk_key", "group_id")


def _gold(c: DataFrame) -> DataFrame:
    """The two neighbours of the asking chunk are its gold spans."""
    q = asked(c).select(F.col("query_id").alias("item_id"), F.col("query_book").alias("book_id"), F.explode(F.array(F.struct(F.lit(0).alias("span_no"), (F.col("query_index") - 1).alias("i")), F.struct(F.lit(1).alias("span_no"), (F.col("query_index") + 1).alias("i")))).alias("s"))
    return q.where("s.i >= 0").select("item_id", "book_id", "s.span_no", (1600 * F.col("s.i")).alias("span_start"), (1600 * F.col("s.i") + 1800).alias("span_end"))


GOLD = """
gs as (select query_id as item_id, query_book as book_id, span_no, 1600 * i as span_start, 1600 * i + 1800 as span_end from
        (select query_id, query_book, 0 as span_no, query_index - 1 as i from qs union all select query_id, query_book, 1, query_index + 1 from qs) where i >= 0)"""


def _span_hits(c: DataFrame, found: DataFrame) -> DataFrame:
    """(item_id, rank, span_no) of hits that overlap a gold span of their question."""
    hits = found.select(F.col("query_id").alias("item_id"), "rank", "book_id", "char_start", "char_end").withColumn("key", F.concat_ws("|", F.col("item_id").cast("string"), "book_id"))
    gold = _gold(c).withColumn("key", F.concat_ws("|", F.col("item_id").cast("string"), "book_id")).select("key", "span_no", "span_start", "span_end")
    return intervals.overlap_join(hits, gold, "key", 4000).select("item_id", "rank", "span_no")


def _both_first(spark: SparkSession, d: str, k: int) -> tuple[DataFrame, DataFrame]:
    """First hits of both arms, dense and without overlaps, from one ranking: the dense arm is its beginning."""
    c = chunks_once(spark, d)
    items = asked(c).select(F.col("query_id").alias("item_id"))
    found = saved(ranking.dense_top_k(c, asked(c), k + ranking.OVERFETCH, other=OTHER).select("query_id", "rank", "chunk_key", "book_id", "char_start", "char_end"), "ranking")
    dense, dedup = (evaluation.first_hits(_span_hits(c, arm).withColumn("hit", F.lit(True)), items) for arm in (found.where(F.col("rank") <= k), ranking.dedup_overlaps(found, k)))
    return dense, dedup


FIRST = """
{p}h as (select item_id, r.rank, span_no from {p}rk r join gs on r.query_id = gs.item_id and r.book_id = gs.book_id and r.char_start < span_end and span_start < r.char_end),
{p}f as (select query_id as item_id, min(rank) as first_rank from qs left join {p}h h on h.item_id = query_id group by 1)"""
METRICS = ", ".join(f"round(avg(case when first_rank <= {k} then 1.0::double else 0.0 end), 6) as hit_{k}" for k in (1, 3, 5, 8)) + ", round(avg(coalesce(1.0::double / first_rank, 0.0)), 6) as mrr"
ARMS = f"with {CHUNKS}, {GOLD}, ark as ({ranked_sql(8)}), rk as ({ranked_sql(16)}), brk as ({dedup_sql(8)}), {FIRST.replace('{p}', 'a')}, {FIRST.replace('{p}', 'b')}"


@query(f"{ARMS} select 'dense' as arm, count(*) as n, {METRICS} from af union all select 'dedup', count(*), {METRICS} from bf")
def hit_mrr_by_k(spark, d):
    dense, dedup = _both_first(spark, d, 8)
    return evaluation.hit_and_mrr(dense.withColumn("arm", F.lit("dense")).unionByName(dedup.withColumn("arm", F.lit("dedup"))), ["arm"])


@query(f"{ARMS} select gs.item_id, count(*) as n_spans, count(g.span_no) as covered, round(count(g.span_no)::double / count(*), 6) as coverage from gs left join (select distinct item_id, span_no from ah) g on g.item_id = gs.item_id and g.span_no = gs.span_no group by 1")
def span_coverage(spark, d):
    c = chunks(spark, d)
    return evaluation.span_coverage(_span_hits(c, ranking.dense_top_k(c, asked(c), 8, other=OTHER)), _gold(c).select("item_id", "span_no"))


SIGN = """case when better + worse = 0 then 1.0 else least(1.0, 2 * list_sum(list_transform(range(0, (least(better, worse) + 1)::int), lambda k: exp(lgamma(better + worse + 1) - lgamma(k + 1) - lgamma(better + worse - k + 1) - (better + worse) * ln(2::double))))) end"""


@query(f"""{ARMS}, pr as (select count(*) filter (y - x > 1e-9) as better, count(*) filter (y - x < -1e-9) as worse, count(*) filter (abs(y - x) <= 1e-9) as same
  from (select coalesce(1.0::double / af.first_rank, 0) as x, coalesce(1.0::double / bf.first_rank, 0) as y from af join bf using (item_id))) select *, round({SIGN}, 6) as p from pr""")
def paired_rank_sign_test(spark, d):
    rr = F.coalesce(1.0 / F.col("first_rank"), F.lit(0.0))
    dense, dedup = _both_first(spark, d, 8)
    return evaluation.paired(dense.withColumn("rr", rr), dedup.withColumn("rr", rr), "item_id", "rr")


@query(f"""with {CHUNKS}, rk as ({ranked_sql(8)}), ex as (select r.query_id, r.rank, n.char_start, n.char_end, n.chunk_index from rk r join ch n on n.book_id = r.book_id and abs(n.chunk_index - r.chunk_index) <= 1 where r.rank <= 3)
  select query_id, rank, count(*) as pieces, min(char_start)::bigint as char_start, max(char_end)::bigint as char_end from ex group by 1, 2""")
def neighbour_expand(spark, d):
    c = chunks(spark, d)
    top = ranking.dense_top_k(c, asked(c), 8, other=OTHER).where("rank <= 3")
    wanted = top.select("query_id", "rank", "book_id", F.explode(F.sequence(F.greatest(F.col("chunk_index") - 1, F.lit(0)), F.col("chunk_index") + 1)).alias("chunk_index"))
    return wanted.join(c.select("book_id", "chunk_index", "char_start", "char_end"), ["book_id", "chunk_index"]).groupBy("query_id", "rank").agg(F.count("*").alias("pieces"), F.min("char_start").alias("char_start"), F.max("char_end").alias("char_end"))


def _half(c: DataFrame, part: int) -> DataFrame:
    cut = F.slice("vector", 1 + 32 * part, 32)
    return c.withColumn("vector", cut)


def _two_rankings(spark, d, k):
    c = chunks_once(spark, d)
    out = []
    for part in (0, 1):
        h = _half(c, part)
        out.append(ranking.dense_top_k(h, asked(h), k, other=OTHER).select("query_id", "rank", "chunk_key"))
    return out


TWO = f"""with {CHUNKS}, r0 as (select query_id, chunk_key, row_number() over (partition by query_id order by s desc, chunk_key) as rank from (select query_id, chunk_key, round(list_dot_product(vector[1:32], query_vector[1:32]), 6) as s from ch, qs where vec_id <> query_id)),
r1 as (select query_id, chunk_key, row_number() over (partition by query_id order by s desc, chunk_key) as rank from (select query_id, chunk_key, round(list_dot_product(vector[33:64], query_vector[33:64]), 6) as s from ch, qs where vec_id <> query_id)),
al as (select query_id, chunk_key, 0 as l, rank from r0 where rank <= 30 union all select query_id, chunk_key, 1, rank from r1 where rank <= 30)"""


@query(f"{TWO} select query_id, rank, chunk_key, score from (select query_id, chunk_key, score, row_number() over (partition by query_id order by score desc, f.l, f.rank, chunk_key) as rank from (select query_id, chunk_key, round(sum(1.0::double / (60 + rank)), 6) as score, min({{'l': l, 'rank': rank}}) as f from al group by 1, 2)) where rank <= 10")
def rrf_hybrid(spark, d):
    return ranking.rrf(_two_rankings(spark, d, 30), 10).select("query_id", "rank", "chunk_key", "score")


@query(f"{TWO} select query_id, chunk_key, row_number() over (partition by query_id order by rank, l) as rank from (select *, row_number() over (partition by query_id, chunk_key order by rank, l) as o from al) where o = 1")
def interleave_rankings(spark, d):
    return ranking.interleave(_two_rankings(spark, d, 30)).select("query_id", "chunk_key", "rank")


@query(f"{TWO} select query_id, rank, chunk_key from (select r0.query_id, r0.chunk_key, row_number() over (partition by r0.query_id order by r1.rank desc, r0.rank) as rank from r0 join r1 using (query_id, chunk_key) where r0.rank <= 30) where rank <= 8")
def rerank_topk(spark, d):
    first, _ = _two_rankings(spark, d, 30)
    c = _half(chunks(spark, d), 1)
    # ranks among the hits themselves: in the same order as their ranks among all chunks
    scored = top_k(R.similarity(first, c, asked(c)), 2**31 - 1, "query_id", F.desc("score"), F.col("chunk_key")).select("query_id", "chunk_key", F.col("rank").alias("rerank_score"))
    return ranking.rerank(first, scored, 8).select("query_id", "rank", "chunk_key")


BENCH = """
tk as (select doc_id, list_filter(regexp_extract_all(lower(text), '[a-zäöüß0-9]+'), lambda x: length(x) > 1) as w from documents),
po as (select doc_id, term, count(*) as tf from (select doc_id, unnest(w) as term from tk) group by 1, 2),
qp as (select query_id, term, count(*) as qtf from (select item_id as query_id, unnest(list_filter(regexp_extract_all(lower(text), '[a-zäöüß0-9]+'), lambda x: length(x) > 1)) as term from benchmark) group by 1, 2)"""


def _bench(spark, d):
    return t(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


@query(f"with {BENCH} select term, count(*) as df, sum(tf)::bigint as occurrences from po group by 1")
def token_df(spark, d):
    return lexical.postings(t(spark, d, "documents"), "doc_id", "text").groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("occurrences"))


@query(f"""with {BENCH}, st as (select count(*) as n, avg(len(w)) as avgdl from tk), ra as (select term, ln((n - count(*) + 0.5::double) / (count(*) + 0.5)) as raw from po, st group by term, n),
  idf as (select term, case when raw < 0 then 0.25 * (select avg(raw) from ra) else raw end as idf from ra),
  sco as (select query_id, doc_id, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(w) / avgdl))), 6) as score from qp join idf using (term) join po using (term) join tk using (doc_id), st group by 1, 2)
  select query_id, rank, doc_id, score from (select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from sco where score > 0) where rank <= 10""")
def bm25_topk(spark, d):
    return lexical.bm25(t(spark, d, "documents"), _bench(spark, d), 10).select("query_id", "rank", "doc_id", "score")


def _weights(df: DataFrame, key: str, text: str) -> DataFrame:
    """Learned weights' stand-in: a word weighs its length over the text's. Words are made distinct by grouping; array_distinct compares strings pair by pair."""
    posts = lexical.postings(df, key, text)
    n = posts.groupBy(key).agg(F.sum("tf").alias("n"))
    entry = F.struct("term", (F.length("term") / (10.0 + F.col("n"))).alias("w"))
    return posts.join(n, key).groupBy(key).agg(F.map_from_entries(F.collect_list(entry)).alias("weights"))


@query(f"""with {BENCH}, sq as (select query_id, doc_id, round(sum((length(term) / (10.0::double + len(w))) * (length(term) / (10.0::double + qn))), 6) as score from qp join (select query_id, sum(qtf) as qn from qp group by 1) using (query_id) join po using (term) join tk using (doc_id) group by 1, 2)
  select query_id, rank, doc_id, score from (select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from sq where score > 0) where rank <= 10""")
def sparse_dot(spark, d):
    return lexical.sparse_top_k(_weights(t(spark, d, "documents"), "doc_id", "text"), _weights(_bench(spark, d), "query_id", "query"), 10, key="doc_id").select("query_id", "rank", "doc_id", "score")


# --- ranges -------------------------------------------------------------------------------------------------------------------


@query(f"with {PARAS} select book_id, para, start, length(paragraph)::bigint as length from pa")
def paragraph_offsets(spark, d):
    return paragraphs_of_books(spark, d).select("book_id", "para", "start", F.length("paragraph").cast("long").alias("length"))


@query(f"with {PARAS} select p.book_id, p.para, h.chapter from pa p left join lateral (select 'H' || q.para as chapter from pa q where q.book_id = p.book_id and q.para % 7 = 3 and q.start <= p.start order by q.start desc limit 1) h on true")
def asof_chapter(spark, d):
    p = paragraphs_of_books(spark, d).select("book_id", "para", "start")
    heads = p.where("para % 7 = 3").select("book_id", F.col("start").alias("offset"), F.concat(F.lit("H"), "para").alias("title"))
    return intervals.as_of(p, heads, "book_id", "start", "offset", "title", "chapter").select("book_id", "para", "chapter")


@query(f"with {CHUNKS}, sp as (select book_id, 1300 * (query_id % 40) as span_start, 1300 * (query_id % 40) + 700 + 30 * (query_id % 90) as span_end, query_id from qs join (select distinct book_id from ch) b on true) select query_id, book_id, count(*) as n_chunks, min(chunk_index)::bigint as first_chunk from ch join sp using (book_id) where char_start < span_end and span_start < char_end group by 1, 2")
def interval_overlap_join(spark, d):
    c = chunks(spark, d)
    at = 1300 * (F.col("query_id") % 40)
    spans = asked(c).select("query_id", at.alias("span_start"), (at + 700 + 30 * (F.col("query_id") % 90)).alias("span_end")).crossJoin(F.broadcast(c.select("book_id").distinct()))
    return intervals.overlap_join(c.select("book_id", "chunk_index", "char_start", "char_end"), spans, "book_id", 3600).groupBy("query_id", "book_id").agg(F.count("*").alias("n_chunks"), F.min("chunk_index").alias("first_chunk"))


@query("""with s as (select l_orderkey, l_linenumber * 25 as a, (l_linenumber * 25 + l_quantity)::bigint as b from lineitem),
  f as (select *, case when a > max(b) over (partition by l_orderkey order by a, b rows between unbounded preceding and 1 preceding) or row_number() over (partition by l_orderkey order by a, b) = 1 then 1 else 0 end as n from s),
  i as (select *, sum(n) over (partition by l_orderkey order by a, b rows unbounded preceding) as g from f)
  select l_orderkey, min(a)::bigint as char_start, max(b)::bigint as char_end from i group by l_orderkey, g""")
def span_merge_islands(spark, d):
    s = t(spark, d, "lineitem").select("l_orderkey", (F.col("l_linenumber") * 25).cast("long").alias("char_start"), F.rint(F.col("l_linenumber") * 25 + F.col("l_quantity")).cast("long").alias("char_end"))
    return intervals.merge_spans(s, "l_orderkey")


# --- telemetry and catalog ----------------------------------------------------------------------------------------------------


@query(f"with {LOG} select model, count(*) as queries, round(avg(ttft_ms), 1) as avg_ttft_ms, round(avg(tps), 1) as avg_tps, round(avg(completion_tokens), 1) as avg_completion_tokens from lg group by 1")
def telemetry_per_model(spark, d):
    return catalog.telemetry(query_log(spark, d))


@query(f"with {LOG} select model, round(coalesce(quantile_cont(ttft_ms, 0.5), 0), 6) as p50, round(coalesce(quantile_cont(ttft_ms, 0.95), 0), 6) as p95 from lg group by 1")
def telemetry_percentiles(spark, d):
    return query_log(spark, d).groupBy("model").agg(F.round(evaluation.percentile("ttft_ms", 0.5), 6).alias("p50"), F.round(evaluation.percentile("ttft_ms", 0.95), 6).alias("p95"))


@query(f"with {LOG} select model, list_sort(list(ttft_ms) filter (ttft_ms is not null))[len(list(ttft_ms) filter (ttft_ms is not null)) // 2 + 1] as upper_median from lg group by 1")
def upper_median_latency(spark, d):
    return query_log(spark, d).groupBy("model").agg(evaluation.upper_median("ttft_ms").alias("upper_median"))


@query("""with v as (select user_id, round(sum(case when event_type = 'error' then -value else value end), 2) as total from events group by 1), m as (select max(case when total > 0 then total end) as m from v)
  select user_id, case when total > 0 then total end as total, coalesce(round(100.0 * case when total > 0 then total end / m, 6), 0.0)::double as pct from v, m""")
def bars_pct_of_max(spark, d):
    v = t(spark, d, "events").groupBy("user_id").agg(F.round(F.sum(F.when(F.col("event_type") == "error", -F.col("value")).otherwise(F.col("value"))), 2).alias("total"))
    return catalog.bars(v, "total")


@query("select concurrency, count(*) as requests, count(*) filter (ok) as ok, count(*) filter (not ok) as failed, round(coalesce(quantile_cont(value, 0.5) filter (ok), 0), 3) as ttft_p50, round(coalesce(quantile_cont(value, 0.95) filter (ok), 0), 3) as ttft_p95, round(coalesce(quantile_cont(value * 2, 0.5) filter (ok), 0), 3) as e2e_p50, round(coalesce(quantile_cont(value * 2, 0.95) filter (ok), 0), 3) as e2e_p95, round(coalesce(avg(k / 8.0::double) filter (ok), 0), 1) as mean_tps, round(coalesce(sum(case when ok then k else 0 end) / 1000.0::double, 0), 1) as tokens_per_s from (select user_id % 4 as concurrency, event_type <> 'error' as ok, value, (props->>'$.k')::bigint as k from events) group by 1")
def load_summary(spark, d):
    k = F.get_json_object("props", "$.k").cast("long")
    r = t(spark, d, "events").select((F.col("user_id") % 4).alias("concurrency"), (F.col("event_type") != "error").alias("ok"), F.col("value").alias("ttft_s"), (F.col("value") * 2).alias("e2e_s"), k.alias("completion_tokens"), (k / 8.0).alias("tps"), F.lit(1000.0).alias("wall"))
    return evaluation.load_summary(r, ["concurrency"], "wall")


def _catalog(spark, d):
    """Nations are groups, regions collections, suppliers books."""
    groups = t(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.lower("n_name").alias("slug"), F.col("n_name").alias("name"))
    books = t(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").cast("long").alias("group_id"), F.col("s_name").alias("book_key"))
    coll = t(spark, d, "region").select(F.col("r_regionkey").cast("long").alias("id"), F.lower("r_name").alias("slug"), F.col("r_name").alias("name"))
    members = t(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_regionkey").cast("long").alias("collection_id"), F.col("n_nationkey").cast("long").alias("group_id"))
    return groups, books, coll, members


@query("select lower(n_name) as slug, count(s_suppkey) as n_books from nation left join supplier on s_nationkey = n_nationkey group by 1")
def group_book_counts(spark, d):
    groups, books, _, _ = _catalog(spark, d)
    return catalog.book_counts(groups, books).select("slug", "n_books")


@query("select lower(r_name) as slug, count(distinct n_nationkey) as n_groups, count(s_suppkey) as n_books from region left join nation on n_regionkey = r_regionkey left join supplier on s_nationkey = n_nationkey group by 1")
def collection_book_counts(spark, d):
    _, books, coll, members = _catalog(spark, d)
    return catalog.collection_counts(coll, members, books).select("slug", "n_groups", "n_books")


@query("""with s as (select lower(r_name) as slug from region union all select lower(n_name) from nation where n_nationkey % 3 = 0 union all select 'nowhere'), m as (select lower(r_name) as slug, list_sort(list(lower(n_name))) as g from region join nation on n_regionkey = r_regionkey group by 1)
  select slug, array_to_string(coalesce(g, [slug]), ',') as group_ids from s left join m using (slug)""")
def collection_expand(spark, d):
    groups, _, coll, members = _catalog(spark, d)
    slugs = coll.select("slug").unionByName(groups.where("id % 3 = 0").select("slug")).unionByName(spark.createDataFrame([("nowhere",)], "slug string"))
    return catalog.expand_slugs(slugs, groups, coll, members).select("slug", F.array_join("group_ids", ",").alias("group_ids"))


@query("select c_nationkey as nationkey, count(*) as n from customer where c_nationkey not in (select s_nationkey from supplier where s_suppkey % 3 = 0) group by 1")
def missing_members_anti(spark, d):
    wanted = t(spark, d, "customer").select(F.col("c_nationkey").alias("nationkey"))
    return catalog.missing(wanted, t(spark, d, "supplier").where("s_suppkey % 3 = 0").select(F.col("s_nationkey").alias("nationkey")), "nationkey").groupBy("nationkey").agg(F.count("*").alias("n"))


@query(r"select conv_id, turn, role, case when role = 'assistant' then trim(regexp_replace(text, '\[\d+\]', '', 'g')) else text end as content from (select *, row_number() over (partition by conv_id order by turn desc) as n from conversations) where n <= 4")
def history_last_n(spark, d):
    c = catalog.last_turns(t(spark, d, "conversations"), 4)
    return c.select("conv_id", "turn", "role", F.when(F.col("role") == "assistant", T.without_citations(F.col("text"))).otherwise(F.col("text")).alias("content"))


@query("select conv_id, left(first(text order by turn), 80) as title, count(*) as n, max(turn) as last_turn from conversations group by 1")
def conversation_titles(spark, d):
    c = t(spark, d, "conversations")
    return c.groupBy("conv_id").agg(F.substring(F.min_by("text", "turn"), 1, 80).alias("title"), F.count("*").alias("n"), F.max("turn").alias("last_turn"))


@query("select r_name as name, case when position(' ' in r_name) > 0 then replace(lower(r_name), ' ', '-') else lower(r_name) || '-2' end as slug from region union all select 'Größe ' || n_name, 'groe-' || replace(lower(n_name), '_', '-') from nation")
def slug_namespace(spark, d):
    groups, _, coll, _ = _catalog(spark, d)
    names = coll.select("name").unionByName(groups.select(F.concat(F.lit("Größe "), "name").alias("name")))
    return catalog.unique_slugs(names, groups.select("slug").unionByName(coll.select("slug"))).select("name", "slug")


@query("select e.event_id, e.user_id from events e where not exists (select 1 from (select distinct user_id, event_id // 10 as b from events where event_type = 'error') d where d.b = e.event_id // 10)")
def checkpoint_antijoin(spark, d):
    e = t(spark, d, "events").withColumn("key", F.floor(F.col("event_id") / 10))
    return files.todo(e, e.where("event_type = 'error'"), "key").select("event_id", "user_id")


@query("select user_id, arg_max(event_type, event_id) as event_type, arg_max(value, event_id) as value, max(event_id) as event_id from events group by 1")
def checkpoint_last_wins(spark, d):
    e = t(spark, d, "events").select("user_id", "event_type", "value", "event_id", F.col("event_id").alias("_at"))
    return files.last_wins(e, "user_id", "_at").drop("_at")


MODELS = "known as (select p_partkey as id, p_brand as family, case when p_size % 2 = 0 then p_size::bigint end as parameter_count, p_size % 5 = 0 as curated from part where p_partkey % 3 <> 1), found as (select p_partkey as id, p_type as family, p_size || 'M' as parameter_size from part where p_partkey % 3 <> 2)"


@query(f"with {MODELS} select printf('m%d', coalesce(k.id, f.id)) as name, coalesce(f.family, k.family) as family, coalesce(k.parameter_count, regexp_extract(f.parameter_size, '[0-9]+')::bigint * 1000000) as parameter_count, case when f.id is null then 'old' when k.curated then 'ollama+kuratiert' else 'ollama' end as source from known k full join found f on k.id = f.id")
def model_registry_merge(spark, d):
    p = t(spark, d, "part")
    name = F.format_string("m%d", "p_partkey").alias("name")
    none = lambda kind, n: F.lit(None).cast(kind).alias(n)
    known = p.where("p_partkey % 3 <> 1").select(name, F.col("p_brand").alias("family"), none("string", "parameter_size"), F.when(F.col("p_size") % 2 == 0, F.col("p_size").cast("long")).alias("parameter_count"), none("string", "quantization"), none("int", "context_length"), F.when(F.col("p_size") % 5 == 0, F.lit("2024-01-01").cast("date")).alias("cutoff_date"), F.lit("old").alias("source"), none("timestamp_ntz", "updated_at"))
    found = p.where("p_partkey % 3 <> 2").select(name, F.col("p_type").alias("family"), F.concat(F.col("p_size"), F.lit("M")).alias("parameter_size"), none("string", "quantization"), none("int", "context_length"))
    return catalog.sync_models(known, found, F.lit("2025-01-01 00:00:00").cast("timestamp_ntz")).select("name", "family", "parameter_count", "source")


@query("select 'groups' as tab, count(*) as n, coalesce(sum(n_nationkey), 0)::bigint as check_sum from nation where n_nationkey % 4 <> 1 union all select 'books', count(*), coalesce(sum(s_suppkey), 0)::bigint from supplier where s_nationkey % 4 <> 1 union all select 'members', count(*), coalesce(sum(n_nationkey), 0)::bigint from nation where n_nationkey % 4 <> 1 union all select 'chunks', count(*), coalesce(sum(c_custkey), 0)::bigint from customer where c_nationkey % 4 <> 1")
def cascade_delete(spark, d):
    groups, books, _, members = _catalog(spark, d)
    held = t(spark, d, "customer").join(groups.select(F.col("id").alias("c_nationkey"), F.col("slug").alias("group_id")), "c_nationkey").select(F.col("c_custkey").alias("id"), "group_id")
    left = catalog.delete_groups(groups.where("id % 4 = 1").select("slug"), groups, books, members, held)
    out = None
    for name in ("groups", "books", "members", "chunks"):
        row = left[name].agg(F.count("*").alias("n"), F.coalesce(F.sum("id"), F.lit(0)).alias("check_sum")).select(F.lit(name).alias("tab"), "n", "check_sum")
        out = row if out is None else out.unionByName(row)
    return out


@query("with new as (select o_orderkey, o_custkey, o_totalprice + 1 as o_totalprice from orders where o_orderkey % 3 = 0) select o_orderkey, o_custkey, round(coalesce(n.o_totalprice, o.o_totalprice), 2) as o_totalprice from (select * from orders where o_orderkey % 2 = 0) o full join new n using (o_orderkey, o_custkey)")
def keyed_merge(spark, d):
    o = t(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    new = o.where("o_orderkey % 3 = 0").withColumn("o_totalprice", F.col("o_totalprice") + 1)
    return store.merged(o.where("o_orderkey % 2 = 0"), new, ["o_orderkey"]).select("o_orderkey", "o_custkey", F.round("o_totalprice", 2).alias("o_totalprice"))


@query("select o_orderkey, case when o_orderkey % 5 = 0 then 'late' else o_orderstatus end as o_orderstatus, case when o_orderkey % 5 = 0 then o_custkey end as note from orders")
def partial_update(spark, d):
    o = t(spark, d, "orders")
    fields = o.where("o_orderkey % 5 = 0").select("o_orderkey", F.lit("late").alias("o_orderstatus"), F.col("o_custkey").alias("note"))
    return store.patched(o.select("o_orderkey", "o_orderstatus"), fields, ["o_orderkey"]).select("o_orderkey", "o_orderstatus", "note")


# --- text ---------------------------------------------------------------------------------------------------------------------

@query(r"""with c as (select doc_id, text, regexp_replace(nfc_normalize(text), '[\x00-\x08\x0b\x0c\x0e-\x1f]', '', 'g') as f from documents),
  l as (select doc_id, text, list_filter(list_transform(string_split(f, chr(10)), lambda x: trim(x, ' ' || chr(9))), lambda x: not regexp_full_match(x, '\d{1,4}')) as k, len(list_filter(string_split(f, chr(10)), lambda x: regexp_full_match(trim(x, ' ' || chr(9)), '\d{1,4}'))) as pagenums from c),
  p as (select doc_id, text, pagenums, trim(regexp_replace(array_to_string(k, chr(10)), '\n{2,}', chr(10) || chr(10), 'g'), chr(10)) as s from l),
  q as (select *, trim(regexp_replace(replace(replace(regexp_replace(replace(s, chr(10) || chr(10), chr(1)), '([A-Za-zÀ-ÿ])-\n(\p{Ll})', '\1\2', 'g'), chr(10), ' '), chr(1), chr(10) || chr(10)), '[ \t]{2,}', ' ', 'g')) as cleaned from p)
  select doc_id, length(text)::int as original_chars, length(cleaned)::int as cleaned_chars, (length(replace(s, chr(10) || chr(10), '')) - length(replace(replace(s, chr(10) || chr(10), ''), chr(10), '')))::int as lines_merged, pagenums::int as pagenumber_lines_removed,
    round(len(regexp_extract_all(cleaned, '[^\x00-\x7f]'))::double / greatest(length(cleaned), 1), 4) as nonascii_ratio_after, round(1 - length(cleaned)::double / greatest(length(text), 1), 4) as dropped_ratio, md5(cleaned) as cleaned_md5 from q""")
def clean_report(spark, d):
    out = I.clean_report(t(spark, d, "documents"), text="text")
    return out.select("doc_id", "original_chars", "cleaned_chars", "lines_merged", "pagenumber_lines_removed", "nonascii_ratio_after", "dropped_ratio", F.md5("cleaned").alias("cleaned_md5"))


@query(r"""select doc_id, array_to_string(list_filter([case when length(trim(text, ' ' || chr(9) || chr(10) || chr(13))) < 200 then 'too_short' end, case when len(regexp_extract_all(text, '�')) > greatest(10, floor(0.001 * length(text))) then 'garbled' end,
  case when length(regexp_replace(text, '\s+', '', 'g')) > 0 and len(regexp_extract_all(text, '\p{L}'))::double / length(regexp_replace(text, '\s+', '', 'g')) < 0.5 then 'few_letters' end], lambda x: x is not null), ',') as errors from documents""")
def validate_documents(spark, d):
    return t(spark, d, "documents").select("doc_id", F.array_join(T.document_errors(F.col("text")), ",").alias("errors"))


@query(r"select doc_id, round(len(regexp_extract_all(text, '[^\x00-\x7f]'))::double / greatest(length(text), 1), 4) as share from documents")
def char_ratio(spark, d):
    return t(spark, d, "documents").select("doc_id", T.share_not_ascii(F.col("text")).alias("share"))


@query(r"""with s as (select doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x, ' ' || chr(10) || chr(9))), lambda x: x <> '') as s from documents)
  select doc_id, len(s)::int as n_sentences, coalesce(list_max(list_transform(s, lambda x: length(x))), 0)::int as longest from s""")
def sentence_split(spark, d):
    s = t(spark, d, "documents").select("doc_id", T.sentences(F.col("text")).alias("s"))
    return s.select("doc_id", F.size("s").alias("n_sentences"), F.coalesce(F.array_max(F.transform("s", F.length)), F.lit(0)).alias("longest"))


@query(rf"with {ANSWERS} select conv_id, turn, array_to_string(list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(answer, '\[(\d+)\]', 1), lambda x: x::int), lambda n: n between 1 and 5))), ',') as markers from an")
def citation_map(spark, d):
    return cited_answers(spark, d).select("conv_id", "turn", F.array_join(T.citations(F.col("answer"), 5), ",").alias("markers"))


@query(rf"""with {ANSWERS}, s as (select conv_id, turn, list_filter(list_transform(string_split(regexp_replace(answer, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x, ' ' || chr(10))), lambda x: length(x) > 15) as s from an)
  select conv_id, turn, round(case when len(s) > 0 then len(list_filter(s, lambda x: regexp_matches(x, '\[\d+\]')))::double / len(s) end, 6) as rate from s""")
def citation_rate(spark, d):
    return cited_answers(spark, d).select("conv_id", "turn", F.round(evaluation.citation_rate(F.col("answer")), 6).alias("rate"))


REFUSED = r"(regexp_matches(text, '(?i)(steht|finde|findet\s+sich|gibt\s+es)[^.]{0,60}(quellen|texten?)[^.]{0,40}(nichts|keine|nicht)|quellen\s+(reichen|enthalten)\s+nicht|keine\s+(information|angabe|informationen|angaben)') or (position('[' in text) = 0 and length(text) < 200))"


@query(f"select role, count(*) as n, count(*) filter ({REFUSED}) as refusals from conversations group by 1")
def refusal_rate(spark, d):
    return t(spark, d, "conversations").groupBy("role").agg(F.count("*").alias("n"), F.count_if(T.is_refusal(F.col("text"))).alias("refusals"))


@query(f"select lang, count(*) as n, round(avg(case when qtype = 'unanswerable' then refused::int end), 6) as refusal_rate, round(avg(case when qtype is distinct from 'unanswerable' then refused::int end), 6) as false_refusal_rate, round(avg(case when qtype is distinct from 'unanswerable' then (correct and not refused)::int end), 6) as correct_rate from (select lang, case when doc_id % 8 = 0 then 'unanswerable' when doc_id % 3 > 0 then 'fact' end as qtype, {REFUSED} as refused, quality = 1 as correct from documents join labels using (doc_id)) group by 1")
def answer_rates(spark, d):
    a = t(spark, d, "documents").join(t(spark, d, "labels"), "doc_id")
    a = a.select("lang", F.when(F.col("doc_id") % 8 == 0, "unanswerable").when(F.col("doc_id") % 3 > 0, "fact").alias("qtype"), T.is_refusal(F.col("text")).alias("refused"), (F.col("quality") == 1).alias("correct"))
    return evaluation.answer_summary(a, ["lang"])


PAIRS = """
pr as (select a.conv_id, a.turn, a.text as pred, b.text as gold from conversations a join conversations b on a.conv_id = b.conv_id and b.turn = a.turn - 1 where a.role = 'assistant')"""


def _pairs(spark, d):
    c = t(spark, d, "conversations")
    before = c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("gold"))
    return c.where("role = 'assistant'").select("conv_id", "turn", F.col("text").alias("pred")).join(before, ["conv_id", "turn"])


@query(rf"""with {PAIRS}, w as (select conv_id, turn, list_filter(regexp_split_to_array(translate(lower(pred), '!"#$%&()*+,-./:;<=>?@[\]^_`{{|}}~' || chr(39), ''), '\s+'), lambda x: x <> '') as p, list_filter(regexp_split_to_array(translate(lower(gold), '!"#$%&()*+,-./:;<=>?@[\]^_`{{|}}~' || chr(39), ''), '\s+'), lambda x: x <> '') as g from pr),
  o as (select *, coalesce(list_sum(list_transform(list_distinct(p), lambda x: least(len(list_filter(p, lambda y: y = x)), len(list_filter(g, lambda y: y = x))))), 0) as c from w)
  select conv_id, turn, round(case when len(p) = 0 or len(g) = 0 or c = 0 then 0.0 else 2.0 * c::double / (len(p) + len(g)) end, 6) as f1 from o""")
def token_f1(spark, d):
    words = _pairs(spark, d).select("conv_id", "turn", T.answer_tokens(F.col("pred")).alias("p"), T.answer_tokens(F.col("gold")).alias("g"))
    return words.select("conv_id", "turn", F.round(evaluation.token_f1(F.col("p"), F.col("g")), 6).alias("f1"))


@query()
def rouge_l(spark, d):
    return _pairs(spark, d).select("conv_id", "turn", F.round(evaluation.rouge_l("pred", "gold"), 6).alias("rouge_l"))


@query(r"with l as (select trim(lower(regexp_replace(trim(u, ' '), '[\d\s|]+', ' ', 'g'))) as line from (select unnest(string_split(text, chr(10))) as u from documents) where length(u) <= 150) select line, count(*) as n from l where line <> '' group by 1 having count(*) >= 5")
def boilerplate_lines(spark, d):
    lines = t(spark, d, "documents").select(F.explode(F.split("text", "\n", -1)).alias("u")).where(F.length("u") <= 150)
    return lines.select(T.boilerplate_key(F.col("u")).alias("line")).where("line <> ''").groupBy("line").agg(F.count("*").alias("n")).where("n >= 5")


@query(f"""with {PARAS}, q as (select book_id, para, case when para % 11 = 5 then 'CHAPTER ' || (para % 40) when book_id like '%3' and para % 5 = 0 then 'CHAPTER I CHAPTER II CHAPTER III' else paragraph end as paragraph from pa)
  select book_id, para, (regexp_matches(paragraph, '^(CHAPTER|Chapter|KAPITEL|Kapitel|BOOK|Book)\\b.{{0,70}}$') and length(paragraph) <= 80) as heading, len(regexp_extract_all(paragraph, '(?i)\\b(CHAPTER|KAPITEL)\\b')) >= 3 as contents from q""")
def heading_flags(spark, d):
    return _flagged(paragraphs_of_books(spark, d))


def _flagged(p: DataFrame) -> DataFrame:
    text = F.when(F.col("para") % 11 == 5, F.concat(F.lit("CHAPTER "), (F.col("para") % 40).cast("string"))).when(F.col("book_id").endswith("3") & (F.col("para") % 5 == 0), F.lit("CHAPTER I CHAPTER II CHAPTER III")).otherwise(F.col("paragraph"))
    marked = I.heading_marks(p.select("book_id", "para", text.alias("paragraph"))).withColumn("contents", T.is_contents(F.col("paragraph")))
    return I.heading_rule(marked.drop("paragraph")).select("book_id", "para", "heading", "contents")


@query(rf"with {BENCH.replace('length(x) > 1', 'length(x) > 3')} select term, sum(tf)::bigint as n from po group by 1 order by n desc, term limit 120")
def word_freq_topn(spark, d):
    posts = lexical.postings(t(spark, d, "documents"), "doc_id", "text").where(F.length("term") > 3)
    return posts.groupBy("term").agg(F.sum("tf").alias("n")).orderBy(F.desc("n"), "term").limit(120)


@query("select source, bucket, doc_id from (select *, row_number() over (partition by source, bucket order by md5(doc_id::varchar || ':42'), doc_id) as r from (select source, doc_id, ntile(3) over (partition by source order by n_chars, doc_id) as bucket from documents)) where r <= 4")
def stratified_sample(spark, d):
    third = t(spark, d, "documents").select("source", "doc_id", F.ntile(3).over(Window.partitionBy("source").orderBy("n_chars", "doc_id")).alias("bucket"))
    return top_k(third, 4, ["source", "bucket"], F.md5(F.concat(F.col("doc_id").cast("string"), F.lit(":42"))), F.col("doc_id")).select("source", "bucket", "doc_id")


@query("select route, count(*) as n from (select case when doc_id % 6 = 0 then 'global' when doc_id % 6 in (1, 2) then 'local' end as route from documents) group by 1")
def route_questions(spark, d):
    said = F.when(F.col("doc_id") % 6 == 0, "Welche Rolle spielt er?").when(F.col("doc_id") % 6 == 1, " Wann kommt sie an?").when(F.col("doc_id") % 6 == 2, "WER ist das").when(F.col("doc_id") % 6 == 3, "Entwickeltes? Nein: wannsee").otherwise("Ist das so?")
    said = F.when(F.col("doc_id") % 6 == 3, F.lit("Wannsee liegt wo?")).otherwise(said)
    return t(spark, d, "documents").select(T.route(said).alias("route")).groupBy("route").agg(F.count("*").alias("n"))


# --- graph --------------------------------------------------------------------------------------------------------------------


@query(f"with {ENTITIES} select entity_id, n_mentions, idf from no")
def entity_mentions_idf(spark, d):
    return entity_graph(spark, d)[0].select("entity_id", "n_mentions", "idf")


@query(f"with {ENTITIES} select src, dst, weight from ed")
def edge_weights(spark, d):
    return entity_graph(spark, d)[1]


@query(f"with {LINKED} select query_id, entity_id, activation from ac")
def hop_activation(spark, d):
    _, edges, mentions, _ = entity_graph(spark, d)
    return graph.hop_activations(linked_entities(spark, d, mentions), edges)


@query(f"with {LINKED} select query_id, chunk_key, round(sum(activation * idf), 6) as graph_score, count(*) as n_shared from ac join no using (entity_id) join me using (entity_id) where activation * idf > 0 group by 1, 2 having count(*) >= 2")
def chunk_graph_score(spark, d):
    nodes, edges, mentions, _ = entity_graph(spark, d, once=True)
    return graph.chunk_scores(graph.hop_activations(linked_entities(spark, d, mentions), edges), mentions, nodes, 2)


@query("""with i as (select distinct 'PERSON:' || lower(n) as id, string_split(lower(n), ' ') as w from (select p_name as n from part union all select split_part(p_name, ' ', 1) from part where p_partkey % 7 = 0 union all select p_name || ' ' || lower(p_type) from part where p_partkey % 40 = 0))
  select a.id as entity_id, count(*) as n, min(b.id) as first_target from i a join i b on len(b.w) > len(a.w) and (b.w[1:len(a.w)] = a.w or b.w[len(b.w) - len(a.w) + 1:] = a.w) group by 1""")
def alias_merge_candidates(spark, d):
    p = t(spark, d, "part")
    names = p.select(F.col("p_name").alias("n")).unionByName(p.where("p_partkey % 7 = 0").select(F.split("p_name", " ")[0].alias("n"))).unionByName(p.where("p_partkey % 40 = 0").select(F.concat("p_name", F.lit(" "), F.lower("p_type")).alias("n")))
    found = graph.alias_candidates(names.select(T.entity_key(F.col("n"), F.lit("PERSON")).alias("entity_id")).distinct())
    return found.groupBy("entity_id").agg(F.count("*").alias("n"), F.min("target").alias("first_target"))


@query(f"with recursive {NEAREST.strip()}, bo as (select src as a, dst as b from ne union all select dst, src from ne), re(x, y) as (select a, a from bo union select r.x, b.b from re r join bo b on r.y = b.a) select x as entity_id, min(y) as component from re group by 1")
def connected_components(spark, d):
    return _components(nearest(spark, d))


def _components(e: DataFrame) -> DataFrame:
    nodes = e.select(F.col("src").alias("entity_id")).unionByName(e.select(F.col("dst").alias("entity_id"))).distinct().withColumn("label", F.lit("all"))
    return communities.components(e, nodes)


def _labelled(spark, d):
    return t(spark, d, "embeddings").select(F.format_string("v%06d", "vec_id").alias("entity_id"), F.format_string("c%03d", "label").alias("community"))


def _keyed(spark, d):
    return t(spark, d, "embeddings").select(F.format_string("v%06d", "vec_id").alias("entity_id"), F.concat(F.lit("k"), F.col("vec_id") % 13).alias("chunk_key"))


@query(f"""with {NEAREST}, mb as (select printf('v%06d', vec_id) as e, printf('c%03d', label) as c from cv), dg as (select e, sum(w) as deg from (select src as e, weight as w from ne union all select dst, weight from ne) group by 1), m as (select sum(weight)::double as m from ne),
  inn as (select a.c, sum(weight) as i, count(*) as k from ne join mb a on a.e = src join mb b on b.e = dst where a.c = b.c group by 1)
  select mb.c as community, count(*) as size, coalesce(any_value(i), 0)::bigint as internal, coalesce(any_value(k), 0)::bigint as internal_edges, sum(deg)::bigint as degree, round(coalesce(any_value(i), 0) / any_value(m) - pow(sum(deg) / (2 * any_value(m)), 2), 6) as modularity from mb join dg using (e) left join inn on inn.c = mb.c, m group by 1""")
def modularity_terms(spark, d):
    return communities.modularity_terms(nearest(spark, d), _labelled(spark, d))


@query(f"""with {NEAREST}, mb as (select printf('v%06d', vec_id) as e, printf('c%03d', label) as c, 'k' || (vec_id % 13) as chunk_key from cv), dg as (select e, sum(w) as deg from (select src as e, weight as w from ne union all select dst, weight from ne) group by 1)
  select community, rank, chunk_key, score from (select c as community, chunk_key, sum(coalesce(deg, 0))::bigint as score, row_number() over (partition by c order by sum(coalesce(deg, 0)) desc, chunk_key) as rank from mb left join dg using (e) group by 1, 2) where rank <= 3""")
def community_representatives(spark, d):
    return communities.representatives(_labelled(spark, d), _keyed(spark, d), nearest(spark, d)).select("community", "rank", "chunk_key", "score")


@query()
def louvain_communities(spark, d):
    nodes, edges, _, _ = entity_graph(spark, d, once=True)
    members, _ = communities.communities(nodes, edges, min_size=3)
    return members


@query()
def extraction_parse(spark, d):
    """Extraction answers in fences, cut off, or without an object."""
    words = F.regexp_extract_all("text", F.lit("[A-Z][a-z]{5,}"), F.lit(0))
    one = F.array_join(F.transform(words, lambda w: F.concat(F.lit('{"name":"'), w, F.lit('","type":"character","desc":"x"}'))), ",")
    whole = F.concat(F.lit('{"entities":['), one, F.lit('],"relations":[{"source":"A","target":"B","rel":"r"}]}'))
    raw = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("Here:\n```json\n"), whole, F.lit("\n```"))).when(F.col("doc_id") % 4 == 1, F.substring(whole, 1, 200)).when(F.col("doc_id") % 4 == 2, whole).otherwise(F.lit("none"))
    out = J.parse_extractions(t(spark, d, "documents").select("doc_id", raw.alias("raw")), out="x")
    return out.select("doc_id", F.size("x.entities").alias("n_entities"), F.size("x.relations").alias("n_relations"), "x.truncated", "x.error")


@query()
def graph_build(spark, d):
    """The whole graph from extraction rows: nodes with idf, degree and aliases."""
    words = F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Z][a-z]{5,}"), F.lit(0)))
    rows = t(spark, d, "documents").select(F.concat(F.lit("b:"), "doc_id").alias("key"), F.lit("b").alias("book_id"), words.alias("w"))
    rows = rows.select("key", "book_id", F.transform("w", lambda w: F.struct(w.alias("name"), F.lit("PERSON").alias("type"), F.lit("").alias("desc"))).alias("entities"),
                       F.transform(F.slice("w", F.lit(2), F.greatest(F.size("w") - 1, F.lit(0))), lambda w: F.struct(F.get("w", F.lit(0)).alias("source"), w.alias("target"), F.lit("near").alias("rel"))).alias("relations"))
    g = graph.build(rows, t(spark, d, "documents").count())
    return g.nodes.join(communities.weighted_degree(g.edges), "entity_id", "left").select("entity_id", "name", "type", "n_mentions", "idf", F.coalesce("degree", F.lit(0)).alias("degree"))


@query(f"""with {CHUNKS}, rk as ({ranked_sql(8)}), gr as (select query_id, chunk_key, 1.0 * (chunk_index % 7) as graph_score from (select query_id, chunk_key, chunk_index, row_number() over (partition by query_id order by chunk_index % 7 desc, chunk_key) as r from sc) where r <= 40),
  sh as (select query_id, chunk_key, graph_score / max(graph_score) over (partition by query_id) as g, row_number() over (partition by query_id order by graph_score desc, chunk_key) as r from gr),
  al as (select r.query_id, r.chunk_key, r.score, 0 as l, r.rank as o, coalesce(g, 0) as g from rk r left join sh using (query_id, chunk_key) union all
         select s.query_id, s.chunk_key, sc.score, 1, s.r, s.g from sh s join sc using (query_id, chunk_key) where s.r <= 20 and not exists (select 1 from rk x where x.query_id = s.query_id and x.chunk_key = s.chunk_key))
  select query_id, chunk_key, round(score + 0.10 * g, 6) as fused, round(g, 4) as graph_score from al""")
def fuse_scores(spark, d):
    c = chunks(spark, d)
    q = asked(c)
    dense = ranking.dense_top_k(c, q, 8, other=OTHER)
    # remainders as vectors of one component: the same ranking, of all chunks but the asking one
    by_rest = ranking.dense_top_k(c.withColumn("vector", F.array((F.col("chunk_index") % 7).cast("double"))), q.withColumn("query_vector", F.array(F.lit(1.0))), 40, other=OTHER)
    g = by_rest.select("query_id", "chunk_key", F.col("score").alias("graph_score"))
    scores = R.similarity(g, c, q)
    # without overlaps between candidates nothing is dropped, so that scores alone are seen
    apart = lambda x: x.withColumn("book_id", F.concat_ws("/", "book_id", "chunk_key"))
    return graph.fuse(apart(dense), g, apart(scores), 0, graph.GraphParams(alpha=0.10)).select("query_id", "chunk_key", "fused", "graph_score")


# --- statistics ---------------------------------------------------------------------------------------------------------------


@query("""select lang, count(*) as n, round(avg((quality = toxic)::int), 6) as agreement, round(case when pe >= 1 then 1.0 else (avg((quality = toxic)::int) - pe) / (1 - pe) end, 6) as kappa
  from (select lang, quality, toxic, avg(quality) over (partition by lang) * avg(toxic) over (partition by lang) + (1 - avg(quality) over (partition by lang)) * (1 - avg(toxic) over (partition by lang)) as pe from labels join documents using (doc_id)) group by lang, pe""")
def cohen_kappa(spark, d):
    both = t(spark, d, "labels").join(t(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    return evaluation.kappa(both.select("lang", (F.col("quality") == 1).alias("a"), (F.col("toxic") == 1).alias("b")), "a", "b", ["lang"])


@query("select grp, tp, fp, fn, tn, round(case when tp + fp > 0 then tp::double / (tp + fp) end, 6) as precision, round(case when tp + fn > 0 then tp::double / (tp + fn) end, 6) as recall from (select doc_id % 4 as grp, count(*) filter (p and q) as tp, count(*) filter (p and not q) as fp, count(*) filter (not p and q) as fn, count(*) filter (not p and not q) as tn from (select doc_id, doc_id % 3 > 0 as p, quality = 1 as q from labels) group by 1)")
def confusion_precision_recall(spark, d):
    rows = t(spark, d, "labels").select((F.col("doc_id") % 4).alias("grp"), (F.col("doc_id") % 3 > 0).alias("p"), (F.col("quality") == 1).alias("q"))
    return evaluation.confusion(rows, "p", "q", ["grp"])


@query("select source, count(distinct lang) + max((lang is null)::int) as distinct_langs from (select source, case when doc_id % 9 > 0 then lang end as lang from documents) group by 1")
def distinct_chapters(spark, d):
    rows = t(spark, d, "documents").select("source", F.when(F.col("doc_id") % 9 > 0, F.col("lang")).alias("lang"))
    return rows.groupBy("source").agg(evaluation.distinct_with_null("lang").alias("distinct_langs"))


@query("select item_id, answer, coalesce(lead(answer) over (order by item_id), first_value(answer) over (order by item_id)) as other_answer from (select item_id, text as answer from benchmark)")
def calibration_pairs(spark, d):
    return evaluation.calibration_pairs(t(spark, d, "benchmark").select("item_id", F.col("text").alias("answer")))


@query("select user_id, round(case when tokens > 0 then tokens / greatest((value * 3 - value) / 1000.0::double, 1e-6) else 0 end, 4) as tps, event_id from (select *, (props->>'$.k')::bigint as tokens from events)")
def decode_speed(spark, d):
    k = F.get_json_object("props", "$.k").cast("long")
    return t(spark, d, "events").select("user_id", F.round(evaluation.timings(F.col("value"), F.col("value") * 3, k), 4).alias("tps"), "event_id")


# --- streams of events --------------------------------------------------------------------------------------------------------

TOKENS = """
ev as (select user_id as query_id, event_id as seq, case event_type when 'error' then 'reset' when 'signup' then 'done' else 'token' end as event, (event_id % 97)::varchar || ' ' as payload from events)"""


@query(f"with {TOKENS}, r as (select query_id, max(seq) filter (event = 'reset') as rs from ev group by 1) select query_id, coalesce(string_agg(payload, '' order by seq) filter (event = 'token' and seq > coalesce(rs, -1)), '') as answer, count(*) filter (event = 'reset') as resets, bool_or(event = 'done') as done from ev join r using (query_id) group by 1")
def reset_token_answer(spark, d):
    e = t(spark, d, "events")
    kind = F.when(F.col("event_type") == "error", "reset").when(F.col("event_type") == "signup", "done").otherwise("token")
    rows = e.select(F.col("user_id").alias("query_id"), F.col("event_id").alias("seq"), "ts", kind.alias("event"), F.concat((F.col("event_id") % 97).cast("string"), F.lit(" ")).alias("payload"))
    return E.answers(rows).select("query_id", "answer", "resets", "done")


@query("select time_bucket(interval '6 hours', ts) as window_start, event_type, count(*) as n, round(avg(value), 6) as mean, round(max(value), 6) as largest from events group by 1, 2")
def windowed_telemetry(spark, d):
    e = t(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = E.windowed(e, "event_type", "6 hours")
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", "mean", "largest")


@query("""with g as (select user_id, ts, case when ts - lag(ts) over w >= interval '4 hours' or lag(ts) over w is null then 1 else 0 end as f from events window w as (partition by user_id order by ts)), s as (select *, sum(f) over (partition by user_id order by ts rows unbounded preceding) as k from g)
  select user_id, min(ts) as session_start, count(*) as n from s group by user_id, k""")
def telemetry_sessions(spark, d):
    e = t(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return E.sessions(e, "user_id", "4 hours").select("user_id", F.col("session_start").cast("timestamp_ntz").alias("session_start"), "n")


# --- whole jobs ---------------------------------------------------------------------------------------------------------------


def _books(spark, d) -> DataFrame:
    """Sources as books: their documents in order, with a chapter heading before every 23rd."""
    head = F.when(F.col("para") % 23 == 0, F.concat(F.lit("CHAPTER "), F.col("para").cast("string"), F.lit("\n\n"))).otherwise(F.lit(""))
    p = paragraphs_of_books(spark, d).select("book_id", "para", F.concat(head, "paragraph").alias("p"))
    lists = p.groupBy("book_id").agg(F.array_sort(F.collect_list(F.struct("para", "p"))).alias("l"))
    return lists.select("book_id", F.concat(F.lit("g"), F.length("book_id")).alias("group_id"), F.col("book_id").alias("title"), F.array_join(F.transform("l", lambda x: x["p"]), "\n\n").alias("text"))


def _book_parts(spark, d) -> tuple[DataFrame, DataFrame]:
    """The same books in parts, and what is known of the books: a document is a part, with a chapter heading before every 23rd; documents of one id are one part."""
    head = F.when(F.col("para") % 23 == 0, F.concat(F.lit("CHAPTER "), F.col("para").cast("string"), F.lit("\n\n"))).otherwise(F.lit(""))
    docs = t(spark, d, "documents").select(F.col("source").alias("book_id"), F.col("doc_id").alias("para"), F.replace(F.col("text"), F.lit("\n"), F.lit(" ")).alias("paragraph"))
    p = docs.select("book_id", F.coalesce("para", F.lit(-(2**63))).alias("part"), F.concat(head, "paragraph").alias("p"))
    parts = p.groupBy("book_id", "part").agg(F.array_join(F.array_sort(F.collect_list("p")), "\n\n").alias("text"), F.count("p").alias("_n")).where("_n > 0").drop("_n")
    return parts, docs.select("book_id").distinct().select("book_id", F.concat(F.lit("g"), F.length("book_id")).alias("group_id"), F.col("book_id").alias("title"))


@query()
def chunk_book(spark, d):
    _, _, cleaned = I.ingest_parts(*_book_parts(spark, d), embed(HashEmbedder()), dry_run=True)
    return I.chunk_parts(cleaned).select("book_id", "chapter", "chunk_index", "char_start", "char_end", F.md5("text").alias("text_md5"))


@query()
def ingest_points(spark, d):
    _, made, _ = I.ingest_parts(*_book_parts(spark, d), embed(HashEmbedder()))
    return made.select("chunk_key", "group_id", "chapter", "char_start", "char_end", "book_chars", F.size("vector").alias("dims"))


def _asked_texts(spark, d) -> DataFrame:
    b = t(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))
    return b.withColumn("_raw", embed(HashEmbedder())(F.col("question"))).withColumn("query_vector", l2_normalize(F.col("_raw"))).drop("_raw").withColumn("group_ids", F.lit(None).cast("array<string>"))


@query()
def prompt_build(spark, d):
    _, made, _ = I.ingest_parts(*_book_parts(spark, d), embed(HashEmbedder()), compose=False)
    made = saved(made.select("chunk_key", "book_id", "group_id", "chunk_index", "char_start", "char_end", "text", "vector"), "points")
    questions = _asked_texts(spark, d)
    hits = A.select_hits(questions, made, Settings(top_k=4, small_to_big=True))
    out = A.build_messages(questions, A.context_blocks(hits), None, "system", "Antworte mit Quellen.")
    return out.select("query_id", F.size("messages").alias("n_messages"), A.prompt_chars(F.col("messages")).alias("chars"), "n_sources")


@query()
def crag_flow(spark, d):
    _, made, _ = I.ingest_parts(*_book_parts(spark, d), embed(HashEmbedder()), compose=False)
    made = saved(made.select("chunk_key", "book_id", "group_id", "chunk_index", "char_start", "char_end", "text", "vector"), "points")  # searched once an attempt

    def search(q: DataFrame) -> DataFrame:
        v = q.withColumn("_raw", embed(HashEmbedder())(F.col("query"))).withColumn("query_vector", l2_normalize(F.col("_raw"))).drop("_raw")
        found = ranking.retrieve(made.drop("text"), v, 4)
        return A.with_texts(found, made)

    grader = lambda question, passages: F.when(lexical_score(passages, question) > 0.9, F.lit('{"relevant": [1, "2"]}')).otherwise(F.lit('{"relevant": []}'))
    rewriter = complete(lambda s: s.str.slice(0, 60))
    out = A.corrective_retrieval(_asked_texts(spark, d).select("query_id", "question"), search, grader, rewriter, Settings(top_k=4))
    return out.select("query_id", "attempts", "n_relevant", "decision", F.size("queries").alias("n_queries"), F.coalesce(F.size("context"), F.lit(0)).alias("n_context"))


@query()
def global_search(spark, d):
    keys = _keyed(spark, d)
    reps = communities.representatives(_labelled(spark, d), keys, nearest(spark, d))
    reports = reps.groupBy("community").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "chunk_key"))), lambda x: x["chunk_key"]).alias("chunk_keys")).withColumn("text", F.concat(F.lit("report "), "community"))
    scores = t(spark, d, "benchmark").select(F.col("item_id").alias("query_id")).join(F.broadcast(reports.select("community")), F.lit(True)).withColumn("score", F.round(F.pmod(F.xxhash64("query_id", "community"), F.lit(1000)) / 1000.0, 3))
    texts = keys.select("chunk_key", F.concat(F.lit("text of "), "chunk_key").alias("text")).distinct()
    return communities.global_points(communities.select_reports(scores), reports, texts)


# --- statistics of corpora, answers and graphs ----------------------------------------------------------------------------------


@query(f"""with {CHUNKS} select book_id, chapter, count(*) as n_chunks, round(avg(char_end - char_start), 6)::double as mean_chars, max(char_end - char_start)::bigint as most_chars, max(char_end)::bigint as extent
  from (select *, case when chunk_index % 7 > 0 then 'c' || (chunk_index // 10) end as chapter from ch) group by 1, 2""")
def chapter_statistics(spark, d):
    chapter = F.when(F.col("chunk_index") % 7 > 0, F.concat(F.lit("c"), F.floor(F.col("chunk_index") / 10)))
    return evaluation.chapter_statistics(chunks(spark, d).withColumn("chapter", chapter))


@query(f"""with {CHUNKS}, per as (select 'c' || (chunk_index // 10) as chapter, count(*) as n from ch group by 1), it as (select n_nationkey as item_id, unnest(list_distinct(['c' || (n_nationkey % 3), 'c' || (n_nationkey % 2), 'none'])) as chapter from nation)
  select item_id, coalesce(sum(n), 0)::bigint as n_chunks from it left join per using (chapter) group by 1""")
def chapter_coverage(spark, d):
    c = chunks(spark, d).withColumn("chapter", F.concat(F.lit("c"), F.floor(F.col("chunk_index") / 10)))
    name = lambda n: F.concat(F.lit("c"), F.col("n_nationkey") % n)
    items = t(spark, d, "nation").select(F.col("n_nationkey").alias("item_id"), F.array(name(3), name(2), F.lit("none")).alias("chapters"))
    return evaluation.chapter_coverage(items, c)


def _extractions(spark, d):
    words = F.regexp_extract_all("text", F.lit("[A-Z][a-z]{5,}"), F.lit(0))
    return t(spark, d, "documents").select("source", words.alias("entities"), F.when(F.col("doc_id") % 3 > 0, words).alias("relations"), F.when(F.col("doc_id") % 5 == 0, "invalid JSON").alias("error"), (F.col("doc_id") % 7 == 0).alias("truncated"), (F.col("n_chars") % 4).alias("ms"))


@query("""select count(*) as n_rows, count(error) as errors, round(count(error)::double / count(*), 6) as error_rate, count(*) filter (truncated) as repaired, round(avg(e), 6) as avg_entities, round(avg(r), 6) as avg_relations, round(avg(nullif(ms, 0)), 6) as avg_ms
  from (select len(w) as e, case when doc_id % 3 > 0 then len(w) else 0 end as r, case when doc_id % 5 = 0 then 'x' end as error, doc_id % 7 = 0 as truncated, n_chars % 4 as ms from (select *, regexp_extract_all(text, '[A-Z][a-z]{5,}') as w from documents))""")
def extraction_summary(spark, d):
    return G.extraction_summary(_extractions(spark, d))


@query("select doc_id % 4 as grp, count(*) as points, round(avg(case when quality = 1 and doc_id % 9 > 0 then 1.0 else 0.0 end), 6)::double as coverage from labels group by 1")
def rubric_coverage(spark, d):
    said = F.when(F.col("doc_id") % 9 > 0, F.when(F.col("quality") == 1, " ja, sicher").otherwise("Nein"))
    return G.rubric_coverage(t(spark, d, "labels").select((F.col("doc_id") % 4).alias("grp"), G.says_yes(said).alias("present")), ["grp"])


@query("""select user_id, count(*) filter (event_type in ('view', 'click', 'purchase')) as llm_calls, count(*) filter (event_type = 'click') as retries, greatest(count(*) filter (event_type = 'purchase') - 1, 0) as regens from events group by 1""")
def trace_counts(spark, d):
    node = F.when(F.col("event_type") == "view", "grade").when(F.col("event_type") == "click", "rewrite").when(F.col("event_type") == "purchase", "generate").otherwise("search")
    traces = t(spark, d, "events").groupBy("user_id").agg(F.collect_list(F.struct(node.alias("node"))).alias("trace"))
    out = G.trace_counts(traces)
    return out.select("user_id", *[F.col(c).cast("long").alias(c) for c in ("llm_calls", "retries", "regens")])


@query("select doc_id, case when doc_id % 3 = 0 then 'Kapitel ' || doc_id when doc_id % 3 = 1 then source || ' · bei ' || (doc_id % 100) || ' %' when doc_id % 2 = 0 then source else 'Quelle' end as label from documents")
def source_labels(spark, d):
    k = F.col("doc_id")
    chapter, title = F.when(k % 3 == 0, F.concat(F.lit("Kapitel "), k.cast("string"))).otherwise(F.when(k % 2 == 0, F.lit(""))), F.when((k % 3 == 1) | (k % 2 == 0), F.col("source"))
    return t(spark, d, "documents").select("doc_id", G.source_label(chapter, title, F.when(k % 3 == 1, k % 100)).alias("label"))


@query(f"""with {NEAREST}, mb as (select printf('v%06d', vec_id) as e, printf('c%03d', label) as c from cv), dg as (select e, sum(w) as deg from (select src as e, weight as w from ne union all select dst, weight from ne) group by 1)
  select c as community, string_agg(e, ',' order by coalesce(deg, 0) desc, e) as entities from mb left join dg using (e) group by 1""")
def community_entities(spark, d):
    return communities.ordered_entities(_labelled(spark, d), nearest(spark, d)).select("community", F.array_join("entities", ",").alias("entities"))


@query(f"""with {NEAREST}, mb as (select printf('v%06d', vec_id) as e, printf('c%03d', label) as c from cv)
  select * from (select a.c as community, row_number() over (partition by a.c order by weight desc, src, dst) as rank, src, dst, weight from ne join mb a on a.e = src join mb b on b.e = dst where a.c = b.c) where rank <= 12""")
def community_edges(spark, d):
    return communities.report_edges(_labelled(spark, d), nearest(spark, d), 12)


@query(f"""with {ENTITIES}, dg as (select src as e, sum(weight)::bigint as n from bo group by 1), al as (select 'degree' as kind, e, n from dg union all select 'mentions', entity_id, n_mentions from no union all select 'type', upper(left(entity_id, 1)), count(*) from no group by 2)
  select kind, rank, e as name, n from (select *, row_number() over (partition by kind order by n desc, e) as rank from al) where rank <= 10 or kind = 'type'""")
def graph_top_stats(spark, d):
    nodes, edges, mentions, _ = entity_graph(spark, d)
    named = nodes.withColumn("name", F.col("entity_id")).withColumn("type", F.upper(F.substring("entity_id", 1, 1)))
    return graph.top_stats(graph.Graph(named, edges, mentions, mentions, mentions))


@query("select row_number() over (order by md5(doc_id || ':42'), doc_id) as place, doc_id from labels")
def judge_order(spark, d):
    tasks = G.blind_order(t(spark, d, "labels").select("doc_id"), "doc_id")
    return tasks.select(F.row_number().over(Window.orderBy(F.md5(F.concat(F.col("doc_id").cast("string"), F.lit(":42"))), "doc_id")).alias("place"), "doc_id")


def chunk_graph(c: DataFrame) -> tuple[graph.Graph, DataFrame]:
    """A graph over chunks: two entities a chunk, by remainders of its number, each with the vector of its first chunk."""
    pair = F.array(F.concat(F.lit("e"), F.col("vec_id") % 17), F.concat(F.lit("f"), F.col("vec_id") % 23))
    mentions = saved(c.select("chunk_key", "vec_id", "vector", F.explode(pair).alias("entity_id")), "chunk-mentions")
    n = c.count()
    nodes = mentions.groupBy("entity_id").agg(F.count("*").alias("n_mentions"), F.min_by("vector", "vec_id").alias("vector")).withColumn("idf", graph.idf(F.col("n_mentions"), n)).withColumn("name", F.col("entity_id"))
    edges = c.select(pair.alias("p")).groupBy(F.col("p")[0].alias("src"), F.col("p")[1].alias("dst")).agg(F.count("*").alias("weight"))
    plain = mentions.select("entity_id", "chunk_key")
    return graph.Graph(nodes, edges, plain, plain, plain), nodes.select("entity_id", "vector")


def _graph_hits(spark, d, mode):
    c = chunks_once(spark, d)
    g, vectors = chunk_graph(c)
    q = asked(c).select("query_id", "query_vector")
    return R.graph_hits(q, c, g, vectors, 5, mode, graph.GraphParams(min_sim=0.1)).select("query_id", "rank", "chunk_key", F.round("score", 5).alias("score"))


@query()
def graph_link(spark, d):
    """Dense hits fused with passages of the entities that the question activates; tests hold it against plain loops, as the two below."""
    return _graph_hits(spark, d, "link")


@query()
def graph_expand(spark, d):
    return _graph_hits(spark, d, "expand")


@query()
def graph_only(spark, d):
    return _graph_hits(spark, d, "graph_only")


@query()
def service_answers(spark, d):
    """Each question by its service, with dense retrieval for those that get nothing; then answered and checked by stand-ins."""
    c = chunks_once(spark, d)
    g, vectors = chunk_graph(c)
    kind = F.when(F.col("query_id") % 3 == 0, "graph").when(F.col("query_id") % 3 == 1, "global").otherwise("dense")
    q = asked(c).select("query_id", "query_vector", F.concat(F.lit("Frage "), F.col("query_id").cast("string")).alias("question")).withColumn("service", kind)
    pick = lambda t: t.select("query_id", "rank", "score", *R.PLACE)
    services = {"graph": lambda x: pick(R.graph_hits(x, c, g, vectors, 4)), "global": lambda x: pick(ranking.retrieve(c, x, 4).withColumn("score", F.lit(0.0)).where("false")), "dense": lambda x: pick(ranking.retrieve(c, x, 4).withColumn("score", F.lit(0.0)))}
    hits = saved(R.by_service(q, services).withColumn("text", F.concat(F.lit("Stelle "), F.col("chunk_key"))), "hits")
    model = lambda p: F.when(p.contains("STRENG"), F.lit("Es steht da [1].")).otherwise(F.concat(F.lit("Antwort mit [1] und [2]. "), F.substring(F.md5(p), 1, 4)))
    entails = lambda premise, hypothesis: F.when(hypothesis.contains("Es steht") | premise.endswith("0"), 0.9).otherwise(0.1)
    answers, sources = G.checked_answers(q.drop("service"), hits, model, entails, Settings(), "system", "Antworte.", "STRENG")
    return answers.join(hits.select("query_id", "service").distinct(), "query_id", "left").select("query_id", "service", "regen", "n_sources", "unsupported", "llm_calls", F.length("answer").alias("chars"))
