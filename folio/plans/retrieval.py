"""Which passages a question gets: dense, linked through the entity graph, expanded from dense hits, or by the graph alone; and which service answers it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.functions.vectors import dot
from folio.lineage import saved
from folio.operators import graph, ranking
from folio.operators.graph import Graph, GraphParams
from folio.operators.ranking import OVERFETCH, top_k

PLACE = ["chunk_key", "book_id", "chunk_index", "char_start", "char_end"]
MODES = ("link", "expand", "graph_only")


def similarity(candidates: DataFrame, chunks: DataFrame, questions: DataFrame, query: str = "query_id") -> DataFrame:
    """Scores of (query, chunk_key) pairs alone: two equi-joins, no comparison of all with all."""
    pairs = candidates.select(query, "chunk_key").join(chunks.select(*PLACE, "vector"), "chunk_key").join(questions.select(query, "query_vector"), query)
    return pairs.select(query, *PLACE, F.round(dot(F.col("vector"), F.col("query_vector")), 6).alias("score"))


def activated(questions: DataFrame, g: Graph, entities: DataFrame, params: GraphParams, query: str = "query_id") -> DataFrame:
    """Entities that are like the question (entities: entity_id, vector of unit length) and, damped, their neighbours."""
    scores = ranking.dense_top_k(entities.select("entity_id", "vector"), questions.select(query, "query_vector"), params.top_m, query, "entity_id").drop("rank")
    return graph.hop_activations(graph.link_entities(scores, params, query), g.edges, params, query)


def graph_hits(questions: DataFrame, chunks: DataFrame, g: Graph, entities: DataFrame, k: int, mode: str = "link", params: GraphParams = GraphParams(), on: Column | None = None, query: str = "query_id") -> DataFrame:
    """Ranking of each question through the graph.

    link: k + 8 dense hits fused with passages of the entities that the question activates. expand: the entities come from the best dense hits, and a
    passage has to share several. graph_only: passages by graph score alone, as a share of the best one's.
    """
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}")
    n, fetched = k + OVERFETCH, max(params.expand_dense_k, k + OVERFETCH) if mode == "expand" else k + OVERFETCH
    columns = [query, "rank", "score", *PLACE]
    dense = None if mode == "graph_only" else saved(ranking.dense_top_k(chunks.select(*PLACE, *[c for c in ("vec_id", "group_id") if c in chunks.columns], "vector"), questions, fetched, query, on=on).select(*columns), "dense")
    least = params.expand_min_shared if mode == "expand" else 1
    if mode == "expand":
        active = graph.seeds_from_dense(ranking.dedup_overlaps(dense, params.expand_dense_k, query), g.mentions, g.nodes, params, query)
    else:
        active = activated(questions, g, entities, params, query)
    active = saved(active, "activations")
    if mode == "graph_only":
        ranked = graph.top_chunks(active, g.mentions, g.nodes, n, least, query)
        best = ranked.where("rank = 1").select(query, F.col("graph_score").alias("_max"))
        ranked = ranked.join(best, query)
        ranked = ranked.join(chunks.select(*PLACE), "chunk_key").select(query, "rank", F.round(F.coalesce(F.try_divide("graph_score", "_max"), F.lit(0.0)), 6).alias("score"), *PLACE)
        return ranking.dedup_overlaps(ranked, k, query)
    dense = dense.where(F.col("rank") <= n)
    pool = saved(graph.top_chunks(active, g.mentions, g.nodes, params.pool, least, query).drop("rank"), "pool")
    # the pool has the best score, so that with the scores of the dense hits it is all that fusion reads
    scores = pool.unionByName(graph.chunk_scores(active, g.mentions, g.nodes, least, query, dense).join(pool.select(query, "chunk_key"), [query, "chunk_key"], "left_anti"))
    return graph.fuse(dense, scores, similarity(pool, chunks, questions, query), k, params, query).withColumnRenamed("fused", "score")


def chosen_service(mode: Column, corrective: bool, has_graph: Column, has_index: Column) -> Column:
    """The service that answers: the corrective loop before all others if it is on; global questions need an index, linked retrieval a graph; else dense."""
    return F.when(F.lit(corrective), "crag").when((mode == "global") & has_index, "global").when(has_graph, "graph").otherwise("dense")


def by_service(questions: DataFrame, services: dict[str, Callable[[DataFrame], DataFrame]], query: str = "query_id", service: str = "service") -> DataFrame:
    """Each question's ranking by its own service (column `service`); one that gives a question nothing leaves it to `dense`. Adds `service` that answered."""
    parts = []
    for name, run in sorted(services.items()):
        if name != "dense":
            parts.append(run(questions.where(F.col(service) == name)).withColumn(service, F.lit(name)))
    found = parts[0] if parts else None
    for p in parts[1:]:
        found = found.unionByName(p, allowMissingColumns=True)
    left = questions if found is None else questions.join(found.select(query).distinct(), query, "left_anti")
    rest = services["dense"](left).withColumn(service, F.lit("dense"))
    return rest if found is None else found.unionByName(rest, allowMissingColumns=True)


def available_groups(groups: DataFrame, graphs: DataFrame, group: str = "group_id") -> DataFrame:
    """Groups with a flag whether a graph is there (graphs: group_id)."""
    return groups.join(graphs.select(group, F.lit(True).alias("has_graph")).distinct(), group, "left").withColumn("has_graph", F.coalesce("has_graph", F.lit(False)))
