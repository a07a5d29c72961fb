"""Hybrid retrieval: chunks found directly and through the graph, fused by reciprocal rank."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.scoring import reciprocal_rank
from corvane.operators.chunk_search import chunk_scores, search_rows, top_chunks
from corvane.operators.paths import evidence_chunks, graph_paths
from corvane.sources.shared import materialise

#: Each branch gives so many times the chunks asked for.
POOL = 3
#: A chunk below this direct score is not returned, however it ranked.
LEAST_RELEVANCE = 0.05


def fuse(direct: DataFrame, graph: DataFrame) -> DataFrame:
    """Full outer union of two pools (id, index, score): id, index, fused, best_rank. Pools are small: a rank each."""
    place = F.row_number().over(Window.orderBy(F.desc("score"), "index", "id"))
    ranks = direct.select("id", "index", "score").withColumn("rank", place).unionByName(graph.select("id", "index", "score").withColumn("rank", place))
    return ranks.groupBy("id", "index").agg(F.sum(reciprocal_rank(F.col("rank"))).alias("fused"), F.min("rank").alias("best_rank"))


def retrieve(
    chunks: DataFrame, nodes: DataFrame, edges: DataFrame, query: str, top: int = 5, max_hops: int = 2, top_paths: int = 5,
    query_vector: Sequence[float] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(chunks, paths) for a query.

    Chunks by fused rank with ``score`` and ``relevance``, their direct score, which must reach 0.05: a chunk that
    only the graph found fails that. Paths stay whose chunks are all returned.
    """
    if min(top, max_hops, top_paths) < 1:
        raise ValueError("limits must be positive")
    scores = materialise(chunk_scores(search_rows(chunks, nodes, edges), query, query_vector).select("id", "index", "score"), "scores")
    paths = materialise(graph_paths(chunks, nodes, edges, query, max_hops, top_paths, query_vector), "paths")
    direct = top_chunks(scores, POOL * top)
    graph = top_chunks(evidence_chunks(paths, chunks).select("id", "index", "score"), POOL * top)
    fused = fuse(direct, graph).join(scores.select("id", F.col("score").alias("relevance")), "id", "left")
    kept = fused.filter(F.coalesce("relevance", F.lit(0.0)) >= LEAST_RELEVANCE).orderBy(F.desc("fused"), "best_rank", "index", "id").limit(top)
    kept = materialise(kept.select("id", F.col("fused").alias("score"), "relevance", "best_rank"), "kept")
    hits = chunks.join(F.broadcast(kept), "id")
    ids = kept.agg(F.collect_list("id").alias("ids"))
    retained = paths.crossJoin(F.broadcast(ids)).filter(F.size(F.array_except("chunk_ids", "ids")) == 0).drop("ids")
    return hits, retained
