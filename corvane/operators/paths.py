"""Graph paths that answer a query: mentions, seeds, beam traversal, ranking, evidence.

Every hop is one join of the frontier, never more rows than the beam, with the adjacency, and a
ranking of what it reached; statistics of a hop's texts are those of its own candidates. Paths carry
what ranking needs of their nodes and edges, so no hop looks them up again.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.scoring import SIMILARITY_FLOOR, calibrate_bm25, calibrate_similarity, cosine, noisy_or
from corvane.functions.text import tokenize
from corvane.operators.bm25 import bm25_scores
from corvane.sources.shared import materialise

SEEDS, BEAM = 5, 50
MENTION, HOP_DECAY = 0.9, 0.85


def _strings() -> Column:
    return F.array().cast("array<string>")


def adjacency(edges: DataFrame) -> DataFrame:
    """Each edge from both ends: node, edge_id, neighbour, label, forward, chunk_ids; a self-loop once."""
    out = edges.select(F.col("source").alias("node"), F.col("id").alias("edge_id"), F.col("target").alias("neighbour"), "label", F.lit(True).alias("forward"), "chunk_ids")
    back = edges.filter("source <> target").select(F.col("target").alias("node"), F.col("id").alias("edge_id"), F.col("source").alias("neighbour"), "label", F.lit(False).alias("forward"), "chunk_ids")
    return out.unionByName(back)


def mentioned(nodes: DataFrame, query: str) -> DataFrame:
    """(id, mention): nodes whose label or an alias stands in the query, word for word. A match that lies within a
    longer match, of whatever node, does not count."""
    said = re.findall("[a-z0-9]+", query.lower())
    if not said:
        return nodes.select("id", F.lit(MENTION).alias("mention")).limit(0)
    asked = F.array(*[F.lit(w) for w in said])
    names = nodes.select("id", F.explode(F.concat(F.array("label"), F.coalesce("aliases", _strings()))).alias("name")).select("id", tokenize(F.col("name")).alias("name"))
    names = names.filter((F.size("name") > 0) & (F.size("name") <= len(said)))
    starts = F.filter(F.sequence(F.lit(1), F.lit(len(said)) - F.size("name") + 1), lambda s: F.slice(asked, s, F.size("name")) == F.col("name"))
    found = names.select("id", F.explode(starts).alias("start"), F.size("name").alias("length"))
    # intervals of the query: no more than its words squared
    spans = found.select(F.col("start").alias("s"), F.col("length").alias("l")).distinct()
    inside = (F.col("s") <= F.col("start")) & (F.col("start") + F.col("length") <= F.col("s") + F.col("l")) & (F.col("l") > F.col("length"))
    return found.join(F.broadcast(spans), inside, "left_anti").select("id", F.lit(MENTION).alias("mention")).distinct()


def node_search_text(label: str = "label") -> Column:
    """Label, type, aliases, suggested type and properties of a node, a line each."""
    return F.concat_ws("\n", F.col(label), F.col("type"), F.array_join(F.when(F.size("aliases") > 0, F.col("aliases")), "\n"), F.nullif(F.col("suggested_type"), F.lit("")), F.col("properties"))


def seed_scores(nodes: DataFrame, query: str, query_vector: Sequence[float] | None = None, floor: float = SIMILARITY_FLOOR) -> DataFrame:
    """Nodes with ``search_text``, ``mention`` and ``score``: noisy-or of label, mention, metadata and, with vectors, meaning."""
    rows = nodes.withColumn("search_text", node_search_text()).join(mentioned(nodes, query), "id", "left")
    rows = bm25_scores(rows, query, {"label_score": F.col("label"), "metadata_score": F.col("search_text")})
    semantic = F.lit(0.0)
    if query_vector is not None and "vector" in nodes.columns:
        semantic = calibrate_similarity(cosine(F.col("vector"), F.array(*[F.lit(float(x)) for x in query_vector])), floor)
    score = noisy_or([(calibrate_bm25(F.col("label_score")), 2.0), (F.col("mention"), 2.0), (calibrate_bm25(F.col("metadata_score")), 1.0), (semantic, 1.0)])
    return rows.withColumns({"score": score, "mention": F.coalesce("mention", F.lit(0.0))}).drop("label_score", "metadata_score")


def seeds(scored: DataFrame, k: int = SEEDS) -> DataFrame:
    """The k nodes with the highest positive score, ties by id."""
    return scored.filter("score > 0").orderBy(F.desc("score"), "id").limit(k)


def deduplicated(paths: DataFrame) -> DataFrame:
    """One of the paths with the same edges in either direction: the highest seed, then the larger reversed nodes."""
    key = F.least(F.col("edge_ids"), F.reverse("edge_ids"))
    first = F.row_number().over(Window.partitionBy("__key").orderBy(F.desc("seed_score"), F.desc(F.reverse("node_ids"))))
    return paths.withColumn("__key", key).withColumn("__first", first).filter("__first = 1").drop("__key", "__first")


def ranked(paths: DataFrame, chunks: DataFrame, query: str) -> DataFrame:
    """Paths with ``chunk_ids`` (their evidence: the edges' chunks, or else the nodes') and ``score``."""
    wanted = paths.select("edge_ids", "node_ids", F.posexplode(F.concat("edge_chunks", "node_chunks")).alias("at", "chunk_id"), F.size("edge_chunks").alias("n_edge"))
    known = wanted.join(chunks.select(F.col("id").alias("chunk_id"), "text"), "chunk_id")
    some = F.array_sort(F.collect_list(F.struct("at", "chunk_id", "text", (F.col("at") < F.col("n_edge")).alias("of_edge"))))
    found = known.groupBy("edge_ids", "node_ids").agg(some.alias("found"))
    edge_found = F.filter("found", lambda x: x["of_edge"])
    chosen = F.when(F.size(edge_found) > 0, edge_found).otherwise(F.col("found"))
    ids = F.transform(chosen, lambda x: x["chunk_id"])
    once = F.filter(chosen, lambda x, i: F.array_position(ids, x["chunk_id"]) == i + 1)
    found = found.select("edge_ids", "node_ids", F.transform(once, lambda x: x["chunk_id"]).alias("chunk_ids"), F.array_join(F.transform(once, lambda x: x["text"]), "\n").alias("evidence"))
    rows = paths.join(found, ["edge_ids", "node_ids"], "left").withColumn("chunk_ids", F.coalesce("chunk_ids", _strings()))
    rows = bm25_scores(rows, query, {"__path": F.array_join("steps", "\n"), "__evidence": F.coalesce("evidence", F.lit(""))})
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda a, b: a + b)
    coverage = total(F.slice(F.sort_array("node_scores", False), 1, 2)) / 2.0
    mention = total(F.col("mentions")) / F.size("mentions")
    decay = F.pow(F.lit(HOP_DECAY), F.size("edge_ids") - 1)
    score = noisy_or([(calibrate_bm25(F.col("__path")), 1.0), (calibrate_bm25(F.col("__evidence")), 0.5), (coverage, 1.0), (mention, 1.0)]) * decay
    return rows.withColumn("score", score).drop("__path", "__evidence", "evidence")


def best_paths(paths: DataFrame, k: int) -> DataFrame:
    """The k best paths by score, hops, nodes, edges."""
    return paths.orderBy(F.desc("score"), F.size("edge_ids"), "node_ids", "edge_ids").limit(k)


def traverse(chunks: DataFrame, edges: DataFrame, scored_nodes: DataFrame, query: str, max_hops: int = 2, beam: int = BEAM) -> DataFrame:
    """Candidate paths of 1 to ``max_hops`` edges from the seeds, no node twice, at most ``beam`` of each length."""
    text = scored_nodes.select("id", "search_text", F.col("score").alias("node_score"), "mention", F.col("chunk_ids").alias("node_chunk_ids"))
    step, text = adjacency(edges), text.withColumnRenamed("id", "neighbour")
    frontier = seeds(scored_nodes).select(
        F.array("id").alias("node_ids"), _strings().alias("edge_ids"), F.col("score").alias("seed_score"), F.col("search_text").alias("last_text"), _strings().alias("steps"),
        F.array("score").alias("node_scores"), F.array("mention").alias("mentions"), F.coalesce("chunk_ids", _strings()).alias("node_chunks"), _strings().alias("edge_chunks"),
    )
    # steps are written as tables, whose size Spark knows: a small frontier's texts are looked up without moving the others
    frontier, reached = materialise(frontier, "frontier"), None
    for _ in range(max_hops):
        # the frontier, at most the beam, picks its edges; only their other ends are looked up
        on = F.broadcast(frontier).join(step, F.element_at("node_ids", -1) == F.col("node")).filter(~F.array_contains("node_ids", F.col("neighbour")))
        on = materialise(on, "picked").join(text, "neighbour")
        direction = F.when(F.col("forward"), F.col("label")).otherwise(F.concat(F.lit("inverse "), "label"))
        more = lambda array, value: F.concat(array, F.array(value))
        expanded = on.select(
            more("node_ids", F.col("neighbour")).alias("node_ids"), more("edge_ids", F.col("edge_id")).alias("edge_ids"), "seed_score", F.col("search_text").alias("last_text"),
            more("steps", F.concat_ws("\n", "last_text", direction, "search_text")).alias("steps"), more("node_scores", F.col("node_score")).alias("node_scores"),
            more("mentions", F.col("mention")).alias("mentions"), F.concat("node_chunks", F.coalesce("node_chunk_ids", _strings())).alias("node_chunks"),
            F.concat("edge_chunks", F.coalesce("chunk_ids", _strings())).alias("edge_chunks"),
        )
        frontier = materialise(best_paths(ranked(materialise(deduplicated(expanded), "expanded"), chunks, query), beam).drop("score", "chunk_ids"), "frontier")
        reached = frontier if reached is None else reached.unionByName(frontier)
        if frontier.isEmpty():
            break
    return deduplicated(reached)


def dealt(nodes: DataFrame) -> DataFrame:
    """The nodes as a table of a file for each core: millions fit in one file, which a single task would read and match."""
    return materialise(nodes.repartition(nodes.sparkSession.sparkContext.defaultParallelism, "id"), "dealt")


def graph_paths(chunks: DataFrame, nodes: DataFrame, edges: DataFrame, query: str, max_hops: int = 2, top_paths: int = 5, query_vector: Sequence[float] | None = None) -> DataFrame:
    """The best paths with evidence: node_ids, edge_ids, chunk_ids, score."""
    if min(max_hops, top_paths) < 1:
        raise ValueError("max_hops and top_paths must be positive")
    scored = materialise(seed_scores(dealt(nodes), query, query_vector), "seed-scores")
    candidates = materialise(traverse(chunks, edges, scored, query, max_hops, max(BEAM, 5 * top_paths)), "candidates")
    found = ranked(candidates, chunks, query).filter(F.size("chunk_ids") > 0)
    return best_paths(found, top_paths).select("node_ids", "edge_ids", "chunk_ids", "score")


def evidence_chunks(paths: DataFrame, chunks: DataFrame) -> DataFrame:
    """The chunks that the paths rest on, each with the best path's score."""
    best = paths.select(F.explode("chunk_ids").alias("id"), "score").groupBy("id").agg(F.max("score").alias("score"))
    return chunks.join(best, "id")
