"""Retrieval results as text: a block per chunk, a line per path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.operators.chunk_search import node_text, relationship_text
from corvane.operators.references import location_label


def _listed(title: str, lines: Column) -> Column:
    return F.when(F.size(lines) > 0, F.concat(F.lit(f"{title}:\n- "), F.array_join(lines, "\n- ")))


def chunk_blocks(hits: DataFrame) -> DataFrame:
    """Annotated hits with ``block``: a line of id, source, location and heading in brackets, the text, and the entities and
    relationships of the chunk."""
    location = location_label(F.col("source"), F.col("page_start"), F.col("page_end"))
    heading = F.when(F.size("heading_path") > 0, F.array_join("heading_path", " > "))
    head = F.concat(F.lit("["), F.concat_ws(" | ", "id", "source", location, heading), F.lit("]"))
    entities = _listed("Linked entities", F.transform("nodes", node_text))
    relations = _listed("Linked relationships", F.transform("edges", relationship_text))
    return hits.withColumn("block", F.concat_ws("\n", head, "text", entities, relations))


def path_lines(paths: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Paths (node_ids, edge_ids, chunk_ids, score) with ``line``: labels and arrows in the edges' own direction, and the
    evidence chunks below. Paths are few; their nodes and edges are looked up by join."""
    rows = paths.withColumn("path", F.array_join("edge_ids", "\0"))
    steps = rows.select("path", F.posexplode("edge_ids").alias("k", "edge_id"), "node_ids")
    steps = steps.select("path", "k", "edge_id", F.get("node_ids", F.col("k")).alias("left"), F.get("node_ids", F.col("k") + 1).alias("right"), F.get("node_ids", F.lit(0)).alias("first"))
    steps = steps.join(edges.select(F.col("id").alias("edge_id"), "source", F.col("label").alias("by")), "edge_id")
    label = lambda c: nodes.select(F.col("id").alias(c), F.col("label").alias(f"{c}_label"))
    steps = steps.join(label("right"), "right").join(label("first"), "first")
    arrow = F.when(F.col("source") == F.col("left"), F.concat(F.lit("--"), "by", F.lit("--> "))).otherwise(F.concat(F.lit("<--"), "by", F.lit("-- ")))
    said = F.array_sort(F.collect_list(F.struct("k", F.concat(arrow, "right_label").alias("s"))))
    lines = steps.groupBy("path").agg(F.concat_ws(" ", F.first("first_label"), F.array_join(F.transform(said, lambda x: x["s"]), " ")).alias("text"))
    evidence = F.when(F.size("chunk_ids") > 0, F.concat(F.lit("\n  Evidence chunks: "), F.array_join("chunk_ids", ", "))).otherwise("")
    return rows.join(lines, "path").withColumn("line", F.concat(F.lit("- "), "text", evidence)).drop("path", "text")


def context_text(query: str, blocks: DataFrame, lines: DataFrame) -> str:
    """The whole context of a result: its few blocks and lines, in order of score."""
    found = [r["block"] for r in blocks.orderBy(F.desc("score"), "index", "id").select("block").collect()]
    paths = [r["line"] for r in lines.orderBy(F.desc("score"), F.size("edge_ids"), "node_ids", "edge_ids").select("line").collect()]
    parts = [f"Query: {query}", "Evidence:\n" + ("\n\n".join(found) or "- None")]
    return "\n\n".join([*parts, "Graph paths:\n" + "\n".join(paths)] if paths else parts)
