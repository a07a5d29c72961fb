"""Graphs for viewers: JSON of nodes and edges with tooltips, by source and as a whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def escaped(text: Column) -> Column:
    """A text inside HTML."""
    for mark, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(mark), F.lit(entity))
    return text


def tooltip(rows: list[tuple[str, Column]]) -> Column:
    """Bold names with escaped values, a line each; null values are ``null``."""
    return F.concat_ws("<br>", *[F.concat(F.lit(f"<b>{name}</b>: "), escaped(F.coalesce(value, F.lit("null")))) for name, value in rows])


def viewer_nodes(nodes: DataFrame) -> DataFrame:
    """id, label, group and tooltip of nodes."""
    title = tooltip([("id", F.col("id")), ("type", F.col("type")), ("suggested_type", F.col("suggested_type")), ("chunk_ids", F.to_json("chunk_ids")), ("properties", F.coalesce("properties", F.lit("{}")))])
    return nodes.select("id", "label", F.col("type").alias("group"), title.alias("title"))


def viewer_edges(edges: DataFrame) -> DataFrame:
    """from, to, label and tooltip of edges."""
    title = tooltip([("id", F.col("id")), ("label", F.col("label")), ("chunk_ids", F.to_json("chunk_ids")), ("properties", F.coalesce("properties", F.lit("{}")))])
    return edges.select(F.col("source").alias("from"), F.col("target").alias("to"), "label", title.alias("title"))


def export_graph(nodes: DataFrame, edges: DataFrame, folder: str) -> None:
    """Write both as JSON lines; what lay there before is replaced."""
    viewer_nodes(nodes).write.mode("overwrite").json(f"{folder}/nodes")
    viewer_edges(edges).write.mode("overwrite").json(f"{folder}/edges")


def export_by_source(provenance_nodes: DataFrame, folder: str) -> None:
    """Nodes with a ``source`` column as JSON lines in a folder per source; folders of sources that are gone go too."""
    provenance_nodes.write.mode("overwrite").partitionBy("source").json(folder)
