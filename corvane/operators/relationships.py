"""Texts of nodes with their relationships, for embedding, and which texts a change makes stale."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def relationship_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, ord, line): a node's relationships once each, a line for an edge to and from it, ordered by the edges' ids.

    Both ends of an edge must exist. A row for each line: a hub's lines are not brought together.
    """
    end = lambda name: nodes.select(F.col("id").alias(name), F.col("label").alias(f"{name}_label"), F.col("type").alias(f"{name}_type"))
    joined = edges.select(F.col("id").alias("edge"), "source", "target", "label").join(end("source"), "source").join(end("target"), "target")
    out = F.struct(F.col("source").alias("id"), F.lit(0).alias("side"), F.format_string("outgoing %s to %s (%s)", "label", "target_label", "target_type").alias("line"))
    back = F.struct(F.col("target").alias("id"), F.lit(1).alias("side"), F.format_string("incoming %s from %s (%s)", "label", "source_label", "source_type").alias("line"))
    rows = joined.select("edge", F.explode(F.array(out, back)).alias("r")).select("edge", "r.*")
    first = rows.groupBy("id", "line").agg(F.min(F.struct("edge", "side")).alias("first"))
    return first.select("id", F.row_number().over(Window.partitionBy("id").orderBy("first")).alias("ord"), "line")


def node_texts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, text): label, type, suggested type, aliases, properties and relationships of nodes, a part a line."""
    listed = relationship_lines(nodes, edges).groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "line"))), lambda x: x["line"]), "; ").alias("relationships"))
    part = lambda name, value: F.concat(F.lit(f"{name}: "), value)
    text = F.concat_ws(
        "\n", part("label", F.col("label")), part("type", F.col("type")), part("suggested_type", F.nullif("suggested_type", F.lit(""))),
        F.when(F.size("aliases") > 0, part("aliases", F.array_join("aliases", ", "))), part("properties", F.col("properties")), part("relationships", F.col("relationships")),
    )
    return nodes.join(listed, "id", "left").select("id", text.alias("text"))


def stale(nodes_before: DataFrame, edges_before: DataFrame, nodes_after: DataFrame, edges_after: DataFrame) -> DataFrame:
    """(id) of the nodes whose text differs between two graphs: nodes that changed themselves, the ends of changed edges, and
    the other ends of the edges at a node whose label or type changed. Nodes that went have no text."""

    def changed(before: DataFrame, after: DataFrame, fields: list[str]) -> DataFrame:
        old, new = (rows.select("id", F.struct(*fields).alias(name)) for rows, name in ((before, "old"), (after, "new")))
        return old.join(new, "id", "full_outer").filter(~F.col("old").eqNullSafe(F.col("new"))).select("id")

    own = changed(nodes_before, nodes_after, ["label", "type", "suggested_type", "aliases", "properties"])
    named = changed(nodes_before, nodes_after, ["label", "type"])
    edges = edges_before.select("id", "source", "target").unionByName(edges_after.select("id", "source", "target"))
    moved = edges.join(changed(edges_before, edges_after, ["source", "target", "label"]), "id", "left_semi").select(F.explode(F.array("source", "target")).alias("id"))
    beside = lambda a, b: edges.join(named.withColumnRenamed("id", a), a, "left_semi").select(F.col(b).alias("id"))
    every = own.unionByName(moved).unionByName(beside("source", "target")).unionByName(beside("target", "source"))
    return nodes_after.select("id").join(every.distinct(), "id", "left_semi")
