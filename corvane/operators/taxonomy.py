"""Suggested node types: collection, promotion, migration."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.functions.text import type_key

LEAST_NODES, LEAST_SOURCES = 5, 2


def suggestions(nodes: DataFrame) -> DataFrame:
    """Suggestion records from nodes (id, label, type, suggested_type, source, chunk_ids) whose suggestion is not blank."""
    rows = nodes.withColumn("normalized_suggested_type", type_key(F.col("suggested_type"))).filter("normalized_suggested_type <> ''")
    return rows.select("suggested_type", "normalized_suggested_type", F.col("id").alias("node_id"), F.col("label").alias("node_label"), F.col("type").alias("current_type"), "source", F.get("chunk_ids", 0).alias("chunk_id"))


def aggregate_suggestions(records: DataFrame) -> DataFrame:
    """One row per normalised type: distinct nodes and sources, spellings, and the sources, sorted."""
    return records.groupBy("normalized_suggested_type").agg(
        F.count_distinct("source", "node_id").alias("node_count"),
        F.count_distinct("source").alias("source_count"),
        F.array_sort(F.collect_set("suggested_type")).alias("spellings"),
        F.array_sort(F.collect_set("source")).alias("sources"),
    )


def promotions(aggregated: DataFrame, registry: DataFrame, least_nodes: int = LEAST_NODES, least_sources: int = LEAST_SOURCES) -> DataFrame:
    """The suggestions with enough nodes and sources that the registry (type) does not have yet."""
    enough = aggregated.filter((F.col("node_count") >= least_nodes) & (F.col("source_count") >= least_sources))
    return enough.join(registry.select(F.col("type").alias("normalized_suggested_type")), "normalized_suggested_type", "left_anti")


def migrate(nodes: DataFrame, promoted: DataFrame) -> DataFrame:
    """Nodes with the promoted type (normalized_suggested_type) where they are unclassified and suggested it, their suggestion
    taken away, and ``migrated``."""
    own = promoted.select(F.col("normalized_suggested_type").alias("__promoted"))
    rows = nodes.join(own, type_key(F.col("suggested_type")) == F.col("__promoted"), "left")
    moves = (type_key(F.col("type")) == "unclassified") & F.col("__promoted").isNotNull()
    return rows.withColumns({"type": F.when(moves, F.col("__promoted")).otherwise(F.col("type")), "migrated": moves, "suggested_type": F.when(~moves, F.col("suggested_type"))}).drop("__promoted")


def affected_nodes(migrated: DataFrame) -> DataFrame:
    """(type, node) of migrated nodes (source, id): one row for each node that a promotion changed."""
    return migrated.filter("migrated").select("type", F.concat_ws(":", F.nullif("source", F.lit("")), "id").alias("node")).distinct()


def evolve(registry: DataFrame, records: DataFrame, nodes: DataFrame, earlier: DataFrame | None = None, least_nodes: int = LEAST_NODES, least_sources: int = LEAST_SOURCES) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(registry, nodes, promotions, affected): promote the suggestions (records) that are frequent enough and migrate nodes,
    to types that were promoted ``earlier`` (type) too, so that it does not matter when a node comes.

    The registry (type) gets the new types; promotions are (type, matched_suggestions, reason); nodes (source, id, type,
    suggested_type, ...) carry ``migrated``; affected has a row (type, node) for each, so that no list grows with the corpus.
    """
    promoted = promotions(aggregate_suggestions(records), registry, least_nodes, least_sources)
    reason = F.format_string("Appeared in %d nodes across %d source documents.", "node_count", "source_count")
    audit = promoted.select(F.col("normalized_suggested_type").alias("type"), F.col("spellings").alias("matched_suggestions"), reason.alias("reason"))
    own = promoted.select("normalized_suggested_type")
    moved = migrate(nodes, own if earlier is None else own.unionByName(earlier.select(F.col("type").alias("normalized_suggested_type")).distinct()))
    return registry.select("type").unionByName(audit.select("type")), moved, audit, affected_nodes(moved)
