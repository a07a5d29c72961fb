"""Incremental maintenance: snapshot differences, affected elements, deltas, conditional upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.functions.text import content_hash


def snapshot_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(source, change) between two snapshots (source, content_hash): added, deleted, changed or unchanged."""
    left = before.select("source", F.col("content_hash").alias("old"))
    right = after.select("source", F.col("content_hash").alias("new"))
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "deleted").when(F.col("old") != F.col("new"), "changed").otherwise("unchanged")
    return left.join(right, "source", "full_outer").select("source", change.alias("change"))


def hashed(documents: DataFrame) -> DataFrame:
    """Documents (source, markdown) with their content hash."""
    return documents.withColumn("content_hash", content_hash(F.col("markdown")))


def affected(node_provenance: DataFrame, edge_provenance: DataFrame, edges: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Ids of the nodes and edges that ``sources`` (source) contribute to; edges at an affected node too."""
    nodes = node_provenance.join(sources, "source", "left_semi").select(F.col("canonical_node_id").alias("id")).distinct()
    own = edge_provenance.join(sources, "source", "left_semi").select(F.col("canonical_edge_id").alias("id"))
    ends = edges.select("id", F.explode(F.array("source", "target")).alias("end"))
    incident = ends.join(nodes.withColumnRenamed("id", "end"), "end", "left_semi").select("id")
    return nodes, own.unionByName(incident).distinct()


def delta(old_affected: DataFrame, new_affected: DataFrame, new_rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(upserts, deleted ids): of the elements affected before or after, those that exist now, and the rest."""
    every = old_affected.unionByName(new_affected).distinct()
    return new_rows.join(every, "id", "left_semi"), every.join(new_rows.select("id"), "id", "left_anti")


def apply_delta(base: DataFrame, upserts: DataFrame, deleted: DataFrame, key: str = "id") -> DataFrame:
    """``base`` without the touched rows, and the upserts."""
    touched = upserts.select(key).unionByName(deleted.select(key))
    return base.join(touched, key, "left_anti").unionByName(upserts.select(*base.columns))


def row_changes(stored: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """(key, change): what a full replacement writes: I(nsert), U(pdate), D(elete) or = for rows that stay."""
    columns = [c for c in stored.columns if c != key]
    left, right = stored.select(key, F.struct(*columns).alias("old")), wanted.select(key, F.struct(*columns).alias("new"))
    change = F.when(F.col("old").isNull(), "I").when(F.col("new").isNull(), "D").when(F.col("old") == F.col("new"), "=").otherwise("U")
    return left.join(right, key, "full_outer").select(key, change.alias("change"))


def conditional_upsert(stored: DataFrame, incoming: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(table, written): the table after an upsert, and the rows that really differ from what it held."""
    columns = [c for c in stored.columns if c != key]
    old = stored.select(key, F.struct(*columns).alias("__old"))
    rows = incoming.join(old, key, "left")
    written = rows.filter(F.col("__old").isNull() | ~F.struct(*columns).eqNullSafe(F.col("__old"))).select(*stored.columns)
    return stored.join(written.select(key), key, "left_anti").unionByName(written), written


def replace_sources(stored: DataFrame, rows: DataFrame) -> DataFrame:
    """``stored`` with all rows of the sources in ``rows`` replaced by them."""
    return stored.join(rows.select("source").distinct(), "source", "left_anti").unionByName(rows.select(*stored.columns))


def cached_vectors(inputs: DataFrame, cache: DataFrame, model: str, embed) -> DataFrame:
    """(id, embedding_model, embedding_input_hash, vector) for inputs (id, text).

    A vector is taken from the cache for the same id, model and text, or else for the same model and text; texts
    that are nowhere are embedded once each by ``embed``, a function from a text column to a vector column.
    A null text has no vector.
    """
    text_hash = F.sha2(F.col("text").cast("binary"), 256).alias("embedding_input_hash")
    rows = inputs.select("id", F.lit(model).alias("embedding_model"), text_hash)
    known = cache.filter(F.col("embedding_model") == model)
    own = known.select("id", "embedding_input_hash", F.col("vector").alias("own"))
    same = known.groupBy("embedding_input_hash").agg(F.min_by("vector", "id").alias("same"))
    # a text moves once, to its hash, and one of each from a task; ids and hashes meet what was found there
    texts = inputs.filter("text is not null").select("text", text_hash).dropDuplicates(["embedding_input_hash"])
    missing = texts.join(same.filter("same is not null"), "embedding_input_hash", "left_anti")
    fresh = missing.select("embedding_input_hash", embed(F.col("text")).cast("array<float>").alias("fresh"))
    rows = rows.join(same, "embedding_input_hash", "left").join(fresh, "embedding_input_hash", "left").join(own, ["id", "embedding_input_hash"], "left")
    return rows.select("id", "embedding_model", "embedding_input_hash", F.coalesce("own", "same", "fresh").alias("vector"))


def reusable(expected: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """The keys whose stored manifest equals the expected one in every setting, nulls included: their conversion stands."""
    settings = [c for c in expected.columns if c != key]
    left = expected.select(key, F.struct(*settings).alias("wanted"))
    right = stored.select(key, F.struct(*settings).alias("found"))
    return left.join(right, key).filter(F.col("wanted").eqNullSafe(F.col("found"))).select(key)
