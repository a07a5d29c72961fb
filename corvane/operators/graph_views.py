"""Graphs with provenance: validation, materialised elements, views by source, combination.

An element is what its provenance rows, in order, make of it. Every function takes that order from
``ord``; nothing depends on the order of rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.text import entity_key, type_key
from corvane.operators.ranking import global_rank
from corvane.sources.shared import materialise


def violations(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, id): repeated node ids, repeated edge ids, and edges with an end that does not exist."""
    repeated = lambda df, kind: df.groupBy("id").count().filter("count > 1").select(F.lit(kind).alias("kind"), "id")
    ends = edges.select("id", F.explode(F.array("source", "target")).alias("end"))
    dangling = ends.join(nodes.select(F.col("id").alias("end")), "end", "left_anti").select(F.lit("dangling edge").alias("kind"), "id").distinct()
    return repeated(nodes, "repeated node").unionByName(repeated(edges, "repeated edge")).unionByName(dangling)


def validate(nodes: DataFrame, edges: DataFrame) -> None:
    """Raise if the graph has a violation."""
    if found := violations(nodes, edges).take(5):
        raise ValueError("invalid graph: " + ", ".join(f"{r['kind']} {r['id']}" for r in found))


def _ordered(*fields: str) -> Column:
    return F.array_sort(F.collect_list(F.struct("ord", *fields)))


def _all(rows: Column, field: str) -> Column:
    none = F.array().cast("array<string>")
    return F.flatten(F.transform(rows, lambda x: F.coalesce(x[field], none)))


def _once(rows: DataFrame, values: Column, out: str, key=None) -> DataFrame:
    """(id, ``out``): the distinct values of all rows (id, ord, ...) of an element, those of one ``key`` once, in order of first
    occurrence. Repeats go before the values of an element meet, so its row holds what differs and no more."""
    each = rows.select("id", "ord", F.posexplode(values).alias("pos", "value")).filter("value is not null")
    each = each.withColumn("key", F.col("value") if key is None else key(F.col("value")))
    first = each.groupBy("id", "key").agg(F.min(F.struct("ord", "pos", "value")).alias("first"))
    return first.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("first", "key"))).alias(out))


def materialize_nodes(provenance: DataFrame) -> DataFrame:
    """Nodes from their provenance rows: label and properties of the first, the first type that is not unclassified, the
    first suggested type that is not empty, other labels and all aliases once, chunk ids once, in order."""
    none = F.array().cast("array<string>")
    rows = provenance.withColumnRenamed("canonical_node_id", "id")
    place = F.struct("ord", "label", "type")
    at = lambda wanted: F.when(wanted, place)
    classified, suggested = type_key(F.col("type")) != "unclassified", F.col("suggested_type") != ""
    firsts = rows.groupBy("id").agg(
        F.min_by(F.struct("label", "properties", "type"), place).alias("first"),
        F.min_by("type", at(classified)).alias("classified"),
        F.min_by("suggested_type", at(suggested)).alias("suggested_type"),
    )
    named = _once(rows, F.concat(F.array("label"), F.coalesce("aliases", none), F.coalesce("resolution_aliases", none)), "names", entity_key)
    cited = _once(rows, F.coalesce("chunk_ids", none), "chunks")
    joined = firsts.join(named, "id", "left").join(cited, "id", "left")
    others = F.filter(F.coalesce("names", F.array()), lambda n: (n["key"] != "") & (n["key"] != entity_key(F.col("first.label"))))
    return joined.select(
        "id",
        F.col("first.label").alias("label"),
        F.coalesce("classified", "first.type").alias("type"),
        "suggested_type",
        F.transform(others, lambda n: n["first"]["value"]).alias("aliases"),
        F.col("first.properties").alias("properties"),
        F.coalesce(F.transform("chunks", lambda c: c["key"]), none).alias("chunk_ids"),
    )


def materialize_edges(provenance: DataFrame, ends: DataFrame) -> DataFrame:
    """Edges (ends gives id, source, target) from their provenance rows: label and properties of the first, chunk ids once."""
    rows = provenance.withColumnRenamed("canonical_edge_id", "id")
    firsts = rows.groupBy("id").agg(F.min_by(F.struct("label", "properties"), F.struct("ord", "label", "properties")).alias("first"))
    none = F.array().cast("array<string>")
    cited = _once(rows, F.coalesce("chunk_ids", none), "chunks")
    joined = firsts.join(ends.select("id", "source", "target"), "id").join(cited, "id", "left")
    return joined.select("id", "source", "target", F.col("first.label").alias("label"), F.col("first.properties").alias("properties"), F.coalesce(F.transform("chunks", lambda c: c["key"]), none).alias("chunk_ids"))


def _connected(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    ids = nodes.select(F.col("id").alias("__id"))
    return edges.join(ids, F.col("source") == F.col("__id"), "left_semi").join(ids, F.col("target") == F.col("__id"), "left_semi")


def restricted_to(node_provenance: DataFrame, edge_provenance: DataFrame, edges: DataFrame, sources: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """The graph that the given sources alone make; elements without provenance there are left out."""
    own = F.col("source").isin(*sources)
    nodes = materialize_nodes(node_provenance.filter(own))
    return nodes, _connected(materialize_edges(edge_provenance.filter(own), edges), nodes)


def excluding(nodes: DataFrame, edges: DataFrame, node_provenance: DataFrame, edge_provenance: DataFrame, sources: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """The graph without the given sources. Elements that never had provenance stay as they are; those that lose all of
    theirs go; with no source to exclude everything stays as it is stored."""
    if not sources:
        return nodes, edges
    other = ~F.col("source").isin(*sources)
    bare = nodes.join(node_provenance.select(F.col("canonical_node_id").alias("id")), "id", "left_anti")
    left_nodes = bare.select("id", "label", "type", "suggested_type", "aliases", "properties", "chunk_ids").unionByName(materialize_nodes(node_provenance.filter(other)))
    bare = edges.join(edge_provenance.select(F.col("canonical_edge_id").alias("id")), "id", "left_anti")
    left_edges = bare.select("id", "source", "target", "label", "properties", "chunk_ids").unionByName(materialize_edges(edge_provenance.filter(other), edges))
    return left_nodes, _connected(left_edges, left_nodes)


def remapped(edges: DataFrame, node_map: DataFrame) -> DataFrame:
    """Edges with both ends replaced by ``node_map`` (old, new); ends that it does not name stay."""
    for end in ("source", "target"):
        own = node_map.select(F.col("old").alias(end), F.col("new").alias("__new"))
        edges = edges.join(own, end, "left").withColumn(end, F.coalesce("__new", end)).drop("__new")
    return edges


def combine_edges(edges: DataFrame, provenance: bool = True) -> DataFrame:
    """Edges (ord, id, source, target, label, properties, chunk_ids) merged by (source, target, label) in order.

    A merged edge keeps its first id where that is the first use of it; the others get the next free ``edge-0001``
    in order. Without ``provenance`` all do.
    """
    grouped = edges.groupBy("source", "target", "label").agg(_ordered("id", "properties", "chunk_ids").alias("p"))
    first = F.col("p")[0]
    rows = grouped.select("source", "target", "label", first["ord"].alias("ord"), first["id"].alias("id"), first["properties"].alias("properties"), F.array_distinct(_all(F.col("p"), "chunk_ids")).alias("chunk_ids"))
    use = F.row_number().over(Window.partitionBy("id").orderBy("ord"))
    rows = rows.withColumn("keeps", (use == 1) if provenance else F.lit(False))
    kept, others = rows.filter("keeps").drop("keeps"), rows.filter("not keeps").drop("keeps", "id")
    return kept.unionByName(numbered(others, kept))


def numbered(rows: DataFrame, used: DataFrame) -> DataFrame:
    """Edges (ord, ...) with ``id``: in order the next free ``edge-0001`` that no id of ``used`` holds.

    Beyond the largest number taken the free ones run on, so that only rows that fill a gap before it meet a table of them.
    """
    rows = global_rank(rows, F.col("ord"), name="n")
    taken = used.filter(F.col("id").rlike(r"^edge-\d{4,}$")).select(F.expr("try_cast(substr(id, 6) as bigint)").alias("number")).filter("number > 0").distinct()
    taken = materialise(taken, "taken")
    total, last = taken.agg(F.count("*"), F.coalesce(F.max("number"), F.lit(0))).first()
    placed = rows.filter(F.col("n") > last - total).withColumn("number", F.col("n") + total)
    if last > total:
        # as many numbers as there are rows and taken ones suffice
        numbers = rows.sparkSession.range(1, min(last, rows.count() + total) + 1).withColumnRenamed("id", "number")
        free = global_rank(numbers.join(taken, "number", "left_anti"), F.col("number"), name="n")
        placed = placed.unionByName(rows.filter(F.col("n") <= last - total).join(free, "n").select(*placed.columns))
    return placed.withColumn("id", F.format_string("edge-%04d", "number")).drop("n", "number")


def merge_edge_sets(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Stored edges (id, source, target, label, properties, chunk_ids) with incoming ones (ord, ...) merged in by their ends
    and label: a stored edge keeps its id and properties and gets the new chunk ids behind its own; new edges get the next
    free numbers in order. Only the ids that stored edges hold matter, not how they came by them."""
    key = ["source", "target", "label"]
    none = F.array().cast("array<string>")

    def merged(how: str) -> DataFrame:
        # incoming edges part before they meet, so that neither side carries the other's
        rows = incoming.join(stored.select(*key), key, how).groupBy(*key).agg(_ordered("properties", "chunk_ids").alias("p"))
        return rows.select(*key, F.col("p")[0]["ord"].alias("ord"), F.col("p")[0]["properties"].alias("properties"), F.array_distinct(_all(F.col("p"), "chunk_ids")).alias("chunk_ids"))

    more = merged("left_semi").select(*key, F.col("chunk_ids").alias("more"))
    kept = stored.join(more, key, "left").select("id", *key, "properties", F.array_distinct(F.concat(F.coalesce("chunk_ids", none), F.coalesce("more", none))).alias("chunk_ids"))
    return kept.unionByName(numbered(merged("left_anti"), stored).select("id", *key, "properties", "chunk_ids"))


def combine_nodes(nodes: DataFrame) -> DataFrame:
    """Nodes (ord, id, label, type, suggested_type, aliases, properties, chunk_ids) of several graphs, merged by id in order: as
    ``materialize_nodes`` does with contributions."""
    rows = nodes.withColumnRenamed("id", "canonical_node_id").withColumn("resolution_aliases", F.array().cast("array<string>"))
    return materialize_nodes(rows)
