"""Search over chunks: graph annotations, searchable fields, combined scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions.scoring import SIMILARITY_FLOOR, calibrate_bm25, calibrate_similarity, cosine, noisy_or
from corvane.functions.text import file_name, keep_first, search_key, stem
from corvane.operators.bm25 import bm25_scores
from corvane.sources.shared import materialise

#: Weights of the signals of a chunk.
WEIGHTS = {"labels": 2.0, "aliases": 1.5, "content": 1.0, "metadata": 0.5, "semantic": 1.0}


def in_order(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` with the elements of the array ``name`` sorted, each once."""
    rows = rows.withColumn(name, F.array_sort(name))
    return rows.withColumn(name, F.filter(name, lambda x, i: (i == 0) | ~x.eqNullSafe(F.get(name, i - 1))))


def _by_chunk(rows: DataFrame, name: str, fields: list[str]) -> DataFrame:
    """(chunk_id, ``name``): the rows of each chunk as structs of ``fields`` in order. Repeats go where a chunk's rows have met,
    sorted; a pass over all rows for them would be a shuffle of its own."""
    return in_order(rows.groupBy("chunk_id").agg(F.collect_list(F.struct(*fields)).alias(name)), name)


def attached_nodes(chunks: DataFrame, nodes: DataFrame) -> DataFrame:
    """(chunk_id, nodes): the nodes of each chunk in id order; chunk ids that do not exist are ignored."""
    fields = ["id", "label", "type", "suggested_type", "aliases", "properties"]
    rows = nodes.select(F.explode(F.array_distinct("chunk_ids")).alias("chunk_id"), *fields)
    return _by_chunk(rows.join(chunks.select(F.col("id").alias("chunk_id")), "chunk_id", "left_semi"), "nodes", fields)


def attached_edges(chunks: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(chunk_id, edges): the edges of each chunk in id order with their ends' labels; both ends must exist."""
    label = lambda name: nodes.select(F.col("id").alias(name), F.col("label").alias(f"{name}_label"))
    fields = ["id", "label", "source", "target", "properties"]
    rows = edges.select(F.explode(F.array_distinct("chunk_ids")).alias("chunk_id"), *fields)
    rows = rows.join(label("source"), "source").join(label("target"), "target").join(chunks.select(F.col("id").alias("chunk_id")), "chunk_id", "left_semi")
    return _by_chunk(rows, "edges", [*fields, "source_label", "target_label"])


def attached_kinds(chunks: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(chunk_id, edges): of the edges of each chunk the first of each label and properties, in id order; both ends must
    exist. That is all that search fields tell of edges, and tasks leave but these before a chunk's edges meet."""
    fields = ["id", "label", "source", "target", "properties"]
    rows = edges.select(F.explode(F.array_distinct("chunk_ids")).alias("chunk_id"), *fields)
    for end in ("source", "target"):
        rows = rows.join(nodes.select(F.col("id").alias(end)), end, "left_semi")
    first = rows.groupBy("chunk_id", "label", "properties").agg(F.min(F.struct(*fields)).alias("e"))
    first = first.join(chunks.select(F.col("id").alias("chunk_id")), "chunk_id", "left_semi")
    return first.groupBy("chunk_id").agg(F.array_sort(F.collect_list("e")).alias("edges"))


def annotated(chunks: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Chunks with their ``nodes`` and ``edges``, empty arrays where there are none."""
    return _annotated(chunks, nodes, attached_edges(chunks, nodes, edges))


def with_nodes(chunks: DataFrame, nodes: DataFrame) -> DataFrame:
    """Chunks with their ``nodes``, an empty array where there are none."""
    rows = chunks.withColumn("chunk_id", F.col("id")).join(attached_nodes(chunks, nodes), "chunk_id", "left")
    return rows.withColumn("nodes", F.coalesce("nodes", F.array())).drop("chunk_id")


def _annotated(chunks: DataFrame, nodes: DataFrame, attached: DataFrame) -> DataFrame:
    rows = with_nodes(chunks, nodes).withColumn("chunk_id", F.col("id")).join(attached, "chunk_id", "left")
    return rows.drop("chunk_id").withColumn("edges", F.coalesce("edges", F.array()))


def node_text(n: Column) -> Column:
    """A node as one line: label, type, aliases, suggested type, properties."""
    return F.concat_ws(
        " | ",
        F.concat(n["label"], F.lit(" ["), n["type"], F.lit("]")),
        F.when(F.size(n["aliases"]) > 0, F.concat(F.lit("aliases: "), F.array_join(n["aliases"], ", "))),
        F.concat(F.lit("suggested type: "), F.nullif(n["suggested_type"], F.lit(""))),
        F.concat(F.lit("properties: "), n["properties"]),
    )


def relationship_text(e: Column) -> Column:
    """An edge between its ends' labels as one line."""
    return F.concat_ws(" | ", F.concat(e["source_label"], F.lit(" --"), e["label"], F.lit("--> "), e["target_label"]), F.concat(F.lit("properties: "), e["properties"]))


def search_fields(rows: DataFrame) -> DataFrame:
    """Annotated chunks with the texts of their four searchable fields: labels, aliases, content, metadata."""
    joined = lambda values: F.array_join(keep_first(F.filter(values, lambda x: x.isNotNull()), search_key), "\n")
    each = lambda field: F.transform("nodes", lambda n: n[field])
    relation = F.transform("edges", lambda e: F.concat_ws(" | ", e["label"], F.concat(F.lit("properties: "), e["properties"])))
    path = F.array("source", file_name(F.col("source")), stem(F.col("source")))
    metadata = F.concat(path, F.coalesce("heading_path", F.array().cast("array<string>")), each("type"), each("suggested_type"), each("properties"), relation)
    return rows.withColumns(
        {
            "labels": joined(each("label")),
            "aliases": joined(F.flatten(F.transform("nodes", lambda n: F.coalesce(n["aliases"], F.array().cast("array<string>"))))),
            "content": F.col("text"),
            "metadata": joined(metadata),
        }
    )


def search_rows(chunks: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``search_fields`` of all chunks as a written table, with id, index and any vector: scores read it twice, and a second
    pass over it is not a second pass over the graph."""
    rows = search_fields(_annotated(chunks, nodes, attached_kinds(chunks, nodes, edges)))
    return materialise(rows.select("id", "index", "labels", "aliases", "content", "metadata", *[c for c in chunks.columns if c == "vector"]), "fields")


def searchable_text(rows: DataFrame) -> DataFrame:
    """Annotated chunks with ``searchable``, the text that is embedded: source, heading, content, entities, relationships."""
    section = lambda title, lines: F.when(F.size(lines) > 0, F.concat(F.lit(f"{title}:\n"), F.array_join(lines, "\n")))
    heading = F.when(F.size("heading_path") > 0, F.concat(F.lit("Heading:\n"), F.array_join("heading_path", " > ")))
    text = F.concat_ws(
        "\n", F.concat(F.lit("Source:\n"), "source"), heading, F.concat(F.lit("Content:\n"), "text"),
        section("Entities", F.transform("nodes", node_text)), section("Relationships", F.transform("edges", relationship_text)),
    )
    return rows.withColumn("searchable", text)


def chunk_scores(fields: DataFrame, query: str, query_vector: Sequence[float] | None = None, floor: float = SIMILARITY_FLOOR) -> DataFrame:
    """Chunks with search fields, and ``score`` > 0: noisy-or of four calibrated BM25 fields and, where the rows have a
    ``vector`` and the query has one, the calibrated cosine."""
    names = ["labels", "aliases", "content", "metadata"]
    raw = {f"raw_{n}": F.col(n) for n in names}
    scored = bm25_scores(fields, query, raw)
    signals = [(calibrate_bm25(F.col(f"raw_{n}")), WEIGHTS[n]) for n in names]
    semantic = F.lit(0.0)
    if query_vector is not None and "vector" in fields.columns:
        semantic = calibrate_similarity(cosine(F.col("vector"), F.array(*[F.lit(float(x)) for x in query_vector])), floor)
    scored = scored.withColumn("score", noisy_or([*signals, (semantic, WEIGHTS["semantic"])]))
    return scored.filter(F.col("score") > 0).drop(*raw)


def top_chunks(scored: DataFrame, k: int) -> DataFrame:
    """The k best chunks by score, index, id."""
    return scored.orderBy(F.desc("score"), "index", "id").limit(k)
