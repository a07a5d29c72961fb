"""Graphs extracted from chunks: cached extraction, structural filters, chunk graphs.

The extractor is a function that the caller gives; what it returns is rows of nodes (chunk_id, ord, ref,
label, type, suggested_type) and edges (chunk_id, ord, source_ref, target_ref, label).
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.text import structural_key
from corvane.sources.shared import materialise

#: Types and labels that name the document's own structure, not something in the world.
STRUCTURAL_TYPES = ["chunk", "column", "file path", "heading", "link", "markdown table", "row", "source", "source path", "table", "url"]
STRUCTURAL_LABELS = ["chunk", "column", "document", "file path", "heading", "markdown table", "row", "source", "source path", "table"]


def cache_key(prompt: Column, schema: Column, model: Column) -> Column:
    """Identity of an extraction request."""
    return F.sha2(F.to_json(F.struct(model.alias("model"), prompt.alias("prompt"), schema.alias("schema"))).cast("binary"), 256)


def extract_missing(requests: DataFrame, cache: DataFrame, extract: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(results, cache): requests (id, key, ...) with ``result``; each key that the cache (key, result) lacks is asked for
    once, whatever the number of requests. ``extract`` turns rows of distinct requests into (key, result)."""
    missing = requests.join(cache, "key", "left_anti").dropDuplicates(["key"])
    after = cache.unionByName(extract(missing).select(*cache.columns))
    return requests.join(after, "key"), after


RESULT = "nodes ARRAY<STRUCT<ref: STRING, label: STRING, type: STRING, suggested_type: STRING>>, edges ARRAY<STRUCT<source_ref: STRING, target_ref: STRING, label: STRING>>"


class InvalidOutput(ValueError):
    """A model's answer that is not a graph."""


def checked(answer: dict) -> dict:
    """An answer with only the fields of a graph, or ``InvalidOutput``: every node needs a ref, a label and a type, every
    edge its ends and a label, all of them texts."""
    try:
        nodes = [{"ref": n["ref"], "label": n["label"], "type": n["type"], "suggested_type": n.get("suggested_type")} for n in answer["nodes"]]
        edges = [{k: e[k] for k in ("source_ref", "target_ref", "label")} for e in answer["edges"]]
    except (KeyError, TypeError, AttributeError) as error:
        raise InvalidOutput(str(error)) from error
    texts = [v for row in [*nodes, *edges] for k, v in row.items() if not (k == "suggested_type" and v is None)]
    if not all(isinstance(v, str) for v in texts):
        raise InvalidOutput("a field is not a text")
    return {"nodes": nodes, "edges": edges}


@dataclass(frozen=True)
class CachedExtractor:
    """A model that is asked once for each distinct content: ``ask`` turns a request (heading path, text) into an answer with
    nodes and edges; an invalid answer is asked for once more. ``model`` and ``schema`` name what answers depend on."""

    ask: Callable[[str, str], dict]
    model: str
    schema: str = "graph-1"

    def requests(self, chunks: DataFrame) -> DataFrame:
        """(chunk_id, key, heading, text) of chunks."""
        heading = F.when(F.size("heading_path") > 0, F.array_join("heading_path", " > ")).otherwise(F.lit("(none)"))
        rows = chunks.select(F.col("id").alias("chunk_id"), "source", heading.alias("heading"), "text")
        prompt = F.to_json(F.struct("heading", "text"))
        return rows.withColumn("key", cache_key(prompt, F.lit(self.schema), F.lit(self.model)))

    def answers(self, missing: DataFrame) -> DataFrame:
        """(key, result) of distinct requests, one call each."""
        ask = self.ask

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for rows in batches:
                out = []
                for r in rows.itertuples():
                    try:
                        answer = checked(ask(r.heading, r.text))
                    except InvalidOutput:
                        answer = checked(ask(r.heading, r.text))
                    out.append((r.key, json.dumps(answer)))
                yield pd.DataFrame(out, columns=["key", "result"])

        return missing.select("key", "heading", "text").mapInPandas(run, "key string, result string")

    def extract(self, chunks: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(nodes, edges, records): the graphs of chunks, and the records (source, key, result) that they use. The cache has
        (key, result, ...); what it has is not asked for again, whoever asked."""
        wanted = self.requests(chunks)
        known = cache.groupBy("key").agg(F.min("result").alias("result"))
        missing = wanted.join(known, "key", "left_anti").dropDuplicates(["key"])
        fresh = materialise(self.answers(missing), "answers")
        results = materialise(wanted.join(known.unionByName(fresh), "key").select("chunk_id", "source", "key", "result"), "results")
        graph = results.select("chunk_id", F.from_json("result", RESULT).alias("g"))
        nodes = graph.select("chunk_id", F.posexplode("g.nodes").alias("ord", "n")).select("chunk_id", "ord", "n.*")
        edges = graph.select("chunk_id", F.posexplode("g.edges").alias("ord", "e")).select("chunk_id", "ord", "e.*")
        return nodes, edges, results.select("source", "key", "result").distinct()


def is_structural() -> Column:
    """Whether a node (label, type) of a chunk (chunk_id, source, heading_path) names structure: by its type, its label,
    the chunk's id or source, or as ``chunk`` and a heading."""
    label, kind = structural_key(F.col("label")), structural_key(F.col("type"))
    headings = F.coalesce("heading_path", F.array().cast("array<string>"))
    whole = F.when(F.size(headings) > 0, F.array_join(headings, " > ")).otherwise(F.lit("(none)"))
    named = F.filter(F.transform(F.concat(headings, F.array(whole)), structural_key), lambda x: x != "")
    own = F.filter(F.array(structural_key(F.col("chunk_id")), structural_key(F.col("source"))), lambda x: x != "")
    wrapper = label.startswith("chunk ") & F.array_contains(named, F.trim(F.substr(label, F.lit(7))))
    return kind.isin(*STRUCTURAL_TYPES) | label.isin(*STRUCTURAL_LABELS) | F.array_contains(own, label) | wrapper


def chunk_graph(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, dropped) of all chunks.

    Structural nodes go, the others are numbered in order within their chunk. Edges at a structural node go silently;
    those at a reference that no node has are returned as dropped with the missing ends. Of edges with the same ends
    and label the first stays; the rest is numbered in order.
    """
    marked = nodes.withColumn("structural", is_structural())
    own = Window.partitionBy("chunk_id").orderBy("ord")
    number = F.sum((~F.col("structural")).cast("int")).over(own.rowsBetween(Window.unboundedPreceding, 0))
    marked = marked.withColumn("id", F.when(~F.col("structural"), F.format_string("%s::node-%04d", "chunk_id", number)))
    kept = marked.filter("not structural").select("chunk_id", "ord", "id", "label", "type", "suggested_type", F.array("chunk_id").alias("chunk_ids"))
    ends = lambda name: marked.select("chunk_id", F.col("ref").alias(f"{name}_ref"), F.col("id").alias(name), F.col("structural").alias(f"{name}_structural"))
    joined = edges.join(ends("source"), ["chunk_id", "source_ref"], "left").join(ends("target"), ["chunk_id", "target_ref"], "left")
    joined = joined.filter(~(F.coalesce("source_structural", F.lit(False)) | F.coalesce("target_structural", F.lit(False))))
    missing = F.array_compact(F.array(F.when(F.col("source").isNull(), "source"), F.when(F.col("target").isNull(), "target")))
    dropped = joined.filter(F.col("source").isNull() | F.col("target").isNull()).select("chunk_id", "ord", "source_ref", "target_ref", "label", missing.alias("missing"))
    same = F.row_number().over(Window.partitionBy("chunk_id", "source", "target", "label").orderBy("ord"))
    first = joined.filter(F.col("source").isNotNull() & F.col("target").isNotNull()).withColumn("same", same).filter("same = 1")
    named = first.withColumn("id", F.format_string("edge-%04d", F.row_number().over(own)))
    return kept, named.select("chunk_id", "ord", "id", "source", "target", "label", F.array("chunk_id").alias("chunk_ids")), dropped


def counters(nodes: DataFrame, kept: DataFrame, edges: DataFrame, named: DataFrame, dropped: DataFrame) -> DataFrame:
    """Raw, kept and dropped nodes and edges by chunk."""
    count = lambda df, name: df.groupBy("chunk_id").agg(F.count("*").alias(name))
    rows = count(nodes, "raw_nodes").join(count(kept, "kept_nodes"), "chunk_id", "left")
    for df, name in ((edges, "raw_edges"), (named, "kept_edges"), (dropped, "dropped_edges")):
        rows = rows.join(count(df, name), "chunk_id", "left")
    return rows.na.fill(0)
