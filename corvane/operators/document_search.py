"""Documents of a chunk table: a catalogue, and search by metadata, passages and name."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.functions.scoring import reciprocal_rank
from corvane.functions.text import document_key, file_name, keep_first, stem, title
from corvane.operators.bm25 import bm25_scores
from corvane.operators.ranking import global_rank

MOST_HEADINGS = 20


def catalog(chunks: DataFrame) -> DataFrame:
    """One row per source: source, title, headings (distinct heading paths in order of first appearance), chunk_count."""
    heading = F.array_join(F.coalesce("heading_path", F.array().cast("array<string>")), " > ")
    rows = chunks.select("source", "index", heading.alias("heading"), document_key(heading).alias("key"))
    once = rows.groupBy("source", "key").agg(F.min(F.struct("index", "heading")).alias("first"), F.count("*").alias("n"))
    listed = F.array_sort(F.collect_list(F.when(F.col("key") != "", F.col("first"))))
    grouped = once.groupBy("source").agg(F.transform(listed, lambda x: x["heading"]).alias("headings"), F.sum("n").alias("chunk_count"))
    return grouped.select("source", title(F.col("source")).alias("title"), "headings", "chunk_count")


def search_documents(documents: DataFrame, query: str, passages: DataFrame | None = None, allowed: Sequence[str] | DataFrame | None = None, top: int = 5) -> DataFrame:
    """The best ``top`` documents of a catalogue: reciprocal ranks by metadata and by first passage hit, and 1 more where
    the query contains the file name or title.

    ``passages`` is ranked hits (source, rank), a rank for each hit; metadata ranks are given among allowed sources (a list, or a table with a
    column source)
    with a positive score. Only documents in one of the two lists are returned.
    """
    if top < 1:
        raise ValueError("top must be positive")
    text = F.concat_ws("\n", "source", file_name(F.col("source")), stem(F.col("source")), "title", F.array_join("headings", "\n"))
    scored = bm25_scores(documents, query, {"score": text})
    if isinstance(allowed, DataFrame):
        permitted = lambda df: df.join(allowed.select("source").distinct(), "source", "left_semi")
    else:
        permitted = lambda df: df if allowed is None else df.filter(F.col("source").isin(*allowed))
    found = permitted(scored.filter("score > 0")).select("source", "score")
    ranks = global_rank(found, F.desc("score"), F.col("source"), name="metadata_rank").drop("score")
    if passages is not None:
        ranks = ranks.join(permitted(passages).groupBy("source").agg(F.min("rank").alias("passage_rank")), "source", "full_outer")
    else:
        ranks = ranks.withColumn("passage_rank", F.lit(None).cast("int"))
    said = F.lit(" ".join(query_words(query)))
    names = lambda c: (document_key(c) != "") & (F.instr(said, document_key(c)) > 0)
    named = names(file_name(F.col("source"))) | names(F.col("title"))
    score = F.when(named, 1.0).otherwise(0.0) + reciprocal_rank(F.col("metadata_rank")) + reciprocal_rank(F.col("passage_rank"))
    rows = documents.join(ranks, "source").withColumn("score", score).orderBy(F.desc("score"), "source").limit(top)
    return rows.select("source", "title", F.slice("headings", 1, MOST_HEADINGS).alias("headings"), "chunk_count", "score")


def query_words(query: str) -> list[str]:
    """The query's tokens as they stand, repeats included."""
    return re.findall("[a-z0-9]+", query.casefold())
