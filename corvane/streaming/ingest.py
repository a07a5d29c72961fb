"""Incremental ingestion: documents that arrive in a folder are synchronised in micro-batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corvane.session import Extractor, KnowledgeBase
from corvane.sources.files import relative


def stream_markdown(spark: SparkSession, folder: str) -> DataFrame:
    """(source, markdown) of Markdown files as they arrive under a folder."""
    rows = spark.readStream.format("text").option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").load(folder)
    return rows.select(relative(F.col("_metadata.file_path"), folder).alias("source"), F.regexp_replace("value", "\r\n?", "\n").alias("markdown"))


def ingest(documents: DataFrame, base: KnowledgeBase, extract: Extractor, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Synchronise every micro-batch of (source, markdown) into the knowledge base.

    A batch adds to and replaces what is there; it deletes nothing. A batch that is run again changes nothing, since
    its documents have the hashes that they already have.
    """

    def batch(rows: DataFrame, _: int) -> None:
        rows = rows.dropDuplicates(["source"])
        base.merge(rows, extract)

    writer = documents.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
