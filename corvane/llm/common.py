"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.sources.shared import checkpoint, materialise, shared_dir

__all__ = ["blocks", "bytes_of", "checkpoint", "crc_mod", "materialise", "packed", "shared_dir", "small_batches", "table", "text_udf", "unpacked", "unused", "vector_sum"]

#: Bytes of text that one block of rows holds inside a task, unless a single row is longer.
BLOCK_BYTES = 16 << 20
#: Bytes of an Arrow batch in a session with ``small_batches``, unless a single row is longer.
BATCH_BYTES = 4 << 20

#: Whitespace that ends a word, and a word, as Java and DuckDB regular expressions.
SPACE_CLASS = r"[ \x09-\x0D]+"
WORD_CLASS = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The named Parquet table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """From now on tasks of the session send texts to Python in batches of about ``BATCH_BYTES``: a batch lies in memory on
    both sides, with room for its growth, and by default it is as large as a whole partition."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def bytes_of(text: Column) -> Column:
    """UTF-8 bytes of a text, empty for null."""
    return F.coalesce(text, F.lit("")).cast("binary")


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def blocks(batches: Iterator[pa.RecordBatch], column: str, most: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into slices whose texts hold about ``most`` bytes; long rows stand alone."""
    for batch in batches:
        at, held = 0, 0
        lengths = pa.compute.binary_length(batch.column(column)).fill_null(0).to_pylist()
        for i, n in enumerate(lengths):
            if i > at and held + n > most:
                yield batch.slice(at, i - at)
                at, held = i, 0
            held += n
        if at < batch.num_rows:
            yield batch.slice(at)


def text_udf(function: Callable[[list[bytes]], pa.Array], returns: str):
    """An Arrow UDF over the bytes of a text column; ``function`` gets a bounded list of texts at a time."""

    def call(column: pa.Array) -> pa.Array:
        parts, texts, held = [], [], 0
        for value in column:
            text = value.as_py() or b""
            if texts and held + len(text) > BLOCK_BYTES:
                parts.append(function(texts))
                texts, held = [], 0
            texts.append(text)
            held += len(text)
        if texts or not parts:
            parts.append(function(texts))
        return parts[0] if len(parts) == 1 else pa.concat_arrays(parts)

    call.__annotations__ = {"column": pa.Array, "return": pa.Array}
    return F.arrow_udf(call, returnType=returns)


def unused(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Positions of a long vector that travel in one row, and partial vectors that one task adds up at a time.
CHUNK, FAN = 1 << 16, 64


def packed(x: np.ndarray) -> bytes:
    """An array's values, compressed."""
    return pa.compress(np.ascontiguousarray(x).data.cast("B") if x.size else b"", codec="zstd", asbytes=True)


def unpacked(x: bytes, n: int, kind: str) -> np.ndarray:
    """The ``n`` values that ``packed`` was given."""
    return np.frombuffer(pa.decompress(x, decompressed_size=np.dtype(kind).itemsize * n, codec="zstd", asbytes=True), kind)


def vector_sum(rows: DataFrame, partial: Callable[[pa.RecordBatch], np.ndarray], length: int) -> np.ndarray:
    """The sum over all rows of a vector of whole numbers of fixed length: tasks add up their own, chunks of it are
    added in groups of ``FAN`` tasks, twice, then by chunk, so no task's share grows with the number of tasks before a
    million of them. Only the total reaches the driver. A batch's vector may be of any type; it is added in place."""

    def pack(x: np.ndarray) -> bytes:
        return packed(x.astype("<i8"))

    def unpack(x: bytes, n: int) -> np.ndarray:
        return unpacked(x, n, "<i8")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                total = np.zeros(length, np.int64) if total is None else total
                total += partial(batch)
        if total is not None:
            context = TaskContext.get()
            part = context.partitionId() // FAN if context else 0
            for chunk, at in enumerate(range(0, length, CHUNK)):
                own = total[at : at + CHUNK]
                yield pa.RecordBatch.from_arrays([pa.array([chunk]), pa.array([part]), pa.array([len(own)]), pa.array([pack(own)], pa.binary())], ["chunk", "part", "n", "x"])

    def add(group: pa.Table) -> pa.Table:
        n, total = group.column("n")[0].as_py(), 0
        for x in group.column("x"):
            total = total + unpack(x.as_py(), n)
        return pa.table({"chunk": [group.column("chunk")[0].as_py()], "part": [group.column("part")[0].as_py() // FAN], "n": [n], "x": pa.array([pack(total)], pa.binary())})

    kinds = "chunk bigint, part bigint, n bigint, x binary"
    parts = rows.mapInArrow(run, kinds)
    for keys in (["chunk", "part"], ["chunk", "part"], ["chunk"]):
        parts = parts.groupBy(*keys).applyInArrow(add, kinds)
    out = np.zeros(length, np.int64)
    for r in parts.collect():
        out[r["chunk"] * CHUNK : r["chunk"] * CHUNK + r["n"]] = unpack(bytes(r["x"]), r["n"])
    return out
