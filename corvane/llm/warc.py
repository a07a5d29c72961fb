"""WARC archives: Spark writes whole-file gzip streams, a normaliser turns them into archives with one
gzip member per record and a sidecar offset index, and a reader goes through the index.

A monolithic archive can only be read from its start. The normaliser inflates each such stream once,
piece by piece, cuts it at the records' lengths, compresses every record as a member of its own and
notes where it lies. Files are written in the shared folder under names of their own attempt; only
what a finished task reports is used, so retried and speculative tasks do no harm.
"""

from __future__ import annotations

import base64
import hashlib
import json
import os
import uuid
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.common import bytes_of, materialise, shared_dir, table

#: What ends a record.
END = "\r\n\r\n"
#: Bytes that are inflated at a time.
PIECE = 1 << 20
LEVEL = 6
INDEX = "archive string, offset bigint, length bigint, record_id string, record_type string"


def file_system(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a URI or path, and the path in it."""
    return pyarrow.fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{os.path.abspath(uri)}")


def base32(digest):
    """A column of hexadecimal SHA-1 as bare upper-case base32."""
    five = lambda k: F.lpad(F.conv(F.substring(digest, 5 * k + 1, 5), 16, 2), 20, "0")
    bits = F.concat(*[five(k) for k in range(8)])
    letter = lambda k: F.substring(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"), F.conv(F.substring(bits, 5 * k + 1, 5), 2, 10).cast("int") + 1, 1)
    return F.concat(*[letter(k) for k in range(32)])


def records(pages: DataFrame, least_bytes: int = 0, date: str | None = None) -> DataFrame:
    """Pages (page_id, url, html) as WARC records: page_id, record (header and block as one string).

    A response's block is an HTTP message whose body is the payload; ``date`` (now, if none) is its WARC-Date. Without a
    url the record's own name is the target. Of pages with equal payloads of at least ``least_bytes``, the one with the smallest page_id is a response,
    the others revisits that name it and carry no block; smaller payloads are all responses. A null html is an
    empty payload. Rows with a null page_id are responses where no id shares their payload; repeated rows with the
    smallest id are all responses. Payloads count as
    equal if their SHA-1 and length are.
    """
    payload = bytes_of(F.col("html"))
    rows = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"), F.sha1(payload).alias("sha1"), F.octet_length(payload).cast("long").alias("size"))
    # payloads stay where they are read: what they are compared by is narrow, and only the revisits come back, by
    # page, as a table whose size Spark knows when it chooses between a broadcast and a shuffle
    keys = rows.filter(F.col("size") >= least_bytes).select("page_id", "sha1", "size")
    first = keys.groupBy("sha1", "size").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1")
    first = first.select(F.concat_ws(":", F.col("size").cast("string"), "sha1").alias("payload"), "first")
    again = keys.withColumn("payload", F.concat_ws(":", F.col("size").cast("string"), "sha1")).join(first, "payload")
    again = again.filter(~F.col("page_id").eqNullSafe(F.col("first"))).select(F.col("page_id").alias("__page"), F.col("sha1").alias("__sha1"), "first").distinct()
    again = materialise(again, "revisits")
    rows = rows.join(again, F.col("page_id").eqNullSafe(F.col("__page")) & (F.col("sha1") == F.col("__sha1")), "left")
    other = F.col("__sha1").isNotNull()
    name = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(c.cast("string"), F.lit("none")))
    line = lambda key, value: F.concat(F.lit(f"{key}: "), value, F.lit("\r\n"))
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    target = F.regexp_replace("url", r"[\x00-\x20\x7F]", "")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit(END))
    header = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(other, "revisit").otherwise("response")),
        line("WARC-Date", F.lit(date)),
        line("WARC-Record-ID", F.concat(F.lit("<"), name(F.col("page_id")), F.lit(">"))),
        line("WARC-Target-URI", F.when(target != "", target).otherwise(name(F.col("page_id")))),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32(F.col("sha1")))),
        line("X-Payload-Bytes", F.col("size").cast("string")),
        F.when(other & F.col("first").isNotNull(), line("WARC-Refers-To", F.concat(F.lit("<"), name(F.col("first")), F.lit(">")))).otherwise(""),
        F.when(other, line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))).otherwise(""),
        line("Content-Length", F.when(other, F.lit("0")).otherwise((F.octet_length(http) + F.col("size")).cast("string"))),
        F.lit("\r\n"),
    )
    return rows.select("page_id", F.concat(header, F.when(other, "").otherwise(F.concat(http, "html"))).alias("record"))


def write_monolithic(rows: DataFrame, folder: str) -> str:
    """Write records as gzip streams, one for each task, each compressed as a whole."""
    rows.select("record").write.option("compression", "gzip").option("lineSep", END).option("maxRecordsPerFile", 20_000).text(folder)
    return folder


def _header(head: bytes) -> dict[str, str]:
    lines = head.decode().split("\r\n")
    return {k: v for k, _, v in (x.partition(": ") for x in lines[1:])}


def split_records(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header and bytes of each record of an inflated stream; holds one record and one piece at a time."""
    held, pieces = bytearray(), iter(pieces)

    def fill(n: int) -> bool:
        while len(held) < n:
            piece = next(pieces, None)
            if piece is None:
                return False
            held.extend(piece)
        return True

    at = 0
    while True:
        cut = held.find(END.encode(), max(0, at - 3))
        if cut < 0:
            at = len(held)
            if not fill(at + 1):
                if held:
                    raise ValueError("the stream ends inside a record")
                return
            continue
        header = _header(bytes(held[:cut]))
        size = cut + 4 + int(header["Content-Length"]) + 4
        if not fill(size):
            raise ValueError("the stream ends inside a record")
        yield header, bytes(held[:size])
        del held[:size]
        at = 0


def inflate(raw, piece: int = PIECE) -> Iterator[bytes]:
    """A gzip stream of any number of members, from a file object, in pieces of bounded size."""
    unpack = zlib.decompressobj(31)
    data = raw.read(piece)
    while data:
        out = unpack.decompress(data, piece)
        data = unpack.unconsumed_tail
        if out:
            yield out
        if unpack.eof:
            data, unpack = unpack.unused_data, zlib.decompressobj(31)
        if not data:
            data = raw.read(piece)


def member(record: bytes, level: int = LEVEL) -> bytes:
    """A record as a gzip member."""
    pack = zlib.compressobj(level, zlib.DEFLATED, 31)
    return pack.compress(record) + pack.flush()


def _normalise(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = file_system(folder)
        system.create_dir(root, recursive=True)
        for batch in batches:
            for stream in batch.column("path").to_pylist():
                name = f"{uuid.uuid4().hex}.warc.gz"
                archive = f"{folder}/{name}"
                index, offset = [], 0
                of, path = file_system(stream)
                with system.open_output_stream(f"{root}/{name}", compression=None) as out, of.open_input_stream(path, compression=None) as raw:
                    for header, record in split_records(inflate(raw)):
                        packed = member(record)
                        out.write(packed)
                        index.append((archive, offset, len(packed), header["WARC-Record-ID"], header["WARC-Type"]))
                        offset += len(packed)
                with system.open_output_stream(f"{root}/{name}.idx.jsonl", compression=None) as out:
                    for row in index:
                        out.write(json.dumps(dict(zip(("archive", "offset", "length", "record_id", "record_type"), row, strict=True))).encode() + b"\n")
                columns = list(zip(*index, strict=True)) or [()] * 5
                kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["archive", "offset", "length", "record_id", "record_type"])

    return run


def normalise(spark: SparkSession, monolithic: str, folder: str) -> DataFrame:
    """Rewrite every gzip stream under ``monolithic`` as an archive of one member per record in ``folder``,
    each with a sidecar ``.idx.jsonl``. Returns the offset index. A task reads a stream in pieces and holds a piece
    and a record of it; only paths come through Spark."""
    streams = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(monolithic).select("path")
    return materialise(streams.mapInArrow(_normalise(folder), INDEX), "warc-index")


def remove(folder: str) -> None:
    """Delete a folder of streams or archives, once no table reads it."""
    system, path = file_system(folder)
    system.delete_dir(path)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    opened: tuple[str, object] | None = None
    for batch in batches:
        out = []
        for archive, offset, length in zip(*(batch.column(c).to_pylist() for c in ("archive", "offset", "length")), strict=True):
            if opened is None or opened[0] != archive:
                system, path = file_system(archive)
                opened = (archive, system.open_input_file(path))
            opened[1].seek(offset)
            [(header, record)] = split_records(inflate(pa.BufferReader(opened[1].read(length))))
            block = record[record.index(END.encode()) + 4 : -4]
            told = header["WARC-Payload-Digest"].removeprefix("sha1:")
            response = header["WARC-Type"] == "response"
            block = block[block.index(END.encode()) + 4 :] if response else block  # the body of the HTTP message
            if response and (told != base64.b32encode(hashlib.sha1(block).digest()).decode() or len(block) != int(header["X-Payload-Bytes"])):
                raise ValueError(f"record {header['WARC-Record-ID']} of {archive} does not have the payload that it names")
            page = lambda key: None if (x := header.get(key, "")[len("<urn:page:") : -1]) in ("", "none") else int(x)  # noqa: B023, E731
            out.append((page("WARC-Record-ID"), int(header["X-Payload-Bytes"]), told, header["WARC-Type"], page("WARC-Refers-To"), block if response else None))
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
        columns = list(zip(*out, strict=True)) or [()] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"])


def read_archives(index: DataFrame) -> DataFrame:
    """The records that an index names, each read at its offset: page_id, payload_bytes, payload_digest,
    record_type, refers_to, payload (null for revisits). A response's digest and length are verified."""
    kinds = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, payload binary"
    return index.mapInArrow(_read, kinds)


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    """The offset index of the archives in a folder, from their sidecar files."""
    return spark.read.schema(INDEX).json(f"{folder}/*.idx.jsonl")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written as a WARC record and read back from the normalised archives."""
    folder = f"{shared_dir(spark)}/corvane-warc-{uuid.uuid4().hex}"
    monolithic = write_monolithic(records(table(spark, sf_dir, "pages")), f"{folder}/monolithic")
    index = normalise(spark, monolithic, f"{folder}/archives")
    remove(monolithic)  # the index is a written table: nothing reads the streams again
    read = read_archives(index)
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP6_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY html) AS first, sha1(html) AS hex FROM p),
b AS (SELECT *, array_to_string(list_transform(range(8), lambda k: right('00000000000000000000' || bin(('0x' || substr(hex, (5 * k + 1)::INT, 5))::BIGINT), 20)), '') AS bits FROM f)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
       array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         (list_sum(list_transform(range(5), lambda j: CASE WHEN substr(bits, (5 * k + j + 1)::INT, 1) = '1' THEN 1 << (4 - j)::INT ELSE 0 END)) + 1)::INT, 1)), '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM b
"""
