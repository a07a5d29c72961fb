"""SentencePiece encoding by a table of distinct chunks, and decoding.

Where no piece of a model crosses into a whitespace marker, merges on two sides of a marker do not depend on each
other: a text is the chain of its chunks, each a run of markers with what follows them, and its ids are theirs in
order. So every distinct chunk is segmented once. Tasks cut their texts into chunks, by blocks of texts: the distinct
chunks of a block go to hash buckets, where equal ones of all blocks get the ids of the library's own segmentation, and
return to the block, whose texts are positions in the list of its chunks: ids are joined by position.

A block holds about ``BLOCK`` bytes of text, so its list is bounded too; a frequent chunk is once in each block's list.
Lists travel packed. Models with pieces across markers or with a normaliser are handled exactly as well: a text is one
chunk then.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from corvane.llm.common import bytes_of, materialise, table, unused

MARK = "▁"
#: Text of one block, unless a single text is longer, and bytes of a text that are cut at a time.
BLOCK, PART = 8 << 20, 4 << 20
#: Distinct chunks that are segmented at a time, and hash buckets of chunks at least.
AT_ONCE, LEAST_BUCKETS = 1 << 14, 1 << 10
_PROBE = f" \t a  Ａﬁéé{MARK} 　b\r\n  "


def processor(path: str):
    """The library's processor of a model file."""
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def separable(path: str) -> bool:
    """Whether chunks of the model's texts are independent: no piece has a marker after another character, and the
    normaliser only writes spaces as markers, one more at the front."""
    model = processor(path)
    crossing = re.compile(f"[^{MARK}]{MARK}")
    if any(crossing.search(model.id_to_piece(i)) for i in range(model.get_piece_size())):
        return False
    return model.normalize(_PROBE) == MARK + _PROBE.replace(" ", MARK)


def _parts(text: bytes) -> Iterator[bytes]:
    """Cut a text after ``PART`` bytes or more at single spaces, which are left out, between other characters."""
    at = 0
    while len(text) - at > PART:
        cut = re.compile(rb"[^ ] [^ ]").search(text, at + PART)
        if not cut:
            break
        yield text[at : cut.start() + 1]
        at = cut.start() + 2
    yield text[at:]


def chunks(text: bytes) -> Iterator[list[bytes]]:
    """The chunks of a text, in lists of bounded size, each without its first marker and with spaces for the others."""
    text = text.replace(MARK.encode(), b" ")
    if not text:
        return
    for part in _parts(text):
        words = part.split(b" ")
        if b"" in words:
            found, run = [], 0
            for word in words:
                if word:
                    found.append(b" " * run + word)
                    run = 0
                else:
                    run += 1
            words = found + [b" " * (run - 1)] * (run > 0)
        yield words


def whole(text: bytes) -> Iterator[list[bytes]]:
    """A text as its only chunk."""
    if text:
        yield [text]


def segment(model, found: Sequence[bytes], alone: bool) -> list[list[int]]:
    """Ids of chunks as the library gives them. The chunk of a marker alone has no text of its own that the library would
    mark: its ids are what a space at a text's end adds."""
    ids = model.encode(list(found), num_threads=1)
    if not alone:
        return ids
    bare = model.encode("a ")[len(model.encode("a")) :]
    return [own if chunk else bare for own, chunk in zip(ids, found, strict=True)]


def _bucket(chunk: bytes, buckets: int) -> int:
    return zlib.crc32(chunk) % buckets if buckets <= 1 << 32 else xxhash.xxh3_64_intdigest(chunk) % buckets


def _packed(numbers: Sequence[int] | np.ndarray, kind: str) -> bytes:
    return pa.compress(np.asarray(numbers, kind).tobytes(), codec="zstd", asbytes=True)


def _unpacked(packed: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), kind)


class _Numbers(dict):
    """Numbers of chunks in the order in which they are first asked for."""

    def __missing__(self, chunk: bytes) -> int:
        self[chunk] = number = len(self)
        return number


def _cut(cutter: Callable[[bytes], Iterator[list[bytes]]], buckets: int, lists: bool):
    """Blocks of texts, cut into chunks that are numbered as they come, in either of two views.

    ``lists``: rows (bucket, block, stamp, chunks), the block's distinct chunks by hash bucket. Else rows (block, kept, codes) of
    the texts, and one (block, stamp, order): the bucket of each number. The stamp names the list of chunks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = None
        block = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32
        known, held = _Numbers(), 0

        def batch_of(**columns: pa.Array) -> pa.RecordBatch:
            n = len(next(iter(columns.values())))
            return pa.RecordBatch.from_arrays([columns.get(f.name, pa.nulls(n, f.type)) for f in schema], schema=schema)

        def listed() -> Iterator[pa.RecordBatch]:
            stamp = xxhash.xxh3_64()
            for chunk in known:
                stamp.update(len(chunk).to_bytes(8, "little") + chunk)
            named = pa.array([stamp.intdigest() - (1 << 63)], pa.int64())
            bucket = np.fromiter((_bucket(c, buckets) for c in known), np.int64, len(known))
            if not lists:
                yield batch_of(block=pa.array([block], pa.int64()), stamp=named, order=pa.array([_packed(bucket, "<i8")], pa.binary()))
                return
            order, found = np.argsort(bucket, kind="stable"), list(known)
            cuts = np.flatnonzero(np.r_[True, np.diff(bucket[order]) > 0, True]) if len(order) else np.zeros(1, int)
            for at in range(0, len(cuts) - 1, 1 << 10):
                own = [order[x:y].tolist() for x, y in zip(cuts[at : at + (1 << 10)], cuts[at + 1 : at + 1 + (1 << 10)], strict=False)]
                packs = [_packed_chunks([found[i] for i in part]) for part in own]
                n = len(own)
                yield pa.RecordBatch.from_arrays([pa.array([int(bucket[p[0]]) for p in own], pa.int64()), pa.array([block] * n, pa.int64()), pa.array([named[0].as_py()] * n, pa.int64()), pa.array(packs, pa.binary())], ["bucket", "block", "stamp", "chunks"])

        for batch in batches:
            kept, texts = batch.column("kept"), batch.column("text")
            schema = schema or pa.schema([batch.schema.field("kept").with_nullable(True), ("block", pa.int64()), ("codes", pa.binary()), ("stamp", pa.int64()), ("order", pa.binary())])
            start, codes, blocks = 0, [], []
            for i, value in enumerate(texts):
                text = value.as_py() or b""
                if held and held + len(text) > BLOCK:
                    if i > start and not lists:
                        yield batch_of(block=pa.array(blocks, pa.int64()), kept=kept.slice(start, i - start), codes=pa.array(codes, pa.binary()))
                    yield from listed()
                    block, known, held, start, codes, blocks = block + 1, _Numbers(), 0, i, [], []
                if lists:
                    for words in cutter(text):
                        known.update(dict.fromkeys(words))
                else:
                    own = [np.fromiter(map(known.__getitem__, words), np.int32, len(words)) for words in cutter(text)]
                    codes.append(_packed(np.concatenate(own), "<i4") if own else b"")
                    blocks.append(block)
                held += len(text)
            if batch.num_rows > start and not lists:
                yield batch_of(block=pa.array(blocks, pa.int64()), kept=kept.slice(start), codes=pa.array(codes, pa.binary()))
        if schema is not None:
            yield from listed()

    return run


def _packed_chunks(found: list[bytes]) -> bytes:
    """Chunks as one string: their lengths, then their bytes."""
    return pa.compress(np.array([len(found), *map(len, found)], "<i4").tobytes() + b"".join(found), codec="zstd", asbytes=True)


def _unpacked_chunks(packed: bytes) -> list[bytes]:
    data = zstandard.ZstdDecompressor().decompress(packed)
    n = int(np.frombuffer(data, "<i4", 1)[0])
    ends = 4 * (n + 1) + np.cumsum(np.frombuffer(data, "<i4", n, 4), dtype=np.int64)
    return [data[a:b] for a, b in zip([4 * (n + 1), *ends[:-1].tolist()], ends.tolist(), strict=True)]


def _segmented(path: str, alone: bool, kind: str):
    """From rows (bucket, block, chunks) sorted by bucket, rows (block, bucket, ids): each distinct chunk of a bucket is
    segmented once. ``ids`` holds the number of ids of each chunk, then all ids."""

    def answered(model, rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
        lists = [_unpacked_chunks(packed) for *_, packed in rows]
        known = dict.fromkeys(c for own in lists for c in own)
        distinct = list(known)
        for at in range(0, len(distinct), AT_ONCE):
            known.update(zip(distinct[at : at + AT_ONCE], segment(model, distinct[at : at + AT_ONCE], alone), strict=True))
        out = []
        for own in lists:
            ids = [known[c] for c in own]
            sizes = np.fromiter(map(len, ids), np.int32, len(ids))
            flat = np.fromiter(chain.from_iterable(ids), kind, int(sizes.sum()))
            out.append(pa.compress(sizes.astype("<i4").tobytes() + flat.tobytes(), codec="zstd", asbytes=True))
        return pa.RecordBatch.from_arrays([pa.array([r[1] for r in rows], pa.int64()), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64()), pa.array([len(x) for x in lists], pa.int32()), pa.array(out, pa.binary())], ["block", "bucket", "stamp", "n", "ids"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, held = processor(path), []
        for batch in batches:
            for row in zip(*(batch.column(n).to_pylist() for n in ("bucket", "block", "stamp", "chunks")), strict=True):
                if held and held[-1][0] != row[0]:
                    yield answered(model, held)
                    held = []
                held.append(row)
        if held:
            yield answered(model, held)

    return run


def _joined(end: int | None, kind: str, into: str):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        marked = left.column("order").is_valid()
        texts, [order] = left.filter(pa.compute.invert(marked)).combine_chunks(), left.filter(marked).column("order").to_pylist()
        bucket, listed = _unpacked(order, "<i8"), right.sort_by("bucket")
        sizes, flat = [np.zeros(0, "<i4")], [np.zeros(0, kind)]
        for n, packed in zip(listed.column("n").to_pylist(), listed.column("ids").to_pylist(), strict=True):
            data = zstandard.ZstdDecompressor().decompress(packed)
            sizes.append(np.frombuffer(data, "<i4", n))
            flat.append(np.frombuffer(data, kind, offset=4 * n))
        by_bucket, own, ids = np.argsort(bucket, kind="stable"), np.concatenate(sizes).astype(np.int64), np.concatenate(flat)
        if len(own) != len(bucket) or {*listed.column("stamp").to_pylist()} - {*left.filter(marked).column("stamp").to_pylist()}:
            raise RuntimeError("a block's texts are not those that its chunks came from: the rows must be written first")
        size, start = np.zeros(len(bucket), np.int64), np.zeros(len(bucket), np.int64)
        size[by_bucket], start[by_bucket] = own, np.cumsum(own) - own
        out, lengths = [np.zeros(0, np.int32)], []
        for packed in texts.column("codes").to_pylist():
            length = 0
            if packed:
                codes = _unpacked(packed, "<i4")
                n = size[codes]
                length = int(n.sum())
                out.append(ids[np.repeat(start[codes] - np.cumsum(n) + n, n) + np.arange(length)].astype(np.int32))
            if end is not None:
                out.append(np.array([end], np.int32))
            lengths.append(length + (end is not None))
        values = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(lengths)].astype(np.int32)), pa.array(np.concatenate(out)))
        return pa.Table.from_arrays([texts.column("kept"), values], ["kept", into])

    return run


def _buckets(rows: DataFrame) -> int:
    """Hash buckets of chunks: one for each MB that Spark expects the rows to have, so that what meets in one stays small."""
    expected = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return min(max(LEAST_BUCKETS, expected >> 20), 1 << 40)


def encode(documents: DataFrame, path: str, columns: Sequence[str] = ("doc_id",), text: str = "text", end: bool = True, into: str = "ids", stored: bool = False) -> DataFrame:
    """The ids of every row's whole text, as the library gives them, beside the named columns.

    Null counts as the empty text; with ``end`` the model's end id is added to every text. Repeated rows stay. A carried
    column of the name ``into`` is an error. Texts are cut twice, for their chunks and for their positions, so the rows
    are written first unless they are ``stored``: read from a table as they are, which gives the same partitions every time. Rows
    that differ between the two are found out and raise.
    """
    if into.lower() in {c.lower() for c in columns}:
        raise ValueError(f"the column {into} is carried; give another name for the ids")
    model, alone = processor(path), separable(path)
    kind = "<u4" if model.get_piece_size() > 1 << 16 else "<u2"
    rows = documents.select(F.struct(*[F.col(f"`{c}`") for c in columns], F.lit(None).cast("int").alias(unused(documents, "own"))).alias("kept"), bytes_of(F.col(f"`{text}`")).alias("text"))
    if not stored:
        rows = materialise(rows, "texts")
    cutter, buckets = chunks if alone else whole, _buckets(rows)
    listed = rows.mapInArrow(_cut(cutter, buckets, True), "bucket bigint, block bigint, stamp bigint, chunks binary").repartition("bucket").sortWithinPartitions("bucket")
    listed = listed.mapInArrow(_segmented(path, alone, kind), "block bigint, bucket bigint, stamp bigint, n int, ids binary")
    carried = StructField("kept", rows.schema["kept"].dataType)
    texts = rows.mapInArrow(_cut(cutter, buckets, False), StructType([carried, *StructType.fromDDL("block bigint, codes binary, stamp bigint, `order` binary")]))
    out = StructType([carried, *StructType.fromDDL(f"`{into}` array<int>")])
    joined = texts.groupBy("block").cogroup(listed.groupBy("block")).applyInArrow(_joined(model.eos_id() if end else None, kind, into), out)
    return joined.select(*[F.col(f"kept.`{c}`").alias(c) for c in columns], F.col(f"`{into}`"))


def decoded(ids: Column, path: str) -> Column:
    """The text that the library decodes an array of ids to; null and empty arrays give the empty text."""

    def call(column: pa.Array) -> pa.Array:
        model = processor(path)
        ids, ends = column.flatten().to_numpy(zero_copy_only=False), np.cumsum(pa.compute.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False))
        texts: list[str] = []
        for at in range(0, len(column), 256):
            cuts = [int(ends[at - 1]) if at else 0, *ends[at : at + 256].tolist()]
            texts += model.decode([ids[a:b].tolist() for a, b in zip(cuts, cuts[1:], strict=False)])
        return pa.array(texts, pa.string())

    call.__annotations__ = {"column": pa.Array, "return": pa.Array}
    return F.arrow_udf(call, returnType="string")(ids)


def public_model(name: str = "piece_bpe_32k.model") -> str:
    """The path of a public model file, which every executor has."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op12_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of ids and digests of the ids and of the decoded text of every document."""
    path = public_model()
    ids = encode(table(spark, sf_dir, "documents"), path, stored=True)
    texts = ids.withColumn("decoded", decoded(F.col("ids"), path))
    listing = F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary")
    return texts.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), F.sha2(listing, 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
