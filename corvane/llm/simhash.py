"""SimHash near-duplicates by a byte-position inverted index with count filtering.

Fingerprints of 64 bits that differ in at most d bits differ in at most d of their 8 bytes, so they share at
least 8 - d positional bytes: that is the guaranteed minimum of matches. A posting's key is a combination of
``KEY`` positions with their bytes, fewer than the minimum (4 of 5 for d = 3), so pairs that can be linked meet
in several lists and pairs that cannot meet in some: in a list the shared positional bytes of each pair are
tallied, pairs that reach the minimum are retained, and their bits verified. Keys of one byte would make lists
of a 256th of the corpus that meet quadratically; the README has figures for the widths.

``drop_near_duplicates`` finds texts whose sets of 5-word shingles have a Jaccard similarity of 0.8 or more with
the same index. Sign bits cannot tell such pairs (the README has figures), so the positional bytes are those
of ``POSITIONS`` least hashes of the set, two of which agree with the probability of the similarity: the minimum
of matches is far below what pairs at the threshold share, and retained pairs are verified by their whole sets.

Equal fingerprints and equal sets are collapsed before, and links leave the lists as spanning forests.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import postings
from corvane.llm.common import bytes_of, materialise, table, text_udf, unused
from corvane.llm.components import components

SHINGLE = 3
SEED = 42
MOST_BITS = 3
#: Positions of a posting's key.
KEY = 4
#: Words of a shingle and the least similarity, as a fraction of whole numbers, of near-duplicate texts.
SET_SHINGLE, LEAST = 5, (4, 5)
#: Positional bytes of a set, positions of a posting's key (each position is in one), and the minimum of matches: pairs at
#: the threshold share 51 on average with a deviation of 3.2, and no key of 16 with a chance of 2 in 10,000.
POSITIONS, SET_KEY, MATCHES = 64, 4, 36

_ORDERS = np.random.default_rng(SEED).integers(1 << 63, size=(3, POSITIONS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _fingerprints(texts: list[bytes]) -> pa.Array:
    digest, out = xxhash.xxh64_intdigest, np.zeros(len(texts), np.uint64)
    for i, text in enumerate(texts):
        words = text.lower().split()
        n = len(words) - SHINGLE + 1
        if not words:
            continue
        joined = b" ".join(words)
        if n <= 1:
            out[i] = digest(joined, SEED)
            continue
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lengths + 1) - 1
        starts, ends = (ends - lengths)[:n].tolist(), ends[SHINGLE - 1 :].tolist()
        ones = np.zeros(64, np.int64)
        for at in range(0, n, 1 << 16):
            part = [digest(joined[a:b], SEED) for a, b in zip(starts[at : at + (1 << 16)], ends[at : at + (1 << 16)], strict=True)]
            bits = np.unpackbits(np.array(part, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones += bits.sum(axis=0, dtype=np.int64)
        out[i] = np.packbits(2 * ones > n, bitorder="little").view("<u8")[0]
    return pa.array(out.view(np.int64))


def fingerprint(text: Column) -> Column:
    """The SimHash of a text as a long: A-Z lower-cased, XXH64 of the 3-word shingles, a bit set where over
    half of the hashes have it. Fewer words are one shingle; null, empty and blank texts give zero."""
    return text_udf(_fingerprints, "bigint")(bytes_of(text))


def _close(x: np.ndarray, most_bits: int) -> np.ndarray:
    """Of differences x: shared positional bytes tallied, the minimum reached, the bits verified."""
    tally = (np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8) == 0).sum(axis=1)
    out = tally >= 8 - most_bits
    out[out] = np.bitwise_count(x[out]) <= most_bits
    return out


def _fingerprints_close(most_bits: int):
    def make(rows: pa.Table):
        f = rows.column("data").to_numpy().view(np.uint64)
        return lambda i, j: _close(f[i] ^ f[j], most_bits)

    return make


def posting_keys(fp: Column, width: int) -> Column:
    """The keys of a fingerprint's postings: a hash of each combination of ``width`` positions with their bytes."""
    masks = [int.from_bytes(bytes(255 * (i in positions) for i in range(8)), "little", signed=True) for positions in combinations(range(8), width)]
    return F.array(*[F.xxhash64(F.lit(k), fp.bitwiseAND(F.lit(m))) for k, m in enumerate(masks)])


def link_fingerprints(distinct: DataFrame, most_bits: int = MOST_BITS, width: int = KEY) -> DataFrame:
    """From distinct fingerprints (fp), links (a, b) that span the components of those within ``most_bits`` bits.

    ``width`` may be at most the guaranteed minimum, 8 - ``most_bits``.
    """
    if not 0 < width <= 8 - most_bits:
        raise ValueError("pairs within the bits need not share that many positional bytes")
    members = postings.members_of(distinct.select(F.explode(posting_keys(F.col("fp"), width)).alias("key"), "fp"))
    data, close = distinct.select("fp", F.col("fp").alias("data")), _fingerprints_close(most_bits)
    links = materialise(postings.first_links(members, data, close), "links")
    long = members.filter("parts > 1")
    if long.take(1):
        links = links.unionByName(postings.second_links(postings.apart(long, links), data, close))
    return links


def component_of_fingerprints(rows: DataFrame, most_bits: int = MOST_BITS) -> DataFrame:
    """From rows (doc_id, fp), (fp, component_id): the smallest doc_id reachable from each fingerprint.

    Null ids name no component unless all ids of one are null.
    """
    classes = materialise(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "fingerprints")
    roots = components(link_fingerprints(classes.select("fp"), most_bits))
    rooted = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    rooted = materialise(rooted, "roots")
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    # inverted keys, as in the rounds of components: a large component can be split among tasks
    smallest = smallest.select(F.bitwise_not("root").alias("k"), "component_id")
    return rooted.select("fp", "root", F.bitwise_not("root").alias("k")).join(smallest, "k").select("fp", "component_id", "root")


def near_duplicates(documents: DataFrame, most_bits: int = MOST_BITS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row of documents (doc_id, text).

    Repeated rows stay; null, empty and blank texts have fingerprint zero and are linked like any other.
    """
    rows = materialise(documents.select("doc_id", fingerprint(F.col("text")).alias("fp")), "simhash")
    named = rows.join(component_of_fingerprints(rows, most_bits), "fp")
    return named.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def shingles(text: bytes) -> np.ndarray:
    """The sorted distinct hashes of a text's 5-word shingles, A-Z lower-cased; fewer words are one shingle, no words none."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    digest, joined = xxhash.xxh64_intdigest, b" ".join(words)
    if len(words) <= SET_SHINGLE:
        return np.array([digest(joined, SEED)], np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(words) - SET_SHINGLE + 1].tolist()
    return np.unique(np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[SET_SHINGLE - 1 :].tolist(), strict=True)], np.uint64))


def _positional_bytes(own: np.ndarray) -> bytes:
    """One byte for each of ``POSITIONS`` hash orders: of the set's least hash in it."""
    least = np.full(POSITIONS, np.iinfo(np.uint64).max)
    for at in range(0, len(own), 1024):
        mixed = (own[at : at + 1024, None] ^ _ORDERS[0]) * _ORDERS[1]
        least = np.minimum(least, (mixed ^ (mixed >> np.uint64(32))).min(axis=0))
    return ((least * _ORDERS[2]) >> np.uint64(56)).astype(np.uint8).tobytes()


def _sketches(texts: list[bytes]) -> pa.Array:
    sets = [shingles(t) for t in texts]
    names = np.array([xxhash.xxh3_64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)
    return pa.StructArray.from_arrays([pa.array(names), pa.array([len(s) for s in sets], pa.int32()), pa.array([_positional_bytes(s) for s in sets], pa.binary())], ["fp", "n", "bytes"])


def sketch(text: Column) -> Column:
    """The name of a text's set of shingles (equal sets have equal names), its size and its positional bytes."""
    return text_udf(_sketches, "struct<fp:bigint,n:int,bytes:binary>")(bytes_of(text))


def _similar(a: np.ndarray, b: np.ndarray) -> bool:
    least, of = LEAST
    if of * min(len(a), len(b)) < least * max(len(a), len(b)):
        return False
    shared = len(a) + len(b) - len(np.union1d(a, b))
    return of * shared >= least * (len(a) + len(b) - shared)


def _tally_close(rows: pa.Table):
    """Pairs that share the minimum of positional bytes."""
    bytes_ = _rows_of(rows.column("data"), POSITIONS)
    return lambda i, j: _tally(bytes_, i, j)


def _rows_of(column: pa.ChunkedArray, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(x[:width] for x in column.to_pylist()), np.uint8).reshape(-1, width)


def _tally(bytes_: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    out = np.zeros(len(i), bool)
    for at in range(0, len(i), 1 << 16):
        out[at : at + (1 << 16)] = (bytes_[i[at : at + (1 << 16)]] == bytes_[j[at : at + (1 << 16)]]).sum(axis=1) >= MATCHES
    return out


def _sets_close(rows: pa.Table):
    """Pairs that share the minimum of positional bytes and are as similar as asked by their whole sets."""
    bytes_ = _rows_of(rows.column("data"), POSITIONS)
    sets = [np.frombuffer(x, np.uint64, offset=POSITIONS) for x in rows.column("data").to_pylist()]

    def close(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        out = _tally(bytes_, i, j)
        for k in np.flatnonzero(out):
            out[k] = _similar(sets[i[k]], sets[j[k]])
        return out

    return close


def _verified(a: pa.Array, b: pa.Array) -> pa.Array:
    return pa.array([_similar(np.frombuffer(x, np.uint64, offset=POSITIONS), np.frombuffer(y, np.uint64, offset=POSITIONS)) for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)], pa.bool_())


_verified.__annotations__ = {"a": pa.Array, "b": pa.Array, "return": pa.Array}


def _set_bytes(texts: list[bytes]) -> pa.Array:
    return pa.array([shingles(t).tobytes() for t in texts], pa.binary())


def link_sets(sketches: DataFrame, texts: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Links (a, b) that span the components of similar sets, from sketches (fp, bytes), one for each set, and ``texts``: from
    sets (fp) to rows (fp, text), a text of each.

    The first pass tallies and its forest is verified by whole sets. What that leaves apart is compared whole, but
    only sets that share the minimum of bytes with one of another component travel for it.
    """
    keys = F.array(*[F.xxhash64(F.lit(i), F.expr(f"substring(bytes, {i * SET_KEY + 1}, {SET_KEY})")) for i in range(POSITIONS // SET_KEY)])
    members = postings.members_of(sketches.select(F.explode(keys).alias("key"), "fp"))
    bytes_ = sketches.select("fp", F.col("bytes").alias("data"))
    tried = materialise(postings.first_links(members, bytes_, _tally_close), "tried")
    some = members.select("fp").distinct()
    sets = texts(some).select("fp", text_udf(_set_bytes, "binary")(bytes_of(F.col("text"))).alias("own"))
    sets = materialise(sets.join(bytes_, "fp").select("fp", F.concat("data", "own").alias("data")), "sets")
    pairs = tried.join(sets.select(F.col("fp").alias("a"), F.col("data").alias("one")), "a").join(sets.select(F.col("fp").alias("b"), F.col("data").alias("other")), "b")
    links = materialise(pairs.filter(F.arrow_udf(_verified, returnType="boolean")("one", "other")).select("a", "b"), "links")
    left = materialise(postings.with_partner(postings.apart(members, links), bytes_, _tally_close), "apart")
    return links.unionByName(postings.second_links(left, sets, _sets_close))


def drop_near_duplicates(documents: DataFrame) -> DataFrame:
    """One document of each group that is linked by similar texts, all columns kept, whatever their names: the smallest
    doc_id, null ids last, and of rows with the same id the first written. Null, empty and blank texts are equal. Rows get a
    number in a written table, so repeated rows are told apart."""
    names = documents.columns
    own = unused(documents, "near")
    row = F.monotonically_increasing_id().alias("row")
    numbered = materialise(documents.select("*", F.struct(sketch(F.col("text")).alias("s"), row).alias(own)), "numbered")
    rows = numbered.select("doc_id", "text", F.col(f"{own}.s.fp").alias("fp"), F.col(f"{own}.s.n").alias("n"), F.col(f"{own}.s.bytes").alias("bytes"), F.col(f"{own}.row").alias("row"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")).alias("first")
    classes = materialise(rows.groupBy("fp").agg(first, F.first("bytes").alias("bytes"), F.first("n").alias("n")), "classes")

    def texts(sets: DataFrame) -> DataFrame:
        # the few sets that meet another are written first: where they are small, Spark need not move the texts
        first = materialise(classes.join(sets, "fp", "left_semi").select(F.col("first.row").alias("row")).sortWithinPartitions("row"), "met")
        return rows.select("row", "fp", "text").join(first, "row", "left_semi").select("fp", "text")

    roots = components(link_sets(classes.filter("n > 0").select("fp", "bytes"), texts)).withColumnRenamed("node", "fp")
    kept = classes.select("fp", "first").join(roots, "fp", "left").groupBy(F.coalesce("root", "fp").alias("root")).agg(F.min("first").alias("first"))
    kept = kept.select(F.struct(F.col("first.row").alias("row")).alias("kept"))
    return numbered.join(kept, numbered[own]["row"] == kept["kept"]["row"], "left_semi").select(*[F.col(f"`{n}`") for n in names])


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return near_duplicates(table(spark, sf_dir, "documents"))
