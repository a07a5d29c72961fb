"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are the word windows of the benchmark. For each pattern length there is a table of shifts
by the last block of two words under the window (how far the search may jump without missing a
pattern), and, where the shift is zero, a bucket of test windows by that suffix block and their
first block; a direct comparison of all words confirms an occurrence. The benchmark is cut into
shards of a bounded number of words; every shard is a pass of its own over the texts, so the driver
and a task hold the tables of one shard however large the benchmark grows.
"""

from __future__ import annotations

import struct
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.common import bytes_of, materialise, table, text_udf, unused

#: Words of a window.
WINDOW = 10
#: Words of the items of a shard, on average over a hash of them.
SHARD_WORDS = 1_000_000

#: ASCII letters lower-cased, digits and all bytes of other characters kept, the rest turned to blanks.
_WORD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

FOUND = "struct<n_words:bigint,hits:binary,items:array<string>>"


def words_of(text: bytes) -> list[bytes]:
    """Words of a text: runs of ASCII letters and digits and of all other characters beyond ASCII, A-Z lower-cased."""
    return text.translate(_WORD).split()


class Tables:
    """Shift tables and suffix-hash buckets of a shard's windows, one pair for each window length."""

    def __init__(self, items: list[tuple[str | None, bytes]], window: int = WINDOW):
        owners: dict[tuple, set] = defaultdict(set)
        for name, text in items:
            words = words_of(text)
            for i in range(max(1, len(words) - window + 1) if words else 0):
                owners[tuple(words[i : i + window])].add(name)
        self.owners = [sorted(x for x in names if x is not None) for names in owners.values()]
        self.by_length: dict[int, tuple[dict, dict]] = {}
        for number, pattern in enumerate(owners):
            m = len(pattern)
            shifts, buckets = self.by_length.setdefault(m, ({}, defaultdict(lambda: defaultdict(list))))
            size = min(2, m)
            for end in range(size, m + 1):
                block = pattern[end - size : end]
                shifts[block] = min(shifts.get(block, m), m - end)
            buckets[pattern[m - size :]][pattern[:size]].append((pattern, number))

    def search(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Intervals of the words that patterns cover, by start within a length, and the numbers of those patterns."""
        spans, numbers = [], set()
        n = len(words)
        for m, (shifts, buckets) in self.by_length.items():
            size = min(2, m)
            jump, shift_of = m - size + 1, shifts.get
            at = m
            while at <= n:
                block = (words[at - 2], words[at - 1]) if size == 2 else (words[at - 1],)
                shift = shift_of(block, jump)
                if shift:
                    at += shift
                    continue
                first = at - m
                for pattern, number in buckets[block].get(tuple(words[first : first + size]), ()):
                    if list(pattern) == words[first:at]:
                        spans.append((first, at))
                        numbers.add(number)
                at += 1
        return spans, numbers


def merged(spans: list[tuple[int, int]]) -> list[list[int]]:
    """Disjoint intervals that cover the same positions, in order."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return out


def _scan(shard: list[tuple[str | None, bytes]], window: int):
    made: list[Tables] = []

    def call(texts: list[bytes]) -> pa.Array:
        if not made:
            made.append(Tables(shard, window))
        n_words, hits, items = [], [], []
        for text in texts:
            words = words_of(text)
            spans, numbers = made[0].search(words)
            n_words.append(len(words))
            hits.append(struct.pack(f"<{2 * len(s)}i", *(x for ab in s for x in ab)) if (s := merged(spans)) else b"")
            items.append(sorted({x for k in numbers for x in made[0].owners[k]}))
        return pa.StructArray.from_arrays([pa.array(n_words, pa.int64()), pa.array(hits, pa.binary()), pa.array(items, pa.list_(pa.string()))], ["n_words", "hits", "items"])

    return text_udf(call, FOUND)


def _join_hits(column: pa.Array) -> pa.Array:
    """Positions covered by any of several lists of intervals."""
    out = []
    for packed in column.to_pylist():
        data = b"".join(packed)
        flat = struct.unpack(f"<{len(data) // 4}i", data)
        out.append(sum(b - a for a, b in merged(list(zip(flat[::2], flat[1::2], strict=True)))))
    return pa.array(out, pa.int64())


_join_hits.__annotations__ = {"column": pa.Array, "return": pa.Array}


def benchmark_shards(benchmark: DataFrame, shard_words: int = SHARD_WORDS) -> tuple[DataFrame, int]:
    """The benchmark's items (item, text, shard) as a written table, and the number of shards, dealt out by a hash so that
    one holds ``shard_words`` on average. Items without words have no windows; a null id marks hits but is no item;
    repeated rows count once."""
    rows = benchmark.select(F.col("item_id").cast("string").alias("item"), bytes_of(F.col("text")).alias("text")).distinct()
    rows = materialise(rows.withColumn("n", text_udf(_lengths, "bigint")(F.col("text"))).filter("n > 0"), "benchmark")
    shards = max(1, -(-(rows.agg(F.sum("n")).first()[0] or 0) // shard_words))
    return rows.select("item", "text", F.pmod(F.xxhash64("item", "text"), F.lit(shards)).cast("int").alias("shard")), shards


def _lengths(texts: list[bytes]) -> pa.Array:
    return pa.array([len(words_of(t)) for t in texts], pa.int64())


def _shard(items: DataFrame, number: int, window: int):
    """The search for one shard: only its items are on the driver and in the tasks of a pass."""
    return _scan([(r["item"], bytes(r["text"])) for r in items.filter(F.col("shard") == number).select("item", "text").collect()], window)


def find_leaks(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, shard_words: int = SHARD_WORDS, into: str = "leak") -> DataFrame:
    """``documents`` with a struct ``into`` (n_words, n_hit, items): words, words inside any occurrence of a
    benchmark window, and the ids of the items with occurring windows, sorted as strings.

    The first shard is searched where the documents are read. If there are more, the documents get row numbers in a
    written table, each further shard passes over them alone and writes the rows that it hits, and the hits are merged by
    row. Null and empty texts have no words. All other columns and repeated rows stay as they are; a column named
    ``into`` is replaced.
    """
    items, shards = benchmark_shards(benchmark, shard_words)
    names = [c for c in documents.columns if c.lower() != into.lower()]
    keep = [F.col(f"`{c}`") for c in names]
    own = unused(documents, "found")
    text = bytes_of(F.col("text"))
    found = documents.select(*keep, F.struct(_shard(items, 0, window)(text).alias("f"), F.monotonically_increasing_id().alias("row")).alias(own))
    more = F.lit(None).cast("struct<row:bigint,hits:array<binary>,items:array<string>>")
    if shards > 1:
        found, parts = materialise(found, "found"), []
        for k in range(1, shards):
            part = found.select(F.col(f"{own}.row").alias("row"), _shard(items, k, window)(bytes_of(F.col("text"))).alias("f"))
            parts.append(materialise(part.filter(F.octet_length("f.hits") > 0).select("row", "f.hits", "f.items"), f"shard{k}"))
        merged_ = parts[0]
        for part in parts[1:]:
            merged_ = merged_.unionByName(part)
        merged_ = merged_.groupBy("row").agg(F.collect_list("hits").alias("hits"), F.flatten(F.collect_list("items")).alias("items"))
        other = unused(documents, "others")
        merged_ = merged_.select(F.struct("row", "hits", "items").alias(other))
        found = found.join(merged_, F.col(f"{own}.row") == F.col(f"{other}.row"), "left")
        more = F.col(other)
    first = F.col(f"{own}.f")
    hits = F.concat(F.array(first["hits"]), F.coalesce(more["hits"], F.array().cast("array<binary>")))
    all_items = F.sort_array(F.array_distinct(F.concat(first["items"], F.coalesce(more["items"], F.array().cast("array<string>")))))
    some = F.exists(hits, lambda h: F.octet_length(h) > 0)
    n_hit = F.when(some, F.arrow_udf(_join_hits, returnType="bigint")(hits)).otherwise(F.lit(0)).cast("long")
    return found.select(*keep, F.struct(first["n_words"].alias("n_words"), n_hit.alias("n_hit"), all_items.alias("items")).alias(into))


def drop_leaks(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no benchmark window, with all their columns, whatever their names."""
    own = unused(documents, "leak")
    return find_leaks(documents, benchmark, into=own).filter(F.col(own)["n_hit"] == 0).drop(own)


def items_digest(items: Column) -> Column:
    """sha256 of the comma-joined ids."""
    return F.sha2(F.array_join(items, ",").cast("binary"), 256)


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words, hit words and items of every document against the whole benchmark."""
    leaks = find_leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return leaks.select(
        "doc_id",
        F.col("leak.n_words").alias("n_words"),
        F.col("leak.n_hit").alias("n_hit"),
        F.size("leak.items").cast("long").alias("n_items"),
        items_digest(F.col("leak.items")).alias("items_sha256"),
        (F.col("leak.n_hit") > 0).alias("contaminated"),
    )


LEAK_CTE = r"""
iw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT item_id, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS g, least(len(w), 10) AS m
        FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 8, 2))) AS i FROM iw WHERE len(w) > 0)),
dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM {documents}),
lens AS (SELECT DISTINCT m FROM win),
dg AS (SELECT doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') AS g FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM dw, lens WHERE len(w) >= m)),
occ AS (SELECT DISTINCT doc_id, dg.m, i, item_id FROM dg JOIN win ON dg.g = win.g AND dg.m = win.m),
hit AS (SELECT doc_id, count(DISTINCT p)::BIGINT AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM occ) GROUP BY doc_id),
its AS (SELECT doc_id, count(*)::BIGINT AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM occ WHERE item_id IS NOT NULL) GROUP BY doc_id)
"""

OP3_SQL = "WITH " + LEAK_CTE.format(documents="documents") + r"""
SELECT dw.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
"""
