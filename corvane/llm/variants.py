"""Spelling variants: words grouped with the frequent words that one edit makes of them.

Words come from whole texts and are counted by task before they are shuffled. Every word emits itself and its distinct
single deletions; two words at distance one share exactly one of these keys: the shorter word where one is the other
without a code point, the text without the replaced code point else. Words meet by equal keys and are verified by their
exact distance. At most the alphabet's size times the key's length and one words can share a key, whatever
the corpus, so lists are bounded. Each word's near words are aggregated to a form, and forms are followed by doubling: in
round r a word knows the word 2^r forms on.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.common import bytes_of, materialise, table

SHORTEST, LEAST, FACTOR = 7, 2, 10
#: One run in so many, by a hash of the document and the run, loses a code point.
SLIP = 31
#: Distinct words that a task holds before it puts out their counts.
HELD = 1 << 19
#: Code points up to which a key is the text itself.
PLAIN = 64
MODULUS, BASE = (1 << 61) - 1, 0x1234_5678_9ABC_DEF1 % ((1 << 61) - 1)


def _counted(slip: int | None, shortest: int):
    """Counts of words by task. With ``slip``, runs lose a code point by the hash of their document and themselves."""
    runs = re.compile("[A-Za-zÀ-ÿ]+")

    def put(counts: Counter[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()
        for batch in batches:
            for name, value in zip(batch.column("name"), batch.column("text"), strict=True):
                text = (value.as_py() or b"").lower().decode("utf-8", "replace")
                if slip is None:
                    counts.update(w for w in runs.findall(text) if len(w) >= shortest)
                else:
                    own, seed = Counter(runs.findall(text)), zlib.crc32(name.as_py() + b":")
                    for word, n in own.items():
                        size = len(word)
                        if size < shortest:
                            continue
                        h = zlib.crc32(word.encode(), seed)
                        if h % slip == 0:
                            at = h % size
                            word = word[:at] + word[at + 1 :]
                            if size - 1 < shortest:
                                continue
                        counts[word] += n
                if len(counts) > HELD:
                    yield put(counts)
                    counts = Counter()
        if counts:
            yield put(counts)

    return run


def words(documents: DataFrame, slip: int | None = None, shortest: int = SHORTEST, least: int = LEAST) -> DataFrame:
    """(word, n): runs of Latin letters of whole texts (doc_id, text), A-Z lower-cased, with at least ``shortest`` code
    points and ``least`` occurrences. Null texts hold none; with ``slip``, a null id counts as the empty text."""
    rows = documents.select(bytes_of(F.col("doc_id").cast("string")).alias("name"), bytes_of(F.col("text")).alias("text"))
    counted = rows.mapInArrow(_counted(slip, shortest), "word string, n bigint")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def _deletion_hashes(word: str) -> list[int]:
    """Polynomial hashes of a word and of its single deletions, in time linear in its length."""
    head, tail, power = [0], [0], [1]
    for a, z in zip(word, reversed(word), strict=True):
        head.append((head[-1] * BASE + ord(a)) % MODULUS)
        tail.append((ord(z) * power[-1] + tail[-1]) % MODULUS)
        power.append(power[-1] * BASE % MODULUS)
    last = len(word) - 1
    return sorted({head[-1], *((head[i] * power[last - i] + tail[last - i]) % MODULUS for i in range(last + 1))})


def _hashed_keys(column: pa.Array) -> pa.Array:
    return pa.array([_deletion_hashes(w) for w in column.to_pylist()], pa.list_(pa.int64()))


_hashed_keys.__annotations__ = {"column": pa.Array, "return": pa.Array}


def _short_pairs(counted: DataFrame) -> DataFrame:
    deletions = F.transform(F.sequence(F.lit(1), F.length("word")), lambda i: F.concat(F.substring("word", F.lit(1), i - 1), F.substring("word", i + 1, F.length("word"))))
    keys = counted.filter(F.length("word") <= PLAIN).select(F.explode(F.concat(F.array("word"), F.array_distinct(deletions))).alias("key"), "word", "n")
    others = keys.select("key", F.col("word").alias("other"), F.col("n").alias("m"))
    # Spark sizes exploded rows as those they come from, and would take the deletions for small enough to broadcast
    return keys.hint("merge").join(others, "key").filter("word != other").select("word", "n", "other", "m")


def _long_pairs(counted: DataFrame) -> DataFrame:
    numbered = materialise(counted.filter(F.length("word") >= PLAIN).withColumn("id", F.monotonically_increasing_id()), "long")
    keys = numbered.select(F.explode(F.arrow_udf(_hashed_keys, returnType="array<bigint>")("word")).alias("key"), "id")
    met = keys.hint("merge").join(keys.withColumnRenamed("id", "to"), "key").filter("id != to").select("id", "to").distinct()
    met = met.join(numbered, "id").join(numbered.select(F.col("id").alias("to"), F.col("word").alias("other"), F.col("n").alias("m")), "to")
    return met.filter(F.greatest(F.length("word"), F.length("other")) > PLAIN).select("word", "n", "other", "m")


def near_pairs(counted: DataFrame) -> DataFrame:
    """Ordered pairs (word, n, other, m) of distinct words (word, n) whose distance is one code point. Words beyond
    ``PLAIN`` code points meet by numbers and hashes, as their deletions would fill the square of their length."""
    met = _short_pairs(counted).unionByName(_long_pairs(counted))
    return met.filter(F.levenshtein("word", "other", 1) == 1)


def followed(forms: DataFrame) -> DataFrame:
    """(word, root) from acyclic (word, form), one row a word: the last word that forms lead to. Each round doubles the way
    and is written; only whether any word went on reaches the driver."""
    at = materialise(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = materialise(at.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("went")), "roots")
        at = step.select("word", "root")
        if step.filter("went").isEmpty():
            return at


def group_variants(counted: DataFrame, factor: int = FACTOR) -> DataFrame:
    """Word, form, root, n, n_near and form_n of distinct words (word, n).

    A word's form is its near word of largest n, ties to the smallest in code-point order, if that n is at least
    ``factor`` (above 1) times its own; its root is where forms lead, itself without a form. No words, no rows.
    """
    counted = materialise(counted.select("word", "n"), "words")
    best = F.min(F.struct((-F.col("m")).alias("m"), "other"))
    near = near_pairs(counted).groupBy("word").agg(F.count("*").alias("n_near"), F.first("n").alias("n"), best.alias("best"))
    formed = -F.col("best.m") >= factor * F.col("n")
    near = materialise(near.select("word", "n_near", F.when(formed, F.col("best.other")).alias("form"), F.when(formed, -F.col("best.m")).alias("form_n")), "near")
    roots = followed(near.filter("form is not null").select("word", "form"))
    found = counted.join(near, "word", "left").join(roots, "word", "left")
    return found.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), "form_n")


def op13_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spelling variants among the words of all documents, one run in 31 misspelt by the contract's hash."""
    return group_variants(words(table(spark, sf_dir, "documents"), SLIP))


#: crc32 has no function in DuckDB: its table is made from the polynomial, and bytes are folded over it.
OP13_SQL = f"""
WITH RECURSIVE bits AS (
  SELECT range AS i, 0 AS r, range::UBIGINT AS v FROM range(256)
  UNION ALL SELECT i, r + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::UBIGINT) ELSE v >> 1 END FROM bits WHERE r < 8
), crc AS MATERIALIZED (SELECT list(v ORDER BY i) AS t FROM bits WHERE r = 8),
runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS w FROM documents),
own AS MATERIALIZED (SELECT doc_id, w, count(*) AS n FROM runs WHERE length(w) >= {SHORTEST} GROUP BY ALL),
coded AS (
  SELECT w, n, flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || w, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::UBIGINT] ELSE [195::UBIGINT, (unicode(c) - 64)::UBIGINT] END)) AS b FROM own
), hashed AS (
  SELECT w, n, xor(list_reduce(list_concat([4294967295::UBIGINT], b), lambda a, x: xor(a >> 8, t[(xor(a, x) & 255)::BIGINT + 1])), 4294967295::UBIGINT) AS h FROM coded, crc
), slipped AS (
  SELECT CASE WHEN h % {SLIP} = 0 THEN substr(w, 1, (h % length(w))::BIGINT) || substr(w, (h % length(w))::BIGINT + 2) ELSE w END AS word, n FROM hashed
), words AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM slipped WHERE length(word) >= {SHORTEST} GROUP BY word HAVING sum(n) >= {LEAST}),
cuts AS MATERIALIZED (SELECT word, n, p, substr(word, 1, p - 1) || substr(word, p + 1) AS k FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS p FROM words)),
pairs AS (
  SELECT a.word, a.n, b.word AS other, b.n AS m FROM cuts a JOIN cuts b ON a.k = b.k AND a.p = b.p AND a.word != b.word
  UNION SELECT a.word, a.n, b.word, b.n FROM cuts a JOIN words b ON a.k = b.word
  UNION SELECT b.word, b.n, a.word, a.n FROM cuts a JOIN words b ON a.k = b.word
), near AS MATERIALIZED (SELECT word, any_value(n) AS n, count(*) AS n_near, arg_min(other, (-m, other)) AS best, max(m) AS best_n FROM pairs GROUP BY word),
forms AS MATERIALIZED (SELECT word, best AS form, best_n AS form_n FROM near WHERE best_n >= {FACTOR} * n),
ways AS (SELECT word, form AS root, 1 AS d FROM forms UNION ALL SELECT ways.word, forms.form, d + 1 FROM ways JOIN forms ON forms.word = ways.root),
roots AS (SELECT word, arg_max(root, d) AS root FROM ways GROUP BY word)
SELECT words.word, form, coalesce(root, words.word) AS root, words.n, coalesce(n_near, 0)::BIGINT AS n_near, form_n
FROM words LEFT JOIN near ON near.word = words.word LEFT JOIN forms ON forms.word = words.word LEFT JOIN roots ON roots.word = words.word
"""
