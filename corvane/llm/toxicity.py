"""Toxicity by nearest labelled examples under exact TF-IDF cosine, found in a block-max inverted index.

Every word of a whole text is a term. Document frequencies are counted over all documents. Examples lie
in the index in the order of their strongest terms, in blocks, with each term's largest weight per block:
a text's blocks are scored from the highest upper bound down until no bound reaches the k-th best cosine,
so the neighbours are exact. Votes weighted by squared cosine, shrunk towards the rate among examples, give
the score, and the neighbours themselves the evidence.

A term's weight is its TF-IDF times ``1 + association * sqrt(excess)``, where the excess is how far its
log-likelihood ratio with the label among the examples goes beyond chance; ``association=0`` is plain TF-IDF.
All terms keep at least their plain weight and none is left out (the README has figures for both).

Words that no example has cannot add to a cosine but belong in a text's norm. Their document frequencies come
from a table of ``OTHERS`` hash buckets counted over all documents, an upper bound of a single word's; it scales all
cosines of a text alike, so neighbours and their order do not depend on it.

Bounds, all parameters: ``examples`` labelled rows (those with the smallest hash of their id) of ``EXAMPLE_WORDS``
distinct words in total; the index and the tables that tasks hold are never larger than these.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.common import blocks, bytes_of, crc_mod, materialise, packed, table, text_udf, unpacked, unused, vector_sum
from corvane.llm.decontaminate import words_of
from corvane.llm.quality import trusted

EXAMPLES, EXAMPLE_WORDS, NEIGHBOURS, BLOCK = 4096, 4_000_000, 24, 64
#: Terms at most that the index holds as dense rows, of those that a 32nd of the examples have.
FREQUENT = 512
#: Blocks of the highest bounds that are scored before the others are held against what they gave.
FIRST = 12
#: Texts whose dense rows are multiplied at once.
TOGETHER = 64
#: Hash buckets of the words that no example has.
OTHERS = 1 << 20
#: How strongly a term's association with the label raises its weight.
ASSOCIATION = 4.0
#: The log-likelihood ratio that chance exceeds once in a thousand terms.
CHANCE = 10.83
#: Votes of the base rate that are mixed into every score.
SHRINK = 0.5

EVIDENCE = "struct<score:double,neighbours:array<bigint>,cosines:array<double>>"


def bucket_of(word: bytes) -> int:
    return zlib.crc32(word) % OTHERS


class Vocabulary:
    """Numbers of the examples' words; tasks make their look-up table from one string when they first need it."""

    def __init__(self, words: list[bytes]):
        self.size, self._joined, self._numbers = len(words), b" ".join(words), None

    def __getstate__(self) -> dict:
        return {**self.__dict__, "_numbers": None}

    @property
    def numbers(self) -> dict[bytes, int]:
        if self._numbers is None:
            self._numbers = {w: i for i, w in enumerate(self._joined.split())}
        return self._numbers

    def split(self, words: Counter) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Numbers and counts of the words that examples have, buckets and counts of the others."""
        number = self.numbers.get
        got = [number(w, -1) for w in words]
        of, n = np.array(got, np.int64), np.fromiter(words.values(), np.float64, len(words))
        other = np.array([bucket_of(w) for w, k in zip(words, got, strict=True) if k < 0], np.int64)
        return of[of >= 0], n[of >= 0], other, n[of < 0]


class Index:
    """Block-max inverted index over the examples' unit vectors.

    The ``FREQUENT`` terms that most examples have are dense rows, since their postings would name almost every example:
    what they add to a text's cosines is known for each example, and its largest value in a block is part of the
    block's bound. All other terms have postings and their largest weight in each block that has them.
    """

    def __init__(self, ids: np.ndarray, labels: np.ndarray, idf: np.ndarray, idf_other: np.ndarray):
        self.ids, self.labels, self.idf, self.idf_other = ids, labels, idf, idf_other
        self.base = float((labels.sum() + 0.5) / (len(labels) + 5))

    def build(self, vectors: list[tuple[np.ndarray, np.ndarray]], block: int = BLOCK, frequent: int = FREQUENT) -> Index:
        """Lay the examples out in the order of their strongest terms and index them."""
        none = np.zeros(0, np.int64), np.zeros(0)
        weighed = [self.weigh(t, n, *none) for t, n in vectors]
        strongest = [tuple(t[np.argsort(-w, kind="stable")][:3].tolist()) for (t, _), w in zip(vectors, weighed, strict=True)]
        order = sorted(range(len(vectors)), key=lambda i: (strongest[i], self.ids[i]))
        self.ids, self.labels = self.ids[order], self.labels[order]
        n, self.block, self.blocks = len(order), block, max(1, -(-len(order) // block))
        terms = np.concatenate([vectors[i][0] for i in order] or [none[0]])
        weights = np.concatenate([weighed[i] for i in order] or [none[1]])
        places = np.repeat(np.arange(n, dtype=np.int32), [len(weighed[i]) for i in order])
        del vectors, weighed
        df = np.bincount(terms, minlength=len(self.idf))
        most = np.argsort(-df, kind="stable")[:frequent]
        most = most[df[most] * 32 >= n]
        self.row = np.full(len(self.idf), -1, np.int32)
        self.row[most] = np.arange(len(most))
        self.dense = np.zeros((len(most), self.blocks * block))
        dense = self.row[terms] >= 0
        self.dense[self.row[terms[dense]], places[dense]] = weights[dense]
        terms, places, weights = terms[~dense], places[~dense], weights[~dense]
        by_term = np.lexsort((places, terms))
        terms, self.weights = terms[by_term], weights[by_term]
        self.places = places[by_term].astype(np.int16 if n <= np.iinfo(np.int16).max else np.int32)
        self.count = np.bincount(terms, minlength=len(self.idf)).astype(np.int32)
        return self._listed()

    def _listed(self) -> Index:
        """Lay out the postings' blocks, a slot for each block of a term: where it begins and its largest weight."""
        terms = np.repeat(np.arange(len(self.count), dtype=np.int32), self.count)
        block = self.places // self.block
        new = np.ones(len(terms), bool)
        new[1:] = (terms[1:] != terms[:-1]) | (block[1:] != block[:-1])
        first = np.flatnonzero(new)
        self.of_block = block[first]
        self.most = np.maximum.reduceat(self.weights, first) if len(first) else np.zeros(0)
        self.entries = np.searchsorted(terms[first], np.arange(len(self.count) + 1)).astype(np.int32)
        self.first = np.append(first, len(terms)).astype(np.int32)
        return self

    def __getstate__(self) -> dict:
        state = {k: v for k, v in self.__dict__.items() if k not in ("of_block", "most", "entries", "first")}
        return state | {k: (packed(state[k]), state[k].shape) for k in ("idf_other", "dense") if k in state}

    def __setstate__(self, state: dict) -> None:
        """Tasks lay out the slots themselves: what travels to them, and stays in them beside the index, is the postings
        alone, with the dense rows and the other words' weights compressed."""
        self.__dict__.update(state)
        for k in {"idf_other", "dense"} & state.keys():
            x, shape = state[k]
            setattr(self, k, unpacked(x, int(np.prod(shape)), "float64").reshape(shape))
        if "count" in state:
            self._listed()

    def weigh(self, terms: np.ndarray, counts: np.ndarray, others: np.ndarray, other_counts: np.ndarray) -> np.ndarray:
        """The unit vector of a text over the examples' words; all its words are in the norm."""
        w, o = (1 + np.log(counts)) * self.idf[terms], (1 + np.log(other_counts)) * self.idf_other[others]
        return w / np.sqrt((w * w).sum() + (o * o).sum()) if len(w) else w

    def nearest(self, texts: list[tuple[np.ndarray, np.ndarray]], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each text (terms, unit vector), places and cosines of the k nearest examples with a cosine over zero, ties
        to the smaller id."""
        frequent = np.zeros((len(texts), len(self.dense)))
        for i, (terms, q) in enumerate(texts):
            own = self.row[terms]
            frequent[i, own[own >= 0]] = q[own >= 0]
        return [self._nearest(terms[self.row[terms] < 0], q[self.row[terms] < 0], known, k) for (terms, q), known in zip(texts, frequent @ self.dense, strict=True)]

    def _nearest(self, terms: np.ndarray, q: np.ndarray, known: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        length = self.entries[terms + 1] - self.entries[terms]
        rows = np.repeat(self.entries[terms] - np.cumsum(length) + length, length) + np.arange(length.sum())
        share, block = np.repeat(q, length), self.of_block[rows]
        known = known.reshape(self.blocks, self.block)
        bound = np.bincount(block, share * self.most[rows], self.blocks) + known.max(axis=1)
        by_bound = np.argsort(-bound, kind="stable")
        places, scores = np.zeros(0, np.int64), np.zeros(0)
        at, take = 0, FIRST  # then all blocks whose bound reaches the k-th best of the first ones
        while at < self.blocks:
            least = scores[k - 1] if len(scores) >= k else 0.0
            todo = by_bound[at : at + take]
            todo = todo[bound[todo] >= max(least - 1e-12, 1e-12)]
            if not len(todo):
                break
            rank = np.full(self.blocks, -1)
            rank[todo] = np.arange(len(todo))
            own = rank[block] >= 0
            first, size = self.first[rows[own]], self.first[rows[own] + 1] - self.first[rows[own]]
            posting = np.repeat(first - np.cumsum(size) + size, size) + np.arange(size.sum())
            where = self.places[posting]
            got = np.bincount(rank[where // self.block] * self.block + where % self.block, np.repeat(share[own], size) * self.weights[posting], len(todo) * self.block)
            got = got + known[todo].ravel()
            least = max(least - 1e-11, np.partition(got, -k)[-k] - 1e-11 if len(got) > k else 0.0)
            found = np.flatnonzero((got > 0) & (got >= least))
            places, scores = np.r_[places, todo[found // self.block] * self.block + found % self.block], np.r_[scores, got[found]]
            order = np.lexsort((self.ids[places], -np.round(scores, 12)))[:k]
            places, scores = places[order], scores[order]
            at, take = at + take, self.blocks
        return places, scores


def vote(index: Index, places: np.ndarray, cosines: np.ndarray, shrink: float = SHRINK) -> float:
    """The share of toxic ones among neighbours, weighted by squared cosine (the nearest counts one)."""
    if not len(places):
        return index.base
    votes = (cosines / cosines[0]) ** 2
    return (float(votes @ index.labels[places]) + shrink * index.base) / (float(votes.sum()) + shrink)


def judge(text: Column, vocabulary: Vocabulary, index: Index, neighbours: int = NEIGHBOURS) -> Column:
    """Score, ids of the nearest examples and their cosines, from a column of whole texts.

    A text that shares no word with an example (null and empty ones too) has no neighbours; its score is the smoothed
    rate among the examples.
    """

    def call(texts: list[bytes]) -> pa.Array:
        seen: dict[bytes, tuple] = {}
        once = list(dict.fromkeys(texts))
        for at in range(0, len(once), TOGETHER):
            some = once[at : at + TOGETHER]
            split = [vocabulary.split(Counter(words_of(t))) for t in some]
            for text, (places, cosines) in zip(some, index.nearest([(s[0], index.weigh(*s)) for s in split], neighbours), strict=True):
                seen[text] = vote(index, places, cosines), index.ids[places], cosines
        got = [seen[t] for t in texts]
        ends = pa.array(np.cumsum([0, *(len(g[1]) for g in got)]), pa.int32())
        lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate([g[k] for g in got] or [np.zeros(0)]).astype(kind))) for k, kind in ((1, np.int64), (2, np.float64))]
        return pa.StructArray.from_arrays([pa.array([g[0] for g in got], pa.float64()), *lists], ["score", "neighbours", "cosines"])

    return text_udf(call, EVIDENCE)(bytes_of(text))


def association(n: int, toxic: int, df: np.ndarray, of_toxic: np.ndarray) -> np.ndarray:
    """Log-likelihood ratio of terms that the label makes likelier, zero for the rest, from examples that have them."""
    share = toxic / max(1, n)
    cell = lambda o, e: np.where(o > 0, o * np.log(np.maximum(o, 1e-300) / np.maximum(e, 1e-300)), 0.0)
    ratio = 2 * (cell(of_toxic, df * share) + cell(df - of_toxic, df * (1 - share)) + cell(toxic - of_toxic, (n - df) * share) + cell(n - toxic - df + of_toxic, (n - df) * (1 - share)))
    return np.where(of_toxic > df * share, ratio, 0.0)


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in blocks(batches, "text"):
        counts = [Counter(words_of(t)) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                batch.column("label"),
                pa.array([b" ".join(c) for c in counts], pa.binary()),
                pa.array([np.fromiter(c.values(), "<i4", len(c)).tobytes() for c in counts], pa.binary()),
                pa.array([len(c) for c in counts], pa.int64()),
            ],
            ["doc_id", "label", "words", "counts", "n"],
        )


def sample_examples(documents: DataFrame, labels: DataFrame, most: int = EXAMPLES, most_words: int = EXAMPLE_WORDS) -> list:
    """Rows (doc_id, label, words, counts) of at most ``most`` labelled documents that may be learnt from, those with the
    smallest hash of their id, while their distinct words add up to ``most_words`` at most. Of repeated ids one row stays."""
    spark = documents.sparkSession
    chosen = spark.createDataFrame(trusted(labels, "toxic").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).collect(), "doc_id bigint, label int")
    texts = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), bytes_of(F.col("text")).alias("text")).join(F.broadcast(chosen), "doc_id")
    counted = materialise(texts.select("doc_id", "label", "text").mapInArrow(_word_counts, "doc_id bigint, label int, words binary, counts binary, n bigint"), "examples")
    sizes, held, total = counted.groupBy("doc_id").agg(F.min("n").alias("n")).orderBy(F.xxhash64("doc_id"), "doc_id").collect(), set(), 0
    for r in sizes:
        total += r["n"]
        if total > most_words:
            break
        held.add(r["doc_id"])
    if not held:
        return []
    # of rows with one id: the fewest distinct words, then the smallest words
    rows = counted.join(F.broadcast(spark.createDataFrame([(d,) for d in sorted(held)], "doc_id bigint")), "doc_id")
    rows = rows.groupBy("doc_id").agg(F.min(F.struct("n", "words", "counts", "label")).alias("r"))
    return rows.select("doc_id", "r.label", "r.words", "r.counts").orderBy("doc_id").collect()


def train(documents: DataFrame, labels: DataFrame, examples: int = EXAMPLES, strength: float = ASSOCIATION) -> tuple[Vocabulary, Index]:
    """The examples' vocabulary and their index, with document frequencies over all documents."""
    rows = sample_examples(documents, labels, examples)
    words: dict[bytes, int] = {}
    vectors = [(np.array([words.setdefault(w, len(words)) for w in bytes(r["words"]).split()], np.int32), np.frombuffer(bytes(r["counts"]), "<i4")) for r in rows]
    vocabulary = Vocabulary(list(words))
    size = vocabulary.size

    def partial(batch: pa.RecordBatch) -> np.ndarray:
        total, known = np.zeros(size + OTHERS + 1, np.int32), vocabulary.numbers
        total[-1] = batch.num_rows
        for piece in blocks(iter([batch]), "text"):
            for value in piece.column("text"):
                own = set(words_of(value.as_py()))
                np.add.at(total, np.fromiter((known[w] if w in known else size + bucket_of(w) for w in own), np.int64, len(own)), 1)
        return total

    seen = vector_sum(documents.select(bytes_of(F.col("text")).alias("text")), partial, size + OTHERS + 1)
    idf = np.log((seen[-1] + 1) / (seen[:-1] + 1)) + 1
    label = np.array([float(r["label"] == 1) for r in rows])
    flat = np.concatenate([t for t, _ in vectors] or [np.zeros(0, np.int64)])
    toxic = np.repeat(label, [len(t) for t, _ in vectors])
    ratio = association(len(rows), int(label.sum()), np.bincount(flat, minlength=size), np.bincount(flat, toxic, size))
    del flat, toxic
    raised = 1 + strength * np.sqrt(np.maximum(0, ratio - CHANCE))
    index = Index(np.array([r["doc_id"] for r in rows], np.int64), label, idf[:size] * raised, idf[size:])
    return vocabulary, index.build(vectors)


def drop_toxic(documents: DataFrame, labels: DataFrame, most: float = 0.3) -> DataFrame:
    """The documents whose score is below ``most``, all columns kept, whatever their names."""
    own = unused(documents, "judged")
    scored = documents.withColumn(own, judge(F.col("text"), *train(documents, labels)))
    return scored.filter(F.col(own)["score"] < most).drop(own)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document, with the nearest examples as evidence."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    judged = documents.select("doc_id", (crc_mod(F.col("doc_id"), 4) == 2).alias("held_out"), judge(F.col("text"), *train(documents, table(spark, sf_dir, "labels"))).alias("j"))
    # written once: the text is judged in one pass, whatever is derived from its evidence
    judged = materialise(judged, "judged")
    return judged.select("doc_id", "held_out", F.col("j.score").alias("score"), (F.col("j.score") >= 0.3).cast("int").alias("predicted"), F.col("j.neighbours").alias("neighbours"), F.col("j.cosines").alias("cosines"))
