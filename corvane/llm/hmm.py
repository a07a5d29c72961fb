"""Language-model scoring with a hidden Markov model.

Latent states emit word classes (a hash of the word into a fixed number of classes), and a class emits its words
by their counts in the whole training corpus, so the model's tables are bounded while the word counts grow with
the input and stay distributed. Baum-Welch: each task turns its blocks into expected counts over whole texts, Spark
adds them by class, and the driver normalises a table of states by classes. The first model comes from all training
text too: classes are clustered by the texts that hold their words. A text's likelihood is exact: the scaled forward
recursion over all its tokens.

Tokenised text is written once, in blocks of bounded size that number their own words in the order of their hashes
(64 bits of XXH3 stand for a word). Each block deals its words out by ranges of hashes, whose number grows with the
corpus; a range's task adds up the counts of all blocks and hands every block its words' totals. A word has one
entry in each block that holds it, whatever it occurs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.common import blocks, bytes_of, crc_mod, materialise, table, vector_sum

STATES, CLASSES = 8, 1 << 14
#: Passes of Baum-Welch over all training text at most, and the relative gain in likelihood that ends them.
PASSES, GAIN = 4, 5e-4
#: Tokens of the pieces in which forward-backward runs side by side; the recursions go on from piece to piece.
SEGMENT = 128
#: Bytes of text in a block, and words of blocks, on average, that one range of hashes holds.
BLOCK, RANGE = 24 << 20, 1 << 20
#: Tokens between two scalings of the recursions along a text.
STRIDE = 16
#: Random signs that stand for a class.
SIGNS = 16
END = b"\n"

_BLOCKS = "block bigint, doc_ids array<bigint>, held array<boolean>, lengths array<int>, tokens binary, kinds binary, hashes binary, counts binary, words bigint"


def _packed(numbers: np.ndarray) -> bytes:
    """Whole numbers below 2 ** 32 byte plane by byte plane, compressed; the high planes are almost all zero."""
    return pa.compress(np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), codec="zstd", asbytes=True)


def _unpacked(packed: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(packed, decompressed_size=4 * n, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, n).T).view("<u4").ravel().astype(np.int64)


def _tokenise(classes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context, number = TaskContext.get(), 0
        for batch in blocks(batches, "text", BLOCK):
            names: dict[bytes, int] = {END: 0}
            lengths, parts = [], []
            for text in batch.column("text").to_pylist():
                words = text.lower().split()
                words.append(END)
                lengths.append(len(words))
                parts.append(np.fromiter((names.setdefault(w, len(names)) for w in words), np.int32, len(words)))
            hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, names), np.uint64, len(names))
            order = np.argsort(hashes, kind="stable")
            rank = np.empty(len(names), np.int32)
            rank[order] = np.arange(len(names))
            tokens, hashes = rank[np.concatenate(parts)], hashes[order]
            held = batch.column("held").to_numpy(zero_copy_only=False)
            counts = np.bincount(tokens[~np.repeat(held, lengths)], minlength=len(names))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([(context.partitionId() if context else 0) << 32 | number], pa.int64()),
                    pa.array([batch.column("doc_id").to_pylist()], pa.list_(pa.int64())),
                    pa.array([held.tolist()], pa.list_(pa.bool_())),
                    pa.array([lengths], pa.list_(pa.int32())),
                    pa.array([_packed(tokens)], pa.binary()),
                    pa.array([_packed(hashes % np.uint64(classes))], pa.binary()),
                    pa.array([hashes.tobytes()], pa.binary()),
                    pa.array([_packed(counts)], pa.binary()),
                    pa.array([len(names)], pa.int64()),
                ],
                ["block", "doc_ids", "held", "lengths", "tokens", "kinds", "hashes", "counts", "words"],
            )
            number += 1

    return run


def tokenised(documents: DataFrame, held, classes: int = CLASSES) -> DataFrame:
    """The blocks of rows (doc_id, text); ``held`` (a condition) marks texts that are not learnt from.

    A-Z lower-cased, words split at ASCII whitespace, then one end token; null and empty texts have the end only.
    """
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held, F.lit(False)).alias("held"), bytes_of(F.col("text")).alias("text"))
    return materialise(rows.mapInArrow(_tokenise(classes), _BLOCKS), "tokens")


@dataclass
class Corpus:
    """What the training tokens say of words: the table (of, range, totals) has the counts in all training text of each
    block's words, range by range; the number of tokens and of distinct words; both by class, with room for one unseen word."""

    looked_up: DataFrame
    tokens: int
    words: int
    class_size: np.ndarray
    classes: int

    def share(self) -> np.ndarray:
        """Each class's smoothed share of the tokens."""
        return self.class_size / self.class_size.sum()


def count_words(texts: DataFrame, classes: int = CLASSES) -> Corpus:
    """Count the training words of all blocks. One shuffle brings the entries of a range of hashes together."""
    ranges = max(1, -(-(texts.agg(F.sum("words")).first()[0] or 0) // RANGE))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                hashes, counts = np.frombuffer(row["hashes"], np.uint64), _unpacked(row["counts"], row["words"])
                of = (hashes >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)
                own, first = np.unique(of, return_index=True)
                ends = [*first[1:], len(of)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(own.astype(np.int64)),
                        pa.array([row["block"]] * len(own), pa.int64()),
                        pa.array([hashes[a:b].tobytes() for a, b in zip(first, ends, strict=True)], pa.binary()),
                        pa.array([_packed(counts[a:b]) for a, b in zip(first, ends, strict=True)], pa.binary()),
                    ],
                    ["range", "of", "hashes", "counts"],
                )

    def add(group: pa.Table) -> pa.Table:
        hashes = [np.frombuffer(x, np.uint64) for x in group.column("hashes").to_pylist()]
        counts = [_unpacked(x, len(h)) for x, h in zip(group.column("counts").to_pylist(), hashes, strict=True)]
        own, at = np.unique(np.concatenate(hashes), return_inverse=True)
        total = np.bincount(at, np.concatenate(counts), len(own)).astype(np.int64)
        known = total > 0
        kind = (own[known] % np.uint64(classes)).astype(np.int64)
        by_class = np.r_[np.bincount(kind, total[known], classes), np.bincount(kind, minlength=classes)].astype("<i8")
        ends = np.cumsum([len(h) for h in hashes])
        rows = [_totals(x) for x in np.split(total[at], ends[:-1])]
        number = group.column("range")[0].as_py()
        # one more row for each range: tokens and distinct words by class
        return pa.table({"of": pa.array([*group.column("of").to_pylist(), -1], pa.int64()), "range": pa.array([number] * (len(rows) + 1), pa.int64()), "totals": pa.array([*rows, by_class.tobytes()], pa.binary())})

    dealt = texts.select("block", "hashes", "counts", "words").mapInArrow(deal, "range bigint, of bigint, hashes binary, counts binary")
    looked_up = materialise(dealt.groupBy("range").applyInArrow(add, "of bigint, range bigint, totals binary"), "words")
    by_class = vector_sum(looked_up.filter("of = -1").select("totals"), lambda batch: sum(np.frombuffer(x, "<i8") for x in batch.column("totals").to_pylist()), 2 * classes)
    n, v = by_class[:classes], by_class[classes:]
    return Corpus(looked_up.filter("of >= 0"), int(n.sum()), int(v.sum()), 1.0 + n + v, classes)


def _totals(counts: np.ndarray) -> bytes:
    return pa.compress(np.ascontiguousarray(counts.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes(), codec="zstd", asbytes=True) + len(counts).to_bytes(8, "little")


def _counts(totals: bytes) -> np.ndarray:
    n = int.from_bytes(totals[-8:], "little")
    planes = np.frombuffer(pa.decompress(totals[:-8], decompressed_size=8 * n, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(8, n).T).view("<i8").ravel()


@dataclass
class Model:
    """First-state, transition and emission (class by state) probabilities."""

    first: np.ndarray
    move: np.ndarray
    emit: np.ndarray

    def padded(self) -> np.ndarray:
        """Emissions with a last row of ones, for positions behind a sequence's end: they change no likelihood."""
        return np.r_[self.emit, np.ones((1, self.emit.shape[1]))]

    def _along(self, tokens: np.ndarray, lengths: np.ndarray):
        """Texts by falling length: order, sizes, and a function that gives the emissions of ``STRIDE`` tokens from a position."""
        order = np.argsort(-lengths, kind="stable")
        size, begin = lengths[order], (np.cumsum(lengths) - lengths)[order]
        tokens, emit = np.r_[tokens, len(self.emit)], self.padded()

        def chunk(at: int) -> np.ndarray:
            n = int(np.searchsorted(-size, -at, side="left"))  # texts longer than at
            steps = at + np.arange(STRIDE)[:, None]
            return emit[tokens[np.where(steps < size[:n], begin[:n] + steps, len(tokens) - 1)]]

        return order, size, chunk

    def forward(self, tokens: np.ndarray, lengths: np.ndarray, segment: int = 0) -> tuple[np.ndarray, dict[int, np.ndarray]]:
        """Exact log10 probability of each text of classes, given one after the other in ``tokens``; and, at each
        multiple of ``segment``, the state distributions of the texts that go on there, longest first."""
        order, size, chunk = self._along(tokens, lengths)
        state, total, kept = np.tile(self.first, (len(size), 1)), np.zeros(len(size)), {}
        for at in range(0, int(size.max(initial=0)), STRIDE):
            emitted = chunk(at)
            n = emitted.shape[1]
            now = state[:n]
            if segment and at and at % segment == 0:
                kept[at] = now.copy()
            for k in range(STRIDE):
                now = (now @ self.move if at + k else now) * emitted[k]
            sums = now.sum(axis=1)
            total[:n] += np.log10(sums)
            state[:n] = now / sums[:, None]
        out = np.empty(len(size))
        out[order] = total
        return out, kept

    def backward(self, tokens: np.ndarray, lengths: np.ndarray, segment: int) -> dict[int, np.ndarray]:
        """At each multiple of ``segment``, how likely each state before it makes the rest of a text, to a factor."""
        _, size, chunk = self._along(tokens, lengths)
        state, kept, back = np.ones((len(size), len(self.first))), {}, self.move.T
        for at in range(STRIDE * ((int(size.max(initial=0)) - 1) // STRIDE), 0, -STRIDE):
            emitted = chunk(at)
            n = emitted.shape[1]
            now = state[:n]
            for k in range(STRIDE - 1, -1, -1):
                now = (now * emitted[k]) @ back
            state[:n] = now / now.sum(axis=1)[:, None]
            if at % segment == 0:
                kept[at] = state[:n].copy()
        return kept

    def expected(self, tokens: np.ndarray, lengths: np.ndarray, segment: int = SEGMENT) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """Forward-backward over whole texts: expected emissions, moves, first states, and the log10 likelihood.

        Texts longer than ``segment`` (a multiple of ``STRIDE``) are cut into pieces that start from the forward state and
        end in the backward state of the whole text there, so the counts are those of the uncut recursions.
        """
        states, pad = len(self.first), len(self.emit)
        emitted, moves, first, value = np.zeros((pad, states)), np.zeros((states, states)), np.zeros(states), 0.0
        if not len(lengths):
            return emitted, moves, first, value
        order = np.argsort(-lengths, kind="stable")
        size, begin = lengths[order], (np.cumsum(lengths) - lengths)[order]
        long = int(np.searchsorted(-size, -segment, side="left"))
        where = np.repeat(begin[:long] - np.cumsum(size[:long]) + size[:long], size[:long]) + np.arange(size[:long].sum())
        ahead, behind = self.forward(tokens[where], size[:long], segment)[1], self.backward(tokens[where], size[:long], segment)
        tokens = np.r_[tokens, pad]
        for at in range(0, int(size[0]), segment):
            n = int(np.searchsorted(-size, -at, side="left"))
            after = np.ones((n, states))
            if at + segment in behind:
                after[: len(behind[at + segment])] = behind[at + segment]
            for a in range(0, n, 2048):
                b = min(n, a + 2048)
                steps = at + np.arange(min(segment, int(size[a]) - at))[:, None]
                rows = tokens[np.where(steps < size[a:b], begin[a:b] + steps, len(tokens) - 1)]
                part = self._piece(rows, ahead[at][a:b] if at else None, after[a:b])
                emitted += part[0]
                moves += part[1]
                first += part[2]
                value += part[3]
        return emitted, moves, first, value

    def _piece(self, rows: np.ndarray, before: np.ndarray | None, after: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """Expected counts of pieces (position by piece): ``before`` has the state ahead of each (none: texts begin),
        ``after`` how likely the states at its end make the rest."""
        length, n = rows.shape
        states, emit, pad = len(self.first), self.padded(), len(self.emit)
        alpha, scale = np.empty((length, n, states)), np.empty((length, n))
        for t in range(length):
            a = ((self.first if before is None else before @ self.move) if t == 0 else alpha[t - 1] @ self.move) * emit[rows[t]]
            scale[t] = a.sum(axis=1)
            alpha[t] = a / scale[t][:, None]
        moves = np.zeros((states, states))
        beta = after / (alpha[-1] * after).sum(axis=1)[:, None]
        for t in range(length - 1, -1, -1):
            real = rows[t] != pad
            if t or before is not None:
                onward = beta * emit[rows[t]] / scale[t][:, None]
                earlier = alpha[t - 1] if t else before
                moves += earlier[real].T @ onward[real]
            alpha[t] *= beta  # now the posterior
            if t:
                beta = onward @ self.move.T
        flat, posterior = rows.ravel(), alpha.reshape(-1, states)
        emitted = np.stack([np.bincount(flat, posterior[:, k], minlength=pad + 1)[:pad] for k in range(states)], axis=1)
        return emitted, moves * self.move, alpha[0].sum(axis=0) if before is None else np.zeros(states), float(np.log10(scale).sum())


def maximised(emitted: np.ndarray, moves: np.ndarray, first: np.ndarray, share: np.ndarray) -> Model:
    """The model of expected counts, each state's emissions drawn a little towards the corpus."""
    mass = emitted.sum(axis=0)
    prior = 0.02 * mass + 100
    emit = (emitted + share[:, None] * prior) / (mass + prior)
    moves = moves + 1 + 9 * np.eye(len(moves))
    return Model((first + 1) / (first + 1).sum(), moves / moves.sum(axis=1, keepdims=True), emit)


def _training(row: dict) -> tuple[np.ndarray, np.ndarray]:
    """Classes of a block's training tokens, and the lengths of its training texts."""
    lengths, held = np.array(row["lengths"], np.int64), np.array(row["held"], bool)
    tokens = _unpacked(row["kinds"], row["words"])[_unpacked(row["tokens"], int(lengths.sum()))]
    return tokens[~np.repeat(held, lengths)], lengths[~held]


def _summed(texts: DataFrame, rows: int, columns: int, partial) -> np.ndarray:
    """A table of sums over the training texts of all blocks: added up in tasks, then by row in Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((rows, columns))
        for batch in batches:
            for row in batch.to_pylist():
                total += partial(*_training(row))
        some = np.flatnonzero(total.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(some), *(pa.array(total[some, k]) for k in range(columns))], ["i", *(f"s{k}" for k in range(columns))])

    names = [f"s{k}" for k in range(columns)]
    parts = texts.select("held", "lengths", "tokens", "kinds", "words").mapInArrow(run, "i bigint, " + ", ".join(f"{s} double" for s in names))
    total = np.zeros((rows, columns))
    for r in parts.groupBy("i").agg(*[F.sum(s).alias(s) for s in names]).collect():  # one row for each class
        total[r["i"]] = [r[s] for s in names]
    return total


def first_model(texts: DataFrame, corpus: Corpus, states: int = STATES) -> Model:
    """A model from all training text: classes are clustered by the texts that their words are in, and states stay.

    A text is known by the mean of its classes' random signs, a class by the mean of its tokens' texts.
    """
    classes = corpus.classes
    signs = np.random.default_rng(7).choice(np.array([-1.0, 1.0]), (classes, SIGNS))

    def company(tokens: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        if not len(lengths):
            return np.zeros((classes, SIGNS + 1))
        mean = np.add.reduceat(signs[tokens], np.cumsum(lengths) - lengths) / lengths[:, None]
        return np.stack([np.bincount(tokens, np.repeat(c, lengths), classes) for c in (*mean.T, np.ones(len(lengths)))], axis=1)

    total = _summed(texts, classes, SIGNS + 1, company)
    n, share = total[:, -1], corpus.share()
    stay = np.full((states, states), 0.02 / states) + 0.98 * np.eye(states)
    if not n.any():
        return Model(np.full(states, 1 / states), stay, np.tile(share[:, None], (1, states)))
    mean = total[:, :-1].sum(axis=0) / n.sum()
    x = (total[:, :-1] + 20 * mean) / (n + 20)[:, None] - mean
    x /= np.sqrt((n[:, None] * x * x).sum() / n.sum()) + 1e-12
    rng, centres = np.random.default_rng(11), x[[int(np.argmax(n))]]
    for _ in range(states - 1):  # far from those chosen, as far as tokens weigh
        far = ((x[:, None] - centres[None]) ** 2).sum(axis=2).min(axis=1) * n
        centres = np.r_[centres, x[[int(rng.choice(classes, p=far / far.sum()) if far.sum() else 0)]]]
    for _ in range(30):
        own = ((x[:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
        centres = np.stack([np.average(x[own == s], axis=0, weights=n[own == s]) if n[own == s].sum() else centres[s] for s in range(states)])
    emit = share[:, None] * ((own[:, None] == np.arange(states)) + 0.05)
    return Model(np.full(states, 1 / states), stay, emit / emit.sum(axis=0))


def improved(texts: DataFrame, model: Model, corpus: Corpus) -> tuple[Model, float]:
    """One pass of Baum-Welch over all training text, and the log10 likelihood of the model before it."""
    classes, states = corpus.classes, len(model.first)

    def counts(tokens: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        emitted, moves, first, value = model.expected(tokens, lengths)
        return np.r_[emitted, moves, first[None], np.full((1, states), value / states)]

    total = _summed(texts, classes + states + 2, states, counts)
    return maximised(total[:classes], total[classes : classes + states], total[-2], corpus.share()), float(total[-1].sum())


def train(texts: DataFrame, corpus: Corpus, passes: int = PASSES, gain: float = GAIN) -> Model:
    """Baum-Welch over all training text until the likelihood gains little."""
    model, last = first_model(texts, corpus), -np.inf
    for _ in range(passes if corpus.tokens else 0):
        model, value = improved(texts, model, corpus)
        if value - last < gain * abs(value):
            break
        last = value
    return model


def score(texts: DataFrame, model: Model, corpus: Corpus) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every text of the blocks."""
    n_train, n_words, size = corpus.tokens, corpus.words, np.log10(corpus.class_size)

    def run(block: pa.Table, words: pa.Table) -> pa.Table:
        row = block.to_pylist()[0]
        lengths = np.array(row["lengths"], np.int64)
        tokens, kind = _unpacked(row["tokens"], int(lengths.sum())), _unpacked(row["kinds"], row["words"])
        by_range = sorted(zip(words.column("range").to_pylist(), words.column("totals").to_pylist(), strict=True))
        count = np.concatenate([_counts(x) for _, x in by_range])
        log_count = np.log10(count + 1.0)
        begin = np.cumsum(lengths) - lengths
        add = lambda x: np.add.reduceat(x[tokens], begin)
        base = add(log_count) - lengths * np.log10(float(n_train + n_words + 1))
        exact = model.forward(kind[tokens], lengths)[0] + add(log_count - size[kind])
        return pa.table(
            {
                "doc_id": pa.array(row["doc_ids"], pa.int64()),
                "held_out": pa.array(row["held"], pa.bool_()),
                "n_tokens": lengths,
                "n_known": add((count > 0).astype(np.int64)),
                "train_tokens": pa.array([n_train] * len(lengths), pa.int64()),
                "base_score": base,
                "score": exact,
            }
        )

    grouped = texts.select("block", "doc_ids", "held", "lengths", "tokens", "kinds", "words").groupBy("block").cogroup(corpus.looked_up.groupBy("of"))
    return grouped.applyInArrow(run, "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")


def op2_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact log10 likelihood of every document, and the unigram base it is held against."""
    texts = tokenised(table(spark, sf_dir, "documents"), crc_mod(F.col("doc_id"), 7) == 2)
    corpus = count_words(texts)
    return score(texts, train(texts, corpus), corpus)
