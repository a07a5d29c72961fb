"""Quality classifier by positive-unlabelled learning.

A linear model over shape features of the whole text minimises the non-negative unbiased risk of
trusted positives (documents labelled good) and unlabelled text (all documents), weighted by a class
prior that is estimated from these two as well: labels of bad text are never used. With the logistic loss
the unbiased risk is convex, and each Newton step needs only sums over the rows: partial sums in the
tasks, added by position in Spark.
"""

from __future__ import annotations

import warnings
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.common import bytes_of, crc_mod, materialise, table, text_udf, unused

_PUNCTUATION = [b for b in range(33, 127) if not chr(b).isalnum()]
_GROUPS = [range(48, 58), range(65, 91), range(97, 123), [10], [9, 11, 12, 13, 32], [*range(9), *range(14, 32), 127], range(128, 256)]
_SHARES = np.zeros((256, len(_PUNCTUATION) + len(_GROUPS)))
for _k, _bytes in enumerate([*([b] for b in _PUNCTUATION), *_GROUPS]):
    _SHARES[list(_bytes), _k] = 1
#: Features of a text, besides the constant.
FEATURES = _SHARES.shape[1] + 7
RIDGE = 1e-2
#: The negatives' risk that counts as zero, and the root of the Newton decrement at which a minimum is reached.
TOLERANCE = 1e-5
#: Where halving ends: a part of a Newton step, a bracket of the multiplier.
SHORTEST_PACE, NARROWEST = 2.0**-40, 1e-13


def _features(texts: list[bytes]) -> pa.Array:
    out = np.zeros((len(texts), FEATURES), np.float32)
    for i, text in enumerate(texts):
        n = len(text)
        if not n:
            continue
        data = np.frombuffer(text, np.uint8)
        counts = sum(np.bincount(data[a : a + (1 << 20)], minlength=256) for a in range(0, n, 1 << 20))
        words = text.split()
        lines = text.split(b"\n")
        packer = zlib.compressobj(1)
        packed = sum(len(packer.compress(text[a : a + (1 << 20)])) for a in range(0, n, 1 << 20)) + len(packer.flush())
        m = max(1, len(words))
        out[i] = [
            *np.sqrt(counts @ _SHARES / n),
            np.log1p(n) / 10,
            np.log1p(len(words)) / 10,
            min(30.0, (n - counts[32] - counts[10]) / m) / 10,
            len(set(words)) / m,
            len(set(lines)) / len(lines),
            min(4.0, n / packed),
            np.log1p(n / len(lines)) / 10,
        ]
    return pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * FEATURES), pa.array(out.ravel()))


def features(text: Column) -> Column:
    """Shape of a whole text: shares of byte classes, lengths, repetition. Null is empty, all zeros."""
    return text_udf(_features, "array<float>")(bytes_of(text))


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64)


def sums(rows: DataFrame, partial: Callable[[pa.RecordBatch], np.ndarray]) -> np.ndarray:
    """Add up fixed-length vectors of the rows: within tasks first, then by position; only the total is collected."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                part = partial(batch)
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["i", "x"])

    parts = rows.mapInArrow(run, "i bigint, x double").groupBy("i").agg(F.sum("x").alias("x")).orderBy("i").collect()
    return np.array([r["x"] for r in parts])


@dataclass(frozen=True)
class Model:
    """Weights over standardised features, the constant first; ``prior`` is the estimated share of good text. A
    ``multiplier`` below 1 tells that the negatives' risk is held at zero or, at 0, is below it at the minimum."""

    weights: tuple[float, ...]
    mean: tuple[float, ...]
    scale: tuple[float, ...]
    prior: float
    multiplier: float = 1.0
    converged: bool = True

    def margin(self, x: np.ndarray) -> np.ndarray:
        w = np.array(self.weights)
        return w[0] + ((x - np.array(self.mean)) / np.array(self.scale)) @ w[1:]

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -500, 500)))

    def score(self, features_column: Column) -> Column:
        """The probability of good quality from a column of features."""

        def call(column: pa.Array) -> pa.Array:
            return pa.array(self.probability(_matrix(column)) if len(column) else [], pa.float64())

        call.__annotations__ = {"column": pa.Array, "return": pa.Array}
        return F.arrow_udf(call, returnType="double")(features_column)


def _softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, z)


def fit(rows: DataFrame, prior: float, ridge: float = RIDGE) -> Model:
    """Fit from rows (x: features, positive: boolean). All rows are the unlabelled sample, positives besides.

    The non-negative risk is ``prior * P+ + max(0, N)`` with ``N = U- - prior * P-`` (P, U: mean losses of the positives and of
    all rows), with a ridge. Every evaluation in ``solve`` is a pass over the rows; it goes on until the optimum's conditions hold.
    """
    if not rows.take(1):
        return Model((0.0,) * (FEATURES + 1), (0.0,) * FEATURES, (1.0,) * FEATURES, prior)

    def moments(batch: pa.RecordBatch) -> np.ndarray:
        x = _matrix(batch.column("x"))
        return np.r_[len(x), x.sum(axis=0), (x * x).sum(axis=0)]

    total = sums(rows, moments)
    n, first, second = total[0], total[1 : FEATURES + 1], total[FEATURES + 1 :]
    mean = first / n
    scale = np.sqrt(np.maximum(second / n - mean**2, 0))
    scale = np.where(scale > 1e-6, scale, 1.0)

    def losses(w: np.ndarray) -> Losses:
        def partial(batch: pa.RecordBatch) -> np.ndarray:
            x = np.c_[np.ones(batch.num_rows), (_matrix(batch.column("x")) - mean) / scale]
            positive = batch.column("positive").to_numpy(zero_copy_only=False).astype(bool)
            return np.concatenate([_loss_sums(part, w) for part in (x, x[positive])])

        return Losses(sums(rows, partial), prior, ridge, w)

    w = np.zeros(FEATURES + 1)
    w[0] = np.log(prior / (1 - prior))
    found = solve(losses, w)
    if not found.converged:
        warnings.warn("the quality model's risk was not minimised to the tolerance", stacklevel=2)
    return Model(tuple(found.losses.w), tuple(mean), tuple(scale), prior, found.multiplier, found.converged)


@dataclass(frozen=True)
class Solution:
    losses: Losses
    multiplier: float
    converged: bool


def _minimise(losses: Callable[[np.ndarray], Losses], now: Losses, multiplier: float) -> tuple[Losses, bool]:
    """Newton steps, halved where they do not lessen the risk, until the decrement is below the tolerance. The risk is
    strictly convex, so a step short enough lessens it: one that no longer does is at the end of what doubles tell."""
    while True:
        gradient, hessian = now.slope(multiplier)
        step = np.linalg.solve(hessian, gradient)
        decrement, pace = float(gradient @ step), 1.0
        if decrement < TOLERANCE**2:
            return now, True
        while True:
            tried = losses(now.w - pace * step)
            if tried.risk(multiplier) <= now.risk(multiplier) - pace * decrement / 4:
                break
            pace /= 2
            if pace < SHORTEST_PACE:
                return now, decrement < TOLERANCE
        now = tried


def solve(losses: Callable[[np.ndarray], Losses], w: np.ndarray) -> Solution:
    """The minimum of ``prior * P+ + max(0, N) + ridge`` from losses at given weights, starting at ``w``.

    It is the largest over m in 0..1 of the least ``prior * P+ + m * N + ridge``; N at that minimum does not grow with m. So
    m is 1 where N is not below zero there, 0 where N is not above zero there, and else where N is zero: found in
    a bracket by Newton steps in m, or its middle after a step that did not halve N.
    """
    now, good = _minimise(losses, losses(w), 1.0)
    if now.negative >= 0:
        return Solution(now, 1.0, good)
    one = now
    now, good = _minimise(losses, now, 0.0)
    if now.negative <= 0:
        return Solution(now, 0.0, good)
    low, high, m, last = 0.0, 1.0, 0.0, np.inf
    # from the nearer end
    if abs(one.negative) < abs(now.negative):
        now, m = one, 1.0
    while abs(now.negative) > TOLERANCE and high - low > NARROWEST:
        low, high = (m, high) if now.negative > 0 else (low, m)
        step = now.negative / max(now.fall(m), 1e-300)
        m = m + step if abs(now.negative) <= last / 2 and low < m + step < high else (low + high) / 2
        last = abs(now.negative)
        now, good = _minimise(losses, now, m)
    return Solution(now, m, good and abs(now.negative) <= 10 * TOLERANCE)


def _loss_sums(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Rows, losses as a positive and as a negative, margins' slope, and the losses' slope and curvature."""
    z = np.clip(x @ w, -500, 500)
    p = 1 / (1 + np.exp(-z))
    return np.r_[len(z), _softplus(-z).sum(), _softplus(z).sum(), x.sum(axis=0), x.T @ p, ((x * (p * (1 - p))[:, None]).T @ x).ravel()]


class Losses:
    """Mean losses of all rows and of the positives at weights ``w``, with their slopes."""

    def __init__(self, total: np.ndarray, prior: float, ridge: float, w: np.ndarray):
        d = len(w)
        self.prior, self.ridge, self.w = prior, ridge, w
        self.all, self.good = (t / max(1.0, t[0]) for t in np.split(total, 2))
        self.x, self.p, self.curve = slice(3, 3 + d), slice(3 + d, 3 + 2 * d), slice(3 + 2 * d, None)
        self.negative = float(self.all[2] - prior * self.good[2])

    def risk(self, multiplier: float = 1.0) -> float:
        return float(self.prior * self.good[1] + multiplier * self.negative + self.ridge / 2 * self.w @ self.w)

    def fall(self, multiplier: float) -> float:
        """How fast N at the minimum falls with the multiplier."""
        own = self.all[self.p] - self.prior * self.good[self.p]
        return float(own @ np.linalg.solve(self.slope(multiplier)[1], own))

    def slope(self, multiplier: float) -> tuple[np.ndarray, np.ndarray]:
        """Gradient and Hessian; the two losses of a positive differ by its margin, so its curvatures cancel at 1."""
        d, rest = len(self.w), self.prior * (1 - multiplier)
        gradient = self.prior * (self.good[self.p] - self.good[self.x]) + multiplier * (self.all[self.p] - self.prior * self.good[self.p]) + self.ridge * self.w
        hessian = multiplier * self.all[self.curve] + rest * self.good[self.curve]
        return gradient, hessian.reshape(d, d) + self.ridge * np.eye(d)


def trusted(labels: DataFrame, column: str) -> DataFrame:
    """(doc_id, label) from the labels that may be learnt from: the id's crc32 modulo 4 is not 2. Null ids and
    labels tell nothing; of repeated ids the larger label holds."""
    rows = labels.select("doc_id", F.col(column).alias("label")).filter(F.col("doc_id").isNotNull() & F.col("label").isNotNull())
    return rows.filter(crc_mod(F.col("doc_id"), 4) != 2).groupBy("doc_id").agg(F.max("label").alias("label"))


def estimated_prior(rows: DataFrame) -> float:
    """The share of good ones among all rows (score, kept), from positives that the score was not learnt from (``kept``).

    Above any score lie at least ``share * (positives above it)`` of all rows, and no more where only good ones are:
    the share is the least ratio of the two, over thresholds that a tenth of the positives or more reach. The ratio's
    chance error is a twentieth at most there. Scores are counted in 1,000 bins.
    """
    bins = rows.groupBy(F.least(F.floor(F.col("score") * 1000), F.lit(999)).cast("int").alias("bin")).agg(F.count("*").alias("n"), F.sum(F.col("kept").cast("long")).alias("p"))
    every, good = np.zeros(1000), np.zeros(1000)
    for r in bins.collect():
        every[r["bin"]], good[r["bin"]] = r["n"], r["p"]
    if not good.sum():
        return 0.5
    above, reached = np.cumsum(every[::-1]) / every.sum(), np.cumsum(good[::-1]) / good.sum()
    own = (reached >= 0.1) & (np.cumsum(good[::-1]) >= min(400, good.sum()))
    return float(np.clip((above[own] / reached[own]).min(), 0.01, 0.99))


def train(shapes: DataFrame, labels: DataFrame) -> Model:
    """The model from rows (doc_id, x) of all documents and the labels table (doc_id, quality).

    Only labels of good text are used. The class prior is estimated with a first model that a quarter of the
    positives, by a hash of their ids, are kept from; the second has them all.
    """
    good = trusted(labels, "quality").filter("label = 1").select("doc_id", F.lit(True).alias("good"))
    known = F.coalesce("good", F.lit(False))
    kept = known & (F.pmod(F.xxhash64(F.col("doc_id"), F.lit(17)), F.lit(4)) == 0)
    rows = materialise(shapes.join(good, "doc_id", "left").select("x", known.alias("good"), kept.alias("kept")), "quality")
    if rows.filter("good").isEmpty():
        return Model((0.0,) * (FEATURES + 1), (0.0,) * FEATURES, (1.0,) * FEATURES, 0.5)
    first = fit(rows.select("x", (F.col("good") & ~F.col("kept")).alias("positive")), 0.5)
    prior = estimated_prior(rows.select(first.score(F.col("x")).alias("score"), "kept"))
    return fit(rows.select("x", F.col("good").alias("positive")), prior)


def keep_good(documents: DataFrame, labels: DataFrame, least: float = 0.7) -> DataFrame:
    """The documents whose score is at least ``least``, all columns kept, whatever their names. Empty texts score like
    any other. Features are written for the fit alone, and made again for the score: the
    documents are not copied."""
    shapes = materialise(documents.select("doc_id", features(F.col("text")).alias("x")), "shapes")
    model = train(shapes, labels)
    own = unused(documents, "score")
    return documents.withColumn(own, model.score(features(F.col("text")))).filter(F.col(own) >= least).drop(own)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, learnt without the held-out quarter's labels."""
    shapes = materialise(table(spark, sf_dir, "documents").select("doc_id", features(F.col("text")).alias("x")), "shapes")
    score = train(shapes, table(spark, sf_dir, "labels")).score(F.col("x"))
    scored = shapes.select("doc_id", (crc_mod(F.col("doc_id"), 4) == 2).alias("held_out"), score.alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))
