"""Scores as column expressions: calibration to [0, 1), weighted noisy-or, cosine."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A BM25 score that is calibrated to one half.
BM25_MIDPOINT = 6.0
#: Cosines up to this floor say nothing.
SIMILARITY_FLOOR = 0.70
#: Constant of reciprocal rank fusion.
FUSION = 60


def calibrate_bm25(score: Column) -> Column:
    """score / (score + 6): absolute, whatever else was found."""
    return F.when(score > 0, score / (score + BM25_MIDPOINT)).otherwise(0.0)


def calibrate_similarity(cosine: Column, floor: float = SIMILARITY_FLOOR) -> Column:
    """The share of the way from ``floor`` to 1 that a cosine has come, at least 0."""
    return F.greatest(F.lit(0.0), (cosine - floor) / (1.0 - floor))


def noisy_or(signals: Sequence[tuple[Column, float]]) -> Column:
    """1 - product of (1 - signal * weight / largest weight); a null signal is 0 and still counts its weight."""
    largest = max(w for _, w in signals)
    product = F.lit(1.0)
    for signal, weight in signals:
        product = product * (1.0 - F.coalesce(signal, F.lit(0.0)) * (weight / largest))
    return 1.0 - product


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def dot(left: Column, right: Column) -> Column:
    """Sum of products in double precision."""
    return _total(F.zip_with(left, right, lambda x, y: x.cast("double") * y.cast("double")))


def norm(vector: Column) -> Column:
    """Euclidean length in double precision."""
    return F.sqrt(_total(F.transform(vector, lambda x: x.cast("double") * x.cast("double"))))


def unit(vector: Column) -> Column:
    """The vector at length 1 in double precision; a zero vector stays."""
    length = norm(vector)
    return F.when(length > 0, F.transform(vector, lambda x: x.cast("double") / length)).otherwise(F.transform(vector, lambda x: x.cast("double")))


def cosine(left: Column, right: Column) -> Column:
    """Cosine in double precision; 0 where lengths differ or a vector is zero."""
    lengths = norm(left) * norm(right)
    return F.when((F.size(left) == F.size(right)) & (lengths > 0), dot(left, right) / lengths).otherwise(0.0)


def reciprocal_rank(rank: Column, constant: int = FUSION) -> Column:
    """1 / (60 + rank), 0 for a null rank."""
    return F.coalesce(1.0 / (constant + rank), F.lit(0.0))
