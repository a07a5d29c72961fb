"""Centroid clustering in whole numbers with Hamerly's bounds.

Vectors are whole numbers, so sums, centroids and distances are exact and a clustering has one result, however the
rows are dealt. The state of a round is a written table: each vector with its cluster, an upper bound of the distance to
its centroid and one lower bound of the distance to the second nearest. Centroids that move loosen both by their drift;
only vectors whose bounds then cross measure their own distance, and those still ambiguous all of them. Bounds are
doubles, rounded away from each other, and a vector is only skipped where its upper bound is strictly below the lower:
ties always reach the exact scan, in which the smaller number wins.

The centroids are the only thing that goes to every task: ``k`` vectors, whatever the rows. Each round reads the table
once, sums only what moved, and removes the table before it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.common import table, unused
from corvane.sources.shared import Scratch

CLUSTERS, ROUNDS, WIDTH, SCALE = 8, 10, 64, 1024
#: Components of larger size are left out: squares of their differences would leave a long.
LARGEST = 1 << 27
#: Share by which bounds are widened after each rounding.
SLACK = 1e-12
#: Up to here, products of components add up exactly in doubles.
_IN_DOUBLES = 1 << 21
#: Vectors whose distances are held at a time.
BLOCK = 1 << 14


def quantised(embedding: Column, width: int = WIDTH, scale: int = SCALE) -> Column:
    """Components as floor(scale * x), or null where the vector has another length, or a null or non-finite component,
    or one of 2^27 or more after scaling."""
    scaled = F.transform(embedding, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))
    usable = (F.size(embedding) == width) & F.forall(embedding, lambda x: F.coalesce(F.abs(x.cast("double")) < LARGEST / scale, F.lit(False)) & ~F.isnan(x))
    return F.when(usable, scaled)


def _rows(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of x to the rows of c, as longs."""
    if max(np.abs(x).max(initial=0), np.abs(c).max(initial=0)) <= _IN_DOUBLES and x.shape[1] <= 1 << 8:
        a, b = x.astype(np.float64), c.astype(np.float64)
        return ((a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)[None, :]).astype(np.int64)
    return np.stack([((x - one) ** 2).sum(axis=1) for one in c], axis=1)


def _up(x: np.ndarray) -> np.ndarray:
    return x * (1 + SLACK)


def _down(x: np.ndarray) -> np.ndarray:
    return x * (1 - SLACK)


@dataclass(frozen=True)
class Step:
    """Centroids of a round, how far at most each has moved, and half the distance to its nearest other."""

    centroids: np.ndarray
    drift: np.ndarray
    half: np.ndarray

    @classmethod
    def between(cls, before: np.ndarray, after: np.ndarray) -> Step:
        apart = squared(after, after).astype(np.float64)
        np.fill_diagonal(apart, np.inf)
        moved = _up(np.sqrt(((after - before) ** 2).sum(axis=1).astype(np.float64)))
        return cls(after, moved, _down(np.sqrt(apart.min(axis=1)) / 2))

    def assign(self, x: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cluster and bounds of each vector; a cluster below zero has no bounds yet."""
        cluster, new = cluster.copy(), cluster < 0
        own = np.where(new, 0, cluster)
        largest = int(self.drift.argmax())
        others = np.where(own == largest, np.delete(self.drift, largest).max(initial=0.0), self.drift[largest])
        upper = np.where(new, np.inf, _up(upper + self.drift[own]))
        lower = np.where(new, -np.inf, lower - others - SLACK * (np.abs(lower) + others))
        least = np.maximum(lower, self.half[own])
        crossed = np.flatnonzero(~new & (upper >= least))
        measured = ((x[crossed] - self.centroids[own[crossed]]) ** 2).sum(axis=1)
        upper[crossed] = _up(np.sqrt(measured.astype(np.float64)))
        ambiguous = np.flatnonzero(new | (upper >= least))
        for at in range(0, len(ambiguous), BLOCK):
            rows = ambiguous[at : at + BLOCK]
            distance = squared(x[rows], self.centroids)
            nearest = distance.argmin(axis=1)
            cluster[rows] = nearest
            upper[rows] = _up(np.sqrt(distance[np.arange(len(rows)), nearest].astype(np.float64)))
            distance[np.arange(len(rows)), nearest] = np.iinfo(np.int64).max
            second = distance.min(axis=1).astype(np.float64) if len(self.centroids) > 1 else np.full(len(rows), np.inf)
            lower[rows] = _down(np.sqrt(second))
        return cluster, upper, lower


def _stepped(step: Step):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            was = batch.column("cluster").to_numpy()
            cluster, upper, lower = step.assign(_rows(batch.column("x")), was, batch.column("upper").to_numpy(), batch.column("lower").to_numpy())
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("x"), pa.array(was), pa.array(cluster.astype(np.int32)), pa.array(upper), pa.array(lower)], _STATE)

    return run


def _moves(k: int, width: int):
    """Per task, what the moved vectors add to and take from each cluster: counts in position 0, sums after it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, width + 1), np.int64)
        for batch in batches:
            x = np.c_[np.ones(batch.num_rows, np.int64), _rows(batch.column("x"))] if batch.num_rows else np.zeros((0, width + 1), np.int64)
            to, was = batch.column("cluster").to_numpy(), batch.column("was").to_numpy()
            for j in range(k):
                total[j] += x[to == j].sum(axis=0) - x[was == j].sum(axis=0)
        at = np.flatnonzero(total.ravel())
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.ravel()[at])], ["i", "x"])

    return run


_STATE = ["row", "x", "was", "cluster", "upper", "lower"]


def first_centroids(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """The ``k`` vectors (or all, if fewer) whose ``seed:<vec_id>`` has the smallest SHA-256, in that order; a null id
    counts as the empty text, and of equal ids the smaller vectors come first."""
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256)
    chosen = vectors.select(name.alias("name"), "x").orderBy("name", "x").limit(k).collect()
    return np.array([r["x"] for r in chosen], np.int64) if chosen else np.zeros((0, 0), np.int64)


@dataclass(frozen=True)
class Clustering:
    """``assigned``: the input's rows with ``cluster`` and ``distance``; the final centroids; vectors and inertia by cluster."""

    assigned: DataFrame
    centroids: np.ndarray


def cluster(vectors: DataFrame, scratch: Scratch, k: int = CLUSTERS, rounds: int = ROUNDS, seed: int = 3) -> Clustering:
    """Cluster rows (vec_id, x: whole numbers, all of one length); other columns stay, whatever their names.

    ``rounds`` rounds assign every vector to its nearest centroid, ties to the smaller number, and move every centroid
    that has vectors to the floor of their mean; then vectors are assigned once more. Rounds after one in which nothing
    moved change nothing and are left out. Fewer vectors than ``k`` make as many clusters; none, an empty result.
    """
    names = vectors.columns
    start = vectors.select(F.struct(*[F.col(f"`{n}`") for n in names]).alias("row"), "x", F.lit(-1).alias("was"), F.lit(-1).alias("cluster"), F.lit(0.0).alias("upper"), F.lit(0.0).alias("lower"))
    state = scratch.write(start, "vectors")
    centroids = first_centroids(state.select("row.vec_id", "x"), k, seed)
    k, width = len(centroids), centroids.shape[1]
    total, step = np.zeros((k, width + 1), np.int64), Step.between(centroids, centroids) if k else None
    for round_ in range(rounds + 1 if k else 0):
        after = scratch.write(state.mapInArrow(_stepped(step), state.schema), "clusters")
        scratch.remove(state)
        state = after
        if round_ == rounds:
            break
        moved = state.filter("cluster != was").select("x", "was", "cluster").mapInArrow(_moves(k, width), "i bigint, x bigint").groupBy("i").agg(F.sum("x").alias("x")).collect()
        if not moved:
            break
        for r in moved:
            total.ravel()[r["i"]] += r["x"]
        filled = total[:, 0] > 0
        after = centroids.copy()
        after[filled] = total[filled, 1:] // total[filled, :1]
        step, centroids = Step.between(centroids, after), after
    final = centroids

    def own(x: pa.Array, cluster: pa.Array) -> pa.Array:
        return pa.array(((_rows(x) - final[cluster.to_numpy()]) ** 2).sum(axis=1) if len(x) else [], pa.int64())

    own.__annotations__ = {"x": pa.Array, "cluster": pa.Array, "return": pa.Array}
    kept = [F.col(f"row.`{n}`").alias(n) for n in names]
    taken = {n: unused(vectors, n) for n in ("cluster", "distance")}
    assigned = state.select(*kept, F.col("cluster").alias(taken["cluster"]), F.arrow_udf(own, returnType="bigint")("x", "cluster").alias(taken["distance"]))
    return Clustering(assigned, centroids)


def digest(centroid: np.ndarray) -> str:
    """SHA-256 of the components as decimal numbers joined by commas."""
    return hashlib.sha256(",".join(str(int(v)) for v in centroid).encode()).hexdigest()


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster and squared distance of every usable vector, with the sums of its cluster and of all, and its centroid's digest."""
    scratch = Scratch(spark)
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", quantised(F.col("embedding")).alias("x")).filter("x is not null")
    found = cluster(vectors, scratch)
    rows = scratch.keep_only(scratch.write(found.assigned.select("vec_id", "cluster", "distance"), "assigned"))
    sums = {r["cluster"]: r["d"] for r in rows.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}
    facts = [(j, sums.get(j, 0), digest(c)) for j, c in enumerate(found.centroids)] or [(0, 0, "")]
    own = F.element_at(F.array(*[F.struct(F.lit(d).cast("bigint").alias("d"), F.lit(s).alias("s")) for _, d, s in facts]), F.col("cluster") + 1)
    total = F.lit(sum(sums.values())).cast("bigint")
    return rows.select("vec_id", "cluster", "distance", own["d"].alias("cluster_inertia"), total.alias("inertia"), own["s"].alias("centroid_sha256"))


def _oracle(rounds: int = ROUNDS, k: int = CLUSTERS, seed: int = 3) -> str:
    """The clustering in SQL: a pair of tables for each round."""
    scaled = "list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT)"
    parts = [
        f"kept AS MATERIALIZED (SELECT vec_id, {scaled} AS x FROM embeddings WHERE len(embedding) = {WIDTH} AND list_count(embedding) = {WIDTH} AND len(list_filter(embedding, lambda x: isfinite(x))) = {WIDTH})",
        "cells AS MATERIALIZED (SELECT vec_id, unnest(x) AS v, generate_subscripts(x, 1) AS i FROM kept)",
        f"c0 AS MATERIALIZED (SELECT j, unnest(x) AS v, generate_subscripts(x, 1) AS i FROM (SELECT x, row_number() OVER (ORDER BY h) - 1 AS j FROM (SELECT x, sha256('{seed}:' || vec_id) AS h FROM kept ORDER BY h LIMIT {k})))",
    ]
    for r in range(rounds + 1):
        near = f"SELECT vec_id, c.j, sum((cells.v - c.v) * (cells.v - c.v))::BIGINT AS d FROM cells JOIN c{r} c USING (i) GROUP BY ALL"
        parts.append(f"a{r} AS MATERIALIZED (SELECT vec_id, j, d FROM ({near}) QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, j) = 1)")
        if r < rounds:
            mean = f"SELECT j, i, sum(v)::BIGINT AS s, count(*) AS n FROM a{r} JOIN cells USING (vec_id) GROUP BY ALL"
            moved = f"SELECT c.j, c.i, CASE WHEN n IS NULL THEN c.v ELSE (s - ((s % n) + n) % n) // n END AS v FROM c{r} c LEFT JOIN ({mean}) m USING (j, i)"
            parts.append(f"c{r + 1} AS MATERIALIZED ({moved})")
    parts.append(f"digests AS (SELECT j, sha256(string_agg(v::VARCHAR, ',' ORDER BY i)) AS centroid_sha256 FROM c{rounds} GROUP BY j)")
    return (
        "WITH " + ",\n".join(parts) + f"\nSELECT vec_id, j::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY j))::BIGINT AS cluster_inertia,"
        f" (sum(d) OVER ())::BIGINT AS inertia, centroid_sha256 FROM a{rounds} JOIN digests USING (j)"
    )


OP11_SQL = _oracle()
