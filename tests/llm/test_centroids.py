"""Centroid clustering against plain whole-number rounds."""

import hashlib
import math
import random

import pytest

from corvane.llm import centroids
from corvane.sources.shared import Scratch


def brute(rows, k, rounds, width):
    """{row position: (cluster, distance)} and the final centroids of rows (vec_id, embedding or None)."""
    kept = []
    for at, (vec_id, e) in enumerate(rows):
        if e is None or len(e) != width or any(x is None or not math.isfinite(x) for x in e):
            continue
        if all(abs(x) < centroids.LARGEST / 1024 for x in e):
            kept.append((at, vec_id, [math.floor(1024 * x) for x in e]))
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"3:{'' if r[1] is None else r[1]}".encode()).hexdigest(), r[2]))
    centers = [list(r[2]) for r in order[:k]]

    def assign():
        return {at: min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), j) for j, c in enumerate(centers)) for at, _, x in kept}

    for _ in range(rounds):
        near = assign()
        for j in range(len(centers)):
            own = [x for at, _, x in kept if near[at][1] == j]
            if own:
                centers[j] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    return {at: (j, d) for at, (d, j) in assign().items()}, centers


def random_rows(rng, n, width, spread):
    rows = [(i, [rng.choice(range(5)) * spread + rng.gauss(0, 1) for _ in range(width)]) for i in range(n)]
    rows += [(i, list(rows[i % 7][1])) for i in range(n, n + 15)]  # equal vectors
    rows += [rows[3], rows[3], (None, rows[4][1]), (None, [0.0] * width)]
    bad = [None, [], [1.0] * (width - 1), [float("nan")] + [0.0] * (width - 1), [float("inf")] + [0.0] * (width - 1), [None] + [0.0] * (width - 1), [1e30] + [0.0] * (width - 1)]
    return rows + [(1000 + i, b) for i, b in enumerate(bad)]


@pytest.mark.parametrize("k,rounds,spread", [(8, 10, 0.5), (5, 3, 0.0), (1, 2, 1.0)])
def test_clusters_match_plain_rounds(spark, k, rounds, spread):
    width = 6
    rows = random_rows(random.Random(k), 150, width, spread)
    df = spark.createDataFrame([(i, v, e, "x") for i, (v, e) in enumerate(rows)], "at int, vec_id long, embedding array<double>, cluster string")
    found = df.withColumn("x", centroids.quantised(df["embedding"], width)).filter("x is not null").drop("embedding")
    with Scratch(spark) as scratch:
        got = centroids.cluster(found, scratch, k, rounds)
        assert got.assigned.columns == ["at", "vec_id", "cluster", "x", "cluster_", "distance"]  # the caller's column stays
        rows_ = {r["at"]: (r["cluster_"], r["distance"]) for r in got.assigned.collect()}
    want, centers = brute(rows, k, rounds, width)
    assert rows_ == want
    assert got.centroids.tolist() == centers


def test_bounds_skip_only_what_cannot_change():
    """Hamerly's step equals a full scan over many rounds, small and large components, ties included."""
    import numpy as np

    rng = np.random.default_rng(5)
    for largest in (3, 1000, 1 << 26):
        x = rng.integers(-largest, largest, size=(400, 4))
        c = x[:6].copy()
        step = centroids.Step.between(c, c)
        cluster, upper, lower = np.full(400, -1), np.zeros(400), np.zeros(400)
        for _ in range(12):
            cluster, upper, lower = step.assign(x, cluster, upper, lower)
            plain = np.stack([((x - one) ** 2).sum(axis=1) for one in step.centroids], axis=1)
            assert (cluster == plain.argmin(axis=1)).all()
            new = np.stack([x[cluster == j].sum(axis=0) // max(1, (cluster == j).sum()) if (cluster == j).any() else step.centroids[j] for j in range(6)])
            step = centroids.Step.between(step.centroids, new)


def test_few_and_no_vectors(spark, tmp_path):
    schema = "vec_id long, embedding array<float>, label int"
    few = [(1, [0.5] * 64, 0), (2, [0.25] * 64, 1), (2, [0.25] * 64, 1), (3, None, 1)]
    for rows in (few, []):
        spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{tmp_path}/embeddings.parquet")
        got = centroids.op11_centroids(spark, str(tmp_path)).collect()
        assert sorted(r["vec_id"] for r in got) == [r[0] for r in rows if r[1]]
        assert all(r["distance"] == 0 and r["inertia"] == 0 and r["cluster_inertia"] == 0 for r in got)
