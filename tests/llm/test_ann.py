"""Nearest neighbours: recall, exact scores, ties, unusable vectors."""

import numpy as np
from pyspark.sql import functions as F

from corvane.llm import ann


def test_recall_and_scores(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(1500, 32)).astype(np.float32)
    x[100:400] = x[100]  # a common vector
    rows = [(int(i), [float(a) for a in v], "y") for i, v in enumerate(x)]
    rows += [(5000, None, ""), (5050, [], ""), (5100, [0.0] * 32, ""), (5150, [float("nan")] * 32, ""), (5200, [None] * 32, ""), (None, rows[0][1], "")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string")
    got = ann.nearest_neighbours(df, F.col("vec_id") % 50 == 0).collect()
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    hits = total = 0
    for q in range(0, 1500, 50):
        own = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        s = unit @ unit[q]
        s[q] = -9
        assert [r["rank"] for r in own] == [1, 2, 3, 4, 5]
        assert all(abs(r["score"] - s[r["vec_id"]]) < 1e-12 for r in own)
        assert [(-round(r["score"], 12), r["vec_id"]) for r in own] == sorted((-round(r["score"], 12), r["vec_id"]) for r in own)
        hits += len({r["vec_id"] for r in own} & set(np.lexsort((np.arange(1500), -np.round(s, 12)))[:5].tolist()))
        total += 5
    assert hits / total >= 0.9
    common = [r["vec_id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == 200]
    assert common == [100, 101, 102, 103, 104]
    assert {r["query_id"] for r in got} == set(range(0, 1500, 50))


def test_few_rows_give_all_candidates(spark):
    rows = [(0, [1.0, 0.0, 0.5]), (50, [1.0, 0.0, 0.5]), (3, [-1.0, 0.2, 0.0]), (4, [0.0, 0.0, -2.0]), (7, [1.0, 1.0])]
    got = ann.nearest_neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0)
    assert {(r["query_id"], r["vec_id"]) for r in got.collect()} == {(a, b) for a in (0, 50) for b in (0, 50, 3, 4) if a != b}
    assert ann.nearest_neighbours(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("vec_id") % 50 == 0).count() == 0
