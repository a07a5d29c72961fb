"""Targets, copies and the drawn mixture."""

import random

from pyspark.sql import functions as F

from corvane.llm import mixing


def poured(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    share, full = 1.5 * sum(sizes.values()), set()
    while True:
        rest = [s for s in names if s not in full]
        left = share - sum(2 * sizes[s] for s in full)
        rate = left / sum(w[s] for s in rest) if rest else 0
        over = {s for s in rest if rate * w[s] > 2 * sizes[s] + 1e-9}
        if not over:
            return {s: 2 * sizes[s] if s in full else rate * w[s] for s in names}
        full |= over


def test_targets_are_poured_by_weight(spark):
    rng = random.Random(4)
    for n in (1, 2, 5, 9):
        sizes = {f"s{i}": rng.choice([0, 3, 50, 1000, 90000]) for i in range(n)} | {None: 40}
        df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        got = {r["source"]: r["target"] for r in mixing.source_targets(df).collect()}
        want = poured(sizes)
        assert all(abs(got[s] - want[s]) < 1e-6 for s in want)


def test_mixture_follows_its_plan(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(["w"] * rng.randrange(1, 40)), f"s{i % 3}", "x") for i in range(3000)]
    rows += [(7000, None, "s0", "x"), (7001, "", None, "x"), (7002, "a b", None, "x"), (7002, "a b", None, "x"), (None, "c d e", "s1", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, mix string")
    plan = mixing.plan_mix(df, into="p").select("doc_id", "source", "p.*").collect()
    assert len(plan) == len(rows)
    for s in ("s0", "s1", "s2"):
        own = [r for r in plan if r["source"] == s]
        assert abs(sum(r["size"] * r["copies"] for r in own) - own[0]["target"]) < 0.06 * own[0]["target"]
    assert all(r["copies"] <= 2 for r in plan)
    mixed = mixing.mix_documents(df)
    assert mixed.columns == [*df.columns, "mix_copy"]
    assert mixed.count() == sum(r["copies"] for r in plan)
    again = mixing.mix_documents(df.repartition(7))
    key = [F.count("*"), F.sum("doc_id"), F.sum("mix_copy")]
    assert mixed.agg(*key).first() == again.agg(*key).first()


def test_empty_table(spark):
    assert mixing.mix_documents(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0


def test_columns_of_any_name_stay(spark):
    names = ["__source", "__target", "__mix", "mix", "its_source", "its_target"]
    df = spark.createDataFrame([(1, "a b", "s", *names), (2, None, None, *names)], "doc_id long, text string, source string, " + ", ".join(f"{n} string" for n in names))
    mixed = mixing.mix_documents(df)
    assert mixed.columns == [*df.columns, "mix_copy"] and mixed.count() > 0
    assert all(r[n] == n for r in mixed.collect() for n in names)
