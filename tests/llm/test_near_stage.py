"""The pipeline's near-duplicate stage against brute force over all pairs."""

import random

import pytest

import corpus_pipeline as p
from corvane.llm import postings


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def groups(rows):
    sets, names = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        while names[i] != i:
            i = names[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or 5 * len(a & b) >= 4 * len(a | b):
                names[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(rows))]


def planted():
    rng = random.Random(11)
    words = [f"w{i}" for i in range(3000)]
    texts = [" ".join(rng.choices(words, k=rng.choice([30, 90, 200, 400]))) for _ in range(60)]
    for k in range(240):  # near copies on both sides of the threshold
        t = texts[k % 60].split()
        for _ in range(rng.randrange(1, 1 + len(t) // 25)):
            t[rng.randrange(len(t))] = "changed" + rng.choice(words)
        texts.append(" ".join(t))
    common = " ".join(rng.choices(words, k=25))
    texts += [common + " " + " ".join(rng.choices(words, k=30)) for _ in range(40)]
    texts += [None, "", " \t", "A b c", "a B C", "a b c d", texts[3], texts[3].upper()]
    ids = rng.sample(range(10**6), len(texts))
    return list(zip(ids, texts, strict=True))


def test_stage_drops_all_planted_near_copies(spark):
    rows = planted()
    names = groups(rows)
    want = sorted(min(i for (i, _), n in zip(rows, names, strict=True) if n == name) for name in set(names))
    assert 60 < len(want) < len(rows) - 60
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = p.drop_near_duplicates(spark, df, "")
    assert got.columns == df.columns
    assert sorted(r["doc_id"] for r in got.collect()) == want


@pytest.mark.parametrize("members, short", [(4096, 48), (16, 48), (16, 2)])
def test_long_lists_are_cut_into_blocks_that_meet(spark, monkeypatch, members, short):
    """Shingles that hundreds of texts share, and copies around several centres, in blocks of 16."""
    rng = random.Random(12)
    words = [f"w{i}" for i in range(3000)]
    rows = []
    for _ in range(3):
        centre = rng.choices(words, k=120)
        for _ in range(60):
            t = list(centre)
            for _ in range(rng.randrange(4)):
                t[rng.randrange(len(t))] = "new" + rng.choice(words)
            rows.append((len(rows), " ".join(t)))
    common = " ".join(rng.choices(words, k=40))
    rows += [(len(rows) + i, common + " " + " ".join(rng.choices(words, k=12))) for i in range(80)]
    names = groups(rows)
    monkeypatch.setattr(postings, "MEMBERS", members)
    monkeypatch.setattr(postings, "SHORT", short)
    got = p.drop_near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert sorted(r["doc_id"] for r in got.collect()) == sorted(set(names))


def test_stage_keeps_columns_of_any_name(spark):
    df = spark.createDataFrame([(1, "a b c", "x", 7, None), (2, "a b c", "y", 8, 1.0), (3, "q", "z", 9, 2.0)], "doc_id long, text string, near string, row int, fp double")
    got = p.drop_near_duplicates(spark, df, "")
    assert got.columns == df.columns and sorted(map(tuple, got.collect()), key=lambda r: r[0]) == [(1, "a b c", "x", 7, None), (3, "q", "z", 9, 2.0)]


def test_stage_on_empty_table_and_null_ids(spark):
    assert p.drop_near_duplicates(spark, spark.createDataFrame([], "doc_id long, text string"), "").count() == 0
    rows = [(5, "a b c d"), (5, "a b c d"), (2, "A B c d"), (None, "a b c d"), (None, "other words here now"), (7, None), (8, "")]
    got = p.drop_near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    assert sorted((r["doc_id"] or -1, r["text"]) for r in got) == [(-1, "other words here now"), (2, "A B c d"), (7, None)]
