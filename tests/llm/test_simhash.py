"""SimHash: fingerprints, links and components against brute force."""

import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from corvane.llm import simhash
from corvane.llm.components import components


def brute(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(ids, prints, most=3):
    names = list(range(len(prints)))

    def find(i):
        while names[i] != i:
            i = names[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= most:
                names[max(find(i), find(j))] = min(find(i), find(j))
    roots = [find(i) for i in range(len(prints))]
    return [min(ids[j] for j in range(len(ids)) if roots[j] == r) for r in roots]


def test_near_duplicates_match_brute_force(spark):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(rng.choices(words, k=rng.choice([1, 2, 3, 60, 300]))) for _ in range(60)]
    for i in range(40):  # near copies
        t = texts[i % 20].split()
        t[rng.randrange(len(t))] = "Changed"
        texts.append(" ".join(t))
    texts += [None, "", " \t\n", "A b c", "a B C", texts[5], texts[5]]
    ids = list(range(1000, 1000 - len(texts), -1))
    df = spark.createDataFrame([(i, t, "x") for i, t in zip(ids, texts)], "doc_id long, text string, fp string")
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(df).collect()}
    prints = [brute(t) for t in texts]
    assert {i: g[0] for i, g in got.items()} == {i: f"{p:016x}" for i, p in zip(ids, prints)}
    assert {i: g[1] for i, g in got.items()} == dict(zip(ids, brute_components(ids, prints)))


def test_long_posting_lists_are_cut_into_blocks_that_meet(spark, monkeypatch):
    rng = np.random.default_rng(3)
    base = int(rng.integers(1 << 62))
    f = np.unique(np.array([base ^ int(x) for x in rng.integers(0, 1 << 16, 300)], np.uint64))
    want = brute_components(list(range(len(f))), [int(x) for x in f])
    rows = spark.createDataFrame([(i, int(x.astype(np.int64))) for i, x in enumerate(f)], "doc_id long, fp long")
    for members, short in ((4096, 48), (32, 48), (32, 4)):
        monkeypatch.setattr(simhash.postings, "MEMBERS", members)
        monkeypatch.setattr(simhash.postings, "SHORT", short)
        got = {r["fp"]: r["component_id"] for r in simhash.component_of_fingerprints(rows).collect()}
        assert [got[int(x.astype(np.int64))] for x in f] == want


def test_tally_decides_at_every_key_width(spark):
    """Pairs on both sides of the minimum of five shared bytes and of the three bits."""
    rng = random.Random(5)
    prints = []
    for _ in range(40):
        p = rng.getrandbits(64)
        prints += [p, p ^ sum(1 << (8 * b) for b in rng.sample(range(8), rng.choice([3, 4]))), p ^ (0xF << 8 * rng.randrange(8))]
    want = brute_components(list(range(len(prints))), prints)
    signed = [int(np.uint64(p).astype(np.int64)) for p in prints]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    for width in (2, 3, 4, 5):
        roots = {r["node"]: r["root"] for r in components(simhash.link_fingerprints(df, 3, width)).collect()}
        got = [signed.index(next(x for x in signed if roots.get(x, x) == roots.get(s, s))) for s in signed]
        assert got == want


def test_links_span_planted_clusters(spark):
    rng = random.Random(7)
    prints = [rng.getrandbits(64) for _ in range(30)]
    for p in list(prints):
        q = p
        for _ in range(rng.randrange(6)):
            q ^= 1 << rng.randrange(64)
            prints.append(q)
    prints = list(dict.fromkeys(prints))
    signed = [int(np.uint64(p).astype(np.int64)) for p in prints]
    got = {r["fp"]: r["component_id"] for r in simhash.component_of_fingerprints(spark.createDataFrame(list(enumerate(signed)), "doc_id long, fp long")).collect()}
    assert [got[s] for s in signed] == brute_components(list(range(len(prints))), prints)


def test_exploded_postings_are_never_broadcast(spark, monkeypatch):
    monkeypatch.setattr(simhash.postings, "materialise", lambda df, name: df)
    fps = spark.range(1000).select(F.col("id").alias("fp"))
    members = simhash.postings.members_of(fps.select(F.explode(simhash.posting_keys(F.col("fp"), 4)).alias("key"), "fp"))
    assert "Broadcast" not in members._jdf.queryExecution().sparkPlan().toString()
    assert members.count() > 0


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(df).count() == 0
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_long_chain_is_one_component(spark):
    got = components(spark.createDataFrame([(i, i + 1) for i in range(200)], "a long, b long")).collect()
    assert len(got) == 200 and {r["root"] for r in got} == {0}
