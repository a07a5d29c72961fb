"""Quality and toxicity: held-out accuracy, exact neighbours, edge cases."""

import math
import pickle
import random
import re
import zlib
from collections import Counter

import numpy as np

from corvane.llm import quality, toxicity

LANG = ["lorem", "ipsum", "dolor", "amet", "tempor", "magna", "aliqua", "erat", "sed", "diam"]


def corpus(n=600, seed=9):
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        words = [rng.choice(LANG) + rng.choice(["a", "b", "c", ""]) for _ in range(rng.randrange(20, 120))]
        bad, toxic = rng.random() < 0.25, rng.random() < 0.2
        if toxic:
            for _ in range(3):
                words[rng.randrange(len(words))] = rng.choice(["vilex", "grudox", "snarfy"]) + rng.choice(["", "ish"])
        text = " ".join(w + "###" if bad else w for w in words)
        docs.append((i, text, "x"))
        if rng.random() < 0.7:
            labels.append((i, int(not bad), int(toxic)))
    return docs, labels


def held_out(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


def frames(spark):
    docs, labels = corpus()
    extra = [(9001, None, "x"), (9002, "", "x"), (None, "lorem ipsum", "x"), (9003, "vilex " * 9, "x"), (9003, "vilex " * 9, "x")]
    return docs, labels, spark.createDataFrame(docs + extra, "doc_id long, text string, score string"), spark.createDataFrame([*labels, (None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")


def plain_risk(x, positive, prior, w, multiplier=1.0, ridge=quality.RIDGE):
    """The unbiased risk of weights by the definition, with its negative part."""
    z = np.c_[np.ones(len(x)), x] @ w
    negative = np.logaddexp(0, z).mean() - prior * np.logaddexp(0, z[positive]).mean()
    return prior * np.logaddexp(0, -z[positive]).mean() + multiplier * negative + ridge / 2 * w @ w, negative


def standardised(features):
    x = np.array(features, float)
    scale = np.sqrt(np.maximum((x * x).mean(0) - x.mean(0) ** 2, 0))
    return (x - x.mean(0)) / np.where(scale > 1e-6, scale, 1.0)


def assert_conditions(m, negative):
    """The multiplier is 1 and the negatives' risk not below zero, or 0 and not above it, or the risk is zero."""
    assert (m == 1.0 and negative >= -1e-6) or (m == 0.0 and negative <= 1e-6) or (0 < m < 1 and abs(negative) < 1e-4)


def test_the_solver_ends_at_the_optimum_of_any_problem():
    rng = np.random.default_rng(3)
    kinds = Counter()
    for _ in range(400):
        n, d = int(rng.integers(1, 60)), int(rng.integers(1, 9))
        raw = rng.normal(size=(n, d)) * rng.choice([0.1, 1, 3])
        if rng.random() < 0.3:
            raw[:, 0] = rng.integers(0, 2, n)
        positive = rng.random(n) < rng.choice([0.0, 0.1, 0.5, 1.0])
        raw[positive, -1] += rng.choice([0, 1, 5])
        x, prior = np.c_[np.ones(n), standardised(raw)], float(rng.choice([0.01, 0.1, 0.3, 0.5, 0.7, 0.9, 0.95, 0.99]))
        passes = 0

        def losses(w):
            nonlocal passes
            passes += 1
            return quality.Losses(np.concatenate([quality._loss_sums(part, w) for part in (x, x[positive])]), prior, quality.RIDGE, w)

        start = np.zeros(d + 1)
        start[0] = np.log(prior / (1 - prior))
        found = quality.solve(losses, start)
        w, m = found.losses.w, found.multiplier
        assert found.converged and passes < 150
        assert_conditions(m, found.losses.negative)
        gradient = found.losses.slope(m)[0]
        assert np.abs(gradient).max() < 1e-4
        # no weights near or far have a smaller non-negative risk
        risk = lambda v: (lambda k: k.risk(0.0) + max(0.0, k.negative))(losses(v))
        best = risk(w)
        assert all(risk(w + rng.normal(size=d + 1) * s) >= best - 2e-5 for s in (1e-3, 1e-2, 0.1, 1.0) for _ in range(3))
        kinds["one" if m == 1 else "zero" if m == 0 else "between"] += 1
    assert min(kinds[k] for k in ("one", "zero", "between")) > 10


def test_quality_weights_minimise_the_non_negative_risk(spark):
    rng = np.random.default_rng(6)
    good = rng.random(400) < 0.6
    raw = rng.normal(size=(400, quality.FEATURES)).astype(np.float32)
    raw[:, 0] += 1.5 * good
    positive = good & (rng.random(400) < 0.5)
    rows = spark.createDataFrame([(r.tolist(), bool(p)) for r, p in zip(raw, positive)], "x array<float>, positive boolean")
    x = standardised(raw)
    bound = []
    for prior in (0.3, 0.6, 0.95):
        model = quality.fit(rows, prior)
        w, m = np.array(model.weights), model.multiplier
        risk, negative = plain_risk(x, positive, prior, w, m)
        bound.append(m)
        assert model.converged
        assert_conditions(m, negative)
        # plain gradient descent by differences ends no lower, from the solution and from zero
        for v in (w.copy(), np.zeros_like(w)):
            for _ in range(400):
                z = np.c_[np.ones(len(x)), x] @ v
                p, full = 1 / (1 + np.exp(-z)), np.c_[np.ones(len(x)), x]
                g = prior * (full[positive] * (p[positive] - 1)[:, None]).mean(0) + m * ((full * p[:, None]).mean(0) - prior * (full[positive] * p[positive][:, None]).mean(0)) + quality.RIDGE * v
                v -= 0.2 * g
            assert plain_risk(x, positive, prior, v, m)[0] >= risk - 1e-4
        assert np.allclose(model.margin(raw.astype(float)), np.c_[np.ones(len(x)), x] @ w, atol=1e-3)
    assert bound[0] == 1.0 and bound[2] < 1.0  # the risk of the negatives binds where the prior is far too large


def test_prior_from_positives_and_unlabelled_text(spark):
    rng = np.random.default_rng(8)
    for share in (0.2, 0.7):
        good = rng.random(20_000) < share
        score = np.clip(np.where(good, rng.normal(0.75, 0.1, 20_000), rng.normal(0.3, 0.1, 20_000)), 0, 1)
        rows = spark.createDataFrame(list(zip(score.tolist(), (good & (rng.random(20_000) < 0.2)).tolist())), "score double, kept boolean")
        assert abs(quality.estimated_prior(rows) - share) < 0.05


def test_labels_of_bad_text_are_not_used(spark):
    docs, labels, df, known = frames(spark)
    shapes = df.select("doc_id", quality.features(df["text"]).alias("x"))
    assert quality.train(shapes, known) == quality.train(shapes, known.filter("quality = 1"))


def test_quality_keeps_columns_of_any_name_and_long_texts(spark):
    docs, labels, df, known = frames(spark)
    wide = df.withColumnRenamed("score", "shape").unionByName(spark.createDataFrame([(8000, "lorem " * 500_000, "y")], "doc_id long, text string, shape string"))
    kept = quality.keep_good(wide, known, 0.0)
    assert kept.columns == ["doc_id", "text", "shape"] and kept.count() == wide.count()
    assert sorted(r["shape"] for r in kept.collect()) == sorted(r["shape"] for r in wide.collect())


def test_quality_held_out(spark):
    docs, labels, df, known = frames(spark)
    shapes = df.select("doc_id", quality.features(df["text"]).alias("x"))
    model = quality.train(shapes, known)
    got = {r["doc_id"]: r["s"] for r in shapes.select("doc_id", model.score(shapes["x"]).alias("s")).collect()}
    assert all(0 <= s <= 1 for s in got.values()) and 9001 in got and got[9001] == got[9002]
    test = [(got[i] >= 0.7) == bool(q) for i, q, _ in labels if held_out(i)]
    assert np.mean(test) > 0.95
    kept = quality.keep_good(df, known)
    assert kept.columns == df.columns and 0 < kept.count() < df.count()


def brute_toxicity(docs, labels, strength):
    """Idf, cosines of all examples, the nearest and the score of every text, by plain loops."""
    words = lambda t: Counter(re.findall(rb"[0-9a-z\x80-\xff]+", (t or "").encode().lower()))
    counts = [words(t) for _, t, *_ in docs]
    df = Counter(w for c in counts for w in c)
    known = {}
    for i, _, t in labels:
        if i is not None and t is not None and not held_out(i):
            known[i] = max(t, known.get(i, 0))
    examples = {}
    for (i, *_), c in zip(docs, counts):
        if i in known and (i not in examples or len(c) < len(examples[i])):
            examples[i] = c
    n, toxic = len(examples), sum(known[i] for i in examples)
    of, of_toxic = Counter(w for c in examples.values() for w in c), Counter(w for i, c in examples.items() if known[i] for w in c)

    def cell(o, e):
        return o * math.log(o / e) if o else 0.0

    def idf(w):
        # the norm's unseen words: the number of documents of all unseen words in the bucket, each document once for each
        own = df[w] if w in of else sum(df[x] for x in df if x not in of and toxicity.bucket_of(x) == toxicity.bucket_of(w))
        plain = math.log((len(docs) + 1) / (own + 1)) + 1
        d, a, share = of[w], of_toxic[w], toxic / n
        if a <= d * share:
            return plain
        ratio = 2 * (cell(a, d * share) + cell(d - a, d * (1 - share)) + cell(toxic - a, (n - d) * share) + cell(n - toxic - d + a, (n - d) * (1 - share)))
        return plain * (1 + strength * math.sqrt(max(0.0, ratio - toxicity.CHANCE)))

    weight = {w: idf(w) for w in df}

    def unit(c):
        v = {w: (1 + math.log(k)) * weight[w] for w, k in c.items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {w: x / norm for w, x in v.items()}

    vectors = {i: unit(c) for i, c in examples.items()}
    base = (toxic + 0.5) / (n + 5)
    out = []
    for c in counts:
        q = unit(c) if c else {}
        every = {i: sum(x * v.get(w, 0.0) for w, x in q.items()) for i, v in vectors.items()}
        best = sorted((i for i, s in every.items() if s > 0), key=lambda i: (-round(every[i], 12), i))[: toxicity.NEIGHBOURS]
        votes = [(every[i] / every[best[0]]) ** 2 for i in best]
        score = (sum(v * known[i] for v, i in zip(votes, best)) + toxicity.SHRINK * base) / (sum(votes) + toxicity.SHRINK) if best else base
        out.append((score, best, [every[i] for i in best]))
    return out


def test_toxicity_matches_brute_force(spark):
    docs, labels, df, known = frames(spark)
    for strength in (0.0, toxicity.ASSOCIATION):
        want = brute_toxicity([(r["doc_id"], r["text"]) for r in df.collect()], [tuple(r) for r in known.collect()], strength)
        got = df.select("doc_id", toxicity.judge(df["text"], *toxicity.train(df, known, strength=strength)).alias("j")).collect()
        for r, (score, best, cosines) in zip(got, want, strict=True):
            assert r["j"]["neighbours"] == best and np.allclose(r["j"]["cosines"], cosines) and math.isclose(r["j"]["score"], score, rel_tol=1e-9)


def test_block_max_search_is_exact_with_small_blocks():
    rng = np.random.default_rng(4)
    vectors = []
    for _ in range(300):
        terms = np.unique(np.minimum(rng.geometric(0.02, rng.integers(1, 60)) - 1, 199))
        vectors.append((terms, rng.integers(1, 5, len(terms)).astype(float)))
    idf, none = rng.random(200) + 0.5, (np.zeros(0, np.int64), np.zeros(0))
    for block, frequent in ((4, 0), (8, 10), (64, 200)):
        index = toxicity.Index(np.arange(300), np.zeros(300), idf, np.ones(toxicity.OTHERS)).build(vectors, block, frequent)
        whole = np.zeros((300, 200))
        for i, v in enumerate(vectors):
            whole[i, v[0]] = index.weigh(*v, *none)
        texts = [(t, index.weigh(t, n, *none)) for t, n in vectors]
        for (places, cosines), row in zip(index.nearest(texts, 10), whole @ whole.T, strict=True):
            best = sorted(np.flatnonzero(row > 0).tolist(), key=lambda i: (-round(row[i], 12), i))[:10]
            assert index.ids[places].tolist() == best and np.allclose(cosines, row[best])


def test_what_travels_to_tasks_is_small_and_the_same_index():
    vectors = [(np.array([0, 1, 2 + i]), np.array([1.0, 2.0, 1.0])) for i in range(256)]
    index = toxicity.Index(np.arange(256), np.zeros(256), np.ones(258), np.ones(toxicity.OTHERS)).build(vectors)
    sent = pickle.dumps(index)
    assert len(sent) < 100_000  # the other words' weights alone are 8 MB
    for one in (index, toxicity.Index(np.arange(0), np.zeros(0), np.ones(0), np.ones(4)).build([])):
        got = pickle.loads(pickle.dumps(one))
        assert got.__dict__.keys() == one.__dict__.keys()
        for k, v in one.__dict__.items():
            assert np.array_equal(getattr(got, k), v), k


def test_toxicity_held_out_and_edges(spark):
    docs, labels, df, known = frames(spark)
    vocabulary, index = toxicity.train(df, known)
    got = {r["doc_id"]: r["j"] for r in df.select("doc_id", toxicity.judge(df["text"], vocabulary, index).alias("j")).collect()}
    test = [(got[i]["score"] >= 0.3) == bool(t) for i, _, t in labels if held_out(i)]
    assert np.mean(test) > 0.95
    assert all(not held_out(n) for j in got.values() for n in j["neighbours"])
    for empty in (9001, 9002):
        assert got[empty]["neighbours"] == [] and got[empty]["score"] == index.base
    # every text that shares a word with an example has evidence
    assert all(j["neighbours"] for i, j in got.items() if i not in (9001, 9002))
    kept = toxicity.drop_toxic(df.withColumnRenamed("score", "judged"), known)
    assert kept.columns == ["doc_id", "text", "judged"] and kept.filter("doc_id = 9003").count() == 0


def test_toxicity_of_a_very_long_text(spark):
    docs, labels, df, known = frames(spark)
    long = spark.createDataFrame([(77, " ".join(LANG) * 200_000)], "doc_id long, text string")
    [row] = long.select(toxicity.judge(long["text"], *toxicity.train(df, known)).alias("j")).collect()
    assert 0 <= row["j"]["score"] < 0.3 and row["j"]["neighbours"]


def test_without_documents_or_labels(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.keep_good(docs.limit(0), none).count() == 0
    assert quality.keep_good(docs, none, 0.0).count() == 2
    assert toxicity.drop_toxic(docs, none).count() == 2
    assert toxicity.drop_toxic(docs.limit(0), none).count() == 0
