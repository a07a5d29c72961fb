"""Hidden Markov model: exact likelihood, a proper distribution, better than the base on held-out text."""

import itertools
import math
import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from corvane.llm import hmm


def test_forward_is_exact():
    rng = np.random.default_rng(1)
    norm = lambda x, axis: x / x.sum(axis=axis, keepdims=True)
    m = hmm.Model(norm(rng.random(3), 0), norm(rng.random((3, 3)), 1), norm(rng.random((5, 3)), 0))
    sequences = [rng.integers(0, 5, n) for n in (1, 2, 5, 17, 40, 16, 32)]
    got, _ = m.forward(np.concatenate(sequences), np.array([len(s) for s in sequences]))
    for s, g in zip(sequences, got):
        a = m.first * m.emit[s[0]]
        for t in s[1:]:
            a = (a @ m.move) * m.emit[t]
        assert math.isclose(g, math.log10(a.sum()), rel_tol=1e-12)
    s = sequences[2][:3]
    paths = sum(m.first[p[0]] * m.emit[s[0], p[0]] * m.move[p[0], p[1]] * m.emit[s[1], p[1]] * m.move[p[1], p[2]] * m.emit[s[2], p[2]] for p in itertools.product(range(3), repeat=3))
    assert math.isclose(m.forward(s, np.array([3]))[0][0], math.log10(paths))


def uncut(m, s):
    """Expected counts of one text by forward-backward over the whole of it."""
    alpha, beta, states = [m.first * m.emit[s[0]]], [np.ones(len(m.first))], len(m.first)
    alpha[0] = alpha[0] / alpha[0].sum()
    for t in s[1:]:
        a = (alpha[-1] @ m.move) * m.emit[t]
        alpha.append(a / a.sum())
    for t in s[:0:-1]:
        b = m.move @ (m.emit[t] * beta[0])
        beta.insert(0, b / b.sum())
    emitted, moves = np.zeros_like(m.emit), np.zeros((states, states))
    for t, (a, b) in enumerate(zip(alpha, beta)):
        emitted[s[t]] += a * b / (a * b).sum()
        if t:
            x = alpha[t - 1][:, None] * m.move * (m.emit[s[t]] * b)[None]
            moves += x / x.sum()
    return emitted, moves, alpha[0] * beta[0] / (alpha[0] * beta[0]).sum()


def test_expected_counts_of_cut_texts_are_those_of_the_uncut_recursions():
    rng = np.random.default_rng(5)
    norm = lambda x, axis: x / x.sum(axis=axis, keepdims=True)
    m = hmm.Model(norm(rng.random(3), 0), norm(rng.random((3, 3)) ** 3, 1), norm(rng.random((6, 3)) ** 3, 0))
    texts = [rng.integers(0, 6, n) for n in (1, 15, 16, 17, 32, 33, 48, 100, 700, 64)]
    want = [sum(x) for x in zip(*(uncut(m, t) for t in texts))]
    for segment in (16, 32, 128):
        *got, value = m.expected(np.concatenate(texts), np.array([len(t) for t in texts]), segment)
        for g, w in zip(got, want):
            assert np.allclose(g, w, rtol=1e-9, atol=1e-12)
        assert math.isclose(value, m.forward(np.concatenate(texts), np.array([len(t) for t in texts]))[0].sum(), rel_tol=1e-12)


def test_baum_welch_raises_the_likelihood():
    rng = np.random.default_rng(2)
    sequences = [rng.integers(0, 4, 40) if k % 2 else rng.integers(4, 8, rng.integers(1, 60)) for k in range(60)]
    tokens, lengths = np.concatenate(sequences), np.array([len(s) for s in sequences])
    model = hmm.Model(np.array([0.5, 0.5]), np.full((2, 2), 0.5), np.stack([np.linspace(1, 2, 8), np.linspace(2, 1, 8)], 1) / 12)
    last = -math.inf
    for _ in range(15):
        emitted, moves, first, value = model.expected(tokens, lengths, 16)
        assert value >= last - 1e-9
        assert math.isclose(emitted.sum(), len(tokens)) and math.isclose(first.sum(), 60)
        last = value
        model = hmm.Model(first / first.sum(), moves / moves.sum(1, keepdims=True), emitted / emitted.sum(0))


def test_scores_of_documents(spark, monkeypatch):
    rng = random.Random(3)
    kinds = [[f"{c}{i}" for i in range(30)] for c in "xy"]
    rows = [(i, " ".join(rng.choices(kinds[i % 2], k=rng.randrange(1, 80))), "z") for i in range(300)]
    rows += [(900, None, "z"), (901, "", "z"), (902, "never seen WORDS", "z"), (None, "x1 x2", "z"), (5, rows[5][1], "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, score string")
    monkeypatch.setattr(hmm, "RANGE", 16)
    monkeypatch.setattr(hmm, "BLOCK", 4096)
    texts = hmm.tokenised(df, F.col("doc_id") % 7 == 2, 64)
    counted = hmm.count_words(texts, 64)
    model = hmm.train(texts, counted)
    got = hmm.score(texts, model, counted).collect()
    assert len(got) == len(rows)
    train = [w for i, t, _ in rows if i is None or i % 7 != 2 for w in [*(t or "").lower().split(), "\n"]]
    n, v = len(train), len(set(train))
    texts_of = {(i, t) for i, t, _ in rows}
    for r in got:
        options = [t for i, t in texts_of if i == r["doc_id"]]
        tokens = [*(options[0] or "").lower().split(), "\n"]
        assert r["n_tokens"] == len(tokens) and r["train_tokens"] == n and r["n_known"] == sum(w in set(train) for w in tokens)
        assert math.isclose(r["base_score"], sum(math.log10((train.count(w) + 1) / (n + v + 1)) for w in tokens), rel_tol=1e-9)
        # the score end to end from words: classes, counts and a plain forward recursion
        kinds = [xxhash.xxh3_64_intdigest(w.encode()) % 64 for w in tokens]
        a, value = model.first, 0.0
        for k, (w, c) in enumerate(zip(tokens, kinds)):
            same = [x for x in set(train) if xxhash.xxh3_64_intdigest(x.encode()) % 64 == c]
            a = (a if k == 0 else a @ model.move) * model.emit[c] * (train.count(w) + 1) / (sum(train.count(x) for x in same) + len(same) + 1)
            value += math.log10(a.sum())
            a = a / a.sum()
        assert math.isclose(r["score"], value, rel_tol=1e-9)
    held = [r for r in got if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 300]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_empty_table(spark):
    texts = hmm.tokenised(spark.createDataFrame([], "doc_id long, text string"), F.lit(False), 16)
    counted = hmm.count_words(texts, 16)
    assert hmm.score(texts, hmm.train(texts, counted), counted).count() == 0


def test_nothing_to_learn_from_and_a_very_long_text(spark):
    rows = [(1, "a b"), (2, None), (3, "A " * 300_000)]
    texts = hmm.tokenised(spark.createDataFrame(rows, "doc_id long, text string"), F.lit(True), 16)
    counted = hmm.count_words(texts, 16)
    got = {r["doc_id"]: r for r in hmm.score(texts, hmm.train(texts, counted), counted).collect()}
    assert got[3]["n_tokens"] == 300_001 and got[1]["n_known"] == 0 and got[2]["base_score"] == 0.0
    assert all(math.isfinite(r["score"]) for r in got.values())
    learnt = hmm.tokenised(spark.createDataFrame(rows, "doc_id long, text string"), F.lit(False), 16)
    counted = hmm.count_words(learnt, 16)
    assert counted.tokens == 300_005 and counted.words == 3
    assert hmm.score(learnt, hmm.train(learnt, counted), counted).count() == 3
