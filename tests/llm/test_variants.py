"""Spelling variants against brute force over all pairs of words."""

import random
import re
import zlib
from collections import Counter

from corvane.llm import variants


def brute_words(docs, slip=variants.SLIP, shortest=7, least=2):
    counts = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            if slip and h % slip == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            counts[word] += 1
    return {w: n for w, n in counts.items() if len(w) >= shortest and n >= least}


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_groups(n):
    out = {}
    for word in n:
        others = [o for o in n if near(word, o)]
        best = min(others, key=lambda o: (-n[o], o), default=None)
        form = best if best and n[best] >= 10 * n[word] else None
        out[word] = [form, word, n[word], len(others), n[form] if form else None]
    for word in n:
        while out[out[word][1]][0]:
            out[word][1] = out[out[word][1]][0]
    return {w: tuple(v) for w, v in out.items()}


def documents():
    rng = random.Random(8)
    base = ["".join(rng.choices("abcdéÿ", k=rng.randrange(6, 11))) for _ in range(40)]
    weights = [rng.choice([1, 1, 2, 30, 400]) for _ in base]
    docs = []
    for i in range(120):
        own = []
        for word in rng.choices(base, weights, k=60):
            if rng.random() < 0.2:  # an edit of any kind
                at = rng.randrange(len(word))
                word = word[:at] + rng.choice(["", "x", word[at] * 2]) + word[at + rng.randrange(2) :]
            own.append(word if rng.random() < 0.7 else word.upper())
        docs.append((i, rng.choice([" ", "-", "7", "\n"]).join(own)))
    docs += [(None, "Variants variants ÀÉàé÷×abcdefg"), (7, None), (8, ""), (9, " \n"), docs[4], docs[4], (500, "Ωmega Ωmegaword ßword " * 3), (501, "letter" * 50_000)]
    return docs


def test_words_and_groups_match_brute_force(spark, monkeypatch):
    docs = documents()
    df = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, word string").repartition(3)
    for held in (1 << 19, 20):
        monkeypatch.setattr(variants, "HELD", held)
        counted = variants.words(df, variants.SLIP)
        assert {r["word"]: r["n"] for r in counted.collect()} == brute_words(docs)
    assert {r["word"]: r["n"] for r in variants.words(df).collect()} == brute_words(docs, None)
    got = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in variants.group_variants(counted).collect()}
    assert got == brute_groups(brute_words(docs))
    assert any(v[0] for v in got.values())


def test_long_chains_and_repeated_letters(spark):
    n = {"aaaaaaa": 10**6, "aaaaaaaa": 10**5, "aaaaaaaaa": 10**4, "aaaaaaaaab": 10**3, "aaaaaaaabb": 100, "baaaaaaabb": 10, "caaaaaaabb": 10, "bcaaaaaabb": 1, "zzzzzzz": 5}
    got = variants.group_variants(spark.createDataFrame(list(n.items()), "word string, n long")).collect()
    assert {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in got} == brute_groups(n)


def test_long_words_are_keyed_by_hashes(spark, monkeypatch):
    n = {"l" * 20_000: 20, "l" * 20_001: 2, "l" * 7_000 + "x" + "l" * 12_999: 1, "m" * 19_999: 3}
    got = variants.group_variants(spark.createDataFrame(list(n.items()), "word string, n long")).collect()
    assert {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in got} == brute_groups(n)
    docs = documents()
    for plain in (6, 7, 8, 9):  # words on both sides of the border
        monkeypatch.setattr(variants, "PLAIN", plain)
        n = brute_words(docs, None, 6, 1)
        got = variants.group_variants(spark.createDataFrame(list(n.items()), "word string, n long")).collect()
        assert {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in got} == brute_groups(n)


def test_no_words(spark):
    assert variants.group_variants(spark.createDataFrame([], "word string, n long")).collect() == []
    assert variants.words(spark.createDataFrame([], "doc_id long, text string"), 31).collect() == []


def test_deletions_are_never_broadcast(spark):
    counted = spark.range(1000).selectExpr("concat('harbour', id) as word", "id + 2 as n")
    assert "Broadcast" not in variants._short_pairs(counted)._jdf.queryExecution().sparkPlan().toString()
