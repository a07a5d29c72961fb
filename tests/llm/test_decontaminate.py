"""Window search against brute force."""

import random

from corvane.llm import decontaminate as d


def brute(text, items):
    words, hit, found = d.words_of((text or "").encode()), set(), set()
    for name, item in items:
        w = d.words_of((item or "").encode())
        windows = {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9))} if w else set()
        for win in windows:
            for i in range(len(words) - len(win) + 1):
                if tuple(words[i : i + len(win)]) == win:
                    hit.update(range(i, i + len(win)))
                    if name is not None:
                        found.add(name)
    return len(words), len(hit), sorted(found)


def test_search_matches_brute_force(spark):
    rng = random.Random(8)
    vocabulary = ["a", "b", "c", "D", "é", "7"]
    items = [(f"i{k}", " ".join(rng.choices(vocabulary, k=rng.choice([1, 2, 3, 7, 10, 11, 25])))) for k in range(12)]
    items = [i for i in items if len(i[1].split()) > 2] + [("none", ""), ("null", None), (None, "zz zz zz"), ("copy", items[-1][1]), ("copy", items[-1][1])]
    texts = [" ".join(rng.choices(vocabulary, k=rng.randrange(0, 60))) for _ in range(80)]
    for _ in range(40):
        item = rng.choice([i for i in items if i[1]])[1]
        texts.append(" ".join(rng.choices(vocabulary, k=9)) + ", " + item.upper().replace("É", "é") + "! " + " ".join(rng.choices(vocabulary, k=9)))
    texts += [None, "", "...", "zz zz zz"]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, leak string")
    bench = spark.createDataFrame(items, "item_id string, text string")
    want = {i: brute(t, items) for i, t in enumerate(texts)}
    for shard in (10**6, 20):  # one table, and a pass for each few items
        got = {r["doc_id"]: (r["f"]["n_words"], r["f"]["n_hit"], r["f"]["items"]) for r in d.find_leaks(docs, bench, shard_words=shard, into="f").collect()}
        assert got == want
    kept = d.drop_leaks(docs, bench)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i, w in want.items() if not w[1]}


def test_a_pass_holds_one_shard(spark, capsys):
    """No plan searches more than one shard's tables, however many there are."""
    docs = spark.createDataFrame([(1, "a b c"), (None, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(i, f"w{i} v{i} u{i}") for i in range(40)], "item_id long, text string")
    items, shards = d.benchmark_shards(bench, 30)
    assert shards == 4 and items.groupBy("shard").count().agg({"count": "sum"}).first()[0] == 40
    d.find_leaks(docs, bench, shard_words=30).explain()
    plan = capsys.readouterr().out.partition("Initial Plan")[0]
    assert plan.count("ArrowEvalPython") <= 1  # the merge of hits; searches are behind written tables
    assert d.find_leaks(docs, bench, shard_words=30).count() == 2


def test_columns_of_any_name_stay(spark):
    docs = spark.createDataFrame([(1, "zz zz zz", "p", "q", 3), (2, "yy", "p", "q", 4)], "doc_id long, text string, found string, others string, row int")
    bench = spark.createDataFrame([("i", "zz zz zz"), ("j", "a b c")], "item_id string, text string")
    for shard in (10**6, 1):
        got = d.find_leaks(docs, bench, shard_words=shard)
        assert got.columns == [*docs.columns, "leak"] and {r["doc_id"]: r["leak"]["n_hit"] for r in got.collect()} == {1: 3, 2: 0}
        assert sorted(map(tuple, got.drop("leak").collect())) == sorted(map(tuple, docs.collect()))


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    bench = spark.createDataFrame([], "item_id long, text string")
    assert d.drop_leaks(docs, bench).count() == 1
    assert d.find_leaks(docs.limit(0), bench).count() == 0
