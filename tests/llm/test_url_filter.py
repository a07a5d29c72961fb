"""URL rules against a plain reading of them."""

import random

from pyspark.sql import functions as F

from corvane.llm import url_filter as u


def plain(url):
    host, path = u.split_url(url)
    best = None
    for r in u.RULES:
        h, _, p = r.name.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(r.name) > len(best.name)):
            best = r
    return host, path, best and best.name, best.verdict if best else "allow"


def test_rules_match_plain_reading(spark):
    rng = random.Random(2)
    hosts = ["example.com", "WWW.Example.com", "badexample.com", "a.net", "net", "x.y.net", "com", "example.org", "é.com", "user@a.com:80", ""]
    paths = ["", "/", "/en", "/en/", "/en/1", "/EN/", "/es/a", "/fr/", "/x.net/es/", "//es/", "/en/*?"]
    urls = [f"http://{rng.choice(hosts)}{rng.choice(paths)}{rng.choice(['', '?q=/en/', '#/fr/'])}" for _ in range(400)]
    urls += [None, "", "example.com/en/", "://", "a://b://c/en/", "http://net/es/" + "x" * 70000, "http://a.com\n/x"]
    df = spark.createDataFrame([(i, x, "kept") for i, x in enumerate(urls)], "page_id long, url string, verdict string")
    got = df.select("page_id", u.judge(F.col("url"), u.RULES).alias("j")).select("page_id", "j.*").collect()
    assert {r["page_id"]: tuple(r)[1:] for r in got} == {i: plain(x) for i, x in enumerate(urls)}
    kept = u.filter_urls(df, u.RULES)
    assert kept.columns == df.columns and kept.count() == sum(plain(x)[3] == "allow" for x in urls)


def test_globs_and_many_words(spark):
    rules = [u.Rule("block", f"r{i}", f"**{'ab'[i % 2]}{i:03d}?x*") for i in range(60)]
    a = u.Automaton(rules)
    assert a.words > 4
    hit = a.matches([b".h/zza004qxtail", b".h/b005qx/no", b".h/a006/x", b""])
    assert [set(row.nonzero()[0]) for row in hit] == [{4}, set(), set(), set()]


def test_no_rules_and_empty_table(spark):
    df = spark.createDataFrame([], "page_id long, url string")
    assert df.select(u.judge(F.col("url"), u.RULES)).count() == 0
    one = spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string")
    assert one.select(u.judge(F.col("url"), [], "block").alias("j")).first()["j"]["verdict"] == "block"


def test_columns_of_any_name_stay_in_the_filter(spark):
    df = spark.createDataFrame([("http://a.com/x", "v", "w"), (None, "v", "w")], "url string, __corvane_verdict string, judged string")
    got = u.filter_urls(df, u.RULES)
    assert got.columns == df.columns and all((r[1], r[2]) == ("v", "w") for r in got.collect()) and got.count() == 2
