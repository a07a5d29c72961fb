"""A knowledge base: synchronisation, incremental equality, search, scopes."""

import pytest
from pyspark.sql import functions as F

from corvane.session import KnowledgeBase

DOCS = {
    "documents/work/phoenix-plan.md": "# Phoenix\n\nAlpha uses Beta for storage.\n\n# Costs\n\nGamma pays.",
    "documents/work/atlas.md": "# Atlas\n\nBeta depends on Gamma and Alphas.",
    "documents/home/notes.md": "# Notes\n\nDelta likes tea.",
}


def frame(spark, docs):
    return spark.createDataFrame(list(docs.items()), "source string, markdown string")


def extract(chunks):
    """Capitalised known names are nodes; neighbours in a text are linked."""
    found = F.filter(F.regexp_extract_all("text", F.lit("(Alphas?|Beta|Gamma|Delta|tea)"), 1), lambda x: x != "")
    rows = chunks.select(F.col("id").alias("chunk_id"), found.alias("names")).filter(F.size("names") > 0)
    nodes = rows.select("chunk_id", F.posexplode("names").alias("ord", "label")).select("chunk_id", "ord", F.col("ord").cast("string").alias("ref"), "label", F.lit("thing").alias("type"), F.lit(None).cast("string").alias("suggested_type"))
    edges = nodes.filter("ord > 0").select("chunk_id", "ord", (F.col("ord") - 1).cast("string").alias("source_ref"), F.col("ref").alias("target_ref"), F.lit("near").alias("label"))
    return nodes, edges


def content(base):
    nodes = {r["id"]: (r["label"], tuple(r["chunk_ids"])) for r in base.table("nodes").collect()}
    edges = {(nodes[r["source"]][0], nodes[r["target"]][0], tuple(r["chunk_ids"])) for r in base.table("edges").collect()}
    return sorted(nodes.values()), sorted(edges)


def test_sync_and_search(spark, tmp_path):
    base = KnowledgeBase(spark, str(tmp_path / "kb"), {"work": "documents/work", "home": "documents/home"})
    assert not base.store.exists()
    changes = {r["source"]: r["change"] for r in base.sync(frame(spark, DOCS), extract).collect()}
    assert set(changes.values()) == {"added"}
    labels = sorted(r["label"] for r in base.table("nodes").collect())
    assert labels == ["Alphas", "Beta", "Delta", "Gamma", "tea"]  # Alpha and Alphas are one; the first source names it
    version = base.store.current()[0]
    base.sync(frame(spark, DOCS), extract)
    assert base.store.current()[0] == version  # nothing changed, nothing written
    hits, paths, refs = base.search("How is Alpha related to Gamma?")
    assert {r["source"] for r in hits.collect()} <= set(DOCS) and hits.count() > 0
    scoped = base.search("Delta tea", scope="HOME")[0].collect()
    assert {r["source"] for r in scoped} == {"documents/home/notes.md"}
    with pytest.raises(ValueError):
        base.search("x", scope="nowhere")
    with pytest.raises(ValueError):
        base.search("x", sources=["missing.md"])
    assert base.find_documents("phoenix plan").first()["source"] == "documents/work/phoenix-plan.md"
    chunk = base.table("chunks").first()
    assert base.neighborhood(chunk["source"], chunk["id"]).count() == 1
    with pytest.raises(LookupError):
        base.neighborhood(chunk["source"], "nothing")


def test_incremental_equals_rebuild(spark, tmp_path):
    base = KnowledgeBase(spark, str(tmp_path / "a"))
    base.sync(frame(spark, DOCS), extract)
    after = dict(DOCS)
    del after["documents/home/notes.md"]
    after["documents/work/phoenix-plan.md"] = "# Phoenix\n\nBeta and Delta."
    after["documents/work/new.md"] = "# New\n\nGamma with tea."
    changes = {r["source"]: r["change"] for r in base.sync(frame(spark, after), extract).collect()}
    assert changes == {"documents/home/notes.md": "deleted", "documents/work/phoenix-plan.md": "changed", "documents/work/new.md": "added", "documents/work/atlas.md": "unchanged"}
    fresh = KnowledgeBase(spark, str(tmp_path / "b"))
    fresh.sync(frame(spark, after), extract)
    assert sorted(n for n, _ in content(base)[0]) == sorted(n for n, _ in content(fresh)[0])
    assert {(a, b) for a, b, _ in content(base)[1]} == {(a, b) for a, b, _ in content(fresh)[1]}


def test_failure_leaves_the_store_as_it_was(spark, tmp_path):
    base = KnowledgeBase(spark, str(tmp_path / "kb"))
    base.sync(frame(spark, DOCS), extract)
    before = content(base)

    def broken(chunks):
        raise RuntimeError("no model")

    with pytest.raises(RuntimeError):
        base.sync(frame(spark, {"documents/x.md": "# X\n\nAlpha"}), broken)
    assert content(base) == before


def test_streaming_ingest(spark, tmp_path):
    from corvane.streaming.ingest import ingest, stream_markdown

    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.md").write_bytes(b"# A\r\n\r\nAlpha near Beta.")
    base = KnowledgeBase(spark, str(tmp_path / "kb"))
    run = lambda: ingest(stream_markdown(spark, f"file://{folder}"), base, extract, str(tmp_path / "check")).awaitTermination()
    run()
    (folder / "b.md").write_text("# B\n\nGamma near Beta.")
    run()
    assert sorted(r["label"] for r in base.table("nodes").collect()) == ["Alpha", "Beta", "Gamma"]
    assert sorted(r["source"] for r in base.table("documents").collect()) == ["a.md", "b.md"]


def test_meaning_and_vector_cache(spark, tmp_path):
    from corvane.functions.embedding import hashing_embedder

    base = KnowledgeBase(spark, str(tmp_path / "kb"), {"work": "documents/work"}, hashing_embedder(32))
    base.sync(frame(spark, DOCS), extract)
    assert base.table("chunk_vectors").count() == base.table("chunks").count()
    assert base.table("node_vectors").count() == base.table("nodes").count()
    hits, _, _ = base.search("Delta likes tea")
    assert "documents/home/notes.md" in {r["source"] for r in hits.collect()}
    assert base.search("Alpha storage", scope="work")[0].count() > 0
    before = {r["id"]: r["vector"] for r in base.table("chunk_vectors").collect()}
    base.embed = lambda text: F.array(F.raise_error(F.lit("asked again")).cast("float"))
    base.sync(frame(spark, {k: v for k, v in DOCS.items() if "notes" not in k}), extract)
    after = {r["id"]: r["vector"] for r in base.table("chunk_vectors").collect()}
    assert after.items() <= before.items() and 0 < len(after) < len(before)


def firms(chunks):
    """Upper-case phrases that end in CORP or LTD are nodes."""
    found = chunks.select(F.col("id").alias("chunk_id"), F.regexp_extract_all("text", F.lit("[A-Z]+ CORP(?: LTD)?"), 0).alias("names"))
    nodes = found.select("chunk_id", F.posexplode("names").alias("ord", "label")).select("chunk_id", "ord", F.col("ord").cast("string").alias("ref"), "label", F.lit("firm").alias("type"), F.lit(None).cast("string").alias("suggested_type"))
    return nodes, chunks.select(F.col("id").alias("chunk_id"), F.lit(0).alias("ord"), F.lit("0").alias("source_ref"), F.lit("1").alias("target_ref"), F.lit("with").alias("label")).limit(0)


def test_judge_and_taken_ids(spark, tmp_path):
    from corvane.functions.embedding import hashing_embedder

    asked = lambda node, options: (options[0]["id"], 0.9 if node["label"] == "ZEPHYR CORP LTD" else 0.1)
    base = KnowledgeBase(spark, str(tmp_path / "kb"), embed=hashing_embedder(256), judge=asked)
    base.sync(frame(spark, {"a.md": "# A\n\nZEPHYR CORP and ORBIT CORP.", "b.md": "# B\n\nZEPHYR CORP."}), firms)
    base.merge(frame(spark, {"c.md": "# C\n\nZEPHYR CORP LTD, ORBIT CORP LTD."}), firms)
    nodes = {r["label"]: r for r in base.table("nodes").collect()}
    assert sorted(nodes) == ["ORBIT CORP", "ORBIT CORP LTD", "ZEPHYR CORP"] and len(nodes["ZEPHYR CORP"]["chunk_ids"]) == 3
    # a.md no longer names it, others do: its id stays theirs, and a new node in its place gets another
    base.merge(frame(spark, {"a.md": "# A\n\nQUARTZ CORP."}), firms)
    ids = {r["label"]: r["id"] for r in base.table("nodes").collect()}
    assert sorted(ids) == ["ORBIT CORP LTD", "QUARTZ CORP", "ZEPHYR CORP"]
    assert ids["ZEPHYR CORP"] == nodes["ZEPHYR CORP"]["id"] and ids["QUARTZ CORP"] == ids["ZEPHYR CORP"] + "::0002"
