"""Exclusive commits, cached extraction, promoted types, rebuilds, node texts, lookups, tails, numbered lines."""

import base64
import hashlib
import json
import random
import re
import threading

import pytest
from pyspark.sql import functions as F

from corvane.operators import chunking, extraction, graph_views, relationships, resolution, taxonomy
from corvane.session import KnowledgeBase
from corvane.sources import files
from corvane.sources.snapshots import Conflict, SnapshotStore

NODES = "id string, label string, type string, suggested_type string, aliases array<string>, properties string, chunk_ids array<string>"
EDGES = "id string, source string, target string, label string, properties string, chunk_ids array<string>"


def test_of_two_racing_writers_one_wins_and_the_other_reads_again(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "s"))
    store.commit(t=spark.createDataFrame([(0,)], "x int"))
    both, results = threading.Barrier(2), []

    def add(x):
        first = True

        def make():
            nonlocal first
            rows = SnapshotStore(spark, store.folder).read("t").unionByName(spark.createDataFrame([(x,)], "x int"))
            if first:  # both have read version 1 before either commits
                first = False
                both.wait(60)
            return {"t": rows}

        results.append(SnapshotStore(spark, store.folder).update(make))

    threads = [threading.Thread(target=add, args=(x,)) for x in (1, 2)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert sorted(results) == [2, 3] and sorted(r["x"] for r in store.read("t").collect()) == [0, 1, 2]
    with pytest.raises(Conflict):
        store.commit(expected=2, t=spark.createDataFrame([(9,)], "x int"))
    assert store.current()[0] == 3
    # the loser's folder went at once, one of a writer that died goes with the sweep
    staged = {p.name for p in (tmp_path / "s").iterdir() if p.name.startswith("v")}
    assert len(staged) == 3
    (tmp_path / "s" / "v00000009-dead" / "t").mkdir(parents=True)
    assert store.sweep() == [] and store.sweep(0) == ["v00000009-dead"]
    assert store.read("t").count() == 3


def test_tables_laid_out_by_source_are_read_by_few_files(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "s"))
    rows = spark.createDataFrame([(f"s{i % 40}", f"c{i}", i) for i in range(400)], "source string, id string, index int")
    store.commit(["chunks"], chunks=rows, empty=rows.limit(0))
    assert store.read("empty").count() == 0 and store.read("chunks").columns == ["source", "id", "index"]
    some = store.read("chunks", ["s3", "s7", "missing"])
    assert sorted(r["index"] for r in some.collect()) == sorted(i for i in range(400) if i % 40 in (3, 7))
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[(isnotnull\(part#\d+\), )?part#\d+ (IN|=)", plan) or re.search(r"PartitionFilters: \[[^]]*part#\d+ IN \(", plan), plan
    asked = spark.createDataFrame([(0, "s3", "c43"), (1, "s7", "c47"), (2, "s3", "c43"), (3, "s3", "c47"), (4, "s9", "none")], "ord int, source string, id string")
    found = chunking.by_ids(store.read("chunks", ["s3", "s7"]), asked).orderBy("ord").collect()
    assert [(r["ord"], r["id"]) for r in found] == [(0, "c43"), (1, "c47"), (2, "c43")]


DOCS = {"a.md": "# One\n\nAlpha uses Beta.", "b.md": "# Two\n\nBeta needs Gamma.", "c.md": "# One\n\nAlpha uses Beta."}


def frame(spark, docs):
    return spark.createDataFrame(list(docs.items()), "source string, markdown string")


def asking(path, broken=0):
    """A model that finds the capitalised words, notes every call and first answers ``broken`` calls badly."""

    def ask(heading, text):
        with open(path, "a") as out:
            out.write("call\n")
        if sum(1 for _ in open(path)) <= broken:
            return {"nodes": [{"ref": "x"}], "edges": []}
        names = [w.strip(".") for line in text.splitlines() if not line.startswith("#") for w in line.split() if w[0].isupper()]
        nodes = [{"ref": str(i), "label": n, "type": "unclassified", "suggested_type": "Greek Letter"} for i, n in enumerate(names)]
        edges = [{"source_ref": str(i), "target_ref": str(i + 1), "label": "uses"} for i in range(len(names) - 1)] + [{"source_ref": "0", "target_ref": "none", "label": "lost"}]
        return {"nodes": nodes, "edges": edges}

    return extraction.CachedExtractor(ask, "model-1")


def calls(path):
    return sum(1 for _ in open(path)) if path.exists() else 0


def content(base):
    labels = {r["id"]: r["label"] for r in base.table("nodes").collect()}
    nodes = {(r["label"], r["type"], tuple(sorted(r["chunk_ids"]))) for r in base.table("nodes").collect()}
    return nodes, {(labels[r["source"]], r["label"], labels[r["target"]], tuple(sorted(r["chunk_ids"]))) for r in base.table("edges").collect()}


def test_sync_asks_once_for_each_content_and_keeps_answers_with_the_version(spark, tmp_path, monkeypatch):
    log = tmp_path / "calls"
    base = KnowledgeBase(spark, str(tmp_path / "kb"))
    base.sync(frame(spark, DOCS), asking(log))
    assert calls(log) == 2  # equal chunks of two sources are one request
    assert base.table("extractions").count() == 3
    assert {(r["source"], tuple(r["missing"])) for r in base.table("dropped_edges").collect()} == {(s, ("target",)) for s in DOCS}
    after = {**DOCS, "d.md": DOCS["b.md"], "e.md": "# New\n\nDelta alone."}
    version = base.store.current()[0]
    # a failure after the model has answered leaves the stored answers as they were
    monkeypatch.setattr(resolution, "name_matches", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        base.sync(frame(spark, after), asking(log))
    assert base.store.current()[0] == version and base.table("extractions").count() == 3
    monkeypatch.undo()
    before = calls(log)
    base.sync(frame(spark, after), asking(log))
    assert calls(log) == before + 1  # only the new text
    # a rebuild asks nothing and says the same as the increments, and as a new base
    one = content(base)
    now = calls(log)
    base.rebuild(frame(spark, after), asking(log))
    assert calls(log) == now and content(base) == one


def test_invalid_answers_are_asked_for_once_more(spark, tmp_path):
    doc = frame(spark, {"a.md": "# One\n\nAlpha uses Beta."})
    base = KnowledgeBase(spark, str(tmp_path / "kb"))
    base.sync(doc, asking(tmp_path / "one", broken=1))
    assert calls(tmp_path / "one") == 2 and base.table("nodes").count() == 2
    other = KnowledgeBase(spark, str(tmp_path / "other"))
    with pytest.raises(Exception, match="InvalidOutput"):
        other.sync(doc, asking(tmp_path / "two", broken=2))
    assert not other.store.exists()
    for bad in ({}, {"nodes": [], "edges": [{"source_ref": 1}]}, {"nodes": [{"ref": 1, "label": "a", "type": "b"}], "edges": []}, [], None):
        with pytest.raises(extraction.InvalidOutput):
            extraction.checked(bad)


def test_frequent_suggestions_become_types_and_old_nodes_migrate(spark, tmp_path):
    base = KnowledgeBase(spark, str(tmp_path / "kb"), types=["organization"])
    base.sync(frame(spark, {"a.md": "# A\n\nAlpha uses Beta."}), asking(tmp_path / "log"))
    assert {r["type"] for r in base.table("nodes").collect()} == {"unclassified"} and base.table("promotions").count() == 0
    base.merge(frame(spark, {"b.md": "# B\n\nGamma uses Delta and Epsilon."}), asking(tmp_path / "log"))
    assert sorted(r["type"] for r in base.table("registry").collect()) == ["greek_letter", "organization"]
    nodes = base.table("nodes").collect()
    assert {(r["type"], r["suggested_type"]) for r in nodes} == {("greek_letter", None)} and len(nodes) == 5
    [promotion] = base.table("promotions").collect()
    assert promotion["reason"] == "Appeared in 5 nodes across 2 source documents." and promotion["matched_suggestions"] == ["Greek Letter"] and promotion["version"] == 2
    affected = {r["node"] for r in base.table("promoted_nodes").collect()}
    assert len(affected) == 5 and {a.split(":")[0] for a in affected} == {"a.md", "b.md"}
    base.merge(frame(spark, {"c.md": "# C\n\nZeta alone."}), asking(tmp_path / "log"))  # known by now: not promoted again
    assert base.table("promotions").count() == 1
    assert {r["type"] for r in base.table("nodes").collect()} == {"greek_letter"}


def test_taxonomy_counts_are_thresholds(spark):
    rows = [(f"n{i}", "x", "unclassified" if i else "kept", "Same Type", f"s{i % k}", ["c"]) for k in (1, 2) for i in range(5)]
    for part, promoted in ((rows[:5], 0), (rows[5:9], 0), (rows[5:], 1)):
        nodes = spark.createDataFrame(part, "id string, label string, type string, suggested_type string, source string, chunk_ids array<string>")
        registry, moved, audit, affected = taxonomy.evolve(spark.createDataFrame([("a",)], "type string"), taxonomy.suggestions(nodes), nodes)
        assert (registry.count() - 1, audit.count()) == (promoted, promoted)
        assert affected.count() == moved.filter("migrated").count() == (4 if promoted else 0)


def plain_texts(nodes, edges):
    lines = {n[0]: [] for n in nodes}
    known = {n[0]: n for n in nodes}
    for e in sorted(edges):
        if e[1] in known and e[2] in known:
            lines[e[1]].append(f"outgoing {e[3]} to {known[e[2]][1]} ({known[e[2]][2]})")
            lines[e[2]].append(f"incoming {e[3]} from {known[e[1]][1]} ({known[e[1]][2]})")
    out = {}
    for id_, label, kind, suggested, aliases, properties, _ in nodes:
        parts = [f"label: {label}", f"type: {kind}"] + [f"suggested_type: {suggested}"] * bool(suggested) + [f"aliases: {', '.join(aliases)}"] * bool(aliases)
        parts += [f"properties: {properties}"] * bool(properties) + [f"relationships: {'; '.join(dict.fromkeys(lines[id_]))}"] * bool(lines[id_])
        out[id_] = "\n".join(parts)
    return out


def test_node_texts_and_which_of_them_a_change_makes_stale(spark):
    rng = random.Random(4)

    def graph():
        nodes = [(f"n{i}", rng.choice(["A", "B"]), rng.choice(["t", "u"]), rng.choice([None, "", "s"]), rng.choice([[], ["x", "y"]]), rng.choice([None, '{"k": 1}']), []) for i in range(12)]
        edges = [(f"e{i:02d}", f"n{rng.randrange(13)}", f"n{rng.randrange(12)}", rng.choice("pq"), None, []) for i in range(14)]
        return nodes, edges

    for _ in range(3):
        nodes, edges = graph()
        after_nodes = [n if rng.random() < 0.8 else (n[0], n[1] + "!", *n[2:]) for n in nodes if rng.random() < 0.95]
        after_edges = [e if rng.random() < 0.9 else (*e[:3], "r", *e[4:]) for e in edges if rng.random() < 0.9]
        frames = [spark.createDataFrame(rows, kinds) for rows, kinds in ((nodes, NODES), (edges, EDGES), (after_nodes, NODES), (after_edges, EDGES))]
        before, after = plain_texts(nodes, edges), plain_texts(after_nodes, after_edges)
        assert {r["id"]: r["text"] for r in relationships.node_texts(*frames[2:]).collect()} == after
        stale = {r["id"] for r in relationships.stale(*frames).collect()}
        assert {i for i in after if after[i] != before.get(i)} <= stale <= set(after)
        # nothing far from a change is stale
        touched = {n[0] for n in nodes if n not in after_nodes} | {n[0] for n in after_nodes if n not in nodes}
        ends = {x for e in edges + after_edges if (e not in edges or e not in after_edges) or {e[1], e[2]} & touched for x in (e[1], e[2])}
        assert stale <= touched | ends


def test_vectors_are_made_again_only_for_changed_texts(spark, tmp_path):
    from corvane.functions.embedding import hashing_embedder

    base = KnowledgeBase(spark, str(tmp_path / "kb"), embed=hashing_embedder(8))
    base.sync(frame(spark, DOCS), asking(tmp_path / "log"))
    labels = {r["id"]: r["label"] for r in base.table("nodes").collect()}
    one = {labels[r["id"]]: r["embedding_input_hash"] for r in base.table("node_vectors").collect()}
    base.merge(frame(spark, {"d.md": "# D\n\nGamma uses Omega."}), asking(tmp_path / "log"))
    nodes, edges = base.table("nodes"), base.table("edges")
    labels = {r["id"]: r["label"] for r in nodes.collect()}
    two = {labels[r["id"]]: r["embedding_input_hash"] for r in base.table("node_vectors").collect()}
    assert set(two) == {"Alpha", "Beta", "Gamma", "Omega"} and {n for n in one if one[n] != two[n]} == {"Gamma"}
    want = {r["id"]: r["h"] for r in relationships.node_texts(nodes, edges).select("id", F.sha2(F.col("text").cast("binary"), 256).alias("h")).collect()}
    assert want == {r["id"]: r["embedding_input_hash"] for r in base.table("node_vectors").collect()}


def test_same_contribution_names_the_canonical_node(spark):
    known = spark.createDataFrame([("k1", "s", "h", "n1"), ("k2", "s", "h2", "n2"), ("k3", "t", "h", "n1")], "canonical_node_id string, source string, content_hash string, node_id string")
    rows = spark.createDataFrame([("n1", "s", "h"), ("n2", "s", "h"), ("n1", "u", "h")], "id string, source string, content_hash string")
    assert [(r["id"], r["match"]) for r in resolution.same_contribution(rows, known).collect()] == [("n1", "k1")]


def test_edge_sets_take_the_next_free_numbers(spark):
    stored = [("edge-0002", "a", "b", "p", "1", ["c1"]), ("edge-0003", "b", "c", "p", None, None), ("own", "c", "d", "p", None, ["c2"])]
    incoming = [(1, "a", "b", "p", "9", ["c1", "c3"]), (2, "x", "y", "p", "2", ["c4"]), (3, "y", "z", "p", None, []), (4, "x", "y", "p", "3", ["c5", "c4"]), (5, "a", "b", "p", None, ["c6"])]
    got = graph_views.merge_edge_sets(spark.createDataFrame(stored, EDGES), spark.createDataFrame(incoming, "ord int, source string, target string, label string, properties string, chunk_ids array<string>"))
    assert {r["id"]: (r["source"], r["target"], r["properties"], r["chunk_ids"]) for r in got.collect()} == {
        "edge-0002": ("a", "b", "1", ["c1", "c3", "c6"]), "edge-0003": ("b", "c", None, []), "own": ("c", "d", None, ["c2"]),
        "edge-0001": ("x", "y", "2", ["c4", "c5"]), "edge-0004": ("y", "z", None, []),
    }


@pytest.mark.parametrize("seed", range(4))
def test_free_numbers_against_a_plain_model(spark, seed):
    """Gaps before the largest taken number are filled in order, then the numbers run on; rows that are ranked do not move again."""
    rng = random.Random(seed)
    used = rng.sample(range(40), rng.choice([0, 5, 20])) + rng.choice([[], [5_000_000_000]])
    n = rng.choice([0, 3, 30])
    rows = spark.createDataFrame([(i, f"row {i}") for i in rng.sample(range(1000), n)], "ord int, name string")
    ids = [f"edge-{u:04d}" for u in used] + ["edge-7", "own", "edge-" + "9" * 30]
    got = graph_views.numbered(rows, spark.createDataFrame([(i,) for i in ids], "id string"))
    free = [i for i in range(1, 100) if i not in used]
    want = {o: f"edge-{free[k]:04d}" for k, o in enumerate(sorted(r["ord"] for r in rows.collect()))}
    assert {r["ord"]: r["id"] for r in got.collect()} == want


def test_ranked_rows_move_once(spark):
    from corvane.operators.ranking import global_rank

    plan = global_rank(spark.range(100), F.desc("id"))._jdf.queryExecution().sparkPlan().toString()
    assert "Window" not in plan and "hashpartitioning" not in plan


def test_known_edges_meet_stored_ones_alone(spark):
    stored = spark.createDataFrame([("edge-0001", "a", "b", "p", None, ["c1"])], EDGES)
    incoming = spark.createDataFrame([(1, "a", "b", "p", None, ["c2"]), (2, "x", "y", "p", None, ["c3"])], "ord int, source string, target string, label string, properties string, chunk_ids array<string>")
    plan = graph_views.merge_edge_sets(stored, incoming)._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan


@pytest.mark.parametrize("size", [1, 3, 7, 500])
def test_rolling_tail_is_the_end_of_all_before(spark, size):
    rng = random.Random(size)
    rows = [(f"s{i % 3}", i, rng.choice([None, "", "é", "ab", "long text " * 3, "x" * 40])) for i in range(90)]
    got = {r["ord"]: r["tail"] for r in chunking.rolling_tail(spark.createDataFrame(rows, "source string, ord int, text string"), size).collect()}
    assert got == {i: "".join(t or "" for s, j, t in rows if s == source and j < i)[-size:] for source, i, _ in rows}


def test_page_ranges(spark):
    rows = [("a", None, None), ("b", 1, 1), ("c", 1, None), ("d", 0, 3), ("e", 3, 2), ("f", None, 2)]
    chunks = spark.createDataFrame(rows, "id string, page_start int, page_end int")
    assert {r["id"]: r["problem"] for r in chunking.page_range_violations(chunks).collect()} == {"c": "one end alone", "d": "first page below 1", "e": "end before start", "f": "one end alone"}
    with pytest.raises(ValueError, match="page"):
        chunking.validate_page_ranges(chunks)
    chunking.validate_page_ranges(chunks.limit(2))


def test_bad_lines_are_named_in_split_files(spark, tmp_path):
    good = {"id": "1", "source": "s", "chunk": 1, "original": "a", "replacement": "b", "context": "c", "decision": "accept", "reviewed": True}
    lines = [json.dumps({**good, "id": str(i)}) for i in range(3000)]
    (tmp_path / "x.jsonl").write_text("\n".join([*lines[:2000], "", *lines[2000:]]) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40k")
    try:
        assert spark.read.text(str(tmp_path / "x.jsonl")).rdd.getNumPartitions() > 3
        numbered = {r["line"]: r["value"] for r in files.numbered_lines(spark, str(tmp_path / "x.jsonl")).collect()}
        assert numbered == dict(enumerate([*lines[:2000], "", *lines[2000:]], 1))
        assert files.read_corrections(spark, str(tmp_path / "x.jsonl")).count() == 3000
        (tmp_path / "y.jsonl").write_text("\n".join([*lines[:2500], "{broken", *lines[2500:], "also"]) + "\n")
        with pytest.raises(ValueError, match="line 2501"):
            files.read_corrections(spark, str(tmp_path / "y.jsonl"))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_chunks_by_the_tokens_of_a_public_vocabulary(spark):
    public = pytest.importorskip("public_tokenizers")
    tiktoken = pytest.importorskip("tiktoken")
    tokens = chunking.RankTokens(public.path("byte_bpe_50k.tiktoken"), public.PATTERN)
    text = "Élan vital, naïve 漢字 🙂 words-and-marks!? 12345 supercalifragilistic\n\n\tend"
    spans = tokens.spans(text)
    assert all(a < b for a, b in spans) and [text[a:b] for a, b in spans if text[a:b].strip() != text[a:b]] == []
    assert "".join(text[a:b] for a, b in spans) == "".join(text.split())
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(tokens.path, "rb"))}
    model = tiktoken.Encoding("m", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
    plain = "the quick brown fox jumps over supercalifragilistic dogs"
    assert tokens.count(plain) == len(model.encode_ordinary(" " + plain))
    long = " ".join(random.Random(1).choices(["alpha", "supercalifragilistic", "naïveté", "x"], k=900))
    docs = spark.createDataFrame([("a.md", f"# H\n\n{long}")], "source string, markdown string")
    got = chunking.chunk_documents(docs, 50, 100, tokens).orderBy("index").collect()
    assert " ".join(r["text"] for r in got).split() == f"# H {long}".split() and len(got) > 10
    assert all(len(model.encode_ordinary(" " + " ".join(r["text"].split()))) <= 100 for r in got)


def test_lookups_document_graphs_export_and_command_line(spark, tmp_path, capsys, monkeypatch):
    from corvane import __main__ as command

    base = KnowledgeBase(spark, str(tmp_path / "kb"))
    (tmp_path / "docs").mkdir()
    for name, text in DOCS.items():
        (tmp_path / "docs" / name).write_text(text)
    module = type("module", (), {"extractor": asking(tmp_path / "log")})
    monkeypatch.setattr(command.importlib, "import_module", lambda name: module)
    command.main(["sync", str(tmp_path / "kb"), str(tmp_path / "docs"), "--extractor", "own.module:extractor"])
    assert capsys.readouterr().out == "added: 3\n"
    ids = [r["id"] for r in base.table("chunks").filter("source = 'b.md'").collect()]
    assert [r["id"] for r in base.lookup("b.md", ["none", *ids, *ids]).collect()] == ids * 2
    nodes, edges = base.document_graph("b.md")
    assert {r["label"] for r in nodes.collect()} == {"Beta", "Gamma"} and edges.count() == 1
    with pytest.raises(ValueError, match="unknown sources: z.md"):
        base.document_graph("z.md")
    for query, top in (("  ", 5), ("Beta", 0)):
        with pytest.raises(ValueError):
            base.find_documents(query, top=top)
    command.main(["documents", str(tmp_path / "kb"), "Gamma"])
    assert capsys.readouterr().out.split()[0] == "b.md"
    command.main(["export", str(tmp_path / "kb"), str(tmp_path / "out")])
    assert {p.name for p in (tmp_path / "out" / "sources").iterdir() if p.is_dir()} == {f"source={s}" for s in DOCS}
    assert spark.read.json(str(tmp_path / "out" / "all" / "nodes")).count() == 3


def test_context_prompts_and_terms(spark, tmp_path):
    from corvane.operators import transcripts

    rows = spark.createDataFrame([("s", 0, "abc"), ("s", 1, "x" * 600), ("s", 2, None), ("t", 0, "q")], "source string, index int, text string")
    got = {(r["source"], r["index"]): r["prompt"] for r in transcripts.context_prompts(rows).collect()}
    assert got == {("s", 0): None, ("s", 1): "Transcribed before:\nabc", ("s", 2): "Transcribed before:\n" + "x" * 500, ("t", 0): None}
    told = transcripts.context_prompts(rows, ["Ada", "Zoë"]).filter("index = 1").first()["prompt"]
    assert told.split("\n\n") == ["Names and spellings to expect, where they match what is said:\n- Ada\n- Zoë", "Transcribed before:\nabc"]
    (tmp_path / "g.json").write_text(json.dumps({"terms": [" Ada ", "Zoë"]}))
    assert files.read_terms(spark, str(tmp_path / "g.json")) == ["Ada", "Zoë"] and files.read_terms(spark, str(tmp_path / "none.json")) == []
    (tmp_path / "b.json").write_text(json.dumps({"terms": ["a", " "]}))
    with pytest.raises(ValueError, match="empty term"):
        files.read_terms(spark, str(tmp_path / "b.json"))


def test_cached_vectors_against_a_plain_model(spark):
    """Nulls, ids that repeat, cached rows that repeat or lack a vector; every text that is nowhere is embedded once."""
    from corvane.operators import sync

    asked = spark.sparkContext.accumulator(0)

    @F.udf("array<double>")
    def embed(text):
        asked.add(1)
        return [float(len(text))]

    h = lambda t: None if t is None else hashlib.sha256(t.encode()).hexdigest()
    inputs = [("a", "one"), ("a", "two"), ("b", "one"), ("b", "one"), ("c", "new"), ("d", "new"), (None, "new"), (None, "one"), ("e", None), ("f", ""), ("g", "bare"), ("a", None)]
    cache = [("a", "m", "one", [1.0]), ("a", "m", "one", [2.0]), ("z", "m", "one", [9.0]), ("c", "other", "new", [7.0]), ("y", "m", "two", [3.0]), ("x", "m", "two", [4.0]), ("e", "m", None, [5.0]), (None, "m", "", [6.0]), ("g", "m", "bare", None)]
    stored = spark.createDataFrame([(i, m, h(t), v) for i, m, t, v in cache], "id string, embedding_model string, embedding_input_hash string, vector array<float>")
    got = sync.cached_vectors(spark.createDataFrame(inputs, "id string, text string"), stored, "m", embed)
    want = []
    for i, t in inputs:
        mine = [c for c in cache if c[1] == "m" and t is not None and c[2] == t]
        same = min(((c[0], c[3]) for c in mine if c[0] is not None), key=lambda x: x[0], default=(None, None))[1]
        for own in [c[3] for c in mine if i is not None and c[0] == i] or [None]:
            want.append((i, "m", h(t), own or same or (None if t is None else [float(len(t))])))
    # of one id's vectors any may stand for the same text elsewhere
    rows = [(*r[:3], [1.0] if r[0] != "a" and r["vector"] == [2.0] else r["vector"]) for r in got.collect()]
    assert sorted(rows, key=str) == sorted(want, key=str) and asked.value == 3  # "new", "" and "bare"


def test_embedding_cache_lookup_reads_texts_for_hashes_and_for_what_is_missing(spark, tmp_path):
    """Twice in all, beside the cache, which is written once; rows and ids that repeat keep their number."""
    from corvane.plans import knowledge_queries

    docs = [(i, f"text {i % 7}") for i in range(30)] + [(3, "text 3"), (3, "other"), (None, "text 1"), (31, None), (33, None), (32, "")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = knowledge_queries.embedding_cache_lookup(spark, str(tmp_path))
    assert got._jdf.queryExecution().sparkPlan().toString().count("text:string") == 2
    cached = [(i, t) for i, t in docs if i is not None and i % 3 == 0]
    want = []
    for i, t in docs:
        times = max(1, sum(c == (i, t) for c in cached if t is not None)) * max(1, sum(c[0] == i for c in cached))
        row = (None if i is None else str(i), None if t is None else float(len(t)), any(c[0] == i for c in cached), t is not None and any(c[1] == t for c in cached))
        want += [row] * times
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
