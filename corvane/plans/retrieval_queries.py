"""Queries over chunks, documents and the graph: ranking, paths, fusion, catalogue, references."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.functions import scoring
from corvane.functions.text import in_folder, source_key
from corvane.operators import bm25, chunk_search, chunking, context, document_search, hybrid, paths, ranking, references, resolution
from corvane.plans import corpora, sql
from corvane.plans.corpora import C_CHUNKS, C_EDGES, C_NODES, table
from corvane.sources.export import viewer_nodes
from corvane.sources.shared import materialise

QUERY = "the and of the world with tion"
GRAPH_QUERY = "which red widget does nation 3 get from supplier 000000007"
QUERIES, ORACLES = {}, {}


def query(name: str, oracle: str | None = None):
    """Register a query and the SQL that repeats it."""

    def put(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return put


def r9(c: str):
    return F.round(F.col(c), 9).alias(c)


@query("bm25_rank", "WITH " + sql.bm25_ctes("b", "documents", "doc_id", "text", QUERY) + "SELECT key AS doc_id, round(score, 9) AS score, row_number() OVER (ORDER BY round(score, 9) DESC, key)::BIGINT AS rank FROM b")
def bm25_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = bm25.bm25_scores(docs, QUERY, {"score": F.col("text")}, keep=["doc_id"]).select("doc_id", r9("score"))
    return ranking.global_rank(scored, F.desc("score"), F.col("doc_id"))


@query("bm25_calibrated", "WITH " + sql.bm25_ctes("b", "documents", "doc_id", "text", QUERY) + f"SELECT key AS doc_id, round({sql.calibrated('score')}, 9) AS score FROM b WHERE score > 0")
def bm25_calibrated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25.calibrated(table(spark, sf_dir, "documents").select("doc_id", "text"), QUERY, F.col("text")).select("doc_id", r9("score"))


@query("bm25_scoped", "WITH " + C_CHUNKS + ", s AS (SELECT * FROM c_chunks WHERE starts_with(source, 'documents/en/')), " + sql.bm25_ctes("b", "s", "id", "text", QUERY) + "SELECT key AS id, round(score, 9) AS score FROM b")
def bm25_scoped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The folder restriction comes before the statistics."""
    rows = corpora.chunks(spark, sf_dir).filter(in_folder(F.col("source"), "documents/en")).select("id", "text")
    return bm25.bm25_scores(rows, QUERY, {"score": F.col("text")}).select("id", r9("score"))


def annotated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpora.annotated(spark, sf_dir)


def search_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_search.search_rows(corpora.chunks(spark, sf_dir), corpora.nodes(spark, sf_dir), corpora.edges(spark, sf_dir))


_UNIQUE = "list_filter(x, lambda v, i: trim(regexp_replace(lower(v), '\\s+', ' ', 'g')) <> '' AND list_position(list_transform(x, lambda u: trim(regexp_replace(lower(u), '\\s+', ' ', 'g'))), trim(regexp_replace(lower(v), '\\s+', ' ', 'g'))) = i)"
C_FIELDS = (
    C_NODES
    + ","
    + C_EDGES
    + """,
an AS (SELECT chunk_id, list(n ORDER BY n.id) AS ns FROM (SELECT unnest(chunk_ids) AS chunk_id, n FROM c_nodes n) GROUP BY chunk_id),
ae AS (SELECT chunk_id, list(e ORDER BY e.id) AS es FROM (SELECT unnest(chunk_ids) AS chunk_id, e FROM c_edges e
       WHERE e.source IN (SELECT id FROM c_nodes) AND e.target IN (SELECT id FROM c_nodes)) GROUP BY chunk_id),
c_fields AS (SELECT c.*, coalesce(list_transform(ns, lambda n: n.label), []) AS f_labels, coalesce(flatten(list_transform(ns, lambda n: n.aliases)), []) AS f_aliases,
  list_concat([source, split_part(source, '/', 3), regexp_replace(split_part(source, '/', 3), '\\.md$', '')], heading_path, coalesce(list_transform(ns, lambda n: n.type), []),
    coalesce(list_filter(list_transform(ns, lambda n: n.suggested_type), lambda v: v IS NOT NULL), []), coalesce(list_filter(list_transform(ns, lambda n: n.properties), lambda v: v IS NOT NULL), []),
    coalesce(list_transform(es, lambda e: e.label), [])) AS f_metadata
  FROM c_chunks c LEFT JOIN an ON an.chunk_id = c.id LEFT JOIN ae ON ae.chunk_id = c.id),
c_texts AS (SELECT id, index, text AS content, """
    + ", ".join(f"(SELECT array_to_string({_UNIQUE}, chr(10)) FROM (SELECT f_{n} AS x)) AS {n}" for n in ("labels", "aliases", "metadata"))
    + " FROM c_fields)"
)
C_SCORES = C_FIELDS.replace("\\\\", "\\")


def score_ctes(q: str) -> str:
    """CTEs that end in c_scores(id, index, score)."""
    names = ("labels", "aliases", "content", "metadata")
    each = "".join("," + sql.bm25_ctes(f"b_{n}", "c_texts", "id", n, q) for n in names)
    score = sql.noisy_or([*((sql.calibrated(f"b_{n}.score"), chunk_search.WEIGHTS[n]) for n in names), ("0e0", 1.0)])
    joins = "".join(f" JOIN b_{n} ON b_{n}.key = c_texts.id" for n in names)
    return C_SCORES + each + f", c_scores AS (SELECT id, index, score FROM (SELECT c_texts.id, c_texts.index, {score} AS score FROM c_texts{joins}) WHERE score > 0)"


@query("chunk_search_fields", "WITH " + C_SCORES + " SELECT id, labels, aliases, metadata FROM c_texts")
def chunk_search_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search_rows(spark, sf_dir).select("id", "labels", "aliases", "metadata")


@query("multi_field_score", "WITH " + score_ctes(GRAPH_QUERY) + " SELECT id, index::BIGINT AS index, round(score, 9) AS score FROM c_scores")
def multi_field_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = chunk_search.chunk_scores(search_rows(spark, sf_dir), GRAPH_QUERY)
    return scored.select("id", F.col("index").cast("long").alias("index"), r9("score"))


@query("chunk_top_k", "WITH " + score_ctes(GRAPH_QUERY) + " SELECT id, round(score, 9) AS score FROM c_scores ORDER BY c_scores.score DESC, index, id LIMIT 10")
def chunk_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = chunk_search.chunk_scores(search_rows(spark, sf_dir), GRAPH_QUERY)
    return chunk_search.top_chunks(scored, 10).select("id", r9("score"))


@query("chunk_annotations", "WITH " + C_SCORES + " SELECT c.id, len(coalesce(ns, []))::BIGINT AS n_nodes, len(coalesce(es, []))::BIGINT AS n_edges, coalesce(array_to_string(list_transform(ns, lambda n: n.id), ','), '') AS node_ids FROM c_chunks c LEFT JOIN an ON an.chunk_id = c.id LEFT JOIN ae ON ae.chunk_id = c.id")
def chunk_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = annotated(spark, sf_dir)
    return rows.select("id", F.size("nodes").cast("long").alias("n_nodes"), F.size("edges").cast("long").alias("n_edges"), F.array_join(F.transform("nodes", lambda n: n["id"]), ",").alias("node_ids"))


@query("noisy_or", "SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, round(" + sql.noisy_or([("l_discount", 2.0), ("l_tax", 1.5), ("least(l_quantity / 100, 1)", 1.0)]) + ", 9) AS score FROM lineitem")
def noisy_or(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = scoring.noisy_or([(F.col("l_discount"), 2.0), (F.col("l_tax"), 1.5), (F.least(F.col("l_quantity") / 100, F.lit(1.0)), 1.0)])
    return table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), F.round(score, 9).alias("score"))


_COS = "list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"


@query("cosine_topk", f"SELECT query_id, vec_id, round(score, 9) AS score, rank::BIGINT AS rank FROM (SELECT a.vec_id AS query_id, b.vec_id, {_COS} AS score, row_number() OVER (PARTITION BY a.vec_id ORDER BY round({_COS}, 9) DESC, b.vec_id) AS rank FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0) WHERE rank <= 5")
def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every twentieth vector, the five nearest within their label, by matrix products of blocks. Vectors that are null or
    have null or NaN components take no part."""
    # ids as texts in the order of the numbers: ties go to the smaller one
    key = F.lpad(F.hex(F.col("vec_id").cast("long").bitwiseXOR(F.lit(-(1 << 63)).cast("long"))), 16, "0")
    vectors = table(spark, sf_dir, "embeddings").filter("label is not null")
    vectors = vectors.select("vec_id", key.alias("id"), F.concat(F.lit("label "), "label").alias("type"), F.col("embedding").alias("vector"))
    found = resolution.vector_candidates(vectors.filter("vec_id % 20 = 0"), vectors, 5, -2.0)
    number = lambda c: F.conv(c, 16, -10).cast("long").bitwiseXOR(F.lit(-(1 << 63)).cast("long"))
    return found.select(number("id").alias("query_id"), number("candidate").alias("vec_id"), F.col("similarity").alias("score"), F.col("rank").cast("long").alias("rank"))


@query("semantic_calibrated", f"SELECT b.vec_id, round(greatest(0e0, ({_COS} - 0.2e0) / (1e0 - 0.2e0)), 9) AS score FROM embeddings a, embeddings b WHERE a.vec_id = 0 AND {_COS} > 0.2e0")
def semantic_calibrated(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    asked = vectors.filter("vec_id = 0").select(F.col("embedding").alias("asked"))
    score = scoring.calibrate_similarity(scoring.cosine(F.col("asked"), F.col("embedding")), 0.2)
    return vectors.crossJoin(F.broadcast(asked)).select("vec_id", F.round(score, 9).alias("score")).filter("score > 0")


_SAID = "['which', 'red', 'widget', 'does', 'nation', '3', 'get', 'from', 'supplier', '000000007']"
MENTIONS = (
    C_NODES
    + f""",
nm AS (SELECT id, regexp_extract_all(lower(name), '[a-z0-9]+') AS t FROM (SELECT id, unnest(list_concat([label], aliases)) AS name FROM c_nodes)),
mt AS (SELECT id, s, len(t) AS l FROM (SELECT id, t, unnest(range(1, 11 - len(t) + 1)) AS s FROM nm WHERE len(t) BETWEEN 1 AND 10) WHERE list_slice({_SAID}, s, s + len(t) - 1) = t),
mentions AS (SELECT DISTINCT id, 0.9::DOUBLE AS mention FROM mt WHERE NOT EXISTS (SELECT 1 FROM mt o WHERE o.s <= mt.s AND mt.s + mt.l <= o.s + o.l AND o.l > mt.l))
"""
)


@query("mention_match", "WITH " + MENTIONS + " SELECT id, mention FROM mentions")
def mention_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths.mentioned(corpora.nodes(spark, sf_dir), GRAPH_QUERY)


SEED = (
    MENTIONS
    + """,
nt AS (SELECT *, concat_ws(chr(10), label, type, CASE WHEN len(aliases) > 0 THEN array_to_string(aliases, chr(10)) END, suggested_type, properties) AS st FROM c_nodes),
"""
    + sql.bm25_ctes("sl", "nt", "id", "label", GRAPH_QUERY)
    + ","
    + sql.bm25_ctes("sm", "nt", "id", "st", GRAPH_QUERY)
    + ", seed AS (SELECT nt.id, "
    + sql.noisy_or([(sql.calibrated("sl.score"), 2.0), ("mention", 2.0), (sql.calibrated("sm.score"), 1.0), ("0e0", 1.0)])
    + " AS score, coalesce(mention, 0e0) AS mention FROM nt JOIN sl ON sl.key = nt.id JOIN sm ON sm.key = nt.id LEFT JOIN mentions USING (id))"
)


@query("seed_nodes", "WITH " + SEED + " SELECT id, round(score, 9) AS score, mention FROM seed WHERE score > 0")
def seed_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths.seed_scores(corpora.nodes(spark, sf_dir), GRAPH_QUERY).filter("score > 0").select("id", r9("score"), "mention")


@query("adjacency", "WITH " + C_CHUNKS + "," + C_EDGES + " SELECT source AS node, id AS edge_id, target AS neighbour, true AS forward FROM c_edges UNION ALL SELECT target, id, source, false FROM c_edges WHERE source <> target")
def adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths.adjacency(corpora.edges(spark, sf_dir)).select("node", "edge_id", "neighbour", "forward")


_ADJ = ", adj AS (SELECT source AS node, id AS e, target AS nb FROM c_edges UNION ALL SELECT target, id, source FROM c_edges WHERE source <> target)"


@query(
    "paths_2hop_simple",
    "WITH " + C_CHUNKS + "," + C_EDGES + _ADJ + ", p AS (SELECT [a.node, a.nb, b.nb] AS ns, [a.e, b.e] AS es FROM adj a JOIN adj b ON a.nb = b.node WHERE a.node = 'nation:3' AND b.nb <> a.node AND b.nb <> a.nb"
    " UNION ALL SELECT [a.node, a.nb], [a.e] FROM adj a WHERE a.node = 'nation:3') SELECT array_to_string(ns, '>') AS nodes, array_to_string(es, '>') AS edges FROM p",
)
def paths_2hop_simple(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Simple paths of one and two edges from a node."""
    adj = paths.adjacency(corpora.edges(spark, sf_dir)).select("node", "edge_id", "neighbour")
    one = adj.filter("node = 'nation:3'").select(F.array("node", "neighbour").alias("ns"), F.array("edge_id").alias("es"))
    two = one.join(adj, F.element_at("ns", -1) == F.col("node")).filter(~F.array_contains("ns", F.col("neighbour")))
    two = two.select(F.concat("ns", F.array("neighbour")).alias("ns"), F.concat("es", F.array("edge_id")).alias("es"))
    return one.unionByName(two).select(F.array_join("ns", ">").alias("nodes"), F.array_join("es", ">").alias("edges"))


def stored(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Chunks, nodes and edges as tables, as a knowledge base holds them: several steps read them."""
    return materialise(corpora.chunks(spark, sf_dir), "chunks"), materialise(corpora.nodes(spark, sf_dir), "nodes"), materialise(corpora.edges(spark, sf_dir), "edges")


@query("graph_paths")
def graph_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = paths.graph_paths(*stored(spark, sf_dir), GRAPH_QUERY)
    return found.select(F.array_join("node_ids", ">").alias("nodes"), F.array_join("edge_ids", ">").alias("edges"), F.array_join("chunk_ids", ",").alias("chunks"), r9("score"))


@query("rrf_fusion", "WITH " + sql.bm25_ctes("a", "documents", "doc_id", "text", "the and of") + "," + sql.bm25_ctes("b", "documents", "doc_id", "text", "with this that") + """,
ra AS (SELECT key, row_number() OVER (ORDER BY round(score, 9) DESC, key) AS rank FROM a WHERE score > 0 QUALIFY rank <= 15),
rb AS (SELECT key, row_number() OVER (ORDER BY round(score, 9) DESC, key) AS rank FROM b WHERE score > 0 QUALIFY rank <= 15)
SELECT key AS doc_id, round(sum(1e0 / (60 + rank)), 9) AS fused, min(rank)::BIGINT AS best_rank FROM (FROM ra UNION ALL FROM rb) GROUP BY key""")
def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = bm25.bm25_scores(docs, {"a": "the and of", "b": "with this that"}, {"score": F.col("text")}, keep=["doc_id"])

    def pool(q):
        own = scored.filter(F.col(f"score.{q}") > 0).select(F.col("doc_id").alias("id"), F.lit(0).alias("index"), F.round(f"score.{q}", 9).alias("score"))
        return own.orderBy(F.desc("score"), "id").limit(15)

    return hybrid.fuse(pool("a"), pool("b")).select(F.col("id").alias("doc_id"), r9("fused"), F.col("best_rank").cast("long").alias("best_rank"))


@query("hybrid_topk")
def hybrid_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits, _ = hybrid.retrieve(*stored(spark, sf_dir), GRAPH_QUERY)
    return hits.select("id", "source", "index", r9("score"), r9("relevance"))


C_CATALOG = C_CHUNKS + ", cat AS (SELECT source, regexp_replace(split_part(source, '/', 3), '\\.md$', '') AS title, any_value(array_to_string(heading_path, ' > ')) AS headings, count(*)::BIGINT AS chunk_count FROM c_chunks GROUP BY source)"


@query("document_catalog", "WITH " + C_CATALOG + " SELECT * FROM cat")
def document_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_search.catalog(corpora.chunks(spark, sf_dir)).withColumn("headings", F.array_join("headings", "|"))


_FIND = "what does src7 say of the world in en"


@query(
    "document_search",
    "WITH " + C_CATALOG + ", txt AS (SELECT *, concat_ws(chr(10), source, split_part(source, '/', 3), title, title, headings) AS doc FROM cat), "
    + sql.bm25_ctes("b", "txt", "source", "doc", _FIND)
    + ", mr AS (SELECT key AS source, row_number() OVER (ORDER BY score DESC, key) AS r FROM b WHERE score > 0), "
    + sql.bm25_ctes("p", "c_chunks", "id", "text", _FIND)
    + """, pr AS (SELECT source, min(r) AS r FROM (SELECT c.source, row_number() OVER (ORDER BY round(p.score, 9) DESC, c.id) AS r FROM p JOIN c_chunks c ON c.id = p.key WHERE p.score > 0) WHERE r <= 20 GROUP BY source)
SELECT source, title, headings, chunk_count, round(CASE WHEN contains('"""
    + _FIND
    + """', replace(split_part(source, '/', 3), '.', ' ')) OR contains('"""
    + _FIND
    + """', title) THEN 1e0 ELSE 0e0 END + coalesce(1e0 / (60 + mr.r), 0) + coalesce(1e0 / (60 + pr.r), 0), 9) AS score
FROM cat LEFT JOIN mr USING (source) LEFT JOIN pr USING (source) WHERE mr.r IS NOT NULL OR pr.r IS NOT NULL ORDER BY score DESC, source LIMIT 5""",
)
def documents_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = corpora.chunks(spark, sf_dir)
    hits = bm25.bm25_scores(chunks.select("id", "source", "text"), _FIND, {"score": F.col("text")}).filter("score > 0").select("id", "source", r9("score"))
    hits = hits.orderBy(F.desc("score"), "id").limit(20).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id")))
    found = document_search.search_documents(document_search.catalog(chunks), _FIND, hits)
    return found.select("source", "title", F.array_join("headings", "|").alias("headings"), "chunk_count", r9("score"))


@query("page_range_merge", "WITH " + C_CHUNKS + """, h AS (SELECT source, page_start AS s, page_end AS e, doc_id FROM c_chunks),
b AS (SELECT *, max(e) OVER w AS before FROM h WINDOW w AS (PARTITION BY source ORDER BY s, e, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
i AS (SELECT *, sum(CASE WHEN before IS NULL OR s > before + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY source ORDER BY s, e, doc_id ROWS UNBOUNDED PRECEDING) AS island FROM b)
SELECT source, min(s)::BIGINT AS page_start, max(e)::BIGINT AS page_end, source || ' (' || CASE WHEN min(s) = max(e) THEN 'p. ' || min(s) ELSE 'pp. ' || min(s) || '-' || max(e) END || ')' AS label FROM i GROUP BY source, island""")
def page_range_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = corpora.chunks(spark, sf_dir).select(F.col("doc_id").alias("ord"), "source", "page_start", "page_end")
    found = references.source_references(hits)
    return found.select("source", F.col("page_start").cast("long").alias("page_start"), F.col("page_end").cast("long").alias("page_end"), references.reference_label(F.col("source"), F.col("page_start"), F.col("page_end")).alias("label"))


@query("chunk_neighborhood", "WITH " + C_CHUNKS + " SELECT id, lag(id) OVER w AS previous, lead(id) OVER w AS next FROM c_chunks WINDOW w AS (PARTITION BY source ORDER BY index)")
def chunk_neighborhood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.neighbours(corpora.chunks(spark, sf_dir)).select("id", F.col("previous_id").alias("previous"), F.col("next_id").alias("next"))


_NODE_TEXT = "n.label || ' [' || n.type || ']' || CASE WHEN len(n.aliases) > 0 THEN ' | aliases: ' || array_to_string(n.aliases, ', ') ELSE '' END || coalesce(' | suggested type: ' || n.suggested_type, '') || coalesce(' | properties: ' || n.properties, '')"
_LINES = C_SCORES + f""", nl AS (SELECT chunk_id, list({_NODE_TEXT} ORDER BY n.id) AS lines FROM (SELECT unnest(chunk_ids) AS chunk_id, n FROM c_nodes n) GROUP BY chunk_id),
el AS (SELECT chunk_id, list(line ORDER BY id) AS lines FROM (SELECT e.chunk_ids[1] AS chunk_id, e.id, s.label || ' --' || e.label || '--> ' || t.label AS line FROM c_edges e JOIN c_nodes s ON s.id = e.source JOIN c_nodes t ON t.id = e.target) GROUP BY chunk_id)"""


@query("searchable_text", "WITH " + _LINES + """ SELECT c.id, concat_ws(chr(10), 'Source:' || chr(10) || source, 'Heading:' || chr(10) || array_to_string(heading_path, ' > '), 'Content:' || chr(10) || text,
'Entities:' || chr(10) || array_to_string(nl.lines, chr(10)), 'Relationships:' || chr(10) || array_to_string(el.lines, chr(10))) AS searchable FROM c_chunks c LEFT JOIN nl ON nl.chunk_id = c.id LEFT JOIN el ON el.chunk_id = c.id""")
def searchable_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_search.searchable_text(annotated(spark, sf_dir)).select("id", "searchable")


@query("context_blocks", "WITH " + _LINES + """ SELECT c.id, concat_ws(chr(10), '[' || c.id || ' | ' || source || ' | ' || CASE WHEN page_start = page_end THEN 'p. ' || page_start ELSE 'pp. ' || page_start || '-' || page_end END || ' | ' || array_to_string(heading_path, ' > ') || ']', text,
'Linked entities:' || chr(10) || '- ' || array_to_string(nl.lines, chr(10) || '- '), 'Linked relationships:' || chr(10) || '- ' || array_to_string(el.lines, chr(10) || '- ')) AS block FROM c_chunks c LEFT JOIN nl ON nl.chunk_id = c.id LEFT JOIN el ON el.chunk_id = c.id""")
def context_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.chunk_blocks(annotated(spark, sf_dir)).select("id", "block")


@query("viewer_nodes", "WITH " + C_NODES + """ SELECT id, label, type AS "group", '<b>id</b>: ' || id || '<br><b>type</b>: ' || type || '<br><b>suggested_type</b>: ' || coalesce(suggested_type, 'null') || '<br><b>chunk_ids</b>: [&quot;' || chunk_ids[1] || '&quot;]<br><b>properties</b>: ' || replace(coalesce(properties, '{}'), '"', '&quot;') AS title FROM c_nodes""")
def exported_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return viewer_nodes(corpora.nodes(spark, sf_dir))


def _edge_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every edge as a path from both of its ends, the seed's score from its name's length."""
    adj = paths.adjacency(corpora.edges(spark, sf_dir))
    return adj.select(F.array("node", "neighbour").alias("node_ids"), F.array("edge_id").alias("edge_ids"), F.char_length("node").cast("double").alias("seed_score"), "chunk_ids")


@query("path_dedupe", "WITH " + C_CHUNKS + "," + C_EDGES + " SELECT id AS edge, CASE WHEN length(source) > length(target) OR (length(source) = length(target) AND target > source) THEN source ELSE target END AS start FROM c_edges")
def path_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = paths.deduplicated(_edge_paths(spark, sf_dir))
    return kept.select(F.get("edge_ids", F.lit(0)).alias("edge"), F.get("node_ids", F.lit(0)).alias("start"))


@query("evidence_chunks", "WITH " + C_CHUNKS + "," + C_EDGES + " SELECT chunk_ids[1] AS id, max(greatest(length(source), length(target)))::DOUBLE AS score FROM c_edges GROUP BY 1")
def evidence_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _edge_paths(spark, sf_dir).withColumnRenamed("seed_score", "score")
    return paths.evidence_chunks(rows, corpora.chunks(spark, sf_dir)).select("id", "score")


@query("relevance_cut", "WITH " + score_ctes(GRAPH_QUERY) + " SELECT id, round(score, 9) AS score FROM c_scores WHERE score >= 0.05e0 ORDER BY c_scores.score DESC, index, id LIMIT 5")
def relevance_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = chunk_search.chunk_scores(search_rows(spark, sf_dir), GRAPH_QUERY)
    return chunk_search.top_chunks(scored.filter(F.col("score") >= hybrid.LEAST_RELEVANCE), 5).select("id", r9("score"))


@query("source_keys", "WITH " + C_CHUNKS + " SELECT DISTINCT source, regexp_replace(split_part(source, '/', 3), '\\.md$', '') || '-' || left(sha256(source), 8) AS key FROM c_chunks")
def source_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = corpora.chunks(spark, sf_dir).select("source").distinct()
    return rows.select("source", source_key(F.col("source")).alias("key"))
