"""Queries over the graph with provenance, incremental maintenance, resolution, extraction, types and ledgers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.functions.embedding import hashing_embedder
from corvane.functions.text import entity_key
from corvane.operators import chunking, extraction, graph_views, ledger, resolution, sync, taxonomy, transcripts
from corvane.plans import corpora, sql
from corvane.plans.corpora import C_CHUNKS, C_EDGES, C_NODES, table
from corvane.sources import messages
from corvane.sources.shared import materialise

QUERIES, ORACLES = {}, {}


def query(name: str, oracle: str | None = None):
    """Register a query and the SQL that repeats it."""

    def put(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return put


# Parts as contributions to shared nodes: every name is a node, every part with it a contribution.
def node_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    none = F.lit(None).cast("string")
    return p.select(
        F.concat(F.lit("name:"), "p_name").alias("canonical_node_id"), F.col("p_partkey").cast("int").alias("ord"), F.col("p_brand").alias("source"), none.alias("content_hash"),
        F.col("p_partkey").cast("string").alias("node_id"), F.when(F.col("p_partkey") % 3 == 0, F.upper("p_name")).when(F.col("p_partkey") % 5 == 0, F.concat("p_name", F.lit("s"))).otherwise(F.concat("p_name", F.lit(" "), F.col("p_size"))).alias("label"),
        F.when(F.col("p_size") > 40, F.lower("p_type")).otherwise("unclassified").alias("type"), F.when(F.col("p_size") < 10, F.col("p_type")).alias("suggested_type"),
        F.array("p_type", "p_brand").alias("aliases"), F.col("p_retailprice").cast("string").alias("properties"), F.array(F.concat(F.lit("c"), (F.col("p_partkey") % 7).cast("string"))).alias("chunk_ids"), F.array("p_type").alias("resolution_aliases"),
    )


def edge_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    target = F.concat(F.lit("name:"), "p_name")
    source = F.concat(F.lit("supplier:"), F.col("l_suppkey"))
    return lines.select(
        F.concat_ws("|", source, target).alias("canonical_edge_id"), ((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 100000 + F.col("l_partkey")).alias("ord"), F.col("p_brand").alias("source"), F.lit(None).cast("string").alias("content_hash"),
        F.col("l_orderkey").cast("string").alias("edge_id"), source.alias("source_node_id"), target.alias("target_node_id"), F.concat(F.lit("ships_"), F.lower("l_returnflag")).alias("label"),
        F.lit(None).cast("string").alias("properties"), F.array(F.concat(F.lit("c"), (F.col("l_orderkey") % 5).cast("string"))).alias("chunk_ids"),
    )


NP = """np AS (SELECT 'name:' || p_name AS id, p_partkey AS ord, p_brand AS source, CASE WHEN p_partkey % 3 = 0 THEN upper(p_name) WHEN p_partkey % 5 = 0 THEN p_name || 's' ELSE p_name || ' ' || p_size END AS label,
 CASE WHEN p_size > 40 THEN lower(p_type) ELSE 'unclassified' END AS type, CASE WHEN p_size < 10 THEN p_type END AS suggested, [p_type, p_brand] AS aliases, [p_type] AS more, p_retailprice AS price, 'c' || (p_partkey % 7) AS chunk FROM part)"""
EP = """ep AS (SELECT 'supplier:' || l_suppkey || '|name:' || p_name AS id, (l_orderkey * 10 + l_linenumber) * 100000 + l_partkey AS ord, p_brand AS source, 'supplier:' || l_suppkey AS s, 'name:' || p_name AS t, 'ships_' || lower(l_returnflag) AS label, 'c' || (l_orderkey % 5) AS chunk
 FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def node_sql(rows: str, out: str) -> str:
    key = sql.entity_key
    return f"""{out}_f AS (SELECT id, first(label ORDER BY ord) AS label, coalesce(first(type ORDER BY ord) FILTER (type <> 'unclassified'), first(type ORDER BY ord)) AS type, first(suggested ORDER BY ord) FILTER (suggested <> '') AS suggested_type FROM {rows} GROUP BY id),
{out}_a AS (SELECT r.id, r.ord, u.k, u.a FROM {rows} r JOIN {out}_f f USING (id), unnest(list_concat(CASE WHEN {key("r.label")} <> {key("f.label")} THEN [r.label] ELSE [] END, r.aliases, r.more)) WITH ORDINALITY AS u(a, k)),
{out}_k AS (SELECT a.id, {key("a.a")} AS key, arg_min(a.a, [a.ord, a.k]) AS a, min([a.ord, a.k]) AS pos FROM {out}_a a JOIN {out}_f f USING (id) WHERE {key("a.a")} <> '' AND {key("a.a")} <> {key("f.label")} GROUP BY a.id, {key("a.a")}),
{out}_n AS (SELECT id, string_agg(a, '|' ORDER BY pos) AS aliases FROM {out}_k GROUP BY id),
{out}_c AS (SELECT id, string_agg(chunk, '|' ORDER BY pos) AS chunks FROM (SELECT id, chunk, min(ord) AS pos FROM {rows} GROUP BY id, chunk) GROUP BY id),
{out} AS (SELECT f.id, label, type, suggested_type, coalesce(aliases, '') AS aliases, chunks FROM {out}_f f LEFT JOIN {out}_n USING (id) JOIN {out}_c USING (id))"""


def shown(nodes: DataFrame) -> DataFrame:
    return nodes.select("id", "label", "type", "suggested_type", F.array_join("aliases", "|").alias("aliases"), F.array_join("chunk_ids", "|").alias("chunks"))


def edge_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edge_provenance(spark, sf_dir).select(F.col("canonical_edge_id").alias("id"), F.col("source_node_id").alias("source"), F.col("target_node_id").alias("target")).distinct()


@query("node_materialize", f"WITH {NP}, {node_sql('np', 'n')} SELECT * FROM n")
def node_materialize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(graph_views.materialize_nodes(node_provenance(spark, sf_dir)))


_EDGE = "e AS (SELECT id, any_value(s) AS source, any_value(t) AS target, first(label ORDER BY ord) AS label FROM {rows} GROUP BY id), ec AS (SELECT id, string_agg(chunk, '|' ORDER BY pos) AS chunks FROM (SELECT id, chunk, min(ord) AS pos FROM {rows} GROUP BY id, chunk) GROUP BY id)"


@query("edge_materialize", f"WITH {EP}, {_EDGE.format(rows='ep')} SELECT e.*, chunks FROM e JOIN ec USING (id)")
def edge_materialize(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = graph_views.materialize_edges(edge_provenance(spark, sf_dir), edge_table(spark, sf_dir))
    return edges.select("id", "source", "target", "label", F.array_join("chunk_ids", "|").alias("chunks"))


_SOURCES = ["Brand#1", "Brand#2", "Brand#3"]
_IN = "('Brand#1', 'Brand#2', 'Brand#3')"


@query("source_restriction_view", f"WITH {NP}, r AS (SELECT * FROM np WHERE source IN {_IN}), {node_sql('r', 'n')} SELECT * FROM n")
def source_restriction_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, _ = graph_views.restricted_to(node_provenance(spark, sf_dir), edge_provenance(spark, sf_dir), edge_table(spark, sf_dir), _SOURCES)
    return shown(nodes)


@query("source_exclusion_view", f"WITH {NP}, r AS (SELECT * FROM np WHERE source NOT IN {_IN}), {node_sql('r', 'n')} SELECT * FROM n")
def source_exclusion_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = graph_views.materialize_nodes(node_provenance(spark, sf_dir))
    edges = graph_views.materialize_edges(edge_provenance(spark, sf_dir), edge_table(spark, sf_dir))
    left, _ = graph_views.excluding(nodes, edges, node_provenance(spark, sf_dir), edge_provenance(spark, sf_dir), _SOURCES)
    return shown(left)


@query("graph_violations", "WITH " + C_NODES + "," + C_EDGES + " SELECT 'dangling edge' AS kind, id FROM c_edges WHERE source NOT IN (SELECT id FROM c_nodes WHERE type <> 'unclassified') OR target NOT IN (SELECT id FROM c_nodes WHERE type <> 'unclassified')")
def graph_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges that dangle where unclassified nodes are left out."""
    return graph_views.violations(corpora.nodes(spark, sf_dir).filter("type <> 'unclassified'"), corpora.edges(spark, sf_dir))


@query("combine_edges", """WITH l AS (SELECT o_orderkey AS ord, 'edge-' || lpad((o_orderkey % 40)::VARCHAR, 4, '0') AS id, 's' || (o_custkey % 20) AS source, 'p' || (o_orderkey * 7 % 20) AS target, lower(o_orderstatus) AS label FROM orders),
g AS (SELECT source, target, label, min(ord) AS ord, arg_min(id, ord) AS id, count(*) AS n FROM l GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ord) = 1 AS keeps FROM g),
taken AS (SELECT substr(id, 6)::BIGINT AS number FROM k WHERE keeps),
free AS (SELECT number, row_number() OVER (ORDER BY number) AS n FROM (SELECT unnest(range(1, (SELECT count(*) FROM k) + 100)) AS number) WHERE number NOT IN (SELECT number FROM taken)),
o AS (SELECT *, row_number() OVER (ORDER BY ord) AS place FROM k WHERE NOT keeps)
SELECT id, source, target, label, ord FROM k WHERE keeps UNION ALL SELECT 'edge-' || CASE WHEN number < 10000 THEN lpad(number::VARCHAR, 4, '0') ELSE number::VARCHAR END, source, target, label, ord FROM o JOIN free ON free.n = place""")
def combine_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("ord"), F.format_string("edge-%04d", F.col("o_orderkey") % 40).alias("id"), F.concat(F.lit("s"), F.col("o_custkey") % 20).alias("source"),
        F.concat(F.lit("p"), F.col("o_orderkey") * 7 % 20).alias("target"), F.lower("o_orderstatus").alias("label"), F.lit(None).cast("string").alias("properties"), F.array(F.lit("c")).alias("chunk_ids"),
    )
    return graph_views.combine_edges(rows).select("id", "source", "target", "label", "ord")


def versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two snapshots of the documents: in the second some are gone, some changed, some renamed."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("d/"), F.col("doc_id"), F.lit(".md")).alias("source"), F.col("text").alias("markdown"))
    after = docs.filter("doc_id % 10 <> 0").withColumn("markdown", F.when(F.col("doc_id") % 10 == 1, F.concat("markdown", F.lit(" more"))).otherwise(F.col("markdown")))
    after = after.withColumn("source", F.when(F.col("doc_id") % 10 == 2, F.concat(F.lit("renamed/"), F.col("doc_id"))).otherwise(F.col("source")))
    return sync.hashed(docs.drop("doc_id")), sync.hashed(after.drop("doc_id"))


@query("snapshot_diff", """SELECT 'd/' || doc_id || '.md' AS source, CASE doc_id % 10 WHEN 0 THEN 'deleted' WHEN 1 THEN 'changed' WHEN 2 THEN 'deleted' ELSE 'unchanged' END AS change FROM documents
UNION ALL SELECT 'renamed/' || doc_id, 'added' FROM documents WHERE doc_id % 10 = 2""")
def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sync.snapshot_diff(*versions(spark, sf_dir))


@query("affected_ids", f"""WITH {NP}, {EP}, n AS (SELECT DISTINCT id FROM np WHERE source = 'Brand#7'), e AS (SELECT DISTINCT id FROM ep WHERE source = 'Brand#7' OR s IN (SELECT id FROM n) OR t IN (SELECT id FROM n))
SELECT 'node' AS kind, id FROM n UNION ALL SELECT 'edge', id FROM e""")
def affected_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = spark.createDataFrame([("Brand#7",)], "source string")
    nodes, edges = sync.affected(node_provenance(spark, sf_dir), edge_provenance(spark, sf_dir), edge_table(spark, sf_dir), sources)
    return nodes.select(F.lit("node").alias("kind"), "id").unionByName(edges.select(F.lit("edge").alias("kind"), "id"))


@query("delta_apply", f"WITH {NP}, r AS (SELECT * FROM np WHERE source <> 'Brand#7'), {node_sql('r', 'n')} SELECT * FROM n")
def delta_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Removing a source by a delta gives what a rebuild without it gives."""
    before, after = node_provenance(spark, sf_dir), node_provenance(spark, sf_dir).filter("source <> 'Brand#7'")
    old = before.filter("source = 'Brand#7'").select(F.col("canonical_node_id").alias("id")).distinct()
    touched = after.join(old.withColumnRenamed("id", "canonical_node_id"), "canonical_node_id", "left_semi")
    upserts, gone = sync.delta(old, old.limit(0), graph_views.materialize_nodes(touched))
    return shown(sync.apply_delta(graph_views.materialize_nodes(before), upserts, gone))


@query("conditional_upsert", "SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal FROM customer WHERE c_custkey % 4 = 0 OR c_custkey % 6 = 1")
def conditional_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that an upsert really writes: new customers and changed balances."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    stored = rows.filter("c_custkey % 6 <> 1 or c_custkey % 4 = 0")
    incoming = rows.withColumn("c_acctbal", F.when(F.col("c_custkey") % 4 == 0, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal")))
    return sync.conditional_upsert(stored, incoming, "c_custkey")[1]


@query("embedding_cache_lookup", """WITH k AS (SELECT text, min(doc_id) AS first FROM documents WHERE doc_id % 3 = 0 GROUP BY text) SELECT doc_id::VARCHAR AS id, length(text)::DOUBLE AS size, d.doc_id % 3 = 0 AS own, k.first IS NOT NULL AS known FROM documents d LEFT JOIN k USING (text)""")
def embedding_cache_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of all texts where a third is cached; the stand-in for an embedding is the text's length."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), "text", "doc_id")
    vector = lambda t: F.array(F.char_length(t).cast("float"))
    cache = docs.filter("doc_id % 3 = 0").select("id", F.lit("m").alias("embedding_model"), F.sha2(F.col("text").cast("binary"), 256).alias("embedding_input_hash"), vector(F.col("text")).alias("vector"))
    stored = materialise(cache, "cache")
    found = sync.cached_vectors(docs, stored, "m", vector)
    known = stored.select("embedding_input_hash").distinct().withColumn("known", F.lit(True))
    own = stored.select("id").withColumn("own", F.lit(True))
    rows = found.join(known, "embedding_input_hash", "left").join(own, "id", "left")
    return rows.select("id", F.get("vector", 0).cast("double").alias("size"), F.coalesce("own", F.lit(False)).alias("own"), F.coalesce("known", F.lit(False)).alias("known"))


def _part_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    kind = F.when(F.col("p_size") > 40, F.lit("unclassified")).otherwise(F.lower("p_type"))
    return p.select(F.concat(F.lit("part:"), F.col("p_partkey")).alias("id"), F.col("p_partkey").alias("rank"), F.concat("p_name", F.lit("es")).alias("label"), kind.alias("type"), F.array(F.concat("p_name", F.lit(" "), "p_brand")).alias("aliases"))


@query("normalized_names", f"SELECT p_partkey, {sql.entity_key('p_name' + chr(124) * 2 + chr(39) + 'es, Boxes & Cities' + chr(39))} AS key FROM part")
def normalized_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", entity_key(F.concat("p_name", F.lit("es, Boxes & Cities"))).alias("key"))


@query("normalized_name_match", f"""WITH p AS (SELECT 'part:' || p_partkey AS id, p_partkey AS rank, CASE WHEN p_size > 40 THEN 'unclassified' ELSE lower(p_type) END AS type, unnest([p_name || 'es', p_name || ' ' || p_brand]) AS name FROM part),
k AS (SELECT DISTINCT id, rank, type, {sql.entity_key('name')} AS name FROM p)
SELECT a.id, arg_min(b.id, b.rank) AS match FROM k a JOIN k b ON a.name = b.name AND (a.type = b.type OR a.type = 'unclassified' OR b.type = 'unclassified') WHERE b.rank % 2 = 0 AND a.rank % 2 = 1 GROUP BY a.id""")
def normalized_name_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = _part_nodes(spark, sf_dir)
    return resolution.name_matches(nodes.filter("rank % 2 = 1"), nodes.filter("rank % 2 = 0"))


@query("blocked_knn", """WITH v AS (SELECT vec_id::VARCHAR AS id, CASE WHEN label = 0 THEN 'unclassified' ELSE 't' || label END AS type, embedding::DOUBLE[] AS e, vec_id FROM embeddings),
p AS (SELECT a.id, b.id AS candidate, round(list_cosine_similarity(a.e, b.e), 9) AS similarity FROM v a JOIN v b ON a.id <> b.id AND (a.type = b.type OR a.type = 'unclassified' OR b.type = 'unclassified') WHERE a.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY similarity DESC, candidate) AS rank FROM p WHERE similarity >= 0.2) SELECT id, candidate, similarity, rank::BIGINT AS rank FROM r WHERE rank <= 10""")
def blocked_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("id"), "vec_id", F.when(F.col("label") == 0, "unclassified").otherwise(F.concat(F.lit("t"), F.col("label"))).alias("type"), F.col("embedding").alias("vector"))
    return resolution.vector_candidates(rows.filter("vec_id % 20 = 0"), rows, 10, 0.2).withColumn("rank", F.col("rank").cast("long"))


@query("edge_remap_dedupe", """WITH e AS (SELECT 'supplier:' || (l_suppkey % 10) AS source, 'part:' || l_partkey AS target, lower(l_returnflag) AS label FROM lineitem) SELECT source, target, label, count(*)::BIGINT AS n FROM e GROUP BY ALL""")
def edge_remap_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("supplier:"), F.col("l_suppkey")).alias("source"), F.concat(F.lit("part:"), F.col("l_partkey")).alias("target"), F.lower("l_returnflag").alias("label"))
    node_map = table(spark, sf_dir, "supplier").filter("s_suppkey >= 10").select(F.concat(F.lit("supplier:"), F.col("s_suppkey")).alias("old"), F.concat(F.lit("supplier:"), F.col("s_suppkey") % 10).alias("new"))
    return graph_views.remapped(edges, node_map).groupBy("source", "target", "label").agg(F.count("*").alias("n"))


def closest(node: dict, options: list[dict]) -> tuple[str | None, float]:
    """A judge without a model: the most similar option, as surely as it is similar."""
    return options[0]["id"], options[0]["similarity"]


@query("entity_resolution")
def entity_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = _part_nodes(spark, sf_dir)
    asking = resolution.unsettled(nodes).withColumn("vector", hashing_embedder(32)(F.col("label")))
    pairs = materialise(resolution.vector_candidates(asking, asking, least=0.5, earlier=True).drop("rank"), "pairs")
    return resolution.resolve(nodes, pairs, closest).select("id", "canonical")


# Parts as extracted nodes of chunks (their sizes), line items as extracted edges.
def extracted(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    p = table(spark, sf_dir, "part")
    label = F.when(F.col("p_partkey") % 11 == 0, "Heading").when(F.col("p_partkey") % 13 == 0, F.concat(F.lit("Chunk: "), F.col("p_size"))).otherwise(F.col("p_name"))
    nodes = p.select(
        F.concat(F.lit("size-"), F.col("p_size")).alias("chunk_id"), F.lit("a/b.md").alias("source"), F.array(F.col("p_size").cast("string")).alias("heading_path"), F.col("p_partkey").alias("ord"),
        F.concat(F.lit("r"), F.col("p_partkey")).alias("ref"), label.alias("label"), F.when(F.col("p_partkey") % 17 == 0, "Table").otherwise(F.lower("p_type")).alias("type"), F.lit(None).cast("string").alias("suggested_type"),
    )
    lines = table(spark, sf_dir, "lineitem").join(p, F.col("l_partkey") == F.col("p_partkey"))
    edges = lines.select(F.concat(F.lit("size-"), F.col("p_size")).alias("chunk_id"), ((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 100000 + F.col("l_partkey")).alias("ord"), F.concat(F.lit("r"), F.col("p_partkey")).alias("source_ref"), F.concat(F.lit("r"), (F.col("p_partkey") * 7) % 2500).alias("target_ref"), F.lower("l_returnflag").alias("label"))
    return nodes, edges


X = """xn AS (SELECT 'size-' || p_size AS chunk_id, p_partkey AS ord, 'r' || p_partkey AS ref, CASE WHEN p_partkey % 11 = 0 THEN 'Heading' WHEN p_partkey % 13 = 0 THEN 'Chunk: ' || p_size ELSE p_name END AS label,
  p_partkey % 11 = 0 OR p_partkey % 13 = 0 OR p_partkey % 17 = 0 AS structural FROM part),
xe AS (SELECT 'size-' || p_size AS chunk_id, (l_orderkey * 10 + l_linenumber) * 100000 + l_partkey AS ord, 'r' || p_partkey AS source_ref, 'r' || (p_partkey * 7 % 2500) AS target_ref, lower(l_returnflag) AS label FROM lineitem JOIN part ON l_partkey = p_partkey),
xk AS (SELECT *, chunk_id || '::node-' || lpad((row_number() OVER (PARTITION BY chunk_id ORDER BY ord))::VARCHAR, 4, '0') AS id FROM xn WHERE NOT structural),
xj AS (SELECT e.*, s.id AS s, t.id AS t FROM xe e LEFT JOIN xk s ON s.chunk_id = e.chunk_id AND s.ref = source_ref LEFT JOIN xk t ON t.chunk_id = e.chunk_id AND t.ref = target_ref
  WHERE NOT EXISTS (SELECT 1 FROM xn n WHERE n.structural AND n.chunk_id = e.chunk_id AND n.ref IN (source_ref, target_ref)))"""


@query("structural_filter", f"WITH {X} SELECT chunk_id, id, label FROM xk")
def structural_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.chunk_graph(*extracted(spark, sf_dir))[0].select("chunk_id", "id", "label")


@query("chunk_graph_edges", f"WITH {X}, f AS (SELECT chunk_id, s, t, label, min(ord) AS ord FROM xj WHERE s IS NOT NULL AND t IS NOT NULL GROUP BY ALL) SELECT chunk_id, 'edge-' || lpad((row_number() OVER (PARTITION BY chunk_id ORDER BY ord))::VARCHAR, 4, '0') AS id, s AS source, t AS target, label FROM f")
def chunk_graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.chunk_graph(*extracted(spark, sf_dir))[1].select("chunk_id", "id", "source", "target", "label")


@query("dropped_edges", f"WITH {X} SELECT chunk_id, ord, CASE WHEN s IS NULL AND t IS NULL THEN 'source,target' WHEN s IS NULL THEN 'source' ELSE 'target' END AS missing FROM xj WHERE s IS NULL OR t IS NULL")
def dropped_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.chunk_graph(*extracted(spark, sf_dir))[2].select("chunk_id", "ord", F.array_join("missing", ",").alias("missing"))


@query("chunk_graph_counters", f"""WITH {X}, n AS (SELECT chunk_id, count(*) AS raw_nodes, sum(CASE WHEN structural THEN 0 ELSE 1 END) AS kept_nodes FROM xn GROUP BY chunk_id), r AS (SELECT chunk_id, count(*) AS raw_edges FROM xe GROUP BY chunk_id),
k AS (SELECT chunk_id, count(DISTINCT (s, t, label)) FILTER (s IS NOT NULL AND t IS NOT NULL) AS kept_edges, count(*) FILTER (s IS NULL OR t IS NULL) AS dropped_edges FROM xj GROUP BY chunk_id)
SELECT n.chunk_id, raw_nodes::BIGINT AS raw_nodes, kept_nodes::BIGINT AS kept_nodes, coalesce(raw_edges, 0)::BIGINT AS raw_edges, coalesce(kept_edges, 0)::BIGINT AS kept_edges, coalesce(dropped_edges, 0)::BIGINT AS dropped_edges FROM n LEFT JOIN r USING (chunk_id) LEFT JOIN k USING (chunk_id)""")
def chunk_graph_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = extracted(spark, sf_dir)
    kept, named, dropped = extraction.chunk_graph(nodes, edges)
    return extraction.counters(nodes, kept, edges, named, dropped)


@query("reusable_conversions", "SELECT o_orderkey FROM orders WHERE o_orderkey % 3 <> 0 AND o_orderkey % 4 <> 1")
def reusable_conversions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifests with a setting changed in a third of the rows, and another lost in a quarter; null equals null."""
    wanted = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", F.nullif("o_orderpriority", F.lit("5-LOW")).alias("priority"))
    status = F.when(F.col("o_orderkey") % 3 == 0, F.concat("o_orderstatus", F.lit("?"))).otherwise(F.col("o_orderstatus"))
    stored = wanted.filter("o_orderkey % 4 <> 1").withColumn("o_orderstatus", status)
    return sync.reusable(wanted, stored, "o_orderkey")


@query("row_changes", "SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'I' WHEN c_custkey % 5 = 1 THEN 'D' WHEN c_custkey % 5 = 2 THEN 'U' ELSE '=' END AS change FROM customer")
def row_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    balance = F.when(F.col("c_custkey") % 5 == 2, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal"))
    return sync.row_changes(rows.filter("c_custkey % 5 <> 0"), rows.filter("c_custkey % 5 <> 1").withColumn("c_acctbal", balance), "c_custkey")


def _suggested(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    kind = F.when(F.col("p_partkey") % 2 == 0, F.concat("p_type", F.lit(" Part"))).otherwise(F.concat(F.lower("p_type"), F.lit("--part")))
    return p.select(F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("label"), F.when(F.col("p_size") < 25, "unclassified").otherwise("product").alias("type"), F.when(F.col("p_size") < 30, kind).alias("suggested_type"), F.col("p_brand").alias("source"), F.array(F.lit("c")).alias("chunk_ids"))


SUG = """sg AS (SELECT p_partkey, lower(p_type) || '_part' AS t, CASE WHEN p_partkey % 2 = 0 THEN p_type || ' Part' ELSE lower(p_type) || '--part' END AS s, p_brand FROM part WHERE p_size < 30),
ag AS (SELECT t AS normalized_suggested_type, count(*)::BIGINT AS node_count, count(DISTINCT p_brand)::BIGINT AS source_count, array_to_string(list_sort(list_distinct(list(s))), '|') AS spellings FROM sg GROUP BY t)"""


@query("suggestion_aggregate", f"WITH {SUG} SELECT * FROM ag")
def suggestion_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = taxonomy.aggregate_suggestions(taxonomy.suggestions(_suggested(spark, sf_dir)))
    return rows.select("normalized_suggested_type", "node_count", "source_count", F.array_join("spellings", "|").alias("spellings"))


@query("promote_having", f"WITH {SUG} SELECT normalized_suggested_type, node_count FROM ag WHERE node_count >= 5 AND source_count >= 2 AND normalized_suggested_type <> 'small_part'")
def promote_having(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = taxonomy.aggregate_suggestions(taxonomy.suggestions(_suggested(spark, sf_dir)))
    return taxonomy.promotions(rows, spark.createDataFrame([("small_part",)], "type string")).select("normalized_suggested_type", "node_count")


@query("type_migration", "SELECT p_partkey::VARCHAR AS id, CASE WHEN p_size < 25 AND p_type <> 'SMALL' THEN lower(p_type) || '_part' WHEN p_size < 25 THEN 'unclassified' ELSE 'product' END AS type, p_size < 25 AND p_type <> 'SMALL' AS migrated FROM part")
def type_migration(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = _suggested(spark, sf_dir)
    promoted = taxonomy.promotions(taxonomy.aggregate_suggestions(taxonomy.suggestions(nodes)), spark.createDataFrame([("small_part",)], "type string"))
    return taxonomy.migrate(nodes, promoted).select("id", "type", "migrated")


@query("time_windows", """WITH d AS (SELECT event_type AS source, (epoch_us(max(ts)) // 1000 - epoch_us(min(ts)) // 1000)::BIGINT AS d FROM events GROUP BY event_type), s AS (SELECT source, d, unnest(range(0, d, 1200000)) AS b FROM d)
SELECT source, (b // 1200000)::BIGINT AS index, b::BIGINT AS start_ms, least(b + 1205000, d)::BIGINT AS end_ms FROM s WHERE b = 0 OR b + 5000 < d""")
def time_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda f: F.floor(F.unix_micros(f("ts").cast("timestamp")) / 1000)
    recordings = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("source")).agg((at(F.max) - at(F.min)).cast("long").alias("duration_ms"))
    return transcripts.time_windows(recordings).withColumn("index", F.col("index").cast("long"))


@query("transcript_overlap")
def transcript_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows that repeat the last eight words of the one before."""
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("source"), F.col("turn").cast("int").alias("index"), "text")
    before = F.lag("text").over(Window.partitionBy("source").orderBy("index"))
    tail = F.array_join(F.slice(F.split(before, r"\s+"), F.greatest(F.size(F.split(before, r"\s+")) - 7, F.lit(1)), F.lit(8)), " ")
    rows = turns.withColumn("text", F.concat_ws(" ", tail, "text")).withColumn("start_ms", F.col("index").cast("long") * 1_200_000)
    return transcripts.assemble(rows)


def _ledger(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Texts of digits, and corrections that each rewrite two marked places."""
    t = table(spark, sf_dir, "orders").select(F.lit("s").alias("source"), F.col("o_orderkey").cast("int").alias("index"), F.concat_ws(" ", F.lit("alpha"), "o_orderkey", F.lit("beta"), "o_custkey", F.lit("gamma")).alias("text"))
    row = lambda i, original, context, to: t.select(F.concat(F.lit(f"{i}-"), "index").alias("id"), "source", F.col("index").alias("chunk"), F.lit(original).alias("original"), F.lit(to).alias("replacement"), F.lit(context).alias("context"), F.when(F.col("index") % 2 == 0, "apply").otherwise("review").alias("decision"), F.lit(False).alias("reviewed"))
    rows = row(1, "alpha", "alpha ", "Alpha").unionByName(row(2, "beta", " beta ", "Beta-2")).unionByName(row(3, "eta", "beta", "ETA").filter("chunk % 5 = 0"))
    return t, rows


@query("correction_overlap", "SELECT i || '-' || o_orderkey AS id FROM orders, (VALUES (2), (3)) v(i) WHERE o_orderkey % 5 = 0")
def correction_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts, rows = _ledger(spark, sf_dir)
    return transcripts.overlapping(transcripts.located(rows, texts)).select("id")


@query("correction_apply", "SELECT o_orderkey::BIGINT AS index, CASE WHEN o_orderkey % 2 = 0 THEN 'Alpha' ELSE 'alpha' END || ' ' || o_orderkey || ' ' || CASE WHEN o_orderkey % 2 = 0 AND o_orderkey % 5 <> 0 THEN 'Beta-2' ELSE 'beta' END || ' ' || o_custkey || ' gamma' AS text FROM orders")
def correction_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts, rows = _ledger(spark, sf_dir)
    return transcripts.apply_corrections(texts, transcripts.located(rows, texts)).select(F.col("index").cast("long").alias("index"), "text")


@query("conversation_compaction", """WITH t AS (SELECT conv_id, turn, role, len(regexp_split_to_array(text, '\\s+'))::BIGINT AS tokens FROM conversations), u AS (SELECT *, sum(tokens) OVER (PARTITION BY conv_id ORDER BY turn DESC) AS upto, sum(tokens) OVER (PARTITION BY conv_id) AS al FROM t),
s AS (SELECT *, coalesce(min(CASE WHEN role = 'user' AND upto <= 120 THEN turn END) OVER (PARTITION BY conv_id), max(turn) OVER (PARTITION BY conv_id)) AS st FROM u) SELECT conv_id, turn, tokens, al <= 250 OR turn >= st AS keeps FROM s""")
def conversation_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.size(F.split("text", r"\s+")).cast("long").alias("tokens"))
    return ledger.compacted(turns, 250, 120).select("conv_id", "turn", "tokens", "keeps")


@query("reference_registry", "WITH " + C_CHUNKS + ", r AS (SELECT source, page_start, page_end, min(doc_id) AS first FROM c_chunks GROUP BY ALL) SELECT source, page_start::BIGINT AS page_start, page_end::BIGINT AS page_end, 'S' || row_number() OVER (ORDER BY first) AS name FROM r")
def reference_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All chunks as the hits of a session."""
    rows = corpora.chunks(spark, sf_dir).select(F.col("doc_id").alias("ord"), "source", "page_start", "page_end")
    return ledger.registry(rows).select("source", F.col("page_start").cast("long").alias("page_start"), F.col("page_end").cast("long").alias("page_end"), "name")


@query("evidence_ledger", "WITH " + C_CHUNKS + " SELECT source, page_start::BIGINT AS page_start, min(doc_id) AS first, array_to_string(list_sort(list_distinct(list((doc_id % 4)::VARCHAR))), ',') AS subquestions, count(*)::BIGINT AS times FROM c_chunks GROUP BY source, page_start")
def evidence_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = corpora.chunks(spark, sf_dir).select(F.col("doc_id").alias("ord"), (F.col("doc_id") % 4).cast("string").alias("subquestion"), "source", F.col("page_start").cast("long").alias("page_start"))
    return ledger.evidence(rows, ["source", "page_start"]).withColumn("subquestions", F.array_join("subquestions", ","))


def markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row as a document of its own: a title, a page marker in every fifth, a section with the text."""
    docs = table(spark, sf_dir, "documents")
    marker = F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("<!-- page: "), F.col("doc_id") + 1, F.lit(" -->\n"))).otherwise("")
    body = F.concat(F.lit("# "), "source", F.lit("\n\n"), marker, F.lit("## Doc "), "doc_id", F.lit("\n\n"), F.coalesce("text", F.lit("")))
    return docs.select(F.concat("source", F.lit("/"), "doc_id", F.lit(".md")).alias("source"), body.alias("markdown"))


@query("chunk_markdown")
def chunk_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunk_documents(markdown(spark, sf_dir)).withColumn("heading_path", F.array_join("heading_path", " > "))


OPENS = "c = 8 OR chars + p.n > 16000"


@query("page_batches", f"""WITH RECURSIVE p AS (SELECT source, doc_id AS page, length(coalesce(text, '')) AS n, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents),
b AS (SELECT source, page, k, 1 AS batch, 1 AS c, n AS chars FROM p WHERE k = 1
  UNION ALL SELECT p.source, p.page, p.k, CASE WHEN {OPENS} THEN batch + 1 ELSE batch END, CASE WHEN {OPENS} THEN 1 ELSE c + 1 END, CASE WHEN {OPENS} THEN p.n ELSE chars + p.n END FROM b JOIN p ON p.source IS NOT DISTINCT FROM b.source AND p.k = b.k + 1)
SELECT source, page::INT AS page, batch FROM b""")
def page_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.page_batches(table(spark, sf_dir, "documents").select("source", F.col("doc_id").alias("page"), "text"))


BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(28) || chr(29) || chr(30) || chr(31) || chr(133) || chr(160) || chr(8232) || chr(8233) || chr(12288)"


def last_of(mark: str) -> str:
    """The length of what precedes the last ``mark`` in the first 4,097 characters, if that is not blank."""
    before = f"regexp_extract(left(rest, 4097), '(?s)^(.*){mark}', 1)"
    return f"WHEN trim({before}, {BLANKS}) <> '' THEN length({before})"


@query("message_split", rf"""WITH RECURSIVE m AS (SELECT doc_id AS id, -1 AS part, NULL::VARCHAR AS text, trim(coalesce(text, ''), {BLANKS}) AS rest FROM documents
  UNION ALL SELECT id, part + 1, CASE WHEN length(rest) <= 4096 THEN rest ELSE rtrim(left(rest, cut), {BLANKS}) END, CASE WHEN length(rest) <= 4096 THEN '' ELSE ltrim(substr(rest, cut + 1), {BLANKS}) END
  FROM (SELECT id, part, rest, CASE {last_of(chr(92) + "n")} {last_of(" ")} ELSE 4096 END AS cut FROM m WHERE rest <> ''))
SELECT id, part, text FROM m WHERE part >= 0""")
def message_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages.split_messages(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"))
