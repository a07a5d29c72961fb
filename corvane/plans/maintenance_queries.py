"""Queries over graphs that are combined and changed, node texts, types, lookups and rolling context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.operators import chunking, graph_views, relationships, taxonomy
from corvane.plans import corpora
from corvane.plans.corpora import C_CHUNKS, C_EDGES, C_NODES, table

QUERIES, ORACLES = {}, {}


def query(name: str, oracle: str | None = None):
    """Register a query and the SQL that repeats it."""

    def put(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return put


def listed(column: str) -> Column:
    return F.array_join(column, "|").alias(column)


# A second graph names every node anew and gives it a chunk of its own; parts get a type there.
@query("combine_nodes", f"""WITH {C_NODES} SELECT id, label, CASE WHEN type = 'unclassified' THEN 'thing' ELSE type END AS type, coalesce(nullif(suggested_type, ''), 'late') AS suggested_type,
 array_to_string(list_concat(aliases, [label || ' again']), '|') AS aliases, properties, array_to_string(list_concat(chunk_ids, ['more-' || id]), '|') AS chunk_ids FROM c_nodes""")
def combine_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = corpora.nodes(spark, sf_dir).drop("chunk_source")
    first = own.withColumn("ord", F.lit(1))
    second = own.withColumns({
        "ord": F.lit(2), "label": F.concat("label", F.lit(" again")), "type": F.when(F.col("type") == "unclassified", "thing").otherwise("other"), "suggested_type": F.lit("late"),
        "chunk_ids": F.array(F.concat(F.lit("more-"), "id")),
    })
    rows = graph_views.combine_nodes(first.unionByName(second))
    return rows.select("id", "label", "type", "suggested_type", listed("aliases"), "properties", listed("chunk_ids"))


# The graph without supplies is stored, with numbers that have gaps; the whole graph comes in.
@query("merge_edge_sets", f"""WITH {C_CHUNKS}, {C_EDGES},
s AS (SELECT 'edge-' || printf('%04d', 3 * row_number() OVER (ORDER BY source, target, label)) AS id, source, target, label, chunk_ids FROM c_edges WHERE label <> 'supplies'),
n AS (SELECT source, target, label, chunk_ids, row_number() OVER (ORDER BY id) AS k FROM c_edges WHERE label = 'supplies'),
f AS (SELECT i, row_number() OVER (ORDER BY i) AS k FROM range(1, (SELECT count(*) FROM c_edges)::BIGINT + 1) t(i) WHERE 'edge-' || lpad(i::VARCHAR, greatest(4, length(i::VARCHAR))::INT, '0') NOT IN (SELECT id FROM s))
SELECT id, source, target, label, array_to_string(list_concat(chunk_ids, ['new']), '|') AS chunk_ids FROM s
UNION ALL SELECT 'edge-' || lpad(i::VARCHAR, greatest(4, length(i::VARCHAR))::INT, '0'), source, target, label, array_to_string(list_concat(['new'], chunk_ids), '|') FROM n JOIN f USING (k)""")
def merge_edge_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvane.operators.ranking import global_rank

    own = corpora.edges(spark, sf_dir).drop("chunk_source")
    kept = global_rank(own.filter("label <> 'supplies'"), F.col("source"), F.col("target"), F.col("label"), name="k")
    stored = kept.withColumn("id", F.format_string("edge-%04d", F.col("k") * 3)).drop("k")
    incoming = own.withColumn("ord", F.col("id")).withColumn("chunk_ids", F.when(F.col("label") == "supplies", F.concat(F.array(F.lit("new")), "chunk_ids")).otherwise(F.concat("chunk_ids", F.array(F.lit("new")))))
    return graph_views.merge_edge_sets(stored, incoming).select("id", "source", "target", "label", listed("chunk_ids"))


# Orders ask for the chunk with their customer's number, in the source of the chunk with their own: some are elsewhere.
@query("chunk_lookup", f"""WITH {C_CHUNKS}, n AS (SELECT count(*) AS n FROM documents), r AS (SELECT o_orderkey AS ord, b.source, a.id FROM orders, n JOIN c_chunks a ON a.doc_id = o_custkey % n JOIN c_chunks b ON b.doc_id = o_orderkey % n)
SELECT r.ord, c.id, c.index::BIGINT AS index, c.page_start, c.page_end FROM r JOIN c_chunks c ON c.source = r.source AND c.id = r.id""")
def chunk_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = corpora.chunks(spark, sf_dir)
    n = table(spark, sf_dir, "documents").count()
    asked = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("ord"), (F.col("o_custkey") % n).alias("a"), (F.col("o_orderkey") % n).alias("b"))
    requests = asked.join(chunks.select(F.col("doc_id").alias("a"), "id"), "a").join(chunks.select(F.col("doc_id").alias("b"), "source"), "b")
    return chunking.by_ids(chunks, requests).select("ord", "id", F.col("index").cast("long").alias("index"), "page_start", "page_end")


@query("page_range_violations", """WITH c AS (SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS id, CASE WHEN l_returnflag <> 'A' THEN l_linenumber - 1 END AS a, CASE WHEN l_linestatus <> 'F' OR l_returnflag <> 'A' THEN l_quantity::INT % 7 END AS b FROM lineitem)
SELECT id, CASE WHEN (a IS NULL) <> (b IS NULL) THEN 'one end alone' WHEN a < 1 THEN 'first page below 1' WHEN b < a THEN 'end before start' END AS problem FROM c WHERE (a IS NULL) <> (b IS NULL) OR a < 1 OR b < a""")
def page_range_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.when(F.col("l_returnflag") != "A", F.col("l_linenumber") - 1)
    last = F.when((F.col("l_linestatus") != "F") | (F.col("l_returnflag") != "A"), F.col("l_quantity").cast("int") % 7)
    lines = table(spark, sf_dir, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("id"), first.alias("page_start"), last.alias("page_end"))
    return chunking.page_range_violations(lines)


LINES = """ends AS (SELECT e.id AS edge, e.source, e.target, e.label, s.label AS sl, s.type AS st, t.label AS tl, t.type AS tt FROM c_edges e JOIN {nodes} s ON s.id = e.source JOIN {nodes} t ON t.id = e.target),
lines AS (SELECT source AS id, edge, 0 AS side, 'outgoing ' || label || ' to ' || tl || ' (' || tt || ')' AS line FROM ends UNION ALL SELECT target, edge, 1, 'incoming ' || label || ' from ' || sl || ' (' || st || ')' FROM ends),
once AS (SELECT id, line, min((edge, side)) AS pos FROM lines GROUP BY id, line),
joined AS (SELECT id, string_agg(line, '; ' ORDER BY pos) AS relationships FROM once GROUP BY id)"""


@query("node_texts", f"""WITH {C_NODES}, {C_EDGES}, {LINES.format(nodes='c_nodes')}
SELECT id, md5(concat_ws(chr(10), 'label: ' || label, 'type: ' || type, 'suggested_type: ' || nullif(suggested_type, ''), CASE WHEN len(aliases) > 0 THEN 'aliases: ' || array_to_string(aliases, ', ') END, 'properties: ' || properties, 'relationships: ' || relationships)) AS text_md5
FROM c_nodes LEFT JOIN joined USING (id)""")
def node_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = relationships.node_texts(corpora.nodes(spark, sf_dir), corpora.edges(spark, sf_dir))
    return texts.select("id", F.md5(F.col("text").cast("binary")).alias("text_md5"))


# Nations of one region are renamed, and suppliers of another lose their edges.
@query("stale_node_texts", f"""WITH {C_NODES}, {C_EDGES},
moved AS (SELECT 'nation:' || n_nationkey AS id FROM nation WHERE n_regionkey = 2),
gone AS (SELECT source, target FROM c_edges WHERE target IN (SELECT 'nation:' || n_nationkey FROM nation WHERE n_regionkey = 1) AND label = 'located_in'),
x AS (SELECT id FROM moved UNION SELECT source FROM gone UNION SELECT target FROM gone UNION SELECT source FROM c_edges WHERE target IN (SELECT id FROM moved) UNION SELECT target FROM c_edges WHERE source IN (SELECT id FROM moved))
SELECT id FROM x WHERE id IN (SELECT id FROM c_nodes)""")
def stale_node_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges, nations = corpora.nodes(spark, sf_dir), corpora.edges(spark, sf_dir), table(spark, sf_dir, "nation")
    key = F.concat(F.lit("nation:"), "n_nationkey")
    moved = nations.filter("n_regionkey = 2").select(key.alias("id"), F.lit(" moved").alias("suffix"))
    after = nodes.join(moved, "id", "left").withColumn("label", F.concat("label", F.coalesce("suffix", F.lit("")))).drop("suffix")
    gone = nations.filter("n_regionkey = 1").select(key.alias("target"), F.lit("located_in").alias("label"))
    return relationships.stale(nodes, edges, after, edges.join(gone, ["target", "label"], "left_anti"))


def _suggested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as extracted nodes: brands are their sources, types their suggestions; large ones are classified already."""
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("label"), F.when(F.col("p_size") < 25, "Unclassified").otherwise("product").alias("type"),
        F.concat("p_type", F.lit(" part")).alias("suggested_type"), F.col("p_brand").alias("source"), F.array(F.col("p_size").cast("string")).alias("chunk_ids"),
    )


EVOLVED = """p AS (SELECT p_partkey::VARCHAR AS id, p_brand AS source, p_size, p_type || ' part' AS s, array_to_string(regexp_extract_all(lower(p_type), '[a-z0-9]+'), '_') || '_part' AS k FROM part),
ag AS (SELECT k, count(DISTINCT (source, id)) AS n, count(DISTINCT source) AS m, array_to_string(list_sort(list(DISTINCT s)), '|') AS matched FROM p GROUP BY k HAVING count(DISTINCT (source, id)) >= 5 AND count(DISTINCT source) >= 2 AND k <> 'small_part')"""


@query("taxonomy_promotions", f"WITH {EVOLVED} SELECT k AS type, matched AS matched_suggestions, 'Appeared in ' || n || ' nodes across ' || m || ' source documents.' AS reason FROM ag")
def taxonomy_promotions(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = _suggested(spark, sf_dir)
    audit = taxonomy.evolve(spark.createDataFrame([("small_part",)], "type string"), taxonomy.suggestions(nodes), nodes)[2]
    return audit.select("type", listed("matched_suggestions"), "reason")


@query("promotion_affected", f"WITH {EVOLVED} SELECT DISTINCT k AS type, source || ':' || id AS node FROM p JOIN ag USING (k) WHERE p_size < 25")
def promotion_affected(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = _suggested(spark, sf_dir)
    return taxonomy.evolve(spark.createDataFrame([("small_part",)], "type string"), taxonomy.suggestions(nodes), nodes)[3]


@query("rolling_tail", """WITH d AS (SELECT lang || '/' || source AS source, doc_id, coalesce(text, '') AS text, sum(length(coalesce(text, ''))) OVER w AS e FROM documents WINDOW w AS (PARTITION BY lang, source ORDER BY doc_id)),
p AS (SELECT a.source, a.doc_id, string_agg(b.text, '' ORDER BY b.doc_id) AS t FROM d a JOIN d b ON a.source = b.source AND b.doc_id < a.doc_id AND b.e > a.e - length(a.text) - 500 GROUP BY ALL)
SELECT d.source, d.doc_id, md5(coalesce(right(t, 500), '')) AS tail_md5, length(coalesce(right(t, 500), ''))::BIGINT AS length FROM d LEFT JOIN p USING (source, doc_id)""")
def rolling_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.concat_ws("/", "lang", "source").alias("source"), "doc_id", "text")
    rows = chunking.rolling_tail(docs, 500, "doc_id")
    return rows.select("source", "doc_id", F.md5(F.col("tail").cast("binary")).alias("tail_md5"), F.char_length("tail").cast("long").alias("length"))
