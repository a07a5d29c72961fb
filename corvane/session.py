"""A knowledge base over a snapshot store: synchronise documents, search, find documents, look around a chunk."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane import schemas
from corvane.functions.text import in_folder
from corvane.operators import chunk_search, chunking, document_search, extraction, graph_views, hybrid, references, relationships, resolution, sync, taxonomy
from corvane.sources import export
from corvane.sources.shared import checkpoint, materialise
from corvane.sources.snapshots import Conflict, SnapshotStore

#: An extractor: from chunks to nodes (chunk_id, ord, ref, label, type, suggested_type) and edges (chunk_id, ord,
#: source_ref, target_ref, label); or one that asks a model once for each content and keeps its answers with the version.
Extractor = Callable[[DataFrame], tuple[DataFrame, DataFrame]] | extraction.CachedExtractor

#: Stands before the ids of known nodes while new ones are resolved, and sorts before them.
KNOWN = "\x01"

_TABLES = {
    "documents": "source STRING, content_hash STRING",
    "chunks": schemas.CHUNKS,
    "nodes": schemas.NODES,
    "edges": schemas.EDGES,
    "node_provenance": schemas.NODE_PROVENANCE.replace("ord INT", "ord BIGINT"),
    "edge_provenance": schemas.EDGE_PROVENANCE.replace("ord INT", "ord BIGINT"),
    "chunk_vectors": schemas.EMBEDDINGS,
    "node_vectors": schemas.EMBEDDINGS,
    "suggestions": schemas.SUGGESTIONS.replace(", created_at TIMESTAMP", ""),
    "extractions": "source STRING, key STRING, result STRING",
    "registry": "type STRING",
    "promotions": "type STRING, matched_suggestions ARRAY<STRING>, reason STRING, version BIGINT",
    "promoted_nodes": "type STRING, node STRING, version BIGINT",
    "dropped_edges": "chunk_id STRING, source STRING, ord BIGINT, source_ref STRING, target_ref STRING, label STRING, missing ARRAY<STRING>",
}
#: Tables that a rebuild goes on from: answers, vectors and types outlive the graph.
_LASTING = ("extractions", "registry", "promotions", "promoted_nodes", "chunk_vectors", "node_vectors")
#: Tables laid out by their source, for lookups that name one.
_BY_SOURCE = ("chunks", "node_provenance", "edge_provenance")
#: Times that a synchronisation is made again because another writer was first.
ATTEMPTS = 5


class KnowledgeBase:
    """Chunks and a graph with provenance, kept up to date from document snapshots."""

    def __init__(self, spark: SparkSession, folder: str, scopes: dict[str, str] | None = None, embed: Callable[[Column], Column] | None = None, model: str = "embedder", judge: resolution.Judge | None = None, types: Sequence[str] = ()):
        """``embed``, where given, turns texts into vectors; ``model`` names it in the vectors' cache. ``judge``, where given
        too, decides on new nodes that share no name with an earlier one but have a similar vector. ``types`` are the node
        types that are known from the start; suggested ones that become frequent are added and nodes migrated to them."""
        self.spark, self.store, self.scopes = spark, SnapshotStore(spark, folder), scopes or {}
        self.embed, self.model, self.judge, self.types = embed, model, judge, list(types)
        self._anew = False

    def table(self, name: str) -> DataFrame:
        """A table of the newest version, empty before the first."""
        now = self.store.current()
        if now and name in now[1] and not (self._anew and name not in _LASTING):
            return self.store.read(name)
        return self.spark.createDataFrame([(t,) for t in self.types] if name == "registry" else [], _TABLES[name])

    def merge(self, documents: DataFrame, extract: Extractor) -> DataFrame:
        """Like ``sync``, but sources that ``documents`` does not name stay."""
        return self._first(lambda: self._apply(sync.hashed(documents), extract, keep_others=True))

    def sync(self, documents: DataFrame, extract: Extractor) -> DataFrame:
        """Make the knowledge base say what ``documents`` (source, markdown) say; returns (source, change).

        Only added and changed documents are chunked, extracted and resolved; elements that other sources support stay,
        with their ids. All tables of the new version appear together; after an error none does.
        """
        return self._first(lambda: self._apply(sync.hashed(documents), extract))

    def rebuild(self, documents: DataFrame, extract: Extractor) -> DataFrame:
        """A new version made from the documents alone, as if the graph had never been there; stored answers and vectors are
        used again."""
        self._anew = True
        try:
            return self._first(lambda: self._apply(sync.hashed(documents), extract))
        finally:
            self._anew = False

    def _first(self, make: Callable[[], DataFrame]) -> DataFrame:
        """The result of ``make``, made again from the newest version where another writer was first."""
        for _ in range(ATTEMPTS - 1):
            try:
                return make()
            except Conflict:
                continue
        return make()

    def _apply(self, after: DataFrame, extract: Extractor, keep_others: bool = False) -> DataFrame:
        now = self.store.current()
        before = self.table("documents")
        if keep_others:
            others = before.join(after, "source", "left_anti").withColumn("markdown", F.lit(None).cast("string"))
            after = after.unionByName(others)
        diff = checkpoint(sync.snapshot_diff(before, after))
        if now and not self._anew and diff.filter("change <> 'unchanged'").isEmpty():
            return diff
        gone = diff.filter("change in ('deleted', 'changed')").select("source")
        fresh = after.join(diff.filter("change in ('added', 'changed')"), "source", "left_semi")
        version = now[0] + 1 if now else 1
        chunks = materialise(chunking.chunk_documents(fresh), "chunks")
        found_nodes, found_edges, answers = self._extracted(extract, chunks)
        home = chunks.select(F.col("id").alias("chunk_id"), "source", "heading_path")
        nodes, edges, dropped = extraction.chunk_graph(found_nodes.join(home, "chunk_id"), found_edges)
        home = home.drop("heading_path")
        edges, dropped = materialise(edges, "found-edges"), materialise(dropped.join(home, "chunk_id"), "dropped-edges")
        nodes = nodes.join(home, "chunk_id")
        kept = lambda name: self.table(name).join(gone, "source", "left_anti")
        kept_edges = kept("edge_provenance")
        suggestions = materialise(kept("suggestions").unionByName(taxonomy.suggestions(nodes)), "suggestions")
        registry, nodes, kept_nodes, audit = self._evolved(suggestions, nodes, kept("node_provenance"), version)
        canonical = self._resolve(nodes.join(after.select("source", "content_hash"), "source"), edges, kept_nodes)
        place = lambda key: (F.lit(version * 10**9) + F.row_number().over(Window.partitionBy(key).orderBy("source", "__id"))).alias("ord")
        none, empty = F.lit(None).cast("string"), F.array().cast("array<string>")
        hashes = after.select("source", "content_hash")
        new_nodes = nodes.join(canonical, "id").join(hashes, "source").withColumn("__id", F.col("id")).select(
            F.col("canonical").alias("canonical_node_id"), place("canonical"), "source", "content_hash", F.col("id").alias("node_id"), "label", "type", "suggested_type",
            empty.alias("aliases"), none.alias("properties"), "chunk_ids", F.coalesce("given", empty).alias("resolution_aliases"),
        )
        mapped = graph_views.remapped(edges, canonical.select(F.col("id").alias("old"), F.col("canonical").alias("new")))
        mapped = mapped.withColumnRenamed("source", "source_node_id").withColumnRenamed("target", "target_node_id").join(home, "chunk_id").join(hashes, "source")
        name = F.concat(F.lit("edge-"), F.substring(F.sha2(F.concat_ws("\0", "source_node_id", "target_node_id", "label").cast("binary"), 256), 1, 16))
        new_edges = mapped.withColumns({"canonical": name, "__id": F.concat_ws("::", "chunk_id", "id")}).select(
            F.col("canonical").alias("canonical_edge_id"), place("canonical"), "source", "content_hash", F.col("__id").alias("edge_id"), "source_node_id", "target_node_id", "label", none.alias("properties"), "chunk_ids",
        )
        migrated = kept_nodes.filter("migrated").select(F.col("canonical_node_id").alias("id"))
        node_rows = materialise(kept_nodes.drop("migrated").unionByName(new_nodes), "node-provenance")
        edge_rows = materialise(kept_edges.unionByName(new_edges), "edge-provenance")
        tables = {
            "chunks": materialise(kept("chunks").unionByName(chunks), "chunks"),
            "nodes": materialise(self._delta("nodes", gone, new_nodes.select(F.col("canonical_node_id").alias("id")).unionByName(migrated), "node", node_rows, None), "nodes"),
            "edges": materialise(self._delta("edges", gone, new_edges.select(F.col("canonical_edge_id").alias("id")), "edge", edge_rows, edge_rows), "edges"),
        }
        used = kept("extractions").unionByName(answers)
        dropped = kept("dropped_edges").unionByName(dropped.withColumn("ord", F.col("ord").cast("bigint")))
        self.store.commit(
            _BY_SOURCE, now[0] if now else 0, documents=hashes, node_provenance=node_rows, edge_provenance=edge_rows, suggestions=suggestions, extractions=used,
            dropped_edges=dropped, registry=registry, **audit, **tables, **self._vectors(**tables),
        )
        return diff

    def _extracted(self, extract: Extractor, chunks: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(nodes, edges, records) of chunks; a cached extractor's records are stored with the version, or not at all."""
        if isinstance(extract, extraction.CachedExtractor):
            return extract.extract(chunks, self.table("extractions"))
        return *extract(chunks), self.spark.createDataFrame([], _TABLES["extractions"])

    def _evolved(self, suggestions: DataFrame, nodes: DataFrame, kept: DataFrame, version: int) -> tuple[DataFrame, DataFrame, DataFrame, dict[str, DataFrame]]:
        """(registry, new nodes, kept provenance, audit tables) with newly frequent suggested types promoted; both kinds of
        rows are migrated, kept ones with ``migrated``."""
        new = nodes.select(F.lit(True).alias("new"), "source", "id", "type", "suggested_type")
        old = kept.select(F.lit(False).alias("new"), "source", F.col("node_id").alias("id"), "type", "suggested_type")
        registry, moved, promotions, affected = taxonomy.evolve(self.table("registry"), suggestions, new.unionByName(old), self.table("promotions"))
        moved = materialise(moved.select("new", "source", "id", "type", "suggested_type", "migrated"), "migrated")
        types = lambda fresh: moved.filter(F.col("new") == fresh).drop("new").distinct()
        nodes = materialise(nodes.drop("type", "suggested_type").join(types(True).drop("migrated"), ["source", "id"]), "found-nodes")
        kept = kept.drop("type", "suggested_type").join(types(False).withColumnRenamed("id", "node_id"), ["source", "node_id"])
        numbered = lambda rows: rows.withColumn("version", F.lit(version).cast("bigint"))
        affected = taxonomy.affected_nodes(moved)
        audit = {"promotions": self.table("promotions").unionByName(numbered(promotions)), "promoted_nodes": self.table("promoted_nodes").unionByName(numbered(affected))}
        return registry, nodes, materialise(kept, "kept-nodes"), audit

    def _vectors(self, chunks: DataFrame, nodes: DataFrame, edges: DataFrame) -> dict[str, DataFrame]:
        """Vectors of all chunks and nodes; only texts that no stored vector has are embedded."""
        if self.embed is None:
            return {}
        text = chunk_search.searchable_text(chunk_search.annotated(chunks, nodes, edges)).select("id", F.col("searchable").alias("text"))
        found = {"chunk_vectors": sync.cached_vectors(text, self.table("chunk_vectors"), self.model, self.embed)}
        # nodes whose own row, edges or neighbours did not change keep their vectors; of the others texts are made
        stored = self.table("node_vectors").filter(F.col("embedding_model") == self.model)
        changed = relationships.stale(self.table("nodes"), self.table("edges"), nodes, edges)
        stale = materialise(changed.unionByName(nodes.select("id").join(stored.select("id"), "id", "left_anti")).distinct(), "stale")
        at = lambda end: edges.join(stale.withColumnRenamed("id", end), end, "left_semi").select("id")
        near = edges.join(at("source").unionByName(at("target")), "id", "left_semi")
        texts = relationships.node_texts(nodes, near).join(stale, "id", "left_semi")
        kept = stored.join(stale, "id", "left_anti").join(nodes.select("id"), "id", "left_semi")
        found["node_vectors"] = kept.unionByName(sync.cached_vectors(texts, self.table("node_vectors"), self.model, self.embed).select(*kept.columns))
        return found

    def _resolve(self, nodes: DataFrame, edges: DataFrame, provenance: DataFrame) -> DataFrame:
        """(id, canonical, given) of new nodes: a known node with the same contribution, one with a shared name and a comparable
        type, one that the judge accepts, or the first new one. A new canonical node whose id is taken gets the next free number
        behind it; ``given`` are aliases that the judge adds."""
        known = graph_views.materialize_nodes(provenance).withColumn("rank", F.col("id"))
        incoming = nodes.select("id", F.concat_ws("\0", "source", "id").alias("rank"), "label", "type", "suggested_type", F.array().cast("array<string>").alias("aliases"))
        same = materialise(resolution.same_contribution(nodes, provenance), "same")
        matched = same.unionByName(resolution.name_matches(incoming.join(same, "id", "left_anti"), known))
        matched = materialise(matched, "matches")
        rest = materialise(incoming.join(matched, "id", "left_anti"), "unmatched")
        if self.judge is None or self.embed is None:
            folded = resolution.resolve(rest)
        else:
            folded = self._judged(rest, known, edges)
        # known nodes are told apart from new ones with the same id by a mark
        number = F.coalesce(F.nullif(F.regexp_extract("id", r"::(\d{4,})$", 1), F.lit("")).cast("int"), F.lit(1))
        taken = known.select(F.regexp_replace("id", r"::\d{4,}$", "").alias("canonical"), number.alias("n")).groupBy("canonical").agg(F.max("n").alias("n"))
        free = F.when(F.col("canonical").startswith(KNOWN), F.substring_index("canonical", KNOWN, -1)).when(F.col("n").isNotNull(), F.concat("canonical", F.lit("::"), F.lpad((F.col("n") + 1).cast("string"), 4, "0")))
        folded = folded.join(taken, "canonical", "left").select("id", F.coalesce(free, "canonical").alias("canonical"), F.col("aliases").alias("given"))
        return materialise(matched.select("id", F.col("match").alias("canonical"), F.array().cast("array<string>").alias("given")).unionByName(folded), "canonical")

    def _judged(self, rest: DataFrame, known: DataFrame, edges: DataFrame) -> DataFrame:
        """(id, canonical, aliases) of new nodes by name among themselves, else by the judge among similar earlier ones; known nodes
        come first and have a mark before their ids."""
        none = F.lit(None).cast("string").alias("properties")
        texts = relationships.node_texts(rest.withColumn("properties", none), edges.select(F.concat_ws("::", "chunk_id", "id").alias("id"), "source", "target", "label"))
        fresh = resolution.unsettled(rest).join(texts, "id").select("id", "rank", "type", self.embed(F.col("text")).alias("vector"))
        vectors = self.table("node_vectors").filter(F.col("embedding_model") == self.model).select("id", "vector")
        mark = F.concat(F.lit(KNOWN), "id")
        stored = known.join(vectors, "id").select(mark.alias("id"), mark.alias("rank"), "type", "vector")
        asking = materialise(fresh, "new-vectors")
        pairs = materialise(resolution.vector_candidates(asking, asking.unionByName(stored), earlier=True).drop("rank"), "pairs")
        asked = known.select(mark.alias("id"), mark.alias("rank"), "label", "type", "aliases", F.lit(True).alias("fixed"))
        asked = asked.join(pairs.select(F.col("candidate").alias("id")), "id", "left_semi")
        both = rest.select("id", "rank", "label", "type", "aliases", F.lit(False).alias("fixed")).unionByName(asked)
        return resolution.resolve(both, pairs, self.judge).join(rest.select("id"), "id", "left_semi")

    def _delta(self, name: str, gone: DataFrame, added: DataFrame, kind: str, rows: DataFrame, ends: DataFrame | None) -> DataFrame:
        """The stored elements with those that removed or new provenance touches made anew."""
        key = f"canonical_{kind}_id"
        lost = self.table(f"{kind}_provenance").join(gone, "source", "left_semi").select(F.col(key).alias("id"))
        touched = lost.unionByName(added).distinct()
        own = rows.join(touched.withColumnRenamed("id", key), key, "left_semi")
        if ends is None:
            made = graph_views.materialize_nodes(own)
        else:
            made = graph_views.materialize_edges(own, ends.select(F.col(key).alias("id"), F.col("source_node_id").alias("source"), F.col("target_node_id").alias("target")).distinct())
        upserts, deleted = sync.delta(touched, touched.limit(0), made)
        return sync.apply_delta(self.table(name), upserts, deleted)

    def restricted(self, scope: str | None = None, sources: Sequence[str] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Chunks, nodes and edges of a folder scope or of given sources: the restriction comes before any statistics."""
        chunks = self.table("chunks")
        if scope is None and sources is None:
            return chunks, self.table("nodes"), self.table("edges")
        own_rows = self.table if sources is None or not self.store.exists() else (lambda name: self.store.read(name, sources))
        chunks = own_rows("chunks")
        if scope is not None:
            if scope.strip().casefold() not in self.scopes:
                raise ValueError(f"unknown scope {scope!r}; there are {', '.join(sorted(self.scopes))}")
            chunks = chunks.filter(in_folder(F.col("source"), self.scopes[scope.strip().casefold()]))
        if sources is not None:
            wanted = self.spark.createDataFrame([(s,) for s in sources], "source string")
            if missing := [r["source"] for r in wanted.join(chunks, "source", "left_anti").distinct().take(5)]:
                raise ValueError(f"unknown sources: {', '.join(sorted(missing))}")
        own = chunks.select("source").distinct()
        nodes = graph_views.materialize_nodes(own_rows("node_provenance").join(own, "source", "left_semi"))
        edges = graph_views.materialize_edges(own_rows("edge_provenance").join(own, "source", "left_semi"), self.table("edges"))
        ends = nodes.select(F.col("id").alias("__id"))
        edges = edges.join(ends, F.col("source") == F.col("__id"), "left_semi").join(ends, F.col("target") == F.col("__id"), "left_semi")
        return chunks, nodes, edges

    def search(self, query: str, scope: str | None = None, sources: Sequence[str] | None = None, top: int = 5) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(chunks, paths, references) for a query."""
        chunks, nodes, edges = self.restricted(scope, sources)
        vector = None
        if self.embed is not None:
            vector = self._query_vector(query)
            chunks = chunks.join(self._vectors_of("chunk_vectors"), "id", "left")
            if scope is None or sources is not None:  # a folder scope alone seeds the graph by names, not by meaning
                nodes = nodes.join(self._vectors_of("node_vectors"), "id", "left")
        hits, paths = hybrid.retrieve(chunks, nodes, edges, query, top, query_vector=vector)
        order = Window.orderBy(F.desc("score"), "best_rank", "index", "id")
        ranked = hits.withColumn("ord", F.row_number().over(order))
        return ranked, paths, references.source_references(ranked)

    def _query_vector(self, query: str) -> list[float]:
        return self.spark.range(1).select(self.embed(F.lit(query)).alias("v")).first()["v"]

    def _vectors_of(self, name: str) -> DataFrame:
        return self.table(name).filter(F.col("embedding_model") == self.model).select("id", "vector")

    def find_documents(self, query: str, scope: str | None = None, top: int = 5) -> DataFrame:
        """Documents for a query by metadata, by the passages it finds in all fields, and by name; a blank query raises."""
        if not query.strip():
            raise ValueError("the query is empty")
        if top < 1:
            raise ValueError("top must be positive")
        chunks, nodes, edges = self.restricted(scope)
        fields, vector = chunk_search.search_fields(chunk_search.annotated(chunks, nodes, edges)), None
        if self.embed is not None:
            vector = self._query_vector(query)
            fields = fields.join(self._vectors_of("chunk_vectors"), "id", "left")
        passages = chunk_search.top_chunks(chunk_search.chunk_scores(fields, query, vector), max(4 * top, 20))
        passages = passages.select("source", F.row_number().over(Window.orderBy(F.desc("score"), "index", "id")).alias("rank"))
        allowed = None if scope is None else chunks.select("source")
        return document_search.search_documents(document_search.catalog(self.table("chunks")), query, passages, allowed, top)

    def neighborhood(self, source: str, chunk_id: str) -> DataFrame:
        """A chunk of a source with the ids of the ones before and after it; an unknown one raises."""
        found = chunking.neighbours(self.table("chunks").filter(F.col("source") == source)).filter(F.col("id") == chunk_id)
        if found.isEmpty():
            raise LookupError(f"no chunk {chunk_id!r} in {source!r}")
        return found

    def lookup(self, source: str, ids: Sequence[str]) -> DataFrame:
        """The chunks of a source with the given ids, in the order asked for; unknown ones are left out. Only the source's
        folder is read."""
        asked = self.spark.createDataFrame([(i, source, id_) for i, id_ in enumerate(ids)], "ord int, source string, id string")
        return chunking.by_ids(self.store.read("chunks", [source]), asked).orderBy("ord").drop("ord")

    def document_graph(self, source: str) -> tuple[DataFrame, DataFrame]:
        """Nodes and edges that one source alone supports."""
        return self.restricted(sources=[source])[1:]

    def export(self, folder: str) -> None:
        """The graph for viewers, as a whole and by source; what lay in the folder is replaced."""
        nodes, edges = self.table("nodes"), self.table("edges")
        export.export_graph(nodes, edges, f"{folder}/all")
        homes = self.table("node_provenance").select(F.col("canonical_node_id").alias("id"), "source").distinct()
        export.export_by_source(export.viewer_nodes(nodes).join(homes, "id"), f"{folder}/sources")
