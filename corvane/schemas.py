"""Schemas of the engine's tables, as DDL.

Arrays that stand for an order carry it explicitly (``ord``, ``index``); row order never means anything.
``properties`` is a JSON object with sorted keys, or null.
"""

CHUNKS = "id STRING, source STRING, index INT, text STRING, heading_path ARRAY<STRING>, page_start INT, page_end INT"
NODES = "id STRING, label STRING, type STRING, suggested_type STRING, aliases ARRAY<STRING>, properties STRING, chunk_ids ARRAY<STRING>"
EDGES = "id STRING, source STRING, target STRING, label STRING, properties STRING, chunk_ids ARRAY<STRING>"
NODE_PROVENANCE = (
    "canonical_node_id STRING, ord INT, source STRING, content_hash STRING, node_id STRING, label STRING, type STRING, "
    "suggested_type STRING, aliases ARRAY<STRING>, properties STRING, chunk_ids ARRAY<STRING>, resolution_aliases ARRAY<STRING>"
)
EDGE_PROVENANCE = (
    "canonical_edge_id STRING, ord INT, source STRING, content_hash STRING, edge_id STRING, source_node_id STRING, "
    "target_node_id STRING, label STRING, properties STRING, chunk_ids ARRAY<STRING>"
)
EMBEDDINGS = "id STRING, embedding_model STRING, embedding_input_hash STRING, vector ARRAY<FLOAT>"
SUGGESTIONS = (
    "suggested_type STRING, normalized_suggested_type STRING, node_id STRING, node_label STRING, current_type STRING, "
    "source STRING, chunk_id STRING, created_at TIMESTAMP"
)
TRANSCRIPT = "source STRING, index INT, start_ms BIGINT, end_ms BIGINT, text STRING"
CORRECTIONS = "id STRING, source STRING, chunk INT, original STRING, replacement STRING, context STRING, decision STRING, reviewed BOOLEAN"
