"""Registered queries by name and the SQL that repeats them."""

from corvane.plans import knowledge_queries, maintenance_queries, retrieval_queries

FLAGSHIP = "hybrid_topk"
QUERIES = {**retrieval_queries.QUERIES, **knowledge_queries.QUERIES, **maintenance_queries.QUERIES}
ORACLES = {**retrieval_queries.ORACLES, **knowledge_queries.ORACLES, **maintenance_queries.ORACLES}
