"""Pieces of oracle SQL for DuckDB."""

from __future__ import annotations

from corvane.operators.bm25 import query_terms


def bm25_ctes(name: str, source: str, key: str, text: str, query: str) -> str:
    """CTEs that end in ``name``(key, score): raw BM25 of ``text`` over the rows of ``source``."""
    terms = query_terms(query)
    tf = ", ".join(f"len(list_filter(t, lambda x: x = '{w}'))" for w in terms)
    df = ", ".join(f"sum(CASE WHEN tf[{i + 1}] > 0 THEN 1 ELSE 0 END)" for i in range(len(terms)))
    part = lambda i: f"CASE WHEN tf[{i}] > 0 AND m > 0 THEN ln(1e0 + (n - df[{i}] + 0.5e0) / (df[{i}] + 0.5e0)) * tf[{i}] * 2.5e0 / (tf[{i}] + 1.5e0 * (0.25e0 + 0.75e0 * dl / m)) ELSE 0e0 END"
    score = " + ".join(f"{often} * {part(i + 1)}" for i, often in enumerate(terms.values()))
    return f"""
{name}_t AS (SELECT {key} AS key, regexp_extract_all(lower(coalesce({text}, '')), '[a-z0-9]+') AS t FROM {source}),
{name}_l AS (SELECT key, len(t) AS dl, [{tf}] AS tf FROM {name}_t),
{name}_s AS (SELECT count(*) AS n, avg(dl) AS m, [{df}] AS df FROM {name}_l),
{name} AS (SELECT key, {score} AS score FROM {name}_l, {name}_s)
"""


def calibrated(score: str) -> str:
    """score / (score + 6), 0 where it is not positive."""
    return f"(CASE WHEN {score} > 0 THEN {score} / ({score} + 6e0) ELSE 0e0 END)"


def noisy_or(signals: list[tuple[str, float]]) -> str:
    """1 - product of (1 - signal * weight / largest weight)."""
    largest = max(w for _, w in signals)
    return "(1e0 - " + " * ".join(f"(1e0 - coalesce({s}, 0e0) * {w / largest!r}::DOUBLE)" for s, w in signals) + ")"


#: Array expressions in DuckDB for text keys.
def words(text: str) -> str:
    return f"regexp_extract_all(replace(lower({text}), 'ß', 'ss'), '[a-z0-9]+')"


def singular(word: str) -> str:
    return f"""CASE WHEN {word} LIKE '%ies' AND len({word}) > 4 THEN left({word}, len({word}) - 3) || 'y'
  WHEN regexp_matches({word}, '(ch|sh|ss|x|z)es$') AND len({word}) > 4 THEN left({word}, len({word}) - 2)
  WHEN {word} LIKE '%s' AND {word} NOT LIKE '%ss' AND len({word}) > 3 THEN left({word}, len({word}) - 1) ELSE {word} END"""


def entity_key(name: str) -> str:
    return f"array_to_string(list_transform({words(name)}, lambda w: {singular('w')}), ' ')"
