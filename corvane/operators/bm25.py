"""BM25 over any number of text fields.

A query reads the texts once for the statistics and once for the scores, both times only counting its
own terms: no token is shuffled, and what crosses tasks is one row of sums per field. Where only some
columns are wanted beside the scores, the texts are read once: their counts are written, and both read those.
A corpus that is asked often is prepared: its postings are written by term, and a query reads only its terms' rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions.scoring import calibrate_bm25
from corvane.functions.text import tokenize
from corvane.operators.ranking import global_rank
from corvane.sources.shared import materialise

K1, B = 1.5, 0.75


def query_terms(query: str) -> dict[str, int]:
    """The query's tokens and how often each occurs, in order of first occurrence."""
    return dict(Counter(re.findall("[a-z0-9]+", query.lower())))


def term_score(tf: Column, length: Column, mean: Column, n: Column, df: Column) -> Column:
    """One term's part of a BM25 score."""
    idf = F.ln(1 + (n - df + 0.5) / (df + 0.5))
    return F.when((tf > 0) & (mean > 0), idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))).otherwise(0.0)


def bm25_scores(documents: DataFrame, query: str | Mapping[str, str], fields: Mapping[str, Column], keep: Sequence[str] | None = None) -> DataFrame:
    """``documents`` with a raw BM25 score per field, in columns of the fields' names.

    Every field has statistics of its own over the given rows, empty ones included. Repeated query tokens
    count as often as they occur; a null text is empty; without query tokens all scores are 0.
    Of several queries by name the terms are counted together, and a field's column is a struct of its scores by those names.
    With ``keep`` the rows have only these columns beside the scores. Each text is then read once: its counts are written,
    and the statistics and scores read those.
    """
    several = not isinstance(query, str)
    asks = {name: query_terms(q) for name, q in (query if several else {"score": query}).items()}
    by_query = lambda scores: F.struct(*[s.alias(q) for q, s in scores.items()]) if several else scores["score"]
    terms = list(dict.fromkeys(w for own in asks.values() for w in own))
    if not terms:
        rows = documents if keep is None else documents.select(*keep)
        return rows.withColumns({name: by_query(dict.fromkeys(asks, F.lit(0.0))) for name in fields})
    asked = F.array(*[F.lit(w) for w in terms])
    tokens = {f"__{name}": tokenize(F.coalesce(text, F.lit(""))) for name, text in fields.items()}
    count = lambda own: F.transform(asked, lambda w: F.size(F.filter(own, lambda t: t == w)))
    measured = documents.withColumns(tokens)
    measured = measured.withColumns({c: F.struct(F.size(c).alias("length"), F.filter(c, lambda t: t.isin(*terms)).alias("own")) for c in tokens})
    measured = measured.withColumns({c: F.struct(f"{c}.length", count(F.col(f"{c}.own")).alias("tf")) for c in tokens})
    if keep is not None:
        measured = materialise(measured.select(*keep, *tokens), "counts")
    sums = [F.count("*").alias("n")]
    for c in tokens:
        held = [F.sum((F.get(F.col(f"{c}.tf"), i) > 0).cast("long")) for i in range(len(terms))]
        sums += [F.avg(F.col(f"{c}.length")).alias(f"{c}_mean"), F.array(*held).alias(f"{c}_df")]
    totals = measured.agg(*sums).select(F.struct("*").alias("__totals"))  # one row
    scored = measured.crossJoin(F.broadcast(totals))
    for name in fields:
        scored = scored.withColumn(name, by_query({q: _score(name, terms, own) for q, own in asks.items()}))
    return scored.drop("__totals", *tokens)


def _score(field: str, terms: Sequence[str], own: Mapping[str, int]) -> Column:
    """A field's score for the query of the terms ``own``, from its counts and totals of all ``terms``."""
    length, mean, n = F.col(f"__{field}.length"), F.col(f"__totals.__{field}_mean"), F.col("__totals.n")
    often = F.array(*[F.lit(float(own.get(w, 0))) for w in terms])
    counts = F.arrays_zip(F.col(f"__{field}.tf").alias("tf"), F.col(f"__totals.__{field}_df").alias("df"), often.alias("often"))
    return F.aggregate(F.transform(counts, _part(length, mean, n)), F.lit(0.0), lambda a, x: a + x)


def _part(length: Column, mean: Column, n: Column):
    return lambda x: x["often"] * term_score(x["tf"], length, mean, n, x["df"])


def rank_documents(documents: DataFrame, query: str, text: Column, order: Column) -> DataFrame:
    """All ``documents``, zeros included, with ``score`` and ``rank``: by score, then by ``order``."""
    scored = bm25_scores(documents, query, {"score": text})
    return global_rank(scored, F.desc("score"), order)


def calibrated(documents: DataFrame, query: str, text: Column) -> DataFrame:
    """The documents with a positive score, calibrated to [0, 1)."""
    scored = bm25_scores(documents, query, {"score": text})
    return scored.withColumn("score", calibrate_bm25(F.col("score"))).filter(F.col("score") > 0)


class PreparedBM25:
    """A corpus whose postings are written once, sorted by term, for many queries."""

    def __init__(self, documents: DataFrame, id_column: str, text: Column, path: str):
        self.spark, self.id_column, self.path = documents.sparkSession, id_column, path
        rows = documents.select(F.col(id_column), tokenize(F.coalesce(text, F.lit(""))).alias("tokens"))
        lengths = rows.select(id_column, F.size("tokens").alias("length"), F.explode_outer("tokens").alias("term"))
        counts = lengths.groupBy(id_column, "length", "term").agg(F.count("term").alias("tf"))
        counts.repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/postings")
        rows.agg(F.count("*").alias("n"), F.avg(F.size("tokens")).alias("mean")).write.mode("overwrite").parquet(f"{path}/totals")

    def scores(self, query: str) -> DataFrame:
        """(id, score) of the documents that hold a term of the query; the filter on terms reaches the scan."""
        terms = query_terms(query)
        postings = self.spark.read.parquet(f"{self.path}/postings").filter(F.col("term").isin(*terms))
        totals = F.broadcast(self.spark.read.parquet(f"{self.path}/totals"))
        df = F.broadcast(postings.groupBy("term").agg(F.count("*").alias("df")))  # a row per query term
        often = F.create_map(*[F.lit(x) for pair in terms.items() for x in pair]) if terms else F.lit(None)
        part = F.element_at(often, F.col("term")) * term_score(F.col("tf"), F.col("length"), F.col("mean"), F.col("n"), F.col("df"))
        return postings.join(df, "term").crossJoin(totals).groupBy(self.id_column).agg(F.sum(part).alias("score"))
