"""Mixing sources to target weights: repetition rates per source, whole copies plus one Bernoulli copy.

Sizes are summed per source (partial sums before the shuffle, so a hot source costs no more than
another), shares are poured into the sources by weight up to a cap, and each document is emitted
``floor(rate)`` times plus once more with the fraction as its probability, drawn from a hash of its
id and text. One row per source is all that meets in a single task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.llm.common import materialise, SPACE_CLASS, table, unused, WORD_CLASS

#: Rows up to which the table of targets (one per source) is broadcast; beyond it, it is joined by shuffle.
BROADCAST_SOURCES = 100_000


def word_count(text: Column) -> Column:
    """Words (runs free of ASCII whitespace) of a text; null has none."""
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE_CLASS), "")).cast("long")


def draw(doc_id: Column, text: Column) -> Column:
    """A number in [0, 1) from the md5 of id and text; null counts as empty, equal rows draw alike."""
    seed = F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("")), F.md5(F.coalesce(text, F.lit("")).cast("binary")))
    return F.conv(F.substring(F.md5(seed.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(16**13))


def source_targets(sizes: DataFrame, weights: Sequence[float] = (3, 1, 2), budget: float = 1.5, cap: float = 2.0) -> DataFrame:
    """From (source, source_size), the words to take from each source: columns source, source_size, target.

    Sources by code point, null last, take ``weights`` in turn and share ``budget`` times all words. No
    target exceeds ``cap`` times its source; the excess goes to the others by weight until none does.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (((F.row_number().over(by_name) - 1) % len(weights)) + 1).cast("int"))
    poured = sizes.select("source", "source_size", w.alias("w")).withColumn("room", cap * F.col("source_size"))
    everyone = Window.partitionBy()
    before = Window.orderBy((F.col("room") / F.col("w")).asc(), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    poured = poured.withColumns(
        {
            "share": budget * F.sum("source_size").over(everyone),
            "all_w": F.sum("w").over(everyone),
            "room_before": F.coalesce(F.sum("room").over(before), F.lit(0.0)),
            "w_before": F.coalesce(F.sum("w").over(before), F.lit(0.0)),
        }
    )
    full = (F.col("share") - F.col("room_before")) / (F.col("all_w") - F.col("w_before")) >= F.col("room") / F.col("w")
    poured = poured.withColumn("full", full)
    left = F.col("share") - F.coalesce(F.sum(F.when(F.col("full"), F.col("room"))).over(everyone), F.lit(0.0))
    open_w = F.sum(F.when(~F.col("full"), F.col("w"))).over(everyone)
    target = F.when(F.col("full"), F.col("room")).otherwise(F.least(F.col("room"), F.col("w") * (left / open_w)))
    return poured.select("source", "source_size", target.alias("target"))


def plan_mix(documents: DataFrame, weights: Sequence[float] = (3, 1, 2), budget: float = 1.5, cap: float = 2.0, into: str = "mix") -> DataFrame:
    """``documents`` with a struct ``into`` (size, source_size, target, copies), one row per document.

    Null texts have size 0; a null source is a source of its own; a source without words has rate 0.
    Equal rows get equal copies, and reruns agree.
    """
    sizes = documents.groupBy("source").agg(F.sum(word_count(F.col("text"))).alias("source_size"))
    targets = source_targets(sizes, weights, budget, cap)
    source, target = (unused(documents, name) for name in ("its_source", "its_target"))
    t = targets.select(F.col("source").alias(source), F.struct("source_size", "target").alias(target))
    t = materialise(t, "targets")
    small = t.count() <= BROADCAST_SOURCES
    joined = documents.join(F.broadcast(t) if small else t, F.col("source").eqNullSafe(F.col(source)), "left")
    rate = F.when(F.col(f"{target}.source_size") > 0, F.col(f"{target}.target") / F.col(f"{target}.source_size")).otherwise(0.0)
    copies = F.floor(rate) + F.when(draw(F.col("doc_id"), F.col("text")) < rate - F.floor(rate), 1).otherwise(0)
    mix = F.struct(word_count(F.col("text")).alias("size"), F.col(f"{target}.source_size").alias("source_size"), F.col(f"{target}.target").alias("target"), copies.cast("long").alias("copies"))
    return joined.withColumn(into, mix).drop(source, target)


def mix_documents(documents: DataFrame, weights: Sequence[float] = (3, 1, 2), budget: float = 1.5, cap: float = 2.0) -> DataFrame:
    """The mixture: every document as often as its source's rate says, its copies numbered from 1 in ``mix_copy``
    (a column of that name is replaced)."""
    own = unused(documents, "mix")
    planned = plan_mix(documents, weights, budget, cap, own).filter(F.col(f"{own}.copies") > 0)
    return planned.withColumn("mix_copy", F.explode(F.sequence(F.lit(1), F.col(f"{own}.copies").cast("int")))).drop(own)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size, source size, target and words taken of every document."""
    planned = plan_mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return planned.select("doc_id", F.col("mix.size").alias("size"), F.col("mix.source_size").alias("source_size"), F.col("mix.target").alias("target"), (F.col("mix.size") * F.col("mix.copies")).alias("taken"))


MIX_CTE = rf"""
z AS (SELECT *, len(regexp_extract_all(coalesce(text, ''), '{WORD_CLASS}'))::BIGINT AS size,
        ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u FROM {{documents}}),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM z GROUP BY source),
w AS (SELECT *, [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w, 2.0::DOUBLE * source_size AS room FROM s),
p AS (SELECT *, 1.5::DOUBLE * sum(source_size) OVER () AS share, sum(w) OVER () AS all_w,
        coalesce(sum(room) OVER (ORDER BY room / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room_before,
        coalesce(sum(w) OVER (ORDER BY room / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS w_before FROM w),
f AS (SELECT *, (share - room_before) / (all_w - w_before) >= room / w AS is_full FROM p),
t AS (SELECT source, source_size, CASE WHEN is_full THEN room ELSE least(room, w * ((share - coalesce(sum(CASE WHEN is_full THEN room END) OVER (), 0))
        / sum(CASE WHEN NOT is_full THEN w END) OVER ())) END AS target FROM f),
m AS (SELECT z.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate
      FROM z JOIN t ON z.source IS NOT DISTINCT FROM t.source),
x AS (SELECT *, (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END)::BIGINT AS copies FROM m)
"""

OP8_SQL = "WITH " + MIX_CTE.format(documents="documents") + "SELECT doc_id, size, source_size, target, size * copies AS taken FROM x"
