"""Research ledgers as batch operators: evidence once each, references in order, conversations within a budget."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.operators.ranking import global_rank


def evidence(rows: DataFrame, key: list[str]) -> DataFrame:
    """Evidence rows (ord, subquestion, *key) once by key, in order of first appearance, with all their subquestions."""
    grouped = rows.groupBy(*key).agg(F.min("ord").alias("first"), F.array_sort(F.collect_set("subquestion")).alias("subquestions"), F.count("*").alias("times"))
    return grouped


def registry(references: DataFrame) -> DataFrame:
    """References (ord, source, page_start, page_end) once each with ``name`` S1, S2, ... in order of first appearance, numbered
    by ranges of that order."""
    once = references.groupBy("source", "page_start", "page_end").agg(F.min("ord").alias("first"))
    once = global_rank(once, F.col("first"), F.col("source"), F.col("page_start"), F.col("page_end"), name="number")
    return once.withColumn("name", F.concat(F.lit("S"), F.col("number").cast("string"))).drop("number")


def compacted(turns: DataFrame, trigger: int = 256_000, retain: int = 64_000) -> DataFrame:
    """Turns (conv_id, turn, role, tokens) with ``keeps``: conversations of at most ``trigger`` tokens keep all their turns,
    others the longest end that starts with a user's turn and has at most ``retain`` tokens, or at least the last turn; the
    rest is to be summarised."""
    back = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    whole = Window.partitionBy("conv_id")
    upto = F.sum("tokens").over(back.rowsBetween(Window.unboundedPreceding, 0))
    rows = turns.withColumns({"__upto": upto, "__all": F.sum("tokens").over(whole)})
    starts = F.when((F.col("role") == "user") & (F.col("__upto") <= retain), F.col("turn"))
    rows = rows.withColumn("__start", F.coalesce(F.min(starts).over(whole), F.max("turn").over(whole)))
    keeps = (F.col("__all") <= trigger) | F.coalesce(F.col("turn") >= F.col("__start"), F.lit(False))
    return rows.withColumn("keeps", keeps).drop("__upto", "__all", "__start")
