"""Connected components of a link table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import checkpoint


def _with_least(links: DataFrame, least: DataFrame) -> DataFrame:
    """Join (u, v) with (u, m). The inverted key hides the aggregate's partitioning from the planner, so
    that both sides get an exchange of their own and a hub with very many links can be split among tasks."""
    left = links.select(F.bitwise_not("u").alias("k"), "u", "v")
    right = least.select(F.bitwise_not("u").alias("k"), "m")
    return left.join(right, "k").select("u", "v", "m")


def components(links: DataFrame) -> DataFrame:
    """From links (a, b) between long ids, (node, root): the smallest id that each linked node can reach.

    Nodes without a link to another are absent. Every round writes its links, a forest in the end, to a
    reliable checkpoint; links stay distributed, and only a count and a checksum reach the driver. Rounds
    are logarithmic in practice (at most the square of the logarithm is proven for the scheme).
    """
    links = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct()
    links, seen = checkpoint(links), None
    while True:
        now = links.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == seen or not now[0]:
            return links.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = now
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = _with_least(both, least).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = _with_least(large, least).filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        links = checkpoint(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
