"""Ranks over a whole table without bringing it into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.sources.shared import materialise

#: Bits of a place within a range, in the numbers that Spark gives to rows.
PLACE = 33


def global_rank(rows: DataFrame, *order: Column, name: str = "rank") -> DataFrame:
    """``rows`` with their 1-based place in a total ``order``.

    Rows are dealt out by ranges of the order and numbered within each as they are written, sorted; a range's first number is
    the count of all rows before it, from one number per range. So rows move once.
    """
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    dealt = materialise(dealt, "ranges").withColumn("__range", F.shiftright("__at", PLACE))
    sizes = dealt.groupBy("__range").agg(F.count("*").alias("n")).orderBy("__range").collect()
    before, offsets = 0, []
    for r in sizes:
        offsets.append((r["__range"], before))
        before += r["n"]
    first = rows.sparkSession.createDataFrame(offsets, "__range long, __before long")
    place = F.col("__at").bitwiseAND((1 << PLACE) - 1) + F.col("__before") + 1
    return dealt.join(F.broadcast(first), "__range").withColumn(name, place).drop("__range", "__at", "__before")
