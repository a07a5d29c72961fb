"""References to sources: merged page ranges and their labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def source_references(hits: DataFrame) -> DataFrame:
    """From hits (ord, source, page_start, page_end), the references: source_ord, source, page_start, page_end.

    A source with an unpaged hit is one reference without pages. Otherwise its ranges are merged where one starts at
    most a page after the ranges before it end. Sources go by their first hit.
    """
    ordered = Window.partitionBy("source").orderBy("page_start", "page_end", "ord")
    paged = hits.groupBy("source").agg(F.min("ord").alias("source_ord"), F.max(F.col("page_start").isNull()).alias("unpaged"))
    bare = paged.filter("unpaged").select("source_ord", "source", F.lit(None).cast("int").alias("page_start"), F.lit(None).cast("int").alias("page_end"))
    before = F.max("page_end").over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    rows = hits.join(paged.filter("not unpaged"), "source").withColumn("opens", (before.isNull() | (F.col("page_start") > before + 1)).cast("int"))
    rows = rows.withColumn("island", F.sum("opens").over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
    merged = rows.groupBy("source_ord", "source", "island").agg(F.min("page_start").alias("page_start"), F.max("page_end").alias("page_end")).drop("island")
    return merged.unionByName(bare)


def location_label(source: Column, start: Column, end: Column) -> Column:
    """``p. 3``, ``pp. 3-5``, or slides for presentations; null without pages."""
    slides = F.lower(source).endswith(".pptx")
    one, many = F.when(slides, "slide ").otherwise("p. "), F.when(slides, "slides ").otherwise("pp. ")
    return F.when(start.isNull(), None).when(start == end, F.concat(one, start.cast("string"))).otherwise(F.concat(many, start.cast("string"), F.lit("-"), end.cast("string")))


def reference_label(source: Column, start: Column, end: Column) -> Column:
    """A source, and its location in brackets where it has one."""
    location = location_label(source, start, end)
    return F.when(location.isNull(), source).otherwise(F.concat(source, F.lit(" ("), location, F.lit(")")))
