"""Documents, ledgers and settings in files, read by Spark."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.functions.text import in_folder
from corvane.schemas import CORRECTIONS

MARKDOWN = (".md",)
#: Formats that are converted to Markdown outside of the engine.
CONVERTED = (".pdf", ".pptx", ".flac", ".m4a", ".mp3", ".mp4", ".mpeg", ".mpga", ".ogg", ".wav", ".webm")


def discover(spark: SparkSession, folder: str, suffixes: Sequence[str] = MARKDOWN + CONVERTED) -> DataFrame:
    """(path, length, modificationTime) of the files under a folder with one of the suffixes, in any case."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).drop("content")
    ending = F.lower(F.regexp_extract("path", r"(\.[^./]*)$", 1))
    return files.filter(ending.isin(*suffixes))


def relative(path: Column, folder: str) -> Column:
    """A file's path below a folder; local paths may come with or without their scheme."""
    plain = F.regexp_replace(path, "^file:/+", "/")
    return F.substring_index(plain, re.sub("^file:/+", "/", folder).rstrip("/") + "/", -1)


def read_markdown(spark: SparkSession, folder: str) -> DataFrame:
    """(source, markdown) of the Markdown files under a folder: paths relative to it, newlines made alike."""
    rows = spark.read.option("recursiveFileLookup", True).text(folder, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    rows = rows.filter(F.lower("path").endswith(".md"))
    return rows.select(relative(F.col("path"), folder).alias("source"), F.regexp_replace("value", "\r\n?", "\n").alias("markdown"))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line, value): the lines of text files with their numbers from 1, however files are split among tasks.

    Lines are numbered within their split; splits lie in order of their first byte, so a line's number is its own and the
    number of lines in the file's earlier splits.
    """
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("order"), "value")
    own = F.row_number().over(Window.partitionBy("path", "split").orderBy("order"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("path").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    splits = rows.groupBy("path", "split").agg(F.count("*").alias("n")).withColumn("before", before).drop("n")
    return rows.withColumn("own", own).join(splits, ["path", "split"]).select("path", (F.col("own") + F.col("before")).alias("line"), "value")


def read_corrections(spark: SparkSession, path: str) -> DataFrame:
    """A ledger of corrections, a JSON object per line; blank lines are skipped, others that do not parse raise with their
    number. Lines are numbered only where one does not parse."""
    parsed = F.from_json("value", CORRECTIONS, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "broken"})
    fields = F.from_json("value", f"{CORRECTIONS}, broken STRING", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "broken"})
    bad = (F.trim("value") != "") & (fields["broken"].isNotNull() | fields["id"].isNull())
    if not spark.read.text(path).filter(bad).isEmpty():
        first = numbered_lines(spark, path).filter(bad).orderBy("path", "line").first()
        raise ValueError(f"invalid correction in {first['path']} on line {first['line']}")
    return spark.read.text(path).filter(F.trim("value") != "").select(parsed.alias("r")).select("r.*")


def write_corrections(rows: DataFrame, path: str) -> None:
    """Write a ledger sorted by chunk and id."""
    rows.orderBy("source", "chunk", "id").write.mode("overwrite").json(path)


def read_scopes(spark: SparkSession, path: str, root: str = "documents") -> dict[str, str]:
    """Folder scopes by case-folded name from a JSON object {name: folder}: a small settings file.

    Names are not empty, not ``all`` and differ; folders lie under ``root`` and have no ``.`` or ``..``.
    """
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,string>", {"mode": "FAILFAST"})).alias("name", "folder")).collect()
    scopes: dict[str, str] = {}
    for name, folder in rows:
        key, parts = name.strip().casefold(), folder.replace("\\", "/").strip("/").split("/")
        if not key or key == "all" or key in scopes or parts[0] != root or {".", "..", ""} & set(parts):
            raise ValueError(f"invalid scope {name!r}: {folder!r}")
        scopes[key] = "/".join(parts)
    return scopes


def read_terms(spark: SparkSession, path: str) -> list[str]:
    """A glossary, {"terms": [...]}: a small settings file. Terms are trimmed; an empty one raises, no file is no terms."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return []
    row = spark.read.text(path, wholetext=True).select(F.from_json("value", "terms array<string>", {"mode": "FAILFAST"})["terms"].alias("terms")).first()
    terms = [(t or "").strip() for t in (row["terms"] or [])]
    if not all(terms):
        raise ValueError(f"the glossary {path!r} contains an empty term")
    return terms


def scoped(rows: DataFrame, scopes: dict[str, str], scope: str | None) -> DataFrame:
    """Rows whose source lies in the folder of a scope; no scope, all rows; an unknown one raises."""
    if scope is None:
        return rows
    if scope.strip().casefold() not in scopes:
        raise ValueError(f"unknown scope {scope!r}; there are {', '.join(sorted(scopes))}")
    return rows.filter(in_folder(F.col("source"), scopes[scope.strip().casefold()]))
