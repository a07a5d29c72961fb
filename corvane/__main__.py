"""Command line of a knowledge base.

    python -m corvane sync BASE FOLDER --extractor package.module:name
    python -m corvane search BASE QUERY [--scope NAME] [--scopes FILE] [--top N]
    python -m corvane documents BASE QUERY [--scope NAME] [--scopes FILE] [--top N]
    python -m corvane export BASE FOLDER

Run with spark-submit or python; the session's settings are Spark's own.
"""

from __future__ import annotations

import argparse
import importlib
from collections.abc import Sequence

from pyspark.sql import SparkSession

from corvane.session import KnowledgeBase
from corvane.sources import files


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="corvane")
    commands = parser.add_subparsers(dest="command", required=True)
    for name, second in (("sync", "folder"), ("search", "query"), ("documents", "query"), ("export", "folder")):
        command = commands.add_parser(name)
        command.add_argument("base")
        command.add_argument(second)
        if name == "sync":
            command.add_argument("--extractor", required=True, help="package.module:name of an extractor")
        if second == "query":
            command.add_argument("--scope")
            command.add_argument("--scopes", help="JSON file of folder scopes")
            command.add_argument("--top", type=int, default=5)
    return parser


def main(arguments: Sequence[str] | None = None) -> int:
    """Run one command; results go to standard output, a line each."""
    given = _parser().parse_args(arguments)
    spark = SparkSession.builder.getOrCreate()
    scopes = files.read_scopes(spark, given.scopes) if getattr(given, "scopes", None) else None
    base = KnowledgeBase(spark, given.base, scopes)
    if given.command == "sync":
        module, _, name = given.extractor.partition(":")
        changes = base.sync(files.read_markdown(spark, given.folder), getattr(importlib.import_module(module), name))
        for row in changes.groupBy("change").count().orderBy("change").collect():
            print(f"{row['change']}: {row['count']}")
    elif given.command == "search":
        chunks, paths, references = base.search(given.query, given.scope, top=given.top)
        for row in chunks.orderBy("ord").collect():
            print(f"{row['score']:.4f} {row['source']} {row['id']}")
        for row in paths.collect():
            print(" > ".join(row["node_ids"]))
        for row in references.collect():
            print(*(value for value in row if value is not None))
    elif given.command == "documents":
        for row in base.find_documents(given.query, given.scope, given.top).collect():
            print(row["source"])
    else:
        base.export(given.folder)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
