"""Long messages in parts that a chat accepts."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST = 4096


def parts_of(text: str, most: int = MOST) -> list[str]:
    """Parts of at most ``most`` characters: cut at the last newline in reach, else the last blank, else anywhere."""
    if most < 1:
        raise ValueError("most must be positive")
    rest, parts = text.strip(), []
    while len(rest) > most:
        reach = rest[: most + 1]
        at = next((i for i in (reach.rfind("\n"), reach.rfind(" ")) if i > 0 and reach[:i].strip()), most)
        parts.append(rest[:at].rstrip())
        rest = rest[at:].lstrip()
    return [*parts, rest] if rest else parts


def split_messages(rows: DataFrame, most: int = MOST) -> DataFrame:
    """(id, part, text) of messages (id, text), parts from 0; null and blank messages have none."""

    def call(column: pa.Array) -> pa.Array:
        return pa.array([parts_of(t or "", most) for t in column.to_pylist()], pa.list_(pa.string()))

    call.__annotations__ = {"column": pa.Array, "return": pa.Array}
    return rows.select("id", F.posexplode(F.arrow_udf(call, returnType="array<string>")("text")).alias("part", "text"))
