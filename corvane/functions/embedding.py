"""A deterministic stand-in for an embedding model."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from corvane.functions.text import tokenize


def hashing_embedder(dim: int = 64) -> Callable[[Column], Column]:
    """A function from texts to vectors that counts tokens by a hash: equal texts get equal vectors."""

    def embed(text: Column) -> Column:
        places = F.transform(tokenize(F.coalesce(text, F.lit(""))), lambda t: F.pmod(F.xxhash64(t), F.lit(dim)).cast("int"))
        return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda b: F.size(F.filter(places, lambda p: p == b)).cast("float"))

    return embed
