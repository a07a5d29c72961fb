"""Approximate nearest neighbours by cross-polytope hashing.

Each table rotates unit vectors by three rounds of random signs and a fast Hadamard transform and
assigns them to the nearest signed axis. Every row is indexed once per table; queries probe the
axes nearest to them in each. What meets in an axis is scored exactly, in blocks: axes with many
rows or many queries are cut into cells of bounded size, so a common vector or direction is spread
over tasks. Equal vectors are indexed once with their smallest ids, all that a result can need.
Queries that find too few candidates probe every axis of one table, which holds every row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.llm.common import materialise, table

#: Tables and probes per table: measured recall at 5 of at least 0.95 on random 64-dimensional vectors.
TABLES, PROBES = 4, 28
#: Vectors and query vectors of one cell at most, on average over a hash of their ids.
CELL, CELL_QUERIES = 4096, 2048
SEED = 20_011


def rotate(x: np.ndarray, number: int) -> np.ndarray:
    """Pseudo-rotation ``number`` of the rows: signs and a fast Hadamard transform, three times, zero-padded."""
    n, d = x.shape
    size = 1 << max(0, d - 1).bit_length()
    signs = np.random.default_rng(SEED + number).choice(np.array([-1.0, 1.0]), (3, size))
    y = np.zeros((n, size))
    y[:, :d] = x
    for s in signs:
        y = y * s
        h = 1
        while h < size:
            y = y.reshape(n, size // (2 * h), 2, h)
            y = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(n, size)
            h *= 2
        y /= np.sqrt(size)
    return y


def signed_axes(y: np.ndarray, most: int) -> np.ndarray:
    """The ``most`` signed axes nearest to each row, nearest first: i for +i, size + i for -i."""
    both = np.concatenate([y, -y], axis=1)
    return np.argsort(-both, axis=1, kind="stable")[:, :most]


def _distinct(kind: str, k: int):
    """Usable vectors of a batch, equal ones once: their bytes, the k smallest ids, the smallest query id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, batch in enumerate(batches):
            seen: dict[bytes, list[int]] = {}
            for vec_id, vector in zip(batch.column("vec_id").to_pylist(), batch.column("embedding").to_pylist(), strict=True):
                if vec_id is None or not vector or None in vector:
                    continue
                v = np.array(vector, kind)
                most = float(np.abs(v).max())
                if not np.isfinite(v).all() or not most:
                    continue
                if not 1e-100 < most < 1e100:
                    v = v / most
                seen.setdefault((v + 0.0).astype(kind).tobytes(), []).append(vec_id)
            ids = [sorted(x)[:k] for x in seen.values()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(seen), pa.binary()), pa.array(ids, pa.list_(pa.int64())), pa.array([number % 256] * len(ids), pa.int32())],
                ["vector", "ids", "salt"],
            )

    return run


def _hashed(kind: str, tables: int, probes: int):
    """Adds to (vector, ids, query) the axis in each table, and for queries the probed axes of all tables."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column("vector").to_pylist()
            asked = batch.column("query").is_valid().to_numpy(zero_copy_only=False)
            axes: list = [None] * len(raw)
            probed: list = [None] * len(raw)
            sizes = np.array([len(b) for b in raw])
            for size in np.unique(sizes):
                at = np.flatnonzero(sizes == size)
                x = np.frombuffer(b"".join(raw[i] for i in at), kind).reshape(len(at), -1).astype(np.float64)
                x = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
                turned = [rotate(x, t) for t in range(tables)]
                near = np.stack([signed_axes(y, 1)[:, 0] for y in turned], axis=1)
                wide = np.concatenate([signed_axes(y[asked[at]], probes) for y in turned], axis=1)
                for i, row in zip(at, near.tolist(), strict=True):
                    axes[i] = row
                for i, row in zip(at[asked[at]], wide.tolist(), strict=True):
                    probed[i] = row
            lists = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(axes, lists), pa.array(probed, lists)], ["vector", "ids", "query", "axes", "probed"])

    return run


def _nearest(kind: str, k: int):
    def run(rows: pa.Table, queries: pa.Table) -> pa.Table:
        schema = pa.schema([("query", pa.int64()), ("ids", pa.list_(pa.int64())), ("score", pa.float64())])
        if not rows.num_rows or not queries.num_rows:
            return schema.empty_table()
        unpack = lambda c: np.frombuffer(b"".join(c.to_pylist()), kind).reshape(len(c), -1).astype(np.float64)
        x, q, ids = unpack(rows.column("vector")), unpack(queries.column("asked")), rows.column("ids").to_pylist()
        x_norm, q_norm = np.sqrt((x * x).sum(axis=1)), np.sqrt((q * q).sum(axis=1))
        first = np.array([i[0] for i in ids])
        found_q, found_x, scores = [], [], []
        for a in range(0, len(q), 256):
            near = np.round((q[a : a + 256] @ x.T) / (q_norm[a : a + 256, None] * x_norm), 12)
            for i, row in enumerate(near):
                pool = np.flatnonzero(row >= np.partition(row, -k)[-k]) if len(row) > k else np.arange(len(row))
                best = pool[np.lexsort((first[pool], -row[pool]))[:k]]
                exact = (x[best] * q[a + i]).sum(axis=1) / (x_norm[best] * q_norm[a + i])
                found_q += [a + i] * len(best)
                found_x += best.tolist()
                scores += exact.tolist()
        names = queries.column("name").to_pylist()
        return pa.Table.from_arrays([pa.array([names[i] for i in found_q], pa.int64()), pa.array([ids[i] for i in found_x], pa.list_(pa.int64())), pa.array(scores, pa.float64())], schema=schema)

    return run


def _in_cells(hashed: DataFrame, queries: DataFrame, kind: str, k: int) -> DataFrame:
    """Nearest candidates (query, ids, score) of queries (query, vector, dim, t, axis) among the indexed rows."""
    place = ["dim", "t", "axis"]
    rows = hashed.select("vector", "ids", F.octet_length("vector").alias("dim"), F.posexplode("axes").alias("t", "axis"))
    # two numbers for each axis of each table
    counts = rows.groupBy(*place).agg(F.count("*").alias("n")).join(queries.groupBy(*place).agg(F.count("*").alias("m")), place)
    cuts = counts.select(*place, F.ceil(F.col("n") / CELL).cast("int").alias("row_cells"), F.ceil(F.col("m") / CELL_QUERIES).cast("int").alias("query_cells"))
    own = lambda c, n: F.pmod(F.xxhash64(c), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    left = rows.join(cuts, place).select(*place, own("vector", F.col("row_cells")).alias("r"), every(F.col("query_cells")).alias("q"), "vector", "ids")
    right = queries.join(cuts, place).select(*place, every(F.col("row_cells")).alias("r"), own("vector", F.col("query_cells")).alias("q"), F.col("vector").alias("asked"), F.col("query").alias("name"))
    cell = [*place, "r", "q"]
    return left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInArrow(_nearest(kind, k), "query bigint, ids array<bigint>, score double")


def _best(found: DataFrame, k: int) -> DataFrame:
    """The k best distinct vectors of each query."""
    once = found.groupBy("query", F.col("ids")[0].alias("first")).agg(F.max("score").alias("score"), F.first("ids").alias("ids"))
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "first"))
    return once.withColumn("rank", rank).filter(F.col("rank") <= k).select("query", "ids", "score")


def nearest_neighbours(vectors: DataFrame, is_query, k: int = 5, tables: int = TABLES, probes: int = PROBES) -> DataFrame:
    """query_id, rank, vec_id, score: for rows (vec_id, embedding) where ``is_query`` (a condition) holds, the k
    nearest other rows by cosine in double precision, ties to the smaller id.

    Vectors that are null, empty or zero, or hold null or non-finite components, take no part, nor do null
    ids; vectors of different lengths never meet. Repeated rows (same id, same vector) count once.
    """
    kind = "<f4" if dict(vectors.dtypes)["embedding"] == "array<float>" else "<f8"
    usable = vectors.select("vec_id", "embedding")
    parts = usable.mapInArrow(_distinct(kind, k + 1), "vector binary, ids array<bigint>, salt int")
    smallest = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, k + 1).alias("ids")
    merged = parts.groupBy("vector", "salt").agg(smallest).groupBy("vector").agg(smallest)
    asked = usable.filter(is_query).mapInArrow(_distinct(kind, 1 << 30), "vector binary, ids array<bigint>, salt int")
    asked = materialise(asked.select("vector", F.explode("ids").alias("query_id")).distinct(), "queries")
    names = materialise(asked.groupBy("vector").agg(F.min("query_id").alias("query")), "names")
    hashed = merged.join(names, "vector", "left").select("vector", "ids", "query")
    hashed = materialise(hashed.mapInArrow(_hashed(kind, tables, probes), "vector binary, ids array<bigint>, query bigint, axes array<int>, probed array<int>"), "hashed")
    queries = hashed.filter("query is not null").select("query", "vector", F.octet_length("vector").alias("dim"), F.posexplode("probed").alias("p", "axis"))
    # a row of the short lengths has fewer axes than probes
    per_table = F.greatest(F.lit(1), F.least(F.lit(probes), _axes(kind)))
    queries = queries.select("query", "vector", "dim", F.floor(F.col("p") / per_table).cast("int").alias("t"), "axis")
    found = materialise(_best(_in_cells(hashed, queries, kind, k + 1), k + 1), "nearest")
    ids = found.groupBy("query").agg(F.sum(F.size("ids")).alias("n"))
    few = hashed.filter("query is not null").join(ids, "query", "left").filter(F.coalesce("n", F.lit(0)) <= k)
    few = few.select("query", "vector", F.octet_length("vector").alias("dim")).withColumn("t", F.lit(0))
    few = materialise(few.withColumn("axis", F.explode(F.sequence(F.lit(0), _axes(kind) - 1))), "few")
    if few.take(1):
        found = found.unionByName(_in_cells(hashed, few, kind, k + 1))
        found = _best(found, k + 1)
    each = asked.join(names, "vector").select("query_id", "query").join(found, "query")
    pairs = each.select("query_id", F.explode("ids").alias("vec_id"), "score").filter("vec_id != query_id")
    pairs = pairs.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return pairs.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _axes(kind: str):
    """Signed axes of a row by its length in bytes: twice the next power of two of its dimension."""
    dim = F.col("dim") / int(kind[-1])
    return (2 * F.pow(F.lit(2.0), F.ceil(F.log2(dim)))).cast("int")


def op10_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest rows of every row whose id is divisible by 50."""
    return nearest_neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
