"""Posting lists of an inverted index, whose entries are compared in blocks of bounded size.

A list is known by its entries: lists of equal entries are compared once. Nothing here holds a whole list: the first
pass compares the entries of each block, and the list's smallest entry goes to all of its blocks, so that a large group of
copies becomes one component at the cost of a pass. The second compares what the links left apart: of each list, the
entries that are not in its largest component meet all others, block by block. Pairs that are already in one component
are not compared, and of the others a spanning forest is put out, never all pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import materialise
from corvane.llm.components import components

#: Entries of a block, on average over a hash of them.
MEMBERS = 4096
#: Rows that a task gathers before it compares the lists among them.
GATHER = 1 << 16
#: Lists up to this length compare shifted rows, longer ones one entry with all others at a time.
SHORT = 48

Close = Callable[[np.ndarray, np.ndarray], np.ndarray]


def members_of(postings: DataFrame) -> DataFrame:
    """From postings (key, fp), one row for each, the entries (list, fp, parts, least) of lists of two or more: the list's
    name, its number of blocks and its smallest entry."""
    lists = postings.groupBy("key").agg(F.count("*").alias("m"), F.bit_xor(F.xxhash64("fp")).alias("list"), F.min("fp").alias("least")).filter("m > 1")
    # inverted keys, as in the rounds of components: a long list can be split among the tasks of the join
    lists = lists.select(F.bitwise_not("key").alias("k"), "list", F.ceil(F.col("m") / MEMBERS).cast("int").alias("parts"), "least")
    # Spark sizes exploded rows as those they come from, and would take all postings for small enough to broadcast
    own = postings.select(F.bitwise_not("key").alias("k"), "fp").hint("merge").join(lists, "k")
    return materialise(own.select("list", "fp", "parts", "least").distinct(), "lists")


def _block(parts: Column) -> Column:
    return F.pmod(F.xxhash64("fp"), parts).cast("int")


def gathered(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.Table]:
    """Batches sorted by ``keys``, joined to tables that never cut a group of equal keys."""
    held, rows = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows < GATHER:
            continue
        whole = pa.Table.from_batches(held).combine_chunks()
        cut = int(np.flatnonzero(_starts(whole, keys))[-1])
        if cut:
            yield whole.slice(0, cut)
        held, rows = whole.slice(cut).to_batches(), rows - cut
    if rows:
        yield pa.Table.from_batches(held).combine_chunks()


def _starts(rows: pa.Table, keys: tuple[str, ...]) -> np.ndarray:
    new = np.zeros(rows.num_rows, bool)
    new[:1] = True
    for key in keys:
        column = rows.column(key).to_numpy()
        new[1:] |= column[1:] != column[:-1]
    return new


def root_of(parent: np.ndarray) -> np.ndarray:
    while True:
        up = parent[parent]
        if np.array_equal(up, parent):
            return up
        parent = up


def unite(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Union of the pairs (a, b) in a forest whose entries point at their roots, the smallest of each tree."""
    while True:
        x, y = parent[a], parent[b]
        apart = x != y
        if not apart.any():
            return parent
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
        parent = root_of(parent)


def spanning(new: np.ndarray, parent: np.ndarray, side: np.ndarray | None, close: Close) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of close rows that join the rows of each group as all its close pairs would.

    ``new`` marks the first row of each group. Rows of one tree of ``parent`` (a row points at its root) need not be
    compared, nor do rows of one ``side`` where sides are given.
    """
    n = len(new)
    first = np.flatnonzero(new)
    size = np.diff(np.r_[first, n])
    left = np.repeat(first + size, size) - np.arange(n)  # rows from here to the group's end
    short = np.repeat(size <= SHORT, size)
    one, other = [], []

    def compare(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        nonlocal parent
        apart = parent[i] != parent[j]
        if side is not None:
            apart &= side[i] != side[j]
        i, j = i[apart], j[apart]
        if len(i):
            near = close(i, j)
            i, j = i[near], j[near]
            if len(i):
                # pairs of one call may close circles; few do, and a surplus link does no harm
                parent = unite(parent.copy(), i, j)
                one.append(i)
                other.append(j)

    for d in range(1, min(SHORT, int(size.max(initial=1)))):
        at = np.flatnonzero(short & (left > d))
        if not len(at):
            break
        compare(at, at + d)
    for k in np.flatnonzero(size > SHORT):
        rows = np.arange(first[k], first[k] + size[k])
        for i in rows[:-1]:
            after = rows[i - first[k] + 1 :]
            after = after[parent[after] != parent[i]]
            if len(after):
                compare(np.full(len(after), i), after)
    none = np.zeros(0, np.int64)
    return np.concatenate(one or [none]), np.concatenate(other or [none])


def _compared(make_close: Callable[[pa.Table], Close], with_sides: bool):
    keys = ("list", "one", "two")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in gathered(batches, keys):
            new = _starts(rows, keys)
            fp = rows.column("fp").to_numpy()
            parent = np.arange(len(fp))
            if with_sides:  # rows of one group and one component are joined from the start
                _, parent = np.unique(np.stack([np.cumsum(new), rows.column("root").to_numpy()], axis=1), axis=0, return_index=True, return_inverse=True)[1:]
                at = np.full(parent.max(initial=-1) + 1, len(fp))
                np.minimum.at(at, parent.ravel(), np.arange(len(fp)))
                parent = at[parent.ravel()]
            i, j = spanning(new, parent, rows.column("side").to_numpy() if with_sides else None, make_close(rows))
            yield pa.RecordBatch.from_arrays([pa.array(fp[i]), pa.array(fp[j])], ["a", "b"])

    return run


def _joined(rows: DataFrame, make_close: Callable[[pa.Table], Close], with_sides: bool) -> DataFrame:
    rows = rows.repartition("list", "one", "two").sortWithinPartitions("list", "one", "two", "fp")
    return rows.mapInArrow(_compared(make_close, with_sides), "a bigint, b bigint")


def first_links(members: DataFrame, data: DataFrame, make_close: Callable[[pa.Table], Close]) -> DataFrame:
    """Close pairs (a, b) that join the entries of each block, the list's smallest entry in all of them.

    ``data`` has a row (fp, data) for each entry; ``make_close`` makes the comparison of rows of a table with that column.
    """
    own = members.select("list", "fp", _block(F.col("parts")).alias("one"))
    heads = members.filter((F.col("parts") > 1) & (F.col("fp") == F.col("least")))
    heads = heads.select("list", "fp", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("one"))
    rows = own.unionByName(heads).distinct().withColumn("two", F.lit(0))
    return _joined(rows.join(data, "fp"), make_close, False).distinct()


def apart(members: DataFrame, links: DataFrame) -> DataFrame:
    """Rows (list, one, two, side, fp, root) of the lists that ``links`` do not make one component: the entries outside a
    list's largest component (side 1) in blocks that meet the blocks of all its entries (side 0)."""
    roots = components(links).withColumnRenamed("node", "fp")
    rooted = materialise(members.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "rooted")
    sizes = rooted.groupBy("list", "root").agg(F.count("*").alias("n")).groupBy("list")
    sizes = sizes.agg(F.max_by("root", "n").alias("main"), F.sum("n").alias("m"), F.max("n").alias("n")).filter("m > n")
    sizes = sizes.select(F.bitwise_not("list").alias("k"), "main", F.ceil((F.col("m") - F.col("n")) / MEMBERS).cast("int").alias("minor_parts"))
    rows = rooted.withColumn("k", F.bitwise_not("list")).join(sizes, "k")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    minor = rows.filter("root != main").select("list", "fp", "root", _block(F.col("minor_parts")).alias("one"), every(F.col("parts")).alias("two"), F.lit(1).alias("side"))
    whole = rows.select("list", "fp", "root", every(F.col("minor_parts")).alias("one"), _block(F.col("parts")).alias("two"), F.lit(0).alias("side"))
    return minor.unionByName(whole)


def second_links(rows: DataFrame, data: DataFrame, make_close: Callable[[pa.Table], Close]) -> DataFrame:
    """Close pairs (a, b) between different components, from the rows of ``apart``."""
    return _joined(rows.join(data, "fp"), make_close, True)


def with_partner(rows: DataFrame, data: DataFrame, make_close: Callable[[pa.Table], Close]) -> DataFrame:
    """Of the rows of ``apart``, those that are close to a row of another side and component."""
    keys = ("list", "one", "two")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in gathered(batches, keys):
            new = _starts(table, keys)
            first = np.flatnonzero(new)
            root, side = table.column("root").to_numpy(), table.column("side").to_numpy()
            close, met = make_close(table), np.zeros(len(new), bool)
            for a, b in zip(first, [*first[1:], len(new)], strict=True):
                minor, others = a + np.flatnonzero(side[a:b] == 1), a + np.flatnonzero(side[a:b] == 0)
                step = max(1, (1 << 18) // max(1, len(others)))
                for at in range(0, len(minor), step):
                    i, j = (x.ravel() for x in np.meshgrid(minor[at : at + step], others, indexing="ij"))
                    differ = root[i] != root[j]
                    i, j = i[differ], j[differ]
                    near = close(i, j)
                    met[i[near]] = met[j[near]] = True
            yield table.filter(pa.array(met)).select(["list", "one", "two", "side", "fp", "root"]).combine_chunks().to_batches()[0] if met.any() else empty

    kinds = "list bigint, one int, two int, side int, fp bigint, root bigint"
    empty = pa.RecordBatch.from_pylist([], pa.schema([("list", pa.int64()), ("one", pa.int32()), ("two", pa.int32()), ("side", pa.int32()), ("fp", pa.int64()), ("root", pa.int64())]))
    joined = rows.join(data, "fp").repartition("list", "one", "two").sortWithinPartitions("list", "one", "two", "fp")
    return joined.select("list", "one", "two", "side", "fp", "root", "data").mapInArrow(run, kinds)
