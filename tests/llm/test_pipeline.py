"""The corpus pipeline on the smallest data folder."""

import os

import pyarrow as pa
import pytest

import corpus_pipeline as p
from corvane.llm import decontaminate
from corvane.llm.common import BATCH_BYTES

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_stages_keep_columns_and_only_drop(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    before = docs
    for name, stage in p.STAGES[:-1]:
        after = stage(spark, before, DATA)
        assert after.columns == docs.columns, name
        assert after.exceptAll(before).isEmpty(), name
        before = p.materialise(after, name)
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    tables = decontaminate.Tables([(str(i), t.encode()) for i, t in items])
    assert not any(tables.search(decontaminate.words_of(r["text"].encode()))[0] for r in before.collect())
    mixed = p.STAGES[-1][1](spark, before, DATA)
    assert set(docs.columns) <= set(mixed.columns)
    assert mixed.select(docs.columns).distinct().exceptAll(before.distinct()).isEmpty()


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_texts_reach_python_in_small_batches(spark):
    """With the session's defaults a task holds a whole partition in one Arrow batch, on both sides."""
    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    try:
        p.keep_quality(spark, spark.createDataFrame([(1, "a b")], "doc_id long, text string"), DATA)
        rows = spark.range(6000, numPartitions=1).selectExpr("repeat(cast(id as string), 1000) AS text")
        sizes = rows.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.nbytes]}) for b in batches), "n long").collect()
        assert sum(r["n"] for r in sizes) > 20_000_000 and max(r["n"] for r in sizes) < 2 * BATCH_BYTES
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", before)
