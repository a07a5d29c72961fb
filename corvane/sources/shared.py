"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where none is named, a session on this machine alone gets a temporary folder; a cluster must name one.
    """
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not named:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="corvane-"))
        named = context.getCheckpointDir()
    return named.rstrip("/")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Cuts the lineage: what a lost executor held is read again from the table, not recomputed.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/corvane-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """Written tables of one computation, which can be removed as soon as nothing reads them any more.

    As a context it removes, at its end, whatever is left; results must be computed before.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.tables = spark, []

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        while self.tables:
            self.remove(self.tables[-1][0])

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """As ``materialise``."""
        path = f"{shared_dir(self.spark)}/corvane-{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        written = self.spark.read.schema(df.schema).parquet(path)
        self.tables.append((written, path))
        return written

    def keep_only(self, *written: DataFrame) -> DataFrame:
        """Delete all tables but these, and return the first."""
        for other in [t for t, _ in self.tables if not any(t is w for w in written)]:
            self.remove(other)
        return written[0]

    def remove(self, written: DataFrame) -> None:
        """Delete a table that ``write`` returned."""
        path = next(p for t, p in self.tables if t is written)
        self.tables = [(t, p) for t, p in self.tables if t is not written]
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def checkpoint(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()
