"""The folder that driver and executors share, and small helpers for Arrow batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import DataType, StructType


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new path below ``spark.checkpoint.dir``, removed when the session's JVM ends.

    Where that setting is missing a local folder serves a local master; on a cluster it is an error, for
    executors would write where nobody else reads.
    """
    context = spark.sparkContext
    base = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="marlstone-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(base)
    path = f"{base.rstrip('/')}/marlstone/{name}-{uuid.uuid4().hex}"
    where = context._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(context._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def saved(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder as Parquet and read again, so that lineage ends there."""
    return saved_at(df, name)[0]


def saved_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """As ``saved``, with the path."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def removed(spark: SparkSession, path: str) -> None:
    """Delete what ``saved_at`` wrote, once nothing reads it any more."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def with_fields(df: DataFrame, **fields: str | DataType) -> StructType:
    """The schema of ``df`` with further fields."""
    out = StructType(list(df.schema.fields))
    for name, kind in fields.items():
        out = out.add(name, kind)
    return out


def slices(batch, rows: int):
    """Parts of an Arrow batch of at most ``rows`` rows."""
    for i in range(0, batch.num_rows, rows):
        yield batch.slice(i, rows)


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of at most ``rows`` rows for what runs inside, where rows are large; the session's setting comes back."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)
