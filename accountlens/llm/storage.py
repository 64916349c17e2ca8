"""The folder that driver and executors share, for checkpoints and written tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; a temporary folder only where that is unset and Spark runs on this machine alone."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir is unset: the executors need a folder that they share")
        folder = f"file://{tempfile.mkdtemp(prefix='spark-')}"
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """The same rows, read from the shared folder: lineage ends here, and a lost executor costs no rerun."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame, name: str, path: str | None = None, part_bytes: int | None = None) -> DataFrame:
    """The same rows, from Parquet files in the shared folder: at a new path, or the given one if the caller is to discard them. part_bytes: what a task holds of a file before it writes it."""
    path = path or new_path(df.sparkSession, name)
    writer = df.write.option("parquet.block.size", part_bytes) if part_bytes else df.write
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Removes a table that new_path() named and that nothing reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Inside, Spark removes the shuffle files of a query as it ends, rather than when the driver happens to collect its garbage. The session's own setting comes back."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before) if before is not None else spark.conf.unset(name)
