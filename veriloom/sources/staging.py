"""Staged intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; where unset (local tests), a temporary folder that is made and set."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    found = spark.sparkContext._jsc.sc().getCheckpointDir()
    if found.isDefined():
        return found.get().rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):  # executors on other machines don't see a local folder
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    made = "file://" + tempfile.mkdtemp(prefix="veriloom-")
    spark.sparkContext.setCheckpointDir(made)
    return made


#: Has Spark delete the shuffle files of an execution when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of writes in here go when the write ends, as what it wrote is read back from its own files; otherwise those of
    all steps of a session lie on the disk together, until the driver happens to collect its garbage."""
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def staged(df: DataFrame, label: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` as Parquet and read it back: plans stay short, and what several results share is computed once."""
    path = f"{shared_dir(df.sparkSession)}/veriloom-{label}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    writer = writer.partitionBy(*partition_by) if partition_by else writer
    with tidy(df.sparkSession):
        writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def broadcast_if(staged_df: DataFrame, row_bytes: int, limit: int = 32 << 20) -> DataFrame:
    """A broadcast hint where the counted rows of a staged table prove that it is small; else the frame as it is."""
    return F.broadcast(staged_df) if staged_df.count() * row_bytes <= limit else staged_df


def spread(table: DataFrame) -> DataFrame:
    """A table scan, dealt out anew where its files give fewer tasks than twice the cores; a larger one as it is."""
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table.repartition(cores) if table.rdd.getNumPartitions() < 2 * cores else table


#: Rows of a task that :func:`dealt` aims at.
TASK_ROWS = 250_000


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``df`` by hash of the keys, in a task for each 250,000 of ``rows`` (at least one a core), so that a task's memory
    doesn't follow the size of the input."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // TASK_ROWS)), *keys)
