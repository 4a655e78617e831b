"""Shared helpers of the training-data operators: table access, staging, training splits."""

from __future__ import annotations

import ctypes
import functools
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only where the session names none (local tests) a temporary folder is made and set.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    sc: SparkContext = spark.sparkContext
    found = sc._jsc.sc().getCheckpointDir()
    if found.isDefined():
        return found.get().rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):  # executors on other machines don't see a local folder
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    made = "file://" + tempfile.mkdtemp(prefix="veriloom-")
    sc.setCheckpointDir(made)
    return made


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends there, every executor can read it,
    and a lost executor costs a re-read instead of a recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/veriloom-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fold(doc_id: Column | str, modulus: int) -> Column:
    """``crc32(doc_id as text) mod modulus``, the split between training rows and held-out rows."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(c.cast("string").cast("binary")) % F.lit(modulus)


def only(df: DataFrame, *names: str) -> DataFrame:
    """The named columns by exact position, so that extra columns of any name do no harm."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def small(df: DataFrame, row_bytes: int, limit: int = 32 << 20) -> bool:
    """Whether a staged table is proven to fit a broadcast: its counted rows times ``row_bytes`` are below ``limit``."""
    return df.count() * row_bytes <= limit


def maybe_broadcast(df: DataFrame, row_bytes: int, limit: int = 32 << 20) -> DataFrame:
    """A broadcast hint where :func:`small` holds; otherwise the frame as it is, for a shuffled (skew-split) join."""
    return F.broadcast(df) if small(df, row_bytes, limit) else df


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` doesn't have, in any case."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id isn't among ``ids(doc_id)``, a staged table of distinct ids; null ids stay."""
    name = fresh(docs, "gone")
    return docs.join(maybe_broadcast(ids.select(F.col("doc_id").alias(name)), 16), F.col("`doc_id`") == F.col(name), "left_anti")


def _tidy(task: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``task``, and then free memory goes back to the system: a Python worker serves many tasks, and what one of them
    left in its heap would count against the next."""

    @functools.wraps(task)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from task(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
            if trim:
                trim(0)

    return run


#: The setting that bounds Arrow batches by bytes, and its value where a session has none.
BATCH_BYTES = ("spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20)


def in_arrow(df: DataFrame, task: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """``df.mapInArrow(task, schema)`` in batches bounded by bytes, for use with ``df.transform``.

    Spark bounds them by rows alone, and 10,000 long texts, or pairs of texts, stand several times in the memory of an
    executor: as buffers of the JVM that double while they grow, and again in the Python worker. A bound that the session
    has set already stays.
    """
    key, size = BATCH_BYTES
    if df.sparkSession.conf.get(key, None) is None:
        df.sparkSession.conf.set(key, str(size))
    return df.mapInArrow(_tidy(task), schema)
