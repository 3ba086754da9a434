"""Where a job keeps what it must be able to read again after losing executors."""

from __future__ import annotations

import ctypes
import gc
import math
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

Work = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]
#: Settings of Arrow batches: Spark's default, and what the library sets in its place.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "1000"), "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "8m")}

#: Rows that one task gets of what dealt() deals out.
PER_TASK = 1 << 19


def ready(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package from where the driver has it, if that folder is there, and get texts in small batches.

    Spark's defaults of 10,000 rows and 64 MB a batch are too much text at both ends; a value that was set on purpose stays.
    """
    for name, (default, own) in BATCHES.items():
        if spark.conf.get(name) == default:
            spark.conf.set(name, own)
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    paths = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in paths.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, (root, paths)))
    return spark


def _lean(batches: Iterator[pa.RecordBatch], work: Work) -> Iterator[pa.RecordBatch]:
    try:
        yield from work(batches)
    finally:
        gc.collect()
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
            trim(0)


def mapped(df: DataFrame, work: Work, schema: str | StructType) -> DataFrame:
    """mapInArrow with workers that give memory back at the end of each task: they stay for tasks of other stages."""
    return df.mapInArrow(partial(_lean, work=work), schema)


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; a temporary one only where it is unset and everything runs in one process."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if named is None:
        if not context.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="coclave-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(named)
    return named


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Run the plan now and go on from reliable files in the shared folder.

    Spark removes them with the last reference if spark.cleaner.referenceTracking.cleanCheckpoints is set.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint()


def dealt(df: DataFrame, rows: int, *by: str) -> DataFrame:
    """df by the columns over as many tasks as give each PER_TASK of its rows, so that a task's memory does not grow with them.

    Spark's own number of partitions is fixed, and small ones become larger by their packed size, whatever their rows turn into.
    """
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, math.ceil(rows / PER_TASK)), *by)


def keep(df: DataFrame, label: str) -> DataFrame:
    """Write the rows as a table in the shared folder and read them from there: each is computed once."""
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    kept = df.sparkSession.read.schema(df.schema).parquet(path)
    kept.kept_at = path
    return kept


def small(df: DataFrame, label: str, most: int = 1 << 16) -> DataFrame:
    """The rows, computed once; marked for broadcast if there are at most `most` of them, else joined like any table."""
    kept = keep(df, label)
    return F.broadcast(kept) if kept.count() <= most else kept


def release(spark: SparkSession) -> None:
    """Let go of what ended jobs left: Spark removes shuffle files, broadcasts and checkpoints that nothing refers to any more, and
    the driver's heap shrinks, only when garbage is collected, which a driver with room to grow puts off.

    To be called between the steps of a long job, not in loops over small ones: it stops the driver for some tenths of a second.
    """
    gc.collect()
    spark._jvm.System.gc()


def discard(kept: DataFrame) -> None:
    """Delete the table of keep(), once nothing that is still to run reads it."""
    spark = kept.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(kept.kept_at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
