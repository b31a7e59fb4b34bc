"""Session helpers shared by the operators of this subpackage."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or (only where that is unset, as in
    single-machine tests) a fresh temporary folder."""
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not path:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = tempfile.mkdtemp(prefix="lexoria-")
        spark.conf.set("spark.checkpoint.dir", path)
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` reliably in the shared folder and cut its lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


class Scratch:
    """Parquet tables in the shared folder for the inside of one operator; ``clear`` deletes them.

    Unlike a checkpoint they are columnar and compressed. Results that leave the operator must not
    read them, unless they are kept until the session ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def keep(self, df: DataFrame, at_exit: bool = False) -> DataFrame:
        """``at_exit``: what is not cleared before goes when the session's JVM ends."""
        path = f"{shared_dir(self.spark).rstrip('/')}/scratch-{uuid.uuid4().hex}"
        df.write.parquet(path)
        if at_exit:
            at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (out, path)
        return out

    def clear(self, *frames: DataFrame) -> None:
        for key in [id(f) for f in frames] or list(self.paths):
            _, path = self.paths.pop(key)
            jvm = self.spark.sparkContext._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def give_back() -> None:
    """Return a worker's freed memory to the system; an idle worker otherwise keeps it."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def lean(run: Callable) -> Callable:
    """A function for mapInArrow that gives its memory back when a task ends."""

    def batches(rows: Iterator) -> Iterator:
        try:
            yield from run(rows)
        finally:
            give_back()

    return batches


def lean_group(run: Callable) -> Callable:
    """A function for applyInArrow that gives its memory back after each group."""

    def group(table):
        try:
            return run(table)
        finally:
            give_back()

    return group


def by_bucket(df: DataFrame, buckets: int, run: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """``run`` over each bucket of a table with the column ``bucket`` (0 to buckets - 1), one task a
    bucket: no two buckets meet in a task, and nothing is sorted."""

    def whole(batches: Iterator) -> Iterator:
        rows = list(batches)
        if sum(len(b) for b in rows):
            yield from run(pa.Table.from_batches(rows)).to_batches()

    return df.repartitionById(buckets, F.col("bucket")).mapInArrow(lean(whole), schema)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of frames that are no longer referenced."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    time.sleep(1)


def text_bytes(df: DataFrame, column: str = "text") -> int:
    """Total UTF-8 bytes of a text column, from which bucket counts are derived."""
    return int(df.agg(F.sum(F.octet_length(column))).first()[0] or 0)


def buckets_for(total_bytes: int, per_bucket: int, least: int = 32) -> int:
    """How many hash buckets keep each near ``per_bucket`` bytes, whatever the input size."""
    return max(least, -(-total_bytes // per_bucket))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
