"""What the operators share: scratch tables in the cluster's shared folder, and Arrow batch helpers."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


#: Settings by which Spark drops a query's shuffle files at its end.
CLEANUP = ("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "spark.sql.connect.shuffleDependency.fileCleanup.enabled")


@cache
def _own_dir() -> str:
    """A temporary folder of this process, for sessions on one machine that name no shared one."""
    base = tempfile.mkdtemp(prefix="foliant-shared-")
    atexit.register(shutil.rmtree, base, ignore_errors=True)
    return base


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: `spark.checkpoint.dir`, with its file system.

    Where it is unset a folder of this process serves a local master; a cluster without it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: no folder that the driver and all executors share")
        base = f"file:{_own_dir()}"
    return qualified(spark, base).rstrip("/")


def qualified(spark: SparkSession, path: str) -> str:
    """A path with the scheme of the file system on which Spark finds it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).makeQualified(where).toString()


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Queries run within drop their shuffle files when they end, by Spark's own clean-up, not when garbage happens to be collected."""
    before = {k: spark.conf.get(k, None) for k in CLEANUP}
    try:
        for k in CLEANUP:
            spark.conf.set(k, "true")
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def stash(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Write `df` to a new table in the shared folder and read it back: lineage ends there, and a lost executor loses nothing.

    The write's shuffle files go with it.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    with tidy(spark):
        df.write.option("compression", compression).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def stash_bucketed(df: DataFrame, name: str, key: str) -> DataFrame:
    """As `stash`, as a table dealt by `key` into as many buckets as a shuffle has partitions: grouping by it later moves nothing."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, name)
    table = path.rsplit("/", 1)[-1].replace("-", "_")
    with tidy(spark):
        df.write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), key).option("path", path).option("compression", "zstd").saveAsTable(table)
    out = spark.table(table)
    out._scratch = path
    return out


def unstash(*frames: DataFrame) -> None:
    """Delete stashed tables that nothing will read again."""
    for df in frames:
        path = getattr(df, "_scratch", None)
        if path:
            jvm = df.sparkSession._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


#: Each drops a table that an operator keeps in a Python worker between its tasks, and tells whether there was one.
HELD: list[Callable[[], bool]] = []


def release() -> None:
    """Give memory that this process has freed back to the system; Python workers outlive their tasks and would keep it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc alone
    if trim:
        trim(0)


def forget() -> None:
    """Drop what other operators have left in this process, and give the memory back to the system."""
    if any([drop() for drop in HELD]):
        release()


def arrow_map(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | pa.Table | None], schema: str) -> DataFrame:
    """Apply `fn` batch by batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            out = fn(batch)
            if out is not None and out.num_rows:
                if isinstance(out, pa.Table):
                    yield from out.to_batches()
                else:
                    yield out

    return df.mapInArrow(run, schema)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> Iterator[bytes]:
    """The UTF-8 bytes of each text; null counts as empty."""
    for value in batch.column(column).cast(pa.binary()):
        yield value.as_py() or b""
