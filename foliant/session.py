"""Session defaults for tests, benchmarks and notebooks; a cluster brings its own."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | None = None, partitions: int | None = None, memory: str = "8g") -> SparkSession:
    """A local session that behaves like the cluster: AQE on, UTC, Arrow for Python exchange."""
    cores = cores or int(os.environ.get("BENCH_CPUS", "8"))
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("foliant")
        .config("spark.sql.shuffle.partitions", str(partitions or cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def cut(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder of `spark.checkpoint.dir` and reads it back: what is used several times runs once.

    Where the setting is absent, as in tests, a temporary folder serves.
    """
    spark = df.sparkSession
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or tempfile.gettempdir()
    path = f"{shared}/foliant-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.parquet(path)
