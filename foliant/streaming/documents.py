"""Files of positioned lines, as they arrive, to Markdown: each micro-batch runs the batch plan on whole documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from foliant.operators import layout


def lines_stream(spark: SparkSession, path: str, schema, files: int = 100) -> DataFrame:
    """Parquet files of lines under `path`; a document lies in one file, so no state outlives a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def markdown_stream(lines: DataFrame, out: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Writes the Markdown of each batch under `out/batch=N`; a batch that runs again overwrites its own folder."""

    def write(batch: DataFrame, n: int) -> None:
        layout.markdown(batch).write.mode("overwrite").parquet(f"{out}/batch={n}")

    writer = lines.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
