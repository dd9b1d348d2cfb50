"""Writing and querying tables by name: tables are replaced, texts go to one file a partition."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_table(data: DataFrame, name: str) -> None:
    """Drops and replaces the table."""
    data.write.mode("overwrite").saveAsTable(name)


def write_rows(spark: SparkSession, rows: list, columns: list[str], name: str) -> None:
    """Rows, each as wide as `columns`, to a table that they replace."""
    if any(len(r) != len(columns) for r in rows):
        raise ValueError(f"rows must have {len(columns)} values")
    write_table(spark.createDataFrame(rows, columns), name)


def run_query(spark: SparkSession, sql: str) -> DataFrame:
    return spark.sql(sql)


def page_texts(pages: DataFrame) -> DataFrame:
    """One text a document: its pages' texts in order, a blank line between; pages without text are passed over."""
    rows = F.array_sort(F.collect_list(F.struct("page_no", "text")))
    return pages.where("text is not null").groupBy("doc_id").agg(F.array_join(F.transform(rows, lambda x: x["text"]), "\n\n").alias("text"))


def write_markdown(texts: DataFrame, path: str) -> None:
    """doc_id and text as JSON lines, so that a text's own line breaks survive."""
    texts.select("doc_id", "text").write.mode("overwrite").json(path)
