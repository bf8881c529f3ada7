"""Reading HTML into (key, html) tables and writing results. Plain Spark readers and writers do the work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What `csv` is read with: HTML holds line breaks and quotes.
_CSV = {"header": True, "multiLine": True, "escape": '"'}


def read_tables(spark: SparkSession, path: str, html: str = "html", fmt: str = "parquet", schema: str | None = None) -> DataFrame:
    """A table with an HTML column, from parquet, orc, json or csv (give a schema for the last two)."""
    reader = spark.read.format(fmt)
    if fmt == "csv":
        reader = reader.options(**_CSV)
    if schema:
        reader = reader.schema(schema)
    df = reader.load(path)
    if html not in df.columns:
        raise ValueError(f"no column {html} in {path}")
    return df


def read_html_files(spark: SparkSession, path: str, charset: str = "UTF-8", glob: str = "*.html") -> DataFrame:
    """(path, modified, length, html) of HTML files below a folder; one file is one document."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.col("modificationTime").alias("modified"), "length", F.decode("content", charset).alias("html"))


def read_text_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, html), each file whole."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("html"))


def normalize_newlines(html: Column) -> Column:
    """CR and CR LF as LF, as a parse does."""
    return F.regexp_replace(html, "\r\n?", "\n")


def spread(df: DataFrame, per_task_bytes: int = 32 << 20, html: str = "html") -> DataFrame:
    """Repartition by estimated size, for sources of few files: one pass over the column's lengths decides the number."""
    total = df.agg(F.sum(F.octet_length(html))).first()[0] or 0
    return df.repartition(max(1, -(-total // per_task_bytes)))


def write_html(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists", partition_by: tuple[str, ...] = ()) -> None:
    writer = df.write.format(fmt).mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


def write_chunks(chunk_rows: DataFrame, sink) -> None:  # noqa: ANN001
    """Hand chunk rows (..., ord, chunk) to ``sink(row)`` on the workers; order holds within a document if it lies in one partition."""

    def run(rows) -> None:  # noqa: ANN001
        for row in rows:
            sink(row)

    chunk_rows.foreachPartition(run)
