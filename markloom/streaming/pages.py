"""The row-wise operators under Structured Streaming, and windows over what they remove."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from markloom.operators.sanitize import Sanitizer, removals


def read_stream(spark: SparkSession, path: str, schema: StructType | str, files_per_trigger: int | None = None) -> DataFrame:
    """New Parquet files of a folder, or of a pattern if ``path`` holds ``*``."""
    reader = spark.readStream.format("parquet").schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path)


def sanitize_stream(stream: DataFrame, sanitizer: Sanitizer, html: str = "html") -> DataFrame:
    """The stream with ``html`` sanitized and ``removed`` beside it; stateless, so no watermark is needed."""
    made = stream.withColumn("_r", sanitizer.report(F.col(html)))
    return made.withColumn(html, F.col("_r.html")).withColumn("removed", F.col("_r.removed")).drop("_r")


def removal_windows(stream: DataFrame, sanitizer: Sanitizer, time: str, window: str = "10 minutes", late: str = "30 minutes", html: str = "html") -> DataFrame:
    """Removals by event-time window, kind and reason; rows later than ``late`` are left out."""
    rows = removals(stream.withWatermark(time, late), sanitizer, html, (time,))
    return rows.groupBy(F.window(time, window), "kind", "reason").count()


def sliding_counts(stream: DataFrame, time: str, key: str, window: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Rows by tumbling or sliding window and key."""
    span = F.window(time, window, slide) if slide else F.window(time, window)
    return stream.withWatermark(time, late).groupBy(span, key).count()


def session_counts(stream: DataFrame, time: str, key: str, gap: str, late: str = "1 hour") -> DataFrame:
    """Rows by session of a key: a gap of that length ends it."""
    return stream.withWatermark(time, late).groupBy(F.session_window(time, gap), key).count()


def run_once(stream: DataFrame, folder: str, mode: str = "append", keys: tuple[str, ...] = ()) -> DataFrame:
    """Process what is there now into a Parquet table under ``folder`` and give it back as a batch table.

    In update mode the last result of each group counts: batches are kept apart
    by number, and rows are told by ``keys``, by default all columns but ``count``.
    In complete mode the last batch is the result.
    """
    spark, out = stream.sparkSession, f"{folder}/stream-{uuid.uuid4().hex}"
    if mode == "append":
        query = stream.writeStream.format("parquet").option("path", f"{out}/data").option("checkpointLocation", f"{out}/state")
    else:
        write = lambda df, n: df.withColumn("_batch", F.lit(n)).write.mode("overwrite").parquet(f"{out}/data/{n}")
        query = stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{out}/state")
    query.outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    if mode == "append":
        return spark.read.schema(stream.schema).parquet(f"{out}/data")
    rows = spark.read.schema(StructType([*stream.schema.fields, StructField("_batch", LongType())])).option("recursiveFileLookup", "true").parquet(f"{out}/data")
    if mode == "complete":
        return rows.where(F.col("_batch") == (rows.agg(F.max("_batch")).first()[0] or 0)).select(*stream.columns)
    names = list(keys or [c for c in stream.columns if c != "count"])
    last = rows.groupBy(*names).agg(F.max_by(F.struct(*stream.columns), "_batch").alias("_last"))
    return last.select("_last.*")
