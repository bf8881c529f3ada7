"""Helpers that the training-data operators share."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, suppress

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: What the contracts call a word: a run of bytes outside space and \t \n \v \f \r.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
#: Rows of whole texts that go to a Python worker at once.
ARROW_ROWS = 1000

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Only where the session has none (unit tests on one machine) a temporary
    folder is made and set.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    found = spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    path = "file://" + tempfile.mkdtemp(prefix="markloom-")
    spark.sparkContext.setCheckpointDir(path)
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts the lineage with files that outlive any executor, smaller than a
    checkpoint of rows. The folders are deleted when the driver exits.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def _delete(tables: list[tuple[SparkSession, str]]) -> None:
    for spark, path in reversed(tables):
        try:
            jvm = spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # noqa: BLE001 - the session may be gone already
            return


def drop_written() -> None:
    """Delete every table that ``cut`` wrote in this process."""
    _delete(_written)
    _written.clear()


@contextmanager
def last_stays() -> Iterator[None]:
    """Of the tables that ``cut`` writes inside, only the last outlives the block; it must be the only one still read.

    The driver's memory is collected then, which lets Spark delete the shuffle
    files of plans that are gone.
    """
    mark = len(_written)
    yield
    passed = _written[mark:-1]
    _delete(passed)
    del _written[mark:-1]
    if passed:
        passed[0][0].sparkContext._jvm.System.gc()


atexit.register(drop_written)


@contextmanager
def small_batches(spark: SparkSession, rows: int = ARROW_ROWS) -> Iterator[None]:
    """Tables written inside send at most ``rows`` rows at once to Python workers; a smaller bound of the session stands.

    Spark's own 10,000 rows of whole texts are tens of MB, several times over:
    in the executor's buffers, as Arrow, as strings and as what is made of them.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    had = spark.conf.get(name, None)
    if had is None or not 0 < int(had) <= rows:
        spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        if had is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, had)


def give_back() -> None:
    """Give what a Python worker has freed back to the system: a worker outlives its task and stands beside the stages that follow."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


def dealt(stored: DataFrame, rows: int) -> DataFrame:
    """A stored table dealt out to tasks of about ``rows`` rows, if it lies in fewer parts."""
    parts = -(-stored.count() // rows)
    return stored.repartition(parts) if stored.rdd.getNumPartitions() < parts else stored


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; null counts as empty. Pure ASCII takes the fast path."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, UPPER.lower())
    )


def tag_rows(df: DataFrame, name: str = "_rid") -> DataFrame:
    """Add a row number that is unique but otherwise arbitrary (no shuffle)."""
    return df.withColumn(name, F.monotonically_increasing_id())


def ordered(df: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` stored in the order of ``keys``, with its partition and a number that grows with the order."""
    placed = df.orderBy(*keys).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id())
    return cut(placed, "ordered")


def sums_before(df: DataFrame, keys: list[str], values: dict[str, Column]) -> DataFrame:
    """``df`` with sums of ``values`` over all rows that come before in the order of ``keys``.

    Rows are sorted by ranges and summed up range by range, so no task sees more
    than its range; keys should be unique.
    """
    rows = ordered(df.select("*", *[v.alias(f"_v_{n}") for n, v in values.items()]), keys)
    parts = rows.groupBy("_part").agg(*[F.sum(f"_v_{n}").alias(f"_sum_{n}") for n in values])
    first = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    starts = parts.select("_part", *[F.coalesce(F.sum(f"_sum_{n}").over(first), F.lit(0)).alias(f"_start_{n}") for n in values])
    inside = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    sums = [(F.col(f"_start_{n}") + F.coalesce(F.sum(f"_v_{n}").over(inside), F.lit(0))).alias(n) for n in values]
    return rows.join(F.broadcast(starts), "_part").select(*df.columns, *sums)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
