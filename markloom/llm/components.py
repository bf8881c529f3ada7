"""Connected components by alternating large-star and small-star steps.

Every step is a min-aggregation and a join on one column, so hubs are combined
before the exchange and split by skew joins; nothing is collected. Each step's
links are written to the shared folder, which cuts the lineage.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def components(links: DataFrame, max_steps: int | None = None) -> DataFrame:
    """(a, b) links of long ids -> (node, component), the least id reachable.

    Only nodes that have a link appear. Loops and repeated links are harmless.
    Steps go on until nothing changes; more than ``max_steps``, if given, raise.
    """
    edges = cut(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "cc-links")
    before = None
    for step in count():
        if step == max_steps:
            raise RuntimeError(f"links have not settled in {max_steps} steps")
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small_least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(small_least, "u")
            .select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
            .where("u <> v").distinct()
        )
        edges = cut(small, "cc-links")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component"))
    ).distinct()
