"""Line dedup by distinct-site spread.

Per hash of a trimmed line, HyperLogLog sketches of its sites merge by
aggregation. Lines whose estimate lies far below the threshold stay and those
far above go; for those near it the distinct sites are counted exactly. A line
seen on enough sites is boilerplate and is removed from every document.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

MIN_SITES = 5
#: Lines of fewer characters neither count nor go; blank lines never do.
MIN_CHARS = 1
BLANKS = " \t\r"
#: Relative error of the sketches, and the estimates, as shares of the threshold, between which lines are counted exactly.
SKETCH_ERROR, LOW, HIGH = 0.1, 0.4, 3.0
#: Up to so many boilerplate lines (8 bytes each) are broadcast; more are joined.
BROADCAST_LINES = 500_000


def _line(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def _facts(docs: DataFrame, text: str, site: str, min_chars: int) -> DataFrame:
    """(site, h) of every line that may count."""
    lines = docs.select(
        F.coalesce(F.col(site).cast("string"), F.lit("")).alias("site"),
        F.explode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("line"),
    ).withColumn("line", _line(F.col("line")))
    return lines.where(F.length("line") >= min_chars).select("site", F.xxhash64("line").alias("h"))


def boilerplate(docs: DataFrame, text: str = "text", site: str = "source", min_sites: int = MIN_SITES, min_chars: int = MIN_CHARS) -> DataFrame:
    """(h): 64-bit hashes of lines of at least ``min_chars`` characters on at least ``min_sites`` distinct sites.

    A null site is one site, the same as the empty one.
    """
    facts = cut(_facts(docs, text, site, min_chars), "line-facts")
    spread = facts.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("site", SKETCH_ERROR).alias("sites"))
    spread = cut(spread.where(F.col("n") >= min_sites), "line-spread")  # on fewer sites than copies: never below the threshold by more than the count allows
    sure = spread.where(F.col("sites") > HIGH * min_sites).select("h")
    near = spread.where((F.col("sites") <= HIGH * min_sites) & (F.col("sites") >= LOW * min_sites)).select("h")
    exact = (
        facts.distinct().join(near, "h")
        .groupBy("h").agg(F.count(F.lit(1)).alias("sites"))
        .where(F.col("sites") >= min_sites).select("h")
    )
    return cut(sure.unionByName(exact), "line-boilerplate")


def drop_lines(
    docs: DataFrame, text: str = "text", site: str = "source", min_sites: int = MIN_SITES, min_chars: int = MIN_CHARS,
    broadcast_lines: int = BROADCAST_LINES,
) -> DataFrame:
    """``docs`` with ``text`` cleaned of boilerplate lines, and n_lines and n_removed.

    Null text stays null, with 0 lines; other texts have one line more than
    line feeds, so empty text has one. Every line that is not blank counts,
    unless ``min_chars`` is raised; blank lines always stay. Repeated rows are
    cleaned alike; other columns pass unchanged, whatever their names, those
    named n_lines or n_removed are replaced. An empty table gives no rows.
    """
    found = boilerplate(docs, text, site, min_sites, min_chars)
    if found.count() > broadcast_lines:
        return _drop_by_join(docs, found, text, min_chars)
    shared = docs.sparkSession.sparkContext.broadcast({r["h"] for r in found.collect()})  # at most broadcast_lines
    keep = _others(docs, text)

    from pyspark.sql.types import StructType

    @F.pandas_udf(StructType.fromDDL("text string, n_lines long, n_removed long"))
    def clean(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        from xxhash import xxh64_intdigest

        drop = {h & (2**64 - 1) for h in shared.value}
        for part in parts:
            rows = []
            for body in part:
                if not isinstance(body, str):
                    rows.append((None, 0, 0))
                    continue
                lines = body.split("\n")
                stay = [x for x in lines if len(y := x.strip(BLANKS)) < min_chars or xxh64_intdigest(y.encode("utf-8", "surrogatepass"), 42) not in drop]
                rows.append(("\n".join(stay) if len(stay) < len(lines) else body, len(lines), len(lines) - len(stay)))
            yield pd.DataFrame(rows, columns=["text", "n_lines", "n_removed"])

    made = docs.select(F.struct(*[F.col(c) for c in keep]).alias("row"), clean(F.col(text)).alias("made"))
    return made.select("row.*", F.col("made.text").alias(text), "made.n_lines", "made.n_removed")


def _others(docs: DataFrame, text: str) -> list[str]:
    return [c for c in docs.columns if c not in {text, "n_lines", "n_removed"}]


def _drop_by_join(docs: DataFrame, found: DataFrame, text: str, min_chars: int) -> DataFrame:
    """The same by joins: distinct texts, told apart by digest, are spread into lines and put together again."""
    keep = _others(docs, text)
    marked = docs.select(F.struct(*[F.col(c) for c in keep]).alias("row"), F.col(text).alias("body"), F.sha2(F.col(text), 256).alias("t"))
    texts = marked.where("body is not null").groupBy("t").agg(F.first("body").alias("body"))
    lines = texts.select("t", F.posexplode(F.split("body", "\n")).alias("at", "line"))
    asked = F.length(_line(F.col("line"))) >= min_chars
    # lines that are not asked for get keys of their own, so that they spread over the tasks
    lines = lines.withColumn("asked", asked).withColumn("k", F.when(asked, F.xxhash64(_line(F.col("line")))).otherwise(F.xxhash64("t", "at")))
    hit = lines.join(found.select(F.col("h").alias("k"), F.lit(True).alias("known")), "k", "left").withColumn("hit", F.col("asked") & F.coalesce("known", F.lit(False)))
    back = hit.groupBy("t").agg(
        F.count(F.lit(1)).alias("n_lines"), F.sum(F.col("hit").cast("long")).alias("n_removed"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("hit"), F.struct("at", "line")))), lambda x: x["line"]), "\n").alias("clean"),
    )
    return marked.drop("body").join(back, "t", "left").select(
        "row.*", F.col("clean").alias(text), F.coalesce("n_lines", F.lit(0)).alias("n_lines"), F.coalesce("n_removed", F.lit(0)).alias("n_removed")
    )
