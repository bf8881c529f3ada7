"""A distributed suffix array by the difference-cover method, and repeats read from it.

Positions that are 1 or 2 modulo 3 are sorted by their triples and named in
order; unless all names differ, the names form a shorter text that is solved the
same way. The remaining third is sorted by its first letter and the rank of what
follows, and both are merged by two sorts that count how many of the one stand
before each of the other. Equal prefixes then stand side by side.

Every step is a sort, a join or a sum of DataFrames. It gives right results, but
it sorts and joins records of every byte many times over; ``repeats.py`` does the
corpus job and the README has both methods' figures.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, ordered, sums_before

#: Texts of names up to this long are solved in one task: a bound, not a share of the input.
SMALL = 20_000


def letters(docs: DataFrame) -> DataFrame:
    """(pos, c, doc, start): bytes of all texts end to end, each text closed by a letter of its own below all bytes."""
    sized = docs.select("doc", F.encode("text", "UTF-8").alias("b")).withColumn("n", F.octet_length("b") + 1)
    placed = _before(sized, ["doc"], F.col("n"), "base")
    ranked = _before(placed, ["doc"], F.lit(1), "rank")
    total = docs.count()
    each = ranked.select("doc", "base", "rank", "b", F.posexplode(F.sequence(F.lit(1), F.col("n"))).alias("start", "k"))
    byte = F.ascii(F.decode(F.substring("b", F.col("k"), F.lit(1)), "ISO-8859-1"))
    c = F.when(F.col("k") <= F.octet_length("b"), byte + F.lit(total + 1)).otherwise(F.col("rank") + 1)
    return each.select((F.col("base") + F.col("start")).alias("pos"), c.cast("long").alias("c"), "doc", "start")


def _before(df: DataFrame, keys: list[str], value: Column, name: str) -> DataFrame:
    """``df`` with the sum of ``value`` over all rows that come before in the order of ``keys``."""
    return sums_before(df, keys, {name: value.cast("long")})


def _shifted(df: DataFrame, value: str, by: int, name: str) -> DataFrame:
    """``value`` of the row ``by`` positions on, 0 behind the end."""
    later = df.select((F.col("pos") - by).alias("pos"), F.col(value).alias(name))
    return later.where("pos >= 0")


def ranks(text: DataFrame, n: int, depth: int = 0) -> DataFrame:
    """(pos, c) with positions 0..n-1 and letters above 0 -> (pos, rank) of all suffixes, from 1."""
    if n <= SMALL:
        return _small(text)
    text = cut(text.select("pos", "c"), "suffix-text")
    wide = text
    for by, name in ((1, "c1"), (2, "c2")):
        wide = wide.join(_shifted(text, "c", by, name), "pos", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    wide = cut(wide, "suffix-triples")
    sampled = wide.where("pos % 3 <> 0")
    distinct = sampled.select("c", "c1", "c2").distinct()
    names = _before(distinct, ["c", "c1", "c2"], F.lit(1), "name").withColumn("name", F.col("name") + 1)
    named = cut(sampled.join(names, ["c", "c1", "c2"]).select("pos", "name"), "suffix-names")
    size = (n + 1) // 3 + n // 3  # of positions 1 and 2 modulo 3
    half = (n + 1) // 3
    folded = F.when(F.col("pos") % 3 == 1, F.floor(F.col("pos") / 3)).otherwise(F.floor(F.col("pos") / 3) + half + 1)
    if names.count() == size:
        ranked = named.withColumnRenamed("name", "r")
    else:
        short = named.select(folded.alias("pos"), F.col("name").alias("c"))
        gap = text.sparkSession.createDataFrame([(half, 0)], "pos long, c long")  # parts the two halves
        solved = ranks(short.unionByName(gap).withColumn("c", F.col("c") + 1), size + 1, depth + 1)
        unfolded = F.when(F.col("pos") < half, F.col("pos") * 3 + 1).otherwise((F.col("pos") - half - 1) * 3 + 2)
        ranked = solved.where(F.col("pos") != half).select(unfolded.alias("pos"), (F.col("rank") - 1).alias("r"))
    ranked = cut(ranked, "suffix-sampled")
    full = wide.join(ranked, "pos", "left")
    for by, name in ((1, "r1"), (2, "r2")):
        full = full.join(_shifted(ranked, "r", by, name), "pos", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    full = cut(full.withColumn("m", F.col("pos") % 3), "suffix-full")
    rest, one, two = (full.where(f"m = {k}") for k in (0, 1, 2))
    # how many sampled suffixes stand before each of the rest, and the other way round
    with_one = _before(rest.unionByName(one), ["c", "r1", "m"], (F.col("m") == 1).cast("int"), "ones")
    with_one = cut(_before(with_one, ["c", "r1", "m"], (F.col("m") == 0).cast("int"), "rests"), "suffix-merge")
    with_two = _before(rest.unionByName(two), ["c", "c1", "r2", "m"], (F.col("m") == 2).cast("int"), "twos")
    with_two = cut(_before(with_two, ["c", "c1", "r2", "m"], (F.col("m") == 0).cast("int"), "rests"), "suffix-merge")
    ahead = with_one.where("m = 0").select("pos", "ones", "rests").join(with_two.where("m = 0").select("pos", "twos"), "pos")
    of_rest = ahead.select("pos", (F.col("ones") + F.col("twos") + F.col("rests") + 1).alias("rank"))
    sampled_rest = with_one.where("m = 1").select("pos", "r", "rests").unionByName(with_two.where("m = 2").select("pos", "r", "rests"))
    order = _before(sampled_rest, ["r"], F.lit(1), "place")
    of_sampled = order.select("pos", (F.col("place") + F.col("rests") + 1).alias("rank"))
    return cut(of_rest.unionByName(of_sampled), "suffix-ranks")


def _small(text: DataFrame) -> DataFrame:
    """Suffix ranks of a short text in one task, by doubling."""
    import numpy as np
    import pandas as pd

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pos")
        r = np.unique(rows["c"].to_numpy(), return_inverse=True)[1].astype(np.int64) + 1
        step = 1
        while len(r) and r.max() < len(r):
            nxt = np.zeros_like(r)
            nxt[:-step] = r[step:] if step < len(r) else 0
            r = np.unique(r * (len(r) + 2) + nxt, return_inverse=True)[1].astype(np.int64) + 1
            step *= 2
        return pd.DataFrame({"pos": rows["pos"].to_numpy(), "rank": r})

    whole = text.select("pos", "c", F.lit(0).alias("one")).groupBy("one")  # at most SMALL rows
    return cut(whole.applyInPandas(lambda rows: solve(rows), "pos long, rank long"), "suffix-small")


def suffix_array(docs: DataFrame) -> DataFrame:
    """(doc, text) with distinct ids -> (rank, doc, start) of every byte's suffix within its text; null text is empty."""
    docs = docs.select("doc", F.coalesce("text", F.lit("")).alias("text"))
    text = cut(letters(docs), "suffix-letters")
    n = text.count()
    solved = ranks(text, n)
    ends = F.max("start").over(Window.partitionBy("doc"))
    return solved.join(text, "pos").withColumn("_end", ends).where("start < _end").select("rank", "doc", "start")


def repeated_starts(docs: DataFrame, length: int = 100) -> DataFrame:
    """(doc, start) of every string of ``length`` bytes that also starts earlier, by comparing neighbours in the array."""
    bytes_ = docs.select("doc", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("b"))
    array = suffix_array(docs).join(bytes_, "doc").withColumn("prefix", F.substring("b", F.col("start") + 1, F.lit(length)))
    array = array.where(F.octet_length("prefix") == length).select("rank", "doc", "start", "prefix")
    rows = ordered(array, ["rank"])
    last = rows.groupBy("_part").agg(F.max_by("prefix", "_at").alias("last"))
    carried = last.withColumn("carry", F.lag("last").over(Window.orderBy("_part"))).select("_part", "carry")  # one row a partition
    here = Window.partitionBy("_part").orderBy("_at")
    previous = F.coalesce(F.lag("prefix").over(here), F.col("carry"))
    marked = rows.join(carried, "_part").withColumn("opens", (~F.col("prefix").eqNullSafe(previous)).cast("int")).drop("prefix", "carry", "_part", "_at")
    grouped = _before(marked, ["rank"], F.col("opens"), "seen").withColumn("g", F.col("seen") + F.col("opens"))
    first = grouped.groupBy("g").agg(F.min(F.struct("doc", "start")).alias("first"))
    return grouped.join(first, "g").where(F.struct("doc", "start") > F.col("first")).select("doc", "start")
