"""Mixing sources to target weights by Pareto order sampling. DataFrame operations only.

A source with target/size ratio r gives floor(r) whole copies of each document
for certain and one more copy to a sample that is to hold the fraction f = r -
floor(r) of its words. Inclusion is unequal: a document of s words is included
with probability f (1 + (1 - f) (g - G)), where g = s / (s + mean size) and G is
the mean of g over the words of the source, so that longer documents are likelier
(a sample of given words then takes fewer, longer ones), every probability lies
between 0 and 1, and the words expected are f of the source's. Documents are
ranked by random odds over inclusion odds, (u/(1-u)) / (p/(1-p)), u being a hash
of id and content, and taken until the words wanted are reached: the size that
is fixed is that in words, as targets are. One further document, the one whose
size comes closest to what is still missing, closes the gap.

No task sees a whole source: ranks are cut into buckets of about the square
root of the source's rows, sums per bucket tell which are taken whole, and only
the bucket where the words run out is ordered row by row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_PATTERN, cut, sums_before, tag_rows

WEIGHTS = (5, 2, 1)
MAX_COPIES = 3
#: Up to so many sources, the table of decisions per source is broadcast; beyond it, joined.
BROADCAST_SOURCES = 20_000


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD_PATTERN)).cast("long")


def _before(df: DataFrame, keys: list[str], values: dict[str, Column], few: bool) -> DataFrame:
    """``df`` with sums of ``values`` over the rows before in the order of ``keys``: a window over few rows, ranges beyond."""
    if not few:
        return sums_before(df, keys, values)
    rows = Window.orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)  # at most BROADCAST_SOURCES rows
    return df.select("*", *[F.coalesce(F.sum(v).over(rows), F.lit(0)).alias(n) for n, v in values.items()])


def targets(
    sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_copies: int = MAX_COPIES, few_sources: int = BROADCAST_SOURCES
) -> DataFrame:
    """(source, source_size, n_docs), a stored table -> the same with ``target`` in words.

    Sources in code-point order, null last, take the weights in turn and share
    the sum of all sizes; a target stops at ``max_copies`` times the source's
    size and the excess is shared anew by weight until none is above. The order
    of the caps is that of size over weight, so one running sum settles it.
    """
    n = len(weights)
    few = sources.limit(few_sources + 1).count() <= few_sources
    ranked = _before(sources.withColumn("_null", F.col("source").isNull()), ["_null", "source"], {"_rank": F.lit(1)}, few)
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("_rank") % n + 1).cast("int"))
    ranked = ranked.withColumn("_w", w).withColumn("_cap", F.col("source_size") * F.lit(float(max_copies)))
    # capped are the sources with the least cap/weight: source i is capped iff its cap is at most
    # its share of what those before it leave over
    ranked = ranked.withColumn("_key", F.col("_cap") / F.col("_w"))
    total = ranked.agg(F.sum("source_size").cast("double").alias("all"), F.sum("_w").alias("ws")).first()  # two numbers
    run = (
        _before(ranked, ["_key", "_rank"], {"_caps": F.col("_cap"), "_ws": F.col("_w")}, few)
        .withColumn("_rate", (F.lit(total["all"] or 0.0) - F.col("_caps")) / (F.lit(total["ws"] or 0.0) - F.col("_ws")))
        .withColumn("_capped", F.col("_key") <= F.col("_rate"))
    )
    run = cut(run, "mix-targets")
    rate = run.where(~F.col("_capped")).agg(F.min(F.struct("_key", "_rank", "_rate"))["_rate"].alias("rate")).first()["rate"]
    return run.withColumn(
        "target", F.when(F.col("_capped"), F.col("_cap")).otherwise(F.col("_w") * F.lit(rate or 0.0))
    ).select("source", "source_size", "n_docs", "target")


def mix(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", seed: int = 20_24,
    weights: tuple[int, ...] = WEIGHTS, max_copies: int = MAX_COPIES, few_sources: int = BROADCAST_SOURCES, digest: Column | None = None,
) -> DataFrame:
    """Per row of ``docs``: id, ``_rid``, size, source_size, target, copies, taken, and ``_digest`` where one is given.

    ``taken`` = copies x size. Null text has size 0 and null is a source of its
    own, last in order. Documents of size 0, and all documents of sources
    without words, are taken 0 times. Reruns agree however the rows are dealt, as
    chance and ties come from id and content alone; rows alike in all of them
    are alike in any order. Columns other than the three are ignored, whatever
    their names. An empty table gives no rows.
    """
    more = [] if digest is None else ["_digest"]
    base = docs.select(
        F.col(id_col).alias("id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"),
        F.xxhash64(F.col(text), F.col(source)).alias("body"), *[digest.alias(c) for c in more],
    )
    keyed = tag_rows(base)
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "id", "body"), 11).cast("double") + 0.5) / F.lit(float(1 << 53))
    facts = cut(keyed.withColumn("u", u), "mix-facts")
    per_source = cut(facts.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs")), "mix-sources")
    plan = (
        targets(per_source, weights, max_copies, few_sources)
        .withColumn("ratio", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
        .withColumn("whole", F.least(F.floor("ratio"), F.lit(max_copies)).cast("int"))
        .withColumn("f", F.col("ratio") - F.col("whole"))
        .withColumn("goal", F.col("target") - F.col("whole") * F.col("source_size"))
        .withColumn("n_buckets", F.greatest(F.lit(1), F.ceil(F.sqrt("n_docs"))).cast("long"))
    )
    plan = cut(plan, "mix-plan")
    few = plan.count() <= few_sources
    hint = F.broadcast if few else (lambda df: df)

    def by_source(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
        r = right.withColumnRenamed("source", "_s")
        return left.join(hint(r), left["source"].eqNullSafe(r["_s"]), how).drop("_s")

    sized = by_source(facts, plan).withColumn("g", F.when(F.col("size") > 0, F.col("size") / (F.col("size") + F.col("source_size") / F.col("n_docs"))))
    middle = cut(sized.where("size > 0").groupBy("source").agg((F.sum(F.col("g") * F.col("size")) / F.sum("size")).alias("mid")), "mix-middle")
    chance = F.col("f") * (1 + (1 - F.col("f")) * (F.col("g") - F.round("mid", 9)))  # rounded: sums of fractions depend on their order
    # Pareto rank of a document; q / (1 + q) lies between 0 and 1, and its buckets are buckets of rank
    odds = (F.col("u") / (1 - F.col("u"))) * ((1 - F.col("chance")) / F.col("chance"))
    ranked = (
        by_source(sized, middle, "left").withColumn("chance", chance)
        .withColumn("q", F.when((F.col("f") > 1e-12) & (F.col("size") > 0), odds))
        .withColumn("bucket", F.floor(F.col("q") / (1 + F.col("q")) * F.col("n_buckets")))
    )
    sums = ranked.where("q is not null").groupBy("source", "bucket").agg(F.sum("size").alias("held"), F.first("goal").alias("goal"))
    before = F.coalesce(F.sum("held").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    edge = (
        sums.withColumn("before", before)
        .where((F.col("before") <= F.col("goal")) & (F.col("before") + F.col("held") > F.col("goal")))
        .groupBy("source").agg(F.min(F.struct("bucket", "before")).alias("edge"))
        .select("source", F.col("edge.bucket").alias("edge"), F.col("edge.before").alias("before"))
    )
    edge = cut(edge, "mix-edge")
    at_edge = by_source(ranked.where("q is not null"), edge).where("bucket = edge")
    cum = F.col("before") + F.sum("size").over(Window.partitionBy("source").orderBy("q", "id", "size", "body", "_rid").rowsBetween(Window.unboundedPreceding, 0))
    at_edge = at_edge.withColumn("cum", cum)
    # the last row that still fits, and what is missing after it
    cutoff = cut(
        at_edge.where("cum <= goal")
        .groupBy("source").agg(F.max(F.struct("q", "id", "size", "body", "_rid", "cum")).alias("last")),
        "mix-cutoff",
    )
    decided = by_source(by_source(ranked, edge, "left"), cutoff, "left")
    order = ("q", "id", "size", "body", "_rid")
    sampled = F.col("q").isNotNull() & (
        F.col("edge").isNull() | (F.col("bucket") < F.col("edge"))
        | ((F.col("bucket") == F.col("edge")) & F.col("last").isNotNull()
           & (F.struct(*order) <= F.struct(*[F.col(f"last.{c}").alias(c) for c in order])))
    )
    decided = decided.withColumn("sampled", F.coalesce(sampled, F.lit(False)))
    missing = F.col("goal") - F.coalesce(F.col("last.cum"), F.col("before").cast("long"), F.lit(0))
    closer = (
        decided.where(F.col("edge").isNotNull() & F.col("q").isNotNull() & ~F.col("sampled"))
        .withColumn("off", F.abs(missing - F.col("size")))
        .where(F.col("off") < missing)
        .groupBy("source").agg(F.min(F.struct("off", "q", "id", "body", "_rid")).alias("best"))
        .select("source", F.col("best._rid").alias("extra"))
    )
    closer = cut(closer, "mix-closer")
    copies = F.when(F.col("size") > 0, F.col("whole") + F.when(F.col("sampled") | (F.col("_rid") == F.coalesce(F.col("extra"), F.lit(-1))), 1).otherwise(0)).otherwise(0)
    return by_source(decided, closer, "left").select(
        F.col("id").alias(id_col), "_rid", "size", "source_size", F.col("target").cast("double").alias("target"),
        copies.cast("int").alias("copies"), (copies * F.col("size")).cast("long").alias("taken"), *more,
    )


def repeat_by_mix(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it was taken, columns unchanged.

    Rows that are alike in id, text and source share their copies; what does not
    divide evenly goes to one of them.
    """
    digest = F.xxhash64(F.col(text), F.col(source))
    mixed = mix(docs, id_col, text, source, digest=digest)
    taken = mixed.groupBy(F.col(id_col).alias("_mix_id"), F.col("_digest").alias("_mix_digest")).agg(
        F.sum("copies").alias("_mix_copies"), F.count(F.lit(1)).alias("_mix_rows")
    )
    taken = cut(taken.where("_mix_copies > 0"), "mix-taken")
    rows = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"), F.col(id_col).alias("_mix_own_id"), digest.alias("_mix_own"))
    joined = rows.join(taken, F.col("_mix_own_id").eqNullSafe(F.col("_mix_id")) & (F.col("_mix_own") == F.col("_mix_digest")))
    each, rest = F.expr("cast(_mix_copies div _mix_rows as int)"), F.expr("cast(_mix_copies % _mix_rows as int)")
    out = joined.where(each > 0).select("row", F.explode(F.sequence(F.lit(1), each))).select("row.*")
    if not taken.where(rest > 0).limit(1).count():
        return out
    lead = joined.where(rest > 0).groupBy("_mix_id", "_mix_digest").agg(F.first("row").alias("row"), F.first(rest).alias("_mix_rest"))
    return out.unionByName(lead.select("row", F.explode(F.sequence(F.lit(1), F.col("_mix_rest")))).select("row.*"))
