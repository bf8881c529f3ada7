"""Near copies by exact Jaccard similarity of five-word shingles: the near-duplicate stage of the pipeline.

It starts from SimHash: fingerprints of the shingle sets meet by their deletion
variants (``simhash.links``), and in each component all meet the one of least
fingerprint and are verified on their whole sets. That wears large groups down
at one test a text, but similarity 0.8 leaves about ten of 64 bits different,
far beyond what segments can find. So an exact search completes it: two sets of
similarity 4/5 or more share a shingle among the first fifth of each (and one
more) in any order that all sets share. The order puts shingles first that a
sample of documents does not repeat, which keeps the posting lists short; it has
no influence on what is found.

In rounds, each text that is left is tested against one other it was not tested
against before: of the leaders of its lists the one it shares most lists with.
When the tests drop few, the pairs that remain are met in their lists, under
bounds by size, place and a parity bitmap of the set that no pair of the
similarity breaks, and verified.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, give_back, last_stays, small_batches
from .components import components
from .simhash import links

SHINGLE = 5
#: Similarity from which texts are near copies, as a fraction.
LIKE, OF = 4, 5
#: Documents of the sample that orders the shingles, and the most shingles it may tell apart.
SAMPLE_DOCS, SAMPLE_SHINGLES = 4000, 200_000
#: Leaders of a posting list: its least members by residue of the key.
LEADERS = 8
#: A round follows while the last one dropped one of so many tested texts, and one of so many of all.
OF_TESTED, OF_ALL = 4, 2000
#: Words of 64 bits in the parity bitmap of a set.
MAP_WORDS = 8
#: Up to so many rows of keys (24 bytes each) are broadcast; more are joined.
BROADCAST_ROWS = 500_000


def shingles(text: str | None, width: int = SHINGLE) -> np.ndarray:
    """Sorted distinct XXH64 (seed 42) of the word shingles in lower case A-Z; a shorter text is one shingle."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    grams = map(b" ".join, zip(*(words[k:] for k in range(width)), strict=False)) if len(words) >= width else [b" ".join(words)]
    return np.unique(np.fromiter(map(xxh64_intdigest, grams, repeat(42)), np.uint64))


def near(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return OF * both >= LIKE * (len(a) + len(b) - both)


def parity(h: np.ndarray, words: int = MAP_WORDS) -> np.ndarray:
    """Bit k tells whether an odd number of the shingles falls on k: sets that differ in d shingles differ in at most d bits.

    ``words`` is a power of two; the two halves of a map, one upon the other by
    exclusive or, are the map of half as many words.
    """
    odd = np.bincount((h >> np.uint64(7)).astype(np.int64) & (64 * words - 1), minlength=64 * words) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def wide(h: np.ndarray) -> np.ndarray | None:
    """Map of a bit or two a shingle, for sets that fill the small one."""
    return parity(h, 1 << (-(-len(h) // 64) - 1).bit_length()) if len(h) > 64 * MAP_WORDS else None


def majority(h: np.ndarray) -> int:
    """SimHash of a set of shingles, as a signed number."""
    bits = np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    return int.from_bytes(np.packbits((2 * bits.sum(axis=0, dtype=np.int64) > len(h)).astype(np.uint8)).tobytes(), "big", signed=True)


def _frequent(docs: DataFrame, id_col: str, text: str) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that a sample of documents repeats, in order, and how often."""

    @F.pandas_udf("array<long>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series([shingles(t if isinstance(t, str) else None).view(np.int64) for t in part])
        part = None
        give_back()

    n = docs.count()
    u = F.shiftrightunsigned(F.xxhash64(F.lit(4), id_col, text), 11).cast("double") / F.lit(float(1 << 53))
    few = docs.where(u < min(1.0, SAMPLE_DOCS / max(1, n)))
    counts = few.select(F.explode(run(F.col(text))).alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    with small_batches(docs.sparkSession):
        got = sorted((r["h"] % (1 << 64), r["n"]) for r in counts.orderBy(F.desc("n"), "h").limit(SAMPLE_SHINGLES).collect())
    return np.array([h for h, _ in got], np.uint64), np.array([c for _, c in got], np.int64)


def _facts(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """(o, key, n, fp, map, wide, first) of every row: o orders rows by id, null last, and tells the row; key tells sets apart."""
    shared = docs.sparkSession.sparkContext.broadcast(_frequent(docs, id_col, text))  # at most SAMPLE_SHINGLES

    @F.pandas_udf("key long, n long, fp long, map array<long>, wide array<long>, first array<long>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        from xxhash import xxh64_intdigest

        known, times = shared.value
        for part in parts:
            rows = []
            for t in part:
                h = shingles(t if isinstance(t, str) else None)
                count = np.zeros(len(h), np.int64)
                if len(known):
                    at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                    count = np.where(known[at] == h, times[at], 0)
                first = h[np.lexsort((h, count))][: len(h) - -(-LIKE * len(h) // OF) + 1]
                key = np.array(xxh64_intdigest(h.tobytes(), 42), np.uint64).view(np.int64).item()
                rows.append((key, len(h), majority(h), parity(h), wide(h), first.view(np.int64)))
            yield pd.DataFrame(rows, columns=["key", "n", "fp", "map", "wide", "first"])
        part = rows = None
        give_back()

    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("t"), run(F.col(text)).alias("s"))
    with small_batches(docs.sparkSession):
        return cut(rows.select(F.struct(F.col("id").isNull().alias("none"), "id", "t", F.col("s.key").alias("key")).alias("o"), "s.*"), "near-facts")


def _may(n: Column, their_n: Column, bits: Column, their_bits: Column) -> Column:
    """No pair of the similarity fails: neither is shorter than 4/5 of the other, and they differ in at most a ninth of their sizes' sum."""
    sizes = (LIKE * F.greatest(n, their_n) <= OF * F.least(n, their_n))
    apart = sum((F.bit_count(bits[k].bitwiseXOR(their_bits[k])) for k in range(MAP_WORDS)), F.lit(0))
    return sizes & ((OF + LIKE) * apart <= (OF - LIKE) * (n + their_n))


def _may_wide(pairs: DataFrame, wides: DataFrame) -> DataFrame:
    """``pairs`` (key, other) without those of long texts that differ in too many bits of their wide maps."""
    a = wides.select("key", "n", "wide")
    b = wides.select(F.col("key").alias("other"), F.col("n").alias("n2"), F.col("wide").alias("wide2"))
    # sizes within 4/5 of each other: of two maps one is at most twice as wide, and is folded
    least = F.least(F.size("wide"), F.size("wide2"))

    def folded(x: Column) -> Column:
        halves = F.zip_with(F.slice(x, 1, least), F.slice(x, least + 1, least), lambda p, q: p.bitwiseXOR(q))
        return F.when(F.size(x) > least, halves).otherwise(x)

    bits = F.zip_with(folded(F.col("wide")), folded(F.col("wide2")), lambda p, q: F.bit_count(p.bitwiseXOR(q)))
    apart = F.aggregate(bits, F.lit(0), lambda s, x: s + x)
    fine = F.col("wide").isNull() | F.col("wide2").isNull() | ((OF + LIKE) * apart <= (OF - LIKE) * (F.col("n") + F.col("n2")))
    return pairs.join(a, "key", "left").join(b, "other", "left").where(fine).select("key", "other")


def _verified(pairs: DataFrame, nodes: DataFrame, wides: DataFrame, docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """(key): the later ones of candidate pairs (key, other), ``other`` being the earlier, that are near copies by their whole texts."""

    @F.pandas_udf("boolean")
    def same(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for a, b in parts:
            sets = {t: shingles(t) for t in {*a, *b}}
            yield pd.Series([near(sets[x], sets[y]) for x, y in zip(a, b, strict=True)], dtype=bool)
        a = b = sets = None
        give_back()

    with last_stays():
        return _met(cut(_may_wide(pairs, wides), "near-pairs"), nodes, docs, id_col, text, same)


def _met(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, id_col: str, text: str, same: Callable) -> DataFrame:
    """(key) of the pairs whose texts, put side by side, are the ``same``; stored."""
    keys = pairs.select("key").union(pairs.select("other")).distinct()
    asked = cut(nodes.join(keys, "key").select("key", F.col("o.id").alias("_near_id"), F.col("o.t").alias("_near_t")), "near-asked")
    if asked.count() <= BROADCAST_ROWS:
        asked = F.broadcast(asked)
    body = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("t"), F.coalesce(F.col(text), F.lit("")).alias("body"))
    found = body.join(asked, F.col("id").eqNullSafe(F.col("_near_id")) & (F.col("t") == F.col("_near_t")))
    texts = cut(found.select("key", "body").dropDuplicates(["key"]), "near-texts")
    met = pairs.join(texts, "key").join(texts.select(F.col("key").alias("other"), F.col("body").alias("their")), "other")
    with small_batches(docs.sparkSession):
        return cut(met.where(same("body", "their")).select("key").distinct(), "near-gone")


def _by_fingerprint(nodes: DataFrame) -> DataFrame:
    """(key, other): each text and the first one of the least fingerprint of its SimHash component, the later one first."""
    first = cut(nodes.groupBy("fp").agg(F.min(F.struct("o", "key", "n", "map")).alias("m")), "near-fp")
    comp = components(links(first.select(F.col("fp").alias("id"), "fp")))
    rooted = nodes.join(comp, nodes["fp"] == comp["node"], "left").withColumn("root", F.coalesce("component", "fp"))
    pivots = first.select(F.col("fp").alias("root"), F.col("m.o").alias("o2"), F.col("m.key").alias("pivot"), F.col("m.n").alias("n2"), F.col("m.map").alias("map2"))
    both = rooted.join(pivots, "root").where((F.col("key") != F.col("pivot")) & _may(F.col("n"), F.col("n2"), F.col("map"), F.col("map2")))
    later = F.col("o") > F.col("o2")
    return both.select(F.when(later, F.col("key")).otherwise(F.col("pivot")).alias("key"), F.when(later, F.col("pivot")).otherwise(F.col("key")).alias("other"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without near copies: no two texts of similarity 0.8 or more stay.

    Each text that goes is near one with a smaller id, or a chain of such leads
    to one that stays; null ids come last. Texts without words are alike. Rows
    alike in id and text stay or go together. All columns are kept, whatever
    their names. An empty table gives no rows.
    """
    facts = _facts(docs, id_col, text)
    nodes = cut(facts.groupBy("key").agg(F.min(F.struct("o", "n", "fp", "map")).alias("m")).select("key", "m.*"), "near-nodes")
    wides = cut(facts.where("wide is not null").select("key", "n", "wide").dropDuplicates(["key"]), "near-wide")
    total = nodes.count()
    with last_stays():
        pairs = cut(_by_fingerprint(nodes), "near-pairs")
    gone = [_verified(pairs, nodes, wides, docs, id_col, text)]
    posts = facts.join(nodes.select(F.col("o").alias("least")), F.col("o") == F.col("least"), "left_semi").join(gone[0], "key", "left_anti")
    posts = posts.select("key", "o", F.posexplode("first").alias("at", "h"))
    shared = posts.groupBy("h").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("h")
    live = cut(posts.join(shared, "h"), "near-posts")
    facts_of = nodes.select("key", "n", "map")
    theirs = facts_of.select(F.col("key").alias("other"), F.col("n").alias("n2"), F.col("map").alias("map2"))
    tested = None
    while total:
        leaders = live.groupBy("h", F.pmod("key", F.lit(LEADERS)).alias("k")).agg(F.min(F.struct("o", "key")).alias("m"))
        leaders = leaders.select("h", F.col("m.key").alias("other"), F.col("m.o").alias("o2"))
        met = live.join(leaders, "h").where("o2 < o").groupBy("key", "other").agg(F.count(F.lit(1)).alias("c"))
        if tested is not None:
            met = met.join(tested, ["key", "other"], "left_anti")
        able = met.join(facts_of, "key").join(theirs, "other").where(_may(F.col("n"), F.col("n2"), F.col("map"), F.col("map2")))
        pairs = cut(able.groupBy("key").agg(F.max_by("other", F.struct("c", "other")).alias("other")), "near-pairs")
        tested = pairs if tested is None else tested.unionByName(pairs)
        went = _verified(pairs, nodes, wides, docs, id_col, text)
        gone.append(went)
        live = cut(live.join(went, "key", "left_anti"), "near-posts")
        dropped = went.count()
        if dropped * OF_TESTED < pairs.count() or dropped * OF_ALL <= total:
            break
    if total:
        again = live.groupBy("h").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("h")
        full = cut(live.join(again, "h").join(facts_of, "key"), "near-posts")
        others = full.select("h", F.col("key").alias("other"), F.col("o").alias("o2"), F.col("at").alias("at2"), F.col("n").alias("n2"), F.col("map").alias("map2"))
        # what precedes a shared shingle in one set can only be shared with what precedes it in the other, and likewise behind it
        most = F.least("at", "at2") + F.least(F.col("n") - F.col("at"), F.col("n2") - F.col("at2"))
        able = (F.col("o2") < F.col("o")) & _may(F.col("n"), F.col("n2"), F.col("map"), F.col("map2")) & ((OF + LIKE) * most >= LIKE * (F.col("n") + F.col("n2")))
        pairs = full.join(others, "h").where(able).select("key", "other").distinct()
        gone.append(_verified(cut(pairs, "near-pairs"), nodes, wides, docs, id_col, text))
    for went in gone:
        nodes = nodes.join(went, "key", "left_anti")
    keep = nodes.select(F.col("o.id").alias("_near_id"), F.col("o.t").alias("_near_t"))
    marked = docs.withColumn("_near_own", F.xxhash64(text))
    return marked.join(keep, F.col(id_col).eqNullSafe(F.col("_near_id")) & (F.col("_near_own") == F.col("_near_t")), "left_semi").select(*docs.columns)
