"""SimHash near-dedup by deletion-variant signatures.

Fingerprints of 64 bits link at three or fewer differing bits, so of two halves
one differs in at most one bit. Each distinct fingerprint is indexed by both
halves as they are and by their 32 variants with one bit taken out; an
equality join on a variant finds the pairs whose half differs in just that bit,
and each candidate is verified on all 64 bits. Where a variant is shared by many
fingerprints, the other half is cut further so that one of its parts must be
equal, and that part joins the key: the pairs tested stay few however large a
group of copies is, and no pair is lost.

Equal fingerprints are one node from the start; links exist between distinct
fingerprints only.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, dealt
from .components import components

MAX_BITS = 3
SHINGLE = 3
#: Fingerprints whose variants one task makes, about.
NODES_PER_TASK = 20_000
#: Variants shared by more fingerprints than this are cut further.
CROWD = 48


def fingerprint(text: str | None, width: int = SHINGLE) -> int:
    """SimHash over XXH64 (seed 42) of the word shingles of the text in lower case A-Z."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < width:
        return xxh64_intdigest(b" ".join(words), 42)
    n = len(words) - width + 1
    total = np.zeros(64, np.int64)
    step = 1 << 15
    for at in range(0, n, step):
        part = words[at : at + step + width - 1]
        grams = map(b" ".join, zip(*(part[k:] for k in range(width)), strict=False))
        h = np.fromiter(map(xxh64_intdigest, grams, repeat(42)), np.uint64)
        bits = np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        total += bits.sum(axis=0, dtype=np.int32)
    packed = np.packbits((2 * total > n).astype(np.uint8))
    return int.from_bytes(packed.tobytes(), "big")


def with_fingerprint(docs: DataFrame, text: str = "text", name: str = "fp") -> DataFrame:
    """``docs`` plus a signed 64-bit fingerprint; null text counts as empty (fingerprint 0)."""

    @F.pandas_udf("long")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series(np.array([fingerprint(t if isinstance(t, str) else None) for t in part], np.uint64).view(np.int64))

    return docs.withColumn(name, run(F.col(text)))


def _parts(word: str, n: int) -> str:
    """SQL array of the n parts of a 32-bit word."""
    size = -(-32 // n)
    return "array(" + ", ".join(f"(shiftright({word}, {k * size}) & {(1 << min(size, 32 - k * size)) - 1})" for k in range(n)) + ")"


def _first_equal(one: str, other: str) -> str:
    """SQL: none of the parts before number ``part`` is equal in both words."""

    def before(n: int) -> str:
        size = -(-32 // n)
        tests = [f"(part <= {k} or shiftright({one} ^ {other}, {k * size}) & {(1 << min(size, 32 - k * size)) - 1} <> 0)" for k in range(n - 1)]
        return "(" + " and ".join(tests) + ")"

    return f"if(s = 2, {before(4)}, {before(3)})"


def links(nodes: DataFrame, max_bits: int = MAX_BITS, crowd: int = CROWD) -> DataFrame:
    """(a, b): ids of all linked pairs among the rows (id, fp) of a stored table with distinct fp, each pair once.

    ``max_bits`` is at most 3: two halves, one of them within one bit. A pair
    that meets under several keys is given under the first of them only.
    """
    if not 0 <= max_bits <= 3:
        raise ValueError("max_bits must be 0 to 3")
    # each row makes 66 variants: many small parts, however few files the table has
    halves = dealt(nodes, NODES_PER_TASK).select(
        "id", "fp",
        F.explode(F.array(
            F.struct(F.lit(0).alias("half"), F.expr("shiftrightunsigned(fp, 32)").alias("seg"), F.expr("fp & 4294967295L").alias("rest")),
            F.struct(F.lit(1).alias("half"), F.expr("fp & 4294967295L").alias("seg"), F.expr("shiftrightunsigned(fp, 32)").alias("rest")),
        )).alias("x"),
    ).select("id", "fp", "x.half", "x.seg", "x.rest")
    variants = halves.select(
        "id", "fp", "rest",
        # bit -1: the half as it is; bit j: bit j taken out, side tells which value it had
        F.explode(F.expr(
            "transform(sequence(-1, 31), j -> named_struct("
            "'key', (half * 33 + j + 1) * 4294967296L + if(j < 0, seg, seg & ~shiftleft(1L, j)),"
            "'side', if(j < 0, 2, cast(shiftrightunsigned(seg, j) & 1 as int))))"
        )).alias("v"),
    ).select("id", "fp", "rest", "v.key", "v.side")
    variants = cut(variants, "simhash-variants")
    # a wildcard key only pairs its two sides: keys with one side missing go before anything is joined
    sides = variants.groupBy("key").agg(
        F.count(F.lit(1)).alias("n"), F.max((F.col("side") != 0).cast("int")).alias("one"), F.max((F.col("side") != 1).cast("int")).alias("zero")
    ).where("n > 1 and one = 1 and zero = 1").select("key", "n")
    live = cut(variants.join(sides, "key"), "simhash-live")
    # bits left for the other half: 3 where the half is equal, else 2; so of 4 (or 3) parts one is equal
    cuts = F.when(F.col("side") == 2, F.expr(_parts("rest", 4))).otherwise(F.expr(_parts("rest", 3)))
    keyed = live.select(
        "id", "fp", "key", "side", "rest",
        F.posexplode(F.when(F.col("n") > crowd, cuts).otherwise(F.array(F.lit(-1).cast("long")))).alias("part", "value"),
    )
    left = keyed.where("side <> 1").select("key", "part", "value", F.col("side").alias("s"), "rest", F.col("id").alias("a"), F.col("fp").alias("x"))
    right = keyed.where("side <> 0").select("key", "part", "value", F.col("rest").alias("their"), F.col("id").alias("b"), F.col("fp").alias("y"))
    near = (
        F.expr(f"bit_count(x ^ y) <= {int(max_bits)}") & ((F.col("s") != 2) | (F.col("a") < F.col("b")))
        & F.expr(f"key < {33 << 32}L or bit_count(shiftrightunsigned(x ^ y, 32)) > 1")  # in the second half only what the first does not show
        & F.expr("part < 1 or " + _first_equal("rest", "their"))
    )
    return left.join(right, ["key", "part", "value"]).where(near).select("a", "b")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, fp, component_id.

    component_id is the smallest id reachable over links, the row's own
    included. Texts without words share fingerprint 0 and are linked like any
    others. Nodes are fingerprints, so rows that repeat an id with other texts
    stand each for itself, and a row with null id links others as any row does;
    null names a group only if it holds no other id. Repeated rows share all
    values. Columns of ``docs`` other than the two are ignored, whatever their
    names. Empty table: no rows.
    """
    base = cut(with_fingerprint(docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))).select("id", "fp"), "simhash-fp")
    nodes = cut(base.groupBy("fp").agg(F.min("id").alias("least")), "simhash-nodes")
    comp = components(links(nodes.select(F.col("fp").alias("id"), "fp")))
    rooted = nodes.join(comp, nodes["fp"] == comp["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("root"))
    names = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(names, "root").select("fp", "component_id")
    return base.join(named, "fp").select(F.col("id").alias(id_col), "fp", "component_id")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each group of near copies, the one with the smallest id.

    Of rows repeated with that id, all with the same id stay only if their texts
    fall in different groups. All columns are kept.
    """
    groups = near_groups(docs, id_col, text)
    keep = groups.where(F.col(id_col).eqNullSafe(F.col("component_id"))).select(F.col(id_col).alias("_keep")).distinct()
    return docs.join(keep, docs[id_col].eqNullSafe(keep["_keep"]), "left_semi")
