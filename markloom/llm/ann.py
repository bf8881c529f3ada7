"""Nearest neighbours by largest inner product through a permutation index.

Vectors are lifted by one coordinate to equal length, which makes the largest
inner product the nearest point. Each is represented by its nearest pivots in
order and posted, with its place in that order, in the inverted files of those
pivots. A query reads the files of its own nearest pivots and sums up the
footrule distance to every vector posted there. The best of them bound the k-th
largest product from below; rows outside are tested against that bound by one
product over the block, so that none is lost, and what meets it is scored
exactly.

Every row is indexed; only the pivots are a sample, at most ``PIVOTS``. The
index is cut into blocks of rows, each with its own inverted files, and the
queries into chunks; each chunk meets each block in one task and leaves k rows a
query, which are merged. A block's size is fixed, so no file grows with the
table and equal vectors spread over blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PIVOTS = 256
#: Pivots in an order: those a vector is posted under, and those a query visits.
ORDER = 64
#: Of a block's rows, so large a share, and at least so many, set the bound that the others must meet.
SCORED_SHARE, SCORED_LEAST = 0.1, 200
BLOCK_ROWS, QUERY_ROWS = 8192, 32_768
#: Queries whose products with a block are taken at once.
BATCH = 64


def usable(vector: Column) -> Column:
    """Not null or empty, all components finite and not all zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.coalesce((F.size(vector) > 0) & ~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


@dataclass
class Pivots:
    points: np.ndarray  # lifted to one dimension more
    longest: float  # squared length of the longest vector

    def orders(self, x: np.ndarray, query: bool) -> np.ndarray:
        """Indices of the nearest pivots, nearest first, for each row."""
        lift = np.zeros(len(x)) if query else np.sqrt(np.maximum(0.0, self.longest - (x * x).sum(axis=1)))
        near = x @ self.points[:, :-1].T + lift[:, None] * self.points[:, -1]
        far = (self.points * self.points).sum(axis=1) - 2 * near
        k = min(ORDER, len(self.points))
        part = np.argpartition(far, k - 1, axis=1)[:, :k]
        rows = np.arange(len(x))[:, None]
        return part[rows, np.argsort(far[rows, part], axis=1, kind="stable")].astype(np.int16)


def _pivots(valid: DataFrame, longest: float, n: int) -> Pivots:
    h = F.xxhash64(F.lit(3), "vec_id")
    # a threshold leaves about four times as many as wanted, so that tasks send few rows each
    few = valid.where(F.shiftrightunsigned(h, 11).cast("double") / F.lit(float(1 << 53)) < min(1.0, 4 * PIVOTS / n))
    rows = few.orderBy(h, "vec_id").limit(PIVOTS).select("v").collect()  # the documented sample
    x = np.unique(np.array([r["v"] for r in rows], np.float64), axis=0)
    lift = np.sqrt(np.maximum(0.0, longest - (x * x).sum(axis=1)))
    return Pivots(np.hstack([x, lift[:, None]]), longest)


def _route(valid: DataFrame, pivots: Pivots, query_mod: int, blocks: int, chunks: int) -> DataFrame:
    """(block, chunk, role, vec_id, v, seq): role 0 is a row of the index, role 1 a query."""
    shared = valid.sparkSession.sparkContext.broadcast(pivots)  # at most PIVOTS points

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = shared.value
        for batch in batches:
            x, ids = np.stack(batch["v"].to_numpy()).astype(np.float64), batch["vec_id"].to_numpy()
            mixed = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(29)
            own_block, own_chunk = (mixed % np.uint64(blocks)).astype(np.int64), (mixed // np.uint64(blocks) % np.uint64(chunks)).astype(np.int64)
            if len(batch):
                at = np.arange(len(ids))
                for role, rows, copies in ((0, at, chunks), (1, at[ids % query_mod == 0], blocks)):
                    if not len(rows):
                        continue
                    orders = p.orders(x[rows], role == 1)
                    pick, other = np.repeat(np.arange(len(rows)), copies), np.tile(np.arange(copies), len(rows))
                    mine = (own_block if role == 0 else own_chunk)[rows][pick]
                    yield pd.DataFrame({
                        "block": mine if role == 0 else other, "chunk": other if role == 0 else mine, "role": role, "vec_id": ids[rows][pick],
                        "v": [x[k].tobytes() for k in rows[pick]], "seq": [orders[k].tobytes() for k in pick],
                    })

    return valid.select("vec_id", "v").mapInPandas(run, "block long, chunk long, role int, vec_id long, v binary, seq binary")


class Files:
    """Inverted files of one block: for each pivot a number per row, its place in the row's order or, if it is not there, their number."""

    def __init__(self, seq: np.ndarray, n_pivots: int):
        rows, self.width = seq.shape
        self.places = np.full((n_pivots, rows), self.width, np.uint16)
        self.places[seq.ravel(), np.repeat(np.arange(rows), self.width)] = np.tile(np.arange(self.width, dtype=np.uint16), rows)

    def footrule(self, order: np.ndarray) -> np.ndarray:
        """Distance of every row to a query's order; a pivot missing from either stands behind its last.

        Beside a constant, a pivot at place j of the query and t of the row adds
        |t - j| - (n - j) - (n - t) = 2 max(t, j) - 2 n, which is 0 where the row lacks it.
        """
        total = np.zeros(self.places.shape[1], np.uint16)
        later = np.empty_like(total)
        for place, pivot in enumerate(order):
            np.maximum(self.places[pivot], np.uint16(place), out=later)
            total += later
        n = self.width
        return 2 * (total.astype(np.int32) - n * len(order)) + 2 * int((n - np.arange(n)).sum())


def _search(k: int, n_pivots: int):  # noqa: ANN202
    def run(group: pd.DataFrame) -> pd.DataFrame:
        posts, asks = group[group["role"] == 0].sort_values("vec_id"), group[group["role"] == 1]
        none = pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64"), "block": pd.Series(dtype="int64")})
        if posts.empty or asks.empty:
            return none
        x, seq, ids = _rows(posts["v"], np.float64), _rows(posts["seq"], np.int16), posts["vec_id"].to_numpy()
        q, q_seq, q_ids = _rows(asks["v"], np.float64), _rows(asks["seq"], np.int16), asks["vec_id"].to_numpy()
        files = Files(seq, n_pivots)
        scored = min(len(ids), max(SCORED_LEAST, k + 1, int(len(ids) * SCORED_SHARE)))
        out = []
        for at, (row, order, own) in enumerate(zip(q, q_seq, q_ids, strict=True)):
            if at % BATCH == 0:
                products = q[at : at + BATCH] @ x.T
            near, others = products[at % BATCH], ids != own
            slack = 1e-9 * max(1.0, np.abs(near).max())  # the product's last bits depend on its layout: keep all that may be among the k
            foot = files.footrule(order)
            first = near[(foot <= np.partition(foot, scored - 1)[scored - 1]) & others]
            bound = np.partition(first, len(first) - k)[len(first) - k] if len(first) > k else -np.inf
            best = np.flatnonzero((near >= bound - slack) & others)
            if len(best) > k:
                best = best[near[best] >= np.partition(near[best], len(best) - k)[len(best) - k] - slack]
            score = exact_scores(x[best], row)
            top = np.lexsort((ids[best], -score))[:k]
            out.append((np.full(len(top), own), ids[best][top], score[top]))
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), map(np.concatenate, zip(*out, strict=True)), strict=True))).assign(block=posts["block"].iloc[0])

    return run


def exact_scores(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products in double precision, summed in order of the components."""
    return (x * q).cumsum(axis=1)[:, -1] if len(x) else np.zeros(0)


def _rows(column: pd.Series, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(column), kind).reshape(len(column), -1)


def nearest(
    vectors: DataFrame, k: int = 20, query_mod: int = 20, id_col: str = "vec_id", vector: str = "embedding",
    block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each row whose id is divisible by ``query_mod``.

    Vectors that are null, empty, zero or hold null or non-finite components,
    and rows with null id, take no part. Vectors of different dimension have no
    inner product: each dimension is searched by itself. Ties go to the smaller
    id; of repeated ids the best score counts. A query never finds its own id.
    Columns other than the two are ignored, whatever their names. Without
    vectors there are no rows.
    """
    base = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector).cast(T.ArrayType(T.DoubleType())).alias("v"))
    base = base.where(F.col("vec_id").isNotNull() & usable(F.col("v")))
    size = F.size("v")
    ends = base.agg(F.min(size).alias("least"), F.max(size).alias("most")).first()
    if ends["least"] != ends["most"]:
        found = [
            nearest(base.where(size == r["d"]), k, query_mod, "vec_id", "v", block_rows, query_rows)
            for r in base.select(size.alias("d")).distinct().orderBy("d").collect()  # as many as there are dimensions
        ]
        return _best(reduce(DataFrame.unionByName, found).select("query_id", "vec_id", "score", F.lit(0).alias("lot")), k)
    len2 = F.aggregate("v", F.lit(0.0), lambda s, y: s + y * y)
    valid = base.withColumn("len2", len2)
    asked = (F.col("vec_id") % query_mod == 0).cast("long")
    stats = valid.agg(F.count(F.lit(1)).alias("n"), F.max("len2").alias("longest"), F.sum(asked).alias("queries")).first()
    if not stats["queries"]:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    blocks, chunks = -(-stats["n"] // block_rows), -(-stats["queries"] // query_rows)
    pivots = _pivots(valid, stats["longest"], stats["n"])
    routed = _route(valid, pivots, query_mod, blocks, chunks)
    found = routed.groupBy("block", "chunk").applyInPandas(_search(k, len(pivots.points)), "query_id long, vec_id long, score double, block long")
    return _best(found.withColumn("lot", F.col("block") % (math.isqrt(blocks) + 1)), k)


def _best(found: DataFrame, k: int) -> DataFrame:
    """The k best rows of each query with their rank: lots of blocks first, so that neither step's buffers grow with the table."""
    best = found.groupBy("query_id", "lot", "vec_id").agg(F.max("score").alias("score"))
    own = F.struct((-F.col("score")).alias("s"), "vec_id", "score")
    lots = best.groupBy("query_id", "lot").agg(F.slice(F.array_sort(F.collect_list(own)), 1, k).alias("some"))
    rows = lots.select("query_id", F.inline("some")).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    top = rows.groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list(own)), 1, k).alias("top"))
    return top.select("query_id", F.posexplode("top").alias("pos", "t")).select(
        "query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("t.vec_id").alias("vec_id"), F.col("t.score").alias("score")
    )
