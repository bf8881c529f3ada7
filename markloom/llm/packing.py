"""Best-fit packing of tokenised documents into sequences of fixed capacity.

Token counts have at most ``capacity`` different values, so the packing is
solved on their histogram: large items (above a third of the capacity) are
matched greedily, at most two to a bin, the longest first with the longest that
still fits; the others go, longest first, to the tightest remaining gap. Equal
bins are handled as one class with a multiplicity, so the plan's size depends on
the capacity alone, not on the number of documents. Pieces then find their slot
by their rank among pieces of equal length; ranks come from counts per (length,
bucket), summed up by ranges, and a rank within the bucket. A length of n pieces
has about sqrt(n) buckets of sqrt(n) pieces, so no task holds a whole length.
"""

from __future__ import annotations

import array
import bisect
import math
import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, give_back, small_batches, sums_before

CAPACITY = 2048
EOT = 0
#: Word cache of a task: entries until it is emptied.
CACHE_WORDS = 1_000_000
PIECES = "id long, piece int, start long, length long, ids_crc32 long"

_SEPARATORS = re.compile(r"[\x1c-\x1f]").search
_encoders: dict[str, object] = {}


class WordEncoder:
    """Token ids as little-endian bytes, through a cache of words.

    The tokenizer splits a text into words and encodes each by itself. For texts
    of characters below U+0300, where normal form C changes nothing, the words
    are found here and each distinct one is encoded once. Any other text, or one
    that holds a special token's string, goes to the tokenizer whole.
    """

    #: The tokenizer's words, spelled out for characters below U+0300: letters together, digits one by one, the rest together.
    PATTERN = (
        r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_\xb2\xb3\xb9\xbc-\xbe]+|[\d\xb2\xb3\xb9\xbc-\xbe]|(?:[^\w\t-\r \x85\xa0]|_)+"
    )

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.words = re.compile(self.PATTERN).findall
        self.beyond = re.compile(r"[^\x00-\x1b -\u02ff]").search
        words = self.words
        tokenize = self.tokenizer.model.tokenize
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = sorted(set(range(256)) - set(shown))
        letters = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}  # bytes as the vocabulary spells them

        class Cache(dict):
            def __missing__(self, word: str) -> bytes:
                if len(self) >= CACHE_WORDS:
                    self.clear()
                ids = [t.id for w in words(word.lower()) for t in tokenize(w.encode().decode("latin-1").translate(letters))]
                out = self[word] = array.array("I", ids).tobytes()
                return out

        self.cache = Cache()

    def __call__(self, text: str) -> bytes:
        if "<|" in text or (not text.isascii() and self.beyond(text)) or (text.isascii() and _SEPARATORS(text)):
            return array.array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        return b"".join(map(self.cache.__getitem__, text.split()))


def encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def tokenize_pieces(docs: DataFrame, id_col: str, text: str, vocabulary: str, capacity: int = CAPACITY) -> DataFrame:
    """(id, piece, start, length, ids_crc32) of every piece; whole texts, streamed by Arrow batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, end, step = encoder(vocabulary), array.array("I", [EOT]).tobytes(), 4 * capacity
        for batch in batches:
            rows = []
            for key, body in zip(batch["id"], batch["text"], strict=True):
                ids = (encode(body) if isinstance(body, str) else b"") + end
                for piece, at in enumerate(range(0, len(ids), step)):
                    part = ids[at : at + step]
                    rows.append((key, piece, at // 4, len(part) // 4, zlib.crc32(part)))
            out = pd.DataFrame(rows, columns=["id", "piece", "start", "length", "ids_crc32"])
            out["id"] = out["id"].astype("Int64")
            yield out
        encode.cache.clear()  # the worker may serve other stages next; a task of texts fills it anew
        batch = rows = out = None
        give_back()

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text")).mapInPandas(run, PIECES)


def pack_histogram(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Classes of bins, (lengths in the bin, how many such bins), for counts by length."""
    left = {n: c for n, c in counts.items() if c > 0 and n > 0}
    large = sorted((n for n in left if 3 * n > capacity), reverse=True)
    bins: list[tuple[tuple[int, ...], int]] = []
    partners = sorted(large)  # ascending, those with some left
    for n in large:
        while left[n]:
            fit = bisect.bisect_right(partners, capacity - n) - 1
            while fit >= 0 and not left[partners[fit]]:
                partners.pop(fit)
                fit -= 1
            if fit < 0:
                bins.append(((n,), left[n]))
                left[n] = 0
                break
            m = partners[fit]
            k = left[n] // 2 if m == n else min(left[n], left[m])
            if not k:  # one is left and only itself would fit
                smaller = next((x for x in reversed(partners[:fit]) if left[x]), None)
                bins.append(((n, smaller) if smaller else (n,), 1))
                left[n] -= 1
                if smaller:
                    left[smaller] -= 1
                continue
            bins.append(((n, m), k))
            left[n] -= k
            left[m] -= k
    gaps: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    for content, k in bins:
        gaps.setdefault(capacity - sum(content), []).append((content, k))
    order = sorted(gaps)
    for n in sorted((n for n in left if left[n]), reverse=True):
        while left[n]:
            at = bisect.bisect_left(order, n)
            if at == len(order):  # no gap is wide enough: open bins of as many as fit
                per = min(capacity // n, left[n])
                content, k = (n,) * per, left[n] // per
                left[n] -= per * k
            else:
                gap = order[at]
                content, k = gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap]
                    order.pop(at)
                per = min(gap // n, left[n])
                use = min(k, left[n] // per)
                if use < k:
                    if gap not in gaps:
                        gaps[gap] = []
                        bisect.insort(order, gap)
                    gaps[gap].append((content, k - use))
                content, k = content + (n,) * per, use
                left[n] -= per * use
            rest = capacity - sum(content)
            if rest not in gaps:
                gaps[rest] = []
                bisect.insort(order, rest)
            gaps[rest].append((content, k))
    return [x for found in gaps.values() for x in found]


def _slots(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, ranks, first sequence, offset) for every place in every class of bins."""
    out, seen, sequence = [], dict.fromkeys(counts, 0), 0
    for content, k in pack_histogram(counts, capacity):
        offset = 0
        for n in content:
            out.append((n, seen[n], k, sequence, offset))
            seen[n] += k
            offset += n
        sequence += k
    return out


def assign(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to (id, piece, start, length, ...), which must be a stored table."""
    spark = pieces.sparkSession
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `capacity` rows
    slots = spark.createDataFrame(
        _slots(counts, capacity),
        "s_length long, s_first long, s_ranks long, s_sequence long, s_offset long",
    )
    starts, seen = [], 0
    for n in sorted(counts):
        starts.append((n, math.isqrt(counts[n]) + 1, seen))
        seen += counts[n]
    lengths = spark.createDataFrame(starts, "b_length long, b_buckets long, b_start long")
    spread = (
        pieces.join(F.broadcast(lengths), F.col("length") == F.col("b_length"))  # at most `capacity` rows
        .withColumn("bucket", F.pmod(F.xxhash64("id", "piece", "ids_crc32"), F.col("b_buckets")))
    )
    per = spread.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"), F.first("b_start").alias("b_start"))
    first = sums_before(per, ["length", "bucket"], {"before": F.col("n")}).select("length", "bucket", (F.col("before") - F.col("b_start")).alias("before"))
    spread = spread.drop("b_length", "b_buckets", "b_start")
    inside = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("id", "piece", "ids_crc32")) - 1
    ranked = (
        spread.withColumn("inside", inside)
        .join(first, ["length", "bucket"])
        .withColumn("rank", F.col("before") + F.col("inside"))
    )
    # at most a few places per length and class: bounded by the capacity, not by the input
    return ranked.join(
        F.broadcast(slots),
        (F.col("length") == F.col("s_length")) & (F.col("rank") >= F.col("s_first")) & (F.col("rank") < F.col("s_first") + F.col("s_ranks")),
    ).select(
        *pieces.columns,
        (F.col("s_sequence") + F.col("rank") - F.col("s_first")).alias("sequence_id"),
        F.col("s_offset").alias("offset"),
    )


def pack(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """Per piece of every document: id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its token ids and a closing 0; null or empty text is that 0
    alone. Only documents longer than ``capacity`` are cut. Repeated rows are
    packed each for itself. An empty table gives no rows; further columns are
    ignored.
    """
    with small_batches(docs.sparkSession):
        pieces = cut(tokenize_pieces(docs, id_col, text, vocabulary, capacity), "pack-pieces")
    return assign(pieces, capacity).withColumnRenamed("id", id_col)
