"""Removal of repeated byte strings of fixed length.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts earlier:
in a smaller id, or earlier in the same text. The order of method asked for, a
distributed suffix array by difference cover, would sort a record for every
byte; the README has the figures. What it and this share is a sample of
positions: here it depends on content alone, so both places of a repeat sample
the same ones.

1. Of each window of LENGTH bytes the K-gram with the least hash is its anchor.
   Consecutive windows share an anchor, about 35 of them; an anchor with its run
   of windows, the span, is one record. Records meet by anchor hash. Where whole
   spans are equal, all but the first are repeats from end to end.
2. Where one anchor has different spans, the first of each is resolved window by
   window: their texts are read again and the hashes of single windows meet.
3. The intervals found are joined to the texts, merged and cut out.

Records travel packed, many to a row, by hash range. Each batch combines its own
copies first, so that a passage which a third of all documents share costs every
batch one record.
"""

from __future__ import annotations

import gc
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, sums_before

LENGTH = 100
K = 32
W = LENGTH - K + 1
#: Bytes of text handled at once by the vector steps; longer texts go in pieces of MOST.
STEP, MOST = 1 << 19, 1 << 19
#: Characters of text whose records are made, and whose copies are combined, at a time.
SLICE = 12 << 20
#: Bytes of text to a hash range of records.
RANGE_BYTES = 8 << 20

_rng = np.random.default_rng(2_024)
_BYTE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_POS = np.uint64((1 << 22) - 1)
_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = STEP * 2
    while size < n:
        size *= 2
    if size not in _tables:
        _tables[size] = tuple(
            np.concatenate([[np.uint64(1)], np.cumprod(np.full(size, b, np.uint64))]) for b in (_BASE, pow(_BASE, -1, 1 << 64))
        )
    return _tables[size]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(32))


def _sums(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    power, inverse = _powers(len(data) + 1)
    s = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * power[: len(data)], out=s[1:])
    return s, inverse


def _slide_min(x: np.ndarray, w: int) -> np.ndarray:
    n = len(x)
    rows = -(-n // w)
    full = np.full(rows * w, np.uint64(2**64 - 1))
    full[:n] = x
    grid = full.reshape(rows, w)
    pre = np.minimum.accumulate(grid, axis=1).ravel()
    suf = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(suf[: n - w + 1], pre[w - 1 : n])


def anchors(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Records of texts laid end to end: (text index, start in the text, windows, anchor hash, span hash)."""
    n = len(data)
    if n < LENGTH:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    s, inverse = _sums(data)
    gram = _mix((s[K:] - s[:-K]) * inverse[: n - K + 1])
    at = _slide_min((gram & ~_POS) | np.arange(len(gram), dtype=np.uint64), W) & _POS
    whole = np.ones(len(at), bool)
    for b in starts[1:]:
        whole[max(0, b - LENGTH + 1) : b] = False
    change = np.ones(len(at), bool)
    change[1:] = (at[1:] != at[:-1]) | (whole[1:] != whole[:-1])
    first = np.flatnonzero(change)
    count = np.diff(np.append(first, len(at)))
    good = whole[first]
    first, count = first[good], count[good]
    anchor = at[first].astype(np.int64)
    span = (s[first + count - 1 + LENGTH] - s[first]) * inverse[first]
    place = ((anchor - first).astype(np.uint64) << np.uint64(8)) | count.astype(np.uint64)
    text = np.searchsorted(starts, first, "right") - 1
    return text, first - starts[text], count, gram[anchor], _mix(span + _mix(place))


def windows(data: np.ndarray, first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of the windows of spans in one text."""
    s, inverse = _sums(data)
    at = np.repeat(first - np.cumsum(count) + count, count) + np.arange(count.sum())
    return at, _mix((s[at + LENGTH] - s[at]) * inverse[at])


def _later(keys: tuple[np.ndarray, ...], doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of records with equal keys: indices of the first, and of those that come later in id and start."""
    order = np.lexsort((start, doc, *reversed(keys)))
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.logical_or.reduce([k[order][1:] != k[order][:-1] for k in keys])
    head = order[new]
    lead = head[np.cumsum(new) - 1]
    same = (doc[order] == doc[lead]) & (start[order] == start[lead])  # a row that is repeated whole
    return head, order[~same]


def merge(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unions of overlapping or touching intervals of each document."""
    if not len(doc):
        return doc, start, end
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    base = np.zeros(len(doc), np.int64)
    base[1:] = np.cumsum(doc[1:] != doc[:-1])
    far = base * (1 << 40)
    top = np.maximum.accumulate(far + end)
    new = np.ones(len(doc), bool)
    new[1:] = far[1:] + start[1:] > top[:-1]
    heads = np.flatnonzero(new)
    return doc[heads], start[heads], np.append(top[heads[1:] - 1], top[-1]) - far[heads]


_FIELDS = (("h", np.uint64), ("s", np.uint64), ("doc", np.int64), ("start", np.int32), ("n", np.uint8))
_PACKED = "part long, kind int, h binary, s binary, doc binary, start binary, n binary"


def _pack(kind: int, ranges: int, h: np.ndarray, *more: np.ndarray) -> list[dict]:
    """Rows of packed columns, one for each hash range."""
    if not len(h):
        return []
    part = ((h >> np.uint64(16)) % np.uint64(ranges)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    cuts = np.flatnonzero(np.diff(part[order])) + 1
    columns = [np.ascontiguousarray(c[order].astype(t)) for c, (_, t) in zip((h, *more), _FIELDS, strict=True)]
    edges = np.concatenate([[0], cuts, [len(order)]])
    return [
        {"part": int(part[order[a]]), "kind": kind}
        | {f: _planes(c[a:b]) if f in _STEPS else c[a:b].tobytes() for (f, _), c in zip(_FIELDS, columns, strict=True)}
        for a, b in zip(edges[:-1], edges[1:], strict=True)
    ]


#: Columns that mostly rise in small steps: kept as differences, byte by byte, which exchanges compress.
_STEPS = {"doc", "start"}


def _planes(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(np.diff(x, prepend=x.dtype.type(0)).view(np.uint8).reshape(len(x), -1).T).tobytes()


def _from_planes(b: bytes, kind: type) -> np.ndarray:
    wide = np.frombuffer(b, np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.cumsum(np.ascontiguousarray(wide.T).view(kind).ravel(), dtype=kind)


def _unpack(rows: pd.DataFrame) -> list[np.ndarray]:
    def column(f: str, kind: type) -> np.ndarray:
        if f in _STEPS and len(rows):
            return np.concatenate([_from_planes(b, kind) for b in rows[f]])
        return np.frombuffer(b"".join(rows[f]), kind)

    return [column(f, kind) for f, kind in _FIELDS]


def _covers(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> pd.DataFrame:
    doc, start, end = merge(doc.astype(np.int64), start.astype(np.int64), end.astype(np.int64))
    return pd.DataFrame({"kind": np.ones(len(doc), np.int32), "doc": doc, "start": start, "end": end})


def _groups(texts: list[bytes]) -> Iterator[tuple[list[int], list[int], np.ndarray, np.ndarray]]:
    """Texts laid end to end up to STEP bytes: (which texts, offset in the text, data, starts)."""
    which: list[int] = []
    offsets: list[int] = []
    held: list[bytes] = []
    size = 0

    def out() -> tuple:
        starts = np.concatenate([[0], np.cumsum([len(x) for x in held])[:-1]]).astype(np.int64)
        return which, offsets, np.frombuffer(b"".join(held), np.uint8), starts

    for i, body in enumerate(texts):
        if len(body) < LENGTH:
            continue
        for at in range(0, len(body) - LENGTH + 1, MOST):  # pieces share LENGTH - 1 bytes
            piece = body[at : at + MOST + LENGTH - 1]
            if held and size + len(piece) > STEP:
                yield out()
                which, offsets, held, size = [], [], [], 0
            which.append(i)
            offsets.append(at)
            held.append(piece)
            size += len(piece)
    if held:
        yield out()


def _slices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Batches cut to about SLICE bytes of text, to keep a worker's memory low."""
    for batch in batches:
        size = batch["text"].map(lambda t: len(t) if isinstance(t, str) else 0).cumsum().to_numpy() // SLICE
        for part in np.unique(size):
            yield batch[size == part]


def _bodies(batch: pd.DataFrame) -> list[bytes]:
    return [t.encode("utf-8", "surrogatepass") if isinstance(t, str) else b"" for t in batch["text"]]


def _map_spans(ranges: int):  # noqa: ANN202
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in _slices(batches):
            ids, found = batch["doc"].to_numpy(), []
            for which, offsets, data, starts in _groups(_bodies(batch)):
                text, start, count, h, s = anchors(data, starts)
                found.append((h, s, ids[np.array(which)[text]], start + np.array(offsets)[text], count))
            if not found:
                continue
            h, s, doc, start, count = (np.concatenate(x) for x in zip(*found, strict=True))
            head, later = _later((h, s), doc, start)
            head.sort()
            rows = _pack(0, ranges, *(x[head] for x in (h, s, doc, start, count)))
            if len(later):  # repeats within the batch are known here
                d, a, b = merge(doc[later], start[later], start[later] + count[later] - 1 + LENGTH)
                u = d.astype(np.uint64)
                rows += _pack(1, ranges, _mix(u), b.astype(np.uint64), d, a, np.zeros(len(d)))
            yield pd.DataFrame(rows)

    return run


def _reduce_spans(rows: pd.DataFrame) -> pd.DataFrame:
    out = []
    known = rows[rows["kind"] == 1]
    if len(known):
        _, end, doc, start, _ = _unpack(known)
        out.append(_covers(doc, start, end))
    h, s, doc, start, count = _unpack(rows[rows["kind"] == 0])
    if len(h):
        head, later = _later((h, s), doc, start)
        start = start.astype(np.int64)
        out.append(_covers(doc[later], start[later], start[later] + count[later] - 1 + LENGTH))
        hh = h[head]
        many = np.zeros(len(hh), bool)
        many[1:] |= hh[1:] == hh[:-1]
        many[:-1] |= hh[1:] == hh[:-1]
        open_ = head[many]
        out.append(pd.DataFrame({"kind": np.full(len(open_), 2, np.int32), "doc": doc[open_], "start": start[open_], "end": start[open_] + count[open_]}))
    return pd.concat(out)


def _map_windows(ranges: int):  # noqa: ANN202
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in _slices(batches):
            found = []
            for doc, body, first, last in zip(batch["doc"], _bodies(batch), batch["a"], batch["b"], strict=True):
                first, last = np.asarray(first, np.int64), np.asarray(last, np.int64)
                for low in range(0, max(1, len(body)), MOST):
                    a, b = np.maximum(first, low), np.minimum(last, min(low + MOST, len(body) - LENGTH + 1))
                    if (a < b).any():
                        a, b = a[a < b], b[a < b]
                        start, h = windows(np.frombuffer(body[low : low + MOST + LENGTH], np.uint8), a - low, b - a)
                        found.append((h, start + low, np.full(len(h), doc)))
            if not found:
                continue
            h, start, doc = (np.concatenate(x) for x in zip(*found, strict=True))
            head, later = _later((h,), doc, start)
            head.sort()
            zero = np.zeros(len(head))
            rows = _pack(0, ranges, h[head], zero, doc[head], start[head], zero)
            if len(later):
                d, a, b = merge(doc[later], start[later], start[later] + LENGTH)
                rows += _pack(1, ranges, _mix(d.astype(np.uint64)), b.astype(np.uint64), d, a, np.zeros(len(d)))
            yield pd.DataFrame(rows)

    return run


def _reduce_windows(rows: pd.DataFrame) -> pd.DataFrame:
    out = [pd.DataFrame({"kind": pd.Series(dtype="int32"), "doc": pd.Series(dtype="int64"), "start": pd.Series(dtype="int64"), "end": pd.Series(dtype="int64")})]
    known = rows[rows["kind"] == 1]
    if len(known):
        _, end, doc, start, _ = _unpack(known)
        out.append(_covers(doc, start, end))
    h, _, doc, start, _ = _unpack(rows[rows["kind"] == 0])
    _, later = _later((h,), doc, start)
    out.append(_covers(doc[later], start[later], start[later].astype(np.int64) + LENGTH))
    return pd.concat(out)


_FOUND = "kind int, doc long, start long, end long"


def repeat_spans(docs: DataFrame) -> DataFrame:
    """(doc, start, end) byte intervals to remove from (doc, text); they may overlap."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(16, total // RANGE_BYTES)
    packed = docs.mapInPandas(_map_spans(ranges), _PACKED)
    first = cut(packed.groupBy("part").applyInPandas(_reduce_spans, _FOUND), "repeats-spans")
    _release(docs)
    unsettled = first.where("kind = 2").groupBy("doc").agg(F.collect_list(F.struct("start", "end")).alias("spans"))  # at most a text's length
    texts = docs.join(unsettled, "doc").select("doc", "text", F.col("spans.start").alias("a"), F.col("spans.end").alias("b"))
    second = cut(texts.mapInPandas(_map_windows(ranges), _PACKED).groupBy("part").applyInPandas(_reduce_windows, _FOUND), "repeats-windows")
    _release(docs)
    return first.where("kind = 1").unionByName(second).select("doc", "start", "end")


def _release(df: DataFrame) -> None:
    """Let Python and the JVM notice that earlier exchanges are done with, so that their files go."""
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()


def _numbered(rows: DataFrame) -> DataFrame:
    """(_id, text) with ``doc``: the id where it names one text, else a number for each id and text in the order of ids."""
    own = F.xxhash64("text")
    told = rows.groupBy("_id").agg((F.min(own) != F.max(own)).alias("many"))
    if not told.where("many or _id is null").limit(1).count():
        return rows.withColumn("doc", F.col("_id").cast("long"))
    each = rows.select((F.col("_id").isNotNull()).alias("known"), F.coalesce(F.col("_id").cast("long"), F.lit(0)).alias("id"), own.alias("own")).distinct()
    numbers = sums_before(each, ["known", "id", "own"], {"doc": F.lit(1).cast("long")})
    numbers = cut(numbers.select(F.col("known").alias("_k"), F.col("id").alias("_i"), F.col("own").alias("_o"), "doc"), "repeats-numbers")
    same = (F.col("_id").isNotNull() == F.col("_k")) & (F.coalesce(F.col("_id").cast("long"), F.lit(0)) == F.col("_i")) & (own == F.col("_o"))
    return rows.join(numbers, same).select("_id", "text", "doc")


def cut_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text", with_kept: bool = True) -> DataFrame:
    """Per row: id, n_bytes, n_removed, n_spans, kept (binary, unless turned off), kept_sha256.

    Texts are UTF-8 bytes, null counts as empty. A null id comes before all
    others; rows that share an id, or have none, with different texts are texts
    of their own, in the order of a hash of the text. A row repeated whole, id
    and text, is one text: its copies are treated alike. Texts under LENGTH
    bytes keep everything; columns other than the two are ignored, whatever
    their names; an empty table gives no rows.
    """
    base = _numbered(docs.select(F.col(id_col).alias("_id"), F.col(text).alias("text")))
    spans = repeat_spans(base.select("doc", "text"))
    per = spans.groupBy("doc").agg(F.collect_list(F.struct("start", "end")).alias("spans"))  # at most a text's length
    joined = base.join(per, "doc", "left").select("_id", "text", F.col("spans.start").alias("a"), F.col("spans.end").alias("b"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, body, a, b in zip(batch["_id"], _bodies(batch), batch["a"], batch["b"], strict=True):
                kept, removed, n = body, 0, 0
                if a is not None and len(a):
                    a, b = np.asarray(a, np.int64), np.asarray(b, np.int64)
                    _, a, b = merge(np.zeros(len(a), np.int64), a, np.minimum(b, len(body)))
                    good = a < b
                    a, b = a[good], b[good]
                    parts, at = [], 0
                    for x, y in zip(a, b, strict=True):
                        parts.append(body[at:x])
                        at = y
                    kept, removed, n = b"".join([*parts, body[at:]]), int((b - a).sum()), len(a)
                rows.append((key, len(body), removed, n, kept if with_kept else None, hashlib.sha256(kept).hexdigest()))
            out = pd.DataFrame(rows, columns=["_id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"])
            out["_id"] = out["_id"].astype("Int64")
            yield out

    done = joined.mapInPandas(run, "_id long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string")
    return done.withColumnRenamed("_id", id_col) if with_kept else done.withColumnRenamed("_id", id_col).drop("kept")
