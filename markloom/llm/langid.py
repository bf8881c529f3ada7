"""Language identification by error-correcting output codes.

Each language has a codeword of bits. For each bit a binary logistic classifier
over hashed byte n-grams of the letters says how the bit stands; decoding takes
the codeword of least loss over the bits, each bit weighted for each language by
how well its classifier did on that language in training, and flags ambiguity
where the two nearest codewords are close.

Classifiers are fitted on the driver on a bounded sample of labelled rows:
``SAMPLE_PER_LANG`` a language and ``SAMPLE_ROWS`` in all, those of the least
hashes of id and text. Every label is learned; of more than ``SAMPLE_ROWS``
labels, that many, the most frequent. Whole texts are read, in training and in prediction.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType, StructType

from .common import give_back

#: Features of the hashed n-gram space.
DIM = 4096
SAMPLE_PER_LANG = 900
SAMPLE_ROWS = 6000
#: A margin between the two nearest codewords below this is ambiguous.
AMBIGUOUS = 0.15
#: Ambiguous documents of a lower score are rejected.
LEAST_SCORE = 0.5
UND = "und"

_letter = regex.compile(r"\p{L}").search
_BYTES = np.arange(256)
# non-letters of ASCII become a space; bytes of longer characters stay
_FOLD = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_MIX = [np.random.default_rng(7 + k).integers(0, 1 << 32, 256, dtype=np.uint32) for k in range(3)]


def has_letter(text: str) -> bool:
    return _letter(text) is not None


@F.pandas_udf(BooleanType())
def lettered(part: pd.Series) -> pd.Series:
    """Whether a text has a letter; null has none."""
    return pd.Series([isinstance(t, str) and has_letter(t) for t in part], dtype=bool)


def features(texts: list[str]) -> np.ndarray:
    """Rows of L2-normed log counts of byte 1- to 3-grams, hashed to DIM columns."""
    out = np.zeros((len(texts), DIM), np.float32)
    mask, one, two, three = np.uint32(DIM - 1), *_MIX
    for i, text in enumerate(texts):
        body = unicodedata.normalize("NFC", text) if not text.isascii() else text
        data = b" " + b" ".join(body.lower().encode("utf-8", "ignore").translate(_FOLD).split()) + b" "
        count = np.zeros(DIM, np.int64)
        raw = np.frombuffer(data, np.uint8)
        for at in range(0, max(1, raw.size - 2), 1 << 20):  # whole text, in steps that keep memory low
            a = raw[at : at + (1 << 20) + 2]
            h1 = one[a]
            h2 = h1[:-1] * np.uint32(0x9E3779B1) + two[a[1:]]
            keys = [h1 >> 20 & mask, h2 >> 20 & mask]
            if a.size > 2:
                h3 = h2[:-1] * np.uint32(0x85EBCA6B) + three[a[2:]]
                keys.append(h3 >> 20 & mask)
            for k in keys:
                count += np.bincount(k, minlength=DIM)
        row = np.log1p(count, dtype=np.float32)
        norm = float(np.sqrt(row @ row))
        if norm:
            out[i] = row / norm
    return out


def codewords(n: int, extra: int = 8, seed: int = 11) -> np.ndarray:
    """n rows of -1/+1 codewords: one-against-rest bits and random balanced ones, far apart."""
    if n == 1:
        return np.ones((1, 1), np.float32)
    rng = np.random.default_rng(seed)
    bits = [np.where(np.arange(n) == k, 1, -1) for k in range(n)] if n <= 24 else []
    want = len(bits) + max(extra, 4 * int(np.ceil(np.log2(n))))
    tries = 0
    while len(bits) < want and tries < 2000:
        tries += 1
        b = np.where(rng.permutation(n) < (n + 1) // 2, 1, -1)
        same = any(abs(int(b @ c)) == n for c in bits)
        if not same or n > 64:
            bits.append(b)
    return np.array(bits, np.float32).T.copy()


@dataclass
class Model:
    """What a worker needs: languages, codewords (L x B), weights (L x B), linear classifiers."""

    langs: list[str]
    code: np.ndarray
    trust: np.ndarray
    w: np.ndarray
    b: np.ndarray

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Best language's index, its probability-like score and the margin to the next."""
        margin = x @ self.w + self.b
        loss = np.zeros((x.shape[0], len(self.langs)), np.float32)
        for k, word in enumerate(self.code):
            loss[:, k] = np.logaddexp(0, -margin * word) @ self.trust[k]
        order = np.argsort(loss, axis=1, kind="stable")
        rows = np.arange(len(loss))
        best = order[:, 0]
        if len(self.langs) == 1:
            return best, np.ones(len(loss)), np.ones(len(loss))
        p = np.exp(-(loss - loss[rows, best][:, None]) * self.code.shape[1] / 2)
        return best, p[rows, best] / p.sum(axis=1), loss[rows, order[:, 1]] - loss[rows, best]


@F.pandas_udf(BinaryType())
def _packed(part: pd.Series) -> pd.Series:
    return pd.Series([row.astype(np.float16).tobytes() for t in part for row in features([t])])


def fit(x: np.ndarray, langs: list[str], rounds: int = 120) -> Model | None:
    """Fit all bit classifiers at once by accelerated gradient steps on logistic loss."""
    names = sorted(set(langs))
    if not names:
        return None
    code = codewords(len(names))
    y_at = np.array([names.index(v) for v in langs])
    y = code[y_at]
    weight = 1.0 / np.bincount(y_at, minlength=len(names))[y_at].astype(np.float32)  # each language counts alike
    weight /= weight.sum()
    w, b = np.zeros((DIM, code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    vw, vb, step = w.copy(), b.copy(), 4.0
    for t in range(rounds if len(names) > 1 else 0):
        m = (x @ vw + vb) * y
        g = -(y / (1 + np.exp(m))) * weight[:, None]
        nw, nb = vw - step * (x.T @ g + 1e-6 * vw), vb - step * g.sum(axis=0)
        k = t / (t + 3)
        vw, vb = nw + k * (nw - w), nb + k * (nb - b)
        w, b = nw, nb
    right = (x @ w + b) * y > 0
    trust = np.array([right[y_at == k].mean(axis=0) for k in range(len(names))], np.float32)
    trust = np.maximum(trust - 0.5, 0.02)
    trust /= trust.sum(axis=1, keepdims=True)
    return Model(names, code, trust, w, b)


def training_sample(
    docs: DataFrame, id_col: str, text: str, lang: str, usable,  # noqa: ANN001
    per_lang: int = SAMPLE_PER_LANG, rows: int = SAMPLE_ROWS,
) -> tuple[np.ndarray, list[str]]:
    """Features (made on the executors, from whole texts) and languages of a bounded sample of labelled rows."""
    labelled = docs.where(usable & F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}"))
    h = F.xxhash64(F.lit(5), F.col(id_col), F.col(text))
    named = labelled.select(h.alias("h"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    counts = [(r["lang"], r["n"]) for r in named.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(rows).collect()]
    if not counts:
        return np.zeros((0, DIM), np.float32), []
    each = max(1, min(per_lang, rows // len(counts)))
    # a hash threshold leaves somewhat more rows of a language than wanted; those of the least hashes are kept
    chances = docs.sparkSession.createDataFrame([(k, min(1.0, (1.5 * each + 30) / n)) for k, n in counts], "lang string, chance double")
    u = F.shiftrightunsigned("h", 11).cast("double") / F.lit(float(1 << 53))
    few = named.withColumn("u", u).join(F.broadcast(chances), "lang").where("u < chance or chance >= 1.0")  # at most `rows` labels
    least = few.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("u", "h"))).where(F.col("place") <= each)
    got = least.select("h", "lang", _packed(F.col("text")).alias("x")).collect()  # the documented bound of the training sample
    kept = sorted(got, key=lambda r: (r["h"], r["lang"]))
    x = np.zeros((len(kept), DIM), np.float32)
    for i, r in enumerate(kept):
        x[i] = np.frombuffer(r["x"], np.float16)
    return x, [r["lang"] for r in kept]


def train(docs: DataFrame, usable=None, id_col: str = "doc_id", text: str = "text", lang: str = "lang") -> Model | None:  # noqa: ANN001
    """Fit on labelled rows where ``usable`` holds; None where there is no such row."""
    usable = F.lit(True) if usable is None else usable
    return fit(*training_sample(docs, id_col, text, lang, usable))


def predict(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred, score and lang_ambiguous, predicted from the whole text alone.

    Columns of these names are replaced; the others pass unchanged.
    """
    names = {"lang_pred", "score", "lang_ambiguous"}
    keep = [c for c in docs.columns if c not in names]
    made = docs.select(F.struct(*[F.col(c) for c in keep]).alias("row"), language(docs, model, text).alias("made"))
    return made.select("row.*", "made.lang_pred", "made.score", "made.lang_ambiguous")


def language(docs: DataFrame, model: Model | None, text: str = "text") -> Column:
    """struct(lang_pred, score, lang_ambiguous) of a text column of ``docs``.

    Null text, text without a letter, or no model: ``und`` with score 0 and not
    ambiguous.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded: DIM x bits

    @F.pandas_udf(StructType.fromDDL("lang_pred string, score double, lang_ambiguous boolean"))
    def guess(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for part in parts:
            n = len(part)
            pred = np.full(n, UND, object)
            score, vague = np.zeros(n), np.zeros(n, bool)
            if m is not None:
                usable = [i for i, t in enumerate(part) if isinstance(t, str) and has_letter(t)]
                for at in range(0, len(usable), 256):
                    rows = usable[at : at + 256]
                    best, p, margin = m.decode(features([part.iloc[i] for i in rows]))
                    for i, k, s, g in zip(rows, best, p, margin, strict=True):
                        pred[i], score[i], vague[i] = m.langs[k], min(1.0, max(0.0, float(s))), bool(g < AMBIGUOUS)
            yield pd.DataFrame({"lang_pred": pred, "score": score, "lang_ambiguous": vague})
        part = None
        give_back()

    return guess(F.col(text))


def drop_unidentified(docs: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """``docs`` without the documents that the decoder rejects, all columns kept, whatever their names.

    Rejected are null texts, texts without a letter, and texts whose two nearest
    codewords are close while no language has half of the weight. Classifiers
    learn from the labels of ``docs`` itself; where there is none, only the first
    two sorts go. Repeated rows stay or go together. An empty table gives no rows.
    """
    model = train(docs.select(id_col, text, lang), None, id_col, text, lang)
    if model is None:
        return docs.where(lettered(F.col(text)))
    made = docs.select(F.struct(*docs.columns).alias("row"), language(docs, model, text).alias("guess"))
    sure = (F.col("guess.lang_pred") != UND) & ~(F.col("guess.lang_ambiguous") & (F.col("guess.score") < LEAST_SCORE))
    return made.where(sure).select("row.*")


def fold(id_col: str = "doc_id"):  # noqa: ANN201
    """crc32 of the id as text, mod 5."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5


def held_out_predictions(docs: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Learn from rows outside fold 0 and predict every row: id, held_out, lang_pred, score, lang_ambiguous."""
    base = docs.select(F.col(id_col), F.col(text), F.col(lang))
    model = train(base, fold(id_col) != 0, id_col, text, lang)
    out = predict(base.select(id_col, text), model, text)
    return out.select(id_col, F.coalesce(fold(id_col) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score", "lang_ambiguous")
