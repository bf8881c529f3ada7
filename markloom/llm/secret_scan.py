"""Secret scan: patterns, and a linear-chain conditional random field decoded by Viterbi.

The patterns give the base spans. The field adds spans: it tags every token of
a whole text as secret begin, inside or outside. A text's tokens are its words
with the signs that credentials hold; all of them are one chain, ordinary words
too, so a secret may be letters only, several words or far from any key word, and
what comes before decides on what follows. Features are the whole token's shape,
its neighbouring words and signs, the last key word before it in its sentence or
line, and facts of the whole file.

``Decoder`` finds the best path of each whole chain: weights are summed for all
tokens at once, a bound shows where no path but the outside one can be best, and
Viterbi runs over what is left. The path is the one Viterbi gives over all tokens.

The field is trained on the driver on stretches made on the executors from whole
documents: a bounded sample of documents (``SAMPLE_DOCS`` of each sort, at most
``SAMPLE_CHAINS`` stretches about cues and ``SAMPLE_PLAIN`` others of each), tagged
by the patterns, and made-up texts with random credentials and harmless look-alikes.
"""

from __future__ import annotations

import bisect
import itertools
import math
import random
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = ("assign", "access", "hex", "crf")
#: Training documents with and without base spans, stretches about cues of each, and stretches elsewhere.
SAMPLE_DOCS, SAMPLE_CHAINS, SAMPLE_PLAIN = 600, 8, 2
DIM = 1 << 14
#: Added spans are at least so long, as those of the assign pattern.
LEAST_CHARS = 6
#: Tokens of a training stretch before a credential-like token, behind it, behind a key word, and elsewhere.
BEFORE, BEHIND, AFTER_CUE, PLAIN = 3, 2, 8, 16
#: Tokens that are decoded at once (whole texts), words and kinds of gaps whose weights are held.
LOT_TOKENS, HELD_WORDS, HELD_GAPS = 200_000, 400_000, 2_000

_ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ASSIGN_PARTS = ("passw", "secret", "token", "api")  # one of them is in every match
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")  # runs are maximal, so a lower bound equals dropping short matches
_HEX = re.compile(r"[0-9a-f]{24,}")
_TOKEN = re.compile(r"[\w+/.\-]+={0,2}")
_CUE = re.compile(r"(?i)pass[ -]?(?:word|wd|phrase|code)|pwd|secret|token|bearer|credential|auth|(?<![a-z])key|api_?key|(?:recovery|seed) phrase")
_KEY = re.compile(_CUE.pattern + "|phrase")  # in one token
_SPLIT = re.compile(f"({_TOKEN.pattern})")
_CUE_PARTS = ("pass", "pwd", "secret", "token", "bearer", "credential", "auth", "key", "phrase")  # one of them is in every cue
_LIKELY = re.compile(r"[0-9]|[A-Za-z0-9+/_.\-]{20}")


class _Classes(dict):
    """Classes of characters by code point: small letters, capitals, digits; others stand for themselves."""

    def __missing__(self, code: int) -> str:
        sign = chr(code)
        made = self[code] = "9" if sign in "0123456789" else "A" if sign.isupper() else "a" if sign.isalpha() else sign
        return made


_CLASSES = _Classes()
_REPEATS = re.compile(r"([aA9])\1+")
_SWITCH = re.compile(r"[A-Za-z][0-9]|[0-9][A-Za-z]")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the patterns' matches, leftmost and non-overlapping per kind, in order."""
    low, found = text.lower(), []
    if any(map(low.__contains__, _ASSIGN_PARTS)):
        found = [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text)]
    found += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def chains(text: str) -> list[list[tuple[int, int]]]:
    """Stretches of the text's tokens about cues, in order; those that meet are one. Training takes them, the scan every token."""
    low = text.lower()
    cues = [m.end() for m in _CUE.finditer(text)] if any(map(low.__contains__, _CUE_PARTS)) else []
    if not cues and not _LIKELY.search(text):
        return []
    found = [m.span() for m in _TOKEN.finditer(text)]
    starts = [s for s, _ in found]
    parts = []
    for at in cues:
        i = bisect.bisect_right(starts, at - 1)  # the first token behind the one that holds the key word
        parts.append((i, i + AFTER_CUE))
    for i, (s, e) in enumerate(found):
        if e - s >= 6 and (e - s >= 20 or any(map(text[s:e].__contains__, "0123456789"))):
            parts.append((i - BEFORE, i + 1 + BEHIND))
    out: list[list[tuple[int, int]]] = []
    last = 0
    for a, b in sorted(parts):
        a, b = max(a, last), min(b, len(found))
        if a >= b:
            continue
        if out and a == last:
            out[-1].extend(found[a:b])
        else:
            out.append(found[a:b])
        last = b
    return out


def _hash(name: str) -> int:
    return zlib.crc32(name.encode("utf-8", "surrogatepass")) % DIM


def _likely(word: str) -> bool:
    """Whether a token looks like a credential."""
    return len(word) >= 6 and (len(word) >= 20 or any(map(word.__contains__, "0123456789")))


def _key(word: str) -> str:
    """The key word that a token holds, or nothing."""
    low = word.lower()
    if low.isascii() and not any(map(low.__contains__, _CUE_PARTS)):
        return ""
    hit = _KEY.search(low)
    return hit[0] if hit else ""


def _holding(lines: str, parts: tuple[str, ...]) -> list[int]:
    """Numbers of the lines that hold one of the parts, with the letters that patterns take for i and s whatever the case."""
    lines, found = lines.replace("\u0131", "i").replace("\u017f", "s"), set()
    for part in parts:
        at = lines.find(part)
        while at >= 0:
            found.add(at)
            at = lines.find(part, at + 1)
    out, line, done = [], 0, 0
    for at in sorted(found):
        line += lines.count("\n", done, at)
        done = at
        if not out or out[-1] != line:
            out.append(line)
    return out


def _gap(gap: str) -> str:
    return "line" if "\n" in gap else gap.replace(" ", "")[:3] or "space"


_QUOTES = ("'", '"', "`", "\u2019", "\u201d")


def _behind(gap: str) -> str:
    return "line" if "\n" in gap[:2] else "end" if gap[:1] in (",", ";") else "quote" if gap[:1] in _QUOTES else "sign" if not gap or not gap[0].isspace() else "space"


_BEHIND = ("line", "end", "quote", "sign", "space")
_START, _END = "^", "$"
_LEAD, _ONE, _TWO, _NEXT = (zlib.crc32(x) for x in (b"lead", b"one", b"two", b"next"))


def _hashed(*names: str) -> list[int]:
    return [*map(_hash, names)]


def _of_one(word: str) -> list[int]:
    return _hashed(f"one{word.lower()[-20:]}")


def _of_two(word: str) -> list[int]:
    return _hashed(f"two{word.lower()[-20:]}")


def _of_next(word: str) -> list[int]:
    return _hashed(f"next{word.lower()[:12]}")


def _of_cue(key: str) -> list[int]:
    return _hashed(f"cue{bool(key)}")


def _of_gaps(gap: str, behind: str) -> list[int]:
    return _hashed(f"gap{gap}", f"behind{behind}", f"gap{gap}behind{behind}")


def _of_near(key: str, since: int, size: int, switch: int) -> list[int]:
    return _hashed(f"near{key}{since}", f"since{since}len{size}", f"keyed{key}switch{switch}")


def _of_near_gap(key: str, since: int, gap: str) -> list[int]:
    return _hashed(f"near{key}{since}gap{gap}")


def _sizes(shape: str) -> tuple[int, int]:
    return min(len(shape), 64) // 8, min(3, len(_SWITCH.findall(shape)))


def _of_shape(shape: str) -> list[int]:
    n, digits, lower, upper = len(shape), shape.count("9"), "a" in shape, "A" in shape
    short = _REPEATS.sub(r"\1", shape)
    return _hashed(
        f"len{min(n, 64) // 4}", f"digits{10 * digits // n}", f"case{lower}{upper}", f"shape{short if len(short) < 13 else len(short)}",
        f"switch{min(8, len(_SWITCH.findall(shape)))}", f"signs{min(3, sum(map(shape.count, '/.-_+')))}", f"mid{upper and not shape.startswith('A')}{short.count('A') > 1}",
    )


def _bits(word: str) -> int:
    """Twice the bits a character has, by how often each occurs."""
    n = len(word)
    return int(2 * (math.log2(n) - sum(v * math.log2(v) for v in Counter(word).values()) / n) + 1e-6)


def _all_bits(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """``_bits`` and ``_hexlike`` of many words."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    hexlike = np.logical_and.reduceat(_HEX_CODES[np.minimum(codes, 127)], starts)
    pairs = np.sort(np.repeat(np.arange(len(words), dtype=np.int64) << 21, sizes) | codes)
    runs = np.flatnonzero(np.concatenate([[True], pairs[1:] != pairs[:-1]]))
    counts = np.diff(np.concatenate([runs, [len(pairs)]]))
    many = np.bincount(pairs[runs] >> 21, counts * np.log2(counts), len(words))
    return (2 * (np.log2(sizes) - many / sizes) + 1e-6).astype(np.int64), hexlike


_HEX_CODES = np.array([chr(x) in "0123456789abcdefABCDEF" for x in range(128)])


def _hexlike(word: str) -> bool:
    return not word.strip("0123456789abcdefABCDEF")


def _of_bits(bits: int, hexlike: bool) -> list[int]:
    return _hashed(f"bits{bits}", f"hexlike{hexlike}")


def _of_lead(lead: str) -> list[int]:
    return _hashed(f"lead{lead}")


def _of_file(n_base: int, n_cues: int) -> list[int]:
    return _hashed(f"file-base{min(3, n_base)}", f"file-cues{min(4, n_cues.bit_length())}", "bias")


class Features:
    """Features of the tokens of one text; those of the word alone are made once for each word."""

    def __init__(self, text: str, n_base: int, n_cues: int):
        self.text, self.words = text, {}
        self.file = _of_file(n_base, n_cues)

    def of_word(self, word: str) -> list[int]:
        if word in self.words:
            return self.words[word]
        made = self.words[word] = [*_of_shape(word.translate(_CLASSES)), *_of_bits(_bits(word), _hexlike(word)), *_of_lead(word[:3])]
        return made

    def rows(self, found: list[tuple[int, int]], stretches: list[tuple[int, int]]) -> list[list[list[int]]]:
        """Features by stretch (from, to) of the tokens ``found``, which are all of the text's; stretches are in order."""
        text, out, done = self.text, [], 0
        words = [text[s:e] for s, e in found]
        keys: dict[str, str] = {}
        since, key = 9, "-"
        for a, b in stretches:
            out.append([])
            for k in range(done, b):
                word, (s, e) = words[k], found[k]
                gap = _gap(text[found[k - 1][1] : s] if k else text[max(0, s - 3) : s])
                cue = keys[word] if word in keys else keys.setdefault(word, _key(word))
                behind = _behind(text[e : found[k + 1][0]] if k + 1 < len(found) else text[e : e + 2] or "\n")
                if k >= a:
                    near = min(since, 4)
                    out[-1].append([
                        *self.of_word(word), *_of_cue(cue), *self.file, *_of_one(words[k - 1] if k else _START), *_of_two(words[k - 2] if k > 1 else _START),
                        *_of_next(words[k + 1] if k + 1 < len(words) else _END), *_of_gaps(gap, behind), *_of_near(key, near, *_sizes(word.translate(_CLASSES))), *_of_near_gap(key, near, gap),
                    ])
                since += 1
                if cue:
                    since, key = 0, cue
                elif gap == "line" or behind == "quote" or word.endswith("."):
                    since, key = 9, "-"
            done = b
        return out


@dataclass
class Field:
    """State weights (DIM x 3 for O, B, I) and transition scores; the chain starts and ends outside."""

    w: np.ndarray
    t: np.ndarray

    def __getstate__(self) -> dict:
        return {"w": self.w, "t": self.t}  # not the decoder

    def decoder(self) -> Decoder:
        if "_decoder" not in self.__dict__:
            self._decoder = Decoder(self)
        return self._decoder

    def viterbi(self, features: list[list[int]]) -> list[int]:
        return best_path(np.stack([self.w[row].sum(axis=0) for row in features]), self.t) if features else []


def best_path(emit: np.ndarray, t: np.ndarray) -> list[int]:
    """The best states of a chain that starts and ends outside; of equal ones the lower."""
    (oo, ob, oi), (bo, bb, bi), (io, ib, ii) = t.tolist()
    back, o, b, i = [], 0.0, -math.inf, -math.inf
    for eo, eb, ei in emit.tolist():
        # into each state from outside, begin and inside; max takes the first of equal ones
        o1, b1, i1 = (o + oo, b + bo, i + io), (o + ob, b + bb, i + ib), (o + oi, b + bi, i + ii)
        o, b, i = max(o1), max(b1), max(i1)
        back.append((o1.index(o), b1.index(b), i1.index(i)))
        o, b, i = o + eo, b + eb, i + ei
    last = (o + oo, b + bo, i + io)
    state, path = last.index(max(last)), []
    for step in reversed(back):
        path.append(state)
        state = step[state]
    return path[::-1]


class _Words(dict):
    """Numbers of words from 1; those that are new are listed."""

    def __init__(self):
        super().__init__()
        self.n, self.new = 1, []

    def __missing__(self, word: str) -> int:
        self.new.append(word)
        k = self[word] = self.n
        self.n = k + 1
        return k


class _Ids(dict):
    """Numbers by key; ``make`` gives the number of a key that is new."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, key: str) -> int:
        return self.make(key)


def _grown(table: np.ndarray, n: int) -> np.ndarray:
    if n < len(table):
        return table
    return np.concatenate([table, np.zeros((max(n, len(table)), *table.shape[1:]), table.dtype)])


class Decoder:
    """Best paths of whole texts, all tokens of many texts at once.

    Weights are those of begin and inside less those of outside, so that outside
    has none; they are held by word, by gap and by key word and summed by position.
    Two marks without weights stand before each text and one behind the last.
    """

    def __init__(self, field: Field):
        self.field = field
        self.d = field.w[:, 1:] - field.w[:, :1]
        self.keys: dict[str, int] = {}
        self.by_key = np.zeros((0, 5, 36, 2))
        self._key_id("-")
        self._forget_words()
        self._forget_gaps()

    def _weight(self, features: list[int]) -> np.ndarray:
        return self.d[features].sum(axis=0)

    def _key_id(self, key: str) -> int:
        if key not in self.keys:
            made = [[[self._weight(_of_near(key, since, size, switch)) for size in range(9) for switch in range(4)] for since in range(5)]]
            self.by_key = np.concatenate([self.by_key, made])
            self.keys[key] = len(self.keys)
            if hasattr(self, "by_near_gap"):
                self._forget_gaps()
        return self.keys[key]

    def _forget_words(self) -> None:
        self.ids = _Words()
        self.own, self.one, self.two, self.next = (np.zeros((1024, 2)) for _ in range(4))
        self.size, self.key_of, self.cue, self.dot = (np.zeros(1024, np.int64) for _ in range(4))
        self.one[0], self.two[0], self.next[0] = self._weight(_of_one(_START)), self._weight(_of_two(_START)), self._weight(_of_next(_END))
        self.shapes, self.by_shape, self.of_shape = _Ids(self._shape), np.zeros((1024, 2)), np.zeros((1024, 2), np.int64)

    def _shape(self, shape: str) -> int:
        k, (size, switch) = len(self.shapes), _sizes(shape)
        self.by_shape, self.of_shape = _grown(self.by_shape, k), _grown(self.of_shape, k)
        self.by_shape[k], self.of_shape[k] = self._weight(_of_shape(shape)), (size * 4 + switch, _likely(shape.replace("9", "0")))
        self.shapes[shape] = k
        return k

    def _add_words(self) -> None:
        """Weights of the new words, made for all at once."""
        words, self.ids.new = self.ids.new, []
        if not words:
            return
        joined = "\n".join(words).lower()  # no token holds a line break
        lows = joined.split("\n")
        new = slice(self.ids.n - len(words), self.ids.n)
        for name in ("own", "one", "two", "next", "size", "key_of", "cue", "dot"):
            setattr(self, name, _grown(getattr(self, name), self.ids.n))
        shape = np.fromiter(map(self.shapes.__getitem__, [w.translate(_CLASSES) for w in words]), np.int64, len(words))
        key = np.zeros(len(words), np.int64)
        for k in _holding(joined, _CUE_PARTS):
            if found := _key(words[k]):
                key[k] = self._key_id(found)
        bits, hexlike = _all_bits(words)
        of_bits = np.array([[self._weight(_of_bits(k, h)) for h in (False, True)] for k in range(int(bits.max()) + 1)])
        of_cue = np.array([self._weight(_of_cue(k)) for k in ("", "key")])

        def hashed(texts: list[bytes], start: int) -> np.ndarray:
            # a CRC goes on from that of the feature's name
            return np.array([zlib.crc32(x, start) for x in texts], np.int64) % DIM

        def coded(texts: list[str]) -> list[bytes]:
            return "\n".join(texts).encode("utf-8", "surrogatepass").split(b"\n")

        ends = coded([w[-20:] for w in lows])
        self.own[new] = self.by_shape[shape] + of_bits[bits, hexlike * 1] + of_cue[(key > 0) * 1] + self.d[hashed(coded([w[:3] for w in words]), _LEAD)]
        self.one[new], self.two[new] = self.d[hashed(ends, _ONE)], self.d[hashed(ends, _TWO)]
        self.next[new] = self.d[hashed(coded([w[:12] for w in lows]), _NEXT)]
        self.size[new], self.key_of[new], self.cue[new] = self.of_shape[shape, 0], key, (key > 0) | (self.of_shape[shape, 1] > 0)
        self.dot[new] = [w.endswith(".") for w in words]
        for word in words:
            if len(word) > 64:
                del self.ids[word]

    def _forget_gaps(self) -> None:
        self.gap_ids = _Ids(self._gap_id)
        self.names: dict[str, int] = {}
        self.by_gaps = np.zeros((1024, len(_BEHIND), 2))
        self.by_near_gap, self.known = np.zeros((1024, 5 * len(self.keys), 2)), np.zeros((1024, 5 * len(self.keys)), bool)

    def _gap_id(self, gap: str) -> int:
        """The number of the gap's name and that of what it is to the token before it, in one."""
        name = _gap(gap)
        k = self.names.setdefault(name, len(self.names))
        if k >= len(self.by_gaps):
            self.by_gaps, self.by_near_gap, self.known = _grown(self.by_gaps, k), _grown(self.by_near_gap, k), _grown(self.known, k)
        if k == len(self.names) - 1:
            self.by_gaps[k] = [self._weight(_of_gaps(name, behind)) for behind in _BEHIND]
        number = len(_BEHIND) * k + _BEHIND.index(_behind(gap))
        if len(gap) <= 16:
            self.gap_ids[gap] = number
        return number

    def _near_gap(self, near: np.ndarray, name: np.ndarray) -> np.ndarray:
        at = name * self.known.shape[1] + near
        known = self.known.ravel().take(at)
        if not known.all():
            keys, names = list(self.keys), list(self.names)
            for k in set(at[~known].tolist()):
                g, n = divmod(k, self.known.shape[1])
                self.by_near_gap[g, n] = self._weight(_of_near_gap(keys[n // 5], n % 5, names[g]))
                self.known[g, n] = True
        return self.by_near_gap.reshape(-1, 2).take(at, 0)

    def weights(self, lot: list[tuple[list[str], int]]) -> tuple[np.ndarray, np.ndarray]:
        """Weights of begin and inside by token and mark, and where the marks are, of texts parted at their tokens with their base spans."""
        if self.ids.n > HELD_WORDS:
            self._forget_words()
        if len(self.names) > HELD_GAPS:
            self._forget_gaps()
        words, number = [], self.ids.__getitem__
        for parts, _ in lot:
            words.append(np.fromiter(itertools.chain((0, 0), map(number, itertools.islice(parts, 1, None, 2))), np.int64, 2 + len(parts) // 2))
        self._add_words()
        gaps, number = [], self.gap_ids.__getitem__  # words may have brought key words, and these empty the gaps
        for parts, _ in lot:
            gaps += number(""), number("")  # before each mark; the second is followed by the first token's
            gaps.append(number(parts[0][-3:]))
            gaps += map(number, itertools.islice(parts, 2, len(parts) - 1, 2))
            if len(parts) > 1:
                gaps.append(number(parts[-1] or "\n"))
        ids, starts = np.concatenate([*words, np.zeros(1, np.int64)]), np.cumsum([0, *map(len, words)])
        # gaps has, for each text, those before its marks, before each token and behind the last
        before, after, at = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64), 0
        gaps = np.array(gaps, np.int64)
        for a, b in itertools.pairwise(starts.tolist()):
            n = b - a - 2
            before[a + 2 : b], after[a + 2 : b] = gaps[at + 2 : at + 2 + n], gaps[at + 3 : at + 3 + n]
            at += 3 + n
        mark = ids == 0
        place = np.arange(len(ids))
        out = self.own.take(ids, 0)
        out[1:] += self.one.take(ids[:-1], 0)
        out[2:] += self.two.take(ids[:-2], 0)
        out[:-1] += self.next.take(ids[1:], 0)
        cues = np.add.reduceat(self.cue[ids], starts[:-1])
        out[:-1] += np.repeat([self._weight(_of_file(base, n)) for (_, base), n in zip(lot, cues.tolist(), strict=True)], np.diff(starts), axis=0)
        name, behind = before // len(_BEHIND), after % len(_BEHIND)
        out += self.by_gaps.reshape(-1, 2).take(len(_BEHIND) * name + behind, 0)
        key = self.key_of.take(ids)
        last = np.maximum.accumulate(np.where((key > 0) | mark, place, 0))
        last = np.concatenate([[0], last[:-1]])  # the last key word or mark before each token
        stop = (name == self.names.get("line", -1)) | (behind == _BEHIND.index("quote")) | (self.dot.take(ids) > 0)
        stops = np.maximum.accumulate(np.where(stop & ~mark, place, -1))
        stops = np.concatenate([[-1], stops[:-1]])
        key = np.where(stops > last, 0, key[last])
        since = np.where(key == 0, 4, np.minimum(4, place - last - 1))
        near = 5 * key + since
        out += self.by_key.reshape(-1, 2).take(36 * near + self.size.take(ids), 0)
        out += self._near_gap(near, name)
        return out, mark

    def tags(self, lot: list[tuple[list[str], int]]) -> list[dict[int, int]]:
        """The tokens of each text that the best path has not outside, by number, with their states."""
        gain, mark = self.weights(lot)
        t = self.field.t
        r = t - t[0, 0]
        enter = np.maximum(gain[:, 0] + r[0, 1], gain[:, 1] + r[0, 2])
        stay = np.maximum(gain[:, 0] + max(r[1, 1], r[2, 1]), gain[:, 1] + max(r[1, 2], r[2, 2]))
        leave = max(r[1, 0], r[2, 0])
        enter[mark] = stay[mark] = -1000.0
        # a run of tokens from i to j that are not outside gains at most enter[i] + stay[i + 1] + ... + stay[j] + leave;
        # where no run over a token gains, the best path has it outside
        total = np.cumsum(stay)
        first = np.maximum.accumulate(enter - total)
        rest = np.maximum.accumulate(total[::-1])[::-1]
        maybe = (first + rest + leave >= -1e-3) & ~mark
        edges = np.flatnonzero(np.diff(np.concatenate([[False], maybe, [False]]).astype(np.int8)))
        starts = np.cumsum([0, *(2 + len(parts) // 2 for parts, _ in lot)])
        out: list[dict[int, int]] = [{} for _ in lot]
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            k = bisect.bisect_right(starts, a) - 1
            path = best_path(np.concatenate([np.zeros((b - a, 1)), gain[a:b]], axis=1), t)
            out[k].update((a + j - int(starts[k]) - 2, state) for j, state in enumerate(path) if state)
        return out

    def scan(self, texts: Iterable[str]) -> Iterator[tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]]:
        """For each text what ``scan`` gives."""
        lot, size = [], 0
        for text in texts:
            lot.append((text, base_spans(text), _SPLIT.split(text)))
            size += 2 + len(lot[-1][2]) // 2
            if size >= LOT_TOKENS:
                yield from self._lot(lot)
                lot, size = [], 0
        if lot:
            yield from self._lot(lot)

    def _lot(self, lot: list[tuple[str, list[tuple[int, int, str]], list[str]]]) -> Iterator[tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]]:
        states = self.tags([(parts, len(base)) for _, base, parts in lot])
        for (text, base, _), tags in zip(lot, states, strict=True):
            yield base, with_added(base, secrets(text, tags)) if tags else base


def _parts(features: list[list[int]], tags: list[int], width: int = 16) -> list[tuple[list[list[int]], list[int]]]:
    """A training chain parted behind tokens that are outside, where a chain may start anew, once ``width`` tokens are gathered."""
    out, at = [], 0
    for k, tag in enumerate(tags, 1):
        if k == len(tags) or (tag == 0 and k - at >= width):
            out.append((features[at:k], tags[at:k]))
            at = k
    return out


def train_field(sequences: list[tuple[list[list[int]], list[int]]], rounds: int = 60) -> Field:
    """Maximum likelihood by Adam steps, forward-backward over all sequences at once."""
    w, t = np.zeros((DIM, 3)), np.zeros((3, 3))
    never = np.zeros((3, 3))
    never[0, 2] = -50.0  # inside needs a begin
    sequences = sorted((part for f, y in sequences for part in _parts(f, y)), key=lambda part: -len(part[1]))
    if not sequences:
        w[:, 0] = 1.0
        return Field(w, t + never)
    b, long = len(sequences), max(len(y) for _, y in sequences)
    feats = np.array([row for f, _ in sequences for row in f], np.int32)  # of tokens, all of one width
    ys, mask = np.zeros((b, long), np.int64), np.zeros((b, long), bool)
    for i, (_, y) in enumerate(sequences):
        ys[i, : len(y)], mask[i, : len(y)] = y, True
    flat, width = feats.ravel(), feats.shape[1]
    rows, state = np.arange(b), [np.zeros_like(w), np.zeros_like(w), np.zeros_like(t), np.zeros_like(t)]
    ends, live, row = mask.sum(axis=1) - 1, mask.sum(axis=0).tolist(), np.nonzero(mask)[0]  # the longest come first
    gold, true = np.zeros((3, 3)), np.eye(3)[ys[mask]]
    np.add.at(gold, (ys[:, :-1][mask[:, 1:]], ys[:, 1:][mask[:, 1:]]), 1)
    np.add.at(gold[0], ys[:, 0], 1)
    np.add.at(gold[:, 0], ys[rows, ends], 1)

    def lse(a: np.ndarray, axis: int) -> np.ndarray:
        top = a.max(axis=axis, keepdims=True)
        return (top + np.log(np.exp(a - top).sum(axis=axis, keepdims=True))).squeeze(axis)

    for step in range(1, rounds + 1):
        tt = t + never
        emit = np.zeros((b, long, 3))
        emit[mask] = sum(w.take(feats[:, k], 0) for k in range(width))
        fwd, bwd = np.zeros((b, long, 3)), np.zeros((b, long, 3))
        fwd[:, 0] = tt[0] + emit[:, 0]
        for j in range(1, long):
            n = live[j]
            fwd[:n, j] = lse(fwd[:n, j - 1, :, None] + tt, 1) + emit[:n, j]
        z = lse(fwd[rows, ends] + tt[:, 0], 1)
        gt = gold.copy()
        bwd[rows, ends] = tt[:, 0]
        for j in range(long - 2, -1, -1):
            n = live[j + 1]
            after = tt + (emit[:n, j + 1] + bwd[:n, j + 1])[:, None, :]
            bwd[:n, j] = lse(after, 2)
            gt -= np.exp(fwd[:n, j, :, None] + after - z[:n, None, None]).sum(axis=0)
        gt[0] -= np.exp(fwd[:, 0] + bwd[:, 0] - z[:, None]).sum(axis=0)
        gt[:, 0] -= np.exp(fwd[rows, ends] + bwd[rows, ends] - z[:, None]).sum(axis=0)
        delta = true - np.exp(fwd[mask] + bwd[mask] - z[row, None])
        gw = np.stack([np.bincount(flat, np.repeat(delta[:, k], width), DIM) for k in range(3)], axis=1)
        gw, gt = gw / b - 1e-4 * w, gt / b - 1e-4 * t
        for x, g, m, v in ((w, gw, state[0], state[1]), (t, gt, state[2], state[3])):
            m *= 0.9
            m += 0.1 * g
            v *= 0.999
            v += 0.001 * g * g
            x += 0.15 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Field(w, t + never)


def tagged(text: str, secret: list[tuple[int, int]], most: int | None = None) -> list[tuple[list[list[int]], list[int]]]:
    """Chains of features and tags; tokens that meet a secret's span are begin, then inside. The whole text is one chain.

    With ``most``, at most so many of the stretches about cues, spread over the
    text, and ``SAMPLE_PLAIN`` stretches elsewhere; they begin and end outside.
    """
    found = [m.span() for m in _TOKEN.finditer(text)]
    make = Features(text, len(base_spans(text)), sum(bool(_key(text[s:e])) or _likely(text[s:e]) for s, e in found))
    secret = sorted(secret)
    ends = [e for _, e in secret]
    tags, last = [], None
    for start, end in found:
        k = bisect.bisect_right(ends, start)
        hit = k if k < len(secret) and secret[k][0] < end else None
        tags.append(0 if hit is None else 2 if hit == last else 1)
        last = hit
    stretches = [(0, len(found))] if found else []
    if most is not None:
        starts = [s for s, _ in found]
        near = chains(text)
        near = [near[k * len(near) // most] for k in range(most)] if len(near) > most else near
        wanted = [(i := bisect.bisect_left(starts, c[0][0]), i + len(c)) for c in near]
        wanted += [(i := k * len(found) // SAMPLE_PLAIN, min(len(found), i + PLAIN)) for k in range(SAMPLE_PLAIN)]
        stretches, done = [], 0
        for a, b in sorted(wanted):
            a = max(a, done)
            while a > done and tags[a - 1]:
                a -= 1
            while b < len(found) and tags[b]:
                b += 1
            if a < b:
                stretches.append((a, b))
                done = b
    return [(rows, tags[a:b]) for rows, (a, b) in zip(make.rows(found, stretches), stretches, strict=True)]


def _silver(text: str) -> list[tuple[int, int]]:
    spans = [m.span(2) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    return spans + [m.span() for m in _ACCESS.finditer(text)] + [m.span() for m in _HEX.finditer(text)]


def made_up(n: int = 2400, seed: int = 17) -> list[tuple[str, list[tuple[int, int]]]]:
    """Texts with random credentials in forms the patterns miss, and texts with key words or tokens that are harmless."""
    rng = random.Random(seed)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    some = lambda k, chars=letters: "".join(rng.choice(chars) for _ in range(k))
    digits = lambda k: some(k, "0123456789")
    parts = [some(rng.randint(1, 3), "bcdfghklmnprstvw") + some(1, "aeiou") for _ in range(60)]
    word = lambda: "".join(rng.choice(parts) for _ in range(rng.randint(1, 4)))
    lines = lambda most: " ".join(word() for _ in range(rng.randint(0, most)))
    strong = ["pwd", "passphrase", "passcode", "credential", "auth key", "private_key", "access key", "master key", "db pwd", "my password is", "login credential"]
    first = ["bearer ", "Bearer ", "authorization: basic ", "sk_live_", "ghp_", "xoxb-"]
    single = [
        lambda: some(rng.randint(12, 44)), lambda: "-".join(some(8) for _ in range(3)), lambda: some(40) + "==", lambda: word() + digits(3), lambda: some(rng.randint(8, 14), letters[26:52]),
        lambda: word().capitalize() + word().capitalize(), lambda: (word() + word() + word())[: rng.randint(8, 16)],
    ]
    harmless = [
        lambda: f"{digits(4)}-{digits(2)}-{digits(2)}", lambda: f"{digits(3)}-{digits(3)}-{digits(4)}", lambda: digits(rng.randint(6, 16)), lambda: f"v{digits(1)}.{digits(2)}.{digits(1)}-beta",
        lambda: f"www.{word()}{digits(2)}.com/{word()}", lambda: f"{digits(3)}.{digits(3)}.{digits(2)}.{digits(1)}", lambda: f"{word()}{digits(4)}", lambda: f"{word()}.{word()}{digits(2)}",
        lambda: f"978-{digits(10)}", lambda: "-" * 30, lambda: "_" * 24, lambda: "-".join(word() for _ in range(5)), lambda: f"+{digits(2)}-{digits(10)}", lambda: f"{digits(2)}/{digits(2)}/{digits(4)}",
        lambda: f"{word()}/{word()}/{digits(6)}", lambda: word() * 5, lambda: (word() + word() + word() + word() + word() + word()).capitalize(), lambda: f"commit {some(8, '0123456789abcdef')}A{digits(1)}",
        lambda: f"git commit {some(rng.randint(7, 10))}{digits(1)}", lambda: f"build {some(8)}{digits(2)}", lambda: f"order {some(4).upper()}{digits(6)}",
    ]
    plain = [
        "the password is required for", "forgot your password", "token ring network", "keep it secret please", "the key point is that", "a secret about", "reset the password by", "authentication is needed",
        "the author wrote", "key findings show", "tokens are counted", "each token is read", "the bearer of this letter", "pass the salt", "your credentials are checked", "no secret was found in",
    ]
    out = []
    for i in range(n):
        lead, tail = lines(6), lines(6)
        lead, tail = lead + " " if lead else "", (rng.choice([" ", ". ", "\n", ", "]) + tail) if tail else ""
        if i % 3 == 0:
            key = rng.choice(strong) + rng.choice([": ", " = ", "=", ":", " -> ", ' "', ": '"])
            close = {'"': '"', "'": "'"}.get(key[-1], "")
            value = rng.choice(single)()
            at = len(lead) + len(key)
            out.append((f"{lead}{key}{value}{close}{tail}", [(at, at + len(value))] if len(value) >= LEAST_CHARS else []))
        elif i % 3 == 1 and i % 2:
            key = rng.choice(first)
            value = some(rng.randint(16, 40))
            at = len(lead) + (len(key) if key[-1] == " " else 0)
            out.append((f"{lead}{key}{value}{tail}", [(at, len(lead) + len(key) + len(value))]))
        elif i % 3 == 1:
            key = rng.choice(["pass phrase", "passphrase", "recovery phrase", "seed phrase"]) + rng.choice([": ", " = ", " -> ", ": '"])
            value = " ".join(word() for _ in range(rng.randint(3, 6)))
            at = len(lead) + len(key)
            tail = {"'": "'"}.get(key[-1], "") + rng.choice(["", "\n" + lines(6), ". " + lines(6)])
            out.append((f"{lead}{key}{value}{tail}", [(at, at + len(value))]))
        elif rng.random() < 0.6:
            out.append((f"{lead}{rng.choice(harmless)()}{tail}", []))
        else:
            out.append((f"{lead}{rng.choice(plain)} {lines(8)}{tail}", []))
    return out


def made_up_far(n: int = 900, seed: int = 18) -> list[tuple[str, list[tuple[int, int]]]]:
    """Texts with secrets that no key word is near: long phrases, and letters alone; and harmless texts like them."""
    rng = random.Random(seed)
    small, large = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    some = lambda k, chars: "".join(rng.choice(chars) for _ in range(k))
    parts = [some(rng.randint(1, 3), "bcdfghklmnprstvw") + some(1, "aeiou") for _ in range(90)]
    word = lambda: "".join(rng.choice(parts) for _ in range(rng.randint(1, 4)))
    lines = lambda least, most: " ".join(word() for _ in range(rng.randint(least, most)))
    harmless = [
        lambda: "".join(word().capitalize() for _ in range(rng.randint(2, 5))), lambda: word() + "".join(word().capitalize() for _ in range(rng.randint(1, 4))),
        lambda: word() + word() + word() + word(), lambda: (word() + word() + word()).upper(), lambda: "_".join(word() for _ in range(4)), lambda: "-".join(word().capitalize() for _ in range(3)),
    ]
    out = []
    for i in range(n):
        lead, tail = lines(4, 20), lines(0, 30)
        if i % 3 == 0:
            key = rng.choice(["pass phrase", "passphrase", "recovery phrase", "seed phrase"]) + rng.choice([": ", " = ", ": '"])
            value = lines(7, 24)
            close = "'" if key[-1] == "'" else ""
            out.append((f"{lead} {key}{value}{close}" + (f"\n{tail}" if tail else ""), [(len(lead) + 1 + len(key), len(lead) + 1 + len(key) + len(value))]))
        elif i % 3 == 1:
            value = some(rng.randint(12, 19), small + large)
            out.append((f"{lead} {value}{rng.choice([' ', '. ', ', ', chr(10)])}{tail}", [(len(lead) + 1, len(lead) + 1 + len(value))]))
        else:
            middle = rng.choice(harmless)() if rng.random() < 0.7 else rng.choice(["the phrase is", "a phrase like", "this phrase"])
            out.append((f"{lead} {middle} {tail}", []))
    return out


_ASSIGNED = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{6,}"""


def _hit(text: Column) -> Column:
    """Whether a text has a base span; words that must be there are looked for before the pattern that needs them."""
    low = F.lower(text)
    named = low.contains("passw") | low.contains("secret") | low.contains("token") | low.contains("key")
    return text.rlike("[0-9a-f]{24}") | (text.contains("AKIA") & text.rlike("AKIA[A-Z0-9]{16}")) | (named & text.rlike(_ASSIGNED))


def sample(docs: DataFrame, id_col: str = "doc_id", text: str = "text", rows: int = SAMPLE_DOCS, most: int = SAMPLE_CHAINS) -> list[tuple[list[list[int]], list[int]]]:
    """Chains of about ``rows`` documents that hold base matches and ``rows`` that do not, chosen by a hash of id and text.

    A pass counts both sorts; a second takes those under a hash threshold and
    makes features and tags on the executors, from whole texts, so what reaches
    the driver is bounded: at most ``most`` chains of each.
    """
    marked = docs.where(F.col(text).isNotNull()).select(
        F.xxhash64(F.lit(9), F.col(id_col), F.col(text)).alias("h"), _hit(F.col(text)).alias("hit"), F.col(text).alias("text")
    )
    counts = {r["hit"]: r["n"] for r in marked.groupBy("hit").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = {hit: min(1.0, rows / counts.get(hit, 1)) for hit in (True, False)}
    u = F.shiftrightunsigned("h", 11).cast("double") / F.lit(float(1 << 53))

    @F.pandas_udf("array<struct<f:array<array<int>>,y:array<int>>>")
    def make(part: pd.Series) -> pd.Series:
        return pd.Series([[{"f": f, "y": y} for f, y in tagged(t, _silver(t), most)] for t in part])

    few = marked.where(u < F.when(F.col("hit"), share[True]).otherwise(share[False]))
    got = few.select("h", make(F.col("text")).alias("chains")).limit(4 * rows).collect()  # the documented bound
    return [(x["f"], x["y"]) for r in sorted(got, key=lambda r: r["h"]) for x in r["chains"]]


def train(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> Field:
    data = sample(docs, id_col, text)
    data += [x for line, secret in made_up() + made_up_far() for x in tagged(line, secret)]
    return train_field(data)


def secrets(text: str, tags: dict[int, int]) -> list[tuple[int, int]]:
    """Spans of the text's tokens that begin a secret (1) and are inside it (2), by their numbers."""
    out: list[list[int]] = []
    most, last = max(tags), -2
    for k, m in enumerate(itertools.islice(_TOKEN.finditer(text), most + 1)):
        tag = tags.get(k, 0)
        if tag == 1:
            out.append([*m.span()])
            last = k
        elif tag == 2 and last == k - 1:
            out[-1][1] = m.end()
            last = k
    return [(s, e) for s, e in out]


def with_added(base: list[tuple[int, int, str]], added: list[tuple[int, int]]) -> list[tuple[int, int, str]]:
    """Base spans and those of the added ones that are long enough and meet no base one, in order."""
    taken = merged([(s, e) for s, e, _ in base])
    ends = [e for _, e in taken]
    free = []
    for s, e in added:
        k = bisect.bisect_right(ends, s)
        if e - s >= LEAST_CHARS and (k == len(taken) or taken[k][0] >= e):
            free.append((s, e, "crf"))
    return sorted(base + free, key=lambda s: (s[0], KINDS.index(s[2])))


def scan(text: str, field: Field) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """Base spans, and base and added spans together in order. Added spans never overlap base ones."""
    return next(field.decoder().scan([text]))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Unions of overlapping spans, in order."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s < out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def find_secrets(docs: DataFrame, field: Field, text: str = "text") -> DataFrame:
    """``docs`` with n_assign, n_access, n_hex, base_spans and spans, from the whole text.

    A span is ``kind:start:end`` in code points, end exclusive. Null text counts
    as empty and has no spans (empty strings, zero counts). Columns of these
    names are replaced; others pass unchanged, repeated rows alike.
    """
    shared = docs.sparkSession.sparkContext.broadcast(field)  # DIM x 3 weights
    names = ["n_assign", "n_access", "n_hex", "base_spans", "spans"]

    @F.pandas_udf(T.StructType.fromDDL("n_assign long, n_access long, n_hex long, base_spans string, spans string"))
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = shared.value
        for part in parts:
            rows = []
            for base, spans in model.decoder().scan(body if isinstance(body, str) else "" for body in part):
                kinds = [k for _, _, k in base]
                rows.append((kinds.count("assign"), kinds.count("access"), kinds.count("hex"), joined(base), joined(spans)))
            yield pd.DataFrame(rows, columns=names)

    keep = [c for c in docs.columns if c not in names]
    made = docs.select(F.struct(*[F.col(c) for c in keep]).alias("row"), run(F.col(text)).alias("made"))
    return made.select("row.*", *[f"made.{n}" for n in names])
