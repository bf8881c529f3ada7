"""A forgiving event parser: tags as written, few rules about nesting, no tree.

``Lenient(handler, ...)`` calls ``handler.opened(name, attrs)``,
``handler.text(data, clean)``, ``handler.closed(name, implied)`` and, if there,
``handler.remark(data)``. ``clean`` says that the text holds none of ``& < >``.
"""

from __future__ import annotations

import bisect
import re
from html.entities import html5 as NAMED

from .entities import LONGEST, code_point
from .facts import SPACE, SPACE_CLASS
from .fixed import INHERITED, LENIENT_CLOSES
from .fixed import LENIENT_RAW as RAW
from .fixed import LENIENT_VOID as VOID

_NAMES = sorted(NAMED)
_LONG = LONGEST - 1
_ALNUM = re.compile(r"[0-9A-Za-z]*")
_NUMBER = re.compile(r"#(?:[xX]([0-9a-fA-F]+)|([0-9]+));?")

CLOSES = {k: frozenset(v.split()) for k, v in LENIENT_CLOSES.items()}

_SPACES = re.compile(f"{SPACE_CLASS}*")
_TAG_NAME = re.compile(f"[^{SPACE}/>]*")
_ATTR_NAME = re.compile(f"[^{SPACE}/>=]*")
_BARE = re.compile(f"[^{SPACE}>]*")
_MARKED = re.compile("[&<>]")
# tags as most are written
_PLAIN = re.compile('''([a-z][a-z0-9]*)((?: [a-z][a-z0-9-]*="[^"]*")*)>''')
_PAIR = re.compile(''' ([a-z][a-z0-9-]*)="([^"]*)"''')


def _starts_name(s: str) -> bool:
    at = bisect.bisect_left(_NAMES, s)
    return at < len(_NAMES) and _NAMES[at].startswith(s)


def _reference(s: str, at: int, attribute: bool) -> tuple[str, int] | None:
    """(value, end) of the reference whose & is just before ``at``."""
    if s.startswith("#", at):
        m = _NUMBER.match(s, at)
        if not m:
            return None
        digits = (m[1] or m[2]).lstrip("0")[:12]
        return code_point(int(digits or "0", 16 if m[1] else 10)), m.end()
    run = _ALNUM.match(s, at, at + _LONG)[0]
    end = at + len(run)
    if s.startswith(";", end) and run + ";" in NAMED:
        return NAMED[run + ";"], end + 1
    if not attribute:
        for n in range(len(run), 1, -1):
            if run[:n] in NAMED:
                return NAMED[run[:n]], at + n
        return None
    # in attributes: follow the names as far as any goes on, and accept only a
    # stop at a name that is complete, before neither "=" nor a letter or digit
    n, best = 0, None
    while n < _LONG and at + n < len(s) and s[at + n] != ";" and _starts_name(s[at : at + n + 1]):
        n += 1
        if s[at : at + n] in NAMED:
            best = n
    if best is None:
        return None
    name, after = s[at : at + n], s[at + n : at + n + 1]
    if after and ((name not in NAMED and name + ";" not in NAMED) or after == "=" or (after.isascii() and after.isalnum())):
        return None
    return NAMED[s[at : at + best]], at + best


def decode(s: str, attribute: bool = False) -> str:
    at = s.find("&")
    if at < 0:
        return s
    out, last = [], 0
    while at >= 0:
        hit = _reference(s, at + 1, attribute)
        if hit:
            out += (s[last:at], hit[0])
            last = hit[1]
            at = s.find("&", last)
        else:
            at = s.find("&", at + 1)
    out.append(s[last:])
    return "".join(out)


def _comment_end(s: str, at: int) -> int:
    """Index of the > that ends a comment whose text begins at ``at``, or -1. The opening dashes may be used again."""
    if s.startswith(">", at):
        return at
    dashes = 2
    for m in re.compile("-+|>|[^->]+").finditer(s, at):
        if m[0][0] == "-":
            dashes = len(m[0]) + (dashes if m.start() == at else 0)
        elif m[0] == ">":
            if dashes >= 2:
                return m.start()
            dashes = 0
        else:
            dashes = 0
    return -1


def keyed(attrs: list[tuple[str, str]]) -> dict[str, str]:
    """Attributes as a script object keeps them: the first of a name counts, small integers come first."""
    out: dict[str, str] = {}
    for k, v in attrs:
        if k not in out and k not in INHERITED:
            out[k] = v
    numbers = sorted((k for k in out if k.isascii() and k.isdigit() and (k == "0" or k[0] != "0") and int(k) < 2**32 - 1), key=int)
    return {k: out[k] for k in numbers} | out if numbers else out


class Lenient:
    def __init__(self, handler, decode_entities: bool = True, lower_tags: bool = True, lower_attributes: bool | None = None):  # noqa: ANN001
        self.handler, self.decodes, self.lower_tags = handler, decode_entities, lower_tags
        self.lower_attributes = lower_tags if lower_attributes is None else lower_attributes
        self.stack: list[str] = []
        self.end = -1

    def run(self, source: str) -> None:
        self._scan(source)
        while self.stack:
            self.handler.closed(self.stack.pop(), True)

    def _say(self, data: str, decodes: bool = True) -> None:
        if not data:
            return
        if not _MARKED.search(data):
            self.handler.text(data, True)
        else:
            self.handler.text(decode(data) if self.decodes and decodes else data, False)

    def _open(self, name: str, attrs: list[tuple[str, str]], slash: bool) -> None:
        if self.lower_tags:
            name = name.lower()
        closes = CLOSES.get(name)
        if closes:
            while self.stack and self.stack[-1] in closes:
                self.handler.closed(self.stack.pop(), True)
        pairs = []
        for k, v in attrs:
            if self.lower_attributes:
                k = k.lower()
            pairs.append((k, decode(v, True) if self.decodes else v))
        self.handler.opened(name, keyed(pairs))
        if name in VOID:
            self.handler.closed(name, True)
        elif slash and (name in ("svg", "math") or "svg" in self.stack or "math" in self.stack):
            self.handler.closed(name, False)
        else:
            self.stack.append(name)

    def _close(self, name: str, implied: bool = False) -> None:
        if self.lower_tags:
            name = name.lower()
        if name in self.stack:
            while (top := self.stack.pop()) != name:
                self.handler.closed(top, True)
            self.handler.closed(name, implied)
        elif name == "p":
            self._open("p", [], False)
            self._close("p", True)
        elif name == "br":
            self._open("br", [], False)

    def _scan(self, s: str) -> None:
        size = len(s)
        i = begin = 0
        folded = None

        def flush(to: int) -> None:
            nonlocal begin
            if to > begin:
                self._say(s[begin:to])
                self.end = to
            begin = to

        def past(to: int, counts: bool = True) -> int:
            nonlocal begin
            begin = to
            if counts:
                self.end = to
            return to

        while i < size:
            i = s.find("<", i)
            if i < 0:
                break
            c = s[i + 1 : i + 2]
            if c == "!" and s.startswith("--", i + 2):
                flush(i)
                end = _comment_end(s, i + 4)
                if end < 0:
                    return
                remark = getattr(self.handler, "remark", None)
                if remark:
                    a, b = i + 4, end - 2
                    remark(s[min(a, b) : max(a, b)] if b >= 0 else "")
                i = past(end + 1)
            elif c == "!" and s.startswith("[CDATA[", i + 2):
                flush(i)
                end = s.find("]]>", i + 9)
                if end < 0:
                    return
                i = past(end + 3)
            elif c in ("!", "?") and c:
                flush(i)
                d = s[i + 2 : i + 3]
                if c == "!" and (d == ">" or (d == "-" and s[i + 3 : i + 4] in ("", ">"))):
                    i = past(i + 2)
                else:
                    end = s.find(">", i + 2)
                    i = past(i + 2, counts=False) if end < 0 else past(end + 1)
            elif c == "/":
                flush(i)
                j = _SPACES.match(s, i + 2).end()
                d = s[j : j + 1]
                if not d:
                    self._say(s[i:], False)
                    past(size)
                    return
                if d == ">":
                    self._say(s[i : j + 1], False)
                    i = past(j + 1)
                    continue
                end = s.find(">", j)
                if end < 0:
                    return
                if d.isascii() and d.isalpha():
                    self._close(_TAG_NAME.match(s, j)[0])
                i = past(end + 1)
            elif c.isascii() and c.isalpha():
                flush(i)
                name, attrs, slash, j = self._tag(s, i + 1)
                if j < 0:
                    slashes = s.count("/", i)
                    if slashes:
                        for _ in range(slashes):
                            self._say("/", False)
                        past(size)
                    return
                self._open(name, attrs, slash)
                i = past(j)
                lowered = name.lower()
                shown = lowered if self.lower_tags else name
                if slash or shown in VOID or lowered not in RAW:
                    continue
                if folded is None:
                    folded = s.lower() if len(s.lower()) == size else s.translate({k: k + 32 for k in range(65, 91)})
                m = re.compile(f"</{lowered}(?=[{SPACE}/>]|\\Z)").search(folded, i)
                if m is None:
                    self._say(s[i:], lowered == "title")
                    self.end = size
                    if self.stack and self.stack[-1] == shown:
                        self.stack.pop()
                        self.handler.closed(shown, True)
                    i = begin = size
                    continue
                self._say(s[i : m.start()], lowered == "title")
                end = s.find(">", m.end())
                if end < 0:
                    begin = m.start()
                    return
                self._close(lowered)
                i = past(end + 1)
            else:
                flush(i)
                self._say("<", False)
                i = past(i + 1)
        if begin < size:
            self._say(s[begin:])
            self.end = size
        elif self.end < 0:
            self.end = begin

    @staticmethod
    def _tag(s: str, at: int) -> tuple[str, list[tuple[str, str]], bool, int]:
        """(name, attributes, self-closing, where the tag ends or -1)."""
        size = len(s)
        m = _PLAIN.match(s, at)
        if m is not None:
            return m[1], _PAIR.findall(m[2]) if m[2] else [], False, m.end()
        m = _TAG_NAME.match(s, at)
        name, j = m[0], m.end()
        attrs: list[tuple[str, str]] = []
        while True:
            j = _SPACES.match(s, j).end()
            if j >= size:
                return name, attrs, False, -1
            if s[j] == ">":
                return name, attrs, False, j + 1
            if s[j] == "/":
                j = _SPACES.match(s, j + 1).end()
                if s.startswith(">", j):
                    return name, attrs, True, j + 1
                continue
            m = _ATTR_NAME.match(s, j)
            key, j = m[0], m.end()
            if not key:
                key = "="
                j += 1
            j = _SPACES.match(s, j).end()
            value = ""
            if s.startswith("=", j):
                j = _SPACES.match(s, j + 1).end()
                quote = s[j : j + 1]
                if quote in ("'", '"') and quote:
                    end = s.find(quote, j + 1)
                    value = s[j + 1 : size if end < 0 else end]
                    j = size if end < 0 else end + 1
                else:
                    m = _BARE.match(s, j)
                    value, j = m[0], m.end()
            attrs.append((key, value))
