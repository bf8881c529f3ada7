"""HTML tokenizer that scans runs with regular expressions.

Tokens are tuples whose first item is the kind: ``CHARS`` (text), ``OPEN``
(name, attributes, self-closing), ``SHUT`` (name, attributes, self-closing),
``COMMENT`` (text), ``DOCTYPE`` (name, public id, system id, quirks) and ``END``.
Attributes are a list of [name, value]; of repeated names the first counts.
"""

from __future__ import annotations

import re

from .entities import ascii_lower, decode_attribute, decode_text

CHARS, OPEN, SHUT, COMMENT, DOCTYPE, END = range(6)
#: Content models.
DATA, RCDATA, RAWTEXT, SCRIPT, PLAIN = range(5)

_WS = "\t\n\f "
_NAME = re.compile(r"[^\t\n\f />]+")
_GAP = re.compile(r"[\t\n\f /]*")
_ATTR = re.compile(
    r"""([^\t\n\f />][^\t\n\f /=>]*)"""
    r"""(?:[\t\n\f ]*=[\t\n\f ]*(?:"([^"]*)("?)|'([^']*)('?)|(?=>)|([^\t\n\f >"'][^\t\n\f >]*)|(\Z)))?"""
)
# tags as most are written: lower case, values in double quotes without references
_PLAIN = re.compile(r'''<(/?)([a-z][a-z0-9]*)((?: [a-z][a-z0-9-]*="[^"&\0]*")*)>''')
_PAIR = re.compile(r''' ([a-z][a-z0-9-]*)="([^"]*)"''')
_COMMENT_END = re.compile(r"--!?>")
_SCRIPT = re.compile(r"<!--|-->|<(/?)script(?=[\t\n\f />])", re.I | re.A)
_NEWLINE = re.compile(r"\r\n?")
_raw_end: dict[str, re.Pattern] = {}


class Tokenizer:
    __slots__ = ("text", "at", "size", "model", "last_open", "foreign", "waiting", "done")

    def __init__(self, text: str, model: int = DATA, last_open: str = ""):
        self.text = _NEWLINE.sub("\n", text) if "\r" in text else text
        self.at, self.size = 0, len(self.text)
        self.model, self.last_open = model, last_open
        self.foreign = False
        self.waiting: tuple | None = None
        self.done = False

    def next(self) -> tuple | None:
        """The next token; text between two other tokens comes as one. None after the end."""
        if self.waiting is not None:
            token, self.waiting = self.waiting, None
            return token
        if self.done:
            return None
        if self.model == DATA:  # the usual case: a run of text, then a plainly written tag
            text, at = self.text, self.at
            less = text.find("<", at)
            if less >= 0 and (m := _PLAIN.match(text, less)) is not None:
                token = self._plain(m)
                if less == at:
                    return token
                self.waiting = token
                return (CHARS, decode_text(text[at:less]))
        parts: list[str] = []
        token = None
        while token is None:
            if self.at >= self.size:
                self.done = True
                token = (END,)
            elif self.model == DATA:
                token = self._data(parts)
            elif self.model == PLAIN:
                parts.append(self.text[self.at :].replace("\0", "�"))
                self.at = self.size
            else:
                token = self._raw(parts)
        data = "".join(parts)
        if data:
            self.waiting = token
            return (CHARS, data)
        return token

    def all(self) -> list[tuple]:
        out = []
        while (token := self.next()) is not None:
            out.append(token)
        return out

    def _data(self, parts: list[str]) -> tuple | None:
        text, at = self.text, self.at
        less = text.find("<", at)
        if less < 0:
            parts.append(decode_text(text[at:]))
            self.at = self.size
            return None
        if less > at:
            parts.append(decode_text(text[at:less]))
        m = _PLAIN.match(text, less)
        if m is not None:
            return self._plain(m)
        c = text[less + 1 : less + 2]
        if c.isascii() and c.isalpha():
            return self._tag(less + 1, OPEN)
        if c == "/":
            d = text[less + 2 : less + 3]
            if d.isascii() and d.isalpha():
                return self._tag(less + 2, SHUT)
            if not d:
                parts.append("</")
                self.at = self.size
                return None
            if d == ">":
                self.at = less + 3
                return None
            return self._bogus(less + 2)
        if c == "!":
            return self._declaration(less + 2, parts)
        if c == "?":
            return self._bogus(less + 1)
        parts.append("<")
        self.at = less + 1
        return None

    def _plain(self, m: re.Match) -> tuple:
        shut, name, rest = m.groups()
        self.at = m.end()
        attrs = []
        if rest:
            seen = set()
            for pair in _PAIR.findall(rest):
                if pair[0] not in seen:
                    seen.add(pair[0])
                    attrs.append(list(pair))
        if shut:
            return (SHUT, name, attrs, False)
        self.last_open = name
        return (OPEN, name, attrs, False)

    def _tag(self, at: int, kind: int) -> tuple | None:
        """A tag whose name begins at ``at``; input that ends inside a tag gives none."""
        text, size = self.text, self.size
        m = _NAME.match(text, at)
        at = m.end()
        name = ascii_lower(m[0])
        attrs: list[list[str]] = []
        names: set[str] = set()
        slash = False
        while True:
            gap = _GAP.match(text, at).end()
            if gap >= size:
                self.at = size
                return None
            if text[gap] == ">":
                slash = gap > at and text[gap - 1] == "/"
                break
            m = _ATTR.match(text, gap)
            at = m.end()
            key, value = m[1], ""
            if m[2] is not None:
                if not m[3]:
                    self.at = size
                    return None
                value = m[2]
            elif m[4] is not None:
                if not m[5]:
                    self.at = size
                    return None
                value = m[4]
            elif m[6] is not None:
                value = m[6]
            key = ascii_lower(key)
            if "\0" in key:
                key = key.replace("\0", "�")
            if key not in names:
                names.add(key)
                if "\0" in value:
                    value = value.replace("\0", "�")
                attrs.append([key, decode_attribute(value)])
        self.at = gap + 1
        if "\0" in name:
            name = name.replace("\0", "�")
        if kind == OPEN:
            self.last_open = name
        self.model = DATA
        return (kind, name, attrs, slash)

    def _bogus(self, at: int) -> tuple:
        end = self.text.find(">", at)
        if end < 0:
            end = self.size
        self.at = end + 1
        return (COMMENT, self.text[at:end].replace("\0", "�"))

    def _declaration(self, at: int, parts: list[str]) -> tuple | None:
        text = self.text
        if text.startswith("--", at):
            return self._comment(at + 2)
        if text[at : at + 7].lower() == "doctype":
            return self._doctype(at + 7)
        if self.foreign and text.startswith("[CDATA[", at):
            end = text.find("]]>", at + 7)
            parts.append(text[at + 7 : end] if end >= 0 else text[at + 7 :])
            self.at = end + 3 if end >= 0 else self.size
            return None
        return self._bogus(at)

    def _comment(self, at: int) -> tuple:
        text = self.text
        for short in (">", "->"):
            if text.startswith(short, at):
                self.at = at + len(short)
                return (COMMENT, "")
        m = _COMMENT_END.search(text, at)
        if m:
            data, self.at = text[at : m.start()], m.end()
        else:
            data, self.at = text[at:], self.size
            for tail in ("--!", "--", "-"):
                if data.endswith(tail):
                    data = data[: -len(tail)]
                    break
        return (COMMENT, data.replace("\0", "�"))

    def _doctype(self, at: int) -> tuple:
        text, size = self.text, self.size

        def skip(i: int) -> int:
            while i < size and text[i] in _WS:
                i += 1
            return i

        def clean(s: str) -> str:
            return s.replace("\0", "�")

        def quoted(i: int) -> tuple[str, int, bool]:
            """Identifier in quotes at i: (value, where it ends, whether it was closed)."""
            stop = i + 1
            while stop < size and text[stop] not in (text[i], ">"):
                stop += 1
            closed = stop < size and text[stop] == text[i]
            return clean(text[i + 1 : stop]), stop + closed, closed

        def finish(i: int, name: str | None, public: str | None, system: str | None, quirks: bool) -> tuple:
            end = text.find(">", i)
            self.at = size if end < 0 else end + 1
            return (DOCTYPE, name, public, system, quirks)

        at = skip(at)
        if at >= size or text[at] == ">":
            return finish(at, None, None, None, True)
        stop = at
        while stop < size and text[stop] not in "\t\n\f >":
            stop += 1
        name = clean(ascii_lower(text[at:stop]))
        at = skip(stop)
        if at >= size:
            return finish(at, name, None, None, True)
        if text[at] == ">":
            return finish(at, name, None, None, False)
        public = system = None
        word = text[at : at + 6].lower()
        if word not in ("public", "system"):
            return finish(at, name, None, None, True)
        at = skip(at + 6)
        if at >= size or text[at] not in "\"'":
            return finish(at, name, None, None, True)
        value, at, closed = quoted(at)
        if word == "system":
            system = value
        else:
            public = value
            if closed:
                at = skip(at)
                if at < size and text[at] in "\"'":
                    system, at, closed = quoted(at)
                elif at < size and text[at] == ">":
                    return finish(at, name, public, None, False)
                else:
                    return finish(at, name, public, None, True)
        if not closed:
            return finish(at, name, public, system, True)
        at = skip(at)
        return finish(at, name, public, system, at >= size)

    def _raw(self, parts: list[str]) -> tuple | None:
        """Text up to the end tag of the element that opened last."""
        text, at = self.text, self.at
        stop = self._script_end(at) if self.model == SCRIPT else self._element_end(at)
        data = text[at : self.size if stop < 0 else stop].replace("\0", "�")
        parts.append(decode_text(data) if self.model == RCDATA else data)
        if stop < 0:
            self.at = self.size
            return None
        return self._tag(stop + 2, SHUT)

    def _element_end(self, at: int) -> int:
        name = self.last_open
        if not name:
            return -1
        if name not in _raw_end:
            _raw_end[name] = re.compile("</" + re.escape(name) + r"(?=[\t\n\f />])", re.I | re.A)
        m = _raw_end[name].search(self.text, at)
        return m.start() if m else -1

    def _script_end(self, at: int) -> int:
        """A comment in a script hides end tags once another script has opened in it."""
        if self.last_open != "script":
            return self._element_end(at)
        depth = 0
        while m := _SCRIPT.search(self.text, at):
            at = m.end()
            if m[0] == "<!--":
                if not depth:
                    depth = 1
                    at = m.start() + 2  # its dashes may also close it
            elif m[0] == "-->":
                depth = 0
            elif m[1]:
                if depth < 2:
                    return m.start()
                depth = 1
            elif depth == 1:
                depth = 2
        return -1
