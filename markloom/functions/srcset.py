"""Image candidate lists and inline style lists of the lenient dialect."""

from __future__ import annotations

import re
import warnings
from dataclasses import dataclass

from .facts import SPACE, SPACE_CLASS

_WHITE = " \t\n\f\r"
_INT = re.compile(r"[0-9]+\Z")
_FLOAT = re.compile(r"-?(?:[0-9]+|[0-9]*\.[0-9]+)(?:[eE][+-]?[0-9]+)?\Z")
_URL = re.compile(r"[^ \t\n\r\f]+")


@dataclass
class Candidate:
    url: str
    w: int | None = None
    h: int | None = None
    d: float | None = None


#: By unit: how the number is written, what else may not stand beside it, and whether zero counts.
_UNITS = {"w": (_INT, "wd", False), "x": (_FLOAT, "whd", True), "h": (_INT, "hd", False)}
_FIELD = {"w": "w", "x": "d", "h": "h"}


def _described(url: str, descriptors: list[str]) -> Candidate | None:
    """The candidate, or None if a descriptor is wrong or clashes with another; a warning tells of that once a process."""
    found = Candidate(url)
    for text in descriptors:
        pattern, clashes, zero = _UNITS.get(text[-1:], (None, "", False))
        number = float(text[:-1]) if pattern is not None and pattern.match(text[:-1]) else -1.0
        if number < 0 or (not number and not zero) or any(getattr(found, other) is not None for other in clashes):
            warnings.warn("an image candidate has a wrong descriptor and is left out", stacklevel=2)
            return None
        setattr(found, _FIELD[text[-1]], int(text[:-1]) if pattern is _INT else number)
    return found


def _descriptors(s: str, at: int) -> tuple[list[str], int]:
    """Descriptors up to a comma outside parentheses, and where to go on."""
    out, held, inside = [], "", False
    while at < len(s):
        c = s[at]
        at += 1
        if inside:
            held += c
            inside = c != ")"
        elif c in _WHITE:
            if held:
                out.append(held)
            held = ""
        elif c == ",":
            break
        else:
            held += c
            inside = c == "("
    if held:
        out.append(held)
    return out, at


def candidates(s: str) -> list[Candidate]:
    out, at = [], 0
    while True:
        while at < len(s) and s[at] in _WHITE + ",":
            at += 1
        m = _URL.match(s, at)
        if m is None:
            return out
        url, at = m[0], m.end()
        if url.endswith(","):
            found = _described(url.rstrip(","), [])
        else:
            parts, at = _descriptors(s, at)
            found = _described(url, parts)
        if found is not None:
            out.append(found)


def _plain(d: float) -> str:
    """A number the way scripts print it."""
    if d == int(d) and abs(d) < 1e21:
        return str(int(d))
    s = repr(d)
    if "e" in s:
        mantissa, _, power = s.partition("e")
        n = int(power)
        if -7 < n < 0:
            return f"{d:.{len(mantissa.replace('.', '').lstrip('-')) - 1 - n}f}"
        return f"{mantissa}e{'+' if n > 0 else '-'}{abs(n)}"
    return s


def written(parts: list[Candidate]) -> str:
    out = []
    for p in parts:
        if not p.url:
            raise ValueError("a candidate has no URL")
        out.append(p.url + (f" {p.w}w" if p.w else "") + (f" {p.h}h" if p.h else "") + (f" {_plain(p.d)}x" if p.d else ""))
    return ", ".join(out)


@dataclass
class Declaration:
    """One declaration; a comment has neither property nor value."""

    prop: str | None = None
    value: str | None = None
    important: bool = False

    def __str__(self) -> str:
        show = lambda x: "undefined" if x is None else x
        return f"{show(self.prop)}:{show(self.value)}{' !important' if self.important else ''}"


_PIECE = re.compile(r"""(?s)/\*.*?(?:\*/|(\Z))|\\(?:.|(\Z))|"(?:[^"\\]|\\.|\\\Z)*(?:"|(\Z))|'(?:[^'\\]|\\.|\\\Z)*(?:'|(\Z))|.""")
_IMPORTANT = re.compile(f"!{SPACE_CLASS}*important{SPACE_CLASS}*\\Z", re.I)


def style_declarations(css: str) -> list[Declaration]:
    """Declarations of an inline style; ValueError where a style sheet parser would give up."""
    out: list[Declaration] = []
    pieces: list[tuple[str, int, int]] = []  # of one declaration: text and place, comments too

    def finish() -> None:
        real = [p for p in pieces if not p[0].startswith("/*") and p[0].strip(SPACE)]
        colon = next((k for k, p in enumerate(pieces) if p[0] == ":colon"), -1)
        body = [p for p in real if p[0] != ":colon"]
        remarks = [p for p in pieces if p[0].startswith("/*")]
        if not body:
            out.extend(Declaration() for _ in remarks)
            return
        first, last = body[0][1], body[-1][2]
        out.extend(Declaration() for p in remarks if p[1] < first)
        if colon < 0 or pieces[colon][1] < first:
            raise ValueError("a declaration lacks its colon")
        at = pieces[colon][1]
        prop = "".join(p[0] for p in pieces[:colon] if p[1] >= first and not p[0].startswith("/*")).strip(SPACE)
        if not prop or any(c in SPACE for c in prop):
            raise ValueError("not a property name")
        has_value = last > at
        value = "".join(p[0] if p[0] != ":colon" else ":" for p in pieces[colon + 1 :] if p[2] <= last and not p[0].startswith("/*")).strip(SPACE) if has_value else ""
        m = _IMPORTANT.search(value)
        if m:
            value = value[: m.start()].rstrip(SPACE)
        out.append(Declaration(prop, value, m is not None))
        if has_value:
            out.extend(Declaration() for p in remarks if p[1] >= last)

    depth, seen_colon = 0, False
    for m in _PIECE.finditer(css):
        s = m[0]
        if any(g is not None for g in m.groups()):
            raise ValueError("unclosed comment or string, or a trailing backslash")
        if s == "(":
            depth += 1
        elif s == ")":
            depth = max(0, depth - 1)
        elif s in ("{", "}"):
            raise ValueError("a brace in a style")
        elif s == ";" and not depth:
            finish()
            pieces, seen_colon = [], False
            continue
        elif s == ":" and not depth and not seen_colon:
            seen_colon, s = True, ":colon"
        pieces.append((s, m.start(), m.end()))
    if depth:
        raise ValueError("unclosed bracket")
    if pieces:
        finish()
    return out
