"""Character references and ASCII helpers."""

from __future__ import annotations

import re
from html.entities import html5 as NAMED

_CASE = {c: c + 32 for c in range(65, 91)}
LONGEST = max(map(len, NAMED))

#: Windows-1252 meanings of the C1 range, by decoding it.
C1 = {c: bytes([c]).decode("cp1252", "ignore") or chr(c) for c in range(0x80, 0xA0)}

_REF = re.compile(r"&(?:#(?:[xX]([0-9a-fA-F]+)|([0-9]+));?|([A-Za-z0-9]+;?))")


def ascii_lower(s: str) -> str:
    return s.lower() if s.isascii() else s.translate(_CASE)


def code_point(n: int) -> str:
    if n == 0 or n > 0x10FFFF or 0xD800 <= n <= 0xDFFF:
        return "�"
    return C1.get(n) or chr(n)


def named(run: str) -> tuple[str, int] | None:
    """Value and length of the longest name that starts ``run``."""
    for n in range(min(len(run), LONGEST), 1, -1):
        value = NAMED.get(run[:n])
        if value is not None:
            return value, n
    return None


def _number(digits: str, base: int) -> str:
    digits = digits.lstrip("0")
    return code_point(int(digits, base) if 0 < len(digits) < 12 else (0x110000 if digits else 0))


def _in_text(m: re.Match) -> str:
    if m[3] is None:
        return _number(m[1], 16) if m[1] else _number(m[2], 10)
    hit = named(m[3])
    return m[0] if hit is None else hit[0] + m[3][hit[1] :]


def _in_attribute(m: re.Match) -> str:
    if m[3] is None:
        return _in_text(m)
    hit = named(m[3])
    if hit is None:
        return m[0]
    value, n = hit
    if m[3][n - 1] != ";":
        # without a semicolon a name that runs on, or meets "=", is literal
        follows = m[3][n] if n < len(m[3]) else m.string[m.end() : m.end() + 1]
        if follows == "=" or (follows.isascii() and follows.isalnum()):
            return m[0]
    return value + m[3][n:]


def decode_text(s: str) -> str:
    return _REF.sub(_in_text, s) if "&" in s else s


def decode_attribute(s: str) -> str:
    return _REF.sub(_in_attribute, s) if "&" in s else s
