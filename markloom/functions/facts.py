"""What a parse can say about URLs and styles before any policy is known."""

from __future__ import annotations

import re

from .fixed import UNSAFE_PROPERTIES

#: White space as browsers' script engines see it.
SPACE = "\t\n\v\f\r \xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
SPACE_CLASS = "[" + SPACE + "]"
_C0_SPACE = "".join(map(chr, range(33)))
_SCHEME = re.compile(r"[A-Za-z][A-Za-z0-9+.\-]*(?=:)")
_CLEAN = re.compile(r"[A-Za-z0-9+.\-]+(?=:)")
_AUTHORITY = re.compile(r"//([^/?#]*)")
_BAD_HOST = re.compile(r"[\x00\t\n\r #/:<>?@\[\\\]^|]")
_PORT = re.compile(r":(\d*)\Z")


def parsed_scheme(value: str) -> str | None:
    """Scheme of an absolute URL as a browser resolves it; None where it cannot be parsed."""
    s = value.strip(_C0_SPACE).translate({9: None, 10: None, 13: None})
    m = _SCHEME.match(s)
    if m is None:
        return None
    scheme, rest = m[0].lower(), s[m.end() + 1 :]
    host = _AUTHORITY.match(rest)
    if host and scheme not in ("http", "https", "ws", "wss", "ftp", "file"):
        name = host[1].rpartition("@")[2]
        port = _PORT.search(name)
        if port:
            if port[1] and int(port[1]) > 65535:
                return None
            name = name[: port.start()]
        elif ":" in name and not name.startswith("["):
            return None
        if name.startswith("["):
            if not name.endswith("]"):
                return None
        elif _BAD_HOST.search(name):
            return None
    return scheme


def url_facts(value: str) -> tuple[str | None, bool]:
    """(scheme, whether a data URL is an image); no scheme for relative values."""
    at = value.find(":")
    if at <= 0:
        return None, False
    m = _CLEAN.match(value)
    if m and m.end() == at:
        return m[0].lower(), value[:11].lower() == "data:image/"
    return parsed_scheme(value), value.strip(SPACE).lower().startswith("data:image/")


def dangerous(value: str) -> bool:
    scheme, image = url_facts(value)
    return scheme in ("javascript", "vbscript") or (scheme == "data" and not image)


def declarations(style: str) -> list[tuple[str, str]]:
    """(property, value) of the declarations between top-level semicolons that have both."""
    out, start, depth, quote = [], 0, 0, ""
    for i, c in enumerate(style + ";"):
        if quote and i < len(style):
            if c == quote:
                quote = ""
        elif c in "\"'":
            quote = c
        elif c == "(":
            depth += 1
        elif c == ")":
            depth = max(0, depth - 1)
        elif i == len(style) or (c == ";" and not depth):
            name, colon, value = style[start:i].partition(":")
            name, value = name.strip(SPACE).lower(), value.strip(SPACE)
            if colon and name and value:
                out.append((name, value))
            start = i + 1
    return out


_CONTROL = re.compile("[\x00-\x1f]")
_SQUEEZE = dict.fromkeys(map(ord, SPACE))
_QUOTES = {34: None, 39: None}


def unsafe_value(value: str) -> bool:
    if _CONTROL.search(value):
        return True
    v = value.translate(_SQUEEZE).lower().translate(_QUOTES)
    if "expression(" in v or "javascript:" in v or "vbscript:" in v:
        return True
    return "url(data:" in v and "url(data:image/" not in v


def safe_style(value: str) -> str:
    return "; ".join(f"{p}: {v}" for p, v in declarations(value) if p not in UNSAFE_PROPERTIES and not unsafe_value(v))
