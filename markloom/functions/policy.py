"""Policies: what may stay. Deny by default; a baseline holds unless it is switched off."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field

from . import fixed
from .fixed import BASELINE_DROP, CONTENT_DROP, NO_END_TAG, RAW_TEXT, URL_ATTRIBUTES


#: Names an ancestor mask can hold, by bit.
MASKED = [*sorted(CONTENT_DROP | RAW_TEXT), *sorted(NO_END_TAG)]
BIT = {name: 1 << k for k, name in enumerate(MASKED)}


def mask_of(names: Iterable[str]) -> int:
    return sum(BIT[n] for n in set(names) & BIT.keys())


@dataclass(frozen=True)
class Policy:
    tags: frozenset[str] = frozenset()
    attrs: Mapping[str, frozenset[str]] = field(default_factory=dict)
    allow_unsafe: bool = False

    @property
    def drop_mask(self) -> int:
        """Ancestors under which nothing is shown; elements without end tag hold children in foreign content only."""
        return mask_of(self.drops() | (self.kept_tags() & NO_END_TAG))

    def drops(self) -> frozenset[str]:
        """Elements that go with all they hold."""
        return (CONTENT_DROP - self.tags) | (frozenset() if self.allow_unsafe else BASELINE_DROP)

    def kept_tags(self) -> frozenset[str]:
        return self.tags if self.allow_unsafe else self.tags - BASELINE_DROP

    def allowed(self, tag: str) -> frozenset[str]:
        return self.attrs.get(tag, frozenset()) | self.attrs.get("*", frozenset())

    def unsafe(self) -> Policy:
        return Policy(self.tags, self.attrs, True)

    def rows(self) -> list[tuple[str, str | None]]:
        """(tag, attribute) pairs; a tag without attributes has one row with null."""
        out: list[tuple[str, str | None]] = []
        for tag in sorted(self.tags | set(self.attrs)):
            names = sorted(self.attrs.get(tag, ()))
            out += [(tag, n) for n in names] or [(tag, None)]
        return out


def policy(tags: Iterable[str] = (), attrs: Mapping[str, Iterable[str]] | None = None, allow_unsafe: bool = False) -> Policy:
    return Policy(frozenset(tags), {k: frozenset(v) for k, v in (attrs or {}).items()}, allow_unsafe)


def _preset(tags: str, attrs: Mapping[str, str]) -> Policy:
    return policy(tags.split(), {tag: names.split() for tag, names in attrs.items()})


PRESETS: dict[str, Policy] = {
    "none": policy(),
    "basic": _preset(fixed.BASIC_TAGS, fixed.BASIC_ATTRIBUTES),
    "ugc": _preset(fixed.UGC_TAGS, fixed.UGC_ATTRIBUTES),
    "markdown": _preset(fixed.MARKDOWN_TAGS, fixed.MARKDOWN_ATTRIBUTES),
}


class Builder:
    """Collect rules, then ``build()`` an immutable sanitizer. Each step returns the builder."""

    def __init__(self, make: Callable, base: Policy | str | Mapping | None = None):
        self._make, self._tags, self._attrs, self._parser = make, set(), {}, None
        if base is not None:
            self.preset(base)

    def preset(self, base: Policy | str | Mapping) -> Builder:
        """Add a policy, the name of a preset, or a mapping with ``tags`` and ``attrs``. The baseline stays on."""
        if isinstance(base, str):
            base = PRESETS[base]
        elif not isinstance(base, Policy):
            base = policy(base.get("tags", ()), base.get("attrs", {}))
        self._tags |= base.tags
        for tag, names in base.attrs.items():
            self._attrs[tag] = self._attrs.get(tag, frozenset()) | names
        return self

    def allow(self, tag: str, attrs: Iterable[str] = ()) -> Builder:
        self._tags.add(tag)
        names = frozenset(attrs)
        if names:
            self._attrs[tag] = self._attrs.get(tag, frozenset()) | names
        return self

    def deny(self, tag: str) -> Builder:
        """Take back a tag and its own attributes; those of ``*`` stay."""
        self._tags.discard(tag)
        self._attrs.pop(tag, None)
        return self

    def parser(self, parser) -> Builder:  # noqa: ANN001
        """A name of the parser registry, a callable from str to a document node, or None for the default."""
        self._parser = parser
        return self

    def build(self):  # noqa: ANN201
        return self._make(Policy(frozenset(self._tags), dict(self._attrs), False), self._parser)


def attribute_verdict(policy_: Policy, allowed: frozenset[str], name: str, value: str) -> tuple[str | None, tuple[str, str, str] | None]:
    """(value to keep or None, removal or None) of one attribute."""
    from .facts import dangerous, safe_style

    if name not in allowed:
        return None, ("attr", name, "not-allowed")
    if policy_.allow_unsafe:
        return value, None
    if name.startswith("on"):
        return None, ("attr", name, "event-handler")
    if name in URL_ATTRIBUTES and dangerous(value):
        return None, ("url", name, "dangerous-url")
    if name == "style":
        safe = safe_style(value)
        if not safe:
            return None, ("style", name, "unsafe-css")
        if safe != value:
            return safe, ("style", name, "unsafe-css-declaration")
    return value, None
