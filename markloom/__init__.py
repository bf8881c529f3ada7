"""HTML corpora as Spark tables: parse, query, sanitize, report, serialize."""

from __future__ import annotations

import importlib

__version__ = "0.1.0"

_PLACES = {
    "Sanitizer": "operators.sanitize", "chunk_rows": "operators.sanitize", "removals": "operators.sanitize", "policy_table": "operators.sanitize",
    "Policy": "functions.policy", "PRESETS": "functions.policy", "policy": "functions.policy",
    "with_events": "operators.parse", "parse_events": "operators.parse", "nodes": "operators.parse", "attributes": "operators.parse",
    "tokenize": "operators.parse", "lenient_events": "operators.parse", "PARSERS": "operators.parse",
    "find_all": "operators.query", "find": "operators.query", "links": "operators.query", "walk": "operators.query",
    "text_content": "operators.query", "serialize": "operators.query",
    "legacy_sanitize": "operators.legacy", "sanitize_string": "operators.legacy", "options": "functions.dialect",
    "simple_transform": "functions.dialect", "register": "operators.sql",
}
__all__ = sorted(_PLACES)


def __getattr__(name: str):  # noqa: ANN202
    """Names of the public surface, imported when first used, so that workers load only what they run."""
    if name in _PLACES:
        return getattr(importlib.import_module(f"markloom.{_PLACES[name]}"), name)
    raise AttributeError(name)
