"""The lenient dialect on columns."""

from __future__ import annotations

from functools import lru_cache
from typing import Any

from pyspark.sql import Column

from markloom.functions.dialect import Compiled, Options, options

from .parse import arrow_column


def compiled(given: Options | dict[str, Any] | None = None) -> Compiled:
    if given is None:
        return _defaults()
    return Compiled(given if isinstance(given, Options) else options(**given))


@lru_cache(maxsize=1)
def _defaults() -> Compiled:
    return Compiled(Options())


def legacy_sanitize(html: Column, given: Options | dict[str, Any] | None = None) -> Column:
    """Sanitized HTML under the given options; null gives the empty string.

    Options are compiled once on the driver and travel with the function.
    Callables among them run on the workers and may see a row twice if a task
    is tried again.
    """
    from pyspark.sql import functions as F

    made = compiled(given)
    return F.coalesce(arrow_column(made.clean, "string", html.cast("string")), F.lit(""))


def sanitize_string(html: Any, given: Options | dict[str, Any] | None = None) -> str:
    """The same for one value on the driver."""
    return compiled(given).clean(html)
