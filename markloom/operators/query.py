"""Finding elements, text and links."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from markloom.functions import render
from markloom.functions.expressions import element_text, serialized_html
from markloom.functions.tree import ELEMENT, TEXT

from .parse import arrow_column, nodes, parser_of

#: Elements that may be there without their tag in the source.
IMPLIED_TAGS = frozenset("html head body tbody tr colgroup p img".split())
FOUND = "array<struct<ord:int,name:string,attrs:array<struct<name:string,value:string>>,text:string>>"


def _text_of(node) -> str:  # noqa: ANN001
    out, work = [], [iter(node.children)]
    while work:
        for child in work[-1]:
            if child.kind == TEXT:
                out.append(child.value)
            elif child.kind == ELEMENT:
                work.append(iter(child.children))
                break
        else:
            work.pop()
    return "".join(out)


def find_all(df: DataFrame, match: str | Callable, html: str = "html", keys: tuple[str, ...] = (), parser: str | Callable | None = None, prefilter: bool = True) -> DataFrame:
    """One row per matching element in document order: keys, ord, name, attrs, text.

    ``match`` is a tag name or a predicate on a parsed node. Only what matches
    crosses from Python. For a tag that cannot be implied, documents without
    ``<tag`` in their source are left out before parsing.
    """
    build = parser_of(parser)
    if isinstance(match, str):
        if prefilter and match not in IMPLIED_TAGS and match.isascii() and match == match.lower():
            df = df.where(F.contains(F.lower(F.col(html)), F.lit("<" + match)))
        test = lambda n: n.name == match
    else:
        test = match

    def run(s: str) -> list[dict]:
        hits = (n for n in render.elements(build(s)) if test(n))
        return [{"ord": k, "name": n.name, "attrs": [{"name": a, "value": v} for a, v in n.attrs], "text": _text_of(n)} for k, n in enumerate(hits)]

    return df.select(*keys, F.inline(arrow_column(run, FOUND, F.col(html))))


def find(df: DataFrame, match: str | Callable, html: str = "html", keys: tuple[str, ...] = (), parser: str | Callable | None = None) -> DataFrame:
    """The first matching element of each document; documents without one give no row."""
    return find_all(df, match, html, keys, parser).where("ord = 0").drop("ord")


def attribute(attrs: Column, name: str) -> Column:
    """Value of an attribute in an attrs array; null if it is not there."""
    return F.filter(attrs, lambda a: a["name"] == name)[0]["value"]


def links(df: DataFrame, html: str = "html", keys: tuple[str, ...] = ()) -> DataFrame:
    return find_all(df, "a", html, keys).select(*keys, "ord", attribute(F.col("attrs"), "href").alias("href")).where("href is not null")


def find_all_events(events: Column, match: str | Callable[[Column], Column]) -> Column:
    """Matching opens of a stored events array; ``match`` is a name or a predicate on columns."""
    test = (lambda e: e["name"] == match) if isinstance(match, str) else match
    return F.filter(events, lambda e: (e["kind"] == "open") & test(e))


def find_event(events: Column, match: str | Callable[[Column], Column]) -> Column:
    return F.get(find_all_events(events, match), F.lit(0))


def text_content(events: Column, node_id: Column | None = None) -> Column:
    """All text of the document, raw text too, or of one node's subtree."""
    if node_id is not None:
        return element_text(events, node_id)
    return F.array_join(F.transform(F.filter(events, lambda e: e["kind"] == "text"), lambda e: e["value"]), "")


def serialize(events: Column, node_id: Column | None = None) -> Column:
    return serialized_html(events, node_id)


def walk(df: DataFrame, *keys: str, skip: Column | None = None) -> DataFrame:
    """Nodes in document order; where ``skip`` holds, the node stays but what is below it goes.

    ``keys`` name the document; without them each row of ``df`` is a document,
    told by a column ``doc``.
    """
    if not keys:
        df, keys = df.withColumn("doc", F.monotonically_increasing_id()), ("doc",)
    rows = nodes(df, *keys)
    if skip is None:
        return rows
    before = Window.partitionBy(*keys).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    cut = F.max(F.when(skip, F.col("exit_seq"))).over(before)
    return rows.withColumn("_cut", cut).where(F.col("_cut").isNull() | (F.col("seq") > F.col("_cut"))).drop("_cut")


def descendants(node_rows: DataFrame, ancestors: DataFrame, *keys: str) -> DataFrame:
    """Pairs (ancestor, descendant) by interval containment within the same keys, which name the document."""
    if not keys:
        raise ValueError("name the columns that tell documents apart: node numbers are counted within a document")
    a = ancestors.select(*keys, F.col("node_id").alias("ancestor_id"), F.col("seq").alias("_a"), F.col("exit_seq").alias("_b"))
    return node_rows.join(a, list(keys)).where((F.col("seq") > F.col("_a")) & (F.col("seq") < F.col("_b"))).drop("_a", "_b")


def text_by_document(node_rows: DataFrame, *keys: str) -> DataFrame:
    """Document text as an aggregate over nodes."""
    texts = node_rows.where("kind = 'text'").groupBy(*keys)
    return texts.agg(F.expr("listagg(value) within group (order by seq)").alias("text"))
