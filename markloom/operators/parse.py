"""Parsing as table operators: documents in, events, nodes, attributes or tokens out.

``events`` is one array per document in document order, opens and closes, with
facts that no policy changes. Everything after it is Catalyst. Python sees the
HTML column only; filter and prune rows before parsing, since nothing is pushed
below a Python operator that is not there already.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from markloom.functions import render, tokens, tree
from markloom.functions.lenient import Lenient
from markloom.functions.mappings import adapted

EVENTS = (
    "array<struct<seq:int,kind:string,node_id:int,parent_id:int,depth:int,exit_seq:int,name:string,ns:string,parent_name:string,"
    "value:string,public_id:string,system_id:string,anc_mask:long,attrs:array<struct<name:string,value:string,url_scheme:string,"
    "url_data_image:boolean,style_decls:array<struct<prop:string,val:string>>>>>>"
)
TOKENS = (
    "array<struct<kind:string,name:string,data:string,attrs:array<struct<name:string,value:string>>,self_closing:boolean,"
    "public_id:string,system_id:string,force_quirks:boolean>>"
)
LENIENT_EVENTS = "array<struct<kind:string,name:string,data:string,attrs:array<struct<name:string,value:string>>,is_implied:boolean,end_index:int>>"


#: Bounds of the results that a Python worker holds at once: rows, and characters of the markup they come from.
PIECE_ROWS = 1000
PIECE_CHARS = 1 << 18


class _TreeHandler:
    """Builds a plain tree from the lenient parser's events."""

    def __init__(self):
        self.root = tree.Node(tree.DOCUMENT)
        self.open = [self.root]

    def _add(self, node: tree.Node) -> tree.Node:
        node.parent = self.open[-1]
        self.open[-1].children.append(node)
        return node

    def opened(self, name: str, attrs: dict) -> None:
        self.open.append(self._add(tree.Node(tree.ELEMENT, name, "html", [[k, v] for k, v in attrs.items()])))

    def text(self, data: str, clean: bool) -> None:
        near = self.open[-1].children
        if near and near[-1].kind == tree.TEXT:
            near[-1].value += data
        else:
            self._add(tree.Node(tree.TEXT, value=data))

    def closed(self, name: str, implied: bool) -> None:
        if len(self.open) > 1:
            self.open.pop()

    def remark(self, data: str) -> None:
        self._add(tree.Node(tree.REMARK, value=data))


def lenient_tree(html: str) -> tree.Node:
    """Tree of the forgiving parser: no implied elements, all names in the html namespace, no doctype."""
    handler = _TreeHandler()
    Lenient(handler).run(html)
    return handler.root


#: Parsers by name; any callable from str to a document node may be registered. A cluster has no DOM, so ``dom`` is the browser's parse.
PARSERS: dict[str, Callable[[str], tree.Node]] = {"browser": tree.build, "dom": tree.build, "lenient": lenient_tree}


def register_parser(name: str, parse: Callable[[str], object], mappings: bool = False) -> None:
    """Register a parser by name; with ``mappings`` it gives nested mappings of nodes instead of a document node."""
    PARSERS[name] = adapted(parse) if mappings else parse


def parser_of(parser: str | Callable | None) -> Callable[[str], tree.Node]:
    return tree.build if parser is None else PARSERS[parser] if isinstance(parser, str) else parser


def pieces(fn: Callable, parts: Iterable[pa.Array], kind: pa.DataType) -> Iterator[pa.Array]:
    """Results of ``fn`` in order, in arrays of at most ``PIECE_ROWS`` rows, none begun beyond ``PIECE_CHARS`` of input."""
    for part in parts:
        made, chars = [], 0
        for value in part:
            s = value.as_py()
            made.append(None if s is None else fn(s))
            chars += 0 if s is None else len(s)
            if len(made) >= PIECE_ROWS or chars >= PIECE_CHARS:
                yield pa.array(made, type=kind)
                made, chars = [], 0
        if made:
            yield pa.array(made, type=kind)


def arrow_function(fn: Callable, ddl: str) -> Callable:
    """``fn`` of each string as an Arrow-batched function; null gives null.

    Spark sends 10,000 rows at once. Their results as Python objects are many
    times the markup, so they go back in pieces and only one piece is held.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    kind = T._parse_datatype_string(ddl)
    arrow_kind = to_arrow_type(kind)

    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return pieces(fn, parts, arrow_kind)

    run.__annotations__ = {"parts": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, kind)


def arrow_column(fn: Callable, ddl: str, html: Column, *, deterministic: bool = True) -> Column:
    make = arrow_function(fn, ddl)
    return (make if deterministic else make.asNondeterministic())(html)


def parse_events(html: Column, parser: str | Callable | None = None) -> Column:
    """Events array of each document; null for null. A document parses once per use, so persist what several queries share."""
    build = parser_of(parser)
    return arrow_column(lambda s: render.events(build(s)), EVENTS, html)


def with_events(df: DataFrame, html: str = "html", parser: str | Callable | None = None) -> DataFrame:
    return df.withColumn("events", parse_events(F.col(html), parser))


def nodes(df: DataFrame, *keys: str) -> DataFrame:
    """One row per node of ``df.events``, opens standing for elements, with the key columns."""
    return df.select(*keys, F.inline(F.filter("events", lambda e: e["kind"] != "close")))


def attributes(node_rows: DataFrame, *keys: str) -> DataFrame:
    """One row per attribute: keys, seq, node_id, tag, position and the attribute's facts."""
    flat = node_rows.select(*keys, "seq", "node_id", F.col("name").alias("tag"), F.posexplode("attrs").alias("position", "attr"))
    return flat.select(*keys, "seq", "node_id", "tag", "position", F.col("attr.name").alias("name"), "attr.value", "attr.url_scheme", "attr.url_data_image", "attr.style_decls")


_KINDS = {tokens.CHARS: "character", tokens.OPEN: "start_tag", tokens.SHUT: "end_tag", tokens.COMMENT: "comment", tokens.DOCTYPE: "doctype", tokens.END: "eof"}
CONTENT_MODELS = {"data": tokens.DATA, "rcdata": tokens.RCDATA, "rawtext": tokens.RAWTEXT, "script_data": tokens.SCRIPT, "plaintext": tokens.PLAIN}


def _token_row(t: tuple) -> dict:
    row = dict.fromkeys(("name", "data", "attrs", "self_closing", "public_id", "system_id", "force_quirks")) | {"kind": _KINDS[t[0]]}
    if t[0] in (tokens.OPEN, tokens.SHUT):
        row |= {"name": t[1], "attrs": [{"name": k, "value": v} for k, v in t[2]], "self_closing": t[3]}
    elif t[0] == tokens.DOCTYPE:
        row |= {"name": t[1], "public_id": t[2], "system_id": t[3], "force_quirks": t[4]}
    elif t[0] != tokens.END:
        row["data"] = t[1]
    return row


def tokenize(html: Column, state: str = "data", last_start_tag: str = "") -> Column:
    """Token stream of each string in a content model, the end token last."""
    model = CONTENT_MODELS[state]
    return arrow_column(lambda s: [_token_row(t) for t in tokens.Tokenizer(s, model, last_start_tag).all()], TOKENS, html)


class _EventRows:
    def __init__(self):
        self.rows: list[dict] = []
        self.parser: Lenient | None = None

    def _row(self, kind: str, name: str | None = None, data: str | None = None, attrs: dict | None = None, implied: bool | None = None) -> None:
        pairs = None if attrs is None else [{"name": k, "value": v} for k, v in attrs.items()]
        self.rows.append({"kind": kind, "name": name, "data": data, "attrs": pairs, "is_implied": implied, "end_index": self.parser.end})

    def opened(self, name: str, attrs: dict) -> None:
        self._row("open", name, attrs=attrs)

    def text(self, data: str, clean: bool) -> None:
        self._row("text", data=data)

    def closed(self, name: str, implied: bool) -> None:
        self._row("close", name, implied=implied)

    def remark(self, data: str) -> None:
        self._row("comment", data=data)


def lenient_events(html: Column, decode_entities: bool = True, lower_tags: bool = True, lower_attributes: bool | None = None) -> Column:
    """Events of the forgiving parser: open, text, close, comment."""

    def run(s: str) -> list[dict]:
        handler = _EventRows()
        handler.parser = Lenient(handler, decode_entities, lower_tags, lower_attributes)
        handler.parser.run(s)
        return handler.rows

    return arrow_column(run, LENIENT_EVENTS, html)


def register_udtfs(spark) -> None:  # noqa: ANN001
    """SQL table functions ``html_tokens(html)`` and ``html_nodes(html)`` for LATERAL use."""

    @F.udtf(returnType="ord int, kind string, name string, data string, self_closing boolean")
    class HtmlTokens:
        def eval(self, html: str):  # noqa: ANN201
            for k, t in enumerate(tokens.Tokenizer(html or "").all()):
                row = _token_row(t)
                yield k, row["kind"], row["name"], row["data"], row["self_closing"]

    @F.udtf(returnType="seq int, exit_seq int, kind string, name string, parent_name string, value string")
    class HtmlNodes:
        def eval(self, html: str):  # noqa: ANN201
            for e in render.events(tree.build(html or "")):
                if e["kind"] != "close":
                    yield e["seq"], e["exit_seq"], e["kind"], e["name"], e["parent_name"], e["value"]

    spark.udtf.register("html_tokens", HtmlTokens)
    spark.udtf.register("html_nodes", HtmlNodes)
