"""Tokenizer, tree construction and entities."""

from __future__ import annotations

import random

import pytest
from markloom.functions import tokens as T
from markloom.functions.entities import decode_attribute, decode_text
from markloom.functions.mappings import adapted
from markloom.functions.render import events, plain_text, serialized
from markloom.functions.tree import build
from markloom.operators.parse import PARSERS, register_parser
from markloom.operators.sanitize import Sanitizer


def inner(html):
    return serialized(build(html)).removeprefix("<html><head></head><body>").removesuffix("</body></html>")


def kinds(text, *args):
    return T.Tokenizer(text, *args).all()[:-1]


@pytest.mark.parametrize(
    ("text", "expect"),
    [
        ("a<B x=1 X=2 y>b", [(T.CHARS, "a"), (T.OPEN, "b", [["x", "1"], ["y", ""]], False), (T.CHARS, "b")]),
        ("<br/><a b=c/>", [(T.OPEN, "br", [], True), (T.OPEN, "a", [["b", "c/"]], False)]),
        ("<a =x>", [(T.OPEN, "a", [["=x", ""]], False)]),
        ("x</>y", [(T.CHARS, "xy")]),
        ("<!-->a<!--->b<!--c--!>d<!--e", [(T.COMMENT, ""), (T.CHARS, "a"), (T.COMMENT, ""), (T.CHARS, "b"), (T.COMMENT, "c"), (T.CHARS, "d"), (T.COMMENT, "e")]),
        ("</1><?p><!x>", [(T.COMMENT, "1"), (T.COMMENT, "?p"), (T.COMMENT, "x")]),
        ("<p title='a", []),
        ("a\r\nb\rc", [(T.CHARS, "a\nb\nc")]),
        ("<!DOCTYPE Html PUBLIC 'p' \"s\">", [(T.DOCTYPE, "html", "p", "s", False)]),
        ("<!doctype>", [(T.DOCTYPE, None, None, None, True)]),
        ("<![CDATA[x]]>", [(T.COMMENT, "[CDATA[x]]")]),
    ],
)
def test_tokens(text, expect):
    assert kinds(text) == expect


def test_raw_content_models():
    assert kinds("a&amp;</b></title>x", T.RCDATA, "title") == [(T.CHARS, "a&</b>"), (T.SHUT, "title", [], False), (T.CHARS, "x")]
    script = "<!--<script></script>--></script>z"
    assert kinds(script, T.SCRIPT, "script")[0] == (T.CHARS, "<!--<script></script>-->")
    assert kinds("<!--></script>z", T.SCRIPT, "script")[0] == (T.CHARS, "<!-->")


def test_character_references():
    assert decode_text("&amp;&lt&notit;&#x80;&#0;&#xD800;&nosuch;&#65") == "&<¬it;€��&nosuch;A"
    assert decode_attribute("?a=1&copy=2&copyx&copy;&lt") == "?a=1&copy=2&copyx©<"


@pytest.mark.parametrize(
    ("html", "expect"),
    [
        ("<p>a<p>b", "<p>a</p><p>b</p>"),
        ("<b>1<p>2</b>3", "<b>1</b><p><b>2</b>3</p>"),
        ("<table>x<tr><td>y", "x<table><tbody><tr><td>y</td></tr></tbody></table>"),
        ("<ul><li>a<li>b</ul>", "<ul><li>a</li><li>b</li></ul>"),
        ("x</p>", "x<p></p>"),
        ("<h1>a</h3>b", "<h1>a</h1>b"),
        ("<svg viewbox=1><foreignobject><p>x</p></foreignobject></svg>y", '<svg viewBox="1"><foreignObject><p>x</p></foreignObject></svg>y'),
        ("<svg><a xlink:href=u></a><p>o", '<svg><a xlink:href="u"></a></svg><p>o</p>'),
        ("<image src=a>", '<img src="a">'),
        ("<pre>\n\nx", "<pre>\nx</pre>"),
        ("<select><option>a<option>b</select>", "<select><option>a</option><option>b</option></select>"),
        ("<a>1<a>2", "<a>1</a><a>2</a>"),
        ("<textarea><p></textarea>", "<textarea>&lt;p&gt;</textarea>"),
        ("<math><mi>x<p>y</p></mi></math>", "<math><mi>x<p>y</p></mi></math>"),
        ("<form><form>x</form>", "<form>x</form>"),
        ("<button>a<button>b", "<button>a</button><button>b</button>"),
    ],
)
def test_trees(html, expect):
    assert inner(html) == expect


def test_head_body_and_frames():
    assert serialized(build("<title>a&amp;b</title><!--c-->x")) == "<html><head><title>a&amp;b</title><!--c--></head><body>x</body></html>"
    assert serialized(build("<frameset><frame></frameset>")) == "<html><head></head><frameset><frame></frameset></html>"
    assert serialized(build("<template>x</template>y")) == "<html><head><template>x</template>y</head></html>"
    assert serialized(build("")) == "<html><head></head><body></body></html>"


def test_deep_nesting_and_events():
    root = build("<div>" * 5000 + "x")
    assert plain_text(root) == "x"
    rows = events(root)
    assert max(r["depth"] for r in rows) == 5002 and rows[0]["exit_seq"] == len(rows) - 1
    assert all(rows[r["exit_seq"]]["node_id"] == r["node_id"] for r in rows if r["kind"] == "open")


def test_reserialising_settles():
    rng = random.Random(1)
    bits = ["<p>", "</p>", "<b>", "</b>", "<i a='1'>", "</i>", "<div>", "</div>", "x", " ", "&lt;", "<ul>", "<li>", "</ul>", "<br>", "<!--c-->"]
    for _ in range(300):
        html = "".join(rng.choice(bits) for _ in range(rng.randint(1, 25)))
        once = serialized(build(html))
        assert plain_text(build(once)) == plain_text(build(html))


def test_parser_of_mappings():
    given = {"nodeName": "#document", "childNodes": [
        {"nodeName": "#documentType", "name": "html", "publicId": "p"},
        {"nodeName": "html", "tagName": "html", "childNodes": [
            {"nodeName": "svg", "tagName": "svg", "namespaceURI": "http://www.w3.org/2000/svg",
             "attrs": [{"name": "href", "prefix": "xlink", "value": "javascript:x"}, {"name": "id", "value": "i"}]},
            {"nodeName": "template", "tagName": "template", "content": {"childNodes": [{"nodeName": "#text", "value": "t"}]}},
            {"nodeName": "#comment", "data": "c"},
            {"nodeName": "math", "tagName": "math", "namespaceURI": "http://www.w3.org/1998/Math/MathML"},
        ]},
    ]}
    root = adapted(lambda _: given)("any")
    top = root.children[1]
    assert [(n.kind, n.name, n.ns, n.value) for n in top.children] == [
        ("element", "svg", "svg", ""), ("element", "template", "html", ""), ("comment", "", "html", "c"), ("element", "math", "mathml", ""),
    ]
    assert top.children[0].attrs == [["xlink href", "javascript:x"], ["id", "i"]]
    assert top.children[1].children[0].value == "t" and root.children[0].public == "p" and top.parent is root


def test_registered_parsers(spark):
    deep = {"nodeName": "#text", "value": "x"}
    for _ in range(3000):
        deep = {"nodeName": "b", "tagName": "b", "childNodes": [deep]}
    register_parser("deep", lambda _: {"nodeName": "#document", "childNodes": [deep]}, mappings=True)
    try:
        assert Sanitizer("none", "deep").clean("any") == "x"
    finally:
        del PARSERS["deep"]
    assert Sanitizer("basic", "dom").clean("<p>a<p>b") == Sanitizer("basic").clean("<p>a<p>b")
