"""The lenient dialect, option by option."""

from __future__ import annotations

import re

import pytest
from markloom.functions.dialect import naughty, options, simple_transform, url_host
from markloom.functions.lenient import decode
from markloom.functions.srcset import candidates, style_declarations, written
from markloom.operators.legacy import legacy_sanitize, sanitize_string
from markloom.operators.parse import lenient_events
from pyspark.sql import functions as F


@pytest.mark.parametrize(
    ("html", "given", "expect"),
    [
        (None, {}, ""), (7, {}, "7"), ("", {}, ""),
        ("<p>a<wiggly>b</wiggly></p>", {}, "<p>ab</p>"),
        ("x<script>y</script>z<!-- c -->", {}, "xz"),
        ("<wiggly a=1>b</wiggly>", {"allowed_tags": False, "allowed_attributes": False}, '<wiggly a="1">b</wiggly>'),
        ("<i>a</i><b>c</b>", {"allowed_tags": ["b"], "disallowed_tags_mode": "escape"}, "&lt;i&gt;a&lt;/i&gt;<b>c</b>"),
        ("<i>a<b>c</b></i>", {"allowed_tags": ["b"], "disallowed_tags_mode": "recursiveEscape"}, "&lt;i&gt;a&lt;b&gt;c&lt;/b&gt;&lt;/i&gt;"),
        ("<i>a<b>c</b></i>d", {"allowed_tags": ["b"], "disallowed_tags_mode": "completelyDiscard"}, "<b>c</b>"),
        ("<a href='javascript:x' name=n>l</a>", {}, '<a name="n">l</a>'),
        ("<a href='jav&#x09;ascript:x'>l</a>", {}, "<a>l</a>"),
        ("<a href='//h/x'>l</a>", {"allow_protocol_relative": False}, "<a>l</a>"),
        ("<img src=a.png alt=''>", {"allowed_tags": ["img"]}, '<img src="a.png" alt="" />'),
        ("<a data-x=1 data-y=2 z=3>", {"allowed_attributes": {"a": ["data-*"]}}, '<a data-x="1" data-y="2"></a>'),
        ("<p class='a b-1 c'>x", {"allowed_classes": {"p": ["a", "b-*"]}}, '<p class="a b-1">x</p>'),
        ("<p class='a'>x", {"allowed_classes": {"p": []}}, "<p>x</p>"),
        ("<p class='ab c'>x", {"allowed_classes": {"p": [re.compile("^a")]}}, '<p class="ab">x</p>'),
        ("<p style='color:red;width:1px'>x", {"allowed_attributes": {"p": ["style"]}, "allowed_styles": {"p": {"color": ["^red$"]}}}, '<p style="color:red">x</p>'),
        ("<p style='a{'>x", {"allowed_attributes": {"p": ["style"]}}, "<p>x</p>"),
        ("<b><i><u>x</u></i></b>", {"nesting_limit": 2}, "<b><i>x</i></b>"),
        ("a<html><p>b</p></html>c", {"enforce_html_boundary": True}, "<p>b</p>"),
        ("<b>x</b>", {"transform_tags": {"b": "strong"}}, "<strong>x</strong>"),
        ("<b>x</b>", {"text_filter": lambda t, tag: f"{t}!{tag}"}, "<b>x!b</b>"),
        ("<p></p><p>x</p>", {"exclusive_filter": lambda f: not f.text}, "<p>x</p>"),
        ("<p>a<b>x</b></p>", {"exclusive_filter": lambda f: "excludeTag" if f.tag == "b" else False}, "<p>ax</p>"),
        ("<i a=1>", {"allowed_tags": [], "disallowed_tags_mode": "escape", "preserve_escaped_attributes": True}, '&lt;i a="1"&gt;'),
        ("<iframe src='https://a.b.com/x'></iframe><iframe src='https://c.com'></iframe>", {"allowed_tags": ["iframe"], "allowed_attributes": {"iframe": ["src"]}, "allowed_iframe_domains": ["b.com"]}, '<iframe src="https://a.b.com/x"></iframe><iframe></iframe>'),
        ("<p>1 &amp;&lt; 2&nbsp;</p", {}, "<p>1 &amp;&lt; 2\u00a0</p>"),
        ("<P>up</P>", {"parser": {"lowerCaseTags": True}}, "<p>up</p>"),
        ("</p>x</br>", {}, "<p></p>x<br />"),
        ("<img srcset='a.png 1x, javascript:b 2x'>", {"allowed_tags": ["img"]}, '<img srcset="a.png 1x" />'),
    ],
)
def test_options(html, given, expect):
    assert sanitize_string(html, given) == expect


def test_both_spellings_and_unknown_options():
    assert options(allowedTags=["b"]).allowed_tags == ["b"]
    with pytest.raises(TypeError):
        options(allowed_tag=[])
    with pytest.warns(UserWarning, match="script"):
        sanitize_string("x", {"allowed_tags": ["script"]})


def test_transformers():
    made = simple_transform("ol", {"class": "c"})("ul", {"id": "i"})
    assert made == {"tag_name": "ol", "attribs": {"id": "i", "class": "c"}}
    assert simple_transform("ol", {"class": "c"}, merge=False)("ul", {"id": "i"})["attribs"] == {"class": "c"}
    star = {"transform_tags": {"*": lambda n, a: {"tag_name": n, "attribs": {**a, "name": "t"}}}}
    assert sanitize_string("<a>x</a>", star) == '<a name="t">x</a>'
    text = {"transform_tags": {"b": lambda n, a: {"tag_name": n, "attribs": a, "text": "new"}}}
    assert sanitize_string("<b>old</b><i>y</i>", text) == "<b>new</b><i>y</i>"
    assert sanitize_string("<p>a<br>b</p>", {"transform_tags": {"br": lambda n, a: {"tagName": "i", "text": " "}}}) == "<p>a<i> </i>b</p>"
    assert sanitize_string("<p>old</p>", {"transform_tags": {"p": lambda n, a: {"text": "new"}}}) == "new"


def test_hooks_see_opens_and_closes():
    met = []
    hooks = {"on_open_tag": lambda n, a: met.append((n, dict(a))), "on_close_tag": lambda n, implied: met.append((n, implied))}
    sanitize_string("<div id=a><p>x<p>y</div>", {"allowed_tags": ["p"], **hooks})
    assert met == [("div", {"id": "a"}), ("p", {}), ("p", True), ("p", {}), ("p", True), ("div", False)]


@pytest.mark.parametrize(
    ("html", "given", "expect"),
    [
        ("<b><i/", {"allowed_tags": ["b"]}, "<b>/</b>"),
        ("<u>x", {"allowed_tags": [], "disallowed_tags_mode": "escape"}, "&lt;u&gt;x"),
        ("x <u y", {"disallowed_tags_mode": "recursiveEscape"}, "x &lt;u y"),
        ("<a href='java&#0000001script:x'>l</a>", {}, "<a>l</a>"),
        ("<a href='/\\h/x'>l</a>", {"allow_protocol_relative": False}, "<a>l</a>"),
        ("<iframe src='/\n\\h'>", {"allowed_tags": ["iframe"], "allowed_attributes": {"iframe": ["src"]}, "allowed_iframe_hostnames": ["k"], "allow_iframe_relative_urls": True}, "<iframe></iframe>"),
        ("<script src='https://h/x'>y</script>", {"allowed_tags": ["script"], "allowed_attributes": {"script": ["src"]}, "allowed_script_hostnames": ["h"], "allow_vulnerable_tags": True}, '<script src="https://h/x"></script>'),
        ("<p class='a-1 b'>x", {"allowed_classes": {"*": ["b"], "p": ["a-*"]}}, '<p class="a-1 b">x</p>'),
        ("<textarea>&lt;b&gt;&amp;amp;</textarea>", {"allowed_tags": ["textarea"]}, "<textarea>&lt;b&gt;&amp;amp;</textarea>"),
        ("a &amp; & &reg;", {"parser": {"decodeEntities": False}}, "a &amp; &amp; &reg;"),
        ("<input checked form>", {"allowed_tags": "input", "allowed_attributes": {"input": ["checked", "form"]}}, "<input checked />"),
    ],
)
def test_hard_cases(html, given, expect):
    assert sanitize_string(html, given) == expect


def test_entities_in_text_and_attributes():
    assert decode("&amp;&ampere &copy2 &#x41;&#65;&bogus;") == "&&ere ©2 AA&bogus;"
    assert decode("x&copy=1", True) == "x&copy=1" and decode("x&copy", True) == "x©"


def test_naughty_urls_and_hosts():
    assert naughty("jav<!-- x -->ascript:1", ("http",)) and not naughty("http:x", ("http",)) and not naughty("/x:y", ())
    assert url_host("https://User@Ex.com:8/p") == (False, "ex.com") and url_host("/a/b")[0] and url_host("//h/x") == (False, "h")


def test_srcset_and_styles():
    assert written(candidates("a.png 1.50x, b 100w 50h, c -1x, d 1w 2x,, e,")) == "a.png 1.5x, b 100w 50h, e"
    assert [str(d) for d in style_declarations("A: b !important; c:; /* x */")] == ["A:b !important", "c:", "undefined:undefined"]
    for bad in ("a", "a:b'", "a:(", "a:b\\", "a:b}", "/* x"):
        with pytest.raises(ValueError):
            style_declarations(bad)


def test_columns_and_events(spark):
    df = spark.createDataFrame([("<b>x</b><script>y",), (None,)], "html string")
    assert [r[0] for r in df.select(legacy_sanitize(F.col("html"))).collect()] == ["<b>x</b>", ""]
    rows = df.select(lenient_events(F.col("html")).alias("e")).first()["e"]
    assert [(e["kind"], e["name"]) for e in rows][:3] == [("open", "b"), ("text", None), ("close", "b")]
    assert rows[-1]["is_implied"] is True


MATRIX = [
    {}, {"allowed_tags": []}, {"allowed_tags": False, "allowed_attributes": False, "allow_vulnerable_tags": True}, {"disallowed_tags_mode": "escape"},
    {"disallowed_tags_mode": "recursiveEscape"}, {"disallowed_tags_mode": "completelyDiscard"}, {"enforce_html_boundary": True}, {"nesting_limit": 2},
    {"allowed_attributes": {"*": ["id", "data-*"], "a": ["href"]}}, {"self_closing": []}, {"parser": {"decodeEntities": False}},
    {"parser": {"lowerCaseTags": False}}, {"allowed_classes": {"*": ["a*"]}}, {"allowed_attributes": {"*": ["style"]}},
    {"allowed_attributes": {"p": [{"name": "id", "multiple": True, "values": ["x", "y"]}]}}, {"allowed_schemes": ["https"]},
    {"allowed_schemes_by_tag": {"img": ["data"]}}, {"non_text_tags": ["style", "p"]}, {"preserve_escaped_attributes": True, "disallowed_tags_mode": "escape"},
    {"transform_tags": {"*": lambda n, a: {"tag_name": "p" if n == "x" else n, "attribs": a}}}, {"text_filter": lambda t, tag: t.upper()},
    {"exclusive_filter": lambda f: f.tag == "b"}, {"allowed_empty_attributes": [], "non_boolean_attributes": ["*"]},
    {"allow_protocol_relative": False}, {"parse_style_attributes": False},
]


def test_option_matrix_on_random_markup():
    import random
    import warnings

    rng = random.Random(12)
    bits = (
        "<p id='x z'>|</p>|<b>|</b>|<x>|</x>|<a href=javascript:1>|<a href=//h>|</a>|<script>a<b</script>|<img src=data:x alt>|<p style='a:b;c'>|<p class='ab b'>"
        "|<html>|</html>|&amp;|&|<|>|</|<!--c-->|<!-|<![CDATA[x]]>|<textarea>&lt;</textarea>|<br/>|<svg><g/></svg>|<title>t|</title>|text| |<!doctype x>"
    ).split("|")
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        made = [options(**m) for m in MATRIX]
        from markloom.functions.dialect import Compiled

        for given, o in zip(MATRIX, made, strict=True):
            c = Compiled(o)
            for _ in range(120):
                html = "".join(rng.choice(bits) for _ in range(rng.randint(0, 14)))
                out = c.clean(html)
                assert isinstance(out, str) and c.clean(html) == out
                if given.get("allowed_tags") is not False:
                    assert "<script" not in out and "href=\"javascript" not in out.replace("&lt;", "")


def test_wrong_descriptor_warns():
    with pytest.warns(UserWarning, match="descriptor"):
        assert [c.url for c in candidates("a 0w, b 1w 2x, c -1x, d 1q, e 2h 1w, f 0x")] == ["e", "f"]
