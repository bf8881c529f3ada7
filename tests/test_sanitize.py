"""The allow-list sanitizer: policies, baseline, reports, and the agreement of its two shapes."""

from __future__ import annotations

import random

import pytest
from markloom.functions import render
from markloom.functions.facts import dangerous, safe_style
from markloom.functions.policy import PRESETS
from markloom.functions.tree import build
from markloom.operators import query as Q
from markloom.operators import sanitize as S
from markloom.operators.parse import attributes, nodes, parse_events, register_udtfs, tokenize, with_events
from pyspark.sql import functions as F


def clean(html, *allow, base=None):
    b = S.Sanitizer.builder(base)
    for tag, attrs in allow:
        b = b.allow(tag, attrs)
    return b.build().clean(html)


@pytest.mark.parametrize(
    ("html", "expect"),
    [
        ("<p onclick=x()>hi <script>bad()</script><b>there</b></p>", "<p>hi <b>there</b></p>"),
        ("<a href='JaVaScript:x'>l</a><a href='/ok' title=\"q&quot;\">m</a>", '<a>l</a><a href="/ok" title="q&quot;">m</a>'),
        ("<div><em>in</em></div><style>p{}</style><textarea>t</textarea>", "<em>in</em>"),
        ("1 < 2 &amp; 3\u00a0", "1 &lt; 2 &amp; 3&nbsp;"),
        ("<br></br><ul><li>x", "<br><ul><li>x</li></ul>"),
    ],
)
def test_basic_preset(html, expect):
    assert clean(html, base="basic") == expect


def test_baseline_holds_unless_switched_off():
    rules = [("script", ()), ("p", ("onclick", "style")), ("a", ("href",))]
    html = "<script>x</script><p onclick=a style='color:red;behavior:url(x)'>t</p><a href='data:text/html,x'>d</a>"
    assert clean(html, *rules) == '<p style="color: red">t</p><a>d</a>'
    loose = S.Sanitizer.builder().allow("script").allow("p", ["onclick"]).build()
    assert "".join(render.sanitized(build("<script>a<b</script><p onclick=a>"), loose.policy.unsafe())) == '<script>a<b</script><p onclick="a"></p>'


def test_builder_algebra():
    b = S.Sanitizer.builder("basic").preset({"tags": ["img"], "attrs": {"*": ["id"]}}).allow("u", ["class"]).deny("a")
    p = b.build().policy
    assert "img" in p.tags and "a" not in p.tags and p.allowed("u") == {"class", "id"} and "a" not in p.attrs
    assert len(PRESETS["basic"].tags) == 13 and len(PRESETS["ugc"].tags) == 51 and len(PRESETS["markdown"].tags) == 35
    assert S.Sanitizer.builder({"tags": ["script"], "allow_unsafe": True}).build().clean("<script>x</script>") == ""


@pytest.mark.parametrize(
    ("url", "bad"),
    [
        ("javascript:x", True), ("JAVASCRIPT:x", True), ("java\tscript:x", True), ("\x01javascript:x", True), (" javascript:x", True),
        ("vbscript:x", True), ("data:image/png,x", False), ("DATA:text/html,x", True), ("http://a/", False), ("/a:b", False), (":x", False),
        ("mailto:a", False), ("java\tscript://[", False), ("java script:x", False), ("", False),
    ],
)
def test_dangerous_urls(url, bad):
    assert dangerous(url) is bad


def test_styles():
    assert safe_style("COLOR : red; width:expression(1)") == "color: red"
    assert safe_style("a:b;background:url('x;y');c") == "a: b; background: url('x;y')"
    assert safe_style("background:url(data:text/html,x)") == "" and safe_style("b:url(data:image/png,x)") == "b: url(data:image/png,x)"
    assert safe_style("x:\x01y; -moz-binding:url(a)") == ""


def test_report_order_and_reasons(spark):
    s = S.Sanitizer.builder("basic").allow("p", ["onclick", "style"]).build()
    html = "<div><p id=a onclick=b style='x:y;behavior:z'>t<script>s</script></p><a href=javascript:1>"
    r = spark.createDataFrame([(html,)], "html string").select(s.report(F.col("html")).alias("r")).first()["r"]
    assert r["html"] == s.clean(html)
    assert [tuple(x) for x in r["removed"]] == [
        ("tag", "div", "not-allowed"), ("attr", "id", "not-allowed"), ("attr", "onclick", "event-handler"),
        ("style", "style", "unsafe-css-declaration"), ("tag", "script", "unsafe-element"), ("url", "href", "dangerous-url"),
    ]


VOCABULARY = (
    "<p>|</p>|<b>|</b>|<a href='javascript:1'>|<a href=/x id=1>|</a>|<script>x<y</script>|<style>a{}</style>|<svg>|</svg>|<math>|</math>"
    "|<table>|<td>|</table>|<img src=x onerror=1>|<div style='color:red;x:expression(1)'>|</div>|text|&lt;|&amp;|\u00a0|<!--c-->|<ul><li>"
    "|</ul>|<br>|<textarea>|</textarea>|<noscript>|</noscript>|<option>|<title>t</title>|<xmp>|</xmp>|<svg><a xlink:href='data:x'>|<col>"
    "|<input type=checkbox checked>|<plaintext>|<template>|</template>|<iframe>|</iframe>"
).split("|")


def random_pages(n, seed=4):
    rng = random.Random(seed)
    return ["".join(rng.choice(VOCABULARY) for _ in range(rng.randint(0, 14))) for _ in range(n)]


def test_two_shapes_agree_on_odd_markup(spark):
    df = spark.createDataFrame([(i, h) for i, h in enumerate(random_pages(400))] + [(9999, None)], "id int, html string").repartition(8)
    df = with_events(df)
    policies = [S.Sanitizer(n) for n in PRESETS] + [
        S.Sanitizer.builder("ugc").allow("script").allow("style").allow("plaintext").allow("svg").allow("textarea").allow("a", ["xlink href"]).allow("div", ["style"]).build()
    ]
    policies.append(S.Sanitizer(policies[-1].policy.unsafe()))
    for s in policies:
        both = s.report(F.col("html"))
        rows = df.select("id", both["html"].alias("a"), s.sanitize_events(F.col("events")).alias("b"), both["removed"].alias("c"), s.removed_events(F.col("events")).alias("d")).collect()
        for r in rows:
            assert r["a"] == r["b"] and r["c"] == r["d"], r


def test_sanitizing_again_settles_and_is_safe():
    s = S.Sanitizer("ugc")
    for html in random_pages(500, seed=8):
        once = s.clean(html)
        twice = s.clean(once)
        assert s.clean(twice) == twice
        for node in render.elements(build(twice)):
            assert node.name != "script" and not any(k.startswith("on") or "javascript:" in v for k, v in node.attrs)


def test_chunks(spark):
    s = S.Sanitizer("basic")
    df = spark.createDataFrame([(1, "<p>" + "ab " * 50 + "</p>" * 1 + "<b>x</b>" * 30), (2, "<script></script>"), (3, None)], "id int, html string")
    rows = S.chunk_rows(df, s, keys=("id",), size=40).collect()
    assert {r["id"] for r in rows} == {1}
    parts = [r["chunk"] for r in sorted(rows, key=lambda r: r["ord"])]
    assert "".join(parts) == s.clean(df.where("id = 1").first()["html"]) and all(len(p) >= 40 for p in parts[:-1])
    assert render.chunked(["\U0001f600"] * 3, 4) == ["\U0001f600" * 2, "\U0001f600"]


def test_nodes_find_walk_and_text(spark):
    html = "<div id=a><p>x<b>y</b></p><p>z</p></div><script>s</script><!--c-->"
    df = with_events(spark.createDataFrame([(1, html), (2, "plain")], "id int, html string"))
    rows = nodes(df, "id").where("id = 1").orderBy("seq").collect()
    assert [r["name"] or r["value"] for r in rows] == ["html", "head", "body", "div", "p", "x", "b", "y", "p", "z", "script", "s", "c"]
    assert attributes(nodes(df, "id"), "id").select("tag", "name", "value").collect() == [("div", "id", "a")]
    assert [r["text"] for r in Q.find_all(df, "p", keys=("id",)).orderBy("ord").collect()] == ["xy", "z"]
    assert Q.find(df, lambda n: n.name in ("b", "p"), keys=("id",)).first()["name"] == "p"
    assert Q.find_all(df, "body", keys=("id",)).count() == 2
    one = df.where("id = 1")
    assert one.select(Q.text_content(F.col("events"))).first()[0] == "xyzs"
    p = next(r["node_id"] for r in rows if r["name"] == "p")
    assert one.select(Q.text_content(F.col("events"), F.lit(p)), Q.serialize(F.col("events"), F.lit(p))).first()[:] == ("xy", "<p>x<b>y</b></p>")
    assert one.select(Q.find_event(F.col("events"), "b")["name"], F.size(Q.find_all_events(F.col("events"), "p"))).first()[:] == ("b", 2)
    met = Q.walk(df.where("id = 1"), "id", skip=F.coalesce(F.col("name") == "p", F.lit(False))).orderBy("seq").collect()
    assert [r["name"] or r["value"] for r in met] == ["html", "head", "body", "div", "p", "p", "script", "s", "c"]
    assert Q.text_by_document(nodes(df, "id"), "id").orderBy("id").collect() == [(1, "xyzs"), (2, "plain")]
    pairs = Q.descendants(nodes(df, "id"), nodes(df, "id").where("name = 'p'"), "id")
    assert pairs.count() == 4


def test_serialize_equals_the_tree(spark):
    rows = random_pages(200, seed=6)
    df = spark.createDataFrame([(i, h) for i, h in enumerate(rows)], "id int, html string")
    got = df.select("id", Q.serialize(parse_events(F.col("html"))).alias("s")).collect()
    assert all(r["s"] == render.serialized(build(rows[r["id"]])) for r in got)


def test_parsers_and_fragment(spark):
    df = spark.createDataFrame([("<p>a<p>b<td>c",)], "html string")
    lenient = S.Sanitizer.builder("basic").parser("lenient").build()
    assert df.select(lenient.sanitize(F.col("html"))).first()[0] == "<p>a</p><p>bc</p>"
    own = S.Sanitizer.builder("basic").parser(lambda s: build(s.upper())).build()
    assert own.clean("<p>a") == "<p>A</p>"
    kept = df.select(S.Sanitizer("basic").fragment(F.col("html")).alias("e")).first()["e"]
    assert [(e["kind"], e["name"] or e["value"]) for e in kept] == [
        ("open", "p"), ("text", "a"), ("close", "p"), ("open", "p"), ("text", "bc"), ("close", "p"),
    ]


def test_tokens_and_table_functions(spark):
    row = spark.createDataFrame([("a<b c=d>",)], "h string").select(tokenize(F.col("h")).alias("t")).first()["t"]
    assert [t["kind"] for t in row] == ["character", "start_tag", "eof"] and row[1]["attrs"][0]["value"] == "d"
    register_udtfs(spark)
    assert spark.sql("SELECT count(*) FROM html_nodes('<p>a')").first()[0] == 5
    assert spark.sql("SELECT kind FROM html_tokens('<p>a') ORDER BY ord").first()[0] == "start_tag"


def test_policy_relations(spark):
    table = S.policy_table(spark)
    merged = S.policy_union(table, "basic", "markdown")
    assert merged.where("tag = 'a' and attr = 'href'").count() == 1
    denied = spark.createDataFrame([("a",)], "tag string")
    assert S.policy_deny(merged, denied).where("tag = 'a'").count() == 0
    df = with_events(spark.createDataFrame([(1, "<a href=x id=1 class=c>y</a><p id=2 href=3>")], "id int, html string"))
    kept = S.kept_attributes(df, table, "ugc", "id").select("tag", "name").collect()
    assert sorted(map(tuple, kept)) == [("a", "class"), ("a", "href"), ("a", "id"), ("p", "id")]


def test_sql_functions_and_public_names(spark):
    import markloom

    assert all(getattr(markloom, n) is not None for n in markloom.__all__)
    markloom.register(spark)
    row = spark.sql(
        "SELECT html_text('<p>a<script>b'), html_sanitize_basic('<p onclick=x>a</p><i>b'), html_serialize('x'), html_lenient('<x>y'), "
        "size(html_events('<p>')), html_text(CAST(null AS string))"
    ).first()
    assert row[:] == ("a", "<p>a</p><i>b</i>", "<html><head></head><body>x</body></html>", "y", 8, None)
    joined = spark.sql("SELECT t.name FROM (SELECT '<ul><li>x' AS h) d, LATERAL html_nodes(d.h) t WHERE t.kind = 'open' ORDER BY t.seq").collect()
    assert [r[0] for r in joined] == ["html", "head", "body", "ul", "li"]
