"""Queries whose results SQL cannot give, or gives from a table of cases, against other ways to the same."""

from __future__ import annotations

from collections import Counter

import duckdb
import pytest
from markloom.functions import render
from markloom.functions.policy import PRESETS
from markloom.functions.tree import build
from markloom.plans import catalogue, dirty

SF = "/root/testdata/sf0.001"

_COUNTED = ("a", "article", "br", "div", "footer", "h1", "li", "meta", "nav", "script", "style", "title", "ul")
_COUNTS = """
    SELECT name, reason, sum(n)::BIGINT AS n FROM (
        SELECT t.name, CASE WHEN t.name IN ('script', 'style', 'title') THEN 'unsafe-element' ELSE 'not-allowed' END AS reason,
               len(regexp_extract_all(html, '<' || t.name || '[ >]')) AS n
        FROM pages, (SELECT unnest([{names}]) AS name) t) GROUP BY ALL HAVING sum(n) > 0""".format(
    names=", ".join(f"'{n}'" for n in _COUNTED)
)


def removed_one_by_one():
    found = Counter()
    for (html,) in duckdb.sql(f"SELECT html FROM '{SF}/pages.parquet'").fetchall():
        gone = []
        render.sanitized(build(html), PRESETS["none"], gone)
        found.update((name, reason) for _, name, reason in gone)
    return found


def test_removal_counts(spark):
    got = {(r["name"], r["reason"]): r["n"] for r in catalogue.removal_counts_none(spark, SF).collect()}
    assert got == removed_one_by_one()
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS FROM '{SF}/pages.parquet'")
    told = {(name, reason): n for name, reason, n in con.sql(_COUNTS).fetchall()}
    assert told == {k: n for k, n in got.items() if k[0] in _COUNTED}


def test_removals_rollup(spark):
    got = {(r["reason"], r["name"]): r["n"] for r in catalogue.removals_rollup(spark, SF).collect()}
    expect = Counter()
    for (name, reason), n in removed_one_by_one().items():
        expect.update({(reason, name): n, (reason, None): n, (None, None): n})
    assert got == expect


@pytest.mark.parametrize("name", sorted(dirty.QUERIES))
def test_cases(spark, name):
    out = dirty.QUERIES[name](spark, SF)
    columns = sorted(out.columns)
    told = duckdb.sql(f"SELECT {', '.join(columns)} FROM ({dirty.ORACLE_SQL[name]})").fetchall()
    assert sorted(tuple(r[c] for c in columns) for r in out.collect()) == sorted(told)
