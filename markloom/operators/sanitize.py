"""The allow-list sanitizer on columns: strings, reports, chunks, text, and relations of what was removed."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from markloom.functions import expressions as E
from markloom.functions import render
from markloom.functions.policy import PRESETS, Builder, Policy

from .parse import arrow_column, attributes, nodes, parse_events, parser_of

REMOVED = "array<struct<kind:string,name:string,reason:string>>"
REPORT = f"struct<html:string,removed:{REMOVED}>"
CHUNK = 16_384


class Sanitizer:
    """A policy with a parser, compiled once. Column methods take and give columns; ``clean`` takes one string."""

    def __init__(self, policy: Policy | str = "none", parser: str | Callable | None = None):
        self.policy = PRESETS[policy] if isinstance(policy, str) else policy
        self.parser = parser

    @classmethod
    def builder(cls, base: Policy | str | Mapping | None = None) -> Builder:
        return Builder(cls, base)

    def _tree(self):  # noqa: ANN202
        return parser_of(self.parser)

    def clean(self, html: str) -> str:
        return "".join(render.sanitized(self._tree()(html), self.policy))

    def sanitize(self, html: Column) -> Column:
        """Sanitized HTML; null for null."""
        build, policy = self._tree(), self.policy
        return arrow_column(lambda s: "".join(render.sanitized(build(s), policy)), "string", html)

    trusted_html = sanitize  # a cluster has no DOM to hand wrapped values to

    def _report(self, root) -> dict:  # noqa: ANN001
        removed: list = []
        out = "".join(render.sanitized(root, self.policy, removed))
        return {"html": out, "removed": [dict(zip(("kind", "name", "reason"), r, strict=True)) for r in removed]}

    def report(self, html: Column) -> Column:
        """struct(html, removed): the same HTML, and what went in document order."""
        build = self._tree()
        return arrow_column(lambda s: self._report(build(s)), REPORT, html)

    def unsafe(self, html: Column) -> Column:
        """The same allow-list without the baseline."""
        return Sanitizer(self.policy.unsafe(), self.parser).sanitize(html)

    def chunks(self, html: Column, size: int = CHUNK) -> Column:
        """Array of pieces of the sanitized HTML, each of at least ``size`` UTF-16 units but the last."""
        build, policy = self._tree(), self.policy
        return arrow_column(lambda s: render.chunked(render.sanitized(build(s), policy), size), "array<string>", html)

    def text(self, html: Column) -> Column:
        """Text outside raw-text elements, unescaped; no policy applies."""
        build = self._tree()
        return arrow_column(lambda s: render.plain_text(build(s)), "string", html)

    def fragment(self, html: Column) -> Column:
        """What stays, as events: the structure without going through a string again."""
        policy = self.policy
        kept = sorted(policy.kept_tags())
        events = F.filter(parse_events(html, self.parser), lambda e: E.shown(e, policy) & ((e["kind"] == "text") | (e["kind"].isin("open", "close") & (e["name"].isin(*kept) if kept else F.lit(False)))))
        allowed = E.allowed_map(policy)

        def trimmed(e: Column) -> Column:
            stay = F.filter(e["attrs"], lambda a: F.coalesce(E.attribute_reason(a, allowed[e["name"]], policy), F.lit("")).isin("", "unsafe-css-declaration"))
            return e.withField("attrs", stay)

        return F.transform(events, trimmed)

    # on a stored events column, where a new policy parses nothing anew

    def sanitize_events(self, events: Column) -> Column:
        return E.sanitized_html(events, self.policy)

    def removed_events(self, events: Column) -> Column:
        return E.removals(events, self.policy)


def reports(html: Column, policies: Mapping[str, Policy | str], parser: str | Callable | None = None) -> Column:
    """Struct of the reports of several policies by name: one parse and one worker for all."""
    build, made = parser_of(parser), {name: Sanitizer(p, parser) for name, p in policies.items()}

    def run(s: str) -> dict:
        root = build(s)
        return {name: one._report(root) for name, one in made.items()}

    return arrow_column(run, "struct<" + ",".join(f"`{name}`:{REPORT}" for name in made) + ">", html)


def escape_text(c: Column) -> Column:
    return E.escape_text(c)


def escape_attribute(c: Column) -> Column:
    return E.escape_attribute(c)


def chunk_rows(df: DataFrame, sanitizer: Sanitizer, html: str = "html", keys: tuple[str, ...] = (), size: int = CHUNK) -> DataFrame:
    """One row per chunk: keys, ord, chunk. An empty result gives no chunk."""
    return df.select(*keys, F.posexplode(sanitizer.chunks(F.col(html), size)).alias("ord", "chunk"))


def removals(df: DataFrame, sanitizer: Sanitizer, html: str = "html", keys: tuple[str, ...] = ()) -> DataFrame:
    """One row per removal: keys, ord, kind, name, reason."""
    rows = df.select(*keys, F.posexplode(sanitizer.report(F.col(html))["removed"]).alias("ord", "r"))
    return rows.select(*keys, "ord", "r.kind", "r.name", "r.reason")


def policy_table(spark: SparkSession, policies: Mapping[str, Policy] | None = None) -> DataFrame:
    """(policy, tag, attr) relation; a tag without attributes has one row with null."""
    rows = [(name, tag, attr) for name, p in (policies or PRESETS).items() for tag, attr in p.rows()]
    return spark.createDataFrame(rows, "policy string, tag string, attr string")


def policy_union(table: DataFrame, *names: str) -> DataFrame:
    return table.where(F.col("policy").isin(*names)).select("tag", "attr").distinct()


def policy_deny(rules: DataFrame, denied: DataFrame) -> DataFrame:
    """Rules without denied tags; ``*`` stays unless it is denied by name."""
    return rules.join(denied, "tag", "left_anti")


def kept_attributes(df: DataFrame, table: DataFrame, name: str, *keys: str) -> DataFrame:
    """Attributes of ``df.events`` that a stored policy lists, by a join with its table; the planner broadcasts it if its size allows."""
    rules = table.where(F.col("policy") == name).where("attr is not null").select("tag", F.col("attr").alias("name"))
    rows = attributes(nodes(df, *keys).where("kind = 'open'"), *keys)
    own = rules.where("tag <> '*'").withColumn("_own", F.lit(True))
    star = rules.where("tag = '*'").select("name").distinct().withColumn("_star", F.lit(True))
    listed = table.where(F.col("policy") == name).where("tag <> '*'").select("tag").distinct()
    found = rows.join(listed, "tag", "left_semi").join(own, ["tag", "name"], "left").join(star, "name", "left")
    return found.where("_own or _star").drop("_own", "_star")


def elements_by_policy(df: DataFrame, table: DataFrame, name: str, *keys: str) -> DataFrame:
    """Elements of ``df.events`` with whether the policy lists their tag."""
    listed = table.where(F.col("policy") == name).where("tag <> '*'").select("tag").distinct().withColumn("listed", F.lit(True))
    rows = nodes(df, *keys).where("kind = 'open'").select(*keys, "seq", F.col("name").alias("tag"))
    return rows.join(listed, "tag", "left").withColumn("listed", F.coalesce("listed", F.lit(False)))
