"""The queries of the HTML operators over the test tables, and the SQL that says the same where SQL can."""

from __future__ import annotations

import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from markloom.functions import expressions as E
from markloom.functions.policy import PRESETS
from markloom.operators import query as Q
from markloom.operators import sanitize as S
from markloom.operators.legacy import legacy_sanitize
from markloom.operators.parse import attributes, lenient_events, nodes, tokenize, with_events
from markloom.plans import dirty
from markloom.streaming import pages as streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages dealt out over the cores, since the files may be few; ids and markup only."""
    df = table(spark, sf_dir, "pages").select("page_id", "html")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def shared_folder(spark: SparkSession) -> str:
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return path or "file://" + tempfile.mkdtemp(prefix="markloom-")


_SCHEME = "lower(regexp_extract(u, '^([A-Za-z0-9+.-]+):', 1))"
_STRIPPED = """
    SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html, '(?s)<script>.*?</script>', '', 'g'),
           '(?s)<style>.*?</style>', '', 'g'), '(?s)<!--.*?-->', '', 'g') AS h FROM pages"""


def _decoded(x: str) -> str:
    for name, value in (("&quot;", "'\"'"), ("&copy;", "chr(169)"), ("&middot;", "chr(183)"), ("&lt;", "'<'"), ("&gt;", "'>'"), ("&amp;", "'&'")):
        x = f"replace({x}, '{name}', {value})"
    return x


def _escaped(x: str) -> str:
    return f"replace(replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(160), '&nbsp;')"


@query(f"SELECT doc_id, {_escaped('text')} AS escaped FROM documents")
def escape_text_documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", S.escape_text(F.col("text")).alias("escaped"))


@query("SELECT doc_id, replace(replace(replace(text, '&', '&amp;'), '\"', '&quot;'), chr(160), '&nbsp;') AS escaped FROM documents")
def escape_attr_documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", S.escape_attribute(F.col("text")).alias("escaped"))


_URLS = """
    SELECT page_id, unnest([url, 'javascript:' || url, 'data:text/html,' || url, 'data:image/png,' || url, 'VBScript:' || url, '/x/' || url])
           AS u FROM pages"""


def _urls(spark, sf_dir):
    u = F.col("url")
    made = F.array(u, *[F.concat(F.lit(p), u) for p in ("javascript:", "data:text/html,", "data:image/png,", "VBScript:", "/x/")])
    return table(spark, sf_dir, "pages").select("page_id", F.explode(made).alias("u"))


@query(
    f"""SELECT page_id, u, {_SCHEME} IN ('javascript', 'vbscript')
        OR ({_SCHEME} = 'data' AND lower(substr(u, 1, 11)) <> 'data:image/') AS dangerous FROM ({_URLS})"""
)
def dangerous_url_pages(spark, sf_dir):
    return _urls(spark, sf_dir).withColumn("dangerous", E.dangerous_url(F.col("u")))


@query(
    f"""SELECT page_id, u, CASE WHEN regexp_extract(u, '^([a-zA-Z][a-zA-Z0-9.+-]*):', 1) <> ''
        THEN lower(regexp_extract(u, '^([a-zA-Z][a-zA-Z0-9.+-]*):', 1)) NOT IN ('http', 'https', 'ftp', 'mailto', 'tel')
        ELSE false END AS harmful FROM ({_URLS})"""
)
def legacy_scheme_pages(spark, sf_dir):
    return _urls(spark, sf_dir).withColumn("harmful", E.harmful_scheme(F.col("u")))


@query(
    f"""WITH m AS (SELECT page_id, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS l FROM pages)
        SELECT page_id, (unnest(range(len(l))))::INT AS ord, {_decoded('unnest(l)')} AS href FROM m"""
)
def find_all_links(spark, sf_dir):
    return Q.links(pages(spark, sf_dir), keys=("page_id",))


@query(f"SELECT page_id, {_decoded('''regexp_extract(html, '<title>([^<]*)</title>', 1)''')} AS title FROM pages WHERE html LIKE '%<title>%'")
def find_title(spark, sf_dir):
    return Q.find(pages(spark, sf_dir), "title", keys=("page_id",)).select("page_id", F.col("text").alias("title"))


@query("SELECT page_id, regexp_extract(html, '<a href=\"([^\"]*)\"', 1) AS href FROM pages WHERE html LIKE '%<a href=%'")
def find_first_window(spark, sf_dir):
    """The first link of a page by a window over stored nodes."""
    from pyspark.sql import Window

    rows = nodes(with_events(pages(spark, sf_dir)), "page_id").where("kind = 'open' and name = 'a'")
    first = rows.withColumn("rn", F.row_number().over(Window.partitionBy("page_id").orderBy("seq"))).where("rn = 1")
    return first.select("page_id", Q.attribute(F.col("attrs"), "href").alias("href"))


@query(f"SELECT page_id, {_decoded('''regexp_replace(h, '<[^>]*(>|$)', '', 'g')''')} AS text FROM ({_STRIPPED})")
def to_text_pages(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", S.Sanitizer("none").text(F.col("html")).alias("text"))


@query(f"SELECT page_id, {_decoded('''regexp_replace(h, '<[^>]*(>|$)', '', 'g')''')} AS text FROM ({_STRIPPED})")
def to_text_events(spark, sf_dir):
    """The same by expressions over stored events."""
    return with_events(pages(spark, sf_dir)).select("page_id", E.visible_text(F.col("events")).alias("text"))


_NO_TITLE = f"SELECT page_id, regexp_replace(h, '(?s)<title>.*?</title>', '', 'g') AS h FROM ({_STRIPPED})"


@query(f"SELECT page_id, {_escaped(_decoded('''regexp_replace(h, '<[^>]*(>|$)', '', 'g')'''))} AS html FROM ({_NO_TITLE})")
def sanitize_none_pages(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", S.Sanitizer("none").sanitize(F.col("html")).alias("html"))


@query()
def removal_counts_none(spark, sf_dir):
    """All removals by name and reason; implied and renewed elements are beyond SQL, tests count them one by one."""
    rows = S.removals(pages(spark, sf_dir), S.Sanitizer("none"), keys=("page_id",))
    return rows.groupBy("name", "reason").agg(F.count(F.lit(1)).alias("n"))


@query()
def removals_rollup(spark, sf_dir):
    rows = with_events(pages(spark, sf_dir)).select(F.inline(S.Sanitizer("none").removed_events(F.col("events"))))
    return rows.rollup("reason", "name").agg(F.count(F.lit(1)).alias("n"))


_RULES = "SELECT * FROM (VALUES " + ", ".join(
    f"('{name}', '{tag}', {'NULL' if attr is None else repr(attr)})" for name, p in PRESETS.items() for tag, attr in p.rows()
) + ") AS r(policy, tag, attr)"


@query("SELECT * FROM (" + _RULES + ")")
def preset_tags(spark, sf_dir):
    return S.policy_table(spark)


@query(f"SELECT DISTINCT tag, attr FROM ({_RULES}) WHERE policy IN ('basic', 'markdown')")
def policy_union(spark, sf_dir):
    return S.policy_union(S.policy_table(spark), "basic", "markdown")


@query(f"SELECT DISTINCT tag, attr FROM ({_RULES}) WHERE policy = 'ugc' AND tag NOT IN ('img', 'a')")
def policy_deny(spark, sf_dir):
    denied = spark.createDataFrame([("img",), ("a",)], "tag string")
    return S.policy_deny(S.policy_union(S.policy_table(spark), "ugc"), denied)


@query(
    """SELECT t.tag, t.tag IN ('a', 'br', 'li', 'ul') AS listed, sum(len(regexp_extract_all(html, '<' || t.tag || '[ >]')))::BIGINT AS n
       FROM pages, (SELECT unnest(['a', 'article', 'br', 'div', 'footer', 'h1', 'li', 'nav', 'ul']) AS tag) t GROUP BY ALL"""
)
def allow_list_broadcast_join(spark, sf_dir):
    df = with_events(pages(spark, sf_dir))
    rows = S.elements_by_policy(df, S.policy_table(spark), "basic", "page_id")
    named = rows.where(F.col("tag").isin("a", "article", "br", "div", "footer", "h1", "li", "nav", "ul"))
    return named.groupBy("tag", "listed").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT page_id, len(regexp_extract_all(html, '<a href='))::BIGINT AS n FROM pages WHERE html LIKE '%<a href=%'")
def kept_attributes_join(spark, sf_dir):
    kept = S.kept_attributes(with_events(pages(spark, sf_dir)), S.policy_table(spark), "basic", "page_id")
    return kept.groupBy("page_id").agg(F.count(F.lit(1)).alias("n"))


@query(
    """SELECT page_id, len(regexp_extract_all(regexp_extract(html, '(?s)<nav>(.*?)(</nav>|$)', 1), '<a href='))::BIGINT AS n
       FROM pages WHERE html LIKE '%<nav>%<a href=%'"""
)
def descendants_of_nav(spark, sf_dir):
    """Links inside the navigation by interval containment."""
    rows = nodes(with_events(pages(spark, sf_dir)), "page_id").where("kind = 'open' and name in ('nav', 'a')")
    pairs = Q.descendants(rows.where("name = 'a'"), rows.where("name = 'nav'"), "page_id")
    return pairs.groupBy("page_id").agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""SELECT page_id, {_decoded("regexp_replace(regexp_replace(h, '(?s)<nav>.*?</nav>', '', 'g'), '<[^>]*(>|$)', '', 'g')")} AS text
        FROM ({_STRIPPED}) WHERE page_id IN (SELECT page_id FROM pages WHERE html LIKE '%</nav>%')"""
)
def walk_without_nav(spark, sf_dir):
    """Text of the nodes that a walk meets which skips navigation, scripts and styles."""
    df = with_events(pages(spark, sf_dir).where(F.contains("html", F.lit("</nav>"))))
    met = Q.walk(df, "page_id", skip=F.coalesce(F.col("name").isin("nav", "script", "style"), F.lit(False)))
    return Q.text_by_document(met, "page_id")


@query(
    f"""SELECT href, n FROM (SELECT href, count(*) AS n FROM (SELECT {_decoded('unnest(l)')} AS href FROM (
            SELECT regexp_extract_all(html, '<a href="([^"]*)"', 1) AS l FROM pages)) GROUP BY href) ORDER BY n DESC, href LIMIT 10"""
)
def top_links(spark, sf_dir):
    """The ten links that most anchors have: counted in parts, then each task's ten and ten of those."""
    counted = Q.links(pages(spark, sf_dir), keys=("page_id",)).groupBy("href").agg(F.count(F.lit(1)).alias("n"))
    return counted.orderBy(F.desc("n"), "href").limit(10)


@query(
    f"""SELECT page_id, {_decoded("regexp_extract(html, '<title>([^<]*)</title>', 1)")} AS text FROM pages WHERE html LIKE '%<title>%'
        INTERSECT SELECT page_id, {_decoded("regexp_extract(html, '<h1>([^<]*)</h1>', 1)")} FROM pages WHERE html LIKE '%<h1>%'"""
)
def titles_as_headings(spark, sf_dir):
    """Titles that stand as a first heading too."""
    df = pages(spark, sf_dir)
    first = lambda tag: Q.find(df, tag, keys=("page_id",)).select("page_id", "text")
    return first("title").intersect(first("h1"))


@query(
    f"""SELECT round(exp(avg(ln(length(text)::DOUBLE / length(html)))), 6) AS share, count(*) AS n FROM (
        SELECT html, {_decoded("regexp_replace(h, '<[^>]*(>|$)', '', 'g')")} AS text
        FROM (SELECT page_id, h FROM ({_STRIPPED})) JOIN pages USING (page_id)) WHERE length(text) > 0"""
)
def text_share_geomean(spark, sf_dir):
    """Geometric mean of the share that text has in markup, over pages with text."""
    sized = pages(spark, sf_dir).select(F.length("html").alias("m"), F.length(S.Sanitizer("none").text(F.col("html"))).alias("t"))
    return sized.where("t > 0").agg(F.round(F.exp(F.avg(F.ln(F.col("t") / F.col("m")))), 6).alias("share"), F.count(F.lit(1)).alias("n"))


@query("SELECT page_id, true AS agree FROM pages")
def sanitize_shapes_agree(spark, sf_dir):
    """The Python path and the expressions over events give the same HTML and removals, preset by preset."""
    df = with_events(pages(spark, sf_dir)).withColumn("reports", S.reports(F.col("html"), PRESETS))
    same = F.lit(True)
    for name in sorted(PRESETS):
        s = S.Sanitizer(name)
        both = F.col("reports")[name]
        same = same & (both["html"] == s.sanitize_events(F.col("events"))) & (both["removed"] == s.removed_events(F.col("events")))
    return df.select("page_id", same.alias("agree"))


@query("SELECT page_id, true AS agree FROM pages")
def chunks_rejoin(spark, sf_dir):
    s = S.Sanitizer("ugc")
    return pages(spark, sf_dir).select(
        "page_id", (F.array_join(s.chunks(F.col("html"), 512), "") == s.sanitize(F.col("html"))).alias("agree")
    )


@query()
def sanitize_basic(spark, sf_dir):
    made = pages(spark, sf_dir).select("page_id", S.Sanitizer("basic").report(F.col("html")).alias("r"))
    return made.select("page_id", "r.html", F.size("r.removed").alias("n_removed"))


@query()
def sanitize_report(spark, sf_dir):
    return S.removals(pages(spark, sf_dir), S.Sanitizer("ugc"), keys=("page_id",))


@query()
def sanitize_unsafe(spark, sf_dir):
    loose = S.Sanitizer.builder("ugc").allow("script").allow("style").build()
    return pages(spark, sf_dir).select("page_id", loose.unsafe(F.col("html")).alias("html"))


@query()
def sanitize_fragment(spark, sf_dir):
    kept = pages(spark, sf_dir).select("page_id", F.posexplode(S.Sanitizer("markdown").fragment(F.col("html"))).alias("ord", "e"))
    return kept.select("page_id", "ord", "e.kind", "e.name", "e.value")


@query()
def sanitize_chunks(spark, sf_dir):
    return S.chunk_rows(pages(spark, sf_dir), S.Sanitizer("basic"), keys=("page_id",), size=1024)


@query()
def serialize_pages(spark, sf_dir):
    return with_events(pages(spark, sf_dir)).select("page_id", Q.serialize(F.col("events")).alias("html"))


@query()
def nodes_pages(spark, sf_dir):
    return nodes(with_events(pages(spark, sf_dir)), "page_id").drop("attrs")


@query()
def attributes_pages(spark, sf_dir):
    return attributes(nodes(with_events(pages(spark, sf_dir)), "page_id").where("kind = 'open'"), "page_id").drop("style_decls")


@query("SELECT page_id, len(regexp_extract_all(html, '<!DOCTYPE'))::BIGINT AS doctypes, len(regexp_extract_all(html, '<li>'))::BIGINT AS items FROM pages")
def tokens_pages(spark, sf_dir):
    made = pages(spark, sf_dir).select("page_id", tokenize(F.col("html")).alias("t"))
    return made.select(
        "page_id",
        F.size(F.filter("t", lambda t: t["kind"] == "doctype")).cast("long").alias("doctypes"),
        F.size(F.filter("t", lambda t: (t["kind"] == "start_tag") & (t["name"] == "li"))).cast("long").alias("items"),
    )


@query()
def legacy_sanitize_pages(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", legacy_sanitize(F.col("html")).alias("html"))


@query()
def legacy_escape_pages(spark, sf_dir):
    given = {"allowed_tags": ["p", "b", "a"], "disallowed_tags_mode": "escape"}
    return pages(spark, sf_dir).select("page_id", legacy_sanitize(F.col("html"), given).alias("html"))


@query("SELECT page_id, len(regexp_extract_all(html, '<li>'))::BIGINT AS items FROM pages")
def legacy_events_pages(spark, sf_dir):
    made = pages(spark, sf_dir).select("page_id", lenient_events(F.col("html")).alias("e"))
    return made.select("page_id", F.size(F.filter("e", lambda e: (e["kind"] == "open") & (e["name"] == "li"))).cast("long").alias("items"))


@query()
def dialects_differ(spark, sf_dir):
    """Pages on which the two dialects, with one allow-list, disagree."""
    tags = sorted(PRESETS["basic"].tags)
    given = {"allowed_tags": tags, "allowed_attributes": {"a": ["href", "title"]}, "self_closing": []}
    base = pages(spark, sf_dir)
    strict = base.select("page_id", S.Sanitizer("basic").sanitize(F.col("html")).alias("html"))
    return strict.exceptAll(base.select("page_id", legacy_sanitize(F.col("html"), given).alias("html")))


@query("SELECT conv_id, string_agg(" + _escaped("text") + ", chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id")
def conversations_clean(spark, sf_dir):
    """Turns escaped and joined in order."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", S.escape_text(F.col("text")).alias("t"))
    ordered = F.array_sort(F.collect_list(F.struct("turn", "t")))
    return rows.groupBy("conv_id").agg(F.array_join(F.transform(ordered, lambda x: x["t"]), "\n").alias("text"))


@query(f"SELECT page_id, {_escaped(_decoded('''regexp_replace(h, '<[^>]*(>|$)', '', 'g')'''))} AS html FROM ({_NO_TITLE})")
def stream_sanitize_none(spark, sf_dir):
    """The sanitizer under Structured Streaming."""
    path = f"{sf_dir}/pages.parquet*"
    stream = streams.read_stream(spark, path, table(spark, sf_dir, "pages").schema)
    made = streams.sanitize_stream(stream, S.Sanitizer("none")).select("page_id", "html")
    return streams.run_once(made, shared_folder(spark))


@query(
    """SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS count FROM events GROUP BY ALL"""
)
def stream_event_windows(spark, sf_dir):
    stream = streams.read_stream(spark, f"{sf_dir}/events.parquet*", table(spark, sf_dir, "events").schema).withColumn("ts", F.col("ts").cast("timestamp"))
    made = streams.run_once(streams.sliding_counts(stream, "ts", "event_type", "1 hour"), shared_folder(spark), "complete")
    return made.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "count")


QUERIES |= dirty.QUERIES
ORACLE_SQL |= dirty.ORACLE_SQL
