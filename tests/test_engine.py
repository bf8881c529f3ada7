"""Catalogue against SQL, sources, streams, and the bounds between packages."""

from __future__ import annotations

import ast
from pathlib import Path

import duckdb
import pytest
from markloom.operators import sanitize as S
from markloom.plans import catalogue
from markloom.sources import files
from markloom.streaming import pages as streams
from pyspark.sql import functions as F

ROOT = Path(__file__).resolve().parent.parent
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_catalogue(spark, sql, name):
    got = catalogue.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    rows = [tuple(r) for r in got.select(*columns).collect()]
    if name in catalogue.ORACLE_SQL:
        expect = sql.execute(f"SELECT {', '.join(columns)} FROM ({catalogue.ORACLE_SQL[name]})").fetchall()
        assert sorted(map(repr, rows)) == sorted(map(repr, expect))


def test_html_files(spark, tmp_path):
    (tmp_path / "a.html").write_text("<p>é\r\nx")
    (tmp_path / "b.txt").write_text("no")
    rows = files.read_html_files(spark, str(tmp_path)).collect()
    assert [(Path(r["path"]).name, r["html"]) for r in rows] == [("a.html", "<p>é\r\nx")]
    assert files.read_text_files(spark, str(tmp_path / "a.html")).select(files.normalize_newlines(F.col("html"))).first()[0] == "<p>é\nx"
    out = str(tmp_path / "out")
    files.write_html(files.spread(spark.createDataFrame([(1, "<p>")], "id int, html string")), out)
    assert files.read_tables(spark, out).count() == 1
    with pytest.raises(ValueError):
        files.read_tables(spark, out, html="body")


def test_stream_equals_batch(spark, tmp_path):
    schema = spark.read.parquet(f"{SF}/pages.parquet").schema
    stream = streams.read_stream(spark, f"{SF}/pages.parquet*", schema)
    s = S.Sanitizer("ugc")
    got = streams.run_once(streams.sanitize_stream(stream, s).select("page_id", "html", "removed"), str(tmp_path))
    batch = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", s.report(F.col("html")).alias("r")).select("page_id", "r.html", "r.removed")
    assert got.exceptAll(batch).count() == 0 and got.count() == batch.count()


def test_removal_and_session_windows(spark, tmp_path):
    (tmp_path / "in").mkdir()
    rows = [("2024-01-01 00:01:00", "<script>a</script><p onclick=b>"), ("2024-01-01 00:02:00", "<script>"), ("2024-01-01 00:30:00", "<i>")]
    df = spark.createDataFrame(rows, "t string, html string").select(F.to_timestamp("t").alias("t"), "html")
    df.write.parquet(str(tmp_path / "in/x"))
    stream = streams.read_stream(spark, str(tmp_path / "in/x"), df.schema)
    made = streams.run_once(streams.removal_windows(stream, S.Sanitizer("none"), "t"), str(tmp_path), "complete")
    counts = {(r["window"]["start"].minute, r["kind"], r["reason"]): r["count"] for r in made.collect()}
    assert counts == {(0, "tag", "unsafe-element"): 2, (0, "tag", "not-allowed"): 1, (30, "tag", "not-allowed"): 1}
    sessions = streams.session_counts(stream.withColumn("k", F.lit(1)), "t", "k", "5 minutes")
    assert sorted(r["count"] for r in streams.run_once(sessions, str(tmp_path), "complete").collect()) == [1, 2]


def imports_of(path):
    for node in ast.walk(ast.parse(path.read_text())):
        if isinstance(node, ast.Import):
            yield from (a.name for a in node.names)
        elif isinstance(node, ast.ImportFrom):
            yield "." * node.level + (node.module or "")


def test_import_bounds():
    package = ROOT / "markloom"
    for path in package.rglob("*.py"):
        part = path.relative_to(package).parts[0]
        names = list(imports_of(path))
        if part != "llm":
            assert not any("llm" in n for n in names), path
        if path.name in ("lenient.py", "dialect.py", "srcset.py"):
            assert not any(n.split(".")[-1] in ("tree", "tokens", "policy", "render") for n in names), path


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns == ["page_id", "html", "n_removed"] and df.count() == 50
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_update_mode_keeps_the_last_result_of_every_window(spark, tmp_path):
    from markloom.streaming import pages as streams

    for k in range(3):
        rows = [(f"2024-01-01 0{k}:00:00", "a"), (f"2024-01-01 0{max(0, k - 1)}:10:00", "a")]
        spark.createDataFrame(rows, "t string, k string").selectExpr("cast(t as timestamp) t", "k").write.parquet(f"{tmp_path}/in/{k}")
    counts = {}
    for mode in ("update", "complete"):
        stream = streams.read_stream(spark, f"{tmp_path}/in/*", "t timestamp, k string", files_per_trigger=1)
        out = streams.run_once(streams.sliding_counts(stream, "t", "k", "1 hour", late="1 day"), str(tmp_path / mode), mode)
        counts[mode] = sorted((r["window"]["start"].hour, r["count"]) for r in out.collect())
    assert counts["update"] == counts["complete"] and [n for _, n in counts["update"]] == [3, 2, 1]


def test_walk_without_keys_keeps_documents_apart(spark):
    import pytest as _pytest
    from markloom.operators import query as Q
    from markloom.operators.parse import with_events

    df = spark.createDataFrame([("<nav>a</nav><p>b",), ("<nav>c</nav><p>d",)], "html string").coalesce(1)
    skip = Q.F.coalesce(Q.F.col("name") == "nav", Q.F.lit(False))
    one = Q.walk(with_events(df.limit(1)), skip=skip).count()
    rows = Q.walk(with_events(df), skip=skip)
    assert rows.count() == 2 * one and rows.select("doc").distinct().count() == 2
    with _pytest.raises(ValueError):
        Q.descendants(rows, rows)


@pytest.mark.parametrize(("length", "most"), [(1, 1000), (20_000, 14)])
def test_a_worker_holds_results_of_a_piece_only(spark, length, most):
    from markloom.operators.parse import arrow_column

    class Held(str):
        alive = 0

        def __del__(self):
            Held.alive -= 1

    def run(s):
        Held.alive += 1
        return Held(f"{Held.alive} {s[-5:].strip()}")

    rows, text = 6000 if length == 1 else 2000, F.lpad(F.col("id").cast("string"), max(5, length), " ")
    df = spark.range(0, rows, 1, 1).select("id", F.when(F.col("id") % 7 != 0, text).alias("html"))
    out = df.select("id", arrow_column(run, "string", F.col("html")).alias("r")).collect()
    assert [r["id"] for r in out] == list(range(rows))
    assert all(r["r"] is None if r["id"] % 7 == 0 else int(r["r"].split()[1]) == r["id"] for r in out)
    assert max(int(r["r"].split()[0]) for r in out if r["r"]) <= most


def test_reports_of_several_policies(spark):
    html = '<div onclick=a><script>x</script><a href="javascript:b" title=t>c</a><p style="color:red">d'
    df = spark.createDataFrame([(html,), (None,), ("",)], "html string")
    names = ("none", "basic", "ugc")
    one = df.select("html", *[S.Sanitizer(n).report(F.col("html")).alias(n) for n in names])
    both = df.select("html", S.reports(F.col("html"), {n: n for n in names}).alias("r")).select("html", *[f"r.{n}" for n in names])
    assert sorted(map(repr, both.collect())) == sorted(map(repr, one.collect()))
    assert df.limit(0).select(S.reports(F.col("html"), {"none": "none"}).alias("r")).collect() == []
