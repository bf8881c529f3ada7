"""The queries of the training-data operators: whole tables, production parameters, full results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, exact_dedup, langid, line_dedup, mixing, packing, repeats, secret_scan, simhash, url_rules
from .common import UPPER, read


def vocabulary_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(read(spark, sf_dir, "documents"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.drop_lines(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken", "copies")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), vocabulary_path())


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.held_out_predictions(read(spark, sf_dir, "documents"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_groups(read(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op7_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeats.cut_repeats(read(spark, sf_dir, "documents"), with_kept=False)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    out = secret_scan.find_secrets(docs, secret_scan.train(docs))
    return out.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"), "spans")


def op9_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(read(spark, sf_dir, "embeddings"))


URL_RULES = (
    ("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"),
)


def op10_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = url_rules.judge(read(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES)
    return out.select("page_id", "host", "path", "rule", "verdict")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_exact_dedup, op2_line_dedup, op3_mixing, op4_packing, op5_language, op6_simhash, op7_repeated_bytes,
        op8_secret_scan, op9_permutation_index, op10_url_rules,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op1_exact_dedup": f"""
        WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}')) AS h FROM documents)
        SELECT doc_id, max(doc_id) OVER (PARTITION BY h) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
               row_number() OVER (PARTITION BY h ORDER BY doc_id DESC) = 1 AS kept, h AS text_sha256
        FROM d""",
    "op2_line_dedup": f"""
        WITH d AS (SELECT doc_id, coalesce(source, '') AS site, string_split(text, chr(10)) AS lines FROM documents),
        l AS (SELECT site, trim(unnest(lines), ' ' || chr(9) || chr(13)) AS line FROM d),
        b AS (SELECT line FROM l WHERE length(line) >= {line_dedup.MIN_CHARS} GROUP BY line
              HAVING count(DISTINCT site) >= {line_dedup.MIN_SITES}),
        p AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM d),
        k AS (SELECT p.doc_id, p.pos, p.line, b.line IS NOT NULL AS gone
              FROM p LEFT JOIN b ON trim(p.line, ' ' || chr(9) || chr(13)) = b.line),
        g AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed,
                     coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS kept
              FROM k GROUP BY doc_id)
        SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed,
               sha256(coalesce(kept, '')) AS kept_sha256
        FROM d LEFT JOIN g USING (doc_id)""",
    # brute force: every query against every row; tables without null components
    "op9_permutation_index": """
        WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0),
        u AS (SELECT * FROM v WHERE isfinite(list_inner_product(e, e)) AND list_inner_product(e, e) > 0),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e) AS score
              FROM u q JOIN u c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)),
        r AS (SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20""",
    "op10_url_rules": """
        WITH r(rule, host_rule, path_rule, verdict) AS (VALUES
            ('com/en/', 'com', '/en/', 'block'), ('example.com/en/7', 'example.com', '/en/7', 'allow'),
            ('net/de/', 'net', '/de/', 'block'), ('example.net/de/8', 'example.net', '/de/8', 'block'),
            ('org/es/', 'org', '/es/', 'block')),
        s AS (SELECT page_id, url, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
              FROM pages),
        p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                     'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM s),
        m AS (SELECT page_id, max_by(rule, length(rule)) AS rule, max_by(verdict, length(rule)) AS verdict
              FROM p JOIN r ON (p.host = host_rule OR ends_with(p.host, '.' || host_rule)) AND starts_with(p.path, path_rule)
              GROUP BY page_id)
        SELECT p.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM p LEFT JOIN m USING (page_id)""",
}
