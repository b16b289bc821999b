"""The registered queries of this subpackage and, where SQL can express one, its SQL.

Each query applies one operator to its whole table and derives the digest
columns from the operator's own result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, exact_dedup, html_density, line_dedup, ngram_join, packing, quality_crf, secret_ledger, sstable, substring_dedup


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similarity_components(spark, table(spark, sf_dir, "documents"), n=3, percent=90)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_crf.quality(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_density.extract_pages(table(spark, sf_dir, "pages"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(spark, table(spark, sf_dir, "documents"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digest(line_dedup.line_dedup(spark, table(spark, sf_dir, "documents")))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(spark, table(spark, sf_dir, "documents"))


def op8_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sstable.token_shards(spark, table(spark, sf_dir, "documents"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_ledger.digest(secret_ledger.secret_scan(spark, table(spark, sf_dir, "documents")))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digest(substring_dedup.substring_dedup(spark, table(spark, sf_dir, "documents")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_ngram_join": op1_ngram_join,
        "op2_quality": op2_quality,
        "op3_html_text": op3_html_text,
        "op4_exact_dedup": op4_exact_dedup,
        "op5_decontaminate": op5_decontaminate,
        "op6_line_dedup": op6_line_dedup,
        "op7_packing": op7_packing,
        "op8_token_shards": op8_token_shards,
        "op9_substring_dedup": op9_substring_dedup,
        "op10_secret_scan": op10_secret_scan,
    }


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"

_OP1 = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(_LOWER)} AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, g FROM (
  SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN []::VARCHAR[] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) END) AS g FROM w)),
n AS (SELECT w.doc_id, count(g) AS n FROM w LEFT JOIN s USING (doc_id) GROUP BY 1),
met AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS same FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM met JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * same >= 90 * (x.n + y.n - same)),
reached AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reached r JOIN links l ON r.b = l.a)
SELECT n.doc_id, n.n AS n_shingles, least(n.doc_id, coalesce(min(r.b), n.doc_id)) AS component_id
FROM n LEFT JOIN reached r ON n.doc_id = r.a GROUP BY n.doc_id, n.n
"""

_OP4 = f"""
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = max(doc_id) OVER same AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, {_LOWER} AS t FROM documents) WINDOW same AS (PARTITION BY t)
"""

_OP9 = f"""
WITH w AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS ws FROM documents),
p AS (SELECT doc_id, ws, unnest(range(0, greatest(len(ws) - 19, 0))) AS s FROM w),
k AS (SELECT doc_id, s, row_number() OVER (PARTITION BY array_to_string(ws[s + 1 : s + 20], ' ') ORDER BY doc_id, s) AS r FROM p),
gone AS (SELECT DISTINCT doc_id, s + unnest(range(0, 20)) AS i FROM k WHERE r > 1),
x AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS i FROM w),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS t FROM x ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""


def _op10() -> str:
    """Positions are running sums over the pieces between the matches, as in the operator, but by list functions."""
    parts = []
    for rank, rule in enumerate(secret_ledger.RULES):
        pattern = rule.pattern.replace("'", "''")
        parts.append(
            f"SELECT doc_id, '{rule.kind}' AS kind, {rank} AS rank, {rule.least} AS least, string_split_regex(t, '{pattern}') AS gaps, "
            f"regexp_extract_all(t, '{pattern}', 0) AS ms, regexp_extract_all(t, '{pattern}', {rule.group}) AS gs FROM d"
        )
    base = ", ".join(f"'{r.kind}'" for r in secret_ledger.RULES if r.base)
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS ({" UNION ALL ".join(parts)}),
e AS (SELECT *, unnest(range(1, len(ms) + 1)) AS k FROM m),
s AS (SELECT doc_id, kind, rank, list_sum(list_transform(gaps[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:k - 1], lambda x: length(x))), 0) AS a, length(ms[k]) AS l
  FROM e WHERE length(gs[k]) >= least),
f AS (SELECT doc_id, kind, rank, a, kind || ':' || a::BIGINT || ':' || (a + l)::BIGINT AS span FROM s)
SELECT d.doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  sha256(coalesce(string_agg(span, ',' ORDER BY a, rank) FILTER (kind IN ({base})), '')) AS base_sha256,
  coalesce(string_agg(span, ',' ORDER BY a, rank), '') AS spans
FROM d LEFT JOIN f USING (doc_id) GROUP BY d.doc_id
"""


def oracle_sql() -> dict[str, str]:
    """SQL of the queries that SQL can express; tests hold the others against plain versions."""
    return {"op1_ngram_join": _OP1, "op4_exact_dedup": _OP4, "op9_substring_dedup": _OP9, "op10_secret_scan": _op10()}
