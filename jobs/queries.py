"""The jobs as registered queries: each runs twice into one new folder and gives its output as it stands then, with DuckDB SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from jobs import source_worklist, verdict_ledger
from runledger.sources.shared import new_folder


def job1_verdict_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "verdict-ledger")
    for _ in range(2):
        verdict_ledger.run(spark, f"{sf_dir}/events*.parquet", f"{folder}/out", f"{folder}/checkpoint")
    return verdict_ledger.ledger(spark, f"{folder}/out").drop("folded")


def job2_source_worklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "source-worklist")
    for _ in range(2):
        source_worklist.run(spark, f"{sf_dir}/documents.parquet", f"{sf_dir}/labels.parquet", f"{sf_dir}/benchmark.parquet", folder)
    return source_worklist.listing(spark, folder)


QUERIES = {f.__name__: f for f in (job1_verdict_ledger, job2_source_worklist)}

ORACLES = {
    "job1_verdict_ledger": """
        WITH t AS (SELECT CAST(ts AS DATE) AS day, user_id AS unit, ts, event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
                          CASE event_type WHEN 'purchase' THEN 'verified' WHEN 'error' THEN 'error' WHEN 'signup' THEN 'violated' WHEN 'click' THEN 'unknown' WHEN 'view' THEN 'needs_contract' END AS verdict FROM events),
        c AS (SELECT day, unit, count(*) AS n_runs, count(*) FILTER (WHERE verdict IS NULL OR verdict NOT IN ('verified', 'needs_contract')) AS n_failures,
                     count(*) FILTER (WHERE verdict = 'needs_contract') AS n_needs_contract FROM t GROUP BY day, unit),
        l AS (SELECT day, unit, verdict, k FROM t QUALIFY row_number() OVER (PARTITION BY day, unit ORDER BY ts DESC NULLS LAST, event_id DESC NULLS LAST, verdict DESC NULLS LAST, k DESC NULLS LAST) = 1)
        SELECT c.*, l.verdict, l.k, CASE WHEN n_failures > 0 THEN 'block' ELSE 'pass' END AS decision, CASE WHEN n_failures > 0 THEN 2 ELSE 0 END AS exit_code
        FROM c JOIN l ON c.day IS NOT DISTINCT FROM l.day AND c.unit IS NOT DISTINCT FROM l.unit""",
    "job2_source_worklist": r"""
        WITH f AS (SELECT doc_id AS id, source AS "group", sha256(text) AS digest, length(text) AS n_chars, count(*) AS n_rows,
                          len(regexp_extract_all(text, '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]')) + CASE WHEN text <> '' AND NOT regexp_matches(text, '[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]\z') THEN 1 ELSE 0 END AS n_lines,
                          coalesce(source, 'none') || '::' || coalesce(CAST(doc_id AS VARCHAR), 'none') AS unit FROM documents GROUP BY ALL),
        s AS (SELECT doc_id AS id, bool_or(coalesce(toxic = 1, false)) AS begun, CASE WHEN min(quality) FILTER (WHERE quality IN (0, 1)) = 0 THEN 'violated' WHEN min(quality) FILTER (WHERE quality IN (0, 1)) = 1 THEN 'verified' END AS own FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
        r AS (SELECT f.*, coalesce(begun, false) AS begun, own FROM f LEFT JOIN s USING (id)),
        n AS (SELECT *, CASE WHEN digest IS NULL THEN 0 ELSE sum(n_rows) OVER d END AS n_all, CASE WHEN digest IS NULL THEN NULL ELSE min(own) OVER d END AS one, CASE WHEN digest IS NULL THEN NULL ELSE max(own) OVER d END AS other,
                     row_number() OVER (PARTITION BY digest, own IS NULL ORDER BY id NULLS LAST, "group" NULLS LAST) AS place,
                     first_value(id) OVER (PARTITION BY digest, own IS NULL ORDER BY id NULLS LAST, "group" NULLS LAST) AS first_id FROM r WINDOW d AS (PARTITION BY digest)),
        j AS (SELECT *, CASE WHEN digest IS NULL THEN 'unreadable' WHEN own IS NOT NULL THEN own WHEN one IS NOT NULL THEN 'reused' WHEN digest IN (SELECT sha256(text) FROM benchmark WHERE text IS NOT NULL) THEN 'baseline'
                     WHEN place = 1 AND begun THEN 'retry' WHEN place = 1 THEN 'verify' ELSE 'waits' END AS status FROM n)
        SELECT id, replace(replace(unit, '::', '__'), '/', '_') || '-' || substr(sha256(unit), 1, 12) AS slug, digest, n_rows, n_lines, n_chars, coalesce(own, CASE WHEN other = 'violated' THEN other ELSE one END) AS verdict,
               CAST(n_all AS BIGINT) AS n_sources, CASE WHEN status IN ('retry', 'verify', 'waits') THEN first_id END AS lead, status IN ('retry', 'verify') AS work, "group", status FROM j""",
}
