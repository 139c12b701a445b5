"""Queries on what is published, logged and counted after verdicts, each with its DuckDB twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corrobora.operators import benchmark as B
from corrobora.operators import enrichment as N
from corrobora.plans import adapters as A
from corrobora.sources.files import ordered_checksum

THRESHOLDS = [0, 50, 80, 95]


def _findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.raw_results(spark, sf_dir).select("pos", F.col("predicted_verdict").alias("verdict"), "confidence", "reason_type", F.col("ts").alias("fetched_at"))


def publication_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings fit to be shown, with their priority and the day their source is to be fetched anew."""
    return B.with_expiry(B.publishable(_findings(spark, sf_dir))).select("pos", "priority", F.to_date("expires_at").alias("expires_on"))


GATE_SQL = f"""WITH {A.RAW_SQL} SELECT pos, CASE WHEN reason_type = 'contradiction' THEN 1 ELSE 2 END AS priority, CAST(ts + INTERVAL 90 DAY AS DATE) AS expires_on
FROM raw_results WHERE predicted_verdict = 'Not supported' AND confidence >= 80"""


def contradictions_published(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same gate where contradictions alone may pass."""
    return B.publishable(_findings(spark, sf_dir), 50, contradictions_only=True).select("pos", "confidence", "priority")


CONTRADICTIONS_SQL = f"""WITH {A.RAW_SQL} SELECT pos, confidence, 1 AS priority FROM raw_results
WHERE predicted_verdict = 'Not supported' AND confidence >= 50 AND reason_type = 'contradiction'"""


def flag_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.flag_precision(A.results(spark, sf_dir), THRESHOLDS)


FLAG_SQL = f"""WITH {A.RESULTS_SQL},
r AS (SELECT provider, predicted_verdict = 'Not supported' AS said, ground_truth = 'Not supported' AS bad, coalesce(confidence, 0) AS confidence FROM results WHERE coalesce(error, '') = ''),
s AS (SELECT provider, threshold, count(*) FILTER (WHERE said AND confidence >= threshold) AS flagged, count(*) FILTER (WHERE said AND bad AND confidence >= threshold) AS n, count(*) FILTER (WHERE bad) AS positive
  FROM r CROSS JOIN (SELECT unnest({THRESHOLDS})::INTEGER AS threshold) GROUP BY provider, threshold)
SELECT provider, threshold, flagged, n AS "right", coalesce(n / nullif(flagged, 0), 0.0)::DOUBLE AS precision, coalesce(n / nullif(positive, 0), 0.0)::DOUBLE AS recall FROM s"""


def extraction_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as citations: every fourth one's source could not be had, every fifth one has no address."""
    k = F.col("page_id")
    cited = A.table(spark, sf_dir, "pages").select(
        F.when(k % 5 != 0, F.regexp_extract("url", "^([^?#]*)", 1)).alias("url"), (k % 3).cast("int").alias("page_num"),
        F.when(k % 4 != 0, F.col("html")).alias("content"), F.when(k % 4 == 0, "fetch_failed").alias("unavailable_reason"),
    )
    return N.extraction_totals(cited)


TOTALS_SQL = """WITH c AS (SELECT page_id AS k, CASE WHEN page_id % 5 <> 0 THEN regexp_extract(url, '^([^?#]*)', 1) END AS url, html FROM pages)
SELECT count(*) AS citations, count(url) AS with_url, count(*) FILTER (WHERE k % 4 <> 0 AND html <> '') AS fetched, count(*) FILTER (WHERE k % 4 = 0) AS failed,
  count(DISTINCT url || CASE WHEN k % 3 <> 0 THEN '|page=' || k % 3 ELSE '' END) AS sources FROM c"""


def feedback_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratings as they are sent; what is not known is null."""
    rated = A.table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("check_id"), F.when(F.col("quality") == 1, 1).otherwise(-1).alias("rating"), F.when(F.col("toxic") == 1, "NOT SUPPORTED").alias("corrected_verdict"))
    return N.feedback_payload(rated)


FEEDBACK_SQL = """SELECT doc_id::VARCHAR AS check_id, CASE WHEN quality = 1 THEN 1 ELSE -1 END AS rating, CASE WHEN toxic = 1 THEN 'NOT SUPPORTED' END AS corrected_verdict,
  NULL::VARCHAR AS wiki_section, NULL::VARCHAR AS client_id FROM labels"""


def dataset_checksum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest of all documents' lines of a dataset, in the order of source and id."""
    rows = A.table(spark, sf_dir, "documents").select("doc_id", "source", "lang", F.sha2("text", 256).alias("text_hash"))
    return ordered_checksum(rows, ["source", "doc_id"], fan=64)


CHECKSUM_SQL = """WITH RECURSIVE d AS (
  SELECT source, doc_id, sha256('{"doc_id":' || coalesce(doc_id::VARCHAR, 'null') || ',"source":' || coalesce(to_json(source)::VARCHAR, 'null') || ',"lang":' || coalesce(to_json(lang)::VARCHAR, 'null') || ',"text_hash":' || coalesce('"' || sha256(text) || '"', 'null') || '}') AS h FROM documents),
v(lv, i, h, n) AS (
  SELECT 0, row_number() OVER (ORDER BY source NULLS FIRST, doc_id NULLS FIRST, h) - 1, h, count(*) OVER () FROM d
  UNION ALL SELECT lv + 1, i // 64, sha256(string_agg(h, '' ORDER BY i)), any_value((n + 63) // 64) FROM v WHERE n > 1 OR lv = 0 GROUP BY lv, i // 64)
SELECT coalesce(max(h), sha256('')) AS checksum FROM v WHERE n = 1 AND lv > 0"""


QUERIES = {
    "dataset_checksum": (dataset_checksum, CHECKSUM_SQL),
    "publication_gate": (publication_gate, GATE_SQL), "contradictions_published": (contradictions_published, CONTRADICTIONS_SQL), "flag_precision": (flag_precision, FLAG_SQL),
    "extraction_totals": (extraction_totals, TOTALS_SQL), "feedback_rows": (feedback_rows, FEEDBACK_SQL),
}
