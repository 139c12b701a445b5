"""The driver's tables read as the library's logical tables.

The driver's tables hold no verdicts: they are derived here by fixed rules, so
accuracies over them mean nothing outside the checks. Each adapter has its SQL
twin, used by the oracles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corrobora.functions.verdicts import TITLES
from corrobora.operators.common import latest

CUT = "2024-01-16"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(index) -> F.Column:
    return F.get(F.array(*map(F.lit, TITLES)), index.cast("int"))


def raw_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per event: a model's verdict on an entry, with repeats."""
    events = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    return events.select("event_id", "ts", "user_id", "event_type", "value", k.alias("k")).select(
        F.col("event_id").alias("pos"),
        "ts",
        F.concat(F.lit("row_"), F.col("user_id").cast("string")).alias("entry_id"),
        F.col("event_type").alias("provider"),
        F.concat(F.lit("model-"), F.col("event_type")).alias("model"),
        _pick(F.col("user_id") % 4).alias("ground_truth"),
        F.when(F.col("k") % 23 == 0, "PARSE_ERROR").otherwise(_pick(F.col("k") % 4)).alias("predicted_verdict"),
        F.col("k").alias("confidence"),
        F.floor(F.col("value") * 100).cast("long").alias("latency_ms"),
        F.when(F.col("k") % 17 == 0, "HTTP 503").alias("error"),
        F.when(F.col("k") % 5 == 0, "contradiction").otherwise("omission").alias("reason_type"),
        F.when(F.col("k") % 3 == 0, "").otherwise(F.concat(F.lit("q"), F.col("k").cast("string"))).alias("source_quote"),
        (F.col("k") % 2 == 0).alias("quote_verified"),
        F.when(F.col("k") % 7 != 0, F.col("k") * 10).alias("tokens_in"),
        F.when(F.col("k") % 7 != 0, F.col("k")).alias("tokens_out"),
    )


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per (entry_id, provider): the last one."""
    return latest(raw_results(spark, sf_dir), ["entry_id", "provider"], ["ts", "pos"])


def control(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_results(spark, sf_dir).where(F.col("ts") < F.lit(CUT).cast("timestamp_ntz"))


def treatment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_results(spark, sf_dir).where(F.col("ts") >= F.lit(CUT).cast("timestamp_ntz"))


def dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per user: an entry of the evaluation dataset."""
    u = F.col("user_id")
    return table(spark, sf_dir, "events").select("user_id").distinct().select(
        F.concat(F.lit("row_"), u.cast("string")).alias("id"),
        F.concat(F.lit("claim "), u.cast("string")).alias("claim_text"),
        F.concat(F.lit("https://example.org/"), (u % 50).cast("string")).alias("source_url"),
        _pick(u % 4).alias("ground_truth"),
        F.when(u % 3 != 0, F.concat(F.lit("v"), (u % 3).cast("string"))).alias("dataset_version"),
        F.when(u % 11 == 0, "source_fetch_failed").otherwise("complete").alias("extraction_status"),
        F.when(u % 13 == 0, True).when(u % 5 == 0, False).alias("needs_manual_review"),
        F.when(u % 2 == 0, "unanimous").otherwise("mixed").alias("wice_label_projection"),
    )


_PICK = "(['Supported', 'Partially supported', 'Not supported', 'Source unavailable'])[({}) % 4 + 1]"

RAW_SQL = f"""
ev AS (SELECT event_id, ts, user_id, event_type, value, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events),
raw_results AS (
  SELECT event_id AS pos, ts, 'row_' || user_id AS entry_id, event_type AS provider, 'model-' || event_type AS model,
    {_PICK.format("user_id")} AS ground_truth, CASE WHEN k % 23 = 0 THEN 'PARSE_ERROR' ELSE {_PICK.format("k")} END AS predicted_verdict,
    k AS confidence, CAST(floor(value * 100) AS BIGINT) AS latency_ms, CASE WHEN k % 17 = 0 THEN 'HTTP 503' END AS error,
    CASE WHEN k % 5 = 0 THEN 'contradiction' ELSE 'omission' END AS reason_type, CASE WHEN k % 3 = 0 THEN '' ELSE 'q' || k END AS source_quote,
    k % 2 = 0 AS quote_verified, CASE WHEN k % 7 <> 0 THEN k * 10 END AS tokens_in, CASE WHEN k % 7 <> 0 THEN k END AS tokens_out
  FROM ev
)"""
RESULTS_SQL = RAW_SQL + """,
results AS (SELECT * FROM raw_results QUALIFY row_number() OVER (PARTITION BY entry_id, provider ORDER BY ts DESC, pos DESC) = 1)"""
RUNS_SQL = RAW_SQL + f""",
control AS (SELECT * FROM raw_results WHERE ts < TIMESTAMP '{CUT}' QUALIFY row_number() OVER (PARTITION BY entry_id, provider ORDER BY pos DESC) = 1),
treatment AS (SELECT * FROM raw_results WHERE ts >= TIMESTAMP '{CUT}' QUALIFY row_number() OVER (PARTITION BY entry_id, provider ORDER BY pos DESC) = 1)"""
DATASET_SQL = f"""
dataset AS (
  SELECT 'row_' || user_id AS id, 'claim ' || user_id AS claim_text, 'https://example.org/' || (user_id % 50) AS source_url, {_PICK.format("user_id")} AS ground_truth,
    CASE WHEN user_id % 3 <> 0 THEN 'v' || (user_id % 3) END AS dataset_version, CASE WHEN user_id % 11 = 0 THEN 'source_fetch_failed' ELSE 'complete' END AS extraction_status,
    CASE WHEN user_id % 13 = 0 THEN true WHEN user_id % 5 = 0 THEN false END AS needs_manual_review, CASE WHEN user_id % 2 = 0 THEN 'unanimous' ELSE 'mixed' END AS wice_label_projection
  FROM (SELECT DISTINCT user_id FROM events)
)"""
