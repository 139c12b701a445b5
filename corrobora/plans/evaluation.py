"""Evaluation queries over the driver's tables, each with its DuckDB twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corrobora.functions import verdicts as V
from corrobora.operators import compare as C
from corrobora.operators import ensemble as E
from corrobora.operators import metrics as M
from corrobora.operators import runs as R
from corrobora.operators.common import has_error, ready
from corrobora.plans import adapters as A

PANEL = ["click", "error", "purchase", "signup", "view"]
NAMES = ("hf-vote-5", "hf-vote-5-binary")


def canon_sql(c: str) -> str:
    own = f"trim(regexp_replace(replace(upper({c}), '_', ' '), '\\s+', ' ', 'g'))"
    return "CASE " + " ".join(f"WHEN starts_with({own}, '{p}') THEN '{v}'" for p, v in V.PREFIXES) + " END"


def map_sql(c: str, to: list[str], other: str) -> str:
    return f"CASE {c} " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in zip(V.VERDICTS, to, strict=True)) + f" ELSE {other} END"


def label_sql(c: str) -> str:
    """The metrics' label of a verdict."""
    return f"coalesce({map_sql(canon_sql(c), V.TITLES, 'NULL')}, CASE WHEN contains(lower({c}), 'error') THEN 'Error' ELSE 'Unknown' END)"


def short_sql(c: str) -> str:
    """The comparison's label of a verdict."""
    return f"coalesce({map_sql(canon_sql(c), V.SHORT, 'NULL')}, trim(lower(coalesce({c}, ''))))"


def kind_sql(p: str, t: str) -> str:
    def kind(c: str) -> str:
        return f"CASE WHEN contains({c}, 'not supported') THEN 'not_supported' WHEN contains({c}, 'partially') THEN 'partial' WHEN contains({c}, 'supported') THEN 'supported' WHEN contains({c}, 'unavailable') THEN 'unavailable' ELSE {c} END"

    a, b = kind(f"lower(coalesce({p}, ''))"), kind(f"lower(coalesce({t}, ''))")
    return f"CASE WHEN {a} = {b} THEN 'exact' WHEN {a} IN ('partial', 'supported') AND {b} IN ('partial', 'supported') THEN 'partial' ELSE 'wrong' END"


_SUPPORT = "('Supported', 'Partially supported')"
_PROBLEM = "('Partially supported', 'Not supported')"
JUDGED = f"""{A.RESULTS_SQL},
labelled AS (SELECT *, {label_sql("predicted_verdict")} AS p, {label_sql("ground_truth")} AS t, coalesce(error, '') = '' AND predicted_verdict <> 'ERROR' AS valid FROM results),
judged AS (
  SELECT *, p = t AS exact, p <> t AND p IN {_SUPPORT} AND t IN {_SUPPORT} AS near, (p IN {_SUPPORT}) = (t IN {_SUPPORT}) AS bin,
    p NOT IN ('Error', 'Unknown') AND t NOT IN ('Error', 'Unknown') AND (p = t OR (p IN {_PROBLEM} AND t IN {_PROBLEM})) AS rest,
    p IN {_SUPPORT} OR (p = 'Not supported' AND reason_type = 'contradiction') AS eligible, coalesce(source_quote, '') <> '' AS offered
  FROM labelled)"""


def _share(a: str, b: str) -> str:
    return f"CASE WHEN {b} = 0 THEN 0.0 ELSE CAST({a} AS DOUBLE) / CAST({b} AS DOUBLE) END"


_SUMS = """
sums AS (
  SELECT provider, arg_min(model, pos) AS model, count(*) AS total, count(*) FILTER (WHERE valid) AS valid, count(*) FILTER (WHERE valid AND exact) AS ex, count(*) FILTER (WHERE valid AND near) AS nr,
    count(*) FILTER (WHERE valid AND bin) AS bn, count(*) FILTER (WHERE valid AND rest) AS rs,
    coalesce(avg(latency_ms) FILTER (WHERE latency_ms > 0), 0.0) AS latency_avg, coalesce(min(latency_ms) FILTER (WHERE latency_ms > 0), 0) AS latency_min, coalesce(max(latency_ms) FILTER (WHERE latency_ms > 0), 0) AS latency_max,
    coalesce(avg(confidence) FILTER (WHERE valid AND confidence > 0), 0.0) AS confidence_avg, coalesce(avg(coalesce(confidence, 0)) FILTER (WHERE valid AND exact), 0.0) AS confidence_correct, coalesce(avg(coalesce(confidence, 0)) FILTER (WHERE valid AND NOT exact), 0.0) AS confidence_wrong,
    count(*) FILTER (WHERE valid AND eligible) AS qe, count(*) FILTER (WHERE valid AND eligible AND offered) AS qo, count(*) FILTER (WHERE valid AND eligible AND offered AND quote_verified) AS qv,
    count(*) FILTER (WHERE valid AND eligible AND offered AND quote_verified AND exact) AS ve, count(*) FILTER (WHERE valid AND eligible AND offered AND NOT quote_verified) AS qu, count(*) FILTER (WHERE valid AND eligible AND offered AND NOT quote_verified AND exact) AS ue
  FROM judged GROUP BY provider)"""
METRICS_SQL = f"""WITH {JUDGED},{_SUMS}
SELECT provider, model, total, valid, total - valid AS errors, ex AS exact_matches, nr AS partial_matches, {_share("ex", "valid")} AS exact_accuracy, {_share("ex + nr", "valid")} AS lenient_accuracy,
  {_share("bn", "valid")} AS binary_accuracy, {_share("rs", "valid")} AS supported_vs_rest_accuracy, latency_avg, latency_min, latency_max, confidence_avg, confidence_correct, confidence_wrong,
  confidence_correct - confidence_wrong AS calibration, qe AS quotes_eligible, qo AS quotes_offered, qv AS quotes_verified, {_share("qo", "qe")} AS offer_rate, {_share("qv", "qo")} AS fidelity,
  {_share("ve", "qv")} AS accuracy_verified, {_share("ue", "qu")} AS accuracy_unverified
FROM sums"""
_TITLES = "(VALUES " + ", ".join(f"('{t}')" for t in V.TITLES) + ")"

Query = tuple  # (function, oracle or None)


def metrics_by_provider(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.metrics_by_provider(A.results(spark, sf_dir))


def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.confusion_matrix(A.results(spark, sf_dir))


CONFUSION_SQL = f"""WITH {JUDGED},
counts AS (SELECT provider, t, p, count(*) AS n FROM judged WHERE valid GROUP BY ALL)
SELECT g.provider, a.t AS truth, b.p AS predicted, coalesce(n, 0) AS n FROM (SELECT DISTINCT provider FROM judged WHERE valid) g CROSS JOIN {_TITLES} a(t) CROSS JOIN {_TITLES} b(p)
LEFT JOIN counts c ON c.provider = g.provider AND c.t = a.t AND c.p = b.p"""


def provider_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.ranking(A.results(spark, sf_dir))


RANKING_SQL = f"""WITH {JUDGED}, r AS (SELECT provider, min(pos) AS first, {_share("count(*) FILTER (WHERE valid AND exact)", "count(*) FILTER (WHERE valid)")} AS exact_accuracy FROM judged GROUP BY provider)
SELECT provider, exact_accuracy, row_number() OVER (ORDER BY exact_accuracy DESC, first) AS rank FROM r"""


def best_providers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.best(A.results(spark, sf_dir))


BEST_SQL = f"""WITH {JUDGED},{_SUMS}, r AS (SELECT s.*, {_share("ex", "valid")} AS acc, confidence_correct - confidence_wrong AS calibration, first FROM sums s JOIN (SELECT provider, min(pos) AS first FROM results GROUP BY provider) USING (provider))
SELECT (SELECT provider FROM r ORDER BY latency_avg, first DESC LIMIT 1) AS fastest, (SELECT provider FROM r ORDER BY calibration DESC, first DESC LIMIT 1) AS best_calibrated, (SELECT provider FROM r ORDER BY acc DESC, first LIMIT 1) AS most_accurate"""


def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.run_summary(A.results(spark, sf_dir), V.score("predicted_verdict", "ground_truth", "error"))


SUMMARY_SQL = f"""WITH {A.RESULTS_SQL}, s AS (SELECT *, CASE WHEN coalesce(error, '') = '' THEN {kind_sql("predicted_verdict", "ground_truth")} END AS correct FROM results)
SELECT provider, count(*) AS total, count(*) FILTER (WHERE correct = 'exact') AS exact, count(*) FILTER (WHERE correct = 'partial') AS partial, count(*) FILTER (WHERE correct = 'wrong') AS wrong,
  count(*) FILTER (WHERE coalesce(error, '') <> '') AS errors, avg(latency_ms) AS avg_latency, CAST(sum(tokens_in) AS BIGINT) AS tokens_in, CAST(sum(tokens_out) AS BIGINT) AS tokens_out FROM s GROUP BY provider"""


def needs_review_prf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.needs_review(A.results(spark, sf_dir))


REVIEW_SQL = f"""WITH {JUDGED}, s AS (
  SELECT provider, count(*) FILTER (WHERE t <> 'Supported' AND p <> 'Supported') AS tp, count(*) FILTER (WHERE t = 'Supported' AND p <> 'Supported') AS fp, count(*) FILTER (WHERE t <> 'Supported' AND p = 'Supported') AS fn
  FROM judged WHERE valid AND p NOT IN ('Error', 'Unknown') AND t NOT IN ('Error', 'Unknown') GROUP BY provider)
SELECT provider, tp, fp, fn, {_share("tp", "tp + fp")} AS precision, {_share("tp", "tp + fn")} AS recall, {_share("2 * tp", "2 * tp + fp + fn")} AS f1 FROM s"""


def quote_fidelity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.quote_fidelity(A.raw_results(spark, sf_dir))


FIDELITY_SQL = f"""WITH {A.RAW_SQL} SELECT provider, count(*) AS checks, count(*) FILTER (WHERE source_quote <> '') AS quoted, count(*) FILTER (WHERE source_quote <> '' AND quote_verified) AS verified FROM raw_results GROUP BY provider"""


def distinct_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.distinct_counts(A.raw_results(spark, sf_dir))


DISTINCT_SQL = f"WITH {A.RAW_SQL} SELECT count(*) AS rows, count(DISTINCT entry_id) AS entries, count(DISTINCT provider) AS providers FROM raw_results"


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.cells(A.control(spark, sf_dir), A.treatment(spark, sf_dir), A.dataset(spark, sf_dir))


def compare_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cells(spark, sf_dir)


_INDEXED = f"""{A.RAW_SQL}, usable AS (SELECT * FROM raw_results WHERE coalesce(error, '') = '' AND predicted_verdict <> 'ERROR'),
ctl AS (SELECT * FROM usable WHERE ts < TIMESTAMP '{A.CUT}' QUALIFY row_number() OVER (PARTITION BY entry_id, provider ORDER BY pos DESC) = 1),
trt AS (SELECT * FROM usable WHERE ts >= TIMESTAMP '{A.CUT}' QUALIFY row_number() OVER (PARTITION BY entry_id, provider ORDER BY pos DESC) = 1), {A.DATASET_SQL},
valid_entries AS (SELECT * FROM dataset WHERE extraction_status = 'complete' AND NOT coalesce(needs_manual_review, false))"""
_BASE = f"""{_INDEXED}, base AS (
  SELECT c.entry_id, c.provider, c.predicted_verdict AS control_verdict, t.predicted_verdict AS treatment_verdict, d.ground_truth, d.claim_text, d.source_url, d.dataset_version,
    {short_sql("c.predicted_verdict")} AS x, {short_sql("t.predicted_verdict")} AS y, {short_sql("d.ground_truth")} AS z
  FROM ctl c JOIN trt t USING (entry_id, provider) JOIN valid_entries d ON d.id = c.entry_id),
cells AS (SELECT *, CASE WHEN x = z AND y = z THEN 'unchanged-correct' WHEN y = z THEN 'improvement' WHEN x = z THEN 'regression' WHEN x = y THEN 'unchanged-wrong-same' ELSE 'lateral' END AS direction FROM base)"""
_CELL_COLUMNS = "entry_id, provider, control_verdict, treatment_verdict, ground_truth, claim_text, source_url, dataset_version, direction"
CELLS_SQL = f"WITH {_BASE} SELECT {_CELL_COLUMNS} FROM cells"


def compare_provider_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.provider_stats(_cells(spark, sf_dir))


def _stats_sql(where: str) -> str:
    s = "('support', 'partial')"
    tests = {
        "exact_control": "x = z", "exact_treatment": "y = z", "lenient_control": f"x = z OR (x IN {s} AND z IN {s})", "lenient_treatment": f"y = z OR (y IN {s} AND z IN {s})",
        "binary_control": f"(x IN {s}) = (z IN {s})", "binary_treatment": f"(y IN {s}) = (z IN {s})",
    } | {d.replace("-", "_"): f"direction = '{d}'" for d in V.DIRECTIONS}
    sums = ", ".join(f"count(*) FILTER (WHERE {t}) AS {n}" for n, t in tests.items())
    pct = ", ".join(f"{r}_control::DOUBLE / n * 100 AS {r}_control_pct, {r}_treatment::DOUBLE / n * 100 AS {r}_treatment_pct, {r}_treatment::DOUBLE / n * 100 - {r}_control::DOUBLE / n * 100 AS {r}_delta" for r in ("exact", "lenient", "binary"))
    return f"WITH {_BASE}, s AS (SELECT provider, count(*) AS n, {sums} FROM cells WHERE {where} GROUP BY provider) SELECT *, {pct} FROM s"


def compare_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.coverage(A.control(spark, sf_dir), A.treatment(spark, sf_dir), A.dataset(spark, sf_dir))


COVERAGE_SQL = f"""WITH {_INDEXED}, pairs AS (SELECT c.pos AS a, t.pos AS b, coalesce(c.entry_id, t.entry_id) AS e FROM ctl c FULL JOIN trt t ON c.entry_id = t.entry_id AND c.provider = t.provider)
SELECT (SELECT count(*) FROM dataset) AS dataset_total, (SELECT count(*) FROM valid_entries) AS dataset_valid, count(*) FILTER (WHERE b IS NULL) AS control_only, count(*) FILTER (WHERE a IS NULL) AS treatment_only,
  count(*) FILTER (WHERE a IS NOT NULL AND b IS NOT NULL) AS intersection, count(*) FILTER (WHERE a IS NOT NULL AND b IS NOT NULL AND e IN (SELECT id FROM valid_entries)) AS compared FROM pairs"""


def compare_flips_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.provider_stats(C.filter_cells(_cells(spark, sf_dir), "direction=regression"))


def provider_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.pivot(A.raw_results(spark, sf_dir), PANEL)


PIVOT_SQL = f"""WITH {A.RAW_SQL} SELECT entry_id, arg_min(ground_truth, pos) AS ground_truth, {", ".join(f"coalesce(arg_max(predicted_verdict, pos) FILTER (WHERE provider = '{p}'), '') AS {p}" for p in PANEL)} FROM raw_results GROUP BY entry_id"""


def ensemble_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.votes(A.results(spark, sf_dir), PANEL)


_RANK = "CASE predicted_verdict WHEN 'Partially supported' THEN 4 WHEN 'Not supported' THEN 3 WHEN 'Source unavailable' THEN 2 WHEN 'Supported' THEN 1 ELSE 0 END"
_VOTES = f"""{A.RESULTS_SQL}, members AS (SELECT *, list_position({PANEL!r}, provider) AS place FROM results WHERE provider IN ({", ".join(map(repr, PANEL))})),
tally AS (SELECT entry_id, predicted_verdict, count(*) AS n, min(place) AS first, {_RANK} AS rk FROM members GROUP BY entry_id, predicted_verdict),
won AS (SELECT entry_id, predicted_verdict AS plurality FROM tally QUALIFY row_number() OVER (PARTITION BY entry_id ORDER BY n DESC, rk DESC, first) = 1),
votes AS (
  SELECT entry_id, plurality, CASE WHEN 2 * supports > 5 THEN 'Supported' ELSE 'Not supported' END AS bin, supports
  FROM (SELECT entry_id, count(*) AS n, count(*) FILTER (WHERE predicted_verdict IN {_SUPPORT}) AS supports FROM members GROUP BY entry_id HAVING count(*) = 5) JOIN won USING (entry_id))"""
VOTES_SQL = f'WITH {_VOTES} SELECT entry_id, plurality, bin AS "binary", supports FROM votes'


def ensemble_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.vote_rows(A.results(spark, sf_dir), PANEL, NAMES)


ROWS_SQL = f"""WITH {_VOTES}, both_votes AS (
  SELECT entry_id, '{NAMES[0]}' AS provider, 'plurality-5' AS model, plurality AS predicted_verdict FROM votes UNION ALL SELECT entry_id, '{NAMES[1]}', 'majority-5-binary', bin FROM votes),
sums AS (SELECT entry_id, max(ground_truth) FILTER (WHERE provider = '{PANEL[0]}') AS ground_truth, CAST(sum(latency_ms) AS BIGINT) AS latency_ms, CAST(sum(tokens_in) AS BIGINT) AS tokens_in, CAST(sum(tokens_out) AS BIGINT) AS tokens_out FROM members GROUP BY entry_id)
SELECT entry_id, provider, model, ground_truth, predicted_verdict, 0 AS confidence, latency_ms, tokens_in, tokens_out, {kind_sql("predicted_verdict", "ground_truth")} AS correct FROM both_votes JOIN sums USING (entry_id)"""


def metrics_with_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ensemble rows beside the real ones, counted per provider."""
    return E.with_votes(A.results(spark, sf_dir), PANEL, NAMES).groupBy("provider").agg(F.count("*").alias("n"), F.count_if(V.match_kind("predicted_verdict", "ground_truth") == "exact").alias("exact"))


WITH_VOTES_SQL = f"""WITH {_VOTES}, every AS (
  SELECT provider, predicted_verdict, ground_truth FROM results UNION ALL
  SELECT v.provider, v.predicted_verdict, g.ground_truth FROM (SELECT entry_id, '{NAMES[0]}' AS provider, plurality AS predicted_verdict FROM votes UNION ALL SELECT entry_id, '{NAMES[1]}', bin FROM votes) v
  JOIN (SELECT entry_id, max(ground_truth) AS ground_truth FROM members GROUP BY entry_id) g USING (entry_id))
SELECT provider, count(*) AS n, count(*) FILTER (WHERE {kind_sql("predicted_verdict", "ground_truth")} = 'exact') AS exact FROM every GROUP BY provider"""


def canonical_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every normaliser over many spellings of verdicts."""
    spellings = F.array(*map(F.lit, _SPELLINGS))
    raw = F.get(spellings, (F.col("event_id") % len(_SPELLINGS)).cast("int"))
    truth = F.get(spellings, (F.col("user_id") % len(_SPELLINGS)).cast("int"))
    rows = A.table(spark, sf_dir, "events").select("event_id", raw.alias("raw"), truth.alias("truth"))
    return rows.select(
        "event_id", V.canonical("raw").alias("canonical"), V.metric_label("raw").alias("metric_label"), V.compare_label("raw").alias("compare_label"), V.runner_label("raw").alias("runner_label"), V.truth_label("raw").alias("truth_label"),
        V.match_kind("raw", "truth").alias("match_kind"), V.equal_lenient("raw", "truth").alias("lenient"), V.equal_binary("raw", "truth").alias("same_side"), V.equal_supported_vs_rest("raw", "truth").alias("rest"), V.needs_action("raw").alias("needs_action"),
    )


_SPELLINGS = ["SUPPORTED", "supported", "partially_supported", "Partially  supported", "NOT_SUPPORTED", "not supported ", "Source unavailable", "UNAVAILABLE", "PARSE_ERROR", "ERROR", "", "maybe", "Supports"]
CANONICAL_SQL = f"""WITH rows AS (SELECT event_id, ({_SPELLINGS!r})[event_id % {len(_SPELLINGS)} + 1] AS raw, ({_SPELLINGS!r})[user_id % {len(_SPELLINGS)} + 1] AS truth FROM events),
c AS (SELECT *, {canon_sql("raw")} AS cr, {canon_sql("truth")} AS ct, {short_sql("raw")} AS sr, {short_sql("truth")} AS st FROM rows)
SELECT event_id, cr AS canonical, {label_sql("raw")} AS metric_label, sr AS compare_label, {map_sql("cr", V.TITLES, "'PARSE_ERROR'")} AS runner_label, {map_sql("cr", V.TITLES, "raw")} AS truth_label, {kind_sql("raw", "truth")} AS match_kind,
  sr = st OR (sr IN ('support', 'partial') AND st IN ('support', 'partial')) AS lenient, (sr IN ('support', 'partial')) = (st IN ('support', 'partial')) AS same_side,
  coalesce(cr = ct OR (cr IN ('PARTIALLY SUPPORTED', 'NOT SUPPORTED') AND ct IN ('PARTIALLY SUPPORTED', 'NOT SUPPORTED')), false) AS rest, coalesce(cr <> 'SUPPORTED', false) AS needs_action FROM c"""


def resume_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = ready(A.dataset(spark, sf_dir)).select(F.col("id").alias("entry_id"))
    return R.open_tasks(entries, PANEL, A.results(spark, sf_dir).where(~has_error()))


RESUME_SQL = f"""WITH {A.RESULTS_SQL}, {A.DATASET_SQL}
SELECT d.id AS entry_id, p.provider FROM dataset d CROSS JOIN (SELECT unnest({PANEL!r}) AS provider) p
WHERE d.extraction_status = 'complete' AND NOT coalesce(d.needs_manual_review, false) AND NOT EXISTS (SELECT 1 FROM results r WHERE r.entry_id = d.id AND r.provider = p.provider AND coalesce(r.error, '') = '')"""


def protected_reload(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.reload(A.results(spark, sf_dir), ["click", "view"], resume=True).select("entry_id", "provider", "error")


RELOAD_SQL = f"WITH {A.RESULTS_SQL} SELECT entry_id, provider, error FROM results WHERE provider NOT IN ('click', 'view') OR coalesce(error, '') = ''"


def version_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.of_version(A.results(spark, sf_dir), A.dataset(spark, sf_dir).where("id <> 'row_3'"), "v1").groupBy("provider").agg(F.count("*").alias("n"))


VERSION_SQL = f"""WITH {A.RESULTS_SQL}, {A.DATASET_SQL} SELECT provider, count(*) AS n FROM results r LEFT JOIN (SELECT * FROM dataset WHERE id <> 'row_3') d ON d.id = r.entry_id WHERE coalesce(d.dataset_version, 'v1') = 'v1' GROUP BY provider"""


def projection_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.of_projection(A.results(spark, sf_dir), A.dataset(spark, sf_dir), "mixed").groupBy("provider").agg(F.count("*").alias("n"))


PROJECTION_SQL = f"WITH {A.RESULTS_SQL}, {A.DATASET_SQL} SELECT provider, count(*) AS n FROM results r JOIN dataset d ON d.id = r.entry_id WHERE wice_label_projection = 'mixed' GROUP BY provider"


def inspect_wrong(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = A.results(spark, sf_dir).withColumn("correct", V.score("predicted_verdict", "ground_truth", "error"))
    return R.inspect(scored, A.dataset(spark, sf_dir), "wrong", "click")


INSPECT_SQL = f"""WITH {A.RESULTS_SQL}, {A.DATASET_SQL} SELECT r.entry_id, r.predicted_verdict, r.ground_truth, coalesce(d.claim_text, '(no claim)') AS claim_text FROM results r LEFT JOIN dataset d ON d.id = r.entry_id
WHERE provider = 'click' AND coalesce(error, '') = '' AND {kind_sql("r.predicted_verdict", "r.ground_truth")} = 'wrong'"""


def unknown_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Asked-for ids: whether the dataset has each."""
    return R.wanted_rows(A.dataset(spark, sf_dir), " row_1, row_2 ,,row_nowhere").select("id", "known")


UNKNOWN_SQL = f"WITH {A.RAW_SQL}, {A.DATASET_SQL} SELECT w.id, d.id IS NOT NULL AS known FROM (VALUES ('row_1'), ('row_2'), ('row_nowhere')) w(id) LEFT JOIN dataset d USING (id)"


def dataset_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries extracted anew replace those of the same id."""
    old = A.dataset(spark, sf_dir)
    new = old.where("extraction_status <> 'complete'").withColumn("extraction_status", F.lit("complete"))
    return R.merge(old, new, "id").select("id", "extraction_status")


MERGE_SQL = f"WITH {A.DATASET_SQL} SELECT id, 'complete' AS extraction_status FROM dataset"

QUERIES: dict[str, Query] = {
    "metrics_by_provider": (metrics_by_provider, METRICS_SQL), "confusion_matrix": (confusion_matrix, CONFUSION_SQL), "provider_ranking": (provider_ranking, RANKING_SQL), "best_providers": (best_providers, BEST_SQL),
    "run_summary": (run_summary, SUMMARY_SQL), "needs_review_prf": (needs_review_prf, REVIEW_SQL), "quote_fidelity": (quote_fidelity, FIDELITY_SQL), "distinct_counts": (distinct_counts, DISTINCT_SQL),
    "compare_cells": (compare_cells, CELLS_SQL), "compare_provider_stats": (compare_provider_stats, _stats_sql("true")), "compare_coverage": (compare_coverage, COVERAGE_SQL),
    "compare_flips_filtered": (compare_flips_filtered, _stats_sql("direction = 'regression'")), "provider_pivot": (provider_pivot, PIVOT_SQL), "ensemble_votes": (ensemble_votes, VOTES_SQL), "ensemble_rows": (ensemble_rows, ROWS_SQL),
    "metrics_with_votes": (metrics_with_votes, WITH_VOTES_SQL), "canonical_verdicts": (canonical_verdicts, CANONICAL_SQL), "resume_tasks": (resume_tasks, RESUME_SQL), "protected_reload": (protected_reload, RELOAD_SQL),
    "version_filter": (version_filter, VERSION_SQL), "projection_filter": (projection_filter, PROJECTION_SQL), "inspect_wrong": (inspect_wrong, INSPECT_SQL), "unknown_rows": (unknown_rows, UNKNOWN_SQL), "dataset_merge": (dataset_merge, MERGE_SQL),
}
