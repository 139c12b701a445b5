"""Accuracy, calibration and quote metrics per provider."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corrobora.functions.text import share
from corrobora.functions.verdicts import TITLES, equal_supported_vs_rest, metric_label, quote_expected
from corrobora.operators.common import has_error


def judged(results: DataFrame) -> DataFrame:
    """Each result with its normalised labels and the tests that the metrics count."""
    p, t = metric_label("predicted_verdict"), metric_label("ground_truth")
    rows = results.withColumns({"p": p, "t": t, "valid": ~has_error() & (F.coalesce("predicted_verdict", F.lit("")) != "ERROR")})
    support = ["Supported", "Partially supported"]
    tests = {
        "exact": F.col("p") == F.col("t"),
        "near": F.col("p").isin(*support) & F.col("t").isin(*support) & (F.col("p") != F.col("t")),
        "binary": F.col("p").isin(*support) == F.col("t").isin(*support),
        "rest": equal_supported_vs_rest("predicted_verdict", "ground_truth"),
        "eligible": quote_expected("predicted_verdict", "reason_type"),
        "offered": F.coalesce("source_quote", F.lit("")) != "",
    }
    return rows.withColumns(tests)


def _n(*tests: Column) -> Column:
    """How many valid rows pass all tests."""
    every = F.col("valid")
    for t in tests:
        every = every & t
    return F.count_if(every)


def metrics_by_provider(results: DataFrame) -> DataFrame:
    """All metrics of each provider, in one pass over the results.

    Ratios of nothing are 0. Latency covers all rows with one above 0; mean
    confidence covers valid rows above 0, but its split by correctness all
    valid rows, with none as 0.
    """
    c = F.col
    exact, wrong = c("exact"), ~c("exact")
    conf = F.coalesce("confidence", F.lit(0))
    latency = F.when(c("latency_ms") > 0, c("latency_ms"))
    offered, verified = c("eligible") & c("offered"), c("eligible") & c("offered") & c("quote_verified")
    unverified = c("eligible") & c("offered") & ~F.coalesce("quote_verified", F.lit(False))
    sums = judged(results).groupBy("provider").agg(
        F.min_by("model", "pos").alias("model"), F.count("*").alias("total"), _n().alias("valid"), _n(exact).alias("exact_matches"), _n(c("near")).alias("partial_matches"),
        _n(c("binary")).alias("binary_matches"), _n(c("rest")).alias("rest_matches"),
        F.coalesce(F.avg(latency), F.lit(0.0)).alias("latency_avg"), F.coalesce(F.min(latency), F.lit(0)).alias("latency_min"), F.coalesce(F.max(latency), F.lit(0)).alias("latency_max"),
        F.coalesce(F.avg(F.when(c("valid") & (c("confidence") > 0), c("confidence"))), F.lit(0.0)).alias("confidence_avg"),
        F.coalesce(F.avg(F.when(c("valid") & exact, conf)), F.lit(0.0)).alias("confidence_correct"), F.coalesce(F.avg(F.when(c("valid") & wrong, conf)), F.lit(0.0)).alias("confidence_wrong"),
        _n(c("eligible")).alias("quotes_eligible"), _n(offered).alias("quotes_offered"), _n(verified).alias("quotes_verified"),
        _n(verified, exact).alias("verified_exact"), _n(unverified).alias("quotes_unverified"), _n(unverified, exact).alias("unverified_exact"),
    )
    return sums.select(
        "provider", "model", "total", "valid", (c("total") - c("valid")).alias("errors"), "exact_matches", "partial_matches",
        share(c("exact_matches"), c("valid")).alias("exact_accuracy"), share(c("exact_matches") + c("partial_matches"), c("valid")).alias("lenient_accuracy"),
        share(c("binary_matches"), c("valid")).alias("binary_accuracy"), share(c("rest_matches"), c("valid")).alias("supported_vs_rest_accuracy"),
        "latency_avg", "latency_min", "latency_max", "confidence_avg", "confidence_correct", "confidence_wrong", (c("confidence_correct") - c("confidence_wrong")).alias("calibration"),
        "quotes_eligible", "quotes_offered", "quotes_verified", share(c("quotes_offered"), c("quotes_eligible")).alias("offer_rate"), share(c("quotes_verified"), c("quotes_offered")).alias("fidelity"),
        share(c("verified_exact"), c("quotes_verified")).alias("accuracy_verified"), share(c("unverified_exact"), c("quotes_unverified")).alias("accuracy_unverified"),
    )


def confusion_matrix(results: DataFrame) -> DataFrame:
    """provider, truth, predicted, n over all pairs of the four verdicts, zeros included."""
    rows = judged(results).where("valid")
    counts = rows.where(F.col("t").isin(*TITLES) & F.col("p").isin(*TITLES)).groupBy("provider", "t", "p").agg(F.count("*").alias("n"))
    every = F.array(*map(F.lit, TITLES))
    grid = rows.select("provider").distinct().select("provider", F.explode(every).alias("t")).select("provider", "t", F.explode(every).alias("p"))
    return grid.join(counts, ["provider", "t", "p"], "left").select("provider", F.col("t").alias("truth"), F.col("p").alias("predicted"), F.coalesce("n", F.lit(0)).alias("n"))


def ranking(results: DataFrame) -> DataFrame:
    """Providers by exact accuracy, ties in order of first appearance. One row a provider: the window is small."""
    from pyspark.sql import Window

    first = results.groupBy("provider").agg(F.min("pos").alias("first"))
    rows = metrics_by_provider(results).join(first, "provider")
    w = Window.orderBy(F.desc("exact_accuracy"), "first")
    return rows.select("provider", "exact_accuracy", F.row_number().over(w).cast("long").alias("rank"))


def best(results: DataFrame) -> DataFrame:
    """The fastest and the best calibrated provider; the last of equals wins."""
    first = results.groupBy("provider").agg(F.min("pos").alias("first"))
    rows = metrics_by_provider(results).join(first, "provider")
    return rows.agg(
        F.max_by("provider", F.struct(-F.col("latency_avg"), F.col("first"))).alias("fastest"), F.max_by("provider", F.struct("calibration", "first")).alias("best_calibrated"),
        F.max_by("provider", F.struct(F.col("exact_accuracy"), -F.col("first"))).alias("most_accurate"),
    )


def _costs(results: DataFrame) -> list[Column]:
    if "cost_usd" not in results.columns:
        return []
    cost = F.sum("cost_usd")
    return [cost.alias("cost_usd"), F.avg("cost_usd").alias("avg_cost_usd"), F.try_divide(cost, F.nullif(F.count_if(F.col("correct") == "exact"), F.lit(0))).alias("cost_per_exact_usd")]


def run_summary(results: DataFrame, correct: Column) -> DataFrame:
    """Counts of a run, its mean latency over all rows and, where rows have costs, their sum, mean and sum for each exact one."""
    return results.withColumn("correct", correct).groupBy("provider").agg(
        F.count("*").alias("total"), F.count_if(F.col("correct") == "exact").alias("exact"), F.count_if(F.col("correct") == "partial").alias("partial"), F.count_if(F.col("correct") == "wrong").alias("wrong"),
        F.count_if(has_error()).alias("errors"), F.avg("latency_ms").alias("avg_latency"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"),
        *_costs(results),
    )


def needs_review(results: DataFrame) -> DataFrame:
    """Precision, recall and F1 of finding entries that are not supported."""
    rows = judged(results).where(F.col("valid") & F.col("t").isin(*TITLES) & F.col("p").isin(*TITLES))
    bad, said = F.col("t") != "Supported", F.col("p") != "Supported"
    sums = rows.groupBy("provider").agg(F.count_if(bad & said).alias("tp"), F.count_if(~bad & said).alias("fp"), F.count_if(bad & ~said).alias("fn"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return sums.select("provider", "tp", "fp", "fn", share(tp, tp + fp).alias("precision"), share(tp, tp + fn).alias("recall"), share(2 * tp, 2 * tp + fp + fn).alias("f1"))


def quote_fidelity(logs: DataFrame) -> DataFrame:
    """For each provider: replies, those with a quote, and those whose quote was found."""
    quoted = F.coalesce("source_quote", F.lit("")) != ""
    return logs.groupBy("provider").agg(F.count("*").alias("checks"), F.count_if(quoted).alias("quoted"), F.count_if(quoted & F.col("quote_verified")).alias("verified"))


def distinct_counts(results: DataFrame) -> DataFrame:
    """Rows, and distinct entries and providers, and addresses and groups where rows have them."""
    more = [F.count_distinct(c).alias(n) for c, n in (("source_url", "urls"), ("group_id", "groups")) if c in results.columns]
    return results.agg(F.count("*").alias("rows"), F.count_distinct("entry_id").alias("entries"), F.count_distinct("provider").alias("providers"), *more)
