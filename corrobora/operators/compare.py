"""Two runs over the same entries, compared cell by cell."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corrobora.functions.text import percent
from corrobora.functions.verdicts import DIRECTIONS, direction, equal_binary, equal_exact, equal_lenient
from corrobora.operators.common import has_error, latest, ready

KEY = ["entry_id", "provider"]


def index(run: DataFrame) -> DataFrame:
    """A run's usable rows, the last one of each (entry, provider)."""
    usable = run.where(~has_error() & (F.coalesce("predicted_verdict", F.lit("")) != "ERROR"))
    return latest(usable, KEY, ["pos"]).select(*KEY, "predicted_verdict")


def cells(control: DataFrame, treatment: DataFrame, dataset: DataFrame) -> DataFrame:
    """Pairs that both runs have, of entries ready for use, with how each moved.

    Both runs are deduplicated on the join's key, so one shuffle serves both.
    """
    a = index(control).withColumnRenamed("predicted_verdict", "control_verdict")
    b = index(treatment).withColumnRenamed("predicted_verdict", "treatment_verdict")
    entries = ready(dataset).select(F.col("id").alias("entry_id"), "ground_truth", "claim_text", "source_url", "dataset_version")
    rows = a.join(b, KEY).join(entries, "entry_id")
    return rows.withColumn("direction", direction("control_verdict", "treatment_verdict", "ground_truth"))


def provider_stats(cells: DataFrame) -> DataFrame:
    """Correct cells of both runs under each rule, in percent, and the flips."""
    rules = {"exact": equal_exact, "lenient": equal_lenient, "binary": equal_binary}
    tests = {f"{name}_{side}": F.count_if(rule(f"{side}_verdict", "ground_truth")) for name, rule in rules.items() for side in ("control", "treatment")}
    flips = {d.replace("-", "_"): F.count_if(F.col("direction") == d) for d in DIRECTIONS}
    sums = cells.groupBy("provider").agg(F.count("*").alias("n"), *(e.alias(n) for n, e in (tests | flips).items()))
    for name in rules:
        before, after = percent(F.col(f"{name}_control"), F.col("n")), percent(F.col(f"{name}_treatment"), F.col("n"))
        sums = sums.withColumns({f"{name}_control_pct": before, f"{name}_treatment_pct": after, f"{name}_delta": after - before})
    return sums


def coverage(control: DataFrame, treatment: DataFrame, dataset: DataFrame) -> DataFrame:
    """Entries and pairs on each side, as one row: counted in one full join of the keys."""
    a, b = index(control).select(*KEY, F.lit(1).alias("a")), index(treatment).select(*KEY, F.lit(1).alias("b"))
    valid = ready(dataset).select(F.col("id").alias("entry_id"), F.lit(1).alias("v"))
    both = a.join(b, KEY, "full").join(valid, "entry_id", "left")
    pairs = both.agg(
        F.count_if(F.col("b").isNull()).alias("control_only"), F.count_if(F.col("a").isNull()).alias("treatment_only"), F.count_if((F.col("a") == 1) & (F.col("b") == 1)).alias("intersection"),
        F.count_if((F.col("a") == 1) & (F.col("b") == 1) & (F.col("v") == 1)).alias("compared"),
    )
    usable = (F.col("extraction_status") == "complete") & ~F.coalesce("needs_manual_review", F.lit(False))
    return dataset.agg(F.count("*").alias("dataset_total"), F.count_if(usable).alias("dataset_valid")).crossJoin(pairs)  # one row each


FILTERS = {"version": "dataset_version", "provider": "provider", "direction": "direction"}


def filter_cells(cells: DataFrame, expression: str) -> DataFrame:
    """Cells that satisfy ``key=value``; key is version, provider or direction."""
    key, sep, value = expression.partition("=")
    if not sep or key not in FILTERS or not value:
        raise ValueError(f"a filter is one of {', '.join(FILTERS)} followed by =value, not {expression!r}")
    return cells.where(F.col(FILTERS[key]) == value)


def pivot(results: DataFrame, providers: list[str]) -> DataFrame:
    """One row an entry, one column a provider: its last verdict, '' where there is none."""
    truth = results.groupBy("entry_id").agg(F.min_by("ground_truth", "pos").alias("ground_truth"))
    wide = results.groupBy("entry_id").pivot("provider", providers).agg(F.max_by("predicted_verdict", "pos"))
    return truth.join(wide, "entry_id").select("entry_id", "ground_truth", *(F.coalesce(p, F.lit("")).alias(p) for p in providers))
