"""Choosing rows for a run: versions, projections, open tasks, reloads."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corrobora.operators.common import has_error


def open_tasks(entries: DataFrame, providers: Sequence[str], done: DataFrame) -> DataFrame:
    """(entry_id, provider) pairs without a result in ``done``."""
    tasks = entries.select("entry_id", F.explode(F.array(*map(F.lit, providers))).alias("provider"))
    return tasks.join(done.select("entry_id", "provider"), ["entry_id", "provider"], "left_anti")


def reload(results: DataFrame, selected: Sequence[str], resume: bool) -> DataFrame:
    """What a new run keeps: other providers' rows, and with ``resume`` the selected ones' rows without error."""
    others = ~F.col("provider").isin(*selected)
    return results.where(others | ~has_error()) if resume else results.where(others)


def of_version(results: DataFrame, dataset: DataFrame, version: str, default: str = "v1") -> DataFrame:
    """Results of entries of a version; entries that the dataset lacks count as the default one."""
    versions = dataset.select(F.col("id").alias("entry_id"), "dataset_version")
    return results.join(versions, "entry_id", "left").where(F.coalesce("dataset_version", F.lit(default)) == version).drop("dataset_version")


def of_projection(results: DataFrame, dataset: DataFrame, projection: str) -> DataFrame:
    """Results of entries whose label projection is the given one."""
    if projection not in ("unanimous", "mixed"):
        raise ValueError(f"a projection is unanimous or mixed, not {projection!r}")
    entries = dataset.where(F.col("wice_label_projection") == projection).select(F.col("id").alias("entry_id"))
    return results.join(entries, "entry_id", "left_semi")


def inspect(results: DataFrame, dataset: DataFrame, status: str, provider: str | None = None) -> DataFrame:
    """Results with a status (exact, partial, wrong or error) and their claims."""
    rows = results.where(F.col("provider") == provider) if provider else results
    rows = rows.where(has_error()) if status == "error" else rows.where(F.col("correct") == status)
    claims = dataset.select(F.col("id").alias("entry_id"), "claim_text")
    return rows.join(claims, "entry_id", "left").select("entry_id", "predicted_verdict", "ground_truth", F.coalesce("claim_text", F.lit("(no claim)")).alias("claim_text"))


def wanted_rows(dataset: DataFrame, ids: str) -> DataFrame:
    """The ids of a comma-separated list, each with whether the dataset has it."""
    wanted = sorted({x.strip() for x in ids.split(",") if x.strip()})
    asked = dataset.sparkSession.createDataFrame([(x,) for x in wanted], "id string")
    have = dataset.where(F.col("id").isin(*wanted)).select("id", F.lit(True).alias("known"))
    return asked.join(have, "id", "left").withColumn("known", F.coalesce("known", F.lit(False)))


def merge(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``new`` and the rows of ``old`` whose key it lacks."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def by_number(rows: DataFrame, column: str = "id") -> DataFrame:
    """Sorted by the number in an id such as row_12."""
    return rows.orderBy(F.regexp_extract(column, "([0-9]+)", 1).try_cast("long"))
