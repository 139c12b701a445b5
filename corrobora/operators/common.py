"""Building blocks that several operators share."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key in the given order; Spark keeps one row a key before it shuffles."""
    w = Window.partitionBy(*keys).orderBy(*(F.col(c).desc() for c in order))
    return df.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def has_error(column: str = "error") -> F.Column:
    """An error is a text that is not empty."""
    return F.coalesce(F.col(column), F.lit("")) != ""


def ready(dataset: DataFrame) -> DataFrame:
    """Entries that a run may use: complete, and not waiting for a review."""
    return dataset.where((F.col("extraction_status") == "complete") & ~F.coalesce("needs_manual_review", F.lit(False)))
