"""Results saved part by part beside their file, and put into it once.

``<path>.parts`` holds a folder of Parquet files for each part and, under
``done``, an empty file for each part that is whole; making that file is the
commit. A save costs its own rows alone, whatever was saved before, and a crash
loses no part that was committed: the next run finds them by ``saved``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from corrobora.sources.files import delete, listed, touch, write_rows


def save(rows: DataFrame, path: str) -> None:
    """Adds a part; its rows count from when they are all written."""
    name = uuid.uuid4().hex
    rows.write.parquet(f"{path}.parts/{name}")
    touch(rows.sparkSession, f"{path}.parts/done/{name}")


def saved(spark: SparkSession, path: str) -> DataFrame | None:
    """The rows of all committed parts; None where there is none."""
    names = listed(spark, f"{path}.parts/done")
    return spark.read.option("mergeSchema", True).parquet(*(f"{path}.parts/{n}" for n in names)) if names else None


def finish(rows: DataFrame, path: str, metadata: dict) -> None:
    """Writes the file and drops the parts; a crash in between leaves parts that the file has already."""
    write_rows(rows, path, metadata)
    delete(rows.sparkSession, f"{path}.parts")


def replaced(old: DataFrame | None, parts: DataFrame, keys: list[str]) -> DataFrame:
    """The file's rows with the parts' rows in place of those of the same keys."""
    if old is None:
        return parts
    return old.join(parts.select(*keys), keys, "left_anti").unionByName(parts, allowMissingColumns=True)
