"""The corpus pipeline: quality rules, near duplicates, decontamination, PII, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept; all but the last return the columns of ``documents``. ``run`` writes each
stage's result as Parquet in the shared folder and gives it, read again, to the
next one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corrobora.llm.decontam import drop_contaminated
from corrobora.llm.durable import materialize
from corrobora.llm.jaccard import keep_one
from corrobora.llm.packing import pack
from corrobora.llm.pii import replace_pii
from corrobora.llm.quality import keep_good

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the repetition rules reject go.

    A null or empty text has no words and goes; a null doc_id or other column is
    kept as it is; each row is judged by itself, so repeated rows fare alike; an
    empty table gives none; extra columns stay, whatever their names.
    """
    return keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by 5-word shingles at a similarity of 0.8 or more the smallest doc_id stays.

    Rows without words (null, empty) all stay; a null doc_id stays only where its
    whole group has none; of rows that share the smallest doc_id and the text one
    stays, whichever; an empty table gives none; extra columns stay, whatever
    their names.
    """
    return keep_one(docs, k=5, num=80, den=100)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of a benchmark item go.

    A null or empty text holds none and stays; null doc_ids stay or go by their
    text; repeated rows fare alike; an empty table gives none and an empty
    benchmark takes none; extra columns stay, whatever their names.
    """
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts is replaced by surrogates, under the session's key.

    A null text stays null and an empty one empty; no row goes; repeated rows get
    equal texts; an empty table gives none; all other columns, whatever their
    names, stay as they are.
    """
    return replace_pii(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' tokens packed into sequences of 2048.

    A null text is an empty one: a piece of the end id alone; a null doc_id is
    kept; repeated rows are packed as often as they occur; an empty table gives
    none; other columns are not read.
    """
    return pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("packing", packing),
]

#: The stages hash, tokenise and pack; SQL can't express them.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
