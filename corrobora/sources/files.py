"""Files of rows: envelopes, logs, tables and reports."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corrobora.operators.ranks import numbered, ordered
from corrobora.sources.shared import materialize, new_path


def read_rows(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Rows of a JSON file that is an array of rows, or an object with them under ``rows``; else none."""
    bare = spark.read.schema(schema).option("multiLine", True).json(path)
    wrapped = spark.read.schema(T.StructType([T.StructField("rows", T.ArrayType(schema))])).option("multiLine", True).json(path)
    inner = wrapped.where(F.col("rows").isNotNull()).select(F.explode("rows").alias("r")).select("r.*")
    some = F.lit(False)
    for f in schema.fieldNames():
        some = some | F.col(f).isNotNull()
    return inner.unionByName(bare.where(some))


def read_metadata(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The one row of an envelope's metadata; no row for a bare array."""
    own = T.StructType([T.StructField("metadata", schema)])
    return spark.read.schema(own).option("multiLine", True).json(path).where(F.col("metadata").isNotNull()).select("metadata.*")


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """One object a line; blank lines are skipped, a malformed one fails the job."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


LOG = "wiki string, revid long, old_revid long, pageid long, title string, user string, timestamp string, comment string, size_delta int, is_new_page boolean, is_minor boolean, first_seen string"


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(str(path))
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def listed(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, in order; none where there is no folder."""
    where = spark._jvm.org.apache.hadoop.fs.Path(str(path))
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in fs.listStatus(where)) if fs.exists(where) and fs.getFileStatus(where).isDirectory() else []


def touch(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(str(path))
    where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where, True).close()


def delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(str(path))
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


#: The day of log rows without a timestamp, before all others.
NO_DAY = "0000-00-00"


def _by_day(spark: SparkSession, path: str) -> bool:
    return any(name.startswith("day=") for name in listed(spark, path))


def read_log(spark: SparkSession, path: str, since: str | None = None) -> DataFrame:
    """An edit log of one object a line; empty where there is no file.

    ``since`` leaves the files of earlier days unread, but for rows without a
    timestamp; a log that isn't kept by days is read whole.
    """
    if not exists(spark, path):
        return spark.createDataFrame([], LOG)
    if not _by_day(spark, path):
        return spark.read.schema(LOG).json(path)
    days = spark.read.schema(LOG + ", day string").json(path)
    return (days.where((F.col("day") >= since) | (F.col("day") == NO_DAY)) if since else days).drop("day")


def write_log(log: DataFrame, path: str) -> None:
    """The log sorted by (timestamp, wiki, revid), keys in order: a folder a day, whose files follow each other by name.

    A day with many rows fills many files, each with a range of the order, so no
    task sees a whole day; only the days that ``log`` has are written.
    """
    columns = sorted(log.columns)
    day = F.substring(F.coalesce(F.nullif("timestamp", F.lit("")), F.lit(NO_DAY)), 1, 10)
    order = ["day", F.coalesce("timestamp", F.lit("")), F.coalesce("wiki", F.lit("")), F.coalesce("revid", F.lit(0))]
    placed = log.withColumn("day", day).repartitionByRange(*order).sortWithinPartitions(*order)
    lines = placed.select("day", F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("value"))
    lines.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").text(path)


def merge_log(fresh: DataFrame, path: str) -> None:
    """Sorts new rows into the log; days without a new row are neither read nor written.

    What is written is put in the shared folder first, since its days are read
    from where they go. A log in one file or without days is rewritten by days.
    """
    spark = fresh.sparkSession
    if not _by_day(spark, path):
        write_log(read_log(spark, path).unionByName(fresh), f"{path}.days")
        delete(spark, path)
        made, where = (spark._jvm.org.apache.hadoop.fs.Path(str(p)) for p in (f"{path}.days", path))
        made.getFileSystem(spark._jsc.hadoopConfiguration()).rename(made, where)
        return
    day = F.substring(F.coalesce(F.nullif("timestamp", F.lit("")), F.lit(NO_DAY)), 1, 10)
    days = [r[0] for r in fresh.select(day).distinct().collect()]  # at most one row a calendar day
    old = spark.read.schema(LOG + ", day string").json(path).where(F.col("day").isin(days)).drop("day")
    write_log(materialize(old.unionByName(fresh), "log"), path)


def _split(line: str) -> list[str]:
    """Cells of a line in the older cutting: every quote toggles, so a doubled one vanishes."""
    cells, cell, inside = [], [], False
    for c in line:
        if c == '"':
            inside = not inside
        elif c == "," and not inside:
            cells.append("".join(cell).strip())
            cell = []
        else:
            cell.append(c)
    return [*cells, "".join(cell).strip()]


def read_csv(spark: SparkSession, path: str, compatible: bool = False) -> DataFrame:
    """A table with a header; cells are trimmed and missing ones are ''.

    ``compatible`` keeps the older cutting of cells, without quotes inside
    quotes and without cells over several lines, and adds ``_row``, the number
    of each line in its file.
    """
    if not compatible:
        table = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
        return table.select(*(F.coalesce(F.trim(c), F.lit("")).alias(c) for c in table.columns))
    lines = spark.read.text(path, wholetext=True)
    header = _split(spark.read.text(path).first()[0])

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for whole in frame["value"]:
                rows = [(i, _split(x)) for i, x in enumerate(whole.split("\n")) if i and x.strip()]
                yield pd.DataFrame([[*(c[: len(header)] + [""] * (len(header) - len(c))), i] for i, c in rows], columns=[*header, "_row"])

    return lines.mapInPandas(cut, ", ".join(f"`{h}` string" for h in header) + ", _row long")


def write_rows(rows: DataFrame, path: str, metadata: dict) -> None:
    """An envelope ``{metadata, rows}`` in one file, a line a row in the rows' order.

    Tasks write the lines; their files are copied behind each other buffer by
    buffer, so the driver never holds the rows. The new file takes the old one's
    place by a rename: a crash leaves the one or the other.
    """
    spark = rows.sparkSession
    jvm, conf, lines = spark._jvm, spark._jsc.hadoopConfiguration(), new_path(spark, "lines")
    rows.select(F.to_json(F.struct("*")).alias("value")).write.option("lineSep", ",\n").text(lines)
    folder, where, staged = (jvm.org.apache.hadoop.fs.Path(p) for p in (lines, path, path + ".tmp"))
    source, fs = folder.getFileSystem(conf), where.getFileSystem(conf)
    files = sorted(((s.getPath().getName(), s.getLen(), s.getPath()) for s in source.listStatus(folder) if s.getLen() and s.getPath().getName().startswith("part-")), key=lambda x: x[0])
    out = fs.create(staged, True)
    out.write(bytearray(f'{{"metadata": {json.dumps(metadata, ensure_ascii=False)},\n"rows": [\n'.encode()))
    for i, (_, size, file) in enumerate(files):
        lines_of = source.open(file)
        jvm.org.apache.commons.io.IOUtils.copyLarge(lines_of, out, 0, size - 2 * (i == len(files) - 1))  # no comma after the last row
        lines_of.close()
    out.write(bytearray(b"\n]}\n"))
    out.close()
    source.delete(folder, True)
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(where.toUri(), conf).rename(fs.makeQualified(staged), fs.makeQualified(where), options)


REVIEW = ["id", "article_title", "citation_number", "occurrence", "claim_text", "source_url", "source_text_preview", "ground_truth", "dataset_version", "extraction_status", "needs_manual_review", "manual_claim_override", "manual_source_override"]


def review_table(dataset: DataFrame) -> DataFrame:
    """The 13 columns of the review file; quotes are doubled in the claim and the preview, which are cut to 500 and 200."""

    def quoted(c: str, most: int, tail: str = "") -> F.Column:
        return F.concat(F.lit('"'), F.substring(F.replace(F.coalesce(c, F.lit("")), F.lit('"'), F.lit('""')), 1, most), F.lit(tail + '"'))

    made = {
        "claim_text": quoted("claim_text", 500), "source_text_preview": quoted("source_text", 200, "..."), "dataset_version": F.coalesce("dataset_version", F.lit("v1")),
        "manual_claim_override": F.lit(""), "manual_source_override": F.lit(""),
    }
    return dataset.select(*(made.get(c, F.col(c) if c in dataset.columns else F.lit("")).cast("string").alias(c) for c in REVIEW))


def review_lines(dataset: DataFrame) -> DataFrame:
    """The review file's lines, without its header."""
    table = review_table(dataset)
    return table.select(F.concat_ws(",", *(F.coalesce(c, F.lit("")) for c in REVIEW)).alias("value"))


def checksum(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One digest of a table, whatever its order: of the sorted digests of its rows in 256 groups, and of these."""
    line = F.sha2(F.to_json(F.struct(*sorted(rows.columns)), {"ignoreNullFields": "false"}), 256)
    parts = rows.select(line.alias("h")).groupBy(F.substring("h", 1, 2).alias("p")).agg(F.sum(F.conv(F.substring("h", 3, 12), 16, 10).cast("decimal(38,0)")).alias("s"), F.count("*").alias("n"))
    return parts.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "s", "n"))), lambda x: F.concat_ws(":", x["p"], x["s"].cast("string"), x["n"].cast("string"))), ","), 256).alias("checksum"))


def ordered_checksum(rows: DataFrame, order: Sequence[str], fan: int = 4096) -> DataFrame:
    """One digest of a table in an order, so that a row at another place is seen as well as another row.

    Rows' digests (of their JSON, nulls named) are joined ``fan`` consecutive ones
    at a time and digested, and so on until one is left; an empty table has the
    digest of nothing. Places come from ranges of the order, nulls first, ties by
    the digest, so the result depends on no partitioning and no task sees more
    than a range or ``fan`` digests.
    """
    line = F.sha2(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}), 256)
    keyed = rows.select(F.lit("").alias("all"), F.struct(*(F.col(c) for c in order)).alias("by"), line.alias("h"))
    keys = [F.col(f"by.{c}").asc_nulls_first() for c in order]
    level = numbered(*ordered(keyed, "all", [*keys, F.col("h")]), "all").select("node", "h")
    while True:
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node", "h"))), lambda x: x["h"]), "")
        level = materialize(level.groupBy(F.expr(f"node div {fan}").alias("node")).agg(F.sha2(joined, 256).alias("h")), "digests")
        if level.count() <= 1:
            return level.agg(F.coalesce(F.max("h"), F.sha2(F.lit(""), 256)).alias("checksum"))
