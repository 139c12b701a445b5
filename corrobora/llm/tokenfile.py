"""Token ids as Parquet list columns, written in ascending doc_id order.

One file per range of doc_id: ``doc_id``, ``n_tokens`` and ``local_start`` for
metadata reads, ``ids`` as a list of 32-bit integers. Parquet's second writer
version delta-encodes integers and a dictionary is kept for ids where it pays;
row-group and page sizes are parameters, and page indexes let a reader skip to
the pages of a doc_id. Documents are range-partitioned and sorted before they
are encoded, so texts are shuffled once, compressed, and encoded once.

Defined results: a null text is an empty one and has the end id alone; null
doc_ids come first; rows with one doc_id stand side by side, ordered by the first
``PREFIX`` characters of the text, and may lie in several files;
an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corrobora.llm.arrowtext import blocks, buffers, gives_back
from corrobora.llm.durable import new_path

#: Characters of the text that order rows of one doc_id.
PREFIX = 16

FILE = "part int, row long, doc_id long, local_start long, n_tokens int, ids array<int>"


def _encode(vocabulary: str, end_id: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    @gives_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        from corrobora.llm.bpe import encoder

        own, part, done, row = encoder(vocabulary), TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            for i, j in blocks(offsets):
                flat, rows = own.encode(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                n = np.diff(rows) + 1
                ends = np.cumsum(n)
                ids = np.empty(int(ends[-1]), np.int32)
                last = np.zeros(len(ids), dtype=bool)
                last[ends - 1] = True
                ids[last] = end_id
                ids[~last] = flat.astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(ids))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(j - i, part, np.int32)), pa.array(np.arange(row, row + j - i, dtype=np.int64)),
                        batch.column("doc_id").slice(i, j - i), pa.array(done + ends - n), pa.array(n.astype(np.int32)), lists,
                    ],
                    ["part", "row", "doc_id", "local_start", "n_tokens", "ids"],
                )
                done, row = done + int(ends[-1]), row + j - i

    return run


def write_tokens(docs: DataFrame, path: str, vocabulary: str = "word_bpe_49k.json", end_id: int = 2, files: int | None = None, row_group_bytes: int = 32 << 20, page_bytes: int = 256 << 10) -> None:
    """Writes the ids of every text and the end id to ``path``."""
    spark = docs.sparkSession
    files = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.substring("text", 1, PREFIX).alias("prefix"), F.monotonically_increasing_id().alias("row"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("prefix").asc_nulls_first(), F.col("row")]  # a doc_id used very often is split too
    ordered = slim.repartitionByRange(files, *order).sortWithinPartitions(*order).select("doc_id", "text")
    (
        ordered.mapInArrow(_encode(vocabulary, end_id), FILE)
        .write.option("parquet.writer.version", "v2").option("parquet.block.size", str(row_group_bytes)).option("parquet.page.size", str(page_bytes))
        .option("parquet.enable.dictionary", "true").option("parquet.page.write-checksum.enabled", "true").option("compression", "zstd")
        .parquet(path)
    )


@gives_back
def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("ids")
        offs, values = lists.offsets.to_numpy(), lists.values.to_numpy().astype("<u4")
        crc = [zlib.crc32(values[a:b]) for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("part"), batch.column("doc_id"), batch.column("local_start"), pa.array(np.diff(offs).astype(np.int64)), pa.array(crc, pa.int64())],
            ["part", "doc_id", "local_start", "n_tokens", "ids_crc32"],
        )


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The files' rows: doc_id, ids and metadata. Selecting metadata alone leaves the ids unread."""
    return spark.read.schema(FILE).parquet(path)


def token_index(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and the crc32 of the ids, read from the files."""
    table = read_tokens(spark, path)
    sums = table.groupBy("part").agg(F.sum(F.col("n_tokens").cast("long")).alias("n"))  # a row per file
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    read = table.select("part", "doc_id", "local_start", "ids").mapInArrow(_sums, "part int, doc_id long, local_start long, n_tokens long, ids_crc32 long")
    return read.join(base, "part").select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")


def tokenize_to_files(docs: DataFrame, vocabulary: str = "word_bpe_49k.json", end_id: int = 2) -> DataFrame:
    """Writes the token files to the shared folder and returns their index, read back."""
    path = new_path(docs.sparkSession, "tokens")
    write_tokens(docs, path, vocabulary, end_id)
    return token_index(docs.sparkSession, path)
