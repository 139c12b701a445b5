"""Splits of a corpus: from a local clone, else a disk cache, else an injected download."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corrobora.sources.files import read_jsonl
from corrobora.sources.shared import new_path


def locate(name: str, local: str | None, cache: str, download: Callable[[str], str] | None = None) -> str:
    """The path of a corpus file. A downloaded file is put into the cache whole or not at all."""
    if local and os.path.exists(path := os.path.join(local, name)):
        return path
    path = os.path.join(cache, name)
    if os.path.exists(path):
        return path
    if download is None:
        raise FileNotFoundError(f"{name} is neither in {local or 'a local clone'} nor in {cache}, and there is no download")
    text = download(name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    handle, staged = tempfile.mkstemp(dir=os.path.dirname(path))
    with os.fdopen(handle, "w", encoding="utf-8") as f:
        f.write(text)
    os.replace(staged, path)
    return path


def reachable(spark: SparkSession, path: str, copied: bool | None = None) -> str:
    """The file where every executor can read it: a cluster's gets a copy in the shared folder, a local master reads it in place."""
    if copied is None:
        copied = not spark.sparkContext.master.startswith("local")
    if not copied:
        return path
    target = f"{new_path(spark, 'corpus')}/{os.path.basename(path)}"
    own, there = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (f"file://{os.path.abspath(path)}", target))
    there.getFileSystem(spark._jsc.hadoopConfiguration()).copyFromLocalFile(own, there)
    return target


def load_splits(spark: SparkSession, splits: Sequence[str], schema: T.StructType, pattern: str, local: str | None, cache: str, download: Callable[[str], str] | None = None) -> DataFrame:
    """All rows of several splits with a column ``split``; ``pattern`` names a split's file, such as ``claim/{split}.jsonl``."""
    tables = [read_jsonl(spark, reachable(spark, locate(pattern.format(split=s), local, cache, download)), schema).withColumn("split", F.lit(s)) for s in splits]
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out
