"""Tables written in the folder that all executors share.

``spark.checkpoint.dir`` names that folder; only where a session has none (as
in tests) a temporary one of this machine is used. A written table cuts the
lineage: a lost executor costs the tasks it had, never the stages before, and
calls that left the process are not made again. Tables go when the driver's
JVM ends.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; one of our own only where none is set."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        option = spark.sparkContext._jsc.sc().getCheckpointDir()
        named = option.get() if option.isDefined() else None
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir: a cluster's executors share no folder of this machine")
        app = spark.sparkContext.applicationId
        named = _OWN.setdefault(app, "file://" + tempfile.mkdtemp(prefix="corrobora-"))
    return named.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, deleted when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` once as Parquet in the shared folder and returns a scan of it."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Deletes a materialized table that no later action reads."""
    spark = df.sparkSession
    for file in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        where = spark._jvm.org.apache.hadoop.fs.Path(file)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
