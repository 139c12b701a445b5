"""A session with the settings that the library expects; all may be set otherwise by the cluster."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "corrobora", **settings: str) -> SparkSession:
    builder = SparkSession.builder.appName(name)
    defaults = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.ui.showConsoleProgress": "false"}
    for key, value in (defaults | settings).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
