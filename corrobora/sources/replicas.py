"""Database replicas by JDBC, and their credentials."""

from __future__ import annotations

import configparser

from pyspark.sql import DataFrame, SparkSession

#: Clusters and the domains of their hosts.
CLUSTERS = {"web": "web.db.svc.wikimedia.cloud", "analytics": "analytics.db.svc.wikimedia.cloud"}


def host_name(database: str, cluster: str = "analytics") -> str:
    if cluster not in CLUSTERS:
        raise ValueError(f"unknown cluster: {cluster} (known: {', '.join(CLUSTERS)})")
    return f"{database}.{CLUSTERS[cluster]}"


def database_name(database: str) -> str:
    return f"{database}_p"


def credentials(text: str) -> dict[str, str]:
    """User and password of the [client] section; quotes around values go."""
    parser = configparser.RawConfigParser(comment_prefixes=("#", ";"), strict=False, allow_no_value=True)
    parser.read_string(text)
    found = {k: (parser.get("client", k, fallback=None) or "").strip().strip("\"'") for k in ("user", "password")}
    if missing := [k for k, v in found.items() if not v]:
        raise ValueError(f"the [client] section lacks {' and '.join(missing)}")
    return found


def read_query(spark: SparkSession, database: str, query: str, login: dict[str, str], cluster: str = "analytics", driver: str = "org.mariadb.jdbc.Driver") -> DataFrame:
    """The rows of a query that the replica runs; filters and limits belong in the query."""
    url = f"jdbc:mariadb://{host_name(database, cluster)}:3306/{database_name(database)}"
    return spark.read.format("jdbc").options(url=url, query=query, user=login["user"], password=login["password"], driver=driver).load()
