"""Registered queries of this subpackage on the smallest tables, against their SQL."""

import duckdb
import pytest

from corrobora.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_oracle(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    cursor = con.execute(ORACLE_SQL[name])
    names = [d[0] for d in cursor.description]
    frame = QUERIES[name](spark, sf_dir)
    assert sorted(frame.columns) == sorted(names)
    assert sorted(map(str, (tuple(r) for r in frame.select(*names).collect()))) == sorted(map(str, cursor.fetchall()))
