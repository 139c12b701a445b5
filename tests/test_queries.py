"""Every registered query runs, and those with SQL give its rows."""

import duckdb
import pytest

import __spark_entry__
from corrobora import plans

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def cell(v):
    return "null" if v is None or v != v else repr(round(v, 9)) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, sf_dir, con, name):
    query, sql = plans.QUERIES[name]
    frame = query(spark, sf_dir)
    columns = sorted(frame.columns)
    got = sorted(tuple(cell(v) for v in r) for r in frame.select(*columns).collect())
    assert got or name in ("compare_flips_filtered", "sweep_dedup")
    if sql:
        cursor = con.execute(sql)
        names = [d[0] for d in cursor.description]
        assert sorted(names) == columns
        order = [names.index(c) for c in columns]
        assert sorted(tuple(cell(r[i]) for i in order) for r in cursor.fetchall()) == got


def test_whole_texts_and_all_rows_are_read(spark, tmp_path):
    rows = [(1, "\n".join(f"line {i} of a text" for i in range(7))), (2, "short"), (3, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = plans.QUERIES["citation_extract"][0](spark, str(tmp_path)).groupBy("doc_id").count().collect()
    assert {int(r[0]): r[1] for r in found}[1] == 14
    assert {r["doc_id"] for r in plans.QUERIES["quote_normalized"][0](spark, str(tmp_path)).collect()} == {1, 2, 3}


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(plans.QUERIES) <= set(__spark_entry__.queries()) and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
