"""Every registered query with SQL gives the rows that DuckDB gives."""

import os

import pytest

import __spark_entry__

SF = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in sorted(os.listdir(SF)):
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return c


OWN, SQL = __spark_entry__._own()


@pytest.mark.parametrize("name", sorted(OWN))
def test_query(spark, con, tmp_path, name):
    OWN[name](spark, SF).write.parquet(f"{tmp_path}/out")
    if name not in SQL:
        return
    columns = ", ".join(f'"{c}"' for c in spark.read.parquet(f"{tmp_path}/out").columns)
    ours, theirs = f"SELECT {columns} FROM '{tmp_path}/out/*.parquet'", f"SELECT {columns} FROM ({SQL[name]})"
    for a, b in ((ours, theirs), (theirs, ours)):
        assert con.sql(f"{a} EXCEPT ALL {b}").fetchall()[:3] == []


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_ridges_follow_every_embedding(spark):
    want = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id").distinct()
    got = OWN["ridges"](spark, SF).select("stroke").distinct()
    assert want.exceptAll(got).count() == 0 and want.count() == got.count()
