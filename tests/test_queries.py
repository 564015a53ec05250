"""Every query with SQL gives the rows that the SQL gives; the others run."""

import os

import pytest

import __spark_entry__
from gridloom.plans import registry

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def rows(pdf, columns):
    plain = lambda v: None if v is None or v != v else int(v) if isinstance(v, float) and v == int(v) else v
    return sorted(str([plain(v) for v in r]) for r in pdf[columns].astype(object).where(pdf[columns].notna(), None).values.tolist())


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    got = registry.queries()[name](spark, DATA).toPandas()
    assert len(got), "a query that returns nothing shows nothing"
    if name in registry.oracle_sql():
        want = duck.sql(registry.oracle_sql()[name]).df()
        columns = sorted(got.columns)
        assert columns == sorted(want.columns)
        assert rows(got, columns) == rows(want, columns)


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["id", "idx"]
    assert set(registry.oracle_sql()) <= set(registry.queries())
