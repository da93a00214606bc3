"""Every query against its SQL twin, and the shape of the driver contract."""

import math

import duckdb
import pytest

from rigspan.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def rows(df):
    df = df[sorted(df.columns)]
    clean = lambda x: None if x is None or (isinstance(x, float) and math.isnan(x)) else f"{x:.9g}" if isinstance(x, float) else str(x)
    return sorted(tuple(str(clean(x)) for x in r) for r in df.astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF).toPandas()
    want = duck.execute(catalog.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 4


def test_every_query_without_sql_runs(spark):
    for name in set(catalog.QUERIES) - set(catalog.ORACLE_SQL):
        assert catalog.QUERIES[name](spark, SF).count() > 0, name
