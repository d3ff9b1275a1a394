"""Every catalogue query with SQL gives the rows that DuckDB gives."""

import duckdb
import pytest

from factloom.plans import catalog, records, rules  # noqa: F401 - both add their queries

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return c


def rows(df):
    cols = sorted(df.columns)
    said = df[cols].map(lambda v: "null" if v is None or v != v else f"{v:.6f}" if isinstance(v, float) else str(v))
    return sorted(map(tuple, said.to_numpy().tolist()))


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_matches_sql(spark, duck, name):
    got = catalog.QUERIES[name](spark, DIR).toPandas()
    want = duck.sql(catalog.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry_module(spark):
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0
