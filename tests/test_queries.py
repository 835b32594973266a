"""Each reference query against its SQL on the smallest tables."""

import duckdb
import pytest

from lodestar.plans.queries import QUERIES, SQL

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_as_sql(spark, duck, name):
    got = QUERIES[name](spark, DATA).toPandas()
    want = duck.execute(SQL[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    plain = lambda df: sorted(map(str, df[columns].itertuples(index=False, name=None)))
    assert plain(got) == plain(want)


def test_entry_module():
    import __spark_entry__ as e

    assert set(SQL) <= set(e.oracle_sql())
    assert set(QUERIES) <= set(e.queries())
