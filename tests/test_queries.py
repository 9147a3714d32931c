"""Every registered query of the library against its SQL, on the smallest tables."""

import os

import pandas as pd
import pytest

from palimpsest import plans

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def plain(value):
    if value is None or value is pd.NA or value != value:
        return None
    if hasattr(value, "item"):
        value = value.item()
    if isinstance(value, float) and value == int(value):
        return int(value)
    return str(value) if not isinstance(value, (int, float, str, bool)) else value


def rows(frame):
    columns = sorted(frame.columns)
    return sorted(repr(tuple(plain(v) for v in r)) for r in frame[columns].astype(object).itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query_matches_sql(spark, duck, name):
    got = plans.QUERIES[name](spark, DATA).toPandas()
    want = duck.execute(plans.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
