"""Every query with an oracle gives the rows of its SQL on the smallest tables."""

import os

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry
from isochron import queries as readings

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def canonical(df: pd.DataFrame) -> list[tuple]:
    def cell(x):
        if pd.api.types.is_scalar(x) and pd.isna(x):
            return "null"
        if isinstance(x, (bool, np.bool_)):
            return str(bool(x))
        if isinstance(x, (int, float)) or hasattr(x, "dtype"):
            return f"{float(x) + 0.0:.5f}"
        return str(x)

    return sorted(tuple(cell(x) for x in row) for row in df[sorted(df.columns)].itertuples(index=False))


def close(a: str, b: str) -> bool:
    if a == b:
        return True
    try:
        return abs(float(a) - float(b)) <= 2e-4
    except ValueError:
        return False


@pytest.mark.parametrize("name", sorted(readings.oracle_sql()))
def test_same_rows(spark, duck, name):
    found = readings.queries()[name](spark, SF).toPandas()
    wanted = duck.sql(readings.oracle_sql()[name]).df()
    assert sorted(found.columns) == sorted(wanted.columns)
    a, b = canonical(found), canonical(wanted)
    assert len(a) == len(b)
    assert all(all(map(close, x, y)) for x, y in zip(a, b, strict=True))


@pytest.mark.parametrize("name", sorted(set(readings.queries()) - set(readings.oracle_sql())))
def test_others_give_rows(spark, name):
    assert readings.queries()[name](spark, SF).count() > 0


def test_entry_and_keys(spark):
    assert entry.entry(spark).count() == 5
    assert set(entry.oracle_sql()) <= set(entry.queries())
