"""Corpus queries with an oracle give the rows of its SQL."""

import os

import duckdb
import pytest

from isochron.llm import queries
from tests.test_oracles import canonical, close

SF = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data here")


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_rows(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    found = queries.queries()[name](spark, SF).toPandas()
    wanted = con.sql(queries.ORACLE_SQL[name]).df()
    assert sorted(found.columns) == sorted(wanted.columns)
    a, b = canonical(found), canonical(wanted)
    assert len(a) == len(b)
    assert all(all(map(close, x, y)) for x, y in zip(a, b, strict=True))
