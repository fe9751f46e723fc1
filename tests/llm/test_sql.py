"""The corpus queries that have SQL give the SQL's rows."""

import os

import duckdb
import pandas as pd
import pytest

from mosaiq.llm.oracles import ORACLES
from mosaiq.llm.queries import QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


def rows(pdf):
    return sorted((tuple("-" if pd.isna(v) else v for v in r) for r in pdf[sorted(pdf.columns)].itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "labels", "conversations"):
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    got, want = QUERIES[name](spark, DATA).toPandas(), con.sql(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    as_float = lambda d: d.astype({c: float for c in d.columns if str(d[c].dtype).lower() in ("int64", "float64")})
    assert rows(as_float(got)) == rows(as_float(want))
