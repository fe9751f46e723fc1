"""Every query that has SQL gives the SQL's rows on the smallest tables."""

import math
import os

import duckdb
import numpy as np
import pytest

from mosaiq.oracles import ORACLES
from mosaiq.queries import QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def rows(pdf):
    def plain(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return "-"
        return tuple(v) if isinstance(v, (list, np.ndarray)) else v

    return sorted((tuple(plain(v) for v in r) for r in pdf[sorted(pdf.columns)].itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, duck, name):
    got, want = QUERIES[name](spark, DATA).toPandas(), duck.sql(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
