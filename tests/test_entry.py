"""Driver contract: entry, queries and oracle, compared on the smallest data."""

from __future__ import annotations

import datetime as dt
import os

import duckdb
import pytest

import __spark_entry__ as E

from .conftest import TESTDATA

SF = f"{TESTDATA}/sf0.001"
OWN = sorted(set(E.queries()) - set(E.LLM_QUERIES))   # the optional subpackage has tests of its own
pytestmark = pytest.mark.skipif(not os.path.exists(SF), reason="driver data absent")


def test_entry_returns_rows(spark):
    df = E.entry(spark)
    assert df.count() == 80
    assert df.columns == ["Year", "Month", "MonthlyRevenue", "PrevMonthRevenue", "RevenueGrowthPct",
                          "CumulativeRevenue", "MovingAvg3Months"]


def test_every_query_has_an_oracle():
    assert set(OWN) == set(E.oracle_sql()) - set(E.LLM_ORACLE_SQL)


def _norm(v):
    if v is None:
        return ""
    if isinstance(v, float):
        return repr(v)
    if isinstance(v, (dt.date, dt.datetime)):
        return v.isoformat()[:10]
    return str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("region nation customer supplier part orders lineitem").split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", OWN)
def test_query_matches_oracle(spark, duck, name):
    sdf = E.queries()[name](spark, SF)
    res = duck.execute(E.oracle_sql()[name])
    dcols = [c[0] for c in res.description]
    assert sorted(sdf.columns) == sorted(dcols)
    srows = sorted(tuple(_norm(r[c]) for c in sorted(sdf.columns)) for r in sdf.collect())
    idx = [dcols.index(c) for c in sorted(dcols)]
    drows = sorted(tuple(_norm(r[i]) for i in idx) for r in res.fetchall())
    assert srows == drows
