"""Concentration / HHI on invented rows, plus invariants on the driver data."""

from __future__ import annotations

import os

import pytest

from ledgerline import operators as ops
from ledgerline.params import WindowParams
from ledgerline.sources.tpch import tpch_tables

from .conftest import TESTDATA, d, line, make_tables


def _tables(spark, revenues):
    lines, orders = [], []
    for i, rev in enumerate(revenues, start=1):
        orders.append((i, f"C{i:02d}", d("2020-01-01")))
        lines.append(line(i, 1, rev, 1))
    return make_tables(spark, lines, orders)


def test_shares_contributions_and_segments(spark):
    t = _tables(spark, [500, 300, 100, 50, 50])
    rows = ops.customer_concentration(t).collect()
    assert [r.CustomerID for r in rows] == ["C01", "C02", "C03", "C04", "C05"]
    assert [r.RevenueSharePct for r in rows] == [50.0, 30.0, 10.0, 5.0, 5.0]
    assert [r.RevenueShareSq for r in rows] == [0.25, 0.09, 0.01, 0.0025, 0.0025]
    assert [r.HHI_Contribution for r in rows] == [2500.0, 900.0, 100.0, 25.0, 25.0]
    assert [r.AccumulatedSharePct for r in rows] == [50.0, 80.0, 90.0, 95.0, 100.0]
    # 5 customers -> tiles 1..5: TOP, then MIDDLE for tiles 2..5
    assert [r.CustomerSegment for r in rows] == ["TOP 10%"] + ["MIDDLE 40%"] * 4
    assert rows[0].TotalRevenue == 1000.0
    hhi = ops.hhi_summary(t).first()
    assert hhi.TotalHHI == 3550.0 and hhi.ExactHHI == 3550.0 and hhi.HHIBand == "CRITICAL"
    pareto = {r.ThresholdPct: r.CustomersToReach for r in ops.pareto_cutoff(t).collect()}
    assert pareto == {50.0: 1, 80.0: 2, 90.0: 3}


def test_share_rounding_chain(spark):
    # 1/3 each: share 33.3333, square 0.111111 (fraction), contribution 1111.1089
    t = _tables(spark, [10, 10, 10])
    r = ops.customer_concentration(t).first()
    assert (r.RevenueSharePct, r.RevenueShareSq, r.HHI_Contribution) == (33.3333, 0.111111, 1111.1089)
    assert ops.customer_concentration(t).collect()[-1].AccumulatedSharePct == 100.0   # 99.9999 shown


def test_bucketed_matches_single_with_ties(spark):
    t = _tables(spark, [5, 5, 5, 9, 9, 1, 2, 3, 3, 3, 3, 8, 7, 7, 7, 7, 7, 6, 5, 4, 4, 4, 2, 1])
    single = [tuple(r) for r in ops.customer_concentration(t, window=WindowParams(buckets=1)).collect()]
    wp = WindowParams(direct_bytes=0, buckets=64, oversample=1)
    bucketed = [tuple(r) for r in ops.customer_concentration(t, window=wp).collect()]
    assert single == bucketed


@pytest.mark.skipif(not os.path.exists(f"{TESTDATA}/sf0.01"), reason="driver data absent")
def test_invariants_on_driver_data(spark):
    t = tpch_tables(spark, f"{TESTDATA}/sf0.01")
    rows = ops.customer_concentration(t).collect()
    n = len(rows)
    counts = {}
    for r in rows:
        counts[r.CustomerSegment] = counts.get(r.CustomerSegment, 0) + 1
    assert sum(counts.values()) == n
    q, rem = divmod(n, 10)
    assert counts["TOP 10%"] == q + (1 if rem else 0)
    # accumulated share is non-decreasing and ends at the sum of shown shares
    accs = [r.AccumulatedSharePct for r in rows]
    assert accs == sorted(accs)
    # cumulative revenue of the last month equals the sum of all months (exact decimals)
    growth = ops.monthly_growth(t).collect()
    from decimal import Decimal
    total = sum(Decimal(str(r.MonthlyRevenue)) for r in growth)
    assert abs(Decimal(str(growth[-1].CumulativeRevenue)) - total) <= Decimal("0.01") * len(growth)
