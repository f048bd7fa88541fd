"""Customer analyses on invented rows (one test per rule)."""

from __future__ import annotations

import pytest

from ledgerline import operators as ops
from ledgerline.params import RfmParams

from .conftest import d, line, make_tables


def _by_id(df, key="CustomerID"):
    return {r[key]: r for r in df.collect()}


@pytest.mark.parametrize("shared", [False, True])
def test_order_without_lines_counts_in_rfm_but_not_in_churn(spark, shared):
    lines = [line(1, 1, 10, 1), line(2, 1, 20, 1), line(3, 1, 5, 2)]
    orders = [(1, "A", d("2020-01-01")), (2, "A", d("2020-02-01")), (3, "B", d("2020-01-15")),
              (4, "B", d("2020-03-01")),          # B's newest order has no lines
              (5, "A", d("2020-01-10"))]          # A: order without lines too
    t = make_tables(spark, lines, orders)
    if shared:
        t = ops.share_order_revenue(t)
    rfm = _by_id(ops.customer_rfm(t))
    assert rfm["A"].TotalOrders == 3 and rfm["A"].TotalRevenue == 30.0
    assert rfm["A"].AvgOrderValue == 10.0             # 30 / 3 orders (one of them empty)
    assert rfm["B"].LastPurchase == d("2020-03-01")   # set by the empty order
    assert rfm["B"].DaysSinceLastPurchase == 0        # reference = newest order of all
    churn = _by_id(ops.customer_churn(t))
    assert churn["B"].LastPurchaseDate == d("2020-01-15")   # empty order ignored
    assert churn["B"].DaysSinceLastPurchase == 46             # ... but sets the reference date
    assert churn["A"].TotalHistoricRevenue == 30.0


def test_single_order_customer_left_out_of_rfm_and_country_total(spark):
    lines = [line(1, 1, 100, 1), line(2, 1, 50, 1), line(3, 1, 7, 1)]
    orders = [(1, "A", d("2020-01-01")), (2, "A", d("2020-01-05")), (3, "C", d("2020-01-03"))]
    t = make_tables(spark, lines, orders)
    rfm = _by_id(ops.customer_rfm(t))
    assert set(rfm) == {"A"}
    assert rfm["A"].CountryTotalRevenue == 150.0 and rfm["A"].PctOfCountryRevenue == 100.0
    churn = _by_id(ops.customer_churn(t))
    assert churn["C"].AvgMonthlyRevenue is None          # first = last purchase
    assert churn["A"].AvgMonthlyRevenue == 1125.0        # 150 / (4 / 30)


def test_rank_and_dense_rank_with_ties(spark):
    lines = [line(o, 1, p, 1) for o, p in [(1, 50), (2, 50), (3, 50), (4, 50), (5, 30), (6, 30)]]
    orders = [(1, "X", d("2020-01-01")), (2, "X", d("2020-01-02")),
              (3, "Y", d("2020-01-01")), (4, "Y", d("2020-01-02")),
              (5, "Z", d("2020-01-01")), (6, "Z", d("2020-01-02"))]
    t = make_tables(spark, lines, orders)
    rank = {k: r.RevenueRank for k, r in _by_id(ops.customer_rfm(t)).items()}
    dense = {k: r.RevenueRank for k, r in _by_id(ops.customer_rfm(t, RfmParams(rank_method="dense_rank"))).items()}
    assert rank == {"X": 1, "Y": 1, "Z": 3}
    assert dense == {"X": 1, "Y": 1, "Z": 2}


def test_rfm_bucketed_path_matches_single(spark):
    lines, orders, customers = [], [], []
    oid = 0
    for c in range(60):
        cid = f"C{c:03d}"
        customers.append((cid, f"Co {c}", ["North", "South", None][c % 3], "Town"))
        for k in range(2 + c % 3):
            oid += 1
            orders.append((oid, cid, d(f"2020-0{1 + k}-1{c % 9}")))
            lines.append(line(oid, 1, 10 * (c % 7) + 5, 1 + k % 2))
    t = make_tables(spark, lines, orders, customers=customers)
    from ledgerline.params import WindowParams
    one, wp = WindowParams(buckets=1), WindowParams(direct_bytes=0, buckets=64, oversample=1)
    for method in ("rank", "dense_rank"):
        single = sorted(tuple(r) for r in ops.customer_rfm(t, RfmParams(rank_method=method), window=one).collect())
        bucketed = sorted(tuple(r) for r in ops.customer_rfm(t, RfmParams(rank_method=method), window=wp).collect())
        assert single == bucketed


def test_churn_thresholds(spark):
    # reference date = 2020-12-31 (customer R's order)
    orders = [(1, "R", d("2020-12-31")), (2, "A", d("2020-10-03")), (3, "B", d("2020-10-02")),
              (4, "C", d("2020-07-05")), (5, "D", d("2020-07-04"))]
    lines = [line(o, 1, 10, 1) for o in range(1, 6)]
    t = make_tables(spark, lines, orders)
    got = {k: (r.DaysSinceLastPurchase, r.ChurnRisk) for k, r in _by_id(ops.customer_churn(t)).items()}
    assert got["A"] == (89, "ACTIVE")
    assert got["B"] == (90, "AT RISK")
    assert got["C"] == (179, "AT RISK")
    assert got["D"] == (180, "LOST")


def test_null_order_dates_fall_to_active(spark):
    orders = [(1, "A", None), (2, "A", None)]
    t = make_tables(spark, [line(1, 1, 10, 1), line(2, 1, 10, 1)], orders)
    r = ops.customer_churn(t).first()
    assert r.DaysSinceLastPurchase is None and r.ChurnRisk == "ACTIVE"


def test_orphan_audit_finds_missing_customers(spark):
    orders = [(1, "A", d("2020-01-01")), (2, "GHOST", d("2020-01-02")), (3, "GHOST", d("2020-01-05"))]
    lines = [line(o, 1, 10, 1) for o in (1, 2, 3)]
    t = make_tables(spark, lines, orders, customers=[("A", "Co A", "Land", "Town")])
    rows = ops.orphan_customers(t).collect()
    assert [(r.CustomerID, r.Orders) for r in rows] == [("GHOST", 2)]
    # ... and orphans are dropped from the customer analyses
    assert {r.CustomerID for r in ops.customer_churn(t).collect()} == {"A"}
    assert {r.CustomerID for r in ops.customer_concentration(t).collect()} == {"A"}
