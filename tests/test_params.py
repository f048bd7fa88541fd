"""Non-default parameters reach the operators."""

from __future__ import annotations

from ledgerline import operators as ops
from ledgerline.params import CalendarParams, ChurnParams, ConcentrationParams, RfmParams, TrendParams

from .conftest import d, line, make_tables


def _customers(spark):
    orders = [(1, "R", d("2020-12-31")), (2, "A", d("2020-12-01")), (3, "B", d("2020-11-01")),
              (4, "A", d("2020-06-01"))]
    lines = [line(1, 1, 100, 1), line(2, 1, 30, 1), line(3, 1, 20, 1), line(4, 1, 10, 1)]
    return make_tables(spark, lines, orders)


def test_churn_thresholds_are_parameters(spark):
    t = _customers(spark)
    got = {r.CustomerID: r.ChurnRisk for r in ops.customer_churn(t, ChurnParams(lost_days=60, at_risk_days=20)).collect()}
    assert got == {"R": "ACTIVE", "A": "AT RISK", "B": "LOST"}


def test_min_orders_is_a_parameter(spark):
    t = _customers(spark)
    assert {r.CustomerID for r in ops.customer_rfm(t, RfmParams(min_orders=1)).collect()} == {"R", "A", "B"}
    assert {r.CustomerID for r in ops.customer_rfm(t).collect()} == {"A"}


def test_trend_thresholds_and_top_n(spark):
    products = [(1, "P1", 1), (2, "P2", 1)]
    lines = [line(1, 1, 100, 1), line(2, 1, 110, 1), line(1, 2, 50, 1), line(2, 2, 40, 1)]
    orders = [(1, "A", d("2021-01-05")), (2, "A", d("2021-02-05"))]
    t = make_tables(spark, lines, orders, products=products)
    p = TrendParams(sharp_decline_below=-15.0, growing_above=5.0, top_n=1, top_label="BEST")
    rows = {(r.ProductName, r.Month): r for r in ops.product_trend(t, p).collect()}
    assert rows[("P1", 2)].TrendAlert == "GROWING"          # +10 % > 5
    assert rows[("P2", 2)].TrendAlert == "SHARP DECLINE"    # -20 % < -15
    assert rows[("P1", 1)].Top3Flag == "BEST" and rows[("P2", 1)].Top3Flag is None
    assert {r.ProductName for r in ops.product_top(t, p).collect()} == {"P1"}


def test_segments_band_and_pareto_parameters(spark):
    lines = [line(i, 1, rev, 1) for i, rev in enumerate([500, 300, 200], start=1)]
    orders = [(i, f"C{i}", d("2020-01-01")) for i in (1, 2, 3)]
    t = make_tables(spark, lines, orders)
    p = ConcentrationParams(tiles=3, top_tiles=1, middle_tiles=2, top_label="A", middle_label="B",
                            bottom_label="C", healthy_below=4000.0, critical_above=5000.0,
                            pareto_thresholds=(50.0, 99.0), band_from="reported")
    assert [r.CustomerSegment for r in ops.customer_concentration(t, p).collect()] == ["A", "B", "C"]
    assert ops.hhi_summary(t, p).first().HHIBand == "HEALTHY"             # 3800 < 4000
    assert {r.ThresholdPct: r.CustomersToReach for r in ops.pareto_cutoff(t, p).collect()} == {50.0: 1, 99.0: 3}


def test_week_start_is_a_parameter(spark):
    t = make_tables(spark, [line(1, 1, 1, 1)], [(1, "A", d("2024-03-03"))])   # a Sunday
    sunday = ops.calendar_for(t).first()
    monday = ops.calendar_for(t, CalendarParams(week_start="monday")).first()
    assert (sunday["Day of Week"], monday["Day of Week"]) == (0, 6)


def test_trend_series_by_category_and_name(spark):
    # one product name in two categories: by name alone the series interleave
    products = [(1, "Mug", 1), (2, "Mug", 2)]
    categories = [(1, "Kitchen"), (2, "Office")]
    lines = [line(1, 1, 10, 1), line(2, 2, 50, 1), line(3, 1, 20, 1)]
    orders = [(1, "A", d("2021-01-05")), (2, "A", d("2021-02-05")), (3, "A", d("2021-03-05"))]
    t = make_tables(spark, lines, orders, products=products, categories=categories)
    by_name = {(r.CategoryName, r.Month): r.PrevMonthRevenue for r in ops.product_trend(t).collect()}
    assert by_name == {("Kitchen", 1): None, ("Office", 2): 10.0, ("Kitchen", 3): 50.0}
    split = {(r.CategoryName, r.Month): r.PrevMonthRevenue
             for r in ops.product_trend(t, TrendParams(series_by=("CategoryName", "ProductName"))).collect()}
    assert split == {("Kitchen", 1): None, ("Office", 2): None, ("Kitchen", 3): 10.0}
