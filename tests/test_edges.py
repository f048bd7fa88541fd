"""Degenerate inputs: empty tables and zero revenue."""

from __future__ import annotations

from ledgerline import operators as ops

from .conftest import d, line, make_tables


def test_every_operator_runs_on_empty_tables(spark):
    t = make_tables(spark, [], [], products=[], categories=[], customers=[])
    for name in ("net_revenue_lines", "order_revenue", "customer_order_stats", "customer_rfm", "customer_churn",
                 "customer_concentration", "product_month_base", "product_trend", "product_top", "monthly_growth",
                 "fact_sales", "fact_sales_load", "dim_customer", "dim_product", "dim_category", "calendar_for",
                 "orphan_customers", "star_rollup"):
        assert getattr(ops, name)(t).count() == 0, name
    hhi = ops.hhi_summary(t).collect()
    assert len(hhi) == 1 and hhi[0].Customers == 0 and hhi[0].HHIBand is None
    pareto = ops.pareto_cutoff(t).collect()
    assert [r.CustomersToReach for r in pareto] == [None, None, None]


def test_zero_revenue_gives_null_shares(spark):
    lines = [line(1, 1, 0, 1), line(2, 1, 0, 3)]
    orders = [(1, "A", d("2020-01-01")), (2, "B", d("2020-02-01"))]
    t = make_tables(spark, lines, orders)
    rows = ops.customer_concentration(t).collect()
    assert [(r.CustomerRevenue, r.RevenueSharePct, r.HHI_Contribution) for r in rows] == [(0.0, None, None)] * 2
    assert ops.hhi_summary(t).first().HHIBand is None
    growth = ops.monthly_growth(t).collect()
    assert [r.RevenueGrowthPct for r in growth] == [None, None]


def test_bucketed_window_on_empty_input(spark):
    from ledgerline.params import WindowParams
    t = make_tables(spark, [], [], products=[], categories=[], customers=[])
    wp = WindowParams(direct_bytes=0, buckets=64, oversample=1)
    assert ops.customer_concentration(t, window=wp).count() == 0
    assert ops.customer_rfm(t, window=wp).count() == 0
    assert ops.product_trend(t, window=wp).count() == 0
