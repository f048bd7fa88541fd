"""Star schema, calendar, view registration and roll-up."""

from __future__ import annotations

import datetime as dt

from ledgerline import operators as ops

from .conftest import d, line, make_tables


def test_country_normalisation(spark):
    customers = [("A", "a", " USA ", "x"), ("B", "b", "UK", "y"), ("C", "c", "usa", "z"), ("D", "d", None, "w"),
                 ("E", "e", "\tUK", "v")]
    t = make_tables(spark, [line(1, 1, 1, 1)], [(1, "A", d("2020-01-01"))], customers=customers)
    got = {r.CustomerID: r.Country for r in ops.dim_customer(t).collect()}
    # trim removes spaces only; no case folding
    assert got == {"A": "United States", "B": "United Kingdom", "C": "usa", "D": None, "E": "\tUK"}


def test_fact_keeps_lines_without_category_and_drops_orphans(spark):
    products = [(1, "P1", 1), (2, "P2", None)]
    lines = [line(1, 1, 10, 2, "0.10"), line(1, 2, 5, 1), line(1, 3, 7, 1),   # product 3 unknown
             line(9, 1, 4, 1)]                                                # order 9 unknown
    t = make_tables(spark, lines, [(1, "A", d("2020-01-01"))], products=products)
    rows = sorted(ops.fact_sales(t).collect(), key=lambda r: r.ProductID)
    assert [(r.ProductID, r.CategoryID, float(r.NetRevenue)) for r in rows] == [(1, 1, 18.0), (2, None, 5.0)]
    assert ops.fact_sales_load(t).columns == ["OrderID", "CustomerID", "ProductID", "CategoryID",
                                              "OrderDate", "Quantity", "NetRevenue"]


def test_calendar_spans_fact_range_with_leap_day(spark):
    t = make_tables(spark, [line(1, 1, 1, 1), line(2, 1, 1, 1)],
                    [(1, "A", d("2024-02-27")), (2, "A", d("2024-03-02"))])
    cal = ops.dim_date(ops.fact_sales_load(t)).collect()
    assert [r.Date for r in cal] == [dt.date(2024, 2, 27) + dt.timedelta(days=i) for i in range(5)]
    assert [tuple(r) for r in ops.calendar_for(t).collect()] == [tuple(r) for r in cal]
    feb29 = cal[2]
    assert (feb29["Month Name"], feb29["Quarter Name"], feb29["Day Name"], feb29["Day of Week"]) == \
        ("Feb", "Q1", "Thu", 4)


def test_calendar_of_empty_fact_is_empty(spark):
    t = make_tables(spark, [line(1, 1, 1, 1)], [(2, "A", d("2020-01-01"))])   # no line has an order
    assert ops.dim_date(ops.fact_sales_load(t)).count() == 0
    assert ops.calendar_for(t).count() == 0


def test_calendar_range_ignores_lines_without_product(spark):
    lines = [line(1, 1, 1, 1), line(2, 99, 1, 1)]          # product 99 unknown
    orders = [(1, "A", d("2021-01-10")), (2, "A", d("2021-03-01"))]
    t = make_tables(spark, lines, orders)
    assert ops.calendar_for(t).count() == 1


def test_views_registered_idempotently_and_rollup_sql_matches(spark):
    products = [(1, "P1", 1), (2, "P2", 2)]
    categories = [(1, "Food"), (2, "Drink")]
    customers = [("A", "a", "USA", "x"), ("B", "b", "UK", "y")]
    lines = [line(1, 1, 10, 1), line(1, 2, 5, 2), line(2, 2, 3, 1)]
    orders = [(1, "A", d("2020-01-05")), (2, "B", d("2020-05-05"))]
    t = make_tables(spark, lines, orders, products=products, categories=categories, customers=customers)
    ops.register_star_views(spark, t, prefix="t_")
    ops.register_star_views(spark, t, prefix="t_")          # re-create: no error
    assert spark.sql("SELECT COUNT(*) AS n FROM t_FactSales").first().n == 3
    a = sorted(tuple(r) for r in ops.star_rollup(t).collect())
    b = sorted(tuple(r) for r in ops.star_rollup_sql(spark, t, prefix="t_").collect())
    assert a == b
    assert ("Drink", 2020, 1, "United States", 10.0, 2, 1) in a


def test_rollup_same_with_and_without_customer_broadcast(spark):
    from ledgerline.params import JoinParams
    products = [(1, "P1", 1), (2, "P2", 2)]
    categories = [(1, "Food"), (2, "Drink")]
    customers = [("A", "a", "USA", "x"), ("B", "b", "UK", "y")]
    lines = [line(1, 1, 10, 1), line(1, 2, 5, 2), line(2, 2, 3, 1), line(3, 1, 7, 3)]
    orders = [(1, "A", d("2020-01-05")), (2, "B", d("2020-05-05")), (3, "GHOST", d("2020-05-06"))]
    t = make_tables(spark, lines, orders, products=products, categories=categories, customers=customers)
    small = sorted(tuple(r) for r in ops.star_rollup(t).collect())
    no_bc = JoinParams(broadcast_max_rows=0, broadcast_max_bytes=0)
    assert sorted(tuple(r) for r in ops.star_rollup(t, join=no_bc).collect()) == small
    assert ("Food", 2020, 2, None, 21.0, 3, 1) in small       # order of an unknown customer kept
