"""Bitmap counts merge across levels; the bitmap anti join keeps every order without lines."""

from __future__ import annotations

import pytest

from ledgerline import operators as ops

from .conftest import d, line


def _tables(spark, lines, orders):
    from ledgerline.sources.model import SalesTables

    from .conftest import CATEGORIES_SCHEMA, CUSTOMERS_SCHEMA, OD_SCHEMA, PRODUCTS_SCHEMA
    return SalesTables(spark.createDataFrame(lines, OD_SCHEMA), spark.createDataFrame(orders, "OrderID long, CustomerID long, OrderDate date"),
                       spark.createDataFrame([(1, "P", 1)], PRODUCTS_SCHEMA), spark.createDataFrame([(1, "C")], CATEGORIES_SCHEMA),
                       spark.createDataFrame([], CUSTOMERS_SCHEMA)).validate()


ORDERS = [(1, 7, d("2020-01-05")), (2, 7, d("2020-02-05")), (32768, 7, d("2020-02-06")), (32769, 8, d("2020-04-01")),
          (-5, None, d("2020-04-02")), (70000, 9, None), (0, 9, d("2021-01-01")), (9, 9, d("2021-01-02"))]


def test_levels_merge(spark):
    t = _tables(spark, [line(o, 1, 5, 1) for o in (1, 1, 2, 32768, 32769, -5, 70000, 0)], ORDERS)
    got = {(r.Level, str(r.PeriodStart)): (r.Orders, r.Customers) for r in ops.distinct_by_period(t).collect()}
    assert got == {("month", "2020-01-01"): (1, 1), ("month", "2020-02-01"): (2, 1), ("month", "2020-04-01"): (2, 1), ("month", "2021-01-01"): (1, 1),
                   ("quarter", "2020-01-01"): (3, 1), ("quarter", "2020-04-01"): (2, 1), ("quarter", "2021-01-01"): (1, 1),
                   ("year", "2020-01-01"): (5, 2), ("year", "2021-01-01"): (1, 1)}


@pytest.mark.parametrize("with_lines", [(), (1, 32768, 0, -5), (1, 2, 32768, 32769, -5, 70000, 0, 9, 123456)])
def test_orders_without_lines(spark, with_lines):
    orders = [*ORDERS, (None, 3, d("2020-01-01"))]
    t = _tables(spark, [line(o, 1, 5, 1) for o in with_lines], orders)
    got = {r.OrderID for r in ops.orders_without_lines(t).collect()}
    assert got == {o for o, *_ in orders if o not in with_lines}


def test_text_ids_are_refused(spark):
    from .conftest import make_tables
    t = make_tables(spark, [line(1, 1, 5, 1)], [(1, "A", d("2020-01-01"))])
    with pytest.raises(ValueError, match="integral"):
        ops.distinct_by_period(t)
