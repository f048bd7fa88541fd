"""Line money over the classic schema keeps every decimal."""

from __future__ import annotations

from decimal import Decimal

import pytest

from ledgerline import operators as ops
from ledgerline.functions.money import net_amount
from ledgerline.sources.model import from_classic


def _classic(spark, lines, schema):
    frames = {
        "Order Details": spark.createDataFrame(lines, schema),
        "Orders": spark.createDataFrame([(1, "A", "2020-01-02")], "OrderID int, CustomerID string, OrderDate string"),
        "Products": spark.createDataFrame([(1, "P", 1)], "ProductID int, ProductName string, CategoryID int"),
        "Categories": spark.createDataFrame([(1, "C")], "CategoryID int, CategoryName string"),
        "Customers": spark.createDataFrame([("A", "Co", "Land", "Town")], "CustomerID string, CompanyName string, Country string, City string"),
    }
    return from_classic(frames.__getitem__)


KEYS = "OrderID int, ProductID int, "


@pytest.mark.parametrize("price,qty,discount,schema,want", [
    (0.3333, 2.5, 0.125, "UnitPrice double, Quantity double, Discount double", "0.72909375"),
    (Decimal("0.3333"), 1, 0.125, "UnitPrice decimal(19,4), Quantity smallint, Discount float", "0.2916375"),
    (Decimal("0.3333"), 1, 0.125, "UnitPrice decimal(19,4), Quantity bigint, Discount double", "0.2916375"),
    (99999999.99, 30000.0, 0.0, "UnitPrice double, Quantity double, Discount double", "2999999999700"),
    (1.0, -2.0, 1.0, "UnitPrice double, Quantity double, Discount double", "0"),
])
def test_net_amount_keeps_every_decimal(spark, price, qty, discount, schema, want):
    t = _classic(spark, [(1, 1, price, qty, discount)], KEYS + schema)
    got = t.order_details.select(net_amount("GrossAmount", "Discount").alias("net")).first().net
    assert got == Decimal(want)


def test_many_lines_sum_exactly(spark):
    from pyspark.sql import functions as F
    line = spark.range(30_000).select(F.lit(1).alias("OrderID"), F.lit(1).alias("ProductID"), F.lit(0.3333).alias("UnitPrice"),
                                      F.lit(2.5).alias("Quantity"), F.lit(0.125).alias("Discount"))
    t = _classic(spark, [(1, 1, 1.0, 1.0, 0.0)], KEYS + "UnitPrice double, Quantity double, Discount double")
    frames = {"Order Details": line, "Orders": t.orders, "Products": t.products, "Categories": t.categories, "Customers": t.customers}
    exact = from_classic(frames.__getitem__)
    assert [r.OrderRevenue for r in ops.order_revenue(exact).collect()][0] == pytest.approx(21872.8125, abs=0.0051)
    total = exact.order_details.agg(F.sum(net_amount("GrossAmount", "Discount")).alias("s")).first().s
    assert total == Decimal("21872.8125")


def test_types_that_lose_digits_are_refused(spark):
    with pytest.raises(ValueError, match="38 digits"):
        _classic(spark, [(1, 1, Decimal("1"), Decimal("1"), Decimal("0.1"))],
                 KEYS + "UnitPrice decimal(28,10), Quantity decimal(9,4), Discount decimal(15,14)")
