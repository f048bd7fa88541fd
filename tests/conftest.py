from __future__ import annotations

import datetime as dt
import os
import sys
from decimal import Decimal

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from ledgerline.session import local_session  # noqa: E402
from ledgerline.sources.model import SalesTables  # noqa: E402

TESTDATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark():
    s = local_session("*", shuffle_partitions=8)
    yield s


OD_SCHEMA = "OrderID long, ProductID long, Quantity long, UnitPrice double, GrossAmount decimal(20,6), Discount decimal(9,6)"
ORDERS_SCHEMA = "OrderID long, CustomerID string, OrderDate date"
PRODUCTS_SCHEMA = "ProductID long, ProductName string, CategoryID long"
CATEGORIES_SCHEMA = "CategoryID long, CategoryName string"
CUSTOMERS_SCHEMA = "CustomerID string, CompanyName string, Country string, City string"


def line(order, product, price, qty, disc="0"):
    """An order line from unit price and quantity (gross = price x qty)."""
    p, q = Decimal(str(price)), int(qty)
    return (order, product, q, float(p), p * q, Decimal(disc))


def make_tables(spark, lines, orders, products=None, categories=None, customers=None) -> SalesTables:
    products = products if products is not None else [(1, "P1", 1)]
    categories = categories if categories is not None else [(1, "C1")]
    if customers is None:
        ids = sorted({o[1] for o in orders if o[1] is not None})
        customers = [(c, f"Company {c}", "Land", "Town") for c in ids]
    return SalesTables(
        order_details=spark.createDataFrame(lines, OD_SCHEMA),
        orders=spark.createDataFrame(orders, ORDERS_SCHEMA),
        products=spark.createDataFrame(products, PRODUCTS_SCHEMA),
        categories=spark.createDataFrame(categories, CATEGORIES_SCHEMA),
        customers=spark.createDataFrame(customers, CUSTOMERS_SCHEMA),
    ).validate()


def d(s: str) -> dt.date:
    return dt.date.fromisoformat(s)
