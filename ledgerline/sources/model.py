"""The canonical sales model every operator reads.

Five relations, named by role rather than by any particular database:

=============  ==============================================================
order_details  OrderID, ProductID, Quantity and UnitPrice (as the source has
               them), GrossAmount (decimal: unit price x quantity) and
               Discount (decimal fraction), both at the source's scale
orders         OrderID, CustomerID, OrderDate (date)
products       ProductID, ProductName, CategoryID
categories     CategoryID, CategoryName
customers      CustomerID, CompanyName, Country, City
=============  ==============================================================

Keys may be of any orderable type.  Adapters turn a concrete source into
these frames lazily; nothing is read until an operator's plan runs, and
Catalyst prunes every scan down to the columns the plan uses.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.dates import as_date
from ledgerline.functions.money import exact, narrowed

ORDER_DETAILS_COLUMNS = ("OrderID", "ProductID", "Quantity", "UnitPrice", "GrossAmount", "Discount")
ORDERS_COLUMNS = ("OrderID", "CustomerID", "OrderDate")
PRODUCTS_COLUMNS = ("ProductID", "ProductName", "CategoryID")
CATEGORIES_COLUMNS = ("CategoryID", "CategoryName")
CUSTOMERS_COLUMNS = ("CustomerID", "CompanyName", "Country", "City")


@dataclass(frozen=True)
class SalesTables:
    order_details: DataFrame
    orders: DataFrame
    products: DataFrame
    categories: DataFrame
    customers: DataFrame
    # Optional precomputed order facts (OrderID, CustomerID, OrderDate,
    # OrderRevenue, LineCount) for every order, shared by analyses run
    # together (see operators.revenue.share_order_revenue).
    order_facts: DataFrame | None = None

    def validate(self) -> SalesTables:
        """Check that every relation carries its canonical columns, and bring
        the money columns to types whose product is exact."""
        for name, cols in (("order_details", ORDER_DETAILS_COLUMNS),
                           ("orders", ORDERS_COLUMNS),
                           ("products", PRODUCTS_COLUMNS),
                           ("categories", CATEGORIES_COLUMNS),
                           ("customers", CUSTOMERS_COLUMNS)):
            have = set(getattr(self, name).columns)
            missing = [c for c in cols if c not in have]
            if missing:
                raise ValueError(f"{name} lacks columns {missing}")
        facts = {"OrderID", "CustomerID", "OrderDate", "OrderRevenue", "LineCount"}
        if self.order_facts is not None and not facts <= set(self.order_facts.columns):
            raise ValueError(f"order_facts needs columns {sorted(facts)}")
        gross, discount = narrowed(self.order_details, "GrossAmount", "Discount")
        return replace(self, order_details=self.order_details.withColumns({"GrossAmount": gross, "Discount": discount}))


def from_classic(read: Callable[[str], DataFrame]) -> SalesTables:
    """Canonical frames from the classic five-table order schema.

    ``read(name)`` returns the table called ``Order Details``, ``Orders``,
    ``Products``, ``Categories`` or ``Customers`` (for instance
    ``DatabaseSource.reader("dbo")`` or ``ParquetSource.table``).
    """
    od = read("Order Details")
    return SalesTables(
        order_details=od.select(
            "OrderID", "ProductID", "Quantity",
            F.col("UnitPrice").cast("double").alias("UnitPrice"),
            (exact(od, "UnitPrice") * exact(od, "Quantity")).alias("GrossAmount"),
            exact(od, "Discount").alias("Discount"),
        ),
        orders=read("Orders").select("OrderID", "CustomerID", as_date("OrderDate").alias("OrderDate")),
        products=read("Products").select(*PRODUCTS_COLUMNS),
        categories=read("Categories").select(*CATEGORIES_COLUMNS),
        customers=read("Customers").select(*CUSTOMERS_COLUMNS),
    ).validate()
