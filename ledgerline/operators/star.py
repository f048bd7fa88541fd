"""Star schema: sales fact, customer/product/category dimensions, view
registration and a roll-up of the fact by dimension attributes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.functions.dates import quarter_of, year_of
from ledgerline.functions.money import net_amount
from ledgerline.operators.calendar import calendar_for
from ledgerline.params import DEFAULTS, CalendarParams, JoinParams
from ledgerline.plans.joins import broadcast_fits, join_dimension
from ledgerline.sources.model import SalesTables

FACT_LOAD_COLUMNS = ("OrderID", "CustomerID", "ProductID", "CategoryID", "OrderDate", "Quantity", "NetRevenue")
QUANTITY = "decimal(18,6)"    # exact sums of quantities that may be fractional


def fact_sales(t: SalesTables, join: JoinParams = DEFAULTS.join) -> DataFrame:
    """One row per order line that has an order and a product.

    Lines without a category are kept (CategoryID comes from the product).
    NetRevenue is exact (DECIMAL(38,12)); Discount is the source's own fraction.
    Orders are joined by a shuffle on OrderID; products through a checked
    broadcast.  No join to the category table: it would add no column and
    cannot drop a line.
    """
    lines = t.order_details.select("OrderID", "ProductID", "Quantity", "UnitPrice", "GrossAmount", "Discount")
    x = lines.join(t.orders.select("OrderID", "CustomerID", "OrderDate"), "OrderID")
    x = join_dimension(x, t.products.select("ProductID", "CategoryID"), on="ProductID", params=join)
    return x.select("OrderID", "CustomerID", "ProductID", "CategoryID", "OrderDate", "Quantity",
                    "UnitPrice", "Discount",
                    net_amount("GrossAmount", "Discount").alias("NetRevenue"))


def fact_sales_load(t: SalesTables, join: JoinParams = DEFAULTS.join) -> DataFrame:
    """The fact as loaded into the model: unit price and discount left out."""
    return fact_sales(t, join).select(*FACT_LOAD_COLUMNS)


def normalized_country(col: Column, aliases: dict) -> Column:
    """Trim spaces, then replace known abbreviations (case-sensitive)."""
    trimmed = F.trim(col)
    expr = None
    for short, full in aliases.items():
        expr = (F.when(trimmed == F.lit(short), F.lit(full)) if expr is None
                else expr.when(trimmed == F.lit(short), F.lit(full)))
    return trimmed if expr is None else expr.otherwise(trimmed)


def dim_customer(t: SalesTables, aliases: dict | None = None) -> DataFrame:
    aliases = DEFAULTS.country_aliases if aliases is None else aliases
    return t.customers.select("CustomerID", "CompanyName",
                              normalized_country(F.col("Country"), aliases).alias("Country"), "City")


def dim_product(t: SalesTables) -> DataFrame:
    return t.products.select("ProductID", "ProductName", "CategoryID")


def dim_category(t: SalesTables) -> DataFrame:
    return t.categories.select("CategoryID", "CategoryName")


STAR_VIEWS = ("FactSales", "FactSalesLoad", "DimCustomer", "DimProduct", "DimCategory", "DimDate")


def register_star_views(spark: SparkSession, t: SalesTables, prefix: str = "",
                        calendar: CalendarParams = DEFAULTS.calendar) -> dict[str, DataFrame]:
    """(Re)create the star schema as temporary views; safe to call repeatedly.

    FactSales has all nine columns, FactSalesLoad the seven of the load form.

    DimDate carries a broadcast hint: it has one row per day of the fact's
    span (a bound set by the calendar, about 365 rows a year, not by data
    volume), so SQL joining the fact to it never shuffles the fact by date.
    """
    frames = {
        "FactSales": fact_sales(t),
        "FactSalesLoad": fact_sales_load(t),
        "DimCustomer": dim_customer(t),
        "DimProduct": dim_product(t),
        "DimCategory": dim_category(t),
        "DimDate": calendar_for(t, calendar).hint("broadcast"),
    }
    for name, df in frames.items():
        df.createOrReplaceTempView(prefix + name)
    return {prefix + k: v for k, v in frames.items()}


def star_rollup(t: SalesTables, join: JoinParams = DEFAULTS.join, aliases: dict | None = None) -> DataFrame:
    """Net revenue, quantity and line count by category, year, quarter and
    (normalised) country.

    A customer dimension proven small enough to broadcast is attached to
    each line in the scan stage and the fact is aggregated once.  Otherwise
    the fact is first reduced to (customer, category, year, quarter) --
    combined map-side -- and only that is joined to the customers, so the
    shuffled customer join never sees line-level rows.  Year and quarter
    are derived from the order date directly (the calendar table would
    return the same attributes).
    """
    fact = fact_sales_load(t, join).select(
        "CustomerID", "CategoryID", year_of("OrderDate").alias("Year"),
        quarter_of("OrderDate").alias("Quarter"), "NetRevenue",
        F.col("Quantity").cast(QUANTITY).alias("Quantity"))
    customers = dim_customer(t, aliases).select("CustomerID", "Country")
    keys = ["CategoryName", "Year", "Quarter", "Country"]
    if broadcast_fits(customers, join):
        # Small customer dimension: attach it to each line inside the scan
        # stage and aggregate once.
        g = fact.join(F.broadcast(customers), "CustomerID", "left").withColumns(
            {"_rev": F.col("NetRevenue"), "_qty": F.col("Quantity"), "_lines": F.lit(1)})
    else:
        g = (fact.groupBy("CustomerID", "CategoryID", "Year", "Quarter")
             .agg(F.sum("NetRevenue").alias("_rev"), F.sum("Quantity").alias("_qty"),
                  F.count(F.lit(1)).alias("_lines"))
             .join(customers, "CustomerID", "left"))
    g = join_dimension(g, dim_category(t), on="CategoryID", how="left", params=join)
    return (g.groupBy(*keys)
            .agg(F.round(F.sum("_rev"), 2).cast("double").alias("NetRevenue"),
                 F.sum("_qty").cast("double").alias("Quantity"),
                 F.sum("_lines").cast("long").alias("Lines")))


ROLLUP_SQL = """
SELECT c.CategoryName, d.Year, d.Quarter, cu.Country,
       CAST(ROUND(SUM(f.NetRevenue), 2) AS DOUBLE) AS NetRevenue,
       CAST(SUM(CAST(f.Quantity AS {qty})) AS DOUBLE) AS Quantity,
       CAST(COUNT(*) AS BIGINT) AS Lines
FROM {p}FactSales f
LEFT JOIN {p}DimDate d ON f.OrderDate = d.Date
LEFT JOIN {p}DimCustomer cu ON f.CustomerID = cu.CustomerID
LEFT JOIN {p}DimCategory c ON f.CategoryID = c.CategoryID
GROUP BY c.CategoryName, d.Year, d.Quarter, cu.Country
"""


def star_rollup_sql(spark: SparkSession, t: SalesTables, prefix: str = "") -> DataFrame:
    """The same roll-up written in SQL against the registered star views."""
    register_star_views(spark, t, prefix)
    return spark.sql(ROLLUP_SQL.format(p=prefix, qty=QUANTITY))
