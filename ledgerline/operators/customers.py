"""Customer analyses: order statistics, RFM view, churn risk, orphan audit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.dates import days_between
from ledgerline.functions.money import mean_round2, per_period_round2, ratio, round_out
from ledgerline.operators.revenue import orders_with_revenue
from ledgerline.params import DEFAULTS, ChurnParams, RfmParams, WindowParams
from ledgerline.plans.ordered import WindowOutputs, ordered_window
from ledgerline.sources.model import SalesTables


def reference_date(t: SalesTables):
    """Latest order date over all orders, as a scalar subquery Column.

    The analyses' "today" comes from the data, never from the clock, so a
    rerun gives the same answer.  Spark computes the subquery once.
    """
    orders = t.order_facts if t.order_facts is not None else t.orders
    return orders.select(F.max("OrderDate")).scalar()


def _customer_order_stats(t: SalesTables, min_orders: int) -> DataFrame:
    """Per customer (decimal): TotalOrders, _total, _rows, First/LastPurchase.

    Every order counts, also one without lines (left join, revenue 0).
    Aggregation runs in two steps -- per (customer, order), then per
    customer -- which is count-distinct without an Expand, and both steps
    combine map-side so a customer owning a third of the orders never lands
    in one task unreduced.  The per-order step needs no shuffle: the join
    output is already partitioned by OrderID.
    """
    per_order = (orders_with_revenue(t, "left")
                 .groupBy("CustomerID", "OrderID")
                 .agg(F.sum(F.coalesce(F.col("OrderRevenue"), F.lit(0))).alias("_orev"),
                      F.count(F.lit(1)).alias("_rows"),
                      F.min("OrderDate").alias("_first"),
                      F.max("OrderDate").alias("_last")))
    stats = (per_order.groupBy("CustomerID")
             .agg(F.count("OrderID").alias("TotalOrders"),
                  F.sum("_orev").alias("_total"),
                  F.sum("_rows").alias("_rows"),
                  F.min("_first").alias("FirstPurchase"),
                  F.max("_last").alias("LastPurchase")))
    return stats.where(F.col("TotalOrders") >= F.lit(min_orders))


def customer_order_stats(t: SalesTables, params: RfmParams = DEFAULTS.rfm) -> DataFrame:
    """Customers with at least ``min_orders`` orders and their order metrics."""
    s = _customer_order_stats(t, params.min_orders)
    return s.select(
        "CustomerID",
        F.col("TotalOrders").cast("long").alias("TotalOrders"),
        round_out("_total", 2).alias("TotalRevenue"),
        mean_round2("_total", "_rows").alias("AvgOrderValue"),
        "FirstPurchase", "LastPurchase",
    )


def customer_rfm(t: SalesTables, params: RfmParams = DEFAULTS.rfm,
                 window: WindowParams = DEFAULTS.window, ordered: bool = True) -> DataFrame:
    """Recency / frequency / monetary view with a ranking inside each country.

    Customers below ``min_orders`` are dropped before the country totals.
    Ranks and country totals use unrounded revenue; rounding is for display.
    The country ranking and totals run through ``ordered_window``, so a
    country holding most customers is split across tasks.
    """
    if params.rank_method not in ("rank", "dense_rank"):
        raise ValueError("rank_method must be 'rank' or 'dense_rank'")
    stats = _customer_order_stats(t, params.min_orders)
    customers = t.customers.select("CustomerID", "CompanyName", "Country")
    base = (stats.join(customers, "CustomerID")
            .withColumn("DaysSinceLastPurchase", days_between("LastPurchase", reference_date(t))))
    ranked = ordered_window(
        base, partition_by=["Country"], order_keys=[("_total", False)], tiebreak=[("CustomerID", True)],
        outputs=WindowOutputs(segment_sums={"_ctot": "_total"}, **{params.rank_method: "RevenueRank"}),
        params=window, bounded_by=t.customers, range_segments=ordered)     # a country holds a customer once
    out = ranked.select(
        "CustomerID", "CompanyName", "Country",
        F.col("TotalOrders").cast("long").alias("TotalOrders"),
        round_out("_total", 2).alias("TotalRevenue"),
        mean_round2("_total", "_rows").alias("AvgOrderValue"),
        "FirstPurchase", "LastPurchase", "DaysSinceLastPurchase",
        "RevenueRank",
        round_out("_ctot", 2).alias("CountryTotalRevenue"),
        ratio("_total", "_ctot", 2, factor=100.0, factor_first=True).alias("PctOfCountryRevenue"),
        "_total",
    )
    if ordered:
        out = out.orderBy(F.col("Country").asc(), F.col("_total").desc(), F.col("CustomerID").asc())
    return out.drop("_total")


def customer_activity(t: SalesTables) -> DataFrame:
    """Per customer with at least one order line: first/last purchase, revenue.

    Lines are pre-aggregated per order before joining orders (inner: an
    order without lines does not count here), then per customer.
    """
    return (orders_with_revenue(t, "inner")
            .groupBy("CustomerID")
            .agg(F.min("OrderDate").alias("FirstPurchaseDate"),
                 F.max("OrderDate").alias("LastPurchaseDate"),
                 F.sum("OrderRevenue").alias("_total")))


def customer_churn(t: SalesTables, params: ChurnParams = DEFAULTS.churn, ordered: bool = True) -> DataFrame:
    """Churn risk from purchase inactivity, relative to the latest order date."""
    act = customer_activity(t).join(t.customers.select("CustomerID", "CompanyName", "Country"), "CustomerID")
    days = days_between("LastPurchaseDate", reference_date(t))
    total2 = F.round(F.col("_total"), 2)
    out = act.select(
        "CustomerID", "CompanyName", "Country", "FirstPurchaseDate", "LastPurchaseDate",
        days.alias("DaysSinceLastPurchase"),
        total2.cast("double").alias("TotalHistoricRevenue"),
        per_period_round2(total2, days_between("FirstPurchaseDate", "LastPurchaseDate"),
                          params.days_per_month).alias("AvgMonthlyRevenue"),
        F.when(days >= params.lost_days, F.lit("LOST"))
         .when(days >= params.at_risk_days, F.lit("AT RISK"))
         .otherwise(F.lit("ACTIVE")).alias("ChurnRisk"),
    )
    if ordered:
        out = out.orderBy(F.col("DaysSinceLastPurchase").desc(), F.col("CustomerID").asc())
    return out


def orphan_customers(t: SalesTables) -> DataFrame:
    """Customer ids used by orders but missing from the customer table.

    Orders are reduced to one row per customer id first (map-side combine),
    then anti-joined to the customer keys.
    """
    per_customer = (t.orders.groupBy("CustomerID")
                    .agg(F.count(F.lit(1)).cast("long").alias("Orders"),
                         F.min("OrderDate").alias("FirstOrderDate"),
                         F.max("OrderDate").alias("LastOrderDate")))
    return per_customer.join(t.customers.select("CustomerID"), "CustomerID", "left_anti")


__all__ = ["customer_order_stats", "customer_rfm", "customer_activity", "customer_churn",
           "orphan_customers", "reference_date"]
