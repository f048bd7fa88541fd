"""Line and order revenue (the shared first step of every analysis)."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.money import net_amount
from ledgerline.plans.materialize import materialize
from ledgerline.sources.model import SalesTables


def net_revenue_lines(t: SalesTables) -> DataFrame:
    """One row per order line with its exact net revenue (DECIMAL(38,12))."""
    return t.order_details.select(
        "OrderID", "ProductID", "Quantity", "Discount", "GrossAmount",
        net_amount("GrossAmount", "Discount").alias("NetRevenue"),
    )


def order_revenue(t: SalesTables) -> DataFrame:
    """Net revenue per order: (OrderID, OrderRevenue DECIMAL).

    Aggregated before any join: partial aggregation collapses the lines of an
    order inside each input split, so the shuffle by OrderID moves about one
    row per order and a hot order is combined map-side.
    """
    return (t.order_details
            .groupBy("OrderID")
            .agg(F.sum(net_amount("GrossAmount", "Discount")).alias("OrderRevenue")))


def share_order_revenue(t: SalesTables) -> SalesTables:
    """``t`` carrying its order facts, computed once and checkpointed.

    The facts are every order with its revenue and its number of lines (0
    when it has none).  The customer analyses, the concentration and the
    monthly growth all start from revenue per order; run together (a report
    export, a dashboard refresh) they then read this one order-grain result
    instead of each scanning the order lines and shuffling both tables again.
    """
    per_order = (t.order_details.groupBy("OrderID")
                 .agg(F.sum(net_amount("GrossAmount", "Discount")).alias("OrderRevenue"),
                      F.count(F.lit(1)).alias("LineCount")))
    facts = (t.orders.select("OrderID", "CustomerID", "OrderDate")
             .join(per_order, "OrderID", "left")
             .withColumn("LineCount", F.coalesce(F.col("LineCount"), F.lit(0))))
    return replace(t, order_facts=materialize(facts))


def orders_with_revenue(t: SalesTables, how: str = "inner") -> DataFrame:
    """Orders joined to their revenue on OrderID.

    ``how='inner'`` keeps orders that have lines; ``how='left'`` keeps every
    order (revenue NULL when it has no line).  Both sides are hash-partitioned
    on OrderID, and the output stays so partitioned, which later per-order
    groupings reuse without another shuffle.
    """
    if how not in ("left", "inner"):
        raise ValueError("how must be 'left' or 'inner'")
    if t.order_facts is not None:
        facts = t.order_facts if how == "left" else t.order_facts.where(F.col("LineCount") > 0)
        return facts.select("OrderID", "CustomerID", "OrderDate", "OrderRevenue")
    orders = t.orders.select("OrderID", "CustomerID", "OrderDate")
    return orders.join(order_revenue(t), "OrderID", how)
