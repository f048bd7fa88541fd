"""Month-grain trends: company growth and per-product trends."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.dates import month_of, month_start, year_of
from ledgerline.functions.money import mean_round2, net_amount, ratio, round_out
from ledgerline.operators.revenue import orders_with_revenue
from ledgerline.params import DEFAULTS, JoinParams, TrendParams, WindowParams
from ledgerline.plans.joins import broadcast_fits, input_bytes, join_dimension
from ledgerline.plans.ordered import WindowOutputs, ordered_window
from ledgerline.session import shuffle_partitions_for
from ledgerline.sources.model import SalesTables

SPREAD_BYTES = 64 << 20        # files of the order lines beyond which steps of line grain are dealt by their size
GROUPING_BYTES = 8 << 20       # and how much of them one task then takes
UNKNOWN_BYTES = 1 << 60        # Spark's estimate where it knows no size


def monthly_revenue(t: SalesTables) -> DataFrame:
    """(OrderMonth DATE, MonthlyRevenue DECIMAL) over lines that have an order."""
    return (orders_with_revenue(t, "inner")
            .groupBy(month_start("OrderDate").alias("OrderMonth"))
            .agg(F.sum("OrderRevenue").alias("MonthlyRevenue")))


def monthly_growth(t: SalesTables, ordered: bool = True) -> DataFrame:
    """Company revenue per month with previous month, growth %, cumulative
    revenue and a 3-month moving average (the current and two previous rows).

    The month table has one row per calendar month that has sales, a size
    set by the time span rather than the data volume, so its ordered window
    runs in one task by design.  "Previous" is the previous row, not the
    previous calendar month.
    """
    m = monthly_revenue(t)
    w = Window.orderBy(F.col("OrderMonth").asc_nulls_first())
    run = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last3 = w.rowsBetween(-2, Window.currentRow)
    m = m.withColumns({
        "_prev": F.lag("MonthlyRevenue").over(w),
        "_cum": F.sum("MonthlyRevenue").over(run),
        "_sum3": F.sum("MonthlyRevenue").over(last3),
        "_n3": F.count("MonthlyRevenue").over(last3),
    })
    out = m.select(
        year_of("OrderMonth").alias("Year"),
        month_of("OrderMonth").alias("Month"),
        round_out("MonthlyRevenue", 2).alias("MonthlyRevenue"),
        round_out("_prev", 2).alias("PrevMonthRevenue"),
        ratio(F.col("MonthlyRevenue") - F.col("_prev"), "_prev", 2, factor=100.0).alias("RevenueGrowthPct"),
        round_out("_cum", 2).alias("CumulativeRevenue"),
        mean_round2("_sum3", "_n3").alias("MovingAvg3Months"),
        "OrderMonth",
    )
    if ordered:
        out = out.orderBy(F.col("OrderMonth").asc_nulls_first())
    return out.drop("OrderMonth")


def product_dimension(t: SalesTables, join: JoinParams = DEFAULTS.join) -> DataFrame:
    """(ProductID, ProductName, CategoryName) for products with a category."""
    return join_dimension(t.products.select("ProductID", "ProductName", "CategoryID"),
                          t.categories.select("CategoryID", "CategoryName"),
                          on="CategoryID", params=join).drop("CategoryID")


def _names_identify_products(products: DataFrame) -> bool:
    """True when no two products share a (category, name) pair."""
    return products.groupBy("CategoryName", "ProductName").count().where("count > 1").limit(1).count() == 0


def _tasks(t: SalesTables) -> int | None:
    """Tasks for the steps that hold a row per order line, from the lines' file
    sizes (no job); None where the lines are few or their size is unknown."""
    size = input_bytes(t.order_details)
    if size is None or not SPREAD_BYTES < size < UNKNOWN_BYTES:
        return None
    return shuffle_partitions_for(size, GROUPING_BYTES)


def _spread(x: DataFrame, t: SalesTables, keys: list[str]) -> DataFrame:
    """``x`` dealt by ``keys`` over ``_tasks``.  Adaptive execution merges the
    join's partitions up to a number of compressed bytes; there the join only
    sorts, but a grouping by order holds a row per line in two hash tables."""
    n = _tasks(t)
    return x if n is None else x.repartition(n, *keys)


def _sorted(out: DataFrame, t: SalesTables, keys: list[str]) -> DataFrame:
    """``out`` in the order of ``keys``, over ``_tasks`` for the same reason."""
    n = _tasks(t)
    return out.orderBy(*keys) if n is None else out.repartitionByRange(n, *keys).sortWithinPartitions(*keys)


def product_month_base(t: SalesTables, join: JoinParams = DEFAULTS.join) -> DataFrame:
    """One row per (month, category, product name): revenue and distinct orders.

    Lines join orders on OrderID (both shuffled by OrderID once).  The
    per-order grouping that makes the order count distinct reuses the
    OrderID partitioning, or with many lines has a shuffle sized by them
    (``_spread``).  The product dimension is attached

    * by broadcast when proven small;
    * otherwise, when every (category, name) pair is one product, after
      aggregating to (month, product): the dimension then meets
      month-grain rows, not lines;
    * otherwise by a shuffle join at line grain.
    """
    lines = t.order_details.select("OrderID", "ProductID",
                                   net_amount("GrossAmount", "Discount").alias("_net"))
    orders = t.orders.select("OrderID", month_start("OrderDate").alias("OrderMonth"))
    dims = product_dimension(t, join)
    keys = ["OrderMonth", "CategoryName", "ProductName"]
    x = lines.join(orders, "OrderID")
    if not broadcast_fits(dims, join) and _names_identify_products(dims):
        x = _spread(x, t, ["OrderMonth", "ProductID", "OrderID"])
        per_order = x.groupBy("OrderMonth", "ProductID", "OrderID").agg(F.sum("_net").alias("_rev"))
        per_month = per_order.groupBy("OrderMonth", "ProductID").agg(
            F.sum("_rev").alias("MonthlyRevenue"), F.count("OrderID").cast("long").alias("MonthlyOrders"))
        return per_month.join(dims, "ProductID").select(*keys, "MonthlyRevenue", "MonthlyOrders")
    x = _spread(join_dimension(x, dims, on="ProductID", params=join), t, [*keys, "OrderID"])
    per_order = x.groupBy(*keys, "OrderID").agg(F.sum("_net").alias("_rev"))
    return per_order.groupBy(*keys).agg(F.sum("_rev").alias("MonthlyRevenue"),
                                        F.count("OrderID").cast("long").alias("MonthlyOrders"))


def _alert(growth, p: TrendParams):
    return (F.when(growth.isNull(), F.lit(None).cast("string"))
            .when(growth < p.sharp_decline_below, F.lit("SHARP DECLINE"))
            .when(growth < 0, F.lit("DECLINING"))
            .when(growth > p.growing_above, F.lit("GROWING"))
            .otherwise(F.lit("STABLE")))


def product_trend(t: SalesTables, params: TrendParams = DEFAULTS.trend,
                  window: WindowParams = DEFAULTS.window, join: JoinParams = DEFAULTS.join,
                  ordered: bool = True) -> DataFrame:
    """Monthly product revenue with growth, running revenue, rank in category
    and month, a top-N flag and a trend alert.

    * previous month and running revenue: per product name (or per
      category and name, ``TrendParams.series_by``), in month order (a
      series is bounded by the number of months);
    * rank: dense rank of revenue inside (category, month), via
      ``ordered_window`` because a category-month can hold any number of
      products;
    * the alert reads the rounded growth.
    """
    if not set(params.series_by) <= {"ProductName", "CategoryName"} or "ProductName" not in params.series_by:
        raise ValueError("series_by must be ('ProductName',) or ('CategoryName', 'ProductName')")
    base = _with_series(_spread(product_month_base(t, join), t, list(params.series_by)), params)
    ranked = ordered_window(
        base, partition_by=["CategoryName", "OrderMonth"], order_keys=[("MonthlyRevenue", False)],
        tiebreak=[("ProductName", True)], outputs=WindowOutputs(dense_rank="RevenueRankInCategory"),
        params=window, bounded_by=t.products)      # a category-month holds a product once
    out = _trend_report(ranked, params)
    if ordered:
        out = _sorted(out, t, ["CategoryName", "ProductName", "Year", "Month"])
    return out


def _with_series(base: DataFrame, params: TrendParams) -> DataFrame:
    """The previous month and the running revenue of each product's series."""
    w = Window.partitionBy(*params.series_by).orderBy(F.col("OrderMonth").asc_nulls_first(),
                                                      F.col("CategoryName").asc_nulls_first())
    return base.withColumns({
        "_prev": F.lag("MonthlyRevenue").over(w),
        "_run": F.sum("MonthlyRevenue").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)),
    })


def _trend_report(ranked: DataFrame, params: TrendParams) -> DataFrame:
    growth = ratio(F.col("MonthlyRevenue") - F.col("_prev"), "_prev", 2, factor=100.0)
    return ranked.select(
        year_of("OrderMonth").alias("Year"),
        month_of("OrderMonth").alias("Month"),
        "CategoryName", "ProductName",
        round_out("MonthlyRevenue", 2).alias("MonthlyRevenue"),
        "MonthlyOrders",
        round_out("_prev", 2).alias("PrevMonthRevenue"),
        growth.alias("RevenueGrowthPct"),
        round_out("_run", 2).alias("RunningRevenueByProduct"),
        "RevenueRankInCategory",
        F.when(F.col("RevenueRankInCategory") <= params.top_n, F.lit(params.top_label)).alias("Top3Flag"),
    ).withColumn("TrendAlert", _alert(F.col("RevenueGrowthPct"), params))


def product_top(t: SalesTables, params: TrendParams = DEFAULTS.trend, join: JoinParams = DEFAULTS.join,
                ordered: bool = True) -> DataFrame:
    """Only the rows in the first ``top_n`` ranks of their category and month.

    The series columns come first, then the rank and its filter together, so
    that Spark limits every (category, month) inside each task before the
    shuffle (``WindowGroupLimit``): a category with most products sends a few
    rows per task, not all of them, and no ordered window over it is needed.
    """
    base = _with_series(_spread(product_month_base(t, join), t, list(params.series_by)), params)
    rank = F.dense_rank().over(Window.partitionBy("CategoryName", "OrderMonth").orderBy(F.col("MonthlyRevenue").desc()))
    top = base.withColumn("_rank", rank).where(F.col("_rank") <= params.top_n)
    out = _trend_report(top.withColumn("RevenueRankInCategory", F.col("_rank").cast("long")), params)
    if ordered:
        out = out.orderBy("CategoryName", "ProductName", "Year", "Month")
    return out
