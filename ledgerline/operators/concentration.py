"""Customer concentration: revenue shares, HHI, accumulated share, deciles.

Rounding follows the analysis exactly: customer revenue to 2 decimals, the
company total is the sum of those, the share to 4 decimals, the squared
share (as a fraction) to 6, the HHI contribution (share squared on the
0..10,000 scale) to 4, and the accumulated share is the running sum of the
rounded shares, shown to 2 decimals.  All of it is exact DECIMAL arithmetic
once the share is known.

The running share and the deciles are ordered by revenue, largest first,
with the customer id breaking ties (the share order is the same order,
since a larger revenue never has a smaller share).  Both run through
``ordered_window``, which splits the global order across tasks.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.money import RATIO_DEC, ratio, round_out
from ledgerline.operators.revenue import orders_with_revenue
from ledgerline.params import DEFAULTS, ConcentrationParams, WindowParams
from ledgerline.plans.ordered import WindowOutputs, fits_one_task, ordered_window
from ledgerline.sources.model import SalesTables

SHARE = "decimal(9,4)"


def revenue_share(revenue: Column, total: Column) -> Column:
    """Percent of ``total``, rounded to 4 decimals, as DECIMAL(9,4); NULL if
    the total is 0.  Same rule as ``functions.money.ratio``, kept decimal so
    squares and running sums of it are exact."""
    q = (revenue.cast("double") / F.nullif(total.cast("double"), F.lit(0.0))) * F.lit(100.0)
    return F.round(q.cast(RATIO_DEC), 4).cast(SHARE)


def customer_revenue(t: SalesTables) -> DataFrame:
    """(CustomerID, CompanyName, CustomerRevenue DECIMAL(18,2)) for customers
    with order lines and a customer row."""
    per_customer = (orders_with_revenue(t, "inner")
                    .groupBy("CustomerID")
                    .agg(F.sum("OrderRevenue").alias("_rev")))
    return (per_customer.join(t.customers.select("CustomerID", "CompanyName"), "CustomerID")
            .select("CustomerID", "CompanyName",
                    F.round("_rev", 2).cast("decimal(18,2)").alias("CustomerRevenue")))


def concentration_frame(t: SalesTables, params: ConcentrationParams = DEFAULTS.concentration,
                        window: WindowParams = DEFAULTS.window) -> DataFrame:
    """Decimal working frame: shares, contributions, running share, tile, row number."""
    cr = customer_revenue(t)
    # A direct window gathers the customers in one task anyway: there the total needs no pass of its own.
    total = (F.sum("CustomerRevenue").over(Window.partitionBy()) if fits_one_task(t.customers, window)
             else cr.select(F.sum("CustomerRevenue")).scalar())
    share = revenue_share(F.col("CustomerRevenue"), total)
    shares = cr.select("CustomerID", "CompanyName", "CustomerRevenue",
                       total.alias("TotalRevenue"), share.alias("_share"))
    shares = shares.withColumns({
        "_share_sq": F.round(F.col("_share") * F.col("_share") * F.lit(Decimal("0.0001")), 6),
        "_hhi": F.round(F.col("_share") * F.col("_share"), 4),
    })
    return ordered_window(
        shares, order_keys=[("CustomerRevenue", False)], tiebreak=[("CustomerID", True)],
        outputs=WindowOutputs(row_number="_rn", running_sums={"_acc": "_share"},
                              ntile=("_tile", params.tiles)),
        params=window, bounded_by=t.customers)


def customer_concentration(t: SalesTables, params: ConcentrationParams = DEFAULTS.concentration,
                           window: WindowParams = DEFAULTS.window, ordered: bool = True) -> DataFrame:
    f = concentration_frame(t, params, window)
    out = f.select(
        "CustomerID", "CompanyName",
        F.col("CustomerRevenue").cast("double").alias("CustomerRevenue"),
        F.col("TotalRevenue").cast("double").alias("TotalRevenue"),
        F.col("_share").cast("double").alias("RevenueSharePct"),
        F.col("_share_sq").cast("double").alias("RevenueShareSq"),
        F.col("_hhi").cast("double").alias("HHI_Contribution"),
        round_out("_acc", 2).alias("AccumulatedSharePct"),
        F.when(F.col("_tile") <= params.top_tiles, F.lit(params.top_label))
         .when(F.col("_tile") <= params.middle_tiles, F.lit(params.middle_label))
         .otherwise(F.lit(params.bottom_label)).alias("CustomerSegment"),
        "_rn",
    )
    if ordered:
        out = out.orderBy("_rn")
    return out.drop("_rn")


def hhi_summary(t: SalesTables, params: ConcentrationParams = DEFAULTS.concentration) -> DataFrame:
    """One row: customers, total revenue, HHI as the sum of the rounded
    contributions, HHI from unrounded shares, and the health band.

    The band is read from the unrounded HHI: with many customers most
    rounded contributions become 0 and their sum understates concentration.
    """
    cr = customer_revenue(t)
    # The total is a scalar subquery over the same plan; adaptive execution
    # reuses the customer-revenue exchanges instead of recomputing them.
    total = cr.select(F.sum("CustomerRevenue")).scalar()
    share = revenue_share(F.col("CustomerRevenue"), total)
    sums = cr.agg(
        F.count(F.lit(1)).cast("long").alias("Customers"),
        F.sum(F.round(share * share, 4)).alias("_hhi"),
        # exact sum of squared revenues, so the result does not depend on
        # the order rows are added in
        F.sum(F.col("CustomerRevenue") * F.col("CustomerRevenue")).alias("_sumsq"),
    )
    if params.band_from not in ("exact", "reported"):
        raise ValueError("band_from must be 'exact' or 'reported'")
    t2 = total.cast("double") * total.cast("double")
    exact_q = (F.col("_sumsq").cast("double") / F.nullif(t2, F.lit(0.0))) * F.lit(10000.0)
    exact = F.round(exact_q.cast(RATIO_DEC), 4).cast("double")
    reported = F.col("_hhi").cast("double")
    hhi = exact if params.band_from == "exact" else reported
    return sums.select(
        "Customers", total.cast("double").alias("TotalRevenue"),
        reported.alias("TotalHHI"),
        exact.alias("ExactHHI"),
        F.when(hhi < params.healthy_below, F.lit("HEALTHY"))
         .when(hhi <= params.critical_above, F.lit("MODERATE"))
         .when(hhi.isNotNull(), F.lit("CRITICAL")).alias("HHIBand"),
    )


def pareto_cutoff(t: SalesTables, params: ConcentrationParams = DEFAULTS.concentration,
                  window: WindowParams = DEFAULTS.window) -> DataFrame:
    """How many of the largest customers it takes to reach X % of revenue.

    For each threshold X: the position of the first customer whose shown
    accumulated share (2 decimals) reaches X, the customer count and that
    position as a percentage of customers.  One aggregation pass with a
    conditional minimum per threshold.
    """
    f = concentration_frame(t, params, window)
    acc = F.round("_acc", 2)
    aggs = [F.count(F.lit(1)).cast("long").alias("_n")]
    for i, x in enumerate(params.pareto_thresholds):
        aggs.append(F.min(F.when(acc >= F.lit(Decimal(str(x))), F.col("_rn"))).alias(f"_k{i}"))
    one = f.agg(*aggs)
    rows = F.array(*[
        F.struct(F.lit(float(x)).alias("ThresholdPct"), F.col(f"_k{i}").cast("long").alias("CustomersToReach"))
        for i, x in enumerate(params.pareto_thresholds)])
    return (one.select("_n", F.inline(rows))
            .select("ThresholdPct", "CustomersToReach", F.col("_n").alias("TotalCustomers"),
                    ratio("CustomersToReach", "_n", 2, factor=100.0, factor_first=True).alias("PctOfCustomers")))
