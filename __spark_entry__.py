"""

``entry(spark)`` runs the flagship query (monthly growth) on sf0.001.
``queries()`` maps every implemented operator to a ``(spark, sf_dir) ->
DataFrame`` callable over the driver's TPC-H style tables (whole tables,
through the adapter in ``ledgerline.sources.tpch``); ``oracle_sql()`` gives
the equivalent DuckDB SQL for each of them, written against the raw tables
with the same role mapping, rounding and tie-break rules.
"""

from __future__ import annotations

import os
import sys
import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from ledgerline import operators as ops  # noqa: E402
from ledgerline.params import DEFAULTS, RfmParams  # noqa: E402
from ledgerline.session import apply_skew_conf, ensure_checkpoint_dir  # noqa: E402
from ledgerline.sources.model import SalesTables  # noqa: E402
from ledgerline.sources.tpch import tpch_tables  # noqa: E402

try:  # the training-data subpackage is optional
    import corpus_pipeline
    from ledgerline.llm.queries import ORACLE_SQL as LLM_ORACLE_SQL
    from ledgerline.llm.queries import QUERIES as LLM_QUERIES

    LLM_QUERIES = {**LLM_QUERIES, "pipeline": corpus_pipeline.run}
except ImportError:
    LLM_QUERIES, LLM_ORACLE_SQL = {}, {}

SMOKE_DIR = "/root/testdata/sf0.001"


def _doubles(df: DataFrame) -> DataFrame:
    """Emit exact decimals as DOUBLE (the reports' numeric type)."""
    return df.select(*[F.col(f.name).cast("double").alias(f.name) if isinstance(f.dataType, DecimalType)
                       else F.col(f.name) for f in df.schema.fields])


def _run(fn: Callable) -> Callable[[SparkSession, str], DataFrame]:
    def call(spark: SparkSession, sf_dir: str) -> DataFrame:
        # The checkpoint folder is resolved lazily, by the operators that
        # checkpoint (large inputs only).
        apply_skew_conf(spark)
        return _doubles(fn(spark, tpch_tables(spark, sf_dir)))
    call.__name__ = getattr(fn, "__name__", "query")
    return call


def _fact_refresh(spark: SparkSession, t: SalesTables) -> DataFrame:
    """The fact stored without the orders of the last 45 days (nor those
    without a date), then refreshed by these orders' ids."""
    name = f"ledgerline_{uuid.uuid4().hex}"
    latest = t.orders.agg(F.date_sub(F.max("OrderDate"), 45)).scalar()
    early = F.coalesce(F.col("OrderDate") <= latest, F.lit(False))
    ops.store_fact(spark, replace(t, orders=t.orders.where(early)), name, f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}")
    ops.refresh_fact(spark, t, name, t.orders.where(~early))
    return ops.stored_fact(spark, name)


def entry(spark: SparkSession) -> DataFrame:
    return queries()["monthly_growth"](spark, SMOKE_DIR)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "net_revenue_lines": _run(lambda s, t: ops.net_revenue_lines(t)),
        "revenue_by_order": _run(lambda s, t: ops.order_revenue(t)),
        "customer_order_stats": _run(lambda s, t: ops.customer_order_stats(t)),
        "customer_rfm": _run(lambda s, t: ops.customer_rfm(t)),
        "customer_rfm_dense": _run(lambda s, t: ops.customer_rfm(t, RfmParams(rank_method="dense_rank"))),
        "product_month_base": _run(lambda s, t: ops.product_month_base(t)),
        "product_trend": _run(lambda s, t: ops.product_trend(t)),
        "product_top3": _run(lambda s, t: ops.product_top(t)),
        "monthly_growth": _run(lambda s, t: ops.monthly_growth(t)),
        "customer_concentration": _run(lambda s, t: ops.customer_concentration(t)),
        "hhi_total": _run(lambda s, t: ops.hhi_summary(t)),
        "pareto_cutoff": _run(lambda s, t: ops.pareto_cutoff(t)),
        "customer_churn": _run(lambda s, t: ops.customer_churn(t)),
        "fact_sales": _run(lambda s, t: ops.fact_sales(t)),
        "fact_sales_load": _run(lambda s, t: ops.fact_sales_load(t)),
        "fact_refresh": _run(_fact_refresh),
        "dim_customer": _run(lambda s, t: ops.dim_customer(t)),
        "dim_product": _run(lambda s, t: ops.dim_product(t)),
        "dim_category": _run(lambda s, t: ops.dim_category(t)),
        "dim_date": _run(lambda s, t: ops.calendar_for(t)),
        "orphan_customers": _run(lambda s, t: ops.orphan_customers(t)),
        "distinct_by_period": _run(lambda s, t: ops.distinct_by_period(t)),
        "orders_without_lines": _run(lambda s, t: ops.orders_without_lines(t)),
        "star_rollup": _run(lambda s, t: ops.star_rollup(t)),
        "star_rollup_sql": _run(lambda s, t: ops.star_rollup_sql(s, t, prefix="ledgerline_")),
        **LLM_QUERIES,
    }


# ---------------------------------------------------------------------------
# DuckDB oracle.  The CTEs below restate the role mapping of the adapter on
# the raw tables; each query then restates its operator's rules.  Engine
# differences are spelled out rather than left to defaults:
#   * window orders say NULLS FIRST/LAST (DuckDB sorts NULLs last by default);
#   * divisions use NULLIF (DuckDB gives inf for x / 0.0);
#   * ratios are DOUBLE divisions fixed to DECIMAL(38,10) before ROUND, and
#     averages use HUGEINT integer division, as in functions/money.py;
#   * extended price x (1 - discount) in DECIMAL: the driver's tables hold both
#     with two decimals, so a net has four and the casts round nothing; exact
#     decimals settle the half cents that binary sums would leave to chance;
#   * every output is cast to BIGINT / DOUBLE / DATE / VARCHAR.
# ---------------------------------------------------------------------------

_BASE = """
od AS (
  SELECT l_orderkey AS OrderID, l_partkey AS ProductID,
         l_quantity AS Quantity, l_discount AS Discount, l_extendedprice AS GrossAmount,
         l_extendedprice / NULLIF(l_quantity, 0) AS UnitPrice
  FROM lineitem),
odn AS (SELECT *, CAST(CAST(GrossAmount AS DECIMAL(15,2)) * (1 - CAST(Discount AS DECIMAL(4,2))) AS DECIMAL(18,4)) AS Net FROM od),
o AS (SELECT o_orderkey AS OrderID, o_custkey AS CustomerID, CAST(o_orderdate AS DATE) AS OrderDate FROM orders),
p AS (SELECT p_partkey AS ProductID, p_name || ' #' || CAST(p_partkey AS VARCHAR) AS ProductName,
             p_type AS CategoryID FROM part),
cat AS (SELECT DISTINCT p_type AS CategoryID, p_type AS CategoryName FROM part WHERE p_type IS NOT NULL),
cu AS (SELECT c_custkey AS CustomerID, c_name AS CompanyName, n_name AS Country, c_mktsegment AS City
       FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey),
rbo AS (SELECT OrderID, SUM(Net) AS rev FROM odn GROUP BY OrderID)
"""


def _with(*ctes: str) -> str:
    return "WITH " + ",\n".join([_BASE.strip(), *[c.strip() for c in ctes]]) + "\n"


def _ratio(num: str, den: str, scale: int, factor_first: bool = False) -> str:
    """Mirror of functions.money.ratio with factor 100."""
    n, d = f"CAST({num} AS DOUBLE)", f"NULLIF(CAST({den} AS DOUBLE), 0)"
    q = f"({n} * 100.0) / {d}" if factor_first else f"({n} / {d}) * 100.0"
    return f"CAST(ROUND(CAST({q} AS DECIMAL(38,10)), {scale}) AS DOUBLE)"


def _mean2(total: str, n: str) -> str:
    """Mirror of functions.money.mean_round2 (total has 4 decimals)."""
    return (f"sign({total}) * CAST((CAST(abs({total}) * 10000 AS HUGEINT) * 200 + NULLIF({n}, 0) * 10000) "
            f"// (NULLIF({n}, 0) * 20000) AS DOUBLE) / 100")


def _per30(total2: str, days: str) -> str:
    """Mirror of functions.money.per_period_round2 with 30-day months."""
    return (f"sign({total2}) * CAST((CAST(abs({total2}) * 100 AS HUGEINT) * 60 + NULLIF({days}, 0)) "
            f"// (2 * NULLIF({days}, 0)) AS DOUBLE) / 100")


_STATS = """
st AS (
  SELECT o.CustomerID, COUNT(DISTINCT o.OrderID) AS TotalOrders, SUM(COALESCE(r.rev, 0)) AS total,
         COUNT(*) AS nrows, MIN(o.OrderDate) AS FirstPurchase, MAX(o.OrderDate) AS LastPurchase
  FROM o LEFT JOIN rbo r ON o.OrderID = r.OrderID
  GROUP BY o.CustomerID
  HAVING COUNT(DISTINCT o.OrderID) >= 2)
"""


def _rfm(rank_fn: str) -> str:
    return _with(_STATS, "md AS (SELECT MAX(OrderDate) AS MaxDate FROM o)",
                 "b AS (SELECT st.*, cu.CompanyName, cu.Country FROM st JOIN cu ON st.CustomerID = cu.CustomerID)") + f"""
SELECT CustomerID, CompanyName, Country, CAST(TotalOrders AS BIGINT) AS TotalOrders,
       CAST(ROUND(total, 2) AS DOUBLE) AS TotalRevenue,
       {_mean2('total', 'nrows')} AS AvgOrderValue,
       FirstPurchase, LastPurchase,
       CAST(date_diff('day', LastPurchase, (SELECT MaxDate FROM md)) AS BIGINT) AS DaysSinceLastPurchase,
       CAST({rank_fn}() OVER (PARTITION BY Country ORDER BY total DESC) AS BIGINT) AS RevenueRank,
       CAST(ROUND(SUM(total) OVER (PARTITION BY Country), 2) AS DOUBLE) AS CountryTotalRevenue,
       {_ratio('total', 'SUM(total) OVER (PARTITION BY Country)', 2, factor_first=True)} AS PctOfCountryRevenue
FROM b
"""


_TREND_BASE = """
base AS (
  SELECT CAST(date_trunc('month', o.OrderDate) AS DATE) AS OrderMonth, c.CategoryName, p.ProductName,
         SUM(od.Net) AS rev, CAST(COUNT(DISTINCT od.OrderID) AS BIGINT) AS MonthlyOrders
  FROM odn od JOIN o ON od.OrderID = o.OrderID
          JOIN p ON od.ProductID = p.ProductID
          JOIN cat c ON p.CategoryID = c.CategoryID
  GROUP BY 1, 2, 3)
"""


def _trend(where: str = "") -> str:
    w = "PARTITION BY ProductName ORDER BY OrderMonth ASC NULLS FIRST, CategoryName ASC NULLS FIRST"
    return _with(_TREND_BASE, f"""
w AS (SELECT *, LAG(rev) OVER ({w}) AS prev,
             SUM(rev) OVER ({w} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run,
             DENSE_RANK() OVER (PARTITION BY CategoryName, OrderMonth ORDER BY rev DESC) AS rnk
      FROM base)""", f"g AS (SELECT *, {_ratio('rev - prev', 'prev', 2)} AS growth FROM w)") + f"""
SELECT CAST(year(OrderMonth) AS BIGINT) AS Year, CAST(month(OrderMonth) AS BIGINT) AS Month,
       CategoryName, ProductName,
       CAST(ROUND(rev, 2) AS DOUBLE) AS MonthlyRevenue, MonthlyOrders,
       CAST(ROUND(prev, 2) AS DOUBLE) AS PrevMonthRevenue,
       growth AS RevenueGrowthPct,
       CAST(ROUND(run, 2) AS DOUBLE) AS RunningRevenueByProduct,
       CAST(rnk AS BIGINT) AS RevenueRankInCategory,
       CASE WHEN rnk <= 3 THEN 'TOP 3' END AS Top3Flag,
       CASE WHEN growth IS NULL THEN NULL
            WHEN growth < -20 THEN 'SHARP DECLINE'
            WHEN growth < 0 THEN 'DECLINING'
            WHEN growth > 20 THEN 'GROWING'
            ELSE 'STABLE' END AS TrendAlert
FROM g {where}
"""


_CONC = [
    """cr AS (SELECT o.CustomerID, cu.CompanyName, CAST(ROUND(SUM(r.rev), 2) AS DECIMAL(18,2)) AS CR
           FROM rbo r JOIN o ON r.OrderID = o.OrderID JOIN cu ON o.CustomerID = cu.CustomerID
           GROUP BY o.CustomerID, cu.CompanyName)""",
    "tot AS (SELECT SUM(CR) AS T FROM cr)",
    f"""sh AS (SELECT cr.*, tot.T,
              CAST(ROUND(CAST((CAST(CR AS DOUBLE) / NULLIF(CAST(T AS DOUBLE), 0)) * 100.0 AS DECIMAL(38,10)), 4)
                   AS DECIMAL(9,4)) AS share
           FROM cr, tot)""",
]
_ORDER = "ORDER BY CR DESC, CustomerID ASC"

_FACT = """
fact AS (SELECT od.OrderID, o.CustomerID, od.ProductID, p.CategoryID, o.OrderDate, od.Quantity,
                od.UnitPrice, od.Discount, od.Net
         FROM odn od JOIN o ON od.OrderID = o.OrderID JOIN p ON od.ProductID = p.ProductID)
"""
_DIMCUST = """
dc AS (SELECT CustomerID, CompanyName,
              CASE WHEN trim(Country) = 'USA' THEN 'United States'
                   WHEN trim(Country) = 'UK' THEN 'United Kingdom'
                   ELSE trim(Country) END AS Country, City FROM cu)
"""
_ROLLUP = _with(_FACT, _DIMCUST) + """
SELECT c.CategoryName, CAST(year(f.OrderDate) AS BIGINT) AS Year, CAST(quarter(f.OrderDate) AS BIGINT) AS Quarter,
       dc.Country, CAST(ROUND(SUM(f.Net), 2) AS DOUBLE) AS NetRevenue,
       CAST(SUM(CAST(f.Quantity AS DECIMAL(18,6))) AS DOUBLE) AS Quantity, CAST(COUNT(*) AS BIGINT) AS Lines
FROM fact f LEFT JOIN dc ON f.CustomerID = dc.CustomerID LEFT JOIN cat c ON f.CategoryID = c.CategoryID
GROUP BY 1, 2, 3, 4
"""


def _pareto() -> str:
    xs = DEFAULTS.concentration.pareto_thresholds
    acc = f"""acc AS (SELECT ROW_NUMBER() OVER ({_ORDER}) AS rn,
                  ROUND(SUM(share) OVER ({_ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 2) AS a
           FROM sh)"""
    mins = ", ".join(f"MIN(CASE WHEN a >= {x} THEN rn END) AS k{i}" for i, x in enumerate(xs))
    agg = f"agg AS (SELECT COUNT(*) AS n, {mins} FROM acc)"
    parts = [f"""SELECT CAST({x} AS DOUBLE) AS ThresholdPct, CAST(k{i} AS BIGINT) AS CustomersToReach,
       CAST(n AS BIGINT) AS TotalCustomers, {_ratio(f'k{i}', 'n', 2, factor_first=True)} AS PctOfCustomers
FROM agg""" for i, x in enumerate(xs)]
    return _with(*_CONC, acc, agg) + "\nUNION ALL\n".join(parts)


def oracle_sql() -> dict[str, str]:
    fact_cols = "OrderID, CustomerID, ProductID, CategoryID, OrderDate, Quantity"
    return {
        "net_revenue_lines": _with() + """
SELECT OrderID, ProductID, Quantity, Discount,
       CAST(GrossAmount AS DOUBLE) AS GrossAmount, CAST(Net AS DOUBLE) AS NetRevenue FROM odn""",
        "revenue_by_order": _with() + "SELECT OrderID, CAST(rev AS DOUBLE) AS OrderRevenue FROM rbo",
        "customer_order_stats": _with(_STATS) + f"""
SELECT CustomerID, CAST(TotalOrders AS BIGINT) AS TotalOrders, CAST(ROUND(total, 2) AS DOUBLE) AS TotalRevenue,
       {_mean2('total', 'nrows')} AS AvgOrderValue, FirstPurchase, LastPurchase FROM st""",
        "customer_rfm": _rfm("RANK"),
        "customer_rfm_dense": _rfm("DENSE_RANK"),
        "product_month_base": _with(_TREND_BASE) + """
SELECT OrderMonth, CategoryName, ProductName, CAST(rev AS DOUBLE) AS MonthlyRevenue, MonthlyOrders FROM base""",
        "product_trend": _trend(),
        "product_top3": _trend("WHERE rnk <= 3"),
        "monthly_growth": _with(
            """m AS (SELECT CAST(date_trunc('month', o.OrderDate) AS DATE) AS OrderMonth, SUM(r.rev) AS rev
                     FROM rbo r JOIN o ON r.OrderID = o.OrderID GROUP BY 1)""",
            """w AS (SELECT OrderMonth, rev, LAG(rev) OVER (ORDER BY OrderMonth ASC NULLS FIRST) AS prev,
                SUM(rev) OVER (ORDER BY OrderMonth ASC NULLS FIRST
                               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum,
                SUM(rev) OVER (ORDER BY OrderMonth ASC NULLS FIRST ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS s3,
                COUNT(rev) OVER (ORDER BY OrderMonth ASC NULLS FIRST ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS n3
         FROM m)""") + f"""
SELECT CAST(year(OrderMonth) AS BIGINT) AS Year, CAST(month(OrderMonth) AS BIGINT) AS Month,
       CAST(ROUND(rev, 2) AS DOUBLE) AS MonthlyRevenue, CAST(ROUND(prev, 2) AS DOUBLE) AS PrevMonthRevenue,
       {_ratio('rev - prev', 'prev', 2)} AS RevenueGrowthPct,
       CAST(ROUND(cum, 2) AS DOUBLE) AS CumulativeRevenue,
       {_mean2('s3', 'n3')} AS MovingAvg3Months
FROM w""",
        "customer_concentration": _with(*_CONC) + f"""
SELECT CustomerID, CompanyName, CAST(CR AS DOUBLE) AS CustomerRevenue, CAST(T AS DOUBLE) AS TotalRevenue,
       CAST(share AS DOUBLE) AS RevenueSharePct,
       CAST(ROUND(share * share * 0.0001, 6) AS DOUBLE) AS RevenueShareSq,
       CAST(ROUND(share * share, 4) AS DOUBLE) AS HHI_Contribution,
       CAST(ROUND(SUM(share) OVER ({_ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 2) AS DOUBLE)
         AS AccumulatedSharePct,
       CASE WHEN NTILE(10) OVER ({_ORDER}) = 1 THEN 'TOP 10%'
            WHEN NTILE(10) OVER ({_ORDER}) <= 5 THEN 'MIDDLE 40%'
            ELSE 'BOTTOM 50%' END AS CustomerSegment
FROM sh""",
        "hhi_total": _with(*_CONC, """h AS (
  SELECT CAST(COUNT(*) AS BIGINT) AS Customers, CAST((SELECT T FROM tot) AS DOUBLE) AS TotalRevenue,
         CAST(SUM(ROUND(share * share, 4)) AS DOUBLE) AS TotalHHI,
         CAST(ROUND(CAST((CAST(SUM(CR * CR) AS DOUBLE)
                          / NULLIF(CAST(MAX(T) AS DOUBLE) * CAST(MAX(T) AS DOUBLE), 0)) * 10000.0
                         AS DECIMAL(38,10)), 4) AS DOUBLE) AS ExactHHI
  FROM sh)""") + """
SELECT Customers, TotalRevenue, TotalHHI, ExactHHI,
       CASE WHEN ExactHHI < 1500 THEN 'HEALTHY' WHEN ExactHHI <= 2500 THEN 'MODERATE'
            WHEN ExactHHI IS NOT NULL THEN 'CRITICAL' END AS HHIBand
FROM h""",
        "pareto_cutoff": _pareto(),
        "customer_churn": _with(
            """act AS (SELECT o.CustomerID, MIN(o.OrderDate) AS F, MAX(o.OrderDate) AS L, SUM(r.rev) AS total
                       FROM rbo r JOIN o ON r.OrderID = o.OrderID GROUP BY o.CustomerID)""",
            "md AS (SELECT MAX(OrderDate) AS R FROM o)") + f"""
SELECT a.CustomerID, cu.CompanyName, cu.Country, F AS FirstPurchaseDate, L AS LastPurchaseDate,
       CAST(date_diff('day', L, (SELECT R FROM md)) AS BIGINT) AS DaysSinceLastPurchase,
       CAST(ROUND(total, 2) AS DOUBLE) AS TotalHistoricRevenue,
       {_per30('ROUND(total, 2)', "date_diff('day', F, L)")} AS AvgMonthlyRevenue,
       CASE WHEN date_diff('day', L, (SELECT R FROM md)) >= 180 THEN 'LOST'
            WHEN date_diff('day', L, (SELECT R FROM md)) >= 90 THEN 'AT RISK'
            ELSE 'ACTIVE' END AS ChurnRisk
FROM act a JOIN cu ON a.CustomerID = cu.CustomerID""",
        "fact_sales": _with(_FACT) + f"""
SELECT {fact_cols}, UnitPrice, Discount, CAST(Net AS DOUBLE) AS NetRevenue FROM fact""",
        "fact_sales_load": _with(_FACT) + f"SELECT {fact_cols}, CAST(Net AS DOUBLE) AS NetRevenue FROM fact",
        "fact_refresh": _with(_FACT) + f"SELECT {fact_cols}, UnitPrice, Discount, CAST(Net AS DOUBLE) AS NetRevenue FROM fact",
        "dim_customer": _with(_DIMCUST) + "SELECT CustomerID, CompanyName, Country, City FROM dc",
        "dim_product": _with() + "SELECT ProductID, ProductName, CategoryID FROM p",
        "dim_category": _with() + "SELECT CategoryID, CategoryName FROM cat",
        "dim_date": _with(_FACT, "b AS (SELECT MIN(OrderDate) AS lo, MAX(OrderDate) AS hi FROM fact)",
                          """d AS (SELECT CAST(unnest(generate_series(CAST(lo AS TIMESTAMP), CAST(hi AS TIMESTAMP),
                                                                  INTERVAL 1 DAY)) AS DATE) AS Date FROM b)""") + """
SELECT Date, CAST(year(Date) AS BIGINT) AS Year, CAST(month(Date) AS BIGINT) AS Month,
       strftime(Date, '%b') AS "Month Name", CAST(quarter(Date) AS BIGINT) AS Quarter,
       'Q' || CAST(quarter(Date) AS VARCHAR) AS "Quarter Name",
       CAST(dayofweek(Date) AS BIGINT) AS "Day of Week", strftime(Date, '%a') AS "Day Name"
FROM d""",
        "orphan_customers": _with() + """
SELECT o.CustomerID, CAST(COUNT(*) AS BIGINT) AS Orders, MIN(o.OrderDate) AS FirstOrderDate,
       MAX(o.OrderDate) AS LastOrderDate
FROM o WHERE NOT EXISTS (SELECT 1 FROM cu WHERE cu.CustomerID = o.CustomerID)
GROUP BY o.CustomerID""",
        "distinct_by_period": "\nUNION ALL\n".join(f"""
SELECT '{x}' AS Level, CAST(date_trunc('{x}', o_orderdate) AS DATE) AS PeriodStart, COUNT(DISTINCT o_orderkey) AS Orders,
       COUNT(DISTINCT o_custkey) AS Customers
FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem) GROUP BY 1, 2""" for x in ("month", "quarter", "year")),
        "orders_without_lines": """
SELECT o_orderkey AS OrderID, o_custkey AS CustomerID, CAST(o_orderdate AS DATE) AS OrderDate
FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_orderkey IS NOT NULL)""",
        "star_rollup": _ROLLUP,
        "star_rollup_sql": _ROLLUP,
        **LLM_ORACLE_SQL,
    }
