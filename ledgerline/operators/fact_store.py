"""The sales fact as a stored table by month, refreshed month by month.

``store_fact`` loads the whole fact once, partitioned by the month of the
order (orders without a date have a partition of their own).  After that
``refresh_fact`` takes the ids of orders that were added, changed or deleted,
with any of their lines, finds the months they stand in (now, or in the
stored fact), recomputes these months from the source tables and replaces
exactly their partitions by a dynamic overwrite; a month left without rows is
dropped.  The other partitions aren't read or written, and the result is that
of a full load.

Only month starts reach the driver: one value per month, a bound set by the
calendar.  A month that holds most rows is split over tasks by the rebalance
before the write.  A refresh that was broken off can be run again.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ledgerline.functions.dates import month_start
from ledgerline.operators.star import fact_sales
from ledgerline.sources.model import SalesTables

MONTH = "OrderMonth"


def _by_month(t: SalesTables) -> DataFrame:
    return fact_sales(t).withColumn(MONTH, month_start(F.col("OrderDate"))).hint("rebalance", F.col(MONTH))


def _in_months(month: Column, months: Sequence[dt.date | None]) -> Column:
    dated = month.isin([m for m in months if m is not None])
    return (dated | month.isNull()) if None in months else dated


def _months(df: DataFrame, month: Column) -> set[dt.date | None]:
    return {r[0] for r in df.select(month.alias(MONTH)).distinct().collect()}


def store_fact(spark: SparkSession, t: SalesTables, database: str, location: str, table: str = "fact_sales") -> DataFrame:
    """Write the whole fact to a table of ``database`` at ``location`` (shared
    storage), partitioned by month; returns the stored fact."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database} LOCATION '{location}'")
    _by_month(t).write.mode("overwrite").format("parquet").partitionBy(MONTH).saveAsTable(f"{database}.{table}")
    return stored_fact(spark, database, table)


def stored_fact(spark: SparkSession, database: str, table: str = "fact_sales") -> DataFrame:
    """The nine columns of the stored fact."""
    return spark.table(f"{database}.{table}").drop(MONTH)


def refresh_fact(spark: SparkSession, t: SalesTables, database: str, changed: DataFrame,
                 table: str = "fact_sales") -> dict[dt.date | None, int]:
    """Bring the stored fact up to ``t`` after a change of the orders in
    ``changed`` (column OrderID); returns the rows now in each touched month.

    No changed order, or only unknown ones: nothing is written.
    """
    name = f"{database}.{table}"
    ids = changed.select("OrderID").where("OrderID IS NOT NULL").distinct()
    stored = spark.table(name)
    before = _months(stored.join(ids, "OrderID", "left_semi"), F.col(MONTH))
    now = _months(t.orders.join(ids, "OrderID", "left_semi"), month_start(F.col("OrderDate")))
    months = sorted(before | now, key=lambda m: (m is not None, m))
    if not months:
        return {}
    part = replace(t, orders=t.orders.where(_in_months(month_start(F.col("OrderDate")), months)), order_facts=None)
    seen = Observation()
    counts = [F.count(F.when(_in_months(F.col(MONTH), [m]), 1)).alias(f"m{k}") for k, m in enumerate(months)]
    fresh = _by_month(part).select(*stored.columns).observe(seen, *counts)
    mode = "spark.sql.sources.partitionOverwriteMode"
    old = spark.conf.get(mode)
    spark.conf.set(mode, "dynamic")
    try:
        fresh.write.mode("overwrite").insertInto(name)
    finally:
        spark.conf.set(mode, old)
    rows = {m: int(seen.get[f"m{k}"]) for k, m in enumerate(months)}
    for m in before:
        if not rows[m]:                                    # a dynamic overwrite leaves a month without new rows as it was
            value = "null" if m is None else f"DATE'{m}'"
            spark.sql(f"ALTER TABLE {name} DROP IF EXISTS PARTITION ({MONTH} = {value})")
    return rows
