"""Exact distinct counts and membership by mergeable bitmaps.

Integral ids are kept as bitmaps of 32,768 ids each (4 KB), built in every
task before the shuffle.  Bitmaps of months are merged into those of quarters
and years, so the coarser levels never read orders or lines again; and a test
for "has any line" needs the lines' bitmaps only, not their rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from ledgerline.functions.dates import as_date
from ledgerline.sources.model import SalesTables

LEVELS = ("month", "quarter", "year")


def _integral(df: DataFrame, name: str) -> None:
    if not isinstance(df.schema[name].dataType, IntegralType):
        raise ValueError(f"{name}: bitmaps need integral ids, not {df.schema[name].dataType.simpleString()}")


def distinct_by_period(t: SalesTables) -> DataFrame:
    """(Level, PeriodStart, Orders, Customers): distinct orders with lines and
    distinct customers of them, per month, quarter and year.

    A customer of several months counts once in their quarter: counts of months
    can't be added, bitmaps can be merged.  Orders without a date are left out;
    a NULL customer isn't counted.  Ids must be integral.
    """
    for name in ("OrderID", "CustomerID"):
        _integral(t.orders, name)
    orders = t.orders.select("OrderID", "CustomerID", F.trunc(as_date("OrderDate"), "month").alias("PeriodStart"))
    sold = orders.where(F.col("PeriodStart").isNotNull()).join(t.order_details.select("OrderID"), "OrderID", "left_semi")
    ids = F.inline(F.array(*[F.struct(F.lit(name).alias("kind"), F.col(name).cast("long").alias("id")) for name in ("OrderID", "CustomerID")]))
    months = (sold.select("PeriodStart", ids).where("id IS NOT NULL")
              .groupBy("PeriodStart", "kind", F.bitmap_bucket_number("id").alias("bucket"))
              .agg(F.bitmap_construct_agg(F.bitmap_bit_position("id")).alias("bits")))
    levels = F.inline(F.array(*[F.struct(F.lit(x).alias("Level"), F.trunc("PeriodStart", x).alias("start")) for x in LEVELS]))
    merged = (months.select("kind", "bucket", "bits", levels).groupBy("Level", "start", "kind", "bucket")
              .agg(F.bitmap_or_agg("bits").alias("bits")))

    def count(kind: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("kind") == kind, F.bitmap_count("bits"))), F.lit(0)).cast("long")

    return merged.groupBy("Level", F.col("start").alias("PeriodStart")).agg(
        count("OrderID").alias("Orders"), count("CustomerID").alias("Customers"))


def orders_without_lines(t: SalesTables) -> DataFrame:
    """(OrderID, CustomerID, OrderDate) of orders that no line names.

    Lines become bitmaps of order ids inside each task; the anti join shuffles
    these and the orders by bucket of ids, never the lines.  A NULL order id
    has no line.  Ids must be integral.
    """
    _integral(t.orders, "OrderID")
    _integral(t.order_details, "OrderID")
    key = F.col("OrderID").cast("long")
    lines = (t.order_details.where("OrderID IS NOT NULL").groupBy(F.bitmap_bucket_number(key).alias("bucket"))
             .agg(F.bitmap_construct_agg(F.bitmap_bit_position(key)).alias("bits")))
    orders = t.orders.select("OrderID", "CustomerID", "OrderDate", F.bitmap_bucket_number(key).alias("bucket"),
                             F.bitmap_bit_position(key).alias("place"))
    byte = F.expr("cast(conv(hex(substring(bits, cast(place div 8 as int) + 1, 1)), 16, 10) as int)")
    has = F.coalesce(F.getbit(byte, (F.col("place") % 8).cast("int")), F.lit(0)) == 1
    return orders.join(lines, "bucket", "left").where(F.col("OrderID").isNull() | ~has).select("OrderID", "CustomerID", "OrderDate")
