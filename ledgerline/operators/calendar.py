"""Calendar dimension generated from the fact's own date range."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.dates import (
    as_date,
    day_abbrev,
    day_of_week,
    month_abbrev,
    month_of,
    quarter_of,
    year_of,
)
from ledgerline.params import DEFAULTS, CalendarParams, JoinParams
from ledgerline.plans.joins import join_dimension
from ledgerline.sources.model import SalesTables


def dim_date(fact: DataFrame, params: CalendarParams = DEFAULTS.calendar,
             date_col: str = "OrderDate") -> DataFrame:
    """Every day from the fact's first to its last date, inclusive.

    The range comes from one global min/max aggregate (combined map-side)
    and the days are generated with ``sequence`` + ``explode`` on an
    executor; the row count is the number of days spanned, independent of
    the fact's size.  An empty fact gives an empty calendar.
    """
    bounds = fact.agg(F.min(as_date(date_col)).alias("_lo"), F.max(as_date(date_col)).alias("_hi"))
    return calendar_between(bounds, params)


def fact_date_range(t: SalesTables, join: JoinParams = DEFAULTS.join) -> DataFrame:
    """(_lo, _hi): first and last order date of the sales fact, computed
    without building the fact.

    The fact holds a line when its order and its product exist.  Min and
    max ignore duplicates, so semi-joins suffice: the distinct order ids of
    lines with a known product (deduplicated map-side, about one row per
    order crosses the shuffle instead of one per line), then the orders
    having one of them.
    """
    products = t.products.select("ProductID")
    with_product = (join_dimension(t.order_details.select("OrderID", "ProductID"), products,
                                   on="ProductID", how="left_semi", params=join)
                    .select("OrderID").distinct())
    dated = t.orders.select("OrderID", "OrderDate").join(with_product, "OrderID", "left_semi")
    return dated.agg(F.min("OrderDate").alias("_lo"), F.max("OrderDate").alias("_hi"))


def calendar_for(t: SalesTables, params: CalendarParams = DEFAULTS.calendar) -> DataFrame:
    """The calendar of the sales fact of ``t`` (same rows as
    ``dim_date(fact_sales_load(t))``)."""
    return calendar_between(fact_date_range(t), params)


def calendar_between(bounds: DataFrame, params: CalendarParams = DEFAULTS.calendar) -> DataFrame:
    """Calendar rows for the one-row frame of dates ``_lo`` .. ``_hi``."""
    days = bounds.select(F.explode(F.sequence(as_date("_lo"), as_date("_hi"))).alias("Date"))
    d = F.col("Date")
    return days.select(
        d,
        year_of(d).alias("Year"),
        month_of(d).alias("Month"),
        month_abbrev(d).alias("Month Name"),
        quarter_of(d).alias("Quarter"),
        F.concat(F.lit("Q"), quarter_of(d).cast("string")).alias("Quarter Name"),
        day_of_week(d, params.week_start).alias("Day of Week"),
        day_abbrev(d).alias("Day Name"),
    )
