"""Adapter from TPC-H style parquet tables to the canonical sales model.

Role mapping (a choice; documented in the README):

* order line  <- ``lineitem``: OrderID=l_orderkey, ProductID=l_partkey,
  Quantity=l_quantity, GrossAmount=l_extendedprice (it is already unit price
  x quantity), Discount=l_discount, both exact decimals,
  UnitPrice = l_extendedprice / l_quantity (display only).
* order       <- ``orders``: o_orderkey, o_custkey, o_orderdate (as date).
* product     <- ``part``: ProductName = p_name || ' #' || p_partkey because
  part names are not unique; CategoryID = p_type.
* category    <- distinct ``p_type`` (id and name are the type).
* customer    <- ``customer`` joined to ``nation``: CompanyName=c_name,
  Country=n_name, City=c_mktsegment (the tables carry no city).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.functions.dates import as_date
from ledgerline.functions.money import exact
from ledgerline.plans.joins import join_dimension
from ledgerline.sources.model import SalesTables
from ledgerline.sources.parquet import ParquetSource


# Columns the adapter maps, with their parquet types.  Reading with an
# explicit schema skips footer-based schema inference (a distributed job over
# every file footer at scale) and limits each scan to these columns.
TPCH_SCHEMAS = {
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_quantity double, l_extendedprice double, "
                "l_discount double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderdate timestamp_ntz",
    "part": "p_partkey bigint, p_name string, p_type string",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_mktsegment string",
    "nation": "n_nationkey int, n_name string",
}


def tpch_tables(spark: SparkSession, base_dir: str, infer_schema: bool = False) -> SalesTables:
    """The canonical model over TPC-H style parquet tables in ``base_dir``.

    By default each table is read with ``TPCH_SCHEMAS`` (no inference job).
    ``infer_schema=True`` takes the column types from the files instead
    (e.g. DECIMAL prices from another generator); the same columns are used.
    """
    src = ParquetSource(spark, base_dir)
    if infer_schema:
        frames = {name: src.table(name).select(*[c.split()[0] for c in schema.split(", ")])
                  for name, schema in TPCH_SCHEMAS.items()}
    else:
        frames = {name: src.table(name, schema) for name, schema in TPCH_SCHEMAS.items()}
    return tpch_from_frames(**frames)


def tpch_from_frames(lineitem: DataFrame, orders: DataFrame, part: DataFrame,
                     customer: DataFrame, nation: DataFrame) -> SalesTables:
    order_details = lineitem.select(
        F.col("l_orderkey").alias("OrderID"),
        F.col("l_partkey").alias("ProductID"),
        F.col("l_quantity").alias("Quantity"),
        F.try_divide(F.col("l_extendedprice").cast("double"), F.col("l_quantity").cast("double")).alias("UnitPrice"),
        exact(lineitem, "l_extendedprice").alias("GrossAmount"),
        exact(lineitem, "l_discount").alias("Discount"),
    )
    orders_c = orders.select(
        F.col("o_orderkey").alias("OrderID"),
        F.col("o_custkey").alias("CustomerID"),
        as_date("o_orderdate").alias("OrderDate"),
    )
    products = part.select(
        F.col("p_partkey").alias("ProductID"),
        F.concat(F.col("p_name"), F.lit(" #"), F.col("p_partkey").cast("string")).alias("ProductName"),
        F.col("p_type").alias("CategoryID"),
    )
    categories = (part.select(F.col("p_type").alias("CategoryID"))
                  .where(F.col("CategoryID").isNotNull())
                  .distinct()
                  .select("CategoryID", F.col("CategoryID").alias("CategoryName")))
    nations = nation.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("Country"))
    customers = join_dimension(
        customer.select("c_custkey", "c_name", "c_nationkey", "c_mktsegment"),
        nations, on="c_nationkey", how="left",
    ).select(
        F.col("c_custkey").alias("CustomerID"),
        F.col("c_name").alias("CompanyName"),
        F.col("Country"),
        F.col("c_mktsegment").alias("City"),
    )
    return SalesTables(order_details, orders_c, products, categories, customers).validate()
