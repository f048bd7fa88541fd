"""Co-located storage of the sales model (Spark bucketed tables).

Every analysis starts by joining order lines to orders on OrderID, and at
scale that shuffle of the line table is the dominant cost.  Writing both
tables bucketed (hash-partitioned into files) by OrderID with the same
bucket count, once, lets every later run aggregate lines per order and join
them to orders with no exchange at all: the scans already report the
partitioning the operators need.

``store_bucketed`` pays one shuffle per table at write time; ``bucketed_tables``
reads the stored model back through the session catalog (bucketing metadata
lives there).  Tables are external, at ``location``/<name>, so the data sits
on shared storage and not in a session-local warehouse.
"""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

from ledgerline.sources.model import SalesTables

TABLES = ("order_details", "orders", "products", "categories", "customers")
BUCKET_KEYS = {"order_details": "OrderID", "orders": "OrderID"}


def _name(database: str, table: str) -> str:
    return f"{database}.{table}"


def store_bucketed(spark: SparkSession, t: SalesTables, database: str, location: str,
                   buckets: int, mode: str = "overwrite") -> SalesTables:
    """Write ``t`` with lines and orders bucketed (and sorted) by OrderID.

    ``buckets`` should give files of a few hundred MB for the line table;
    both tables must use the same count for the join to stay shuffle-free.
    The small relations are written unbucketed.
    """
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database} LOCATION '{os.path.join(location, '_database')}'")
    for table in TABLES:
        writer = getattr(t, table).write.mode(mode).format("parquet").option("path", os.path.join(location, table))
        key = BUCKET_KEYS.get(table)
        if key is not None:
            writer = writer.bucketBy(buckets, key).sortBy(key)
        writer.saveAsTable(_name(database, table))
    return bucketed_tables(spark, database)


def bucketed_tables(spark: SparkSession, database: str) -> SalesTables:
    return SalesTables(*[spark.table(_name(database, table)) for table in TABLES]).validate()
