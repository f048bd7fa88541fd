"""Parameterised database source.

Two parameters (server, database) define one shared connection; each table
is reached by navigating to a schema and an item.  Nothing is read until a
plan runs: ``DatabaseSource`` only builds readers.  Reads can be split into
parallel range queries on a numeric column (``partition_column``) so a large
fact table is not pulled through one connection.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class DatabaseSource:
    spark: SparkSession
    server: str = "localhost"
    database: str = "sales"
    url_template: str = "jdbc:sqlserver://{server};databaseName={database};encrypt=true"
    properties: dict = field(default_factory=dict)   # user, password, driver, fetchsize ...

    @property
    def url(self) -> str:
        return self.url_template.format(server=self.server, database=self.database)

    @staticmethod
    def qualified(schema: str, item: str) -> str:
        """``schema.[item]``: a name that isn't plain is bracketed, ``]`` doubled."""
        return f"{schema}.{item}" if item.replace("_", "a").isalnum() else f"{schema}.[{item.replace(']', ']]')}]"

    def options_for(self, schema: str, item: str, partition_column: str | None = None,
                    lower_bound: int | None = None, upper_bound: int | None = None,
                    num_partitions: int | None = None) -> dict:
        opts = {"url": self.url, "dbtable": self.qualified(schema, item), **self.properties}
        if partition_column is not None:
            if None in (lower_bound, upper_bound, num_partitions):
                raise ValueError("partitioned reads need lower_bound, upper_bound and num_partitions")
            opts.update(partitionColumn=partition_column, lowerBound=str(lower_bound),
                        upperBound=str(upper_bound), numPartitions=str(num_partitions))
        return opts

    def table(self, schema: str, item: str, **partitioning) -> DataFrame:
        return self.spark.read.format("jdbc").options(**self.options_for(schema, item, **partitioning)).load()

    def reader(self, schema: str = "dbo", partitioning: dict[str, dict] | None = None) -> Callable[[str], DataFrame]:
        """A ``name -> DataFrame`` function for ``sources.model.from_classic``.

        ``partitioning``: by table name, the partitioned-read options of
        ``options_for``, so that a large table comes through several connections.
        """
        return lambda item: self.table(schema, item, **(partitioning or {}).get(item, {}))
