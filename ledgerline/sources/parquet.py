"""Parquet folder source: one ``<name>.parquet`` per table."""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class ParquetSource:
    spark: SparkSession
    base_dir: str

    def path(self, name: str) -> str:
        return os.path.join(self.base_dir, f"{name}.parquet")

    def table(self, name: str, schema: str | None = None) -> DataFrame:
        """Lazy scan; filters and projections are pushed into the reader.

        With ``schema`` (a DDL string of the columns wanted) no inference
        job runs and only those columns are read.
        """
        reader = self.spark.read if schema is None else self.spark.read.schema(schema)
        return reader.parquet(self.path(name))
