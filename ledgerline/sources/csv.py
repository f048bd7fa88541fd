"""CSV export of an analysis (headered UTF-8, NULL spelled ``NULL``).

The write is distributed: each task writes its own part file into the
target folder.  Nothing is funnelled through the driver or a single task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def export_csv(df: DataFrame, path: str, *, null_value: str = "NULL", mode: str = "overwrite",
               date_format: str = "yyyy-MM-dd") -> None:
    (df.write.mode(mode)
       .option("header", True)
       .option("encoding", "UTF-8")
       .option("nullValue", null_value)
       .option("emptyValue", "")
       .option("dateFormat", date_format)
       .option("lineSep", "\n")
       .csv(path))


def read_csv(spark: SparkSession, path: str, schema: StructType | str, *,
             null_value: str = "NULL") -> DataFrame:
    """Read an exported analysis back with an explicit schema (no inference)."""
    return (spark.read.schema(schema)
            .option("header", True)
            .option("encoding", "UTF-8")
            .option("nullValue", null_value)
            .csv(path))
