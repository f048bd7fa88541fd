"""Command line: run the analyses over a parquet folder and write CSV reports.

    python -m ledgerline reports --tpch /data/sf1 --out /reports
    python -m ledgerline reports --classic /data/shop --out /reports --only customer_rfm customer_churn
    python -m ledgerline views --tpch /data/sf1 --sql "SELECT Year, SUM(NetRevenue) AS r FROM FactSales f
                                JOIN DimDate d ON f.OrderDate = d.Date GROUP BY Year" --out /reports/by_year

``--classic`` reads ``Order Details``, ``Orders``, ``Products``,
``Categories`` and ``Customers`` as ``<name>.parquet`` files; ``--tpch``
reads the TPC-H style tables.  On a cluster, submit with spark-submit and
set ``spark.checkpoint.dir``; the session comes from the environment.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from ledgerline.operators.reports import REPORTS, export_reports
from ledgerline.operators.star import register_star_views
from ledgerline.session import apply_skew_conf, configure_shuffle, ensure_checkpoint_dir
from ledgerline.sources.csv import export_csv
from ledgerline.sources.model import from_classic
from ledgerline.sources.parquet import ParquetSource
from ledgerline.sources.tpch import tpch_tables


def _tables(spark: SparkSession, args):
    if args.tpch:
        return tpch_tables(spark, args.tpch)
    return from_classic(ParquetSource(spark, args.classic).table)


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="ledgerline")
    sub = parser.add_subparsers(dest="command", required=True)
    helps = {"reports": "write the five analyses as CSV report folders",
             "views": "register the star schema views and write the result of a SQL query as CSV"}
    for name in ("reports", "views"):
        p = sub.add_parser(name, help=helps[name], description=helps[name])
        src = p.add_mutually_exclusive_group(required=True)
        src.add_argument("--tpch", help="folder of TPC-H style parquet tables")
        src.add_argument("--classic", help="folder of the five classic order tables as parquet")
        p.add_argument("--out", required=True, help="output folder")
        p.add_argument("--keep-shuffle-conf", action="store_true",
                       help="do not size shuffle partitions from the line table")
    sub.choices["reports"].add_argument("--only", nargs="*", choices=sorted(REPORTS), help="reports to write")
    sub.choices["views"].add_argument("--sql", required=True, help="query over the star views")
    args = parser.parse_args(argv)

    spark = SparkSession.builder.appName("ledgerline").getOrCreate()
    ensure_checkpoint_dir(spark)
    apply_skew_conf(spark)
    t = _tables(spark, args)
    if not args.keep_shuffle_conf:
        configure_shuffle(spark, t)
    if args.command == "reports":
        for name, path in export_reports(t, args.out, tuple(args.only) if args.only else None).items():
            print(f"{name}: {path}")
    else:
        register_star_views(spark, t)
        export_csv(spark.sql(args.sql), args.out)
        print(args.out)
    return 0


if __name__ == "__main__":
    sys.exit(main())
