"""Sources and the CSV sink."""

from __future__ import annotations

import datetime as dt
import os
import tempfile
from decimal import Decimal

import pytest

from ledgerline import operators as ops
from ledgerline.sources import DatabaseSource, ParquetSource, export_csv, from_classic, read_csv
from ledgerline.sources.tpch import TPCH_SCHEMAS, tpch_tables

from .conftest import TESTDATA


def test_database_source_builds_options_without_connecting(spark):
    src = DatabaseSource(spark, server="db.example", database="Sales", properties={"user": "u"})
    opts = src.options_for("dbo", "Order Details")
    assert opts["url"].startswith("jdbc:sqlserver://db.example;databaseName=Sales")
    assert opts["dbtable"] == "dbo.[Order Details]" and opts["user"] == "u"
    part = src.options_for("dbo", "Orders", partition_column="OrderID", lower_bound=1, upper_bound=1000,
                           num_partitions=16)
    assert part["dbtable"] == "dbo.Orders" and part["numPartitions"] == "16"
    with pytest.raises(ValueError):
        src.options_for("dbo", "Orders", partition_column="OrderID")


def test_classic_schema_adapter(spark):
    frames = {
        "Order Details": spark.createDataFrame(
            [(1, 1, Decimal("18.00"), 2, 0.1)], "OrderID long, ProductID long, UnitPrice decimal(10,2), "
                                                "Quantity int, Discount float"),
        "Orders": spark.createDataFrame([(1, "CU001", dt.datetime(2021, 8, 25, 0, 0))],
                                        "OrderID long, CustomerID string, OrderDate timestamp"),
        "Products": spark.createDataFrame([(1, "Green tea", 1)], "ProductID long, ProductName string, CategoryID long"),
        "Categories": spark.createDataFrame([(1, "Drinks")], "CategoryID long, CategoryName string"),
        "Customers": spark.createDataFrame([("CU001", "Corner Shop", "Landia", "Town")],
                                           "CustomerID string, CompanyName string, Country string, City string"),
    }
    t = from_classic(frames.__getitem__)
    r = ops.fact_sales(t).first()
    assert r.NetRevenue == Decimal("32.4000") and r.OrderDate == dt.date(2021, 8, 25)


def test_line_amounts_are_not_rounded_on_input(spark):
    od = spark.createDataFrame(
        [(1, 1, 10.0, 10.0, 0.125), (2, 1, 0.3333, 10.0, 0.0), (3, 1, 4.0, 2.5, 0.1), (4, 1, None, 1.0, 0.0)],
        "OrderID long, ProductID long, UnitPrice double, Quantity double, Discount double")
    frames = {
        "Order Details": od,
        "Orders": spark.createDataFrame([(k, "A", dt.date(2021, 8, 25)) for k in (1, 2, 3, 4)], "OrderID long, CustomerID string, OrderDate date"),
        "Products": spark.createDataFrame([(1, "Green tea", 1)], "ProductID long, ProductName string, CategoryID long"),
        "Categories": spark.createDataFrame([(1, "Drinks")], "CategoryID long, CategoryName string"),
        "Customers": spark.createDataFrame([("A", "Corner Shop", "Landia", "Town")],
                                           "CustomerID string, CompanyName string, Country string, City string"),
    }
    rows = ops.fact_sales(from_classic(frames.__getitem__)).orderBy("OrderID").collect()
    assert [r.NetRevenue for r in rows] == [Decimal("87.50"), Decimal("3.333"), Decimal("9"), None]
    assert [(r.Quantity, float(r.Discount)) for r in rows] == [(10.0, 0.125), (10.0, 0.0), (2.5, 0.1), (1.0, 0.0)]
    assert ops.star_rollup(from_classic(frames.__getitem__)).first().Quantity == 23.5


def test_csv_export_round_trip_with_nulls(spark):
    df = spark.createDataFrame([("Ñandú S.A.", None, 1.5), ("b", "x", None)], "name string, tag string, v double")
    out = os.path.join(tempfile.mkdtemp(prefix="ledgerline-csv-"), "report")
    export_csv(df, out)
    text = "".join(open(os.path.join(out, f), encoding="utf-8").read()
                   for f in sorted(os.listdir(out)) if f.endswith(".csv"))
    assert "NULL" in text and "Ñandú S.A." in text
    back = read_csv(spark, out, "name string, tag string, v double")
    assert sorted(tuple(r) for r in back.collect()) == sorted(tuple(r) for r in df.collect())


@pytest.mark.skipif(not os.path.exists(f"{TESTDATA}/sf0.001"), reason="driver data absent")
def test_tpch_adapter_reads_only_mapped_columns(spark):
    src = ParquetSource(spark, f"{TESTDATA}/sf0.001")
    for name, schema in TPCH_SCHEMAS.items():
        actual = {f.name: f.dataType.simpleString() for f in src.table(name).schema.fields}
        wanted = {f.name: f.dataType.simpleString() for f in src.table(name, schema).schema.fields}
        assert all(actual[k] == v for k, v in wanted.items()), name
    t = tpch_tables(spark, f"{TESTDATA}/sf0.001")
    plan = t.order_details._jdf.queryExecution().executedPlan().toString()
    assert "l_shipdate" not in plan and "l_comment" not in plan


@pytest.mark.skipif(not os.path.exists(f"{TESTDATA}/sf0.001"), reason="driver data absent")
def test_export_reports_writes_every_analysis(spark):
    t = tpch_tables(spark, f"{TESTDATA}/sf0.001")
    out = tempfile.mkdtemp(prefix="ledgerline-reports-")
    written = ops.export_reports(t, out)
    assert set(written) == set(ops.REPORTS)
    growth = read_csv(spark, written["monthly_growth"],
                      "Year long, Month long, MonthlyRevenue double, PrevMonthRevenue double, "
                      "RevenueGrowthPct double, CumulativeRevenue double, MovingAvg3Months double")
    assert growth.count() == 80
    assert growth.where("PrevMonthRevenue IS NULL").count() == 1


def test_export_of_one_report_shares_no_order_facts(spark, monkeypatch):
    from ledgerline.operators import reports

    shared = []
    monkeypatch.setattr(reports, "share_order_revenue", lambda t: shared.append(1) or t)
    t = tpch_tables(spark, f"{TESTDATA}/sf0.001")
    out = tempfile.mkdtemp(prefix="ledgerline-reports-")
    reports.export_reports(t, out, ("product_trend", "monthly_growth"))
    assert not shared
    reports.export_reports(t, out + "-two", ("monthly_growth", "customer_churn"))
    assert shared


@pytest.fixture
def restore_shuffle_conf(spark):
    keys = ["spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.initialPartitionNum",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes"]
    old = {k: spark.conf.get(k, None) for k in keys}
    yield
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.mark.skipif(not os.path.exists(f"{TESTDATA}/sf0.001"), reason="driver data absent")
def test_command_line_reports_and_views(spark, restore_shuffle_conf):
    from ledgerline.__main__ import main
    out = tempfile.mkdtemp(prefix="ledgerline-cli-")
    assert main(["reports", "--tpch", f"{TESTDATA}/sf0.001", "--out", out, "--only", "customer_churn"]) == 0
    churn = read_csv(spark, os.path.join(out, "customer_churn"), "CustomerID long, CompanyName string")
    assert churn.count() == 150
    sql = "SELECT d.Year, COUNT(*) AS lines FROM FactSales f JOIN DimDate d ON f.OrderDate = d.Date GROUP BY d.Year"
    assert main(["views", "--tpch", f"{TESTDATA}/sf0.001", "--sql", sql, "--out", os.path.join(out, "by_year")]) == 0
    by_year = read_csv(spark, os.path.join(out, "by_year"), "Year long, lines long")
    assert sum(r.lines for r in by_year.collect()) == 6000


def test_classic_parquet_folder_through_the_command_line(spark, restore_shuffle_conf):
    from ledgerline.__main__ import main
    src = tempfile.mkdtemp(prefix="ledgerline-classic-")
    tables = {
        "Order Details": ([(1, 1, Decimal("18.00"), 2, 0.0), (2, 1, Decimal("18.00"), 1, 0.15),
                           (3, 2, Decimal("9.50"), 4, 0.05)],
                          "OrderID int, ProductID int, UnitPrice decimal(19,4), Quantity smallint, Discount float"),
        "Orders": ([(1, "AAA01", dt.datetime(2021, 1, 10)), (2, "AAA01", dt.datetime(2021, 3, 5)),
                    (3, "BBB02", dt.datetime(2021, 3, 6))],
                   "OrderID int, CustomerID string, OrderDate timestamp"),
        "Products": ([(1, "Green tea", 1), (2, "Rye bread", 2)], "ProductID int, ProductName string, CategoryID int"),
        "Categories": ([(1, "Drinks"), (2, "Bakery")], "CategoryID int, CategoryName string"),
        "Customers": ([("AAA01", "Corner Shop", "UK", "Town"), ("BBB02", "Big Store", " USA", "City")],
                      "CustomerID string, CompanyName string, Country string, City string"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(os.path.join(src, f"{name}.parquet"))
    out = tempfile.mkdtemp(prefix="ledgerline-classic-out-")
    assert main(["reports", "--classic", src, "--out", out, "--only", "customer_rfm", "monthly_growth"]) == 0
    rfm = read_csv(spark, os.path.join(out, "customer_rfm"),
                   "CustomerID string, CompanyName string, Country string, TotalOrders long, TotalRevenue double")
    assert [(r.CustomerID, r.Country, r.TotalOrders, r.TotalRevenue) for r in rfm.collect()] == \
        [("AAA01", "UK", 2, 51.3)]                       # 36.00 + 18.00 x 0.85; raw country kept
    growth = read_csv(spark, os.path.join(out, "monthly_growth"), "Year long, Month long, MonthlyRevenue double")
    assert sorted((r.Month, r.MonthlyRevenue) for r in growth.collect()) == [(1, 36.0), (3, 51.4)]


def test_shuffle_sizing_from_the_line_table(spark):
    from ledgerline.session import configure_shuffle, shuffle_partitions_for
    assert shuffle_partitions_for(100 * 2**40) == 200_000          # capped
    assert shuffle_partitions_for(10 * 2**30) == 80 and shuffle_partitions_for(0, minimum=8) == 8
    keys = ["spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.initialPartitionNum",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes"]
    old = {k: spark.conf.get(k, None) for k in keys}
    try:
        t = tpch_tables(spark, f"{TESTDATA}/sf0.01")
        n = configure_shuffle(spark, t, target_bytes=64 * 1024)
        assert n >= spark.sparkContext.defaultParallelism
        assert spark.conf.get("spark.sql.shuffle.partitions") == str(n)
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.mark.skipif(not os.path.exists(f"{TESTDATA}/sf0.001"), reason="driver data absent")
def test_inferred_and_declared_schemas_give_the_same_results(spark):
    declared = tpch_tables(spark, f"{TESTDATA}/sf0.001")
    inferred = tpch_tables(spark, f"{TESTDATA}/sf0.001", infer_schema=True)
    for fn in (ops.customer_churn, ops.monthly_growth):
        assert [tuple(r) for r in fn(declared).collect()] == [tuple(r) for r in fn(inferred).collect()]


def test_decimal_prices_from_another_generator(spark):
    from ledgerline.sources.tpch import tpch_from_frames
    li = spark.createDataFrame([(1, 1, Decimal("2"), Decimal("10.05"), Decimal("0.10"))],
                               "l_orderkey long, l_partkey long, l_quantity decimal(15,2), "
                               "l_extendedprice decimal(15,2), l_discount decimal(15,2)")
    orders = spark.createDataFrame([(1, 7, dt.datetime(2021, 1, 1))], "o_orderkey long, o_custkey long, o_orderdate timestamp")
    part = spark.createDataFrame([(1, "bolt", "SMALL")], "p_partkey long, p_name string, p_type string")
    customer = spark.createDataFrame([(7, "C7", 1, "AUTO")], "c_custkey long, c_name string, c_nationkey int, c_mktsegment string")
    nation = spark.createDataFrame([(1, "N1")], "n_nationkey int, n_name string")
    t = tpch_from_frames(li, orders, part, customer, nation)
    r = ops.net_revenue_lines(t).first()
    assert (r.Quantity, r.GrossAmount, r.NetRevenue) == (2, Decimal("10.05"), Decimal("9.0450"))


def test_database_reader_navigates_schema_and_item(spark):
    src = DatabaseSource(spark, server="srv", database="shop")
    assert src.qualified("sales", "Orders") == "sales.Orders"
    assert src.qualified("dbo", "Order Details") == "dbo.[Order Details]"
    assert callable(src.reader("sales"))
    assert src.url == "jdbc:sqlserver://srv;databaseName=shop;encrypt=true"
    assert src.qualified("dbo", "a]b") == "dbo.[a]]b]"
