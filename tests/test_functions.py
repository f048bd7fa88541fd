from __future__ import annotations

from decimal import Decimal

from pyspark.sql import functions as F

from ledgerline.functions import dates as D
from ledgerline.functions import money as M


def test_net_amount_is_exact_decimal(spark):
    df = spark.createDataFrame([(1.1, 0.05), (68423.46, 0.07), (0.29, 0.0), (100.0, 0.125), (3.333, 0.0)], "g double, disc double")
    net = M.net_amount(M.exact(df, "g"), M.exact(df, "disc"))
    got = [r.n for r in df.select(net.alias("n")).collect()]
    assert got == [Decimal(x) for x in ("1.0450", "63633.8178", "0.2900", "87.5", "3.333")]
    assert df.select(net).schema.fields[0].dataType.simpleString() == "decimal(38,12)"


def test_exact_keeps_the_scale_of_its_source(spark):
    df = spark.createDataFrame([(Decimal("0.3333"), 3, 0.1, 2.5, None)], "d decimal(19,4), s smallint, f float, x double, n double")
    row = df.select(*[M.exact(df, c).alias(c) for c in df.columns])
    assert [f.dataType.simpleString() for f in row.schema.fields] == ["decimal(19,4)", "decimal(5,0)"] + ["decimal(16,6)"] * 3
    assert tuple(row.first()) == (Decimal("0.3333"), Decimal(3), Decimal("0.1"), Decimal("2.5"), None)


def test_round_out_half_away_from_zero(spark):
    df = spark.createDataFrame([(Decimal("1.255"),), (Decimal("-1.255"),), (Decimal("1.005"),)], "x decimal(10,3)")
    got = [r.r for r in df.select(M.round_out("x", 2).alias("r")).collect()]
    assert got == [1.26, -1.26, 1.01]


def test_mean_round2_exact_half_cents(spark):
    # 0.0250 / 2 = 0.0125 -> 0.01 ; 0.0300 / 2 = 0.015 -> 0.02 ; 10.005 / 2 = 5.0025 -> 5.00
    rows = [(Decimal("0.0250"), 2), (Decimal("0.0300"), 2), (Decimal("10.0050"), 2), (Decimal("1"), 3),
            (Decimal("5"), 0), (Decimal("5"), None)]
    df = spark.createDataFrame(rows, "t decimal(24,4), n long")
    got = [r.m for r in df.select(M.mean_round2("t", "n", 4).alias("m")).collect()]
    assert got == [0.01, 0.02, 5.0, 0.33, None, None]


def test_per_period_round2(spark):
    # 100.00 over 45 days with 30-day months: 100 / 1.5 = 66.666.. -> 66.67
    rows = [(Decimal("100.00"), 45), (Decimal("200.00"), 62), (Decimal("1.00"), 0)]
    df = spark.createDataFrame(rows, "t decimal(18,2), d long")
    got = [r.m for r in df.select(M.per_period_round2("t", "d", 30).alias("m")).collect()]
    assert got == [66.67, 96.77, None]


def test_ratio_null_on_zero_and_rounds(spark):
    df = spark.createDataFrame([(1.0, 3.0), (5.0, 0.0), (None, 2.0)], "a double, b double")
    got = [r.r for r in df.select(M.ratio("a", "b", 4, factor=100.0).alias("r")).collect()]
    assert got == [33.3333, None, None]


def test_days_between_counts_date_boundaries(spark):
    df = spark.createDataFrame([("2020-01-01 23:00:00", "2020-01-02 01:00:00")], "a string, b string")
    df = df.select(F.to_timestamp("a").alias("a"), F.to_timestamp("b").alias("b"))
    assert df.select(D.days_between("a", "b").alias("n")).first().n == 1


def test_calendar_attributes(spark):
    df = spark.createDataFrame([("2020-05-03",)], "s string").select(F.to_date("s").alias("d"))
    r = df.select(D.month_abbrev("d").alias("m"), D.day_abbrev("d").alias("a"),
                  D.day_of_week("d").alias("w"), D.day_of_week("d", "monday").alias("wm"),
                  D.quarter_of("d").alias("q")).first()
    assert (r.m, r.a, r.w, r.wm, r.q) == ("May", "Sun", 0, 6, 2)


def test_averages_of_negative_totals_round_away_from_zero(spark):
    rows = [(Decimal("-1.0000"), 2), (Decimal("-10.0000"), 3), (Decimal("-0.0010"), 1), (Decimal("1.0000"), 2)]
    df = spark.createDataFrame(rows, "t decimal(24,4), n long")
    assert [r.m for r in df.select(M.mean_round2("t", "n", 4).alias("m")).collect()] == [-0.5, -3.33, 0.0, 0.5]
    df = spark.createDataFrame([(Decimal("-100.00"), 60)], "t decimal(24,2), d long")
    assert df.select(M.per_period_round2("t", "d", 30).alias("m")).first().m == -50.0
