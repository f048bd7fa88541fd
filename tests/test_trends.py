"""Month-grain trends on invented rows."""

from __future__ import annotations

from ledgerline import operators as ops
from ledgerline.params import WindowParams

from .conftest import d, line, make_tables


def _series_tables(spark, revenues, product=1, start_year=2020):
    """One order per month with the given revenues (None = no sales that month)."""
    lines, orders, oid = [], [], 0
    for i, rev in enumerate(revenues):
        if rev is None:
            continue
        oid += 1
        orders.append((oid, "A", d(f"{start_year + i // 12}-{1 + i % 12:02d}-15")))
        lines.append(line(oid, product, rev, 1))
    return make_tables(spark, lines, orders)


def test_trend_alert_boundaries(spark):
    # growth: -20, -20.004 (rounds to -20.00), -20.006 (-20.01), 0, 20, 20.01
    prev = 100000
    revs = [prev, 80000, prev, 79996, prev, 79994, prev, prev, prev, 120000, prev, 120010]
    t = _series_tables(spark, revs)
    rows = ops.product_trend(t).collect()
    got = [(r.RevenueGrowthPct, r.TrendAlert) for r in rows]
    assert got[0] == (None, None)
    assert got[1] == (-20.0, "DECLINING")
    assert got[3] == (-20.0, "DECLINING")
    assert got[5] == (-20.01, "SHARP DECLINE")
    assert got[7] == (0.0, "STABLE")
    assert got[9] == (20.0, "STABLE")
    assert got[11] == (20.01, "GROWING")


def test_previous_is_previous_row_not_calendar_month(spark):
    t = _series_tables(spark, [10, None, None, 40])
    rows = ops.product_trend(t).collect()
    assert [r.Month for r in rows] == [1, 4]
    assert rows[1].PrevMonthRevenue == 10.0 and rows[1].RevenueGrowthPct == 300.0
    assert rows[1].RunningRevenueByProduct == 50.0


def test_zero_previous_month_gives_null_growth(spark):
    t = _series_tables(spark, [0, 50])
    rows = ops.product_trend(t).collect()
    assert rows[1].PrevMonthRevenue == 0.0
    assert rows[1].RevenueGrowthPct is None and rows[1].TrendAlert is None


def test_top3_dense_rank_ties_give_four_flags(spark):
    products = [(i, f"P{i}", 1) for i in range(1, 6)]
    revs = {1: 90, 2: 80, 3: 70, 4: 70, 5: 10}
    lines = [line(i, i, revs[i], 1) for i in range(1, 6)]
    orders = [(i, "A", d("2021-03-03")) for i in range(1, 6)]
    t = make_tables(spark, lines, orders, products=products)
    flags = {r.ProductName: (r.RevenueRankInCategory, r.Top3Flag) for r in ops.product_trend(t).collect()}
    assert flags == {"P1": (1, "TOP 3"), "P2": (2, "TOP 3"), "P3": (3, "TOP 3"), "P4": (3, "TOP 3"),
                     "P5": (4, None)}
    assert {r.ProductName for r in ops.product_top(t).collect()} == {"P1", "P2", "P3", "P4"}


def test_trend_bucketed_rank_matches_single(spark):
    products = [(i, f"P{i:02d}", 1 + i % 2) for i in range(1, 41)]
    categories = [(1, "Odd"), (2, "Even")]
    lines, orders, oid = [], [], 0
    for m in range(1, 4):
        for p in range(1, 41):
            oid += 1
            orders.append((oid, "A", d(f"2021-0{m}-0{1 + p % 9}")))
            lines.append(line(oid, p, (p * 7 + m) % 9 + 1, 1 + p % 3))
    t = make_tables(spark, lines, orders, products=products, categories=categories)
    single = sorted(tuple(r) for r in ops.product_trend(t, window=WindowParams(buckets=1)).collect())
    wp = WindowParams(direct_bytes=0, buckets=64, oversample=1)
    bucketed = sorted(tuple(r) for r in ops.product_trend(t, window=wp).collect())
    assert single == bucketed


def test_line_without_category_dropped_from_trend(spark):
    products = [(1, "P1", 1), (2, "P2", None)]
    lines = [line(1, 1, 10, 1), line(1, 2, 99, 1)]
    t = make_tables(spark, lines, [(1, "A", d("2021-01-01"))], products=products)
    assert [(r.ProductName, r.MonthlyRevenue) for r in ops.product_trend(t).collect()] == [("P1", 10.0)]
    # ... while monthly growth keeps it (it needs only the order)
    assert ops.monthly_growth(t).first().MonthlyRevenue == 109.0


def test_monthly_growth_moving_average_window(spark):
    t = _series_tables(spark, [10, 20, 30, 40])
    rows = ops.monthly_growth(t).collect()
    assert [r.MovingAvg3Months for r in rows] == [10.0, 15.0, 20.0, 30.0]
    assert [r.CumulativeRevenue for r in rows] == [10.0, 30.0, 60.0, 100.0]
    assert [r.RevenueGrowthPct for r in rows] == [None, 100.0, 50.0, 33.33]


def test_product_base_same_when_products_cannot_be_broadcast(spark):
    from ledgerline.params import JoinParams
    no_bc = JoinParams(broadcast_max_rows=0, broadcast_max_bytes=0)
    products = [(1, "P1", 1), (2, "P2", 1), (3, "P3", 2), (4, "P4", None)]
    categories = [(1, "C1"), (2, "C2")]
    lines = [line(1, 1, 10, 1), line(1, 2, 5, 2), line(1, 1, 3, 1), line(2, 3, 7, 1), line(3, 4, 9, 1),
             line(3, 2, 1, 4)]
    orders = [(1, "A", d("2021-01-05")), (2, "A", d("2021-01-20")), (3, "B", d("2021-02-01"))]
    t = make_tables(spark, lines, orders, products=products, categories=categories)
    small = sorted(map(tuple, ops.product_month_base(t).collect()))
    assert sorted(map(tuple, ops.product_month_base(t, join=no_bc).collect())) == small
    # a shared (category, name) pair falls back to the line-grain join
    dup = make_tables(spark, lines, orders, products=[(1, "P1", 1), (2, "P1", 1), (3, "P3", 2)],
                      categories=categories)
    assert sorted(map(tuple, ops.product_month_base(dup, join=no_bc).collect())) == \
        sorted(map(tuple, ops.product_month_base(dup).collect()))


def test_steps_of_line_grain_are_dealt_by_the_size_of_the_lines(spark, tmp_path, monkeypatch):
    """Many lines: the per-order grouping and the final sort get tasks by the
    lines' size instead of merged partitions; rows and their order stay."""
    from dataclasses import replace

    from ledgerline.operators import trends
    from ledgerline.params import JoinParams
    products = [(p, f"P{p:02d}", 1 + p % 2) for p in range(1, 21)] + [(21, "P01", 2), (22, None, 1)]
    lines = [line(o if o % 9 else None, 1 + (o * p) % 22, o % 7 + 1, p) for o in range(1, 60) for p in range(1, 12)]
    orders = [(o, "A", d(f"2021-{1 + o % 12:02d}-03") if o % 5 else None) for o in range(1, 60)] + [(7, "A", d("2021-08-03")), (8, "A", d("2021-01-09"))]
    t = make_tables(spark, lines, orders, products=products, categories=[(1, "C1"), (2, "C2")])
    t.order_details.write.parquet(str(tmp_path / "lines"))
    t = replace(t, order_details=spark.read.parquet(str(tmp_path / "lines")))
    frames = (lambda: ops.product_month_base(t), lambda: ops.product_month_base(t, join=JoinParams(broadcast_max_rows=0, broadcast_max_bytes=0)),
              lambda: ops.product_top(t))
    plain = [sorted(map(str, f().collect())) for f in frames]
    trend = ops.product_trend(t).collect()
    monkeypatch.setattr(trends, "SPREAD_BYTES", 0)
    monkeypatch.setattr(trends, "GROUPING_BYTES", 256)
    n = trends._tasks(t)
    assert n > 8
    for f, rows in zip(frames, plain, strict=True):
        df = f()
        assert sorted(map(str, df.collect())) == rows
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert f", {n}), REPARTITION_BY_NUM" in plan
    df = ops.product_trend(t)
    got = df.collect()
    assert [(r.CategoryName, r.ProductName, r.Year, r.Month) for r in got] == [(r.CategoryName, r.ProductName, r.Year, r.Month) for r in trend]
    assert sorted(map(str, got)) == sorted(map(str, trend))
    assert df._jdf.queryExecution().executedPlan().toString().count(f", {n}), REPARTITION_BY_NUM") >= 2
