"""Plan shape: pruned scans, checked broadcasts, no redundant shuffles."""

from __future__ import annotations

import os
import re

import pytest

from ledgerline import operators as ops
from ledgerline.params import WindowParams
from ledgerline.plans.joins import broadcast_fits
from ledgerline.sources.tpch import tpch_tables

from .conftest import TESTDATA

SF = f"{TESTDATA}/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.exists(SF), reason="driver data absent")


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _exchanges(plan: str) -> list[str]:
    return re.findall(r"Exchange (hashpartitioning\([^)]*\)|rangepartitioning\([^)]*\)|SinglePartition)", plan)


@pytest.fixture(scope="module")
def t(spark):
    return tpch_tables(spark, SF)


def test_lineitem_scan_is_pruned_and_filtered(t):
    plan = _plan(ops.monthly_growth(t))
    scans = [line for line in plan.splitlines() if "lineitem" in line and "FileScan" in line]
    assert scans
    for s in scans:
        read = re.search(r"ReadSchema: struct<([^>]*)>", s).group(1)
        assert set(c.split(":")[0] for c in read.split(",")) == {"l_orderkey", "l_extendedprice", "l_discount"}
        assert "IsNotNull(l_orderkey)" in s


def test_dimension_broadcast_is_checked(spark, t):
    assert broadcast_fits(t.categories)
    assert "BroadcastHashJoin" in _plan(ops.product_month_base(t))


def test_per_order_grouping_reuses_join_partitioning(spark, t):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = _plan(ops.product_month_base(t))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    hashed = [e for e in _exchanges(plan) if e.startswith("hashpartitioning")]
    # lines by OrderID, orders by OrderID, the month-grain result (plus the
    # tiny distinct that builds the category dimension); the per-order
    # grouping between join and month grain adds no exchange of its own.
    assert not [e for e in hashed if "OrderID" in e and "OrderMonth" in e], hashed
    assert sum("OrderID" in e for e in hashed) == 2, hashed


def test_customer_stats_shuffles(spark, t):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = _plan(ops.customer_order_stats(t))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    hashed = [e for e in _exchanges(plan) if e.startswith("hashpartitioning")]
    # lines by OrderID (after partial aggregation), orders by OrderID, then
    # customer-grain partial aggregates by CustomerID
    assert len(hashed) == 3, hashed


def test_month_window_is_the_only_single_partition_step(t):
    plan = _plan(ops.monthly_growth(t, ordered=False))
    singles = [e for e in _exchanges(plan) if e == "SinglePartition"]
    assert len(singles) <= 1    # the month-grain window (one row per month)


def test_bucketed_storage_removes_the_order_shuffles(spark, t):
    import tempfile

    from ledgerline.sources import store_bucketed
    loc = tempfile.mkdtemp(prefix="ledgerline-bucketed-")
    bt = store_bucketed(spark, t, "ledgerline_test_bucketed", loc, buckets=8)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for fn in (ops.customer_churn, ops.product_month_base, ops.monthly_growth):
            plain, stored = fn(t), fn(bt)
            assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, stored.collect()))
            order_shuffles = [e for e in _exchanges(_plan(stored)) if "OrderID" in e]
            assert order_shuffles == [], fn.__name__
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_shared_order_revenue_is_reused_not_recomputed(spark, t):
    shared = ops.share_order_revenue(t)
    for fn in (ops.customer_rfm, ops.customer_churn, ops.customer_concentration, ops.monthly_growth):
        assert [tuple(r) for r in fn(shared).collect()] == [tuple(r) for r in fn(t).collect()], fn.__name__
        plan = _plan(fn(shared))
        assert "lineitem" not in plan and "orders.parquet" not in plan, fn.__name__


def test_no_python_evaluation_in_any_query(spark):
    import __spark_entry__ as E
    for name, fn in E.queries().items():
        if name in E.LLM_QUERIES:
            continue
        df = fn(spark, f"{TESTDATA}/sf0.001")
        df.collect()                                   # final adaptive plan
        plan = _plan(df)
        assert "EvalPython" not in plan and "PythonUDF" not in plan and "MapInPandas" not in plan, name
        assert "*(" in plan or "EmptyRelation" in plan, name   # generated code, unless AQE emptied it


def test_rfm_window_and_final_sort_share_one_exchange(spark, t):
    df = ops.customer_rfm(t)
    df.collect()
    plan = _plan(df).split("== Initial Plan ==")[0]
    country = [e for e in _exchanges(plan) if "Country" in e]
    assert len(country) == 1 and country[0].startswith("rangepartitioning(Country"), country


def test_direct_windows_are_chosen_by_file_sizes(t):
    from ledgerline.plans.ordered import fits_one_task
    assert fits_one_task(t.customers, WindowParams()) and fits_one_task(t.products, WindowParams())
    assert not fits_one_task(t.customers, WindowParams(direct_bytes=0)) and not fits_one_task(None, WindowParams())


def test_ordered_analyses_run_nothing_before_an_action(spark, t):
    """RFM, concentration, Pareto and the trend are plans only: no job and no
    checkpoint; with splitters no window gathers the customers in one task."""
    wp = WindowParams(direct_bytes=0)
    for group, kw in (("lazy split", {"window": wp}), ("lazy direct", {})):
        spark.sparkContext.setJobGroup(group, "ordered analyses")
        frames = [fn(t, **kw) for fn in (ops.customer_rfm, ops.customer_concentration, ops.pareto_cutoff)]
        assert list(spark.sparkContext.statusTracker().getJobIdsForGroup(group)) == [], group
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        for df in frames:
            df.collect()
            plan = _plan(df).split("== Initial Plan ==")[0]
            assert "CheckpointRDD" not in plan
            for line in plan.splitlines():
                if kw and "Window [" in line:      # by bucket, or over the table of buckets
                    assert "windowspecdefinition(__g" in line or "__b" in line, line


def test_top_products_are_limited_before_the_shuffle(t):
    plan = _plan(ops.product_top(t))
    assert "WindowGroupLimit" in plan and "Partial" in plan.split("WindowGroupLimit")[-1] + plan
    trend = {tuple(r) for r in ops.product_trend(t).where("RevenueRankInCategory <= 3").collect()}
    assert {tuple(r) for r in ops.product_top(t).collect()} == trend
