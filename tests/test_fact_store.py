"""The stored fact: a refresh gives the result of a full load and touches only its months."""

from __future__ import annotations

import os
import uuid
from collections import Counter

import pytest

from ledgerline import operators as ops
from ledgerline.operators import refresh_fact, store_fact, stored_fact

from .conftest import d, line, make_tables

ORDERS = [(1, "A", d("2024-01-05")), (2, "B", d("2024-01-20")), (3, "A", d("2024-02-03")), (4, "B", d("2024-03-09")), (5, "A", None)]
LINES = [line(1, 1, 10, 1), line(2, 1, 3, 2, "0.25"), line(3, 1, 4, 1), line(3, 1, 4, 1), line(4, 1, 7, 3), line(5, 1, 2, 2)]


def bag(df):
    return Counter(tuple(r) for r in df.collect())


def files(root):
    """Part files by month folder."""
    return {os.path.basename(p): sorted(f for f in fs if f.startswith("part-")) for p, _, fs in os.walk(root) if "OrderMonth=" in p}


@pytest.fixture
def store(spark, tmp_path):
    name = f"facts_{uuid.uuid4().hex}"
    yield name, str(tmp_path)
    spark.sql(f"DROP DATABASE IF EXISTS {name} CASCADE")


def check(spark, store, lines, orders, changed, touched):
    """Load LINES and ORDERS, then refresh to ``lines`` and ``orders``."""
    name, root = store
    store_fact(spark, make_tables(spark, LINES, ORDERS), name, root)
    before = files(root)
    t = make_tables(spark, lines, orders)
    rows = refresh_fact(spark, t, name, spark.createDataFrame([(k,) for k in changed], "OrderID long"))
    assert bag(stored_fact(spark, name)) == bag(ops.fact_sales(t))
    assert set(rows) == {None if m is None else d(m) for m in touched}
    after = files(root)
    folders = {f"OrderMonth={m or '__HIVE_DEFAULT_PARTITION__'}" for m in touched}
    for folder in before.keys() | after.keys():
        assert (before.get(folder) == after.get(folder)) == (folder not in folders), folder
    assert sum(rows.values()) == sum(1 for o in ops.fact_sales(t).collect() if (str(o.OrderDate.replace(day=1)) if o.OrderDate else None) in touched)


def test_full_load(spark, store):
    t = make_tables(spark, LINES, ORDERS)
    got = store_fact(spark, t, *store)
    assert got.columns == ops.fact_sales(t).columns
    assert bag(got) == bag(ops.fact_sales(t))


def test_a_late_line_changes_one_partition(spark, store):
    check(spark, store, [*LINES, line(2, 1, 9, 1)], ORDERS, [2], ["2024-01-01"])


def test_a_new_month(spark, store):
    check(spark, store, [*LINES, line(6, 1, 9, 1)], [*ORDERS, (6, "C", d("2024-05-31"))], [6], ["2024-05-01"])


def test_an_order_moves_to_another_month(spark, store):
    orders = [(3, "A", d("2024-03-30")) if o[0] == 3 else o for o in ORDERS]
    check(spark, store, LINES, orders, [3], ["2024-02-01", "2024-03-01"])          # February is left without rows


def test_deleted_orders_empty_their_months(spark, store):
    check(spark, store, LINES, [o for o in ORDERS if o[0] not in (4, 5)], [4, 5], ["2024-03-01", None])


def test_an_order_gets_its_date(spark, store):
    check(spark, store, LINES, [*ORDERS[:4], (5, "A", d("2024-03-01"))], [5], [None, "2024-03-01"])


def test_nothing_changed(spark, store):
    check(spark, store, LINES, ORDERS, [], [])
    name, _ = store
    assert refresh_fact(spark, make_tables(spark, LINES, ORDERS), name, spark.createDataFrame([(99,), (None,)], "OrderID long")) == {}


def test_the_setting_of_the_session_is_kept(spark, store):
    key = "spark.sql.sources.partitionOverwriteMode"
    was = spark.conf.get(key)
    check(spark, store, [*LINES, line(1, 1, 1, 1)], ORDERS, [1], ["2024-01-01"])
    assert spark.conf.get(key) == was
