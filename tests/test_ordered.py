"""The scalable ordered window must equal Spark's window operator exactly."""

from __future__ import annotations

import random
from decimal import Decimal

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerline.params import WindowParams
from ledgerline.plans.ordered import WindowOutputs, ordered_window

ALL = WindowOutputs(row_number="rn", rank="rk", dense_rank="dr", running_sums={"run": "v"},
                    segment_sums={"tot": "v"}, segment_count="cnt", ntile=("tile", 10))


def _frame(spark, n, seed, segments, hot_key_share=0.0):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        seg = rnd.choice(segments)
        key = 7 if rnd.random() < hot_key_share else rnd.randint(0, 12)
        if rnd.random() < 0.05:
            key = None
        rows.append((i, seg, key, Decimal(rnd.randint(0, 999)) / 100))
    return spark.createDataFrame(rows, "id long, seg string, k long, v decimal(10,2)")


def _spark_window(df, part, keys, tie, out):
    """The same columns by Spark's own window, a segment in one task."""
    order = [F.col(c).asc() if asc else F.col(c).desc() for c, asc in keys]
    full = Window.partitionBy(*part).orderBy(*order, *[F.col(c).asc() for c, _ in tie])
    whole, by_key = Window.partitionBy(*part), Window.partitionBy(*part).orderBy(*order)
    cols = {out.row_number: F.row_number().over(full).cast("long"), out.rank: F.rank().over(by_key).cast("long"),
            out.dense_rank: F.dense_rank().over(by_key).cast("long"), out.segment_count: F.count(F.lit(1)).over(whole),
            **{n: F.sum(c).over(full.rowsBetween(Window.unboundedPreceding, 0)) for n, c in out.running_sums.items()},
            **{n: F.sum(c).over(whole) for n, c in out.segment_sums.items()}}
    if out.ntile:
        cols[out.ntile[0]] = F.ntile(out.ntile[1]).over(full).cast("long")
    return df.withColumns({n: c for n, c in cols.items() if n})


def _both(df, part, buckets, outputs=ALL, oversample=1):
    kw = dict(partition_by=part, order_keys=[("k", False)], tiebreak=[("id", True)], outputs=outputs)
    single = _spark_window(df, part, [("k", False)], [("id", True)], outputs)
    split = ordered_window(df, params=WindowParams(buckets=buckets, oversample=oversample), **kw)
    cols = single.columns
    return (sorted((tuple(r) for r in single.select(*cols).collect()), key=str),
            sorted((tuple(r) for r in split.select(*cols).collect()), key=str))


@pytest.mark.parametrize("seed,n,buckets,segments,hot", [
    (1, 200, 17, ["a", "b", "c", None], 0.0),
    (2, 300, 9, ["a"], 0.5),             # one hot key holding half the rows
    (3, 150, 1, ["a", "b"], 0.0),      # a single bucket
    (4, 120, 90, ["x", "y", "z"], 0.34),
])
def test_segmented_window_matches(spark, seed, n, buckets, segments, hot):
    s, b = _both(_frame(spark, n, seed, segments, hot), ["seg"], buckets)
    assert s == b


@pytest.mark.parametrize("seed,n,buckets,hot", [(5, 257, 130, 0.0), (6, 400, 11, 0.4)])
def test_global_window_matches(spark, seed, n, buckets, hot):
    s, b = _both(_frame(spark, n, seed, ["only"], hot).drop("seg"), [], buckets)
    assert s == b


@pytest.mark.parametrize("n", [1, 5, 9, 10, 11, 89, 1500])
def test_ntile_sizes_equal_sql_ntile(spark, n):
    df = spark.range(n).withColumn("k", (F.col("id") * 7919) % 101).withColumn("v", F.lit(Decimal("1.00")))
    out = WindowOutputs(ntile=("tile", 10), row_number="rn")
    kw = dict(order_keys=[("k", False)], tiebreak=[("id", True)], outputs=out)
    single = ordered_window(df, params=WindowParams(buckets=1), **kw)
    bucketed = ordered_window(df, params=WindowParams(buckets=40, oversample=5), **kw)
    a = sorted((r.id, r.tile) for r in single.collect())
    b = sorted((r.id, r.tile) for r in bucketed.collect())
    assert a == b
    sizes = {}
    for _, tile in a:
        sizes[tile] = sizes.get(tile, 0) + 1
    q, r = divmod(n, 10)
    assert [sizes[t] for t in sorted(sizes)] == [q + 1] * r + [q] * (min(n, 10) - r)


def test_lazy_and_no_single_partition_over_rows(spark):
    """No job and no checkpoint before an action; what meets in one task is
    the sample of the splitters and the table of buckets, never the rows."""
    df = spark.range(50_000).withColumn("k", F.col("id") % 7).withColumn("v", F.lit(Decimal("1.00")))
    spark.sparkContext.setJobGroup("lazy window", "ordered window")
    out = ordered_window(df, order_keys=[("k", False)], tiebreak=[("id", True)],
                         outputs=WindowOutputs(row_number="rn", running_sums={"run": "v"}), params=WindowParams(buckets=16, oversample=4))
    assert list(spark.sparkContext.statusTracker().getJobIdsForGroup("lazy window")) == []
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert out.agg(F.max("rn"), F.countDistinct("rn")).first()[:] == (50_000, 50_000)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "CheckpointRDD" not in plan
    sizes = out.groupBy((F.col("rn") / 100_000).cast("int")).count().count()
    assert sizes == 1


def test_buckets_are_even_under_one_hot_key(spark):
    """Half the rows share one key: the tie-break splits them."""
    from ledgerline.plans.ordered import with_bucket
    df = spark.range(40_000).withColumn("k", F.when(F.col("id") % 2 == 0, F.lit(5)).otherwise(F.col("id")))
    keys, params = [("k", False), ("id", True)], WindowParams(buckets=32, oversample=64)
    first = with_bucket(df, [], keys, params, "b").select("id", "b")
    counts = [r["count"] for r in first.groupBy("b").count().collect()]
    assert len(counts) >= 32 and max(counts) < 2 * 40_000 / 32
    again = with_bucket(df.repartition(5), [], keys, params, "b").select("id", "b")
    assert again.exceptAll(first).count() == 0       # a pure function of the rows


@pytest.mark.parametrize("kind", ["int", "double", "date", "timestamp", "boolean", "decimal(9,2)"])
def test_descending_keys_of_every_type(spark, kind):
    df = spark.range(60).withColumn("x", F.when(F.col("id") % 9 > 0, F.col("id") % 11))
    k = {"date": "date_add(date'2020-01-01', int(x))", "timestamp": "timestamp_seconds(x)", "boolean": "x > 5",
         "double": "if(x = 3, double('nan'), double(x))"}.get(kind, f"cast(x as {kind})")
    df = df.select("id", F.expr(k).alias("k"), F.lit(Decimal("1.00")).alias("v"))
    s, b = _both(df, [], 40)
    assert str(s) == str(b)          # NaN equals itself as text


def test_descending_text_key_is_refused(spark):
    with pytest.raises(ValueError, match="descending"):
        ordered_window(spark.createDataFrame([("a", 1)], "k string, id long"), order_keys=[("k", False)], tiebreak=[("id", True)],
                       outputs=WindowOutputs(row_number="rn"))


try:
    from hypothesis import HealthCheck, given, settings
    from hypothesis import strategies as st
except ImportError:  # pragma: no cover
    given = None

if given is not None:
    row = st.tuples(st.sampled_from(["a", "b", None]), st.one_of(st.none(), st.integers(0, 5)),
                    st.integers(0, 99))

    @settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
    @given(rows=st.lists(row, min_size=1, max_size=60), buckets=st.integers(1, 40),
           segmented=st.booleans())
    def test_property_bucketed_equals_single(spark, rows, buckets, segmented):
        data = [(i, s, k, Decimal(v) / 10) for i, (s, k, v) in enumerate(rows)]
        df = spark.createDataFrame(data, "id long, seg string, k long, v decimal(10,1)")
        part = ["seg"] if segmented else []
        s, b = _both(df if segmented else df.drop("seg"), part, buckets)
        assert s == b


def test_running_sum_over_null_summands_equals_the_window(spark):
    df = spark.range(30).select("id", F.when(F.col("id") % 3 != 0, F.col("id").cast("decimal(18,2)")).alias("x"))
    df = df.withColumn("x", F.when(F.col("id") >= 4, F.col("x")))     # the first rows are NULL
    w = Window.orderBy("id").rowsBetween(Window.unboundedPreceding, 0)
    want = [r.s for r in df.withColumn("s", F.sum("x").over(w)).orderBy("id").collect()]
    out = ordered_window(df, partition_by=[], order_keys=[("id", True)], tiebreak=[], outputs=WindowOutputs(running_sums={"s": "x"}),
                         params=WindowParams(buckets=8, oversample=1))
    assert [r.s for r in out.orderBy("id").collect()] == want
