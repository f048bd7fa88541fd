"""Ordered windows that scale past one task per group.

Spark evaluates ``Window.partitionBy(g).orderBy(k)`` with every row of a
group in one task, and a window without ``partitionBy`` with the whole table
in one task.  That is fine for a bounded group (the months of one product)
but not for a group that grows with the data (all customers of a country,
or all customers at once).

``ordered_window`` computes, per segment (the ``partition_by`` group), in
the order ``order_keys`` + ``tiebreak`` (which together must be unique):

* ``row_number``, ``rank`` and ``dense_rank`` (ties on ``order_keys`` only),
* running sums (rows frame, unbounded preceding to current row),
* ``ntile`` tiles, segment totals and the segment row count.

Rows are dealt to buckets by splitters, a pure function of the data: the
``buckets * oversample`` rows with the smallest hash form a sample (a bounded
top-k, no second copy of the data), every ``oversample``-th of the sorted
sample is a splitter, and a row's bucket is the number of splitters below its
(segment, keys, tiebreak).  The splitters reach the rows as a scalar
subquery.  A hot segment or a hot key is therefore split across buckets by
the unique tiebreak.  Each bucket runs the window locally; one small table of
per-bucket counts, totals and boundary keys (at most buckets + segments rows)
yields each bucket's offsets, which are joined back.

Nothing runs before an action: no count, no checkpoint.  A task that is run
again computes the same buckets.  Only where the files of a table that bounds
every segment (``bounded_by``) are below ``WindowParams.direct_bytes`` does
Spark's own window run directly: with few rows the splitters' extra passes
cost more than they save.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DateType, DecimalType, FractionalType, IntegralType, NumericType, TimestampType

from ledgerline.params import WindowParams
from ledgerline.plans.joins import input_bytes

Key = tuple[str, bool]  # (column, ascending)


@dataclass(frozen=True)
class WindowOutputs:
    row_number: str | None = None
    rank: str | None = None
    dense_rank: str | None = None
    running_sums: dict = field(default_factory=dict)    # output -> input column
    segment_sums: dict = field(default_factory=dict)    # output -> input column
    segment_count: str | None = None
    ntile: tuple[str, int] | None = None                 # (output, number of tiles)


def _sort(keys: Sequence[Key]) -> list[Column]:
    # Spark's defaults: ascending puts NULLs first, descending puts them last.
    return [F.col(c).asc() if asc else F.col(c).desc() for c, asc in keys]


def ntile_from_index(rn: Column, n: Column, tiles: int) -> Column:
    """SQL NTILE from a 1-based row number and the segment size.

    With q, r = divmod(n, tiles) the first r tiles hold q + 1 rows and the
    rest q rows.
    """
    i = rn - F.lit(1)
    q = F.floor(n / F.lit(tiles)).cast("long")
    r = n - q * F.lit(tiles)
    big = r * (q + F.lit(1))
    return F.when(i < big, F.floor(i / (q + F.lit(1))) + F.lit(1)).otherwise(
        r + F.floor((i - big) / q) + F.lit(1)).cast("long")


def _ascending(df: DataFrame, name: str, ascending: bool) -> list[Column]:
    """Columns whose ascending order is that of the key."""
    kind, c = df.schema[name].dataType, F.col(name)
    if ascending:
        return [c]
    if isinstance(kind, IntegralType):
        return [c.isNull(), -c.cast("decimal(20,0)")]
    if isinstance(kind, FractionalType) and not isinstance(kind, DecimalType):
        return [c.isNull(), ~F.isnan(c), -c]
    if isinstance(kind, NumericType):
        return [c.isNull(), -c]
    if isinstance(kind, DateType):
        return [c.isNull(), -F.unix_date(c)]
    if isinstance(kind, TimestampType):
        return [c.isNull(), -F.unix_micros(c)]
    if isinstance(kind, BooleanType):
        return [c.isNull(), ~c]
    raise ValueError(f"{name}: a descending {kind.simpleString()} key has no splitters")


def fits_one_task(bounded_by: DataFrame | None, params: WindowParams) -> bool:
    """True when the tables read for the bounding one are small (by file sizes; no job)."""
    size = None if bounded_by is None else input_bytes(bounded_by)
    return size is not None and size <= params.direct_bytes


def _direct(df: DataFrame, part: list[str], keys: list[Key], tie: list[Key],
            out: WindowOutputs, range_segments: bool = False) -> DataFrame:
    if range_segments and part:
        df = df.repartitionByRange(*[F.col(p).asc() for p in part])
    full = Window.partitionBy(*part).orderBy(*_sort(keys + tie)) if part else \
        Window.orderBy(*_sort(keys + tie))
    by_key = Window.partitionBy(*part).orderBy(*_sort(keys)) if part else Window.orderBy(*_sort(keys))
    running = full.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(*part) if part else Window.partitionBy()
    cols: dict[str, Column] = {}
    if out.row_number:
        cols[out.row_number] = F.row_number().over(full).cast("long")
    if out.rank:
        cols[out.rank] = F.rank().over(by_key).cast("long")
    if out.dense_rank:
        cols[out.dense_rank] = F.dense_rank().over(by_key).cast("long")
    for name, src in out.running_sums.items():
        cols[name] = F.sum(src).over(running)
    for name, src in out.segment_sums.items():
        cols[name] = F.sum(src).over(whole)
    if out.segment_count:
        cols[out.segment_count] = F.count(F.lit(1)).over(whole).cast("long")
    if out.ntile:
        name, tiles = out.ntile
        cols[name] = F.ntile(tiles).over(full).cast("long")
    return df.withColumns(cols)


def with_bucket(df: DataFrame, part: Sequence[str], keys: Sequence[Key], params: WindowParams, name: str) -> DataFrame:
    """``df`` with the row's bucket: the number of splitters below it, found by
    binary search."""
    parts = [c for p in part for c in _ascending(df, p, True)] + [c for k, asc in keys for c in _ascending(df, k, asc)]
    place = F.struct(*[c.alias(f"k{i}") for i, c in enumerate(parts)])
    if params.buckets <= 1:
        return df.withColumn(name, F.lit(0))
    sample = df.select(place.alias("p")).orderBy(F.xxhash64("p"), "p").limit(params.buckets * params.oversample)
    ordered = sample.agg(F.sort_array(F.collect_list("p")).alias("s"))
    splitters = ordered.select(F.filter("s", lambda x, i: (i + 1) % params.oversample == 0)).scalar()
    # one subquery, carried as a column from projection to projection only
    out, step = df.withColumns({"__place": place, "__splitters": splitters, name: F.lit(0)}), 1 << (params.buckets.bit_length() - 1)
    while step:
        below = F.get("__splitters", F.col(name) + (step - 1)) < F.col("__place")      # NULL beyond the last splitter
        out = out.withColumn(name, F.col(name) + F.when(below, step).otherwise(0))
        step >>= 1
    return out.drop("__place", "__splitters")


def ordered_window(df: DataFrame, *, partition_by: Sequence[str] = (), order_keys: Sequence[Key],
                   tiebreak: Sequence[Key] = (), outputs: WindowOutputs,
                   params: WindowParams = WindowParams(), bounded_by: DataFrame | None = None,
                   range_segments: bool = False) -> DataFrame:
    """Add the requested ordered-window columns to ``df`` (lazily).

    ``bounded_by`` has at least a row for every row of a segment.
    ``range_segments`` (direct windows) range-partitions by the segment columns
    instead of hashing them: each segment still lands in one task, and a later
    global sort that starts with them needs no further exchange.
    """
    part, keys, tie, out = list(partition_by), list(order_keys), list(tiebreak), outputs
    if fits_one_task(bounded_by, params):
        return _direct(df, part, keys, tie, out, range_segments)
    key_cols = [c for c, _ in keys]
    sums = {f"__rs_{i}": c for i, c in enumerate(out.running_sums.values())}
    seg_sums = {f"__ss_{i}": c for i, c in enumerate(out.segment_sums.values())}

    # 1. Buckets over (segment, keys, tiebreak); local window per bucket.  A
    #    struct of bucket and segment is the key of the window and of the join
    #    below, so that NULL segments match and the rows are shuffled once.
    ranged = with_bucket(df, part, keys + tie, params, "__bucket").withColumn("__g", F.struct(F.col("__bucket").alias("b"), *part))
    lw = Window.partitionBy("__g").orderBy(*_sort(keys + tie))
    lk = Window.partitionBy("__g").orderBy(*_sort(keys))
    lrun = lw.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local_cols = {
        "__lrn": F.row_number().over(lw).cast("long"),
        "__lrank": F.rank().over(lk).cast("long"),
        "__ldense": F.dense_rank().over(lk).cast("long"),
    }
    for tmp, src in sums.items():
        local_cols[tmp] = F.sum(src).over(lrun)
    local = ranged.withColumns(local_cols)

    # 2. One row per (bucket, segment): counts, totals and boundary keys.
    aggs = [F.count(F.lit(1)).alias("__cnt"), F.max("__ldense").alias("__dcnt"),
            F.max_by("__lrank", "__lrn").alias("__last_lrank")]
    for i, c in enumerate(key_cols):
        aggs += [F.min_by(c, "__lrn").alias(f"__first_{i}"), F.max_by(c, "__lrn").alias(f"__last_{i}")]
    for tmp, src in {**sums, **seg_sums}.items():
        aggs.append(F.sum(src).alias(f"__tot{tmp}"))
    stats = local.groupBy("__g").agg(*aggs).select("*", F.col("__g.b").alias("__b"), *[F.col("__g")[p].alias(p) for p in part])

    # 3. Offsets: exclusive prefix over the buckets of each segment.  A tie
    #    group (equal keys) may continue from the previous bucket ("cont"):
    #    its rows keep the rank of the row where the group started ("carry":
    #    the rank of the previous bucket's last row, carried through buckets
    #    that hold nothing but that group) and do not open a new dense rank.
    seg = Window.partitionBy(*part).orderBy("__b") if part else Window.orderBy("__b")
    before = seg.rowsBetween(Window.unboundedPreceding, -1)
    upto = seg.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(*part) if part else Window.partitionBy()
    cont = F.lag("__b").over(seg).isNotNull()   # a previous bucket exists
    for i in range(len(key_cols)):
        cont = cont & F.col(f"__first_{i}").eqNullSafe(F.lag(f"__last_{i}").over(seg))
    all_same = None
    for i in range(len(key_cols)):
        eq = F.col(f"__first_{i}").eqNullSafe(F.col(f"__last_{i}"))
        all_same = eq if all_same is None else all_same & eq
    stats = stats.withColumns({
        "__cont": F.coalesce(cont, F.lit(False)),
        "__off_cnt": F.coalesce(F.sum("__cnt").over(before), F.lit(0)).cast("long"),
    })
    stats = stats.withColumns({
        "__carry_v": F.when(F.col("__cont") & all_same, F.lit(0).cast("long")).otherwise(
            F.col("__off_cnt") + F.col("__last_lrank")),
        "__off_dense": (F.coalesce(F.sum("__dcnt").over(before), F.lit(0))
                        - F.sum(F.col("__cont").cast("long")).over(upto)).cast("long"),
        "__seg_cnt": F.sum("__cnt").over(whole).cast("long"),
        **{f"__off{tmp}": F.sum(f"__tot{tmp}").over(before) for tmp in sums},
        **{f"__segtot{tmp}": F.sum(f"__tot{tmp}").over(whole) for tmp in seg_sums},
    })
    stats = stats.withColumn("__carry", F.coalesce(F.max("__carry_v").over(before), F.lit(0)).cast("long"))
    offsets = stats.select("__g", "__cont", "__off_cnt", "__off_dense", "__carry", "__seg_cnt",
                           *[f"__off{t}" for t in sums], *[f"__segtot{t}" for t in seg_sums])

    # 4. Stitch: at most buckets + segments rows are joined back; adaptive
    #    execution broadcasts them if their measured size allows.
    j = local.join(offsets, "__g")
    rn = F.col("__off_cnt") + F.col("__lrn")
    cols: dict[str, Column] = {}
    if out.row_number:
        cols[out.row_number] = rn
    if out.rank:
        cols[out.rank] = F.when(F.col("__cont") & (F.col("__lrank") == 1), F.col("__carry")).otherwise(
            F.col("__off_cnt") + F.col("__lrank"))
    if out.dense_rank:
        cols[out.dense_rank] = F.col("__off_dense") + F.col("__ldense")
    for (name, _), tmp in zip(out.running_sums.items(), sums):
        off, local = F.col(f"__off{tmp}"), F.col(tmp)      # NULL only before the first non-NULL value
        cols[name] = F.coalesce(off + local, off, local)
    for (name, _), tmp in zip(out.segment_sums.items(), seg_sums):
        cols[name] = F.col(f"__segtot{tmp}")
    if out.segment_count:
        cols[out.segment_count] = F.col("__seg_cnt")
    if out.ntile:
        name, tiles = out.ntile
        cols[name] = ntile_from_index(rn, F.col("__seg_cnt"), tiles)
    result = j.withColumns(cols)
    return result.drop(*[c for c in result.columns if c.startswith("__")])
