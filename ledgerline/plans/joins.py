"""Joins to dimension-like sides with an explicit, checked broadcast.

``join_dimension`` broadcasts the right side only when it is proven small:
first the optimizer's size estimate must be under the byte limit (no job);
if the estimate is under the limit divided by a safety factor (covering
columnar compression, so that an on-disk estimate still bounds the
in-memory size), that suffices; otherwise a bounded row count
(``limit(max_rows + 1).count()``, which never reads more than
``max_rows + 1`` rows per task) must confirm it.  Beyond the limit
the join is left to the planner: a shuffle join that AQE may still turn into
a broadcast from runtime statistics, and whose hot keys AQE's skew-join
handling splits.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.params import JoinParams


def estimated_bytes(df: DataFrame) -> int | None:
    """The optimizer's size estimate for ``df`` (no job runs)."""
    try:
        stats = df._jdf.queryExecution().optimizedPlan().stats()
        return int(str(stats.sizeInBytes()))
    except Exception:  # pragma: no cover - estimate unavailable
        return None


def input_bytes(df: DataFrame) -> int | None:
    """Total size of the tables that ``df`` reads (no job runs); unlike the
    estimate of a join it doesn't multiply them."""
    try:
        leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
        return sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    except Exception:  # pragma: no cover - sizes unavailable
        return None


def row_width(df: DataFrame) -> int:
    """Default per-row width Spark assumes for the schema."""
    try:
        return int(df._jdf.schema().defaultSize())
    except Exception:  # pragma: no cover
        return 8 * max(1, len(df.columns))


def broadcast_fits(df: DataFrame, params: JoinParams = JoinParams()) -> bool:
    """True when ``df`` is proven to fit the broadcast limits."""
    est = estimated_bytes(df)
    if est is not None and est > params.broadcast_max_bytes:
        return False
    if est is not None and est * params.estimate_safety_factor <= params.broadcast_max_bytes:
        return True   # far below the limit even if the estimate is compressed size
    n = df.limit(params.broadcast_max_rows + 1).count()
    return n <= params.broadcast_max_rows and n * row_width(df) <= params.broadcast_max_bytes


def join_dimension(left: DataFrame, dim: DataFrame, on: str | Sequence[str], how: str = "inner",
                   params: JoinParams = JoinParams(), null_safe: bool = False,
                   known_rows: int | None = None) -> DataFrame:
    """Join ``left`` to ``dim`` on equally named key columns.

    The result keeps ``left``'s key columns and ``dim``'s other columns.
    ``null_safe`` matches NULL keys to each other (grouping semantics).
    ``known_rows`` is the exact row count of ``dim`` when the caller has it
    (e.g. from a counted checkpoint, whose inherited size estimate can be far
    off); the broadcast decision then rests on it alone.
    """
    keys = [on] if isinstance(on, str) else list(on)
    if known_rows is not None:
        fits = (known_rows <= params.broadcast_max_rows
                and known_rows * row_width(dim) <= params.broadcast_max_bytes)
    else:
        fits = broadcast_fits(dim, params)
    right = F.broadcast(dim) if fits else dim
    if not null_safe:
        return left.join(right, keys, how)
    renamed = right.select(*[F.col(c).alias(f"__dimkey_{c}") if c in keys else F.col(c)
                             for c in right.columns])
    cond = None
    for k in keys:
        part = left[k].eqNullSafe(renamed[f"__dimkey_{k}"])
        cond = part if cond is None else cond & part
    return left.join(renamed, cond, how).drop(*[f"__dimkey_{k}" for k in keys])
