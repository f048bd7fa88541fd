"""Tunable parameters.  Defaults are the fixed values of the analyses."""

from __future__ import annotations

from dataclasses import dataclass, field

# ---------------------------------------------------------------------------
# Fixed values that define the analyses' results (kept together, as text):
#   minimum orders for a customer to enter the RFM view ...... 2
#   trend alert: growth below -20 -> SHARP DECLINE, below 0 -> DECLINING,
#                above 20 -> GROWING, otherwise STABLE, NULL growth -> NULL
#   top flag: dense rank 1..3 inside (category, month) -> 'TOP 3'
#   churn: 180 or more inactive days -> LOST, 90 or more -> AT RISK,
#          otherwise ACTIVE
#   average monthly revenue uses months of 30.0 days
#   customer segments by revenue decile (NTILE 10): decile 1 -> 'TOP 10%',
#          deciles 2 to 5 -> 'MIDDLE 40%', deciles 6 to 10 -> 'BOTTOM 50%'
#   HHI bands: below 1500 HEALTHY, 1500 to 2500 MODERATE, above 2500 CRITICAL
#   country clean-up: trim, then 'USA' -> 'United States',
#          'UK' -> 'United Kingdom'
#   calendar: 3-letter English month and day names, quarter name 'Q' + n,
#          day of week 0..6 starting on Sunday
# ---------------------------------------------------------------------------

COUNTRY_ALIASES = {"USA": "United States", "UK": "United Kingdom"}


@dataclass(frozen=True)
class RfmParams:
    min_orders: int = 2
    rank_method: str = "rank"  # or "dense_rank"


@dataclass(frozen=True)
class TrendParams:
    sharp_decline_below: float = -20.0
    growing_above: float = 20.0
    top_n: int = 3
    top_label: str = "TOP 3"
    # Rows that form one product's series for the previous month and the
    # running revenue: ("ProductName",) as the analysis defines it, or
    # ("CategoryName", "ProductName") when a name recurs across categories.
    series_by: tuple[str, ...] = ("ProductName",)


@dataclass(frozen=True)
class ChurnParams:
    lost_days: int = 180
    at_risk_days: int = 90
    days_per_month: int = 30


@dataclass(frozen=True)
class ConcentrationParams:
    tiles: int = 10
    top_tiles: int = 1          # tile 1 -> TOP
    middle_tiles: int = 5       # tiles 2..5 -> MIDDLE, the rest BOTTOM
    top_label: str = "TOP 10%"
    middle_label: str = "MIDDLE 40%"
    bottom_label: str = "BOTTOM 50%"
    healthy_below: float = 1500.0
    critical_above: float = 2500.0
    # Which HHI the band reads: "exact" (from unrounded shares) or
    # "reported" (the sum of the rounded per-customer contributions).
    band_from: str = "exact"
    pareto_thresholds: tuple[float, ...] = (50.0, 80.0, 90.0)


@dataclass(frozen=True)
class CalendarParams:
    # Day of week numbering: "sunday" -> Sunday=0 .. Saturday=6,
    # "monday" -> Monday=0 .. Sunday=6.
    week_start: str = "sunday"


@dataclass(frozen=True)
class WindowParams:
    """Controls for ordered windows over data whose size grows with the input.

    Rows are dealt to ``buckets`` buckets by splitters from a sample of
    ``buckets * oversample`` rows (both fixed, whatever the input), so no task
    holds an unbounded group.  One bucket is Spark's own window, which also
    runs where the table that bounds a group has files of at most
    ``direct_bytes`` in all (0: never).
    """

    direct_bytes: int = 32 << 20
    buckets: int = 512
    oversample: int = 16


@dataclass(frozen=True)
class JoinParams:
    """Explicit broadcast limit for dimension-like sides (rows and bytes)."""

    broadcast_max_rows: int = 2_000_000
    broadcast_max_bytes: int = 64 * 1024 * 1024
    # An optimizer estimate this many times below the byte limit is trusted
    # without a counting job (parquet rarely compresses more than ~10x).
    estimate_safety_factor: int = 32


@dataclass(frozen=True)
class Settings:
    rfm: RfmParams = field(default_factory=RfmParams)
    trend: TrendParams = field(default_factory=TrendParams)
    churn: ChurnParams = field(default_factory=ChurnParams)
    concentration: ConcentrationParams = field(default_factory=ConcentrationParams)
    calendar: CalendarParams = field(default_factory=CalendarParams)
    window: WindowParams = field(default_factory=WindowParams)
    join: JoinParams = field(default_factory=JoinParams)
    country_aliases: dict = field(default_factory=lambda: dict(COUNTRY_ALIASES))


DEFAULTS = Settings()
