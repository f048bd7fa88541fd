"""Column-level building blocks (money, ratios, dates)."""

from ledgerline.functions.dates import (
    as_date,
    day_abbrev,
    day_of_week,
    days_between,
    month_abbrev,
    month_of,
    month_start,
    quarter_of,
    year_of,
)
from ledgerline.functions.money import (
    exact,
    mean_round2,
    net_amount,
    per_period_round2,
    ratio,
    round_out,
)

__all__ = [
    "as_date", "day_abbrev", "day_of_week", "days_between", "month_abbrev",
    "month_of", "month_start", "quarter_of", "year_of", "exact",
    "mean_round2", "net_amount",
    "per_period_round2", "ratio", "round_out",
]
