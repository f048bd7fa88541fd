"""Exact money arithmetic as Spark Column expressions.

Money is carried as DECIMAL so that sums are exact and independent of how
rows are partitioned (a DOUBLE sum depends on the order of additions and can
flip a rounded digit between runs).  Results leave the library as DOUBLE
values that are the nearest double to an exactly rounded decimal.

Rounding is half away from zero, the rule of SQL ``ROUND`` on decimals.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, IntegralType

# Intermediate type used to round a DOUBLE ratio: going through a fixed
# 10-digit decimal makes the final half-up rounding independent of how an
# engine rounds binary doubles.
RATIO_DEC = "decimal(38,10)"

BINARY = "decimal(16,6)"      # a price, quantity or discount held as FLOAT or DOUBLE
INTEGERS = {"byte": "decimal(3,0)", "short": "decimal(5,0)", "integer": "decimal(10,0)"}
NET_SCALE = 12
NET = f"decimal(38,{NET_SCALE})"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def exact(df: DataFrame, name: str) -> Column:
    """Column ``name`` of ``df`` as DECIMAL at the scale of its source.

    A DECIMAL column stays as it is, an integer gets scale 0, and a binary
    FLOAT or DOUBLE is read as the decimal it was recorded as, to 6 places.
    """
    kind = df.schema[name].dataType
    c = F.col(name)
    if isinstance(kind, DecimalType):
        return c
    if isinstance(kind, IntegralType):
        return c.cast(INTEGERS.get(kind.typeName(), "decimal(20,0)"))
    return c.cast(BINARY)


def narrowed(df: DataFrame, gross: str, discount: str) -> tuple[Column, Column]:
    """The two factors of a line's net amount in types whose product has at
    most 38 digits, so that Spark keeps every decimal of it.

    A discount is a fraction: one digit before the point suffices (anything
    larger raises).  Gross and discount keep their scales; gross keeps as many
    digits before the point as 38 allow, 10 at least, or the types are refused.
    """
    g, d = df.schema[gross].dataType, df.schema[discount].dataType
    if not isinstance(g, DecimalType) or not isinstance(d, DecimalType):
        return F.col(gross), F.col(discount)
    # (precision + precision + 1) of the product stays within 38: 1 - discount has two digits before the point
    whole = min(g.precision - g.scale, 38 - 1 - (d.scale + 2) - g.scale)
    if whole < min(10, g.precision - g.scale):
        raise ValueError(f"{gross} {g.simpleString()} times {discount} {d.simpleString()} doesn't fit 38 digits")
    return (F.col(gross).cast(f"decimal({whole + g.scale},{g.scale})"),
            F.col(discount).cast(f"decimal({d.scale + 1},{d.scale})"))


def net_amount(gross: Column | str, discount: Column | str) -> Column:
    """Net line revenue: gross x (1 - discount) as DECIMAL(38,12).

    Both are decimals at their source's scale (see ``exact``) and are
    multiplied exactly.  Spark cuts a product of more than 38 digits to six
    decimals; ``SalesTables.validate`` brings the columns to types whose
    product fits (see ``narrowed``) and refuses those that would lose digits.
    Only decimals beyond the twelfth of a line's net amount are rounded.
    """
    return (_col(gross) * (F.lit(Decimal(1)) - _col(discount))).cast(NET)


def round_out(c: Column | str, scale: int = 2) -> Column:
    """Round a decimal half away from zero and emit it as DOUBLE."""
    return F.round(_col(c), scale).cast("double")


def ratio(num: Column | str, den: Column | str, scale: int,
          factor: float | None = None, factor_first: bool = False) -> Column:
    """Round ``num / den`` (times ``factor``) to ``scale`` digits; NULL if den = 0.

    The division happens in DOUBLE, like SQL's ``x / NULLIF(y, 0) * 100``;
    ``factor_first`` gives ``x * 100 / NULLIF(y, 0)`` instead.  The quotient
    is then fixed to 10 decimals and rounded half up in DECIMAL.
    """
    n = _col(num).cast("double")
    d = F.nullif(_col(den).cast("double"), F.lit(0.0))
    if factor is None:
        q = n / d
    elif factor_first:
        q = (n * F.lit(float(factor))) / d
    else:
        q = (n / d) * F.lit(float(factor))
    return F.round(q.cast(RATIO_DEC), scale).cast("double")


def mean_round2(total: Column | str, count: Column | str, total_scale: int = NET_SCALE) -> Column:
    """``round(total / count, 2)`` of a decimal total, half away from zero, exactly.

    Uses integer arithmetic on the absolute total: (200 * units + count * 10^s)
    div (2 * count * 10^s) where units = |total| * 10^s, then the sign, so no
    binary division is involved.  NULL when count is 0 or NULL.
    """
    pow10 = 10 ** total_scale
    units = (_col(total) * F.lit(pow10)).cast("decimal(38,0)")
    n = F.nullif(_col(count).cast("decimal(38,0)"), F.lit(Decimal(0)))
    num = F.abs(units) * F.lit(200) + n * F.lit(pow10)
    den = n * F.lit(2 * pow10)
    return _signed(_int_div(num, den).cast("double") / F.lit(100.0), units)


def per_period_round2(total2: Column | str, days: Column | str, days_per_period: int) -> Column:
    """``round(total / (days / days_per_period), 2)`` exactly, NULL when days = 0.

    ``total2`` has two decimals (cents).  Equals
    (2 * P * |cents| + days) div (2 * days) / 100 with the total's sign, i.e.
    half away from zero.
    """
    cents = (_col(total2) * F.lit(100)).cast("decimal(38,0)")
    d = F.nullif(_col(days).cast("decimal(38,0)"), F.lit(Decimal(0)))
    num = F.abs(cents) * F.lit(2 * days_per_period) + d
    den = d * F.lit(2)
    return _signed(_int_div(num, den).cast("double") / F.lit(100.0), cents)


def _signed(size: Column, of: Column) -> Column:
    """``size`` with the sign of ``of``."""
    return F.when((of < 0) & (size != 0), -size).otherwise(size)


def _int_div(num: Column, den: Column) -> Column:
    """Exact integral division of two integral decimals (SQL ``div``).

    Column has no ``div`` operator in the Python API; the SQL function
    ``div`` (IntegralDivide) returns the exact integer quotient as BIGINT.
    """
    return F.call_function("div", num, den)
