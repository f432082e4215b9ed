"""Exact arithmetic helpers: nothing here goes through DOUBLE."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(num: Column, den: Column, scale: int = 6) -> Column:
    """``num / den`` rounded half up once to ``scale`` digits; NULL when den is 0.

    Both sides are non-negative whole numbers. The remainder is scaled and
    rounded on its own in a wide DECIMAL, so no step overflows or rounds twice.
    """
    one = 10**scale
    d = F.nullif(den, F.lit(0)).cast("decimal(20,0)")
    n = num.cast("decimal(20,0)")
    whole = F.call_function("div", n, d)
    rest = (n - whole.cast("decimal(19,0)") * d).cast("decimal(20,0)")
    doubled = rest * F.lit(2 * one).cast("decimal(10,0)") + d
    part = F.call_function("div", doubled, d * F.lit(2).cast("decimal(1,0)")).cast("decimal(10,0)")
    unit = F.expr(f"cast('{1 / one:.{scale}f}' as decimal({scale + 1},{scale}))")
    return (whole.cast("decimal(18,0)") + part * unit).cast(f"decimal(24,{scale})")


def bucket_of(col: Column, width: int) -> Column:
    """Whole-number bucket of a whole-number column, without DOUBLE division."""
    return F.call_function("div", col.cast("bigint"), F.lit(width).cast("bigint"))
