"""Row frames over one entity's history.

A panel is unique on (ticker, date), so a ticker's window holds at most one row
per trading day: its size is bounded by the calendar, never by the table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

KEY = "ticker"
DAY = "date"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def history(key: str = KEY, day: str = DAY) -> WindowSpec:
    return Window.partitionBy(key).orderBy(day)


def trailing(n: int, key: str = KEY, day: str = DAY) -> WindowSpec:
    return history(key, day).rowsBetween(-(n - 1), 0)


def rolling(
    fn: Callable[[Column], Column],
    c: str | Column,
    n: int,
    min_periods: int | None = None,
    key: str = KEY,
    day: str = DAY,
) -> Column:
    """``fn`` over the last ``n`` rows, null until ``min_periods`` values exist."""
    w = trailing(n, key, day)
    need = n if min_periods is None else min_periods
    return F.when(F.count(col(c)).over(w) >= need, fn(col(c)).over(w))


def ratio(a: str | Column, b: str | Column) -> Column:
    """a / b as double, null when b is zero or missing."""
    return F.try_divide(col(a).cast("double"), col(b).cast("double"))


def finite(c: str | Column) -> Column:
    """Null for NaN and both infinities."""
    x = col(c)
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def clip(c: str | Column, lo: float | None = None, hi: float | None = None) -> Column:
    """Bound a value, keeping null null (``greatest`` alone would drop the null)."""
    x = col(c)
    y = x
    if lo is not None:
        y = F.greatest(y, F.lit(lo))
    if hi is not None:
        y = F.least(y, F.lit(hi))
    return F.when(x.isNotNull(), y)


def flag(cond: Column) -> Column:
    """1 when true, otherwise 0 (also for null)."""
    return F.when(cond, 1).otherwise(0)


def correlation(x: str | Column, y: str | Column, w: WindowSpec | None = None) -> Column:
    """Pearson correlation over complete pairs, null when a side is constant.

    The built-in ``corr`` divides by the deviations and fails on a constant side in ANSI mode,
    even under a guarding ``when``, because aggregates are evaluated first."""
    a, b = col(x).cast("double"), col(y).cast("double")
    both = a.isNotNull() & b.isNotNull()
    over = (lambda c: c) if w is None else (lambda c: c.over(w))
    cov = over(F.covar_pop(a, b))
    sa, sb = over(F.stddev_pop(F.when(both, a))), over(F.stddev_pop(F.when(both, b)))
    return F.try_divide(cov, sa * sb)
