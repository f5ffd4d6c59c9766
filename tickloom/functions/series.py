"""Column factories for ordered series: trailing windows with full-window semantics.

Missing values are NULL. A windowed value is NULL until its window is full, and wherever the
window holds a NULL unless the function says otherwise. Division by zero is NULL with ``div``;
``ratio`` and ``ln`` give what floating point gives: infinities, and NaN where there is no limit.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


class Axis:
    """Partition and order of a series; builds its windows."""

    def __init__(self, by: str | list[str] = "symbol", order: str | list[str] = "ts_ns", time: str = "ts_ns"):
        self.by = [by] if isinstance(by, str) else list(by)
        self.order = [order] if isinstance(order, str) else list(order)
        self.time = time

    @property
    def whole(self) -> Window:
        return Window.partitionBy(*self.by).orderBy(*self.order)

    def rows(self, n: int, end: int = 0) -> Window:
        return self.whole.rowsBetween(-(n - 1), end)

    @property
    def running(self) -> Window:
        return self.whole.rowsBetween(Window.unboundedPreceding, 0)

    def ago(self, ns: int) -> Window:
        """Rows at least ns before the current one."""
        return Window.partitionBy(*self.by).orderBy(self.time).rangeBetween(Window.unboundedPreceding, -ns)

    def since(self, ns: int) -> Window:
        """Rows of the last ns, both ends included."""
        return Window.partitionBy(*self.by).orderBy(self.time).rangeBetween(-ns, 0)

    def lag(self, c: Column, n: int = 1) -> Column:
        return F.lag(c, n).over(self.whole) if n >= 0 else F.lead(c, -n).over(self.whole)

    def full(self, n: int, *cs: Column) -> Column:
        """The last n rows exist and hold no NULL of the columns."""
        ok = F.count(F.lit(1)).over(self.rows(n)) == n
        for c in cs:
            ok = ok & (F.count(c).over(self.rows(n)) == n)
        return ok

    def agg(self, f: Column, n: int, *cs: Column) -> Column:
        return F.when(self.full(n, *cs), f.over(self.rows(n)))


def div(a: Column, b: Column) -> Column:
    return F.try_divide(a, b)


def ratio(a: Column, b: Column) -> Column:
    """a / b in floating point: over 0 an infinity, 0 / 0 is NaN."""
    return F.when(b == 0, a * F.pow(b, F.lit(-1.0))).otherwise(F.try_divide(a, b))


def ln(x: Column) -> Column:
    """Log in floating point: -infinity at 0, NaN below."""
    return F.when(x > 0, F.log(x)).when(x == 0, F.lit(-math.inf)).when(x < 0, F.lit(math.nan))


def safe_log(x: Column) -> Column:
    return F.when(x > 0, F.log(x))


def safe_log1p(x: Column) -> Column:
    return F.when(x >= 0, F.log1p(x))


def safe_sqrt(x: Column) -> Column:
    return F.when(x >= 0, F.sqrt(x))


def null_min(a: Column, b: Column) -> Column:
    """The lesser; NULL if either is."""
    return F.when(a.isNotNull() & b.isNotNull(), F.least(a, b))


def null_max(a: Column, b: Column) -> Column:
    return F.when(a.isNotNull() & b.isNotNull(), F.greatest(a, b))


def clip(x: Column, lower: float | None = None, upper: float | None = None) -> Column:
    if upper is not None:
        x = F.when(x > upper, F.lit(float(upper))).otherwise(x)
    return x if lower is None else F.when(x < lower, F.lit(float(lower))).otherwise(x)


def sma(ax: Axis, x: Column, n: int) -> Column:
    return ax.agg(F.avg(x), n, x)


def rolling_std(ax: Axis, x: Column, n: int, ddof: int = 1) -> Column:
    return ax.agg(F.stddev_samp(x) if ddof else F.stddev_pop(x), n, x)


def zscore(ax: Axis, x: Column, n: int, ddof: int = 0) -> Column:
    sd = rolling_std(ax, x, n, ddof)
    return F.when(sd > 0, (x - sma(ax, x, n)) / sd)


def bollinger_percent_b(ax: Axis, x: Column, n: int, k: float) -> Column:
    m, sd = sma(ax, x, n), rolling_std(ax, x, n)
    return div(x - (m - k * sd), 2 * k * sd)


def burst_ratio(ax: Axis, x: Column, n: int) -> Column:
    med = ax.agg(F.percentile(x, F.lit(0.5)), n, x)
    return F.when(med > 0, x / med)


def realized_vol(ax: Axis, r: Column, n: int, sample: bool = False) -> Column:
    k = F.count(r).over(ax.rows(n))
    return F.when(ax.full(n) & (k > 1), F.sqrt(div(F.sum(r * r).over(ax.rows(n)), (k - int(sample)).cast("double"))))


def bipower(ax: Axis, r: Column, prev: Column, n: int) -> Column:
    return F.when(ax.full(n + 1, r), math.sqrt(math.pi / 2) * F.sum(F.abs(r) * F.abs(prev)).over(ax.rows(n)))


def vpin(ax: Axis, buy: Column, sell: Column, n: int) -> Column:
    total = F.sum(buy + sell).over(ax.rows(n))
    return F.when(ax.full(n, buy, sell) & (total > 1e-9), F.sum(F.abs(buy - sell)).over(ax.rows(n)) / total)


def flow_acceleration(ax: Axis, v: Column, n: int, recent: int) -> Column:
    if recent >= n:
        return F.lit(None).cast("double")
    late, early = F.sum(v).over(ax.rows(recent)), F.sum(v).over(ax.whole.rowsBetween(-(n - 1), -recent))
    return F.when(ax.full(n, v), F.log((late + 1e-12) / (early + 1e-12)))


def stoch_k(ax: Axis, close: Column, low: Column, high: Column, n: int) -> Column:
    lo, hi = F.min(low).over(ax.rows(n)), F.max(high).over(ax.rows(n))
    return F.when(ax.full(n, close, low, high), 100 * div(close - lo, hi - lo))


def rolling_variance(ax: Axis, x: Column, n: int, ddof: int = 0, least: int | None = None) -> Column:
    """NULL-skipping variance, floored at 0, with at least ``least`` values (n by default)."""
    v = (F.var_samp(x) if ddof else F.var_pop(x)).over(ax.rows(n))
    return F.when(F.count(x).over(ax.rows(n)) >= (n if least is None else least), F.greatest(v, F.lit(0.0)))


def true_range(high: Column, low: Column, prev: Column, first: Column) -> Column:
    wide = F.greatest(high - low, F.abs(high - prev), F.abs(low - prev))
    return F.when(first, high - low).otherwise(F.when(prev.isNotNull() & high.isNotNull() & low.isNotNull(), wide))


def parkinson_range(high: Column, low: Column) -> Column:
    return F.pow(F.log(div(high, low)), 2) / (4 * math.log(2))


def lagged_return(ax: Axis, x: Column, seq: Column, ns: int, is_log: bool = False) -> Column:
    """As-of lookback: against the last row at least ns before, without a join."""
    if ns <= 0:
        raise ValueError("the window must be positive")
    base = F.max_by(x, seq).over(ax.ago(ns))
    r = ratio(x, base)
    return ln(r) if is_log else r - 1


def time_cues(ts_ns: Column) -> dict[str, Column]:
    """Time of day and week, UTC; Monday is 0."""
    s = F.call_function("div", ts_ns, F.lit(1_000_000_000))
    day = F.pmod(s, F.lit(86_400)).cast("double")
    dow = F.pmod(F.floor(s / 86_400) + 3, F.lit(7)).cast("double")
    hour, minute = F.floor(day / 3600).cast("int"), F.floor((day % 3600) / 60).cast("int")
    tau = 2 * math.pi
    return {
        "sin_td": F.sin(tau * day / 86_400),
        "cos_td": F.cos(tau * day / 86_400),
        "sin_dw": F.sin(tau * dow / 7),
        "cos_dw": F.cos(tau * dow / 7),
        "asia": hour < 8,
        "eu": (hour >= 7) & (hour < 15),
        "us": (hour >= 13) & (hour < 21),
        "sess_x": hour.isin(0, 7, 13) & (minute == 0),
        "top_hr": minute == 0,
    }
