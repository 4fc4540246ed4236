"""Window shorthands. Every per-code window uses the same partition and order, so Spark sorts once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

KEYS = ("code",)
ORDER = ("ts",)


def series(keys: Sequence[str] = KEYS, order: Sequence[str] = ORDER) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(*order)


class Series:
    """Trailing-window expressions over one ordered series (all on one shared sort)."""

    def __init__(self, keys: Sequence[str] = KEYS, order: Sequence[str] = ORDER):
        self.keys, self.order = tuple(keys), tuple(order)

    @property
    def w(self) -> WindowSpec:
        """Built on use: a window needs a running session, a module import must not."""
        return series(self.keys, self.order)

    def trail(self, n: int, skip: int = 0) -> WindowSpec:
        return self.w.rowsBetween(-(n - 1) - skip, -skip)

    def run(self) -> WindowSpec:
        return self.w.rowsBetween(Window.unboundedPreceding, 0)

    def lag(self, c, n: int = 1) -> Column:
        return F.lag(_c(c), n).over(self.w)

    def lead(self, c, n: int = 1) -> Column:
        return F.lead(_c(c), n).over(self.w)

    def diff(self, c, n: int = 1) -> Column:
        return _c(c) - self.lag(c, n)

    def pct(self, c, n: int = 1) -> Column:
        return ratio(_c(c), self.lag(c, n)) - 1

    def idx(self) -> Column:
        """1-based position in the series."""
        return F.row_number().over(self.w)

    def agg(self, fn, c, n: int, skip: int = 0, min_periods: int | None = None) -> Column:
        """``fn`` over the last ``n`` rows; null while fewer than ``min_periods`` (default n) values."""
        w = self.trail(n, skip)
        need = n if min_periods is None else min_periods
        out = fn(_c(c)).over(w)
        return out if need <= 1 else F.when(F.count(_c(c)).over(w) >= need, out)

    def mean(self, c, n, **k) -> Column:
        return self.agg(F.avg, c, n, **k)

    def std(self, c, n, **k) -> Column:
        return self.agg(F.stddev_samp, c, n, **k)

    def pstd(self, c, n, **k) -> Column:
        return self.agg(F.stddev_pop, c, n, **k)

    def max(self, c, n, **k) -> Column:
        return self.agg(F.max, c, n, **k)

    def min(self, c, n, **k) -> Column:
        return self.agg(F.min, c, n, **k)

    def sum(self, c, n, **k) -> Column:
        return self.agg(F.sum, c, n, **k)


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio(a, b) -> Column:
    """a / b, null when b is 0 (ANSI mode would raise)."""
    return F.try_divide(_c(a).cast("double"), _c(b).cast("double"))


def ladder(*steps, default=None) -> Column:
    """``ladder((cond, value), ..., default=x)``: first true condition wins."""
    out = F
    for cond, value in steps:
        out = out.when(cond, value)
    return out if default is None else out.otherwise(default)


def clamp(c: Column, lo: float, hi: float) -> Column:
    """Null stays null (greatest and least alone would skip it)."""
    return F.when(c.isNotNull(), F.greatest(F.lit(lo), F.least(F.lit(hi), c)))
