"""Sums of doubles that are the same for every order of the rows.

A plain sum of doubles hangs in its last digit on the order in which tasks and partial sums meet. That is enough to part
equal groups in a rank, or to move a value that lies on a bound across it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F

COARSE, FINE = 2.0 ** 4, 2.0 ** -22     # places at which a value is cut


def exact_sum(x: Column | str, over: WindowSpec | None = None) -> Column:
    """Sum of ``x`` as an aggregate, or over a window; only the last two additions round.

    Every value is cut at two fixed binary places. Sums of such pieces are exact while they stay under 10^17 and 2 * 10^9, so
    they don't hang on the order of the rows, and they combine map-side like any sum. Beyond that it is a plain sum.
    """
    x = (F.col(x) if isinstance(x, str) else x).cast("double")
    high = F.rint(x * (1 / COARSE)) * COARSE
    middle = F.rint((x - high) * (1 / FINE)) * FINE
    top, *rest = [F.sum(p) if over is None else F.sum(p).over(over) for p in (high, middle, x - high - middle)]
    # an infinite value leaves no rest
    return F.when(F.abs(top) < math.inf, top + rest[0] + rest[1]).otherwise(top)


def exact_mean(x: Column | str) -> Column:
    """Mean of the values that are not null, from their exact sum."""
    return F.try_divide(exact_sum(x), F.count(x).cast("double"))
