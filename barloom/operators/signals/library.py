"""The whole signal library over one bar level as one run.

Bars are stored once with the columns that all signals read, so trades are read once. Signals are compiled in groups: those
that read the same recursions stand together, so a recursion is run once or twice, and a group is small enough for its plan
and its generated code. A group shuffles the stored bars by code once for all of its windows.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.operators.indicators import S, base_columns
from barloom.operators.signals.base import SIGNALS, label_frame, signal_rows
from barloom.session import cut

GROUP = 24


def groups(names: Sequence[str], size: int = GROUP) -> list[list[str]]:
    """Groups of at most ``size`` signals, in order of their recursions and of the depth of their windows."""
    order = sorted(names, key=lambda n: (repr(SIGNALS[n].rec), len(SIGNALS[n].stages), n))
    return [order[a : a + size] for a in range(0, len(order), size)]


def prepared(bars: DataFrame) -> DataFrame:
    """Bars with base columns and a mark on each code's last bar, stored."""
    return cut(base_columns(bars).withColumn("is_last", S.lead("ts").isNull()))


def signal_library(bars: DataFrame, level: str, names: Sequence[str] | None = None, last_only: bool = False, size: int = GROUP) -> DataFrame:
    """signals(code, ts, level, category, name, v1) of all named signals (default: every bar signal) for every bar, or for
    each code's last bar. A signal's second value stands behind its first as in ``signal_rows``."""
    base, parts = prepared(bars), []
    for part in groups(names or list(SIGNALS), size):
        frame = label_frame(base, part, ["is_last"])
        frame = frame.where("is_last") if last_only else frame
        parts.append(cut(signal_rows(frame.drop("is_last"), level)))  # one small plan each, instead of one that is planned anew at every stage
    return reduce(DataFrame.unionByName, parts)
