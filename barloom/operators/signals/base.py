"""Signal registry and the one plan that evaluates any set of signals."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.recursive import with_recursions
from barloom.functions.windows import Series
from barloom.operators.indicators import base_columns, with_stages

NONE = "其他"
S = Series()
c = F.col


@dataclass(frozen=True)
class Signal:
    name: str
    need: int                                   # bars required, else the none label
    label: Callable[[], Column | tuple[Column, Column]]
    before: dict = field(default_factory=dict)  # window columns the recursions read
    rec: tuple = ()                             # recursion specs
    stages: tuple = ()                          # later window levels


SIGNALS: dict[str, Signal] = {}


def signal(name: str, need: int, before=None, rec=(), stages=()):
    def wrap(fn):
        SIGNALS[name] = Signal(name, need, fn, before or {}, tuple(rec), tuple(stages))
        return fn
    return wrap


def pick(*steps, default=NONE) -> Column:
    out = F
    for cond, label in steps:
        out = out.when(cond, label)
    return out.otherwise(default)


def bands(x: Column, steps: Sequence[tuple[float, str]], last: str) -> Column:
    """First label whose threshold ``x`` exceeds, else ``last``; the none label for a null ``x``."""
    out = F
    for t, label in steps:
        out = out.when(x > t, F.lit(label))
    return out.when(x.isNotNull(), F.lit(last)).otherwise(F.lit(NONE))


def cross(a: Column, b: Column, pa: Column, pb: Column,
          labels=("金叉", "死叉", "多头", "空头")) -> Column:
    """State of line a against line b: crossed up, crossed down, above, below."""
    up, down, above, below = labels
    return pick(((a > b) & (pa <= pb), up), ((a < b) & (pa >= pb), down), (a > b, above),
                (a.isNotNull() & b.isNotNull(), below))


def cross_cols(a: str, b: str, labels=("金叉", "死叉", "多头", "空头")) -> Column:
    return cross(c(a), c(b), S.lag(a), S.lag(b), labels)


def signal_frame(bars: DataFrame, names: Sequence[str], di: int = 1) -> DataFrame:
    """Labels of the named signals per bar. One shuffle by code serves every window and recursion.

    A second value of a signal appears as ``<name>_v2`` (``<name>_2nd`` if a signal of that name is there); ``di`` > 1 reads the label di-1 bars back.
    """
    out = label_frame(base_columns(bars), names)
    if di > 1:
        labels = [x for x in out.columns if x not in ("code", "ts")]
        out = out.select("code", "ts", *[F.coalesce(S.lag(x, di - 1), F.lit(NONE)).alias(x) for x in labels])
    return out


def label_frame(df: DataFrame, names: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """The labels of ``signal_frame`` from bars that have their base columns; ``keep`` names columns to carry along."""
    todo = [SIGNALS[n] for n in names]
    before = {k: f for s in todo for k, f in s.before.items()}
    if before:
        df = df.select("*", *[f().alias(k) for k, f in before.items()])
    df = with_recursions(df, [r for s in todo for r in s.rec])
    for level in range(max((len(s.stages) for s in todo), default=0)):
        merged = {k: f for s in todo if len(s.stages) > level for k, f in s.stages[level].items()}
        df = with_stages(df, [merged])
    cols = []
    for s in todo:
        out = s.label()
        parts = out if isinstance(out, tuple) else (out,)
        for j, p in enumerate(parts):
            name = s.name if j == 0 else f"{s.name}_2nd" if f"{s.name}_v2" in names else f"{s.name}_v2"
            none = NONE if j == 0 else "任意"
            cols.append(F.when(c("i") + 1 >= s.need, F.coalesce(p, F.lit(none))).otherwise(F.lit(none)).alias(name))
    return df.select("code", "ts", *keep, *cols)


def signal_rows(frame: DataFrame, level: str) -> DataFrame:
    """Wide labels -> signals(code, ts, level, category, name, v1), none labels dropped.

    A signal of two values has both in ``v1``, joined by ``_``, unless the second is open ("任意").
    """
    labels = [x for x in frame.columns if x not in ("code", "ts")]
    second = {x: f"{x}_2nd" if f"{x}_2nd" in labels else f"{x}_v2" for x in labels}
    second = {x: y for x, y in second.items() if y in labels}
    names = [x for x in labels if x not in second.values()]
    both = {x: F.when((c(x) != NONE) & (c(y) != "任意"), F.concat_ws("_", x, y)).otherwise(c(x)) for x, y in second.items()}
    frame = frame.select("code", "ts", *[both.get(x, c(x)).alias(x) for x in names])
    rows = frame.unpivot(["code", "ts"], names, "name", "v1")
    return rows.where(c("v1") != NONE).select(
        "code", "ts", F.lit(level).alias("level"), F.split("name", "_")[0].alias("category"), "name", "v1")
