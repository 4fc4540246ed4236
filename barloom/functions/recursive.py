"""Recursions that have no window form: one linear pass per series.

Spark partitions the bars by key and hands each series to numpy as Arrow batches. A series is a bar
history, so its length is bounded by the calendar, not by the number of trades behind the bars.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

SAR_STEP, SAR_MAX = 0.02, 0.2


def span(n: int) -> float:
    """Smoothing weight of an n-bar EMA."""
    return 2.0 / (n + 1)


def com(n: float) -> float:
    return 1.0 / (1.0 + n)


def parabolic_stop(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Stop-and-reverse level per bar: the stop chases the extreme price and flips when touched."""
    out = np.empty(len(high))
    if not len(high):
        return out
    rising, rate, extreme, level = True, SAR_STEP, high[0], low[0]
    out[0] = level
    for t in range(1, len(high)):
        back = slice(max(0, t - 2), t)
        level += rate * (extreme - level)
        level = min(level, low[back].min()) if rising else max(level, high[back].max())
        touched = low[t] < level if rising else high[t] > level
        if touched:
            level, extreme = extreme, (low[t] if rising else high[t])
            rising, rate = not rising, SAR_STEP
        elif (rising and high[t] > extreme) or (not rising and low[t] < extreme):
            extreme = high[t] if rising else low[t]
            rate = min(rate + SAR_STEP, SAR_MAX)
        out[t] = level
    return out


def hurst_exponent(close: np.ndarray, n: int) -> np.ndarray:
    """Slope of log mean rescaled range on log chunk length over the last n closes (null before)."""
    out = np.full(len(close), np.nan)
    if len(close) < n:
        return out
    rets = np.diff(np.log(np.lib.stride_tricks.sliding_window_view(close, n)), axis=1)
    size = rets.shape[1]
    xs, ys = [], []
    for k in range(5, min(20, size // 2) + 1):
        m = size // k
        chunks = rets[:, : k * m].reshape(len(rets), k, m)
        walk = np.cumsum(chunks - chunks.mean(axis=2, keepdims=True), axis=2)
        sd = chunks.std(axis=2)
        rs = np.where(sd > 0, (walk.max(axis=2) - walk.min(axis=2)) / np.where(sd > 0, sd, 1), np.nan)
        xs.append(np.full(len(rets), np.log(m)))
        with np.errstate(all="ignore"):
            ys.append(np.log(np.nanmean(rs, axis=1)))
    x, y = np.array(xs), np.array(ys)
    xm, ym = x.mean(axis=0), y.mean(axis=0)
    out[n - 1:] = ((x - xm) * (y - ym)).sum(axis=0) / ((x - xm) ** 2).sum(axis=0)
    return out


def _step(pdf: pd.DataFrame, spec: tuple) -> np.ndarray | pd.Series:
    kind, args = spec[1], spec[2:]
    if kind == "ema":
        return pdf[args[0]].astype("float64").ewm(alpha=args[1], adjust=False).mean()
    if kind == "minus":
        return pdf[args[0]] - pdf[args[1]]
    if kind == "sar":
        return parabolic_stop(pdf["high"].to_numpy(), pdf["low"].to_numpy())
    if kind == "hurst":
        return hurst_exponent(pdf["close"].to_numpy(dtype="float64"), args[0])
    raise ValueError(kind)


def with_recursions(df: DataFrame, specs: Sequence[tuple], keys: Sequence[str] = ("code",),
                    order: str = "ts") -> DataFrame:
    """Append recursive columns. Specs run in order and may use earlier outputs:
    ``(out, "ema", source, weight)``, ``(out, "minus", a, b)``, ``(out, "sar")``, ``(out, "hurst", n)``."""
    specs = [s for i, s in enumerate(specs) if s not in specs[:i]]
    if not specs:
        return df
    names = [s[0] for s in specs]
    schema = T.StructType([*df.schema.fields, *(T.StructField(n, T.DoubleType()) for n in names)])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable").reset_index(drop=True)
        for s in specs:
            pdf[s[0]] = _step(pdf, s)
        return pdf

    return df.groupBy(*keys).applyInPandas(run, schema)
