"""Option pricing columns and bracketed solvers.

The solvers bisect whole Arrow batches with numpy: a fixed number of steps, no convergence test, so
results do not depend on batch boundaries.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

# Polynomial approximation of the normal distribution (Abramowitz & Stegun 26.2.17).
CDF_P, CDF_D = 0.2316419, 0.3989422804014327
CDF_B = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)


def norm_pdf(x: Column) -> Column:
    return F.exp(-(x * x) / 2) * CDF_D


def _tail(x: Column, t: Column) -> Column:
    poly = F.lit(0.0)
    for b in reversed(CDF_B):
        poly = (poly + b) * t
    return norm_pdf(x) * poly


def norm_cdf(x: Column) -> Column:
    tail = _tail(x, 1 / (1 + F.abs(x) * CDF_P))
    return F.when(x > 0, 1 - tail).otherwise(tail)


def with_cdfs(df: DataFrame, r: float, q: float, live: Column) -> DataFrame:
    """(spot, strike, t, sigma, call) -> the same with _d1 and _n1 = N(d1), _n2 = N(d2), of -d for puts; null where not ``live``.

    Each step reads the columns of the one before: as one expression, every use of N(d) would compute d anew.
    """
    s, k, t, v = (F.col(x) for x in ("spot", "strike", "t", "sigma"))
    sign = F.when(F.col("call"), 1.0).otherwise(-1.0)
    keep = [*df.columns, "_d1"]
    df = df.withColumn("_d1", F.when(live, d1_d2(s, k, t, r, v, q)[0]))
    df = df.select("*", (F.col("_d1") * sign).alias("_x1"), ((F.col("_d1") - v * F.sqrt(t)) * sign).alias("_x2"))
    df = df.select("*", *[(1 / (1 + F.abs(f"_x{i}") * CDF_P)).alias(f"_t{i}") for i in (1, 2)])
    df = df.select("*", *[_tail(F.col(f"_x{i}"), F.col(f"_t{i}")).alias(f"_p{i}") for i in (1, 2)])
    return df.select(*keep, *[F.when(F.col(f"_x{i}") > 0, 1 - F.col(f"_p{i}")).otherwise(F.col(f"_p{i}")).alias(f"_n{i}") for i in (1, 2)])


def with_option_price(df: DataFrame, r: float, q: float = 0.0, out: str = "price") -> DataFrame:
    """``option_price`` of (spot, strike, t, sigma, call) as a column made in steps, for whole chains."""
    s, k, t, call = (F.col(x) for x in ("spot", "strike", "t", "call"))
    a, b = s * F.exp(t * -q) * F.col("_n1"), k * F.exp(t * -r) * F.col("_n2")
    intrinsic = F.greatest(F.when(call, s - k).otherwise(k - s), F.lit(0.0))
    price = F.when(t <= 0, intrinsic).otherwise(F.when(call, a - b).otherwise(b - a))
    return with_cdfs(df, r, q, t > 0).select(*df.columns, price.alias(out))


def d1_d2(s: Column, k: Column, t: Column, r: float, sigma: Column, q: float = 0.0) -> tuple[Column, Column]:
    d1 = (F.log(s / k) + (sigma * sigma / 2 + (r - q)) * t) / (sigma * F.sqrt(t))
    return d1, d1 - sigma * F.sqrt(t)


def option_price(s: Column, k: Column, t: Column, r: float, sigma: Column, call: Column, q: float = 0.0) -> Column:
    """Black-Scholes price with dividend yield; intrinsic value at expiry."""
    d1, d2 = d1_d2(s, k, t, r, sigma, q)
    eq, er = F.exp(t * -q), F.exp(t * -r)
    c = s * eq * norm_cdf(d1) - k * er * norm_cdf(d2)
    p = k * er * norm_cdf(-d2) - s * eq * norm_cdf(-d1)
    intrinsic = F.greatest(F.when(call, s - k).otherwise(k - s), F.lit(0.0))
    return F.when(t <= 0, intrinsic).otherwise(F.when(call, c).otherwise(p))


def _cdf(x: np.ndarray) -> np.ndarray:
    t = 1 / (1 + CDF_P * np.abs(x))
    poly = np.zeros_like(x)
    for b in reversed(CDF_B):
        poly = (poly + b) * t
    tail = CDF_D * np.exp(-0.5 * x * x) * poly
    return np.where(x > 0, 1 - tail, tail)


def implied_vol(s: Column, k: Column, t: Column, price: Column, call: Column, r: float = 0.02, steps: int = 60) -> Column:
    """Volatility in (1e-4, 5) that reproduces the price; null for impossible prices or no bracket."""

    @F.pandas_udf(DoubleType())
    def solve(s: pd.Series, k: pd.Series, t: pd.Series, p: pd.Series, call: pd.Series) -> pd.Series:
        s, k, t, p = (x.to_numpy(dtype="float64", na_value=np.nan) for x in (s, k, t, p))
        is_call = call.to_numpy(dtype=bool)
        with np.errstate(all="ignore"):
            def value(v):
                d1 = (np.log(s / k) + (r + 0.5 * v * v) * t) / (v * np.sqrt(t))
                d2 = d1 - v * np.sqrt(t)
                disc = k * np.exp(-r * t)
                return np.where(is_call, s * _cdf(d1) - disc * _cdf(d2), disc * _cdf(-d2) - s * _cdf(-d1))

            intrinsic = np.maximum(np.where(is_call, s - k, k - s), 0)
            lo, hi = np.full(len(p), 1e-4), np.full(len(p), 5.0)
            ok = (s > 0) & (k > 0) & (t > 0) & (p > intrinsic + 1e-9) & (value(lo) <= p) & (value(hi) >= p)
            for _ in range(steps):
                mid = (lo + hi) / 2
                low = value(mid) < p
                lo, hi = np.where(low, mid, lo), np.where(low, hi, mid)
        return pd.Series(np.where(ok, (lo + hi) / 2, np.nan))

    return solve(s, k, t, price, call)


def bond_yield(times: Column, flows: Column, price: Column, steps: int = 100) -> Column:
    """Yield that discounts the (years, amount) arrays to the price; brackets [-.5, 1], then [-.9, 2]."""

    @F.pandas_udf(DoubleType())
    def solve(times: pd.Series, flows: pd.Series, price: pd.Series) -> pd.Series:
        n = len(price)
        if n == 0:
            return pd.Series([], dtype="float64")
        width = max(1, max(len(x) for x in times))
        t, f = np.zeros((n, width)), np.zeros((n, width))
        for i, (a, b) in enumerate(zip(times, flows)):     # pad the ragged arrays of the batch
            t[i, :len(a)], f[i, :len(b)] = a, b
        p = price.to_numpy(dtype="float64")

        def excess(y):
            return (f / (1 + y)[:, None] ** t).sum(axis=1) - p

        lo, hi = np.full(n, -0.5), np.full(n, 1.0)
        wide = excess(lo) * excess(hi) > 0
        lo, hi = np.where(wide, -0.9, lo), np.where(wide, 2.0, hi)
        ok = (excess(lo) * excess(hi) <= 0) & (p > 0)
        for _ in range(steps):
            mid = (lo + hi) / 2
            above = excess(mid) > 0                          # value falls as the yield rises
            lo, hi = np.where(above, mid, lo), np.where(above, hi, mid)
        return pd.Series(np.where(ok, (lo + hi) / 2, np.nan))

    return solve(times, flows, price)
