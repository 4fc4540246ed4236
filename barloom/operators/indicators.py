"""Technical indicators on bars(code, ts, open, high, low, close, volume, amount).

Functions return Columns over the shared per-code window; those that need a recursion or a second
window level are built by ``with_indicators`` in stages.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.recursive import com, span, with_recursions
from barloom.functions.windows import Series, ladder, ratio

S = Series()
c = F.col


def base_columns(bars: DataFrame) -> DataFrame:
    """Position, previous bar, differences and true range: the first window level of everything else."""
    df = bars.select(
        "*", (S.idx() - 1).alias("i"), *[S.lag(x).alias(f"p{x[0]}") for x in ("open", "high", "low", "close", "volume")])
    return df.select(
        "*", (c("close") - c("pc")).alias("d"), (ratio("close", "pc") - 1).alias("r"),
        F.greatest(c("high") - c("low"), F.abs(c("high") - c("pc")), F.abs(c("low") - c("pc"))).alias("tr"),
        ((c("high") + c("low") + c("close")) / 3).alias("tp"))


# ---- single-level windows ------------------------------------------------------------------------

def sma(x="close", n: int = 20, loose: bool = True) -> Column:
    """``loose`` averages what there is; otherwise null until n rows."""
    return S.mean(x, n, min_periods=1 if loose else n)


def wma(x="close", n: int = 5) -> Column:
    """Weights 1..n, newest heaviest."""
    total = sum((S.lag(x, n - k) if k < n else F.col(x)) * k for k in range(1, n + 1))
    return total / (n * (n + 1) / 2)


def bollinger(n: int = 20, k: float = 2.0, loose: bool = True) -> tuple[Column, Column, Column]:
    need = 1 if loose else n
    mid, sd = S.mean("close", n, min_periods=need), S.std("close", n, min_periods=max(need, 2))
    return mid + sd * k, mid, mid - sd * k


def atr(n: int = 14, loose: bool = True) -> Column:
    return S.mean("tr", n, min_periods=1 if loose else n)


def roc(n: int = 5) -> Column:
    return (ratio("close", S.lag("close", n)) - 1) * 100


def mtm(n: int = 12) -> Column:
    return c("close") - S.lag("close", n)


def obv() -> Column:
    return F.sum(F.coalesce(F.signum("d"), F.lit(0.0)) * c("volume")).over(S.run())


def vwap_running() -> Column:
    return ratio(F.sum(c("close") * c("volume")).over(S.run()), F.sum("volume").over(S.run()))


def vwap_day(day: Column) -> Column:
    w = Window.partitionBy("code", day).orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    return ratio(F.sum("amount").over(w), F.sum("volume").over(w))


def rsi_simple(n: int = 14) -> Column:
    """Rolling-mean RSI; a window without losses gives 0 (loss 0 counts as infinite)."""
    gain = S.mean(F.when(c("d").isNotNull(), F.greatest(c("d"), F.lit(0.0))), n)
    loss = S.mean(F.when(c("d").isNotNull(), F.greatest(-c("d"), F.lit(0.0))), n)
    return F.when(loss == 0, F.lit(0.0)).otherwise(100 - 100 / (1 + ratio(gain, loss)))


def cci(n: int = 14) -> Column:
    """(tp - mean) / (0.015 x mean absolute deviation); the deviation needs the frame's own mean."""
    frame = F.collect_list("tp").over(S.trail(n))
    mean = S.mean("tp", n)
    dev = F.aggregate(frame, F.lit(0.0), lambda a, x: a + F.abs(x - mean)) / n
    return ratio(c("tp") - mean, dev * 0.015)


def williams_r(n: int = 14) -> Column:
    hi, lo = S.max("high", n), S.min("low", n)
    return (hi - c("close")) / (hi - lo + 1e-10) * 100


def psy(n: int = 12) -> Column:
    return S.mean(F.when(c("d").isNotNull(), F.when(c("d") > 0, 100.0).otherwise(0.0)), n)


def volume_ratio(n: int = 26) -> Column:
    vol = lambda cond: S.sum(F.when(cond, c("volume")).otherwise(F.lit(0.0)), n)
    up, down, flat = vol(c("d") > 0), vol(c("d") < 0), vol(c("d") == 0)
    return (up + flat / 2) / (down + flat / 2 + 1e-10) * 100


def pivot_points() -> dict[str, Column]:
    p = (c("ph") + c("pl") + c("pc")) / 3
    return {"p": p, "r1": 2 * p - c("pl"), "s1": 2 * p - c("ph"), "r2": p + (c("ph") - c("pl")),
            "s2": p - (c("ph") - c("pl")), "r3": c("ph") + 2 * (p - c("pl")), "s3": c("pl") - 2 * (c("ph") - p)}


# Retracement levels.
FIB = [0.0, 0.236, 0.382, 0.5, 0.618, 0.786, 1.0]


def fibonacci(n: int = 60) -> Column:
    """Array of price levels between the n-bar high and low."""
    hi, lo = S.max("high", n), S.min("low", n)
    return F.array(*[hi - (hi - lo) * f for f in FIB])


def rsv(n: int = 9, loose: bool = True) -> Column:
    need = 1 if loose else n
    hi, lo = S.max("high", n, min_periods=need), S.min("low", n, min_periods=need)
    if loose:
        return (c("close") - lo) / (hi - lo + 1e-10) * 100
    return F.coalesce(ratio(c("close") - lo, hi - lo) * 100, F.lit(50.0))


# ---- recursions ----------------------------------------------------------------------------------

MACD = [("e12", "ema", "close", span(12)), ("e26", "ema", "close", span(26)), ("dif", "minus", "e12", "e26"),
        ("dea", "ema", "dif", span(9)), ("_bar", "minus", "dif", "dea")]


def rsi_recursion(n: int) -> list[tuple]:
    return [(f"ag{n}", "ema", "gain", com(n - 1)), (f"al{n}", "ema", "loss", com(n - 1))]


def wilder_rsi(n: int) -> Column:
    """Null where the average loss is 0."""
    return 100 - 100 / (1 + ratio(f"ag{n}", f"al{n}"))


KDJ = [("k", "ema", "rsv", com(2)), ("dd", "ema", "k", com(2))]
TRIX = [("t1", "ema", "close", span(12)), ("t2", "ema", "t1", span(12)), ("t3", "ema", "t2", span(12))]
TSI = [("ad1", "ema", "d", span(25)), ("aa1", "ema", "absd", span(25)), ("ad2", "ema", "ad1", span(13)),
       ("aa2", "ema", "aa1", span(13))]


def gain_loss(df: DataFrame) -> DataFrame:
    ok = c("d").isNotNull()
    return df.select("*", F.when(ok, F.greatest(c("d"), F.lit(0.0))).alias("gain"),
                     F.when(ok, F.greatest(-c("d"), F.lit(0.0))).alias("loss"), F.abs("d").alias("absd"))


def macd_columns(bars: DataFrame) -> DataFrame:
    return with_recursions(bars, MACD).withColumn("bar", c("_bar") * 2).drop("_bar")


def dmi_stages(n: int = 14) -> list[dict[str, Callable[[], Column]]]:
    """+DI, -DI and ADX by simple means: three window levels."""
    up, dn = lambda: c("high") - c("ph"), lambda: c("pl") - c("low")
    pick = lambda a, b: F.when((a > b) & (a > 0), a).otherwise(F.lit(0.0))
    return [
        {"pdm": lambda: pick(up(), dn()), "mdm": lambda: pick(dn(), up())},
        {"pdi": lambda: ratio(S.mean("pdm", n), S.mean("tr", n)) * 100,
         "mdi": lambda: ratio(S.mean("mdm", n), S.mean("tr", n)) * 100},
        {"dx": lambda: F.abs(c("pdi") - c("mdi")) / (c("pdi") + c("mdi") + 1e-10) * 100},
        {"adx": lambda: S.mean("dx", n)},
    ]


def with_stages(df: DataFrame, stages: Sequence[dict[str, Callable[[], Column]]]) -> DataFrame:
    for stage in stages:
        df = df.select("*", *[f().alias(k) for k, f in stage.items() if k not in df.columns])
    return df


# ---- divergences ---------------------------------------------------------------------------------

def _near_high(n: int) -> Column:
    return c("close") >= S.max("close", n) * 0.995


def _near_low(n: int) -> Column:
    return c("close") <= S.min("close", n) * 1.005


def macd_divergence(n: int = 10, bar: str = "bar") -> Column:
    """'top' / 'bottom': price near its extreme while the last 3 bars of MACD stay under 85 % of the earlier peak."""
    hi3, hi_before = S.max(bar, 3), S.max(bar, n - 3, skip=3)
    lo3, lo_before = S.min(bar, 3), S.min(bar, n - 3, skip=3)
    return F.when(S.idx() >= n + 2, ladder(
        (_near_high(n) & (hi3 < hi_before * 0.85) & (hi3 > 0), "top"),
        (_near_low(n) & (lo3 > lo_before * 0.85) & (lo3 < 0), "bottom")))


def rsi_divergence(n: int = 10, rsi: str = "rsi") -> Column:
    hi, lo = S.max(rsi, n, min_periods=1), S.min(rsi, n, min_periods=1)
    return F.when(S.idx() >= n + 2, ladder(
        (_near_high(n) & (c(rsi) < hi - 5), "rsi_top"), (_near_low(n) & (c(rsi) > lo + 5), "rsi_bottom")))


# ---- realised volatility -------------------------------------------------------------------------

LN2 = math.log(2)


def _annual(var: Column, year: int) -> Column:
    return F.sqrt(F.greatest(var, F.lit(0.0)) * year)


def _positive(n: int, *cols: str) -> Column:
    bad = F.lit(False)
    for x in cols:
        bad = bad | (c(x) <= 0)
    return F.max(bad.cast("int")).over(S.trail(n)) == 0


def vol_close(n: int = 20, year: int = 252) -> Column:
    """Sample deviation of log returns; the first n rows are null."""
    return S.std("lr", n) * math.sqrt(year)


def log_return() -> Column:
    ok = (c("close") > 0) & (c("pc") > 0)
    return F.when(ok, F.log(F.when(ok, c("close") / c("pc"))))


def _range_vol(term: Column, n: int, year: int, cols: Sequence[str]) -> Column:
    ok = _positive(n, *cols) & (F.max((c("high") < c("low")).cast("int")).over(S.trail(n)) == 0)
    var = S.sum(term, n) / (n - 1)
    return F.when(ok & (S.idx() > n), F.when(var.isNotNull(), _annual(var, year)))


def _ln(a: str, b: str) -> Column:
    ok = (c(a) > 0) & (c(b) > 0)
    return F.log(F.when(ok, c(a) / c(b)))


def vol_parkinson(n: int = 20, year: int = 252) -> Column:
    return _range_vol(_ln("high", "low") ** 2 / (4 * LN2), n, year, ("high", "low"))


def vol_garman_klass(n: int = 20, year: int = 252) -> Column:
    term = _ln("high", "low") ** 2 * 0.5 - _ln("close", "open") ** 2 * (2 * LN2 - 1)
    return _range_vol(term, n, year, ("open", "high", "low", "close"))


def vol_rogers_satchell(n: int = 20, year: int = 252) -> Column:
    u, d, k = _ln("high", "open"), _ln("low", "open"), _ln("close", "open")
    return _range_vol(u * (u - k) + d * (d - k), n, year, ("open", "high", "low", "close"))


# ---- period analysis -----------------------------------------------------------------------------

def period_frame(bars: DataFrame) -> DataFrame:
    """All indicators and states of one level, per bar. Rows before the 10th bar are neutral (score 50)."""
    df = gain_loss(base_columns(bars)).withColumn("rsv", rsv(9))
    df = macd_columns(with_recursions(df, KDJ + rsi_recursion(14)))
    up, mid, lo = bollinger()
    df = df.select(
        "*", *[sma("close", n).alias(f"ma{n}") for n in (5, 10, 20, 60)], up.alias("boll_up"), mid.alias("boll_mid"),
        lo.alias("boll_low"), atr(14).alias("atr"), obv().alias("obv"), wilder_rsi(14).alias("rsi"),
        (c("k") * 3 - c("dd") * 2).alias("j"))
    pb, pk, pd_ = S.lag("bar"), S.lag("k"), S.lag("dd")
    df = df.select(
        "*",
        ladder(((c("ma5") > c("ma10")) & (c("ma10") > c("ma20")) & (c("ma20") > c("ma60")), "bull"),
               ((c("ma5") < c("ma10")) & (c("ma10") < c("ma20")) & (c("ma20") < c("ma60")), "bear"),
               default="mixed").alias("ma_state"),
        ladder(((c("bar") > 0) & (pb < 0), "golden"), ((c("bar") < 0) & (pb > 0), "dead"), (c("bar") > pb, "expand"),
               default="shrink").alias("macd_state"),
        ladder((F.round("rsi", 2) > 70, "overbought"), (F.round("rsi", 2) < 30, "oversold"), default="normal").alias("rsi_zone"),
        ladder(((c("k") > c("dd")) & (pk <= pd_), "golden"), ((c("k") < c("dd")) & (pk >= pd_), "dead"),
               (c("j") > 80, "overbought"), (c("j") < 20, "oversold"), default="running").alias("kdj_state"),
        ((c("close") - c("boll_mid")) / (c("boll_up") - c("boll_mid") + 1e-10)).alias("boll_pos"),
        (ratio("atr", "close") * 100).alias("atr_pct"),
        # 5-bar mean of OBV as it stood four bars ago
        ladder((c("obv") > S.mean("obv", 5, skip=4, min_periods=1), "up"), default="down").alias("obv_trend"),
        ((ratio("close", S.lag("close", 9)) - 1) * 100).alias("change10"))
    df = df.select(
        "*",
        ladder((c("boll_pos") > 0.8, "upper"), (c("boll_pos") > 0.2, "above_mid"), (c("boll_pos") > -0.2, "mid"),
               (c("boll_pos") > -0.8, "below_mid"), default="lower").alias("boll_zone"),
        ladder((c("change10") > 3, "up"), (c("change10") < -3, "down"), default="flat").alias("trend"))
    return df.withColumn("score", F.when(c("i") >= 9, period_score()).otherwise(F.lit(50)))


def _points(col: str, table: dict[str, int]) -> Column:
    return ladder(*[(c(col) == k, v) for k, v in table.items()], default=0)


def period_score() -> Column:
    rsi = F.round("rsi", 2)
    s = (F.lit(50) + _points("ma_state", {"bull": 15, "bear": -15})
         + F.when(c("close") > c("ma20"), 5).otherwise(-5) + F.when(c("close") > c("ma60"), 5).otherwise(-5)
         + _points("macd_state", {"golden": 15, "expand": 8, "shrink": -5, "dead": -15})
         + F.when(c("dif") > 0, 5).otherwise(-5)
         + ladder((rsi.between(45, 70), 10), (rsi > 70, -5), (rsi < 30, 5), default=0)
         + _points("kdj_state", {"golden": 10, "oversold": 8, "overbought": -5, "dead": -10})
         + _points("boll_zone", {"upper": -5, "above_mid": 5, "below_mid": -3, "lower": 3})
         + F.when(c("obv_trend") == "up", 5).otherwise(-5))
    return F.greatest(F.lit(0), F.least(F.lit(100), s))


def composite_levels(scores: DataFrame) -> DataFrame:
    """(code, level, score) latest rows -> 0.30 month + 0.35 week + 0.35 day; a missing level counts 50."""
    w = {"month": 30, "week": 35, "day": 35}    # percent: whole numbers round exactly
    total = F.lit(0)
    for k, v in w.items():
        total = total + F.coalesce(F.max(F.when(c("level") == k, c("score"))), F.lit(50)) * v
    return scores.groupBy("code").agg((F.floor((total + 5) / 10) / 10).alias("composite")).withColumn("strength", ladder(
        (c("composite") >= 75, "strong"), (c("composite") >= 60, "firm"), (c("composite") >= 45, "neutral"),
        (c("composite") >= 30, "soft"), default="weak"))


def support_resistance(bars: DataFrame) -> DataFrame:
    """Per bar: highest candidate under 1.05 x close, lowest candidate above 0.95 x close."""
    up, mid, lo = bollinger()
    df = bars.select("code", "ts", "close", S.min("low", 20).alias("_l"), lo.alias("_b"), mid.alias("_m"),
                     S.max("high", 20).alias("_h"), up.alias("_u"))
    sup = F.array_max(F.filter(F.array("_l", "_b", "_m"), lambda x: x < c("close") * 1.05))
    res = F.array_min(F.filter(F.array("_h", "_u"), lambda x: x > c("close") * 0.95))
    return df.where(c("_l").isNotNull()).select("code", "ts", "close", sup.alias("support"), res.alias("resistance"))


# ---- minute analysis -----------------------------------------------------------------------------

def minute_frame(bars: DataFrame, lookback: int = 20) -> DataFrame:
    """Volume-price state, VWAP deviation, divergence, direction and 0..10 score per minute bar."""
    day = F.to_date("ts")
    df = gain_loss(base_columns(bars)).withColumn("day", day)
    df = macd_columns(with_recursions(df, rsi_recursion(6)))
    w = Window.partitionBy("code", "day").orderBy("ts")
    df = df.select(
        "*", wilder_rsi(6).alias("rsi"), roc(5).alias("roc"), S.lag("bar").alias("prev_bar"),
        ratio("volume", F.avg("volume").over(w.rowsBetween(-4, 0))).alias("vol_ratio"),
        F.coalesce(c("close") - F.lag("close").over(w), F.lit(0.0)).alias("chg"), vwap_day(c("day")).alias("vwap"))
    df = df.select("*", F.coalesce(macd_divergence(lookback), rsi_divergence(lookback)).alias("divergence"),
                   ((ratio("close", "vwap") - 1) * 100).alias("vwap_dev"))
    up, dn = c("chg") > 0, c("chg") < 0
    more, less = c("vol_ratio") > 1.1, c("vol_ratio") < 0.9
    df = df.withColumn("volume_price", ladder((up & more, "up_more"), (up & less, "up_less"), (dn & more, "down_more"),
                                              (dn & less, "down_less"), default="neutral"))
    df = df.withColumn("direction", direction_vote())
    return df.withColumn("score", minute_score())


def direction_vote() -> Column:
    bar, prev, rsi, roc_ = c("bar"), c("prev_bar"), c("rsi"), F.coalesce(c("roc"), F.lit(0.0))
    buy = (ladder(((bar > 0) & (bar > prev), 2), (bar > 0, 1), default=0) + F.when(c("dif") > 0, 1).otherwise(0)
           + ladder((rsi.between(40, 65), 1), (rsi < 35, 1), default=0)
           + _points("volume_price", {"up_more": 2, "down_less": 1}) + F.when(roc_ > 1, 1).otherwise(0))
    sell = (ladder((bar > 0, 0), ((bar < 0) & (bar < prev), 2), default=1) + F.when(c("dif") > 0, 0).otherwise(1)
            + F.when(rsi > 70, 2).otherwise(0) + _points("volume_price", {"down_more": 2, "up_less": 1})
            + F.when(roc_ < -1, 1).otherwise(0))
    return ladder((buy >= sell + 2, "buy"), (sell >= buy + 2, "sell"), default="neutral")


def minute_score() -> Column:
    rsi = c("rsi")
    s = (F.lit(5.0) + _points("direction", {"buy": 2, "sell": -2})
         + ladder((c("volume_price") == "up_more", 1.0), (c("volume_price") == "down_less", 0.5),
                  (c("volume_price") == "up_less", -0.5), (c("volume_price") == "down_more", -1.0), default=0.0)
         + F.when(c("bar") > 0, 0.5).otherwise(-0.5)
         + ladder((rsi.between(40, 65), 0.5), ((rsi > 75) | (rsi < 25), -0.5), default=0.0)
         + ladder((c("divergence").endswith("top"), -1.5), (c("divergence").endswith("bottom"), 1.0), default=0.0)
         + ladder((F.round("vwap_dev", 2) > 2, -0.5), (F.round("vwap_dev", 2) < -2, 0.3), default=0.0))
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(10.0), s)), 1)


# Weight of each minute level in the composite.
MINUTE_WEIGHTS = {"5min": 4.0, "15min": 2.0, "30min": 2.0, "60min": 0.67, "90min": 0.67, "120min": 0.67}


def composite_signal(levels: DataFrame) -> DataFrame:
    """(code, level, direction, score): weighted direction and score; a missing level is neutral with 5."""
    total = sum(MINUTE_WEIGHTS.values())
    w = ladder(*[(c("level") == k, v) for k, v in MINUTE_WEIGHTS.items()], default=0.0)
    val = ladder((c("direction") == "buy", 1), (c("direction") == "sell", -1), default=0)
    g = levels.groupBy("code").agg(F.sum(w * val).alias("_d"), F.sum(w * (c("score") - 5)).alias("_s"))
    d = c("_d") / total
    return g.select("code", ladder((d > 0.25, "buy"), (d < -0.25, "sell"), default="neutral").alias("signal"),
                    F.round(c("_s") / total + 5, 1).alias("strength"))


# ---- trend of a short series ---------------------------------------------------------------------

def series_trend(df: DataFrame, value: str, n: int) -> DataFrame:
    """Slope over mean of the last n rows and population deviation of the changes, per row."""
    d = df.select("code", "ts", value, S.idx().alias("_i"), (ratio(value, S.lag(value)) - 1).alias("_r"))
    w = S.trail(n)
    rel = ratio(F.regr_slope(value, "_i").over(w), F.avg(value).over(w))
    d = d.select("code", "ts", value, rel.alias("rel_slope"), F.coalesce(
        F.stddev_pop("_r").over(S.trail(n - 1)), F.lit(0.0)).alias("volatility"))
    return d.withColumn("trend", ladder((c("rel_slope") > 0.01, "increasing"), (c("rel_slope") < -0.01, "decreasing"),
                                        default="stable"))
