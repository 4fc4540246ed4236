"""Options and futures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.solvers import norm_pdf, option_price, with_cdfs
from barloom.functions.windows import Series, clamp, ladder, ratio

c = F.col
DAY60 = 60 / 365


# ---- pricing -------------------------------------------------------------------------------------

def with_greeks(chain: DataFrame, r: float = 0.02, q: float = 0.0) -> DataFrame:
    """(spot, strike, t, sigma, call) -> delta, gamma, theta/day, vega/1 %, rho/1 %; zero at expiry."""
    s, k, t, v, call = c("spot"), c("strike"), c("t"), c("sigma"), c("call")
    pdf, n1, n2 = norm_pdf(c("_d1")), c("_n1"), c("_n2")
    eq, er = F.exp(t * -q), F.exp(t * -r)
    sign = F.when(call, 1.0).otherwise(-1.0)
    d = with_cdfs(chain, r, q, t > 1e-6)
    cols = {
        "delta": eq * n1 * sign,
        "gamma": eq * pdf / (s * v * F.sqrt(t)),
        "theta": (-s * eq * pdf * v / (F.sqrt(t) * 2) - sign * k * er * n2 * r + sign * s * eq * n1 * q) / 365,
        "vega": s * eq * pdf * F.sqrt(t) / 100,
        "rho": sign * k * t * er * n2 / 100}
    return d.select(*chain.columns, *[F.when(t <= 1e-6, 0.0).otherwise(x).alias(n) for n, x in cols.items()])


def parity_screen(chain: DataFrame, keys: Sequence[str], r: float = 0.02, q: float = 0.0, tolerance: float = 0.01) -> DataFrame:
    """|C - P - (S e^-qT - K e^-rT)| against 1 % of spot. Calls and puts meet in one aggregate, not a self join."""
    g = chain.groupBy(*keys, "strike", "t").agg(F.max("spot").alias("spot"), F.max(F.when(c("call"), c("price"))).alias("cp"),
                                                F.max(F.when(~c("call"), c("price"))).alias("pp"))
    gap = F.abs(c("cp") - c("pp") - (c("spot") * F.exp(c("t") * -q) - c("strike") * F.exp(c("t") * -r)))
    return g.where(c("cp").isNotNull() & c("pp").isNotNull()).withColumn("gap", gap).withColumn("holds", c("gap") < c("spot") * tolerance)


# ---- chain metrics -------------------------------------------------------------------------------

def put_call_ratios(rows: DataFrame, keys: Sequence[str] = ("symbol", "date")) -> DataFrame:
    side = lambda x, call: F.sum(F.when(c("call") == call, c(x)).otherwise(0.0))
    return rows.groupBy(*keys).agg(side("vol", True).alias("call_vol"), side("vol", False).alias("put_vol"),
                                   ratio(side("vol", False), side("vol", True)).alias("pcr_vol"),
                                   ratio(side("oi", False), side("oi", True)).alias("pcr_oi"))


def iv_metrics(rows: DataFrame, keys: Sequence[str] = ("symbol", "date")) -> DataFrame:
    """(strike, spot, t, iv, vol, call) -> ATM iv, volume-weighted iv, OTM slopes, risk reversal, ATM put-call gap.

    One aggregate: every piece is a conditional measure with map-side partials.
    """
    m = c("strike") / c("spot")
    d = rows.where(c("iv").isNotNull()).select("*", m.alias("_m"), F.abs(m - 1).alias("_d"), (c("t") <= DAY60).alias("_near"))
    put_otm, call_otm = c("_near") & (c("_m") < 1), c("_near") & (c("_m") > 1)

    def slope(cond):
        x, y = F.when(cond, c("strike")), F.when(cond, c("iv"))
        return F.when(F.count(x) >= 3, F.regr_slope(y, x) * 1000)

    atm = c("_near") & (c("_d") < 0.05)
    gap = F.avg(F.when(atm & ~c("call"), c("iv"))) - F.avg(F.when(atm & c("call"), c("iv")))
    return d.groupBy(*keys).agg(
        (F.min_by(F.when(c("_near"), c("iv")), F.when(c("_near"), F.struct("_d", "call", "iv"))) * 100).alias("atm_iv"),
        (ratio(F.sum(c("iv") * c("vol")), F.sum("vol")) * 100).alias("weighted_iv"), slope(put_otm).alias("slope_put"), slope(call_otm).alias("slope_call"),
        ((F.avg(F.when(put_otm & ~c("call"), c("iv"))) - F.avg(F.when(call_otm & c("call"), c("iv")))) * 100).alias("risk_reversal"),
        (gap * 100).alias("atm_gap"))


def weekly_option_metrics(daily: DataFrame, metrics: Sequence[str], bucket: Column) -> DataFrame:
    """Means per bucket (week) with the last day's values beside them."""
    return daily.groupBy("symbol", bucket.alias("bucket")).agg(
        *[F.avg(x).alias(f"{x}_mean") for x in metrics], *[F.max_by(x, "date").alias(f"{x}_last") for x in metrics], F.count(F.lit(1)).alias("days"))


# ---- volatility ----------------------------------------------------------------------------------

def iv_against_rv(df: DataFrame, windows: Sequence[str], threshold: float = 0.03) -> DataFrame:
    """(keys..., iv, one realised column per window) -> spread, premium and label per window, vote per row."""
    keys = [x for x in df.columns if x not in windows and x != "iv"]
    long = df.unpivot([*keys, "iv"], list(windows), "horizon", "rv").where(c("rv").isNotNull())
    d = long.withColumn("spread", c("iv") - c("rv")).withColumn("premium_pct", F.when(c("rv") > 0, c("spread") / c("rv") * 100).otherwise(0.0))
    d = d.withColumn("label", ladder((c("spread") > threshold, "rich"), (c("spread") < -threshold, "cheap"), default="fair"))
    vote = F.sum(F.when(c("label") == "rich", 1).when(c("label") == "cheap", -1).otherwise(0)).over(Window.partitionBy(*keys))
    return d.withColumn("overall", ladder((vote > 0, "rich"), (vote < 0, "cheap"), default="fair"))


def surface_summary(rows: DataFrame) -> DataFrame:
    """(symbol, tenor, atm_vol, rr) -> skew per tenor; slope from the shortest to the longest tenor."""
    w = Window.partitionBy("symbol")
    slope = F.max_by("atm_vol", "tenor").over(w) - F.min_by("atm_vol", "tenor").over(w)
    n = F.count(F.lit(1)).over(w)
    return rows.select("*", F.when(c("rr") > 0, "call_skew").otherwise("put_skew").alias("skew"),
                       ladder((n < 2, "n/a"), (slope > 0, "contango"), default="backwardation").alias("term_structure"),
                       F.min("atm_vol").over(w).alias("atm_min"), F.max("atm_vol").over(w).alias("atm_max"))


def vol_regime(iv: DataFrame, window: int = 252) -> DataFrame:
    """IV rank and strict percentile over the trailing window; bands of 20 and 80."""
    s = Series(("symbol",), ("date",))
    lo, hi = s.min("iv", window, min_periods=1), s.max("iv", window, min_periods=1)
    hist = F.collect_list("iv").over(s.trail(window))
    d = iv.select("*", (ratio(c("iv") - lo, hi - lo) * 100).alias("iv_rank"), hist.alias("_h"))
    pct = F.when(F.size("_h") > 10, F.size(F.filter("_h", lambda x: x < c("iv"))) / F.size("_h") * 100)
    return d.withColumn("iv_percentile", pct).drop("_h").withColumn("regime", F.when(c("iv_rank").isNotNull(), ladder(
        (c("iv_rank") < 20, "low"), (c("iv_rank") < 80, "normal"), default="high")))


# ---- payoff --------------------------------------------------------------------------------------

def spot_grid(strategies: DataFrame, points: int = 101, lo: float = 0.5, hi: float = 1.5) -> DataFrame:
    """(strategy, spot0, legs) -> one row per grid spot; the grid is expanded per row."""
    step = (hi - lo) / (points - 1)
    return strategies.select("*", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("i")).withColumn(
        "spot", c("spot0") * (c("i") * step + lo))


def _legs(value) -> Column:
    return F.aggregate("legs", F.lit(0.0), lambda a, leg: a + leg["direction"] * leg["qty"] * (value(leg) - leg["premium"]))


def expiry_payoff(grid: DataFrame) -> DataFrame:
    """Intrinsic value of every leg less its premium, summed over the legs (a handful per strategy)."""
    intrinsic = lambda g: F.greatest(F.when(g["call"], c("spot") - g["strike"]).otherwise(g["strike"] - c("spot")), F.lit(0.0))
    return grid.withColumn("pnl", _legs(intrinsic))


def theoretical_value(grid: DataFrame, r: float = 0.02, sigma: Column | None = None) -> DataFrame:
    def value(g):
        return option_price(c("spot"), g["strike"], g["t"], r, g["sigma"] if sigma is None else sigma, g["call"])
    return grid.withColumn("value", _legs(value))


def vol_scenarios(grid: DataFrame, multipliers: Sequence[float] = (0.5, 0.75, 1.0, 1.25, 1.5), r: float = 0.02) -> DataFrame:
    g = grid.select("*", F.explode(F.array(*[F.lit(x) for x in multipliers])).alias("multiplier"))

    def value(leg):
        return option_price(c("spot"), leg["strike"], leg["t"], r, leg["sigma"] * c("multiplier"), leg["call"])
    return g.withColumn("value", _legs(value))


def _path():
    return Window.partitionBy("strategy").orderBy("i")


def break_evens(payoff: DataFrame) -> DataFrame:
    """Exact zeros and linearly interpolated sign changes, rounded to cents."""
    p, s = F.lag("pnl").over(_path()), F.lag("spot").over(_path())
    cut = F.when(c("pnl") == 0, c("spot")).when((p * c("pnl") < 0), s + (c("spot") - s) * p / (p - c("pnl")))
    return payoff.select("strategy", F.floor(cut * 100 + 0.5).alias("_c")).where(c("_c").isNotNull()).distinct().select(
        "strategy", (c("_c") / 100).alias("break_even"))


def profit_ranges(payoff: DataFrame) -> DataFrame:
    """Intervals of profit and of loss along the grid (islands of equal sign)."""
    d = payoff.select("strategy", "i", "spot", "pnl", F.signum("pnl").alias("sg"))
    d = d.withColumn("_new", F.when(c("sg") != F.lag("sg").over(_path()), 1).otherwise(0))
    d = d.withColumn("island", F.sum("_new").over(_path().rowsBetween(Window.unboundedPreceding, 0)))
    return d.where("sg <> 0").groupBy("strategy", "island", "sg").agg(F.min("spot").alias("from_spot"), F.max("spot").alias("to_spot"), F.max(F.abs("pnl")).alias("peak"))


def max_profit_loss(payoff: DataFrame) -> DataFrame:
    """Extremes on the grid; unlimited by the sign of the net calls."""
    net = F.aggregate("legs", F.lit(0.0), lambda a, g: a + F.when(g["call"], g["direction"] * g["qty"]).otherwise(0.0))
    g = payoff.select("strategy", "pnl", net.alias("_n")).groupBy("strategy").agg(F.max("pnl").alias("max_profit"), F.min("pnl").alias("max_loss"), F.max("_n").alias("_n"))
    return g.select("strategy", "max_profit", "max_loss", (c("_n") > 0).alias("profit_unlimited"), (c("_n") < 0).alias("loss_unlimited"))


# ---- futures -------------------------------------------------------------------------------------

FS = Series(("symbol",), ("date",))


def price_state(fut: DataFrame) -> DataFrame:
    """MA alignment, 20-bar range, amplitude, open-interest and volume state per bar."""
    ma = {n: F.when(FS.idx() >= n, FS.mean("close", n)).otherwise(c("close")) for n in (5, 10, 20)}
    d = fut.select("*", *[v.alias(f"ma{n}") for n, v in ma.items()], FS.max("high", 20, min_periods=1).alias("high20"), FS.min("low", 20, min_periods=1).alias("low20"),
                   (FS.mean(ratio(c("high") - c("low"), "close"), 10, min_periods=1) * 100).alias("amplitude10"), (c("oi") - FS.lag("oi")).alias("oi_chg"),
                   F.when(FS.idx() >= 5, FS.mean("vol", 5)).otherwise(c("vol")).alias("vol5"), ((ratio("close", FS.lag("close")) - 1) * 100).alias("pct_chg"))
    return d.select("*", ladder(
        ((c("close") > c("ma5")) & (c("ma5") > c("ma10")) & (c("ma10") > c("ma20")), "bull"), ((c("close") < c("ma5")) & (c("ma5") < c("ma10")) & (c("ma10") < c("ma20")), "bear"),
        (c("close") > c("ma5"), "leaning_bull"), default="leaning_bear").alias("trend"),
        ladder((c("oi_chg") > 0, "adding"), (c("oi_chg") < 0, "cutting"), default="flat").alias("oi_trend"),
        ladder((c("vol") > c("vol5") * 1.2, "heavy"), (c("vol") < c("vol5") * 0.8, "light"), default="normal").alias("vol_state"))


def basis(fut: DataFrame, spot: DataFrame) -> DataFrame:
    """Future less spot on common dates, rate, label at 0.5 % and 5-row mean rate."""
    j = fut.select("symbol", "date", c("close").alias("fut")).join(spot.select("symbol", "date", c("close").alias("spot")), ["symbol", "date"]).where("spot <> 0")
    j = j.withColumn("basis", c("fut") - c("spot")).withColumn("basis_rate", c("basis") / c("spot") * 100)
    return j.select("*", FS.mean("basis_rate", 5, min_periods=1).alias("basis_rate5"),
                    ladder((c("basis_rate") > 0.5, "premium"), (c("basis_rate") < -0.5, "discount"), default="normal").alias("basis_signal"))


def broker_positions(hold: DataFrame, n: int = 10) -> DataFrame:
    """Per (symbol, date): totals, net share, concentration of the n largest on each side."""
    both = hold.select("symbol", "date", F.inline(F.array(
        F.struct(F.lit("long").alias("side"), c("long_hld").alias("qty")), F.struct(F.lit("short").alias("side"), c("short_hld").alias("qty")))), "broker")
    w = Window.partitionBy("symbol", "date", "side").orderBy(F.desc("qty"), "broker")
    top = both.withColumn("_r", F.row_number().over(w)).where(c("_r") <= n).groupBy("symbol", "date").agg(
        *[F.sum(F.when(c("side") == s, c("qty")).otherwise(0.0)).alias(f"top_{s}") for s in ("long", "short")])
    tot = hold.groupBy("symbol", "date").agg(F.sum("long_hld").alias("long_total"), F.sum("short_hld").alias("short_total"))
    net = (c("long_total") - c("short_total")) / (c("long_total") + c("short_total")) * 100
    return tot.join(top, ["symbol", "date"]).withColumn("net_pct", F.when(c("long_total") + c("short_total") > 0, net)).withColumn(
        "signal", ladder((c("net_pct") > 5, "bullish"), (c("net_pct") < -5, "bearish"), default="neutral"))


def named_broker(hold: DataFrame, broker) -> DataFrame:
    """Net of one broker against all others: snapshot, change, 5-row sums of change, agreement."""
    mine = c("broker") == broker
    net = c("long_hld") - c("short_hld")
    g = hold.groupBy("symbol", "date").agg(F.sum(F.when(mine, net).otherwise(0.0)).alias("named_net"), F.sum(F.when(mine, 0.0).otherwise(net)).alias("others_net"))
    g = g.select("*", (c("named_net") - FS.lag("named_net")).alias("named_chg"), (c("others_net") - FS.lag("others_net")).alias("others_chg"))
    a, b = FS.sum("named_chg", 5, min_periods=1), FS.sum("others_chg", 5, min_periods=1)
    return g.select("*", a.alias("named_chg5"), b.alias("others_chg5"), ladder(
        ((a > 0) & (b > 0), "both_bullish"), ((a < 0) & (b < 0), "both_bearish"), ((a > 0) & (b < 0), "named_bullish"), ((a < 0) & (b > 0), "named_bearish"),
        default="flat").alias("agreement"))


def futures_score(d: DataFrame) -> DataFrame:
    """(trend, pct_chg, basis_signal, signal, agreement) -> 0..100."""
    s = (F.lit(50) + ladder((c("trend") == "bull", 15), (c("trend") == "bear", -15), default=0) + ladder((c("pct_chg") > 0, 5), (c("pct_chg") < 0, -5), default=0)
         + ladder((c("basis_signal") == "premium", 10), (c("basis_signal") == "discount", -10), default=0)
         + ladder((c("signal") == "bullish", 10), (c("signal") == "bearish", -10), default=0)
         + ladder((c("named_chg5") > 0, 5), (c("named_chg5") < 0, -5), default=0))
    return d.withColumn("score", F.greatest(F.lit(0), F.least(F.lit(100), s)))


# ---- option-futures linkage ----------------------------------------------------------------------

def linkage_rules(d: DataFrame) -> DataFrame:
    """Five cross rules per (symbol, date), one row per rule."""
    full_bull, full_bear = c("trend") == "bull", c("trend") == "bear"
    pcr_bear, pcr_bull = c("pcr_vol") > 1.2, c("pcr_vol") < 0.8
    hi_iv, lo_iv = c("weighted_iv").isNull() | (c("weighted_iv") > 30), c("weighted_iv") < 18
    pct = F.coalesce("pct_chg", F.lit(0.0))
    rr_put, rr_call = c("risk_reversal") > 0.5, c("risk_reversal") < -0.5
    prem, disc = c("basis_signal") == "premium", c("basis_signal") == "discount"
    adding = F.coalesce("oi_chg", F.lit(0.0)) > 0
    rules = {
        "pcr_trend": ladder((pcr_bear & full_bear, -2), (pcr_bull & full_bull, 2), default=0),
        "iv_move": ladder((hi_iv & (pct < -1), -1), (hi_iv & (pct > 1), 0), (lo_iv & full_bull, 1), default=0),
        "skew_basis": ladder((rr_put & disc, -2), (rr_call & prem, 2), default=0),
        "atm_gap_oi": ladder(((c("atm_gap") > 1.5) & adding, -1), ((c("atm_gap") < -1.5) & adding, 1), default=0),
        "oi_pcr_basis": ladder(((c("pcr_oi") > 1.0) & disc, -1), ((c("pcr_oi") < 0.7) & prem, 1), default=0)}
    return d.select("*", F.inline(F.array(*[F.struct(F.lit(k).alias("rule"), v.alias("points")) for k, v in rules.items()])))


def linkage_score(rules: DataFrame) -> DataFrame:
    """Direction per symbol and the 0..100 linkage score; spread across the symbols of a date."""
    keep = ["symbol", "date", "pcr_vol", "risk_reversal", "weighted_iv", "trend", "basis_signal"]
    g = rules.groupBy(*keep).agg(F.sum("points").alias("points"))
    s = (F.lit(50.0) + ladder((c("pcr_vol") < 0.8, 8), (c("pcr_vol") > 1.2, -8), default=0) + ladder((c("risk_reversal") < -0.5, 6), (c("risk_reversal") > 0.5, -6), default=0)
         + F.when(c("weighted_iv") > 30, -6).otherwise(0) + ladder((c("trend") == "bull", 10), (c("trend") == "bear", -10), default=0)
         + ladder((c("basis_signal") == "premium", 5), (c("basis_signal") == "discount", -5), default=0) + c("points") * 2.5)
    g = g.withColumn("score", clamp(F.rint(s), 0.0, 100.0)).withColumn("direction", ladder(
        (c("points") <= -3, "bearish"), (c("points") >= 3, "bullish"), (c("points") <= -1, "slightly_bearish"), (c("points") >= 1, "slightly_bullish"), default="neutral"))
    spread = g.groupBy("date").agg((F.max("score") - F.min("score")).alias("divergence"))
    return g.join(spread, "date").withColumn("divergence_level", ladder((c("divergence") > 25, "high"), (c("divergence") > 10, "medium"), default="low"))
