"""Position signals."""

from pyspark.sql import functions as F

from barloom.functions.recursive import span
from barloom.functions.windows import ratio
from barloom.operators import indicators as I
from barloom.operators.signals.base import S, bands, c, cross, pick, signal

E20 = [("e20", "ema", "close", span(20))]


@signal("pos_above_ma", 21, rec=E20)
def above_ma():
    return bands((ratio("close", "e20") - 1) * 100,
                 [(5, "远高于"), (2, "偏高于"), (0, "略高于"), (-2, "略低于"), (-5, "偏低于")], "远低于")


@signal("pos_ma_cross", 62)
def ma_cross():
    return cross(c("close"), S.mean("close", 60), c("pc"), S.mean("close", 60, skip=1), ("上穿", "下穿", "均线上方", "均线下方"))


@signal("pos_support_resistance", 31)
def support_resistance():
    hi, lo = S.max("high", 29, skip=1), S.min("low", 29, skip=1)
    p = ratio(c("close") - lo, hi - lo)
    return pick((p > 0.9, "接近阻力"), (p < 0.1, "接近支撑"), (p > 0.5, "中上区间"), (p.isNotNull(), "中下区间"))


@signal("pos_high_low", 61)
def high_low():
    hi, lo = S.max("high", 59, skip=1), S.min("low", 59, skip=1)
    return pick((c("close") > hi, "创新高"), (c("close") < lo, "创新低"), (c("close") > (hi + lo) / 2, "前高附近"), default="前低附近")


@signal("pos_gap_fill", 31, stages=[
    {"gk": lambda: F.when(c("low") > c("ph"), "up").when(c("high") < c("pl"), "down"),
     "gl": lambda: F.when(c("low") > c("ph"), c("low")).when(c("high") < c("pl"), c("pl"))}])
def gap_fill():
    """The latest gap of the last 30 bars: has the close come back through its edge?"""
    kind = F.last("gk", ignorenulls=True).over(S.trail(29))
    edge = F.last("gl", ignorenulls=True).over(S.trail(29))
    up, dn = kind == "up", kind == "down"
    return pick((up & (c("close") < edge), "向上缺口已补"), (up, "向上缺口未补"), (dn & (c("close") > edge), "向下缺口已补"), (dn, "向下缺口未补"))


@signal("pos_trend_line", 21)
def trend_line():
    w = S.trail(20)
    line = F.avg("low").over(w) + F.regr_slope("low", "i").over(w) * 9.5
    return bands(ratio(c("close") - line, F.abs(line)) * 100, [(3, "远高于趋势线"), (0, "趋势线上方"), (-3, "趋势线下方")], "远低于趋势线")


@signal("pos_fibonacci", 61, stages=[{"fib": lambda: I.fibonacci(60)}])
def fibonacci():
    """Nearest level; the higher price wins a tie."""
    dist = F.transform(c("fib"), lambda x: F.abs(c("close") - x))
    at = F.array_position(dist, F.array_min(dist)).cast("int")
    return F.element_at(F.array(*[F.lit(f"{f:.3f}") for f in I.FIB]), at)


@signal("pos_pivot", 3)
def pivot():
    p = I.pivot_points()
    return pick(*[(c("close") > p[k], v) for k, v in (("r2", "R2上方"), ("r1", "R1上方"), ("p", "枢轴上方"), ("s1", "枢轴下方"),
                                                      ("s2", "S1下方"))], default="S2下方")


@signal("pos_channel_position", 21)
def channel_position():
    w = S.trail(21)
    slope = F.regr_slope("close", "i").over(w)
    mid = F.avg("close").over(w) + slope * 10
    var = F.var_pop("close").over(w) - slope * slope * F.var_pop("i").over(w)
    sd = F.sqrt(F.greatest(var, F.lit(0.0)))
    p = ratio(c("close") - (mid - sd * 2), sd * 4)
    return pick((p > 1, "通道上方"), (p > 0.8, "上轨附近"), (p < 0, "通道下方"), (p < 0.2, "下轨附近"), (p.isNotNull(), "通道中部"))


@signal("pos_price_zone", 61)
def price_zone():
    lo, hi = S.min("close", 60), S.max("close", 60)
    return bands(ratio(c("close") - lo, hi - lo), [(0.9, "高位区"), (0.7, "偏高区"), (0.3, "中间区"), (0.1, "偏低区")], "低位区")


@signal("pos_ma_band", 21, rec=[("e5", "ema", "close", span(5)), *E20])
def ma_band():
    return pick((c("close") > F.greatest("e5", "e20"), "均线上方"), (c("close") < F.least("e5", "e20"), "均线下方"), default="均线之间")


@signal("pos_round_number", 2)
def round_number():
    """Distance to the nearest multiple of a tenth of the price's magnitude."""
    x = F.when(c("close") > 0, c("close"))
    base = F.greatest(F.pow(F.lit(10.0), F.log10(x).cast("int")), F.lit(1.0)) / 10
    near = F.rint(x / base) * base
    dist = F.abs(x - near) / x * 100
    tag = lambda p: F.concat(F.lit(p), near.cast("bigint").cast("string"), F.lit("关口"))
    return pick((dist < 0.5, tag("接近")), (dist < 2, tag("临近")), (x.isNotNull(), "远离关口"))


def _bin(x):
    return F.least(F.floor((x - c("vlo")) / (c("vhi") - c("vlo")) * 5), F.lit(4))


@signal("pos_volume_profile", 31, stages=[
    {"vp": lambda: F.collect_list(F.struct("close", "volume")).over(S.trail(30)), "vlo": lambda: S.min("close", 30),
     "vhi": lambda: S.max("close", 30)}])
def volume_profile():
    """Volume in the price fifth of the last close against the fullest fifth."""
    def at(b):
        return F.aggregate(F.filter(c("vp"), lambda s: _bin(s["close"]) == b), F.lit(0.0), lambda a, s: a + s["volume"])

    x = ratio(at(_bin(c("close"))), F.greatest(*[at(F.lit(b)) for b in range(5)]))
    return F.when(c("vhi") > c("vlo"), bands(x, [(0.8, "高量区"), (0.5, "中量区")], "低量区"))


@signal("pos_boll_position", 21)
def boll_position():
    up, _, lo = I.bollinger(20, 2.0, loose=False)
    return bands(ratio(c("close") - lo, up - lo),
                 [(1, "上轨上方"), (0.8, "上轨附近"), (0.5, "中轨上方"), (0.2, "中轨下方"), (0, "下轨附近")], "下轨下方")


@signal("pos_kelt_position", 22, rec=E20)
def kelt_position():
    a = I.atr(10, loose=False) * 1.5
    return pick((c("close") > c("e20") + a, "通道上方"), (c("close") > c("e20"), "中轨上方"), (c("close") > c("e20") - a, "中轨下方"),
                default="通道下方")
