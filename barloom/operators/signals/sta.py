"""Statistical signals. Return windows begin with a zero return, as the labels are defined on it."""

from pyspark.sql import functions as F

from barloom.functions.windows import ratio
from barloom.operators.signals.base import S, bands, c, pick, signal


def _pstd_with_zero(n: int):
    """Population deviation of the last n returns (fewer early on) and one zero."""
    w = S.trail(n)
    k = F.count("r").over(w) + 1
    s1, s2 = F.sum("r").over(w), F.sum(c("r") * c("r")).over(w)
    return F.sqrt(F.greatest(s2 / k - (s1 / k) * (s1 / k), F.lit(0.0)))


def _z(n: int):
    return ratio(c("close") - S.mean("close", n), S.pstd("close", n))


@signal("sta_mean_revert", 21)
def mean_revert():
    return bands(_z(21), [(2, "超买"), (1, "偏多"), (-1, "中性"), (-2, "偏空")], "超卖")


@signal("sta_volatility", 22)
def volatility():
    return bands(ratio(_pstd_with_zero(20), _pstd_with_zero(60)),
                 [(1.5, "高波"), (1.2, "波率上升"), (0.8, "正常波率"), (0.5, "波率下降")], "低波")


@signal("sta_vol_ratio", 22)
def vol_ratio():
    return bands(ratio(S.pstd("r", 6), S.pstd("r", 21)), [(1.5, "波动扩大"), (1.0, "波动略增"), (0.7, "波动平稳")], "波动收窄")


@signal("sta_autocorr", 22, stages=[{"rr": lambda: c("r") * S.lag("r")}])
def autocorr():
    """Lag-1 correlation of (0, r1..r20)."""
    n = 20
    sy, syy = S.sum("r", n), S.sum(c("r") * c("r"), n)
    sx, sxx = S.sum("r", n - 1, skip=1), S.sum(c("r") * c("r"), n - 1, skip=1)
    sxy = S.sum("rr", n - 1)
    den = F.sqrt(F.greatest((n * sxx - sx * sx) * (n * syy - sy * sy), F.lit(0.0)))
    return bands(ratio(n * sxy - sx * sy, den), [(0.3, "正相关"), (0.1, "弱正相关"), (-0.1, "不相关"), (-0.3, "弱负相关")], "负相关")


def _moments(n: int):
    m = n + 1
    p1, p2, p3, p4 = (S.sum(F.pow(c("r"), F.lit(float(k))), n) / m for k in (1, 2, 3, 4))
    m2 = p2 - p1 * p1
    m3 = p3 - 3 * p1 * p2 + 2 * p1 * p1 * p1
    m4 = p4 - 4 * p1 * p3 + 6 * p1 * p1 * p2 - 3 * p1 * p1 * p1 * p1
    return m, m2, m3, m4


@signal("sta_skewness", 32)
def skewness():
    m, m2, m3, _ = _moments(30)
    x = ratio(m3, F.pow(m2, F.lit(1.5))) * ((m * (m - 1)) ** 0.5 / (m - 2))
    return bands(x, [(1, "右偏极强"), (0.5, "右偏"), (-0.5, "对称"), (-1, "左偏")], "左偏极强")


@signal("sta_kurtosis", 32)
def kurtosis():
    m, m2, _, m4 = _moments(30)
    x = ((ratio(m4, m2 * m2) - 3) * (m + 1) + 6) * ((m - 1) / ((m - 2) * (m - 3)))
    return bands(x, [(5, "尖峰厚尾"), (2, "轻厚尾"), (-1, "近似正态")], "平坦薄尾")


@signal("sta_hurst", 101, rec=[("hurst", "hurst", 100)])
def hurst():
    return bands(c("hurst"), [(0.6, "趋势持续"), (0.5, "弱趋势"), (0.4, "随机游走")], "均值回归")


@signal("sta_z_score", 21)
def z_score():
    return bands(_z(20), [(2, "Z>2"), (1, "Z>1"), (0, "0<Z<1"), (-1, "-1<Z<0"), (-2, "Z<-1")], "Z<-2")


@signal("sta_percentile", 61, stages=[{"w60": lambda: F.collect_list("close").over(S.trail(60))}])
def percentile():
    x = F.size(F.filter(c("w60"), lambda v: v < c("close"))) / F.lit(60.0) * 100
    return bands(x, [(90, "极高百分位"), (70, "高百分位"), (30, "中百分位"), (10, "低百分位")], "极低百分位")


@signal("sta_regime", 62)
def regime():
    w = S.trail(60)
    trend = F.abs(ratio(F.regr_slope("close", "i").over(w), F.avg("close").over(w)) * 100)
    vol = _pstd_with_zero(59) * 100
    return pick(((trend > 2) & (vol < 2), "低波趋势"), (trend > 2, "高波趋势"), (vol < 1.5, "低波盘整"), default="高波盘整")


@signal("sta_consecutive", 11, stages=[
    {"sg": lambda: F.signum("d")},
    {"turn": lambda: F.when(~c("sg").eqNullSafe(S.lag("sg")), c("i"))},
    {"start": lambda: F.max("turn").over(S.run())}])
def consecutive():
    """Length of the running streak."""
    n = (c("i") - c("start") + 1).cast("string")
    return pick((c("sg") > 0, F.concat(F.lit("连涨"), n)), (c("sg") < 0, F.concat(F.lit("连跌"), n)), default="无连续")


@signal("sta_momentum_roc", 14)
def momentum_roc():
    return bands((ratio("close", S.lag("close", 12)) - 1) * 100, [(10, "强多"), (3, "偏多"), (-3, "中性"), (-10, "偏空")], "强空")
