"""Volume signals."""

from pyspark.sql import functions as F

from barloom.functions.windows import ratio
from barloom.operators.signals.base import S, bands, c, cross, pick, signal

V = "volume"
DV = {"dv": lambda: c("volume") - c("pv")}


@signal("vol_single_ma", 21)
def single_ma():
    return bands(ratio(V, S.mean(V, 20)), [(2, "巨量"), (1.5, "放量"), (0.8, "正常"), (0.5, "缩量")], "地量")


@signal("vol_double_ma", 22)
def double_ma():
    return cross(S.mean(V, 5), S.mean(V, 20), S.mean(V, 5, skip=1), S.mean(V, 20, skip=1))


@signal("vol_ti_suo", 6, stages=[DV])
def ti_suo():
    return pick((S.min("dv", 4) > 0, "递增"), (S.max("dv", 4) < 0, "递减"), default="无序")


def _gao_di():
    """Longest matching look-back of 10..6 bars: highest bar, halved after the highest, lowest bar."""
    steps = []
    for n in (10, 9, 8, 7, 6):
        hi, lo, have = S.max(V, n), S.min(V, n), c("i") >= n
        for cond, label in ((c(V) == hi, "高量柱"), ((c("pv") == hi) & (c(V) < c("pv") * 0.5), "高量黄金柱"), (c(V) == lo, "低量柱")):
            steps.append((have & cond, label, f"{n}K"))
    return steps


@signal("vol_gao_di", 7)
def gao_di():
    steps = _gao_di()
    return pick(*[(x, a) for x, a, _ in steps]), pick(*[(x, b) for x, _, b in steps], default="任意")


@signal("vol_window", 31, stages=[
    {"vq": lambda: F.percentile(V, F.array(*[F.lit(k / 10) for k in range(11)])).over(S.trail(30)),
     "vmax": lambda: S.max(V, 5), "vmin": lambda: S.min(V, 5)},
    {"vqd": lambda: F.array_distinct("vq")}])
def window():
    """Decile layer (of 30 bars) of the largest and smallest of the last five volumes."""
    layer = lambda x: F.greatest(F.size(F.filter(c("vqd"), lambda e: e < c(x))), F.lit(1)).cast("string")
    ok = F.size("vqd") > 1
    return F.when(ok, F.concat(F.lit("高量N"), layer("vmax"))), F.when(ok, F.concat(F.lit("低量N"), layer("vmin")))


@signal("vol_window_v2", 6, stages=[{"v5": lambda: F.collect_list(V).over(S.trail(5))}])
def window_v2():
    a = c("v5")
    return pick((F.array_position(a, F.array_min(a)) > F.array_position(a, F.array_max(a)), "先放后缩"), default="先缩后放")


@signal("vol_break", 21)
def break_():
    x = ratio(V, S.mean(V, 19, skip=1))
    return pick((x >= 2.0, "放量突破"), (x.isNotNull(), "未突破"))


@signal("vol_shrink", 6)
def shrink():
    n = S.sum(F.when(c(V) < c("pv") * 0.5, 1).otherwise(0), 4)
    return pick((n >= 4, "持续缩量"), (n >= 2, "部分缩量"))


@signal("vol_ratio_signal", 6)
def ratio_signal():
    return bands(ratio(V, S.mean(V, 4, skip=1)), [(3, "巨量"), (2, "大量"), (1, "放量"), (0.7, "正常"), (0.3, "缩量")], "地量")


@signal("vol_price_divergence", 21)
def price_divergence():
    high = S.max("close", 10) > S.max("close", 10, skip=10)
    low = S.min("close", 10) < S.min("close", 10, skip=10)
    vhigh = S.max(V, 10) > S.max(V, 10, skip=10)
    vlow = S.min(V, 10) < S.min(V, 10, skip=10)
    return pick((high & ~vhigh, "量价顶背离"), (low & ~vlow, "量价底背离"), default="量价配合")


@signal("vol_vwap", 2)
def vwap():
    x = (ratio("close", ratio(S.sum(c("tp") * c(V), 1), S.sum(V, 1))) - 1) * 100
    return bands(x, [(2, "VWAP上方"), (0, "VWAP略上方"), (-2, "VWAP略下方")], "VWAP下方")


@signal("vol_pvt_signal", 22, stages=[{"pvts": lambda: F.coalesce(c("d") / (c("pc") + 1e-10) * c(V), F.lit(0.0))},
                                      {"pvt": lambda: F.sum("pvts").over(S.run())}])
def pvt_signal():
    return pick((c("pvt") > S.mean("pvt", 20), "多头"), default="空头")


@signal("vol_mfi_signal", 16, stages=[{"ptp": lambda: S.lag("tp")},
                                      {"pmf": lambda: F.when(c("tp") > c("ptp"), c("tp") * c(V)).otherwise(0.0),
                                       "nmf": lambda: F.when(c("tp") <= c("ptp"), c("tp") * c(V)).otherwise(0.0)}])
def mfi_signal():
    x = 100 - 100 / (1 + S.sum("pmf", 14) / (S.sum("nmf", 14) + 1e-10))
    return bands(x, [(80, "超买"), (60, "偏多"), (40, "中性"), (20, "偏空")], "超卖")


@signal("vol_volatility_ratio", 21)
def volatility_ratio():
    return bands(ratio(S.std(V, 20), S.mean(V, 20)), [(0.8, "量极不稳定"), (0.5, "量波动较大"), (0.3, "量波动正常")], "量波动较小")


@signal("vol_adi_signal", 22, stages=[
    {"adis": lambda: ((c("close") - c("low")) - (c("high") - c("close"))) / (c("high") - c("low") + 1e-10) * c(V)},
    {"adi": lambda: F.sum("adis").over(S.run())}])
def adi_signal():
    return pick((c("adi") > S.mean("adi", 20), "资金流入"), default="资金流出")
