"""Raw-bar signals."""

from pyspark.sql import functions as F

from barloom.functions.windows import ratio
from barloom.operators.signals.base import NONE, S, bands, c, pick, signal

UP = lambda: c("close") > c("open")
BODY = lambda: F.abs(c("close") - c("open"))
PCT = lambda: (ratio("close", "open") - 1) * 100
MONEY = lambda: c("close") * c("volume")


@signal("bar_single_trend", 101, stages=[
    {"bst": lambda: F.when(c("volume") > 0, ratio(ratio("close", "open") - 1, "volume"))},
    {"bstq": lambda: F.percentile("bst", F.array(*[F.lit(k / 5) for k in range(6)])).over(S.trail(100)),
     "bstn": lambda: F.count("bst").over(S.trail(100)),
     "bstl": lambda: F.last("bst", ignorenulls=True).over(S.trail(100))}])
def single_trend():
    """Quintile of the last bar's volume-scaled gain among 100 bars; tied edges give no label."""
    layer = F.size(F.filter(F.slice(c("bstq"), 2, 4), lambda e: e < c("bstl"))) + 1
    ok = (c("bstn") >= 50) & (F.size(F.array_distinct(c("bstq"))) == 6)
    return F.when(ok, F.concat(F.lit("第"), layer.cast("string"), F.lit("层")))


@signal("bar_triple_accelerate", 8)
def triple_accelerate():
    up3, dn3 = S.min(UP().cast("int"), 3) == 1, S.min((c("close") < c("open")).cast("int"), 3) == 1
    h1, h2, l1, l2, v1, v2 = c("ph"), S.lag("high", 2), c("pl"), S.lag("low", 2), c("pv"), S.lag("volume", 2)
    newhigh = (c("high") > h1) & (h1 > h2) & (c("low") > l1) & (l1 > l2)
    newlow = (c("high") < h1) & (h1 < h2) & (c("low") < l1) & (l1 < l2)
    v = pick((up3 & newhigh, "新高涨"), (up3, "三连涨"), (dn3 & newlow, "新低跌"), (dn3, "三连跌"))
    vol = pick(((c("volume") > v1) & (v1 > v2), "依次放量"), ((c("volume") < v1) & (v1 < v2), "依次缩量"), default="量柱无序")
    return v, F.when(up3 | dn3, vol)


@signal("bar_accelerate", 5, stages=[{"body": BODY}, {"dbody": lambda: c("body") - S.lag("body")}])
def accelerate():
    grow = S.min("dbody", 4) > 0
    return pick((grow & UP(), "加速上涨"), (grow, "加速下跌"), (UP(), "减速上涨"), default="减速下跌")


@signal("bar_reversal", 3, stages=[{"body": BODY}])
def reversal():
    big = c("body") > S.mean("body", 3) * 1.5
    was_up = c("pc") > c("po")
    return pick((was_up & ~UP() & big, "顶反转"), (~was_up & UP() & big, "底反转"))


@signal("bar_fake_break", 22)
def fake_break():
    hi, lo = S.max("high", 20, skip=1), S.min("low", 20, skip=1)
    return pick(((c("high") > hi) & (c("close") < hi), "向上假突破"), ((c("low") < lo) & (c("close") > lo), "向下假突破"))


@signal("bar_channel", 21)
def channel():
    hi, lo = S.max("high", 20), S.min("low", 20)
    p = ratio(c("close") - lo, hi - lo)
    return pick((p > 0.8, "上轨附近"), (p < 0.2, "下轨附近"), (p.isNotNull(), "通道中部"))


@signal("bar_zdf", 1)
def zdf():
    return bands(PCT(), [(5, "大涨"), (2, "上涨"), (-2, "横盘"), (-5, "下跌")], "大跌")


@signal("bar_vol_grow", 5, stages=[{"dv": lambda: c("volume") - c("pv")}])
def vol_grow():
    return pick((S.min("dv", 4) > 0, "连续放量"))


@signal("bar_mean_amount", 21, stages=[{"money": MONEY}])
def mean_amount():
    return bands(ratio("money", S.mean("money", 19, skip=1)), [(3, "巨量"), (2, "大量"), (1, "放量")], "缩量")


@signal("bar_section_momentum", 20)
def section_momentum():
    return bands((ratio("close", S.lag("close", 19)) - 1) * 100, [(10, "强多"), (3, "偏多"), (-3, "中性"), (-10, "偏空")], "强空")


@signal("bar_zt_count", 20)
def zt_count():
    n = S.sum(F.when(PCT() >= 9.5, 1).otherwise(0), 20)
    return F.concat(n.cast("string"), F.lit("次涨停"))


@signal("bar_big_solid", 1)
def big_solid():
    s = ratio(BODY(), "close")
    return pick(((s > 0.06) & UP(), "超大阳"), (s > 0.06, "超大阴"), ((s > 0.03) & UP(), "大阳"), (s > 0.03, "大阴"),
                (s < 0.03 * 0.3, "十字星"), (UP(), "小阳"), (s.isNotNull(), "小阴"))


@signal("bar_shuang_fei", 2)
def shuang_fei():
    return pick((c("low") > c("ph"), "向上跳空"), (c("high") < c("pl"), "向下跳空"), default="无缺口")


@signal("bar_limit_down", 1)
def limit_down():
    return pick((PCT() <= -9.5, "跌停"))


@signal("bar_bpm", 5)
def bpm():
    n = S.sum(F.when((c("close") > 0) & (ratio(BODY(), "close") > 0.02), 1.0).otherwise(0.0), 5)
    return bands(n / 5, [(0.6, "高波动"), (0.3, "中波动")], "低波动")


@signal("bar_r_breaker", 10)
def r_breaker():
    hi, lo = S.max("high", 10), S.min("low", 10)
    p = (hi + lo + c("close")) / 3
    return pick((c("close") > 2 * p - lo, "突破买入"), (c("close") < 2 * p - hi, "突破卖出"), default="区间内")


@signal("bar_dual_thrust", 4)
def dual_thrust():
    rng = F.greatest(S.max("high", 4) - S.min("close", 4), S.max("close", 4) - S.min("low", 4))
    return pick((c("close") > c("open") + rng * 0.5, "看多"), (c("close") < c("open") - rng * 0.5, "看空"), default="中性")


@signal("bar_tnr", 12)
def tnr():
    x = ratio("tr", S.mean("tr", 9, skip=1))
    return pick((x > 2, "异常波动"), (x > 1.5, "高波动"), (x < 0.5, "低波动"), (x.isNotNull(), "正常波动"))


@signal("bar_amount_acc", 11, stages=[{"money": MONEY}])
def amount_acc():
    return bands(ratio(S.sum("money", 5), S.sum("money", 5, skip=5)), [(2, "显著放量"), (1.2, "温和放量"), (0.8, "持平")], "缩量")


@signal("bar_operate_span", 1)
def operate_span():
    return pick(((c("close") != c("open")) & (c("volume") > 0), "可操作"), default="不可操作")
