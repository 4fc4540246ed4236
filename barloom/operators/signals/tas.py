"""Indicator signals."""

from pyspark.sql import functions as F

from barloom.functions.recursive import span
from barloom.functions.windows import ratio
from barloom.operators import indicators as I
from barloom.operators.signals.base import NONE, S, bands, c, cross, cross_cols, pick, signal

MACD = dict(rec=I.MACD)
BAR = {"bar": lambda: c("_bar") * 2}
CHOICE = [(10, "强多"), (3, "偏多"), (-3, "中性"), (-10, "偏空")]


@signal("tas_macd_cross", 36, **MACD)
def macd_cross():
    return cross_cols("dif", "dea")


def _peaks(sign: int):
    """Positions (oldest first) of strict extremes among the last 30 closes, 5 bars to either side."""
    xs = F.transform(c("w30"), lambda s: s["close"] * sign)

    def is_peak(p):
        lo = F.greatest(p - 5, F.lit(0))
        around = F.slice(xs, lo + 1, F.least(p + 5, F.lit(29)) - lo + 1)
        top = F.array_max(around)
        return (F.get(xs, p) == top) & (F.size(F.filter(around, lambda v: v == top)) == 1)

    return F.filter(F.sequence(F.lit(1), F.lit(28)), is_peak)


@signal("tas_macd_bc", 55, rec=I.MACD, stages=[
    BAR, {"w30": lambda: F.collect_list(F.struct("close", F.abs("bar").alias("m"))).over(S.trail(30))},
    {"tops": lambda: _peaks(1), "lows": lambda: _peaks(-1)}])
def macd_bc():
    """Last two local extremes: a further price with a smaller MACD bar is a divergence."""
    def pair(idx, better):
        a, b = (F.get("w30", F.try_element_at(idx, F.lit(k))) for k in (-2, -1))
        return better(b["close"], a["close"]) & (b["m"] < a["m"])

    two_tops, two_lows = F.size("tops") >= 2, F.size("lows") >= 2
    tops = F.when(two_tops, pair(c("tops"), lambda b, a: b > a))
    lows = F.when(two_lows, pair(c("lows"), lambda b, a: b < a))
    return pick((tops, "顶背驰"), (~two_tops & lows, "底背驰"), default="无背驰")


@signal("tas_macd_dist", 36, **MACD)
def macd_dist():
    x = ratio("dif", F.stddev_pop("dif").over(S.run()))
    return bands(x, [(2, "远高于零轴"), (0, "高于零轴"), (-2, "低于零轴")], "远低于零轴")


def _mas():
    return [S.mean("close", n) for n in (5, 10, 20, 60)]


@signal("tas_ma_system", 61)
def ma_system():
    a, b, d, e = _mas()
    return pick(((a > b) & (b > d) & (d > e), "多头排列"), ((a < b) & (b < d) & (d < e), "空头排列"), default="交叉排列")


@signal("tas_ma_cohere", 61)
def ma_cohere():
    m = _mas()
    mean = (m[0] + m[1] + m[2] + m[3]) / 4
    x = F.when(mean > 0, (F.greatest(*m) - F.least(*m)) / mean).otherwise(1.0)
    return pick((x < 0.02, "粘合"), default="分散")


@signal("tas_double_ma", 22, rec=[("e5", "ema", "close", span(5)), ("e20", "ema", "close", span(20))])
def double_ma():
    return cross_cols("e5", "e20")


@signal("tas_cross_status", 21)
def cross_status():
    x = (ratio(S.mean("close", 5), S.mean("close", 20)) - 1) * 100
    return bands(x, [(3, "多头远离"), (0, "多头贴近"), (-3, "空头贴近")], "空头远离")


@signal("tas_atr", 16)
def atr():
    return bands(ratio(I.atr(14, loose=False), "close") * 100, [(3, "高波动"), (1.5, "中波动")], "低波动")


@signal("tas_boll_status", 21)
def boll_status():
    up, mid, lo = I.bollinger(20, 2.0, loose=False)
    v = pick((c("close") > up, "上轨上方"), (c("close") < lo, "下轨下方"), (c("close") > mid, "中轨上方"), default="中轨下方")
    width = F.when(mid > 0, (up - lo) / mid).otherwise(0.0)
    return v, pick((width < 0.05, "收窄"), default="扩张")


@signal("tas_kdj_cross", 11, before={"rsv": lambda: I.rsv(9, loose=False)}, rec=I.KDJ)
def kdj_cross():
    k, d, pk, pd_ = c("k"), c("dd"), S.lag("k"), S.lag("dd")
    j = k * 3 - d * 2
    return pick(((k > d) & (pk <= pd_), "金叉"), ((k < d) & (pk >= pd_), "死叉"), (j > 100, "超买"), (j < 0, "超卖"),
                (k > d, "多头"), default="空头")


@signal("tas_rsi_status", 16)
def rsi_status():
    return bands(I.rsi_simple(14), [(80, "极度超买"), (70, "超买"), (50, "偏强"), (30, "偏弱"), (20, "超卖")], "极度超卖")


@signal("tas_cci_status", 16, stages=[{"cci": lambda: I.cci(14)}])
def cci_status():
    return bands(c("cci"), [(200, "极度看多"), (100, "看多"), (-100, "中性"), (-200, "看空")], "极度看空")


@signal("tas_sar_status", 21, rec=[("sar", "sar")])
def sar_status():
    return pick((c("close") > c("sar"), "看多"), default="看空")


@signal("tas_dif_zero", 37, **MACD)
def dif_zero():
    return cross(c("dif"), F.lit(0), S.lag("dif"), F.lit(0), ("上穿零轴", "下穿零轴", "零轴上方", "零轴下方"))


@signal("tas_slope", 6)
def slope():
    w = S.trail(5)
    x = ratio(F.regr_slope("close", "i").over(w), F.avg("close").over(w)) * 100
    return bands(x, [(1, "上升"), (0, "微升"), (-1, "微降")], "下降")


@signal("tas_accelerate", 21)
def accelerate():
    a = ratio(S.lag("close", 6), S.lag("close", 10)) - 1
    b = ratio(c("pc"), S.lag("close", 5)) - 1
    return pick(((b > a) & (a > 0), "加速上涨"), ((b < a) & (a < 0), "加速下跌"), ((a > 0) & (b < 0), "上涨减速"),
                ((a < 0) & (b > 0), "下跌减速"), default="匀速")


@signal("tas_low_trend", 21)
def low_trend():
    lo, hi, ma = S.min("close", 21), S.max("close", 21), S.mean("close", 5)
    p = ratio(c("close") - lo, hi - lo)
    return pick(((p < 0.2) & (c("close") > ma), "低位反转"), (p < 0.2, "低位弱势"), ((p > 0.8) & (c("close") < ma), "高位反转"),
                (p > 0.8, "高位强势"), (p.isNotNull(), "中位震荡"))


@signal("tas_angle", 6)
def angle():
    return bands((ratio("close", S.lag("close", 4)) - 1) * 100,
                 [(5, "陡峭上升"), (1, "平缓上升"), (-1, "横盘"), (-5, "平缓下降")], "陡峭下降")


@signal("tas_dma_bs", 52, stages=[{"dma": lambda: S.mean("close", 10) - S.mean("close", 50)}, {"ama": lambda: S.mean("dma", 10)}])
def dma_bs():
    return cross_cols("dma", "ama", ("看多", "看空", "多头", "空头"))


@signal("tas_rumi", 26, rec=[("e3", "ema", "close", span(3)), ("e20", "ema", "close", span(20)), ("rd", "minus", "e3", "e20"),
                             ("rumi", "ema", "rd", span(5))])
def rumi():
    return pick((c("rumi") > 0, "看多"), default="看空")


@signal("tas_macd_bs1", 37, **MACD)
def macd_bs1():
    a, b, pa, pb = c("dif"), c("dea"), S.lag("dif"), S.lag("dea")
    return pick(((a > b) & (pa <= pb) & (a < 0), "一类买"), ((a < b) & (pa >= pb) & (a > 0), "一类卖"))


@signal("tas_volume_price", 6)
def volume_price():
    p, v = c("close") > S.lag("close", 4), c("volume") > S.lag("volume", 4)
    return pick((p & v, "量价齐升"), (~p & ~v, "量价齐跌"), (p & ~v, "价涨量缩"), default="价跌量增")


@signal("tas_bias_status", 21)
def bias_status():
    return bands((ratio("close", S.mean("close", 20)) - 1) * 100,
                 [(5, "严重正乖离"), (2, "正乖离"), (-2, "正常"), (-5, "负乖离")], "严重负乖离")


@signal("tas_emv_status", 16, stages=[{"emv": lambda: ((c("high") + c("low")) / 2 - (c("ph") + c("pl")) / 2)
                                       * (c("volume") / (c("high") - c("low") + 0.001) * 10000)}])
def emv_status():
    return bands(S.mean("emv", 14), [(0, "看多")], "看空")


@signal("tas_obv_status", 22, stages=[{"obv": I.obv}, {"obvm": lambda: S.mean("obv", 20)}])
def obv_status():
    return cross_cols("obv", "obvm", ("看多", "看空", "多头", "空头"))


@signal("tas_wr_status", 16)
def wr_status():
    return bands(I.williams_r(14), [(80, "超卖"), (50, "偏弱"), (20, "偏强")], "超买")


@signal("tas_dmi_status", 30, stages=I.dmi_stages())
def dmi_status():
    return (pick((c("pdi") > c("mdi"), "多头"), (c("pdi").isNotNull(), "空头")),
            bands(F.coalesce("adx", F.lit(0.0)), [(40, "强趋势"), (25, "有趋势")], "无趋势"))


@signal("tas_trix_signal", 38, rec=I.TRIX, stages=[{"trix": lambda: (c("t3") - S.lag("t3")) / (S.lag("t3") + 1e-10) * 100}])
def trix_signal():
    return cross(c("trix"), F.lit(0), S.lag("trix"), F.lit(0))


@signal("tas_roc_signal", 14)
def roc_signal():
    p = S.lag("close", 12)
    return bands((c("close") - p) / (p + 1e-10) * 100, CHOICE, "强空")


@signal("tas_mtm_signal", 14)
def mtm_signal():
    m = I.mtm(12)
    return pick((m > 0, "多头动量"), (m < 0, "空头动量"), default="动量平衡")


@signal("tas_psy_status", 14)
def psy_status():
    return bands(I.psy(12), [(75, "超买"), (50, "偏强"), (25, "偏弱")], "超卖")


@signal("tas_vr_status", 28)
def vr_status():
    return bands(I.volume_ratio(26), [(350, "超买"), (200, "偏多"), (70, "正常"), (40, "偏空")], "超卖")


def _wad_step():
    """Accumulation against the previous close."""
    up, dn = c("close") - F.least("low", "pc"), c("close") - F.greatest("high", "pc")
    return F.when(c("d") > 0, up).when(c("d") < 0, dn).otherwise(0.0)


@signal("tas_wad_status", 22, stages=[{"wads": _wad_step}, {"wad": lambda: F.sum("wads").over(S.run())}])
def wad_status():
    return pick((c("wad") > S.mean("wad", 20), "多头"), default="空头")


@signal("tas_adx_status", 30, stages=I.dmi_stages())
def adx_status():
    return bands(c("adx"), [(50, "极强趋势"), (40, "强趋势"), (25, "有趋势")], "无趋势")


@signal("tas_tsi_signal", 52, before={"absd": lambda: F.abs("d")}, rec=I.TSI)
def tsi_signal():
    return bands(c("ad2") / (c("aa2") + 1e-10) * 100, [(20, "强多"), (0, "多头"), (-20, "空头")], "强空")
