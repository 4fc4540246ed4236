"""Structure signals: labels on strokes (as of each stroke's end) and on bars (as of each bar).

The zone rule inputs are zone-history columns joined as of the stroke's end; every rule is then a
projection over one window per code.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.windows import Series, ratio
from barloom.operators.signals.base import NONE, bands, pick
from barloom.operators.structures import asof

c = F.col
Q = Series(("code",), ("seq",))
ZONE_FIELDS = ["low", "high", "prev_low", "prev_high", "first_low", "first_high", "n_zones", "center_cv", "n_recent"]

STROKE_SIGNALS: dict[str, tuple[int, object]] = {}
BAR_SIGNALS: dict[str, object] = {}


def on_stroke(name: str, need: int = 1):
    def wrap(fn):
        STROKE_SIGNALS[name] = (need, fn)
        return fn
    return wrap


def on_bar(name: str):
    def wrap(fn):
        BAR_SIGNALS[name] = fn
        return fn
    return wrap


def _emit(name, out) -> list[Column]:
    parts = out if isinstance(out, tuple) else (out,)
    return [F.coalesce(p, F.lit(NONE if j == 0 else "任意")).alias(name if j == 0 else f"{name}_v2") for j, p in enumerate(parts)]


def stroke_frame(strokes: DataFrame, zone_history: DataFrame) -> DataFrame:
    d = asof(strokes, zone_history, "end_ts", "end_ts", ZONE_FIELDS)
    return d.withColumn("k", F.row_number().over(Q.w))


def stroke_signals(frame: DataFrame, names: Sequence[str]) -> DataFrame:
    cols = []
    for n in names:
        need, fn = STROKE_SIGNALS[n]
        out = fn()
        parts = out if isinstance(out, tuple) else (out,)
        cols += _emit(n, tuple(F.when(c("k") >= need, p) for p in parts))
    return frame.select("code", "seq", c("end_ts").alias("ts"), *cols)


def bar_frame(bars: DataFrame, strokes: DataFrame, fractals: DataFrame, zone_history: DataFrame) -> DataFrame:
    """Bars with the last finished stroke, the last fractal and the last zone; ``ubi`` counts bars after the stroke."""
    s = strokes.select("*", F.row_number().over(Q.w).alias("k"))
    d = asof(bars.select("code", "ts", "close", "i"), s, "ts", "end_ts", ["k", "dir", "end_i"], "s_")
    d = asof(d, fractals.select("*", F.row_number().over(Series().w).alias("n")), "ts", "ts", ["low", "high", "n"], "f_")
    d = asof(d, zone_history, "ts", "end_ts", ["low", "high"], "z_")
    return d.withColumn("ubi", c("i") + 1 - c("s_end_i"))


def bar_signals(frame: DataFrame, names: Sequence[str]) -> DataFrame:
    return frame.select("code", "ts", *[x for n in names for x in _emit(n, BAR_SIGNALS[n]())])


def H(k: int = 0) -> Column:
    """High of the stroke k back."""
    return c("high") if k == 0 else Q.lag("high", k)


def L(k: int = 0) -> Column:
    return c("low") if k == 0 else Q.lag("low", k)


def _hs(n):
    return [H(n - 1 - i) for i in range(n)]       # oldest first


def _ls(n):
    return [L(n - 1 - i) for i in range(n)]


UP, DOWN = (lambda: c("dir") == 1), (lambda: c("dir") == -1)


# ---- strokes -------------------------------------------------------------------------------------

@on_stroke("cxt_bi_trend", 5)
def bi_trend():
    w = Q.trail(5)
    h, l = F.regr_slope("high", "seq").over(w), F.regr_slope("low", "seq").over(w)
    return pick(((h > 0) & (l > 0), "上涨"), ((h < 0) & (l < 0), "下跌"), default="震荡")


@on_stroke("cxt_bi_zdf")
def bi_zdf():
    return bands((ratio("end_price", "start_price") - 1) * 100, [(5, "大涨"), (2, "小涨"), (-2, "横盘"), (-5, "小跌")], "大跌")


@on_stroke("cxt_three_bi", 3)
def three_bi():
    return pick(((H() > H(2)) & (L(1) > L(2)), "上涨趋势"), ((L() < L(2)) & (H(1) < H(2)), "下跌趋势"), ((H() > H(2)) & (L() < L(2)), "扩张形态"),
                ((H() < H(2)) & (L() > L(2)), "收敛形态"), default="震荡形态")


@on_stroke("cxt_five_bi", 5)
def five_bi():
    return pick(((H() > H(2)) & (L() > L(2)) & (L(2) > L(4)), "二买"), ((H() < H(2)) & (H(2) < H(4)), "二卖"), ((L() > L(2)) & (L(2) >= L(4) * 0.98), "类二买"))


@on_stroke("cxt_seven_bi", 7)
def seven_bi():
    return pick(((H() > H(4)) & (L() > L(4)), "上涨中枢"), ((H() < H(4)) & (L() < L(4)), "下跌中枢"), default="盘整中枢")


def _box(hs, ls, a, b):
    return F.least(*hs[a:b]), F.greatest(*ls[a:b])


@on_stroke("cxt_nine_bi", 9)
def nine_bi():
    hs, ls = _hs(9), _ls(9)
    (h1, l1), (h2, l2) = _box(hs, ls, 2, 5), _box(hs, ls, 5, 8)
    return pick(((l2 > l1) & (h2 > h1), "上涨双中枢"), ((l2 < l1) & (h2 < h1), "下跌双中枢"), default="盘整双中枢")


@on_stroke("cxt_eleven_bi", 11)
def eleven_bi():
    hs = _hs(11)
    a, b, d = hs[0:3], hs[3:6], hs[8:11]
    lo, hi = F.least, F.greatest
    return pick(((hs[10] > hs[0]) & (lo(*d) > lo(*b)) & (lo(*b) > lo(*a)), "完整上涨"), ((hs[10] < hs[0]) & (hi(*d) < hi(*b)) & (hi(*b) < hi(*a)), "完整下跌"), default="复杂形态")


@on_stroke("cxt_thirteen_bi", 13)
def thirteen_bi():
    hs, ls = _hs(13), _ls(13)
    (h1, l1), (h2, l2), (h3, l3) = _box(hs, ls, 2, 5), _box(hs, ls, 5, 8), _box(hs, ls, 8, 11)
    return pick(((h1 < h2) & (h2 < h3) & (l1 < l2) & (l2 < l3), "完整上涨"), ((h1 > h2) & (h2 > h3) & (l1 > l2) & (l2 > l3), "完整下跌"), default="复杂形态")


@on_stroke("cxt_first_buy", 6)
def first_buy():
    return pick((DOWN() & (c("low") < c("z_low")), "一买"))


@on_stroke("cxt_first_sell", 6)
def first_sell():
    return pick((UP() & (c("high") > c("z_high")), "一卖"))


@on_stroke("cxt_second_bs", 5)
def second_bs():
    return pick(((L() > L(2)) & (H() > H(2)), "二买"), ((H() < H(2)) & (L() < L(2)), "二卖"))


@on_stroke("cxt_third_buy", 4)
def third_buy():
    return pick((DOWN() & (c("low") > c("z_high")), "三买"))


@on_stroke("cxt_third_bs", 2)
def third_bs():
    return pick((DOWN() & (c("low") > c("z_high")), "三买"), (UP() & (c("high") < c("z_low")), "三卖"))


@on_stroke("jcc_shan_chun", 7)
def shan_chun():
    var = lambda x, y, z: F.pow(x - (x + y + z) / 3, F.lit(2.0)) + F.pow(y - (x + y + z) / 3, F.lit(2.0)) + F.pow(z - (x + y + z) / 3, F.lit(2.0))
    return pick((UP() & (var(H(4), H(2), H()) / 3 < 0.2), "三山"), (DOWN() & (var(L(4), L(2), L()) / 3 < 0.2), "三川"))


# ---- zones ---------------------------------------------------------------------------------------

@on_stroke("cxt_zs_status")
def zs_status():
    n = F.coalesce("z_n_zones", F.lit(0))
    many = n >= 2
    v = pick((n == 0, "无中枢"), (n == 1, "盘整"), (many & (c("z_low") > c("z_first_low")), "上涨"), (many & (c("z_high") < c("z_first_high")), "下跌"), default="盘整")
    return v, F.concat(n.cast("string"), F.lit("中枢"))


@on_stroke("cxt_zs_overlap")
def zs_overlap():
    ok = F.least("z_high", F.coalesce("z_prev_high", "z_high")) > F.greatest("z_low", F.coalesce("z_prev_low", "z_low"))
    return F.when(c("z_low").isNotNull(), pick((ok, "有重叠"), default="无重叠"))


@on_stroke("cxt_zs_gongzhen")
def zs_gongzhen():
    return F.when(c("z_n_recent") >= 3, pick((c("z_center_cv") < 0.02, "共振"), default="无共振"))


@on_stroke("cxt_double_zs")
def double_zs():
    l1, h1, l2, h2 = c("z_prev_low"), c("z_prev_high"), c("z_low"), c("z_high")
    return F.when(l1.isNotNull(), pick((l2 > h1, "上涨排列"), (h2 < l1, "下跌排列"), (l2 > l1, "上涨交叉"), (h2 < h1, "下跌交叉"), default="重叠盘整"))


@on_stroke("cxt_range_oscillation")
def range_oscillation():
    a = ratio(c("z_high") - c("z_low"), (c("z_high") + c("z_low")) / 2)
    return F.when(a.isNotNull(), pick((a < 0.03, "窄幅震荡"), (a < 0.08, "宽幅震荡"), default="剧烈震荡"))


@on_stroke("cxt_zs_level")
def zs_level():
    total = Q.max("high", 20, min_periods=1) - Q.min("low", 20, min_periods=1)
    r = ratio(c("z_high") - c("z_low"), total)
    return F.when(r.isNotNull(), pick((r > 0.5, "大级别"), (r > 0.2, "中级别"), default="小级别"))


@on_stroke("cxt_decision", 3)
def decision(divergence: str | None = "divergence"):
    """Direction, order of the last two zones and the latest divergence (column of bottom / top / null)."""
    s = c("dir") + F.when(c("z_prev_low").isNull(), 0).when(c("z_low") > c("z_prev_low"), 1).otherwise(-1)
    if divergence:
        s = s + F.when(c(divergence) == "bottom", 2).when(c(divergence) == "top", -2).otherwise(0)
    return pick((s > 1, "看多"), (s < -1, "看空"), default="中性")


@on_stroke("cxt_bi_macd_diverge", 3)
def bi_macd_diverge():
    """MACD area of the last 10 bars under 0.7 of the 10 before (columns area10, parea10 as of the stroke end)."""
    weak = c("area10") < c("parea10") * 0.7
    return F.when((c("dir") != Q.lag("dir")) & (c("parea10") > 0), pick((weak & UP(), "顶背驰"), (weak, "底背驰"), default="无背驰"))


@on_stroke("cxt_multi_level_bs", 3)
def multi_level_bs():
    """Own and higher-level direction votes; a level votes only with a zone (column higher_vote)."""
    s = F.when(c("z_low").isNotNull(), c("dir")).otherwise(0) + F.coalesce("higher_vote", F.lit(0))
    return pick((s >= 2, "共振买点"), (s == 1, "偏多"), (s == -1, "偏空"), (s <= -2, "共振卖点"), default="中性")


# ---- segments (rows shaped like strokes, with n_strokes) ------------------------------------------

@on_stroke("cxt_seg_status")
def seg_status():
    return pick((UP(), "向上"), default="向下"), pick((c("n_strokes") >= 5, "延伸"), default="转折")


@on_stroke("cxt_seg_direction", 3)
def seg_direction():
    return pick(((H() > H(1)) & (H(1) > H(2)), "上涨"), ((H() < H(1)) & (H(1) < H(2)), "下跌"), default="震荡")


@on_stroke("cxt_seg_zs", 3)
def seg_zs():
    w = F.least(H(), H(1), H(2)) - F.greatest(L(), L(1), L(2))
    return pick((w > 0, "有中枢"), default="无中枢"), F.when(w > 0, F.concat(F.lit("宽度"), F.format_string("%.2f", F.floor(w * 100 + 0.5) / 100)))


# ---- bars ----------------------------------------------------------------------------------------

def _turned():
    return pick((c("s_dir") == -1, "向上"), default="向下")


@on_bar("cxt_bi_base")
def bi_base():
    ok = c("s_k") >= 3
    return F.when(ok, _turned()), F.when(ok, pick((c("ubi") >= 9, "中继"), default="转折"))


@on_bar("cxt_bi_end")
def bi_end():
    ok = c("s_k") >= 3
    return F.when(ok, _turned()), F.when(ok, pick(((c("ubi") < 7) & (c("f_n") >= 2), "结束"), default="延续"))


@on_bar("cxt_bi_status")
def bi_status():
    ok = c("s_k") >= 1
    return F.when(ok, _turned()), F.when(ok, pick((c("ubi") < 3, "新笔"), (c("ubi") < 7, "转折"), default="延伸"))


@on_bar("cxt_bi_stop")
def bi_stop():
    ok = (c("s_k") >= 2) & (c("f_n") >= 2) & (c("ubi") >= 1)
    up = c("s_dir") == 1
    stop = F.when(up, c("close") < c("f_low")).otherwise(c("close") > c("f_high"))
    return F.when(ok, pick((up, "向上"), default="向下")), F.when(ok, pick((stop, "停顿"), default="延伸"))


@on_bar("cxt_ubi_end")
def ubi_end():
    return F.when(c("s_k") >= 1, pick((c("ubi") < 3, "刚形成"), (c("ubi") < 5, "即将结束"), default="延续中"))


@on_bar("cxt_zs_breakout")
def zs_breakout():
    return F.when(c("z_low").isNotNull(), pick((c("close") > c("z_high"), "向上突破"), (c("close") < c("z_low"), "向下突破"), default="中枢内"))


# ---- labels of other tables ----------------------------------------------------------------------

def fx_power(fractals: DataFrame, zone_history: DataFrame) -> DataFrame:
    """Strength word of each fractal's body and whether a zone exists by then."""
    d = asof(fractals, zone_history, "ts", "end_ts", ["zone"])
    body = ratio(F.abs(c("close") - c("open")), "close")
    word = F.when(body > 0.02, "强").when((body > 0) & (body < 0.005), "弱").otherwise("中")
    return d.select("code", "ts", F.concat(word, F.when(c("kind") == 1, "顶").otherwise("底")).alias("cxt_fx_power"), F.when(c("z_zone").isNotNull(), "有中枢").otherwise("无中枢").alias("cxt_fx_power_v2"))


# Label of each point, divergence and trend.
POINT_LABELS = {"buy1": "一买", "buy2": "二买", "buy3": "三买", "sell1": "一卖", "sell2": "二卖", "sell3": "三卖"}
DIVERGENCE_LABELS = {"top": "顶背驰", "bottom": "底背驰"}
TREND_LABELS = {"up_trend": "上涨", "down_trend": "下跌", "consolidation": "盘整", "unknown": "未判定"}


def labelled(col: Column, table: dict[str, str]) -> Column:
    return pick(*[(col == k, v) for k, v in table.items()])


def trend_signal(trend: DataFrame) -> DataFrame:
    s = c("trend_strength")
    return trend.select("code", labelled(c("trend"), TREND_LABELS).alias("cxt_trend_type_signal"), F.when(s > 0.7, "强").when(s > 0.4, "中").otherwise("弱").alias("cxt_trend_type_signal_v2"))
