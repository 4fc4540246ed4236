"""One query per bar signal: the label of every brand-week bar."""

from barloom.operators.signals import signal_frame
from barloom.plans import bindings as D
from barloom.plans.frames import BASE, MACD, WIN, bands, ema, over, run, span, staged
from barloom.plans.registry import query


def lag(x, n=1):
    return f"lag({x}, {n}) OVER w"


def mean(x, n, skip=0):
    return over(f"avg({x})", n, skip)


def mx(x, n, skip=0):
    return over(f"max({x})", n, skip)


def mn(x, n, skip=0):
    return over(f"min({x})", n, skip)


def sm(x, n, skip=0):
    return over(f"sum({x})", n, skip)


def case(*steps, default="其他"):
    body = " ".join(f"WHEN {cond} THEN {label if label.startswith('(') else repr(label)}" for cond, label in steps)
    return f"CASE {body} ELSE '{default}' END"


def cross(a, b, pa, pb, labels=("金叉", "死叉", "多头", "空头")):
    u, d, x, y = labels
    return case((f"{a} > {b} AND {pa} <= {pb}", u), (f"{a} < {b} AND {pa} >= {pb}", d), (f"{a} > {b}", x),
                (f"{a} IS NOT NULL AND {b} IS NOT NULL", y))


def cross_cols(a, b, labels=("金叉", "死叉", "多头", "空头")):
    return cross(a, b, lag(a), lag(b), labels)


def register(num: int, name: str, need: int, v1: str, v2: str | None = None, stages=(), base=BASE, src="b", sql=True):
    text, last = staged(stages, base, src)
    cols = f"CASE WHEN i + 1 >= {need} THEN coalesce({v1}, '其他') ELSE '其他' END AS {name}"
    spec = f"code:s ts:d {name}:s"
    if v2:
        cols += f", CASE WHEN i + 1 >= {need} THEN coalesce({v2}, '任意') ELSE '任意' END AS {name}_v2"
        spec += f" {name}_v2:s"

    @query(f"g{num:03d}_{name}", spec, f"{text}\n---\nSELECT code, ts, {cols} FROM {last} {WIN}" if sql else None)
    def run_signal(spark, sf):
        return signal_frame(D.brand_bars(spark, sf, "week"), [name])


G = register
PCT = "((close / open - 1) * 100)"
BODY = {"body": "abs(close - open)"}
MONEY = {"money": "close * volume"}

# ---- raw bars ------------------------------------------------------------------------------------
G(1, "bar_single_trend", 101, "CASE WHEN n >= 50 AND list_unique(q) = 6 THEN '第' || (1 + len(list_filter(q[2:5], lambda e: e < x))) || '层' END",
  stages=[{"x": "(close / open - 1) / volume"}, {"q": "quantile_cont(x, [0, 0.2, 0.4, 0.6, 0.8, 1]) OVER (w ROWS 99 PRECEDING)", "n": "count(x) OVER (w ROWS 99 PRECEDING)"}])
_u3 = f"({mn('CASE WHEN close > open THEN 1 ELSE 0 END', 3)} = 1)"
_d3 = f"({mn('CASE WHEN close < open THEN 1 ELSE 0 END', 3)} = 1)"
_nh = f"high > ph AND ph > {lag('high', 2)} AND low > pl AND pl > {lag('low', 2)}"
_nl = f"high < ph AND ph < {lag('high', 2)} AND low < pl AND pl < {lag('low', 2)}"
G(2, "bar_triple_accelerate", 8, case((f"{_u3} AND {_nh}", "新高涨"), (_u3, "三连涨"), (f"{_d3} AND {_nl}", "新低跌"), (_d3, "三连跌")),
  f"CASE WHEN {_u3} OR {_d3} THEN " + case((f"volume > pv AND pv > {lag('volume', 2)}", "依次放量"), (f"volume < pv AND pv < {lag('volume', 2)}", "依次缩量"), default="量柱无序") + " END")
_g = f"{mn('db', 4)} > 0"
G(3, "bar_accelerate", 5, case((f"{_g} AND close > open", "加速上涨"), (_g, "加速下跌"), ("close > open", "减速上涨"), default="减速下跌"),
  stages=[BODY, {"db": f"body - {lag('body')}"}])
G(4, "bar_reversal", 3, case((f"pc > po AND NOT close > open AND body > {mean('body', 3)} * 1.5", "顶反转"),
                             (f"NOT pc > po AND close > open AND body > {mean('body', 3)} * 1.5", "底反转")), stages=[BODY])
G(5, "bar_fake_break", 22, case((f"high > {mx('high', 20, 1)} AND close < {mx('high', 20, 1)}", "向上假突破"),
                                (f"low < {mn('low', 20, 1)} AND close > {mn('low', 20, 1)}", "向下假突破")))
_p = f"((close - {mn('low', 20)}) / nullif({mx('high', 20)} - {mn('low', 20)}, 0))"
G(6, "bar_channel", 21, case((f"{_p} > 0.8", "上轨附近"), (f"{_p} < 0.2", "下轨附近"), (f"{_p} IS NOT NULL", "通道中部")))
G(7, "bar_zdf", 1, bands(PCT, [(5, "大涨"), (2, "上涨"), (-2, "横盘"), (-5, "下跌")], "大跌"))
G(8, "bar_vol_grow", 5, case((f"{mn('dv', 4)} > 0", "连续放量")), stages=[{"dv": "volume - pv"}])
G(9, "bar_mean_amount", 21, bands(f"(money / {mean('money', 19, 1)})", [(3, "巨量"), (2, "大量"), (1, "放量")], "缩量"), stages=[MONEY])
G(10, "bar_section_momentum", 20, bands(f"((close / {lag('close', 19)} - 1) * 100)", [(10, "强多"), (3, "偏多"), (-3, "中性"), (-10, "偏空")], "强空"))
G(11, "bar_zt_count", 20, f"CAST({sm(f'CASE WHEN {PCT} >= 9.5 THEN 1 ELSE 0 END', 20)} AS BIGINT) || '次涨停'")
G(12, "bar_big_solid", 1, case(("s > 0.06 AND close > open", "超大阳"), ("s > 0.06", "超大阴"), ("s > 0.03 AND close > open", "大阳"), ("s > 0.03", "大阴"),
                               ("s < 0.03e0 * 0.3e0", "十字星"), ("close > open", "小阳"), default="小阴"), stages=[{"s": "abs(close - open) / close"}])
G(13, "bar_shuang_fei", 2, case(("low > ph", "向上跳空"), ("high < pl", "向下跳空"), default="无缺口"))
G(14, "bar_limit_down", 1, case((f"{PCT} <= -9.5", "跌停")))
G(15, "bar_bpm", 5, bands(f"({sm('CASE WHEN abs(close - open) / close > 0.02 THEN 1e0 ELSE 0 END', 5)} / 5)", [(0.6, "高波动"), (0.3, "中波动")], "低波动"))
_pv = f"(({mx('high', 10)} + {mn('low', 10)} + close) / 3)"
G(16, "bar_r_breaker", 10, case((f"close > 2 * {_pv} - {mn('low', 10)}", "突破买入"), (f"close < 2 * {_pv} - {mx('high', 10)}", "突破卖出"), default="区间内"))
_rg = f"greatest({mx('high', 4)} - {mn('close', 4)}, {mx('close', 4)} - {mn('low', 4)})"
G(17, "bar_dual_thrust", 4, case((f"close > open + 0.5 * {_rg}", "看多"), (f"close < open - 0.5 * {_rg}", "看空"), default="中性"))
_tn = f"(tr / nullif({mean('tr', 9, 1)}, 0))"
G(18, "bar_tnr", 12, case((f"{_tn} > 2", "异常波动"), (f"{_tn} > 1.5", "高波动"), (f"{_tn} < 0.5", "低波动"), (f"{_tn} IS NOT NULL", "正常波动")))
G(19, "bar_amount_acc", 11, bands(f"({sm('money', 5)} / {sm('money', 5, 5)})", [(2, "显著放量"), (1.2, "温和放量"), (0.8, "持平")], "缩量"), stages=[MONEY])
G(20, "bar_operate_span", 1, case(("close <> open AND volume > 0", "可操作"), default="不可操作"))

# ---- indicators ----------------------------------------------------------------------------------
E = lambda n: ema("close", span(n))
G(21, "tas_macd_cross", 36, cross_cols("dif", "dea"), stages=MACD)
_arr = [*MACD, {"wc": "list(close) OVER (w ROWS 29 PRECEDING)", "wm": "list(abs(bar)) OVER (w ROWS 29 PRECEDING)"},
        {k: f"list_filter(range(2, 30), lambda p: len(list_filter(range(greatest(p - 5, 1), least(p + 5, 30) + 1), lambda q: q <> p AND NOT wc[p] {op} wc[q])) = 0)"
         for k, op in (("tops", ">"), ("lows", "<"))}]
G(22, "tas_macd_bc", 55, case(
    ("len(tops) >= 2 AND wc[tops[-1]] > wc[tops[-2]] AND wm[tops[-1]] < wm[tops[-2]]", "顶背驰"),
    ("len(tops) < 2 AND len(lows) >= 2 AND wc[lows[-1]] < wc[lows[-2]] AND wm[lows[-1]] < wm[lows[-2]]", "底背驰"), default="无背驰"), stages=_arr)
G(23, "tas_macd_dist", 36, bands(f"(dif / nullif({run('stddev_pop(dif)')}, 0))", [(2, "远高于零轴"), (0, "高于零轴"), (-2, "低于零轴")], "远低于零轴"), stages=MACD)
_ma = {f"m{n}": mean("close", n) for n in (5, 10, 20, 60)}
G(24, "tas_ma_system", 61, case(("m5 > m10 AND m10 > m20 AND m20 > m60", "多头排列"), ("m5 < m10 AND m10 < m20 AND m20 < m60", "空头排列"), default="交叉排列"), stages=[_ma])
G(25, "tas_ma_cohere", 61, case(("(greatest(m5, m10, m20, m60) - least(m5, m10, m20, m60)) / ((m5 + m10 + m20 + m60) / 4) < 0.02", "粘合"), default="分散"), stages=[_ma])
G(26, "tas_double_ma", 22, cross_cols("a", "z"), stages=[{"a": E(5), "z": E(20)}])
G(27, "tas_cross_status", 21, bands(f"(({mean('close', 5)} / {mean('close', 20)} - 1) * 100)", [(3, "多头远离"), (0, "多头贴近"), (-3, "空头贴近")], "空头远离"))
G(28, "tas_atr", 16, bands(f"({mean('tr', 14)} / close * 100)", [(3, "高波动"), (1.5, "中波动")], "低波动"))
_bb = [{"mid": mean("close", 20), "sd": over("stddev_samp(close)", 20)}]
G(29, "tas_boll_status", 21, case(("close > mid + 2 * sd", "上轨上方"), ("close < mid - 2 * sd", "下轨下方"), ("close > mid", "中轨上方"), default="中轨下方"),
  case(("4 * sd / mid < 0.05", "收窄"), default="扩张"), stages=_bb)
_kdj = [{"rsv": f"coalesce((close - {mn('low', 9)}) / nullif({mx('high', 9)} - {mn('low', 9)}, 0) * 100, 50)"}, {"k": ema("rsv", 1 / 3)}, {"dd": ema("k", 1 / 3)}]
G(30, "tas_kdj_cross", 11, case((f"k > dd AND {lag('k')} <= {lag('dd')}", "金叉"), (f"k < dd AND {lag('k')} >= {lag('dd')}", "死叉"), ("3 * k - 2 * dd > 100", "超买"),
                                ("3 * k - 2 * dd < 0", "超卖"), ("k > dd", "多头"), default="空头"), stages=_kdj)
RSI_SIMPLE = [{"ga": "CASE WHEN d IS NOT NULL THEN greatest(d, 0) END", "lo": "CASE WHEN d IS NOT NULL THEN greatest(-d, 0) END"},
              {"ag": mean("ga", 14), "al": mean("lo", 14)}, {"rsi": "CASE WHEN al = 0 THEN 0 ELSE 100 - 100 / (1 + ag / al) END"}]
G(31, "tas_rsi_status", 16, bands("rsi", [(80, "极度超买"), (70, "超买"), (50, "偏强"), (30, "偏弱"), (20, "超卖")], "极度超卖"), stages=RSI_SIMPLE)
CCI = [{"tl": "list(tp) OVER (w ROWS 13 PRECEDING)", "tm": mean("tp", 14)},
       {"cci": "CASE WHEN tm IS NOT NULL THEN (tp - tm) / nullif(0.015 * list_avg(list_transform(tl, lambda x: abs(x - tm))), 0) END"}]
G(32, "tas_cci_status", 16, bands("cci", [(200, "极度看多"), (100, "看多"), (-100, "中性"), (-200, "看空")], "极度看空"), stages=CCI)
SAR = "RECURSIVE " + BASE + """,
lows AS MATERIALIZED (SELECT *, least(pl, coalesce(lag(low, 2) OVER w, pl)) AS fl, greatest(ph, coalesce(lag(high, 2) OVER w, ph)) AS fh FROM b
  WINDOW w AS (PARTITION BY code ORDER BY ts)),
sarr AS (SELECT code, ts, i, close, low AS sar, true AS up, 0.02e0 AS af, high AS ep FROM lows WHERE i = 0
  UNION ALL
  SELECT code, ts, i, close, CASE WHEN flip THEN ep0 ELSE raw END, up0 <> flip,
    CASE WHEN flip THEN 0.02e0 WHEN (up0 AND high > ep0) OR (NOT up0 AND low < ep0) THEN least(af0 + 0.02e0, 0.2e0) ELSE af0 END,
    CASE WHEN flip THEN (CASE WHEN up0 THEN low ELSE high END) WHEN up0 THEN greatest(ep0, high) ELSE least(ep0, low) END
  FROM (SELECT *, CASE WHEN up0 THEN low < raw ELSE high > raw END AS flip FROM (
    SELECT l.code, l.ts, l.i, l.close, l.high, l.low, s.up AS up0, s.af AS af0, s.ep AS ep0,
      CASE WHEN s.up THEN least(s.sar + s.af * (s.ep - s.sar), l.fl) ELSE greatest(s.sar + s.af * (s.ep - s.sar), l.fh) END AS raw
    FROM sarr s JOIN lows l ON l.code = s.code AND l.i = s.i + 1)))"""
G(33, "tas_sar_status", 21, case(("close > sar", "看多"), default="看空"), base=SAR, src="sarr")
G(34, "tas_dif_zero", 37, cross("dif", "0", lag("dif"), "0", ("上穿零轴", "下穿零轴", "零轴上方", "零轴下方")), stages=MACD)
G(35, "tas_slope", 6, bands(f"({over('regr_slope(close, i)', 5)} / {mean('close', 5)} * 100)", [(1, "上升"), (0, "微升"), (-1, "微降")], "下降"))
_a, _b = f"({lag('close', 6)} / {lag('close', 10)} - 1)", f"(pc / {lag('close', 5)} - 1)"
G(36, "tas_accelerate", 21, case((f"{_b} > {_a} AND {_a} > 0", "加速上涨"), (f"{_b} < {_a} AND {_a} < 0", "加速下跌"), (f"{_a} > 0 AND {_b} < 0", "上涨减速"),
                                 (f"{_a} < 0 AND {_b} > 0", "下跌减速"), default="匀速"))
_p = f"((close - {mn('close', 21)}) / nullif({mx('close', 21)} - {mn('close', 21)}, 0))"
G(37, "tas_low_trend", 21, case((f"{_p} < 0.2 AND close > {mean('close', 5)}", "低位反转"), (f"{_p} < 0.2", "低位弱势"), (f"{_p} > 0.8 AND close < {mean('close', 5)}", "高位反转"),
                                (f"{_p} > 0.8", "高位强势"), (f"{_p} IS NOT NULL", "中位震荡")))
G(38, "tas_angle", 6, bands(f"((close / {lag('close', 4)} - 1) * 100)", [(5, "陡峭上升"), (1, "平缓上升"), (-1, "横盘"), (-5, "平缓下降")], "陡峭下降"))
G(39, "tas_dma_bs", 52, cross_cols("dma", "ama", ("看多", "看空", "多头", "空头")), stages=[{"dma": f"{mean('close', 10)} - {mean('close', 50)}"}, {"ama": mean("dma", 10)}])
G(40, "tas_rumi", 26, case(("rumi > 0", "看多"), default="看空"), stages=[{"rd": f"{E(3)} - {E(20)}"}, {"rumi": ema("rd", span(5))}])
G(41, "tas_macd_bs1", 37, case((f"dif > dea AND {lag('dif')} <= {lag('dea')} AND dif < 0", "一类买"), (f"dif < dea AND {lag('dif')} >= {lag('dea')} AND dif > 0", "一类卖")), stages=MACD)
_p, _v = f"close > {lag('close', 4)}", f"volume > {lag('volume', 4)}"
G(42, "tas_volume_price", 6, case((f"{_p} AND {_v}", "量价齐升"), (f"NOT {_p} AND NOT {_v}", "量价齐跌"), (f"{_p} AND NOT {_v}", "价涨量缩"), default="价跌量增"))
G(43, "tas_bias_status", 21, bands(f"((close / {mean('close', 20)} - 1) * 100)", [(5, "严重正乖离"), (2, "正乖离"), (-2, "正常"), (-5, "负乖离")], "严重负乖离"))
G(44, "tas_emv_status", 16, bands(mean("emv", 14), [(0, "看多")], "看空"), stages=[{"emv": "((high + low) / 2 - (ph + pl) / 2) * (volume / (high - low + 0.001) * 10000)"}])
OBV = [{"obv": run("sum(coalesce(sign(d), 0) * volume)")}]
G(45, "tas_obv_status", 22, cross_cols("obv", "om", ("看多", "看空", "多头", "空头")), stages=[*OBV, {"om": mean("obv", 20)}])
G(46, "tas_wr_status", 16, bands(f"(({mx('high', 14)} - close) / ({mx('high', 14)} - {mn('low', 14)} + 1e-10) * 100)", [(80, "超卖"), (50, "偏弱"), (20, "偏强")], "超买"))
DMI = [{"pdm": "CASE WHEN high - ph > pl - low AND high > ph THEN high - ph ELSE 0e0 END", "mdm": "CASE WHEN pl - low > high - ph AND pl > low THEN pl - low ELSE 0e0 END"},
       {"pdi": f"{mean('pdm', 14)} / nullif({mean('tr', 14)}, 0) * 100", "mdi": f"{mean('mdm', 14)} / nullif({mean('tr', 14)}, 0) * 100"},
       {"dx": "abs(pdi - mdi) / (pdi + mdi + 1e-10) * 100"}, {"adx": mean("dx", 14)}]
G(47, "tas_dmi_status", 30, case(("pdi > mdi", "多头"), ("pdi IS NOT NULL", "空头")), bands("coalesce(adx, 0)", [(40, "强趋势"), (25, "有趋势")], "无趋势"), stages=DMI)
TRIX = [{"t1": E(12)}, {"t2": ema("t1", span(12))}, {"t3": ema("t2", span(12))}, {"trix": f"(t3 - {lag('t3')}) / ({lag('t3')} + 1e-10) * 100"}]
G(48, "tas_trix_signal", 38, cross("trix", "0", lag("trix"), "0"), stages=TRIX)
CH = [(10, "强多"), (3, "偏多"), (-3, "中性"), (-10, "偏空")]
G(49, "tas_roc_signal", 14, bands(f"((close - {lag('close', 12)}) / ({lag('close', 12)} + 1e-10) * 100)", CH, "强空"))
G(50, "tas_mtm_signal", 14, case((f"close > {lag('close', 12)}", "多头动量"), (f"close < {lag('close', 12)}", "空头动量"), default="动量平衡"))
G(51, "tas_psy_status", 14, bands(mean("CASE WHEN d > 0 THEN 100e0 WHEN d <= 0 THEN 0e0 END", 12), [(75, "超买"), (50, "偏强"), (25, "偏弱")], "超卖"))
VR = [{"uv": sm("CASE WHEN d > 0 THEN volume ELSE 0 END", 26), "nv": sm("CASE WHEN d < 0 THEN volume ELSE 0 END", 26), "ev": sm("CASE WHEN d = 0 THEN volume ELSE 0 END", 26)},
      {"vr": "(uv + ev / 2) / (nv + ev / 2 + 1e-10) * 100"}]
G(52, "tas_vr_status", 28, bands("vr", [(350, "超买"), (200, "偏多"), (70, "正常"), (40, "偏空")], "超卖"), stages=VR)
G(53, "tas_wad_status", 22, case((f"wad > {mean('wad', 20)}", "多头"), default="空头"),
  stages=[{"wad": run("sum(CASE WHEN close > pc THEN close - least(low, pc) WHEN close < pc THEN close - greatest(high, pc) ELSE 0e0 END)")}])
G(54, "tas_adx_status", 30, bands("adx", [(50, "极强趋势"), (40, "强趋势"), (25, "有趋势")], "无趋势"), stages=DMI)
G(55, "tas_tsi_signal", 52, bands("(a2 / (b2 + 1e-10) * 100)", [(20, "强多"), (0, "多头"), (-20, "空头")], "强空"),
  stages=[{"a1": ema("d", span(25), 1), "b1": ema("abs(d)", span(25), 1)}, {"a2": ema("a1", span(13), 1), "b2": ema("b1", span(13), 1)}])

# ---- volume --------------------------------------------------------------------------------------
G(56, "vol_single_ma", 21, bands(f"(volume / {mean('volume', 20)})", [(2, "巨量"), (1.5, "放量"), (0.8, "正常"), (0.5, "缩量")], "地量"))
G(57, "vol_double_ma", 22, cross(mean("volume", 5), mean("volume", 20), mean("volume", 5, 1), mean("volume", 20, 1)))
_DV = [{"dv": "volume - pv"}]
G(58, "vol_ti_suo", 6, case((f"{mn('dv', 4)} > 0", "递增"), (f"{mx('dv', 4)} < 0", "递减"), default="无序"), stages=_DV)
_gd = [(f"i >= {n} AND {cond}", label, f"{n}K") for n in (10, 9, 8, 7, 6) for cond, label in (
    (f"volume = {mx('volume', n)}", "高量柱"), (f"pv = {mx('volume', n)} AND volume < pv * 0.5", "高量黄金柱"), (f"volume = {mn('volume', n)}", "低量柱"))]
G(59, "vol_gao_di", 7, case(*[(x, a) for x, a, _ in _gd]), case(*[(x, b) for x, _, b in _gd], default="任意"))
_ly = "greatest(len(list_filter(list_distinct(q), lambda e: e < {x})), 1)"
G(60, "vol_window", 31, "CASE WHEN list_unique(q) > 1 THEN '高量N' || " + _ly.format(x="vmax") + " END", "CASE WHEN list_unique(q) > 1 THEN '低量N' || " + _ly.format(x="vmin") + " END",
  stages=[{"q": "quantile_cont(volume, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1]) OVER (w ROWS 29 PRECEDING)", "vmax": mx("volume", 5), "vmin": mn("volume", 5)}])
G(61, "vol_window_v2", 6, case(("list_position(v5, list_min(v5)) > list_position(v5, list_max(v5))", "先放后缩"), default="先缩后放"), stages=[{"v5": "list(volume) OVER (w ROWS 4 PRECEDING)"}])
G(62, "vol_break", 21, case((f"volume / {mean('volume', 19, 1)} >= 2", "放量突破"), default="未突破"))
_n = sm("CASE WHEN volume < pv * 0.5 THEN 1 ELSE 0 END", 4)
G(63, "vol_shrink", 6, case((f"{_n} >= 4", "持续缩量"), (f"{_n} >= 2", "部分缩量")))
G(64, "vol_ratio_signal", 6, bands(f"(volume / {mean('volume', 4, 1)})", [(3, "巨量"), (2, "大量"), (1, "放量"), (0.7, "正常"), (0.3, "缩量")], "地量"))
G(65, "vol_price_divergence", 21, case(
    (f"{mx('close', 10)} > {mx('close', 10, 10)} AND NOT {mx('volume', 10)} > {mx('volume', 10, 10)}", "量价顶背离"),
    (f"{mn('close', 10)} < {mn('close', 10, 10)} AND NOT {mn('volume', 10)} < {mn('volume', 10, 10)}", "量价底背离"), default="量价配合"))
G(66, "vol_vwap", 2, bands("((close / (tp * volume / volume) - 1) * 100)", [(2, "VWAP上方"), (0, "VWAP略上方"), (-2, "VWAP略下方")], "VWAP下方"))
G(67, "vol_pvt_signal", 22, case((f"pvt > {mean('pvt', 20)}", "多头"), default="空头"), stages=[{"pvt": run("sum(coalesce((close - pc) / (pc + 1e-10) * volume, 0))")}])
G(68, "vol_mfi_signal", 16, bands(f"(100 - 100 / (1 + {sm('pm', 14)} / ({sm('nm', 14)} + 1e-10)))", [(80, "超买"), (60, "偏多"), (40, "中性"), (20, "偏空")], "超卖"),
  stages=[{"pt": lag("tp")}, {"pm": "CASE WHEN tp > pt THEN tp * volume ELSE 0e0 END", "nm": "CASE WHEN tp <= pt THEN tp * volume ELSE 0e0 END"}])
G(69, "vol_volatility_ratio", 21, bands(f"({over('stddev_samp(volume)', 20)} / {mean('volume', 20)})", [(0.8, "量极不稳定"), (0.5, "量波动较大"), (0.3, "量波动正常")], "量波动较小"))
G(70, "vol_adi_signal", 22, case((f"adi > {mean('adi', 20)}", "资金流入"), default="资金流出"),
  stages=[{"adi": run("sum(((close - low) - (high - close)) / (high - low + 1e-10) * volume)")}])

# ---- position ------------------------------------------------------------------------------------
G(71, "pos_above_ma", 21, bands("((close / e - 1) * 100)", [(5, "远高于"), (2, "偏高于"), (0, "略高于"), (-2, "略低于"), (-5, "偏低于")], "远低于"), stages=[{"e": E(20)}])
G(72, "pos_ma_cross", 62, cross("close", mean("close", 60), "pc", mean("close", 60, 1), ("上穿", "下穿", "均线上方", "均线下方")))
_p = f"((close - {mn('low', 29, 1)}) / nullif({mx('high', 29, 1)} - {mn('low', 29, 1)}, 0))"
G(73, "pos_support_resistance", 31, case((f"{_p} > 0.9", "接近阻力"), (f"{_p} < 0.1", "接近支撑"), (f"{_p} > 0.5", "中上区间"), (f"{_p} IS NOT NULL", "中下区间")))
_h, _l = mx("high", 59, 1), mn("low", 59, 1)
G(74, "pos_high_low", 61, case((f"close > {_h}", "创新高"), (f"close < {_l}", "创新低"), (f"close > ({_h} + {_l}) / 2", "前高附近"), default="前低附近"))
G(75, "pos_gap_fill", 31, case(("k = 'up' AND close < e", "向上缺口已补"), ("k = 'up'", "向上缺口未补"), ("k = 'down' AND close > e", "向下缺口已补"), ("k = 'down'", "向下缺口未补")),
  stages=[{"gk": "CASE WHEN low > ph THEN 'up' WHEN high < pl THEN 'down' END", "gl": "CASE WHEN low > ph THEN low WHEN high < pl THEN pl END"},
          {"k": "last_value(gk IGNORE NULLS) OVER (w ROWS 28 PRECEDING)", "e": "last_value(gl IGNORE NULLS) OVER (w ROWS 28 PRECEDING)"}])
G(76, "pos_trend_line", 21, bands("((close - t) / abs(t) * 100)", [(3, "远高于趋势线"), (0, "趋势线上方"), (-3, "趋势线下方")], "远低于趋势线"),
  stages=[{"t": f"{mean('low', 20)} + {over('regr_slope(low, i)', 20)} * 9.5"}])
_fib = ["0.000", "0.236", "0.382", "0.500", "0.618", "0.786", "1.000"]
FIBS = [{"hi": mx("high", 60), "lo": mn("low", 60)}, {"fd": "list_transform([0, 0.236, 0.382, 0.5, 0.618, 0.786, 1], lambda f: abs(close - (hi - CAST(f AS DOUBLE) * (hi - lo))))"}]
G(77, "pos_fibonacci", 61, f"{_fib!r}[list_position(fd, list_min(fd))]", stages=FIBS)
PIV = [{"p": "(ph + pl + pc) / 3"}, {"r1": "2 * p - pl", "s1": "2 * p - ph", "r2": "p + (ph - pl)", "s2": "p - (ph - pl)"}]
G(78, "pos_pivot", 3, case(("close > r2", "R2上方"), ("close > r1", "R1上方"), ("close > p", "枢轴上方"), ("close > s1", "枢轴下方"), ("close > s2", "S1下方"), default="S2下方"), stages=PIV)
G(79, "pos_channel_position", 21, case(("x > 1", "通道上方"), ("x > 0.8", "上轨附近"), ("x < 0", "通道下方"), ("x < 0.2", "下轨附近"), ("x IS NOT NULL", "通道中部")),
  stages=[{"sl": over("regr_slope(close, i)", 21), "m": mean("close", 21), "vc": over("var_pop(close)", 21)}, {"sd": "sqrt(greatest(vc - sl * sl * 110e0 / 3, 0))"},
          {"x": "(close - (m + sl * 10 - 2 * sd)) / nullif(4 * sd, 0)"}])
G(80, "pos_price_zone", 61, bands(f"((close - {mn('close', 60)}) / nullif({mx('close', 60)} - {mn('close', 60)}, 0))", [(0.9, "高位区"), (0.7, "偏高区"), (0.3, "中间区"), (0.1, "偏低区")], "低位区"))
G(81, "pos_ma_band", 21, case(("close > greatest(a, z)", "均线上方"), ("close < least(a, z)", "均线下方"), default="均线之间"), stages=[{"a": E(5), "z": E(20)}])
G(82, "pos_round_number", 2, case(("dist < 0.5", "('接近' || CAST(near AS BIGINT) || '关口')"), ("dist < 2", "('临近' || CAST(near AS BIGINT) || '关口')"), default="远离关口"),
  stages=[{"rb": "greatest(pow(10, trunc(log10(close))), 1) / 10"}, {"near": "round_even(close / rb, 0) * rb"}, {"dist": "abs(close - near) / close * 100"}])
_bin = "least(floor(({x} - vlo) / (vhi - vlo) * 5), 4)"
G(83, "pos_volume_profile", 31, "CASE WHEN vhi > vlo THEN " + bands("(bv[1 + CAST(" + _bin.format(x="close") + " AS INT)] / list_max(bv))", [(0.8, "高量区"), (0.5, "中量区")], "低量区") + " END",
  stages=[{"vc": "list(close) OVER (w ROWS 29 PRECEDING)", "vv": "list(volume) OVER (w ROWS 29 PRECEDING)", "vlo": mn("close", 30), "vhi": mx("close", 30)},
          {"bv": "list_transform(range(0, 5), lambda k: coalesce(list_sum(list_transform(range(1, len(vc) + 1), lambda q: CASE WHEN " + _bin.format(x="vc[q]") + " = k THEN vv[q] ELSE 0 END)), 0))"}])
G(84, "pos_boll_position", 21, bands("((close - (mid - 2 * sd)) / nullif((mid + 2 * sd) - (mid - 2 * sd), 0))",
                                     [(1, "上轨上方"), (0.8, "上轨附近"), (0.5, "中轨上方"), (0.2, "中轨下方"), (0, "下轨附近")], "下轨下方"), stages=_bb)
G(85, "pos_kelt_position", 22, case(("close > e + 1.5 * a", "通道上方"), ("close > e", "中轨上方"), ("close > e - 1.5 * a", "中轨下方"), default="通道下方"),
  stages=[{"e": E(20), "a": mean("tr", 10)}])

# ---- statistics ----------------------------------------------------------------------------------
_z = lambda n: f"((close - {mean('close', n)}) / nullif({over('stddev_pop(close)', n)}, 0))"
G(86, "sta_mean_revert", 21, bands(_z(21), [(2, "超买"), (1, "偏多"), (-1, "中性"), (-2, "偏空")], "超卖"))
_rl = {f"r{n}": f"list_prepend(0e0, list(r) FILTER (r IS NOT NULL) OVER (w ROWS {n - 1} PRECEDING))" for n in (20, 60)}
G(87, "sta_volatility", 22, bands("(list_stddev_pop(r20) / nullif(list_stddev_pop(r60), 0))", [(1.5, "高波"), (1.2, "波率上升"), (0.8, "正常波率"), (0.5, "波率下降")], "低波"), stages=[_rl])
G(88, "sta_vol_ratio", 22, bands(f"({over('stddev_pop(r)', 6)} / nullif({over('stddev_pop(r)', 21)}, 0))", [(1.5, "波动扩大"), (1.0, "波动略增"), (0.7, "波动平稳")], "波动收窄"))
_AC = [{"y": "list(r) OVER (w ROWS 19 PRECEDING)"}, {"x": "list_prepend(0e0, y[1:19])"}, {"mxx": "list_avg(x)", "myy": "list_avg(y)"},
       {"ac": "list_avg(list_transform(range(1, 21), lambda q: (x[q] - mxx) * (y[q] - myy))) / nullif(list_stddev_pop(x) * list_stddev_pop(y), 0)"}]
G(89, "sta_autocorr", 22, bands("ac", [(0.3, "正相关"), (0.1, "弱正相关"), (-0.1, "不相关"), (-0.3, "弱负相关")], "负相关"), stages=_AC)
_M31 = [{"y": "list_prepend(0e0, list(r) OVER (w ROWS 29 PRECEDING))"}, {"mu": "list_avg(y)"},
        {f"q{k}": f"list_avg(list_transform(y, lambda v: pow(v - mu, {k})))" for k in (2, 3, 4)}]
G(90, "sta_skewness", 32, bands("(q3 / nullif(pow(q2, 1.5), 0) * sqrt(31e0 * 30) / 29)", [(1, "右偏极强"), (0.5, "右偏"), (-0.5, "对称"), (-1, "左偏")], "左偏极强"), stages=_M31)
G(91, "sta_kurtosis", 32, bands("(((q4 / nullif(q2 * q2, 0) - 3) * 32 + 6) * 30 / (29e0 * 28))", [(5, "尖峰厚尾"), (2, "轻厚尾"), (-1, "近似正态")], "平坦薄尾"), stages=_M31)
G(92, "sta_hurst", 101, "NULL", sql=False)
G(93, "sta_z_score", 21, bands(_z(20), [(2, "Z>2"), (1, "Z>1"), (0, "0<Z<1"), (-1, "-1<Z<0"), (-2, "Z<-1")], "Z<-2"))
G(94, "sta_percentile", 61, bands("(len(list_filter(c60, lambda v: v < close)) / 60e0 * 100)", [(90, "极高百分位"), (70, "高百分位"), (30, "中百分位"), (10, "低百分位")], "极低百分位"),
  stages=[{"c60": "list(close) OVER (w ROWS 59 PRECEDING)"}])
G(95, "sta_regime", 62, case(("t > 2 AND v < 2", "低波趋势"), ("t > 2", "高波趋势"), ("v < 1.5", "低波盘整"), default="高波盘整"),
  stages=[{"t": f"abs({over('regr_slope(close, i)', 60)} / {mean('close', 60)} * 100)", "v": "list_stddev_pop(list_prepend(0e0, list(r) FILTER (r IS NOT NULL) OVER (w ROWS 58 PRECEDING))) * 100"}])
G(96, "sta_consecutive", 11, case(("s > 0", "('连涨' || CAST(i - st + 1 AS BIGINT))"), ("s < 0", "('连跌' || CAST(i - st + 1 AS BIGINT))"), default="无连续"),
  stages=[{"s": "sign(d)"}, {"tn": f"CASE WHEN s IS DISTINCT FROM {lag('s')} THEN i END"}, {"st": run("max(tn)")}])
G(97, "sta_momentum_roc", 14, bands(f"((close / {lag('close', 12)} - 1) * 100)", CH, "强空"))


# ---- candlesticks --------------------------------------------------------------------------------
class K:
    """SQL of the bar k steps back."""

    def __init__(self, k=0):
        self.o, self.h, self.l, self.c = (x if k == 0 else f"({lag(x, k)})" for x in ("open", "high", "low", "close"))
        self.up, self.dn = f"{self.c} > {self.o}", f"{self.c} < {self.o}"
        self.body = f"abs({self.c} - {self.o})"
        self.us, self.ls = f"({self.h} - greatest({self.c}, {self.o}))", f"(least({self.c}, {self.o}) - {self.l})"
        self.top, self.bot = f"greatest({self.c}, {self.o})", f"least({self.c}, {self.o})"
        self.doji = f"({self.h} = {self.l} OR {self.body} / nullif({self.h} - {self.l}, 0) < 0.001)"


X, P, Q = K(), K(1), K(2)
_all3 = lambda f: " AND ".join(f(k) for k in (Q, P, X))
_stars = _all3(lambda k: k.doji)
G(98, "jcc_san_xing_xian", 4, case((f"{_stars} AND {X.c} > {Q.c}", "三星看多"), (_stars, "三星看空")))
G(99, "jcc_ten_mo", 2, case((f"{X.doji} AND {X.ls} > {X.us} * 2", "蜻蜓十字"), (f"{X.doji} AND {X.us} > {X.ls} * 2", "墓碑十字"), (X.doji, "长腿十字")))
_pm = f"({P.o} + {P.c}) / 2"
G(100, "jcc_wu_yun_gai_ding", 3, case((f"{P.up} AND {X.dn} AND {X.o} > {P.h} AND {X.c} < {_pm}", "乌云盖顶")))
G(101, "jcc_ci_tou", 3, case((f"{P.dn} AND {X.up} AND {X.o} < {P.l} AND {X.c} > {_pm}", "刺透")))
_sf = []
for _n in (5, 6, 7, 8):
    _a, _mids = K(_n - 1), [K(k) for k in range(1, _n - 1)]
    _sf.append((f"i >= {_n} AND {_a.up} AND {X.up} AND {X.c} > {_a.h} AND " + " AND ".join(f"{m.dn} AND {m.h} < {_a.h} AND {m.l} > {_a.o}" for m in _mids), "上升三法", f"{_n}K"))
    _sf.append((f"i >= {_n} AND {_a.dn} AND {X.dn} AND {X.c} < {_a.l} AND " + " AND ".join(f"{m.up} AND {m.l} > {_a.l} AND {m.h} < {_a.o}" for m in _mids), "下降三法", f"{_n}K"))
G(102, "jcc_san_fa", 6, case(*[(x, a) for x, a, _ in _sf]), case(*[(x, b) for x, _, b in _sf], default="任意"))
_big = f"{Q.body} > 2 * {P.body} AND {X.body} > 2 * {P.body}"
G(103, "jcc_xing_xian", 4, case((f"{Q.dn} AND {X.up} AND {_big} AND {P.c} < {Q.c}", "晨星"), (f"{Q.up} AND {X.dn} AND {_big} AND {P.c} > {Q.c}", "暮星")))
_so = f"abs({P.o} - {X.o}) / greatest({P.o}, 1) < 0.002"
G(104, "jcc_fen_shou_xian", 3, case((f"{_so} AND {P.up} AND {X.dn}", "看空分手"), (f"{_so} AND {P.dn} AND {X.up}", "看多分手")))
G(105, "jcc_zhu_huo_xian", 3, case((f"{P.dn} AND {X.up} AND {X.o} <= {P.c} AND {X.c} >= {P.o}", "看多抓获"), (f"{P.up} AND {X.dn} AND {X.o} >= {P.c} AND {X.c} <= {P.o}", "看空抓获")))
_in = f"{P.top} > {X.top} AND {P.bot} < {X.bot}"
G(106, "jcc_yun_xian", 3, case((f"{_in} AND {P.up} AND {X.dn}", "看空孕线"), (f"{_in} AND {P.dn} AND {X.up}", "看多孕线"), (_in, "十字孕线")))
G(107, "jcc_ping_tou", 3, case((f"abs({P.h} - {X.h}) < greatest({P.h}, 1) * 0.002", "平头顶"), (f"abs({P.l} - {X.l}) < greatest({P.h}, 1) * 0.002", "平头底")))
G(108, "jcc_two_crow", 4, case((f"{Q.up} AND {P.dn} AND {X.dn} AND {P.o} > {Q.c} AND {X.o} > {P.o} AND {X.c} < {P.c}", "两只乌鸦")))
G(109, "jcc_three_crow", 4, case((_all3(lambda k: k.dn), "三只乌鸦")))
G(110, "jcc_szx", 3, case((f"{X.doji} AND {P.up}", "阳后十字"), (f"{X.doji} AND {P.dn}", "阴后十字"), (X.doji, "十字")))
G(111, "jcc_san_szx", 4, case((_stars, "三星十字")))
_sc = f"abs({P.c} - {X.c}) / greatest({P.c}, 1) < 0.002"
G(112, "jcc_fan_ji_xian", 3, case((f"{_sc} AND {P.up} AND {X.dn}", "看空反击"), (f"{_sc} AND {P.dn} AND {X.up}", "看多反击")))
_ev = f"pow({X.body} - {P.body}, 2) / 4 < 0.2"
G(114, "jcc_gap_yin_yang", 4, case((f"least({X.l}, {P.l}) > {Q.h} AND {P.up} AND {X.dn} AND {_ev}", "向上跳空"), (f"greatest({X.h}, {P.h}) < {Q.l} AND {P.dn} AND {X.up} AND {_ev}", "向下跳空")))
_tx = []
for _n in (5, 6, 7, 8, 9):
    _a = K(_n - 1)
    _e = f"i >= {_n} AND least({_a.body}, {X.body}) >= greatest({', '.join(K(k).body for k in range(1, _n - 1))})"
    _tx.append((f"{_e} AND {_a.up} AND {X.dn} AND {over('var_pop(high)', _n - 2, 1)} < 0.5", "顶部", f"{_n}K"))
    _tx.append((f"{_e} AND {_a.dn} AND {X.up} AND {over('var_pop(low)', _n - 2, 1)} < 0.5", "底部", f"{_n}K"))
G(115, "jcc_ta_xing", 6, case(*[(x, a) for x, a, _ in _tx]), case(*[(x, b) for x, _, b in _tx], default="任意"))
_sp = "nullif(high - low, 0)"
G(116, "jcc_zhuo_yao_dai_xian", 2, case((f"abs(open - low) / {_sp} < 0.05 AND close > open AND {X.body} / {_sp} > 0.6", "看多捉腰带"),
                                        (f"abs(open - high) / {_sp} < 0.05 AND close < open AND {X.body} / {_sp} > 0.6", "看空捉腰带")))
_rs = f"{lag('close', 4)} > pc"
_lo = f"high > low AND {X.ls} > {X.body} * 2 AND {X.us} < {X.body} * 0.5"
_up = f"high > low AND {X.us} > {X.body} * 2 AND {X.ls} < {X.body} * 0.5"
G(117, "jcc_hammer", 6, case((f"{_lo} AND {_rs}", "上吊线"), (_lo, "锤子线"), (f"{_up} AND {_rs}", "射击之星"), (_up, "倒锤子")))
G(118, "jcc_engulfing", 3, case((f"{P.dn} AND {X.up} AND {X.o} <= {P.c} AND {X.c} >= {P.o} AND {X.body} > {P.body}", "看涨吞没"),
                                (f"{P.up} AND {X.dn} AND {X.o} >= {P.c} AND {X.c} <= {P.o} AND {X.body} > {P.body}", "看跌吞没")))
G(119, "jcc_harami_cross", 3, case((f"{X.doji} AND {_in} AND {P.up}", "看空十字孕线"), (f"{X.doji} AND {_in} AND {P.dn}", "看多十字孕线"), (f"{X.doji} AND {_in}", "十字孕线")))
_tw = _all3(lambda k: k.up) + f" AND {X.c} > {P.c} AND {P.c} > {Q.c} AND {X.o} > {P.o} AND {P.o} > {Q.o}"
_hw = " OR ".join(f"{k.us} > {k.body} * 0.3" for k in (Q, P, X))
G(120, "jcc_three_white", 4, case((f"{_tw} AND ({_hw})", "受阻三白兵"), (_tw, "三白兵")))
_tb = _all3(lambda k: k.dn) + f" AND {X.c} < {P.c} AND {P.c} < {Q.c} AND {X.o} < {P.o} AND {P.o} < {Q.o}"
_hb = " OR ".join(f"{k.ls} > {k.body} * 0.3" for k in (Q, P, X))
G(121, "jcc_three_black", 4, case((f"{_tb} AND ({_hb})", "受撑三黑鸦"), (_tb, "三黑鸦")))
G(122, "jcc_kicking", 3, case(("low > ph", "看多跳空"), ("high < pl", "看空跳空")))
