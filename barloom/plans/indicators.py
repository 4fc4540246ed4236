"""Indicator queries over brand-week bars, minute bars and multi-level bars."""

import re

from pyspark.sql import functions as F

from barloom.functions.recursive import span, with_recursions
from barloom.functions.windows import ladder
from barloom.operators import bars as B
from barloom.operators import indicators as I
from barloom.plans import bindings as D
from barloom.plans import signals as G
from barloom.plans.frames import BASE, MACD, WIN, bands, ema, frame_sql, over, run, span as sp, staged
from barloom.plans.registry import query

c = F.col
S = I.S


def _base(spark, sf):
    return I.base_columns(D.brand_bars(spark, sf, "week"))


def ind(name, cols, build, stages):
    """cols: 'name:spec ...'; build(df) -> df with those columns; stages: SQL stages defining them."""
    names = [x.split(":")[0] for x in cols.split()]

    @query(name, "code:s ts:d " + cols, frame_sql("code, ts, " + ", ".join(names), stages))
    def run_ind(spark, sf):
        return build(_base(spark, sf))


def col(name, fn):
    return lambda df: df.withColumn(name, fn())


def loose(expr, n):
    return over(expr, n, need=1)


ind("i01_ema", "ema12:f4", lambda df: with_recursions(df, [("ema12", "ema", "close", span(12))]), [{"ema12": ema("close", sp(12))}])
ind("i02_sma", "loose20:f4 strict20:f4", lambda df: df.select("*", I.sma("close", 20).alias("loose20"), I.sma("close", 20, loose=False).alias("strict20")),
    [{"loose20": loose("avg(close)", 20), "strict20": over("avg(close)", 20)}])
ind("i03_wma", "wma5:f4", col("wma5", lambda: I.wma("close", 5)),
    [{"wma5": "(lag(close,4) OVER w + 2 * lag(close,3) OVER w + 3 * lag(close,2) OVER w + 4 * lag(close,1) OVER w + 5 * close) / 15"}])
ind("i04_macd", "dif:f4 dea:f4 bar:f4", I.macd_columns, MACD)
_GL = {"g": "CASE WHEN d IS NOT NULL THEN greatest(d, 0) END", "l": "CASE WHEN d IS NOT NULL THEN greatest(-d, 0) END"}
_RSI14 = [_GL, {"ag": ema("g", 1 / 14, 1), "al": ema("l", 1 / 14, 1)}, {"rsi": "100 - 100 / (1 + ag / nullif(al, 0))"}]
ind("i05_rsi_wilder", "rsi:f6", lambda df: with_recursions(I.gain_loss(df), I.rsi_recursion(14)).withColumn("rsi", I.wilder_rsi(14)), _RSI14)
ind("i06_rsi_simple", "rsi:f6", col("rsi", lambda: I.rsi_simple(14)), G.RSI_SIMPLE)
_KDJ = [{"rsv": f"(close - {loose('min(low)', 9)}) / ({loose('max(high)', 9)} - {loose('min(low)', 9)} + 1e-10) * 100"}, {"k": ema("rsv", 1 / 3)}, {"dd": ema("k", 1 / 3)}, {"j": "3 * k - 2 * dd"}]
ind("i07_kdj", "k:f6 dd:f6 j:f6", lambda df: with_recursions(df.withColumn("rsv", I.rsv(9)), I.KDJ).withColumn("j", c("k") * 3 - c("dd") * 2), _KDJ)


def _boll(df):
    up, mid, lo = I.bollinger()
    return df.select("*", up.alias("up"), mid.alias("mid"), lo.alias("lo"))


_BOLL = [{"mid": loose("avg(close)", 20), "sd": loose("stddev_samp(close)", 20)}, {"up": "mid + 2 * sd", "lo": "mid - 2 * sd"}]
ind("i08_bollinger", "up:f4 mid:f4 lo:f4", _boll, _BOLL)
ind("i09_atr", "atr:f4", col("atr", lambda: I.atr(14)), [{"atr": loose("avg(tr)", 14)}])
ind("i10_obv", "obv:f2", col("obv", I.obv), G.OBV)
ind("i11_vwap_running", "vwap:f4", col("vwap", I.vwap_running), [{"vwap": f"{run('sum(close * volume)')} / {run('sum(volume)')}"}])
ind("i12_roc", "roc:f6", col("roc", lambda: I.roc(5)), [{"roc": "(close / lag(close, 5) OVER w - 1) * 100"}])


def _div(n):
    hi3, hib, lo3, lob = over("max(bar)", 3), over("max(bar)", n - 3, 3), over("min(bar)", 3), over("min(bar)", n - 3, 3)
    return (f"CASE WHEN i + 1 >= {n + 2} THEN CASE WHEN close >= {over('max(close)', n)} * 0.995 AND {hi3} < {hib} * 0.85 AND {hi3} > 0 THEN 'top' "
            f"WHEN close <= {over('min(close)', n)} * 1.005 AND {lo3} > {lob} * 0.85 AND {lo3} < 0 THEN 'bottom' END END")


def _rdiv(n):
    return (f"CASE WHEN i + 1 >= {n + 2} THEN CASE WHEN close >= {over('max(close)', n)} * 0.995 AND rsi < {loose('max(rsi)', n)} - 5 THEN 'rsi_top' "
            f"WHEN close <= {over('min(close)', n)} * 1.005 AND rsi > {loose('min(rsi)', n)} + 5 THEN 'rsi_bottom' END END")


ind("i13_macd_divergence", "div:s", lambda df: I.macd_columns(df).withColumn("div", I.macd_divergence(10)), [*MACD, {"div": _div(10)}])
ind("i14_rsi_divergence", "div:s", lambda df: with_recursions(I.gain_loss(df), I.rsi_recursion(14)).withColumn("rsi", I.wilder_rsi(14)).withColumn("div", I.rsi_divergence(10)),
    [*_RSI14, {"div": _rdiv(10)}])
ind("i15_cci", "cci:f6", col("cci", lambda: I.cci(14)), G.CCI)


@query("i16_sar", "code:s ts:d sar:f6", G.SAR + "\n---\nSELECT code, ts, sar FROM sarr")
def sar(spark, sf):
    return with_recursions(_base(spark, sf), [("sar", "sar")])


ind("i17_williams_r", "wr:f6", col("wr", lambda: I.williams_r(14)), [{"wr": f"({over('max(high)', 14)} - close) / ({over('max(high)', 14)} - {over('min(low)', 14)} + 1e-10) * 100"}])
ind("i18_dmi_adx", "pdi:f6 mdi:f6 adx:f6", lambda df: I.with_stages(df, I.dmi_stages()), G.DMI)
ind("i19_trix", "trix:f6", lambda df: with_recursions(df, I.TRIX).withColumn("trix", (c("t3") - S.lag("t3")) / (S.lag("t3") + 1e-10) * 100), G.TRIX)
ind("i20_mtm", "mtm:f8", col("mtm", lambda: I.mtm(12)), [{"mtm": "close - lag(close, 12) OVER w"}])
ind("i21_psy", "psy:f6", col("psy", lambda: I.psy(12)), [{"psy": over("avg(CASE WHEN d > 0 THEN 100e0 WHEN d <= 0 THEN 0e0 END)", 12)}])
ind("i22_vr", "vr:f6", col("vr", lambda: I.volume_ratio(26)), G.VR)
ind("i23_keltner", "mid:f4 up:f4 lo:f4", lambda df: with_recursions(df.withColumn("a", I.atr(10, loose=False)), [("mid", "ema", "close", span(20))]).select(
    "*", (c("mid") + c("a") * 1.5).alias("up"), (c("mid") - c("a") * 1.5).alias("lo")),
    [{"mid": ema("close", sp(20)), "a": over("avg(tr)", 10)}, {"up": "mid + 1.5 * a", "lo": "mid - 1.5 * a"}])
ind("i24_pivot_points", "p:f6 r1:f6 s1:f6 r2:f6 s2:f6", lambda df: df.select("*", *[v.alias(k) for k, v in I.pivot_points().items()]), G.PIV)
ind("i25_fibonacci", "f236:f4 f618:f4", lambda df: df.withColumn("fib", I.fibonacci(60)).select("*", c("fib")[1].alias("f236"), c("fib")[4].alias("f618")),
    [{"hi": over("max(high)", 60), "lo": over("min(low)", 60)}, {"f236": "hi - 0.236 * (hi - lo)", "f618": "hi - 0.618 * (hi - lo)"}])

# ---- period analysis -----------------------------------------------------------------------------
_L = "lag({}) OVER w"
PERIOD = [
    {**{f"ma{n}": loose("avg(close)", n) for n in (5, 10, 20, 60)}, **_BOLL[0], **_KDJ[0], **_GL, **MACD[0], "atr": loose("avg(tr)", 14), **G.OBV[0]},
    {**_KDJ[1], **MACD[1], **_RSI14[1], **_BOLL[1]},
    {**_KDJ[2], **MACD[2], **_RSI14[2], "boll_pos": "(close - mid) / (up - mid + 1e-10)"},
    {**MACD[3], "j": "3 * k - 2 * dd", "r2": "round(rsi, 2)", "obv5": over("avg(obv)", 5, 4, need=1), "change10": "(close / lag(close, 9) OVER w - 1) * 100"},
    {"ma_state": "CASE WHEN ma5 > ma10 AND ma10 > ma20 AND ma20 > ma60 THEN 'bull' WHEN ma5 < ma10 AND ma10 < ma20 AND ma20 < ma60 THEN 'bear' ELSE 'mixed' END",
     "macd_state": f"CASE WHEN bar > 0 AND {_L.format('bar')} < 0 THEN 'golden' WHEN bar < 0 AND {_L.format('bar')} > 0 THEN 'dead' WHEN bar > {_L.format('bar')} THEN 'expand' ELSE 'shrink' END",
     "rsi_zone": "CASE WHEN r2 > 70 THEN 'overbought' WHEN r2 < 30 THEN 'oversold' ELSE 'normal' END",
     "kdj_state": f"CASE WHEN k > dd AND {_L.format('k')} <= {_L.format('dd')} THEN 'golden' WHEN k < dd AND {_L.format('k')} >= {_L.format('dd')} THEN 'dead' WHEN j > 80 THEN 'overbought' WHEN j < 20 THEN 'oversold' ELSE 'running' END",
     "boll_zone": "CASE WHEN boll_pos > 0.8 THEN 'upper' WHEN boll_pos > 0.2 THEN 'above_mid' WHEN boll_pos > -0.2 THEN 'mid' WHEN boll_pos > -0.8 THEN 'below_mid' ELSE 'lower' END",
     "obv_trend": "CASE WHEN obv > obv5 THEN 'up' ELSE 'down' END", "trend": "CASE WHEN change10 > 3 THEN 'up' WHEN change10 < -3 THEN 'down' ELSE 'flat' END"},
    {"score": """CASE WHEN i >= 9 THEN greatest(0, least(100, 50 + CASE ma_state WHEN 'bull' THEN 15 WHEN 'bear' THEN -15 ELSE 0 END + CASE WHEN close > ma20 THEN 5 ELSE -5 END
  + CASE WHEN close > ma60 THEN 5 ELSE -5 END + CASE macd_state WHEN 'golden' THEN 15 WHEN 'expand' THEN 8 WHEN 'shrink' THEN -5 ELSE -15 END + CASE WHEN dif > 0 THEN 5 ELSE -5 END
  + CASE WHEN r2 BETWEEN 45 AND 70 THEN 10 WHEN r2 > 70 THEN -5 WHEN r2 < 30 THEN 5 ELSE 0 END
  + CASE kdj_state WHEN 'golden' THEN 10 WHEN 'oversold' THEN 8 WHEN 'overbought' THEN -5 WHEN 'dead' THEN -10 ELSE 0 END
  + CASE boll_zone WHEN 'upper' THEN -5 WHEN 'above_mid' THEN 5 WHEN 'below_mid' THEN -3 WHEN 'lower' THEN 3 ELSE 0 END + CASE obv_trend WHEN 'up' THEN 5 ELSE -5 END)) ELSE 50 END"""}]
_states = "ma_state macd_state rsi_zone kdj_state boll_zone obv_trend trend".split()


@query("i26_period_analysis", "code:s ts:d atr_pct:f4 " + " ".join(f"{x}:s" for x in _states),
       frame_sql("code, ts, atr / close * 100 AS atr_pct, " + ", ".join(_states), PERIOD))
def period_analysis(spark, sf):
    return I.period_frame(D.brand_bars(spark, sf, "week"))


@query("i27_period_score", "code:s ts:d score:i", frame_sql("code, ts, score", PERIOD))
def period_score(spark, sf):
    return period_analysis(spark, sf)


def _level_sql(level, bars_sql, name):
    text, last = staged(PERIOD, "", f"{level}b")
    text = re.sub(r"\bst(\d)\b", rf"{level}st\1", text)
    base = bars_sql + f""",
{level}b0 AS (SELECT *, row_number() OVER w - 1 AS i, lag(close) OVER w AS pc FROM {name} {WIN}),
{level}b AS (SELECT *, close - pc AS d, greatest(high - low, coalesce(abs(high - pc), 0), coalesce(abs(low - pc), 0)) AS tr FROM {level}b0)"""
    return base + text, f"{level}{last}"


def _short_ema_levels():
    parts, finals = [], []
    for lv, bars_sql, name in (("month", D.BRAND_MONTH, "mbars"), ("week", D.BRAND_WEEK, "bars")):
        text, last = _level_sql(lv, bars_sql, name)
        parts.append(text.strip().lstrip(","))
        finals.append(f"SELECT code, '{lv}' AS level, score FROM {last} QUALIFY row_number() OVER (PARTITION BY code ORDER BY ts DESC) = 1")
    return ",\n".join(parts), " UNION ALL ".join(f"({x})" for x in finals)


_lv_text, _lv_union = _short_ema_levels()


@query("i28_multi_period_composite", "code:s composite:f1 strength:s", _lv_text + f""",
lv AS ({_lv_union}),
cmp AS (SELECT code, floor((coalesce(max(score) FILTER (level = 'month'), 50) * 30 + coalesce(max(score) FILTER (level = 'week'), 50) * 35 + 50 * 35 + 5) / 10) / 10 AS composite FROM lv GROUP BY 1)
---
SELECT *, CASE WHEN composite >= 75 THEN 'strong' WHEN composite >= 60 THEN 'firm' WHEN composite >= 45 THEN 'neutral' WHEN composite >= 30 THEN 'soft' ELSE 'weak' END AS strength FROM cmp""")
def multi_period(spark, sf):
    """Month and week levels of every brand; the day level is absent here and counts as neutral."""
    rows = None
    for lv in ("month", "week"):
        x = B.last_bars(I.period_frame(D.brand_bars(spark, sf, lv)).select("code", "ts", "score"), 1)
        x = x.select("code", F.lit(lv).alias("level"), "score")
        rows = x if rows is None else rows.unionByName(x)
    return I.composite_levels(rows)


@query("i29_support_resistance", "code:s ts:d close:f8 support:f6 resistance:f6", frame_sql(
    "code, ts, close, list_max(list_filter([l20, lo, mid], lambda x: x < close * 1.05)) AS support, list_min(list_filter([h20, up], lambda x: x > close * 0.95)) AS resistance",
    [{"l20": over("min(low)", 20), "h20": over("max(high)", 20), **_BOLL[0]}, _BOLL[1]], where="WHERE l20 IS NOT NULL"))
def support(spark, sf):
    return I.support_resistance(D.brand_bars(spark, sf, "week"))


# ---- minute level --------------------------------------------------------------------------------
def _minute_base(minutes, name, pre):
    return D.event_bars_sql(minutes, "event_type", name) + f""",
{pre}b0 AS (SELECT *, row_number() OVER w - 1 AS i, lag(close) OVER w AS pc, CAST(ts AS DATE) AS dy FROM {name} {WIN}),
{pre}b AS (SELECT *, close - pc AS d, volume / avg(volume) OVER (v ROWS 4 PRECEDING) AS vol_ratio, coalesce(close - lag(close) OVER v, 0) AS chg,
  sum(amount) OVER (v ROWS UNBOUNDED PRECEDING) / sum(volume) OVER (v ROWS UNBOUNDED PRECEDING) AS vwap FROM {pre}b0 WINDOW v AS (PARTITION BY code, dy ORDER BY ts))"""


def _chunked_ema(x, a, start=0, chunk=100):
    return ema(x, a, start)


MINUTE = [{**_GL, **MACD[0], "roc": "(close / lag(close, 5) OVER w - 1) * 100", "vwap_dev": "(close / vwap - 1) * 100"},
          {**MACD[1], "ag": ema("g", 1 / 6, 1), "al": ema("l", 1 / 6, 1)}, {**MACD[2], **_RSI14[2]}, MACD[3],
          {"divergence": f"coalesce({_div(20)}, {_rdiv(20)})", "pb": "lag(bar) OVER w",
           "volume_price": "CASE WHEN chg > 0 AND vol_ratio > 1.1 THEN 'up_more' WHEN chg > 0 AND vol_ratio < 0.9 THEN 'up_less' WHEN chg < 0 AND vol_ratio > 1.1 THEN 'down_more' WHEN chg < 0 AND vol_ratio < 0.9 THEN 'down_less' ELSE 'neutral' END"},
          {"buy": "CASE WHEN bar > 0 AND bar > pb THEN 2 WHEN bar > 0 THEN 1 ELSE 0 END + CASE WHEN dif > 0 THEN 1 ELSE 0 END + CASE WHEN rsi BETWEEN 40 AND 65 THEN 1 WHEN rsi < 35 THEN 1 ELSE 0 END + CASE volume_price WHEN 'up_more' THEN 2 WHEN 'down_less' THEN 1 ELSE 0 END + CASE WHEN roc > 1 THEN 1 ELSE 0 END",
           "sell": "CASE WHEN bar > 0 THEN 0 WHEN bar < 0 AND bar < pb THEN 2 ELSE 1 END + CASE WHEN dif > 0 THEN 0 ELSE 1 END + CASE WHEN rsi > 70 THEN 2 ELSE 0 END + CASE volume_price WHEN 'down_more' THEN 2 WHEN 'up_less' THEN 1 ELSE 0 END + CASE WHEN roc < -1 THEN 1 ELSE 0 END"},
          {"direction": "CASE WHEN buy >= sell + 2 THEN 'buy' WHEN sell >= buy + 2 THEN 'sell' ELSE 'neutral' END"},
          {"score": "round(greatest(0, least(10, 5e0 + CASE direction WHEN 'buy' THEN 2 WHEN 'sell' THEN -2 ELSE 0 END + CASE volume_price WHEN 'up_more' THEN 1 WHEN 'down_less' THEN 0.5 WHEN 'up_less' THEN -0.5 WHEN 'down_more' THEN -1 ELSE 0 END + CASE WHEN bar > 0 THEN 0.5 ELSE -0.5 END + CASE WHEN rsi BETWEEN 40 AND 65 THEN 0.5 WHEN rsi > 75 OR rsi < 25 THEN -0.5 ELSE 0 END + CASE WHEN divergence LIKE '%top' THEN -1.5 WHEN divergence LIKE '%bottom' THEN 1 ELSE 0 END + CASE WHEN round(vwap_dev, 2) > 2 THEN -0.5 WHEN round(vwap_dev, 2) < -2 THEN 0.3 ELSE 0 END)), 1)"}]
_mtext, _mlast = staged(MINUTE, _minute_base(120, "ebars", ""), "b")


def _minute(spark, sf, minutes=120):
    return I.minute_frame(D.event_bars(spark, sf, minutes))


@query("i11_vwap_day", "code:s ts:t vwap:f8", _minute_base(120, "ebars", "") + "\n---\nSELECT code, ts, vwap FROM b")
def vwap_day(spark, sf):
    return D.event_bars(spark, sf, 120).withColumn("day", F.to_date("ts")).withColumn("vwap", I.vwap_day(c("day")))


@query("i30_minute_analysis", "code:s ts:t volume_price:s vol_ratio:f4 vwap_dev:f4 divergence:s", f"{_mtext}\n---\nSELECT * FROM {_mlast}")
def minute_analysis(spark, sf):
    return _minute(spark, sf)


@query("i31_direction_vote", "code:s ts:t direction:s", f"{_mtext}\n---\nSELECT * FROM {_mlast}")
def direction(spark, sf):
    return _minute(spark, sf)


@query("i32_minute_score", "code:s ts:t score:f1", f"{_mtext}\n---\nSELECT * FROM {_mlast}")
def minute_score(spark, sf):
    return _minute(spark, sf)


@query("i33_composite_signal", "code:s signal:s strength:f1", f"""{_mtext},
lat AS (SELECT code, direction, score FROM {_mlast} QUALIFY row_number() OVER (PARTITION BY code ORDER BY ts DESC) = 1),
ws AS (SELECT code, CASE direction WHEN 'buy' THEN 1 WHEN 'sell' THEN -1 ELSE 0 END * 0.67e0 / 10.01e0 AS dv, (score - 5) * 0.67e0 / 10.01e0 + 5 AS st FROM lat)
---
SELECT code, CASE WHEN dv > 0.25 THEN 'buy' WHEN dv < -0.25 THEN 'sell' ELSE 'neutral' END AS signal, round(st, 1) AS strength FROM ws""")
def composite_signal(spark, sf):
    lat = B.last_bars(_minute(spark, sf).select("code", "ts", "direction", "score"), 1)
    return I.composite_signal(lat.withColumn("level", F.lit("120min")))


# ---- realised volatility -------------------------------------------------------------------------
_LR = [{"lr": "ln(close / pc)"}]
ind("i34_vol_close", "vol:f6", lambda df: df.withColumn("lr", I.log_return()).withColumn("vol", I.vol_close(20)), [*_LR, {"vol": f"{over('stddev_samp(lr)', 20)} * sqrt(252e0)"}])


def _rv(term):
    return [{"tm": term}, {"vol": f"CASE WHEN i >= 20 THEN sqrt(greatest({over('sum(tm)', 20)} / 19, 0) * 252) END"}]


ind("i35_vol_parkinson", "vol:f6", col("vol", I.vol_parkinson), _rv("pow(ln(high / low), 2) / (4 * ln(2e0))"))
ind("i36_vol_garman_klass", "vol:f6", col("vol", I.vol_garman_klass), _rv("0.5 * pow(ln(high / low), 2) - (2 * ln(2e0) - 1) * pow(ln(close / open), 2)"))
ind("i37_vol_rogers_satchell", "vol:f6", col("vol", I.vol_rogers_satchell), _rv("ln(high / open) * (ln(high / open) - ln(close / open)) + ln(low / open) * (ln(low / open) - ln(close / open))"))
ind("i38_rolling_vol", "vol:f6", lambda df: df.withColumn("lr", I.log_return()).withColumn("vol", I.vol_close(60)), [*_LR, {"vol": f"{over('stddev_samp(lr)', 60)} * sqrt(252e0)"}])
_WINS = (20, 60, 90, 252)
ind("i39_multi_window_vol", " ".join(f"vol{n}:f6" for n in _WINS), lambda df: df.withColumn("lr", I.log_return()).select("*", *[I.vol_close(n).alias(f"vol{n}") for n in _WINS]),
    [*_LR, {f"vol{n}": f"{over('stddev_samp(lr)', n)} * sqrt(252e0)" for n in _WINS}])


@query("i40_series_trend", "code:s ts:d rel_slope:f8 volatility:f8 trend:s", frame_sql(
    "code, ts, rel_slope, volatility, CASE WHEN rel_slope > 0.01 THEN 'increasing' WHEN rel_slope < -0.01 THEN 'decreasing' ELSE 'stable' END AS trend",
    [{"vr": "volume / pv - 1"}, {"rel_slope": f"CASE WHEN i >= 1 THEN {loose('regr_slope(volume, i)', 20)} / {loose('avg(volume)', 20)} END", "volatility": f"coalesce({loose('stddev_pop(vr)', 19)}, 0)"}]))
def series_trend(spark, sf):
    return I.series_trend(D.brand_bars(spark, sf, "week"), "volume", 20)
