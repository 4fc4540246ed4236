"""Factor research queries."""

from pyspark.sql import functions as F

from barloom.operators import factors as Fx
from barloom.plans import bindings as D
from barloom.plans.registry import query
from barloom.session import cut

S = Fx.S
W = "WINDOW w AS (PARTITION BY code ORDER BY date)"


def _ts(name, spec, spark_col, sql_expr):
    """One time-series column over the monthly panel."""

    @query(name, f"date:d code:i {spec}", f"{D.PANEL}\n---\nSELECT date, code, {sql_expr} AS {spec.split(':')[0]} FROM panel {W}")
    def run(spark, sf):
        return D.panel(spark, sf).select("date", "code", spark_col().alias(spec.split(":")[0]))


_ts("f01_forward_return", "fwd:f6", lambda: Fx.forward_return(3), "lead(close, 3) OVER w / close - 1")
_ts("f02_daily_return", "ret:f6", lambda: Fx.daily_return(), "close / lag(close) OVER w - 1")
_ts("f03_momentum", "mom:f6", lambda: Fx.momentum(1, 12), "lag(close, 1) OVER w / lag(close, 13) OVER w - 1")

_RET = D.PANEL + f""",
rets AS (SELECT *, close / lag(close) OVER w - 1 AS ret FROM panel {W})"""


def _returns(spark, sf):
    return D.panel(spark, sf).withColumn("ret", Fx.daily_return())


def _rolling(name, spec, spark_col, sql_expr):
    col = spec.split(":")[0]

    @query(name, f"date:d code:i {spec}", f"{_RET}\n---\nSELECT date, code, {sql_expr} AS {col} FROM rets {W}")
    def run(spark, sf):
        return _returns(spark, sf).select("date", "code", spark_col().alias(col))


_rolling("f04_volatility", "vol:f6", lambda: Fx.volatility("ret", 36, 20),
         "CASE WHEN count(ret) OVER (w ROWS 35 PRECEDING) >= 20 THEN stddev_samp(ret) OVER (w ROWS 35 PRECEDING) * sqrt(252) END")
_rolling("f06_downside_deviation", "down:f6", lambda: Fx.downside_deviation("ret", 36, 20),
         "CASE WHEN count(*) OVER (w ROWS 35 PRECEDING) >= 20 THEN sqrt(avg(CASE WHEN ret < 0 THEN ret * ret ELSE 0e0 END) OVER (w ROWS 35 PRECEDING)) * sqrt(252) END")
_rolling("f07_turnover_neg", "turn:f6", lambda: Fx.turnover_neg("ret", 24, 20),
         "CASE WHEN count(ret) OVER (w ROWS 23 PRECEDING) >= 20 THEN -avg(abs(ret)) OVER (w ROWS 23 PRECEDING) END")

_BENCH = _RET + """,
bench AS (SELECT date, b / lag(b) OVER (ORDER BY date) - 1 AS bench_ret FROM (SELECT date, avg(close) AS b FROM panel GROUP BY 1)),
rb AS (SELECT rets.*, bench_ret FROM rets JOIN bench USING (date)),
beta AS (SELECT *, CASE WHEN count(CASE WHEN ret IS NOT NULL AND bench_ret IS NOT NULL THEN 1 END) OVER v >= 20
  THEN covar_samp(ret, bench_ret) OVER v / var_samp(bench_ret) OVER v END AS beta FROM rb
  WINDOW v AS (PARTITION BY code ORDER BY date ROWS 47 PRECEDING))"""


@query("f05_rolling_beta", "date:d code:i beta:f6", _BENCH + "\n---\nSELECT date, code, beta FROM beta")
def rolling_beta(spark, sf):
    return Fx.rolling_beta(D.panel(spark, sf), D.benchmark(spark, sf), 48, 20)


@query("f08_core_factors", "date:d code:i mom_12_1:f6 turnover_neg:f6 volatility_neg:f6 downside_neg:f6 size_neg:f6 "
       "beta_neg:f6 fwd_ret:f6", _BENCH + f"""
---
SELECT date, code, lag(close, 1) OVER w / lag(close, 13) OVER w - 1 AS mom_12_1,
  CASE WHEN count(ret) OVER (w ROWS 23 PRECEDING) >= 20 THEN -avg(abs(ret)) OVER (w ROWS 23 PRECEDING) END AS turnover_neg,
  CASE WHEN count(ret) OVER (w ROWS 35 PRECEDING) >= 20 THEN -stddev_samp(ret) OVER (w ROWS 35 PRECEDING) * sqrt(252) END AS volatility_neg,
  CASE WHEN count(*) OVER (w ROWS 35 PRECEDING) >= 20 THEN -sqrt(avg(CASE WHEN ret < 0 THEN ret * ret ELSE 0e0 END) OVER (w ROWS 35 PRECEDING)) * sqrt(252) END AS downside_neg,
  -ln(abs(close) + 1e-9) AS size_neg, -beta AS beta_neg, lead(close, 3) OVER w / close - 1 AS fwd_ret
FROM beta {W}""")
def core_factors(spark, sf):
    return Fx.core_factors(D.panel(spark, sf), D.benchmark(spark, sf), 3, long=36, beta=48, turn=24,
                           min_periods=20, beta_min=20)


# ---- sub-indicator panel -------------------------------------------------------------------------

INDICATORS = ["ep", "bp", "mom_12_1", "turnover_neg", "roe", "leverage_neg", "volatility_neg", "size_neg", "revenue_cagr"]


def _wide(spark, sf):
    c = F.col
    p = D.panel(spark, sf)
    return p.select(
        "date", "code", "close",
        (c("low") / c("high")).alias("ep"), (c("volume") / c("amount") * 1000).alias("bp"),
        Fx.momentum(1, 12).alias("mom_12_1"), (-(c("high") - c("low")) / c("close")).alias("turnover_neg"),
        (c("open") / c("close")).alias("roe"), (-c("trades").cast("double")).alias("leverage_neg"),
        (-(c("high") - c("low")) / (c("high") + c("low"))).alias("volatility_neg"),
        (-F.log("amount")).alias("size_neg"), (c("amount") / S.lag("amount", 12) - 1).alias("revenue_cagr"),
        Fx.forward_return(1).alias("fwd"))


def _long(spark, sf):
    return _wide(spark, sf).unpivot(["date", "code"], INDICATORS, "indicator", "value")


def _industry(spark, sf):
    s, n = D.table(spark, sf, "supplier"), D.table(spark, sf, "nation")
    ind = s.join(F.broadcast(n), s.s_nationkey == n.n_nationkey).select(
        F.col("s_suppkey").alias("code"), F.col("n_regionkey").cast("string").alias("industry"))
    return _long(spark, sf).join(ind, "code", "left")


WIDE = D.PANEL + f""",
wide AS (SELECT date, code, close, low / high AS ep, volume / amount * 1000 AS bp,
  lag(close, 1) OVER w / lag(close, 13) OVER w - 1 AS mom_12_1, -(high - low) / close AS turnover_neg,
  open / close AS roe, -CAST(trades AS DOUBLE) AS leverage_neg, -(high - low) / (high + low) AS volatility_neg,
  -ln(amount) AS size_neg, amount / lag(amount, 12) OVER w - 1 AS revenue_cagr, lead(close, 1) OVER w / close - 1 AS fwd
  FROM panel {W})"""
LONG = WIDE + """,
long AS (SELECT date, code, indicator, value FROM (SELECT date, code, """ + ", ".join(INDICATORS) + """ FROM wide)
  UNPIVOT INCLUDE NULLS (value FOR indicator IN (""" + ", ".join(INDICATORS) + """)))"""
WINSOR = LONG + """,
q AS (SELECT date, indicator, quantile_cont(value, 0.025) AS lo, quantile_cont(value, 0.975) AS hi FROM long GROUP BY 1, 2),
wins AS (SELECT date, code, indicator,
  CASE WHEN value IS NOT NULL THEN least(greatest(value, lo), hi) END AS value FROM long JOIN q USING (date, indicator))"""
NEUTRAL = WINSOR + """,
neu AS (SELECT wins.date, wins.code, indicator, CASE WHEN stddev_samp(value) OVER g > 0
    THEN round((value - avg(value) OVER g) / stddev_samp(value) OVER g, 9) END AS value
  FROM wins LEFT JOIN (SELECT s_suppkey, n_regionkey FROM supplier JOIN nation ON s_nationkey = n_nationkey) s ON s_suppkey = wins.code
  WINDOW g AS (PARTITION BY date, indicator, n_regionkey))"""


def _pct(src):
    return f"""
pct AS (SELECT date, code, indicator, {D.avg_rank_sql('date, indicator', 'value')} / count(*) OVER (PARTITION BY date, indicator) * 100 AS score
  FROM {src} WHERE value IS NOT NULL)"""


SCORES = NEUTRAL + "," + _pct("neu") + """,
wt AS (SELECT * FROM (VALUES ('value','ep',0.6e0,2),('value','bp',0.4e0,2),('momentum','mom_12_1',5e0/7,2),('momentum','turnover_neg',2e0/7,2),
  ('quality','roe',3e0/5.5e0,2),('quality','leverage_neg',2.5e0/5.5e0,2),('low_vol','volatility_neg',1e0,1),('size','size_neg',1e0,1),
  ('growth','revenue_cagr',1e0,1)) t(factor, indicator, w, subs)),
scores AS (SELECT l.date, l.code, factor, CASE WHEN count(p.score) = max(subs) THEN sum(w * p.score) ELSE 50e0 END AS score
  FROM long l JOIN wt USING (indicator) LEFT JOIN pct p ON p.date = l.date AND p.code = l.code AND p.indicator = l.indicator
  GROUP BY 1, 2, 3)"""


@query("f09_winsorize", "date:d code:i indicator:s value:f6", WINSOR + "\n---\nSELECT * FROM wins WHERE value IS NOT NULL")
def winsorize(spark, sf):
    return Fx.winsorize(cut(_long(spark, sf)), by=("date", "indicator")).where("value is not null")


@query("f10_industry_neutral", "date:d code:i indicator:s value:f9", NEUTRAL + "\n---\nSELECT * FROM neu")
def neutral(spark, sf):
    w = Fx.winsorize(cut(_industry(spark, sf)), by=("date", "indicator"))
    return Fx.neutralize(w, by=("date", "indicator", "industry"))


@query("f11_percentile_score", "date:d code:i indicator:s score:f6", LONG + "," + _pct("long") + "\n---\nSELECT * FROM pct")
def pct_score(spark, sf):
    return Fx.percentile_score(cut(_long(spark, sf)), by=("date", "indicator")).where("score is not null")


@query("f12_factor_score", "date:d code:i score:f6", SCORES + "\n---\nSELECT * FROM scores WHERE factor = 'value'")
def factor_score(spark, sf):
    return Fx.factor_scores(_industry(spark, sf), {"value": Fx.SUB_WEIGHTS["value"]}, INDICATORS, industry=True)


@query("f13_six_factor_scores", "date:d code:i factor:s score:f6", SCORES + "\n---\nSELECT * FROM scores")
def six_scores(spark, sf):
    return Fx.factor_scores(_industry(spark, sf), Fx.SUB_WEIGHTS, INDICATORS, industry=True)


_MULTI = SCORES + ", multi AS (SELECT date, code, avg(score) AS score FROM scores GROUP BY 1, 2)"


@query("f14_multifactor_score", "date:d code:i score:f6 weighted:f6", SCORES + """
---
SELECT date, code, avg(score) AS score, sum(score * CASE factor WHEN 'value' THEN 3e0 WHEN 'momentum' THEN 2e0 WHEN 'quality' THEN 1e0 ELSE 0e0 END) / 6
  AS weighted FROM scores GROUP BY 1, 2""")
def multi_score(spark, sf):
    return Fx.multifactors(six_scores(spark, sf), {"score": None, "weighted": {"value": 3, "momentum": 2, "quality": 1}})


@query("f15_top_n", "date:d code:i rank:i score:f4", _MULTI + """
---
SELECT date, code, score, row_number() OVER (PARTITION BY date ORDER BY round(score, 9) DESC, code) AS rank FROM multi
QUALIFY rank <= 10""")
def top(spark, sf):
    s = Fx.multifactor(six_scores(spark, sf)).withColumn("score", F.round("score", 9))
    return Fx.top_n(s, 10)


# ---- information coefficient ---------------------------------------------------------------------

IC = WIDE + """,
r AS (SELECT date, code, """ + D.avg_rank_sql("date", "mom_12_1") + " AS rf, " + D.avg_rank_sql("date", "fwd") + """ AS rr
  FROM wide WHERE mom_12_1 IS NOT NULL AND fwd IS NOT NULL),
ic AS (SELECT date, CASE WHEN count(*) >= 5 THEN round(corr(rf, rr), 6) END AS ic, count(*) AS n FROM r GROUP BY 1),
summ AS (SELECT avg(ic) AS ic_mean, stddev_samp(ic) AS ic_std, avg(CASE WHEN ic > 0 THEN 100e0 ELSE 0e0 END) AS ic_positive_pct,
  count(*) AS n_periods, coalesce(avg(ic) / nullif(stddev_samp(ic), 0), 0) AS ir FROM ic WHERE ic IS NOT NULL)"""


def _pairs(spark, sf):
    return D.panel(spark, sf).select("date", "code", Fx.momentum(1, 12).alias("factor"), Fx.forward_return(1).alias("ret"))


@query("f16_ic_series", "date:d ic:f5 n:i", IC + "\n---\nSELECT * FROM ic")
def ic_series(spark, sf):
    return Fx.ic_series(_pairs(spark, sf))


@query("f17_ic_summary", "ic_mean:f5 ic_std:f5 ir:f4 ic_positive_pct:f2 n_periods:i", IC + "\n---\nSELECT * FROM summ")
def ic_summary(spark, sf):
    return Fx.ic_summary(ic_series(spark, sf))


@query("f18_ic_label", "label:s", IC + """
---
SELECT concat_ws('; ', CASE WHEN abs(ic_mean) > 0.10 THEN 'IC unusually high' WHEN abs(ic_mean) > 0.05 THEN 'strong predictive power'
  WHEN abs(ic_mean) > 0.03 THEN 'basic predictive power' ELSE 'weak predictive power' END,
  CASE WHEN abs(ir) > 1 THEN 'IR very strong' WHEN abs(ir) > 0.5 THEN 'IR good' ELSE 'IR low' END,
  CASE WHEN ic_positive_pct > 55 THEN 'stable direction' WHEN ic_positive_pct < 50 THEN 'unstable direction' END) AS label FROM summ""")
def ic_label(spark, sf):
    return ic_summary(spark, sf).select(Fx.ic_label().alias("label"))


QR = WIDE + """,
k AS (SELECT date, code, fwd, """ + D.avg_rank_sql("date", "mom_12_1") + """ AS rk, count(*) OVER (PARTITION BY date) AS n
  FROM wide WHERE mom_12_1 IS NOT NULL AND fwd IS NOT NULL),
qr AS (SELECT date, least(ceil(rk * 5 / n), 5) AS grp, avg(fwd) AS ret FROM k WHERE n >= 5 GROUP BY 1, 2)"""


@query("f19_quantile_portfolios", "date:d grp:i ret:f6 nav:f6", QR + """
---
SELECT *, exp(sum(ln(1 + ret)) OVER (PARTITION BY grp ORDER BY date ROWS UNBOUNDED PRECEDING)) AS nav FROM qr""")
def quantile_nav(spark, sf):
    return Fx.nav_by_group(Fx.quantile_returns(_pairs(spark, sf)))


@query("f19_quantile_portfolios_integer_bounds", "date:d grp:i ret:f6", WIDE + """,
k AS (SELECT date, code, fwd, """ + D.avg_rank_sql("date", "leverage_neg") + """ AS rk, count(*) OVER (PARTITION BY date) AS n
  FROM wide WHERE leverage_neg IS NOT NULL AND fwd IS NOT NULL),
g AS (SELECT unnest(range(5)) AS g)
---
SELECT date, g + 1 AS grp, avg(fwd) AS ret FROM k JOIN g ON rk >= n * g // 5 + 1 AND rk <= n * (g + 1) // 5 WHERE n >= 5 GROUP BY 1, 2""")
def quantile_compat(spark, sf):
    p = _wide(spark, sf).select("date", "code", F.col("leverage_neg").alias("factor"), F.col("fwd").alias("ret"))
    return Fx.quantile_returns(p, compat=True)


@query("f20_long_short_spread", "spread_pct:f4", QR + """,
st AS (SELECT grp, exp(sum(ln(1 + ret))) AS nav FROM qr GROUP BY 1)
---
SELECT (max(nav) FILTER (grp = 5) - max(nav) FILTER (grp = 1)) * 100 AS spread_pct FROM st""")
def spread(spark, sf):
    return Fx.long_short_spread(Fx.group_stats(Fx.quantile_returns(_pairs(spark, sf))))


# ---- combination ---------------------------------------------------------------------------------

_COLS = ["ep", "mom_12_1", "size_neg"]
Z = WIDE + """,
z AS (SELECT date, code, """ + ", ".join(
    f"coalesce(CASE WHEN stddev_samp({c}) OVER g > 0 THEN ({c} - avg({c}) OVER g) / stddev_samp({c}) OVER g END, 0) AS z{i}"
    for i, c in enumerate(_COLS)) + " FROM wide WINDOW g AS (PARTITION BY date))"


@query("f21_combine_equal", "date:d code:i composite:f6", Z + "\n---\nSELECT date, code, (z0 + z1 + z2) / 3 AS composite FROM z")
def combine_equal(spark, sf):
    return Fx.combine(_wide(spark, sf), _COLS)


@query("f22_combine_ic_weighted", "date:d code:i composite:f6",
       Z + "\n---\nSELECT date, code, z0 * 0.5 + z1 * 0.3 + z2 * 0.2 AS composite FROM z")
def combine_ic(spark, sf):
    return Fx.combine(_wide(spark, sf), _COLS, [0.05, 0.03, 0.02])


@query("f23_combine_orthogonal", "date:d code:i composite:f6", Z + """,
e1 AS (SELECT *, z1 - z0 * (sum(z1 * z0) OVER g / coalesce(nullif(sum(z0 * z0) OVER g, 0), 1)) AS o1,
  z2 - z0 * (sum(z2 * z0) OVER g / coalesce(nullif(sum(z0 * z0) OVER g, 0), 1)) AS p2 FROM z WINDOW g AS (PARTITION BY date)),
e2 AS (SELECT *, p2 - o1 * (sum(p2 * o1) OVER g / coalesce(nullif(sum(o1 * o1) OVER g, 0), 1)) AS o2 FROM e1 WINDOW g AS (PARTITION BY date))
---
SELECT date, code, (z0 + o1 + o2) / 3 AS composite FROM e2""")
def combine_orth(spark, sf):
    return Fx.combine_orthogonal(_wide(spark, sf), _COLS)


# ---- cycle ---------------------------------------------------------------------------------------

_MACRO = """mq AS (SELECT CAST(date_trunc('quarter', o_orderdate) AS DATE) AS date, sum(o_totalprice) AS rev,
  avg(o_totalprice) AS price, avg(CASE WHEN o_orderstatus = 'F' THEN 1e0 ELSE 0e0 END) AS f FROM orders GROUP BY 1),
macro AS (SELECT date, (rev / lag(rev) OVER w - 1) * 10 AS gdp_trend, (price / lag(price) OVER w - 1) * 20 AS inflation,
  (f - lag(f) OVER w) * 10 AS rate_trend FROM mq WINDOW w AS (ORDER BY date)),
stage AS (SELECT *, CASE WHEN gdp_trend > 0 AND inflation <= 0 AND rate_trend <= 0 THEN 'recovery_early'
  WHEN gdp_trend > 0 AND inflation <= 0.5 AND abs(rate_trend) < 0.3 THEN 'expansion_mid'
  WHEN gdp_trend <= 0.3 AND inflation > 0.5 AND rate_trend > 0 THEN 'expansion_late'
  WHEN gdp_trend < 0 THEN 'downturn' ELSE 'trough_rebound' END AS cycle FROM macro WHERE gdp_trend IS NOT NULL)"""


def _macro(spark, sf):
    from pyspark.sql import Window
    q = D.table(spark, sf, "orders").groupBy(F.trunc("o_orderdate", "quarter").alias("date")).agg(
        F.sum("o_totalprice").alias("rev"), F.avg("o_totalprice").alias("price"),
        F.avg(F.when(F.col("o_orderstatus") == "F", 1.0).otherwise(0.0)).alias("f"))
    w = Window.orderBy("date")    # one row per quarter
    return q.select("date", ((F.col("rev") / F.lag("rev").over(w) - 1) * 10).alias("gdp_trend"),
                    ((F.col("price") / F.lag("price").over(w) - 1) * 20).alias("inflation"),
                    ((F.col("f") - F.lag("f").over(w)) * 10).alias("rate_trend")).where("gdp_trend is not null")


@query("f25_cycle_stage", "date:d cycle:s", _MACRO + "\n---\nSELECT date, cycle FROM stage")
def cycle_stage(spark, sf):
    return _macro(spark, sf).withColumn("cycle", Fx.detect_cycle())


_WT = """cw AS (SELECT * FROM (VALUES
  ('recovery_early',0.15,0.20,0.10,0.05,0.25,0.25),('expansion_mid',0.10,0.25,0.20,0.05,0.15,0.25),
  ('expansion_late',0.25,0.10,0.25,0.20,0.10,0.10),('downturn',0.15,0.05,0.25,0.30,0.05,0.20),
  ('trough_rebound',0.30,0.15,0.10,0.05,0.25,0.15)) t(cycle, value, momentum, quality, low_vol, size, growth)),
cl AS (SELECT cycle, factor, least(greatest(CAST(w AS DOUBLE), 1e0 / 6 - 0.1e0), 1e0 / 6 + 0.1e0) AS w FROM cw
  UNPIVOT (w FOR factor IN (value, momentum, quality, low_vol, size, growth))),
tw AS (SELECT cycle, factor, round(w / sum(w) OVER (PARTITION BY cycle), 4) AS weight FROM cl)"""


@query("f24_timing_weights", "date:d factor:s weight:f4", _MACRO + "," + _WT + """
---
SELECT date, factor, weight FROM stage JOIN tw USING (cycle)""")
def timing_weights(spark, sf):
    return Fx.timing_advice(_macro(spark, sf))


@query("f26_timing_advice", "date:d cycle:s factor:s weight:f4 stance:s", _MACRO + "," + _WT + """,
fav(cycle, good, bad) AS (VALUES ('recovery_early', ['size','momentum','growth'], ['low_vol']), ('expansion_mid', ['momentum','quality'], ['value']),
  ('expansion_late', ['quality','value'], ['size','growth']), ('downturn', ['low_vol','quality'], ['momentum','size']),
  ('trough_rebound', ['value','size'], ['low_vol']))
---
SELECT date, cycle, factor, weight, CASE WHEN list_contains(good, factor) THEN 'favourable'
  WHEN list_contains(bad, factor) THEN 'unfavourable' ELSE 'neutral' END AS stance
FROM stage JOIN tw USING (cycle) JOIN fav USING (cycle)""")
def timing_advice(spark, sf):
    return Fx.timing_advice(_macro(spark, sf))


# ---- crowding, decay, correlation ----------------------------------------------------------------

@query("f27_crowding", "factor:i n:i lag1:f6 decay:f6 crowding:s", _RET + """,
x AS (SELECT code AS factor, ret AS r, lag(ret) OVER (PARTITION BY code ORDER BY date) AS r1,
  row_number() OVER (PARTITION BY code ORDER BY date DESC) AS age FROM rets WHERE ret IS NOT NULL),
a AS (SELECT factor, count(*) AS n, CASE WHEN count(*) >= 62 THEN coalesce(corr(r, r1), 0) END AS lag1,
  CASE WHEN count(*) >= 62 THEN avg(r) FILTER (age <= 60) - avg(r) END AS decay FROM x GROUP BY 1)
---
SELECT *, CASE WHEN lag1 IS NULL THEN 'insufficient' WHEN lag1 > 0.3 AND decay < 0 THEN 'high' WHEN lag1 > 0.3 THEN 'medium'
  WHEN decay < -0.0005 THEN 'medium' ELSE 'low' END AS crowding FROM a""")
def crowding(spark, sf):
    return Fx.crowding(_returns(spark, sf).select(F.col("code").alias("factor"), "date", F.col("ret").alias("r")))


@query("f40_factor_decay", "horizon:i ic_mean:f5 ic_std:f5 n_periods:i", WIDE + f""",
h AS (SELECT date, code, mom_12_1, unnest([1, 3, 6]) AS horizon, unnest([lead(close, 1) OVER w, lead(close, 3) OVER w, lead(close, 6) OVER w]) / close - 1 AS ret
  FROM wide {W}),
r AS (SELECT date, horizon, """ + D.avg_rank_sql("date, horizon", "mom_12_1") + " AS rf, " + D.avg_rank_sql("date, horizon", "ret") + """ AS rr
  FROM h WHERE mom_12_1 IS NOT NULL AND ret IS NOT NULL),
ic AS (SELECT date, horizon, round(corr(rf, rr), 6) AS ic FROM r GROUP BY 1, 2 HAVING count(*) >= 5)
---
SELECT horizon, avg(ic) AS ic_mean, stddev_samp(ic) AS ic_std, count(*) AS n_periods FROM ic GROUP BY 1""")
def decay(spark, sf):
    return Fx.factor_decay(_wide(spark, sf), [1, 3, 6], "mom_12_1")


@query("f45_valuation_spread", "date:d cheap:f6 dear:f6 spread:f6", WIDE + """,
k AS (SELECT date, close, least(ceil(""" + D.avg_rank_sql("date", "close") + """ * 4 / count(*) OVER (PARTITION BY date)), 4) AS q FROM wide)
---
SELECT date, quantile_cont(close, 0.5) FILTER (q = 1) AS cheap, quantile_cont(close, 0.5) FILTER (q = 4) AS dear,
  quantile_cont(close, 0.5) FILTER (q = 4) / quantile_cont(close, 0.5) FILTER (q = 1) AS spread FROM k GROUP BY 1""")
def val_spread(spark, sf):
    return Fx.valuation_spread(_wide(spark, sf), "close")


@query("f46_factor_correlation", "f1:s f2:s corr:f6", WIDE + "\n---\n" + " UNION ALL ".join(
    f"SELECT '{a}' AS f1, '{b}' AS f2, corr({a}, {b}) AS corr FROM wide"
    for i, a in enumerate(INDICATORS) for b in INDICATORS[i + 1:]))
def correlation(spark, sf):
    return Fx.correlation_matrix(_wide(spark, sf), INDICATORS)


# ---- documented sub-indicators -------------------------------------------------------------------

FIN = """fin AS (SELECT o_custkey AS code, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS date, sum(o_totalprice) AS revenue,
  sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice * 0.2 ELSE o_totalprice * 0.05 END) AS profit, count(*) AS n,
  max(o_totalprice) AS cfo FROM orders GROUP BY 1, 2)"""


def fin(spark, sf):
    o = D.table(spark, sf, "orders")
    return o.groupBy(F.col("o_custkey").alias("code"), F.trunc("o_orderdate", "quarter").alias("date")).agg(
        F.sum("o_totalprice").alias("revenue"),
        F.sum(F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice") * 0.2).otherwise(F.col("o_totalprice") * 0.05)).alias("profit"),
        F.count(F.lit(1)).alias("n"), F.max("o_totalprice").alias("cfo"))


@query("f41_value_subindicators", "code:i date:d ebit_ev:f6 book_price:f6 fcf_ev:f6 ebitda_ev:f6", FIN + """
---
SELECT code, date, profit / ev AS ebit_ev, n * 1000 / ev AS book_price, (cfo - revenue * 0.1) / ev AS fcf_ev, profit * 1.1 / ev AS ebitda_ev
FROM (SELECT fin.*, revenue * 2 + abs(c_acctbal) AS ev FROM fin JOIN customer ON c_custkey = code)""")
def value_subs(spark, sf):
    c = D.table(spark, sf, "customer").select(F.col("c_custkey").alias("code"), "c_acctbal")
    f = fin(spark, sf).join(c, "code")
    return Fx.value_indicators(f.withColumn("ev", F.col("revenue") * 2 + F.abs("c_acctbal"))
                               .withColumn("book", F.col("n") * 1000.0).withColumn("capex", F.col("revenue") * 0.1))


@query("f42_momentum_subindicators", "code:i date:d mom_12_1:f6 rev_eps:f6 turnover_rank_neg:f6", D.PANEL + f""",
e AS (SELECT code, date, lag(close, 1) OVER w / lag(close, 13) OVER w - 1 AS mom_12_1,
  open / lag(open, 3) OVER w - 1 AS rev_eps, avg(volume) OVER (w ROWS 2 PRECEDING) AS t3 FROM panel {W})
---
SELECT code, date, mom_12_1, rev_eps, -""" + D.avg_rank_sql("date", "t3") + """ / count(*) OVER (PARTITION BY date) AS turnover_rank_neg FROM e""")
def momentum_subs(spark, sf):
    p = D.panel(spark, sf).withColumn("consensus_eps", F.col("open")).withColumn("turnover", F.col("volume"))
    return Fx.momentum_indicators(p)


@query("f43_quality_subindicators", "code:i date:d roe:f8 stability:f6 leverage_neg:f8 cash_ratio:f8", FIN + """,
g AS (SELECT *, profit / lag(profit, 4) OVER (PARTITION BY code ORDER BY date) - 1 AS gr FROM fin)
---
SELECT code, date, profit / (n * 5000) AS roe, CASE WHEN count(gr) OVER v >= 4 THEN 1 - stddev_samp(gr) OVER v END AS stability,
  1 - revenue * 0.4 / (revenue * 0.4 + n * 5000) AS leverage_neg, cfo / profit AS cash_ratio FROM g
WINDOW v AS (PARTITION BY code ORDER BY date ROWS 19 PRECEDING)""")
def quality_subs(spark, sf):
    f = fin(spark, sf).withColumn("equity", F.col("n") * 5000.0).withColumn("debt", F.col("revenue") * 0.4)
    return Fx.quality_indicators(f.withColumn("assets", F.col("debt") + F.col("equity")))


@query("f44_growth_subindicators", "code:i date:d revenue_cagr:f6 profit_cagr:f6 margin_expansion:f6 fwd_growth:f6", FIN + """
---
SELECT code, date, power(revenue / lag(revenue, 12) OVER w, 1e0 / 3) - 1 AS revenue_cagr,
  power(profit / lag(profit, 12) OVER w, 1e0 / 3) - 1 AS profit_cagr,
  profit / revenue - lag(profit, 12) OVER w / lag(revenue, 12) OVER w AS margin_expansion, cfo / revenue - 1 AS fwd_growth
FROM fin WINDOW w AS (PARTITION BY code ORDER BY date)""")
def growth_subs(spark, sf):
    return Fx.growth_indicators(fin(spark, sf).withColumn("consensus_next", F.col("cfo")))


# ---- seven-factor screen -------------------------------------------------------------------------

_SEVEN = _RET + """,
a AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY date DESC) AS age, count(*) OVER (PARTITION BY code) AS n FROM rets),
b AS (SELECT code, max(n) AS n, max(date) AS date, max(close) FILTER (age = 1) AS close, max(volume) FILTER (age = 1) AS volume,
  max(close) FILTER (age = least(20, n - 1) + 1) AS cm, max(close) FILTER (age = least(5, n - 1) + 1) AS cr,
  stddev_pop(ret) FILTER (age <= least(20, n - 1)) AS sd, avg(volume) FILTER (age <= least(20, n - 1)) AS av FROM a GROUP BY 1),
fu AS (SELECT s_suppkey AS code, s_name AS name, s_nationkey, CASE WHEN s_acctbal > 0 THEN s_acctbal / 100 END AS pe, abs(s_acctbal) / 1000 + 0.5 AS pb,
  abs(s_acctbal) * 1000 AS total_mv FROM supplier),
f7 AS (SELECT b.code, date, close, total_mv, close / cm - 1 AS momentum, close / cr - 1 AS reversal, sd AS volatility, volume / av AS volume_ratio,
  1 / pe AS pe_factor, 1 / pb AS pb_factor, pb / pe AS roe_factor FROM b LEFT JOIN fu ON fu.code = b.code)"""
_FS = list(Fx.SEVEN_FACTORS)
_ZS = _SEVEN + ", z7 AS (SELECT *, " + ", ".join(
    f"CASE WHEN stddev_samp({f}) OVER () > 1e-10 THEN {d} * ({f} - avg({f}) OVER ()) / stddev_samp({f}) OVER () ELSE 0 END AS {f}_z"
    for f, d in Fx.SEVEN_FACTORS.items()) + " FROM f7)"
_CS = _ZS + ", c7 AS (SELECT *, (" + " + ".join(f"coalesce({f}_z, 0)" for f in _FS) + ") / 7 AS composite_score FROM z7)"


def fundamentals(spark, sf):
    s = D.table(spark, sf, "supplier")
    return s.select(F.col("s_suppkey").alias("code"), F.when(F.col("s_acctbal") > 0, F.col("s_acctbal") / 100).alias("pe"),
                    (F.abs("s_acctbal") / 1000 + 0.5).alias("pb"), (F.abs("s_acctbal") * 1000).alias("total_mv"))


def _seven(spark, sf):
    return Fx.seven_factors(D.panel(spark, sf), fundamentals(spark, sf))


@query("f28_seven_factors", "code:i date:d close:f8 " + " ".join(f"{f}:f6" for f in _FS), _SEVEN + "\n---\nSELECT * FROM f7")
def seven(spark, sf):
    return _seven(spark, sf)


@query("f29_directed_zscore", "code:i " + " ".join(f"{f}_z:f6" for f in _FS), _ZS + "\n---\nSELECT * FROM z7")
def directed(spark, sf):
    return Fx.directed_zscore(cut(_seven(spark, sf)))


@query("f30_composite_rank", "code:i composite_score:f6 rank:i", _CS + """
---
SELECT code, composite_score, row_number() OVER (ORDER BY composite_score DESC, code) AS rank FROM c7""")
def composite(spark, sf):
    """One row per code is stored before the market-wide moments and the rank read it again."""
    return Fx.rank_all(cut(Fx.composite_score(Fx.directed_zscore(cut(_seven(spark, sf))))), "composite_score", "code")


@query("f31_cap_band_filter", "code:i total_mv:f2", _SEVEN + """
---
SELECT code, total_mv FROM f7 WHERE total_mv / 10000 >= 100 AND total_mv / 10000 < 500""")
def cap_band(spark, sf):
    return Fx.cap_band_filter(_seven(spark, sf), "mid")


@query("f32_valid_factor_gate", "code:i valid_factors:i", _SEVEN + """
---
SELECT code, """ + " + ".join(f"(CASE WHEN {f} IS NULL THEN 0 ELSE 1 END)" for f in _FS) + " AS valid_factors FROM f7 WHERE valid_factors >= 7")
def gate(spark, sf):
    return Fx.valid_factor_gate(_seven(spark, sf), need=7)


@query("f33_factor_statistics", "factor:s mean:f6 std:f6 max:f6 min:f6 valid:i", _SEVEN + "\n---\n" + " UNION ALL ".join(
    f"SELECT '{f}' AS factor, avg({f}) AS mean, stddev_samp({f}) AS std, max({f}) AS max, min({f}) AS min, count({f}) AS valid FROM f7" for f in _FS))
def stats(spark, sf):
    return Fx.factor_statistics(_seven(spark, sf))


@query("f34_universe_filter", "code:i name:s list_date:d", """
m AS (SELECT l_suppkey AS code, CAST(max(l_shipdate) AS DATE) AS last_date, CAST(min(l_shipdate) AS DATE) AS list_date FROM lineitem GROUP BY 1),
j AS (SELECT code, CASE WHEN s_nationkey % 5 = 0 THEN 'ST ' || s_name ELSE s_name END AS name, list_date, s_nationkey FROM m JOIN supplier ON s_suppkey = code)
---
SELECT code, name, list_date FROM j WHERE name NOT LIKE '%ST%' AND list_date <= DATE '1995-06-01' - 120""")
def universe(spark, sf):
    li = D.table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("code")).agg(
        F.to_date(F.min("l_shipdate")).alias("list_date"))
    s = D.table(spark, sf, "supplier").withColumn(
        "name", F.when(F.col("s_nationkey") % 5 == 0, F.concat(F.lit("ST "), F.col("s_name"))).otherwise(F.col("s_name")))
    m = li.join(s, li.code == s.s_suppkey)
    return Fx.universe_filter(m, F.lit("1995-06-01").cast("date"))


@query("f35_fundamental_weights", "date:d code:i weight:f8", D.PANEL + """,
r AS (SELECT date, code, close / 150 AS pe, low / high * 20 AS pb, open / close * 10 AS roe FROM panel),
o AS (SELECT *, coalesce(pe > 0 AND pe <= 30 AND pb <= 3 AND roe >= 8, false) AS ok FROM r)
---
SELECT date, code, CASE WHEN ok THEN 1e0 / count_if(ok) OVER (PARTITION BY date) ELSE 0 END AS weight FROM o""")
def fund_weights(spark, sf):
    p = D.panel(spark, sf).select("date", "code", (F.col("close") / 150).alias("pe"), (F.col("low") / F.col("high") * 20).alias("pb"),
                                  (F.col("open") / F.col("close") * 10).alias("roe"))
    return Fx.fundamental_weights(p)


# ---- small caps: one row per customer ------------------------------------------------------------

_SC = """y AS (SELECT o_custkey AS code, year(o_orderdate) AS yr, sum(o_totalprice) AS rev, count(*) AS n, max(o_totalprice) AS mx FROM orders GROUP BY 1, 2),
g AS (SELECT *, lag(rev, 3) OVER w AS rev3, lag(rev, 2) OVER w AS rev2, lag(rev) OVER w AS rev1, lag(mx) OVER w AS mx1,
  row_number() OVER (PARTITION BY code ORDER BY yr DESC) AS r FROM y WINDOW w AS (PARTITION BY code ORDER BY yr)),
sc AS (SELECT code, rev / 10000 AS total_mv_yi, (power(rev / rev3, 1e0 / 3) - 1) * 100 AS revenue_cagr3_pct, (power(rev / rev2, 0.5e0) - 1) * 100 AS revenue_cagr2_pct,
  (rev / rev1 - 1) * 100 AS revenue_growth_pct, (mx / rev - mx1 / rev1) * 10 AS margin_delta, mx / rev * 120 AS cash_ratio_pct, n * 12e0 AS debt_ratio,
  CAST(code % 60 AS DOUBLE) AS holder_pct, CASE WHEN code % 3 > 0 THEN code % 13 END AS moat_score, CAST(NULL AS DOUBLE) AS rnd_score,
  mx / 200000 AS peg FROM g WHERE r = 1),
q AS (SELECT *, CASE WHEN total_mv_yi BETWEEN 100 AND 200 THEN 'mid_small' WHEN total_mv_yi BETWEEN 50 AND 100 THEN 'small' WHEN total_mv_yi BETWEEN 20 AND 50 THEN 'micro' END AS band,
  (CASE WHEN revenue_growth_pct >= 40 THEN 20 WHEN revenue_growth_pct >= 30 THEN 16 WHEN revenue_growth_pct >= 20 THEN 12 ELSE 0 END)
  + (CASE WHEN margin_delta > 1 THEN 15 WHEN margin_delta >= 0 THEN 10 WHEN margin_delta >= -2 THEN 5 ELSE 0 END)
  + (CASE WHEN cash_ratio_pct >= 100 THEN 15 WHEN cash_ratio_pct >= 80 THEN 10 WHEN cash_ratio_pct >= 60 THEN 5 ELSE 0 END)
  + (CASE WHEN debt_ratio < 50 THEN 10 WHEN debt_ratio < 60 THEN 7 WHEN debt_ratio < 70 THEN 4 ELSE 0 END)
  + (CASE WHEN holder_pct >= 40 THEN 10 WHEN holder_pct >= 25 THEN 7 WHEN holder_pct >= 15 THEN 4 ELSE 2 END)
  + coalesce(CASE WHEN moat_score > 10 THEN 10 ELSE moat_score END, 6) + 6
  + (CASE WHEN peg < 0.8 THEN 10 WHEN peg < 1.2 THEN 7 WHEN peg < 1.5 THEN 4 ELSE 2 END) AS quality_score FROM sc),
qq AS (SELECT *, CASE WHEN quality_score >= 80 THEN '5 stars' WHEN quality_score >= 65 THEN '4 stars' WHEN quality_score >= 50 THEN '3 stars'
  WHEN quality_score >= 35 THEN '2 stars' ELSE '1 star' END AS rating, coalesce(revenue_cagr3_pct > 20, false) OR coalesce(revenue_cagr2_pct > 25, false) AS gate FROM q)"""


def small_caps(spark, sf):
    from pyspark.sql import Window
    o = D.table(spark, sf, "orders")
    y = o.groupBy(F.col("o_custkey").alias("code"), F.year("o_orderdate").alias("yr")).agg(
        F.sum("o_totalprice").alias("rev"), F.count(F.lit(1)).alias("n"), F.max("o_totalprice").alias("mx"))
    w = Window.partitionBy("code").orderBy("yr")
    c = F.col
    g = y.select("*", F.lag("rev", 3).over(w).alias("rev3"), F.lag("rev", 2).over(w).alias("rev2"),
                 F.lag("rev").over(w).alias("rev1"), F.lag("mx").over(w).alias("mx1"),
                 F.lead("yr").over(w).alias("nxt")).where("nxt is null")
    return g.select(
        "code", (c("rev") / 10000).alias("total_mv_yi"),
        ((F.pow(c("rev") / c("rev3"), F.lit(1.0 / 3)) - 1) * 100).alias("revenue_cagr3_pct"),
        ((F.pow(c("rev") / c("rev2"), F.lit(0.5)) - 1) * 100).alias("revenue_cagr2_pct"),
        ((c("rev") / c("rev1") - 1) * 100).alias("revenue_growth_pct"),
        ((c("mx") / c("rev") - c("mx1") / c("rev1")) * 10).alias("margin_delta"),
        (c("mx") / c("rev") * 120).alias("cash_ratio_pct"), (c("n") * 12.0).alias("debt_ratio"),
        (c("code") % 60).cast("double").alias("holder_pct"),
        F.when(c("code") % 3 > 0, (c("code") % 13).cast("double")).alias("moat_score"),
        F.lit(None).cast("double").alias("rnd_score"), (c("mx") / 200000).alias("peg"))


@query("f36_small_cap_band", "code:i band:s", _SC + "\n---\nSELECT code, band FROM qq")
def sc_band(spark, sf):
    return small_caps(spark, sf).withColumn("band", Fx.small_cap_band(F.col("total_mv_yi")))


@query("f37_growth_gate", "code:i revenue_cagr3_pct:f4", _SC + "\n---\nSELECT code, revenue_cagr3_pct FROM qq WHERE gate")
def sc_gate(spark, sf):
    return small_caps(spark, sf).where(Fx.growth_gate(F.col("revenue_cagr3_pct"), F.col("revenue_cagr2_pct")))


@query("f38_growth_quality", "code:i quality_score:i rating:s", _SC + "\n---\nSELECT code, quality_score, rating FROM qq")
def sc_quality(spark, sf):
    total = sum(Fx.growth_quality().values(), F.lit(0))
    return small_caps(spark, sf).withColumn("quality_score", total).withColumn("rating", Fx.star_rating(F.col("quality_score")))


@query("f39_small_cap_screen", "code:i band:s quality_score:i rating:s",
       _SC + "\n---\nSELECT code, band, quality_score, rating FROM qq WHERE gate AND band IS NOT NULL")
def sc_screen(spark, sf):
    return Fx.small_cap_screen(small_caps(spark, sf))
