"""Strategy and portfolio queries on the monthly supplier panel and the weekly brand panel."""

from pyspark.sql import functions as F

from barloom.functions.ranking import with_totals

from barloom.operators import portfolio as P
from barloom.plans import bindings as D
from barloom.plans.frames import ema, span
from barloom.plans.registry import query

c = F.col
W = "WINDOW w AS (PARTITION BY code ORDER BY date)"


def avg(n):
    return f"CASE WHEN count(close) OVER (w ROWS {n - 1} PRECEDING) >= {n} THEN avg(close) OVER (w ROWS {n - 1} PRECEDING) END"


_MA = D.PANEL + f""",
m AS (SELECT *, row_number() OVER w AS i, {avg(5)} AS a, {avg(20)} AS b FROM panel {W}),
sg AS (SELECT *, CASE WHEN i <= 20 THEN 0e0 WHEN a > b THEN 1 WHEN a < b THEN -1 ELSE 0 END AS sig FROM m)"""


def _dual(spark, sf):
    return D.panel(spark, sf).withColumn("sig", P.dual_ma())


@query("p01_dual_ma_signal", "code:i date:d sig:f0", _MA + "\n---\nSELECT * FROM sg")
def dual(spark, sf):
    return _dual(spark, sf)


@query("p02_rsi_signal", "code:i date:d sig:f0", D.PANEL + f""",
d AS (SELECT *, row_number() OVER w AS i, close - lag(close) OVER w AS d FROM panel {W}),
r AS (SELECT *, avg(CASE WHEN d > 0 THEN d ELSE 0e0 END) OVER (w ROWS 13 PRECEDING) AS g, avg(CASE WHEN d < 0 THEN -d ELSE 0e0 END) OVER (w ROWS 13 PRECEDING) AS l FROM d {W}),
s AS (SELECT *, 100 - 100 / (1 + g / nullif(l, 0)) AS rsi FROM r)
---
SELECT *, CASE WHEN i <= 14 THEN 0 WHEN rsi < 30 THEN 1 WHEN rsi > 70 THEN -1 ELSE 0 END AS sig FROM s""")
def rsi(spark, sf):
    return P.rsi_reversal(D.panel(spark, sf))


@query("p03_macd_signal", "code:i date:d sig:f0", D.PANEL + f""",
x AS (SELECT *, row_number() OVER w - 1 AS i FROM panel {W}),
y AS (SELECT *, {ema('close', span(12))} - {ema('close', span(26))} AS m FROM x {W}),
z AS (SELECT *, {ema('m', span(9))} AS g FROM y {W})
---
SELECT *, CASE WHEN i < 26 THEN 0 WHEN m > g THEN 1 WHEN m < g THEN -1 ELSE 0 END AS sig FROM z""")
def macd(spark, sf):
    return P.macd_trend(D.panel(spark, sf))


_PRE = ["300", "600", "688", "430", "000"]
_SYM = "(['300','600','688','430','000'])[1 + code % 5] || lpad(CAST(code % 1000 AS VARCHAR), 3, '0')"


def _symbol(df):
    pre = F.element_at(F.array(*[F.lit(x) for x in _PRE]), (c("code") % 5 + 1).cast("int"))
    return df.withColumn("symbol", F.concat(pre, F.lpad((c("code") % 1000).cast("string"), 3, "0")))


_LIM = _MA + f""",
ov AS (SELECT s_suppkey AS oc, 0.05e0 AS o FROM supplier WHERE s_nationkey = 3),
lm AS (SELECT sg.*, {_SYM} AS symbol, coalesce(o, CASE WHEN code % 5 IN (0, 2) THEN 0.2e0 WHEN code % 5 = 3 THEN 0.3e0 ELSE 0.1e0 END) AS ratio,
  lag(close) OVER w AS pc FROM sg LEFT JOIN ov ON oc = code {W}),
lp AS (SELECT *, floor(pc * (1 + ratio) * 100 + 0.5) / 100 AS limit_up, floor(pc * (1 - ratio) * 100 + 0.5) / 100 AS limit_down FROM lm),
fl AS (SELECT *, volume <= 0 AS suspended, coalesce(close >= limit_up - 1e-6, false) AS at_up, coalesce(close <= limit_down + 1e-6, false) AS at_down FROM lp),
bk AS (SELECT *, CASE WHEN suspended THEN 'suspended' WHEN at_up AND sig > coalesce(lag(sig) OVER w, 0) THEN 'limit_up'
  WHEN at_down AND sig < coalesce(lag(sig) OVER w, 0) THEN 'limit_down' END AS blocked FROM fl {W}),
ex AS (SELECT *, coalesce(last_value(CASE WHEN blocked IS NULL THEN sig END IGNORE NULLS) OVER (w ROWS UNBOUNDED PRECEDING), 0) AS executed FROM bk {W})"""


def _limits(spark, sf):
    over = D.table(spark, sf, "supplier").where("s_nationkey = 3").select(c("s_suppkey").alias("code"), F.lit(0.05).alias("ratio"))
    return P.with_limits(_symbol(_dual(spark, sf)), over)


def _executed(spark, sf):
    return P.execute(P.with_flags(_limits(spark, sf)))


@query("p04_board_limit", "code:i date:d symbol:s ratio:f4", _LIM + "\n---\nSELECT * FROM lp")
def board(spark, sf):
    return _limits(spark, sf)


@query("p05_limit_prices", "code:i date:d limit_up:f2 limit_down:f2", _LIM + "\n---\nSELECT * FROM lp")
def limits(spark, sf):
    return _limits(spark, sf)


@query("p06_tradability_flags", "code:i date:d suspended:b at_up:b at_down:b", _LIM + "\n---\nSELECT * FROM fl")
def flags(spark, sf):
    return P.with_flags(_limits(spark, sf))


@query("p07_deferred_execution", "code:i date:d sig:f0 blocked:s executed:f0", _LIM + "\n---\nSELECT * FROM ex")
def deferred(spark, sf):
    return _executed(spark, sf)


@query("p11_rebalance_log", "code:i date:d before:f0 after:f0 blocked:s", _LIM + f""",
rl AS (SELECT code, date, sig, coalesce(lag(executed) OVER w, 0) AS before, executed AS after, blocked FROM ex {W})
---
SELECT * FROM rl WHERE before <> after OR (blocked IS NOT NULL AND sig <> before)""")
def rebalances(spark, sf):
    return P.rebalance_log(_executed(spark, sf))


_WT = _LIM + """,
wt AS (SELECT *, coalesce(executed / nullif(count_if(executed <> 0) OVER (PARTITION BY date), 0), 0) AS weight FROM ex)"""


def _weights(spark, sf):
    return P.active_weights(_executed(spark, sf), "executed")


@query("p08_active_weights", "code:i date:d weight:f8", _WT + "\n---\nSELECT * FROM wt")
def weights(spark, sf):
    return _weights(spark, sf)


_COST = "CASE WHEN {n} <= 0 THEN 0 ELSE greatest({n} * 0.0003, 5) + {n} * 0.00001 + CASE WHEN {s} THEN {n} * 0.0005 ELSE 0 END END"


@query("p09_trade_cost", "code:i date:d cost:f4", _WT + f""",
mv AS (SELECT code, date, weight - coalesce(lag(weight) OVER w, 0) AS dw FROM wt {W})
---
SELECT code, date, {_COST.format(n='(abs(dw) * 1e6)', s='dw < 0')} AS cost FROM mv""")
def cost(spark, sf):
    d = _weights(spark, sf).withColumn("_dw", c("weight") - F.coalesce(P.S.lag("weight"), F.lit(0.0)))
    return d.withColumn("cost", P.trade_cost(F.abs("_dw") * 1e6, c("_dw") < 0))


_RATE = repr(P.COMMISSION + P.TRANSFER_FEE + P.SLIPPAGE)
_PR = _WT + f""",
pr0 AS (SELECT date, weight, coalesce(lag(weight) OVER w, 0) AS pw, coalesce(close / lag(close) OVER w - 1, 0) AS r FROM wt {W}),
pr AS (SELECT date, sum(pw * r) AS gross, sum(abs(weight - pw) * {_RATE} + greatest(pw - weight, 0) * 0.0005) AS cost FROM pr0 GROUP BY 1),
nv AS (SELECT *, gross - cost AS net, exp(sum(ln(greatest(1 + gross - cost, 1e-12))) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING)) AS nav FROM pr)"""


@query("p10_panel_backtest", "date:d gross:f8 cost:f8 net:f8 nav:f6", _PR + "\n---\nSELECT * FROM nv")
def backtest(spark, sf):
    return P.with_nav(P.portfolio_returns(_weights(spark, sf)))


def perf_sql(src: str, key: str, name: str = "pf") -> str:
    return f"""
{name}0 AS (SELECT {key}, date, net, exp(sum(ln(greatest(1 + net, 1e-12))) OVER (PARTITION BY {key} ORDER BY date ROWS UNBOUNDED PRECEDING)) AS nav,
  row_number() OVER (PARTITION BY {key} ORDER BY date) AS i FROM {src}),
{name}1 AS (SELECT *, nav / greatest(1, max(nav) OVER (PARTITION BY {key} ORDER BY date ROWS UNBOUNDED PRECEDING)) - 1 AS dd FROM {name}0),
{name} AS (SELECT {key}, (arg_max(nav, date) - 1) * 100 AS total_return_pct, (pow(arg_max(nav, date), 252e0 / greatest(count(*) - 1, 1)) - 1) * 100 AS annual_return_pct,
  CASE WHEN stddev_samp(net) FILTER (i > 1) > 0 THEN avg(net) FILTER (i > 1) / stddev_samp(net) FILTER (i > 1) * sqrt(252e0) ELSE 0 END AS sharpe_ratio, min(dd) * 100 AS max_drawdown_pct,
  avg(CASE WHEN net > 0 THEN 100e0 ELSE 0 END) FILTER (i > 1) AS win_rate_pct, count(*) - 1 AS n_days FROM {name}1 GROUP BY {key})"""


_PF = _PR + ", nk AS (SELECT 'dual_ma' AS strategy, date, net FROM nv)," + perf_sql("nk", "strategy")
_METRICS = "total_return_pct:f4 annual_return_pct:f4 sharpe_ratio:f6 max_drawdown_pct:f4 win_rate_pct:f4 n_days:i"


def _perf(spark, sf):
    r = P.portfolio_returns(_weights(spark, sf)).withColumn("strategy", F.lit("dual_ma"))
    return P.performance(r)


@query("p12_performance", "strategy:s " + _METRICS, _PF + "\n---\nSELECT * FROM pf")
def performance(spark, sf):
    return _perf(spark, sf)


@query("p13_strategy_rating", "strategy:s rating:i passed:b issues:s", _PF + """,
tc AS (SELECT count(*) AS trade_count FROM (SELECT executed <> coalesce(lag(executed) OVER w, 0) AS t FROM ex WINDOW w AS (PARTITION BY code ORDER BY date)) WHERE t),
sc AS (SELECT *, 60 - CASE WHEN trade_count = 0 THEN 30 ELSE 0 END - CASE WHEN total_return_pct < -20 THEN 10 ELSE 0 END - CASE WHEN max_drawdown_pct < -30 THEN 5 ELSE 0 END AS rating FROM pf, tc)
---
SELECT strategy, rating, rating >= 60 AS passed, concat_ws(',', CASE WHEN trade_count = 0 THEN 'no_trades' END, CASE WHEN total_return_pct < -20 THEN 'heavy_loss' END,
  CASE WHEN max_drawdown_pct < -30 THEN 'deep_drawdown' END, CASE WHEN sharpe_ratio < 0.5 THEN 'low_sharpe' END) AS issues FROM sc""")
def rating(spark, sf):
    trades = P.rebalance_log(_executed(spark, sf)).where("before <> after").agg(F.count(F.lit(1)).alias("trade_count"))
    return P.rate_strategy(with_totals(_perf(spark, sf), trades))


# ---- sweep and walk-forward on weekly brand bars -------------------------------------------------
GRID = [(a, b) for a in (3, 5, 8, 10, 12, 15, 20) for b in (20, 25, 30, 40, 50, 60, 75, 90, 100, 120) if a < b]
_LEN = sorted({x for g in GRID for x in g})
_SW = D.BRAND_WEEK + ",\nbp AS (SELECT code, ts AS date, amount / volume AS close FROM bars),\nbm AS (SELECT *, row_number() OVER w AS i, lag(date) OVER w AS pdate, coalesce(close / lag(close) OVER w - 1, 0) AS r, " + \
    ", ".join(f"{avg(n)} AS m{n}" for n in _LEN) + f" FROM bp {W}),\nbg AS (SELECT code, date, r, unnest([" + ", ".join(
        f"{{'pid': {k}, 'sig': CASE WHEN i <= {b} THEN 0e0 WHEN m{a} > m{b} THEN 1e0 WHEN m{a} < m{b} THEN -1e0 ELSE 0e0 END}}" for k, (a, b) in enumerate(GRID)) + """], recursive := true) FROM bm),
bw AS (SELECT *, coalesce(sig / nullif(count_if(sig <> 0) OVER (PARTITION BY pid, date), 0), 0) AS weight FROM bg),
bl AS (SELECT pid, date, r, weight, coalesce(lag(weight) OVER (PARTITION BY pid, code ORDER BY date), 0) AS pw FROM bw),
br AS (SELECT pid, date, sum(pw * r) - sum(abs(weight - pw) * """ + _RATE + """ + greatest(pw - weight, 0) * 0.0005) AS net FROM bl GROUP BY 1, 2),""" + perf_sql("br", "pid")


def _brand_panel(spark, sf):
    return D.brand_bars(spark, sf, "week").select("code", c("ts").alias("date"), (c("amount") / c("volume")).alias("close"))


@query("p14_parameter_sweep", "pid:i place:i " + _METRICS, _SW + """
---
SELECT *, row_number() OVER (ORDER BY round(sharpe_ratio, 9) DESC, pid) AS place FROM pf""")
def sweep(spark, sf):
    return P.sweep(_brand_panel(spark, sf), GRID)


_WF = _SW + """,
dx AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS i FROM (SELECT DISTINCT date FROM br)),
wn AS (SELECT unnest(range((SELECT (max(i) + 1 - 120) // 20 FROM dx))) AS win),
tr AS (SELECT win, pid, avg(net) / nullif(stddev_samp(net), 0) * sqrt(252e0) AS train_sharpe FROM br JOIN dx USING (date) JOIN wn ON i > win * 20 AND i < win * 20 + 120 GROUP BY 1, 2),
bs AS (SELECT win, pid, coalesce(train_sharpe, 0) AS train_sharpe FROM tr QUALIFY row_number() OVER (PARTITION BY win ORDER BY round(coalesce(train_sharpe, 0), 9) DESC, pid) = 1),
te AS (SELECT win, pid, train_sharpe, exp(sum(ln(greatest(1 + net, 1e-12)))) - 1 AS test_return FROM bs JOIN br USING (pid) JOIN dx USING (date) WHERE i > 120 + win * 20 AND i < 140 + win * 20 GROUP BY 1, 2, 3),
wf AS (SELECT *, exp(sum(ln(greatest(1 + test_return, 1e-12))) OVER (ORDER BY win ROWS UNBOUNDED PRECEDING)) AS oos_equity FROM te)"""


def _walk(spark, sf):
    return P.walk_forward(P.returns_from_states(P.ma_grid_states(_brand_panel(spark, sf), GRID)))


@query("p15_walk_forward", "win:i pid:i train_sharpe:f6 test_return:f6 oos_equity:f6", _WF + "\n---\nSELECT * FROM wf")
def walk(spark, sf):
    return _walk(spark, sf)


@query("p15_parameter_votes", "pid:i times:i wins:i", _WF + "\n---\nSELECT pid, count(*) AS times, count_if(test_return > 0) AS wins FROM wf GROUP BY 1")
def votes(spark, sf):
    return P.parameter_votes(_walk(spark, sf))
