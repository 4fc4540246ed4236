"""Screen queries on the monthly panel, weekly brand bars and derived statements."""

from pyspark.sql import functions as F

from barloom.operators import fundamentals as U
from barloom.operators import screens as X
from barloom.plans import bindings as D
from barloom.plans import fundamentals as PF
from barloom.plans.frames import BASE, MACD, ema, over, span, staged
from barloom.plans.indicators import _BOLL, _RSI14
from barloom.plans.registry import query

c = F.col
DAY = D.PANEL + """,
dy AS (SELECT code, date, close, (close / lag(close) OVER w - 1) * 10 AS pct_chg, volume / 20 AS turnover_rate, trades, volume FROM panel WINDOW w AS (PARTITION BY code ORDER BY date))"""


def day(spark, sf):
    return D.panel(spark, sf).select("code", "date", "close", ((c("close") / X.S.lag("close") - 1) * 10).alias("pct_chg"), (c("volume") / 20).alias("turnover_rate"), "trades", "volume")


MG = DAY + """,
ms AS (SELECT s_suppkey AS code, CASE WHEN s_nationkey % 7 = 0 THEN 'ST ' || s_name ELSE s_name END AS name, CASE WHEN s_nationkey % 9 = 0 THEN 'BJ' ELSE 'SZ' END AS exchange, abs(s_acctbal) * 1000 AS total_mv FROM supplier),
mg AS (SELECT dy.*, name, total_mv FROM dy LEFT JOIN ms USING (code) WHERE NOT coalesce(name LIKE '%ST%', false) AND NOT coalesce(exchange = 'BJ', false))"""


def merged(spark, sf):
    d = day(spark, sf)
    s = D.table(spark, sf, "supplier")
    m = s.select(c("s_suppkey").alias("code"), F.when(c("s_nationkey") % 7 == 0, F.concat(F.lit("ST "), c("s_name"))).otherwise(c("s_name")).alias("name"),
                 F.when(c("s_nationkey") % 9 == 0, "BJ").otherwise("SZ").alias("exchange"), (F.abs("s_acctbal") * 1000).alias("total_mv"))
    return X.merge_daily(d.select("code", "date", "close", "turnover_rate", "trades", "volume"), d.select("code", "date", "pct_chg"), m)


@query("s01_daily_merge", "code:i date:d pct_chg:f6 turnover_rate:f4 name:s", MG + "\n---\nSELECT * FROM mg")
def daily_merge(spark, sf):
    return merged(spark, sf)


@query("s02_cap_filter", "code:i date:d total_mv:f2", MG + "\n---\nSELECT * FROM mg WHERE total_mv >= 1e6 AND total_mv <= 5e6")
def cap_filter(spark, sf):
    return X.cap_filter(merged(spark, sf), "mid")


@query("s03_nearest_earlier_day", "date:d used:d", """
w AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders), a AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS d FROM lineitem WHERE isodow(l_shipdate) <= 4)
---
SELECT w.date, max(a.d) AS used FROM w LEFT JOIN a ON a.d BETWEEN w.date - 5 AND w.date GROUP BY 1""")
def nearest(spark, sf):
    w = D.table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("date")).distinct()
    a = D.table(spark, sf, "lineitem").where(F.weekday("l_shipdate") < 4).select(F.to_date("l_shipdate").alias("date")).distinct()
    return X.nearest_earlier(w, a)


@query("s04_momentum_breakthrough", "date:d place:i code:i score:f4", MG + """,
sc AS (SELECT date, code, round((greatest(-10, least(10, p)) * 5 + 50) * 0.3 + least(t, 20) * 5 * 0.25 + CASE WHEN p > 0 THEN 20 ELSE 0 END + CASE WHEN p > 2 AND t >= 1.5 THEN 15 ELSE 0 END + greatest(0, least(100, CASE WHEN p > 5 THEN 80 + p * 2 ELSE 60 + p * 4 END)) * 0.1, 4) AS score
  FROM (SELECT *, coalesce(pct_chg, 0) AS p, coalesce(turnover_rate, 0) AS t FROM mg))
---
SELECT *, row_number() OVER (PARTITION BY date ORDER BY score DESC, code) AS place FROM sc QUALIFY place <= 10""")
def momentum(spark, sf):
    return X.top_by(X.momentum_breakthrough(merged(spark, sf)), 10)


_tb, _tl = staged([{**MACD[0], "g": "CASE WHEN d IS NOT NULL THEN greatest(d, 0) END", "l": "CASE WHEN d IS NOT NULL THEN greatest(-d, 0) END", "e20": ema("close", span(20)), "e50": ema("close", span(50)), **_BOLL[0],
                    "vr": f"coalesce(volume / {over('avg(volume)', 20, 1)}, 1)"}, {**MACD[1], **_RSI14[1], **_BOLL[1]}, {**MACD[2], **_RSI14[2]},
                   {"sr": "CASE WHEN rsi IS NULL THEN 50 ELSE greatest(0, (rsi - 30) * 1.43) END", "smx": "CASE WHEN dif > dea AND lag(dif) OVER w <= lag(dea) OVER w THEN 100 WHEN dif > dea THEN 70 WHEN dif > 0 THEN 50 ELSE 20 END",
                    "stx": "50 + CASE WHEN close > e20 THEN 30 ELSE 0 END + CASE WHEN close > e50 THEN 20 ELSE 0 END", "sb": "coalesce(greatest(0, least(100, (close - lo) / nullif(up - lo, 0) * 100)), 50)"},
                   {"score": "sr * 0.2 + smx * 0.25 + least(100, volume / 10 * 6.67) * 0.2 + stx * 0.2 + least(100, sb + greatest(0, least(30, (vr - 1) * 15))) * 0.15"}])


@query("s05_technical_breakthrough", "code:s ts:d rsi:f4 volume_ratio:f4 score:f4 breakthrough:b", f"{_tb}\n---\nSELECT code, ts, rsi, vr AS volume_ratio, score, score >= 60 AS breakthrough FROM {_tl} WHERE i >= 4 AND (rsi IS NULL OR rsi BETWEEN 30 AND 80)")
def technical(spark, sf):
    return X.technical_breakthrough(D.brand_bars(spark, sf, "week"))


@query("s06_oversold_rebound", "code:i date:d score:f4 rebound:b", MG + """,
md AS (SELECT *, (pct_chg + 30) AS rsi, median(turnover_rate) OVER (PARTITION BY date) AS med, coalesce(pct_chg, 0) AS p FROM mg),
os AS (SELECT *, least(100, greatest(-p, 0) * 2 + 20 + greatest(turnover_rate / greatest(med, 0.1) - 1, 0) * 3 + CASE WHEN p > 0 THEN 10 WHEN p > -3 THEN 5 ELSE 0 END) AS score FROM md)
---
SELECT code, date, score, score >= 40 AS rebound FROM os WHERE (rsi IS NULL OR rsi BETWEEN 10 AND 50) AND turnover_rate >= 0.5""")
def oversold(spark, sf):
    return X.oversold_rebound(merged(spark, sf).withColumn("rsi", c("pct_chg") + 30))


@query("s07_limit_up_leaders", "code:i date:d limit_times:i open_times:i score:f2 is_leader:b", DAY + """,
lh AS (SELECT *, coalesce(pct_chg >= 3, false) AS hit, row_number() OVER w AS i, trades % 4 AS open_times FROM dy WINDOW w AS (PARTITION BY code ORDER BY date)),
ls AS (SELECT *, i - coalesce(max(CASE WHEN NOT hit THEN i END) OVER (PARTITION BY code ORDER BY date ROWS UNBOUNDED PRECEDING), 0) AS limit_times FROM lh)
---
SELECT code, date, limit_times, open_times, limit_times * 10 AS score, limit_times >= 3 AND open_times <= 1 AS is_leader FROM ls WHERE limit_times BETWEEN 1 AND 10 AND open_times <= 2 AND turnover_rate BETWEEN 1 AND 50""")
def leaders(spark, sf):
    d = X.limit_streaks(day(spark, sf), 3.0).withColumn("open_times", c("trades") % 4)
    return X.limit_up_leaders(d, (1, 10), 2, (1.0, 50.0))


# ---- statement screens ---------------------------------------------------------------------------
_RAT = {"roe": "n_income_attr_p / equity * 400", "current_ratio": "current_assets / nullif(current_liab, 0)", "debt_ratio": "total_liab / total_assets * 100", "gross_margin": "(1 - total_cogs / revenue) * 100",
        "net_margin": "n_income / revenue * 100", "roic": "n_income / (equity + st_borr) * 300", "quick_ratio": "(current_assets - inventories) / nullif(current_liab, 0)"}
RT = PF.ST + ",\nrt AS (SELECT code, end_date, n_income, revenue, total_share, " + ", ".join(f"{v} AS {k}" for k, v in _RAT.items()) + """,
  (revenue / lag(revenue, 4) OVER w - 1) * 100 AS revenue_growth, (n_income - lag(n_income, 4) OVER w) / nullif(abs(lag(n_income, 4) OVER w), 0) * 100 AS profit_growth, row_number() OVER (PARTITION BY code ORDER BY end_date DESC) AS r FROM st WINDOW w AS (PARTITION BY code ORDER BY end_date)),
av AS (SELECT code, count(*) AS periods, """ + ", ".join(f"avg({k}) FILTER (r <= 8) AS avg_{k}" for k in [*_RAT, "revenue_growth", "profit_growth"]) + """, avg(profit_growth) FILTER (r <= 4) AS eps_growth_4q FROM rt GROUP BY 1),
va AS (SELECT av.*, abs(s_acctbal) / 300 AS pe, abs(s_acctbal) / 2000 + 0.5 AS pb, abs(s_acctbal) / 10 AS mv_yi, avg_profit_growth AS avg_eps_growth FROM av JOIN supplier ON s_suppkey = code)"""


def _ratios(spark, sf):
    st = PF.statements(spark, sf)
    s = U.S
    return st.select("code", "end_date", *[F.expr(v).alias(k) for k, v in _RAT.items()], ((c("revenue") / s.lag("revenue", 4) - 1) * 100).alias("revenue_growth"),
                     (F.try_divide(c("n_income") - s.lag("n_income", 4), F.abs(s.lag("n_income", 4))) * 100).alias("profit_growth"))


def _averages(spark, sf):
    r = _ratios(spark, sf)
    a = X.last_period_means(r, [*_RAT, "revenue_growth", "profit_growth"])
    q4 = X.last_period_means(r, ["profit_growth"], 4, "q4_").select("code", c("q4_profit_growth").alias("eps_growth_4q"))
    s = D.table(spark, sf, "supplier").select(c("s_suppkey").alias("code"), (F.abs("s_acctbal") / 300).alias("pe"), (F.abs("s_acctbal") / 2000 + 0.5).alias("pb"), (F.abs("s_acctbal") / 10).alias("mv_yi"))
    return a.join(q4, "code").join(s, "code").withColumn("avg_eps_growth", c("avg_profit_growth"))


@query("s08_value_investment", "code:i score:f4", RT + """
---
SELECT code, least(avg_roe / 15, 2) * 20 + (least(avg_gross_margin / 30, 1.5) * 0.6 + least(avg_net_margin / 10, 2) * 0.4) * 25 + (greatest(1 - avg_debt_ratio / 100, 0) * 0.7 + least(avg_current_ratio / 2, 1) * 0.3) * 20 + (greatest(1 - pe / 50, 0) * 0.6 + greatest(1 - pb / 6, 0) * 0.4) * 15 AS score
FROM va WHERE pe > 0 AND pe <= 30 AND pb > 0 AND pb <= 5 AND periods >= 4 AND avg_roe >= 5 AND avg_current_ratio >= 1 AND avg_debt_ratio <= 60 AND avg_profit_growth >= -50 AND avg_gross_margin >= 20 AND avg_net_margin >= 3""")
def value(spark, sf):
    return X.value_investment(_averages(spark, sf), dict(pe_max=30, pb_max=5, roe=5, current=1, debt=60, growth=-50, gross=20, net=3))


@query("s09_growth_stock", "code:i peg:f4 score:f4", RT + """,
gs AS (SELECT *, least(greatest(pe, 0.01) / greatest(coalesce(eps_growth_4q, 0), 0.01), 999) AS peg FROM va WHERE (avg_eps_growth >= 20 OR avg_revenue_growth >= 5) AND (avg_roic >= 10)::INT + (avg_gross_margin >= 30)::INT + (avg_net_margin >= 5)::INT >= 2 AND avg_debt_ratio < 60 AND avg_quick_ratio > 0.8)
---
SELECT code, peg, least(avg_eps_growth, 50) * 0.4 + least(avg_revenue_growth, 50) * 0.4 + least(avg_roic, 25) * 0.7 + least(avg_gross_margin, 80) * 0.25 + least(avg_net_margin, 40) * 0.5 + CASE WHEN avg_debt_ratio < 50 THEN 5 ELSE 0 END + CASE WHEN avg_quick_ratio > 1.2 THEN 5 ELSE 0 END
  + CASE WHEN peg BETWEEN 0.1 AND 2 THEN 10 ELSE 0 END AS score FROM gs""")
def growth(spark, sf):
    return X.growth_stock(_averages(spark, sf), dict(eps_growth=20, revenue_growth=5, roic=10, gross=30, net=5, debt=60, quick=0.8, peg_min=0.1, peg_max=2))


@query("s10_high_dividend", "code:i dividend_yield:f4 payout_ratio:f4 dividend_financing:f4 score:f4", PF.ST + f""",
lv AS (SELECT code, arg_max(n_income_attr_p, end_date) AS np, arg_max(n_income_attr_p / total_share, end_date) AS eps, arg_max(revenue * 0.05, end_date) AS paid, arg_max(lt_borr, end_date) AS fin, arg_max(n_income_attr_p / equity * 100, end_date) AS roe,
  arg_max(n_income_attr_p * 0.3 / total_share, end_date) FILTER (n_income_attr_p > 0) AS cash_div FROM st GROUP BY 1),
hd AS (SELECT code, eps, roe, abs(s_acctbal) / 300 AS pe, abs(s_acctbal) / 2000 + 0.5 AS pb, abs(s_acctbal) / 10 AS mv_yi, CASE WHEN cash_div > 0 THEN cash_div / (abs(s_acctbal) + 100) * 100 ELSE 0 END AS dividend_yield,
  CASE WHEN paid > 0 AND np > 0 THEN least(100, paid / np * 100) ELSE 0 END AS payout_ratio, CASE WHEN paid > 0 AND fin > 0 THEN least(200, paid / fin * 100) ELSE 0 END AS dividend_financing FROM lv JOIN supplier ON s_suppkey = code)
---
SELECT *, dividend_yield * 8 + least(roe, 20) * 2 + least(mv_yi / 10, 10) + CASE WHEN payout_ratio > 20 THEN least(payout_ratio / 5, 10) ELSE 0 END + 20 AS score FROM hd WHERE eps > 0 AND mv_yi >= 10 AND dividend_yield >= 1 AND pe > 0 AND pe < 30 AND pb > 0 AND pb < 6""")
def dividend(spark, sf):
    st = PF.statements(spark, sf)
    last = U.latest(st).select("code", c("n_income_attr_p").alias("net_profit"), (c("n_income_attr_p") / c("total_share")).alias("eps"), (c("revenue") * 0.05).alias("dividend_paid"),
                               c("lt_borr").alias("financing_in"), (c("n_income_attr_p") / c("equity") * 100).alias("roe"))
    div = X.latest_valid(st.select("code", "end_date", F.when(c("n_income_attr_p") > 0, c("n_income_attr_p") * 0.3 / c("total_share")).alias("cash_div")), "cash_div").select("code", "cash_div")
    s = D.table(spark, sf, "supplier").select(c("s_suppkey").alias("code"), (F.abs("s_acctbal") / 300).alias("pe"), (F.abs("s_acctbal") / 2000 + 0.5).alias("pb"), (F.abs("s_acctbal") / 10).alias("mv_yi"), (F.abs("s_acctbal") + 100).alias("close"))
    return X.high_dividend(last.join(div, "code", "left").join(s, "code"), {"eps": 0, "mv": 10, "yield": 1, "pe": 30, "pb": 6})


@query("s11_fund_flow", "code:i buy_trend:f4 balance_growth:f4 composite:f4 score:f4", D.PANEL + """,
fm AS (SELECT code, high AS rzmre, close AS rzye, row_number() OVER (PARTITION BY code ORDER BY date) AS a, row_number() OVER (PARTITION BY code ORDER BY date DESC) AS z FROM panel WHERE date > (SELECT max(date) FROM panel) - 365),
fg AS (SELECT code, CASE WHEN count(*) >= 4 THEN (avg(rzmre) FILTER (z <= 2) / avg(rzmre) FILTER (a <= 2) - 1) * 100 END AS buy_trend, CASE WHEN count(*) >= 4 THEN (avg(rzye) FILTER (z <= 2) / avg(rzye) FILTER (a <= 2) - 1) * 100 END AS balance_growth FROM fm GROUP BY 1),
fc AS (SELECT *, coalesce(buy_trend, 0) * 0.6 + coalesce(balance_growth, 0) * 0.4 AS composite FROM fg)
---
SELECT *, greatest(0, least(100, composite * 2 + 50)) AS score FROM fc WHERE composite >= 6""")
def fund_flow(spark, sf):
    """A year of the monthly panel stands in for 90 daily rows."""
    return X.fund_flow(D.panel(spark, sf).select("code", "date", c("high").alias("rzmre"), c("close").alias("rzye")), days=365)


@query("s12_rank_by_strategies", "code:i total:f4 strategies:i", D.PANEL + """,
st AS (SELECT code, unnest(['low_price', 'wide_range']) AS strategy, unnest([greatest(0, 100 - close / 100), high / low]) AS score FROM panel QUALIFY row_number() OVER (PARTITION BY code ORDER BY date DESC) = 1),
sg AS (SELECT code, avg(score) AS total, count(*) AS strategies FROM st GROUP BY 1)
---
SELECT * FROM sg ORDER BY round(total, 6) DESC, code LIMIT 10""".replace("unnest(['low_price', 'wide_range']) AS strategy, unnest([greatest(0, 100 - close / 100), high / low]) AS score FROM panel QUALIFY", "unnest(['low_price', 'wide_range']) AS strategy, unnest([greatest(0, 100 - close / 100), high / low]) AS score FROM (SELECT * FROM panel QUALIFY").replace("ORDER BY date DESC) = 1),\nsg", "ORDER BY date DESC) = 1)),\nsg"))
def rank(spark, sf):
    last = U.latest(D.panel(spark, sf), order="date")
    s = last.select("code", F.inline(F.array(F.struct(F.lit("low_price").alias("strategy"), F.greatest(F.lit(0.0), 100 - c("close") / 100).alias("score")),
                                             F.struct(F.lit("wide_range").alias("strategy"), (c("high") / c("low")).alias("score")))))
    return X.rank_by_strategies(s)


@query("s13_structured_screen", "code:i price:f4 size:i sector:s", "SELECT p_partkey AS code, p_retailprice AS price, p_size AS size, p_type AS sector FROM part WHERE p_retailprice BETWEEN 950 AND 1500 AND p_size > 10 AND p_type IN ('ECONOMY', 'SMALL', 'PROMO') AND p_type NOT IN ('PROMO') ORDER BY price DESC, code LIMIT 25")
def structured(spark, sf):
    p = D.table(spark, sf, "part").select(c("p_partkey").alias("code"), c("p_retailprice").alias("price"), c("p_size").alias("size"), c("p_type").alias("sector"))
    return X.structured_screen(p, [("price", "between", (950, 1500)), ("size", ">", 10)], ["ECONOMY", "SMALL", "PROMO"], ["PROMO"], "price", True, 25)


@query("s14_reporting_periods", "date:d k:i period_end:d", """
w AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders)
---
SELECT date, k, CAST(date_trunc('quarter', date) - to_months(CAST(3 * k AS INTEGER)) AS DATE) - 1 AS period_end FROM w, range(8) t(k)""")
def periods(spark, sf):
    return X.reporting_periods(D.table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("date")).distinct())
