"""Statement, valuation, expectation and ownership queries.

Statements are derived from all line items per supplier and quarter; the formulas below only give
the columns varied signs and sizes.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

from barloom.functions.sums import exact_sum
from barloom.functions.windows import ladder
from barloom.operators import fundamentals as U
from barloom.plans import bindings as D
from barloom.plans.registry import query

c = F.col
INDUSTRIES = ["白酒", "银行", "钢铁", "计算机", "医药", "其他"]

# column -> formula, valid both as SQL text and as a Spark expression over the sums below
FORMULAS = {
    "revenue": "s", "total_cogs": "s * 0.5e0 + r * 0.45e0", "operate_profit": "s * 0.38e0 - r * 0.8e0", "total_profit": "s * 0.36e0 - r * 0.8e0 + o * 0.2e0",
    "n_income": "s * 0.28e0 - r * 0.6e0", "n_income_attr_p": "s * 0.26e0 - r * 0.57e0", "excite_income": "o * 0.3e0", "excite_tax": "t * 0.1e0",
    "total_assets": "s * 1.8e0 + mx", "total_liab": "s * 0.7e0 + a * 0.6e0", "equity": "s * 1.1e0 + mx - a * 0.6e0", "money_cap": "a * 1.4e0",
    "st_borr": "r * 0.9e0", "lt_borr": "nf * 0.6e0", "bond_payable": "mx * 0.2e0", "accounts_receiv": "r * 0.6e0", "inventories": "a * 0.4e0",
    "goodwill": "mx * 1.5e0", "cip": "nf * 0.35e0", "fix_assets_total": "s * 0.22e0", "prepayment": "mx * 0.8e0", "cfo": "s * 0.3e0 - r * 0.5e0 - a * 0.3e0",
    "cfi": "a * 0.2e0 - s * 0.08e0", "cff": "r * 0.2e0 - nf * 0.15e0", "capex": "s * 0.06e0", "contract_liab": "nf * 0.1e0", "total_share": "n * 10e0",
    "expenses": "s * 0.1e0 + o", "current_assets": "a * 1.4e0 + r", "current_liab": "r * 0.9e0 + nf * 0.3e0", "roe_pct": "(s * 0.26e0 - r * 0.57e0) / (s * 1.1e0 + mx - a * 0.6e0) * 100e0",
    "minority_income": "s * 0.02e0 - r * 0.03e0", "related_sales": "nf * 0.9e0", "rd_total": "o", "rd_capitalised": "t * 1.1e0"}
_SUMS_SQL = """sum(l_extendedprice) AS s, sum(CASE WHEN l_returnflag = 'R' THEN l_extendedprice ELSE 0 END) AS r,
  sum(CASE WHEN l_returnflag = 'A' THEN l_extendedprice ELSE 0 END) AS a, sum(CASE WHEN l_returnflag = 'N' THEN l_extendedprice ELSE 0 END) AS nf,
  sum(l_extendedprice * l_discount) AS o, sum(l_extendedprice * l_tax) AS t, max(l_extendedprice) AS mx, count(*) AS n"""
_IND_SQL = "(['" + "','".join(INDUSTRIES) + "'])[1 + code % 6]"


def _st_sql(unit, name):
    return f"""
{name}0 AS (SELECT l_suppkey AS code, CAST(date_trunc('{unit}', l_shipdate) AS DATE) AS end_date, {_SUMS_SQL} FROM lineitem GROUP BY 1, 2),
{name} AS (SELECT code, end_date, end_date + 45 AS ann_date, {', '.join(f'{v} AS {k}' for k, v in FORMULAS.items())}, {_IND_SQL} AS industry,
  'A' || CAST(n % 2 AS VARCHAR) AS auditor, CASE WHEN n % 7 = 0 THEN 'qualified' ELSE 'standard' END AS audit_opinion FROM {name}0)"""


ST, AN = _st_sql("quarter", "st"), _st_sql("year", "an")
L = "QUALIFY row_number() OVER (PARTITION BY code ORDER BY end_date DESC) <= {n}"
W = "WINDOW w AS (PARTITION BY code ORDER BY end_date)"


def statements(spark, sf, unit="quarter", total=F.sum):
    li = D.table(spark, sf, "lineitem")
    p = c("l_extendedprice")
    flag = lambda x: total(F.when(c("l_returnflag") == x, p).otherwise(0.0))
    g = li.groupBy(c("l_suppkey").alias("code"), F.trunc("l_shipdate", unit).alias("end_date")).agg(
        total(p).alias("s"), flag("R").alias("r"), flag("A").alias("a"), flag("N").alias("nf"), total(p * c("l_discount")).alias("o"),
        total(p * c("l_tax")).alias("t"), F.max(p).alias("mx"), F.count(F.lit(1)).alias("n"))
    return g.select(
        "code", "end_date", F.date_add("end_date", 45).alias("ann_date"), *[F.expr(v).alias(k) for k, v in FORMULAS.items()],
        F.element_at(F.array(*[F.lit(x) for x in INDUSTRIES]), (c("code") % 6 + 1).cast("int")).alias("industry"),
        F.concat(F.lit("A"), (c("n") % 2).cast("string")).alias("auditor"), F.when(c("n") % 7 == 0, "qualified").otherwise("standard").alias("audit_opinion"))


def q(name, spec, sql):
    return query(name, spec, sql)


def latest_sql(src, n=1, cols="*"):
    return f"SELECT {cols} FROM {src} {L.format(n=n)}"


@q("u01_statement_join", "code:i end_date:d revenue:f4 total_assets:f4 cfo:f4", ST + "\n---\n" + latest_sql("st", 4))
def statement_join(spark, sf):
    s = statements(spark, sf)
    return U.join_statements(s.select("code", "end_date", "revenue"), s.select("code", "end_date", "total_assets"), s.select("code", "end_date", "cfo"))


@q("u01_point_in_time", "code:i date:d end_date:d revenue:f2", D.PANEL + "," + ST + """
---
SELECT p.code, p.date, st.end_date, st.revenue FROM panel p ASOF LEFT JOIN st ON p.code = st.code AND p.date >= st.ann_date""")
def point_in_time(spark, sf):
    return U.point_in_time(D.panel(spark, sf).select("code", "date"), statements(spark, sf), ["revenue"])


CHECKS = f"""
ck AS (SELECT code, end_date, n_income_attr_p / equity AS equity_ratio, (n_income - cfo) / total_assets AS accrual_ratio,
  CASE WHEN n_income_attr_p / equity > 0 AND n_income_attr_p / equity < 0.5 THEN 'ok' ELSE 'warning' END AS equity_check,
  CASE WHEN abs((n_income - cfo) / total_assets) < 0.1 THEN 'ok' ELSE 'warning' END AS accrual_check,
  CASE WHEN cfo > 0 AND money_cap > 0 THEN 'ok' WHEN cfo < 0 AND money_cap > total_assets * 0.3 THEN 'warning' ELSE 'info' END AS cash_check FROM ({latest_sql('st')})),
ckw AS (SELECT *, (equity_check = 'warning')::INT + (accrual_check = 'warning')::INT + (cash_check = 'warning')::INT AS warnings FROM ck)"""


@q("u02_statement_checks", "code:i end_date:d equity_ratio:f6 accrual_ratio:f6 equity_check:s accrual_check:s cash_check:s warnings:i", ST + "," + CHECKS + "\n---\nSELECT * FROM ckw")
def checks(spark, sf):
    return U.statement_checks(statements(spark, sf))


QUALITY = f"""
qa AS (SELECT *, row_number() OVER w AS n, revenue / lag(revenue) OVER w - 1 AS gr, accounts_receiv / nullif(lag(accounts_receiv) OVER w, 0) - 1 AS ga, cfo - lag(cfo) OVER w AS dc,
  avg(CASE WHEN cfo > 0 THEN 1e0 ELSE 0 END) OVER (w ROWS 3 PRECEDING) AS pos, total_cogs / nullif(inventories, 0) AS turn FROM st {W}),
qb AS (SELECT *, turn - lag(turn) OVER w AS dt FROM qa {W}),
qc AS (SELECT code, end_date, CASE WHEN n_income_attr_p > 0 THEN CASE WHEN cfo / n_income_attr_p > 1.2 THEN 3 WHEN cfo / n_income_attr_p > 0.8 THEN 2 ELSE 1 END WHEN n_income_attr_p < 0 THEN CASE WHEN cfo > 0 THEN 2 ELSE 1 END ELSE 2 END AS cash_item,
  CASE WHEN gr IS NULL OR ga IS NULL THEN 2 WHEN ga < gr THEN 3 WHEN ga < gr * 1.5 THEN 2 ELSE 1 END AS receivable_item,
  CASE WHEN n_income_attr_p = 0 OR excite_income = excite_tax THEN 2 WHEN (n_income_attr_p - excite_income + excite_tax) / n_income_attr_p > 0.9 THEN 3 WHEN (n_income_attr_p - excite_income + excite_tax) / n_income_attr_p > 0.7 THEN 2 ELSE 1 END AS core_item,
  CASE WHEN n < 2 THEN 2 WHEN pos = 1 AND dc > 0 THEN 3 WHEN pos >= 0.5 THEN 2 ELSE 1 END AS trend_item,
  CASE WHEN dt IS NULL THEN 2 WHEN dt > 0 THEN 3 WHEN abs(dt) < 0.1 THEN 2 ELSE 1 END AS inventory_item FROM ({latest_sql('qb')})),
qd AS (SELECT *, (cash_item * 5 + (receivable_item + core_item + trend_item) * 4 + inventory_item * 3) / 20e0 AS quality FROM qc)"""


@q("u03_earnings_quality", "code:i end_date:d cash_item:i receivable_item:i core_item:i trend_item:i inventory_item:i quality:f4 quality_level:s", ST + "," + QUALITY + """
---
SELECT *, CASE WHEN quality >= 2.5 THEN 'excellent' WHEN quality >= 2 THEN 'good' WHEN quality >= 1.5 THEN 'fair' ELSE 'poor' END AS quality_level FROM qd""")
def quality(spark, sf):
    return U.earnings_quality(statements(spark, sf))


_FLAGS = ["f1_cash_and_debt", "f2_receivables", "f3_inventory", "f4_paper_profit", "f7_construction", "f8_prepayment", "f12_goodwill"]
FLAGS = f"""
fa AS (SELECT *, accounts_receiv / nullif(lag(accounts_receiv) OVER w, 0) - 1 AS ga, revenue / lag(revenue) OVER w - 1 AS gr, inventories / revenue AS iv,
  sum(CASE WHEN cfo < 0 AND n_income > 0 THEN 1 ELSE 0 END) OVER (w ROWS 3 PRECEDING) AS paper FROM st {W}),
fb AS (SELECT *, sum(CASE WHEN ga > gr * 1.5 AND ga > 0 THEN 1 ELSE 0 END) OVER (w ROWS 1 PRECEDING) AS ar, iv / nullif(lag(iv) OVER w, 0) AS ivr FROM fa {W}),
fc AS (SELECT code, end_date, money_cap / total_assets > 0.3 AND (st_borr + lt_borr + bond_payable) / total_assets > 0.3 AS f1_cash_and_debt, ar >= 2 AS f2_receivables,
  coalesce(ivr > 1.5, false) AS f3_inventory, paper >= 2 AS f4_paper_profit, cip / fix_assets_total > 0.5 AS f7_construction, prepayment / total_assets > 0.1 AS f8_prepayment,
  goodwill / equity > 0.3 AS f12_goodwill FROM ({latest_sql('fb')})),
fd AS (SELECT *, {' + '.join(f'{x}::INT' for x in _FLAGS)} AS triggered FROM fc)"""


@q("u04_red_flags", "code:i end_date:d " + " ".join(f"{x}:b" for x in _FLAGS) + " triggered:i risk_level:s", ST + "," + FLAGS + """
---
SELECT *, CASE WHEN triggered <= 1 THEN 'low' WHEN triggered <= 3 THEN 'medium' WHEN triggered <= 5 THEN 'high' ELSE 'extreme' END AS risk_level FROM fd""")
def red_flags(spark, sf):
    return U.red_flags(statements(spark, sf))


def _dupont_sql(n):
    return f"""
da AS (SELECT code, end_date, n_income_attr_p / revenue AS net_margin, revenue / total_assets AS asset_turnover, total_assets / equity AS equity_multiplier,
  coalesce(n_income_attr_p / nullif(total_profit, 0), 0) AS tax_burden, coalesce(total_profit / nullif(operate_profit, 0), 0) AS interest_burden, operate_profit / revenue AS operating_margin FROM ({latest_sql('st', n)})),
db AS (SELECT *, net_margin * asset_turnover * equity_multiplier AS roe FROM da),
dc AS (SELECT *, CASE WHEN round(roe, 4) <= 0 THEN 'loss' WHEN net_margin >= asset_turnover AND net_margin >= equity_multiplier THEN 'profitability' WHEN asset_turnover >= equity_multiplier THEN 'efficiency' ELSE 'leverage' END AS driver FROM db)"""


@q("u05_dupont", "code:i end_date:d roe:f6 net_margin:f6 asset_turnover:f6 equity_multiplier:f6 tax_burden:f4 interest_burden:f4 operating_margin:f6 driver:s", ST + "," + _dupont_sql(4) + "\n---\nSELECT * FROM dc")
def dupont(spark, sf):
    return U.dupont(statements(spark, sf))


MATRIX = f"""
ma AS (SELECT code, end_date, cfo, CASE WHEN cfo > 0 THEN '+' ELSE '-' END || CASE WHEN cfi < 0 THEN '-' ELSE '+' END || CASE WHEN cff < 0 THEN '-' ELSE '+' END AS pattern FROM ({latest_sql('st')})),
mb AS (SELECT *, CASE pattern WHEN '+--' THEN 'excellent' WHEN '+-+' THEN 'expanding' WHEN '++-' THEN 'steady' WHEN '--+' THEN 'dangerous' WHEN '-++' THEN 'distress' WHEN '-+-' THEN 'declining' ELSE 'unclear' END AS status,
  CASE WHEN cfo > 0 THEN 'healthy' WHEN cfo < 0 THEN 'warning' ELSE 'neutral' END AS cash_quality FROM ma)"""


@q("u06_cash_flow_matrix", "code:i end_date:d pattern:s status:s cash_quality:s", ST + "," + MATRIX + "\n---\nSELECT * FROM mb")
def matrix(spark, sf):
    return U.cash_flow_matrix(statements(spark, sf))


@q("u07_health_score", "code:i score:f4 rating:s", ST + "," + CHECKS + "," + QUALITY + "," + FLAGS + "," + _dupont_sql(1) + "," + MATRIX + """,
hs AS (SELECT code, greatest(0, 100 - warnings * 15) * 0.15e0 + quality / 3 * 30e0 + greatest(0, 100 - triggered * 18) * 0.25e0
  + CASE driver WHEN 'profitability' THEN 90 WHEN 'efficiency' THEN 80 WHEN 'leverage' THEN 55 ELSE 20 END * 0.15e0 + CASE cash_quality WHEN 'healthy' THEN 90 WHEN 'warning' THEN 30 ELSE 60 END * 0.15e0 AS score
  FROM ckw JOIN qd USING (code) JOIN fd USING (code) JOIN dc USING (code) JOIN mb USING (code))
---
SELECT *, CASE WHEN score >= 80 THEN 'excellent' WHEN score >= 65 THEN 'good' WHEN score >= 50 THEN 'average' WHEN score >= 35 THEN 'weak' ELSE 'dangerous' END AS rating FROM hs""")
def health(spark, sf):
    return U.health_score(statements(spark, sf))


@q("u08_annual_growth", "code:i current:f2 yoy_growth:f6 avg_growth:f6 trend:s stability:s", AN + f""",
g AS (SELECT code, end_date, revenue, revenue / lag(revenue) OVER w - 1 AS g FROM an {W}),
h AS (SELECT code, arg_max(revenue, end_date) AS current, arg_max(g, end_date) * 100 AS yoy_growth, avg(g) * 100 AS avg_growth, stddev_samp(g) AS sd FROM g GROUP BY 1 HAVING count(*) >= 2)
---
SELECT *, CASE WHEN yoy_growth > 0 THEN 'up' ELSE 'down' END AS trend, CASE WHEN sd < 0.1 THEN 'stable' ELSE 'volatile' END AS stability FROM h""")
def annual_growth(spark, sf):
    return U.growth_summary(statements(spark, sf, "year"))


@q("u09_quarterly_growth", "code:i end_date:d qoq_revenue:f4 qoq_profit:f4 net_margin:f6 cash_stability:s", ST + f"""
---
SELECT code, end_date, (revenue / lag(revenue) OVER w - 1) * 100 AS qoq_revenue, (n_income - lag(n_income) OVER w) / nullif(abs(lag(n_income) OVER w), 0) * 100 AS qoq_profit, n_income / revenue * 100 AS net_margin,
  CASE WHEN stddev_pop(cfo) OVER (PARTITION BY code) < avg(cfo) OVER (PARTITION BY code) * 0.3 THEN 'stable' ELSE 'volatile' END AS cash_stability FROM st {W}""")
def quarterly(spark, sf):
    return U.quarterly_profile(statements(spark, sf))


@q("u10_margin_trend", "code:i current_margin:f6 avg_margin:f6 margin_range:f6 trend:s stability:s seasonality:s", ST + f""",
m AS (SELECT code, end_date, (1 - total_cogs / revenue) * 100 AS m FROM st), mp AS (SELECT *, lag(m) OVER w AS p FROM m {W}),
g AS (SELECT code, arg_max(m, end_date) AS current_margin, avg(m) AS avg_margin, stddev_pop(m) AS sd, max(m) - min(m) AS margin_range, arg_max(p, end_date) AS p FROM mp GROUP BY 1)
---
SELECT *, CASE WHEN current_margin > p THEN 'up' ELSE 'down' END AS trend, CASE WHEN sd < 5 THEN 'stable' ELSE 'volatile' END AS stability, CASE WHEN margin_range > 10 THEN 'marked' ELSE 'flat' END AS seasonality FROM g""")
def margins(spark, sf):
    return U.margin_trend(statements(spark, sf))


@q("u11_segment_mix", "code:i end_date:d item:s sales:f2 margin_pct:f6 share_pct:f6 change_pct:f4", """
d AS (SELECT l_suppkey AS code, CAST(date_trunc('year', l_shipdate) AS DATE) AS end_date, p_type AS item, sum(l_extendedprice) AS sales, sum(l_extendedprice * (0.4e0 - l_discount)) AS profit
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3),
r AS (SELECT *, dense_rank() OVER (PARTITION BY code ORDER BY end_date DESC) AS r FROM d)
---
SELECT a.code, a.end_date, a.item, a.sales, a.profit / a.sales * 100 AS margin_pct, a.sales / sum(a.sales) OVER (PARTITION BY a.code) * 100 AS share_pct, (a.sales / b.sales - 1) * 100 AS change_pct
FROM (SELECT * FROM r WHERE r = 1) a LEFT JOIN (SELECT * FROM r WHERE r = 2) b ON a.code = b.code AND a.item = b.item""")
def segments(spark, sf):
    li, part = D.table(spark, sf, "lineitem"), D.table(spark, sf, "part")
    d = li.join(part, li.l_partkey == part.p_partkey).groupBy(
        c("l_suppkey").alias("code"), F.trunc("l_shipdate", "year").alias("end_date"), c("p_type").alias("item")).agg(
        F.sum("l_extendedprice").alias("sales"), F.sum(c("l_extendedprice") * (0.4 - c("l_discount"))).alias("profit"))
    return U.segment_mix(d)


def _streak(col):
    return f"""sk0 AS (SELECT *, row_number() OVER w AS i, lag({col}) OVER w AS pv FROM st {W}),
sk1 AS (SELECT *, i - max(CASE WHEN NOT coalesce({col} > pv, false) THEN i END) OVER (w ROWS UNBOUNDED PRECEDING) AS streak FROM sk0 {W})"""


@q("u12_contract_liabilities", "code:i end_date:d current:f2 growth_rate:f4 streak:i indicator:s", ST + "," + _streak("contract_liab") + f""",
l AS ({latest_sql('sk1')})
---
SELECT code, end_date, contract_liab AS current, (contract_liab - pv) / nullif(abs(pv), 0) * 100 AS growth_rate, streak,
  CASE WHEN streak >= 2 THEN 'expanding' WHEN contract_liab > pv THEN 'positive' WHEN contract_liab = 0 AND pv = 0 THEN 'none' ELSE 'cautious' END AS indicator FROM l WHERE i >= 2""")
def contract(spark, sf):
    return U.contract_liabilities(statements(spark, sf))


@q("u13_inventory_signal", "code:i end_date:d inventory_growth:f4 revenue_growth:f4 streak:i turn_trend:s signal:s", ST + "," + _streak("inventories") + f""",
x AS (SELECT *, inventories / nullif(pv, 0) - 1 AS gi, revenue / lag(revenue) OVER w - 1 AS gr, total_cogs / nullif(inventories, 0) AS tn FROM sk1 {W}),
y AS (SELECT *, lag(tn) OVER w AS ptn FROM x {W}), l AS ({latest_sql('y')})
---
SELECT code, end_date, gi * 100 AS inventory_growth, gr * 100 AS revenue_growth, streak, CASE WHEN tn > ptn THEN 'faster' ELSE 'slower' END AS turn_trend,
  CASE WHEN inventories = 0 THEN 'no_inventory' WHEN (gi - gr) * 100 > 15 THEN 'piling_up' WHEN (gi - gr) * 100 < -15 THEN 'short_supply' ELSE 'matched' END AS signal FROM l WHERE i >= 2""")
def inventory(spark, sf):
    return U.inventory_signal(statements(spark, sf))


# ---- valuation -----------------------------------------------------------------------------------
def _case(table, k, default):
    return "CASE industry " + " ".join(f"WHEN '{n}' THEN {float(v[k])!r}e0" for n, v in table.items()) + f" ELSE {default!r}e0 END"


DCF = f"""
ai AS (SELECT code, arg_max(cfo - abs(capex), end_date) AS fcff, min(revenue) FILTER (end_date = mn) AS r0, max(revenue) FILTER (end_date = mx2) AS r1, count(*) AS years,
  arg_max(st_borr + lt_borr + bond_payable - money_cap, end_date) AS net_debt, arg_max(total_share, end_date) AS shares, arg_max(operate_profit, end_date) * 1.1 AS ebitda, any_value(industry) AS industry
  FROM (SELECT *, min(end_date) OVER (PARTITION BY code) AS mn, max(end_date) OVER (PARTITION BY code) AS mx2 FROM ({latest_sql('an', 5)})) GROUP BY 1),
aj AS (SELECT *, greatest(0, least(CASE WHEN years >= 3 THEN pow(r1 / r0, 1e0 / (years - 1)) - 1 ELSE 0.08 END, 0.3)) AS cagr, ({_case(U.INDUSTRY_WACC, 0, 0.09)} + {_case(U.INDUSTRY_WACC, 1, 0.11)}) / 2 AS wacc FROM ai),
ak AS (SELECT *, fcff * pow(1 + greatest(cagr * 0.8, 0.02), 1) AS q1, fcff * pow(1 + greatest(cagr * 0.8, 0.02), 2) AS q2, fcff * pow(1 + greatest(cagr * 0.8, 0.02), 2) * (1 + greatest(cagr * 0.5, 0.02)) AS q3,
  fcff * pow(1 + greatest(cagr * 0.8, 0.02), 2) * pow(1 + greatest(cagr * 0.5, 0.02), 2) AS q4, fcff * pow(1 + greatest(cagr * 0.8, 0.02), 2) * pow(1 + greatest(cagr * 0.5, 0.02), 2) * (1 + greatest(cagr * 0.3, 0.02)) AS q5 FROM aj)"""


def _ps(w, terminal):
    return f"(q1 / (1 + {w}) + q2 / pow(1 + {w}, 2) + q3 / pow(1 + {w}, 3) + q4 / pow(1 + {w}, 4) + q5 / pow(1 + {w}, 5) + {terminal} / pow(1 + {w}, 5) - net_debt) / shares"


@q("u14_dcf", "code:i fcff:f2 cagr:f6 wacc:f6 per_share:f4", AN + "," + DCF + f"\n---\nSELECT *, {_ps('wacc', 'q5 * 1.025 / (wacc - 0.025)')} AS per_share FROM ak")
def dcf(spark, sf):
    return U.dcf(statements(spark, sf, "year"))


@q("u15_dcf_grid", "code:i w:f3 g:f3 per_share:f4", AN + "," + DCF + f"""
---
SELECT code, w, g, {_ps('w', 'q5 * (1 + g) / (w - g)')} AS per_share FROM ak, (SELECT unnest([0.08e0, 0.09e0, 0.1e0, 0.11e0, 0.12e0]) AS w), (SELECT unnest([0.02e0, 0.025e0, 0.03e0]) AS g)""")
def dcf_grid(spark, sf):
    return U.dcf_grid(statements(spark, sf, "year"))


@q("u45_exit_multiple", "code:i per_share:f4", AN + "," + DCF + f"\n---\nSELECT code, {_ps('wacc', 'ebitda * q5 / fcff * 10')} AS per_share FROM ak WHERE fcff <> 0")
def exit_multiple(spark, sf):
    return U.dcf_exit(statements(spark, sf, "year"))


@q("u16_ddm", "code:i latest_dps:f6 dividend_cagr:f6 ke:f6 per_share:f4 applicable:b", AN + f""",
dv AS (SELECT code, end_date, industry, n_income_attr_p * 0.4 / total_share AS dps FROM an),
dl AS (SELECT * FROM dv WHERE dps > 0 {L.format(n=5)}),
dg AS (SELECT code, arg_min(dps, end_date) AS d0, arg_max(dps, end_date) AS latest_dps, count(*) AS n, any_value(industry) AS industry FROM dl GROUP BY 1 HAVING count(*) >= 3),
dk AS (SELECT *, pow(latest_dps / d0, 1e0 / (n - 1)) - 1 AS dividend_cagr, ({_case(U.INDUSTRY_WACC, 0, 0.08)} + {_case(U.INDUSTRY_WACC, 1, 0.10)}) / 2 + 0.01 AS ke FROM dg),
du AS (SELECT *, (1 + dividend_cagr) / (1 + ke) AS u FROM dk)
---
SELECT *, latest_dps * (u + pow(u, 2) + pow(u, 3) + pow(u, 4) + pow(u, 5)) + latest_dps * pow(u, 5) * 1.025 / (ke - 0.025) AS per_share, dividend_cagr > 0 AS applicable FROM du""")
def ddm(spark, sf):
    a = statements(spark, sf, "year").select("code", "end_date", "industry", (c("n_income_attr_p") * 0.4 / c("total_share")).alias("dps"))
    return U.ddm(a)


DAILY = D.PANEL + ", daily AS (SELECT code, date, close, (close - 2000) / 100 AS pe, low / high * 20 AS pb, open / close AS ps FROM panel)"


def daily(spark, sf, **more):
    return D.panel(spark, sf, **more).select("code", "date", "close", ((c("close") - 2000) / 100).alias("pe"), (c("low") / c("high") * 20).alias("pb"), (c("open") / c("close")).alias("ps"), *more)


PEB = """
pb0 AS (SELECT *, arg_max(pe, date) OVER (PARTITION BY code) AS current_pe FROM daily WHERE pe > 0),
peb AS (SELECT code, quantile_cont(pe, 0.1) AS p10, quantile_cont(pe, 0.25) AS p25, quantile_cont(pe, 0.5) AS p50, quantile_cont(pe, 0.75) AS p75, quantile_cont(pe, 0.9) AS p90, any_value(current_pe) AS current_pe,
  avg(CASE WHEN pe < current_pe THEN 1e0 ELSE 0 END) AS rank FROM pb0 GROUP BY 1)"""


def _eps(spark, sf):
    return U.latest(statements(spark, sf)).select("code", (c("n_income_attr_p") / c("total_share") / 100).alias("eps"))


_EPS = f"eps AS (SELECT code, n_income_attr_p / total_share / 100 AS eps FROM ({latest_sql('st')}))"


@q("u17_pe_band", "code:i p10:f6 p25:f6 p50:f6 p75:f6 p90:f6 current_pe:f6 rank:f6 implied_p50:f4 judgement:s", DAILY + "," + PEB + "," + ST + "," + _EPS + """
---
SELECT peb.*, CASE WHEN eps > 0 THEN p50 * eps END AS implied_p50, CASE WHEN rank < 0.25 THEN 'deeply_undervalued' WHEN rank < 0.4 THEN 'undervalued' WHEN rank < 0.6 THEN 'fair' WHEN rank < 0.75 THEN 'rich' ELSE 'deeply_overvalued' END AS judgement
FROM peb LEFT JOIN eps USING (code)""")
def pe_band(spark, sf):
    return U.pe_band(daily(spark, sf), _eps(spark, sf))


@q("u18_pe_band_month_end", "code:i months:i p10:f6 p50:f6 p90:f6", DAILY + """,
m AS (SELECT code, date, pe FROM daily WHERE year(date) >= (SELECT max(year(d2.date)) FROM daily d2 WHERE d2.code = daily.code) - 5),
a AS (SELECT code, list_sort(list(pe)) AS a FROM m GROUP BY 1)
---
SELECT code, len(a) AS months, a[greatest(len(a) * 10 // 100, 1)] AS p10, a[greatest(len(a) * 50 // 100, 1)] AS p50, a[greatest(len(a) * 90 // 100, 1)] AS p90 FROM a""")
def pe_month_end(spark, sf):
    return U.pe_band_month_end(daily(spark, sf))


_PR = f"pr AS (SELECT d.code, d.pb / 5 AS pb, s.n_income_attr_p / s.equity * 2 AS roe FROM (SELECT * FROM daily QUALIFY row_number() OVER (PARTITION BY code ORDER BY date DESC) = 1) d JOIN ({latest_sql('st')}) s USING (code))"


@q("u19_pb_roe", "code:i pb:f6 roe:f6 quadrant:s theoretical_pb:f6 versus_theory:s", DAILY + "," + ST + "," + _PR + """
---
SELECT *, CASE WHEN pb < 2 AND roe > 0.12 THEN 'undervalued' WHEN roe > 0.12 THEN 'fair_premium' WHEN pb < 2 THEN 'value_trap_or_turnaround' ELSE 'overvalued' END AS quadrant,
  CASE WHEN roe > 0.03 THEN (roe - 0.03) / 0.07 ELSE 0 END AS theoretical_pb, CASE WHEN pb < CASE WHEN roe > 0.03 THEN (roe - 0.03) / 0.07 ELSE 0 END THEN 'below' ELSE 'above' END AS versus_theory FROM pr""")
def pb_roe(spark, sf):
    return U.pb_roe(_pb_roe_rows(spark, sf))


def _pb_roe_rows(spark, sf):
    d = U.latest(daily(spark, sf), order="date").select("code", (c("pb") / 5).alias("pb"))
    return d.join(U.latest(statements(spark, sf)).select("code", (c("n_income_attr_p") / c("equity") * 2).alias("roe")), "code")


_EV = f"""ev AS (SELECT code, industry, (total_assets * 3 + st_borr + lt_borr + bond_payable - money_cap) / (operate_profit * 1.1) AS ev_ebitda, {_case(U.INDUSTRY_MULTIPLES, 0, 14)} AS industry_median,
  {_case(U.INDUSTRY_MULTIPLES, 1, 10)} AS lo, {_case(U.INDUSTRY_MULTIPLES, 2, 20)} AS hi FROM ({latest_sql('st')}) WHERE operate_profit > 0)"""


def _ev(spark, sf):
    s = U.latest(statements(spark, sf))
    return U.ev_ebitda(s.select("code", "industry", "operate_profit", (c("total_assets") * 3).alias("market_cap"),
                                (c("st_borr") + c("lt_borr") + c("bond_payable") - c("money_cap")).alias("net_debt")))


@q("u20_ev_ebitda", "code:i ev_ebitda:f6 industry_median:f2 judgement:s", ST + "," + _EV + """
---
SELECT *, CASE WHEN ev_ebitda < lo THEN 'undervalued' WHEN ev_ebitda < industry_median THEN 'fair_low' WHEN ev_ebitda < hi THEN 'fair_high' ELSE 'overvalued' END AS judgement FROM ev""")
def ev_ebitda(spark, sf):
    return _ev(spark, sf)


_T = ["t1_cyclical_pe", "t3_low_roe", "t4_goodwill", "t5_receivables"]


@q("u21_valuation_traps", "code:i end_date:d " + " ".join(f"{x}:b" for x in _T) + " triggered:i risk_level:s", ST + f""",
v AS (SELECT *, accounts_receiv / revenue AS rr, n_income / revenue * 40 AS pe, sum(CASE WHEN roe_pct < 5 THEN 1 ELSE 0 END) OVER (w ROWS 4 PRECEDING) AS lw, count(*) OVER (w ROWS 4 PRECEDING) AS nn FROM st {W}),
x AS (SELECT *, lag(rr) OVER w AS prr FROM v {W}),
y AS (SELECT code, end_date, pe > 0 AND pe < 8 AND industry IN ('钢铁', '煤炭', '有色金属', '石油', '化工', '建材') AS t1_cyclical_pe, nn >= 3 AND lw = nn AS t3_low_roe, goodwill / equity > 0.3 AS t4_goodwill,
  coalesce(rr > prr * 1.2 AND rr > 0.3, false) AS t5_receivables FROM ({latest_sql('x')})),
z AS (SELECT *, {' + '.join(f'{x}::INT' for x in _T)} AS triggered FROM y)
---
SELECT *, CASE WHEN triggered >= 3 THEN 'high' WHEN triggered >= 1 THEN 'medium' ELSE 'low' END AS risk_level FROM z""")
def traps(spark, sf):
    return U.valuation_traps(statements(spark, sf).withColumn("pe", c("n_income") / c("revenue") * 40))


@q("u22_valuation_cross_check", "code:i price:f8 target:f4 median:f4 spread:f6 upside:f6 methods:i consistent:b label:s", D.PANEL.replace("panel AS", "panel AS") + "," + AN + "," + DCF + "," + ST + "," + _EV + f""",
px AS (SELECT code, close AS price FROM panel QUALIFY row_number() OVER (PARTITION BY code ORDER BY date DESC) = 1),
mv AS (SELECT code, price, unnest(['dcf', 'pe_band', 'ev_ebitda']) AS method, unnest([0.35e0, 0.25e0, 0.15e0]) AS w, unnest([{_ps('wacc', 'q5 * 1.025 / (wacc - 0.025)')}, price * 0.9, price * industry_median / ev_ebitda]) AS value
  FROM px LEFT JOIN ak USING (code) LEFT JOIN ev USING (code)),
mg AS (SELECT code, price, sum(w * value) / sum(w) AS target, median(value) AS median, (max(value) - min(value)) / median(value) AS spread, count(*) AS methods FROM mv WHERE value > 0 GROUP BY 1, 2)
---
SELECT *, target / price - 1 AS upside, spread < 0.3 AS consistent, CASE WHEN target / price - 1 > 0.1 THEN 'up' WHEN target / price - 1 < -0.1 THEN 'down' ELSE 'neutral' END AS label FROM mg""")
def cross_check(spark, sf):
    px = U.latest(D.panel(spark, sf), order="date").select("code", c("close").alias("price"))
    d = px.join(U.dcf(statements(spark, sf, "year")).select("code", c("per_share").alias("dcf")), "code", "left").join(
        _ev(spark, sf).select("code", "ev_ebitda", "industry_median"), "code", "left")
    return U.valuation_cross_check(d.select(
        "code", "price", "dcf", F.lit(None).cast("double").alias("ddm"), (c("price") * 0.9).alias("pe_band"), F.lit(None).cast("double").alias("pb_roe"),
        (c("price") * c("industry_median") / c("ev_ebitda")).alias("ev_ebitda")))


@q("u23_history_percentile", "code:i metric:s current:f6 percentile:f6 rating:s", DAILY + """,
lg AS (SELECT * FROM daily UNPIVOT (value FOR metric IN (pe, pb, ps))),
cu AS (SELECT *, arg_max(value, date) OVER (PARTITION BY code, metric) AS current FROM lg WHERE value > 0),
pc AS (SELECT code, metric, current, avg(CASE WHEN value < current THEN 100e0 ELSE 0 END) AS percentile FROM cu GROUP BY 1, 2, 3)
---
SELECT *, CASE WHEN percentile >= 80 THEN 'expensive' WHEN percentile <= 20 THEN 'cheap' ELSE 'fair' END AS rating FROM pc""")
def history_pct(spark, sf):
    return U.history_percentile(daily(spark, sf))


@q("u24_industry_percentile", "code:i date:d industry:s pe:f6 median:f6 mean:f6 min:f6 max:f6 percentile:f6", DAILY + f""",
di AS (SELECT *, {_IND_SQL} AS industry FROM daily WHERE pe > 0)
---
SELECT code, date, industry, pe, median(pe) OVER g AS median, avg(pe) OVER g AS mean, min(pe) OVER g AS min, max(pe) OVER g AS max, (rank() OVER (PARTITION BY date, industry ORDER BY pe) - 1) * 100e0 / count(*) OVER g AS percentile
FROM di WINDOW g AS (PARTITION BY date, industry)""")
def industry_pct(spark, sf):
    ind = F.element_at(F.array(*[F.lit(x) for x in INDUSTRIES]), (c("code") % 6 + 1).cast("int"))
    d = daily(spark, sf, _amount=exact_sum("amount"), _volume=exact_sum("volume")).withColumn("industry", ind)
    return U.industry_percentile(d.withColumn("_exact", (c("_amount") / c("_volume") - 2000) / 100), order="_exact")


# ---- expectations --------------------------------------------------------------------------------
SUE = ST + f""",
e AS (SELECT code, end_date, ann_date, n_income / total_share AS actual, cfo / total_share AS consensus FROM st),
e1 AS (SELECT *, actual - consensus AS er FROM e),
sue AS (SELECT *, er / nullif(CASE WHEN count(er) OVER (w ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING) >= 8 THEN stddev_samp(er) OVER (w ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING) END, 0) AS sue FROM e1 {W})"""


def _sue(spark, sf):
    s = statements(spark, sf, total=exact_sum)      # events are ranked: equal ones must not part by a last digit
    return U.sue(s.select("code", "end_date", "ann_date", (c("n_income") / c("total_share")).alias("actual"), (c("cfo") / c("total_share")).alias("consensus")))


@q("u25_sue", "code:i end_date:d sue:f6 signal:s", SUE + """
---
SELECT *, CASE WHEN sue > 2 THEN 'strong_buy' WHEN sue > 1 THEN 'buy' WHEN sue >= -1 THEN 'none' WHEN sue >= -2 THEN 'sell' WHEN sue IS NOT NULL THEN 'strong_sell' END AS signal FROM sue""")
def sue(spark, sf):
    return _sue(spark, sf)


@q("u26_pead", "code:i end_date:d entry:d sue:f6 quintile:i side:s ret4:f6 ret6:f6", D.PANEL + "," + SUE + """,
pf AS (SELECT code, date, close, lead(close, 4) OVER v / close - 1 AS ret4, lead(close, 6) OVER v / close - 1 AS ret6 FROM panel WINDOW v AS (PARTITION BY code ORDER BY date)),
hit AS (SELECT s.code, s.end_date, s.sue, p.date AS entry, p.ret4, p.ret6 FROM sue s ASOF LEFT JOIN pf p ON s.code = p.code AND s.ann_date < p.date WHERE s.sue IS NOT NULL)
---
SELECT *, least(ceil((rank() OVER (ORDER BY sue) + (count(*) OVER (PARTITION BY sue) - 1) / 2e0) * 5 / count(*) OVER ()), 5) AS quintile, CASE WHEN sue > 1.5 THEN 'long' WHEN sue < -1.5 THEN 'short' ELSE 'none' END AS side FROM hit""")
def pead(spark, sf):
    ev = _sue(spark, sf).select("code", c("ann_date").alias("date"), "end_date", "sue")
    return U.pead(ev, D.panel(spark, sf), hold=4, drift=6)


EST = """es AS (SELECT p_brand AS code, l_suppkey AS analyst, CAST(date_trunc('month', l_shipdate) AS DATE) AS date, avg(l_extendedprice / l_quantity) AS eps FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3)"""


def _est(spark, sf):
    li, part = D.table(spark, sf, "lineitem"), D.table(spark, sf, "part")
    return li.join(part, li.l_partkey == part.p_partkey).groupBy(
        c("p_brand").alias("code"), c("l_suppkey").alias("analyst"), F.trunc("l_shipdate", "month").alias("date")).agg(
        F.avg(c("l_extendedprice") / c("l_quantity")).alias("eps"))


@q("u27_revisions", "code:s date:d consensus:f8 erm:f6 change:f6", EST + """,
rv AS (SELECT *, sign(eps - lag(eps) OVER (PARTITION BY code, analyst ORDER BY date)) AS s FROM es),
dy AS (SELECT code, date, avg(eps) AS consensus, (count(*) FILTER (s > 0) - count(*) FILTER (s < 0)) * 1e0 / count(*) AS erm FROM rv GROUP BY 1, 2)
---
SELECT a.code, a.date, a.consensus, a.erm, (a.consensus - b.consensus) / abs(b.consensus) AS change FROM dy a ASOF LEFT JOIN dy b ON a.code = b.code AND a.date >= b.date + 30""")
def revisions(spark, sf):
    return U.revisions(_est(spark, sf))


@q("u28_dispersion", "code:s analysts:i mean:f4 dispersion:f6 agreement:s", EST + """,
la AS (SELECT code, analyst, arg_max(eps, date) AS eps FROM es GROUP BY 1, 2), ds AS (SELECT code, count(*) AS analysts, avg(eps) AS mean, stddev_samp(eps) / avg(eps) AS dispersion FROM la GROUP BY 1)
---
SELECT *, CASE WHEN dispersion > 0.3 THEN 'split' WHEN dispersion < 0.1 THEN 'firm' ELSE 'mixed' END AS agreement FROM ds""")
def dispersion(spark, sf):
    return U.dispersion(_est(spark, sf))


@q("u29_guidance_labels", "code:i end_date:d versus_consensus:s revision:s", ST + f""",
g AS (SELECT code, end_date, revenue AS midpoint, total_cogs * 1.55 AS consensus, lag(revenue) OVER w AS p FROM st {W})
---
SELECT *, CASE WHEN midpoint > consensus * 1.02 THEN 'above' WHEN midpoint < consensus * 0.98 THEN 'below' ELSE 'inline' END AS versus_consensus,
  CASE WHEN midpoint > p * 1.01 THEN 'raised' WHEN midpoint < p * 0.99 THEN 'lowered' WHEN p IS NOT NULL THEN 'maintained' END AS revision FROM g""")
def guidance(spark, sf):
    return U.guidance_labels(statements(spark, sf).select("code", "end_date", c("revenue").alias("midpoint"), (c("total_cogs") * 1.55).alias("consensus")))


@q("u30_consensus_rollup", "code:s quarter:d n:i brokers:i eps_avg:f8 eps_max:f8 eps_min:f8 high_target:f2 low_target:f2 buys:i", """
rc AS (SELECT p_brand AS code, CAST(date_trunc('quarter', l_shipdate) AS DATE) AS quarter, l_suppkey AS org, l_extendedprice / l_quantity AS eps, l_extendedprice AS price, l_returnflag FROM lineitem JOIN part ON l_partkey = p_partkey)
---
SELECT code, quarter, count(*) AS n, count(DISTINCT org) AS brokers, avg(eps) AS eps_avg, max(eps) AS eps_max, min(eps) AS eps_min, max(price) AS high_target, min(price) AS low_target, count_if(l_returnflag = 'N') AS buys FROM rc GROUP BY 1, 2""")
def consensus(spark, sf):
    li, part = D.table(spark, sf, "lineitem"), D.table(spark, sf, "part")
    rc = li.join(part, li.l_partkey == part.p_partkey).select(
        c("p_brand").alias("code"), F.trunc("l_shipdate", "quarter").alias("quarter"), c("l_suppkey").alias("org"), (c("l_extendedprice") / c("l_quantity")).alias("eps"),
        c("l_extendedprice").alias("max_price"), c("l_extendedprice").alias("min_price"), F.when(c("l_returnflag") == "N", "buy").otherwise("hold").alias("rating"))
    return U.consensus_rollup(rc)


@q("u31_institution_visits", "code:i days:i records:i orgs:i frequent_orgs:i top_type:s top_count:i", """
v AS (SELECT l_suppkey AS code, CAST(l_shipdate AS DATE) AS date, l_partkey AS org, p_type AS org_type FROM lineitem JOIN part ON l_partkey = p_partkey),
o AS (SELECT code, count_if(k >= 2) AS frequent_orgs, count(*) AS orgs FROM (SELECT code, org, count(*) AS k FROM v GROUP BY 1, 2) GROUP BY 1),
t AS (SELECT code, org_type AS top_type, k AS top_count FROM (SELECT code, org_type, count(*) AS k FROM v GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY code ORDER BY k DESC, org_type) = 1)
---
SELECT code, days, records, orgs, frequent_orgs, top_type, top_count FROM (SELECT code, count(DISTINCT date) AS days, count(*) AS records FROM v GROUP BY 1) JOIN o USING (code) JOIN t USING (code)""")
def visits(spark, sf):
    li, part = D.table(spark, sf, "lineitem"), D.table(spark, sf, "part")
    return U.institution_visits(li.join(part, li.l_partkey == part.p_partkey).select(
        c("l_suppkey").alias("code"), F.to_date("l_shipdate").alias("date"), c("l_partkey").alias("org"), c("p_type").alias("org_type")))


# ---- ownership -----------------------------------------------------------------------------------
CHIPS = SUPPLIER = """ch0 AS (SELECT l_suppkey AS code, floor(l_extendedprice / l_quantity / 100) * 100 AS price, sum(l_quantity) AS q FROM lineitem GROUP BY 1, 2),
ch AS (SELECT code, price, q * 100 / sum(q) OVER (PARTITION BY code) AS percent FROM ch0 WHERE price > 0),
cp AS (SELECT l_suppkey AS code, sum(l_extendedprice) / sum(l_quantity) AS current FROM lineitem GROUP BY 1)"""


def _chips(spark, sf):
    g = D.table(spark, sf, "lineitem").groupBy(c("l_suppkey").alias("code"), (F.floor(c("l_extendedprice") / c("l_quantity") / 100) * 100).cast("double").alias("price")).agg(
        F.sum("l_quantity").alias("q")).where("price > 0")
    return g.select("code", "price", (c("q") * 100 / F.sum("q").over(Window.partitionBy("code"))).alias("percent"))


@q("u32_chip_distribution", "code:i profit_share:f4 loss_share:f4 cost5:f2 cost15:f2 cost85:f2 cost95:f2 avg_cost:f4 peak_price:f2 density_pct:f4 deviation_pct:f4 level1:f4 level5:f4", CHIPS + """,
cc AS (SELECT ch.*, current, sum(percent) OVER (PARTITION BY code ORDER BY price ROWS UNBOUNDED PRECEDING) AS cum, min(price) OVER (PARTITION BY code) AS lo, max(price) OVER (PARTITION BY code) AS hi FROM ch JOIN cp USING (code)),
cg AS (SELECT code, any_value(current) AS current, sum(CASE WHEN price <= current THEN percent ELSE 0 END) AS profit_share, sum(CASE WHEN price > current THEN percent ELSE 0 END) AS loss_share,
  coalesce(min(price) FILTER (cum >= 5), max(price)) AS cost5, coalesce(min(price) FILTER (cum >= 15), max(price)) AS cost15, coalesce(min(price) FILTER (cum >= 85), max(price)) AS cost85, coalesce(min(price) FILTER (cum >= 95), max(price)) AS cost95,
  sum(price * percent) / sum(percent) AS avg_cost, arg_max(price, percent * 1e12 - price) AS peak_price, sum(CASE WHEN price < lo + (hi - lo) / 5 THEN percent ELSE 0 END) AS level1, sum(CASE WHEN price >= lo + (hi - lo) / 5 * 4 AND price < lo + (hi - lo) / 5 * 5 THEN percent ELSE 0 END) AS level5 FROM cc GROUP BY 1)
---
SELECT *, (cost95 - cost5) / current * 100 AS density_pct, (current / avg_cost - 1) * 100 AS deviation_pct FROM cg""")
def chips(spark, sf):
    price = D.table(spark, sf, "lineitem").groupBy(c("l_suppkey").alias("code")).agg((F.sum("l_extendedprice") / F.sum("l_quantity")).alias("current"))
    return U.chip_distribution(_chips(spark, sf), price)


@q("u33_chip_drift", "code:i first_cost:f4 last_cost:f4 samples:i drift_pct:f4", """
d AS (SELECT l_suppkey AS code, CAST(date_trunc('year', l_shipdate) AS DATE) AS date, sum(l_extendedprice) / sum(l_quantity) AS cost FROM lineitem GROUP BY 1, 2)
---
SELECT code, arg_min(cost, date) AS first_cost, arg_max(cost, date) AS last_cost, count(*) AS samples, (arg_max(cost, date) / arg_min(cost, date) - 1) * 100 AS drift_pct FROM d GROUP BY 1 HAVING count(*) >= 2""")
def drift(spark, sf):
    d = D.table(spark, sf, "lineitem").select(c("l_suppkey").alias("code"), F.trunc("l_shipdate", "year").alias("date"), (c("l_extendedprice") / c("l_quantity")).alias("price"), c("l_quantity").alias("percent"))
    return U.chip_drift(d)


MARGIN = D.PANEL + ", mg AS (SELECT code, date, amount AS rzye, volume * 50 AS rqye, amount * 0.5 AS rzmre, high * volume * 0.1 AS rzche, volume AS rqmcl, trades * 25 AS rqchl FROM panel)"


def _margin(spark, sf):
    return D.panel(spark, sf).select("code", "date", c("amount").alias("rzye"), (c("volume") * 50).alias("rqye"), (c("amount") * 0.5).alias("rzmre"), (c("high") * c("volume") * 0.1).alias("rzche"), c("volume").alias("rqmcl"), (c("trades") * 25.0).alias("rqchl"))


@q("u34_margin_analysis", "code:i net_financing:f2 net_lending:f2 turnover:f6 rz_change:f4 rq_change:f4 rz_vol:f6 rq_vol:f6 rz_trend:s rq_trend:s risk:i score:i view:s", MARGIN + """,
mw AS (SELECT *, row_number() OVER w AS i, row_number() OVER (PARTITION BY code ORDER BY date DESC) AS a, rzye / lag(rzye) OVER w - 1 AS rz, rqye / lag(rqye) OVER w - 1 AS rq FROM mg WINDOW w AS (PARTITION BY code ORDER BY date)),
ms AS (SELECT code, sum(rzmre - rzche) AS net_financing, sum(rqmcl - rqchl) AS net_lending, avg(rzmre) / avg(rzye) AS turnover, (avg(rzye) FILTER (a <= 5) / avg(rzye) FILTER (a > 5) - 1) * 100 AS rz_change, (avg(rqye) FILTER (a <= 5) / avg(rqye) FILTER (a > 5) - 1) * 100 AS rq_change,
  stddev_pop(rz) AS rz_vol, stddev_pop(rq) AS rq_vol, regr_slope(rzye, i) / avg(rzye) AS ts, regr_slope(rqye, i) / avg(rqye) AS tq FROM mw GROUP BY 1),
mt AS (SELECT *, CASE WHEN ts > 0.01 THEN 'increasing' WHEN ts < -0.01 THEN 'decreasing' ELSE 'stable' END AS rz_trend, CASE WHEN tq > 0.01 THEN 'increasing' WHEN tq < -0.01 THEN 'decreasing' ELSE 'stable' END AS rq_trend,
  CASE WHEN rz_vol > 0.1 THEN 30 ELSE 0 END + CASE WHEN rq_vol > 0.15 THEN 20 ELSE 0 END + CASE WHEN net_financing < -1e8 THEN 25 ELSE 0 END + CASE WHEN net_lending > 1e6 THEN 25 ELSE 0 END AS risk FROM ms),
mu AS (SELECT *, greatest(0, least(100, 50 + CASE rz_trend WHEN 'increasing' THEN 15 WHEN 'decreasing' THEN -10 ELSE 0 END + CASE rq_trend WHEN 'decreasing' THEN 10 WHEN 'increasing' THEN -15 ELSE 0 END
  + CASE WHEN net_financing > 0 THEN 15 ELSE -10 END + CASE WHEN net_lending < 0 THEN 10 ELSE -10 END + CASE WHEN risk >= 50 THEN -20 WHEN risk >= 25 THEN 0 ELSE 10 END)) AS score FROM mt)
---
SELECT *, CASE WHEN score >= 70 THEN 'bullish' WHEN score <= 30 THEN 'bearish' ELSE 'neutral' END AS view FROM mu""")
def margin(spark, sf):
    return U.margin_analysis(_margin(spark, sf))


HOLD = f"""hn AS (SELECT l_suppkey AS code, CAST(date_trunc('quarter', l_shipdate) AS DATE) AS end_date, count(DISTINCT l_partkey) AS holder_num FROM lineitem GROUP BY 1, 2),
hd AS (SELECT *, holder_num * 1e0 / lag(holder_num) OVER w - 1 AS change FROM hn {W}),
ht AS (SELECT *, CASE WHEN change < -0.05 THEN 'bullish' WHEN change < -0.02 THEN 'slightly_bullish' WHEN change > 0.05 THEN 'bearish' WHEN change > 0.02 THEN 'slightly_bearish' ELSE 'neutral' END AS signal FROM ({latest_sql('hd')}) WHERE change IS NOT NULL)"""


@q("u35_holder_trend", "code:i end_date:d holder_num:i change:f6 signal:s", HOLD + "\n---\nSELECT * FROM ht")
def holder_trend(spark, sf):
    h = D.table(spark, sf, "lineitem").groupBy(c("l_suppkey").alias("code"), F.trunc("l_shipdate", "quarter").alias("end_date")).agg(F.countDistinct("l_partkey").alias("holder_num"))
    return U.holder_trend(h)


TOP = """th0 AS (SELECT l_suppkey AS code, p_name AS holder, sum(l_quantity) AS q FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
th1 AS (SELECT *, q * 100 / sum(q) OVER (PARTITION BY code) AS hold_ratio FROM th0),
th2 AS (SELECT * FROM th1 QUALIFY row_number() OVER (PARTITION BY code ORDER BY round(hold_ratio, 9) DESC, holder) <= 10),
th AS (SELECT code, sum(hold_ratio) AS total_ratio, count_if(holder LIKE '%widget%' OR holder LIKE '%ring%') AS institutions, count(*) AS holders FROM th2 GROUP BY 1)"""


@q("u36_top_holders", "code:i total_ratio:f4 institutions:i holders:i concentration:s", TOP + "\n---\nSELECT *, CASE WHEN total_ratio > 60 THEN 'high' WHEN total_ratio > 40 THEN 'medium' ELSE 'low' END AS concentration FROM th")
def top_holders(spark, sf):
    li, part = D.table(spark, sf, "lineitem"), D.table(spark, sf, "part")
    g = li.join(part, li.l_partkey == part.p_partkey).groupBy(c("l_suppkey").alias("code"), c("p_name").alias("holder")).agg(F.sum("l_quantity").alias("q"))
    h = g.select("code", "holder", F.round(c("q") * 100 / F.sum("q").over(Window.partitionBy("code")), 9).alias("hold_ratio"))
    return U.top_holders(h, ["widget", "ring"])


TRADES = """ht0 AS (SELECT l_suppkey AS code, CASE WHEN l_returnflag = 'N' THEN l_quantity WHEN l_returnflag = 'R' THEN -l_quantity ELSE 0 END AS v FROM lineitem),
htr AS (SELECT code, count_if(v > 0) AS buys, count_if(v < 0) AS sells, sum(CASE WHEN v > 0 THEN v ELSE 0 END) AS bought, sum(CASE WHEN v < 0 THEN -v ELSE 0 END) AS sold FROM ht0 GROUP BY 1),
htd AS (SELECT *, CASE WHEN bought > sold THEN 'net_buy' WHEN bought < sold THEN 'net_sell' ELSE 'balanced' END AS direction FROM htr)"""


@q("u37_holder_trades", "code:i buys:i sells:i bought:f2 sold:f2 direction:s", TRADES + "\n---\nSELECT * FROM htd")
def holder_trades(spark, sf):
    v = ladder((c("l_returnflag") == "N", c("l_quantity")), (c("l_returnflag") == "R", -c("l_quantity")), default=0.0)
    return U.holder_trades(D.table(spark, sf, "lineitem").select(c("l_suppkey").alias("code"), v.alias("change_vol")))


PLEDGE = """pl AS (SELECT l_suppkey AS code, max(CASE WHEN l_returnflag <> 'A' THEN round(l_discount * 500 + l_tax * 100, 2) END) AS ratio FROM lineitem GROUP BY 1),
pk AS (SELECT *, CASE WHEN ratio > 50 THEN 'high' WHEN ratio > 30 THEN 'medium' ELSE 'low' END AS risk FROM pl)"""


def _pledge(spark, sf):
    txt = F.when(c("l_returnflag") == "A", F.lit("n/a")).otherwise(F.concat(F.round(c("l_discount") * 500 + c("l_tax") * 100, 2).cast("string"), F.lit("%")))
    return U.pledge_risk(D.table(spark, sf, "lineitem").select(c("l_suppkey").alias("code"), txt.alias("pledge")))


@q("u38_pledge_risk", "code:i ratio:f2 risk:s", PLEDGE + "\n---\nSELECT * FROM pk")
def pledge(spark, sf):
    return _pledge(spark, sf)


KINDS = ["click", "view", "purchase", "signup", "error"]


@q("u39_event_counts", "code:i " + " ".join(f"{k}:i" for k in KINDS) + " total_events:i", "SELECT user_id AS code, " + ", ".join(
    f"count_if(event_type = '{k}') AS {k}" for k in KINDS) + ", count(*) AS total_events FROM events GROUP BY 1")
def event_counts(spark, sf):
    return U.event_counts(D.table(spark, sf, "events").select(c("user_id").alias("code"), c("event_type").alias("kind")), KINDS)


@q("u40_shareholder_score", "code:i score:i rating:s", HOLD + "," + TOP + "," + TRADES + "," + PLEDGE + """,
ss AS (SELECT code, greatest(0, least(100, 50 + CASE signal WHEN 'bullish' THEN 15 WHEN 'slightly_bullish' THEN 8 WHEN 'bearish' THEN -15 WHEN 'slightly_bearish' THEN -8 ELSE 0 END
  + CASE WHEN total_ratio > 60 THEN 10 WHEN total_ratio > 40 THEN 5 WHEN total_ratio < 20 THEN -5 ELSE 0 END + CASE direction WHEN 'net_buy' THEN 15 WHEN 'net_sell' THEN -15 ELSE 0 END
  + CASE risk WHEN 'high' THEN -10 WHEN 'medium' THEN -5 ELSE 5 END - least(sells % 3 * 3, 10))) AS score FROM ht JOIN th USING (code) JOIN htd USING (code) JOIN pk USING (code))
---
SELECT *, CASE WHEN score >= 80 THEN 'excellent' WHEN score >= 65 THEN 'good' WHEN score >= 50 THEN 'neutral' WHEN score >= 35 THEN 'weak' ELSE 'poor' END AS rating FROM ss""")
def shareholder_score(spark, sf):
    tr = holder_trades(spark, sf)
    d = (holder_trend(spark, sf).select("code", "signal").join(top_holders(spark, sf).select("code", "total_ratio"), "code")
         .join(tr.select("code", "direction", (c("sells") % 3).alias("letters")), "code").join(_pledge(spark, sf).select("code", "risk"), "code"))
    return U.shareholder_score(d)


# ---- documented statement rules ------------------------------------------------------------------
@q("u41_documented_flags", "code:i end_date:d f5_related_party:b f6_auditor:b f9_minority:b f10_opinion:b f11_rd:b", ST + f""",
a AS (SELECT *, auditor <> lag(auditor) OVER w AS ch, minority_income / nullif(n_income, 0) AS sh FROM st {W}),
b AS (SELECT *, sum(ch::INT) OVER (w ROWS 11 PRECEDING) AS chs, sh - lag(sh) OVER w AS sw FROM a {W})
---
SELECT code, end_date, related_sales / revenue > 0.3 AS f5_related_party, chs >= 2 AS f6_auditor, abs(sw) > 0.3 AS f9_minority, audit_opinion <> 'standard' AS f10_opinion, rd_capitalised / rd_total > 0.5 AS f11_rd FROM ({latest_sql('b')})""")
def documented(spark, sf):
    return U.documented_flags(statements(spark, sf))


@q("u42_cash_reconciliation", "code:i end_date:d cash_gap:f2 reconciled:b receivables_outgrow:b", ST + f"""
---
SELECT code, end_date, (money_cap - lag(money_cap) OVER w) - (cfo + cfi + cff) AS cash_gap, abs((money_cap - lag(money_cap) OVER w) - (cfo + cfi + cff)) <= 1 AS reconciled,
  accounts_receiv / nullif(lag(accounts_receiv) OVER w, 0) - 1 > revenue / lag(revenue) OVER w - 1 AS receivables_outgrow FROM st {W}""")
def reconcile(spark, sf):
    return U.cash_reconciliation(statements(spark, sf))


@q("u43_liquidity_ratios", "code:i end_date:d gross_margin:f6 net_margin:f6 expense_ratio:f6 current_ratio:f6 quick_ratio:f6 interest_debt_ratio:f6 debt_ratio:f6", ST + """
---
SELECT code, end_date, 1 - total_cogs / revenue AS gross_margin, n_income / revenue AS net_margin, expenses / revenue AS expense_ratio, current_assets / nullif(current_liab, 0) AS current_ratio,
  (current_assets - inventories) / nullif(current_liab, 0) AS quick_ratio, (st_borr + lt_borr + bond_payable) / total_assets AS interest_debt_ratio, total_liab / total_assets AS debt_ratio FROM st""")
def ratios(spark, sf):
    return U.liquidity_ratios(statements(spark, sf))


@q("u44_wacc_capm", "code:i date:d beta:f6 ke:f6 wacc:f6", """""" + __import__("barloom.plans.factors", fromlist=["_BENCH"])._BENCH + """,
lb AS (SELECT code, date, beta, volume * 100 AS e, trades * 5000 AS d FROM beta QUALIFY row_number() OVER (PARTITION BY code ORDER BY date DESC) = 1)
---
SELECT code, date, beta, 0.025 + beta * 0.06 AS ke, e / (e + d) * (0.025 + beta * 0.06) + d / (e + d) * 0.045 * 0.75 AS wacc FROM lb""")
def capm(spark, sf):
    from barloom.operators.factors import rolling_beta

    b = U.latest(rolling_beta(D.panel(spark, sf), D.benchmark(spark, sf), 48, 20), order="date")
    return U.wacc_capm(b.select("code", "date", "beta", (c("volume") * 100).alias("equity_value"), (c("trades") * 5000.0).alias("debt")))
