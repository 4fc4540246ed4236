"""Bond, fund and industry queries. Every part is a bond on the stock of its first supplier."""

from pyspark.sql import functions as F

from barloom.functions.sums import exact_mean
from barloom.operators import bonds_funds as E
from barloom.plans import bindings as D
from barloom.plans.registry import query
from barloom.session import cut

c = F.col
ASOF = "DATE '2000-01-01'"
ASOF_COL = lambda: F.lit("2000-01-01").cast("date")
CREDIT = ["AAA", "AA+", "AA", "AA-", "A+", "B"]

# text of the coupon clause: four yearly segments from the part's size
_CLAUSE = "'19980101-19981231,票面利率:' || p_size % 5 || '.4%;19990101-19991231,票面利率:' || p_size % 5 || '.8%;20000101-20001231,票面利率:1.' || p_size % 5 || '%;20010101-20011231,票面利率:2.' || p_size % 7 || '%'"
BONDS = D.PANEL + f""",
ps AS (SELECT l_partkey AS pk, min(l_suppkey) AS stk_code, sum(l_extendedprice) AS amount, sum(l_quantity) AS qty, avg(l_discount) AS disc, avg(l_tax) AS tax, CAST(min(l_shipdate) AS DATE) AS list_date, CAST(max(l_shipdate) AS DATE) AS last_date, count(*) AS n FROM lineitem GROUP BY 1),
lst AS (SELECT code AS stk_code, arg_max(close, date) / 300 AS stock_price, (arg_max(close, date) / arg_max(open, date) - 1) * 5 AS stock_chg FROM panel GROUP BY 1),
bd AS (SELECT p_partkey AS code, p_brand AS brand, stk_code, 85e0 + p_retailprice % 70 AS price, 5e0 + p_size * 0.4e0 AS conv_price, stock_price, stock_chg, p_retailprice / 100 AS remain_size, {_CLAUSE} AS rate_clause,
  DATE '2002-01-01' + p_size * 20 AS maturity_date, amount * 500 AS amount, amount / 2e5 AS amount_yi, qty / 10 AS turnover, (disc - 0.05) * 400 AS chg, tax * 100 AS amplitude, list_date, CASE WHEN n % 4 = 0 THEN last_date END AS delist_date,
  (['AAA','AA+','AA','AA-','A+','B'])[1 + p_partkey % 6] AS credit, p_size % 2 = 0 AS has_downrev, 100e0 + p_size % 15 AS redeem_price, 80e0 + p_retailprice % 45 AS pure_bond, p_size / 10e0 AS years_left, p_size * 0.6e0 AS equity_ratio,
  p_retailprice / 40 - 5 AS pe, p_size / 12e0 AS pb, p_retailprice % 13 - 4 AS ytm_pct FROM part JOIN ps ON pk = p_partkey JOIN lst USING (stk_code)),
bv AS (SELECT *, 100 / conv_price * stock_price AS conv_value, (price / (100 / conv_price * stock_price) - 1) * 100 AS premium, price + (price / (100 / conv_price * stock_price) - 1) * 100 AS double_low FROM bd WHERE stock_price > 0)"""


def bonds(spark, sf):
    li, part = D.table(spark, sf, "lineitem"), D.table(spark, sf, "part")
    ps = li.groupBy(c("l_partkey").alias("p_partkey")).agg(
        F.min("l_suppkey").alias("stk_code"), F.sum("l_extendedprice").alias("am"), F.sum("l_quantity").alias("qty"), exact_mean("l_discount").alias("disc"), F.avg("l_tax").alias("tax"),
        F.to_date(F.min("l_shipdate")).alias("list_date"), F.to_date(F.max("l_shipdate")).alias("last_date"), F.count(F.lit(1)).alias("n"))
    last = D.panel(spark, sf).groupBy(c("code").alias("stk_code")).agg(
        (F.max_by("close", "date") / 300).alias("stock_price"), ((F.max_by("close", "date") / F.max_by("open", "date") - 1) * 5).alias("stock_chg"))
    s5, s7 = (c("p_size") % 5).cast("string"), (c("p_size") % 7).cast("string")
    clause = F.concat(F.lit("19980101-19981231,票面利率:"), s5, F.lit(".4%;19990101-19991231,票面利率:"), s5, F.lit(".8%;20000101-20001231,票面利率:1."), s5,
                      F.lit("%;20010101-20011231,票面利率:2."), s7, F.lit("%"))
    d = part.join(ps, "p_partkey").join(last, "stk_code")
    return d.select(
        c("p_partkey").alias("code"), c("p_brand").alias("brand"), "stk_code", (c("p_retailprice") % 70 + 85.0).alias("price"), (c("p_size") * 0.4 + 5.0).alias("conv_price"),
        "stock_price", "stock_chg", (c("p_retailprice") / 100).alias("remain_size"), clause.alias("rate_clause"), F.date_add(F.lit("2002-01-01").cast("date"), c("p_size") * 20).alias("maturity_date"),
        (c("am") * 500).alias("amount"), (c("am") / 2e5).alias("amount_yi"), (c("qty") / 10).alias("turnover"), ((c("disc") - 0.05) * 400).alias("chg"), (c("tax") * 100).alias("amplitude"),
        "list_date", F.when(c("n") % 4 == 0, c("last_date")).alias("delist_date"), F.element_at(F.array(*[F.lit(x) for x in CREDIT]), (c("p_partkey") % 6 + 1).cast("int")).alias("credit"),
        (c("p_size") % 2 == 0).alias("has_downrev"), (c("p_size") % 15 + 100.0).alias("redeem_price"), (c("p_retailprice") % 45 + 80.0).alias("pure_bond"), (c("p_size") / 10.0).alias("years_left"),
        (c("p_size") * 0.6).alias("equity_ratio"), (c("p_retailprice") / 40 - 5).alias("pe"), (c("p_size") / 12.0).alias("pb"), (c("p_retailprice") % 13 - 4).alias("ytm_pct"))


def valued(spark, sf):
    return E.conversion_values(bonds(spark, sf))


@query("e01_conversion_values", "code:i conv_value:f6 premium:f6 double_low:f6", BONDS + "\n---\nSELECT * FROM bv")
def conversion(spark, sf):
    return valued(spark, sf)


_STATS = """avg(price) AS avg_price, avg(premium) AS avg_premium, avg(double_low) AS avg_double_low, median(price) AS median_price, count_if(price < 100) AS lt100, count_if(price >= 100 AND price < 120) AS b100_120,
  count_if(price >= 120 AND price < 150) AS b120_150, count_if(price >= 150) AS ge150"""


@query("e02_market_statistics", "brand:s avg_price:f4 avg_premium:f4 avg_double_low:f4 median_price:f4 lt100:i b100_120:i b120_150:i ge150:i", BONDS + f"\n---\nSELECT brand, {_STATS} FROM bv GROUP BY 1")
def statistics(spark, sf):
    return E.market_statistics(cut(valued(spark, sf).select("brand", "price", "premium", "double_low")), ("brand",))


@query("e02_double_low_top10", "code:i double_low:f6", BONDS + "\n---\nSELECT code, double_low FROM bv ORDER BY double_low, code LIMIT 10")
def double_low(spark, sf):
    return E.smallest(valued(spark, sf).select("code", "double_low"), "double_low")


@query("e03_market_size", "alive:i remaining:f4 listed:i delisted:i", BONDS + f"""
---
SELECT count_if(a) AS alive, sum(CASE WHEN a THEN remain_size ELSE 0 END) AS remaining, count_if(list_date BETWEEN DATE '1995-03-01' AND {ASOF}) AS listed, count_if(delist_date BETWEEN DATE '1995-03-01' AND {ASOF}) AS delisted
FROM (SELECT *, list_date <= {ASOF} AND (delist_date IS NULL OR delist_date > {ASOF}) AS a FROM bd)""")
def size(spark, sf):
    return E.market_size(bonds(spark, sf), F.lit("1995-03-01").cast("date"), ASOF_COL())


WK = """wk0 AS (SELECT CAST(date_trunc('week', l_shipdate) AS DATE) AS week, sum(l_extendedprice) AS am, avg(l_discount) AS dc, avg(l_extendedprice / l_quantity) AS px FROM lineitem GROUP BY 1),
wk1 AS (SELECT week, (px / lag(px) OVER w - 1) * 10 AS week_pct, (dc - lag(dc) OVER w) * 1000 AS premium_chg, 100 + dc * 1000 AS double_low, am / 5e4 AS amount_yi FROM wk0 WINDOW w AS (ORDER BY week)),
wk AS (SELECT *, greatest(0, least(100, 50 + CASE WHEN week_pct >= 1 THEN 15 WHEN week_pct <= -1 THEN -15 ELSE 0 END + CASE WHEN premium_chg > 2 THEN -10 WHEN premium_chg < -2 THEN 10 ELSE 0 END
  + CASE WHEN double_low < 130 THEN 8 WHEN double_low > 160 THEN -8 ELSE 0 END + CASE WHEN amount_yi >= 150 THEN 8 WHEN amount_yi < 80 THEN -8 ELSE 0 END)) AS score FROM wk1)"""


@query("e04_weekly_score", "week:d score:i direction:s", WK + "\n---\nSELECT *, CASE WHEN score >= 58 THEN 'bullish' WHEN score <= 42 THEN 'bearish' ELSE 'mixed' END AS direction FROM wk")
def weekly(spark, sf):
    from pyspark.sql import Window

    g = D.table(spark, sf, "lineitem").groupBy(F.date_trunc("week", "l_shipdate").cast("date").alias("week")).agg(
        F.sum("l_extendedprice").alias("am"), F.avg("l_discount").alias("dc"), F.avg(c("l_extendedprice") / c("l_quantity")).alias("px"))
    w = Window.orderBy("week")      # one row per week
    return E.weekly_score(g.select("week", ((c("px") / F.lag("px").over(w) - 1) * 10).alias("week_pct"), ((c("dc") - F.lag("dc").over(w)) * 1000).alias("premium_chg"),
                                   (c("dc") * 1000 + 100).alias("double_low"), (c("am") / 5e4).alias("amount_yi")))


@query("e05_coupon_schedule", "code:i seg_start:d seg_end:d rate:f2", BONDS + r""",
cs AS (SELECT code, unnest(regexp_extract_all(rate_clause, '(\d{8})-(\d{8}),票面利率:([\d.]+)%', 1)) AS s, unnest(regexp_extract_all(rate_clause, '(\d{8})-(\d{8}),票面利率:([\d.]+)%', 2)) AS e, unnest(regexp_extract_all(rate_clause, '(\d{8})-(\d{8}),票面利率:([\d.]+)%', 3)) AS r FROM bd)
---
SELECT code, CAST(strptime(s, '%Y%m%d') AS DATE) AS seg_start, CAST(strptime(e, '%Y%m%d') AS DATE) AS seg_end, CAST(r AS DOUBLE) AS rate FROM cs""")
def coupons(spark, sf):
    return E.coupon_schedule(bonds(spark, sf))


def _npv(y):
    t1, t2 = "date_diff('day', DATE '2000-01-01', DATE '2000-12-31') / 365.25e0", "date_diff('day', DATE '2000-01-01', DATE '2001-12-31') / 365.25e0"
    return f"(c1 / pow(1 + {y}, {t1}) + c2 / pow(1 + {y}, {t2}) + 100 / pow(1 + {y}, tm) - price)"


@query("e06_yield_to_maturity", "code:i ytm:f8", BONDS + r""",
yt AS (SELECT code, price, date_diff('day', DATE '2000-01-01', maturity_date) / 365.25e0 AS tm, CAST(regexp_extract_all(rate_clause, '率:([\d.]+)%', 1)[3] AS DOUBLE) AS c1, CAST(regexp_extract_all(rate_clause, '率:([\d.]+)%', 1)[4] AS DOUBLE) AS c2 FROM bd),
yb AS (SELECT *, list_reduce(list_prepend({'lo': -0.5e0, 'hi': 1e0}, list_transform(range(100), lambda i: {'lo': 0e0, 'hi': 0e0})), lambda a, x: CASE WHEN """ + _npv("((a.lo + a.hi) / 2)") + """ > 0 THEN {'lo': (a.lo + a.hi) / 2, 'hi': a.hi} ELSE {'lo': a.lo, 'hi': (a.lo + a.hi) / 2} END) AS b FROM yt)
---
SELECT code, (b.lo + b.hi) / 2 AS ytm FROM yb""")
def ytm(spark, sf):
    return E.yield_to_maturity(bonds(spark, sf), ASOF_COL())


SIX = """
sx AS (SELECT *, (CASE WHEN premium < 0 THEN 100 WHEN premium < 10 THEN 90 + (10 - premium) WHEN premium < 20 THEN 70 + (20 - premium) * 2 WHEN premium < 40 THEN 40 + (40 - premium) ELSE greatest(0, 40 - (premium - 40)) END) * 0.7
   + (CASE WHEN ytm_pct > 5 THEN 100 WHEN ytm_pct > 0 THEN 70 + ytm_pct * 6 WHEN ytm_pct > -10 THEN 60 + ytm_pct * 3 ELSE greatest(0, 30 + ytm_pct) END) * 0.3 AS basic,
  (CASE WHEN pe BETWEEN 10 AND 30 THEN 85 WHEN pe > 0 AND pe < 10 THEN 75 WHEN pe > 30 AND pe <= 50 THEN 60 WHEN pe > 50 THEN greatest(20, 60 - (pe - 50)) ELSE 50 END) * 0.35 + (CASE WHEN pb BETWEEN 0.5 AND 3 THEN 80 WHEN pb > 0 AND pb < 0.5 THEN 60 WHEN pb > 3 THEN greatest(30, 60 - (pb - 3) * 5) ELSE 50 END) * 0.25
   + (CASE WHEN stock_chg > 5 THEN 90 WHEN stock_chg > 0 THEN 70 + stock_chg * 4 WHEN stock_chg > -5 THEN 50 + stock_chg * 4 ELSE greatest(20, 50 + stock_chg * 3) END) * 0.4 AS stock,
  (CASE credit WHEN 'AAA' THEN 100 WHEN 'AA+' THEN 90 WHEN 'AA' THEN 80 WHEN 'AA-' THEN 70 WHEN 'A+' THEN 55 WHEN 'A' THEN 45 ELSE 50 END) * 0.5 + (CASE WHEN has_downrev THEN 90 ELSE 50 END) * 0.3 + (CASE WHEN redeem_price >= 110 THEN 80 WHEN redeem_price >= 105 THEN 65 ELSE 50 END) * 0.2 AS protection,
  CASE WHEN years_left BETWEEN 1 AND 3 THEN 90 WHEN years_left >= 0.5 AND years_left < 1 THEN 70 WHEN years_left > 3 AND years_left <= 5 THEN 70 - (years_left - 3) * 10 WHEN years_left > 5 THEN greatest(30, 50 - (years_left - 5) * 5) WHEN years_left > 0 THEN 50 + years_left * 40 ELSE 50 END AS time,
  (CASE WHEN amount > 5e8 THEN 75 WHEN amount > 1e8 THEN 85 WHEN amount > 5e7 THEN 70 WHEN amount > 0 THEN 60 ELSE 50 END) * 0.5 + (CASE WHEN turnover BETWEEN 5 AND 30 THEN 80 WHEN turnover > 30 THEN greatest(40, 80 - (turnover - 30) * 2) WHEN turnover > 0 THEN 50 + turnover * 2 ELSE 50 END) * 0.5 AS trading,
  (CASE WHEN premium < 0 THEN 100 WHEN premium < 5 THEN 90 WHEN premium < 15 THEN 70 + (15 - premium) * 2 WHEN premium < 30 THEN 50 + (30 - premium) ELSE greatest(20, 50 - (premium - 30)) END) * 0.7
   + (CASE WHEN double_low > 0 AND double_low < 130 THEN 85 WHEN double_low > 0 AND double_low < 150 THEN 70 WHEN double_low > 0 THEN greatest(30, 70 - (double_low - 150) * 0.5) ELSE 50 END) * 0.3 AS arbitrage FROM bv),
sy AS (SELECT *, basic * 0.25 + stock * 0.2 + protection * 0.2 + time * 0.1 + trading * 0.15 + arbitrage * 0.1 AS composite FROM sx)"""


@query("e07_six_dimension_score", "code:i basic:f4 stock:f4 protection:f4 time:f4 trading:f4 arbitrage:f4 composite:f4 advice:s", BONDS + "," + SIX + """
---
SELECT *, CASE WHEN composite >= 80 THEN 'strong_buy' WHEN composite >= 65 THEN 'buy' WHEN composite >= 50 THEN 'watch' ELSE 'avoid' END AS advice FROM sy""")
def six(spark, sf):
    return E.six_dimension_score(valued(spark, sf))


@query("e08_bond_comparison", "code:i brand:s place:i composite:f4", BONDS + "," + SIX + "\n---\nSELECT *, row_number() OVER (PARTITION BY brand ORDER BY round(composite, 9) DESC, code) AS place FROM sy")
def comparison(spark, sf):
    return E.compare(six(spark, sf), "brand")


TD = D.PANEL + ", td AS (SELECT code, date, close, avg(close) OVER (PARTITION BY code) / 1.1 AS conv_price FROM panel)"


def _trigger_rows(spark, sf):
    from pyspark.sql import Window

    return D.panel(spark, sf).select("code", "date", "close", (F.avg("close").over(Window.partitionBy("code")) / 1.1).alias("conv_price"))


@query("e09_forced_redemption", "code:i date:d days:f0 state:s", TD + """,
tx AS (SELECT code, date, CASE WHEN count(*) OVER w >= 30 THEN sum((close >= conv_price * 1.3)::INT) OVER w END AS days FROM td WINDOW w AS (PARTITION BY code ORDER BY date ROWS 29 PRECEDING))
---
SELECT code, date, days, CASE WHEN days >= 15 THEN 'triggered' WHEN days >= 10 THEN 'approaching' ELSE 'not_triggered' END AS state FROM tx""")
def forced(spark, sf):
    return E.trigger_days(_trigger_rows(spark, sf))


@query("e10_down_revision", "code:i date:d days:f0 remaining:i high_priority:b", TD + """,
tx AS (SELECT code, date, CASE WHEN count(*) OVER w >= 30 THEN sum((close < conv_price * 0.85)::INT) OVER w END AS days FROM td WINDOW w AS (PARTITION BY code ORDER BY date ROWS 29 PRECEDING))
---
SELECT code, date, days, CASE WHEN days IS NOT NULL THEN greatest(15 - days, 0) END AS remaining, greatest(15 - days, 0) <= 5 AND days IS NOT NULL AS high_priority FROM tx""")
def down_revision(spark, sf):
    return E.down_revision_days(_trigger_rows(spark, sf))


@query("e11_smallest_float", "code:i remain_size:f4", BONDS + "\n---\nSELECT code, remain_size FROM bd ORDER BY remain_size, code LIMIT 10")
def smallest(spark, sf):
    return E.smallest(bonds(spark, sf).select("code", "remain_size"), "remain_size")


@query("e12_limit_hit_bonds", "code:i stk_code:i side:s", BONDS + """,
sl AS (SELECT stk_code, CASE WHEN stock_chg >= 2 THEN 'up' WHEN stock_chg <= -2 THEN 'down' END AS side FROM lst)
---
SELECT code, stk_code, side FROM bd JOIN sl USING (stk_code) WHERE side IS NOT NULL""")
def limit_hits(spark, sf):
    b = bonds(spark, sf)
    st = D.panel(spark, sf).groupBy(c("code").alias("stk_code")).agg(((F.max_by("close", "date") / F.max_by("open", "date") - 1) * 5).alias("chg"))
    return E.limit_hit_bonds(st.select("stk_code", F.when(c("chg") >= 2, "up").when(c("chg") <= -2, "down").alias("side")), b.select("code", "stk_code"))


@query("e13_listed_anomalies", "code:i stk_code:i", BONDS + "\n---\nSELECT code, stk_code FROM bd WHERE stk_code IN (SELECT l_suppkey FROM lineitem WHERE l_quantity >= 50 AND l_discount >= 0.1)")
def anomalies(spark, sf):
    listed = D.table(spark, sf, "lineitem").where("l_quantity >= 50 and l_discount >= 0.1").select(c("l_suppkey").alias("stk_code"))
    return E.listed_anomaly_bonds(bonds(spark, sf).select("code", "stk_code"), listed)


@query("e14_issuance_pipeline", "stage:s n:i size:f2", "SELECT o_orderpriority AS stage, count(*) AS n, sum(o_totalprice) AS size FROM orders WHERE o_orderpriority <> '1-URGENT' GROUP BY 1")
def issuance(spark, sf):
    o = D.table(spark, sf, "orders").select(c("o_orderpriority").alias("stage"), c("o_totalprice").alias("size"))
    return E.issuance_pipeline(o, "1-URGENT")


_LISTS = {"double_low": ("double_low", False), "ytm": ("ytm_pct", True), "amount": ("amount_yi", True), "turnover": ("turnover", True)}


@query("e15_top_lists", "metric:s place:i code:i value:f4", BONDS + ",\n" + ",\n".join(
    f"tl{i} AS (SELECT '{col}' AS metric, row_number() OVER (ORDER BY {col} {'DESC' if d else ''}, code) AS place, code, {col} AS value FROM bv)" for i, (col, d) in enumerate(_LISTS.values())) + "\n---\n" + " UNION ALL ".join(
    f"SELECT * FROM tl{i} WHERE place <= 10" for i in range(4)))
def top_lists(spark, sf):
    return E.top_lists(valued(spark, sf), _LISTS)


LAB = """
lb0 AS (SELECT *, (stock_price / conv_price - 1) * 100 AS cushion_pct, (pure_bond / price - 1) * 100 AS floor_pct, price - greatest(conv_value, pure_bond) AS time_value, (price - greatest(conv_value, pure_bond)) / price * 100 AS time_value_pct, (redeem_price / price - 1) * 100 AS maturity_pct,
  (conv_value / price - 1) * 100 AS arb_pct FROM bv),
lb AS (SELECT *, CASE WHEN floor_pct > 10 AND equity_ratio > 10 THEN 'high' WHEN floor_pct > 0 THEN 'medium' ELSE 'low' END AS safety, CASE WHEN years_left < 1 THEN 'fast' WHEN years_left < 2 THEN 'medium' ELSE 'slow' END AS decay,
  CASE WHEN time_value_pct > 20 THEN 'high' WHEN time_value_pct > 5 THEN 'medium' ELSE 'low' END AS option_level, CASE WHEN credit LIKE 'AA%' AND ytm_pct > 2 AND floor_pct > 5 THEN 'high' WHEN credit LIKE 'A%' AND ytm_pct > 0 THEN 'medium' ELSE 'low' END AS redeem_certainty,
  CASE WHEN maturity_pct > 5 AND ytm_pct > 3 THEN 'discount' WHEN maturity_pct > 0 THEN 'small_gain' ELSE 'premium_risk' END AS opportunity, CASE WHEN premium < 0 THEN 'discount' WHEN premium < 10 THEN 'low' WHEN premium < 30 THEN 'medium' ELSE 'high' END AS premium_zone,
  CASE WHEN amplitude > 5 AND turnover > 10 AND amount_yi > 1 THEN 'prime' WHEN amplitude > 3 AND turnover > 5 THEN 'suitable' ELSE 'plain' END AS grid, CASE WHEN turnover > 100 OR abs(chg) > 10 THEN 'high' WHEN turnover > 50 OR abs(chg) > 5 THEN 'medium' ELSE 'light' END AS abnormal,
  CASE WHEN arb_pct > 1 AND amount_yi > 0.5 THEN 'executable' WHEN arb_pct > 0.5 THEN 'watch' ELSE 'none' END AS arbitrage_state, CASE WHEN stock_chg > 0 THEN 'filling' WHEN stock_chg < 0 THEN 'falling' ELSE 'flat' END AS rights_state FROM lb0)"""


def _label_query(name, spec):
    @query(name, "code:i " + spec, BONDS + "," + LAB + "\n---\nSELECT * FROM lb")
    def run(spark, sf):
        return E.dashboard_labels(valued(spark, sf))


_label_query("e16_bond_cushion", "cushion_pct:f4 floor_pct:f4 safety:s")
_label_query("e17_rights_recovery", "rights_state:s")
_label_query("e18_time_value", "time_value:f4 time_value_pct:f4 decay:s option_level:s")
_label_query("e19_hard_redemption", "floor_pct:f4 maturity_pct:f4 redeem_certainty:s")
_label_query("e20_maturity_price", "maturity_pct:f4 opportunity:s")
_label_query("e22_grid_trading", "grid:s")
_label_query("e23_abnormal_bonds", "abnormal:s")
_label_query("e24_discount_arbitrage", "arb_pct:f4 arbitrage_state:s")


@query("e21_premium_zones", "premium_zone:s n:i avg_premium:f4", BONDS + "," + LAB + "\n---\nSELECT premium_zone, count(*) AS n, avg(premium) AS avg_premium FROM lb GROUP BY 1")
def zones(spark, sf):
    return E.zone_counts(E.dashboard_labels(valued(spark, sf)))


# ---- funds: every supplier is a fund -------------------------------------------------------------
_WIDE, _CROSS = ["widget", "gear"], ["red", "ring"]
KIND = """CASE WHEN p_type = 'PROMO' THEN 'money' WHEN p_type = 'SMALL' OR p_name LIKE '%bolt%' THEN 'commodity' WHEN regexp_matches(p_name, 'red|ring') AND NOT regexp_matches(p_name, 'widget|gear') THEN 'cross_border' WHEN regexp_matches(p_name, 'widget|gear') THEN 'broad' ELSE 'sector' END"""


def _kind():
    return E.classify_fund(c("p_name"), c("p_type"), _WIDE, _CROSS, ["PROMO"], ["SMALL"], ["bolt"])


@query("e25_fund_classification", "code:i kind:s", f"SELECT p_partkey AS code, {KIND} AS kind FROM part")
def classification(spark, sf):
    return D.table(spark, sf, "part").select(c("p_partkey").alias("code"), _kind().alias("kind"))


def _funds(spark, sf):
    return D.panel(spark, sf).select("code", "date", c("volume").alias("share"), "amount", c("close").alias("nav"), "close")


@query("e26_share_changes", "code:i date:d change:f2 change_pct:f4", D.PANEL + """
---
SELECT code, date, volume - lag(volume) OVER w AS change, (volume / lag(volume) OVER w - 1) * 100 AS change_pct FROM panel WINDOW w AS (PARTITION BY code ORDER BY date)""")
def share_changes(spark, sf):
    return E.share_changes(_funds(spark, sf))


SCL = """
am AS (SELECT code, avg(amount) AS mean_amount FROM (SELECT * FROM panel QUALIFY row_number() OVER (PARTITION BY code ORDER BY date DESC) <= 30) GROUP BY 1),
scl AS (SELECT am.code, mean_amount, share, nav, share * nav AS scale FROM am JOIN (SELECT code, arg_max(volume, date) AS share, arg_max(close, date) AS nav FROM panel GROUP BY 1) s ON s.code = am.code)"""


@query("e27_fund_scale", "code:i mean_amount:f2 share:f2 scale:f2", D.PANEL + "," + SCL + "\n---\nSELECT * FROM scl")
def scale(spark, sf):
    f = _funds(spark, sf)
    return E.fund_scale(f, f, f)


@query("e28_fund_comparison", "code:i ret60:f4 ret200:f4", D.PANEL + """,
lx AS (SELECT *, max(date) OVER (PARTITION BY code) AS l FROM panel)
---
SELECT code, (arg_max(close, date) / arg_min(close, date) FILTER (date >= l - 60) - 1) * 100 AS ret60, (arg_max(close, date) / arg_min(close, date) FILTER (date >= l - 200) - 1) * 100 AS ret200 FROM lx GROUP BY 1""")
def fund_comparison(spark, sf):
    return E.fund_returns(_funds(spark, sf), [60, 200])


FND = D.PANEL + "," + SCL + f""",
fk AS (SELECT l_suppkey AS code, min(l_partkey) AS pk FROM lineitem GROUP BY 1),
lc AS (SELECT code, date, (volume / lag(volume) OVER w - 1) * 100 AS change_pct FROM panel WINDOW w AS (PARTITION BY code ORDER BY date)),
fd AS (SELECT fk.code, s_name AS name, {KIND} AS kind, scale, arg_max_null(change_pct, date) AS change_pct FROM fk JOIN part ON p_partkey = pk JOIN supplier ON s_suppkey = fk.code JOIN scl ON scl.code = fk.code JOIN lc ON lc.code = fk.code GROUP BY 1, 2, 3, 4)"""


def _fund_table(spark, sf):
    k = D.table(spark, sf, "lineitem").groupBy(c("l_suppkey").alias("code")).agg(F.min("l_partkey").alias("p_partkey"))
    k = k.join(D.table(spark, sf, "part"), "p_partkey").select("code", _kind().alias("kind"))
    n = D.table(spark, sf, "supplier").select(c("s_suppkey").alias("code"), c("s_name").alias("name"))
    ch = share_changes(spark, sf).groupBy("code").agg(F.max_by("change_pct", "date").alias("change_pct"))
    return k.join(n, "code").join(scale(spark, sf).select("code", "scale"), "code").join(ch, "code")


@query("e29_fund_screen", "code:i kind:s scale:f2 change_pct:f4", FND + "\n---\nSELECT * FROM fd WHERE kind = 'broad' AND scale >= 1000 AND change_pct >= -60")
def fund_screen(spark, sf):
    return E.fund_screen(_fund_table(spark, sf), "broad", 1000, -60)


@query("e30_class_summary", "kind:s n:i scale:f2 top_names:s", FND + """,
fr AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY round(scale, 6) DESC, code) AS r FROM fd)
---
SELECT kind, count(*) AS n, sum(scale) AS scale, string_agg(name, ',' ORDER BY r) FILTER (r <= 3) AS top_names FROM fr GROUP BY 1""")
def class_summary(spark, sf):
    return E.class_summary(_fund_table(spark, sf).withColumn("scale", F.round("scale", 6)))


@query("e31_latest_records", "fund:i place:i holding:i ratio:f4 date:d", """
hd AS (SELECT l_suppkey AS fund, l_partkey AS holding, CAST(l_shipdate AS DATE) AS date, l_quantity AS ratio, l_orderkey, l_linenumber FROM lineitem)
---
SELECT *, row_number() OVER (PARTITION BY fund ORDER BY date DESC, l_orderkey, l_linenumber) AS place FROM hd QUALIFY place <= 10""")
def records(spark, sf):
    h = D.table(spark, sf, "lineitem").select(c("l_suppkey").alias("fund"), c("l_partkey").alias("holding"), F.to_date("l_shipdate").alias("date"), c("l_quantity").alias("ratio"), "l_orderkey", "l_linenumber")
    return E.latest_records(h, ["fund"], [F.desc("date"), c("l_orderkey"), c("l_linenumber")])


# ---- industries ----------------------------------------------------------------------------------
@query("e32_industry_overview", "industry:s companies:i cap:f2", """
x AS (SELECT p_partkey AS company, p_retailprice AS cap, unnest(string_split(p_name, ' ')) AS industry FROM part)
---
SELECT industry, count(DISTINCT company) AS companies, sum(cap) AS cap FROM x GROUP BY 1 ORDER BY companies DESC, industry LIMIT 10""")
def overview(spark, sf):
    p = D.table(spark, sf, "part").select(c("p_partkey").alias("company"), c("p_retailprice").alias("cap"), F.split("p_name", " ").alias("industries"))
    return E.industry_overview(p)


@query("e33_chain_nodes", "stage:s node:s companies:i names:s", """
n AS (SELECT DISTINCT p_type AS stage, p_brand AS node, s_name AS company FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey),
r AS (SELECT *, row_number() OVER (PARTITION BY stage, node ORDER BY company) AS r FROM n)
---
SELECT stage, node, count(*) AS companies, string_agg(company, ',' ORDER BY company) FILTER (r <= 5) AS names FROM r GROUP BY 1, 2""")
def chain(spark, sf):
    li, part, s = (D.table(spark, sf, x) for x in ("lineitem", "part", "supplier"))
    return E.chain_nodes(li.join(part, li.l_partkey == part.p_partkey).join(s, li.l_suppkey == s.s_suppkey).select(c("p_type").alias("stage"), c("p_brand").alias("node"), c("s_name").alias("company")))


@query("e34_key_stocks", "industry:s place:i code:i cap:f2", "SELECT p_type AS industry, row_number() OVER (PARTITION BY p_type ORDER BY p_retailprice DESC, p_partkey) AS place, p_partkey AS code, p_retailprice AS cap FROM part QUALIFY place <= 5")
def key_stocks(spark, sf):
    return E.key_stocks(D.table(spark, sf, "part").select(c("p_type").alias("industry"), c("p_partkey").alias("code"), c("p_retailprice").alias("cap")))
