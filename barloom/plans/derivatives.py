"""Option and futures queries."""

from pyspark.sql import functions as F

from barloom.functions.solvers import CDF_B, CDF_D, CDF_P, implied_vol, with_option_price
from barloom.operators import derivatives as V
from barloom.operators import indicators as I
from barloom.plans import bindings as D
from barloom.plans.registry import query
from barloom.session import spread

c = F.col
R = 0.02


def cdf_sql(x):
    t = f"(1 / (1 + {CDF_P}e0 * abs({x})))"
    poly = f"({CDF_B[4]}e0 * {t})"
    for b in reversed(CDF_B[:4]):
        poly = f"(({poly} + ({b}e0)) * {t})"
    return f"(CASE WHEN {x} > 0 THEN 1 - {CDF_D}e0 * exp(-({x}) * ({x}) / 2) * {poly} ELSE {CDF_D}e0 * exp(-({x}) * ({x}) / 2) * {poly} END)"


# ---- chain: every part is an underlying with seven strikes, calls and puts ------------------------
_M = [0.8, 0.9, 0.95, 1.0, 1.05, 1.1, 1.2]
CHAIN = f"""ch0 AS (SELECT p_partkey AS symbol, p_retailprice AS spot, (p_size + 5) / 365e0 AS t, unnest([{', '.join(f'{m}e0' for m in _M)}]) AS m, p_partkey FROM part),
ch1 AS (SELECT symbol, spot, t, spot * m AS strike, 0.15e0 + p_partkey % 20 / 100e0 + (m - 1) * (m - 1) AS sigma, unnest([true, false]) AS call FROM ch0),
ch2 AS (SELECT *, (ln(spot / strike) + (sigma * sigma / 2 + {R}e0) * t) / (sigma * sqrt(t)) AS d1 FROM ch1),
ch3 AS (SELECT *, d1 - sigma * sqrt(t) AS d2 FROM ch2),
ch AS (SELECT *, CASE WHEN call THEN spot * {cdf_sql('d1')} - strike * exp(-{R}e0 * t) * {cdf_sql('d2')} ELSE strike * exp(-{R}e0 * t) * {cdf_sql('(-d2)')} - spot * {cdf_sql('(-d1)')} END AS price FROM ch3)"""


def chain(spark, sf):
    p = D.table(spark, sf, "part").select(c("p_partkey").alias("symbol"), c("p_retailprice").alias("spot"), ((c("p_size") + 5) / 365.0).alias("t"))
    p = spread(p, "symbol").select("*", F.explode(F.array(*[F.lit(m) for m in _M])).alias("m"))
    p = p.select("symbol", "spot", "t", (c("spot") * c("m")).alias("strike"), (F.lit(0.15) + c("symbol") % 20 / 100.0 + (c("m") - 1) * (c("m") - 1)).alias("sigma"),
                 F.explode(F.array(F.lit(True), F.lit(False))).alias("call"))
    return with_option_price(p, R)


@query("d01_option_price", "symbol:i strike:f4 call:b price:f6", CHAIN + "\n---\nSELECT * FROM ch")
def price(spark, sf):
    return chain(spark, sf)


@query("d02_greeks", "symbol:i strike:f4 call:b delta:f6 gamma:f6 theta:f6 vega:f6 rho:f6", CHAIN + f"""
---
SELECT symbol, strike, call, CASE WHEN call THEN {cdf_sql('d1')} ELSE -{cdf_sql('(-d1)')} END AS delta, {CDF_D}e0 * exp(-d1 * d1 / 2) / (spot * sigma * sqrt(t)) AS gamma,
  (-spot * {CDF_D}e0 * exp(-d1 * d1 / 2) * sigma / (2 * sqrt(t)) + CASE WHEN call THEN -{R}e0 * strike * exp(-{R}e0 * t) * {cdf_sql('d2')} ELSE {R}e0 * strike * exp(-{R}e0 * t) * {cdf_sql('(-d2)')} END) / 365 AS theta,
  spot * {CDF_D}e0 * exp(-d1 * d1 / 2) * sqrt(t) / 100 AS vega, CASE WHEN call THEN strike * t * exp(-{R}e0 * t) * {cdf_sql('d2')} ELSE -strike * t * exp(-{R}e0 * t) * {cdf_sql('(-d2)')} END / 100 AS rho FROM ch""")
def greeks(spark, sf):
    return V.with_greeks(chain(spark, sf), R)


def _iv_sql(r):
    val = (f"CASE WHEN call THEN spot * {cdf_sql('({d1})')} - strike * exp(-{r}e0 * t) * {cdf_sql('({d2})')} ELSE strike * exp(-{r}e0 * t) * {cdf_sql('(-({d2}))')} - spot * {cdf_sql('(-({d1}))')} END")

    def value(v):
        d1 = f"(ln(spot / strike) + ({r}e0 + {v} * {v} / 2) * t) / ({v} * sqrt(t))"
        d2 = f"{d1} - {v} * sqrt(t)"
        return val.replace("{d1}", d1).replace("{d2}", d2)

    step = value("((a.lo + a.hi) / 2)")
    ok = f"price > greatest(CASE WHEN call THEN spot - strike ELSE strike - spot END, 0) + 1e-9 AND {value('1e-4')} <= price AND {value('5e0')} >= price"
    return f"""CASE WHEN {ok} THEN list_reduce(list_prepend({{'lo': 1e-4, 'hi': 5e0}}, list_transform(range(60), lambda i: {{'lo': 0e0, 'hi': 0e0}})),
  lambda a, x: CASE WHEN {step} < price THEN {{'lo': (a.lo + a.hi) / 2, 'hi': a.hi}} ELSE {{'lo': a.lo, 'hi': (a.lo + a.hi) / 2}} END) END"""


def _iv_query(r):
    return CHAIN + f",\niv AS (SELECT symbol, strike, call, {_iv_sql(r)} AS b FROM ch)\n---\nSELECT symbol, strike, call, (b.lo + b.hi) / 2 AS iv FROM iv"


@query("d03_implied_vol", "symbol:i strike:f4 call:b iv:f4", _iv_query(R))
def implied(spark, sf):
    return chain(spark, sf).withColumn("iv", implied_vol(c("spot"), c("strike"), c("t"), c("price"), c("call"), R))


@query("d04_implied_vol_zero_rate", "symbol:i strike:f4 call:b iv:f4", _iv_query(0.0))
def implied_zero(spark, sf):
    return chain(spark, sf).withColumn("iv", implied_vol(c("spot"), c("strike"), c("t"), c("price"), c("call"), 0.0))


@query("d05_put_call_parity", "symbol:i strike:f4 gap:f5 holds:b", CHAIN + f""",
pp AS (SELECT symbol, strike, t, max(spot) AS spot, max(price) FILTER (call) AS cp, max(price) FILTER (NOT call) AS pp FROM ch GROUP BY 1, 2, 3)
---
SELECT symbol, strike, abs(cp - pp - (spot - strike * exp(-{R}e0 * t))) AS gap, abs(cp - pp - (spot - strike * exp(-{R}e0 * t))) < spot * 0.01 AS holds FROM pp""")
def parity(spark, sf):
    return V.parity_screen(chain(spark, sf), ("symbol",), R)


# ---- daily option rows: brand x month x strike step x side, volumes from all line items -----------
OPT = """op0 AS (SELECT p_brand AS symbol, CAST(date_trunc('month', l_shipdate) AS DATE) AS date, l_linenumber AS k, l_linestatus = 'O' OR l_returnflag = 'R' AS call, sum(l_quantity) AS vol, count(*) * 10 AS oi,
  sum(l_extendedprice) AS am FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3, 4),
op1 AS (SELECT *, sum(am) OVER (PARTITION BY symbol, date) / sum(vol) OVER (PARTITION BY symbol, date) AS spot FROM op0),
op AS (SELECT symbol, date, call, vol, oi, spot, spot * (0.86e0 + k * 0.04e0) AS strike, k * 12 / 365e0 AS t, 0.15e0 + k * 0.02e0 + CASE WHEN call THEN 0 ELSE 0.01e0 END + vol % 7 / 100 AS iv FROM op1)"""


def option_rows(spark, sf):
    from pyspark.sql import Window

    li, part = D.table(spark, sf, "lineitem"), D.table(spark, sf, "part")
    g = li.join(part, li.l_partkey == part.p_partkey).groupBy(
        c("p_brand").alias("symbol"), F.trunc("l_shipdate", "month").alias("date"), c("l_linenumber").alias("k"), ((c("l_linestatus") == "O") | (c("l_returnflag") == "R")).alias("call")).agg(
        F.sum("l_quantity").alias("vol"), (F.count(F.lit(1)) * 10.0).alias("oi"), F.sum("l_extendedprice").alias("am"))
    w = Window.partitionBy("symbol", "date")
    g = g.withColumn("spot", F.sum("am").over(w) / F.sum("vol").over(w))
    return g.select("symbol", "date", "call", "vol", "oi", "spot", (c("spot") * (c("k") * 0.04 + 0.86)).alias("strike"), (c("k") * 12 / 365.0).alias("t"),
                    (c("k") * 0.02 + 0.15 + F.when(c("call"), 0.0).otherwise(0.01) + c("vol") % 7 / 100).alias("iv"))


PCR = """
pcr AS (SELECT symbol, date, sum(CASE WHEN call THEN vol ELSE 0 END) AS call_vol, sum(CASE WHEN call THEN 0 ELSE vol END) AS put_vol, sum(CASE WHEN call THEN 0 ELSE vol END) / nullif(sum(CASE WHEN call THEN vol ELSE 0 END), 0) AS pcr_vol,
  sum(CASE WHEN call THEN 0 ELSE oi END) / nullif(sum(CASE WHEN call THEN oi ELSE 0 END), 0) AS pcr_oi FROM op GROUP BY 1, 2)"""
IVM = """
im0 AS (SELECT *, strike / spot AS m, abs(strike / spot - 1) AS dm, t <= 60 / 365e0 AS near FROM op),
im AS (SELECT symbol, date, arg_min(iv, struct_pack(d := dm, c := call, v := iv)) FILTER (near) * 100 AS atm_iv, sum(iv * vol) / sum(vol) * 100 AS weighted_iv,
  CASE WHEN count(*) FILTER (near AND m < 1) >= 3 THEN regr_slope(iv, strike) FILTER (near AND m < 1) * 1000 END AS slope_put, CASE WHEN count(*) FILTER (near AND m > 1) >= 3 THEN regr_slope(iv, strike) FILTER (near AND m > 1) * 1000 END AS slope_call,
  (avg(iv) FILTER (near AND m < 1 AND NOT call) - avg(iv) FILTER (near AND m > 1 AND call)) * 100 AS risk_reversal, (avg(iv) FILTER (near AND dm < 0.05 AND NOT call) - avg(iv) FILTER (near AND dm < 0.05 AND call)) * 100 AS atm_gap FROM im0 GROUP BY 1, 2)"""


@query("d06_put_call_ratios", "symbol:s date:d call_vol:f2 put_vol:f2 pcr_vol:f6 pcr_oi:f6", OPT + "," + PCR + "\n---\nSELECT * FROM pcr")
def pcr(spark, sf):
    return V.put_call_ratios(option_rows(spark, sf))


def _ivm(spark, sf):
    return V.iv_metrics(option_rows(spark, sf).withColumn("dm", F.lit(0)))


@query("d07_weighted_iv", "symbol:s date:d weighted_iv:f6", OPT + "," + IVM + "\n---\nSELECT * FROM im")
def weighted_iv(spark, sf):
    return _ivm(spark, sf)


@query("d07_atm_iv", "symbol:s strike:f4 atm_iv:f4", CHAIN + """,
at0 AS (SELECT symbol, t, strike, spot, sigma AS iv, call FROM ch)
---
SELECT symbol, max(spot) AS strike, arg_min(iv, struct_pack(d := abs(strike / spot - 1), c := call, v := iv)) FILTER (t <= 60 / 365e0) * 100 AS atm_iv FROM at0 GROUP BY 1""")
def atm_iv(spark, sf):
    rows = chain(spark, sf).select("symbol", "t", "strike", "spot", c("sigma").alias("iv"), "call", F.lit(1.0).alias("vol"), F.lit("x").alias("date"))
    spot = rows.groupBy("symbol").agg(F.max("spot").alias("strike"))
    return V.iv_metrics(rows, ("symbol",)).join(spot, "symbol")


@query("d08_skew_slopes", "symbol:s date:d slope_put:f6 slope_call:f6", OPT + "," + IVM + "\n---\nSELECT * FROM im")
def skew(spark, sf):
    return _ivm(spark, sf)


@query("d09_risk_reversal", "symbol:s date:d risk_reversal:f6 atm_gap:f6", OPT + "," + IVM + "\n---\nSELECT * FROM im")
def risk_reversal(spark, sf):
    return _ivm(spark, sf)


@query("d10_bucketed_option_metrics", "symbol:s bucket:d pcr_vol_mean:f6 weighted_iv_mean:f6 pcr_vol_last:f6 weighted_iv_last:f6 days:i", OPT + "," + PCR + "," + IVM + """
---
SELECT symbol, CAST(date_trunc('quarter', date) AS DATE) AS bucket, avg(pcr_vol) AS pcr_vol_mean, avg(weighted_iv) AS weighted_iv_mean, arg_max_null(pcr_vol, date) AS pcr_vol_last, arg_max_null(weighted_iv, date) AS weighted_iv_last, count(*) AS days
FROM pcr JOIN im USING (symbol, date) GROUP BY 1, 2""")
def bucketed(spark, sf):
    d = pcr(spark, sf).join(_ivm(spark, sf), ["symbol", "date"])
    return V.weekly_option_metrics(d, ["pcr_vol", "weighted_iv"], F.trunc("date", "quarter"))


RV = """
pr AS (SELECT code AS symbol, date, close, ln(close / lag(close) OVER w) AS lr FROM panel WINDOW w AS (PARTITION BY code ORDER BY date)),
rv AS (SELECT symbol, date, CASE WHEN count(lr) OVER (v ROWS 5 PRECEDING) >= 6 THEN stddev_samp(lr) OVER (v ROWS 5 PRECEDING) END AS rv6, CASE WHEN count(lr) OVER (v ROWS 11 PRECEDING) >= 12 THEN stddev_samp(lr) OVER (v ROWS 11 PRECEDING) END AS rv12,
  CASE WHEN count(lr) OVER (v ROWS 23 PRECEDING) >= 24 THEN stddev_samp(lr) OVER (v ROWS 23 PRECEDING) END AS iv FROM pr WINDOW v AS (PARTITION BY symbol ORDER BY date))"""


def _rv(spark, sf):
    p = D.panel(spark, sf).select(c("code").alias("symbol"), "date", "close")
    s = V.FS
    p = p.withColumn("lr", F.log(c("close") / s.lag("close")))
    return p.select("symbol", "date", s.std("lr", 6).alias("rv6"), s.std("lr", 12).alias("rv12"), s.std("lr", 24).alias("iv"))


@query("d11_iv_against_rv", "symbol:i date:d horizon:s spread:f6 premium_pct:f4 label:s overall:s", D.PANEL + "," + RV + """,
lg AS (SELECT symbol, date, iv, unnest(['rv6', 'rv12']) AS win, unnest([rv6, rv12]) AS rv FROM rv),
lb AS (SELECT *, iv - rv AS spread, CASE WHEN rv > 0 THEN (iv - rv) / rv * 100 ELSE 0 END AS premium_pct, CASE WHEN iv - rv > 0.03 THEN 'rich' WHEN iv - rv < -0.03 THEN 'cheap' ELSE 'fair' END AS label FROM lg WHERE rv IS NOT NULL AND iv IS NOT NULL),
vt AS (SELECT *, sum(CASE label WHEN 'rich' THEN 1 WHEN 'cheap' THEN -1 ELSE 0 END) OVER (PARTITION BY symbol, date) AS v FROM lb)
---
SELECT symbol, date, win AS horizon, spread, premium_pct, label, CASE WHEN v > 0 THEN 'rich' WHEN v < 0 THEN 'cheap' ELSE 'fair' END AS overall FROM vt""")
def iv_rv(spark, sf):
    return V.iv_against_rv(_rv(spark, sf).where("iv is not null"), ["rv6", "rv12"])


@query("d12_surface_summary", "symbol:i tenor:f8 atm_vol:f6 skew:s term_structure:s atm_min:f6 atm_max:f6", CHAIN + """,
su AS (SELECT symbol, strike AS tenor, avg(sigma) AS atm_vol, avg(sigma) - 0.25e0 AS rr FROM ch GROUP BY symbol, strike)
---
SELECT symbol, tenor, atm_vol, CASE WHEN rr > 0 THEN 'call_skew' ELSE 'put_skew' END AS skew, CASE WHEN arg_max(atm_vol, tenor) OVER g - arg_min(atm_vol, tenor) OVER g > 0 THEN 'contango' ELSE 'backwardation' END AS term_structure,
  min(atm_vol) OVER g AS atm_min, max(atm_vol) OVER g AS atm_max FROM su WINDOW g AS (PARTITION BY symbol)""")
def surface(spark, sf):
    vol = chain(spark, sf).groupBy("symbol", c("strike").alias("tenor")).agg(F.avg("sigma").alias("atm_vol"))     # calls and puts
    return V.surface_summary(vol.withColumn("rr", c("atm_vol") - 0.25))


@query("d13_vol_regime", "symbol:i date:d iv_rank:f4 iv_percentile:f4 regime:s", D.PANEL + "," + RV + """,
rg AS (SELECT symbol, date, iv, (iv - min(iv) OVER h) / nullif(max(iv) OVER h - min(iv) OVER h, 0) * 100 AS iv_rank, list(iv) OVER h AS l FROM rv WHERE iv IS NOT NULL WINDOW h AS (PARTITION BY symbol ORDER BY date ROWS 35 PRECEDING))
---
SELECT symbol, date, iv_rank, CASE WHEN len(l) > 10 THEN len(list_filter(l, lambda x: x < iv)) * 100e0 / len(l) END AS iv_percentile, CASE WHEN iv_rank < 20 THEN 'low' WHEN iv_rank < 80 THEN 'normal' WHEN iv_rank IS NOT NULL THEN 'high' END AS regime FROM rg""")
def regime(spark, sf):
    return V.vol_regime(_rv(spark, sf).where("iv is not null").select("symbol", "date", "iv"), 36)


# ---- payoff: three strategies per brand on its mean price -----------------------------------------
_LEG = "{{'call': {c}, 'strike': s0 * {k}e0, 'direction': {d}e0, 'qty': {q}e0, 'premium': s0 * {p}e0, 't': {t}e0, 'sigma': {v}e0}}"
LEGS = {"bull_call": [(True, 0.95, 1, 1, 0.08, 0.25, 0.3), (True, 1.05, -1, 1, 0.03, 0.25, 0.3)], "straddle": [(True, 1.0, 1, 2, 0.05, 0.5, 0.25), (False, 1.0, 1, 2, 0.045, 0.5, 0.25)],
        "ratio_call": [(True, 0.9, 1, 1, 0.12, 0.25, 0.35), (True, 1.1, -1, 2, 0.02, 0.25, 0.35)]}


def _legs_sql(legs):
    return "[" + ", ".join(_LEG.format(c=str(a).lower(), k=k, d=d, q=qq, p=p, t=t, v=v) for a, k, d, qq, p, t, v in legs) + "]"


PAY = "pm AS (SELECT p_brand AS brand, avg(p_retailprice) AS s0 FROM part GROUP BY 1),\nps AS (" + " UNION ALL ".join(
    f"SELECT brand || ':{n}' AS strategy, s0, {_legs_sql(v)} AS legs FROM pm" for n, v in LEGS.items()) + """),
pg AS (SELECT *, s0 * (0.5e0 + i * 0.01e0) AS spot FROM ps, (SELECT unnest(range(101)) AS i)),
pl AS (SELECT strategy, i, spot, unnest(legs) AS g FROM pg),
py AS (SELECT strategy, i, spot, sum(g.direction * g.qty * (greatest(CASE WHEN g.call THEN spot - g.strike ELSE g.strike - spot END, 0) - g.premium)) AS pnl, sum(CASE WHEN g.call THEN g.direction * g.qty ELSE 0 END) AS nc FROM pl GROUP BY 1, 2, 3)"""


def _grid(spark, sf):
    b = D.table(spark, sf, "part").groupBy(c("p_brand").alias("brand")).agg(F.avg("p_retailprice").alias("spot0"))

    def leg(a, k, d, qq, p, t, v):
        return F.struct(F.lit(a).alias("call"), (c("spot0") * k).alias("strike"), F.lit(float(d)).alias("direction"), F.lit(float(qq)).alias("qty"),
                        (c("spot0") * p).alias("premium"), F.lit(t).alias("t"), F.lit(v).alias("sigma"))

    s = b.select("brand", "spot0", F.inline(F.array(*[F.struct(F.lit(n).alias("n"), F.array(*[leg(*x) for x in v]).alias("legs")) for n, v in LEGS.items()])))
    return V.spot_grid(s.withColumn("strategy", F.concat("brand", F.lit(":"), "n")))


def _payoff(spark, sf):
    return V.expiry_payoff(_grid(spark, sf))


@query("d14_expiry_payoff", "strategy:s i:i spot:f6 pnl:f6", PAY + "\n---\nSELECT * FROM py")
def payoff(spark, sf):
    return _payoff(spark, sf)


def _theo_sql(mult="1e0"):
    v = f"(g.sigma * {mult})"
    d1 = f"((ln(spot / g.strike) + ({v} * {v} / 2 + {R}e0) * g.t) / ({v} * sqrt(g.t)))"
    d2 = f"({d1} - {v} * sqrt(g.t))"
    return f"CASE WHEN g.call THEN spot * {cdf_sql(d1)} - g.strike * exp(-{R}e0 * g.t) * {cdf_sql(d2)} ELSE g.strike * exp(-{R}e0 * g.t) * {cdf_sql(f'(-{d2})')} - spot * {cdf_sql(f'(-{d1})')} END"


@query("d15_theoretical_value", "strategy:s i:i value:f4", PAY + f"\n---\nSELECT strategy, i, sum(g.direction * g.qty * ({_theo_sql()} - g.premium)) AS value FROM pl GROUP BY 1, 2")
def theo(spark, sf):
    return V.theoretical_value(_grid(spark, sf), R)


@query("d16_break_evens", "strategy:s break_even:f2", PAY + """,
be AS (SELECT strategy, spot, pnl, lag(pnl) OVER w AS pp, lag(spot) OVER w AS sp FROM py WINDOW w AS (PARTITION BY strategy ORDER BY i)),
bf AS (SELECT strategy, CASE WHEN pnl = 0 THEN spot WHEN pp * pnl < 0 THEN sp + (spot - sp) * pp / (pp - pnl) END AS x FROM be)
---
SELECT DISTINCT strategy, floor(x * 100 + 0.5) / 100 AS break_even FROM bf WHERE x IS NOT NULL""")
def breaks(spark, sf):
    return V.break_evens(_payoff(spark, sf))


@query("d17_max_profit_loss", "strategy:s max_profit:f4 max_loss:f4 profit_unlimited:b loss_unlimited:b", PAY + "\n---\nSELECT strategy, max(pnl) AS max_profit, min(pnl) AS max_loss, max(nc) > 0 AS profit_unlimited, max(nc) < 0 AS loss_unlimited FROM py GROUP BY 1")
def extremes(spark, sf):
    return V.max_profit_loss(_payoff(spark, sf))


@query("d17_profit_ranges", "strategy:s sg:f0 from_spot:f6 to_spot:f6 peak:f6", PAY + """,
pi AS (SELECT *, sign(pnl) AS sg, CASE WHEN sign(pnl) <> lag(sign(pnl)) OVER w THEN 1 ELSE 0 END AS nw FROM py WINDOW w AS (PARTITION BY strategy ORDER BY i)),
pj AS (SELECT *, sum(nw) OVER (PARTITION BY strategy ORDER BY i) AS isl FROM pi)
---
SELECT strategy, sg, min(spot) AS from_spot, max(spot) AS to_spot, max(abs(pnl)) AS peak FROM pj WHERE sg <> 0 GROUP BY strategy, isl, sg""")
def ranges(spark, sf):
    return V.profit_ranges(_payoff(spark, sf))


@query("d18_vol_scenarios", "strategy:s i:i multiplier:f2 value:f4", PAY + f"""
---
SELECT strategy, i, mu AS multiplier, sum(g.direction * g.qty * ({_theo_sql('mu')} - g.premium)) AS value FROM pl, (SELECT unnest([0.5e0, 0.75e0, 1e0, 1.25e0, 1.5e0]) AS mu) GROUP BY 1, 2, 3""")
def scenarios(spark, sf):
    return V.vol_scenarios(_grid(spark, sf), r=R)


# ---- futures: brand months -----------------------------------------------------------------------
FUT = D.BRAND_MONTH + """,
fu AS (SELECT code AS symbol, ts AS date, amount / volume AS close, high, low, volume AS vol, trades * 10e0 AS oi FROM mbars)"""
FST = """
fs0 AS (SELECT *, row_number() OVER w AS i, avg(close) OVER (w ROWS 4 PRECEDING) AS m5, avg(close) OVER (w ROWS 9 PRECEDING) AS m10, avg(close) OVER (w ROWS 19 PRECEDING) AS m20, max(high) OVER (w ROWS 19 PRECEDING) AS high20, min(low) OVER (w ROWS 19 PRECEDING) AS low20,
  avg((high - low) / close) OVER (w ROWS 9 PRECEDING) * 100 AS amplitude10, oi - lag(oi) OVER w AS oi_chg, avg(vol) OVER (w ROWS 4 PRECEDING) AS v5, (close / lag(close) OVER w - 1) * 100 AS pct_chg FROM fu WINDOW w AS (PARTITION BY symbol ORDER BY date)),
fs1 AS (SELECT *, CASE WHEN i >= 5 THEN m5 ELSE close END AS ma5, CASE WHEN i >= 10 THEN m10 ELSE close END AS ma10, CASE WHEN i >= 20 THEN m20 ELSE close END AS ma20, CASE WHEN i >= 5 THEN v5 ELSE vol END AS vol5 FROM fs0),
fst AS (SELECT *, CASE WHEN close > ma5 AND ma5 > ma10 AND ma10 > ma20 THEN 'bull' WHEN close < ma5 AND ma5 < ma10 AND ma10 < ma20 THEN 'bear' WHEN close > ma5 THEN 'leaning_bull' ELSE 'leaning_bear' END AS trend,
  CASE WHEN oi_chg > 0 THEN 'adding' WHEN oi_chg < 0 THEN 'cutting' ELSE 'flat' END AS oi_trend, CASE WHEN vol > vol5 * 1.2 THEN 'heavy' WHEN vol < vol5 * 0.8 THEN 'light' ELSE 'normal' END AS vol_state FROM fs1)"""


def futures(spark, sf):
    return D.brand_bars(spark, sf, "month").select(c("code").alias("symbol"), c("ts").alias("date"), (c("amount") / c("volume")).alias("close"), "high", "low",
                                                   c("volume").alias("vol"), (c("trades") * 10.0).alias("oi"))


@query("d19_futures_price_state", "symbol:s date:d ma5:f7 ma20:f7 high20:f8 low20:f8 amplitude10:f6 trend:s oi_trend:s vol_state:s", FUT + "," + FST + "\n---\nSELECT * FROM fst")
def price_state(spark, sf):
    return V.price_state(futures(spark, sf))


BAS = """
sp AS (SELECT date, avg(close) AS spot FROM fu GROUP BY 1),
bs0 AS (SELECT symbol, fu.date, close - spot AS basis, (close - spot) / spot * 100 AS basis_rate FROM fu JOIN sp ON fu.date = sp.date),
bas AS (SELECT *, avg(basis_rate) OVER (PARTITION BY symbol ORDER BY date ROWS 4 PRECEDING) AS basis_rate5, CASE WHEN basis_rate > 0.5 THEN 'premium' WHEN basis_rate < -0.5 THEN 'discount' ELSE 'normal' END AS basis_signal FROM bs0)"""


def _basis(spark, sf):
    f = futures(spark, sf)
    mean = f.groupBy("date").agg(F.avg("close").alias("close"))
    spot = f.select("symbol", "date").join(mean, "date")
    return V.basis(f, spot)


@query("d20_basis", "symbol:s date:d basis:f4 basis_rate:f6 basis_rate5:f6 basis_signal:s", FUT + "," + BAS + "\n---\nSELECT * FROM bas")
def basis(spark, sf):
    return _basis(spark, sf)


HLD = """hl AS (SELECT p_brand AS symbol, CAST(date_trunc('month', l_shipdate) AS DATE) AS date, l_suppkey AS broker, sum(CASE WHEN l_returnflag = 'N' THEN l_quantity ELSE 0 END) AS long_hld,
  sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) AS short_hld FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3)"""
BRK = """
bk AS (SELECT symbol, date, sum(long_hld) AS long_total, sum(short_hld) AS short_total FROM hl GROUP BY 1, 2),
bl AS (SELECT symbol, date, sum(long_hld) AS top_long FROM (SELECT * FROM hl QUALIFY row_number() OVER (PARTITION BY symbol, date ORDER BY long_hld DESC, broker) <= 10) GROUP BY 1, 2),
bsh AS (SELECT symbol, date, sum(short_hld) AS top_short FROM (SELECT * FROM hl QUALIFY row_number() OVER (PARTITION BY symbol, date ORDER BY short_hld DESC, broker) <= 10) GROUP BY 1, 2),
br AS (SELECT *, (long_total - short_total) / nullif(long_total + short_total, 0) * 100 AS net_pct FROM bk JOIN bl USING (symbol, date) JOIN bsh USING (symbol, date)),
bro AS (SELECT *, CASE WHEN net_pct > 5 THEN 'bullish' WHEN net_pct < -5 THEN 'bearish' ELSE 'neutral' END AS signal FROM br)"""


def _holdings(spark, sf):
    li, part = D.table(spark, sf, "lineitem"), D.table(spark, sf, "part")
    q = lambda f: F.sum(F.when(c("l_returnflag") == f, c("l_quantity")).otherwise(0.0))
    t = li.join(part, li.l_partkey == part.p_partkey).select(
        c("p_brand").alias("symbol"), F.trunc("l_shipdate", "month").alias("date"), c("l_suppkey").alias("broker"), "l_returnflag", "l_quantity")
    # nearly every trade is a group of its own: nothing combines before the shuffle, so tasks of bounded size do it after
    return spread(t, "symbol", "date", "broker", rows=500_000, like=li).groupBy("symbol", "date", "broker").agg(q("N").alias("long_hld"), q("R").alias("short_hld"))


@query("d21_broker_positions", "symbol:s date:d long_total:f2 short_total:f2 top_long:f2 top_short:f2 net_pct:f6 signal:s", HLD + "," + BRK + "\n---\nSELECT * FROM bro")
def brokers(spark, sf):
    return V.broker_positions(_holdings(spark, sf))


NMB = """
nb0 AS (SELECT symbol, date, sum(CASE WHEN broker = 1 THEN long_hld - short_hld ELSE 0 END) AS named_net, sum(CASE WHEN broker = 1 THEN 0 ELSE long_hld - short_hld END) AS others_net FROM hl GROUP BY 1, 2),
nb1 AS (SELECT *, named_net - lag(named_net) OVER w AS nc, others_net - lag(others_net) OVER w AS oc FROM nb0 WINDOW w AS (PARTITION BY symbol ORDER BY date)),
nb AS (SELECT *, sum(nc) OVER (w ROWS 4 PRECEDING) AS named_chg5, sum(oc) OVER (w ROWS 4 PRECEDING) AS others_chg5 FROM nb1 WINDOW w AS (PARTITION BY symbol ORDER BY date))"""


@query("d22_named_broker", "symbol:s date:d named_net:f2 others_net:f2 named_chg5:f2 others_chg5:f2 agreement:s", HLD + "," + NMB + """
---
SELECT *, CASE WHEN named_chg5 > 0 AND others_chg5 > 0 THEN 'both_bullish' WHEN named_chg5 < 0 AND others_chg5 < 0 THEN 'both_bearish' WHEN named_chg5 > 0 AND others_chg5 < 0 THEN 'named_bullish' WHEN named_chg5 < 0 AND others_chg5 > 0 THEN 'named_bearish' ELSE 'flat' END AS agreement FROM nb""")
def named(spark, sf):
    return V.named_broker(_holdings(spark, sf), 1)


@query("d23_futures_score", "symbol:s date:d score:i", FUT + "," + FST + "," + BAS + "," + HLD + "," + BRK + "," + NMB + """
---
SELECT symbol, date, greatest(0, least(100, 50 + CASE trend WHEN 'bull' THEN 15 WHEN 'bear' THEN -15 ELSE 0 END + CASE WHEN pct_chg > 0 THEN 5 WHEN pct_chg < 0 THEN -5 ELSE 0 END + CASE basis_signal WHEN 'premium' THEN 10 WHEN 'discount' THEN -10 ELSE 0 END
  + CASE signal WHEN 'bullish' THEN 10 WHEN 'bearish' THEN -10 ELSE 0 END + CASE WHEN named_chg5 > 0 THEN 5 WHEN named_chg5 < 0 THEN -5 ELSE 0 END)) AS score FROM fst JOIN bas USING (symbol, date) JOIN bro USING (symbol, date) JOIN nb USING (symbol, date)""")
def futures_score(spark, sf):
    k = ["symbol", "date"]
    d = (price_state(spark, sf).select(*k, "trend", "pct_chg").join(_basis(spark, sf).select(*k, "basis_signal"), k)
         .join(brokers(spark, sf).select(*k, "signal"), k).join(named(spark, sf).select(*k, "named_chg5"), k))
    return V.futures_score(d)


LNK = FUT + "," + FST + "," + BAS + "," + OPT + "," + PCR + "," + IVM + """,
lk AS (SELECT symbol, date, pcr_vol, pcr_oi, weighted_iv, risk_reversal, atm_gap, trend, pct_chg, oi_chg, basis_signal FROM fst JOIN bas USING (symbol, date) JOIN pcr USING (symbol, date) JOIN im USING (symbol, date)),
lr AS (SELECT *, unnest(['pcr_trend', 'iv_move', 'skew_basis', 'atm_gap_oi', 'oi_pcr_basis']) AS rule, unnest([CASE WHEN pcr_vol > 1.2 AND trend = 'bear' THEN -2 WHEN pcr_vol < 0.8 AND trend = 'bull' THEN 2 ELSE 0 END,
  CASE WHEN (weighted_iv IS NULL OR weighted_iv > 30) AND coalesce(pct_chg, 0) < -1 THEN -1 WHEN (weighted_iv IS NULL OR weighted_iv > 30) AND coalesce(pct_chg, 0) > 1 THEN 0 WHEN weighted_iv < 18 AND trend = 'bull' THEN 1 ELSE 0 END,
  CASE WHEN risk_reversal > 0.5 AND basis_signal = 'discount' THEN -2 WHEN risk_reversal < -0.5 AND basis_signal = 'premium' THEN 2 ELSE 0 END,
  CASE WHEN atm_gap > 1.5 AND oi_chg > 0 THEN -1 WHEN atm_gap < -1.5 AND oi_chg > 0 THEN 1 ELSE 0 END, CASE WHEN pcr_oi > 1 AND basis_signal = 'discount' THEN -1 WHEN pcr_oi < 0.7 AND basis_signal = 'premium' THEN 1 ELSE 0 END]) AS points FROM lk)"""


def _linkage(spark, sf):
    k = ["symbol", "date"]
    d = (price_state(spark, sf).select(*k, "trend", "pct_chg", "oi_chg").join(_basis(spark, sf).select(*k, "basis_signal"), k)
         .join(pcr(spark, sf).select(*k, "pcr_vol", "pcr_oi"), k).join(_ivm(spark, sf).select(*k, "weighted_iv", "risk_reversal", "atm_gap"), k))
    return V.linkage_rules(d)


@query("d24_linkage_rules", "symbol:s date:d rule:s points:i", LNK + "\n---\nSELECT * FROM lr")
def linkage(spark, sf):
    return _linkage(spark, sf)


@query("d25_linkage_score", "symbol:s date:d points:i score:f0 direction:s divergence:f0 divergence_level:s", LNK + """,
lp AS (SELECT symbol, date, any_value(pcr_vol) AS pcr_vol, any_value(risk_reversal) AS rr, any_value(weighted_iv) AS wi, any_value(trend) AS trend, any_value(basis_signal) AS bsg, sum(points) AS points FROM lr GROUP BY 1, 2),
lc AS (SELECT *, greatest(0, least(100, round_even(50e0 + CASE WHEN pcr_vol < 0.8 THEN 8 WHEN pcr_vol > 1.2 THEN -8 ELSE 0 END + CASE WHEN rr < -0.5 THEN 6 WHEN rr > 0.5 THEN -6 ELSE 0 END + CASE WHEN wi > 30 THEN -6 ELSE 0 END + CASE trend WHEN 'bull' THEN 10 WHEN 'bear' THEN -10 ELSE 0 END
  + CASE bsg WHEN 'premium' THEN 5 WHEN 'discount' THEN -5 ELSE 0 END + points * 2.5, 0))) AS score FROM lp),
ld AS (SELECT *, max(score) OVER (PARTITION BY date) - min(score) OVER (PARTITION BY date) AS divergence FROM lc)
---
SELECT *, CASE WHEN points <= -3 THEN 'bearish' WHEN points >= 3 THEN 'bullish' WHEN points <= -1 THEN 'slightly_bearish' WHEN points >= 1 THEN 'slightly_bullish' ELSE 'neutral' END AS direction,
  CASE WHEN divergence > 25 THEN 'high' WHEN divergence > 10 THEN 'medium' ELSE 'low' END AS divergence_level FROM ld""")
def linkage_score(spark, sf):
    return V.linkage_score(_linkage(spark, sf))
