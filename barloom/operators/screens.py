"""Stock screens: universe -> features -> gates -> score -> top n, for any set of dates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.ranking import quantiles
from barloom.functions.recursive import span, with_recursions
from barloom.functions.windows import Series, clamp, ladder, ratio

c = F.col
S = Series(("code",), ("date",))


def merge_daily(basic: DataFrame, price: DataFrame, master: DataFrame) -> DataFrame:
    """Fundamentals with price and master columns; special-treatment names and the excluded exchange dropped."""
    d = basic.join(price, ["code", "date"], "left").join(master, "code", "left")
    return d.where(~F.coalesce(c("name").rlike("ST"), F.lit(False)) & ~F.coalesce(c("exchange") == "BJ", F.lit(False)))


def cap_filter(df: DataFrame, band: str) -> DataFrame:
    """large >= 5,000,000, mid 1,000,000..5,000,000, small <= 1,000,000 (ten thousands)."""
    m = c("total_mv")
    return df.where({"all": F.lit(True), "large": m >= 5e6, "mid": (m >= 1e6) & (m <= 5e6), "small": m <= 1e6}[band])


def nearest_earlier(wanted: DataFrame, available: DataFrame, back: int = 5) -> DataFrame:
    """Latest available date within ``back`` days: each wanted date is expanded to its candidates (equi-join)."""
    cand = wanted.select("date", F.explode(F.sequence(F.lit(0), F.lit(back))).alias("_k")).withColumn("day", F.date_sub("date", c("_k")))
    hit = cand.join(available.select(c("date").alias("day")).distinct(), "day")
    return wanted.join(hit.groupBy("date").agg(F.max("day").alias("used")), "date", "left")


def top_by(df: DataFrame, n: int, score: str = "score", by: Sequence[str] = ("date",)) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(F.desc(score), "code")
    return df.withColumn("place", F.row_number().over(w)).where(c("place") <= n)


def momentum_breakthrough(day: DataFrame, ratio_min: float = 1.5) -> DataFrame:
    """.30 move + .25 turnover + .20 up-trend + .15 break-out + .10 relative strength."""
    p, t = F.coalesce("pct_chg", F.lit(0.0)), F.coalesce("turnover_rate", F.lit(0.0))
    rps = clamp(F.when(p > 5, p * 2 + 80).otherwise(p * 4 + 60), 0.0, 100.0)
    s = ((clamp(p, -10.0, 10.0) * 5 + 50) * 0.30 + F.least(t, F.lit(20.0)) * 5 * 0.25 + F.when(p > 0, 100.0).otherwise(0.0) * 0.20
         + F.when((p > 2) & (t >= ratio_min), 100.0).otherwise(0.0) * 0.15 + rps * 0.10)
    return day.withColumn("score", F.round(s, 4))


def technical_breakthrough(bars: DataFrame, rsi_min: float = 30, rsi_max: float = 80, threshold: float = 60) -> DataFrame:
    """RSI, MACD, EMA, Bollinger and volume ratio per bar, weighted .20/.25/.20/.20/.15.

    Every bar is scored; a cheap pre-cut would change the result and is not needed here.
    """
    from barloom.operators import indicators as I

    d = I.gain_loss(I.base_columns(bars))
    d = with_recursions(d, I.MACD + I.rsi_recursion(14) + [("e20", "ema", "close", span(20)), ("e50", "ema", "close", span(50))])
    up, mid, lo = I.bollinger()
    d = d.select("*", I.wilder_rsi(14).alias("rsi"), up.alias("_u"), lo.alias("_l"), mid.alias("_m"), ((ratio("close", "pc") - 1) * 100).alias("pct_chg"),
                 F.coalesce(ratio("volume", I.S.mean("volume", 20, skip=1)), F.lit(1.0)).alias("volume_ratio"), I.S.lag("dif").alias("_pd"), I.S.lag("dea").alias("_pe"))
    turn = c("volume") / 10
    rsi_s = F.when(c("rsi").isNull(), 50.0).otherwise(F.greatest(F.lit(0.0), (c("rsi") - 30) * 1.43))
    macd_s = ladder(((c("dif") > c("dea")) & (c("_pd") <= c("_pe")), 100.0), (c("dif") > c("dea"), 70.0), (c("dif") > 0, 50.0), default=20.0)
    trend_s = F.lit(50.0) + F.when(c("close") > c("e20"), 30.0).otherwise(0.0) + F.when(c("close") > c("e50"), 20.0).otherwise(0.0)
    boll = F.coalesce(clamp(ratio(c("close") - c("_l"), c("_u") - c("_l")) * 100, 0.0, 100.0), F.lit(50.0))
    brk = F.least(F.lit(100.0), boll + clamp((c("volume_ratio") - 1) * 15, 0.0, 30.0))
    s = rsi_s * 0.20 + macd_s * 0.25 + F.least(F.lit(100.0), turn * 6.67) * 0.20 + trend_s * 0.20 + brk * 0.15
    gate = c("rsi").isNull() | c("rsi").between(rsi_min, rsi_max)
    return d.where(gate & (c("i") >= 4)).select("code", "ts", "rsi", "volume_ratio", s.alias("score"), (s >= threshold).alias("breakthrough"))


def oversold_rebound(day: DataFrame, rsi_min: float = 10, rsi_max: float = 50, turnover_min: float = 0.5) -> DataFrame:
    """20 + drop x2 + turnover over the day's median x3 + 10/5 for a small move; RSI and turnover gates."""
    med = quantiles(day, ("date",), "turnover_rate", {"_med": 0.5})
    d = day.join(med, "date")
    p = F.coalesce("pct_chg", F.lit(0.0))
    vol = c("turnover_rate") / F.greatest("_med", F.lit(0.1))
    s = (F.greatest(-p, F.lit(0.0)) * 2 + 20 + F.greatest(vol - 1, F.lit(0.0)) * 3 + ladder((p > 0, 10.0), (p > -3, 5.0), default=0.0))
    d = d.withColumn("score", F.least(s, F.lit(100.0)))
    gate = (c("rsi").isNull() | c("rsi").between(rsi_min, rsi_max)) & (c("turnover_rate") >= turnover_min)
    return d.where(gate).withColumn("rebound", c("score") >= 40).drop("_med")


def limit_streaks(daily: DataFrame, limit_pct: float) -> DataFrame:
    """Consecutive limit-up days per code (islands) and days that opened inside the limit."""
    hit = F.coalesce(c("pct_chg") >= limit_pct, F.lit(False))
    d = daily.withColumn("_hit", hit).withColumn("_i", S.idx())
    d = d.withColumn("_miss", F.max(F.when(~c("_hit"), c("_i"))).over(S.run()))
    return d.withColumn("limit_times", c("_i") - F.coalesce("_miss", F.lit(0))).drop("_hit", "_i", "_miss")


def limit_up_leaders(rows: DataFrame, times=(1, 10), max_open: int = 3, turnover=(0.0, 1e9)) -> DataFrame:
    d = rows.where(c("limit_times").between(*times) & (c("open_times") <= max_open) & c("turnover_rate").between(*turnover))
    return d.withColumn("score", c("limit_times") * 10.0).withColumn("is_leader", (c("limit_times") >= 3) & (c("open_times") <= 1))


def last_period_means(st: DataFrame, cols: Sequence[str], n: int = 8, prefix: str = "avg_") -> DataFrame:
    """Mean of the last n non-missing periods' rows per code, with the period count."""
    w = Window.partitionBy("code").orderBy(F.desc("end_date"))
    d = st.withColumn("_r", F.row_number().over(w))
    return d.groupBy("code").agg(*[F.avg(F.when(c("_r") <= n, c(x))).alias(f"{prefix}{x}") for x in cols], F.count(F.lit(1)).alias("periods"))


def value_investment(d: DataFrame, gates: Mapping[str, float]) -> DataFrame:
    """Hard gates, then profitability 20 + quality 25 + safety 20 + valuation 15."""
    ok = ((c("pe") > 0) & (c("pe") <= gates["pe_max"]) & (c("pb") > 0) & (c("pb") <= gates["pb_max"]) & (c("periods") >= 4) & (c("avg_roe") >= gates["roe"])
          & (c("avg_current_ratio") >= gates["current"]) & (c("avg_debt_ratio") <= gates["debt"]) & (c("avg_profit_growth") >= gates["growth"])
          & (c("avg_gross_margin") >= gates["gross"]) & (c("avg_net_margin") >= gates["net"]))
    s = (F.least(c("avg_roe") / 15, F.lit(2.0)) * 20 + (F.least(c("avg_gross_margin") / 30, F.lit(1.5)) * 0.6 + F.least(c("avg_net_margin") / 10, F.lit(2.0)) * 0.4) * 25
         + (F.greatest(1 - c("avg_debt_ratio") / 100, F.lit(0.0)) * 0.7 + F.least(c("avg_current_ratio") / 2, F.lit(1.0)) * 0.3) * 20
         + (F.greatest(1 - c("pe") / 50, F.lit(0.0)) * 0.6 + F.greatest(1 - c("pb") / 6, F.lit(0.0)) * 0.4) * 15)
    return d.where(ok).withColumn("score", s)


def growth_stock(d: DataFrame, gates: Mapping[str, float]) -> DataFrame:
    """One of two growth gates, two of three profit gates, safety gates, PEG and score."""
    at = lambda x, k: F.when(c(x) >= gates[k], 1).otherwise(0)
    growth = (c("avg_eps_growth") >= gates["eps_growth"]) | (c("avg_revenue_growth") >= gates["revenue_growth"])
    profit = at("avg_roic", "roic") + at("avg_gross_margin", "gross") + at("avg_net_margin", "net") >= 2
    safe = (c("avg_debt_ratio") < gates["debt"]) & (c("avg_quick_ratio") > gates["quick"]) & c("pe").isNotNull() & c("pb").isNotNull()
    peg = F.least(F.greatest("pe", F.lit(0.01)) / F.greatest(F.coalesce("eps_growth_4q", F.lit(0.0)), F.lit(0.01)), F.lit(999.0))
    x = d.where(growth & profit & safe).withColumn("peg", peg)
    cap = lambda k, m: F.least(c(k), F.lit(float(m)))
    s = (cap("avg_eps_growth", 50) * 0.4 + cap("avg_revenue_growth", 50) * 0.4 + cap("avg_roic", 25) * 0.7 + cap("avg_gross_margin", 80) * 0.25 + cap("avg_net_margin", 40) * 0.5
         + F.when(c("avg_debt_ratio") < 50, 5).otherwise(0) + F.when(c("avg_quick_ratio") > 1.2, 5).otherwise(0) + F.when(c("peg").between(gates["peg_min"], gates["peg_max"]), 10).otherwise(0))
    return x.withColumn("score", s)


def high_dividend(d: DataFrame, gates: Mapping[str, float]) -> DataFrame:
    """Yield, payout, dividend over financing, criteria and score."""
    y = F.when((c("cash_div") > 0) & (c("close") > 0), c("cash_div") / c("close") * 100).otherwise(0.0)
    pay = F.when((c("dividend_paid") > 0) & (c("net_profit") > 0), F.least(F.lit(100.0), c("dividend_paid") / c("net_profit") * 100)).otherwise(0.0)
    fin = F.when((c("dividend_paid") > 0) & (c("financing_in") > 0), F.least(F.lit(200.0), c("dividend_paid") / c("financing_in") * 100)).otherwise(0.0)
    x = d.select("*", y.alias("dividend_yield"), pay.alias("payout_ratio"), fin.alias("dividend_financing"))
    ok = (c("eps") > gates["eps"]) & (c("mv_yi") >= gates["mv"]) & (c("dividend_yield") >= gates["yield"]) & (c("pe") > 0) & (c("pe") < gates["pe"]) & (c("pb") > 0) & (c("pb") < gates["pb"])
    s = (c("dividend_yield") * 8 + F.least(c("roe"), F.lit(20.0)) * 2 + F.least(c("mv_yi") / 10, F.lit(10.0))
         + F.when(c("payout_ratio") > 20, F.least(c("payout_ratio") / 5, F.lit(10.0))).otherwise(0.0) + 20)
    return x.where(ok).withColumn("score", s)


def latest_valid(rows: DataFrame, value: str, key: str = "code", order: str = "end_date") -> DataFrame:
    """Latest row per key whose value is present."""
    return rows.where(c(value).isNotNull()).groupBy(key).agg(F.max_by(value, order).alias(value), F.max(order).alias(order))


def fund_flow(margin: DataFrame, days: int = 90, buy_min: float = 10.0) -> DataFrame:
    """(code, date, rzmre, rzye): every date of the last ``days`` days; last two against first two means; .6/.4 composite gate."""
    last = margin.agg(F.max("date")).first()[0]     # one value
    m = margin.where(c("date") > F.date_sub(F.lit(last), days))
    up, dn = Window.partitionBy("code").orderBy("date"), Window.partitionBy("code").orderBy(F.desc("date"))
    m = m.select("*", F.row_number().over(up).alias("_a"), F.row_number().over(dn).alias("_z"))

    def growth(x):
        first, last = F.avg(F.when(c("_a") <= 2, c(x))), F.avg(F.when(c("_z") <= 2, c(x)))
        return F.when((F.count(F.lit(1)) >= 4) & (first > 0), (last / first - 1) * 100)

    g = m.groupBy("code").agg(growth("rzmre").alias("buy_trend"), growth("rzye").alias("balance_growth"))
    comp = F.coalesce("buy_trend", F.lit(0.0)) * 0.6 + F.coalesce("balance_growth", F.lit(0.0)) * 0.4
    g = g.withColumn("composite", comp).where(c("composite") >= buy_min * 0.6)
    return g.withColumn("score", clamp(c("composite") * 2 + 50, 0.0, 100.0))


def rank_by_strategies(scores: DataFrame, n: int = 10) -> DataFrame:
    """(code, strategy, score): mean over the strategies, top n."""
    g = scores.groupBy("code").agg(F.avg("score").alias("total"), F.count(F.lit(1)).alias("strategies"))
    return g.orderBy(F.desc(F.round("total", 6)), "code").limit(n)


# Operators of a structured filter.
_OPS = {">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, "=": lambda a, b: a == b}


def structured_screen(df: DataFrame, filters: Sequence[tuple], include: Sequence[str] = (), exclude: Sequence[str] = (), sort: str | None = None,
                      descending: bool = True, n: int | None = None) -> DataFrame:
    """Filters are (field, op, value) or (field, "between", (lo, hi)); unknown fields or operators raise."""
    for f, op, v in filters:
        if f not in df.columns:
            raise ValueError(f"unknown field {f}")
        if op == "between":
            df = df.where(c(f).between(*v))
        elif op in _OPS:
            df = df.where(_OPS[op](c(f), v))
        else:
            raise ValueError(f"unknown operator {op}")
    if include:
        df = df.where(c("sector").isin(*include))
    if exclude:
        df = df.where(~c("sector").isin(*exclude))
    if sort:
        df = df.orderBy(F.desc(sort) if descending else F.asc(sort), "code")
    return df.limit(n) if n else df


def reporting_periods(dates: DataFrame, n: int = 8) -> DataFrame:
    """The last n quarter ends on or before each date."""
    q = F.trunc("date", "quarter")
    ends = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.date_sub(F.add_months(q, (-k * 3).cast("int")), 1))
    return dates.select("date", F.posexplode(ends).alias("k", "period_end"))
