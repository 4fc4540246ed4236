"""Convertible bonds, funds and industries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.ranking import quantiles
from barloom.functions.solvers import bond_yield
from barloom.functions.windows import Series, clamp, ladder, ratio

c = F.col


def conversion_values(bonds: DataFrame) -> DataFrame:
    """Conversion value 100/conv_price x stock, premium %, price + premium."""
    d = bonds.where(c("stock_price") > 0).withColumn("conv_value", ratio(F.lit(100.0), "conv_price") * c("stock_price"))
    d = d.withColumn("premium", (c("price") / c("conv_value") - 1) * 100)
    return d.withColumn("double_low", c("price") + c("premium"))


def market_statistics(v: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Means, exact median and price-band counts; the median never gathers a group in one task."""
    keys = list(by) or ["_all"]
    d = v if by else v.withColumn("_all", F.lit(1))
    band = lambda x: F.sum(x.cast("int"))
    p = c("price")
    g = d.groupBy(*keys).agg(
        F.avg("price").alias("avg_price"), F.avg("premium").alias("avg_premium"), F.avg("double_low").alias("avg_double_low"),
        band(p < 100).alias("lt100"), band((p >= 100) & (p < 120)).alias("b100_120"), band((p >= 120) & (p < 150)).alias("b120_150"), band(p >= 150).alias("ge150"))
    return g.join(quantiles(d, keys, "price", {"median_price": 0.5}), keys).drop("_all")


def market_size(bonds: DataFrame, first: Column, last: Column) -> DataFrame:
    """Alive count and remaining size on ``last``; bonds listed and delisted inside [first, last]."""
    alive = (c("list_date") <= last) & (c("delist_date").isNull() | (c("delist_date") > last))
    return bonds.agg(F.sum(alive.cast("int")).alias("alive"), F.sum(F.when(alive, c("remain_size")).otherwise(0.0)).alias("remaining"),
                     F.sum(c("list_date").between(first, last).cast("int")).alias("listed"),
                     F.sum(F.coalesce(c("delist_date").between(first, last), F.lit(False)).cast("int")).alias("delisted"))


def weekly_score(w: DataFrame) -> DataFrame:
    """(week_pct, premium_chg, double_low, amount_yi) -> 50 +- components, direction."""
    s = (F.lit(50) + ladder((c("week_pct") >= 1, 15), (c("week_pct") <= -1, -15), default=0) + ladder((c("premium_chg") > 2, -10), (c("premium_chg") < -2, 10), default=0)
         + ladder((c("double_low") < 130, 8), (c("double_low") > 160, -8), default=0) + ladder((c("amount_yi") >= 150, 8), (c("amount_yi") < 80, -8), default=0))
    return w.withColumn("score", F.greatest(F.lit(0), F.least(F.lit(100), s))).withColumn(
        "direction", ladder((c("score") >= 58, "bullish"), (c("score") <= 42, "bearish"), default="mixed"))


# Text form of one coupon segment.
COUPON_PATTERN = r"(\d{8})-(\d{8}),票面利率:([\d.]+)%"


def coupon_schedule(bonds: DataFrame) -> DataFrame:
    """One row per coupon segment found in the clause text."""
    part = lambda g: F.regexp_extract_all("rate_clause", F.lit(COUPON_PATTERN), F.lit(g))
    seg = F.arrays_zip(part(1).alias("s"), part(2).alias("e"), part(3).alias("r"))
    d = bonds.select("code", F.explode(seg).alias("x"))
    return d.select("code", F.to_date("x.s", "yyyyMMdd").alias("seg_start"), F.to_date("x.e", "yyyyMMdd").alias("seg_end"), c("x.r").cast("double").alias("rate"))


def yield_to_maturity(bonds: DataFrame, asof: Column, par: float = 100.0) -> DataFrame:
    """Annual coupons at the segment ends after ``asof`` plus par at maturity; null if matured."""
    part = lambda g: F.regexp_extract_all("rate_clause", F.lit(COUPON_PATTERN), F.lit(g))
    years = lambda d: F.datediff(d, asof) / 365.25
    flows = F.transform(F.arrays_zip(part(2).alias("e"), part(3).alias("r")),
                        lambda x: F.struct(years(F.to_date(x["e"], "yyyyMMdd")).alias("t"), (x["r"].cast("double") * (par / 100)).alias("f")))
    flows = F.concat(F.filter(flows, lambda x: x["t"] > 0), F.array(F.struct(years(c("maturity_date")).alias("t"), F.lit(par).alias("f"))))
    d = bonds.withColumn("_f", flows)
    y = bond_yield(F.transform("_f", lambda x: x["t"]), F.transform("_f", lambda x: x["f"]), c("price"))
    return d.withColumn("ytm", F.when((c("maturity_date") > asof) & (c("price") > 0), y)).drop("_f")


# ---- scoring -------------------------------------------------------------------------------------

def _floor(lo: float, x: Column) -> Column:
    return F.greatest(F.lit(lo), x)


def six_dimension_score(b: DataFrame) -> DataFrame:
    """25/20/20/10/15/10 over basics, stock, protection, time, trading and arbitrage ladders."""
    pr, y = c("premium"), c("ytm_pct")
    s_prem = ladder((pr < 0, 100.0), (pr < 10, 100 - pr), (pr < 20, 110 - pr * 2), (pr < 40, 80 - pr), default=_floor(0.0, 80 - pr))
    s_ytm = ladder((y > 5, 100.0), (y > 0, 70 + y * 6), (y > -10, 60 + y * 3), default=_floor(0.0, 30 + y))
    pe, pb, ch = c("pe"), c("pb"), c("stock_chg")
    s_pe = ladder(((pe >= 10) & (pe <= 30), 85.0), ((pe > 0) & (pe < 10), 75.0), ((pe > 30) & (pe <= 50), 60.0), (pe > 50, _floor(20.0, 110 - pe)), default=50.0)
    s_pb = ladder(((pb >= 0.5) & (pb <= 3), 80.0), ((pb > 0) & (pb < 0.5), 60.0), (pb > 3, _floor(30.0, 75 - pb * 5)), default=50.0)
    s_ch = ladder((ch > 5, 90.0), (ch > 0, 70 + ch * 4), (ch > -5, 50 + ch * 4), default=_floor(20.0, 50 + ch * 3))
    # Points per credit rating.
    ratings = {"AAA": 100.0, "AA+": 90.0, "AA": 80.0, "AA-": 70.0, "A+": 55.0, "A": 45.0}
    s_rate = ladder(*[(c("credit") == k, v) for k, v in ratings.items()], default=50.0)
    s_down, rd = F.when(c("has_downrev"), 90.0).otherwise(50.0), c("redeem_price")
    s_red = ladder((rd >= 110, 80.0), (rd >= 105, 65.0), default=50.0)
    t = c("years_left")
    s_time = ladder(((t >= 1) & (t <= 3), 90.0), ((t >= 0.5) & (t < 1), 70.0), ((t > 3) & (t <= 5), 100 - t * 10), (t > 5, _floor(30.0, 75 - t * 5)),
                    ((t > 0) & (t < 0.5), 50 + t * 40), default=50.0)
    am, tn = c("amount"), c("turnover")
    s_am = ladder((am > 5e8, 75.0), (am > 1e8, 85.0), (am > 5e7, 70.0), (am > 0, 60.0), default=50.0)
    s_tn = ladder(((tn >= 5) & (tn <= 30), 80.0), (tn > 30, _floor(40.0, 140 - tn * 2)), (tn > 0, 50 + tn * 2), default=50.0)
    dl = c("double_low")
    s_arb = ladder((pr < 0, 100.0), (pr < 5, 90.0), (pr < 15, 100 - pr * 2), (pr < 30, 80 - pr), default=_floor(20.0, 80 - pr))
    s_dl = ladder(((dl > 0) & (dl < 130), 85.0), ((dl > 0) & (dl < 150), 70.0), (dl > 0, _floor(30.0, 145 - dl * 0.5)), default=50.0)
    d = b.select("*", (s_prem * 0.7 + s_ytm * 0.3).alias("basic"), (s_pe * 0.35 + s_pb * 0.25 + s_ch * 0.40).alias("stock"),
                 (s_rate * 0.5 + s_down * 0.3 + s_red * 0.2).alias("protection"), s_time.alias("time"), (s_am * 0.5 + s_tn * 0.5).alias("trading"),
                 (s_arb * 0.7 + s_dl * 0.3).alias("arbitrage"))
    total = c("basic") * 0.25 + c("stock") * 0.20 + c("protection") * 0.20 + c("time") * 0.10 + c("trading") * 0.15 + c("arbitrage") * 0.10
    return d.withColumn("composite", total).withColumn("advice", ladder(
        (c("composite") >= 80, "strong_buy"), (c("composite") >= 65, "buy"), (c("composite") >= 50, "watch"), default="avoid"))


def compare(scored: DataFrame, group: str) -> DataFrame:
    """Place of every bond inside its group by composite."""
    w = Window.partitionBy(group).orderBy(F.desc(F.round("composite", 9)), "code")
    return scored.withColumn("place", F.row_number().over(w))


# ---- dashboard -----------------------------------------------------------------------------------

B = Series(("code",), ("date",))


def trigger_days(daily: DataFrame, m: int = 30, n: int = 15, level: float = 1.30) -> DataFrame:
    """(code, date, close, conv_price): days of the last m with the stock at or above level x conversion price; null before m days."""
    hit = (c("close") >= c("conv_price") * level).cast("int")
    d = daily.withColumn("days", F.when(B.idx() >= m, F.sum(hit).over(B.trail(m))))
    return d.withColumn("state", ladder((c("days") >= n, "triggered"), (c("days") >= n - 5, "approaching"), default="not_triggered"))


def down_revision_days(daily: DataFrame, m: int = 30, n: int = 15, level: float = 0.85) -> DataFrame:
    """Days below the revision level (null before m days); remaining days to n, high priority at 5 or fewer."""
    hit = (c("close") < c("conv_price") * level).cast("int")
    d = daily.withColumn("days", F.when(B.idx() >= m, F.sum(hit).over(B.trail(m))))
    left = F.when(c("days").isNotNull(), F.greatest(F.lit(n) - c("days"), F.lit(0)))
    return d.withColumn("remaining", left).withColumn("high_priority", F.coalesce(c("remaining") <= 5, F.lit(False)))


def smallest(df: DataFrame, by: str, n: int = 10) -> DataFrame:
    return df.orderBy(by, "code").limit(n)


def limit_hit_bonds(stocks: DataFrame, bonds: DataFrame) -> DataFrame:
    """Bonds whose stock (stk_code, side) is at its limit."""
    return bonds.join(stocks.where(c("side").isNotNull()).select("stk_code", "side"), "stk_code")


def listed_anomaly_bonds(bonds: DataFrame, listed: DataFrame) -> DataFrame:
    return bonds.join(listed.select("stk_code").distinct(), "stk_code", "left_semi")


def issuance_pipeline(issues: DataFrame, done: str) -> DataFrame:
    return issues.where(c("stage") != done).groupBy("stage").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"))


def top_lists(v: DataFrame, lists: dict[str, tuple[str, bool]], n: int = 10) -> DataFrame:
    """Several top-n lists in one pass: name -> (column, descending)."""
    long = v.unpivot(["code"], [x for x, _ in lists.values()], "metric", "value").where(c("value").isNotNull())
    key = ladder(*[(c("metric") == col, -c("value") if desc else c("value")) for col, desc in lists.values()])
    w = Window.partitionBy("metric").orderBy("_k", "code")
    return long.withColumn("_k", key).withColumn("place", F.row_number().over(w)).where(c("place") <= n).drop("_k")


def dashboard_labels(v: DataFrame) -> DataFrame:
    """Every per-bond measure and label of the dashboard in one projection."""
    floor_pct = F.when((c("price") > 0) & (c("pure_bond") > 0), (c("pure_bond") / c("price") - 1) * 100).otherwise(0.0)
    cushion = (ratio("stock_price", "conv_price") - 1) * 100
    intrinsic = F.greatest("conv_value", "pure_bond")
    tv = c("price") - intrinsic
    mat = (ratio("redeem_price", "price") - 1) * 100
    arb = (ratio("conv_value", "price") - 1) * 100
    d = v.select("*", cushion.alias("cushion_pct"), floor_pct.alias("floor_pct"), tv.alias("time_value"), (ratio(tv, "price") * 100).alias("time_value_pct"),
                 mat.alias("maturity_pct"), arb.alias("arb_pct"))
    high_floor = c("floor_pct") > 10
    rate = c("credit")
    return d.select(
        "*",
        ladder((high_floor & (c("equity_ratio") > 10), "high"), (c("floor_pct") > 0, "medium"), default="low").alias("safety"),
        ladder((c("years_left") < 1, "fast"), (c("years_left") < 2, "medium"), default="slow").alias("decay"),
        ladder((c("time_value_pct") > 20, "high"), (c("time_value_pct") > 5, "medium"), default="low").alias("option_level"),
        ladder((rate.startswith("AA") & (c("ytm_pct") > 2) & (c("floor_pct") > 5), "high"), (rate.startswith("A") & (c("ytm_pct") > 0), "medium"), default="low").alias("redeem_certainty"),
        ladder(((c("maturity_pct") > 5) & (c("ytm_pct") > 3), "discount"), (c("maturity_pct") > 0, "small_gain"), default="premium_risk").alias("opportunity"),
        ladder((c("premium") < 0, "discount"), (c("premium") < 10, "low"), (c("premium") < 30, "medium"), default="high").alias("premium_zone"),
        ladder(((c("amplitude") > 5) & (c("turnover") > 10) & (c("amount_yi") > 1), "prime"), ((c("amplitude") > 3) & (c("turnover") > 5), "suitable"), default="plain").alias("grid"),
        ladder(((c("turnover") > 100) | (F.abs("chg") > 10), "high"), ((c("turnover") > 50) | (F.abs("chg") > 5), "medium"), default="light").alias("abnormal"),
        ladder(((c("arb_pct") > 1) & (c("amount_yi") > 0.5), "executable"), (c("arb_pct") > 0.5, "watch"), default="none").alias("arbitrage_state"),
        ladder((c("stock_chg") > 0, "filling"), (c("stock_chg") < 0, "falling"), default="flat").alias("rights_state"))


def zone_counts(labels: DataFrame, col: str = "premium_zone") -> DataFrame:
    return labels.groupBy(col).agg(F.count(F.lit(1)).alias("n"), F.avg("premium").alias("avg_premium"))


# ---- funds ---------------------------------------------------------------------------------------

# Fund types and name words.
MONEY_TYPES = ["货币型", "货币市场型"]
COMMODITY_TYPES = ["黄金现货合约", "商品型", "能源化工期货型", "有色金属期货型", "豆粕期货型", "白银期货型", "原油主题基金", "原油期货型"]
COMMODITY_WORDS = ["黄金", "原油", "豆粕", "白银", "期货", "商品", "能源"]


def classify_fund(name: Column, invest_type: Column, wide: Sequence[str], cross: Sequence[str], money_types: Sequence[str] = tuple(MONEY_TYPES),
                  commodity_types: Sequence[str] = tuple(COMMODITY_TYPES), commodity_words: Sequence[str] = tuple(COMMODITY_WORDS)) -> Column:
    """First match: money, commodity, cross-border without broad words, broad, else sector."""
    has = lambda words: name.rlike("|".join(words))
    return ladder((invest_type.isin(*money_types), "money"), (invest_type.isin(*commodity_types) | has(commodity_words), "commodity"),
                  (has(cross) & ~has(wide), "cross_border"), (has(wide), "broad"), default="sector")


def share_changes(shares: DataFrame) -> DataFrame:
    """Change of the share count, forward in time."""
    p = B.lag("share")
    return shares.select("code", "date", "share", (c("share") - p).alias("change"), ((ratio("share", p) - 1) * 100).alias("change_pct"))


def fund_scale(daily: DataFrame, shares: DataFrame, nav: DataFrame, n: int = 30) -> DataFrame:
    """Mean amount of the last n rows; latest share times latest NAV."""
    w = Window.partitionBy("code").orderBy(F.desc("date"))
    amt = daily.withColumn("_r", F.row_number().over(w)).where(c("_r") <= n).groupBy("code").agg(F.avg("amount").alias("mean_amount"))
    sh = shares.groupBy("code").agg(F.max_by("share", "date").alias("share"))
    nv = nav.groupBy("code").agg(F.max_by("nav", "date").alias("nav"))
    return amt.join(sh, "code").join(nv, "code").withColumn("scale", c("share") * c("nav"))


def fund_returns(daily: DataFrame, days: Sequence[int]) -> DataFrame:
    """Return over each calendar window ending at the fund's latest date."""
    last = daily.groupBy("code").agg(F.max("date").alias("_l"))
    d = daily.join(last, "code")
    aggs = [F.max_by("close", "date").alias("close")]
    for n in days:
        inside = c("date") >= F.date_sub(c("_l"), n)
        aggs.append(F.min_by(F.when(inside, c("close")), F.when(inside, c("date"))).alias(f"_s{n}"))
    g = d.groupBy("code").agg(*aggs)
    return g.select("code", "close", *[((ratio("close", f"_s{n}") - 1) * 100).alias(f"ret{n}") for n in days])


def fund_screen(funds: DataFrame, kind: str, min_scale: float, min_change: float) -> DataFrame:
    return funds.where((c("kind") == kind) & (c("scale") >= min_scale) & (c("change_pct") >= min_change))


def class_summary(funds: DataFrame, n: int = 3) -> DataFrame:
    """Count, total scale and the n largest names per class."""
    w = Window.partitionBy("kind").orderBy(F.desc("scale"), "code")
    d = funds.withColumn("_r", F.row_number().over(w))
    top = d.where(c("_r") <= n).groupBy("kind").agg(F.concat_ws(",", F.transform(F.sort_array(F.collect_list(F.struct("_r", "name"))), lambda x: x["name"])).alias("top_names"))
    return d.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum("scale").alias("scale")).join(top, "kind")


def latest_records(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int = 10) -> DataFrame:
    """The n newest records per key (holdings, managers, dividends)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("place", F.row_number().over(w)).where(c("place") <= n)


# ---- industries ----------------------------------------------------------------------------------

def industry_overview(rows: DataFrame, n: int = 10) -> DataFrame:
    """(company, cap, industries array): companies and cap per industry, n largest by count."""
    d = rows.select("company", "cap", F.explode("industries").alias("industry"))
    g = d.groupBy("industry").agg(F.countDistinct("company").alias("companies"), F.sum("cap").alias("cap"))
    return g.orderBy(F.desc("companies"), "industry").limit(n)


def chain_nodes(rows: DataFrame, n: int = 5) -> DataFrame:
    """Per (stage, node): companies and the first n names in order (only n per node are gathered)."""
    names = rows.select("stage", "node", "company").distinct()
    w = Window.partitionBy("stage", "node").orderBy("company")
    first = names.withColumn("_r", F.row_number().over(w)).where(c("_r") <= n)
    top = first.groupBy("stage", "node").agg(F.concat_ws(",", F.sort_array(F.collect_list("company"))).alias("names"))
    return names.groupBy("stage", "node").agg(F.count(F.lit(1)).alias("companies")).join(top, ["stage", "node"])


def key_stocks(rows: DataFrame, n: int = 5) -> DataFrame:
    w = Window.partitionBy("industry").orderBy(F.desc("cap"), "code")
    return rows.withColumn("place", F.row_number().over(w)).where(c("place") <= n)
