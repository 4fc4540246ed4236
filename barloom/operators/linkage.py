"""Market-wide dimensions per date: each yields (date, score, bias) with its details."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.windows import ladder, ratio

c = F.col


def _bias(up: Column, down: Column) -> Column:
    return ladder((up, "bullish"), (down, "bearish"), default="neutral")


def _by_score() -> Column:
    return _bias(c("score") > 55, c("score") < 45)


def _clip(s: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(100), s))


def _day(order: str = "date"):
    """The calendar of a market-wide series: one row per date by now."""
    return Window.orderBy(order)


def capital_flow(flows: DataFrame) -> DataFrame:
    """(date, code, net) in ten thousands -> market net (hundreds of millions), counts, bands of 10 and 50."""
    g = flows.groupBy("date").agg((F.sum("net") / 1e4).alias("net_yi"), F.sum((c("net") > 0).cast("int")).alias("in_count"),
                                  F.sum((c("net") < 0).cast("int")).alias("out_count"))
    n = c("net_yi")
    return g.withColumn("score", ladder((n > 50, 75), (n > 10, 60), (n < -50, 25), (n < -10, 40), default=50)).withColumn("bias", _bias(n > 10, n < -10))


def top_flows(flows: DataFrame, n: int = 10, key: str = "code") -> DataFrame:
    """The n largest inflows and outflows per date."""
    agg = flows.groupBy("date", key).agg(F.sum("net").alias("net"))
    side = agg.where("net <> 0").withColumn("side", F.when(c("net") > 0, "in").otherwise("out"))
    w = Window.partitionBy("date", "side").orderBy(F.desc(F.abs("net")), key)
    return side.withColumn("place", F.row_number().over(w)).where(c("place") <= n)


def northbound(daily: DataFrame, n: int = 5, cap: int | None = None) -> DataFrame:
    """(date, net): latest flow, n-day sum, positive days, sign streak (at most ``cap`` if given), score."""
    w = _day()
    last = w.rowsBetween(-(n - 1), 0)
    d = daily.select("date", "net", (c("net") / 1e4).alias("net_yi"), (F.sum("net").over(last) / 1e4).alias("cum_yi"),
                     F.sum((c("net") > 0).cast("int")).over(last).alias("positive_days"), (c("net") > 0).alias("_up"), F.row_number().over(w).alias("_i"))
    d = d.withColumn("_turn", F.when(~c("_up").eqNullSafe(F.lag("_up").over(w)), c("_i")))
    streak = c("_i") - F.max("_turn").over(w.rowsBetween(Window.unboundedPreceding, 0)) + 1
    d = d.withColumn("streak", streak if cap is None else F.least(streak, F.lit(cap)))
    s = (F.lit(50) + ladder((c("net_yi") > 50, 18), (c("net_yi") > 0, 6), (c("net_yi") < -50, -18), (c("net_yi") < 0, -6), default=0)
         + F.when(c("cum_yi") > 0, 5).otherwise(-5) + F.when(c("streak") >= 3, F.when(c("net") > 0, 10).otherwise(-10)).otherwise(0))
    return d.withColumn("score", _clip(s)).withColumn("bias", _by_score())


def margin_trend(daily: DataFrame, n: int = 20) -> DataFrame:
    """(date, rzye): net change, change over n rows, MA5, score."""
    w = _day()
    first = F.first("rzye").over(w.rowsBetween(-(n - 1), 0))
    d = daily.select("date", "rzye", F.coalesce(c("rzye") - F.lag("rzye").over(w), F.lit(0.0)).alias("net"), ((ratio("rzye", first) - 1) * 100).alias("change_pct"),
                     F.avg("rzye").over(w.rowsBetween(-4, 0)).alias("ma5"))
    s = F.lit(50) + F.when(c("net") > 0, 12).otherwise(-12) + ladder((c("change_pct") > 1.5, 8), (c("change_pct") < -1.5, -8), default=0)
    return d.withColumn("trend", F.when(c("rzye") > c("ma5"), "up").otherwise("down")).withColumn("score", _clip(s)).withColumn("bias", _by_score())


def _votes(d: DataFrame, up: Column, down: Column, step: int) -> DataFrame:
    g = d.groupBy("date").agg(F.sum(up.cast("int")).alias("ups"), F.sum(down.cast("int")).alias("downs"))
    return g.withColumn("score", _clip(F.lit(50) + (c("ups") - c("downs")) * step)).withColumn("bias", _bias(c("ups") > c("downs"), c("ups") < c("downs")))


def futures_basis(contracts: DataFrame, index: DataFrame) -> DataFrame:
    """(variety, date, contract, vol, settle) and (variety, date, close): dominant contract's settle basis, votes at 0.3 %."""
    main = contracts.groupBy("variety", "date").agg(F.max_by("settle", F.struct("vol", "contract")).alias("settle"))
    j = main.join(index, ["variety", "date"]).where("close <> 0").withColumn("basis_rate", (c("settle") / c("close") - 1) * 100)
    return _votes(j, c("basis_rate") > 0.3, c("basis_rate") < -0.3, 10)


def option_sentiment(pcr: DataFrame) -> DataFrame:
    """(symbol, date, pcr_vol): calls busy under 0.7, puts busy over 1.3."""
    x = F.coalesce("pcr_vol", F.lit(1.0))
    return _votes(pcr, x < 0.7, x > 1.3, 8)


def etf_shares(rows: DataFrame, n: int = 20) -> DataFrame:
    """(code, date, share, close): share and price change over n rows, divergence label per fund."""
    w = Window.partitionBy("code").orderBy("date").rowsBetween(-n, 0)
    d = rows.select("code", "date", ((ratio("share", F.first("share").over(w)) - 1) * 100).alias("share_pct"),
                    ((ratio("close", F.first("close").over(w)) - 1) * 100).alias("price_pct"))
    s, p = c("share_pct"), c("price_pct")
    return d.withColumn("divergence", ladder(((s > 0) & (p < 0), "buying_dip"), ((s < 0) & (p > 0), "taking_profit"), ((s > 0) & (p > 0), "with_trend"),
                                             ((s < 0) & (p < 0), "leaving"), default="none"))


def etf_dimension(shares: DataFrame) -> DataFrame:
    return _votes(shares, c("share_pct") > 2, c("share_pct") < -2, 7)


def interbank(rates: DataFrame, tenors: list[str], n: int = 5) -> DataFrame:
    """(date, one column per tenor, %): mean change over n rows in basis points, 1Y - ON spread."""
    w = _day().rowsBetween(-n, 0)
    chg = [(c(t) - F.first(t).over(w)) * 100 for t in tenors]
    d = rates.select("date", (sum(chg[1:], chg[0]) / len(tenors)).alias("mean_bp"), (c(tenors[-1]) - c(tenors[0])).alias("spread"))
    return d.withColumn("flat_curve", c("spread") < 0.2).withColumn("score", ladder((c("mean_bp") < -2, 65), (c("mean_bp") > 2, 35), default=50)).withColumn(
        "bias", _bias(c("mean_bp") < -2, c("mean_bp") > 2))


def dragon_tiger(listed: DataFrame, inst: DataFrame) -> DataFrame:
    """(date, code) listed stocks and (date, code, net) institution trades."""
    n = listed.dropDuplicates(["date", "code"]).groupBy("date").agg(F.count(F.lit(1)).alias("list_count"))
    m = inst.groupBy("date", "code").agg(F.sum("net").alias("net")).groupBy("date").agg(F.sum("net").alias("inst_net"))
    d = n.join(m, "date", "full").fillna(0, ["list_count", "inst_net"])
    busy, x = c("list_count") > 20, c("inst_net")
    return d.withColumn("score", ladder((busy & (x > 0), 70), (x > 0, 60), (busy & (x < 0), 35), (x < 0, 40), default=50)).withColumn("bias", _bias(x > 0, x < 0))


def aggregate(dims: DataFrame, expected: int = 8, compat: bool = False) -> DataFrame:
    """(date, dim, score, bias) -> mean score, counts, sentiment. Missing dimensions are left out and show
    in ``coverage``; ``compat`` counts them as a neutral 50."""
    n = F.count("score")
    mean = (F.sum("score") + (expected - n) * 50) / expected if compat else F.avg("score")
    g = dims.groupBy("date").agg(mean.alias("avg_score"), F.sum((c("bias") == "bullish").cast("int")).alias("bulls"),
                                 F.sum((c("bias") == "bearish").cast("int")).alias("bears"), (n / expected).alias("coverage"))
    return g.withColumn("sentiment", ladder(((c("bulls") > c("bears")) & (c("avg_score") >= 58), "bullish"),
                                            ((c("bears") > c("bulls")) & (c("avg_score") <= 42), "bearish"), default="mixed"))
