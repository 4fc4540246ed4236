"""Bars: building, resampling, validity, calendar, refresh, roll-ups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.windows import Series, ratio, series


def trade_order(day_in_bar: Column, order_id: Column, line: Column) -> Column:
    """Total trade order inside one bar as one bigint (day < 32, order id < 2^55, line < 8).

    A single long keeps the first/last aggregates hash-based; a struct key would force a sort.
    """
    return (F.shiftleft(day_in_bar.cast("bigint"), 58)
            .bitwiseOR(F.shiftleft(order_id.cast("bigint"), 3)).bitwiseOR(line.cast("bigint")))


def build_bars(trades: DataFrame, bar: Column, code: str = "code", price: str = "price",
               volume: str = "volume", order: str = "ord", amount: str | None = None, **more: Column) -> DataFrame:
    """OHLCV bars per (code, bar). All aggregates combine map-side, so a hot code shrinks before the shuffle. ``more`` adds aggregates."""
    amt = F.col(amount) if amount else F.col(price) * F.col(volume)
    return trades.groupBy(F.col(code).alias("code"), bar.alias("ts")).agg(
        F.min_by(price, order).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"),
        F.max_by(price, order).alias("close"), F.sum(volume).alias("volume"), F.sum(amt).alias("amount"),
        F.count(F.lit(1)).alias("trades"), *[a.alias(k) for k, a in more.items()])


def resample_within_day(bars: DataFrame, k: int, keys: Sequence[str] = ("code",)) -> DataFrame:
    """Merge k consecutive bars of one day; a merge never crosses the day."""
    day = F.to_date("ts")
    w = Window.partitionBy(*keys, "_day").orderBy("ts")
    b = bars.withColumn("_day", day)
    b = b.withColumn("_grp", F.floor((F.row_number().over(w) - 1) / k))
    return b.groupBy(*keys, "_day", "_grp").agg(
        F.min("ts").alias("ts"), F.min_by("open", "ts").alias("open"), F.max("high").alias("high"),
        F.min("low").alias("low"), F.max_by("close", "ts").alias("close"), F.sum("volume").alias("volume"),
        F.sum("amount").alias("amount")).drop("_day", "_grp")


def last_bars(bars: DataFrame, n: int, keys: Sequence[str] = ("code",)) -> DataFrame:
    """The n most recent bars of every code."""
    w = Window.partitionBy(*keys).orderBy(F.desc("ts"))
    return bars.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def last_days(bars: DataFrame, n: int, keys: Sequence[str] = ("code",)) -> DataFrame:
    """Bars of the n most recent distinct days of every code."""
    w = Window.partitionBy(*keys).orderBy(F.desc(F.to_date("ts")))
    return bars.withColumn("_r", F.dense_rank().over(w)).where(F.col("_r") <= n).drop("_r")


def flow_snapshot(daily: DataFrame) -> DataFrame:
    """Last row per code: 10-row mean turnover, latest turnover, 5-row net flow sums and the sign."""
    s = Series()
    d = daily.select(
        "code", "ts", F.col("turnover").alias("last_turnover"),
        s.mean("turnover", 10, min_periods=1).alias("avg_turnover10"),
        s.sum("net_volume", 5, min_periods=1).alias("net_volume5"),
        s.sum("net_amount", 5, min_periods=1).alias("net_amount5"))
    return last_bars(d, 1).withColumn(
        "direction", F.when(F.col("net_amount5") > 0, "inflow").when(F.col("net_amount5") < 0, "outflow")
        .otherwise("flat"))


def weekly_rollup(daily: DataFrame) -> DataFrame:
    """Market total per day first, then the week: first/last close, % change, amount mean/sum/max, days."""
    per_day = daily.groupBy("ts").agg(F.sum("amount").alias("amount"), F.avg("close").alias("close"))
    week = F.date_trunc("week", "ts").cast("date")
    out = per_day.groupBy(week.alias("week")).agg(
        F.min_by("close", "ts").alias("first_close"), F.max_by("close", "ts").alias("last_close"),
        F.avg("amount").alias("mean_amount"), F.sum("amount").alias("sum_amount"),
        F.max("amount").alias("max_amount"), F.count(F.lit(1)).alias("days"))
    return out.withColumn("iso_week", F.weekofyear("week")).withColumn(
        "week_pct", (ratio("last_close", "first_close") - 1) * 100)


def rows_in_days(rows: DataFrame, date_col: str, days: DataFrame) -> DataFrame:
    """Rows whose date is one of ``days(date)``."""
    return rows.join(days.select(F.col("date").alias(date_col)), date_col, "left_semi")


def contract_join(daily: DataFrame, master: DataFrame, key: str, wanted: Column) -> DataFrame:
    """Daily rows of the wanted contracts with their reference columns."""
    return daily.join(master.where(wanted), key, "inner")


def dominant_by_volume(daily: DataFrame) -> DataFrame:
    """Contract with the largest volume on the latest date of each symbol."""
    per = daily.groupBy("symbol", "ts", "contract").agg(F.sum("volume").alias("volume"))
    latest = per.groupBy("symbol").agg(F.max("ts").alias("ts"))
    per = per.join(latest, ["symbol", "ts"])
    return per.groupBy("symbol", "ts").agg(
        F.max_by("contract", F.struct("volume", "contract")).alias("contract"), F.max("volume").alias("volume"))


def dominant_by_mode(mapping: DataFrame) -> DataFrame:
    """Most frequent contract of each symbol on its latest date (smallest name wins ties)."""
    latest = mapping.groupBy("symbol").agg(F.max("ts").alias("ts"))
    cnt = mapping.join(latest, ["symbol", "ts"]).groupBy("symbol", "ts", "contract").agg(
        F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("symbol").orderBy(F.desc("n"), "contract")
    return cnt.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def last_of(rows: DataFrame, keys: Sequence[str], order: str | None = None) -> DataFrame:
    """One row per key: the last by ``order``; without one, or in ties, the largest of the other columns in turn."""
    rest = [x for x in rows.columns if x not in keys]
    if not rest:
        return rows.distinct()
    rank = F.struct(*([F.col(order).alias("_o")] if order else []), *rest)
    return rows.groupBy(*keys).agg(F.max(rank).alias("_r")).select(*[F.col(x) if x in keys else F.col(f"_r.{x}") for x in rows.columns])


def valid_bars(bars: DataFrame, max_jump: float = 0.5, order: str | None = None) -> DataFrame:
    """Keep the last bar of each key (see ``last_of``), drop non-positive and high<low bars, then jumps of more than ``max_jump``."""
    ok = ((F.col("open") > 0) & (F.col("high") > 0) & (F.col("low") > 0) & (F.col("close") > 0)
          & (F.col("high") >= F.col("low")) & (F.col("volume") >= 0))
    s = Series()
    jump = F.abs(s.pct("close"))
    return (last_of(bars, ["code", "ts"], order).where(ok).withColumn("_j", jump)
            .where(F.col("_j").isNull() | (F.col("_j") <= max_jump)).drop("_j"))


def trading_calendar(days: DataFrame) -> DataFrame:
    """calendar(date, td_index) of the open days; its size is bounded by the calendar."""
    return days.select("date").distinct().withColumn(
        "td_index", F.row_number().over(Window.orderBy("date")))


def nth_previous_day(calendar: DataFrame, n: int) -> DataFrame:
    prev = calendar.select(F.col("date").alias("prev_date"), (F.col("td_index") + n).alias("td_index"))
    return calendar.join(prev, "td_index", "left").select("date", "prev_date")


def nearest_trading_day(dates: DataFrame, calendar: DataFrame, col: str = "date") -> DataFrame:
    """As-of: the last open day not after each date; distinct dates and calendar are unioned and filled."""
    marks = dates.select(F.col(col).alias("_d")).distinct().withColumn("_open", F.lit(None).cast("date"))
    opens = calendar.select(F.col("date").alias("_d"), F.col("date").alias("_open"))
    allrows = marks.unionByName(opens).groupBy("_d").agg(F.max("_open").alias("_open"))
    w = Window.orderBy("_d").rowsBetween(Window.unboundedPreceding, 0)
    filled = allrows.select("_d", F.last("_open", ignorenulls=True).over(w).alias("trading_day"))
    return dates.join(filled, dates[col] == F.col("_d"), "left").drop("_d")


def refresh(history: DataFrame, fresh: DataFrame, keys: Sequence[str] = ("code", "ts"), order: str | None = None) -> DataFrame:
    """Upsert: the last fresh row of a key (by ``order``) replaces the stored row; everything else is kept.

    The overlap (a few days) is small next to the history, so the history is only probed, not regrouped.
    """
    return history.join(fresh.select(*keys), list(keys), "left_anti").unionByName(last_of(fresh, keys, order))


def curve_overlay(curves: DataFrame) -> DataFrame:
    """Rebase every run's NAV to 1 at its first point; running sum of IC per run."""
    w = series(("run_id",), ("ts",))
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    return curves.select(
        "run_id", "ts", ratio("nav", F.first("nav").over(run)).alias("rebased"),
        F.sum("ic").over(run).alias("cum_ic"))
