"""Market tables derived from the given tables, in Spark and as SQL CTEs with the same rows.

The given tables hold invented data; these projections give them the shape of trades, bars and panels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.operators import bars as B
from barloom.operators import factors as Fx

Spark = SparkSession


def table(spark: Spark, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# ---- supplier x month bars -----------------------------------------------------------------------

def supplier_month(spark: Spark, sf: str, **more: Column) -> DataFrame:
    li = table(spark, sf, "lineitem")
    t = li.select(
        F.col("l_suppkey").alias("code"), "l_shipdate",
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), F.col("l_quantity").alias("volume"),
        F.col("l_extendedprice").alias("amount"),
        B.trade_order(F.dayofmonth("l_shipdate"), F.col("l_orderkey"), F.col("l_linenumber")).alias("ord"))
    return B.build_bars(t, F.trunc("l_shipdate", "month"), amount="amount", **more)


_OHLC = """arg_min(price, ord) AS open, max(price) AS high, min(price) AS low, arg_max(price, ord) AS close,
    sum(volume) AS volume, sum(amount) AS amount, count(*) AS trades"""

SUPPLIER_MONTH = f"""
strades AS (SELECT l_suppkey AS code, l_shipdate, l_extendedprice / l_quantity AS price, l_quantity AS volume,
    l_extendedprice AS amount,
    CAST(day(l_shipdate) AS HUGEINT) * 288230376151711744 + l_orderkey * 8 + l_linenumber AS ord FROM lineitem),
sbars AS (SELECT code, CAST(date_trunc('month', l_shipdate) AS DATE) AS ts, {_OHLC} FROM strades GROUP BY ALL)"""


def panel(spark: Spark, sf: str, **more: Column) -> DataFrame:
    """Monthly panel whose close is the month's average price; ``more`` aggregates of the trades become columns."""
    return supplier_month(spark, sf, **more).select(
        "code", F.col("ts").alias("date"), (F.col("amount") / F.col("volume")).alias("close"),
        "open", "high", "low", "volume", "amount", "trades", *more)


PANEL = SUPPLIER_MONTH + """,
panel AS (SELECT code, ts AS date, amount / volume AS close, open, high, low, volume, amount, trades FROM sbars)"""


# ---- brand x week / day / month bars -------------------------------------------------------------

def brand_bars(spark: Spark, sf: str, level: str = "week") -> DataFrame:
    li, part = table(spark, sf, "lineitem"), table(spark, sf, "part")
    day = F.weekday("l_shipdate") if level == "week" else F.dayofmonth("l_shipdate")
    t = li.join(part, li.l_partkey == part.p_partkey).select(
        F.col("p_brand").alias("code"), "l_shipdate",
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), F.col("l_quantity").alias("volume"),
        F.col("l_extendedprice").alias("amount"),
        B.trade_order(day, F.col("l_orderkey"), F.col("l_linenumber")).alias("ord"))
    return B.build_bars(t, F.date_trunc(level, "l_shipdate").cast("date"), amount="amount")


def _brand_sql(level: str, name: str) -> str:
    day = "isodow(l_shipdate) - 1" if level == "week" else "day(l_shipdate)"
    return f"""
{name}_t AS (SELECT p_brand AS code, l_shipdate, l_extendedprice / l_quantity AS price, l_quantity AS volume,
    l_extendedprice AS amount,
    CAST({day} AS HUGEINT) * 288230376151711744 + l_orderkey * 8 + l_linenumber AS ord
    FROM lineitem JOIN part ON l_partkey = p_partkey),
{name} AS (SELECT code, CAST(date_trunc('{level}', l_shipdate) AS DATE) AS ts, {_OHLC} FROM {name}_t GROUP BY ALL)"""


BRAND_WEEK = _brand_sql("week", "bars")
BRAND_MONTH = _brand_sql("month", "mbars")
BRAND_DAY = _brand_sql("day", "dbars")


# ---- minute bars from events ---------------------------------------------------------------------

def events(spark: Spark, sf: str) -> DataFrame:
    return table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def event_order(ts, event_id):
    """(microseconds, id) as one decimal: exact, and still a hash-aggregate buffer."""
    return F.unix_micros(ts).cast("decimal(20,0)") * F.lit(10 ** 15).cast("decimal(16,0)") + event_id.cast("decimal(16,0)")


def event_bars(spark: Spark, sf: str, minutes: int = 30, code: str = "event_type") -> DataFrame:
    ev = events(spark, sf)
    t = ev.select(F.col(code).alias("code"), "ts", F.col("value").alias("price"), F.lit(1.0).alias("volume"),
                  event_order(F.col("ts"), F.col("event_id")).alias("ord"))
    bar = F.timestamp_seconds(F.floor(F.unix_seconds("ts") / (60 * minutes)) * (60 * minutes))
    return B.build_bars(t, bar)


def event_bars_sql(minutes: int = 30, code: str = "event_type", name: str = "ebars") -> str:
    return f"""
{name}_t AS (SELECT {code} AS code, ts AS tick, value AS price, 1e0 AS volume, value AS amount,
    CAST(epoch_us(ts) AS HUGEINT) * 1000000000000000 + event_id AS ord,
    make_timestamp((epoch_us(ts) // {minutes * 60000000}) * {minutes * 60000000}) AS bar FROM events),
{name} AS (SELECT code, bar AS ts, {_OHLC} FROM {name}_t GROUP BY ALL)"""


EVENT_BARS = event_bars_sql()


# ---- benchmark -----------------------------------------------------------------------------------

def benchmark(spark: Spark, sf: str) -> DataFrame:
    return Fx.benchmark_returns(panel(spark, sf))


def avg_rank_sql(by: str, x: str) -> str:
    return (f"(rank() OVER (PARTITION BY {by} ORDER BY {x}) "
            f"+ (count(*) OVER (PARTITION BY {by}, {x}) - 1) / 2e0)")
