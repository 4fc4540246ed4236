"""Bar, calendar and panel queries."""

from pyspark.sql import functions as F

from barloom.operators import bars as B
from barloom.operators import factors as Fx
from barloom.plans import bindings as D
from barloom.plans.registry import query
from barloom.sources.panels import long_to_wide, wide_to_long

PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def _wide(spark, sf):
    o = D.table(spark, sf, "orders")
    return o.groupBy(F.trunc("o_orderdate", "month").alias("date")).pivot("o_orderpriority", PRIORITIES).agg(
        F.sum("o_totalprice"))


@query("b01_load_panel", "date:d code:s value:f2", """
SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS date, o_orderpriority AS code, sum(o_totalprice) AS value
FROM orders GROUP BY 1, 2""")
def load_panel(spark, sf):
    return wide_to_long(_wide(spark, sf))


@query("b02_panel_pivot", "date:d code:s revenue:f2 orders:f0 largest:f2", """
SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS date, o_orderpriority AS code, sum(o_totalprice) AS revenue,
  count(*) AS orders, max(o_totalprice) AS largest FROM orders GROUP BY 1, 2""")
def panel_pivot(spark, sf):
    o = D.table(spark, sf, "orders").groupBy(
        F.trunc("o_orderdate", "month").alias("date"), F.col("o_orderpriority").alias("code")).agg(
        F.sum("o_totalprice").alias("revenue"), F.count(F.lit(1)).cast("double").alias("orders"),
        F.max("o_totalprice").alias("largest"))
    long = o.unpivot(["date", "code"], ["revenue", "orders", "largest"], "indicator", "value")
    return long_to_wide(long, ["revenue", "orders", "largest"])


@query("b03_ic_result_set", "kind:s key:s value:f4", D.PANEL + """,
x AS (SELECT date, code, volume AS factor, lead(close, 1) OVER w / close - 1 AS ret FROM panel
  WINDOW w AS (PARTITION BY code ORDER BY date)),
r AS (SELECT *, """ + D.avg_rank_sql("date", "factor") + " AS rf, " + D.avg_rank_sql("date", "ret") + """ AS rr
  FROM x WHERE factor IS NOT NULL AND ret IS NOT NULL),
ic AS (SELECT date, round(corr(rf, rr), 6) AS ic FROM r GROUP BY date HAVING count(*) >= 5)
---
SELECT 'series' AS kind, strftime(date, '%Y-%m-%d') AS key, ic AS value FROM ic
UNION ALL SELECT 'summary', 'ic_mean', avg(ic) FROM ic
UNION ALL SELECT 'summary', 'ic_std', stddev_samp(ic) FROM ic""")
def result_set(spark, sf):
    """The rows that the result writer stores: one IC row per date plus the summary."""
    p = D.panel(spark, sf).select("date", "code", F.col("volume").alias("factor"), Fx.forward_return(1).alias("ret"))
    ic = Fx.ic_series(p).where(F.col("ic").isNotNull())
    s = Fx.ic_summary(ic)
    return (ic.select(F.lit("series").alias("kind"), F.col("date").cast("string").alias("key"), F.col("ic").alias("value"))
            .unionByName(s.unpivot([], ["ic_mean", "ic_std"], "key", "value").withColumn("kind", F.lit("summary"))))


@query("b04_overlap_refresh", "code:i ts:d n:i total:f2", """
hist AS (SELECT user_id AS code, CAST(ts AS DATE) AS ts, count(*) AS n, sum(value) AS total FROM events
  WHERE ts < TIMESTAMP '2024-01-24 12:00:00' GROUP BY 1, 2),
fresh AS (SELECT user_id AS code, CAST(ts AS DATE) AS ts, count(*) AS n, sum(value) AS total FROM events
  WHERE ts >= TIMESTAMP '2024-01-18 00:00:00' GROUP BY 1, 2)
---
SELECT coalesce(f.code, h.code) AS code, coalesce(f.ts, h.ts) AS ts, coalesce(f.n, h.n) AS n,
  coalesce(f.total, h.total) AS total
FROM hist h FULL OUTER JOIN fresh f ON h.code = f.code AND h.ts = f.ts""")
def overlap_refresh(spark, sf):
    """Daily rows stored up to noon of the 24th, then the last seven days re-read."""
    ev = D.table(spark, sf, "events")

    def daily(df):
        return df.groupBy(F.col("user_id").alias("code"), F.to_date("ts").alias("ts")).agg(
            F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))

    return B.refresh(daily(ev.where("ts < timestamp'2024-01-24 12:00:00'")),
                     daily(ev.where("ts >= timestamp'2024-01-18 00:00:00'")))


_CAL = """cal AS (SELECT date, row_number() OVER (ORDER BY date) AS td_index FROM
  (SELECT DISTINCT CAST(l_shipdate AS DATE) AS date FROM lineitem WHERE isodow(l_shipdate) <= 5))"""


def _calendar(spark, sf):
    d = D.table(spark, sf, "lineitem").where(F.weekday("l_shipdate") < 5)
    return B.trading_calendar(d.select(F.to_date("l_shipdate").alias("date")))


@query("b05_trading_calendar", "date:d td_index:i prev_date:d", _CAL + """
---
SELECT a.date, a.td_index, b.date AS prev_date FROM cal a LEFT JOIN cal b ON b.td_index = a.td_index - 5""")
def calendar(spark, sf):
    cal = _calendar(spark, sf)
    return cal.join(B.nth_previous_day(cal, 5), "date")


@query("b05_nearest_trading_day", "o_orderkey:i trading_day:d", _CAL + """
---
SELECT o_orderkey, cal.date AS trading_day FROM orders ASOF LEFT JOIN cal ON CAST(o_orderdate AS DATE) >= cal.date""")
def nearest_day(spark, sf):
    o = D.table(spark, sf, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("date"))
    return B.nearest_trading_day(o, _calendar(spark, sf))


_BAR = "code:i ts:d open:f8 high:f8 low:f8 close:f8 volume:f2 amount:f2 trades:i"


@query("b06_bar_build", _BAR, D.SUPPLIER_MONTH + "\n---\nSELECT * FROM sbars")
def bar_build(spark, sf):
    return D.supplier_month(spark, sf)


@query("b06_brand_week_bars", _BAR.replace("code:i", "code:s"), D.BRAND_WEEK + "\n---\nSELECT * FROM bars")
def brand_week(spark, sf):
    return D.brand_bars(spark, sf, "week")


@query("b07_resample_within_day", "code:s ts:t open:f4 high:f4 low:f4 close:f4 volume:f2 amount:f2", D.EVENT_BARS + """,
g AS (SELECT *, CAST(ts AS DATE) AS dy,
  (row_number() OVER (PARTITION BY code, CAST(ts AS DATE) ORDER BY ts) - 1) // 3 AS grp FROM ebars)
---
SELECT code, min(ts) AS ts, arg_min(open, ts) AS open, max(high) AS high, min(low) AS low,
  arg_max(close, ts) AS close, sum(volume) AS volume, sum(amount) AS amount FROM g GROUP BY code, dy, grp""")
def resample(spark, sf):
    return B.resample_within_day(D.event_bars(spark, sf), 3)


@query("b08_last_bars", "code:s ts:t close:f4", D.EVENT_BARS + """
---
SELECT code, ts, close FROM ebars QUALIFY row_number() OVER (PARTITION BY code ORDER BY ts DESC) <= 20""")
def last_bars(spark, sf):
    return B.last_bars(D.event_bars(spark, sf), 20)


@query("b08_last_days", "code:s ts:t close:f4", D.EVENT_BARS + """
---
SELECT code, ts, close FROM ebars
QUALIFY dense_rank() OVER (PARTITION BY code ORDER BY CAST(ts AS DATE) DESC) <= 3""")
def last_days(spark, sf):
    return B.last_days(D.event_bars(spark, sf), 3)


@query("b09_flow_snapshot",
       "code:i ts:d last_turnover:f6 avg_turnover10:f6 net_volume5:f2 net_amount5:f2 direction:s", """
m AS (SELECT l_suppkey AS code, CAST(date_trunc('month', l_shipdate) AS DATE) AS ts,
  sum(CASE WHEN l_returnflag = 'N' THEN l_quantity ELSE -l_quantity END) AS net_volume,
  sum(CASE WHEN l_returnflag = 'N' THEN l_extendedprice ELSE -l_extendedprice END) AS net_amount,
  sum(l_quantity) / 1000 AS turnover FROM lineitem GROUP BY 1, 2),
x AS (SELECT code, ts, turnover AS last_turnover,
  avg(turnover) OVER (w ROWS 9 PRECEDING) AS avg_turnover10, sum(net_volume) OVER (w ROWS 4 PRECEDING) AS net_volume5,
  sum(net_amount) OVER (w ROWS 4 PRECEDING) AS net_amount5,
  row_number() OVER (PARTITION BY code ORDER BY ts DESC) AS r FROM m WINDOW w AS (PARTITION BY code ORDER BY ts))
---
SELECT *, CASE WHEN net_amount5 > 0 THEN 'inflow' WHEN net_amount5 < 0 THEN 'outflow' ELSE 'flat' END AS direction
FROM x WHERE r = 1""")
def flow_snapshot(spark, sf):
    li = D.table(spark, sf, "lineitem")
    sign = F.when(F.col("l_returnflag") == "N", 1).otherwise(-1)
    m = li.groupBy(F.col("l_suppkey").alias("code"), F.trunc("l_shipdate", "month").alias("ts")).agg(
        F.sum(sign * F.col("l_quantity")).alias("net_volume"),
        F.sum(sign * F.col("l_extendedprice")).alias("net_amount"),
        (F.sum("l_quantity") / 1000).alias("turnover"))
    return B.flow_snapshot(m)


@query("b10_weekly_rollup", "week:d iso_week:i first_close:f8 last_close:f8 mean_amount:f5 sum_amount:f2 "
       "max_amount:f2 days:i week_pct:f6", """
d AS (SELECT l_suppkey, CAST(l_shipdate AS DATE) AS ts, sum(l_extendedprice) AS amount,
  sum(l_extendedprice) / sum(l_quantity) AS close FROM lineitem GROUP BY 1, 2),
p AS (SELECT ts, sum(amount) AS amount, avg(close) AS close FROM d GROUP BY 1)
---
SELECT CAST(date_trunc('week', ts) AS DATE) AS week, any_value(week(ts)) AS iso_week, arg_min(close, ts) AS first_close,
  arg_max(close, ts) AS last_close, avg(amount) AS mean_amount, sum(amount) AS sum_amount, max(amount) AS max_amount,
  count(*) AS days, (arg_max(close, ts) / arg_min(close, ts) - 1) * 100 AS week_pct FROM p GROUP BY 1""")
def weekly_rollup(spark, sf):
    d = D.table(spark, sf, "lineitem").groupBy("l_suppkey", F.to_date("l_shipdate").alias("ts")).agg(
        F.sum("l_extendedprice").alias("amount"),
        (F.sum("l_extendedprice") / F.sum("l_quantity")).alias("close"))
    return B.weekly_rollup(d)


@query("b11_rows_in_week", "o_orderkey:i o_orderdate:d", _CAL + """
---
SELECT o_orderkey, o_orderdate FROM orders WHERE CAST(o_orderdate AS DATE) IN
  (SELECT date FROM cal WHERE date BETWEEN DATE '1998-03-01' AND DATE '1998-03-31')""")
def rows_in_week(spark, sf):
    days = _calendar(spark, sf).where("date between date'1998-03-01' and date'1998-03-31'").select("date")
    o = D.table(spark, sf, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("o_orderdate"))
    return B.rows_in_days(o, "o_orderdate", days)


@query("b12_contract_join", "ts_code:i p_name:s p_size:i volume:f2", """
SELECT l_partkey AS ts_code, p_name, p_size, sum(l_quantity) AS volume FROM lineitem JOIN part ON l_partkey = p_partkey
WHERE p_type = 'ECONOMY' GROUP BY 1, 2, 3""")
def contract_join(spark, sf):
    daily = D.table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("ts_code")).agg(
        F.sum("l_quantity").alias("volume"))
    master = D.table(spark, sf, "part").withColumnRenamed("p_partkey", "ts_code")
    return B.contract_join(daily, master, "ts_code", F.col("p_type") == "ECONOMY")


def _brand_daily(spark, sf):
    li, part = D.table(spark, sf, "lineitem"), D.table(spark, sf, "part")
    return li.join(part, li.l_partkey == part.p_partkey).select(
        F.col("p_brand").alias("symbol"), F.trunc("l_shipdate", "month").alias("ts"),
        F.col("l_suppkey").alias("contract"), F.col("l_quantity").alias("volume"))


_BD = """d AS (SELECT p_brand AS symbol, CAST(date_trunc('month', l_shipdate) AS DATE) AS ts, l_suppkey AS contract,
  l_quantity AS volume FROM lineitem JOIN part ON l_partkey = p_partkey),
l AS (SELECT symbol, max(ts) AS ts FROM d GROUP BY 1)"""


@query("b13_dominant_by_volume", "symbol:s ts:d contract:i volume:f2", _BD + """
---
SELECT * FROM (SELECT symbol, ts, contract, sum(volume) AS volume FROM d JOIN l USING (symbol, ts) GROUP BY 1, 2, 3)
QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY volume DESC, contract DESC) = 1""")
def dominant_volume(spark, sf):
    return B.dominant_by_volume(_brand_daily(spark, sf))


@query("b13_dominant_by_mode", "symbol:s ts:d contract:i n:i", _BD + """
---
SELECT * FROM (SELECT symbol, ts, contract, count(*) AS n FROM d JOIN l USING (symbol, ts) GROUP BY 1, 2, 3)
QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY n DESC, contract) = 1""")
def dominant_mode(spark, sf):
    return B.dominant_by_mode(_brand_daily(spark, sf))


@query("b14_valid_bars", "code:i ts:d close:f8", D.SUPPLIER_MONTH + """,
ok AS (SELECT * FROM sbars WHERE open > 0 AND high > 0 AND low > 0 AND close > 0 AND high >= low AND volume >= 0),
j AS (SELECT *, abs(close / lag(close) OVER (PARTITION BY code ORDER BY ts) - 1) AS jump FROM ok)
---
SELECT code, ts, close FROM j WHERE jump IS NULL OR jump <= 0.5""")
def valid_bars(spark, sf):
    return B.valid_bars(D.supplier_month(spark, sf))


@query("b15_curve_overlay", "run_id:i ts:d rebased:f6 cum_ic:f4", D.PANEL + """
---
SELECT code AS run_id, date AS ts, close / first_value(close) OVER w AS rebased,
  sum(open / high) OVER w AS cum_ic FROM panel
  WINDOW w AS (PARTITION BY code ORDER BY date ROWS UNBOUNDED PRECEDING)""")
def curve_overlay(spark, sf):
    p = D.panel(spark, sf).select(F.col("code").alias("run_id"), F.col("date").alias("ts"), F.col("close").alias("nav"),
                                  (F.col("open") / F.col("high")).alias("ic"))
    return B.curve_overlay(p)
