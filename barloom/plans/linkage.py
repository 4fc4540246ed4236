"""Market dimensions: flows, margin, basis, options, funds, rates, lists, and their aggregate."""

from pyspark.sql import functions as F

from barloom.operators import linkage as L
from barloom.plans import bindings as D
from barloom.plans.registry import query

c = F.col
TENORS = ["t_on", "t_1w", "t_1m", "t_1y"]

FLOW = """fl AS (SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS date, l_suppkey AS code, sum(CASE WHEN l_returnflag = 'N' THEN l_extendedprice WHEN l_returnflag = 'R' THEN -l_extendedprice ELSE 0 END) / 100 AS net FROM lineitem GROUP BY 1, 2)"""


def flows(spark, sf):
    p = c("l_extendedprice")
    return D.table(spark, sf, "lineitem").groupBy(F.trunc("l_shipdate", "month").alias("date"), c("l_suppkey").alias("code")).agg(
        (F.sum(F.when(c("l_returnflag") == "N", p).when(c("l_returnflag") == "R", -p).otherwise(0.0)) / 100).alias("net"))


CAP = FLOW + """,
cf AS (SELECT date, sum(net) / 1e4 AS net_yi, count_if(net > 0) AS in_count, count_if(net < 0) AS out_count FROM fl GROUP BY 1),
l1 AS (SELECT *, CASE WHEN net_yi > 50 THEN 75 WHEN net_yi > 10 THEN 60 WHEN net_yi < -50 THEN 25 WHEN net_yi < -10 THEN 40 ELSE 50 END AS score, CASE WHEN net_yi > 10 THEN 'bullish' WHEN net_yi < -10 THEN 'bearish' ELSE 'neutral' END AS bias FROM cf)"""


@query("l01_capital_flow", "date:d net_yi:f6 in_count:i out_count:i score:i bias:s", CAP + "\n---\nSELECT * FROM l1")
def capital(spark, sf):
    return L.capital_flow(flows(spark, sf))


@query("l01_top_flows", "date:d side:s place:i code:i net:f4", FLOW + """,
sd AS (SELECT *, CASE WHEN net > 0 THEN 'in' ELSE 'out' END AS side FROM fl WHERE net <> 0)
---
SELECT *, row_number() OVER (PARTITION BY date, side ORDER BY abs(net) DESC, code) AS place FROM sd QUALIFY place <= 10""")
def top_flows(spark, sf):
    return L.top_flows(flows(spark, sf))


@query("l01_top_sector_flows", "date:d side:s place:i sector:s net:f4", FLOW + """,
sc AS (SELECT date, n_name AS sector, sum(net) AS net FROM fl JOIN supplier ON s_suppkey = code JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2),
sd AS (SELECT *, CASE WHEN net > 0 THEN 'in' ELSE 'out' END AS side FROM sc WHERE net <> 0)
---
SELECT *, row_number() OVER (PARTITION BY date, side ORDER BY abs(net) DESC, sector) AS place FROM sd QUALIFY place <= 5""")
def top_sectors(spark, sf):
    s, n = D.table(spark, sf, "supplier"), D.table(spark, sf, "nation")
    sec = s.join(F.broadcast(n), s.s_nationkey == n.n_nationkey).select(c("s_suppkey").alias("code"), c("n_name").alias("sector"))
    return L.top_flows(flows(spark, sf).join(sec, "code"), 5, "sector")


NB = FLOW + """,
nb0 AS (SELECT date, sum(net) * 5 AS net FROM fl GROUP BY 1),
nb1 AS (SELECT *, net / 1e4 AS net_yi, sum(net) OVER (ORDER BY date ROWS 4 PRECEDING) / 1e4 AS cum_yi, sum((net > 0)::INT) OVER (ORDER BY date ROWS 4 PRECEDING) AS positive_days, row_number() OVER (ORDER BY date) AS i,
  (net > 0) IS DISTINCT FROM lag(net > 0) OVER (ORDER BY date) AS tn FROM nb0),
nb2 AS (SELECT *, i - max(CASE WHEN tn THEN i END) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) + 1 AS streak FROM nb1),
nb3 AS (SELECT *, greatest(0, least(100, 50 + CASE WHEN net_yi > 50 THEN 18 WHEN net_yi > 0 THEN 6 WHEN net_yi < -50 THEN -18 WHEN net_yi < 0 THEN -6 ELSE 0 END + CASE WHEN cum_yi > 0 THEN 5 ELSE -5 END + CASE WHEN streak >= 3 THEN CASE WHEN net > 0 THEN 10 ELSE -10 END ELSE 0 END)) AS score FROM nb2),
l2 AS (SELECT *, CASE WHEN score > 55 THEN 'bullish' WHEN score < 45 THEN 'bearish' ELSE 'neutral' END AS bias FROM nb3)"""


@query("l02_northbound", "date:d net_yi:f8 cum_yi:f8 positive_days:i streak:i score:i bias:s", NB + "\n---\nSELECT * FROM l2")
def northbound(spark, sf):
    return L.northbound(flows(spark, sf).groupBy("date").agg((F.sum("net") * 5).alias("net")))


MT = """mt0 AS (SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS date, sum(l_extendedprice) AS rzye FROM lineitem GROUP BY 1),
mt1 AS (SELECT *, coalesce(rzye - lag(rzye) OVER w, 0) AS net, (rzye / first_value(rzye) OVER (w ROWS 19 PRECEDING) - 1) * 100 AS change_pct, avg(rzye) OVER (w ROWS 4 PRECEDING) AS ma5 FROM mt0 WINDOW w AS (ORDER BY date)),
mt2 AS (SELECT *, CASE WHEN rzye > ma5 THEN 'up' ELSE 'down' END AS trend, greatest(0, least(100, 50 + CASE WHEN net > 0 THEN 12 ELSE -12 END + CASE WHEN change_pct > 1.5 THEN 8 WHEN change_pct < -1.5 THEN -8 ELSE 0 END)) AS score FROM mt1),
l3 AS (SELECT *, CASE WHEN score > 55 THEN 'bullish' WHEN score < 45 THEN 'bearish' ELSE 'neutral' END AS bias FROM mt2)"""


@query("l03_margin_trend", "date:d net:f2 change_pct:f4 ma5:f2 trend:s score:i bias:s", MT + "\n---\nSELECT * FROM l3")
def margin(spark, sf):
    return L.margin_trend(D.table(spark, sf, "lineitem").groupBy(F.trunc("l_shipdate", "month").alias("date")).agg(F.sum("l_extendedprice").alias("rzye")))


FB = """fb0 AS (SELECT p_type AS variety, CAST(date_trunc('month', l_shipdate) AS DATE) AS date, l_suppkey AS contract, sum(l_quantity) AS vol, sum(l_extendedprice) / sum(l_quantity) AS settle, sum(l_extendedprice) AS am FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3),
fb1 AS (SELECT variety, date, settle FROM fb0 QUALIFY row_number() OVER (PARTITION BY variety, date ORDER BY vol DESC, contract DESC) = 1),
fb2 AS (SELECT variety, date, (settle / close - 1) * 100 AS br FROM fb1 JOIN (SELECT variety, date, sum(am) / sum(vol) AS close FROM fb0 GROUP BY 1, 2) USING (variety, date)),
fb3 AS (SELECT date, count_if(br > 0.3) AS ups, count_if(br < -0.3) AS downs FROM fb2 GROUP BY 1),
l4 AS (SELECT *, greatest(0, least(100, 50 + (ups - downs) * 10)) AS score, CASE WHEN ups > downs THEN 'bullish' WHEN ups < downs THEN 'bearish' ELSE 'neutral' END AS bias FROM fb3)"""


@query("l04_futures_basis", "date:d ups:i downs:i score:i bias:s", FB + "\n---\nSELECT * FROM l4")
def basis(spark, sf):
    li, part = D.table(spark, sf, "lineitem"), D.table(spark, sf, "part")
    g = li.join(part, li.l_partkey == part.p_partkey).groupBy(c("p_type").alias("variety"), F.trunc("l_shipdate", "month").alias("date"), c("l_suppkey").alias("contract")).agg(
        F.sum("l_quantity").alias("vol"), F.sum("l_extendedprice").alias("am"))
    index = g.groupBy("variety", "date").agg((F.sum("am") / F.sum("vol")).alias("close"))
    return L.futures_basis(g.withColumn("settle", c("am") / c("vol")), index)


def _dv():
    from barloom.plans import derivatives
    return derivatives


OS = _dv().OPT + "," + _dv().PCR + """,
os AS (SELECT date, count_if(coalesce(pcr_vol, 1) < 0.7) AS ups, count_if(coalesce(pcr_vol, 1) > 1.3) AS downs FROM pcr GROUP BY 1),
l5 AS (SELECT *, greatest(0, least(100, 50 + (ups - downs) * 8)) AS score, CASE WHEN ups > downs THEN 'bullish' WHEN ups < downs THEN 'bearish' ELSE 'neutral' END AS bias FROM os)"""


@query("l05_option_sentiment", "date:d ups:i downs:i score:i bias:s", OS + "\n---\nSELECT * FROM l5")
def options(spark, sf):
    return L.option_sentiment(_dv().pcr(spark, sf))


ES = D.PANEL + """,
es AS (SELECT code, date, (volume / first_value(volume) OVER w - 1) * 100 AS share_pct, (close / first_value(close) OVER w - 1) * 100 AS price_pct FROM panel WINDOW w AS (PARTITION BY code ORDER BY date ROWS 20 PRECEDING)),
et AS (SELECT date, count_if(share_pct > 2) AS ups, count_if(share_pct < -2) AS downs FROM es GROUP BY 1),
l6 AS (SELECT *, greatest(0, least(100, 50 + (ups - downs) * 7)) AS score, CASE WHEN ups > downs THEN 'bullish' WHEN ups < downs THEN 'bearish' ELSE 'neutral' END AS bias FROM et)"""


def _shares(spark, sf):
    return L.etf_shares(D.panel(spark, sf).select("code", "date", c("volume").alias("share"), "close"))


@query("l06_etf_share_change", "code:i date:d share_pct:f4 price_pct:f4 divergence:s", ES + """
---
SELECT *, CASE WHEN share_pct > 0 AND price_pct < 0 THEN 'buying_dip' WHEN share_pct < 0 AND price_pct > 0 THEN 'taking_profit' WHEN share_pct > 0 AND price_pct > 0 THEN 'with_trend' WHEN share_pct < 0 AND price_pct < 0 THEN 'leaving' ELSE 'none' END AS divergence FROM es""")
def etf_shares(spark, sf):
    return _shares(spark, sf)


@query("l06_etf_dimension", "date:d ups:i downs:i score:i bias:s", ES + "\n---\nSELECT * FROM l6")
def etf_dim(spark, sf):
    return L.etf_dimension(_shares(spark, sf))


IB = """ib0 AS (SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS date, avg(l_discount) * 40 AS t_on, avg(l_tax) * 55 AS t_1w, avg(l_discount) FILTER (l_returnflag = 'N') * 45 AS t_1m, avg(l_tax) FILTER (l_returnflag = 'R') * 58 AS t_1y FROM lineitem GROUP BY 1),
ib1 AS (SELECT date, ((t_on - first_value(t_on) OVER w) + (t_1w - first_value(t_1w) OVER w) + (t_1m - first_value(t_1m) OVER w) + (t_1y - first_value(t_1y) OVER w)) * 25 AS mean_bp, t_1y - t_on AS spread FROM ib0 WINDOW w AS (ORDER BY date ROWS 5 PRECEDING)),
l7 AS (SELECT *, spread < 0.2 AS flat_curve, CASE WHEN mean_bp < -2 THEN 65 WHEN mean_bp > 2 THEN 35 ELSE 50 END AS score, CASE WHEN mean_bp < -2 THEN 'bullish' WHEN mean_bp > 2 THEN 'bearish' ELSE 'neutral' END AS bias FROM ib1)"""


@query("l07_interbank_rates", "date:d mean_bp:f6 spread:f6 flat_curve:b score:i bias:s", IB + "\n---\nSELECT * FROM l7")
def interbank(spark, sf):
    r = D.table(spark, sf, "lineitem").groupBy(F.trunc("l_shipdate", "month").alias("date")).agg(
        (F.avg("l_discount") * 40).alias("t_on"), (F.avg("l_tax") * 55).alias("t_1w"), (F.avg(F.when(c("l_returnflag") == "N", c("l_discount"))) * 45).alias("t_1m"),
        (F.avg(F.when(c("l_returnflag") == "R", c("l_tax"))) * 58).alias("t_1y"))
    return L.interbank(r, TENORS)


DT = FLOW + """,
dt0 AS (SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS date, count(DISTINCT l_suppkey) AS list_count FROM lineitem WHERE l_quantity >= 50 GROUP BY 1),
dt1 AS (SELECT coalesce(a.date, b.date) AS date, coalesce(list_count, 0) AS list_count, coalesce(b.inst_net, 0) AS inst_net FROM dt0 a FULL JOIN (SELECT date, sum(net) AS inst_net FROM fl GROUP BY 1) b ON a.date = b.date),
l8 AS (SELECT *, CASE WHEN list_count > 20 AND inst_net > 0 THEN 70 WHEN inst_net > 0 THEN 60 WHEN list_count > 20 AND inst_net < 0 THEN 35 WHEN inst_net < 0 THEN 40 ELSE 50 END AS score, CASE WHEN inst_net > 0 THEN 'bullish' WHEN inst_net < 0 THEN 'bearish' ELSE 'neutral' END AS bias FROM dt1)"""


@query("l08_dragon_tiger", "date:d list_count:i inst_net:f2 score:i bias:s", DT + "\n---\nSELECT * FROM l8")
def dragon(spark, sf):
    listed = D.table(spark, sf, "lineitem").where("l_quantity >= 50").select(F.trunc("l_shipdate", "month").alias("date"), c("l_suppkey").alias("code"))
    return L.dragon_tiger(listed, flows(spark, sf))


_PARTS = [CAP, NB, MT, FB, OS, ES, IB, DT]


def _aggregate_sql():
    seen, out = set(), []
    for i, text in enumerate(_PARTS, 1):
        # each text is a list of named CTEs; shared ones (flows, bars) appear once
        for part in _split(text):
            name = part.split(" AS ")[0].strip()
            if name not in seen:
                seen.add(name)
                out.append(part.strip())
    union = " UNION ALL ".join(f"SELECT date, {i} AS dim, score, bias FROM l{i}" for i in range(1, 9))
    return ",\n".join(out) + f",\ndm AS ({union}),\nag AS (SELECT date, avg(score) AS a, count_if(bias = 'bullish') AS bulls, count_if(bias = 'bearish') AS bears, count(*) / 8e0 AS coverage FROM dm GROUP BY 1)"


def _split(text):
    depth, start, parts = 0, 0, []
    for i, ch in enumerate(text):
        depth += ch == "("
        depth -= ch == ")"
        if ch == "," and depth == 0:
            parts.append(text[start:i])
            start = i + 1
    return [*parts, text[start:]]


@query("l09_linkage_aggregate", "date:d avg_score:f4 bulls:i bears:i coverage:f4 sentiment:s", _aggregate_sql() + """
---
SELECT date, a AS avg_score, bulls, bears, coverage, CASE WHEN bulls > bears AND a >= 58 THEN 'bullish' WHEN bears > bulls AND a <= 42 THEN 'bearish' ELSE 'mixed' END AS sentiment FROM ag""")
def aggregate(spark, sf):
    parts = [capital, northbound, margin, basis, options, etf_dim, interbank, dragon]
    dims = None
    for i, fn in enumerate(parts, 1):
        d = fn(spark, sf).select("date", F.lit(i).alias("dim"), c("score").cast("double").alias("score"), "bias")
        dims = d if dims is None else dims.unionByName(d)
    return L.aggregate(dims)
