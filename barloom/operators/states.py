"""State signals: ten labels of a code's structures as of its last bar, each with up to three values and a score."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.windows import ladder

c = F.col
# Label and key of each point.
POINT_NAMES = {"buy1": ("一类买", "BUY1"), "buy2": ("二类买", "BUY2"), "buy3": ("三类买", "BUY3"), "sell1": ("一类卖", "SELL1"), "sell2": ("二类卖", "SELL2"), "sell3": ("三类卖", "SELL3")}
# The default events. A condition is (kind of signal, one of its values).
EVENTS = [
    {"name": "一类买机会", "all": [("买卖点", "|BUY1|")], "priority": 3},
    {"name": "二类买机会", "all": [("买卖点", "|BUY2|")], "priority": 2},
    {"name": "三类买机会", "all": [("买卖点", "|BUY3|")], "priority": 1},
    {"name": "趋势反转", "all": [("MACD", "|底背离|")], "any": [("买卖点", "|一类买|"), ("笔状态", "|转折|")], "priority": 3},
    {"name": "高风险警告", "all": [("风险等级", "|高|")], "any": [("买卖点", "|一类卖|"), ("MACD", "|顶背离|")], "priority": 3},
]


def asof_many(left: DataFrame, left_ts: str, sources: Mapping[str, tuple[DataFrame, str, Sequence[str]]]) -> DataFrame:
    """``left`` with the latest row of every source no later than ``left_ts``, and its age in days.

    All sources (prefix: (rows, time column, fields)) are merged with ``left`` once and filled forward, so k sources cost
    one shuffle and one sort by code instead of one each. Fields appear as ``<prefix><field>``, ages as ``<prefix>age``.
    """
    parts = [left.withColumns({"_t": c(left_ts), "_k": F.lit(1)})]
    for prefix, (rows, ts, fields) in sources.items():
        parts.append(rows.select("code", c(ts).alias("_t"), F.lit(0).alias("_k"), F.struct(*fields, c(ts).alias("_at")).alias(f"_{prefix}")))
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    w = Window.partitionBy("code").orderBy("_t", "_k").rowsBetween(Window.unboundedPreceding, 0)
    filled = both.select("*", *[F.last(f"_{p}", ignorenulls=True).over(w).alias(f"_l{p}") for p in sources]).where("_k = 1")
    found = [c(f"_l{p}")[f].alias(f"{p}{f}") for p, (_, _, fields) in sources.items() for f in fields]
    ages = [F.datediff(left_ts, c(f"_l{p}")["_at"]).alias(f"{p}age") for p in sources]
    return filled.select(*left.columns, *found, *ages)


def _price(x: str) -> Column:
    return F.format_string("%.2f", F.floor(c(x) * 100 + 0.5) / 100)


def _row(k2: str, k3, v1, v2, score, v3=None, when=None) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    row = F.struct(lit(k2).alias("k2"), lit(k3).alias("k3"), lit(v1).alias("v1"), lit(v2).alias("v2"), lit(v3 if v3 is not None else "任意").alias("v3"), lit(score).cast("double").alias("score"))
    return row if when is None else F.when(when, row)


def state_signals(last: DataFrame, points: DataFrame, n_points: int = 3) -> DataFrame:
    """(code, k2, k3, v1, v2, v3, score) of every code.

    ``last`` has one row for each code: close, volume_ratio (null before 20 bars), cross, ubi (bars since the last stroke),
    stroke_dir, fractal word and whether a zone was there, the last zone's edges, the last divergence, and direction, strength
    and risk of the composite. ``points`` are all points, of which the latest ``n_points`` count. What is missing gives no row.
    """
    down = c("stroke_dir") == -1
    status = ladder((c("ubi") < 3, "新笔"), (c("ubi") < 7, "转折"), default="延伸")
    divergence = ladder((c("divergence") == "top", "顶背离"), (c("divergence") == "bottom", "底背离"), default="无背离")
    word = lambda x, names: ladder((c(x) > 0.7, names[0]), (c(x) > 0.4, names[1]), default=names[2])
    power = c("fractal")
    ends, sure = power.isNotNull(), c("divergence").isNotNull()
    above, below = c("close") > c("zone_high"), c("close") < c("zone_low")
    vr = c("volume_ratio")
    rows = [
        _row("分型强弱", "D1F", power, F.when(c("fractal_zone"), "有中枢").otherwise("无中枢"), ladder((power == "强", 1.0), (power == "中", 0.7), default=0.4), when=ends),
        _row("笔状态", "D0BL", F.when(down, "向上").otherwise("向下"), status, F.when(status == "转折", 0.8).otherwise(0.5), when=c("stroke_dir").isNotNull()),
        _row("MACD", "信号", c("cross"), divergence, F.when(divergence != "无背离", 0.9).otherwise(0.6)),
        _row("趋势方向", "综合", c("direction"), word("trend_strength", "强中弱"), c("trend_strength"), when=c("direction").isNotNull()),
        _row("风险等级", "评估", word("risk", "高中低"), F.concat(F.floor(c("risk") * 100 + 1e-9).cast("string"), F.lit("%")), 1 - c("risk"), when=c("risk").isNotNull()),
        _row("笔结束", "BI_END", F.when(ends, "结束").otherwise("延续"), F.when(sure, "MACD确认").otherwise("MACD未确认"), ladder((ends & sure, 0.9), (ends, 0.6), default=0.3), F.when(down, "向下").otherwise("向上"), when=c("stroke_dir").isNotNull()),
        _row("中枢突破", "ZS_BRK", ladder((above, "向上突破"), (below, "向下突破"), default="在中枢内"),
             ladder((above, F.concat(F.lit("突破"), _price("zone_high"))), (below, F.concat(F.lit("跌破"), _price("zone_low"))), default=F.concat(F.lit("区间"), _price("zone_low"), F.lit("-"), _price("zone_high"))),
             F.when(above | below, 0.8).otherwise(0.3), when=c("zone_low").isNotNull()),
        _row("MACD背离", "MACD_DIV", divergence, F.when(c("divergence") == "top", "价格新高MACD未新高").otherwise("价格新低MACD未新低"), 0.85, when=sure),
        _row("量能信号", "VOL_BRK", ladder((vr > 3, "巨量"), (vr > 2, "大量"), (vr > 1.5, "放量"), default="缩量"), F.concat(F.lit("量比"), F.format_string("%.1f", F.floor(vr * 10 + 0.5) / 10)),
             ladder((vr > 3, 0.9), (vr > 2, 0.7), (vr > 1.5, 0.5), default=0.2), ladder((c("direction") == "up", "向上"), (c("direction") == "down", "向下"), default="横盘"), when=vr.isNotNull()),
    ]
    out = last.select("code", F.explode(F.filter(F.array(*rows), lambda x: x.isNotNull())).alias("s")).select("code", "s.*")
    w = Window.partitionBy("code").orderBy(F.desc("ts"), F.desc("point"))
    recent = points.withColumn("_r", F.row_number().over(w)).where(c("_r") <= n_points)
    name = lambda k: ladder(*[(c("point") == p, v[k]) for p, v in POINT_NAMES.items()])
    sure_ = F.concat(F.lit("可靠度"), F.floor(c("reliability") * 100 + 1e-9).cast("string"), F.lit("%"))
    return out.unionByName(recent.select("code", F.lit("买卖点").alias("k2"), name(1).alias("k3"), name(0).alias("v1"), sure_.alias("v2"), F.lit("任意").alias("v3"), c("reliability").cast("double").alias("score")))


def event_labels(states: DataFrame) -> DataFrame:
    """State signals as (code, name, v1) for the rule engine: all values of a signal between bars."""
    return states.select("code", c("k2").alias("name"), F.concat(F.lit("|"), F.concat_ws("|", "k3", "v1", "v2"), F.lit("|")).alias("v1"))
