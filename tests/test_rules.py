"""Label scoring, rules over labels, the merged as-of step and the grouped library run."""

import datetime as dt
import random

import pytest

from barloom.operators import structures as X
from barloom.operators.signals import SIGNALS, signal_frame, signal_rows
from barloom.operators.signals.library import groups, signal_library
from barloom.operators.states import EVENTS, asof_many, event_labels
from barloom.plans import bindings as D
from barloom.plans.structures import STRATEGIES

TABLE = [("s", "up", 10.0), ("s", "up_strong", 20.0), ("s", "up_strong_late", 30.0), ("s", "own", 5.0), ("t", "x_y", 7.0)]


@pytest.mark.parametrize("name,label,want", [
    ("s", "up", 10), ("s", "up_strong", 20), ("s", "up_strong_late", 30), ("s", "up_strong_early", 20), ("s", "up_weak_late", 10),
    ("s", "wide_up", 10), ("s", "own_goal", 5), ("s", "none", 0), ("t", "x", 7), ("t", "z", 0), ("u", "up", 0), ("s", "ow", 5)])
def test_labels_are_shortened_part_by_part_then_matched_loosely(spark, name, label, want):
    table = spark.createDataFrame([(*r, i) for i, r in enumerate(TABLE)], "name string, value string, score double, ord int")
    rows = spark.createDataFrame([("a", 1, name, "k", label)] * 2, "code string, ts int, name string, category string, v1 string")
    assert [r.score for r in X.score_signals(rows, table).collect()] == [want, want]


def plain_rules(labels, rules, final, scores):
    def holds(cond):
        return any(n == cond[0] and cond[1] in v for n, v in labels)

    for r in rules:
        if all(map(holds, r.get("all", ()))) and (not r.get("any") or any(map(holds, r["any"]))) and not any(map(holds, r.get("not", ()))):
            if final >= r.get("min_score", 0) and all(scores.get(k, 0) >= v for k, v in r.get("min_category", {}).items()):
                yield r["name"]


def test_rules_equal_a_plain_check(spark):
    """More conditions than one bitmap holds, and every strategy by chance."""
    pick = random.Random(3)
    conds = [(f"n{i % 40}", f"v{i}") for i in range(150)]
    rules = [{"name": f"r{i}", "all": pick.sample(conds, pick.randrange(3)), "any": pick.sample(conds, pick.randrange(4)), "not": pick.sample(conds, pick.randrange(2)), "min_score": pick.choice([0, 50]), "min_category": pick.choice([{}, {"k": 5}])} for i in range(40)]
    named = sorted({c for r in STRATEGIES for k in ("all", "any", "not") for c in r.get(k, ())})
    rules += STRATEGIES
    rows, finals, scores, want = [], [], [], set()
    for i in range(60):
        labels = [(n, f"_{v}_") for n, v in pick.sample(conds, 40) + pick.sample(named, 8)]
        final, score = pick.choice([40.0, 55.0, 65.0]), {k: pick.choice([0.0, 6.0, 30.0]) for k in pick.sample(["k", "cxt", "tas"], 2)}
        rows += [("a", i, n, v) for n, v in labels]
        finals.append(("a", i, final))
        scores += [("a", i, k, v) for k, v in score.items()]
        want |= {(i, x) for x in plain_rules(labels, rules, final, score)}
    got = X.rule_matches(spark.createDataFrame(rows, "code string, ts int, name string, v1 string"), rules, spark.createDataFrame(finals, "code string, ts int, final double"), spark.createDataFrame(scores, "code string, ts int, category string, m double"))
    assert {(r.ts, r.strategy) for r in got.collect()} == want and any(not x.startswith("r") for _, x in want)


def test_default_events(spark):
    rows = [("a", "买卖点", "BUY1", "一类买", "可靠度80%"), ("a", "MACD", "信号", "金叉", "底背离"), ("b", "风险等级", "评估", "高", "80%"), ("b", "MACD", "信号", "死叉", "顶背离"), ("c", "风险等级", "评估", "中", "50%"), ("c", "买卖点", "SELL1", "一类卖", "x")]
    states = spark.createDataFrame(rows, "code string, k2 string, k3 string, v1 string, v2 string")
    got = X.rule_matches(event_labels(states), EVENTS, keys=["code"]).collect()
    assert {(r.code, r.strategy) for r in got} == {("a", "一类买机会"), ("a", "趋势反转"), ("b", "高风险警告")}


def test_merged_asof_equals_a_plain_search(spark):
    pick = random.Random(9)
    day = lambda i: dt.date(2024, 1, 1) + dt.timedelta(days=i)
    left = [(c, day(pick.randrange(60))) for c in "ab" for _ in range(20)]
    sources = {p: [(c, day(pick.randrange(60)), pick.randrange(1000)) for c in "ab" for _ in range(n)] for p, n in (("x_", 3), ("y_", 25))}
    sources = {p: list({r[:2]: r for r in rows}.values()) for p, rows in sources.items()}
    d = asof_many(spark.createDataFrame(left, "code string, ts date"), "ts", {p: (spark.createDataFrame(rows, "code string, at date, v int"), "at", ["v"]) for p, rows in sources.items()})
    for r in d.collect():
        for p, rows in sources.items():
            best = max((q for q in rows if q[0] == r.code and q[1] <= r.ts), key=lambda q: q[1], default=None)
            assert (r[f"{p}v"], r[f"{p}age"]) == ((best[2], (r.ts - best[1]).days) if best else (None, None))


def test_grouped_library_gives_the_labels_of_each_signal(spark):
    names = ["bar_zdf", "tas_macd_cross", "vol_single_ma", "jcc_engulfing", "tas_kdj_cross", "tas_rsi_status", "sta_consecutive"]
    bars = D.brand_bars(spark, "/root/testdata/sf0.001", "month")
    want = {tuple(r) for r in signal_rows(signal_frame(bars, names), "month").collect()}
    assert {tuple(r) for r in signal_library(bars, "month", names, size=3).collect()} == want
    last = {c: max(r[1] for r in want if r[0] == c) for c in {r[0] for r in want}}
    got = {tuple(r) for r in signal_library(bars, "month", names, last_only=True).collect()}
    assert got <= want and all(r[1] == last[r[0]] for r in got)


def test_groups_hold_every_signal_once_and_recursions_together():
    got = groups(list(SIGNALS), 24)
    assert sorted(n for g in got for n in g) == sorted(SIGNALS) and max(map(len, got)) <= 24


def test_overrides_go_by_code_where_symbols_repeat(spark):
    from barloom.operators import portfolio as P

    rows = [(code, dt.date(2024, 1, d), "000007", 10.0) for code in (7, 1007, 2007) for d in (1, 2)]
    panel = spark.createDataFrame(rows, "code long, date date, symbol string, close double")
    over = spark.createDataFrame([(7, 0.05), (1007, 0.05)], "code long, ratio double")
    got = sorted((r.code, r.date.day, r.ratio, r.limit_up) for r in P.with_limits(panel, over).collect())
    assert got == [(7, 1, 0.05, None), (7, 2, 0.05, 10.5), (1007, 1, 0.05, None), (1007, 2, 0.05, 10.5), (2007, 1, 0.1, None), (2007, 2, 0.1, 11.0)]


def test_a_small_file_of_options_is_dealt_out(spark):
    from barloom.plans import derivatives as V

    n = V.chain(spark, "/root/testdata/sf0.1").select("symbol").rdd.glom().map(len).collect()
    assert len(n) >= 2 and sum(n) == 280_000 and max(n) < 0.7 * sum(n)


def test_current_value_never_counts_itself(spark):
    """Rows whose value is not the same twice, like a sum of doubles added up in another order."""
    from pyspark.sql import functions as F

    from barloom.operators import fundamentals as U

    d = spark.range(200).select((F.col("id") % 20).alias("code"), F.date_add(F.lit("2024-01-01").cast("date"), F.floor(F.col("id") / 20).cast("int")).alias("date"))
    noisy = F.udf(lambda k: 10.0 + k + __import__("random").random() / 10, "double").asNondeterministic()
    d = d.withColumn("pe", noisy(F.dayofmonth("date")))
    assert {r.percentile for r in U.history_percentile(d, ("pe",)).collect()} == {90.0}


def test_broker_holdings_are_made_in_tasks_of_bounded_size(spark):
    from barloom.plans import derivatives as V

    plan = V._holdings(spark, "/root/testdata/sf0.1")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_NUM") == 1 and "ENSURE_REQUIREMENTS" not in plan.split("REPARTITION_BY_NUM")[0]


def test_chain_steps_equal_the_one_expression(spark):
    from pyspark.sql import functions as F

    from barloom.functions.solvers import option_price, with_option_price
    from barloom.operators.derivatives import with_greeks

    rows = [(100.0, k, t, 0.2, call) for k in (80.0, 100.0, 125.0) for t in (0.0, 5e-7, 0.3) for call in (True, False)]
    df = spark.createDataFrame(rows, "spot double, strike double, t double, sigma double, call boolean")
    one = df.withColumn("price", option_price(*(F.col(x) for x in ("spot", "strike", "t")), 0.02, F.col("sigma"), F.col("call"))).collect()
    steps = with_option_price(df, 0.02)
    assert steps.collect() == one
    greeks = with_greeks(steps, 0.02)
    assert all(r.delta == r.rho == 0 for r in greeks.collect() if r.t <= 1e-6) and len(greeks.columns) == 11
    plan = greeks._jdf.queryExecution().optimizedPlan().toString().lower()
    assert plan.count("ln(") <= 2           # once for the price, once for the Greeks; as one expression it stands at every use


def test_reversal_scores_every_text_once(spark):
    from barloom.operators import text as T

    docs = spark.createDataFrame([(i, i % 3, "x", "up" if i > 4 else "down" * (i + 1)) for i in range(9)], "doc_id int, day int, lang string, text string")
    posts = T.lexicon_score(docs, {"up": 1.0, "down": -1.0})
    got = T.sentiment_reversal(posts, ["lang"], ["day", "doc_id"])
    assert "MapInArrow" not in got._jdf.queryExecution().executedPlan().toString()     # scores are stored, no plan reads the texts again
    by_day = [r.score for r in posts.orderBy("day", "doc_id").collect()]
    row = got.first()
    assert (row.posts, row.early, row.late) == (9, sum(by_day[:4]) / 4, sum(by_day[4:]) / 5)
