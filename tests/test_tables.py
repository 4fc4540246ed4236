"""Readers, writers, streaming, report text and fund names."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from barloom.operators import bonds_funds as E
from barloom.operators import screens, text
from barloom.operators import factors as Fx
from barloom.sources import panels
from barloom.streaming import bars as SB


def test_wide_csv_panels(spark, tmp_path):
    for name in ("ep", "bp"):
        (tmp_path / f"{name}.csv").write_text("date,A,B\n2024-01-02,1.5,2\n2024-01-03,,4\n")
    one = panels.load_panel(spark, str(tmp_path / "ep.csv"))
    assert sorted(map(tuple, one.collect())) == [(dt.date(2024, 1, 2), "A", 1.5), (dt.date(2024, 1, 2), "B", 2.0), (dt.date(2024, 1, 3), "B", 4.0)]
    both = panels.load_panel_dir(spark, [str(tmp_path / "ep.csv"), str(tmp_path / "bp.csv")])
    wide = panels.long_to_wide(both, ["ep", "bp"])
    assert wide.count() == 3 and set(wide.columns) == {"date", "code", "ep", "bp"}


def test_save_results(spark, tmp_path):
    ic = spark.createDataFrame([(dt.date(2024, 1, 1), 0.1, 9)], "date date, ic double, n long")
    panels.save_results(ic, Fx.ic_summary(ic), ic.select(F.lit(1).alias("grp")), str(tmp_path))
    assert spark.read.json(str(tmp_path / "ic_summary")).first().n_periods == 1
    assert spark.read.option("header", True).csv(str(tmp_path / "ic_series")).count() == 1


def test_stream_bars_equal_batch_bars(spark, tmp_path):
    ev = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select(
        F.col("event_type").alias("code"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"), F.col("value").alias("price"), F.lit(1.0).alias("volume"))
    ev.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = (SB.stream_bars(stream, "1 day", "60 days").writeStream.outputMode("complete").format("memory").queryName("bars_out").start())
    q.processAllAvailable()
    q.stop()
    got = {(r.code, r.ts): (r.open, r.close, r.high, r.volume) for r in spark.sql("select * from bars_out").collect()}
    want = ev.groupBy("code", F.date_trunc("day", "ts").alias("ts")).agg(
        F.min_by("price", F.struct("ts", "seq")).alias("o"), F.max_by("price", F.struct("ts", "seq")).alias("c"), F.max("price").alias("h"), F.sum("volume").alias("v"))
    assert got == {(r.code, r.ts): (r.o, r.c, r.h, r.v) for r in want.collect()}


def test_month_sink_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "bars")
    b = spark.createDataFrame([("a", dt.date(2024, 1, 5), 1.0), ("a", dt.date(2024, 2, 5), 2.0)], "code string, ts date, close double")
    write = SB.month_sink(path)
    write(b, 0)
    write(b.where("ts >= '2024-02-01'").withColumn("close", F.lit(3.0)), 1)
    write(b.where("ts >= '2024-02-01'").withColumn("close", F.lit(3.0)), 1)
    assert sorted((r.ts.month, r.close) for r in spark.read.parquet(path).collect()) == [(1, 1.0), (2, 3.0)]


def test_report_facts(spark):
    d = spark.createDataFrame([("给予买入评级", "目标价：12.5元，逻辑清晰"), ("点评", "35元目标价 维持增持"), ("无", "无")], "title string, body string")
    got = text.report_facts(d).select("rating", "target_price", "has_analysis").collect()
    assert [tuple(r) for r in got] == [("买入", 12.5, True), ("增持", 35.0, False), (None, None, False)]


def test_date_filter_keeps_unreadable_dates(spark):
    d = spark.createDataFrame([("2024-05-01",), ("2023-01-01",), ("2024-05-02 10:00:00",), ("soon",), (None,)], "publish_date string")
    assert text.date_filter(d, F.lit("2024-01-01").cast("date")).count() == 4


def test_negation_turns_a_word(spark):
    d = spark.createDataFrame([("x利好",), ("不利好",), ("",)], "text string")
    got = [r.score for r in text.lexicon_score(d, {"利好": 0.6}, ["不"]).collect()]
    assert got[0] == 0.6 and abs(got[1] + 0.42) < 1e-12 and got[2] == 0.0


def test_fund_classes(spark):
    d = spark.createDataFrame([("货币A", "货币型"), ("黄金ETF", "股票型"), ("恒生科技ETF", "股票型"), ("沪深300ETF", "股票型"), ("医药ETF", "股票型")], "n string, t string")
    got = [r[0] for r in d.select(E.classify_fund(F.col("n"), F.col("t"), ["沪深300"], ["恒生科技"])).collect()]
    assert got == ["money", "commodity", "cross_border", "broad", "sector"]


def test_structured_screen_rejects_unknown_fields(spark):
    import pytest

    d = spark.createDataFrame([(1, 2.0)], "code int, pe double")
    assert screens.structured_screen(d, [("pe", "between", (1, 3))]).count() == 1
    for bad in ([("roe", ">", 1)], [("pe", "like", 1)]):
        with pytest.raises(ValueError):
            screens.structured_screen(d, bad)


def test_refresh_keeps_the_last_fresh_row(spark):
    from barloom.operators import bars as B

    ddl = "code string, ts date, close double, ingested int"
    old = spark.createDataFrame([("a", dt.date(2024, 1, 4), 1.0, 1), ("a", dt.date(2024, 1, 5), 2.0, 1)], ddl)
    new = spark.createDataFrame([("a", dt.date(2024, 1, 5), 7.0, 2), ("a", dt.date(2024, 1, 5), 3.0, 3), ("b", dt.date(2024, 1, 5), 9.0, 2)], ddl)
    got = {(r.code, r.ts.day): r.close for r in B.refresh(old, new, order="ingested").collect()}
    assert got == {("a", 4): 1.0, ("a", 5): 3.0, ("b", 5): 9.0} and B.refresh(old, new).count() == 3


def test_stream_refresh_lets_a_late_correction_win(spark, tmp_path):
    ddl = "code string, ts timestamp, close double, ingested int"
    day = dt.datetime(2024, 1, 5)
    path = str(tmp_path / "in")
    seen = {}

    def sink(batch, epoch):
        seen.update({(r.code, r.ts): r.close for r in batch.collect()})

    q = SB.stream_refresh(spark.readStream.schema(ddl).parquet(path)) if (tmp_path / "in").mkdir() is None else None
    run = q.writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", str(tmp_path / "cp")).start()
    for k, close in ((1, 5.0), (3, 6.0), (2, 4.0)):     # the last arrival is the older version
        spark.createDataFrame([("a", day, close, k)], ddl).write.mode("append").parquet(path)
        run.processAllAvailable()
    run.stop()
    assert seen == {("a", day): 6.0}


def test_signal_rows_keep_both_parts(spark):
    from barloom.operators import signals as G

    wide = spark.createDataFrame([("x", 1, "多头", "任意", "强"), ("x", 2, "空头", "确认", G.NONE)], "code string, ts int, tas_a string, tas_a_v2 string, bar_b string")
    got = sorted((r.ts, r.name, r.category, r.v1) for r in G.signal_rows(wide, "day").collect())
    assert got == [(1, "bar_b", "bar", "强"), (1, "tas_a", "tas", "多头"), (2, "tas_a", "tas", "空头_确认")]


def test_longer_entry_wins_by_number_of_characters(spark):
    from barloom.operators import structures as X

    label = "abcdefghij_tail"
    rows = spark.createDataFrame([("x", 1, "n", label)], "code string, ts int, name string, v1 string")
    table = spark.createDataFrame([("n", label[:9], 1.0), ("n", label[:10], 2.0)], "name string, value string, score double")
    assert X.score_signals(rows, table).first().score == 2.0


def test_fund_flow_reads_every_date_of_the_window(spark):
    day = dt.date(2024, 6, 1)
    rows = [("a", day + dt.timedelta(days=i), float(10 + i), 5.0) for i in range(40)]
    got = screens.fund_flow(spark.createDataFrame(rows, "code string, date date, rzmre double, rzye double"), days=30).first()
    assert abs(got.buy_trend - ((48.5 / 20.5) - 1) * 100) < 1e-9     # the last 30 days run from 10 + 10 to 10 + 39


def test_walk_forward_has_no_window_over_the_returns(spark):
    from barloom.operators import portfolio as P

    r = spark.range(400).select((F.col("id") % 2).cast("int").alias("pid"), F.expr("date_add(date'2024-01-01', cast(id / 2 as int))").alias("date"), F.sin("id").alias("net"))
    assert {x.win for x in P.walk_forward(r).collect()} == {0, 1, 2, 3}


@pytest.mark.parametrize("seed", range(5))
def test_word_hits_equal_str_count(seed):
    import random

    from barloom.operators import text as T

    pick = random.Random(seed)
    words = ["ab", "aba", "b", "aa", "éa", "ca", "abab"]
    value = "".join(pick.choice("abcé ") for _ in range(300))
    counts, first = T.word_hits(T._automaton(words), len(words), value)
    assert counts == [value.count(w) for w in words] and first == [value.find(w) for w in words]


def test_lexicon_scores_odd_rows(spark):
    from barloom.operators import text as T

    docs = spark.createDataFrame([(1, None), (2, ""), (3, "good good"), (4, "not good"), (5, "very good"), (6, "bad " * 50_000)], "i int, text string")
    rows = {r.i: (r.hits, r.score) for r in T.lexicon_score(docs, {"good": 0.5, "bad": -0.4}, ["t "], {"very": 2.0}).collect()}
    assert rows == {1: (None, 0.0), 2: (0.0, 0.0), 3: (2.0, 0.5), 4: (1.0, -0.35), 5: (1.0, 1.0), 6: (50_000.0, pytest.approx(-0.4))}
    assert T.lexicon_score(docs.limit(0), {"good": 0.5}).count() == 0
