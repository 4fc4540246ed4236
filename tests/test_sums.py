"""Results must not hang on the order in which rows are added up."""

import datetime as dt
import math

from pyspark.sql import functions as F

import __spark_entry__ as entry
from barloom.functions.sums import exact_mean, exact_sum
from barloom.operators import fundamentals as U
from barloom.plans.registry import shape

PRICES = [330318.59, 357744.67, 218771.92]     # added up forwards and backwards they differ in the last digit
SCHEMA = ("l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, "
          "l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp")


def line(i, part=1, supplier=0, price=1000.0, quantity=2.0, discount=0.05, flag="N", day=dt.datetime(1998, 3, 5)):
    return i, part, supplier, 1, quantity, price, discount, 0.04, flag, "O", day


def tables(spark, folder, lines, parts=()):
    """A folder with ``lines`` in this order in one file, and ``parts`` as (key, size)."""
    spark.createDataFrame(lines, SCHEMA).coalesce(1).write.parquet(f"{folder}/lineitem.parquet")
    spark.createDataFrame([(k, "red bolt", "STANDARD", "Brand#11", s, 1000.0) for k, s in parts],
                          "p_partkey long, p_name string, p_type string, p_brand string, p_size int, p_retailprice double").coalesce(1).write.parquet(f"{folder}/part.parquet")
    return str(folder)


def test_exact_sum(spark):
    v = [0.1, 1e9, -1e9, 0.3, 2.0 ** -40, None]
    for values in (v, v[::-1], v * 3):
        r = spark.createDataFrame([(x,) for x in values], "x double").repartition(3).agg(exact_sum("x"), exact_mean("x")).first()
        kept = [x for x in values if x is not None]
        assert r[0] == math.fsum(kept) and r[1] == math.fsum(kept) / len(kept)
    odd = lambda *x: spark.createDataFrame([(y,) for y in x], "x double").agg(exact_sum("x")).first()[0]
    assert odd(None) is None and odd(1.0, math.inf) == math.inf and math.isnan(odd(1.0, math.nan)) and math.isnan(odd(math.inf, -math.inf))
    assert odd(1e300, 1e300) == 2e300 and odd(5e-324, None) == 5e-324


def test_equal_pe_has_equal_percentile(spark, tmp_path):
    """u24: suppliers 0 and 6 (one industry) traded the same, in another order; supplier 12 traded lower."""
    lines = [line(i, supplier=s, price=p) for s, ps in ((0, PRICES), (6, PRICES[::-1]), (12, [5000.0])) for i, p in enumerate(ps)]
    got = {r.code: r.percentile for r in entry.queries()["u24_industry_percentile"](spark, tables(spark, tmp_path, lines)).collect()}
    assert got == {0: 33.333333, 6: 33.333333, 12: 0.0}


def test_equal_surprises_share_a_quintile(spark, tmp_path):
    """u26: two suppliers whose quarters hold the same trades, added up in another order."""
    quarters = [dt.datetime(1995 + q // 4, q % 4 * 3 + 1, 5) for q in range(11)]
    lines = []
    for s in (0, 1):
        for q, day in enumerate(quarters):
            trades = [(p + q * 1000.77 * (q % 3 + 1), f) for p, f in zip(PRICES, "RAN")] + [(p / 3 + q, "R") for p in PRICES]
            lines += [line(i, supplier=s, price=round(p, 2), flag=f, day=day) for i, (p, f) in enumerate(trades if s == 0 else trades[::-1])]
    got = entry.queries()["u26_pead"](spark, tables(spark, tmp_path, lines)).collect()
    assert len(got) == 6
    for day in {r.end_date for r in got}:
        one, two = [(r.quintile, r.side) for r in got if r.end_date == day]
        assert one == two


def test_mean_change_on_a_bound(spark, tmp_path):
    """e23: two bonds with the same trades, whose mean discount puts the change on the bound, have one label."""
    discounts = [6, 7, 3, 3, 7, 0, 4, 0]
    lines = [line(i, part=k, discount=x / 100) for k, xs in ((1, discounts), (2, sorted(discounts)), (3, sorted(discounts, reverse=True))) for i, x in enumerate(xs)]
    got = {r.code: r.abnormal for r in entry.queries()["e23_abnormal_bonds"](spark, tables(spark, tmp_path, lines, [(1, 5), (2, 5), (3, 5)])).collect()}
    assert got == {1: "medium", 2: "medium", 3: "medium"}


def test_chips_whose_share_is_a_bound(spark):
    """u32: 171 of 180 shares lie at the eighth price or below, which is 95 % and not a last digit less."""
    shares = [21, 6, 34, 12, 30, 35, 6, 27, 9]
    chips = spark.createDataFrame([(1, 100.0 * (i + 1), x * 100 / 180) for i, x in enumerate(shares)], "code long, price double, percent double")
    got = U.chip_distribution(chips, spark.createDataFrame([(1, 400.0)], "code long, current double")).first()
    assert (got.cost5, got.cost95) == (100.0, 800.0)


def test_output_is_rounded_as_in_the_sql(spark, duck):
    """u24 and all others: the same double gives the same digits, also next to a half."""
    near = [(k + 0.5) / 1e6 for k in range(39_493_000, 39_494_000)]
    odd = [None, 0.0, -0.0, 1e300, 1.7e308, -2.5e-6, math.inf, -math.inf, math.nan]
    values = near + [math.nextafter(x, 0) for x in near] + [-x for x in near] + odd
    got = shape(spark.createDataFrame([(i, x) for i, x in enumerate(values)], "i long, x double"), "i:i x:f6").orderBy("i").collect()
    for r, x in zip(got, values):
        want = duck.execute("SELECT round(CAST(? AS DOUBLE), 6) + 0e0", [x]).fetchone()[0]
        assert r.x == want or (math.isnan(r.x) and math.isnan(want)), x
