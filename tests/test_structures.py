"""Folds against plain restatements of their rules, and properties of the structures."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from barloom.functions.recursive import hurst_exponent, parabolic_stop
from barloom.operators import structures as X


def frame(lows, highs):
    n = len(lows)
    o = [(a + b) / 2 for a, b in zip(lows, highs)]
    return pd.DataFrame({"code": "a", "ts": [dt.date(2024, 1, 1) + dt.timedelta(days=i) for i in range(n)], "open": o, "high": highs, "low": lows, "close": o,
                         "volume": [1.0] * n, "amount": [2.0] * n})


pairs = st.lists(st.tuples(st.integers(1, 60), st.integers(0, 30)), min_size=1, max_size=60)


@settings(max_examples=200, deadline=None)
@given(pairs)
def test_merged_bars_never_contain_each_other(xs):
    pdf = frame([float(a) for a, _ in xs], [float(a + b) for a, b in xs])
    out = X._merge_pdf(pdf)
    h, l = out["high"].to_numpy(), out["low"].to_numpy()
    for i in range(len(out) - 1):
        assert not (h[i] >= h[i + 1] and l[i] <= l[i + 1]) and not (h[i + 1] >= h[i] and l[i + 1] <= l[i])
    assert out["volume"].sum() == len(xs) and out["n_merged"].sum() == len(xs)
    assert out["ts"].is_monotonic_increasing


def test_merge_by_hand():
    # bar 2 lies inside bar 1 and there is no earlier bar: rising rule, higher low kept
    out = X._merge_pdf(frame([10.0, 12.0, 20.0], [20.0, 18.0, 30.0]))
    assert out[["low", "high", "n_merged"]].values.tolist() == [[12.0, 20.0, 2], [20.0, 30.0, 1]]


def test_segment_closes_on_a_feature_fractal():
    # up-segment whose three counter-strokes end at 5, 8, 6: the middle one is a peak
    starts = [1, 10, 5, 14, 8, 12, 6]
    ends = [10, 5, 14, 8, 12, 6, 9]
    d = [1, -1, 1, -1, 1, -1, 1]
    s = [0.1 * (k + 1) for k in range(7)]           # rising strength: no loose closing
    got = X.segment_members(d, starts, ends, s, s)
    assert got[:5] == [(0, 0), (0, 1), (0, 2), (0, 3), (0, 4)]


def test_segment_closes_at_nine_strokes_in_loose_mode():
    d = [1, -1] * 6
    # a steadily widening zigzag: counter-strokes contain each other, so no fractal forms
    starts = [100 - 5 * k if k % 2 == 0 else 105 + 5 * k for k in range(12)]
    ends = starts[1:] + [starts[-1] - 100]
    s = [0.1 * (k + 1) for k in range(12)]
    got = X.segment_members(d, starts, ends, s, s)
    assert [p for seg, p in got if seg == 0] == list(range(8))


def test_standard_features_drop_contained_counter_strokes():
    # an up-segment: counter-strokes 10-5, 9-6 (inside the first), 14-8 and 15-7 (around the one before)
    d = [1, -1, 1, -1, 1, -1, 1, -1, 1]
    a = [1, 10, 5, 9, 6, 14, 8, 15, 7]
    b = [10, 5, 9, 6, 14, 8, 15, 7, 20]
    pairs = [(0, p) for p in range(9)]
    got = X.standard_features(pairs, d, a, b)
    assert [p for (_, p), kept in zip(pairs, got, strict=True) if kept] == [1, 7]


def test_features_start_anew_in_each_segment():
    d = [1, -1, 1, -1, 1, -1]
    a, b = [1, 9, 3, 8, 4, 7], [9, 3, 8, 4, 7, 5]  # every counter-stroke lies inside the one before
    assert X.standard_features([(0, 0), (0, 1), (0, 2), (1, 2), (1, 3), (1, 4), (1, 5)], d, a, b) == [False, True, False, False, True, False, False]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 40), st.integers(0, 6), st.sampled_from(["up", "down", None])), max_size=40))
def test_gap_fill_equals_a_search_from_every_gap(xs):
    low, high = [a for a, _, _ in xs], [a + b for a, b, _ in xs]
    gap, edge = [g for _, _, g in xs], [(a + 2 if g == "down" else a - 2) if g else None for a, _, g in xs]
    want = []
    for t in range(len(xs)):
        hits = [j - t for j in range(t + 1, len(xs)) if gap[t] and (low[j] <= edge[t] if gap[t] == "up" else high[j] >= edge[t])]
        want.append(hits[0] if hits else None)
    got = X.bars_to_fill(high, low, gap, edge)
    assert [None if np.isnan(x) else x for x in got] == want


def test_gap_fill_of_a_long_series_is_fast():
    import time

    n = 100_000
    low = list(range(n))
    start = time.time()
    got = X.bars_to_fill([x + 0.5 for x in low], low, ["up"] * n, [x - 0.25 for x in low])
    assert np.isnan(got).all() and time.time() - start < 1


def brute_zones(high, low, lo, hi, d):
    """The same rule with every range taken afresh from the segments it covers."""
    out, i = [], 0
    while i <= len(high) - 3:
        def rng(a, b):
            t, f = min(high[a:b]), max(low[a:b])
            return (t, f) if t > f else (min(high[a:a + 3]), max(low[a:a + 3]))
        t, f = min(high[i:i + 3]), max(low[i:i + 3])
        mean = sum(high[k] - low[k] for k in range(i, i + 3)) / 3
        if not t > f or (mean > 0 and (t - f) / mean < 0.01):
            i += 1
            continue
        n = 3
        while i + n < len(high) and n < 12:
            t, f = rng(i, i + n)
            p = min(hi[i + n], t) - max(lo[i + n], f)
            if not (p > 0 and hi[i + n] > lo[i + n] and p / (hi[i + n] - lo[i + n]) >= 0.01):
                break
            n += 1
        if len(set(d[i:i + n])) < 2:
            i += 1
            continue
        t, f = rng(i, i + n)
        out.append((i, i + n - 1, f, t))
        i += n
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 50), st.integers(1, 20)), max_size=40))
def test_zones_equal_brute_force(xs):
    lo, hi = [float(a) for a, _ in xs], [float(a + b) for a, b in xs]
    d = [1 if k % 2 else -1 for k in range(len(xs))]
    assert X.grow_zones(hi, lo, lo, hi, d) == brute_zones(hi, lo, lo, hi, d)


def test_hurst_equals_plain_loops():
    rng = np.random.default_rng(5)
    close = np.exp(np.cumsum(rng.normal(0, 0.02, 130)))
    got = hurst_exponent(close, 100)
    assert np.isnan(got[:99]).all()
    for end in (99, 120, 129):
        r = np.diff(np.log(close[end - 99:end + 1]))
        xs, ys = [], []
        for k in range(5, 21):
            m = len(r) // k
            vals = []
            for i in range(k):
                part = r[i * m:(i + 1) * m]
                walk = np.cumsum(part - part.mean())
                if part.std() > 0:
                    vals.append((walk.max() - walk.min()) / part.std())
            xs.append(np.log(m))
            ys.append(np.log(np.mean(vals)))
        assert got[end] == pytest.approx(np.polyfit(xs, ys, 1)[0], rel=1e-9)


def test_parabolic_stop_trails_a_rise():
    h = np.arange(10.0, 40.0)
    s = parabolic_stop(h, h - 1)
    assert (s[1:] < h[1:] - 1 + 1e-9).all() and (np.diff(s) >= 0).all()


def test_segments_of_the_given_data_are_ordered(spark):
    from barloom.plans import structures as P

    segs = P.segments(spark, "/root/testdata/sf0.001").toPandas().sort_values(["code", "seq"])
    assert len(segs) > 0 and (segs["n_strokes"] >= 3).all() and (segs["integrity"] >= 0.5).all()
    for _, g in segs.groupby("code"):
        assert (g["start_ts"].to_numpy()[1:] >= g["start_ts"].to_numpy()[:-1]).all()


def test_signal_shift_reads_back(spark):
    from barloom.operators.signals import signal_frame
    from barloom.plans import bindings as D

    b = D.brand_bars(spark, "/root/testdata/sf0.001", "month")
    now = signal_frame(b, ["bar_zdf"]).toPandas().sort_values(["code", "ts"])
    back = signal_frame(b, ["bar_zdf"], di=3).toPandas().sort_values(["code", "ts"])
    a, z = now[now.code == "Brand#1"]["bar_zdf"].tolist(), back[back.code == "Brand#1"]["bar_zdf"].tolist()
    assert z[2:] == a[:-2] and z[:2] == ["其他", "其他"]


SEG = "code string, seq long, dir int, start_ts date, end_ts date, start_price double, end_price double, high double, low double"


def seg_rows(code, ends):
    day = lambda i: dt.date(2024, 1, 1 + i)
    return [(code, i + 1, 1 if b > a else -1, day(i), day(i + 1), float(a), float(b), float(max(a, b)), float(min(a, b))) for i, (a, b) in enumerate(ends)]


def test_codes_without_a_zone(spark):
    few, many = [(10, 20), (20, 12)], [(10, 20), (20, 12), (12, 19), (19, 13), (13, 18)]
    alone = X.zones(spark.createDataFrame(seg_rows("a", few), SEG))
    assert alone.collect() == []
    both = X.zones(spark.createDataFrame(seg_rows("a", few) + seg_rows("b", many), SEG)).collect()
    assert [(r.code, r.zone, r.first_seq, r.start_ts) for r in both] == [("b", 1, 1, dt.date(2024, 1, 1))]


def test_codes_without_a_segment(spark):
    st = spark.createDataFrame([("a", 1, 1, 10.0, 20.0, 0.5, 1.0)], "code string, seq long, dir int, start_price double, end_price double, strength double, amplitude double")
    assert X.segment_strokes(st).collect() == []


def test_scores_without_an_order_prefer_the_longer_entry(spark):
    rows = spark.createDataFrame([("x", 1, "n", "abcdef")], "code string, ts int, name string, v1 string")
    table = spark.createDataFrame([("n", "abc", 1.0), ("n", "abcde", 2.0)], "name string, value string, score double")
    assert X.score_signals(rows, table).first().score == 2.0
