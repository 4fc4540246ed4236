"""Price structures: merged bars, fractals, strokes, segments, pivot zones, points and their scoring.

Each structure is its own table keyed by (code, seq). Only three steps keep state along a series
(inclusion merge, segment closing, zone growing); each is a short fold over one code's bars or
strokes, run by Spark per code. Everything else is windows, joins and aggregates.
"""

from __future__ import annotations

import heapq
from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.windows import Series, ladder, ratio

c = F.col
S = Series()
Q = Series(("code",), ("seq",))


# ---- inclusion merge -----------------------------------------------------------------------------

def _merge_pdf(pdf: pd.DataFrame) -> pd.DataFrame:
    """A bar inside its left neighbour (or around it) joins it; rising neighbours keep the higher edges,
    falling ones the lower, then the range is widened to hold open and close."""
    pdf = pdf.sort_values("ts")
    done: list[list] = []           # ts, open, high, low, close, volume, amount, n_merged
    for bar in pdf[["ts", "open", "high", "low", "close", "volume", "amount"]].itertuples(index=False, name=None):
        cur = [*bar, 1]
        while done:
            top = done[-1]
            if not ((top[2] >= cur[2] and top[3] <= cur[3]) or (cur[2] >= top[2] and cur[3] <= top[3])):
                break
            pick = max if len(done) < 2 or top[2] > done[-2][2] else min
            o, cl = top[1], cur[4]
            cur = [cur[0], o, max(pick(top[2], cur[2]), o, cl), min(pick(top[3], cur[3]), o, cl), cl,
                   top[5] + cur[5], top[6] + cur[6], top[7] + cur[7]]
            done.pop()
        done.append(cur)
    out = pd.DataFrame(done, columns=["ts", "open", "high", "low", "close", "volume", "amount", "n_merged"])
    out.insert(0, "code", pdf["code"].iloc[0])
    return out


def merge_inclusions(bars: DataFrame) -> DataFrame:
    """Bars without any neighbour containing another."""
    b = bars.select("code", "ts", "open", "high", "low", "close", "volume", "amount")
    code, ts = b.schema["code"].dataType.simpleString(), b.schema["ts"].dataType.simpleString()
    return b.groupBy("code").applyInPandas(
        _merge_pdf, f"code {code}, ts {ts}, open double, high double, low double, close double, volume double, amount double, n_merged long")


def inclusion_test(bars: DataFrame) -> DataFrame:
    """Each bar against the one before: ``holds`` it, lies ``inside`` it (equal ranges count as that), or ``none``."""
    ph, pl = S.lag("high"), S.lag("low")
    kind = ladder(((ph >= c("high")) & (pl <= c("low")), "inside"), ((c("high") >= ph) & (c("low") <= pl), "holds"), default="none")
    return bars.select("code", "ts", "high", "low", ph.alias("p_high"), pl.alias("p_low"), kind.alias("inclusion")).where(c("p_high").isNotNull())


def merge_direction(bars: DataFrame) -> DataFrame:
    """The direction in which a bar would join the one before: rising if that one's high passed its own predecessor's, or
    if it has none."""
    up = S.lag("high", 2).isNull() | (S.lag("high") > S.lag("high", 2))
    return bars.select("code", "ts", S.lag("high").alias("_p"), F.when(up, "up").otherwise("down").alias("direction")).where(c("_p").isNotNull()).drop("_p")


def merge_pairs(bars: DataFrame) -> DataFrame:
    """Every bar that includes or is included by the one before, and the bar the two make: higher edges when rising, lower
    ones when falling, widened to hold the first open and the last close."""
    p = {x: S.lag(x) for x in ("open", "high", "low")}
    d = bars.select("code", "ts", "high", "low", "close", *[x.alias(f"p_{k}") for k, x in p.items()])
    d = d.join(inclusion_test(bars).where("inclusion <> 'none'").select("code", "ts", "inclusion"), ["code", "ts"]).join(merge_direction(bars), ["code", "ts"])
    up = c("direction") == "up"
    high = F.when(up, F.greatest("p_high", "high")).otherwise(F.least("p_high", "high"))
    low = F.when(up, F.greatest("p_low", "low")).otherwise(F.least("p_low", "low"))
    return d.select("code", "ts", "inclusion", "direction", c("p_open").alias("open"), F.greatest(high, "p_open", "close").alias("high"), F.least(low, "p_open", "close").alias("low"), "close")


# ---- fractals ------------------------------------------------------------------------------------

def fractals(bars: DataFrame, strict: bool = True) -> DataFrame:
    """Tops and bottoms against both neighbours (strictly, or allowing equal edges), with their measures."""
    h, l, v = c("high"), c("low"), c("volume")
    ph, nh, pl, nl = S.lag("high"), S.lead("high"), S.lag("low"), S.lead("low")
    over = (lambda a, b: a > b) if strict else (lambda a, b: a >= b)
    top = over(h, ph) & over(h, nh) & over(l, pl) & over(l, nl)
    bottom = over(ph, h) & over(nh, h) & over(pl, l) & over(nl, l)
    d = bars.select("code", "ts", "open", "close", "high", "low", "volume", S.idx().alias("i"), F.when(top, 1).when(bottom, -1).alias("kind"),
                    F.greatest(ph, nh).alias("_mh"), F.least(pl, nl).alias("_ml"), ((S.lag("volume") + S.lead("volume")) / 2).alias("_mv"),
                    F.least(pl, l, nl).alias("win_low"), F.greatest(ph, h, nh).alias("win_high"),
                    F.count(F.lit(1)).over(S.w.rowsBetween(2, 4)).alias("after"))
    d = d.where(c("kind").isNotNull())
    up = c("kind") == 1
    strength = F.when(up, F.greatest(F.lit(0.0), ratio(h - c("_mh"), "_mh"))).otherwise(F.greatest(F.lit(0.0), ratio(c("_ml") - l, "_ml")))
    conf = ladder((c("after") <= 0, 0.0), (c("after") == 1, 0.6), (c("after") == 2, 0.8), default=1.0)
    return d.select("code", "ts", "i", "kind", F.when(up, h).otherwise(l).alias("price"), "high", "low", "open", "close", "win_low", "win_high",
                    strength.alias("strength"), F.coalesce(ratio("volume", "_mv"), F.lit(1.0)).alias("volume_ratio"), conf.alias("confidence"))


def reduce_fractals(fx: DataFrame, keep: str = "first") -> DataFrame:
    """One fractal per run of the same kind: the first, or the most extreme (earliest wins ties)."""
    d = fx.withColumn("_new", F.when(c("kind").eqNullSafe(S.lag("kind")), 0).otherwise(1))
    if keep == "first":
        out = d.where("_new = 1").drop("_new")
    else:
        d = d.withColumn("_run", F.sum("_new").over(S.run()))
        w = Window.partitionBy("code", "_run").orderBy(F.desc(c("price") * c("kind")), "ts")
        out = d.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_new", "_run", "_r")
    return out.withColumn("seq", F.row_number().over(S.w))


# ---- strokes -------------------------------------------------------------------------------------

def pair_modes(fx: DataFrame) -> DataFrame:
    """Which of the four pair rules (strict, totally, loss, half) each fractal and its successor pass."""
    n = {k: Q.lead(k) for k in ("kind", "price", "high", "low", "win_low", "win_high")}
    up = c("kind") == -1
    d = fx.select("code", "seq", "ts", "kind", "price", "win_low", "win_high", *[v.alias(f"n_{k}") for k, v in n.items()]).where(c("n_kind").isNotNull())
    strict = F.when(up, c("win_low") < c("n_win_low")).otherwise(c("win_high") > c("n_win_high"))
    totally = F.when(up, c("win_high") < c("n_win_low")).otherwise(c("win_low") > c("n_win_high"))
    loss = F.when(up, c("price") < c("n_low")).otherwise(c("price") > c("n_high"))
    # with one neighbour on each side the half rule has no second bar and equals the strict rule
    return d.select("code", "seq", strict.alias("strict"), totally.alias("totally"), loss.alias("loss"), strict.alias("half"))


def strokes(fx: DataFrame, bars: DataFrame) -> DataFrame:
    """Adjacent opposite fractals and the bars between them, ends included.

    Every bar is tied to its stroke by filling the last fractal forward; a bar on a fractal belongs to
    both sides. No range join is needed.
    """
    ends = fx.select("code", "seq", "kind", "ts", "price", Q.lead("ts").alias("end_ts"), Q.lead("price").alias("end_price"), Q.lead("i").alias("end_i")).where(c("end_ts").isNotNull())
    at = bars.join(fx.select("code", "ts", c("seq").alias("_f")), ["code", "ts"], "left")
    at = at.select("code", "ts", "high", "low", "close", "volume", "_f", F.last("_f", ignorenulls=True).over(S.run()).alias("_s"))
    member = at.where(c("_s").isNotNull()).select("*", F.explode(F.when(c("_f").isNotNull(), F.array(c("_s"), c("_s") - 1)).otherwise(F.array("_s"))).alias("seq"))
    w = Window.partitionBy("code", "seq").orderBy("ts")
    member = member.join(ends.select("code", "seq", (-c("kind")).alias("dir")), ["code", "seq"]).withColumn("_pc", F.lag("close").over(w))
    moved = F.when(c("_pc").isNotNull(), F.when(c("dir") == 1, c("close") >= c("_pc")).otherwise(c("close") <= c("_pc")).cast("int"))
    g = member.groupBy("code", "seq").agg(F.max("high").alias("high"), F.min("low").alias("low"), F.count(F.lit(1)).alias("n_bars"),
                                          F.sum("volume").alias("volume"), F.coalesce(F.avg(moved), F.lit(1.0)).alias("purity"))
    d = ends.select("code", "seq", (-c("kind")).alias("dir"), c("ts").alias("start_ts"), "end_ts", "end_i", c("price").alias("start_price"), "end_price").join(g, ["code", "seq"])
    amp = F.abs(ratio(c("end_price") - c("start_price"), "start_price"))
    return d.withColumn("amplitude", amp).withColumn("strength", c("amplitude") * 0.7 + F.least(F.lit(1.0), c("volume") / c("n_bars") / 1e6) * 0.3)


def stroke_relations(st: DataFrame) -> DataFrame:
    """Overlap with, retracement of and golden-ratio distance to the previous stroke."""
    lo, hi = F.least("start_price", "end_price"), F.greatest("start_price", "end_price")
    d = st.select("code", "seq", lo.alias("_lo"), hi.alias("_hi")).select("*", Q.lag("_lo").alias("_plo"), Q.lag("_hi").alias("_phi"))
    d = d.where(c("_plo").isNotNull())
    part = F.least("_hi", "_phi") - F.greatest("_lo", "_plo")
    smaller = F.least(c("_hi") - c("_lo"), c("_phi") - c("_plo"))
    d = d.select("code", "seq", F.when((part > 0) & (smaller > 0), part / smaller).otherwise(0.0).alias("overlap"), F.coalesce(ratio(c("_hi") - c("_lo"), c("_phi") - c("_plo")), F.lit(0.0)).alias("retracement"))
    gold = F.lit(False)
    for g in (0.382, 0.5, 0.618, 0.809):
        gold = gold | (F.abs(c("retracement") - g) <= 0.05)
    return d.withColumn("golden", gold)


def reversal_points(st: DataFrame) -> DataFrame:
    """A further extreme by the next stroke with under 0.8 of the previous stroke's strength."""
    d = st.select("code", "seq", "end_ts", "end_price", *[Q.lag(x).alias(f"p_{x}") for x in ("dir", "end_price", "strength")], *[Q.lead(x).alias(f"n_{x}") for x in ("dir", "end_price", "strength")])
    same = c("p_dir") == c("n_dir")
    further = F.when(c("p_dir") == 1, c("n_end_price") > c("p_end_price")).otherwise(c("n_end_price") < c("p_end_price"))
    d = d.where(same & further & (c("n_strength") < c("p_strength") * 0.8))
    sr = F.coalesce(ratio("n_strength", "p_strength"), F.lit(0.5))
    conf = F.lit(0.5) + ladder((sr < 0.6, 0.3), (sr < 0.8, 0.2), default=0.0) + F.when(F.abs(ratio(c("n_end_price") - c("p_end_price"), "p_end_price")) > 0.05, 0.1).otherwise(0.0)
    return d.select("code", "seq", "end_ts", "end_price", F.least(conf, F.lit(1.0)).alias("confidence"))


# ---- segments ------------------------------------------------------------------------------------

def _fades(x: Sequence[float], share: float) -> bool:
    return all(a >= b for a, b in zip(x, x[1:])) and x[-1] < x[0] * share


def _reduced(seq: list[tuple[float, float]]) -> list[int]:
    """Positions left after dropping contained ranges; a wider range replaces its predecessor."""
    kept: list[int] = []
    for i, (lo, hi) in enumerate(seq):
        if kept:
            klo, khi = seq[kept[-1]]
            if lo >= klo and hi <= khi:
                continue
            if lo <= klo and hi >= khi:
                kept[-1] = i
                continue
        kept.append(i)
    return kept


def segment_members(directions, starts, ends, strengths, amplitudes, min_count: int = 3, loose: bool = True) -> list[tuple[int, int]]:
    """(segment, stroke position) pairs. A segment closes when its counter-strokes form a fractal, and in
    loose mode also at nine strokes or when the last four fade; its last stroke seeds the next one."""
    pairs, open_, seg = [], [], 0
    for pos in range(len(directions)):
        open_.append(pos)
        if len(open_) < max(3, min_count):
            continue
        counter = [p for p in open_ if directions[p] != directions[open_[0]]]
        close = bool(counter) and loose and len(open_) >= 5 and (
            len(open_) >= 9 or _fades([strengths[p] for p in open_[-4:]], 0.7) or _fades([amplitudes[p] for p in open_[-4:]], 0.5))
        if not close and len(counter) >= 3:
            kept = _reduced([(min(starts[p], ends[p]), max(starts[p], ends[p])) for p in counter])
            if len(kept) >= 3:
                a, b, d = (ends[counter[k]] for k in kept[-3:])
                close = (b > a and b > d) or (b < a and b < d)
        if close:
            members = open_[:-1] if len(open_) > 3 else open_
            if len(members) >= min_count:
                pairs += [(seg, p) for p in members]
                seg += 1
            open_ = open_[-1:]
    if len(open_) >= min_count:
        pairs += [(seg, p) for p in open_]
    return pairs


def standard_features(pairs, directions, starts, ends) -> list[bool]:
    """Which (segment, position) pairs stay in their segment's feature sequence once contained counter-strokes are gone."""
    counter: dict[int, list[int]] = {}
    first: dict[int, int] = {}
    for seg, pos in pairs:
        if directions[pos] != directions[first.setdefault(seg, pos)]:
            counter.setdefault(seg, []).append(pos)
    kept = {(seg, at[k]) for seg, at in counter.items() for k in _reduced([(min(starts[p], ends[p]), max(starts[p], ends[p])) for p in at])}
    return [pair in kept for pair in pairs]


def _segments_pdf(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("seq").reset_index(drop=True)
    d, a, b = pdf["dir"].tolist(), pdf["start_price"].tolist(), pdf["end_price"].tolist()
    pairs = segment_members(d, a, b, pdf["strength"].tolist(), pdf["amplitude"].tolist())
    out = pdf[["code", "seq"]].iloc[[p for _, p in pairs]].reset_index(drop=True)
    out.insert(1, "seg", np.array([s for s, _ in pairs], dtype="int64"))
    return out.assign(feature=np.array(standard_features(pairs, d, a, b), dtype=bool))


def segment_strokes(st: DataFrame) -> DataFrame:
    """(code, seg, seq, feature): which strokes make up each segment, and which of them are its standard features."""
    code = st.schema["code"].dataType.simpleString()
    return st.select("code", "seq", "dir", "start_price", "end_price", "strength", "amplitude").groupBy("code").applyInPandas(
        _segments_pdf, f"code {code}, seg long, seq long, feature boolean")


def feature_sequence(st: DataFrame, members: DataFrame) -> DataFrame:
    """The standard feature sequence: strokes against their segment's direction, none contained in its neighbour."""
    return members.where("feature").join(st, ["code", "seq"])


def segments(st: DataFrame, members: DataFrame, min_amplitude: float = 0.005) -> DataFrame:
    """Segment rows with strength (.5 amplitude + .3 stroke strength + .2 direction share) and integrity
    (.7 alternation + .3 counter-stroke share); weak ones (amplitude, integrity under .5) are dropped."""
    d = members.join(st, ["code", "seq"])
    w = Window.partitionBy("code", "seg").orderBy("seq")
    d = d.select("*", F.first("dir").over(w).alias("_d"), F.row_number().over(w).alias("_k"))
    along = (c("dir") == c("_d")).cast("double")
    expected = F.when(c("_k") % 2 == 1, c("_d")).otherwise(-c("_d"))
    g = d.groupBy("code", "seg").agg(
        F.max("_d").alias("dir"), F.min("start_ts").alias("start_ts"), F.max("end_ts").alias("end_ts"), F.min_by("start_price", "seq").alias("start_price"),
        F.max_by("end_price", "seq").alias("end_price"), F.max("high").alias("high"), F.min("low").alias("low"), F.count(F.lit(1)).alias("n_strokes"), F.sum("n_bars").alias("n_bars"),
        F.avg("strength").alias("_bs"), F.avg(along).alias("_share"), F.avg((c("dir") == expected).cast("double")).alias("_alt"))
    amp = F.abs(ratio(c("end_price") - c("start_price"), "start_price"))
    g = g.withColumn("amplitude", amp).withColumn("strength", c("amplitude") * 0.5 + c("_bs") * 0.3 + c("_share") * 0.2)
    g = g.withColumn("integrity", F.when(c("n_strokes") >= 3, c("_alt") * 0.7 + (1 - c("_share")) * 0.3).otherwise(0.0))
    g = g.where((c("amplitude") >= min_amplitude) & (c("integrity") >= 0.5)).drop("_bs", "_share", "_alt")
    return g.withColumn("seq", F.row_number().over(Window.partitionBy("code").orderBy("seg"))).drop("seg")


# ---- pivot zones ---------------------------------------------------------------------------------

def grow_zones(high, low, lo_end, hi_end, direction, min_overlap: float = 0.01, max_extend: int = 9) -> list[tuple[int, int, float, float]]:
    """(first, last, low, high) position ranges: three overlapping segments of both directions, extended
    while the next one still overlaps; a zone consumes its segments."""
    out, i = [], 0
    while i + 3 <= len(high):
        top, floor = min(high[i:i + 3]), max(low[i:i + 3])
        mean = sum(h - l for h, l in zip(high[i:i + 3], low[i:i + 3])) / 3
        if top <= floor or (mean > 0 and (top - floor) / mean < min_overlap):
            i += 1
            continue
        j, base = i + 3, (top, floor)
        while j < len(high) and j - i - 3 < max_extend:
            part, size = min(hi_end[j], top) - max(lo_end[j], floor), hi_end[j] - lo_end[j]
            if part <= 0 or size <= 0 or part / size < min_overlap:
                break
            j += 1
            top, floor = min(high[i:j]), max(low[i:j])
            if top <= floor:
                top, floor = base
        if len(set(direction[i:j])) < 2:
            i += 1
            continue
        out.append((i, j - 1, floor, top))
        i = j
    return out


def _zones_pdf(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("seq").reset_index(drop=True)
    ends = pdf[["start_price", "end_price"]]
    z = grow_zones(pdf["high"].tolist(), pdf["low"].tolist(), ends.min(axis=1).tolist(), ends.max(axis=1).tolist(), pdf["dir"].tolist())
    # columns are taken from the input: a plain empty list would come out as doubles, which are no dates
    first, last = (pdf.iloc[[x[k] for x in z]].reset_index(drop=True) for k in (0, 1))
    return pd.DataFrame({
        "code": first["code"], "zone": np.arange(1, len(z) + 1), "first_seq": first["seq"], "last_seq": last["seq"], "start_ts": first["start_ts"], "end_ts": last["end_ts"],
        "low": [x[2] for x in z], "high": [x[3] for x in z], "extend_count": np.array([b - a - 2 for a, b, *_ in z], dtype="int64")})


def zones(segs: DataFrame) -> DataFrame:
    """Pivot zones of every code's segments."""
    code, ts = segs.schema["code"].dataType.simpleString(), segs.schema["start_ts"].dataType.simpleString()
    return segs.select("code", "seq", "dir", "start_ts", "end_ts", "start_price", "end_price", "high", "low").groupBy("code").applyInPandas(
        _zones_pdf, f"code {code}, zone long, first_seq long, last_seq long, start_ts {ts}, end_ts {ts}, low double, high double, extend_count long")


def zone_metrics(zs: DataFrame, segs: DataFrame) -> DataFrame:
    """Strength, stability and type. Zones expand to their segment numbers, so the join is on equality."""
    m = zs.select("code", "zone", c("low").alias("zl"), c("high").alias("zh"), "extend_count", F.explode(F.sequence("first_seq", "last_seq")).alias("seq"))
    lo, hi = F.least("start_price", "end_price"), F.greatest("start_price", "end_price")
    d = m.join(segs.select("code", "seq", "strength", "n_bars", lo.alias("_l"), hi.alias("_h")), ["code", "seq"])
    part = F.least("_h", "zh") - F.greatest("_l", "zl")
    inside = F.when((part > 0) & (c("_h") > c("_l")), c("n_bars") * part / (c("_h") - c("_l"))).otherwise(0.0)
    g = d.groupBy("code", "zone", "zl", "zh", "extend_count").agg(F.avg("strength").alias("_s"), F.sum("n_bars").alias("bars"), F.count(F.lit(1)).alias("n"), F.sum(inside).alias("_in"))
    rr = (c("zh") - c("zl")) / ((c("zh") + c("zl")) / 2)
    one = lambda x: F.least(F.lit(1.0), x)
    g = g.withColumn("range_ratio", rr).withColumn("strength", c("_s") * 0.4 + one(c("bars") / 20) * 0.3 + one(c("range_ratio") * 10) * 0.2 + one(c("n") / 5) * 0.1)
    g = g.withColumn("stability", c("_in") / c("bars") * 0.7 + one(c("extend_count") / 3) * 0.3)
    return g.select("code", "zone", "range_ratio", "strength", "stability", "bars", ladder((c("extend_count") >= 3, "extended"), (c("n") >= 5, "complex"), default="normal").alias("zone_type"))


def zone_history(zs: DataFrame) -> DataFrame:
    """Each zone with its predecessor, the first zone and counts up to it: one row serves every as-of rule."""
    w = Window.partitionBy("code").orderBy("zone")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    pl, ph = F.lag("low").over(w), F.lag("high").over(w)
    center = (c("low") + c("high")) / 2
    d = zs.select("*", pl.alias("prev_low"), ph.alias("prev_high"), F.first("low").over(run).alias("first_low"), F.first("high").over(run).alias("first_high"), c("zone").alias("n_zones"), center.alias("center"))
    w3 = w.rowsBetween(-2, 0)
    up, dn = c("low") > c("prev_low"), c("high") < c("prev_high")
    return d.select("*", F.sum(F.when(up, 1).otherwise(0)).over(run).alias("ups"), F.sum(F.when(~up & dn, 1).otherwise(0)).over(run).alias("downs"),
                    (F.stddev_pop("center").over(w3) / F.avg("center").over(w3)).alias("center_cv"), F.count(F.lit(1)).over(w3).alias("n_recent"))


def asof(left: DataFrame, right: DataFrame, left_ts: str, right_ts: str, fields: Sequence[str], prefix: str = "z_") -> DataFrame:
    """Last ``right`` row of the code with right_ts <= left_ts, by union and fill (one sort per code)."""
    r = right.select("code", c(right_ts).alias("_t"), F.struct(*fields).alias("_p"), F.lit(0).alias("_k"))
    both = left.withColumn("_t", c(left_ts)).withColumn("_k", F.lit(1)).unionByName(r, allowMissingColumns=True)
    w = Window.partitionBy("code").orderBy("_t", "_k").rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn("_p", F.last("_p", ignorenulls=True).over(w)).where("_k = 1")
    return out.select(*left.columns, *[c(f"_p.{f}").alias(f"{prefix}{f}") for f in fields])


def price_position(bars: DataFrame, zs: DataFrame) -> DataFrame:
    """Each bar's close against the last finished zone: inside, distance, place, broken by 1 %."""
    d = asof(bars.select("code", "ts", "close"), zs, "ts", "end_ts", ["zone", "low", "high"]).where(c("z_zone").isNotNull())
    p, lo, hi = c("close"), c("z_low"), c("z_high")
    return d.select("code", "ts", "close", "z_zone", p.between(lo, hi).alias("inside"), (p - (lo + hi) / 2).alias("distance"), F.least(F.greatest(ratio(p - lo, hi - lo), F.lit(0.0)), F.lit(1.0)).alias("place"),
                    ladder((p > hi * 1.01, "up"), (p < lo * 0.99, "down"), default="none").alias("broken"))


def nearest_zone(last_price: DataFrame, zs: DataFrame) -> DataFrame:
    """Per code the zone whose centre is nearest to the price, and the latest zone that holds it."""
    d = zs.join(last_price, "code").withColumn("_d", F.abs(c("price") - (c("low") + c("high")) / 2))
    return d.groupBy("code", "price").agg(F.min("_d").alias("distance"), F.min_by("zone", F.struct("_d", "zone")).alias("nearest"),
                                          F.max(F.when(c("price").between(c("low"), c("high")), c("zone"))).alias("current"))


def trend_type(zh: DataFrame) -> DataFrame:
    """Latest row per code: one zone is consolidation, else the majority of rising lows and falling highs."""
    last = zh.groupBy("code").agg(F.max_by(F.struct("n_zones", "ups", "downs"), "zone").alias("_s")).select("code", "_s.*")
    return last.withColumn("trend", ladder(((c("n_zones") >= 2) & (c("ups") > c("downs")), "up_trend"), ((c("n_zones") >= 2) & (c("downs") > c("ups")), "down_trend"), default="consolidation"))


# ---- MACD zones and divergence -------------------------------------------------------------------

def macd_zones(df: DataFrame) -> DataFrame:
    """Runs of one sign of the MACD bar (zeros stay in the running zone), at least two bars."""
    sign = F.last(F.when(c("bar") != 0, F.signum("bar")), ignorenulls=True).over(S.run())
    d = df.select("code", "ts", "i", "high", "low", "bar", "dif", "dea", sign.alias("sg")).where(c("sg").isNotNull())
    d = d.withColumn("_new", F.when(c("sg").eqNullSafe(S.lag("sg")), 0).otherwise(1))
    d = d.withColumn("zone", F.sum("_new").over(S.run()))
    g = d.groupBy("code", "zone", "sg").agg(F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"), F.min("i").alias("first_i"), F.max("i").alias("last_i"), F.count(F.lit(1)).alias("n"),
                                            F.sum(F.abs("bar")).alias("area"), F.min("low").alias("_lo"), F.max("high").alias("_hi"))
    return g.where("n >= 2").withColumn("extreme", F.when(c("sg") < 0, c("_lo")).otherwise(c("_hi"))).drop("_lo", "_hi")


def area_divergence(zones_: DataFrame, bars: DataFrame) -> DataFrame:
    """Neighbouring zones of one sign. Bottom: area grew over 1.1, new low, golden cross near the end;
    top: area under .9, new high, death cross. Crosses are looked up by bar number (equi-join)."""
    w = Window.partitionBy("code", "sg").orderBy("zone")
    z = zones_.select("*", F.lag("area").over(w).alias("p_area"), F.lag("extreme").over(w).alias("p_extreme")).where(c("p_area") > 0)
    z = z.select("*", ratio("area", "p_area").alias("area_ratio"))
    pd_, pe = S.lag("dif"), S.lag("dea")
    x = bars.select("code", "i", ((pd_ <= pe) & (c("dif") > c("dea")) & (c("bar") >= 0)).alias("golden"), ((pd_ >= pe) & (c("dif") < c("dea")) & (c("bar") <= 0)).alias("dead"))
    near = z.select("code", "zone", F.explode(F.sequence(c("last_i") + 1, c("last_i") + 4)).alias("i")).join(x, ["code", "i"])
    near = near.groupBy("code", "zone").agg(F.max("golden").alias("golden"), F.max("dead").alias("dead"))
    d = z.join(near, ["code", "zone"])
    gap = F.abs(ratio(c("extreme") - c("p_extreme"), "p_extreme")) * 100
    bottom = (c("sg") < 0) & (c("area_ratio") > 1.1) & (c("extreme") < c("p_extreme")) & c("golden")
    top = (c("sg") > 0) & (c("area_ratio") < 0.9) & (c("extreme") > c("p_extreme")) & c("dead")
    rel = F.least(F.lit(0.9), F.when(bottom, c("area_ratio") - 1).otherwise(1 - c("area_ratio")) * 0.5 + gap * 0.01)
    return d.where(bottom | top).select("code", "zone", "end_ts", "extreme", "area_ratio", gap.alias("gap_pct"), F.when(bottom, "bottom").otherwise("top").alias("kind"), rel.alias("reliability"))


# ---- buy and sell points -------------------------------------------------------------------------

def touching_zone(segs: DataFrame, zs: DataFrame) -> DataFrame:
    """Segments with a flag: does any zone overlap them in time? Running maximum instead of an interval join."""
    z = zs.select("code", c("start_ts").alias("_t"), c("end_ts").alias("_ze"), F.lit(0).alias("_k"))
    both = segs.withColumn("_t", c("end_ts")).withColumn("_k", F.lit(1)).unionByName(z, allowMissingColumns=True)
    w = Window.partitionBy("code").orderBy("_t", "_k").rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn("_m", F.max("_ze").over(w)).where("_k = 1")
    return out.select(*segs.columns, F.coalesce(c("_m") >= c("start_ts"), F.lit(False)).alias("in_zone"))


def first_points(segs: DataFrame, zs: DataFrame) -> DataFrame:
    """Segment weaker than .88 of the previous one of its direction, with a zone between them."""
    d = touching_zone(segs, zs).withColumn("_cum", F.sum(c("in_zone").cast("int")).over(Q.run()))
    w = Window.partitionBy("code", "dir").orderBy("seq")
    d = d.select("*", (c("_cum") - c("in_zone").cast("int")).alias("_before"), F.lag("_cum").over(w).alias("_pcum"), F.lag("strength").over(w).alias("_ps"))
    d = d.where((c("_before") - c("_pcum") > 0) & (c("strength") < c("_ps") * 0.88))
    return d.select("code", "seq", c("end_ts").alias("ts"), c("end_price").alias("price"), F.when(c("dir") == -1, "buy1").otherwise("sell1").alias("point"),
                    F.when(c("_ps") == 0, 0.5).otherwise(F.least(1 - ratio("strength", "_ps"), F.lit(1.0))).alias("strength"), F.lit(0.8).alias("reliability"))


def second_points(segs: DataFrame, first: DataFrame) -> DataFrame:
    """The second segment that starts after a class-1 point ends within 5 % of holding it."""
    shift = lambda x: F.when(Q.lead("start_ts") > c("end_ts"), Q.lead(x, 2)).otherwise(Q.lead(x, 3))
    nxt = segs.select("code", "seq", shift("end_ts").alias("ts2"), shift("end_price").alias("price2"), shift("strength").alias("strength2"))
    d = first.select("code", "seq", "price", "point").join(nxt, ["code", "seq"])
    ok = F.when(c("point") == "buy1", c("price2") > c("price") * 0.95).otherwise(c("price2") < c("price") * 1.05)
    return d.where(ok).select("code", "seq", c("ts2").alias("ts"), c("price2").alias("price"), F.when(c("point") == "buy1", "buy2").otherwise("sell2").alias("point"),
                              c("strength2").alias("strength"), F.lit(0.7).alias("reliability"))


def third_points(segs: DataFrame, zs: DataFrame) -> DataFrame:
    """A segment leaves an earlier zone and the next one stays out (2 %). A test segment counts once, against
    the easiest zone: lowest top for buys, highest bottom for sells (running extremes)."""
    z = zs.select("code", c("end_ts").alias("_t"), c("high").alias("_zh"), c("low").alias("_zl"), F.lit(0).alias("_k"))
    nx = lambda x: F.when(Q.lead("start_ts") > c("end_ts"), Q.lead(x, 1)).otherwise(Q.lead(x, 2))
    s = segs.select("code", "seq", "dir", "start_ts", "end_price", nx("seq").alias("t_seq"), nx("end_ts").alias("t_ts"), nx("end_price").alias("t_price"), nx("strength").alias("t_strength"))
    both = s.withColumn("_t", c("start_ts")).withColumn("_k", F.lit(1)).unionByName(z, allowMissingColumns=True)
    w = Window.partitionBy("code").orderBy("_t", "_k").rowsBetween(Window.unboundedPreceding, 0)
    d = both.select("*", F.min("_zh").over(w).alias("zh"), F.max("_zl").over(w).alias("zl")).where("_k = 1")
    buy = (c("dir") == 1) & (c("end_price") > c("zh")) & (c("t_price") > c("zh") * 0.98)
    sell = (c("dir") == -1) & (c("end_price") < c("zl")) & (c("t_price") < c("zl") * 1.02)
    return d.where(buy | sell).select("code", c("t_seq").alias("seq"), c("t_ts").alias("ts"), c("t_price").alias("price"), F.when(c("dir") == 1, "buy3").otherwise("sell3").alias("point"),
                                      c("t_strength").alias("strength"), F.lit(0.9).alias("reliability"))


def nest_levels(lower: DataFrame, upper: DataFrame, last_day: int) -> DataFrame:
    """Each lower-level row with the upper-level row whose span holds it (``upper_seq``, null if none does).

    Rows of a level follow one another without overlapping, so the only candidate is the last upper row that starts no
    later: an as-of step instead of an interval join. ``last_day`` is added to upper ends that name a bar by its first day.
    """
    d = asof(lower, upper, "start_ts", "start_ts", ["seq", "dir", "end_ts"], "upper_")
    held = c("end_ts") <= F.date_add("upper_end_ts", last_day)
    return d.select(*lower.columns, F.when(held, c("upper_seq")).alias("upper_seq"), F.when(held, c("upper_dir")).alias("upper_dir"))


def confirm_levels(points: DataFrame, level: str, other: DataFrame, days: int, bonus: float) -> DataFrame:
    """Points of ``level`` confirmed by ``other`` points of the same side within ``days``; the bonus counts once.

    Times are cut into buckets as wide as the window; a row meets the three nearest buckets by equality.
    """
    side = F.substring("point", 1, 3)
    bucket = lambda t: F.floor(F.datediff(t, F.lit("1970-01-01")) / days)
    a = points.select("*", side.alias("_s"), F.explode(F.array(bucket(c("ts")) - 1, bucket(c("ts")), bucket(c("ts")) + 1)).alias("_b"))
    b = other.select("code", side.alias("_s"), c("ts").alias("_ots"), bucket(c("ts")).alias("_b")).distinct()
    hit = a.join(b, ["code", "_s", "_b"]).where(F.abs(F.datediff("ts", "_ots")) <= days).select("code", "point", "seq").distinct().withColumn("confirmed", F.lit(True))
    out = points.join(hit, ["code", "point", "seq"], "left").withColumn("confirmed", F.coalesce("confirmed", F.lit(False)))
    return out.withColumn("level", F.lit(level)).withColumn("reliability", F.when(c("confirmed"), F.least(c("reliability") + bonus, F.lit(1.0))).otherwise(c("reliability")))


# Weight of each level in the consensus.
LEVEL_WEIGHTS = {"month": 1.0, "week": 0.9, "day": 0.8, "120min": 0.7, "90min": 0.65, "60min": 0.6, "30min": 0.5, "15min": 0.4, "5min": 0.3}


def level_consistency(rows: DataFrame) -> DataFrame:
    """(code, level, direction, strength, has_buy, has_sell) -> consistency, resonance, decision, position size."""
    w = ladder(*[(c("level") == k, v) for k, v in LEVEL_WEIGHTS.items()], default=0.5)
    up, dn = c("direction") == "up", c("direction") == "down"
    n = F.count(F.lit(1))
    s = lambda x: F.sum(x.cast("int"))
    wsum = lambda cond, x=None: F.sum(F.when(cond, c("w") if x is None else c("w") * x).otherwise(0.0))
    g = rows.withColumn("w", w).groupBy("code").agg(
        n.alias("levels"), s(up).alias("_u"), s(dn).alias("_d"), s(c("has_buy")).alias("buys"), s(c("has_sell")).alias("sells"), F.sum("w").alias("_tw"),
        (wsum(up) + wsum(up & c("has_buy")) * 0.3).alias("_mu"), (wsum(dn) + wsum(dn & c("has_sell")) * 0.3).alias("_md"), wsum(~up & ~dn).alias("_mn"),
        wsum(up, c("strength")).alias("_su"), wsum(dn, c("strength")).alias("_sd"), F.sum(c("w") * c("strength")).alias("_ts"))
    g = g.withColumn("consistency", F.when(c("levels") < 2, 0.0).otherwise(F.greatest("_u", "_d", c("levels") - c("_u") - c("_d")) / c("levels")))
    g = g.withColumn("resonance", ladder((c("buys") > c("sells"), c("_mu")), (c("sells") > c("buys"), c("_md")), default=c("_mn")) / c("_tw"))
    g = g.withColumn("overall", ladder((c("_su") > c("_sd") * 1.5, "up"), (c("_sd") > c("_su") * 1.5, "down"), default="consolidation"))
    g = g.withColumn("confidence", F.coalesce(ratio(F.greatest("_su", "_sd"), "_ts"), F.lit(0.0)))
    r, o = c("resonance"), c("overall")
    g = g.withColumn("action", ladder(((o == "up") & (r > 0.5), "buy"), ((o == "down") & (r > 0.5), "sell"), default="hold"))
    return g.withColumn("position", ladder(((o == "up") & (r > 0.7), F.least(r * 1.2, F.lit(1.0))), ((o == "up") & (r > 0.5), r * 0.6), ((o == "down") & (r > 0.7), F.lit(1.0)),
                                           ((o == "down") & (r > 0.5), F.lit(0.5)), default=0.0)).select("code", "levels", "consistency", "resonance", "overall", "confidence", "action", "position")


def divergence_consensus(points: DataFrame, days: int) -> DataFrame:
    """(code, level, ts, kind): how many other levels show the same kind within ``days``."""
    bucket = lambda t: F.floor(F.datediff(t, F.lit("1970-01-01")) / days)
    a = points.select("*", F.explode(F.array(bucket(c("ts")) - 1, bucket(c("ts")), bucket(c("ts")) + 1)).alias("_b"))
    b = points.select("code", "kind", c("level").alias("_l"), c("ts").alias("_t"), bucket(c("ts")).alias("_b"))
    hit = a.join(b, ["code", "kind", "_b"]).where((c("level") != c("_l")) & (F.abs(F.datediff("ts", "_t")) <= days))
    n = hit.groupBy("code", "level", "ts", "kind").agg(F.countDistinct("_l").alias("confirming"))
    return points.join(n, ["code", "level", "ts", "kind"], "left").withColumn("confirming", F.coalesce("confirming", F.lit(0)))


# ---- gaps ----------------------------------------------------------------------------------------

def gaps(bars: DataFrame) -> DataFrame:
    ph, pl = S.lag("high"), S.lag("low")
    d = bars.select("code", "ts", "high", "low", S.idx().alias("i"), F.when(c("low") > ph, "up").when(c("high") < pl, "down").alias("gap"), ph.alias("_ph"), pl.alias("_pl"))
    up = c("gap") == "up"
    size = F.when(up, c("low") - c("_ph")).otherwise(c("_pl") - c("high"))
    edge = F.when(up, c("_ph")).otherwise(c("_pl"))
    return d.where(c("gap").isNotNull()).select("code", "ts", "i", "gap", edge.alias("edge"), size.alias("points"), (ratio(size, edge) * 100).alias("pct"))


def gap_persistence(bars: DataFrame, n: int = 3) -> DataFrame:
    """Gaps and whether the next n bars (the gap bar included) keep clear of the far edge."""
    w = S.w.rowsBetween(0, n - 1)
    lows = bars.select("code", "ts", F.min("low").over(w).alias("_lo"), F.max("high").over(w).alias("_hi"))
    d = gaps(bars).join(lows, ["code", "ts"])
    return d.select("code", "ts", "gap", "edge", "pct", F.when(c("gap") == "up", c("_lo") > c("edge")).otherwise(c("_hi") < c("edge")).alias("held"))


def bars_to_fill(high, low, gap, edge) -> list[float]:
    """For every gap the bars until a low (of an up gap) or a high (of a down gap) reaches its edge; nan while open.

    Open gaps wait in two heaps, nearest edge first, so a bar looks only at the gaps that it fills."""
    out = [float("nan")] * len(high)
    below: list[tuple[float, int]] = []  # up gaps: the highest edge is reached first
    above: list[tuple[float, int]] = []
    for t, (h, l, g, e) in enumerate(zip(high, low, gap, edge)):
        while below and l <= -below[0][0]:
            k = heapq.heappop(below)[1]
            out[k] = float(t - k)
        while above and h >= above[0][0]:
            k = heapq.heappop(above)[1]
            out[k] = float(t - k)
        if g == "up":
            heapq.heappush(below, (-e, t))
        elif g == "down":
            heapq.heappush(above, (e, t))
    return out


def _fills_pdf(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("i").reset_index(drop=True)
    pdf["bars_to_fill"] = bars_to_fill(*(pdf[k].tolist() for k in ("high", "low", "gap", "edge")))
    return pdf.loc[pdf["gap"].notna(), ["code", "ts", "gap", "bars_to_fill"]]


def gap_fill(bars: DataFrame) -> DataFrame:
    """Bars until each gap is filled (null while open)."""
    b = bars.select("code", "ts", "high", "low", S.idx().alias("i")).join(gaps(bars).select("code", "ts", "gap", "edge"), ["code", "ts"], "left")
    code, ts = b.schema["code"].dataType.simpleString(), b.schema["ts"].dataType.simpleString()
    return b.groupBy("code").applyInPandas(_fills_pdf, f"code {code}, ts {ts}, gap string, bars_to_fill double")


# ---- swings and patterns -------------------------------------------------------------------------

def swings(bars: DataFrame, half: int = 10) -> DataFrame:
    """Bars that are the extreme of a centred window; runs of one side keep the more extreme (earliest) one."""
    w = S.w.rowsBetween(-half, half)
    full = F.count(F.lit(1)).over(w) == 2 * half + 1
    hi, lo = c("high") == F.max("high").over(w), c("low") == F.min("low").over(w)
    d = bars.select("code", "ts", F.when(full & hi & ~lo, 1).when(full & lo & ~hi, -1).alias("kind"), "high", "low").where(c("kind").isNotNull())
    d = d.select("code", "ts", "kind", F.when(c("kind") == 1, c("high")).otherwise(c("low")).alias("price"))
    return reduce_fractals(d, "extreme")


def _next(d: DataFrame, n: int) -> DataFrame:
    cols = [Q.lead(x, k).alias(f"{x}{k}") for k in range(1, n + 1) for x in ("price", "ts")]
    return d.select("code", "seq", "kind", c("price").alias("price0"), c("ts").alias("ts0"), *cols).where(c(f"price{n}").isNotNull())


def _spaced(n: int, days: int) -> Column:
    ok = F.lit(True)
    for k in range(n):
        ok = ok & (F.datediff(f"ts{k + 1}", f"ts{k}") >= days)
    return ok


def elliott_impulse(sw: DataFrame, days: int = 5, tol: float = 0.15) -> DataFrame:
    """Six alternating swings with the five-wave ratio rules; up-waves warn of a top, down-waves of a bottom."""
    d = _next(sw, 5)
    sgn = -c("kind")                                  # +1 when the first swing is a low
    w = [sgn * (c(f"price{k + 1}") - c(f"price{k}")) * (1 if k % 2 == 0 else -1) for k in range(5)]
    r2, r3, r4 = ratio(w[1], w[0]), ratio(w[2], w[0]), ratio(w[3], w[2])
    ok = ((w[0] > 0) & (w[2] > 0) & (w[4] > 0) & (sgn * (c("price2") - c("price0")) > 0) & ~((w[2] < w[0]) & (w[2] < w[4])) & (sgn * (c("price4") - c("price1")) > 0)
          & r2.between(0.5 - tol, 0.618 + tol) & r3.between(1.0 - tol, 2.618 + tol) & r4.between(0.236 - tol, 0.5 + tol) & _spaced(5, days))
    return d.where(ok).select("code", "seq", c("ts5").alias("ts"), (-sgn).alias("signal"), *[x.alias(f"w{k + 1}") for k, x in enumerate(w)])


def elliott_abc(sw: DataFrame, days: int = 5, tol: float = 0.15) -> DataFrame:
    d = _next(sw, 3)
    sgn = c("kind")                                   # +1 when the correction falls from a high
    a, b, e = sgn * (c("price0") - c("price1")), sgn * (c("price2") - c("price1")), sgn * (c("price2") - c("price3"))
    ok = ((a > 0) & (b > 0) & (e > 0) & (sgn * (c("price0") - c("price2")) > 0) & ratio(b, a).between(0.382 - tol, 0.618 + tol) & ratio(e, a).between(0.618 - tol, 1.618 + tol) & _spaced(3, days))
    return d.where(ok).select("code", "seq", c("ts3").alias("ts"), sgn.alias("signal"), a.alias("wave_a"), b.alias("wave_b"), e.alias("wave_c"))


# Ratio ranges (AB/XA, AD/XA, BC/AB, CD/BC) per pattern.
HARMONIC = {
    "Gartley": ((0.55, 0.68), (0.72, 0.84), (0.382, 0.886), (1.27, 1.618)),
    "Bat": ((0.33, 0.55), (0.82, 0.94), (0.382, 0.886), (1.618, 2.618)),
    "Butterfly": ((0.72, 0.84), (1.20, 1.38), (0.382, 0.886), (1.618, 2.618)),
    "Crab": ((0.33, 0.68), (1.52, 1.72), (0.382, 0.886), (2.24, 3.618))}


def harmonic_patterns(sw: DataFrame, tol: float = 0.1, table: Mapping = HARMONIC) -> DataFrame:
    """Alternating X, A, B, C, D against the ratio ranges widened by ``tol``; a low at D is bullish."""
    d = _next(sw, 4)
    xa, ab, bc, cd, ad = (F.abs(c(f"price{a}") - c(f"price{b}")) for a, b in ((1, 0), (2, 1), (3, 2), (4, 3), (4, 1)))
    d = d.select("*", ratio(ab, xa).alias("b_retrace"), ratio(ad, xa).alias("d_retrace"), F.coalesce(ratio(bc, ab), F.lit(0.0)).alias("bc_ratio"), F.coalesce(ratio(cd, bc), F.lit(0.0)).alias("cd_ratio"))
    rows = F.array(*[F.struct(F.lit(k).alias("pattern"), *[F.lit(x).alias(f"{n}{i}") for n, r in zip("bdxy", v) for i, x in enumerate(r)]) for k, v in table.items()])
    d = d.select("*", F.inline(rows))                 # four literal rows per five swings
    ok = F.lit(True)
    for n, x in zip("bdxy", ("b_retrace", "d_retrace", "bc_ratio", "cd_ratio")):
        ok = ok & c(x).between(c(f"{n}0") - tol, c(f"{n}1") + tol)
    return d.where(ok).select("code", "seq", c("ts4").alias("ts"), "pattern", (-c("kind")).alias("signal"), "b_retrace", "d_retrace", "bc_ratio", "cd_ratio")


# ---- signal scoring ------------------------------------------------------------------------------

# Weight of each signal family.
CATEGORY_WEIGHTS = {"cxt": 0.30, "tas": 0.25, "vol": 0.15, "bar": 0.10, "pos": 0.10, "jcc": 0.05, "sta": 0.05}


def score_signals(signals: DataFrame, table: DataFrame) -> DataFrame:
    """Score of each (name, v1) from a table (name, value, score, ord): the longest run of the label's parts that is an
    entry; failing that, the first entry that holds the label or is held by it; 0 if none. Without ``ord`` longer entries come first.

    Labels repeat from bar to bar, so each distinct one is looked up once: its parts, shortened one by one from the end,
    meet the entries by equality. Only labels without such an entry are compared with the entries of their signal.
    """
    first = c("ord") if "ord" in table.columns else F.struct(-F.length("value"), "value")
    t = table.select("name", "value", c("score").alias("_sc"), first.alias("_o"))
    labels = signals.select("name", "v1").distinct()
    parts = F.split("v1", "_")
    runs = labels.select("name", "v1", F.posexplode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.concat_ws("_", F.slice(parts, F.lit(1), k)))).alias("_n", "value"))
    exact = runs.join(t, ["name", "value"]).groupBy("name", "v1").agg(F.max_by("_sc", "_n").alias("_e"))
    rest = labels.join(exact, ["name", "v1"], "left_anti").join(t, "name").where(c("v1").contains(c("value")) | c("value").contains(c("v1")))
    loose = rest.groupBy("name", "v1").agg(F.min_by("_sc", "_o").alias("_e"))
    return signals.join(exact.unionByName(loose), ["name", "v1"], "left").select(*signals.columns, F.coalesce("_e", F.lit(0.0)).alias("score"))


def fuse_categories(scored: DataFrame, weights: Mapping[str, float] = CATEGORY_WEIGHTS, compat: bool = False) -> DataFrame:
    """(code, ts, category, score) -> weighted total over present families, agreement bonus, final 0..100, direction."""
    cat = scored.groupBy("code", "ts", "category").agg(F.avg("score").alias("m"))
    w = ladder(*[(c("category") == k, v) for k, v in weights.items()])
    g = cat.withColumn("_w", w).where(c("_w").isNotNull()).groupBy("code", "ts").agg(
        F.sum(c("m") * c("_w")).alias("_s"), F.sum("_w").alias("_t"), F.sum((c("m") > 10).cast("int")).alias("_p"), F.sum((c("m") < -10).cast("int")).alias("_n"), F.count(F.lit(1)).alias("families"))
    total = ratio("_s", "_t")
    if compat:
        total = total * ratio(F.lit(sum(weights.values())), "_t")
    agree = F.greatest("_p", "_n")
    g = g.withColumn("total", total).withColumn("bonus", ladder((agree >= 3, 0.2), (agree >= 2, 0.1), default=0.0))
    g = g.withColumn("final", F.greatest(F.lit(0.0), F.least(F.lit(100.0), c("total") * 0.5 * (1 + c("bonus")) + 50)))
    f = c("final")
    return g.select("code", "ts", "families", "total", "bonus", "final", ladder((f >= 52, "bullish"), (f <= 48, "bearish"), default="neutral").alias("direction"),
                    ladder(((f >= 70) | (f <= 30), "strong"), ((f >= 58) | (f <= 42), "medium"), default="weak").alias("power"))


BITS = 62


def rule_table(spark, rules: Sequence[Mapping]) -> tuple[DataFrame, DataFrame, int]:
    """Rules as two tables, and the number of condition words.

    Conditions are numbered over all rules: (name, text, word, bit). A rule is one mask a word for each of all / any / not,
    a least final score and least category scores. Rules may be any number; the plan is the same."""
    conds = sorted({tuple(x) for r in rules for k in ("all", "any", "not") for x in r.get(k, ())})
    at = {x: divmod(i, BITS) for i, x in enumerate(conds)}
    words = len(conds) // BITS + 1

    def masks(xs):
        out = [0] * words
        for x in xs:
            w, bit = at[tuple(x)]
            out[w] |= 1 << bit
        return out

    rows = [(r["name"], masks(r.get("all", ())), masks(r.get("any", ())), masks(r.get("not", ())), float(r.get("min_score", 0)), sorted((k, float(v)) for k, v in r.get("min_category", {}).items())) for r in rules]
    table = spark.createDataFrame(rows, "strategy string, all array<bigint>, any array<bigint>, none array<bigint>, least double, floors array<struct<category: string, least: double>>")
    return spark.createDataFrame([(n, t, *at[n, t]) for n, t in conds], "name string, text string, word int, bit int"), table, words


def rule_matches(signals: DataFrame, rules: Sequence[Mapping], finals: DataFrame | None = None, scores: DataFrame | None = None, keys: Sequence[str] = ("code", "ts")) -> DataFrame:
    """(keys, final, strategy) of the rules that hold at each key.

    A key's labels (name, v1) become one bitmap of the conditions they meet, so a rule is a test of bits: all of its
    ``all`` bits, one of its ``any`` bits if it has any, none of its ``not`` bits. ``finals`` (keys, final) and ``scores``
    (keys, category, m) are held against the rule's least scores; a missing category counts as 0. The rule tables are
    parameters of fixed size and are broadcast."""
    conds, table, words = rule_table(signals.sparkSession, rules)
    hit = signals.join(F.broadcast(conds), "name").where((c("text") == "任意") | c("v1").contains(c("text")))
    bits = [F.coalesce(F.bit_or(F.when(c("word") == w, F.expr("shiftleft(CAST(1 AS BIGINT), bit)"))), F.lit(0).cast("bigint")) for w in range(words)]
    d = hit.groupBy(*keys).agg(F.array(*bits).alias("_b"))
    d = signals.select(*keys).distinct().join(d, list(keys), "left").withColumn("_b", F.coalesce("_b", F.array(*[F.lit(0).cast("bigint")] * words)))
    d = d.join(finals.select(*keys, "final"), list(keys)) if finals is not None else d.withColumn("final", F.lit(None).cast("double"))
    if scores is not None:
        m = scores.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("category", "m"))).alias("_m"))
        d = d.join(m, list(keys), "left")
    else:
        d = d.withColumn("_m", F.lit(None).cast("map<string,double>"))
    d = d.crossJoin(F.broadcast(table))  # a fixed number of rules for each key
    each = lambda f: [f(c("_b")[w], w) for w in range(words)]
    ok = c("final").isNull() | (c("final") >= c("least"))
    for x in each(lambda b, w: (b.bitwiseAND(c("all")[w]) == c("all")[w]) & (b.bitwiseAND(c("none")[w]) == 0)):
        ok = ok & x
    some = each(lambda b, w: b.bitwiseAND(c("any")[w]) != 0)
    free = each(lambda b, w: c("any")[w] == 0)
    anyof, noany = some[0], free[0]
    for x, y in zip(some[1:], free[1:]):
        anyof, noany = anyof | x, noany & y
    floors = F.forall("floors", lambda x: F.coalesce(F.element_at(c("_m"), x["category"]), F.lit(0.0)) >= x["least"])
    return d.where(ok & (noany | anyof) & (floors | c("final").isNull())).select(*keys, "final", "strategy")


def divergence_selector(points: DataFrame, n: int = 50) -> DataFrame:
    """(code, kind, reliability, area_ratio, gap_pct, dif, price): 30 + 25 + 20 + 15 + 10 points, key prices, top n by score then code."""
    buy = c("kind") == "bottom"
    rel = c("reliability") * 30
    area = F.when(buy, F.least((c("area_ratio") - 1) * 25, F.lit(25.0))).otherwise(F.least((1 - c("area_ratio")) * 50, F.lit(25.0)))
    gap = F.least(c("gap_pct") * 2, F.lit(20.0))
    macd = F.when(F.when(buy, c("dif") < 0).otherwise(c("dif") > 0), 15.0).otherwise(5.0)
    stop = F.when(buy, c("price") * 0.95).otherwise(c("price") * 1.05)
    goal = F.when(buy, c("price") * (c("reliability") * 0.15 + 1)).otherwise(c("price") * (1 - c("reliability") * 0.15))
    d = points.select("*", stop.alias("stop_loss"), goal.alias("take_profit"))
    rr = ratio(F.abs(c("take_profit") - c("price")), F.abs(c("price") - c("stop_loss")))
    reward = F.when(rr.isNull(), 5.0).otherwise(ladder((rr >= 3, F.lit(10.0)), (rr >= 2, (rr - 2) * 2 + 7), (rr >= 1.5, (rr - 1.5) * 4 + 5), default=rr * 2 + 2))
    d = d.withColumn("score", rel + F.greatest(area, F.lit(0.0)) + gap + macd + reward)
    d = d.withColumn("power", ladder((c("score") >= 80, "strong"), (c("score") >= 60, "medium"), default="weak"))
    return d.orderBy(F.desc(F.round("score", 6)), "code").limit(n)


def composite_trend(segs: DataFrame, stability: DataFrame | None = None) -> DataFrame:
    """Majority of the last three segments; .6 mean strength + .4 direction share; risk and confidence averages."""
    w = Window.partitionBy("code").orderBy(F.desc("seq"))
    d = segs.withColumn("_r", F.row_number().over(w))
    g = d.groupBy("code").agg(F.count(F.lit(1)).alias("n"), F.avg("strength").alias("_s"), F.sum(F.when(c("_r") <= 3, c("dir")).otherwise(0)).alias("_v"), F.avg((c("dir") == 1).cast("double")).alias("_u"))
    g = g.withColumn("direction", F.when(c("n") < 2, "consolidation").otherwise(ladder((c("_v") > 0, "up"), (c("_v") < 0, "down"), default="consolidation")))
    share = ladder((c("direction") == "up", c("_u")), (c("direction") == "down", 1 - c("_u")), default=0.5)
    g = g.withColumn("trend_strength", c("_s") * 0.6 + share * 0.4)
    if stability is not None:
        z = stability.groupBy("code").agg(F.avg("stability").alias("_st"))
        g = g.join(z, "code", "left")
        risk = F.when(c("_st").isNull(), 1 - c("trend_strength")).otherwise((1 - c("_st") + 1 - c("trend_strength")) / 2)
        whole = F.lit(0.7) + F.when(c("_st").isNotNull(), 0.3).otherwise(0.0)
    else:
        risk, whole = 1 - c("trend_strength"), F.lit(0.7)
    return g.withColumn("risk", risk).withColumn("confidence", (F.least(c("n") / 100, F.lit(1.0)) + whole + 0.5) / 3).select("code", "direction", "trend_strength", "risk", "confidence")


def recommendation(trend: DataFrame, points: DataFrame, last_zone: DataFrame) -> DataFrame:
    """Latest point against the trend: action, entry, stop from the last zone, target."""
    p = points.groupBy("code").agg(F.max_by(F.struct("point", "price", "reliability"), F.struct("ts", "point")).alias("_p")).select("code", "_p.*")
    d = trend.join(p, "code", "left").join(last_zone.select("code", c("low").alias("_zl"), c("high").alias("_zh")), "code", "left")
    buy = c("point").startswith("buy") & (c("reliability") > 0.6) & c("direction").isin("up", "consolidation")
    sell = c("point").startswith("sell") & (c("reliability") > 0.6) & c("direction").isin("down", "consolidation")
    d = d.withColumn("action", ladder((c("point").isNull(), "wait"), (buy, "buy"), (sell, "sell"), default="hold"))
    a, has = c("action"), c("_zl").isNotNull()
    return d.select("code", "action", F.when(a.isin("buy", "sell"), c("price")).alias("entry"), ladder(((a == "buy") & has, c("_zl") * 0.98), ((a == "sell") & has, c("_zh") * 1.02)).alias("stop_loss"),
                    ladder(((a == "buy") & has, c("price") * 1.1), ((a == "sell") & has, c("price") * 0.9)).alias("take_profit"))
