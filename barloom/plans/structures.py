"""Price-structure queries on brand bars.

Bars, fractals, strokes, MACD zones and patterns are read off weekly bars. Segments need many strokes, so segments and
all that stands on them (zones, trend, points, composite, structure signals) are read off daily bars; queries on two
levels build both.
"""

import re
from functools import cached_property

from pyspark.sql import Window
from pyspark.sql import functions as F

from barloom.functions.windows import ladder
from barloom.operators import indicators as I
from barloom.operators import signals as G
from barloom.operators import structures as X
from barloom.operators.signals import cxt
from barloom.operators.signals.base import NONE
from barloom.operators.signals.library import signal_library
from barloom.operators.states import EVENTS, POINT_NAMES, asof_many, event_labels, state_signals
from barloom.plans import bindings as D
from barloom.plans.frames import BASE, MACD, WIN, ema, over, span, staged
from barloom.plans.registry import query
from barloom.session import cut

c = F.col
LC = "lead({}) OVER w"


# ---- SQL -----------------------------------------------------------------------------------------
FX = BASE + f""",
fx0 AS (SELECT *, lead(high) OVER w AS nh, lead(low) OVER w AS nl, lead(volume) OVER w AS nv, count(*) OVER (PARTITION BY code ORDER BY ts ROWS BETWEEN 2 FOLLOWING AND 4 FOLLOWING) AS aft FROM b {WIN}),
fx1 AS (SELECT *, CASE WHEN high > ph AND high > nh AND low > pl AND low > nl THEN 1 WHEN high < ph AND high < nh AND low < pl AND low < nl THEN -1 END AS kind FROM fx0),
fx AS (SELECT code, ts, i + 1 AS i, kind, CASE WHEN kind = 1 THEN high ELSE low END AS price, high, low, open, close, least(pl, low, nl) AS win_low, greatest(ph, high, nh) AS win_high,
  CASE WHEN kind = 1 THEN greatest(0, (high - greatest(ph, nh)) / greatest(ph, nh)) ELSE greatest(0, (least(pl, nl) - low) / least(pl, nl)) END AS strength, coalesce(volume / nullif((pv + nv) / 2, 0), 1) AS volume_ratio,
  CASE WHEN aft <= 0 THEN 0 WHEN aft = 1 THEN 0.6 WHEN aft = 2 THEN 0.8 ELSE 1 END AS confidence FROM fx1 WHERE kind IS NOT NULL),
rf AS (SELECT *, row_number() OVER w AS seq FROM (SELECT *, lag(kind) OVER w IS DISTINCT FROM kind AS nw FROM fx {WIN}) WHERE nw {WIN})"""
SK = FX + """,
sk0 AS (SELECT code, seq, -kind AS dir, ts AS start_ts, lead(ts) OVER q AS end_ts, lead(i) OVER q AS end_i, price AS start_price, lead(price) OVER q AS end_price FROM rf WINDOW q AS (PARTITION BY code ORDER BY seq)),
sk1 AS (SELECT k.code, k.seq, k.dir, b.high, b.low, b.volume, b.close, lag(b.close) OVER (PARTITION BY k.code, k.seq ORDER BY b.ts) AS pcl FROM sk0 k JOIN b ON b.code = k.code AND b.ts BETWEEN k.start_ts AND k.end_ts WHERE k.end_ts IS NOT NULL),
sk2 AS (SELECT code, seq, max(high) AS high, min(low) AS low, count(*) AS n_bars, sum(volume) AS volume, coalesce(avg(CASE WHEN pcl IS NOT NULL THEN CASE WHEN dir = 1 THEN (close >= pcl)::INT ELSE (close <= pcl)::INT END END), 1) AS purity FROM sk1 GROUP BY 1, 2),
sk3 AS (SELECT sk0.*, high, low, n_bars, volume, purity, abs((end_price - start_price) / start_price) AS amplitude FROM sk0 JOIN sk2 USING (code, seq)),
sk AS MATERIALIZED (SELECT *, amplitude * 0.7 + least(1, volume / n_bars / 1e6) * 0.3 AS strength FROM sk3)"""
def daily(text):
    """SQL on weekly bars made to read daily ones."""
    return text.replace(D.BRAND_WEEK, D.BRAND_DAY.replace("dbars", "bars"))


def suffixed(text, suffix="_w"):
    """The CTEs of a text under names of their own, so that two levels stand side by side."""
    names = re.findall(r"(?:^|,)\s*([a-z][a-z0-9_]*)(?:\([^()]*\))? AS (?:MATERIALIZED )?\(", text)
    return re.sub(r"\b(" + "|".join(sorted(set(names), key=len, reverse=True)) + r")\b(?!')", rf"\1{suffix}", text)


def without(text, start):
    """``text`` after ``start``, to be put behind another text that begins alike."""
    assert text.startswith(start + ",")
    return text[len(start) + 1:]


# strokes are ``bi`` and segments ``sk`` from here on
BI = "RECURSIVE " + daily(SK).replace("sk AS MATERIALIZED", "bi AS MATERIALIZED")
_fades = lambda x, share: f"(w[-4].{x} >= w[-3].{x} AND w[-3].{x} >= w[-2].{x} AND w[-2].{x} >= w[-1].{x} AND w[-1].{x} < w[-4].{x} * {share})"
_kept = """CASE WHEN len({0}) > 0 THEN list_reduce(list_transform({0}, lambda y: [y]), lambda a, y: CASE WHEN y[1].lo >= a[-1].lo AND y[1].hi <= a[-1].hi THEN a
    WHEN y[1].lo <= a[-1].lo AND y[1].hi >= a[-1].hi THEN list_concat(a[1:len(a) - 1], y) ELSE list_concat(a, y) END) ELSE [] END"""
SEG = BI + f""",
bl AS MATERIALIZED (SELECT code, count(*) AS n, list(struct_pack(q := seq, d := dir, lo := least(start_price, end_price), hi := greatest(start_price, end_price), e := end_price, s := strength, a := amplitude) ORDER BY seq) AS l FROM bi GROUP BY code),
sr AS (SELECT code, CAST(1 AS BIGINT) AS i, CAST(1 AS BIGINT) AS o, CAST(NULL AS BIGINT) AS m0, CAST(NULL AS BIGINT) AS m1 FROM bl
  UNION ALL
  SELECT code, i + 1, CASE WHEN shut THEN i ELSE o END, CASE WHEN shut OR (i = n AND i - o >= 2) THEN o END, CASE WHEN shut AND i - o >= 3 THEN i - 1 WHEN shut OR (i = n AND i - o >= 2) THEN i END
  FROM (SELECT *, coalesce(i - o >= 2 AND len(f) > 0 AND ((i - o >= 4 AND (i - o >= 8 OR {_fades("s", 0.7)} OR {_fades("a", 0.5)}))
      OR (len(f) >= 3 AND len(k) >= 3 AND ((k[-2].e > k[-3].e AND k[-2].e > k[-1].e) OR (k[-2].e < k[-3].e AND k[-2].e < k[-1].e)))), false) AS shut
    FROM (SELECT *, {_kept.format("f")} AS k FROM (SELECT *, list_filter(w, lambda x: x.d <> w[1].d) AS f FROM (SELECT r.*, bl.n, bl.l[r.o:r.i] AS w FROM sr r JOIN bl ON bl.code = r.code WHERE r.i <= bl.n))))),
sm AS MATERIALIZED (SELECT code, row_number() OVER (PARTITION BY code ORDER BY m0) - 1 AS seg, m0, m1 FROM sr WHERE m0 IS NOT NULL),
sw AS (SELECT m.code, m.seg, list_filter(bl.l[m.m0:m.m1], lambda x: x.d <> bl.l[m.m0].d) AS f FROM sm m JOIN bl ON bl.code = m.code),
sf1 AS (SELECT code, seg, unnest({_kept.format("f")}) AS x FROM sw WHERE len(f) > 0),
sb AS (SELECT m.seg, k.*, row_number() OVER q AS k, first_value(dir) OVER q AS d FROM sm m JOIN bi k ON k.code = m.code AND k.seq BETWEEN m.m0 AND m.m1 WINDOW q AS (PARTITION BY m.code, m.seg ORDER BY k.seq)),
sc AS (SELECT code, seg, max(d) AS dir, min(start_ts) AS start_ts, max(end_ts) AS end_ts, arg_min(start_price, seq) AS start_price, arg_max(end_price, seq) AS end_price, max(high) AS high, min(low) AS low, count(*) AS n_strokes,
  sum(n_bars) AS n_bars, avg(strength) AS bs, avg((dir = d)::INT) AS share, avg((dir = CASE WHEN k % 2 = 1 THEN d ELSE -d END)::INT) AS alt FROM sb GROUP BY 1, 2),
sd AS (SELECT *, abs((end_price - start_price) / start_price) AS amplitude, CASE WHEN n_strokes >= 3 THEN alt * 0.7 + (1 - share) * 0.3 ELSE 0 END AS integrity FROM sc),
sk AS MATERIALIZED (SELECT *, amplitude * 0.5 + bs * 0.3 + share * 0.2 AS strength, row_number() OVER (PARTITION BY code ORDER BY seg) AS seq FROM sd WHERE amplitude >= 0.005 AND integrity >= 0.5)"""
ZS = SEG + """,
zr AS (SELECT code, CAST(1 AS BIGINT) AS i, CAST(0 AS BIGINT) AS n, 0e0 AS rh, 0e0 AS rl, 0e0 AS bh, 0e0 AS bl, false AS emit, CAST(0 AS BIGINT) AS zi, CAST(0 AS BIGINT) AS zn, 0e0 AS zh, 0e0 AS zl FROM (SELECT DISTINCT code FROM sk)
  UNION ALL
  SELECT code, CASE WHEN (n = 0 AND NOT base) OR (n > 0 AND NOT ext AND NOT mixed) THEN i + 1 WHEN n > 0 AND NOT ext THEN i + n ELSE i END, CASE WHEN n = 0 THEN CASE WHEN base THEN 3 ELSE 0 END WHEN ext THEN n + 1 ELSE 0 END,
    CASE WHEN n = 0 THEN h3 ELSE least(rh, coalesce(jh, rh)) END, CASE WHEN n = 0 THEN l3 ELSE greatest(rl, coalesce(jl, rl)) END, CASE WHEN n = 0 THEN h3 ELSE bh END, CASE WHEN n = 0 THEN l3 ELSE bl END,
    n > 0 AND NOT ext AND mixed, i, n, eh, el
  FROM (SELECT *, n > 0 AND EXISTS (SELECT 1 FROM sk x JOIN sk y ON y.code = x.code AND x.seq = y.seq + 1 WHERE x.code = t.code AND x.seq > t.i AND x.seq < t.i + t.n AND x.dir <> y.dir) AS mixed, n > 0 AND coalesce(jh IS NOT NULL AND n - 3 < 9 AND least(jhi, eh) > greatest(jlo, el) AND jhi > jlo AND (least(jhi, eh) - greatest(jlo, el)) / (jhi - jlo) >= 0.01, false) AS ext FROM (
    SELECT z.*, CASE WHEN rh > rl THEN rh ELSE bh END AS eh, CASE WHEN rh > rl THEN rl ELSE bl END AS el, least(s1.high, s2.high, s3.high) AS h3, greatest(s1.low, s2.low, s3.low) AS l3,
      coalesce(least(s1.high, s2.high, s3.high) > greatest(s1.low, s2.low, s3.low) AND (least(s1.high, s2.high, s3.high) - greatest(s1.low, s2.low, s3.low)) / ((s1.high - s1.low + s2.high - s2.low + s3.high - s3.low) / 3) >= 0.01, false) AS base,
      j.high AS jh, j.low AS jl, greatest(j.start_price, j.end_price) AS jhi, least(j.start_price, j.end_price) AS jlo
    FROM zr z LEFT JOIN sk s1 ON s1.code = z.code AND s1.seq = z.i LEFT JOIN sk s2 ON s2.code = z.code AND s2.seq = z.i + 1 LEFT JOIN sk s3 ON s3.code = z.code AND s3.seq = z.i + 2 LEFT JOIN sk j ON z.n > 0 AND j.code = z.code AND j.seq = z.i + z.n
    WHERE z.n > 0 OR s3.seq IS NOT NULL) t)),
zs AS MATERIALIZED (SELECT r.code, row_number() OVER (PARTITION BY r.code ORDER BY zi) AS zone, zi AS first_seq, zi + zn - 1 AS last_seq, f.start_ts, g.end_ts, zl AS low, zh AS high, zn - 3 AS extend_count
  FROM zr r JOIN sk f ON f.code = r.code AND f.seq = zi JOIN sk g ON g.code = r.code AND g.seq = zi + zn - 1 WHERE emit)"""
ZH = ZS + """,
zh0 AS (SELECT *, lag(low) OVER w AS prev_low, lag(high) OVER w AS prev_high, first_value(low) OVER w AS first_low, first_value(high) OVER w AS first_high, zone AS n_zones, (low + high) / 2 AS center FROM zs WINDOW w AS (PARTITION BY code ORDER BY zone)),
zh AS (SELECT *, sum((low > prev_low)::INT) OVER w AS ups, sum((NOT low > prev_low AND high < prev_high)::INT) OVER w AS downs, stddev_pop(center) OVER (w ROWS 2 PRECEDING) / avg(center) OVER (w ROWS 2 PRECEDING) AS center_cv,
  count(*) OVER (w ROWS 2 PRECEDING) AS n_recent FROM zh0 WINDOW w AS (PARTITION BY code ORDER BY zone))"""
SF = ZH + """,
sf AS (SELECT k.*, row_number() OVER (PARTITION BY k.code ORDER BY k.seq) AS k, z.low AS z_low, z.high AS z_high, z.prev_low AS z_prev_low, z.prev_high AS z_prev_high, z.first_low AS z_first_low, z.first_high AS z_first_high, z.n_zones AS z_n_zones,
  z.center_cv AS z_center_cv, z.n_recent AS z_n_recent FROM bi k ASOF LEFT JOIN zh z ON z.code = k.code AND k.end_ts >= z.end_ts)"""


# ---- Spark bindings ------------------------------------------------------------------------------
def bars(spark, sf):
    """Structures read their bars several times, so the bars are stored first and the trades read once."""
    return cut(D.brand_bars(spark, sf, "week"))


def fx(spark, sf):
    return X.fractals(bars(spark, sf))


def strokes(spark, sf):
    b = bars(spark, sf)
    return cut(X.strokes(X.reduce_fractals(X.fractals(b)), b))


class Level:
    """All structures of one bar level; each is computed once and only if asked for."""

    def __init__(self, spark, sf, level="day"):
        self.bars = cut(D.brand_bars(spark, sf, level))

    @cached_property
    def fractals(self):
        return X.fractals(self.bars)

    @cached_property
    def strokes(self):
        return cut(X.strokes(X.reduce_fractals(self.fractals), self.bars))

    @cached_property
    def members(self):
        return cut(X.segment_strokes(self.strokes))

    @cached_property
    def segments(self):
        return cut(X.segments(self.strokes, self.members))

    @cached_property
    def zones(self):
        return cut(X.zones(self.segments))

    @cached_property
    def history(self):
        return X.zone_history(self.zones)

    @cached_property
    def metrics(self):
        return X.zone_metrics(self.zones, self.segments)

    @cached_property
    def first_points(self):
        return X.first_points(self.segments, self.zones)

    @cached_property
    def points(self):
        """Points of all three classes."""
        first = cut(self.first_points)
        return cut(first.unionByName(X.second_points(self.segments, first)).unionByName(X.third_points(self.segments, self.zones)))

    @cached_property
    def macd(self):
        return cut(I.macd_columns(I.base_columns(self.bars)))

    @cached_property
    def divergences(self):
        return X.area_divergence(X.macd_zones(self.macd), self.macd)

    @cached_property
    def composite(self):
        return X.composite_trend(self.segments, self.metrics)


# ---- merged bars ---------------------------------------------------------------------------------
MERGE = "RECURSIVE " + BASE + """,
mb AS MATERIALIZED (SELECT code, i, {'ts': ts, 'o': open, 'h': high, 'l': low, 'c': close, 'v': volume, 'a': amount, 'n': 1} AS s FROM b),
mr AS (SELECT code, CAST(0 AS BIGINT) AS i, CAST(NULL AS STRUCT(ts DATE, o DOUBLE, h DOUBLE, l DOUBLE, c DOUBLE, v DOUBLE, a DOUBLE, n INTEGER)) AS cur, CAST([] AS STRUCT(ts DATE, o DOUBLE, h DOUBLE, l DOUBLE, c DOUBLE, v DOUBLE, a DOUBLE, n INTEGER)[]) AS stk
    FROM (SELECT DISTINCT code FROM mb)
  UNION ALL
  SELECT code, i, CASE WHEN inc THEN {'ts': cur.ts, 'o': t.o, 'h': greatest(CASE WHEN up THEN greatest(t.h, cur.h) ELSE least(t.h, cur.h) END, t.o, cur.c), 'l': least(CASE WHEN up THEN greatest(t.l, cur.l) ELSE least(t.l, cur.l) END, t.o, cur.c),
      'c': cur.c, 'v': t.v + cur.v, 'a': t.a + cur.a, 'n': t.n + cur.n} END, CASE WHEN inc THEN stk[1:len(stk) - 1] ELSE list_append(stk, cur) END
  FROM (SELECT *, coalesce(len(stk) > 0 AND ((t.h >= cur.h AND t.l <= cur.l) OR (cur.h >= t.h AND cur.l <= t.l)), false) AS inc, len(stk) < 2 OR t.h > stk[-2].h AS up FROM (
    SELECT r.code, CASE WHEN r.cur IS NULL THEN r.i + 1 ELSE r.i END AS i, coalesce(r.cur, mb.s) AS cur, r.stk, r.stk[-1] AS t FROM mr r LEFT JOIN mb ON r.cur IS NULL AND mb.code = r.code AND mb.i = r.i WHERE r.cur IS NOT NULL OR mb.i IS NOT NULL))),
ml AS (SELECT code, arg_max(stk, i * 1000 + len(stk)) AS stk FROM mr WHERE cur IS NULL AND i = (SELECT max(i) + 1 FROM mb WHERE mb.code = mr.code) GROUP BY 1),
mg AS (SELECT code, unnest(stk) AS s FROM ml)"""


@query("c01_inclusion_merge", "code:s ts:d open:f8 high:f8 low:f8 close:f8 volume:f2 n_merged:i", MERGE + """
---
SELECT code, s.ts AS ts, s.o AS open, s.h AS high, s.l AS low, s.c AS close, s.v AS volume, s.n AS n_merged FROM mg""")
def merge(spark, sf):
    return X.merge_inclusions(bars(spark, sf))


INC = BASE + """,
ic AS (SELECT *, CASE WHEN ph >= high AND pl <= low THEN 'inside' WHEN high >= ph AND low <= pl THEN 'holds' ELSE 'none' END AS inclusion,
  CASE WHEN lag(high, 2) OVER w IS NULL OR ph > lag(high, 2) OVER w THEN 'up' ELSE 'down' END AS direction FROM b WINDOW w AS (PARTITION BY code ORDER BY ts)),
im AS (SELECT code, ts, inclusion, direction, po AS open, close, CASE WHEN direction = 'up' THEN greatest(ph, high) ELSE least(ph, high) END AS h, CASE WHEN direction = 'up' THEN greatest(pl, low) ELSE least(pl, low) END AS l FROM ic WHERE ph IS NOT NULL AND inclusion <> 'none')"""


@query("c02_inclusion_test", "code:s ts:d inclusion:s", INC + "\n---\nSELECT code, ts, inclusion FROM ic WHERE ph IS NOT NULL")
def inclusion(spark, sf):
    return X.inclusion_test(bars(spark, sf))


@query("c03_merge_direction", "code:s ts:d direction:s", INC + "\n---\nSELECT code, ts, direction FROM ic WHERE ph IS NOT NULL")
def direction(spark, sf):
    return X.merge_direction(bars(spark, sf))


@query("c04_merge_rule", "code:s ts:d inclusion:s direction:s open:f8 high:f8 low:f8 close:f8", INC + "\n---\nSELECT code, ts, inclusion, direction, open, greatest(h, open, close) AS high, least(l, open, close) AS low, close FROM im")
def merge_rule(spark, sf):
    """What each pair of neighbouring weekly bars would become."""
    return X.merge_pairs(bars(spark, sf))


@query("c05_fractals", "code:s ts:d kind:i price:f8", FX + "\n---\nSELECT * FROM fx")
def fractals(spark, sf):
    """Tops (1) and bottoms (-1) of the weekly bars."""
    return fx(spark, sf)


@query("c05_fractals_of_merged_bars", "code:s ts:d kind:i price:f8")
def merged_fractals(spark, sf):
    return X.fractals(X.merge_inclusions(bars(spark, sf)))


@query("c06_bottom_fractals", "code:s ts:d price:f8", FX + "\n---\nSELECT code, ts, price FROM fx WHERE kind = -1")
def bottoms(spark, sf):
    return fx(spark, sf).where("kind = -1")


@query("c07_fractal_strength", "code:s ts:d strength:f6 volume_ratio:f6 confidence:f2", FX + "\n---\nSELECT * FROM fx")
def fractal_strength(spark, sf):
    return fx(spark, sf)


@query("c08_fractal_reduction", "code:s seq:i ts:d kind:i", FX + "\n---\nSELECT * FROM rf")
def reduction(spark, sf):
    return X.reduce_fractals(fx(spark, sf))


@query("c08_fractal_reduction_extreme", "code:s seq:i ts:d kind:i price:f8", FX + f""",
e0 AS (SELECT *, sum(nw::INT) OVER (w ROWS UNBOUNDED PRECEDING) AS rn FROM (SELECT *, lag(kind) OVER w IS DISTINCT FROM kind AS nw FROM fx {WIN}) {WIN}),
e1 AS (SELECT * FROM e0 QUALIFY row_number() OVER (PARTITION BY code, rn ORDER BY price * kind DESC, ts) = 1)
---
SELECT *, row_number() OVER w AS seq FROM e1 {WIN}""")
def reduction_extreme(spark, sf):
    return X.reduce_fractals(fx(spark, sf), "extreme")


@query("c09_strokes", "code:s seq:i dir:i start_ts:d end_ts:d start_price:f8 end_price:f8 high:f8 low:f8 n_bars:i", SK + "\n---\nSELECT * FROM sk")
def stroke_rows(spark, sf):
    return strokes(spark, sf)


@query("c10_stroke_pair_modes", "code:s seq:i strict:b totally:b loss:b half:b", FX + """,
pm AS (SELECT *, lead(kind) OVER q AS nk, lead(high) OVER q AS nhi, lead(low) OVER q AS nlo, lead(win_low) OVER q AS nwl, lead(win_high) OVER q AS nwh FROM rf WINDOW q AS (PARTITION BY code ORDER BY seq)),
pn AS (SELECT code, seq, CASE WHEN kind = -1 THEN win_low < nwl ELSE win_high > nwh END AS strict, CASE WHEN kind = -1 THEN win_high < nwl ELSE win_low > nwh END AS totally, CASE WHEN kind = -1 THEN price < nlo ELSE price > nhi END AS loss FROM pm WHERE nk IS NOT NULL)
---
SELECT *, strict AS half FROM pn""")
def modes(spark, sf):
    return X.pair_modes(X.reduce_fractals(fx(spark, sf)))


@query("c11_stroke_strength", "code:s seq:i amplitude:f6 strength:f6 purity:f6", SK + "\n---\nSELECT * FROM sk")
def stroke_strength(spark, sf):
    return strokes(spark, sf)


@query("c12_stroke_relations", "code:s seq:i overlap:f6 retracement:f6 golden:b", SK + """,
rl AS (SELECT code, seq, least(start_price, end_price) AS lo, greatest(start_price, end_price) AS hi FROM sk), rm AS (SELECT *, lag(lo) OVER q AS plo, lag(hi) OVER q AS phi FROM rl WINDOW q AS (PARTITION BY code ORDER BY seq)),
rn AS (SELECT code, seq, CASE WHEN least(hi, phi) > greatest(lo, plo) AND least(hi - lo, phi - plo) > 0 THEN (least(hi, phi) - greatest(lo, plo)) / least(hi - lo, phi - plo) ELSE 0 END AS overlap, coalesce((hi - lo) / nullif(phi - plo, 0), 0) AS retracement FROM rm WHERE plo IS NOT NULL)
---
SELECT *, abs(retracement - 0.382) <= 0.05 OR abs(retracement - 0.5) <= 0.05 OR abs(retracement - 0.618) <= 0.05 OR abs(retracement - 0.809) <= 0.05 AS golden FROM rn""")
def relations(spark, sf):
    return X.stroke_relations(strokes(spark, sf))


@query("c13_reversal_points", "code:s seq:i end_ts:d confidence:f2", SK + """,
rv AS (SELECT *, lag(dir) OVER q AS pdir, lag(end_price) OVER q AS pe, lag(strength) OVER q AS ps, lead(dir) OVER q AS ndir, lead(end_price) OVER q AS ne, lead(strength) OVER q AS ns FROM sk WINDOW q AS (PARTITION BY code ORDER BY seq))
---
SELECT code, seq, end_ts, least(1, 0.5 + CASE WHEN coalesce(ns / nullif(ps, 0), 0.5) < 0.6 THEN 0.3 WHEN coalesce(ns / nullif(ps, 0), 0.5) < 0.8 THEN 0.2 ELSE 0 END + CASE WHEN abs(ne / pe - 1) > 0.05 THEN 0.1 ELSE 0 END) AS confidence FROM rv
WHERE pdir = ndir AND CASE WHEN pdir = 1 THEN ne > pe ELSE ne < pe END AND ns < ps * 0.8""")
def reversals(spark, sf):
    return X.reversal_points(strokes(spark, sf))


@query("c14_feature_sequence", "code:s seg:i seq:i dir:i end_price:f8", SEG + """
---
SELECT f.code, f.seg, k.seq, k.dir, k.end_price FROM sf1 f JOIN bi k ON k.code = f.code AND k.seq = f.x.q""")
def features(spark, sf):
    """Counter-strokes of each daily segment, contained ones gone."""
    t = Level(spark, sf)
    return X.feature_sequence(t.strokes, t.members)


@query("c15_segments", "code:s seq:i dir:i start_ts:d end_ts:d start_price:f8 end_price:f8 n_strokes:i", SEG + "\n---\nSELECT * FROM sk")
def segments(spark, sf):
    return Level(spark, sf).segments


@query("c16_segment_strength", "code:s seq:i amplitude:f6 strength:f6 integrity:f6", SEG + "\n---\nSELECT * FROM sk")
def segment_strength(spark, sf):
    return Level(spark, sf).segments


@query("c17_pivot_zones", "code:s zone:i first_seq:i last_seq:i start_ts:d end_ts:d low:f8 high:f8 extend_count:i", ZS + "\n---\nSELECT * FROM zs")
def zone_rows(spark, sf):
    return Level(spark, sf).zones


ZSW = "RECURSIVE " + SK + "," + without(ZS, SEG)


@query("c17_pivot_zones_of_strokes", "code:s zone:i first_seq:i last_seq:i start_ts:d end_ts:d low:f8 high:f8 extend_count:i", ZSW + "\n---\nSELECT * FROM zs")
def stroke_zones(spark, sf):
    """The same rule one level down: weekly strokes in the place of segments."""
    return X.zones(strokes(spark, sf))


@query("c17_pivot_zones_of_segments", "code:s zone:i first_seq:i last_seq:i low:f8 high:f8", suffixed(ZS.replace(D.BRAND_DAY.replace("dbars", "bars"), D.BRAND_WEEK)) + "\n---\nSELECT * FROM zs_w")
def segment_zones(spark, sf):
    """Zones of weekly segments."""
    return Level(spark, sf, "week").zones


ZM = ZS + """,
zm0 AS (SELECT z.code, zone, z.low AS zl, z.high AS zh, extend_count, k.strength, n_bars, least(start_price, end_price) AS l, greatest(start_price, end_price) AS h FROM zs z JOIN sk k ON k.code = z.code AND k.seq BETWEEN first_seq AND last_seq),
zm1 AS (SELECT code, zone, zl, zh, extend_count, avg(strength) AS s, sum(n_bars) AS bars, count(*) AS n, sum(CASE WHEN least(h, zh) > greatest(l, zl) AND h > l THEN n_bars * (least(h, zh) - greatest(l, zl)) / (h - l) ELSE 0 END) AS ins FROM zm0 GROUP BY 1, 2, 3, 4, 5),
zm AS (SELECT *, (zh - zl) / ((zh + zl) / 2) AS range_ratio, s * 0.4 + least(1, bars / 20e0) * 0.3 + least(1, (zh - zl) / ((zh + zl) / 2) * 10) * 0.2 + least(1, n / 5e0) * 0.1 AS strength, ins / bars * 0.7 + least(1, extend_count / 3e0) * 0.3 AS stability,
  CASE WHEN extend_count >= 3 THEN 'extended' WHEN n >= 5 THEN 'complex' ELSE 'normal' END AS zone_type FROM zm1)"""


@query("c18_zone_metrics", "code:s zone:i range_ratio:f6 strength:f6 stability:f6 bars:i zone_type:s", ZM + "\n---\nSELECT * FROM zm")
def zone_metrics(spark, sf):
    return Level(spark, sf).metrics


@query("c19_price_position", "code:s ts:d z_zone:i inside:b distance:f8 place:f6 broken:s", ZS + """
---
SELECT b.code, b.ts, z.zone AS z_zone, close BETWEEN z.low AND z.high AS inside, close - (z.low + z.high) / 2 AS distance, least(1, greatest(0, (close - z.low) / (z.high - z.low))) AS place,
  CASE WHEN close > z.high * 1.01 THEN 'up' WHEN close < z.low * 0.99 THEN 'down' ELSE 'none' END AS broken FROM b ASOF JOIN zs z ON z.code = b.code AND b.ts >= z.end_ts""")
def position(spark, sf):
    t = Level(spark, sf)
    return X.price_position(t.bars, t.zones)


@query("c20_nearest_zone", "code:s price:f8 distance:f4 nearest:i current:f0", ZS + """,
lp AS (SELECT code, arg_max(close, ts) AS price FROM b GROUP BY 1), nz AS (SELECT zs.*, price, abs(price - (low + high) / 2) AS d FROM zs JOIN lp USING (code))
---
SELECT code, price, min(d) AS distance, arg_min(zone, d) AS nearest, max(CASE WHEN price BETWEEN low AND high THEN zone END) AS current FROM nz GROUP BY 1, 2""")
def nearest(spark, sf):
    t = Level(spark, sf)
    return X.nearest_zone(t.bars.groupBy("code").agg(F.max_by("close", "ts").alias("price")), t.zones)


TT = ZH + """,
tt AS (SELECT code, n_zones, coalesce(ups, 0) AS ups, coalesce(downs, 0) AS downs FROM zh QUALIFY row_number() OVER (PARTITION BY code ORDER BY zone DESC) = 1),
ty AS (SELECT *, CASE WHEN n_zones >= 2 AND ups > downs THEN 'up_trend' WHEN n_zones >= 2 AND downs > ups THEN 'down_trend' ELSE 'consolidation' END AS trend FROM tt)"""


@query("c21_trend_type", "code:s n_zones:i ups:i downs:i trend:s", TT + "\n---\nSELECT * FROM ty")
def trend(spark, sf):
    return X.trend_type(Level(spark, sf).history)


# ---- MACD zones ----------------------------------------------------------------------------------
_mt, _ml = staged(MACD)
MZ = _mt + f""",
mz0 AS (SELECT *, last_value(CASE WHEN bar <> 0 THEN sign(bar) END IGNORE NULLS) OVER (w ROWS UNBOUNDED PRECEDING) AS sg FROM {_ml} {WIN}),
mz1 AS (SELECT *, lag(sg) OVER w IS DISTINCT FROM sg AS nw FROM mz0 WHERE sg IS NOT NULL {WIN}), mz2 AS (SELECT *, sum(nw::INT) OVER (w ROWS UNBOUNDED PRECEDING) AS zone FROM mz1 {WIN}),
mz AS (SELECT code, zone, sg, min(ts) AS start_ts, max(ts) AS end_ts, min(i) AS first_i, max(i) AS last_i, count(*) AS n, sum(abs(bar)) AS area, CASE WHEN sg < 0 THEN min(low) ELSE max(high) END AS extreme FROM mz2 GROUP BY 1, 2, 3 HAVING count(*) >= 2)"""


def _macd(spark, sf):
    return I.macd_columns(I.base_columns(bars(spark, sf)))


@query("c22_macd_zones", "code:s zone:i sg:f0 start_ts:d end_ts:d n:i area:f4 extreme:f8", MZ + "\n---\nSELECT * FROM mz")
def macd_zones(spark, sf):
    return X.macd_zones(_macd(spark, sf))


DV = MZ + f""",
dv0 AS (SELECT *, lag(area) OVER z AS pa, lag(extreme) OVER z AS pe FROM mz WINDOW z AS (PARTITION BY code, sg ORDER BY zone)),
xs AS (SELECT code, i, lag(dif) OVER w <= lag(dea) OVER w AND dif > dea AND bar >= 0 AS gold, lag(dif) OVER w >= lag(dea) OVER w AND dif < dea AND bar <= 0 AS dead FROM {_ml} {WIN}),
dv1 AS (SELECT d.code, d.zone, any_value(d.sg) AS sg, any_value(d.end_ts) AS end_ts, any_value(d.extreme) AS extreme, any_value(d.area / pa) AS ar, any_value(pe) AS pe, bool_or(gold) AS gold, bool_or(dead) AS dead FROM dv0 d JOIN xs ON xs.code = d.code AND xs.i BETWEEN d.last_i + 1 AND d.last_i + 4 WHERE pa > 0 GROUP BY 1, 2),
dv AS (SELECT code, zone, end_ts, extreme, ar AS area_ratio, abs((extreme - pe) / pe) * 100 AS gap_pct, CASE WHEN sg < 0 THEN 'bottom' ELSE 'top' END AS kind, least(0.9, CASE WHEN sg < 0 THEN ar - 1 ELSE 1 - ar END * 0.5 + abs((extreme - pe) / pe)) AS reliability FROM dv1
  WHERE (sg < 0 AND ar > 1.1 AND extreme < pe AND gold) OR (sg > 0 AND ar < 0.9 AND extreme > pe AND dead))"""


def _divergences(spark, sf):
    m = _macd(spark, sf)
    return X.area_divergence(X.macd_zones(m), m)


@query("c23_area_divergence", "code:s zone:i end_ts:d kind:s area_ratio:f6 gap_pct:f4 reliability:f6", DV + "\n---\nSELECT * FROM dv")
def divergences(spark, sf):
    return _divergences(spark, sf)


# ---- points --------------------------------------------------------------------------------------
P1 = ZS + """,
tz AS (SELECT *, EXISTS (SELECT 1 FROM zs WHERE zs.code = sk.code AND sk.start_ts <= zs.end_ts AND sk.end_ts >= zs.start_ts) AS in_zone FROM sk),
pr AS (SELECT a.*, (SELECT max(seq) FROM sk p WHERE p.code = a.code AND p.dir = a.dir AND p.seq < a.seq) AS pseq FROM sk a),
p1 AS (SELECT pr.code, pr.seq, pr.end_ts AS ts, pr.end_price AS price, CASE WHEN pr.dir = -1 THEN 'buy1' ELSE 'sell1' END AS point, CASE WHEN p.strength = 0 THEN 0.5 ELSE least(1 - pr.strength / p.strength, 1) END AS strength, 0.8e0 AS reliability
  FROM pr JOIN sk p ON p.code = pr.code AND p.seq = pr.pseq WHERE pr.strength < p.strength * 0.88 AND EXISTS (SELECT 1 FROM tz WHERE tz.code = pr.code AND tz.seq > pr.pseq AND tz.seq < pr.seq AND tz.in_zone))"""
_P = "code:s seq:i ts:d price:f8 point:s strength:f6 reliability:f2"


@query("c24_first_class_points", _P, P1 + "\n---\nSELECT * FROM p1")
def first_points(spark, sf):
    return Level(spark, sf).first_points


P2 = P1 + """,
lt AS (SELECT p1.code, p1.seq, p1.price AS pp, p1.point AS po, s.seq AS s, s.end_ts, s.end_price, s.strength AS st, row_number() OVER (PARTITION BY p1.code, p1.seq, p1.point ORDER BY s.seq) AS r FROM p1 JOIN sk s ON s.code = p1.code AND s.start_ts > p1.ts),
p2 AS (SELECT code, seq, end_ts AS ts, end_price AS price, CASE WHEN po = 'buy1' THEN 'buy2' ELSE 'sell2' END AS point, st AS strength, 0.7e0 AS reliability FROM lt WHERE r = 2 AND CASE WHEN po = 'buy1' THEN end_price > pp * 0.95 ELSE end_price < pp * 1.05 END)"""


@query("c25_second_class_points", _P, P2 + "\n---\nSELECT * FROM p2")
def second_points(spark, sf):
    t = Level(spark, sf)
    return X.second_points(t.segments, t.first_points)


P3 = ZS + """,
nt AS (SELECT a.code, a.seq, (SELECT min(seq) FROM sk t WHERE t.code = a.code AND t.start_ts > a.end_ts) AS tseq FROM sk a),
p3 AS (SELECT DISTINCT t.code, t.seq, t.end_ts AS ts, t.end_price AS price, CASE WHEN l.dir = 1 THEN 'buy3' ELSE 'sell3' END AS point, t.strength, 0.9e0 AS reliability FROM zs z JOIN sk l ON l.code = z.code AND l.start_ts >= z.end_ts JOIN nt ON nt.code = l.code AND nt.seq = l.seq JOIN sk t ON t.code = l.code AND t.seq = nt.tseq
  WHERE (l.dir = 1 AND l.end_price > z.high AND t.end_price > z.high * 0.98) OR (l.dir = -1 AND l.end_price < z.low AND t.end_price < z.low * 1.02))"""


@query("c26_third_class_points", _P, P3 + "\n---\nSELECT * FROM p3")
def third_points(spark, sf):
    t = Level(spark, sf)
    return X.third_points(t.segments, t.zones)


PTS = P2 + "," + without(P3, ZS) + """,
pts AS (SELECT * FROM p1 UNION ALL SELECT * FROM p2 UNION ALL SELECT * FROM p3)"""


def both(text):
    """CTEs of the daily text and, with the suffix ``_w``, of the same on weekly bars."""
    week = suffixed(text[len("RECURSIVE "):].replace(D.BRAND_DAY.replace("dbars", "bars"), D.BRAND_WEEK))
    return text + "," + week


WINDOW_DAYS = 7


@query("c27_level_confirmation", "code:s seq:i ts:d point:s confirmed:b reliability:f2 level:s", both(PTS) + f"""
---
SELECT code, seq, ts, point, cf AS confirmed, CASE WHEN cf THEN least(1, reliability + 0.2) ELSE reliability END AS reliability, 'day' AS level
  FROM (SELECT p.*, EXISTS (SELECT 1 FROM pts_w o WHERE o.code = p.code AND o.point[1:3] = p.point[1:3] AND abs(date_diff('day', o.ts, p.ts)) <= {WINDOW_DAYS}) AS cf FROM pts p)
UNION ALL SELECT code, seq, ts, point, cf, CASE WHEN cf THEN least(1, reliability + 0.1) ELSE reliability END, 'week'
  FROM (SELECT p.*, EXISTS (SELECT 1 FROM pts o WHERE o.code = p.code AND o.point[1:3] = p.point[1:3] AND abs(date_diff('day', o.ts, p.ts)) <= {WINDOW_DAYS}) AS cf FROM pts_w p)""")
def confirmation(spark, sf):
    """Points of daily and of weekly segments against each other's: a higher level adds 0.2, a lower one 0.1."""
    day, week = (Level(spark, sf, k).points for k in ("day", "week"))
    return X.confirm_levels(day, "day", week, WINDOW_DAYS, 0.2).unionByName(X.confirm_levels(week, "week", day, WINDOW_DAYS, 0.1))


@query("c27_level_nesting", "code:s seq:i dir:i start_ts:d end_ts:d upper_seq:i upper_dir:i", both(BI) + """
---
SELECT l.code, l.seq, l.dir, l.start_ts, l.end_ts, CASE WHEN l.end_ts <= u.end_ts + 6 THEN u.seq END AS upper_seq, CASE WHEN l.end_ts <= u.end_ts + 6 THEN u.dir END AS upper_dir
FROM bi l ASOF LEFT JOIN bi_w u ON u.code = l.code AND l.start_ts >= u.start_ts""")
def nesting(spark, sf):
    """Daily strokes and the weekly stroke whose span holds each; a week's bar is named by its Monday."""
    day, week = (Level(spark, sf, k).strokes for k in ("day", "week"))
    return X.nest_levels(day.select("code", "seq", "dir", "start_ts", "end_ts"), week, 6)


CT = ZS + """,
ct0 AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY seq DESC) AS r FROM sk),
ct1 AS (SELECT code, count(*) AS n, avg(strength) AS s, sum(CASE WHEN r <= 3 THEN dir ELSE 0 END) AS v, avg((dir = 1)::INT) AS u FROM ct0 GROUP BY 1),
ct2 AS (SELECT *, CASE WHEN n < 2 THEN 'consolidation' WHEN v > 0 THEN 'up' WHEN v < 0 THEN 'down' ELSE 'consolidation' END AS direction FROM ct1),
ct AS (SELECT code, n, direction, s * 0.6 + CASE direction WHEN 'up' THEN u WHEN 'down' THEN 1 - u ELSE 0.5 END * 0.4 AS trend_strength FROM ct2)"""
LEVELS = CT + "," + without(PTS, ZS)
LV = both(LEVELS) + """,
lh AS (SELECT 'day' AS level, code, bool_or(point LIKE 'buy%') AS has_buy, bool_or(point LIKE 'sell%') AS has_sell FROM pts GROUP BY 2 UNION ALL SELECT 'week', code, bool_or(point LIKE 'buy%'), bool_or(point LIKE 'sell%') FROM pts_w GROUP BY 2),
lv AS (SELECT c.*, coalesce(has_buy, false) AS has_buy, coalesce(has_sell, false) AS has_sell FROM (SELECT code, 'day' AS level, direction, trend_strength AS strength FROM ct UNION ALL SELECT code, 'week', direction, trend_strength FROM ct_w) c LEFT JOIN lh USING (level, code)),
lw AS (SELECT *, CASE level WHEN 'week' THEN 0.9e0 ELSE 0.8e0 END AS w FROM lv),
lx AS (SELECT code, count(*) AS levels, count_if(direction = 'up') AS u, count_if(direction = 'down') AS d, count_if(has_buy) AS buys, count_if(has_sell) AS sells, sum(w) AS tw, sum(CASE WHEN direction = 'up' THEN w * (1 + CASE WHEN has_buy THEN 0.3 ELSE 0 END) ELSE 0 END) AS mu,
  sum(CASE WHEN direction = 'down' THEN w * (1 + CASE WHEN has_sell THEN 0.3 ELSE 0 END) ELSE 0 END) AS md, sum(CASE WHEN direction NOT IN ('up', 'down') THEN w ELSE 0 END) AS mn, sum(CASE WHEN direction = 'up' THEN w * strength ELSE 0 END) AS su, sum(CASE WHEN direction = 'down' THEN w * strength ELSE 0 END) AS sd, sum(w * strength) AS ts FROM lw GROUP BY 1),
ly AS (SELECT *, CASE WHEN levels < 2 THEN 0 ELSE greatest(u, d, levels - u - d) / levels END AS consistency, CASE WHEN buys > sells THEN mu WHEN sells > buys THEN md ELSE mn END / tw AS resonance, CASE WHEN su > sd * 1.5 THEN 'up' WHEN sd > su * 1.5 THEN 'down' ELSE 'consolidation' END AS overall, coalesce(greatest(su, sd) / nullif(ts, 0), 0) AS confidence FROM lx)"""


@query("c28_level_consistency", "code:s levels:i consistency:f4 resonance:f6 overall:s confidence:f6 action:s position:f6", LV + """
---
SELECT *, CASE WHEN overall = 'up' AND resonance > 0.5 THEN 'buy' WHEN overall = 'down' AND resonance > 0.5 THEN 'sell' ELSE 'hold' END AS action,
  CASE WHEN overall = 'up' AND resonance > 0.7 THEN least(1, resonance * 1.2) WHEN overall = 'up' AND resonance > 0.5 THEN resonance * 0.6 WHEN overall = 'down' AND resonance > 0.7 THEN 1 WHEN overall = 'down' AND resonance > 0.5 THEN 0.5 ELSE 0 END AS position FROM ly""")
def consistency(spark, sf):
    """Trend and points of daily and of weekly segments."""
    side = lambda x: F.max(c("point").startswith(x)).alias(f"has_{x}")
    rows = []
    for name in ("day", "week"):
        t = Level(spark, sf, name)
        p = t.points.groupBy("code").agg(side("buy"), side("sell"))
        d = X.composite_trend(t.segments).join(p, "code", "left").withColumn("level", F.lit(name))
        rows.append(d.select("code", "level", "direction", c("trend_strength").alias("strength"), *(F.coalesce(f"has_{x}", F.lit(False)).alias(f"has_{x}") for x in ("buy", "sell"))))
    return X.level_consistency(rows[0].unionByName(rows[1]))


# ---- gaps ----------------------------------------------------------------------------------------
GP = BASE + """,
gp0 AS (SELECT *, CASE WHEN low > ph THEN 'up' WHEN high < pl THEN 'down' END AS gap FROM b),
gp AS (SELECT code, ts, i + 1 AS i, gap, CASE WHEN gap = 'up' THEN ph ELSE pl END AS edge, CASE WHEN gap = 'up' THEN low - ph ELSE pl - high END AS points FROM gp0 WHERE gap IS NOT NULL)"""


@query("c29_gaps", "code:s ts:d gap:s edge:f8 points:f6 pct:f6", GP + "\n---\nSELECT *, points / edge * 100 AS pct FROM gp")
def gap_rows(spark, sf):
    return X.gaps(bars(spark, sf))


@query("c30_gap_persistence", "code:s ts:d gap:s held:b", GP + f""",
gw AS (SELECT code, ts, min(low) OVER v AS lo, max(high) OVER v AS hi FROM b WINDOW v AS (PARTITION BY code ORDER BY ts ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING))
---
SELECT gp.code, gp.ts, gap, CASE WHEN gap = 'up' THEN lo > edge ELSE hi < edge END AS held FROM gp JOIN gw ON gw.code = gp.code AND gw.ts = gp.ts""")
def persistence(spark, sf):
    return X.gap_persistence(bars(spark, sf))


@query("c30_gap_fill", "code:s ts:d gap:s bars_to_fill:f0", GP + """
---
SELECT gp.code, gp.ts, any_value(gap) AS gap, min(CASE WHEN CASE WHEN gap = 'up' THEN b.low <= edge ELSE b.high >= edge END THEN b.i + 1 - gp.i END) AS bars_to_fill FROM gp LEFT JOIN b ON b.code = gp.code AND b.i + 1 > gp.i GROUP BY 1, 2""")
def gap_fill(spark, sf):
    return X.gap_fill(bars(spark, sf))


# ---- swings (three bars to either side keep the weekly series busy) --------------------------------
SW = BASE + f""",
sw0 AS (SELECT *, max(high) OVER v AS mh, min(low) OVER v AS ml, count(*) OVER v AS n FROM b WINDOW v AS (PARTITION BY code ORDER BY ts ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)),
sw1 AS (SELECT code, ts, CASE WHEN n = 5 AND high = mh AND low <> ml THEN 1 WHEN n = 5 AND low = ml AND high <> mh THEN -1 END AS kind, high, low FROM sw0),
sw2 AS (SELECT code, ts, kind, CASE WHEN kind = 1 THEN high ELSE low END AS price, lag(kind) OVER w IS DISTINCT FROM kind AS nw FROM sw1 WHERE kind IS NOT NULL {WIN}),
sw3 AS (SELECT *, sum(nw::INT) OVER (w ROWS UNBOUNDED PRECEDING) AS rn FROM sw2 {WIN}), sw4 AS (SELECT * FROM sw3 QUALIFY row_number() OVER (PARTITION BY code, rn ORDER BY price * kind DESC, ts) = 1),
sw AS (SELECT code, ts, kind, price, row_number() OVER w AS seq FROM sw4 {WIN}),
sl AS (SELECT *, """ + ", ".join(f"lead(price, {k}) OVER q AS p{k}, lead(ts, {k}) OVER q AS t{k}" for k in range(1, 6)) + " FROM sw WINDOW q AS (PARTITION BY code ORDER BY seq))"


def _swings(spark, sf):
    return X.swings(bars(spark, sf), 2)


@query("c31_swings", "code:s seq:i ts:d kind:i price:f8", SW + "\n---\nSELECT * FROM sw")
def swing_rows(spark, sf):
    return _swings(spark, sf)


def _gaps_ok(n):
    return " AND ".join(f"date_diff('day', {'ts' if k == 0 else f't{k}'}, t{k + 1}) >= 5" for k in range(n))


# twelve-bar means: the invented weekly prices jump too much for five orderly waves
SWM = SW.replace("FROM b WINDOW v AS", f"FROM (SELECT code, ts, avg(close) OVER (w ROWS 11 PRECEDING) AS high, avg(close) OVER (w ROWS 11 PRECEDING) AS low FROM b {WIN}) WINDOW v AS")


def _smooth_swings(spark, sf):
    m = I.sma("close", 12)
    return X.swings(bars(spark, sf).select("code", "ts", m.alias("high"), m.alias("low")), 2)


@query("c32_elliott_impulse", "code:s seq:i ts:d signal:i w1:f6 w2:f6 w3:f6 w4:f6 w5:f6", SWM + f""",
el AS (SELECT code, seq, t5 AS ts, kind AS signal, -kind * (p1 - price) AS w1, kind * (p2 - p1) AS w2, -kind * (p3 - p2) AS w3, kind * (p4 - p3) AS w4, -kind * (p5 - p4) AS w5, -kind * (p2 - price) AS c1, -kind * (p4 - p1) AS c2 FROM sl WHERE p5 IS NOT NULL AND {_gaps_ok(5)})
---
SELECT * FROM el WHERE w1 > 0 AND w3 > 0 AND w5 > 0 AND c1 > 0 AND c2 > 0 AND NOT (w3 < w1 AND w3 < w5) AND w2 / w1 BETWEEN -1.5 AND 2.618 AND w3 / w1 BETWEEN -1 AND 4.618 AND w4 / w3 BETWEEN -1.764 AND 2.5""")
def impulse(spark, sf):
    """Invented prices rarely obey the usual tolerance of 0.15, so a wide one is used here."""
    return X.elliott_impulse(_smooth_swings(spark, sf), tol=2.0)


@query("c33_elliott_abc", "code:s seq:i ts:d signal:i wave_a:f6 wave_b:f6 wave_c:f6", SW + f""",
ab AS (SELECT code, seq, t3 AS ts, kind AS signal, kind * (price - p1) AS wave_a, kind * (p2 - p1) AS wave_b, kind * (p2 - p3) AS wave_c, kind * (price - p2) AS h FROM sl WHERE p3 IS NOT NULL AND {_gaps_ok(3)})
---
SELECT * FROM ab WHERE wave_a > 0 AND wave_b > 0 AND wave_c > 0 AND h > 0 AND wave_b / wave_a BETWEEN 0.382 - 0.15 AND 0.618 + 0.15 AND wave_c / wave_a BETWEEN 0.618 - 0.15 AND 1.618 + 0.15""")
def abc(spark, sf):
    return X.elliott_abc(_swings(spark, sf))


@query("c34_harmonic_patterns", "code:s seq:i ts:d pattern:s signal:i b_retrace:f6 d_retrace:f6 bc_ratio:f6 cd_ratio:f6", SW + """,
ha AS (SELECT code, seq, t4 AS ts, -kind AS signal, abs(p2 - p1) / nullif(abs(p1 - price), 0) AS b_retrace, abs(p4 - p1) / nullif(abs(p1 - price), 0) AS d_retrace, coalesce(abs(p3 - p2) / nullif(abs(p2 - p1), 0), 0) AS bc_ratio, coalesce(abs(p4 - p3) / nullif(abs(p3 - p2), 0), 0) AS cd_ratio FROM sl WHERE p4 IS NOT NULL),
hp(pattern, b0, b1, d0, d1, c0, c1, e0, e1) AS (VALUES ('Gartley', 0.55, 0.68, 0.72, 0.84, 0.382, 0.886, 1.27, 1.618), ('Bat', 0.33, 0.55, 0.82, 0.94, 0.382, 0.886, 1.618, 2.618), ('Butterfly', 0.72, 0.84, 1.20, 1.38, 0.382, 0.886, 1.618, 2.618), ('Crab', 0.33, 0.68, 1.52, 1.72, 0.382, 0.886, 2.24, 3.618))
---
SELECT ha.*, pattern FROM ha JOIN hp ON b_retrace BETWEEN b0 - 0.1 AND b1 + 0.1 AND d_retrace BETWEEN d0 - 0.1 AND d1 + 0.1 AND bc_ratio BETWEEN c0 - 0.1 AND c1 + 0.1 AND cd_ratio BETWEEN e0 - 0.1 AND e1 + 0.1""")
def harmonic(spark, sf):
    return X.harmonic_patterns(_swings(spark, sf))


# ---- scoring -------------------------------------------------------------------------------------
SCORES = [("bar_zdf", "大涨", 60.0), ("bar_zdf", "涨", 30.0), ("bar_zdf", "大跌", -60.0), ("bar_zdf", "跌", -30.0), ("bar_channel", "上轨", 40.0), ("bar_channel", "下轨附近", -40.0), ("vol_single_ma", "巨量", 50.0), ("vol_single_ma", "量", -10.0),
          ("jcc_engulfing", "看涨", 70.0), ("jcc_engulfing", "看跌吞没", -70.0), ("sta_consecutive", "连涨", 35.0), ("sta_consecutive", "连跌", -35.0)]
NAMES = ["bar_zdf", "bar_channel", "vol_single_ma", "jcc_engulfing", "sta_consecutive"]
# The named strategies. Conditions are (signal, text in its label).
STRATEGIES = [
    {"name": "底背驰反转", "all": [("cxt_backchi_signal", "底背驰")], "any": [("tas_macd_cross", "金叉"), ("tas_kdj_cross", "金叉"), ("tas_double_ma", "金叉")],
     "not": [("cxt_backchi_signal", "顶背驰"), ("tas_rsi_status", "超买")], "min_score": 58, "min_category": {"cxt": 10}},
    {"name": "一类买点", "all": [("cxt_first_buy", "一类买")], "any": [("tas_macd_bc", "底背驰"), ("cxt_bi_macd_diverge", "底背离")],
     "not": [("cxt_backchi_signal", "顶背驰")], "min_score": 60, "min_category": {"cxt": 20}},
    {"name": "中枢突破追涨", "all": [("cxt_zs_breakout", "向上突破")], "any": [("tas_ma_system", "多头排列"), ("tas_double_ma", "金叉")],
     "not": [("cxt_backchi_signal", "顶背驰"), ("tas_rsi_status", "超买")], "min_score": 60, "min_category": {"cxt": 15}},
    {"name": "超卖反弹", "all": [("tas_rsi_status", "超卖")], "any": [("tas_kdj_cross", "金叉"), ("jcc_hammer", "锤子线"), ("jcc_engulfing", "看多吞没"), ("jcc_xing_xian", "晨星")],
     "not": [("tas_ma_system", "空头排列")], "min_score": 52},
    {"name": "均线多头回踩", "all": [("tas_ma_system", "多头排列"), ("pos_above_ma", "均线上方")], "any": [("tas_boll_status", "中轨上方"), ("pos_support_resistance", "支撑位附近"), ("vol_shrink", "缩量")],
     "not": [("bar_zdf", "大跌"), ("bar_zdf", "跌停")], "min_score": 58, "min_category": {"tas": 10}},
    {"name": "三类买点回试", "all": [("cxt_third_buy", "三类买")], "any": [("vol_break", "放量突破"), ("tas_volume_price", "价涨量增")],
     "not": [("cxt_backchi_signal", "顶背驰")], "min_score": 55, "min_category": {"cxt": 15}},
    {"name": "顶背驰逃顶", "all": [("cxt_backchi_signal", "顶背驰")], "any": [("tas_macd_cross", "死叉"), ("tas_kdj_cross", "死叉"), ("jcc_wu_yun_gai_ding", "乌云盖顶"), ("jcc_three_crow", "三只乌鸦")],
     "not": [("tas_ma_system", "多头排列")], "min_score": 40, "min_category": {"cxt": -10}},
    {"name": "缩量阴跌风险", "all": [("tas_ma_system", "空头排列")], "any": [("vol_shrink", "缩量"), ("tas_rsi_status", "偏弱")],
     "not": [("cxt_backchi_signal", "底背驰")], "min_score": 42, "min_category": {"tas": -10}},
]
# Scores of the labels of the signals that strategies read.
RULE_SCORES = {
    "cxt_first_buy": {"一类买": 80, "一类买_确认": 90, "一类买_未确认": 55}, "cxt_third_buy": {"三类买": 60, "三类买_确认": 70}, "cxt_zs_breakout": {"向上突破": 70, "向下突破": -70, "在中枢内": 0},
    "cxt_backchi_signal": {"底背驰": 75, "顶背驰": -75, "无背驰": 0, "底背驰_强": 90, "顶背驰_强": -90}, "cxt_bi_macd_diverge": {"底背离": 65, "顶背离": -65, "无背离": 0},
    "tas_macd_cross": {"金叉": 60, "死叉": -60}, "tas_macd_bc": {"底背驰": 70, "顶背驰": -70, "无背驰": 0}, "tas_ma_system": {"多头排列": 55, "空头排列": -55, "交叉排列": 0},
    "tas_double_ma": {"金叉": 50, "死叉": -50, "多头": 25, "空头": -25}, "tas_boll_status": {"上轨附近": -20, "中轨上方": 20, "中轨附近": 0, "中轨下方": -15, "下轨附近": 25},
    "tas_kdj_cross": {"金叉": 45, "死叉": -45, "超买": -30, "超卖": 30}, "tas_rsi_status": {"超买": -35, "超卖": 35, "中性": 0, "偏强": 15, "偏弱": -15},
    "tas_volume_price": {"价涨量增": 40, "价跌量缩": 10, "价涨量缩": -15, "价跌量增": -35, "量价中性": 0}, "bar_zdf": {"涨停": 80, "大涨": 50, "小涨": 20, "横盘": 0, "小跌": -20, "大跌": -50, "跌停": -80},
    "vol_break": {"放量突破": 60, "缩量突破": 20, "放量下跌": -50, "缩量下跌": -15, "无突破": 0}, "vol_shrink": {"缩量": -15, "放量": 25, "正常": 0}, "jcc_wu_yun_gai_ding": {"乌云盖顶": -55},
    "jcc_xing_xian": {"晨星": 55, "暮星": -55}, "jcc_three_crow": {"三只乌鸦": -55}, "jcc_hammer": {"锤子线": 45, "上吊线": -40}, "jcc_engulfing": {"看多吞没": 55, "看空吞没": -55},
    "pos_above_ma": {"均线上方": 25, "均线下方": -25, "均线附近": 0},
}
RULE_ROWS = [(n, v, float(x)) for n, t in RULE_SCORES.items() for v, x in t.items()]


def _signal_sql():
    from barloom.plans.registry import ORACLES

    text, parts = [], []
    for i, n in enumerate(NAMES):
        key = next(k for k in ORACLES if k.endswith(n) and k[0] == "g")
        text.append(f"sg{i} AS ({ORACLES[key]})")
        parts.append(f"SELECT code, ts, '{n}' AS name, '{n.split('_')[0]}' AS category, {n} AS v1 FROM sg{i} WHERE {n} <> '其他'")
    return ",\n".join(text) + ",\nsig AS (" + " UNION ALL ".join(parts) + ")"


import barloom.plans.signals  # noqa: E402,F401  (the label queries above come first)


def score_sql(rows, src="sig"):
    """``ss``: the rows of ``src`` (code, ts, name, category, v1) with their scores."""
    return "st(name, value, sc, o) AS (VALUES " + ", ".join(f"('{a}', '{b}', {v}e0, {i})" for i, (a, b, v) in enumerate(rows)) + f"""),
sl AS (SELECT DISTINCT name, v1 FROM {src}),
sx AS (SELECT l.name, l.v1, arg_max(st.sc, n) AS sc FROM (SELECT name, v1, unnest(range(1, len(string_split(v1, '_')) + 1)) AS n FROM sl) l JOIN st ON st.name = l.name AND st.value = array_to_string(string_split(l.v1, '_')[1:n], '_') GROUP BY 1, 2),
sy AS (SELECT l.name, l.v1, arg_min(st.sc, st.o) AS sc FROM sl l JOIN st ON st.name = l.name AND (contains(l.v1, st.value) OR contains(st.value, l.v1)) WHERE NOT EXISTS (SELECT 1 FROM sx WHERE sx.name = l.name AND sx.v1 = l.v1) GROUP BY 1, 2),
ss AS (SELECT s.*, coalesce(z.sc, 0) AS score FROM {src} s LEFT JOIN (SELECT * FROM sx UNION ALL SELECT * FROM sy) z ON z.name = s.name AND z.v1 = s.v1)"""


SG = _signal_sql() + ",\n" + score_sql(SCORES)
FU = SG + """,
fc AS (SELECT code, ts, category, avg(score) AS m FROM ss GROUP BY 1, 2, 3),
fw AS (SELECT code, ts, sum(m * w) / sum(w) AS total, CASE WHEN greatest(count_if(m > 10), count_if(m < -10)) >= 3 THEN 0.2 WHEN greatest(count_if(m > 10), count_if(m < -10)) >= 2 THEN 0.1 ELSE 0 END AS bonus, count(*) AS families
  FROM (SELECT *, CASE category WHEN 'bar' THEN 0.1e0 WHEN 'vol' THEN 0.15e0 WHEN 'jcc' THEN 0.05e0 WHEN 'sta' THEN 0.05e0 END AS w FROM fc) GROUP BY 1, 2),
fu AS (SELECT *, greatest(0, least(100, 50 + total * 0.5 * (1 + bonus))) AS final FROM fw)"""


def _signals(spark, sf):
    return G.signal_rows(G.signal_frame(bars(spark, sf), NAMES), "week").withColumn("ts", F.date_format("ts", "yyyy-MM-dd"))


def _score_table(spark, rows):
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "name string, value string, score double, ord int")


def _scored(spark, sf):
    return X.score_signals(_signals(spark, sf).select("code", "ts", "name", "category", "v1"), _score_table(spark, SCORES))


@query("c35_signal_scores", "code:s ts:s name:s v1:s score:f2", SG + "\n---\nSELECT * FROM ss")
def scores(spark, sf):
    return _scored(spark, sf)


@query("c36_category_fusion", "code:s ts:s families:i total:f4 bonus:f2 final:f4 direction:s power:s", FU + """
---
SELECT *, CASE WHEN final >= 52 THEN 'bullish' WHEN final <= 48 THEN 'bearish' ELSE 'neutral' END AS direction, CASE WHEN final >= 70 OR final <= 30 THEN 'strong' WHEN final >= 58 OR final <= 42 THEN 'medium' ELSE 'weak' END AS power FROM fu""")
def fusion(spark, sf):
    return X.fuse_categories(_scored(spark, sf))


@query("c39_divergence_selector", "code:s kind:s score:f4 power:s stop_loss:f4 take_profit:f4", DV + """,
dl AS (SELECT code, kind, reliability, area_ratio, gap_pct, extreme AS price, CASE WHEN kind = 'bottom' THEN -1 ELSE 1 END AS dif FROM dv QUALIFY row_number() OVER (PARTITION BY code ORDER BY end_ts DESC) = 1),
dk AS (SELECT *, CASE WHEN kind = 'bottom' THEN price * 0.95 ELSE price * 1.05 END AS stop_loss, CASE WHEN kind = 'bottom' THEN price * (1 + reliability * 0.15) ELSE price * (1 - reliability * 0.15) END AS take_profit FROM dl),
dr AS (SELECT *, abs(take_profit - price) / nullif(abs(price - stop_loss), 0) AS rr FROM dk),
ds AS (SELECT *, reliability * 30 + greatest(CASE WHEN kind = 'bottom' THEN least((area_ratio - 1) * 25, 25) ELSE least((1 - area_ratio) * 50, 25) END, 0) + least(gap_pct * 2, 20) + 15 + CASE WHEN rr IS NULL THEN 5 WHEN rr >= 3 THEN 10 WHEN rr >= 2 THEN 7 + (rr - 2) * 2 WHEN rr >= 1.5 THEN 5 + (rr - 1.5) * 4 ELSE 2 + rr * 2 END AS score FROM dr)
---
SELECT *, CASE WHEN score >= 80 THEN 'strong' WHEN score >= 60 THEN 'medium' ELSE 'weak' END AS power FROM ds ORDER BY round(score, 6) DESC, code LIMIT 20""")
def selector(spark, sf):
    d = _divergences(spark, sf).groupBy("code").agg(F.max_by(F.struct("kind", "reliability", "area_ratio", "gap_pct", c("extreme").alias("price")), "end_ts").alias("_d")).select("code", "_d.*")
    return X.divergence_selector(d.withColumn("dif", F.when(c("kind") == "bottom", -1.0).otherwise(1.0)), 20)


DVD = daily(DV)


@query("c40_divergence_consensus", "code:s level:s ts:d kind:s confirming:i", DVD + "," + suffixed(DV) + f"""
,pt AS (SELECT code, 'day' AS level, end_ts AS ts, kind FROM dv UNION ALL SELECT code, 'week' AS level, end_ts, kind FROM dv_w)
---
SELECT p.code, p.level, p.ts, p.kind, count(DISTINCT o.level) AS confirming FROM pt p LEFT JOIN pt o ON o.code = p.code AND o.kind = p.kind AND o.level <> p.level AND abs(date_diff('day', p.ts, o.ts)) <= {WINDOW_DAYS} GROUP BY 1, 2, 3, 4""")
def consensus(spark, sf):
    """Divergences of daily and of weekly bars."""
    d, w = (Level(spark, sf, k).divergences.select("code", F.lit(k).alias("level"), c("end_ts").alias("ts"), "kind") for k in ("day", "week"))
    return X.divergence_consensus(d.unionByName(w), WINDOW_DAYS)


RISK = CT + "," + without(ZM, ZS) + """,
rk AS (SELECT ct.*, st FROM ct LEFT JOIN (SELECT code, avg(stability) AS st FROM zm GROUP BY 1) z USING (code)),
rt AS (SELECT code, direction, trend_strength, CASE WHEN st IS NULL THEN 1 - trend_strength ELSE (1 - st + 1 - trend_strength) / 2 END AS risk, (least(n / 100e0, 1) + 0.7 + CASE WHEN st IS NOT NULL THEN 0.3 ELSE 0 END + 0.5) / 3 AS confidence FROM rk)"""


@query("c41_composite_trend", "code:s direction:s trend_strength:f6 risk:f6 confidence:f6", RISK + "\n---\nSELECT * FROM rt")
def composite(spark, sf):
    return Level(spark, sf).composite


@query("c42_recommendation", "code:s action:s entry:f8 stop_loss:f4 take_profit:f4", RISK + "," + without(PTS, ZS) + """,
lpt AS (SELECT * FROM pts QUALIFY row_number() OVER (PARTITION BY code ORDER BY ts DESC, point DESC) = 1), lz AS (SELECT * FROM zs QUALIFY row_number() OVER (PARTITION BY code ORDER BY zone DESC) = 1),
rc AS (SELECT rt.code, p.price, z.low AS zl, z.high AS zh, CASE WHEN p.point IS NULL THEN 'wait' WHEN p.point LIKE 'buy%' AND p.reliability > 0.6 AND direction IN ('up', 'consolidation') THEN 'buy' WHEN p.point LIKE 'sell%' AND p.reliability > 0.6 AND direction IN ('down', 'consolidation') THEN 'sell' ELSE 'hold' END AS action
  FROM rt LEFT JOIN lpt p ON p.code = rt.code LEFT JOIN lz z ON z.code = rt.code)
---
SELECT code, action, CASE WHEN action IN ('buy', 'sell') THEN price END AS entry, CASE WHEN action = 'buy' AND zl IS NOT NULL THEN zl * 0.98 WHEN action = 'sell' AND zl IS NOT NULL THEN zh * 1.02 END AS stop_loss,
  CASE WHEN action = 'buy' AND zl IS NOT NULL THEN price * 1.1 WHEN action = 'sell' AND zl IS NOT NULL THEN price * 0.9 END AS take_profit FROM rc""")
def recommend(spark, sf):
    """The latest point of any class against the trend of the segments."""
    t = Level(spark, sf)
    last = t.zones.groupBy("code").agg(F.max_by(F.struct("low", "high"), "zone").alias("_z")).select("code", "_z.*")
    return X.recommendation(t.composite, t.points, last)


# ---- structure signals ---------------------------------------------------------------------------
def case(*steps, default="其他"):
    return "CASE " + " ".join(f"WHEN {a} THEN '{b}'" for a, b in steps) + f" ELSE '{default}' END"


def h(k=0):
    return "high" if k == 0 else f"lag(high, {k}) OVER q"


def l(k=0):  # noqa: E743
    return "low" if k == 0 else f"lag(low, {k}) OVER q"


def _box(n, a, b):
    return "least(" + ", ".join(h(n - 1 - i) for i in range(a, b)) + ")", "greatest(" + ", ".join(l(n - 1 - i) for i in range(a, b)) + ")"


def stroke_frame(t):
    """Daily strokes with the zones of segments that were finished by each stroke's end."""
    return cxt.stroke_frame(t.strokes, t.history)


def segment_frame(t):
    return t.segments.withColumn("k", F.row_number().over(Window.partitionBy("code").orderBy("seq")))


STROKE_SQL, BAR_SQL = {}, {}


def stroke_query(num, name, need, v1, v2=None, base=SF, extra=None, src="sf", frame=stroke_frame):
    cols = f"coalesce(CASE WHEN k >= {need} THEN {v1} END, '其他') AS {name}"
    STROKE_SQL[name] = (need, v1, v2)
    spec = f"code:s seq:i {name}:s"
    if v2:
        cols += f", coalesce(CASE WHEN k >= {need} THEN {v2} END, '任意') AS {name}_v2"
        spec += f" {name}_v2:s"

    @query(f"g{num:03d}_{name}", spec, f"{base}\n---\nSELECT code, seq, {cols} FROM {src} WINDOW q AS (PARTITION BY code ORDER BY seq)")
    def run(spark, sf):
        t = Level(spark, sf)
        d = frame(t)
        return cxt.stroke_signals(extra(spark, sf, t, d) if extra else d, [name])


_sl = "regr_slope({}, seq) OVER (q ROWS 4 PRECEDING)"
stroke_query(127, "cxt_bi_trend", 5, case((f"{_sl.format('high')} > 0 AND {_sl.format('low')} > 0", "上涨"), (f"{_sl.format('high')} < 0 AND {_sl.format('low')} < 0", "下跌"), default="震荡"))
_z = "(end_price / start_price - 1) * 100"
stroke_query(128, "cxt_bi_zdf", 1, case((f"{_z} > 5", "大涨"), (f"{_z} > 2", "小涨"), (f"{_z} > -2", "横盘"), (f"{_z} > -5", "小跌"), default="大跌"))
stroke_query(130, "cxt_three_bi", 3, case((f"{h()} > {h(2)} AND {l(1)} > {l(2)}", "上涨趋势"), (f"{l()} < {l(2)} AND {h(1)} < {h(2)}", "下跌趋势"), (f"{h()} > {h(2)} AND {l()} < {l(2)}", "扩张形态"), (f"{h()} < {h(2)} AND {l()} > {l(2)}", "收敛形态"), default="震荡形态"))
stroke_query(131, "cxt_five_bi", 5, case((f"{h()} > {h(2)} AND {l()} > {l(2)} AND {l(2)} > {l(4)}", "二买"), (f"{h()} < {h(2)} AND {h(2)} < {h(4)}", "二卖"), (f"{l()} > {l(2)} AND {l(2)} >= {l(4)} * 0.98", "类二买")))
stroke_query(132, "cxt_seven_bi", 7, case((f"{h()} > {h(4)} AND {l()} > {l(4)}", "上涨中枢"), (f"{h()} < {h(4)} AND {l()} < {l(4)}", "下跌中枢"), default="盘整中枢"))
(_a, _b), (_d, _e) = _box(9, 2, 5), _box(9, 5, 8)
stroke_query(133, "cxt_nine_bi", 9, case((f"{_e} > {_b} AND {_d} > {_a}", "上涨双中枢"), (f"{_e} < {_b} AND {_d} < {_a}", "下跌双中枢"), default="盘整双中枢"))
_g = lambda fn, a, b: f"{fn}(" + ", ".join(h(10 - i) for i in range(a, b)) + ")"
stroke_query(134, "cxt_eleven_bi", 11, case((f"{h()} > {h(10)} AND {_g('least', 8, 11)} > {_g('least', 3, 6)} AND {_g('least', 3, 6)} > {_g('least', 0, 3)}", "完整上涨"),
                                            (f"{h()} < {h(10)} AND {_g('greatest', 8, 11)} < {_g('greatest', 3, 6)} AND {_g('greatest', 3, 6)} < {_g('greatest', 0, 3)}", "完整下跌"), default="复杂形态"))
stroke_query(135, "cxt_first_buy", 6, case(("dir = -1 AND low < z_low", "一买")))
stroke_query(136, "cxt_first_sell", 6, case(("dir = 1 AND high > z_high", "一卖")))
stroke_query(137, "cxt_second_bs", 5, case((f"{l()} > {l(2)} AND {h()} > {h(2)}", "二买"), (f"{h()} < {h(2)} AND {l()} < {l(2)}", "二卖")))
stroke_query(138, "cxt_third_buy", 4, case(("dir = -1 AND low > z_high", "三买")))
stroke_query(139, "cxt_third_bs", 2, case(("dir = -1 AND low > z_high", "三买"), ("dir = 1 AND high < z_low", "三卖")))
stroke_query(141, "cxt_zs_status", 1, case(("coalesce(z_n_zones, 0) = 0", "无中枢"), ("z_n_zones = 1", "盘整"), ("z_low > z_first_low", "上涨"), ("z_high < z_first_high", "下跌"), default="盘整"), "coalesce(z_n_zones, 0)::BIGINT || '中枢'")
stroke_query(142, "cxt_zs_overlap", 1, "CASE WHEN z_low IS NOT NULL THEN " + case(("least(z_high, coalesce(z_prev_high, z_high)) > greatest(z_low, coalesce(z_prev_low, z_low))", "有重叠"), default="无重叠") + " END")
stroke_query(143, "cxt_zs_gongzhen", 1, "CASE WHEN z_n_recent >= 3 THEN " + case(("z_center_cv < 0.02", "共振"), default="无共振") + " END")
stroke_query(144, "cxt_double_zs", 1, "CASE WHEN z_prev_low IS NOT NULL THEN " + case(("z_low > z_prev_high", "上涨排列"), ("z_high < z_prev_low", "下跌排列"), ("z_low > z_prev_low", "上涨交叉"), ("z_high < z_prev_high", "下跌交叉"), default="重叠盘整") + " END")
_am = "((z_high - z_low) / ((z_high + z_low) / 2))"
stroke_query(145, "cxt_range_oscillation", 1, "CASE WHEN z_low IS NOT NULL THEN " + case((f"{_am} < 0.03", "窄幅震荡"), (f"{_am} < 0.08", "宽幅震荡"), default="剧烈震荡") + " END")
_as = "(SELECT kind FROM dv WHERE dv.code = sf0.code AND dv.end_ts <= sf0.end_ts ORDER BY dv.end_ts DESC, dv.zone DESC LIMIT 1)"
SFD = SF + "," + without(DV, BASE) + ",\nsfd AS (SELECT sf.*, d.kind AS divergence FROM sf ASOF LEFT JOIN dv d ON d.code = sf.code AND sf.end_ts >= d.end_ts)"


def _with_divergence(spark, sf, t, d):
    return X.asof(d, t.divergences, "end_ts", "end_ts", ["kind"], "dv_").withColumnRenamed("dv_kind", "divergence")


_sc = "(dir + CASE WHEN z_prev_low IS NULL THEN 0 WHEN z_low > z_prev_low THEN 1 ELSE -1 END + CASE divergence WHEN 'bottom' THEN 2 WHEN 'top' THEN -2 ELSE 0 END)"
stroke_query(146, "cxt_decision", 3, case((f"{_sc} > 1", "看多"), (f"{_sc} < -1", "看空"), default="中性"), base=SFD, extra=_with_divergence, src="sfd")
stroke_query(153, "cxt_thirteen_bi", 13, case((" AND ".join(f"{_box(13, a, a + 3)[k]} < {_box(13, a + 3, a + 6)[k]}" for a in (2, 5) for k in (0, 1)), "完整上涨"), (" AND ".join(f"{_box(13, a, a + 3)[k]} > {_box(13, a + 3, a + 6)[k]}" for a in (2, 5) for k in (0, 1)), "完整下跌"), default="复杂形态"))
_rr = "((z_high - z_low) / nullif(max(high) OVER (q ROWS 19 PRECEDING) - min(low) OVER (q ROWS 19 PRECEDING), 0))"
stroke_query(154, "cxt_zs_level", 1, f"CASE WHEN {_rr} IS NOT NULL THEN " + case((f"{_rr} > 0.5", "大级别"), (f"{_rr} > 0.2", "中级别"), default="小级别") + " END")
SFM = SF + "," + without(_mt, BASE) + f""",
ar AS (SELECT code, ts, {over('sum(abs(bar))', 10)} AS area10, {over('sum(abs(bar))', 10, 10)} AS parea10 FROM {_ml} {WIN}),
sfm AS (SELECT sf.*, area10, parea10 FROM sf LEFT JOIN ar ON ar.code = sf.code AND ar.ts = sf.end_ts)"""


def _with_area(spark, sf, t, d):
    a = t.macd.select("code", c("ts").alias("end_ts"), I.S.sum(F.abs("bar"), 10).alias("area10"), I.S.sum(F.abs("bar"), 10, skip=10).alias("parea10"))
    return d.join(a, ["code", "end_ts"], "left")


stroke_query(155, "cxt_bi_macd_diverge", 3, "CASE WHEN dir <> lag(dir) OVER q AND parea10 > 0 THEN " + case(("area10 < parea10 * 0.7 AND dir = 1", "顶背驰"), ("area10 < parea10 * 0.7", "底背驰"), default="无背驰") + " END", base=SFM, extra=_with_area, src="sfm")
_v = "(CASE WHEN z_low IS NOT NULL THEN dir ELSE 0 END + hv)"
SFH = both(SF) + """,
wk AS (SELECT code, dir, end_ts + 6 AS t, row_number() OVER (PARTITION BY code ORDER BY seq) AS k FROM bi_w), wz AS (SELECT code, zone, end_ts + 6 AS t FROM zs_w),
sfg AS (SELECT sf.*, wk.dir AS w_dir, wk.k AS w_k FROM sf ASOF LEFT JOIN wk ON wk.code = sf.code AND sf.end_ts >= wk.t),
sfh AS (SELECT sfg.*, CASE WHEN w_k >= 3 AND wz.zone IS NOT NULL THEN w_dir ELSE 0 END AS hv FROM sfg ASOF LEFT JOIN wz ON wz.code = sfg.code AND sfg.end_ts >= wz.t)"""


def _with_week(spark, sf, t, d):
    """The vote of the week: its last stroke's direction once it has three strokes and a zone. A week is known at its end."""
    w = Level(spark, sf, "week")
    known = F.date_add("end_ts", 6).alias("t")
    d = X.asof(d, w.strokes.select("code", "dir", known, F.row_number().over(Window.partitionBy("code").orderBy("seq")).alias("k")), "end_ts", "t", ["dir", "k"], "w_")
    d = X.asof(d, w.zones.select("code", "zone", known), "end_ts", "t", ["zone"], "w_")
    return d.withColumn("higher_vote", F.when((c("w_k") >= 3) & c("w_zone").isNotNull(), c("w_dir")).otherwise(0))


stroke_query(157, "cxt_multi_level_bs", 3, case((f"{_v} >= 2", "共振买点"), (f"{_v} = 1", "偏多"), (f"{_v} = -1", "偏空"), (f"{_v} <= -2", "共振卖点"), default="中性"), base=SFH, src="sfh", extra=_with_week)
_v3 = lambda f: f"(SELECT var_pop(x) FROM (SELECT unnest([{f(4)}, {f(2)}, {f()}]) AS x))"
_vp = lambda f: f"list_var_pop([{f(4)}, {f(2)}, {f()}])"
stroke_query(113, "jcc_shan_chun", 7, case((f"dir = 1 AND {_vp(h)} < 0.2", "三山"), (f"dir = -1 AND {_vp(l)} < 0.2", "三川")))
SEGS = SEG + ",\nsg AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY seq) AS k FROM sk)"
stroke_query(149, "cxt_seg_status", 1, case(("dir = 1", "向上"), default="向下"), case(("n_strokes >= 5", "延伸"), default="转折"), base=SEGS, src="sg", frame=segment_frame)
stroke_query(150, "cxt_seg_direction", 3, case((f"{h()} > {h(1)} AND {h(1)} > {h(2)}", "上涨"), (f"{h()} < {h(1)} AND {h(1)} < {h(2)}", "下跌"), default="震荡"), base=SEGS, src="sg", frame=segment_frame)
_w = f"(least({h()}, {h(1)}, {h(2)}) - greatest({l()}, {l(1)}, {l(2)}))"
stroke_query(156, "cxt_seg_zs", 3, case((f"{_w} > 0", "有中枢"), default="无中枢"), f"CASE WHEN {_w} > 0 THEN '宽度' || format('{{:.2f}}', floor({_w} * 100 + 0.5) / 100) END", base=SEGS, src="sg", frame=segment_frame)

BF = ZH + f""",
bf AS (SELECT b.code, b.ts, b.close, b.i, s.k AS s_k, s.dir AS s_dir, b.i + 1 - s.end_i AS ubi FROM b ASOF LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY code ORDER BY seq) AS k FROM bi) s ON s.code = b.code AND b.ts >= s.end_ts),
bg AS (SELECT bf.*, f.low AS f_low, f.high AS f_high, f.n AS f_n FROM bf ASOF LEFT JOIN (SELECT *, row_number() OVER w AS n FROM fx {WIN}) f ON f.code = bf.code AND bf.ts >= f.ts),
bh AS (SELECT bg.*, z.low AS z_low, z.high AS z_high FROM bg ASOF LEFT JOIN zh z ON z.code = bg.code AND bg.ts >= z.end_ts)"""


def bar_frame(t):
    """Daily bars with the last finished stroke, the last fractal and the last zone of segments."""
    return cxt.bar_frame(I.base_columns(t.bars), t.strokes, t.fractals, t.history)


def bar_query(num, name, v1, v2=None):
    BAR_SQL[name] = (v1, v2)
    cols = f"coalesce({v1}, '其他') AS {name}" + (f", coalesce({v2}, '任意') AS {name}_v2" if v2 else "")

    @query(f"g{num:03d}_{name}", f"code:s ts:d {name}:s" + (f" {name}_v2:s" if v2 else ""), f"{BF}\n---\nSELECT code, ts, {cols} FROM bh")
    def run(spark, sf):
        return cxt.bar_signals(bar_frame(Level(spark, sf)), [name])


def when(cond, x):
    return f"CASE WHEN {cond} THEN {x} END"


_t = case(("s_dir = -1", "向上"), default="向下")
bar_query(123, "cxt_bi_base", when("s_k >= 3", _t), when("s_k >= 3", case(("ubi >= 9", "中继"), default="转折")))
bar_query(125, "cxt_bi_end", when("s_k >= 3", _t), when("s_k >= 3", case(("ubi < 7 AND f_n >= 2", "结束"), default="延续")))
bar_query(126, "cxt_bi_status", when("s_k >= 1", _t), when("s_k >= 1", case(("ubi < 3", "新笔"), ("ubi < 7", "转折"), default="延伸")))
_ok = "s_k >= 2 AND f_n >= 2 AND ubi >= 1"
bar_query(129, "cxt_bi_stop", when(_ok, case(("s_dir = 1", "向上"), default="向下")), when(_ok, case(("CASE WHEN s_dir = 1 THEN close < f_low ELSE close > f_high END", "停顿"), default="延伸")))
bar_query(140, "cxt_zs_breakout", when("z_low IS NOT NULL", case(("close > z_high", "向上突破"), ("close < z_low", "向下突破"), default="中枢内")))
bar_query(148, "cxt_ubi_end", when("s_k >= 1", case(("ubi < 3", "刚形成"), ("ubi < 5", "即将结束"), default="延续中")))


@query("g124_cxt_fx_power", "code:s ts:d cxt_fx_power:s cxt_fx_power_v2:s", ZS + """
---
SELECT f.code, f.ts, CASE WHEN abs(f.close - f.open) / f.close > 0.02 THEN '强' WHEN abs(f.close - f.open) > 0 AND abs(f.close - f.open) / f.close < 0.005 THEN '弱' ELSE '中' END || CASE WHEN kind = 1 THEN '顶' ELSE '底' END AS cxt_fx_power,
  CASE WHEN z.zone IS NOT NULL THEN '有中枢' ELSE '无中枢' END AS cxt_fx_power_v2 FROM fx f ASOF LEFT JOIN zs z ON z.code = f.code AND f.ts >= z.end_ts""")
def fx_power(spark, sf):
    t = Level(spark, sf)
    return cxt.fx_power(t.fractals, t.zones)


def _label_sql(col, table):
    return "CASE " + col + " " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + " ELSE '其他' END"


@query("g147_cxt_bs_signal", "code:s ts:d cxt_bs_signal:s", PTS + f""",
pl AS (SELECT code, ts, max(point) AS point FROM pts GROUP BY 1, 2)
---
SELECT b.code, b.ts, {_label_sql('p.point', cxt.POINT_LABELS)} AS cxt_bs_signal FROM b ASOF LEFT JOIN pl p ON p.code = b.code AND b.ts >= p.ts""")
def bs_signal(spark, sf):
    """The latest point of any class; of several on one day the last by name."""
    t = Level(spark, sf)
    p = t.points.groupBy("code", c("ts").alias("p_ts")).agg(F.max("point").alias("point"))
    d = X.asof(t.bars.select("code", "ts"), p, "ts", "p_ts", ["point"], "p_")
    return d.withColumn("cxt_bs_signal", cxt.labelled(c("p_point"), cxt.POINT_LABELS))


@query("g151_cxt_trend_type_signal", "code:s cxt_trend_type_signal:s cxt_trend_type_signal_v2:s", TT + "," + without(CT, ZS) + f"""
---
SELECT ty.code, {_label_sql('trend', cxt.TREND_LABELS)} AS cxt_trend_type_signal, CASE WHEN trend_strength > 0.7 THEN '强' WHEN trend_strength > 0.4 THEN '中' ELSE '弱' END AS cxt_trend_type_signal_v2 FROM ty JOIN ct USING (code)""")
def trend_signal(spark, sf):
    t = Level(spark, sf)
    return cxt.trend_signal(X.trend_type(t.history).join(t.composite.select("code", "trend_strength"), "code"))


@query("g152_cxt_backchi_signal", "code:s ts:d cxt_backchi_signal:s", DV + f"""
---
SELECT b.code, b.ts, {_label_sql('d.kind', cxt.DIVERGENCE_LABELS)} AS cxt_backchi_signal FROM b ASOF LEFT JOIN dv d ON d.code = b.code AND b.ts >= d.end_ts""")
def backchi_signal(spark, sf):
    d = X.asof(bars(spark, sf).select("code", "ts"), _divergences(spark, sf), "ts", "end_ts", ["kind"], "d_")
    return d.withColumn("cxt_backchi_signal", cxt.labelled(c("d_kind"), cxt.DIVERGENCE_LABELS))


@query("c43_structure_state_signals", "code:s ts:d bi:s breakout:s power:s", BF + """,
vb AS (SELECT code, ts, volume / avg(volume) OVER (PARTITION BY code ORDER BY ts ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS vr FROM b)
---
SELECT bh.code, bh.ts, coalesce(CASE WHEN s_k >= 1 THEN CASE WHEN s_dir = -1 THEN '向上' ELSE '向下' END || CASE WHEN ubi < 3 THEN '新笔' WHEN ubi < 7 THEN '转折' ELSE '延伸' END END, '其他任意') AS bi,
  coalesce(CASE WHEN z_low IS NOT NULL THEN CASE WHEN close > z_high THEN '向上突破' WHEN close < z_low THEN '向下突破' ELSE '中枢内' END END, '其他') AS breakout, CASE WHEN vr >= 2 THEN '放量突破' ELSE '未突破' END AS power FROM bh JOIN vb ON vb.code = bh.code AND vb.ts = bh.ts""")
def stroke_and_zone_states(spark, sf):
    """Stroke, zone and volume states side by side for every bar."""
    t = Level(spark, sf)
    b = I.base_columns(t.bars)
    d = cxt.bar_signals(bar_frame(t), ["cxt_bi_status", "cxt_zs_breakout"])
    v = b.select("code", "ts", F.when(c("volume") / I.S.agg(F.avg, "volume", 20, skip=1, min_periods=1) >= 2, "放量突破").otherwise("未突破").alias("power"))
    return d.join(v, ["code", "ts"]).select("code", "ts", F.concat("cxt_bi_status", "cxt_bi_status_v2").alias("bi"), c("cxt_zs_breakout").alias("breakout"), "power")


# ---- the whole library, strategies and events ------------------------------------------------------
DAYBASE = daily(BASE)


def label_parts(names, base):
    """One CTE a signal over a shared base: (text, [(cte, name, has second value)])."""
    from barloom.plans.registry import ORACLES

    text, found = [], []
    for k, n in enumerate(names):
        sql = ORACLES[next(q for q in ORACLES if re.fullmatch(rf"g\d+_{n}", q))]
        head = "WITH " + BASE.strip()
        if sql.startswith(head):
            rest = sql[len(head):].lstrip(",\n ")
            sql = rest if rest.startswith("SELECT") else "WITH " + rest
        elif base != BASE:
            sql = daily(sql)
        text.append(f"lb{k} AS ({sql})")
        found.append((f"lb{k}", n, f"AS {n}_v2" in sql))
    return ",\n".join(text), found


def label_union(found, where=""):
    one = lambda n, two: f"CASE WHEN {n} <> '其他' AND {n}_v2 <> '任意' THEN {n} || '_' || {n}_v2 ELSE {n} END" if two else n
    return " UNION ALL ".join(f"SELECT code, ts, '{n}' AS name, '{n.split('_')[0]}' AS category, {one(n, two)} AS v1 FROM {cte} WHERE {n} <> '其他'{where}" for cte, n, two in found)


def sqlable(names):
    from barloom.plans.registry import ORACLES

    return [n for n in names if any(re.fullmatch(rf"g\d+_{n}", q) for q in ORACLES)]


STROKE_LABELS = ["cxt_first_buy", "cxt_third_buy", "cxt_bi_macd_diverge"]
RULE_NAMES = sorted({x[0] for r in STRATEGIES for k in ("all", "any", "not") for x in r.get(k, ())})
BAR_NAMES = [n for n in RULE_NAMES if not n.startswith("cxt_")]


def structure_labels(spark, sf, t):
    """For every bar the labels of its last finished stroke, zone and divergence."""
    strokes_ = cxt.stroke_signals(_with_area(spark, sf, t, stroke_frame(t)), STROKE_LABELS).withColumnRenamed("ts", "s_ts")
    d = X.asof(cxt.bar_signals(bar_frame(t), ["cxt_zs_breakout"]), strokes_, "ts", "s_ts", STROKE_LABELS, "")
    d = X.asof(d, t.divergences, "ts", "end_ts", ["kind"], "d_")
    none = [F.coalesce(n, F.lit(NONE)).alias(n) for n in STROKE_LABELS]
    return d.select("code", "ts", "cxt_zs_breakout", *none, cxt.labelled(c("d_kind"), cxt.DIVERGENCE_LABELS).alias("cxt_backchi_signal"))


def rule_signals(spark, sf):
    t = Level(spark, sf)
    bars_ = signal_library(t.bars, "day", BAR_NAMES)
    return cut(bars_.unionByName(G.signal_rows(structure_labels(spark, sf, t), "day")).select("code", "ts", "name", "category", "v1"))


_bar_text, _bar_found = label_parts(BAR_NAMES, DAYBASE)
STRUCTURE_LABELS = SFM + "," + without(DV, _mt) + "," + without(BF, ZH) + """,
zl AS (SELECT code, end_ts, """ + ", ".join(f"coalesce(CASE WHEN k >= {STROKE_SQL[n][0]} THEN {STROKE_SQL[n][1]} END, '其他') AS {n}" for n in STROKE_LABELS) + """ FROM sfm WINDOW q AS (PARTITION BY code ORDER BY seq)),
xl AS (SELECT x.*, coalesce(z.cxt_first_buy, '其他') AS cxt_first_buy, coalesce(z.cxt_third_buy, '其他') AS cxt_third_buy, coalesce(z.cxt_bi_macd_diverge, '其他') AS cxt_bi_macd_diverge
  FROM (SELECT code, ts, coalesce(""" + BAR_SQL["cxt_zs_breakout"][0] + f""", '其他') AS cxt_zs_breakout FROM bh) x ASOF LEFT JOIN zl z ON z.code = x.code AND x.ts >= z.end_ts),
xd AS (SELECT x.*, {_label_sql('d.kind', cxt.DIVERGENCE_LABELS)} AS cxt_backchi_signal FROM xl x ASOF LEFT JOIN dv d ON d.code = x.code AND x.ts >= d.end_ts),
xs_ AS (SELECT * REPLACE (strftime(ts, '%Y-%m-%d') AS ts) FROM xd)"""
RULE_SIG = STRUCTURE_LABELS + ",\n" + _bar_text + ",\nsig AS (" + label_union(_bar_found) + " UNION ALL " + label_union([("xs_", n, False) for n in ("cxt_zs_breakout", *STROKE_LABELS, "cxt_backchi_signal")]) + ")"
FUSED = """,
fc AS (SELECT code, ts, category, avg(score) AS m FROM ss GROUP BY 1, 2, 3),
fw AS (SELECT code, ts, sum(m * w) / sum(w) AS total, CASE WHEN greatest(count_if(m > 10), count_if(m < -10)) >= 3 THEN 0.2 WHEN greatest(count_if(m > 10), count_if(m < -10)) >= 2 THEN 0.1 ELSE 0 END AS bonus
  FROM (SELECT *, CASE category """ + " ".join(f"WHEN '{k}' THEN {v}e0" for k, v in X.CATEGORY_WEIGHTS.items()) + """ END AS w FROM fc) GROUP BY 1, 2),
fu AS (SELECT code, ts, greatest(0, least(100, 50 + total * 0.5 * (1 + bonus))) AS final FROM fw)"""


def rule_sql(rules, src="ss", keys="code, ts"):
    """One aggregate with a flag for each condition, one SELECT for each rule."""
    conds = sorted({tuple(x) for r in rules for k in ("all", "any", "not") for x in r.get(k, ())})
    flag = {x: f"f{i}" for i, x in enumerate(conds)}
    text = "rf_ AS (SELECT " + keys + ", " + ", ".join(f"bool_or(name = '{n}' AND contains(v1, '{t}')) AS {flag[n, t]}" for n, t in conds) + f" FROM {src} GROUP BY ALL)"
    body = []
    for r in rules:
        terms = [flag[tuple(x)] for x in r.get("all", ())] + [f"NOT {flag[tuple(x)]}" for x in r.get("not", ())]
        if r.get("any"):
            terms.append("(" + " OR ".join(flag[tuple(x)] for x in r["any"]) + ")")
        if "min_score" in r:
            terms.append(f"round(final, 9) >= {r['min_score']}")
        for k, v in r.get("min_category", {}).items():
            terms.append(f"round(coalesce((SELECT m FROM fc WHERE fc.code = z.code AND fc.ts = z.ts AND fc.category = '{k}'), 0), 9) >= {v}")
        body.append((r["name"], " AND ".join(terms)))
    return text, body


_rt, _rb = rule_sql(STRATEGIES)


@query("c37_signal_strategies", "code:s ts:s final:f4 strategy:s", RULE_SIG + ",\n" + score_sql(RULE_ROWS) + FUSED + ",\n" + _rt + "\n---\n" + " UNION ALL ".join(f"SELECT z.code, z.ts, final, '{n}' AS strategy FROM rf_ z JOIN fu ON fu.code = z.code AND fu.ts = z.ts WHERE {w}" for n, w in _rb))
def strategies(spark, sf):
    """The eight named strategies over the labels of every daily bar."""
    s = cut(X.score_signals(rule_signals(spark, sf), _score_table(spark, RULE_ROWS)).withColumn("ts", F.date_format("ts", "yyyy-MM-dd")))
    finals = X.fuse_categories(s).withColumn("final", F.round("final", 9))
    return X.rule_matches(s, STRATEGIES, finals, s.groupBy("code", "ts", "category").agg(F.round(F.avg("score"), 9).alias("m")))


@query("c37_labels_of_strategies", "code:s ts:s name:s v1:s score:f2", RULE_SIG + ",\n" + score_sql(RULE_ROWS) + "\n---\nSELECT * FROM ss QUALIFY ts = max(ts) OVER (PARTITION BY code)")
def strategy_labels(spark, sf):
    """What the strategies read at each code's last day with a label."""
    s = X.score_signals(rule_signals(spark, sf), _score_table(spark, RULE_ROWS)).withColumn("ts", F.date_format("ts", "yyyy-MM-dd"))
    return s.withColumn("_l", F.max("ts").over(Window.partitionBy("code"))).where(c("ts") == c("_l"))


# ---- state signals and events --------------------------------------------------------------------
def state_rows(spark, sf):
    t = Level(spark, sf)
    b = I.base_columns(t.bars)
    vr = c("volume") / I.S.agg(F.avg, "volume", 20)
    last = b.select("code", "ts", "close", "i", vr.alias("volume_ratio"), I.S.lead("ts").alias("_n")).where("_n is null").drop("_n")
    fx_ = cxt.fx_power(t.fractals, t.zones).select("code", "ts", F.substring("cxt_fx_power", 1, 1).alias("word"), (c("cxt_fx_power_v2") == "有中枢").alias("zone"))
    cross = G.signal_frame(t.bars, ["tas_macd_cross"])
    d = asof_many(last, "ts", {"f_": (fx_, "ts", ["word", "zone"]), "s_": (t.strokes, "end_ts", ["dir", "end_i"]), "z_": (t.zones, "end_ts", ["low", "high"]), "d_": (t.divergences, "end_ts", ["kind"]), "x_": (cross, "ts", ["tas_macd_cross"])})
    d = d.join(t.composite.select("code", "direction", "trend_strength", "risk"), "code", "left")
    d = d.select("code", "close", "volume_ratio", c("x_tas_macd_cross").alias("cross"), (c("i") + 1 - c("s_end_i")).alias("ubi"), c("s_dir").alias("stroke_dir"), c("f_word").alias("fractal"), F.coalesce("f_zone", F.lit(False)).alias("fractal_zone"),
                 c("z_low").alias("zone_low"), c("z_high").alias("zone_high"), c("d_kind").alias("divergence"), "direction", "trend_strength", "risk")
    return state_signals(d, t.points)


_ct, _cf = label_parts(["tas_macd_cross"], DAYBASE)
_two = lambda x: f"format('{{:.2f}}', floor({x} * 100 + 0.5) / 100)"
_pt = lambda k: "CASE point " + " ".join(f"WHEN '{p}' THEN '{v[k]}'" for p, v in POINT_NAMES.items()) + " END"
_dv3 = "CASE dk WHEN 'top' THEN '顶背离' WHEN 'bottom' THEN '底背离' ELSE '无背离' END"
_st3 = "CASE WHEN ubi < 3 THEN '新笔' WHEN ubi < 7 THEN '转折' ELSE '延伸' END"
_w3 = lambda x, n: f"CASE WHEN {x} > 0.7 THEN '{n[0]}' WHEN {x} > 0.4 THEN '{n[1]}' ELSE '{n[2]}' END"
STATES = RISK + "," + without(PTS, ZS) + "," + without(daily(DV), DAYBASE) + ",\n" + _ct + f""",
la AS (SELECT code, ts, close, i, CASE WHEN count(*) OVER v >= 20 THEN volume / avg(volume) OVER v END AS vr FROM b WINDOW v AS (PARTITION BY code ORDER BY ts ROWS 19 PRECEDING) QUALIFY row_number() OVER (PARTITION BY code ORDER BY ts DESC) = 1),
lf AS (SELECT f.code, CASE WHEN abs(f.close - f.open) / f.close > 0.02 THEN '强' WHEN abs(f.close - f.open) > 0 AND abs(f.close - f.open) / f.close < 0.005 THEN '弱' ELSE '中' END AS word, EXISTS (SELECT 1 FROM zs z WHERE z.code = f.code AND z.end_ts <= f.ts) AS has
  FROM fx f QUALIFY row_number() OVER (PARTITION BY f.code ORDER BY f.ts DESC) = 1),
lk AS (SELECT code, dir AS sdir, end_i FROM bi QUALIFY row_number() OVER (PARTITION BY code ORDER BY seq DESC) = 1), lzo AS (SELECT code, low AS zl, high AS zh FROM zs QUALIFY row_number() OVER (PARTITION BY code ORDER BY zone DESC) = 1),
ldv AS (SELECT code, kind AS dk FROM dv QUALIFY row_number() OVER (PARTITION BY code ORDER BY end_ts DESC) = 1), lcr AS (SELECT code, tas_macd_cross AS cr FROM lb0 QUALIFY row_number() OVER (PARTITION BY code ORDER BY ts DESC) = 1),
lall AS (SELECT la.*, word, has, sdir, la.i + 1 - end_i AS ubi, zl, zh, dk, cr, direction, trend_strength, risk FROM la LEFT JOIN lf ON lf.code = la.code LEFT JOIN lk ON lk.code = la.code LEFT JOIN lzo ON lzo.code = la.code LEFT JOIN ldv ON ldv.code = la.code LEFT JOIN lcr ON lcr.code = la.code LEFT JOIN rt ON rt.code = la.code),
sta AS (SELECT code, '分型强弱' AS k2, 'D1F' AS k3, word AS v1, CASE WHEN has THEN '有中枢' ELSE '无中枢' END AS v2, '任意' AS v3, CASE word WHEN '强' THEN 1.0 WHEN '中' THEN 0.7 ELSE 0.4 END AS score FROM lall WHERE word IS NOT NULL
  UNION ALL SELECT code, '笔状态', 'D0BL', CASE WHEN sdir = -1 THEN '向上' ELSE '向下' END, {_st3}, '任意', CASE WHEN {_st3} = '转折' THEN 0.8 ELSE 0.5 END FROM lall WHERE sdir IS NOT NULL
  UNION ALL SELECT code, 'MACD', '信号', cr, {_dv3}, '任意', CASE WHEN dk IS NULL THEN 0.6 ELSE 0.9 END FROM lall
  UNION ALL SELECT code, '趋势方向', '综合', direction, {_w3("trend_strength", "强中弱")}, '任意', trend_strength FROM lall WHERE direction IS NOT NULL
  UNION ALL SELECT code, '风险等级', '评估', {_w3("risk", "高中低")}, CAST(floor(risk * 100 + 1e-9) AS BIGINT) || '%', '任意', 1 - risk FROM lall WHERE risk IS NOT NULL
  UNION ALL SELECT code, '笔结束', 'BI_END', CASE WHEN word IS NULL THEN '延续' ELSE '结束' END, CASE WHEN dk IS NULL THEN 'MACD未确认' ELSE 'MACD确认' END, CASE WHEN sdir = -1 THEN '向下' ELSE '向上' END, CASE WHEN word IS NULL THEN 0.3 WHEN dk IS NULL THEN 0.6 ELSE 0.9 END FROM lall WHERE sdir IS NOT NULL
  UNION ALL SELECT code, '中枢突破', 'ZS_BRK', CASE WHEN close > zh THEN '向上突破' WHEN close < zl THEN '向下突破' ELSE '在中枢内' END, CASE WHEN close > zh THEN '突破' || {_two("zh")} WHEN close < zl THEN '跌破' || {_two("zl")} ELSE '区间' || {_two("zl")} || '-' || {_two("zh")} END, '任意', CASE WHEN close > zh OR close < zl THEN 0.8 ELSE 0.3 END FROM lall WHERE zl IS NOT NULL
  UNION ALL SELECT code, 'MACD背离', 'MACD_DIV', {_dv3}, CASE WHEN dk = 'top' THEN '价格新高MACD未新高' ELSE '价格新低MACD未新低' END, '任意', 0.85 FROM lall WHERE dk IS NOT NULL
  UNION ALL SELECT code, '量能信号', 'VOL_BRK', CASE WHEN vr > 3 THEN '巨量' WHEN vr > 2 THEN '大量' WHEN vr > 1.5 THEN '放量' ELSE '缩量' END, '量比' || format('{{:.1f}}', floor(vr * 10 + 0.5) / 10), CASE direction WHEN 'up' THEN '向上' WHEN 'down' THEN '向下' ELSE '横盘' END, CASE WHEN vr > 3 THEN 0.9 WHEN vr > 2 THEN 0.7 WHEN vr > 1.5 THEN 0.5 ELSE 0.2 END FROM lall WHERE vr IS NOT NULL
  UNION ALL SELECT code, '买卖点', {_pt(1)}, {_pt(0)}, '可靠度' || CAST(floor(reliability * 100 + 1e-9) AS BIGINT) || '%', '任意', reliability FROM (SELECT * FROM pts QUALIFY row_number() OVER (PARTITION BY code ORDER BY ts DESC, point DESC) <= 3))"""


@query("c43_state_signals", "code:s k2:s k3:s v1:s v2:s v3:s score:f4", STATES + "\n---\nSELECT * FROM sta")
def states(spark, sf):
    """The ten state signals of each code as of its last day."""
    return state_rows(spark, sf)


EV = STATES + ",\nev AS (SELECT code, k2 AS name, '|' || concat_ws('|', k3, v1, v2) || '|' AS v1 FROM sta),\n"
_et, _eb = rule_sql([{k: v for k, v in r.items() if k != "min_score"} for r in EVENTS], "ev", "code")


@query("c38_event_rules", "code:s strategy:s", EV + _et + "\n---\n" + " UNION ALL ".join(f"SELECT z.code, '{n}' AS strategy FROM rf_ z WHERE {w}" for n, w in _eb))
def events(spark, sf):
    """The default events over the state signals of each code."""
    return X.rule_matches(event_labels(cut(state_rows(spark, sf))), EVENTS, keys=["code"])


# ---- the library on two levels -------------------------------------------------------------------
ALL_BARS = sorted(n for n in sqlable(G.SIGNALS))
ALL_STROKES = [n for n in STROKE_SQL if not n.startswith("cxt_seg_")]


def stroke_library(spark, sf, t, level):
    """The labels of each code's last stroke."""
    d = _with_area(spark, sf, t, _with_divergence(spark, sf, t, stroke_frame(t)))
    d = _with_week(spark, sf, t, d) if level == "day" else d.withColumn("higher_vote", F.lit(0))
    frame = cxt.stroke_signals(d, ALL_STROKES).drop("seq")
    w = Window.partitionBy("code")
    return cut(G.signal_rows(frame.withColumn("_l", F.max("ts").over(w)).where(c("ts") == c("_l")).drop("_l"), level))


def _library_sql(level):
    base = DAYBASE if level == "day" else BASE
    text, found = label_parts(ALL_BARS, base)
    # the closed form of a mean of span 3 passes the range of doubles after a thousand days: folded over a window instead
    text = text.replace(ema("close", span(3)), "list_reduce(list(close) OVER (w ROWS 99 PRECEDING), lambda m, v: m * 0.5 + v * 0.5)")
    bars_sql = f"WITH {base.strip()},\n{text}\nSELECT * FROM ({label_union(found)}) u WHERE ts = (SELECT strftime(max(ts), '%Y-%m-%d') FROM b WHERE b.code = u.code)"
    both_ = SFM + "," + without(DV, _mt) + ",\nsfd AS (" + SFD.split(",\nsfd AS (")[1]
    if level == "day":
        head = both_ + "," + without(SFH, SF)
        votes = "hv"
        join = "JOIN (SELECT code, seq, hv FROM sfh) h ON h.code = m.code AND h.seq = m.seq"
    else:
        head = both_.replace(D.BRAND_DAY.replace("dbars", "bars"), D.BRAND_WEEK)
        votes, join = "0 AS hv", ""
    cols = []
    for n in ALL_STROKES:
        need, v1, v2 = STROKE_SQL[n]
        cols.append(f"coalesce(CASE WHEN k >= {need} THEN {v1} END, '其他') AS {n}")
        if v2:
            cols.append(f"coalesce(CASE WHEN k >= {need} THEN {v2} END, '任意') AS {n}_v2")
    rows = label_union([("sn", n, bool(STROKE_SQL[n][2])) for n in ALL_STROKES])
    strokes_sql = f"""WITH {head},
sfa AS (SELECT m.*, d.divergence, {votes} FROM sfm m JOIN (SELECT code, seq, divergence FROM sfd) d ON d.code = m.code AND d.seq = m.seq {join}),
sn0 AS (SELECT code, seq, strftime(end_ts, '%Y-%m-%d') AS ts, {", ".join(cols)} FROM sfa WINDOW q AS (PARTITION BY code ORDER BY seq)),
sn AS (SELECT * FROM sn0 QUALIFY ts = max(ts) OVER (PARTITION BY code))
SELECT * FROM ({rows})"""
    return f"l1_{level} AS ({bars_sql}), l2_{level} AS ({strokes_sql})"


@query("c44_signal_library", "code:s ts:s level:s category:s name:s v1:s", ", ".join(_library_sql(k) for k in ("day", "week")) + "\n---\n" + " UNION ALL ".join(f"SELECT *, '{k}' AS level FROM l{i}_{k}" for k in ("day", "week") for i in (1, 2)))
def library(spark, sf):
    """Every bar and stroke signal on daily and weekly bars, as of each code's last bar and last stroke."""
    parts = []
    for level in ("day", "week"):
        t = Level(spark, sf, level)
        parts += [signal_library(t.bars, level, ALL_BARS, last_only=True), stroke_library(spark, sf, t, level)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3]).withColumn("ts", F.date_format("ts", "yyyy-MM-dd"))
