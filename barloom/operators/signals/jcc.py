"""Candlestick shapes over the last one to nine bars."""

from functools import reduce

from pyspark.sql import functions as F

from barloom.operators.signals.base import S, c, pick, signal


class Bar:
    """Columns of the bar k steps back."""

    def __init__(self, k: int = 0):
        get = (lambda x: c(x)) if k == 0 else (lambda x: S.lag(x, k))
        self.o, self.h, self.l, self.c = get("open"), get("high"), get("low"), get("close")

    @property
    def yang(self):
        return self.c > self.o

    @property
    def yin(self):
        return self.c < self.o

    @property
    def body(self):
        return F.abs(self.c - self.o)

    @property
    def upper(self):
        return self.h - F.greatest(self.c, self.o)

    @property
    def lower(self):
        return F.least(self.c, self.o) - self.l

    @property
    def top(self):
        return F.greatest(self.o, self.c)

    @property
    def bottom(self):
        return F.least(self.o, self.c)

    def doji(self, th=0.001):
        span = self.h - self.l
        return (span == 0) | (F.try_divide(self.body, span) < th)


def every(conds):
    return reduce(lambda a, b: a & b, conds)


def last3():
    return Bar(2), Bar(1), Bar(0)


@signal("jcc_san_xing_xian", 4)
def san_xing_xian():
    a, b, d = last3()
    stars = every(x.doji() for x in (a, b, d))
    return pick((stars & (d.c > a.c), "三星看多"), (stars, "三星看空"))


@signal("jcc_ten_mo", 2)
def ten_mo():
    x = Bar()
    return pick((x.doji() & (x.lower > x.upper * 2), "蜻蜓十字"), (x.doji() & (x.upper > x.lower * 2), "墓碑十字"), (x.doji(), "长腿十字"))


@signal("jcc_wu_yun_gai_ding", 3)
def wu_yun_gai_ding():
    p, x = Bar(1), Bar()
    return pick((p.yang & x.yin & (x.o > p.h) & (x.c < (p.o + p.c) / 2), "乌云盖顶"))


@signal("jcc_ci_tou", 3)
def ci_tou():
    p, x = Bar(1), Bar()
    return pick((p.yin & x.yang & (x.o < p.l) & (x.c > (p.o + p.c) / 2), "刺透"))


def _san_fa():
    x, steps = Bar(), []
    for n in (5, 6, 7, 8):
        a, mids, have = Bar(n - 1), [Bar(k) for k in range(1, n - 1)], c("i") >= n
        rise = (have & a.yang & x.yang & (x.c > a.h) & every(m.yin & (m.h < a.h) & (m.l > a.o) for m in mids))
        fall = (have & a.yin & x.yin & (x.c < a.l) & every(m.yang & (m.l > a.l) & (m.h < a.o) for m in mids))
        steps += [(rise, "上升三法", f"{n}K"), (fall, "下降三法", f"{n}K")]
    return steps


@signal("jcc_san_fa", 6)
def san_fa():
    s = _san_fa()
    return pick(*[(x, a) for x, a, _ in s]), pick(*[(x, b) for x, _, b in s], default="任意")


@signal("jcc_xing_xian", 4)
def xing_xian():
    a, b, d = last3()
    big = (a.body > b.body * 2) & (d.body > b.body * 2)
    return pick((a.yin & d.yang & big & (b.c < a.c), "晨星"), (a.yang & d.yin & big & (b.c > a.c), "暮星"))


def _same(x, y):
    return F.abs(x - y) / F.greatest(x, F.lit(1.0)) < 0.002


@signal("jcc_fen_shou_xian", 3)
def fen_shou_xian():
    p, x = Bar(1), Bar()
    same = _same(p.o, x.o)
    return pick((same & p.yang & x.yin, "看空分手"), (same & p.yin & x.yang, "看多分手"))


@signal("jcc_zhu_huo_xian", 3)
def zhu_huo_xian():
    p, x = Bar(1), Bar()
    return pick((p.yin & x.yang & (x.o <= p.c) & (x.c >= p.o), "看多抓获"), (p.yang & x.yin & (x.o >= p.c) & (x.c <= p.o), "看空抓获"))


@signal("jcc_yun_xian", 3)
def yun_xian():
    p, x = Bar(1), Bar()
    inside = (p.top > x.top) & (p.bottom < x.bottom)
    return pick((inside & p.yang & x.yin, "看空孕线"), (inside & p.yin & x.yang, "看多孕线"), (inside, "十字孕线"))


@signal("jcc_ping_tou", 3)
def ping_tou():
    p, x = Bar(1), Bar()
    th = F.greatest(p.h, F.lit(1.0)) * 0.002
    return pick((F.abs(p.h - x.h) < th, "平头顶"), (F.abs(p.l - x.l) < th, "平头底"))


@signal("jcc_two_crow", 4)
def two_crow():
    a, b, d = last3()
    return pick((a.yang & b.yin & d.yin & (b.o > a.c) & (d.o > b.o) & (d.c < b.c), "两只乌鸦"))


@signal("jcc_three_crow", 4)
def three_crow():
    return pick((every(x.yin for x in last3()), "三只乌鸦"))


@signal("jcc_szx", 3)
def szx():
    p, x = Bar(1), Bar()
    return pick((x.doji() & p.yang, "阳后十字"), (x.doji() & p.yin, "阴后十字"), (x.doji(), "十字"))


@signal("jcc_san_szx", 4)
def san_szx():
    return pick((every(x.doji() for x in last3()), "三星十字"))


@signal("jcc_fan_ji_xian", 3)
def fan_ji_xian():
    p, x = Bar(1), Bar()
    same = _same(p.c, x.c)
    return pick((same & p.yang & x.yin, "看空反击"), (same & p.yin & x.yang, "看多反击"))


@signal("jcc_gap_yin_yang", 4)
def gap_yin_yang():
    """The variance of two bodies is a quarter of their squared difference."""
    a, b, d = last3()
    even = (d.body - b.body) * (d.body - b.body) / 4 < 0.2
    return pick(((F.least(d.l, b.l) > a.h) & b.yang & d.yin & even, "向上跳空"),
                ((F.greatest(d.h, b.h) < a.l) & b.yin & d.yang & even, "向下跳空"))


def _ta_xing():
    steps = []
    for n in (5, 6, 7, 8, 9):
        a, x, have = Bar(n - 1), Bar(), c("i") >= n
        inner = F.greatest(*[Bar(k).body for k in range(1, n - 1)])
        ends = F.least(a.body, x.body) >= inner
        flat = lambda col: S.agg(F.var_pop, col, n - 2, skip=1) < 0.5
        steps += [(have & ends & a.yang & x.yin & flat("high"), "顶部", f"{n}K"),
                  (have & ends & a.yin & x.yang & flat("low"), "底部", f"{n}K")]
    return steps


@signal("jcc_ta_xing", 6)
def ta_xing():
    s = _ta_xing()
    return pick(*[(x, a) for x, a, _ in s]), pick(*[(x, b) for x, _, b in s], default="任意")


@signal("jcc_zhuo_yao_dai_xian", 2)
def zhuo_yao_dai_xian():
    x = Bar()
    span = x.h - x.l
    share = lambda v: F.try_divide(v, span)
    strong = share(x.body) > 0.6
    return pick(((share(F.abs(x.o - x.l)) < 0.05) & x.yang & strong, "看多捉腰带"),
                ((share(F.abs(x.o - x.h)) < 0.05) & x.yin & strong, "看空捉腰带"))


@signal("jcc_hammer", 6)
def hammer():
    x = Bar()
    rising = S.lag("close", 4) > c("pc")
    low = (x.h > x.l) & (x.lower > x.body * 2) & (x.upper < x.body * 0.5)
    up = (x.h > x.l) & (x.upper > x.body * 2) & (x.lower < x.body * 0.5)
    return pick((low & rising, "上吊线"), (low, "锤子线"), (up & rising, "射击之星"), (up, "倒锤子"))


@signal("jcc_engulfing", 3)
def engulfing():
    p, x = Bar(1), Bar()
    big = x.body > p.body
    return pick((p.yin & x.yang & (x.o <= p.c) & (x.c >= p.o) & big, "看涨吞没"), (p.yang & x.yin & (x.o >= p.c) & (x.c <= p.o) & big, "看跌吞没"))


@signal("jcc_harami_cross", 3)
def harami_cross():
    p, x = Bar(1), Bar()
    inside = x.doji() & (p.top > x.top) & (p.bottom < x.bottom)
    return pick((inside & p.yang, "看空十字孕线"), (inside & p.yin, "看多十字孕线"), (inside, "十字孕线"))


@signal("jcc_three_white", 4)
def three_white():
    a, b, d = last3()
    ok = every(x.yang for x in (a, b, d)) & (d.c > b.c) & (b.c > a.c) & (d.o > b.o) & (b.o > a.o)
    held = reduce(lambda p, q: p | q, (x.upper > x.body * 0.3 for x in (a, b, d)))
    return pick((ok & held, "受阻三白兵"), (ok, "三白兵"))


@signal("jcc_three_black", 4)
def three_black():
    a, b, d = last3()
    ok = every(x.yin for x in (a, b, d)) & (d.c < b.c) & (b.c < a.c) & (d.o < b.o) & (b.o < a.o)
    held = reduce(lambda p, q: p | q, (x.lower > x.body * 0.3 for x in (a, b, d)))
    return pick((ok & held, "受撑三黑鸦"), (ok, "三黑鸦"))


@signal("jcc_kicking", 3)
def kicking():
    p, x = Bar(1), Bar()
    return pick((x.l > p.h, "看多跳空"), (x.h < p.l, "看空跳空"))
