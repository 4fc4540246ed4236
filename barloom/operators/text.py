"""Lexicon sentiment and report text. Texts are scored whole; nothing is cut."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.functions.windows import clamp, ladder, ratio
from barloom.session import cut as stored

c = F.col


def _count(text: Column, word: str) -> Column:
    """Non-overlapping occurrences of a literal word. Byte lengths are stored with the text, so only the
    replacement itself reads it."""
    return (F.octet_length(text) - F.octet_length(F.replace(text, F.lit(word), F.lit("")))) / len(word.encode())


def _automaton(words: Sequence[str]) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for i, w in enumerate(words):
        found.add_word(w, (i, len(w)))
    if words:
        found.make_automaton()
    return found


def word_hits(automaton: ahocorasick.Automaton, n: int, text: str) -> tuple[list[int], list[int]]:
    """Of each of the ``n`` words: non-overlapping occurrences from the left, and the first place (-1 if none). One pass."""
    counts, first, free = [0] * n, [-1] * n, [0] * n
    for end, (i, size) in automaton.iter(text):
        start = end - size + 1
        if start >= free[i]:
            counts[i] += 1
            free[i] = end + 1
            if first[i] < 0:
                first[i] = start
    return counts, first


def lexicon_score(docs: DataFrame, words: Mapping[str, float], negations: Sequence[str] = (),
                  intensifiers: Mapping[str, float] | None = None, text: str = "text") -> DataFrame:
    """Replace the text by (hits, score clamped to +-1). Weights are signed. A null text has null hits and score 0.

    A word adds weight x count. If the two characters before its first place hold a negation the sign
    turns and the size drops to 0.7; otherwise the first intensifier found up to ten characters after
    that place multiplies it. One automaton finds all words and intensifiers in one pass over a text, so the
    time does not grow with the lexicon; what it counts needs order within a text, hence Arrow batches.
    """
    keep = [x for x in docs.columns if x != text]
    strong = dict(intensifiers or {})
    names = list(dict.fromkeys([*words, *strong]))
    at_strong = [(names.index(x), len(x), k) for x, k in strong.items()]
    weights = list(words.values())
    d = docs.select(*keep, c(text).cast("string").alias(text))
    schema = T.StructType([*[d.schema[x] for x in keep], T.StructField("hits", T.DoubleType()), T.StructField("score", T.DoubleType())])

    def score(value: str, find) -> tuple[float, float]:
        counts, first = word_hits(find, len(names), value)
        total, hits = 0.0, 0.0
        for i, weight in enumerate(weights):
            n, at = counts[i], first[i]
            if n:
                before = value[max(at - 2, 0) : at]
                if any(x in before for x in negations):
                    effect = -0.7
                else:
                    effect = next((k for j, size, k in at_strong if 0 <= first[j] <= at + 10 - size), 1.0)
                total += n * weight * effect
                hits += n
        return hits, max(-1.0, min(1.0, total / hits)) if hits else 0.0

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = _automaton(names)
        for rb in it:
            # one text at a time becomes a Python string, not the batch
            texts = (v.as_py() for v in rb.column(len(keep)))
            found = [(None, 0.0) if v is None else score(v, find) if names else (0.0, 0.0) for v in texts]
            arrays = [*(rb.column(k) for k in range(len(keep))), pa.array([x for x, _ in found], pa.float64()), pa.array([y for _, y in found], pa.float64())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*keep, "hits", "score"])

    return d.mapInArrow(run, schema)


def sentiment_label(score: Column) -> Column:
    return ladder((score > 0.3, "strongly_bullish"), (score > 0.1, "bullish"), (score > -0.1, "neutral"), (score > -0.3, "bearish"), default="strongly_bearish")


def buzz_metrics(posts: DataFrame, by: Sequence[str]) -> DataFrame:
    """Counts, sources, mean and population deviation, shares and a volume level."""
    s = c("score")
    g = posts.groupBy(*by).agg(
        F.count(F.lit(1)).alias("posts"), F.countDistinct("source").alias("sources"), F.avg(s).alias("mean"), F.stddev_pop(s).alias("sd"),
        F.avg((s > 0.1).cast("double")).alias("bullish_share"), F.avg((s < -0.1).cast("double")).alias("bearish_share"))
    return g.withColumn("level", ladder((c("posts") >= 50, "very_high"), (c("posts") >= 30, "high"), (c("posts") >= 15, "medium"), (c("posts") >= 5, "lowish"), default="low"))


def hot_topics(posts: DataFrame, words: Sequence[str], n: int = 10) -> DataFrame:
    """Mentions of each word over all texts: one pass with a sum per word, then unpivoted."""
    one = posts.agg(*[F.sum(_count(c("text"), w)).alias(w) for w in words])
    return one.unpivot([], list(words), "topic", "mentions").where(c("mentions") > 0).orderBy(F.desc("mentions"), "topic").limit(n)


def fear_greed(buzz: DataFrame) -> DataFrame:
    """0.6 sentiment + 0.4 bullish share on 0..100, pulled to 50 when posts are few."""
    raw = (c("mean") + 1) * 50 * 0.6 + c("bullish_share") * 100 * 0.4
    damp = F.least(c("posts") / 30.0, F.lit(1.0)) * 0.7 + 0.3
    d = buzz.withColumn("index", clamp((raw - 50) * damp + 50, 0.0, 100.0))
    return d.withColumn("mood", ladder((c("index") >= 80, "extreme_greed"), (c("index") >= 60, "greed"), (c("index") >= 40, "neutral"), (c("index") >= 20, "fear"), default="extreme_fear"))


def sentiment_reversal(posts: DataFrame, by: Sequence[str], order: Sequence[str], cut: float = 0.1) -> DataFrame:
    """Mean of the later half less mean of the earlier half, by time order.

    The halves come from per-day counts (map-side combined), so a key with a third of all posts is
    never sorted in one task; only the day that holds the middle is numbered row by row. Posts are read several
    times, so the few columns needed are stored first and every text is scored once.
    """
    posts = stored(posts.select(*by, *order, "score"))
    day = posts.groupBy(*by, order[0]).agg(F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy(*by).orderBy(order[0]).rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum("_c").over(Window.partitionBy(*by))
    day = day.select(*by, order[0], (F.sum("_c").over(w) - c("_c")).alias("_before"), c("_c"), F.floor(total / 2).alias("_half"))
    d = posts.join(day, [*by, order[0]])
    inside = Window.partitionBy(*by, order[0]).orderBy(*order[1:])
    split = (c("_before") < c("_half")) & (c("_before") + c("_c") > c("_half"))
    mixed = d.where(split).withColumn("_early", F.row_number().over(inside) + c("_before") <= c("_half"))
    whole = d.where(~split).withColumn("_early", c("_before") < c("_half"))
    g = mixed.unionByName(whole).groupBy(*by).agg(
        F.avg(F.when(c("_early"), c("score"))).alias("early"), F.avg(F.when(~c("_early"), c("score"))).alias("late"), F.count(F.lit(1)).alias("posts"))
    g = g.withColumn("shift", c("late") - c("early"))
    return g.withColumn("reversal", ladder((c("shift") > cut, "improving"), (c("shift") < -cut, "worsening"), default="stable"))


def price_divergence(days: DataFrame) -> DataFrame:
    """(ret5, mean sentiment): price +-2 % against mood +-0.1."""
    up, dn, warm, cold = c("ret5") > 0.02, c("ret5") < -0.02, c("mean") > 0.1, c("mean") < -0.1
    return days.withColumn("divergence", ladder((up & cold, "bearish_divergence"), (dn & warm, "bullish_divergence"),
                                                ((up & warm) | (dn & cold), "trend_confirmation"), default="neutral"))


def overall_score(d: DataFrame) -> DataFrame:
    """40 sentiment + 20 distance of fear-greed from 50 + 20 volume + 20 agreement; mirrored for a bearish mean."""
    s = ((c("mean") + 1) * 20 + F.abs(c("index") - 50) * 0.4 + F.least(c("posts") * 2.0, F.lit(100.0)) * 0.2
         + F.greatest("bullish_share", "bearish_share") * 20)
    return d.withColumn("overall", clamp(F.when(c("mean") < -0.1, 100 - s).otherwise(s), 0.0, 100.0))


# ---- reports -------------------------------------------------------------------------------------

def parse_date(col: str) -> Column:
    """Date with or without a time of day; null when unreadable."""
    t = c(col)
    return F.coalesce(F.try_to_timestamp(t, F.lit("yyyy-MM-dd")), F.try_to_timestamp(t, F.lit("yyyy-MM-dd HH:mm:ss"))).cast("date")


def date_filter(docs: DataFrame, first: Column | None = None, last: Column | None = None, col: str = "publish_date") -> DataFrame:
    """Range on a text date; a missing or unreadable date is kept."""
    d, ok = parse_date(col), F.lit(True)
    if first is not None:
        ok = ok & (d >= first)
    if last is not None:
        ok = ok & (d <= last)
    return docs.where(d.isNull() | ok)


def relevance(docs: DataFrame, keywords: Sequence[str]) -> DataFrame:
    """1 for a title of 10..50 characters, 2 per keyword in title or body, 1 for a digit in the title."""
    t, b = F.lower("title"), F.lower("body")
    s = F.when(F.length(t).between(10, 50), 1).otherwise(0) + F.when(t.rlike("[0-9]"), 1).otherwise(0)
    for k in keywords:
        s = s + F.when(t.contains(k) | b.contains(k), 2).otherwise(0)
    return docs.withColumn("relevance", s)


# Rating words in the order they are tried, target-price forms, words that mark an analysis.
RATING_WORDS = ["买入", "增持", "持有", "减持", "卖出", "推荐", "谨慎推荐"]
TARGET_PATTERNS = [r"目标价\s*[:：]?\s*(\d+(?:\.\d+)?)\s*元", r"(\d+(?:\.\d+)?)\s*元\s*目标价", r"目标价\s*(\d+(?:\.\d+)?)"]
ANALYSIS_WORDS = ["分析", "逻辑", "原因", "因素"]


def report_facts(docs: DataFrame, ratings: Sequence[str] = tuple(RATING_WORDS), targets: Sequence[str] = tuple(TARGET_PATTERNS),
                 analysis_words: Sequence[str] = tuple(ANALYSIS_WORDS), industries: Sequence[str] = ()) -> DataFrame:
    """First rating word, first matching target price, first industry word, analysis flag."""
    text = F.concat_ws(" ", "title", "body")
    first = lambda words: ladder(*[(text.contains(w), w) for w in words]) if words else F.lit(None).cast("string")
    price = F.coalesce(*[F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in targets]).cast("double")
    return docs.select("*", first(ratings).alias("rating"), price.alias("target_price"), first(industries).alias("industry"),
                       c("body").rlike("|".join(analysis_words)).alias("has_analysis"))


def corpus_statistics(facts: DataFrame, by: Sequence[str]) -> DataFrame:
    return facts.groupBy(*by).agg(F.count(F.lit(1)).alias("docs"), F.avg(F.length("body")).alias("mean_length"), F.count("rating").alias("rated"),
                                  F.avg(c("target_price").isNotNull().cast("double")).alias("target_share"), F.sum(c("has_analysis").cast("int")).alias("analyses"))


def news_window(items: DataFrame, last: Column, days: int, n: int) -> DataFrame:
    """Items of the last days, newest first, at most n (the report's length)."""
    return items.where((c("ts") > F.date_sub(last, days)) & (c("ts") < F.date_add(last, 1))).orderBy(F.desc("ts"), "item_id").limit(n)


def merge_results(parts: Sequence[DataFrame], key: str) -> DataFrame:
    """Union of result sets with one row per key: of the lowest source position, and there the smallest of its other columns."""
    out, rest = None, [x for x in parts[0].columns if x != key]
    for i, p in enumerate(parts):
        p = p.withColumn("_src", F.lit(i))
        out = p if out is None else out.unionByName(p)
    first = out.groupBy(key).agg(F.min(F.struct("_src", *rest)).alias("_r"))
    return first.select(*[c(x) if x == key else c(f"_r.{x}") for x in parts[0].columns])
