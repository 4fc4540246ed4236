"""Sentiment and report-text queries over whole documents and conversations."""

from pyspark.sql import functions as F

from barloom.operators import text as T
from barloom.plans import bindings as D
from barloom.plans.registry import query

c = F.col
# words that occur in the given texts stand in for the market lexicon
LEXICON = {"tion": 0.4, "les": 0.6, "with": 0.5, "from": -0.6, "der": -0.5, "was": -0.4, "que": 0.3, "en el": -0.7}
NEGATIONS = ["e ", "n "]
INTENSIFIERS = {"thth": 1.5, "ough": 1.3}
TOPICS = ["the", "les", "der", "que", "tion", "license", "http", "email", "und", "ing", "con", "zzz"]


def count_sql(t, w):
    return f"((length({t}) - length(replace({t}, '{w}', ''))) / {len(w)}e0)"


def _score_sql(t):
    parts, hits = [], []
    for w, weight in LEXICON.items():
        at = f"instr({t}, '{w}')"
        before = f"substring({t}, greatest({at} - 2, 1), least({at} - 1, 2))"
        neg = " OR ".join(f"contains({before}, '{x}')" for x in NEGATIONS)
        strong = "CASE " + " ".join(f"WHEN contains(substring({t}, 1, {at} + 9), '{x}') THEN {k}e0" for x, k in INTENSIFIERS.items()) + " ELSE 1e0 END"
        parts.append(f"CASE WHEN {at} > 0 THEN {count_sql(t, w)} * {weight}e0 * CASE WHEN {at} > 1 AND ({neg}) THEN -0.7e0 ELSE {strong} END ELSE 0 END")
        hits.append(count_sql(t, w))
    return " + ".join(parts), " + ".join(hits)


_S, _H = _score_sql("text")
DOCS = f"""sc0 AS (SELECT doc_id, lang, source, text, {_S} AS raw, {_H} AS hits FROM documents),
sc AS (SELECT doc_id, lang, source, hits, DATE '2024-01-01' + CAST(doc_id % 30 AS INTEGER) AS day, greatest(-1, least(1, coalesce(raw / nullif(hits, 0), 0))) AS score FROM sc0)"""


def scored(spark, sf):
    d = D.table(spark, sf, "documents").select("doc_id", "lang", "source", "text")
    return T.lexicon_score(d, LEXICON, NEGATIONS, INTENSIFIERS).withColumn(
        "day", F.date_add(F.lit("2024-01-01").cast("date"), (c("doc_id") % 30).cast("int")))


@query("t01_lexicon_score", "doc_id:i hits:f0 score:f6", DOCS + "\n---\nSELECT * FROM sc")
def lexicon(spark, sf):
    return scored(spark, sf)


LABEL = "CASE WHEN score > 0.3 THEN 'strongly_bullish' WHEN score > 0.1 THEN 'bullish' WHEN score > -0.1 THEN 'neutral' WHEN score > -0.3 THEN 'bearish' ELSE 'strongly_bearish' END"


@query("t02_sentiment_label", "doc_id:i label:s quality:f0", DOCS + f"\n---\nSELECT sc.doc_id, {LABEL} AS label, quality FROM sc LEFT JOIN labels USING (doc_id)")
def label(spark, sf):
    return scored(spark, sf).withColumn("label", T.sentiment_label(c("score"))).join(D.table(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left")


def _buzz_sql(by):
    return DOCS + f""",
bz AS (SELECT {by}, count(*) AS posts, count(DISTINCT source) AS sources, avg(score) AS mean, stddev_pop(score) AS sd, avg((score > 0.1)::INT) AS bullish_share, avg((score < -0.1)::INT) AS bearish_share FROM sc GROUP BY {by}),
bx AS (SELECT *, greatest(0, least(100, 50 + ((mean + 1) * 30 + bullish_share * 40 - 50) * (0.3e0 + 0.7e0 * least(posts / 30e0, 1)))) AS index FROM bz)"""


@query("t03_buzz_metrics", "day:d lang:s posts:i sources:i mean:f6 sd:f6 bullish_share:f6 bearish_share:f6 level:s", _buzz_sql("day, lang") + """
---
SELECT *, CASE WHEN posts >= 50 THEN 'very_high' WHEN posts >= 30 THEN 'high' WHEN posts >= 15 THEN 'medium' WHEN posts >= 5 THEN 'lowish' ELSE 'low' END AS level FROM bx""")
def buzz(spark, sf):
    return T.buzz_metrics(scored(spark, sf), ["day", "lang"])


@query("t04_hot_topics", "topic:s mentions:f0", "tp AS (" + " UNION ALL ".join(f"SELECT '{w}' AS topic, sum({count_sql('text', w)}) AS mentions FROM documents" for w in TOPICS) + """)
---
SELECT * FROM tp WHERE mentions > 0 ORDER BY mentions DESC, topic LIMIT 10""")
def topics(spark, sf):
    return T.hot_topics(D.table(spark, sf, "documents"), TOPICS)


@query("t05_fear_greed", "day:d lang:s index:f4 mood:s", _buzz_sql("day, lang") + """
---
SELECT *, CASE WHEN index >= 80 THEN 'extreme_greed' WHEN index >= 60 THEN 'greed' WHEN index >= 40 THEN 'neutral' WHEN index >= 20 THEN 'fear' ELSE 'extreme_fear' END AS mood FROM bx""")
def fear_greed(spark, sf):
    return T.fear_greed(buzz(spark, sf))


@query("t06_sentiment_reversal", "lang:s posts:i early:f6 late:f6 shift:f6 reversal:s", DOCS + """,
rv AS (SELECT lang, score, row_number() OVER (PARTITION BY lang ORDER BY day, doc_id) <= count(*) OVER (PARTITION BY lang) // 2 AS e FROM sc),
rg AS (SELECT lang, count(*) AS posts, avg(score) FILTER (e) AS early, avg(score) FILTER (NOT e) AS late, avg(score) FILTER (NOT e) - avg(score) FILTER (e) AS shift FROM rv GROUP BY 1)
---
SELECT *, CASE WHEN shift > 0.1 THEN 'improving' WHEN shift < -0.1 THEN 'worsening' ELSE 'stable' END AS reversal FROM rg""")
def reversal(spark, sf):
    return T.sentiment_reversal(scored(spark, sf), ["lang"], ["day", "doc_id"])


PX = """ep AS (SELECT CAST(ts AS DATE) AS day, avg(value) AS close FROM events GROUP BY 1),
er AS (SELECT day, close / first_value(close) OVER w - 1 AS ret5 FROM ep WINDOW w AS (ORDER BY day ROWS 4 PRECEDING))"""


@query("t07_price_sentiment_divergence", "day:d ret5:f6 mean:f6 divergence:s", _buzz_sql("day") + "," + PX + """
---
SELECT day, ret5, mean, CASE WHEN ret5 > 0.02 AND mean < -0.1 THEN 'bearish_divergence' WHEN ret5 < -0.02 AND mean > 0.1 THEN 'bullish_divergence' WHEN (ret5 > 0.02 AND mean > 0.1) OR (ret5 < -0.02 AND mean < -0.1) THEN 'trend_confirmation' ELSE 'neutral' END AS divergence
FROM bx JOIN er USING (day)""")
def divergence(spark, sf):
    from pyspark.sql import Window

    px = D.events(spark, sf).groupBy(F.to_date("ts").alias("day")).agg(F.avg("value").alias("close"))
    w = Window.orderBy("day").rowsBetween(-4, 0)          # one row per day
    px = px.select("day", (c("close") / F.first("close").over(w) - 1).alias("ret5"))
    return T.price_divergence(T.buzz_metrics(scored(spark, sf), ["day"]).join(px, "day"))


@query("t08_overall_score", "day:d overall:f4", _buzz_sql("day") + """,
ov AS (SELECT day, mean, (mean + 1) * 20 + abs(index - 50) * 0.4 + least(posts * 2, 100) * 0.2 + greatest(bullish_share, bearish_share) * 20 AS s FROM bx)
---
SELECT day, greatest(0, least(100, CASE WHEN mean < -0.1 THEN 100 - s ELSE s END)) AS overall FROM ov""")
def overall(spark, sf):
    return T.overall_score(T.fear_greed(T.buzz_metrics(scored(spark, sf), ["day"])))


# ---- reports: the first line is the title, the whole text the body --------------------------------
REP = """rp AS (SELECT doc_id, source, lang, string_split(text, chr(10))[1] AS title, text AS body, CASE doc_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'soon' WHEN 2 THEN strftime(DATE '2024-01-01' + CAST(doc_id % 300 AS INTEGER), '%Y-%m-%d') || ' 08:30:00'
  ELSE strftime(DATE '2024-01-01' + CAST(doc_id % 300 AS INTEGER), '%Y-%m-%d') END AS publish_date FROM documents)"""


def reports(spark, sf):
    d = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (c("doc_id") % 300).cast("int")), "yyyy-MM-dd")
    m = c("doc_id") % 5
    pub = F.when(m == 0, F.lit(None).cast("string")).when(m == 1, F.lit("soon")).when(m == 2, F.concat(d, F.lit(" 08:30:00"))).otherwise(d)
    return D.table(spark, sf, "documents").select("doc_id", "source", "lang", F.split("text", "\n")[0].alias("title"), c("text").alias("body"), pub.alias("publish_date"))


@query("t09_date_filter", "doc_id:i publish_date:s", REP + """
---
SELECT doc_id, publish_date FROM rp WHERE publish_date IS NULL OR publish_date = 'soon' OR CAST(publish_date[1:10] AS DATE) BETWEEN DATE '2024-03-01' AND DATE '2024-06-30'""")
def date_filter(spark, sf):
    return T.date_filter(reports(spark, sf), F.lit("2024-03-01").cast("date"), F.lit("2024-06-30").cast("date"))


KEYS = ["the", "les", "license"]


@query("t10_relevance", "doc_id:i relevance:i", REP + """
---
SELECT doc_id, CASE WHEN length(title) BETWEEN 10 AND 50 THEN 1 ELSE 0 END + CASE WHEN regexp_matches(title, '[0-9]') THEN 1 ELSE 0 END""" + "".join(
    f" + CASE WHEN contains(lower(title), '{k}') OR contains(lower(body), '{k}') THEN 2 ELSE 0 END" for k in KEYS) + " AS relevance FROM rp")
def relevance(spark, sf):
    return T.relevance(reports(spark, sf), KEYS)


RATES, TARGETS, WORDS, INDS = ["license", "copy", "email"], [r"(\d+(?:\.\d+)?) (?:the|of)", r"\+(\d+)"], ["http", "que"], ["tion", "und"]
FACTS = REP + """,
ft AS (SELECT *, CASE """ + " ".join(f"WHEN contains(title || ' ' || body, '{w}') THEN '{w}'" for w in RATES) + " END AS rating, CAST(coalesce(" + ", ".join(
    f"nullif(regexp_extract(title || ' ' || body, '{p}', 1), '')" for p in TARGETS) + ") AS DOUBLE) AS target_price, CASE " + " ".join(
    f"WHEN contains(title || ' ' || body, '{w}') THEN '{w}'" for w in INDS) + " END AS industry, contains(body, 'http') OR contains(body, 'que') AS has_analysis FROM rp)"


def _facts(spark, sf):
    return T.report_facts(reports(spark, sf), RATES, TARGETS, WORDS, INDS)


@query("t11_report_facts", "doc_id:i rating:s target_price:f4 industry:s has_analysis:b", FACTS + "\n---\nSELECT * FROM ft")
def facts(spark, sf):
    return _facts(spark, sf)


@query("t12_corpus_statistics", "source:s lang:s docs:i mean_length:f4 rated:i target_share:f6 analyses:i", FACTS + """
---
SELECT source, lang, count(*) AS docs, avg(length(body)) AS mean_length, count(rating) AS rated, avg((target_price IS NOT NULL)::INT) AS target_share, count_if(has_analysis) AS analyses FROM ft GROUP BY 1, 2""")
def corpus(spark, sf):
    return T.corpus_statistics(_facts(spark, sf), ["source", "lang"])


@query("t13_news_window", "item_id:i ts:t", """SELECT event_id AS item_id, ts FROM events WHERE ts > DATE '2024-01-20' - 5 AND ts < DATE '2024-01-20' + 1 ORDER BY ts DESC, event_id LIMIT 50""")
def news(spark, sf):
    return T.news_window(D.events(spark, sf).select(c("event_id").alias("item_id"), "ts"), F.lit("2024-01-20").cast("date"), 5, 50)


@query("t14_merge_results", "doc_id:i lang:s", """
SELECT DISTINCT doc_id, lang FROM documents WHERE contains(text, 'tion') OR contains(text, 'les') OR lang = 'de'""")
def merge(spark, sf):
    d = D.table(spark, sf, "documents")
    return T.merge_results([d.where(c("text").contains("tion")).select("doc_id", "lang"), d.where(c("text").contains("les")).select("doc_id", "lang"), d.where("lang = 'de'").select("doc_id", "lang")], "doc_id")
