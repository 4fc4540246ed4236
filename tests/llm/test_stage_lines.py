"""Line dedup of the pipeline: every template of a leaf, long repeats from two documents on, similar lines only."""

import re

import corpus_pipeline
from test_counts_and_filters import frame


def rest(spark, texts, ids=None):
    return [r.text for r in sorted(corpus_pipeline.line_dedup(spark, frame(spark, texts, ids), "").collect(), key=lambda r: (r.doc_id, r.text))]


def passage(name, n=60):
    return "it begins alike " + " ".join(name + chr(97 + i % 26) + chr(97 + i // 26) for i in range(n - 3))


def test_two_templates_of_a_leaf_both_go(spark):
    assert rest(spark, [passage("x")] * 6 + [passage("y")] * 5) == [passage("x"), *[""] * 5, passage("y"), *[""] * 4]
    varied = [passage(name).replace(name + "ea", word).replace(name + "za", word) for name in "xy" for word in ("one", "two", "three")]
    assert rest(spark, varied) == [varied[0], "", "", varied[3], "", ""]


def test_lines_of_a_row_are_told_by_its_text(spark):
    line = passage("x")
    assert rest(spark, [line] * 3 + ["head\n" + line, "other\nkept"], [0, 1, 2, 5, 5]) == [line, "", "", "head", "other\nkept"]


def test_stage_runs_no_python(spark):
    plan = corpus_pipeline.line_dedup(spark, frame(spark, ["a\nb"] * 5), "")._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|CartesianProduct|NestedLoop", plan)


def test_long_lines_recur_from_two_documents_on(spark):
    assert rest(spark, [passage("x", 51), "1 " + passage("y", 50), passage("x", 51), "23 " + passage("y", 50), passage("z", 50), passage("z", 50)]) == [passage("x", 51), "1 " + passage("y", 50), "", "", passage("z", 50), passage("z", 50)]


def test_lines_that_only_begin_alike_stay(spark):
    short = [f"Thanks for the {a}{a} {b}{b}" for a, b in zip("abcde", "vwxyz", strict=True)] + [f"All rights are reserved by {a}" for a in "abcde"]
    long = [" ".join(w if i % 3 else w + a for i, w in enumerate(passage("x").split())) for a in "abcde"]
    assert rest(spark, short + long) == short + long


def test_lines_that_only_begin_alike_are_not_tried(spark, monkeypatch):
    from barloom.llm import line_templates

    tried, store = [], line_templates.store
    monkeypatch.setattr(line_templates, "store", lambda df: tried.append(store(df)) or tried[-1])
    near = [passage("u").replace("u" + gone, word) for gone, word in (("ea", "one"), ("fa", "two"), ("ga", "three"))]
    texts = [passage(name) for name in "vwxyz"] + near
    assert rest(spark, texts) == texts[:6] + ["", ""]
    patterns = next(t for t in tried if "pattern" in t.columns)
    assert patterns.count() and {r.low for r in patterns.select("low").distinct().collect()} == {5, 6, 7}
