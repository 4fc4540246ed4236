"""The pipeline's stages on a small input, one after another, each judged on what it was given."""

import corpus_pipeline
import pytest

from barloom.llm import catalog, decontaminate, simhash, toxicity
from barloom.llm.common import store, table

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs = [table(spark, SF, "documents")]
    for _, stage in corpus_pipeline.STAGES:
        docs.append(store(stage(spark, docs[-1], SF)))
    return docs


def test_stages_are_in_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "decontamination", "packing"]
    assert corpus_pipeline.ORACLE_SQL is None


def test_columns_stay_until_the_last_stage(steps):
    assert all(d.columns == steps[0].columns for d in steps[:-1])
    assert {"doc_id", "start", "length", "ids", "sequence_id", "offset"} <= set(steps[-1].columns)


def test_each_decision_takes_effect(spark, steps):
    ids = [{r.doc_id for r in d.select("doc_id").collect()} for d in steps]
    model = toxicity.train(steps[0], table(spark, SF, "labels").where(~toxicity.held_out()))
    assert ids[1] == {r.doc_id for r in toxicity.score(steps[0], model).where("score < 0.3").collect()}
    assert ids[2] == ids[1]
    found = simhash.near_duplicates(steps[2], **simhash.STAGE).collect()
    assert ids[3] == {r.component_id for r in found}
    leaks = {r.doc_id for r in decontaminate.contained_items(steps[3], table(spark, SF, "benchmark")).collect()}
    assert ids[4] == ids[3] - leaks and ids[5] == ids[4]


def test_run_gives_the_last_stage(spark, steps):
    key = ["doc_id", "start", "length", "ids_crc32"]
    rows = lambda d: sorted(map(tuple, d.select(key).collect()))
    total = lambda d: sum(r.length for r in d.select("length").collect())
    run = corpus_pipeline.run(spark, SF)
    assert total(run) == total(steps[-1]) and {r[0] for r in rows(run)} == {r[0] for r in rows(steps[-1])}


def test_an_empty_input_runs_through(spark):
    docs = table(spark, SF, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = store(stage(spark, docs, SF))
    assert docs.count() == 0


def test_one_query_for_each_operator():
    names = sorted(catalog.QUERIES)
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11))
    assert set(catalog.ORACLES) <= set(names)
