"""Top-k over vectors with very large finite components."""

import numpy as np

from barloom.llm import topk


def test_large_finite_vectors_take_part(spark, monkeypatch):
    monkeypatch.setattr(topk, "CHUNK", 16)
    x = np.random.default_rng(5).normal(size=(200, 6)).round(2)
    x[60] *= 2.0**16
    x[100] *= 2.0**15
    x[150] = [2.0**18, -(2.0**18), 0, 0, 0, 1]
    whole = [[int(v) for v in np.floor(r * 1024)] for r in x]
    vectors = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id bigint, embedding array<double>")
    want = []
    for q in (0, 100):
        best = sorted((-sum(a * b for a, b in zip(whole[q], w, strict=True)), i) for i, w in enumerate(whole) if i != q)[:10]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert {60, 150} & {w[2] for w in want}
    assert sorted(map(tuple, topk.top_k(vectors, vectors.where("vec_id % 100 = 0")).collect())) == sorted(want)
