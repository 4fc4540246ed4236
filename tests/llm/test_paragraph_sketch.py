"""Paragraph sketches against sets of digests, and the query against brute force."""

import random
from hashlib import sha256

import numpy as np
import pytest

from barloom.llm.paragraph_sketch import Sketches, differences, digests, paragraph_fingerprints, sketched

SCHEMA = "doc_id bigint, text string, part int, guest string"


def jaccard(a, b):
    a, b = set(digests(a).tolist()), set(digests(b).tolist())
    return len(a & b) / len(a | b) if a | b else 1.0


def check(spark, rows):
    df = spark.createDataFrame([(*r, 7, "g") for r in rows], SCHEMA)
    got = paragraph_fingerprints(df.repartition(3)).collect()
    order = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode()))
    want = []
    for k, (i, t) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        half = len(t) // 2
        new = t[: len(t) - half] + after[:half]
        want.append((i, len(t), sha256(new.encode()).hexdigest(), round(jaccard(t, new), 9), round(jaccard(t, after), 9)))
    key = lambda r: repr(r)
    assert sorted(((r["doc_id"], r["n_chars"], r["edited_sha256"], round(r["near_edited"], 9), round(r["near_next"], 9)) for r in got), key=key) == sorted(want, key=key)
    by_text = {}
    for (i, t), r in zip(order, sorted(got, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0)), strict=True):
        if i is not None and sum(j == i for j, _ in order) == 1:
            assert by_text.setdefault(t, r["fingerprint"]) == r["fingerprint"]
    return got


def texts(seed, n, words):
    pick = random.Random(seed)
    vocabulary = ["".join(pick.choice("abcdeéß漢 ") for _ in range(6)) for _ in range(200)]
    return ["".join(pick.choice(vocabulary) + pick.choice([" ", " ", ". ", "\n"]) for _ in range(pick.randrange(words))) for _ in range(n)]


def test_query_equals_brute_force(spark):
    check(spark, [(i * 3, t) for i, t in enumerate(texts(1, 120, 400))])


def test_nulls_empties_ties_repeats_and_long_texts(spark):
    rows = [(None, "lost"), (None, None), (5, None), (6, ""), (7, "a"), (8, "aa"), (9, "same\n" * 500), (10, "same\n" * 501), (11, "x" * 300_000), (2**50, "é\n漢字" * 9), (12, "same\n" * 500)]
    check(spark, rows + [(13, "tie b"), (13, "tie a"), (14, "copy"), (14, "copy")])


@pytest.mark.parametrize("rows", [[], [(1, "only one")], [(None, "no id")]])
def test_very_small_tables(spark, rows):
    assert len(check(spark, rows)) == len(rows)


def test_all_rows_of_one_id(spark):
    assert len(check(spark, [(4, f"text {i}") for i in range(30)])) == 30


def test_peeling_recovers_both_sides():
    rng = np.random.default_rng(2)
    a, b = [], []
    for n, more, less in [(0, 0, 0), (50, 1, 0), (50, 2, 3), (1000, 0, 400), (10, 5000, 0), (300, 300, 300), (0, 7, 9)]:
        shared, left, right = (rng.integers(0, 1 << 63, k, dtype=np.uint64) for k in (n, more, less))
        a.append(np.append(shared, left))
        b.append(np.append(shared, right))
    pair, keys, sign = differences(a, b)
    for i, (x, y) in enumerate(zip(a, b, strict=True)):
        here = pair == i
        assert set(keys[here & (sign == 1)].tolist()) == set(x.tolist()) - set(y.tolist())
        assert set(keys[here & (sign == -1)].tolist()) == set(y.tolist()) - set(x.tolist())


def test_stored_fingerprints_subtract_without_the_texts():
    """One changed line of fifty is told by two strings alone."""
    a = [f"line {i} of the first version" for i in range(50)]
    b = a.copy()
    b[20] = "rewritten"
    sets = [digests("\n".join(v)) for v in (a, b)]
    left, right = (Sketches.decoded(sketched([s]).encoded()) for s in sets)
    rest = left.minus(right)
    _, keys, sign = rest.peel()
    assert not len(rest.left())
    assert {(int(k), int(s)) for k, s in zip(keys, sign, strict=True)} == {(k, 1) for k in set(sets[0].tolist()) - set(sets[1].tolist())} | {(k, -1) for k in set(sets[1].tolist()) - set(sets[0].tolist())}


def test_a_wider_sketch_is_taken_when_cells_remain():
    rng = np.random.default_rng(4)
    a, b = (rng.integers(0, 1 << 63, 200, dtype=np.uint64) for _ in range(2))
    small = sketched([a]).minus(sketched([b]))
    small.peel()
    assert len(small.left())
    assert len(differences([a], [b])[0]) == 400
