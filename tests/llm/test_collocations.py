"""Collocations against a plain count of all phrases, and the tiles against a dictionary."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from barloom.llm.collocations import collocations, count_pairs

SCHEMA = "doc_id bigint, lang string, text string, word string, f bigint, block int"
LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def plain(rows, least, top):
    n, f = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 6):
                f.update((lang, *w[i : i + k]) for i in range(len(w) - k + 1))
    long = {p: c for p, c in f.items() if c >= least and len(p) > 2}
    gone = set()
    for p, c in long.items():
        for k in range(2, len(p) - 1):
            gone.update(s for i in range(1, len(p) - k + 1) if f[s := (p[0], *p[i : i + k])] <= c)
    found = {}
    for p, a in long.items():
        if p in gone:
            continue
        lang, w = p[0], p[1:]
        cuts = [(1000 * a * n[lang] // (f[(lang, *w[:k])] * f[(lang, *w[k:])]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        found.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), f[(lang, *w[:k])], f[(lang, *w[k:])]))
    return sorted((lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for lang, all_ in found.items() for i, (s, a, p, left, right) in enumerate(sorted(all_)[:top]))


def check(spark, rows, least=2, top=2000, **more):
    df = spark.createDataFrame([(i, *r, "x", 0, 0) for i, r in enumerate(rows)], SCHEMA)
    got = sorted(tuple(r) for r in collocations(df, least, top=top, **more).collect())
    assert got == plain(rows, least, top)
    return got


@pytest.mark.parametrize("tile,dense", [(4, 1), (4, 6), (256, 4096), (8, 10**9)])
def test_tiles_count_like_a_dictionary(tile, dense):
    rng = np.random.default_rng(3)
    x, y = (rng.zipf(1.6, 3000) % 50 for _ in range(2))
    got = {(int(a), int(b)): int(c) for a, b, c in zip(*count_pairs(x, y, tile, dense), strict=True)}
    assert got == Counter(zip(x.tolist(), y.tolist(), strict=True))


def test_phrases_equal_a_plain_count(spark):
    pick = random.Random(5)
    words = ["The", "of", "é", "Éa", "x1", "und", "|", "a\x00b", "\x1c", "ß"]
    rows = []
    for _ in range(60):
        text = "".join(pick.choice(words[: pick.choice([2, 10])]) + pick.choice([" "] * 9 + ["\t ", ", ", ".\n", "\r", "!?", "\x0b"]) for _ in range(pick.randrange(80)))
        rows.append((pick.choice(["en", "de", None]), text))
    got = check(spark, rows)
    assert max(len(r[2].split(" ")) for r in got) == 5
    check(spark, rows, least=4, top=3)
    check(spark, rows, broadcast_pairs=0)


def test_nulls_empties_ties_repeats_and_long_texts(spark):
    rows = [(None, None), ("en", ""), ("en", " .,. \t"), ("und", "a b. b c"), (None, "a b"), ("en", "new york " * 40_000), ("en", "w" * 200_000)]
    check(spark, rows + [("fr", "p q r s t u"), ("fr", "p q r s t u"), ("fr", "q p. q p")])


def test_an_empty_table_gives_no_rows(spark):
    assert collocations(spark.createDataFrame([], SCHEMA)).count() == 0


def test_scores_beyond_64_bits_are_exact(spark):
    """1000 * a * n passes 64 bits long before the counts do."""
    from pyspark.sql import functions as F

    from barloom.llm.collocations import CUT

    a, n, left, right = 3_000_000_007, 9_000_000_000_019, 4_000_000_009, 5_000_000_021
    df = spark.range(1).select(F.lit(a).alias("f"), F.lit(n).alias("n"), F.array(F.lit(left)).alias("heads"), F.array(F.lit(right)).alias("tails"))
    assert df.select(F.expr(CUT)["score"]).first()[0] == 1000 * a * n // (left * right)
