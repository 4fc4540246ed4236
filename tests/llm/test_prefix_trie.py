"""The prefix trie against a plain restatement, with and without rounds over stored chains."""

import random
import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from barloom.llm.prefix_trie import prefix_trie

SCHEMA = "conv_id bigint, turn bigint, role string, text string, node string, part int"


def plain(rows):
    own = {}
    for conv, turn, role, text in sorted({i: r for i, r in enumerate(rows) if r[0] is not None}.values(), key=lambda r: (r[1] is not None, r[1] or 0)):
        own.setdefault(conv, []).append((role or "", text or ""))
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = tuple(own.get(c - c % 5, [])[:h] + turns[h:])
    members = {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(c)
    kids = {}
    for k in members:
        if k:
            kids[k[:-1]] = kids.get(k[:-1], 0) + 1
    leaves, saved = dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for k, m in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += k not in kids
            saved[k[:d]] += (len(m) - 1) * len(k[-1][1].encode()) if k else 0
    out = []
    for k, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(built[c]) == len(k))
        out.append((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), kids.get(k, 0), leaves[k], saved[k], sha256(ends.encode()).hexdigest()))
    return sorted(out)


def check(spark, rows, **more):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    got = sorted(tuple(r) for r in prefix_trie(df, **more).collect())
    assert got == plain(rows)
    return got


def conversations(seed, n, depth, words):
    pick = random.Random(seed)
    rows = []
    for c in range(n):
        for t in range(pick.randrange(depth)):
            rows.append((c, t, pick.choice(["user", "assistant"]), pick.choice(words)))
    pick.shuffle(rows)
    return rows


@pytest.mark.parametrize("local_rows", [4, 40, None])
def test_trie_equals_a_plain_restatement(spark, local_rows):
    check(spark, conversations(7, 60, 12, ["a", "é", "long " * 50]), local_rows=local_rows)


def test_a_hot_opening_copies_and_a_deep_conversation(spark):
    rows = [(c, t, "user", "same" if t < 3 else f"own {c % 7} {t}") for c in range(200) for t in range(5)]
    rows += [(1000, t, "user", f"deep {t}") for t in range(300)]
    check(spark, rows, local_rows=16)
    check(spark, rows)


def test_nulls_repeated_rows_and_missing_bases(spark):
    rows = [(3, None, None, "x"), (3, 0, "user", None), (3, 1, None, None), (None, 0, "user", "lost"), (7, 5, "", ""), (7, 5, "", ""), (-4, 0, "u", "x"), (2**40, 1, "u", "y" * 100_000)]
    check(spark, rows, local_rows=2)


def test_an_empty_table_gives_no_rows(spark):
    assert prefix_trie(spark.createDataFrame([], SCHEMA)).count() == 0
    assert prefix_trie(spark.createDataFrame([(None, 1, "a", "b", "c", 1)], SCHEMA)).count() == 0


def test_ends_of_many_ids_span_several_chunks(spark):
    df = spark.range(0, 30_000, 5).select(F.col("id").alias("conv_id"), F.lit(0).alias("turn"), F.lit("u").alias("role"), F.lit("t").alias("text"))
    own = [c for c in range(0, 30_000, 5) if zlib.crc32(str(c).encode()) % 9 >= 0]
    want = sha256(",".join(map(str, own)).encode()).hexdigest()
    assert prefix_trie(df).where("depth = 1").select("ends_sha256").first()[0] == want
