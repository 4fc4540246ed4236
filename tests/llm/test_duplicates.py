"""Line dedup, SimHash, suffix dedup, decontamination, back-off, top-k: against brute force on small fixtures."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from test_counts_and_filters import frame, odd_texts

from barloom.llm import backoff, bwt, decontaminate, line_templates, packing, simhash, suffix_dedup, topk
from barloom.llm.components import components


def copies(seed, n=60):
    """Texts with exact copies, near copies, shared passages, empties and nulls."""
    pick = random.Random(seed)
    words = [a + b + c for a in "tnrslk" for b in "aeiou" for c in ("n", "rth", "s", "l", "")]
    passage = " ".join(pick.choice(words) for _ in range(90))
    texts = []
    for _ in range(n):
        kind = pick.random()
        if texts and kind < 0.2:
            texts.append(pick.choice(texts))
        elif texts and kind < 0.4 and (near := pick.choice(texts)):
            w = near.split(" ")
            w[pick.randrange(len(w))] = pick.choice(words)
            texts.append(" ".join(w))
        elif kind < 0.5:
            texts.append(pick.choice([None, "", " ", "one", "Two words"]))
        else:
            t = " ".join(pick.choice(words) for _ in range(pick.randint(1, 160)))
            texts.append(t + (" " + passage + " " if kind > 0.8 else "") + (t[:80] if kind > 0.9 else ""))
    return texts


def plain_fingerprint(text, words):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + words]), 42) for i in range(max(1, len(w) - words + 1))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(values, linked, ids):
    root = list(range(len(values)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(values)):
        for j in range(i):
            if linked(values[i], values[j]):
                root[find(i)] = find(j)
    low = defaultdict(lambda: math.inf)
    for i, doc in enumerate(ids):
        low[find(i)] = min(low[find(i)], doc)
    return [low[find(i)] for i in range(len(ids))]


def test_simhash_against_all_pairs(spark):
    texts = copies(1) + odd_texts(40)
    ids = [7 * i % 1009 for i in range(len(texts))]
    got = {r.doc_id: r for r in simhash.near_duplicates(frame(spark, texts, ids), distance=6).collect()}
    fp = [plain_fingerprint(t, 3) for t in texts]
    assert [got[i].fp % 2**64 for i in ids] == fp
    assert [got[i].component_id for i in ids] == plain_components(fp, lambda a, b: (a ^ b).bit_count() <= 6, ids)


@pytest.mark.parametrize(("distance", "bits"), [(0, 5), (1, 7), (2, 5), (3, 5), (2, 4), (2, 3), (3, 2)])
def test_linked_fingerprints_meet_at_an_anchor(distance, bits):
    pick = random.Random(distance * 10 + bits)
    a = np.array([pick.getrandbits(64) for _ in range(200)], np.uint64)
    b = np.array([int(x) ^ sum(1 << k for k in pick.sample(range(64), pick.randint(0, distance))) for x in a], np.uint64)
    row, anchor, lives = simhash.anchors(a, distance, bits)
    home = {int(r): int(x) for r, x, h in zip(row, anchor, lives, strict=True) if h}
    row, anchor, _ = simhash.anchors(b, distance, bits)
    assert all((r, home[r]) in set(zip(row.tolist(), anchor.tolist(), strict=True)) for r in range(200))


def test_blocks_shrink_as_fingerprints_grow():
    assert [simhash.block_bits(n) for n in (0, 10**6, 10**7, 10**9, 10**12, 10**13)] == [5, 5, 4, 3, 2, 2]


def test_keep_first_keeps_one_of_each_group(spark):
    pick = random.Random(4)
    long = [" ".join(pick.choice(["alpha", "beta", "gamma", "delta", "eps"]) + str(pick.randint(0, 300)) for _ in range(400)) for _ in range(4)]
    near = [t.replace(t.split(" ")[5], "changed", 1) for t in long]
    docs = frame(spark, [*long, *near, *long, None, None, ""], [*range(12), 20, None, 21])
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [0, 1, 2, 3, 20]
    assert sum(r.doc_id is None for r in kept.collect()) == 1
    assert simhash.keep_first(docs.limit(0)).count() == 0


def five_words(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_near_copies_are_those_of_exact_similarity(spark):
    pick = random.Random(11)
    word = lambda: "w%d" % pick.randint(0, 5000)
    texts = []
    for _ in range(60):
        base = [word() for _ in range(pick.choice([8, 60, 200, 500]))]
        for edits in (0, 1, 0.01, 0.02, 0.025, 0.04, 0.07):  # similarities from 1 to about 0.5
            w = list(base)
            for at in pick.sample(range(len(w)), int(edits if edits >= 1 else edits * len(w))):
                w[at] = word()
            texts.append(" ".join(w))
    sets = [five_words(t) for t in texts]
    linked = lambda a, b: len(a & b) >= 0.8 * len(a | b)
    want = plain_components(sets, linked, range(len(texts)))
    assert len(texts) > len(set(want)) > 60  # some groups of seven are apart
    got = simhash.near_duplicates(frame(spark, texts), **simhash.STAGE).collect()
    assert {r.doc_id: r.component_id for r in got} == dict(enumerate(want))
    assert {r.doc_id for r in simhash.keep_first(frame(spark, texts)).collect()} == set(want)


def test_a_large_group_that_is_mostly_apart_is_compared_in_many_cells(spark, monkeypatch):
    """Copies of one text that share keys but are mostly less than 0.8 alike: links are found across blocks of a key."""
    monkeypatch.setattr(simhash, "CELL", 4)
    pick = random.Random(12)
    base = ["b%d" % i for i in range(300)]
    texts = []
    for edits in [9] * 50 + [4] * 20 + [3] * 20:
        w = list(base)
        for at in pick.sample(range(len(w)), edits):
            w[at] = "w%d" % pick.randint(0, 10**6)
        texts.append(" ".join(w))
    sets = [five_words(t) for t in texts]
    want = plain_components(sets, lambda a, b: len(a & b) >= 0.8 * len(a | b), range(len(texts)))
    assert 1 < len(set(want)) < len(texts)
    got = simhash.near_duplicates(frame(spark, texts), **simhash.STAGE).collect()
    assert {r.doc_id: r.component_id for r in got} == dict(enumerate(want))


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 160)] + [(7, 7), (200, 201), (201, 200)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 160), 100), 200: 200, 201: 200}


def plain_cut(texts, length):
    raw = [(t or "").encode() for t in texts]
    count = Counter(t[i : i + length] for t in raw for i in range(len(t) - length + 1))
    out = []
    for t in raw:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if count[t[i : i + length]] > 1:
                gone[i : i + length] = True
        out.append((len(t), int(gone.sum()), int((np.diff(np.append(0, gone.astype(int))) == 1).sum()), hashlib.sha256(bytes(b for b, g in zip(t, gone, strict=True) if not g)).hexdigest()))
    return out


@pytest.mark.parametrize(("seed", "hot", "piece"), [(2, 4096, 1 << 20), (3, 1, 1 << 20), (4, 4096, 300)])
def test_suffix_dedup_against_brute_force(spark, monkeypatch, seed, hot, piece):
    monkeypatch.setattr(suffix_dedup, "PIECE", piece)
    texts = copies(seed, 50) + ["é" * 40 + "ab" * 300, "ab" * 280, "x" * 900, "ü" * 700]
    rows = suffix_dedup.cut_repeats(frame(spark, texts), length=100, gram=16, hot=hot, bin_bytes=3000).toPandas().set_index("doc_id")
    got = [(r.n_bytes, sum(s["to"] - s["from"] for s in r.spans), len(r.spans), hashlib.sha256(r.kept).hexdigest()) for r in rows.loc[range(len(texts))].itertuples()]
    assert got == plain_cut(texts, 100)


def plan_nodes(node):
    """(name, description, names of the two nodes under each child) of every node of a physical plan."""

    def under(n):
        below = [n.children().apply(k) for k in range(n.children().size())]
        return [y for x in below for y in (under(x) if re.match("WholeStageCodegen|InputAdapter", x.nodeName()) else [x])]

    for child in under(node):
        yield child.nodeName(), child.simpleString(1000), [[x.nodeName(), *(y.nodeName() for y in under(x))] for x in under(child)]
        yield from plan_nodes(child)


def test_suffix_dedup_deals_out_hot_anchors_and_bins(spark, monkeypatch):
    """Spark splits a join on a value of very many runs only if it reads both shuffles itself; bins have a task each, however many there are."""
    nodes = []

    def noted(df, **more):
        nodes.extend(plan_nodes(df._jdf.queryExecution().executedPlan()))
        return store(df, **more)

    store = suffix_dedup.store
    monkeypatch.setattr(suffix_dedup, "store", noted)
    conf = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        suffix_dedup.cut_repeats(frame(spark, copies(5, 50)), length=100, gram=16, bin_bytes=300)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    joins = [below for name, _, below in nodes if name == "SortMergeJoin"]
    assert len(joins) >= 2 and all(side[:2] == ["Sort", "Exchange"] for join in joins for side in join), joins
    parts = [int(n) for name, text, _ in nodes if name == "Exchange" for n in re.findall(r"hashpartitioning\(bin#\d+\w?, (\d+)\)", text)]
    assert max(parts) > int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_suffix_dedup_odd_rows(spark):
    same = "a b c " * 100
    docs = spark.createDataFrame([(1, same), (1, same), (None, "z" + same), (2, None), (3, "")], "doc_id bigint, text string")
    rows = suffix_dedup.cut_repeats(docs).collect()
    assert sorted((r.doc_id or 0, r.n_bytes, bytes(r.kept)) for r in rows) == [(0, 601, b"z"), (1, 600, b""), (1, 600, b""), (2, 0, b""), (3, 0, b"")]
    assert suffix_dedup.cut_repeats(docs.limit(0)).count() == 0


def test_merged_transforms_against_counting():
    pick = random.Random(3)
    for _ in range(150):
        length, letters = pick.choice([1, 2, 3, 5, 8, 12, 20]), pick.choice([b"ab", b"abc", bytes(range(256))])
        strings = list({bytes(pick.choice(letters) for _ in range(pick.randint(length, 40))) for _ in range(pick.randint(1, 12))})
        count = Counter(s[i : i + length] for s in strings for i in range(len(s) - length + 1))
        assert [h.tolist() for h in bwt.repeated_starts(strings, length)] == [[count[s[i : i + length]] > 1 for i in range(len(s) - length + 1)] for s in strings]


def test_lines_of_recurring_templates_go_but_for_the_first(spark):
    body = "This text of document %d has words %s that no other document has at all"
    texts = [body % (i, "abcdefghij"[i % 10] * 9 + str(i)) + f"\nCopyright 20{i:02d} the example site, all rights reserved\n\nunique {chr(97 + i)}{chr(98 + i)} ending" for i in range(6)]
    docs = frame(spark, [*texts, None, "", "a\nb"], [*range(6), 6, 7, 8])
    got = {r.doc_id: r for r in line_templates.line_report(docs).collect()}
    assert got[0].n_dropped == 0 and "Copyright" in got[0].text
    assert all("Copyright" not in got[i].text and got[i].n_lines == 4 for i in range(1, 6))
    assert (got[6].text, got[7].text, got[8].text) == (None, "", "a\nb") and got[6].n_lines == 0
    out = line_templates.dedup_lines(docs)
    assert out.columns == docs.columns and {r.doc_id: r.text for r in out.collect()} == {i: r.text for i, r in got.items()}
    assert line_templates.dedup_lines(docs.limit(0)).count() == 0
    lost = {r.doc_id: r.text for r in line_templates.dedup_lines(frame(spark, ["same line"] * 4, [5, 3, None, None])).collect()}
    assert lost == {3: "same line", None: "same line", 5: "same line"}  # two documents and nameless ones
    lost = {r.doc_id: r.text for r in line_templates.dedup_lines(frame(spark, ["same line"] * 4, [5, 3, 4, 9])).collect()}
    assert lost == {3: "same line", 4: "", 5: "", 9: ""}


def test_line_dedup_runs_no_python(spark):
    plan = line_templates.dedup_lines(frame(spark, ["a\nb"] * 5))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|CartesianProduct|NestedLoop", plan)


def test_containment_against_brute_force(spark, monkeypatch):
    pick = random.Random(8)
    words = ["w%d" % i for i in range(50)]
    items = [(i, " ".join(pick.choice(words) for _ in range(n))) for i, n in enumerate([3, 5, 6, 12, 30, 60])] + [(6, None), (7, ""), (None, "x y z u v w"), (3, "w1 w2 w3 w4 w5")]
    texts = []
    for _ in range(40):
        part = pick.choice(items)[1] or "nothing"
        w = part.split()
        if len(w) > 8 and pick.random() < 0.5:
            w[pick.randrange(len(w))] = "changed"
        texts.append(" ".join(pick.choice(words) for _ in range(pick.randint(0, 200))) + ("; " if pick.random() < 0.5 else "") + " ".join(w).upper())
    texts += [None, "", items[0][1], texts[0]]
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")

    def shingles(t):
        w = re.findall(r"[a-z0-9]+", (t or "").lower())
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    want = sorted((i, k, len(s), len(s & shingles(t))) for i, t in enumerate(texts) for k, s in {(k, frozenset(shingles(b))) for k, b in items if k is not None and shingles(b)} if len(s & shingles(t)) >= 0.8 * len(s))
    docs = frame(spark, texts)
    got = lambda: sorted((r.doc_id, r.item_id, r.n_shingles, r.n_found) for r in decontaminate.contained_items(docs, benchmark).collect())
    assert got() == want and want
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 1600)  # several blocks of items
    assert got() == want
    clean = decontaminate.decontaminate(docs, benchmark)
    assert clean.columns == docs.columns and {r.doc_id for r in clean.collect()} == set(range(len(texts))) - {w[0] for w in want}
    assert decontaminate.contained_items(docs, benchmark.limit(0)).count() == 0
    assert decontaminate.decontaminate(docs.limit(0), benchmark).count() == 0


def plain_backoff(texts, order, alpha=0.4):
    docs = [re.findall(r"[^\x00-/:-@\[-`{-\x7f]+", (t or "").lower()) for t in texts]
    grams = [Counter(tuple(d[i : i + n]) for n in range(1, order + 1) for i in range(len(d) - n + 1)) for d in docs]
    whole, size, out = sum(grams, Counter()), sum(map(len, docs)), []
    for d, own in zip(docs, grams, strict=True):
        total = 0.0
        for i in range(len(d)):
            factor = 1.0
            for n in range(min(order, i + 1), 0, -1):
                gram = tuple(d[i - n + 1 : i + 1])
                c = whole[gram] - own[gram]
                if n == 1:
                    total += math.log(factor * (c or alpha) / (size - len(d) + 1))
                elif c:
                    total += math.log(factor * c / (whole[gram[:-1]] - own[gram[:-1]]))
                    break
                factor *= alpha
        out.append((len(d), total))
    return out


@pytest.mark.parametrize(("order", "entries"), [(1, 10**6), (2, 50), (3, 500), (4, 10**6)])
def test_backoff_against_brute_force(spark, monkeypatch, order, entries):
    monkeypatch.setattr(backoff, "BUCKET_ENTRIES", entries)
    texts = copies(6) + ["", None, "onlyhere"]
    got = {r.doc_id: r for r in backoff.backoff_scores(frame(spark, texts), order).collect()}
    for i, (n, total) in enumerate(plain_backoff(texts, order)):
        assert got[i].n_words == n and math.isclose(got[i].log_score, total, rel_tol=1e-9, abs_tol=1e-9)
    assert backoff.backoff_scores(frame(spark, texts).limit(0), order).count() == 0


def test_packed_integers_round_trip():
    for x in ([0], [1, 2, 3], [2**63, 5, 2**64 - 1], list(range(1000))):
        a = np.array(x, np.uint64)
        assert (backoff.unpack_ints(backoff.pack_ints(a)) == a).all()
        assert (backoff.unpack_sorted(backoff.pack_sorted(np.unique(a))) == np.unique(a)).all()


def test_top_k_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(topk, "CHUNK", 16)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 24)).round(2)
    x[50:90] = x[50]  # ties
    rows = [(int(i), [float(v) for v in r], 0) for i, r in enumerate(x)]
    odd = [(1000, None, 0), (1100, [], 0), (1200, [float("nan")] * 24, 0), (1300, [None] * 24, 0), (1400, [float("inf")] * 24, 0), (1500, [1.0, 2.0], 0), (1501, [2.0, 1.0], 0), (None, [1.0] * 24, 0), (7, rows[7][1], 0)]
    vectors = spark.createDataFrame(rows + odd, "vec_id bigint, embedding array<double>, score int").repartition(4)
    used = [(i, np.floor(np.array(v) * 1024).astype(np.int64)) for i, v, _ in [*rows, rows[7], odd[5], odd[6]]]
    want = []
    for q, v in used:
        if q % 100 == 0:
            best = sorted((-int(v @ w), i) for i, w in used if i != q and len(w) == len(v))[:10]
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    asked = vectors.where("vec_id % 100 = 0")
    assert sorted(map(tuple, topk.top_k(vectors, asked).collect())) == sorted(want)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 64)
    assert sorted(map(tuple, topk.top_k(vectors, asked).collect())) == sorted(want)
    assert topk.top_k(vectors, asked.limit(0)).count() == 0 and topk.top_k(vectors.limit(0), asked).count() == 0


def test_bounds_are_never_below_the_score():
    rng = np.random.default_rng(4)
    x = rng.integers(-3000, 3000, (80, 37))
    for parts in topk.SEGMENTS:
        s = topk.statistics(x, parts)
        assert (s @ s.T + 1e-6 * np.abs(s @ s.T) + 1e-6 >= x @ x.T).all()


def test_packer_gives_full_windows():
    packer, windows = packing.Packer((4, 8, 16)), []
    pick, sizes = random.Random(1), {}
    for i in range(300):
        sizes[i] = pick.randint(1, 60)
        windows += packer.add(i, sizes[i])
        windows += packer.pack(last=False)
    windows += packer.pack(last=True)
    assert sum(sum(p[2] for p in w) != size for size, w in windows) <= 1
    covered = defaultdict(list)
    for _, w in windows:
        for d, start, n in w:
            covered[d] += range(start, start + n)
    assert all(sorted(covered[d]) == list(range(n)) for d, n in sizes.items())


def test_blocks_of_backoff_are_not_shuffled(spark):
    texts = ["a b c d"] * 3 + ["b c d e", None, ""]
    scored = backoff.backoff_scores(frame(spark, texts))
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(block") == 1 and "Bucketed: true" in plan  # the answers only
    assert scored.count() == len(texts)


def test_sorted_hashes_are_packed_below_six_bytes():
    rng = np.random.default_rng(3)
    for values in ([], [0], [2**64 - 1], [0, 2**64 - 1], rng.integers(0, 2**63, 5000)):
        h = np.unique(np.array(values, np.uint64))
        assert (backoff.unpack_sorted(backoff.pack_sorted(h)) == h).all()
    h = np.unique(rng.integers(0, 2**56, 4000).astype(np.uint64))  # one bucket of 250 in a block of a million
    assert len(backoff.pack_sorted(h)) < 6 * len(h)
