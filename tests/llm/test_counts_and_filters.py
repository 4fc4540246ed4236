"""Token counts, URL filter, packing, toxicity: against the libraries and plain restatements of the rules."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from barloom.llm import packing, token_counts, toxicity, url_filter

ODD = ["'", "'s", "'re", "'ve", "'ll", "'r", "r", "e", " ", "  ", "\n", "\t", "a", "B", "é", "1", "22", ".", "!", "<|endoftext|>", "<|ENDOFTEXT|>", "<|endof", "́", "Σ", "ς", "İ", "\x85", "\xa0", "\x1c", "\x00", "中", "½", "　", " '", "​", " \n"]


def odd_texts(n: int) -> list[str]:
    pick = random.Random(7)
    return ["".join(pick.choice(ODD) for _ in range(pick.randint(0, 30))) for _ in range(n)] + ["ab" * 20_000, " *" * 5_000, "\n" * 500 + "x", "x'll" * 9_000]


def frame(spark, texts, ids=None):
    """Documents with extra columns whose names clash with those used inside."""
    rows = [(i, t, "x", 1) for i, t in zip(ids or range(len(texts)), texts, strict=True)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, gone string, start int").repartition(3)


def test_token_counts_equal_the_library(spark):
    texts = [*odd_texts(800), None, "", None, "same", "same"]
    path = public_tokenizers.path("word_bpe_49k.json")
    got = {r.doc_id: r for r in token_counts.token_counts(frame(spark, texts), path).collect()}
    want = [len(e.ids) for e in Tokenizer.from_file(path).encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert [got[i].n_tokens for i in range(len(texts))] == want
    assert [got[i].n_bytes for i in range(len(texts))] == [len((t or "").encode()) for t in texts]
    assert token_counts.token_counts(frame(spark, texts).limit(0), path).count() == 0


def test_splitter_states_compose():
    """A row's entry state by the prefix scan is the state of the automaton run from the first character."""
    nxt, _ = token_counts.compile_splitter()
    cls = np.random.default_rng(1).integers(0, 11, (50, 16)).astype(np.uint8)
    state, want = token_counts.BETWEEN, []
    for row in cls:
        want.append(state)
        for c in row:
            state = nxt[state, c]
    assert token_counts.entry_states(cls, nxt).tolist() == want


def test_packing_is_a_partition_of_all_ids(spark):
    texts = [*odd_texts(300), None, "", "word " * 30_000, "same text", "same text"]
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = packing.pack(frame(spark, texts), path).toPandas()
    want = [e.ids + [1] for e in Tokenizer.from_file(path).encode_batch([t or "" for t in texts], add_special_tokens=False)]
    for doc, pieces in rows.groupby("doc_id"):
        pieces = pieces.sort_values("start")
        assert pieces.start.tolist() == [0, *pieces.length.cumsum().tolist()[:-1]]
        assert [x for ids in pieces.ids for x in ids] == want[doc]
        assert (pieces.doc_tokens == len(want[doc])).all()
        assert all(zlib.crc32(np.array(i, "<u4").tobytes()) == c for i, c in zip(pieces.ids, pieces.ids_crc32, strict=True))
    assert rows.doc_id.nunique() == len(texts)
    for _, s in rows.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert s.offset.tolist() == [0, *s.length.cumsum().tolist()[:-1]] and s.length.sum() <= 2048
    used = rows.groupby("sequence_id").length.sum()
    padding = used.map(lambda n: 0 if n & (n - 1) == 0 else 2048 - n).sum()
    assert padding < 2048 * 3  # one window for each task
    steps = rows.drop_duplicates("sequence_id").groupby("step_id").tier.agg(["sum", "nunique"])
    assert (steps["sum"] <= packing.STEP_TOKENS).all() and (steps["nunique"] == 1).all()
    assert (steps["sum"] < packing.STEP_TOKENS).sum() <= 3 * (len(packing.TIERS) + 1)  # the last of each tier and task
    assert packing.pack(frame(spark, texts).limit(0), path).count() == 0


def plain_rule(url, rules, default="allow"):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if c.isascii() else c for c in rest[:cut])
    path = rest[cut:]
    path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fits = [(len(h + p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[1:] if fits else (None, default)))


def test_url_rules(spark, monkeypatch):
    urls = [None, "", "no scheme", "http://", "http://ORG", "http://a.org/", "https://www.Example.org/es/1?x#y", "https://example.org/en/12", "https://example.org/en/2", "http://notexample.org/es/",
            "ftp://x.com/fr/", "http://com/de/", "http://x.com/de", "http://x.com?/de/", "http://x.com#/fr/", "http://ÄB.com/fr/é", "http://a.b.c.com/de/..//", "http://a.org/" + "p" * 50_000, "a://b://org/"]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)] + [(5, "http://a.org/", "h")], "page_id bigint, url string, rule string")
    want = sorted([(i, *plain_rule(u, url_filter.RULES)) for i, u in enumerate(urls)] + [(5, *plain_rule("http://a.org/", url_filter.RULES))], key=str)
    assert sorted(map(tuple, url_filter.filter_urls(pages, url_filter.RULES).collect()), key=str) == want
    monkeypatch.setattr(url_filter, "MAX_RULES", 2)  # several digest files
    assert sorted(map(tuple, url_filter.filter_urls(pages, url_filter.RULES).collect()), key=str) == want
    assert {r.verdict for r in url_filter.filter_urls(pages, []).collect()} == {"allow"}
    assert url_filter.filter_urls(pages.limit(0), url_filter.RULES).count() == 0


def test_equal_digests_are_told_apart(tmp_path, monkeypatch):
    monkeypatch.setattr(url_filter.xxhash, "xxh64_intdigest", lambda key: 7)
    url_filter.write_digests(url_filter.RULES, str(tmp_path / "d"))
    digests = url_filter.DigestArray(str(tmp_path / "d"))
    found = digests.probe([b"org/", b"com/de/", b"net/"])
    assert found[2] == -1 and found[0] != found[1] and digests.allow[found].tolist()[:2] == [1, 0]


def toxic_fixture(n):
    pick = random.Random(5)
    words = ["w%d" % i for i in range(300)]
    rows, labels = [], []
    for i in range(n):
        text = [pick.choice(words) for _ in range(pick.randint(5, 60))]
        bad = pick.random() < 0.2
        for _ in range(3 if bad else 0):
            text.insert(pick.randint(0, len(text)), pick.choice(["foulone", "fultwo", "vilest"]))
        rows.append(" ".join(text))
        labels.append((i, 0, int(bad)))
    return rows, labels


def test_toxicity_held_out_accuracy_and_odd_rows(spark):
    texts, labels = toxic_fixture(1500)
    marked = spark.createDataFrame([*labels, (None, 1, 1), (3, 1, None), (4, *labels[4][1:])], "doc_id bigint, quality int, toxic int")
    docs = frame(spark, [*texts, None, "", "foulone " * 60_000], [*range(1500), 9001, 9002, 9003])
    model = toxicity.train(docs, marked.where(~toxicity.held_out()))
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    held = [(got[i], y) for i, _, y in labels if zlib.crc32(str(i).encode()) % 4 == 2]
    assert np.mean([(s >= 0.3) == y for s, y in held]) > 0.97
    assert got[9001] == got[9002] < 0.3 and got[9003] > 0.3
    assert len(model.features) < 2000  # L1 leaves few weights
    kept = toxicity.reject_toxic(docs, marked)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, s in got.items() if s < 0.3}
    empty = toxicity.train(docs, marked.limit(0))
    assert [r.score < 0.3 for r in toxicity.score(docs.limit(5), empty).collect()] == [True] * 5
    assert toxicity.score(docs.limit(0), model).count() == 0


@pytest.mark.parametrize("n", [1, 7, 500])
def test_blocks_cover_all(n):
    from barloom.llm.common import blocks

    texts = [None if i % 5 == 0 else "x" * (i % 9) for i in range(n)]
    runs = list(blocks(texts, 20))
    assert [i for a, b in runs for i in range(a, b)] == list(range(n))
