"""SimHash near-duplicates by anchor-point covering.

Fingerprints of 64 bits are compared only with those they share an anchor with. The anchors are the words of a
covering code: the bits are cut into blocks, and the code repeats one bit over each block, so an anchor is one bit per
block and the nearest anchor of a fingerprint takes each block's majority. Its covering radius is the sum of the
largest minorities. A fingerprint lives at its nearest anchor and is replicated to every anchor that a fingerprint
within the threshold may live at: those reached by turning over blocks whose majorities need, all together, no more
changed bits than the threshold. Two fingerprints that link therefore always meet where either of them lives.

Equal fingerprints count as one before anything is compared, so a group of copies is one row however large it is.
Within an anchor only a spanning forest of the links is kept; components are then found over all anchors.

Fingerprints estimate a similarity. Where links must have one (``near_copies``), components of fingerprints only propose
pairs, ``BANDS`` keys of ``ROWS`` MinHashes propose the pairs that fingerprints miss, and every link is a pair whose
shingle sets have been compared exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.common import batch, col_or_empty, merge_partitions, mix, query, store, table, unused
from barloom.llm.components import components

SEED = 42
#: Fingerprints for each anchor that blocks of a size may have to hold; beyond, smaller blocks make more anchors.
PER_ANCHOR = 512
SLICE = 1 << 16
TOGETHER = 512
#: A pair of similarity s shares no key with probability (1 - s**ROWS)**BANDS: 3e-8 at 0.8.
BANDS, ROWS = 24, 3
#: Nodes of a block of a key; a cell holds two blocks at most.
CELL = 256
FACTORS = np.random.default_rng(SEED).integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_hashes(text: bytes, words: int) -> np.ndarray:
    """XXH64 of every ``words``-word shingle, repeats included; a shorter text is one shingle, an empty one none."""
    w = text.lower().split()  # bytes: only A-Z change, and only ASCII white space separates
    if not w:
        return np.empty(0, np.uint64)
    joined = b" ".join(w)
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    n = max(1, len(w) - words + 1)
    last = ends[min(words, len(w)) - 1 :].tolist()
    h = xxhash.xxh64_intdigest
    return np.fromiter([h(joined[a:b], SEED) for a, b in zip(starts[:n], last, strict=True)], np.uint64, n)


def fingerprint(hashes: np.ndarray) -> int:
    """A bit is set if it is set in more than half of the hashes."""
    ones = np.zeros(64, np.int64)
    for a in range(0, len(hashes), SLICE):
        bits = np.unpackbits(hashes[a : a + SLICE].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


FP_SCHEMA = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64()), ("fp2", pa.int64())])


def fingerprints(docs: DataFrame, words: int = 3, words2: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, fp2) of every row by its whole text, of shingles of ``words`` and ``words2`` words (zero if None).

    Null text counts as empty, whose fingerprints are zero."""

    def of(texts: list[bytes], words: int | None) -> np.ndarray:
        return np.array([fingerprint(shingle_hashes(t, words)) if words else 0 for t in texts], np.uint64).view(np.int64)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in it:
            texts = [t.encode() for t in rb.column(1).to_pylist()]
            yield batch({"doc_id": rb.column(0), "fp": of(texts, words), "fp2": of(texts, words2)}, FP_SCHEMA)

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), col_or_empty(text_col).alias("text")).mapInArrow(run, "doc_id bigint, fp bigint, fp2 bigint")


def block_masks(bits: int) -> np.ndarray:
    return np.array([((1 << min(bits, 64 - a)) - 1) << a for a in range(0, 64, bits)], np.uint64)


def block_bits(fingerprints: int) -> int:
    """The largest blocks, of 5 bits to 2, that leave few fingerprints for each anchor. Any size gives the same links."""
    return next((bits for bits in (5, 4, 3) if fingerprints <= PER_ANCHOR << len(block_masks(bits))), 2)


def anchors(fp: np.ndarray, distance: int, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, anchor, lives there) of each fingerprint and each anchor it is replicated to."""
    masks = block_masks(bits)
    ones = np.bitwise_count(fp[:, None] & masks).astype(np.int64)
    need = np.array([int(m).bit_count() // 2 + 1 for m in masks])  # ones that make a block a one
    up = ones >= need
    cost = np.where(up, ones - need + 1, need - ones)
    home = (up.astype(np.int64) << np.arange(len(masks))).sum(axis=1)
    rows, found, lives = [np.arange(len(fp))], [home], [np.ones(len(fp), bool)]
    for k in range(1, distance + 1):
        for turned in combinations(range(len(masks)), k):
            at = np.flatnonzero(cost[:, turned].sum(axis=1) <= distance)
            rows.append(at)
            found.append(home[at] ^ sum(1 << b for b in turned))
            lives.append(np.zeros(len(at), bool))
    return np.concatenate(rows), np.concatenate(found), np.concatenate(lives)


def forest(fp: np.ndarray, fp2: np.ndarray, node: np.ndarray, lives: np.ndarray, distance: int, distance2: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest, as (node, smaller node), of the links between those that live here and all others here."""
    order = np.argsort(node, kind="stable")
    fp, fp2, node, lives = fp[order], fp2[order], node[order], lives[order]
    here = np.flatnonzero(lives)
    label = np.arange(len(fp))
    step = max(1, (1 << 20) // max(1, len(fp)))
    for a in range(0, len(here), step):
        i, j = np.nonzero(np.bitwise_count(fp[here[a : a + step], None] ^ fp[None, :]) <= distance)
        i = here[a : a + step][i]
        linked = (i != j) & (np.bitwise_count(fp2[i] ^ fp2[j]) <= distance2)
        i, j = i[linked], j[linked]
        while len(i):  # unite the ends of the new links
            low = np.minimum(label[i], label[j])
            np.minimum.at(label, label[i], low)
            np.minimum.at(label, label[j], low)
            while (label[label] != label).any():
                label = label[label]
            open_ = label[i] != label[j]
            i, j = i[open_], j[open_]
    child = np.flatnonzero(node[label] != node)
    return node[child], node[label[child]]


ANCHOR_SCHEMA = pa.schema([("anchor", pa.int64()), ("fp", pa.int64()), ("fp2", pa.int64()), ("node", pa.int64()), ("lives", pa.bool_())])
EDGE_SCHEMA = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def links(distinct: DataFrame, distance: int, distance2: int = 64, bits: int = 5) -> DataFrame:
    """Edges (u, v), up to connectivity, between nodes that differ in at most ``distance`` bits of ``fp`` and
    ``distance2`` bits of ``fp2``.

    ``distinct`` has one row (fp, fp2, node) for each pair of fingerprints. Anchors arrive sorted and are compared one
    after another, in blocks of bounded size; small ones are compared together, which costs less than a call for each.
    """

    def spread(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in it:
            fp, fp2, node = (rb.column(k).to_numpy() for k in range(3))
            for a in range(0, len(fp), 2048):
                row, anchor, lives = anchors(fp[a : a + 2048].view(np.uint64), distance, bits)
                row += a
                yield batch({"anchor": anchor, "fp": fp[row], "fp2": fp2[row], "node": node[row], "lives": lives}, ANCHOR_SCHEMA)

    def compare(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # whole anchors and the part of the one that the last batch ended in

        def joined() -> pa.RecordBatch:
            fp, fp2, node, lives = (np.concatenate([h[k] for h in held]) for k in (1, 2, 3, 4))
            u, v = forest(fp.view(np.uint64), fp2.view(np.uint64), node, lives, distance, distance2)
            return batch({"u": u, "v": v}, EDGE_SCHEMA)

        for rb in it:
            anchor, fp, fp2, node = (rb.column(k).to_numpy() for k in range(4))
            lives = rb.column(4).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(anchor[1:] != anchor[:-1]) + 1).tolist(), len(anchor)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                if held and held[-1][0] != anchor[a] and sum(len(h[1]) for h in held) >= TOGETHER:
                    yield joined()
                    held = []
                held.append((anchor[a], fp[a:b], fp2[a:b], node[a:b], lives[a:b]))
        if held:
            yield joined()

    n = merge_partitions(distinct.sparkSession)
    placed = distinct.select("fp", "fp2", "node").repartition(n).mapInArrow(spread, "anchor bigint, fp bigint, fp2 bigint, node bigint, lives boolean")
    return placed.repartition(n, "anchor").sortWithinPartitions("anchor").mapInArrow(compare, "u bigint, v bigint")


def band_keys(shingles: np.ndarray) -> np.ndarray:
    """The keys of a set of shingle hashes that is not empty, one for each band."""
    low = np.full(len(FACTORS), ~np.uint64(0))
    for a in range(0, len(shingles), 2048):
        np.minimum(low, (shingles[None, a : a + 2048] * FACTORS[:, None]).min(axis=1), out=low)
    keys = np.arange(BANDS, dtype=np.uint64)
    for k in range(ROWS):
        keys = mix(keys + low[k::ROWS])
    return keys


PROFILE_SCHEMA = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("fp", pa.int64()), ("fp2", pa.int64()), ("node", pa.int64()), ("n", pa.int64()), ("keys", pa.list_(pa.int64()))])


def profiles(docs: DataFrame, words: int, words2: int) -> DataFrame:
    """Of every row of (doc_id, text_hash, text): both fingerprints, and hash, size and band keys of its set of
    ``words2``-word shingles."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in it:
            fp, fp2, node, n, keys = [], [], [], [], []
            for t in rb.column(2).to_pylist():
                raw = t.encode()
                all_ = shingle_hashes(raw, words2)
                own = np.unique(all_)
                fp.append(fingerprint(shingle_hashes(raw, words)))
                fp2.append(fingerprint(all_))
                node.append(xxhash.xxh64_intdigest(own.astype("<u8").tobytes(), SEED))
                n.append(len(own))
                keys.append(band_keys(own).view(np.int64) if len(own) else [])
            made = {k: np.array(v, np.uint64).view(np.int64) for k, v in (("fp", fp), ("fp2", fp2), ("node", node))}
            yield batch({"doc_id": rb.column(0), "text_hash": rb.column(1), **made, "n": n, "keys": keys}, PROFILE_SCHEMA)

    return docs.select("doc_id", "text_hash", "text").mapInArrow(run, "doc_id bigint, text_hash bigint, fp bigint, fp2 bigint, node bigint, n bigint, keys array<bigint>")


def confirmed(pairs: DataFrame, texts: DataFrame, words: int, similar: float) -> DataFrame:
    """Those of the pairs (u, v) whose sets of ``words``-word shingles have a Jaccard similarity of ``similar`` or more.

    ``texts`` has one (node, text) for each node."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple = (None, None)
        for rb in it:
            u, v = rb.column(0).to_pylist(), rb.column(1).to_pylist()
            linked = np.zeros(len(u), bool)
            for i, (at, a, b) in enumerate(zip(v, rb.column(2), rb.column(3), strict=True)):
                if last[0] != at:
                    last = (at, np.unique(shingle_hashes(b.as_py().encode(), words)))
                own = np.unique(shingle_hashes(a.as_py().encode(), words))
                both = len(np.intersect1d(own, last[1], assume_unique=True))
                linked[i] = both >= similar * (len(own) + len(last[1]) - both)
            at = np.flatnonzero(linked)
            yield batch({"u": np.array(u, np.int64)[at], "v": np.array(v, np.int64)[at]}, EDGE_SCHEMA)

    a, b = (texts.select(F.col("node").alias(k), F.col("text").alias(f"text_{k}")) for k in "uv")
    return pairs.join(a, "u").join(b, "v").select("u", "v", "text_u", "text_v").mapInArrow(run, "u bigint, v bigint")


def cell_links(key: int, block: np.ndarray, node: np.ndarray, label: np.ndarray, keys: np.ndarray, sets: list[np.ndarray], similar: float) -> tuple[list[int], list[int]]:
    """Links, up to connectivity, between nodes of one cell that are not connected; see ``open_links``."""
    n = np.array([len(x) for x in sets])
    mixed = block.min() != block.max()
    order = np.arange(len(node))
    pairs: list[tuple[int, int]] = []
    for i in range(len(node) - 1):
        j = order[i + 1 :]
        j = j[(label[j] != label[i]) & (np.minimum(n[i], n[j]) >= similar * np.maximum(n[i], n[j]))]
        j = j[block[j] != block[i]] if mixed else j
        if len(j):
            shared = keys[j] == keys[i]
            mine = keys[i][shared.argmax(axis=1)] == key  # a pair that shares several keys is compared at the first of them
            pairs += [(i, k) for k in j[mine].tolist()]
    names, at = np.unique(label, return_inverse=True)
    root = list(range(len(names)))

    def find(a: int) -> int:
        while root[a] != a:
            root[a] = root[root[a]]
            a = root[a]
        return a

    u, v = [], []
    for a, b in pairs:
        x, y = find(int(at[a])), find(int(at[b]))
        if x != y:
            both = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
            if both >= similar * (n[a] + n[b] - both):
                root[x] = y
                u.append(max(int(node[a]), int(node[b])))
                v.append(min(int(node[a]), int(node[b])))
    return u, v


SET_SCHEMA = pa.schema([("node", pa.int64()), ("keys", pa.list_(pa.int64())), ("set", pa.binary())])


def open_links(labelled: DataFrame, texts: DataFrame, words: int, similar: float) -> DataFrame:
    """Edges (u, v) between nodes that share a key, have different labels and are similar, up to connectivity.

    ``labelled`` has (key, node, label). The nodes of a key are cut into blocks of about ``CELL`` by hash, and each node
    goes with its shingle set to every cell, a pair of blocks of the key. A cell's pairs are compared where they lie, so
    only links are rows, and a key of many nodes is many cells of bounded size.
    """

    def profile(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in it:
            for node, text in zip(rb.column(0).to_pylist(), rb.column(1).to_pylist(), strict=True):
                own = np.unique(shingle_hashes(text.encode(), words))
                yield batch({"node": [node], "keys": [band_keys(own).view(np.int64)], "set": [own.astype("<u8").tobytes()]}, SET_SCHEMA)

    def compare(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held = None, []

        def linked() -> pa.RecordBatch:
            block, node, label = (np.array([h[k] for h in held], np.int64) for k in range(3))
            sets = [np.frombuffer(h[4], "<u8") for h in held]
            u, v = cell_links(cell[0], block, node, label, np.array([h[3] for h in held], np.int64), sets, similar)
            return batch({"u": u, "v": v}, EDGE_SCHEMA)

        for rb in it:
            for row in zip(*(rb.column(k) for k in range(8)), strict=True):
                key, x, y, *rest = (value.as_py() for value in row)
                if (key, x, y) != cell:
                    if held:
                        yield linked()
                    cell, held = (key, x, y), []
                held.append(rest)
        if held:
            yield linked()

    mixed = labelled.groupBy("key").agg(F.min("label").alias("a"), F.max("label").alias("b"), F.ceil(F.count("*") / CELL).cast("int").alias("blocks")).where("a <> b").select("key", "blocks")
    open_ = store(labelled.join(mixed, "key").select("key", "node", "label", "blocks"))
    sets = store(texts.join(open_.select("node").distinct(), "node").select("node", "text").mapInArrow(profile, "node bigint, keys array<bigint>, set binary"))
    placed = open_.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = placed.select("key", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "block", "node", "label")
    n = merge_partitions(labelled.sparkSession)
    rows = cells.join(sets, "node").select("key", "x", "y", "block", "node", "label", "keys", "set")
    return rows.repartition(n, "key", "x", "y").sortWithinPartitions("key", "x", "y").mapInArrow(compare, "u bigint, v bigint").distinct()


def near_copies(docs: DataFrame, words: int, distance: int, words2: int, distance2: int, similar: float) -> DataFrame:
    """(doc_id, text_hash, fp, first) of every row of (doc_id, text_hash, text); ``first`` is the (doc_id, text_hash)
    that is smallest in the row's component.

    A link is a pair of rows whose sets of ``words2``-word shingles have a Jaccard similarity of ``similar`` or more.
    Rows of equal sets are one node. First every node is compared with the smallest of its component by fingerprints
    (see ``near_duplicates``) and with the smallest node that shares one of its band keys, so a large group of copies
    takes as many comparisons as it has members; then nodes that share a key and are not connected yet are compared where
    they meet (see ``open_links``).
    """
    marked = store(profiles(docs, words, words2))
    by_doc = F.struct("doc_id", "text_hash")
    nodes = store(marked.groupBy("node").agg(F.min(by_doc).alias("row"), F.min(F.struct("fp", "fp2")).alias("f"), F.first("n").alias("n"), F.first("keys").alias("keys")))
    distinct = nodes.groupBy("f.fp", "f.fp2").agg(F.min("node").alias("node"))
    held = distinct.withColumnRenamed("node", "one")
    by_print = components(links(distinct, distance, distance2, block_bits(distinct.count()))).withColumnRenamed("node", "one")
    proposed = nodes.select("node", F.col("f.fp").alias("fp"), F.col("f.fp2").alias("fp2")).join(held, ["fp", "fp2"]).join(by_print, "one", "left").select("node", F.coalesce("component", "one").alias("hub"))

    fits = lambda a, b: F.least(a, b) >= similar * F.greatest(a, b)
    keyed = nodes.select("node", "n", F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("held"), F.min(F.struct("node", "n")).alias("hub")).where("held > 1").drop("held")
    members = store(keyed.join(shared, "key"))
    hubs = members.where(fits(F.col("n"), F.col("hub.n"))).select("node", F.col("hub.node").alias("hub"))
    pairs = store(hubs.union(proposed).where("node <> hub").select(F.greatest("node", "hub").alias("u"), F.least("node", "hub").alias("v")).distinct())

    wanted = members.select("node").union(pairs.select("u")).union(pairs.select("v")).distinct()
    rows = nodes.join(wanted, "node").select("node", "row.doc_id", "row.text_hash")
    texts = store(docs.join(rows, ["doc_id", "text_hash"]).select("node", "text").dropDuplicates(["node"]))
    edges = store(confirmed(pairs, texts, words2, similar))

    labels = components(edges).select("node", F.col("component").alias("label"))
    labelled = members.join(labels, "node", "left").select("key", "node", F.coalesce("label", "node").alias("label"))
    more = store(open_links(labelled, texts, words2, similar))

    found = nodes.select("node", "row").join(components(edges.union(more)), "node", "left").select("node", "row", F.coalesce("component", "node").alias("component"))
    first = found.groupBy("component").agg(F.min("row").alias("first"))
    return marked.select("doc_id", "text_hash", "fp", "node").join(found.select("node", "component").join(first, "component"), "node").select("doc_id", "text_hash", "fp", "first")


def _hashed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), col_or_empty(text_col).alias("text"))


def near_duplicates(docs: DataFrame, words: int = 3, distance: int = 2, words2: int | None = None, distance2: int = 64, id_col: str = "doc_id", text_col: str = "text", similar: float | None = None) -> DataFrame:
    """(doc_id, fp, component_id) of every row; the component is its smallest doc_id.

    Links need ``distance`` bits in the fingerprints of ``words``-word shingles and, with ``words2``, ``distance2`` bits
    in those of ``words2``-word shingles too. With ``similar`` they are the links of ``near_copies`` instead, and rows
    with a null id are left out. Null texts count as empty; empty texts share fingerprint zero and link like any others.
    Repeated rows share a component. A null id stays null and names no component, unless no other id
    is there. An empty table gives no rows; extra columns are not read.
    """
    if similar is not None:
        hashed = _hashed(docs, id_col, text_col)
        named = near_copies(hashed.where(F.col("doc_id").isNotNull()), words, distance, words2, distance2, similar)
        return named.select("doc_id", "fp", F.col("first.doc_id").alias("component_id"))
    marked = store(fingerprints(docs, words, words2, id_col, text_col))
    distinct = store(marked.groupBy("fp", "fp2").agg(F.min("doc_id").alias("node")))
    bits = block_bits(distinct.count())
    found = components(links(distinct.where(F.col("node").isNotNull()), distance, distance2, bits)).withColumnRenamed("node", "_node")
    component = distinct.join(found, F.col("node") == F.col("_node"), "left").select("fp", "fp2", F.coalesce("component", "node").alias("component_id"))
    return marked.join(component, ["fp", "fp2"]).select("doc_id", "fp", "component_id")


#: Near copies have a five-word similarity of 0.8 or more. Fingerprints within these distances propose pairs only.
STAGE = {"words": 1, "distance": 3, "words2": 5, "distance2": 12, "similar": 0.8}


def keep_first(docs: DataFrame, **links) -> DataFrame:
    """``docs`` with one row for each component of near copies: that of the smallest doc_id. Rows with a null id stay.

    Copies are told by exact five-word similarity (see ``near_copies``). Rows are known by doc_id and text: of rows of
    one id and unrelated texts all stay.
    """
    name = unused("text_hash", docs)
    docs_ = docs.withColumn(name, F.xxhash64("text"))
    found = near_copies(_hashed(docs.where(F.col("doc_id").isNotNull()), "doc_id", "text"), **{**STAGE, **links})
    gone = found.where((F.col("doc_id") != F.col("first.doc_id")) | (F.col("text_hash") != F.col("first.text_hash"))).select("doc_id", F.col("text_hash").alias(name)).distinct()
    kept = docs_.join(gone, ["doc_id", name], "left_anti")
    return kept.where(F.col("doc_id").isNotNull()).dropDuplicates(["doc_id", name]).unionByName(kept.where(F.col("doc_id").isNull())).select(docs.columns)


@query("op7_simhash")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
