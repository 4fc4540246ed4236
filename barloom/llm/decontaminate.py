"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

Test items are partitioned by their number of distinct five-word shingles (powers of two). An item is indexed by the
bottom of its MinHash order: the k shingles of smallest hash, with k one more than the number of shingles that may be
missing at the threshold. A document that contains enough of the item holds one of these for certain, so the search
loses nothing however long the document is, unlike a comparison of whole signatures. A document probes only partitions
whose items are small enough to lie inside it. Each (document, item) found so is verified on the shingles themselves.

The index of a block of items (at most ``BLOCK_CHARS`` characters of text, save for a single longer one in each of a
few classes) is sent to all tasks; documents are read once for each block and never shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.llm.common import batch, blocks, col_or_empty, mix, query, table

WORDS = 5
THRESHOLD = 0.8
BLOCK_CHARS = 16 << 20
CLASSES = 16
TEXT_BLOCK = 1 << 21
#: ASCII other than letters and digits separates words.
SEPARATE = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in range(256))


def words_of(text: str) -> list[bytes]:
    return text.lower().encode("utf-8", "replace").translate(SEPARATE).split()


def shingles(words: list[bytes], n: int = WORDS) -> set[bytes]:
    """Distinct shingles; the whole sequence if it is shorter, none if it is empty."""
    if not words:
        return set()
    return {b" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))}


class WordHashes:
    """Hashes of words, kept while a task lasts."""

    def __init__(self, limit: int = 500_000):
        self.limit = limit
        self.known: dict[bytes, int] = {}

    def of(self, words: list[bytes]) -> np.ndarray:
        got = list(map(self.known.get, words))
        if None in got:
            if len(self.known) > self.limit:
                self.known = {}
            new = {w: xxhash.xxh64_intdigest(w) for w, h in zip(words, got, strict=True) if h is None}
            self.known |= new
            got = [new[w] if h is None else h for w, h in zip(words, got, strict=True)]
        return np.array(got, np.uint64)


def shingle_hashes(owner: np.ndarray, words: np.ndarray, n: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(owner, hash) of the shingles of texts laid end to end; a shorter text is one shingle."""
    if not len(words):
        return owner, words
    count = np.bincount(owner)
    start = np.cumsum(count) - count
    left = count[owner] - (np.arange(len(words)) - start[owner])  # words from here to the end of the text
    first = left == count[owner]
    h = words.copy()
    for k in range(1, n):
        follow = np.append(words[k:], np.zeros(min(k, len(words)), np.uint64))[: len(words)]
        h = np.where(left > k, mix(h) + follow, h)
    at = (left >= n) | first
    return owner[at], mix(h[at])


class Index:
    """Bottom-k sketches of items, by size partition."""

    def __init__(self, items: list[tuple[int, str]], threshold: float, n: int = WORDS):
        self.threshold, self.n = threshold, n
        self.sets: list[tuple[int, set[bytes]]] = []
        hashes = WordHashes()
        found: dict[int, list[tuple[int, int]]] = {}  # by size partition: (hash, item)
        self.least: dict[int, int] = {}
        for item_id, text in items:
            words = words_of(text)
            if not words:
                continue
            w = hashes.of(words)
            h = np.unique(shingle_hashes(np.zeros(len(w), np.int64), w, n)[1])
            must = math.ceil(threshold * len(h) - 1e-9)
            size = len(h).bit_length()
            self.least[size] = min(self.least.get(size, must), must)
            found.setdefault(size, []).extend((x, len(self.sets)) for x in h[: len(h) - must + 1].tolist())
            self.sets.append((item_id, shingles(words, n)))
        self.parts = {}
        for size, pairs in found.items():
            h, item = np.array([p[0] for p in pairs], np.uint64), np.array([p[1] for p in pairs], np.int64)
            order = np.argsort(h, kind="stable")
            low = np.zeros(1 << 20, bool)
            low[(h & np.uint64(0xFFFFF)).astype(np.int64)] = True
            self.parts[size] = (h[order], item[order], low)

    def matches(self, texts: list[str], hashes: WordHashes) -> list[tuple[int, int, int, int]]:
        """(row, item id, shingles of the item, shingles found) of every item that a text contains."""
        words = [words_of(t) for t in texts]
        owner = np.repeat(np.arange(len(texts)), [len(w) for w in words])
        owner, h = shingle_hashes(owner, hashes.of([x for w in words for x in w]), self.n)
        held = np.bincount(owner, minlength=len(texts))
        pairs: set[tuple[int, int]] = set()
        for size, (keys, item, low) in self.parts.items():
            at = np.flatnonzero(low[(h & np.uint64(0xFFFFF)).astype(np.int64)] & (held[owner] >= self.least[size]))
            a, b = np.searchsorted(keys, h[at], "left"), np.searchsorted(keys, h[at], "right")
            for row, i, j in zip(owner[at][b > a].tolist(), a[b > a].tolist(), b[b > a].tolist(), strict=True):
                pairs.update((row, k) for k in item[i:j].tolist())
        out, row, mine = [], -1, set()
        for r, k in sorted(pairs):
            if r != row:
                row, mine = r, shingles(words[r], self.n)
            item_id, wanted = self.sets[k]
            n = len(wanted & mine)
            if n >= self.threshold * len(wanted) - 1e-9:
                out.append((r, item_id, len(wanted), n))
        return out


def item_blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> Iterator[list[tuple[int, str]]]:
    """Blocks of items of bounded size, one at a time."""
    items = benchmark.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("item_id"), col_or_empty(text_col).alias("text")).distinct()
    order = Window.partitionBy(F.pmod(F.xxhash64("item_id", "text"), F.lit(CLASSES))).orderBy(F.length("text"), "item_id", "text")
    placed = items.withColumn("block", F.floor(F.sum(F.length("text") + 64).over(order) * CLASSES / BLOCK_CHARS))
    for (block,) in sorted(placed.select("block").distinct().collect()):
        yield [(r.item_id, r.text) for r in placed.where(F.col("block") == block).select("item_id", "text").collect()]


SCHEMA = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("n_shingles", pa.int64()), ("n_found", pa.int64()), ("containment", pa.float64())])
DDL = "doc_id bigint, item_id bigint, n_shingles bigint, n_found bigint, containment double"


def contained_items(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, n_shingles, n_found, containment) of every document and item at or over the threshold.

    Words are runs of letters and digits (any non-ASCII character counts as one of them), lower-cased. A text of fewer
    than five words is one shingle, so a short item is found only as a whole short document; a text without words
    matches nothing. Null texts are empty. Repeated document rows are reported each on their own, items that repeat
    with the same id and text once. Null item ids are skipped. Empty tables give no rows.
    """
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), col_or_empty(text_col).alias("text"))
    out = docs.sparkSession.createDataFrame([], DDL)
    for items in item_blocks(benchmark):
        sent = docs.sparkSession.sparkContext.broadcast(Index(items, threshold))

        def run(it: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            hashes = WordHashes()
            for rb in it:
                texts = rb.column(1).to_pylist()
                for a, b in blocks(texts, TEXT_BLOCK):
                    if found := sent.value.matches(texts[a:b], hashes):
                        row, item, n, k = map(list, zip(*found, strict=True))
                        yield batch({"doc_id": rb.column(0).take(pa.array(row) if a == 0 else pa.array([r + a for r in row])), "item_id": item, "n_shingles": n, "n_found": k, "containment": [y / x for x, y in zip(n, k, strict=True)]}, SCHEMA)

        out = out.unionByName(texts.mapInArrow(run, DDL))
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the documents that contain a benchmark item; same columns, no shuffle."""
    column = docs.columns.index("text")
    for items in item_blocks(benchmark):
        sent = docs.sparkSession.sparkContext.broadcast(Index(items, threshold))

        def run(it: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            hashes = WordHashes()
            for rb in it:
                texts = [t or "" for t in rb.column(column).to_pylist()]
                for a, b in blocks(texts, TEXT_BLOCK):
                    keep = np.ones(b - a, bool)
                    keep[[r for r, *_ in sent.value.matches(texts[a:b], hashes)]] = False
                    yield rb.slice(a, b - a).filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id AS id, regexp_extract_all(lower(coalesce(text, '')), '[^\x00-/:-@\[-`{-\x7f]+') AS w FROM documents),
b AS (SELECT DISTINCT item_id AS id, regexp_extract_all(lower(coalesce(text, '')), '[^\x00-/:-@\[-`{-\x7f]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
ds AS (SELECT DISTINCT r, id, s FROM (SELECT r, id, unnest(list_transform(generate_series(1, greatest(len(w) - 4, 1)), lambda i: array_to_string(w[i:i + 4], ' '))) AS s FROM d WHERE len(w) > 0)),
bs AS (SELECT DISTINCT id, s FROM (SELECT id, unnest(list_transform(generate_series(1, greatest(len(w) - 4, 1)), lambda i: array_to_string(w[i:i + 4], ' '))) AS s FROM b WHERE len(w) > 0)),
n AS (SELECT id, count(*) AS n FROM bs GROUP BY id),
f AS (SELECT ds.r, any_value(ds.id) AS doc_id, bs.id AS item_id, count(*) AS k FROM ds JOIN bs USING (s) GROUP BY ds.r, bs.id)
SELECT doc_id, item_id, n AS n_shingles, k AS n_found, k / n AS containment FROM f JOIN n ON n.id = f.item_id WHERE k >= 0.8 * n - 1e-9
"""


@query("op8_decontamination", SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
