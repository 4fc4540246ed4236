"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are present or absent: words, their four- and five-letter stems, bigrams, and pairs of words one or
two words apart, each hashed to 64 bits. Coordinates have their own learning rates; the L1 term leaves only a few
weights other than zero, which are small enough to send to every task.

Training reads at most ``max_rows`` labelled documents (the bound of the sample, chosen by a hash of the id) in one
task; everything else covers whole texts of all documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.common import batch, blocks, col_or_empty, mix, query, table

MAX_ROWS = 6_144
THRESHOLD = 0.3
BLOCK = 1 << 21
#: ASCII other than letters and digits separates words.
SEPARATE = bytes(b if chr(b).isalnum() or b > 127 else 32 for b in range(256))
SALTS = [np.uint64(0x9E3779B97F4A7C15 * k % 2**64) for k in range(1, 7)]


class Features:
    """Hashed features of texts; words are hashed once per task."""

    def __init__(self, limit: int = 500_000):
        self.limit = limit
        self.clear()

    def clear(self) -> None:
        self.index: dict[bytes, int] = {}
        self.hashes = np.empty((0, 3), np.uint64)

    def words(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(row of each word, its place in ``hashes``)."""
        split = [t.lower().encode("utf-8", "replace").translate(SEPARATE).split() for t in texts]
        flat = [w for ws in split for w in ws]
        if len(self.index) > self.limit:
            self.clear()
        at = list(map(self.index.get, flat))
        if None in at:
            new = list(dict.fromkeys(w for w, k in zip(flat, at, strict=True) if k is None))
            rows = np.empty((len(new), 3), np.uint64)
            for i, w in enumerate(new):
                s = w.decode("utf-8", "replace")
                rows[i] = (xxhash.xxh64_intdigest(w), xxhash.xxh64_intdigest(s[:4]), xxhash.xxh64_intdigest(s[:5]))
            self.index.update(zip(new, range(len(self.hashes), len(self.hashes) + len(new)), strict=True))
            self.hashes = np.concatenate([self.hashes, rows])
            at = list(map(self.index.__getitem__, flat))
        owner = np.repeat(np.arange(len(texts)), [len(ws) for ws in split])
        return owner, np.array(at, np.int64)

    def of(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(row, feature) arrays, one pair for each kind of feature; repeats included."""
        owner, at = self.words(texts)
        word = self.hashes[at, 0]
        yield owner, mix(word ^ SALTS[0])
        yield owner, mix(self.hashes[at, 1] ^ SALTS[1])
        yield owner, mix(self.hashes[at, 2] ^ SALTS[2])
        yield self._pairs(owner, word, 1, SALTS[3])
        yield self._pairs(owner, word, 2, SALTS[4])
        yield self._pairs(owner, word, 3, SALTS[5])

    @staticmethod
    def _pairs(owner: np.ndarray, word: np.ndarray, gap: int, salt: np.uint64) -> tuple[np.ndarray, np.ndarray]:
        if len(word) <= gap:
            return owner[:0], word[:0]
        inside = owner[:-gap] == owner[gap:]
        return owner[:-gap][inside], mix(mix(word[:-gap][inside] ^ salt) + word[gap:][inside])


def ftrl(rows: list[np.ndarray], labels: np.ndarray, size: int, *, alpha: float, beta: float, l1: float, l2: float, epochs: int, bias: float) -> tuple[np.ndarray, float]:
    """Weights and intercept of FTRL-proximal with per-coordinate rates; ``rows`` hold the coordinates present."""
    z, n = np.zeros(size), np.zeros(size)
    bias_n = 1.0
    order = np.arange(len(rows))
    for epoch in range(epochs):
        np.random.default_rng(epoch).shuffle(order)
        for i in order:
            at = rows[i]
            za, na = z[at], n[at]
            root = np.sqrt(na)
            w = np.where(np.abs(za) <= l1, 0.0, -(za - np.sign(za) * l1) / ((beta + root) / alpha + l2))
            p = 1.0 / (1.0 + np.exp(-np.clip(bias + w.sum(), -30, 30)))
            g = p - labels[i]
            z[at] += g - (np.sqrt(na + g * g) - root) / alpha * w
            n[at] += g * g
            bias_n += g * g
            bias -= alpha * g / np.sqrt(bias_n)
    w = np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))
    return w, bias


@dataclass(frozen=True)
class Model:
    """Sparse weights, sorted by feature."""

    features: np.ndarray
    weights: np.ndarray
    bias: float

    def score(self, texts: list[str], made: Features) -> np.ndarray:
        total = np.full(len(texts), self.bias)
        if len(self.features):
            low = np.zeros(1 << 20, bool)
            low[(self.features & np.uint64(0xFFFFF)).astype(np.int64)] = True
            for owner, f in made.of(texts):
                maybe = low[(f & np.uint64(0xFFFFF)).astype(np.int64)]
                owner, f = owner[maybe], f[maybe]
                at = np.searchsorted(self.features, f)
                hit = (at < len(self.features)) & (self.features[np.minimum(at, len(self.features) - 1)] == f)
                once = np.unique(owner[hit] * len(self.features) + at[hit])
                total += np.bincount(once // len(self.features), self.weights[once % len(self.features)], len(texts))
        return 1.0 / (1.0 + np.exp(-np.clip(total, -30, 30)))


def unique_features(texts: list[str], made: Features) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, feature) pairs, by row."""
    parts = list(made.of(texts))
    rows = np.arange(len(texts) + 1)
    cuts = [np.searchsorted(owner, rows) for owner, _ in parts]
    found = [np.unique(np.concatenate([f[c[i] : c[i + 1]] for c, (_, f) in zip(cuts, parts, strict=True)])) for i in range(len(texts))]
    return np.repeat(rows[:-1], [len(f) for f in found]), np.concatenate(found)


def fit_texts(texts: list[str], y: np.ndarray, *, min_docs: int = 4, alpha: float = 0.5, beta: float = 1.0, l1: float = 5.0, l2: float = 0.1, epochs: int = 4) -> tuple[np.ndarray, np.ndarray, float]:
    """(features, weights, intercept). Features of fewer than ``min_docs`` documents are left out: they can't be told
    from all else in those documents. A first pass counts features in hash buckets so that a second one keeps few."""
    mask = np.uint64((1 << 25) - 1)
    slots = np.zeros(1 << 25, np.uint8)
    runs, made = list(blocks(texts, BLOCK // 4)), Features()
    for a, b in runs:
        at, n = np.unique(unique_features(texts[a:b], made)[1] & mask, return_counts=True)
        slots[at] = np.minimum(slots[at] + n, 250)
    owners, found = [], []
    for a, b in runs:
        owner, f = unique_features(texts[a:b], made)
        often = slots[f & mask] >= min_docs
        owners.append((owner[often] + a).astype(np.int32))
        found.append(f[often])
    owner = np.concatenate(owners)
    values, inverse, counts = np.unique(np.concatenate(found), return_inverse=True, return_counts=True)
    keep = counts >= min_docs
    place = np.where(keep, np.cumsum(keep) - 1, -1)[inverse]
    owner, place = owner[place >= 0], place[place >= 0]
    rows = np.split(place, np.searchsorted(owner, np.arange(1, len(texts))))
    prior = (y.sum() + 1) / (len(y) + 20)
    w, bias = ftrl(rows, y, int(keep.sum()), alpha=alpha, beta=beta, l1=l1, l2=l2, epochs=epochs, bias=float(np.log(prior / (1 - prior))))
    kept = np.flatnonzero(w)
    return values[keep][kept], w[kept], bias


def train(docs: DataFrame, labels: DataFrame, *, max_rows: int = MAX_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", **rates) -> Model:
    """Fit on the documents that ``labels`` marks; a document labelled twice counts as toxic if either row says so.

    Null labels and ids are skipped. Without any labelled row the model has no weights and a low intercept.
    """
    marked = labels.select(F.col(id_col).cast("bigint").alias("_id"), F.col(label_col).cast("int").alias("_y")).dropna()
    sample = marked.groupBy("_id").agg(F.max("_y").alias("_y")).orderBy(F.xxhash64("_id"), "_id").limit(max_rows)
    texts = docs.select(F.col(id_col).cast("bigint").alias("_id"), col_or_empty(text_col).alias("_text"))
    rows = texts.join(F.broadcast(sample), "_id")

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_id", "_text"])
        values, w, bias = fit_texts(pdf["_text"].tolist(), pdf["_y"].to_numpy(np.float64), **rates)
        return pd.DataFrame({"feature": np.append(values.view(np.int64), 0), "weight": np.append(w, bias), "is_bias": np.append(np.zeros(len(w), bool), True)})

    got = rows.withColumn("_all", F.lit(True)).groupBy("_all").applyInPandas(fit, "feature bigint, weight double, is_bias boolean").toPandas()
    bias, w = got[got.is_bias].weight, got[~got.is_bias]
    return Model(w.feature.to_numpy(np.int64).view(np.uint64), w.weight.to_numpy(np.float64), float(bias.iloc[0]) if len(bias) else float(np.log(1 / 19)))


SCHEMA = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score in 0..1) of every row by its whole text; null text is empty; no shuffle."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Features()
        for rb in it:
            texts = rb.column(1).to_pylist()
            for a, b in blocks(texts, BLOCK):
                yield batch({"doc_id": rb.column(0)[a:b], "score": sent.value.score(texts[a:b], made)}, SCHEMA)

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), col_or_empty(text_col).alias("text")).mapInArrow(run, "doc_id bigint, score double")


def held_out(doc_id="doc_id"):
    return F.crc32(F.col(doc_id).cast("string")) % 4 == 2


def reject_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the documents whose score reaches ``threshold``; same columns, one row per row kept.

    Scores and filters in one pass over Arrow batches of whole rows, so nothing is shuffled or joined back.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels.where(~held_out())))
    column = docs.columns.index("text")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Features()
        for rb in it:
            texts = [t or "" for t in rb.column(column).to_pylist()]
            for a, b in blocks(texts, BLOCK):
                yield rb.slice(a, b - a).filter(pa.array(model.value.score(texts[a:b], made) < threshold))

    return docs.mapInArrow(run, docs.schema)


@query("op4_toxicity")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels").where(~held_out()))
    return score(docs, model).select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
