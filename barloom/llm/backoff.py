"""Language-model scores by stupid back-off, computed as joins on hashed n-gram counts.

1. Texts become blocks of up to a million words: a table of word hashes, the words as indexes into it, and the
   lengths of the documents. The blocks are stored in buckets, so that they are never shuffled.
2. Each block explodes into its distinct n-grams of all orders, with its counts; they go, packed per bucket of the
   hash space, to that bucket's group. A frequent n-gram is one entry per block, so no bucket is hot.
3. A bucket's group is the count table of that part of the hash space. It joins its counts to the n-grams that asked
   and answers each block with the totals.
4. A block joins the answers to its words, scores every position and sums per document.

A document is scored against all *other* documents: its own occurrences are taken off every count. The score of a word
is its count after the longest context that has been seen with it, relative to the context's count; each shortening of
the context costs a factor ``ALPHA``. Every count covers the whole corpus, and the tables grow with it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.common import batch, blocks, col_or_empty, mix, query, store_bucketed, table
from barloom.llm.decontaminate import words_of

ORDER = 3
ALPHA = 0.4
BLOCK_CHARS = 6 << 20
BUCKET_ENTRIES = 1_000_000
LOW = 5


def pack_ints(x: np.ndarray) -> bytes:
    """Non-negative integers in as few whole bytes as the largest needs, compressed by byte plane."""
    width = max(1, (int(x.max()).bit_length() + 7) // 8) if len(x) else 1
    planes = np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T)
    return bytes([width]) + b"".join((z := zlib.compress(p.tobytes(), 1)) and len(z).to_bytes(4, "little") + z for p in planes)


def unpack_ints(raw: bytes) -> np.ndarray:
    width, at, planes = raw[0], 1, []
    for _ in range(width):
        n = int.from_bytes(raw[at : at + 4], "little")
        planes.append(np.frombuffer(zlib.decompress(raw[at + 4 : at + 4 + n]), np.uint8))
        at += 4 + n
    out = np.zeros((len(planes[0]), 8), np.uint8)
    for k, p in enumerate(planes):
        out[:, k] = p
    return out.view("<u8").ravel()


def pack_sorted(h: np.ndarray) -> bytes:
    """Sorted distinct hashes: of their differences the low five bytes raw, the few bits above them compressed."""
    d = np.diff(h, prepend=np.uint64(0)).astype("<u8")
    return d.view(np.uint8).reshape(-1, 8)[:, :LOW].tobytes() + pack_ints(d[1:] >> np.uint64(8 * LOW)) + (d[:1] >> np.uint64(8 * LOW)).tobytes() + len(h).to_bytes(4, "little")


def unpack_sorted(raw: bytes) -> np.ndarray:
    n = int.from_bytes(raw[-4:], "little")
    out = np.zeros((n, 8), np.uint8)
    out[:, :LOW] = np.frombuffer(raw, np.uint8, n * LOW).reshape(n, LOW)
    high = np.append(np.frombuffer(raw[-12:-4], "<u8"), unpack_ints(raw[n * LOW : -12])) if n else np.empty(0, np.uint64)
    return np.cumsum(out.view("<u8").ravel() + (high << np.uint64(8 * LOW)), dtype=np.uint64)


def ngrams(words: np.ndarray, lengths: np.ndarray, order: int) -> list[np.ndarray]:
    """By order: the hash of the n-gram that ends at each word; of the longest there is near a document's start."""
    start = np.repeat(np.cumsum(lengths) - lengths, lengths)
    before = np.arange(len(words)) - start  # words before this one in its document
    out = [mix(words)]
    for k in range(1, order):
        shorter = np.append(np.zeros(1, np.uint64), out[-1][:-1])  # the (k)-gram that ends one word earlier
        out.append(np.where(before >= k, mix(shorter * np.uint64(0x9E3779B97F4A7C15) + words + np.uint64(k)), np.uint64(0)))
    return out


def asked(grams: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of a block with their counts in it; hash 0 is none."""
    return np.unique(np.concatenate([g[g != 0] for g in grams]), return_counts=True)


def own_counts(place: np.ndarray, doc: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """How often the n-gram at each position, known by its place in ``counts`` of the block, occurs in its own document."""
    out = np.ones(len(place), np.int64)
    several = np.flatnonzero(counts[place] > 1)  # what the block has once, the document has once
    _, run, n = np.unique(doc[several] * len(counts) + place[several], return_inverse=True, return_counts=True)
    out[several] = n[run]
    return out


def score_words(grams: list[np.ndarray], lengths: np.ndarray, totals: np.ndarray, corpus: int, alpha: float) -> np.ndarray:
    """Logarithm of the back-off score of every word; ``totals`` are those of the block's distinct n-grams, in their order."""
    doc = np.repeat(np.arange(len(lengths)), lengths)
    others = corpus - lengths[doc] + 1.0
    start = np.repeat(np.cumsum(lengths) - lengths, lengths)
    before = np.arange(len(doc)) - start
    every = np.concatenate(grams)
    real = np.flatnonzero(every)
    _, place, counts = np.unique(every[real], return_inverse=True, return_counts=True)
    left = np.zeros(len(every), np.int64)
    left[real] = totals[place] - own_counts(place, np.tile(doc, len(grams))[real], counts)
    elsewhere = np.split(left, len(grams))
    out = np.log(np.where(elsewhere[0] > 0, elsewhere[0], alpha) / others)
    for k in range(1, len(grams)):
        context = np.append(np.zeros(1, np.int64), elsewhere[k - 1][:-1])
        with np.errstate(divide="ignore", invalid="ignore"):
            known = np.log(elsewhere[k] / context)
        out = np.where(before < k, out, np.where(elsewhere[k] > 0, known, np.log(alpha) + out))
    return out


BLOCK_SCHEMA = pa.schema([("block", pa.int64()), ("n_words", pa.int64()), ("payload", pa.binary())])


def _payload(raw: bytes) -> dict:
    parts, at = [], 0
    for _ in range(5):
        n = int.from_bytes(raw[at : at + 8], "little")
        parts.append(raw[at + 8 : at + 8 + n])
        at += 8 + n
    ids, named, lengths, words, places = parts
    return {"ids": np.frombuffer(ids, "<i8"), "named": np.frombuffer(named, "?"), "lengths": unpack_ints(lengths).astype(np.int64), "words": np.frombuffer(words, "<u8")[unpack_ints(places).astype(np.int64)]}


def _blocks(docs: DataFrame) -> DataFrame:
    """The corpus as stored blocks."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in it:
            texts, ids = rb.column(1).to_pylist(), rb.column(0).to_pylist()
            for a, b in blocks(texts, BLOCK_CHARS):
                split = [words_of(t) for t in texts[a:b]]
                place = {w: i for i, w in enumerate(dict.fromkeys(w for ws in split for w in ws))}
                hashes = np.array(list(map(xxhash.xxh64_intdigest, place)), "<u8")
                places = np.array([place[w] for ws in split for w in ws], np.int64)
                named = np.array([i is not None for i in ids[a:b]])
                parts = (np.array([i or 0 for i in ids[a:b]], "<i8").tobytes(), named.tobytes(), pack_ints(np.array([len(ws) for ws in split])), hashes.tobytes(), pack_ints(places))
                yield batch({"block": [0], "n_words": [len(places)], "payload": [b"".join(len(p).to_bytes(8, "little") + p for p in parts)]}, BLOCK_SCHEMA)

    made = docs.mapInArrow(run, "block bigint, n_words bigint, payload binary")
    return store_bucketed(made.withColumn("block", F.monotonically_increasing_id()), "block")  # fixed from here on, as the table is stored


def backoff_scores(docs: DataFrame, order: int = ORDER, alpha: float = ALPHA, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, log_score) of every row: the sum of the logarithms of its words' scores.

    Words are as in decontamination: lower-cased runs of letters and digits. A word that no other document has counts
    as ``alpha`` occurrences of a word; a word near the start of a text is scored in the context there is, at no cost.
    Null and empty texts have no words and score 0. Repeated rows are documents of their own. A null id stays null; an
    empty table gives no rows; extra columns are not read.
    """
    corpus = _blocks(docs.select(F.col(id_col).cast("bigint").alias("doc_id"), col_or_empty(text_col).alias("text")))
    total = int(corpus.agg(F.sum("n_words")).first()[0] or 0)
    buckets = max(1, -(-total * order // BUCKET_ENTRIES))
    ask_schema = pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("hashes", pa.binary()), ("counts", pa.binary())])

    def ask(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in it:
            for block, raw in zip(rb.column(0).to_pylist(), rb.column(1).to_pylist(), strict=True):
                p = _payload(raw)
                values, counts = asked(ngrams(p["words"], p["lengths"], order))
                bucket = ((values >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
                cuts = np.append(np.flatnonzero(np.diff(bucket, prepend=-1)), len(values)).tolist()
                found = list(zip(cuts[:-1], cuts[1:], strict=True))
                for a in range(0, len(found), 256):
                    part = found[a : a + 256]
                    yield batch({"bucket": bucket[[i for i, _ in part]], "block": [block] * len(part), "hashes": [pack_sorted(values[i:j]) for i, j in part], "counts": [pack_ints(counts[i:j]) for i, j in part]}, ask_schema)

    def answer(rows: pd.DataFrame) -> pd.DataFrame:
        hashes = [unpack_sorted(r) for r in rows["hashes"]]
        counts = np.concatenate([unpack_ints(r) for r in rows["counts"]]).astype(np.float64)
        _, place = np.unique(np.concatenate(hashes), return_inverse=True)
        totals = np.bincount(place, counts).astype(np.int64)[place]
        ends = np.cumsum([len(h) for h in hashes])[:-1]
        return pd.DataFrame({"block": rows["block"], "bucket": rows["bucket"], "totals": [pack_ints(t) for t in np.split(totals, ends)]})

    def score(replies: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        out = []
        for raw in own["payload"]:
            p = _payload(raw)
            grams, lengths = ngrams(p["words"], p["lengths"], order), p["lengths"]
            totals = np.concatenate([unpack_ints(r) for r in replies.sort_values("bucket")["totals"]]).astype(np.int64) if len(replies) else np.empty(0, np.int64)
            logs = score_words(grams, lengths, totals, total, alpha) if len(totals) else np.empty(0)
            doc = np.repeat(np.arange(len(lengths)), lengths)
            ids = pd.array(p["ids"], "Int64")
            ids[~p["named"]] = pd.NA
            out.append(pd.DataFrame({"doc_id": ids, "n_words": lengths, "log_score": np.bincount(doc, logs, len(lengths)).astype(np.float64)}))
        return pd.concat(out) if out else pd.DataFrame({"doc_id": pd.array([], "Int64"), "n_words": np.empty(0, np.int64), "log_score": np.empty(0)})

    requests = corpus.select("block", "payload").mapInArrow(ask, "bucket bigint, block bigint, hashes binary, counts binary")
    replies = requests.groupBy("bucket").applyInPandas(answer, "block bigint, bucket bigint, totals binary")
    return replies.groupBy("block").cogroup(corpus.select("block", "payload").groupBy("block")).applyInPandas(score, "doc_id bigint, n_words bigint, log_score double")


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x00-/:-@\[-`{-\x7f]+') AS w FROM documents),
p AS (SELECT r, i, w[i] AS w, CASE WHEN i > 1 THEN w[i - 1] END AS v, CASE WHEN i > 2 THEN w[i - 2] END AS x FROM (SELECT r, w, unnest(generate_series(1, len(w))) AS i FROM d)),
u AS (SELECT w, count(*) AS c FROM p GROUP BY w), ud AS (SELECT r, w, count(*) AS c FROM p GROUP BY r, w),
b AS (SELECT v, w, count(*) AS c FROM p WHERE i > 1 GROUP BY v, w), bd AS (SELECT r, v, w, count(*) AS c FROM p WHERE i > 1 GROUP BY r, v, w),
t AS (SELECT x, v, w, count(*) AS c FROM p WHERE i > 2 GROUP BY x, v, w), td AS (SELECT r, x, v, w, count(*) AS c FROM p WHERE i > 2 GROUP BY r, x, v, w),
s AS (
  SELECT p.r, p.i, (SELECT count(*) FROM p) - len(d.w) + 1 AS n, u.c - ud.c AS cu, b.c - bd.c AS cb, uv.c - udv.c AS cv, t.c - td.c AS ct, bv.c - bdv.c AS cxv
  FROM p JOIN d USING (r) JOIN u ON u.w = p.w JOIN ud ON ud.r = p.r AND ud.w = p.w
  LEFT JOIN b ON b.v = p.v AND b.w = p.w LEFT JOIN bd ON bd.r = p.r AND bd.v = p.v AND bd.w = p.w
  LEFT JOIN u uv ON uv.w = p.v LEFT JOIN ud udv ON udv.r = p.r AND udv.w = p.v
  LEFT JOIN t ON t.x = p.x AND t.v = p.v AND t.w = p.w LEFT JOIN td ON td.r = p.r AND td.x = p.x AND td.v = p.v AND td.w = p.w
  LEFT JOIN b bv ON bv.v = p.x AND bv.w = p.v LEFT JOIN bd bdv ON bdv.r = p.r AND bdv.v = p.x AND bdv.w = p.v
), l AS (
  SELECT r, i, ct, cxv, CASE WHEN i > 1 AND cb > 0 THEN ln(cb / cv) ELSE ln(CASE WHEN cu > 0 THEN cu ELSE 0.4 END / n) + CASE WHEN i > 1 THEN ln(0.4) ELSE 0 END END AS y FROM s
), z AS (
  SELECT r, sum(CASE WHEN i > 2 AND ct > 0 THEN ln(ct / cxv) WHEN i > 2 THEN ln(0.4) + y ELSE y END) AS x FROM l GROUP BY r
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, round(coalesce(z.x, 0.0), 3) + 0.0 AS log_score, round(z.x / len(d.w), 6) AS mean_log_score FROM d LEFT JOIN z USING (r)
"""


@query("op6_backoff", SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = backoff_scores(table(spark, sf_dir, "documents"))
    mean = F.when(F.col("n_words") > 0, F.round(F.col("log_score") / F.col("n_words"), 6))
    return scored.select("doc_id", "n_words", (F.round("log_score", 3) + F.lit(0.0)).alias("log_score"), mean.alias("mean_log_score"))
