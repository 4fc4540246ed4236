"""Removal of repeated byte strings by merging Burrows-Wheeler transforms of shards.

Two equal strings of ``LENGTH`` bytes have the same anchor: the place of the smallest hash of ``GRAM`` bytes within
them. Consecutive starts with one anchor form a run, the text from its first start to the end of its last string. So
all starts of equal strings lie in runs of one anchor value, and runs can be dealt out by that value:

1. Every text gives its runs, as (anchor value, hash of the run's bytes, place); no bytes are moved.
2. Runs of one value and hash are equal. If there are two, all their starts repeat. A value with one run only has
   nothing to compare. What is left are values with different runs ("contested"), near the borders of repeats.
3. One copy of each contested run is cut from its document and goes to a bin of about ``BIN_BYTES``. There the runs are
   split into two shards; each shard's transform is built, the two are merged by interleave refinement, and strings
   of one class of ``LENGTH`` symbols repeat (see ``bwt``).
4. Repeated starts become spans, merged per document, and cut out.

A value with more than ``HOT`` different runs (a passage in very many documents, at its border) would overfill a bin.
Its starts are compared by 64-bit hashes of their strings within that value instead, which Spark counts and splits as
it likes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.bwt import repeated_starts
from barloom.llm.common import batch, col_or_empty, drop_table, mix, query, store, table

LENGTH = 400
GRAM = 64
HOT = 4096
BIN_BYTES = 1_000_000
PIECE = 1 << 20
BASE = np.uint64(0x9E3779B97F4A7C15)
NO_ID = -(2**63)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = np.uint64(pow(int(BASE), -1, 2**64))
    with np.errstate(over="ignore"):
        up = np.cumprod(np.append(np.uint64(1), np.full(n, BASE)), dtype=np.uint64)
        down = np.cumprod(np.append(np.uint64(1), np.full(n, inverse)), dtype=np.uint64)
    return up, down


class Runs:
    """Cuts byte strings into runs of starts with one anchor."""

    def __init__(self, length: int, gram: int):
        self.length, self.gram, self.window = length, gram, length - gram + 1
        self.up, self.down = _powers(PIECE + length)

    def gram_hashes(self, text: np.ndarray) -> np.ndarray:
        n = len(text)
        sums = np.cumsum(np.append(np.uint64(0), (text.astype(np.uint64) + np.uint64(1)) * self.up[:n]), dtype=np.uint64)
        return mix((sums[self.gram :] - sums[: n - self.gram + 1]) * self.down[: n - self.gram + 1])

    def _lowest(self, key: np.ndarray) -> np.ndarray:
        """Minimum of each window of ``self.window`` keys, by minima forward and backward within blocks."""
        w, n = self.window, len(key)
        blocks = np.full(-(-n // w) * w, np.uint64(2**64 - 1))
        blocks[:n] = key
        blocks = blocks.reshape(-1, w)
        forward = np.minimum.accumulate(blocks, axis=1).ravel()
        backward = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        return np.minimum(backward[: n - w + 1], forward[w - 1 : n])

    def of(self, texts: list[bytes]) -> Iterator[tuple[int, int, int, int]]:
        """(text, first start, number of starts, anchor value) of every run; texts laid end to end fit one piece."""
        sizes = np.array([len(t) for t in texts], np.int64)
        text = np.frombuffer(b"".join(texts), np.uint8)
        if len(text) < self.length:
            return
        h = self.gram_hashes(text)
        place = np.uint64((1 << 24) - 1)
        low = self._lowest(h & ~place | np.arange(len(h), dtype=np.uint64))
        anchor = (low & place).astype(np.int64)
        ends = np.cumsum(sizes)
        owner = np.repeat(np.arange(len(texts)), sizes)[: len(anchor)]
        start = np.arange(len(anchor))
        inside = start + self.length <= ends[owner]
        first = inside & np.append(True, (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1]) | ~inside[:-1])
        at = np.flatnonzero(first)
        number = np.diff(np.append(np.cumsum(inside)[at] - 1, inside.sum()))
        begin = ends - sizes
        value = h[anchor[at]].view(np.int64)
        yield from zip(owner[at].tolist(), (at - begin[owner[at]]).tolist(), number.tolist(), value.tolist(), strict=True)


def _pieces(texts: list[bytes], length: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """Groups of (text, place, bytes) that fit a piece; long texts are cut so that every string lies in one part."""
    group, n = [], 0
    for i, t in enumerate(texts):
        for a in range(0, max(1, len(t) - length + 1), PIECE - length):
            part = t[a : a + PIECE - 1] if len(t) > PIECE - 1 else t
            if group and n + len(part) > PIECE:
                yield group
                group, n = [], 0
            group.append((i, a, part))
            n += len(part)
    if group:
        yield group


RUN_SCHEMA = pa.schema([("id", pa.int64()), ("th", pa.int64()), ("start", pa.int64()), ("number", pa.int32()), ("anchor", pa.int64()), ("run", pa.int64())])


def runs_of(keyed: DataFrame, length: int, gram: int) -> DataFrame:
    """(id, th, start, number, anchor, run) of every run of every row of ``keyed`` (id, th, text)."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = Runs(length, gram)
        for rb in it:
            ids, hashes = rb.column(0).to_pylist(), rb.column(1).to_pylist()
            texts = [t.encode() for t in rb.column(2).to_pylist()]
            for group in _pieces(texts, length):
                rows: dict[str, list] = {f.name: [] for f in RUN_SCHEMA}
                for k, start, number, anchor in cutter.of([p[2] for p in group]):
                    i, a, part = group[k]
                    digest = xxhash.xxh3_64_intdigest(part[start : start + number + length - 1])
                    for name, value in zip(rows, (ids[i], hashes[i], a + start, number, anchor, digest - (1 << 64) if digest >> 63 else digest), strict=True):
                        rows[name].append(value)
                if rows["id"]:
                    yield batch(rows, RUN_SCHEMA)

    return keyed.mapInArrow(run, "id bigint, th bigint, start bigint, number int, anchor bigint, run bigint")


def _intervals(hit: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs [a, b) of true values."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def contested_starts(keyed: DataFrame, live: DataFrame, length: int, hot: int, bin_bytes: int) -> DataFrame:
    """(anchor, run, low, high): repeated starts [low, high) of runs that differ from others of their anchor value."""
    one = live.where(F.col("kinds") > 1).groupBy("anchor", "run").agg(F.min(F.struct("id", "th", "start", "number")).alias("at"), F.max("kinds").alias("kinds"))
    wanted = one.groupBy(F.col("at.id").alias("id"), F.col("at.th").alias("th")).agg(F.collect_list(F.struct("at.start", "at.number", "anchor", "run", "kinds")).alias("runs"))
    schema = pa.schema([("anchor", pa.int64()), ("run", pa.int64()), ("hot", pa.bool_()), ("bytes", pa.binary())])

    def cut(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in it:
            for text, runs in zip(rb.column(0).to_pylist(), rb.column(1).to_pylist(), strict=True):
                raw = text.encode()
                for a in range(0, len(runs), 1000):
                    part = runs[a : a + 1000]
                    yield batch({"anchor": [r["anchor"] for r in part], "run": [r["run"] for r in part], "hot": [r["kinds"] > hot for r in part], "bytes": [raw[r["start"] : r["start"] + r["number"] + length - 1] for r in part]}, schema)

    texts = store(keyed.join(wanted.hint("shuffle_hash"), ["id", "th"]).select("text", "runs").mapInArrow(cut, "anchor bigint, run bigint, hot boolean, bytes binary"))
    size = int(texts.where(~F.col("hot")).agg(F.sum(F.length("bytes"))).first()[0] or 0)
    bins = max(1, -(-size // bin_bytes))

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop_duplicates(["anchor", "run"]).sort_values(["anchor", "run"])
        place: dict[bytes, int] = {}
        at = [place.setdefault(b, len(place)) for b in rows["bytes"]]
        hits = repeated_starts(list(place), length)
        out = [(a, r, low, high) for a, r, k in zip(rows["anchor"], rows["run"], at, strict=True) for low, high in _intervals(hits[k])]
        return pd.DataFrame(out, columns=["anchor", "run", "low", "high"])

    ddl = "anchor bigint, run bigint, low int, high int"
    merged = texts.where(~F.col("hot")).withColumn("bin", F.pmod(F.xxhash64("anchor"), F.lit(bins))).repartition(bins, "bin").groupBy("bin").applyInPandas(merge, ddl)

    def hashed(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = pa.schema([("anchor", pa.int64()), ("run", pa.int64()), ("low", pa.int32()), ("string", pa.int64())])
        for rb in it:
            for a, r, b in zip(*(rb.column(k).to_pylist() for k in range(3)), strict=True):
                n = len(b) - length + 1
                digests = np.array([xxhash.xxh3_64_intdigest(b[i : i + length]) for i in range(n)], np.uint64)
                yield batch({"anchor": [a] * n, "run": [r] * n, "low": list(range(n)), "string": digests.view(np.int64)}, made)

    starts = texts.where("hot").select("anchor", "run", "bytes").dropDuplicates(["anchor", "run"]).mapInArrow(hashed, "anchor bigint, run bigint, low int, string bigint")
    again = store(starts.groupBy("anchor", "string").agg(F.count("*").alias("n")).where(F.col("n") > 1))
    often = starts.join(again, ["anchor", "string"]).select("anchor", "run", "low", (F.col("low") + 1).alias("high"))
    return store(merged.unionByName(often))


def cut_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT, bin_bytes: int = BIN_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, spans, kept): for every row the removed byte runs [from, to) and the bytes that stay.

    A byte goes if a string of ``length`` bytes that covers it also starts anywhere else, in the same row or another.
    Null texts are empty, rows of null id take part like others, and equal rows are copies of each other. An empty
    table gives no rows; extra columns are not read.
    """
    if not 0 < gram <= length < PIECE // 2:
        raise ValueError("gram must be at most length, and length well below a piece")
    keyed = docs.select(F.coalesce(F.col(id_col).cast("bigint"), F.lit(NO_ID)).alias("id"), F.xxhash64(col_or_empty(text_col)).alias("th"), col_or_empty(text_col).alias("text"))
    found = store(runs_of(keyed, length, gram))
    # counts are stored before they are joined: a join that reads both its shuffles itself is split where one passage is in very many texts
    kinds = store(found.groupBy("anchor", "run").agg(F.count("*").alias("copies")).groupBy("anchor").agg(F.count("*").alias("kinds"), F.sum("copies").alias("all")).where(F.col("all") > 1).select("anchor", "kinds"))
    of_value = store(found.join(kinds, "anchor"))
    copies = store(of_value.groupBy("anchor", "run").agg(F.count("*").alias("copies")).where(F.col("copies") > 1))
    live = store(of_value.join(copies, ["anchor", "run"], "left").withColumn("copies", F.coalesce("copies", F.lit(1))))
    for made in (found, kinds, of_value, copies):
        drop_table(made)
    starts = contested_starts(keyed, live, length, hot, bin_bytes)

    whole = live.where(F.col("copies") > 1).select("id", "th", F.col("start").alias("from"), (F.col("start") + F.col("number") + length - 1).alias("to"))
    part = live.where((F.col("copies") == 1) & (F.col("kinds") > 1)).join(starts, ["anchor", "run"]).select("id", "th", (F.col("start") + F.col("low")).alias("from"), (F.col("start") + F.col("high") + length - 1).alias("to"))
    spans = whole.unionByName(part).groupBy("id", "th").agg(F.collect_set(F.struct("from", "to")).alias("spans"))
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("spans", pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))), ("kept", pa.binary())])

    def remove(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in it:
            for i, text, spans in zip(rb.column(0).to_pylist(), rb.column(1).to_pylist(), rb.column(2).to_pylist(), strict=True):
                raw, merged = text.encode(), []
                for s in sorted((s["from"], s["to"]) for s in spans or ()):
                    if merged and s[0] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], s[1])
                    else:
                        merged.append(list(s))
                edges = [0, *(x for s in merged for x in s), len(raw)]
                kept = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                yield batch({"doc_id": [None if i == NO_ID else i], "n_bytes": [len(raw)], "spans": [[{"from": a, "to": b} for a, b in merged]], "kept": [kept]}, schema)

    joined = keyed.join(spans.hint("shuffle_hash"), ["id", "th"], "left").select("id", "text", "spans")
    return joined.mapInArrow(remove, "doc_id bigint, n_bytes bigint, spans array<struct<from:bigint,to:bigint>>, kept binary")


@query("op5_suffix_dedup")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = cut_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["to"] - s["from"])
    return cut.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
