"""Phrase collocations by direct-address tiles of re-ranked pairs.

1. Texts become blocks of one language: the block's distinct words with their counts, and the words as indexes into
   them, with a gap at each end of a piece. Block counts add up to the words of the corpus; the frequent ones are numbered
   by frequency, all languages together, and each block is answered with the numbers of its own words.
2. A block's neighbours are pairs of numbers. Frequent numbers are small, so the pairs of frequent words fall into few
   square tiles of ``TILE`` x ``TILE`` numbers: a tile with many pairs is counted into a dense array at the pair's
   address, the pairs of all other tiles are sorted and their runs counted. Spark adds the counts up by pair.
3. Frequent pairs are numbered by frequency in turn, blocks are coded anew in these numbers, and a pair of neighbouring
   pairs is a phrase of three words: the same step gives phrases of four and five.

A frequent phrase has frequent parts only, so no phrase is missed, and the parts' counts that its score needs are at hand.
Every block asks for a pair once, so the most frequent pair costs a row for each block and no task gets all of it.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.llm.common import batch, blocks, col_or_empty, drop_table, merge_partitions, query, store, table

MIN_COUNT = 100
LONGEST = 5
TOP = 2000
BLOCK_CHARS = 4 << 20
CHUNK_CHARS = 1 << 18
#: So many frequent pairs or words, 24 bytes or a string each, are sent to all tasks.
BROADCAST_PAIRS = 1_000_000
BROADCAST_WORDS = 300_000
TILE = 256
#: Pairs from which on a tile is counted densely.
DENSE = TILE * TILE // 16
GAP = -1
TOKEN = re.compile(rb"[^ \t\n]+|\n")
PIECES = bytes.maketrans(b".,;:!?\x0b\x0c\r", b"\n" * 9)

BLOCKS = pa.schema([("lang", pa.string()), ("n_words", pa.int64()), ("words", pa.binary()), ("seq", pa.binary())])
WORDS = pa.schema([("lang", pa.string()), ("word", pa.string()), ("c", pa.int64())])
PAIRS = pa.schema([("block", pa.int64()), ("x", pa.int64()), ("y", pa.int64()), ("c", pa.int64())])
CODED = pa.schema([("block", pa.int64()), ("seq", pa.binary())])
CODED_DDL = "block bigint, seq binary"


def packed(seq: np.ndarray) -> bytes:
    """A sequence of numbers, compressed: rows of it stay small on their way through readers and batches."""
    wide = len(seq) and seq.max() >= 1 << 31
    return zstandard.compress(seq.astype("<i8" if wide else "<i4").tobytes(), 1) + (b"8" if wide else b"4")


def unpacked(raw: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(raw[:-1]), f"<i{raw[-1:].decode()}").astype(np.int64)


def tokens(texts: list[str]) -> list[bytes]:
    """Words of all texts in order, with a line feed at each end of a piece."""
    raw = "\n".join(texts).encode("utf-8", "surrogatepass").translate(PIECES).lower()  # of bytes only A-Z change
    return TOKEN.findall(raw)


def count_pairs(x: np.ndarray, y: np.ndarray, tile: int = TILE, dense: int = DENSE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs and their counts: by address in the tiles that hold ``dense`` pairs or more, sorted in all others."""
    if not len(x):
        return x, y, x
    across = int(y.max()) // tile + 1
    at = (x // tile) * across + y // tile
    tiles, place, held = np.unique(at, return_inverse=True, return_counts=True)
    full = held >= dense
    out = []
    crowded = np.flatnonzero(full[place])
    order = crowded[np.argsort(place[crowded], kind="stable")]
    for t, part in zip(tiles[full], np.split(order, np.cumsum(held[full])[:-1]), strict=False):
        cells = np.bincount(x[part] % tile * tile + y[part] % tile, minlength=tile * tile)
        found = np.flatnonzero(cells)
        out.append((t // across * tile + found // tile, t % across * tile + found % tile, cells[found]))
    sparse = np.flatnonzero(~full[place])
    if len(sparse):
        sparse = sparse[np.lexsort((y[sparse], x[sparse]))]
        a, b = x[sparse], y[sparse]
        starts = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
        out.append((a[starts], b[starts], np.diff(starts, append=len(a))))
    return tuple(np.concatenate([o[k] for o in out]) for k in range(3))


def neighbours(seq: np.ndarray) -> np.ndarray:
    """Where a number and the next one are both of frequent phrases of one piece."""
    return np.flatnonzero((seq[:-1] >= 0) & (seq[1:] >= 0))


def corpus(docs: DataFrame) -> DataFrame:
    """The stored blocks of (lang, text)."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in it:
            by_lang: dict[str, list[str]] = {}
            for lang, text in zip(rb.column(0).to_pylist(), rb.column(1).to_pylist(), strict=True):
                by_lang.setdefault(lang, []).append(text)
            for lang, texts in by_lang.items():
                for a, b in blocks(texts, BLOCK_CHARS):
                    place: dict[bytes, int] = {}
                    parts = []
                    for i, j in blocks(texts[a:b], CHUNK_CHARS):
                        parts.append(np.array([GAP if w == b"\n" else place.setdefault(w, len(place)) for w in tokens(texts[a + i : a + j])], np.int64))
                        parts.append(np.array([GAP]))
                    seq = np.concatenate(parts)
                    words = zstandard.compress(b"\n".join(place), 1)  # no word holds a line feed
                    yield batch({"lang": [lang], "n_words": [int((seq >= 0).sum())], "words": [words], "seq": [packed(seq)]}, BLOCKS)

    made = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), col_or_empty().alias("text")).mapInArrow(run, "lang string, n_words bigint, words binary, seq binary")
    return store(made.withColumn("block", F.monotonically_increasing_id()))


def words_of_block(raw: bytes) -> list[str]:
    joined = zstandard.decompress(raw)
    return joined.decode("utf-8", "surrogatepass").split("\n") if joined else []


def word_counts(stored: DataFrame) -> DataFrame:
    """(lang, word, c), the counts of the blocks that come together already added up."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in it:
            totals: dict[str, Counter] = {}
            for lang, words, seq in zip(rb.column(0).to_pylist(), rb.column(1), rb.column(2), strict=True):
                places = unpacked(seq.as_py())
                names = words_of_block(words.as_py())
                held = totals.setdefault(lang, Counter())
                held.update(dict(zip(names, np.bincount(places[places >= 0], minlength=len(names)).tolist(), strict=True)))
                if sum(map(len, totals.values())) >= 1 << 19:
                    yield from emitted(totals)
                    totals = {}
            yield from emitted(totals)

    def emitted(totals: dict[str, Counter]) -> Iterator[pa.RecordBatch]:
        for lang, held in totals.items():
            words = list(held)
            for a in range(0, len(words), 1 << 16):
                part = words[a : a + (1 << 16)]
                yield batch({"lang": pa.repeat(pa.scalar(lang), len(part)), "word": part, "c": [held[w] for w in part]}, WORDS)

    return stored.select("lang", "words", "seq").mapInArrow(run, "lang string, word string, c bigint")


def ranked(counted: DataFrame, keys: list[str]) -> DataFrame:
    """``counted`` (f, keys) with ``id``: its place from 0 by falling ``f``.

    Rows are dealt out by ranges, stored and numbered where they lie; what lies before a partition is one number each."""
    order = [F.col("f").desc(), *keys]
    n = merge_partitions(counted.sparkSession)
    placed = store(counted.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()))
    placed = placed.withColumn("part", F.shiftright("at", 33))
    sizes = placed.groupBy("part").agg(F.count("*").alias("held"), F.min("at").alias("low"))
    before = sizes.select("part", "low", F.coalesce(F.sum("held").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return placed.join(F.broadcast(before), "part").select("f", *keys, (F.col("before") + F.col("at") - F.col("low")).alias("id"))


def coded_words(stored: DataFrame, vocabulary: DataFrame, most: int = BROADCAST_WORDS) -> DataFrame:
    """The blocks with every frequent word as its number, all others as gaps.

    Up to ``most`` frequent words are broadcast; more are joined to the words of each block and brought to it."""
    spark = stored.sparkSession
    blocks_ = stored.select("block", "lang", "words", "seq")

    def numbers(seq: bytes, ids: np.ndarray) -> bytes:
        return packed(np.append(ids, GAP)[unpacked(seq)])  # the last one stands for the gap

    if vocabulary.count() <= most:
        known: dict[str, dict[str, int]] = {}
        for r in vocabulary.select("lang", "word", "id").toArrow().to_pylist():
            known.setdefault(r["lang"], {})[r["word"]] = r["id"]
        sent = spark.sparkContext.broadcast(known)

        def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for rb in it:
                for block, lang, words, seq in zip(*(rb.column(k) for k in range(4)), strict=True):
                    ids = sent.value.get(lang.as_py(), {})
                    own = np.array([ids.get(w, GAP) for w in words_of_block(words.as_py())], np.int64)
                    yield batch({"block": [block.as_py()], "seq": [numbers(seq.as_py(), own)]}, CODED)

        out = store(blocks_.mapInArrow(run, CODED_DDL))
        sent.destroy()
        return out

    asked_schema = pa.schema([("block", pa.int64()), ("lang", pa.string()), ("pos", pa.int64()), ("word", pa.string())])

    def ask(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in it:
            for block, lang, words in zip(*(rb.column(k).to_pylist() for k in range(3)), strict=True):
                names = words_of_block(words)
                yield batch({"block": [block] * len(names), "lang": [lang] * len(names), "pos": np.arange(len(names)), "word": names}, asked_schema)

    def bring(found: pa.Table, own: pa.Table) -> pa.Table:
        out = []
        for words, seq in zip(own["words"].to_pylist(), own["seq"].to_pylist(), strict=True):
            ids = np.full(len(words_of_block(words)), GAP)
            ids[found["pos"].to_numpy()] = found["id"].to_numpy()
            out.append(numbers(seq, ids))
        return pa.table({"block": own["block"], "seq": out}, schema=CODED)

    asked = blocks_.select("block", "lang", "words").mapInArrow(ask, "block bigint, lang string, pos bigint, word string")
    found = asked.join(vocabulary.select("lang", "word", "id"), ["lang", "word"]).select("block", "pos", "id")
    return store(found.groupBy("block").cogroup(blocks_.groupBy("block")).applyInArrow(bring, CODED_DDL))


def asked_pairs(coded: DataFrame) -> DataFrame:
    """(block, x, y, c) of every pair of neighbours; numbers are of one language each."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in it:
            for block, raw in zip(rb.column(0).to_pylist(), rb.column(1), strict=True):
                seq = unpacked(raw.as_py())
                at = neighbours(seq)
                x, y, c = count_pairs(seq[at], seq[at + 1])
                for a in range(0, len(x), 1 << 17):
                    part = slice(a, a + (1 << 17))
                    yield batch({"block": np.full(len(x[part]), block), "x": x[part], "y": y[part], "c": c[part]}, PAIRS)

    return coded.mapInArrow(run, "block bigint, x bigint, y bigint, c bigint")


def numbered(seq: np.ndarray, x: np.ndarray, y: np.ndarray, id_: np.ndarray) -> np.ndarray:
    """``seq`` with every known pair of neighbours as its number, where its first part was, and gaps elsewhere.
    Known pairs are sorted by (x, y)."""
    new = np.full(len(seq), GAP)
    at = neighbours(seq)
    if not len(x) or not len(at):
        return new
    heads = np.append(True, x[1:] != x[:-1])
    first = np.flatnonzero(heads)  # where the pairs of each left part begin
    left = x[first]
    run = np.minimum(np.searchsorted(left, seq[at]), len(left) - 1)
    at, run = at[left[run] == seq[at]], run[left[run] == seq[at]]
    # within one left part right parts are sorted: one key for both, from ranks instead of the numbers themselves
    rights, rank = np.unique(y, return_inverse=True)
    keys = (np.cumsum(heads) - 1) * len(rights) + rank
    place = np.minimum(np.searchsorted(rights, seq[at + 1]), len(rights) - 1)
    fits = rights[place] == seq[at + 1]
    at, wanted = at[fits], run[fits] * len(rights) + place[fits]
    hit = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    found = keys[hit] == wanted
    new[at[found]] = id_[hit[found]]
    return new


def coded_pairs(coded: DataFrame, pairs: DataFrame, most: int = BROADCAST_PAIRS) -> DataFrame:
    """The blocks with every frequent pair of neighbours as its number, where its first part was.

    Up to ``most`` frequent pairs are broadcast; more are joined to the pairs that each block holds and brought to it."""
    spark = coded.sparkSession
    known = pairs.select("x", "y", "id")
    if known.count() <= most:
        rows = known.orderBy("x", "y").toArrow()
        sent = spark.sparkContext.broadcast([rows[k].to_numpy() for k in ("x", "y", "id")])

        def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for rb in it:
                for block, raw in zip(rb.column(0), rb.column(1), strict=True):
                    yield batch({"block": [block.as_py()], "seq": [packed(numbered(unpacked(raw.as_py()), *sent.value))]}, CODED)

        out = store(coded.mapInArrow(run, CODED_DDL))
        sent.destroy()
        return out

    def bring(found: pa.Table, own: pa.Table) -> pa.Table:
        found = found.sort_by([("x", "ascending"), ("y", "ascending")])
        x, y, id_ = (found[k].to_numpy() for k in ("x", "y", "id"))
        out = [packed(numbered(unpacked(raw), x, y, id_)) for raw in own["seq"].to_pylist()]
        return pa.table({"block": own["block"], "seq": out}, schema=CODED)

    asked = asked_pairs(coded).drop("c").join(known, ["x", "y"]).select("block", "x", "y", "id")
    return store(asked.groupBy("block").cogroup(coded.groupBy("block")).applyInArrow(bring, CODED_DDL))


#: The lowest-scoring cut of a phrase, the first of equal ones. Products are exact decimals of at most 38 digits.
CUT = """array_min(transform(sequence(1, size(heads)), k -> struct(
  (CAST(1000 AS DECIMAL(4, 0)) * CAST(f AS DECIMAL(15, 0)) * CAST(n AS DECIMAL(17, 0)))
    div (CAST(heads[k - 1] AS DECIMAL(15, 0)) * CAST(tails[size(heads) - k] AS DECIMAL(15, 0))) AS score,
  k, heads[k - 1] AS l, tails[size(heads) - k] AS r)))"""


def phrases(docs: DataFrame, min_count: int = MIN_COUNT, longest: int = LONGEST, broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """(lang, phrase, f, heads, tails, n) of every phrase of 2 to ``longest`` words that occurs ``min_count`` times or
    more in its language and is in no longer one of the same count; ``heads`` and ``tails`` are the counts of its first
    and of its last words, of one word and more.
    """
    stored = corpus(docs)
    totals = store(stored.groupBy("lang").agg(F.sum("n_words").alias("n")))
    vocabulary = store(ranked(word_counts(stored).groupBy("lang", "word").agg(F.sum("c").alias("f")).where(F.col("f") >= min_count), ["lang", "word"]))
    none = F.array().cast("array<bigint>")
    known = [vocabulary.select("lang", "id", "f", F.col("word").alias("phrase"), F.col("word").alias("last"), none.alias("heads"), none.alias("tails"))]
    coded = coded_words(stored, vocabulary, min(BROADCAST_WORDS, broadcast_pairs))
    drop_table(stored)
    for k in range(2, longest + 1):
        counted = asked_pairs(coded).groupBy("x", "y").agg(F.sum("c").alias("f")).where(F.col("f") >= min_count)
        pairs = store(ranked(counted, ["x", "y"]))
        left, right = (known[-1].select(F.col("id").alias(c), *(F.col(n).alias(f"{c}_{n}") for n in names)) for c, names in (("x", ("lang", "f", "phrase", "heads")), ("y", ("f", "last", "tails"))))
        named = pairs.join(left, "x").join(right, "y")
        known.append(store(named.select(F.col("x_lang").alias("lang"), "id", "x", "y", "f", F.concat_ws(" ", "x_phrase", "y_last").alias("phrase"), F.col("y_last").alias("last"), F.concat("x_heads", F.array("x_f")).alias("heads"), F.concat("y_tails", F.array("y_f")).alias("tails"))))
        if k < longest:
            new = coded_pairs(coded, pairs, broadcast_pairs)
            drop_table(coded)
            coded = new
    drop_table(coded)
    kept = known[-1].select("lang", "phrase", "f", "heads", "tails")
    for short, long in zip(known[1:-1], known[2:], strict=True):
        inside = long.where(F.col("f") >= F.element_at("heads", -1)).select(F.col("x").alias("id")).union(long.where(F.col("f") >= F.element_at("tails", -1)).select(F.col("y").alias("id"))).distinct()
        kept = kept.unionByName(short.join(inside, "id", "left_anti").select("lang", "phrase", "f", "heads", "tails"))
    return kept.join(totals, "lang")


def collocations(docs: DataFrame, min_count: int = MIN_COUNT, longest: int = LONGEST, top: int = TOP, broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of each language's ``top`` phrases by score.

    ``docs`` has lang and text; other columns are not read. A null lang is ``und``, a null text is empty; empty texts and
    languages without a frequent phrase give no rows, nor does an empty table. Repeated rows count each. Texts of any
    length are taken whole: one longer than a block is a block of its own. Of equal scores the more frequent phrase
    comes first, then the smaller one by bytes.
    """
    scored = phrases(docs, min_count, longest, broadcast_pairs).withColumn("cut", F.expr(CUT))
    named = scored.select("lang", "phrase", F.col("f").alias("a"), "cut.l", "cut.r", "n", "cut.score")
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    return named.withColumn("rank", F.row_number().over(order).cast("bigint")).where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


SQL = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), w AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p
), t AS (
  SELECT lang, sum(len(w)) AS n FROM w GROUP BY lang
), i AS (
  SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w
), g AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS a FROM i, range(1, 6) AS x(k) WHERE i + k - 1 <= len(w) GROUP BY ALL HAVING count(*) >= 100
), c AS (
  SELECT lang, phrase, k, a, unnest(range(1, k)) AS j, string_split(phrase, ' ') AS s FROM g WHERE k > 1
), s AS (
  SELECT c.lang, c.phrase, c.k, c.a, l.a AS l, r.a AS r, t.n, c.j, (1000 * CAST(c.a AS HUGEINT) * t.n) // (CAST(l.a AS HUGEINT) * r.a) AS score
  FROM c JOIN t ON t.lang = c.lang JOIN g l ON l.lang = c.lang AND l.k = c.j AND l.phrase = array_to_string(c.s[1:c.j], ' ')
  JOIN g r ON r.lang = c.lang AND r.k = c.k - c.j AND r.phrase = array_to_string(c.s[c.j + 1:], ' ')
), b AS (
  SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1
), d AS (
  SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.lang = b.lang AND g.k > b.k AND 100 * g.a >= 100 * b.a AND contains(' ' || g.phrase || ' ', ' ' || b.phrase || ' '))
)
SELECT lang, CAST(row_number() OVER o AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM d WINDOW o AS (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) QUALIFY row_number() OVER o <= 2000
"""


@query("op13_collocations", SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))
