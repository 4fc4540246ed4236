"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A text is cut into paragraphs: at line feeds and full stops, after four bytes whose hash is one of ``EVERY``, and after
``LONG`` bytes without such a place, so that an edit changes the paragraphs it touches and few others. Each paragraph has a 64-bit digest; a repeated
one is told by how often it has occurred before. A sketch has three parts of ``width`` cells; every digest goes to one
cell of each part, which keeps the number of its digests, their sum and the sum of their checks.

Sketches of two versions subtract cell by cell, and what they share cancels. A cell that is left with one digest gives
it away; taking that digest off its other two cells makes more such cells, until nothing is left: then the paragraphs by
which the versions differ are all known, on either side. If cells remain, the sketch was too small and both versions are
sketched again, ``GROWTH`` times as wide or, if that is more, as wide as the spread of the counts tells. The fingerprint is the smallest sketch, in base64.
"""

from __future__ import annotations

from base64 import b64decode, b64encode
from collections.abc import Iterator, Sequence
from hashlib import sha256

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.common import batch, blocks, col_or_empty, merge_partitions, mix, query, table

SEED = 42
EVERY = 16
LONG = 64
WIDTH = 8
GROWTH = 2
#: Cells for each digest that is expected to be left; from 1.23 on, wide sketches are nearly always resolved.
ROOM = 1.7
PARTS = 3
ODD = np.uint64(0x9E3779B97F4A7C15)
CHECK = np.uint64(0xD1B54A32D192ED03)
BLOCK_CHARS = 1 << 19


def digests(text: str) -> np.ndarray:
    """The distinct digests of a text's paragraphs; the k-th occurrence of a paragraph has a digest of its own."""
    raw = text.encode()
    if not raw:
        return np.empty(0, np.uint64)
    b = np.frombuffer(raw, np.uint8)
    cut = (b == 10) | (b == 46)
    if len(b) >= 4:
        w = b[3:].astype(np.uint32)
        for k in (1, 2, 3):
            w = w << np.uint32(8) | b[3 - k : len(b) - k]
        cut[3:] |= w * np.uint32(0x9E3779B1) >> np.uint32(16) < (1 << 16) // EVERY
    cut[-1] = True
    ends = np.flatnonzero(cut) + 1
    size = np.diff(ends, prepend=0)
    if size.max() > LONG:
        ends = np.sort(np.concatenate([ends, *(np.arange(e - n + LONG, e, LONG) for e, n in zip(ends[size > LONG], size[size > LONG], strict=True))]))
    ends = ends.tolist()
    h = xxhash.xxh64_intdigest
    found = np.fromiter([h(raw[i:j], SEED) for i, j in zip([0, *ends[:-1]], ends, strict=True)], np.uint64, len(ends))
    found.sort()
    new = np.append(True, found[1:] != found[:-1])
    before = np.arange(len(found)) - np.maximum.accumulate(np.where(new, np.arange(len(found)), 0))
    return mix(found + before.astype(np.uint64) * ODD)


class Sketches:
    """Sketches of many sets at once, laid out one after another; set ``i`` has three parts of ``width[i]`` cells."""

    def __init__(self, width: np.ndarray):
        self.width = np.asarray(width, np.int64)
        self.start = np.append(0, np.cumsum(PARTS * self.width))
        n = int(self.start[-1])
        self.count, self.keys, self.checks = np.zeros(n, np.int64), np.zeros(n, np.uint64), np.zeros(n, np.uint64)

    def add(self, of: np.ndarray, keys: np.ndarray, sign: np.ndarray) -> np.ndarray:
        """Put ``keys`` into the sets ``of``, or take them off where ``sign`` is -1; the cells that changed."""
        s = sign.astype(np.int64).view(np.uint64)
        checks = mix(keys + CHECK) * s
        summed, touched = keys * s, []
        for part in range(PARTS):
            w = self.width[of].astype(np.uint64)
            spot = mix(keys ^ (w * ODD + np.uint64(part))) >> np.uint64(32)
            cell = self.start[of] + part * self.width[of] + (spot * w >> np.uint64(32)).astype(np.int64)
            np.add.at(self.count, cell, sign)
            np.add.at(self.keys, cell, summed)
            np.add.at(self.checks, cell, checks)
            touched.append(cell)
        return np.concatenate(touched)

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Take out all digests that can be told: their set, the digest and its sign. What remains is not zero."""
        look, out = np.arange(len(self.count)), []
        while len(look):
            look = look[np.abs(self.count[look]) == 1]
            sign = self.count[look]
            s = sign.view(np.uint64)
            keys = self.keys[look] * s
            single = mix(keys + CHECK) * s == self.checks[look]
            of = np.searchsorted(self.start, look[single], side="right") - 1
            keys, sign = keys[single], sign[single]
            order = np.lexsort((keys, of))
            of, keys, sign = of[order], keys[order], sign[order]
            once = np.append(True, (of[1:] != of[:-1]) | (keys[1:] != keys[:-1])) if len(of) else np.empty(0, bool)
            out.append((of[once], keys[once], sign[once]))
            look = np.unique(self.add(of[once], keys[once], -sign[once])) if once.any() else look[:0]
        return tuple(np.concatenate([o[k] for o in out]) if out else np.empty(0, t) for k, t in enumerate((np.int64, np.uint64, np.int64)))

    def expected(self) -> np.ndarray:
        """About how many digests each difference holds: a cell's count varies about its mean by the root of its share."""
        c = self.count.astype(np.float64)
        spread = np.add.reduceat(c * c, self.start[:-1]) - np.add.reduceat(c, self.start[:-1]) ** 2 / (PARTS * self.width)
        return spread / PARTS

    def left(self) -> np.ndarray:
        """The sets that are not empty."""
        used = np.flatnonzero((self.count != 0) | (self.keys != 0) | (self.checks != 0))
        return np.unique(np.searchsorted(self.start, used, side="right") - 1)

    def encoded(self) -> list[str]:
        rows = np.stack([self.count.view(np.uint64), self.keys, self.checks], axis=1).astype("<u8")
        raw = np.concatenate([rows.view(np.uint8)[:, :4], rows.view(np.uint8)[:, 8:]], axis=1).tobytes()
        at = (self.start * 20).tolist()
        return [b64encode(raw[i:j]).decode() for i, j in zip(at[:-1], at[1:], strict=True)]

    @classmethod
    def decoded(cls, fingerprints: Sequence[str]) -> Sketches:
        raw = [b64decode(f) for f in fingerprints]
        out = cls(np.array([len(r) // (20 * PARTS) for r in raw], np.int64))
        cells = np.frombuffer(b"".join(raw), np.uint8).reshape(-1, 20)
        out.count = np.ascontiguousarray(cells[:, :4]).view("<i4").ravel().astype(np.int64)
        out.keys, out.checks = (np.ascontiguousarray(cells[:, k : k + 8]).view("<u8").ravel().astype(np.uint64) for k in (4, 12))
        return out

    def minus(self, other: Sketches) -> Sketches:
        """The cells of these sets less those of the other ones, which must be as wide."""
        out = Sketches(self.width)
        out.count, out.keys, out.checks = self.count - other.count, self.keys - other.keys, self.checks - other.checks
        return out


def sketched(sets: list[np.ndarray], width: int | np.ndarray = WIDTH) -> Sketches:
    out = Sketches(np.broadcast_to(width, len(sets)))
    if sets:
        of = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        out.add(of, np.concatenate(sets), np.ones(len(of), np.int64))
    return out


def differences(a: list[np.ndarray], b: list[np.ndarray], first: Sketches | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pair, digest, sign) of all digests that only ``a[i]`` (sign 1) or only ``b[i]`` (-1) has. ``first`` is the
    difference of their smallest sketches, if at hand; pairs that it does not settle are sketched wider until they are.
    """
    found = []
    pairs, width = np.arange(len(a)), np.full(len(a), WIDTH)
    if not a:
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64)
    cells = first if first is not None else sketched(a).minus(sketched(b))
    while True:
        expected = cells.expected()
        of, keys, sign = cells.peel()
        left = cells.left()
        done = np.ones(len(pairs), bool)
        done[left] = False
        good = done[of]
        found.append((pairs[of[good]], keys[good], sign[good]))
        if not len(left):
            return tuple(np.concatenate([f[k] for f in found]) for k in range(3))
        pairs = pairs[left]
        least = np.array([abs(len(a[i]) - len(b[i])) for i in pairs])  # sets whose sizes differ are as far apart at least
        width = np.maximum(width[left] * GROWTH, (ROOM / PARTS * np.maximum(expected[left], least)).astype(np.int64))
        cells = sketched([a[i] for i in pairs], width).minus(sketched([b[i] for i in pairs], width))


def likeness(a: list[np.ndarray], b: list[np.ndarray], first: Sketches | None = None) -> np.ndarray:
    """Shared paragraphs among all paragraphs of each pair; 1 for two empty texts."""
    pair, _, _ = differences(a, b, first)
    n = np.array([len(x) + len(y) for x, y in zip(a, b, strict=True)], np.int64)
    apart = np.bincount(pair, minlength=len(a))
    return np.where(n == 0, 1.0, (n - apart) / np.maximum(n + apart, 1))


def in_order(docs: DataFrame) -> DataFrame:
    """Rows (part, guest, doc_id, text) in partitions that hold whole ranges of ids, sorted, each followed by the row that
    comes next in the order of all ids as a guest; after the last one comes the first.

    Only ids are looked at to find the ranges: their quantiles, and the first id of each range. A text is shuffled once.
    """
    n = merge_partitions(docs.sparkSession)
    ids = docs.select("doc_id")
    cuts = ids.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)] or [0.5], 10_000).alias("q")).first()[0] or []
    bounds = F.array(*(F.lit(int(c)) for c in sorted(set(cuts)))) if cuts else F.array().cast("array<bigint>")
    part = F.when(F.col("doc_id").isNull(), 0).otherwise(F.size(F.filter(bounds, lambda b: b <= F.col("doc_id"))))
    by_id = F.struct(F.col("doc_id").isNotNull(), "doc_id")
    firsts = ids.select(part.alias("part"), "doc_id").groupBy("part").agg(F.min(by_id)["doc_id"].alias("doc_id")).orderBy("part").collect()
    before = {r["part"]: firsts[i - 1]["part"] for i, r in enumerate(firsts)}
    named = [r["doc_id"] for r in firsts if r["doc_id"] is not None]
    opens = F.col("doc_id").isin(named) if named else F.lit(False)
    if len(named) < len(firsts):
        opens = F.col("doc_id").isNull() | opens
    previous = F.get(F.array(*(F.lit(before.get(i, 0)) for i in range(max(before, default=0) + 1))), F.col("part"))
    own, guest = (F.struct(p.alias("part"), F.lit(g).alias("guest")) for p, g in ((F.col("part"), 0), (previous, 1)))
    to = F.when(opens, F.array(own, guest)).otherwise(F.array(own))
    dealt = docs.select("doc_id", "text", part.alias("part")).select("doc_id", "text", F.explode(to).alias("to")).select("to.part", "to.guest", "doc_id", "text")
    return dealt.repartition(n, "part").sortWithinPartitions("part", "guest", F.col("doc_id").asc_nulls_first(), "text")


OUT = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])


def edited(text: str, following: str) -> str:
    """``text`` with its second half replaced by as much of the beginning of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def paragraph_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every row.

    ``near_`` is the share of paragraphs that the text has in common with its edited form, and with the next row's text,
    among all paragraphs of the two, repeats counted. Null text counts as empty; two empty texts are alike (1). Rows are
    ordered by id, null first, rows of one id by text; repeated rows stay, each followed by its copy. An empty table
    gives no rows, a single row follows itself. Other columns are not read. Whole texts count, however long.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        texts: list[str] = []
        guests: list[int] = []
        for rb in it:
            guests += rb.column(0).to_pylist()
            ids += rb.column(1).to_pylist()
            texts += rb.column(2).to_pylist()
            for i, j in blocks(texts[:-1], BLOCK_CHARS):
                sets = [digests(t) for t in texts[i : j + 1]]
                rows = [k for k in range(i, j) if not guests[k]]
                if rows:
                    own, after = [sets[k - i] for k in rows], [sets[k - i + 1] for k in rows]
                    new = [edited(texts[k], texts[k + 1]) for k in rows]
                    new_sets = [digests(t) for t in new]
                    mine, theirs, next_ = sketched(own), sketched(new_sets), sketched(after)
                    yield batch(
                        {
                            "doc_id": [ids[k] for k in rows],
                            "n_chars": [len(texts[k]) for k in rows],
                            "edited_sha256": [sha256(t.encode()).hexdigest() for t in new],
                            "fingerprint": mine.encoded(),
                            "edited_fingerprint": theirs.encoded(),
                            "near_edited": likeness(own, new_sets, mine.minus(theirs)),
                            "near_next": likeness(own, after, mine.minus(next_)),
                        },
                        OUT,
                    )
            ids, texts, guests = ids[-1:], texts[-1:], guests[-1:]

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), col_or_empty(text_col).alias("text"))
    return in_order(rows).select("guest", "doc_id", "text").mapInArrow(run, "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


@query("op12_paragraph_sketch")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraph_fingerprints(table(spark, sf_dir, "documents"))
