"""Hierarchical multi-length packing of token sequences.

Every text becomes token ids (with an end id). Full windows of the longest tier are cut off first; what remains of a
document goes to the smallest tier (context size, a power of two) that holds it. Each tier is packed into windows of
its own size, from the longest tier down: a document opens a window, the gap is filled with the longest documents of
shorter tiers that fit, and the last gap is closed by cutting one document. All windows are therefore exactly full,
apart from one at the end of a task. Windows of one tier form step groups of equal token counts.

A task packs the rows of its own input split as a stream, so nothing is shuffled and a lost task repeats its own rows.
"""

from __future__ import annotations

import functools
import re
import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator, Sequence
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.common import batch, blocks, col_or_empty, query, table

TIERS = (256, 512, 1024, 2048)
STEP_TOKENS = 8 * 2048
END_ID = 1
BLOCK = 1 << 20

# Fixed values of byte-level BPE: the pre-token pattern, and the bytes that a vocabulary file writes as themselves.
PRE_TOKENS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
PLAIN_BYTES = (*range(33, 127), *range(161, 173), *range(174, 256))


class Encoder:
    """Ids of whole texts, equal to those of the ``tokenizers`` library for a byte-level BPE file of its own.

    The file's vocabulary is read as merge ranks (in such files a token's id is the rank of its merge) and applied by
    ``tiktoken``, which gives the same ids for a quarter of the CPU time; the tests hold one against the other. Added
    tokens are found in the text first, as the library does by default.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        added = {t.content: i for i, t in tok.get_added_tokens_decoder().items()}
        others = iter(range(256, 512))
        byte = {chr(b if b in PLAIN_BYTES else next(others)): b for b in range(256)}
        ranks = {bytes(byte[c] for c in token): i for token, i in tok.get_vocab(with_added_tokens=False).items() if token not in added}
        self.bpe = tiktoken.Encoding("byte_bpe", pat_str=PRE_TOKENS, mergeable_ranks=ranks, special_tokens={})
        self.special = {t: np.array([i], "<u4").tobytes() for t, i in added.items()}
        self.special_re = re.compile("(" + "|".join(map(re.escape, added)) + ")") if added else None

    def _ids(self, text: str) -> bytes:
        return np.array(self.bpe.encode_ordinary(text), "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """Little-endian 32-bit ids of a text, without an end id."""
        if self.special_re is None or not self.special_re.search(text):
            return self._ids(text)
        return b"".join(self.special.get(part) or self._ids(part) for part in self.special_re.split(text) if part)


class Packer:
    """Packs the remainders of documents; pieces are (document, start, length)."""

    def __init__(self, tiers: Sequence[int]):
        self.tiers = tuple(sorted(tiers))
        self.waiting: list[list[tuple[int, int, int]]] = [[] for _ in self.tiers]  # by tier: (length, document, start), sorted

    def add(self, document: int, length: int) -> Iterator[tuple[int, list[tuple[int, int, int]]]]:
        """Yield the full windows of the longest tier; the rest waits."""
        top, start = self.tiers[-1], 0
        while length - start >= top:
            yield top, [(document, start, top)]
            start += top
        if length > start:
            self._wait(document, start, length - start)

    def _wait(self, document: int, start: int, length: int) -> None:
        tier = next(k for k, t in enumerate(self.tiers) if t >= length)
        insort(self.waiting[tier], (length, document, start))

    def _longest(self, tier: int, gap: int) -> tuple[int, int, int] | None:
        """Take the longest waiting document of at most ``gap`` tokens, of this tier or a shorter one."""
        for k in range(tier, -1, -1):
            if at := bisect_right(self.waiting[k], (gap, float("inf"), 0)):
                return self.waiting[k].pop(at - 1)
        return None

    def _shortest_over(self, tier: int) -> tuple[int, int, int] | None:
        for w in self.waiting[: tier + 1]:
            if w:
                return w.pop(0)
        return None

    def pack(self, last: bool) -> Iterator[tuple[int, list[tuple[int, int, int]]]]:
        """Windows (size, pieces) of what waits, longest tier first. Only ``last`` gives a window that is not full."""
        for tier in range(len(self.tiers) - 1, -1, -1):
            size = self.tiers[tier]
            while self.waiting[tier]:
                if not last and sum(n for w in self.waiting[: tier + 1] for n, _, _ in (w[-8:] if len(w) > 8 else w)) < 2 * size:
                    return  # too little is left to fill a window; it waits for more documents
                length, document, start = self.waiting[tier].pop()
                pieces, gap = [(document, start, length)], size - length
                while gap and (got := self._longest(tier, gap)):
                    pieces.append((got[1], got[2], got[0]))
                    gap -= got[0]
                if gap and (got := self._shortest_over(tier)):
                    length, document, start = got
                    pieces.append((document, start, gap))
                    self._wait(document, start + gap, length - gap)
                    gap = 0
                yield size, pieces


SCHEMA = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()),
                    ("tier", pa.int32()), ("step_id", pa.int64()), ("ids", pa.list_(pa.int32()))])
DDL = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, tier int, step_id bigint, ids array<int>"


@functools.lru_cache(2)
def _encoder(path: str) -> Encoder:
    return Encoder(path)


def pack(docs: DataFrame, vocabulary: str, *, tiers: Sequence[int] = TIERS, end_id: int = END_ID, step_tokens: int = STEP_TOKENS, with_ids: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: where it comes from, its checksum and ids, its sequence, offset, tier and step group.

    Null and empty texts consist of the end id alone. Repeated rows are packed each on their own, and a null id stays
    null. An empty table gives no rows; extra columns are not read. ``tier`` is the padded length of the sequence: its
    own length where that is a power of two, else the longest tier.
    """
    if any(t & (t - 1) or step_tokens % t for t in tiers):
        raise ValueError("tiers must be powers of two that divide step_tokens")
    end = np.array([end_id], "<u4").tobytes()

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, packer, top = _encoder(vocabulary), Packer(tiers), max(tiers)
        base = TaskContext.get().partitionId() << 40
        sequences, steps, numbers = count(base), count(base), count()
        docs: dict[int, tuple[int | None, bytes]] = {}
        left: dict[int, int] = {}
        step: dict[int, tuple[int, int]] = {}  # by tier: (step, tokens in it)
        rows: dict[str, list] = {f.name: [] for f in SCHEMA}

        def emit(windows: Iterator) -> None:
            for size, pieces in windows:
                used = sum(p[2] for p in pieces)
                tier = used if used & (used - 1) == 0 else top
                at, filled = step.get(tier, (None, step_tokens))
                if filled + tier > step_tokens:
                    at, filled = next(steps), 0
                step[tier] = (at, filled + tier)
                sequence, offset = next(sequences), 0
                for document, start, length in pieces:
                    doc_id, ids = docs[document]
                    part = ids[4 * start : 4 * (start + length)]
                    for name, value in zip(rows, (doc_id, start, length, zlib.crc32(part), len(ids) // 4, sequence, offset, tier, at, np.frombuffer(part, "<i4") if with_ids else None), strict=True):
                        rows[name].append(value)
                    offset += length
                    left[document] -= length
                    if not left[document]:
                        del docs[document], left[document]

        def flush() -> pa.RecordBatch:
            out = batch(rows, SCHEMA)
            for v in rows.values():
                v.clear()
            return out

        for rb in it:
            texts = rb.column(1).to_pylist()
            ids = rb.column(0).to_pylist()
            for a, b in blocks(texts, BLOCK):
                for doc_id, text in zip(ids[a:b], texts[a:b], strict=True):
                    coded, number = encoder.encode(text), next(numbers)
                    docs[number] = (doc_id, coded + end)
                    left[number] = len(coded) // 4 + 1
                    emit(packer.add(number, left[number]))
                emit(packer.pack(last=False))
                if rows["doc_id"]:
                    yield flush()
        emit(packer.pack(last=True))
        if rows["doc_id"]:
            yield flush()

    out = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), col_or_empty(text_col).alias("text")).mapInArrow(run, DDL)
    return out if with_ids else out.drop("ids")


@query("op3_packing")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), with_ids=False)
