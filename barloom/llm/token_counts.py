"""Token counts by a compiled finite-state transducer.

The tokenizer of a word-end BPE file is taken apart into two deterministic transducers:

* the *splitter* reads characters as classes and has seven states; each transition says whether a pre-token starts at
  the character read (or one character before it, for an apostrophe that turned out not to be a contraction);
* the *word* transducer maps a finished pre-token to the number of tokens it emits. It is determinised lazily: words
  are compiled by the library when they are first met and kept as word -> count.

Texts are laid end to end, cut into rows of ``WIDTH`` characters, and every row computes, in lock step with all other
rows, the state it would end in for **every** entry state. These maps compose: a parallel prefix scan (doubling) gives
each row's true entry state, and a second lock-step pass emits the annotations.
"""

from __future__ import annotations

import functools
import os
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.common import batch, blocks, col_or_empty, query, table

# Fixed values of the tokenizer's pre-token pattern.
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")

# character classes
RESET, SPACE, NUMBER, OTHER, APOSTROPHE, LETTER, L_STMD, L_R, L_V, L_L, L_E = range(11)
# states: between pre-tokens; in letters; in other characters; after a leading apostrophe; after 'r, 'v, 'l
BETWEEN, IN_LETTERS, IN_OTHER, QUOTE, QUOTE_R, QUOTE_V, QUOTE_L = range(7)
N_STATES = 7
START, LATE = 1, 2  # a pre-token starts at this character; one starts at the character before

WIDTH = 128
BLOCK = 1 << 20
ODD_SPACE = re.compile("[\x0b\x0c\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


def _letter(cls: int) -> bool:
    return cls >= LETTER


def compile_splitter() -> tuple[np.ndarray, np.ndarray]:
    """(next state, annotation) by state and character class."""
    nxt = np.zeros((N_STATES, 11), np.uint8)
    out = np.zeros((N_STATES, 11), np.uint8)

    def fresh(cls: int) -> tuple[int, int]:
        if cls in (RESET, SPACE):
            return BETWEEN, 0
        if cls == NUMBER:
            return BETWEEN, START
        if cls == OTHER:
            return IN_OTHER, START
        if cls == APOSTROPHE:
            return QUOTE, START
        return IN_LETTERS, START

    for cls in range(11):
        for state in range(N_STATES):
            to, mark = fresh(cls)
            if state == IN_LETTERS and _letter(cls):
                to, mark = IN_LETTERS, 0
            elif state == IN_OTHER and cls in (OTHER, APOSTROPHE):
                to, mark = IN_OTHER, 0
            elif state == QUOTE:
                if cls in (OTHER, APOSTROPHE):
                    to, mark = IN_OTHER, 0
                elif cls == L_STMD:
                    to, mark = BETWEEN, 0
                elif cls in (L_R, L_V, L_L):
                    to, mark = {L_R: QUOTE_R, L_V: QUOTE_V, L_L: QUOTE_L}[cls], 0
            elif state in (QUOTE_R, QUOTE_V, QUOTE_L):
                if cls == (L_L if state == QUOTE_L else L_E):
                    to, mark = BETWEEN, 0
                elif _letter(cls):
                    to, mark = IN_LETTERS, LATE
                else:
                    mark |= LATE
            nxt[state, cls], out[state, cls] = to, mark
    return nxt, out


@functools.cache
def char_classes() -> np.ndarray:
    """Class of every code point, after lower-casing."""
    cls = np.full(0x110000, OTHER, np.uint8)
    everything = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for pattern, c in ((r"\p{White_Space}+", SPACE), (r"\p{N}+", NUMBER), (r"\p{L}+", LETTER)):
        for m in regex.finditer(pattern, everything):
            a, b = ord(everything[m.start()]), ord(everything[m.end() - 1])
            cls[a : b + 1] = c
    cls[ord("'")] = APOSTROPHE
    for chars, c in (("stmd", L_STMD), ("r", L_R), ("v", L_V), ("l", L_L), ("e", L_E)):
        for ch in chars:
            cls[ord(ch)] = c
    return cls


def entry_states(classes: np.ndarray, nxt: np.ndarray) -> np.ndarray:
    """State before each row of ``classes`` (rows x WIDTH): lock-step maps of all states, composed by a prefix scan."""
    rows = classes.shape[0]
    maps = np.tile(np.arange(N_STATES, dtype=np.uint8), (rows, 1))
    flat = nxt.ravel()
    columns = np.ascontiguousarray(classes.T)
    for j in range(classes.shape[1]):
        maps = flat[maps * np.uint8(11) + columns[j][:, None]]
    step = 1
    while step < rows:  # inclusive scan: maps[i] becomes the map of rows 0..i
        maps[step:] = np.take_along_axis(maps[step:], maps[:-step].copy(), axis=1)
        step *= 2
    entry = np.empty(rows, np.uint8)
    entry[0] = BETWEEN
    entry[1:] = maps[:-1, BETWEEN]
    return entry


def splits(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of pre-tokens in a lower-cased text (NUL = reset)."""
    nxt, out = _SPLITTER
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    n = len(codes)
    rows = -(-n // WIDTH)
    cls = np.zeros(rows * WIDTH, np.uint8)
    cls[:n] = char_classes()[codes]
    cls[:n][codes == 0] = RESET
    cls = cls.reshape(rows, WIDTH)
    state = entry_states(cls, nxt)
    marks = np.empty((WIDTH, rows), np.uint8)
    columns = np.ascontiguousarray(cls.T)
    fn, fo = nxt.ravel(), out.ravel()
    for j in range(WIDTH):
        at = state * np.uint8(11) + columns[j]
        marks[j] = fo[at]
        state = fn[at]
    marks = marks.T.ravel()
    start = (marks & START).astype(bool)
    start[:-1] |= (marks[1:] & LATE).astype(bool)
    starts = np.flatnonzero(start[:n])
    last = np.maximum.accumulate(np.where(cls.ravel()[:n] > SPACE, np.arange(1, n + 1, dtype=np.int32), 0))
    return starts, last[np.append(starts[1:], n) - 1] if len(starts) else starts


_SPLITTER = compile_splitter()


class TokenCounter:
    """Counts tokens of whole texts as the library does, from its own vocabulary file."""

    def __init__(self, path: str, cache: int = 400_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.special_re = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        self.words: dict[str, int] = {}
        self.cache = cache

    def normal(self, text: str) -> str:
        """NFC, white space as single spaces, lower case by character (no context rule for final sigma)."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            if "Σ" in text:
                text = text.replace("Σ", "σ")
        for c in "\n\t\r":
            text = text.replace(c, " ")
        return ODD_SPACE.sub(" ", text).lower()

    def compile(self, words: list[str]) -> None:
        if len(self.words) > self.cache:
            self.words = {}
        for a in range(0, len(words), 20_000):
            part = words[a : a + 20_000]
            for w, e in zip(part, self.tok.encode_batch_fast(part, add_special_tokens=False), strict=True):
                self.words[w] = len(e.ids)

    def _run(self, parts: list[str]) -> np.ndarray:
        """Token counts of segments without special strings."""
        total = np.zeros(len(parts), np.int64)
        joined = "\0".join(parts)
        starts, ends = splits(joined)
        if not len(starts):
            return total
        found = [joined[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        while None in (counts := list(map(self.words.get, found))):  # again if the table was cleared meanwhile
            self.compile(list({w for w, c in zip(found, counts, strict=True) if c is None}))
        lengths = np.fromiter(map(len, parts), np.int64, len(parts)) + 1
        owner = np.searchsorted(np.cumsum(lengths), starts, side="right")
        total += np.bincount(owner, np.array(counts, np.float64), len(parts)).astype(np.int64)
        return total

    def count(self, texts: list[str]) -> list[int]:
        counts = [0] * len(texts)
        for a, b in blocks(texts, BLOCK):
            parts, owner = [], []
            for i in range(a, b):
                text, pos = texts[i], 0
                if self.special_re and "<|" in text:
                    for m in self.special_re.finditer(text):
                        counts[i] += 1
                        parts.append(text[pos : m.start()])
                        owner.append(i)
                        pos = m.end()
                parts.append(text[pos:] if pos else text)
                owner.append(i)
            parts = [self.normal(p) for p in parts]
            odd = [k for k, p in enumerate(parts) if "\0" in p]  # NUL is the reset mark; such a segment is rewritten
            for k in odd:
                parts[k] = parts[k].replace("\0", "\x01")
            for i, n in zip(owner, self._run(parts), strict=True):
                counts[i] += int(n)
        return counts


@functools.lru_cache(2)
def _counter(path: str) -> TokenCounter:
    return TokenCounter(path)


SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])


def token_counts(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens) of every row; no shuffle.

    Null text counts as empty (0 bytes, 0 tokens), repeated rows are counted each on their own, a null id stays null,
    an empty table gives no rows and extra columns are not read.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(vocabulary)
        for rb in it:
            ids, texts = rb.column(0), rb.column(1).to_pylist()
            for a in range(0, len(texts), 2_000):
                part = texts[a : a + 2_000]
                yield batch({"doc_id": ids[a : a + 2_000], "n_bytes": [len(t.encode()) for t in part], "n_tokens": counter.count(part)}, SCHEMA)

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), col_or_empty(text_col).alias("text")).mapInArrow(run, "doc_id bigint, n_bytes bigint, n_tokens bigint")


@query("op9_token_counts")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    counted = token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return counted.withColumn("over_limit", F.col("n_tokens") > 2048)
