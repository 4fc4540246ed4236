"""Burrows-Wheeler transforms of shards and their merge by iterative interleave refinement."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Shard:
    """The transform of a collection of distinct strings laid end to end, each closed by symbol 0.

    ``bwt`` is the symbol before each suffix in suffix order (bytes are shifted up by one); ``starts`` says where in
    the laid-out collection each suffix starts, to name results.
    """

    bwt: np.ndarray
    starts: np.ndarray


def lay_out(strings: list[bytes]) -> np.ndarray:
    """Symbols of the collection."""
    sizes = np.array([len(s) for s in strings], np.int64)
    text = np.zeros(int(sizes.sum()) + len(strings), np.uint16)
    inside = np.ones(len(text), bool)
    inside[np.cumsum(sizes + 1) - 1] = False
    text[inside] = np.frombuffer(b"".join(strings), np.uint8).astype(np.uint16) + 1
    return text


def transform(strings: list[bytes]) -> Shard:
    """Sort the circular suffixes of one shard by doubling and read off its transform."""
    text = lay_out(strings)
    n = len(text)
    key = np.zeros(n, np.int64)
    for k in range(6):  # nine bits a symbol
        key = (key << 9) | np.roll(text, -k)
    order = np.argsort(key)  # the order within a class doesn't matter: in the end every class is one suffix
    h = 6
    while True:
        sorted_key = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.append(0, sorted_key[1:] != sorted_key[:-1]))
        if h >= n or rank[order[-1]] == n - 1:
            break
        key = rank * n + np.roll(rank, -h)
        order = np.argsort(key)
        h *= 2
    return Shard(text[order - 1], order)


def merged_classes(a: Shard, b: Shard, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Class of each suffix of ``a`` and of ``b``, equal where the first ``depth`` symbols are equal.

    Works on the transforms alone. The inverse of a transform leads from each suffix to the one a symbol later. The
    interleave of the two suffix orders is first known by one symbol; a round refines it from the first h symbols to
    the first 2h, since a suffix's place is given by its class at h and the class, at h, of the suffix h symbols
    later. Both sides are already in order, so a round merges two sorted lists; no suffix is sorted again. The
    borders between classes are where the common prefix of neighbours is shorter than h.
    """
    step_a, step_b = np.argsort(a.bwt, kind="stable"), np.argsort(b.bwt, kind="stable")
    class_a, class_b = a.bwt[step_a].astype(np.int64), b.bwt[step_b].astype(np.int64)
    h = 1
    while h < depth:
        ahead = min(h, depth - h)
        if ahead == h:
            to_a, to_b = step_a, step_b
        else:  # the last round overlaps: the two parts together cover the first ``depth`` symbols
            to_a, to_b = _power(a, ahead), _power(b, ahead)
        scale = int(max(class_a[-1] if len(class_a) else 0, class_b[-1] if len(class_b) else 0)) + 1
        key_a, key_b = class_a * scale + class_a[to_a], class_b * scale + class_b[to_b]
        class_a, class_b = _interleave(key_a, key_b)
        if ahead == h:
            step_a, step_b = step_a[step_a], step_b[step_b]
        h += ahead
    return class_a, class_b


def _power(s: Shard, k: int) -> np.ndarray:
    """Where each suffix's place is, ``k`` symbols later."""
    step, out = np.argsort(s.bwt, kind="stable"), np.arange(len(s.bwt))
    while k:
        if k & 1:
            out = step[out]
        step, k = step[step], k >> 1
    return out


def _interleave(key_a: np.ndarray, key_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Merge two sorted lists of keys and number the distinct ones."""
    at_a = np.arange(len(key_a)) + np.searchsorted(key_b, key_a, "left")
    at_b = np.arange(len(key_b)) + np.searchsorted(key_a, key_b, "right")
    merged = np.empty(len(key_a) + len(key_b), np.int64)
    merged[at_a], merged[at_b] = key_a, key_b
    number = np.cumsum(np.append(0, merged[1:] != merged[:-1])[: len(merged)])
    return number[at_a], number[at_b]


def repeated_starts(strings: list[bytes], length: int) -> list[np.ndarray]:
    """For each of distinct strings, whether the ``length`` bytes from each start (there are len - length + 1) also
    start anywhere else in the collection."""
    parts = [list(range(k, len(strings), 2)) for k in (0, 1)]
    shards = [transform([strings[i] for i in p]) if p else Shard(np.empty(0, np.uint16), np.empty(0, np.int64)) for p in parts]
    classes = merged_classes(*shards, length)
    valid = []
    for p, s in zip(parts, shards, strict=True):
        sizes = np.array([len(strings[i]) + 1 for i in p], np.int64)
        ends = np.cumsum(sizes)
        room = np.repeat(ends, sizes) - np.arange(int(sizes.sum()))  # symbols up to and with the closing one
        valid.append((room > length)[s.starts])
    count = np.bincount(np.concatenate([c[v] for c, v in zip(classes, valid, strict=True)]), minlength=1)
    out: list[np.ndarray] = [np.empty(0, bool)] * len(strings)
    for p, s, c, v in zip(parts, shards, classes, valid, strict=True):
        hit = np.zeros(len(s.starts), bool)
        hit[s.starts[v]] = count[c[v]] >= 2
        at = 0
        for i in p:
            out[i] = hit[at : at + max(0, len(strings[i]) - length + 1)]
            at += len(strings[i]) + 1
    return out
