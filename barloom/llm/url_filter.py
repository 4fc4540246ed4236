"""URL filter: a sorted array of 64-bit digests, memory-mapped and probed with vectorised binary search.

A rule is a host and a path prefix, written ``host + path``; it fits its host and all subdomains of it where the path
of the URL starts with the rule's path. The rules' strings are hashed with xxHash64 and stored as one file: sorted
digests, string offsets, then the strings themselves. Every task maps that file read-only and, for each URL, looks up
the digests of all (host suffix, path prefix) pairs whose path length occurs among the rules. A hit counts only if
the stored string equals the probe, so a collision of digests changes nothing. The longest fitting rule wins.

Files reach the executors through ``SparkContext.addFile``. One file holds at most ``MAX_RULES`` rules; a longer list
is cut into several such files by digest, and every URL is probed in each of them, one file after another.
"""

from __future__ import annotations

import functools
import os
import tempfile
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.common import batch, query, table

MAX_RULES = 2_000_000

# The rules of the registered query, as (verdict, host, path).
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)


def write_digests(rules: Sequence[tuple[str, str, str]], path: str) -> None:
    """One file: n, path lengths, digests (sorted), verdicts, offsets, strings."""
    by_text: dict[bytes, bool] = {}
    for verdict, host, prefix in rules:
        key = (host.lower() + prefix).encode()
        by_text[key] = by_text.get(key, True) and verdict == "allow"  # the same rule twice: block wins
    keys = sorted(by_text, key=lambda k: (xxhash.xxh64_intdigest(k), k))
    lengths = sorted({len(p.encode()) for _, _, p in rules})
    with open(path, "wb") as f:
        f.write(np.array([len(keys), len(lengths)], "<i8").tobytes())
        f.write(np.array(lengths, "<i8").tobytes())
        f.write(np.array([xxhash.xxh64_intdigest(k) for k in keys], "<u8").tobytes())
        f.write(np.cumsum([0, *map(len, keys)], dtype="<i8").tobytes())
        f.write(np.array([by_text[k] for k in keys], "u1").tobytes())
        f.write(b"".join(keys))


class DigestArray:
    """A mapped digest file."""

    def __init__(self, path: str):
        raw = np.memmap(path, np.uint8, "r")
        n, k = raw[:16].view("<i8").tolist()
        self.lengths = raw[16 : 16 + 8 * k].view("<i8").tolist()
        at = 16 + 8 * k
        self.digests = raw[at : at + 8 * n].view("<u8")
        at += 8 * n
        self.offsets = raw[at : at + 8 * (n + 1)].view("<i8")
        at += 8 * (n + 1)
        self.allow = raw[at : at + n]
        self.text = raw[at + n :]

    def probe(self, keys: list[bytes]) -> np.ndarray:
        """Index of each key among the rules, or -1."""
        found = np.full(len(keys), -1, np.int64)
        if not keys or not len(self.digests):
            return found
        want = np.fromiter(map(xxhash.xxh64_intdigest, keys), np.uint64, len(keys))
        at = np.searchsorted(self.digests, want)
        hit = np.flatnonzero((at < len(self.digests)) & (self.digests[np.minimum(at, len(self.digests) - 1)] == want))
        for i in hit.tolist():
            j = int(at[i])
            while j < len(self.digests) and self.digests[j] == want[i]:  # rules of one digest stand together
                if self.text[self.offsets[j] : self.offsets[j + 1]].tobytes() == keys[i]:
                    found[i] = j
                    break
                j += 1
        return found


def candidates(host: bytes, path: bytes, lengths: Sequence[int]) -> list[bytes]:
    """Every rule text that would fit, for the path lengths that occur."""
    suffixes, pos = [host], host.find(b".")
    while pos >= 0:
        suffixes.append(host[pos + 1 :])
        pos = host.find(b".", pos + 1)
    prefixes = [path[:n] for n in lengths if n <= len(path)]
    return [s + p for s in suffixes if s for p in prefixes]


@functools.lru_cache(8)
def _digests(name: str) -> DigestArray:
    return DigestArray(SparkFiles.get(name))


def _distribute(spark: SparkSession, rules: Sequence[tuple[str, str, str]]) -> list[str]:
    parts = -(-max(1, len(rules)) // MAX_RULES)
    names = []
    for k in range(parts):
        name = f"digests-{uuid.uuid4().hex}"
        folder = tempfile.mkdtemp()
        part = [r for r in rules if xxhash.xxh64_intdigest((r[1].lower() + r[2]).encode()) % parts == k]
        write_digests(part, os.path.join(folder, name))
        spark.sparkContext.addFile(os.path.join(folder, name))
        names.append(name)
    return names


def _split_url(url) -> tuple:
    """Host and path columns of a URL."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substr(url, instr(url, '://') + 3)")).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


SCHEMA = pa.schema([("page_id", pa.int64()), ("host", pa.string()), ("path", pa.string()), ("rule", pa.string()), ("verdict", pa.string())])


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]], default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict) of every row; no shuffle.

    ``default`` is the verdict where no rule fits: a URL that is not in the digest array is not filtered. Null URLs and
    those without ``://`` have empty host and path and fit no rule. Repeated rows are judged each on their own; ties
    cannot occur, since two different rules of one length that both fit one URL would need one host and path split
    two ways, and then the longer host wins. An empty table or an empty rule list is fine.
    """
    spark = pages.sparkSession
    names = _distribute(spark, rules)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays = [_digests(n) for n in names]
        for rb in it:
            hosts, paths = rb.column(1).to_pylist(), rb.column(2).to_pylist()
            rule: list[str | None] = [None] * len(hosts)
            verdict = [default] * len(hosts)
            best = [(-1, -1)] * len(hosts)
            for d in arrays:
                keys, owner, size = [], [], []
                for i, (h, p) in enumerate(zip(hosts, paths, strict=True)):
                    hb = h.encode()
                    got = candidates(hb, p.encode(), d.lengths)
                    keys += got
                    owner += [i] * len(got)
                for k in np.flatnonzero((at := d.probe(keys)) >= 0).tolist():
                    i, key = owner[k], keys[k]
                    size = (len(key), key.find(b"/"))
                    if size > best[i]:
                        best[i], rule[i], verdict[i] = size, key.decode(errors="replace"), "allow" if d.allow[at[k]] else "block"
            yield batch({"page_id": rb.column(0), "host": hosts, "path": paths, "rule": rule, "verdict": verdict}, SCHEMA)

    url = F.col("url")
    host, path = _split_url(url)
    split = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).cast("string").alias("url")).select("page_id", host.alias("host"), path.alias("path"))
    return split.mapInArrow(run, "page_id bigint, host string, path string, rule string, verdict string")


SQL = r"""
WITH parts AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), split AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM parts
), rules(verdict, rhost, rpath) AS (
  VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')
), fits AS (
  SELECT page_id, host, path, rhost || rpath AS rule, verdict FROM split JOIN rules
    ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
), best AS (
  SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict FROM fits GROUP BY page_id
)
SELECT s.page_id, s.host, s.path, b.rule, coalesce(b.verdict, 'allow') AS verdict FROM split s LEFT JOIN best b USING (page_id)
"""


@query("op10_url_filter", SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"), RULES)
