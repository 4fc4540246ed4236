"""Exact top-k inner products by multi-resolution segment statistics.

Vectors are cut into segments at several resolutions (1, 4, 16 segments). With mean and spread of every segment, the
inner product of a query and a candidate is at most the sum over segments of ``n * (mean * mean + spread * spread)``
(Cauchy-Schwarz on the centred parts). That is the form, for inner products, of a lower bound on distance. Bounds
are evaluated from coarse to fine; a pair survives while its bound reaches the query's k-th best score so far, and
survivors are scored exactly with integers. The first candidates of a task only set that k-th best score.

Queries are held in blocks of at most ``QUERY_BLOCK`` vectors; each block is sent to all tasks, each task returns its
own best k per query, and a last aggregation keeps the best k of all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.llm.common import batch, new_table, query, store, table

SCALE = 1024
SEGMENTS = (1, 4, 16)
QUERY_BLOCK = 2048
CHUNK = 1024
SLACK = 1e-6
#: Products of components below this, summed over any sensible dimension, are exact in 64-bit integers. Vectors with larger
#: ones survive every bound and are scored with Python's integers.
LARGEST = 2.0**24


def segments(n: int, parts: int) -> list[tuple[int, int]]:
    edges = np.linspace(0, n, min(parts, n) + 1).astype(int)
    return list(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True))


def statistics(x: np.ndarray, parts: int) -> np.ndarray:
    """Means and spreads of the segments, both times the root of the segment's length: a bound is a plain product."""
    out = []
    for a, b in segments(x.shape[1], parts):
        s = x[:, a:b].astype(np.float64)
        out += [s.mean(axis=1) * np.sqrt(b - a), s.std(axis=1) * np.sqrt(b - a)]
    return np.stack(out, axis=1)


class Best:
    """The best k of each query so far: by score, then by smaller id."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.score = [np.empty(0, np.int64) for _ in range(queries)]
        self.ids = [np.empty(0, np.int64) for _ in range(queries)]
        self.least = np.full(queries, -np.inf)

    def add(self, q: int, ids: np.ndarray, scores: np.ndarray) -> None:
        ids, scores = np.concatenate([self.ids[q], ids]), np.concatenate([self.score[q], scores])
        order = np.lexsort((ids, -scores))[: self.k]
        self.ids[q], self.score[q] = ids[order], scores[order]
        if len(order) == self.k:
            self.least[q] = scores[order[-1]]


def search(query_ids: np.ndarray, queries: np.ndarray, stats: list[np.ndarray], ids: np.ndarray, rows: np.ndarray, best: Best) -> None:
    """Offer the candidates to every query; only those whose bound reaches the query's k-th score are scored."""
    alive = np.ones((len(queries), len(rows)), bool)
    full = np.isfinite(best.least)
    if full.any():
        for parts, of_queries in zip(SEGMENTS, stats, strict=True):
            of_rows = statistics(rows, parts)
            qi, ri = np.nonzero(alive) if parts > 1 else (None, None)
            if qi is None or len(qi) > alive.size // 8:
                bound = of_queries @ of_rows.T
                alive &= bound + np.abs(bound) * SLACK + SLACK >= best.least[:, None]
            else:
                bound = np.einsum("ij,ij->i", of_queries[qi], of_rows[ri])
                alive[qi, ri] = bound + np.abs(bound) * SLACK + SLACK >= best.least[qi]
    wide_query, wide_row = ((np.abs(x) >= LARGEST).any(axis=1) for x in (queries, rows))
    alive |= wide_query[:, None] | wide_row[None, :]
    alive &= query_ids[:, None] != ids[None, :]
    for q in np.flatnonzero(alive.any(axis=1)).tolist():
        at = np.flatnonzero(alive[q])
        scores = rows[at] @ queries[q]
        if len(wide := np.flatnonzero(wide_row[at] | wide_query[q])):
            scores[wide] = (rows[at[wide]].astype(object) @ queries[q].astype(object)).tolist()  # fails beyond a bigint
        best.add(q, ids[at], scores)


SCHEMA = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v): integer vectors of the rows whose components are all there and finite."""
    whole = lambda x: F.when(F.abs(x) < 2.0**63, F.floor(x)).otherwise(F.raise_error(F.lit("a scaled component is beyond a bigint")).cast("bigint"))
    scaled = F.transform(F.col(vector_col), lambda x: whole(x.cast("double") * SCALE))
    good = F.forall(F.col(vector_col), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return vectors.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).where(good & (F.size(vector_col) > 0)).select(F.col(id_col).cast("bigint").alias("vec_id"), scaled.alias("v"))


def _matrices(rb: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, integer matrix) of the rows of each dimension."""
    ids, lists = rb.column(0).to_numpy(), rb.column(1)
    flat, offsets = lists.flatten().to_numpy().astype(np.int64), np.append(0, np.cumsum(lists.value_lengths().to_numpy()))
    sizes = np.diff(offsets)
    for n in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == n)
        yield ids[at], flat[offsets[at][:, None] + np.arange(n)]


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest inner products over ``vectors``, ties to the smaller id.

    A row never matches a query of its own id. Rows that are null or hold a null or non-finite component, or no
    component, take no part, neither do rows of another dimension than the query's. A component or score beyond a
    bigint is an error, as in SQL. Repeated ids are candidates each on their own. With fewer than k candidates a query gets fewer rows; empty tables give none.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, id_col, vector_col)
    asked = store(usable(queries, id_col, vector_col).withColumn("block", F.floor((F.row_number().over(Window.partitionBy(F.pmod(F.xxhash64("vec_id"), F.lit(64))).orderBy("vec_id", "v")) - 1) * 64 / QUERY_BLOCK)))
    path = new_table(spark)
    found = spark.createDataFrame([], "query_id bigint, vec_id bigint, score bigint")
    for (block,) in sorted(asked.select("block").distinct().collect()):
        held = asked.where(F.col("block") == block).select("vec_id", "v").toPandas()
        if len(held) > 4 * QUERY_BLOCK:
            raise ValueError("too many repeated query ids for one block")
        by_size = {}
        for n, part in held.groupby(held.v.map(len)):
            x = np.array(part.v.tolist(), np.int64)
            by_size[int(n)] = (part.vec_id.to_numpy(np.int64), x, [statistics(x, p) for p in SEGMENTS])
        sent = spark.sparkContext.broadcast(by_size)

        def run(it: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            best = {n: Best(len(q[0]), k) for n, q in sent.value.items()}
            for rb in it:
                for ids, x in _matrices(rb):
                    if (n := x.shape[1]) in best:
                        for a in range(0, len(ids), CHUNK):
                            search(*sent.value[n], ids[a : a + CHUNK], x[a : a + CHUNK], best[n])
            for n, b in best.items():
                size = [len(i) for i in b.ids]
                if sum(size):
                    yield batch({"query_id": np.repeat(sent.value[n][0], size), "vec_id": np.concatenate(b.ids), "score": np.concatenate(b.score)}, SCHEMA)

        found = store(rows.mapInArrow(run, "query_id bigint, vec_id bigint, score bigint"), append_to=path)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


SQL = """
WITH usable AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM usable q JOIN usable c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id AND len(q.v) = len(c.v)
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM pairs
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""


@query("op2_topk", SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.where(F.col("vec_id") % 100 == 0))
