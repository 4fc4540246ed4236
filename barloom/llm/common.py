"""Shared helpers: stored tables, Arrow batches as Python lists, bounded blocks of texts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)`` under ``name``, with SQL where SQL can express it."""

    def wrap(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which driver and executors share.

    Only a ``local`` session, as in tests, may go without: it gets a temporary folder. On a cluster an unset
    folder is an error, because a machine-local one would lose the files of other machines.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(folder)
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


def store(df: DataFrame, *, append_to: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = append_to or f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.mode("append").option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def store_bucketed(df: DataFrame, key: str) -> DataFrame:
    """As ``store``, in as many buckets of ``key`` as a shuffle has partitions: what is grouped by ``key`` later stays where it is."""
    spark = df.sparkSession
    name = f"table_{uuid.uuid4().hex}"
    df.write.option("path", f"{shared_dir(spark)}/{name}").option("compression", "zstd").bucketBy(merge_partitions(spark), key).saveAsTable(name, format="parquet")
    return spark.table(name)


def new_table(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"


def drop_table(df: DataFrame) -> None:
    """Delete the files of a table made by ``store`` that nothing reads any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for file in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/table-" not in file:
            raise ValueError(f"not a stored table: {file}")
        path = jvm.org.apache.hadoop.fs.Path(file)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def unused(name: str, df: DataFrame) -> str:
    """A column name like ``name`` that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def merge_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def blocks(texts: Sequence[str | None], limit: int) -> Iterator[tuple[int, int]]:
    """Runs [a, b) of ``texts`` of at most ``limit`` characters each; a longer text is alone in its run."""
    a, n = 0, 0
    for i, t in enumerate(texts):
        k = len(t) if t else 0
        if i > a and n + k > limit:
            yield a, i
            a, n = i, 0
        n += k
    if a < len(texts):
        yield a, len(texts)


def mix(h: np.ndarray) -> np.ndarray:
    """Finalising mixer of 64-bit hashes (xor-shift-multiply)."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x9E3779B97F4A7C15)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def ngram_hash(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the ``n``-grams of a sequence of 64-bit word hashes; empty if it is shorter."""
    if len(words) < n:
        return np.empty(0, np.uint64)
    h = words[: len(words) - n + 1].copy()
    for k in range(1, n):
        h = mix(h) + words[k : len(words) - n + 1 + k]
    return mix(h)


def batch(columns: dict[str, object], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in schema], schema=schema)


def col_or_empty(name: str = "text"):
    return F.coalesce(F.col(name).cast("string"), F.lit(""))
