"""Session settings shared by the bench, the tests and notebooks."""

from __future__ import annotations

import math
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(app: str = "barloom", cpus: int | str = "*", partitions: int = 8) -> SparkSession:
    """A local session with the options the engine expects. On a cluster, use the session you are given."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder so that later jobs do not recompute it.

    The folder named by ``spark.checkpoint.dir`` is used. Only a session on one machine (tests, the bench) may leave
    it unset and gets a temporary folder; on a cluster that is an error.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return df.checkpoint(eager=True)


def by_size(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """Store a table of group values that a larger one joins, and send it to all tasks if it has at most ``rows`` rows.

    The optimizer has no size of a stored table and would shuffle the larger side by a few groups.
    """
    df = cut(df)
    return F.broadcast(df) if df.count() <= rows else df


def spread(df: DataFrame, *keys: str, rows: int = 10_000, like: DataFrame | None = None) -> DataFrame:
    """Deal ``df`` out by ``keys`` into tasks of about ``rows`` rows (of ``like``, if given), however few files it comes from.

    For narrow tables whose rows are expanded or computed on at length: their file alone would be one or two tasks. What
    follows by the same keys needs no further shuffle.
    """
    total = (df if like is None else like).count()
    return df.repartition(max(1, math.ceil(total / rows)), *keys)
