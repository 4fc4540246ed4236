"""Bars from a stream of ticks, and the late-data refresh as a stream.

These are the streaming twins of the batch bar build and of the overlap refresh; late ticks are
accepted up to the watermark, older ones are dropped by Spark.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

c = F.col


def stream_bars(ticks: DataFrame, width: str = "30 minutes", late: str = "1 hour", code: str = "code") -> DataFrame:
    """(code, ts, order id, price, volume) -> one bar per window, emitted once the watermark passes it."""
    order = F.unix_micros("ts").cast("decimal(20,0)") * F.lit(10 ** 15).cast("decimal(16,0)") + c("seq").cast("decimal(16,0)")
    d = ticks.withWatermark("ts", late).select(code, "ts", "price", "volume", order.alias("ord"))
    bars = d.groupBy(code, F.window("ts", width)).agg(
        F.min_by("price", "ord").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "ord").alias("close"),
        F.sum("volume").alias("volume"), F.sum(c("price") * c("volume")).alias("amount"))
    return bars.select(code, c("window.start").alias("ts"), "open", "high", "low", "close", "volume", "amount")


def stream_refresh(rows: DataFrame, keys: Sequence[str] = ("code", "ts"), late: str = "7 days", order: str = "ingested") -> DataFrame:
    """The last row of every key by ``order`` inside the watermark, given again whenever a correction arrives.

    For output mode ``update`` and a sink that replaces rows by key, such as ``month_sink``. ``ts`` is one of the keys,
    so the state of a key goes once the watermark passes it.
    """
    last = F.max_by(F.struct(*[x for x in rows.columns if x not in keys]), order).alias("_last")
    return rows.withWatermark("ts", late).groupBy(*keys).agg(last).select(*keys, "_last.*").select(*rows.columns)


def month_sink(path: str):
    """``foreachBatch`` writer that rewrites only the months a batch touches (a replayed batch is harmless)."""

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        new = batch.withColumn("month", F.date_format("ts", "yyyy-MM"))
        months = [r[0] for r in new.select("month").distinct().collect()]      # a handful of calendar months
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        if folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):  # else the first batch
            old = spark.read.parquet(path).where(c("month").isin(months)).select(*new.columns)
            new = old.join(new.select("code", "ts"), ["code", "ts"], "left_anti").select(*new.columns).unionByName(new)
        # the month folders being replaced are read above, so the rows are stored aside first
        from barloom.session import cut

        cut(new).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(path)

    return write
