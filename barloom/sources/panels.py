"""Panels: wide date-by-code tables and the long form used by the engine."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def wide_to_long(wide: DataFrame, date: str = "date") -> DataFrame:
    """(date, one column per code) -> (date, code, value), null cells dropped."""
    cols = [c for c in wide.columns if c != date]
    return wide.unpivot([date], cols, "code", "value").where(F.col("value").isNotNull())


def long_to_wide(panel: DataFrame, indicators: Sequence[str]) -> DataFrame:
    """(date, code, indicator, value) -> one column per indicator."""
    return panel.groupBy("date", "code").pivot("indicator", list(indicators)).agg(F.first("value"))


def _wide_csv(spark: SparkSession, path: str) -> DataFrame:
    with_header = spark.read.option("header", True).csv(path)
    cols = with_header.columns
    schema = ", ".join(f"`{c}` {'date' if i == 0 else 'double'}" for i, c in enumerate(cols))
    return spark.read.option("header", True).schema(schema).csv(path).withColumnRenamed(cols[0], "date")


def load_panel(spark: SparkSession, path: str) -> DataFrame:
    """A date-indexed wide CSV as a long panel."""
    return wide_to_long(_wide_csv(spark, path))


def load_panel_dir(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Several wide CSVs; the file stem is the indicator name."""
    out = None
    for p in paths:
        stem = p.rstrip("/").rsplit("/", 1)[-1].removesuffix(".csv")
        part = load_panel(spark, p).withColumn("indicator", F.lit(stem))
        out = part if out is None else out.unionByName(part)
    return out


def save_results(ic: DataFrame, summary: DataFrame, groups: DataFrame, out_dir: str) -> None:
    """IC series as CSV; summary and group results as JSON."""
    ic.write.mode("overwrite").option("header", True).csv(f"{out_dir}/ic_series")
    summary.write.mode("overwrite").json(f"{out_dir}/ic_summary")
    groups.write.mode("overwrite").json(f"{out_dir}/quantile_groups")


def save_bars(bars: DataFrame, path: str) -> None:
    """Bars partitioned by month, so that a refresh rewrites only the touched months."""
    (bars.withColumn("month", F.date_format("ts", "yyyy-MM")).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(path))
