"""Exact ranks and quantiles of groups of any size.

A plain ``rank().over(partitionBy(date))`` puts a whole date in one task. Here the values are first
counted (map-side combine, so ties and hot values shrink before the shuffle), then each group is
split along a fixed monotone grid of its value. Only the grid totals, whose number is bounded by
the grid and not by the data, are summed along the whole group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GRID_STEPS = 512        # grid cells per factor e of magnitude
GRID_UNIT = 1e-6        # magnitude at which the grid turns from linear to logarithmic


def grid(v: Column) -> Column:
    """Monotone cell number of a double (signed logarithm); at most ~750k cells over all doubles."""
    v = v.cast("double")
    return F.floor(F.signum(v) * F.log1p(F.abs(v) / GRID_UNIT) * GRID_STEPS)


def cumulated_counts(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """(by..., value, n, below, total): ``below`` values lie strictly under ``value`` in the group."""
    counts = (
        df.where(F.col(value).isNotNull())
        .groupBy(*by, value)
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("_cell", grid(F.col(value)))
    )
    in_cell = Window.partitionBy(*by, "_cell").orderBy(value)
    cells = counts.groupBy(*by, "_cell").agg(F.sum("n").alias("_m"))
    group = Window.partitionBy(*by)
    along = group.orderBy("_cell")
    cells = cells.select(
        *by, "_cell",
        (F.sum("_m").over(along.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_m")).alias("_off"),
        F.sum("_m").over(group).alias("total"),
    )
    return (
        counts.withColumn(
            "_in", F.sum("n").over(in_cell.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n"))
        .join(cells, [*by, "_cell"])
        .select(*by, value, "n", (F.col("_in") + F.col("_off")).alias("below"), "total")
    )


def average_rank(df: DataFrame, by: Sequence[str], value: str, out: str = "rank",
                 count: str | None = None) -> DataFrame:
    """Append the 1-based average rank of ``value`` in its group (null stays null)."""
    cum = cumulated_counts(df, by, value).select(
        *by, value,
        (F.col("below") + (F.col("n") + 1) / 2.0).alias(out),
        *([F.col("total").alias(count)] if count else []),
    )
    return df.join(cum, [*by, value], "left")


def quantiles(df: DataFrame, by: Sequence[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Exact linearly interpolated quantiles per group: (by..., one column per name in ``probs``)."""
    cum = cumulated_counts(df, by, value)
    aggs = [F.max("total").alias("total")]
    for name, p in probs.items():
        pos = F.lit(p) * (F.col("total") - 1)
        aggs += [
            F.max(F.when(F.col("below") <= F.floor(pos), F.col(value))).alias(f"_{name}_lo"),
            F.max(F.when(F.col("below") <= F.ceil(pos), F.col(value))).alias(f"_{name}_hi"),
        ]
    agg = cum.groupBy(*by).agg(*aggs)
    cols = []
    for name, p in probs.items():
        pos = F.lit(p) * (F.col("total") - 1)
        lo, hi = F.col(f"_{name}_lo"), F.col(f"_{name}_hi")
        cols.append((lo + (hi - lo) * (pos - F.floor(pos))).alias(name))
    return agg.select(*by, *cols)


def group_moments(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """(by..., mean, sd, n) of one column; the result has one row per group."""
    return df.groupBy(*by).agg(
        F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.count(value).alias("n"))


def with_zscore(df: DataFrame, by: Sequence[str], value: str, out: str, fill: float | None = None,
                moments: DataFrame | None = None) -> DataFrame:
    """Append (x - mean) / sample std per group; 0 or null deviation gives ``fill``. ``moments``: stored ``group_moments``, if at hand.

    The moments have one row per group; whether that side is broadcast is left to the optimizer, which knows its size.
    """
    m = (group_moments(df, by, value) if moments is None else moments).select(*by, F.col("mean").alias("_mean"), F.col("sd").alias("_sd"))
    z = F.when(F.col("_sd") > 0, (F.col(value) - F.col("_mean")) / F.col("_sd"))
    if fill is not None:
        z = F.coalesce(z, F.lit(fill))
    return df.join(m, list(by), "left").withColumn(out, z).drop("_mean", "_sd")


def with_totals(df: DataFrame, totals: DataFrame) -> DataFrame:
    """Append the columns of a one-row table of market-wide totals: a nested-loop join with that single, broadcast row."""
    return df.crossJoin(F.broadcast(totals))
