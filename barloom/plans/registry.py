"""Query registry.

A query is registered with an output spec such as ``"code:i ts:d ret:f6 label:s"``. The same spec
shapes the Spark result and the SQL result: ``i`` bigint, ``d`` ISO date text, ``t`` ISO time text,
``fN`` double rounded to N digits, ``s`` string, ``b`` boolean.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _parse(spec: str) -> list[tuple[str, str]]:
    return [tuple(item.split(":")) for item in spec.split()]


def _rounded(x: Column, digits: int) -> Column:
    """``x`` in units of its last digit to the next whole number, as in the SQL; ``round(x, n)`` of Spark rounds the decimal text of ``x``."""
    unit = 10.0 ** digits
    y = F.round(x * unit) / unit
    return F.when(F.abs(y) < math.inf, y).otherwise(x)


def shape(df: DataFrame, spec: str) -> DataFrame:
    cols = []
    for name, kind in _parse(spec):
        c = F.col(name)
        if kind == "i":
            c = c.cast("bigint")
        elif kind == "d":
            c = F.date_format(c, "yyyy-MM-dd")
        elif kind == "t":
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        elif kind[0] == "f":
            c = _rounded(c.cast("double"), int(kind[1:])) + F.lit(0.0)
        elif kind == "s":
            c = c.cast("string")
        elif kind == "b":
            c = c.cast("boolean")
        cols.append(c.alias(name))
    return df.select(*cols)


def shape_sql(body: str, spec: str) -> str:
    cols = []
    for name, kind in _parse(spec):
        if kind == "i":
            c = f"CAST({name} AS BIGINT)"
        elif kind == "d":
            c = f"strftime({name}, '%Y-%m-%d')"
        elif kind == "t":
            c = f"strftime({name}, '%Y-%m-%d %H:%M:%S')"
        elif kind[0] == "f":
            c = f"round(CAST({name} AS DOUBLE), {kind[1:]}) + 0e0"
        elif kind == "s":
            c = f"CAST({name} AS VARCHAR)"
        else:
            c = f"CAST({name} AS BOOLEAN)"
        cols.append(f"{c} AS {name}")
    body = body.strip()
    head, tail = (body, "")
    # the final SELECT of the body is marked by a line holding only "---"
    if "\n---\n" in body:
        head, tail = body.split("\n---\n")
        return f"WITH {head.strip()}\nSELECT {', '.join(cols)} FROM (\n{tail.strip()}\n) final_rows"
    return f"SELECT {', '.join(cols)} FROM (\n{head}\n) final_rows"


def query(name: str, spec: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)`` under ``name`` with its equivalent SQL (``CTEs --- SELECT``)."""

    def wrap(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return shape(fn(spark, sf_dir), spec)

        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = shape_sql(sql, spec)
        return fn

    return wrap
