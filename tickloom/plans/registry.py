"""Registry of runnable queries: a Spark callable per key and, where SQL can say it, its oracle."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.plans.oracle_views import VIEWS
from tickloom.plans.views import Views

DIGITS = 6
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def finish(df: DataFrame) -> DataFrame:
    """Comparable output: integers as BIGINT, decimals and floats as DOUBLE rounded to 6 digits."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType)):
            c = c.cast("bigint")
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            c = F.round(c.cast("double"), DIGITS) + F.lit(0.0)
        cols.append(c.alias(f.name))
    return df.select(*cols)


def _needed(sql: str) -> list[str]:
    """Views that a text mentions, dependencies first."""
    order: list[str] = []

    def visit(text: str) -> None:
        for name, body in VIEWS.items():
            if name not in order and re.search(rf"\b{name}\b", text):
                visit(body)
                if name not in order:
                    order.append(name)

    visit(sql)
    return order


def oracle(sql: str, dbl: str = "") -> str:
    ctes = ", ".join(f"{v} AS ({VIEWS[v]})" for v in _needed(sql))
    rounded = ", ".join(f"round(CAST({c} AS DOUBLE), {DIGITS}) + 0.0 AS {c}" for c in dbl.split())
    replace = f" REPLACE ({rounded})" if rounded else ""
    head = f"WITH RECURSIVE {ctes} " if ctes else ""
    return f"{head}SELECT *{replace} FROM ({sql}) AS result"


def query(key: str, sql: str | None = None, dbl: str = ""):
    """Register ``fn(views) -> DataFrame`` under ``key``; ``dbl`` lists the oracle's DOUBLE columns."""

    def wrap(fn: Callable[[Views], DataFrame]) -> Callable[[Views], DataFrame]:
        if key in QUERIES:
            raise ValueError(f"duplicate query {key}")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return finish(fn(Views(spark, sf_dir)))

        QUERIES[key] = run
        if sql is not None:
            ORACLES[key] = oracle(sql, dbl)
        return fn

    return wrap
