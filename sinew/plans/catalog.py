"""Registry of the queries this library runs over the test tables, with their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sinew.session import prepare

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(prepare(spark), sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def r(column: Column | str, digits: int = 6) -> Column:
    return F.round(column, digits)


def rounded(df: DataFrame, columns: Sequence[str], digits: int = 6) -> DataFrame:
    return df.select(*[r(c, digits).alias(c) if c in columns else F.col(c) for c in df.columns])


def q(expression: str, name: str | None = None, digits: int = 6) -> str:
    """SQL for a rounded value without negative zero."""
    return f"round({expression}, {digits}) + 0e0" + (f" AS {name}" if name else "")


def load() -> None:
    """Import every module that registers queries."""
    from sinew.plans import (  # noqa: F401
        calibration,
        evaluation,
        holes,
        labelling,
        logs,
        models,
        signals,
        smoothing,
        stores,
        streams,
    )
