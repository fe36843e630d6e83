"""Registry of queries and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def longs(df: DataFrame) -> DataFrame:
    """Integer columns as longs, so that both engines report the same type."""
    kinds = dict(df.dtypes)
    if not any(k in ("int", "smallint", "tinyint") for k in kinds.values()):
        return df
    return df.select(*[F.col(f"`{c}`").cast("long").alias(c) if kinds[c] in ("int", "smallint", "tinyint") else F.col(f"`{c}`") for c in df.columns])


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    """Register a query and, if given, its SQL."""

    def add(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return longs(fn(spark, sf_dir))

        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return add
