"""Connected components of link tables, by alternating star steps on the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rostrum.llm.common import kept


def _with_least(pairs: DataFrame) -> DataFrame:
    """Each pair (x, y) with the least of x and all its partners as ``m``.

    The minima are a table of their own, so that the join reads two plain tables and a hub's pairs can be split.
    """
    least = kept(pairs.groupBy("x").agg(F.min("y").alias("m")), "least").withColumnRenamed("x", "_x")
    return pairs.join(least, F.col("x") == F.col("_x")).select("x", "y", F.least("x", "m").alias("m"))


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("x", "y").cast("decimal(38,0)"))).first())


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(id, component)`` for every id that has a link to another; the component is its smallest id.

    Large-star and small-star steps alternate until the edges no longer change; each leaves one edge per id at most
    more than it found, and the number of rounds grows with the logarithm of the size. Self-links and rows with a null
    are ignored; an empty table gives an empty result.
    """
    edges = links.select(F.greatest(a, b).alias("x"), F.least(a, b).alias("y")).filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    edges = kept(edges.distinct(), "edges")
    state = _state(edges)
    while state[0]:
        both = edges.unionByName(edges.select(F.col("y").alias("x"), F.col("x").alias("y")))
        large = _with_least(both).filter("y > x").select(F.col("y").alias("x"), F.col("m").alias("y")).distinct()
        large = kept(large, "large")
        small = _with_least(large)
        small = small.select("x", F.col("m").alias("y")).unionByName(small.filter("y <> m").select(F.col("y").alias("x"), F.col("m").alias("y")))
        edges = kept(small.distinct(), "small")
        after = _state(edges)
        if after == state:
            break
        state = after
    return edges.select(F.col("x").alias("id"), F.col("y").alias("component")).unionByName(
        edges.select(F.col("y").alias("id"), F.col("y").alias("component")).distinct()
    )
