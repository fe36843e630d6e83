"""Mixing sources to target weights: capped water-filling and seeded repetitions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rostrum.llm.common import kept, word_count
from rostrum.operators.common import distributed_rank

#: Hexadecimal digits of the draw that name a document's bucket within its source.
BUCKET_DIGITS = 3


def cycled_weights(sources: DataFrame, cycle: Sequence[float]) -> DataFrame:
    """Sources in code point order, null last, weighted by ``cycle`` from its start, again and again."""
    numbered = distributed_rank(sources, [], [F.asc_nulls_last("_source")], "_rank")
    weights = F.array(*[F.lit(float(w)) for w in cycle])
    return numbered.select("_source", "source_size", F.element_at(weights, (F.pmod(F.col("_rank") - 1, F.lit(len(cycle))) + 1).cast("int")).alias("weight"))


def fill(sources: DataFrame, total: float, max_epochs: float) -> DataFrame:
    """Add ``target``: shares of ``total`` by weight, none above ``max_epochs`` times the source's size.

    Sources above their cap are clamped and what they leave is shared out again by weight, until none is above. Every
    round is one aggregation over the sources; only its two sums reach the driver. Where all sources are clamped, the
    targets are the caps and stay below ``total``.
    """
    cap = F.col("source_size") * F.lit(float(max_epochs))
    level, clamped = None, -1
    while True:
        above = F.lit(False) if level is None else F.col("weight") * F.lit(level) > cap
        row = sources.agg(
            F.sum(F.when(above, cap)).alias("full"),
            F.sum(F.when(~above, F.col("weight"))).alias("open"),
            F.count(F.when(above, 1)).alias("n"),
        ).first()
        if not row["open"] or row["n"] == clamped:
            break
        clamped, level = row["n"], (float(total) - float(row["full"] or 0.0)) / float(row["open"])
    target = F.lit(0.0) if level is None else F.least(cap, F.col("weight") * F.lit(level))
    return sources.withColumn("target", (cap if level is not None and not row["open"] else target).cast("double"))


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[float] = (5, 2, 1),
    share: float = 1.5,
    max_epochs: float = 2.0,
    seed: str = "mix",
    size: Column | None = None,
) -> DataFrame:
    """One row per input row: id, ``size``, ``source_size``, ``target``, ``taken`` and ``repeats``.

    ``size`` is the number of words (or the given column); null texts have 0. A source's documents are each repeated
    ``floor(target / source_size)`` times; the rest of the target is filled with one more repetition of the documents
    that come first by md5 of seed and id, up to the one that would pass it by more than half its size. A document
    hence never takes more than ``ceil(max_epochs)`` times its size and reruns agree. Rows with equal ids and sizes
    are interchangeable. A null source is a source of its own; sources without words have target 0 and repeats 0.

    A source may hold most rows: its documents are dealt over buckets by their draw, only bucket sums are added up in
    order, and only the one bucket in which the target ends is ordered row by row.
    """
    n = size if size is not None else word_count(F.col(text_col))
    draw = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))
    rows = kept(
        docs.select(F.col(id_col).alias("_id"), F.col(source_col).cast("string").alias("_source"), n.cast("long").alias("size"), draw.alias("_draw"))
        .withColumn("_bucket", F.substring("_draw", 1, BUCKET_DIGITS)),
        "mix-sizes",
    )
    sums = kept(rows.groupBy("_source", "_bucket").agg(F.sum("size").alias("_words")), "mix-buckets")
    sources = kept(cycled_weights(sums.groupBy("_source").agg(F.sum("_words").alias("source_size")), weights), "mix-sources")
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    plan = fill(sources, total * share, max_epochs)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    plan = plan.withColumn("_whole", epochs).withColumn("_rest", F.col("target") - F.col("_whole") * F.col("source_size"))
    before = Window.partitionBy("_source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = sums.withColumn("_before", F.coalesce(F.sum("_words").over(before), F.lit(0)))
    plan = plan.withColumnRenamed("_source", "_psource")
    buckets = buckets.join(plan, F.col("_source").eqNullSafe(F.col("_psource"))).select(
        F.col("_source").alias("_bsource"), F.col("_bucket").alias("_bbucket"), "source_size", "target", "_whole", "_rest", "_before",
        (F.col("_before") >= F.col("_rest")).alias("_none"), (F.col("_before") + F.col("_words") <= F.col("_rest")).alias("_all"),
    )
    on = F.col("_source").eqNullSafe(F.col("_bsource")) & (F.col("_bucket") == F.col("_bbucket"))
    placed = rows.join(buckets, on)
    extra = Window.partitionBy("_source", "_bucket", "_edge").orderBy("_draw", F.asc_nulls_last("_id"), "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("_edge", ~F.col("_none") & ~F.col("_all"))
    inside = placed.filter("_edge").withColumn("_until", F.col("_before") + F.coalesce(F.sum("size").over(extra), F.lit(0)))
    inside = inside.withColumn("_more", F.col("_until") + F.col("size") / 2 <= F.col("_rest")).drop("_until")
    rest = placed.filter(~F.col("_edge")).withColumn("_more", F.col("_all") & ~F.col("_none"))
    repeats = F.col("_whole") + F.col("_more").cast("long")
    return inside.unionByName(rest).select(
        F.col("_id").alias(id_col), "size", "source_size", "target", (repeats * F.col("size")).alias("taken"), repeats.alias("repeats")
    )
