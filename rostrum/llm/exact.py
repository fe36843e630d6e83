"""Exact deduplication by whole content, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rostrum.llm.common import BLANKS

#: Cells over which the rows of one digest are dealt.
SALTS = 64


def normalized(text: Column) -> Column:
    """The text without white space; null counts as empty."""
    out = F.coalesce(text, F.lit(""))
    for blank in BLANKS:
        out = F.replace(out, F.lit(blank), F.lit(""))
    return out


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """One row per input row: id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    Texts are equal when they are identical without white space. Of equal texts the row with the most code points in
    the original text stays, then the smallest id (a null id sorts last). Equal rows are counted one by one, and
    exactly one of them is kept. Empty and null texts form one group; an empty table gives an empty result; columns
    other than the two named are not read.

    Three steps, each grouping by digest *and* content, so that a digest alone never decides: the rows of a digest are
    dealt over ``salts`` cells and reduced to one winner per cell and content; the winners of all cells, at most
    ``salts`` per content, are combined; the members of a cell then look up their winner by cell, without the text.
    """
    text = F.col(text_col)
    rows = docs.select(
        F.col(id_col).alias("_id"),
        F.coalesce(F.length(text), F.lit(0)).alias("_len"),
        normalized(text).alias("_norm"),
    ).withColumn("_sha", F.coalesce(F.sha2(F.col("_norm"), 256), F.lit("")))
    # neither key can be null, so both readers of the dealt rows get the same plan and share one exchange of the texts
    rows = rows.withColumn("_salt", F.coalesce(F.pmod(F.xxhash64("_id", "_len"), F.lit(salts)).cast("int"), F.lit(0)))
    order = [F.desc("_len"), F.asc_nulls_last("_id")]
    whole = (Window.unboundedPreceding, Window.unboundedFollowing)
    cell = Window.partitionBy("_sha", "_salt", "_norm").orderBy(*order)
    local = (
        rows.repartition("_sha", "_salt")
        .withColumn("_rank", F.row_number().over(cell))
        .withColumn("_count", F.count(F.lit(1)).over(cell.rowsBetween(*whole)))
        .withColumn("_local", F.first("_id").over(cell.rowsBetween(*whole)))
    )
    group = Window.partitionBy("_sha", "_norm").orderBy(*order, F.asc("_salt"))
    winners = (
        local.filter("_rank = 1")
        .repartition("_sha")
        .withColumn("_grank", F.row_number().over(group))
        .withColumn("keep_id", F.first("_id").over(group.rowsBetween(*whole)))
        .withColumn("group_size", F.sum("_count").over(group.rowsBetween(*whole)))
        .select(F.col("_sha").alias("_wsha"), F.col("_salt").alias("_wsalt"), F.col("_local").alias("_wlocal"), "_grank", "keep_id", "group_size")
    )
    members = local.select("_id", "_sha", "_salt", "_local", "_rank")
    on = (F.col("_sha") == F.col("_wsha")) & (F.col("_salt") == F.col("_wsalt")) & F.col("_local").eqNullSafe(F.col("_wlocal"))
    return members.join(winners, on).select(
        F.col("_id").alias(id_col),
        "keep_id",
        F.col("group_size").cast("long").alias("group_size"),
        ((F.col("_rank") == 1) & (F.col("_grank") == 1)).alias("kept"),
        F.col("_sha").alias("text_sha256"),
    )


def exact_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """The rows that stay, with all their columns: of each group of :func:`exact_groups` the kept one.

    The rows themselves go through the same two steps, so repeated ids and rows need no join; the normalised text is
    computed again behind each exchange instead of being moved along with the original.
    """
    text = F.col(text_col)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.sha2(normalized(text), 256).alias("_sha"))
    rows = rows.withColumn("_id", F.col(f"_row.`{id_col}`")).withColumn("_len", F.coalesce(F.length(F.col(f"_row.`{text_col}`")), F.lit(0)))
    rows = rows.withColumn("_salt", F.pmod(F.xxhash64("_id", "_len"), F.lit(salts)).cast("int"))
    norm = normalized(F.col(f"_row.`{text_col}`"))
    order = [F.desc("_len"), F.asc_nulls_last("_id")]
    cell = Window.partitionBy("_sha", "_salt", "_norm").orderBy(*order)
    local = rows.repartition("_sha", "_salt").withColumn("_norm", norm).withColumn("_rank", F.row_number().over(cell)).filter("_rank = 1").drop("_norm", "_rank")
    group = Window.partitionBy("_sha", "_norm").orderBy(*order, F.asc("_salt"))
    best = local.repartition("_sha").withColumn("_norm", norm).withColumn("_rank", F.row_number().over(group)).filter("_rank = 1")
    return best.select("_row.*")
