"""Building blocks shared by the operators: lookups, top-k, distributed ranks, interval and as-of joins."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from rostrum.session import materialize

# Cells over which the rows of a busy group are dealt before they meet in one place.
SALTS = 16
# Items of an array that are summed up by appending.
RUN = 64
# Rows of one key on the left of a dealt join that stay in one cell.
CELL_ROWS = 512


def lookup_frame(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A small driver-side table as a local relation with real nulls, whatever the session's settings.

    Its exact size is part of the plan, so Spark itself broadcasts it below
    ``spark.sql.autoBroadcastJoinThreshold`` and shuffles it above.
    """
    fields = T._parse_datatype_string(schema)
    kinds = to_arrow_schema(fields)
    columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
    table = pa.table([pa.array(list(c), f.type) for c, f in zip(columns, kinds, strict=True)], schema=kinds)
    return spark.createDataFrame(table, schema=fields)


def pinned(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are computed exactly once per row.

    A filter on a projected column is normally pushed below the projection with
    the column's expression copied into it, so costly text expressions would be
    evaluated again for every mention. A generator of one row is a boundary the
    optimizer does not push such filters through.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(items: Column, add: Callable[[Column, Column], Column], zero: Column, kind: str, levels: int = 3) -> Column:
    """Array of what comes before each item of a non-empty array: ``zero``, ``zero + items[0]`` and so on.

    ``add`` must be associative, with results of the type ``kind``. Appending to an array copies it, so the array is
    cut into runs of :data:`RUN` items, whose totals are summed up first; on three levels the copies per item
    stay constant up to some ten million items.
    """

    def short(values: Column, start: Column) -> Column:
        init = F.struct(start.alias("at"), F.expr(f"cast(array() as array<{kind}>)").alias("out"))
        step = lambda acc, x: F.struct(add(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
        return F.aggregate(values, init, step)["out"]

    if levels == 1:
        return short(items, zero)
    starts = F.sequence(F.lit(0), F.floor((F.size(items) - 1) / RUN).cast("int"))
    runs = F.transform(starts, lambda g: F.slice(items, g * RUN + 1, F.lit(RUN)))

    def placed(gs: Column) -> Column:
        before = running(F.transform(gs, lambda g: F.aggregate(g, zero, add)), add, zero, kind, levels - 1)
        return bound(before, lambda at: F.flatten(F.transform(gs, lambda g, i: short(g, F.get(at, i)))))

    return bound(runs, placed)


def ratio(num: Column, den: Column, default: float = 0.0, scale: float | None = None) -> Column:
    """``num / den`` (optionally scaled), or ``default`` where the denominator is 0 or null."""
    value = num / F.when(den != 0, den)
    if scale is not None:
        value = value * F.lit(scale)
    return F.coalesce(value, F.lit(float(default)))


def join_groups(df: DataFrame, groups: DataFrame, on: Sequence[str]) -> DataFrame:
    """Inner join of a large table with a table of one row per group.

    Groups are few and uneven, so each group's rows are dealt over :data:`SALTS` cells and the group's row is repeated
    for each. Whether the group table is broadcast is Spark's choice by its measured size.
    """
    salt = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]), F.lit(SALTS)).cast("int")
    cells = groups.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return df.withColumn("_salt", salt).join(cells, [*on, "_salt"]).drop("_salt")


def dealt_join(left: DataFrame, right: DataFrame, on: Sequence[str], rows: int | None = None) -> DataFrame:
    """Inner equi join for keys of very uneven size.

    Keys with more than ``rows`` left rows are dealt over cells of about that size, and the right rows of such a key are
    repeated for each of its cells, so the work of a hot key is spread however large it is.
    """
    rows = rows or CELL_ROWS
    many = left.groupBy(*on).agg(F.count(F.lit(1)).alias("_rows")).filter(F.col("_rows") > rows)
    many = materialize(many.select(*on, F.ceil(F.col("_rows") / rows).alias("_cells")))
    cells = F.coalesce(F.col("_cells"), F.lit(1))
    others = [F.col(f"`{c}`") for c in left.columns if c not in on] or [F.lit(0)]
    dealt = left.join(many, list(on), "left").withColumn("_cell", F.pmod(F.xxhash64(*others), cells)).drop("_cells")
    spread = right.join(many, list(on), "left").withColumn("_cell", F.explode(F.sequence(F.lit(0).cast("long"), cells - 1))).drop("_cells")
    return dealt.join(spread, [*on, "_cell"]).drop("_cell")


def count_if(cond: Column) -> Column:
    """Number of rows that satisfy ``cond`` as a long (0 when there are none)."""
    return F.coalesce(F.sum(F.when(cond, F.lit(1)).otherwise(F.lit(0))), F.lit(0)).cast("long")


def sum_if(cond: Column, value: Column) -> Column:
    """Sum of ``value`` over the rows that satisfy ``cond`` (0 when there are none)."""
    return F.coalesce(F.sum(F.when(cond, value)), F.lit(0)).cast("long")


def top_k(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """First ``k`` rows per group by ``order`` with their 1-based position.

    The rows of a group are dealt over :data:`SALTS` cells that keep ``k`` each, so a hot group never reaches one task
    whole; what the cells keep is ranked together.
    """
    if not by:
        best = df.orderBy(*order).limit(k)
        return best.withColumn(rank, F.row_number().over(Window.orderBy(*order)))
    salt = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns if c not in by], F.lit(1)), F.lit(SALTS))
    cell = Window.partitionBy(*by, "_salt").orderBy(*order)
    first = df.withColumn("_salt", salt).withColumn(rank, F.row_number().over(cell)).filter(F.col(rank) <= k).drop(rank, "_salt")
    return first.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col(rank) <= k)


def distributed_rank(df: DataFrame, by: Sequence[str], order: Sequence[Column], rank: str = "rank") -> DataFrame:
    """``row_number`` per group without putting a group in one task.

    The rows are range-partitioned and sorted by (group, order) over the whole
    cluster and kept on reliable storage. A row's number is its position in its
    partition plus the rows of its group in earlier partitions; only the
    (partition, group) counts are summed up in a window.
    """
    cols = df.columns
    keys = [F.col(c) for c in by]
    ordered = df.orderBy(*keys, *order).withColumn("_mid", F.monotonically_increasing_id())
    ordered = materialize(ordered)
    numbered = ordered.withColumn("_part", F.shiftright("_mid", 33))
    counts = numbered.groupBy("_part", *by).agg(F.count(F.lit(1)).alias("_n"), F.min("_mid").alias("_first"))
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    before = w.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        F.col("_part").alias("_p"),
        *[F.col(c).alias(f"_by_{c}") for c in by],
        "_first",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
    )
    on = F.col("_part") == F.col("_p")
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    position = (F.col("_mid") - F.col("_first") + F.col("_before") + 1).cast("long")
    return numbered.join(offsets, on, "inner").select(*cols, position.alias(rank))


def metric_ranks(
    df: DataFrame,
    key: str,
    metrics: Sequence[str],
    scopes: Sequence[str | None] = (None,),
    eligible: dict[str, Column] | None = None,
) -> DataFrame:
    """Ranks of every ``key`` for many metrics and scopes in one distributed sort.

    A scope is ``None`` (all rows) or a grouping column. The result is long:
    ``(key, scope, metric, rank, pool)``; higher values rank first and ties go
    to the smaller key. ``eligible`` restricts the rows that take part in a metric.
    """
    eligible = eligible or {}
    entries = []
    for scope in scopes:
        group = F.lit(None).cast("string") if scope is None else F.col(scope).cast("string")
        for metric in metrics:
            value = F.col(metric).cast("double")
            if metric in eligible:
                value = F.when(eligible[metric], value)
            entries.append(
                F.struct(
                    F.lit(scope or "all").alias("scope"),
                    group.alias("grp"),
                    F.lit(metric).alias("metric"),
                    value.alias("value"),
                )
            )
    long = (
        df.select(F.col(key), F.explode(F.array(*entries)).alias("e"))
        .select(key, "e.*")
        .filter(F.col("value").isNotNull())
    )
    ranked = distributed_rank(long, ["scope", "grp", "metric"], [F.desc("value"), F.asc(key)])
    pool = ranked.groupBy(
        F.col("scope").alias("_s"), F.col("grp").alias("_g"), F.col("metric").alias("_m")
    ).agg(F.max("rank").alias("pool"))
    on = (F.col("scope") == F.col("_s")) & (F.col("metric") == F.col("_m")) & F.col("grp").eqNullSafe(F.col("_g"))
    return ranked.join(pool, on).select(key, "scope", "metric", "rank", "pool")


def interval_join(
    points: DataFrame,
    ranges: DataFrame,
    key: str,
    pos: str,
    start: str,
    end: str,
    width: int = 4096,
) -> DataFrame:
    """Pairs of points and half-open ranges ``[start, end)`` of the same key.

    Ranges are cut at multiples of ``width``; the join is an equi join on
    (key, cell), so one long text or busy key is spread over many tasks. Every
    point lies in exactly one cell, hence no pair appears twice.
    """
    cell = f"_{key}_cell"
    cut = ranges.filter(F.col(end) > F.col(start)).withColumn(
        cell,
        F.explode(F.sequence(F.floor(F.col(start) / width), F.floor((F.col(end) - 1) / width))),
    )
    located = points.withColumn(cell, F.floor(F.col(pos) / width))
    return located.join(cut, [key, cell], "inner").filter(
        (F.col(start) <= F.col(pos)) & (F.col(pos) < F.col(end))
    ).drop(cell)


def forward_asof(
    left: DataFrame,
    right: DataFrame,
    key: str,
    left_pos: str,
    right_pos: str,
    value: str,
    width: int = 4096,
) -> DataFrame:
    """For each left row, ``value`` of the first right row of the key whose position is larger (null if none).

    Positions are grouped into cells. The next right row is either in the same
    cell (window over one cell) or the first of the next occupied cell (window
    over the cell heads of a key), so no task sorts all rows of a busy key.
    """
    cell = "_cell"
    hit = F.struct(F.col(right_pos).alias("p"), F.col(value).alias("v"))
    r = right.select(key, F.floor(F.col(right_pos) / width).alias(cell), F.col(right_pos).alias("_p"), hit.alias("_hit"))
    heads = r.groupBy(key, cell).agg(F.min("_hit").alias("_head"))
    lcells = left.select(key, F.floor(F.col(left_pos) / width).alias(cell)).distinct()
    spine = lcells.join(heads, [key, cell], "full")
    # from the last row back, so that the frame only grows and each row is looked at once
    following = Window.partitionBy(key).orderBy(F.desc(cell)).rowsBetween(Window.unboundedPreceding, -1)
    nexts = spine.select(key, cell, F.last("_head", ignorenulls=True).over(following).alias("_next"))
    cols = left.columns
    tagged = left.select(
        key, F.floor(F.col(left_pos) / width).alias(cell), F.col(left_pos).alias("_p"),
        F.lit(None).cast(r.schema["_hit"].dataType).alias("_hit"),
        F.struct(*[F.col(c) for c in cols]).alias("_row"),
    )
    both = tagged.unionByName(r.withColumn("_row", F.lit(None).cast(tagged.schema["_row"].dataType)))
    # a right row at the same position sorts before the left row, so it is not "larger"
    within = Window.partitionBy(key, cell).orderBy(F.desc("_p"), F.col("_row").isNull()).rowsBetween(Window.unboundedPreceding, -1)
    near = both.withColumn("_near", F.last("_hit", ignorenulls=True).over(within)).filter(F.col("_row").isNotNull())
    return near.join(nexts, [key, cell], "left").select(
        "_row.*", F.coalesce("_near", "_next")["v"].alias(value)
    )
