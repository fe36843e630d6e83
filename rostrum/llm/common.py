"""What several operators of this folder share: kept tables, size-based partition counts, hashing in tasks."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rostrum.session import ensure_checkpoint_dir

Solve = Callable[[pa.Table], Iterator[pa.RecordBatch]]
Task = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]

#: The six characters of ``[\x20\x09-\x0D]``, the white space that the word and text rules name.
BLANKS = " \t\n\x0b\x0c\r"
#: A word is a maximal run of other characters.
WORD = r"[^\x20\x09-\x0D]+"


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder on the storage that driver and executors share."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as a table in the shared folder and read again.

    Later jobs start from the files, so a lost executor costs no recomputation of what came before.
    """
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def parts_for(total_bytes: int, each: int, least: int = 1) -> int:
    """Number of parts so that each holds about ``each`` bytes."""
    return max(least, -(-int(total_bytes or 0) // each))


def word_count(text: Column) -> Column:
    """Number of words of a text as a long; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def fresh(columns: list[str], name: str) -> str:
    """``name``, with as many underscores before it as it takes to be no column yet (case does not count)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def salted(df: DataFrame, salts: int, *by: str) -> DataFrame:
    """``df`` with a column ``_salt`` of 0 .. salts - 1 that depends on the columns ``by`` only."""
    return df.withColumn("_salt", F.pmod(F.xxhash64(*by), F.lit(salts)).cast("int"))


def spread(df: DataFrame, salts: int) -> DataFrame:
    """Each row of a table of keys once per salt, for joins with a salted table."""
    return df.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))


#: Bits of a sieve: 4 MB, whatever the table.
SIEVE = 1 << 25


def sifted(df: DataFrame, keys: list[str], wanted: DataFrame) -> DataFrame:
    """``df`` without most rows whose ``keys`` are not in ``wanted``; rows that are always stay.

    The keys of ``wanted`` set bits of a bitmap of fixed size, which Spark broadcasts by its size; rows whose bit is
    unset go before they are shuffled. The more keys, the more other rows pass, so an exact join must follow.
    """
    bit = F.pmod(F.xxhash64(*keys), F.lit(SIEVE)).alias("_bit")
    bitmaps = wanted.select(bit).select(F.floor(F.col("_bit") / 32768).alias("_bucket"), (F.col("_bit") % 32768).alias("_at"))
    bitmaps = kept(bitmaps.groupBy("_bucket").agg(F.bitmap_construct_agg("_at").alias("_bits")), "sieve")
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"), bit).withColumn("_bucket", F.floor(F.col("_bit") / 32768))
    byte = F.expr("CAST(conv(hex(substring(_bits, CAST(_bit % 32768 div 8 AS INT) + 1, 1)), 16, 10) AS INT)")
    held = byte.bitwiseAND(F.expr("shiftleft(1, CAST(_bit % 8 AS INT))")) != 0
    return rows.join(bitmaps, "_bucket").filter(held).select("_row.*")


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit affects every output bit (wraps around by design)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(32)
    return x


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """At most ``rows`` rows in a batch for Python workers, for what is run inside; rows with long texts need it."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def give_back() -> None:
    """Return memory that the process holds but does not use to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def frugal(work: Task) -> Task:
    """``work``, after which the worker gives the memory that it holds but does not use back to the system.

    Workers serve one task after another; what the allocators keep of each would add up beside the executor's heap.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(batches)
        finally:
            give_back()

    return run


def by_group(key: str, solve: Solve) -> Task:
    """A task function over rows sorted by ``key`` that calls ``solve(table)`` on the rows of each value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        current = None
        for batch in batches:
            codes = batch.column(batch.schema.get_field_index(key)).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(codes[1:] != codes[:-1]) + 1).tolist(), len(codes)] if len(codes) else []
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if held and codes[a] != current:
                    yield from solve(pa.Table.from_batches(held))
                    held = []
                current = codes[a]
                held.append(batch.slice(a, b - a))
        if held:
            yield from solve(pa.Table.from_batches(held))

    return run
