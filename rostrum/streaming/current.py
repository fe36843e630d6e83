"""Continuous ingestion with keyed state, and tables that stay current with every batch."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from rostrum.operators.activity import index_columns, index_statistics
from rostrum.operators.activity import activity_counts as count_activity

#: How long the stream remembers an id.
MEMORY = "30 days"

Batch = Callable[[DataFrame, int], None]


def write_batch(sink: str) -> Batch:
    """A batch writer that may be repeated: batch ``e`` owns the folder ``batch=e`` and writes it anew."""

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink.rstrip('/')}/batch={epoch}")

    return write


def each_once(rows: DataFrame, key: str, memory: str = MEMORY) -> DataFrame:
    """The rows of a stream without those whose key came before within ``memory``; rows without a key go.

    The state holds keys and no rows, and forgets them after ``memory``. Time is the arrival, so a file that is late by
    its own date is as welcome as any other.
    """
    arrived = rows.filter(F.col(key).isNotNull()).withColumn("_arrived", F.current_timestamp()).withWatermark("_arrived", memory)
    return arrived.dropDuplicatesWithinWatermark([key]).drop("_arrived")


def ingest_once(
    protocols: DataFrame, sink: str, checkpoint: str, publisher: str | None = None, memory: str = MEMORY, also: Sequence[Batch] = ()
) -> StreamingQuery:
    """Ingest a stream of protocols (see ``stream_protocols``) and stop when nothing is left.

    Each id is written once: repeats are told by the state of the stream, which the checkpoint holds, and a batch that is
    replayed after a failure overwrites its own folder. ``also`` are further writers of the same batch, such as
    :func:`keep_current`; they must bear being repeated.
    """
    rows = protocols if publisher is None else protocols.filter(F.col("publisher") == publisher)
    writers = [write_batch(sink), *also]

    def run(batch: DataFrame, epoch: int) -> None:
        for write in writers:
            write(batch, epoch)

    stream = each_once(rows, "protocol_id", memory).writeStream.foreachBatch(run)
    return stream.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


# ---------------------------------------------------------------- mergeable aggregates

#: The counts of ``activity_counts``, which add up.
COUNTS = ("formal", "befragung", "fragestunde", "wortbeitrag")


def merged_activity(parts: DataFrame) -> DataFrame:
    """Activity counts of several batches added up."""
    return parts.groupBy("party", "speaker").agg(*[F.sum(c).alias(c) for c in COUNTS])


def merged_index(parts: DataFrame) -> DataFrame:
    """Speaker statistics of several batches as one: sums, extremes, and party and title of the first speech of all."""
    sums = ("speeches", "wortbeitraege", "befragung_responses", "total_interventions", "total_words")
    return parts.groupBy("speaker").agg(
        F.min("first").alias("first"), *[F.sum(c).alias(c) for c in sums], F.min("min_words").alias("min_words"), F.max("max_words").alias("max_words")
    )


class CurrentTable:
    """A table of partial aggregates by batch that reads as one result.

    ``part(speeches)`` aggregates a batch and ``merge(parts)`` joins aggregates; merging merged parts must give the same.
    A batch overwrites its own folder. After ``compact_every`` batches all that is valid is merged into one folder; a
    result reads the newest such folder and the batches after it (folders are partitions, so the others are pruned),
    hence its work does not grow with the number of batches.
    """

    def __init__(self, path: str, part: Callable[[DataFrame], DataFrame], merge: Callable[[DataFrame], DataFrame], compact_every: int = 32) -> None:
        self.path, self.part, self.merge, self.compact_every = path.rstrip("/"), part, merge, compact_every

    def _stored(self, spark: SparkSession) -> tuple[DataFrame | None, int]:
        """All folders as a table, None where there is none yet, and the batch that the newest merged folder ends with."""
        try:
            stored = spark.read.option("basePath", self.path).parquet(self.path)
        except AnalysisException as error:
            if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                return None, -1
            raise
        newest = stored.filter("kind = 'upto'").agg(F.max("batch")).first()[0]
        return stored, -1 if newest is None else int(newest)

    def write(self, batch: DataFrame, epoch: int) -> None:
        """Take in a batch; a repetition changes nothing."""
        spark = batch.sparkSession
        newest = self._stored(spark)[1]
        if epoch <= newest:
            return
        self.part(batch).write.mode("overwrite").parquet(f"{self.path}/kind=part/batch={epoch}")
        if epoch - newest >= self.compact_every:
            self.read(spark).write.mode("overwrite").parquet(f"{self.path}/kind=upto/batch={epoch}")

    def read(self, spark: SparkSession) -> DataFrame:
        """The aggregate over all batches so far."""
        stored, newest = self._stored(spark)
        if stored is None:
            raise ValueError(f"no batch has been written to {self.path}")
        valid = ((F.col("kind") == "upto") & (F.col("batch") == newest)) | ((F.col("kind") == "part") & (F.col("batch") > newest))
        return self.merge(stored.filter(valid).drop("kind", "batch"))


def current_activity(path: str, speeches: Callable[[DataFrame], DataFrame], **options: int) -> CurrentTable:
    """``activity_counts`` kept current; ``speeches`` makes speeches of a batch."""
    return CurrentTable(path, lambda b: count_activity(speeches(b)), merged_activity, **options)


def current_index(path: str, speeches: Callable[[DataFrame], DataFrame], order: Sequence[str] = ("protocol_id", "speech_id"), **options: int) -> CurrentTable:
    """The statistics behind ``speaker_index`` kept current; :func:`read_index` makes the index of them."""
    return CurrentTable(path, lambda b: index_statistics(speeches(b), order), merged_index, **options)


def read_index(spark: SparkSession, table: CurrentTable) -> DataFrame:
    """``speaker_index`` over all batches so far; slugs are told apart over all of them."""
    return index_columns(table.read(spark))


def keep_current(*tables: CurrentTable) -> list[Batch]:
    """Batch writers that take each batch into the tables."""
    return [t.write for t in tables]
