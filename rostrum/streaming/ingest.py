"""Resumable ingestion of protocol files.

The batch side plans what is pending; the continuous side reads new files as a
stream. Exactly-once per protocol comes from an anti join with the ids already
in the sink, so no stream state grows with the corpus.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.errors import AnalysisException

from rostrum.operators.common import count_if
from rostrum.sources.readers import stream_protocols


def pending_ids(
    listing: DataFrame, done: DataFrame, id_col: str = "id", publisher: str | None = None, limit: int | None = None
) -> DataFrame:
    """Listed ids that are not done yet (failed ones are tried again), optionally of one publisher, lowest ids first."""
    source = listing if publisher is None else listing.filter(F.col("publisher") == publisher)
    rest = source.join(done.select(id_col).distinct(), id_col, "left_anti")
    return rest if limit is None else rest.orderBy(id_col).limit(limit)


def mark(state: DataFrame, updates: DataFrame, id_col: str = "id") -> DataFrame:
    """State table ``(id, state)`` with newer states replacing older ones."""
    return state.join(updates, id_col, "left_anti").unionByName(updates)


def ingest_status(manifest: DataFrame) -> DataFrame:
    """Totals of a manifest ``(id, state)``: total, downloaded, failed, pending and an overall status."""
    totals = manifest.agg(
        F.count(F.lit(1)).alias("total"),
        count_if(F.col("state") == "downloaded").alias("downloaded"),
        count_if(F.col("state") == "failed").alias("failed"),
    )
    pending = F.col("total") - F.col("downloaded")
    status = F.when(F.col("total") == 0, "empty").when(pending == 0, "complete").otherwise("in_progress")
    return totals.withColumn("pending", pending).withColumn("status", status)


def _existing(spark: SparkSession, path: str) -> DataFrame | None:
    """The ids in the sink, or None where nothing has been written; any other trouble is the caller's to see."""
    try:
        return spark.read.parquet(path).select("protocol_id")
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def new_protocols(batch: DataFrame, known: DataFrame | None, publisher: str | None = None) -> DataFrame:
    """The protocols of a batch whose ids are not ``known`` yet (one row per id).

    The known ids grow with the corpus, so they are shuffled to the rows, which the aggregate shuffles by id
    anyway, and never sent through the driver.
    """
    rows = batch.filter(F.col("protocol_id").isNotNull())
    if publisher is not None:
        rows = rows.filter(F.col("publisher") == publisher)
    if known is not None:
        rows = rows.join(known.hint("shuffle_merge"), "protocol_id", "left_anti")
    # copies of one id carry the same document; the aggregate keeps one without gathering the texts of an id in a window
    unique = rows.groupBy("protocol_id").agg(F.max(F.struct(*[c for c in rows.columns if c != "protocol_id"])).alias("r"))
    return unique.select("protocol_id", "r.*")


def write_new_protocols(batch: DataFrame, sink: str, publisher: str | None = None) -> None:
    """Append the protocols of a batch that the sink does not hold yet (one row per id)."""
    new_protocols(batch, _existing(batch.sparkSession, sink), publisher).write.mode("append").parquet(sink)


def ingest_incremental(
    spark: SparkSession, source: str, sink: str, checkpoint: str, publisher: str | None = None, max_files: int | None = None,
) -> StreamingQuery:
    """Ingest all files that arrived since the last run and stop; a rerun continues from the checkpoint.

    A batch that is replayed after a failure finds its ids in the sink and appends nothing twice.
    """

    def append(batch: DataFrame, _epoch: int) -> None:
        write_new_protocols(batch, sink, publisher)

    return (
        stream_protocols(spark, source, max_files)
        .writeStream.foreachBatch(append)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
