"""Writers: speeches, frequency tables, profiles, summaries, research exports."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rostrum.functions.text import preview
from rostrum.operators.common import distributed_rank
from rostrum.session import materialize


def write_speeches(df: DataFrame, path: str) -> None:
    """Parquet partitioned by party. Parties are few and large, so rows keep their task and each task appends per party."""
    df.write.partitionBy("party").mode("overwrite").parquet(path)


def write_wide_frequencies(matrix: DataFrame, path: str) -> None:
    """Word x party CSV sorted by word (range-partitioned, several files in order)."""
    matrix.orderBy("word").write.mode("overwrite").option("header", True).csv(path)


def speech_db(speeches: DataFrame, mode: str = "full", speaker: str = "speaker", orig_id: str = "speech_id", chars: int = 500) -> DataFrame:
    """Speech listing with a dense ``id`` by (speaker, original id).

    ``full`` keeps the text and a preview, ``short`` only the first ``chars`` characters.
    The numbering is distributed: no task sorts all speeches, and no text is sorted or kept on the way.
    Rows with the same speaker and ids get neighbouring numbers.
    """
    ids = [c for c in ("protocol_id", orig_id) if c in speeches.columns]
    keys = [speaker, *ids]
    text = F.substring("text", 1, chars) if mode == "short" else F.col("text")
    cols = [speaker, "party", "type", "words", *(["category"] if mode == "full" else [])]
    rows = speeches.select(*dict.fromkeys([*cols, *ids]), text.alias("text"))
    # only keys are sorted and kept; texts meet their numbers in one join
    ranked = distributed_rank(speeches.select(*keys), [], [F.asc_nulls_first(k) for k in keys], "_rank")
    named = [F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)]
    first = materialize(ranked.groupBy(*named).agg(F.min("_rank").alias("_from"), F.count(F.lit(1)).alias("_rows")))
    on = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_key{i}")) for i, k in enumerate(keys)])
    numbered = rows.join(first.filter("_rows = 1"), on).withColumn("id", F.col("_from"))
    if not first.filter("_rows > 1").isEmpty():  # rows that share a key are told apart by their content
        order = [F.asc(F.xxhash64(*[F.col(c) for c in rows.columns]))]
        several = distributed_rank(rows.join(first.filter("_rows > 1"), on), ["_from"], order, "_k")
        numbered = numbered.unionByName(several.withColumn("id", F.col("_from") + F.col("_k") - 1).drop("_k"))
    if mode == "short":
        return numbered.select("id", speaker, "party", "text", "type", "words")
    return numbered.select("id", speaker, "party", "type", "category", "words", preview(F.col("text")).alias("preview"), "text")


def export_speech_db(speeches: DataFrame, path: str, mode: str = "full", **kwargs) -> None:
    """Write ``speech_db`` as JSON lines."""
    speech_db(speeches, mode, **kwargs).write.mode("overwrite").json(path)


def export_profiles(documents: DataFrame, listing: DataFrame, path: str) -> None:
    """Speaker records and their index as JSON lines; overwriting removes stale records."""
    documents.write.mode("overwrite").json(f"{path}/speakers")
    listing.write.mode("overwrite").json(f"{path}/index")


def summary(counts: DataFrame, totals: DataFrame) -> DataFrame:
    """Per party and in total (party null): speeches, words, and unique and total nouns, adjectives and verbs.

    ``counts(party, word_type, word, n)``, ``totals(party, speeches, total_words)``.
    """

    def kinds(df: DataFrame, keys: Sequence[str]) -> DataFrame:
        per = df.groupBy(*keys, "word_type", "word").agg(F.sum("n").alias("n"))
        aggs: list[Column] = []
        for kind in ("noun", "adjective", "verb"):
            hit = F.col("word_type") == kind
            aggs += [
                F.sum(F.when(hit, 1).otherwise(0)).cast("long").alias(f"unique_{kind}s"),
                F.coalesce(F.sum(F.when(hit, F.col("n"))), F.lit(0)).cast("long").alias(f"total_{kind}s"),
            ]
        return per.groupBy(*keys).agg(*aggs)

    by_party, overall = kinds(counts, ["party"]), kinds(counts, [])
    words = [c for c in by_party.columns if c != "party"]
    all_words = by_party.unionByName(overall.withColumn("party", F.lit(None).cast("string"))).withColumnRenamed("party", "_party")
    all_totals = totals.rollup("party").agg(F.sum("speeches").alias("speeches"), F.sum("total_words").alias("total_words"))
    joined = all_totals.join(all_words, F.col("party").eqNullSafe(F.col("_party")), "left")
    return joined.na.fill(0, words).select("party", "speeches", "total_words", *words)


def export_summary(counts: DataFrame, totals: DataFrame, path: str) -> None:
    """Write ``summary`` as JSON lines."""
    summary(counts, totals).write.mode("overwrite").json(path)


def export_raw(spark: SparkSession, tables: dict[str, DataFrame], path: str, version: str, rows_per_file: int = 200_000) -> DataFrame:
    """Write every table as gzip JSON lines and a manifest of file name, size and SHA-256; returns the manifest.

    ``rows_per_file`` bounds the files, since a checksum reads a file as one value.
    """
    for name, df in tables.items():
        df.write.mode("overwrite").option("compression", "gzip").option("maxRecordsPerFile", rows_per_file).json(f"{path}/{version}/{name}")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.json.gz").load([f"{path}/{version}/{n}" for n in tables])
    manifest = files.select(
        F.lit(version).alias("version"), F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("dataset"),
        F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"),
    )
    manifest.write.mode("overwrite").json(f"{path}/{version}/manifest")
    return spark.read.schema(manifest.schema).json(f"{path}/{version}/manifest")


def export_evaluation(metrics: DataFrame, path: str) -> None:
    """Write per-protocol evaluation metrics as JSON lines."""
    metrics.write.mode("overwrite").json(path)


def append_unknown_names(names: DataFrame, path: str) -> None:
    """Append unresolved names as text lines, for review."""
    names.select(F.col("name").alias("value")).write.mode("append").text(path)
