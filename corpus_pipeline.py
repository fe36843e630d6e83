"""The corpus pipeline: documents in, packed training sequences out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rostrum.llm import exact, langid, mixing, nearminhash, packing
from rostrum.llm.common import fresh, kept, word_count
from rostrum.llm.queries import word_tokenizer


def rows_with(docs: DataFrame, **keys: Column) -> DataFrame:
    """The rows as one column ``_row`` beside some keys, so that names of further columns cannot clash."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), *[k.alias(name) for name, k in keys.items()])


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; those without a letter or without text go."""
    model = langid.fit(docs)
    names = tuple(fresh(docs.columns, n) for n in ("held_out", "lang_pred", "score"))
    found = langid.identify(docs, model, names=names)
    return found.filter(F.col(names[1]) != langid.UNKNOWN).select(*[F.col(f"`{c}`") for c in docs.columns])


def distinct_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that is equal without white space."""
    return exact.exact_rows(docs)


def distinct_shingles(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, linked at a Jaccard similarity of 0.8 or more."""
    surplus = nearminhash.near_groups(docs, percent=80).filter("NOT kept").select(F.col("doc_id").alias("_gone"), F.col("text_hash").alias("_text")).distinct()
    rows = rows_with(docs, _key=F.col("doc_id"), _hash=F.xxhash64("text"))
    return rows.join(kept(surplus, "surplus"), (F.col("_key") == F.col("_gone")) & (F.col("_hash") == F.col("_text")), "left_anti").select("_row.*")


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated so that each source comes near its target; those the mix leaves out go.

    Rows that share an id and a size are repeated alike.
    """
    plan = mixing.mix(docs, weights=(5, 2, 1), share=1.5, max_epochs=2.0)
    plan = plan.groupBy(F.col("doc_id").alias("_id"), F.col("size").alias("_words")).agg(F.max("repeats").alias("_repeats")).filter("_repeats > 0")
    on = F.col("_key").eqNullSafe(F.col("_id")) & (F.col("_size") == F.col("_words"))
    out = rows_with(docs, _key=F.col("doc_id"), _size=word_count(F.col("text"))).join(plan, on)
    return out.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_repeats")))).select("_row.*")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in windows of 2048 tokens."""
    return packing.pack(docs, word_tokenizer())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", known_language),
    ("exact", distinct_texts),
    ("near", distinct_shingles),
    ("mixing", mixed_sources),
    ("packing", packed),
]

#: The language model and the tokenizer cannot be expressed in SQL; the tests compare with a plain Python version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each written and read again as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = kept(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
