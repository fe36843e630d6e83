"""Readers for protocols, speeches, frequency tables, results, lexicons and name tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rostrum.functions.text import derive_category
from rostrum.operators.lexicon import dedupe_lexicon
from rostrum.operators.tokens import unpivot_frequencies

PROTOCOL_SCHEMA = (
    "data struct<id:string,dokumentnummer:string,datum:string,herausgeber:string,wahlperiode:string>, fullText string"
)
#: Size of the files of one batch of a stream.
BATCH_BYTES = 1 << 30
SPEECH_STRUCT = (
    "struct<speaker:string,text:string,type:string,category:string,words:bigint,first_name:string,"
    "last_name:string,acad_title:string,is_government:boolean,start:int,`end`:int>"
)


def protocol_columns(df: DataFrame) -> DataFrame:
    """Columns of parsed protocol records that have a text."""
    return df.filter(F.coalesce(F.col("fullText"), F.lit("")) != "").select(
        F.col("data.id").try_cast("long").alias("protocol_id"),
        F.col("data.dokumentnummer").alias("document_number"),
        F.col("data.datum").try_cast("date").alias("date"),
        F.col("data.herausgeber").alias("publisher"),
        F.col("data.wahlperiode").try_cast("int").alias("period"),
        F.col("fullText").alias("full_text"),
    )


def read_protocols(spark: SparkSession, path: str) -> DataFrame:
    """Protocol JSON files (one document per file). Unreadable files and empty texts are skipped."""
    raw = spark.read.schema(PROTOCOL_SCHEMA).option("multiLine", True).option("mode", "DROPMALFORMED").json(path)
    return protocol_columns(raw)


def stream_protocols(spark: SparkSession, path: str, max_files: int | None = None, max_bytes: int = BATCH_BYTES) -> DataFrame:
    """The same files as a stream: each new file becomes rows of ``read_protocols`` once.

    A batch takes files of ``max_bytes`` in sum, or ``max_files`` of them if that is given. Each batch costs a commit of
    state and sink, so a batch by size keeps their number in proportion to the texts, however small the files are.
    """
    raw = spark.readStream.schema(PROTOCOL_SCHEMA).option("multiLine", True).option("mode", "DROPMALFORMED")
    raw = raw.option("maxBytesPerTrigger", max_bytes) if max_files is None else raw.option("maxFilesPerTrigger", max_files)
    return protocol_columns(raw.json(path))


def read_speeches(spark: SparkSession, path: str) -> DataFrame:
    """Speeches from JSON files that map a party to its list of speeches; the party becomes a column."""
    parsed = spark.read.text(path, wholetext=True).select(
        F.from_json("value", f"map<string,array<{SPEECH_STRUCT}>>").alias("m")
    )
    rows = parsed.select(F.explode("m").alias("party", "list")).select("party", F.inline("list"))
    return rows.withColumn("category", derive_category(F.col("type"), F.col("category")))


def read_speech_table(spark: SparkSession, path: str) -> DataFrame:
    """Speeches as written by ``write_speeches``: parquet partitioned by party, so party filters prune files."""
    return spark.read.parquet(path)


def read_wide_frequencies(spark: SparkSession, path: str) -> DataFrame:
    """Word x party CSV in long form ``(word, party, n, per_1000)``; parties come from the ``*_count`` columns."""
    return unpivot_frequencies(spark.read.option("header", True).csv(path))


def read_results(spark: SparkSession, path: str, exclude_groups: Sequence[str] = ("fraktionslos",)) -> dict[str, DataFrame]:
    """Nested result JSON as tables ``party_stats``, ``top_words``, ``tone_scores`` and ``categories``."""
    schema = (
        "results array<struct<party:string,speech_count:bigint,total_words:bigint,total_nouns:bigint,total_adjectives:bigint,"
        "total_verbs:bigint,top_nouns:array<array<string>>,top_adjectives:array<array<string>>,top_verbs:array<array<string>>,"
        "tone_scores:map<string,double>,categories:map<string,string>>>"
    )
    rows = spark.read.schema(schema).option("multiLine", True).json(path).select(F.inline("results"))
    if exclude_groups:
        rows = rows.filter(~F.col("party").isin(*exclude_groups))
    stats = rows.select(
        "party", F.col("speech_count").alias("speeches"), "total_words", "total_nouns", "total_adjectives", "total_verbs",
        F.size("top_nouns").cast("long").alias("unique_nouns"),
    )
    lists = F.create_map(
        F.lit("noun"), F.col("top_nouns"), F.lit("adjective"), F.col("top_adjectives"), F.lit("verb"), F.col("top_verbs")
    )
    words = (
        rows.select("party", F.explode(lists).alias("word_type", "list"))
        .select("party", "word_type", F.posexplode("list").alias("pos", "pair"))
        .select("party", "word_type", F.col("pair")[0].alias("word"), F.col("pair")[1].cast("long").alias("n"), (F.col("pos") + 1).alias("rank"))
    )
    tone = rows.filter(F.col("tone_scores").isNotNull()).select("party", F.explode("tone_scores").alias("metric", "score"))
    cats = (
        rows.select("party", F.explode("categories").alias("scheme", "_json"))
        .select("party", "scheme", F.explode(F.from_json("_json", "map<string,string>")).alias("category", "_words"))
        .filter(F.col("_words").startswith("{") & (F.col("category") != "totals"))
        .select("party", "scheme", "category", F.explode(F.from_json("_words", "map<string,bigint>")).alias("word", "n"))
    )
    return {"party_stats": stats, "top_words": words, "tone_scores": tone, "categories": cats}


def read_lexicon(spark: SparkSession, path: str, on_conflict: str = "last") -> DataFrame:
    """Lexicon CSV ``scheme,category,word,weight,ord``; ``ord`` decides which of two categories of a word counts."""
    df = spark.read.option("header", True).schema("scheme string, category string, word string, weight double, ord long").csv(path)
    return dedupe_lexicon(df.withColumn("word", F.lower("word")).na.fill(1.0, ["weight"]), "ord", on_conflict)


def load_overrides(spark: SparkSession, path: str) -> DataFrame:
    """Name -> gender JSON as rows ``(first_name, gender, source, ambiguous)`` with lower-case names."""
    parsed = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,string>").alias("m"))
    return parsed.select(F.explode("m").alias("k", "gender")).select(
        F.lower("k").alias("first_name"), "gender", F.lit("manual").alias("source"), F.lit(False).alias("ambiguous")
    )
