"""Sources and sinks: files derived from the given tables are written to the shared folder, read back and compared."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from rostrum.operators import activity as ac
from rostrum.operators import rankings as rk
from rostrum.operators import tokens as tk
from rostrum.plans import corpus_queries, transcript_queries  # noqa: F401
from rostrum.plans import views as v
from rostrum.plans.registry import ORACLES, QUERIES, query
from rostrum.plans.sqltext import sql
from rostrum.session import ensure_checkpoint_dir, materialize
from rostrum.sources import readers, records, writers
from rostrum.streaming import current, ingest

#: Documents in one JSON file.
PER_FILE = 64


def folder(spark: SparkSession, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _protocol_files(spark: SparkSession, sf: str) -> str:
    """Protocol JSON files of the documents, some without text and some with a broken date."""
    i = F.col("doc_id")
    data = F.struct(
        i.cast("string").alias("id"), F.concat(F.lit("20/"), i.cast("string")).alias("dokumentnummer"),
        F.when(i % 13 == 0, F.lit("unknown")).otherwise(F.lit("2021-03-04")).alias("datum"), F.col("source").alias("herausgeber"), F.lit("20").alias("wahlperiode"),
    )
    one = F.struct(data.alias("data"), F.when(i % 17 == 0, F.lit("")).otherwise(F.col("text")).alias("fullText"))
    files = v.read(spark, sf, "documents").groupBy(F.floor(i / PER_FILE).alias("file")).agg(F.to_json(F.collect_list(one)).alias("value"))
    path = folder(spark, "protocols")
    files.select("value").write.option("maxRecordsPerFile", 1).text(path)
    return path


@query("read_protocols", """
SELECT doc_id AS protocol_id, '20/' || doc_id AS document_number, CASE WHEN doc_id % 13 = 0 THEN NULL ELSE '2021-03-04' END AS date, source AS publisher,
  CAST(20 AS BIGINT) AS period, length(text) AS chars FROM documents WHERE doc_id % 17 <> 0 AND text <> ''""")
def read_protocols(spark, sf):
    got = readers.read_protocols(spark, _protocol_files(spark, sf))
    return got.select("protocol_id", "document_number", F.col("date").cast("string").alias("date"), "publisher", "period", F.length("full_text").alias("chars"))


@query("ingest_stream", "SELECT doc_id AS protocol_id, source AS publisher, length(text) AS chars FROM documents WHERE doc_id % 17 <> 0 AND text <> ''")
def ingest_stream(spark, sf):
    """Protocol files streamed into a table, twice: the second run finds all ids there."""
    source, sink = _protocol_files(spark, sf), folder(spark, "sink")
    for run in ("first", "second"):
        ingest.ingest_incremental(spark, source, sink, folder(spark, f"stream-{run}")).awaitTermination()
    return spark.read.parquet(sink).select("protocol_id", "publisher", F.length("full_text").alias("chars"))


@query("read_records", """
SELECT CASE WHEN doc_id % 17 IN (0, 3, 5) OR text = '' THEN NULL ELSE doc_id END AS protocol_id, CASE WHEN doc_id % 17 IN (3, 5) THEN 'malformed' WHEN doc_id % 17 = 0 OR text = '' THEN 'no text' ELSE 'good' END AS outcome,
  CASE WHEN doc_id % 17 IN (0, 3, 5) OR text = '' THEN NULL ELSE length(text) END AS chars, CASE WHEN doc_id % 17 IN (0, 3, 5) OR text = '' THEN doc_id END AS raw_id FROM documents
UNION ALL SELECT NULL, 'no record', NULL, NULL FROM (SELECT DISTINCT doc_id // 64 AS file FROM documents WHERE (doc_id // 64) % 3 = 0)
UNION ALL SELECT NULL, 'no id', NULL, NULL FROM (SELECT DISTINCT doc_id // 64 AS file FROM documents WHERE (doc_id // 64) % 3 = 1)""")
def read_records(spark, sf):
    """Protocol files with records cut off in the middle, broken ones, some without id or text, and stray text in front: good rows and those set aside."""
    i, per = F.col("doc_id"), PER_FILE
    data = F.struct(i.cast("string").alias("id"), F.lit("20/1").alias("dokumentnummer"))
    record = F.to_json(F.struct(data.alias("data"), F.when(i % 17 == 0, F.lit("")).otherwise(F.col("text")).alias("fullText")))
    broken = F.when(i % 17 == 3, F.substring(record, F.lit(1), F.length(record) - 2)).when(i % 17 == 5, F.replace(record, F.lit('"dokumentnummer":'), F.lit('"dokumentnummer"'))).otherwise(record)
    files = v.read(spark, sf, "documents").groupBy(F.floor(i / per).alias("file")).agg(F.array_join(F.collect_list(broken), ",\n").alias("body"))
    before = F.when(F.col("file") % 3 == 0, 'stray text [').when(F.col("file") % 3 == 1, '[{"data":{"id":"x"},"fullText":"y"},').otherwise("[")
    path = folder(spark, "records")
    files.select(F.concat(before, "body", F.lit("]")).alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    got = records.read_records(spark, path)
    good = got.good.select("protocol_id", F.lit("good").alias("outcome"), F.length("full_text").alias("chars"), F.lit(None).cast("long").alias("raw_id"))
    none = F.lit(None).cast("long")
    raw_id = F.regexp_extract("raw", r'"id":"(\d+)"', 1).try_cast("long")
    return good.unionByName(got.quarantine.select(none.alias("protocol_id"), F.col("reason").alias("outcome"), none.cast("int").alias("chars"), raw_id.alias("raw_id")))


@query("read_record_lines", "SELECT CASE WHEN doc_id % 17 NOT IN (0, 3) AND text <> '' THEN doc_id END AS protocol_id, CASE WHEN doc_id % 17 = 3 THEN 'malformed' WHEN doc_id % 17 = 0 OR text = '' THEN 'no text' ELSE 'good' END AS outcome FROM documents")
def read_record_lines(spark, sf):
    """The same from files with a record a line, which tasks share."""
    i = F.col("doc_id")
    record = F.to_json(F.struct(F.struct(i.cast("string").alias("id")).alias("data"), F.when(i % 17 == 0, F.lit("")).otherwise(F.col("text")).alias("fullText")))
    path = folder(spark, "record-lines")
    v.read(spark, sf, "documents").select(F.when(i % 17 == 3, F.substring(record, F.lit(1), F.length(record) - 2)).otherwise(record).alias("value")).write.text(path)
    got = records.read_records(spark, path, lines=True)
    return got.good.select("protocol_id", F.lit("good").alias("outcome")).unionByName(got.quarantine.select(F.lit(None).cast("long").alias("protocol_id"), F.col("reason").alias("outcome")))


@query("ingest_once", "SELECT doc_id AS protocol_id, source AS publisher, length(text) AS chars FROM documents WHERE text <> ''")
def ingest_once(spark, sf):
    """Protocol files that arrive in three waves, the third late by its own date and full of repeated ids; then a replayed batch."""
    source, sink, checkpoint = folder(spark, "waves"), folder(spark, "once"), folder(spark, "once-state")
    i = F.col("doc_id")
    docs = v.read(spark, sf, "documents")

    def wave(n: int) -> None:
        chosen = docs.filter((i % 3 == n) | ((F.lit(n) == 2) & (i % 5 == 0)))
        data = F.struct(i.cast("string").alias("id"), F.lit("20/1").alias("dokumentnummer"), F.lit(f"{2023 - 10 * (n == 2) + n}-01-01").alias("datum"), F.col("source").alias("herausgeber"), F.lit("20").alias("wahlperiode"))
        one = F.struct(data.alias("data"), F.col("text").alias("fullText"))
        files = chosen.groupBy(F.floor(i / PER_FILE).alias("file")).agg(F.to_json(F.collect_list(one)).alias("value"))
        files.select("value").write.mode("append").option("maxRecordsPerFile", 1).text(source)

    for n in range(3):
        wave(n)
        current.ingest_once(readers.stream_protocols(spark, source), sink, checkpoint).awaitTermination()
    first = spark.read.parquet(f"{sink}/batch=0")
    current.write_batch(sink)(materialize(first), 0)
    return spark.read.parquet(sink).select("protocol_id", "publisher", F.length("full_text").alias("chars"))


def _arriving(spark: SparkSession, sf: str, tables: list[current.CurrentTable]) -> None:
    """The speeches of the documents taken in as a stream of four batches; the last is replayed."""
    source, sink, checkpoint = folder(spark, "arriving"), folder(spark, "arrived"), folder(spark, "arriving-state")
    docs = v.corpus_docs(spark, sf).withColumn("protocol_id", F.col("speech_id"))
    for n in range(4):
        docs.filter(F.col("speech_id") % 4 == n).write.mode("append").parquet(source)
        stream = spark.readStream.schema(docs.schema).parquet(source)
        current.ingest_once(stream, sink, checkpoint, also=current.keep_current(*tables)).awaitTermination()
    for t in tables:
        t.write(spark.read.parquet(f"{sink}/batch=3"), 3)


@query("current_activity", ORACLES["activity_counts"])
def current_activity(spark, sf):
    """Activity counts after four batches of a stream equal those of all speeches at once."""
    table = current.current_activity(folder(spark, "activity"), lambda b: b, compact_every=3)
    _arriving(spark, sf, [table])
    return table.read(spark)


@query("current_index", ORACLES["speaker_index"])
def current_index(spark, sf):
    """The speaker index after four batches of a stream equals that of all speeches at once."""
    table = current.current_index(folder(spark, "index"), lambda b: b, ["speech_id"], compact_every=3)
    _arriving(spark, sf, [table])
    return current.read_index(spark, table)


@query("read_speeches", sql("SELECT speech_id, party, speaker, type, category, words, length(text) AS chars FROM corpus", "corpus"))
def read_speeches(spark, sf):
    """Speeches from JSON files that map a party to its speeches."""
    d = v.corpus_docs(spark, sf)
    one = F.struct("speaker", "text", "type", "category", "words", F.col("speech_id").cast("string").alias("last_name"))
    lists = d.groupBy("party", F.floor(F.col("speech_id") / PER_FILE).alias("file")).agg(F.collect_list(one).alias("list"))
    path = folder(spark, "speeches")
    lists.select(F.to_json(F.create_map("party", "list")).alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    got = readers.read_speeches(spark, path)
    return got.select(F.col("last_name").cast("long").alias("speech_id"), "party", "speaker", "type", "category", "words", F.length("text").alias("chars"))


@query("write_speeches", sql("SELECT speech_id, party, speaker, type, words, length(text) AS chars FROM corpus", "corpus"))
def write_speeches(spark, sf):
    path = folder(spark, "speech-table")
    writers.write_speeches(v.corpus_docs(spark, sf), path)
    return readers.read_speech_table(spark, path).select("speech_id", "party", "speaker", "type", "words", F.length("text").alias("chars"))


@query("wide_frequencies_file", sql("""SELECT w.word, t.party, coalesce(p.n, 0) AS n, coalesce(round(CAST(p.n AS DOUBLE) / t.total_words * 1000, 4), 0) AS per_1000
FROM (SELECT DISTINCT word FROM pwc) w CROSS JOIN ptot t LEFT JOIN pwc p ON p.word = w.word AND p.party = t.party""", "ptot"))
def wide_frequencies_file(spark, sf):
    """The word x group table as sorted CSV files and back in long form; groups come from the data."""
    counts = tk.word_counts(v.corpus_docs(spark, sf), ["party"])
    path = folder(spark, "frequencies")
    writers.write_wide_frequencies(tk.frequency_matrix(counts, tk.token_totals(counts, ["party"])), path)
    return readers.read_wide_frequencies(spark, path)


def _result_file(spark: SparkSession, sf: str) -> str:
    counts = tk.word_counts(v.corpus_docs(spark, sf), ["party"])
    top = tk.top_words(counts, ["party"], 5).groupBy("party").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "word", "n"))), lambda w: F.array(w["word"], w["n"].cast("string"))).alias("top_nouns"))
    tone = F.create_map(F.lit("aggression"), F.lit(1.5), F.lit("authority"), F.lit(50.0))
    cats = F.create_map(F.lit("topic"), F.to_json(F.create_map(F.lit("klima"), F.to_json(F.create_map(F.lit("wind"), F.size("top_nouns"))), F.lit("totals"), F.lit('{"x":1}'))))
    rows = counts.groupBy("party").agg(F.sum("n").alias("total_words"), F.count("word").alias("speech_count")).join(top, "party")
    one = F.struct("party", "speech_count", "total_words", "top_nouns", tone.alias("tone_scores"), cats.alias("categories"))
    path = folder(spark, "results")
    rows.groupBy().agg(F.to_json(F.struct(F.collect_list(one).alias("results"))).alias("value")).write.text(path)  # a row per group
    return path


@query("read_results_words", sql("SELECT party, 'noun' AS word_type, word, n, row_number() OVER (PARTITION BY party ORDER BY n DESC, word) AS rank FROM pwc QUALIFY rank <= 5", "pwc"))
def read_results_words(spark, sf):
    return readers.read_results(spark, _result_file(spark, sf))["top_words"]


@query("read_results_stats", sql("SELECT p.party, count(*) AS speeches, CAST(sum(n) AS BIGINT) AS total_words, least(5, count(*)) AS unique_nouns, 1.5::DOUBLE AS aggression, least(5, count(*)) AS wind FROM pwc p GROUP BY p.party", "pwc"))
def read_results_stats(spark, sf):
    got = readers.read_results(spark, _result_file(spark, sf))
    tone = got["tone_scores"].filter("metric = 'aggression'").select("party", F.col("score").alias("aggression"))
    wind = got["categories"].select("party", F.col("n").alias("wind"))
    return got["party_stats"].select("party", "speeches", "total_words", "unique_nouns").join(tone, "party").join(wind, "party")


@query("export_speech_db", sql("SELECT row_number() OVER (ORDER BY speaker, speech_id) AS id, speaker, party, type, words, substr(text, 1, 500) AS text FROM corpus", "corpus"))
def export_speech_db(spark, sf):
    path = folder(spark, "speech-db")
    writers.export_speech_db(v.corpus_docs(spark, sf), path, mode="short")
    return spark.read.schema("id long, speaker string, party string, type string, words long, text string").json(path)


@query("export_raw", "SELECT 'nation' AS dataset, count(*) AS n, CAST(sum(n_nationkey) AS BIGINT) AS keys FROM nation UNION ALL SELECT 'customer', count(*), CAST(sum(c_custkey) AS BIGINT) FROM customer")
def export_raw(spark, sf):
    """Tables as gzip JSON lines with a manifest; what the manifest lists is read back and its checksums compared."""
    path = folder(spark, "raw")
    manifest = writers.export_raw(spark, {t: v.read(spark, sf, t) for t in ("nation", "customer")}, path, "v1", rows_per_file=500)
    files = spark.read.format("binaryFile").load([f"{path}/v1/{t}" for t in ("nation", "customer")])
    good = files.select(F.sha2("content", 256).alias("sha256")).join(manifest, "sha256").groupBy("dataset").agg(F.count(F.lit(1)).alias("files"))
    listed = manifest.groupBy("dataset").agg(F.count(F.lit(1)).alias("listed"))
    rows = [
        spark.read.schema(f"{c} long").json(f"{path}/v1/{t}").agg(F.lit(t).alias("dataset"), F.count(F.lit(1)).alias("n"), F.sum(c).alias("keys"))
        for t, c in (("nation", "n_nationkey"), ("customer", "c_custkey"))
    ]
    return rows[0].unionByName(rows[1]).join(good, "dataset").join(listed, "dataset").filter("files = listed").select("dataset", "n", "keys")


@query("overrides_file", "SELECT lower(n_name) AS first_name, CASE WHEN n_nationkey % 2 = 0 THEN 'female' ELSE 'male' END AS gender, 'manual' AS source, false AS ambiguous FROM nation")
def overrides_file(spark, sf):
    """Name overrides from a JSON file."""
    pairs = v.read(spark, sf, "nation").select("n_name", F.when(F.col("n_nationkey") % 2 == 0, "female").otherwise("male").alias("g"))
    path = folder(spark, "overrides")
    pairs.groupBy(F.floor(F.hash("n_name") / 2**28).alias("file")).agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("n_name", "g")))).alias("value")).select("value").write.option("maxRecordsPerFile", 1).text(path)
    return readers.load_overrides(spark, path)


@query("unknown_names_file", "SELECT c_name AS name, count(*) AS n FROM customer GROUP BY c_name")
def unknown_names_file(spark, sf):
    """Unresolved names appended as lines and read back."""
    path = folder(spark, "unknown")
    names = v.read(spark, sf, "customer").select(F.col("c_name").alias("name"))
    for part in (0, 1):
        writers.append_unknown_names(names.filter(F.pmod(F.hash("name"), F.lit(2)) == part), path)
    return spark.read.text(path).groupBy(F.col("value").alias("name")).agg(F.count(F.lit(1)).alias("n"))



@query("export_profiles", sql(f"""
, i AS ({corpus_queries._INDEX}), l AS (SELECT party, word, n, row_number() OVER (PARTITION BY party, speaker ORDER BY n DESC, word) AS k, speaker FROM wc QUALIFY k <= 5),
w AS (SELECT party, speaker, string_agg(word || ':' || n, ',' ORDER BY k) AS words FROM l GROUP BY ALL)
SELECT 'speakers' AS file, i.speaker, i.party, slug, speeches, wortbeitraege, total_words, coalesce(words, '') AS words FROM i LEFT JOIN w ON i.party = w.party AND i.speaker = w.speaker
UNION ALL SELECT 'index', speaker, party, slug, speeches, wortbeitraege, total_words, NULL FROM i""", "corpus", "wc"))
def export_profiles(spark, sf):
    """Speaker records with their words and their index written as JSON twice, the second time without stale ones, and read back."""
    docs = v.corpus_docs(spark, sf)
    index = materialize(ac.speaker_index(docs, ["speech_id"]))  # read for the records, their ranks and the listing, each written twice
    words = rk.listed_per_speaker(tk.top_words(tk.word_counts(docs, ["party", "speaker"]), ["party", "speaker"], 5), ["word", "n"], "top")
    ranks = index.select("speaker", "party", F.col("max_words").alias("longest"))
    records_ = materialize(rk.speaker_documents(index, ranks, ranks, ("words", words)))
    path = folder(spark, "profiles")
    for part in (records_.withColumn("slug", F.lit("stale")), records_):
        writers.export_profiles(part, rk.speaker_listing(index), path)
    cols = "speaker string, party string, slug string, speeches long, wortbeitraege long, total_words long"
    names = [c.split()[0] for c in cols.split(", ")]
    back = spark.read.schema(f"{cols}, words struct<top:array<struct<word:string,n:long>>>").json(f"{path}/speakers")
    listed = F.array_join(F.transform("words.top", lambda w: F.concat_ws(":", w["word"], w["n"].cast("string"))), ",")
    one = back.select(F.lit("speakers").alias("file"), *names, F.coalesce(listed, F.lit("")).alias("words"))
    return one.unionByName(spark.read.schema(cols).json(f"{path}/index").select(F.lit("index").alias("file"), *names, F.lit(None).cast("string").alias("words")))


@query("export_evaluation", ORACLES["detection_metrics"])
def export_evaluation(spark, sf):
    """Metrics per protocol and overall written as JSON and read back."""
    metrics = QUERIES["detection_metrics"](spark, sf)
    path = folder(spark, "evaluation")
    writers.export_evaluation(metrics, path)
    return spark.read.schema(metrics.schema).json(path)
