import gzip
import hashlib
import json

from pyspark.sql import functions as F

from rostrum.functions.text import preview
from rostrum.operators import attributes as at
from rostrum.operators import tokens as tk
from rostrum.sources import readers as rd
from rostrum.sources import writers as wr
from rostrum.streaming import ingest


def _protocol(i, publisher="BT", text="Text"):
    return {"data": {"id": str(i), "dokumentnummer": f"21/{i}", "datum": "2025-05-06", "herausgeber": publisher}, "fullText": text}


def _write(folder, name, value):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text(value if isinstance(value, str) else json.dumps(value, indent=1), encoding="utf-8")


def test_read_protocols(spark, tmp_path):
    src = tmp_path / "protocols"
    _write(src, "1.json", _protocol(1))
    _write(src, "2.json", _protocol(2, text=""))
    _write(src, "3.json", "{not json")
    _write(src, "4.json", {"data": {"id": "4"}})
    got = rd.read_protocols(spark, str(src)).collect()
    assert [(r.protocol_id, r.document_number, str(r.date), r.publisher, r.full_text) for r in got] == [(1, "21/1", "2025-05-06", "BT", "Text")]


def test_incremental_ingestion_resumes(spark, tmp_path):
    src, sink, cp = tmp_path / "in", str(tmp_path / "sink"), str(tmp_path / "cp")
    _write(src, "1.json", _protocol(1))
    _write(src, "2.json", _protocol(2, publisher="BR"))
    ingest.ingest_incremental(spark, str(src), sink, cp, publisher="BT").awaitTermination()
    assert [r.protocol_id for r in spark.read.parquet(sink).collect()] == [1]
    _write(src, "3.json", _protocol(3))
    _write(src, "1b.json", _protocol(1))
    ingest.ingest_incremental(spark, str(src), sink, cp, publisher="BT").awaitTermination()
    assert sorted(r.protocol_id for r in spark.read.parquet(sink).collect()) == [1, 3]
    # a replayed batch appends nothing
    ingest.write_new_protocols(rd.read_protocols(spark, str(src)), sink, "BT")
    assert spark.read.parquet(sink).count() == 2


def test_pending_and_status(spark):
    listing = spark.createDataFrame([(1, "BT"), (2, "BT"), (3, "BR"), (4, "BT")], "id long, publisher string")
    done = spark.createDataFrame([(1,)], "id long")
    assert [r.id for r in ingest.pending_ids(listing, done, "id", "BT", 1).collect()] == [2]
    state = spark.createDataFrame([(1, "failed"), (2, "downloaded")], "id long, state string")
    new = ingest.mark(state, spark.createDataFrame([(1, "downloaded")], "id long, state string"))
    assert ingest.ingest_status(new).collect()[0].status == "complete"
    assert ingest.ingest_status(state).collect()[0].asDict() == {"total": 2, "downloaded": 1, "failed": 1, "pending": 1, "status": "in_progress"}
    assert ingest.ingest_status(state.limit(0)).collect()[0].status == "empty"


def test_speeches_round_trip(spark, tmp_path):
    src = tmp_path / "speeches.json"
    src.write_text(json.dumps({"SPD": [{"speaker": "A", "text": "x", "type": "rede", "words": 3}], "AfD": [{"speaker": "B", "text": "y", "type": "other", "words": 1, "category": None}]}))
    df = rd.read_speeches(spark, str(src))
    assert sorted((r.party, r.speaker, r.category, r.words) for r in df.collect()) == [("AfD", "B", "wortbeitrag", 1), ("SPD", "A", "rede", 3)]
    (tmp_path / "lines.json").write_text(json.dumps(json.loads(src.read_text()), indent=2))
    assert sorted(map(tuple, rd.read_speeches(spark, str(tmp_path / "lines.json")).collect())) == sorted(map(tuple, df.collect()))
    wr.write_speeches(df, str(tmp_path / "out"))
    back = rd.read_speech_table(spark, str(tmp_path / "out"))
    assert back.filter("party = 'SPD'").count() == 1
    assert "PartitionFilters: [isnotnull(party" in back.filter("party = 'SPD'")._jdf.queryExecution().executedPlan().toString()


def test_frequency_csv_round_trip(spark, tmp_path):
    counts = spark.createDataFrame([("SPD", "haus", 3), ("AfD", "haus", 1), ("SPD", "baum", 1)], "party string, word string, n long")
    matrix = tk.frequency_matrix(counts, tk.token_totals(counts, ["party"]), ["SPD", "AfD"])
    wr.write_wide_frequencies(matrix, str(tmp_path / "m"))
    got = {(r.word, r.party): (r.n, r.per_1000) for r in rd.read_wide_frequencies(spark, str(tmp_path / "m")).collect()}
    assert got == {("haus", "SPD"): (3, 750.0), ("haus", "AfD"): (1, 1000.0), ("baum", "SPD"): (1, 250.0), ("baum", "AfD"): (0, 0.0)}


def test_read_results(spark, tmp_path):
    result = {"party": "SPD", "speech_count": 2, "total_words": 9, "total_nouns": 4, "total_adjectives": 1, "total_verbs": 1, "top_nouns": [["haus", 3], ["baum", 1]],
              "top_adjectives": [["gut", 1]], "top_verbs": [], "tone_scores": {"aggression": 1.5}, "categories": {"verbs": {"solution": {"bauen": 2}, "totals": {"solution": 2}, "total_analyzed": 2}, "total_words": 9}}
    path = tmp_path / "full.json"
    path.write_text(json.dumps({"metadata": {}, "results": [result, {**result, "party": "fraktionslos"}]}, indent=1))
    got = rd.read_results(spark, str(path))
    assert [(r.party, r.speeches, r.unique_nouns) for r in got["party_stats"].collect()] == [("SPD", 2, 2)]
    assert sorted((r.word_type, r.word, r.n, r["rank"]) for r in got["top_words"].collect()) == [("adjective", "gut", 1, 1), ("noun", "baum", 1, 2), ("noun", "haus", 3, 1)]
    assert [(r.metric, r.score) for r in got["tone_scores"].collect()] == [("aggression", 1.5)]
    assert [(r.scheme, r.category, r.word, r.n) for r in got["categories"].collect()] == [("verbs", "solution", "bauen", 2)]


def test_lexicon_and_overrides(spark, tmp_path):
    (tmp_path / "lex.csv").write_text("scheme,category,word,weight,ord\nverb,solution,Bauen,,1\nverb,problem,bauen,,2\n", encoding="utf-8")
    assert [tuple(r) for r in rd.read_lexicon(spark, str(tmp_path / "lex.csv")).collect()] == [("verb", "problem", "bauen", 1.0)]
    assert [r.category for r in rd.read_lexicon(spark, str(tmp_path / "lex.csv"), "first").collect()] == ["solution"]
    (tmp_path / "o.json").write_text('{"Kim": "female"}')
    names = rd.load_overrides(spark, str(tmp_path / "o.json"))
    df = spark.createDataFrame([("Kim Lee",), ("Zzz",)], "first_name string")
    found = at.detect_gender(df, names)
    assert {r.first_name: (r.gender, r.source) for r in found.collect()} == {"Kim Lee": ("female", "manual"), "Zzz": ("unknown", "unknown")}
    wr.append_unknown_names(at.unknown_names(found), str(tmp_path / "unknown"))
    known = spark.read.text(str(tmp_path / "unknown")).withColumnRenamed("value", "name")
    assert [r.name for r in known.collect()] == ["zzz"] and at.unknown_names(found, known).isEmpty()


def test_speech_db(spark, tmp_path):
    df = spark.createDataFrame([(1, 2, "B", "SPD", "x\ny" * 400, "rede", "rede", 5), (1, 1, "B", "SPD", "a", "rede", "rede", 1), (2, 1, "A", "AfD", "b", "rede", "rede", 1)],
                               "protocol_id long, speech_id long, speaker string, party string, text string, type string, category string, words long")
    full = wr.speech_db(df).orderBy("id").collect()
    assert [(r.id, r.speaker, r.words) for r in full] == [(1, "A", 1), (2, "B", 1), (3, "B", 5)]
    assert full[2].preview == df.select(preview(F.col("text")).alias("p")).filter("length(p) > 9").collect()[0].p
    wr.export_speech_db(df, str(tmp_path / "db"), "short")
    assert max(len(r.text) for r in spark.read.json(str(tmp_path / "db")).collect()) == 500


def test_raw_export_manifest(spark, tmp_path):
    manifest = wr.export_raw(spark, {"a": spark.range(10), "b": spark.range(3)}, str(tmp_path), "v1").collect()
    assert {r.dataset for r in manifest} == {"a", "b"}
    lines = 0
    for r in manifest:
        data = (tmp_path / "v1" / r.dataset / r.file).read_bytes()
        assert hashlib.sha256(data).hexdigest() == r.sha256 and len(data) == r.bytes
        lines += gzip.decompress(data).count(b"\n")
    assert lines == 13


def test_profile_and_evaluation_exports(spark, tmp_path):
    df = spark.createDataFrame([("A", "SPD")], "speaker string, party string")
    for _ in range(2):
        wr.export_profiles(df, df, str(tmp_path / "p"))
    wr.export_evaluation(df, str(tmp_path / "e"))
    totals = spark.createDataFrame([("SPD", 2, 10)], "party string, speeches long, total_words long")
    counts = spark.createDataFrame([("SPD", "noun", "haus", 3)], "party string, word_type string, word string, n long")
    wr.export_summary(counts, totals, str(tmp_path / "s"))
    assert spark.read.json(str(tmp_path / "p" / "speakers")).count() == 1 and spark.read.json(str(tmp_path / "e")).count() == 1
    assert sorted(spark.read.json(str(tmp_path / "s")).select("unique_nouns", "total_nouns", "unique_verbs").collect()) == [(1, 3, 0), (1, 3, 0)]
