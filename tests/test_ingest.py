"""Record-level reading, keyed ingestion, tables kept current, running sums and dense numbers."""

import json
import random

import pytest
from pyspark.sql import functions as F

from rostrum.operators import activity as ac
from rostrum.operators import transcript as tr
from rostrum.operators.common import dealt_join, running
from rostrum.sources import readers as rd
from rostrum.sources import records as rc
from rostrum.sources import writers as wr
from rostrum.streaming import current as cu
from rostrum.streaming import ingest as ing


def record(i, text="Text", **more):
    return {"data": {"id": None if i is None else str(i), "dokumentnummer": f"21/{i}", "datum": "2025-05-06", "herausgeber": "BT"}, "fullText": text, **more}


def put(folder, name, text):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text(text, encoding="utf-8")


def test_records_of_odd_files(spark, tmp_path):
    src = tmp_path / "in"
    good = json.dumps(record(1, 'He said {"data": {"id": 7}} and ]}'))
    put(src, "one.json", json.dumps(record(2), indent=2))
    put(src, "array.json", "[" + ",\n ".join([good, json.dumps(record(3))[:-1], json.dumps(record(4, "ü\n" * 9)), json.dumps(record(5))[:40], json.dumps({"fullText": "x", "data": {"id": "6"}})]) + "]")
    put(src, "stray.json", "junk before " + json.dumps(record(8)))
    put(src, "odd.json", json.dumps([record(None), record("x1"), record(9, ""), record(10, None), record(11, extra={"a": [1, {"b": "}"}]})]))
    put(src, "empty.json", "")
    put(src, "junk.json", "{not json")
    got = rc.read_records(spark, str(src))
    assert sorted((r.protocol_id, r.full_text) for r in got.good.collect()) == [(1, 'He said {"data": {"id": 7}} and ]}'), (2, "Text"), (4, "ü\n" * 9), (6, "x"), (8, "Text"), (11, "Text")]
    assert got.good.columns == rd.read_protocols(spark, str(src)).columns
    aside = sorted((r.file.rsplit("/", 1)[1], r.offset, r.reason) for r in got.quarantine.collect())
    array, odd = (src / "array.json").read_text(), (src / "odd.json").read_text()
    places = [odd.index('{"data": {"id": ' + x) for x in ('null', '"x1"', '"9"', '"10"')]
    assert aside == sorted([
        ("array.json", array.index('{"data": {"id": "3"'), "malformed"), ("array.json", array.index('{"data": {"id": "5"'), "malformed"), ("junk.json", 0, "no record"), ("stray.json", 0, "no record"),
        *[("odd.json", p, why) for p, why in zip(places, ("no id", "no id", "no text", "no text"), strict=True)],
    ])


def test_record_lines(spark, tmp_path):
    put(tmp_path / "in", "a.json", "\n".join([json.dumps(record(1)), "", json.dumps(record(2))[:-3], "garbage", json.dumps(record(3))]))
    got = rc.read_records(spark, str(tmp_path / "in"), lines=True)
    assert sorted(r.protocol_id for r in got.good.collect()) == [1, 3]
    assert [(r.offset, r.reason) for r in got.quarantine.collect()] == [(None, "malformed")] * 2


def test_each_id_once_over_runs_and_replays(spark, tmp_path):
    src, sink, state = tmp_path / "in", str(tmp_path / "sink"), str(tmp_path / "state")
    seen = []
    run = lambda: cu.ingest_once(rd.stream_protocols(spark, str(src)), sink, state, also=[lambda b, e: seen.append((e, b.count()))]).awaitTermination()
    put(src, "1.json", json.dumps([record(1), record(2), record(2)]))
    run()
    put(src, "2.json", json.dumps([record(2), record(3)]))
    put(src, "3.json", json.dumps(record(1)))
    run()
    ids = lambda: sorted(r.protocol_id for r in spark.read.parquet(sink).collect())
    assert ids() == [1, 2, 3] and sum(n for _, n in seen) == 3
    batch = spark.read.parquet(f"{sink}/batch=1").checkpoint()
    cu.write_batch(sink)(batch, 1)
    assert ids() == [1, 2, 3]


SPEECHES = "protocol_id long, speech_id long, speaker string, party string, type string, category string, words long, acad_title string"


@pytest.mark.parametrize("compact_every", [1, 2, 3, 100])
def test_current_tables_equal_one_shot(spark, tmp_path, compact_every):
    rng = random.Random(3)
    kinds = [("rede", "rede"), ("befragung", "wortbeitrag"), ("fragestunde", "wortbeitrag"), ("sonstiges", "wortbeitrag")]
    rows = [(i % 7, i, *rng.choice([("A B", "SPD"), ("A-B", "AfD"), ("C", None), (None, "SPD")]), *rng.choice(kinds), rng.randrange(1, 900), rng.choice(["Dr", None])) for i in range(60)]
    rng.shuffle(rows)
    tables = [cu.current_activity(str(tmp_path / "a"), lambda b: b, compact_every=compact_every), cu.current_index(str(tmp_path / "i"), lambda b: b, compact_every=compact_every)]
    with pytest.raises(ValueError):
        tables[0].read(spark)
    for epoch in range(5):
        part = spark.createDataFrame(rows[12 * epoch : 12 * epoch + 12] if epoch != 2 else [], SPEECHES)
        for t in tables:
            t.write(part, epoch)
            t.write(part, epoch)
    every = spark.createDataFrame(rows[:24] + rows[36:], SPEECHES)
    same = lambda a, b: sorted(map(tuple, a.select(*b.columns).collect()), key=repr) == sorted(map(tuple, b.collect()), key=repr)
    assert same(tables[0].read(spark), ac.activity_counts(every))
    assert same(cu.read_index(spark, tables[1]), ac.speaker_index(every))


@pytest.mark.parametrize("n", [1, 2, 63, 64, 65, 4096, 4097, 20_000])
def test_running_sums(spark, n):
    df = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda x: (x % 7).cast("int")).alias("x"))
    got = df.select(running(F.col("x"), lambda a, b: a + b, F.lit(0), "int").alias("s"), "x").collect()[0]
    want = [0]
    for x in got.x:
        want.append(want[-1] + x)
    assert list(got.s) == want[:-1]


def test_segments_of_many_headers(spark):
    """20,000 headers: offsets, surroundings and question ranges as a plain scan gives them."""
    turns = [f"\nAnna Schmidt{'x' * (i % 5)} (SPD):\nText {i} dazu.\n" for i in range(20_000)]
    turns[5000] = "\nPräsidentin Julia Weber:\nIch rufe auf: Befragung der Bundesregierung.\n"
    turns[9000] = "\nPräsidentin Julia Weber:\nDamit beende ich die Befragung.\n"
    df = spark.createDataFrame([(1, "".join(turns))], "protocol_id long, full_text string")
    rows = tr.segment(df).select("ordinal", "kind", "prev_kind", "header_start", "end", "context", "qa_kind").orderBy("ordinal").collect()
    at, text = 0, "".join(turns)
    assert len(rows) == 20_000
    for i, (r, t) in enumerate(zip(rows, turns, strict=True)):
        kind = "president" if i in (5000, 9000) else "speaker"
        assert (r.ordinal, r.kind, r.header_start, r.end, r.context) == (i, kind, at, at + len(t), text[max(0, at - tr.CONTEXT_CHARS) : at])
        assert r.prev_kind == (None if i == 0 else "president" if i in (5001, 9001) else "speaker") and r.qa_kind == ("befragung" if 5000 < i <= 9000 else None)
        at += len(t)


def test_dense_numbers_with_shared_keys(spark):
    """Rows that share speaker and ids, also null ones, get neighbouring numbers; no text is in the sorted or kept rows."""
    rows = [(1, 2, "B", "x"), (1, 2, "B", "y"), (1, 2, "B", "y"), (None, None, None, "z"), (None, None, None, "w"), (2, 1, "A", "b"), (1, 1, "B", "c")]
    df = spark.createDataFrame([(p, i, s, "SPD", t, "rede", "rede", 1) for p, i, s, t in rows], "protocol_id long, speech_id long, speaker string, party string, text string, type string, category string, words long")
    got = wr.speech_db(df).orderBy("id").collect()
    assert [r.id for r in got] == list(range(1, 8))
    assert [r.speaker for r in got] == [None, None, "A", "B", "B", "B", "B"] and [r.text for r in got][2:4] == ["b", "c"] and sorted(r.text for r in got) == sorted(r[3] for r in rows)


def test_dealt_join_is_a_join(spark):
    left = spark.range(3000).select((F.col("id") % 3).alias("k"), F.col("id").alias("a"))
    right = spark.range(30).select((F.col("id") % 5).alias("k"), F.col("id").alias("b"))
    want = sorted(tuple(r) for r in left.join(right, "k").select("k", "a", "b").collect())
    assert sorted(tuple(r) for r in dealt_join(left, right, ["k"], rows=50).select("k", "a", "b").collect()) == want


def test_known_ids_are_not_broadcast(spark):
    """The ids in the sink grow with the corpus and stay off the driver."""
    batch = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b"), (None, "c")], "protocol_id long, full_text string")
    got = ing.new_protocols(batch, spark.createDataFrame([(1,)], "protocol_id long"))
    assert [tuple(r) for r in got.collect()] == [(2, "b")]
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()


def test_small_files_are_one_batch(spark, tmp_path):
    """The batches of a stream grow in number with the size of the texts, not with the number of files."""
    for i in range(1010):
        (tmp_path / f"{i}.json").write_text(f'{{"data": {{"id": "{i}"}}, "fullText": "text {i}"}}', encoding="utf-8")
    sizes = []
    run = lambda files: rd.stream_protocols(spark, str(tmp_path), files).writeStream.foreachBatch(lambda b, e: sizes.append(b.count())).trigger(availableNow=True).start().awaitTermination()
    run(None)
    assert sizes == [1010]
    run(600)
    assert sizes[1:] == [600, 410]
