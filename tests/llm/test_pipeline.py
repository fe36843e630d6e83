"""The pipeline's stages, one after another, against a plain version of each."""

import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from rostrum.llm.common import kept

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = docs.limit(1).select(F.lit(10**6).cast("long").alias("doc_id"), F.lit("12 34").alias("text"), F.lit(None).cast("string").alias("lang"), "source", "n_chars")
    docs = docs.unionByName(odd).withColumn("_row", F.lit(1)).withColumn("score", F.lit("x")).withColumn("_id", F.lit(2))
    out = [docs]
    for name, stage in cp.STAGES:
        out.append(kept(stage(spark, out[-1], SF), f"test-{name}"))
    return out


def test_stages_return_the_columns_of_documents(steps):
    assert [name for name, _ in cp.STAGES] == ["language", "exact", "near", "mixing", "packing"]
    assert all(sorted(s.columns) == sorted(steps[0].columns) for s in steps[1:-1])


def test_stage_decisions(steps):
    docs, language, exact, near, mixed, packed = steps
    assert {r.doc_id for r in docs.collect()} - {r.doc_id for r in language.collect()} == {10**6}
    norm = lambda t: re.sub("[\x20\x09-\x0d]", "", t)
    assert sorted(norm(r.text) for r in exact.collect()) == sorted({norm(r.text) for r in language.collect()})
    left = {r.doc_id: r.text for r in near.collect()}
    gone = {r.doc_id: r.text for r in exact.collect() if r.doc_id not in left}
    sets = {d: {tuple(w[i : i + 5]) for w in [t.lower().split()] for i in range(max(1, len(w) - 4))} for d, t in (left | gone).items()}
    alike = lambda a, b: 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    assert all(any(alike(d, k) for k in sets if k != d) for d in gone)
    assert not any(alike(a, b) for a in left for b in left if a < b)
    ids = [r.doc_id for r in mixed.collect()]
    assert set(ids) <= set(left) and max(ids.count(i) for i in set(ids)) <= 2
    assert {r.doc_id for r in packed.collect()} == set(ids)


def test_near_stage_on_the_given_documents(steps):
    """What goes has a partner at 0.80 or more, and no two that stay are so alike."""
    exact, near = ({r.doc_id: r.text for r in s.collect()} for s in steps[2:4])
    sets = {d: {tuple(w[i : i + 5]) for w in [t.lower().split()] for i in range(max(1, len(w) - 4))} for d, t in exact.items()}
    alike = lambda a, b: 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    assert all(any(alike(d, k) for k in sets if k != d) for d in exact if d not in near)
    assert not any(alike(a, b) for a in near for b in near if a < b)


def test_near_stage_links_from_080_on(spark):
    """Copies at 0.80 exactly and at 0.81 go, those just below 0.80 stay."""
    base = lambda tag, n: [f"{tag}{i}" for i in range(n)]
    edited = lambda words, *at: [f"new{i}" if i in at else w for i, w in enumerate(words)]
    texts = {1: base("a", 49), 2: edited(base("a", 49), 20), 3: base("b", 100), 4: edited(base("b", 100), 20, 60), 5: base("c", 48), 6: edited(base("c", 48), 20)}
    sets = {d: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} for d, w in texts.items()}
    shares = [len(sets[d] & sets[d + 1]) / len(sets[d] | sets[d + 1]) for d in (1, 3, 5)]
    assert shares[0] == 0.8 < shares[1] < 0.85 and 0.79 < shares[2] < 0.8
    docs = spark.createDataFrame([(d, " ".join(w)) for d, w in texts.items()], "doc_id long, text string")
    assert sorted(r.doc_id for r in cp.distinct_shingles(spark, docs, SF).collect()) == [1, 3, 5, 6]


def test_near_stage_loses_no_text(spark):
    """Rows that share an id: only what has a partner goes, whatever its id."""
    base = " ".join(f"w{i}" for i in range(60))
    rows = [(1, base), (2, base + " more"), (2, "quite another text of its own"), (3, None), (None, base), (4, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in cp.distinct_shingles(spark, docs, SF).collect()), key=repr)
    assert got == sorted([rows[0], *rows[2:]], key=repr)


def test_empty_input(spark):
    none = spark.read.parquet(f"{SF}/documents.parquet").filter("doc_id < 0")
    for _, stage in cp.STAGES:
        assert stage(spark, none, SF).count() == 0
