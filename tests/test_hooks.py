"""Decision lists as tables and the columnar annotator, against plain versions."""

import random
import re

import pytest
from pyspark.sql import functions as F

from rostrum.functions.rules import start_rules
from rostrum.operators import ruletable as rt
from rostrum.operators import tokens as tk
from rostrum.operators.common import lookup_frame


def first_label(text, rules, default="other"):
    """The label by testing rule after rule."""
    text = text or ""
    for _, label, tests in sorted(rules, key=lambda r: (r[0], r[1])):
        def holds(t):
            head = (text[: t["window"]] if t["window"] else text).lower()
            if t["kind"] == rt.REGEX:
                return re.search(t["pattern"].replace(r"[\p{L}\p{N}_]", r"\w"), head) is not None
            return head.startswith(t["pattern"].lower()) if t["kind"] == rt.STARTS else t["pattern"].lower() in head

        if all(holds(t) for t in tests):
            return label
    return default


def test_tables_decide_as_lists(spark):
    rng = random.Random(12)
    test = lambda kind, pattern, window=0: {"window": window, "kind": kind, "pattern": pattern}
    parts = ["ab", "Ab c", "b.", "ä*", "c"]
    rules = [(i * 10, f"l{i % 7}", [test(rt.STARTS, "".join(rng.choice(parts) for _ in range(rng.randrange(1, 5))))]) for i in range(40)]
    rules += [(i * 10 + 205, f"m{i}", [test(rng.choice([rt.CONTAINS, rt.STARTS]), rng.choice(parts), rng.choice([0, 3, 9])), test(rt.CONTAINS, rng.choice(parts), 6)]) for i in range(20)]
    rules += [(77, "re", [test(rt.REGEX, r"b\.\s*c$")]), (33, "short window", [test(rt.STARTS, "ab c", 2)]), (40, "same", [test(rt.STARTS, "ab")]), (40, "other way", [test(rt.STARTS, "AB")])]
    texts = [None, "", "zz"] + ["".join(rng.choice([*parts, " "]) for _ in range(rng.randrange(1, 9))) for _ in range(300)]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "id int, text string, label string")
    table = lookup_frame(spark, rules, rt.RULE_SCHEMA)
    got = {r.id: r.label for r in rt.classify_by_table(df, table, ["id"]).collect()}
    assert got == {i: first_label(t, rules) for i, t in enumerate(texts)} and len(set(got.values())) > 10
    assert {r.label for r in rt.classify_by_table(df, table.limit(0), ["id"], default=None).collect()} == {None}
    assert rt.classify_by_table(df.limit(0), table, ["id"]).count() == 0


def test_built_in_rules_as_a_table(spark):
    from rostrum.functions import rules as ru
    from rostrum.plans.transcript_queries import _TABLE_OPENINGS

    df = spark.createDataFrame([(i, o + " und mehr") for i, (o, _) in enumerate(_TABLE_OPENINGS)], "id int, text string")
    table = rt.classify_by_table(df, rt.rule_table(spark, start_rules()), ["id"])
    both = table.join(df, "id").select("label", ru.classify_start(F.col("text")).alias("listed")).collect()
    assert len(both) == len(_TABLE_OPENINGS) and all(r.label == r.listed for r in both)


def test_table_bounds(spark, monkeypatch):
    monkeypatch.setattr(rt, "MOST_TESTED", 3)
    with pytest.raises(ValueError):
        rt.classify_by_table(spark.createDataFrame([(1, "x")], "id int, text string"), rt.rule_table(spark, start_rules()), ["id"])


@pytest.fixture
def annotator():
    """A model that workers get by value."""

    def load():
        import re

        calls = []

        def run(texts):
            calls.append(sum(map(len, texts)))
            if any("boom" in t for t in texts):
                raise RuntimeError("cannot read this")
            rows = [(i, w) for i, t in enumerate(texts) for w in re.findall(r"\w+", t)]
            ent = []
            for i, w in rows:
                ent.append((sum(1 for j, x in rows[: len(ent)] if j == i and x.istitle()) if w.istitle() else None))
            return {"text": [i for i, _ in rows], "token": [w for _, w in rows], "lemma": [w.lower() for _, w in rows], "ent_id": ent, "upos": ["PROPN" if e is not None else "X" for e in ent]}

        return run

    return load


@pytest.mark.parametrize("max_chars", [7, 40, 1 << 20])
def test_columns_of_whole_texts(spark, annotator, max_chars):
    texts = {1: "Anna sees Bernd and Clara", 2: "a b c " * 20, 3: "", 4: "fine " * 5 + "boom " + "more " * 5, 5: "x" * 30, 6: "Dora", 7: None, 8: "   "}
    df = spark.createDataFrame([(i, t, "idx") for i, t in texts.items()] + [(None, "no id", "x")], "doc_id long, text string, idx string").repartition(2)
    tokens, failed = tk.split_errors(tk.annotate_columns(df, annotator, max_chars=max_chars))
    got = {}
    for r in tokens.orderBy("doc_id", "idx").collect():
        got.setdefault(r.doc_id, []).append(r)
    for i, t in texts.items():
        rows = got.get(i, [])
        assert [r.idx for r in rows] == list(range(len(rows)))
        if i not in (4, 5):
            assert [r.token for r in rows] == re.findall(r"\w+", t or "")
        assert [r.ent_id for r in rows if r.ent_id is not None] == list(range(sum(r.token.istitle() for r in rows)))
        assert all(r.is_space is False and r.ent_label is None for r in rows)
    assert "".join(r.token for r in got[5]) == "x" * 30
    bad = failed.collect()
    assert [(r.doc_id, r.error) for r in bad] == [(4, "RuntimeError: cannot read this")] and texts[4][bad[0].start :][: max_chars].count("boom") == 1
    assert len(got.get(4, [])) == (0 if max_chars > 100 else len([w for w in texts[4].split()]) - len(texts[4][bad[0].start :][:max_chars].split()) if max_chars != 7 else 10)
    assert tk.annotate_columns(df.limit(0), annotator).count() == 0


def test_parts_cover_a_text():
    rng = random.Random(2)
    for _ in range(200):
        text = "".join(rng.choice("ab \n") for _ in range(rng.randrange(0, 60)))
        parts = list(tk._cut_text(text, 7))
        assert "".join(p for _, p in parts) == text and all(len(p) <= 7 for _, p in parts)
        assert all(text[s : s + len(p)] == p for s, p in parts)


def test_annotated_columns_are_not_sorted(spark):
    """The counts of the annotator query hash its tokens; only one row per text and error is sorted for the greatest error."""
    import __spark_entry__ as entries

    plan = entries.queries()["annotate_columns"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    below = plan.split("MapInArrow")[0].splitlines()
    nearest = [line for line in below if "Aggregate" in line][-1]
    assert "HashAggregate" in nearest
