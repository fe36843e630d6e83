import random
import re

import pytest
from pyspark.sql import functions as F

from rostrum.operators import common
from rostrum.operators import matching as ma
from rostrum.operators import similar as si


def shingles(text, words):
    found = re.findall("[^\x20\x09-\x0D]+", (text or "").lower())
    return {tuple(found[i : i + words]) for i in range(max(1, len(found) - words + 1))} if found else set()


def shared(a, b, words):
    a, b = shingles(a, words), shingles(b, words)
    return len(a & b) / len(a | b) if a and b else 0.0


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        nxt = [i]
        for j, y in enumerate(b, 1):
            nxt.append(min(nxt[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = nxt
    return row[-1]


def keys_match(a, b):
    return distance(a, b) <= 3 or bool(a and b and a.split()[-1] == b.split()[-1])


def test_matching_names_finds_every_pair(spark):
    rng = random.Random(11)
    base = ["anna schmidt", "bernd maier", "kraft", "li", "o", "", "clara kraft", "konstantin von berg", "xu wen", "abc", "abcdefg hij"]

    def noisy(name):
        chars = list(name)
        for _ in range(rng.randrange(5)):
            op, at = rng.randrange(3), rng.randrange(len(chars) + 1)
            if op == 0:
                chars.insert(at, rng.choice("abcde "))
            elif chars and at < len(chars):
                if op == 1:
                    del chars[at]
                else:
                    chars[at] = rng.choice("abcde")
        return " ".join("".join(chars).split())

    left = [(b, noisy(rng.choice(base))) for b in (1, 2) for _ in range(60)]
    right = [(b, noisy(rng.choice(base))) for b in (1, 2) for _ in range(60)]
    l, r = spark.createDataFrame(left, "block int, key string"), spark.createDataFrame(right, "block int, key string")
    got = {tuple(x) for x in ma.matching_names(l, r, "block").collect()}
    want = {(b, x, y) for b, x in left for b2, y in right if b == b2 and keys_match(x, y)}
    assert got == want


@pytest.mark.parametrize("a,b,want", [
    ("Dr. Anna Schmidt", "Anna Schmidt", True), ("Anna Schmidt", "Anna Schmitt", True), ("A. Schmidt", "Anna Schmidt", True),
    ("Anna Schmidt", "Bernd Maier", False), (None, "Bernd Maier", False),
])
def test_names_match_column(spark, a, b, want):
    df = spark.createDataFrame([(a, b)], "a string, b string")
    assert df.select(ma.names_match(F.col("a"), F.col("b")).alias("x")).collect()[0].x is want


def stepwise_match(truth, pred):
    """The stepwise definition on plain lists: (truth_idx, pred_idx, kind)."""
    out, used_t, used_p = [], set(), set()
    for t in truth:
        for p in pred:
            if p["idx"] in used_p:
                continue
            same = (t["party"] or "").upper() == (p["party"] or "").upper()
            if keys_match(t["speaker"].lower(), p["speaker"].lower()) and (same or (t["role"] and not t["party"])):
                out.append((t["idx"], p["idx"], "exact"))
                used_t.add(t["idx"])
                used_p.add(p["idx"])
                break
    for t in truth:
        if t["idx"] in used_t:
            continue
        best, best_sim = None, 0.0
        for p in pred:
            if p["idx"] in used_p or not t["text_preview"] or not p["text"]:
                continue
            sim = shared(t["text_preview"], p["text"], 2)
            if sim > 0.5 and sim > best_sim:
                best, best_sim = p, sim
        if best:
            out.append((t["idx"], best["idx"], "partial"))
            used_t.add(t["idx"])
            used_p.add(best["idx"])
    out += [(t["idx"], None, "truth_only") for t in truth if t["idx"] not in used_t]
    out += [(None, p["idx"], "pred_only") for p in pred if p["idx"] not in used_p]
    return sorted(out, key=repr)


def test_match_all_against_the_stepwise_definition(spark):
    rng = random.Random(2)
    people = [("Anna Schmidt", "SPD"), ("Anna Schmitt", "SPD"), ("Bernd Maier", "AfD"), ("Clara Kraft", "SPD"), ("Kraft", "SPD"), ("Zora Xylander", "FDP")]
    texts = ["Wir reden heute über Schulen und Lehrer im Land", "Der Haushalt ist zu groß und muss kleiner werden", "Straßen und Brücken brauchen mehr Geld", "Wir reden heute über Schulen und Lehrer", ""]
    truth, pred = [], []
    for block in (1, 2, 3):
        for i in range(25):
            name, party = rng.choice(people)
            official = rng.random() < 0.2
            truth.append({"protocol_id": block, "idx": i, "speaker": name if rng.random() < 0.8 else "Quirin Ypsilon", "party": None if official else party, "role": "Ministerin" if official else None,
                          "text_preview": rng.choice(texts)[: rng.randrange(20, 60)]})
            name, party = rng.choice(people)
            pred.append({"protocol_id": block, "idx": i, "speaker": name, "party": party, "text": rng.choice(texts)})
    t = spark.createDataFrame(truth, "protocol_id int, idx int, speaker string, party string, role string, text_preview string")
    p = spark.createDataFrame(pred, "protocol_id int, idx int, speaker string, party string, text string")
    got = ma.match_all(t, p)
    rows = {}
    for r in got.collect():
        rows.setdefault(r.protocol_id, []).append((r.truth_idx, r.pred_idx, r.match_type))
    for block in (1, 2, 3):
        want = stepwise_match([x for x in truth if x["protocol_id"] == block], [x for x in pred if x["protocol_id"] == block])
        assert sorted(rows[block], key=repr) == want
    issues = ma.match_issues(got, t, p)
    assert issues.count() == got.filter("match_type <> 'exact'").count() and issues.filter("issue is null").isEmpty()


def test_detection_metrics_defaults(spark):
    m = spark.createDataFrame([(1, "pred_only", None), (2, "exact", None), (2, "partial", False), (2, "truth_only", None)], "protocol_id int, match_type string, same_speaker boolean")
    got = {r.protocol_id: r for r in ma.detection_metrics(m).collect()}
    assert (got[1].precision, got[1].recall, got[1].f1) == (0.0, 0.0, 0.0)
    assert got[2].precision == 1.0 and got[2].recall == pytest.approx(2 / 3) and got[2].speaker_mismatches == 1
    assert got[None].overall and got[None].precision == pytest.approx(2 / 3)


def test_near_duplicates_against_all_pairs(spark):
    rng = random.Random(9)
    bases = [[rng.choice("abcdefghij") for _ in range(rng.randrange(3, 300))] for _ in range(4)]
    data = []
    for i in range(60):
        text = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 3, 30])):
            text[rng.randrange(len(text))] = rng.choice("xyz")
        data.append((rng.choice([1, 2]), i, rng.choice(["Anna Schmidt", "Anna Schmitt", "Bernd Maier", "B. Maier"]), " ".join(text)))
    df = spark.createDataFrame(data, "protocol_id int, speech_id int, speaker string, text string")
    got = ma.near_duplicates(df).collect()
    want, count = set(), 0
    for x in data:
        for y in data:
            if x[0] == y[0] and x[1] < y[1] and keys_match(x[2].lower(), y[2].lower()) and shared(x[3], y[3], 5) >= 0.8:
                count += 1
                want.add((x[0], x[1], y[1]))
    assert sum(r.pairs for r in got) == count > 20
    assert {(r.protocol_id, r.left_id, r.right_id) for r in got if r.left_id != r.right_id} <= want


def test_whole_texts_are_compared(spark):
    """Texts that agree in the head only are no match; texts that differ in the head only are one."""
    rng = random.Random(4)
    prose = lambda n: " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(rng.randrange(2, 9))) for _ in range(n))
    head, tail = prose(120), prose(900)
    texts = [head + " " + prose(400), head + " " + prose(400), prose(90) + " " + tail, prose(90) + " " + tail]
    rows = [(1, i, "Anna Schmidt", t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "protocol_id int, speech_id int, speaker string, text string")
    assert len(head) > 500
    assert [(r.left_id, r.right_id, r.n_left) for r in ma.near_duplicates(df).collect()] == [(2, 3, 1)]
    assert [(r.left_id, r.right_id, r.n_left) for r in ma.near_duplicates(df, chars=500).collect()] == [(0, 0, 2)]
    cols = "protocol_id int, idx int, speaker string, party string, role string, {} string"
    truth = spark.createDataFrame([(1, i, "Zora Xylander", "FDP", None, texts[i]) for i in (0, 2)], cols.format("text_preview"))
    pred = spark.createDataFrame([(1, i, "Bernd Maier", "SPD", None, texts[i]) for i in (1, 3)], cols.format("text"))
    got = {(r.truth_idx, r.pred_idx, r.match_type) for r in ma.match_all(truth, pred).collect()}
    assert (2, 3, "partial") in got and (0, 1, "partial") not in got


def test_a_large_group_of_copies_is_one_row(spark):
    df = spark.range(2000).select(F.lit(1).alias("protocol_id"), F.col("id").alias("speech_id"), F.lit("Anna Schmidt").alias("speaker"), F.lit("Derselbe Text.").alias("text"))
    got = ma.near_duplicates(df).collect()
    assert [(r.left_id, r.right_id, r.n_left, r.pairs) for r in got] == [(0, 0, 2000, 2000 * 1999 // 2)]


def test_no_cross_joins(spark):
    df = spark.createDataFrame([(1, 1, "Anna", "x")], "protocol_id int, speech_id int, speaker string, text string")
    keys = df.select("protocol_id", F.lower("speaker").alias("key"))
    sets = df.select("protocol_id", F.col("speech_id").alias("id"), F.array(F.lit(1).cast("long")).alias("shingles"))
    for plan in (ma.near_duplicates(df), ma.matching_names(keys, keys, "protocol_id"), si.similar_sets(sets, sets, "protocol_id", 0.5)):
        text = plan._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in text and "NestedLoop" not in text


def test_edits_at_any_place_of_long_texts(spark):
    """One word more at the head, in the middle or at the end of a long text, or a shifted half, and what that shares."""
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(5000)]
    put = lambda at: words[:at] + ["new"] + words[at:]
    texts = [words, put(0), put(2500), put(5000), words[2500:] + words[:2500], words[:3900], words[:4100] + ["x"] * 50]
    df = spark.createDataFrame([(1, i, "Anna Schmidt", " ".join(t)) for i, t in enumerate(texts)], "protocol_id int, speech_id int, speaker string, text string")
    got = {(r.left_id, r.right_id): r.similarity for r in ma.near_duplicates(df).collect()}
    sims = {(i, j): shared(" ".join(texts[i]), " ".join(texts[j]), 5) for i in range(7) for j in range(i + 1, 7)}
    assert got == {k: v for k, v in sims.items() if v >= 0.8} and {(0, 1), (0, 2), (0, 3), (1, 2), (0, 4), (0, 6)} <= set(got)


@pytest.mark.parametrize("threshold, strict", [(0.5, True), (0.5, False), (0.8, False), (1.0, False), (0.34, True)])
def test_similar_sets_are_all_pairs(spark, threshold, strict, monkeypatch):
    """Every pair of sets, between two tables and within one, with hot items and lists cut into small cells."""
    monkeypatch.setattr(common, "CELL_ROWS", 4)
    rng = random.Random(int(threshold * 100))
    make = lambda n: [(rng.choice(["a", "a", "b", None]), i, rng.sample(range(12), rng.randrange(0, 9)) + ([99] if rng.random() < 0.9 else [])) for i in range(n)]
    left, right = make(60), make(50)
    schema = "block string, id long, shingles array<long>"
    l, r = spark.createDataFrame(left, schema), spark.createDataFrame(right, schema)
    alike = lambda x, y: (s := len(set(x) & set(y)) / max(1, len(set(x) | set(y)))) and (s > threshold if strict else s >= threshold)
    two = {(x.block, x.left_id, x.right_id) for x in si.similar_sets(l, r, "block", threshold, strict).collect()}
    assert two == {(b, i, j) for b, i, x in left for c, j, y in right if b is not None and b == c and alike(x, y)}
    one = si.similar_sets(l, None, "block", threshold, strict).collect()
    want = {(b, i, j): len(set(x) & set(y)) for b, i, x in left for c, j, y in left if b is not None and b == c and i < j and alike(x, y)}
    assert {(x.block, x.left_id, x.right_id): x.overlap for x in one} == want and len(one) == len(want)
    assert si.similar_sets(l.filter("id < 0"), None, "block", threshold).count() == 0


def test_only_first_items_are_posted(spark):
    """Of large sets with a few links only the first items of each leave their row, and only named sets are moved."""
    rng = random.Random(8)
    data = [("a", i, rng.sample(range(1 << 40), 200)) for i in range(300)]
    data += [("a", 300 + i, data[i][2][:190] + rng.sample(range(1 << 40), 10)) for i in range(5)]
    sets = spark.createDataFrame(data, "block string, id long, shingles array<long>")
    both = sets.select("block", F.lit(0).alias("side"), "id", F.size("shingles").alias("n"), "shingles", F.col("id").alias("row"), F.xxhash64("block").alias("home"))
    posted = si.postings(both, 0.8, 22)
    assert posted.groupBy("row").count().agg(F.max("count")).first()[0] <= 41 and posted.count() < 1000
    assert si.postings(both, 0.8, 8).count() == 305 * 41
    assert {(x.left_id, x.right_id, x.overlap) for x in si.similar_sets(sets, None, "block", 0.8).collect()} == {(i, 300 + i, 190) for i in range(5)}
    named = spark.createDataFrame([(0, 300)], "left_row long, right_row long")
    assert sorted(r.row for r in si._sieved(both, si._named(named)).collect()) == [0, 300]


def test_similar_texts_compare_copies_once(spark, monkeypatch):
    """Pairs of all texts, while only one text of a class of copies is compared."""
    rng = random.Random(12)
    bases = [[rng.choice("abcdefghij") for _ in range(rng.randrange(2, 200))] for _ in range(4)]
    data = [(rng.choice(["a", "b", None]), i, " ".join(rng.choice(bases))) for i in range(60)]
    data += [(b, i + 60, None if t is None or i % 20 == 0 else t + " x") for b, i, t in data] + [("a", 200, ""), ("a", 201, "")]
    rng.shuffle(data)
    compared, linked = [], si._linked
    monkeypatch.setattr(si, "_linked", lambda both, *rest: compared.append(both.count()) or linked(both, *rest))
    got = si.similar_texts(spark.createDataFrame(data, "block string, id long, text string"), "block", 0.8, 5).collect()
    alike = lambda x, y: bool(x and y) and shared(x, y, 5) >= 0.8
    want = {(b, i, j): shared(x, y, 5) for b, i, x in data for c, j, y in data if b is not None and b == c and i < j and alike(x, y)}
    assert {(r.block, r.left_id, r.right_id): r.similarity for r in got} == want and len(got) == len(want) > 100
    assert all(r.overlap / (r.n_left + r.n_right - r.overlap) == r.similarity for r in got)
    assert compared == [len({(b, t) for b, _, t in data if b is not None and t})]


def test_shingles_of_odd_texts(spark):
    rows = [(None,), ("",), (" \t",), ("One",), ("one TWO",), ("a b c d e f a b c d e",)]
    df = spark.createDataFrame(rows, "text string").withColumn("words", F.lit(1))
    sizes = [len(r.shingles) for r in si.with_shingles(df, F.col("text"), 5).collect()]
    assert sizes == [0, 0, 0, 1, 1, 6]
    pair = df.limit(1).select(F.array(F.lit(1), F.lit(2)).alias("a"), F.array(F.lit(2), F.lit(3)).alias("b"), F.array().cast("array<int>").alias("e"))
    assert tuple(pair.select(ma.text_similarity(F.col("a"), F.col("b")), ma.text_similarity(F.col("e"), F.col("e"))).collect()[0]) == (1 / 3, 0.0)


@pytest.mark.parametrize("seed", range(4))
def test_assignment_serves_in_order(spark, seed):
    """The rounds give what serving one row after another gives, also where classes share some of their options."""
    rng = random.Random(seed)
    left = [(b, i, f"l{rng.randrange(6)}") for b in (1, 2) for i in rng.sample(range(100), 30)]
    right = [(b, i, f"r{rng.randrange(6)}") for b in (1, 2) for i in rng.sample(range(100), 25)]
    options = [(b, f"l{x}", f"r{y}", rng.choice([0.0, -0.5, -0.7])) for b in (1, 2) for x in range(6) for y in range(6) if rng.random() < (0.15 * (seed + 1))]
    want = []
    for b in (1, 2):
        pref = {(x, y): p for c, x, y, p in options if c == b}
        taken = set()
        for i, x in sorted((i, x) for c, i, x in left if c == b):
            best = min(((pref[x, y], j) for c, j, y in right if c == b and (x, y) in pref and j not in taken), default=None)
            if best:
                taken.add(best[1])
                want.append((b, i, best[1]))
    frames = (spark.createDataFrame(left, "block int, l_idx long, l_class string"), spark.createDataFrame(right, "block int, r_idx long, r_class string"), spark.createDataFrame(options, "block int, l_class string, r_class string, pref double"))
    assert sorted(tuple(r) for r in ma.assign_in_order(*frames, "block").collect()) == sorted(want)


def test_assignment_of_copies_is_one_round(spark, monkeypatch):
    """A thousand equal rows are paired by rank, not one a round."""
    rounds = []
    ranked = ma.distributed_rank
    monkeypatch.setattr(ma, "distributed_rank", lambda *a: rounds.append(1) or ranked(*a))
    left = spark.range(1000).select(F.lit(1).alias("block"), F.col("id").alias("l_idx"), F.concat(F.lit("l"), F.col("id") % 3).alias("l_class"))
    right = spark.range(900).select(F.lit(1).alias("block"), F.col("id").alias("r_idx"), F.concat(F.lit("r"), F.col("id") % 2).alias("r_class"))
    options = spark.createDataFrame([(1, f"l{x}", f"r{y}", -1.0) for x in range(3) for y in range(2)], "block int, l_class string, r_class string, pref double")
    got = ma.assign_in_order(left, right, options, "block").collect()
    assert sorted(tuple(r) for r in got) == [(1, i, i) for i in range(900)] and len(rounds) == 2
    assert ma.assign_in_order(left, right, options.filter("pref > 0"), "block").count() == 0


def test_tangled_classes_take_one_round(spark, monkeypatch):
    """Two lists that share a part hold each other up row after row; what the first round leaves is served at once, or in rounds if it is large."""
    rounds = []
    ranked = ma.distributed_rank
    monkeypatch.setattr(ma, "distributed_rank", lambda *a: rounds.append(1) or ranked(*a))
    left = spark.range(12).select(F.lit(1).alias("block"), F.col("id").alias("l_idx"), F.concat(F.lit("l"), F.col("id") % 2).alias("l_class"))
    right = spark.range(12).select(F.lit(1).alias("block"), F.col("id").alias("r_idx"), F.concat(F.lit("r"), F.col("id") % 3).alias("r_class"))
    options = spark.createDataFrame([(1, "l0", "r0", 0.0), (1, "l0", "r1", 0.0), (1, "l1", "r1", 0.0), (1, "l1", "r2", 0.0)], "block int, l_class string, r_class string, pref double")
    got = sorted(tuple(r) for r in ma.assign_in_order(left, right, options, "block").collect())
    assert len(got) == 12 and len(rounds) == 2
    monkeypatch.setattr(ma, "SERVED_ROWS", 10)
    monkeypatch.setattr(ma, "ROUNDS", 4)
    assert sorted(tuple(r) for r in ma.assign_in_order(left, right, options, "block").collect()) == got and len(rounds) > 6


def test_names_of_large_and_small_blocks(spark, monkeypatch):
    """Blocks compared pair by pair and blocks that go through the candidate joins give the same pairs, and only the latter are cut into segments."""
    names = ["anna schmidt", "enne schmidt", "anne schmitt", "bernd maier", "b. maier", "li", "", "lo", "clara kraft", "kraft"]
    keys = spark.createDataFrame([(b, n) for b, size in ((1, 3), (2, 10), (None, 4)) for n in names[:size]], "block int, key string")
    want = {(b, x, y) for b, size in ((1, 3), (2, 10)) for x in names[:size] for y in names[:size] if keys_match(x, y)}
    cut = []
    segments = ma._segments
    monkeypatch.setattr(ma, "_segments", lambda *a: cut.append(1) or segments(*a))
    for most in (64, 5, 0):
        monkeypatch.setattr(ma, "PAIRED_NAMES", most)
        got = [tuple(r) for r in ma.matching_names(keys, keys, "block").collect()]
        assert set(got) == want and len(got) == len(want) and bool(cut) == (most < 64)


def test_sample_is_repeatable(spark):
    df = spark.range(50).withColumnRenamed("id", "protocol_id")
    a = [r.protocol_id for r in ma.sample_protocols(df, 5, seed=1).collect()]
    assert a == [r.protocol_id for r in ma.sample_protocols(df.repartition(3), 5, seed=1).collect()] and len(a) == 5
    assert [r.protocol_id for r in ma.sample_protocols(df, 5, only=[7]).collect()] == [7]
