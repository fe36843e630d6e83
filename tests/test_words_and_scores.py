import math
import random

import pytest
from pyspark.sql import functions as F

from rostrum.functions.words import POS_STOPWORDS
from rostrum.operators import activity as ac
from rostrum.operators import attributes as at
from rostrum.operators import distinct as di
from rostrum.operators import interjections as ij
from rostrum.operators import lexicon as lx
from rostrum.operators import rankings as rk
from rostrum.operators import tokens as tk
from rostrum.operators.common import lookup_frame
from rostrum.plans import views as v


def counts_of(spark, data, cols="party string, word string, n long"):
    return spark.createDataFrame(data, cols)


# ---------------------------------------------------------------- tokens


def test_entities_count_once_as_their_text(spark):
    tokens = spark.createDataFrame([
        (1, 0, "Anna", "Anna", "PROPN", False, False, 1, "PER", "Anna Schmidt"), (1, 1, "Schmidt", "Schmidt", "PROPN", False, False, 1, "PER", "Anna Schmidt"),
        (1, 2, "baut", "bauen", "VERB", False, False, None, None, None), (1, 3, "neue", "neu", "ADJ", False, False, None, None, None),
        (1, 4, "Häuser", "Haus", "NOUN", False, False, None, None, None), (1, 5, ".", ".", "PUNCT", False, True, None, None, None), (1, 6, " ", " ", "SPACE", True, False, None, None, None),
    ], tk.TOKEN_SCHEMA)
    merged = tk.merge_entities(tokens)
    got = {(r.word_type, r.word): r.n for r in tk.pos_counts(merged, ["doc_id"], {"noun": ["haus"]}).collect()}
    assert got == {("noun", "anna schmidt"): 1, ("verb", "bauen"): 1, ("adjective", "neu"): 1}
    lists = tk.extract_words(tokens).collect()[0]
    assert lists.nouns == ["anna", "schmidt", "haus"] and lists.verbs == ["bauen"] and lists.adjectives == ["neu"]
    assert tk.word_totals(tokens, ["doc_id"]).collect()[0].total_words == 6
    assert {r.word for r in tk.lemma_counts(tokens, ["doc_id"]).collect()} == {"anna", "schmidt", "bauen", "neu", "haus"}


def test_annotator_runs_in_batches(spark):
    def annotator():
        return lambda texts: [[{"token": w, "lemma": w.lower(), "upos": "NOUN"} for w in t.split()] for t in texts]

    df = spark.createDataFrame([(i, f"Wort{chr(97 + i % 3)} Haus") for i in range(25)] + [(99, "")], "doc_id long, text string")
    got = tk.annotate(df, annotator, batch_size=4)
    assert got.count() == 50 and got.filter("lemma = 'haus'").count() == 25


def test_rollup_levels_add_up(spark):
    sp = spark.createDataFrame([("A", "x", "haus haus baum", "rede"), ("A", "y", "haus", "rede"), ("B", "z", "baum garten", "rede"), ("B", "z", "haus", "ortskraefte")], "party string, speaker string, text string, type string")
    lex = lx.build_lexicon(spark, [("verb", "solution", "haus", 1.0), ("topic", "klima", "haus", 1.0)])
    rows = tk.word_rollup(sp, lex).collect()
    got = {(r.level, r.party, r.speaker, r.word_type, r.word): r.n for r in rows}
    assert got[("speaker", "A", "x", "all", "haus")] == 2 and got[("party", "A", None, "all", "haus")] == 3
    assert got[("corpus", None, None, "all", "haus")] == 3 and got[("corpus", None, None, "verb", "haus")] == 3
    assert ("speaker", "B", "z", "all", "haus") not in got
    for level in ("speaker", "party", "corpus"):
        assert sum(r.n for r in rows if r.level == level and r.word_type == "all") == 6


def test_hot_words_and_vocabulary(spark):
    c = counts_of(spark, [(p, w, n) for p in "ABC" for w, n in (("alle", 5), (f"nur{p.lower()}", 9))])
    assert [(r.word, r.groups, r.total) for r in tk.hot_words(c, min_groups=3).collect()] == [("alle", 3, 15)]
    assert {r.vocabulary for r in tk.vocabulary_size(c, ["party"]).collect()} == {2}
    assert {r.vocabulary for r in tk.vocabulary_size(c, ["party"], approximate=True).collect()} == {2}


# ---------------------------------------------------------------- distinctiveness


def naive_key_topics(data, groups, n, share, min_ratio):
    total = {g: sum(c for p, _, c in data if p == g) for g in groups}
    count = {(p, w): c for p, w, c in data}
    out = {}
    for g in groups:
        cand = []
        for p, w, c in data:
            if p != g:
                continue
            f = c / total[g] * 1000
            others = sum(count.get((o, w), 0) / total[o] * 1000 for o in groups if o != g) / (len(groups) - 1)
            if c >= total[g] * share and f / (others + 0.001) > min_ratio:
                cand.append((w, c))
        cand = sorted(cand, key=lambda x: (-x[1], x[0]))[: 2 * n]
        kept = []
        for w, c in cand:
            if any(w in k and w != k for k, _ in kept):
                continue
            kept = [(k, x) for k, x in kept if not (k in w and k != w)] + [(w, c)]
            if len(kept) >= n:
                break
        out[g] = kept[:n]
    return out


def test_key_topics_against_the_stepwise_definition(spark):
    rng = random.Random(4)
    words = ["bahn", "autobahn", "bahnhof", "haus", "hausbau", "bau", "rat", "rathaus", "ab", "abc", "abcd", "xyz"]
    data = [(g, w, rng.randrange(1, 60)) for g in "ABC" for w in words if rng.random() < 0.8]
    c = counts_of(spark, data)
    got = {}
    for r in di.key_topics(c, tk.token_totals(c, ["party"]), n=3).orderBy("party", "rank").collect():
        got.setdefault(r.party, []).append((r.word, r.n))
    want = {g: w for g, w in naive_key_topics(data, list("ABC"), 3, 0.0005, 1.5).items() if w}
    assert got == want


def test_distinctive_needs_two_groups_and_skips_stopwords(spark):
    one = counts_of(spark, [("A", "haus", 5)])
    assert di.distinctive_words(one, tk.token_totals(one, ["party"])).isEmpty()
    two = counts_of(spark, [("A", "afghanistan", 5), ("A", "haus", 5), ("B", "baum", 5)])
    got = di.distinctive_words(two, tk.token_totals(two, ["party"])).collect()
    assert {(r.party, r.word) for r in got} == {("A", "haus"), ("B", "baum")}
    a = next(r for r in got if r.party == "A")
    assert a.ratio == pytest.approx(500 / 0.001) and a.score == pytest.approx(a.ratio * math.sqrt(500))


def test_signature_words_leave_the_speaker_out(spark):
    c = counts_of(spark, [("A", "x", "steuer", 10), ("A", "x", "haushalt", 10), ("A", "y", "haushalt", 80), ("A", "y", "steuer", 20), ("B", "z", "garten", 40)], "party string, speaker string, word string, n long")
    got = {(r.speaker, r.word): (r.ratio_party, r.ratio_corpus) for r in di.signature_words(c).collect()}
    # x: 500 per 1000 against 200 in the rest of the party and 20/140 in the rest of the corpus
    assert got == {("x", "steuer"): (2.5, 3.5)}
    alone = counts_of(spark, [("A", "x", "steuer", 10)], "party string, speaker string, word string, n long")
    assert di.signature_words(alone).isEmpty()


# ---------------------------------------------------------------- lexicon


def test_lexicon_conflicts(spark):
    entries = [("verb", "solution", "Bauen", 1.0), ("verb", "problem", "bauen", 1.0)]
    assert [lx.build_lexicon(spark, entries, mode).collect()[0].category for mode in ("last", "first")] == ["problem", "solution"]
    assert lx.build_lexicon(spark, entries, "all").count() == 2


def test_built_in_words(spark):
    style = lx.style_lexicon(spark)
    assert {(r.scheme, r.category): r.n for r in style.groupBy("scheme", "category").agg(F.count("*").alias("n")).collect()} == {
        ("modal", "obligation"): 8, ("modal", "possibility"): 4, ("modal", "intention"): 7, ("temporal", "retrospective"): 12,
        ("temporal", "prospective"): 13, ("intensity", "intensifier"): 35, ("intensity", "moderator"): 25, ("pronoun", "inclusive"): 19,
        ("pronoun", "exclusive"): 12,
    }
    assert {k: len(w) for k, w in POS_STOPWORDS.items()} == {"noun": 64, "adjective": 24, "verb": 28}


def test_typed_counts_only_meet_their_scheme(spark):
    lex = lx.build_lexicon(spark, [("adjective", "critical", "schlecht", 1.0), ("modal", "obligation", "schlecht", 1.0)])
    c = counts_of(spark, [("A", "noun", "schlecht", 3), ("A", "adjective", "Schlecht", 2), ("A", "all", "schlecht", 5)], "party string, word_type string, word string, n long")
    assert {(r.scheme, r.n) for r in lx.categorize(c, lex).collect()} == {("adjective", 2), ("modal", 5)}


def test_tone_defaults_without_evidence(spark):
    c = counts_of(spark, [("A", "haus", 10)])
    r = lx.tone_from_counts(c, v.lexicon(spark), ["party"]).collect()[0]
    for name, *_ in lx.RATIO_SCORES:
        assert r[name] == 50.0
    for name, *_ in lx.INDEX_SCORES:
        assert r[name] == 0.0
    assert r.discriminatory == 0.0
    totals = spark.createDataFrame([("A", 0)], "party string, total_words long")
    assert {x.score for x in lx.topic_scores(lx.categorize(c, v.lexicon(spark)), totals, ["party"]).collect()} == {0.0}


def test_tone_both_paths_agree(spark):
    rng = random.Random(8)
    words = sorted({w for _, _, w, _ in v.LEXICON} | {"anderes"})
    c = counts_of(spark, [(p, w, rng.randrange(1, 40)) for p in "ABC" for w in words if rng.random() < 0.6])
    lex = v.lexicon(spark)
    a = lx.tone_from_counts(c, lex, ["party"])
    b = lx.tone_scores(lx.categorize(c, lex), tk.token_totals(c, ["party"]), ["party"])
    assert a.exceptAll(b.select(*a.columns)).isEmpty() and a.count() == 3
    t = lx.topics_from_counts(c, lex, ["party"], v.TOPIC_LIST)
    u = lx.topic_scores(lx.categorize(c, lex), tk.token_totals(c, ["party"]), ["party"], v.TOPIC_LIST)
    assert t.exceptAll(u.select(*t.columns)).isEmpty()
    assert lx.has_scores(a) and not lx.has_scores(a.limit(0))
    assert lx.tone_ranking(a, metrics=["hope"]).select("metric").distinct().collect()[0].metric == "solution_focus"


def test_lexicon_join_is_not_forced(spark):
    c = counts_of(spark, [("A", "haus", 10)])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = lx.tone_from_counts(c, v.lexicon(spark), ["party"])._jdf.queryExecution().executedPlan().toString()
        assert "Broadcast" not in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


# ---------------------------------------------------------------- interjections


def test_interjections_strict_and_loose(spark):
    raw = "Text (Beifall bei der SPD) (Jens Krug [GRÜNE]: Genau!) und (Anna Groß [SPD]: Selbst) (Abg. Otto  Ei [Neue X]: So?)"
    sp = spark.createDataFrame([("Dr. Anna Groß", "SPD", raw)], "speaker string, party string, raw_text string")
    got = ij.extract_interjections(sp).orderBy("from_name").collect()
    assert [(r.from_name, r.from_party, r.to_name, r.content, r.sentiment) for r in got] == [
        ("Jens Krug", "GRÜNE", "Dr. Anna Groß", " Genau!", "positive"), ("Otto Ei", "Neue X", "Dr. Anna Groß", " So?", "neutral"),
    ]
    # with the loose name class the reaction swallows the interjection and the noise filter drops it
    assert [r.from_name for r in ij.extract_interjections(sp, strict=False).collect()] == ["Otto Ei"]
    assert ij.extract_interjections(sp, keep_self=True).count() == 3
    assert [(r.applauding_party, r.n) for r in ij.applause_counts(sp).collect()] == [("SPD", 1)]
    compact = ij.compact_speeches(sp.withColumn("text", F.lit("")))
    assert ij.extract_interjections(compact).exceptAll(ij.extract_interjections(sp)).isEmpty()


# ---------------------------------------------------------------- profiles, rankings


def _profile(name, first, last, party, n, **extra):
    base = dict(speaker=name, party=party, first_name=first, last_name=last, acad_title=None, gender="unknown", total_words=10 * n, avg_words=10.0)
    base.update({c: n for c in ac.PROFILE_COUNTS if c != "total_words"})
    return {**base, **extra}


def test_partial_profiles_merge_into_the_most_active(spark):
    schema = "speaker string, party string, first_name string, last_name string, acad_title string, gender string, total_words long, avg_words double, " + ", ".join(f"{c} long" for c in ac.PROFILE_COUNTS if c != "total_words")
    data = [_profile("Clara Kraft", "Clara", "Kraft", "GRÜNE", 5), _profile("Otto Kraft", "Otto", "Kraft", "GRÜNE", 9), _profile("Kraft", "", "Kraft", "GRÜNE", 2), _profile("Kraft x", " ", "kraft", "GRÜNE", 1), _profile("Kraft S", "", "Kraft", "SPD", 4)]
    merged = {r.speaker: r for r in ac.merge_partial_profiles(spark.createDataFrame(data, schema)).collect()}
    assert set(merged) == {"Clara Kraft", "Otto Kraft", "Kraft S"}
    assert merged["Otto Kraft"].total_speeches == 12 and merged["Otto Kraft"].befragung_responses == 12 and merged["Otto Kraft"].total_words == 120
    stats = {r.party: r for r in ac.gender_stats(spark.createDataFrame(data, schema), ["SPD"]).collect()}
    assert stats["SPD"].unknown_speakers == 1 and stats[None].total_speakers == 1 and "GRÜNE" not in stats


def test_detector_stats_and_profiles(spark):
    names = at.default_names(spark)
    assert {(r.source, r.gender) for r in at.detector_stats(names).collect()} == {("dictionary", "female"), ("dictionary", "male")}
    assert at.has_profiles(names)


def test_badges_conditions(spark):
    cols = "speaker string, speeches long, total_words long, max_words long, speech_rank int, total_speakers int, verbosity_rank int, verbosity_total int, longest_speech_rank int, party_speech_rank int, party_size int, speech_percentile double, interruptions_given long, interrupter_rank int"
    data = [("a", 9, 5000, 900, 1, 300, 5, 200, 3, 1, 40, 99.7, 30, 2), ("b", 2, 900, 100, 25, 300, None, None, 50, 9, 9, 91.7, 12, 40), ("c", 1, 10, 10, 200, 300, None, None, 90, 20, 40, 33.3, None, None)]
    got = {r.speaker: [(b.kind, b.rank, b.value) for b in r.badges] for r in rk.badges(spark.createDataFrame(data, cols)).collect()}
    assert [b[0] for b in got["a"]] == ["speeches", "words", "speech_rank", "verbosity_rank", "longest_speech", "interrupter_rank"]
    assert got["b"] == [("speeches", None, 2), ("interruptions", None, 12), ("top_percent", None, 9)]
    assert got["c"] == [("speeches", None, 1)]


def test_fit_scores_follow_the_criteria(spark):
    features = spark.createDataFrame([("a", "SPD", 4.0, 300.0), ("b", "SPD", 1.0, 900.0)], "speaker string, party string, speeches double, avg_words double")
    criteria = lookup_frame(spark, [("x", "speeches", 0.5, 8.0, 2.0, False), ("x", "avg_words", 0.5, 400.0, None, True), ("y", "avg_words", 1.0, 600.0, None, False)], rk.CRITERIA_SCHEMA)
    got = {(r.speaker, r.archetype): r.score for r in rk.fit_scores(features, criteria).collect()}
    assert got == {("a", "x"): pytest.approx(0.25 + 0.125), ("a", "y"): pytest.approx(0.5), ("b", "y"): 1.0}


def test_archetypes_end_to_end(spark):
    sp = spark.createDataFrame([(1, i, f"S{i % 30}", "AfD" if i % 30 == 0 else "SPD", "rede" if i % 2 else "fragestunde", "rede" if i % 2 else "wortbeitrag", 50 + i % 30 * 10, None) for i in range(300)],
                               "protocol_id long, speech_id long, speaker string, party string, type string, category string, words long, acad_title string")
    ev = spark.createDataFrame([("S1", "SPD", "S2", "SPD", "negative")] * 3, "from_name string, from_party string, to_name string, to_party string, sentiment string")
    index = ac.speaker_index(sp)
    ranks = rk.speaker_ranks(index)
    drama = rk.speaker_drama(index, ev)
    signature = spark.createDataFrame([("S1", "SPD", "haus", 9.0, 1)], "speaker string, party string, word string, ratio_corpus double, rank int")
    tone = index.select("speaker", "party", *[F.lit(50.0).alias(m) for m in ("aggression", "collaboration", "affirmative", "solution_focus", "demand_intensity", "authority")])
    features = rk.archetype_features(index, ranks, drama, signature, tone)
    fits = rk.fit_scores(features, lookup_frame(spark, rk.ARCHETYPE_CRITERIA, rk.CRITERIA_SCHEMA))
    got = {r.speaker: r for r in rk.assign_archetype(features, fits, exclude_groups=["AfD"]).collect()}
    assert len(got) == 30 and got["S0"].archetype is None
    assert got["S29"].archetype == "tiger" and len(got["S29"].alternatives) == 2
    assert all(len(r.alternatives) <= 2 and r.archetype not in [a.archetype for a in r.alternatives] for r in got.values() if r.archetype)
    docs = rk.speaker_documents(index, ranks, rk.speaker_comparison(index, ac.group_averages(index)), ("drama", drama), ("words", rk.listed_per_speaker(signature, ["word"], "signature")))
    assert docs.count() == 30 and docs.filter("speaker = 'S1'").collect()[0].words.signature[0].word == "haus"


def test_percentile_and_ranks_are_dense(spark):
    sp = spark.createDataFrame([(1, i, f"S{i:02d}", "P", "rede", "rede", 10, None) for i in range(10)], "protocol_id long, speech_id long, speaker string, party string, type string, category string, words long, acad_title string")
    rows = rk.speaker_ranks(ac.speaker_index(sp)).orderBy("speech_rank").collect()
    assert [r.speech_rank for r in rows] == list(range(1, 11)) and rows[0].speech_percentile == 90.0 and rows[-1].speech_percentile == 0.0
    assert [r.speaker for r in rows] == sorted(r.speaker for r in rows) and rows[0].verbosity_rank is None


def test_traits_ignore_constant_inclusivity(spark):
    base = {m: 50.0 for m in lx.TONE_METRICS}
    rows = [dict(base, party=p, aggression=float(i)) for i, p in enumerate("ABC")]
    scores = spark.createDataFrame(rows)
    traits = {r.party: r.traits for r in rk.group_traits(scores).collect()}
    assert "inclusivity" not in traits["A"] and traits["C"][0] == "aggression"
    varied = spark.createDataFrame([dict(r, inclusivity=float(i)) for i, r in enumerate(rows)])
    assert any("inclusivity" in r.traits for r in rk.group_traits(varied, n=9).collect())
    assert {r.party: r.category for r in rk.classify_group(scores).collect()}["C"] == "aggression"


def test_marked_entities_are_merged_in_one_pass(spark):
    """The annotator runs once and its tokens are not shuffled, with the result of the grouped form."""

    def annotator():
        def run(texts):
            label = lambda w: {"ent_id": 7 if w == "Anna" else None, "ent_label": "PER" if w.istitle() else "LOC", "ent_text": w + " X"} if w.isalpha() else {}
            return [[{"token": w, "lemma": w, "upos": "NOUN", **label(w)} for w in t.split()] for t in texts]

        return run

    df = spark.createDataFrame([(i, "Anna 1 sah Anna und Bernd und Clara 2") for i in range(5)] + [(9, ""), (10, " ")], "doc_id long, text string")
    tokens = tk.annotate(df, annotator, batch_size=2)
    once, grouped = tk.merge_entities(tokens), tk.merge_entities(tokens.drop("ent_first"))
    plan = once._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Exchange" not in plan
    cols = grouped.columns
    assert once.columns == cols and sorted(map(tuple, once.collect()), key=repr) == sorted(map(tuple, grouped.select(*cols).collect()), key=repr)
    assert once.count() == 5 * 7 and [r.token for r in once.filter("doc_id = 3").orderBy("idx").collect()] == ["Anna X", "1", "sah", "und", "Bernd X", "und", "2"]
