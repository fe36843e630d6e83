"""Rankings, badges, group and speaker profiles, archetypes.

Ties are broken by name, so results are deterministic. Full rankings go through
``metric_ranks`` (one distributed sort for all metrics); short lists through ``top_k``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rostrum.operators.activity import ANSWER_TYPES, FORMAL, QUESTION_TYPE
from rostrum.operators.common import join_groups, metric_ranks, ratio, top_k

NO_RANK = 999

# Archetype, metric, weight, scale, minimum, inverse.
ARCHETYPE_CRITERIA: list[tuple[str, str, float, float, float | None, bool]] = [
    ("eule", "sig_ratio", 0.5, 500.0, None, False),
    ("eule", "sig_word_count", 0.3, 5.0, None, False),
    ("eule", "speeches", 0.2, 20.0, 5.0, False),
    ("wolf", "interruptions_given", 0.6, 25.0, None, False),
    ("wolf", "aggression", 0.25, 20.0, None, False),
    ("wolf", "speeches", 0.15, 10.0, 2.0, False),
    ("papagei", "sig_word_count", 0.4, 3.0, None, False),
    ("papagei", "speeches", 0.3, 8.0, None, False),
    ("papagei", "avg_words", 0.3, 400.0, None, True),
    ("baer", "interruptions_received", 0.7, 25.0, None, False),
    ("baer", "speeches", 0.2, 12.0, 4.0, False),
    ("baer", "authority", 0.1, 100.0, None, False),
    ("pfau", "avg_words", 0.5, 800.0, None, False),
    ("pfau", "speeches", 0.3, 12.0, 3.0, False),
    ("pfau", "affirmative", 0.2, 100.0, None, False),
    ("otter", "affirmative", 0.4, 100.0, None, False),
    ("otter", "collaboration", 0.3, 100.0, None, False),
    ("otter", "solution_focus", 0.3, 100.0, None, False),
    ("pferd", "speeches", 0.5, 15.0, None, False),
    ("pferd", "total_words", 0.3, 8000.0, None, False),
    ("pferd", "interruptions_given", 0.2, 20.0, None, False),
    ("kolibri", "speeches", 0.5, 12.0, 5.0, False),
    ("kolibri", "avg_words", 0.5, 300.0, None, True),
    ("delfin", "speeches", 0.25, 10.0, 2.0, False),
    ("delfin", "interruptions_given", 0.35, 5.0, None, True),
    ("delfin", "collaboration", 0.4, 100.0, None, False),
    ("biber", "collaboration", 0.4, 100.0, None, False),
    ("biber", "solution_focus", 0.3, 100.0, None, False),
    ("biber", "interruptions_given", 0.3, 15.0, None, True),
    ("schwan", "avg_words", 0.5, 900.0, None, False),
    ("schwan", "speeches", 0.3, 4.0, None, True),
    ("schwan", "solution_focus", 0.2, 100.0, None, False),
    ("fuchs", "sig_word_count", 0.5, 5.0, None, False),
    ("fuchs", "sig_ratio", 0.3, 200.0, None, False),
    ("fuchs", "speeches", 0.2, 15.0, 3.0, False),
    ("krabbe", "demand_intensity", 0.5, 25.0, None, False),
    ("krabbe", "speeches", 0.3, 10.0, 2.0, False),
    ("krabbe", "authority", 0.2, 100.0, None, False),
    ("igel", "interruptions_received", 0.5, 20.0, None, False),
    ("igel", "speeches", 0.3, 8.0, 2.0, False),
    ("igel", "affirmative", 0.2, 100.0, None, False),
    ("schildkroete", "avg_words", 0.4, 800.0, None, False),
    ("schildkroete", "speeches", 0.3, 5.0, None, True),
    ("schildkroete", "solution_focus", 0.3, 100.0, None, False),
    ("eichhoernchen", "sig_word_count", 0.5, 3.0, None, False),
    ("eichhoernchen", "speeches", 0.3, 8.0, None, False),
    ("eichhoernchen", "total_words", 0.2, 5000.0, None, False),
    ("hase", "affirmative", 0.4, 100.0, None, False),
    ("hase", "solution_focus", 0.4, 100.0, None, False),
    ("hase", "speeches", 0.2, 8.0, None, True),
    ("biene", "speeches", 0.5, 8.0, None, False),
    ("biene", "total_words", 0.5, 4000.0, None, False),
]
CRITERIA_SCHEMA = "archetype string, metric string, weight double, scale double, min double, inverse boolean"

# Tone metrics on which groups compete, and the one that joins the traits when it varies.
GROUP_METRICS = ["aggression", "demand_intensity", "collaboration", "solution_focus", "affirmative"]
VARYING_METRIC = "inclusivity"


# ---------------------------------------------------------------- short lists


def _speaker_counts(speeches: DataFrame, cond: Column) -> DataFrame:
    return speeches.filter(cond).groupBy("speaker", "party").agg(F.count(F.lit(1)).alias("n"))


def _top(counts: DataFrame, n: int) -> DataFrame:
    return top_k(counts, [], [F.desc("n"), F.asc("speaker"), F.asc("party")], n)


def top_speakers(speeches: DataFrame, n: int = 10) -> DataFrame:
    """Speakers with most formal speeches."""
    return _top(_speaker_counts(speeches, F.col("type") == FORMAL), n)


def question_time_speakers(speeches: DataFrame, n: int = 10) -> DataFrame:
    """Speakers with most questions in question time."""
    return _top(_speaker_counts(speeches, F.col("type") == QUESTION_TYPE), n)


def befragung_responders(speeches: DataFrame, n: int = 10) -> DataFrame:
    """Speakers with most answers in question sessions."""
    return _top(_speaker_counts(speeches, F.col("type").isin(*ANSWER_TYPES)), n)


def group_top_speakers(speeches: DataFrame, n: int = 3) -> DataFrame:
    """Most active formal speakers of every party."""
    return top_k(_speaker_counts(speeches, F.col("type") == FORMAL), ["party"], [F.desc("n"), F.asc("speaker")], n)


def group_champion(speeches: DataFrame) -> DataFrame:
    """The most active formal speaker of every party."""
    return group_top_speakers(speeches, 1).drop("rank")


def marathon(speeches: DataFrame, n: int = 5, tie: Sequence[str] = ("speech_id",)) -> DataFrame:
    """The longest single speeches."""
    short = speeches.select(*tie, "speaker", "party", "words")
    return top_k(short, [], [F.desc("words"), *[F.asc(c) for c in tie]], n)


def _word_totals(speeches: DataFrame, order: Sequence[str]) -> DataFrame:
    return speeches.groupBy("speaker").agg(
        F.min_by("party", F.struct(*order)).alias("party"), F.sum("words").alias("total_words"), F.count(F.lit(1)).alias("speeches")
    )


def verbose(speeches: DataFrame, n: int = 5, min_speeches: int = 5, order: Sequence[str] = ("speech_id",)) -> DataFrame:
    """Speakers by mean words per contribution."""
    t = _word_totals(speeches, order).filter(F.col("speeches") >= min_speeches)
    t = t.withColumn("avg_words", F.col("total_words") / F.col("speeches"))
    return top_k(t.select("speaker", "party", "avg_words", "speeches"), [], [F.desc("avg_words"), F.asc("speaker")], n)


def wordiest(speeches: DataFrame, n: int = 5, order: Sequence[str] = ("speech_id",)) -> DataFrame:
    """Speakers by total words."""
    return top_k(_word_totals(speeches, order), [], [F.desc("total_words"), F.asc("speaker")], n)


def avg_words_formal(speeches: DataFrame, n: int = 20, min_speeches: int = 5, order: Sequence[str] = ("speech_id",)) -> DataFrame:
    """Speakers by whole mean words per formal speech."""
    t = _word_totals(speeches.filter(F.col("type") == FORMAL), order).filter(F.col("speeches") >= min_speeches)
    t = t.withColumn("avg_words", F.floor(F.col("total_words") / F.col("speeches")))
    return top_k(t, [], [F.desc("avg_words"), F.asc("speaker")], n)


def academic_ranking(lengths: DataFrame) -> DataFrame:
    """Parties by share of speeches with an academic title (input: ``length_stats``)."""
    return lengths.select("party", "dr_ratio", "dr_count", "speeches").orderBy(F.desc("dr_ratio"), F.asc("party"))


# ---------------------------------------------------------------- full speaker ranks


def speaker_ranks(index: DataFrame, events: DataFrame | None = None, min_speeches: int = 3) -> DataFrame:
    """All ranks of every speaker: global, per party, pool sizes and percentiles.

    Ranks by speeches, words, mean words (from ``min_speeches`` speeches) and
    longest speech; with ``events`` also by interjections made and received,
    where a speaker is matched by name and party.
    """
    values = index.select("speaker", "party", "speeches", "total_words", "avg_words", "max_words")
    enough = {"avg_words": F.col("speeches") >= min_speeches}
    ranks = metric_ranks(values, "speaker", ["speeches", "total_words", "avg_words", "max_words"], (None, "party"), enough)
    names = {
        ("all", "speeches"): "speech_rank", ("all", "total_words"): "words_rank", ("all", "avg_words"): "verbosity_rank",
        ("all", "max_words"): "longest_speech_rank", ("party", "speeches"): "party_speech_rank",
        ("party", "total_words"): "party_words_rank", ("party", "avg_words"): "party_verbosity_rank",
    }
    pools = {("all", "speeches"): "total_speakers", ("all", "avg_words"): "verbosity_total", ("party", "speeches"): "party_size"}

    def cell(scope: str, metric: str, value: str) -> Column:
        return F.max(F.when((F.col("scope") == scope) & (F.col("metric") == metric), F.col(value)))

    aggs = [cell(s, m, "rank").alias(n) for (s, m), n in names.items()] + [cell(s, m, "pool").alias(n) for (s, m), n in pools.items()]
    out = index.select("speaker", "party").join(ranks.groupBy("speaker").agg(*aggs), "speaker")
    out = out.withColumn("speech_percentile", percentile(F.col("speech_rank"), F.col("total_speakers"))).withColumn(
        "words_percentile", percentile(F.col("words_rank"), F.col("total_speakers"))
    )
    if events is not None:
        out = out.join(speaker_drama(index, events), ["speaker", "party"], "left")
    return out


def percentile(rank: Column, total: Column) -> Column:
    """Share of the pool ranked below, in percent with one decimal."""
    return F.round((1 - rank / total) * 100, 1)


def speaker_drama(index: DataFrame, events: DataFrame) -> DataFrame:
    """Interjections made and received per speaker with the ranks among all interrupters and all interrupted."""

    def ranked(name: str, party: str, count: str, rank: str) -> DataFrame:
        c = events.groupBy(F.col(name).alias("speaker"), F.col(party).alias("party")).agg(F.count(F.lit(1)).alias(count))
        keyed = c.withColumn("_k", F.concat_ws("\u0001", "speaker", "party"))
        r = metric_ranks(keyed, "_k", [count]).select("_k", F.col("rank").alias(rank))
        return keyed.join(r, "_k").drop("_k")

    made = ranked("from_name", "from_party", "interruptions_given", "interrupter_rank")
    received = ranked("to_name", "to_party", "interruptions_received", "interrupted_rank")
    return (
        index.select("speaker", "party")
        .join(made, ["speaker", "party"], "left")
        .join(received, ["speaker", "party"], "left")
        .na.fill(0, ["interruptions_given", "interruptions_received"])
    )


def speaker_comparison(index: DataFrame, averages: DataFrame) -> DataFrame:
    """A speaker's mean words against the party's and the corpus' (2 decimals, 1.0 without a base).

    ``vs_party`` and ``vs_corpus`` divide by the mean over all contributions;
    the ``_formal`` variants divide by words per formal speech.
    """
    # the overall row is attached to the per-party rows through a window, one row per party
    base = averages.select(
        "party", "overall",
        F.col("avg_words_all").alias("party_avg_words"), F.col("avg_words_formal").alias("party_avg_formal"),
        F.max(F.when(F.col("overall"), F.col("avg_words_all"))).over(Window.partitionBy()).alias("corpus_avg_words"),
        F.max(F.when(F.col("overall"), F.col("avg_words_formal"))).over(Window.partitionBy()).alias("corpus_avg_formal"),
    ).filter(~F.col("overall")).drop("overall")
    joined = index.select("speaker", "party", F.col("avg_words").alias("speaker_avg_words")).join(base, "party", "left")

    def versus(base_col: str) -> Column:
        return F.round(ratio(F.col("speaker_avg_words"), F.col(base_col), 1.0), 2)

    return joined.select(
        "speaker", "party", "speaker_avg_words", "party_avg_words", "corpus_avg_words",
        versus("party_avg_words").alias("vs_party"), versus("corpus_avg_words").alias("vs_corpus"),
        versus("party_avg_formal").alias("vs_party_formal"), versus("corpus_avg_formal").alias("vs_corpus_formal"),
    )


def badges(profile: DataFrame, limit: int = 6) -> DataFrame:
    """Up to ``limit`` notable facts per speaker as an array of ``(kind, rank, value)``.

    Reads the index columns and those of ``speaker_ranks`` with events.
    """
    c = F.col
    made = F.coalesce(c("interruptions_given"), F.lit(0))
    interrupter = F.coalesce(c("interrupter_rank") <= 20, F.lit(False))

    def fact(cond: Column, kind: str, rank: Column, value: Column) -> Column:
        return F.when(cond, F.struct(F.lit(kind).alias("kind"), rank.cast("int").alias("rank"), value.cast("long").alias("value")))

    none = F.lit(None)
    facts = F.array(
        fact(F.lit(True), "speeches", none, c("speeches")),
        fact(c("total_words") >= 1000, "words", none, c("total_words")),
        fact(c("speech_rank") <= 20, "speech_rank", c("speech_rank"), c("total_speakers")),
        fact(c("verbosity_rank") <= 20, "verbosity_rank", c("verbosity_rank"), c("verbosity_total")),
        fact((c("longest_speech_rank") <= 10) & (c("max_words") > 0), "longest_speech", c("longest_speech_rank"), c("max_words")),
        fact(interrupter, "interrupter_rank", c("interrupter_rank"), made),
        fact(~interrupter & (made >= 10), "interruptions", none, made),
        fact((c("party_speech_rank") <= 5) & (c("party_size") > 10), "party_rank", c("party_speech_rank"), c("party_size")),
        fact((c("speech_percentile") >= 90) & (c("speech_rank") > 20), "top_percent", none, 100 - F.floor("speech_percentile")),
    )
    return profile.withColumn("badges", F.slice(F.filter(facts, lambda f: f.isNotNull()), 1, limit))


def speaker_documents(index: DataFrame, ranks: DataFrame, comparison: DataFrame, *parts: tuple[str, DataFrame]) -> DataFrame:
    """One nested record per speaker: index columns plus a struct per part, joined on (speaker, party).

    Each part is ``(name, table)`` with one row per (speaker, party).
    """
    out = index
    for name, table in (("rankings", ranks), ("comparison", comparison), *parts):
        cols = [c for c in table.columns if c not in ("speaker", "party")]
        out = out.join(table.select("speaker", "party", F.struct(*cols).alias(name)), ["speaker", "party"], "left")
    return out


def listed_per_speaker(df: DataFrame, cols: Sequence[str], out: str) -> DataFrame:
    """Fold a ranked short list (one row per speaker and rank) into one array per speaker."""
    ordered = F.sort_array(F.collect_list(F.struct("rank", *cols)))
    return df.groupBy("speaker", "party").agg(F.transform(ordered, lambda w: F.struct(*[w[c].alias(c) for c in cols])).alias(out))


def speaker_listing(index: DataFrame, party: str | None = None, search: str | None = None, limit: int | None = None) -> DataFrame:
    """Index entries by speeches, optionally of one party, by part of the name, and only the first ``limit``."""
    df = index
    if party is not None:
        df = df.filter(F.col("party") == party)
    if search is not None:
        df = df.filter(F.lower("speaker").contains(search.lower()))
    df = df.select("slug", "speaker", "party", "speeches", "wortbeitraege", "befragung_responses", "total_words")
    df = df.orderBy(F.desc("speeches"), F.asc("speaker"))
    return df if limit is None else df.limit(limit)


# ---------------------------------------------------------------- groups


def _long_ranks(scores: DataFrame, metrics: Sequence[str], by: str) -> DataFrame:
    long = scores.unpivot([by], list(metrics), "metric", "score")
    # rows per metric = number of groups
    w = Window.partitionBy("metric")
    return long.withColumn("rank", F.row_number().over(w.orderBy(F.desc("score"), F.asc(by)))).withColumn(
        "groups", F.count(F.lit(1)).over(w)
    )


def group_rankings(scores: DataFrame, metrics: Sequence[str] = GROUP_METRICS, by: str = "party") -> DataFrame:
    """Rank and score of every group on every metric."""
    return _long_ranks(scores, metrics, by).select(by, "metric", "rank", "score")


def classify_group(scores: DataFrame, metrics: Sequence[str] = GROUP_METRICS, by: str = "party") -> DataFrame:
    """The metric on which a group ranks best; ties go to the higher score, then the listed order."""
    order = F.array_position(F.array(*[F.lit(m) for m in metrics]), F.col("metric"))
    ranked = group_rankings(scores, metrics, by)
    best = ranked.groupBy(by).agg(
        F.min_by(F.struct("metric", "rank", "score"), F.struct(F.col("rank"), -F.col("score"), order)).alias("_b")
    )
    return best.select(by, F.coalesce("_b.metric", F.lit("balanced")).alias("category"), "_b.rank", "_b.score")


def group_traits(scores: DataFrame, n: int = 3, metrics: Sequence[str] = GROUP_METRICS, extra: str = VARYING_METRIC, by: str = "party") -> DataFrame:
    """Metrics on which a group ranks first or second, most distinguishing first, at most ``n``.

    ``extra`` takes part only if its scores differ between groups.
    """
    names = [*metrics, extra]
    order = F.array_position(F.array(*[F.lit(m) for m in names]), F.col("metric"))
    long = _long_ranks(scores, names, by)
    varies = long.groupBy(F.col("metric").alias("_m")).agg((F.max("score") > F.min("score")).alias("_varies"))
    used = long.join(varies, F.col("metric") == F.col("_m")).filter((F.col("metric") != extra) | F.col("_varies"))
    traits = used.filter(F.col("rank") <= 2).withColumn("extremity", (F.col("groups") + 1) / 2 - F.col("rank"))
    listed = traits.groupBy(by).agg(
        F.sort_array(F.collect_list(F.struct((-F.col("extremity")).alias("e"), "rank", order.alias("o"), "metric"))).alias("_t")
    )
    picked = listed.select(by, F.slice(F.transform("_t", lambda t: t["metric"]), 1, n).alias("traits"))
    return scores.select(by).join(picked, by, "left").select(
        by, F.coalesce("traits", F.expr("cast(array() as array<string>)")).alias("traits")
    )


def group_profiles(scores: DataFrame, by: str = "party") -> DataFrame:
    """Category, rank, traits and all scores of every group."""
    cols = [c for c in scores.columns if c != by]
    return (
        classify_group(scores, by=by)
        .join(group_traits(scores, by=by), by)
        .join(scores.select(by, F.struct(*cols).alias("scores")), by)
        .withColumn("total_groups", F.count(F.lit(1)).over(Window.partitionBy()))
    )


def classify_single(scores: DataFrame, by: str = "party") -> DataFrame:
    """Category of a group from its own scores only: indices are weighted, ratios count by their distance from 50."""
    weighted = [
        ("aggression", F.col("aggression") * 3),
        ("discriminatory", F.col("discriminatory") * 5),
        ("demand_intensity", F.col("demand_intensity") * 3),
        ("collaboration", F.abs(F.col("collaboration") - 50)),
        ("solution_focus", F.abs(F.col("solution_focus") - 50)),
        ("affirmative", F.abs(F.col("affirmative") - 50)),
    ]
    # the first listed category wins ties
    entries = [F.struct(v.alias("w"), F.lit(-i).alias("o"), F.lit(k).alias("category")) for i, (k, v) in enumerate(weighted)]
    best = F.array_max(F.array(*entries))
    return scores.select(by, best["category"].alias("category"), best["w"].alias("weight"))


# ---------------------------------------------------------------- archetypes


def archetype_features(index: DataFrame, ranks: DataFrame, drama: DataFrame, signature: DataFrame, tone: DataFrame) -> DataFrame:
    """One row per speaker with the metrics that archetypes are scored on; missing values get neutral defaults."""
    sig = signature.groupBy("speaker", "party").agg(
        F.max(F.when(F.col("rank") == 1, F.col("ratio_corpus"))).alias("sig_ratio"),
        F.sum(F.when(F.col("ratio_corpus") >= 5, 1).otherwise(0)).alias("sig_word_count"),
    )
    tones = tone.select("speaker", "party", "aggression", "collaboration", "affirmative", "solution_focus", "demand_intensity", "authority")
    r = ranks.select("speaker", "party", "words_rank", "speech_rank", "party_speech_rank", "party_size", "verbosity_rank")
    d = drama.select("speaker", "party", "interruptions_given", "interruptions_received")
    joined = index.select(
        "speaker", "party", F.col("speeches").alias("_formal"), (F.col("speeches") + F.col("wortbeitraege")).alias("speeches"),
        "total_words", "avg_words",
    )
    for part in (r, d, sig, tones):
        joined = joined.join(part, ["speaker", "party"], "left")
    fill = {
        "words_rank": NO_RANK, "speech_rank": NO_RANK, "party_speech_rank": NO_RANK, "verbosity_rank": NO_RANK, "party_size": 0,
        "interruptions_given": 0, "interruptions_received": 0, "sig_ratio": 0.0, "sig_word_count": 0, "aggression": 0.0,
        "collaboration": 50.0, "affirmative": 50.0, "solution_focus": 50.0, "demand_intensity": 0.0, "authority": 50.0,
    }
    filled = joined.na.fill(fill)
    received = F.greatest(F.lit(1), F.col("interruptions_received"))
    return filled.withColumn("persistence", F.col("_formal") / received * 10).drop("_formal")


def fit_scores(features: DataFrame, criteria: DataFrame, keys: Sequence[str] = ("speaker", "party")) -> DataFrame:
    """Fit of every entity to every archetype; entities that miss a minimum are left out.

    ``criteria(archetype, metric, weight, scale, min, inverse)``. A metric adds
    weight * min(1, value / scale); an inverse one uses max(0, scale - value).
    """
    metrics = [c for c in features.columns if c not in keys and dict(features.dtypes)[c] not in ("string",)]
    long = features.select(
        *keys, F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics]))
    )
    def terms(value: Column) -> tuple[Column, Column]:
        used = F.when(F.col("inverse"), F.greatest(F.lit(0.0), F.col("scale") - value)).otherwise(value)
        part = F.when(F.col("scale") > 0, F.least(F.lit(1.0), used / F.col("scale"))).otherwise(0.0) * F.col("weight")
        return part, F.col("min").isNull() | (value >= F.col("min"))

    part, ok = terms(F.col("value"))
    found = long.join(criteria, "metric").groupBy(*keys, "archetype").agg(F.sum(part).alias("score"), F.bool_and(ok).alias("_ok")).filter("_ok")
    # a metric without a column counts as 0, so that its minimum and its share of the fit still apply
    part0, ok0 = terms(F.lit(0.0))
    rest = criteria.groupBy("archetype").agg(
        F.sum(F.when(~F.col("metric").isin(*metrics), part0).otherwise(0.0)).alias("_more"), F.bool_and(F.col("metric").isin(*metrics) | ok0).alias("_may")
    )
    return join_groups(found, rest, ["archetype"]).filter("_may").select(*keys, "archetype", (F.col("score") + F.col("_more")).alias("score"))


def assign_archetype(
    features: DataFrame, fits: DataFrame, exclude_groups: Sequence[str] = (), keys: Sequence[str] = ("speaker", "party"),
    fallback: str = "biene",
) -> DataFrame:
    """Archetype per entity with up to two alternatives; excluded groups get null.

    Exceptional ranks decide first, otherwise the best fit does.
    """
    top = top_k(fits, keys, [F.desc("score"), F.asc("archetype")], 3)
    lists = top.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("rank", "archetype", "score"))).alias("_top"))
    c = F.col
    elite = (
        F.when((c("words_rank") <= 10) & (c("aggression") > 15), F.lit("tiger"))
        .when(c("words_rank") <= 10, F.lit("elefant"))
        .when((c("speech_rank") <= 10) & (c("words_rank") <= 20), F.lit("adler"))
        .when((c("party_speech_rank") <= 3) & (c("party_size") >= 20), F.lit("loewe"))
    )
    excluded = c("party").isin(*exclude_groups) if exclude_groups else F.lit(False)
    joined = features.select(*keys, elite.alias("_elite")).join(lists, list(keys), "left")
    chosen = F.coalesce("_elite", F.get("_top", F.lit(0))["archetype"], F.lit(fallback))
    others = F.slice(F.filter("_top", lambda t: t["archetype"] != F.col("_chosen")), 1, 2)
    return joined.withColumn("_chosen", chosen).select(
        *keys,
        F.when(~excluded, F.col("_chosen")).alias("archetype"),
        F.when(~excluded, F.transform(others, lambda t: F.struct(t["archetype"].alias("archetype"), F.round(t["score"], 3).alias("score")))).alias("alternatives"),
    )
