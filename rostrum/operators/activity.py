"""Grouped statistics over speeches: activity, lengths, speaker index, profiles, reports."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rostrum.functions.text import name_parts, resolve_slug_collisions, slug
from rostrum.operators.common import count_if, ratio, sum_if, top_k
from rostrum.session import materialize

ANSWER_TYPES = ("befragung", "fragestunde_antwort")
QUESTION_TYPE = "fragestunde"
FORMAL = "rede"
WORDS_PER_BOOK = 50_000


def _counts() -> list[Column]:
    return [
        count_if(F.col("type") == FORMAL).alias("formal"),
        count_if(F.col("type").isin(*ANSWER_TYPES)).alias("befragung"),
        count_if(F.col("type") == QUESTION_TYPE).alias("fragestunde"),
        count_if(F.col("category") != FORMAL).alias("wortbeitrag"),
    ]


def activity_counts(speeches: DataFrame) -> DataFrame:
    """Contributions by kind per (party, speaker)."""
    return speeches.groupBy("party", "speaker").agg(*_counts())


def activity_by_party(speeches: DataFrame) -> DataFrame:
    """Contributions by kind per party (``real_speech`` by type, ``rede`` by category)."""
    return speeches.groupBy("party").agg(
        count_if(F.col("type") == FORMAL).alias("real_speech"),
        count_if(F.col("category") == FORMAL).alias("rede"),
        count_if(F.col("category") != FORMAL).alias("wortbeitrag"),
    )


def length_stats(speeches: DataFrame, by: str = "party") -> DataFrame:
    """Words per speech (min, max, mean) and the share of speeches by titled speakers.

    ``titled_speakers`` also counts the titled persons, since the ratio is per speech.
    """
    titled = F.col("acad_title").isNotNull() & (F.col("acad_title") != "")
    return speeches.groupBy(by).agg(
        F.count(F.lit(1)).alias("speeches"),
        F.min("words").alias("min_words"),
        F.max("words").alias("max_words"),
        (F.sum("words") / F.count(F.lit(1))).alias("avg_words"),
        count_if(titled).alias("dr_count"),
        (count_if(titled) / F.count(F.lit(1))).alias("dr_ratio"),
        F.count_distinct(F.when(titled, F.col("speaker"))).alias("titled_speakers"),
    )


def index_statistics(speeches: DataFrame, order: Sequence[str] = ("protocol_id", "speech_id")) -> DataFrame:
    """What the index says of each speaker, in a form that adds up over parts of the speeches.

    ``first`` holds the place of the first speech and the party and title there.
    """
    first = F.struct(*order, "party", "acad_title")
    return speeches.groupBy("speaker").agg(
        F.min(first).alias("first"),
        count_if(F.col("category") == FORMAL).alias("speeches"),
        count_if(F.col("category") != FORMAL).alias("wortbeitraege"),
        count_if(F.col("type").isin(*ANSWER_TYPES)).alias("befragung_responses"),
        F.count(F.lit(1)).alias("total_interventions"),
        F.sum("words").alias("total_words"),
        F.min("words").alias("min_words"),
        F.max("words").alias("max_words"),
    )


def index_columns(stats: DataFrame) -> DataFrame:
    """The index of ``index_statistics``."""
    index = stats.select(
        "speaker", F.col("first.party").alias("party"), slug(F.col("speaker")).alias("slug"), "speeches", "wortbeitraege", "befragung_responses",
        "total_interventions", "total_words",
        F.round(ratio(F.col("total_words"), F.col("speeches") + F.col("wortbeitraege"))).cast("long").alias("avg_words"),
        "min_words", "max_words", F.col("first.acad_title").alias("acad_title"),
    )
    return resolve_slug_collisions(index)


def speaker_index(speeches: DataFrame, order: Sequence[str] = ("protocol_id", "speech_id")) -> DataFrame:
    """One row per speaker: party (of the first speech), slug, counts and word statistics."""
    return index_columns(index_statistics(speeches, order))


def speaker_profiles(
    speeches: DataFrame, events: DataFrame, genders, order: Sequence[str] = ("protocol_id", "speech_id")
) -> DataFrame:
    """One row per speaker with totals, counts per kind, gender and interruptions made and received.

    ``genders`` maps a DataFrame with ``first_name`` to the same with ``gender``.
    Missing first names are parsed from the speaker; interruptions are matched
    by name and party.
    """
    first = F.struct(*order)
    s = speeches.filter(F.col("speaker") != "").groupBy("speaker").agg(
        F.min_by("party", first).alias("party"),
        F.min_by(F.struct("first_name", "last_name", "acad_title"), first).alias("_n"),
        F.count(F.lit(1)).alias("total_speeches"),
        F.sum("words").alias("total_words"),
        count_if(F.col("category") == FORMAL).alias("formal_speeches"),
        count_if(F.col("category") != FORMAL).alias("wortbeitraege"),
        count_if(F.col("type").isin(*ANSWER_TYPES)).alias("befragung_responses"),
        count_if(F.col("type") == QUESTION_TYPE).alias("question_speeches"),
    )
    parsed = name_parts(F.col("speaker"))
    missing = F.coalesce(F.col("_n.first_name"), F.lit("")) == ""
    named = s.select(
        "speaker", "party",
        F.when(missing, parsed["first_name"]).otherwise(F.col("_n.first_name")).alias("first_name"),
        F.when(missing, parsed["last_name"]).otherwise(F.col("_n.last_name")).alias("last_name"),
        F.when(missing, F.coalesce(parsed["acad_title"], F.col("_n.acad_title"))).otherwise(F.col("_n.acad_title")).alias("acad_title"),
        "total_speeches", "total_words", "formal_speeches", "wortbeitraege", "befragung_responses", "question_speeches",
    )
    made = events.groupBy(F.col("from_name").alias("speaker"), F.col("from_party").alias("party")).agg(
        F.count(F.lit(1)).alias("interruptions_made")
    )
    received = events.groupBy(F.col("to_name").alias("speaker"), F.col("to_party").alias("party")).agg(
        F.count(F.lit(1)).alias("interruptions_received")
    )
    full = (
        genders(named)
        .join(made, ["speaker", "party"], "left")
        .join(received, ["speaker", "party"], "left")
        .na.fill(0, ["interruptions_made", "interruptions_received"])
    )
    return full.withColumn("avg_words", ratio(F.col("total_words"), F.col("total_speeches")))


PROFILE_COUNTS = [
    "total_speeches", "total_words", "formal_speeches", "wortbeitraege", "befragung_responses", "question_speeches",
    "interruptions_made", "interruptions_received",
]


def merge_partial_profiles(profiles: DataFrame) -> DataFrame:
    """Fold last-name-only profiles into the full profile of the same (last name, party).

    Among several candidates the one with most speeches (then by name) is
    taken; counts are summed and profiles without a counterpart are kept.
    """
    partial = F.trim(F.coalesce(F.col("first_name"), F.lit(""))) == ""
    # read four times below: kept once, one row per speaker
    keyed = materialize(profiles.withColumn("_key", F.lower("last_name")))
    full = keyed.filter(~partial)
    best = full.groupBy("_key", "party").agg(
        F.min_by("speaker", F.struct(-F.col("total_speeches"), F.col("speaker"))).alias("_target")
    )
    parts = keyed.filter(partial).join(best, ["_key", "party"], "left")
    moved = parts.filter(F.col("_target").isNotNull()).groupBy("_target").agg(
        *[F.sum(c).alias(f"_{c}") for c in PROFILE_COUNTS]
    )
    merged = full.join(moved, F.col("speaker") == F.col("_target"), "left")
    for c in PROFILE_COUNTS:
        merged = merged.withColumn(c, F.col(c) + F.coalesce(F.col(f"_{c}"), F.lit(0)))
    kept = parts.filter(F.col("_target").isNull())
    out = merged.select(*profiles.columns).unionByName(kept.select(*profiles.columns))
    return out.withColumn("avg_words", ratio(F.col("total_words"), F.col("total_speeches")))


def gender_stats(profiles: DataFrame, parties: Sequence[str] | None = None) -> DataFrame:
    """Speakers, speeches, words, lengths, interruptions and titles by gender: per party and in total (party null)."""
    source = profiles if parties is None else profiles.filter(F.col("party").isin(*parties))
    aggs = [F.count(F.lit(1)).alias("total_speakers")]
    for g in ("male", "female", "unknown"):
        is_g = F.col("gender") == g
        aggs += [
            count_if(is_g).alias(f"{g}_speakers"),
            sum_if(is_g, F.col("total_speeches")).alias(f"{g}_speeches"),
            sum_if(is_g, F.col("total_words")).alias(f"{g}_words"),
        ]
        if g != "unknown":
            aggs += [
                sum_if(is_g, F.col("interruptions_made")).alias(f"{g}_interruptions_made"),
                sum_if(is_g, F.col("interruptions_received")).alias(f"{g}_interruptions_received"),
                count_if(is_g & F.col("acad_title").isNotNull()).alias(f"{g}_dr_count"),
            ]
    stats = source.rollup("party").agg(*aggs, F.grouping("party").alias("_total"))
    for g in ("male", "female", "unknown"):
        stats = stats.withColumn(f"{g}_avg_length", ratio(F.col(f"{g}_words"), F.col(f"{g}_speeches")))
    return stats.withColumn("is_total", F.col("_total") == 1).drop("_total")


def group_averages(index: DataFrame) -> DataFrame:
    """Rounded words per formal speech, per party and overall (party null); 0 without formal speeches.

    ``avg_words_all`` divides by all contributions, the denominator of a speaker's own average.
    """
    return index.rollup("party").agg(
        F.round(ratio(F.sum("total_words"), F.sum("speeches"))).cast("long").alias("avg_words_formal"),
        F.round(ratio(F.sum("total_words"), F.sum("total_interventions"))).cast("long").alias("avg_words_all"),
        (F.grouping("party") == 1).alias("overall"),
    )


def style_metrics(stats: DataFrame) -> DataFrame:
    """Style figures per party from ``(party, speeches, total_words, unique_nouns, total_nouns, total_adjectives, total_verbs)``."""
    nouns = F.greatest(F.col("total_nouns"), F.lit(1))
    return stats.select(
        "party",
        ratio(F.col("total_words"), F.col("speeches")).alias("avg_speech_length"),
        (F.col("unique_nouns") / nouns).alias("vocabulary_richness"),
        (F.col("total_adjectives") / nouns).alias("descriptiveness"),
        (F.col("total_verbs") / nouns).alias("action_orientation"),
    )


def unique_speakers(speeches: DataFrame) -> DataFrame:
    """Distinct formal speakers per party and overall (party null)."""
    pairs = speeches.filter(F.col("type") == FORMAL).select("party", "speaker").distinct()
    by_party = pairs.groupBy("party").agg(F.count(F.lit(1)).alias("speakers"))
    overall = pairs.select("speaker").distinct().agg(F.count(F.lit(1)).alias("speakers"))
    return by_party.unionByName(overall.select(F.lit(None).cast("string").alias("party"), "speakers"))


def corpus_overview(speeches: DataFrame) -> DataFrame:
    """One row: speeches, formal and other contributions, words, parties, speakers."""
    per_speaker = speeches.groupBy("party", "speaker").agg(
        F.count(F.lit(1)).alias("_n"), count_if(F.col("category") == FORMAL).alias("_r"), F.sum("words").alias("_w")
    )
    return per_speaker.agg(
        F.sum("_n").alias("speeches"), F.sum("_r").alias("reden"), (F.sum("_n") - F.sum("_r")).alias("wortbeitraege"),
        F.sum("_w").alias("words"), F.count_distinct("party").alias("parties"), F.count_distinct("speaker").alias("speakers"),
    )


def group_overview(
    speeches: DataFrame, top_words: DataFrame, signature: DataFrame, topics: DataFrame, style: DataFrame,
) -> DataFrame:
    """Report row per party: counts, words, speakers, lists of top, signature and key words, style, top speaker.

    ``top_words(party, rank, word, n)``, ``signature(party, rank, word, ratio)``
    and ``topics(party, rank, word, n, ratio)`` are already cut to the wanted length.
    """
    per_speaker = speeches.groupBy("party", "speaker").agg(
        count_if(F.col("type") == FORMAL).alias("_formal"), F.count(F.lit(1)).alias("_n"), F.sum("words").alias("_w")
    )
    best = F.struct(-F.col("_formal"), F.col("speaker"))
    base = per_speaker.groupBy("party").agg(
        F.sum("_formal").alias("speeches"), (F.sum("_n") - F.sum("_formal")).alias("wortbeitraege"),
        F.sum("_w").alias("total_words"), count_if(F.col("_formal") > 0).alias("unique_speakers"),
        F.min_by(F.struct(F.col("speaker").alias("name"), F.col("_formal").alias("speeches")), best).alias("_top"),
    ).withColumn("top_speaker", F.when(F.col("_top.speeches") > 0, F.col("_top"))).drop("_top")

    def listed(df: DataFrame, out: str, *cols: str) -> DataFrame:
        ordered = F.sort_array(F.collect_list(F.struct("rank", *cols)))
        return df.groupBy("party").agg(
            F.transform(ordered, lambda w: F.struct(*[w[c].alias(c) for c in cols])).alias(out)
        )

    return (
        base.join(listed(top_words, "top_words", "word", "n"), "party", "left")
        .join(listed(signature.withColumn("ratio", F.round("ratio", 1)), "signature_words", "word", "ratio"), "party", "left")
        .join(listed(topics.withColumn("ratio", F.round("ratio", 1)), "key_topics", "word", "n", "ratio"), "party", "left")
        .join(
            style.select("party", F.floor("avg_speech_length").alias("avg_speech_length"),
                         F.round(F.col("descriptiveness") * 100, 1).alias("descriptiveness")),
            "party", "left",
        )
    )


def speaker_analysis(
    speeches: DataFrame, counts: DataFrame, tone: DataFrame, topics: DataFrame, speaker: str | None = None, top: int = 20,
    by: Sequence[str] = ("party", "speaker"),
) -> DataFrame:
    """Per speaker: speeches, words, average (1 decimal), top words, tone scores and topic scores.

    ``counts(by..., word, n)``; ``tone`` has one row and ``topics`` one row per topic for each speaker.
    All speakers are computed at once unless one is named.
    """
    if speaker is not None:
        keep = F.col("speaker") == speaker
        speeches, counts, tone, topics = (d.filter(keep) for d in (speeches, counts, tone, topics))
    base = speeches.groupBy(*by).agg(F.count(F.lit(1)).alias("speeches"), F.sum("words").alias("words"))
    base = base.withColumn("avg_words", F.round(ratio(F.col("words"), F.col("speeches")), 1))
    words = top_k(counts, by, [F.desc("n"), F.asc("word")], top).groupBy(*by).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("rank", "word", "n"))), lambda w: F.struct(w["word"].alias("word"), w["n"].alias("n"))).alias("top_words")
    )
    scored = [c for c in tone.columns if c not in by]
    tone_rows = tone.select(*by, F.struct(*scored).alias("tone"))
    topic_rows = topics.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("topic", "score"))).alias("topics"))
    return base.join(words, list(by), "left").join(tone_rows, list(by), "left").join(topic_rows, list(by), "left")


def compare_parties(speeches: DataFrame, tone: DataFrame, topics: DataFrame, parties: Sequence[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Selected parties side by side: ``(activity, rankings, topic_spread)``.

    ``rankings`` orders the parties by speeches, aggression and collaboration;
    ``topic_spread`` orders topics by the difference between the highest and lowest score.
    """
    s = speeches.filter(F.col("party").isin(*parties))
    activity = s.groupBy("party", "speaker").agg(F.count(F.lit(1)).alias("_n"), F.sum("words").alias("_w")).groupBy("party").agg(
        F.count(F.lit(1)).alias("speakers"), F.sum("_n").alias("speeches"), F.sum("_w").alias("words"),
        F.round(F.sum("_w") / F.sum("_n"), 1).alias("avg_words"),
    )
    long = activity.join(tone.select("party", "aggression", "collaboration"), "party").select(
        "party", F.col("speeches").cast("double").alias("speeches"), "aggression", "collaboration"
    ).unpivot(["party"], ["speeches", "aggression", "collaboration"], "metric", "value")
    # rows per metric = number of parties
    rankings = long.withColumn("rank", F.row_number().over(Window.partitionBy("metric").orderBy(F.desc("value"), F.asc("party"))))
    spread = topics.filter(F.col("party").isin(*parties)).groupBy("topic").agg(
        F.max("score").alias("highest"), F.min("score").alias("lowest"), (F.max("score") - F.min("score")).alias("spread"),
        F.max_by("party", F.struct("score", "party")).alias("leader"),
    )
    return activity, rankings, spread.orderBy(F.desc("spread"), F.asc("topic"))


def compare_profiles(
    speeches: DataFrame, words: DataFrame, tone: DataFrame, topics: DataFrame, parties: Sequence[str] | None = None, top: int = 20,
) -> DataFrame:
    """Whole profiles of parties side by side, long: ``(party, part, item, value, rank)``.

    Parts: ``activity`` (speakers, speeches, words, avg_words), one part per word type with its ``top`` words and counts,
    and ``<type>_per_1000`` with their share, ``tone`` with every tone score, ``topic`` with every topic score, and the rankings
    ``by_aggression``, ``by_collaboration`` and ``by_solution_focus`` (item is null, value the score). ``words(party, word_type, word, n)``; ``tone`` has
    one row per party, ``topics(party, topic, score)``. Without ``parties`` all that occur are compared. Ranks start
    at 1 per party and part, for the rankings per part; parts without an order have none.
    """
    chosen = speeches.filter(F.col("party").isNotNull())
    if parties is not None:
        chosen = chosen.filter(F.col("party").isin(*parties))
    base = chosen.groupBy("party", "speaker").agg(F.count(F.lit(1)).alias("_n"), F.sum("words").alias("_w")).groupBy("party").agg(
        F.count("speaker").alias("speakers"), F.sum("_n").alias("speeches"), F.sum("_w").alias("words"), F.round(F.sum("_w") / F.sum("_n"), 1).alias("avg_words")
    )
    names = base.select("party", F.col("words").alias("_total"))
    none = F.lit(None).cast("int")

    def rows(df: DataFrame, part: Column, item: Column, value: Column, rank: Column) -> DataFrame:
        return df.select("party", part.alias("part"), item.cast("string").alias("item"), value.cast("double").alias("value"), rank.cast("int").alias("rank"))

    def long(df: DataFrame, part: str) -> DataFrame:
        cols = [c for c in df.columns if c not in ("party", "_total")]
        cells = F.array(*[F.struct(F.lit(c).alias("item"), F.col(c).cast("double").alias("value")) for c in cols])
        return rows(df.select("party", F.inline(cells)), F.lit(part), F.col("item"), F.col("value"), none)

    listed = top_k(words.join(names, "party"), ["party", "word_type"], [F.desc("n"), F.asc("word")], top)
    scores = tone.join(names, "party")
    parts = [
        long(base, "activity"),
        rows(listed, F.col("word_type"), F.col("word"), F.col("n"), F.col("rank")),
        rows(listed, F.concat("word_type", F.lit("_per_1000")), F.col("word"), ratio(F.col("n"), F.col("_total"), scale=1000.0), F.col("rank")),
        long(scores, "tone"),
        rows(topics.join(names, "party"), F.lit("topic"), F.col("topic"), F.col("score"), none),
    ]
    for metric in ("aggression", "collaboration", "solution_focus"):
        place = F.row_number().over(Window.orderBy(F.desc(metric), F.asc("party")))  # a row per party
        parts.append(rows(scores.withColumn("_place", place), F.lit(f"by_{metric}"), F.lit(None), F.col(metric), F.col("_place")))
    return reduce(DataFrame.unionByName, parts)


#: Shares below which a fact is not worth telling, in percent.
LEAST_LABELING, LEAST_SPREAD = 1, 10
FACT_COLUMNS = ("fact", "party", "other", "item", "value")


def _facts(df: DataFrame, fact: str, value: Column, party: str | None = "party", other: str | None = None, item: str | None = None) -> DataFrame:
    text = lambda c: F.lit(None).cast("string") if c is None else F.col(c).cast("string")
    return df.select(F.lit(fact).alias("fact"), text(party).alias("party"), text(other).alias("other"), text(item).alias("item"), value.cast("double").alias("value"))


def tone_facts(tone: DataFrame, words: DataFrame) -> DataFrame:
    """What stands out in tone: ``(fact, party, other, item, value)``.

    The parties with the most aggressive, most labeling (if above :data:`LEAST_LABELING`) and most collaborative
    language, the most frequent labeling and aggressive word of any party, and the distance between the most and the
    least affirmative party (if above :data:`LEAST_SPREAD`). ``words(party, category, word, n)`` holds adjectives by
    category. Ties go to the smaller party or word.
    """
    first = lambda metric: top_k(tone.select("party", metric), [], [F.desc(metric), F.asc("party")], 1)
    word = lambda category: top_k(words.filter(F.col("category") == category), [], [F.desc("n"), F.asc("word"), F.asc("party")], 1)
    ends = tone.agg(
        F.min(F.struct((-F.col("affirmative")).alias("s"), F.col("party").alias("p"))).alias("top"), F.max(F.struct((-F.col("affirmative")).alias("s"), F.col("party").alias("p"))).alias("low"), F.count(F.lit(1)).alias("_n")
    ).select(F.col("top.p").alias("party"), F.col("low.p").alias("other"), (F.col("low.s") - F.col("top.s")).alias("spread"), "_n")
    parts = [
        _facts(first("aggression"), "most_aggressive", F.col("aggression")),
        _facts(first("labeling").filter(F.col("labeling") > LEAST_LABELING), "most_labeling", F.col("labeling")),
        _facts(first("collaboration"), "most_collaborative", F.col("collaboration")),
        _facts(word("labeling"), "labeling_word", F.col("n"), item="word"),
        _facts(word("aggressive"), "aggressive_word", F.col("n"), item="word"),
        _facts(ends.filter((F.col("_n") >= 2) & (F.col("spread") > LEAST_SPREAD)), "affirmative_spread", F.col("spread"), other="other"),
    ]
    return reduce(DataFrame.unionByName, parts)


def gender_facts(profiles: DataFrame) -> DataFrame:
    """What stands out by gender: ``(fact, party, other, item, value)``.

    The share of women among speakers of known gender in percent, the party with the highest share, the woman with most
    contributions (item is her last name), and how many times as often men interrupt as women. Facts without a base
    are left out; ties go to the smaller name.
    """
    by_party = profiles.groupBy("party").agg(count_if(F.col("gender") == "female").alias("f"), count_if(F.col("gender").isin("female", "male")).alias("k")).filter("k > 0")
    best = top_k(by_party.select("party", (F.col("f") / F.col("k") * 100).alias("share")), [], [F.desc("share"), F.asc("party")], 1)
    totals = by_party.agg(F.sum("f").alias("f"), F.sum("k").alias("k")).filter("k > 0")
    women = profiles.filter("gender = 'female'").select("speaker", "party", "total_speeches")
    top = top_k(women, [], [F.desc("total_speeches"), F.asc("speaker"), F.asc("party")], 1).withColumn("last", F.element_at(F.split("speaker", " "), -1))
    made = profiles.agg(sum_if(F.col("gender") == "male", F.col("interruptions_made")).alias("m"), sum_if(F.col("gender") == "female", F.col("interruptions_made")).alias("f"))
    parts = [
        _facts(totals, "female_percent", F.col("f") / F.col("k") * 100, party=None),
        _facts(best, "most_female", F.col("share")),
        _facts(top, "top_woman", F.col("total_speeches"), item="last"),
        _facts(made.filter("m > 0 AND f > 0"), "men_interrupt", F.col("m") / F.col("f"), party=None),
    ]
    return reduce(DataFrame.unionByName, parts)


def kpi_facts(speeches: DataFrame, sessions: int) -> DataFrame:
    """Whole-number facts of a corpus: words per session day, words per contribution, book equivalents."""
    totals = speeches.agg(F.coalesce(F.sum("words"), F.lit(0)).alias("_w"), F.count(F.lit(1)).alias("_n"))
    facts = [
        ("words_per_session", F.floor(F.col("_w") / F.lit(sessions))),
        ("words_per_speech", F.floor(ratio(F.col("_w"), F.col("_n")))),
        ("book_equivalents", F.floor(F.col("_w") / F.lit(WORDS_PER_BOOK))),
    ]
    return totals.select(F.inline(F.array(*[F.struct(F.lit(k).alias("fact"), v.cast("long").alias("value")) for k, v in facts])))
