"""Interjections and reactions: who interrupts whom, who applauds, who heckles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rostrum.functions.groups import PARTY_PATTERNS, normalize_party, parties_in_annotation
from rostrum.functions.sentiment import NEGATIVE_KEYWORDS, POSITIVE_KEYWORDS, annotation_content, classify_sentiment
from rostrum.functions.text import last_name_key, strip_honorific
from rostrum.operators.common import count_if, distributed_rank, ratio, top_k
from rostrum.operators.tokens import groups_of

# The forms of annotations in a transcript.
INTERJECTION = r"\(([A-ZÄÖÜ][^\[\]()]{2,40})\s*\[([A-ZÄÖÜa-zäöü0-9/\s-]+)\]:[^)]+\)"
INTERJECTION_LOOSE = r"\(([A-ZÄÖÜ][^\[\]]{2,40})\s*\[([A-ZÄÖÜa-zäöü0-9/\s-]+)\]:[^)]+\)"
APPLAUSE = r"\(Beifall bei (?:der |dem )?([^)]+)\)"
HECKLE = r"\(Zurufe? (?:von der |vom |der )?([^)]+)\)"
NOISE = r"Beifall|Zuruf|Lachen|Heiterkeit|Widerspruch"


def annotations_only(raw: Column) -> Column:
    """The parenthesised spans of a raw text: all that interjection and reaction counts need of it."""
    return F.array_join(F.regexp_extract_all(raw, F.lit(r"\([^)]+\)"), F.lit(0)), " ")


def compact_speeches(speeches: DataFrame, raw: str = "raw_text") -> DataFrame:
    """Speeches without their text and with annotations as the raw text, small enough to keep for several readers."""
    return speeches.drop("text").withColumn(raw, annotations_only(F.col(raw)))


def is_noise(name: Column) -> Column:
    """Names that are reactions rather than persons."""
    return name.rlike(NOISE)


def extract_interjections(
    speeches: DataFrame, raw: str = "raw_text", strict: bool = True,
    patterns: Sequence[tuple[str, str]] = PARTY_PATTERNS, keep_noise: bool = False, keep_self: bool = False,
    positive: Sequence[str] = POSITIVE_KEYWORDS, negative: Sequence[str] = NEGATIVE_KEYWORDS, match: str = "substring",
) -> DataFrame:
    """One row per ``(Name [Group]: text)`` inside a speech's raw text.

    Reactions taken for names and self-interruptions (same last name) are left
    out. An unknown group keeps its spelling. ``strict=False`` lets a name span
    a preceding reaction, as looser transcripts need.
    """
    pattern = INTERJECTION if strict else INTERJECTION_LOOSE
    keys = [c for c in ("protocol_id", "speech_id") if c in speeches.columns]
    spans = speeches.select(
        *keys, F.col("speaker").alias("to_name"), F.col("party").alias("to_party"),
        F.explode(F.regexp_extract_all(F.col(raw), F.lit(pattern), F.lit(0))).alias("raw"),
    )
    name = F.trim(F.regexp_extract("raw", pattern, 1))
    group = F.trim(F.regexp_extract("raw", pattern, 2))
    events = spans.withColumn("_name", name).withColumn("_group", group)
    if not keep_noise:
        events = events.filter(~is_noise(F.col("_name")))
    events = events.withColumn("from_name", strip_honorific(F.col("_name")))
    if not keep_self:
        events = events.filter(last_name_key(F.col("from_name")) != last_name_key(F.col("to_name")))
    return events.select(
        *keys, "from_name", F.coalesce(normalize_party(F.col("_group"), patterns), F.col("_group")).alias("from_party"),
        "to_name", "to_party", annotation_content(F.col("raw")).alias("content"),
        classify_sentiment(F.col("raw"), positive, negative, match).alias("sentiment"), "raw",
    )


def interrupter_counts(events: DataFrame) -> DataFrame:
    """Interjections made per (name, party)."""
    return events.groupBy(F.col("from_name").alias("name"), F.col("from_party").alias("party")).agg(F.count(F.lit(1)).alias("n"))


def interrupted_counts(events: DataFrame) -> DataFrame:
    """Interjections received per (speaker, party)."""
    return events.groupBy(F.col("to_name").alias("name"), F.col("to_party").alias("party")).agg(F.count(F.lit(1)).alias("n"))


def top_names(counts: DataFrame, n: int = 10) -> DataFrame:
    """First ``n`` of a (name, party, n) table."""
    return top_k(counts, [], [F.desc("n"), F.asc("name"), F.asc("party")], n)


def cross_group_matrix(events: DataFrame) -> DataFrame:
    """Interjections per (from, to) pair of groups, as an edge list."""
    return events.groupBy("from_party", "to_party").agg(F.count(F.lit(1)).alias("n"))


def cross_group_totals(events: DataFrame) -> DataFrame:
    """The edge list with totals per sending and per receiving group (``level`` = pair, from, to)."""
    edges = cross_group_matrix(events)
    sets = [[F.col("from_party"), F.col("to_party")], [F.col("from_party")], [F.col("to_party")]]
    return edges.groupingSets(sets, "from_party", "to_party").agg(
        F.sum("n").alias("n"), F.grouping("from_party").alias("_f"), F.grouping("to_party").alias("_t")
    ).select(
        F.when(F.col("_f") == 1, "to").when(F.col("_t") == 1, "from").otherwise("pair").alias("level"), "from_party", "to_party", "n"
    )


def cross_group_wide(events: DataFrame, groups: Sequence[str] | None = None) -> DataFrame:
    """The matrix with one column per receiving group: the given ones, or all that occur."""
    edges = cross_group_matrix(events)
    if groups is None:
        groups = groups_of(edges, "to_party")
    return edges.groupBy("from_party").pivot("to_party", list(groups)).agg(F.sum("n")).na.fill(0)


def sentiment_counts(events: DataFrame) -> DataFrame:
    """Positive, negative and neutral interjections per (name, party)."""
    kinds = [count_if(F.col("sentiment") == k).alias(k) for k in ("positive", "negative", "neutral")]
    return events.groupBy(F.col("from_name").alias("name"), F.col("from_party").alias("party")).agg(*kinds)


def neutral_texts(events: DataFrame) -> DataFrame:
    """How often each neutral text occurs."""
    neutral = events.filter((F.col("sentiment") == "neutral") & F.col("content").isNotNull())
    return neutral.groupBy("content").agg(F.count(F.lit(1)).alias("n"))


def neutral_summary(events: DataFrame) -> DataFrame:
    """Number of neutral texts and of distinct ones."""
    return neutral_texts(events).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.count(F.lit(1)).alias("distinct_texts")
    )


def _reaction_counts(speeches: DataFrame, pattern: str, raw: str, patterns: Sequence[tuple[str, str]], out: str) -> DataFrame:
    spans = speeches.select(F.explode(F.regexp_extract_all(F.col(raw), F.lit(pattern), F.lit(1))).alias("_s"))
    texts = spans.groupBy(F.trim("_s").alias("_s")).agg(F.count(F.lit(1)).alias("_n"))
    named = texts.select("_n", F.explode(parties_in_annotation(F.col("_s"), patterns)).alias(out))
    return named.groupBy(out).agg(F.sum("_n").alias("n"))


def applause_counts(speeches: DataFrame, raw: str = "raw_text", patterns: Sequence[tuple[str, str]] = PARTY_PATTERNS) -> DataFrame:
    """Applause events per applauding party; each named party counts once per event."""
    return _reaction_counts(speeches, APPLAUSE, raw, patterns, "applauding_party")


def heckle_counts(speeches: DataFrame, raw: str = "raw_text", patterns: Sequence[tuple[str, str]] = PARTY_PATTERNS) -> DataFrame:
    """Heckles per heckling party."""
    return _reaction_counts(speeches, HECKLE, raw, patterns, "heckling_party")


def heckle_ranking(events: DataFrame, n: int = 10) -> DataFrame:
    """Parties by interjections of their members."""
    counts = events.groupBy(F.col("from_party").alias("party")).agg(F.count(F.lit(1)).alias("n"))
    return top_k(counts, [], [F.desc("n"), F.asc("party")], n)


def sentiment_summary(events: DataFrame) -> DataFrame:
    """Totals and percentages (1 decimal) of the three sentiments."""
    kinds = ("positive", "negative", "neutral")
    totals = events.agg(F.count(F.lit(1)).alias("total"), *[count_if(F.col("sentiment") == k).alias(k) for k in kinds])
    shares = [F.round(ratio(F.col(k), F.col("total"), 0.0, 100), 1).alias(f"{k}_percent") for k in kinds]
    return totals.select("total", *kinds, *shares)


def ranked_names(counts: DataFrame) -> DataFrame:
    """All rows of a (name, party, n) table with their position."""
    return distributed_rank(counts, [], [F.desc("n"), F.asc("name"), F.asc("party")])


def interruption_report(events: DataFrame, n: int | None = None) -> DataFrame:
    """Ranked interrupters with their sentiment split: all of them, or the first ``n``."""
    split = sentiment_counts(events).withColumn("n", F.col("positive") + F.col("negative") + F.col("neutral"))
    return ranked_names(split) if n is None else top_names(split, n)


def interrupted_report(events: DataFrame, n: int | None = None) -> DataFrame:
    """Ranked list of interrupted speakers: all of them, or the first ``n``."""
    counts = interrupted_counts(events)
    return ranked_names(counts) if n is None else top_names(counts, n)


def critic_score(events: DataFrame, min_total: int = 50) -> DataFrame:
    """Names with at least ``min_total`` interjections by negatives * sqrt(total), and their negative rate."""
    split = sentiment_counts(events).withColumn("total", F.col("positive") + F.col("negative") + F.col("neutral"))
    return (
        split.filter((F.col("total") >= min_total) & (F.col("negative") > 0))
        .select(
            "name", "party", "negative", "total", (F.col("negative") * F.sqrt("total")).alias("score"),
            (F.col("negative") / F.col("total")).alias("negative_rate"),
        )
        .orderBy(F.desc("score"), F.asc("name"), F.asc("party"))
    )


def critic_rate_leader(events: DataFrame, min_total: int = 50) -> DataFrame:
    """The name with the highest negative rate among those in ``critic_score``."""
    return top_k(critic_score(events, min_total), [], [F.desc("negative_rate"), F.asc("name"), F.asc("party")], 1).drop("rank")
