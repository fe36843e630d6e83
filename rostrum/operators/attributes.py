"""Attributes of speakers (gender by first name) and analyses by that attribute.

Every inference carries its source and confidence; name tables are inputs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rostrum.operators.common import count_if, lookup_frame, ratio, sum_if, top_k

# Endings that suggest a gender, with their confidence, tested in this order.
FEMALE_ENDINGS = ["ine", "ina", "ella", "ette", "ika", "heid", "gard", "traud", "trud", "linde", "hilde"]
MALE_ENDINGS = [
    "bert", "brecht", "fried", "hard", "hart", "helm", "hold",
    "mar", "mut", "olf", "wald", "ward", "win", "rich",
    "ian", "ius", "us",
]
GENDERS = ("male", "female", "unknown")

# Lookup sources by priority with their confidence; an ambiguous dictionary name counts less.
SOURCES = {"manual": (0, 1.0), "override": (1, 0.9), "dictionary": (2, 0.95)}
AMBIGUOUS_CONFIDENCE = 0.7

# A small set of common names, so that the detector works without input; real runs pass their own table.
COMMON_NAMES = [
    ("anna", "female"), ("angela", "female"), ("annalena", "female"), ("beate", "female"), ("clara", "female"),
    ("claudia", "female"), ("dora", "female"), ("frida", "female"), ("gabriele", "female"), ("ida", "female"),
    ("julia", "female"), ("katrin", "female"), ("maria", "female"), ("sabine", "female"), ("susanne", "female"),
    ("ursula", "female"), ("andreas", "male"), ("bernd", "male"), ("christian", "male"), ("emil", "male"),
    ("friedrich", "male"), ("gustav", "male"), ("hans", "male"), ("jens", "male"), ("jürgen", "male"),
    ("klaus", "male"), ("lars", "male"), ("michael", "male"), ("olaf", "male"), ("peter", "male"),
    ("stefan", "male"), ("thomas", "male"), ("wolfgang", "male"),
]
NAMES_SCHEMA = "first_name string, gender string, source string, ambiguous boolean"


def default_names(spark: SparkSession) -> DataFrame:
    """The built-in names as a table ``(first_name, gender, source, ambiguous)``."""
    return lookup_frame(spark, [(n, g, "dictionary", False) for n, g in COMMON_NAMES], NAMES_SCHEMA)


def ending_gender(name: Column) -> Column:
    """Struct ``(gender, confidence)`` by the ending of a lower-case name, else null."""
    def ends(words: Sequence[str]) -> Column:
        return name.rlike(f"(?:{'|'.join(words)})$")

    def guess(gender: str, confidence: float) -> Column:
        return F.struct(F.lit(gender).alias("gender"), F.lit(confidence).alias("confidence"))

    return (
        F.when(ends(FEMALE_ENDINGS), guess("female", 0.8))
        .when(ends(MALE_ENDINGS), guess("male", 0.8))
        .when(name.endswith("a") & ~ends(["ska", "ka"]), guess("female", 0.65))
        .when(name.endswith("o"), guess("male", 0.65))
    )


def _best_names(names: DataFrame) -> DataFrame:
    prio = F.create_map(*[F.lit(x) for k, (p, _) in SOURCES.items() for x in (k, p)])[F.col("source")]
    conf = F.create_map(*[F.lit(x) for k, (_, c) in SOURCES.items() for x in (k, c)])[F.col("source")]
    amb = F.coalesce(F.col("ambiguous"), F.lit(False)) & (F.col("source") == "dictionary")
    # a name listed as female and male in one source counts as female
    return names.groupBy(F.lower("first_name").alias("_name")).agg(
        F.min_by(
            F.struct("gender", F.when(amb, AMBIGUOUS_CONFIDENCE).otherwise(conf).alias("confidence"), "source"),
            F.struct(prio, F.col("gender")),
        ).alias("_hit")
    )


def detect_gender(df: DataFrame, names: DataFrame, first_name: str = "first_name") -> DataFrame:
    """Add ``gender, confidence, source`` from the first token of a first name.

    The lookup ``names(first_name, gender, source, ambiguous)`` is tried by
    source priority (manual, override, dictionary), then name endings.
    """
    token = F.lower(F.regexp_extract(F.trim(F.coalesce(F.col(first_name), F.lit(""))), r"^\S+", 0))
    joined = df.withColumn("_token", token).join(_best_names(names), F.col("_token") == F.col("_name"), "left")
    ending = ending_gender(F.col("_token"))
    hit = F.col("_hit")
    return joined.select(
        *df.columns,
        F.coalesce(hit["gender"], F.when(F.col("_token") != "", ending["gender"]), F.lit("unknown")).alias("gender"),
        F.coalesce(hit["confidence"], F.when(F.col("_token") != "", ending["confidence"]), F.lit(0.0)).alias("confidence"),
        F.when(F.col("_token") == "", "empty").when(hit.isNotNull(), hit["source"]).when(ending.isNotNull(), "heuristic")
        .otherwise("unknown").alias("source"),
    )


def detector_stats(names: DataFrame) -> DataFrame:
    """Names per source and gender, and the ambiguous ones."""
    return names.groupBy("source", "gender").agg(
        F.count_distinct(F.lower("first_name")).alias("names"), count_if(F.coalesce(F.col("ambiguous"), F.lit(False))).alias("ambiguous")
    )


def add_mapping(names: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Names with manual entries added; they take precedence over every other source."""
    rows = [(k.lower(), v, "manual", False) for k, v in mapping.items()]
    extra = lookup_frame(names.sparkSession, rows, NAMES_SCHEMA)
    older = (F.col("source") == "manual") & F.lower("first_name").isin(*[r[0] for r in rows])
    return names.filter(~older).unionByName(extra)


def unknown_names(detected: DataFrame, known: DataFrame | None = None, first_name: str = "first_name") -> DataFrame:
    """Distinct first names that no source resolves, without those already in ``known(name)``."""
    token = F.lower(F.regexp_extract(F.trim(first_name), r"^\S+", 0))
    found = detected.filter(F.col("source") == "unknown").select(token.alias("name")).distinct()
    return found if known is None else found.join(known.select("name"), "name", "left_anti")


# ---------------------------------------------------------------- analyses over profiles


def _by_gender(profiles: DataFrame, value: str | None, out: str) -> DataFrame:
    agg = F.count(F.lit(1)) if value is None else F.sum(value)
    return profiles.groupBy("gender").agg(agg.alias(out))


def gender_distribution(profiles: DataFrame) -> DataFrame:
    """Speakers per gender."""
    return _by_gender(profiles, None, "speakers")


def gender_distribution_by_party(profiles: DataFrame) -> DataFrame:
    """Speakers per party and gender, with the female share of known genders."""
    male, female = count_if(F.col("gender") == "male"), count_if(F.col("gender") == "female")
    counted = profiles.groupBy("party").agg(
        male.alias("male"), female.alias("female"), count_if(F.col("gender") == "unknown").alias("unknown")
    )
    known = F.col("male") + F.col("female")
    return counted.withColumn("female_ratio", F.col("female") / F.when(known > 0, known))


def gender_ratio_by_party(profiles: DataFrame) -> DataFrame:
    """Parties by female share, those without known genders left out."""
    ratios = gender_distribution_by_party(profiles).filter(F.col("female_ratio").isNotNull())
    return ratios.select("party", "female_ratio").orderBy(F.desc("female_ratio"), F.asc("party"))


def speech_share(profiles: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Percent of speeches per gender, overall or per group; all genders are listed and 0 without speeches."""
    sums = profiles.groupBy(*by).agg(
        *[sum_if(F.col("gender") == g, F.col("total_speeches")).alias(g) for g in GENDERS]
    )
    total = F.col("male") + F.col("female") + F.col("unknown")
    return sums.select(*by, *[ratio(F.col(g), total, 0.0, 100).alias(g) for g in GENDERS])


def top_by_gender(profiles: DataFrame, n: int = 10, formal_only: bool = False) -> DataFrame:
    """Most active speakers of each gender by all or by formal contributions."""
    value = "formal_speeches" if formal_only else "total_speeches"
    source = profiles.select("gender", "speaker", "party", F.col(value).alias("n"))
    return top_k(source, ["gender"], [F.desc("n"), F.asc("speaker")], n)


def speech_length_by_gender(profiles: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean words per speech by gender, overall or per group."""
    sums = profiles.groupBy(*by, "gender").agg(F.sum("total_words").alias("_w"), F.sum("total_speeches").alias("_s"))
    return sums.select(*by, "gender", ratio(F.col("_w"), F.col("_s")).alias("avg_words"))


def words_by_gender(profiles: DataFrame) -> DataFrame:
    """Words per gender."""
    return _by_gender(profiles, "total_words", "words")


def interruption_by_gender(profiles: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Interjections made and received per gender and their ratio (made, if none were received)."""
    sums = profiles.groupBy(*by, "gender").agg(
        F.sum("interruptions_made").alias("made"), F.sum("interruptions_received").alias("received")
    )
    return sums.withColumn(
        "ratio", F.when(F.col("received") > 0, F.col("made") / F.when(F.col("received") > 0, F.col("received"))).otherwise(F.col("made").cast("double"))
    )


def titles_by_gender(profiles: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Share of titled speakers among women and men."""
    known = profiles.filter(F.col("gender") != "unknown")
    titled = F.coalesce(F.col("acad_title"), F.lit("")) != ""
    return known.groupBy(*by, "gender").agg((count_if(titled) / F.count(F.lit(1))).alias("titled_share"))


def question_time_by_gender(profiles: DataFrame) -> DataFrame:
    """Question-time contributions per gender and their share in percent."""
    sums = _by_gender(profiles, "question_speeches", "questions")
    # one row per gender
    total = F.sum("questions").over(Window.partitionBy())
    return sums.withColumn("share", ratio(F.col("questions"), total, 0.0, 100))


def wordiest_by_gender(profiles: DataFrame, n: int = 5) -> DataFrame:
    """Speakers with most words of each gender."""
    source = profiles.select("gender", "speaker", "party", "total_words", "total_speeches")
    return top_k(source, ["gender"], [F.desc("total_words"), F.asc("speaker")], n)


def speaking_time_distribution(profiles: DataFrame) -> DataFrame:
    """All speakers by words."""
    return profiles.select("speaker", "party", "total_words").orderBy(F.desc("total_words"), F.asc("speaker"))


def most_active(profiles: DataFrame, n: int = 10, min_speeches: int = 1) -> DataFrame:
    """Speakers with most formal speeches and their mean words."""
    source = profiles.filter(F.col("formal_speeches") >= min_speeches).select("speaker", "party", "formal_speeches", "avg_words")
    return top_k(source, [], [F.desc("formal_speeches"), F.asc("speaker")], n)


def verbose_by_gender(profiles: DataFrame, n: int = 5, min_speeches: int = 3) -> DataFrame:
    """Speakers of each gender by mean words per contribution."""
    source = profiles.filter(F.col("total_speeches") >= min_speeches).select("gender", "speaker", "party", "avg_words", "total_speeches")
    return top_k(source, ["gender"], [F.desc("avg_words"), F.asc("speaker")], n)


def profile_lookup(profiles: DataFrame, name: str) -> DataFrame:
    """The profile of one speaker."""
    return profiles.filter(F.col("speaker") == name)


def by_party_and_gender(profiles: DataFrame, party: str, gender: str) -> DataFrame:
    """Profiles of one party and gender."""
    return profiles.filter((F.col("party") == party) & (F.col("gender") == gender))


def has_profiles(profiles: DataFrame) -> bool:
    """Whether there are any profiles (reads at most one row)."""
    return not profiles.isEmpty()


def gender_report(profiles: DataFrame) -> DataFrame:
    """Long report ``(section, party, gender, value)``: distribution, female share, interruptions, lengths, titles.

    Percentages have one decimal.
    """
    nul = F.lit(None).cast("string")

    def rows(df: DataFrame, section: str, party: Column, gender: Column, value: Column) -> DataFrame:
        return df.select(F.lit(section).alias("section"), party.alias("party"), gender.alias("gender"), value.cast("double").alias("value"))

    dist = gender_distribution(profiles)
    by_party = gender_distribution_by_party(profiles)
    inter = interruption_by_gender(profiles)
    totals = by_party.agg(F.sum("male").alias("m"), F.sum("female").alias("f"))
    share = F.round(ratio(F.col("f"), F.col("m") + F.col("f"), 0.0, 100), 1)
    parts = [
        rows(dist, "speakers", nul, F.col("gender"), F.col("speakers")),
        rows(totals, "female_percent", nul, nul, share),
        rows(by_party, "female_percent", F.col("party"), nul, F.round(F.coalesce(F.col("female_ratio"), F.lit(0.0)) * 100, 1)),
        rows(inter, "interruptions_made", nul, F.col("gender"), F.col("made")),
        rows(inter, "interruptions_received", nul, F.col("gender"), F.col("received")),
        rows(speech_length_by_gender(profiles), "speech_length", nul, F.col("gender"), F.col("avg_words")),
        rows(titles_by_gender(profiles), "titled_share", nul, F.col("gender"), F.col("titled_share")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
