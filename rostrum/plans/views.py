"""Views over the given tables, in Spark and as SQL text for the oracles.

``corpus_docs`` treats ``documents`` as speeches (group = language, speaker =
language/source). ``transcripts`` writes each sitting of ``conversations`` as a
protocol text with headers, openings, chair lines and annotations.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rostrum.functions.text import word_count
from rostrum.operators.common import lookup_frame
from rostrum.operators.transcript import parse_protocols
from rostrum.session import materialize

PARSE_MIN_WORDS = 60

# (name in the officials table, group)
OFFICIALS = [("Dora Lindner", "SPD"), ("Hanno Vogel", "CDU/CSU")]

USER_HEADERS = [
    "Anna Schmidt (SPD)", "Dr. Bernd Maier (CDU/CSU)", "Clara Kraft (BÜNDNIS 90/DIE GRÜNEN)", "Kraft (GRÜNE)", "Ida Anders (Gruppe)",
]
ASSISTANT_HEADERS = [
    "Dora Lindner, Bundesministerin der Finanzen", "Emil Hauser (AfD)", "Frida Sommer, Bundesministerin für Verkehr",
    "Dr. Hanno Vogel, Bundeskanzler", "Gustav Winter (DIE LINKE)", "Anna Schmidt (SPD)",
]
OPENINGS = [
    "Sehr geehrte Frau Präsidentin! ", "Ich habe eine Frage. ", "Ja, so war es. ", "Ich komme zum Schluss. ", "", "Vielen Dank für die Frage. ",
    "Meine Damen und Herren! ",
]
# a line like a header that begins no speech, and a note whose name is none
HEADING = "\nFrage des Abgeordneten Max Muster (SPD):\nWie geht es weiter?"
NOISE_NOTE = " (Heiterkeit Anna [SPD]: Ha!)"
# (interrupter, group as written, normalised group, text, sentiment)
INTERJECTIONS = [
    ("Clara Kraft", "GRÜNE", "GRÜNE", "Unsinn!", "negative"),
    ("Abg. Emil Hauser", "AfD", "AfD", "Sehr richtig!", "positive"),
    ("Jens Krug", "Gruppe X", "Gruppe X", "Wo denn?", "neutral"),
    ("Dr. Bernd Maier", "CDU/CSU", "CDU/CSU", "Das stimmt nicht!", "positive"),
    ("Anna Schmidt", "SPD", "SPD", "Quatsch!", "negative"),
]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _pick(values: list[str], index):
    out = F.when(F.lit(False), F.lit(""))
    for i, v in enumerate(values):
        out = out.when(index == i, F.lit(v))
    return out


def corpus_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents")
    i = F.col("doc_id")
    kind = (
        F.when(i % 7 == 0, "fragestunde").when(i % 5 == 0, "befragung").when(i % 3 == 0, "zwischenfrage").otherwise("rede")
    )
    return d.select(
        i.alias("speech_id"),
        F.col("lang").alias("party"),
        F.concat_ws("/", "lang", "source").alias("speaker"),
        "text",
        word_count(F.col("text")).alias("words"),
        kind.alias("type"),
        F.when(kind == "rede", "rede").otherwise("wortbeitrag").alias("category"),
        F.when(i % 11 == 0, F.lit("Dr")).alias("acad_title"),
    )


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as contributions: header, opening, chair line, annotations."""
    c = read(spark, sf_dir, "conversations")
    conv, turn = F.col("conv_id"), F.col("turn")
    user = _pick(USER_HEADERS, (conv + turn) % len(USER_HEADERS))
    assistant = _pick(ASSISTANT_HEADERS, (conv * 3 + turn) % len(ASSISTANT_HEADERS))
    header = F.when(F.col("role") == "system", F.lit("Präsidentin Julia Weber")).when(F.col("role") == "user", user).otherwise(assistant)
    chair = (
        F.when((turn == 0) & (conv % 3 == 0), F.lit("\nPräsidentin Julia Weber:\nIch rufe auf: Befragung der Bundesregierung.\n"))
        .when((turn == 4) & (conv % 3 == 0), F.lit("\nPräsidentin Julia Weber:\nDamit beende ich die Befragung.\n"))
        .when(turn % 2 == 0, F.lit("\nPräsidentin Julia Weber:\nDas Wort hat der nächste Redner.\n"))
        .otherwise(F.lit(""))
    )
    heckler = _pick([f" ({n} [{p}]: {t})" for n, p, _, t, _ in INTERJECTIONS], (conv + turn) % len(INTERJECTIONS))
    notes = F.concat(
        F.when(turn % 3 == 0, F.lit(" (Beifall bei der SPD und der AfD)")).otherwise(F.lit("")),
        F.when(turn % 2 == 1, heckler).otherwise(F.lit("")),
        F.when(turn % 4 == 1, F.lit(" (Zuruf von der AfD)")).otherwise(F.lit("")),
        F.when(turn % 4 == 2, F.lit(" (Zurufe vom BÜNDNIS 90/DIE GRÜNEN: Oh!)")).otherwise(F.lit("")),
        F.when(turn % 5 == 4, F.lit(NOISE_NOTE)).otherwise(F.lit("")),
        F.when(turn % 5 == 3, F.lit(HEADING)).otherwise(F.lit("")),
    )
    body = F.replace(F.translate(F.col("text"), "()[]", "    "), F.lit("\n"), F.lit("  "))
    return c.select(
        conv.alias("protocol_id"),
        "turn",
        "role",
        F.concat(
            chair, F.lit("\n"), header, F.lit(":\n"), _pick(OPENINGS, (conv + turn) % len(OPENINGS)), body, notes, F.lit("\n")
        ).alias("part"),
    )


def transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One protocol per conversation, whole."""
    parts = turns(spark, sf_dir)
    return parts.groupBy("protocol_id").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("turn", "part"))), lambda p: p["part"]), ""
        ).alias("full_text")
    )


def officials(spark: SparkSession) -> DataFrame:
    return lookup_frame(spark, OFFICIALS, "name string, party string")


def speeches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_protocols(transcripts(spark, sf_dir), officials(spark), min_words=PARSE_MIN_WORDS)


# ---------------------------------------------------------------- fixture lexicon, names, criteria

# (scheme, category, word, weight): frequent words of the tables; one word in two categories, some absent words
LEXICON = [
    ("adjective", "affirmative", "that", 1.0), ("adjective", "affirmative", "pour", 1.0), ("adjective", "critical", "with", 1.0),
    ("adjective", "critical", "from", 1.0), ("adjective", "aggressive", "this", 1.0), ("adjective", "labeling", "than", 1.0),
    ("adjective", "labeling", "from", 1.0), ("adjective", "affirmative", "sich", 1.0),
    ("verb", "solution", "from", 1.0), ("verb", "problem", "tion", 1.0), ("verb", "collaborative", "ther", 1.0),
    ("verb", "confrontational", "zzzz", 1.0), ("verb", "demanding", "thth", 1.0), ("verb", "acknowledging", "sich", 1.0),
    ("modal", "obligation", "that", 1.0), ("modal", "possibility", "this", 1.0),
    ("temporal", "retrospective", "with", 1.0), ("temporal", "prospective", "from", 1.0),
    ("intensity", "intensifier", "than", 1.0), ("intensity", "moderator", "pour", 1.0),
    ("pronoun", "inclusive", "sich", 1.0), ("pronoun", "exclusive", "tion", 1.0),
    ("discriminatory", "dog_whistle", "thth", 1.0), ("discriminatory", "xenophobic", "zzzz", 1.0),
    ("topic", "migration", "that", 1.0), ("topic", "klima", "with", 1.0), ("topic", "wirtschaft", "pour", 1.0),
    ("topic", "soziales", "tion", 1.0), ("topic", "soziales", "that", 1.0), ("topic", "sicherheit", "sich", 1.0),
    ("topic", "europa", "this", 1.0), ("topic", "digital", "ther", 1.0),
]
# (word, topic, weight)
MULTI_LABEL = [
    ("that", "migration", 0.6), ("that", "sicherheit", 0.4), ("sich", "klima", 0.5), ("sich", "europa", 0.5), ("pour", "arbeit", 1.0),
]
TOPIC_LIST = ["migration", "klima", "wirtschaft", "soziales", "sicherheit", "europa", "digital", "justiz"]

# (first name, gender, source, ambiguous)
NAMES = [
    ("anna", "female", "dictionary", False), ("bernd", "male", "dictionary", False), ("clara", "female", "dictionary", False),
    ("dora", "female", "dictionary", True), ("emil", "male", "override", False), ("gustav", "male", "manual", False),
    ("gustav", "female", "dictionary", False),
]

# archetype, metric, weight, scale, minimum, inverse
CRITERIA = [
    ("reader", "total_words", 0.5, 20000.0, None, False), ("reader", "avg_words", 0.5, 400.0, None, False),
    ("sprinter", "avg_words", 0.7, 500.0, None, True), ("sprinter", "speeches", 0.3, 8.0, 2.0, False),
    ("regular", "speeches", 0.5, 10.0, None, False), ("regular", "max_words", 0.5, 2000.0, 100.0, False),
    ("steady", "min_words", 0.6, 50.0, None, False), ("steady", "total_words", 0.4, 8000.0, None, True),
]


def lexicon(spark: SparkSession) -> DataFrame:
    from rostrum.operators.lexicon import build_lexicon

    return build_lexicon(spark, LEXICON)


def names(spark: SparkSession) -> DataFrame:
    return lookup_frame(spark, NAMES, "first_name string, gender string, source string, ambiguous boolean")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rostrum.operators.interjections import extract_interjections

    return extract_interjections(speeches(spark, sf_dir))


def compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parsed speeches without texts, kept on reliable storage: parsing runs once however many operators read them."""
    from rostrum.operators.interjections import compact_speeches

    return materialize(compact_speeches(speeches(spark, sf_dir)))


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merged speaker profiles of the transcripts."""
    from rostrum.operators.activity import merge_partial_profiles, speaker_profiles
    from rostrum.operators.attributes import detect_gender
    from rostrum.operators.interjections import extract_interjections

    sp = compact(spark, sf_dir)
    raw = speaker_profiles(sp, extract_interjections(sp), lambda df: detect_gender(df, names(spark)))
    return merge_partial_profiles(raw)
