"""Keyword sentiment of interjections."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Keywords that mark agreement.
POSITIVE_KEYWORDS = [
    "genau", "richtig", "sehr richtig", "bravo", "sehr wahr",
    "stimmt", "jawohl", "jawoll", "sehr gut", "eben", "so ist es",
    "oh ja", "prima", "völlig richtig", "ganz genau",
    "ausgezeichnet", "wunderbar", "großartig",
    "ja!", "doch!", "korrekt!", "natürlich!", "absolut!",
    "na klar", "ja, klar", "gut so", "schön!",
    "guter mann", "gute frau", "gute rede",
    "so sieht es aus", "so sieht's aus", "zu recht",
    "da hat sie recht", "da hat er recht", "das ist auch gut so",
    "allerdings!", "bingo!", "na also", "wow!",
    "danke schön", "danke!", "interessant!",
    "gott sei dank", "so ist das!",
]

# Keywords that mark criticism.
NEGATIVE_KEYWORDS = [
    "unsinn", "quatsch", "blödsinn", "falsch", "stimmt nicht",
    "lüge", "unverschämt", "peinlich", "skandal", "unfassbar",
    "unglaublich", "witz", "lachhaft", "absurd", "nonsens",
    "schwachsinn", "irrsinn", "wahnsinn", "frechheit", "lächerlich",
    "stimmt doch nicht", "stimmt gar nicht", "das ist nicht wahr",
    "nein", "niemals", "auf keinen fall", "pfui", "schämen",
    "hört! hört!", "aha!", "ach was!",
    "das glauben sie doch selber nicht", "um gottes willen",
    "mein gott", "o mein gott", "ach gott", "meine güte",
    "sie haben es nicht verstanden", "das ist die unwahrheit",
    "thema verfehlt", "na, na, na", "überhaupt nicht",
    "im gegenteil", "besser nicht", "so ein unfug", "schande",
    "verschwörungstheorien", "das geht nicht", "langweilig",
    "träum weiter", "schön wär's",
    "nee!", "oje!", "eijeijei!", "zur sache!",
    "was reden sie denn da", "damit kennen sie sich ja aus",
    "entschuldigen sie sich", "wie bitte?",
]


def _alternation(words: Sequence[str], whole_words: bool) -> str:
    # longest first, so that with whole words the more specific phrase is tried first
    body = "|".join(re.escape(w) for w in sorted(words, key=len, reverse=True))
    return rf"(?<![\p{{L}}\p{{N}}])(?:{body})(?![\p{{L}}\p{{N}}])" if whole_words else f"(?:{body})"


def annotation_content(c: Column) -> Column:
    """Text after the first colon without the closing parentheses; null when there is no colon."""
    after = F.substring(c, F.instr(c, ":") + 1, F.length(c))
    return F.when(F.instr(c, ":") > 0, F.regexp_replace(after, r"\)+$", ""))


def classify_sentiment(
    c: Column,
    positive: Sequence[str] = POSITIVE_KEYWORDS,
    negative: Sequence[str] = NEGATIVE_KEYWORDS,
    match: str = "substring",
) -> Column:
    """``positive`` if any positive keyword occurs, else ``negative`` if any negative one does, else ``neutral``.

    ``match="word"`` counts whole words only (a keyword inside a longer word is ignored).
    """
    content = F.lower(annotation_content(c))
    whole = match == "word"
    return (
        F.when(content.rlike(_alternation(positive, whole)), F.lit("positive"))
        .when(content.rlike(_alternation(negative, whole)), F.lit("negative"))
        .otherwise(F.lit("neutral"))
    )
