"""Party (group) names: normalisation and extraction from annotations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Ordered spellings of group names; the first matching pattern wins.
PARTY_PATTERNS: list[tuple[str, str]] = [
    ("CDU/CSU", r"(?:Gast|-)?(?:\s*C\s*[DSMU]\s*S?[DU]\s*(?:\s*[/,':!.-]?)*\s*(?:\s*C+\s*[DSs]?\s*[UÙ]?\s*)?)(?:-?Hosp\.|-Gast|1)?"),
    ("SPD", r"\s*'?S(?:PD|DP)(?:\.|-Gast)?"),
    ("GRÜNE", r"(?:BÜNDNIS\s*(?:90)?/?(?:\s*D[1I]E)?|Bündnis\s*90/(?:\s*D[1I]E)?)?\s*[GC]R?[UÜ].?\s*[ÑN]EN?(?:/Bündnis 90)?|BÜNDNISSES?\s*90/\s*DIE\s*GR?ÜNEN|Grünen"),
    ("FDP", r"\s*F\.?\s*[PDO][.']?[DP]\.?"),
    ("AfD", r"^AfD$|Alternative für Deutschland"),
    ("DIE LINKE", r"DIE\s*LIN\s?KEN?|LIN\s?KEN|Die Linke"),
    ("BSW", r"^BSW$|Bündnis Sahra Wagenknecht"),
    ("fraktionslos", r"(?:fraktionslos|Parteilos|parteilos)"),
    ("SSW", r"^SSW$"),
    ("PDS", r"(?:Gruppe\s*der\s*)?PDS(?:/(?:LL|Linke Liste))?"),
    ("GB/BHE", r"(?:GB[/-]\s*)?BHE(?:-DG)?"),
    ("DP", r"^DP$"),
    ("KPD", r"^KPD$"),
    ("FVP", r"^FVP$"),
]


# How annotations part, bracket and introduce group names.
AFTER_COLON = r":\s*[^,)]+"
SEPARATOR = r"\s+(?:sowie|und|–|,)\s+"
IN_BRACKETS = r"\[([^\]]+)\]"
AFTER_ARTICLE = r"(?:der|dem|des|bei)\s+(\S+)"


def normalize_party(c: Column, patterns: Sequence[tuple[str, str]] = PARTY_PATTERNS) -> Column:
    """Canonical name of the first pattern found in the trimmed text (case-insensitive), else null."""
    text = F.trim(c)
    out = None
    for name, pattern in patterns:
        found = text.rlike("(?iu)" + pattern)
        out = F.when(found, name) if out is None else out.when(found, name)
    return out


def parties_in_annotation(c: Column, patterns: Sequence[tuple[str, str]] = PARTY_PATTERNS) -> Column:
    """Array of the groups named in a reaction such as ``bei der SPD und Abgeordneten der FDP``.

    The text is split at separators; each part gives at most one group, looked
    for in the whole part, then in ``[...]``, then in the word after an article.
    """
    bare = F.regexp_replace(c, AFTER_COLON, "")
    parts = F.split(bare, SEPARATOR)

    def party_of(part: Column) -> Column:
        return F.coalesce(
            normalize_party(part, patterns),
            normalize_party(F.regexp_extract(part, IN_BRACKETS, 1), patterns),
            normalize_party(F.regexp_extract(part, AFTER_ARTICLE, 1), patterns),
        )

    return F.filter(F.transform(parts, party_of), lambda p: p.isNotNull())


def party_compare_key(c: Column) -> Column:
    """Upper-case comparison key; spellings of two groups are unified and null becomes the empty string."""
    up = F.upper(F.trim(c))
    return (
        F.when(c.isNull() | (c == ""), F.lit(""))
        .when(up.contains("GRÜNE") | up.contains("BÜNDNIS"), F.lit("GRÜNE"))
        .when(up.contains("LINKE"), F.lit("LINKE"))
        .otherwise(up)
    )
