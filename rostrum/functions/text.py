"""String functions on columns (all built-in Spark expressions)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Whitespace as Unicode text sees it (Java's \s alone covers ASCII only).
WS = r"\s\x0B\p{Z}\x85\x1C-\x1F"

# Titles and name particles that are not part of a first or last name.
NAME_TITLES = [
    "Dr", "Prof", "Frau", "D", "-Ing",
    "von", "und", "zu", "van", "de",
    "Baron", "Freiherr", "Freifrau", "Prinz", "Graf",
    "h", "c",
]

# Letters with a diacritic and the plain letter each one decomposes to.
_ACCENTED = "àáâãåçèéêëìíîïñòóôõùúûýÿāăąćĉčďēĕęěĝğġģĥĩīĭįĵķĺļľńņňōŏőŕŗřśŝşšţťũūŭůűųŵŷźżžơưǎǐǒǔșț"
_PLAIN = "aaaaaceeeeiiiinoooouuuyyaaacccdeeeegggghiiiijklllnnnooorrrssssttuuuuuuwyzzzouaioust"


def clean_text(c: Column) -> Column:
    """Special spaces become spaces, long dashes ``-``; runs of tabs and spaces collapse; newlines stay."""
    spaces = F.translate(c, "\u00a0\u2007\u202f\u2060\u2014\u2013", "    --")
    return F.regexp_replace(spaces, "[\t ]+", " ")


def collapse_ws(c: Column) -> Column:
    """Runs of whitespace become one space; ends are trimmed."""
    return F.trim(F.regexp_replace(c, f"[{WS}]+", " "))


def strip_parentheses(c: Column) -> Column:
    """Delete ``(...)`` spans up to the first closing parenthesis, then collapse whitespace."""
    return collapse_ws(F.regexp_replace(c, r"\([^)]+\)", ""))


def word_count(c: Column) -> Column:
    """Number of whitespace-separated words."""
    return F.regexp_count(c, F.lit(f"[^{WS}]+")).cast("long")


def name_parts(c: Column, titles: Sequence[str] = NAME_TITLES) -> Column:
    """Struct ``(first_name, last_name, acad_title)``: titles are set aside, the last token is the last name."""
    letters = collapse_ws(F.regexp_replace(c, r"[^a-zA-ZÀ-ÿÖÄÜäöüßğşçıİ\-" + WS + "]", " "))
    tokens = F.filter(F.split(letters, " "), lambda t: t != "")
    names = F.filter(tokens, lambda t: ~t.isin(*titles))
    found = F.filter(tokens, lambda t: t.isin(*titles))
    n = F.size(names)
    return F.struct(
        F.when(n > 1, F.array_join(F.slice(names, F.lit(1), n - 1), " ")).otherwise("").alias("first_name"),
        F.when(n > 0, F.element_at(names, -1)).otherwise("").alias("last_name"),
        F.when(F.size(found) > 0, F.array_join(found, " ")).alias("acad_title"),
    )


def match_name_key(c: Column) -> Column:
    """Comparison key of a name: without ``Dr``/``Prof``, single spaces, lower case."""
    return F.lower(collapse_ws(F.regexp_replace(F.coalesce(c, F.lit("")), r"\b(Dr\.?|Prof\.?)[" + WS + "]*", "")))


def last_name_key(c: Column) -> Column:
    """Lower-case last token after removing ``Dr.`` and ``Prof.``."""
    bare = collapse_ws(F.replace(F.replace(c, F.lit("Dr."), F.lit("")), F.lit("Prof."), F.lit("")))
    return F.lower(F.element_at(F.split(bare, " "), -1))


def slug(c: Column) -> Column:
    """URL form of a name: titles dropped, ``Last, First`` turned round, umlauts spelled out, accents removed."""
    bare = F.trim(F.regexp_replace(c, r"\b(Dr\.|Prof\.|Dr\s|Prof\s)\s*", ""))
    parts = F.split(bare, ",")
    turned = F.when(F.size(parts) == 2, F.concat(F.trim(parts[1]), F.lit(" "), F.trim(parts[0]))).otherwise(bare)
    out = F.lower(turned)
    for old, new in (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ß", "ss")):
        out = F.replace(out, F.lit(old), F.lit(new))
    out = F.translate(out, _ACCENTED, _PLAIN)
    out = F.regexp_replace(out, "[\\u0300-\\u036f]", "")
    return F.regexp_replace(F.regexp_replace(out, "[^a-z0-9]+", "-"), "^-+|-+$", "")


def resolve_slug_collisions(df: DataFrame, slug_col: str = "slug", suffix_col: str = "party") -> DataFrame:
    """Append the slug of ``suffix_col`` to every slug that several rows share.

    Shared slugs are found by an aggregate and an equi join, so a slug held by
    very many rows is not gathered in one window.
    """
    shared = df.groupBy(slug_col).count().filter(F.col("count") > 1).select(slug_col, F.lit(True).alias("_shared"))
    joined = df.join(shared, slug_col, "left")
    resolved = F.when(F.col("_shared"), F.concat_ws("-", F.col(slug_col), slug(F.col(suffix_col)))).otherwise(F.col(slug_col))
    return joined.withColumn(slug_col, resolved).drop("_shared").select(*df.columns)


def preview(c: Column, n: int = 150) -> Column:
    """First ``n`` characters on one line, with ``...`` where text was left out."""
    head = F.trim(F.replace(F.substring(c, 1, n), F.lit("\n"), F.lit(" ")))
    return F.when(F.length(c) > n, F.concat(head, F.lit("..."))).otherwise(head)


def tokenize(c: Column, min_len: int = 4, letters: str = "a-zäöüß") -> Column:
    """Lower-case word tokens: whole runs of word characters made of ``letters`` only, at least ``min_len`` long."""
    edge = r"[\p{L}\p{N}_]"
    pattern = f"(?<!{edge})[{letters}]{{{min_len},}}(?!{edge})"
    return F.regexp_extract_all(F.lower(c), F.lit(pattern), F.lit(0))


def is_valid_word(c: Column, stopwords: Sequence[str] = ()) -> Column:
    """At least 3 characters, no digit, not starting with ``-``, not a stopword."""
    ok = (F.length(c) >= 3) & ~c.rlike(r"\p{Nd}") & ~c.startswith("-")
    return ok & ~c.isin(*stopwords) if stopwords else ok


def count_occurrences(c: Column, needle: str) -> Column:
    """Non-overlapping occurrences of ``needle`` in the lower-cased text."""
    low = F.lower(c)
    gone = F.length(low) - F.length(F.replace(low, F.lit(needle.lower()), F.lit("")))
    return (gone / F.lit(len(needle))).cast("long")


def strip_honorific(c: Column) -> Column:
    """Drop a leading ``Abg. `` and collapse whitespace."""
    return collapse_ws(F.regexp_replace(c, r"^Abg\. ", ""))


def derive_category(type_col: Column, category: Column | None = None) -> Column:
    """``rede`` for formal speeches, else ``wortbeitrag``; an existing category is kept."""
    derived = F.when(type_col == "rede", F.lit("rede")).otherwise(F.lit("wortbeitrag"))
    return derived if category is None else F.coalesce(category, derived)


def gendered_title(df: DataFrame, titles: DataFrame, id_col: str = "archetype", gender_col: str = "gender") -> DataFrame:
    """Join ``titles(archetype, title, title_f, title_n)`` and pick the variant for the row's gender."""
    t = titles.select(F.col(titles.columns[0]).alias(id_col), "title", "title_f", "title_n")
    picked = (
        F.when(F.col(gender_col) == "female", F.coalesce("title_f", "title"))
        .when(F.col(gender_col) == "unknown", F.coalesce("title_n", "title"))
        .otherwise(F.col("title"))
    )
    return df.join(t, id_col, "left").withColumn("title", picked).drop("title_f", "title_n")
