"""Segmentation and classification of transcripts.

Everything that concerns one transcript is computed inside its row with array
expressions: a transcript is cut at its headers, positions are running sums of
piece lengths in time linear in the pieces, and question-and-answer ranges are
small arrays. Parsing is therefore a map over the protocols table and shuffles
no text at all.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rostrum.functions.groups import PARTY_PATTERNS, normalize_party
from rostrum.functions.rules import PRECEDING_RULES, Rule, classify_preceding, classify_start, rule_windows, start_rules
from rostrum.functions.text import clean_text, derive_category, name_parts, strip_parentheses, word_count
from rostrum.operators.common import bound, interval_join, pinned, running

# The three kinds of header line (the line ends with a colon).
SPEAKER_HEADER = r"([A-ZÄÖÜ][^(\n:]{2,60})[^\S\n]*\(([^)\n]+)\):"
PRESIDENT_HEADER = r"(Vizepräsident(?:in)?|Präsident(?:in)?|Alterspräsident(?:in)?|Bundespräsident(?:in)?)[^\S\n]+([A-ZÄÖÜ][^:\n]{2,40}):"
GOVERNMENT_HEADER = (
    r"([A-ZÄÖÜ][^,\n]{2,50}),[^\S\n]*"
    r"(Bundeskanzler(?:in)?|Bundesminister(?:in)?(?:[^\S\n]+[^\n:]{0,60})?"
    r"|Parl\.[^\S\n]*Staatssekretär(?:in)?(?:[^\S\n]+[^\n:]{0,80})?|Staatsminister(?:in)?(?:[^\S\n]+[^\n:]{0,60})?):"
)
QUESTION_HEADING = r"(?iu:frage[ \u00a0]|anfrage )"
_TAIL = r"[^\S\n]*\n"

# Phrases that open and close a question-and-answer session.
SESSION_STARTS = [
    ("befragung", r"(?iu:Befragung der Bundesregierung)"),
    ("befragung", r"(?iu:Regierungsbefragung)"),
    ("fragestunde", r"(?m:(?:^|\n)Fragestunde\s*(?:\n|$))"),
]
SESSION_END = r"(?iu:(?:schließe ich die|beende ich die|Ende der)\s+(?:Befragung|Fragestunde|Regierungsbefragung))"

CONTEXT_CHARS = 600
MIN_CHARS = 50


def _header_pattern() -> str:
    speaker = f"(?!{QUESTION_HEADING}){SPEAKER_HEADER}"
    return rf"\n(?:{GOVERNMENT_HEADER}|{PRESIDENT_HEADER}|{speaker}){_TAIL}"


def _pieces(text: Column, marker: str) -> Column:
    """Cut ``text`` in front of every match of ``marker`` (nothing is removed)."""
    return F.split(text, f"(?={marker})")


def marker_spans(text: Column, marker: str) -> Column:
    """Array of ``(start, end)`` offsets of all matches of ``marker``, in order."""

    def of(pieces: Column) -> Column:
        def spans(starts: Column) -> Column:
            found = F.transform(
                pieces,
                lambda p, i: F.struct(F.get(starts, i).alias("start"), (F.get(starts, i) + F.length(F.regexp_extract(p, f"^(?:{marker})", 0))).alias("end")),
            )
            return F.filter(found, lambda s: s["end"] > s["start"])

        return bound(running(F.transform(pieces, F.length), lambda a, b: a + b, F.lit(0), "int"), spans)

    none = F.expr("cast(array() as array<struct<start:int,end:int>>)")
    return F.when(text.rlike(marker), bound(_pieces(text, marker), of)).otherwise(none)


def with_session_ranges(
    df: DataFrame, text: str, out: str, starts: Sequence[tuple[str, str]] = SESSION_STARTS,
    end: str = SESSION_END, anchored: bool = False,
) -> DataFrame:
    """Add an array of ``(start, ord, end, kind)`` ranges of the text, ordered by start.

    A range runs from a start marker to the end of the next end marker, or to
    the end of the text. ``anchored`` accepts a start phrase only on a line of its own.
    """

    def closed(ord_: int, kind: str, marker: str) -> Column:
        def close(s: Column) -> Column:
            later = F.filter("_ends", lambda e: e["start"] > s["start"])
            stop = F.coalesce(F.get(later, F.lit(0))["end"], F.length(text))
            return F.struct(
                s["start"].alias("start"), F.lit(ord_).alias("ord"), stop.alias("end"), F.lit(kind).alias("kind")
            )

        line = rf"(?m:^{marker}\s*$)" if anchored and kind == "befragung" else marker
        return F.transform(marker_spans(F.col(text), line), close)

    found = [closed(i, kind, marker) for i, (kind, marker) in enumerate(starts)]
    return (
        df.withColumn("_ends", marker_spans(F.col(text), end))
        .withColumn(out, F.array_sort(F.concat(*found)))
        .drop("_ends")
    )


def qa_markers(protocols: DataFrame, key: str = "protocol_id", text: str = "full_text") -> tuple[DataFrame, DataFrame]:
    """Session starts ``(key, start, kind)`` and session ends ``(key, start, end)`` as tables."""
    cleaned = protocols.select(key, clean_text(F.col(text)).alias("_text"))

    def labelled(kind: str, marker: str) -> Column:
        return F.transform(
            marker_spans(F.col("_text"), marker), lambda s: F.struct(s["start"].alias("start"), F.lit(kind).alias("kind"))
        )

    starts = cleaned.select(key, F.inline(F.concat(*[labelled(k, m) for k, m in SESSION_STARTS])))
    ends = cleaned.select(key, F.inline(marker_spans(F.col("_text"), SESSION_END)))
    return starts, ends


def qa_ranges(protocols: DataFrame, key: str = "protocol_id", text: str = "full_text", anchored: bool = False) -> DataFrame:
    """One row per question-and-answer range of each protocol."""
    cleaned = protocols.select(key, clean_text(F.col(text)).alias("_text"))
    return with_session_ranges(cleaned, "_text", "_ranges", anchored=anchored).select(key, F.inline("_ranges")).select(
        key, "start", "end", "kind"
    )


def in_range(points: DataFrame, ranges: DataFrame, key: str, pos: str, id_cols: Sequence[str]) -> DataFrame:
    """For every point in some range, the kind of the range that starts first."""
    hits = interval_join(points, ranges, key, pos, "start", "end")
    return hits.groupBy(*id_cols).agg(F.min_by("kind", F.struct("start", "end", "kind")).alias("kind"))


def segment(protocols: DataFrame, key: str = "protocol_id", text: str = "full_text", anchored: bool = False) -> DataFrame:
    """One row per header (boundary) with its fields, body, offsets and surroundings.

    Offsets count characters of the cleaned text. ``prev_kind`` is the kind of the
    boundary before, ``context`` the text right before the header, ``qa_kind``
    the question-and-answer range the header lies in. Lines such as
    ``Frage des ... (Group):`` are no boundaries. Where a line fits several
    kinds, government wins over president over speaker.
    """
    header = _header_pattern()
    cleaned = protocols.withColumn("_text", clean_text(F.col(text))).drop(text)
    zero = F.struct(F.lit(0).alias("pos"), F.lit("").alias("tail"), F.lit("").alias("header"))

    def after(a: Column, b: Column) -> Column:
        tail = F.right(F.concat(a["tail"], b["tail"]), F.lit(CONTEXT_CHARS))
        return F.struct((a["pos"] + b["pos"]).alias("pos"), tail.alias("tail"), b["header"].alias("header"))

    def cut(pieces: Column) -> Column:
        def numbered(items: Column) -> Column:
            def rows(before: Column) -> Column:
                seg = F.transform(
                    pieces,
                    lambda p, i: F.struct(
                        F.get(before, i)["pos"].alias("start"), F.get(before, i)["tail"].alias("context"), F.get(before, i)["header"].alias("prev_header"),
                        F.get(items, i)["header"].alias("header"), p.alias("piece"),
                    ),
                )
                return F.filter(seg, lambda x: x["header"] != "")

            return bound(running(items, after, zero, "struct<pos:int,tail:string,header:string>"), rows)

        parts = F.transform(
            pieces,
            lambda p: F.struct(F.length(p).alias("pos"), F.right(p, F.lit(CONTEXT_CHARS)).alias("tail"), F.regexp_extract(p, f"^{header}", 0).alias("header")),
        )
        return bound(parts, numbered)

    segs = bound(_pieces(F.col("_text"), header), cut)
    others = [c for c in cleaned.columns if c != "_text"]
    ranged = with_session_ranges(cleaned, "_text", "_ranges", anchored=anchored)
    rows = ranged.select(*others, "_ranges", F.posexplode(segs).alias("ordinal", "s")).select(
        *others, "_ranges", "ordinal", "s.*"
    )

    def kind_of(h: Column) -> Column:
        return (
            F.when(h.rlike(rf"^\n{GOVERNMENT_HEADER}"), F.lit("government"))
            .when(h.rlike(rf"^\n{PRESIDENT_HEADER}"), F.lit("president"))
            .when(h != "", F.lit("speaker"))
        )

    start = F.col("start")
    inside = F.filter("_ranges", lambda r: (r["start"] <= start) & (start < r["end"]))
    kinds = pinned(
        rows, kind=kind_of(F.col("header")), prev_kind=kind_of(F.col("prev_header")), qa_kind=F.get(inside, F.lit(0))["kind"]
    )
    government = F.col("kind") == "government"
    gov, spk = rf"^\n{GOVERNMENT_HEADER}", rf"^\n{SPEAKER_HEADER}"
    speaker = (
        F.when(government, F.regexp_extract("header", gov, 1))
        .when(F.col("kind") == "president", F.regexp_replace(F.col("header"), r"^\n|:\s*\n$", ""))
        .otherwise(F.regexp_extract("header", spk, 1))
    )
    return kinds.select(
        *others, "ordinal", "kind", "prev_kind", F.trim(speaker).alias("speaker"),
        F.when(F.col("kind") == "speaker", F.trim(F.regexp_extract("header", spk, 2))).alias("party_raw"),
        F.when(government, F.trim(F.regexp_extract("header", gov, 2))).alias("role"),
        start.alias("header_start"),
        (start + F.length("header")).alias("start"),
        (start + F.length("piece")).alias("end"),
        F.substring("piece", F.length("header") + 1, F.length("piece")).alias("raw_text"),
        "context", "qa_kind",
    )


def official_party(df: DataFrame, officials: DataFrame, name: str = "speaker", out: str = "official_party") -> DataFrame:
    """Group of an official by exact name, else by the name without a leading title; null if unknown.

    ``officials(name, party)`` holds one row per name; of several the smallest party counts.
    """
    o = officials.groupBy(F.col("name").alias("_name")).agg(F.min("party").alias("_party"))
    bare = F.trim(F.regexp_replace(F.col(name), r"^(?:Dr\.|Prof\.|Dr\s|Prof\s)\s*", ""))
    exact = o.select(F.col("_name").alias("_n1"), F.col("_party").alias("_p1"))
    untitled = o.select(F.col("_name").alias("_n2"), F.col("_party").alias("_p2"))
    return (
        df.join(exact, F.col(name) == F.col("_n1"), "left")
        .join(untitled, bare == F.col("_n2"), "left")
        .withColumn(out, F.coalesce("_p1", "_p2"))
        .drop("_n1", "_p1", "_n2", "_p2")
    )


def resolve_type(min_words: int = 500) -> Column:
    """Type of a contribution from its classified parts; null means the contribution is dropped.

    Reads the columns ``context_type, kind, qa_kind, start_type, prev_kind, words``.
    """
    c = F.col
    introduced = F.coalesce(c("prev_kind") == "president", F.lit(False))
    return (
        F.when(c("context_type").isNotNull(), c("context_type"))
        .when((c("kind") == "government") & (c("qa_kind") == "befragung"), F.lit("befragung"))
        .when((c("kind") == "government") & c("qa_kind").isNotNull(), F.lit("fragestunde_antwort"))
        .when(c("kind") == "government", F.lit("rede"))
        .when(c("start_type") == "continuation", F.lit(None).cast("string"))
        .when(introduced & (c("start_type") == "fragestunde"), F.lit("fragestunde"))
        .when(introduced & (c("start_type") == "rede"), F.lit("rede"))
        .when((c("words") >= min_words) & (c("start_type") == "other"), F.lit("sonstiges"))
        .when(c("words") >= min_words, c("start_type"))
    )


def parse_protocols(
    protocols: DataFrame,
    officials: DataFrame,
    party_patterns: Sequence[tuple[str, str]] = PARTY_PATTERNS,
    rules: Sequence[Rule] | None = None,
    preceding: Sequence[Rule] = PRECEDING_RULES,
    min_words: int = 500,
    min_chars: int = MIN_CHARS,
    key: str = "protocol_id",
    anchored: bool = False,
) -> DataFrame:
    """Speeches of all protocols: segmented, classified, with names, group, text and offsets.

    Presiding officers only delimit speeches. Contributions that are too short,
    belong to no known group or are neither introduced nor long are dropped.
    """
    start = list(start_rules() if rules is None else rules)
    parts = segment(protocols.select(key, "full_text"), key=key, anchored=anchored).filter(F.col("kind") != "president")
    spoken = pinned(
        parts, text=strip_parentheses(F.col("raw_text")), party_spoken=normalize_party(F.col("party_raw"), party_patterns)
    ).filter(F.length("text") >= min_chars)
    grouped = (
        official_party(spoken, officials)
        .withColumn("party", F.when(F.col("kind") == "government", F.col("official_party")).otherwise(F.col("party_spoken")))
        .filter(F.col("party").isNotNull())
    )
    windows = rule_windows(F.col("text"), start)
    read = pinned(
        grouped, words=word_count(F.col("text")), context_type=classify_preceding(F.col("context"), preceding),
        **{f"_w{n}": c for n, c in windows.items()},
    )
    start_type = classify_start(F.col("text"), start, {n: F.col(f"_w{n}") for n in windows})
    typed = (
        pinned(read, start_type=start_type)
        .withColumn("type", resolve_type(min_words))
        .filter(F.col("type").isNotNull())
        .withColumn("_name", name_parts(F.col("speaker")))
    )
    return typed.select(
        key, F.col("ordinal").alias("speech_id"), "speaker", "party", "text", "raw_text", "type",
        derive_category(F.col("type")).alias("category"), "words", "_name.first_name", "_name.last_name", "_name.acad_title",
        (F.col("kind") == "government").alias("is_government"), "role", "start", "end",
    )
