"""Queries over transcripts built from ``conversations``: segmentation, interjections, profiles, gender, matching."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rostrum.functions import rules as ru
from rostrum.functions import text as tx
from rostrum.functions.groups import PARTY_PATTERNS, normalize_party, parties_in_annotation, party_compare_key
from rostrum.operators import activity as ac
from rostrum.operators import attributes as at
from rostrum.operators import interjections as ij
from rostrum.operators import matching as ma
from rostrum.operators import rankings as rk
from rostrum.operators import ruletable as rt
from rostrum.operators import similar as si
from rostrum.operators import transcript as tr
from rostrum.operators.common import forward_asof, lookup_frame
from rostrum.plans import views as v
from rostrum.plans.registry import query
from rostrum.plans.sqltext import _SUMS, decided, div, lit, pick, sql, strip_parens
from rostrum.session import ensure_checkpoint_dir, materialize

# ---------------------------------------------------------------- segmentation


@query("segment_transcripts", sql("""
SELECT protocol_id, ordinal, kind, prev_kind, speaker, CASE WHEN kind = 'government' THEN string_split(header, ', ')[2] END AS role,
  CASE WHEN kind = 'speaker' THEN rtrim(string_split(header, ' (')[2], ')') END AS party_raw, header_start, header_start + header_len AS start,
  header_start + header_len + length(raw_text) AS "end", raw_text, qa_kind FROM bounds
UNION ALL
SELECT protocol_id, ordinal - 1, 'president', lag_kind, 'Präsidentin Julia Weber', NULL, NULL, header_start - chair_len, header_start - chair_len + 26, header_start,
  substring(chair, 27), CASE WHEN conv_id % 3 = 0 AND turn BETWEEN 1 AND 4 THEN 'befragung' END
FROM (SELECT *, lag(kind) OVER (PARTITION BY protocol_id ORDER BY turn) AS lag_kind FROM bounds) WHERE chair <> ''""", "bounds"))
def segment_transcripts(spark, sf):
    return tr.segment(v.transcripts(spark, sf)).drop("context")


@query("parse_protocols", sql("""SELECT protocol_id, speech_id, speaker, party, text, raw_text, type, category, words, first_name, last_name, acad_title, is_government, role, start, "end" FROM ruled_speeches""", "ruled_speeches"))
def parse_protocols(spark, sf):
    return v.speeches(spark, sf)


@query("official_party", sql(f"""
SELECT b.protocol_id, b.ordinal, b.speaker, p.party AS official_party FROM bounds b LEFT JOIN people p ON b.speaker = p.speaker WHERE b.kind = 'government'""", "bounds", "people"))
def official_party(spark, sf):
    parts = tr.segment(v.transcripts(spark, sf)).filter(F.col("kind") == "government").select("protocol_id", "ordinal", "speaker")
    return tr.official_party(parts, v.officials(spark))


_MARKS = """
, offs AS (SELECT protocol_id, conv_id, turn, header_start - chair_len AS chair_start FROM bounds WHERE chair <> ''),
total AS (SELECT protocol_id, max(header_start + header_len + length(raw_text)) AS len FROM bounds GROUP BY ALL),
st AS (SELECT protocol_id, chair_start + 40 AS start, conv_id FROM offs WHERE turn = 0 AND conv_id % 3 = 0),
en AS (SELECT protocol_id, chair_start + 32 AS start, chair_start + 56 AS "end" FROM offs WHERE turn = 4 AND conv_id % 3 = 0),
rng AS (SELECT st.protocol_id, st.start, coalesce(en."end", total.len) AS "end", 'befragung' AS kind FROM st JOIN total ON st.protocol_id = total.protocol_id LEFT JOIN en ON st.protocol_id = en.protocol_id)
"""


@query("qa_ranges", sql(_MARKS + "SELECT protocol_id, start, \"end\", kind FROM rng", "bounds"))
def qa_ranges(spark, sf):
    return tr.qa_ranges(v.transcripts(spark, sf))


@query("forward_asof_ranges", sql(_MARKS + "SELECT protocol_id, start, CASE WHEN e.e IS NOT NULL THEN e.e END AS \"end\", kind FROM rng LEFT JOIN (SELECT protocol_id AS p, \"end\" AS e FROM en) e ON rng.protocol_id = e.p", "bounds"))
def forward_asof_ranges(spark, sf):
    """The ranges from the marker tables by an as-of join; open ranges have no end."""
    starts, ends = tr.qa_markers(v.transcripts(spark, sf))
    return forward_asof(starts, ends, "protocol_id", "start", "start", "end", width=512).select("protocol_id", "start", "end", "kind")


@query("qa_interval_join", sql("SELECT protocol_id, ordinal, qa_kind AS kind FROM bounds WHERE qa_kind IS NOT NULL", "bounds"))
def qa_interval_join(spark, sf):
    t = v.transcripts(spark, sf)
    points = tr.segment(t).filter(~F.col("speaker").startswith("Präsidentin") | (F.col("ordinal") == 1)).select("protocol_id", "ordinal", "kind", "header_start")
    turn_points = points.filter(F.col("kind") != "president").drop("kind")
    system = points.filter(F.col("kind") == "president").drop("kind")
    return tr.in_range(turn_points.unionByName(system), tr.qa_ranges(t), "protocol_id", "header_start", ["protocol_id", "ordinal"])


_OPENED = strip_parens(f"{pick(v.OPENINGS, f'(conv_id + turn) % {len(v.OPENINGS)}')} || translate(text, '()[]', '    ')")


@query("classify_start", f"""
SELECT conv_id, turn, start_type, start_type = 'rede' AS addresses_chair
FROM (SELECT conv_id, turn, {decided('opened')} AS start_type FROM (SELECT conv_id, turn, {_OPENED} AS opened FROM conversations))""")
def classify_start(spark, sf):
    c = v.read(spark, sf, "conversations")
    opening = v._pick(v.OPENINGS, (F.col("conv_id") + F.col("turn")) % len(v.OPENINGS))
    text = tx.strip_parentheses(F.concat(opening, F.translate("text", "()[]", "    ")))
    kind = ru.classify_start(text)
    return c.select("conv_id", "turn", kind.alias("start_type"), (kind == "rede").alias("addresses_chair"))


# literal openings that are placed where prepared statements and short replies are tested: (priority, label, opening)
_LITERALS = [
    (11_100, "abstimmung", "Dem vorliegenden Antrag stimme ich zu"), (11_200, "statement", "Unsere Haltung zu diesem Vorhaben"), (11_200, "statement", "Unsere Haltung"),
    (11_300, "protokoll", "Zu Protokoll gebe ich"), (16_100, "zwischenfrage", "Dazu nur so viel"), (16_050, "statement", "Dazu nur so viel, Herr Nachbar"),
]
# openings, each with the label that the table gives it
_TABLE_OPENINGS = [
    ("Ich habe eine Frage. ", "fragestunde"), ("Danke, dass Sie die Zwischenfrage zulassen. ", "zwischenfrage"), ("- Ich komme zum Schluss. ", "continuation"),
    ("Moment, ich unterbreche kurz. ", "continuation"), ("Nun eine Frage an den Bundesminister. ", "fragestunde"), ("Dazu eine Nachfrage. ", "fragestunde"),
    ("Sehr geehrte Frau Präsidentin! ", "rede"), ("Guten Tag, Frau Ministerin. ", "fragestunde"), ("Werte Gäste, Herr Vizepräsident! ", "rede"), ("Verehrtes Präsidium! ", "rede"),
    ("Liebe Kolleginnen! ", "rede"), ("Dem vorliegenden Antrag stimme ich zu. ", "abstimmung"), ("Unsere Haltung zu diesem Vorhaben ist klar. ", "statement"), ("Unsere Haltung ist klar. ", "statement"),
    ("Zu Protokoll gebe ich: ", "protokoll"), ("Deutschland hat in den vergangenen Jahren viele Ortskräfte geholt. ", "ortskraefte"), ("Wie hoch sieht die Bundesregierung den Bedarf? ", "fragestunde"),
    ("Nein, so nicht. ", "zwischenfrage"), ("Herr Kollege! ", "zwischenfrage"), ("Dazu nur so viel: ", "zwischenfrage"), ("Dazu nur so viel, Herr Nachbar: ", "statement"), ("Vielen Dank, Herr Staatssekretär. ", "fragestunde"),
    ("Danke für die Frage. ", "fragestunde_antwort"), ("Herzlichen Dank, liebes Haus, geschätzter Präsident. ", "rede"), ("Danke schön. ", "zwischenfrage"), ("Meine Damen und Herren! ", "rede"), ("Xyz. ", "other"),
]


@query("classify_by_table", f"SELECT doc_id, {pick([k for _, k in _TABLE_OPENINGS], f'doc_id % {len(_TABLE_OPENINGS)}')} AS label FROM documents")
def classify_by_table(spark, sf):
    """Openings of all documents by a rules file: the built-in decision list, with literal openings of single sittings in between."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/rules-{uuid.uuid4().hex}"
    extra = [(p, label, [{"window": 100, "kind": rt.STARTS, "pattern": o}]) for p, label, o in _LITERALS]
    rt.rule_table(spark, ru.start_rules()).unionByName(lookup_frame(spark, extra, rt.RULE_SCHEMA)).write.json(path)
    d = v.read(spark, sf, "documents")
    text = F.concat(v._pick([o for o, _ in _TABLE_OPENINGS], F.col("doc_id") % len(_TABLE_OPENINGS)), "text")
    return rt.classify_by_table(d.select("doc_id", text.alias("text")), rt.read_rules(spark, path), ["doc_id"])


_INTROS = [
    "Das Wort hat nun die Abgeordnete.", "Ihre Redezeit ist abgelaufen.", "Eine Kurzintervention folgt.", "Gestatten Sie eine Frage?",
    "Es gibt eine Nachfrage.", "Wir kommen zur Fragestunde.", "Guten Morgen.",
]
_INTRO_KINDS = ["formal", "continuation", "kurzintervention", "zwischenfrage", "question", "fragestunde", "other"]


@query("classify_introduction", f"SELECT conv_id, turn, {pick(_INTRO_KINDS, f'(conv_id + turn) % {len(_INTROS)}')} AS introduction FROM conversations")
def classify_introduction(spark, sf):
    c = v.read(spark, sf, "conversations")
    intro = v._pick(_INTROS, (F.col("conv_id") + F.col("turn")) % len(_INTROS))
    return c.select("conv_id", "turn", ru.classify_introduction(F.concat(F.col("text"), F.lit(" "), intro)).alias("introduction"))


_CONTEXTS = ["Ich rufe die Frage 12 auf.", "Die nächste Frage stellt die Kollegin.", "Herr Staatsminister, Sie haben das Wort.", "Das Wort hat die Kollegin."]
_CONTEXT_KINDS = ["fragestunde", "fragestunde", "fragestunde_antwort", None]


@query("classify_preceding", f"SELECT conv_id, turn, {pick(_CONTEXT_KINDS, f'(conv_id + turn) % {len(_CONTEXTS)}')} AS context_type FROM conversations".replace("THEN NULL", "THEN CAST(NULL AS VARCHAR)"))
def classify_preceding(spark, sf):
    c = v.read(spark, sf, "conversations")
    context = F.concat(F.col("text"), F.lit(". "), v._pick(_CONTEXTS, (F.col("conv_id") + F.col("turn")) % len(_CONTEXTS)))
    return c.select("conv_id", "turn", ru.classify_preceding(F.right(context, F.lit(600))).alias("context_type"))


def _party_of(text: str) -> str:
    """SQL of the canonical group of a text: the first spelling found."""
    arms = " ".join(f"WHEN regexp_matches(trim({text}), {lit('(?i)' + pattern)}) THEN {lit(name)}" for name, pattern in PARTY_PATTERNS)
    return f"CASE {arms} END"


_UPPER = "upper(replace(trim({0}), 'ß', 'ss'))"
_COMPARED = f"CASE WHEN {{0}} = '' THEN '' WHEN {_UPPER} LIKE '%GRÜNE%' OR {_UPPER} LIKE '%BÜNDNIS%' THEN 'GRÜNE' WHEN {_UPPER} LIKE '%LINKE%' THEN 'LINKE' ELSE {_UPPER} END"
_SPELLED = r"""
, words AS (SELECT unnest(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS spelled FROM documents
  UNION ALL SELECT unnest(regexp_extract_all(header || spoken, '[(\[]([^)\]]*)[)\]]', 1)) FROM turns),
d AS (SELECT spelled, count(*) AS n FROM words GROUP BY spelled)"""


@query("normalize_party", sql(_SPELLED + f" SELECT spelled, n, {_party_of('spelled')} AS party, {_COMPARED.format('spelled')} AS compare_key FROM d", "turns"))
def normalize_parties(spark, sf):
    """Groups in all words of the documents and in all that stands in brackets in the transcripts."""
    words = v.read(spark, sf, "documents").select(F.explode(F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))).alias("spelled"))
    noted = v.turns(spark, sf).select(F.explode(F.regexp_extract_all("part", F.lit(r"[(\[]([^)\]]*)[)\]]"), F.lit(1))).alias("spelled"))
    spelled = words.unionByName(noted).groupBy("spelled").agg(F.count(F.lit(1)).alias("n"))
    return spelled.select("spelled", "n", normalize_party(F.col("spelled")).alias("party"), party_compare_key(F.col("spelled")).alias("compare_key"))


@query("parties_in_annotation", sql(r"""
, notes AS (SELECT conv_id AS protocol_id, turn, unnest(regexp_extract_all(header || chr(10) || spoken, '\(([^)]*)\)', 1)) AS note FROM turns),
kinds AS (SELECT note, count(*) AS n, string_split_regex(regexp_replace(note, ':\s*[^,)]+', '', 'g'), '\s+(?:sowie|und|–|,)\s+') AS parts FROM notes GROUP BY note),
split AS (SELECT note, n, unnest(parts) AS part, unnest(range(0, len(parts))) AS i FROM kinds),
found AS (SELECT note, n, i, coalesce(""" + ", ".join(_party_of(x) for x in ("part", r"regexp_extract(part, '\[([^\]]+)\]', 1)", r"regexp_extract(part, '(?:der|dem|des|bei)\s+(\S+)', 1)")) + """) AS party FROM split)
SELECT note, n, coalesce(string_agg(party, ',' ORDER BY i), '') AS parties FROM found GROUP BY note, n""", "turns"))
def parties_in_notes(spark, sf):
    """Groups named in every bracketed note of the transcripts."""
    notes = v.turns(spark, sf).select(F.explode(F.regexp_extract_all("part", F.lit(r"\(([^)]*)\)"), F.lit(1))).alias("note"))
    kinds = notes.groupBy("note").agg(F.count(F.lit(1)).alias("n"))
    return kinds.select("note", "n", F.array_join(parties_in_annotation(F.col("note")), ",").alias("parties"))


# ---------------------------------------------------------------- interjections

_BY_NAME = "SELECT from_name AS name, from_party AS party, count(*) FILTER (sentiment = 'positive') AS positive, count(*) FILTER (sentiment = 'negative') AS negative, count(*) FILTER (sentiment = 'neutral') AS neutral FROM ev GROUP BY ALL"


@query("interjections", sql("SELECT protocol_id, speech_id, from_name, from_party, to_name, to_party, content, sentiment FROM ev", "ev"))
def interjections(spark, sf):
    return v.events(spark, sf).drop("raw")


@query("interrupter_counts", sql("SELECT from_name AS name, from_party AS party, count(*) AS n FROM ev GROUP BY ALL", "ev"))
def interrupter_counts(spark, sf):
    return ij.interrupter_counts(v.events(spark, sf))


@query("interrupted_counts", sql("SELECT to_name AS name, to_party AS party, count(*) AS n FROM ev GROUP BY ALL", "ev"))
def interrupted_counts(spark, sf):
    return ij.interrupted_counts(v.events(spark, sf))


@query("cross_group_matrix", sql("SELECT from_party, to_party, count(*) AS n FROM ev GROUP BY ALL", "ev"))
def cross_group_matrix(spark, sf):
    return ij.cross_group_matrix(v.events(spark, sf))


@query("cross_group_totals", sql("SELECT CASE WHEN grouping(from_party) = 1 THEN 'to' WHEN grouping(to_party) = 1 THEN 'from' ELSE 'pair' END AS level, from_party, to_party, count(*) AS n FROM ev GROUP BY GROUPING SETS ((from_party, to_party), (from_party), (to_party))", "ev"))
def cross_group_totals(spark, sf):
    return ij.cross_group_totals(v.events(spark, sf))


@query("cross_group_wide", sql("""
, e AS (SELECT from_party, to_party, count(*) AS n FROM ev GROUP BY ALL)
SELECT f.from_party, string_agg(g.to_party || ':' || coalesce(e.n, 0), ',' ORDER BY g.to_party) AS cells
FROM (SELECT DISTINCT from_party FROM e) f CROSS JOIN (SELECT DISTINCT to_party FROM e WHERE to_party IS NOT NULL) g LEFT JOIN e ON e.from_party IS NOT DISTINCT FROM f.from_party AND e.to_party = g.to_party
GROUP BY f.from_party""", "ev"))
def cross_group_wide(spark, sf):
    """The matrix with a column for every receiving group that occurs, each named beside its cell."""
    wide = ij.cross_group_wide(v.events(spark, sf))
    columns = sorted(c for c in wide.columns if c != "from_party")
    return wide.select("from_party", F.array_join(F.array(*[F.concat_ws(":", F.lit(c), F.col(f"`{c}`").cast("string")) for c in columns]), ",").alias("cells"))


@query("sentiment_counts", sql(_BY_NAME, "ev"))
def sentiment_counts(spark, sf):
    return ij.sentiment_counts(v.events(spark, sf))


@query("neutral_texts", sql("SELECT content, count(*) AS n FROM ev WHERE sentiment = 'neutral' GROUP BY ALL", "ev"))
def neutral_texts(spark, sf):
    return ij.neutral_texts(v.events(spark, sf))


@query("neutral_summary", sql("SELECT count(*) AS total, count(DISTINCT content) AS distinct_texts FROM ev WHERE sentiment = 'neutral'", "ev"))
def neutral_summary(spark, sf):
    return ij.neutral_summary(v.events(spark, sf))


@query("applause_counts", sql("SELECT p AS applauding_party, count(*) AS n FROM speeches, (VALUES ('SPD'), ('AfD')) AS t(p) WHERE turn % 3 = 0 GROUP BY p", "speeches"))
def applause_counts(spark, sf):
    return ij.applause_counts(v.speeches(spark, sf))


@query("heckle_counts", sql("SELECT CASE WHEN turn % 4 = 1 THEN 'AfD' ELSE 'GRÜNE' END AS heckling_party, count(*) AS n FROM speeches WHERE turn % 4 IN (1, 2) GROUP BY ALL", "speeches"))
def heckle_counts(spark, sf):
    return ij.heckle_counts(v.speeches(spark, sf))


@query("heckle_ranking", sql("SELECT from_party AS party, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, from_party) AS rank FROM ev GROUP BY from_party QUALIFY rank <= 10", "ev"))
def heckle_ranking(spark, sf):
    return ij.heckle_ranking(v.events(spark, sf))


@query("sentiment_summary", sql("""
, s AS (SELECT count(*) AS total, count(*) FILTER (sentiment = 'positive') AS positive, count(*) FILTER (sentiment = 'negative') AS negative, count(*) FILTER (sentiment = 'neutral') AS neutral FROM ev)
SELECT *, """ + ", ".join(f"round({div(k, 'total', '0.0', '100')}, 1) AS {k}_percent" for k in ("positive", "negative", "neutral")) + " FROM s", "ev"))
def sentiment_summary(spark, sf):
    return ij.sentiment_summary(v.events(spark, sf))


@query("interruption_report", sql(f"SELECT *, positive + negative + neutral AS n, row_number() OVER (ORDER BY positive + negative + neutral DESC, name, party) AS rank FROM ({_BY_NAME})", "ev"))
def interruption_report(spark, sf):
    return ij.interruption_report(v.events(spark, sf))


@query("interrupted_report", sql("SELECT *, row_number() OVER (ORDER BY n DESC, name, party) AS rank FROM (SELECT to_name AS name, to_party AS party, count(*) AS n FROM ev GROUP BY ALL)", "ev"))
def interrupted_report(spark, sf):
    return ij.interrupted_report(v.events(spark, sf))


_CRITIC = f"SELECT name, party, negative, positive + negative + neutral AS total, negative * sqrt(positive + negative + neutral) AS score, CAST(negative AS DOUBLE) / (positive + negative + neutral) AS negative_rate FROM ({_BY_NAME}) WHERE positive + negative + neutral >= 5 AND negative > 0"


@query("critic_score", sql(_CRITIC, "ev"))
def critic_score(spark, sf):
    return ij.critic_score(v.events(spark, sf), min_total=5)


@query("critic_rate_leader", sql(f"SELECT * FROM ({_CRITIC}) ORDER BY negative_rate DESC, name, party LIMIT 1", "ev"))
def critic_rate_leader(spark, sf):
    return ij.critic_rate_leader(v.events(spark, sf), min_total=5)


# ---------------------------------------------------------------- profiles and gender

_PROFILE_COLS = ["speaker", "party", "first_name", "last_name", "acad_title", *_SUMS]


@query("speaker_profiles", sql(f"SELECT {', '.join(_PROFILE_COLS)} FROM raw_profiles", "raw_profiles"))
def speaker_profiles(spark, sf):
    sp = v.compact(spark, sf)
    raw = ac.speaker_profiles(sp, ij.extract_interjections(sp), lambda df: at.detect_gender(df, v.names(spark)))
    return raw.select(*_PROFILE_COLS)


@query("merge_profiles", sql(f"SELECT {', '.join(_PROFILE_COLS)}, gender, avg_words FROM profiles", "profiles"))
def merge_profiles(spark, sf):
    return v.profiles(spark, sf).select(*_PROFILE_COLS, "gender", "avg_words")


_GS = ["count(*) AS total_speakers"]
for _g in ("male", "female", "unknown"):
    _c = f"(gender = '{_g}')"
    _GS += [f"count(*) FILTER {_c} AS {_g}_speakers", f"CAST(coalesce(sum(total_speeches) FILTER {_c}, 0) AS BIGINT) AS {_g}_speeches", f"CAST(coalesce(sum(total_words) FILTER {_c}, 0) AS BIGINT) AS {_g}_words",
            f"{div(f'sum(total_words) FILTER {_c}', f'(sum(total_speeches) FILTER {_c})')} AS {_g}_avg_length"]
    if _g != "unknown":
        _GS += [f"CAST(coalesce(sum({x}) FILTER {_c}, 0) AS BIGINT) AS {_g}_{x}" for x in ("interruptions_made", "interruptions_received")]
        _GS.append(f"count(*) FILTER (gender = '{_g}' AND acad_title IS NOT NULL) AS {_g}_dr_count")


@query("gender_stats", sql(f"SELECT party, {', '.join(_GS)}, grouping(party) = 1 AS is_total FROM profiles GROUP BY ROLLUP (party)", "profiles"))
def gender_stats(spark, sf):
    return ac.gender_stats(v.profiles(spark, sf))


_FIRSTS = r"""
, f AS (SELECT w[1] AS first_name FROM (SELECT DISTINCT regexp_extract_all(p, '[^\x20\x09-\x0D]+') AS w FROM (SELECT unnest(string_split(coalesce(text, ''), '.')) AS p FROM documents)) WHERE len(w) > 0
  UNION SELECT first_name || ' Otto' FROM speeches UNION SELECT first_name FROM speeches UNION SELECT ''),
k AS (SELECT first_name, lower(regexp_extract(trim(first_name), '^\S+')) AS t FROM f)"""


def _detected(extra: str = "") -> str:
    """SQL of gender, confidence and source of ``t``: the listed names by priority, then endings."""
    ending = lambda words: f"regexp_matches(t, '(?:{'|'.join(words)})$')"
    arms = [(extra, "female", 1.0, "manual")] if extra else []
    arms += [("t = 'gustav'", "male", 1.0, "manual"), ("t = 'emil'", "male", 0.9, "override"), ("t IN ('anna', 'clara')", "female", 0.95, "dictionary"), ("t = 'bernd'", "male", 0.95, "dictionary"),
             ("t = 'dora'", "female", 0.7, "dictionary"), ("t = ''", "unknown", 0.0, "empty"), (ending(at.FEMALE_ENDINGS), "female", 0.8, "heuristic"), (ending(at.MALE_ENDINGS), "male", 0.8, "heuristic"),
             ("ends_with(t, 'a') AND NOT ends_with(t, 'ka')", "female", 0.65, "heuristic"), ("ends_with(t, 'o')", "male", 0.65, "heuristic")]
    pieces = [" ".join(f"WHEN {c} THEN {lit(x)}" for c, *x_ in arms for x in [x_[i]]) for i in range(3)]
    return f"CASE {pieces[0]} ELSE 'unknown' END AS gender, CASE {pieces[1]} ELSE CAST(0.0 AS DOUBLE) END AS confidence, CASE {pieces[2]} ELSE 'unknown' END AS source"


def _first_names(spark, sf) -> DataFrame:
    """First words of all sentences of the documents, and first names of the speakers, some with a second name."""
    pieces = v.read(spark, sf, "documents").select(F.explode(F.split(F.coalesce("text", F.lit("")), r"\.")).alias("p"))
    words = pieces.select(F.regexp_extract("p", r"[^\x20\x09-\x0D]+", 0).alias("first_name")).filter("first_name <> ''")
    speakers = v.speeches(spark, sf).select("first_name").distinct()
    both = words.unionByName(speakers).unionByName(speakers.select(F.concat("first_name", F.lit(" Otto")).alias("first_name"))).unionByName(lookup_frame(spark, [("",)], "first_name string"))
    return both.distinct()


@query("detect_gender", sql(_FIRSTS + f" SELECT first_name, {_detected()} FROM k", "speeches"))
def detect_gender(spark, sf):
    return at.detect_gender(_first_names(spark, sf), v.names(spark))


@query("unknown_names", sql(_FIRSTS + f" SELECT DISTINCT t AS name FROM (SELECT t, {_detected()} FROM k) WHERE source = 'unknown' AND t NOT IN (SELECT lower(text[1:3]) FROM documents)", "speeches"))
def unknown_names(spark, sf):
    """First names that no source resolves, without those that are on file already."""
    known = v.read(spark, sf, "documents").select(F.lower(F.substring("text", 1, 3)).alias("name")).distinct()
    return at.unknown_names(at.detect_gender(_first_names(spark, sf), v.names(spark)), known)


@query("add_mapping", sql(_FIRSTS + f" SELECT first_name, {_detected(extra="t IN ('the', 'bernd')")} FROM k", "speeches"))
def add_mapping(spark, sf):
    """The same with manual entries, one against the dictionary."""
    extended = at.add_mapping(v.names(spark), {"The": "female", "Bernd": "female"})
    return at.detect_gender(_first_names(spark, sf), extended)


@query("detector_stats", "SELECT 'dictionary' AS source, CASE WHEN n_nationkey % 3 = 0 THEN 'female' ELSE 'male' END AS gender, count(DISTINCT lower(n_name)) AS names, count(*) FILTER (n_nationkey % 4 = 0) AS ambiguous FROM nation GROUP BY ALL UNION ALL SELECT 'manual', 'female', count(*), 0 FROM region")
def detector_stats(spark, sf):
    """Counts of a name table made of the nations, with the regions as manual entries."""
    k = F.col("n_nationkey")
    names = v.read(spark, sf, "nation").select(F.col("n_name").alias("first_name"), F.when(k % 3 == 0, "female").otherwise("male").alias("gender"), F.lit("dictionary").alias("source"), (k % 4 == 0).alias("ambiguous"))
    manual = v.read(spark, sf, "region").select(F.col("r_name").alias("first_name"), F.lit("female").alias("gender"), F.lit("manual").alias("source"), F.lit(None).cast("boolean").alias("ambiguous"))
    return at.detector_stats(names.unionByName(manual))


def _g(name: str, body: str):
    return query(name, sql(body, "profiles"))


@_g("gender_facts", """
, p AS (SELECT party, count(*) FILTER (gender = 'female') AS f, count(*) FILTER (gender IN ('female', 'male')) AS k FROM profiles GROUP BY party HAVING k > 0),
m AS (SELECT coalesce(sum(interruptions_made) FILTER (gender = 'male'), 0) AS m, coalesce(sum(interruptions_made) FILTER (gender = 'female'), 0) AS f FROM profiles)
SELECT 'female_percent' AS fact, CAST(NULL AS VARCHAR) AS party, CAST(NULL AS VARCHAR) AS other, CAST(NULL AS VARCHAR) AS item, CAST(sum(f) AS DOUBLE) / sum(k) * 100 AS value FROM p HAVING sum(k) > 0
UNION ALL SELECT * FROM (SELECT 'most_female', party, NULL, NULL, CAST(f AS DOUBLE) / k * 100 FROM p ORDER BY CAST(f AS DOUBLE) / k DESC, party LIMIT 1)
UNION ALL SELECT * FROM (SELECT 'top_woman', party, NULL, string_split(speaker, ' ')[-1], CAST(total_speeches AS DOUBLE) FROM profiles WHERE gender = 'female' ORDER BY total_speeches DESC, speaker, party LIMIT 1)
UNION ALL SELECT 'men_interrupt', NULL, NULL, NULL, CAST(m AS DOUBLE) / f FROM m WHERE m > 0 AND f > 0""")
def gender_facts(spark, sf):
    return ac.gender_facts(v.profiles(spark, sf))


@_g("has_profiles", "SELECT 'SPD' AS party, count(*) > 0 AS present FROM profiles WHERE party = 'SPD' UNION ALL SELECT 'nobody', false")
def has_profiles(spark, sf):
    """Whether there are profiles of a party, and of one that does not occur."""
    p = v.profiles(spark, sf)
    return lookup_frame(spark, [(party, at.has_profiles(p.filter(F.col("party") == party))) for party in ("SPD", "nobody")], "party string, present boolean")


@_g("gender_distribution", "SELECT gender, count(*) AS speakers FROM profiles GROUP BY gender")
def gender_distribution(spark, sf):
    return at.gender_distribution(v.profiles(spark, sf))


_DIST = "SELECT party, count(*) FILTER (gender = 'male') AS male, count(*) FILTER (gender = 'female') AS female, count(*) FILTER (gender = 'unknown') AS unknown, CAST(count(*) FILTER (gender = 'female') AS DOUBLE) / NULLIF(count(*) FILTER (gender <> 'unknown'), 0) AS female_ratio FROM profiles GROUP BY party"


@_g("gender_distribution_by_party", _DIST)
def gender_distribution_by_party(spark, sf):
    return at.gender_distribution_by_party(v.profiles(spark, sf))


@_g("gender_ratio_by_party", f"SELECT party, female_ratio FROM ({_DIST}) WHERE female_ratio IS NOT NULL")
def gender_ratio_by_party(spark, sf):
    return at.gender_ratio_by_party(v.profiles(spark, sf))


_SHARE = ", ".join(div(f"coalesce(sum(total_speeches) FILTER (gender = '{g}'), 0)", "sum(total_speeches)", "0.0", "100") + f" AS {g}" for g in at.GENDERS)


@_g("speech_share", f"SELECT {_SHARE} FROM profiles")
def speech_share(spark, sf):
    return at.speech_share(v.profiles(spark, sf))


@_g("speech_share_by_party", f"SELECT party, {_SHARE} FROM profiles GROUP BY party")
def speech_share_by_party(spark, sf):
    return at.speech_share(v.profiles(spark, sf), ["party"])


@_g("top_by_gender", "SELECT gender, speaker, party, total_speeches AS n, row_number() OVER (PARTITION BY gender ORDER BY total_speeches DESC, speaker) AS rank FROM profiles QUALIFY rank <= 3")
def top_by_gender(spark, sf):
    return at.top_by_gender(v.profiles(spark, sf), 3)


@_g("top_by_gender_formal", "SELECT gender, speaker, party, formal_speeches AS n, row_number() OVER (PARTITION BY gender ORDER BY formal_speeches DESC, speaker) AS rank FROM profiles QUALIFY rank <= 3")
def top_by_gender_formal(spark, sf):
    return at.top_by_gender(v.profiles(spark, sf), 3, formal_only=True)


@_g("gender_lengths", f"SELECT gender, {div('sum(total_words)', 'sum(total_speeches)')} AS avg_words FROM profiles GROUP BY gender")
def gender_lengths(spark, sf):
    return at.speech_length_by_gender(v.profiles(spark, sf))


@_g("gender_lengths_by_party", f"SELECT party, gender, {div('sum(total_words)', 'sum(total_speeches)')} AS avg_words FROM profiles GROUP BY party, gender")
def gender_lengths_by_party(spark, sf):
    return at.speech_length_by_gender(v.profiles(spark, sf), ["party"])


@_g("words_by_gender", "SELECT gender, CAST(sum(total_words) AS BIGINT) AS words FROM profiles GROUP BY gender")
def words_by_gender(spark, sf):
    return at.words_by_gender(v.profiles(spark, sf))


_INTER = "CAST(sum(interruptions_made) AS BIGINT) AS made, CAST(sum(interruptions_received) AS BIGINT) AS received, CASE WHEN sum(interruptions_received) > 0 THEN CAST(sum(interruptions_made) AS DOUBLE) / sum(interruptions_received) ELSE CAST(sum(interruptions_made) AS DOUBLE) END AS ratio"


@_g("interruption_by_gender", f"SELECT gender, {_INTER} FROM profiles GROUP BY gender")
def interruption_by_gender(spark, sf):
    return at.interruption_by_gender(v.profiles(spark, sf))


@_g("interruption_by_gender_party", f"SELECT party, gender, {_INTER} FROM profiles GROUP BY party, gender")
def interruption_by_gender_party(spark, sf):
    return at.interruption_by_gender(v.profiles(spark, sf), ["party"])


_TITLED = "CAST(count(*) FILTER (acad_title IS NOT NULL) AS DOUBLE) / count(*) AS titled_share FROM profiles WHERE gender <> 'unknown'"


@_g("titles_by_gender", f"SELECT gender, {_TITLED} GROUP BY gender")
def titles_by_gender(spark, sf):
    return at.titles_by_gender(v.profiles(spark, sf))


@_g("titles_by_gender_party", f"SELECT party, gender, {_TITLED} GROUP BY party, gender")
def titles_by_gender_party(spark, sf):
    return at.titles_by_gender(v.profiles(spark, sf), ["party"])


@_g("question_time_by_gender", f"SELECT gender, CAST(q AS BIGINT) AS questions, {div('q', 'sum(q) OVER ()', '0.0', '100')} AS share FROM (SELECT gender, sum(question_speeches) AS q FROM profiles GROUP BY gender)")
def question_time_by_gender(spark, sf):
    return at.question_time_by_gender(v.profiles(spark, sf))


@_g("wordiest_by_gender", "SELECT gender, speaker, party, total_words, total_speeches, row_number() OVER (PARTITION BY gender ORDER BY total_words DESC, speaker) AS rank FROM profiles QUALIFY rank <= 5")
def wordiest_by_gender(spark, sf):
    return at.wordiest_by_gender(v.profiles(spark, sf))


@_g("speaking_time_distribution", "SELECT speaker, party, total_words FROM profiles")
def speaking_time_distribution(spark, sf):
    return at.speaking_time_distribution(v.profiles(spark, sf))


@_g("most_active", "SELECT speaker, party, formal_speeches, avg_words, row_number() OVER (ORDER BY formal_speeches DESC, speaker) AS rank FROM profiles WHERE formal_speeches >= 1 QUALIFY rank <= 10")
def most_active(spark, sf):
    return at.most_active(v.profiles(spark, sf))


@_g("verbose_by_gender", "SELECT gender, speaker, party, avg_words, total_speeches, row_number() OVER (PARTITION BY gender ORDER BY avg_words DESC, speaker) AS rank FROM profiles WHERE total_speeches >= 3 QUALIFY rank <= 5")
def verbose_by_gender(spark, sf):
    return at.verbose_by_gender(v.profiles(spark, sf))


@_g("profile_lookup", "SELECT speaker, party, total_words FROM profiles WHERE speaker = 'Clara Kraft' OR (party = 'SPD' AND gender = 'female')")
def profile_lookup(spark, sf):
    p = v.profiles(spark, sf).select("speaker", "party", "gender", "total_words")
    return at.profile_lookup(p, "Clara Kraft").unionByName(at.by_party_and_gender(p, "SPD", "female")).drop("gender").distinct()


@_g("gender_report", f"""
, d AS ({_DIST}), i AS (SELECT gender, {_INTER} FROM profiles GROUP BY gender)
SELECT 'speakers' AS section, NULL::VARCHAR AS party, gender, CAST(count(*) AS DOUBLE) AS value FROM profiles GROUP BY gender
UNION ALL SELECT 'female_percent', NULL, NULL, round({div('sum(female)', '(sum(male) + sum(female))', '0.0', '100')}, 1) FROM d
UNION ALL SELECT 'female_percent', party, NULL, round(coalesce(female_ratio, 0) * 100, 1) FROM d
UNION ALL SELECT 'interruptions_made', NULL, gender, CAST(made AS DOUBLE) FROM i UNION ALL SELECT 'interruptions_received', NULL, gender, CAST(received AS DOUBLE) FROM i
UNION ALL SELECT 'speech_length', NULL, gender, {div('sum(total_words)', 'sum(total_speeches)')} FROM profiles GROUP BY gender
UNION ALL SELECT 'titled_share', NULL, gender, {_TITLED.replace(' AS titled_share', '')} GROUP BY gender""")
def gender_report(spark, sf):
    return at.gender_report(v.profiles(spark, sf))


# ---------------------------------------------------------------- speaker records


def _speaker_parts(spark, sf):
    sp = v.compact(spark, sf)
    ev = ij.extract_interjections(sp)
    index = ac.speaker_index(sp)
    return sp, ev, index


_TINDEX = "i AS (SELECT speaker, any_value(party) AS party, count(*) FILTER (category = 'rede') AS speeches, CAST(sum(words) AS BIGINT) AS total_words, CAST(round(CAST(sum(words) AS DOUBLE) / count(*)) AS BIGINT) AS avg_words, max(words) AS max_words FROM speeches GROUP BY speaker)"
_DRAMA = """m AS (SELECT from_name AS speaker, from_party AS party, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, from_name || chr(1) || from_party) AS r FROM ev GROUP BY from_name, from_party),
x AS (SELECT to_name AS speaker, to_party AS party, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, to_name || chr(1) || to_party) AS r FROM ev GROUP BY to_name, to_party),
drama AS (SELECT i.speaker, i.party, coalesce(m.n, 0) AS interruptions_given, m.r AS interrupter_rank, coalesce(x.n, 0) AS interruptions_received, x.r AS interrupted_rank FROM i LEFT JOIN m ON i.speaker = m.speaker AND i.party = m.party LEFT JOIN x ON i.speaker = x.speaker AND i.party = x.party)"""


@query("speaker_drama", sql(f", {_TINDEX}, {_DRAMA} SELECT * FROM drama", "ev"))
def speaker_drama(spark, sf):
    _, ev, index = _speaker_parts(spark, sf)
    return rk.speaker_drama(index, ev)


_BADGES = f""", {_TINDEX}, {_DRAMA},
r AS (SELECT *, row_number() OVER (ORDER BY speeches DESC, speaker) AS sr, row_number() OVER (ORDER BY max_words DESC, speaker) AS lr,
  CASE WHEN speeches >= 3 THEN row_number() OVER (PARTITION BY speeches >= 3 ORDER BY avg_words DESC, speaker) END AS vr, row_number() OVER (PARTITION BY party ORDER BY speeches DESC, speaker) AS pr,
  count(*) OVER () AS ts, count(*) OVER (PARTITION BY party) AS ps FROM i),
b AS (SELECT r.speaker, r.party, list_filter([CASE WHEN TRUE THEN 'speeches' END, CASE WHEN total_words >= 1000 THEN 'words' END, CASE WHEN sr <= 20 THEN 'speech_rank' END, CASE WHEN vr <= 20 THEN 'verbosity_rank' END,
  CASE WHEN lr <= 10 AND max_words > 0 THEN 'longest_speech' END, CASE WHEN interrupter_rank <= 20 THEN 'interrupter_rank' END, CASE WHEN coalesce(interrupter_rank, 999) > 20 AND interruptions_given >= 10 THEN 'interruptions' END,
  CASE WHEN pr <= 5 AND ps > 10 THEN 'party_rank' END], lambda k: k IS NOT NULL) AS k FROM r JOIN drama d ON r.speaker = d.speaker)
SELECT speaker, party, array_to_string(k[1:6], ',') AS badges FROM b"""


def _badged(spark, sf) -> DataFrame:
    _, ev, index = _speaker_parts(spark, sf)
    ranks = rk.speaker_ranks(index, ev)
    return rk.badges(index.join(ranks.drop("party"), "speaker"))


@query("badges", sql(_BADGES, "ev"))
def badges(spark, sf):
    return _badged(spark, sf).select("speaker", "party", F.array_join(F.transform("badges", lambda b: b["kind"]), ",").alias("badges"))


@query("speaker_documents", sql(f", {_TINDEX}, {_DRAMA} SELECT d.speaker, d.party, i.total_words, d.interruptions_given, row_number() OVER (ORDER BY i.speeches DESC, i.speaker) AS speech_rank FROM drama d JOIN i ON d.speaker = i.speaker", "ev"))
def speaker_documents(spark, sf):
    _, ev, index = _speaker_parts(spark, sf)
    docs = rk.speaker_documents(
        index, rk.speaker_ranks(index), rk.speaker_comparison(index, ac.group_averages(index)), ("drama", rk.speaker_drama(index, ev))
    )
    return docs.select("speaker", "party", "total_words", "drama.interruptions_given", "rankings.speech_rank")


_TITLES = [("reader", "Leser", "Leserin", "Lesende"), ("regular", "Stammgast", None, None)]


@query("gendered_title", sql("SELECT speaker, CASE WHEN total_speeches >= 20 THEN CASE gender WHEN 'female' THEN 'Leserin' WHEN 'unknown' THEN 'Lesende' ELSE 'Leser' END ELSE 'Stammgast' END AS title FROM profiles", "profiles"))
def gendered_title(spark, sf):
    p = v.profiles(spark, sf).select("speaker", "gender", F.when(F.col("total_speeches") >= 20, "reader").otherwise("regular").alias("archetype"))
    titles = lookup_frame(spark, _TITLES, "archetype string, title string, title_f string, title_n string")
    return tx.gendered_title(p, titles).select("speaker", "title")


# ---------------------------------------------------------------- matching and evaluation

def truth_and_pred(spark, sf) -> tuple[DataFrame, DataFrame]:
    """The parsed speeches, and a truth with every fifth dropped, every seventh name misspelt and some under another name."""
    sp = materialize(
        v.speeches(spark, sf).select(
            "protocol_id", F.col("speech_id").alias("idx"), "speaker", "party", "role", "is_government", "text"
        )
    )
    i = F.col("idx")
    misspelt = (
        F.when(i % 11 == 0, F.lit("Zora Unbekannt-Xylander")).when(i % 7 == 0, F.replace("speaker", F.lit("a"), F.lit("e"))).otherwise(F.col("speaker"))
    )
    truth = sp.filter(i % 5 != 4).select(
        "protocol_id", "idx", misspelt.alias("speaker"), F.when(~F.col("is_government"), F.col("party")).alias("party"), "role",
        F.col("text").alias("text_preview"),
    )
    return truth, sp.select("protocol_id", "idx", "speaker", "party", "text")


_TRUTH = """, tru AS (SELECT protocol_id, speech_id AS idx, CASE WHEN speech_id % 11 = 0 THEN 'Zora Unbekannt-Xylander' WHEN speech_id % 7 = 0 THEN replace(speaker, 'a', 'e') ELSE speaker END AS speaker FROM speeches WHERE speech_id % 5 <> 4)"""
_KEY = r"lower(trim(regexp_replace(regexp_replace({}, '\b(Dr\.?|Prof\.?)\s*', '', 'g'), '\s+', ' ', 'g')))"


@query("names_match", sql(_TRUTH + f""",
a AS (SELECT DISTINCT protocol_id, {_KEY.format('speaker')} AS left_key FROM tru), b AS (SELECT DISTINCT protocol_id, {_KEY.format('speaker')} AS right_key FROM speeches)
SELECT a.protocol_id, left_key, right_key FROM a JOIN b ON a.protocol_id = b.protocol_id
WHERE levenshtein(left_key, right_key) <= 3 OR string_split(left_key, ' ')[-1] = string_split(right_key, ' ')[-1]""", "speeches"))
def names_match(spark, sf):
    """All matching pairs of distinct names per transcript, from the candidate joins."""
    t, p = truth_and_pred(spark, sf)
    key = tx.match_name_key(F.col("speaker")).alias("key")
    return ma.matching_names(t.select("protocol_id", key), p.select("protocol_id", key), "protocol_id")


@query("edit_distance", "SELECT a.n_name AS a, b.n_name AS b, levenshtein(a.n_name, b.n_name) AS distance FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey WHERE a.n_nationkey < b.n_nationkey")
def edit_distance(spark, sf):
    n = v.read(spark, sf, "nation")
    a = n.select("n_regionkey", F.col("n_nationkey").alias("k1"), F.col("n_name").alias("a"))
    b = n.select("n_regionkey", F.col("n_nationkey").alias("k2"), F.col("n_name").alias("b"))
    return a.join(b, "n_regionkey").filter("k1 < k2").select("a", "b", ma.edit_distance(F.col("a"), F.col("b")).alias("distance"))


def _shingles(words: int) -> str:
    """SQL of the distinct runs of ``words`` words of a list ``ws``."""
    return f"list_distinct(list_transform(range(1, greatest(1, len(ws) - {words - 1}) + 1), lambda i: array_to_string(ws[i:i + {words - 1}], ' ')))"


def _alike(a: str, b: str) -> str:
    return f"(levenshtein({a}, {b}) <= 3 OR ({a} <> '' AND {b} <> '' AND string_split({a}, ' ')[-1] = string_split({b}, ' ')[-1]))"


_WORDS = r"regexp_extract_all(lower(coalesce({}, '')), '[^\x20\x09-\x0D]+')"
_PARTY = "CASE WHEN coalesce({0}, '') = '' THEN '' WHEN upper({0}) LIKE '%GRÜNE%' OR upper({0}) LIKE '%BÜNDNIS%' THEN 'GRÜNE' WHEN upper({0}) LIKE '%LINKE%' THEN 'LINKE' ELSE upper(trim({0})) END"


def _served(name: str, pairs: str) -> str:
    """SQL of the greedy assignment, one left row after another: ``name(protocol_id, l, r)`` from ``pairs(protocol_id, l, r, pref)``."""
    return f""",
{name}_c AS (SELECT protocol_id, l, list(r ORDER BY pref, r) AS rs, row_number() OVER (PARTITION BY protocol_id ORDER BY l) AS k FROM {pairs} GROUP BY protocol_id, l),
{name}_g AS (SELECT DISTINCT protocol_id, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS l, CAST(NULL AS BIGINT) AS r, CAST([] AS BIGINT[]) AS used FROM {name}_c
  UNION ALL SELECT protocol_id, k, l, r, list_append(used, r) FROM (SELECT g.protocol_id, c.k, c.l, list_filter(c.rs, lambda x: NOT list_contains(g.used, x))[1] AS r, g.used
    FROM {name}_g g JOIN {name}_c c ON g.protocol_id = c.protocol_id AND c.k = g.k + 1)),
{name} AS (SELECT protocol_id, l, r FROM {name}_g WHERE r IS NOT NULL)"""


_SIDES = f""",
tr AS (SELECT protocol_id, speech_id AS idx, CASE WHEN speech_id % 11 = 0 THEN 'Zora Unbekannt-Xylander' WHEN speech_id % 7 = 0 THEN replace(speaker, 'a', 'e') ELSE speaker END AS speaker,
  CASE WHEN NOT is_government THEN party END AS party, role, text FROM speeches WHERE speech_id % 5 <> 4),
tk AS (SELECT *, {_KEY.format('speaker')} AS name, {_PARTY.format('party')} AS pk, {_WORDS.format('text')} AS ws FROM tr),
pk AS (SELECT protocol_id, speech_id AS idx, {_KEY.format('speaker')} AS name, {_PARTY.format('party')} AS pk, {_WORDS.format('text')} AS ws FROM speeches)"""
_EXACT = f""",
xp AS (SELECT t.protocol_id, t.idx AS l, p.idx AS r, 0 AS pref FROM tk t JOIN pk p ON t.protocol_id = p.protocol_id
  WHERE {_alike('t.name', 'p.name')} AND (t.pk = p.pk OR (coalesce(t.role, '') <> '' AND t.pk = '')))""" + _served("xm", "xp")


def _partial(taken: str) -> str:
    """SQL of the pairs by text of the rows that ``taken(protocol_id, l, r)`` leaves."""
    return f""",
tl AS (SELECT protocol_id, idx, name, {_shingles(2)} AS sh FROM tk WHERE len(ws) > 0 AND NOT EXISTS (SELECT 1 FROM {taken} m WHERE m.protocol_id = tk.protocol_id AND m.l = tk.idx)),
pl AS (SELECT protocol_id, idx, name, {_shingles(2)} AS sh FROM pk WHERE len(ws) > 0 AND NOT EXISTS (SELECT 1 FROM {taken} m WHERE m.protocol_id = pk.protocol_id AND m.r = pk.idx)),
ov AS (SELECT t.protocol_id, t.idx AS l, p.idx AS r, count(*) AS o FROM (SELECT protocol_id, idx, unnest(sh) AS x FROM tl) t JOIN (SELECT protocol_id, idx, unnest(sh) AS x FROM pl) p
  ON t.protocol_id = p.protocol_id AND t.x = p.x GROUP BY ALL),
sp AS (SELECT ov.protocol_id, l, r, CAST(o AS DOUBLE) / (len(tl.sh) + len(pl.sh) - o) AS similarity, {_alike('tl.name', 'pl.name')} AS same_speaker FROM ov
  JOIN tl ON tl.protocol_id = ov.protocol_id AND tl.idx = l JOIN pl ON pl.protocol_id = ov.protocol_id AND pl.idx = r),
pp AS (SELECT *, -similarity AS pref FROM sp WHERE similarity > 0.5)""" + _served("pm", "pp")


_NONE = ", nobody AS (SELECT CAST(NULL AS BIGINT) AS protocol_id, CAST(NULL AS BIGINT) AS l, CAST(NULL AS BIGINT) AS r WHERE false)"
_BY_TEXT = "SELECT pm.protocol_id, pm.l AS truth_idx, pm.r AS pred_idx, {} similarity, same_speaker FROM pm JOIN pp ON pm.protocol_id = pp.protocol_id AND pm.l = pp.l AND pm.r = pp.r"


def recursive(text: str) -> str:
    return text.replace("WITH ", "WITH RECURSIVE ", 1)


@query("match_exact", recursive(sql(_SIDES + _EXACT + " SELECT protocol_id, l AS truth_idx, r AS pred_idx FROM xm", "speeches")))
def match_exact(spark, sf):
    """Pairs of the altered truth and the parsed speeches by name and group, served in order."""
    return ma.match_exact(*truth_and_pred(spark, sf))


@query("match_partial", recursive(sql(_SIDES + _NONE + _partial("nobody") + " " + _BY_TEXT.format(""), "speeches")))
def match_partial(spark, sf):
    """Pairs of the same rows by their whole texts alone."""
    return ma.match_partial(*truth_and_pred(spark, sf))


@query("match_all", recursive(sql(_SIDES + _EXACT + _partial("xm") + """
SELECT protocol_id, l AS truth_idx, r AS pred_idx, 'exact' AS match_type, CAST(NULL AS DOUBLE) AS similarity, CAST(NULL AS BOOLEAN) AS same_speaker FROM xm
UNION ALL """ + _BY_TEXT.format("'partial' AS match_type,") + """
UNION ALL SELECT protocol_id, idx, NULL, 'truth_only', NULL, NULL FROM tk WHERE NOT EXISTS (SELECT 1 FROM (SELECT * FROM xm UNION ALL SELECT * FROM pm) m WHERE m.protocol_id = tk.protocol_id AND m.l = tk.idx)
UNION ALL SELECT protocol_id, NULL, idx, 'pred_only', NULL, NULL FROM pk WHERE NOT EXISTS (SELECT 1 FROM (SELECT * FROM xm UNION ALL SELECT * FROM pm) m WHERE m.protocol_id = pk.protocol_id AND m.r = pk.idx)""", "speeches")))
def match_all(spark, sf):
    """Labelled matches of the altered truth against the parsed speeches."""
    return ma.match_all(*truth_and_pred(spark, sf))


def _labelled(spark, sf) -> DataFrame:
    """Matches as labels of the speeches by fixed rules, so that the metrics can be checked on their own."""
    i = F.col("speech_id")
    kind = F.when(i % 5 == 4, "pred_only").when(i % 11 == 0, "partial").when(i % 13 == 6, "truth_only").otherwise("exact")
    return v.speeches(spark, sf).select("protocol_id", kind.alias("match_type"), F.when(kind == "partial", i % 2 == 0).alias("same_speaker"))


@query("detection_metrics", sql("""
, m AS (SELECT protocol_id, speech_id, CASE WHEN speech_id % 5 = 4 THEN 'pred_only' WHEN speech_id % 11 = 0 THEN 'partial' WHEN speech_id % 13 = 6 THEN 'truth_only' ELSE 'exact' END AS k FROM speeches),
c AS (SELECT protocol_id, grouping(protocol_id) = 1 AS overall, count(*) FILTER (k = 'exact') AS exact, count(*) FILTER (k = 'partial') AS partial, count(*) FILTER (k = 'truth_only') AS truth_only, count(*) FILTER (k = 'pred_only') AS pred_only,
  count(*) FILTER (k = 'partial' AND speech_id % 2 = 1) AS speaker_mismatches FROM m GROUP BY ROLLUP (protocol_id)),
p AS (SELECT *, """ + div("(exact + partial)", "(exact + partial + pred_only)") + " AS precision, " + div("(exact + partial)", "(exact + partial + truth_only)") + """ AS recall FROM c)
SELECT *, coalesce(2 * (precision * recall) / NULLIF(precision + recall, 0), 0) AS f1 FROM p""", "speeches"))
def detection_metrics(spark, sf):
    return ma.detection_metrics(_labelled(spark, sf))


_EDITED = """, ed AS (SELECT protocol_id, speech_id AS i, speaker, text, len(string_split(text, ' ')) // 2 AS half, string_split(text, ' ') AS ws0 FROM speeches),
rows AS (SELECT protocol_id, i * 10 AS id, speaker, text FROM ed
  UNION ALL SELECT protocol_id, i * 10 + 1, speaker, CASE (i // 3) % 3 WHEN 0 THEN 'xq ' || text WHEN 1 THEN text || ' zq'
    ELSE array_to_string(list_concat(list_append(ws0[1:half], 'qq'), ws0[half + 1:]), ' ') END FROM ed WHERE i % 3 = 0
  UNION ALL SELECT protocol_id, i * 10 + 2, speaker, text FROM ed WHERE i % 4 = 0)"""
_PAIRED = f"""
ns AS (SELECT *, {_shingles(5)} AS sh FROM cl WHERE len(ws) > 0),
nx AS (SELECT protocol_id, id, unnest(sh) AS x FROM ns),
no AS (SELECT a.protocol_id, a.id AS l, b.id AS r, count(*) AS o FROM nx a JOIN nx b ON a.protocol_id = b.protocol_id AND a.x = b.x AND a.id < b.id GROUP BY ALL)"""


@query("near_duplicates", sql(_EDITED + f""",
cl AS (SELECT protocol_id, {_KEY.format('speaker')} AS name, text, min(id) AS id, count(*) AS n, {_WORDS.format('text')} AS ws FROM rows WHERE text <> '' GROUP BY ALL),
{_PAIRED}
SELECT no.protocol_id, l AS left_id, r AS right_id, CAST(o AS DOUBLE) / (len(a.sh) + len(b.sh) - o) AS similarity, a.n AS n_left, b.n AS n_right, a.n * b.n AS pairs
FROM no JOIN ns a ON a.protocol_id = no.protocol_id AND a.id = l JOIN ns b ON b.protocol_id = no.protocol_id AND b.id = r
WHERE CAST(o AS DOUBLE) / (len(a.sh) + len(b.sh) - o) >= 0.8 AND {_alike('a.name', 'b.name')}
UNION ALL SELECT protocol_id, id, id, 1.0, n, n, n * (n - 1) // 2 FROM cl WHERE n > 1""", "speeches"))
def near_duplicates(spark, sf):
    """Near-duplicates of a speaker inside a transcript: every third speech again with a word put in front, at the end or in the middle, every fourth copied."""
    i = F.col("speech_id")
    words = F.split("text", " ")
    half = F.floor(F.size(words) / 2).cast("int")
    middle = F.array_join(F.concat(F.slice(words, F.lit(1), half), F.array(F.lit("qq")), F.slice(words, half + 1, F.size(words))), " ")
    turn = F.floor(i / 3) % 3
    edited = F.when(turn == 0, F.concat(F.lit("xq "), "text")).when(turn == 1, F.concat("text", F.lit(" zq"))).otherwise(middle)
    copies = F.array_compact(F.array(
        F.struct((i * 10).alias("id"), F.col("text").alias("t")),
        F.when(i % 3 == 0, F.struct((i * 10 + 1).alias("id"), edited.alias("t"))),
        F.when(i % 4 == 0, F.struct((i * 10 + 2).alias("id"), F.col("text").alias("t"))),
    ))
    sp = v.speeches(spark, sf).select("protocol_id", "speaker", F.inline(copies))
    named = sp.select("protocol_id", F.col("id").cast("long").alias("speech_id"), "speaker", F.col("t").alias("text"))
    return ma.near_duplicates(named)


@query("similar_texts", f"""
WITH w AS (SELECT lang, doc_id, {_WORDS.format('text')} AS ws FROM documents),
x AS (SELECT lang, doc_id, w, lead(w, 1) OVER p AS w1, lead(w, 2) OVER p AS w2, lead(w, 3) OVER p AS w3, lead(w, 4) OVER p AS w4
  FROM (SELECT lang, doc_id, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM w) WINDOW p AS (PARTITION BY doc_id ORDER BY i)),
s AS (SELECT DISTINCT lang, doc_id, concat_ws(' ', w, w1, w2, w3, w4) AS x FROM x WHERE w4 IS NOT NULL UNION ALL SELECT lang, doc_id, array_to_string(ws, ' ') FROM w WHERE len(ws) BETWEEN 1 AND 4),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.lang, a.doc_id AS left_id, b.doc_id AS right_id, count(*) AS overlap FROM s a JOIN s b ON a.lang = b.lang AND a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL)
SELECT lang, left_id, right_id, overlap, CAST(overlap AS DOUBLE) / (l.n + r.n - overlap) AS similarity
FROM o JOIN n l ON l.doc_id = left_id JOIN n r ON r.doc_id = right_id WHERE CAST(overlap AS DOUBLE) / (l.n + r.n - overlap) >= 0.8""")
def similar_texts(spark, sf):
    """Pairs of whole documents of a language that share four fifths of their five-word runs."""
    docs = v.read(spark, sf, "documents").select("lang", F.col("doc_id").alias("id"), "text")
    pairs = si.similar_texts(docs, "lang", 0.8, 5)
    return pairs.select("lang", "left_id", "right_id", F.col("overlap").cast("long").alias("overlap"), "similarity")


@query("text_similarity", f"""
WITH p AS (SELECT d.doc_id, b.item_id, {_WORDS.format('d.text')} AS dw, {_WORDS.format('b.text')} AS bw FROM documents d JOIN benchmark b ON d.doc_id % 40 = b.item_id % 40),
s AS (SELECT doc_id, item_id, (SELECT {_shingles(2)} FROM (SELECT dw AS ws)) AS a, (SELECT {_shingles(2)} FROM (SELECT bw AS ws)) AS b, len(dw) AS na, len(bw) AS nb FROM p),
t AS (SELECT doc_id, item_id, CASE WHEN na = 0 OR nb = 0 THEN 0 ELSE len(list_intersect(a, b)) END AS o, len(a) AS la, len(b) AS lb, na, nb FROM s)
SELECT doc_id, item_id, CASE WHEN o = 0 THEN 0.0 ELSE CAST(o AS DOUBLE) / (la + lb - o) END AS similarity FROM t""")
def text_similarity(spark, sf):
    """The shared part of two-word runs of each document and the benchmark items of its number."""
    d = si.with_shingles(v.read(spark, sf, "documents").select("doc_id", "text"), F.col("text"), 2, "a").select("doc_id", "a", (F.col("doc_id") % 40).alias("_n"))
    b = si.with_shingles(v.read(spark, sf, "benchmark").select("item_id", "text"), F.col("text"), 2, "b").select("item_id", "b", (F.col("item_id") % 40).alias("_n"))
    return d.join(b, "_n").select("doc_id", "item_id", ma.text_similarity(F.col("a"), F.col("b")).alias("similarity"))
