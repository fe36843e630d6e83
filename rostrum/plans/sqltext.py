"""SQL text of the views, shared by the oracle statements (common table expressions by name)."""

from __future__ import annotations

from collections.abc import Sequence

from rostrum.functions.rules import start_rules
from rostrum.plans import views as v

WORD = r"[^\s\x0B\p{Z}\x85\x1C-\x1F]+"
SPACE = r"[\s\x0B\p{Z}\x85\x1C-\x1F]+"


def lit(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    if isinstance(value, float):
        return f"CAST({value} AS DOUBLE)"
    if isinstance(value, int):
        return str(value)
    text = "'" + str(value).replace("'", "''") + "'"
    return text.replace("\n", "' || chr(10) || '")


def values(rows: Sequence[Sequence], names: str) -> str:
    body = ", ".join("(" + ", ".join(lit(x) for x in row) + ")" for row in rows)
    return f"(VALUES {body}) AS t({names})"


def pick(options: Sequence[str], index: str) -> str:
    arms = " ".join(f"WHEN {i} THEN {lit(o)}" for i, o in enumerate(options))
    return f"CASE {index} {arms} END"


def clean(expr: str) -> str:
    special = "chr(160) || chr(8199) || chr(8239) || chr(8288) || chr(8212) || chr(8211)"
    return f"regexp_replace(translate({expr}, {special}, '    --'), '[\\t ]+', ' ', 'g')"


def collapse(expr: str) -> str:
    return f"trim(regexp_replace({expr}, '{SPACE}', ' ', 'g'))"


def strip_parens(expr: str) -> str:
    return collapse(f"regexp_replace({expr}, '\\([^)]+\\)', '', 'g')")


def word_count(expr: str) -> str:
    return f"CAST(len(regexp_extract_all({expr}, '{WORD}')) AS BIGINT)"


def last_name(expr: str) -> str:
    bare = f"replace(replace({expr}, 'Dr.', ''), 'Prof.', '')"
    return f"lower(list_extract(string_split({collapse(bare)}, ' '), -1))"


def div(a: str, b: str, default: str = "0.0", scale: str | None = None) -> str:
    core = f"CAST({a} AS DOUBLE) / NULLIF({b}, 0)"
    if scale:
        core = f"({core}) * {scale}"
    return f"coalesce({core}, CAST({default} AS DOUBLE))"


_USER = v.USER_HEADERS
_ASSISTANT = v.ASSISTANT_HEADERS
_OFFICIAL = dict(v.OFFICIALS)

# speaker as written, group, first name, last name, title
_PEOPLE = [
    ("Anna Schmidt", "SPD", "Anna", "Schmidt", None), ("Dr. Bernd Maier", "CDU/CSU", "Bernd", "Maier", "Dr"),
    ("Clara Kraft", "GRÜNE", "Clara", "Kraft", None), ("Kraft", "GRÜNE", "", "Kraft", None), ("Ida Anders", None, "Ida", "Anders", None),
    ("Dora Lindner", "SPD", "Dora", "Lindner", None), ("Emil Hauser", "AfD", "Emil", "Hauser", None),
    ("Frida Sommer", None, "Frida", "Sommer", None), ("Dr. Hanno Vogel", "CDU/CSU", "Hanno", "Vogel", "Dr"),
    ("Gustav Winter", "DIE LINKE", "Gustav", "Winter", None),
]
_START_TYPES = ["rede", "fragestunde", "zwischenfrage", "continuation", "other", "fragestunde_antwort", "rede"]

CTES: dict[str, str] = {}

CTES["corpus"] = f"""
SELECT doc_id AS speech_id, lang AS party, lang || '/' || source AS speaker, text, {word_count('text')} AS words,
  CASE WHEN doc_id % 7 = 0 THEN 'fragestunde' WHEN doc_id % 5 = 0 THEN 'befragung' WHEN doc_id % 3 = 0 THEN 'zwischenfrage' ELSE 'rede' END AS type,
  CASE WHEN doc_id % 7 <> 0 AND doc_id % 5 <> 0 AND doc_id % 3 <> 0 THEN 'rede' ELSE 'wortbeitrag' END AS category,
  CASE WHEN doc_id % 11 = 0 THEN 'Dr' END AS acad_title
FROM documents"""

CTES["tokens"] = r"""
SELECT speech_id, party, speaker, type, word FROM (
  SELECT speech_id, party, speaker, type, unnest(regexp_split_to_array(lower(text), '[^\p{L}\p{N}_]+')) AS word FROM corpus)
WHERE regexp_full_match(word, '[a-zäöüß]{4,}')"""

CTES["wc"] = "SELECT party, speaker, word, count(*) AS n FROM tokens GROUP BY ALL"
CTES["pwc"] = "SELECT party, word, CAST(sum(n) AS BIGINT) AS n FROM wc GROUP BY ALL"
CTES["ptot"] = "SELECT party, CAST(sum(n) AS BIGINT) AS total_words FROM pwc GROUP BY ALL"
CTES["stot"] = "SELECT party, speaker, CAST(sum(n) AS BIGINT) AS total_words FROM wc GROUP BY ALL"
CTES["lex"] = (
    "SELECT scheme, category, word, weight FROM "
    + values([(*row, i) for i, row in enumerate(v.LEXICON)], "scheme, category, word, weight, ord")
    + " QUALIFY row_number() OVER (PARTITION BY scheme, word ORDER BY ord DESC) = 1"
)
CTES["multi"] = "SELECT * FROM " + values([(*row, i) for i, row in enumerate(v.MULTI_LABEL)], "word, category, weight, ord")
CTES["topics"] = "SELECT * FROM " + values([(t,) for t in v.TOPIC_LIST], "topic")
CTES["cat"] = "SELECT p.party, p.speaker, p.word, p.n, l.scheme, l.category FROM wc p JOIN lex l ON p.word = l.word"


# what the scores are expected to compare, written out here and not taken from the operators
RATIO_SCORES = [
    ("affirmative", "adjective", "affirmative", "critical"), ("solution_focus", "verb", "solution", "problem"),
    ("collaboration", "verb", "collaborative", "confrontational"), ("authority", "modal", "obligation", "possibility"),
    ("future_orientation", "temporal", "prospective", "retrospective"), ("emotional_intensity", "intensity", "intensifier", "moderator"),
    ("inclusivity", "pronoun", "inclusive", "exclusive"),
]
INDEX_SCORES = [
    ("aggression", "adjective", "aggressive"), ("labeling", "adjective", "labeling"), ("demand_intensity", "verb", "demanding"),
    ("acknowledgment", "verb", "acknowledging"),
]


def tone_columns(total: str = "total_words") -> str:
    """Score columns over a table with one row per (group, scheme, category, n)."""
    def of(scheme: str, category: str | None = None) -> str:
        cond = f"scheme = '{scheme}'" + (f" AND category = '{category}'" if category else "")
        return f"coalesce(sum(n) FILTER ({cond}), 0)"

    cols = []
    for name, scheme, a, b in RATIO_SCORES:
        cols.append(f"{div(of(scheme, a), f'({of(scheme, a)} + {of(scheme, b)})', '50.0', '100')} AS {name}")
    for name, scheme, a in INDEX_SCORES:
        cols.append(f"{div(of(scheme, a), of(scheme), '0.0', '100')} AS {name}")
    cols.append(f"{div(of('discriminatory'), f'max({total})', '0.0', '1000')} AS discriminatory")
    return ",\n".join(cols)


CTES["tone"] = "SELECT t.party, max(t.total_words) AS total_words, TONE FROM ptot t LEFT JOIN cat c ON t.party = c.party GROUP BY t.party"
CTES["stone"] = "SELECT t.party, t.speaker, max(t.total_words) AS total_words, TONE FROM stot t LEFT JOIN cat c ON t.party = c.party AND t.speaker = c.speaker GROUP BY t.party, t.speaker"
CTES["tscore"] = f"""
SELECT g.party, g.topic, coalesce(c.n, 0) AS n, {div('coalesce(c.n, 0)', 'g.total_words', '0.0', '1000')} AS score
FROM (SELECT party, total_words, topic FROM ptot, topics) g
LEFT JOIN (SELECT party, category AS topic, CAST(sum(n) AS BIGINT) AS n FROM cat WHERE scheme = 'topic' GROUP BY ALL) c
  ON g.party = c.party AND g.topic = c.topic"""

# ---------------------------------------------------------------- transcripts

CTES["turns"] = f"""
SELECT conv_id AS protocol_id, conv_id, turn, role,
  CASE role WHEN 'system' THEN 'Präsidentin Julia Weber' WHEN 'user' THEN {pick(_USER, f'(conv_id + turn) % {len(_USER)}')}
    ELSE {pick(_ASSISTANT, f'(conv_id * 3 + turn) % {len(_ASSISTANT)}')} END AS header,
  CASE WHEN turn = 0 AND conv_id % 3 = 0 THEN {lit(chr(10) + 'Präsidentin Julia Weber:' + chr(10) + 'Ich rufe auf: Befragung der Bundesregierung.' + chr(10))}
    WHEN turn = 4 AND conv_id % 3 = 0 THEN {lit(chr(10) + 'Präsidentin Julia Weber:' + chr(10) + 'Damit beende ich die Befragung.' + chr(10))}
    WHEN turn % 2 = 0 THEN {lit(chr(10) + 'Präsidentin Julia Weber:' + chr(10) + 'Das Wort hat der nächste Redner.' + chr(10))}
    ELSE '' END AS chair,
  {pick(v.OPENINGS, f'(conv_id + turn) % {len(v.OPENINGS)}')} || replace(translate(text, '()[]', '    '), chr(10), '  ') ||
  CASE WHEN turn % 3 = 0 THEN ' (Beifall bei der SPD und der AfD)' ELSE '' END ||
  CASE WHEN turn % 2 = 1 THEN {pick([f' ({n} [{p}]: {t})' for n, p, _, t, _ in v.INTERJECTIONS], f'(conv_id + turn) % {len(v.INTERJECTIONS)}')} ELSE '' END ||
  CASE WHEN turn % 4 = 1 THEN ' (Zuruf von der AfD)' ELSE '' END ||
  CASE WHEN turn % 4 = 2 THEN ' (Zurufe vom BÜNDNIS 90/DIE GRÜNEN: Oh!)' ELSE '' END ||
  CASE WHEN turn % 5 = 4 THEN {lit(v.NOISE_NOTE)} ELSE '' END || CASE WHEN turn % 5 = 3 THEN {lit(v.HEADING)} ELSE '' END || chr(10) AS spoken,
  {pick(_START_TYPES, f'(conv_id + turn) % {len(_START_TYPES)}')} AS start_type,
  (conv_id + turn) % {len(v.INTERJECTIONS)} AS heckle
FROM conversations"""

CTES["parts"] = f"""
SELECT *, CASE WHEN role = 'system' THEN 'president' WHEN header LIKE '%, %' THEN 'government' ELSE 'speaker' END AS kind,
  {clean('spoken')} AS raw_text, length(chair) AS chair_len, length(header) + 3 AS header_len
FROM turns"""

CTES["bounds"] = """
SELECT *,
  CASE WHEN chair <> '' THEN 'president' ELSE lag(kind) OVER w END AS prev_kind,
  CAST(coalesce(sum(1 + CASE WHEN chair <> '' THEN 1 ELSE 0 END) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
    + CASE WHEN chair <> '' THEN 1 ELSE 0 END AS BIGINT) AS ordinal,
  CAST(coalesce(sum(chair_len + header_len + length(raw_text)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + chair_len AS BIGINT) AS header_start,
  CASE WHEN conv_id % 3 = 0 AND turn < 4 THEN 'befragung' END AS qa_kind,
  CASE kind WHEN 'government' THEN string_split(header, ', ')[1] WHEN 'speaker' THEN string_split(header, ' (')[1] ELSE header END AS speaker
FROM parts WINDOW w AS (PARTITION BY protocol_id ORDER BY turn)"""

CTES["people"] = "SELECT * FROM " + values(_PEOPLE, "speaker, party, first_name, last_name, acad_title")

CTES["speeches"] = f"""
SELECT protocol_id, speech_id, speaker, party, text, raw_text, type, CASE WHEN type = 'rede' THEN 'rede' ELSE 'wortbeitrag' END AS category,
  words, first_name, last_name, acad_title, is_government, role_name AS role, start, "end", conv_id, turn, heckle
FROM (
  SELECT *, CASE WHEN kind = 'government' AND qa_kind = 'befragung' THEN 'befragung' WHEN kind = 'government' THEN 'rede'
      WHEN start_type = 'continuation' THEN NULL
      WHEN prev_kind = 'president' AND start_type = 'fragestunde' THEN 'fragestunde'
      WHEN prev_kind = 'president' AND start_type = 'rede' THEN 'rede'
      WHEN words >= {v.PARSE_MIN_WORDS} THEN CASE start_type WHEN 'other' THEN 'sonstiges' ELSE start_type END END AS type
  FROM (
    SELECT b.protocol_id, b.ordinal AS speech_id, b.speaker, p.party, {strip_parens('b.raw_text')} AS text, b.raw_text, b.kind, b.qa_kind,
      b.prev_kind, b.start_type, {word_count(strip_parens('b.raw_text'))} AS words, p.first_name, p.last_name, p.acad_title,
      b.kind = 'government' AS is_government, CASE WHEN b.kind = 'government' THEN string_split(b.header, ', ')[2] END AS role_name,
      b.header_start + b.header_len AS start, b.header_start + b.header_len + length(b.raw_text) AS "end", b.conv_id, b.turn, b.heckle
    FROM bounds b JOIN people p ON b.speaker = p.speaker WHERE b.kind <> 'president' AND p.party IS NOT NULL)
  WHERE length(text) >= 50)
WHERE type IS NOT NULL"""

def decided(text: str) -> str:
    """The label of a contribution by the decision list of its opening words: the first rule whose tests all match."""
    arms = []
    for rule in start_rules():
        tests = " AND ".join(f"regexp_matches(lower(substring({text}, 1, {n})), {lit(regex)})" for n, regex in rule.tests)
        arms.append(f"WHEN {tests} THEN {lit(rule.label)}")
    return f"CASE {' '.join(arms)} ELSE 'other' END"


# the speeches with the opening labelled by the decision list on the whole text; the view above takes the label of the words put
# in front, which differs where none are and the text itself begins like a reply
CTES["ruled_speeches"] = CTES["speeches"].replace("b.start_type, ", "").replace(
    "WHERE length(text) >= 50)", "WHERE length(text) >= 50))"
).replace("  FROM (\n    SELECT b.protocol_id", f"  FROM (SELECT *, {decided('text')} AS start_type FROM (\n    SELECT b.protocol_id")


CTES["heckles"] = "SELECT * FROM " + values(
    [(i, n.replace("Abg. ", ""), n.split()[-1], g, t, s) for i, (n, _, g, t, s) in enumerate(v.INTERJECTIONS)],
    "heckle, from_name, from_last, from_party, content, sentiment",
)
CTES["ev"] = """
SELECT s.protocol_id, s.speech_id, h.from_name, h.from_party, s.speaker AS to_name, s.party AS to_party, ' ' || h.content AS content, h.sentiment
FROM speeches s JOIN heckles h ON s.heckle = h.heckle
WHERE s.turn % 2 = 1 AND h.from_last <> s.last_name"""

CTES["raw_profiles"] = """
SELECT s.speaker, any_value(s.party) AS party, any_value(s.first_name) AS first_name, any_value(s.last_name) AS last_name, any_value(s.acad_title) AS acad_title,
  count(*) AS total_speeches, CAST(sum(words) AS BIGINT) AS total_words, count(*) FILTER (category = 'rede') AS formal_speeches,
  count(*) FILTER (category <> 'rede') AS wortbeitraege, count(*) FILTER (type IN ('befragung', 'fragestunde_antwort')) AS befragung_responses,
  count(*) FILTER (type = 'fragestunde') AS question_speeches,
  coalesce(any_value(m.n), 0) AS interruptions_made, coalesce(any_value(r.n), 0) AS interruptions_received
FROM speeches s
LEFT JOIN (SELECT from_name, from_party, count(*) AS n FROM ev GROUP BY ALL) m ON s.speaker = m.from_name AND s.party = m.from_party
LEFT JOIN (SELECT to_name, to_party, count(*) AS n FROM ev GROUP BY ALL) r ON s.speaker = r.to_name AND s.party = r.to_party
GROUP BY s.speaker"""

_SUMS = ["total_speeches", "total_words", "formal_speeches", "wortbeitraege", "befragung_responses", "question_speeches", "interruptions_made", "interruptions_received"]
CTES["profiles"] = f"""
SELECT speaker, party, first_name, last_name, acad_title, {', '.join(_SUMS)},
  CASE first_name WHEN 'Anna' THEN 'female' WHEN 'Bernd' THEN 'male' WHEN 'Clara' THEN 'female' WHEN 'Dora' THEN 'female'
    WHEN 'Emil' THEN 'male' WHEN 'Gustav' THEN 'male' WHEN 'Hanno' THEN 'male' ELSE 'unknown' END AS gender,
  CAST(total_words AS DOUBLE) / total_speeches AS avg_words
FROM (
  SELECT coalesce(f.speaker, p.speaker) AS speaker, p.party, coalesce(any_value(f.first_name), any_value(p.first_name)) AS first_name,
    any_value(p.last_name) AS last_name, coalesce(any_value(f.acad_title), any_value(p.acad_title)) AS acad_title,
    {', '.join(f'CAST(sum(p.{c}) AS BIGINT) AS {c}' for c in _SUMS)}
  FROM raw_profiles p LEFT JOIN raw_profiles f
    ON p.first_name = '' AND f.first_name <> '' AND f.last_name = p.last_name AND f.party = p.party
  GROUP BY coalesce(f.speaker, p.speaker), p.party)"""

_DEPS = {
    "tokens": ["corpus"], "wc": ["tokens"], "pwc": ["wc"], "ptot": ["pwc"], "stot": ["wc"], "cat": ["wc", "lex"],
    "tone": ["ptot", "cat"], "stone": ["stot", "cat"], "tscore": ["ptot", "topics", "cat"],
    "parts": ["turns"], "bounds": ["parts"], "speeches": ["bounds", "people"], "ruled_speeches": ["bounds", "people"], "ev": ["speeches", "heckles"],
    "raw_profiles": ["ev"], "profiles": ["raw_profiles"],
}


def sql(body: str, *names: str) -> str:
    """``body`` with the common table expressions ``names`` and all they need in front."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for dep in _DEPS.get(name, []):
            add(dep)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        add(name)
    if not ordered:
        return body
    parts = []
    for name in ordered:
        text = CTES[name].replace("TONE", tone_columns("t.total_words")) if "TONE" in CTES[name] else CTES[name]
        parts.append(f"{name} AS ({text.strip()})")
    return "WITH " + ",\n".join(parts) + "\n" + body
