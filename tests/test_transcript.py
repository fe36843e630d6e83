
from rostrum.operators import transcript as tr
from rostrum.operators.common import forward_asof

LONG = "Wir brauchen gute Schulen in allen Teilen des Landes, und zwar jetzt. "


def protocols(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts, 1)], "protocol_id long, full_text string")


def officials(spark):
    return spark.createDataFrame([("Dora Lindner", "SPD"), ("Hanno Vogel", "CDU/CSU")], "name string, party string")


def parse(spark, *texts, **kwargs):
    return tr.parse_protocols(protocols(spark, *texts), officials(spark), **kwargs).orderBy("protocol_id", "speech_id").collect()


def test_officials_and_members(spark):
    text = (
        "Inhalt\nPräsidentin Julia Weber:\nDas Wort hat die Ministerin.\n"
        f"\nDora Lindner, Bundesministerin der Finanzen:\nSehr geehrte Frau Präsidentin! {LONG}\n"
        f"\nPräsidentin Julia Weber:\nDanke.\n\nDr. Bernd Maier (CDU/CSU):\nSehr geehrte Frau Präsidentin! {LONG}(Beifall bei der CDU/CSU)\n"
        f"\nDr. Hanno Vogel, Bundeskanzler:\n{LONG}\n\nFrida Unbekannt, Staatsministerin im Amt:\n{LONG}\n"
    )
    got = parse(spark, text)
    assert [(s.speaker, s.party, s.is_government, s.type) for s in got] == [
        ("Dora Lindner", "SPD", True, "rede"), ("Dr. Bernd Maier", "CDU/CSU", False, "rede"), ("Dr. Hanno Vogel", "CDU/CSU", True, "rede"),
    ]
    assert "Beifall" not in got[1].text and "Beifall" in got[1].raw_text
    assert got[1].acad_title == "Dr" and got[1].last_name == "Maier"
    assert not any("Präsidentin Julia" in s.speaker for s in got)
    cleaned = text
    for s in got:
        assert cleaned[s.start:s.end] == s.raw_text


def test_short_unknown_and_question_headings(spark):
    text = (
        f"\nPräsident Karl Ott:\nBitte.\n\nAnna Schmidt (SPD):\nJa.\n\nAnna Schmidt (Verein):\nHerr Präsident! {LONG}\n"
        f"\nPräsident Karl Ott:\nBitte.\n\nAnna Schmidt (SPD):\nHerr Präsident! {LONG}\nFrage des Abgeordneten Otto (AfD):\n{LONG}\n"
    )
    got = parse(spark, text)
    assert len(got) == 1 and got[0].speaker == "Anna Schmidt"
    assert "Frage des Abgeordneten" in got[0].text


def test_government_wins_over_speaker(spark):
    got = parse(spark, f"\nDora Lindner, Bundesministerin (BMF):\n{LONG}\n")
    assert [(s.speaker, s.is_government) for s in got] == [("Dora Lindner", True)]


def test_length_rule_and_continuation(spark):
    long_text = LONG * 60
    text = (
        f"\nAnna Schmidt (SPD):\n{LONG}\n\nEmil Hauser (AfD):\n{long_text}\n\nGustav Winter (DIE LINKE):\nIch komme zum Schluss. {long_text}\n"
        f"\nClara Kraft (GRÜNE):\nJa, {long_text}\n"
    )
    got = parse(spark, text)
    assert [(s.speaker, s.type, s.category) for s in got] == [
        ("Emil Hauser", "sonstiges", "wortbeitrag"), ("Clara Kraft", "zwischenfrage", "wortbeitrag"),
    ]


def test_context_beats_everything(spark):
    text = f"\nPräsident Karl Ott:\nIch rufe die Frage 12 auf.\n\nDora Lindner, Bundesministerin:\n{LONG}\n"
    assert [s.type for s in parse(spark, text)] == ["fragestunde"]


def test_question_session_ranges(spark):
    text = (
        f"\nPräsident Karl Ott:\nRegierungsbefragung\n\nDora Lindner, Bundesministerin:\n{LONG}\n"
        f"\nPräsident Karl Ott:\nDamit beende ich die Befragung.\n\nDora Lindner, Bundesministerin:\n{LONG}\n"
        f"\nFragestunde\n\nDora Lindner, Bundesministerin:\n{LONG}\n"
    )
    assert [s.type for s in parse(spark, text)] == ["befragung", "rede", "fragestunde_antwort"]
    ranges = tr.qa_ranges(protocols(spark, text)).orderBy("start").collect()
    assert [r.kind for r in ranges] == ["befragung", "fragestunde"]
    assert text[ranges[0].start:ranges[0].end].endswith("beende ich die Befragung") and ranges[1].end == len(text)


def test_ranges_relational_and_in_row_agree(spark):
    texts = ["", "Befragung der Bundesregierung x Ende der Befragung y Regierungsbefragung z", "a\nFragestunde\nb schließe ich die Fragestunde c Fragestunde"]
    p = protocols(spark, *texts)
    inside = {(r.protocol_id, r.start, r.end) for r in tr.qa_ranges(p).collect()}
    starts, ends = tr.qa_markers(p)
    joined = forward_asof(starts, ends, "protocol_id", "start", "start", "end", width=8)
    assert inside == {(r.protocol_id, r.start, r.end if r.end is not None else len(texts[r.protocol_id - 1])) for r in joined.collect()}


def test_anchored_session_start(spark):
    text = f"Inhalt: Regierungsbefragung Seite 3\nDora Lindner, Bundesministerin:\n{LONG}\n"
    assert [s.type for s in parse(spark, text)] == ["befragung"]
    assert [s.type for s in parse(spark, text, anchored=True)] == ["rede"]


def test_pieces_cover_the_text(spark):
    text = f"Vorspann\nAnna Schmidt (SPD):\n{LONG}\n\nEmil Hauser (AfD):\nKurz.\n"
    parts = tr.segment(protocols(spark, text)).orderBy("ordinal").collect()
    assert text[: parts[0].header_start] == "Vorspann"
    assert "".join(text[s.header_start:s.end] for s in parts) == text[parts[0].header_start:]
    assert [p.prev_kind for p in parts] == [None, "speaker"]


def test_back_to_back_headers_and_special_spaces(spark):
    text = f"\nAnna Schmidt (SPD):\n\nEmil Hauser (AfD):\nHerr Präsident! {LONG}\n"
    assert [p.speaker for p in tr.segment(protocols(spark, text)).orderBy("ordinal").collect()] == ["Anna Schmidt", "Emil Hauser"]


def test_parsing_shuffles_no_text(spark):
    plan = tr.parse_protocols(protocols(spark, LONG), officials(spark))._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(protocol_id" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
