import pytest
from pyspark.sql import functions as F

from rostrum.functions import rules as ru
from rostrum.functions import text as tx
from rostrum.functions.groups import normalize_party, parties_in_annotation, party_compare_key
from rostrum.functions.sentiment import classify_sentiment


def one(spark, value, fn, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(fn(F.col("v")).alias("x")).collect()[0].x


def test_clean_and_strip(spark):
    assert one(spark, "a b–c\t\td  e\nf", tx.clean_text) == "a b-c d e\nf"
    assert one(spark, "Ja (Beifall) nein (a (b) c)  ok", tx.strip_parentheses) == "Ja nein c) ok"
    assert one(spark, "()x", tx.strip_parentheses) == "()x"


@pytest.mark.parametrize("text,n", [("", 0), ("  ", 0), ("a b c\n d", 4), (" x ", 1)])
def test_word_count(spark, text, n):
    assert one(spark, text, tx.word_count) == n


@pytest.mark.parametrize("name,want", [
    ("Dr. Anna Schmidt", ("Anna", "Schmidt", "Dr")), ("Schmidt", ("", "Schmidt", None)), ("Prof. Dr. h. c. Éva Lü", ("Éva", "Lü", "Prof Dr h c")),
    ("", ("", "", None)), ("Jan van Aken", ("Jan", "Aken", "van")),
])
def test_name_parts(spark, name, want):
    assert tuple(one(spark, name, tx.name_parts)) == want


@pytest.mark.parametrize("name,want", [
    ("Dr. Paula Pietsch", "paula-pietsch"), ("Müller, Hans", "hans-mueller"), ("Çelik Ñandú", "celik-nandu"), ("Groß & Söhne!", "gross-soehne"),
])
def test_slug(spark, name, want):
    assert one(spark, name, tx.slug) == want


def test_slug_collisions(spark):
    df = spark.createDataFrame([("A B", "SPD", "a-b"), ("A. B", "AfD", "a-b"), ("C", "SPD", "c")], "speaker string, party string, slug string")
    assert {r.speaker: r.slug for r in tx.resolve_slug_collisions(df).collect()} == {"A B": "a-b-spd", "A. B": "a-b-afd", "C": "c"}


def test_tokens(spark):
    got = one(spark, "élève größe haus Häuser naïve x_haus haus1 über die", tx.tokenize)
    assert got == ["größe", "haus", "häuser", "über"]


def test_small_functions(spark):
    assert one(spark, "Moin moin, moinmoin", lambda c: tx.count_occurrences(c, "moin")) == 4
    assert one(spark, "x" * 200, tx.preview) == "x" * 150 + "..."
    assert one(spark, "a\nb", tx.preview) == "a b"
    assert one(spark, "Abg. Dr.  X", tx.strip_honorific) == "Dr. X"
    assert one(spark, "Prof. Dr. Anna Groß", tx.last_name_key) == "groß"
    assert [one(spark, w, lambda c: tx.is_valid_word(c, ["haus"])) for w in ("haus", "ab", "a1b", "-abc", "baum")] == [False, False, False, False, True]


@pytest.mark.parametrize("raw,want", [
    ("CDU/CSU", "CDU/CSU"), ("spd", "SPD"), ("BÜNDNIS 90/DIE GRÜNEN", "GRÜNE"), ("F.D.P.", "FDP"), ("AfD", "AfD"), ("Die Linke", "DIE LINKE"),
    ("BSW", "BSW"), ("Parteilos", "fraktionslos"), ("xyz", None), ("GB/BHE", "GB/BHE"),
])
def test_normalize_party(spark, raw, want):
    assert one(spark, raw, normalize_party) == want


@pytest.mark.parametrize("note,want", [
    ("SPD und der AfD", ["SPD", "AfD"]), ("CDU/CSU sowie bei Abgeordneten der SPD", ["CDU/CSU", "SPD"]), ("Abg. Dr. X [SPD]", ["SPD"]),
    ("AfD: Oh!", ["AfD"]), ("ganzen Hause", []), ("SPD und der SPD", ["SPD", "SPD"]),
])
def test_parties_in_annotation(spark, note, want):
    assert one(spark, note, parties_in_annotation) == want


def test_party_compare_key(spark):
    assert [one(spark, p, party_compare_key) for p in ("Bündnis 90", "Die Linke", "spd ", None)] == ["GRÜNE", "LINKE", "SPD", ""]


@pytest.mark.parametrize("raw,want", [
    ("(A [B]: Sehr richtig!)", "positive"), ("(A [B]: Unsinn!)", "negative"), ("(A [B]: Wo denn?)", "neutral"), ("ohne", "neutral"),
    ("(A [B]: Das stimmt nicht)", "positive"), ("(A [B]: Leben)", "positive"),
])
def test_sentiment(spark, raw, want):
    assert one(spark, raw, classify_sentiment) == want


def test_sentiment_whole_words(spark):
    assert one(spark, "(A [B]: Leben)", lambda c: classify_sentiment(c, match="word")) == "neutral"


@pytest.mark.parametrize("text,want", [
    ("Ich habe eine Frage zum Haushalt.", "fragestunde"), ("Vielen Dank, dass Sie die Zwischenfrage zulassen.", "zwischenfrage"),
    ("- Ich komme zum Schluss, Frau Präsidentin.", "continuation"), ("Frau Präsidentin, ich unterbreche ungern.", "continuation"),
    ("Es ist eine Frage an den Bundesfinanzminister.", "fragestunde"), ("Eine Nachfrage dazu.", "fragestunde"),
    ("Sehr geehrte Frau Präsidentin! Herr Minister!", "rede"), ("Vielen Dank. - Frau Ministerin, warum?", "fragestunde"),
    ("Herr Präsident! Guten Tag.", "rede"), ("Verehrtes Präsidium!", "rede"), ("Liebe Kolleginnen und Kollegen!", "rede"),
    ("Deutschland hat in den vergangenen Jahren viele Ortskräfte", "ortskraefte"), ("Welche Pläne hat die Bundesregierung?", "fragestunde"),
    ("Welche Pläne gibt es?", "other"), ("Nein, das ist falsch.", "zwischenfrage"), ("Herr Kollege, das stimmt.", "zwischenfrage"),
    ("Danke für die Frage.", "fragestunde_antwort"), ("Danke schön, liebe Leute.", "zwischenfrage"), ("Meine Damen und Herren!", "rede"),
    ("Guten Tag.", "other"),
])
def test_classify_start(spark, text, want):
    assert one(spark, text, ru.classify_start) == want


def test_extra_rules_and_address(spark):
    rules = ru.start_rules(extra_statements=[ru.Rule("abstimmung", ((100, "^ich stimme dem"),))])
    assert one(spark, "Ich stimme dem Antrag zu.", lambda c: ru.classify_start(c, rules)) == "abstimmung"
    assert one(spark, "Herr Präsident!", ru.starts_with_president_address) is True


def test_rules_file(spark, tmp_path):
    path = tmp_path / "rules.json"
    path.write_text('[{"label": "x", "tests": [[10, "^ab"], [0, "cd"]]}]', encoding="utf-8")
    rules = ru.load_rules(str(path))
    assert one(spark, "AB und cd", lambda c: ru.decide(c, rules)) == "x"
    assert one(spark, "AB", lambda c: ru.decide(c, rules)) == "other"


@pytest.mark.parametrize("context,want", [
    ("Ich rufe die Frage 3 auf.", "fragestunde"), ("Die nächste Hauptfrage stellt X.", "fragestunde"), ("ob es eine Nachfrage gibt", "fragestunde"),
    ("Herr Staatsminister, Sie haben das Wort.", "fragestunde_antwort"), ("Sie haben das Wort, Frau Bundesministerin.", "fragestunde_antwort"), ("Guten Tag.", None),
])
def test_preceding(spark, context, want):
    assert one(spark, context, ru.classify_preceding) == want


def test_introduction(spark):
    assert one(spark, "Das Wort hat X", ru.classify_introduction) == "formal"
    assert one(spark, "ihre REDEZEIT IST ABGELAUFEN", ru.classify_introduction) == "continuation"
