"""Rows on which a query and its SQL once gave different answers."""

from datetime import datetime

import duckdb
import pytest

import __spark_entry__ as entries


def both(spark, folder, table, name):
    """Rows of a query and of its SQL, columns by name."""
    duckdb.sql(f"COPY ({table[1]}) TO '{folder}/{table[0]}.parquet'")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW {table[0]} AS SELECT * FROM '{folder}/{table[0]}.parquet'")
    df, result = entries.queries()[name](spark, str(folder)), con.sql(entries.oracle_sql()[name])
    cols = sorted(df.columns)
    got = sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)
    want = sorted((tuple(r[result.columns.index(c)] for c in cols) for r in result.fetchall()), key=repr)
    return [dict(zip(cols, r)) for r in got], [dict(zip(cols, r)) for r in want]


def test_clicks_in_the_second_of_the_purchase(spark, tmp_path):
    """Parts of a second decide what lies after a purchase, and what lies within a day of it."""
    at = lambda day, second, micro: datetime(2024, 1, day, 10, 0, second, micro)
    rows = [
        (1, at(1, 5, 700_000), 1, "purchase"), (2, at(1, 5, 200_000), 1, "click"), (3, at(1, 5, 900_000), 1, "click"), (4, at(2, 5, 699_999), 1, "click"), (5, at(2, 5, 700_000), 1, "click"),
        (6, at(1, 5, 400_000), 2, "purchase"), (7, at(1, 5, 300_000), 2, "click"), (8, at(1, 5, 600_000), 2, "click"), (9, at(2, 5, 300_000), 2, "click"), (10, at(2, 5, 600_000), 2, "click"),
    ]
    values = ", ".join(f"({i}::BIGINT, TIMESTAMP '{t}', {u}::BIGINT, '{kind}')" for i, t, u, kind in rows)
    got, want = both(spark, tmp_path, ("events", f"SELECT * FROM (VALUES {values}) t(event_id, ts, user_id, event_type)"), "in_range_counts")
    assert got == want == [{"clicks": 2, "event_id": 1}, {"clicks": 2, "event_id": 6}]


@pytest.mark.parametrize("name", ["classify_start", "parse_protocols"])
def test_texts_that_begin_like_a_reply(spark, tmp_path, name):
    """Where no words are put in front, the text's own decide the label."""
    starts = ["Ja gallen por al", "Nein, das ist", "Also, wir sind", "Was die Bundesregierung plant", "Danke für die Frage, die", "Jagallen por al", "ICH UNTERBRECHE (kurz)"]
    tail = " wort" * 70
    rows = [(7 * i + 2, turn, "user" if turn % 2 == 0 else "assistant", text + tail) for i, text in enumerate(starts) for turn in range(4)]
    values = ", ".join(f"({c}::BIGINT, {t}::BIGINT, '{role}', '{text}')" for c, t, role, text in rows)
    got, want = both(spark, tmp_path, ("conversations", f"SELECT * FROM (VALUES {values}) t(conv_id, turn, role, text)"), name)
    assert got == want
    label = "start_type" if name == "classify_start" else "type"
    assert "zwischenfrage" in {r[label] for r in got}
