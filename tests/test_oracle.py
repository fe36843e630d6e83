"""Every registered query against its SQL on the same files."""

import os
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entries

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}

pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def ordered(names, rows):
    at = [names.index(c) for c in sorted(names)]
    return sorted((tuple(r[i] for i in at) for r in rows), key=lambda r: tuple((x is None, repr(x)) for x in r))


@pytest.mark.parametrize("name", sorted(entries.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = entries.queries()[name](spark, SF)
    result = duck.sql(entries.oracle_sql()[name])
    assert sorted(df.columns) == sorted(result.columns)
    kinds = dict(df.dtypes)
    assert {c: TYPES[kinds[c]] for c in df.columns} == {c: str(t) for c, t in zip(result.columns, result.types)}
    assert ordered(df.columns, df.collect()) == ordered(result.columns, result.fetchall())


@pytest.mark.parametrize("name", sorted(set(entries.queries()) - set(entries.oracle_sql())))
def test_query_without_sql_runs(spark, name):
    assert entries.queries()[name](spark, SF).count() >= 0


def test_every_oracle_has_a_query():
    assert set(entries.oracle_sql()) <= set(entries.queries())


def test_entry(spark):
    assert entries.entry(spark).count() > 0
