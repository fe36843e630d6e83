"""Decision lists as tables: literal openings meet texts in an equi join, other rules are tested in the row."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rostrum.functions.rules import Rule
from rostrum.operators.common import lookup_frame, pinned

#: A rule holds where all its tests do; a test looks at the first ``window`` characters in lower case (0: all).
RULE_SCHEMA = "priority long, label string, tests array<struct<window:int,kind:string,pattern:string>>"
#: Kinds of tests: the text begins with, contains, or matches the pattern.
STARTS, CONTAINS, REGEX = "starts", "contains", "regex"
#: Rules that are no literal openings, and different lengths of openings, that one table may hold.
MOST_TESTED, MOST_LENGTHS = 1000, 300


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """Rules from JSON lines with the fields of :data:`RULE_SCHEMA`; the smallest priority is tested first."""
    return spark.read.schema(RULE_SCHEMA).json(path)


def rule_table(spark: SparkSession, rules: Sequence[Rule], step: int = 1000) -> DataFrame:
    """Built-in rules as a table, with room for others between their priorities."""
    rows = [((i + 1) * step, r.label, [{"window": n, "kind": REGEX, "pattern": p} for n, p in r.tests]) for i, r in enumerate(rules)]
    return lookup_frame(spark, rows, RULE_SCHEMA)


def _tested(row, windows: dict[int, Column]) -> Column:
    """Whether a rule that is no literal opening holds."""
    out = F.lit(True)
    for test in row.tests:
        quoted = {REGEX: test.pattern, CONTAINS: re.escape(test.pattern.lower()), STARTS: "^" + re.escape(test.pattern.lower())}[test.kind]
        out = out & windows[test.window].rlike(quoted)
    return out


def classify_by_table(df: DataFrame, rules: DataFrame, keys: Sequence[str], text: str = "text", default: str | None = "other") -> DataFrame:
    """``(keys..., label)``: the label of the rule of smallest priority that holds for each text.

    Rules with one literal opening may be many: a text sends its beginnings in the lengths that occur, and they meet the
    openings in an equi join. The others, at most :data:`MOST_TESTED`, are tested in the row, in order. No text is
    shuffled, only keys and priorities. ``keys`` must tell the rows apart; null texts count as empty; of rules with
    one priority the smaller label counts.
    """
    only = F.element_at("tests", 1)
    literal = (F.size("tests") == 1) & (only["kind"] == STARTS) & (only["pattern"] != "")
    prefix = F.lower(only["pattern"])
    fits = (only["window"] == 0) | (F.length(only["pattern"]) <= only["window"])
    hit = F.struct("priority", "label")
    openings = rules.filter(literal & fits).select(prefix.alias("_opening"), hit.alias("_hit")).groupBy("_opening").agg(F.min("_hit").alias("_hit"))
    lengths = sorted(r[0] for r in openings.select(F.length("_opening").alias("n")).distinct().limit(MOST_LENGTHS + 1).collect())
    tested = rules.filter(~literal).orderBy("priority", "label").limit(MOST_TESTED + 1).collect()
    if len(lengths) > MOST_LENGTHS or len(tested) > MOST_TESTED:
        raise ValueError(f"a table may hold {MOST_TESTED} rules that are no literal openings, and openings of {MOST_LENGTHS} lengths")

    sizes = sorted({t.window for r in tested for t in r.tests})
    whole = F.coalesce(F.col(text), F.lit(""))
    heads = {n: F.lower(F.substring(whole, 1, n)) if n else F.lower(whole) for n in sizes}
    longest = max(lengths, default=0)
    rows = pinned(df, _begin=F.lower(F.substring(whole, 1, longest)), **{f"_w{n}": c for n, c in heads.items()})
    windows = {n: F.col(f"_w{n}") for n in sizes}
    none = F.struct(F.lit((1 << 63) - 1).alias("priority"), F.lit(default).cast("string").alias("label"))
    first = None
    for r in tested:
        value = F.struct(F.lit(r.priority).cast("long").alias("priority"), F.lit(r.label).alias("label"))
        first = F.when(_tested(r, windows), value) if first is None else first.when(_tested(r, windows), value)
    hits = rows.select(*keys, (none if first is None else first.otherwise(none)).alias("_hit"))
    if lengths:
        begun = rows.select(*keys, "_begin", F.explode(F.array(*[F.lit(n) for n in lengths])).alias("_n")).filter(F.length("_begin") >= F.col("_n"))
        begun = begun.select(*keys, F.substring("_begin", F.lit(1), F.col("_n")).alias("_opening")).join(openings, "_opening")
        hits = hits.unionByName(begun.select(*keys, "_hit"))
    return hits.groupBy(*keys).agg(F.min("_hit").alias("_hit")).select(*keys, F.col("_hit.label").alias("label"))
