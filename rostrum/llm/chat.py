"""Tool calls of conversations: linked with their results, ordered by dependency, checked and written as canonical JSON."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rostrum.llm.common import kept
from rostrum.operators.common import distributed_rank


@dataclass(frozen=True)
class Argument:
    """What a tool's schema says of one argument; bounds hold for numbers."""

    tool: str
    name: str
    kind: str
    required: bool = True
    least: float | None = None
    most: float | None = None


#: Variant types that satisfy a schema's type.
KINDS = {"string": ("STRING",), "integer": ("BIGINT",), "number": ("BIGINT", "DOUBLE", "DECIMAL", "FLOAT"), "boolean": ("BOOLEAN",), "array": ("ARRAY",), "object": ("OBJECT",)}


def violations(tool: Column, arguments: Column, schema: Sequence[Argument]) -> Column:
    """What is wrong with the arguments of a call, as an array of ``name: fault`` in the order of the schema.

    Malformed JSON, JSON that is no object, and tools without a schema are one fault each.
    """
    value = F.try_parse_json(arguments)
    kind = F.schema_of_variant(value)
    faults: list[Column] = []
    for a in schema:
        path = f"$.{a.name}"
        found = F.schema_of_variant(F.try_variant_get(value, path, "variant"))
        fits = reduce(lambda x, y: x | y, [found.startswith(k) for k in KINDS[a.kind]])
        number = F.try_variant_get(value, path, "double")
        fault = F.when(found.isNull(), F.lit(f"{a.name}: missing") if a.required else F.lit(None)).when(~fits, F.lit(f"{a.name}: not {a.kind}"))
        if a.least is not None:
            fault = fault.when(number < a.least, F.lit(f"{a.name}: too small"))
        if a.most is not None:
            fault = fault.when(number > a.most, F.lit(f"{a.name}: too large"))
        faults.append(F.when(tool == a.tool, fault))
    known = [
        F.when(tool == t, F.array(*[F.lit(a.name) for a in schema if a.tool == t])) for t in dict.fromkeys(a.tool for a in schema)
    ]
    names = F.coalesce(*known, F.array().cast("array<string>"))
    extra = F.transform(F.array_sort(F.array_except(F.coalesce(F.json_object_keys(F.when(kind.startswith("OBJECT"), arguments)), F.array().cast("array<string>")), names)), lambda n: F.concat(n, F.lit(": unknown")))
    one = F.when(value.isNull(), F.lit("malformed JSON")).when(~kind.startswith("OBJECT"), F.lit("not an object")).when(
        ~F.coalesce(tool.isin(*{a.tool for a in schema}), F.lit(False)), F.lit("unknown tool"))
    listed = F.filter(F.array(*faults, F.lit(None).cast("string")), lambda x: x.isNotNull())
    return F.when(one.isNotNull(), F.array(one)).otherwise(F.concat(listed, extra))


def levels(calls: DataFrame) -> DataFrame:
    """``_id, level``: 0 for calls that wait for none, else one more than the highest call they wait for.

    ``calls`` has ``_id`` and ``depends_on``; names of no call are ignored. Each round takes out the calls whose
    dependencies are all out, so there is a round per level; calls on a cycle, or behind one, get no row.
    """
    ids = kept(calls.select("_id", "depends_on").dropDuplicates(["_id"]), "calls")
    edges = ids.select("_id", F.explode("depends_on").alias("_on")).distinct()
    edges = kept(edges.join(ids.select(F.col("_id").alias("_on")), "_on", "left_semi"), "dependencies")
    waiting = kept(edges.select("_id").distinct(), "waiting")
    out = ids.join(waiting, "_id", "left_anti").select("_id", F.lit(0).cast("long").alias("level"))
    level = 0
    left = waiting.count()
    while left:
        level += 1
        open_ = edges.join(waiting.select(F.col("_id").alias("_on")), "_on", "left_semi").select("_id").distinct()
        still = kept(waiting.join(open_, "_id", "left_semi"), "waiting")
        out = out.unionByName(waiting.join(still, "_id", "left_anti").select("_id", F.lit(level).cast("long").alias("level")))
        waiting, before, left = still, left, still.count()
        if left == before:
            break
    return out


def link_calls(calls: DataFrame, results: DataFrame, schema: Sequence[Argument]) -> DataFrame:
    """One row per call, and per identifier that only results name.

    ``calls``: conv_id, call_id, position, tool, arguments (JSON), depends_on (array of call ids of the conversation).
    ``results``: conv_id, call_id, position, content. Calls and results meet by conversation and call id; of several
    with one id the one with the smallest position counts (then the smaller content), and ``n_calls`` and
    ``n_results`` tell how many there were. Rows without a conversation or call id are left out.

    Result: ``conv_id, call_id, tool, level, ord, status, errors, json``. ``ord`` numbers the calls of a conversation
    in topological order, by level, position and id; a call on or behind a cycle comes last, with level null.
    ``status`` is the first that holds of orphan (no call), cycle, invalid (arguments), unanswered, late (the result
    stands before the call), ok. ``json`` has sorted keys at every depth and no spaces; arguments that cannot be read
    are kept as a string. Empty tables give no rows; other columns are not read.
    """
    key = F.to_json(F.struct(F.col("conv_id").cast("string").alias("a"), F.col("call_id").alias("b")))
    named = F.col("conv_id").isNotNull() & F.col("call_id").isNotNull()
    first = calls.filter(named).withColumn("_id", key).groupBy("_id", "conv_id", "call_id").agg(
        F.min(F.struct("position", "tool", "arguments", "depends_on")).alias("c"), F.count(F.lit(1)).alias("n_calls"))
    conv = F.col("conv_id").cast("string")
    first = first.select(
        "_id", "conv_id", "call_id", "c.position", "c.tool", "c.arguments", "n_calls",
        F.transform(F.coalesce("c.depends_on", F.array().cast("array<string>")), lambda d: F.to_json(F.struct(conv.alias("a"), d.alias("b")))).alias("depends_on"),
    )
    first = kept(first, "first-calls")
    answer = results.filter(named).withColumn("_id", key).groupBy("_id", "conv_id", "call_id").agg(
        F.min(F.struct("position", "content")).alias("r"), F.count(F.lit(1)).alias("n_results"))
    answer = answer.select("_id", F.col("conv_id").alias("_conv"), F.col("call_id").alias("_call"), F.col("r.position").alias("_at"), F.col("r.content").alias("result"), "n_results")
    both = first.drop("depends_on").join(answer, "_id", "full").join(levels(first), "_id", "left")
    is_call = F.col("n_calls").isNotNull()
    errors = F.when(is_call, violations(F.col("tool"), F.col("arguments"), schema)).otherwise(F.array().cast("array<string>"))
    both = both.withColumn("errors", errors).withColumn("conv_id", F.coalesce("conv_id", "_conv")).withColumn("call_id", F.coalesce("call_id", "_call"))
    status = (
        F.when(~is_call, "orphan").when(F.col("level").isNull(), "cycle").when(F.size("errors") > 0, "invalid")
        .when(F.col("n_results").isNull(), "unanswered").when(F.col("_at") < F.col("position"), "late").otherwise("ok")
    )
    value = F.try_parse_json(F.col("arguments"))
    text = lambda c: F.coalesce(F.substring(F.to_json(F.array(c)), 2, 2147483647), F.lit("null]"))
    quoted = lambda c: F.expr(f"substring({'_q' + c}, 1, length({'_q' + c}) - 1)")
    both = both.withColumn("status", status)
    for c in ("arguments", "call_id", "result", "tool", "status"):
        both = both.withColumn(f"_q{c}", text(F.col(c)))
    line = F.concat(
        F.lit('{"arguments":'), F.coalesce(F.to_json(value), quoted("arguments")), F.lit(',"call_id":'), quoted("call_id"),
        F.lit(',"result":'), quoted("result"), F.lit(',"status":'), quoted("status"), F.lit(',"tool":'), quoted("tool"), F.lit("}"),
    )
    both = both.withColumn("json", line)
    ordered = distributed_rank(
        both.select("conv_id", "call_id", "tool", "level", "status", "errors", "json", "n_calls", "n_results", F.coalesce("position", "_at").alias("_position")),
        ["conv_id"], [F.asc_nulls_last("level"), F.asc("_position"), F.asc("call_id")], "ord",
    )
    return ordered.drop("_position").withColumn("ord", F.col("ord").cast("long"))
