"""Spelling variants: words one edit apart, each led to the much more frequent form it may stand for."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rostrum.llm.common import kept

#: Letters of a word.
LETTERS = r"A-Za-zÀ-ÿ"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Words of one chunk list that meet the grams of a cell; longer lists are dealt over several cells.
BLOCK = 512


def ascii_lower(text: Column) -> Column:
    """``text`` with A-Z in lower case and nothing else changed."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def word_counts(docs: DataFrame, least_length: int = 6, least_count: int = 5, id_col: str = "doc_id", text_col: str = "text", respell: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """``word, n``: the words of all texts with at least ``least_length`` code points and ``least_count`` occurrences.

    A word is a maximal run of :data:`LETTERS` with A-Z in lower case. ``respell(id, word)`` may change each occurrence
    (the id is a string, empty for null) before lengths and counts are taken; it must not lengthen words. Null texts
    have no words; rows that repeat count each time. Occurrences are combined before the shuffle.
    """
    name, long = F.coalesce(F.col(id_col).cast("string"), F.lit("")), f"[{LETTERS}]{{{least_length},}}"  # shorter runs stay short
    runs = docs.select(name.alias("id"), F.explode(F.regexp_extract_all(F.col(text_col), F.lit(long), F.lit(0))).alias("word"))
    runs = runs.select("id", ascii_lower(F.col("word")).alias("word"))
    if respell is not None:
        runs = runs.select(respell(F.col("id"), F.col("word")).alias("word"))
    counts = runs.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counts.filter((F.col("n") >= least_count) & (F.length("word") >= least_length))


def near_pairs(words: DataFrame, least_length: int = 6) -> DataFrame:
    """``a, b, n_a, n_b``: every pair of distinct words that are exactly one edit apart, once.

    The shorter word (of equal ones the smaller) contributes two disjoint chunks, its first and last ``length // 2``
    code points; one edit leaves one of them whole. The longer word contributes positional grams: of all its grams only
    those at shift 0 and, for what follows an inserted code point, shift 1 can meet a chunk in place, so just these are
    sent. Between words of one length nothing shifts; past an insertion behind the first chunk that chunk is met at
    shift 0, past one in or before it the last chunk is met at shift 1. Words meet by an equi join on (length, chunk, gram) and are
    verified; a pair that both chunks find is taken from the first. Lists of more than :data:`BLOCK` words are dealt
    over cells, to which the grams that meet them are repeated.
    """
    size = F.length("word")
    half = F.col("len").bitwiseAND(-2) / 2

    def pieces(shift: int) -> Column:
        """Of a word ``shift`` longer than its partner of length ``len``: (chunk, what stands in its place)."""
        q = half.cast("int")
        return F.array(
            F.struct(F.lit(0).alias("chunk"), F.substring("word", F.lit(1), q).alias("gram")),
            F.struct(F.lit(1).alias("chunk"), F.substring("word", F.col("len") - q + 1 + shift, q).alias("gram")),
        )

    sized = words.select("word", "n", size.alias("len"))
    chunks = sized.select("len", F.inline(pieces(0)), F.col("word").alias("a"), F.col("n").alias("n_a"))
    grams = [
        words.select("word", "n", (size - shift).alias("len")).filter(F.col("len") >= least_length).select("len", F.inline(pieces(shift)), F.col("word").alias("b"), F.col("n").alias("n_b"))
        for shift in (0, 1)
    ]
    grams = grams[0].unionByName(grams[1])
    on = ["len", "chunk", "gram"]
    hot = kept(chunks.groupBy(*on).agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") > BLOCK).withColumn("cells", F.ceil(F.col("size") / BLOCK)).drop("size"), "hot-chunks")
    cells = F.coalesce(F.col("cells"), F.lit(1))
    chunks = chunks.join(hot, on, "left").withColumn("cell", F.pmod(F.xxhash64("a"), cells)).drop("cells")
    grams = grams.join(hot, on, "left").withColumn("cell", F.explode(F.sequence(F.lit(0).cast("long"), cells - 1))).drop("cells")
    met = chunks.join(grams, [*on, "cell"])
    q = half.cast("int")
    first = (F.col("chunk") == 0) | (F.substring("a", F.lit(1), q) != F.substring("b", F.lit(1), q))
    once = (F.length("b") > F.length("a")) | (F.col("a") < F.col("b"))
    return met.filter(first & once & (F.levenshtein("a", "b", 1) == 1)).select("a", "b", "n_a", "n_b")


def variant_groups(words: DataFrame, ratio: int = 5, least_length: int = 6) -> DataFrame:
    """One row per word of ``words(word, n)``: ``word, form, root, n, n_near, form_n``.

    ``n_near`` counts the words one edit apart. ``form`` is the most frequent of them (ties: the smallest in code-point
    order) if it is at least ``ratio`` times as frequent as the word, else null, and ``form_n`` its count. ``root`` is
    where following forms ends. Counts grow by ``ratio`` at each step, so chains are short and end; they are followed
    by doubling, with each round on reliable storage. ``words`` must hold each word once, with no null and none shorter
    than ``least_length``; an empty table gives no rows.
    """
    if ratio < 2:
        raise ValueError("forms must be at least twice as frequent as their variants")
    words = kept(words.select("word", "n"), "words")
    both = F.array(
        F.struct(F.col("a").alias("word"), F.struct((-F.col("n_b")).alias("less"), F.col("b").alias("near")).alias("hit")),
        F.struct(F.col("b").alias("word"), F.struct((-F.col("n_a")).alias("less"), F.col("a").alias("near")).alias("hit")),
    )
    best = near_pairs(words, least_length).select(F.inline(both)).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min("hit").alias("hit"))
    often = -F.col("hit.less") >= F.col("n") * ratio
    rows = kept(
        words.join(best, "word", "left").select(
            "word", F.when(often, F.col("hit.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(often, -F.col("hit.less")).alias("form_n")
        ),
        "forms",
    )
    least, most = rows.agg(F.min("n"), F.max("n")).first()
    steps = int(math.log(most / max(1, least), ratio)) + 1 if most else 0
    roots = rows.filter("form IS NOT NULL").select("word", F.col("form").alias("root"))
    for _ in range(math.ceil(math.log2(steps)) if steps > 1 else 0):
        on = roots.select(F.col("word").alias("_at"), F.col("root").alias("_next"))
        roots = kept(roots.join(on, F.col("root") == F.col("_at"), "left").select("word", F.coalesce("_next", "root").alias("root")), "roots")
    out = rows.join(roots, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
