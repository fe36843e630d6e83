"""Which words set a group (or a speaker) apart from the others."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rostrum.operators.common import join_groups, top_k
from rostrum.operators.tokens import EVENT_STOPWORDS, PARTY_STOPWORDS


def _group_ratios(counts: DataFrame, totals: DataFrame, by: str, stopwords: Sequence[str]) -> DataFrame:
    """Per (group, word): n, per_1000 and its ratio to the unweighted mean of the other groups.

    The mean of the others is (sum over all groups - own) / (groups - 1), so no
    word x group matrix is built; absent words count as 0.
    """
    # one row per group: the window over the whole table sees as many rows as there are groups
    sized = totals.select(by, "total_words").filter(F.col("total_words") > 0).withColumn(
        "_groups", F.count(F.lit(1)).over(Window.partitionBy())
    )
    counted = counts.groupBy(by).agg(F.sum("n").alias("_counted"))
    freq = join_groups(counts, sized.join(counted, by), [by]).withColumn("per_1000", F.col("n") / F.col("total_words") * 1000)
    # a word has at most one row per group, so a window over a word stays small
    joined = freq.withColumn("_sum", F.sum("per_1000").over(Window.partitionBy("word")))
    others = (F.col("_sum") - F.col("per_1000")) / (F.col("_groups") - 1)
    rated = joined.filter(F.col("_groups") > 1).withColumn(
        "ratio", F.col("per_1000") / (F.greatest(others, F.lit(0.0)) + 0.001)
    )
    if stopwords:
        rated = rated.filter(~F.col("word").isin(*stopwords))
    return rated


def distinctive_words(
    counts: DataFrame, totals: DataFrame, by: str = "party", n: int = 5,
    min_share: float = 0.0005, min_ratio: float = 2.0, stopwords: Sequence[str] = tuple(EVENT_STOPWORDS + PARTY_STOPWORDS),
) -> DataFrame:
    """Top ``n`` words per group by ratio * sqrt(per_1000), for all groups in one pass.

    A word needs ``min_share`` of the group's counted words and a ratio above ``min_ratio``.
    """
    rated = _group_ratios(counts, totals, by, stopwords)
    kept = rated.filter((F.col("n") >= F.col("_counted") * min_share) & (F.col("ratio") > min_ratio)).select(
        by, "word", "n", "per_1000", "ratio", (F.col("ratio") * F.sqrt("per_1000")).alias("score")
    )
    return top_k(kept, [by], [F.desc("score"), F.asc("word")], n)


def _without_substrings(words: Column, n: int) -> Column:
    """First ``n`` entries of a short ranked list after folding words into longer ones.

    In rank order, a word contained in a kept longer word is skipped, and a word
    that contains kept shorter words replaces them; taking words stops once ``n`` are kept.
    """
    empty = "cast(array() as array<struct<rank:int,word:string,n:bigint,ratio:double>>)"

    def step(kept: Column, w: Column) -> Column:
        covered = F.exists(kept, lambda k: k["word"].contains(w["word"]) & (k["word"] != w["word"]))
        rest = F.filter(kept, lambda k: ~w["word"].contains(k["word"]))
        return F.when((F.size(kept) >= n) | covered, kept).otherwise(F.concat(rest, F.array(w)))

    return F.aggregate(words, F.expr(empty), step)


def key_topics(
    counts: DataFrame, totals: DataFrame, by: str = "party", n: int = 10,
    min_share: float = 0.0005, min_ratio: float = 1.5, stopwords: Sequence[str] = tuple(EVENT_STOPWORDS + PARTY_STOPWORDS),
) -> DataFrame:
    """Most frequent mildly distinctive words per group, with words folded into longer ones that contain them.

    The fold reads the top ``2n`` words of a group, a list of fixed length.
    """
    rated = _group_ratios(counts, totals, by, stopwords)
    kept = rated.filter((F.col("n") >= F.col("_counted") * min_share) & (F.col("ratio") > min_ratio))
    pool = top_k(kept.select(by, "word", "n", "ratio"), [by], [F.desc("n"), F.asc("word")], 2 * n)
    lists = pool.groupBy(by).agg(F.sort_array(F.collect_list(F.struct("rank", "word", "n", "ratio"))).alias("_w"))
    return lists.select(by, F.posexplode(_without_substrings(F.col("_w"), n)).alias("_p", "w")).select(
        by, F.col("w.word").alias("word"), F.col("w.n").alias("n"), F.col("w.ratio").alias("ratio"),
        (F.col("_p") + 1).alias("rank"),
    )


def exclusive_words(counts: DataFrame, by: str = "party", n: int = 3, min_count: int = 10) -> DataFrame:
    """Words used at least ``min_count`` times by one group and never by another, top ``n`` per group."""
    single = counts.groupBy("word").agg(
        F.count(F.lit(1)).alias("_groups"), F.first(by).alias(by), F.sum("n").alias("n")
    ).filter((F.col("_groups") == 1) & (F.col("n") >= min_count))
    return top_k(single.select(by, "word", "n"), [by], [F.desc("n"), F.asc("word")], n)


def signature_words(
    counts: DataFrame, n: int = 5, min_count: int = 5, min_len: int = 5, min_ratio: float = 2.0,
    stopwords: Sequence[str] = (), totals: DataFrame | None = None,
) -> DataFrame:
    """Words a speaker uses more than the rest of the party; the ratio to the rest of the corpus is added.

    ``counts(party, speaker, word, n)``. The rest is the party (corpus) minus
    the speaker, obtained by subtraction. Where the rest never uses the word,
    the ratio is ten times the speaker's per-1000. ``totals(party, speaker,
    total_words)`` gives the words of each speaker when ``counts`` holds only
    some of them (for example adjectives).
    """
    own = totals if totals is not None else counts.groupBy("party", "speaker").agg(F.sum("n").alias("total_words"))
    own = own.select("party", "speaker", F.col("total_words").alias("_own"))
    # the window over the whole table sees one row per party
    party_total = own.groupBy("party").agg(F.sum("_own").alias("_party_total")).withColumn(
        "_all_total", F.sum("_party_total").over(Window.partitionBy())
    )
    candidates = counts.filter((F.col("n") >= min_count) & (F.length("word") >= min_len))
    if stopwords:
        candidates = candidates.filter(~F.col("word").isin(*stopwords))
    party_counts = counts.groupBy("party", "word").agg(F.sum("n").alias("_party_n"))
    all_counts = party_counts.groupBy("word").agg(F.sum("_party_n").alias("_all_n"))
    sizes = own.join(party_total, "party")
    joined = join_groups(candidates.join(party_counts, ["party", "word"]).join(all_counts, "word"), sizes, ["party", "speaker"])
    rest_party, rest_all = F.col("_party_total") - F.col("_own"), F.col("_all_total") - F.col("_own")
    freq = F.col("n") / F.col("_own") * 1000

    def against(count: Column, total: Column) -> Column:
        other = (count - F.col("n")) / total * 1000
        return F.when(other > 0, freq / F.when(other > 0, other)).otherwise(freq * 10)

    rated = (
        joined.filter((rest_party > 0) & (rest_all > 0))
        .withColumn("_rp", against(F.col("_party_n"), rest_party))
        .withColumn("_rc", against(F.col("_all_n"), rest_all))
        .filter(F.col("_rp") >= min_ratio)
        .select("party", "speaker", "word", "n", F.round("_rp", 1).alias("ratio_party"), F.round("_rc", 1).alias("ratio_corpus"))
    )
    return top_k(rated, ["party", "speaker"], [F.desc("ratio_party"), F.desc("n"), F.asc("word")], n)


def signature_adjectives(counts: DataFrame, lexicon: DataFrame, n: int = 5, min_count: int = 3, min_ratio: float = 2.0) -> DataFrame:
    """``signature_words`` restricted to lexicon adjectives; rates still refer to all words of a speaker."""
    words = lexicon.filter(F.col("scheme") == "adjective").select("word").distinct()
    totals = counts.groupBy("party", "speaker").agg(F.sum("n").alias("total_words"))
    return signature_words(
        counts.join(words, "word", "left_semi"), n=n, min_count=min_count, min_len=1, min_ratio=min_ratio, totals=totals
    )
