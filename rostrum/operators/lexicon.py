"""Lexicon categories, tone and topic scores.

A lexicon is a table ``(scheme, category, word, weight)``. It is joined to
aggregated counts, never to raw tokens, and no join is forced to broadcast:
Spark does so while the lexicon is small.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rostrum.functions.text import tokenize
from rostrum.functions.words import STYLE_WORDS
from rostrum.operators.common import lookup_frame, ratio, sum_if, top_k

LEXICON_SCHEMA = "scheme string, category string, word string, weight double"

# The word type that each scheme is compared with.
SCHEME_WORD_TYPE = {
    "adjective": "adjective", "verb": "verb", "topic": "noun",
    "modal": "all", "temporal": "all", "intensity": "all", "pronoun": "all", "discriminatory": "all",
}

# Score name, scheme, categories counted, categories compared with (None = all of the scheme).
RATIO_SCORES = [
    ("affirmative", "adjective", "affirmative", "critical"),
    ("solution_focus", "verb", "solution", "problem"),
    ("collaboration", "verb", "collaborative", "confrontational"),
    ("authority", "modal", "obligation", "possibility"),
    ("future_orientation", "temporal", "prospective", "retrospective"),
    ("emotional_intensity", "intensity", "intensifier", "moderator"),
    ("inclusivity", "pronoun", "inclusive", "exclusive"),
]
INDEX_SCORES = [
    ("aggression", "adjective", "aggressive"),
    ("labeling", "adjective", "labeling"),
    ("demand_intensity", "verb", "demanding"),
    ("acknowledgment", "verb", "acknowledging"),
]
TONE_METRICS = [s[0] for s in RATIO_SCORES] + [s[0] for s in INDEX_SCORES] + ["discriminatory"]

# Other names of the metrics.
METRIC_ALIASES = {
    "aggressiveness": "aggression", "positivity": "affirmative", "cooperation": "collaboration", "hope": "solution_focus",
}
TOPICS = [
    "migration", "klima", "wirtschaft", "soziales", "sicherheit", "gesundheit", "europa",
    "digital", "bildung", "finanzen", "justiz", "arbeit", "mobilitaet",
]


def build_lexicon(spark: SparkSession, entries: Sequence[tuple[str, str, str, float]], on_conflict: str = "last") -> DataFrame:
    """Lexicon table with one category per (scheme, word).

    Entries are ``(scheme, category, word, weight)`` in order. For a word in two
    categories of a scheme the last (or ``first``) entry counts; ``all`` keeps every entry.
    """
    rows = [(scheme, category, word.lower(), float(weight), i) for i, (scheme, category, word, weight) in enumerate(entries)]
    df = lookup_frame(spark, rows, LEXICON_SCHEMA + ", ord long")
    return dedupe_lexicon(df, "ord", on_conflict)


def style_lexicon(spark: SparkSession) -> DataFrame:
    """The built-in style markers (modal verbs, time, intensity, pronouns) as a lexicon table."""
    entries = [
        (scheme, category, word, 1.0)
        for scheme, categories in STYLE_WORDS.items()
        for category, words in categories.items()
        for word in words
    ]
    return build_lexicon(spark, entries)


def dedupe_lexicon(df: DataFrame, order: str, on_conflict: str = "last") -> DataFrame:
    """Keep one category per (scheme, word) of a lexicon table with an order column."""
    if on_conflict == "all":
        return df.select("scheme", "category", "word", "weight")
    pick = F.max_by if on_conflict == "last" else F.min_by
    best = df.groupBy("scheme", "word").agg(pick(F.struct("category", "weight"), F.col(order)).alias("_b"))
    return best.select("scheme", "_b.category", "word", "_b.weight")


def categorize(counts: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Counts joined with the lexicon: adds ``scheme, category, weight``.

    Where counts carry a ``word_type``, a scheme only applies to its own word
    type; untyped counts are compared with every scheme.
    """
    lex = lexicon.select("scheme", "category", F.col("word").alias("_word"), "weight")
    on = F.lower("word") == F.col("_word")
    if "word_type" in counts.columns:
        kinds = F.create_map(*[F.lit(x) for kv in SCHEME_WORD_TYPE.items() for x in kv])
        lex = lex.withColumn("_type", kinds[F.col("scheme")])
        on = on & (F.col("word_type") == F.col("_type"))
    return counts.join(lex, on).drop("_word", "_type")


def primary_topic(multi_label: DataFrame, single: DataFrame | None = None) -> DataFrame:
    """One topic per word: the highest weight (first listed wins ties); other words keep their single label.

    ``multi_label(word, category, weight, ord)``, ``single(word, category)``.
    """
    best = multi_label.groupBy("word").agg(
        F.max_by("category", F.struct(F.col("weight"), -F.col("ord"))).alias("category")
    )
    if single is None:
        return best
    rest = single.select("word", "category").join(best, "word", "left_anti")
    return best.unionByName(rest)


def topic_counts_weighted(counts: DataFrame, single: DataFrame, multi_label: DataFrame, by: Sequence[str]) -> DataFrame:
    """Topic counts per word: a multi-label word adds ``floor(n * weight)`` to each of its topics, others ``n`` to their one.

    Weighted counts are cut to whole numbers per (group, word), so they must not be rolled up further.
    """
    multi = multi_label.select("word", "category", "weight")
    rest = single.select("word", "category", F.lit(1.0).alias("weight")).join(
        multi.select("word").distinct(), "word", "left_anti"
    )
    labels = multi.unionByName(rest)
    grouped = counts.groupBy(*by, "word").agg(F.sum("n").alias("n"))
    whole = F.when(F.col("weight") < 1, F.floor(F.col("n") * F.col("weight"))).otherwise(F.col("n")).cast("long")
    return (
        grouped.join(labels, "word")
        .select(*by, "category", "word", whole.alias("n"))
        .filter(F.col("n") > 0)
    )


def multi_label_tags(counts: DataFrame, tags: DataFrame, by: Sequence[str]) -> DataFrame:
    """Weighted tag totals: every tag of a word receives ``n * weight``."""
    return (
        counts.join(tags.select("word", F.col("category").alias("tag"), "weight"), "word")
        .groupBy(*by, "tag")
        .agg(F.sum(F.col("n") * F.col("weight")).alias("weighted"), F.sum("n").alias("n"))
    )


def category_totals(cat: DataFrame, by: Sequence[str]) -> DataFrame:
    """Words per scheme and category."""
    return cat.groupBy(*by, "scheme", "category").agg(F.sum("n").alias("n"))


def top_words_per_category(cat: DataFrame, by: Sequence[str], k: int = 50) -> DataFrame:
    """Most frequent words of every category per group."""
    words = cat.groupBy(*by, "scheme", "category", "word").agg(F.sum("n").alias("n"))
    return top_k(words, [*by, "scheme", "category"], [F.desc("n"), F.asc("word")], k)


def _tone_sums(of) -> list[Column]:
    """Aggregates behind the tone scores; ``of(scheme, category)`` counts words of a category (None = whole scheme)."""
    aggs = []
    for name, scheme, a, b in RATIO_SCORES:
        aggs += [of(scheme, a).alias(f"_{name}_a"), of(scheme, b).alias(f"_{name}_b")]
    for name, scheme, category in INDEX_SCORES:
        aggs.append(of(scheme, category).alias(f"_{name}_a"))
    return aggs + [of("adjective", None).alias("_adjective"), of("verb", None).alias("_verb"), of("discriminatory", None).alias("_disc")]


def _tone_columns(total: str) -> list[Column]:
    scores = []
    for name, _, _, _ in RATIO_SCORES:
        a, b = F.col(f"_{name}_a"), F.col(f"_{name}_b")
        scores.append(ratio(a, a + b, 50.0, 100).alias(name))
    for name, scheme, _ in INDEX_SCORES:
        scores.append(ratio(F.col(f"_{name}_a"), F.col(f"_{scheme}"), 0.0, 100).alias(name))
    return [*scores, ratio(F.col("_disc"), F.col(total), 0.0, 1000).alias("discriminatory")]


def tone_scores(cat: DataFrame, totals: DataFrame, by: Sequence[str], total: str = "total_words") -> DataFrame:
    """Twelve tone scores per group of ``totals`` in one aggregation.

    Ratio pairs give ``100 * a / (a + b)`` and 50 without evidence; index scores
    give the share of their scheme's categorised words in percent and 0 without
    evidence; ``discriminatory`` counts per 1000 words.
    """

    def of(scheme: str, category: str | None) -> Column:
        cond = F.col("scheme") == scheme
        return sum_if(cond if category is None else cond & (F.col("category") == category), F.col("n"))

    joined = totals.select(*by, total).join(cat.groupBy(*by).agg(*_tone_sums(of)), list(by), "left")
    return joined.select(*by, total, *_tone_columns(total))


def wide_lexicon(lexicon: DataFrame) -> DataFrame:
    """One row per word with its category in every scheme (null where it has none)."""
    return lexicon.groupBy(F.col("word").alias("_word")).agg(
        *[F.max(F.when(F.col("scheme") == s, F.col("category"))).alias(f"_in_{s}") for s in SCHEME_WORD_TYPE]
    )


def _with_categories(counts: DataFrame, lexicon: DataFrame) -> DataFrame:
    # a left join keeps words outside the lexicon, so totals come from the same pass
    return counts.join(wide_lexicon(lexicon), F.lower("word") == F.col("_word"), "left")


def tone_from_counts(counts: DataFrame, lexicon: DataFrame, by: Sequence[str]) -> DataFrame:
    """``tone_scores`` straight from untyped ``counts(by..., word, n)``, reading them once."""

    def of(scheme: str, category: str | None) -> Column:
        hit = F.col(f"_in_{scheme}").isNotNull() if category is None else F.col(f"_in_{scheme}") == category
        return sum_if(hit, F.col("n"))

    sums = _with_categories(counts, lexicon).groupBy(*by).agg(F.sum("n").alias("total_words"), *_tone_sums(of))
    return sums.select(*by, "total_words", *_tone_columns("total_words"))


def topics_from_counts(counts: DataFrame, lexicon: DataFrame, by: Sequence[str], topics: Sequence[str] = TOPICS) -> DataFrame:
    """``topic_scores`` straight from untyped ``counts(by..., word, n)``, reading them once."""
    hits = [sum_if(F.col("_in_topic") == t, F.col("n")).alias(f"_t{i}") for i, t in enumerate(topics)]
    sums = _with_categories(counts, lexicon).groupBy(*by).agg(F.sum("n").alias("_total"), *hits)
    rows = [F.struct(F.lit(t).alias("topic"), F.col(f"_t{i}").alias("n")) for i, t in enumerate(topics)]
    return sums.select(*by, "_total", F.inline(F.array(*rows))).select(
        *by, "topic", "n", ratio(F.col("n"), F.col("_total"), 0.0, 1000).alias("score")
    )


def topic_scores(cat: DataFrame, totals: DataFrame, by: Sequence[str], topics: Sequence[str] = TOPICS, total: str = "total_words") -> DataFrame:
    """Per group and topic: words per 1000; topics without words and groups without tokens score 0."""
    grid = totals.select(*by, total, F.explode(F.array(*[F.lit(t) for t in topics])).alias("topic"))
    counted = cat.filter(F.col("scheme") == "topic").groupBy(*by, F.col("category").alias("topic")).agg(F.sum("n").alias("n"))
    return grid.join(counted, [*by, "topic"], "left").select(
        *by, "topic", F.coalesce("n", F.lit(0)).alias("n"), ratio(F.coalesce("n", F.lit(0)), F.col(total), 0.0, 1000).alias("score")
    )


def top_topics(scores: DataFrame, by: Sequence[str], n: int = 5, positive_only: bool = False) -> DataFrame:
    """Highest-scoring topics per group."""
    source = scores.filter(F.col("score") > 0) if positive_only else scores
    return top_k(source, by, [F.desc("score"), F.asc("topic")], n)


def speaker_tone(
    counts: DataFrame, cat: DataFrame, contributions: DataFrame, by: Sequence[str] = ("party", "speaker"),
    min_speeches: int = 3, min_words: int = 300,
) -> DataFrame:
    """Tone scores per speaker with sample sizes and a ``confidence`` of ``sufficient`` or ``low``.

    ``contributions(by..., contributions)`` counts the speeches of each speaker.
    """
    totals = contributions.join(counts.groupBy(*by).agg(F.sum("n").alias("_t")), list(by), "left").select(
        *by, "contributions", F.coalesce("_t", F.lit(0)).alias("total_words")
    )
    sizes = cat.groupBy(*by).agg(
        sum_if(F.col("scheme") == "adjective", F.col("n")).alias("adjectives"),
        sum_if(F.col("scheme") == "verb", F.col("n")).alias("verbs"),
    )
    enough = (F.col("contributions") >= min_speeches) & (F.col("total_words") >= min_words)
    return (
        tone_scores(cat, totals, by)
        .join(totals.select(*by, "contributions"), list(by))
        .join(sizes, list(by), "left")
        .na.fill(0, ["adjectives", "verbs"])
        .withColumn("confidence", F.when(enough, "sufficient").otherwise("low"))
    )


def speaker_topics(
    counts: DataFrame, cat: DataFrame, by: Sequence[str] = ("party", "speaker"), topics: Sequence[str] = TOPICS,
    top: int = 5, top_words: int = 5,
) -> DataFrame:
    """Per speaker the top topics (score above 0, 2 decimals) with rank and their top words."""
    totals = counts.groupBy(*by).agg(F.sum("n").alias("total_words")).filter(F.col("total_words") > 0)
    scores = topic_scores(cat, totals, by, topics).withColumn("score", F.round("score", 2))
    best = top_topics(scores, by, top, positive_only=True)
    words = top_words_per_category(cat.filter(F.col("scheme") == "topic"), by, top_words)
    lists = words.groupBy(*by, F.col("category").alias("topic")).agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct("rank", "word", "n"))), lambda w: F.struct(w["word"].alias("word"), w["n"].alias("n"))
        ).alias("words")
    )
    return best.join(lists, [*by, "topic"], "left")


def group_topics(counts: DataFrame, cat: DataFrame, by: str = "party", topics: Sequence[str] = TOPICS, top: int = 6) -> DataFrame:
    """Topic scores (2 decimals) per group and overall (group null), with the rank of the first ``top`` topics of each.

    Groups come from aggregated counts; the overall row is a roll-up of the group rows.
    """
    totals = counts.groupBy(by).agg(F.sum("n").alias("_t"))
    totals = totals.rollup(by).agg(F.sum("_t").alias("total_words"), F.grouping(by).alias("overall"))
    hits = cat.filter(F.col("scheme") == "topic").groupBy(by, F.col("category").alias("topic")).agg(F.sum("n").alias("_n"))
    hits = hits.groupingSets([[F.col("topic"), F.col(by)], [F.col("topic")]], "topic", by).agg(
        F.sum("_n").alias("n"), F.grouping(by).alias("overall")
    )
    grid = totals.filter(F.col("total_words") > 0).select(
        by, "overall", "total_words", F.explode(F.array(*[F.lit(t) for t in topics])).alias("topic")
    )
    h = hits.select(F.col("topic").alias("_topic"), F.col(by).alias("_by"), F.col("overall").alias("_o"), "n")
    on = (F.col("topic") == F.col("_topic")) & (F.col("overall") == F.col("_o")) & F.col(by).eqNullSafe(F.col("_by"))
    score = F.round(ratio(F.coalesce("n", F.lit(0)), F.col("total_words"), 0.0, 1000), 2)
    scored = grid.join(h, on, "left").select(by, (F.col("overall") == 1).alias("overall"), "topic", score.alias("score"))
    # one row per (group, topic): the window holds as many rows as there are topics
    rank = F.row_number().over(Window.partitionBy("overall", by).orderBy(F.desc("score"), F.asc("topic")))
    return scored.withColumn("rank", rank).withColumn("rank", F.when(F.col("rank") <= top, F.col("rank")))


def score_documents(
    df: DataFrame, lexicon: DataFrame, id_col: str = "doc_id", text: str = "text", topics: Sequence[str] = TOPICS,
    min_chars: int = 0, min_len: int = 1, top: int = 10,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Tone, topics and top words of every text: ``(tone, topics, words)`` keyed by ``id_col``.

    A text without words, or a null one, has the scores of no evidence and no top words.

    A text is one row, so its tokens are combined inside their task before the
    shuffle; each of the three results reads the texts once.
    """
    tokens = df.filter(F.coalesce(F.length(text), F.lit(0)) >= min_chars).select(id_col, F.explode_outer(tokenize(F.col(text), min_len)).alias("word"))
    tokens = tokens.withColumn("n", F.col("word").isNotNull().cast("int"))
    counts = tokens.filter("n > 0").groupBy(id_col, "word").agg(F.count(F.lit(1)).alias("n"))
    words = top_k(counts, [id_col], [F.desc("n"), F.asc("word")], top)
    return tone_from_counts(tokens, lexicon, [id_col]), topics_from_counts(tokens, lexicon, [id_col], topics), words


def tone_comparison(scores: DataFrame, by: str = "party") -> DataFrame:
    """All groups' scores side by side, rounded as reported (2 decimals for the per-mille score, else 1)."""
    cols = [F.round(m, 2 if m == "discriminatory" else 1).alias(m) for m in TONE_METRICS]
    return scores.select(by, *cols)


def tone_ranking(scores: DataFrame, by: str = "party", metrics: Sequence[str] = TONE_METRICS) -> DataFrame:
    """Rank of every group on every metric, highest score first."""
    chosen = [METRIC_ALIASES.get(m, m) for m in metrics]
    long = scores.unpivot([by], chosen, "metric", "score")
    # rows per metric = number of groups
    rank = F.row_number().over(Window.partitionBy("metric").orderBy(F.desc("score"), F.asc(by)))
    return long.withColumn("rank", rank)


def category_word_counts(cat: DataFrame, scheme: str, by: str = "party") -> DataFrame:
    """Words of a scheme per group, largest first."""
    return cat.groupBy(by).agg(sum_if(F.col("scheme") == scheme, F.col("n")).alias("n")).orderBy(F.desc("n"), F.asc(by))


def champion_word(cat: DataFrame, scheme: str, category: str, by: str = "party") -> DataFrame:
    """The single most frequent word of a category over all groups."""
    words = cat.filter((F.col("scheme") == scheme) & (F.col("category") == category)).groupBy(by, "word").agg(F.sum("n").alias("n"))
    return top_k(words, [], [F.desc("n"), F.asc("word"), F.asc(by)], 1).drop("rank")


def score_spread(scores: DataFrame, metrics: Sequence[str] = TONE_METRICS, by: str = "party") -> DataFrame:
    """Best and worst group of every metric and the difference of their scores."""
    long = scores.unpivot([by], list(metrics), "metric", "score")
    return long.groupBy("metric").agg(
        F.max_by(by, F.struct("score", by)).alias("best"), F.min_by(by, F.struct("score", by)).alias("worst"),
        (F.max("score") - F.min("score")).alias("spread"),
    )


def has_scores(scores: DataFrame) -> bool:
    """Whether there are any scores (reads at most one row)."""
    return not scores.isEmpty()
