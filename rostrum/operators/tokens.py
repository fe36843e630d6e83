"""Tokens and word frequencies.

Counts are kept long: ``(group columns..., word_type, word, n)``. Tokens are
aggregated before anything is shuffled or joined, so frequent words cost one
row per group and partition.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rostrum.functions.text import is_valid_word, tokenize
from rostrum.operators.common import join_groups, ratio, top_k
from rostrum.session import materialize

TOKEN_SCHEMA = (
    "doc_id long, idx int, token string, lemma string, upos string, "
    "is_space boolean, is_punct boolean, ent_id int, ent_label string, ent_text string"
)
ENTITY_LABEL = "PER"
_WORD_TYPES = {"NOUN": "noun", "PROPN": "noun", "ADJ": "adjective", "VERB": "verb"}

# Words of single debates and names of the groups themselves.
EVENT_STOPWORDS = [
    "afghanistan", "afghan", "afghaninn", "afghane", "afghanen", "afghaninnen",
    "ortskraft", "ortskräfte", "aufnahmezusage", "aufnahmezusagen",
]
PARTY_STOPWORDS = [
    "spd-fraktion", "cdu-fraktion", "csu-fraktion", "unionsfraktion",
    "grüne-fraktion", "grünen-fraktion", "afd-fraktion", "linke-fraktion",
    "fdp-fraktion", "bsw-fraktion",
    "sozialdemokrat", "sozialdemokratin", "sozialdemokraten", "sozialdemokratinnen",
    "christdemokrat", "christdemokratin", "christdemokraten",
    "spd-geführt", "cdu-geführt", "grün-geführt",
]


# ---------------------------------------------------------------- annotated tokens


def annotate(
    df: DataFrame,
    annotator: Callable[[], Callable[[Sequence[str]], list[list[dict]]]],
    doc_id: str = "doc_id",
    text: str = "text",
    batch_size: int = 100,
) -> DataFrame:
    """Run a user-supplied annotator over every text, partition by partition.

    ``annotator()`` is called once per Python worker and returns a function from
    a batch of texts to one list of token dicts per text (fields as in
    ``TOKEN_SCHEMA`` without ``doc_id`` and ``idx``). ``ent_first`` marks the first token of each person entity of a
    text, so that :func:`merge_entities` need not look for it.
    """
    schema = pa.schema([
        ("doc_id", pa.int64()), ("idx", pa.int32()), ("token", pa.string()), ("lemma", pa.string()), ("upos", pa.string()), ("is_space", pa.bool_()),
        ("is_punct", pa.bool_()), ("ent_id", pa.int32()), ("ent_label", pa.string()), ("ent_text", pa.string()), ("ent_first", pa.bool_()),
    ])
    defaults = {"token": None, "lemma": None, "upos": None, "is_space": False, "is_punct": False, "ent_id": None, "ent_label": None, "ent_text": None}

    def firsts(tokens: list[dict]) -> list[bool]:
        known: set = set()
        return [t.get("ent_label") == ENTITY_LABEL and (e := t.get("ent_id")) not in known and known.add(e) is None for t in tokens]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pipe = annotator()
        for batch in batches:
            for at in range(0, batch.num_rows, batch_size):
                docs, texts = (batch.column(i).slice(at, batch_size).to_pylist() for i in (0, 1))
                found = [list(tokens) for tokens in pipe(texts)]
                if len(found) != len(docs):
                    raise ValueError("an annotator answers with one list of tokens per text")
                sizes = np.array([len(tokens) for tokens in found], np.int64)
                flat = [t for tokens in found for t in tokens]
                columns = {
                    "doc_id": np.repeat(np.array(docs, object), sizes), "idx": np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes),
                    **{n: [t.get(n, default) for t in flat] for n, default in defaults.items()}, "ent_first": [x for tokens in found for x in firsts(tokens)],
                }
                yield pa.record_batch([pa.array(columns[f.name], f.type) for f in schema], schema=schema)

    source = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).filter(F.col("text") != "")
    return source.mapInArrow(run, f"{TOKEN_SCHEMA}, ent_first boolean")


#: Columns of an annotator's answer beside ``text``, the number of the text in the call, with what stands for a missing one.
ANSWER = {"token": None, "lemma": None, "upos": None, "is_space": False, "is_punct": False, "ent_id": None, "ent_label": None, "ent_text": None}
ANNOTATED_SCHEMA = f"{TOKEN_SCHEMA}, start long, error string"


def _cut_text(text: str, size: int) -> Iterator[tuple[int, str]]:
    """``(start, part)``: a text in parts of at most ``size`` characters, cut behind white space where there is any."""
    at = 0
    while len(text) - at > size:
        end = max(text.rfind(c, at, at + size) for c in "\n ") + 1
        end = end if end > at else at + size
        yield at, text[at:end]
        at = end
    yield at, text[at:]


def annotate_columns(
    df: DataFrame, annotator: Callable[[], Callable[[list[str]], dict[str, Sequence]]], doc_id: str = "doc_id", text: str = "text", max_chars: int = 1 << 20,
) -> DataFrame:
    """Token columns of every text, or the error of what the annotator fails on: ``TOKEN_SCHEMA`` with ``start`` and ``error``.

    ``annotator()`` is called once per Python worker. The function it returns takes a list of texts of at most
    ``max_chars`` characters in sum and answers with columns: ``text`` (the number of the text in the call), ``token``,
    ``lemma`` and any of the others in :data:`ANSWER`. Longer texts are cut behind white space; ``idx`` and ``ent_id``
    go on counting over the parts, so a text of any length takes the memory of one part. If a call fails, its texts are
    tried one by one; one that fails again yields a row with ``error`` and its ``start`` in the text (null tokens), and costs
    the others nothing. See :func:`split_errors`.
    """
    names = list(ANSWER)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pipe = annotator()
        kinds = {"ent_id": pa.int32(), "is_space": pa.bool_(), "is_punct": pa.bool_()}
        columns = [c.split()[0] for c in ANNOTATED_SCHEMA.split(", ")]
        seen: dict[str, int] = {}

        def tokens(parts: list[tuple[int, int, str]]) -> pa.RecordBatch:
            got = pipe([p[2] for p in parts])
            which = np.asarray(got["text"], np.int64)
            if len(which) and ((np.diff(which) < 0).any() or which[0] < 0 or which[-1] >= len(parts)):
                raise ValueError("tokens must come in the order of the texts")
            filled = {n: pa.array(got[n] if n in got else [ANSWER[n]] * len(which), kinds.get(n, pa.string())) for n in names}
            docs = [p[0] for p in parts]
            number = np.arange(len(which)) - np.searchsorted(which, which)
            entities = filled["ent_id"]
            for i, doc in enumerate(docs):  # parts of one text go on counting
                mine = slice(*np.searchsorted(which, [i, i + 1]))
                if doc == seen.get("doc") and parts[i][1] > 0:
                    number[mine] += seen["idx"]
                    if seen["ent"]:
                        entities = pc.if_else(pa.array(which == i), pc.add(entities, seen["ent"]), entities).cast(pa.int32())
                    seen["idx"] += mine.stop - mine.start
                else:
                    seen.update(doc=doc, idx=mine.stop - mine.start, ent=0)
                top = pc.max(entities.slice(mine.start, mine.stop - mine.start)).as_py()
                seen["ent"] = max(seen["ent"], -1 if top is None else top + 1, 0)
            filled["ent_id"] = entities
            starts = np.array([p[1] for p in parts], np.int64)[which] if len(which) else np.zeros(0, np.int64)
            row = [pa.array(np.array(docs, np.int64)[which] if len(which) else np.zeros(0, np.int64)), pa.array(number.astype(np.int32)), *filled.values(), pa.array(starts), pa.nulls(len(which), pa.string())]
            return pa.record_batch(row, columns)

        def failed(part: tuple[int, int, str], error: Exception) -> pa.RecordBatch:
            row = {"doc_id": pa.array([part[0]], pa.int64()), "idx": pa.nulls(1, pa.int32()), **{n: pa.nulls(1, kinds.get(n, pa.string())) for n in names}}
            return pa.record_batch([*row.values(), pa.array([part[1]], pa.int64()), pa.array([f"{type(error).__name__}: {error}"[:500]])], columns)

        def answer(parts: list[tuple[int, int, str]]) -> Iterator[pa.RecordBatch]:
            before = dict(seen)
            try:
                yield tokens(parts)
            except Exception as error:  # noqa: BLE001 - whatever a user's model raises concerns these texts alone
                seen.clear()
                seen.update(before)
                if len(parts) == 1:
                    yield failed(parts[0], error)
                else:
                    for part in parts:
                        yield from answer([part])

        held: list[tuple[int, int, str]] = []
        size = 0
        for batch in batches:
            for i in range(batch.num_rows):
                doc, value = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                for start, part in _cut_text(value, max_chars):
                    if held and size + len(part) > max_chars:
                        yield from answer(held)
                        held, size = [], 0
                    held.append((doc, start, part))
                    size += len(part)
        if held:
            yield from answer(held)

    source = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).filter((F.col("text") != "") & F.col("doc_id").isNotNull())
    return source.mapInArrow(run, ANNOTATED_SCHEMA)


def split_errors(annotated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The tokens, and ``(doc_id, start, error)`` of the texts or parts that failed, from one run of the annotator."""
    kept = materialize(annotated)
    return kept.filter("error IS NULL").drop("start", "error"), kept.filter("error IS NOT NULL").select("doc_id", "start", "error")


def lexicon_annotate(df: DataFrame, pos_lexicon: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """Default annotator without a language model: word tokens tagged from ``pos_lexicon(word, lemma, upos)``.

    Words outside the lexicon are their own lemma and get the tag ``X``; of a word listed twice the smaller
    (lemma, upos) counts. ``keep`` names columns of the document that every token carries, so that groups need no
    second look at the documents.
    """
    words = df.select(F.col(doc_id).cast("long").alias("doc_id"), *keep, F.posexplode(tokenize(F.col(text), min_len=1)).alias("idx", "token"))
    tags = pos_lexicon.groupBy(F.col("word").alias("_w")).agg(F.min(F.struct("lemma", "upos")).alias("_t"))
    tags = tags.select("_w", F.col("_t.lemma").alias("_l"), F.col("_t.upos").alias("_u"))
    return words.join(tags, F.col("token") == F.col("_w"), "left").select(
        "doc_id", *keep, "idx", "token", F.coalesce("_l", "token").alias("lemma"), F.coalesce("_u", F.lit("X")).alias("upos"),
        F.lit(False).alias("is_space"), F.lit(False).alias("is_punct"), F.lit(None).cast("int").alias("ent_id"),
        F.lit(None).cast("string").alias("ent_label"), F.lit(None).cast("string").alias("ent_text"),
    )


def merge_entities(tokens: DataFrame, by: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Replace the tokens of a person entity by one noun: the entity's whole text in lower case.

    Where the annotator has marked the first tokens (``ent_first``), the tokens are read once and not shuffled.
    """
    inside = F.col("ent_label") == ENTITY_LABEL
    if "ent_first" in tokens.columns and list(by) == ["doc_id"]:
        person = F.coalesce(inside, F.lit(False))
        changed = {"token": F.col("ent_text"), "lemma": F.lower("ent_text"), "upos": F.lit("PROPN"), "is_space": F.lit(False), "is_punct": F.lit(False)}
        kept = [F.when(person, changed[c]).otherwise(F.col(c)).alias(c) if c in changed else F.col(c) for c in tokens.columns if c != "ent_first"]
        return tokens.filter(~person | F.col("ent_first")).select(*kept)
    rest = tokens.filter(~F.coalesce(inside, F.lit(False)))
    firsts = tokens.filter(inside).groupBy(*by, "ent_id").agg(
        F.min_by(F.struct("idx", "ent_text"), "idx").alias("_e")
    )
    merged = firsts.select(
        *by, F.col("_e.idx").alias("idx"), F.col("_e.ent_text").alias("token"),
        F.lower("_e.ent_text").alias("lemma"), F.lit("PROPN").alias("upos"),
        F.lit(False).alias("is_space"), F.lit(False).alias("is_punct"), "ent_id", F.lit(ENTITY_LABEL).alias("ent_label"),
        F.col("_e.ent_text").alias("ent_text"),
    )
    return rest.unionByName(merged, allowMissingColumns=True)


def _word_type() -> Column:
    return F.create_map(*[F.lit(x) for kv in _WORD_TYPES.items() for x in kv])[F.col("upos")]


def typed_words(tokens: DataFrame, stopwords: dict[str, Sequence[str]] | None = None) -> DataFrame:
    """Noun, adjective and verb lemmas that pass the validity test of their type."""
    stopwords = stopwords or {}
    word = F.lower("lemma")
    ok = F.lit(False)
    for kind in ("noun", "adjective", "verb"):
        ok = ok | ((F.col("word_type") == kind) & is_valid_word(F.col("word"), list(stopwords.get(kind, ()))))
    return tokens.withColumn("word_type", _word_type()).withColumn("word", word).filter(ok)


def pos_counts(tokens: DataFrame, by: Sequence[str], stopwords: dict[str, Sequence[str]] | None = None) -> DataFrame:
    """Noun, adjective and verb lemma counts per group."""
    return typed_words(tokens, stopwords).groupBy(*by, "word_type", "word").agg(F.count(F.lit(1)).alias("n"))


def word_totals(tokens: DataFrame, by: Sequence[str], doc: str = "doc_id") -> DataFrame:
    """Non-space tokens and number of documents per group."""
    return tokens.groupBy(*by).agg(
        F.sum(F.when(~F.col("is_space"), 1).otherwise(0)).cast("long").alias("total_words"),
        F.count_distinct(doc).alias("documents"),
    )


def lemma_counts(tokens: DataFrame, by: Sequence[str]) -> DataFrame:
    """Counts of all lemmas of at least two characters that are neither space nor punctuation."""
    word = F.lower("lemma")
    keep = ~F.col("is_space") & ~F.col("is_punct") & (F.length(word) >= 2)
    return tokens.filter(keep).groupBy(*by, word.alias("word")).agg(F.count(F.lit(1)).alias("n"))


def extract_words(tokens: DataFrame, stopwords: dict[str, Sequence[str]] | None = None, kinds: Sequence[str] = ("noun", "adjective", "verb")) -> DataFrame:
    """Per document the lists of valid nouns, adjectives and verbs in text order."""
    typed = typed_words(tokens, stopwords)
    ordered = F.sort_array(F.collect_list(F.struct("idx", "word_type", "word")))
    grouped = typed.groupBy("doc_id").agg(ordered.alias("_w"))
    lists = [
        F.transform(_of_type(kind), lambda w: w["word"]).alias(f"{kind}s") for kind in kinds
    ]
    return grouped.select("doc_id", *lists)


def _of_type(kind: str) -> Column:
    return F.filter("_w", lambda w: w["word_type"] == kind)


# ---------------------------------------------------------------- plain word counts


def word_counts(
    df: DataFrame, by: Sequence[str], text: str = "text", min_len: int = 4, exclude_types: Sequence[str] = ()
) -> DataFrame:
    """``(by..., word, n)`` of the word tokens of each text."""
    source = df
    if exclude_types:
        source = source.filter(~F.col("type").isin(*exclude_types))
    words = source.select(*by, F.explode(tokenize(F.col(text), min_len)).alias("word"))
    return words.groupBy(*by, "word").agg(F.count(F.lit(1)).alias("n"))


def token_totals(counts: DataFrame, by: Sequence[str], out: str = "total_words") -> DataFrame:
    """Tokens per group from a counts table."""
    return counts.groupBy(*by).agg(F.sum("n").alias(out))


def word_rollup(
    speeches: DataFrame,
    lexicon: DataFrame | None = None,
    exclude_types: Sequence[str] = ("ortskraefte",),
    min_len: int = 4,
) -> DataFrame:
    """Counts per speaker, party and whole corpus: ``(level, party, speaker, word_type, word, n)``.

    Tokens are reduced to (party, speaker, word) in one shuffle; parties are summed up from speakers and the corpus from
    parties, so each level moves only what its tasks have already combined. With a lexicon, words of its adjective,
    verb and topic schemes are also counted under these word types.
    """
    none = F.lit(None).cast("string")
    by_speaker = word_counts(speeches, ["party", "speaker"], min_len=min_len, exclude_types=exclude_types)
    by_party = by_speaker.groupBy("party", "word").agg(F.sum("n").alias("n"))
    corpus = by_party.groupBy("word").agg(F.sum("n").alias("n"))
    levels = (
        by_speaker.select(F.lit("speaker").alias("level"), "party", "speaker", "word", "n")
        .unionByName(by_party.select(F.lit("party").alias("level"), "party", none.alias("speaker"), "word", "n"))
        .unionByName(corpus.select(F.lit("corpus").alias("level"), none.alias("party"), none.alias("speaker"), "word", "n"))
    )
    if lexicon is None:
        return levels.select("level", "party", "speaker", F.lit("all").alias("word_type"), "word", "n")
    kinds = lexicon.filter(F.col("scheme").isin("adjective", "verb", "topic")).groupBy(F.col("word").alias("_word")).agg(
        F.collect_set("scheme").alias("_kinds")
    )
    # the word types of a word as an array: the counts are read once
    types = F.concat(F.array(F.lit("all")), F.coalesce("_kinds", F.expr("cast(array() as array<string>)")))
    typed = levels.join(kinds, F.col("word") == F.col("_word"), "left")
    return typed.select("level", "party", "speaker", F.explode(types).alias("word_type"), "word", "n")


def top_words(counts: DataFrame, by: Sequence[str], n: int = 50) -> DataFrame:
    """The ``n`` most frequent words per group; ties in alphabetical order."""
    return top_k(counts, by, [F.desc("n"), F.asc("word")], n)


def top_words_without_stopwords(
    counts: DataFrame, by: Sequence[str], stopwords: DataFrame, pool: int = 50, n: int = 10, compat: bool = False
) -> DataFrame:
    """Top words per group without ``stopwords(word)``.

    By default stopwords are removed first. ``compat`` takes the top ``pool``
    first and removes stopwords from those, so fewer than ``n`` may remain.
    """
    if compat:
        kept = top_words(counts, by, pool).drop("rank").join(stopwords.select("word"), "word", "left_anti")
        return top_words(kept, by, n)
    return top_words(counts.join(stopwords.select("word"), "word", "left_anti"), by, n)


def per_thousand(counts: DataFrame, totals: DataFrame, by: Sequence[str], total: str = "total_words") -> DataFrame:
    """Counts with ``per_1000`` = n / total words of the group * 1000; groups without words give no rows."""
    joined = join_groups(counts, totals.select(*by, total).filter(F.col(total) > 0), by)
    return joined.withColumn("per_1000", F.col("n") / F.col(total) * 1000)


#: Groups that may become columns.
MOST_GROUPS = 1000


def groups_of(totals: DataFrame, by: str) -> list[str]:
    """The groups of a table of one row per group, at most :data:`MOST_GROUPS`, since each becomes a column."""
    found = [r[0] for r in totals.select(by).filter(F.col(by).isNotNull()).distinct().orderBy(by).limit(MOST_GROUPS + 1).collect()]
    if len(found) > MOST_GROUPS:
        raise ValueError(f"more than {MOST_GROUPS} groups in column {by}: name those that shall be columns")
    return found


def frequency_matrix(counts: DataFrame, totals: DataFrame, groups: Sequence[str] | None = None, by: str = "party") -> DataFrame:
    """Word x group table with ``{group}_count`` and ``{group}_per1000`` (4 decimals, 0 where absent).

    Without ``groups`` there are columns for all groups of ``totals``.
    """
    groups = groups_of(totals, by) if groups is None else groups
    freq = per_thousand(counts, totals, [by]).filter(F.col(by).isin(*groups))
    wide = freq.groupBy("word").pivot(by, list(groups)).agg(
        F.sum("n").alias("count"), F.round(F.sum("per_1000"), 4).alias("per1000")
    )
    return wide.na.fill(0)


def unpivot_frequencies(wide: DataFrame) -> DataFrame:
    """Long form ``(word, party, n, per_1000)`` of a word x group table; groups come from the ``*_count`` columns."""
    groups = [c[: -len("_count")] for c in wide.columns if c.endswith("_count")]
    pairs = [
        F.struct(
            F.lit(g).alias("party"), F.col(f"`{g}_count`").cast("long").alias("n"), F.col(f"`{g}_per1000`").cast("double").alias("per_1000")
        )
        for g in groups
    ]
    return wide.select("word", F.inline(F.array(*pairs)))


def compare_groups(counts: DataFrame, totals: DataFrame, groups: Sequence[str] | None = None, by: str = "party", n: int = 30) -> DataFrame:
    """Union of all groups' top ``n`` words with every group's per-1000 (2 decimals) and the spread max - min.

    Without ``groups`` all groups of ``totals`` are compared.
    """
    groups = groups_of(totals, by) if groups is None else groups
    words = top_words(counts.filter(F.col(by).isin(*groups)), [by], n).select("word").distinct()
    freq = per_thousand(counts.filter(F.col(by).isin(*groups)).join(words, "word", "left_semi"), totals, [by])
    wide = freq.groupBy("word").pivot(by, list(groups)).agg(F.round(F.sum("per_1000"), 2)).na.fill(0.0)
    cols = [F.col(f"`{g}`") for g in groups]
    spread = F.greatest(*cols) - F.least(*cols) if len(groups) > 1 else F.lit(0.0)
    return wide.withColumn("spread", spread)


def hot_words(counts: DataFrame, by: str = "party", top: int = 50, min_groups: int = 3, n: int = 10) -> DataFrame:
    """Words in the top list of at least ``min_groups`` groups, by number of groups and total count."""
    tops = top_words(counts, [by], top)
    shared = tops.groupBy("word").agg(F.count(F.lit(1)).alias("groups"), F.sum("n").alias("total")).filter(
        F.col("groups") >= min_groups
    )
    return top_k(shared, [], [F.desc("groups"), F.desc("total"), F.asc("word")], n)


def word_rank(speeches: DataFrame, word: str, n: int = 10, formal_only: bool = False) -> DataFrame:
    """Who uses ``word`` most: count and per-1000 of the speaker's words, top ``n``."""
    source = speeches.filter(F.col("type") == "rede") if formal_only else speeches
    tokens = tokenize(F.col("text"), min_len=1)
    counted = source.select(
        "speaker", "party", F.size(tokens).alias("_all"), F.size(F.filter(tokens, lambda t: t == word.lower())).alias("_hits")
    ).groupBy("speaker", "party").agg(F.sum("_hits").alias("n"), F.sum("_all").alias("total_words"))
    used = counted.filter(F.col("n") > 0).withColumn("per_1000", ratio(F.col("n"), F.col("total_words"), 0.0, 1000))
    return top_k(used, [], [F.desc("n"), F.asc("speaker"), F.asc("party")], n)


def vocabulary_size(counts: DataFrame, by: Sequence[str], approximate: bool = False) -> DataFrame:
    """Distinct words per group. A counts table holds one row per word, so the exact size is a row count."""
    if approximate:
        return counts.groupBy(*by).agg(F.approx_count_distinct("word").alias("vocabulary"))
    return counts.groupBy(*by).agg(F.count(F.lit(1)).alias("vocabulary"))


def occurrence_ranking(speeches: DataFrame, needle: str, n: int = 10) -> DataFrame:
    """Speakers by occurrences of a string in their texts."""
    from rostrum.functions.text import count_occurrences

    hits = speeches.groupBy("speaker", "party").agg(F.sum(count_occurrences(F.col("text"), needle)).alias("n"))
    return top_k(hits.filter(F.col("n") > 0), [], [F.desc("n"), F.asc("speaker"), F.asc("party")], n)
