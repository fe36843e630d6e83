"""Queries over ``documents`` seen as speeches: words, lexicon scores, distinctiveness, activity, rankings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rostrum.functions import text as tx
from rostrum.operators import activity as ac
from rostrum.operators import distinct as di
from rostrum.operators import lexicon as lx
from rostrum.operators import rankings as rk
from rostrum.operators import tokens as tk
from rostrum.operators.common import lookup_frame
from rostrum.plans import views as v
from rostrum.plans.registry import query
from rostrum.plans.sqltext import SPACE, div, pick, sql, tone_columns, values, word_count
from rostrum.session import materialize
from rostrum.sources import writers as wr

# the groups that the tables hold, for the SQL only: the operators take theirs from the data
GROUPS = ["en", "fr", "de", "es"]
STOP = ["that", "with", "pour", "sich"]


def _wc(spark: SparkSession, sf: str, by: list[str]) -> DataFrame:
    return tk.word_counts(v.corpus_docs(spark, sf), by)


def _kept(spark: SparkSession, sf: str, by: list[str]) -> DataFrame:
    """Word counts kept on reliable storage: the texts are tokenised once however often the counts are read."""
    return materialize(_wc(spark, sf, by))


def _party(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    counts = _kept(spark, sf, ["party"])
    return counts, tk.token_totals(counts, ["party"])


def _cat(spark: SparkSession, sf: str, by: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    counts = _kept(spark, sf, by)
    return counts, tk.token_totals(counts, by), lx.categorize(counts, v.lexicon(spark))


def _categorized(spark: SparkSession, sf: str, by: list[str]) -> DataFrame:
    return lx.categorize(_wc(spark, sf, by), v.lexicon(spark))


# ---------------------------------------------------------------- text functions


@query("clean_text", f"""SELECT doc_id, regexp_replace(translate(text, chr(160) || chr(8199) || chr(8239) || chr(8288) || chr(8212) || chr(8211), '    --'), '[\\t ]+', ' ', 'g') AS cleaned FROM documents""")
def clean_text(spark, sf):
    return v.read(spark, sf, "documents").select("doc_id", tx.clean_text(F.col("text")).alias("cleaned"))


@query("strip_parentheses", f"""SELECT doc_id, trim(regexp_replace(regexp_replace(text, '\\([^)]+\\)', '', 'g'), '{SPACE}', ' ', 'g')) AS stripped FROM documents""")
def strip_parentheses(spark, sf):
    return v.read(spark, sf, "documents").select("doc_id", tx.strip_parentheses(F.col("text")).alias("stripped"))


@query("word_count", f"SELECT doc_id, {word_count('text')} AS words FROM documents")
def count_words(spark, sf):
    return v.read(spark, sf, "documents").select("doc_id", tx.word_count(F.col("text")).alias("words"))


_NAMED = r"""
WITH pc AS (SELECT DISTINCT regexp_extract_all(p, '[^\x20\x09-\x0D]+') AS w, length(p) % 4 AS f FROM (SELECT unnest(string_split(coalesce(text, ''), '.')) AS p FROM documents)),
n AS (SELECT DISTINCT CASE f WHEN 0 THEN w[1] || ' ' || w[2] WHEN 1 THEN 'Dr. ' || w[1] || ' ' || w[2] || ' ' || w[3] WHEN 2 THEN w[2] || ', ' || w[1] ELSE 'Prof. Dr. ' || w[2] END AS name
  FROM pc WHERE len(w) >= 3)"""


def _names(spark: SparkSession, sf: str) -> DataFrame:
    """Names of several forms, made of the first words of every sentence of the documents."""
    pieces = v.read(spark, sf, "documents").select(F.explode(F.split(F.coalesce("text", F.lit("")), r"\.")).alias("p"))
    w = lambda i: F.get("w", F.lit(i))
    found = pieces.select(F.regexp_extract_all("p", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)).alias("w"), (F.length("p") % 4).alias("f")).filter(F.size("w") >= 3)
    name = (
        F.when(F.col("f") == 0, F.concat_ws(" ", w(0), w(1))).when(F.col("f") == 1, F.concat_ws(" ", F.lit("Dr."), w(0), w(1), w(2)))
        .when(F.col("f") == 2, F.concat(w(1), F.lit(", "), w(0))).otherwise(F.concat(F.lit("Prof. Dr. "), w(1)))
    )
    return found.select(name.alias("name")).distinct()


@query("name_parts", _NAMED + f""",
p AS (SELECT *, list_filter(string_split(trim(regexp_replace(regexp_replace(name, '[^a-zA-ZÀ-ÿÖÄÜäöüßğşçıİ\\-\\s]', ' ', 'g'), '\\s+', ' ', 'g')), ' '), lambda x: x <> '') AS t FROM n),
q AS (SELECT *, list_filter(t, lambda x: NOT list_contains({tx.NAME_TITLES!r}, x)) AS nm, list_filter(t, lambda x: list_contains({tx.NAME_TITLES!r}, x)) AS tt FROM p)
SELECT name, CASE WHEN len(nm) > 1 THEN array_to_string(nm[1:len(nm)-1], ' ') ELSE '' END AS first_name,
  CASE WHEN len(nm) > 0 THEN nm[len(nm)] ELSE '' END AS last_name, CASE WHEN len(tt) > 0 THEN array_to_string(tt, ' ') END AS acad_title FROM q""")
def name_parts(spark, sf):
    return _names(spark, sf).select("name", tx.name_parts(F.col("name")).alias("p")).select("name", "p.*")


@query("name_keys", _NAMED + """
SELECT name, lower(trim(regexp_replace(regexp_replace(name, '\\b(Dr\\.?|Prof\\.?)\\s*', '', 'g'), '\\s+', ' ', 'g'))) AS match_key,
  lower(list_extract(string_split(trim(regexp_replace(replace(replace(name, 'Dr.', ''), 'Prof.', ''), '\\s+', ' ', 'g')), ' '), -1)) AS last_key FROM n""")
def name_keys(spark, sf):
    return _names(spark, sf).select("name", tx.match_name_key(F.col("name")).alias("match_key"), tx.last_name_key(F.col("name")).alias("last_key"))


@query("slugs", _NAMED + r""",
b AS (SELECT name, trim(regexp_replace(name, '\b(Dr\.|Prof\.|Dr\s|Prof\s)\s*', '', 'g')) AS bare FROM n),
t AS (SELECT name, lower(CASE WHEN len(string_split(bare, ',')) = 2 THEN trim(string_split(bare, ',')[2]) || ' ' || trim(string_split(bare, ',')[1]) ELSE bare END) AS low FROM b),
u AS (SELECT name, strip_accents(replace(replace(replace(replace(low, 'ä', 'ae'), 'ö', 'oe'), 'ü', 'ue'), 'ß', 'ss')) AS plain FROM t)
SELECT name, trim(regexp_replace(plain, '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM u""")
def slugs(spark, sf):
    return _names(spark, sf).select("name", tx.slug(F.col("name")).alias("slug"))


@query("slug_collisions", """
WITH s AS (SELECT DISTINCT lang, source FROM documents), c AS (SELECT *, count(*) OVER (PARTITION BY source) AS n FROM s)
SELECT lang AS party, source AS speaker, CASE WHEN n > 1 THEN trim(regexp_replace(lower(source), '[^a-z0-9]+', '-', 'g'), '-') || '-' || lang ELSE trim(regexp_replace(lower(source), '[^a-z0-9]+', '-', 'g'), '-') END AS slug FROM c""")
def slug_collisions(spark, sf):
    s = v.read(spark, sf, "documents").select(F.col("lang").alias("party"), F.col("source").alias("speaker")).distinct()
    return tx.resolve_slug_collisions(s.withColumn("slug", tx.slug(F.col("speaker"))))


@query("preview", """
SELECT doc_id, CASE WHEN length(text) > 150 THEN trim(replace(substring(text, 1, 150), chr(10), ' ')) || '...' ELSE trim(replace(substring(text, 1, 150), chr(10), ' ')) END AS preview FROM documents""")
def preview(spark, sf):
    return v.read(spark, sf, "documents").select("doc_id", tx.preview(F.col("text")).alias("preview"))


@query("occurrences", sql("SELECT speaker, party, n, row_number() OVER (ORDER BY n DESC, speaker, party) AS rank FROM (SELECT speaker, party, CAST(sum((length(lower(text)) - length(replace(lower(text), 'tion', ''))) // 4) AS BIGINT) AS n FROM corpus GROUP BY ALL) WHERE n > 0 QUALIFY rank <= 10", "corpus"))
def occurrences(spark, sf):
    return tk.occurrence_ranking(v.corpus_docs(spark, sf), "tion", 10)


# ---------------------------------------------------------------- words


@query("token_counts", sql("SELECT party, speaker, word, n FROM wc", "wc"))
def token_counts(spark, sf):
    return _wc(spark, sf, ["party", "speaker"])


@query("word_rollup", sql("""
, typed AS (SELECT 'all' AS word_type, * FROM wc UNION ALL SELECT l.scheme, w.* FROM wc w JOIN (SELECT DISTINCT scheme, word FROM lex WHERE scheme IN ('adjective', 'verb', 'topic')) l ON w.word = l.word)
SELECT CASE WHEN grouping(party) = 1 THEN 'corpus' WHEN grouping(speaker) = 1 THEN 'party' ELSE 'speaker' END AS level, party, speaker, word_type, word, CAST(sum(n) AS BIGINT) AS n
FROM typed GROUP BY GROUPING SETS ((word_type, word, party, speaker), (word_type, word, party), (word_type, word))""", "wc", "lex"))
def word_rollup(spark, sf):
    return tk.word_rollup(v.corpus_docs(spark, sf), v.lexicon(spark))


@query("per_thousand", sql("SELECT p.party, word, n, total_words, CAST(n AS DOUBLE) / total_words * 1000 AS per_1000 FROM pwc p JOIN ptot t ON p.party = t.party", "ptot"))
def per_thousand(spark, sf):
    counts, totals = _party(spark, sf)
    return tk.per_thousand(counts, totals, ["party"])


@query("top_words", sql("SELECT party, word, n, row_number() OVER (PARTITION BY party ORDER BY n DESC, word) AS rank FROM pwc QUALIFY rank <= 50", "pwc"))
def top_words(spark, sf):
    return tk.top_words(_wc(spark, sf, ["party"]), ["party"], 50)


@query("top_words_without_stopwords", sql(f"SELECT party, speaker, word, n, row_number() OVER (PARTITION BY party, speaker ORDER BY n DESC, word) AS rank FROM wc WHERE word NOT IN {tuple(STOP)} QUALIFY rank <= 10", "wc"))
def top_words_without_stopwords(spark, sf):
    stop = lookup_frame(spark, [(w,) for w in STOP], "word string")
    return tk.top_words_without_stopwords(_wc(spark, sf, ["party", "speaker"]), ["party", "speaker"], stop)


@query("top_words_stopwords_after", sql(f"""
SELECT party, word, n, row_number() OVER (PARTITION BY party ORDER BY n DESC, word) AS rank FROM (SELECT * FROM pwc QUALIFY row_number() OVER (PARTITION BY party ORDER BY n DESC, word) <= 12) WHERE word NOT IN {tuple(STOP)} QUALIFY rank <= 10""", "pwc"))
def top_words_stopwords_after(spark, sf):
    stop = lookup_frame(spark, [(w,) for w in STOP], "word string")
    return tk.top_words_without_stopwords(_wc(spark, sf, ["party"]), ["party"], stop, pool=12, compat=True)


_MATRIX = ", ".join(
    f"CAST(coalesce(sum(n) FILTER (p.party = '{g}'), 0) AS BIGINT) AS {g}_count, coalesce(round(sum(CAST(n AS DOUBLE) / total_words * 1000) FILTER (p.party = '{g}'), 4), 0) AS {g}_per1000"
    for g in GROUPS
)


@query("frequency_matrix", sql(f"SELECT word, {_MATRIX} FROM pwc p JOIN ptot t ON p.party = t.party GROUP BY word", "ptot"))
def frequency_matrix(spark, sf):
    counts, totals = _party(spark, sf)
    return tk.frequency_matrix(counts, totals)


@query("unpivot_frequencies", sql("SELECT w.word, t.party, coalesce(p.n, 0) AS n, coalesce(round(CAST(p.n AS DOUBLE) / t.total_words * 1000, 4), 0) AS per_1000 FROM (SELECT DISTINCT word FROM pwc) w CROSS JOIN ptot t LEFT JOIN pwc p ON p.word = w.word AND p.party = t.party", "ptot"))
def unpivot_frequencies(spark, sf):
    counts, totals = _party(spark, sf)
    return tk.unpivot_frequencies(tk.frequency_matrix(counts, totals))


_CMP = ", ".join(f"coalesce(round(sum(CAST(n AS DOUBLE) / total_words * 1000) FILTER (p.party = '{g}'), 2), 0) AS {g}" for g in GROUPS)


@query("compare_groups", sql(f"""
, w AS (SELECT DISTINCT word FROM (SELECT * FROM pwc QUALIFY row_number() OVER (PARTITION BY party ORDER BY n DESC, word) <= 30))
SELECT *, greatest(en, fr, de, es) - least(en, fr, de, es) AS spread FROM (SELECT p.word, {_CMP} FROM pwc p JOIN ptot t ON p.party = t.party WHERE p.word IN (SELECT word FROM w) GROUP BY p.word)""", "ptot"))
def compare_groups(spark, sf):
    counts, totals = _party(spark, sf)
    return tk.compare_groups(counts, totals)


@query("hot_words", sql("""
, t AS (SELECT * FROM pwc QUALIFY row_number() OVER (PARTITION BY party ORDER BY n DESC, word) <= 500)
SELECT word, count(*) AS groups, CAST(sum(n) AS BIGINT) AS total, row_number() OVER (ORDER BY count(*) DESC, sum(n) DESC, word) AS rank FROM t GROUP BY word HAVING count(*) >= 2 QUALIFY rank <= 10""", "pwc"))
def hot_words(spark, sf):
    return tk.hot_words(_wc(spark, sf, ["party"]), top=500, min_groups=2, n=10)


@query("word_rank", sql(r"""
, t AS (SELECT party, speaker, word FROM (SELECT party, speaker, unnest(regexp_split_to_array(lower(text), '[^\p{L}\p{N}_]+')) AS word FROM corpus) WHERE regexp_full_match(word, '[a-zäöüß]+')),
c AS (SELECT speaker, party, count(*) FILTER (word = 'with') AS n, count(*) AS total_words FROM t GROUP BY ALL)
SELECT speaker, party, n, total_words, CAST(n AS DOUBLE) / total_words * 1000 AS per_1000, row_number() OVER (ORDER BY n DESC, speaker, party) AS rank FROM c WHERE n > 0 QUALIFY rank <= 10""", "corpus"))
def word_rank(spark, sf):
    return tk.word_rank(v.corpus_docs(spark, sf), "with", 10)


@query("vocabulary_size", sql("SELECT party, count(*) AS vocabulary FROM pwc GROUP BY party", "pwc"))
def vocabulary_size(spark, sf):
    return tk.vocabulary_size(_wc(spark, sf, ["party"]), ["party"])


_POS = [("that", "that", "PROPN"), ("with", "with", "VERB"), ("this", "this", "ADJ"), ("from", "source", "NOUN"), ("pour", "pour", "VERB"), ("than", "than", "ADJ")]
_POS_CTE = f"pos AS (SELECT * FROM {values(_POS, 'word, lemma, upos')})"


def _tagged(body: str) -> str:
    return "WITH " + _POS_CTE + r""",
t AS (SELECT doc_id, lang AS party, word AS token FROM (SELECT doc_id, lang, unnest(regexp_split_to_array(lower(text), '[^\p{L}\p{N}_]+')) AS word FROM documents) WHERE regexp_full_match(word, '[a-zäöüß]+')),
g AS (SELECT t.*, coalesce(p.lemma, t.token) AS lemma, coalesce(p.upos, 'X') AS upos FROM t LEFT JOIN pos p ON t.token = p.word)
""" + body


def _tokens(spark, sf) -> DataFrame:
    d = v.read(spark, sf, "documents").withColumnRenamed("lang", "party")
    return tk.lexicon_annotate(d, lookup_frame(spark, _POS, "word string, lemma string, upos string"), keep=["party"])


@query("pos_counts", _tagged("""
SELECT party, CASE WHEN upos IN ('NOUN', 'PROPN') THEN 'noun' WHEN upos = 'ADJ' THEN 'adjective' ELSE 'verb' END AS word_type, lower(lemma) AS word, count(*) AS n
FROM g WHERE upos IN ('NOUN', 'PROPN', 'ADJ', 'VERB') AND NOT (upos = 'VERB' AND lemma = 'pour') AND length(lemma) >= 3 GROUP BY ALL"""))
def pos_counts(spark, sf):
    return tk.pos_counts(_tokens(spark, sf), ["party"], {"verb": ["pour"]})


@query("lemma_counts", _tagged("SELECT party, lower(lemma) AS word, count(*) AS n FROM g WHERE length(lemma) >= 2 GROUP BY ALL"))
def lemma_counts(spark, sf):
    return tk.lemma_counts(_tokens(spark, sf), ["party"])


@query("word_totals", _tagged("SELECT party, count(*) AS total_words, count(DISTINCT doc_id) AS documents FROM g GROUP BY ALL"))
def word_totals(spark, sf):
    return tk.word_totals(_tokens(spark, sf), ["party"])


#: Bytes of the long text of the annotator query.
LONG_TEXT = 50_000_000


@query("annotate_columns", rf"""
WITH one AS (SELECT min(doc_id) AS doc_id FROM documents WHERE text <> '' AND doc_id % 29 <> 3),
d AS (SELECT doc_id, text, CASE WHEN doc_id IN (SELECT doc_id FROM one) THEN {LONG_TEXT} // (strlen(text) + 1) + 1 ELSE 1 END AS times FROM documents WHERE text <> ''),
t AS (SELECT doc_id, times, len(regexp_extract_all(text, '[A-ZÀ-Þa-zß-ÿ]+')) AS n, len(regexp_extract_all(text, '[A-ZÀ-Þ][A-ZÀ-Þa-zß-ÿ]*')) AS p FROM d)
SELECT doc_id, CAST(n * times AS BIGINT) AS tokens, CAST(n * times - 1 AS BIGINT) AS last_idx, NULL AS error FROM t WHERE doc_id % 29 <> 3 AND n > 0
UNION ALL SELECT doc_id, 0, NULL, 'ValueError: no model for this' FROM t WHERE doc_id % 29 = 3""")
def annotate_columns(spark, sf):
    """The columnar annotator hook over whole texts, one of them 50 MB long, and some that the annotator fails on."""

    def annotator():
        import re

        word = re.compile("[A-ZÀ-Þa-zß-ÿ]+")

        def run(texts):
            found = [word.findall(t) for t in texts]
            if any("FAIL" in t[:8] for t in texts):
                raise ValueError("no model for this")
            flat = [w for f in found for w in f]
            return {"text": [i for i, f in enumerate(found) for _ in f], "token": flat, "lemma": flat}

        return run

    docs = v.read(spark, sf, "documents").filter("text <> ''").select("doc_id", "text")
    longest = docs.filter("doc_id % 29 <> 3").agg(F.min("doc_id").alias("_one"))
    times = F.when(F.col("doc_id") == F.col("_one"), F.floor(F.lit(LONG_TEXT) / (F.octet_length("text") + 1)).cast("int") + 1).otherwise(1)
    docs = docs.join(longest, F.col("doc_id") == F.col("_one"), "left").select("doc_id", F.repeat(F.concat("text", F.lit(" ")), times).alias("text"))
    docs = docs.withColumn("text", F.when(F.col("doc_id") % 29 == 3, F.concat(F.lit("FAIL 1 "), "text")).otherwise(F.col("text")))
    done = tk.annotate_columns(docs, annotator)
    # by error first: the greatest of strings needs sorted tokens, and so few rows are left for it
    counted = done.groupBy("doc_id", "error").agg(F.count("token").alias("tokens"), F.max("idx").cast("long").alias("last_idx"))
    return counted.groupBy("doc_id").agg(F.sum("tokens").alias("tokens"), F.max("last_idx").alias("last_idx"), F.max("error").alias("error"))


@query("annotate_batches", r"""
WITH t AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-ZÀ-Þa-zß-ÿ]+')) AS w FROM documents),
k AS (SELECT doc_id, CASE WHEN regexp_matches(w, '^[A-ZÀ-Þ]') THEN 'noun' WHEN ends_with(w, 'e') THEN 'adjective' ELSE 'noun' END AS word_type, w FROM t WHERE length(w) >= 3)
SELECT doc_id, word_type, count(*) AS n FROM k GROUP BY ALL""")
def annotate_batches(spark, sf):
    """Annotator hook, entity merge and typed counts over whole texts.

    The annotator stands in for a language model: capitalised words are person
    entities, other words ending in -e adjectives, the rest nouns.
    """

    def annotator():
        import re

        word = re.compile("[A-ZÀ-Þa-zß-ÿ]+")
        upper = re.compile("[A-ZÀ-Þ]")

        def run(texts):
            out = []
            for text in texts:
                rows = []
                for i, t in enumerate(word.findall(text)):
                    person = upper.match(t) is not None
                    entity = {"ent_id": i, "ent_label": "PER", "ent_text": t} if person else {}
                    tag = "PROPN" if person else "ADJ" if t.endswith("e") else "NOUN"
                    rows.append({"token": t, "lemma": t, "upos": tag, **entity})
                out.append(rows)
            return out

        return run

    tokens = tk.merge_entities(tk.annotate(v.read(spark, sf, "documents"), annotator))
    return tk.typed_words(tokens).groupBy("doc_id", "word_type").agg(F.count(F.lit(1)).alias("n"))


@query("extract_words", r"""
WITH t AS (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^\p{L}\p{N}_]+')) AS w FROM documents)
SELECT doc_id, coalesce(sum(1) FILTER (w IN ('that', 'from')), 0)::BIGINT AS nouns, coalesce(sum(1) FILTER (w IN ('this', 'than')), 0)::BIGINT AS adjectives, coalesce(sum(1) FILTER (w IN ('with', 'pour')), 0)::BIGINT AS verbs
FROM t GROUP BY doc_id HAVING count(*) FILTER (w IN ('that', 'from', 'this', 'than', 'with', 'pour')) > 0""")
def extract_words(spark, sf):
    d = v.read(spark, sf, "documents")
    tagged = tk.lexicon_annotate(d, lookup_frame(spark, _POS, "word string, lemma string, upos string"))
    lists = tk.extract_words(tagged)
    return lists.select("doc_id", *[F.size(c).alias(c) for c in ("nouns", "adjectives", "verbs")])


# ---------------------------------------------------------------- distinctiveness

_RATED = """
, f AS (SELECT p.party, word, n, CAST(n AS DOUBLE) / total_words * 1000 AS per_1000 FROM pwc p JOIN ptot t ON p.party = t.party),
s AS (SELECT word, sum(per_1000) AS s FROM f GROUP BY word), c AS (SELECT party, sum(n) AS counted FROM f GROUP BY party),
r AS (SELECT f.*, counted, per_1000 / (greatest((s - per_1000) / ((SELECT count(*) FROM ptot) - 1), 0) + 0.001::DOUBLE) AS ratio FROM f JOIN s ON f.word = s.word JOIN c ON f.party = c.party)
"""


@query("distinctive_words", sql(_RATED + """
SELECT party, word, n, round(per_1000, 6) AS per_1000, round(ratio, 4) AS ratio, round(ratio * sqrt(per_1000), 4) AS score, row_number() OVER (PARTITION BY party ORDER BY round(ratio * sqrt(per_1000), 6) DESC, word) AS rank
FROM r WHERE n >= counted * 0.0005::DOUBLE AND ratio > 2 QUALIFY rank <= 5""", "ptot"))
def distinctive_words(spark, sf):
    counts, totals = _party(spark, sf)
    d = di.distinctive_words(counts, totals)
    return d.select("party", "word", "n", F.round("per_1000", 6).alias("per_1000"), F.round("ratio", 4).alias("ratio"), F.round("score", 4).alias("score"), "rank")


def _folded(n: int) -> str:
    """SQL of the key topics: the most frequent mildly distinctive words, folded into longer ones, one list ``ks`` per party."""
    return _RATED + f"""
, pool AS (SELECT party, word, n, ratio, row_number() OVER (PARTITION BY party ORDER BY n DESC, word) AS k FROM r WHERE n >= counted * 0.0005::DOUBLE AND ratio > 1.5 QUALIFY k <= {2 * n}),
lists AS (SELECT party, list([{{'word': word, 'n': n, 'ratio': ratio}}] ORDER BY k) AS ws FROM pool GROUP BY party),
folded AS (SELECT party, list_reduce(list_prepend(ws[1][2:1], ws), lambda kept, w: CASE
    WHEN len(kept) >= {n} OR len(list_filter(kept, lambda x: contains(x.word, w[1].word) AND x.word <> w[1].word)) > 0 THEN kept
    ELSE list_concat(list_filter(kept, lambda x: NOT contains(w[1].word, x.word)), w) END) AS ks FROM lists)"""


@query("key_topics", sql(_folded(10) + """
SELECT party, k.word AS word, CAST(k.n AS BIGINT) AS n, round(k.ratio, 4) AS ratio, rank FROM (SELECT party, unnest(ks) AS k, unnest(range(1, len(ks) + 1)) AS rank FROM folded)""", "ptot"))
def key_topics(spark, sf):
    counts, totals = _party(spark, sf)
    return di.key_topics(counts, totals).withColumn("ratio", F.round("ratio", 4))


@query("exclusive_words", sql("""
SELECT party, word, n, row_number() OVER (PARTITION BY party ORDER BY n DESC, word) AS rank FROM (SELECT word, any_value(party) AS party, CAST(sum(n) AS BIGINT) AS n FROM pwc GROUP BY word HAVING count(*) = 1 AND sum(n) >= 10) QUALIFY rank <= 3""", "pwc"))
def exclusive_words(spark, sf):
    return di.exclusive_words(_wc(spark, sf, ["party"]))


def _signature(source: str, extra: str, min_count: int) -> str:
    return f"""
, pw AS (SELECT party, word, sum(n) AS pn FROM wc GROUP BY ALL), aw AS (SELECT word, sum(n) AS an FROM wc GROUP BY ALL),
pt AS (SELECT party, sum(total_words) AS pt FROM stot GROUP BY ALL), x AS (SELECT sum(total_words) AS all_words FROM stot),
j AS (SELECT w.party, w.speaker, w.word, w.n, CAST(n AS DOUBLE) / total_words * 1000 AS f, CAST(pn - n AS DOUBLE) / (pt - total_words) * 1000 AS fp, CAST(an - n AS DOUBLE) / (all_words - total_words) * 1000 AS fa
  FROM {source} w JOIN pw ON w.party = pw.party AND w.word = pw.word JOIN aw ON w.word = aw.word JOIN stot s ON w.party = s.party AND w.speaker = s.speaker JOIN pt ON w.party = pt.party, x
  WHERE w.n >= {min_count} AND pt - total_words > 0 AND all_words - total_words > 0 {extra}),
r AS (SELECT *, CASE WHEN fp > 0 THEN f / fp ELSE f * 10 END AS rp, CASE WHEN fa > 0 THEN f / fa ELSE f * 10 END AS ra FROM j)
SELECT party, speaker, word, n, round(rp, 1) AS ratio_party, round(ra, 1) AS ratio_corpus, row_number() OVER (PARTITION BY party, speaker ORDER BY round(rp, 1) DESC, n DESC, word) AS rank FROM r WHERE rp >= 2 QUALIFY rank <= 5"""


@query("signature_words", sql(_signature("wc", "AND length(w.word) >= 5", 5), "wc", "stot"))
def signature_words(spark, sf):
    return di.signature_words(_kept(spark, sf, ["party", "speaker"]))


@query("signature_adjectives", sql(_signature("wc", "AND w.word IN (SELECT word FROM lex WHERE scheme = 'adjective')", 3), "wc", "stot", "lex"))
def signature_adjectives(spark, sf):
    return di.signature_adjectives(_kept(spark, sf, ["party", "speaker"]), v.lexicon(spark))


# ---------------------------------------------------------------- lexicon


@query("lexicon_conflicts", sql("SELECT scheme, category, word, weight FROM lex WHERE word IN (SELECT word FROM pwc)", "lex", "pwc"))
def lexicon_conflicts(spark, sf):
    """The lexicon restricted to words that occur in the documents."""
    used = _wc(spark, sf, ["party"]).select("word").distinct()
    return v.lexicon(spark).join(used, "word", "left_semi")


@query("categorize", sql("SELECT party, word, CAST(sum(n) AS BIGINT) AS n, scheme, category FROM cat GROUP BY ALL", "cat"))
def categorize(spark, sf):
    return _categorized(spark, sf, ["party"]).drop("weight")


@query("category_totals", sql("SELECT party, scheme, category, CAST(sum(n) AS BIGINT) AS n FROM cat GROUP BY ALL", "cat"))
def category_totals(spark, sf):
    return lx.category_totals(_categorized(spark, sf, ["party"]), ["party"])


@query("top_words_per_category", sql("SELECT party, scheme, category, word, CAST(sum(n) AS BIGINT) AS n, row_number() OVER (PARTITION BY party, scheme, category ORDER BY sum(n) DESC, word) AS rank FROM cat GROUP BY party, scheme, category, word QUALIFY rank <= 2", "cat"))
def top_words_per_category(spark, sf):
    return lx.top_words_per_category(_categorized(spark, sf, ["party"]), ["party"], 2)


@query("primary_topic", sql("""
, m AS (SELECT word, category FROM multi QUALIFY row_number() OVER (PARTITION BY word ORDER BY weight DESC, ord) = 1),
l AS (SELECT * FROM m UNION ALL SELECT word, category FROM lex WHERE scheme = 'topic' AND word NOT IN (SELECT word FROM multi))
SELECT p.party, l.category AS topic, CAST(sum(p.n) AS BIGINT) AS n FROM pwc p JOIN l ON p.word = l.word GROUP BY ALL""", "multi", "lex", "pwc"))
def primary_topic(spark, sf):
    multi = lookup_frame(spark, [(*r, i) for i, r in enumerate(v.MULTI_LABEL)], "word string, category string, weight double, ord long")
    topics = lx.primary_topic(multi, v.lexicon(spark).filter(F.col("scheme") == "topic"))
    counts = _wc(spark, sf, ["party"])
    return counts.join(topics, "word").groupBy("party", F.col("category").alias("topic")).agg(F.sum("n").alias("n"))


@query("weighted_topics", sql("""
, l AS (SELECT word, category, weight FROM multi UNION ALL SELECT word, category, 1.0 FROM lex WHERE scheme = 'topic' AND word NOT IN (SELECT word FROM multi))
SELECT * FROM (SELECT p.party, l.category, p.word, CAST(CASE WHEN weight < 1 THEN floor(p.n * weight) ELSE p.n END AS BIGINT) AS n FROM pwc p JOIN l ON p.word = l.word) WHERE n > 0""", "multi", "lex", "pwc"))
def weighted_topics(spark, sf):
    multi = lookup_frame(spark, v.MULTI_LABEL, "word string, category string, weight double")
    single = v.lexicon(spark).filter(F.col("scheme") == "topic")
    return lx.topic_counts_weighted(_wc(spark, sf, ["party"]), single, multi, ["party"])


@query("multi_label_tags", sql("SELECT party, category AS tag, round(sum(n * weight), 6) AS weighted, CAST(sum(n) AS BIGINT) AS n FROM pwc p JOIN multi m ON p.word = m.word GROUP BY ALL", "multi", "pwc"))
def multi_label_tags(spark, sf):
    tags = lookup_frame(spark, v.MULTI_LABEL, "word string, category string, weight double")
    return lx.multi_label_tags(_wc(spark, sf, ["party"]), tags, ["party"]).withColumn("weighted", F.round("weighted", 6))


def _tone(spark, sf) -> DataFrame:
    return lx.tone_from_counts(_wc(spark, sf, ["party"]), v.lexicon(spark), ["party"])


def _topics(spark, sf) -> DataFrame:
    return lx.topics_from_counts(_wc(spark, sf, ["party"]), v.lexicon(spark), ["party"], v.TOPIC_LIST)


@query("tone_scores", sql("SELECT * FROM tone", "tone"))
def tone_scores(spark, sf):
    return _tone(spark, sf)


@query("topic_scores", sql("SELECT * FROM tscore", "tscore"))
def topic_scores(spark, sf):
    return _topics(spark, sf)


@query("topic_scores_from_categories", sql("SELECT * FROM tscore", "tscore"))
def topic_scores_from_categories(spark, sf):
    _, totals, cat = _cat(spark, sf, ["party"])
    return lx.topic_scores(cat, totals, ["party"], v.TOPIC_LIST)


@query("tone_scores_from_categories", sql("SELECT * FROM tone", "tone"))
def tone_scores_from_categories(spark, sf):
    _, totals, cat = _cat(spark, sf, ["party"])
    return lx.tone_scores(cat, totals, ["party"])


@query("top_topics", sql("SELECT *, row_number() OVER (PARTITION BY party ORDER BY score DESC, topic) AS rank FROM tscore WHERE score > 0 QUALIFY rank <= 5", "tscore"))
def top_topics(spark, sf):
    return lx.top_topics(_topics(spark, sf), ["party"], 5, positive_only=True)


@query("speaker_tone", sql("""
SELECT s.party, s.speaker, s.contributions, coalesce(t.total_words, 0) AS total_words, CASE WHEN contributions >= 3 AND coalesce(t.total_words, 0) >= 300 THEN 'sufficient' ELSE 'low' END AS confidence,
  coalesce(c.adjectives, 0) AS adjectives, coalesce(c.verbs, 0) AS verbs, """ + ", ".join(f"coalesce(t.{m}, {50.0 if m in ('affirmative', 'solution_focus', 'collaboration', 'authority', 'future_orientation', 'emotional_intensity', 'inclusivity') else 0.0}) AS {m}" for m in lx.TONE_METRICS) + """
FROM (SELECT party, speaker, count(*) AS contributions FROM corpus GROUP BY ALL) s LEFT JOIN stone t ON s.party = t.party AND s.speaker = t.speaker
LEFT JOIN (SELECT party, speaker, CAST(coalesce(sum(n) FILTER (scheme = 'adjective'), 0) AS BIGINT) AS adjectives, CAST(coalesce(sum(n) FILTER (scheme = 'verb'), 0) AS BIGINT) AS verbs FROM cat GROUP BY ALL) c ON s.party = c.party AND s.speaker = c.speaker""", "corpus", "stone"))
def speaker_tone(spark, sf):
    by = ["party", "speaker"]
    counts, _, cat = _cat(spark, sf, by)
    contributions = v.corpus_docs(spark, sf).groupBy(*by).agg(F.count(F.lit(1)).alias("contributions"))
    return lx.speaker_tone(counts, cat, contributions)


@query("speaker_topics", sql("""
, c AS (SELECT party, speaker, category AS topic, sum(n) AS n FROM cat WHERE scheme = 'topic' GROUP BY ALL),
w AS (SELECT party, speaker, category AS topic, word, sum(n) AS n, row_number() OVER (PARTITION BY party, speaker, category ORDER BY sum(n) DESC, word) AS r FROM cat WHERE scheme = 'topic' GROUP BY party, speaker, category, word QUALIFY r <= 5),
b AS (SELECT c.party, c.speaker, c.topic, round(CAST(n AS DOUBLE) / total_words * 1000, 2) AS score FROM c JOIN stot s ON c.party = s.party AND c.speaker = s.speaker JOIN topics t ON c.topic = t.topic)
SELECT b.party, b.speaker, b.topic, b.score, b.rank, (SELECT string_agg(word || ':' || CAST(n AS BIGINT), ',' ORDER BY r) FROM w WHERE w.party = b.party AND w.speaker = b.speaker AND w.topic = b.topic) AS words
FROM (SELECT *, row_number() OVER (PARTITION BY party, speaker ORDER BY score DESC, topic) AS rank FROM b WHERE score > 0 QUALIFY rank <= 5) b""", "cat", "stot", "topics"))
def speaker_topics(spark, sf):
    counts, _, cat = _cat(spark, sf, ["party", "speaker"])
    out = lx.speaker_topics(counts, cat, topics=v.TOPIC_LIST)
    words = F.array_join(F.transform("words", lambda w: F.concat_ws(":", w["word"], w["n"].cast("string"))), ",")
    return out.select("party", "speaker", "topic", "score", "rank", words.alias("words"))


@query("group_topics_rollup", sql(f"""
, t AS (SELECT party, grouping(party) = 1 AS overall, sum(total_words) AS tw FROM ptot GROUP BY ROLLUP (party)),
h AS (SELECT party, grouping(party) = 1 AS overall, category AS topic, sum(n) AS n FROM cat WHERE scheme = 'topic' GROUP BY GROUPING SETS ((topic, party), (topic))),
g AS (SELECT t.party, t.overall, topics.topic, round({div('coalesce(h.n, 0)', 't.tw', '0.0', '1000')}, 2) AS score FROM t CROSS JOIN topics LEFT JOIN h ON h.topic = topics.topic AND h.overall = t.overall AND h.party IS NOT DISTINCT FROM t.party)
SELECT party, overall, topic, score, CASE WHEN r <= 6 THEN r END AS rank FROM (SELECT *, row_number() OVER (PARTITION BY overall, party ORDER BY score DESC, topic) AS r FROM g)""", "ptot", "cat", "topics"))
def group_topics_rollup(spark, sf):
    counts, _, cat = _cat(spark, sf, ["party"])
    return lx.group_topics(counts, cat, topics=v.TOPIC_LIST)


@query("score_documents", sql(f"""
, dt AS (SELECT speech_id AS doc_id, word, count(*) AS n FROM tokens GROUP BY ALL), tt AS (SELECT d.doc_id, CAST(coalesce(sum(n), 0) AS BIGINT) AS total_words FROM documents d LEFT JOIN dt ON d.doc_id = dt.doc_id GROUP BY ALL),
c AS (SELECT d.doc_id, d.n, scheme, category FROM dt d JOIN lex ON d.word = lex.word)
SELECT t.doc_id, max(t.total_words) AS total_words, {tone_columns('t.total_words')} FROM tt t LEFT JOIN c ON t.doc_id = c.doc_id GROUP BY t.doc_id""", "tokens", "lex"))
def score_documents(spark, sf):
    return lx.score_documents(v.read(spark, sf, "documents"), v.lexicon(spark), topics=v.TOPIC_LIST, min_len=4)[0]


@query("score_document_topics", sql(f"""
, dt AS (SELECT speech_id AS doc_id, word, count(*) AS n FROM tokens GROUP BY ALL), tt AS (SELECT d.doc_id, CAST(coalesce(sum(n), 0) AS BIGINT) AS total_words FROM documents d LEFT JOIN dt ON d.doc_id = dt.doc_id GROUP BY ALL),
c AS (SELECT d.doc_id, category AS topic, CAST(sum(d.n) AS BIGINT) AS n FROM dt d JOIN lex ON d.word = lex.word WHERE scheme = 'topic' GROUP BY ALL)
SELECT t.doc_id, topics.topic, coalesce(c.n, 0) AS n, {div('coalesce(c.n, 0)', 't.total_words', '0.0', '1000')} AS score FROM tt t CROSS JOIN topics LEFT JOIN c ON t.doc_id = c.doc_id AND topics.topic = c.topic""", "tokens", "lex", "topics"))
def score_document_topics(spark, sf):
    return lx.score_documents(v.read(spark, sf, "documents"), v.lexicon(spark), topics=v.TOPIC_LIST, min_len=4)[1]


@query("score_document_words", sql("SELECT speech_id AS doc_id, word, count(*) AS n, row_number() OVER (PARTITION BY speech_id ORDER BY count(*) DESC, word) AS rank FROM tokens GROUP BY speech_id, word QUALIFY rank <= 10", "tokens"))
def score_document_words(spark, sf):
    return lx.score_documents(v.read(spark, sf, "documents"), v.lexicon(spark), topics=v.TOPIC_LIST, min_len=4)[2]


_ROUNDED = ", ".join(f"round({m}, {2 if m == 'discriminatory' else 1}) AS {m}" for m in lx.TONE_METRICS)
_LONG = " UNION ALL ".join(f"SELECT party, '{m}' AS metric, {m} AS score FROM tone" for m in lx.TONE_METRICS)


@query("tone_comparison", sql(f"SELECT party, {_ROUNDED} FROM tone", "tone"))
def tone_comparison(spark, sf):
    return lx.tone_comparison(_tone(spark, sf))


@query("tone_rankings", sql(f"SELECT *, row_number() OVER (PARTITION BY metric ORDER BY score DESC, party) AS rank FROM ({_LONG})", "tone"))
def tone_rankings(spark, sf):
    return lx.tone_ranking(_tone(spark, sf))


@query("category_word_counts", sql("SELECT p.party, CAST(coalesce(sum(c.n) FILTER (scheme = 'discriminatory'), 0) AS BIGINT) AS n FROM (SELECT DISTINCT party FROM cat) p JOIN cat c ON p.party = c.party GROUP BY ALL", "cat"))
def category_word_counts(spark, sf):
    return lx.category_word_counts(_categorized(spark, sf, ["party"]), "discriminatory")


@query("champion_word", sql("SELECT party, word, CAST(sum(n) AS BIGINT) AS n FROM cat WHERE scheme = 'adjective' AND category = 'labeling' GROUP BY ALL ORDER BY n DESC, word, party LIMIT 1", "cat"))
def champion_word(spark, sf):
    return lx.champion_word(_categorized(spark, sf, ["party"]), "adjective", "labeling")


@query("score_spread", sql(f"SELECT metric, arg_max(party, (score, party)) AS best, arg_min(party, (score, party)) AS worst, max(score) - min(score) AS spread FROM ({_LONG}) GROUP BY metric", "tone"))
def score_spread(spark, sf):
    return lx.score_spread(_tone(spark, sf))


# ---------------------------------------------------------------- activity

_F = "count(*) FILTER"


@query("activity_counts", sql(f"SELECT party, speaker, {_F} (type = 'rede') AS formal, {_F} (type IN ('befragung', 'fragestunde_antwort')) AS befragung, {_F} (type = 'fragestunde') AS fragestunde, {_F} (category <> 'rede') AS wortbeitrag FROM corpus GROUP BY ALL", "corpus"))
def activity_counts(spark, sf):
    return ac.activity_counts(v.corpus_docs(spark, sf))


@query("activity_by_party", sql(f"SELECT party, {_F} (type = 'rede') AS real_speech, {_F} (category = 'rede') AS rede, {_F} (category <> 'rede') AS wortbeitrag FROM corpus GROUP BY ALL", "corpus"))
def activity_by_party(spark, sf):
    return ac.activity_by_party(v.corpus_docs(spark, sf))


_LENGTHS = f"SELECT party, count(*) AS speeches, min(words) AS min_words, max(words) AS max_words, CAST(sum(words) AS DOUBLE) / count(*) AS avg_words, {_F} (acad_title IS NOT NULL) AS dr_count, CAST({_F} (acad_title IS NOT NULL) AS DOUBLE) / count(*) AS dr_ratio, count(DISTINCT speaker) FILTER (acad_title IS NOT NULL) AS titled_speakers FROM corpus GROUP BY party"


@query("length_stats", sql(_LENGTHS, "corpus"))
def length_stats(spark, sf):
    return ac.length_stats(v.corpus_docs(spark, sf))


@query("academic_ranking", sql(f"SELECT party, dr_ratio, dr_count, speeches FROM ({_LENGTHS})", "corpus"))
def academic_ranking(spark, sf):
    return rk.academic_ranking(ac.length_stats(v.corpus_docs(spark, sf)))


_INDEX = f"""SELECT speaker, any_value(party) AS party, trim(regexp_replace(lower(speaker), '[^a-z0-9]+', '-', 'g'), '-') AS slug, {_F} (category = 'rede') AS speeches, {_F} (category <> 'rede') AS wortbeitraege,
  {_F} (type = 'befragung') AS befragung_responses, count(*) AS total_interventions, CAST(sum(words) AS BIGINT) AS total_words, CAST(round(CAST(sum(words) AS DOUBLE) / count(*)) AS BIGINT) AS avg_words,
  min(words) AS min_words, max(words) AS max_words, CAST(arg_min([acad_title], speech_id)[1] AS VARCHAR) AS acad_title FROM corpus GROUP BY speaker"""


def _index(spark, sf) -> DataFrame:
    return ac.speaker_index(v.corpus_docs(spark, sf), ["speech_id"])


@query("speaker_index", sql(_INDEX, "corpus"))
def speaker_index(spark, sf):
    return _index(spark, sf)


@query("group_averages", sql(f"SELECT party, CAST(round({div('sum(total_words)', 'sum(speeches)')}) AS BIGINT) AS avg_words_formal, CAST(round({div('sum(total_words)', 'sum(total_interventions)')}) AS BIGINT) AS avg_words_all, grouping(party) = 1 AS overall FROM ({_INDEX}) GROUP BY ROLLUP (party)", "corpus"))
def group_averages(spark, sf):
    return ac.group_averages(_index(spark, sf))


def _style_input(spark, sf) -> DataFrame:
    docs = v.corpus_docs(spark, sf)
    totals = docs.groupBy("party").agg(F.count(F.lit(1)).alias("speeches"), F.sum("words").alias("total_words"))
    counts = _kept(spark, sf, ["party"])
    words = counts.groupBy("party").agg(F.count(F.lit(1)).alias("unique_nouns"), F.sum("n").alias("total_nouns"))
    cat = lx.category_totals(lx.categorize(counts, v.lexicon(spark)), ["party"]).groupBy("party").agg(
        F.sum(F.when(F.col("scheme") == "adjective", F.col("n"))).alias("total_adjectives"),
        F.sum(F.when(F.col("scheme") == "verb", F.col("n"))).alias("total_verbs"),
    )
    return totals.join(words, "party").join(cat, "party").na.fill(0)


_STYLE = f"""
, s AS (SELECT party, count(*) AS speeches, sum(words) AS total_words FROM corpus GROUP BY ALL), w AS (SELECT party, count(*) AS un, sum(n) AS tn FROM pwc GROUP BY ALL),
c AS (SELECT party, coalesce(sum(n) FILTER (scheme = 'adjective'), 0) AS ta, coalesce(sum(n) FILTER (scheme = 'verb'), 0) AS tv FROM cat GROUP BY ALL),
style AS (SELECT s.party, CAST(total_words AS DOUBLE) / speeches AS avg_speech_length, CAST(un AS DOUBLE) / greatest(tn, 1) AS vocabulary_richness, CAST(ta AS DOUBLE) / greatest(tn, 1) AS descriptiveness, CAST(tv AS DOUBLE) / greatest(tn, 1) AS action_orientation FROM s JOIN w ON s.party = w.party JOIN c ON s.party = c.party)"""


@query("style_metrics", sql(_STYLE + " SELECT * FROM style", "corpus", "pwc", "cat"))
def style_metrics(spark, sf):
    return ac.style_metrics(_style_input(spark, sf))


@query("unique_speakers", sql("SELECT party, count(DISTINCT speaker) AS speakers FROM corpus WHERE type = 'rede' GROUP BY ROLLUP (party)", "corpus"))
def unique_speakers(spark, sf):
    return ac.unique_speakers(v.corpus_docs(spark, sf))


@query("corpus_overview", sql(f"SELECT count(*) AS speeches, {_F} (category = 'rede') AS reden, {_F} (category <> 'rede') AS wortbeitraege, CAST(sum(words) AS BIGINT) AS words, count(DISTINCT party) AS parties, count(DISTINCT speaker) AS speakers FROM corpus", "corpus"))
def corpus_overview(spark, sf):
    return ac.corpus_overview(v.corpus_docs(spark, sf))


@query("group_overview", sql(_STYLE.replace(", s AS (", ", sz AS (", 1).replace("FROM s JOIN", "FROM sz s JOIN").replace(", w AS (", ", wz AS (", 1).replace("JOIN w ON", "JOIN wz w ON").replace("c AS (SELECT party, coalesce", "cz AS (SELECT party, coalesce", 1).replace("JOIN c ON", "JOIN cz c ON") + _folded(5) + f""",
sg AS (SELECT party, word, ratio, row_number() OVER (PARTITION BY party ORDER BY round(ratio * sqrt(per_1000), 6) DESC, word) AS k FROM r WHERE n >= counted * 0.0005::DOUBLE AND ratio > 2 QUALIFY k <= 5),
fm AS (SELECT party, speaker, {_F} (type = 'rede') AS formal, count(*) AS n, sum(words) AS w FROM corpus GROUP BY ALL),
tw AS (SELECT party, word, n, row_number() OVER (PARTITION BY party ORDER BY n DESC, word) AS k FROM pwc QUALIFY k <= 7)
SELECT fm.party, CAST(sum(formal) AS BIGINT) AS speeches, CAST(sum(n) - sum(formal) AS BIGINT) AS wortbeitraege, CAST(sum(w) AS BIGINT) AS total_words, {_F} (formal > 0) AS unique_speakers,
  arg_min(speaker, (-formal, speaker)) AS top_speaker, max(formal) AS top_speeches, (SELECT string_agg(word || ':' || n, ',' ORDER BY k) FROM tw WHERE tw.party = fm.party) AS top_words,
  coalesce((SELECT string_agg(word || ':' || CAST(round(ratio * 10) AS BIGINT), ',' ORDER BY k) FROM sg WHERE sg.party = fm.party), '') AS signature_words,
  coalesce((SELECT array_to_string(list_transform(ks, lambda x: x.word || ':' || CAST(x.n AS BIGINT) || ':' || CAST(round(x.ratio * 10) AS BIGINT)), ',') FROM folded WHERE folded.party = fm.party), '') AS key_topics,
  CAST(floor(any_value(avg_speech_length)) AS BIGINT) AS avg_speech_length, round(any_value(descriptiveness) * 100, 1) AS descriptiveness
FROM fm JOIN style s ON fm.party = s.party GROUP BY fm.party""", "corpus", "pwc", "cat", "ptot"))
def group_overview(spark, sf):
    docs = v.corpus_docs(spark, sf)
    counts, totals = _party(spark, sf)
    out = ac.group_overview(
        docs, tk.top_words(counts, ["party"], 7), di.distinctive_words(counts, totals), di.key_topics(counts, totals, n=5),
        ac.style_metrics(_style_input(spark, sf)),
    )
    tenths = lambda c: F.round(c * 10).cast("long").cast("string")
    listed = lambda name, *parts: F.array_join(F.transform(F.coalesce(F.col(name), F.array().cast(out.schema[name].dataType)), lambda w: F.concat_ws(":", *[p(w) for p in parts])), ",").alias(name)
    word, n, ratio_ = (lambda w: w["word"]), (lambda w: w["n"].cast("string")), (lambda w: tenths(w["ratio"]))
    return out.select(
        "party", "speeches", "wortbeitraege", "total_words", "unique_speakers", F.col("top_speaker.name").alias("top_speaker"), F.col("top_speaker.speeches").alias("top_speeches"),
        listed("top_words", word, n), listed("signature_words", word, ratio_), listed("key_topics", word, n, ratio_), "avg_speech_length", "descriptiveness",
    )


@query("speaker_analysis", sql("""
, c AS (SELECT party, speaker, count(*) AS speeches, CAST(sum(words) AS BIGINT) AS words, round(CAST(sum(words) AS DOUBLE) / count(*), 1) AS avg_words FROM corpus GROUP BY ALL),
w AS (SELECT party, speaker, word, n, row_number() OVER (PARTITION BY party, speaker ORDER BY n DESC, word) AS r FROM wc QUALIFY r <= 20),
l AS (SELECT party, speaker, string_agg(word || ':' || n, ',' ORDER BY r) AS top_words FROM w GROUP BY ALL),
m AS (SELECT party, speaker, category AS topic, CAST(sum(n) AS BIGINT) AS k FROM cat WHERE scheme = 'topic' GROUP BY ALL),
g AS (SELECT s.party, s.speaker, string_agg(topic || ':' || CAST(round(coalesce(k, 0) * CAST(1000000 AS DOUBLE) / s.total_words) AS BIGINT), ',' ORDER BY topic) AS topic_list
  FROM (SELECT * FROM stot, topics) s LEFT JOIN m USING (party, speaker, topic) GROUP BY ALL)
SELECT c.*, l.top_words, """ + ", ".join(f"t.{m}" for m in lx.TONE_METRICS) + """, g.topic_list FROM c LEFT JOIN l ON c.party = l.party AND c.speaker = l.speaker LEFT JOIN stone t ON c.party = t.party AND c.speaker = t.speaker
LEFT JOIN g ON c.party = g.party AND c.speaker = g.speaker""", "corpus", "wc", "stone", "topics"))
def speaker_analysis(spark, sf):
    by = ["party", "speaker"]
    counts, totals, cat = _cat(spark, sf, by)
    out = ac.speaker_analysis(
        v.corpus_docs(spark, sf), counts, lx.tone_scores(cat, totals, by), lx.topic_scores(cat, totals, by, v.TOPIC_LIST)
    )
    words = F.array_join(F.transform("top_words", lambda w: F.concat_ws(":", w["word"], w["n"].cast("string"))), ",")
    topics = F.array_join(F.transform("topics", lambda t: F.concat_ws(":", t["topic"], F.round(t["score"] * 1000).cast("long").cast("string"))), ",")
    return out.select(*by, "speeches", "words", "avg_words", words.alias("top_words"), *[f"tone.{m}" for m in lx.TONE_METRICS], topics.alias("topic_list"))


def _compare(spark, sf) -> tuple[DataFrame, DataFrame, DataFrame]:
    return ac.compare_parties(v.corpus_docs(spark, sf), _tone(spark, sf), _topics(spark, sf), ["en", "de", "fr"])


_ACT = "SELECT party, count(DISTINCT speaker) AS speakers, count(*) AS speeches, CAST(sum(words) AS BIGINT) AS words, round(CAST(sum(words) AS DOUBLE) / count(*), 1) AS avg_words FROM corpus WHERE party IN ('en', 'de', 'fr') GROUP BY party"


@query("compare_parties_activity", sql(_ACT, "corpus"))
def compare_parties_activity(spark, sf):
    return _compare(spark, sf)[0]


@query("compare_parties_rankings", sql(f"""
, a AS ({_ACT}), l AS (SELECT party, 'speeches' AS metric, CAST(speeches AS DOUBLE) AS value FROM a UNION ALL SELECT party, 'aggression', aggression FROM tone WHERE party IN ('en', 'de', 'fr') UNION ALL SELECT party, 'collaboration', collaboration FROM tone WHERE party IN ('en', 'de', 'fr'))
SELECT *, row_number() OVER (PARTITION BY metric ORDER BY value DESC, party) AS rank FROM l""", "corpus", "tone"))
def compare_parties_rankings(spark, sf):
    return _compare(spark, sf)[1]


@query("compare_parties_topics", sql("SELECT topic, max(score) AS highest, min(score) AS lowest, max(score) - min(score) AS spread, arg_max(party, (score, party)) AS leader FROM tscore WHERE party IN ('en', 'de', 'fr') GROUP BY topic", "tscore"))
def compare_parties_topics(spark, sf):
    return _compare(spark, sf)[2]


def _typed(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Words of each party as nouns, adjectives and verbs, and the categorised ones."""
    counts = _kept(spark, sf, ["party"])
    cat = lx.categorize(counts, v.lexicon(spark))
    kinds = cat.filter(F.col("scheme").isin("adjective", "verb")).select("party", "word", "n", F.col("scheme").alias("word_type"))
    return counts.withColumn("word_type", F.lit("noun")).unionByName(kinds), cat


_TONES = ", ".join(f"('{m}', {m})" for m in lx.TONE_METRICS)
_BY_SCORE = " UNION ALL ".join(f"SELECT party, 'by_{m}', NULL, {m}, CAST(row_number() OVER (ORDER BY {m} DESC, party) AS BIGINT) FROM tone WHERE party <> 'es'" for m in ("aggression", "collaboration", "solution_focus"))


@query("compare_profiles", sql(f"""
, b AS (SELECT party, CAST(count(DISTINCT speaker) AS DOUBLE) AS speakers, CAST(count(*) AS DOUBLE) AS speeches, CAST(sum(words) AS DOUBLE) AS words, round(CAST(sum(words) AS DOUBLE) / count(*), 1) AS avg_words FROM corpus WHERE party <> 'es' GROUP BY party),
k AS (SELECT party, 'noun' AS word_type, word, n FROM pwc UNION ALL SELECT party, scheme, word, n FROM (SELECT party, scheme, word, sum(n) AS n FROM cat WHERE scheme IN ('adjective', 'verb') GROUP BY ALL)),
o AS (SELECT *, row_number() OVER (PARTITION BY party, word_type ORDER BY n DESC, word) AS rank FROM k WHERE party <> 'es' QUALIFY rank <= 20)
SELECT party, 'activity' AS part, u.n AS item, u.x AS value, CAST(NULL AS BIGINT) AS rank FROM (SELECT party, unnest([{{'n': 'speakers', 'x': speakers}}, {{'n': 'speeches', 'x': speeches}}, {{'n': 'words', 'x': words}}, {{'n': 'avg_words', 'x': avg_words}}]) AS u FROM b)
UNION ALL SELECT party, word_type, word, CAST(n AS DOUBLE), rank FROM o
UNION ALL SELECT o.party, word_type || '_per_1000', word, CAST(n AS DOUBLE) / words * 1000, rank FROM o JOIN b ON o.party = b.party
UNION ALL SELECT party, 'tone', u.n, u.x, NULL FROM (SELECT party, unnest([{", ".join(f"{{'n': '{m}', 'x': {m}}}" for m in ["total_words", *lx.TONE_METRICS])}]) AS u FROM tone WHERE party <> 'es')
UNION ALL SELECT party, 'topic', topic, score, NULL FROM tscore WHERE party <> 'es'
UNION ALL {_BY_SCORE}""", "corpus", "pwc", "cat", "tone", "tscore"))
def compare_profiles(spark, sf):
    """Whole profiles of three parties: activity, top words by type, all tone and topic scores, rankings."""
    words, _ = _typed(spark, sf)
    return ac.compare_profiles(v.corpus_docs(spark, sf), words, _tone(spark, sf), _topics(spark, sf), ["en", "de", "fr"])


@query("tone_facts", sql("""
, k AS (SELECT party, category, word, sum(n) AS n FROM cat WHERE scheme = 'adjective' GROUP BY ALL),
e AS (SELECT arg_min(party, (-affirmative, party)) AS hi, arg_max(party, (-affirmative, party)) AS lo, max(affirmative) - min(affirmative) AS spread, count(*) AS n FROM tone)
SELECT * FROM (SELECT 'most_aggressive' AS fact, party, CAST(NULL AS VARCHAR) AS other, CAST(NULL AS VARCHAR) AS item, aggression AS value FROM tone ORDER BY aggression DESC, party LIMIT 1)
UNION ALL SELECT * FROM (SELECT 'most_labeling', party, NULL, NULL, labeling FROM tone WHERE labeling > 1 ORDER BY labeling DESC, party LIMIT 1)
UNION ALL SELECT * FROM (SELECT 'most_collaborative', party, NULL, NULL, collaboration FROM tone ORDER BY collaboration DESC, party LIMIT 1)
UNION ALL SELECT * FROM (SELECT 'labeling_word', party, NULL, word, CAST(n AS DOUBLE) FROM k WHERE category = 'labeling' ORDER BY n DESC, word, party LIMIT 1)
UNION ALL SELECT * FROM (SELECT 'aggressive_word', party, NULL, word, CAST(n AS DOUBLE) FROM k WHERE category = 'aggressive' ORDER BY n DESC, word, party LIMIT 1)
UNION ALL SELECT 'affirmative_spread', hi, lo, NULL, spread FROM e WHERE n >= 2 AND spread > 10""", "cat", "tone"))
def tone_facts(spark, sf):
    _, cat = _typed(spark, sf)
    words = cat.filter("scheme = 'adjective'").groupBy("party", "category", "word").agg(F.sum("n").alias("n"))
    return ac.tone_facts(_tone(spark, sf), words)


@query("has_scores", sql("SELECT 'tone' AS scores, count(*) > 0 AS present FROM tone UNION ALL SELECT 'tone of nobody', false", "tone"))
def has_scores(spark, sf):
    """Whether there are scores, for all parties and for one that does not occur."""
    tone = _tone(spark, sf)
    rows = [("tone", lx.has_scores(tone)), ("tone of nobody", lx.has_scores(tone.filter("party = 'nobody'")))]
    return lookup_frame(spark, rows, "scores string, present boolean")


@query("kpi_facts", sql("""
, t AS (SELECT sum(words) AS w, count(*) AS n FROM corpus)
SELECT 'words_per_session' AS fact, CAST(w // 50 AS BIGINT) AS value FROM t UNION ALL SELECT 'words_per_speech', CAST(w // n AS BIGINT) FROM t UNION ALL SELECT 'book_equivalents', CAST(w // 50000 AS BIGINT) FROM t""", "corpus"))
def kpi_facts(spark, sf):
    return ac.kpi_facts(v.corpus_docs(spark, sf), 50)


@query("summary", sql("""
, k AS (SELECT party, scheme, word, sum(n) AS n FROM cat WHERE scheme IN ('adjective', 'verb') GROUP BY ALL UNION ALL SELECT party, 'noun', word, n FROM pwc),
s AS (SELECT party, count(*) AS speeches, CAST(sum(words) AS BIGINT) AS total_words FROM corpus GROUP BY ROLLUP (party)),
w AS (SELECT party, """ + ", ".join(f"count(DISTINCT word) FILTER (scheme = '{k}') AS unique_{k}s, CAST(coalesce(sum(n) FILTER (scheme = '{k}'), 0) AS BIGINT) AS total_{k}s" for k in ("noun", "adjective", "verb")) + """ FROM k GROUP BY ROLLUP (party))
SELECT s.*, w.* EXCLUDE (party) FROM s JOIN w ON s.party IS NOT DISTINCT FROM w.party""", "corpus", "pwc", "cat"))
def summary(spark, sf):
    counts = _kept(spark, sf, ["party"])
    cat = lx.categorize(counts, v.lexicon(spark)).filter(F.col("scheme").isin("adjective", "verb"))
    typed = counts.withColumn("word_type", F.lit("noun")).unionByName(cat.select("party", "word", "n", F.col("scheme").alias("word_type")))
    totals = v.corpus_docs(spark, sf).groupBy("party").agg(F.count(F.lit(1)).alias("speeches"), F.sum("words").alias("total_words"))
    return wr.summary(typed, totals)


@query("speech_db", sql("SELECT row_number() OVER (ORDER BY speaker, speech_id) AS id, speaker, party, substring(text, 1, 500) AS text, type, words FROM corpus", "corpus"))
def speech_db(spark, sf):
    return wr.speech_db(v.corpus_docs(spark, sf), "short")


# ---------------------------------------------------------------- rankings


def _ranked(cond: str, n: int, by: str = "") -> str:
    part = f"PARTITION BY {by} " if by else ""
    return f"SELECT speaker, party, count(*) AS n, row_number() OVER ({part}ORDER BY count(*) DESC, speaker, party) AS rank FROM corpus WHERE {cond} GROUP BY speaker, party QUALIFY rank <= {n}"


@query("top_speakers", sql(_ranked("type = 'rede'", 10), "corpus"))
def top_speakers(spark, sf):
    return rk.top_speakers(v.corpus_docs(spark, sf), 10)


@query("question_time_speakers", sql(_ranked("type = 'fragestunde'", 10), "corpus"))
def question_time_speakers(spark, sf):
    return rk.question_time_speakers(v.corpus_docs(spark, sf), 10)


@query("befragung_responders", sql(_ranked("type = 'befragung'", 10), "corpus"))
def befragung_responders(spark, sf):
    return rk.befragung_responders(v.corpus_docs(spark, sf), 10)


@query("group_top_speakers", sql(_ranked("type = 'rede'", 3, "party"), "corpus"))
def group_top_speakers(spark, sf):
    return rk.group_top_speakers(v.corpus_docs(spark, sf), 3)


@query("group_champion", sql(f"SELECT speaker, party, n FROM ({_ranked("type = 'rede'", 1, "party")})", "corpus"))
def group_champion(spark, sf):
    return rk.group_champion(v.corpus_docs(spark, sf))


@query("marathon", sql("SELECT speech_id, speaker, party, words, row_number() OVER (ORDER BY words DESC, speech_id) AS rank FROM corpus QUALIFY rank <= 5", "corpus"))
def marathon(spark, sf):
    return rk.marathon(v.corpus_docs(spark, sf), 5)


@query("verbose", sql("SELECT speaker, party, CAST(sum(words) AS DOUBLE) / count(*) AS avg_words, count(*) AS speeches, row_number() OVER (ORDER BY CAST(sum(words) AS DOUBLE) / count(*) DESC, speaker) AS rank FROM corpus GROUP BY speaker, party HAVING count(*) >= 5 QUALIFY rank <= 5", "corpus"))
def verbose(spark, sf):
    return rk.verbose(v.corpus_docs(spark, sf))


@query("wordiest", sql("SELECT speaker, party, CAST(sum(words) AS BIGINT) AS total_words, count(*) AS speeches, row_number() OVER (ORDER BY sum(words) DESC, speaker) AS rank FROM corpus GROUP BY speaker, party QUALIFY rank <= 5", "corpus"))
def wordiest(spark, sf):
    return rk.wordiest(v.corpus_docs(spark, sf))


@query("avg_words_formal", sql("SELECT speaker, party, CAST(sum(words) AS BIGINT) AS total_words, count(*) AS speeches, CAST(sum(words) // count(*) AS BIGINT) AS avg_words, row_number() OVER (ORDER BY sum(words) // count(*) DESC, speaker) AS rank FROM corpus WHERE type = 'rede' GROUP BY speaker, party HAVING count(*) >= 5 QUALIFY rank <= 20", "corpus"))
def avg_words_formal(spark, sf):
    return rk.avg_words_formal(v.corpus_docs(spark, sf))


def _rank_sql(metric: str, out: str, part: str = "", cond: str = "TRUE") -> str:
    over = f"PARTITION BY {cond}{', ' + part if part else ''} ORDER BY {metric} DESC, speaker"
    return f"CASE WHEN {cond} THEN row_number() OVER ({over}) END AS {out}"


_RANKS = f"""
, i AS ({_INDEX}), r AS (SELECT speaker, party, {_rank_sql('speeches', 'speech_rank')}, {_rank_sql('total_words', 'words_rank')}, {_rank_sql('avg_words', 'verbosity_rank', '', 'speeches >= 3')},
  {_rank_sql('max_words', 'longest_speech_rank')}, {_rank_sql('speeches', 'party_speech_rank', 'party')}, {_rank_sql('total_words', 'party_words_rank', 'party')}, {_rank_sql('avg_words', 'party_verbosity_rank', 'party', 'speeches >= 3')},
  count(*) OVER () AS total_speakers, CASE WHEN speeches >= 3 THEN count(*) FILTER (speeches >= 3) OVER () END AS verbosity_total, count(*) OVER (PARTITION BY party) AS party_size FROM i),
ranks AS (SELECT *, round((1 - CAST(speech_rank AS DOUBLE) / total_speakers) * 100, 1) AS speech_percentile, round((1 - CAST(words_rank AS DOUBLE) / total_speakers) * 100, 1) AS words_percentile FROM r)"""


@query("speaker_ranks", sql(_RANKS + " SELECT * FROM ranks", "corpus"))
def speaker_ranks(spark, sf):
    return rk.speaker_ranks(_index(spark, sf))


@query("speaker_comparison", sql(f"""
, i AS ({_INDEX}), a AS (SELECT party, CAST(round({div('sum(total_words)', 'sum(total_interventions)')}) AS BIGINT) AS aw, CAST(round({div('sum(total_words)', 'sum(speeches)')}) AS BIGINT) AS af FROM i GROUP BY ROLLUP (party))
SELECT i.speaker, i.party, avg_words AS speaker_avg_words, p.aw AS party_avg_words, c.aw AS corpus_avg_words, round({div('avg_words', 'p.aw', '1.0')}, 2) AS vs_party, round({div('avg_words', 'c.aw', '1.0')}, 2) AS vs_corpus,
  round({div('avg_words', 'p.af', '1.0')}, 2) AS vs_party_formal, round({div('avg_words', 'c.af', '1.0')}, 2) AS vs_corpus_formal FROM i JOIN a p ON i.party = p.party, (SELECT * FROM a WHERE party IS NULL) c""", "corpus"))
def speaker_comparison(spark, sf):
    index = _index(spark, sf)
    return rk.speaker_comparison(index, ac.group_averages(index))


@query("speaker_listing", sql(f"SELECT slug, speaker, party, speeches, wortbeitraege, befragung_responses, total_words FROM ({_INDEX}) WHERE party = 'en' AND contains(speaker, '1') ORDER BY speeches DESC, speaker LIMIT 10", "corpus"))
def speaker_listing(spark, sf):
    return rk.speaker_listing(_index(spark, sf), party="en", search="1", limit=10)


# ---------------------------------------------------------------- group profiles and archetypes

_GROUP_LONG = " UNION ALL ".join(f"SELECT party, '{m}' AS metric, {i} AS o, {m} AS score FROM tone" for i, m in enumerate([*rk.GROUP_METRICS, rk.VARYING_METRIC], 1))
_GROUP_RANKS = f", gr AS (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY score DESC, party) AS rank, count(*) OVER (PARTITION BY metric) AS g, max(score) OVER (PARTITION BY metric) > min(score) OVER (PARTITION BY metric) AS varies FROM ({_GROUP_LONG}))"


@query("group_rankings", sql(_GROUP_RANKS + f" SELECT party, metric, rank, score FROM gr WHERE metric <> '{rk.VARYING_METRIC}'", "tone"))
def group_rankings(spark, sf):
    return rk.group_rankings(_tone(spark, sf))


_CLASSIFY = f"SELECT party, metric AS category, rank, score FROM gr WHERE metric <> '{rk.VARYING_METRIC}' QUALIFY row_number() OVER (PARTITION BY party ORDER BY rank, score DESC, o) = 1"


@query("group_classify", sql(_GROUP_RANKS + _CLASSIFY.replace("SELECT", " SELECT", 1), "tone"))
def group_classify(spark, sf):
    return rk.classify_group(_tone(spark, sf))


_TRAITS = f"""SELECT t.party, coalesce((SELECT string_agg(metric, ',' ORDER BY r) FROM (SELECT metric, party, row_number() OVER (PARTITION BY party ORDER BY rank, o) AS r FROM gr WHERE rank <= 2 AND (metric <> '{rk.VARYING_METRIC}' OR varies)) x WHERE x.party = t.party AND r <= 3), '') AS traits FROM tone t"""


@query("group_traits", sql(_GROUP_RANKS + " " + _TRAITS, "tone"))
def group_traits(spark, sf):
    return rk.group_traits(_tone(spark, sf)).withColumn("traits", F.array_join("traits", ","))


@query("group_profiles", sql(_GROUP_RANKS + f" SELECT c.party, c.category, c.rank, c.score, t.traits, s.affirmative, (SELECT count(*) FROM tone) AS total_groups FROM ({_CLASSIFY}) c JOIN ({_TRAITS}) t ON c.party = t.party JOIN tone s ON c.party = s.party", "tone"))
def group_profiles(spark, sf):
    p = rk.group_profiles(_tone(spark, sf))
    return p.select("party", "category", "rank", "score", F.array_join("traits", ",").alias("traits"), "scores.affirmative", "total_groups")


@query("classify_single", sql("""
, w AS (SELECT party, unnest([(aggression * 3, 0, 'aggression'), (discriminatory * 5, -1, 'discriminatory'), (demand_intensity * 3, -2, 'demand_intensity'), (abs(collaboration - 50), -3, 'collaboration'), (abs(solution_focus - 50), -4, 'solution_focus'), (abs(affirmative - 50), -5, 'affirmative')]) AS x FROM tone),
f AS (SELECT party, x[1] AS weight, x[2] AS o, x[3] AS category FROM w)
SELECT party, category, weight FROM f QUALIFY row_number() OVER (PARTITION BY party ORDER BY weight DESC, o DESC) = 1""", "tone"))
def classify_single(spark, sf):
    return rk.classify_single(_tone(spark, sf))


_CRITERIA = f"crit AS (SELECT * FROM {values(v.CRITERIA, 'archetype, metric, weight, scale, minimum, inverse')})"
_FEATURES = ["speeches", "total_words", "avg_words", "min_words", "max_words"]
_FIT = f"""
, i AS ({_INDEX}), {_CRITERIA},
l AS ({' UNION ALL '.join(f"SELECT speaker, party, '{m}' AS metric, CAST({m} AS DOUBLE) AS value FROM i" for m in _FEATURES)}),
fit AS (SELECT speaker, party, archetype, round(sum(weight * least(1.0, CASE WHEN inverse THEN greatest(0.0, scale - value) ELSE value END / scale)), 6) AS score FROM l JOIN crit c ON l.metric = c.metric
  GROUP BY ALL HAVING bool_and(minimum IS NULL OR value >= minimum))"""


def _fits(spark, sf) -> DataFrame:
    features = _index(spark, sf).select("speaker", "party", *_FEATURES)
    fits = rk.fit_scores(features, lookup_frame(spark, v.CRITERIA, rk.CRITERIA_SCHEMA))
    return fits.withColumn("score", F.round("score", 6))


@query("fit_scores", sql(_FIT + " SELECT * FROM fit", "corpus"))
def fit_scores(spark, sf):
    return _fits(spark, sf)


@query("assign_archetype", sql(_RANKS + _FIT.replace(f", i AS ({_INDEX})", "") + """,
b AS (SELECT *, row_number() OVER (PARTITION BY speaker ORDER BY score DESC, archetype) AS k FROM fit QUALIFY k <= 3),
e AS (SELECT speaker, party, CASE WHEN words_rank <= 10 THEN 'elefant' WHEN speech_rank <= 10 AND words_rank <= 20 THEN 'adler' WHEN party_speech_rank <= 3 AND party_size >= 20 THEN 'loewe' END AS elite FROM ranks),
a AS (SELECT e.speaker, e.party, coalesce(elite, b.archetype, 'biene') AS archetype FROM e LEFT JOIN b ON e.speaker = b.speaker AND b.k = 1)
SELECT a.speaker, a.party, CASE WHEN a.party <> 'es' THEN a.archetype END AS archetype, CASE WHEN a.party <> 'es' THEN coalesce((SELECT string_agg(x.archetype, ',' ORDER BY k) FROM (SELECT *, row_number() OVER (PARTITION BY speaker ORDER BY k) AS kk FROM (SELECT b.* FROM b JOIN a a2 ON b.speaker = a2.speaker AND b.archetype <> a2.archetype)) x WHERE x.speaker = a.speaker AND kk <= 2), '') END AS alternatives FROM a""", "corpus"))
def assign_archetype(spark, sf):
    index = _index(spark, sf)
    ranks = rk.speaker_ranks(index)
    features = index.select("speaker", "party", *_FEATURES, F.lit(0.0).alias("aggression")).join(
        ranks.select("speaker", "words_rank", "speech_rank", "party_speech_rank", "party_size"), "speaker"
    )
    out = rk.assign_archetype(features, _fits(spark, sf), exclude_groups=["es"])
    return out.select("speaker", "party", "archetype", F.array_join(F.transform("alternatives", lambda t: t["archetype"]), ",").alias("alternatives"))
