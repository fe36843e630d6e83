"""The registered queries of this folder and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rostrum.llm import chat, chunkids, divergence, edits, exact, langid, mixing, nearminhash, packing, repeats, variants, vectors, warc
from rostrum.llm.common import scratch, word_count

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable:
    """Register a query and, if given, its SQL."""

    def add(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_suffix_dedup")
def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without the 50-byte strings that an earlier document has."""
    return repeats.without_repeats(table(spark, sf_dir, "documents"))


@query(
    "op2_warc",
    """
    WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
    d AS (SELECT page_id, strlen(h) AS n, sha1(h) AS s, min(page_id) OVER (PARTITION BY h) AS f FROM p),
    bits AS (
        SELECT page_id, n, f, s,
            list_transform(range(0, 32), lambda i: (
                (instr('0123456789abcdef', s[(5 * i) // 4 + 1]) - 1) * 16
                + coalesce(instr('0123456789abcdef', nullif(s[(5 * i) // 4 + 2], '')) - 1, 0)
            ) // CAST(pow(2, 3 - (5 * i) % 4) AS INT) % 32) AS v
        FROM d)
    SELECT page_id, n AS payload_bytes,
        list_aggregate(list_transform(v, lambda x: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[x + 1]), 'string_agg', '') AS payload_digest,
        CASE WHEN page_id = f THEN 'response' ELSE 'revisit' END AS record_type,
        CASE WHEN page_id = f THEN NULL ELSE f END AS refers_to
    FROM bits""",
)
def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as WARC records and read back from the archives."""
    path = scratch(spark, "warc")
    warc.write_warc(table(spark, sf_dir, "pages"), path, least=0)
    records = warc.read_warc(spark, path).filter("kind = 'record'")
    number = lambda c: F.regexp_extract(c, r"(-?\d+)$", 1).try_cast("long")
    return records.select(
        number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        F.when(F.col("refers_to").isNotNull(), number("refers_to")).alias("refers_to"),
    )


@query(
    "op3_vector_dedup",
    """
    WITH RECURSIVE n AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
    ok AS (SELECT vec_id, label, v FROM n WHERE label IS NOT NULL AND v IS NOT NULL AND len(v) > 0
        AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_dot_product(v, v) > 0),
    l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
        WHERE list_cosine_similarity(a.v, b.v) >= 0.93),
    r AS (SELECT vec_id AS a, vec_id AS c FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.c = l.a)
    SELECT e.vec_id, (SELECT count(*) FROM l WHERE l.a = e.vec_id) AS n_links, min(r.c) AS component_id, min(r.c) = e.vec_id AS kept
    FROM embeddings e JOIN r ON r.a = e.vec_id GROUP BY e.vec_id""",
)
def op3_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors linked within their label at a cosine of 0.93, as components."""
    return vectors.near_vectors(table(spark, sf_dir, "embeddings"), least=0.93)


@query("op4_token_counts")
def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document before and after three edits: a replacement, a deletion, an addition.

    With n code points: 5 from n / 4 on become the first 12; then 7 from 3 n / 4 on go; then ``" The end."`` follows.
    """
    import public_tokenizers

    n = F.length("text").cast("long")
    step = lambda start, stop, text: F.struct(start.cast("long").alias("start"), stop.cast("long").alias("stop"), text.alias("text"))
    at, late = F.floor(n / 4), F.floor(3 * n / 4)
    end = F.lit(1 << 40)
    plan = F.array(step(at, at + 5, F.substring("text", 1, 12)), step(late, late + 7, F.lit("")), step(end, end, F.lit(" The end.")))
    ranks, pattern = str(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN
    trees = edits.build_trees(table(spark, sf_dir, "documents"), ranks, pattern, edits=plan)
    done = edits.apply_edits(trees, ranks, pattern)
    return done.select(
        F.col("id").alias("doc_id"), "n_edits", "tokens_before", F.col("tokens").alias("tokens_after"), F.length("text").cast("long").alias("chars_after"), "pieces_renewed"
    )


#: The tools that the chat query derives, and their schemas.
TOOLS = (
    chat.Argument("count", "limit", "integer", least=1, most=150),
    chat.Argument("count", "query", "string"),
    chat.Argument("lookup", "exact", "boolean", required=False),
    chat.Argument("lookup", "key", "string"),
)


@query(
    "op5_tool_calls",
    r"""
    WITH m AS (SELECT conv_id, turn, role, regexp_extract(coalesce(text, ''), '[A-Za-z]+') AS word,
        len(regexp_extract_all(coalesce(text, ''), '[^ 	-
]+')) AS n FROM conversations),
    c AS (SELECT conv_id, turn, 't' || turn AS call_id, CASE WHEN turn % 4 = 1 THEN 'count' ELSE 'lookup' END AS tool, word, n FROM m WHERE role = 'assistant'),
    r AS (SELECT conv_id, 't' || (turn - 1) AS call_id, turn, word FROM m WHERE role = 'user' AND turn > 0 AND n % 5 <> 0),
    a AS (SELECT *, CASE WHEN tool = 'count' THEN
            CASE WHEN n % 11 = 0 THEN '{"limit":"' || n || '","query":"' || word || '"}' ELSE '{"limit":' || n || ',"query":"' || word || '"}' END
        WHEN n % 7 = 0 THEN '{"exact":true}' WHEN n % 7 = 1 THEN '{"fuzzy":1,"key":"' || word || '"}' ELSE '{"exact":false,"key":"' || word || '"}' END AS arguments,
        CASE WHEN tool = 'count' AND n % 11 = 0 THEN ['limit: not integer'] WHEN tool = 'count' AND n < 1 THEN ['limit: too small'] WHEN tool = 'count' AND n > 150 THEN ['limit: too large']
        WHEN tool = 'lookup' AND n % 7 = 0 THEN ['key: missing'] WHEN tool = 'lookup' AND n % 7 = 1 THEN ['fuzzy: unknown'] ELSE CAST([] AS VARCHAR[]) END AS errors FROM c),
    d AS (SELECT a.*, (SELECT count(*) FROM c x WHERE x.conv_id = a.conv_id AND x.turn < a.turn AND x.turn % 2 = a.turn % 2 AND x.turn // 8 = a.turn // 8
            AND (SELECT count(*) FROM c y WHERE y.conv_id = a.conv_id AND y.turn % 2 = a.turn % 2 AND y.turn > x.turn AND y.turn < a.turn) = (a.turn - x.turn) / 2 - 1) AS level FROM a),
    b AS (SELECT coalesce(d.conv_id, r.conv_id) AS conv_id, coalesce(d.call_id, r.call_id) AS call_id, d.tool, d.level, d.errors, d.arguments, r.word AS result,
        CASE WHEN d.call_id IS NULL THEN 'orphan' WHEN len(d.errors) > 0 THEN 'invalid' WHEN r.call_id IS NULL THEN 'unanswered' ELSE 'ok' END AS status,
        coalesce(d.turn, r.turn) AS pos, CASE WHEN d.call_id IS NOT NULL THEN CAST(1 AS BIGINT) END AS n_calls, CASE WHEN r.call_id IS NOT NULL THEN CAST(1 AS BIGINT) END AS n_results
        FROM d FULL JOIN r ON d.conv_id = r.conv_id AND d.call_id = r.call_id),
    q AS (SELECT *, CASE WHEN result IS NULL THEN 'null' ELSE '"' || result || '"' END AS rq, CASE WHEN tool IS NULL THEN 'null' ELSE '"' || tool || '"' END AS tq FROM b)
    SELECT conv_id, call_id, tool, level, row_number() OVER (PARTITION BY conv_id ORDER BY level NULLS LAST, pos, call_id) AS ord, status,
        coalesce(array_to_string(errors, ', '), '') AS errors, n_calls, n_results,
        '{"arguments":' || coalesce(arguments, 'null') || ',"call_id":"' || call_id || '","result":' || rq || ',"status":"' || status || '","tool":' || tq || '}' AS json
    FROM q""",
)
def op5_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tool calls derived from the assistant turns of all conversations, results from the user turns that follow.

    A call waits for the one two turns before it within its eight turns. Its arguments come from the first word and
    the number of words; some break the schema.
    """
    turns = table(spark, sf_dir, "conversations")
    text = F.coalesce(F.col("text"), F.lit(""))
    word, n = F.regexp_extract(text, "[A-Za-z]+", 0), word_count(F.col("text"))
    turns = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", word.alias("word"), n.alias("n"))
    name = lambda turn: F.concat(F.lit("t"), turn.cast("string"))
    calls = turns.filter("role = 'assistant'").withColumn("tool", F.when(F.col("turn") % 4 == 1, "count").otherwise("lookup"))
    number = F.when(F.col("n") % 11 == 0, F.format_string('"%d"', "n")).otherwise(F.col("n").cast("string"))
    arguments = (
        F.when(F.col("tool") == "count", F.format_string('{ "query": "%s",  "limit": %s }', "word", number))
        .when(F.col("n") % 7 == 0, F.lit('{"exact" : true}'))
        .when(F.col("n") % 7 == 1, F.format_string('{"key":"%s", "fuzzy": 1}', "word"))
        .otherwise(F.format_string('{"key": "%s", "exact": false}', "word"))
    )
    waits = F.when(F.col("turn") % 8 >= 2, F.array(name(F.col("turn") - 2)))
    calls = calls.select("conv_id", name(F.col("turn")).alias("call_id"), F.col("turn").alias("position"), "tool", arguments.alias("arguments"), waits.alias("depends_on"))
    results = turns.filter("role = 'user' AND turn > 0 AND n % 5 <> 0")
    results = results.select("conv_id", name(F.col("turn") - 1).alias("call_id"), F.col("turn").alias("position"), F.col("word").alias("content"))
    linked = chat.link_calls(calls, results, TOOLS)
    return linked.withColumn("errors", F.array_join("errors", ", "))


@query("op6_minhash")
def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups over all documents: five-word shingles, similarity 0.85."""
    return nearminhash.near_groups(table(spark, sf_dir, "documents"), percent=85).drop("text_hash")


@query(
    "op7_exact_dedup",
    r"""
    WITH n AS (SELECT doc_id, coalesce(length(text), 0) AS len, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
    w AS (SELECT doc_id, norm, count(*) OVER (PARTITION BY norm) AS group_size,
        first_value(doc_id) OVER (PARTITION BY norm ORDER BY len DESC, doc_id) AS keep_id FROM n)
    SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM w""",
)
def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts over all documents and the row of each that stays."""
    return exact.exact_groups(table(spark, sf_dir, "documents"))


def word_tokenizer() -> str:
    """The vocabulary file that the packing query names."""
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


@query("op8_packing")
def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into windows of 2048 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"), word_tokenizer())


@query(
    "op9_mixing",
    r"""
    WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, md5('mix:' || doc_id) AS draw FROM documents),
    s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
    n AS (SELECT *, [5.0, 2.0, 1.0][1 + CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INT)]::DOUBLE AS w FROM s),
    c AS (SELECT *, 2.0::DOUBLE * source_size AS cap FROM n),
    o AS (SELECT *, row_number() OVER (ORDER BY cap / w, source NULLS LAST) AS k FROM c),
    f AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS full_before,
        sum(w) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_from, 1.5::DOUBLE * sum(source_size) OVER () AS total FROM o),
    l AS (SELECT (total - full_before) / open_from AS level FROM f WHERE (total - full_before) / open_from <= cap / w ORDER BY k LIMIT 1),
    t AS (SELECT source, source_size, least(cap, w * level) AS target FROM f, l),
    e AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM t),
    x AS (SELECT doc_id, size, source_size, target, whole, target - whole * source_size AS rest,
        coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY draw, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
        sum(size) OVER (PARTITION BY d.source, draw[1:3]) AS words, min(draw[1:3]) OVER () AS unused, draw
        FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
    SELECT doc_id, size, source_size, target,
        CAST(size * (whole + CASE WHEN rest > 0 AND before + size / 2 <= rest THEN 1 ELSE 0 END) AS BIGINT) AS taken, 
        CAST(whole + CASE WHEN rest > 0 AND before + size / 2 <= rest THEN 1 ELSE 0 END AS BIGINT) AS repeats
    FROM x""",
)
def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed by source weights 5, 2, 1 to 150 % of their words, at most two epochs of a source."""
    return mixing.mix(table(spark, sf_dir, "documents"), weights=(5, 2, 1), share=1.5, max_epochs=2.0)


@query("op10_language_id")
def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, by a model fitted on labelled rows outside the held-out quarter."""
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs)
    return langid.identify(docs.select("doc_id", "text"), model).select("doc_id", "held_out", "lang_pred", "score")


@query("op11_bpe_chunks")
def op11_bpe_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the token ids of every document and of the text that they decode to."""
    path = word_tokenizer()
    rows = chunkids.encode(table(spark, sf_dir, "documents"), path, decoded=True)
    decimal = F.array_join(F.col("ids").cast("array<string>"), " ")
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(decimal, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def dropped_letter(name: Column, word: Column) -> Column:
    """``word``, without one code point where 199 divides the checksum of ``name:word``."""
    h = F.crc32(F.concat(name, F.lit(":"), word))
    at = (h % F.length(word)).cast("int")
    return F.when(h % 199 == 0, F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.length(word)))).otherwise(word)


@query(
    "op12_spelling_variants",
    r"""
    WITH RECURSIVE runs AS (
        SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents),
    w AS (SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w, count(*) AS c FROM runs WHERE length(run) >= 6 GROUP BY ALL),
    x AS (SELECT w, c, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || w)) AS hx FROM w),
    h AS (SELECT w, c, xor(list_reduce(
            list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(0, length(hx)), lambda k: CAST(instr('0123456789ABCDEF', hx[CASE WHEN k % 2 = 0 THEN k + 2 ELSE k END]) - 1 AS BIGINT))),
            lambda a, b: xor(a >> 4, ([0, 498536548, 997073096, 651767980, 1994146192, 1802195444, 1303535960, 1342533948,
                3988292384, 4027552580, 3604390888, 3412177804, 2607071920, 2262029012, 2685067896, 3183342108]::BIGINT[])[(xor(a, b) & 15) + 1])),
            CAST(4294967295 AS BIGINT)) AS h FROM x),
    r AS (SELECT CASE WHEN h % 199 = 0 THEN w[1:h % length(w)] || w[h % length(w) + 2:] ELSE w END AS word, c FROM h),
    v AS (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM r WHERE length(word) >= 6 GROUP BY word HAVING sum(c) >= 5),
    d AS (SELECT word, n, length(word) AS len, i, word[1:i - 1] || word[i + 1:] AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)),
    p AS (SELECT DISTINCT a.word AS a, b.word AS b, b.n AS n FROM d a JOIN d b ON a.len = b.len AND a.i = b.i AND a.rest = b.rest AND a.word <> b.word
        UNION SELECT d.word, v.word, v.n FROM d JOIN v ON d.rest = v.word
        UNION SELECT v.word, d.word, d.n FROM d JOIN v ON d.rest = v.word),
    b AS (SELECT a AS word, count(*) AS n_near, max(n) AS most, first(b ORDER BY n DESC, b) AS near FROM p GROUP BY a),
    f AS (SELECT v.word, v.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN most >= 5 * v.n THEN near END AS form, CASE WHEN most >= 5 * v.n THEN most END AS form_n
        FROM v LEFT JOIN b ON v.word = b.word),
    chain AS (SELECT word, word AS at FROM f UNION SELECT chain.word, f.form FROM chain JOIN f ON chain.at = f.word WHERE f.form IS NOT NULL)
    SELECT f.word, f.form, chain.at AS root, f.n, f.n_near, f.form_n
    FROM f JOIN chain ON f.word = chain.word JOIN f e ON chain.at = e.word AND e.form IS NULL""",
)
def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents, some with a letter dropped, and the forms that they may stand for."""
    words = variants.word_counts(table(spark, sf_dir, "documents"), least_length=6, least_count=5, respell=dropped_letter)
    return variants.variant_groups(words, ratio=5, least_length=6)


@query(
    "op13_source_divergence",
    r"""
    WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
    t AS (SELECT id, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
    k AS (SELECT lang, term, CAST(count(*) AS HUGEINT) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT id) >= 30),
    c AS (SELECT t.lang, t.source, t.term, CAST(count(*) AS HUGEINT) AS n FROM t JOIN k ON t.lang = k.lang AND t.term = k.term GROUP BY ALL),
    l AS (SELECT lang, CAST(sum(n) AS HUGEINT) AS total, CAST(count(*) AS HUGEINT) AS v FROM k GROUP BY lang),
    g AS (SELECT d.lang, d.source, coalesce(max(s.total), 0) AS total FROM d LEFT JOIN (SELECT lang, source, CAST(sum(n) AS HUGEINT) AS total FROM c GROUP BY ALL) s
        ON d.lang = s.lang AND d.source = s.source GROUP BY d.lang, d.source),
    p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000 * (coalesce(c.n, 0) + 5)) // (g.total + 5 * l.v) AS p, 1 + (1000000000 * (k.n + 5)) // (l.total + 5 * l.v) AS q
        FROM g JOIN k ON g.lang = k.lang JOIN l ON g.lang = l.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
    s AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
    u AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value
        FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
        UNION ALL SELECT lang, source, 'term', term, CAST(p - q AS BIGINT) FROM p WHERE n > 0 AND p > q),
    o AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM u)
    SELECT lang, source, part, item, value, rank FROM o WHERE part = 'pair' OR rank <= 50""",
)
def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the sources of each language differ in the terms that at least 30 documents of the language have."""
    return divergence.audit(table(spark, sf_dir, "documents"), least_docs=30, most_terms=50)
