"""How sources of a language differ: exact term counts through whitespace chunks, and audits of smoothed shares."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rostrum.llm.common import by_group, frugal, kept, parts_for
from rostrum.operators.common import join_groups, top_k

#: Text bytes of a block of documents, whose counts are held and joined together.
BLOCK = 16 << 20
#: Text bytes behind one part of the distinct chunks.
PART = 32 << 20
#: What separates terms: ASCII characters that are no letters.
GAPS = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
#: Shares are whole billionths.
SCALE = 1_000_000_000

#: Rows between the steps. Kind 0 is a block's layout: its groups, and per document the chunks and counts in ``data``.
#: Kind 1 is the block's distinct chunks of one part, one a line of ``text``; later their terms, in the same order.
ROWS = "key long, kind int, block long, part int, langs array<string>, sources array<string>, data array<binary>, text binary"


def squeezed(x: bytes | np.ndarray) -> bytes:
    """Bytes behind their length, compressed."""
    raw = x if isinstance(x, bytes) else x.tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unsqueezed(x: bytes) -> bytes:
    """What :func:`squeezed` was given."""
    return pa.decompress(x[8:], decompressed_size=int.from_bytes(x[:8], "little"), codec="zstd", asbytes=True)


def terms_of(chunks: pa.Array) -> list[str]:
    """The terms of each whitespace chunk, separated by blanks, with A-Z in lower case."""
    return pc.utf8_trim(pc.replace_substring_regex(pc.ascii_lower(chunks), GAPS, " "), " ").to_pylist()


def runs_of(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order that sorts ``keys`` and the places in it where a new key begins."""
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    return order, np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1]))) if len(keys) else np.zeros(0, np.int64)


def cut_block(langs: list[str], sources: list[str], texts: pa.Array, block: int, parts: int) -> Iterator[tuple]:
    """Rows of a block: per document its distinct whitespace chunks with counts, and the distinct chunks by part."""
    groups = {g: i for i, g in enumerate(dict.fromkeys(zip(langs, sources, strict=True)))}
    group = np.array([groups[g] for g in zip(langs, sources, strict=True)], np.int32)
    lists = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(texts))
    coded = lists.flatten().dictionary_encode()
    chunks = coded.dictionary.to_pylist()
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    sizes = np.diff(np.asarray(lists.offsets))
    part = np.array([zlib.crc32(c.encode()) % parts for c in chunks], np.int64)
    order = np.argsort(part, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    width = max(1, len(chunks))
    pairs, counts = np.unique(np.repeat(np.arange(len(texts)), sizes) * width + place[codes], return_counts=True)
    doc, code = pairs // width, pairs % width
    steps = np.diff(code, prepend=0)
    first = np.flatnonzero(np.diff(doc, prepend=-1))
    steps[first] = code[first]  # within a document the codes rise
    data = [squeezed(x) for x in (group, np.bincount(doc, minlength=len(texts)).astype(np.int32), steps.astype(np.int32), counts.astype(np.int32))]
    yield (-1 - block % parts, 0, block, None, [g[0] for g in groups], [g[1] for g in groups], data, None)
    for p in np.unique(part).tolist():
        lines = "\n".join(chunks[i] for i in order[np.searchsorted(part[order], p) : np.searchsorted(part[order], p, "right")])
        yield (p, 1, block, p, None, None, None, squeezed(lines.encode()))


def block_counts(langs: list[str], sources: list[str], data: list[bytes], lines: list[str]) -> pa.RecordBatch:
    """``lang, source, term, n, docs`` of a block from its layout and the terms of its chunks; a group's null term has its documents."""
    group, sizes, steps, counts = (np.frombuffer(unsqueezed(x), np.int32).astype(np.int64) for x in data)
    words = pc.split_pattern(pa.array(lines, pa.large_string()), " ")
    coded = words.flatten().dictionary_encode()
    empty = coded.dictionary.index("").as_py() if len(coded.dictionary) else -1
    per, offsets = np.diff(np.asarray(words.offsets)), np.asarray(words.offsets).astype(np.int64)
    terms = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    running = np.cumsum(steps)
    begin = (ends - sizes)[sizes > 0]
    code = running - np.repeat(running[begin] - steps[begin], sizes[sizes > 0])
    # one row per (document, chunk, term), then per (document, term)
    times = per[code]
    at = np.repeat(offsets[code] - np.cumsum(times) + times, times) + np.arange(times.sum())
    term = terms[at]
    owner = np.repeat(np.repeat(np.arange(len(sizes)), sizes), times)
    n = np.repeat(counts, times)
    real = term != empty
    term, owner, n = term[real], owner[real], n[real]
    width = max(1, len(coded.dictionary))
    order, starts = runs_of(owner * width + term)
    sums = np.add.reduceat(n[order], starts) if len(starts) else np.zeros(0, np.int64)
    key = group[owner[order[starts]]] * width + term[order[starts]]
    order, starts = runs_of(key)
    docs = np.diff(np.append(starts, len(order)))
    sums = np.add.reduceat(sums[order], starts) if len(starts) else np.zeros(0, np.int64)
    key = key[order[starts]]
    which = np.concatenate((key // width, np.arange(len(langs))))
    term = pa.concat_arrays([coded.dictionary.take(pa.array(key % width)).cast(pa.string()), pa.nulls(len(langs), pa.string())])
    docs = np.concatenate((docs, np.bincount(group, minlength=len(langs))))
    return pa.record_batch(
        [pa.array(langs, pa.string()).take(pa.array(which)), pa.array(sources, pa.string()).take(pa.array(which)), term, pa.array(np.concatenate((sums, np.zeros(len(langs), np.int64)))), pa.array(docs)],
        ["lang", "source", "term", "n", "docs"],
    )


def term_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """``lang, source, term, n, docs``: occurrences of each term in a group and documents of the group that have it.

    Each group also has a row with a null term and its number of documents. A term is a maximal run of ASCII letters and
    characters beyond ASCII, with A-Z in lower case. Every row is a document, also where ids repeat; null text, language
    and source count as ``''``.

    Blocks of documents count the whitespace chunks of each document. The blocks' distinct chunks are shuffled by hash,
    each is cut into terms once, and the terms return to the blocks that asked, where documents are told apart; only sums
    leave a block. A widespread chunk costs one line per block. ``docs`` should come from files, so that a repeated
    task sees the same rows in the same order.
    """
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])
    parts = parts_for(rows.agg(F.sum(F.octet_length("text"))).first()[0], PART)
    schema = pa.schema([("key", pa.int64()), ("kind", pa.int32()), ("block", pa.int64()), ("part", pa.int32()), ("langs", pa.list_(pa.string())), ("sources", pa.list_(pa.string())), ("data", pa.list_(pa.binary())), ("text", pa.binary())])
    batch_of = lambda made: pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*made, strict=True), schema, strict=True)], schema=schema)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            ends = np.cumsum(pc.binary_length(batch.column(2)).to_numpy(zero_copy_only=False).astype(np.int64))
            first = 0
            while first < batch.num_rows:
                last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + BLOCK, "right")))
                langs, sources, texts = batch.slice(first, last - first).columns
                yield batch_of(list(cut_block(langs.to_pylist(), sources.to_pylist(), texts, number, parts)))
                first, number = last, number + 1

    def tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, known = None, {}
        for batch in batches:
            for row in batch.to_pylist():
                if row["kind"] == 1:
                    if row["part"] != part:
                        part, known = row["part"], {}
                    chunks = unsqueezed(row["text"]).decode().split("\n")
                    new = [c for c in chunks if c not in known]
                    known.update(zip(new, terms_of(pa.array(new, pa.string())), strict=True))
                    row["text"] = squeezed("\n".join([known[c] for c in chunks]).encode())
                yield batch_of([tuple(row.values())])

    def count(table: pa.Table) -> Iterator[pa.RecordBatch]:
        rows = sorted(table.to_pylist(), key=lambda r: (r["kind"], r["part"] or 0))
        lines = [line for r in rows[1:] for line in unsqueezed(r["text"]).decode().split("\n")]
        yield block_counts(rows[0]["langs"], rows[0]["sources"], rows[0]["data"], lines)

    asked = rows.mapInArrow(frugal(cut), ROWS).repartition(parts, "key").sortWithinPartitions("key")
    told = asked.mapInArrow(frugal(tokenize), ROWS).repartition(parts, "block").sortWithinPartitions("block")
    sums = told.mapInArrow(frugal(by_group("block", count)), "lang string, source string, term string, n long, docs long")
    return sums.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: Column, total: Column, terms: Column) -> Column:
    """Billionths of a smoothed share, in whole numbers."""
    wide = lambda c: c.cast("decimal(19,0)")
    part = F.lit(SCALE).cast("decimal(10,0)") * wide(count + 5)
    return (F.lit(1) + F.call_function("div", part, wide(total + 5 * terms))).cast("long")


def pair_sums(dense: DataFrame) -> DataFrame:
    """``lang, i, j, value`` with i < j: sums of |p_i - p_j| over rows ``(lang, shares)``; a row holds one share per source."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column(0).dictionary_encode()
            codes = langs.indices.to_numpy(zero_copy_only=False)
            for k, lang in enumerate(langs.dictionary.to_pylist()):
                lists = batch.column(1).filter(pa.array(codes == k))
                m = lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)
                for i in range(m.shape[1] - 1):
                    value = np.abs(m[:, i + 1 :] - m[:, i : i + 1]).sum(axis=0)
                    size = len(value)
                    yield pa.record_batch([pa.array([lang] * size), pa.array([i] * size, pa.int32()), pa.array(np.arange(i + 1, i + 1 + size), pa.int32()), pa.array(value)], ["lang", "i", "j", "value"])

    return dense.select("lang", "shares").mapInArrow(add, "lang string, i int, j int, value long").groupBy("lang", "i", "j").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, least_docs: int = 30, most_terms: int = 50, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """``lang, source, part, item, value, rank``: how far sources of a language lie apart, and which terms they overuse.

    A language keeps the V terms that at least ``least_docs`` of its documents have. In a group of N occurrences of kept
    terms, a term with ``n`` of them has the share ``1 + floor(1e9 (n + 5) / (N + 5 V))``. Part ``pair``: for each other
    source of the language the sum over kept terms of the shares' distances (0 without kept terms). Part ``term``: the
    ``most_terms`` kept terms of the group whose share exceeds the language's by most. Ranks go by value descending,
    then by item. All numbers are whole; rows with null text, language or source count as ``''``; an empty table gives
    no rows. The result has a row per ordered pair of a language's sources, so sources should be few as against documents.
    """
    counts = kept(term_counts(docs, text_col, lang_col, source_col), "term-counts")
    terms = kept(counts.filter("term IS NOT NULL").groupBy("lang", "term").agg(F.sum("n").alias("n_lang"), F.sum("docs").alias("docs")).filter(F.col("docs") >= least_docs).drop("docs"), "kept-terms")
    langs = terms.groupBy("lang").agg(F.sum("n_lang").alias("total_lang"), F.count(F.lit(1)).alias("v"))
    found = kept(counts.filter("term IS NOT NULL").select("lang", "source", "term", "n").join(terms, ["lang", "term"]), "kept-counts")
    totals = found.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = counts.filter("term IS NULL").select("lang", "source").join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = kept(groups.select("lang", "source", *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("total", "total_lang", "v")]), "groups")
    shares = join_groups(found, groups, ["lang", "source"])
    shares = shares.select("lang", "source", "term", share(F.col("n"), F.col("total"), F.col("v")).alias("p"), share(F.col("n_lang"), F.col("total_lang"), F.col("v")).alias("q"))

    over = shares.filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    over = top_k(over, ["lang", "source"], [F.desc("value"), F.asc("item")], most_terms)

    by_lang = groups.filter("v > 0").groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("source", share(F.lit(0), F.col("total"), F.col("v")).alias("p")))).alias("all"))
    rows = shares.groupBy("lang", "term").agg(F.collect_list(F.struct("source", "p")).alias("has"))
    dense = join_groups(rows, by_lang, ["lang"]).withColumn("has", F.map_from_entries("has"))
    dense = dense.select("lang", F.transform("all", lambda s: F.coalesce(F.element_at("has", s["source"]), s["p"])).alias("shares"))
    number = Window.partitionBy("lang").orderBy("source")
    named = groups.select("lang", "source", (F.row_number().over(number) - 1).alias("i"))
    sums = pair_sums(dense)
    both = sums.select("lang", "i", "j", "value").unionByName(sums.select("lang", F.col("j").alias("i"), F.col("i").alias("j"), "value"))
    other = named.select("lang", F.col("source").alias("item"), F.col("i").alias("j"))
    pairs = named.join(other, "lang").filter("i <> j").join(both, ["lang", "i", "j"], "left")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).cast("long").alias("value"))
    pairs = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))))
    return pairs.unionByName(over).select("lang", "source", "part", "item", F.col("value").cast("long").alias("value"), F.col("rank").cast("int").alias("rank"))
