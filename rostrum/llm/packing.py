"""Packing documents into token windows with lexically near neighbours from sharded BM25 indexes."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rostrum.llm.common import arrow_rows, frugal, mixed, parts_for, scratch
from rostrum.llm.wordids import word_ids

#: Tokens of a window.
WINDOW = 2048
#: The id that ends each document.
END = 1
#: Tokens of one shard: what one index covers and one task holds at a time.
SHARD = 1 << 20
#: Bytes of token ids of one partition of the packing step.
PART = 8 << 20
#: Documents encoded at once.
BATCH = 2000
#: Neighbours sorted at first; the others follow if these do not fill the window.
BEST = 32
#: BM25's saturation and length parameters.
K1, B = 1.2, 0.75

TOKENS = "kind int, doc_id string, doc_tokens long, crcs array<long>, rest binary, key long, term int, docs long, total long"
PIECES = "doc_id string, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def crc_of(ids: np.ndarray) -> int:
    """crc32 of the ids as little-endian unsigned 32-bit numbers."""
    return zlib.crc32(ids.astype("<u4").tobytes())


def term_draws(vocabulary: int) -> np.ndarray:
    """A number for each token that rarer tokens tend to have smaller.

    It depends on the id alone; ids grow with rarity, and a token is favoured in proportion to the square of its id.
    """
    terms = np.arange(vocabulary, dtype=np.uint64)
    return -np.log((mixed(terms) >> np.uint64(11)).astype(np.float64) / 2**53 + 1e-18) / (1.0 + terms.astype(np.float64)) ** 2


def locality_key(terms: np.ndarray, draws: np.ndarray) -> int:
    """The two tokens of least draw; rows sorted by it have neighbours with alike rarer tokens nearby."""
    own = draws[terms]
    first = int(own.argmin())
    own[first] = np.inf
    return int(terms[first]) << 20 | int(terms[own.argmin()])


class Shard:
    """Open pieces of some documents under an inverted index of BM25 weights."""

    def __init__(self, pieces: list[np.ndarray], idf: np.ndarray, mean: float) -> None:
        self.sizes = np.array([len(p) for p in pieces])
        docs, terms, weights = [], [], []
        for i, ids in enumerate(pieces):
            term, count = np.unique(ids, return_counts=True)
            norm = K1 * (1 - B + B * len(ids) / mean)
            docs.append(np.full(len(term), i))
            terms.append(term)
            weights.append((idf[term] * count * (K1 + 1) / (count + norm)).astype(np.float32))
        self.terms_of = terms
        doc, term, weight = np.concatenate(docs), np.concatenate(terms).astype(np.int64), np.concatenate(weights)
        order = np.argsort(term, kind="stable")
        self.doc, self.weight, self.term = doc[order], weight[order].astype(np.float64), term[order]
        self.span = len(idf) + 1
        self.unused = np.ones(len(pieces), bool)
        self.indexed = len(pieces)
        self._place()

    def _place(self) -> None:
        """Where each token's postings begin."""
        self.first = np.searchsorted(self.term, np.arange(self.span))

    def neighbours(self, seed: int) -> Iterator[int]:
        """Unused pieces that share a token with the seed, the best match first; ties by position.

        Postings of used pieces leave the index whenever an eighth of its pieces has been used.
        """
        left = int(self.unused.sum())
        if left < self.indexed * 7 // 8:
            alive = self.unused[self.doc]
            self.doc, self.weight, self.term = self.doc[alive], self.weight[alive], self.term[alive]
            self.indexed = left
            self._place()
        terms = self.terms_of[seed].astype(np.int64)
        spans = [slice(a, b) for a, b in zip(self.first[terms].tolist(), self.first[terms + 1].tolist(), strict=True) if a < b]
        if not spans:
            return
        score = np.bincount(np.concatenate([self.doc[s] for s in spans]), np.concatenate([self.weight[s] for s in spans]), minlength=len(self.sizes))
        score[~self.unused] = 0
        found = np.flatnonzero(score)
        score = score[found]
        if len(found) > 2 * BEST:
            least = np.partition(score, len(score) - BEST)[len(score) - BEST]
            best = score >= least
            yield from found[best][np.argsort(-score[best], kind="stable")].tolist()
            found, score = found[~best], score[~best]
        yield from found[np.argsort(-score, kind="stable")].tolist()


def pack_shard(sizes: np.ndarray, shard: Shard, window: int) -> Iterator[list[tuple[int, int, int, int]]]:
    """Sequences as lists of (piece, start in the piece, length, offset).

    The first unused piece is the seed; its neighbours follow, best first, until the window is full, then pieces in
    order. What does not fit of the last one seeds the next window. Only the last sequence stays open.
    """
    nexts = 0
    carry: tuple[int, int] | None = None
    while True:
        if carry is None:
            while nexts < len(sizes) and not shard.unused[nexts]:
                nexts += 1
            if nexts == len(sizes):
                return
            shard.unused[nexts] = False
            carry = (nexts, 0)
        seed, start = carry
        carry = None
        length = int(min(window, sizes[seed] - start))
        sequence, used = [(seed, start, length, 0)], length
        if start + length < sizes[seed]:
            carry = (seed, start + length)
        elif used < window:
            for piece in shard.neighbours(seed):
                length = int(min(window - used, sizes[piece]))
                shard.unused[piece] = False
                sequence.append((int(piece), 0, length, used))
                used += length
                if used == window:
                    carry = (int(piece), length) if length < sizes[piece] else None
                    break
            while used < window:
                while nexts < len(sizes) and not shard.unused[nexts]:
                    nexts += 1
                if nexts == len(sizes):
                    break
                length = int(min(window - used, sizes[nexts]))
                shard.unused[nexts] = False
                sequence.append((nexts, 0, length, used))
                used += length
                if used == window and length < sizes[nexts]:
                    carry = (nexts, length)
        yield sequence


def cut_open(sequence: list[tuple[int, int, int, int]]) -> Iterator[list[tuple[int, int, int, int]]]:
    """An open sequence as sequences whose sizes are powers of two, the largest first, so that none needs padding."""
    left = sum(p[2] for p in sequence)
    pieces = [(p, s, n) for p, s, n, _ in sequence][::-1]
    while left:
        size = 1 << (left.bit_length() - 1)
        left -= size
        out, used = [], 0
        while used < size:
            piece, start, n = pieces.pop()
            take = min(n, size - used)
            out.append((piece, start, take, used))
            used += take
            if take < n:
                pieces.append((piece, start + take, n - take))
        yield out


def tokenized(docs: DataFrame, tokenizer: str, id_col: str, text_col: str, window: int) -> DataFrame:
    """Rows of kind 0: a document's size, the checksums of its full windows, and its open rest with a locality key.

    Rows of kind 1: how many documents of a task hold a token, over whole documents; of kind 2: a task's documents
    and their tokens.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_ids(tokenizer)
        holds = np.zeros(max(encoder.vocabulary, END + 1), np.int64)
        draws = term_draws(len(holds))
        end = np.array([END], encoder.kind)
        number = total = 0
        names = [x.split()[0] for x in TOKENS.split(",")]
        blank = lambda n, kind: pa.nulls(n, kind)
        for batch in batches:
            sizes, crcs, rests, keys = [], [], [], []
            for ids in encoder.encode(batch.column(1)):
                ids = np.concatenate((ids, end))
                full = len(ids) // window * window
                sizes.append(len(ids))
                terms = np.unique(ids)
                holds[terms] += 1
                crcs.append([crc_of(ids[i : i + window]) for i in range(0, full, window)])
                rest = ids[full:]
                rests.append(rest.tobytes() if len(rest) else None)
                keys.append(locality_key(np.unique(rest) if full else terms, draws) if len(rest) else None)
            n = len(sizes)
            number, total = number + n, total + sum(sizes)
            yield pa.record_batch(
                [pa.array([0] * n, pa.int32()), batch.column(0), pa.array(sizes, pa.int64()), pa.array(crcs, pa.list_(pa.int64())), pa.array(rests, pa.binary()),
                 pa.array(keys, pa.int64()), blank(n, pa.int32()), blank(n, pa.int64()), blank(n, pa.int64())], names)
        terms = np.flatnonzero(holds)
        n = len(terms) + 1
        yield pa.record_batch(
            [pa.array([1] * (n - 1) + [2], pa.int32()), blank(n, pa.string()), blank(n, pa.int64()), blank(n, pa.list_(pa.int64())), blank(n, pa.binary()), blank(n, pa.int64()),
             pa.array([*terms.tolist(), None], pa.int32()), pa.array([*holds[terms].tolist(), number], pa.int64()), pa.array([None] * (n - 1) + [total], pa.int64())], names)

    return docs.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(frugal(encode), TOKENS)


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per piece: id, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``, ``sequence_id``, ``offset``.

    Every row of ``docs`` is one document, also where ids repeat or are null; its tokens are those of its whole text
    (null: none) and then id 1. Windows that a long document fills alone are sequences of their own. The open rests
    are sorted by a locality key and cut into shards of about :data:`SHARD` tokens; in each, a BM25 index (with the
    document frequencies of the whole corpus, which the vocabulary bounds) gives each seed's unused neighbours, which
    fill its window. The last, open sequence of a shard is cut into powers of two, which need no padding. An empty
    table gives no rows.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    path = scratch(spark, "tokens")
    with arrow_rows(spark, BATCH):
        tokenized(docs, tokenizer, id_col, text_col, window).write.option("compression", "zstd").parquet(path)
    rows = spark.read.schema(TOKENS).parquet(path)
    stats = {r[0]: r[1] for r in rows.filter("kind = 1").groupBy("term").agg(F.sum("docs")).collect()}
    size = rows.agg(F.sum(F.when(F.col("kind") == 2, F.col("docs"))), F.sum("total"), F.sum(F.octet_length("rest"))).first()
    number, total, rest_bytes = (int(x or 0) for x in size)
    holds = np.zeros(max(stats, default=0) + 1)
    holds[list(stats)] = list(stats.values())
    idf = np.log1p((number - holds + 0.5) / (holds + 0.5)).astype(np.float32)
    mean = max(1.0, total / max(1, number))
    dtype = word_ids(tokenizer).kind

    full = rows.filter("kind = 0 AND size(crcs) > 0")
    full = full.select("doc_id", "doc_tokens", F.posexplode("crcs").alias("_i", "ids_crc32"))
    full = full.select(
        "doc_id", (F.col("_i").cast("long") * window).alias("start"), F.lit(window).cast("long").alias("length"), "ids_crc32", "doc_tokens",
        (2 * F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"),
    )
    parts = parts_for(rest_bytes, PART)
    rests = rows.filter("kind = 0 AND rest IS NOT NULL").select("key", "doc_id", "doc_tokens", F.crc32("rest").alias("crc"), "rest")
    rests = rests.repartitionByRange(parts, "key", "doc_id", "crc").sortWithinPartitions("key", "doc_id", "crc", "doc_tokens", "rest")
    rests = rests.select(F.spark_partition_id().cast("long").alias("part"), "doc_id", "doc_tokens", "rest")

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[str | None, int, np.ndarray]] = []
        tokens = number = 0

        def solve() -> pa.RecordBatch:
            nonlocal number
            shard = Shard([x[2] for x in held], idf, mean)
            out = []
            for sequence in pack_shard(shard.sizes, shard, window):
                used = sequence[-1][3] + sequence[-1][2]
                for part_of in [sequence] if used == window else cut_open(sequence):
                    for piece, start, length, offset in part_of:
                        name, size, ids = held[piece]
                        out.append((name, size - len(ids) + start, length, crc_of(ids[start : start + length]), size, 2 * ((part << 33) + number) + 1, offset))
                    number += 1
            columns = list(zip(*out, strict=True))
            return pa.record_batch([pa.array(columns[0], pa.string()), *[pa.array(c, pa.int64()) for c in columns[1:]]], [x.split()[0] for x in PIECES.split(",")])

        part = 0
        for batch in batches:
            for where, name, size, rest in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                part = where
                held.append((name, size, np.frombuffer(rest, dtype)))
                tokens += len(held[-1][2])
                if tokens >= SHARD:
                    yield solve()
                    held, tokens = [], 0
        if held:
            yield solve()

    packed = rests.mapInArrow(frugal(fill), PIECES)
    return full.unionByName(packed).withColumn("doc_id", F.col("doc_id").cast(kind)).withColumnRenamed("doc_id", id_col)
