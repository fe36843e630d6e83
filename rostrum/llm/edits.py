"""Token counts that follow edits: per document a tree over runs of pre-tokens, of which edits renew only what they touch."""

from __future__ import annotations

import base64
import sys
import types
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rostrum.llm.common import frugal

#: Pre-tokens of a new leaf; a leaf that edits have grown beyond four times as many is cut again.
LEAF = 64
#: Pre-tokens whose counts a worker remembers; beyond it the memory starts anew.
REMEMBERED = 1_000_000

EDIT = "struct<start: bigint, stop: bigint, text: string>"


class PieceCounter:
    """Pre-tokens of a text and the number of tokens of each."""

    def __init__(self, ranks_path: str, pattern: str) -> None:
        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("counted", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(pattern)
        self.counts: dict[str, int] = {}

    def pieces(self, text: str, start: int = 0) -> Iterator[str]:
        """The pre-tokens from a position on that is the border of two."""
        return (m.group() for m in self.pattern.finditer(text, start))

    def count(self, piece: str) -> int:
        """Tokens of one pre-token."""
        n = self.counts.get(piece)
        if n is None:
            if len(self.counts) >= REMEMBERED:
                self.counts.clear()
            n = self.counts[piece] = len(self.encoding.encode_ordinary(piece))
        return n


class Tree:
    """Leaves of consecutive pre-tokens and, above them, sums of characters and tokens of each two nodes below.

    Nodes are numbered from 1 at the root; the children of ``i`` are ``2 i`` and ``2 i + 1``.
    """

    def __init__(self, chars: Sequence[int], tokens: Sequence[int]) -> None:
        n = 1
        while n < len(chars):
            n *= 2
        self.leaves = n
        self.chars, self.tokens = np.zeros(2 * n, np.int64), np.zeros(2 * n, np.int64)
        self.chars[n : n + len(chars)] = chars
        self.tokens[n : n + len(tokens)] = tokens
        while n > 1:
            n //= 2
            for sums in (self.chars, self.tokens):
                sums[n : 2 * n] = sums[2 * n : 4 * n : 2] + sums[2 * n + 1 : 4 * n : 2]

    def find(self, position: int) -> tuple[int, int]:
        """The leaf that holds the character at ``position`` (the last one beyond the end), and where it begins."""
        node, begin = 1, 0
        while node < self.leaves:
            node *= 2
            if position >= begin + self.chars[node] and self.chars[node + 1]:
                begin += int(self.chars[node])
                node += 1
        return node - self.leaves, begin

    def put(self, leaf: int, chars: int, tokens: int) -> None:
        """Renew a leaf and the sums above it."""
        node = leaf + self.leaves
        self.chars[node], self.tokens[node] = chars, tokens
        while node > 1:
            node //= 2
            self.chars[node] = self.chars[2 * node] + self.chars[2 * node + 1]
            self.tokens[node] = self.tokens[2 * node] + self.tokens[2 * node + 1]


def leaves_of(pieces: Sequence[str], counts: Sequence[int]) -> tuple[list[int], list[int]]:
    """Characters and tokens of each run of :data:`LEAF` pre-tokens."""
    if not pieces:
        return [], []
    at = np.arange(0, len(pieces), LEAF)
    chars = np.fromiter(map(len, pieces), np.int64, len(pieces))
    return np.add.reduceat(chars, at).tolist(), np.add.reduceat(np.asarray(counts, np.int64), at).tolist()


class Document:
    """A text with the tree of its token counts."""

    def __init__(self, counter: PieceCounter, text: str, chars: Sequence[int], tokens: Sequence[int]) -> None:
        self.counter, self.text = counter, text
        self.tree = Tree(chars, tokens)
        self.renewed = 0

    @property
    def total(self) -> int:
        return int(self.tree.tokens[1])

    def leaves(self) -> tuple[list[int], list[int]]:
        """Characters and tokens of the leaves that are not empty."""
        n = self.tree.leaves
        used = self.tree.chars[n:] > 0
        return self.tree.chars[n:][used].tolist(), self.tree.tokens[n:][used].tolist()

    def edit(self, start: int, stop: int, new: str) -> None:
        """Replace the characters ``start`` .. ``stop`` (clipped to the text) and renew the leaves around them.

        A pre-token that ends before the edited place sees none of it, not even with its one character of look-ahead;
        so the scan begins at the leaf of the character before. Scanning needs no memory beyond its position: as soon
        as a pre-token of the new text ends where a leaf of the old text behind the edit begins, the rest stands.
        """
        start = min(max(0, start), len(self.text))
        stop = min(max(start, stop), len(self.text))
        old, shift = self.text, len(new) - (stop - start)
        self.text = old[:start] + new + old[stop:]
        tree = self.tree
        first, begin = tree.find(max(0, start - 1))
        if first and start - begin <= 1:
            first, begin = tree.find(begin - 1)
        last, end = tree.find(stop)
        end += int(tree.chars[last + tree.leaves])
        chars = tokens = pieces = 0
        for piece in self.counter.pieces(self.text, begin):
            here = begin + chars - shift
            while here > end:
                last, end = tree.find(end)
                end += int(tree.chars[last + tree.leaves])
            if here == end and here >= stop and chars:
                break
            chars += len(piece)
            tokens += self.counter.count(piece)
            pieces += 1
        self.renewed += pieces
        for leaf in range(first + 1, last + 1):
            if tree.chars[leaf + tree.leaves]:
                tree.put(leaf, 0, 0)
        tree.put(first, chars, tokens)
        if pieces > 4 * LEAF:
            self._cut(first, begin, chars)

    def _cut(self, leaf: int, begin: int, size: int) -> None:
        """Cut a leaf that has grown too long into leaves of the usual size."""
        parts = [m for m in self.counter.pieces(self.text[begin : begin + size])]
        chars, tokens = self.leaves()
        place = int(np.count_nonzero(self.tree.chars[self.tree.leaves : self.tree.leaves + leaf]))
        more = leaves_of(parts, [self.counter.count(p) for p in parts])
        if sum(more[1]) == tokens[place]:
            self.tree = Tree(chars[:place] + more[0] + chars[place + 1 :], tokens[:place] + more[1] + tokens[place + 1 :])


def piece_counter(ranks_path: str, pattern: str) -> PieceCounter:
    """The worker's counter for a vocabulary, kept from task to task."""
    state = sys.modules.setdefault("rostrum_worker_state", types.ModuleType("rostrum_worker_state"))
    counters = state.__dict__.setdefault("counters", {})
    if (ranks_path, pattern) not in counters:
        counters[ranks_path, pattern] = PieceCounter(ranks_path, pattern)
    return counters[ranks_path, pattern]


def _mapped(rows: DataFrame, columns: list[str], schema: str, work: Callable[[dict], dict]) -> DataFrame:
    """Rows through ``work`` in Arrow batches of bounded text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 512):
                part = batch.slice(at, 512)
                out = [work(row) for row in part.to_pylist()]
                names = list(out[0])
                yield pa.record_batch([pa.array([r[c] for r in out], kinds[c]) for c in names], names)

    kinds = {"id": pa.int64(), "text": pa.large_string(), "leaf_chars": pa.list_(pa.int64()), "leaf_tokens": pa.list_(pa.int64()),
             "tokens": pa.int64(), "n_edits": pa.int64(), "tokens_before": pa.int64(), "pieces_renewed": pa.int64(), "edits": pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("text", pa.string())]))}
    return rows.select(*columns).mapInArrow(frugal(run), schema)


def build_trees(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", edits: Column | None = None) -> DataFrame:
    """``id, text, leaf_chars, leaf_tokens, tokens, edits``: the leaves of each document's tree and its token count.

    A null text is empty. ``edits`` may be an expression of type array of (start, stop, text), null if left out.
    """

    def work(row: dict) -> dict:
        counter = piece_counter(ranks_path, pattern)
        pieces = counter.pattern.findall(row["text"])
        chars, tokens = leaves_of(pieces, [counter.count(p) for p in pieces])
        return {"id": row["id"], "text": row["text"], "leaf_chars": chars, "leaf_tokens": tokens, "tokens": sum(tokens), "edits": row["edits"]}

    wanted = (F.lit(None) if edits is None else edits).cast(f"array<{EDIT}>").alias("edits")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), wanted)
    return _mapped(rows, ["id", "text", "edits"], f"id long, text string, leaf_chars array<long>, leaf_tokens array<long>, tokens long, edits array<{EDIT}>", work)


def apply_edits(trees: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """``id, text, leaf_chars, leaf_tokens, tokens, tokens_before, n_edits, pieces_renewed`` after the edits of each row.

    Edits apply one after another, each to the text that the ones before it left; positions are code points, clipped
    to the text; null positions or texts count as 0 and empty. No edits, or null, leave a document as it is.
    """

    def work(row: dict) -> dict:
        document = Document(piece_counter(ranks_path, pattern), row["text"], row["leaf_chars"], row["leaf_tokens"])
        edits = [e for e in row["edits"] or [] if e is not None]
        for e in edits:
            document.edit(e["start"] or 0, e["stop"] or 0, e["text"] or "")
        chars, tokens = document.leaves()
        return {"id": row["id"], "text": document.text, "leaf_chars": chars, "leaf_tokens": tokens, "tokens": document.total,
                "tokens_before": row["tokens"], "n_edits": len(edits), "pieces_renewed": document.renewed}

    return _mapped(trees, ["id", "text", "leaf_chars", "leaf_tokens", "tokens", "edits"],
                   "id long, text string, leaf_chars array<long>, leaf_tokens array<long>, tokens long, tokens_before long, n_edits long, pieces_renewed long", work)
