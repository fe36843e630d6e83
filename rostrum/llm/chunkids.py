"""Token ids of whole texts through content-defined chunks that documents share, and texts of ids."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rostrum.llm.common import by_group, frugal, mixed, parts_for
from rostrum.llm.wordids import gathered, word_ids

#: Text bytes of a block of documents, which is cut and put together at once.
BLOCK = 16 << 20
#: Text bytes behind one part of the distinct chunks.
PART = 32 << 20
#: Bytes that the rolling hash covers, mean and greatest length of a chunk.
WINDOW, MEAN, LONGEST = 32, 512, 4096
#: Text bytes encoded in one call, and token ids that leave a task at once.
CALL, SENT = 8 << 20, 500_000
#: Level of compression of what is shuffled.
LEVEL = 6
#: No pre-token of such a tokenizer crosses these, so ids on both sides do not depend on each other.
SAFE = (0x20, 0x0A)

#: Rows between the steps. Kind 0 is a block's layout: ids of its documents and ``data`` to put them together.
#: Kind 1 asks for the block's distinct chunks of one part: digests, sizes and bytes; the answer is their token ids.
ROWS = "key long, kind int, block long, part int, ids array<string>, data array<binary>"
FIELDS = pa.schema([("key", pa.int64()), ("kind", pa.int32()), ("block", pa.int64()), ("part", pa.int32()), ("ids", pa.list_(pa.string())), ("data", pa.list_(pa.binary()))])


def squeezed(x: bytes | np.ndarray) -> bytes:
    """Bytes behind their length, compressed."""
    raw = x if isinstance(x, bytes) else x.tobytes()
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", LEVEL).compress(raw, asbytes=True)


def unsqueezed(x: bytes) -> bytes:
    """What :func:`squeezed` was given."""
    return pa.decompress(x[8:], decompressed_size=int.from_bytes(x[:8], "little"), codec="zstd", asbytes=True)


def cut_places(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Where chunks begin and end: document bounds and places that the :data:`WINDOW` bytes before them choose.

    Equal texts are cut alike wherever they stand. Runs without such a place are cut at :data:`LONGEST` bytes.
    """
    h = mixed(np.arange(256, dtype=np.uint64)).astype(np.uint32)[data]
    width = 1
    while width < WINDOW and len(h) > width:  # twice the bytes in each round
        h = h[:-width] * np.uint32(0x9E3779B1 + 2 * width) + h[width:]
        width *= 2
    cuts = np.flatnonzero(h >> np.uint32(8) & np.uint32(MEAN - 1) == 0) + WINDOW if width == WINDOW else np.zeros(0, np.int64)
    cuts = cuts[cuts < len(data)]
    cuts = cuts[cuts - bounds[np.searchsorted(bounds, cuts, "right") - 1] >= WINDOW]
    cuts = np.unique(np.concatenate((bounds, cuts)))
    gaps = np.diff(cuts)
    more = [np.arange(cuts[i] + LONGEST, cuts[i + 1], LONGEST) for i in np.flatnonzero(gaps > LONGEST)]
    cuts = np.concatenate((cuts, *more)) if more else cuts
    for _ in range(3):  # not inside a character
        inside = cuts < len(data)
        inside[inside] = data[cuts[inside]] & 0xC0 == 0x80
        cuts = cuts + inside
    return np.unique(cuts)


def cut_block(ids: list[str], texts: pa.Array, block: int, parts: int) -> Iterator[tuple]:
    """Rows of a block: its distinct chunk insides by part, and the layout with the seams between them.

    The inside of a chunk reaches from its first safe byte to its last; a seam covers what lies between the insides of
    neighbours, over as many chunks without a safe byte as stand there.
    """
    texts = texts.cast(pa.large_string())
    texts = pa.concat_arrays([texts])  # from offset 0
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    view = memoryview(raw)[bounds[0] : bounds[-1]] if raw is not None else memoryview(b"")
    bounds = bounds - bounds[0]
    data = np.frombuffer(view, np.uint8)
    cuts = cut_places(data, bounds) if len(data) else np.zeros(1, np.int64)
    safe = np.flatnonzero((data == SAFE[0]) | (data == SAFE[1]))
    low, high = np.searchsorted(safe, cuts[:-1]), np.searchsorted(safe, cuts[1:]) - 1
    held = high > low  # an inside of at least one byte
    begin, end = safe[low[held]], safe[high[held]]
    owner = np.searchsorted(bounds, begin, "right") - 1  # empty documents have no chunk
    per = np.bincount(owner, minlength=len(ids)) if len(owner) else np.zeros(len(ids), np.int64)
    last = np.cumsum(per)
    seam_begin, seam_end = np.insert(end, last - per, bounds[:-1]), np.insert(begin, last, bounds[1:])

    digests = pa.array([hashlib.blake2b(view[a:b], digest_size=16).digest() for a, b in zip(begin.tolist(), end.tolist(), strict=True)], pa.binary(16)).dictionary_encode()
    code = digests.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    names = digests.dictionary.to_pylist()
    example = np.zeros(len(names), np.int64)
    example[code[::-1]] = np.arange(len(code))[::-1]
    part = np.array([int.from_bytes(d[:8], "little") % parts for d in names], np.int64)
    order = np.argsort(part, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    for p in np.unique(part).tolist():
        some = order[np.searchsorted(part[order], p) : np.searchsorted(part[order], p, "right")]
        spans = [(int(begin[i]), int(end[i])) for i in example[some]]
        sizes = np.array([b - a for a, b in spans], np.int32)
        yield p, 1, block, p, None, [b"".join(names[i] for i in some), squeezed(sizes), squeezed(b"".join(view[a:b] for a, b in spans))]

    seams = pa.array([bytes(view[a:b]) for a, b in zip(seam_begin.tolist(), seam_end.tolist(), strict=True)], pa.large_binary()).dictionary_encode()
    sizes = pc.binary_length(seams.dictionary).to_numpy(zero_copy_only=False).astype(np.int64)
    joined = b"".join(seams.dictionary.to_pylist())
    layout = (per.astype(np.int32), place[code].astype(np.int32), seams.indices.to_numpy(zero_copy_only=False).astype(np.int32), sizes, joined)
    yield -1 - block % parts, 0, block, None, ids, [squeezed(x) for x in layout]


def texts_of(joined: bytes, sizes: np.ndarray) -> pa.Array:
    """Texts that stand one after another in UTF-8."""
    offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
    return pa.Array.from_buffers(pa.large_string(), len(sizes), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(joined)])


def flattened(arrays: list[np.ndarray], kind: type) -> tuple[np.ndarray, np.ndarray]:
    """Arrays one after another, and their sizes."""
    return np.concatenate([np.zeros(0, kind), *arrays]), np.array([len(a) for a in arrays], np.int64)


def put_together(rows: list[dict], tokenizer: str, decoded: bool) -> Iterator[pa.RecordBatch]:
    """``id, ids`` and, if ``decoded``, ``text`` of a block: the ids of its chunks' insides with those of the seams between them."""
    encoder = word_ids(tokenizer)
    layout, answers = rows[0], rows[1:]
    per, code, seam, sizes, joined = (unsqueezed(x) for x in layout["data"])
    per, code, seam = (np.frombuffer(x, np.int32).astype(np.int64) for x in (per, code, seam))
    seam_ids, seam_sizes = flattened(encoder.encode(texts_of(joined, np.frombuffer(sizes, np.int64))), encoder.kind)
    inner_sizes = np.concatenate([np.zeros(0, np.int64), *[np.frombuffer(unsqueezed(r["data"][0]), np.int32) for r in answers]])
    flat = np.concatenate([*[np.frombuffer(unsqueezed(r["data"][1]), encoder.kind) for r in answers], seam_ids])
    # the units of a document: seam, inside, seam, ..., inside, seam
    units = 2 * per + 1
    base = np.append(np.cumsum(units) - units, units.sum())
    which = np.empty(int(base[-1]), np.int64)
    turn = np.arange(len(seam)) - np.repeat(np.cumsum(per + 1) - per - 1, per + 1)
    which[np.repeat(base[:-1], per + 1) + 2 * turn] = len(inner_sizes) + seam
    turn = np.arange(len(code)) - np.repeat(np.cumsum(per) - per, per)
    which[np.repeat(base[:-1], per) + 2 * turn + 1] = code
    all_sizes = np.concatenate((inner_sizes, seam_sizes)).astype(np.int64)
    starts = np.cumsum(all_sizes) - all_sizes
    # some documents at a time, so that what leaves the task at once is bounded
    total = np.concatenate(([0], np.cumsum(all_sizes[which])))[base]
    first = 0
    while first < len(per):
        last = max(first + 1, int(np.searchsorted(total, total[first] + SENT, "right")) - 1)
        ids, place = gathered(flat, starts, all_sizes, which[base[first] : base[last]])
        lists = pa.ListArray.from_arrays(pa.array(place[base[first : last + 1] - base[first]], pa.int32()), pa.array(ids.astype(np.int32)))
        names = pa.array(layout["ids"][first:last], pa.string())
        yield pa.record_batch([names, lists, decode_lists(lists, tokenizer)] if decoded else [names, lists], ["id", "ids", "text"][: 3 if decoded else 2])
        first = last


def decode_lists(lists: pa.Array, tokenizer: str) -> pa.Array:
    """The texts of lists of token ids; null for null."""
    encoder = word_ids(tokenizer)
    if encoder.tokenizer.decoder is None:  # then the tokens are joined by blanks
        if not hasattr(encoder, "names"):
            encoder.names = pa.array([encoder.tokenizer.id_to_token(i) for i in range(encoder.vocabulary)], pa.string())
        words = pa.ListArray.from_arrays(pc.subtract(lists.offsets, lists.offsets[0]), encoder.names.take(lists.flatten()))
        return pc.if_else(lists.is_null(), None, pc.binary_join(words, " "))
    out = encoder.tokenizer.decode_batch([x or [] for x in lists.to_pylist()], skip_special_tokens=False)
    return pc.if_else(lists.is_null(), None, pa.array(out, pa.string()))


def encode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """``id_col, ids``: the token ids of every whole text, as the tokenizer file gives them without added tokens.

    With ``decoded`` a column of that name holds the texts that the ids decode to (see :func:`decode`).

    Texts are cut where a rolling hash of the bytes says so, hence documents that share a passage share its chunks. The
    distinct chunks are shuffled by digest and each is encoded once; the blocks of documents that asked for them get the
    ids. What lies around a cut depends on both sides: each join is encoded anew from the last blank before it to the
    first behind it, over as many chunks as have none, since no pre-token crosses a blank and so the ids outside agree
    exactly. A widespread chunk costs one entry per block. Every row is a document, also where ids repeat or are null;
    a null text is empty and has no ids; an empty table gives no rows. ``docs`` should come from files, so that a
    repeated task sees the same rows in the same order.
    """
    kind = docs.schema[id_col].dataType
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    parts = parts_for(rows.agg(F.sum(F.octet_length("text"))).first()[0], PART)
    batch_of = lambda made: pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*made, strict=True), FIELDS, strict=True)], schema=FIELDS)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            ends = np.cumsum(pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False).astype(np.int64))
            first = 0
            while first < batch.num_rows:
                last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + BLOCK, "right")))
                ids, texts = batch.slice(first, last - first).columns
                yield batch_of(list(cut_block(ids.to_pylist(), texts, number, parts)))
                first, number = last, number + 1

    def answer(table: pa.Table) -> Iterator[pa.RecordBatch]:
        encoder = word_ids(tokenizer)
        rows = table.to_pylist()
        asked = [r for r in rows if r["kind"] == 1]
        known: dict[bytes, int] = {}
        held: list[np.ndarray] = []
        waiting: list[pa.Array] = []
        size = 0
        for row in asked:  # many distinct chunks in one call, since the encoder looks up distinct words
            joined, sizes, text = row["data"]
            row["ids"] = [joined[i : i + 16] for i in range(0, len(joined), 16)]
            new = np.zeros(len(row["ids"]), bool)
            for i, d in enumerate(row["ids"]):
                if d not in known:
                    known[d] = len(known)
                    new[i] = True
            texts = texts_of(unsqueezed(text), np.frombuffer(unsqueezed(sizes), np.int32))
            waiting.append(texts if new.all() else texts.filter(pa.array(new)))
            size += texts.nbytes
            row["data"] = None
            if size >= CALL or row is asked[-1]:
                held += encoder.encode(pa.concat_arrays(waiting))
                waiting, size = [], 0
        for row in rows:
            if row["kind"] == 1:
                ids, sizes = flattened([held[known[d]] for d in row["ids"]], encoder.kind)
                row["ids"], row["data"] = None, [squeezed(sizes.astype(np.int32)), squeezed(ids)]
            yield batch_of([tuple(row.values())])

    def gather(table: pa.Table) -> Iterator[pa.RecordBatch]:
        yield from put_together(sorted(table.to_pylist(), key=lambda r: (r["kind"], r["part"] or 0)), tokenizer, decoded)

    asked = rows.mapInArrow(frugal(cut), ROWS).repartition(parts, "key").sortWithinPartitions("key")
    told = asked.mapInArrow(frugal(by_group("key", answer)), ROWS).repartition(parts, "block").sortWithinPartitions("block")
    out = told.mapInArrow(frugal(by_group("block", gather)), "id string, ids array<int>, text string" if decoded else "id string, ids array<int>")
    return out.select(F.col("id").cast(kind).alias(id_col), *[F.col(c).alias(n) for c, n in (("ids", "ids"), ("text", "decoded")) if c in out.columns])


def decode(ids: Column, tokenizer: str) -> Column:
    """The text of token ids, special ones included, as the tokenizer file decodes them; null for null."""

    @F.arrow_udf("string")
    def texts(lists: pa.Array) -> pa.Array:
        return decode_lists(lists, tokenizer)

    return texts(ids)
