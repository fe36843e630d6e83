"""Removal of byte strings that also start in an earlier document, through suffix arrays of content-defined shards."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rostrum.llm.common import by_group, frugal, kept, mixed, parts_for
from rostrum.llm.shingles import views
from rostrum.llm.suffixes import permuted_prefixes, suffix_array

#: Bytes of a string that counts as repeated, and of the anchor within it.
LENGTH, ANCHOR = 50, 24
#: Bytes that every such string has before the anchor, or else behind it, at least.
HALF = (LENGTH - ANCHOR) // 2
#: Text bytes of a block of consecutive documents.
BLOCK = 4 << 20
#: Text bytes behind one bucket of anchors.
BUCKET = 16 << 20
#: Bytes of segments under one suffix array.
SHARD = 1 << 19
#: Segments of one anchor beyond which it is told apart by longer context.
HOT = 2048
#: Entries a task gathers before it hands them on.
GATHER = 1 << 20
#: Document ids looked at to place the block bounds; they decide the balance and nothing else.
BOUND_SAMPLE = 1_000_000

_rng = np.random.default_rng(50)
_VALUE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_POWER = np.uint64(0x5851F42D4C957F2D)
_LAST = (1 << 63) - 1


def _anchor_hashes(data: np.ndarray) -> np.ndarray:
    """64-bit hash of the :data:`ANCHOR` bytes at each position."""
    raw = np.ascontiguousarray(data)
    word = np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,))
    n = len(raw) - ANCHOR + 1
    h = word[:n] * np.uint64(0x9E3779B97F4A7C15)
    for k in range(8, ANCHOR, 8):
        h ^= h >> np.uint64(31)
        h += word[k : k + n]
        h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def segments(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Segments of some documents: document, start, stop, anchor position, anchor hash, content hash.

    Every string of :data:`LENGTH` bytes contains the same anchor wherever it occurs: the one with the least hash,
    the leftmost of equals. Consecutive strings with one anchor form a segment; each string is in exactly one.
    ``data`` has less than 2^24 bytes.
    """
    empty = np.zeros(0, np.int64)
    n = len(data)
    if n < LENGTH:
        return (empty, empty, empty, empty, np.zeros(0, np.uint64), np.zeros(0, np.uint64))
    h = _anchor_hashes(data)
    low = np.uint64((1 << 24) - 1)
    least = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    width, span = LENGTH - ANCHOR + 1, 1
    while span * 2 <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    least = np.minimum(least[: n - LENGTH + 1], least[width - span : width - span + n - LENGTH + 1])
    at = (least & low).astype(np.int64)
    inside = np.ones(len(at) + 1, bool)
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        inside[max(a, b - LENGTH + 1) : b] = False
    inside[-1] = False
    begins = inside[:-1].copy()
    begins[1:] &= ~inside[:-2] | (at[1:] != at[:-1])
    ends = inside[:-1].copy()
    ends[:-1] &= ~inside[1:-1] | (at[1:] != at[:-1])
    start, stop = np.flatnonzero(begins), np.flatnonzero(ends) + LENGTH
    power = np.full(n, _POWER)
    power[0] = 1
    np.multiply.accumulate(power, out=power)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_VALUE[data] * power, out=sums[1:])
    back = np.full(n, np.uint64(pow(int(_POWER), -1, 1 << 64)))
    back[0] = 1
    np.multiply.accumulate(back, out=back)
    content = mixed((sums[stop] - sums[start]) * back[start] + (stop - start).astype(np.uint64))
    doc = np.searchsorted(offsets, start, "right") - 1
    return doc, start, stop, at[start], h[at[start]], content


def row_segments(column: pa.Array) -> Iterator[tuple[np.ndarray, ...]]:
    """Segments of a text column with row numbers and offsets within the row; a long row is read in overlapping parts."""
    for first, last, data, offsets in views(column):
        if last - first == 1 and len(data) > 1 << 23:
            for at in range(0, len(data) - LENGTH + 1, 1 << 22):
                part = data[at : at + (1 << 22) + LENGTH - 1]
                doc, start, stop, anchor, h, content = segments(part, np.array([0, len(part)]))
                yield doc + first, start + at, stop + at, anchor + at, h, content
        else:
            doc, start, stop, anchor, h, content = segments(data, offsets)
            base = offsets[doc]
            yield doc + first, start - base, stop - base, anchor - base, h, content


def _blobs(keys: list[np.ndarray], h: np.ndarray, s: np.ndarray, names: list[str]) -> pa.RecordBatch:
    """Rows of equal keys (sorted already) as one row each with the hashes packed."""
    change = np.zeros(len(h), bool)
    change[:1] = True
    for k in keys:
        change[1:] |= k[1:] != k[:-1]
    first = np.flatnonzero(change)
    last = np.append(first[1:], len(h))
    cols = [pa.array(k[first]) for k in keys]
    packed = [pa.array([x[a:b].tobytes() for a, b in zip(first, last, strict=True)], pa.binary()) for x in (h, s)]
    return pa.record_batch([*cols, *packed], names)


def block_bounds(docs: DataFrame, blocks: int, rows: int) -> list[int]:
    """Ids at which blocks of documents begin, all but the first."""
    ids = docs.select("id") if rows <= BOUND_SAMPLE else docs.select("id").sample(BOUND_SAMPLE / rows, seed=1)
    found = np.sort(ids.toArrow()["id"].to_numpy())
    cuts = found[np.arange(1, blocks) * len(found) // blocks] if len(found) else []
    return sorted({int(x) for x in cuts})


def anchor_entries(docs: DataFrame, buckets: int) -> DataFrame:
    """``bucket, block, h, s``: the distinct (anchor, content) hashes of each block, packed by bucket."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        count = 0

        def flush() -> pa.RecordBatch:
            block, h, s = (np.concatenate(x) for x in zip(*held, strict=True))
            bucket = ((h >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
            h = h.astype(np.uint32)
            key = bucket << 32 | block
            order = np.lexsort((s, key))
            key, h, s = key[order], h[order], s[order]
            fresh = np.ones(len(s), bool)
            fresh[1:] = (s[1:] != s[:-1]) | (key[1:] != key[:-1]) | (h[1:] != h[:-1])
            key, h, s = key[fresh], h[fresh], s[fresh]
            return _blobs([(key >> 32).astype(np.int32), (key & 0xFFFFFFFF).astype(np.int32)], h, s, ["bucket", "block", "h", "s"])

        for batch in batches:
            blocks = batch.column(0).to_numpy().astype(np.int64)
            for row, _, _, _, h, s in row_segments(batch.column(1)):
                held.append((blocks[row], h, s))
                count += len(h)
                if count >= GATHER:
                    yield flush()
                    held, count = [], 0
        if count:
            yield flush()

    return docs.select("block", "text").mapInArrow(frugal(gather), "bucket int, block int, h binary, s binary")


def replies(entries: DataFrame, parts: int) -> DataFrame:
    """``block, kind, h, s``: which segments a block must remove (kind 0) or send to a shard (kind 1).

    A segment that an earlier block has too goes from all its documents. Of an anchor with several different segments
    the earliest block of each sends its text; an anchor with one segment needs no further look.
    """

    def solve(table: pa.Table) -> Iterator[pa.RecordBatch]:
        h = np.frombuffer(b"".join(table["h"].to_pylist()), np.uint32)
        s = np.frombuffer(b"".join(table["s"].to_pylist()), np.uint64)
        sizes = np.array([len(x) // 4 for x in table["h"].to_pylist()])
        block = np.repeat(table["block"].to_numpy(), sizes)
        order = np.lexsort((block, s, h))
        h, s, block = h[order], s[order], block[order]
        new_h = np.ones(len(h), bool)
        new_h[1:] = h[1:] != h[:-1]
        new_s = new_h.copy()
        new_s[1:] |= s[1:] != s[:-1]
        several = np.add.reduceat(new_s.astype(np.int64), np.flatnonzero(new_h)) > 1
        several = several[np.cumsum(new_h) - 1]
        kind = np.where(new_s, np.where(several, 1, -1), 0)
        again = np.zeros(len(h), bool)
        again[1:] = ~new_s[1:] & (block[1:] == block[:-1])
        use = (kind >= 0) & ~again
        lead = np.maximum.accumulate(np.where(new_s, np.arange(len(h)), 0))
        use &= (kind == 1) | (block > block[lead])
        block, kind, h, s = block[use], kind[use], h[use], s[use]
        order = np.lexsort((s, kind, block))
        if len(order):
            yield _blobs([block[order].astype(np.int32), kind[order].astype(np.int32)], h[order], s[order], ["block", "kind", "h", "s"])

    dealt = entries.repartition(parts, "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(frugal(by_group("bucket", solve)), "block int, kind int, h binary, s binary")


def _listed(h: np.ndarray, s: np.ndarray, table: list[tuple[bytes, bytes]]) -> np.ndarray:
    """Which (h, s) a reply lists."""
    found = np.zeros(len(h), bool)
    if not table:
        return found
    th = np.frombuffer(b"".join(x for x, _ in table), np.uint32)
    ts = np.frombuffer(b"".join(x for _, x in table), np.uint64)
    order = np.lexsort((th, ts))
    th, ts = th[order], ts[order]
    at = np.searchsorted(ts, s)
    for step in (0, 1):
        k = np.minimum(at + step, len(ts) - 1)
        found |= (ts[k] == s) & (th[k] == h.astype(np.uint32))
    return found


def merged(spans: np.ndarray) -> np.ndarray:
    """Disjoint maximal runs of some ``[start, stop)`` rows, in order."""
    if not len(spans):
        return spans.reshape(0, 2)
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    first = np.ones(len(spans), bool)
    first[1:] = spans[1:, 0] > reach[:-1]
    begin = np.flatnonzero(first)
    return np.stack([spans[begin, 0], reach[np.append(begin[1:], len(spans)) - 1]], axis=1)


def finished(data: bytes, spans: np.ndarray) -> tuple[int, int, str]:
    """Removed bytes, removed runs and the digest of what stays, for merged spans."""
    digest, at, view = hashlib.sha256(), 0, memoryview(data)
    for a, b in spans.tolist():
        digest.update(view[at:a])
        at = b
    digest.update(view[at:])
    return int((spans[:, 1] - spans[:, 0]).sum()) if len(spans) else 0, len(spans), digest.hexdigest()


FOUND = """kind int, id long, key long, n_bytes long, spans binary, text binary, n_removed long, n_spans long, kept_sha256 string,
 fam binary, start long, anchor long"""
_FOUND = pa.schema([
    ("kind", pa.int32()), ("id", pa.int64()), ("key", pa.int64()), ("n_bytes", pa.int64()), ("spans", pa.binary()), ("text", pa.binary()),
    ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("fam", pa.binary()), ("start", pa.int64()), ("anchor", pa.int64()),
])


def _batch(rows: int, **columns: list) -> pa.RecordBatch:
    return pa.record_batch([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(rows, f.type) for f in _FOUND], schema=_FOUND)


def resolve_blocks(docs: DataFrame, answers: DataFrame, parts: int) -> DataFrame:
    """Per document what its block knows (kind 0), and the segments that go to shards (kind 1).

    A document none of whose segments goes to a shard is finished here; the others keep their text.
    """
    left = answers.select("block", "kind", F.lit(None).cast("long").alias("id"), F.lit(None).cast("string").alias("text"), "h", "s")
    right = docs.select("block", F.lit(2).alias("kind"), "id", "text", F.lit(None).cast("binary").alias("h"), F.lit(None).cast("binary").alias("s"))

    def solve(table: pa.Table) -> Iterator[pa.RecordBatch]:
        kind = table["kind"].to_numpy()
        lists = {k: list(zip(*[table.filter(pa.array(kind == k))[c].to_pylist() for c in ("h", "s")], strict=True)) for k in (0, 1)}
        own = table.filter(pa.array(kind == 2)).select(["block", "id", "text"]).combine_chunks()
        if not len(own):
            return
        ids = own["id"].to_numpy()
        texts = own["text"].combine_chunks() if own["text"].num_chunks != 1 else own["text"].chunk(0)
        block = own["block"][0].as_py()
        got = [np.concatenate(x) for x in zip(*row_segments(texts), strict=True)]
        row, start, stop, anchor, h, s = got
        rank = np.cumsum(np.concatenate(([0], (ids[1:] != ids[:-1]).astype(np.int64))))[row] if len(row) else row
        order = np.lexsort((rank, h, s))
        lead = np.ones(len(order), bool)
        lead[1:] = (s[order][1:] != s[order][:-1]) | (h[order][1:] != h[order][:-1])
        head = np.maximum.accumulate(np.where(lead, np.arange(len(order)), 0))
        gone = np.zeros(len(row), bool)
        gone[order] = rank[order] > rank[order][head]
        gone |= _listed(h, s, lists[0])
        send = ~gone & _listed(h, s, lists[1])
        firsts = np.searchsorted(row, np.arange(len(ids) + 1))
        out: dict[str, list] = {c: [] for c in ("kind", "id", "key", "n_bytes", "spans", "text", "n_removed", "n_spans", "kept_sha256")}
        more: dict[str, list] = {c: [] for c in ("kind", "id", "key", "fam", "start", "anchor", "text")}
        size = 0
        for i in range(len(ids)):
            data = texts[i].as_py()
            data = data.encode() if data is not None else b""
            a, b = firsts[i], firsts[i + 1]
            mine = gone[a:b]
            spans = merged(np.stack([start[a:b][mine], stop[a:b][mine]], axis=1))
            sent = a + np.flatnonzero(send[a:b])
            done = finished(data, spans) if not len(sent) else (None, None, None)
            for c, v in zip(out, (0, int(ids[i]), block << 32 | i, len(data), spans.astype(np.int64).tobytes(), None if done[2] else data, *done), strict=True):
                out[c].append(v)
            for j in sent.tolist():
                cut = data[start[j] : stop[j]]
                for c, v in zip(more, (1, int(ids[i]), block << 32 | i, h[j].tobytes(), int(start[j]), int(anchor[j] - start[j]), cut), strict=True):
                    more[c].append(v)
            size += 0 if done[2] else len(data)
            if size > BLOCK:
                yield _batch(len(out["kind"]), **out)
                out, size = {c: [] for c in out}, 0
        if out["kind"]:
            yield _batch(len(out["kind"]), **out)
        if more["kind"]:
            yield _batch(len(more["kind"]), **more)

    both = left.unionByName(right).repartition(parts, "block").sortWithinPartitions("block", "kind", "id")
    return both.mapInArrow(frugal(by_group("block", solve)), FOUND)


SPANS = "key long, start long, stop long"


def _runs(column: pa.ChunkedArray) -> np.ndarray:
    """Number of each row's run of equal values."""
    if len(column) < 2:
        return np.zeros(len(column), np.int64)
    differ = pc.not_equal(column.slice(1).combine_chunks(), column.slice(0, len(column) - 1).combine_chunks())
    return np.concatenate(([0], np.cumsum(differ.to_numpy(zero_copy_only=False))))


def may_repeat(table: pa.Table, family: np.ndarray) -> np.ndarray:
    """Which segments ``(id, anchor, text)`` may hold a string that another id of the same family has too.

    A string reaches :data:`HALF` bytes or more beyond the anchor on one side. So segments that share a string share the
    anchor with that many bytes before it or behind it; what shares neither with another id needs no suffix array.
    """
    texts = table["text"].combine_chunks()
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)
    ids, anchor = table["id"].to_numpy(), table["anchor"].to_numpy()
    may = np.zeros(len(texts), bool)
    for begin, reaches in ((anchor - HALF, anchor >= HALF), (anchor + ANCHOR, np.diff(offsets) >= anchor + ANCHOR + HALF)):
        rows = np.flatnonzero(reaches)
        first = (offsets[:-1] + begin)[rows]
        context = np.zeros(len(rows), np.uint64)
        for k in range(HALF):
            context = context * _POWER + _VALUE[data[first + k]]
        context = mixed(context)
        order = np.lexsort((ids[rows], context, family[rows]))
        rows, context = rows[order], context[order]
        if not len(rows):
            continue
        lead = np.flatnonzero(np.append(True, (context[1:] != context[:-1]) | (family[rows][1:] != family[rows][:-1])))
        counts = np.diff(np.append(lead, len(rows)))
        several = ids[rows[lead]] != ids[rows[lead + counts - 1]]
        may[rows[np.repeat(several, counts)]] = True
    return may


def shard_repeats(segs: DataFrame, parts: int) -> DataFrame:
    """Spans of segments whose strings a smaller id of the same family has too.

    What :func:`may_repeat` leaves of the families is gathered into shards of about :data:`SHARD` bytes; adjacent suffixes with a common prefix of
    :data:`LENGTH` bytes are occurrences of one string.
    """

    def solve(texts: list[bytes], ids: list[int], keys: list[int], starts: list[int]) -> pa.RecordBatch | None:
        raw = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8)
        sizes = np.array([len(x) for x in texts])
        owner = np.repeat(np.arange(len(texts)), sizes + 1)
        begin = np.concatenate(([0], np.cumsum(sizes + 1)))[:-1]
        left = begin[owner] + sizes[owner] - np.arange(len(raw))
        coded = np.where(left > 0, raw.astype(np.uint16) + 2, 1).astype(np.uint16)
        t = np.append(coded, 0)
        sa = suffix_array(t)
        same = permuted_prefixes(t, sa)[sa] >= LENGTH
        whole = np.append(left, 0)[sa] >= LENGTH
        first = np.flatnonzero(~same)
        who = np.append(np.array(ids, np.int64)[owner], _LAST)[sa]
        least = np.minimum.reduceat(who, first)[np.cumsum(~same) - 1]
        hit = np.sort(sa[whole & (who > least)])
        if not len(hit):
            return None
        cut = np.flatnonzero((hit[1:] != hit[:-1] + 1) | (owner[hit[1:]] != owner[hit[:-1]])) + 1
        a, b = hit[np.concatenate(([0], cut))], hit[np.concatenate((cut - 1, [len(hit) - 1]))]
        shift = np.array(starts, np.int64)[owner[a]] - begin[owner[a]]
        return pa.record_batch([pa.array(np.array(keys, np.int64)[owner[a]]), pa.array(a + shift), pa.array(b + shift + LENGTH)], ["key", "start", "stop"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.Table] = []
        open_end: pa.Table | None = None
        size = 0

        def closed() -> Iterator[pa.RecordBatch]:
            columns = [pa.concat_tables(waiting)[c].to_pylist() for c in ("text", "id", "key", "start")]
            waiting.clear()
            if (got := solve(*columns)) is not None:
                yield got

        for batch in chain(batches, [None]):
            table = open_end if batch is None else pa.Table.from_batches([batch])
            if batch is not None and open_end is not None:
                table = pa.concat_tables([open_end, table])
            if table is None or not len(table):
                continue
            table = table.combine_chunks()
            family = _runs(table["fam"])
            # the last family may go on in the next batch
            whole = len(table) if batch is None else int(np.searchsorted(family, family[-1]))
            open_end = table.slice(whole)
            if not whole:
                continue
            table = table.slice(0, whole)
            table = table.filter(pa.array(may_repeat(table, family[:whole])))
            while len(table):
                ends = np.cumsum(pc.binary_length(table["text"]).to_numpy().astype(np.int64) + 1)
                fam = _runs(table["fam"])
                last = int(np.searchsorted(ends, SHARD - size))
                last = int(np.searchsorted(fam, fam[last], "right")) if last < len(table) else len(table)
                waiting.append(table.slice(0, last))
                size += int(ends[last - 1])
                table = table.slice(last)
                if size >= SHARD:
                    yield from closed()
                    size = 0
        if waiting:
            yield from closed()

    dealt = segs.select("fam", "id", "key", "start", "anchor", "text").repartition(parts, "fam").sortWithinPartitions("fam")
    return dealt.mapInArrow(frugal(run), SPANS)


SEGMENTS = "fam binary, low int, high int, id long, key long, start long, anchor long, text binary"


def told_apart(segs: DataFrame) -> DataFrame:
    """Each segment's strings in two halves by where they begin before the anchor, under what all of a half share.

    A row stands for the strings that begin ``low`` .. ``high`` bytes before its anchor.
    """
    kinds = [pa.binary(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    names = [x.split()[0] for x in SEGMENTS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for _, least, most, who, key, start, anchor, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                middle = (least + most) // 2
                for low, high in ((least, middle), (middle + 1, most)):
                    a, b = max(0, anchor - high), min(len(text), anchor + LENGTH - low)
                    if b - a >= LENGTH and anchor >= low and anchor + LENGTH - high <= len(text):
                        common = text[anchor - low : anchor + LENGTH - high]
                        fam = hashlib.blake2b(common, digest_size=16, salt=bytes([low, high])).digest()
                        out.append((fam, low, high, who, key, start + a, anchor - a, text[a:b]))
            cols = list(zip(*out, strict=True)) or [[]] * len(names)
            yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    return segs.select(*names).mapInArrow(frugal(run), SEGMENTS)


def family_repeats(segs: DataFrame, parts: int) -> DataFrame:
    """Repeated spans of all families.

    A family of more than :data:`HOT` segments is told apart by longer common context, the offsets of its strings
    halved each time, five times at most; what is alone then is dropped. Where one offset is left all strings of a
    family are equal, and the smallest id is all that the others need.
    """
    rows = segs.withColumn("low", F.lit(0)).withColumn("high", F.lit(LENGTH - ANCHOR))
    cold: list[DataFrame] = []
    single: list[DataFrame] = []
    while True:
        counts = rows.groupBy("fam").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("least"), F.min(F.col("high") - F.col("low")).alias("wide"))
        counts = kept(counts.filter("n > 1"), "families").withColumnRenamed("fam", "_fam")
        of = lambda which, rows=rows, counts=counts: rows.join(counts.filter(which), F.col("fam") == F.col("_fam"))
        cold.append(of(f"wide > 0 AND n <= {HOT}").select("fam", "id", "key", "start", "anchor", "text"))
        single.append(of("wide = 0").filter("id > least").select("key", "start", (F.col("start") + LENGTH).alias("stop")))
        if counts.filter(f"wide > 0 AND n > {HOT}").isEmpty():
            break
        rows = kept(told_apart(of(f"wide > 0 AND n > {HOT}")), "told-apart")
    found = shard_repeats(reduce(DataFrame.unionByName, cold), parts)
    return reduce(DataFrame.unionByName, single, found)


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_spans: bool = False) -> DataFrame:
    """One row per input row: id, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256``; on request ``spans`` too.

    Texts are UTF-8 bytes (null: none). A byte goes if a string of :data:`LENGTH` bytes that covers it also starts in
    a document with a smaller id; strings never cross documents and are judged on the input. Rows with equal ids do
    not count as earlier to each other; a null id comes after all others. An empty table gives an empty result.

    The strings of :data:`LENGTH` bytes are gathered into segments by their anchors. Blocks of documents in id order
    exchange hashes of the segments only: a segment that an earlier block has too is settled by that. Anchors whose
    segments differ, as at the edges of a passage, are gathered into shards, where a suffix array finds the equal
    strings. ``spans`` are the removed ranges as pairs of little-endian 64-bit offsets.
    """
    ident = F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST))
    rows = docs.select(ident.alias("id"), F.col(text_col).alias("text"))
    total, number = rows.agg(F.sum(F.octet_length("text")), F.count(F.lit(1))).first()
    total, number = int(total or 0), int(number)
    bounds = block_bounds(rows, parts_for(total, BLOCK), number)
    blocks = len(bounds) + 1
    edges = np.array(bounds, np.int64)

    def block_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(np.searchsorted(edges, batch.column(0).to_numpy(), "right").astype(np.int32))], ["id", "text", "block"])

    placed = rows.mapInArrow(frugal(block_of), "id long, text string, block int")
    answers = replies(anchor_entries(placed, parts_for(total, BUCKET)), parts_for(total, BUCKET))
    spark = docs.sparkSession
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = kept(resolve_blocks(placed, answers, max(blocks, least)), "blocks")
    segs = found.filter("kind = 1")
    spans = family_repeats(segs, max(least, parts_for(total, BUCKET)))
    spans = spans.groupBy(F.col("key").alias("_key")).agg(F.collect_list(F.struct("start", "stop")).alias("more"))
    settled = found.filter("kind = 0 AND text IS NULL").select("id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans")
    waiting = found.filter("kind = 0 AND text IS NOT NULL").select("id", "key", "n_bytes", "spans", "text").join(spans, F.col("key") == F.col("_key"), "left")
    waiting = waiting.select("id", "n_bytes", "spans", "text", "more")

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[], [], [], []]
            for own, text, more in zip(*[batch.column(k) for k in (2, 3, 4)], strict=True):
                spans = np.frombuffer(own.as_py(), np.int64).reshape(-1, 2)
                if more.is_valid and len(more):
                    got = more.values
                    spans = np.concatenate([spans, np.stack([got.field(0).to_numpy(), got.field(1).to_numpy()], axis=1)])
                spans = merged(spans)
                for c, v in zip(cols, (*finished(text.as_py(), spans), spans.astype(np.int64).tobytes()), strict=True):
                    c.append(v)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.binary())], ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])

    closed = waiting.mapInArrow(frugal(close), "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans binary")
    out = settled.unionByName(closed).withColumn("id", F.when(F.col("id") != _LAST, F.col("id")).cast(docs.schema[id_col].dataType))
    out = out.withColumnRenamed("id", id_col)
    return out if with_spans else out.drop("spans")
