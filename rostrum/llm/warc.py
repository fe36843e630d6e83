"""WARC archives: deduplicating writer, and a reader that salvages what a damaged archive still holds."""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rostrum.llm.common import frugal, salted, spread

#: Bytes after which gathered members are handed to Spark's writer.
CHUNK = 1 << 20
#: Chunks of one archive file, so that a file is about 32 MB and a reader's task stays small.
CHUNKS = 32
#: Cells over which the rows of one payload are dealt when they meet the first of their kind.
SALTS = 64

#: Fixed by the format: the profile that names a record without payload.
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: Digests that are checked, as WARC labels them without hyphens.
DIGESTS = frozenset({"md5", "sha1", "sha224", "sha256", "sha384", "sha512"})

SCHEMA = """archive string, kind string, start long, stop long, reason string, record_id string, record_type string,
 target_uri string, refers_to string, payload_digest string, payload_bytes long, payload binary"""


def base32_sha1(data: bytes) -> str:
    """The digest as WARC writes it, without the algorithm's name."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def with_record_types(pages: DataFrame, id_col: str = "page_id", text_col: str = "html", least: int = 0) -> DataFrame:
    """Add ``_payload`` (UTF-8, null is empty), ``record_type`` and ``refers_to``.

    Of rows with equal payloads of at least ``least`` bytes the one with the smallest id is the response and the rest
    are revisits of it; rows that repeat the response's id are responses too. Null ids come last: they are revisits
    where the payload has a row with an id, else responses.
    """
    rows = pages.withColumn("_payload", F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8"))
    rows = rows.withColumn("_sha", F.sha1("_payload"))
    big = F.octet_length("_payload") >= least
    firsts = (
        rows.filter(big).groupBy("_sha").agg(F.min(id_col).alias("_first"), F.count(F.lit(1)).alias("_n"))
        .filter("_n > 1").select(F.col("_sha").alias("_fsha"), "_first")
    )
    first = spread(firsts, SALTS).withColumnRenamed("_salt", "_fsalt")
    dealt = salted(rows, SALTS, id_col)
    on = (F.col("_sha") == F.col("_fsha")) & (F.col("_salt") == F.col("_fsalt")) & big
    revisit = F.col("_first").isNotNull() & ~F.col(id_col).eqNullSafe(F.col("_first"))
    return (
        dealt.join(first, on, "left")
        .withColumn("record_type", F.when(revisit, "revisit").otherwise("response"))
        .withColumn("refers_to", F.when(revisit, F.col("_first")))
        .drop("_sha", "_salt", "_fsha", "_fsalt", "_first")
    )


def record_bytes(record_id: str, kind: str, uri: str, refers_to: str | None, payload: bytes, date: str) -> bytes:
    """One record: WARC header, HTTP header and, unless it is a revisit, the payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if kind == "revisit" else http + payload
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {date}", f"WARC-Target-URI: {uri}",
        f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}", f"WARC-Block-Digest: sha1:{base32_sha1(block)}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if kind == "revisit":
        lines += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: <{refers_to}>"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _raw(values: list[bytes]) -> pa.Array:
    """Bytes as an Arrow string column; Spark's text writer puts them out unchanged."""
    whole = pa.array(values, pa.binary())
    return pa.StringArray.from_buffers(len(whole), whole.buffers()[1], whole.buffers()[2])


def write_warc(
    pages: DataFrame, path: str, id_col: str = "page_id", text_col: str = "html", url_col: str = "url",
    least: int = 0, compress: bool = True, date: str = "1970-01-01T00:00:00Z",
) -> None:
    """Write one record per row as archives of gzip members (or plain records) below ``path``.

    Equal payloads are stored once, see :func:`with_record_types`. The files go through Spark's text writer, hence to
    any file system and only as whole tasks succeed; the NUL it puts after each chunk is padding that gzip allows.
    A null URL becomes ``urn:page:<id>``, line breaks in a URL are percent-encoded. An empty table gives no record.
    """
    cols = [F.col(id_col).cast("string").alias("id"), F.col(url_col).cast("string").alias("url"), "record_type", F.col("refers_to").cast("string").alias("refers_to"), "_payload"]
    rows = with_record_types(pages.select(*dict.fromkeys([id_col, text_col, url_col])), id_col, text_col, least).select(*cols)

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        size = 0
        for batch in batches:
            for key, url, kind, first, payload in zip(*[c for c in batch.columns], strict=True):
                name = f"urn:page:{key.as_py()}"
                uri = (url.as_py() or name).replace("\r", "%0D").replace("\n", "%0A")
                data = record_bytes(name, kind.as_py(), uri, first.is_valid and f"urn:page:{first.as_py()}" or None, payload.as_py(), date)
                if compress:
                    z = zlib.compressobj(6, zlib.DEFLATED, 31)
                    data = z.compress(data) + z.flush()
                held.append(data)
                size += len(data)
                if size >= CHUNK:
                    yield pa.record_batch([_raw([b"".join(held)])], ["value"])
                    held, size = [], 0
        if held:
            yield pa.record_batch([_raw([b"".join(held)])], ["value"])

    out = rows.mapInArrow(frugal(members), "value string")
    out.write.option("lineSep", "\0").option("maxRecordsPerFile", CHUNKS).text(path)


def _headers(data: bytes, start: int) -> tuple[dict[str, str], int] | None:
    """Header fields in lower case and where the block begins."""
    end = data.find(b"\r\n\r\n", start)
    if end < 0 or not data.startswith(b"WARC/1.", start):
        return None
    fields = {}
    for line in data[start:end].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            return None
        fields[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    return fields, end + 4


def _agrees(said: str, data: bytes) -> bool | None:
    """Whether a labelled digest (hex, base32 or base64) is that of ``data``; None where its algorithm is not known."""
    name, colon, value = said.partition(":")
    name = name.strip().lower().replace("-", "")
    if not colon or name not in DIGESTS:
        return None
    digest, value = hashlib.new(name, data).digest(), value.strip().rstrip("=")
    short = base64.b32encode(digest).decode().rstrip("=")
    return value.lower() == digest.hex() or value.upper() == short or value in (base64.b64encode(digest).decode().rstrip("="), base64.urlsafe_b64encode(digest).decode().rstrip("="))


def _plain_digest(said: str) -> str | None:
    """A SHA-1 as base32 without the algorithm's name, any other digest as it stands."""
    name, colon, value = said.partition(":")
    if not colon or name.strip().lower().replace("-", "") != "sha1":
        return said or None
    value = value.strip()
    if len(value) == 40:
        try:
            return base64.b32encode(bytes.fromhex(value)).decode()
        except ValueError:
            return value
    return value or None


def _parsed(data: bytes, start: int) -> tuple[dict, int, bool] | str:
    """The record at ``start``, the offset after it, and whether a digest vouches for it; or why there is none."""
    head = _headers(data, start)
    if head is None:
        return "no header"
    fields, body = head
    length = fields.get("content-length", "")
    if not length.isascii() or not length.isdigit():
        return "no length"
    stop = body + int(length)
    if data[stop : stop + 4] != b"\r\n\r\n":
        return "no record end"
    block = data[body:stop]
    whole = _agrees(fields.get("warc-block-digest", ""), block)
    if whole is False:
        return "block digest"
    kind = fields.get("warc-type", "")
    http, payload = b"", block
    if fields.get("content-type", "").split(";")[0].strip().lower() == "application/http":
        http, _, payload = block.partition(b"\r\n\r\n")
    said = fields.get("warc-payload-digest", "")
    digest, size, inner = _plain_digest(said), len(payload), None
    if kind == "revisit":
        payload = None
        sizes = [x.split(b":", 1)[1].strip() for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]
        size = int(sizes[0]) if sizes and sizes[0].isdigit() else None
    elif digest is None:
        digest = base32_sha1(payload)
    elif "warc-segment-number" not in fields:  # the digest of a segment is that of all segments together
        inner = _agrees(said, payload)
        if inner is False:
            return "payload digest"
    record = {
        "record_id": fields.get("warc-record-id", "").strip("<>"), "record_type": kind, "target_uri": fields.get("warc-target-uri"),
        "refers_to": fields["warc-refers-to"].strip("<>") if "warc-refers-to" in fields else None,
        "payload_digest": digest, "payload_bytes": size, "payload": payload,
    }
    return record, stop + 4, bool(whole or inner)


def parse_record(data: bytes, start: int = 0) -> tuple[dict, int] | str:
    """The record at ``start`` and the offset after it, or why there is none.

    The payload is the block, without its HTTP head where the content type is ``application/http``. Digests of
    algorithms that are not known are returned and not checked.
    """
    part = _parsed(data, start)
    return part if isinstance(part, str) else part[:2]


def _member(data: bytes, start: int) -> tuple[bytes, int, str | None, bool]:
    """What the gzip member at ``start`` inflates to, the offset after it, why it is not whole (CRC, length), and whether it breaks off in its text."""
    view, z, out, at = memoryview(data), zlib.decompressobj(31), [], start
    try:
        while not z.eof:
            if at >= len(data):
                text = b"".join(out)
                return text, at, "cut short", not _ended(z, text)
            out.append(z.decompress(view[at : at + 65536]))
            at = min(len(data), at + 65536)
    except zlib.error:
        text, stop = _inflated(view, start, at)
        return text, stop, "bad member", False
    return b"".join(out), at - len(z.unused_data), None, False


def _ended(z, text: bytes) -> bool:
    """Whether only the CRC and length, or the rest of them, are missing after ``text``."""
    trailer = zlib.crc32(text).to_bytes(4, "little") + (len(text) & 0xFFFFFFFF).to_bytes(4, "little")
    for have in range(8):
        ahead = z.copy()
        try:
            ahead.decompress(trailer[have:])
        except zlib.error:
            continue
        if ahead.eof:
            return True
    return False


def _inflated(view: memoryview, start: int, at: int) -> tuple[bytes, int]:
    """All that inflates from ``start`` until zlib finds a fault, which it does not before ``at``; and where that is."""
    z = zlib.decompressobj(31)
    out = [z.decompress(view[start:at])]
    for step in (4096, 256, 16, 1):
        while True:
            ahead = z.copy()
            try:
                out.append(ahead.decompress(view[at : at + step]))
            except zlib.error:
                break
            z, at = ahead, at + step
    try:
        tail = bytes(view[at : at + 1])
        while piece := z.decompress(tail, 1):
            out.append(piece)
            tail = z.unconsumed_tail
    except zlib.error:
        pass
    return b"".join(out), min(at + 1, len(view))


def _inner(text: bytes, why: str | None, broken: bool) -> tuple[list[dict], list[str]]:
    """The records of an inflated text, sought again from version lines after a fault, and the reason of each gap.

    ``why`` tells that the member itself is damaged: its records that no digest vouches for carry that as ``reason``.
    In a text that is ``broken`` off, the record at the break is not taken for whole.
    """
    found: list[dict] = []
    faults: list[str] = []
    at, whole = 0, True
    while at < len(text):
        part = _parsed(text, at)
        if broken and not isinstance(part, str) and part[1] == len(text):
            part = why
        if isinstance(part, str):
            if whole:
                faults.append(part)
            whole = False
            at = text.find(b"WARC/1.", at + 1)
            if at < 0:
                break
            continue
        record, at, vouched = part
        found.append(record if vouched or why is None else record | {"reason": why})
        whole = True
    return found, faults


def salvage(data: bytes) -> Iterator[dict]:
    """Records and gaps of one archive in order of their place.

    Where a check fails, the reader looks for the next byte that starts a gzip member or a version line, tries there,
    and goes on until one is whole; the bytes in between are one gap with the first reason. NULs after a member are
    padding. Gaps and records together cover all other bytes.

    A member may hold several records. If one of them fails a check, the others are kept, and each run of text that is
    lost is a gap over the bytes of the member. Of a damaged member the records that inflate are kept and its bytes
    are a gap as well; where no digest vouches for such a record, it carries the damage as ``reason``. The record at
    which a cut member breaks off is not kept. What follows a fault in a deflate stream can only be had where zlib
    still inflates it.
    """
    at, lost, why = 0, None, None
    told, until = set(), 0
    name = lambda r: (r["record_id"], r["record_type"], r["payload_digest"])
    while at < len(data):
        if lost is None and data[at] == 0:
            at += 1
            continue
        found: list[dict] = []
        faults: list[str] = []
        damage, stop = None, at
        if data.startswith(b"\x1f\x8b\x08", at):
            text, stop, damage, broken = _member(data, at)
            found, faults = _inner(text, damage, broken)
            reason = damage or (faults or ["empty member"])[0]
        else:
            part = _parsed(data, at)
            if isinstance(part, str):
                reason = damage = part
            else:
                found, stop = [part[0]], part[1]
                if at < until and name(part[0]) in told:  # stored as it is inside the damaged member that gave it
                    at = stop
                    continue
        if found:
            if lost is not None:
                yield {"kind": "gap", "start": lost, "stop": at, "reason": why}
                lost = None
            for record in found:
                yield record | {"kind": "record", "start": at, "stop": stop}
            if damage is None:
                for fault in faults:
                    yield {"kind": "gap", "start": at, "stop": stop, "reason": fault}
            else:
                told, until = told | set(map(name, found)) if at < until else set(map(name, found)), max(until, stop)
        if damage is None and found:
            at = stop
            continue
        if lost is None:
            lost, why = at, reason
        if damage is None:
            at = stop
            continue
        nexts = [x for x in (data.find(b"\x1f\x8b\x08", at + 1), data.find(b"WARC/1.", at + 1)) if x > at]
        at = min(nexts, default=len(data))
    if lost is not None:
        yield {"kind": "gap", "start": lost, "stop": len(data), "reason": why}


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records (``kind = 'record'``) and quarantined byte ranges (``kind = 'gap'``) of all archives below ``path``.

    Files are read by Spark, one row each; every record of a file is checked (gzip CRC, lengths, record end, block and
    payload digest) and what fails becomes a gap with ``start``, ``stop`` and ``reason``, see :func:`salvage`.
    """
    names = [x.split()[0] for x in SCHEMA.replace("\n", " ").split(",")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1), strict=True):
                rows: list[dict] = []
                size = 0
                for row in salvage(content.as_py()):
                    rows.append(row | {"archive": name.as_py()})
                    size += len(row.get("payload") or b"") + 200
                    if size >= 8 * CHUNK:
                        yield pa.RecordBatch.from_pylist([{k: r.get(k) for k in names} for r in rows], schema)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist([{k: r.get(k) for k in names} for r in rows], schema)

    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    schema = pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in SCHEMA.replace("\n", " ").split(",")])
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(frugal(read), SCHEMA)
