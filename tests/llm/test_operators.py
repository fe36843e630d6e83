"""Operators on small tables with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import random
import re
import zlib
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rostrum.llm import chat, edits, exact, langid, mixing, nearminhash, packing, repeats, suffixes, vectors, warc
from rostrum.llm.queries import TOOLS, word_tokenizer
from rostrum.llm.shingles import shingle_sets

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _id long, _sha string, id long, n long, size long, score double, block int"
WORD = re.compile("[^\x20\x09-\x0d]+")


def words(rng, n, pool=400):
    return " ".join(f"w{rng.randrange(pool)}" for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    """(doc_id, text, lang, source) with the odd cases first."""
    rng = random.Random(5)
    base = words(rng, 120, 4000)
    near = base.split()
    near[7] = "other"
    passage = words(rng, 60, 4000)
    long = words(rng, 30_000, 9000)
    rows = [
        (None, "an id is missing here", "en", "a"), (1, None, "en", "a"), (2, "", "de", None), (3, " \t\n", None, "b"), (4, base, "en", "a"), (5, base, "en", "a"),
        (5, base, "en", "a"), (6, " ".join(near), "en", "b"), (7, base.replace(" ", "  "), "fr", "b"), (8, long, "en", "c"), (9, long + " tail", "en", "c"),
        (10, "one two", "en", None), (11, "One TWO", "en", None), (12, "12 34 .. !", None, "b"), (13, words(rng, 30) + " " + passage, "de", "a"),
        (14, passage + " " + words(rng, 40), "de", "a"), (None, None, None, None), (15, "ééé ünï ñandú çà", "fr", "c"),
    ]
    rows += [(100 + i, words(rng, rng.randrange(1, 90)), rng.choice(["en", "de", "fr", "es"]), rng.choice("abc")) for i in range(60)]
    return rows


@pytest.fixture(scope="module")
def docs(spark, texts):
    more = (9, "x", 8, 7, 6, 0.5, 4)
    return spark.createDataFrame([(d, t, lang, s, len(t or ""), *more) for d, t, lang, s in texts], SCHEMA).repartition(3).checkpoint()


@pytest.fixture(scope="module")
def none(docs):
    return docs.filter("doc_id > 1000000")


def test_exact_groups(docs, texts, none):
    got = exact.exact_groups(docs).collect()
    assert len(got) == len(texts) and exact.exact_groups(none).count() == 0
    norm = {}
    for d, t, *_ in texts:
        norm.setdefault(re.sub("[\x20\x09-\x0d]", "", t or ""), []).append((-len(t or ""), d if d is not None else 1 << 62, d))
    by_sha = {hashlib.sha256(k.encode()).hexdigest(): (len(v), min(v)[2]) for k, v in norm.items()}
    assert all((r.group_size, r.keep_id) == by_sha[r.text_sha256] for r in got)
    assert sum(r.kept for r in got) == len(norm)
    rows = exact.exact_rows(docs)
    assert rows.columns == docs.columns and rows.count() == len(norm)
    assert exact.exact_rows(none).count() == 0


def test_mixing(docs, texts, none):
    got = mixing.mix(docs).collect()
    assert len(got) == len(texts) and mixing.mix(none).count() == 0
    total = sum(r["size"] for r in got)
    by = {}
    source = {(d, len(WORD.findall(t or ""))): s for d, t, _, s in texts}
    for r in got:
        assert r.taken == r.repeats * r["size"] <= 2 * r["size"]
        by.setdefault(source[r.doc_id, r["size"]], []).append(r)
    assert abs(sum(rows[0].target for rows in by.values()) - 1.5 * total) < 1e-6
    for rows in by.values():
        assert rows[0].target <= 2 * rows[0].source_size
        assert abs(sum(r.taken for r in rows) - rows[0].target) <= max(r["size"] for r in rows) / 2
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, mixing.mix(docs.repartition(2)).collect()), key=repr)


def brute_components(ids, linked):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def shingles(text):
    found = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(found[i : i + 5]) for i in range(len(found) - 4)} if len(found) >= 5 else ({tuple(found)} if found else set())


def test_near_groups(docs, texts, none):
    got = nearminhash.near_groups(docs, percent=85).collect()
    assert len(got) == len(texts) and nearminhash.near_groups(none).count() == 0
    sets = {d: shingles(t) for d, t, *_ in texts if d is not None}
    links = [(a, b) for a, b in combinations(sets, 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    want = brute_components(sets, links)
    for r in got:
        if r.doc_id is not None:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), want[r.doc_id], want[r.doc_id] == r.doc_id)
        else:
            assert r.component_id is None and r.kept


@pytest.mark.parametrize("percent", [80, 85])
def test_near_groups_tell_rows_apart_by_text(spark, percent, monkeypatch):
    """Rows that share an id but not a text: each is judged by its own text, and of a component one row stays."""
    monkeypatch.setattr(nearminhash, "BLOCK", 3)
    rng = random.Random(21)
    base = [words(rng, 80, 3000) for _ in range(4)]
    rows = [(1, base[0]), (2, base[0] + " more"), (2, base[1]), (3, base[2]), (3, base[2] + " tail"), (3, base[2] + " other"), (4, base[1] + " end"), (7, base[3]), (7, base[3]), (None, base[0]), (5, "")]
    rows += [(10 + i % 20, " ".join(w if rng.random() > 0.02 else "x" for w in base[i % 4].split())) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = nearminhash.near_groups(df, percent=percent).join(df.withColumn("text_hash", F.xxhash64("text")).distinct().withColumnRenamed("doc_id", "id"), "text_hash").filter("doc_id <=> id").collect()
    distinct = sorted({r for r in rows if r[0] is not None and r[1]}, key=repr)
    sets = [shingles(t) for _, t in distinct]
    links = [(i, j) for i, j in combinations(range(len(sets)), 2) if 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    component = brute_components(range(len(sets)), links)
    least = {c: min(d for (d, _), i in zip(distinct, range(len(sets)), strict=True) if component[i] == c) for c in set(component.values())}
    want = {row: least[component[i]] for i, row in enumerate(distinct)}
    assert len(got) == len(rows)
    survivors = {}
    for r in got:
        if r.doc_id is not None and r.text:
            assert r.component_id == want[r.doc_id, r.text]
            if r.kept:
                survivors.setdefault(component[distinct.index((r.doc_id, r.text))], set()).add((r.doc_id, r.text))
                assert r.doc_id == r.component_id
        else:
            assert r.kept and r.component_id == r.doc_id
    assert {c: len(v) for c, v in survivors.items()} == dict.fromkeys(least, 1)


def test_sieve_keeps_all_that_is_wanted(spark):
    from rostrum.llm.common import sifted

    df = spark.range(20_000).select((F.col("id") * 7919 - 50_000_000).alias("id"), F.col("id").alias("_bits"))
    wanted = df.filter("_bits % 100 = 3").select("id")
    got = sifted(df, ["id"], wanted)
    assert got.columns == df.columns and got.join(wanted, "id").count() == 200 and got.count() < 260
    assert sifted(df, ["id"], wanted.limit(0)).count() == 0


def test_shingle_sets_do_not_depend_on_the_batch(texts):
    column = pa.array([t for _, t, *_ in texts])
    whole = list(shingle_sets(column))
    alone = [next(shingle_sets(pa.array([t], pa.string()))) for _, t, *_ in texts]
    assert all((a == b).all() for a, b in zip(whole, alone, strict=True))
    assert [len(x) for x in whole] == [len(shingles(t)) for _, t, *_ in texts]


def test_near_copies_of_one_text_in_many_blocks(spark, monkeypatch):
    """Edited copies whose similarity lies on both sides of the threshold, in lists longer than a block."""
    monkeypatch.setattr(nearminhash, "BLOCK", 8)
    rng = random.Random(2)
    base = words(rng, 100, 9000).split()
    rows = []
    for i in range(60):
        copy = list(base)
        for _ in range(rng.randrange(0, 5)):
            copy[rng.randrange(100)] = f"x{rng.randrange(9000)}"
        rows.append((i, " ".join(copy)))
    got = {r.doc_id: r.component_id for r in nearminhash.near_groups(spark.createDataFrame(rows, "doc_id long, text string"), percent=85).collect()}
    sets = {d: shingles(t) for d, t in rows}
    links = [(a, b) for a, b in combinations(sets, 2) if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    assert got == brute_components(sets, links)


def test_segments_without_a_common_context_need_no_suffix_array():
    """Of segments of one family only those stay that another id's segment may share a string with."""
    rng = random.Random(3)
    text = lambda n: bytes(rng.randrange(65, 91) for _ in range(n))
    anchor, left, right = text(24), text(26), text(26)
    data = [
        (1, 26, left + anchor + right), (2, 26, text(13) + left[13:] + anchor + text(26)), (3, 0, anchor + right), (3, 26, text(26) + anchor + text(26)),
        (4, 26, text(14) + left[14:] + anchor + right[:12] + text(14)), (5, 13, text(13) + anchor + text(13)), (5, 13, text(13) + anchor + text(13)),
    ]
    data += [(6, 0, b"x" * 50), (6, 0, b"x" * 50)]
    table = pa.table({"id": [d[0] for d in data], "anchor": [d[1] for d in data], "text": pa.array([d[2] for d in data], pa.binary())})
    family = np.array([0] * 7 + [1] * 2)
    assert repeats.may_repeat(table, family).tolist() == [True, True, True, False, False, False, False, False, False]
    assert repeats.may_repeat(table.slice(1, 3), family[1:4]).tolist() == [False] * 3


def brute_repeats(rows):
    order = sorted(((1 << 63) - 1 if d is None else d, (t or "").encode()) for d, t, *_ in rows)
    first, out = {}, []
    for d, b in order:
        for j in range(len(b) - 49):
            first.setdefault(b[j : j + 50], d)
    for d, b in order:
        cover = bytearray(len(b))
        for j in range(len(b) - 49):
            if first[b[j : j + 50]] < d:
                cover[j : j + 50] = b"\1" * 50
        kept = bytes(c for c, gone in zip(b, cover) if not gone)
        runs = sum(1 for j in range(len(b)) if cover[j] and (j == 0 or not cover[j - 1]))
        out.append((None if d == (1 << 63) - 1 else d, len(b), len(b) - len(kept), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("hot", "block", "shard"), [(2048, 4 << 20, 1 << 20), (2, 3000, 500)])
def test_without_repeats(docs, texts, none, monkeypatch, hot, block, shard):
    for name, value in (("HOT", hot), ("BLOCK", block), ("SHARD", shard)):
        monkeypatch.setattr(repeats, name, value)
    got = sorted((tuple(r) for r in repeats.without_repeats(docs).collect()), key=repr)
    assert got == brute_repeats(texts)
    assert repeats.without_repeats(none).count() == 0


def test_suffix_array_and_prefixes():
    rng = np.random.default_rng(1)
    for _ in range(150):
        t = np.append(rng.integers(1, rng.integers(2, 6), rng.integers(0, 60)), 0)
        plain = t.tolist()
        want = sorted(range(len(plain)), key=lambda i: plain[i:])
        for wide in (1024, 0):
            suffixes.WIDE, saved = wide, suffixes.WIDE
            assert suffixes.suffix_array(t).tolist() == want
            suffixes.WIDE = saved
        prefixes = suffixes.permuted_prefixes(t, np.array(want))
        for i, j in zip(want[1:], want[:-1], strict=True):
            same = next((k for k, (x, y) in enumerate(zip(plain[i:], plain[j:], strict=False)) if x != y), min(len(plain) - i, len(plain) - j))
            assert prefixes[i] == same


def test_vectors(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(8, 16))
    rows = [(i, [float(x) for x in centres[i % 8] + rng.normal(size=16) * rng.choice([0.02, 0.3])], int(i % 3 > 0)) for i in range(150)]
    rows += [(200, rows[3][1], rows[3][2]), (201, rows[3][1], rows[3][2]), (201, rows[3][1], rows[3][2]), (202, rows[3][1], None), (203, None, 1), (204, [0.0] * 16, 1),
             (205, [float("nan")] * 16, 1), (206, [], 1), (207, [1.0] * 5, 1), (208, [1.0] * 5, 1), (209, [None] + [1.0] * 15, 1), (None, rows[3][1], rows[3][2])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    df = df.withColumn("id", F.lit(1)).withColumn("vec", F.lit("x"))
    got = vectors.near_vectors(df).collect()
    assert len(got) == len(rows) and vectors.near_vectors(df.filter("vec_id < 0")).count() == 0
    good = [(d, np.array(v, float), k) for d, v, k in rows if d is not None and v and k is not None and None not in v and np.isfinite(v).all() and np.any(v)]
    cos = lambda a, b: a @ b / np.sqrt((a @ a) * (b @ b))
    links = [(i, j) for i, j in combinations(range(len(good)), 2) if good[i][2] == good[j][2] and len(good[i][1]) == len(good[j][1]) and cos(good[i][1], good[j][1]) >= 0.93]
    counts = {}
    for i, j in links:
        counts[i] = counts.get(i, 0) + 1
        counts[j] = counts.get(j, 0) + 1
    want = brute_components({d for d, *_ in good}, [(good[i][0], good[j][0]) for i, j in links])
    number = {d: counts.get(i, 0) for i, (d, *_) in enumerate(good)}
    found = sum(min(r.n_links, number.get(r.vec_id, 0)) for r in got)
    assert all(r.n_links <= number.get(r.vec_id, 0) for r in got) and found >= 0.9 * sum(counts.values())
    assert all(r.component_id == want.get(r.vec_id, r.vec_id) for r in got)
    assert all(r.kept == (r.vec_id is None or r.component_id == r.vec_id) for r in got)


@pytest.mark.parametrize("rank", [4, 8, 64])
def test_vectors_of_any_rank_count_links_from_both_ends(spark, rank):
    rng = np.random.default_rng(rank)
    flat = rng.normal(size=(11_000 if rank < 64 else 3_700, rank)) @ np.linalg.qr(rng.normal(size=(64, rank)))[0].T
    flat = flat if rank < 64 else np.concatenate([flat + rng.normal(size=flat.shape) * 0.25 for _ in range(3)])
    flat /= np.linalg.norm(flat, axis=1)[:, None]
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(flat)], "vec_id long, embedding array<double>, label int")
    assert len(flat) // vectors.LIST >= 20
    got = {r.vec_id: r.n_links for r in vectors.near_vectors(df).collect()}
    want = np.concatenate([(flat[i : i + 500] @ flat.T >= 0.93).sum(axis=1) - 1 for i in range(0, len(flat), 500)])
    have = np.array([got[i] for i in range(len(flat))])
    assert (have <= want).all() and have.sum() >= 0.99 * want.sum() > 1000


def test_quantizer_loses_no_pair_within_a_list():
    rng = np.random.default_rng(7)
    x = rng.normal(size=(300, 12))
    x /= np.linalg.norm(x, axis=1)[:, None]
    q = vectors.fit(x, 300)
    residual = x - q.centres[0]
    code, error = q.codes(residual)
    looked = np.sqrt(sum(t[:, code[:, m]] for m, t in enumerate(q.tables(residual))))
    assert (np.abs(looked - np.sqrt(vectors.squared(x, x))) <= error[None, :] + 1e-6).all()


def test_warc_round_trip_and_salvage(spark, tmp_path):
    rows = [(3, "http://a/", "<p>é</p>"), (1, None, "<p>é</p>"), (2, "http://b/\n", ""), (4, "u", None), (5, "u", "x" * 300_000), (6, "u", "WARC/1.1\r\n\r\n"), (7, "u", "<p>é</p>"), (None, "u", "lone")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("_sha", F.lit(1)).withColumn("record_type", F.lit("mine"))
    for compress in (True, False):
        path = f"file://{tmp_path}/{compress}"
        warc.write_warc(pages.drop("record_type"), path, compress=compress)
        got = {r.record_id: r for r in warc.read_warc(spark, path).collect()}
        assert all(r.kind == "record" for r in got.values()) and len(got) == len(rows)
        assert got["urn:page:1"].record_type == "response" and bytes(got["urn:page:1"].payload) == "<p>é</p>".encode()
        for i in (3, 7):
            assert (got[f"urn:page:{i}"].record_type, got[f"urn:page:{i}"].refers_to, got[f"urn:page:{i}"].payload_bytes) == ("revisit", "urn:page:1", 9)
        assert got["urn:page:4"].record_type == "revisit" and got["urn:page:2"].payload_digest == "3I42H3S6NNFQ2MSVX7XZKYAYSCX5QBYJ"
    warc.write_warc(pages.filter("page_id > 100"), f"file://{tmp_path}/none")
    assert warc.read_warc(spark, f"file://{tmp_path}/none").count() == 0


@pytest.mark.parametrize("compress", [True, False])
def test_salvage_goes_on_after_damage(compress):
    def member(i):
        data = warc.record_bytes(f"urn:page:{i}", "response", "u", None, b"payload %d" % i * 50, "1970-01-01T00:00:00Z")
        z = zlib.compressobj(6, zlib.DEFLATED, 31)
        return z.compress(data) + z.flush() if compress else data

    parts = [member(i) for i in range(5)]
    broken = bytearray(parts[2])
    broken[len(broken) // 2] ^= 255
    data = b"junk" + parts[0] + parts[1] + bytes(broken) + parts[3] + b"\0\0" + parts[4][:-9]
    out = list(warc.salvage(data))
    assert [r["record_id"] for r in out if r["kind"] == "record"] == ["urn:page:0", "urn:page:1", "urn:page:3"]
    gaps = [(r["start"], r["stop"]) for r in out if r["kind"] == "gap"]
    two = 4 + len(parts[0]) + len(parts[1])
    assert gaps == [(0, 4), (two, two + len(broken)), (two + len(broken) + len(parts[3]) + 2, len(data))]


def squeezed(data):
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def plain_record(name, kind, block, *lines):
    head = ["WARC/1.0", f"WARC-Type: {kind}", f"WARC-Record-ID: <{name}>", *lines, f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


@pytest.mark.parametrize("bad", [0, 2, 4])
def test_salvage_keeps_the_other_records_of_a_member(bad):
    parts = [warc.record_bytes(f"urn:page:{i}", "response", "u", None, b"payload %d" % i * 50, "1970-01-01T00:00:00Z") for i in range(5)]
    good, other = squeezed(parts[0]), parts[bad].replace(b"payload", b"pAyload", 1)
    member = squeezed(b"".join(parts[:bad] + [other] + parts[bad + 1 :]))
    out = list(warc.salvage(member + good))
    kept = [r["record_id"] for r in out if r["kind"] == "record"]
    assert kept == [f"urn:page:{i}" for i in range(5) if i != bad] + ["urn:page:0"]
    assert [(r["start"], r["stop"], r["reason"]) for r in out if r["kind"] == "gap"] == [(0, len(member), "block digest")]


@pytest.mark.parametrize("level", [6, 0])
@pytest.mark.parametrize("share", [0.02, 0.5, 0.98, "cut", "crc"])
def test_salvage_reads_a_damaged_member_as_far_as_it_inflates(share, level):
    rng = random.Random(9)
    parts = [warc.record_bytes(f"urn:page:{i}", "response", "u", None, rng.randbytes(9000), "1970-01-01T00:00:00Z") for i in range(20)]
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    member = bytearray(z.compress(b"".join(parts)) + z.flush())
    if share == "cut":
        del member[len(member) // 2 :]
    else:
        member[-6 if share == "crc" else int(len(member) * share)] ^= 255
    tail = squeezed(parts[0].replace(b"urn:page:0", b"urn:page:x"))
    out = list(warc.salvage(bytes(member) + tail))
    kept = [r["record_id"] for r in out if r["kind"] == "record"]
    assert kept[-1] == "urn:page:x" and len(kept) == len(set(kept))
    least = {0.02: 0, 0.5: 9, 0.98: 19, "cut": 9, "crc": 20}[share]
    assert kept[:least] == [f"urn:page:{i}" for i in range(least)]
    assert [(r["start"], r["stop"]) for r in out if r["kind"] == "gap"][0][0] == 0


def test_records_without_a_digest_in_a_damaged_member_say_so():
    member = squeezed(plain_record("a", "resource", b"one") + plain_record("b", "resource", b"two"))
    assert [r.get("reason") for r in warc.salvage(member)] == [None, None]
    out = list(warc.salvage(member[:-4]))
    assert [(r["kind"], r.get("record_id"), r["reason"]) for r in out] == [("record", "a", "cut short"), ("record", "b", "cut short"), ("gap", None, "cut short")]


def test_payloads_of_all_record_types_and_digests():
    block = b"name: x\r\n\r\nbody"
    sha256, sha1 = hashlib.sha256(block).hexdigest(), hashlib.sha1(block).hexdigest()
    for kind in ("conversion", "metadata", "resource", "warcinfo"):
        for said in (f"sha256:{sha256}", f"SHA-256:{sha256.upper()}", "blake9:abc", f"sha1:{sha1}", f"sha1:{warc.base32_sha1(block)}"):
            record, _ = warc.parse_record(plain_record("a", kind, block, "Content-Type: text/plain", f"WARC-Payload-Digest: {said}", f"WARC-Block-Digest: {said}"))
            assert (record["payload"], record["payload_bytes"]) == (block, len(block))
            assert record["payload_digest"] == (warc.base32_sha1(block) if said.startswith("sha1") else said)
    http = b"HTTP/1.1 200 OK\r\n\r\nbody"
    assert warc.parse_record(plain_record("a", "response", http, "Content-Type: Application/HTTP;msgtype=response"))[0]["payload"] == b"body"
    for said in (f"sha256:{sha256[1:]}0", f"md5:{sha256}", f"sha1:{sha1[1:]}0"):
        assert warc.parse_record(plain_record("a", "resource", block, f"WARC-Payload-Digest: {said}")) == "payload digest"
        assert warc.parse_record(plain_record("a", "resource", block, f"WARC-Block-Digest: {said}")) == "block digest"


def test_edits_follow_a_full_count(monkeypatch):
    import public_tokenizers as P

    monkeypatch.setattr(edits, "LEAF", 4)
    counter = edits.piece_counter(str(P.path("byte_bpe_50k.tiktoken")), P.PATTERN)
    rng = random.Random(1)
    letters = "ab  \n'sé1 .,\t"
    for _ in range(300):
        text = "".join(rng.choice(letters) for _ in range(rng.randrange(120)))
        pieces = counter.pattern.findall(text)
        document = edits.Document(counter, text, *edits.leaves_of(pieces, [counter.count(p) for p in pieces]))
        for _ in range(4):
            start = rng.randrange(len(document.text) + 3)
            document.edit(start, start + rng.randrange(20), "".join(rng.choice(letters) for _ in range(rng.randrange(40))))
            assert document.total == len(counter.encoding.encode_ordinary(document.text)) and sum(document.leaves()[0]) == len(document.text)


def test_edits_of_odd_rows(docs, texts, none):
    import public_tokenizers as P

    ranks = str(P.path("byte_bpe_50k.tiktoken"))
    plan = F.when(F.col("doc_id") % 2 == 0, F.array(F.struct(F.lit(2).alias("start"), F.lit(None).cast("long").alias("stop"), F.lit(None).cast("string").alias("text")), F.lit(None).cast("struct<start:int,stop:bigint,text:string>")))
    got = edits.apply_edits(edits.build_trees(docs, ranks, P.PATTERN, edits=plan), ranks, P.PATTERN).collect()
    counter = edits.piece_counter(ranks, P.PATTERN)
    assert len(got) == len(texts) and all(r.tokens == len(counter.encoding.encode_ordinary(r.text)) for r in got)
    assert edits.build_trees(none, ranks, P.PATTERN).count() == 0


def test_tool_calls(spark):
    calls = [
        (1, "a", 5, "count", '{"query":"x","limit":3}', ["b"]), (1, "b", 6, "count", '{ "limit" : "3", "query":"y" }', None), (1, "c", 1, "lookup", '{"key":1}', ["d"]),
        (1, "d", 2, "lookup", '{"key":"k","exact":true}', ["c"]), (1, "e", 3, "other", "{}", ["gone"]), (1, "f", 4, "lookup", "not json", []), (1, "g", 7, None, None, None),
        (1, "b", 9, "count", "{}", None), (None, "z", 1, "count", "{}", None), (2, "a", 1, "lookup", '{"key":"k","a":{"z":1,"b":[2,{"y":0,"x":1}]}}', None), (2, "l", 9, "lookup", '{"key":"k"}', None),
    ]
    results = [(1, "a", 8, "fine"), (1, "a", 9, "again"), (2, "q", 3, None), (2, "l", 2, 'quo"te\n'), (2, None, 3, "x")]
    c = spark.createDataFrame(calls, "conv_id long, call_id string, position long, tool string, arguments string, depends_on array<string>").withColumn("_id", F.lit(1))
    r = spark.createDataFrame(results, "conv_id long, call_id string, position long, content string").withColumn("level", F.lit(1))
    got = {(x.conv_id, x.call_id): x for x in chat.link_calls(c, r, TOOLS).collect()}
    assert len(got) == 10
    assert got[1, "a"].status == "ok" and got[1, "a"].level == 1 and got[1, "a"].n_results == 2
    assert got[1, "b"].errors == ["limit: not integer"] and got[1, "b"].n_calls == 2 and got[1, "b"].ord < got[1, "a"].ord
    assert got[1, "c"].status == got[1, "d"].status == "cycle" and got[1, "c"].level is None
    assert got[1, "e"].errors == ["unknown tool"] and got[1, "f"].errors == ["malformed JSON"] and got[1, "g"].status == "invalid"
    assert got[2, "q"].status == "orphan" and got[2, "l"].status == "late"
    assert got[2, "a"].json == '{"arguments":{"a":{"b":[2,{"x":1,"y":0}],"z":1},"key":"k"},"call_id":"a","result":null,"status":"invalid","tool":"lookup"}'
    assert '"result":"quo\\"te\\n"' in got[2, "l"].json
    assert sorted(x.ord for k, x in got.items() if k[0] == 1) == list(range(1, 8))
    assert chat.link_calls(c.filter("conv_id > 9"), r.filter("conv_id > 9"), TOOLS).count() == 0


def test_packing(docs, texts, none):
    from tokenizers import Tokenizer

    got = packing.pack(docs, word_tokenizer()).collect()
    tokenizer = Tokenizer.from_file(word_tokenizer())
    want = sorted((d if d is not None else -1, n) for d, n in ((d, len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1) for d, t, *_ in texts))
    pieces, sequences = {}, {}
    for r in got:
        pieces.setdefault((-1 if r.doc_id is None else r.doc_id, r.doc_tokens), []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    assert sorted(k for k, rows in pieces.items() for _ in range(sum(p.length for p in rows) // k[1])) == want
    for rows in sequences.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= 2048 and at & (at - 1) == 0
    ids = np.array(tokenizer.encode(dict((d, t) for d, t, *_ in texts)[8], add_special_tokens=False).ids + [1], "<u4")
    for r in (r for r in got if r.doc_id == 8):
        assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
    for (name, size), rows in pieces.items():
        ends = sorted((r.start, r.start + r.length) for r in rows)
        copies = sum(r.length for r in rows) // size
        assert sum(1 for a, _ in ends if a == 0) == copies and sum(1 for _, b in ends if b == size) == copies, name
        assert sorted(a for a, _ in ends if a) == sorted(b for _, b in ends if b < size), name
    assert packing.pack(none, word_tokenizer()).count() == 0


def test_neighbours_are_the_unused_pieces_by_their_scores():
    rng = np.random.default_rng(2)
    pieces = [rng.zipf(1.3, rng.integers(1, 60)) % 500 for _ in range(400)]
    idf = rng.random(500).astype(np.float32)
    shard = packing.Shard(pieces, idf, 30.0)
    for _ in range(40):
        unused = np.flatnonzero(shard.unused)
        seed = int(rng.choice(unused))
        shard.unused[seed] = False
        score = {}
        for i in map(int, unused):
            both = set(pieces[seed].tolist()) & set(pieces[i].tolist()) if i != seed else ()
            count = {t: int((pieces[i] == t).sum()) for t in both}
            norm = packing.K1 * (1 - packing.B + packing.B * len(pieces[i]) / 30.0)
            if both:
                score[i] = sum(float(idf[t]) * n * (packing.K1 + 1) / (n + norm) for t, n in count.items())
        got = list(shard.neighbours(seed))
        assert sorted(got) == sorted(score) and all(score[a] >= score[b] - 1e-4 for a, b in zip(got, got[1:]))
        shard.unused[got[:6]] = False
    assert shard.indexed < 400


def test_word_ids_equal_the_tokenizer():
    from rostrum.llm.wordids import word_ids

    encoder = word_ids(word_tokenizer())
    rng = random.Random(3)
    pool = "aZé'’´̈́ßŉǅ<|endoftext|>12½²#.,ΣσςЖ가a̐ᄀ­ƺ҃Ⅷ٣\x1c\x85   "
    column = pa.array(["".join(rng.choice(pool) for _ in range(200)) for _ in range(100)] + [None, "", "it's <|endoftext|>x \x1c!"])
    want = [e.ids for e in encoder.tokenizer.encode_batch([t or "" for t in column.to_pylist()], add_special_tokens=False)]
    assert [x.tolist() for x in encoder.encode(column)] == want
    every = [chr(c) for a, b in ((0x21, 0x7F), (0xA0, 0x250), (0x300, 0x530), (0x1E00, 0x1F00)) for c in range(a, b)] + [" "] * 150 + ["'s", "İ.", "\x01"]
    column = pa.array(["".join(rng.choice(every) for _ in range(100)) for _ in range(2000)])
    want = [e.ids for e in encoder.tokenizer.encode_batch(column.to_pylist(), add_special_tokens=False)]
    assert [x.tolist() for x in encoder.encode(column)] == want


def test_language(spark, docs, texts, none):
    rng = random.Random(8)
    vocabulary = {"en": ["the", "thing", "house", "which"], "de": ["der", "schön", "haus", "über"], "fr": ["le", "maison", "très", "où"], "es": ["el", "niño", "casa", "qué"], "xx": ["zuk", "wok", "pix"]}
    rows = [(i, " ".join(rng.choice(vocabulary[lang]) for _ in range(12)), lang) for i, lang in enumerate(list(vocabulary) * 40)]
    df = spark.createDataFrame([*rows, (900, None, "en"), (901, "12 .. !", "de"), (None, "the house", None)], "doc_id long, text string, lang string").withColumn("score", F.lit("mine"))
    model = langid.fit(df)
    got = langid.identify(df, model).collect()
    right = [r.lang_pred == r.lang for r in got if r.held_out and r.doc_id < 900]
    assert sum(right) >= 0.97 * len(right) > 0 and all(0 <= r.score <= 1 for r in got)
    assert {r.doc_id: r.lang_pred for r in got}[900] == {r.doc_id: r.lang_pred for r in got}[901] == "und"
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert langid.fit(none) is None and langid.identify(none, None).count() == 0
    assert {r.lang_pred for r in langid.identify(docs, None).collect()} == {"und"}
    assert langid.identify(docs, langid.fit(docs)).count() == len(texts)
