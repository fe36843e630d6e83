"""Token ids through shared chunks, spelling variants and source audits against brute-force versions."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rostrum.llm import chunkids, divergence, queries, variants
from rostrum.llm.queries import dropped_letter, word_tokenizer

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, ids string, block long, part string, n long, word string, term string, key int, kind int"
MORE = (9, 8, "ids", 7, "part", 6, "word", "term", 5, 4)


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


@pytest.fixture(scope="module")
def texts():
    """(doc_id, text, lang, source) with null, empty, long, repeated and odd rows."""
    rng = random.Random(11)
    stems = ["".join(rng.choice("abcdeé") for _ in range(rng.randrange(5, 9))) for _ in range(60)]
    word = lambda: rng.choice(stems[: rng.randrange(1, 60)])
    slip = lambda w: w if rng.random() > 0.2 else w[: (k := rng.randrange(len(w)))] + rng.choice(["", "x", w[k] + "q"]) + w[k + 1 :]
    some = lambda n: " ".join(slip(word()) + rng.choice(["", "", ",", ".", "'s", "-" + word()]) for _ in range(n))
    passage = some(400)
    long = some(30_000)
    rows = [
        (None, "no id here " + passage, "en", "a"), (None, None, None, None), (1, None, "en", "a"), (2, "", "de", None), (3, " \t\n\x0b", None, "b"), (4, passage, "en", "a"), (4, passage, "en", "a"),
        (5, "x " + passage + " y", "en", "b"), (6, passage.upper(), "de", "b"), (7, long, "en", "c"), (8, long[1000:], "fr", "c"), (9, "a" * 30_000, "fr", "a"), (10, "é" * 9_001 + " " + "日本" * 3000, "fr", "b"),
        (11, "it's <|endoftext|> and a<|startoftext|>b " + "é" * 700 + "́ ́\ń \x1c x\x1dy\x85z w  v ΑΣ ß İ ①½ 12345", "es", "a"), (12, "12 34 .. !\x00 \x7f×÷ÀÿŸ", "", ""), (13, "\n", "en", "d"),
        (14, "\r\n".join(some(5) for _ in range(200)), "en", "a"),
    ]
    return rows + [(100 + i, some(rng.randrange(1, 200)), rng.choice(["en", "en", "de", "fr", None]), rng.choice("abc")) for i in range(90)]


@pytest.fixture(scope="module")
def docs(spark, texts, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "t")
    spark.createDataFrame([(*r, *MORE) for r in texts], SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def none(docs):
    return docs.filter("doc_id > 1000000")


@pytest.fixture(params=["small", "as it is"])
def sizes(request, monkeypatch):
    """Blocks, parts and chunks so small that all of them occur many times, and the usual ones."""
    if request.param == "small":
        for module in (chunkids, divergence):
            monkeypatch.setattr(module, "BLOCK", 3000)
            monkeypatch.setattr(module, "PART", 20_000)
        monkeypatch.setattr(chunkids, "MEAN", 32)
        monkeypatch.setattr(chunkids, "LONGEST", 100)
        monkeypatch.setattr(chunkids, "CALL", 500)
        monkeypatch.setattr(chunkids, "SENT", 50)
        monkeypatch.setattr(variants, "BLOCK", 3)


def test_ids_equal_the_tokenizer(docs, texts, none, sizes):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(word_tokenizer())
    rows = chunkids.encode(docs, word_tokenizer())
    assert rows.columns == ["doc_id", "ids"]
    got = rows.withColumn("text", chunkids.decode(F.col("ids"), word_tokenizer())).collect()
    both = chunkids.encode(docs, word_tokenizer(), decoded=True)
    assert both.columns == ["doc_id", "ids", "decoded"] and sorted(map(tuple, both.collect()), key=repr) == sorted(map(tuple, got), key=repr)
    want = [(d, tokenizer.encode(t or "", add_special_tokens=False).ids) for d, t, *_ in texts]
    assert sorted(((r.doc_id, list(r.ids)) for r in got), key=repr) == sorted(want, key=repr)
    assert all(r.text == tokenizer.decode(list(r.ids), skip_special_tokens=False) for r in got)
    assert chunkids.encode(none, word_tokenizer()).count() == 0


def test_decode_of_null_and_of_a_byte_tokenizer(spark):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    path = str(P.path("byte_bpe_50k.json"))
    tokenizer = Tokenizer.from_file(path)
    said = ["two  words\né", "", "<|endoftext|> x"]
    rows = [(i, tokenizer.encode(t).ids) for i, t in enumerate(said)] + [(3, None)]
    got = spark.createDataFrame(rows, "i int, ids array<int>").select("i", chunkids.decode(F.col("ids"), path).alias("t")).collect()
    assert {r.i: r.t for r in got} == {0: said[0], 1: said[1], 2: said[2], 3: None}
    odd = spark.createDataFrame([(None,), ([],)], "ids array<int>").select(chunkids.decode(F.col("ids"), word_tokenizer()).alias("t")).collect()
    assert sorted((r.t for r in odd), key=repr) == ["", None]


def test_chunks_move_with_the_text():
    """What is put before a passage changes its first cuts only; cuts keep off characters and no run goes without."""
    rng = random.Random(4)
    passage = "".join(rng.choice("abcd efé日") for _ in range(20_000)).encode()
    cuts_of = lambda raw: chunkids.cut_places(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    plain, moved = cuts_of(passage), cuts_of(b"another start " + passage)
    assert len(plain) > 10 and set(plain[3:]) <= {c - 14 for c in moved}
    for raw in (passage, "é".encode() * 40_000, b"a" * 20_000, b"ab", b""):
        cuts = cuts_of(raw)
        assert all(c == len(raw) or raw[c] & 0xC0 != 0x80 for c in cuts) and max(np.diff(cuts), default=0) <= chunkids.LONGEST + 3


def test_op11_on_the_given_documents(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(word_tokenizer())
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = {}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        ids = tokenizer.encode(r.text or "", add_special_tokens=False).ids
        want[r.doc_id] = (len(ids), sha(" ".join(map(str, ids))), sha(tokenizer.decode(ids, skip_special_tokens=False)))
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.op11_bpe_chunks(spark, SF).collect()}
    assert got == want


def brute_words(rows, least_length=6, least_count=5):
    n = Counter()
    for d, t, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = lower(run)
            h = zlib.crc32(f"{'' if d is None else d}:{w}".encode())
            n[w if h % 199 else w[: h % len(w)] + w[h % len(w) + 1 :]] += 1
    return {w: c for w, c in n.items() if len(w) >= least_length and c >= least_count}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_groups(words, ratio=5):
    near = {w: [x for x in words if one_edit(w, x)] for w in words}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= ratio * words[w] else None
    out = []
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, words[w], len(near[w]), words.get(form[w])))
    return sorted(out, key=repr)


def test_variants_of_odd_rows(docs, texts, none, sizes):
    words = variants.word_counts(docs, respell=dropped_letter)
    want = brute_words(texts)
    assert {r.word: r.n for r in words.collect()} == want and len(want) > 30
    got = sorted((tuple(r) for r in variants.variant_groups(words).collect()), key=repr)
    assert got == brute_groups(want)
    assert sum(r[1] is not None for r in got) > 5
    assert variants.variant_groups(variants.word_counts(none)).count() == 0


def test_variants_follow_long_chains(spark):
    """Each step is five times as frequent as the one before; ties go to the smaller word."""
    words = {"aaaaaaaaaaaa"[: 12 - i] + "b" * i: 5 ** (i + 1) for i in range(9)} | {"bbaaaaaaaaaa": 5, "zzzzzz": 7, "zzzzzy": 35, "zzzzzx": 35, "éàüöäß": 9, "éàüöäx": 45, "éàüöä": 9}
    words = {w: n for w, n in words.items() if len(w) >= 6}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    got = sorted((tuple(r) for r in variants.variant_groups(df).collect()), key=repr)
    assert got == brute_groups(words)
    assert {r[0]: r[2] for r in got}["aaaaaaaaaaaa"] == "aaaabbbbbbbb" and {r[0]: r[1] for r in got}["zzzzzz"] == "zzzzzx"
    with pytest.raises(ValueError):
        variants.variant_groups(df, ratio=1)


@pytest.mark.parametrize("least_length", [2, 3, 7])
def test_near_pairs_are_all_pairs(spark, least_length):
    rng = random.Random(least_length)
    words = {"".join(rng.choice("abé") for _ in range(rng.randrange(least_length, least_length + 4))) for _ in range(300)}
    df = spark.createDataFrame([(w, 1) for w in words], "word string, n long")
    got = [(r.a, r.b) for r in variants.near_pairs(df, least_length).collect()]
    assert len(got) == len(set(got))
    assert {frozenset(p) for p in got} == {frozenset((a, b)) for a in words for b in words if one_edit(a, b)}


def brute_audit(rows, least_docs, most_terms):
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        found = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", lower(text or ""))
        groups.add((lang, source))
        counts[lang, source].update(found)
        docs[lang].update(set(found))
    out = []
    for lang in {g[0] for g in groups}:
        terms = [t for t, n in docs[lang].items() if n >= least_docs]
        sources = sorted(s for x, s in groups if x == lang)

        def shares(n):
            total = sum(n[t] for t in terms)  # noqa: B023
            return {t: 1 + 10**9 * (n[t] + 5) // (total + 5 * len(terms)) for t in terms}  # noqa: B023

        p = {s: shares(counts[lang, s]) for s in sources}
        q = shares(sum((counts[lang, s] for s in sources), Counter()))
        for s in sources:
            pairs = sorted(((-sum(abs(p[s][t] - p[o][t]) for t in terms), o.encode(), o) for o in sources if o != s))
            over = sorted((q[t] - p[s][t], t.encode(), t) for t in terms if counts[lang, s][t] and p[s][t] > q[t])
            out += [(lang, s, part, item, -v, i) for part, found in (("pair", pairs), ("term", over[:most_terms])) for i, (v, _, item) in enumerate(found, 1)]
    return sorted(out)


@pytest.mark.parametrize("least_docs, most_terms", [(1, 3), (4, 50), (1000, 50)])
def test_audit_of_odd_rows(docs, texts, none, sizes, least_docs, most_terms):
    got = sorted(tuple(r) for r in divergence.audit(docs, least_docs, most_terms).collect())
    assert got == brute_audit(texts, least_docs, most_terms)
    assert divergence.audit(none).count() == 0


def test_audit_of_the_given_documents(spark):
    rows = [(r.doc_id, r.text, r.lang, r.source) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert sorted(tuple(r) for r in queries.op13_source_divergence(spark, SF).collect()) == brute_audit(rows, 30, 50)


def test_terms_of_chunks():
    assert divergence.terms_of(pa.array(["", "...", "Don't", "A-b_C2Ü", " x", "É"])) == ["", "", "don t", "a b c Ü", " x", "É"]
