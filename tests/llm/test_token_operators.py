"""Encoding, records, personal data, near-duplicates, quality rules and the pipeline, each against brute force or an exact round trip."""

import collections
import hashlib
import math
import random
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from lodeweave.llm import bpe, near_duplicates, private_terms, quality_rules, token_records

PLAIN = "doc_id long, text string, extra string"


@pytest.fixture(scope="module")
def texts(duck):
    return duck.sql("SELECT doc_id, text FROM documents ORDER BY doc_id").fetchall()


def odd_texts(seed, n):
    r = random.Random(seed)
    pool = [chr(c) for c in range(0x3000)] + list(" \n\t\x1c\x85 a1'sΣ́é") * 60 + [chr(c) for c in (0x1F600, 0x4E00, 0xAC00, 0x10400, 0x1D7CE, 0x11DE0)]
    out = ["".join(r.choices(pool, k=r.randint(0, 60))) for _ in range(n)]
    return out + ["a" * 3000, " " * 500, "=" * 777, "x<|endoftext|>y<|startoftext|>", "", "don't we'll \n\n  stop"]


# --- byte-pair encoding ---


def test_encoding_is_the_library_s(texts):
    from tokenizers import Tokenizer

    e, t = bpe.encoder(bpe.vocabulary_path()), Tokenizer.from_file(bpe.vocabulary_path())
    for x in [x for _, x in texts[:60]] + odd_texts(1, 400):
        ids = t.encode(x, add_special_tokens=False).ids
        assert e.encode(x) == struct.pack(f"<{len(ids)}I", *ids)
        assert e.decode(e.encode(x)) == t.decode(ids, skip_special_tokens=False)


def test_encode_frame(spark):
    d = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (2, "hello world", "c"), (2, "hello world", "c"), (None, "x" * 100_000, "d")], PLAIN).withColumn("n_tokens", F.lit("clash"))
    out = bpe.encode(d).collect()
    assert len(out) == 5 and [r.n_tokens for r in out[:4]] == [0, 0, 2, 2] and out[2].ids == [31373, 995] and len(out[4].ids) == out[4].n_tokens
    assert out[0].ids_sha256 == hashlib.sha256(b"").hexdigest() and out[2].decoded_sha256 == hashlib.sha256(b"hello world").hexdigest()
    assert bpe.encode(d.limit(0)).count() == 0


# --- records ---


def test_crc32c():
    table = [i for i in range(256)]
    for i in range(256):
        c = i
        for _ in range(8):
            c = (c >> 1) ^ (0x82F63B78 if c & 1 else 0)
        table[i] = c

    def plain(b):
        c = 0xFFFFFFFF
        for x in b:
            c = c >> 8 ^ table[(c ^ x) & 0xFF]
        return c ^ 0xFFFFFFFF

    r = random.Random(2)
    parts = [b"123456789", b"", b"a", *(r.randbytes(n) for n in (3, 1023, 1024, 1025, 5000))]
    assert token_records.crc32c(parts) == [plain(p) for p in parts] and plain(b"123456789") == 0xE3069283


def test_frames():
    payloads = [b"", b"x" * 3000, b"yz"]
    blob = b"".join(token_records.frames(payloads))
    assert token_records.unframe(blob) == payloads
    for at in (0, 9, 13, len(blob) - 1):
        with pytest.raises(ValueError):
            token_records.unframe(blob[:at] + bytes([blob[at] ^ 1]) + blob[at + 1 :])
    with pytest.raises(ValueError):
        token_records.unframe(blob[:-3])


def test_chunks_are_the_library_s(texts):
    from tokenizers import Tokenizer

    t, e = Tokenizer.from_file(token_records.vocabulary_path()), token_records.chunk_encoder(token_records.vocabulary_path())
    some = [x for _, x in texts[:60]] + odd_texts(4, 400)
    for x, got in zip(some, e.encode_all(some), strict=True):
        assert np.frombuffer(got, "<u2").tolist() == t.encode(x, add_special_tokens=False).ids


def test_records(spark, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(token_records.vocabulary_path())
    rows = [*texts[:80], (10**12, None), (-5, ""), (10**12 + 1, "word " * 50_000)]
    out = sorted(token_records.read_records(token_records.write(spark.createDataFrame(rows, "doc_id long, text string"), token_records.scratch_path(spark, "t"))).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in out] == sorted(r[0] for r in rows)
    start, by = 0, dict(rows)
    for r in out:
        ids = t.encode(by[r.doc_id] or "", add_special_tokens=False).ids + [2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
        start += len(ids)
    same = spark.createDataFrame([(None, "a"), (1, "b"), (1, "b"), (1, "c c")], "doc_id long, text string")
    out = sorted(token_records.read_records(token_records.write(same, token_records.scratch_path(spark, "t"))).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in out] == [None, 1, 1, 1] and [r.start for r in out][:2] == [0, 2]
    assert token_records.read_records(token_records.write(same.limit(0), token_records.scratch_path(spark, "t"))).count() == 0


# --- personal data ---

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_spans(text):
    out = []
    for kind, p in PATTERNS.items():
        for m in re.finditer(p, text):
            digits = re.sub("[^0-9]", "", m[0])
            total = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(digits[::-1]))
            ok = {"email": True, "ip": kind != "ip" or all(len(x.lstrip("0")) < 4 and int(x) <= 255 for x in m[0].split(".")), "card": 16 <= len(digits) <= 19 and total % 10 == 0, "phone": 8 <= len(digits) <= 15}[kind]
            if ok:
                out.append((kind, *m.span()))
    return out


def test_base_spans(texts):
    r = random.Random(3)
    for x in ["".join(r.choices("ab@.@.-_%+1234 ()0é5", k=r.randint(1, 50))) for _ in range(8000)] + [x for _, x in texts] + ["4111 1111 1111 1111", "1" * 5000 + ".1.1.1", "a" * 5000 + "@b.c"]:
        assert private_terms.base_spans(x) == plain_spans(x)


def test_terms_that_reveal(spark):
    filler = [(100 + i, f"ordinary words about the weather and the town {i}", "") for i in range(60)]
    told = [(i, f"please write to zorblax quickly at zed@corp.example today about the weather {i}", "") for i in range(6)]
    rows = filler + told + [(500, None, ""), (501, "", ""), (6, told[0][1], ""), (6, told[0][1], "")]
    out = {r.doc_id: r for r in private_terms.find_private(spark.createDataFrame(rows, PLAIN)).collect()}
    text = told[0][1]
    at = text.index("zorblax")
    assert f"term:{at}:{at + 7}" in out[0].spans and out[0].base == f"email:{text.index('zed@')}:{text.index(' today')}" and out[0].spans.startswith(out[0].base)
    weather = text.index("weather")
    assert f"term:{weather}:" not in out[0].spans and out[500].spans == "" and out[501].n_email == 0 and out[100].spans == ""
    assert private_terms.sanitise(text, out[0].spans).count("[email]") == 1 and "zorblax" not in private_terms.sanitise(text, out[0].spans)
    assert private_terms.find_private(spark.createDataFrame([], PLAIN)).count() == 0 and private_terms.find_private(spark.createDataFrame(rows, PLAIN)).count() == len(rows)


def plain_disclosure(rows):
    """(doc_id, spans) of every row, by counting over all of them."""
    words = [set(re.findall(r"\w+", x.lower())) for _, x in rows]
    spans = [private_terms.base_spans(x) for _, x in rows]
    held = [{e for k, a, b in s for e in private_terms.entities(k, x[a:b])} for s, (_, x) in zip(spans, rows, strict=True)]
    n_term, n_entity, n_joint = collections.Counter(w for s in words for w in s), collections.Counter(e for s in held for e in s), collections.Counter()
    for h, s, (_, x) in zip(held, spans, rows, strict=True):
        n_joint.update((e, w) for w in {w for w, _, _ in private_terms.free_terms(x, s)} for e in h)
    ln, n = math.log, len(rows)
    bad = {w for (e, w), j in n_joint.items() if j >= private_terms.MIN_JOINT and ln(j * n / (n_entity[e] * n_term[w])) * private_terms.ALPHA >= ln(n / n_entity[e])}
    return [(d, private_terms.joined(s + [("term", a, b) for w, a, b in private_terms.free_terms(x, s) if w in bad])) for s, (d, x) in zip(spans, rows, strict=True)]


def test_disclosure_against_brute_force(spark):
    """At the settings of the query, over all documents of a larger folder, where the method marks terms beside the base spans."""
    rows = [(r.doc_id, r.text or "") for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text").collect()]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.spans) for r in private_terms.find_private(d).collect())
    assert got == sorted(plain_disclosure(rows)) and sum(s.count("term:") for _, s in got) > 10


def test_sanitised_texts(spark):
    filler = [(100 + i, f"ordinary words about the weather and the town {i}", "x") for i in range(60)]
    told = [(i, f"please write to zorblax quickly at zed@corp.example today {i}", "x") for i in range(6)]
    rows = filler + told + [(500, None, "x"), (501, "zorblax alone", "x")]
    out = {r.doc_id: r for r in private_terms.sanitise_texts(spark.createDataFrame(rows, PLAIN)).collect()}
    assert len(out) == len(rows) and out[500].text == "" and "zorblax" not in out[501].text and out[100].text == filler[0][1] and out[100].extra == "x"
    assert "[email]" in out[0].text and "corp.example" not in out[0].text and "zorblax" not in out[0].text
    assert private_terms.sanitise("ab cd ef", "term:0:2,term:3:5", ["remove", "generalise"]) == " [term] ef"


# --- near-duplicates ---


def plain_classes(spark, rows):
    d = spark.createDataFrame(rows, "doc_id long, text string")
    sketch, n = near_duplicates.document_frequencies(d, "text")
    idf = near_duplicates.idf_table(sketch, n)
    sets = {i: near_duplicates.weighted(x or "", idf) for i, x in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and find(a) != find(b) and near_duplicates.similarity(sets[a], sets[b]) >= near_duplicates.THRESHOLD:
                root[max(find(a), find(b))] = min(find(a), find(b))
    return d, {i: find(i) for i in ids}


def test_classes_against_all_pairs(spark, texts):
    r = random.Random(9)
    words = [f"w{i}" for i in range(3000)]
    base = r.choices(words, k=300)
    rows = [(i, x) for i, x in texts]
    for i in range(60):  # a large group of near copies, with edits of many sizes
        w = base.copy()
        for _ in range(i % 12):
            w[r.randrange(300)] = r.choice(words)
        rows.append((10_000 + i, " ".join(w)))
    rows += [(20_000, None), (20_001, ""), (20_002, "!!!"), (20_003, "one two"), (20_004, "One, two.")]
    d, want = plain_classes(spark, rows)
    got = {x.doc_id: x.class_id for x in near_duplicates.classify(d).collect()}
    assert got == want and got[20_004] == 20_003 and got[20_001] == 20_001


def test_shingles_of_groups():
    r = random.Random(4)
    texts = ["", "!!", "one", "One, two!", "a b c d", "a b c d e", "a b c d e " * 9, "\u00c9t\u00e9 \u0130 x y z " * 3, "x" * 100_000] + [" ".join(r.choices("abcdefg", k=r.randint(0, 40))) for _ in range(200)]
    some = pa.array(["skipped", *texts]).slice(1)
    for t, (h, _) in zip(texts, near_duplicates.weighted_sets(some, np.ones(1 << near_duplicates.SKETCH_BITS, np.float32)), strict=True):
        words = re.findall(r"[0-9a-z\u0080-\U0010ffff]+", t.lower())
        plain = collections.Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else {}
        alone, counts = near_duplicates.shingles(t)
        assert len(h) == len(plain) and (alone == h).all() and sorted(counts.tolist()) == sorted(plain.values()) and (np.diff(h.astype(object)) > 0).all()


@pytest.mark.parametrize("n", [4_800, 20_000])
def test_links_in_a_group_that_a_template_makes_alike(spark, n):
    """Texts of 230 words that share 200, unrelated pairs of which are just below the threshold; planted pairs must be found, and nothing else."""
    r, words = random.Random(5), [f"w{i}" for i in range(50_000)]
    common, rows = r.choices(words, k=200), []
    for i in range(n - 800):
        own = r.choices(words, k=30)
        rows.append((i, " ".join(common + own)))
        if i < 800:  # a partner with up to 15 other words at the end
            k = 1 + i % 15
            rows.append((n + i, " ".join(common + own[: 30 - k] + r.choices(words, k=k))))
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    got = {x.doc_id: x.class_id for x in near_duplicates.classify(d).collect()}
    assert all(got[n + i] == got[i] == i for i in range(800)) and len(set(got.values())) == n - 800


def test_components_of_long_chains(spark):
    r = random.Random(6)
    ids = [i.to_bytes(4, "big") for i in range(3000)]
    links = [(ids[i], ids[i + 1]) for i in range(500)] + [(ids[1000], ids[i]) for i in range(1001, 2000)] + [(ids[r.randrange(2000, 3000)], ids[r.randrange(2000, 3000)]) for _ in range(1200)]
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    want = {x: find(x) for p in links for x in p if find(x) != x}
    assert {bytes(x.key): bytes(x.root) for x in near_duplicates.components(spark.createDataFrame(links, "a binary, b binary")).collect()} == want


def test_sampling_estimates_similarity():
    r = np.random.default_rng(1)
    h = np.unique(r.integers(0, 2**63, 400).astype(np.uint64))
    a, b = (h[:300], np.full(300, 0.9, np.float32)), (h[60:], np.full(len(h) - 60, 0.9, np.float32))
    same = np.mean(near_duplicates.signatures([a], 800, 1) == near_duplicates.signatures([b], 800, 1))
    assert abs(same - near_duplicates.similarity(a, b)) < 0.07


def test_keep_one(spark):
    t = "the same words in the same order here " * 5
    rows = [(5, t, "a"), (3, t, "b"), (3, t, "b"), (9, t + "more", "c"), (None, t, "d"), (7, "something else that is entirely of its own kind", "e"), (8, None, "f"), (8, None, "f")]
    kept = near_duplicates.keep_one(spark.createDataFrame(rows, PLAIN)).collect()
    assert sorted((r.doc_id, r.extra) for r in kept) == [(3, "b"), (7, "e"), (8, "f")]
    assert near_duplicates.classify(spark.createDataFrame([], PLAIN)).count() == 0


# --- quality rules ---


def plain_counts(text):
    w = [x for x in re.split(r"[ \t-\r]+", text or "") if x]
    grams = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    n = collections.Counter(grams)
    inside = {i + k for i, g in enumerate(grams) if n[g] > 1 for k in range(8)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^ \t-\r]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(inside)


def test_counts_against_brute_force(spark, texts):
    rows = [*texts, (-1, None), (-2, ""), (-3, "a b " * 50), (-4, "x\n\nx\n \nx"), (-5, "a # b\x0bc d\U0001f600 " * 9), (-6, "1 2 3 4 5 6 7 8"), (-7, "one " * 100_000)]
    d = spark.createDataFrame([(i, x, 0) for i, x in rows], "doc_id long, text string, n_words int")
    got = {r.doc_id: tuple(r[c] for c in quality_rules.FEATURES) for r in quality_rules.features(d).collect()}
    assert got == {i: plain_counts(x) for i, x in rows}


def test_binomial_tail(spark):
    rows = [(k, n) for n in (1, 10, 60, 200, 1000, 5000) for k in {0, 1, n // 50, n // 25, n // 20} if k <= n * 0.05]
    out = quality_rules.with_ln_tail(spark.createDataFrame(rows, "k long, n long"), "k", "n", 0.05).collect()
    for r in out:
        want = math.log(math.fsum(math.exp(math.lgamma(r.n + 1) - math.lgamma(j + 1) - math.lgamma(r.n - j + 1) + j * math.log(0.05) + (r.n - j) * math.log(0.95)) for j in range(r.k + 1)))
        assert abs(r.ln_tail - want) < 1e-8 * max(1, abs(want))


def test_rules(spark):
    good, bad = "some good words that are all of a kind and go on for a while without any marks in them at all " * 1, "### $$$ " * 15
    rows = [(i, f"{good} {i}", "en") for i in range(400)] + [(1000 + i, f"{bad} {i}", "en") for i in range(50)] + [(2000, None, None), (2001, bad, "de"), (400, "short", "en")]
    labels = spark.createDataFrame([(i, 1) for i in range(400)] + [(1000 + i, 0) for i in range(40)] + [(7, 1), (None, 1), (8, None)], "doc_id long, quality int")
    out = {r.doc_id: r for r in quality_rules.apply_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string"), labels).collect()}
    assert len(out) == len(rows) and all(out[i].kept for i in range(400)) and not any(out[1000 + i].kept for i in range(50))
    assert not out[2000].kept and out[2000].base_failed and not out[400].kept
    none = {r.doc_id: r.kept for r in quality_rules.apply_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string"), labels.limit(0)).collect()}
    assert none[0] and not none[400] and quality_rules.apply_rules(spark.createDataFrame([], "doc_id long, text string, lang string"), labels).count() == 0


# --- the pipeline ---


def test_pipeline(spark, duck):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    seen = [docs.select(*p.COLUMNS)]
    for name, stage in p.STAGES:
        out = stage(spark, seen[-1], SMALL).cache()
        assert name == p.STAGES[-1][0] or out.columns == list(p.COLUMNS)
        seen.append(out)
    ids = [{r.doc_id for r in x.select("doc_id").collect()} for x in seen]
    assert ids[1] < ids[0] and ids[2] == ids[1] and ids[3] <= ids[2] and ids[4] <= ids[3] and ids[5] == ids[4]
    kept = {r.doc_id for r in quality_rules.query(spark, SMALL).where("kept").collect()}
    assert ids[1] == kept
    stage2 = {r.doc_id: r.text for r in seen[2].collect()}
    _, classes = plain_classes(spark, sorted(stage2.items()))
    assert ids[3] == {i for i, c in classes.items() if i == c}
    final = p.run(spark, SMALL).collect()
    assert {r.doc_id for r in final} == ids[5]
    e = bpe.encoder(bpe.vocabulary_path())
    assert all(struct.pack(f"<{len(r.ids)}I", *r.ids) == e.encode(stage2[r.doc_id]) for r in final)
    empty = docs.limit(0)
    for _, stage in p.STAGES:
        empty = stage(spark, empty, SMALL)
    assert empty.count() == 0
