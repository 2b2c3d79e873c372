"""Similarity join, ranked search and collocations against brute force, with hot groups, ties, repeated rows and odd texts."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from conftest import SMALL, rows_of

from lodeweave.llm import collocations, ranked_search, similarity_join
from lodeweave.llm.ngrams import Words, byte_table, windows
from lodeweave.llm.registry import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", ["op11_similarity_join", "op12_ranked_search", "op13_collocations"])
def test_sql(spark, duck, name):
    got, want = QUERIES[name](spark, SMALL).toPandas(), duck.sql(ORACLE_SQL[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns and rows_of(got, columns) == rows_of(want, columns)


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def test_words():
    r = random.Random(1)
    texts = ["".join(r.choice("ab .,\n\té\U0001f600Z") for _ in range(r.randrange(40))) for _ in range(300)] + ["", "aaa", "aaa", " ", ""]
    w = Words(pa.array(texts), ~byte_table(b" \t.,\n"), byte_table(b".,\n"))
    want = [(i, lower(x).encode()) for i, t in enumerate(texts) for x in re.findall(r"[^ \t.,\n]+", t)]
    assert [(int(i), w.data[a:b]) for i, a, b in zip(w.text, w.start, w.stop, strict=True)] == want
    assert len({x for _, x in want}) == len({*w.hash.tolist()}) == len({*zip((x for _, x in want), w.hash.tolist(), strict=True)})
    assert w.ends.tolist() == np.cumsum(np.bincount(w.text, minlength=len(texts))).tolist()
    pieces = [(i, k) for i, t in enumerate(texts) for k, p in enumerate(re.split(r"[.,\n]", t)) for _ in re.findall(r"[^ \t]+", p)]
    assert [a == b for a, b in zip(pieces, pieces[1:], strict=False)] == (w.piece[1:] == w.piece[:-1]).tolist()
    assert len(windows(w.hash[:2], 4)) == 0


# similarity join


def shingles(text):
    w = [x for x in re.split(r"[ \t-\r]+", lower(text)) if x]
    return {tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))} if w else set()


def joined(docs):
    sets, root = [(d, shingles(t)) for d, t in docs], list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, (_, x) in enumerate(sets):
        for j in range(i):
            y = sets[j][1]
            if x and y and 100 * len(x & y) >= 85 * len(x | y):
                root[find(i)] = find(j)
    smallest = {}
    for i, (d, _) in enumerate(sets):
        k = find(i)
        smallest[k] = min(smallest.get(k, d), d)
    return sorted((d, len(x), smallest[find(i)]) for i, (d, x) in enumerate(sets))


def corpus(seed):
    r = random.Random(seed)
    word = lambda: f"w{r.randrange(10**6)}"
    docs = []
    template = [word() for _ in range(90)]
    sentences = [[word() for _ in range(9)] for _ in range(12)]
    for _ in range(60):  # one template, own words enough or not enough to be apart
        docs.append(template + [word() for _ in range(r.choice((4, 6, 7, 8, 12, 20)))])
    for _ in range(60):  # the same few sentences in ever new choices
        docs.append(sum(r.sample(sentences, r.choice((3, 8, 11))), []))
    for _ in range(40):
        base = [word() for _ in range(r.choice((1, 2, 4, 5, 9, 24, 60, 300)))]
        docs.append(base)
        for _ in range(3):
            d = [*base]
            for _ in range(r.randrange(1 + len(d) // 20)):
                d[r.randrange(len(d))] = word()
            docs.append(d[: max(1, len(d) - r.randrange(1 + len(d) // 9))])
    rows = [(i * 7 % 997, r.choice((" ", "\n", "  ")).join(d).upper() if r.random() < 0.1 else " ".join(d)) for i, d in enumerate(docs)]
    rows += [(2000 + i, "one and the same text here") for i in range(50)] + [(3000, None), (3001, ""), (3002, " \n "), (3003, "ok"), (3004, "OK"), (5, rows[5][1])]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_join(spark, seed):
    docs = corpus(seed)
    got = similarity_join.link(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == joined(docs)


def test_every_linked_pair_shares_a_signature():
    """Also where nearly all shingles are frequent and are indexed by combinations."""
    r = random.Random(5)
    universe = np.unique(np.array([r.getrandbits(64) for _ in range(3000)], np.uint64))
    order = similarity_join.Order(np.zeros(1 << 16, np.uint32))
    kind = np.array([r.choice((0, *[100] * 20, *[200] * 20)) for _ in range(1 << 16)], np.uint8)
    order.steps, order.second, order.third = kind, 50, 150
    bounds, found, combos = similarity_join.bands(3000, 85), 0, 0
    for _ in range(400):
        n = r.choice((1, 2, 5, 19, 20, 21, 40, 100, 400))
        x = np.sort(np.array(r.sample(universe.tolist(), n), np.uint64))
        gone = r.randrange(1 + int(n * 0.2))
        more = r.randrange(1 + int(n * 0.2))
        y = np.unique(np.concatenate([np.array(r.sample(x.tolist(), n - gone), np.uint64), np.array(r.sample(universe.tolist(), more), np.uint64)]))
        same = len(np.intersect1d(x, y))
        if 100 * same < 85 * (len(x) + len(y) - same):
            continue
        a, b = sorted((x, y), key=len)
        of = [dict() for _ in range(2)]
        for k, s in enumerate((a, b)):
            for sig, left, first in zip(*similarity_join.signatures(s, order, 85, bounds), strict=True):
                of[k].setdefault(sig, []).append((left, first))
        need = 85 * (len(a) + len(b))
        assert any(f and min(p, q) * 185 >= need for sig in of[0].keys() & of[1].keys() for p, f in of[0][sig] for q, _ in of[1][sig])
        found, combos = found + 1, combos + len(of[1])
    assert found > 100 and combos > 20 * found


def test_template_alone_makes_no_pairs(spark):
    """A large group that a template makes alike to less than the threshold: no member is compared with another."""
    r = random.Random(3)
    word = lambda: f"w{r.randrange(10**9)}"
    template = [word() for _ in range(100)]
    docs = spark.createDataFrame([(i, " ".join(template + [word() for _ in range(20)])) for i in range(2000)], "doc_id long, text string")
    sizes = []
    verify = similarity_join.verified
    try:
        similarity_join.verified = lambda pairs, *a: (sizes.append(pairs.count()), verify(pairs, *a))[1]
        assert similarity_join.link(docs).where("doc_id <> component_id").count() == 0
    finally:
        similarity_join.verified = verify
    assert sum(sizes) == 0


# ranked search


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower(text))


def ranked(docs, items, top=10):
    bags = [(d, w) for d, t in docs if (w := terms(t))]
    n_docs, total = len(bags), sum(len(w) for _, w in bags)
    df = Counter(t for _, w in bags for t in set(w))
    out = []
    for item, text in items:
        scores = []
        for d, w in bags:
            c, m = Counter(w), 25 + 75 * len(w) * n_docs // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in terms(text) if c[t])
            scores.append((-s, d))
        out += [(item, k, d, -s) for k, (s, d) in enumerate(sorted(scores)[:top], 1) if s < 0]
    return sorted(out)


@pytest.mark.parametrize("block_terms", [5, 10**6])
def test_search(spark, block_terms):
    r = random.Random(block_terms)
    words = [f"t{i}" for i in range(60)] + ["É", "ß1"]
    text = lambda n: " ".join(words[min(61, int(r.expovariate(0.12)))] + r.choice(("", ",", "!?")) for _ in range(n))
    docs = [(i, text(r.randrange(1, 60))) for i in range(300)] + [(400 + i, "T1 t2-t3") for i in range(30)] + [(500, None), (501, ""), (502, "!"), (7, "t1 t1")]
    items = [(f"q{i}", text(r.randrange(1, 12))) for i in range(8)] + [("same", "t1 t1 t2 t59 t59"), ("none", "zzz"), ("null", None), ("mixed", "zzz T5")]
    schema = ("doc_id long, text string", "item_id string, text string")
    got = ranked_search.search(spark.createDataFrame(docs, schema[0]), spark.createDataFrame(items, schema[1]), block_terms=block_terms).collect()
    assert sorted((x.item_id, x["rank"], x.doc_id, x.score) for x in got) == ranked(docs, items)
    assert ranked_search.search(spark.createDataFrame([], schema[0]), spark.createDataFrame(items, schema[1])).count() == 0
    assert ranked_search.search(spark.createDataFrame(docs, schema[0]), spark.createDataFrame([], schema[1])).count() == 0


def test_threshold_leaves_common_lists_alone():
    """The list of a common term isn't read where rare ones decide."""
    b = ranked_search.Block([[b"rare", b"word", b"the"]])
    most = np.array([{b"rare": 5000, b"word": 4000, b"the": 10}[w] for w in b.words])
    fetch, bound = b.thresholds({0: 8000}, most)
    assert {b.words[t] for t in fetch} == {b"rare", b"word"} and bound.tolist() == [[7990, 2, 10]]
    assert {int(x[2][0]) for x in fetch.values()} == {3995}


# collocations


def phrases(docs, least=30, top=2000):
    f, n = defaultdict(Counter), Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\n-\r]", lower(text)):
            w = [x for x in re.split(r"[ \t]+", piece) if x]
            n[lang] += len(w)
            for k in range(1, 5):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        some = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        inner = defaultdict(int)
        for p, a in some.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    inner[p[i : i + k]] = max(inner[p[i : i + k]], a)
        rows = []
        for p, a in some.items():
            if 100 * inner[p] < 80 * a:
                s, k = min((2_000_000 * a // (c[p[:k]] + c[p[k:]]), k) for k in range(1, len(p)))
                rows.append((-s, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out += [(lang, i, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(rows)[:top], 1)]
    return sorted(out)


@pytest.mark.parametrize("bits", [None, 16])
def test_collocations(spark, bits):
    r = random.Random(9)
    words = ["New", "york", "city", "a", "b", "Ünder", "it's", "\U0001f600", "c\x00d"] + [f"x{i}" for i in range(40)]
    text = lambda: "".join(r.choice(words[:6] if r.random() < 0.5 else words) + r.choice((" ", " ", " ", "\t ", ". ", "\n", "; ")) for _ in range(r.randrange(120)))
    docs = [(text(), r.choice(("en", "en", "de", None, ""))) for _ in range(400)] + [("new york city hall", "en")] * 200 + [(None, "en"), ("", None), ("it is " * 5000, "fr")]
    frame = spark.createDataFrame(docs, "text string, lang string")
    got = collocations.collocations(frame, bits=bits).collect()
    assert sorted((x.lang, x["rank"], x.phrase, x.a, x.l, x.r, x.n, x.score) for x in got) == phrases(docs)
    got = collocations.collocations(frame, least=300, top=3, bits=bits).collect()  # counts above a byte
    assert sorted((x.lang, x["rank"], x.phrase, x.a, x.l, x.r, x.n, x.score) for x in got) == phrases(docs, 300, 3)
    assert collocations.collocations(frame.limit(0)).count() == 0


def test_a_full_sketch_loses_nothing():
    """A sketch of far too few cells lets all through; estimates are never too low."""
    r, s = random.Random(2), collocations.Sketch(11, 30)
    keys = np.array([r.getrandbits(64) for _ in range(2000)], np.uint64)
    times = np.arange(2000) % 40 + 1
    s.add_keys(np.repeat(keys, times))
    s.flush()
    assert (collocations.estimates(s.table.reshape(2, -1), keys) >= np.minimum(times, 30)).all()



def test_scores_beyond_64_bits(spark):
    row = spark.sql(f"SELECT (CAST(a AS DECIMAL(20, 0)) * {collocations.SCALE}) div (CAST(l AS DECIMAL(20, 0)) + CAST(l AS DECIMAL(20, 0))) AS score FROM VALUES (90000000000000L, 90000000000007L) AS t(a, l)").first()
    assert row.score == 2_000_000 * 90000000000000 // (2 * 90000000000007)
