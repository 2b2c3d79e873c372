"""Chunk boundaries, against a second implementation that works on lists, and by what must hold of any document."""

import re

import pytest

from lodeweave.config import ChunkingOptions
from lodeweave.functions.text import token_estimate_py
from lodeweave.operators.chunking import chunk_documents, chunk_windows, hard_split, sentences, windows

O = ChunkingOptions(target_tokens=40, max_tokens=70, min_tokens=8, overlap_tokens=12, hard_split_chars=240, chars_per_token=4.0, sentence_regex=r"(?<=[.!?])\s+(?=[A-Z0-9])")


def page(n):
    return " ".join(f"Questa e la frase numero {i} di prova con parola ripetuta a sufficienza." for i in range(n))


def chunks(pages, o=O):
    return list(chunk_windows(sentences(list(enumerate(pages, 1)), o), o))


def plain_windows(ss, o):
    """All windows of a list of sentences, by index."""
    out, i = [], 0
    while i < len(ss):
        if ss[i].tokens > o.max_tokens:
            out.append(ss[i : i + 1])
            i += 1
            continue
        j, total = i, 0
        while j < len(ss) and total < o.target_tokens and not (j > i and total + ss[j].tokens > o.max_tokens):
            total += ss[j].tokens
            j += 1
        out.append(ss[i:j])
        if j == len(ss):
            break
        k, back = j, 0
        while k > i + 1 and back < o.overlap_tokens:
            k -= 1
            back += ss[k].tokens
        i = k
    return out


@pytest.mark.parametrize("pages", [[20, 20], [30], [6, 6], [1], [12, 1, 1], [50, 3, 40]])
def test_windows_as_on_lists(pages):
    ss = list(sentences([(i, page(n)) for i, n in enumerate(pages)], O))
    assert [[s.start for s in w] for w in windows(iter(ss), O)] == [[s.start for s in w] for w in plain_windows(ss, O)]


def test_overlap_and_order():
    c = chunks([page(30)])
    assert len(c) > 1 and c[1][0].start < c[0][-1].end
    assert [w[0].start for w in c] == sorted(w[0].start for w in c)


def test_pages():
    assert any(w[0].position != w[-1].position_end for w in chunks([page(6), page(6)]))
    positions = {s.position for w in chunks([page(4), "  ", page(4)]) for s in w}
    assert 2 not in positions and 3 in positions
    assert chunks(["", "   "]) == []


def test_bridge():
    text = " ".join(s.text for w in chunks(["Io dichiaro che la citta", "sarebbe stata difesa fino alla fine."]) for s in w)
    assert "la citta sarebbe stata difesa" in text
    off = ChunkingOptions(**{**O.__dict__, "bridge_segments": False})
    assert len(list(sentences([(1, "Io dichiaro che la citta"), (2, "sarebbe difesa.")], off))) == 2
    assert len(list(sentences([(1, "One. "), (2, "two three.")], O))) == 2


def test_hard_split():
    o = ChunkingOptions(**{**O.__dict__, "hard_split_chars": 120})
    c = chunks(["parolasenzapunteggiatura " * 200], o)
    assert len(c) > 1 and all(sum(s.tokens for s in w) <= 120 for w in c)
    assert [p for p, _ in hard_split("x" * 250, 100)] == ["x" * 100, "x" * 100, "x" * 50]
    assert "".join(p for p, _ in hard_split("ab cd", 0)) == "ab cd"


def test_stub_is_merged():
    last = chunks([page(12) + " Fine."])[-1]
    assert sum(s.tokens for s in last) >= 8


def test_offsets_point_into_the_text():
    pages = [page(3), page(2)]
    whole = "\n".join(pages)
    for s in sentences(list(enumerate(pages)), O):
        assert re.sub(r"\s+", " ", whole[s.start : s.end]) == s.text and s.tokens == token_estimate_py(s.text, 4.0)


def test_hashes(spark):
    rows = [("s", "a", 1, page(9)), ("s", "b", 1, page(9)), ("s", "c", 1, "")]
    seg = spark.createDataFrame(rows, "source_key string, external_id string, position int, text string")
    titles = lambda t: spark.createDataFrame([("s", "a", t), ("s", "b", "Test document")], "source_key string, external_id string, title string")
    run = lambda t: {(r.external_id, r.ordinal): r for r in chunk_documents(seg, O, titles(t)).collect()}
    a, b = run("Test document"), run("Other")
    assert a["a", 0].content_hash == a["b", 0].content_hash != b["a", 0].content_hash
    assert a["a", 0].header == "Test document - 1" and not any(k[0] == "c" for k in a)
    assert sorted(k[1] for k in a if k[0] == "a") == list(range(sum(k[0] == "a" for k in a)))


def test_documents_are_streams(spark):
    """One document of many segments passes in bounded memory: the generator is never given more than the batch that it is at."""
    from pyspark.sql import functions as F

    from lodeweave.config import ChunkingOptions
    from lodeweave.operators import chunking

    o = ChunkingOptions()
    read = []

    def found():
        for i in range(100_000):
            read.append(i)
            yield i, f"Sentence number {i} is here to be read. And another one follows it."

    held = next(chunking.chunk_windows(chunking.sentences(found(), o), o))
    assert held and len(read) < 200
    pages = spark.range(60_000).select(F.lit("s").alias("source_key"), F.when(F.col("id") < 50_000, "long").otherwise(F.concat(F.lit("d"), F.col("id") % 50)).alias("external_id"), F.col("id").cast("int").alias("position"), F.format_string("Sentence number %d is here to be read. And another one follows it.", "id").alias("text"))
    got = chunking.chunk_documents(pages, o).where("external_id = 'long'").select("ordinal", "char_start", "char_end", "text").orderBy("ordinal").collect()
    want = [(i, w[0].start, w[-1].end, " ".join(s.text for s in w)) for i, w in enumerate(chunking.chunk_windows(chunking.sentences(((i, f"Sentence number {i} is here to be read. And another one follows it.") for i in range(50_000)), o), o))]
    assert [tuple(r) for r in got] == want
    sums = {r.external_id: (r.content_checksum, r.segments) for r in chunking.content_checksums(pages, F.col("text")).collect()}
    import hashlib

    lines = "".join(f"{i}:Sentence number {i} is here to be read. And another one follows it.\n" for i in range(50_000))
    assert sums["long"] == (hashlib.sha256(lines.encode()).hexdigest(), 50_000) and len(sums) == 51
    plan = chunking.chunk_documents(pages, o)._jdf.queryExecution().toString()
    assert "MapInArrow" in plan and "FlatMapGroups" not in plan
