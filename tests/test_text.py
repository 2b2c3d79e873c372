"""Normalisers, terms, tokens, snippets, excerpts and readable pages."""

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from lodeweave.functions import text as T
from lodeweave.functions import vectors as V


def value(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


CASES = ["ﬁne oﬀer", "co-\n  operate", "Co-\nOperate", "a\x00b​c﻿d�e", "a b  c \t\n d", "‘x’ – y", "", "  ", "dé-\r\nfi"]


@pytest.mark.parametrize("text", CASES)
def test_normalize_columns_and_python_agree(spark, text):
    assert value(spark, T.normalize(F.lit(text))) == T.normalize_py(text)


def test_normalizers(spark):
    assert T.normalize_py("co-\n  operate") == "cooperate"
    assert T.normalize_py("ﬁne oﬃce") == "fine office"
    assert value(spark, T.dehyphenate(F.lit("Co-\nOperate"))) == "Co-\nOperate"


def test_terms(spark):
    assert value(spark, T.terms(F.lit("Cosa ordinò dell'ingenuo fanciullo l’ortolano?"))) == ["cosa", "ordinò", "ingenuo", "fanciullo", "ortolano"]
    assert value(spark, T.terms(F.lit("Nel 1754 e nel 1799"))) == ["nel", "1754", "1799"]
    assert T.terms_py("Nel 1754 e nel 1799") == ["nel", "1754", "1799"]


def test_tokens(spark):
    for text, n in (("", 0), ("a", 1), ("a" * 37, 10), ("a" * 38, 11)):
        assert value(spark, T.token_estimate(F.lit(text))) == T.token_estimate_py(text) == n


def test_snippet_and_label(spark):
    assert value(spark, T.snippet(F.lit("  short  "), 10)) == "short"
    assert value(spark, T.snippet(F.lit("one two, three"), 8)) == "one two..."
    assert value(spark, T.position_label(F.lit(3), F.lit(3))) == "Page 3" and value(spark, T.position_label(F.lit(3), F.lit(5))) == "Pages 3-5"


def test_excerpt():
    text = "filler " * 100 + "the sorella speaks here " + "filler " * 100
    cut = T.excerpt_py(text, "sorelle", 220)
    assert "sorella" in cut and cut.startswith("… ") and cut.endswith(" …") and len(cut) <= 224
    assert T.excerpt_py("short", "x", 200) == "short"


def plain_excerpt(content, question, limit):
    """By counting the occurrences in the window before each one."""
    if len(content) <= limit:
        return content
    low, begins = content.lower(), {}
    for t in T.terms_py(question):
        if len(t) >= 4:
            head = t[: max(4, len(t) - 2)]
            for i in range(len(low)):
                if low.startswith(head, i):
                    begins.setdefault(i, []).append(head)
    counts = [(sum(len(h) for i, h in begins.items() if b <= i < b + limit), -b) for b in (max(0, i - limit // 4) for i in begins)]
    start = min(-max(counts)[1], len(content) - limit) if counts else 0
    spaces = [i for i, c in enumerate(content[:start]) if c == " "]
    start = spaces[-1] + 1 if spaces else start
    part = content[start : start + limit]
    if start + limit < len(content) and " " in part:
        part = part[: part.rindex(" ")]
    return ("… " if start > 0 else "") + part.strip() + (" …" if start + len(part) < len(content) else "")


def test_the_excerpt_query_against_plain_counts(spark):
    """Over the whole table: one row for each document, the last one too."""
    from lodeweave.plans.queries import excerpt, table

    docs = {r.doc_id: r.text for r in table(spark, SMALL, "documents").collect()}
    got = {r.doc_id: r.excerpt for r in excerpt(spark, SMALL).collect()}
    assert got == {i: plain_excerpt(t, docs.get(i + 1, ""), 400) for i, t in docs.items()}


def test_readable_html(spark):
    page = "<p>One &amp; <b>two</b></p><script>no()</script><div>three</div>"
    assert value(spark, T.readable_html(F.lit(page))) == "One & two\nthree"


def test_urls(spark):
    for url, ok in (("https://example.com/a", True), ("ftp://example.com", False), ("http://127.0.0.1/x", False), ("http://10.2.3.4", False), ("http://localhost/", False), ("nonsense", False)):
        assert value(spark, T.is_public_url(F.lit(url))) is ok


def test_vectors(spark):
    assert value(spark, V.dot([1, 2], [3, 4])) == 11
    assert value(spark, V.cosine([1, 0], [0, 0])) == 0
    assert value(spark, V.normalize(F.array(F.lit(3.0), F.lit(4.0)))) == [0.6, 0.8]
    assert value(spark, V.to_literal(F.array(F.lit(0.5), F.lit(-1.0)))) == "[0.5,-1]"
    assert value(spark, V.from_literal(F.lit("[0.5,-1]"))) == [0.5, -1.0]


def test_bodies_of_responses(spark):
    rows = [("grüße".encode(), None, "grüße"), ("grüße".encode("latin-1"), "text/html; Charset=ISO-8859-1", "grüße"), ("grüße".encode("latin-1"), "text/plain", "gr??e"), ("€".encode("cp1252"), 'text/html; charset="windows-1252"', "€"), (b"a\xffb", "x; charset=utf-8", "a?b")]
    rows += [("ß\ufffd".encode(), "x; charset=no-such", "ß\ufffd"), (b"", "x; charset=latin1", ""), (b"", None, ""), (None, "x; charset=latin1", None), ("é".encode(), "x; charset=rot13", "é"), ("日本".encode("shift_jis"), "x; charset=Shift_JIS", "日本")]
    got = spark.createDataFrame([(i, *r[:2]) for i, r in enumerate(rows)], "i int, body binary, type string").select("i", T.decode_body("body", "type").alias("t")).collect()
    assert {r.i: r.t for r in got} == {i: r[2] for i, r in enumerate(rows)}
