"""Nulls in any column, empty and very long texts, ties, repeated rows, empty tables and clashing columns, through every operator and stage."""

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from lodeweave.llm import bpe, chat_format, collocations, decontaminate, license_scan, line_templates, near_duplicates, page_text, private_terms, quality_rules, ranked_search, similarity_join, token_records

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, N_WORDS string, class_id string, ids string, quality string, spans string, item_id string, path string, url string, _t string, _w string, _stratum string, _cut_symbols string, _ranges string, _items string, _dir string, _id string"
GOOD = " ".join(f"word{i} of a text" for i in range(30))


def odd(spark):
    more = ("k", "w", "c", "i", "q", "s", "t", "a/b", "http://h/x", *"twsurid", "x")
    rows = [
        (1, GOOD, "en", "s", 5, *more), (1, GOOD, "en", "s", 5, *more), (2, GOOD, None, None, None, *[None] * 17), (None, GOOD + " more", "en", "s", 1, *more), (None, None, None, None, None, *[None] * 17),
        (3, None, "en", "s", 0, *more), (4, "", "de", "s", 0, *more), (5, "long " * 200_000, "en", "s", 9, *more), (6, "\n" * 3000, "en", "s", 9, *more), (7, "x" * 500_000, "en", "s", 9, *more), (8, "\U0001f600\x00\x0b � tail", "en", "s", 9, *more),
        (9, " ".join(f"one{i}" for i in range(40)), "fr", "s", 2, *more), (-9, " ".join(f"one{i}" for i in range(40)), "fr", "s", 2, *more),
    ]
    return spark.createDataFrame(rows, SCHEMA)


def results(spark, d):
    labels = spark.createDataFrame([(1, 1, None), (2, None, None), (None, 1, 1), (5, 0, 0), (5, 1, 0)], "doc_id long, quality int, toxic int")
    benchmark = spark.createDataFrame([(1, "word3 of a text word4 of a text word5 of"), (None, None), (2, None), (3, "")], "item_id long, text string")
    return {
        "lines": line_templates.drop_recurring_lines(d), "leaks": decontaminate.decontaminate(d, benchmark), "bpe": bpe.encode(d), "private": private_terms.find_private(d), "near": near_duplicates.classify(d),
        "records": token_records.read_records(token_records.write(d, token_records.scratch_path(spark, "edges"))), "rules": quality_rules.apply_rules(d, labels), "licences": license_scan.scan(d),
        "pages": page_text.extract(d, id_col="doc_id", html_col="text"), "links": similarity_join.link(d),
    }


def test_operators(spark):
    d = odd(spark)
    n = d.count()
    out = {k: v.collect() for k, v in results(spark, d).items()}
    assert {k: len(v) for k, v in out.items()} == dict.fromkeys(out, n)
    assert {r.doc_id for r in out["near"] if r.class_id == 1} == {1, 2, None}
    assert sum(r.contaminated for r in out["leaks"]) == 4
    internal = {"_t", "_w", "_stratum", "_cut_symbols", "_ranges", "_items", "_dir", "_id"}
    assert all(internal <= set(out[k][0].asDict()) for k in ("lines", "leaks", "bpe", "rules"))
    assert {r["_t"] for r in out["rules"]} == {"t", None}
    assert {r.kept for r in out["rules"] if r.doc_id in (1, 2)} == {True}
    assert {r.doc_id: r.n_tokens for r in out["records"]}[5] == 200_001


def test_search_and_phrases(spark):
    d = odd(spark)
    items = spark.createDataFrame([(1, "word3 long"), (1, "word3 long"), (None, "word3"), (2, None)], "item_id long, text string")
    out = ranked_search.search(d, items).collect()
    assert [(r.item_id, r["rank"], r.doc_id) for r in out if r.item_id is None] == [(None, 1, 1), (None, 2, 1), (None, 3, 2), (None, 4, None)]
    assert sum(r.item_id == 1 for r in out) == 10 and {r.doc_id for r in out if r.item_id == 1} == {1, 2, 5, None}
    assert {(r.lang, r.phrase, r.a) for r in collocations.collocations(d).collect()} == {("en", "long long long long", 199_997), ("en", "of a text", 90), ("und", "of a text", 30)}
    assert ranked_search.search(d.limit(0), items).count() == collocations.collocations(d.limit(0)).count() == 0


def test_empty_tables(spark):
    assert {k: v.count() for k, v in results(spark, odd(spark).limit(0)).items()} == dict.fromkeys(results(spark, odd(spark).limit(0)), 0)


def test_null_conversations(spark):
    rows = [(None, None, None, None), (None, 0, "user", "a"), (1, None, "assistant", None), (1, 0, None, "b"), (1, 0, None, "b"), (1, 0, "user", ""), (2, 10**6, "assistant", "z" * 300_000)]
    e = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").select("conv_id", F.col("turn").alias("seq"), F.lit("message").alias("kind"), "turn", "role", "text")
    out = chat_format.parse(chat_format.format_conversations(e)).collect()
    assert sum(r.n_turns for r in out) == len(rows) == sum(len(r.turns) for r in out)
    assert next(r for r in out if r.conv_id == 2).loss_text == "z" * 300_000


@pytest.mark.parametrize("full", [True, False])
def test_stages(spark, full):
    import corpus_pipeline as p

    docs = odd(spark) if full else odd(spark).limit(0)
    for name, stage in p.STAGES:
        docs = stage(spark, docs, SMALL).cache()
        assert name == "bpe" or docs.columns == list(p.COLUMNS)
    got = {r.doc_id for r in docs.collect()}
    assert got == ({1, -9} if full else set())
