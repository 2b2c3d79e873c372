"""The stored keyword index gives what an index made anew gives, reads its terms' buckets alone, and is changed by what changes."""

import os

import pytest
from pyspark.sql import functions as F

from lodeweave.config import RetrievalOptions
from lodeweave.operators import retrieval
from lodeweave.operators.keyword_index import COUNT, POSTINGS, KeywordIndex, named
from lodeweave.plans.engine import Engine
from lodeweave.sources.store import TableStore
from lodeweave.sources.tables import FunctionSource

WORDS = "harbour lantern copper meadow thistle granite willow ember cobalt saffron".split()
O = RetrievalOptions()


def text(i, r=0):
    return f"Letter {i} about {WORDS[i % 10]} and {WORDS[(i * 3 + r) % 10]}, sent in year {i + r}. It is signed."


def source(spark, texts):
    rows = [("s", f"d{i}", k, t) for i, ts in texts.items() for k, t in enumerate(ts)]
    frame = spark.createDataFrame(rows, "source_key string, external_id string, position int, text string")
    documents = frame.select("source_key", "external_id", F.lit("t").alias("title"), F.lit(None).cast("string").alias("metadata")).distinct()
    return FunctionSource("s", lambda _: documents, lambda _: frame)


def ranked(spark, index, frequencies, n):
    q = spark.createDataFrame(list(enumerate(["harbour lantern", "the ember year 7", "copper", "nothing here 99"])), "query_id int, question string")
    found = retrieval.lexical_search(q, index, frequencies, n, O)
    return sorted((r.query_id, r.chunk_id, round(r.score, 9), r["rank"]) for r in found.collect()), q


@pytest.fixture
def made(spark, tmp_path):
    store, e = TableStore(spark, str(tmp_path / "store"), buckets=16), Engine(spark)
    index = KeywordIndex(store)
    e.register(source(spark, {i: [text(i)] for i in range(30)}))
    e.ingest_into(store, "s", keywords=index)
    return store, e, index


def same(spark, store, index):
    chunks = named(store.read("chunks"))
    fresh = retrieval.postings(chunks)
    want, q = ranked(spark, fresh, retrieval.document_frequencies(fresh), chunks.count())
    got, _ = ranked(spark, *index.lookup(q, O))
    assert got == want and want
    assert store.facts()[COUNT] == chunks.count()


def test_changes(spark, made):
    store, e, index = made
    same(spark, store, index)
    before = store.read(POSTINGS).count()
    # two texts change, one document is new, one goes; a text comes back later
    for step, (texts, gone) in enumerate([({3: [text(3, 1)], 4: [text(4, 5)], 40: [text(40)]}, [5]), ({3: [text(3)], 6: [text(6)]}, []), ({5: [text(5)], 7: [text(7, 2), text(7)]}, [])]):
        e.register(source(spark, texts))
        away = spark.createDataFrame([("s", f"d{i}") for i in gone], "source_key string, external_id string")
        e.ingest_into(store, "s", gone=away, keywords=index)
        same(spark, store, index)
        added = store.read(POSTINGS).count() - before
        assert added < 12 * 12, "only changed chunks have new postings"
        before += added
    assert store.read(POSTINGS).where("sign < 0").count() > 0
    assert index.compact(files=1) and not index.compact(files=1)
    assert store.read(POSTINGS).where("sign <> 1").count() == 0 and store.read(POSTINGS).count() == store.read(POSTINGS).select("term", "chunk_id").distinct().count()
    same(spark, store, index)


def test_a_search_reads_its_terms_alone(spark, made):
    store, e, index = made
    q = spark.createDataFrame([(0, "harbour")], "query_id int, question string")
    found, _, _ = index.lookup(q, O)
    every = {f for f in store.read(POSTINGS).inputFiles()}
    assert 1 <= len(found.inputFiles()) <= 2 < len(every)
    plan = found._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "PushedFilters" in plan and "harbour" in plan and "Exchange" not in plan
    hits = e.search("harbour", index=index).collect()
    assert {r.external_id for r in hits} >= {"d0", "d10", "d20"}
    assert {r.external_id for r in e.search("harbour", index=index, external_ids=["d10"]).collect()} == {"d10"}


def test_an_index_that_is_empty(spark, tmp_path):
    index = KeywordIndex(TableStore(spark, str(tmp_path / "none")))
    q = spark.createDataFrame([(0, "harbour")], "query_id int, question string")
    assert retrieval.lexical_search(q, *index.lookup(q, O), O).count() == 0 and not index.compact()
    assert not os.path.exists(tmp_path / "none" / "_versions")
