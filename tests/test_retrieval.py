"""Fusion, diversity, de-duplication, keyword search, the pipeline, and filters."""

from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodeweave.config import EngineConfig, RetrievalOptions
from lodeweave.operators import answering, ingest, retrieval, runs
from lodeweave.plans.engine import Engine
from lodeweave.sources import filters as S
from lodeweave.sources.tables import GroupedSource, SegmentMap, SourceRegistry, TableSource


def unit(*v):
    return np.array(v, float) / np.linalg.norm(v)


def test_mmr():
    v, s = [unit(1, 0.02, 0), unit(1, 0.03, 0), unit(0.4, 0.9, 0)], [0.95, 0.94, 0.70]
    assert retrieval.mmr_order(s, v, 0.5, 2) == [0, 2] and retrieval.mmr_order(s, v, 1.0, 2) == [0, 1]
    assert retrieval.mmr_order([0.9, 0.8], [None, None], 0.5, 1) == [0]


def test_dedupe():
    assert retrieval.dedupe_order(["same", "same", "other"], [None] * 3, 1.0) == [0, 2]
    assert retrieval.dedupe_order([None] * 3, [unit(1, 0, 0), unit(0.999, 0.01, 0), unit(0, 1, 0)], 0.97) == [0, 2]


def test_fusion(spark):
    rows = [(0, c, 0, 1.0, r) for r, c in enumerate([1, 2, 3], 1)] + [(0, c, 1, 1.0, r) for r, c in enumerate([3, 4], 1)]
    f = retrieval.fuse(spark.createDataFrame(rows, "query_id int, chunk_id int, leg int, weight double, rank int"))
    assert [r.chunk_id for r in f.orderBy("position").collect()] == [3, 1, 2, 4]


def test_yes_probability(spark):
    assert spark.range(1).select(retrieval.yes_probability(F.lit(None).cast("double"), F.lit(None).cast("double"))).first()[0] == 0.5


def test_rerank(spark):
    hits = spark.createDataFrame([(1, 10, 0.9, 1, 0.1), (1, 11, 0.8, 2, 0.7), (2, 12, 0.9, 1, 0.5), (2, 13, 0.8, 2, 0.5)], "query_id int, chunk_id int, score double, position int, s double")
    out = retrieval.rerank(hits, F.col("s"), RetrievalOptions()).orderBy("query_id", "position").collect()
    assert [(r.chunk_id, r.score) for r in out] == [(11, 0.7), (10, 0.1), (12, 0.9), (13, 0.8)]


LIBRARY = [(1, "Il conto di Giovanni", "Giovanni paga il conto al beccaio della città"), (2, "La città", "la città dorme sotto la luna"), (3, "Viaggio", "la strada verso la costa")]


def test_keyword_search(spark):
    chunks = spark.createDataFrame(LIBRARY, "chunk_id int, title string, content string")
    index = retrieval.postings(chunks)
    ask = lambda q: retrieval.lexical_search(spark.createDataFrame([(0, q)], "query_id int, question string"), index, retrieval.document_frequencies(index), 3, RetrievalOptions()).orderBy("rank").collect()
    assert [r.chunk_id for r in ask("la città del beccaio")][0] == 1 and len(ask("la città del beccaio")) == 3
    assert {r.chunk_id for r in ask("citta")} == {1, 2}
    assert ask("?!") == []
    stem = lambda c: F.substring(c, 1, 4)
    index = retrieval.postings(chunks, stem=stem)
    q = spark.createDataFrame([(0, "dormire")], "query_id int, question string")
    assert [r.chunk_id for r in retrieval.lexical_search(q, index, retrieval.document_frequencies(index), 3, RetrievalOptions(), stem=stem).collect()] == [2]


def test_neighbours(spark):
    chunks = spark.createDataFrame([(i, "d", i) for i in range(6)], "chunk_id int, document_id string, ordinal int")
    hits = spark.createDataFrame([(0, 2, 0.9, 1), (0, 3, 0.5, 2)], "query_id int, chunk_id int, score double, rank int")
    out = retrieval.expand_neighbours(hits, chunks, 1).orderBy("position").collect()
    assert [(r.chunk_id, round(r.score, 3), r.neighbour) for r in out] == [(2, 0.9, False), (1, 0.891, True), (4, 0.891, True), (3, 0.5, False)]


def test_filters(spark):
    assert S.as_list("1, 2 ,3") == ["1", "2", "3"] and S.as_bounds("10-50") == S.as_bounds("10..50") == ("10", "50")
    assert S.as_bounds({"from": 10, "to": None}) == ("10", None) and S.as_bool("false") is False
    assert [S.is_blank(v) for v in (None, "", [], False, 0)] == [True, True, True, False, False]
    assert S.parse_inputs(["a:1", "b: x:y", "c"]) == {"a": "1", "b": "x:y"} and S.narrow(["a", "b"], None) == ["a", "b"]
    df = spark.createDataFrame([("50%_a!",), ("50xya",)], "t string")
    assert df.where(S.contains_text(F.col("t"), "%_A!")).count() == 1
    assert df.where(S.any_of(F.col("t"), [])).count() == 0 and df.where(S.any_of(F.col("t"), None)).count() == 2


def test_grouped_source(spark):
    t = spark.createDataFrame([(x,) for x in ("Amalfi", "Atrani", "Amalfi Costiera", "Benevento", "Capri")], "title string")
    s = GroupedSource("titles", t, "upper(substr(title, 1, 1))", "title", title="Titles - :group", filters=S.FilterSet((S.Filter.like("title"),)))
    docs = {r.external_id: r for r in s.documents().collect()}
    assert set(docs) == {"A", "B", "C"} and docs["A"].title == "Titles - A" and docs["A"].metadata == {"entries": "3"}
    seg = s.segments({"title": "mal"}).orderBy("position").collect()
    assert [r.text for r in seg] == ["Amalfi", "Amalfi Costiera", "Atrani"] and s.count_documents({"title": "mal"}).first().documents == 1
    with pytest.raises(KeyError):
        SourceRegistry().get("nope")


def test_budget_and_citations(spark):
    hits = spark.createDataFrame([(0, 1, 7000), (0, 2, 10), (1, 1, 5000), (1, 2, 900), (1, 3, 200), (1, 4, 10)], "query_id int, rank int, token_count int")
    assert [(r.query_id, r.rank) for r in answering.budget(hits).orderBy("query_id", "rank").collect()] == [(0, 1), (1, 1), (1, 2)]
    a = spark.createDataFrame([(1, "Yes [#2] and [#9]."), (2, "No."), (3, " ")], "query_id int, answer string")
    c = spark.createDataFrame([(q, m) for q in (1, 2, 3) for m in (1, 2)], "query_id int, marker int")
    out = {r.query_id: r for r in answering.judge_answers(a, c).collect()}
    assert out[1].answer == "Yes [#2] and." and out[1].used == [2] and not out[1].refused and out[2].refused and out[3].refused
    r = spark.range(1).select(answering.rewrites(F.lit('{"queries": ["One?", "one?", "Two", "ask"]}'), F.lit("Ask"))).first()[0]
    assert r == ["One?", "Two"]
    r = spark.range(1).select(answering.rewrites(F.lit("- \"First\"\n2) Second\n\n* first"), F.lit("x"))).first()[0]
    assert r == ["First", "Second"]


def test_diff(spark):
    old = spark.createDataFrame([("s", "d", 0, "h1", 5), ("s", "d", 1, "h1", 5), ("s", "d", 2, "h2", 5)], "source_key string, external_id string, ordinal int, content_hash string, token_count int")
    new = spark.createDataFrame([("s", "d", 0, "h3", 7), ("s", "d", 1, "h1", 5)], old.schema)
    r = ingest.diff_summary(ingest.diff_chunks(old, new)).first()
    assert (r.created, r.reused, r.deleted, r.tokens) == (1, 1, 2, 7)


def test_costs(spark):
    prices = spark.createDataFrame([("text-small", 0.02), ("text-small-v2", 0.03), ("big", 1.0)], "model string, micros_per_token double")
    models = spark.createDataFrame([("text-small",), ("text-small-2025-01-31",), ("text-small-v2-x",), ("unknown",)], "model string")
    assert {r.model: r.micros_per_token for r in ingest.price(models, prices).collect()} == {"text-small": 0.02, "text-small-2025-01-31": 0.02, "text-small-v2-x": 0.03, "unknown": 0.0}


def test_engine(spark):
    rows = [("a", 1, "The butcher pays the bill. The town sleeps."), ("a", 2, "Another page about the harbour."), ("b", 1, "The moon over the harbour is white.")]
    pages = spark.createDataFrame(rows, "book string, number int, content string")
    books = spark.createDataFrame([("a", "First"), ("b", "Second")], "id string, title string")
    config = EngineConfig(dimensions=32, retrieval=replace(RetrievalOptions(), min_score=0.0))
    e = Engine(spark, config)
    e.register(TableSource("books", books, "id", SegmentMap.relation(pages, "book", "content", "number"), title="title"))
    e.documents, e.chunks, summary = e.ingest("books")
    e.documents, e.chunks = e.documents.persist(), e.chunks.persist()
    assert {r.external_id: r.status for r in e.documents.collect()} == {"a": "embedded", "b": "embedded"}
    assert sum(r.created for r in summary.collect()) == e.chunks.count()
    hits = e.search("moon harbour").orderBy("rank").collect()
    assert hits[0].external_id == "b" and e.search("  ").count() == 0
    assert e.fetch("books", "a").first().content.startswith("The butcher")
    again = e.ingest("books")[2].collect()
    assert again == []  # nothing has changed
    assert e.forget("books", "a")[0].count() == 1 and e.list_documents().count() == 2
    assert e.estimate("books").first().documents == 2


def test_stream(spark, tmp_path):
    from lodeweave.plans.queries import table
    from lodeweave.streaming.streams import daily_volume, hourly_counts

    folder = str(tmp_path / "events")
    table(spark, "/root/testdata/sf0.001", "events").withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(folder)
    stream = spark.readStream.schema(spark.read.parquet(folder).schema).parquet(folder)
    q = hourly_counts(stream, "ts").writeStream.outputMode("complete").format("memory").queryName("hours").start()
    q.processAllAvailable()
    q.stop()
    key = lambda r: (str(r.bucket), r.n)
    assert sorted(map(key, spark.table("hours").collect())) == sorted(map(key, hourly_counts(spark.read.parquet(folder), "ts").collect()))
    volume = daily_volume(stream, "ts", F.col("user_id") % 5 == 0).writeStream.outputMode("complete").format("memory").queryName("volume").start()
    volume.processAllAvailable()
    volume.stop()
    want = daily_volume(spark.read.parquet(folder), "ts", F.col("user_id") % 5 == 0)
    assert sorted(map(tuple, spark.table("volume").collect())) == sorted(map(tuple, want.collect()))


def test_index_recall(spark):
    from lodeweave.plans.queries import ivf_search, ivf_search_exhaustive

    exact = {(r.query_id, r.vec_id) for r in ivf_search_exhaustive(spark, "/root/testdata/sf0.01").collect()}
    found = {(r.query_id, r.vec_id) for r in ivf_search(spark, "/root/testdata/sf0.01").collect()}
    assert len(exact & found) / len(exact) >= 0.9


def test_engine_with_several_sources(spark):
    """A second source, a filter and new parameters leave other documents as they are; stored chunks are embedded without being read again; the provider is paid once."""
    calls = spark.sparkContext.accumulator(0)
    hashing = ingest.HashingEmbedder(32)

    def embed(texts):
        calls.add(len(texts))
        return hashing(texts)

    rows = [("a", 1, "The butcher pays the bill."), ("b", 1, "The moon over the harbour is white."), ("c", 1, "A letter from the sea.")]
    pages = spark.createDataFrame(rows, "book string, number int, content string")
    books = spark.createDataFrame([("a", "First"), ("b", "Second"), ("c", "Third")], "id string, title string")
    config = EngineConfig(dimensions=32, retrieval=replace(RetrievalOptions(), min_score=0.0))
    e = Engine(spark, config, embed)
    source = lambda key, ids: TableSource(key, books.where(F.col("id").isin(*ids)), "id", SegmentMap.relation(pages, "book", "content", "number"), title="title")
    e.register(source("one", ["a", "b"]))
    e.register(source("two", ["c"]))
    e.documents, e.chunks, _ = e.ingest("one")
    e.documents.collect(), e.chunks.collect()
    assert calls.value == 2
    e.documents, e.chunks, summary = e.ingest("two")
    assert sorted((r.source_key, r.external_id, r.status, r.chunk_count) for r in e.documents.collect()) == [("one", "a", "embedded", 1), ("one", "b", "embedded", 1), ("two", "c", "embedded", 1)]
    assert e.chunks.count() == 3 and calls.value == 3 and summary.count() == 1
    assert e.ingest("one")[2].count() == 0 and calls.value == 3
    e.documents, e.chunks = e.reindex()
    assert {r.status for r in e.documents.collect()} == {"chunked"} and e.chunks.where("embedding IS NOT NULL").count() == 0
    e.documents, e.chunks, _ = e.ingest("one", mode=ingest.EMBEDDINGS_ONLY)
    assert {r.external_id: r.status for r in e.documents.collect()} == {"a": "embedded", "b": "embedded", "c": "chunked"} and calls.value == 5
    index = e.keyword_index()
    assert {r.external_id for r in e.search("harbour moon", index=index).collect()} >= {"b"}
    assert {r.external_id for r in e.search("harbour moon", scopes={"one": lambda d: F.col("external_id") == "a", "two": None}).collect()} == {"a"}
    turned = e.search("harbour moon", reranker=lambda head: head.withColumn("new_score", F.when(F.col("content").contains("butcher"), 0.9).otherwise(0.1))).orderBy("rank").collect()
    assert turned[0].external_id == "a"
    more = spark.createDataFrame([(0, 1, "butcher")], "query_id long, rewrite int, question string")
    assert e.search("harbour", rewrites=more).count() == 2 and e.search("harbour moon", min_score=0.99).where("score < 0.99").count() <= 1
    kept = e.source("one")
    e.register(source("one", ["a"]))
    assert e.prune("one")[0].count() == 2 and kept is not None


def test_rate_limiter_and_retries():
    now, slept, failures = [0.0], [], [RuntimeError(), RuntimeError()]

    def sleep(s):
        slept.append(s)
        now[0] += s

    limiter = runs.RateLimiter(2, 60.0, clock=lambda: now[0], sleep=sleep)
    for _ in range(3):
        limiter.wait()
    assert slept == [60.0]

    def embed(texts):
        if failures:
            raise failures.pop()
        return [[1.0]] * len(texts)

    assert runs.with_retries(embed, sleep=sleep)(["a"]) == [[1.0]] and slept[1:] == [10, 30]


def test_knn_ties_and_passes(spark, monkeypatch):
    rows = [(i, [float(i % 3), 1.0]) for i in range(50)] + [(99, [0.0, 0.0]), (100, None)]
    d = spark.createDataFrame(rows, "id long, v array<double>")
    q = d.where("id < 7").select(F.col("id").alias("q"), "v")
    ask = lambda: sorted(tuple(r) for r in retrieval.knn_join(q, d, 4, query_id="q", id_col="id", vector_col="v", batch_rows=5).select("q", "id", "rank").collect())
    whole = ask()
    assert [x[1] for x in whole if x[0] == 0] == [0, 3, 6, 9] and len(whole) == 28
    monkeypatch.setattr(retrieval, "QUERY_ROWS", 2)
    assert ask() == whole


def test_knn_holds_k_of_equal_vectors(spark):
    """A partition hands over k rows of a query, however many vectors tie."""
    d = spark.range(100_000, numPartitions=4).select(F.col("id"), F.array(F.lit(1.0), F.lit(2.0)).alias("v"))
    q = spark.createDataFrame([(0, [1.0, 2.0]), (1, [2.0, 1.0])], "q int, v array<double>")
    got = retrieval.knn_join(q, d, 10, query_id="q", id_col="id", vector_col="v")
    assert sorted((r.q, r["rank"], r.id) for r in got.collect()) == [(i, k, k - 1) for i in (0, 1) for k in range(1, 11)]
    handed = retrieval._nearest(d, [0, 1], np.array([[1.0, 2.0], [2.0, 1.0]]), 10, q.schema["q"].dataType, "q", "id", "bigint", "v", 2048, False)
    assert handed.count() == 2 * 10 * 4


def test_only_the_ingested_source_is_embedded(spark):
    """After ``reindex`` an ingestion pays for its own source alone."""
    rows = [("a", str(i), 0, f"text {i} of the first source") for i in range(4)] + [("b", "0", 0, "one text of the second")]
    pages = spark.createDataFrame(rows, "s string, d string, n int, t string")
    e = Engine(spark)
    for key in ("a", "b"):
        own = pages.where(F.col("s") == key)
        e.register(TableSource(key, own.select("d").distinct(), "d", SegmentMap.relation(own.select("d", "n", "t"), "d", "t", "n")))
        e.documents, e.chunks, _ = e.ingest(key)
    assert e.chunks.where("embedded_at IS NOT NULL").count() == 5
    e.documents, e.chunks = e.reindex()
    e.documents, e.chunks, _ = e.ingest("b")
    assert {(r.source_key, r.embedded_at is not None) for r in e.chunks.collect()} == {("a", False), ("b", True)}
    assert e.chunks.count() == 5


def test_probed_lists_are_scored_as_blocks(spark):
    """Against brute force over the probed lists: a list that holds half of all rows, equal vectors, queries that are rows themselves, and queries whose lists are empty."""
    import numpy as np

    from lodeweave.operators import ann

    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 6))
    x[:300] = x[0]
    rows = [(f"c{n:04d}", [float(v) for v in r]) for n, r in enumerate(x)]
    corpus = spark.createDataFrame(rows, "chunk_id string, embedding array<double>").repartition(3)
    centroids = ann.unit(rng.normal(size=(8, 6)))
    index = ann.build_index(corpus, centroids)
    queries = spark.createDataFrame([(n, rows[n * 37][1]) for n in range(16)] + [(99, None)], "query_id long, embedding array<double>")
    for probes in (1, 3, 8):
        got = ann.search_index(queries, index, centroids, 7, probes)
        plan = got._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))
        assert "Join" not in plan
        u = ann.unit(x)
        own = np.argmax(u @ centroids.T, axis=1)
        want = set()
        for n in range(16):
            q = ann.unit([rows[n * 37][1]])[0]
            near = np.argsort(-(q @ centroids.T), kind="stable")[:probes]
            best = sorted((-round(float(u[i] @ q), 9), rows[i][0]) for i in np.flatnonzero(np.isin(own, near)))[:7]
            want |= {(n, c, r) for r, (_, c) in enumerate(best, 1)}
        assert {(r.query_id, r.chunk_id, r["rank"]) for r in got.collect()} == want
    assert ann.search_index(queries, index.limit(0), centroids, 7, 3).count() == 0
    # of all rows as the sample, the share that the fitted probes find is the target at least, and less with one probe fewer
    n = ann.fit_probes(index, centroids, 7, target=0.8, sample_queries=600)
    share = []
    exact = {(r.q, r.chunk_id) for r in retrieval.knn_join(corpus.withColumnRenamed("chunk_id", "q"), corpus, 7, query_id="q", exclude_self=True).collect()}
    nearest = np.argsort(-(u @ centroids.T), axis=1, kind="stable")
    for p in (n - 1, n):
        share.append(np.mean([own[int(c[1:])] in nearest[int(q[1:])][:p] for q, c in exact]))
    assert share[0] < 0.8 <= share[1]
    assert ann.fit_probes(index.limit(0), centroids, 7) == 8
