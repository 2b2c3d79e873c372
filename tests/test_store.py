"""Stored tables: only touched buckets are rewritten, a writer that dies leaves the version before, a second writer on one version fails; and documents captured from a stream."""

import os

import pytest
from pyspark.sql import functions as F

from lodeweave.plans.engine import Engine
from lodeweave.sources.store import Change, Conflict, TableStore
from lodeweave.sources.tables import FunctionSource
from lodeweave.streaming.streams import capture, capture_batch


def files(path, table):
    return {os.path.join(d, f) for d, _, names in os.walk(f"{path}/{table}") for f in names if f.endswith(".parquet")}


def rows(store, table="t", **k):
    return sorted(map(tuple, store.read(table, **k).collect()))


@pytest.fixture
def store(spark, tmp_path):
    s = TableStore(spark, str(tmp_path / "store"), buckets=8)
    assert s.version() == 0 and s.read("t") is None
    d = spark.range(200).select(F.col("id"), F.lit("old").alias("v"))
    assert s.commit([Change("t", ("id",), d, d)], {"made": 1}) == 1
    return s


def test_only_touched_buckets_are_rewritten(spark, store):
    before = files(store.path, "t")
    new = spark.createDataFrame([(7, "new"), (7, "twice"), (500, "more")], "id long, v string")
    keys = new.unionByName(spark.createDataFrame([(8, "")], "id long, v string"))
    named = store.state()["tables"]["t"]["at"]
    assert store.commit([Change("t", ("id",), new, keys)]) == 2
    after = store.state()["tables"]["t"]["at"]
    assert 1 <= sum(after[b] != p for b, p in named.items()) <= 3 and before < files(store.path, "t")
    assert rows(store) == sorted([(i, "old") for i in range(200) if i not in (7, 8)] + [(7, "new"), (7, "twice"), (500, "more")])
    assert rows(store, version=1) == [(i, "old") for i in range(200)] and store.facts() == {"made": 1}
    one = store.read("t", keys=spark.createDataFrame([(7,)], "id long"))
    assert len(one.inputFiles()) < len(store.read("t").inputFiles()) and one.where("id = 7").count() == 2
    gone = store.vacuum(keep=1)
    assert gone and rows(store) == sorted([(i, "old") for i in range(200) if i not in (7, 8)] + [(7, "new"), (7, "twice"), (500, "more")])


def test_a_table_can_become_empty(spark, store):
    every = store.read("t")
    store.commit([Change("t", ("id",), every.limit(0), every)])
    assert rows(store) == [] and store.read("t").columns == ["id", "v"]
    store.commit([Change("t", ("id",), every.limit(3), every)])
    assert len(rows(store)) == 3


def test_a_writer_that_dies_changes_nothing(spark, store, monkeypatch):
    monkeypatch.setattr(TableStore, "_publish", lambda *a: (_ for _ in ()).throw(RuntimeError("killed")))
    new = spark.createDataFrame([(7, "new")], "id long, v string")
    with pytest.raises(RuntimeError):
        store.commit([Change("t", ("id",), new, new), Change("u", ("id",), new, new)])
    monkeypatch.undo()
    assert store.version() == 1 and rows(store) == [(i, "old") for i in range(200)] and store.read("u") is None


def test_two_writers(spark, store):
    new = spark.createDataFrame([(7, "new")], "id long, v string")
    base = store.version()
    store.commit([Change("t", ("id",), new, new)], base=base)
    with pytest.raises(Conflict):
        store.commit([Change("t", ("id",), new.withColumn("v", F.lit("other")), new)], base=base)
    assert (7, "new") in rows(store) and store.version() == 2
    with pytest.raises(ValueError):
        store.commit([Change("t", ("id",), spark.range(50).select("id", F.lit("x").alias("v")), new)])


SEGMENTS = "external_id string, title string, revision long, position int, text string"


def state(store):
    documents = store.read("documents").select("source_key", "external_id", "title", F.col("metadata")["revision"], "content_checksum", "params_checksum", "status", "chunk_count", "embedded_chunk_count")
    chunks = store.read("chunks").select("external_id", "ordinal", "content", "content_hash", "position_start", "position_end", "embedding_model", F.col("embedding").cast("string"))
    return sorted(map(tuple, documents.collect())), sorted(map(tuple, chunks.collect()), key=repr)


def text(i, k, r):
    return f"Document {i} has a segment {k} in revision {r}. " + " ".join(f"It says word {j} again." for j in range(60))


def test_three_batches_one_of_them_twice(spark, tmp_path):
    batches = [
        [(f"d{i}", f"t{i}", 1, k, text(i, k, 1)) for i in range(12) for k in range(3)],
        [(f"d{i}", f"T{i}", 2, k, text(i, k, 2 if k else 1)) for i in (0, 1) for k in range(3)] + [("d2", "t2", 2, None, None), ("d0", "late", 1, 0, "an older one")],
        [("d3", "t3", 5, 0, text(3, 0, 5)), ("d3", "t3", 4, 0, text(3, 0, 4)), ("d20", "t20", 1, 0, text(20, 0, 1)), ("d4", "t4", 1, 0, "of a revision that is there")],
    ]
    paid = []

    class Embedder:
        def __call__(self, texts):
            paid.append(len(texts))
            return [[float(len(t)), 1.0] for t in texts]

    from dataclasses import replace

    from lodeweave.config import EngineConfig

    engine = lambda: Engine(spark, replace(EngineConfig(), dimensions=2), Embedder())
    streamed = TableStore(spark, str(tmp_path / "streamed"), buckets=8)
    folder = tmp_path / "in"
    for n, rows_ in enumerate(batches):
        spark.createDataFrame(rows_, SEGMENTS).coalesce(1).write.mode("append").parquet(str(folder))
        stream = spark.readStream.schema(SEGMENTS).option("maxFilesPerTrigger", 1).parquet(str(folder))
        q = capture(stream, engine(), streamed, "s", str(tmp_path / "checkpoint"))
        q.awaitTermination(120)
        assert q.exception() is None and streamed.facts() == {"stream:s": n}
        named = streamed.state()["tables"]
        # the same batch again: nothing is written
        assert not capture_batch(engine(), streamed, "s", spark.createDataFrame(rows_, SEGMENTS), n)
        assert streamed.state()["tables"] == named
    final = [x for x in batches[0] if x[0] not in ("d0", "d1", "d2", "d3")] + [x for x in batches[1] if x[0] == "d1" or x[:3] == ("d0", "T0", 2)] + [batches[2][0], batches[2][2]]
    frame = spark.createDataFrame(final, SEGMENTS).withColumn("source_key", F.lit("s"))
    documents = frame.groupBy("source_key", "external_id").agg(F.max("title").alias("title"), F.create_map(F.lit("revision"), F.max("revision").cast("string")).alias("metadata"))
    whole, e = TableStore(spark, str(tmp_path / "whole"), buckets=8), engine()
    e.register(FunctionSource("s", lambda _: documents, lambda _: frame.select("source_key", "external_id", "position", "text")))
    e.ingest_into(whole, "s")
    assert state(streamed) == state(whole)
    # a run over unchanged documents makes no version, and reads on
    before = whole.version()
    e.ingest_into(whole, "s")
    assert whole.version() == before and e.chunks.count() == len(state(whole)[1])
