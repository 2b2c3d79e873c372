"""Ranges that overlap against all pairs, embedding runs that fail and go on, and evaluations of a search."""

import json
import random
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lodeweave.config import EngineConfig, RetrievalOptions
from lodeweave.operators.embedding_run import VECTORS, EmbeddingRun
from lodeweave.operators.ingest import HashingEmbedder, is_stale
from lodeweave.operators.ranges import overlap_join
from lodeweave.plans.engine import Engine
from lodeweave.sources.store import TableStore
from lodeweave.sources.tables import FunctionSource, read_eval_cases

CHUNK = "doc_id long, embedding_input string, embedding array<float>, embedding_model string, embedding_dimensions int, embedded_at timestamp_ntz"


def ranges(rng, n, widest):
    out = []
    for i in range(n):
        a = rng.randrange(-5000, 5000)
        b = a + rng.choice([-3, 0, 0, 1, 2, 7, rng.randrange(widest)])
        out.append((i % (n - 5), rng.choice(["x", "y", None]), None if rng.random() < 0.03 else a, None if rng.random() < 0.03 else b))
    return out


@pytest.mark.parametrize(("widest", "on"), [(10, []), (3000, []), (200, ["k"])])
def test_overlaps_are_those_of_all_pairs(spark, widest, on):
    rng = random.Random(widest)
    left, right = ranges(rng, 150, widest), ranges(rng, 150, 40)
    low = lambda v: -(10**9) if v is None else v
    high = lambda v: 10**9 if v is None else v
    want = Counter((p[0], q[0]) for p in left for q in right if low(p[2]) <= high(p[3]) and low(q[2]) <= high(q[3]) and low(p[2]) <= high(q[3]) and low(q[2]) <= high(p[3]) and (not on or p[1] is not None and p[1] == q[1]))
    a = spark.createDataFrame(left, f"i int, {'k' if on else 'k1'} string, a int, b int")
    b = spark.createDataFrame(right, f"j int, {'k' if on else 'k2'} string, c int, d int")
    got = overlap_join(a, b, ("a", "b"), ("c", "d"), on)
    assert Counter((r.i, r.j) for r in got.collect()) == want and want
    plan = got._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_short_ranges_do_not_meet_in_wide_bins(spark):
    """2000 moments on each side, and one range over all of them: as candidates only its own pairs, and the moments that are equal or nearly so."""
    a = spark.range(2000).select(F.col("id").alias("i"), (F.col("id") * 10).alias("a"), (F.col("id") * 10).alias("b"))
    b = spark.range(2000).select(F.col("id").alias("j"), (F.col("id") * 10 + 5).alias("c"), F.when(F.col("id") == 0, 10**6).otherwise(F.col("id") * 10 + 5).alias("d"))
    got = overlap_join(a, b, ("a", "b"), ("c", "d"))
    assert got.count() == 1999
    assert overlap_join(a.limit(0), b, ("a", "b"), ("c", "d")).count() == 0 and overlap_join(a, b.limit(0), ("a", "b"), ("c", "d")).count() == 0
    with pytest.raises(ValueError, match="both sides"):
        overlap_join(a, a, ("a", "b"), ("a", "b"))


def paid(folder, bad=None, dimensions=8):
    """A provider that notes each text that it answers, and refuses one text until a file is there; and what it has noted."""
    folder, inner = str(folder), HashingEmbedder(dimensions)

    def provider(texts):
        import json
        import os
        import uuid

        if bad in texts and not os.path.exists(f"{folder}/well"):
            raise RuntimeError("not now")
        with open(f"{folder}/{uuid.uuid4().hex}.json", "w") as f:
            json.dump(texts, f)
        return inner(texts)

    return provider, lambda: Counter(t for p in Path(folder).glob("*.json") for t in json.loads(p.read_text()))


def test_a_run_goes_on_where_it_stopped(spark, tmp_path):
    texts = [f"letter number {i}" for i in range(200)]
    # every text twice, a text of none, and an empty one
    rows = [(n, t, None, None, None, None) for n, t in enumerate([*texts, *texts, None, ""])]
    chunks, (provider, noted) = spark.createDataFrame(rows, CHUNK), paid(tmp_path, texts[77])
    store = TableStore(spark, str(tmp_path / "store"), buckets=4)
    run = EmbeddingRun(store, provider, "m", 8, batch=10, wave_groups=7, task_groups=2)
    first = run.run(chunks)
    refused = sum(w["refused"] for w in first)
    assert len(first) == 3 and 1 <= refused <= 10 and sum(w["answered"] for w in first) == 201 - refused
    half = run.apply(chunks)
    assert half.where("embedding IS NULL AND embedding_input IS NOT NULL").select("embedding_input").distinct().count() == refused
    assert store.read(VECTORS).where("error = 'RuntimeError: not now'").count() == refused
    (tmp_path / "well").touch()
    again = run.run(chunks)
    assert sum(w["answered"] for w in again) == refused and not sum(w["refused"] for w in again)
    assert run.run(chunks) == []
    assert noted() == Counter({*texts, ""}), "each text is paid for once"
    done = run.apply(chunks)
    assert done.count() == 402 and done.where(is_stale("m", 8)).count() == 1
    assert run.apply(done).where("embedding IS NULL").count() == 1
    # a provider that is away ends the run with its first wave
    other = EmbeddingRun(store, lambda t: t[:0], "n", 8, batch=10, wave_groups=7)
    assert [w["answered"] for w in other.run(chunks)] == [0]
    assert EmbeddingRun(store, provider, "m", 8).run(chunks.limit(0)) == []


def source(spark, key, texts):
    documents = spark.createDataFrame([(key, n, "t") for n in texts], "source_key string, external_id string, title string").withColumn("metadata", F.lit(None).cast("string"))
    return FunctionSource(key, lambda _: documents, lambda _: spark.createDataFrame([(key, n, p, t) for n, ts in texts.items() for p, t in enumerate(ts, 1)], "source_key string, external_id string, position int, text string"))


def test_an_engine_embeds_later(spark, tmp_path):
    provider, noted = paid(tmp_path)
    e = Engine(spark, EngineConfig(dimensions=8), provider)
    e.register(source(spark, "s", {f"d{i}": [f"A letter of harbour {i}. It is signed."] for i in range(6)}))
    store = TableStore(spark, str(tmp_path / "store"), buckets=4)
    e.ingest_into(store, "s", defer=True)
    assert not noted() and store.read("chunks").where("embedding IS NOT NULL").count() == 0
    assert [w["answered"] for w in e.embed_into(store, "s")] == [6]
    assert store.read("chunks").where("embedding IS NULL").count() == 0 and {r.status for r in store.read("documents").collect()} == {"embedded"}
    version = store.version()
    assert e.embed_into(store, "s") == [] and store.version() == version and set(noted().values()) == {1}


def test_evaluation(spark, tmp_path):
    e = Engine(spark)
    e.register(source(spark, "s", {f"d{i}": [f"{w} stands by the road. It is old."] for i, w in enumerate("harbour lantern copper meadow thistle".split())}))
    e.documents, e.chunks, _ = e.ingest("s")
    e.register(source(spark, "z", {"d0": ["harbour lamp stands by the road. It is old."]}))
    e.documents, e.chunks, _ = e.ingest("z")
    cases = [
        {"id": "a", "question": "harbour", "category": "one", "sources": ["s"], "expected": [{"document_id": "d0"}]},
        {"question": "lantern", "expected": [{"document_id": "d1", "source": "s", "pages": [1, 3]}, {"document_id": "nothing"}]},
        {"id": "c", "question": "copper", "expected": [{"document_id": "d2", "page": 9}]},
        {"id": "d", "question": "harbour", "category": "one", "sources": ["s"], "expected": [{"document_id": "d0", "source": "z"}]},
        {"id": "e", "question": "meadow"},
    ]
    path = tmp_path / "cases.json"
    path.write_text(json.dumps(cases))
    read = read_eval_cases(spark, str(path))
    report, ranks = e.evaluate(read, {"both": RetrievalOptions(min_score=0), "vectors": RetrievalOptions(min_score=0, lexical=False)}, k=3)
    assert {(r.run, r.case_id): r.first_rank for r in ranks.collect()} == {(run, c): n for run in ("both", "vectors") for c, n in (("a", 1), ("2", 1), ("c", None), ("d", None), ("e", None))}
    got = {(r.run, r.category): (r.cases, r.recall_1, r.recall_3, r.mrr) for r in report.collect()}
    assert got == {(run, c): v for run in ("both", "vectors") for c, v in (("all", (5, 0.4, 0.4, 0.4)), ("one", (2, 0.5, 0.5, 0.5)), ("general", (3, 0.3333, 0.3333, 0.3333)))}
    assert [r.case_id for r in read_eval_cases(spark, str(path), ["one"], ["d", "c"]).collect()] == ["d"]
    assert e.evaluate(read.limit(0))[0].count() == 0
