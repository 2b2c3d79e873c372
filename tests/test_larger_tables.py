"""Rows that only larger tables have, and steps whose cost must not grow faster than the input."""

import datetime
import random
from dataclasses import replace

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from lodeweave.config import EngineConfig, RetrievalOptions
from lodeweave.functions.slices import by_slices
from lodeweave.functions.stems import LISTS, _remembering, _stem_lists
from lodeweave.operators.keyword_index import POSTINGS, KeywordIndex
from lodeweave.operators.ranges import overlap_aggregate
from lodeweave.plans import run_queries  # noqa: F401
from lodeweave.plans.engine import Engine
from lodeweave.plans.queries import ORACLE_SQL, QUERIES
from lodeweave.sources.paged import parquet_rows
from lodeweave.sources.store import TableStore, apart
from lodeweave.streaming.streams import capture_batch


def against_sql(spark, name, folder, tables):
    """A query and its SQL over made-up tables."""
    con = duckdb.connect()
    for t, (rows, columns) in tables.items():
        spark.createDataFrame(rows, columns).coalesce(1).write.mode("overwrite").parquet(f"{folder}/{t}.parquet")
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    got, want = QUERIES[name](spark, str(folder)).toPandas(), con.sql(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got, sorted(got.columns)) == rows_of(want, sorted(got.columns))
    return got


@pytest.mark.parametrize("name", ["answer_log", "answer_citations"])
def test_an_order_of_many_lines_holds_against_sql(spark, tmp_path, name):
    lines = [(3 * o, 10 + n, 7, n % 7 + 1, 1.0, "R") for o, many in ((1, 12), (2, 2)) for n in range(many)]
    columns = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_returnflag string"
    against_sql(spark, name, tmp_path, {"lineitem": (lines, columns), "orders": ([(3, "1-URGENT"), (6, "2-HIGH"), (9, "5-LOW")], "o_orderkey long, o_orderpriority string")})


def test_words_that_cancel_out_hold_against_sql(spark, tmp_path):
    rows = [(1, "Onound, shonre thourein the.", "en"), (2, "", "de"), (3, "plain words", "de"), (4, None, None)]
    against_sql(spark, "embedding_run", tmp_path, {"documents": (rows, "doc_id long, text string, lang string")})


def test_paging_holds_pages_of_a_row_group(tmp_path):
    chance = random.Random(1)
    texts = [f"{chance.random()} " * 100 for _ in range(20_000)]
    pq.write_table(pa.table({"doc_id": list(range(20_000)), "text": texts}), f"{tmp_path}/t.parquet")
    base, most, found = pa.total_allocated_bytes(), 0, []
    for row in parquet_rows(f"{tmp_path}/t.parquet", "doc_id", ("text",), "15", "3"):
        found.append(row)
        most = max(most, pa.total_allocated_bytes() - base)
    assert found == [(str(n), texts[n]) for n in range(20_000) if "15" <= str(n) < "3"]
    assert most < 8 << 20 < sum(map(len, texts)) / 4


def test_python_holds_a_slice_of_a_batch():
    sizes = []

    def twice(some):
        sizes.append(len(some))
        return pa.array([None if v is None else 2 * v for v in some.to_pylist()], pa.int64())

    got = by_slices(twice, pa.int64(), 64, pa.array([None, *range(999)], pa.int64()))
    assert got.to_pylist() == [None, *range(0, 1998, 2)] and max(sizes) == 64
    assert by_slices(twice, pa.int64(), 64, pa.array([], pa.int64())).to_pylist() == []


def test_stems_of_a_batch_are_those_of_each_list():
    chance, one = random.Random(2), _remembering("english")
    words = ["running", "runs", "the", "cat", "cats", "and", "nation", "national", "x"]
    lists = [None if chance.random() < 0.1 else chance.choices(words, k=chance.randrange(9)) for _ in range(3 * LISTS + 5)]
    got = by_slices(lambda some: _stem_lists(some, one), pa.list_(pa.string()), LISTS, pa.array(lists, pa.list_(pa.string())))
    assert got.to_pylist() == [None if x is None else list(dict.fromkeys(s for s in map(one, x) if s)) for x in lists]


def test_counts_of_what_overlaps_against_all_pairs(spark):
    chance = random.Random(3)
    ranges = [[(n, a, a + chance.choice([-1, 0, 1, 6, 40, 200])) for n in range(150) for a in [chance.randrange(-60, 60)]] for _ in range(2)]
    ranges[0][0], ranges[1][0] = (0, None, 3), (0, 5, None)
    left, right = (spark.createDataFrame(r, f"{n} long, {n}_from long, {n}_to long") for r, n in zip(ranges, "lr"))
    got = overlap_aggregate(left, right, ("l_from", "l_to"), ("r_from", "r_to"), "r")
    usable = [[r for r in side if None not in r and r[1] <= r[2]] for side in ranges]
    want = {n: [m for m, c, d in usable[1] if c <= b and a <= d] for n, a, b in usable[0]}
    assert {r.l: (r["count"], r.least, r.greatest) for r in got.collect()} == {n: (len(m), min(m), max(m)) for n, m in want.items() if m}


def test_close_windows_make_no_pairs(spark, tmp_path):
    # 1500 purchases and 3000 views within a minute: 4.5 million pairs
    rows = [(n, datetime.datetime(2024, 1, 1, 0, 0, n % 60), "view" if n % 3 else "purchase") for n in range(4500)]
    got = against_sql(spark, "overlapping_windows", tmp_path, {"events": (rows, "event_id long, ts timestamp_ntz, event_type string")})
    assert got["events"].tolist() == [3000] * 1500
    assert "_longer" not in QUERIES["overlapping_windows"](spark, str(tmp_path))._jdf.queryExecution().toString()


def test_postings_have_ids_of_16_bytes(spark, tmp_path):
    index = KeywordIndex(TableStore(spark, f"file://{tmp_path}/store", buckets=2))
    chunks = spark.createDataFrame([("s", "a", 0, "h1", "red kite"), ("s", "b", 0, "h2", "red fox")], "source_key string, external_id string, ordinal int, content_hash string, content string")
    change, facts = index.change(None, chunks, {})
    index.store.commit([change], facts)
    assert {len(r.chunk_id) for r in index.store.read(POSTINGS).collect()} == {16}
    found, _, n = index.lookup(spark.createDataFrame([(1, "red kite")], "query_id int, question string"), RetrievalOptions())
    assert n == 2 and {(r.term, len(r.chunk_id)) for r in found.collect()} == {("red", 32), ("kite", 32)}


def shuffled(spark, work):
    """Bytes that the stages of ``work`` write for shuffles."""
    sc, jvm = spark.sparkContext, spark._jvm

    def stages():
        spark._jsc.sc().listenerBus().waitUntilEmpty()
        nothing = jvm.java.util.ArrayList()
        found = spark._jsc.sc().statusStore().stageList(nothing, False, False, sc._gateway.new_array(jvm.double, 0), nothing)
        return {(s.stageId(), s.attemptId()): s.shuffleWriteBytes() for s in (found.apply(n) for n in range(found.size()))}

    before = stages()
    work()
    return sum(n for k, n in stages().items() if k not in before)


def test_captured_texts_are_shuffled_once(spark, tmp_path):
    chance = random.Random(4)
    texts = {n: " ".join(f"{chance.getrandbits(64):x}" for _ in range(1500)) + "." for n in range(160)}
    size = sum(map(len, texts.values()))
    frame = lambda rows: spark.createDataFrame(rows, "external_id string, title string, revision long, position int, text string").repartition(3)
    store = TableStore(spark, f"file://{tmp_path}/store", buckets=4)
    take = lambda rows, n: capture_batch(Engine(spark, replace(EngineConfig(), dimensions=2)), store, "s", frame(rows), n)
    # beside the segments there are keys, checksums and counts; the rows that repartition() deals are of the test
    assert shuffled(spark, lambda: take([(f"d{n}", "t", 1, 0, t) for n, t in texts.items()], 0)) < 2.5 * size
    # three documents change and one goes: the rows of others are copied where they are read
    changed = [(f"d{n}", "u", 2, 0, texts[n] + " More.") for n in range(3)] + [("d3", "t", 2, None, texts[3])]
    assert shuffled(spark, lambda: take(changed, 1)) < 0.6 * size
    assert store.version() == 2 and {(r.external_id, r.title) for r in store.read("documents").collect()} == {(f"d{n}", "u" if n < 3 else "t") for n in texts if n != 3}
    chunks = {}
    for r in store.read("chunks").orderBy("ordinal").collect():
        chunks.setdefault(r.external_id, []).append(r)
    assert set(chunks) == {f"d{n}" for n in texts if n != 3} and all(c[0].content[:500] == texts[int(d[1:])][:500] for d, c in chunks.items())
    assert all((c[-1].content.endswith(" More.")) == (int(d[1:]) < 3) and c[-1].embedded_at for d, c in chunks.items())


def test_rows_that_a_bitmap_sets_apart(spark):
    rows = spark.range(20_000).select(F.col("id"), (F.col("id") % 7).alias("v")).unionByName(spark.createDataFrame([(None, 1), (None, 2)], "id long, v long"))
    keys = spark.range(0, 40_000, 9).select(F.col("id").cast("int").alias("id"))
    others, asked = apart(rows, keys, ("id",))
    others, asked = ([tuple(r) for r in part.collect()] for part in (others, asked))
    assert sorted(others + asked, key=repr) == sorted(map(tuple, rows.collect()), key=repr)
    assert not [i for i, _ in others if i is not None and i % 9 == 0] and len(asked) < 20_000 / 9 + 100
    assert [len(part.collect()) for part in apart(rows, keys.limit(0), ("id",))] == [20_002, 0]
