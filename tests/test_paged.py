"""Sources that functions page through: pieces, pushed conditions, counting, finding and ingestion."""

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In, LessThanOrEqual

from lodeweave.plans.engine import Engine
from lodeweave.sources.paged import narrowed, paged_source, pushed
from lodeweave.sources.tables import SourceRegistry


def pages(folder, n=40):
    """Documents d000, d001 and so on; each call notes its range."""
    folder = str(folder)

    def between(low, high, kind):
        import json
        import uuid

        with open(f"{folder}/{uuid.uuid4().hex}.json", "w") as f:
            json.dump([kind, low, high], f)
        for i in range(n):
            d = f"d{i:03d}"
            if (low is None or d >= low) and (high is None or d < high):
                yield d, i

    def documents(low, high):
        for d, i in between(low, high, "documents"):
            yield d, None if i == 3 else f"Letter {i}", {"n": str(i)}
        if low is None:
            yield None, "no id", None

    def segments(low, high):
        for d, i in between(low, high, "segments"):
            for p in (1, 2):
                yield d, p, f"Page {p} of letter {i}. It is signed."

    return documents, segments


def calls(folder):
    return sorted((json.loads(p.read_text()) for p in Path(folder).glob("*.json")), key=lambda c: str(tuple(c[1:])))


def source(spark, folder, key):
    return paged_source(spark, key, ["d010", "d020", "d030"], *pages(folder))


def test_reading_in_pieces(spark, tmp_path):
    s = source(spark, tmp_path, "pieces")
    got = s.documents()
    assert got.rdd.getNumPartitions() == 4
    assert sorted((r.source_key, r.external_id, r.title, r.metadata["n"]) for r in got.collect()) == [("pieces", f"d{i:03d}", None if i == 3 else f"Letter {i}", str(i)) for i in range(40)]
    assert [(a, b) for _, a, b in calls(tmp_path)] == sorted([(None, "d010"), ("d010", "d020"), ("d020", "d030"), ("d030", None)], key=str)


@pytest.mark.parametrize(
    ("where", "count", "ranges"),
    [
        ("external_id = 'd017'", 1, [("d017", "d017\0")]), ("external_id IN ('d035', 'd001', 'zz')", 2, [("d001", "d001\0"), ("d035", "d035\0"), ("zz", "zz\0")]),
        ("external_id > 'd017' AND external_id <= 'd022'", 5, [("d017\0", "d020"), ("d020", "d022\0")]), ("external_id = 'd017' AND external_id = 'd018'", 0, []), ("title = 'Letter 12'", 1, None),
    ],
)
def test_conditions_are_pushed(spark, tmp_path, where, count, ranges):
    assert source(spark, tmp_path, "conditions").documents().where(where).count() == count
    got = [(a, b) for _, a, b in calls(tmp_path)]
    assert len(got) == 4 if ranges is None else sorted(got) == ranges


def test_count_find_and_ingest(spark, tmp_path):
    registry = SourceRegistry()
    registry.register(source(spark, tmp_path, "letters"))
    s = registry.get("letters")
    assert s.count_documents().first()[0] == 40 and s.count_documents({"external_ids": ["d001", "d039", "none"]}).first()[0] == 2
    before = len(calls(tmp_path))
    assert s.find_document("d033").first().title == "Letter 33" and len(calls(tmp_path)) == before + 1
    assert s.find_document("none").count() == 0 and s.documents({"external_ids": []}).count() == 0
    e = Engine(spark)
    e.register(s)
    documents, chunks, _ = e.ingest("letters")
    assert documents.count() == 40 and chunks.where(F.col("content").contains("Page 2 of letter 17.")).select("external_id").distinct().collect()[0][0] == "d017"


def test_ranges():
    pieces = [(None, "f"), ("f", "p"), ("p", None)]
    assert narrowed(pieces, "g", "g") == [] and narrowed(pieces, None, None) == pieces and narrowed(pieces, "a", "q") == [("a", "f"), ("f", "p"), ("p", "q")]
    assert pushed(pieces, [GreaterThan(("k",), "b"), LessThanOrEqual(("k",), "f"), EqualTo(("other",), "z")], "k") == [("b\0", "f"), ("f", "f\0")]
    assert pushed(pieces, [In(("k",), ("q", "a")), EqualTo(("k",), "q")], "k") == [("q", "q\0")]
