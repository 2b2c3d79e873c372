"""Questions that a model rewrites and answers: which of them reach it, how often, and what is logged."""

import pytest
from pyspark.sql import functions as F

from lodeweave.config import EngineConfig, RetrievalOptions
from lodeweave.operators import answering
from lodeweave.plans.engine import Engine
from lodeweave.sources.tables import SegmentMap, TableSource

QUESTIONS = "query_id long, question string"


@pytest.fixture(scope="module")
def engine(spark):
    pages = spark.createDataFrame([("a", 1, "The butcher paid the bill for the harbour."), ("b", 1, "A moon rose over the harbour."), ("c", 4, "Ink and paper, nothing else.")], "book string, number int, content string")
    books = spark.createDataFrame([("a", "Ledger"), ("b", ""), ("c", None)], "id string, title string")
    e = Engine(spark, EngineConfig(dimensions=32, retrieval=RetrievalOptions(min_score=0.99)))
    e.register(TableSource("books", books, "id", SegmentMap.relation(pages, "book", "content", "number"), title="title"))
    e.documents, e.chunks, _ = e.ingest("books")
    return e


@pytest.mark.parametrize(
    ("reply", "want"),
    [
        ('Sure:\n{"queries": ["One?", "one?", 7, null, "Two", "ask"]}\nDone.', ["One?", "Two"]),
        ('{"other": []}', ['{"other": []}']),
        ("1. First\r\n2) 'Second'\n\n* first\n-\tThird", ["First", "Second", "Third"]),
        ('{"queries": ["3.5 metres of rope", "2x4 wood"]}', ["metres of rope", "2x4 wood"]),
        ('{"queries": []}', []),
        ("x" * 601 + "\n" + "y" * 600, ["y" * 600]),
        ("{broken\nplain}", ["{broken", "plain}"]),
        ("", []),
        ("a\nb\nc\nd\ne\nf", ["a", "b", "c", "d"]),
    ],
)
def test_rewrites(spark, reply, want):
    assert spark.range(1).select(answering.rewrites(F.lit(reply), F.lit(" Ask "))).first()[0] == want


def test_a_quoted_question_is_not_rewritten(spark):
    q = spark.createDataFrame([(1, "plain"), (2, ' "exact words" '), (3, "“exact\nwords”"), (4, "«mots»"), (5, 'say "x" twice'), (6, " "), (7, None), (8, "silent"), (9, '"')], QUESTIONS)
    seen = []

    def model(asked):
        seen.append({r.query_id for r in asked.collect()})
        return asked.where("query_id <> 8").select("query_id", F.concat(F.lit("other "), "question").alias("reply"))

    got = {(r.query_id, r.rewrite, r.question) for r in answering.expand(q, model).collect()}
    assert seen == [{1, 5, 8, 9}] and got == {(1, 1, "other plain"), (5, 1, 'other say "x" twice'), (9, 1, "other")}
    assert answering.expand(q.limit(0), lambda a: a.select("query_id", F.col("question").alias("reply"))).count() == 0


def test_an_expander_widens_a_search(spark, engine):
    calls = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def say(_):
        calls.add(1)
        return '{"queries": ["butcher"]}'

    expander = lambda asked: asked.select("query_id", say("question").alias("reply"))
    assert {r.external_id for r in engine.search("moon").collect()} == {"b"} and calls.value == 0
    assert {r.external_id for r in engine.search("moon", expander=expander).collect()} == {"a", "b"} and calls.value == 1
    assert {r.external_id for r in engine.search('"moon"', expander=expander).collect()} == {"b"} and calls.value == 1


def test_a_reranker_reads_titles_and_the_part_that_matters(spark):
    long = "filler words here " * 120 + "the butcher of the harbour " + "further filler text " * 120
    pages = spark.createDataFrame([("a", 1, long), ("b", 1, "harbour")], "book string, number int, content string")
    books = spark.createDataFrame([("a", "Ledger"), ("b", None)], "id string, title string")
    from lodeweave.config import ChunkingOptions

    e = Engine(spark, EngineConfig(dimensions=16, chunking=ChunkingOptions(max_tokens=4000, target_tokens=3000), retrieval=RetrievalOptions(min_score=-1.0, rerank_chars=300)))
    e.register(TableSource("books", books, "id", SegmentMap.relation(pages, "book", "content", "number"), title="title"))
    e.documents, e.chunks, _ = e.ingest("books")
    read = []

    def reranker(head):
        read.extend(head.select("question", "content").collect())
        return head.withColumn("new_score", F.length("content") / 1000)

    rewrites = spark.createDataFrame([(0, 1, "butcher")], "query_id long, rewrite int, question string")
    assert e.search("harbour", rewrites=rewrites, reranker=reranker).orderBy("rank").first().external_id == "a"
    texts = {r.content.split("\n")[0]: r.content for r in read}
    assert {r.question for r in read} == {"harbour"} and set(texts) == {"Ledger", "harbour"}
    assert "butcher" in texts["Ledger"] and len(texts["Ledger"]) <= 320


def test_answers_are_asked_for_twice_at_most_and_logged(spark, engine):
    q = spark.createDataFrame([(1, "Moon"), (2, "harbour"), (3, "ink"), (4, "zebra"), (5, " "), (6, "bill"), (7, "paper")], QUESTIONS)
    calls = spark.sparkContext.accumulator(0)
    script = {1: "Rose [#1], says [#7].", 2: "No marker", 3: answering.REFUSAL, 6: "  ", 7: "Never any"}

    @F.udf("string")
    def say(i, prompt):
        calls.add(1)
        assert "Question:" in prompt and "[#1] " in prompt
        return "Again [#2]" if i == 2 and answering.REMINDER in prompt else script[i]

    model = lambda p: p.select("query_id", say("query_id", "prompt").alias("answer"), F.lit("m").alias("model"), F.lit(10).alias("prompt_tokens"), F.lit(2).alias("completion_tokens"))
    log, cited = engine.answer(q, model)
    got = {r.query_id: r for r in log.collect()}
    # five questions find something, and two of the answers lack markers; reading the log once more costs nothing
    assert calls.value == 7 and log.count() == 7 and calls.value == 7
    assert {i: r.answer for i, r in got.items()} == {1: "Rose [#1], says.", 2: "Again [#2]", **dict.fromkeys((3, 4, 5, 6, 7), answering.REFUSAL)}
    assert {i for i, r in got.items() if r.refused} == {3, 4, 5, 6, 7} and {i for i, r in got.items() if r.retried} == {2, 7}
    assert {i: r.prompt_tokens for i, r in got.items()} == {1: 10, 2: 20, 3: 10, 4: 0, 5: 0, 6: 10, 7: 20}
    assert {i: r.top_k for i, r in got.items()} == {1: 1, 2: 2, 3: 1, 4: 0, 5: 0, 6: 1, 7: 1} and got[2].retrieved_count == 2
    assert got[1].question_hash == spark.range(1).select(F.sha2(F.lit("moon"), 256)).first()[0]
    rows = {(r.query_id, r.marker): r for r in cited.collect()}
    assert set(rows) == {(1, 1), (2, 1), (2, 2), (3, 1), (6, 1), (7, 1)} and {k for k, r in rows.items() if r.used} == {(1, 1), (2, 2)}
    assert rows[1, 1].label == "1" and rows[6, 1].label == "Ledger - 1" and rows[7, 1].label == "4" and rows[7, 1].snippet == "Ink and paper, nothing else."


def test_answers_without_citations_and_with_history(spark, engine):
    seen = []

    def model(p):
        seen.append({r.query_id: r.prompt for r in p.collect()})
        return p.select("query_id", F.lit(" Plain. ").alias("answer"))

    history = spark.createDataFrame([(0, 2, "then?", "later"), (0, 1, "first?", "yes")], "query_id long, turn int, question string, answer string")
    log, cited = engine.answer("moon", model, history=history, require_citations=False)
    row = log.first()
    assert (row.answer, row.refused, row.retried, row.prompt_tokens, row.model) == ("Plain.", False, False, 0, None) and not cited.first().used
    assert len(seen) == 1 and seen[0][0].startswith("User: first?\nAssistant: yes\nUser: then?\nAssistant: later\n\n[#1] ") and seen[0][0].endswith("Question: moon")
