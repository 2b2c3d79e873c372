"""Stems against vectors of the published rules, and searches by stems against brute force."""

import math
import re
from collections import defaultdict
from dataclasses import replace

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from lodeweave.config import EngineConfig, RetrievalOptions
from lodeweave.functions.stems import ENGLISH_STOP, GERMAN_STOP, english, german, stemmer
from lodeweave.functions.text import fold_accents
from lodeweave.operators import retrieval
from lodeweave.operators.keyword_index import KeywordIndex
from lodeweave.plans.engine import Engine
from lodeweave.plans.run_queries import stemmed_search
from lodeweave.sources.store import TableStore
from lodeweave.sources.tables import FunctionSource

# Words and stems of the published sample vocabularies.
ENGLISH = """consign consign consigned consign consignment consign consistency consist consistently consist consolation consol consolatory consolatori console consol consolidating consolid consonant conson conspicuously conspicu
conspiracy conspiraci conspirators conspir conspiring conspir constables constabl constancy constanc knackeries knackeri knavish knavish kneaded knead kneel kneel knees knee knightly knight knitted knit knives knive knocker knocker
skies sky dying die early earli generate generat generously generous communism communism inning inning happy happi by by say say hopping hop hoping hope agreed agre relational relat ties tie cries cri gas gas this this""".split()
GERMAN = """aufeinander aufeinand aufeinanderfolgenden aufeinanderfolg aufeinanderschlügen aufeinanderschlug aufenthaltes aufenthalt auferlegten auferlegt auffallend auffall auffälligen auffall aufforderung aufforder kategorien kategori
kategorischen kategor katers kat kätzchen katzch käufer kauf kauffahrer kauffahr kaufleute kaufleut kaufmann kaufmann kellerei kellerei keineswegs keinesweg keit keit""".split()


@pytest.mark.parametrize(("stem", "words"), [(english, ENGLISH), (german, GERMAN)])
def test_published_vectors(stem, words):
    assert [(w, stem(w)) for w in words[::2]] == list(zip(words[::2], words[1::2], strict=True))


def test_any_word_has_a_stem():
    import itertools

    for letters in ("aeylsd'", "eniugs"):
        for n in range(6):
            for w in map("".join, itertools.product(letters, repeat=n)):
                assert len(english(w)) <= len(w) + 1 and len(german(w)) <= len(w) + 1
    for w in ("ß", "ñandú", "x" * 10_000, "12", "日本語"):
        assert isinstance(english(w), str) and isinstance(german(w), str)


def test_lists(spark):
    rows = [(1, ["walking", "the", "walked", "lantern", "lanterns"]), (2, []), (3, None), (4, ["the", "and"])]
    df = spark.createDataFrame(rows, "id int, words array<string>")
    got = {r.id: r.s for r in df.select("id", stemmer("english")(F.col("words")).alias("s")).collect()}
    assert got == {1: ["walk", "lantern"], 2: [], 3: None, 4: []}
    # a stop word is one after its accents are gone, too
    assert df.select(stemmer("german")(F.array(F.lit("wurden"), F.lit("eines"), F.lit("katers")))).first()[0] == ["kat"]
    assert stemmer("simple") is None and "the" in ENGLISH_STOP and "keinem" in GERMAN_STOP
    with pytest.raises(ValueError, match="klingon"):
        stemmer("klingon")


def test_search_against_brute_force(spark):
    o = replace(RetrievalOptions(), language="english")
    texts = {r.doc_id: r.t for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", F.lower(fold_accents("text")).alias("t")).collect()}
    asked = {r.item_id: r.t for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").select("item_id", F.lower(fold_accents("text")).alias("t")).collect()}
    stems = lambda words: {english(w) for w in words if w not in ENGLISH_STOP}
    lists, n = defaultdict(set), len(texts)
    for i, t in texts.items():
        for s in stems(re.findall(r"[^\W_]+", t or "")):
            lists[s].add(i)
    want = {}
    for q, t in asked.items():
        words = list(dict.fromkeys(w for w in re.findall(r"[^\W_]+", t or "") if len(w) >= 2))[: o.max_query_words]
        found = [(math.log(1 + (n - len(lists[s]) + 0.5) / (len(lists[s]) + 0.5)), s) for s in stems(words) if s in lists and (n < o.common_from or len(lists[s]) <= math.ceil(o.common_share * n))]
        score = defaultdict(float)
        for w, s in sorted(found, key=lambda x: (-x[0], x[1]))[: o.max_terms]:
            for i in lists[s]:
                score[i] += w
        for rank, (i, v) in enumerate(sorted(score.items(), key=lambda x: (-round(x[1], 9), x[0]))[: o.lexical_candidates], 1):
            want[q, i] = (round(v, 5), rank)
    got = {(r.query_id, r.doc_id): (round(r.score, 5), r["rank"]) for r in stemmed_search(spark, SMALL).collect()}
    assert got.keys() == want.keys() and want
    assert {k: v[1] for k, v in got.items()} == {k: v[1] for k, v in want.items()}
    assert all(abs(got[k][0] - want[k][0]) < 1e-4 for k in want)


def test_an_engine_and_its_index(spark, tmp_path):
    texts = {"d0": "She walked home with a lantern.", "d1": "The walker has two lanterns, and walks.", "d2": "It is the one and only harbour of this."}
    documents = spark.createDataFrame([("s", n, "t") for n in texts], "source_key string, external_id string, title string").withColumn("metadata", F.lit(None).cast("string"))
    segments = spark.createDataFrame([("s", n, 1, t) for n, t in texts.items()], "source_key string, external_id string, position int, text string")
    store = TableStore(spark, str(tmp_path / "store"), buckets=8)
    index = KeywordIndex(store, language="english")
    o = RetrievalOptions(min_score=1.1, language="english")  # vectors find nothing
    e = Engine(spark, EngineConfig(retrieval=o, dimensions=64))
    e.register(FunctionSource("s", lambda _: documents, lambda _: segments))
    e.ingest_into(store, "s", keywords=index)
    for given in (None, index, e.keyword_index()):
        find = lambda q: {r.external_id for r in e.search(q, index=given).collect()}  # noqa: B023, E731
        assert find("walking lantern") == {"d0", "d1"} and find("harbours") == {"d2"} and find("the and of this") == set()
    q = spark.createDataFrame([(0, "lanterns")], "query_id int, question string")
    assert retrieval.lexical_search(q, *index.lookup(q, RetrievalOptions()), o).count() == 2
    with pytest.raises(ValueError, match="english"):
        KeywordIndex(store).lookup(q, RetrievalOptions())
