"""A keyword index in a store: postings in buckets by term, kept up to date by what changes.

Postings (term, chunk_id, sign) lie in buckets of their terms, sorted by term in each file, so a search opens its terms' buckets alone and skips the row groups of other terms. A chunk that comes adds postings of sign 1, one
that goes adds the same ones with sign -1; what is there is neither read nor rewritten. Signs are summed where a search groups by chunk anyway. ``compact`` rewrites buckets without what has cancelled.

A posting has its chunk's id as 16 bytes, half of what the id's text takes; an index that was begun with texts goes on with them.

Chunks are named by document, content and how many of this content came before in the document, so a chunk that only moves keeps its name and its postings.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodeweave.config import RetrievalOptions
from lodeweave.functions.stems import SIMPLE
from lodeweave.operators import retrieval
from lodeweave.operators.ingest import KEY
from lodeweave.sources.store import Change, TableStore

POSTINGS, COUNT, LANGUAGE = "postings", "keyword:chunks", "keyword:language"
#: Terms of a search that are pushed down to the files; of more, their buckets are still read alone.
PUSHED = 500


def named(chunks: DataFrame) -> DataFrame:
    """Chunks with ``chunk_id``, which stays the same where a chunk moves."""
    nth = F.row_number().over(Window.partitionBy(*KEY, "content_hash").orderBy("ordinal"))
    return chunks.withColumn("chunk_id", F.md5(F.concat_ws("\u0000", *KEY, "content_hash", nth.cast("string"))))


class KeywordIndex:
    """The postings of a store's chunks, by words or by the stems of a language (the same one as long as the store has an index)."""

    def __init__(self, store: TableStore, stem: retrieval.Stem | None = None, language: str = SIMPLE):
        self.store, self.stem, self.language = store, stem, language

    def _check(self, facts: dict) -> None:
        if facts.get(LANGUAGE, self.language) != self.language:
            raise ValueError(f"the index is one of {facts[LANGUAGE]!r}, not of {self.language!r}")

    def _packed(self) -> bool:
        entry = self.store.state()["tables"].get(POSTINGS)
        return entry is None or any(f["name"] == "chunk_id" and f["type"] == "binary" for f in entry["schema"]["fields"])

    def change(self, before: DataFrame | None, after: DataFrame, facts: dict) -> tuple[Change, dict]:
        """What a change of some documents' chunks (all of them ``before`` and ``after``) adds, and the facts to commit with it: of chunks that stay, nothing."""
        self._check(facts)
        new, own = named(after).select("chunk_id", "content"), ("chunk_id", "content")
        old = named(before).select(*own) if before is not None else new.limit(0)
        signed = lambda a, b, sign: a.join(b, "chunk_id", "left_anti").withColumn("sign", F.lit(sign))
        moved = signed(new, old, 1).unionByName(signed(old, new, -1))
        words = moved.select("chunk_id", "sign", F.explode(retrieval.index_words("content", self.language)).alias("term"))
        words = words if self.stem is None else words.select("chunk_id", "sign", self.stem(F.col("term")).alias("term")).distinct()
        n = facts.get(COUNT, 0) + (moved.agg(F.sum("sign")).first()[0] or 0)
        return Change(POSTINGS, ("term",), words.select("term", (F.unhex("chunk_id") if self._packed() else F.col("chunk_id")).alias("chunk_id"), F.col("sign").cast("byte").alias("sign")), sort=("term", "chunk_id")), {COUNT: n, LANGUAGE: self.language}

    def lookup(self, questions: DataFrame, o: RetrievalOptions, query_id: str = "query_id") -> tuple[DataFrame, DataFrame, int]:
        """(postings, document frequencies, chunks) of the questions' terms, as ``retrieval.lexical_search`` takes them."""
        facts = self.store.facts()
        self._check(facts)
        terms = retrieval.query_terms(questions, replace(o, language=self.language), query_id, stem=self.stem).select("term").distinct()
        found = self.store.read(POSTINGS, terms)
        if found is None:
            found = questions.sparkSession.createDataFrame([], "term string, chunk_id string, sign byte")
        some = [r.term for r in terms.limit(PUSHED + 1).collect()]
        found = found.where(F.col("term").isin(some)) if len(some) <= PUSHED else found.join(terms, "term", "left_semi")
        if dict(found.dtypes)["chunk_id"] == "binary":
            found = found.withColumn("chunk_id", F.lower(F.hex("chunk_id")))
        return found, found.groupBy("term").agg(F.sum("sign").alias("df")).where("df > 0"), facts.get(COUNT, 0)

    def compact(self, files: int = 8) -> bool:
        """Rewrite buckets of more than ``files`` folders: each posting once, and none that has cancelled. False if there is none."""
        state = self.store.state()
        entry = state["tables"].get(POSTINGS)
        full = [] if entry is None else [int(b) for b, p in entry["at"].items() if len(p) > files]
        if not full:
            return False
        base = self.store.version()
        bucket = F.pmod(F.xxhash64("term"), F.lit(entry["buckets"])).cast("int")
        old = self.store.read(POSTINGS, version=base).where(bucket.isin(full))
        rows = old.groupBy("term", "chunk_id").agg(F.sum("sign").cast("byte").alias("sign")).where("sign <> 0")
        self.store.commit([Change(POSTINGS, ("term",), rows, old.select("term"), ("term", "chunk_id"))], None, base)
        return True
