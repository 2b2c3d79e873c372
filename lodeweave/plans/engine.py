"""The engine: sources, stored tables and the verbs that callers use."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import replace
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodeweave.config import EngineConfig, RetrievalOptions
from lodeweave.functions.text import excerpt, normalize
from lodeweave.operators import answering, chunking, dashboards, evaluation, ingest, retrieval
from lodeweave.operators.embedding_run import EmbeddingRun
from lodeweave.operators.keyword_index import KeywordIndex, named
from lodeweave.sources.filters import narrow, user_scope
from lodeweave.sources.store import Change, TableStore, apart, beside, dealt
from lodeweave.sources.tables import KnowledgeSource, SourceRegistry


class Engine:
    """Ingest sources into chunks, and search them.

    ``documents`` and ``chunks`` are frames (None before the first ingestion); verbs return the next state and leave storing to the caller.
    """

    def __init__(self, spark: SparkSession, config: EngineConfig | None = None, embed: ingest.Embed | None = None, documents: DataFrame | None = None, chunks: DataFrame | None = None):
        self.spark, self.config = spark, config or EngineConfig()
        self.embed = embed or ingest.HashingEmbedder(self.config.dimensions)
        self.sources = SourceRegistry()
        self.documents, self.chunks = documents, chunks

    def register(self, source: KnowledgeSource) -> None:
        self.sources.register(source)

    def source(self, key: str) -> KnowledgeSource:
        return self.sources.get(key)

    def ingest(self, key: str, filters: dict[str, Any] | None = None, mode: str = ingest.INCREMENTAL, defer: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(documents, chunks, summary) after an ingestion of a source: unchanged documents are skipped, unchanged chunks keep their vectors. ``defer``: new chunks get theirs later, by ``embed_into``."""
        if mode == ingest.EMBEDDINGS_ONLY:
            return self._embed_stored(key)
        pieces = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        deal = lambda rows: dealt(rows, ingest.KEY, pieces)
        source = self.source(key)
        segments = self._settle(self._deal_segments(source.segments(filters), source.documents(filters), deal))
        return self._ingest(key, filters, mode, defer, deal, segments)[:3]

    @staticmethod
    def _deal_segments(segments: DataFrame, drafts: DataFrame, deal: Callable[[DataFrame], DataFrame], drafted: bool = False) -> DataFrame:
        """Segments with their document's title, dealt by document; ``drafted``: only those of documents that there are."""
        rows = beside(segments.select(*ingest.KEY, "position", "text"), drafts.select(*ingest.KEY, "title", F.lit(True).alias("_drafted")), ingest.KEY, deal)
        return (rows.where("_drafted") if drafted else rows).select(*ingest.KEY, "position", "text", "title")

    def _ingest(self, key: str, filters: dict[str, Any] | None, mode: str, defer: bool, deal: Callable[[DataFrame], DataFrame], segments: DataFrame, whole: bool = True) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame | None]:
        """``ingest`` of segments that ``deal`` has dealt (with titles, and settled), and the documents that were chunked (None: all). Not ``whole``: the chunks are those of these documents alone."""
        c, drafts = self.config, self.source(key).documents(filters)
        checksums = self._settle(chunking.content_checksums(segments, normalize("text", c.chunking.normalizers), dealt=True))
        params = c.chunking.checksum(c.embedding_model, c.dimensions)
        todo = None
        if self.documents is not None:
            todo = self._settle(ingest.pending_documents(checksums, self.documents, params, mode).select(*ingest.KEY))
            segments = beside(segments, todo.withColumn("_todo", F.lit(True)), ingest.KEY, deal).where("_todo")
        new = chunking.chunk_documents(segments, c.chunking, dealt=True).withColumnRenamed("text", "content")
        embedded = lambda df: df if defer else ingest.embed_chunks(df, self.embed, c.embedding_model, c.dimensions, c.embedding_batch)
        # written once: both tables and the summary are built on it, and the provider is paid once, for this source alone
        if self.chunks is None:
            after = new.withColumns({"embedding": F.lit(None).cast("array<float>"), "embedding_model": F.lit(None).cast("string"), "embedding_dimensions": F.lit(None).cast("int"), "embedded_at": F.lit(None).cast("timestamp_ntz")})
            after = self._settle(embedded(after))
            diff_rows = self._settle(ingest.diff_summary(after.withColumn("state", F.lit("created"))))
        else:
            chosen = checksums.select(*ingest.KEY) if todo is None else todo
            others, mine = apart(self.chunks, chosen, tuple(ingest.KEY))
            old = mine.join(chosen, ingest.KEY, "left_semi")
            found = self._settle(ingest.apply_diff(ingest.diff_chunks(old, new).withColumn("_state", F.col("state"))))
            diff_rows = self._settle(ingest.kept_summary(found.withColumnRenamed("_state", "state"), old))
            after, own = found.drop("_state"), F.col("source_key") == key
            if whole:
                after = after.unionByName(others, allowMissingColumns=True).unionByName(mine.join(chosen, ingest.KEY, "left_anti"), allowMissingColumns=True)
            after = self._settle(embedded(after.where(own)).unionByName(after.where(~own), allowMissingColumns=True))
        stamped = drafts.join(checksums.select(*ingest.KEY, "content_checksum"), ingest.KEY, "left").withColumn("params_checksum", F.lit(params))
        known = stamped.withColumn("status", F.lit("pending"))
        if self.documents is not None:
            # documents of other sources, or that the filters leave out, stay as they are
            known = ingest.upsert_documents(self.documents, drafts)
            fresh = stamped.select(*ingest.KEY, F.col("content_checksum").alias("_content"), F.col("params_checksum").alias("_params"), F.lit(True).alias("_seen"))
            known = known.join(fresh, ingest.KEY, "left").withColumns({"content_checksum": F.when(F.col("_seen"), F.col("_content")).otherwise(F.col("content_checksum")), "params_checksum": F.when(F.col("_seen"), F.col("_params")).otherwise(F.col("params_checksum"))}).drop("_content", "_params", "_seen")
        return ingest.refresh_counts(known, after, None if whole else todo), after, diff_rows, todo

    def open(self, store: TableStore) -> None:
        """Take the tables of a store."""
        self.documents, self.chunks = store.read("documents"), store.read("chunks")

    def ingest_into(self, store: TableStore, key: str, filters: dict[str, Any] | None = None, mode: str = "incremental", *, gone: DataFrame | None = None, facts: dict | None = None, keywords: KeywordIndex | None = None, defer: bool = False, segments: DataFrame | None = None) -> DataFrame:
        """``ingest``, stored: only the buckets of the source's documents are read, and only those of changed documents rewritten, both tables in one version. Nothing changed and no ``facts``: no version.

        ``gone``: keys of documents that go with their chunks. ``keywords``: the index of the same store, which is changed with them. ``segments``: the source's segments, settled,
        with their document's title, where they lie as ``store.dealt`` deals them already. The summary of chunk differences is returned.

        Texts are shuffled once to be compared, and those of documents that are chunked again once more; chunks of a first version lie as their texts do, and are written so.
        """
        base, source = store.version(), self.source(key)
        deal = lambda rows: store.dealt(rows, tuple(ingest.KEY))
        keys = self._settle(source.documents(filters).select(*ingest.KEY).distinct())
        touched = keys if gone is None else keys.unionByName(gone.select(*ingest.KEY))
        before, chunks_before = store.read("documents", touched), store.read("chunks", touched)
        if before is not None:
            before = self._settle(apart(before, touched, tuple(ingest.KEY))[1].join(touched.distinct(), ingest.KEY, "left_semi"))
        self.documents, self.chunks, todo = before, chunks_before, None
        if mode == ingest.EMBEDDINGS_ONLY:
            documents, chunks, summary = self._embed_stored(key)
        else:
            if segments is None:
                segments = self._settle(self._deal_segments(source.segments(filters), source.documents(filters), deal, drafted=True))
            documents, chunks, summary, todo = self._ingest(key, filters, mode, defer, deal, segments, whole=False)
        documents = self._settle(documents.join(keys, ingest.KEY, "left_semi"))
        mark = lambda df, name: df.select(*ingest.KEY, F.to_json(F.struct(*sorted(c for c in documents.columns if c not in ingest.KEY))).alias(name))
        changed = documents.select(*ingest.KEY)
        if before is not None:
            changed = mark(documents, "_new").join(mark(before, "_old"), ingest.KEY, "left").where(~F.col("_new").eqNullSafe(F.col("_old"))).select(*ingest.KEY)
        changed = self._settle(changed if gone is None else changed.unionByName(gone.select(*ingest.KEY)).distinct())
        if facts or not changed.isEmpty():
            key_columns, moved = tuple(ingest.KEY), changed
            if todo is not None:  # chunks of documents that weren't chunked stay where they are
                again = todo if gone is None else todo.unionByName(gone.select(*ingest.KEY))
                moved = self._settle(changed.join(again, ingest.KEY, "left_semi"))
            as_dealt = before is None
            if not as_dealt:
                chunks = chunks.join(moved, ingest.KEY, "left_semi")
            if gone is not None and not keys.join(gone, ingest.KEY, "left_semi").isEmpty():
                chunks, as_dealt = chunks.join(gone, ingest.KEY, "left_anti"), False
            changes = [Change("documents", key_columns, documents.join(changed, ingest.KEY, "left_semi"), changed), Change("chunks", key_columns, chunks, moved, dealt=as_dealt)]
            if keywords is not None:
                old = None if chunks_before is None else apart(chunks_before, moved, key_columns)[1].join(moved, ingest.KEY, "left_semi")
                postings, count = keywords.change(old, chunks, store.state(base)["facts"])
                changes, facts = [*changes, postings], (facts or {}) | count
            store.commit(changes, facts, base)
        self.open(store)
        return summary

    def embed_into(self, store: TableStore, key: str, **sizes: int) -> list[dict[str, int]]:
        """Give stored chunks of a source the vectors that they lack, by an ``EmbeddingRun`` (``sizes``: its waves and tasks), whose waves are returned. After a failure the same call goes on where it stopped."""
        c = self.config
        run = EmbeddingRun(store, self.embed, c.embedding_model, c.dimensions, c.embedding_batch, **sizes)
        self.open(store)
        done = run.run(self.chunks.where(F.col("source_key") == key))
        base = store.version()
        own = store.read("chunks", version=base).where(F.col("source_key") == key)
        stale = self._settle(own.where(ingest.is_stale(c.embedding_model, c.dimensions)).select(*ingest.KEY).distinct())
        if not stale.isEmpty():
            of = lambda df: df.join(stale, ingest.KEY, "left_semi")
            chunks = self._settle(run.apply(of(own)))
            documents = ingest.refresh_counts(of(store.read("documents", version=base)), chunks)
            store.commit([Change(name, tuple(ingest.KEY), rows, stale) for name, rows in (("documents", documents), ("chunks", chunks))], base=base)
        self.open(store)
        return done

    def evaluate(self, cases: DataFrame, settings: dict[str, RetrievalOptions] | None = None, k: int = 20, **search: Any) -> tuple[DataFrame, DataFrame]:
        """(report, ranks) of a set of questions with known answers, for one or more settings of the search side by side.

        ``cases``: as ``read_eval_cases`` gives them; those with ``sources`` are asked of these alone. ``ranks``: run, case_id and the rank of the first relevant hit of k (null: none). Diversity is off. ``search``: further
        arguments of ``search``.
        """
        parts, took = None, {}
        # as many as the file has different lists of sources
        scopes = [r.sources for r in cases.select(F.array_sort("sources").alias("sources")).distinct().collect()]
        for name, o in (settings or {"default": self.config.retrieval}).items():
            start = time.monotonic()
            for sources in scopes:
                asked = cases.where(F.array_sort("sources").eqNullSafe(F.lit(sources).cast("array<string>"))).select(F.col("case_id").alias("query_id"), "question")
                hits = self._search(asked, replace(o, top_k=max(1, k), mmr=False, fetch_k=max(o.fetch_k, k)), sources=sources, **search)
                hits = hits.select(F.col("query_id").alias("case_id"), F.col("rank" if "rank" in hits.columns else "position").alias("rank"), "external_id", "source_key", "position_start", "position_end")
                part = self._settle(evaluation.relevant_ranks(hits, evaluation.expectations(cases.where(F.array_sort("sources").eqNullSafe(F.lit(sources).cast("array<string>"))))).withColumn("run", F.lit(name)))
                part.count()
                parts = part if parts is None else parts.unionByName(part)
            took[name] = 1000 * (time.monotonic() - start)
        if parts is None:
            parts = self.spark.createDataFrame([], "case_id string, first_rank int, run string")
        ms = F.create_map(*[F.lit(v) for name, t in took.items() for v in (name, t)]) if took else F.lit(None)
        timed = parts.select("run", "case_id", "first_rank", (ms[F.col("run")] / F.count("*").over(Window.partitionBy("run"))).alias("ms"))
        return evaluation.compare(timed, cases, tuple(n for n in sorted({1, 5, 10, k}) if n <= k)), parts.select("run", "case_id", "first_rank")

    def _embed_stored(self, key: str) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Nothing is read or chunked: stale chunks of the source, as they are stored, get their vectors."""
        c, own = self.config, F.col("source_key") == key
        done = ingest.embed_chunks(self.chunks.where(own), self.embed, c.embedding_model, c.dimensions, c.embedding_batch)
        after = self._settle(done.unionByName(self.chunks.where(~own), allowMissingColumns=True))
        return ingest.refresh_counts(self.documents, after), after, ingest.diff_summary(self.chunks.where(F.lit(False)).withColumn("state", F.lit("")))

    def _settle(self, df: DataFrame) -> DataFrame:
        """A frame that is computed once: checkpointed where the session has a folder for that, else kept on the disks of the executors."""
        if self.spark.sparkContext.getCheckpointDir() or self.spark.conf.get("spark.checkpoint.dir", None):
            return df.checkpoint()
        from pyspark import StorageLevel

        return df.persist(StorageLevel.DISK_ONLY)

    def reindex(self) -> tuple[DataFrame, DataFrame]:
        """(documents, chunks) without vectors, before ones of another width are made with ``embeddings_only``."""
        return ingest.resize_vectors(self.documents, self.chunks)

    def prune(self, key: str) -> tuple[DataFrame, DataFrame]:
        """(documents, chunks) without those that the source no longer has."""
        gone = ingest.orphans(self.documents.where(F.col("source_key") == key), self.source(key).documents(None)).select(*ingest.KEY)
        return self.documents.join(gone, ingest.KEY, "left_anti"), self.chunks.join(gone, ingest.KEY, "left_anti")

    def keyword_index(self) -> tuple[DataFrame, DataFrame, int]:
        """(postings, document frequencies, chunks) of the stored chunks, to be kept and given to ``search`` as ``index``."""
        c = self._ids(self.chunks)
        index = self._settle(retrieval.postings(c, language=self.config.retrieval.language))
        return index, self._settle(retrieval.document_frequencies(index)), c.count()

    @staticmethod
    def _ids(chunks: DataFrame) -> DataFrame:
        return chunks.withColumn("chunk_id", F.concat_ws("/", *ingest.KEY, F.col("ordinal").cast("string"))).withColumn("document_id", F.concat_ws("/", *ingest.KEY))

    def estimate(self, key: str, filters: dict[str, Any] | None = None, micros_per_token: float = 0.0) -> DataFrame:
        """What an ingestion would cost, from the first five documents."""
        source = self.source(key)
        ids = source.documents(filters).orderBy("external_id").limit(5).select(*ingest.KEY)
        sample = source.segments(filters).join(ids, ingest.KEY, "left_semi").groupBy(*ingest.KEY).agg(F.sum(F.length("text")).alias("chars"))
        return ingest.estimate(source.documents(filters), sample, self.config.chunking, micros_per_token)

    def search(self, questions: DataFrame | str, *, sources: Sequence[str] | None = None, limit: int | None = None, min_score: float | None = None, scopes: dict[str, Callable[[DataFrame], Column] | None] | None = None, rewrites: DataFrame | None = None, expander: answering.Model | None = None, reranker: Callable[[DataFrame], DataFrame] | None = None, index: tuple[DataFrame, DataFrame, int] | KeywordIndex | None = None, **scan: Any) -> DataFrame:
        """Hits of one question or a frame of them (query_id, question): passages with marker, score and an excerpt. ``limit`` is held to 1-20.

        ``scopes``: what of each source the user may see. ``rewrites``: further wordings (query_id, rewrite from 1, question). ``expander``: a model that gives them, as ``answering.expand`` has it.
        ``reranker``: as ``retrieval.search`` has it.
        ``index``: what ``keyword_index`` returned, or the ``KeywordIndex`` of the store that the chunks are from; without it the words of all chunks are read anew. Other arguments are those of ``retrieval.base_scan``.
        """
        o = self.config.retrieval
        if limit is not None:
            o = replace(o, top_k=min(20, max(1, limit)))
        if min_score is not None:
            o = replace(o, min_score=min_score)
        return self._search(questions, o, sources=sources, scopes=scopes, rewrites=rewrites, expander=expander, reranker=reranker, index=index, **scan)

    def _search(self, questions: DataFrame | str, o: RetrievalOptions, *, sources: Sequence[str] | None = None, scopes: dict[str, Callable[[DataFrame], Column] | None] | None = None, rewrites: DataFrame | None = None, expander: answering.Model | None = None, reranker: Callable[[DataFrame], DataFrame] | None = None, index: tuple[DataFrame, DataFrame, int] | KeywordIndex | None = None, **scan: Any) -> DataFrame:
        q = self._asked(questions).where(F.length(F.trim("question")) > 0)
        if rewrites is None and expander is not None:
            rewrites = self._settle(answering.expand(q, expander, o.max_rewrites))  # several legs read them, and the model is asked once
        asked = q if rewrites is None else q.withColumn("rewrite", F.lit(0)).unionByName(rewrites.select("query_id", "question", F.col("rewrite").cast("int").alias("rewrite")))
        c = retrieval.base_scan(self.chunks, source_keys=narrow(self.sources.exposed_keys(), sources), **scan)
        c = c if scopes is None else user_scope(c, scopes)
        c = named(c).withColumn("document_id", F.concat_ws("/", *ingest.KEY)) if isinstance(index, KeywordIndex) else self._ids(c)
        given = {}
        if isinstance(index, KeywordIndex):
            o = replace(o, language=index.language)
            found, frequencies, n = index.lookup(asked, o)
            given = {"index": found.join(c.select("chunk_id"), "chunk_id", "left_semi") if self._narrowed(sources, scopes, scan) else found, "frequencies": frequencies, "n": n}
        elif index is not None:
            # postings of the questions' terms first; only a scan or scope that leaves chunks out needs their ids
            found = index[0].join(F.broadcast(retrieval.query_terms(asked, o).select("term").distinct()), "term", "left_semi")
            given = {"index": found.join(c.select("chunk_id"), "chunk_id", "left_semi") if self._narrowed(sources, scopes, scan) else found, "frequencies": index[1], "n": index[2]}
        titles = None
        if reranker is not None and self.documents is not None and "title" in self.documents.columns:
            titles = self.documents.select(F.concat_ws("/", *ingest.KEY).alias("document_id"), "title")
        found = retrieval.search(self._embed_questions(asked), c, o, reranker=reranker, titles=titles, **given)
        hits = found.join(c.select("chunk_id", *ingest.KEY, "ordinal", "position_start", "position_end", "content", "token_count"), "chunk_id").join(q.select("query_id", "question"), "query_id")
        return hits.withColumns({"score": F.round("score", 4), "excerpt": excerpt("content", "question", o.rerank_chars)}).drop("question")

    def _narrowed(self, sources: Sequence[str] | None, scopes: dict | None, scan: dict[str, Any]) -> bool:
        """Whether a search leaves chunks out."""
        return sources is not None or scopes is not None or any(v is not None for v in scan.values()) or self.sources.exposed_keys() != self.sources.keys()

    def _embed_questions(self, q: DataFrame) -> DataFrame:
        embed = self.embed

        def run(frames):  # noqa: ANN001, ANN202
            for pdf in frames:
                yield pdf.assign(embedding=embed(pdf["question"].tolist()) if len(pdf) else [])

        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in q.schema)
        return q.mapInPandas(run, f"{columns}, embedding array<double>")

    def retrieve(self, questions: DataFrame | str, **options: Any) -> DataFrame:
        """``search`` within the answer's token budget, with citation markers."""
        return answering.budget(self.search(questions, **options), self.config.context_tokens)

    def answer(self, questions: DataFrame | str, model: answering.Model, *, history: DataFrame | None = None, system: str | None = None, refusal: str = answering.REFUSAL, require_citations: bool = True, **options: Any) -> tuple[DataFrame, DataFrame]:
        """(log, citations) of questions (query_id, question) that a model answers from what ``search`` finds within the token budget: as ``answering.answers`` has them, the log with ``retrieved_count``.

        ``model``: as ``answering.replies`` has it; a reply without markers is asked for once more. ``history``: earlier turns (query_id, turn, question, answer). ``options`` are those of ``search``. A question that finds
        nothing is refused without a call.
        """
        q = self._settle(self._asked(questions))
        hits = self.search(q, **options)
        order = "rank" if "rank" in hits.columns else "position"
        hits = self._settle(hits)
        given = answering.budget(hits, self.config.context_tokens, order=order).withColumnRenamed(order, "rank")
        if self.documents is not None and "title" in self.documents.columns:
            given = given.join(self.documents.select(*ingest.KEY, "title"), ingest.KEY, "left")
        else:
            given = given.withColumn("title", F.lit(None).cast("string"))
        given = self._settle(answering.labelled(given))
        asked = answering.prompts(q, given, history, answering.SYSTEM + refusal if system is None else system)
        said = answering.replies(asked, model, refusal, require_citations, self._settle)
        found = hits.groupBy("query_id").agg(F.count("*").alias("retrieved_count"))
        log, cited = answering.answers(q, given, said, refusal, require_citations, self.config.snippet_chars)
        log = log.join(found, "query_id", "left").withColumn("retrieved_count", F.coalesce("retrieved_count", F.lit(0)))
        return log, cited.select("query_id", "marker", "rank", "chunk_id", *ingest.KEY, "label", "score", "position_start", "position_end", "used", "snippet")

    def _asked(self, questions: DataFrame | str) -> DataFrame:
        return self.spark.createDataFrame([(0, questions)], "query_id long, question string") if isinstance(questions, str) else questions

    def fetch(self, source_key: str, external_id: str, position_from: int | None = None, position_to: int | None = None) -> DataFrame:
        """A document's text from its chunks, as far as the character budget goes."""
        c = retrieval.base_scan(self.chunks, source_keys=[source_key], external_ids=[external_id], position_from=position_from, position_to=position_to)
        return answering.fetch_document(c.withColumn("document_id", F.col("external_id")), self.config.fetch_chars)

    def forget(self, source_key: str, external_id: str) -> tuple[DataFrame, DataFrame]:
        return ingest.forget_document(self.documents, self.chunks, source_key, external_id)

    def purge(self, source_key: str, embeddings_only: bool = False) -> tuple[DataFrame, DataFrame]:
        return ingest.purge_source(self.documents, self.chunks, source_key, embeddings_only)

    def list_documents(self, limit: int = 500) -> DataFrame:
        return dashboards.document_list(self.documents, self.sources.exposed_keys(), limit)

    def status(self) -> DataFrame:
        return dashboards.coverage(self.chunks)
