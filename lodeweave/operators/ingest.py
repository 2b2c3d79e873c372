"""Ingestion: what changed, what is reused, what has to be embedded, and what is left to clean up.

Tables are immutable frames: each operator takes the stored state and returns the next one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodeweave.config import ChunkingOptions

FULL, INCREMENTAL, EMBEDDINGS_ONLY = "full", "incremental", "embeddings_only"
KEY = ["source_key", "external_id"]


def upsert_documents(stored: DataFrame, drafts: DataFrame) -> DataFrame:
    """Documents with title and metadata of the drafts; a known one keeps its status, a new one is pending."""
    d = drafts.select(*KEY, F.col("title").alias("_title"), F.col("metadata").alias("_metadata"), F.lit(True).alias("_drafted"))
    out = stored.join(d, KEY, "full_outer")
    return out.select(
        *KEY, F.when(F.col("_drafted"), F.col("_title")).otherwise(F.col("title")).alias("title"), F.when(F.col("_drafted"), F.col("_metadata")).otherwise(F.col("metadata")).alias("metadata"),
        F.coalesce("status", F.lit("pending")).alias("status"), *[c for c in stored.columns if c not in (*KEY, "title", "metadata", "status")],
    )


def can_skip(mode: str) -> Column:
    """A document that needs no work: incremental, content and parameters as they were, with chunks, all embedded."""
    same = (F.col("content_checksum") == F.col("stored_content")) & (F.col("params_checksum") == F.col("stored_params"))
    return F.coalesce(F.lit(mode == INCREMENTAL) & same & (F.col("chunk_count") > 0) & (F.col("embedded_chunk_count") >= F.col("chunk_count")), F.lit(False))


def pending_documents(current: DataFrame, stored: DataFrame, params_checksum: str, mode: str = INCREMENTAL) -> DataFrame:
    """Of documents with their ``content_checksum`` those that have to be chunked again."""
    s = stored.select(*KEY, F.col("content_checksum").alias("stored_content"), F.col("params_checksum").alias("stored_params"), "chunk_count", "embedded_chunk_count")
    return current.withColumn("params_checksum", F.lit(params_checksum)).join(s, KEY, "left").where(~can_skip(mode)).select(current.columns)


def diff_chunks(stored: DataFrame, drafts: DataFrame, document: list[str] | None = None) -> DataFrame:
    """The k-th stored chunk of a document with some content hash is the k-th draft with it: ``state`` is reused, created or deleted.

    Columns of the drafts and, with ``stored_`` before them, of the stored chunks.
    """
    doc = document or KEY
    nth = lambda df: df.withColumn("_nth", F.row_number().over(Window.partitionBy(*doc, "content_hash").orderBy("ordinal")))
    keys = [*doc, "content_hash", "_nth"]
    old = nth(stored)
    old = old.select(*keys, *[F.col(c).alias(f"stored_{c}") for c in old.columns if c not in keys], F.lit(1).alias("_old"))
    out = nth(drafts).withColumn("_new", F.lit(1)).join(old, keys, "full_outer")
    state = F.when(F.col("_old").isNull(), "created").when(F.col("_new").isNull(), "deleted").otherwise("reused")
    return out.withColumn("state", state).drop("_nth", "_old", "_new")


def apply_diff(diff: DataFrame, carried: list[str] | None = None) -> DataFrame:
    """The chunks after the diff: reused ones keep what was embedded (``carried``) and take the new place; deleted ones go."""
    carried = carried or ["embedding", "embedding_model", "embedding_dimensions", "embedded_at"]
    kept = [F.col(f"stored_{c}").alias(c) for c in carried if f"stored_{c}" in diff.columns]
    return diff.where(F.col("state") != "deleted").select(*[c for c in diff.columns if not c.startswith("stored_") and c not in ("state", *carried)], *kept)


def diff_summary(diff: DataFrame, document: list[str] | None = None) -> DataFrame:
    """Per document: chunks created, reused and deleted, and tokens to embed."""
    return diff.groupBy(*(document or KEY)).agg(
        *[F.count_if(F.col("state") == s).alias(s) for s in ("created", "reused", "deleted")],
        F.coalesce(F.sum(F.when(F.col("state") == "created", F.col("token_count"))), F.lit(0)).cast("long").alias("tokens"),
    )


def kept_summary(kept: DataFrame, stored: DataFrame) -> DataFrame:
    """``diff_summary`` of what a diff keeps (with its ``state``) and of the stored chunks that went into it: what isn't reused of these is deleted."""
    now = kept.groupBy(*KEY).agg(
        *[F.count_if(F.col("state") == s).alias(s) for s in ("created", "reused")], F.coalesce(F.sum(F.when(F.col("state") == "created", F.col("token_count"))), F.lit(0)).cast("long").alias("tokens"),
    )
    both = now.join(stored.groupBy(*KEY).agg(F.count("*").alias("_had")), KEY, "full_outer").fillna(0, ["created", "reused", "tokens", "_had"])
    return both.select(*KEY, "created", "reused", (F.col("_had") - F.col("reused")).alias("deleted"), "tokens")


def is_stale(model: str, dimensions: int) -> Column:
    """A chunk without an embedding, or with one of another model or width."""
    return F.col("embedded_at").isNull() | ~F.col("embedding_model").eqNullSafe(F.lit(model)) | ~F.col("embedding_dimensions").eqNullSafe(F.lit(dimensions))


Embed = Callable[[list[str]], list[list[float]]]


def unit_vectors(got: list[list[float]], n: int, dimensions: int) -> list[Any]:
    """A provider's vectors, normalised; a wrong count or width is an error."""
    import numpy as np

    if len(got) != n or any(len(v) != dimensions for v in got):
        raise ValueError(f"the provider returned {len(got)} vectors for {n} texts, or not {dimensions} wide")
    a = np.asarray(got, dtype="float64").reshape(n, dimensions)
    size = np.linalg.norm(a, axis=1, keepdims=True)
    return list(np.where(size > 0, a / np.where(size > 0, size, 1), a).astype("float32"))


def embed_chunks(chunks: DataFrame, embed: Embed, model: str, dimensions: int, batch: int = 96, prefix: str = "", now: Column | None = None) -> DataFrame:
    """Stale chunks with their vectors, ``batch`` texts to a call, normalised; a wrong count or width is an error. Others stay as they are."""
    stale = is_stale(model, dimensions)
    columns = [c for c in chunks.columns if c not in ("embedding", "embedding_model", "embedding_dimensions", "embedded_at")]
    todo = chunks.where(stale).select(*columns)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in todo.schema) + ", embedding array<float>"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            vectors: list[Any] = []
            for i in range(0, len(pdf), batch):
                texts = [prefix + t for t in pdf["embedding_input"].iloc[i : i + batch]]
                vectors += unit_vectors(embed(texts), len(texts), dimensions)
            yield pdf.assign(embedding=vectors)

    done = todo.mapInPandas(run, schema).withColumns({"embedding_model": F.lit(model), "embedding_dimensions": F.lit(dimensions), "embedded_at": now if now is not None else F.current_timestamp().cast("timestamp_ntz")})
    return done.unionByName(chunks.where(~stale), allowMissingColumns=True)


@dataclass(frozen=True)
class HashingEmbedder:
    """A deterministic embedder without a model: each word adds to a slot that its hash names, with a sign."""

    dimensions: int = 64

    def __call__(self, texts: list[str]) -> list[list[float]]:
        import re
        import zlib

        out = []
        for t in texts:
            v = [0.0] * self.dimensions
            for w in re.findall(r"\w+", t.lower()):
                h = zlib.crc32(w.encode())
                v[h % self.dimensions] += 1.0 if h >> 16 & 1 else -1.0
            out.append(v)
        return out


def put_vectors(chunks: DataFrame, vectors: DataFrame, model: str, dimensions: int, now: Column | None = None) -> DataFrame:
    """Chunks with the vectors of ``vectors`` (chunk_id, embedding), marked with model, width and time; others keep theirs."""
    v = vectors.select("chunk_id", F.col("embedding").alias("_v"))
    new = F.col("_v").isNotNull()
    out = chunks.join(v, "chunk_id", "left")
    values = {"embedding": F.col("_v"), "embedding_model": F.lit(model), "embedding_dimensions": F.lit(dimensions), "embedded_at": now if now is not None else F.current_timestamp().cast("timestamp_ntz")}
    return out.select(*[F.when(new, values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in chunks.columns])


def forget_vectors(chunks: DataFrame, which: Column | None = None) -> DataFrame:
    """Without the vectors of the chunks in question (all by default); texts stay."""
    hit = which if which is not None else F.lit(True)
    return chunks.withColumns({c: F.when(~hit, F.col(c)) for c in ("embedding", "embedding_model", "embedding_dimensions", "embedded_at")})


def forget_document(documents: DataFrame, chunks: DataFrame, source_key: str, external_id: str) -> tuple[DataFrame, DataFrame]:
    """Both tables without a document."""
    other = ~((F.col("source_key") == source_key) & (F.col("external_id") == external_id))
    return documents.where(other), chunks.where(other)


def purge_source(documents: DataFrame, chunks: DataFrame, source_key: str, embeddings_only: bool = False) -> tuple[DataFrame, DataFrame]:
    """Both tables without a source; or with its vectors gone and its documents back to ``chunked``."""
    own = F.col("source_key") == source_key
    if not embeddings_only:
        return documents.where(~own), chunks.where(~own)
    d = documents.withColumns({"embedded_chunk_count": F.when(own, 0).otherwise(F.col("embedded_chunk_count")), "status": F.when(own, "chunked").otherwise(F.col("status"))})
    return d, forget_vectors(chunks, own)


def resize_vectors(documents: DataFrame, chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables before vectors of another width are made: no chunk has one, and embedded documents are ``chunked`` again."""
    status = F.when(F.col("status") == "embedded", "chunked").otherwise(F.col("status"))
    return documents.withColumns({"embedded_chunk_count": F.lit(0).cast("long"), "status": status}), forget_vectors(chunks)


def orphans(stored: DataFrame, source: DataFrame) -> DataFrame:
    """Stored documents that the source no longer has: one anti join."""
    return stored.join(source.select(*KEY).distinct(), KEY, "left_anti")


def refresh_counts(documents: DataFrame, chunks: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """Documents with their chunks counted; embedded where there are some and all are, else chunked. ``of``: keys of the documents that ``chunks`` has all chunks of; others keep their counts."""
    n = chunks.groupBy(*KEY).agg(F.count("*").cast("long").alias("_n"), F.count("embedded_at").cast("long").alias("_e"))
    if of is None:
        d = documents.drop("chunk_count", "embedded_chunk_count").join(n, KEY, "left").withColumns({"chunk_count": F.coalesce("_n", F.lit(0)), "embedded_chunk_count": F.coalesce("_e", F.lit(0))}).drop("_n", "_e")
    else:
        counted = of.select(*KEY, F.lit(True).alias("_counted")).join(n, KEY, "left")
        d = documents.withColumns({"_n0": F.col("chunk_count"), "_e0": F.col("embedded_chunk_count")}).drop("chunk_count", "embedded_chunk_count").join(counted, KEY, "left")
        now = lambda new, old: F.coalesce(F.when(F.col("_counted"), F.coalesce(new, F.lit(0))).otherwise(F.col(old)), F.lit(0))
        d = d.withColumns({"chunk_count": now("_n", "_n0"), "embedded_chunk_count": now("_e", "_e0")}).drop("_n", "_e", "_n0", "_e0", "_counted")
    return d.withColumn("status", F.when((F.col("chunk_count") > 0) & (F.col("embedded_chunk_count") == F.col("chunk_count")), "embedded").otherwise("chunked"))


def run_totals(items: DataFrame) -> DataFrame:
    """A run's counters as sums over its items, and its progress: 0.3 for chunking, 0.7 for embedding."""
    done = F.col("status").isin("chunked", "embedded", "skipped", "failed")
    t = items.groupBy("run_id").agg(
        F.count("*").alias("documents"), F.count_if(done).alias("documents_done"), F.count_if(F.col("status") == "failed").alias("documents_failed"),
        *[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("chunks_created", "chunks_reused", "chunks_deleted", "chunks_embedded", "tokens")],
    )
    part = lambda a, b: F.when(b > 0, F.least(F.lit(1.0), a / b)).otherwise(F.lit(0.0))
    return t.withColumn("progress", F.round(0.3 * part(F.col("documents_done"), F.col("documents")) + 0.7 * part(F.col("chunks_embedded"), F.col("chunks_created")), 4))


def price(models: DataFrame, prices: DataFrame, model_col: str = "model") -> DataFrame:
    """Each row with the price of its model: the exact name, the name without a date at its end, else the longest known name that it starts with, else 0."""
    undated = F.regexp_replace(model_col, r"-\d{4}-?\d{2}-?\d{2}$", "")
    m = models.select(model_col).distinct().withColumn("_undated", undated)
    p = prices.select(F.col("model").alias("_name"), F.col("micros_per_token").alias("_price"))
    fit = F.when(F.col("_name") == F.col(model_col), 1_000_000).when(F.col("_name") == F.col("_undated"), 900_000).otherwise(F.length("_name"))
    # a price list has a name for each model on the market: it is small, and its size isn't that of the data
    best = m.join(F.broadcast(p), F.col("_undated").startswith(F.col("_name")) | F.col(model_col).startswith(F.col("_name"))).groupBy(model_col).agg(F.max_by("_price", fit).alias("micros_per_token"))
    return models.join(best, model_col, "left").fillna(0.0, ["micros_per_token"])


def cost_micros(tokens: Column, micros_per_token: Column) -> Column:
    """Micro-dollars, rounded to whole ones."""
    return F.round(tokens * micros_per_token).cast("long")


def estimate(documents: DataFrame, sample: DataFrame, o: ChunkingOptions, micros_per_token: float = 0.0) -> DataFrame:
    """One row: documents, tokens, chunks, embedded tokens and cost of an ingestion, from the characters of the first documents (``sample``: chars)."""
    n = documents.agg(F.count("*").alias("documents"))
    per = sample.agg(F.coalesce(F.avg("chars"), F.lit(0.0)).alias("chars"))
    stride = max(1, o.target_tokens - o.overlap_tokens)
    e = n.crossJoin(per).withColumn("tokens", F.ceil(F.col("chars") * F.col("documents") / o.chars_per_token).cast("long"))
    e = e.withColumn("chunks", F.when(F.col("tokens") > 0, F.ceil(F.col("tokens") / stride)).otherwise(0).cast("long"))
    return e.select("documents", "tokens", "chunks", (F.col("chunks") * o.target_tokens).alias("embedded_tokens"), cost_micros(F.col("chunks") * o.target_tokens, F.lit(micros_per_token)).alias("cost_micros"))
