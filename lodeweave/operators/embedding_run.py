"""Embedding runs that can be resumed: vectors are stored as they come, and a rerun asks the provider only for what has none.

Texts without a vector are written once, each different text once, dealt into waves; a wave is one Spark job and one version of the store. Within it each task hands its texts to the provider in groups (96 by default). A
group that the provider refuses is stored as refused beside the groups that it answered, so one bad call costs nobody else's vectors. What can be paid for twice is bounded: by a lost executor the groups of its tasks, by a
lost driver the groups of one wave.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeweave.operators.ingest import Embed, is_stale, unit_vectors
from lodeweave.sources.store import Change, TableStore, shared_folder

VECTORS = "vectors"


class EmbeddingRun:
    """Vectors of a model in a store, by text."""

    def __init__(self, store: TableStore, embed: Embed, model: str, dimensions: int, batch: int = 96, prefix: str = "", wave_groups: int = 10_000, task_groups: int = 20):
        self.store, self.embed, self.model, self.dimensions, self.batch, self.prefix = store, embed, model, dimensions, batch, prefix
        self.wave_groups, self.task_groups = wave_groups, task_groups

    def _key(self) -> Column:
        return F.sha2(F.concat_ws("\u0000", F.lit(self.model), F.lit(str(self.dimensions)), F.lit(self.prefix), "embedding_input"), 256)

    def _known(self) -> DataFrame | None:
        stored = self.store.read(VECTORS)
        return None if stored is None else stored.where("embedding IS NOT NULL")

    def missing(self, chunks: DataFrame) -> DataFrame:
        """(key, text) of the different texts of stale chunks that have no vector in the store. A chunk without text (null) has none to embed."""
        texts = chunks.where(is_stale(self.model, self.dimensions) & F.col("embedding_input").isNotNull()).groupBy(self._key().alias("key")).agg(F.first("embedding_input").alias("text"))
        known = self._known()
        return texts if known is None else texts.join(known.select("key"), "key", "left_anti")

    def run(self, chunks: DataFrame) -> list[dict[str, int]]:
        """Embed what is missing: for each wave how many texts were answered and refused. A wave of which every group is refused is the last one, as the provider is away."""
        spark, missing = chunks.sparkSession, self.missing(chunks)
        n = missing.count()
        waves = max(1, -(-n // (self.wave_groups * self.batch)))
        path = f"{shared_folder(spark)}/embedding-run-{uuid.uuid4().hex}"
        missing.withColumn("wave", F.pmod(F.xxhash64("key"), F.lit(waves)).cast("int")).write.partitionBy("wave").parquet(path)
        done: list[dict[str, int]] = []
        try:
            for wave in range(waves if n else 0):
                todo = spark.read.schema("key string, text string, wave int").parquet(path).where(F.col("wave") == wave).select("key", "text")
                before = self.store.version()
                self.store.commit([Change(VECTORS, ("key",), self._embedded(todo, n // waves).withColumn("version", F.lit(before + 1)), sort=("key",))], base=before)
                row = self.store.read(VECTORS).where(F.col("version") == before + 1).agg(F.count("embedding").alias("answered"), F.count("error").alias("refused")).first()
                done.append({"wave": wave, "answered": row.answered, "refused": row.refused})
                if row.refused and not row.answered:
                    break
        finally:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        return done

    def _embedded(self, todo: DataFrame, size: int) -> DataFrame:
        embed, batch, prefix, dimensions = self.embed, self.batch, self.prefix, self.dimensions

        def answer(texts: list[str]) -> tuple[list[Any], str | None]:
            try:
                return unit_vectors(embed([prefix + t for t in texts]), len(texts), dimensions), None
            except Exception as e:  # noqa: BLE001  whatever a provider raises refuses its group, and is stored
                return [None] * len(texts), f"{type(e).__name__}: {e}"[:500]

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            rest: pd.DataFrame | None = None
            for pdf in frames:
                rest = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
                while len(rest) >= batch:
                    yield group(rest.iloc[:batch])
                    rest = rest.iloc[batch:]
            if rest is not None and len(rest):
                yield group(rest)

        def group(pdf: pd.DataFrame) -> pd.DataFrame:
            vectors, error = answer(pdf["text"].tolist())
            return pd.DataFrame({"key": pdf["key"].tolist(), "embedding": vectors, "error": [error] * len(pdf)})

        tasks = max(1, -(-size // (self.task_groups * batch)))
        return todo.repartition(tasks, "key").mapInPandas(run, "key string, embedding array<float>, error string")

    def apply(self, chunks: DataFrame, now: Column | None = None) -> DataFrame:
        """Chunks with the vectors that the store has for them; what has none stays stale, and what isn't stale stays as it is."""
        known = self._known()
        if known is None:
            return chunks
        stale, columns = is_stale(self.model, self.dimensions), ("embedding", "embedding_model", "embedding_dimensions", "embedded_at")
        made = known.groupBy(F.col("key").alias("_key")).agg(F.first("embedding").alias("_vector"))
        found = chunks.where(stale).withColumn("_key", self._key()).join(made, "_key", "left")
        stamp = now if now is not None else F.current_timestamp().cast("timestamp_ntz")
        values = {"embedding": F.col("_vector"), "embedding_model": F.lit(self.model), "embedding_dimensions": F.lit(self.dimensions), "embedded_at": stamp}
        found = found.withColumns({c: F.when(F.col("_vector").isNotNull(), values[c]).otherwise(F.col(c)) for c in columns})
        return found.select(chunks.columns).unionByName(chunks.where(~stale))
