"""Streaming counterparts of hourly throughput and daily volume, and incremental capture of documents into a store. Batches of the same rows give the same result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeweave.operators.ingest import KEY
from lodeweave.plans.engine import Engine
from lodeweave.sources.store import PIECE, TableStore, beside
from lodeweave.sources.tables import FunctionSource


def hourly_counts(stream: DataFrame, at: str, late: str = "2 hours", by: list[str] | None = None) -> DataFrame:
    """Rows by hour (and ``by``), closed when the watermark passes an hour. ``at`` is a timestamp."""
    w = stream.withWatermark(at, late).groupBy(F.window(at, "1 hour").alias("w"), *(by or [])).agg(F.count("*").alias("n"))
    return w.select(F.col("w.start").alias("bucket"), *(by or []), "n")


def daily_volume(stream: DataFrame, at: str, refused: Column, late: str = "1 day") -> DataFrame:
    """Answered and refused by day."""
    w = stream.withWatermark(at, late).groupBy(F.window(at, "1 day").alias("w")).agg(F.count_if(~F.coalesce(refused, F.lit(False))).alias("answered"), F.count_if(refused).alias("refused"))
    return w.select(F.col("w.start").alias("bucket"), "answered", "refused")


REVISION = "revision"


def capture_batch(engine: Engine, store: TableStore, key: str, arrived: DataFrame, batch: int) -> bool:
    """Take a batch of revisions into the store; False for a batch that is there already.

    Rows of ``arrived`` are segments: external_id, title, revision (a number), position, text. A document's highest revision in the batch is the document, unless a higher one is stored; a revision without any
    position takes the document away. The number of the batch is committed with its rows, so a batch that is delivered again changes nothing, whether the writer died before or after its commit.
    """
    name = f"stream:{key}"
    if store.facts().get(name, -1) >= batch:
        return False
    rows = arrived.select(F.lit(key).alias("source_key"), F.col("external_id").cast("string").alias("external_id"), "title", F.col(REVISION).cast("long").alias(REVISION), F.col("position").cast("int").alias("position"), F.when(F.col("position").isNotNull(), F.col("text")).alias("text"))
    stored = store.read("documents", rows)
    have = engine.spark.createDataFrame([], "source_key string, external_id string, _have long") if stored is None else stored.select(*KEY, F.col("metadata")[REVISION].cast("long").alias("_have"))
    # texts are shuffled here, and lie from here on as the store deals them
    found, of_document = beside(rows, have, KEY, lambda df: store.dealt(df, tuple(KEY))), Window.partitionBy(PIECE, *KEY)
    found = found.withColumn("_newest", F.max(REVISION).over(of_document)).where((F.col(REVISION) == F.col("_newest")) & (F.col("_have").isNull() | (F.col("_have") < F.col(REVISION))))
    found = found.withColumn("title", F.max(F.when(F.col("position").isNotNull(), F.col("title"))).over(of_document))
    rows = engine._settle(found.select(*KEY, "title", REVISION, "position", "text"))
    each = engine._settle(rows.groupBy(*KEY).agg(F.max("title").alias("title"), F.max(REVISION).cast("string").alias(REVISION), F.count("position").alias("_segments")))
    kept, gone = rows.where("position IS NOT NULL"), each.where("_segments = 0").select(*KEY)
    documents = each.where("_segments > 0").select(*KEY, "title", F.create_map(F.lit(REVISION), F.col(REVISION)).alias("metadata"))
    segments = kept.select(*KEY, "position", "text", "title")
    engine.register(FunctionSource(key, make_documents=lambda _: documents, make_segments=lambda _: segments.drop("title")))
    engine.ingest_into(store, key, gone=gone, facts={name: batch}, segments=segments)
    return True


def capture(stream: DataFrame, engine: Engine, store: TableStore, key: str, checkpoint: str, trigger: dict | None = None):  # noqa: ANN201
    """Keep the store's documents and chunks of a source up to date from a stream of revisions (see ``capture_batch``)."""
    writer = stream.writeStream.foreachBatch(lambda df, batch: capture_batch(engine, store, key, df, batch)).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
