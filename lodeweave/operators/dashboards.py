"""Dashboards: coverage, corpus statistics, throughput by hour and volume by day without gaps."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeweave.functions.text import moment


def percent(part: Column, whole: Column) -> Column:
    """A whole number; 0 of nothing."""
    return F.when(whole > 0, F.round(part * 100 / whole)).otherwise(0).cast("int")


def coverage(chunks: DataFrame, by: str = "source_key", done: str = "embedded_at") -> DataFrame:
    """Per source: chunks, embedded, pending and the percentage."""
    c = chunks.groupBy(by).agg(F.count("*").alias("chunks"), F.count(done).alias("embedded"))
    return c.withColumns({"pending": F.col("chunks") - F.col("embedded"), "percent": percent(F.col("embedded"), F.col("chunks"))})


def corpus_stats(documents: DataFrame, chunks: DataFrame, runs: DataFrame, queries: DataFrame, stale: Column) -> DataFrame:
    """One row: documents, chunks, embedded, pending, stale, coverage, spend in micro-dollars (runs and queries), average latency."""
    one = documents.agg(F.count("*").alias("documents")).crossJoin(
        chunks.agg(F.count("*").alias("chunks"), F.count("embedded_at").alias("embedded"), F.count_if(F.col("embedded_at").isNotNull() & stale).alias("stale"))
    )  # each is one row
    one = one.crossJoin(runs.agg(F.coalesce(F.sum("cost_micros"), F.lit(0)).alias("_r"))).crossJoin(queries.agg(F.coalesce(F.sum("cost_micros"), F.lit(0)).alias("_q"), F.round(F.coalesce(F.avg("latency_ms"), F.lit(0.0)), 2).alias("avg_latency_ms")))
    return one.select("documents", "chunks", "embedded", (F.col("chunks") - F.col("embedded")).alias("pending"), "stale", percent(F.col("embedded"), F.col("chunks")).alias("coverage"), (F.col("_r") + F.col("_q")).alias("spend_micros"), "avg_latency_ms")


def spine(spark: SparkSession, first: datetime, count: int, step: timedelta) -> DataFrame:
    """``count`` bucket starts from ``first``."""
    return spark.range(count).select((moment(first) + F.make_dt_interval(secs=F.col("id") * int(step.total_seconds()))).alias("bucket"))


def throughput(rows: DataFrame, at: str, now: datetime, hours: int = 24) -> DataFrame:
    """Rows by hour over the last ``hours``, empty ones too, with the percentage of the largest."""
    from pyspark.sql.window import Window

    last = now.replace(minute=0, second=0, microsecond=0)
    first = last - timedelta(hours=hours - 1)
    c = rows.where((F.col(at) >= moment(first)) & (F.col(at) <= moment(now))).groupBy(F.date_trunc("hour", at).cast("timestamp_ntz").alias("bucket")).agg(F.count("*").alias("n"))
    d = spine(rows.sparkSession, first, hours, timedelta(hours=1)).join(c, "bucket", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return d.withColumn("percent", percent(F.col("n"), F.max("n").over(Window.partitionBy())))  # as many rows as hours


def volume(rows: DataFrame, at: str, refused: Column, today: datetime, days: int = 30) -> DataFrame:
    """Rows by day over the last ``days``, empty ones too: answered and refused."""
    day = today.replace(hour=0, minute=0, second=0, microsecond=0)
    first = day - timedelta(days=days - 1)
    c = rows.where((F.col(at) >= moment(first)) & (F.col(at) < moment(day + timedelta(days=1)))).groupBy(F.date_trunc("day", at).cast("timestamp_ntz").alias("bucket"))
    c = c.agg(F.count_if(~F.coalesce(refused, F.lit(False))).alias("answered"), F.count_if(refused).alias("refused"))
    d = spine(rows.sparkSession, first, days, timedelta(days=1)).join(c, "bucket", "left")
    return d.select("bucket", F.coalesce("answered", F.lit(0)).alias("answered"), F.coalesce("refused", F.lit(0)).alias("refused"))


def latest(rows: DataFrame, at: str, key: str, n: int = 5) -> DataFrame:
    """The latest n rows."""
    return rows.orderBy(F.col(at).desc(), F.col(key).desc()).limit(n)


def document_list(documents: DataFrame, exposed: list[str] | None, limit: int = 500) -> DataFrame:
    """Documents with chunks, of the sources that callers may see, by source and title."""
    d = documents.where(F.col("chunk_count") > 0)
    if exposed is not None:
        d = d.where(F.col("source_key").isin(exposed) if exposed else F.lit(False))
    return d.orderBy("source_key", "title", "external_id").limit(limit)
