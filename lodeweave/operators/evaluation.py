"""Retrieval evaluation: which hits are relevant, recall at k and mean reciprocal rank, by category and over all."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def relevant_ranks(results: DataFrame, expected: DataFrame) -> DataFrame:
    """(case, first_rank): the first relevant hit of each case, null if there is none.

    A hit (case_id, rank, external_id, source_key, position_start, position_end) is relevant if an expectation (case_id, document_id, and each or null:
    source, page, page_from, page_to) has its document, its source, a page inside it, and a range of pages that overlaps it.
    """
    e = expected.select("case_id", "document_id", "source", "page", "page_from", "page_to")
    on = (
        (F.col("r.case_id") == F.col("e.case_id")) & (F.col("r.external_id") == F.col("e.document_id")) & (F.col("e.source").isNull() | (F.col("e.source") == F.col("r.source_key")))
        & (F.col("e.page").isNull() | F.col("e.page").between(F.col("r.position_start"), F.col("r.position_end")))
        & (F.col("e.page_from").isNull() | (F.col("r.position_end") >= F.col("e.page_from"))) & (F.col("e.page_to").isNull() | (F.col("r.position_start") <= F.col("e.page_to")))
    )
    found = results.alias("r").join(e.alias("e"), on).groupBy(F.col("r.case_id").alias("case_id")).agg(F.min("rank").alias("first_rank"))
    return expected.select("case_id").distinct().join(found, "case_id", "left")


def expectations(cases: DataFrame) -> DataFrame:
    """What ``relevant_ranks`` expects, of cases with ``expected`` (document_id, source, page, pages); a case without any is one that nothing answers."""
    e = cases.select("case_id", F.explode_outer("expected").alias("e"))
    return e.select("case_id", "e.document_id", "e.source", "e.page", F.get("e.pages", 0).alias("page_from"), F.get("e.pages", 1).alias("page_to"))


def compare(ranks: DataFrame, cases: DataFrame, ks: Sequence[int] = (1, 5, 10)) -> DataFrame:
    """``report`` for several runs at once: ``ranks`` has ``run`` and ``ms`` too. One pass gives each run's categories and its whole; ``cases``: case_id, category."""
    r = ranks.join(cases.select("case_id", F.coalesce("category", F.lit("general")).alias("category")), "case_id")
    sums = r.groupingSets([["run", "category"], ["run"]], "run", "category").agg(F.grouping("category").alias("_all"), F.count("*").alias("cases"), *measures(ks), F.round(F.avg("ms"), 2).alias("avg_ms"))
    return sums.withColumn("category", F.when(F.col("_all") == 1, "all").otherwise(F.col("category"))).drop("_all")


def measures(ks: Sequence[int]) -> list[Column]:
    """Recall at each k and MRR, 4 digits."""
    hit = lambda k: F.round(F.avg(F.when(F.col("first_rank") <= k, 1.0).otherwise(0.0)), 4).alias(f"recall_{k}")
    return [*[hit(k) for k in ks], F.round(F.avg(F.when(F.col("first_rank").isNotNull(), 1 / F.col("first_rank")).otherwise(0.0)), 4).alias("mrr")]


def report(ranks: DataFrame, cases: DataFrame, ks: Sequence[int] = (1, 5, 10)) -> DataFrame:
    """Recall at each k and MRR (4 digits) of each category and of ``all``. ``cases``: case_id, category, ms."""
    r = ranks.join(cases.select("case_id", F.coalesce("category", F.lit("uncategorised")).alias("category"), "ms"), "case_id")
    out = r.rollup("category").agg(F.grouping("category").alias("_all"), F.count("*").alias("cases"), *measures(ks), F.round(F.avg("ms"), 2).alias("avg_ms"))
    return out.withColumn("category", F.when(F.col("_all") == 1, "all").otherwise(F.col("category"))).drop("_all")
