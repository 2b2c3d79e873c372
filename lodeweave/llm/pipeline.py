"""The corpus pipeline: quality rules, line de-duplication, near-duplicates, benchmark decontamination, byte-pair encoding.

``run`` applies the stages to the documents of a folder. Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and returns the
columns of documents; the last one returns the token ids. What a stage returns is written to the shared folder and read back for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeweave.llm import bpe, decontaminate, line_templates, near_duplicates, quality_rules
from lodeweave.llm.common import SCRATCH, cut, drop_scratch, read, small_batches

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep, as they are."""
    d = quality_rules.apply_rules(docs, read(spark, sf_dir, "labels"))
    return d.where("kept").select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines of templates that recur; ``n_chars`` is that of the new text. A document of which nothing is left goes: all that it said stands elsewhere."""
    d = line_templates.drop_recurring_lines(docs).where(~((F.col("n_dropped") > 0) & ~F.col("text").rlike(r"[^ \t-\r]")))
    return d.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates: that of the smallest id."""
    small_batches(spark)
    return near_duplicates.keep_one(docs).select(*COLUMNS)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of a benchmark item."""
    small_batches(spark)
    return decontaminate.decontaminate(docs, read(spark, sf_dir, "benchmark"), clean_only=True).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id``, ``lang``, ``source`` and the ids of every document, with their count and digests."""
    small_batches(spark)
    return bpe.encode(docs, keep_text=False).select("doc_id", "lang", "source", "ids", *bpe.RESULTS)


STAGES = [("quality_rules", quality), ("line_templates", lines), ("near_duplicates", near), ("decontaminate", leaks), ("bpe", tokens)]
#: SQL can't express the near-duplicates' sampling or the encoding: tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage for the documents of ``sf_dir``."""
    docs = read(spark, sf_dir, "documents")
    first = len(SCRATCH)
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name}")
        drop_scratch(spark, SCRATCH[first:-1])  # what the stage wrote for itself, and what it read
    return STAGES[-1][1](spark, docs, sf_dir)
