"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in one Arrow batch: texts can be long, and a worker holds a few batches at a time.
BATCH_ROWS = "256"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound the memory of Python workers: few rows to an Arrow batch."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` where it is set.

    A folder of this machine is set only where there is none, which is right for a local master alone.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='lodeweave-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


#: Tables written so far that nothing has removed.
SCRATCH: list[str] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new place in the shared folder."""
    SCRATCH.append(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    return SCRATCH[-1]


def drop_scratch(spark: SparkSession, paths: list[str]) -> None:
    """Remove tables that no frame in use reads any more."""
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        SCRATCH.remove(path)


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends there, and a lost executor costs nothing done so far."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def loose(df: DataFrame, parts: int | None = None) -> DataFrame:
    """An aggregate, dealt out anew before it is joined.

    A join right on top of an aggregate is tied to its partitions, and Spark can't split a hot key of the other side. The aggregate has one row a
    key, so it is the cheap side to move.
    """
    return df.repartition(parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def drop_columns(df: DataFrame, *names: str) -> DataFrame:
    """Columns of the input that an operator's own columns replace (case is ignored, as Spark does)."""
    low = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in low])


def text_of(name: str = "text") -> Column:
    """A text column in which null counts as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))
