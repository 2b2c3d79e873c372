"""An inverted-file index for vector search: rows in lists around centroids, of which a query reads the nearest few.

Centroids are fitted on a bounded sample (``sample_rows``); every row is assigned. The table of centroids has lists x width numbers whatever the
corpus, and is sent to the workers. How many lists a search must probe for a wanted recall depends on the data: ``fit_probes`` measures it. Write the index partitioned by ``list``, and a search prunes to the lists that it probes. With as many probes as
lists the search is exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeweave.operators.retrieval import knn_join


def unit(rows: object) -> np.ndarray:
    a = np.vstack(rows).astype("float64")  # type: ignore[call-overload]
    return a / np.maximum(np.linalg.norm(a, axis=1, keepdims=True), 1e-300)


def fit_centroids(vectors: DataFrame, lists: int, *, vector_col: str = "embedding", sample_rows: int = 20_000, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Spherical k-means on a sample of at most ``sample_rows`` rows. An empty frame gives no centroids."""
    n = vectors.count()
    sample = vectors.select(vector_col) if n <= sample_rows else vectors.select(vector_col).sample(fraction=sample_rows / n, seed=seed).limit(sample_rows)
    rows = [r[0] for r in sample.where(F.col(vector_col).isNotNull()).collect()]
    if not rows:
        return np.zeros((0, 0))
    x = unit(rows)
    c = x[np.random.default_rng(seed).permutation(len(x))[: min(lists, len(x))]]
    for _ in range(rounds):
        own = np.argmax(x @ c.T, axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        full = np.linalg.norm(sums, axis=1) > 0
        c = np.where(full[:, None], sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-300), c)
    return c


def nearest_lists(df: DataFrame, centroids: np.ndarray, probes: int, vector_col: str = "embedding") -> DataFrame:
    """``df`` with ``lists``: its nearest centroids, the nearest first."""
    shared = df.sparkSession.sparkContext.broadcast(centroids)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", lists array<int>"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            near = np.argsort(-(unit(pdf[vector_col].tolist()) @ shared.value.T), axis=1, kind="stable")[:, :probes] if len(pdf) else []
            yield pdf.assign(lists=list(near))

    return df.where(F.col(vector_col).isNotNull()).mapInPandas(run, schema)


def build_index(vectors: DataFrame, centroids: np.ndarray, vector_col: str = "embedding") -> DataFrame:
    """Every row with its ``list``."""
    return nearest_lists(vectors, centroids, 1, vector_col).withColumn("list", F.col("lists")[0]).drop("lists")


def search_index(queries: DataFrame, index: DataFrame, centroids: np.ndarray, k: int, probes: int, *, query_id: str = "query_id", id_col: str = "chunk_id", vector_col: str = "embedding") -> DataFrame:
    """The k best rows of the probed lists for each query: query, id, score, rank from 1 (ties by id).

    Rows of a list are scored against all queries that probe it by one product of matrices, of which k a query stay; there is no row for a query and a vector, and no shuffle of the index, so no list is too hot.
    """
    q = nearest_lists(queries.select(query_id, vector_col), centroids, probes, vector_col)
    return knn_join(q, index, k, query_id=query_id, id_col=id_col, vector_col=vector_col, lists=("lists", "list"))


def fit_probes(index: DataFrame, centroids: np.ndarray, k: int, *, target: float = 0.95, sample_queries: int = 200, id_col: str = "chunk_id", vector_col: str = "embedding") -> int:
    """The least number of probes that finds the share ``target`` of the true k nearest of sampled rows, themselves left out; all lists where the sample is empty.

    The sample is of ``sample_queries`` rows at most; its neighbours are searched exactly in the whole index, in one pass.
    """
    asked = index.where(F.col(vector_col).isNotNull()).orderBy(F.xxhash64(id_col), id_col).limit(sample_queries).select(F.col(id_col).alias("_asked"), vector_col)
    near = knn_join(asked, index, k, query_id="_asked", id_col=id_col, vector_col=vector_col, exclude_self=True)
    own = index.select(id_col, "list").join(F.broadcast(near.select("_asked", id_col)), id_col)  # sample_queries x k rows
    order = nearest_lists(asked, centroids, max(1, len(centroids)), vector_col).select("_asked", "lists")
    needed = sorted(r.n for r in own.join(F.broadcast(order), "_asked").select(F.array_position("lists", F.col("list")).alias("n")).collect())
    return int(needed[min(len(needed), int(np.ceil(target * len(needed)))) - 1]) if needed else max(1, len(centroids))
