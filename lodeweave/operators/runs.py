"""Ingestion runs: the plan with its frozen parameters, progress and transitions, usage and cost, and what limits calls to a provider."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeweave.config import EngineConfig
from lodeweave.operators.ingest import KEY, cost_micros, price

ERROR_CHARS = 2000
#: Seconds to wait before each further try of a group of texts.
BACKOFF = (10, 30, 60, 120, 300)
TERMINAL = ("completed", "failed", "cancelled")


def plan(drafts: DataFrame, config: EngineConfig, run_id: str, mode: str) -> DataFrame:
    """One pending item for each document of a run, with the parameters that the run was planned with."""
    c = config.chunking
    frozen = {"run_id": run_id, "mode": mode, "embedding_model": config.embedding_model, "dimensions": config.dimensions, "params_checksum": c.checksum(config.embedding_model, config.dimensions)}
    return drafts.select(*KEY).distinct().select(*[F.lit(v).alias(k) for k, v in frozen.items()], *KEY, F.lit("pending").alias("status"))


def record(items: DataFrame, results: DataFrame) -> DataFrame:
    """Items with the results of their documents (KEY, status, error, counters): an error is cut to ERROR_CHARS; an item without a result stays as it is."""
    counters = [c for c in results.columns if c not in (*KEY, "status", "error")]
    r = results.select(*KEY, F.col("status").alias("_status"), F.substring("error", 1, ERROR_CHARS).alias("error"), *counters)
    return items.drop("error", *counters).join(r, KEY, "left").withColumn("status", F.coalesce("_status", "status")).drop("_status")


def transition(runs: DataFrame, to: str, now: Column) -> DataFrame:
    """Runs in a new status: chunking sets ``started_at`` once, a terminal status ``finished_at``; a run that has ended stays as it is."""
    ended = F.col("status").isin(*TERMINAL)
    started = F.when(~ended & F.lit(to == "chunking"), F.coalesce("started_at", now)).otherwise(F.col("started_at"))
    finished = F.when(~ended & F.lit(to in TERMINAL), now).otherwise(F.col("finished_at"))
    return runs.withColumns({"started_at": started, "finished_at": finished, "status": F.when(ended, F.col("status")).otherwise(F.lit(to))})


def usage(calls: DataFrame, by: list[str]) -> DataFrame:
    """Calls and tokens in and out, added up."""
    return calls.groupBy(*by).agg(F.count("*").alias("calls"), *[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("input_tokens", "output_tokens")])


def usage_cost(used: DataFrame, prices: DataFrame) -> DataFrame:
    """``usage`` of models with what it cost, in micro-dollars."""
    return price(used, prices).withColumn("cost_micros", cost_micros(F.col("input_tokens") + F.col("output_tokens"), F.col("micros_per_token"))).drop("micros_per_token")


def refresh_due(asked_at: Column, refreshed_at: Column, now: Column, delay_seconds: int = 60, unique_seconds: int = 600) -> Column:
    """Statistics are refreshed ``delay_seconds`` after they are asked for, and not again within ``unique_seconds``."""
    late = F.unix_timestamp(now) - F.unix_timestamp(asked_at) >= delay_seconds
    return late & (refreshed_at.isNull() | (F.unix_timestamp(now) - F.unix_timestamp(refreshed_at) >= unique_seconds))


@dataclass
class RateLimiter:
    """At most ``calls`` calls in ``seconds``, for each worker that holds one: wrap an embedder in it, with the provider's limit shared out over the workers."""

    calls: int = 500
    seconds: float = 60.0
    clock: Callable[[], float] = time.monotonic
    sleep: Callable[[float], None] = time.sleep
    taken: list[float] = field(default_factory=list)

    def wait(self) -> None:
        while True:
            now = self.clock()
            self.taken = [t for t in self.taken if now - t < self.seconds]
            if len(self.taken) < self.calls:
                self.taken.append(now)
                return
            self.sleep(self.seconds - (now - self.taken[0]))


def with_retries(embed: Callable[[list[str]], list[list[float]]], limiter: RateLimiter | None = None, backoff: tuple[float, ...] = BACKOFF, sleep: Callable[[float], None] = time.sleep) -> Callable[[list[str]], list[list[float]]]:
    """An embedder that is called again, after a while, when it fails; the last failure is raised."""

    def call(texts: list[str]) -> list[list[float]]:
        for pause in (*backoff, None):
            if limiter:
                limiter.wait()
            try:
                return embed(texts)
            except Exception:  # noqa: BLE001  a provider's own
                if pause is None:
                    raise
                sleep(pause)
        raise AssertionError

    return call
