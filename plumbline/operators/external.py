"""Calls of external services over rows: bounded concurrency, retries, cached replies first, partial failure kept as rows."""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Retries of a call, the first delay and the longest one, in seconds.
ATTEMPTS, BASE_S, CAP_S = 5, 0.5, 30.0


class Retryable(Exception):
    """A failure that may pass: time-outs, rate limits, errors of the server."""


def delay(attempt: int, base: float = BASE_S, cap: float = CAP_S) -> float:
    """Seconds before the attempt after ``attempt`` (from 1), without jitter."""
    return min(base * 2 ** (attempt - 1), cap)


def with_retries(call: Callable[[str], str], text: str, attempts: int = ATTEMPTS, sleep: Callable[[float], None] = time.sleep) -> str:
    """The reply to ``text``; Retryable failures are tried again after growing, jittered delays."""
    for n in range(1, attempts + 1):
        try:
            return call(text)
        except Retryable:
            if n == attempts:
                raise
            sleep(delay(n) * random.uniform(0.5, 1.5))
    raise AssertionError("unreachable")


def call_rows(asked: DataFrame, cache: DataFrame, call: Callable[[str], str], concurrency: int = 4, fallbacks: Callable[[str, str], list[str]] | None = None) -> DataFrame:
    """(node_id, prompt_hash, file_hash, response, error, cached) for every row of ``asked`` (node_id, prompt_hash, file_hash, prompt).

    Rows that the cache (node_id, prompt_hash, file_hash, response) answers are not asked. The rest is asked in ``concurrency`` partitions; a prompt that fails is asked with its
    fallbacks in turn, and if all fail its row has the error. Null prompts fail. A repeated row is asked once."""
    keys = ["node_id", "prompt_hash", "file_hash"]
    known = asked.select(*keys).distinct().join(cache.select(*keys, "response"), keys)
    open_rows = asked.dropDuplicates(keys).join(cache.select(*keys), keys, "left_anti")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for node_id, prompt_hash, file_hash, prompt in pdf.itertuples(index=False, name=None):
                reply, error = None, "no prompt"
                for text in [] if prompt is None else [prompt, *(fallbacks(node_id, prompt) if fallbacks else [])]:
                    try:
                        reply, error = with_retries(call, text), None
                        break
                    except Exception as e:  # a row that fails must not end the job
                        error = f"{type(e).__name__}: {e}"[:500]
                rows.append((node_id, prompt_hash, file_hash, reply, error))
            yield pd.DataFrame(rows, columns=[*keys, "response", "error"])

    fresh = open_rows.select(*keys, "prompt").repartition(concurrency).mapInPandas(run, "node_id string, prompt_hash string, file_hash string, response string, error string")
    hits = known.select(*keys, "response", F.lit(None).cast("string").alias("error"), F.lit(True).alias("cached"))
    return hits.unionByName(fresh.withColumn("cached", F.lit(False)))


def poll(status: Callable[[], str], done: tuple[str, ...] = ("completed", "failed", "expired", "cancelled"), every: float = 30.0, limit: int = 2880, sleep: Callable[[float], None] = time.sleep) -> str:
    """Ask for a job's status until it is final; raises after ``limit`` questions."""
    for _ in range(limit):
        got = status()
        if got in done:
            return got
        sleep(every)
    raise TimeoutError(f"no final status after {limit} questions")
