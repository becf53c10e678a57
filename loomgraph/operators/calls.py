"""What surrounds calls: retries with growing delays, a ceiling on calls at once, counters that expire."""

from __future__ import annotations

import functools
import random
import threading
import time
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RETRIES, BASE_S, MOST_S, FACTOR = 3, 1.0, 60.0, 2.0


def delay(attempt: Column, base: float = BASE_S, most: float = MOST_S, factor: float = FACTOR) -> Column:
    """Seconds before retry number ``attempt`` (0 is the first): base * factor^attempt, ``most`` at most."""
    return F.least(F.lit(most), F.lit(base) * F.pow(F.lit(factor), attempt))


def delay_of(attempt: int, base: float = BASE_S, most: float = MOST_S, factor: float = FACTOR, jitter: float = 0.0, draw: Callable[[], float] = random.random) -> float:
    """The same for one call, plus or minus up to ``jitter`` of it, never below 0."""
    plain = min(most, base * factor**attempt)
    return max(0.0, plain + plain * jitter * (2 * draw() - 1))


def with_retry(*kinds: type[Exception], retries: int = RETRIES, wait: Callable[[float], None] = time.sleep, **delays: float):
    """A decorator: calls again after errors of these kinds, ``retries`` times, then lets the last one through. Other errors pass at once."""

    def wrap(f: Callable) -> Callable:
        @functools.wraps(f)
        def run(*args, **kwargs):
            for attempt in range(retries + 1):
                try:
                    return f(*args, **kwargs)
                except kinds:
                    if attempt == retries:
                        raise
                    wait(delay_of(attempt, **delays))

        return run

    return wrap


class CallLimiter:
    """At most ``most`` calls at once in this process; over a cluster the ceiling is that times the tasks that run at once."""

    def __init__(self, most: int) -> None:
        if most < 1:
            raise ValueError("the ceiling must be positive")
        self._free = threading.BoundedSemaphore(most)

    def __call__(self, f: Callable, *args, **kwargs):
        with self._free:
            return f(*args, **kwargs)


class ExpiringCounter:
    """Counts by key; a key's time to live runs from its first count and later counts don't renew it."""

    def __init__(self, ttl_s: float) -> None:
        self.ttl_s, self.held = ttl_s, {}

    def increment(self, key, now: float) -> int:
        n, until = self.held.get(key, (0, now))
        n, until = (n + 1, until) if n and now < until else (1, now + self.ttl_s)
        self.held[key] = (n, until)
        return n


def expiring_counts(hits: DataFrame, ttl_s: int) -> DataFrame:
    """tenant, event_id, n: the counter after each hit (tenant, ts, event_id). Depends on order: a tenant's times are one group."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        counter = ExpiringCounter(ttl_s * 1_000_000)
        frame = frame.sort_values(["t", "event_id"])
        return pd.DataFrame({"tenant": frame["tenant"], "event_id": frame["event_id"], "n": [counter.increment(0, t) for t in frame["t"].tolist()]})

    kind = dict(hits.dtypes)
    return hits.select("tenant", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t")).groupBy("tenant").applyInPandas(run, f"tenant {kind['tenant']}, event_id {kind['event_id']}, n long")
