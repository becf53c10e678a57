"""Rate windows, admission and circuit breaking replayed over call logs."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

WINDOW_S, FAILURES, RECOVERY_S = 60, 5, 60


def trailing_hits(hits: DataFrame, seconds: int = WINDOW_S, per_minute: int = 60) -> DataFrame:
    """``hits`` (tenant, ts) with the count and the oldest of the trailing window, both ends included, and what remains."""
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    over = Window.partitionBy("tenant").orderBy(at).rangeBetween(-seconds * 1_000_000, 0)
    return hits.withColumns({"hits": F.count("*").over(over), "oldest": F.min("ts").over(over)}).withColumn("remaining", F.greatest(F.lit(0), F.lit(per_minute) - F.col("hits")))


class Admission:
    """Admits a call while fewer than ``limit`` admitted ones lie in the trailing window; refused ones aren't recorded."""

    def __init__(self, limit: int, seconds: float = WINDOW_S) -> None:
        self.limit, self.seconds, self.kept = limit, seconds, deque()

    def __call__(self, now: float) -> tuple[bool, float | None]:
        while self.kept and self.kept[0] < now - self.seconds:
            self.kept.popleft()
        if len(self.kept) >= self.limit:
            return False, self.kept[0] + self.seconds - now
        self.kept.append(now)
        return True, None


def admissions(hits: DataFrame, limit: int, seconds: int = WINDOW_S) -> DataFrame:
    """tenant, event_id, admitted, retry_after. Depends on order: a tenant's times (not its rows) are one group."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        gate = Admission(limit, seconds * 1_000_000)  # whole microseconds, so no sum is rounded
        frame = frame.sort_values(["t", "event_id"])
        said = [gate(t) for t in frame["t"].tolist()]
        return pd.DataFrame({"tenant": frame["tenant"], "event_id": frame["event_id"], "admitted": [a for a, _ in said], "retry_after": [None if r is None else r / 1e6 for _, r in said]}).astype({"retry_after": "float64"})

    kind = dict(hits.dtypes)
    return hits.select("tenant", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t")).groupBy("tenant").applyInPandas(run, f"tenant {kind['tenant']}, event_id {kind['event_id']}, admitted boolean, retry_after double")


class Breaker:
    """closed -> open after ``failures`` in a row -> half open after ``recovery`` seconds -> closed on success, open on failure."""

    def __init__(self, failures: int = FAILURES, recovery: float = RECOVERY_S) -> None:
        self.most, self.recovery = failures, recovery
        self.state, self.count, self.since = "closed", 0, 0.0

    def allow(self, now: float) -> bool:
        if self.state == "open" and now - self.since >= self.recovery:
            self.state = "half_open"
        return self.state != "open"

    def record(self, ok: bool, now: float) -> None:
        if ok:
            self.state, self.count = "closed", 0
            return
        self.count += 1
        if self.state == "half_open" or self.count >= self.most:
            self.state, self.since = "open", now


def breaker_states(calls: DataFrame, failures: int = FAILURES, recovery: int = RECOVERY_S) -> DataFrame:
    """tenant, event_id, allowed, state after the call. calls: tenant, event_id, ts, ok."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["t", "event_id"])
        b, out = Breaker(failures, recovery), []
        for t, ok in zip((frame["t"] / 1e6).tolist(), frame["ok"].tolist()):
            allowed = b.allow(t)
            if allowed:
                b.record(bool(ok), t)
            out.append((allowed, b.state))
        return pd.DataFrame({"tenant": frame["tenant"], "event_id": frame["event_id"], "allowed": [a for a, _ in out], "state": [s for _, s in out]})

    kind = dict(calls.dtypes)
    return calls.select("tenant", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), "ok").groupBy("tenant").applyInPandas(run, f"tenant {kind['tenant']}, event_id {kind['event_id']}, allowed boolean, state string")


def admit_stream(hits: DataFrame, limit: int, seconds: int = WINDOW_S) -> DataFrame:
    """The same admission over a stream: the state of a tenant is the times it was admitted within the window."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    out = "tenant string, event_id long, admitted boolean, retry_after double"

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        gate = Admission(limit, seconds)
        if state.exists:
            gate.kept.extend(state.get[0])
        frame = pd.concat(list(frames)).sort_values(["t", "event_id"])
        said = [gate(t / 1e6) for t in frame["t"].tolist()]
        state.update((list(gate.kept),))
        yield pd.DataFrame({"tenant": [key[0]] * len(frame), "event_id": frame["event_id"].to_numpy(), "admitted": [a for a, _ in said], "retry_after": pd.Series([r for _, r in said], dtype="float64")})

    rows = hits.select(F.col("tenant").cast("string").alias("tenant"), "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    return rows.groupBy("tenant").applyInPandasWithState(run, out, "kept array<double>", "append", GroupStateTimeout.NoTimeout)
