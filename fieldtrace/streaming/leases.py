"""Claims, leases and fences of jobs: one rule, as a batch fold and as keyed stream state with timers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

LEASE_SECONDS = 60
MAX_ATTEMPTS = 3
#: state, owner, generation, attempts, end of the lease in epoch seconds
START = ("none", None, 0, 0, 0.0)
OUTCOME = "job long, seq long, kind string, outcome string, generation long"


def step(state: tuple, kind: str, owner: str | None, generation: int | None, at: float, lease: float = LEASE_SECONDS) -> tuple[tuple, str]:
    """The next state of a job and the outcome of one event.

    A queued job, or a running one whose lease has ended, can be claimed; each
    claim is a new generation, and after three attempts the job has failed. A
    heartbeat or completion counts only from the owner of the present
    generation while the lease lasts; all others have lost it.
    """
    name, holder, gen, attempts, until = state
    if kind == "enqueue":
        return (state, "known") if name != "none" else (("queued", None, gen, 0, 0.0), "queued")
    if kind == "claim":
        if name == "none":
            return state, "unknown"
        if name == "queued" or (name == "running" and until < at):
            if attempts >= MAX_ATTEMPTS:
                return ("failed", holder, gen, attempts, 0.0), "RETRIES_EXHAUSTED"
            return ("running", owner, gen + 1, attempts + 1, at + lease), "claimed"
        return state, "busy"
    if name != "running" or holder != owner or gen != generation or until <= at:
        return state, "LEASE_LOST"
    if kind == "heartbeat":
        return ("running", holder, gen, attempts, at + lease), "extended"
    if kind == "complete":
        return ("done", holder, gen, attempts, 0.0), "completed"
    return state, "unknown"


def _given(row) -> tuple:
    return row.kind, None if pd.isna(row.owner) else row.owner, None if pd.isna(row.generation) else int(row.generation), float(row.at)


def lease_log(events: DataFrame, lease: float = LEASE_SECONDS) -> DataFrame:
    """(job, seq, kind, outcome, generation) of events (job, seq, kind, owner, generation, at).

    ``at`` is in epoch seconds. A job's events stream through one task in order
    with one state in memory. Events without job, order, kind or time are left
    out; an empty table gives no rows.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        job, state = object(), START
        for f in frames:
            told = []
            for row in f.itertuples(index=False):
                if row.job != job:
                    job, state = row.job, START
                state, outcome = step(state, *_given(row), lease)
                told.append((row.job, row.seq, row.kind, outcome, state[2]))
            yield pd.DataFrame(told, columns=["job", "seq", "kind", "outcome", "generation"])

    known = events.filter("job is not null and seq is not null and kind is not null and at is not null").select("job", "seq", "kind", "owner", "generation", F.col("at").cast("double").alias("at"))
    return known.repartition("job").sortWithinPartitions("job", "seq").mapInPandas(run, OUTCOME)


class _Leases(StatefulProcessor):
    """The same rule on a stream; a lease that ends without an event ends by its timer."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("job", "name string, owner string, generation long, attempts long, until double")

    def _held(self) -> tuple:
        return tuple(self.state.get()) if self.state.exists() else START

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803 - Spark's names
        state, told = self._held(), []
        f = pd.concat(list(rows)).sort_values("seq")  # one job's events of one batch
        for row in f.itertuples(index=False):
            before = state[4]
            state, outcome = step(state, *_given(row))
            told.append((key[0], row.seq, row.kind, outcome, state[2]))
            if state[4] > before:
                self.handle.registerTimer(int(state[4] * 1000))
        self.state.update(state)
        yield pd.DataFrame(told, columns=["job", "seq", "kind", "outcome", "generation"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803 - Spark's names
        name, owner, generation, attempts, until = self._held()
        if name == "running" and int(until * 1000) <= expiredTimerInfo.getExpiryTimeInMs():  # not extended since
            self.state.update(("queued", None, generation, attempts, 0.0))
            yield pd.DataFrame([(key[0], None, "timer", "expired", generation)], columns=["job", "seq", "kind", "outcome", "generation"]).astype({"seq": "Int64"})

    def close(self) -> None:
        pass


def lease_stream(events: DataFrame, late: str = "10 seconds") -> DataFrame:
    """As ``lease_log`` over a stream with a timestamp ``ts``; needs the RocksDB state store."""
    timed = events.withWatermark("ts", late).withColumn("at", F.col("ts").cast("double"))
    return timed.groupBy("job").transformWithStateInPandas(_Leases(), OUTCOME, "Append", "EventTime")
