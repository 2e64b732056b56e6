"""Folds over event logs: versions, first writers, slots, claims, quotas, pages."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from fieldtrace.errors import FieldtraceError
from fieldtrace.operators.skew import salted_join


def first_per_key(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row of each key, as an aggregate: no window over a hot key."""
    rest = [c for c in rows.columns if c != key and c not in order]
    first = F.min(F.struct(*order, *rest)).alias("__f")
    return rows.groupBy(key).agg(first).select(key, "__f.*")


def idempotency(requests: DataFrame) -> DataFrame:
    """(key, seq, outcome) of requests (key, seq, request_hash).

    The first writer of a key is 'stored'; later ones with the same hash are
    'replayed', others a 'conflict'. The first writers are aggregated and
    joined back. Requests without a key are always 'stored'.
    """
    first = requests.filter("key is not null").groupBy("key").agg(F.min(F.struct("seq", "request_hash")).alias("f"))
    told = salted_join(requests, first, "key", "left")
    outcome = F.when(F.col("f").isNull() | (F.col("seq") == F.col("f.seq")), "stored").when(F.col("request_hash").eqNullSafe(F.col("f.request_hash")), "replayed").otherwise("conflict")
    return told.select("key", "seq", outcome.alias("outcome"))


def version_chain(writes: DataFrame) -> DataFrame:
    """(key, seq, expected, accepted) of optimistic writes (key, seq, expected_version).

    A write is accepted if it expects the number of writes accepted before it;
    the fold streams over rows sorted by key and sequence with constant memory.
    """

    def step(state, row):
        ok = row[2] == state
        return (state + 1 if ok else state), ok

    return _fold(writes.select("key", "seq", F.col("expected_version").cast("long").alias("value")), 0, step).select("key", "seq", F.col("value").alias("expected"), "accepted")


def quota(puts: DataFrame) -> DataFrame:
    """(key, seq, size, accepted): greedy reservation under a limit per key.

    ``puts``: (key, seq, size, limit). A put that would exceed the limit is
    rejected and later smaller ones may still fit, so it is a true fold; rows
    of a key stream through one task in order, none are gathered.
    """

    def step(used, row):
        ok = used + row[2] <= row[3]
        return (used + row[2] if ok else used), ok

    return _fold(puts.select("key", "seq", F.col("size").cast("long").alias("value"), F.col("limit").cast("long").alias("extra")), 0, step).select("key", "seq", F.col("value").alias("size"), "accepted")


def _fold(rows: DataFrame, start, step) -> DataFrame:
    extra = "extra" in rows.columns

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = object(), start
        for f in frames:
            accepted = []
            for row in f.itertuples(index=False, name=None):
                if row[0] != key:
                    key, state = row[0], start
                state, ok = step(state, row)
                accepted.append(ok)
            yield f.assign(accepted=accepted)

    key_type, seq_type = (rows.schema[c].dataType.simpleString() for c in ("key", "seq"))
    schema = f"key {key_type}, seq {seq_type}, value long, {'extra long, ' if extra else ''}accepted boolean"
    ordered = rows.filter("key is not null and seq is not null and value is not null").repartition("key").sortWithinPartitions("key", "seq")
    return ordered.mapInPandas(run, schema)


def slots(requests: DataFrame, interval: Column) -> DataFrame:
    """(origin, seq, planned): each request's start when starts are spaced.

    ``requests``: (origin, seq, at) in seconds. planned = max(at, previous
    planned + interval), in closed form: a running maximum of at - k * interval.
    """
    by = Window.partitionBy("origin").orderBy("seq")
    k = F.row_number().over(by) - 1
    shifted = requests.withColumn("k", k).withColumn("s", F.col("at") - F.col("k") * interval)
    return shifted.withColumn("planned", F.max("s").over(by.rowsBetween(Window.unboundedPreceding, 0)) + F.col("k") * interval).select("origin", "seq", "planned")


def supersession(activations: DataFrame) -> DataFrame:
    """(source, seq, item, state): the last activation of a source is active."""
    last = activations.groupBy("source").agg(F.max("seq").alias("last"))
    return salted_join(activations, last, "source", "inner").select("source", "seq", "item", F.when(F.col("seq") == F.col("last"), "active").otherwise("superseded").alias("state"))


def due(schedules: DataFrame, now: Column, limit: int) -> DataFrame:
    """Schedules due at ``now``, earliest first; missed ticks count once."""
    ready = schedules.filter(F.col("next_due") <= now).orderBy("next_due", "id").limit(limit)
    missed = F.floor((F.unix_timestamp(now) - F.unix_timestamp("next_due")) / F.col("interval_s"))
    return ready.withColumn("missed", missed).withColumn("next_due", F.timestamp_seconds(F.unix_timestamp(now) + F.col("interval_s")))


def page(rows: DataFrame, key: str, after, limit: int) -> DataFrame:
    """Keyset page: the next ``limit`` rows after a key, in key order."""
    if limit < 1:
        raise FieldtraceError("LIMIT_REACHED", "a page needs at least one row")
    return (rows if after is None else rows.filter(F.col(key) > F.lit(after))).orderBy(key).limit(limit)


def page_desc(rows: DataFrame, first: str, second: str, before: tuple | None, limit: int) -> DataFrame:
    """Keyset page over two descending keys."""
    if before is not None:
        a, b = before
        rows = rows.filter((F.col(first) < F.lit(a)) | ((F.col(first) == F.lit(a)) & (F.col(second) < F.lit(b))))
    return rows.orderBy(F.desc(first), F.desc(second)).limit(limit)
