"""Structured Streaming over event files: windows with late data, keyed state.

Both run as bounded streams (availableNow) and as unbounded ones; state lives
in the checkpoint folder, so a restarted query resumes without double counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from fieldtrace.sources.artifacts import scratch

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """A stream of event files; events without a time or user have no place in it."""
    return spark.readStream.schema(EVENTS).parquet(path).withColumn("ts", F.col("ts").cast("timestamp")).filter("ts is not null and user_id is not null")


def windowed_counts(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and sums per tumbling window and type; events later than ``late`` are dropped."""
    w = F.window("ts", window)
    told = events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("events"), F.sum("value").alias("total"))
    return told.select(F.col("w.start").alias("start"), "event_type", "events", "total")


class _Jobs(StatefulProcessor):
    """Per user: number of events, last time and type, greatest value."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("job", "events long, last_ts timestamp, last_type string, most double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:  # noqa: N802 - Spark's name
        held = self.state.get() if self.state.exists() else None
        n, last, kind, most = held if held else (0, None, None, None)
        for f in rows:
            f = f.sort_values(["ts", "event_id"])
            n += len(f)
            end = f.iloc[-1]
            if last is None or end["ts"] >= pd.Timestamp(last):
                last, kind = end["ts"].to_pydatetime(), end["event_type"]
            top = float(f["value"].max())
            most = top if most is None else max(most, top)
        self.state.update((int(n), last, kind, most))
        yield pd.DataFrame({"user_id": [key[0]], "events": [int(n)], "last_type": [kind], "most": [most]})

    def close(self) -> None:
        pass


def state_session(spark: SparkSession) -> SparkSession:
    """A session of its own with the state store that keyed state with timers needs; the given one stays as it is."""
    own = spark.newSession()
    own.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    for name in ("spark.sql.session.timeZone", "spark.sql.shuffle.partitions"):
        own.conf.set(name, spark.conf.get(name))
    return own


def job_states(events: DataFrame) -> DataFrame:
    """The state of every user after each batch that touched it."""
    return events.groupBy("user_id").transformWithStateInPandas(_Jobs(), "user_id long, events long, last_type string, most double", "Update", "None")


def run_to_table(stream: DataFrame, mode: str = "append", reader: SparkSession | None = None) -> DataFrame:
    """Runs a bounded stream to its end into a folder and reads it (in the session ``reader``, if given)."""
    spark = stream.sparkSession
    out, state = scratch(spark), scratch(spark)
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", state).trigger(availableNow=True)
    if mode == "append":
        query.format("parquet").option("path", out).start().awaitTermination()
    else:
        def write(batch: DataFrame, number: int) -> None:
            batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/batch={number}")

        query.foreachBatch(write).start().awaitTermination()
    return (reader or spark).read.parquet(out)
