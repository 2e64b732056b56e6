"""Queries that run as bounded streams, and proposals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from fieldtrace.plans.propose import name_ratio
from fieldtrace.queries.registry import Registry
from fieldtrace.runtime import table
from fieldtrace.streaming import events as V, leases as L

query = Registry()


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS events, round(sum(value), 4) AS total FROM events WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 2 HOUR FROM events) GROUP BY ALL")
def stream_windows(spark: SparkSession, d: str) -> DataFrame:
    """Hourly counts of a stream; windows the watermark hasn't passed stay open."""
    told = V.run_to_table(V.windowed_counts(V.read_events(spark, f"{d}/events.parque[t]")))
    return told.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "events", F.round("total", 4).alias("total"))


@query("SELECT user_id, count(*) AS events, arg_max(event_type, (ts, event_id)) AS last_type, max(value) AS most FROM events GROUP BY user_id")
def stream_jobs(spark: SparkSession, d: str) -> DataFrame:
    """Keyed state of every user at the end of the stream."""
    own = V.state_session(spark)
    told = V.run_to_table(V.job_states(V.read_events(own, f"{d}/events.parque[t]")), "update", spark)
    last = told.groupBy("user_id").agg(F.max(F.struct("batch", "events", "last_type", "most")).alias("s"))
    return last.select("user_id", "s.events", "s.last_type", "s.most")


_KINDS = "CASE WHEN n = 1 THEN 'enqueue' WHEN event_id % 5 < 2 THEN 'claim' WHEN event_id % 5 < 4 THEN 'heartbeat' ELSE 'complete' END"


@query(f"""WITH RECURSIVE o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
e AS (SELECT user_id AS job, n, {_KINDS} AS kind, 'w' || (event_id % 2) AS owner, 1 + (n // 6) AS gen, n * 25.0 AS moment FROM o),
s AS (SELECT DISTINCT job, CAST(0 AS BIGINT) AS n, 'none' AS name, NULL::VARCHAR AS holder, CAST(0 AS BIGINT) AS g, 0 AS att, 0.0::DOUBLE AS til, '' AS kind, '' AS outcome FROM e
 UNION ALL SELECT job, n, CASE outcome WHEN 'queued' THEN 'queued' WHEN 'claimed' THEN 'running' WHEN 'RETRIES_EXHAUSTED' THEN 'failed' WHEN 'completed' THEN 'done' ELSE name END, CASE WHEN outcome = 'claimed' THEN owner ELSE holder END,
  g + CASE WHEN outcome = 'claimed' THEN 1 ELSE 0 END, att + CASE WHEN outcome = 'claimed' THEN 1 ELSE 0 END, CASE WHEN outcome IN ('claimed', 'extended') THEN moment + 60 WHEN outcome IN ('RETRIES_EXHAUSTED', 'completed', 'queued') THEN 0 ELSE til END, kind, outcome
 FROM (SELECT s.job, e.n, e.kind, e.owner, e.moment, name, holder, g, att, til, CASE
   WHEN e.kind = 'enqueue' THEN CASE WHEN name = 'none' THEN 'queued' ELSE 'known' END
   WHEN e.kind = 'claim' THEN CASE WHEN name = 'none' THEN 'unknown' WHEN name = 'queued' OR (name = 'running' AND til < e.moment) THEN CASE WHEN att >= 3 THEN 'RETRIES_EXHAUSTED' ELSE 'claimed' END ELSE 'busy' END
   WHEN name <> 'running' OR holder <> e.owner OR g <> e.gen OR til <= e.moment THEN 'LEASE_LOST' WHEN e.kind = 'heartbeat' THEN 'extended' ELSE 'completed' END AS outcome
  FROM s JOIN e ON e.job = s.job AND e.n = s.n + 1))
SELECT job, n AS seq, kind, outcome, g AS generation FROM s WHERE n > 0""")
def lease_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """Claims, heartbeats and completions of every user's events as one job each."""
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    e = table(spark, d, "events").filter("user_id is not null").select("user_id", "event_id", n.cast("long").alias("n"))
    kind = F.when(F.col("n") == 1, "enqueue").when(F.col("event_id") % 5 < 2, "claim").when(F.col("event_id") % 5 < 4, "heartbeat").otherwise("complete")
    owner = F.concat(F.lit("w"), F.col("event_id") % 2)
    return L.lease_log(e.select(F.col("user_id").alias("job"), F.col("n").alias("seq"), kind.alias("kind"), owner.alias("owner"), (1 + F.floor(F.col("n") / 6)).alias("generation"), (F.col("n") * 25).alias("at")))


@query()
def propose_mapping(spark: SparkSession, d: str) -> DataFrame:
    """The closest listing column for each leaf name of a wanted schema."""
    wanted = ["productName", "brand", "articleNumber", "shortText", "url", "categoryName"]
    columns = table(spark, d, "products").columns
    pairs = spark.createDataFrame([(w, c) for w in wanted for c in columns], "leaf string, column_name string")  # names of two schemas
    scored = pairs.withColumn("ratio", F.round(name_ratio(F.replace("leaf", F.lit("_"), F.lit("")), F.replace("column_name", F.lit("_"), F.lit(""))), 6))
    best = scored.groupBy("leaf").agg(F.min(F.struct((-F.col("ratio")).alias("r"), "column_name")).alias("b"))
    return best.select("leaf", "b.column_name", (-F.col("b.r")).alias("ratio"))


QUERIES, SQL = query.queries, query.sql
