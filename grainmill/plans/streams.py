"""The batch form of the event-time queries (the streaming form shares their code)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..streaming import ingest
from .base import Plans, Tables

P = Plans()


@P.query("SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(sum(round(value * 1000)::BIGINT) / 1000, 3) AS total FROM events GROUP BY 1, 2")
def tumbling_windows(t: Tables) -> DataFrame:
    thousandths = t.events.withColumn("value", F.round(F.col("value") * 1000).cast("long"))
    w = ingest.tumbling(thousandths)
    return w.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round(F.col("total") / 1000, 3).alias("total"))


@P.query("SELECT w AS window_start, event_type, count(*) AS n FROM (SELECT event_type, unnest([date_trunc('hour', ts), date_trunc('hour', ts) - INTERVAL 1 HOUR]) AS w FROM events) GROUP BY 1, 2")
def sliding_windows(t: Tables) -> DataFrame:
    return ingest.sliding(t.events).select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n")


@P.query("""
    WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS session_start, count(*) AS n FROM s GROUP BY user_id, k
""")
def session_windows(t: Tables) -> DataFrame:
    return ingest.sessions(t.events).select("user_id", F.col("session_start").cast("timestamp_ntz").alias("session_start"), "n")


@P.query("SELECT count(DISTINCT event_id) AS events FROM events")
def dedup_events(t: Tables) -> DataFrame:
    return t.events.dropDuplicates(["event_id"]).agg(F.count("*").alias("events"))


QUERIES, SQL = P.QUERIES, P.SQL
