"""Streaming queries: each reads its table as a stream to its end and is checked against the batch answer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from factgate.plans.oracles import STREAMS
from factgate.streaming import ingest


def x1_ingest(s: SparkSession, d: str) -> DataFrame:
    return ingest.finish(ingest.ingest(ingest.stream_table(s, f"{d}/triples.parquet")), "append").select("triple_id", "trust", "accepted")


def x2_rates(s: SparkSession, d: str) -> DataFrame:
    return ingest.finish(ingest.admission_rates(ingest.ingest(ingest.stream_table(s, f"{d}/triples.parquet"))), "append")


def x3_sessions(s: SparkSession, d: str) -> DataFrame:
    return ingest.finish(ingest.sessions(ingest.stream_table(s, f"{d}/events.parquet")), "append")


QUERIES = {f.__name__: f for f in (x1_ingest, x2_rates, x3_sessions)}
ORACLE = STREAMS | {
    "x3_sessions": """
WITH o AS (SELECT *, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events WHERE ts IS NOT NULL),
m AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap >= INTERVAL 6 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM o)
SELECT user_id, min(ts) AS start, count(*) AS n, round(sum(value), 4) AS total FROM m GROUP BY user_id, k HAVING max(ts) + INTERVAL 6 HOUR <= (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 1 DAY FROM events)""",
}
