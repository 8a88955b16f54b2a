"""Streaming queries, run over all that the events table holds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.plans.registry import query
from recollect.sources.tables import table
from recollect.streaming import streams


@query("SELECT event_id AS sequence, user_id, event_type FROM events WHERE event_type IN ('purchase', 'signup')")
def t1_change_log_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.settle(streams.change_log(streams.events(spark, sf_dir), ["purchase", "signup"]))


@query("SELECT user_id AS session, event_type AS key, arg_max(value, event_id) AS value FROM events GROUP BY ALL")
def t5_working_memory_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.settle(streams.working_memory(streams.events(spark, sf_dir)), ["session", "key"])


@query("SELECT user_id, (floor(epoch(ts) / 3600) * 3600)::BIGINT AS start, count(*) AS n, least(count(*), 2) AS allowed FROM events GROUP BY 1, 2")
def t7_rate_windows_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.settle(streams.rate_windows(streams.events(spark, sf_dir), 2, late=streams.span(spark, sf_dir)), ["user_id", "start"])


@query("SELECT '/' || event_type AS path, (floor(epoch(ts) / 300) * 300)::BIGINT AS start, count(*) AS n FROM events GROUP BY 1, 2")
def t8_probe_rollup_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.lit("/"), "event_type", F.lit("?id="), F.col("event_id").cast("string"))
    return streams.settle(streams.probe_rollup(streams.events(spark, sf_dir), path, late=streams.span(spark, sf_dir)), ["path", "start"])


@query("SELECT event_id, user_id, event_type FROM events")
def t9_audit_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.audit(streams.events(spark, sf_dir).select("event_id", "user_id", "event_type"))


@query("SELECT user_id, event_id, ((n - 1) // 50)::INT AS flush, CASE WHEN (n - 1) // 50 < c // 50 THEN 'size' ELSE 'close' END AS trigger FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, count(*) OVER (PARTITION BY user_id) AS c FROM events)")
def t9_audit_flushes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's audit buffer, flushed at 50 events, and at the end."""
    return streams.flushed(streams.events(spark, sf_dir), table(spark, sf_dir, "events"))
