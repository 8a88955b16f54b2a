"""Change logs, sessions, rate windows and rollups, in batch form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def delta(log: DataFrame, session: int, after: int, limit: int) -> DataFrame:
    """The next ``limit`` changes of a session, and of none, by sequence."""
    return log.filter(((F.col("session") == session) | F.col("session").isNull()) & (F.col("sequence") > after)).orderBy("sequence").limit(limit)


def working_memory(writes: DataFrame) -> DataFrame:
    """session, key, value: the last write of each key."""
    return writes.groupBy("session", "key").agg(F.max_by("value", "sequence").alias("value"))


def rate_windows(events: DataFrame, limit: int, seconds: int = 3600) -> DataFrame:
    """user_id, bucket, n, allowed, refused of each user and fixed window."""
    bucket = F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / seconds)
    counts = events.groupBy("user_id", bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("allowed", F.least("n", F.lit(limit))).withColumn("refused", F.col("n") - F.col("allowed"))


def probe_rollup(events: DataFrame, path: Column, seconds: int = 300, prefixes: list[str] | None = None) -> DataFrame:
    """path, bucket, n: requests a path, query string off, and tumbling window.

    With ``prefixes`` only paths that are one of them, or go on with a "/" after one.
    """
    bucket = F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / seconds)
    rows = events.select(F.regexp_replace(path, r"\?.*$", "").alias("path"), bucket.alias("bucket"))
    if prefixes is not None:
        rows = rows.filter(F.exists(F.array(*map(F.lit, prefixes)), lambda p: (F.col("path") == p) | F.startswith(F.col("path"), F.concat(p, F.lit("/")))))
    return rows.groupBy("path", "bucket").agg(F.count(F.lit(1)).alias("n"))


def crossings(counts: DataFrame, marks: tuple[int, ...] = (1, 5, 10), every: int = 10) -> DataFrame:
    """Rows (key, old, new) where a mark, or a multiple of ``every``, lies in (old, new]."""
    hit = F.exists(F.array(*map(F.lit, marks)), lambda m: (m > F.col("old")) & (m <= F.col("new")))
    return counts.filter(hit | (F.floor(F.col("new") / every) > F.floor(F.col("old") / every)))


def checkpoints(rows: DataFrame) -> DataFrame:
    """id, copies, conflict: one checkpoint a session and key, a conflict where contents differ."""
    ident = F.sha2(F.concat_ws("\x00", F.col("session").cast("string"), "key"), 256)
    return rows.groupBy(ident.alias("id")).agg(F.count(F.lit(1)).alias("copies"), (F.count_distinct("content") > 1).alias("conflict"))


def gap_sessions(events: DataFrame, seconds: int) -> DataFrame:
    """user_id, session, n, first, last of runs of events less than ``seconds`` apart."""
    w = Window.partitionBy("user_id").orderBy("at", "event_id")
    timed = events.withColumn("at", F.unix_timestamp(F.col("ts").cast("timestamp")))
    new = F.when(F.col("at") - F.lag("at").over(w) >= seconds, 1).otherwise(0)
    cut = timed.withColumn("new", new).withColumn("session", F.sum("new").over(w))
    return cut.groupBy("user_id", "session").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"), F.max("at").alias("last"))
