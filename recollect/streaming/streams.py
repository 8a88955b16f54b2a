"""Structured Streaming forms of the change log, working memory, rate windows and rollups.

Each takes a streaming DataFrame of events and returns another; ``settle`` runs one over what
its source holds now and returns what the sink has then.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.errors import StreamingQueryException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState

from recollect.sources.shared import shared_dir

#: How late an event of a live stream may come and still count.
LATE = "30 days"


def events(spark: SparkSession, sf_dir: str, name: str = "events", files_per_batch: int = 1000) -> DataFrame:
    """A table's files as a stream, times as timestamps."""
    path = f"{sf_dir}/{name}.parquet"
    batch = spark.read.parquet(path)
    source = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", files_per_batch)
    if any(f.rstrip("/").endswith(f"/{name}.parquet") for f in batch.inputFiles()):
        stream = source.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)
    else:
        stream = source.parquet(path)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def span(spark: SparkSession, sf_dir: str, name: str = "events") -> str:
    """The days that a table's times span, as a watermark's delay: a replay in which no row is late, whatever its files' order."""
    ends = spark.read.parquet(f"{sf_dir}/{name}.parquet").agg(F.min("ts").cast("timestamp").alias("a"), F.max("ts").cast("timestamp").alias("b"))
    days = ends.select(F.coalesce(F.datediff("b", "a"), F.lit(0))).first()[0]
    return f"{days + 2} days"


def change_log(stream: DataFrame, kinds: list[str]) -> DataFrame:
    """The changes that are kept, to be appended."""
    return stream.filter(F.col("event_type").isin(kinds)).select(F.col("event_id").alias("sequence"), "user_id", "event_type")


def working_memory(stream: DataFrame) -> DataFrame:
    """The last write of each session and key."""
    return stream.groupBy(F.col("user_id").alias("session"), F.col("event_type").alias("key")).agg(F.max_by("value", "event_id").alias("value"))


def rate_windows(stream: DataFrame, limit: int, width: str = "1 hour", late: str = LATE) -> DataFrame:
    counts = stream.withWatermark("ts", late).groupBy("user_id", F.window("ts", width)).agg(F.count(F.lit(1)).alias("n"))
    return counts.select("user_id", F.unix_timestamp("window.start").alias("start"), "n", F.least("n", F.lit(limit)).alias("allowed"))


def probe_rollup(stream: DataFrame, path: Column, width: str = "300 seconds", late: str = LATE) -> DataFrame:
    counts = stream.withWatermark("ts", late).groupBy(F.regexp_replace(path, r"\?.*$", "").alias("path"), F.window("ts", width)).agg(F.count(F.lit(1)).alias("n"))
    return counts.select("path", F.unix_timestamp("window.start").alias("start"), "n")


def buffers(stream: DataFrame, key: str = "user_id", size: int = 50, seconds: float = 5.0) -> DataFrame:
    """key, event_id, flush, trigger: events as buffers hand them on, one buffer a key.

    A buffer is flushed when it holds ``size`` events (``size``), or ``seconds`` after the first
    of them came (``time``), by a timer that later events don't put off. ``flush`` numbers a
    buffer's flushes. What a failed batch flushed is in its buffer again, since state and
    deadlines are those of the batch before.
    """

    def run(own: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, n, deadline = ([], 0, 0) if not state.exists else (list(state.get[0]), state.get[1], state.get[2])
        out = []
        if state.hasTimedOut:
            out, held, n = [(e, n, "time") for e in held], [], n + 1
        else:
            came = sorted(e for b in batches for e in b["event_id"].tolist())
            now = state.getCurrentProcessingTimeMs()
            deadline = deadline if held else now + int(seconds * 1000)
            held += came
            while len(held) >= size:
                out += [(e, n, "size") for e in held[:size]]
                held, n, deadline = held[size:], n + 1, now + int(seconds * 1000)
        state.update((held, n, deadline))
        if held:
            state.setTimeoutDuration(max(1, deadline - state.getCurrentProcessingTimeMs()))
        yield pd.DataFrame({key: [own[0]] * len(out), "event_id": [o[0] for o in out], "flush": [o[1] for o in out], "trigger": [o[2] for o in out]})

    rows = stream.select(F.col(key).cast("long").alias(key), F.col("event_id").cast("long").alias("event_id"))
    return rows.groupBy(key).applyInPandasWithState(run, f"{key} long, event_id long, flush int, trigger string", "ids array<bigint>, flush int, deadline bigint", "append", "ProcessingTimeTimeout")


def flushed(stream: DataFrame, everything: DataFrame, key: str = "user_id", size: int = 50, seconds: float = 5.0) -> DataFrame:
    """``buffers`` of all that the stream's source holds now; what is left in them is flushed as the log is closed (``close``).

    ``everything`` is the source's rows as a table: key and event_id.
    """
    rows = audit(buffers(stream, key, size, seconds))
    last = rows.groupBy(key).agg((F.max("flush") + 1).alias("flush"))
    rest = everything.select(F.col(key).cast("long").alias(key), F.col("event_id").cast("long").alias("event_id")).join(rows.select("event_id"), "event_id", "left_anti")
    return rows.unionByName(rest.join(last, key, "left").select(key, "event_id", F.coalesce("flush", F.lit(0)).alias("flush"), F.lit("close").alias("trigger")))


@contextmanager
def waiting_for_no_timer(spark: SparkSession) -> Iterator[None]:
    """Streams that start meanwhile end with their source: batches without rows, for timers, aren't run."""
    idle = "spark.sql.streaming.noDataMicroBatches.enabled"
    before = spark.conf.get(idle, "true")
    spark.conf.set(idle, "false")
    try:
        yield
    finally:
        spark.conf.set(idle, before)


def audit(stream: DataFrame, every: str | None = None, write: Callable[[DataFrame, str], None] | None = None, until: Callable[[], bool] | None = None) -> DataFrame:
    """What an audit log holds after all of the stream that is there now is flushed to it.

    Each micro-batch is one flush, to a folder of its number: a batch that fails is run again and
    replaces what it wrote, so no event is lost or there twice. ``every`` flushes by processing
    time, as a log that stays open does, ``until`` that is true; else all that is there is flushed
    and the stream ends. ``write`` puts a batch in its folder (default: as Parquet); if it fails,
    the stream is started again from its checkpoint, up to three times.
    """
    spark = stream.sparkSession
    at = f"{shared_dir(spark)}/audit-{uuid.uuid4().hex}"
    put = write or (lambda rows, folder: rows.write.mode("overwrite").parquet(folder))
    writer = stream.writeStream.foreachBatch(lambda rows, n: put(rows, f"{at}/rows/batch={n}")).option("checkpointLocation", f"{at}/state")
    for attempt in range(4):
        try:
            if every:
                running = writer.trigger(processingTime=every).start()
                if until is None:
                    running.processAllAvailable()
                while until is not None and not until() and running.isActive:
                    time.sleep(0.2)
                if running.exception():
                    raise running.exception()
                running.stop()
            else:
                with waiting_for_no_timer(spark):
                    writer.trigger(availableNow=True).start().awaitTermination()
            break
        except StreamingQueryException:
            if attempt == 3:
                raise
    return spark.read.schema(stream.schema).parquet(f"{at}/rows/*")


def settle(stream: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """What the stream gives over all that its source holds now.

    Without keys, rows are appended. With keys, each micro-batch writes the rows that changed,
    and the last written row of a key counts, so that state isn't written out whole.
    """
    spark = stream.sparkSession
    at = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    if keys is None:
        writer = stream.writeStream.format("parquet").outputMode("append").option("path", f"{at}/rows")
    else:
        writer = stream.writeStream.outputMode("update").foreachBatch(lambda rows, n: rows.withColumn("_batch", F.lit(n)).write.mode("append").parquet(f"{at}/rows"))
    writer.option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    if keys is None:
        return spark.read.schema(stream.schema).parquet(f"{at}/rows")
    values = [c for c in stream.columns if c not in keys]
    written = spark.read.parquet(f"{at}/rows")
    return written.groupBy(*keys).agg(F.max_by(F.struct(*values), "_batch").alias("v")).select(*keys, "v.*")
