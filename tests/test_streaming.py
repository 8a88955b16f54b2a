"""Streams over several micro-batches give what the batch form gives over all rows."""

import time

from pyspark.sql import functions as F

from recollect.operators import sessions
from recollect.streaming import streams


def split_events(spark, small, tmp_path, parts):
    whole = spark.read.parquet(f"{small}/events.parquet")
    whole.repartition(parts, "event_id").write.parquet(f"{tmp_path}/events.parquet")
    return whole


def test_rate_windows_over_micro_batches(spark, small, tmp_path):
    whole = split_events(spark, small, tmp_path, 3)
    got = streams.settle(streams.rate_windows(streams.events(spark, str(tmp_path), files_per_batch=1), 2), ["user_id", "start"])
    want = sessions.rate_windows(whole, 2).select("user_id", (F.col("bucket") * 3600).alias("start"), "n", F.col("allowed"))
    assert sorted(map(tuple, got.select("user_id", "start", "n", "allowed").collect())) == sorted(map(tuple, want.collect()))


def test_last_write_wins_over_micro_batches(spark, small, tmp_path):
    whole = split_events(spark, small, tmp_path, 4)
    got = streams.settle(streams.working_memory(streams.events(spark, str(tmp_path), files_per_batch=1)), ["session", "key"])
    want = sessions.working_memory(whole.select(F.col("user_id").alias("session"), F.col("event_type").alias("key"), "value", F.col("event_id").alias("sequence")))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_change_log_is_appended_once(spark, small, tmp_path):
    whole = split_events(spark, small, tmp_path, 3)
    got = streams.settle(streams.change_log(streams.events(spark, str(tmp_path), files_per_batch=1), ["error"]))
    assert got.count() == whole.filter("event_type = 'error'").count()


def test_late_rows_are_dropped(spark, tmp_path):
    rows = [(1, "2024-01-01 00:00:00", 1), (2, "2024-03-01 00:00:00", 1), (3, "2024-03-02 00:00:00", 1), (4, "2024-01-01 00:00:30", 1)]
    for i, r in enumerate(rows):
        spark.createDataFrame([r], "event_id long, t string, user_id long").selectExpr("event_id", "cast(t as timestamp) ts", "user_id").coalesce(1).write.mode("append").parquet(f"{tmp_path}/events.parquet")
        time.sleep(1.1)  # files are taken in order of their time
    stream = streams.events(spark, str(tmp_path), files_per_batch=1)
    got = streams.settle(streams.rate_windows(stream, 5, late="1 day"), ["user_id", "start"])
    assert sorted(r.n for r in got.collect()) == [1, 1, 1]
    replay = streams.settle(streams.rate_windows(stream, 5, late=streams.span(spark, str(tmp_path))), ["user_id", "start"])
    assert sorted(r.n for r in replay.collect()) == [1, 1, 2]


def test_audit_holds_each_event_once_over_flushes(spark, small, tmp_path):
    whole = split_events(spark, small, tmp_path, 4)
    for every in (None, "1 second"):
        got = streams.audit(streams.events(spark, str(tmp_path), files_per_batch=1).select("event_id", "user_id"), every)
        assert sorted(r.event_id for r in got.collect()) == sorted(r.event_id for r in whole.collect())


def test_buffers_flush_at_their_size_over_micro_batches(spark, small, tmp_path):
    whole = split_events(spark, small, tmp_path, 3)
    stream = streams.events(spark, str(tmp_path), files_per_batch=1)
    rows = [tuple(r) for r in streams.flushed(stream, whole, size=4, seconds=600).select("user_id", "event_id", "flush", "trigger").collect()]
    assert sorted(r[1] for r in rows) == sorted(r.event_id for r in whole.collect())
    flushes = {}
    for user, event, n, why in rows:
        flushes.setdefault((user, n), []).append(why)
    assert all(set(f) in ({"size"}, {"close"}) and (len(f) == 4) == (f[0] == "size") or len(f) < 4 for f in flushes.values())
    assert {"size", "close"} == {f[0] for f in flushes.values()}


def test_buffers_flush_after_their_time(spark, small, tmp_path):
    whole = split_events(spark, small, tmp_path, 1)
    users = whole.select("user_id").distinct().count()
    began = time.time()
    got = streams.audit(streams.buffers(streams.events(spark, str(tmp_path)), size=10_000, seconds=2), every="1 second", until=lambda: time.time() - began > 20).collect()
    assert sorted(r.event_id for r in got) == sorted(r.event_id for r in whole.collect())
    assert {r.trigger for r in got} == {"time"} and len({(r.user_id, r.flush) for r in got}) == users


def test_a_failed_flush_is_buffered_again(spark, small, tmp_path):
    whole = split_events(spark, small, tmp_path, 3)
    failed = []

    def put(rows, folder):
        if len(failed) < 2 and not folder.endswith("batch=0"):
            failed.append(folder)
            raise OSError("the log is away")
        rows.write.mode("overwrite").parquet(folder)

    got = streams.audit(streams.buffers(streams.events(spark, str(tmp_path), files_per_batch=1), size=1, seconds=600), write=put)
    assert sorted(r.event_id for r in got.collect()) == sorted(r.event_id for r in whole.collect()) and len(failed) == 2
