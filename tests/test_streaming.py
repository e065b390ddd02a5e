"""Streams give what the batch operators give, whatever the batches."""

from pyspark.sql import functions as F

from tracelake.functions.adapter import trace_events
from tracelake.operators import pairing
from tracelake.streaming import live


def test_state_is_held_between_batches_and_runs(spark, sf, tmp_path):
    events = trace_events(spark, sf)
    folder, at = tmp_path / "in", f"file://{tmp_path}/out"
    low, high = events.agg(F.min("time_ns"), F.max("time_ns")).first()
    part = (high - low) // 4 + 1
    for k in range(4):
        events.where(F.expr(f"(time_ns - {low}) div {part}L") == k).coalesce(1).write.mode("append").parquet(f"file://{folder}")
        got = live.drained(live.running_process(live.arriving(spark, str(folder), events.schema, per_batch=1)), "x", at=at)
    want = pairing.running_process(events, after=True).select("id", "trace_id", "cpu", "time_ns", "running_pid")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_sessions(spark, tmp_path):
    rows = [(f"2024-01-01 00:00:{s:02d}", 1) for s in (0, 2, 4, 20, 21)] + [("2024-01-02 00:00:00", 1)]
    spark.createDataFrame(rows, "ts string, pid long").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.parquet(f"file://{tmp_path}/in")
    stream = live.arriving(spark, f"{tmp_path}/in", "ts timestamp, pid long")
    got = live.drained(live.sessions(stream, "5 seconds", "1 second", "pid"), "s", at=f"file://{tmp_path}/out").collect()
    assert sorted(((r.end_ns - r.start_ns) // 10**9, r.events) for r in got) == [(6, 2), (9, 3)]
