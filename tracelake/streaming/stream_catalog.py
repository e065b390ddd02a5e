"""Queries over the driver's events as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.functions.adapter import EVENTS_SQL, ORDER_SQL, canonical
from tracelake.streaming import live


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return live.arriving(spark, sf_dir, schema, "events.parquet")


def stream_window_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly counts of the windows that an hour's watermark has closed."""
    events = _events(spark, sf_dir).select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    return live.drained(live.window_counts(events, "1 hour", "1 hour", "event_type"), "window-counts")


def stream_running_process(spark: SparkSession, sf_dir: str) -> DataFrame:
    return live.drained(live.running_process(canonical(_events(spark, sf_dir))), "running-process")


QUERIES = {f.__name__: f for f in (stream_window_counts, stream_running_process)}
SQL = {
    "stream_window_counts": """WITH w AS (SELECT date_trunc('hour', ts) AS h, event_type, count(*) AS events FROM events GROUP BY ALL)
      SELECT epoch_us(h) * 1000 AS start_ns, event_type, events FROM w WHERE h + INTERVAL 2 HOUR <= (SELECT max(ts) FROM events)""",
    "stream_running_process": f"""WITH {EVENTS_SQL} SELECT id, trace_id, cpu, time_ns,
      coalesce(last_value(CASE WHEN event_name = 'sched_schedule' THEN next_pid END IGNORE NULLS) OVER (PARTITION BY trace_id, cpu ORDER BY {ORDER_SQL} ROWS UNBOUNDED PRECEDING), 0) AS running_pid FROM ev""",
}
