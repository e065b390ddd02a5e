"""The canonical event table, and the view of the driver's tables as one.

Canonical columns: trace_id, tracefile_id, channel, cpu, block, offset (the position), tsc, time_ns, event_id (type),
event_name, and a payload of typed columns. The global order is time, then tracefile, trace, block, offset.

Where the source has its own columns of time and type, ``ts`` and ``event_type``, they stay beside what is made of them,
and ``in_time`` and ``of_types`` put each condition on both: that on the source's column reaches the Parquet scan.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampNTZType

ORDER = ("time_ns", "tracefile_id", "trace_id", "block", "offset")
#: How the driver's event types stand for kernel events.
NAMES = {"view": "syscall_entry", "click": "syscall_exit", "signup": "irq_entry", "error": "irq_exit", "purchase": "sched_schedule"}
CHANNEL = "kernel"
EPOCH_START = datetime(1970, 1, 1)


def trace_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical(spark.read.parquet(f"{sf_dir}/events.parquet"))


def canonical(raw: DataFrame) -> DataFrame:
    """The driver's events, a table or a stream, as canonical ones."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    name = F.create_map(*[F.lit(x) for pair in NAMES.items() for x in pair])[F.col("event_type")]
    return raw.select(
        F.col("event_id").alias("id"),
        (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("time_ns"),
        (F.col("event_id") % 2).alias("trace_id"),
        (F.col("user_id") % 4).alias("tracefile_id"),
        (F.col("user_id") % 4).alias("cpu"),
        F.lit(0).cast("bigint").alias("block"),
        F.col("event_id").alias("offset"),
        F.lit(CHANNEL).alias("channel"),
        name.alias("event_name"),
        F.col("user_id").alias("pid"),
        k.alias("k"),
        (k % 20).alias("syscall_id"),
        (k % 5).alias("irq_id"),
        (k % 15).alias("next_pid"),
        (k % 3).alias("prev_state"),
        "value",
        "ts",
        "event_type",
    )


def _instant(events: DataFrame, ns: int, up: bool) -> Column:
    """A time as a literal of the source's type, to the microsecond, rounded so that no event is lost."""
    micros = -(-ns // 1000) if up else ns // 1000
    kind = "TIMESTAMP_NTZ" if isinstance(events.schema["ts"].dataType, TimestampNTZType) else "TIMESTAMP"
    text = (EPOCH_START + timedelta(microseconds=micros)).strftime("%Y-%m-%d %H:%M:%S.%f")
    return F.expr(f"{kind} '{text}{'' if kind == 'TIMESTAMP_NTZ' else ' UTC'}'")


def in_time(events: DataFrame, start: int | None = None, end: int | None = None) -> DataFrame:
    """start <= time_ns < end, pushed down to the source's column of time if it is there."""
    source = "ts" in events.columns
    if start is not None:
        events = events.where(F.col("time_ns") >= start)
        events = events.where(F.col("ts") >= _instant(events, start, False)) if source else events
    if end is not None:
        events = events.where(F.col("time_ns") < end)
        events = events.where(F.col("ts") <= _instant(events, end, True)) if source else events
    return events


def of_types(events: DataFrame, *names: str) -> DataFrame:
    """Events of these names, pushed down to the source's column of types if it is there."""
    out = events.where(F.col("event_name").isin(*names))
    if "event_type" in events.columns:
        out = out.where(F.col("event_type").isin(*[k for k, name in NAMES.items() if name in names]))
    return out


#: The same view for DuckDB.
EVENTS_SQL = """ev AS (
  SELECT event_id AS id, epoch_us(ts) * 1000 AS time_ns, event_id % 2 AS trace_id, user_id % 4 AS tracefile_id, user_id % 4 AS cpu, 0::BIGINT AS block, event_id AS "offset",
    'kernel' AS channel, CASE event_type WHEN 'view' THEN 'syscall_entry' WHEN 'click' THEN 'syscall_exit' WHEN 'signup' THEN 'irq_entry' WHEN 'error' THEN 'irq_exit' ELSE 'sched_schedule' END AS event_name,
    user_id AS pid, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CAST(json_extract(props, '$.k') AS BIGINT) % 20 AS syscall_id, CAST(json_extract(props, '$.k') AS BIGINT) % 5 AS irq_id,
    CAST(json_extract(props, '$.k') AS BIGINT) % 15 AS next_pid, CAST(json_extract(props, '$.k') AS BIGINT) % 3 AS prev_state, value
  FROM events)"""
ORDER_SQL = 'time_ns, tracefile_id, trace_id, block, "offset"'
