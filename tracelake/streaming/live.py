"""Live traces: event files that arrive are read in micro-batches, and what has been read is not read again.

Order within a stream is that of the batches; within a batch it is the global order. Events that come after the
watermark has passed their window are left out, as Spark does.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tracelake.functions.adapter import ORDER
from tracelake.functions.tables import shared_dir


def arriving(spark: SparkSession, path: str, schema, files: str = "*.parquet", per_batch: int = 100) -> DataFrame:
    """Event files of a folder as a stream, so many a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).option("pathGlobFilter", files).parquet(path)


def drained(stream: DataFrame, name: str, mode: str = "append", at: str | None = None) -> DataFrame:
    """Runs a stream until what has arrived is read, and returns the table that it wrote. at names a folder to go on
    from: a later call with the same one reads only what came since."""
    at = at or f"{shared_dir(stream.sparkSession)}/{name}-{uuid.uuid4().hex}"
    run = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{at}/progress").trigger(availableNow=True).start(f"{at}/table")
    run.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{at}/table")


def window_counts(events: DataFrame, width: str, delay: str, *by: str) -> DataFrame:
    """Events per window of their ts (a timestamp) and keys; a window is given out once the watermark has passed it."""
    counted = events.withWatermark("ts", delay).groupBy(F.window("ts", width), *by).agg(F.count(F.lit(1)).alias("events"))
    return counted.select((F.unix_micros("window.start") * 1000).alias("start_ns"), *by, "events")


def sessions(events: DataFrame, gap: str, delay: str, *by: str) -> DataFrame:
    """Stretches of events of equal keys without a pause of gap."""
    counted = events.withWatermark("ts", delay).groupBy(F.session_window("ts", gap), *by).agg(F.count(F.lit(1)).alias("events"))
    return counted.select((F.unix_micros("session_window.start") * 1000).alias("start_ns"), (F.unix_micros("session_window.end") * 1000).alias("end_ns"), *by, "events")


def running_process(events: DataFrame) -> DataFrame:
    """The pid that runs on an event's CPU, the event itself included; between batches one number per CPU is held."""
    schema = "id long, trace_id long, cpu long, time_ns long, running_pid long"

    def follow(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values(list(ORDER), kind="stable")
        before = state.get[0] if state.exists else 0
        pid = rows["next_pid"].where(rows["event_name"] == "sched_schedule").ffill().fillna(before).astype("int64")
        state.update((int(pid.iloc[-1]),))
        yield pd.DataFrame({"id": rows["id"], "trace_id": key[0], "cpu": key[1], "time_ns": rows["time_ns"], "running_pid": pid})

    return events.groupBy("trace_id", "cpu").applyInPandasWithState(follow, schema, "pid long", "append", GroupStateTimeout.NoTimeout)
