"""Matching events with events: as-of values, entry and exit brackets, names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.functions.adapter import of_types
from tracelake.functions.tables import settled
from tracelake.operators import blocks


def running_process(events: DataFrame, name: str = "running_pid", after: bool = False) -> DataFrame:
    """The pid that runs on an event's CPU: next_pid of the latest switch there, the event itself included with after;
    0 until the first one."""
    switched = {name: F.when(F.col("event_name") == "sched_schedule", F.col("next_pid"))}
    found = blocks.last_values(events, ("trace_id", "cpu"), **{"upto" if after else "before": switched})
    return blocks.plain(found.withColumn(name, F.coalesce(name, F.lit(0).cast("bigint"))))


def as_of(events: DataFrame, value: Column, name: str, *keys: str, after: bool = True) -> DataFrame:
    """The latest non-null value among events of the same keys."""
    return blocks.plain(blocks.last_values(events, keys, **{"upto" if after else "before": {name: value}}))


def with_names(events: DataFrame, names: DataFrame, id_col: str, kind: str, name: str) -> DataFrame:
    """names: (id, name), a table of names whose size follows the kernel's, not the trace; the planner broadcasts it
    when it is small. Ids without a name get the kind and the id."""
    table = names.select(F.col("id").alias("_id"), F.col("name").alias("_name"))
    plain = F.concat(F.lit(f"{kind} "), F.col(id_col).cast("string"))
    return events.join(table, F.col(id_col) == F.col("_id"), "left").withColumn(name, F.coalesce("_name", plain)).drop("_id", "_name")


def brackets(events: DataFrame, entry: str, exit: str, *keys: str) -> DataFrame:
    """Entry and exit events paired as a stack per key: an exit closes the latest open entry, an exit with nothing open
    is left out, an entry that stays open has a null end. depth counts from 1.

    The depth after an event is the running sum of +1 and -1 less its running minimum, which is what ignoring exits on
    an empty stack comes to; an entry and the next event that returns below its depth are a pair."""
    step = F.when(F.col("event_name") == entry, 1).when(F.col("event_name") == exit, -1)
    own = settled(blocks.depths(of_types(events, entry, exit), step, keys), "depths")
    own = own.where((F.col("_step") == 1) | (F.col("_low") >= F.col("_was")))
    own = own.withColumn("depth", (F.col("_sum") - F.col("_low") + F.when(F.col("_step") == -1, 1).otherwise(0)).cast("bigint"))
    paired = blocks.last_values(own, (*keys, "depth"), following={"end_ns": "time_ns", "exit_id": "id"})
    return blocks.plain(paired.where(F.col("_step") == 1))


def pairs_fifo(events: DataFrame, entry: str, exit: str, *keys: str) -> DataFrame:
    """The k-th entry with the k-th exit of the same key."""
    entries = blocks.plain(blocks.numbered(of_types(events, entry), "nth", keys))
    exits = blocks.plain(blocks.numbered(of_types(events, exit), "nth", keys)).select(*keys, "nth", F.col("time_ns").alias("end_ns"), F.col("id").alias("exit_id"))
    return entries.join(exits, [*keys, "nth"]).drop("nth")


def interval_lookup(events: DataFrame, intervals: DataFrame, keys: list[str], start: str, end: str, values: list[str], bucket_ns: int) -> DataFrame:
    """Events with the values of the interval of the same key that holds their time. Intervals are cut by bucket so that
    the join is on equality; those of one key must not overlap."""
    e = events.withColumn("_b", F.expr(f"time_ns div {bucket_ns}L"))
    i = intervals.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col(start).alias("_start"), F.col(end).alias("_end"), *values)
    i = i.withColumn("_b2", F.explode(F.sequence(F.expr(f"_start div {bucket_ns}L"), F.expr(f"_end div {bucket_ns}L"))))
    on = [F.col(k) == F.col(f"_{k}") for k in keys] + [F.col("_b") == F.col("_b2"), F.col("time_ns") >= F.col("_start"), F.col("time_ns") < F.col("_end")]
    return e.join(i, on, "left").drop("_b", "_b2", "_start", "_end", *[f"_{k}" for k in keys])
