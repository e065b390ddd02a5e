"""Trace sets: lists of traces, saved and loaded, and their metadata as tables."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Traceset:
    """Paths of traces in their order; a trace's number is its place. Every change gives another set."""

    paths: tuple[str, ...] = ()
    name: str = ""

    def added(self, path: str) -> Traceset:
        return Traceset((*self.paths, path), self.name)

    def removed(self, path: str) -> Traceset:
        if path not in self.paths:
            raise KeyError(path)
        return Traceset(tuple(p for p in self.paths if p != path), self.name)

    def copied(self, name: str = "") -> Traceset:
        return Traceset(self.paths, name or self.name)

    def save(self, spark: SparkSession, path: str) -> None:
        """One line of JSON, by Spark, so that any store that it reaches will do."""
        spark.createDataFrame([(json.dumps({"name": self.name, "paths": self.paths}),)], "value string").coalesce(1).write.mode("overwrite").text(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Traceset:
        (row,) = spark.read.text(path).collect()
        held = json.loads(row.value)
        return cls(tuple(held["paths"]), held["name"])


def without_trace(events: DataFrame, trace_id: int) -> DataFrame:
    return events.where(F.col("trace_id") != trace_id)


def traces_table(index: DataFrame) -> DataFrame:
    """One row for each trace of an index of blocks: tracefiles, CPUs, blocks, span, lost events."""
    files = index.groupBy("trace_id", "tracefile_id").agg(F.max_by("events_lost", "block").alias("lost"), F.count(F.lit(1)).alias("blocks"), F.min("begin_ns").alias("start_ns"), F.max("end_ns").alias("end_ns"), F.any_value("cpu").alias("cpu"))
    return files.groupBy("trace_id").agg(F.count(F.lit(1)).alias("tracefiles"), F.count_distinct("cpu").alias("cpus"), F.sum("blocks").alias("blocks"), F.min("start_ns").alias("start_ns"), F.max("end_ns").alias("end_ns"), F.sum("lost").alias("events_lost"))


#: Spark types for the accessors of a payload's field.
ACCESSORS = {"unsigned": "bigint", "int": "int", "long_unsigned": "decimal(20,0)", "long_int": "bigint", "float": "float", "double": "double", "string": "string"}


def payload_field(name: str, accessor: str, payload: str = "payload") -> Column:
    """One field of a payload that is a map of texts, as a type; null where the event lacks it or it is no such value."""
    return F.try_element_at(F.col(payload), F.lit(name)).try_cast(ACCESSORS[accessor])


def typed(events: DataFrame, event: str, fields: Sequence[tuple[str, str]]) -> DataFrame:
    """Events of one name with fields of their payload as typed columns."""
    return events.where(F.col("event_name") == event).withColumns({name: payload_field(name, accessor) for name, accessor in fields})
