"""Text sources: messages between traces, and round-trip times. Lines that begin with # are comments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SECOND = 1_000_000_000


def _fields(spark: SparkSession, path: str, n: int) -> DataFrame:
    line = F.trim(F.col("value"))
    return spark.read.text(path).where(~line.startswith("#")).select(F.split(line, r"\s+").alias("f")).where(F.size("f") == n)


def messages(spark: SparkSession, path: str) -> DataFrame:
    """Lines of sender, receiver, and the times of sending and receiving in seconds."""
    f = _fields(spark, path, 4).where("try_cast(f[0] as long) is not null")
    ns = [F.round(F.col("f")[k].cast("double") * SECOND).cast("long") for k in (2, 3)]
    return f.select(F.col("f")[0].cast("long").alias("out_trace"), F.col("f")[1].cast("long").alias("in_trace"), ns[0].alias("out_ns"), ns[1].alias("in_ns"), F.monotonically_increasing_id().alias("in_id"))


def trace_count(spark: SparkSession, path: str) -> DataFrame:
    """The number of traces, from the line that holds only that."""
    return _fields(spark, path, 1).where("f[0] <> ''").agg(F.max(F.col("f")[0].cast("long")).alias("traces"))


def round_trip_times(spark: SparkSession, path: str) -> DataFrame:
    """Lines of two addresses and milliseconds; the result is in seconds."""
    return _fields(spark, path, 3).select(F.col("f")[0].alias("saddr"), F.col("f")[1].alias("daddr"), (F.col("f")[2].cast("double") / 1000).alias("rtt_s"))
