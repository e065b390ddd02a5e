"""Order, ranges, positions and seeking. Nothing here sorts more than it returns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.functions.adapter import ORDER, in_time
from tracelake.operators import blocks

#: Offsets of a tracefile's block that one task reads in order.
PIECE = 1 << 24


def in_order(events: DataFrame) -> DataFrame:
    return events.orderBy(*ORDER)


def time_range(events: DataFrame, start: int | None = None, end: int | None = None) -> DataFrame:
    """start <= time < end."""
    return in_time(events, start, end)


def after_position(position: Sequence, inclusive: bool = False) -> Column:
    """Whether an event comes after a position, the values of the global order's columns."""
    here, there = F.struct(*ORDER), F.struct(*[F.lit(p).cast("bigint").alias(c) for c, p in zip(ORDER, position, strict=True)])
    return here >= there if inclusive else here > there


def first_events(events: DataFrame, n: int) -> DataFrame:
    return in_order(events).limit(n)


def seek_forward(events: DataFrame, position: Sequence, n: int) -> DataFrame:
    """The next n events after a position."""
    return in_order(in_time(events, start=position[0]).where(after_position(position))).limit(n)


def seek_backward(events: DataFrame, position: Sequence, n: int) -> DataFrame:
    """The last n events before a position."""
    found = in_time(events, end=position[0] + 1).where(~after_position(position, inclusive=True))
    return found.orderBy(*[F.col(c).desc() for c in ORDER]).limit(n)


def before_position(events: DataFrame, end: Sequence) -> DataFrame:
    """Events up to a position, itself excluded: where reading stops."""
    return in_time(events, end=end[0] + 1).where(~after_position(end, inclusive=True))


def at_or_after(events: DataFrame, time_ns: int) -> DataFrame:
    return first_events(in_time(events, start=time_ns), 1)


def at_position(events: DataFrame, position: Sequence) -> DataFrame:
    """The event of a position."""
    same = F.lit(True)
    for c, value in zip(ORDER, position, strict=True):
        same = same & (F.col(c) == value)
    return in_time(events, position[0], position[0] + 1).where(same)


def position_of(events: DataFrame, time_ns: int) -> tuple | None:
    """The bookmark of the first event at or after a time; None after the last."""
    found = at_or_after(events, time_ns).select(*ORDER).collect()
    return tuple(found[0]) if found else None


def seek_many(events: DataFrame, times: Sequence[int]) -> DataFrame:
    """(sought_ns, position) of the first event at or after each of some times, in one pass: events are grouped by how
    many of the times are not after them, each group's first is found, and a time takes the first group that it may."""
    times = sorted(set(times))
    wanted = F.array(*[F.lit(t).cast("bigint") for t in times])
    passed = F.size(F.filter(wanted, lambda t: t <= F.col("time_ns")))
    firsts = in_time(events, start=times[0]).groupBy(passed.alias("_group")).agg(F.min(F.struct(*ORDER)).alias("position")).where("_group > 0")
    ranks = events.sparkSession.createDataFrame([(k + 1, t) for k, t in enumerate(times)], "_rank int, sought_ns bigint")
    return ranks.join(firsts, F.col("_group") >= F.col("_rank")).groupBy("sought_ns").agg(F.min("position").alias("position"))


def ranked(events: DataFrame, name: str = "rank") -> DataFrame:
    """Each event's place in the global order, from 1, numbered within slots of time (see ``blocks``)."""
    return blocks.plain(blocks.numbered(events, name))


def out_of_order(events: DataFrame) -> DataFrame:
    """Per tracefile: events whose time is less than, or the same as, that of the one before in the file. A file is read
    in pieces of PIECE offsets of a block, and each piece's first event meets the last of the piece before."""
    keys, piece = ("trace_id", "tracefile_id"), ("block", "_piece")
    own = events.select(*keys, "block", "offset", "time_ns", F.expr(f"offset div {PIECE}L").alias("_piece"))
    own = own.withColumn("_last", F.lag("time_ns").over(Window.partitionBy(*keys, *piece).orderBy("offset")))
    ends = own.groupBy(*keys, *piece).agg(
        F.count(F.lit(1)).alias("events"), F.count_if(F.col("time_ns") < F.col("_last")).alias("backward"), F.count_if(F.col("time_ns") == F.col("_last")).alias("equal"),
        F.min_by("time_ns", "offset").alias("_from"), F.max_by("time_ns", "offset").alias("_to"),
    )
    ends = ends.withColumn("_over", F.lag("_to").over(Window.partitionBy(*keys).orderBy(*piece)))
    return ends.groupBy(*keys).agg(
        F.sum("events").alias("events"), (F.sum("backward") + F.count_if(F.col("_from") < F.col("_over"))).alias("backward"), (F.sum("equal") + F.count_if(F.col("_from") == F.col("_over"))).alias("equal")
    )


def time_span(events: DataFrame, *by: str) -> DataFrame:
    return events.groupBy(*by).agg(F.min("time_ns").alias("start_ns"), F.max("time_ns").alias("end_ns"))
