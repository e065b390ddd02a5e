"""Network events as the packets that clock synchronisation matches.

events: the fields of IPv4 and TCP or UDP headers, ``direction`` (IN or OUT), and id, trace_id, time_ns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.operators import sync

#: The fields of a segment that are the same where it was sent and where it was received.
SEGMENT_KEY = ("saddr", "daddr", "source", "dest", "tot_len", "ihl", "seq", "ack_seq", "doff", "ack", "rst", "syn", "fin")


def payload_length() -> Column:
    return F.col("tot_len") - F.col("ihl") * 4 - F.col("doff") * 4


def needs_ack() -> Column:
    """A segment that takes up room in the sequence: SYN, FIN, or data."""
    return (F.col("syn") != 0) | (F.col("fin") != 0) | (payload_length() > 0)


def is_ack() -> Column:
    return F.col("ack") != 0


def connection() -> Column:
    """A flow, the same for both directions."""
    here, there = F.struct(F.col("saddr").alias("a"), F.col("source").alias("p")), F.struct(F.col("daddr").alias("a"), F.col("dest").alias("p"))
    low, high = F.least(here, there), F.greatest(here, there)
    return F.concat_ws(":", low["a"], low["p"], high["a"], high["p"])


def segments(events: DataFrame) -> DataFrame:
    """TCP segments, each with its flow, and whether it asks for an acknowledgement or is one."""
    return events.withColumns({"conn": connection(), "needs_ack": needs_ack(), "is_ack": is_ack()})


def tcp_messages(events: DataFrame) -> DataFrame:
    """Segments met by all thirteen fields of their key."""
    return sync.match_messages(segments(events), *SEGMENT_KEY, "conn", "needs_ack", "is_ack")


def tcp_exchanges(events: DataFrame) -> DataFrame:
    return sync.match_exchanges(tcp_messages(events))


def counters(events: DataFrame) -> DataFrame:
    """What a synchronisation reads and finds: packets by direction, messages, exchanges, what is left over."""
    packets = events.agg(F.count(F.lit(1)).alias("packets"), F.count_if(F.col("direction") == "IN").alias("received"), F.count_if(F.col("direction") == "OUT").alias("sent"))
    messages = tcp_messages(events)
    matched = messages.agg(F.count(F.lit(1)).alias("messages"), F.count_if("needs_ack").alias("needing_ack"), F.count_if("is_ack").alias("acks"))
    acked = sync.match_exchanges(messages).agg(F.count(F.lit(1)).alias("exchanges"), F.coalesce(F.sum("acked"), F.lit(0)).alias("acknowledged"))
    rest = sync.unmatched(events, messages).agg(F.count(F.lit(1)).alias("unmatched"))

    def lines(one: DataFrame) -> DataFrame:
        return one.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, one.columns)), F.array(*[F.col(c).cast("bigint") for c in one.columns]))).alias("counter", "n"))

    return lines(packets).unionByName(lines(matched)).unionByName(lines(acked)).unionByName(lines(rest))


def broadcast_statistics(receptions: DataFrame, traces: int, *key: str) -> DataFrame:
    """Groups of receptions together: how many, and the sum of their deviations; of two traces, for each pair, the least,
    greatest, sum and sum of squares of the difference of their clocks, in seconds."""
    groups = sync.broadcast_groups(receptions, traces, *key)
    total = groups.agg(F.count(F.lit(1)).alias("broadcasts"), F.sum("stdev").alias("stdev_sum"))
    if traces != 2:
        return total
    own = sync.in_parts(receptions, traces, *key)
    pairs = own.groupBy(*key, "part").agg(F.count(F.lit(1)).alias("n"), F.min_by("time_ns", "trace_id").alias("first"), F.max_by("time_ns", "trace_id").alias("second")).where("n = 2")
    d = (F.col("second") - F.col("first")) / F.lit(1e9)
    return total.join(pairs.agg(F.min(d).alias("least"), F.max(d).alias("greatest"), F.sum(d).alias("sum"), F.sum(d * d).alias("sum_squares")))
