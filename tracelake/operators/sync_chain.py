"""A synchronisation from packets to corrected traces, put together by options."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.engine import Options
from tracelake.functions.tables import settled
from tracelake.operators import graphs, network, sync

ANALYSES, REDUCTIONS = ("chull", "linreg", "eval"), ("accuracy",)


@dataclass
class Plan:
    """What a synchronisation does. null reads packets and does nothing with them; analysis eval judges the clocks as they
    are and corrects none; stats counts what was read and matched; graphs names a folder for point tables and a script;
    rtt is a table (a, b, rtt_ns) of least round trips, in place of those that exchanges give."""

    analysis: str = "chull"
    reduction: str = "accuracy"
    null: bool = False
    stats: bool = False
    graphs: str | None = None
    rtt: DataFrame | None = None

    def __post_init__(self) -> None:
        if self.analysis not in ANALYSES or self.reduction not in REDUCTIONS:
            raise ValueError(f"analysis is one of {', '.join(ANALYSES)}, reduction one of {', '.join(REDUCTIONS)}")


def options() -> Options:
    """The same as options of a command line."""
    out = Options()
    out.add("sync", help="synchronise the clocks of traces")
    out.add("sync-stats", help="count what was read and matched")
    out.add("sync-null", help="read network events and do nothing with them")
    out.add("sync-analysis", help="how clocks are compared", kind=str, value="chull")
    out.add("sync-reduction", help="how pairs become one scale", kind=str, value="accuracy")
    out.add("sync-graphs", help="write graphs")
    out.add("sync-graphs-dir", help="where graphs go", kind=str, value="graphs")
    out.add("eval-rtt-file", help="round trips to judge by", kind=str)
    return out


def plan_of(found: Options, rtt: DataFrame | None = None) -> Plan:
    return Plan(found["sync-analysis"], found["sync-reduction"], found["sync-null"], found["sync-stats"], found["sync-graphs-dir"] if found["sync-graphs"] else None, rtt)


@dataclass
class Synchronised:
    """factors: (trace, reference, drift, offset, start_freq); counters and quality only if they were asked for."""

    factors: DataFrame | None = None
    pairs: DataFrame | None = None
    counters: DataFrame | None = None
    quality: DataFrame | None = None

    def corrected(self, events: DataFrame) -> DataFrame:
        """Events on the reference's clock; as they are if nothing was corrected."""
        return events if self.factors is None else sync.corrected(events, self.factors)


def _best_direction(fits: DataFrame) -> DataFrame:
    """Of the two regressions of a pair, one for each direction, the one with the smaller residual, as a line from the
    lower trace's clock to the higher one's."""
    a, b = F.least("i", "j"), F.greatest("i", "j")
    # A regression gives j's clock from i's as t + (drift - 1) t + offset; the other way it is turned round.
    drift = F.when(F.col("i") < F.col("j"), F.col("drift")).otherwise(1 / F.col("drift"))
    offset = F.when(F.col("i") < F.col("j"), F.col("offset")).otherwise(-F.col("offset") / F.col("drift"))
    lines = fits.where("drift is not null").select(a.alias("a"), b.alias("b"), F.struct(F.coalesce("accuracy", F.lit(float("inf"))).alias("accuracy"), drift.alias("drift"), offset.alias("offset")).alias("line"))
    best = lines.groupBy("a", "b").agg(F.min("line").alias("line"))
    return best.select("a", "b", F.lit("ACCURATE").alias("type"), "line.drift", "line.offset", "line.accuracy")


def synchronise(packets: DataFrame, traces: int, plan: Plan | None = None, start_freqs: Mapping[int, float] | None = None) -> Synchronised:
    """packets: network events (see ``network``). The table of pairs, the square of the number of traces, comes to the
    driver. start_freqs are the traces' cycle frequencies; all take over that of the trace with the least drift."""
    plan = plan or Plan()
    if plan.null:
        return Synchronised()
    out = Synchronised(counters=network.counters(packets) if plan.stats else None)
    messages = settled(network.tcp_messages(packets), "messages")
    if plan.analysis == "eval":
        rtt = plan.rtt if plan.rtt is not None else sync.least_round_trip(sync.match_exchanges(messages))
        out.quality = sync.message_quality(messages, rtt)
        return out
    if plan.analysis == "linreg":
        out.pairs = _best_direction(sync.regression(sync.match_exchanges(messages)))
    else:
        points = sync.message_points(messages)
        out.pairs = sync.factors(points).select("a", "b", "type", "drift", "offset", "accuracy")
        if plan.graphs:
            graphs.write_graphs(points, out.pairs, plan.graphs)
    reduced = sync.reduce_factors([tuple(r) for r in out.pairs.collect()], traces)
    freq = None if start_freqs is None else start_freqs[min(reduced, key=lambda r: (r[2], r[0]))[0]]
    out.factors = packets.sparkSession.createDataFrame([(*r, freq) for r in reduced], "trace int, reference int, drift double, offset double, start_freq double")
    if plan.stats:
        rtt = plan.rtt if plan.rtt is not None else sync.least_round_trip(sync.match_exchanges(messages))
        out.quality = sync.message_quality(messages, rtt)
    return out
