"""Clock synchronisation: matching packets, exchanges and broadcasts, lines between clocks, evaluation, reduction.

A message is (out_trace, in_trace, out_ns, in_ns, ...). A pair of traces a < b has points x on a's clock and y on b's;
clocks are related by y = offset + drift * x. Sent points (a to b) lie above the true line, received ones below it.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from collections.abc import Iterator
from fractions import Fraction
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelake.functions.tables import settled
from tracelake.operators import blocks

#: The evaluation histogram's bins and their base.
HISTOGRAM_BINS = 1001
HISTOGRAM_BASE = 10 ** (6 / 998)
ORDER = ("time_ns", "id")


def received_packets(events: DataFrame) -> DataFrame:
    """Packets as a protocol handled them, with the time at which their device received them.

    events: id, trace_id, time_ns, skb, step ('receive' by the device, 'handle' by the protocol). Buffers are used again:
    of several receptions in one the last counts, and it serves once, so a packet is known if the event before it in its
    buffer is a reception."""
    w = Window.partitionBy("trace_id", "skb").orderBy(*ORDER)
    both = events.withColumn("_step", F.lag("step").over(w)).withColumn("received_id", F.lag("id").over(w)).withColumn("received_ns", F.lag("time_ns").over(w))
    return both.where((F.col("step") == "handle") & (F.col("_step") == "receive")).drop("step", "_step")


def match_messages(packets: DataFrame, *key: str) -> DataFrame:
    """Sent and received packets of equal keys; packets has id, trace_id, time_ns, direction ('IN' or 'OUT') and key.

    A packet meets the waiting packet of the other direction, and takes the place of a waiting one of its own. So in a
    run whose directions alternate, the first meets the second, the third the fourth. Messages within one trace go."""
    w = Window.partitionBy(*key).orderBy(*ORDER)
    runs = packets.withColumn("_new", F.coalesce(F.lag("direction").over(w) == F.col("direction"), F.lit(True)).cast("int"))
    runs = runs.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    place = Window.partitionBy(*key, "_run").orderBy(*ORDER)
    both = runs.withColumn("_place", F.row_number().over(place))
    for c in ("id", "trace_id", "time_ns"):
        both = both.withColumn(f"_{c}", F.lead(c).over(place))
    sent = F.col("direction") == "OUT"

    def side(c: str, out: bool):
        return F.when(sent if out else ~sent, F.col(c)).otherwise(F.col(f"_{c}"))

    found = both.where((F.col("_place") % 2 == 1) & F.col("_id").isNotNull() & (F.col("trace_id") != F.col("_trace_id")))
    return found.select(*key, *[side(c, out).alias(f"{name}_{label}") for name, out in (("out", True), ("in", False)) for c, label in (("id", "id"), ("trace_id", "trace"), ("time_ns", "ns"))])


def unmatched(packets: DataFrame, messages: DataFrame) -> DataFrame:
    """Packets that are in no message, those that stayed within one trace included."""
    return packets.join(messages.select(F.explode(F.array("out_id", "in_id")).alias("id")), "id", "left_anti")


def match_exchanges(messages: DataFrame) -> DataFrame:
    """Acknowledgements with the last message that each acknowledges.

    messages has seq, ack_seq, needs_ack, is_ack and conn (the flow, the same in both directions). A message waits until
    a later one the other way has an ack_seq after its seq (modulo 2**32). A flow is read in the order of reception,
    batch by batch; only what waits is held."""
    keep = ["conn", "out_trace", "in_trace", "out_ns", "in_ns", "in_id", "seq", "ack_seq", "needs_ack", "is_ack"]
    rows = messages.select(*keep).where("needs_ack or is_ack").repartition("conn").sortWithinPartitions("conn", "in_ns", "in_id")
    schema = "conn string, in_id long, out_trace long, in_trace long, out_ns long, in_ns long, acked_id long, acked_out_ns long, acked_in_ns long, acked long"
    return rows.withColumn("conn", F.col("conn").cast("string")).mapInPandas(_acknowledge, schema)


class _Waiting:
    """Messages one way of a flow that wait for an acknowledgement, in the order of their sequence numbers. Numbers wrap,
    so they are held as distances from the first one, and what is acknowledged is always a beginning of the list."""

    def __init__(self, seq: int) -> None:
        self.base, self.high = seq, 0
        self.held: list[tuple[int, int, tuple]] = []  # distance, arrival, message
        self.arrivals = 0

    def distance(self, seq: int) -> int:
        """The distance whose number is seq, nearest to the greatest one so far."""
        return self.high + ((seq - self.base - self.high + (1 << 31)) % (1 << 32)) - (1 << 31)

    def add(self, seq: int, message: tuple) -> None:
        at = self.distance(seq)
        self.high = max(self.high, at)
        self.arrivals += 1
        insort(self.held, (at, self.arrivals, message))

    def taken(self, ack: int) -> list[tuple[int, int, tuple]]:
        """What an acknowledgement takes off: numbers less than it, but by less than half of all numbers."""
        at = self.distance(ack)
        end, start = bisect_left(self.held, (at,)), bisect_left(self.held, (at - (1 << 31) + 1,))
        out = self.held[start:end]
        del self.held[start:end]
        return out


def _acknowledge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    flow, waiting = None, {}
    columns = ["conn", "in_id", "out_trace", "in_trace", "out_ns", "in_ns", "acked_id", "acked_out_ns", "acked_in_ns", "acked"]
    for batch in batches:
        found = []
        for conn, out_trace, in_trace, out_ns, in_ns, in_id, seq, ack_seq, needs, acks in zip(*(batch[c].tolist() for c in batch.columns), strict=True):
            if conn != flow:
                flow, waiting = conn, {}
            if acks and (back := waiting.get((in_trace, out_trace))) is not None and (taken := back.taken(ack_seq)):
                last = max(taken, key=lambda t: t[1])[2]
                found.append((conn, in_id, out_trace, in_trace, out_ns, in_ns, *last, len(taken)))
            if needs:
                if (out_trace, in_trace) not in waiting:
                    waiting[out_trace, in_trace] = _Waiting(seq)
                waiting[out_trace, in_trace].add(seq, (in_id, out_ns, in_ns))
        yield pd.DataFrame(found, columns=columns)


def in_parts(receptions: DataFrame, traces: int, *key: str) -> DataFrame:
    """Receptions of one datagram numbered in parts of as many as there are traces."""
    w = Window.partitionBy(*key).orderBy(*ORDER)
    return receptions.withColumn("part", F.floor((F.row_number().over(w) - 1) / F.lit(traces)).cast("bigint"))


def broadcast_groups(receptions: DataFrame, traces: int, *key: str) -> DataFrame:
    """Receptions of one datagram, in groups as large as the number of traces; what is left over makes no group."""
    numbered = in_parts(receptions, traces, *key)
    seconds = F.col("time_ns") / F.lit(1e9)
    groups = numbered.groupBy(*key, "part").agg(F.count(F.lit(1)).alias("n"), F.min("time_ns").alias("first_ns"), F.max("time_ns").alias("last_ns"), F.stddev_pop(seconds).alias("stdev"))
    return groups.where(F.col("n") == traces).drop("n")


def regression(exchanges: DataFrame) -> DataFrame:
    """Per ordered pair, least squares of the clocks' difference over time: drift, offset at time 0, and residual."""
    e = exchanges.select(
        F.col("in_trace").alias("i"), F.col("out_trace").alias("j"),
        ((F.col("acked_in_ns") - F.col("acked_out_ns") + F.col("out_ns") - F.col("in_ns")) / 2).alias("d"),
        (F.col("acked_out_ns") / 2 + F.col("in_ns") / 2).alias("t"),
    )
    sums = e.groupBy("i", "j").agg(
        F.count(F.lit(1)).alias("n"), F.regr_slope("d", "t").alias("x"), F.regr_intercept("d", "t").alias("offset"),
        F.regr_syy("d", "t").alias("_syy"), F.regr_sxy("d", "t").alias("_sxy"),
    )
    residual = F.when(F.col("n") > 2, F.sqrt(F.greatest(F.col("_syy") - F.col("x") * F.col("_sxy"), F.lit(0.0)) / (F.col("n") - 2)))
    return sums.select("i", "j", "n", (F.col("x") + 1).alias("drift"), "offset", residual.alias("accuracy"))


def message_points(messages: DataFrame) -> DataFrame:
    """Points (a, b, hull, x, y) of messages, in the order of reception; those whose x goes back are left out."""
    sent = F.col("out_trace") < F.col("in_trace")
    points = messages.select(
        F.least("out_trace", "in_trace").alias("a"), F.greatest("out_trace", "in_trace").alias("b"), F.when(sent, "lower").otherwise("upper").alias("hull"),
        F.when(sent, F.col("out_ns")).otherwise(F.col("in_ns")).alias("x"), F.when(sent, F.col("in_ns")).otherwise(F.col("out_ns")).alias("y"), "in_ns", "in_id",
    )
    # The order of reception, as the scans in slots have it.
    none = F.lit(0).cast("bigint")
    points = points.select("a", "b", "hull", "x", "y", F.col("in_ns").alias("time_ns"), none.alias("tracefile_id"), none.alias("trace_id"), none.alias("block"), F.col("in_id").alias("offset"))
    points = settled(points, "points")
    return blocks.running_max(points, "x", "top", ("a", "b", "hull")).where("x = top").select("a", "b", "hull", "x", "y")


def half_hull(x: list[int], y: list[int], lower: bool) -> list[tuple[int, int]]:
    """The lower or upper convex hull, left to right, in whole numbers."""
    sign, hull = (1 if lower else -1), []
    best: dict[int, int] = {}
    for px, py in zip(x, y, strict=True):
        best[px] = min(best.get(px, py), py) if lower else max(best.get(px, py), py)
    for p in sorted(best.items()):
        while len(hull) > 1 and sign * ((hull[-1][0] - hull[-2][0]) * (p[1] - hull[-2][1]) - (hull[-1][1] - hull[-2][1]) * (p[0] - hull[-2][0])) <= 0:
            hull.pop()
        hull.append(p)
    return hull


def hulls(points: DataFrame) -> DataFrame:
    """Half hulls per pair: of each batch first, before any shuffle, then of the batches' hulls."""
    schema = "a long, b long, hull string, x long, y long"

    def reduced(group: pd.DataFrame) -> pd.DataFrame:
        a, b, kind = (group[c].iloc[0] for c in ("a", "b", "hull"))
        found = half_hull([int(v) for v in group["x"]], [int(v) for v in group["y"]], kind == "lower")
        return pd.DataFrame([(a, b, kind, px, py) for px, py in found], columns=["a", "b", "hull", "x", "y"])

    def each_batch(batches):
        for batch in batches:
            for _, group in batch.groupby(["a", "b", "hull"]):
                yield reduced(group)

    return points.mapInPandas(each_batch, schema).groupBy("a", "b", "hull").applyInPandas(reduced, schema)


def _line(p, q) -> tuple[float, float]:
    drift = (q[1] - p[1]) / (q[0] - p[0])
    return drift, p[1] - drift * p[0]


def _steepest(first, last, least: bool):
    """Of lines from a point of first to a later one of last, the one of least (or greatest) slope; None without any."""
    best = None
    lx, ly = np.array([p[0] for p in last], float), np.array([p[1] for p in last], float)
    for p in first:
        later = np.nonzero(lx > p[0])[0]
        if len(later):
            slopes = (ly[later] - p[1]) / (lx[later] - p[0])
            k = int(slopes.argmin() if least else slopes.argmax())
            if best is None or (slopes[k] < best[0] if least else slopes[k] > best[0]):
                best = (slopes[k], p, last[later[k]])
    return best and _line(best[1], best[2])


def pair_line(lower, upper) -> dict:
    """The line between two half hulls: type, drift, offset, accuracy, and the extreme slopes.

    The greatest slope is the least one from an upper point to a later lower point, the least slope the greatest one
    from a lower to a later upper point; without such points it is unbounded. ACCURATE: both are bounded, and the line is
    their bisector. INCOMPLETE: one is. ABSENT: none is. Hulls that cross have no line between them: APPROXIMATE is the
    line through a point of each with the least sum of vertical errors, and FAIL is one with no such line."""
    low, high = _steepest(lower, upper, least=False), _steepest(upper, lower, least=True)
    shown = {"drift_min": low[0] if low else -math.inf, "drift_max": high[0] if high else math.inf, "drift": None, "offset": None, "accuracy": None}
    if low and high and low[0] > high[0]:
        return shown | _fallback(lower, upper)
    if low and high:
        bmin, bmax, amin, amax = low[0], high[0], low[1], high[1]
        drift = (bmax * bmin - 1 + math.sqrt(1 + bmax**2 * bmin**2 + bmax**2 + bmin**2)) / (bmax + bmin)
        return shown | {"type": "ACCURATE", "drift": drift, "offset": amax - (amax - amin) / 2 * (drift**2 + 1) / (1 + drift * bmax), "accuracy": bmax - bmin}
    return shown | {"type": "INCOMPLETE" if low or high else "ABSENT"}


class _Violations:
    """How far a line lies over the points of a lower hull (or under those of an upper one), summed: the points that a
    line cuts off a hull are neighbours, so they are found by halving, and their sum from sums of all beginnings."""

    def __init__(self, hull, lower: bool) -> None:
        self.sign = 1 if lower else -1
        self.x = [p[0] for p in hull]
        self.y = [self.sign * p[1] for p in hull]
        self.slopes = [(self.y[k + 1] - self.y[k]) / (self.x[k + 1] - self.x[k]) for k in range(len(hull) - 1)]
        self.sx, self.sy = [0, *accumulate(self.x)], [0, *accumulate(self.y)]

    def total(self, drift: float, offset: float) -> float:
        drift, offset = self.sign * drift, self.sign * offset
        touch = bisect_left(self.slopes, drift)  # the point that the line is farthest over, if it is over any

        def over(k: int) -> float:
            return offset + drift * self.x[k] - self.y[k]

        if over(touch) <= 0:
            return 0.0
        first = bisect_left(range(touch), True, key=lambda k: over(k) > 0)
        last = bisect_left(range(touch + 1, len(self.x)), True, key=lambda k: over(k) <= 0) + touch + 1
        n = last - first
        return n * offset + drift * (self.sx[last] - self.sx[first]) - (self.sy[last] - self.sy[first])


def _fallback(lower, upper) -> dict:
    over, under, best = _Violations(lower, True), _Violations(upper, False), None
    for p in lower:
        for q in upper:
            if p[0] != q[0]:
                drift, offset = _line(*sorted((p, q)))
                error = over.total(drift, offset) + under.total(drift, offset)
                if best is None or error < best[0]:
                    best = (error, drift, offset)
    return {"type": "FAIL"} if best is None else {"type": "APPROXIMATE", "drift": best[1], "offset": best[2], "accuracy": float(best[0])}


class _Reach:
    """The value at x of the line of each slope that touches a hull from outside: f(m) = min (or max) of y - m (p - x)."""

    def __init__(self, points, x: int, lower: bool) -> None:
        self.points, self.x, self.sign = half_hull([p[0] for p in points], [p[1] for p in points], lower), x, 1 if lower else -1
        h = self.points
        self.slopes = [Fraction(h[k + 1][1] - h[k][1], h[k + 1][0] - h[k][0]) for k in range(len(h) - 1)]

    def __call__(self, m: Fraction) -> Fraction:
        k = bisect_left(self.slopes, m) if self.sign > 0 else bisect_left(self.slopes, -m, key=lambda s: -s)
        return self.points[k][1] - m * (self.points[k][0] - self.x)


def time_bounds(lower, upper, x: int) -> tuple[float, float] | None:
    """The least and the greatest value at x of a line that lies on or under all points of lower and on or over all of
    upper, and doesn't fall; None if there is no such line. Exact, in whole numbers: by slope, the greatest value is a
    concave function made of lines, and the least a convex one, so what decides are the slopes of the hulls' edges, and
    those at which the two functions cross."""
    if not lower and not upper:
        return -math.inf, math.inf
    last, first = max((p[0] for p in lower), default=-math.inf), min((p[0] for p in upper), default=math.inf)
    top, bottom = _Reach(lower, x, True) if lower else None, _Reach(upper, x, False) if upper else None
    slopes = sorted({Fraction(0), *(s for reach in (top, bottom) if reach for s in reach.slopes if s >= 0)})
    fits = [m for m in slopes if not (top and bottom) or top(m) >= bottom(m)]
    if top and bottom:
        # Between two neighbouring slopes both functions are lines; after the last one they go on as they are.
        for a, b in zip(slopes, [*slopes[1:], slopes[-1] + 1], strict=True):
            fa, fb = top(a) - bottom(a), top(b) - bottom(b)
            if (fa < 0) != (fb < 0) or b > slopes[-1] and fa != fb:
                m = a + (b - a) * fa / (fa - fb)
                if m >= a and (m <= b or b > slopes[-1]):
                    fits.append(m)
    if not fits:
        return None
    high = math.inf if not lower or last < x and last <= first else float(max(map(top, fits)))
    low = -math.inf if not upper or first > x and last <= first else float(min(map(bottom, fits)))
    return low, high


def pair_bounds(points: DataFrame, x: int) -> DataFrame:
    """Per pair, between what the second clock can show when the first shows x; null where no line fits. Other than the
    bisector this says how far off a corrected time may be."""
    schema = "a long, b long, least double, greatest double"

    def solve(group: pd.DataFrame) -> pd.DataFrame:
        side = {k: sorted((int(px), int(py)) for px, py in zip(g["x"], g["y"], strict=True)) for k, g in group.groupby("hull")}
        found = time_bounds(side.get("lower", []), side.get("upper", []), x) or (None, None)
        return pd.DataFrame([(group["a"].iloc[0], group["b"].iloc[0], *found)], columns=["a", "b", "least", "greatest"])

    return hulls(points).groupBy("a", "b").applyInPandas(solve, schema)


def factors(points: DataFrame) -> DataFrame:
    """One line per pair of traces (see pair_line), from message_points."""
    schema = "a long, b long, type string, drift double, offset double, accuracy double, drift_min double, drift_max double"

    def solve(group: pd.DataFrame) -> pd.DataFrame:
        side = {k: sorted((int(x), int(y)) for x, y in zip(g["x"], g["y"], strict=True)) for k, g in group.groupby("hull")}
        found = {"a": group["a"].iloc[0], "b": group["b"].iloc[0]} | pair_line(side.get("lower", []), side.get("upper", []))
        return pd.DataFrame([found])[[c.split()[0] for c in schema.split(", ")]]

    return hulls(points).groupBy("a", "b").applyInPandas(solve, schema)


def reduce_factors(pairs: list[tuple[int, int, str, float, float, float]], traces: int) -> list[tuple[int, int, float, float]]:
    """(trace, reference, drift, offset): what takes each trace's time to its reference's. pairs: (a, b, type, drift,
    offset, accuracy), one per pair of traces, a table as large as the square of the number of traces.

    Shortest paths by accuracy, ACCURATE pairs before APPROXIMATE ones (an accuracy of one is no slope of the other);
    with one island its member of the least sum of distances is the reference, with several each island's lowest."""
    for kind in ("ACCURATE", "APPROXIMATE"):
        known = [p for p in pairs if p[2] == kind and p[3] is not None]
        if known:
            break
    far = np.full((traces, traces), math.inf)
    step = np.full((traces, traces), -1)
    lines: dict[tuple[int, int], tuple[float, float]] = {}
    np.fill_diagonal(far, 0.0)
    for a, b, _, drift, offset, accuracy in known:
        lines[a, b], lines[b, a] = (drift, offset), (1 / drift, -offset / drift)
        far[a, b] = far[b, a] = accuracy
        step[a, b], step[b, a] = b, a
    for k in range(traces):
        through = far[:, k, None] + far[None, k, :]
        better = through < far
        step = np.where(better, step[:, k, None], step)
        far = np.where(better, through, far)
    islands = {tuple(np.nonzero(np.isfinite(row))[0].tolist()) for row in far}
    reference = {t: (min(island, key=lambda m: (far[m].sum(), m)) if len(islands) == 1 else island[0]) for island in islands for t in island}
    out = []
    for t in range(traces):
        drift, offset, at = 1.0, 0.0, t
        while at != reference[t]:
            nxt = int(step[at, reference[t]])
            d, o = lines[at, nxt]
            drift, offset, at = d * drift, d * offset + o, nxt
        out.append((t, reference[t], drift, offset))
    least = min(o for *_, o in out) if out else 0.0
    return [(t, r, d, o - least) for t, r, d, o in out]


def corrected(events: DataFrame, reduced: DataFrame) -> DataFrame:
    """Events with time_ns on the reference's clock; reduced has one row per trace. Traces without one stay as they are."""
    by = reduced.select(F.col("trace").alias("_t"), F.col("drift").alias("_d"), F.col("offset").alias("_o"))
    time = F.when(F.col("_t").isNull(), F.col("time_ns")).otherwise(F.round(F.col("_d") * F.col("time_ns") + F.col("_o")).cast("long"))
    return events.join(by, F.col("trace_id") == F.col("_t"), "left").withColumn("time_ns", time).drop("_t", "_d", "_o")


def corrected_columns(rows: DataFrame, reduced: DataFrame, times: dict[str, str]) -> DataFrame:
    """Several clocks' times in one row, each put on the reference's clock; times: column of time to column of trace.
    With messages {"out_ns": "out_trace", "in_ns": "in_trace"}, an evaluation can be made again after synchronisation."""
    for trace in sorted(set(times.values())):
        by = reduced.select(F.col("trace").alias("_t"), F.col("drift").alias("_d"), F.col("offset").alias("_o"))
        rows = rows.join(by, F.col(trace) == F.col("_t"), "left")
        for c in (c for c, t in times.items() if t == trace):
            rows = rows.withColumn(c, F.when(F.col("_t").isNull(), F.col(c)).otherwise(F.round(F.col("_d") * F.col(c) + F.col("_o")).cast("long")))
        rows = rows.drop("_t", "_d", "_o")
    return rows


def message_quality(messages: DataFrame, rtt: DataFrame) -> DataFrame:
    """Per directed pair: messages, inversions, those faster than half the round trip, those without one. rtt: (a, b,
    rtt_ns), a < b, one row per pair."""
    took = F.col("in_ns") - F.col("out_ns")
    m = messages.withColumn("a", F.least("out_trace", "in_trace")).withColumn("b", F.greatest("out_trace", "in_trace")).join(rtt, ["a", "b"], "left")
    return m.groupBy("out_trace", "in_trace").agg(
        F.count(F.lit(1)).alias("messages"), F.count_if(took <= 0).alias("inversions"), F.count_if((took > 0) & (took * 2 < F.col("rtt_ns"))).alias("too_fast"),
        F.count_if(F.col("rtt_ns").isNull()).alias("no_rtt"), F.min("out_ns").alias("first_ns"), F.max("out_ns").alias("last_ns"),
    )


def round_trips(exchanges: DataFrame) -> DataFrame:
    trip = (F.col("in_ns") - F.col("acked_out_ns")) - (F.col("out_ns") - F.col("acked_in_ns"))
    return exchanges.select(F.least("out_trace", "in_trace").alias("a"), F.greatest("out_trace", "in_trace").alias("b"), trip.alias("rtt_ns"))


def least_round_trip(exchanges: DataFrame) -> DataFrame:
    return round_trips(exchanges).groupBy("a", "b").agg(F.min("rtt_ns").alias("rtt_ns"))


def histogram(values: DataFrame, seconds) -> DataFrame:
    """Counts in bins of equal ratios; the first holds what is smaller, zero and negatives included, the last what is 1 s
    or more."""
    place = F.floor(F.log(seconds) / F.lit(math.log(HISTOGRAM_BASE))) + HISTOGRAM_BINS - 1
    bin_ = F.when(seconds > 0, F.least(F.greatest(place, F.lit(0)), F.lit(HISTOGRAM_BINS - 1))).otherwise(0).cast("bigint")
    return values.groupBy(bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
