"""Lines between clocks, reduction, text sources."""

import math
import random

import pytest

from tracelake.operators import sync
from tracelake.sources import text


def known_clocks(n=60, drift=1.0003, offset=5_000_000, seed=3):
    rng, out = random.Random(seed), []
    for k in range(n):
        sent, took = k * 1_000_000_000 + rng.randrange(10**8), rng.randrange(1_000, 400_000)
        if k % 2:
            out.append((0, 1, sent, round(offset + drift * (sent + took)), k))
        else:
            out.append((1, 0, round(offset + drift * sent), sent + took, k))
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "out_trace long, in_trace long, out_ns long, in_ns long, in_id long")


def test_accurate_line_holds_the_truth(spark):
    line = sync.factors(sync.message_points(frame(spark, known_clocks()))).collect()[0]
    assert line.type == "ACCURATE" and line.drift_min <= 1.0003 <= line.drift_max
    assert abs(line.drift - 1.0003) < 1e-6 and abs(line.offset - 5_000_000) < 400_000


def test_hull_is_brute_force(spark):
    rng = random.Random(1)
    pts = [(rng.randrange(50), rng.randrange(50)) for _ in range(80)]
    for lower in (True, False):
        hull = sync.half_hull([x for x, _ in pts], [y for _, y in pts], lower)
        for p, q in zip(hull, hull[1:]):
            for x, y in pts:
                turn = (q[0] - p[0]) * (y - p[1]) - (q[1] - p[1]) * (x - p[0])
                assert turn >= 0 if lower else turn <= 0


def test_types_of_lines():
    assert sync.pair_line([], [])["type"] == "ABSENT"
    assert sync.pair_line([(0, 5)], [])["type"] == "ABSENT"
    half = sync.pair_line([(10, 12)], [(0, 0)])
    assert half["type"] == "INCOMPLETE" and half["drift_max"] == 1.2 and half["drift_min"] == -math.inf
    crossed = sync.pair_line([(0, 5), (10, 0)], [(1, 10), (9, 10)])
    assert crossed["type"] == "APPROXIMATE" and crossed["accuracy"] > 0


def test_reduction_follows_the_path():
    pairs = [(0, 1, "ACCURATE", 2.0, 10.0, 0.1), (1, 2, "ACCURATE", 3.0, 0.0, 0.1), (0, 2, "ACCURATE", 99.0, 0.0, 5.0)]
    got = {t: (r, d, o) for t, r, d, o in sync.reduce_factors(pairs, 3)}
    assert [got[t][0] for t in range(3)] == [1, 1, 1]
    assert got[0][1:] == (2.0, 10.0) and got[1][1:] == (1.0, 0.0) and got[2][1:] == pytest.approx((1 / 3, 0.0))
    assert [r for _, r, _, _ in sync.reduce_factors(pairs[:1], 4)] == [0, 0, 2, 3]
    assert sync.reduce_factors([], 2) == [(0, 0, 1.0, 0.0), (1, 1, 1.0, 0.0)]


def test_corrected(spark):
    e = spark.createDataFrame([(0, 100), (1, 100), (7, 5)], "trace_id long, time_ns long")
    by = spark.createDataFrame([(0, 2.0, 10.0), (1, 1.0, 0.0)], "trace int, drift double, offset double")
    assert sorted(map(tuple, sync.corrected(e, by).collect())) == [(0, 210), (1, 100), (7, 5)]


def test_sequence_wraps(spark):
    rows = [("c", 0, 1, 1, 2, 1, 2**32 - 5, 0, True, False), ("c", 1, 0, 3, 4, 2, 0, 10, False, True), ("c", 1, 0, 5, 6, 3, 0, 10, False, True)]
    m = spark.createDataFrame(rows, "conn string, out_trace long, in_trace long, out_ns long, in_ns long, in_id long, seq long, ack_seq long, needs_ack boolean, is_ack boolean")
    assert [(r.in_id, r.acked_id, r.acked) for r in sync.match_exchanges(m).collect()] == [(2, 1, 1)]


def test_text_sources(spark, tmp_path):
    (tmp_path / "m.txt").write_text("# words\n2\n0\t1\t1.5\t2.25\n\n1 0 3 3.000000001\n")
    (tmp_path / "r.txt").write_text("# a b ms\n10.0.0.1 10.0.0.2 0.5\n")
    got = text.messages(spark, str(tmp_path / "m.txt")).drop("in_id").collect()
    assert sorted(map(tuple, got)) == [(0, 1, 1_500_000_000, 2_250_000_000), (1, 0, 3_000_000_000, 3_000_000_001)]
    assert text.trace_count(spark, str(tmp_path / "m.txt")).first().traces == 2
    assert text.round_trip_times(spark, str(tmp_path / "r.txt")).first().rtt_s == 0.0005


def test_time_bounds_are_brute_force():
    rng = random.Random(5)
    for _ in range(200):
        lower = [(rng.randrange(12), rng.randrange(4, 16)) for _ in range(rng.randrange(1, 5))]
        upper = [(rng.randrange(12), rng.randrange(-4, 8)) for _ in range(rng.randrange(1, 5))]
        x = rng.randrange(-3, 15)
        got = sync.time_bounds(sync.half_hull(*zip(*lower), True), sync.half_hull(*zip(*upper), False), x)
        found = []
        for step in range(0, 400):
            slope = step / 20
            top, bottom = min(y - slope * px for px, y in lower), max(y - slope * px for px, y in upper)
            if bottom <= top:
                found += [top + slope * x, bottom + slope * x]
        if got is None:
            assert not found
        else:
            # The grid's slopes are a subset: it can't go beyond the bounds, and comes near to those that are finite.
            assert all(got[0] - 1e-9 <= v <= got[1] + 1e-9 for v in found)
            if found and math.isfinite(got[1]):
                assert got[1] - max(found) <= 0.05 * 20
            if found and math.isfinite(got[0]):
                assert min(found) - got[0] <= 0.05 * 20
    assert sync.time_bounds([(0, 5)], [], 3) == (-math.inf, math.inf)


def test_graphs(spark, tmp_path):
    from tracelake.operators import graphs

    points = sync.message_points(frame(spark, known_clocks()))
    graphs.write_graphs(points, sync.factors(points), str(tmp_path / "g"))
    assert spark.read.csv(str(tmp_path / "g/points")).count() == points.count() and spark.read.csv(str(tmp_path / "g/hulls")).count() == sync.hulls(points).count()
    text_ = (next((tmp_path / "g/script").glob("part-*"))).read_text()
    assert 'set output "000-001-TraceTrace.eps"' in text_ and "* x title" in text_


def test_evaluation_of_corrected_times(spark):
    messages = frame(spark, known_clocks())
    pairs = [tuple(p) for p in sync.factors(sync.message_points(messages)).select("a", "b", "type", "drift", "offset", "accuracy").collect()]
    reduced = spark.createDataFrame(sync.reduce_factors(pairs, 2), "trace int, reference int, drift double, offset double")
    rtt = spark.createDataFrame([(0, 1, 2)], "a long, b long, rtt_ns long")
    before = sync.message_quality(messages, rtt).agg({"inversions": "sum"}).first()[0]
    fixed = sync.corrected_columns(messages, reduced, {"out_ns": "out_trace", "in_ns": "in_trace"})
    after = sync.message_quality(fixed, rtt).agg({"inversions": "sum"}).first()[0]
    assert before > 0 and after == 0 and fixed.columns == messages.columns


def test_corrected_query(spark, sf):
    from tracelake.plans import sync_catalog

    rows = sync_catalog.QUERIES["sync_eval_corrected"](spark, sf).collect()
    assert sum(r.messages for r in rows) == sync_catalog.QUERIES["tcp_message_match"](spark, sf).count()


def segments_of(rows, ack_every=3):
    """TCP segments of messages between two clocks; each sequence number grows, and some acknowledge."""
    out, seen = [], {0: 0, 1: 0}
    for k, (a, b, sent, received, _) in enumerate(rows):
        seq, ack = 100 * k, 100 * seen[b]
        seen[a] = k + 1
        header = (10 + a, 10 + b, 1000 + a, 1000 + b, 50, 5, seq, ack, 5, int(k % ack_every == 0), 0, 0, 0)
        out += [(2 * k, a, sent, "OUT", *header), (2 * k + 1, b, received, "IN", *header)]
    return out


def test_chain(spark, tmp_path):
    """From packets to one clock, by hulls and by regression; options, counters, graphs, the frequency that all take."""
    from tests.test_engine import SEGMENTS
    from tracelake.operators import sync_chain

    fields = "id long, trace_id long, time_ns long, direction string, saddr long, daddr long, source long, dest long, tot_len long, ihl long, seq long, ack_seq long, doff long, ack long, rst long, syn long, fin long"
    assert fields == SEGMENTS
    packets = spark.createDataFrame(segments_of(known_clocks(200)), SEGMENTS)
    given = sync_chain.options()
    assert given.parse(["--sync", "--sync-stats", "--sync-graphs", f"--sync-graphs-dir=file://{tmp_path}/graphs", "trace"]) == ["trace"]
    found = sync_chain.synchronise(packets, 2, sync_chain.plan_of(given), {0: 1e9, 1: 2e9})
    factors = {r.trace: r for r in found.factors.collect()}
    other = 1 - factors[0].reference
    assert {r.start_freq for r in factors.values()} <= {1e9, 2e9} and len({r.start_freq for r in factors.values()}) == 1
    assert factors[other].drift == pytest.approx(1.0003 if other == 0 else 1 / 1.0003, rel=1e-5)
    assert {r.counter: r.n for r in found.counters.collect()}["messages"] == 200 and found.quality.count() == 2
    assert (tmp_path / "graphs" / "script").exists()
    times = {}
    for r in found.corrected(packets.select("id", "trace_id", "time_ns")).collect():
        times.setdefault(r.id // 2, {})[r.id % 2] = r.time_ns
    assert all(t[0] < t[1] < t[0] + 2_000_000 for t in times.values())
    line = sync_chain.synchronise(packets, 2, sync_chain.Plan("linreg")).pairs.first()
    assert (line.a, line.b) == (0, 1) and abs(line.drift - 1.0003) < 1e-3
    assert sync_chain.synchronise(packets, 2, sync_chain.Plan("eval")).quality.agg({"messages": "sum"}).first()[0] == 200
    assert sync_chain.synchronise(packets, 2, sync_chain.Plan(null=True)).factors is None
    with pytest.raises(ValueError):
        sync_chain.Plan("none")


def test_time_bounds_by_brute_force():
    """Against all lines through two points, and level ones, in whole numbers."""
    from fractions import Fraction

    r = random.Random(5)
    for _ in range(1500):
        lower, upper = ([(x, r.randrange(20) + up) for x in sorted(r.sample(range(12), r.randrange(5)))] for up in (r.choice([0, 8]), r.choice([0, -8])))
        x, rows = r.randrange(-3, 16), [(p, 1) for p in lower] + [(p, -1) for p in upper]
        lines = {(Fraction(0), Fraction(p[1])) for p, _ in rows}
        lines |= {(s, p[1] - s * p[0]) for k, (p, _) in enumerate(rows) for q, _ in rows[k + 1 :] if p[0] != q[0] and (s := Fraction(q[1] - p[1], q[0] - p[0])) >= 0}
        fits = [s * x + base for s, base in lines if all(sign * (base + s * p[0] - p[1]) <= 0 for p, sign in rows)]
        got = sync.time_bounds(lower, upper, x)
        if rows and not fits:
            assert got is None
        else:
            assert (got[0] == -math.inf or got[0] == float(min(fits))) and (got[1] == math.inf or got[1] == float(max(fits)))


@pytest.mark.parametrize("n, hulls, kind", [(1, (2, 2), "ACCURATE"), (2, (0, 0), "ABSENT")])
def test_hull_sizes(n, hulls, kind):
    lower = [(10, 12), (30, 33)][: hulls[0]]
    upper = [(5, 3), (35, 30)][: hulls[1]]
    assert sync.pair_line(lower, upper)["type"] == kind
