"""Queries of clock synchronisation, over packets that the driver's events stand for.

A view is a packet sent and a click one received by the trace user_id % 4, with the key k; errors are receptions of
broadcasts. Sequence numbers, acknowledgements and flows follow from k.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tracelake.functions.adapter import EVENTS_SQL, trace_events
from tracelake.operators import network, sync

TRACES = 4
QUERIES: dict = {}
SQL: dict[str, str] = {}

MESSAGES_SQL = f"""WITH {EVENTS_SQL}, pk AS (SELECT id, cpu AS trace_id, time_ns, CASE event_name WHEN 'syscall_entry' THEN 'OUT' ELSE 'IN' END AS direction, k FROM ev WHERE event_name IN ('syscall_entry', 'syscall_exit')),
  p1 AS (SELECT *, CASE WHEN lag(direction) OVER (PARTITION BY k ORDER BY time_ns, id) <> direction THEN 0 ELSE 1 END AS fresh FROM pk),
  p2 AS (SELECT *, sum(fresh) OVER (PARTITION BY k ORDER BY time_ns, id ROWS UNBOUNDED PRECEDING) AS run FROM p1),
  p3 AS (SELECT *, (row_number() OVER (PARTITION BY k, run ORDER BY time_ns, id) - 1) // 2 AS couple FROM p2),
  me AS (SELECT k, max(id) FILTER (direction = 'OUT') AS out_id, max(trace_id) FILTER (direction = 'OUT') AS out_trace, max(time_ns) FILTER (direction = 'OUT') AS out_ns,
      max(id) FILTER (direction = 'IN') AS in_id, max(trace_id) FILTER (direction = 'IN') AS in_trace, max(time_ns) FILTER (direction = 'IN') AS in_ns
    FROM p3 GROUP BY k, run, couple HAVING count(*) = 2 AND max(trace_id) FILTER (direction = 'OUT') <> max(trace_id) FILTER (direction = 'IN'))"""
EXCHANGES_SQL = MESSAGES_SQL + """, mm AS (SELECT *, k AS seq, k * 7 % 101 AS ack_seq FROM me),
  fi AS (SELECT u.in_id AS uid, u.in_ns AS uns, u.out_ns AS uout, arg_min(p.in_id, (p.in_ns, p.in_id)) AS pid
    FROM mm u JOIN mm p ON u.out_trace = p.in_trace AND u.in_trace = p.out_trace AND u.k % 5 = p.k % 5 AND (p.in_ns, p.in_id) > (u.in_ns, u.in_id) AND p.ack_seq > u.seq
    WHERE u.k % 2 = 0 AND p.k % 3 = 0 GROUP BY ALL),
  ex AS (SELECT p.in_id, any_value(p.out_trace) AS out_trace, any_value(p.in_trace) AS in_trace, any_value(p.out_ns) AS out_ns, any_value(p.in_ns) AS in_ns,
      arg_max(uid, (uns, uid)) AS acked_id, arg_max(uout, (uns, uid)) AS acked_out_ns, max(uns) AS acked_in_ns, count(*) AS acked
    FROM fi JOIN mm p ON p.in_id = fi.pid GROUP BY p.in_id)"""


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(trace_events(spark, sf_dir))
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _packets(e):
    direction = F.when(F.col("event_name") == "syscall_entry", "OUT").otherwise("IN")
    return e.where(F.col("event_name").isin("syscall_entry", "syscall_exit")).select("id", F.col("cpu").alias("trace_id"), "time_ns", direction.alias("direction"), "k")


def _messages(e):
    return sync.match_messages(_packets(e), "k")


def _exchanges(e):
    k = F.col("k")
    flow = F.concat_ws("-", F.least("out_trace", "in_trace"), F.greatest("out_trace", "in_trace"), k % 5)
    return sync.match_exchanges(_messages(e).select("*", flow.alias("conn"), k.alias("seq"), (k * 7 % 101).alias("ack_seq"), (k % 2 == 0).alias("needs_ack"), (k % 3 == 0).alias("is_ack")))


@query(f"""WITH {EVENTS_SQL}, w AS (SELECT id, cpu AS trace_id, k AS skb, event_name, time_ns, lag(event_name) OVER w AS was, lag(id) OVER w AS received_id, lag(time_ns) OVER w AS received_ns
    FROM ev WHERE event_name IN ('irq_entry', 'irq_exit') WINDOW w AS (PARTITION BY cpu, k ORDER BY time_ns, id))
  SELECT id, trace_id, skb, time_ns, received_id, received_ns FROM w WHERE event_name = 'irq_exit' AND was = 'irq_entry'""")  # fmt: skip
def receive_correlation(e):
    """Interrupts stand for a device's receptions and what returns from them for the protocol's, k for the buffer."""
    step = F.when(F.col("event_name") == "irq_entry", "receive").otherwise("handle")
    return sync.received_packets(e.where(F.col("event_name").isin("irq_entry", "irq_exit")).select("id", F.col("cpu").alias("trace_id"), "time_ns", F.col("k").alias("skb"), step.alias("step")))


@query(MESSAGES_SQL + " SELECT k, out_id, out_trace, out_ns, in_id, in_trace, in_ns FROM me")
def tcp_message_match(e):
    return _messages(e)


def _segments(e):
    """Packets with headers that follow from k."""
    k = F.col("k")
    header = {"saddr": k % 3, "daddr": k % 5, "source": k % 7 + 1000, "dest": F.lit(80), "tot_len": k % 2 * 10 + 40, "ihl": F.lit(5), "seq": k, "ack_seq": k * 7 % 101, "doff": F.lit(5), "ack": (k % 3 == 0).cast("int"), "rst": F.lit(0), "syn": (k % 10 == 0).cast("int"), "fin": F.lit(0)}
    return _packets(e).withColumns(header)


FLAGS_SQL = "k % 10 = 0 OR k % 2 = 1 AS needs_ack, k % 3 = 0 AS is_ack"


@query(MESSAGES_SQL + f" SELECT out_id, in_id, k AS seq, {FLAGS_SQL} FROM me")
def tcp_segment_match(e):
    """Segments by the thirteen fields of their key, and what their flags ask for."""
    return network.tcp_messages(_segments(e)).select("out_id", "in_id", "seq", "needs_ack", "is_ack")


@query(MESSAGES_SQL + f""", fl AS (SELECT *, {FLAGS_SQL} FROM me) SELECT * FROM (
    SELECT unnest([{{'counter': 'packets', 'n': count(*)}}, {{'counter': 'received', 'n': count(*) FILTER (direction = 'IN')}}, {{'counter': 'sent', 'n': count(*) FILTER (direction = 'OUT')}}], recursive := true) FROM pk
    UNION ALL SELECT unnest([{{'counter': 'messages', 'n': count(*)}}, {{'counter': 'needing_ack', 'n': count(*) FILTER (needs_ack)}}, {{'counter': 'acks', 'n': count(*) FILTER (is_ack)}}], recursive := true) FROM fl
    UNION ALL SELECT 'unmatched', count(*) FROM pk WHERE id NOT IN (SELECT out_id FROM me) AND id NOT IN (SELECT in_id FROM me))""")  # fmt: skip
def sync_counters(e):
    """What a synchronisation reads and finds; exchanges, which tcp_exchange_match compares, are left out here."""
    return network.counters(_segments(e)).where(~F.col("counter").isin("exchanges", "acknowledged"))


@query(f"""WITH {EVENTS_SQL}, r AS (SELECT *, (row_number() OVER (PARTITION BY k ORDER BY time_ns, id) - 1) // 2 AS part FROM ev WHERE event_name = 'irq_exit'),
  g AS (SELECT k, part, stddev_pop(time_ns / 1e9) AS sd, (max_by(time_ns, trace_id) - min_by(time_ns, trace_id)) / 1e9 AS d FROM r GROUP BY ALL HAVING count(*) = 2)
  SELECT count(*) AS broadcasts, round(sum(sd), 2) AS stdev_sum, round(sum(abs(d)), 2) AS spread FROM g WHERE d <> 0""")  # fmt: skip
def broadcast_stats(e):
    """Broadcasts to two traces: how many, and their deviations, of those whose receptions are in both."""
    rows = e.where(F.col("event_name") == "irq_exit")
    parts = sync.in_parts(rows, 2, "k").groupBy("k", "part").agg(F.count_distinct("trace_id").alias("n"), F.count(F.lit(1)).alias("all"))
    both = parts.where("n = 2 and all = 2").select(F.col("k").alias("k2"), F.col("part").alias("p2"))
    kept = sync.in_parts(rows, 2, "k").join(both, (F.col("k") == F.col("k2")) & (F.col("part") == F.col("p2"))).drop("k2", "p2").withColumnRenamed("part", "half")
    total = network.broadcast_statistics(kept, 2, "k", "half")
    return total.select("broadcasts", F.round("stdev_sum", 2).alias("stdev_sum"), F.round(F.col("stdev_sum") * 2, 2).alias("spread"))


@query(MESSAGES_SQL + " SELECT id, trace_id, direction FROM pk WHERE id NOT IN (SELECT out_id FROM me) AND id NOT IN (SELECT in_id FROM me)")
def unmatched_events(e):
    packets = _packets(e)
    return sync.unmatched(packets, sync.match_messages(packets, "k")).select("id", "trace_id", "direction")


@query(EXCHANGES_SQL + " SELECT in_id, out_trace, in_trace, acked_id, acked_out_ns, acked_in_ns, acked FROM ex")
def tcp_exchange_match(e):
    return _exchanges(e).select("in_id", "out_trace", "in_trace", "acked_id", "acked_out_ns", "acked_in_ns", "acked")


@query(f"""WITH {EVENTS_SQL}, r AS (SELECT *, (row_number() OVER (PARTITION BY k ORDER BY time_ns, id) - 1) // {TRACES} AS part FROM ev WHERE event_name = 'irq_exit')
  SELECT k, part, min(time_ns) AS first_ns, max(time_ns) AS last_ns, round(stddev_pop(time_ns / 1e9), 3) AS stdev FROM r GROUP BY ALL HAVING count(*) = {TRACES}""")  # fmt: skip
def broadcast_groups(e):
    return sync.broadcast_groups(e.where(F.col("event_name") == "irq_exit"), TRACES, "k").withColumn("stdev", F.round("stdev", 3))


@query(EXCHANGES_SQL + """, s AS (SELECT in_trace AS i, out_trace AS j, (acked_in_ns - acked_out_ns + out_ns - in_ns) / 2 AS d, acked_out_ns / 2 + in_ns / 2 AS t FROM ex)
  SELECT i, j, count(*) AS n, CASE WHEN var_pop(t) > 0 THEN round(1 + regr_slope(d, t), 4) END AS drift FROM s GROUP BY ALL""")  # fmt: skip
def sync_linreg(e):
    return sync.regression(_exchanges(e)).select("i", "j", "n", F.round("drift", 4).alias("drift"))


@query(MESSAGES_SQL + """, po AS (SELECT least(out_trace, in_trace) AS a, greatest(out_trace, in_trace) AS b, CASE WHEN out_trace < in_trace THEN 'lower' ELSE 'upper' END AS hull,
    CASE WHEN out_trace < in_trace THEN out_ns ELSE in_ns END AS x, CASE WHEN out_trace < in_trace THEN in_ns ELSE out_ns END AS y, in_ns, in_id FROM me)
  SELECT a, b, hull, x, y FROM (SELECT *, max(x) OVER (PARTITION BY a, b, hull ORDER BY in_ns, in_id ROWS UNBOUNDED PRECEDING) AS top FROM po) WHERE x = top""")  # fmt: skip
def sync_hull_points(e):
    return sync.message_points(_messages(e))


@query(EXCHANGES_SQL + """, rt AS (SELECT least(out_trace, in_trace) AS a, greatest(out_trace, in_trace) AS b, min((in_ns - acked_out_ns) - (out_ns - acked_in_ns)) AS rtt_ns FROM ex GROUP BY ALL)
  SELECT out_trace, in_trace, count(*) AS messages, count(*) FILTER (in_ns <= out_ns) AS inversions, count(*) FILTER (in_ns > out_ns AND (in_ns - out_ns) * 2 < rtt_ns) AS too_fast,
    count(*) FILTER (rtt_ns IS NULL) AS no_rtt, min(out_ns) AS first_ns, max(out_ns) AS last_ns
  FROM me LEFT JOIN rt ON a = least(out_trace, in_trace) AND b = greatest(out_trace, in_trace) GROUP BY ALL""")  # fmt: skip
def sync_eval_messages(e):
    return sync.message_quality(_messages(e), sync.least_round_trip(_exchanges(e)))


@query(MESSAGES_SQL + f""", v AS (SELECT (in_ns - out_ns) / 1e16 AS s FROM me)
  SELECT CASE WHEN s > 0 THEN least(greatest(CAST(floor(ln(s) / ln(pow(10, 6 / 998.0::DOUBLE))) AS BIGINT) + {sync.HISTOGRAM_BINS - 1}, 0), {sync.HISTOGRAM_BINS - 1}) ELSE 0 END AS bin, count(*) AS n FROM v GROUP BY 1""")  # fmt: skip
def sync_eval_rtt_histogram(e):
    """Times between sending and receiving; the driver's events are hours apart, so their unit is ten million seconds."""
    return sync.histogram(_messages(e), (F.col("in_ns") - F.col("out_ns")) / F.lit(1e16))


@query()
def sync_time_bounds(e):
    """What each pair's second clock can show when the first is at the third day."""
    return sync.pair_bounds(sync.message_points(_messages(e)), 1_704_067_200_000_000_000 + 2 * 86_400_000_000_000)


def _reduced(e):
    """The pairs' table is as large as the square of the traces."""
    pairs = sync.factors(sync.message_points(_messages(e))).select("a", "b", "type", "drift", "offset", "accuracy").collect()
    return e.sparkSession.createDataFrame(sync.reduce_factors([tuple(p) for p in pairs], TRACES), "trace int, reference int, drift double, offset double")


@query()
def sync_factors(e):
    """Lines of all pairs and what they come to per trace."""
    return _reduced(e)


@query()
def sync_eval_corrected(e):
    """The evaluation of messages once more, on corrected times."""
    reduced = _reduced(e)
    message, acked = {"out_ns": "out_trace", "in_ns": "in_trace"}, {"acked_out_ns": "in_trace", "acked_in_ns": "out_trace"}
    exchanges = sync.corrected_columns(_exchanges(e), reduced, message | acked)
    return sync.message_quality(sync.corrected_columns(_messages(e), reduced, message), sync.least_round_trip(exchanges))
