"""All queries of the trace engine by name, with their SQL over the driver's tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.functions import names, scalars
from tracelake.functions.adapter import EVENTS_SQL, ORDER_SQL, of_types, trace_events
from tracelake.functions.tables import settled, shared_dir
from tracelake.operators import checks, dependencies, fold, ordering, pairing, printing, snapshots, statistics, timelines
from tracelake.plans.filterlang import compile_filter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
DAY = 86_400_000_000_000
#: 2024-01-01, where the driver's events begin.
EPOCH = 1_704_067_200_000_000_000
T1, T2 = EPOCH + 2 * DAY, EPOCH + 5 * DAY


def query(sql: str | None = None, events: bool = True):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = f"WITH {EVENTS_SQL}{sql}" if events else sql
        return f

    return add


def on_events(sql: str | None = None):
    """A query whose function takes the event table."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(trace_events(spark, sf_dir))

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        query(sql)(run)
        return f

    return add


LISTED = ("id", "trace_id", "cpu", "event_name", "time_ns", "pid")
LISTED_SQL = "id, trace_id, cpu, event_name, time_ns, pid"


@on_events(f" SELECT {LISTED_SQL} FROM ev")
def event_listing(e):
    return e.select(*LISTED)


@on_events(f" SELECT {LISTED_SQL} FROM ev WHERE pid < 10 AND (event_name = 'syscall_entry' OR cpu = 2)")
def event_listing_filtered(e):
    return e.where(compile_filter("state.pid < 10 & (event.name = kernel.syscall_entry | state.cpu = 2)")).select(*LISTED)


@on_events(f" SELECT {LISTED_SQL} FROM ev WHERE ((event_name = 'irq_entry') <> (cpu = 1)) AND NOT (pid >= 20 OR channel <> 'kernel')")
def event_listing_filter_xor_not(e):
    return e.where(compile_filter("[event.subname=irq_entry ^ state.cpu=1] & !{state.pid>=20 | channel.name!=kernel}")).select(*LISTED)


@on_events(f" SELECT {LISTED_SQL} FROM ev WHERE cpu = 0 AND (event_name = 'irq_entry' OR pid < 8)")
def event_listing_filter_compat(e):
    """No precedence: a & b | c is a & (b | c), where the other reading gives every event of a pid below 8."""
    return e.where(compile_filter("state.cpu = 0 & event.subname = irq_entry | state.pid < 8", compat=True)).select(*LISTED)


@on_events(f" SELECT {LISTED_SQL} FROM ev WHERE (time_ns, tracefile_id, trace_id, block, \"offset\") < ({T2}, 2, 0, 0, 0) AND time_ns >= {T1}")
def events_up_to_position(e):
    """From a time to a position, where reading stops."""
    return ordering.before_position(ordering.time_range(e, start=T1), (T2, 2, 0, 0, 0)).select(*LISTED)


@on_events(f" SELECT {LISTED_SQL} FROM ev WHERE k > 90")
def event_field_filter(e):
    return e.where(compile_filter("event.field.k > 90")).select(*LISTED)


@on_events(f" SELECT {LISTED_SQL} FROM ev WHERE time_ns >= {T1} AND time_ns < {T2}")
def time_range_events(e):
    return ordering.time_range(e, T1, T2).select(*LISTED)


@on_events(f" SELECT {LISTED_SQL} FROM ev ORDER BY {ORDER_SQL} LIMIT 100")
def first_n_events(e):
    return ordering.first_events(e, 100).select(*LISTED)


@on_events(f" SELECT {LISTED_SQL} FROM ev WHERE time_ns >= {T1} ORDER BY {ORDER_SQL} LIMIT 50")
def seek_n_forward(e):
    return ordering.seek_forward(e, (T1, -1, -1, -1, -1), 50).select(*LISTED)


@on_events(f" SELECT {LISTED_SQL} FROM ev WHERE time_ns < {T2} AND event_name = 'irq_exit' ORDER BY time_ns DESC, tracefile_id DESC, trace_id DESC, block DESC, \"offset\" DESC LIMIT 50")
def seek_n_backward(e):
    return ordering.seek_backward(e.where(compile_filter("event.subname=irq_exit")), (T2, -1, -1, -1, -1), 50).select(*LISTED)


@on_events(f" SELECT {LISTED_SQL} FROM ev WHERE time_ns >= {T1} ORDER BY {ORDER_SQL} LIMIT 1")
def event_at_or_after(e):
    return ordering.at_or_after(e, T1).select(*LISTED)


#: Times of many seeks, spread over the trace.
SOUGHT = tuple(EPOCH + (k * 7919 % 30_000) * DAY // 1000 for k in range(200))


@on_events(f" SELECT t AS sought_ns, min(id) FILTER (rank = least_rank) AS id FROM (SELECT t, id, r.rank, min(r.rank) OVER (PARTITION BY t) AS least_rank FROM (SELECT unnest([{', '.join(map(str, SOUGHT))}]) AS t) JOIN (SELECT *, row_number() OVER (ORDER BY {ORDER_SQL}) AS rank FROM ev) r ON r.time_ns >= t) GROUP BY t")
def seek_many_times(e):
    """The first event at or after each of two hundred times."""
    return ordering.seek_many(e, SOUGHT).select("sought_ns", F.col("position.offset").alias("id"))


@on_events(f" SELECT {LISTED_SQL} FROM ev WHERE time_ns >= {T1} ORDER BY {ORDER_SQL} LIMIT 150000")
def seek_far_forward(e):
    return ordering.seek_forward(e, (T1, -1, -1, -1, -1), 150_000).select(*LISTED)


@on_events(f" SELECT {LISTED_SQL} FROM ev WHERE time_ns < {T2} ORDER BY time_ns DESC, tracefile_id DESC, trace_id DESC, block DESC, \"offset\" DESC LIMIT 150000")
def seek_far_backward(e):
    return ordering.seek_backward(e, (T2, -1, -1, -1, -1), 150_000).select(*LISTED)


@on_events(f" SELECT id, row_number() OVER (ORDER BY {ORDER_SQL}) AS rank FROM ev")
def event_rank(e):
    return ordering.ranked(e).select("id", "rank")


@on_events(
    """, l AS (SELECT *, lag(time_ns) OVER (PARTITION BY trace_id, tracefile_id ORDER BY block, "offset") AS last FROM ev)
    SELECT trace_id, tracefile_id, count(*) AS events, count(*) FILTER (time_ns < last) AS backward, count(*) FILTER (time_ns = last) AS equal FROM l GROUP BY ALL"""
)
def monotonicity(e):
    return ordering.out_of_order(e)


@on_events(" SELECT trace_id, min(time_ns) AS start_ns, max(time_ns) AS end_ns FROM ev GROUP BY ROLLUP (trace_id)")
def time_span(e):
    return e.rollup("trace_id").agg(F.min("time_ns").alias("start_ns"), F.max("time_ns").alias("end_ns"))


@on_events(" SELECT count(*) AS events FROM ev")
def event_count_total(e):
    return statistics.event_counts(e)


@on_events(" SELECT trace_id, count(*) AS events FROM ev GROUP BY ROLLUP (trace_id)")
def event_count_by_trace(e):
    return e.rollup("trace_id").agg(F.count(F.lit(1)).alias("events"))


@on_events(f" SELECT cpu, event_name, count(*) AS events FROM ev WHERE pid < 100 AND time_ns >= {EPOCH} AND time_ns < {EPOCH + 20 * DAY} GROUP BY ALL")
def event_counts_by_type_cpu(e):
    """Events per CPU and type under a filter and a time window."""
    return statistics.event_counts(ordering.time_range(e.where(compile_filter("state.pid<100")), EPOCH, EPOCH + 20 * DAY), "cpu", "event_name")


RUNNING_SQL = f"""coalesce(last_value(CASE WHEN event_name = 'sched_schedule' THEN next_pid END IGNORE NULLS) OVER (PARTITION BY trace_id, cpu ORDER BY {ORDER_SQL} ROWS BETWEEN UNBOUNDED PRECEDING AND {{}}), 0)"""
BEFORE_SQL, AFTER_SQL = RUNNING_SQL.format("1 PRECEDING"), RUNNING_SQL.format("CURRENT ROW")


@on_events(f", r AS (SELECT *, {AFTER_SQL} AS running_pid FROM ev) SELECT trace_id, running_pid, cpu, event_name, count(*) AS events FROM r GROUP BY ALL")
def event_counts_by_process(e):
    return statistics.event_counts(pairing.running_process(e, after=True), "trace_id", "running_pid", "cpu", "event_name")


HISTOGRAM = (EPOCH, EPOCH + 30 * DAY, 200)


@on_events(
    f", c AS (SELECT (time_ns - {EPOCH}) * 200 // {30 * DAY} AS bin, count(*) AS n FROM ev WHERE time_ns >= {EPOCH} AND time_ns < {EPOCH + 30 * DAY} GROUP BY 1) SELECT r.bin, coalesce(n, 0) AS events FROM range(200) r(bin) LEFT JOIN c ON c.bin = r.bin"
)
def event_density_histogram(e):
    return statistics.density_histogram(e, *HISTOGRAM)


@on_events(f" SELECT id, {BEFORE_SQL} AS running_pid FROM ev")
def running_process_asof(e):
    return pairing.running_process(e).select("id", "running_pid")


@on_events(f" SELECT id, coalesce(last_value(CASE WHEN event_name = 'syscall_entry' THEN 'prog' || (k % 7) END IGNORE NULLS) OVER (PARTITION BY trace_id, pid ORDER BY {ORDER_SQL} ROWS UNBOUNDED PRECEDING), 'UNNAMED') AS process_name FROM ev")
def process_name_asof(e):
    """The latest name that a process took, as by exec."""
    taken = F.when(F.col("event_name") == "syscall_entry", F.concat(F.lit("prog"), (F.col("k") % 7).cast("string")))
    return pairing.as_of(e, taken, "process_name", "trace_id", "pid").select("id", F.coalesce("process_name", F.lit("UNNAMED")).alias("process_name"))


@query(", n AS (SELECT n_nationkey AS id, n_name AS name FROM nation WHERE n_nationkey < 12) SELECT ev.id, coalesce(name, 'syscall ' || syscall_id) AS syscall FROM ev LEFT JOIN n ON n.id = syscall_id WHERE event_name = 'syscall_entry'")
def syscall_name_lookup(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/nation.parquet").where("n_nationkey < 12").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    return pairing.with_names(of_types(trace_events(spark, sf_dir), "syscall_entry"), table, "syscall_id", "syscall", "syscall").select("id", "syscall")


@on_events(
    f""", f AS (SELECT *, k % 8 AS fd FROM ev) SELECT id, last_value(CASE WHEN event_name = 'syscall_entry' THEN 'file' || k END IGNORE NULLS) OVER (PARTITION BY trace_id, pid, fd ORDER BY {ORDER_SQL} ROWS UNBOUNDED PRECEDING) AS filename FROM f"""
)
def fd_filename_asof(e):
    named = F.when(F.col("event_name") == "syscall_entry", F.concat(F.lit("file"), F.col("k").cast("string")))
    return pairing.as_of(e.withColumn("fd", F.col("k") % 8), named, "filename", "trace_id", "pid", "fd").select("id", "filename")


def _brackets_sql(entry: str, exit: str, keys: str) -> str:
    w = f"OVER (PARTITION BY {keys} ORDER BY {ORDER_SQL} ROWS UNBOUNDED PRECEDING)"
    return f""", b0 AS (SELECT *, CASE event_name WHEN '{entry}' THEN 1 ELSE -1 END AS step FROM ev WHERE event_name IN ('{entry}', '{exit}')),
    b1 AS (SELECT *, sum(step) {w} AS s FROM b0), b2 AS (SELECT *, least(min(s) {w}, 0) AS low FROM b1),
    b3 AS (SELECT *, lag(low, 1, 0) OVER (PARTITION BY {keys} ORDER BY {ORDER_SQL}) AS was FROM b2),
    b4 AS (SELECT *, CAST(s - low + CASE WHEN step = -1 THEN 1 ELSE 0 END AS BIGINT) AS depth FROM b3 WHERE NOT (step = -1 AND low < was)),
    b5 AS (SELECT *, lead(time_ns) OVER w AS end_ns, lead(id) OVER w AS exit_id FROM b4 WINDOW w AS (PARTITION BY {keys}, depth ORDER BY {ORDER_SQL})),
    br AS (SELECT * FROM b5 WHERE step = 1)"""


SYSCALLS_SQL, IRQS_SQL = _brackets_sql("syscall_entry", "syscall_exit", "trace_id, pid"), _brackets_sql("irq_entry", "irq_exit", "trace_id, cpu")


def _irqs(e):
    return pairing.brackets(e, "irq_entry", "irq_exit", "trace_id", "cpu")


def _syscalls(e):
    return pairing.brackets(e, "syscall_entry", "syscall_exit", "trace_id", "pid")


@on_events(SYSCALLS_SQL + " SELECT id, trace_id, pid, syscall_id, time_ns AS start_ns, end_ns, exit_id, depth FROM br")
def syscall_intervals(e):
    return _syscalls(e).select("id", "trace_id", "pid", "syscall_id", F.col("time_ns").alias("start_ns"), "end_ns", "exit_id", "depth")


@on_events(IRQS_SQL + " SELECT id, exit_id, irq_id, end_ns - time_ns AS duration_ns FROM br WHERE end_ns IS NOT NULL")
def irq_pairs_lifo(e):
    return _irqs(e).where("end_ns is not null").select("id", "exit_id", "irq_id", (F.col("end_ns") - F.col("time_ns")).alias("duration_ns"))


@on_events(
    f""", k AS (SELECT *, row_number() OVER (PARTITION BY trace_id, cpu, event_name ORDER BY {ORDER_SQL}) AS nth FROM ev)
    SELECT a.id, b.id AS exit_id, a.irq_id, b.time_ns - a.time_ns AS duration_ns FROM k a JOIN k b USING (trace_id, cpu, nth) WHERE a.event_name = 'irq_entry' AND b.event_name = 'irq_exit'"""
)
def irq_pairs_fifo(e):
    return pairing.pairs_fifo(e, "irq_entry", "irq_exit", "trace_id", "cpu").select("id", "exit_id", "irq_id", (F.col("end_ns") - F.col("time_ns")).alias("duration_ns"))


IRQ_SQL = IRQS_SQL + """, d AS (SELECT *, end_ns - time_ns AS d FROM br WHERE end_ns IS NOT NULL), win AS (SELECT max(end_ns) - min(time_ns) AS width FROM d),
    g AS (SELECT irq_id, count(*) AS n, CAST(sum(d) AS BIGINT) AS total_ns, max(d) AS max_ns, min(d) AS min_ns FROM d GROUP BY 1),
    h AS (SELECT *, CAST(floor(n * 1e9 / width) AS BIGINT) AS hz FROM g, win)"""


@on_events(IRQ_SQL + " SELECT irq_id, n, total_ns, max_ns, min_ns, total_ns // n AS avg_ns, hz, CASE WHEN hz > 0 THEN CAST(floor(1e9 / hz) AS BIGINT) ELSE 0 END AS period_ns FROM h")
def irq_statistics(e):
    return statistics.irq_statistics(_irqs(e)).select("irq_id", "n", "total_ns", "max_ns", "min_ns", "avg_ns", "hz", "period_ns")


@on_events(IRQ_SQL + " SELECT d.irq_id, CAST(round(stddev_pop(d) / 1e6) AS BIGINT) AS duration_sd_ms, CAST(round(sqrt(avg((d - hz)::DOUBLE ** 2)) / 1e6) AS BIGINT) AS hz_sd_ms FROM d JOIN h USING (irq_id) GROUP BY 1")
def irq_stdev(e):
    return statistics.irq_statistics(_irqs(e)).select("irq_id", F.round(F.col("duration_sd") / 1e6).cast("bigint").alias("duration_sd_ms"), F.round(F.col("hz_sd") / 1e6).cast("bigint").alias("hz_sd_ms"))


@query(
    """SELECT l_suppkey % 16 AS disk, CAST(sum(CASE WHEN l_returnflag = 'R' THEN l_quantity::BIGINT * 512 ELSE 0 END) AS BIGINT) AS bytes_read, count(*) FILTER (l_returnflag = 'R') AS reads,
    CAST(sum(CASE WHEN l_returnflag <> 'R' THEN l_quantity::BIGINT * 512 ELSE 0 END) AS BIGINT) AS bytes_written, count(*) FILTER (l_returnflag <> 'R') AS writes,
    CAST(sum(CASE WHEN l_returnflag = 'R' THEN l_quantity::BIGINT * 512 ELSE 0 END) AS BIGINT) * 1000000000 // 60000000000 AS read_per_s,
    CAST(sum(CASE WHEN l_returnflag <> 'R' THEN l_quantity::BIGINT * 512 ELSE 0 END) AS BIGINT) * 1000000000 // 60000000000 AS written_per_s FROM lineitem GROUP BY 1""",
    events=False,
)
def disk_performance(spark, sf_dir):
    """Line items as sized operations on sixteen disks."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    ops = items.select((F.col("l_suppkey") % 16).alias("disk"), F.when(F.col("l_returnflag") == "R", "read").otherwise("write").alias("op"), (F.col("l_quantity").cast("bigint") * 512).alias("bytes"))
    return statistics.disk_performance(ops, 60_000_000_000)


def _islands_sql(source: str, state: str, keys: str, where: str = "TRUE") -> str:
    w = f"(PARTITION BY {keys} ORDER BY {ORDER_SQL} ROWS UNBOUNDED PRECEDING)"
    return f""", i1 AS (SELECT *, last_value({state} IGNORE NULLS) OVER {w} AS state FROM {source} WHERE {where}), i2 AS (SELECT * FROM i1 WHERE state IS NOT NULL),
    i3 AS (SELECT *, CASE WHEN lag(state) OVER (PARTITION BY {keys} ORDER BY {ORDER_SQL}) = state THEN 0 ELSE 1 END AS fresh FROM i2), i4 AS (SELECT *, sum(fresh) OVER {w} AS run FROM i3),
    i5 AS (SELECT {keys}, run, state, min(time_ns) AS start_ns, count(*) AS events FROM i4 GROUP BY ALL)
    SELECT {keys}, state, start_ns, events, lead(start_ns) OVER (PARTITION BY {keys} ORDER BY run) AS end_ns FROM i5"""


#: The rules of state, step by step: each event meets the process that runs before it, and a switch the one that comes.
#: A stack is a list of levels (m mode, s submode, e entry, c change, t status, x time collected), its top the last.
FOLD_SQL = f""", f0 AS (SELECT *, CASE event_name WHEN 'syscall_entry' THEN 'syscall ' || syscall_id WHEN 'irq_entry' THEN 'irq ' || irq_id END AS submode, {BEFORE_SQL} AS ran FROM ev),
  f1 AS (SELECT *, 2 AS rank, 'run' AS role, ran AS who FROM f0 WHERE event_name <> 'sched_schedule' UNION ALL SELECT *, 0, 'out', ran FROM f0 WHERE event_name = 'sched_schedule' UNION ALL SELECT *, 3, 'in', next_pid FROM f0 WHERE event_name = 'sched_schedule'),
  f2 AS MATERIALIZED (SELECT *, CASE WHEN who = 0 THEN cpu ELSE -1 END AS home, row_number() OVER (PARTITION BY trace_id, who, CASE WHEN who = 0 THEN cpu ELSE -1 END ORDER BY {ORDER_SQL}, rank) AS rn FROM f1),
  st AS MATERIALIZED (SELECT f2.*, fo.stack[-1].m AS mode, fo.stack[-1].s AS sub, fo.stack[-1].t AS status, fo.stack[-1].e AS entry_ns, fo.stack[-1].c AS change_ns, len(fo.stack) AS depth, fo.d, fo.el, fo.cum, fo.leaf.m AS lm, fo.leaf.s AS ls FROM f2 JOIN (
    WITH RECURSIVE fo(trace_id, who, home, rn, stack, d, el, cum, leaf) AS (
      SELECT trace_id, who, home, 0::BIGINT, [{{'m': 'MODE_UNKNOWN', 's': 'NONE', 'e': time_ns, 'c': time_ns, 't': 'UNNAMED', 'x': 0::BIGINT}}], NULL::BIGINT, NULL::BIGINT, NULL::BIGINT, {{'m': '', 's': ''}} FROM f2 WHERE rn = 1
      UNION ALL
      SELECT trace_id, who, home, rn,
        CASE WHEN role = 'in' THEN rest || [{{'m': t.m, 's': t.s, 'e': t.e, 'c': time_ns, 't': 'RUN', 'x': x}}]
          WHEN role = 'out' AND who = 0 AND t.m = 'MODE_UNKNOWN' THEN rest || [CASE WHEN pid = 0 THEN {{'m': 'SYSCALL', 's': t.s, 'e': time_ns, 'c': time_ns, 't': 'WAIT', 'x': x}} ELSE {{'m': t.m, 's': t.s, 'e': t.e, 'c': t.c, 't': t.t, 'x': x}} END]
          WHEN role = 'out' THEN rest || [{{'m': t.m, 's': t.s, 'e': t.e, 'c': time_ns, 't': CASE WHEN prev_state = 0 THEN 'WAIT_CPU' ELSE 'WAIT' END, 'x': x}}]
          WHEN event_name = 'irq_entry' OR event_name = 'syscall_entry' AND who <> 0 THEN rest || [{{'m': t.m, 's': t.s, 'e': t.e, 'c': t.c, 't': t.t, 'x': x}}, {{'m': CASE event_name WHEN 'irq_entry' THEN 'IRQ' ELSE 'SYSCALL' END, 's': submode, 'e': time_ns, 'c': time_ns, 't': t.t, 'x': 0::BIGINT}}]
          WHEN len(stack) > 1 AND (event_name = 'irq_exit' AND t.m = 'IRQ' OR event_name = 'syscall_exit' AND who <> 0 AND t.m = 'SYSCALL') THEN stack[1:len(stack) - 2] || [{{'m': u.m, 's': u.s, 'e': u.e, 'c': time_ns, 't': u.t, 'x': u.x}}]
          ELSE rest || [{{'m': t.m, 's': t.s, 'e': t.e, 'c': t.c, 't': t.t, 'x': x}}] END,
        d, CASE WHEN event_name IN ('irq_exit', 'syscall_exit') THEN CASE WHEN t.m <> 'MODE_UNKNOWN' THEN time_ns - t.e ELSE 0 END END, CASE WHEN event_name IN ('irq_exit', 'syscall_exit') THEN x END, {{'m': t.m, 's': t.s}}
      FROM (SELECT *, t.x + coalesce(d, 0) AS x FROM (SELECT n.*, fo.stack, fo.stack[-1] AS t, fo.stack[-2] AS u, fo.stack[1:len(fo.stack) - 1] AS rest,
          CASE WHEN n.role = 'in' THEN NULL WHEN fo.stack[-1].m <> 'MODE_UNKNOWN' AND fo.stack[-1].t = 'RUN' THEN n.time_ns - fo.stack[-1].c ELSE 0 END AS d
        FROM fo JOIN f2 n ON n.trace_id = fo.trace_id AND n.who = fo.who AND n.home = fo.home AND n.rn = fo.rn + 1))
    ) SELECT * FROM fo WHERE rn > 0) fo USING (trace_id, who, home, rn))"""
#: The same for the CPUs' own stacks.
CPU_SQL = f""", c2 AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY trace_id, cpu ORDER BY {ORDER_SQL}) AS rn FROM ev),
  cm AS (SELECT c2.*, co.stack[-1] AS cpu_mode FROM c2 JOIN (WITH RECURSIVE co(trace_id, cpu, rn, stack) AS (
      SELECT DISTINCT trace_id, cpu, 0::BIGINT, ['UNKNOWN'] FROM c2
      UNION ALL
      SELECT n.trace_id, n.cpu, n.rn, CASE n.event_name WHEN 'sched_schedule' THEN [CASE WHEN n.next_pid = 0 THEN 'IDLE' ELSE 'BUSY' END] WHEN 'irq_entry' THEN co.stack || ['IRQ']
        WHEN 'irq_exit' THEN CASE WHEN len(co.stack) <= 1 THEN ['UNKNOWN'] ELSE co.stack[1:len(co.stack) - 1] END ELSE co.stack END
      FROM co JOIN c2 n ON n.trace_id = co.trace_id AND n.cpu = co.cpu AND n.rn = co.rn + 1) SELECT * FROM co) co USING (trace_id, cpu, rn))"""


def _stated(e: DataFrame) -> DataFrame:
    """Events with what the state needs of them."""
    submode = F.when(F.col("event_name") == "syscall_entry", F.concat(F.lit("syscall "), F.col("syscall_id"))).when(F.col("event_name") == "irq_entry", F.concat(F.lit("irq "), F.col("irq_id")))
    return e.withColumn("submode", submode).withColumn("prev_pid", F.col("pid"))


@on_events(CPU_SQL + _islands_sql("cm", "lower(cpu_mode)", "trace_id, cpu"))
def cpu_timeline(e):
    return timelines.cpu_timeline(_stated(e), listed=False)


@on_events(CPU_SQL + ", tl AS (" + _islands_sql("cm", "lower(cpu_mode)", "trace_id, cpu").replace(", i1 AS", "WITH i1 AS", 1) + f""")
    SELECT trace_id, cpu, bin, CAST(sum(least(coalesce(end_ns, {EPOCH + 30 * DAY}), {EPOCH} + (bin + 1) * {DAY}) - greatest(start_ns, {EPOCH} + bin * {DAY})) AS BIGINT) AS busy_ns
    FROM tl JOIN range(30) r(bin) ON coalesce(end_ns, {EPOCH + 30 * DAY}) > {EPOCH} + bin * {DAY} AND start_ns < {EPOCH} + (bin + 1) * {DAY} WHERE state <> 'idle' GROUP BY ALL""")
def cpu_usage(e):
    """Busy time of each CPU on each day."""
    return statistics.cpu_usage(timelines.cpu_timeline(_stated(e), listed=False), EPOCH, EPOCH + 30 * DAY, 30)


@on_events(f""", q0 AS (SELECT *, CASE event_name WHEN 'irq_entry' THEN 1 ELSE -1 END AS step FROM ev WHERE event_name IN ('irq_entry', 'irq_exit')),
    q1 AS (SELECT *, sum(step) OVER (PARTITION BY trace_id, irq_id ORDER BY {ORDER_SQL} ROWS UNBOUNDED PRECEDING) AS s FROM q0),
    q2 AS (SELECT *, s - least(min(s) OVER (PARTITION BY trace_id, irq_id ORDER BY {ORDER_SQL} ROWS UNBOUNDED PRECEDING), 0) AS open FROM q1)""" + _islands_sql("q2", "CASE WHEN open > 0 THEN 'busy' ELSE 'unknown' END", "trace_id, irq_id"))  # fmt: skip
def irq_timeline(e):
    return timelines.irq_timeline(e)


def _renamed(e, names: dict[str, str]) -> DataFrame:
    """Events of some types read as others, for the operators whose events the driver's table has no type of."""
    kind = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])[F.col("event_name")]
    return of_types(e, *names).withColumn("event_name", kind).drop("event_type")


SOFT = {"sched_schedule": "softirq_raise", "irq_entry": "softirq_entry", "irq_exit": "softirq_exit"}
SOFT_SQL = f""", q0 AS (SELECT *, irq_id AS softirq_id, CASE event_name WHEN 'irq_entry' THEN 1 WHEN 'irq_exit' THEN -1 ELSE 0 END AS step FROM ev WHERE event_name IN ('sched_schedule', 'irq_entry', 'irq_exit')),
    q1 AS (SELECT *, sum(step) OVER w AS s, last_value(CASE event_name WHEN 'sched_schedule' THEN TRUE WHEN 'irq_entry' THEN FALSE END IGNORE NULLS) OVER w AS pending FROM q0 WINDOW w AS (PARTITION BY trace_id, softirq_id ORDER BY {ORDER_SQL} ROWS UNBOUNDED PRECEDING)),
    q2 AS (SELECT *, s - least(min(s) OVER (PARTITION BY trace_id, softirq_id ORDER BY {ORDER_SQL} ROWS UNBOUNDED PRECEDING), 0) AS running FROM q1)"""


@on_events(SOFT_SQL + _islands_sql("q2", "CASE WHEN running > 0 THEN 'running' WHEN pending THEN 'pending' ELSE 'idle' END", "trace_id, softirq_id"))
def softirq_timeline(e):
    return timelines.softirq_timeline(_renamed(e, SOFT).withColumn("softirq_id", F.col("irq_id")))


TRAP_SQL = f""", q0 AS (SELECT *, k % 6 AS trap_id, CASE event_name WHEN 'syscall_entry' THEN 1 ELSE -1 END AS step FROM ev WHERE event_name IN ('syscall_entry', 'syscall_exit')),
    q1 AS (SELECT *, sum(step) OVER (PARTITION BY trace_id, trap_id ORDER BY {ORDER_SQL} ROWS UNBOUNDED PRECEDING) AS s FROM q0),
    q2 AS (SELECT *, s - least(min(s) OVER (PARTITION BY trace_id, trap_id ORDER BY {ORDER_SQL} ROWS UNBOUNDED PRECEDING), 0) AS running FROM q1)"""


@on_events(TRAP_SQL + _islands_sql("q2", "CASE WHEN running > 0 THEN 'busy' ELSE 'idle' END", "trace_id, trap_id"))
def trap_timeline(e):
    return timelines.trap_timeline(_renamed(e, {"syscall_entry": "trap_entry", "syscall_exit": "trap_exit"}).withColumn("trap_id", F.col("k") % 6))


BDEV_SQL = f""", q AS MATERIALIZED (SELECT *, k // 25 AS major, k % 4 AS minor, pid % 2 AS direction, row_number() OVER (PARTITION BY trace_id, k // 25, k % 4 ORDER BY {ORDER_SQL}) AS rn FROM ev WHERE event_name IN ('irq_entry', 'irq_exit')),
  bd AS (SELECT q.*, bo.stack[-1] AS now FROM q JOIN (WITH RECURSIVE bo(trace_id, major, minor, rn, stack) AS (
      SELECT DISTINCT trace_id, major, minor, 0::BIGINT, []::VARCHAR[] FROM q
      UNION ALL
      SELECT n.trace_id, n.major, n.minor, n.rn, CASE WHEN n.event_name = 'irq_entry' THEN (CASE WHEN bo.stack = ['unknown'] THEN []::VARCHAR[] ELSE bo.stack END) || [CASE n.direction WHEN 0 THEN 'reading' ELSE 'writing' END]
        WHEN len(bo.stack) <= 1 THEN ['unknown'] ELSE bo.stack[1:len(bo.stack) - 1] END
      FROM bo JOIN q n ON n.trace_id = bo.trace_id AND n.major = bo.major AND n.minor = bo.minor AND n.rn = bo.rn + 1) SELECT * FROM bo) bo USING (trace_id, major, minor, rn))"""


@on_events(BDEV_SQL + _islands_sql("bd", "now", "trace_id, major, minor"))
def bdev_timeline(e):
    own = _renamed(e, {"irq_entry": "_blk_request_issue", "irq_exit": "_blk_request_complete"})
    return timelines.bdev_timeline(own.withColumn("major", F.expr("k div 25")).withColumn("minor", F.col("k") % 4).withColumn("direction", F.col("pid") % 2))


SWITCH_SQL = f""", sw AS (SELECT trace_id, cpu, time_ns, tracefile_id, block, "offset", 0 AS turn, pid, CASE WHEN prev_state = 0 THEN 'WAIT_CPU' ELSE 'WAIT' END AS status FROM ev WHERE event_name = 'sched_schedule'
    UNION ALL SELECT trace_id, cpu, time_ns, tracefile_id, block, "offset", 1, next_pid, 'RUN' FROM ev WHERE event_name = 'sched_schedule'),
    pt AS (SELECT trace_id, pid, cpu, status, time_ns AS start_ns, lead(time_ns) OVER (PARTITION BY trace_id, pid ORDER BY {ORDER_SQL}, turn) AS end_ns, "offset" AS event_id, turn FROM sw)"""


@on_events(SWITCH_SQL + " SELECT * FROM pt")
def run_timeline(e):
    """Statuses from switches alone."""
    return timelines.run_timeline(e)


@on_events(FOLD_SQL + """, ps AS (SELECT trace_id, who AS pid, home, time_ns, tracefile_id, block, "offset" * 8 + rank AS "offset", CASE WHEN status = 'RUN' THEN 'RUN ' || mode ELSE status END AS label FROM st)""" + _islands_sql("ps", "label", "trace_id, pid, home"))
def process_timeline(e):
    return timelines.process_timeline(_stated(e), listed=False)


LEAVES_SQL = FOLD_SQL + """, lv AS (SELECT trace_id, who AS pid, cpu, mode, sub AS submode, event_name, 1 AS n, NULL AS d, NULL AS el, NULL AS cum FROM st WHERE role <> 'out'
    UNION ALL SELECT trace_id, who, cpu, lm, ls, NULL, 0, d, el, cum FROM st WHERE d IS NOT NULL),
  le AS (SELECT trace_id, pid, 0::BIGINT AS birth_ns, cpu, 0::BIGINT AS function, mode, submode, CAST(coalesce(sum(d), 0) AS BIGINT) AS cpu_time_ns, CAST(coalesce(sum(el), 0) AS BIGINT) AS elapsed_ns, CAST(coalesce(sum(cum), 0) AS BIGINT) AS cumulative_ns, CAST(sum(n) AS BIGINT) AS events FROM lv GROUP BY ALL)"""


def _stats(e):
    return statistics.mode_stats(_stated(e), listed=False)


@on_events(LEAVES_SQL + " SELECT * FROM le")
def process_mode_stats(e):
    """CPU, elapsed and cumulative time and events of each process, CPU, function, mode and submode."""
    return _stats(e)


@on_events(LEAVES_SQL + " SELECT trace_id, pid, birth_ns, cpu, function, mode, submode, event_name, sum(n)::BIGINT AS events FROM (SELECT *, 0::BIGINT AS birth_ns, 0::BIGINT AS function FROM lv WHERE n > 0) GROUP BY ALL")
def event_type_stats(e):
    return statistics.event_type_stats(_stated(e), listed=False)


@on_events(LEAVES_SQL + """, ro AS (SELECT trace_id, pid, birth_ns, cpu, function, mode, submode, CAST(sum(cpu_time_ns) AS BIGINT) AS cpu_time_ns, CAST(sum(elapsed_ns) AS BIGINT) AS elapsed_ns, CAST(sum(cumulative_ns) AS BIGINT) AS cumulative_ns, CAST(sum(events) AS BIGINT) AS events,
      grouping(pid)::INT AS g1, grouping(cpu)::INT AS g2, grouping(function)::INT AS g3, grouping(mode)::INT AS g4, grouping(submode)::INT AS g5, grouping(trace_id)::INT AS g0
    FROM le GROUP BY GROUPING SETS ((trace_id, pid, birth_ns, cpu, function, mode, submode), (trace_id, pid, birth_ns, cpu, function, mode), (trace_id, pid, birth_ns, cpu, function), (trace_id, pid, birth_ns, cpu), (trace_id, pid, birth_ns), (trace_id, cpu), (trace_id), ()))
    SELECT trace_id, pid, birth_ns, cpu, function, mode, submode, cpu_time_ns, elapsed_ns, cumulative_ns, events,
      CASE WHEN g5 = 0 THEN 'submode' WHEN g4 = 0 THEN 'mode' WHEN g3 = 0 THEN 'function' WHEN g1 = 0 AND g2 = 0 THEN 'process_cpu' WHEN g1 = 0 THEN 'process' WHEN g2 = 0 THEN 'trace_cpu' WHEN g0 = 0 THEN 'trace' ELSE 'traceset' END AS level FROM ro""")  # fmt: skip
def stats_rollup(e):
    return statistics.stats_rollup(_stats(e))


@on_events(LEAVES_SQL + """ SELECT '/trace' || trace_id || '/' || pid || '-0.0/' || cpu || '/0x0/' || mode || '/' || submode || '/' || x.m || ': ' || x.v AS line
    FROM (SELECT *, unnest([{'m': 'cpu_time', 'v': cpu_time_ns}, {'m': 'elapsed_time', 'v': elapsed_ns}, {'m': 'cumulative_cpu_time', 'v': cumulative_ns}, {'m': 'events_count', 'v': events}]) AS x FROM le)""")  # fmt: skip
def stats_path_output(e):
    return statistics.stats_paths(_stats(e))


@on_events(
    FOLD_SQL + """ SELECT id, channel || '.' || event_name || ': ' || (time_ns // 1000000000) || '.' || lpad(CAST(time_ns % 1000000000 AS VARCHAR), 9, '0') || ' (trace' || trace_id || '/kernel_' || cpu || '), ' || who || ', 0, UNNAMED, , 0, 0x0, ' || mode ||
    CASE event_name WHEN 'syscall_entry' THEN ' { syscall_id = ' || syscall_id || ' }' WHEN 'irq_entry' THEN ' { irq_id = ' || irq_id || ' }' WHEN 'sched_schedule' THEN ' { pid = ' || pid || ', next_pid = ' || next_pid || ', prev_state = ' || prev_state || ' }' ELSE '' END || ' ' || status || ' ' AS line FROM st WHERE role <> 'out'"""
)
def text_dump(e):
    """The dump's lines, with the process's status after each."""
    own = _stated(e)
    return printing.event_lines(printing.with_state(own, fold.state_after(own, listed=False)), process_state=True).select("id", "line")


@on_events(f""" SELECT 'trace' || trace_id AS trace, channel AS tracefile, cpu, event_name AS event, time_ns // 1000000000 AS sec, time_ns % 1000000000 AS nsec, pid,
    CASE event_name WHEN 'syscall_entry' THEN '{{{{ syscall_id = ' || syscall_id || ' }}}}' WHEN 'irq_entry' THEN '{{{{ irq_id = ' || irq_id || ' }}}}' WHEN 'sched_schedule' THEN '{{{{ pid = ' || pid || ', next_pid = ' || next_pid || ', prev_state = ' || prev_state || ' }}}}' ELSE '' END AS description,
    time_ns AS position_time_ns, tracefile_id AS position_tracefile_id, trace_id AS position_trace_id, block AS position_block, "offset" AS position_offset FROM ev""".replace("{{", "{").replace("}}", "}"))  # fmt: skip
def event_rows(e):
    """The event list of the detailed view."""
    return printing.detailed_rows(e)


@on_events(f", r AS (SELECT *, {AFTER_SQL} AS running_pid, row_number() OVER (ORDER BY {ORDER_SQL}) AS rank FROM ev) SELECT rank, time_ns, trace_id, cpu, running_pid, id AS event_id FROM r WHERE rank % 501 = 0")
def state_snapshots(e):
    return snapshots.state_snapshots(e, 500)


@on_events(f", r AS (SELECT *, {AFTER_SQL} AS running_pid, row_number() OVER (ORDER BY {ORDER_SQL}) AS rank FROM ev) SELECT rank, time_ns, trace_id, cpu, running_pid, id AS event_id FROM r WHERE rank % 501 = 0 AND time_ns <= {T2} ORDER BY time_ns DESC, rank DESC LIMIT 1")
def seek_closest_state(e):
    return snapshots.closest_snapshot(snapshots.state_snapshots(e, 500), T2)


#: Who gives way to a process ends its wait.
CRITICAL_SQL = SWITCH_SQL + f""", bl AS (SELECT p.trace_id, p.pid, p.start_ns, p.end_ns, (SELECT min_by(e.pid, (e.time_ns, e.id)) FROM ev e WHERE e.trace_id = p.trace_id AND e.event_name = 'sched_schedule' AND e.next_pid = p.pid AND e.time_ns = p.end_ns) AS waker FROM pt p WHERE p.status = 'WAIT' AND p.end_ns IS NOT NULL)"""


def _waits(e):
    return timelines.run_timeline(e).withColumn("duration_ns", F.col("end_ns") - F.col("start_ns"))


@on_events(SWITCH_SQL + """, d AS (SELECT *, end_ns - start_ns AS d, 'Total/' || status || '/' || cpu AS path FROM pt), n AS (SELECT trace_id, pid, d, unnest([struct_pack(node := 'Total', depth := 1), struct_pack(node := 'Total/' || status, depth := 2), struct_pack(node := path, depth := 3)]) AS x FROM d)
    SELECT trace_id, pid, x.node AS node, x.depth AS depth, CAST(coalesce(sum(d), 0) AS BIGINT) AS total_ns, count(*) AS n FROM n GROUP BY ALL""")
def dep_summary_tree(e):
    return dependencies.summary_tree(_waits(e), ["trace_id", "pid"], ["status", "cpu"])


@on_events(SWITCH_SQL + f", d AS (SELECT trace_id, pid, status, start_ns, end_ns, event_id, row_number() OVER (PARTITION BY trace_id, pid ORDER BY end_ns - start_ns DESC, start_ns, event_id) AS rank FROM pt WHERE end_ns >= {T1} AND end_ns <= {T2} AND status <> 'RUN') SELECT * FROM d WHERE rank <= 10")
def dep_episodes(e):
    blocked = dependencies.within(_waits(e), T1, T2).where("status <> 'RUN'")
    return dependencies.episodes(blocked, ["trace_id", "pid"], 10).select("trace_id", "pid", "status", "start_ns", "end_ns", "event_id", "rank")


@on_events(f""", pr AS (SELECT trace_id, next_pid AS pid, min_by(pid, (time_ns, id)) AS ppid FROM ev WHERE event_name = 'sched_schedule' AND pid < next_pid GROUP BY ALL)
    SELECT trace_id, pid, ancestor, distance FROM (WITH RECURSIVE up AS (SELECT trace_id, pid, ppid AS ancestor, 1 AS distance FROM pr UNION ALL SELECT u.trace_id, u.pid, p.ppid, u.distance + 1 FROM up u JOIN pr p ON u.trace_id = p.trace_id AND u.ancestor = p.pid WHERE u.distance < 64) SELECT * FROM up)""")
def process_ancestors(e):
    """A process's parent is the one of smaller pid that first gave way to it."""
    parents = e.where("event_name = 'sched_schedule' and pid < next_pid").groupBy("trace_id", F.col("next_pid").alias("pid")).agg(F.min_by(F.col("pid"), F.struct("time_ns", "id")).alias("ppid"))
    return dependencies.ancestors(e.sparkSession, parents)


def _ops(e, names: dict[str, str], column: str = "op") -> DataFrame:
    return e.withColumn(column, F.create_map(*[F.lit(x) for kv in names.items() for x in kv])[F.col("event_name")])


@on_events(
    f""", o AS (SELECT *, k % 6 AS fd, CASE event_name WHEN 'syscall_exit' THEN 'close' WHEN 'sched_schedule' THEN 'open' WHEN 'irq_entry' THEN 'read' WHEN 'irq_exit' THEN 'write' END AS op FROM ev WHERE event_name <> 'syscall_entry'),
    l AS (SELECT *, last_value(CASE WHEN op IN ('close', 'open') THEN op END IGNORE NULLS) OVER (PARTITION BY trace_id, pid, fd ORDER BY {ORDER_SQL} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS was FROM o)
    SELECT id, trace_id, pid, fd, op FROM l WHERE op IN ('read', 'write') AND was = 'close'"""
)
def fd_use_after_close(e):
    ops = _ops(e.where("event_name <> 'syscall_entry'"), {"syscall_exit": "close", "sched_schedule": "open", "irq_entry": "read", "irq_exit": "write"}).withColumn("fd", F.col("k") % 6).withColumn("newfd", F.lit(None).cast("bigint"))
    return checks.use_after_close(ops).select("id", "trace_id", "pid", "fd", "op")


@on_events(
    f""", o AS (SELECT *, CASE event_name WHEN 'syscall_exit' THEN 'chroot' WHEN 'sched_schedule' THEN 'chdir' ELSE 'open' END AS op, CASE WHEN k % 2 = 0 THEN '/' ELSE '/x' END AS path FROM ev),
    l AS (SELECT *, last_value(CASE WHEN op = 'chroot' THEN 'jailed' WHEN op = 'chdir' AND path = '/' THEN 'safe' END IGNORE NULLS) OVER (PARTITION BY trace_id, pid ORDER BY {ORDER_SQL} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS was FROM o)
    SELECT id, pid FROM l WHERE op = 'open' AND was = 'jailed'"""
)
def chroot_open_before_chdir(e):
    ops = _ops(e, {"syscall_exit": "chroot", "sched_schedule": "chdir", "syscall_entry": "open", "irq_entry": "open", "irq_exit": "open"})
    return checks.open_before_chdir(ops.withColumn("path", F.when(F.col("k") % 2 == 0, "/").otherwise("/x"))).select("id", "pid")


RT = 20_000_000_000_000


@on_events(SWITCH_SQL + f""", l AS (SELECT *, last_value(CASE WHEN status = 'RUN' THEN time_ns END IGNORE NULLS) OVER (PARTITION BY trace_id, pid ORDER BY {ORDER_SQL}, turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS came FROM sw)
    SELECT "offset" AS event_id, trace_id, pid, time_ns - came AS gap_ns, CASE WHEN status = 'RUN' THEN 'late' ELSE 'early out' END AS warning FROM l WHERE (status = 'RUN' AND time_ns - came > {RT}) OR (status <> 'RUN' AND time_ns - came < 1000000000000)""")
def rt_late_schedule(e):
    return checks.late_schedules(timelines.switches(e), RT, 1_000_000_000_000).select(F.col("offset").alias("event_id"), "trace_id", "pid", "gap_ns", "warning")


LOCK_SQL = f""", o AS (SELECT *, CASE WHEN event_name IN ('syscall_entry', 'irq_entry') THEN 'acquire' WHEN event_name IN ('syscall_exit', 'irq_exit') THEN 'release' WHEN k % 4 = 0 THEN 'init' ELSE 'sched' END AS op, k % 12 AS lock, k % 7 = 0 AS read, k % 3 = 0 AS off, event_name = 'irq_entry' AS hard FROM ev),
    a AS (SELECT *, op = 'acquire' AND NOT read AS taken FROM o WHERE op IN ('release', 'init') OR (op = 'acquire' AND NOT read)),
    w AS (SELECT *, max(CASE WHEN taken AND hard THEN 1 END) OVER v AS irq, max(CASE WHEN taken AND NOT hard AND NOT off THEN 1 END) OVER v AS on_ FROM a WINDOW v AS (PARTITION BY trace_id, lock ORDER BY {ORDER_SQL} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    h0 AS (SELECT *, CASE WHEN taken THEN 1 ELSE -1 END AS step FROM a WHERE op <> 'init'), h1 AS (SELECT *, sum(step) OVER v AS s FROM h0 WINDOW v AS (PARTITION BY trace_id, cpu, lock ORDER BY {ORDER_SQL} ROWS UNBOUNDED PRECEDING)),
    h2 AS (SELECT *, least(min(s) OVER v, 0) AS low FROM h1 WINDOW v AS (PARTITION BY trace_id, cpu, lock ORDER BY {ORDER_SQL} ROWS UNBOUNDED PRECEDING)), h3 AS (SELECT *, coalesce(lag(low) OVER v, 0) AS was FROM h2 WINDOW v AS (PARTITION BY trace_id, cpu, lock ORDER BY {ORDER_SQL})),
    h4 AS (SELECT * FROM h3 WHERE taken OR low >= was),
    held AS (SELECT trace_id, cpu, lock, time_ns, "offset", step, s - low AS depth FROM h4)"""


@on_events(LOCK_SQL + f""" SELECT trace_id, cpu, time_ns, "offset", lock, CASE WHEN hard THEN 'taken in an interrupt, and before with interrupts on' ELSE 'taken with interrupts on, and before in an interrupt' END AS warning FROM w WHERE taken AND (hard AND on_ = 1 OR NOT hard AND NOT off AND irq = 1)
    UNION ALL SELECT i.trace_id, i.cpu, i.time_ns, i."offset", i.lock, 'set up again while it is held' FROM o i WHERE op = 'init' AND (SELECT sum(step) FROM held h WHERE h.trace_id = i.trace_id AND h.lock = i.lock AND (h.time_ns, h.cpu, h.trace_id, h."offset") < (i.time_ns, i.cpu, i.trace_id, i."offset")) > 0
    UNION ALL SELECT s.trace_id, s.cpu, s.time_ns, s."offset", l.lock, 'held over a switch' FROM o s JOIN range(12) l(lock) ON TRUE WHERE s.op = 'sched' AND (SELECT sum(step) FROM held h WHERE h.trace_id = s.trace_id AND h.cpu = s.cpu AND h.lock = l.lock AND (h.time_ns, h."offset") < (s.time_ns, s."offset")) > 0""")  # fmt: skip
def lock_irq_inversion(e):
    """Switches of every fourth key stand for a lock that is set up."""
    kind = F.col("event_name")
    op = F.when(kind.isin("syscall_entry", "irq_entry"), "acquire").when(kind.isin("syscall_exit", "irq_exit"), "release").when(F.col("k") % 4 == 0, "init").otherwise("sched")
    ops = e.withColumn("op", op).withColumn("lock", F.col("k") % 12).withColumn("read", F.col("k") % 7 == 0).withColumn("hardirqs_off", F.col("k") % 3 == 0)
    return checks.lock_warnings(ops.withColumn("hardirq_context", kind == "irq_entry"), switches=True, bucket_ns=DAY)


@on_events(f""" SELECT id, pid || '-' || (time_ns // 1000000000) || '.' || (time_ns % 1000000000) AS pid_time, (pid * 1048576 + k) >> 20 AS major, k AS minor, (id >> 24 & 255) || '.' || (id >> 16 & 255) || '.' || (id >> 8 & 255) || '.' || (id & 255) AS address,
    CAST(time_ns::DOUBLE * 1.5 AS BIGINT) AS stretched, CAST(trunc(time_ns::DOUBLE / 3) AS BIGINT) AS divided, (time_ns // 1000000000) * 1000000000 + k AS from_text, k > 0 AS after,
    'a_' || k || '_b' AS safe, CAST(floor((time_ns - {EPOCH})::DOUBLE / {30 * DAY}::DOUBLE * 700) AS BIGINT) AS pixel, CAST(trunc(time_ns::DOUBLE * 1e9 * 2 / 3e9) AS BIGINT) AS from_tsc, CAST(trunc(CAST(trunc(1.25::DOUBLE * time_ns + 17) AS BIGINT)::DOUBLE * 1e9 * 2 / 3e9) AS BIGINT) AS corrected FROM ev""")  # fmt: skip
def scalar_functions(e):
    device, t, k = scalars.device(F.col("pid"), F.col("k")), F.col("time_ns"), F.col("k")
    text = F.concat(F.expr("time_ns div 1000000000L").cast("string"), F.lit("."), k.cast("string"))
    return e.select(
        "id", scalars.process_key(F.col("pid"), t).alias("pid_time"), scalars.major(device).alias("major"), scalars.minor(device).alias("minor"), scalars.dotted(F.col("id")).alias("address"),
        scalars.time_multiplied(t, 1.5).alias("stretched"), scalars.time_divided(t, 3).alias("divided"), scalars.time_from_text(text).alias("from_text"), scalars.sequence_after(F.pmod(k + 4294967290, F.lit(1 << 32)), F.lit(4294967290).cast("long")).alias("after"),
        scalars.file_safe(F.concat(F.lit("a/"), k.cast("string"), F.lit("/b"))).alias("safe"), scalars.pixel(t, EPOCH, 30 * DAY, 700).alias("pixel"),
        scalars.tsc_to_ns(t, F.lit(2), F.lit(3e9)).alias("from_tsc"), scalars.corrected_ns(t, F.lit(1.25), F.lit(17), F.lit(2), F.lit(3e9)).alias("corrected"),
    )


@on_events(f" SELECT {LISTED_SQL} FROM ev WHERE time_ns >= {T1} ORDER BY {ORDER_SQL} LIMIT 1")
def event_at_position(e):
    """The event of a bookmark, which was taken at a time."""
    return ordering.at_position(e, ordering.position_of(e, T1)).select(*LISTED)


@on_events(SWITCH_SQL + " SELECT ev.id, pt.status FROM ev LEFT JOIN pt ON pt.trace_id = ev.trace_id AND pt.pid = ev.pid AND ev.time_ns >= pt.start_ns AND ev.time_ns < coalesce(pt.end_ns, 9000000000000000000)")
def process_status_asof(e):
    """The status of an event's process in the interval that holds the event."""
    spans = timelines.run_timeline(e).select("trace_id", "pid", "status", "start_ns", F.coalesce("end_ns", F.lit(EPOCH + 400 * DAY)).alias("end_ns")).where("end_ns > start_ns")
    return pairing.interval_lookup(e, spans, ["trace_id", "pid"], "start_ns", "end_ns", ["status"], 5 * DAY).select("id", "status")


@on_events(CRITICAL_SQL + """ SELECT b.trace_id, b.pid, b.start_ns, any_value(b.end_ns) AS end_ns, any_value(b.waker) AS waker, min_by(r.start_ns, (r.end_ns, r.start_ns)) AS waker_start_ns, min(r.end_ns) AS waker_end_ns, min_by(r.status, (r.end_ns, r.start_ns)) AS waker_status
    FROM bl b LEFT JOIN (SELECT * FROM pt WHERE end_ns IS NOT NULL AND pid < 4) r ON r.trace_id = b.trace_id AND r.pid = b.waker AND r.end_ns > b.end_ns - 1 WHERE b.pid = 3 GROUP BY b.trace_id, b.pid, b.start_ns""")  # fmt: skip
def dep_wakers(e):
    """The interval of the process that woke another, the first to end after it did."""
    spans = settled(timelines.run_timeline(e), "run-timeline")
    blocked = spans.where("status = 'WAIT' and end_ns is not null and pid = 3").select("trace_id", "pid", "start_ns", "end_ns")
    gave = of_types(e, "sched_schedule").groupBy(F.col("trace_id").alias("t"), F.col("next_pid").alias("p"), F.col("time_ns").alias("at")).agg(F.min_by("pid", "id").alias("waker"))
    blocked = blocked.join(gave, (F.col("trace_id") == F.col("t")) & (F.col("pid") == F.col("p")) & (F.col("end_ns") == F.col("at")), "left").drop("t", "p", "at").withColumn("woken_ns", F.col("end_ns") - 1)
    return dependencies.wakers(blocked, spans.where("end_ns is not null and pid < 4"))


@on_events(" , pr AS (SELECT trace_id, pid, min(time_ns) AS inserted_ns FROM ev GROUP BY ALL), ut AS (SELECT id AS usertrace, pid, time_ns AS creation_ns FROM ev WHERE event_name = 'irq_entry') SELECT trace_id, pr.pid, inserted_ns, max_by(usertrace, creation_ns) AS usertrace FROM pr LEFT JOIN ut ON ut.pid = pr.pid AND creation_ns <= inserted_ns GROUP BY ALL")
def user_trace_lookup(e):
    """Interrupts stand for the traces that processes write of themselves."""
    processes = e.groupBy("trace_id", "pid").agg(F.min("time_ns").alias("inserted_ns"))
    return dependencies.user_traces(processes, of_types(e, "irq_entry").select(F.col("id").alias("usertrace"), "pid", F.col("time_ns").alias("creation_ns")))


@on_events(", nt AS (SELECT trace_id, k % 5 AS irq, max_by('dev' || pid, time_ns) AS name FROM ev WHERE event_name = 'sched_schedule' AND k % 5 < 4 GROUP BY ALL) SELECT ev.id, coalesce(name, 'irq ' || irq_id) AS irq FROM ev LEFT JOIN nt ON nt.trace_id = ev.trace_id AND nt.irq = ev.irq_id WHERE event_name = 'irq_entry'")
def irq_name_lookup(e):
    """A trace's own table of interrupts, told by its switches."""
    told = _renamed(e, {"sched_schedule": "interrupt"}).where("k % 5 < 4").withColumn("action", F.concat(F.lit("dev"), F.col("pid").cast("string")))
    return names.with_trace_names(of_types(e, "irq_entry"), names.trace_names(told, "irq"), "irq", "irq_id", "irq").select("id", "irq")


@on_events(""" , d AS (SELECT id, [8, 22, 9, 179, 5][1 + k % 5] AS major, id % 240 AS minor FROM ev) SELECT id, CASE major WHEN 8 THEN 'sd' || chr((97 + minor // 16)::INT) || CASE WHEN minor % 16 > 0 THEN (minor % 16)::VARCHAR ELSE '' END
    WHEN 22 THEN 'hd' || chr((99 + minor // 64)::INT) || CASE WHEN minor % 64 > 0 THEN (minor % 64)::VARCHAR ELSE '' END WHEN 9 THEN 'md' || minor WHEN 179 THEN 'mmcblk' || (minor // 8) || CASE WHEN minor % 8 > 0 THEN 'p' || (minor % 8) ELSE '' END ELSE '(' || major || ',' || minor || ')' END AS disk FROM d""")  # fmt: skip
def disk_names(e):
    major = F.element_at(F.array(*[F.lit(m).cast("long") for m in (8, 22, 9, 179, 5)]), (F.col("k") % 5 + 1).cast("int"))
    return e.select("id", names.disk_name(major, F.col("id") % 240).alias("disk"))


@on_events(FOLD_SQL + f""" SELECT trace_id, who AS pid, home, max_by(mode, (time_ns, tracefile_id, trace_id, block, "offset", rank)) AS mode, max_by(status, (time_ns, tracefile_id, trace_id, block, "offset", rank)) AS status, CAST(max_by(depth, (time_ns, tracefile_id, trace_id, block, "offset", rank)) AS INT) AS depth FROM st WHERE time_ns < {T2} GROUP BY ALL""")
def state_at_time(e):
    """The state of every process at a time: from the closest snapshot, and the events since."""
    own = _stated(e)
    path = f"{shared_dir(e.sparkSession)}/states-{uuid.uuid4().hex}"
    snapshots.save_states(own, path, every=1000, listed=False)
    return snapshots.state_at(own, path, T2, listed=False).select("trace_id", "pid", "home", "mode", "status", "depth")


@on_events(FOLD_SQL + CPU_SQL + " SELECT st.id, st.trace_id, st.cpu, st.time_ns, st.who AS pid, st.mode, st.sub AS submode, st.status, CAST(st.depth AS INT) AS depth, st.entry_ns, st.change_ns, cm.cpu_mode FROM st JOIN cm USING (id) WHERE role <> 'out'")
def state_after_event(e):
    """Nested modes, statuses and CPU modes after each event."""
    return fold.state_after(_stated(e), listed=False).select("id", "trace_id", "cpu", "time_ns", "pid", "mode", "submode", "status", "depth", "entry_ns", "change_ns", "cpu_mode")


@on_events(FOLD_SQL + f" SELECT id, trace_id, cpu, event_name, time_ns, who AS pid, mode, status FROM st WHERE role <> 'out' AND who < 8 AND mode = 'SYSCALL' AND status = 'RUN'")
def event_state_filter(e):
    """A filter on the state that each event is in: the running process, its mode and its status."""
    states = fold.state_after(_stated(e), listed=False)
    found = e.drop("pid").join(states.select("id", "pid", "mode", "submode", "status", F.col("name").alias("process_name"), "brand", "ppid"), "id")
    return found.where(compile_filter("state.pid < 8 & state.execution_mode = SYSCALL & state.process_status = RUN")).select("id", "trace_id", "cpu", "event_name", "time_ns", "pid", "mode", "status")


HIGH_SQL = FOLD_SQL + """, ps AS (SELECT trace_id, who AS pid, home, time_ns, tracefile_id, block, "offset" * 8 + rank AS "offset", CASE WHEN status = 'WAIT_CPU' THEN 'INTERRUPTED_CPU' WHEN status = 'WAIT' THEN 'BLOCKED' WHEN mode = 'IRQ' THEN 'INTERRUPTED_IRQ' WHEN mode = 'SYSCALL' THEN 'RUNNING' ELSE 'UNKNOWN' END AS label FROM st)"""


@on_events(HIGH_SQL + ", hl AS (" + _islands_sql("ps", "label", "trace_id, pid, home").replace(", i1 AS", "WITH i1 AS", 1) + ") SELECT trace_id, pid, home, state, start_ns, end_ns FROM hl WHERE end_ns IS NULL OR end_ns > start_ns")
def dep_high_level_states(e):
    return dependencies.high_level_states(fold.process_states(_stated(e), listed=False))


@on_events(FOLD_SQL + f""", tr AS (SELECT *, lag(depth) OVER (PARTITION BY trace_id, who, home ORDER BY {ORDER_SQL}, rank) AS was FROM st WHERE role = 'run')
    SELECT id, trace_id, CASE WHEN who = 0 THEN home + 2000000 ELSE who END AS pid, cpu, time_ns, CASE WHEN depth > coalesce(was, 1) THEN 'push' WHEN depth < coalesce(was, 1) THEN 'pop' ELSE 'ignored' END AS change,
      CASE WHEN event_name LIKE 'irq%' THEN 'IRQ' ELSE 'SYSCALL' END AS level, sub AS submode, CAST(depth AS INT) AS depth FROM tr""")  # fmt: skip
def dep_low_level_transitions(e):
    return dependencies.low_level_transitions(fold.process_states(_stated(e), listed=False))




@on_events(CRITICAL_SQL + f""" SELECT trace_id, pid, start_ns, end_ns, waker, min(depth)::INT AS depth FROM (WITH RECURSIVE path AS (
      SELECT *, 0 AS depth FROM bl WHERE pid = 3 AND end_ns > {T1} AND end_ns <= {T2} AND start_ns >= {T1}
      UNION
      SELECT b.*, p.depth + 1 FROM path p JOIN bl b ON b.trace_id = p.trace_id AND b.pid = p.waker AND b.end_ns > p.start_ns AND b.end_ns <= p.end_ns AND b.start_ns >= p.start_ns AND b.end_ns - b.start_ns < p.end_ns - p.start_ns) SELECT * FROM path) GROUP BY ALL""")  # fmt: skip
def dep_critical_path(e):
    """Whom process 3 waited for between two times, and whom those waited for; who gives way to a process wakes it."""
    blocked = timelines.run_timeline(e).where("status = 'WAIT' and end_ns is not null").select("trace_id", "pid", "start_ns", "end_ns")
    gave = of_types(e, "sched_schedule").groupBy(F.col("trace_id").alias("t"), F.col("next_pid").alias("p"), F.col("time_ns").alias("at")).agg(F.min_by("pid", "id").alias("waker"))
    links = settled(blocked.join(gave, (F.col("trace_id") == F.col("t")) & (F.col("pid") == F.col("p")) & (F.col("end_ns") == F.col("at")), "left").drop("t", "p", "at"), "blocked")
    start = links.select("trace_id").distinct().select("trace_id", F.lit(3).cast("long").alias("pid"), F.lit(T1).alias("t1"), F.lit(T2).alias("t2"))
    return dependencies.critical_path(links, start)


@on_events(SWITCH_SQL + """, d AS (SELECT *, end_ns - start_ns AS d, 'Total/' || status || '/' || cpu AS path FROM pt), n AS (SELECT trace_id, pid, d, unnest([struct_pack(node := 'Total', parent := '', depth := 1), struct_pack(node := 'Total/' || status, parent := 'Total', depth := 2), struct_pack(node := path, parent := 'Total/' || status, depth := 3)]) AS x FROM d),
    g AS (SELECT trace_id, pid, x.node AS node, x.parent AS parent, x.depth AS depth, CAST(coalesce(sum(d), 0) AS BIGINT) AS total_ns, count(*) AS n FROM n GROUP BY ALL)
    SELECT *, row_number() OVER (PARTITION BY trace_id, pid, parent ORDER BY total_ns DESC, node)::INT AS place FROM g""")  # fmt: skip
def dep_summary_sorted(e):
    return dependencies.sorted_summary(dependencies.summary_tree(_waits(e), ["trace_id", "pid"], ["status", "cpu"]), ["trace_id", "pid"])


@on_events(FOLD_SQL + " SELECT DISTINCT trace_id, who AS pid, home, 0::BIGINT AS birth_ns FROM st")
def process_list(e):
    return dependencies.process_list(fold.process_states(_stated(e), listed=False)).select("trace_id", "pid", "home", "birth_ns")


@on_events(" SELECT id, trace_id, cpu, row_number() OVER (PARTITION BY trace_id, cpu ORDER BY " + ORDER_SQL + ") AS nth FROM ev WHERE event_name = 'irq_entry'")
def interrupts_seen(e):
    return statistics.interrupts_seen(e).select("id", "trace_id", "cpu", "nth")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from tracelake.plans import sync_catalog
    from tracelake.streaming import stream_catalog

    return dict(QUERIES) | sync_catalog.QUERIES | stream_catalog.QUERIES


def oracle_sql() -> dict[str, str]:
    from tracelake.plans import sync_catalog
    from tracelake.streaming import stream_catalog

    return dict(SQL) | sync_catalog.SQL | stream_catalog.SQL


