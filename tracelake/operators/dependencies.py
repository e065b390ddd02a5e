"""Why a process was blocked: summaries of its intervals, their wakers, and chains of wakers and parents."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelake.functions.adapter import ORDER
from tracelake.operators import blocks, fold
from tracelake.operators.timelines import islands


def summary_tree(intervals: DataFrame, keys: list[str], path: list[str], duration: str = "duration_ns") -> DataFrame:
    """Sums over every beginning of the path, 'Total' first: (keys, node, depth, total_ns, n)."""
    levels = F.concat(F.array(F.lit("Total")), F.array(*[F.col(c).cast("string") for c in path]))
    rows = intervals.withColumn("_levels", levels).withColumn("depth", F.explode(F.sequence(F.lit(1), F.lit(len(path) + 1))))
    rows = rows.withColumn("node", F.concat_ws("/", F.slice("_levels", F.lit(1), F.col("depth"))))
    return rows.groupBy(*keys, "node", "depth").agg(F.coalesce(F.sum(duration), F.lit(0)).cast("bigint").alias("total_ns"), F.count(F.lit(1)).alias("n"))


def within(intervals: DataFrame, start: int, end: int) -> DataFrame:
    """Intervals that end in [start, end]."""
    return intervals.where((F.col("end_ns") >= start) & (F.col("end_ns") <= end))


def episodes(intervals: DataFrame, keys: list[str], n: int, duration: str = "duration_ns") -> DataFrame:
    """The n longest intervals of each key, longest first: a report, so bounded."""
    w = Window.partitionBy(*keys).orderBy(F.desc(duration), "start_ns", "event_id")
    return intervals.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def critical_path(links: DataFrame, start: DataFrame, most: int = 100_000) -> DataFrame:
    """links: (trace_id, pid, start_ns, end_ns, waker), a process's blocked intervals and who ended each. start:
    (trace_id, pid, t1, t2). From a process's blocked intervals in the window to those of their wakers inside each
    interval, and so on: (trace_id, pid, start_ns, end_ns, waker, depth), each once, at its least depth.

    A waker's interval must lie within the one that it ended, and begin or end apart from it, so every step is shorter
    than the one before and the recursion ends by itself, however deep; past ``most`` steps Spark raises an error rather
    than leave anything out."""
    spark = links.sparkSession
    view = unique_view("links", links.select("trace_id", "pid", "start_ns", "end_ns", "waker"))
    begin = unique_view("begin", start.select("trace_id", "pid", "t1", "t2").distinct())
    return spark.sql(
        f"""WITH RECURSIVE path(trace_id, pid, start_ns, end_ns, waker, depth) MAX RECURSION LEVEL {most} AS (
          SELECT l.trace_id, l.pid, l.start_ns, l.end_ns, l.waker, 0 FROM {view} l JOIN {begin} s ON l.trace_id = s.trace_id AND l.pid = s.pid AND l.end_ns > s.t1 AND l.end_ns <= s.t2 AND l.start_ns >= s.t1
          UNION ALL
          SELECT l.trace_id, l.pid, l.start_ns, l.end_ns, l.waker, p.depth + 1 FROM path p JOIN {view} l
            ON l.trace_id = p.trace_id AND l.pid = p.waker AND l.end_ns > p.start_ns AND l.end_ns <= p.end_ns AND l.start_ns >= p.start_ns AND l.end_ns - l.start_ns < p.end_ns - p.start_ns
        ) SELECT trace_id, pid, start_ns, end_ns, waker, min(depth) AS depth FROM path GROUP BY trace_id, pid, start_ns, end_ns, waker"""
    )


def wakers(blocked: DataFrame, running: DataFrame) -> DataFrame:
    """blocked: (trace_id, pid, start_ns, end_ns, woken_ns, waker); running: intervals of processes. The waker's own
    interval: the first of its that ends after the wake-up."""
    r = running.select(F.col("trace_id").alias("_t"), F.col("pid").alias("_p"), F.struct("end_ns", "start_ns", "status").alias("_i"))
    keys = ["trace_id", "pid", "start_ns"]
    found = blocked.join(r, (F.col("trace_id") == F.col("_t")) & (F.col("waker") == F.col("_p")) & (F.col("_i.end_ns") > F.col("woken_ns")), "left")
    return found.groupBy(*keys).agg(F.any_value("end_ns").alias("end_ns"), F.any_value("waker").alias("waker"), F.min("_i").alias("_i")).select(*keys, "end_ns", "waker", F.col("_i.start_ns").alias("waker_start_ns"), F.col("_i.end_ns").alias("waker_end_ns"), F.col("_i.status").alias("waker_status"))


def ancestors(spark, parents: DataFrame, most: int = 100_000) -> DataFrame:
    """parents: (trace_id, pid, ppid). Every ancestor of every process with its distance, at its least. A process that is
    its own ancestor ends its chain; past ``most`` steps Spark raises an error rather than leave anything out."""
    view = unique_view("parents", parents.select("trace_id", "pid", "ppid"))
    return spark.sql(
        f"""WITH RECURSIVE up(trace_id, pid, ancestor, distance, seen) MAX RECURSION LEVEL {most} AS (
          SELECT trace_id, pid, ppid, 1, array(pid, ppid) FROM {view}
          UNION ALL
          SELECT u.trace_id, u.pid, p.ppid, u.distance + 1, array_append(u.seen, p.ppid) FROM up u JOIN {view} p ON u.trace_id = p.trace_id AND u.ancestor = p.pid WHERE u.pid <> u.ancestor AND NOT array_contains(u.seen, p.ppid)
        ) SELECT trace_id, pid, ancestor, min(distance) AS distance FROM up GROUP BY trace_id, pid, ancestor"""
    )


def unique_view(name: str, df: DataFrame) -> str:
    """A temporary view under a name that no other call takes."""
    view = f"tracelake_{name}_{uuid.uuid4().hex}"
    df.createOrReplaceTempView(view)
    return view


#: High-level states by what is on a process's stack, from the top down.
RUNNING = ("USER_MODE", "SYSCALL", "TRAP")


def high_level_states(states: DataFrame) -> DataFrame:
    """states: fold.process_states. Why each process doesn't run, or that it does, as intervals (trace_id, pid, home,
    state, start_ns, end_ns): RUNNING in user mode, calls and traps, INTERRUPTED_IRQ and INTERRUPTED_SOFTIRQ under an
    interrupt, INTERRUPTED_CPU when it was switched out with a previous state of 0, INTERRUPTED_POST_BLOCK from its
    wake-up to its next run, BLOCKED otherwise. Intervals without a length are left out."""
    mode, status = F.col("mode"), F.col("status")
    state = (
        F.when((status == "WAIT_CPU") & (F.col("event_name") == "sched_try_wakeup"), "INTERRUPTED_POST_BLOCK")
        .when(status == "WAIT_CPU", "INTERRUPTED_CPU")
        .when(status == "WAIT_FORK", "INTERRUPTED_CPU")
        .when(status.isin("WAIT", "EXIT", "ZOMBIE", "DEAD"), "BLOCKED")
        .when(mode == "IRQ", "INTERRUPTED_IRQ")
        .when(mode == "SOFT_IRQ", "INTERRUPTED_SOFTIRQ")
        .when(mode.isin(*RUNNING), "RUNNING")
        .otherwise("UNKNOWN")
    )
    # Rows of one event follow each other by role; a place of their own keeps them in order.
    rows = states.where("event_name is not null").withColumn("offset", F.col("offset") * 8 + F.create_map(*[F.lit(x) for pair in fold.ROLES.items() for x in pair])[F.col("role")])
    return islands(rows, state, "trace_id", "pid", "home").where("end_ns is null or end_ns > start_ns").drop("events")


def low_level_transitions(states: DataFrame) -> DataFrame:
    """Each push and pop of a process's stack: the event, what it put on or took off, and the depth after it. Idle tasks
    get a pid of their own for each CPU, 2000000 and up, so that a summary keeps them apart."""
    kind = F.col("event_name")
    own = states.where(kind.isin(*fold.ENTRIES, *fold.EXITS) & (F.col("role") == fold.RUN))
    own = blocks.last_values(own, ("trace_id", "pid", "home"), before={"_depth": F.col("depth")})
    change = F.col("depth") - F.coalesce("_depth", F.lit(1))
    pid = F.when(F.col("pid") == 0, F.col("home") + 2_000_000).otherwise(F.col("pid"))
    name = F.create_map(*[F.lit(x) for pair in {**fold.ENTRIES, **fold.EXITS}.items() for x in pair])[kind]
    out = own.withColumn("change", F.when(change > 0, "push").when(change < 0, "pop").otherwise("ignored"))
    return out.select("id", "trace_id", pid.alias("pid"), "cpu", "time_ns", "change", name.alias("level"), "submode", "depth")


def sorted_summary(tree: DataFrame, keys: list[str], measure: str = "total_ns") -> DataFrame:
    """Nodes of a summary under each parent, the longest first, with their place."""
    parent = F.when(F.col("depth") > 1, F.expr("substring(node, 1, length(node) - locate('/', reverse(node)))")).otherwise("")
    own = tree.withColumn("parent", parent)
    w = Window.partitionBy(*keys, "parent").orderBy(F.desc(measure), "node")
    return own.withColumn("place", F.row_number().over(w))


def process_list(states: DataFrame) -> DataFrame:
    """Every process once, in the order of the process view: pid (idle tasks by CPU), birth, trace."""
    rows = states.groupBy("trace_id", "pid", "home", "birth_ns").agg(F.max_by("name", F.struct(*ORDER)).alias("name"), F.max_by("ppid", F.struct(*ORDER)).alias("ppid"))
    return rows.orderBy("pid", "home", "birth_ns", "trace_id")


def user_traces(processes: DataFrame, traces: DataFrame) -> DataFrame:
    """processes: (trace_id, pid, inserted_ns); traces: (usertrace, pid, creation_ns). The newest user trace of the pid
    that was there when the process was met."""
    t = traces.select(F.col("pid").alias("_p"), "usertrace", "creation_ns")
    found = processes.join(t, (F.col("pid") == F.col("_p")) & (F.col("creation_ns") <= F.col("inserted_ns")), "left")
    return found.groupBy(*processes.columns).agg(F.max_by("usertrace", "creation_ns").alias("usertrace"))
