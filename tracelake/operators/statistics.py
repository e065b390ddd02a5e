"""Counts, times, roll-ups, interrupt and disk reports, histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.functions.adapter import in_time, of_types
from tracelake.functions.scalars import process_key
from tracelake.operators import blocks, fold

#: What a leaf of the statistics stands for, from the trace down. The roll-ups take the beginnings of it.
LEAF = ("trace_id", "pid", "birth_ns", "cpu", "function", "mode", "submode")
TIMES = ("cpu_time_ns", "elapsed_ns", "cumulative_ns")
MEASURES = (*TIMES, "events")


def event_counts(events: DataFrame, *by: str) -> DataFrame:
    return events.groupBy(*by).agg(F.count(F.lit(1)).alias("events"))


def _leaves(states: DataFrame) -> DataFrame:
    """One row for each leaf that an event adds to, of fold.process_states: the event is counted where its process is
    once it was applied, and the times where it was before."""
    counted = F.struct(*[F.col(c).alias(c) for c in LEAF[1:]], "event_name", F.lit(1).alias("events"), *[F.lit(None).cast("bigint").alias(c) for c in TIMES])
    spent = F.struct(
        F.col("pid"), F.col("leaf_birth").alias("birth_ns"), F.col("cpu"), F.col("leaf_function").alias("function"), F.col("leaf_mode").alias("mode"), F.col("leaf_submode").alias("submode"), F.lit(None).cast("string").alias("event_name"), F.lit(0).alias("events"), *TIMES
    )
    adds = F.array_compact(F.array(F.when(F.col("role").isin(fold.RUN, fold.IN), counted), F.when(F.col("cpu_time_ns").isNotNull(), spent)))
    return states.select("trace_id", F.explode(adds).alias("x")).select("trace_id", "x.*")


def _sums() -> list[Column]:
    return [*[F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in TIMES], F.sum("events").cast("bigint").alias("events")]


def mode_stats(events: DataFrame, listed: bool = True, end_ns: int | None = None) -> DataFrame:
    """CPU time, elapsed time, cumulative CPU time and events of each leaf: process (pid and birth), CPU, function, mode
    and submode. Modes that are open when the trace ends count to end_ns if it is given."""
    return _leaves(fold.process_states(events, listed, end_ns)).groupBy(*LEAF).agg(*_sums())


def event_type_stats(events: DataFrame, listed: bool = True) -> DataFrame:
    """Events of each type in each leaf."""
    return _leaves(fold.process_states(events, listed)).where("events > 0").groupBy(*LEAF, "event_name").agg(F.sum("events").cast("bigint").alias("events"))


#: The levels of the sums: each beginning of a leaf, the CPUs of a trace, the trace, and all traces together.
LEVELS = {"submode": LEAF, "mode": LEAF[:6], "function": LEAF[:5], "process_cpu": LEAF[:4], "process": LEAF[:3], "trace_cpu": ("trace_id", "cpu"), "trace": ("trace_id",), "traceset": ()}


def stats_rollup(stats: DataFrame) -> DataFrame:
    """Sums of leaves at every level, with the level's name."""
    sets = [[F.col(c) for c in own] for own in LEVELS.values()]
    out = stats.groupingSets(sets, *[F.col(c) for c in LEAF]).agg(*_sums(), F.grouping_id(*[F.col(c) for c in LEAF]).alias("_set"))
    level = F.lit(None).cast("string")
    for name, own in LEVELS.items():
        level = F.when(F.col("_set") == sum(1 << len(LEAF) - 1 - k for k, c in enumerate(LEAF) if c not in own), name).otherwise(level)
    return out.withColumn("level", level).drop("_set")


def stats_paths(stats: DataFrame) -> DataFrame:
    """Statistics as lines that can be searched: /trace/process/CPU/function/mode/submode/measure: value."""
    metric = F.explode(F.array(*[F.struct(F.lit(n).alias("m"), F.col(c).alias("v")) for n, c in (("cpu_time", TIMES[0]), ("elapsed_time", TIMES[1]), ("cumulative_cpu_time", TIMES[2]), ("events_count", "events"))]))
    path = F.concat_ws("/", F.lit(""), F.concat(F.lit("trace"), F.col("trace_id").cast("string")), process_key(F.col("pid"), F.col("birth_ns")), F.col("cpu").cast("string"), F.concat(F.lit("0x"), F.hex("function")), "mode", "submode", F.col("x.m"))
    return stats.withColumn("x", metric).select(F.concat(path, F.lit(": "), F.col("x.v").cast("string")).alias("line"))


def stats_tree(stats: DataFrame) -> DataFrame:
    """The same as an indented tree, a row per line, in the order of ``path``. Columns of LEAF that stats lacks are no
    levels."""
    levels = [c for c in LEAF if c in stats.columns]
    measures = [c for c in MEASURES if c in stats.columns]
    paths = F.transform(F.sequence(F.lit(1), F.lit(len(levels))), lambda n: F.slice(F.array(*[F.col(c).cast("string") for c in levels]), F.lit(1), n))
    rows = stats.select(F.explode(paths).alias("path"), *measures).groupBy("path").agg(*[F.sum(c).alias(c) for c in measures])
    return rows.withColumn("line", F.concat(F.expr("repeat('  ', size(path) - 1)"), F.element_at("path", -1))).orderBy("path")


def traceset_tree(stats: DataFrame) -> DataFrame:
    """The statistics report: the tree of all traces together, then that of each trace, with the tree's name."""
    of_all = stats.groupBy(*LEAF[1:]).agg(*[F.sum(c).alias(c) for c in MEASURES])
    total = stats_tree(of_all).withColumn("tree", F.lit("traceset"))
    each = stats_tree(stats).withColumn("tree", F.concat(F.lit("/trace"), F.col("path")[0]))
    return total.unionByName(each).orderBy(F.col("tree") != "traceset", "tree", "path")


def _squares(value: Column) -> list[Column]:
    return [F.sum(value.cast("double")).alias("s1"), F.sum(value.cast("double") * value).alias("s2")]


def irq_statistics(pairs: DataFrame, start: int | None = None, end: int | None = None) -> DataFrame:
    """pairs: brackets of interrupts with irq_id, time_ns, end_ns. Durations of each interrupt; its frequency over the
    window, which is the whole of pairs if none is given; deviations of durations from their mean, from the period and,
    as the report has it, from the frequency. The window is a sum over the interrupts' own rows, so pairs are read once."""
    done = pairs.where("end_ns is not null").withColumn("d", F.col("end_ns") - F.col("time_ns"))

    def pick(f, best: Column) -> Column:
        return f(F.struct(F.col("time_ns").alias("a"), F.col("end_ns").alias("b")), F.struct("d", best, "id"))

    base = done.groupBy("irq_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("d").cast("bigint").alias("total_ns"), F.max("d").alias("max_ns"), F.min("d").alias("min_ns"), F.min("time_ns").alias("lo"), F.max("end_ns").alias("hi"),
        pick(F.max_by, -F.col("time_ns")).alias("longest"), pick(F.min_by, F.col("time_ns")).alias("shortest"), F.min_by("cpu", F.struct("time_ns", "id")).alias("first_cpu"), *_squares(F.col("d")), F.stddev_pop("d").alias("sd"),
    )
    # One row for each interrupt line: the whole table is as long as the machine has lines.
    every = Window.partitionBy()
    low = F.min("lo").over(every) if start is None else F.lit(start)
    high = F.max("hi").over(every) if end is None else F.lit(end)
    base = base.withColumn("width", F.greatest(high - low, F.lit(1)))
    hz = F.floor(F.col("n") * F.lit(1e9) / F.col("width")).cast("bigint")
    period = F.when(F.col("hz") > 0, F.floor(F.lit(1e9) / F.col("hz"))).otherwise(0).cast("bigint")

    def off(x: Column) -> Column:
        return F.floor(F.sqrt(F.greatest((F.col("s2") - 2 * x * F.col("s1") + F.col("n") * x * x) / F.col("n"), F.lit(0.0)))).cast("bigint")

    return (
        base.withColumn("hz", hz).withColumn("period_ns", period)
        .select(
            "irq_id", "first_cpu", "n", "total_ns", "max_ns", "min_ns", F.col("longest.a").alias("max_start_ns"), F.col("longest.b").alias("max_end_ns"), F.col("shortest.a").alias("min_start_ns"), F.col("shortest.b").alias("min_end_ns"),
            F.expr("total_ns div n").alias("avg_ns"), "hz", "period_ns", F.floor("sd").cast("bigint").alias("duration_sd"), off(F.col("period_ns").cast("double")).alias("period_sd"), off(F.col("hz").cast("double")).alias("hz_sd"),
        )
    )


def disk_performance(operations: DataFrame, window_ns: int) -> DataFrame:
    """operations: disk, op ('read' or 'write'), bytes."""

    def of(op: str) -> Column:
        return F.col("op") == op

    def per(c: str) -> Column:
        # A billion times the bytes may exceed a bigint, though the quotient doesn't.
        return F.call_function("div", F.col(c).cast("decimal(19,0)") * F.lit(1_000_000_000).cast("decimal(10,0)"), F.lit(window_ns).cast("decimal(19,0)"))

    sums = operations.groupBy("disk").agg(
        F.coalesce(F.sum(F.when(of("read"), F.col("bytes"))), F.lit(0)).cast("bigint").alias("bytes_read"), F.count_if(of("read")).alias("reads"),
        F.coalesce(F.sum(F.when(of("write"), F.col("bytes"))), F.lit(0)).cast("bigint").alias("bytes_written"), F.count_if(of("write")).alias("writes"),
    )
    return sums.withColumn("read_per_s", per("bytes_read")).withColumn("written_per_s", per("bytes_written"))


def density_histogram(events: DataFrame, start: int, end: int, bins: int) -> DataFrame:
    """Events in each of equal bins of [start, end), empty bins included. Bins are exact integer division."""
    counts = in_time(events, start, end).groupBy(F.expr(f"(time_ns - {start}L) * {bins}L div {end - start}L").alias("bin")).agg(F.count(F.lit(1)).alias("events"))
    every = events.sparkSession.range(bins).select(F.col("id").alias("bin"))
    return every.join(counts, "bin", "left").select("bin", F.coalesce("events", F.lit(0)).alias("events"))


def cpu_usage(timeline: DataFrame, start: int, end: int, bins: int) -> DataFrame:
    """Busy time of each CPU in each bin, from intervals (trace_id, cpu, state, start_ns, end_ns); an open interval
    goes on to the end. An interval gives a row for each bin it touches."""
    width = -(-(end - start) // bins)
    own = timeline.withColumn("end_ns", F.coalesce("end_ns", F.lit(end)))
    own = own.where((F.col("state") != "idle") & (F.col("end_ns") > start) & (F.col("start_ns") < end))
    own = own.withColumn("a", F.greatest("start_ns", F.lit(start)) - start).withColumn("b", F.least("end_ns", F.lit(end)) - start).where("b > a")
    own = own.withColumn("bin", F.explode(F.sequence(F.expr(f"a div {width}L"), F.expr(f"(b - 1) div {width}L"))))
    part = F.least(F.col("b"), (F.col("bin") + 1) * width) - F.greatest(F.col("a"), F.col("bin") * width)
    return own.groupBy("trace_id", "cpu", "bin").agg(F.sum(part).cast("bigint").alias("busy_ns"))


def interrupts_seen(events: DataFrame) -> DataFrame:
    """Interrupts with their number on each CPU."""
    return blocks.plain(blocks.numbered(of_types(events, "irq_entry"), "nth", ("trace_id", "cpu")))


def lost_events(index: DataFrame) -> DataFrame:
    """Events that each tracefile lost, from the index of its blocks: the count goes on from block to block, so the last
    one is the file's, and the files' are added."""
    each = index.groupBy("trace_id", "tracefile_id").agg(F.max_by("events_lost", "block").alias("lost"))
    return each.rollup("trace_id", "tracefile_id").agg(F.sum("lost").alias("lost"))
