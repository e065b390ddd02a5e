"""States over time as intervals: one row from a change to the next. All of them are scans in slots (see ``blocks``)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.functions.adapter import ORDER, of_types
from tracelake.functions.tables import settled
from tracelake.operators import blocks, fold


def islands(events: DataFrame, state: Column, *keys: str) -> DataFrame:
    """Runs of equal state, in the order of events, as (keys, state, start_ns, end_ns, events); the last run of a key
    is open, end_ns null. Events whose state is null go on with the one before."""
    slim = events.select(*dict.fromkeys((*keys, *ORDER)), state.alias("_raw"), *(["_slot"] if "_slot" in events.columns else []))
    own = blocks.last_values(slim, keys, before={"_old": F.col("_raw")}, upto={"state": F.col("_raw")}).where("state is not null").drop("_raw")
    own = settled(blocks.numbered(settled(own, "states"), "_nth", keys), "numbered")
    total = own.groupBy(*keys).agg(F.count(F.lit(1)).alias("_total"))
    starts = own.where(F.col("_old").isNull() | (F.col("_old") != F.col("state")))
    runs = blocks.last_values(starts, keys, following={"end_ns": "time_ns", "_next": "_nth"})
    same = None
    for k in keys:
        total = total.withColumnRenamed(k, f"_of_{k}")
        here = F.col(k).eqNullSafe(F.col(f"_of_{k}"))
        same = here if same is None else same & here
    return runs.join(total, same).select(*keys, "state", F.col("time_ns").alias("start_ns"), "end_ns", (F.coalesce("_next", F.col("_total") + 1) - F.col("_nth")).alias("events"))


def _depth() -> Column:
    return F.col("_sum") - F.col("_low")


def cpu_timeline(events: DataFrame, listed: bool = True) -> DataFrame:
    """Modes of each CPU, the top of its own stack: idle or busy since the switch, what interrupts it, or unknown."""
    modes = fold.cpu_modes(fold.process_states(events, listed))
    return islands(modes, F.lower(F.col("cpu_mode")), "trace_id", "cpu")


def irq_timeline(events: DataFrame) -> DataFrame:
    """Busy while an interrupt of the number is open, on whatever CPU, nested ones included; unknown once the stack was
    emptied, as nothing says that the line is idle."""
    e, keys = F.col("event_name"), ("trace_id", "irq_id")
    own = blocks.depths(of_types(events, "irq_entry", "irq_exit"), F.when(e == "irq_entry", 1).otherwise(-1), keys)
    return islands(blocks.plain(own.withColumn("state", F.when(_depth() > 0, "busy").otherwise("unknown"))), F.col("state"), *keys)


def softirq_timeline(events: DataFrame) -> DataFrame:
    """Raise, entry and exit of soft interrupts: running, else pending, else idle. Pending does not add up."""
    e, keys = F.col("event_name"), ("trace_id", "softirq_id")
    own = of_types(events, "softirq_raise", "softirq_entry", "softirq_exit")
    own = blocks.depths(own, F.when(e == "softirq_entry", 1).when(e == "softirq_exit", -1).otherwise(0), keys)
    own = blocks.last_values(own, keys, upto={"_pending": F.when(e == "softirq_raise", True).when(e == "softirq_entry", False)})
    own = own.withColumn("state", F.when(_depth() > 0, "running").when(F.col("_pending"), "pending").otherwise("idle"))
    return islands(blocks.plain(own), F.col("state"), *keys)


def trap_timeline(events: DataFrame) -> DataFrame:
    e, keys = F.col("event_name"), ("trace_id", "trap_id")
    own = blocks.depths(of_types(events, "trap_entry", "trap_exit"), F.when(e == "trap_entry", 1).otherwise(-1), keys)
    return islands(blocks.plain(own.withColumn("state", F.when(_depth() > 0, "busy").otherwise("idle"))), F.col("state"), *keys)


def bdev_timeline(events: DataFrame) -> DataFrame:
    """Block requests by device, as a stack: reading or writing (direction 0 or 1) by the latest request that is open,
    unknown once the stack was emptied. The whole device number is the key."""
    e, keys = F.col("event_name"), ("trace_id", "major", "minor")
    own = blocks.depths(of_types(events, "_blk_request_issue", "_blk_request_complete"), F.when(e == "_blk_request_issue", 1).otherwise(-1), keys)
    own = own.withColumn("depth", _depth())
    issued = F.when(e == "_blk_request_issue", F.when(F.col("direction") == 0, "reading").otherwise("writing"))
    own = blocks.last_values(own, (*keys, "depth"), upto={"_top": issued})
    return islands(blocks.plain(own.withColumn("state", F.when(F.col("depth") > 0, F.col("_top")).otherwise("unknown"))), F.col("state"), *keys)


def switches(events: DataFrame) -> DataFrame:
    """Each switch as two rows: the process that leaves, with its new status, and the one that comes."""
    own = of_types(events, "sched_schedule")
    left = F.when(F.col("prev_state") == 0, "WAIT_CPU").otherwise("WAIT")
    who = F.explode(F.array(F.struct(F.lit(0).alias("turn"), F.col("pid").alias("pid"), left.alias("status")), F.struct(F.lit(1).alias("turn"), F.col("next_pid").alias("pid"), F.lit("RUN").alias("status"))))
    return own.select("trace_id", "cpu", *ORDER[:2], "block", "offset", who.alias("w")).select("trace_id", "cpu", *ORDER[:2], "block", "offset", "w.*")


def run_timeline(events: DataFrame) -> DataFrame:
    """Status of each process from a switch to its next one, from switches alone."""
    rows = switches(events).withColumn("event_id", F.col("offset")).withColumn("offset", F.col("offset") * 2 + F.col("turn"))
    found = blocks.last_values(rows, ("trace_id", "pid"), following={"end_ns": "time_ns"})
    return found.select("trace_id", "pid", "cpu", "status", F.col("time_ns").alias("start_ns"), "end_ns", "event_id", "turn")


def process_timeline(events: DataFrame, listed: bool = True) -> DataFrame:
    """The control flow view: each process (process 0 of each CPU) from a change of its state to the next. The state is
    the status, and while it runs the mode; wake-ups, forks, exits and interrupts are changes as switches are."""
    rows = fold.process_states(events, listed)
    rows = rows.withColumn("offset", F.col("offset") * 8 + F.create_map(*[F.lit(x) for pair in fold.ROLES.items() for x in pair])[F.col("role")])
    state = F.when(F.col("status") == "RUN", F.concat(F.lit("RUN "), "mode")).otherwise(F.col("status"))
    return islands(rows, state, "trace_id", "pid", "home")
