"""Property checks: state machines per key, as scans in slots (see ``blocks``) of the last relevant event."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.functions.adapter import ORDER
from tracelake.functions.tables import settled
from tracelake.operators import blocks
from tracelake.operators.pairing import interval_lookup


def use_after_close(ops: DataFrame) -> DataFrame:
    """ops: trace_id, pid, fd, op (close, open, read, write, dup3, exit), newfd for dup3. Reads and writes of a file
    descriptor that its process last closed. dup3 opens its new descriptor; exit closes the book on all of the process's."""
    op = F.col("op")
    opened = ops.where("op = 'dup3'").withColumn("fd", F.col("newfd")).withColumn("op", F.lit("open"))
    own = ops.where("op <> 'dup3'").unionByName(opened)
    own = settled(blocks.last_values(own, ("trace_id", "pid"), before={"_exit": F.when(op == "exit", F.struct(*ORDER))}), "exits")
    last = F.when(op.isin("close", "open"), F.struct(op.alias("op"), F.struct(*ORDER).alias("at")))
    found = blocks.last_values(own.where("op <> 'exit'"), ("trace_id", "pid", "fd"), before={"_last": last})
    found = found.where(op.isin("read", "write") & (F.col("_last.op") == "close") & (F.col("_exit").isNull() | (F.col("_exit") < F.col("_last.at"))))
    return blocks.plain(found)


def open_before_chdir(ops: DataFrame) -> DataFrame:
    """ops: trace_id, pid, op (chroot, chdir, open), path. Opens after a chroot and before a chdir to the root."""
    op = F.col("op")
    state = F.when(op == "chroot", "jailed").when((op == "chdir") & (F.col("path") == "/"), "safe")
    found = blocks.last_values(ops, ("trace_id", "pid"), before={"_state": state})
    return blocks.plain(found.where((op == "open") & (F.col("_state") == "jailed")))


def late_schedules(switches: DataFrame, period_ns: int = 500_000_000, running_ns: int = 0) -> DataFrame:
    """switches: trace_id, pid, status, turn and the order. A process is late when it comes to run more than a period after it last
    came to run, and leaves early when it ran for less than it asked for."""
    came = F.when(F.col("status") == "RUN", F.col("time_ns"))
    # The two rows of a switch share a place; their turn keeps them in order.
    own = switches.withColumn("event_offset", F.col("offset")).withColumn("offset", F.col("offset") * 2 + F.col("turn"))
    own = blocks.last_values(own, ("trace_id", "pid"), before={"_last": came}).withColumn("offset", F.col("event_offset")).drop("event_offset")
    own = own.withColumn("gap_ns", F.col("time_ns") - F.col("_last"))
    kind = F.when((F.col("status") == "RUN") & (F.col("gap_ns") > period_ns), "late").when((F.col("status") != "RUN") & (F.col("gap_ns") < running_ns), "early out")
    return own.withColumn("warning", kind).where("warning is not null").transform(blocks.plain)


def lock_warnings(events: DataFrame, switches: bool = False, bucket_ns: int = 3_600_000_000_000) -> DataFrame:
    """events: trace_id, cpu, op (acquire, release, init, sched), lock, read, hardirqs_off, hardirq_context and the
    order. A lock ever taken in a hard interrupt must not be taken with interrupts on, and the other way about; a held
    lock must not be set up again. Read locks are left out. With switches, each lock that is held over a switch of its
    CPU is a warning too, on the switch's row with the lock that is held; how long a lock is held decides bucket_ns."""
    op, keys = F.col("op"), ("trace_id", "lock")
    taken = (op == "acquire") & ~F.coalesce("read", F.lit(False))
    irq, on = taken & F.col("hardirq_context"), taken & ~F.col("hardirq_context") & ~F.col("hardirqs_off")
    own = events.where(taken | op.isin("release", "init")).where("lock is not null")
    # How often each CPU holds each lock: a release of what isn't held is left out.
    held = blocks.depths(own.where(op != "init"), F.when(taken, 1).otherwise(-1), ("trace_id", "cpu", "lock"))
    held = settled(held.where(taken | (F.col("_low") >= F.col("_was"))).withColumn("depth", F.col("_sum") - F.col("_low")), "held-locks")
    count = blocks.plain(held).withColumn("_step", F.when(taken, 1).otherwise(-1)).unionByName(own.where(op == "init"), allowMissingColumns=True)
    count = blocks.running_sum(count, F.coalesce("_step", F.lit(0)), "held", keys)
    again = count.where((op == "init") & (F.col("held") > 0)).withColumn("warning", F.lit("set up again while it is held"))
    seen = blocks.last_values(own.where(taken), keys, before={"_irq": F.when(irq, True), "_on": F.when(on, True)})
    mixed = F.when(irq & F.col("_on"), "taken in an interrupt, and before with interrupts on").when(on & F.col("_irq"), "taken with interrupts on, and before in an interrupt")
    wrong = seen.withColumn("warning", mixed).where("warning is not null")
    shown = ("trace_id", "cpu", "time_ns", "offset", "lock", "warning")
    out = again.select(*shown).unionByName(wrong.select(*shown))
    if not switches:
        return out
    spans = blocks.plain(held).withColumn("level", F.col("depth") + F.when(taken, 0).otherwise(1))
    spans = blocks.plain(blocks.last_values(spans, ("trace_id", "cpu", "lock", "level"), following={"released_ns": "time_ns", "released": "offset"})).where(taken)
    end = events.agg(F.max("time_ns").alias("last_ns"))
    spans = spans.join(F.broadcast(end)).select("trace_id", "cpu", F.col("lock").alias("held_lock"), F.struct("time_ns", "offset").alias("taken"), F.struct(F.col("released_ns").alias("time_ns"), F.col("released").alias("offset")).alias("released"), F.col("time_ns").alias("held_from"), (F.coalesce("released_ns", "last_ns") + 1).alias("held_to"))
    over = interval_lookup(events.where("op = 'sched'").drop("lock"), spans, ["trace_id", "cpu"], "held_from", "held_to", ["held_lock", "taken", "released"], bucket_ns).where("held_lock is not null")
    here = F.struct("time_ns", "offset")
    over = over.where((here > F.col("taken")) & (F.col("released.time_ns").isNull() | (here < F.col("released"))))
    return out.unionByName(over.select("trace_id", "cpu", "time_ns", "offset", F.col("held_lock").alias("lock"), F.lit("held over a switch").alias("warning")).distinct())
