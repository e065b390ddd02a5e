"""Names of what events carry as numbers: system calls, interrupts, soft interrupts, traps, probes, and disks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.functions.scalars import named

#: The events by which a trace tells its own tables: the field of the number, the field of the name, and what a number
#: without a name is called.
TABLES = {"syscall": ("sys_call_table", "id", "symbol"), "softirq": ("softirq_vec", "id", "symbol"), "kprobe": ("kprobe_table", "ip", "symbol"), "irq": ("interrupt", "irq_id", "action"), "trap": ("idt_table", "irq", "symbol")}

# Device numbers of the kernel's list of devices. A family of disks is its major number, the name of its
# first disk, how disks are told apart (letters, numbers, or a letter for each controller), and the minors of one disk.
DISKS = {
    1: ("ram", "number", 1), 2: ("fd", "number", 1), 3: ("hd", "letter", 64), 7: ("loop", "number", 1), 8: ("sd", "letter", 16), 9: ("md", "number", 1), 11: ("scd", "number", 1),
    22: ("hd", "letter", 64), 33: ("hd", "letter", 64), 34: ("hd", "letter", 64), 43: ("nbd", "number", 1), 56: ("hd", "letter", 64), 57: ("hd", "letter", 64), 65: ("sd", "letter", 16), 66: ("sd", "letter", 16),
    67: ("sd", "letter", 16), 68: ("sd", "letter", 16), 69: ("sd", "letter", 16), 70: ("sd", "letter", 16), 71: ("sd", "letter", 16), 179: ("mmcblk", "number", 8), 202: ("xvd", "letter", 16), 253: ("dm-", "number", 1), 254: ("vd", "letter", 16),
}
#: Where a family goes on under another major number: the place of its first disk.
FIRST_DISK = {22: 2, 33: 4, 34: 6, 56: 8, 57: 10, 65: 16, 66: 32, 67: 48, 68: 64, 69: 80, 70: 96, 71: 112}


def trace_names(events: DataFrame, kind: str) -> DataFrame:
    """(trace_id, id, name): the trace's own table of a kind, the last name told for a number."""
    event, number, name = TABLES[kind]
    return events.where(F.col("event_name") == event).groupBy("trace_id", F.col(number).cast("bigint").alias("id")).agg(F.max_by(name, "time_ns").alias("name"))


def with_trace_names(events: DataFrame, table: DataFrame, kind: str, id_col: str, name: str) -> DataFrame:
    """events with the name of a number in its own trace's table, or the kind and the number."""
    t = table.select(F.col("trace_id").alias("_t"), F.col("id").alias("_id"), F.col("name").alias("_name"))
    found = events.join(t, (F.col("trace_id") == F.col("_t")) & (F.col(id_col) == F.col("_id")), "left")
    return found.withColumn(name, named(kind, F.col(id_col), F.col("_name"))).drop("_t", "_id", "_name")


def _letters(n: Column) -> Column:
    """a to z, then aa to zz."""
    low = F.char(F.lit(97) + n % 26)
    return F.when(n < 26, low).otherwise(F.concat(F.char(F.lit(96) + F.floor(n / 26)), low))


def disk_name(major: Column, minor: Column) -> Column:
    """A block device's name from its numbers, with the partition's number for those that have partitions; (major, minor)
    for those that are in no list."""
    out = F.format_string("(%d,%d)", major.cast("long"), minor.cast("long"))
    for number, (stem, way, minors) in DISKS.items():
        disk = F.floor(minor / minors).cast("long") + FIRST_DISK.get(number, 0)
        part = F.pmod(minor.cast("long"), F.lit(minors))
        if way == "letter":
            name = F.concat(F.lit(stem), _letters(disk), F.when(part > 0, part.cast("string")).otherwise(""))
        else:
            name = F.concat(F.lit(stem), disk.cast("string"), F.when((part > 0) & F.lit(minors > 1), F.concat(F.lit("p"), part.cast("string"))).otherwise(""))
        out = F.when(major == number, name).otherwise(out)
    return out
