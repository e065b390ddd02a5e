"""Events as text."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.functions.adapter import ORDER
from tracelake.functions.scalars import time_text

#: Payload fields of the adapter's events, in the order they are printed, each with its marker's printf format.
FIELDS = {"syscall_entry": (("syscall_id", "%u"),), "irq_entry": (("irq_id", "%u"),), "sched_schedule": (("pid", "%u"), ("next_pid", "%u"), ("prev_state", "%lld"))}


def printf(value: Column, form: str) -> Column:
    """One value by a printf format of a marker: signed, unsigned, hexadecimal and octal numbers of any C length, with
    width and flags, pointers, characters, strings in double quotes."""
    kind = form[-1]
    flags = form[1:-1].rstrip("hlqjzt")
    if kind == "s":
        return F.concat(F.lit('"'), F.coalesce(value.cast("string"), F.lit("")), F.lit('"'))
    if kind == "p":
        return F.concat(F.lit("0x"), F.lower(F.hex(value.cast("long"))))
    if kind == "c":
        return F.char(value.cast("long"))
    if kind in "feg":
        return F.format_string(f"%{flags}{kind}", value.cast("double"))
    return F.format_string(f"%{flags}{'d' if kind in 'diu' else kind}", value.cast("long"))


def field_text(field: str, form: str, field_names: bool = True, names: Mapping[str, Column] | None = None) -> Column:
    """name = value, with [name] after a number that stands for something: names has the column of it by field."""
    text = printf(F.col(field), form)
    if names and field in names:
        text = F.concat(text, F.coalesce(F.concat(F.lit(" ["), names[field], F.lit("]")), F.lit("")))
    return F.concat(F.lit(f"{field} = "), text) if field_names else text


def payload_text(fields: Mapping[str, Sequence[tuple[str, str]]] = FIELDS, field_names: bool = True, names: Mapping[str, Column] | None = None) -> Column:
    """{ field = value, ... } by event name, with a space before it; nothing for events without fields."""
    out = F.lit("")
    for name, own in fields.items():
        text = F.concat(F.lit(" { "), F.concat_ws(", ", *[field_text(f, form, field_names, names) for f, form in own]), F.lit(" }"))
        out = F.when(F.col("event_name") == name, text).otherwise(out)
    return out


def event_lines(events: DataFrame, fields: Mapping[str, Sequence[tuple[str, str]]] = FIELDS, field_names: bool = True, process_state: bool = False, names: Mapping[str, Column] | None = None) -> DataFrame:
    """events with line: tracefile.event: sec.nsec (trace/tracefile_cpu), pid, tgid, name, brand, ppid, function, mode
    { payload } and, with process_state, the status. events has channel, the payload and the columns of
    fold.state_after, whose pid is running_pid here; a trace_name takes the place of trace and its number."""
    trace = F.col("trace_name") if "trace_name" in events.columns else F.concat(F.lit("trace"), F.col("trace_id").cast("string"))
    place = F.concat(F.lit("("), trace, F.lit("/"), F.col("channel"), F.lit("_"), F.col("cpu").cast("string"), F.lit(")"))
    head = F.concat(F.col("channel"), F.lit("."), F.col("event_name"), F.lit(": "), time_text(F.col("time_ns")), F.lit(" "), place)
    process = [F.col(c).cast("string") for c in ("running_pid", "tgid", "process_name", "brand", "ppid")]
    line = F.concat(F.concat_ws(", ", head, *process, F.concat(F.lit("0x"), F.lower(F.hex("function"))), F.col("mode")), payload_text(fields, field_names, names))
    return events.withColumn("line", F.concat(line, F.lit(" "), F.col("status"), F.lit(" ")) if process_state else line)


def with_state(events: DataFrame, states: DataFrame) -> DataFrame:
    """events with the columns of fold.state_after that a line shows."""
    shown = states.select("id", F.col("pid").alias("running_pid"), "tgid", F.col("name").alias("process_name"), "brand", "ppid", "function", "mode", "submode", "status")
    return events.drop("submode").join(shown, "id")


def detailed_rows(events: DataFrame) -> DataFrame:
    """The event list's rows: trace, tracefile, CPU, event, seconds, nanoseconds, pid, description, position."""
    return events.select(
        F.concat(F.lit("trace"), F.col("trace_id").cast("string")).alias("trace"), F.col("channel").alias("tracefile"), "cpu", F.col("event_name").alias("event"),
        F.expr("time_ns div 1000000000L").alias("sec"), F.pmod("time_ns", F.lit(1_000_000_000)).alias("nsec"), "pid", F.trim(payload_text()).alias("description"), *[F.col(c).alias(f"position_{c}") for c in ORDER],
    )


def dump(lines: DataFrame, path: str, traces: int, statistics: DataFrame | None = None, events: bool = True) -> None:
    """A text dump as a folder of text files whose names sort in the order of the text: the header, the lines in the
    global order, the footer, and the statistics' lines if they are given. events=False leaves the lines out."""
    spark, n = lines.sparkSession, F.lit(None).cast("bigint")
    edge = [F.lit(0).cast("bigint").alias(c) for c in ORDER]
    part = [spark.createDataFrame([(0, f"Trace set contains {traces} traces"), (0, ""), (2, "End trace set"), (2, "")], "part int, line string").select("part", *edge, F.monotonically_increasing_id().alias("nth"), "line")]
    if events:
        part.append(lines.select(F.lit(1).alias("part"), *[F.col(c).cast("bigint").alias(c) for c in ORDER], n.alias("nth"), "line"))
    if statistics is not None:
        part.append(statistics.select(F.lit(3).alias("part"), *edge, n.alias("nth"), "line"))
    out = part[0]
    for more in part[1:]:
        out = out.unionByName(more)
    out.orderBy("part", *ORDER, "nth", "line").select("line").write.text(path)


def tracefile_dump(events: DataFrame, path: str) -> None:
    """Each tracefile's events in its own folder and order: name, tsc, time, block and offset."""
    line = F.format_string("%s tsc=%d time=%s position=(%d, 0x%x)", "event_name", F.coalesce("tsc", F.lit(0)).cast("long") if "tsc" in events.columns else F.lit(0), time_text(F.col("time_ns")), F.col("block").cast("long"), F.col("offset").cast("long"))
    own = events.select("trace_id", "tracefile_id", "block", "offset", line.alias("line"))
    own.repartitionByRange("trace_id", "tracefile_id", "block", "offset").sortWithinPartitions("trace_id", "tracefile_id", "block", "offset").select("trace_id", "tracefile_id", "line").write.partitionBy("trace_id", "tracefile_id").text(path)
