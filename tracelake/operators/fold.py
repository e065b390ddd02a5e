"""The state of processes and CPUs event by event, with nested modes, forks, exits, names and function stacks.

The process is the unit. Each event goes to the processes that it touches: the one that runs on its CPU (a scan in
slots of time, see ``blocks``), the one that comes to run there, and the one that it names (a wake-up, a fork, an exit).
Each process's events are then read in order, apart from all others; a task holds one stack. What crosses processes is
looked up before or after: who runs where, the end of the kernel's list of processes, and the name that a child takes
over from its parent. CPU modes need only the events since the last switch.

Rules: an exit event whose mode isn't on top of the process's stack, or that would empty it, is ignored. Process 0 is one
per CPU and makes no calls. A pid seen without its fork has an unknown mode and is born at time 0. A process goes once it
was both freed and scheduled out dead, in either order. A CPU's stack that would be emptied has an unknown base.

Times follow the events that change or end a mode, before they are applied: the time since the last change while the
process runs in a known mode is CPU time of its leaf (process, CPU, function, mode, submode); an exit event adds the time
since the mode was entered to the elapsed time, and the CPU time that the mode has collected to the cumulative one. An
exit that is ignored counts too, and leaves what it counted to be counted again, as the reference semantics have it.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.functions.adapter import ORDER
from tracelake.functions.tables import settled
from tracelake.operators import blocks

#: Names of modes and statuses, and the kernel's two states of the dead.
UNKNOWN, NONE, UNNAMED, KERNEL_THREAD = "MODE_UNKNOWN", "NONE", "UNNAMED", "KERNEL_THREAD"
ENTRIES = {"syscall_entry": "SYSCALL", "trap_entry": "TRAP", "page_fault_entry": "TRAP", "page_fault_nosem_entry": "TRAP", "irq_entry": "IRQ", "softirq_entry": "SOFT_IRQ"}
EXITS = {"syscall_exit": "SYSCALL", "trap_exit": "TRAP", "page_fault_exit": "TRAP", "page_fault_nosem_exit": "TRAP", "irq_exit": "IRQ", "softirq_exit": "SOFT_IRQ"}
TARGETED = ("sched_try_wakeup", "process_fork", "kthread_create", "process_exit", "process_free", "process_state")
DEAD_STATES = (32, 64)

#: What an event may have besides its place; a column that no event has may be missing.
STRINGS = ("event_name", "submode", "name", "kind")
NUMBERS = ("id", "prev_pid", "next_pid", "prev_state", "target_pid", "parent_pid", "tgid", "address", "snapshot")
#: The roles in which a process meets an event, in the order in which they apply.
START, OUT, TARGET, RUN, IN, END = "start", "out", "target", "run", "in", "end"
ROLES = {START: -1, OUT: 0, TARGET: 1, END: 2, RUN: 3, IN: 4}

SCHEMA = (
    "id long, role string, event_name string, trace_id long, cpu long, time_ns long, tracefile_id long, block long, offset long, pid long, home long, birth_ns long, inserted_ns long, ppid long, tgid long, name string, brand string, origin long, kind string, "
    "mode string, submode string, status string, depth int, function long, entry_ns long, change_ns long, known int, leaf_birth long, leaf_function long, leaf_mode string, leaf_submode string, cpu_time_ns long, elapsed_ns long, cumulative_ns long, target_pid long, stack string, snapshot long"
)
_TYPES = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}


@dataclass(slots=True)
class Level:
    mode: str
    submode: str
    entry: int
    change: int
    status: str
    spent: int = 0


@dataclass
class Process:
    """A process's life. name and brand are None where they are its parent's at the fork, whose event is ``origin``."""

    pid: int
    stack: list[Level]
    birth: int
    inserted: int
    ppid: int = 0
    tgid: int = 0
    name: str | None = UNNAMED
    brand: str | None = ""
    origin: int | None = None
    kind: str = "USER_THREAD"
    frees: int = 0
    functions: list[int] = field(default_factory=list)
    #: Levels and functions that nothing has touched since the process was last told; only the top ones ever change.
    same: int = 0
    same_functions: int = 0

    @property
    def top(self) -> Level:
        return self.stack[-1]

    def touched(self) -> None:
        self.same, self.same_functions = min(self.same, len(self.stack) - 1), min(self.same_functions, len(self.functions))

    def text(self, whole: bool = True) -> str:
        """All that a snapshot needs besides the columns: levels, functions, and how often the process ended. If not whole,
        levels and functions from those on that have changed since the last text, and how many stay before them."""
        at, functions = (0, 0) if whole else (self.same, self.same_functions)
        self.same, self.same_functions = len(self.stack), len(self.functions)
        own = [[[x.mode, x.submode, x.entry, x.change, x.status, x.spent] for x in self.stack[at:]], self.functions[functions:], self.frees]
        return json.dumps(own if whole else [*own, at, functions])


def resolve(p: Process, t: int) -> None:
    """What is still unknown of a process once the kernel's list ends: its threads were waiting in a call, and so were
    other processes that have no other mode, on top of user mode, unless they wait for a CPU."""
    bottom = p.stack[0]
    if bottom.mode != UNKNOWN:
        return
    kernel = p.kind == KERNEL_THREAD
    p.same = 0
    bottom.mode, bottom.submode, bottom.entry, bottom.change = "SYSCALL" if kernel else "USER_MODE", NONE, t, t
    if bottom.status == UNNAMED:
        bottom.status = "WAIT" if kernel else "RUN"
    if not kernel and len(p.stack) == 1 and bottom.status != "WAIT_CPU":
        p.stack.append(Level("SYSCALL", NONE, t, t, "WAIT"))


class Follow:
    """One pid (of one CPU if it is 0) through its events."""

    def __init__(self, pid: int) -> None:
        self.pid = pid
        self.known: Process | None = None
        self.running: Process | None = None
        self.last_cpu = 0
        self.changed = 0

    def found(self, t: int) -> Process:
        """The process, made up if none is known."""
        if self.known is None:
            self.known = Process(self.pid, [Level(UNKNOWN, NONE, t, t, UNNAMED)], 0, t)
            self.changed += 1
        return self.known

    def left(self, p: Process) -> bool:
        """Counts one of the two ends of a process; whether it was the second."""
        p.frees += 1
        if p.frees > 1 and self.known is p:
            self.known = None
            self.changed -= 1
        return p.frees > 1

    def restore(self, saved: dict) -> None:
        """The process as a snapshot has it."""
        if saved["known"] < 0:
            return
        levels, functions, frees = json.loads(saved["stack"])
        p = self.known = Process(self.pid, [Level(*x) for x in levels], saved["birth_ns"], saved["inserted_ns"], saved["ppid"], saved["tgid"], saved["name"], saved["brand"], None, saved["kind"], frees, functions)
        self.last_cpu = saved["cpu"]
        if p.top.status == "RUN":
            self.running = p

    def apply(self, e: dict) -> tuple[Process | None, tuple | None]:
        """The process after the event, and the leaf and times that the event adds to."""
        role, t, kind = e["role"], e["time_ns"], e["event_name"]
        self.changed = 0
        if role == OUT:
            p = self.running or self.found(t)
            added = self.spent(p, t, False)
            self.switched_out(p, e, t)
            self.running = None
            return p, added
        if role == IN:
            p = self.running = self.found(t)
            p.top.status, p.top.change, self.last_cpu = "RUN", t, e["cpu"]
            return p, None
        if role == RUN:
            if self.running is None:
                self.running = self.found(t)
            p, added, self.last_cpu = self.running, None, e["cpu"]
            if kind in ENTRIES or kind == "function_entry":
                added = self.spent(p, t, False)
            elif kind in EXITS or kind == "function_exit":
                added = self.spent(p, t, True)
            self.ran(p, e, kind, t)
            return p, added
        if role == END:
            if self.known:
                resolve(self.known, t)
            return self.known, None
        return self.named(e, kind, t), None

    def spent(self, p: Process, t: int, ends: bool) -> tuple:
        top = p.top
        counted = top.mode != UNKNOWN
        delta = t - top.change if counted and top.status == "RUN" else 0
        top.spent += delta
        return (p.birth, p.functions[-1] if p.functions else 0, top.mode, top.submode, delta, (t - top.entry if counted else 0) if ends else None, top.spent if ends else None)

    def ran(self, p: Process, e: dict, kind: str, t: int) -> None:
        if kind in ENTRIES:
            if ENTRIES[kind] != "SYSCALL" or p.pid != 0:
                p.stack.append(Level(ENTRIES[kind], e["submode"] or NONE, t, t, p.top.status))
        elif kind in EXITS:
            if (EXITS[kind] != "SYSCALL" or p.pid != 0) and p.top.mode == EXITS[kind] and len(p.stack) > 1:
                p.stack.pop()
                p.top.change = t
        elif kind == "exec":
            p.name, p.brand = e["name"] or UNNAMED, ""
        elif kind == "thread_brand":
            p.brand = e["name"] or ""
        elif kind == "function_entry" and e["address"] is not None:
            p.functions.append(e["address"])
        elif kind == "function_exit" and p.functions and p.functions[-1] == e["address"]:
            p.functions.pop()

    def switched_out(self, p: Process, e: dict, t: int) -> None:
        top, state = p.top, e["prev_state"]
        if p.pid == 0 and top.mode == UNKNOWN:
            # Process 0 leaves for the first time: it was waiting in the kernel, unless another is said to leave.
            if not e["prev_pid"]:
                top.mode, top.status, top.entry, top.change = "SYSCALL", "WAIT", t, t
            return
        top.status = "ZOMBIE" if top.status == "EXIT" else "WAIT_CPU" if state == 0 else "WAIT"
        top.change = t
        if state in DEAD_STATES and not self.left(p):
            top.status = "DEAD"

    def named(self, e: dict, kind: str, t: int) -> Process | None:
        """Events about a process that may run elsewhere or not at all."""
        if kind == "sched_try_wakeup":
            p = self.found(t)
            p.top.status, p.top.change = "WAIT_CPU", t
        elif kind == "process_fork":
            if self.known is None:
                self.known = Process(self.pid, [Level("USER_MODE", NONE, t, t, "RUN"), Level("SYSCALL", NONE, t, t, "WAIT_FORK")], t, t)
                self.changed += 1
            p = self.known
            p.ppid, p.name, p.brand, p.origin = e["ran"], None, None, e["id"]
            p.tgid = p.tgid if e["tgid"] is None else e["tgid"]
        elif kind == "kthread_create":
            p = self.found(t)
            if p.top.status != "DEAD":
                del p.stack[1:]
                p.stack[0].mode = "SYSCALL"
            p.kind = KERNEL_THREAD
        elif kind == "process_exit" and self.known:
            self.known.top.status = "EXIT"
        elif kind == "process_free" and self.known:
            p = self.known
            self.left(p)
            return p
        elif kind == "process_state":
            self.listed(e, t)
        return self.known

    def listed(self, e: dict, t: int) -> None:
        """A line of the kernel's list of processes, written while it runs."""
        p = self.known
        if self.pid == 0:
            p = self.found(t)
            p.ppid = e["parent_pid"] or 0
        elif p is None:
            p = self.known = Process(self.pid, [Level(UNKNOWN, "UNKNOWN", t, t, UNNAMED)], t if e["parent_known"] else 0, t)
            p.ppid = e["parent_pid"] if e["parent_known"] else 0
            self.changed += 1
        else:
            p.ppid = e["parent_pid"] or 0
        p.name, p.brand = e["name"] or UNNAMED, p.brand or ""
        p.kind = KERNEL_THREAD if self.pid == 0 else e["kind"] or p.kind
        p.tgid = e["tgid"] or 0

    def stalled(self, end: int | None) -> list[tuple]:
        """At the end of a trace: the leaves of modes that are still open and have collected CPU time. Each level's
        time goes to the one below; with an end time each is ended there."""
        out, nested = [], 0
        if self.known is None:
            return out
        p = self.known
        while p.stack:
            top = p.top
            top.spent += nested
            if top.spent:
                leaf = (p.birth, p.functions[-1] if p.functions else 0, top.mode, top.submode)
                if end is not None:
                    counted = top.mode != UNKNOWN
                    delta = end - top.change if counted and top.status == "RUN" else 0
                    top.spent += delta
                    out.append((*leaf, delta, end - top.entry if counted else 0, top.spent))
                nested = top.spent
            p.stack.pop()
            if end is not None and p.stack:
                p.top.change = end
        return out


def touched(events: DataFrame, running: DataFrame | None = None) -> DataFrame:
    """Rows of (event, process that it touches): role, pid, home (the CPU if the pid is 0, else -1), and ran, the pid
    that ran on the event's CPU before it. running says what ran on each CPU at the start: (trace_id, cpu, pid)."""
    numbers = [(F.col(c) if c in events.columns else F.lit(None)).cast("long").alias(c) for c in NUMBERS]
    strings = [(F.col(c) if c in events.columns else F.lit(None)).cast("string").alias(c) for c in STRINGS]
    own = events.select(*numbers, *strings, "cpu", *ORDER)
    switch = F.col("event_name") == "sched_schedule"
    own = blocks.last_values(own, ("trace_id", "cpu"), before={"ran": F.when(switch, F.coalesce("next_pid", F.lit(0).cast("long")))}).drop("_slot")
    if running is not None:
        first = running.select(F.col("trace_id").alias("_t"), F.col("cpu").alias("_c"), F.col("pid").alias("_first"))
        own = own.join(F.broadcast(first), (F.col("trace_id") == F.col("_t")) & (F.col("cpu") == F.col("_c")), "left").withColumn("ran", F.coalesce("ran", "_first")).drop("_t", "_c", "_first")
    own = own.withColumn("ran", F.coalesce("ran", F.lit(0).cast("long")))

    def met(role: str, pid: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), pid.alias("pid"), F.when(pid == 0, F.col("cpu")).otherwise(F.lit(-1).cast("long")).alias("home"))

    named = F.col("event_name").isin(*TARGETED) & F.col("target_pid").isNotNull() & ~((F.col("event_name") == "process_state") & (F.col("target_pid") == 0))
    meets = F.array_compact(F.array(F.when(switch, met(OUT, F.col("ran"))), F.when(named, met(TARGET, F.col("target_pid"))), F.when(~switch, met(RUN, F.col("ran"))), F.when(switch, met(IN, F.coalesce("next_pid", F.lit(0).cast("long"))))))
    return own.withColumn("x", F.explode(meets)).select("*", "x.*").drop("x")


def _to_all(rows: DataFrame) -> DataFrame:
    """What concerns processes that the event doesn't name: process 0 of every CPU, and all at the end of the list.
    There are few such events, one list to a trace."""
    keys = rows.select(F.col("trace_id").alias("_t"), F.col("pid").alias("_p"), F.col("home").alias("_h")).distinct()
    kind = F.col("event_name")
    wide = rows.where((F.col("role") == RUN) & ((kind == "statedump_end") | ((kind == "process_state") & (F.col("target_pid") == 0))))
    wide = wide.drop("pid", "home", "role").join(keys, F.col("trace_id") == F.col("_t")).where((kind == "statedump_end") | (F.col("_p") == 0))
    return wide.withColumns({"pid": F.col("_p"), "home": F.col("_h"), "role": F.when(kind == "statedump_end", END).otherwise(TARGET)}).drop("_t", "_p", "_h")


def _parents_known(rows: DataFrame) -> DataFrame:
    """Whether the parent that the list names was met before: its first row comes earlier."""
    first = rows.groupBy(F.col("trace_id").alias("_t"), F.col("pid").alias("_p")).agg(F.min(F.struct(*ORDER)).alias("_first"))
    listed = F.col("event_name") == "process_state"
    lines = rows.where(listed & (F.col("role") == TARGET)).join(first, (F.col("trace_id") == F.col("_t")) & (F.col("parent_pid") == F.col("_p")), "left")
    lines = lines.withColumn("parent_known", F.coalesce(F.col("_first") < F.struct(*ORDER), F.lit(False))).drop("_t", "_p", "_first")
    return rows.where(~(listed & (F.col("role") == TARGET))).withColumn("parent_known", F.lit(False)).unionByName(lines)


def _saved(start: DataFrame, rows: DataFrame) -> DataFrame:
    """Processes of a snapshot as rows before all events."""
    kept = ("birth_ns", "inserted_ns", "ppid", "tgid", "name", "brand", "kind", "stack", "cpu", "known")
    saved = F.to_json(F.struct(*[c for c in kept if c in start.columns]), {"ignoreNullFields": "false"})
    least = {"time_ns": F.lit(-(1 << 62)), **{c: F.lit(0) for c in ORDER if c not in ("time_ns", "trace_id")}}
    own = start.select("trace_id", "pid", "home", saved.alias("saved"), F.lit(START).alias("role"), *[v.cast("long").alias(c) for c, v in least.items()])
    missing = [F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema.fields if f.name not in own.columns]
    return own.select("*", *missing)


def process_states(events: DataFrame, listed: bool = True, end_ns: int | None = None, start: DataFrame | None = None, running: DataFrame | None = None, stacks: bool = False) -> DataFrame:
    """SCHEMA: each process after each event that touches it, and the leaf and times that the event added to before it
    was applied. known is by how much the event changed the number of known processes. listed says whether the trace may
    hold the kernel's list of processes. At the end of each process come rows of role ``stalled``, without an event, for
    modes that never ended, if end_ns is given. start holds processes that are known before the first event, and
    running what runs on each CPU then, as ``snapshots`` saves them; stacks adds what a snapshot needs to the last row
    of each process before a snapshot, whose number is the events' column of that name, if there is one; of a process that
    was told before, only what has changed since (``snapshots`` puts the parts together)."""
    rows = settled(touched(events, running), "touched")
    rows = _parents_known(rows.unionByName(_to_all(rows))) if listed else rows.withColumn("parent_known", F.lit(False))
    if start is not None:
        rows = rows.withColumn("saved", F.lit(None).cast("string")).unionByName(_saved(start, rows))
    else:
        rows = rows.withColumn("saved", F.lit(None).cast("string"))
    rank = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])[F.col("role")]
    schema = pa.schema([(n, _TYPES[t]) for n, t in (c.split() for c in SCHEMA.split(", "))])

    def run(batches):
        key, follow, state, last = None, None, None, None  # last: the row before, whose stack is told if it is the last of its snapshot
        before = None  # the process that was told last, if it is of this key

        def stalled():
            for birth, function, mode, submode, spent, elapsed, cumulative in follow.stalled(end_ns) if follow is not None and end_ns is not None else ():
                p = (None, "stalled", None, key[0], follow.last_cpu, end_ns, None, None, None, key[1], key[2], *[None] * 8, *[None] * 7, 0)
                yield (*p, birth, function, mode, submode, spent, elapsed, cumulative, None, None, None)

        def told(out):
            nonlocal before
            if last is not None:
                out.append((*last[:-2], state.text(state is not before) if stacks else None, last[-1]))
                before = state

        for batch in batches:
            out = []
            for e in batch.to_pylist():
                here = (e["trace_id"], e["pid"], e["home"])
                if last is not None and (here != key or e["snapshot"] != last[-1]):
                    told(out)
                    last = None
                if here != key:
                    out.extend(stalled())
                    key, follow, before = here, Follow(e["pid"]), None
                if e["role"] == START:
                    follow.restore(json.loads(e["saved"]))
                    continue
                if last is not None:
                    out.append(last)
                    last = None
                for x in (follow.known, follow.running):
                    if x is not None:
                        x.touched()
                p, added = follow.apply(e)
                if p is None:
                    continue
                p.touched()
                top = p.stack[-1]
                state = p
                last = (
                    e["id"], e["role"], e["event_name"], e["trace_id"], e["cpu"], e["time_ns"], e["tracefile_id"], e["block"], e["offset"], e["pid"], e["home"], p.birth, p.inserted, p.ppid, p.tgid, p.name, p.brand, p.origin, p.kind,
                    top.mode, top.submode, top.status, len(p.stack), p.functions[-1] if p.functions else 0, top.entry, top.change, follow.changed, *(added or (None,) * 7), e["target_pid"], None, e["snapshot"],
                )
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t.type) for c, t in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
        out = []
        told(out)
        out.extend(stalled())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t.type) for c, t in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    keys = ("trace_id", "pid", "home")
    return rows.withColumn("_rank", rank).repartition(*keys).sortWithinPartitions(*keys, *ORDER, "_rank").drop("_rank").mapInArrow(run, SCHEMA).transform(settled, "process-states")


def with_names(states: DataFrame, most: int = 1000) -> DataFrame:
    """states with the names and brands that children took over from their parents: a chase along forks, a table of one
    row for each fork, until a parent has a name of its own."""
    spark = states.sparkSession
    forks = states.where((F.col("event_name") == "process_fork") & (F.col("role") == RUN)).select(F.col("id").alias("fork"), "name", "brand", "origin")
    view = f"forks_{id(forks):x}_{spark.sparkContext.applicationId.replace('-', '_')}"
    forks.createOrReplaceTempView(view)
    chased = spark.sql(
        f"""WITH RECURSIVE up(fork, name, brand, origin) MAX RECURSION LEVEL {most} AS (
          SELECT fork, name, brand, origin FROM {view}
          UNION ALL
          SELECT u.fork, coalesce(u.name, f.name), coalesce(u.brand, f.brand), f.origin FROM up u JOIN {view} f ON u.origin = f.fork WHERE u.name IS NULL OR u.brand IS NULL
        ) SELECT fork, max(name) AS name0, max(brand) AS brand0 FROM up GROUP BY fork"""
    )
    out = states.join(chased, F.col("origin") == F.col("fork"), "left")
    return out.withColumns({"name": F.coalesce("name", "name0", F.lit(UNNAMED)), "brand": F.coalesce("brand", "brand0", F.lit(""))}).drop("fork", "name0", "brand0")


def cpu_modes(states: DataFrame) -> DataFrame:
    """Rows of roles run and in, one for each event, with cpu_mode: the top of the CPU's own stack. A switch sets its
    base, IDLE or BUSY, with TRAP on it for a process in one, so only the events since then matter."""
    kind, switch = F.col("event_name"), F.col("role") == IN
    entries, exits = ([k for k, mode in names.items() if mode != "SYSCALL"] for names in (ENTRIES, EXITS))
    own = blocks.last_values(states.where(F.col("role").isin(RUN, IN)), ("trace_id", "cpu"), upto={"_since": F.when(switch, F.col("id"))})
    part = ("trace_id", "cpu", "_since")
    w = Window.partitionBy(*part).orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    base = F.when(switch, F.struct(F.when(F.col("pid") == 0, "IDLE").otherwise("BUSY").alias("mode"), ((F.col("pid") != 0) & (F.col("mode") == "TRAP")).cast("int").alias("trap")))
    own = own.withColumn("_base", F.coalesce(F.last(base, ignorenulls=True).over(w), F.struct(F.lit("UNKNOWN").alias("mode"), F.lit(0).alias("trap"))))
    step = F.when(kind.isin(*entries), 1).when(kind.isin(*exits), -1).otherwise(0)
    own = own.withColumn("_size", F.lit(1) + F.col("_base.trap") + F.sum(step).over(w))
    own = own.withColumn("_lost", F.greatest(F.max(F.lit(1) - F.col("_size")).over(w), F.lit(0))).withColumn("_size", F.col("_size") + F.col("_lost"))
    pushed = F.when(kind.isin(*entries), F.create_map(*[F.lit(x) for pair in ENTRIES.items() for x in pair])[kind])
    level = Window.partitionBy(*part, "_size").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    top = F.when(F.col("_size") > 1, F.coalesce(F.last(pushed, ignorenulls=True).over(level), F.lit("TRAP"))).otherwise(F.when(F.col("_lost") > 0, "UNKNOWN").otherwise(F.col("_base.mode")))
    return blocks.plain(own.withColumn("cpu_mode", top))


def process_counts(states: DataFrame) -> DataFrame:
    """(id, processes): how many processes are known after each event."""
    each = states.where("event_name is not null").groupBy("id", *ORDER).agg(F.sum("known").alias("known"))
    return blocks.running_sum(each, F.col("known"), "processes", ("trace_id",)).select("id", F.col("processes").cast("int").alias("processes"))


def state_after(events: DataFrame, listed: bool = True) -> DataFrame:
    """One row for each event: the process that runs on its CPU once the event was applied, and the CPU's mode."""
    found = with_names(cpu_modes(process_states(events, listed)))
    return found.select(
        "id", "trace_id", "cpu", "time_ns", "pid", "birth_ns", "ppid", "tgid", "name", "brand", "kind", "mode", "submode", "status", "depth", "function", "entry_ns", "change_ns", "cpu_mode",
        F.when(F.col("event_name").isin(*[k for k in TARGETED if k != "sched_try_wakeup"]), F.coalesce("target_pid", F.lit(-1).cast("long"))).otherwise(F.lit(-1).cast("long")).alias("target_pid"),
    )
