"""State event by event, critical paths, the lock check, the statistics tree."""

import json
import random

from pyspark.sql import functions as F

from tracelake.functions.adapter import ORDER, trace_events
from tracelake.operators import checks, dependencies, fold, pairing, snapshots, statistics, timelines


def run(spark, steps):
    rows = []
    for t, (cpu, name, more) in enumerate(steps, 1):
        rows.append((t, 0, cpu, name, more.get("submode"), more.get("next_pid"), more.get("prev_state"), more.get("target"), more.get("name"), t * 10, cpu, 0, t, more.get("parent"), more.get("kind"), more.get("address")))
    schema = "id long, trace_id long, cpu long, event_name string, submode string, next_pid long, prev_state long, target_pid long, name string, time_ns long, tracefile_id long, block long, offset long, parent_pid long, kind string, address long"
    states = fold.process_states(spark.createDataFrame(rows, schema))
    found = fold.with_names(fold.cpu_modes(states)).join(fold.process_counts(states), "id")
    shown = fold.state_after(spark.createDataFrame(rows, schema)).columns
    assert "cpu_mode" in shown and "brand" in shown
    return found.withColumn("target_pid", F.coalesce("target_pid", F.lit(-1))).orderBy("id").collect()


def sched(cpu, next_pid, prev_state=0):
    return cpu, "sched_schedule", {"next_pid": next_pid, "prev_state": prev_state}


def test_nested_modes(spark):
    got = run(spark, [sched(0, 5), (0, "syscall_entry", {"submode": "read"}), (0, "irq_entry", {"submode": "irq 3"}), (0, "syscall_exit", {}), (0, "irq_exit", {}), (0, "syscall_exit", {}), (0, "syscall_exit", {})])
    assert [(r.mode, r.submode, r.depth, r.cpu_mode) for r in got] == [
        ("MODE_UNKNOWN", "NONE", 1, "BUSY"), ("SYSCALL", "read", 2, "BUSY"), ("IRQ", "irq 3", 3, "IRQ"), ("IRQ", "irq 3", 3, "IRQ"),
        ("SYSCALL", "read", 2, "BUSY"), ("MODE_UNKNOWN", "NONE", 1, "BUSY"), ("MODE_UNKNOWN", "NONE", 1, "BUSY"),
    ]
    assert got[4].change_ns == 50 and got[4].entry_ns == 20 and got[0].status == "RUN"


def test_process_zero_is_one_per_cpu_and_makes_no_calls(spark):
    got = run(spark, [(0, "syscall_entry", {}), (1, "irq_entry", {}), sched(0, 4), sched(0, 0), (1, "irq_exit", {}), (1, "irq_exit", {})])
    assert [(r.pid, r.mode, r.status, r.cpu_mode) for r in got[2:4]] == [(4, "MODE_UNKNOWN", "RUN", "BUSY"), (0, "SYSCALL", "RUN", "IDLE")]
    assert got[0].depth == 1 and got[1].mode == "IRQ" and got[1].cpu_mode == "IRQ" and got[5].cpu_mode == "UNKNOWN"


def test_fork_names_and_both_orders_of_death(spark):
    birth = [sched(0, 7), (0, "exec", {"name": "/bin/sh"}), (0, "process_fork", {"target": 9}), sched(0, 9)]
    dead, free = sched(0, 7, 64), (0, "process_free", {"target": 9})
    for end in ([dead, free], [free, dead]):
        got = run(spark, [*birth, (0, "process_exit", {"target": 9}), *end])
        assert (got[3].pid, got[3].ppid, got[3].name, got[3].mode, got[3].status, got[3].depth) == (9, 7, "/bin/sh", "SYSCALL", "RUN", 2)
        assert got[4].status == "EXIT" and got[2].target_pid == 9
        before = got[5].processes
        assert got[4].processes == before == got[6].processes + 1


def test_same_depths_as_windows(spark, sf):
    """Calls nested per process, where no process 0 and no other mode comes between: as brackets have them."""
    e = trace_events(spark, sf).where("event_name in ('syscall_entry', 'syscall_exit')")
    first = e.selectExpr("id", "trace_id", "pid as cpu", "event_name", "cast(null as string) submode", "cast(null as long) next_pid", "cast(null as long) prev_state", "cast(null as long) target_pid", "cast(null as string) name", "time_ns", "tracefile_id", "block", "offset")
    entries = first.withColumn("cpu", first.cpu)
    switches = first.groupBy("trace_id", "cpu").agg({"id": "min"}).selectExpr("-cpu - 1 as id", "trace_id", "cpu", "'sched_schedule' as event_name", "cast(null as string) submode", "cpu + 1 as next_pid", "0L as prev_state", "cast(null as long) target_pid", "cast(null as string) name", "-1L as time_ns", "0L as tracefile_id", "0L as block", "-1L as offset")
    got = fold.state_after(entries.unionByName(switches)).where("id >= 0").join(e.where("event_name = 'syscall_entry'").select("id"), "id")
    want = {r.id: r.depth for r in pairing.brackets(e, "syscall_entry", "syscall_exit", "trace_id", "pid").collect()}
    assert {r.id: r.depth - 1 for r in got.collect()} == want and want


def test_deep_chains(spark):
    """Ancestors and critical paths have no depth of their own at which they stop."""
    parents = spark.createDataFrame([(0, k, k - 1) for k in range(1, 151)] + [(0, 500, 501), (0, 501, 500)], "trace_id long, pid long, ppid long")
    got = {(r.pid, r.ancestor): r.distance for r in dependencies.ancestors(spark, parents).collect()}
    assert got[150, 0] == 150 and sum(1 for p, _ in got if p == 150) == 150 and got[500, 501] == 1 and (500, 500) not in got
    links = spark.createDataFrame([(0, k, k, 1000 - k, k + 1) for k in range(1, 121)], "trace_id long, pid long, start_ns long, end_ns long, waker long")
    start = spark.createDataFrame([(0, 1, 0, 1000)], "trace_id long, pid long, t1 long, t2 long")
    assert {r.depth for r in dependencies.critical_path(links, start).collect()} == set(range(120))


def test_wakers_and_user_traces(spark):
    blocked = spark.createDataFrame([(0, 1, 10, 50, 45, 2)], "trace_id long, pid long, start_ns long, end_ns long, woken_ns long, waker long")
    running = spark.createDataFrame([(0, 2, 0, 45, "RUN"), (0, 2, 45, 60, "WAIT"), (0, 2, 60, 90, "RUN")], "trace_id long, pid long, start_ns long, end_ns long, status string")
    (got,) = dependencies.wakers(blocked, running).collect()
    assert (got.waker_start_ns, got.waker_end_ns, got.waker_status) == (45, 60, "WAIT")
    processes = spark.createDataFrame([(0, 5, 100)], "trace_id long, pid long, inserted_ns long")
    traces = spark.createDataFrame([("old", 5, 10), ("new", 5, 90), ("later", 5, 200)], "usertrace string, pid long, creation_ns long")
    assert dependencies.user_traces(processes, traces).first().usertrace == "new"


def test_critical_path(spark):
    links = spark.createDataFrame([(0, 1, 10, 50, 2), (0, 1, 60, 90, None), (0, 2, 20, 40, 3), (0, 2, 5, 45, 3), (0, 3, 25, 35, 1), (1, 1, 10, 50, 2)], "trace_id long, pid long, start_ns long, end_ns long, waker long")
    start = spark.createDataFrame([(0, 1, 0, 55)], "trace_id long, pid long, t1 long, t2 long")
    got = dependencies.critical_path(links, start).collect()
    assert sorted((r.pid, r.start_ns, r.depth) for r in got) == [(1, 10, 0), (2, 20, 1), (3, 25, 2)]


def test_locks(spark):
    rows = [
        (1, 0, "acquire", 7, False, True, True), (2, 0, "release", 7, False, True, True), (3, 0, "acquire", 7, False, False, False), (4, 0, "sched", None, False, False, False),
        (5, 1, "init", 7, False, False, False), (6, 0, "release", 7, False, False, False), (7, 0, "sched", None, False, False, False), (8, 0, "acquire", 8, True, False, False), (9, 0, "sched", None, False, False, False),
    ]
    e = spark.createDataFrame([(0, c, o, l, r, h, i, n, 0, 0, n) for n, c, o, l, r, h, i in rows], "trace_id long, cpu long, op string, lock long, read boolean, hardirqs_off boolean, hardirq_context boolean, time_ns long, tracefile_id long, block long, offset long")
    got = sorted((r.time_ns, r.warning, r.lock) for r in checks.lock_warnings(e, switches=True, bucket_ns=4).collect())
    assert got == [(3, "taken with interrupts on, and before in an interrupt", 7), (4, "held over a switch", 7), (5, "set up again while it is held", 7)]
    assert checks.lock_warnings(e).count() == 2


def test_statistics_tree(spark):
    stats = spark.createDataFrame([(0, 1, 0, 0, 0, "SYSCALL", "read", 5, 6, 7, 2), (0, 1, 0, 0, 0, "SYSCALL", "open", 7, 8, 9, 1), (1, 2, 0, 1, 0, "IRQ", "irq 1", 1, 1, 1, 1)], "trace_id long, pid long, birth_ns long, cpu long, function long, mode string, submode string, cpu_time_ns long, elapsed_ns long, cumulative_ns long, events long")
    got = [(r.line, r.cpu_time_ns, r.events) for r in statistics.stats_tree(stats).collect()]
    assert got[:4] == [("0", 12, 3), ("  1", 12, 3), ("    0", 12, 3), ("      0", 12, 3)] and len(got) == 15
    whole = statistics.traceset_tree(stats).collect()
    assert [r.tree for r in whole] == ["traceset"] * 13 + ["/trace0"] * 8 + ["/trace1"] * 7


class Machine:
    """The rules of state by the book: one trace, all events in order, in plain Python."""

    def __init__(self):
        self.stacks, self.running, self.leaves, self.rows = {}, {}, {}, []

    def stack(self, pid, cpu, t):
        return self.stacks.setdefault((pid, cpu if pid == 0 else -1), [["MODE_UNKNOWN", "NONE", t, t, "UNNAMED", 0]])

    def add(self, pid, cpu, top, **more):
        leaf = self.leaves.setdefault((pid, cpu, top[0], top[1]), dict(spent=0, elapsed=0, cumulative=0, events=0))
        for k, v in more.items():
            leaf[k] += v

    def spend(self, pid, cpu, t, ends):
        top = self.stack(pid, cpu, t)[-1]
        known = top[0] != "MODE_UNKNOWN"
        spent = t - top[3] if known and top[4] == "RUN" else 0
        top[5] += spent
        self.add(pid, cpu, top, spent=spent, **({"elapsed": t - top[2] if known else 0, "cumulative": top[5]} if ends else {}))

    def event(self, cpu, kind, t, sub=None, next_pid=0, prev_state=0, prev_pid=1):
        pid = self.running.setdefault(cpu, 0)
        stack, mode = self.stack(pid, cpu, t), {"s": "SYSCALL", "i": "IRQ", "t": "TRAP", "q": "SOFT_IRQ"}.get(kind[0])
        if kind == "sched":
            self.spend(pid, cpu, t, False)
            top = stack[-1]
            if pid == 0 and top[0] == "MODE_UNKNOWN":
                if not prev_pid:
                    top[:] = ["SYSCALL", top[1], t, t, "WAIT", top[5]]
            else:
                top[3:5] = [t, "WAIT_CPU" if prev_state == 0 else "WAIT"]
            self.running[cpu] = pid = next_pid
            self.stack(pid, cpu, t)[-1][3:5] = [t, "RUN"]
        elif kind[1] == "+":
            self.spend(pid, cpu, t, False)
            if mode != "SYSCALL" or pid:
                stack.append([mode, sub, t, t, stack[-1][4], 0])
        else:
            self.spend(pid, cpu, t, True)
            if (mode != "SYSCALL" or pid) and stack[-1][0] == mode and len(stack) > 1:
                stack.pop()
                stack[-1][3] = t
        top = self.stack(pid, cpu, t)[-1]
        self.add(pid, cpu, top, events=1)
        self.rows.append((pid, top[0], top[1], top[4], len(self.stack(pid, cpu, t))))


NAMES = {"s+": "syscall_entry", "s-": "syscall_exit", "i+": "irq_entry", "i-": "irq_exit", "t+": "trap_entry", "t-": "trap_exit", "q+": "softirq_entry", "q-": "softirq_exit", "sched": "sched_schedule"}


def random_trace(seed, n):
    r, steps = random.Random(seed), []
    for t in range(1, n + 1):
        kind = r.choice(list(NAMES))
        steps.append((r.randrange(3), kind, t * 10, f"{kind[0]}{r.randrange(2)}", r.randrange(4), r.choice([0, 0, 1]), r.choice([0, 1])))
    return steps


def as_events(spark, steps):
    rows = [(k, 0, cpu, NAMES[kind], sub, prev_pid, next_pid, prev_state, t, cpu, 0, k) for k, (cpu, kind, t, sub, next_pid, prev_state, prev_pid) in enumerate(steps)]
    return spark.createDataFrame(rows, "id long, trace_id long, cpu long, event_name string, submode string, prev_pid long, next_pid long, prev_state long, time_ns long, tracefile_id long, block long, offset long")


def test_states_and_statistics_against_a_plain_machine(spark):
    """Nested interrupts in calls, ignored exits, switches between three CPUs, calls of process 0."""
    for seed in (1, 2):
        steps, machine = random_trace(seed, 400), Machine()
        for cpu, kind, t, sub, next_pid, prev_state, prev_pid in steps:
            machine.event(cpu, kind, t, sub, next_pid, prev_state, prev_pid)
        events = as_events(spark, steps)
        got = fold.state_after(events, listed=False).orderBy("id").collect()
        assert [(r.pid, r.mode, r.submode, r.status, r.depth) for r in got] == machine.rows
        stats = {(r.pid, r.cpu, r.mode, r.submode): (r.cpu_time_ns, r.elapsed_ns, r.cumulative_ns, r.events) for r in statistics.mode_stats(events, listed=False).collect()}
        assert stats == {k: (v["spent"], v["elapsed"], v["cumulative"], v["events"]) for k, v in machine.leaves.items()}


def test_modes_that_never_end(spark):
    """With an end time, open modes that have collected time are ended there, each adding to the one below."""
    steps = [(0, "sched", 10, "", 5, 0, 1), (0, "s+", 20, "read", 0, 0, 1), (0, "i+", 30, "irq", 0, 0, 1)]
    open_ = {(r.mode, r.submode): r for r in statistics.mode_stats(as_events(spark, steps), listed=False, end_ns=50).collect()}
    plain = {(r.mode, r.submode): r for r in statistics.mode_stats(as_events(spark, steps), listed=False).collect()}
    assert plain["SYSCALL", "read"].cpu_time_ns == 10 and plain["SYSCALL", "read"].elapsed_ns == 0
    assert open_["SYSCALL", "read"].elapsed_ns == 30 and open_["SYSCALL", "read"].cumulative_ns == 10


def test_nested_interrupt_in_a_call_on_the_cpu(spark):
    """A CPU is back to what it was when an interrupt ends; one more exit leaves it unknown until the next switch."""
    steps = [(0, "sched", 10, "", 5, 0, 1), (0, "s+", 20, "a", 0, 0, 1), (0, "i+", 30, "b", 0, 0, 1), (0, "q+", 40, "c", 0, 0, 1), (0, "q-", 50, "c", 0, 0, 1), (0, "i-", 60, "b", 0, 0, 1), (0, "i-", 70, "b", 0, 0, 1), (0, "sched", 80, "", 0, 0, 1)]
    got = timelines.cpu_timeline(as_events(spark, steps), listed=False).orderBy("start_ns").collect()
    assert [(r.state, r.start_ns, r.end_ns) for r in got] == [("busy", 10, 30), ("irq", 30, 40), ("soft_irq", 40, 50), ("irq", 50, 60), ("busy", 60, 70), ("unknown", 70, 80), ("idle", 80, None)]


def test_snapshots_restore_and_replay(spark, tmp_path):
    """The state at any time is the same from a snapshot as from the beginning, and so is it from XML."""
    events = as_events(spark, random_trace(7, 300))
    path = f"file://{tmp_path}/states"
    snapshots.save_states(events, path, every=49, listed=False)
    keys = ("trace_id", "pid", "home")
    for t in (5, 495, 1503, 2999, 9999):
        got = {tuple(r[k] for k in keys): (r.mode, r.submode, r.status, r.depth, json.loads(r.stack)) for r in snapshots.state_at(events, path, t, listed=False).collect()}
        whole = fold.process_states(events.where(F.col("time_ns") < t), listed=False, stacks=True)
        want = {}
        for r in whole.withColumn("rank", snapshots._role_rank()).orderBy(*ORDER, "rank").collect():
            want[tuple(r[k] for k in keys)] = (r.mode, r.submode, r.status, r.depth, r.stack)
        # The last row of each process tells its stack.
        want = {k: (*v[:-1], json.loads(v[-1])) for k, v in want.items()}
        assert got == want and (want or t == 5)
    before = snapshots.restore_states(spark, path, 3)
    snapshots.write_xml(before, f"file://{tmp_path}/xml")
    again = snapshots.read_xml(spark, f"file://{tmp_path}/xml")
    shown = ("trace_id", "pid", "home", "mode", "submode", "status", "depth", "cpu", "name", "kind")
    assert {tuple(r[c] for c in shown) + (str(json.loads(r.stack)),) for r in again.collect()} == {tuple(r[c] for c in shown) + (str(json.loads(r.stack)),) for r in before.collect()}


def test_the_list_of_processes(spark):
    got = run(spark, [
        (0, "process_state", {"target": 0, "name": "swapper"}), (0, "process_state", {"target": 5, "parent": 1, "name": "sh", "kind": "USER_THREAD"}), (0, "process_state", {"target": 6, "name": "kswapd", "kind": "KERNEL_THREAD"}),
        sched(0, 8), sched(0, 9, 0), (0, "statedump_end", {}), sched(0, 5), sched(0, 6), sched(0, 8),
    ])
    assert got[0].name == "swapper" and got[1].processes == 2 and got[3].mode == "MODE_UNKNOWN"
    assert (got[5].mode, got[5].depth) == ("SYSCALL", 2)
    assert [(r.pid, r.ppid, r.name, r.mode, r.depth) for r in got[6:]] == [(5, 0, "sh", "SYSCALL", 2), (6, 0, "kswapd", "SYSCALL", 1), (8, 0, "UNNAMED", "USER_MODE", 1)]


def test_functions(spark):
    got = run(spark, [sched(0, 5), (0, "function_exit", {"address": 1}), (0, "function_entry", {"address": 10}), (0, "function_entry", {"address": 20}), (0, "function_exit", {"address": 10}), (0, "function_exit", {"address": 20}), (0, "function_exit", {"address": 10})])
    assert [r.function for r in got] == [0, 0, 10, 20, 20, 10, 0]


def test_snapshots_tell_a_deep_stack_once(spark, tmp_path):
    """Calls that never end: what snapshots hold grows with the events, not with their square, and is whole again."""
    rows = [(k, k * 10, 0, 0, 0, 0, k, "sched_schedule" if k == 0 else "irq_exit" if k % 5 == 4 else "irq_entry", 3 if k == 0 else None) for k in range(2000)]
    events = spark.createDataFrame(rows, "id long, time_ns long, trace_id long, tracefile_id long, cpu long, block long, offset long, event_name string, next_pid long")
    path = str(tmp_path / "deep")
    snapshots.save_states(events, path, every=9, listed=False)
    saved = spark.read.parquet(f"{path}/states")
    assert saved.agg(F.max(F.length("stack"))).first()[0] < 2000
    stack = []
    for k in range(1, 771):
        stack.pop() if k % 5 == 4 else stack.append(k * 10)
    (got,) = [json.loads(r.stack)[0] for r in snapshots.restore_states(spark, path, 77).collect() if r.pid == 3]
    assert [x[0] for x in got] == ["MODE_UNKNOWN"] + ["IRQ"] * len(stack) and [x[2] for x in got[1:]] == stack
