"""Hooks, modules, options, attributes, views; trace sets, names, network packets, scans in slots, printing."""

import random
import time

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tracelake import engine
from tracelake.functions import names
from tracelake.functions.adapter import ORDER, in_time, of_types, trace_events
from tracelake.operators import blocks, checks, network, ordering, pairing, printing, statistics, timelines
from tracelake.plans.filterlang import compile_filter, gathered
from tracelake.sources import traceset


def test_hooks(spark):
    seen, one, two = [], engine.Hooks(), engine.Hooks()
    one.add(lambda e: seen.append("late"), 90)
    one.add(lambda e: seen.append("default"))
    two.add(lambda e: e.limit(1) if not seen.append("early") else None, 10)
    assert engine.Hooks.merged(one, two).call(spark.range(5)).count() == 1 and seen == ["early", "default", "late"]
    with pytest.raises(ValueError):
        one.add(print, 100)
    assert two.until(lambda e: e.count() == 1, spark.range(3))[1] and len(one) == 2


def test_event_hooks_and_runs(spark, sf):
    e, run = trace_events(spark, sf), engine.Run()
    run.before_traceset.add(lambda events: events.where("cpu = 0"))
    run.events.bind("irq_entry", {"irq_id": "int"}, lambda v: v.groupBy("irq_id").count())
    events, made = run.process(e, end=1_704_500_000_000_000_000)
    want = e.where("cpu = 0 and time_ns < 1704500000000000000")
    assert events.count() == want.count() and dict(made["irq_entry"][0].collect()) == {r[0]: r[1] for r in want.where("event_name = 'irq_entry'").groupBy("irq_id").count().collect()}
    run.events.bind("irq_entry", {"nothing": "int"}, lambda v: v)
    with pytest.raises(KeyError):
        run.process(e)


def test_modules_and_options():
    log, modules = [], engine.Modules()
    for name, needs in (("a", ()), ("b", ("a",)), ("c", ("a", "b"))):
        modules.register(engine.Module(name, lambda n=name: log.append(f"+{n}"), lambda n=name: log.append(f"-{n}"), needs))
    modules.require("c")
    modules.require("a")
    modules.release("c")
    assert log == ["+a", "+b", "+c", "-c", "-b"] and modules.active() == ["a"]
    modules.register(engine.Module("x", needs=("y",)))
    modules.register(engine.Module("y", needs=("x",)))
    with pytest.raises(ValueError):
        modules.require("x")
    options, told = engine.Options(), []
    options.add("output", "o", "where to", str)
    options.add("noevent", "n")
    options.add("limit", "l", kind=int, value=3, called=told.append)
    assert options.parse(["-o", "f", "trace", "--limit=7", "-n"]) == ["trace"] and (options["output"], options["limit"], options["noevent"]) == ("f", 7, True) and told == [7]
    with pytest.raises(ValueError):
        options.parse(["--what"])


def test_attributes():
    tree = engine.Attributes()
    tree.put("hooks/event/n", 3)
    tree.put("hooks/name", "x")
    other = engine.Attributes()
    other.put("hooks/event/n", 4)
    other.put("new/b", True)
    tree.plus(other)
    assert dict(tree.rows()) == {"hooks/event/n": 7, "hooks/name": "x", "new/b": True}
    assert dict(engine.Attributes.from_xml(tree.to_xml()).rows()) == dict(tree.rows())
    assert tree.find("made/up", int) == 0 and len(tree.find("hooks")) == 2
    with pytest.raises(KeyError):
        tree.find("no/such")


def test_views(spark, sf):
    view, told = engine.View(trace_events(spark, sf)), []
    view.on("filter", told.append)
    chosen = compile_filter("state.cpu = 1")
    view.set("filter", chosen)
    view.set("time_window", (None, 1_704_500_000_000_000_000))
    assert view.events().count() == trace_events(spark, sf).where("cpu = 1 and time_ns < 1704500000000000000").count() and told == [chosen]


def test_cancelled(spark):
    events = spark.range(5)
    assert engine.cancelled(events, lambda: False, "never")(lambda e: e.count()) == 5
    slow = spark.range(4).mapInPandas(lambda frames: (time.sleep(6) or f for f in frames), "id long")
    with pytest.raises(Exception, match="(?i)cancel|interrupt"):
        engine.cancelled(slow, lambda: True, "stop")(lambda e: e.collect())


def test_tracesets(spark, tmp_path):
    held = traceset.Traceset(name="mine").added("a").added("b").added("c").removed("b")
    held.save(spark, f"file://{tmp_path}/set")
    assert traceset.Traceset.load(spark, f"file://{tmp_path}/set") == held and held.copied("other").paths == ("a", "c")
    events = spark.createDataFrame([(0, "open", {"fd": "3", "name": "x", "big": "18446744073709551615"}), (1, "open", {"fd": "no"})], "trace_id long, event_name string, payload map<string,string>")
    rows = traceset.typed(events, "open", [("fd", "unsigned"), ("big", "long_unsigned"), ("name", "string")]).collect()
    assert (rows[0].fd, int(rows[0].big), rows[0].name, rows[1].fd) == (3, 2**64 - 1, "x", None) and traceset.without_trace(events, 0).count() == 1


def test_scans_in_slots(spark, sf):
    """Small slots and cells, against windows over all of a key."""
    e = trace_events(spark, sf).withColumn("step", F.when(F.col("event_name") == "irq_entry", 1).when(F.col("event_name") == "irq_exit", -1).otherwise(0)).drop("ts", "event_type")
    keys, w = ("trace_id", "cpu"), Window.partitionBy("trace_id", "cpu").orderBy(*ORDER)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    value = F.when(F.col("k") % 7 == 0, F.col("k"))
    plain = e.select(
        "id", F.last(value, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("b"), F.last(value, ignorenulls=True).over(upto).alias("u"), F.lead("time_ns").over(w).alias("f"), F.lead("id").over(w).alias("g"),
        F.sum("step").over(upto).alias("s"), F.row_number().over(w).alias("n"), F.max("k").over(upto).alias("m"),
    )
    want = {r.id: tuple(r)[1:] for r in plain.collect()}
    for rows, cell in ((7, 3_600_000_000_000), (40, 86_400_000_000_000), (1_000_000, 60_000_000_000)):
        cut = blocks.slotted(e, rows, cell)
        found = blocks.last_values(cut, keys, before={"b": value}, upto={"u": value}, following={"f": "time_ns", "g": "id"})
        found = blocks.running_max(blocks.numbered(blocks.running_sum(found, F.col("step"), "s", keys), "n", keys), "k", "m", keys)
        assert {r.id: (r.b, r.u, r.f, r.g, r.s, r.n, r.m) for r in found.collect()} == want
        deep = {r.id: (r._sum, r._low, r._was) for r in blocks.depths(cut, F.col("step"), keys).collect()}
        state = {}
        for r in e.orderBy(*ORDER).collect():
            total, low = state.get((r.trace_id, r.cpu), (0, 0))
            state[r.trace_id, r.cpu] = total + r.step, min(low, total + r.step)
            assert deep[r.id][:2] == state[r.trace_id, r.cpu] and deep[r.id][2] in (low, None if total == 0 else low)


def test_conditions_reach_the_scan(spark, sf):
    e = trace_events(spark, sf)
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = of_types(in_time(e, 1_704_200_000_000_000_000, 1_704_500_000_000_000_000), "irq_entry")._jdf.queryExecution().executedPlan().toString()
    pushed = plan[plan.index("PushedFilters") :]
    assert "GreaterThanOrEqual(ts" in pushed and "LessThanOrEqual(ts" in pushed and "event_type" in pushed
    assert ordering.time_range(e, 1_704_200_000_000_000_000).count() == e.where("time_ns >= 1704200000000000000").count()


def test_monotonicity_over_pieces(spark, monkeypatch):
    r = random.Random(2)
    rows = [(0, 0, b, o * 10, r.randrange(50)) for b in range(3) for o in range(40)]
    events = spark.createDataFrame(rows, "trace_id long, tracefile_id long, block long, offset long, time_ns long")
    monkeypatch.setattr(ordering, "PIECE", 64)
    (got,) = ordering.out_of_order(events).collect()
    times = [x[4] for x in rows]
    assert (got.events, got.backward, got.equal) == (120, sum(b < a for a, b in zip(times, times[1:], strict=False)), sum(b == a for a, b in zip(times, times[1:], strict=False)))


def segment(i, trace, t, way, saddr, daddr, sp, dp, seq, ack_seq, length, syn=0, fin=0, ack=1):
    return (i, trace, t, way, saddr, daddr, sp, dp, 40 + length, 5, seq, ack_seq, 5, ack, 0, syn, fin)


SEGMENTS = "id long, trace_id long, time_ns long, direction string, saddr long, daddr long, source long, dest long, tot_len long, ihl long, seq long, ack_seq long, doff long, ack long, rst long, syn long, fin long"


def test_tcp_by_thirteen_fields(spark):
    """Segments that differ in one field don't meet; an acknowledgement without data asks for none; sequences wrap."""
    top = 2**32 - 5
    rows = [
        segment(1, 0, 10, "OUT", 1, 2, 1000, 80, top, 0, 10), segment(2, 1, 20, "IN", 1, 2, 1000, 80, top, 0, 10), segment(3, 1, 22, "IN", 1, 2, 1000, 80, top, 0, 11),
        segment(4, 0, 25, "OUT", 1, 2, 1000, 80, 5, 0, 10), segment(5, 1, 30, "IN", 1, 2, 1000, 80, 5, 0, 10),
        segment(6, 1, 40, "OUT", 2, 1, 80, 1000, 7, 15, 0), segment(7, 0, 50, "IN", 2, 1, 80, 1000, 7, 15, 0),
    ]
    events = spark.createDataFrame(rows, SEGMENTS)
    messages = {(r.out_id, r.in_id): (r.needs_ack, r.is_ack) for r in network.tcp_messages(events).collect()}
    assert messages == {(1, 2): (True, True), (4, 5): (True, True), (6, 7): (False, True)}
    (exchange,) = network.tcp_exchanges(events).collect()
    assert (exchange.in_id, exchange.acked_id, exchange.acked) == (7, 5, 2)
    counts = {r.counter: r.n for r in network.counters(events).collect()}
    assert counts == {"packets": 7, "received": 4, "sent": 3, "messages": 3, "needing_ack": 2, "acks": 3, "exchanges": 1, "acknowledged": 2, "unmatched": 1}


def test_broadcast_statistics(spark):
    rows = [(1, 0, 1_000_000_000, "a"), (2, 1, 3_000_000_000, "a"), (3, 0, 5_000_000_000, "b"), (4, 1, 4_000_000_000, "b"), (5, 0, 9_000_000_000, "c")]
    (got,) = network.broadcast_statistics(spark.createDataFrame(rows, "id long, trace_id long, time_ns long, key string"), 2, "key").collect()
    assert (got.broadcasts, got.stdev_sum, got.least, got.greatest, got["sum"], got.sum_squares) == (2, 1.5, -1.0, 2.0, 1.0, 5.0)


def test_names(spark):
    rows = [(8, 0), (8, 17), (65, 16), (3, 65), (22, 1), (9, 4), (179, 9), (202, 0), (8, 255), (77, 3)]
    df = spark.createDataFrame(rows, "a long, b long").coalesce(1)
    assert [r.n for r in df.select(names.disk_name(F.col("a"), F.col("b")).alias("n")).collect()] == ["sda", "sdb1", "sdr", "hdb1", "hdc1", "md4", "mmcblk1p1", "xvda", "sdp15", "(77,3)"]


@pytest.mark.parametrize("form, value, want", [("%u", 7, "7"), ("%lld", -7, "-7"), ("%#llx", 255, "0xff"), ("%08x", 255, "000000ff"), ("%p", 4096, "0x1000"), ("%c", 65, "A"), ("%5d", 42, "   42"), ("%lo", 8, "10")])
def test_printf(spark, form, value, want):
    assert spark.range(1).select(printing.printf(F.lit(value), form)).first()[0] == want


def test_dump(spark, sf, tmp_path):
    """Header, lines, footer, statistics; strings in quotes, names after numbers, no field names."""
    e = trace_events(spark, sf).limit(30)
    shown = e.selectExpr("*", "pid as running_pid", "0L as tgid", "'sh' as process_name", "'' as brand", "1L as ppid", "255L as function", "'SYSCALL' as mode", "'RUN' as status")
    lines = printing.event_lines(shown, process_state=True, names={"syscall_id": F.when(F.col("syscall_id") < 10, F.concat(F.lit("sys_"), F.col("syscall_id")))})
    stats = spark.createDataFrame([("/trace0/x: 1",)], "line string")
    printing.dump(lines, f"file://{tmp_path}/dump", 2, stats)
    text = [r.value for f in sorted((tmp_path / "dump").glob("part*")) for r in spark.read.text(str(f)).collect()]
    assert text[:2] == ["Trace set contains 2 traces", ""] and text[-3:] == ["End trace set", "", "/trace0/x: 1"] and len(text) == 35
    assert all(", 0, sh, , 1, 0xff, SYSCALL" in x and x.endswith(" RUN ") for x in text[2:32])
    call = next(x for x in text if "syscall_id = " in x)
    number = int(call.split("syscall_id = ")[1].split()[0])
    assert (f"[sys_{number}]" in call) == (number < 10)
    assert "syscall_id" not in "".join(r.line for r in printing.event_lines(shown, field_names=False).collect())
    assert printing.field_text("x", "%s")._jc.toString() and spark.createDataFrame([("a b",)], "x string").select(printing.field_text("x", "%s")).first()[0] == 'x = "a b"'
    printing.tracefile_dump(e, f"file://{tmp_path}/files")
    assert spark.read.text(f"file://{tmp_path}/files").count() == 30


def test_filters_from_files(spark, tmp_path):
    (tmp_path / "f.txt").write_text("state.cpu = 1\n & event.field.k > 50\n")
    text = gathered(spark, ["state.pid < 20"], [f"file://{tmp_path}/f.txt"])
    assert text == "(state.pid < 20)&(state.cpu = 1 & event.field.k > 50)"


def test_closed_files(spark):
    """dup3 opens its new number; what a process that ended had closed is no matter."""
    rows = [(1, "close", 3, None), (2, "read", 3, None), (3, "dup3", 9, 3), (4, "read", 3, None), (5, "close", 3, None), (6, "exit", None, None), (7, "write", 3, None), (8, "close", 4, None), (9, "write", 4, None)]
    ops = spark.createDataFrame([(t, 0, 1, op, fd, new, 0, 0, t) for t, op, fd, new in rows], "time_ns long, trace_id long, pid long, op string, fd long, newfd long, tracefile_id long, block long, offset long")
    assert sorted(r.time_ns for r in checks.use_after_close(ops).collect()) == [2, 9]


def test_interrupt_report(spark):
    """Longest and shortest spans, the first CPU, deviations from the mean and the period."""
    rows = [(1, 0, 7, 100, 110), (2, 1, 7, 200, 230), (3, 1, 7, 300, 320)]
    pairs = spark.createDataFrame(rows, "id long, cpu long, irq_id long, time_ns long, end_ns long")
    (got,) = statistics.irq_statistics(pairs, 0, 1_000_000_000).collect()
    assert (got.first_cpu, got.n, got.total_ns, got.max_start_ns, got.max_end_ns, got.min_start_ns, got.min_end_ns, got.avg_ns, got.hz, got.period_ns) == (0, 3, 60, 200, 230, 100, 110, 20, 3, 333_333_333)
    assert got.duration_sd == 8 and got.period_sd == 333_333_313 and got.hz_sd == 18
    index = spark.createDataFrame([(0, 0, 0, 1), (0, 0, 1, 5), (0, 1, 0, 2)], "trace_id long, tracefile_id long, block long, events_lost long")
    assert {(r.trace_id, r.tracefile_id): r.lost for r in statistics.lost_events(index).collect()} == {(0, 0): 5, (0, 1): 2, (0, None): 7, (None, None): 7}


def test_block_device_stack(spark):
    rows = [(1, "issue", 0), (2, "issue", 1), (3, "complete", 0), (4, "complete", 0), (5, "complete", 0), (6, "issue", 1)]
    e = spark.createDataFrame([(t, 0, f"_blk_request_{op}", d, 8, 1, 0, 0, t) for t, op, d in rows], "time_ns long, trace_id long, event_name string, direction long, major long, minor long, tracefile_id long, block long, offset long")
    got = timelines.bdev_timeline(e).orderBy("start_ns").collect()
    assert [(r.state, r.start_ns, r.end_ns) for r in got] == [("reading", 1, 2), ("writing", 2, 3), ("reading", 3, 4), ("unknown", 4, 6), ("writing", 6, None)]


def test_interval_lookup(spark, sf):
    spans = spark.createDataFrame([(0, 0, 10, "a"), (0, 10, 35, "b"), (1, 5, 6, "c")], "key long, a long, b long, v string")
    events = spark.createDataFrame([(k, t) for k in (0, 1) for t in range(0, 40, 5)], "key long, time_ns long")
    got = {(r.key, r.time_ns): r.v for r in pairing.interval_lookup(events, spans, ["key"], "a", "b", ["v"], 7).collect()}
    assert got == {(k, t): next((v for kk, a, b, v in ((0, 0, 10, "a"), (0, 10, 35, "b"), (1, 5, 6, "c")) if kk == k and a <= t < b), None) for k, t in got}


def test_small_things(spark):
    """Removing, listing, usage; tables of a session go when they are forgotten."""
    from tracelake.functions import tables

    hooks, hook = engine.Hooks(), lambda e: None
    hooks.add(hook)
    hooks.remove(hook)
    assert len(hooks) == 0
    with pytest.raises(KeyError):
        hooks.remove(hook)
    options = engine.Options()
    options.add("stats", "s", "statistics")
    assert "-s, --stats  statistics" in options.usage()
    options.remove("stats")
    with pytest.raises(ValueError):
        options.parse(["--stats"])
    tree = engine.Attributes()
    tree.add("a", 1)
    tree.directory("b").add("c", 2.5)
    assert tree.names() == ["a", "b"] and tree.at(0) == ("a", 1) and tree.get("a") == 1
    tree.remove("a")
    assert dict(tree.rows()) == {"b/c": 2.5}
    view, told = engine.View(spark.range(1)), []
    view.on("position", told.append)
    view.off("position", told.append)
    view.set("position", 5)
    assert not told and view["position"] == 5
    table = tables.settled(spark.range(3).toDF("x"), "three")
    assert table.count() == 3
    tables.forget(spark)
    with pytest.raises(Exception, match="(?i)exist|found"):
        table.count()


def test_disk_performance_of_many_bytes(spark):
    """Sums of bytes whose billionfold is beyond a bigint."""
    from tracelake.operators.statistics import disk_performance

    df = spark.createDataFrame([(1, "read", 3 << 40), (1, "read", 61), (1, "write", 1 << 62), (2, "write", 7)], "disk long, op string, bytes long")
    got = {tuple(r) for r in disk_performance(df, 60_000_000_000).select("disk", "bytes_read", "reads", "bytes_written", "writes", "read_per_s", "written_per_s").collect()}
    read = (3 << 40) + 61
    assert got == {(1, read, 2, 1 << 62, 1, read // 60, (1 << 62) // 60), (2, 0, 0, 7, 1, 0, 0)}
