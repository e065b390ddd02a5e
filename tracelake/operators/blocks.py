"""Scans along time that no single task has to make.

A window over (trace, cpu) puts all that one CPU ever did into one task. Here time is cut into slots of about equal
numbers of events, each slot of a key is scanned on its own, and what goes over from one slot to the next (a latest
value, a sum, the next event) is worked out on a table of one row for each key and slot, which is joined back. So a task
holds a slot of a key, and the largest thing that is done in order is as long as the number of slots.

Slots come from the counts of cells of time: neighbouring cells with few events share a slot, a cell with many is cut
evenly. The table of cells is as long as the trace has minutes (half a million a year), whatever the number of events;
that is the bound on what is broadcast. Columns that begin with an underscore are the scans' own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.functions.adapter import ORDER

#: Events of a slot, and the width of a cell.
SLOT_ROWS, CELL_NS = 1_000_000, 60_000_000_000


def slotted(events: DataFrame, rows: int = SLOT_ROWS, cell_ns: int = CELL_NS) -> DataFrame:
    """events with _slot, a number that grows with time."""
    cell = F.expr(f"(time_ns - pmod(time_ns, {cell_ns}L)) div {cell_ns}L")
    counts = events.groupBy(cell.alias("_cell2")).agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_cell2").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cells = counts.withColumn("_before", before).select("_cell2", F.expr(f"_before div {rows}L").alias("_base"), F.ceil(F.col("_n") / rows).alias("_parts"))
    out = events.withColumn("_cell", cell).join(F.broadcast(cells), F.col("_cell") == F.col("_cell2"))
    return out.withColumn("_slot", F.expr(f"_base + pmod(time_ns, {cell_ns}L) * _parts div {cell_ns}L")).drop("_cell", "_cell2", "_base", "_parts")


def _local(keys: tuple[str, ...]) -> Window:
    return Window.partitionBy(*keys, "_slot").orderBy(*ORDER)


def _slots(keys: tuple[str, ...]) -> Window:
    return Window.partitionBy(*keys).orderBy("_slot")


def _earlier(keys: tuple[str, ...]) -> Window:
    return _slots(keys).rowsBetween(Window.unboundedPreceding, -1)


def _joined(events: DataFrame, ends: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    names = [*keys, "_slot"]
    ends = ends.select(*[F.col(c).alias(f"_at_{c}") for c in names], *[c for c in ends.columns if c not in names])
    on = None
    for c in names:
        same = F.col(c).eqNullSafe(F.col(f"_at_{c}"))
        on = same if on is None else on & same
    return events.join(ends, on).drop(*[f"_at_{c}" for c in names])


def _in_slots(events: DataFrame) -> DataFrame:
    return events if "_slot" in events.columns else slotted(events)


def last_values(events: DataFrame, keys: tuple[str, ...], before: dict[str, Column] | None = None, upto: dict[str, Column] | None = None, following: dict[str, str] | None = None) -> DataFrame:
    """For each event, among those of equal keys: the latest non-null value before it, or up to and with it, and the
    values of columns (new name to column) of the next event. One scan and one table of slots for all of them."""
    before, upto, following = before or {}, upto or {}, following or {}
    own, w = _in_slots(events), _local(keys)
    values = {**before, **upto}
    place, kept = F.struct(*ORDER), list(events.columns)
    out = own.withColumns({f"_v_{n}": c for n, c in values.items()})
    aggregates = [F.max_by(f"_v_{n}", F.when(F.col(f"_v_{n}").isNotNull(), place)).alias(f"_e_{n}") for n in values]
    if following:
        out = out.withColumn("_f", F.struct(*[F.col(c).alias(n) for n, c in following.items()]))
        aggregates.append(F.min_by("_f", place).alias("_first"))
    ends = out.groupBy(*keys, "_slot").agg(*aggregates)
    ends = ends.withColumns({f"_c_{n}": F.last(f"_e_{n}", ignorenulls=True).over(_earlier(keys)) for n in values} | ({"_c_f": F.lead("_first").over(_slots(keys))} if following else {}))
    ends = ends.select(*keys, "_slot", *[f"_c_{n}" for n in values], *(["_c_f"] if following else []))
    for n in values:
        frame = w.rowsBetween(Window.unboundedPreceding, -1 if n in before else Window.currentRow)
        out = out.withColumn(f"_l_{n}", F.last(f"_v_{n}", ignorenulls=True).over(frame))
    if following:
        out = out.withColumn("_l_f", F.lead("_f").over(w))
    out = _joined(out, ends, keys)
    new = {n: F.coalesce(f"_l_{n}", f"_c_{n}") for n in values} | {n: F.coalesce("_l_f", "_c_f")[n] for n in following}
    return out.select(*[c for c in kept if c not in new], *[c.alias(n) for n, c in new.items()], *(["_slot"] if "_slot" not in kept else []))


def depths(events: DataFrame, step: Column, keys: tuple[str, ...]) -> DataFrame:
    """The running sum of a step of +1, -1 or 0 as _sum, the least it has been, but 0 at most, as _low, and what that
    was before the event as _was."""
    own, w = _in_slots(events).withColumn("_step", step), _local(keys)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = own.withColumn("_s", F.sum("_step").over(upto))
    own = own.withColumn("_m", F.min("_s").over(upto)).withColumn("_p", F.lag("_m").over(w))
    ends = own.groupBy(*keys, "_slot").agg(F.sum("_step").alias("_t"), F.min("_s").alias("_least"))
    ends = ends.withColumn("_s0", F.coalesce(F.sum("_t").over(_earlier(keys)), F.lit(0)))
    ends = ends.withColumn("_m0", F.least(F.min(F.col("_s0") + F.col("_least")).over(_earlier(keys)), F.lit(0))).drop("_t", "_least")
    out = _joined(own, ends, keys)
    return out.withColumns({"_sum": F.col("_s0") + F.col("_s"), "_low": F.least("_m0", F.col("_s0") + F.col("_m")), "_was": F.least("_m0", F.col("_s0") + F.col("_p"))}).drop("_s", "_m", "_p", "_s0", "_m0")


def numbered(events: DataFrame, name: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Each event's place among those of equal keys, from 1."""
    own = _in_slots(events)
    ends = own.groupBy(*keys, "_slot").agg(F.count(F.lit(1)).alias("_n"))
    earlier = _earlier(keys) if keys else Window.orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("_n0", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    out = _joined(own.withColumn("_k", F.row_number().over(_local(keys))), ends, keys)
    return out.withColumn(name, F.col("_n0") + F.col("_k")).drop("_k", "_n0")


def running_sum(events: DataFrame, value: Column, name: str, keys: tuple[str, ...]) -> DataFrame:
    """The sum of a value up to and with each event."""
    own = _in_slots(events).withColumn("_x", value)
    ends = own.groupBy(*keys, "_slot").agg(F.sum("_x").alias("_t"))
    ends = ends.withColumn("_t0", F.coalesce(F.sum("_t").over(_earlier(keys)), F.lit(0))).drop("_t")
    out = _joined(own.withColumn("_l", F.sum("_x").over(_local(keys).rowsBetween(Window.unboundedPreceding, Window.currentRow))), ends, keys)
    return out.withColumn(name, F.col("_t0") + F.coalesce("_l", F.lit(0))).drop("_x", "_l", "_t0")


def running_max(events: DataFrame, value: str, name: str, keys: tuple[str, ...]) -> DataFrame:
    """The greatest value up to and with each event."""
    own = _in_slots(events)
    ends = own.groupBy(*keys, "_slot").agg(F.max(value).alias("_t"))
    ends = ends.withColumn("_t0", F.max("_t").over(_earlier(keys))).drop("_t")
    out = _joined(own.withColumn("_l", F.max(value).over(_local(keys).rowsBetween(Window.unboundedPreceding, Window.currentRow))), ends, keys)
    return out.withColumn(name, F.greatest("_t0", "_l")).drop("_l", "_t0")


def plain(df: DataFrame) -> DataFrame:
    """Without the scans' own columns."""
    return df.drop(*[c for c in df.columns if c.startswith("_")])
