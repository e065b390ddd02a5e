"""Graphs of clock synchronisation: point tables as CSV, and a gnuplot script that draws them by pair of traces."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.operators.sync import hulls


def script(pairs: list[tuple[int, int, float | None, float | None]]) -> str:
    """pairs: (a, b, drift, offset), a < b. Without a line, points and hulls alone are drawn."""
    parts = ["set terminal postscript eps color", 'set datafile separator ","', ""]
    for a, b, drift, offset in sorted(pairs, key=lambda p: p[:2]):
        where = f"a={a}/b={b}"
        plots = [f'"< cat points/{where}/hull={hull}/*.csv" using 1:2 title "{title}" with points' for hull, title in (("lower", "sent"), ("upper", "received"))]
        plots += [f'"< cat hulls/{where}/hull={hull}/*.csv" using 1:2 title "{hull} hull" with linespoints' for hull in ("lower", "upper")]
        if drift is not None and offset is not None:
            plots.append(f'{offset!r} + {drift!r} * x title "line"')
        parts += ["reset", f'set output "{a:03d}-{b:03d}-TraceTrace.eps"', f'set xlabel "Clock {a}"', f'set ylabel "Clock {b}"', "plot \\", ", \\\n".join("  " + p for p in plots), ""]
    return "\n".join(parts)


def write_graphs(points: DataFrame, factors: DataFrame, path: str) -> None:
    """points: as message_points; factors: a, b, drift, offset. Writes points/ and hulls/ (x, y by a, b and hull, in the
    order of x) and script/. Only factors, the square of the number of traces, comes to the driver."""
    keys = ["a", "b", "hull"]
    for name, table in (("points", points), ("hulls", hulls(points))):
        table.select(*keys, "x", "y").repartitionByRange(*keys, "x").sortWithinPartitions(*keys, "x").write.partitionBy(*keys).csv(f"{path}/{name}")
    lines = script([tuple(r) for r in factors.select("a", "b", "drift", "offset").collect()])
    points.sparkSession.createDataFrame([(lines,)], "value string").select(F.col("value")).coalesce(1).write.text(f"{path}/script")
