"""Scalar functions on columns: times as nanoseconds, device numbers, addresses, sequence numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SECOND = 1_000_000_000
MINOR_BITS = 20


def time_text(ns: Column) -> Column:
    """sec.nsec with nine digits."""
    return F.format_string("%d.%09d", _whole(ns), F.pmod(ns, F.lit(SECOND)))


def _whole(ns: Column) -> Column:
    return F.call_function("div", ns - F.pmod(ns, F.lit(SECOND)), F.lit(SECOND))


def time_from_text(text: Column) -> Column:
    """sec.nsec, where the part after the dot is a whole number of nanoseconds."""
    parts = F.split(text, r"\.")
    return parts[0].cast("long") * SECOND + F.coalesce(F.try_element_at(parts, F.lit(2)).cast("long"), F.lit(0))


def time_multiplied(ns: Column, by: Column | float) -> Column:
    return (ns.cast("double") * by).cast("long")


def time_divided(ns: Column, by: Column | float) -> Column:
    return (ns.cast("double") / by).cast("long")


def tsc_to_ns(tsc: Column, freq_scale: Column, start_freq: Column) -> Column:
    """In double, in this order of operations."""
    return (tsc.cast("double") * F.lit(1e9) * freq_scale / start_freq).cast("long")


def corrected_ns(tsc: Column, drift: Column, offset: Column, freq_scale: Column, start_freq: Column) -> Column:
    return tsc_to_ns((drift * tsc + offset).cast("long"), freq_scale, start_freq)


def major(device: Column) -> Column:
    return F.shiftright(device, MINOR_BITS)


def minor(device: Column) -> Column:
    return device.bitwiseAND(F.lit((1 << MINOR_BITS) - 1))


def device(major_: Column, minor_: Column) -> Column:
    return F.shiftleft(major_.cast("long"), MINOR_BITS).bitwiseOR(minor_)


def dotted(address: Column) -> Column:
    """An IPv4 address in host order."""
    return F.concat_ws(".", *[F.shiftright(address, s).bitwiseAND(F.lit(255)).cast("string") for s in (24, 16, 8, 0)])


def sequence_after(a: Column, b: Column) -> Column:
    """a > b for 32-bit sequence numbers that wrap."""
    return F.pmod(a - b + F.lit(1 << 31), F.lit(1 << 32)) - F.lit(1 << 31) > 0


def named(kind: str, id_: Column, name: Column | None = None) -> Column:
    """A name, or the kind and id where there is none."""
    plain = F.concat(F.lit(f"{kind} "), id_.cast("string"))
    return plain if name is None else F.coalesce(name, plain)


def process_key(pid: Column, birth_ns: Column) -> Column:
    """pid-sec.nsec, unique although pids are used again."""
    return F.concat(pid.cast("string"), F.lit("-"), _whole(birth_ns).cast("string"), F.lit("."), F.pmod(birth_ns, F.lit(SECOND)).cast("string"))


def file_safe(name: Column) -> Column:
    return F.translate(name, "/", "_")


def pixel(ns: Column, start: int, width_ns: int, bins: int) -> Column:
    return F.floor((ns - F.lit(start)).cast("double") / F.lit(float(width_ns)) * F.lit(bins)).cast("long")
