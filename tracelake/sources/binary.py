"""The binary trace format, version 2.6: a folder of one file per channel and CPU, each a chain of blocks.

A block says where its time begins, so blocks are decoded apart from each other, and a table of the blocks' headers
(``blocks``) both deals out the work and answers time spans without a look at the events. Only the metadata channel,
whose size follows the number of event types, is read by the driver. Files are opened with pyarrow's file systems, by
URI, on executors.

Files whose names or headers don't parse are left out. A block that contradicts its event types raises.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the format.
MAGIC = 0x00D6B7ED
VERSION = (2, 6)
TSC_BITS = 27
ID_SIZE_TSC, ID_SIZE, ID_ONLY = 29, 30, 31
LARGE = 0xFFFF
CORE_IDS, SET_ID, SET_FORMAT = 8, 0, 1
METADATA = "metadata"
#: Fields of a block's header, without padding: cycles at begin and end, magic number, version, pointer size,
#: alignment, start (seconds, microseconds), frequency and its scale, bytes of data, of the block, losses.
HEADER = "QQIBBBBQQQIIIII"
HEADER_SIZE = struct.calcsize("<" + HEADER)

FILE_SCHEMA = "trace_id int, tracefile_id int, path string, channel string, cpu int, tid long, pgid long, creation long"
BLOCK_SCHEMA = FILE_SCHEMA + ", block int, start long, size long, data_size long, tsc_begin long, tsc_end long, begin_ns long, end_ns long, events_lost long, subbuf_corrupt long"
EVENT_SCHEMA = "trace_id int, tracefile_id int, channel string, cpu int, block int, offset long, tsc long, time_ns long, event_id int, event_name string, payload map<string,string>"


@dataclass
class Header:
    order: str
    tsc_begin: int
    tsc_end: int
    alignment: int
    pointer_size: int
    start_ns: int
    freq: int
    scale: int
    data_size: int
    size: int
    lost: int
    corrupt: int

    def nanoseconds(self, tsc: int, drift: float = 1.0, offset: float = 0.0) -> int:
        return int(float(int(drift * tsc + offset)) * 1_000_000_000 * self.scale / self.freq) if self.freq else 0


def parse_header(data: bytes) -> Header | None:
    """None if this is no block of version 2.6. The magic number says which byte order holds."""
    if len(data) < HEADER_SIZE:
        return None
    for order in "<>":
        v = struct.unpack_from(order + HEADER, data)
        if v[2] == MAGIC:
            if v[3:5] != VERSION:
                return None
            return Header(order, v[0], v[1], v[6], v[5], v[7] * 1_000_000_000 + v[8] * 1000, v[9], v[10], v[11], v[12], v[13], v[14])
    return None


def trace_version(path: str) -> tuple[int, int] | None:
    """The version that a tracefile's first block states, whether it can be read or not; None for other files."""
    with _open(path) as f:
        data = f.read(HEADER_SIZE)
    for order in "<>":
        if len(data) == HEADER_SIZE and (v := struct.unpack_from(order + HEADER, data))[2] == MAGIC:
            return v[3], v[4]
    return None


def parse_name(name: str) -> dict | None:
    """<channel>_<cpu>, with flight- before it in flight recorder mode, or that of a process's own trace, which has no
    underscore: <folder>/<folder>/<name>-<tid>.<pgid>.<creation>."""
    name = name.lstrip("/")
    if "_" in name:
        found = re.match(r"(?:flight-)?(.*)_(\d+)", name, re.DOTALL)
        return found and {"channel": found[1], "cpu": int(found[2]), "tid": None, "pgid": None, "creation": None}
    found = re.match(r"[^/]*/[^/]*/[^-]*-(\d+)\.(\d+)\.(\d+)", name)
    return found and {"channel": name, "cpu": 0, "tid": int(found[1]), "pgid": int(found[2]), "creation": int(found[3])}


@dataclass
class Field:
    name: str
    kind: str  # int, uint, pointer, string
    size: int
    network: bool


@dataclass
class Marker:
    """A type of event: what its payload holds and how it lies in memory."""

    name: str
    sizes: dict[str, int]  # int, long, pointer, size_t
    alignment: int
    fields: list[Field] = field(default_factory=list)

    @property
    def largest(self) -> int:
        return max((f.size for f in self.fields if f.kind != "string"), default=0)


_TOKEN = re.compile(r"(?P<escaped>##|%%)|#(?P<attr>n*)(?P<tq>ll|[hlLZztS1248])?(?P<tc>[cspdiouxX])|%[-+ #0]*[\d*]*(?:\.[\d*]*)?(?P<cq>ll|[hlLZzt])?(?P<cc>[cspdiouxX])|(?P<space> +)|(?P<word>[^ #%]+)")
_KINDS = {"c": "uint", "s": "string", "p": "pointer", "d": "int", "i": "int"}
_WIDTHS = {"ll": 8, "L": 8, "h": 2, "1": 1, "2": 2, "4": 4, "8": 8}
_NAMED_WIDTHS = {"l": "long", "Z": "size_t", "z": "size_t", "t": "pointer"}


def _type(qualifier: str | None, letter: str, sizes: dict[str, int]) -> tuple[str, int]:
    kind = _KINDS.get(letter, "uint")
    if letter in "csp":
        return kind, {"c": 1, "s": 0, "p": sizes["pointer"]}[letter]
    return kind, _WIDTHS.get(qualifier) or sizes[_NAMED_WIDTHS.get(qualifier, "int")]


def parse_format(fmt: str, sizes: dict[str, int]) -> list[Field]:
    """Fields of a format such as "pid %d state #2d%ld": a name, then what is stored (#) if it isn't what is printed (%).
    A name is the first word before its type and ends in a space; without one it is "field N"."""
    out, name, ended, stored, network = [], None, False, None, False
    for m in _TOKEN.finditer(fmt):
        if m["tc"]:
            stored, network = _type(m["tq"], m["tc"], sizes), "n" in m["attr"]
        elif m["cc"]:
            shown = _type(m["cq"], m["cc"], sizes)
            kind, size = shown if stored is None or shown[0] == "string" else stored
            out.append(Field(name if name and ended else f"field {len(out) + 1}", kind, 0 if kind == "string" else size, network))
            name, ended, stored, network = None, False, None, False
        elif m["space"]:
            ended = ended or name is not None
        elif m["word"] and name is None:
            name = m["word"]
    return out


def align(at: int, size: int, alignment: int) -> int:
    """The bytes to skip from ``at`` for something of this size."""
    step = min(alignment, size)
    return -at % step if step else 0


def _string(data: bytes, at: int) -> tuple[str, int]:
    end = data.index(b"\0", at)
    return data[at:end].decode("utf-8", "replace"), end + 1


def _payload(data: bytes, at: int, marker: Marker, order: str) -> tuple[dict[str, str], int, int]:
    """Values, where the payload begins once it is aligned, and its size."""
    begin = at + align(at, marker.largest, marker.alignment)
    offset, values = 0, {}
    for f in marker.fields:
        if f.kind == "string":
            values[f.name], end = _string(data, begin + offset)
            offset = end - begin
        else:
            offset += align(offset, f.size, marker.alignment)
            raw = data[begin + offset : begin + offset + f.size]
            values[f.name] = str(int.from_bytes(raw, "big" if f.network or order == ">" else "little", signed=f.kind == "int"))
            offset += f.size
    return values, begin, offset


def _core(data: bytes, at: int, event_id: int, h: Header) -> tuple[tuple, int]:
    """An event of the metadata channel, and where it ends."""
    channel, pos = _string(data, at)
    name, pos = _string(data, pos)
    if event_id == SET_FORMAT:
        fmt, pos = _string(data, pos)
        return ("format", channel, name, fmt), pos
    pos += align(pos, 2, h.alignment)
    number, int_, long_, pointer, size_t, alignment = struct.unpack_from(h.order + "HBBBBB", data, pos)
    return ("id", channel, name, number, {"int": int_, "long": long_, "pointer": pointer, "size_t": size_t}, alignment), pos + 7


def decode_block(data: bytes, h: Header, markers: dict[int, Marker] | None) -> Iterator[tuple]:
    """(offset, tsc, event_id, name, payload) of each event; with no markers, those of a metadata channel, whose last
    two are None and the event as _core gives it."""
    at, tsc, mask = HEADER_SIZE, h.tsc_begin, (1 << TSC_BITS) - 1
    while at < h.data_size:
        offset = at
        at += align(at, 4, h.alignment)
        (packed,) = struct.unpack_from(h.order + "I", data, at)
        at += 4
        event_id, low, size = packed >> TSC_BITS, packed & mask, None
        code = event_id
        if code in (ID_SIZE_TSC, ID_SIZE, ID_ONLY):
            (event_id,) = struct.unpack_from(h.order + "H", data, at)
            at += 2
            if code != ID_ONLY:
                (size,) = struct.unpack_from(h.order + "H", data, at)
                at += 2
                if size == LARGE:
                    (size,) = struct.unpack_from(h.order + "I", data, at)
                    at += 4
        if code == ID_SIZE_TSC:
            at += align(at, 8, h.alignment)
            (tsc,) = struct.unpack_from(h.order + "Q", data, at)
            at += 8
        else:
            tsc = (tsc & ~mask) + (low if low >= tsc & mask else low + mask + 1)
        if markers is None:
            if event_id not in (SET_ID, SET_FORMAT):
                raise ValueError(f"the metadata channel holds an event of id {event_id}")
            core, at = _core(data, at, event_id, h)
            yield offset, tsc, event_id, None, core
            continue
        marker = markers.get(event_id)
        if marker is None:
            raise ValueError(f"no type of event has id {event_id}")
        values, begin, length = _payload(data, at, marker, h.order)
        if size is not None and size != length:
            raise ValueError(f"event {marker.name} has {size} bytes, its type {length}")
        at = begin + length
        yield offset, tsc, event_id, marker.name, values
    if at != h.data_size and h.data_size > HEADER_SIZE:
        raise ValueError("an event goes beyond its block's data")


def _open(path: str):
    system, inner = fs.FileSystem.from_uri(path)
    return system.open_input_file(inner)


def _headers(path: str) -> Iterator[tuple[int, Header]]:
    """Where each block of a file begins, by the chain of their sizes, and its header."""
    with _open(path) as f:
        start, end = 0, f.size()
        while start < end:
            f.seek(start)
            h = parse_header(f.read(HEADER_SIZE))
            if h is None or not HEADER_SIZE <= h.data_size <= h.size:
                return
            yield start, h
            start += h.size


def _block(path: str, start: int, size: int) -> bytes:
    with _open(path) as f:
        f.seek(start)
        return f.read(size)


def tracefiles(spark: SparkSession, *roots: str) -> DataFrame:
    """The files of the traces at these folders (URIs), by name; ids follow the order of roots and of paths."""
    rows = []
    for trace_id, root in enumerate(roots):
        system, inner = fs.FileSystem.from_uri(root)
        files = sorted(i.path for i in system.get_file_info(fs.FileSelector(inner, recursive=True)) if i.type == fs.FileType.File)
        for path in files:
            relative = path[len(inner.rstrip("/")) + 1 :]
            known = parse_name(relative)
            if known:
                rows.append((trace_id, len(rows), f"{root.rstrip('/')}/{relative}", known["channel"], known["cpu"], known["tid"], known["pgid"], known["creation"]))
    return spark.createDataFrame(rows, FILE_SCHEMA)


def blocks(files: DataFrame, drift: float = 1.0, offset: float = 0.0) -> DataFrame:
    """A row per block, from headers alone. Its times are those of its first and last cycle count."""
    names = [c.split()[0] for c in FILE_SCHEMA.split(", ")]

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                rows, first = [], None
                for n, (start, h) in enumerate(_headers(r["path"])):
                    first = first or h
                    rows.append(r | {
                        "block": n, "start": start, "size": h.size, "data_size": h.data_size, "tsc_begin": h.tsc_begin, "tsc_end": h.tsc_end,
                        "begin_ns": first.nanoseconds(h.tsc_begin, drift, offset), "end_ns": first.nanoseconds(h.tsc_end, drift, offset), "events_lost": h.lost, "subbuf_corrupt": h.corrupt,
                    })
                    if len(rows) == 10_000:
                        yield pa.RecordBatch.from_pylist(rows, block_schema)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, block_schema)

    whole = {"int": pa.int32(), "long": pa.int64(), "string": pa.string()}
    block_schema = pa.schema([(n, whole[t]) for n, t in (c.split() for c in BLOCK_SCHEMA.split(", "))])
    # One file to a task: the chain of a file's blocks is followed header by header.
    return files.select(*names).repartition(max(1, min(files.count(), 10_000)), "path").mapInArrow(run, BLOCK_SCHEMA)


def markers(spark: SparkSession, *roots: str) -> DataFrame:
    """Every type of event: trace_id, channel, marker_id, name, format, alignment and sizes."""
    rows = []
    for (trace_id, channel, number), (marker, fmt) in _registry(tracefiles(spark, *roots).where(F.col("channel") == METADATA)).items():
        rows.append((trace_id, channel, number, marker.name, fmt, marker.alignment, marker.sizes, [(f.name, f.kind, f.size) for f in marker.fields]))
    return spark.createDataFrame(rows, "trace_id int, channel string, marker_id int, name string, format string, alignment int, sizes map<string,int>, fields array<struct<name:string,kind:string,size:int>>")


def _registry(metadata: DataFrame) -> dict[tuple[int, str, int], tuple[Marker, str]]:
    """Types by trace, channel and id. A name may have several ids, with sizes of their own; its format is one."""
    out, formats = {}, {}
    for r in metadata.orderBy("tracefile_id").collect():
        for start, h in _headers(r.path):
            for _, _, _, _, event in decode_block(_block(r.path, start, h.data_size), h, None):
                kind, channel, name, *rest = event
                if kind == "format":
                    if formats.setdefault((r.trace_id, channel, name), rest[0]) != rest[0]:
                        raise ValueError(f"{channel}.{name} has two formats")
                else:
                    out[r.trace_id, channel, rest[0]] = Marker(name, rest[1], rest[2])
    for (trace, channel, _), m in out.items():
        m.fields = parse_format(formats.get((trace, channel, m.name), ""), m.sizes)
    return {k: (m, formats.get((k[0], k[1], m.name), "")) for k, m in out.items()}


def read_events(spark: SparkSession, *roots: str, start_ns: int | None = None, end_ns: int | None = None, drift: float = 1.0, offset: float = 0.0) -> DataFrame:
    """The events of the traces at these folders. With a time range, blocks that lie outside it are not read; it is
    exclusive at its end. drift and offset correct the cycle counter before it becomes nanoseconds."""
    files = tracefiles(spark, *roots)
    known = {}
    for (trace, channel, number), (marker, _) in _registry(files.where(F.col("channel") == METADATA)).items():
        known.setdefault((trace, channel), {})[number] = marker
    shared = spark.sparkContext.broadcast(known)
    table = blocks(files.where(F.col("channel") != METADATA), drift, offset)
    if start_ns is not None:
        table = table.where(F.col("end_ns") >= start_ns)
    if end_ns is not None:
        table = table.where(F.col("begin_ns") < end_ns)
    schema = pa.schema([
        ("trace_id", pa.int32()), ("tracefile_id", pa.int32()), ("channel", pa.string()), ("cpu", pa.int32()), ("block", pa.int32()), ("offset", pa.int64()), ("tsc", pa.int64()),
        ("time_ns", pa.int64()), ("event_id", pa.int32()), ("event_name", pa.string()), ("payload", pa.map_(pa.string(), pa.string())),
    ])

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                data = _block(r["path"], r["start"], r["data_size"])
                h, rows = parse_header(data), []
                fixed = (r["trace_id"], r["tracefile_id"], r["channel"], r["cpu"], r["block"])
                # The frequency at the file's beginning holds for all of it, and is in each header.
                for at, tsc, event_id, name, values in decode_block(data, h, shared.value.get((r["trace_id"], r["channel"]), {})):
                    rows.append((*fixed, at, tsc, h.nanoseconds(tsc, drift, offset), event_id, name, list(values.items())))
                    if len(rows) == 10_000:
                        yield _batch(rows, schema)
                        rows = []
                if rows:
                    yield _batch(rows, schema)

    out = table.repartition("path", "block").mapInArrow(run, EVENT_SCHEMA)
    if start_ns is not None:
        out = out.where(F.col("time_ns") >= start_ns)
    return out if end_ns is None else out.where(F.col("time_ns") < end_ns)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), t.type) for c, t in zip(zip(*rows), schema)], schema=schema)


def time_spans(table: DataFrame) -> DataFrame:
    """Least and greatest time per tracefile, channel, trace and over all, from the blocks' headers."""
    return table.groupingSets([("trace_id", "channel", "tracefile_id"), ("trace_id", "channel"), ("trace_id",), ()], "trace_id", "channel", "tracefile_id").agg(F.min("begin_ns").alias("start_ns"), F.max("end_ns").alias("end_ns"))
