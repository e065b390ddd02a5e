"""The binary source against traces written here."""

import struct

import pytest

from tracelake.sources import binary, traceset

SIZES = {"int": 4, "long": 8, "pointer": 8, "size_t": 8}


class Writer:
    """Writes blocks of one file; aligns as the format asks, from the block's beginning."""

    def __init__(self, order="<", alignment=8, freq=1_000_000_000):
        self.order, self.alignment, self.freq, self.body = order, alignment, freq, b""

    def pad(self, size):
        at, step = binary.HEADER_SIZE + len(self.body), min(size, self.alignment)
        while step and at % step:
            self.body += b"\0"
            at += 1

    def put(self, size, value):
        self.pad(size)
        self.body += struct.pack(self.order + {1: "B", 2: "H", 4: "I", 8: "Q"}[size], value)

    def event(self, event_id, tsc, payload=b"", align=0, size=None, full=False):
        low = tsc & (1 << 27) - 1
        if full:
            self.put(4, 29 << 27 | low)
            self.body += struct.pack(self.order + "HH", event_id, len(payload))
            self.put(8, tsc)
        elif size is not None:
            self.put(4, 30 << 27 | low)
            self.body += struct.pack(self.order + "HHI", event_id, 0xFFFF, size)
        elif event_id < 29:
            self.put(4, event_id << 27 | low)
        else:
            self.put(4, 31 << 27 | low)
            self.body += struct.pack(self.order + "H", event_id)
        if align:
            self.pad(align)
        self.body += payload

    def block(self, begin, end, version=(2, 6), lost=0):
        data = binary.HEADER_SIZE + len(self.body)
        size = -(-data // 4096) * 4096
        head = struct.pack(self.order + binary.HEADER, begin, end, binary.MAGIC, *version, 8, self.alignment, 5, 0, self.freq, 1, data, size, lost, 0)
        out, self.body = (head + self.body).ljust(size, b"\xee"), b""
        return out


def metadata(order):
    w = Writer(order)
    for number, name, fmt in [(8, "switch", "prev_pid %d next_pid %d prev_state #2d%ld"), (40, "open", "fd %d name %s flags #n4x%x after #8u%llu"), (9, "tick", "")]:
        w.put(4, 1 << 27 | 1)
        w.body += b"kernel\0" + name.encode() + b"\0" + fmt.encode() + b"\0"
        w.put(4, 0 << 27 | 1)
        w.body += b"kernel\0" + name.encode() + b"\0"
        w.pad(2)
        w.body += struct.pack(order + "HBBBBB", number, 4, 8, 8, 8, 8)
    return w.block(1, 2)


@pytest.mark.parametrize("order", ["<", ">"])
def test_events(spark, tmp_path, order):
    (tmp_path / "metadata_0").write_bytes(metadata(order))
    w, top = Writer(order), 1 << 27
    w.event(8, top + 5, struct.pack(order + "iih", -1, 7, -2), align=4)
    w.event(9, 2 * top + 3)  # the low bits went back: one more round
    first = w.block(top + 1, 2 * top + 3, lost=4)
    name = b"caf\xc3\xa9\0"
    body = struct.pack(order + "i", 3) + name
    body += b"\0" * (-len(body) % 4) + struct.pack(">I", 0x0102)
    body += b"\0" * (-len(body) % 8) + struct.pack(order + "Q", 1 << 40)
    w.event(40, 5 * top, body, align=8)
    w.event(9, 9 * top, full=True)
    w.event(8, 9 * top + 1, struct.pack(order + "iih", 1, 2, 3), align=4, size=10)
    (tmp_path / "flight-kernel_3").write_bytes(first + w.block(5 * top, 9 * top + 1))
    (tmp_path / "notes.txt").write_text("no trace")
    (tmp_path / "kernel_1").write_bytes(b"not a block" * 20)
    root = f"file://{tmp_path}"
    got = binary.read_events(spark, root).orderBy("tsc").collect()
    assert [(r.channel, r.cpu, r.block, r.tsc, r.time_ns, r.event_id, r.event_name) for r in got] == [
        ("kernel", 3, 0, top + 5, top + 5, 8, "switch"), ("kernel", 3, 0, 2 * top + 3, 2 * top + 3, 9, "tick"),
        ("kernel", 3, 1, 5 * top, 5 * top, 40, "open"), ("kernel", 3, 1, 9 * top, 9 * top, 9, "tick"), ("kernel", 3, 1, 9 * top + 1, 9 * top + 1, 8, "switch"),
    ]
    assert got[0].payload == {"prev_pid": "-1", "next_pid": "7", "prev_state": "-2"}
    assert got[2].payload == {"fd": "3", "name": "café", "flags": str(0x0102), "after": str(1 << 40)} and got[1].payload == {}
    assert binary.read_events(spark, root, start_ns=5 * top, end_ns=9 * top + 1).count() == 2
    files = binary.tracefiles(spark, root)
    assert {binary.trace_version(r.path) for r in files.collect()} == {(2, 6), None}
    (trace,) = traceset.traces_table(binary.blocks(files)).collect()
    assert trace.tracefiles == files.count() - 1 and trace.blocks >= trace.tracefiles and trace.start_ns <= trace.end_ns
    table = binary.blocks(binary.tracefiles(spark, root).where("channel = 'kernel'"))
    assert [(r.block, r.events_lost) for r in table.orderBy("block").collect()] == [(0, 4), (1, 0)]
    assert binary.time_spans(table).where("trace_id is null").select("start_ns", "end_ns").first() == (top + 1, 9 * top + 1)
    assert {(r.marker_id, r.name) for r in binary.markers(spark, root).collect()} == {(8, "switch"), (9, "tick"), (40, "open")}


def test_blocks_that_contradict_their_types():
    types = {8: binary.Marker("switch", SIZES, 8, binary.parse_format("a %d", SIZES))}
    for event_id, size in ((8, 5), (9, 0)):
        w = Writer()
        w.event(event_id, 1, b"\0" * 4, size=size)
        data = w.block(0, 1)
        with pytest.raises(ValueError):
            list(binary.decode_block(data, binary.parse_header(data), types))


def test_headers():
    good = Writer().block(0, 1)
    assert binary.parse_header(good).data_size == binary.HEADER_SIZE and list(binary.decode_block(good, binary.parse_header(good), {})) == []
    assert binary.parse_header(Writer().block(0, 1, version=(2, 5))) is None
    assert binary.parse_header(b"") is None and binary.parse_header(b"\0" * 200) is None


def test_formats():
    show = lambda fmt: [(f.name, f.kind, f.size) for f in binary.parse_format(fmt, SIZES)]
    assert show("") == [] and show("%%  ##") == []
    assert show("a b %d c %lu%c") == [("a", "int", 4), ("c", "uint", 8), ("field 3", "uint", 1)]
    assert show("x#2u%d p %p s #4d%s z %-5zx") == [("field 1", "uint", 2), ("p", "pointer", 8), ("s", "string", 0), ("z", "uint", 8)]


def test_names():
    assert binary.parse_name("kernel_12")["cpu"] == 12 and binary.parse_name("flight-fs_0")["channel"] == "fs"
    own = binary.parse_name("userspace/prog/run-12.10.99")
    assert (own["tid"], own["pgid"], own["creation"]) == (12, 10, 99)
    assert binary.parse_name("kernel_x") is None and binary.parse_name("notes.txt") is None
