"""Media columns: TIFF files held in a binary column.

``read_pages`` walks the image directories of a file (either byte order), decodes uncompressed, PackBits, LZW or
deflate strips and tiles, undoes horizontal differencing, and gives one page per directory; ``tiff_pages`` emits these
as one row per page. Samples of 1, 2 and 4 bits come back as a byte each, separate planes side by side. ``write_tiff``
stores bytes as 8-bit samples over pages of at most 64 KiB, whose forms take turns: deflate strips, deflate tiles,
PackBits strips, LZW strips and plain tiles, the deflate and LZW ones with horizontal differencing.

Sizes in a directory are believed only as far as the bytes behind them allow: no page is larger than its compressed
segments can expand to, nor than ``PAGE_BYTES``, which is checked before memory is taken.

Defined results: null text counts as empty, whose payload is 64 zero bytes; a null file gives no rows; a null id is
returned as null; of a file that is no TIFF, is cut short, or whose directories form a loop, the pages before the
fault are rows and the fault is one more row with ``error`` set; equal texts give equal values, repeated rows give
repeated rows, an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

WIDTH, PAGE_ROWS, STRIP_ROWS, TILE = 64, 1024, 256, 32
#: The largest page that is decoded.
PAGE_BYTES = 1 << 30
# Fixed values of the TIFF 6.0 format: field types' sizes, compressions and tags.
SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
PLAIN, LZW, ADOBE_DEFLATE, PACKBITS, DEFLATE = 1, 5, 8, 32773, 32946
SUBFILE, COLS, ROWS, BITS, COMPRESSION, PHOTOMETRIC, STRIP_AT, SAMPLES, ROWS_PER_STRIP, STRIP_BYTES, PLANAR, PREDICTOR, TILE_WIDTH, TILE_ROWS, TILE_AT, TILE_BYTES = 254, 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317, 322, 323, 324, 325
#: How many bytes a compressed byte stands for at most: a repeat of 128 from two bytes, a string of 4096 from 12 bits
#: or less, and deflate's own bound.
GROWTH = {PLAIN: 1, PACKBITS: 64, LZW: 3641, ADOBE_DEFLATE: 1032, DEFLATE: 1032}


class BadTiff(ValueError):
    pass


@dataclass
class Page:
    width: int
    height: int
    samples: int
    bits: int
    compression: int
    tiled: bool
    data: bytes


def packbits_encode(data: bytes) -> bytes:
    """Runs of three and more as repeats where the data has any, else literals of 128 bytes."""
    a = np.frombuffer(data, np.uint8)
    if len(a) < 3 or not ((a[2:] == a[1:-1]) & (a[1:-1] == a[:-2])).any():
        return b"".join(bytes((len(c) - 1,)) + c for c in (data[i : i + 128] for i in range(0, len(data), 128)))
    edges = np.flatnonzero(np.concatenate(([True], a[1:] != a[:-1], [True])))
    out, literal = [], 0
    for start, end in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        if end - start >= 3:
            out += [bytes((len(c) - 1,)) + c for c in (data[i : min(i + 128, start)] for i in range(literal, start, 128))]
            for i in range(start, end, 128):
                n = min(128, end - i)
                out.append(bytes((257 - n if n > 1 else 0, data[i])))
            literal = end
    out += [bytes((len(c) - 1,)) + c for c in (data[i : i + 128] for i in range(literal, len(data), 128))]
    return b"".join(out)


def packbits_decode(data: bytes, size: int) -> bytes:
    out, i, have, n = [], 0, 0, len(data)
    while have < size and i < n:
        head = data[i]
        if head < 128:
            piece = data[i + 1 : i + 2 + head]
            i += 2 + head
        elif head > 128:
            piece = data[i + 1 : i + 2] * (257 - head)
            i += 2
        else:
            piece = b""
            i += 1
        out.append(piece)
        have += len(piece)
    return b"".join(out)[:size]


def lzw_decode(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, most significant bit first, widened one code early; 256 clears and 257 ends."""
    first = [bytes((i,)) for i in range(256)] + [b"", b""]
    table, width, held, bits, out, last = first[:], 9, 0, 0, [], None
    for byte in data:
        held = (held << 8 | byte) & 0xFFFFFF
        bits += 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits & (1 << width) - 1
        if code == 257:
            break
        if code == 256:
            table, width, last = first[:], 9, None
            continue
        if last is None:
            entry = table[code]
        else:
            if code > len(table):
                raise BadTiff("LZW code out of order")
            entry = table[code] if code < len(table) else last + last[:1]
            table.append(last + entry[:1])
            width = 9 if len(table) < 511 else 10 if len(table) < 1023 else 11 if len(table) < 2047 else 12
        out.append(entry)
        last = entry
    return b"".join(out)


def lzw_encode(data: bytes) -> bytes:
    """Counterpart of lzw_decode, for files and tests."""
    out, held, bits = bytearray(), 0, 0

    def put(code: int, width: int) -> None:
        nonlocal held, bits
        held, bits = held << width | code, bits + width
        while bits >= 8:
            bits -= 8
            out.append(held >> bits & 255)
        held &= (1 << bits) - 1

    codes = {bytes((i,)): i for i in range(256)}
    following, width, word = 258, 9, b""
    put(256, 9)
    for i in range(len(data)):
        c = data[i : i + 1]
        if word + c in codes:
            word += c
            continue
        put(codes[word], width)
        codes[word + c] = following
        following += 1
        if following == 4094:
            put(256, 12)
            codes = {bytes((k,)): k for k in range(256)}
            following, width = 258, 9
        else:
            width = 9 if following < 512 else 10 if following < 1024 else 11 if following < 2048 else 12
        word = c
    if word:
        put(codes[word], width)
        following += 1
        width = 9 if following < 512 else 10 if following < 1024 else 11 if following < 2048 else 12
    put(257, width)
    if bits:
        out.append(held << 8 - bits & 255)
    return bytes(out)


def _expand(raw: bytes, compression: int, size: int) -> bytes:
    if compression == PLAIN:
        got = raw
    elif compression in (ADOBE_DEFLATE, DEFLATE):
        got = zlib.decompressobj().decompress(raw, size + 1)
    elif compression == PACKBITS:
        got = packbits_decode(raw, size)
    elif compression == LZW:
        got = lzw_decode(raw)
    else:
        raise BadTiff(f"compression {compression}")
    if len(got) < size:
        raise BadTiff("segment is cut short")
    return got[:size]


def _directories(data: bytes):
    if len(data) < 8 or data[:4] not in (b"II*\0", b"MM\0*"):
        raise BadTiff("no TIFF header")
    e, seen = "<" if data[:1] == b"I" else ">", set()
    at = struct.unpack_from(e + "I", data, 4)[0]
    while at:
        if at in seen:
            raise BadTiff("directories form a loop")
        seen.add(at)
        fields = {}
        (n,) = struct.unpack_from(e + "H", data, at)
        for k in range(n):
            tag, kind, count, value = struct.unpack_from(e + "HHI4s", data, at + 2 + 12 * k)
            if kind not in (1, 3, 4):
                continue
            code, size = {1: "B", 3: "H", 4: "I"}[kind], SIZES[kind] * count
            place, source = (0, value) if size <= 4 else (struct.unpack(e + "I", value)[0], data)
            fields[tag] = struct.unpack_from(f"{e}{count}{code}", source, place)
        yield e, fields
        (at,) = struct.unpack_from(e + "I", data, at + 2 + 12 * n)


def _undo(block: bytes, rows: int, cols: int, samples: int, bits: int, predictor: int, e: str) -> np.ndarray:
    if bits < 8:
        if predictor != 1:
            raise BadTiff("predictor on samples of less than a byte")
        each = np.unpackbits(np.frombuffer(block, np.uint8).reshape(rows, -1), axis=1)
        weights = 1 << np.arange(bits - 1, -1, -1, dtype=np.uint8)
        return (each.reshape(rows, -1, bits) * weights).sum(2, dtype=np.uint8)[:, : cols * samples].reshape(rows, cols, samples)
    a = np.frombuffer(block, np.dtype(f"{e}u{bits // 8}")).reshape(rows, cols, samples)
    if predictor == 2:
        a = np.cumsum(a, axis=1, dtype=a.dtype.newbyteorder("="))
    elif predictor != 1:
        raise BadTiff(f"predictor {predictor}")
    return a


def _page(data: bytes, e: str, f: dict[int, tuple[int, ...]]) -> Page:
    def one(tag: int, default: int) -> int:
        return f.get(tag, (default,))[0]

    width, height, samples, bits = one(COLS, 0), one(ROWS, 0), one(SAMPLES, 1), one(BITS, 1)
    compression, predictor, planes = one(COMPRESSION, PLAIN), one(PREDICTOR, 1), samples if one(PLANAR, 1) == 2 else 1
    if bits not in (1, 2, 4, 8, 16) or len(set(f.get(BITS, ()))) > 1:
        raise BadTiff("samples of other than 1, 2, 4, 8 or 16 bits")
    if compression not in GROWTH:
        raise BadTiff(f"compression {compression}")
    if not (width and height and samples):
        raise BadTiff("a page without samples")
    tiled, each = TILE_AT in f, samples // planes
    at, lengths = (f[TILE_AT], f[TILE_BYTES]) if tiled else (f[STRIP_AT], f[STRIP_BYTES])
    high, wide = (one(TILE_ROWS, 0), one(TILE_WIDTH, 0)) if tiled else (min(one(ROWS_PER_STRIP, height), height), width)
    if not (high and wide):
        raise BadTiff("segments without rows or columns")
    down, across = -(-height // high), -(-width // wide)
    if not len(at) == len(lengths) == down * across * planes:
        raise BadTiff("the number of segments doesn't fit the page")
    row_bytes = -(-wide * each * bits // 8)
    held = sum(min(n, max(0, len(data) - a)) for a, n in zip(at, lengths, strict=True))
    if down * across * planes * row_bytes * (high if tiled else 1) > held * GROWTH[compression] or width * height * samples * max(1, bits // 8) > min(PAGE_BYTES, held * GROWTH[compression] * max(1, 8 // bits)):
        raise BadTiff("the page is larger than its segments can hold")
    page = np.zeros((height, width, samples), f"u{max(8, bits) // 8}")
    for k, (start, size) in enumerate(zip(at, lengths, strict=True)):
        plane, place = divmod(k, down * across)
        r, c = place // across * high, place % across * wide
        rows = high if tiled else min(high, height - r)
        block = _undo(_expand(data[start : start + size], compression, rows * row_bytes), rows, wide, each, bits, predictor, e)
        h, w = min(rows, height - r), min(wide, width - c)
        page[r : r + h, c : c + w, plane * each : (plane + 1) * each] = block[:h, :w]
    return Page(width, height, samples, bits, compression, tiled, page.tobytes())


def pages_of(data: bytes) -> Iterator[Page]:
    """The pages in turn; BadTiff at the first fault, after the pages before it."""
    try:
        for e, fields in _directories(data):
            yield _page(data, e, fields)
    except (struct.error, zlib.error, KeyError, IndexError, ValueError) as error:
        raise BadTiff(str(error)) from error


def read_pages(data: bytes) -> list[Page]:
    return list(pages_of(data))


#: The forms that the pages of a written file take in turn, and how each compression packs a block.
FORMS = ((ADOBE_DEFLATE, False), (ADOBE_DEFLATE, True), (PACKBITS, False), (LZW, False), (PLAIN, True))
PACK = {ADOBE_DEFLATE: lambda block: zlib.compress(block, 1), PACKBITS: packbits_encode, LZW: lzw_encode, PLAIN: bytes}


def write_tiff(payload: bytes) -> bytes:
    """payload (a positive multiple of WIDTH) as 8-bit grey samples, little-endian, one directory per page."""
    if not payload or len(payload) % WIDTH:
        raise ValueError("the payload must be a positive multiple of the width")
    rows, out, link = len(payload) // WIDTH, [b"II*\0\0\0\0\0"], (0, 4)
    size = 8
    for number, top in enumerate(range(0, rows, PAGE_ROWS)):
        height, (compression, tiled) = min(PAGE_ROWS, rows - top), FORMS[number % len(FORMS)]
        grid = np.frombuffer(payload, np.uint8, height * WIDTH, top * WIDTH).reshape(height, WIDTH)
        predictor = 2 if compression in (ADOBE_DEFLATE, LZW) else 1
        if tiled:
            whole = np.vstack((grid, np.zeros((-height % TILE, WIDTH), np.uint8)))
            cut = [whole[r : r + TILE, c : c + TILE] for r in range(0, height, TILE) for c in range(0, WIDTH, TILE)]
        else:
            cut = [grid[r : r + STRIP_ROWS] for r in range(0, height, STRIP_ROWS)]
        blocks = [PACK[compression]((np.diff(block, axis=1, prepend=np.uint8(0)) if predictor == 2 else block).tobytes()) for block in cut]
        places = []
        for b in blocks:
            places.append(size)
            b += b"\0" * (len(b) & 1)
            out.append(b)
            size += len(b)
        lengths = [len(b) for b in blocks]
        tags = [(SUBFILE, 4, [2]), (COLS, 4, [WIDTH]), (ROWS, 4, [height]), (BITS, 3, [8]), (COMPRESSION, 3, [compression]), (PHOTOMETRIC, 3, [1]), (SAMPLES, 3, [1]), (PREDICTOR, 3, [predictor])]
        tags += [(TILE_WIDTH, 4, [TILE]), (TILE_ROWS, 4, [TILE]), (TILE_AT, 4, places), (TILE_BYTES, 4, lengths)] if tiled else [(STRIP_AT, 4, places), (ROWS_PER_STRIP, 4, [STRIP_ROWS]), (STRIP_BYTES, 4, lengths)]
        fields = []
        for tag, kind, values in sorted(tags):
            raw = struct.pack(f"<{len(values)}{'I' if kind == 4 else 'H'}", *values)
            if len(raw) > 4:
                out.append(raw)
                raw, size = struct.pack("<I", size), size + len(raw)
            fields.append(struct.pack("<HHI4s", tag, kind, len(values), raw))
        out[link[0]] = out[link[0]][: link[1]] + struct.pack("<I", size) + out[link[0]][link[1] + 4 :]
        out.append(struct.pack("<H", len(fields)) + b"".join(fields) + b"\0\0\0\0")
        link = (len(out) - 1, 2 + 12 * len(fields))
        size += 2 + 12 * len(fields) + 4
    return b"".join(out)


def padded(data: bytes) -> bytes:
    return data + b"\0" * (-len(data) % WIDTH or (WIDTH if not data else 0))


def feature(payload: bytes) -> str:
    """Mean, deviation and entropy of the samples, mean step along a row, and the number of distinct samples."""
    a = np.frombuffer(payload, np.uint8)
    counts = np.bincount(a, minlength=256)
    p = counts[counts > 0] / len(a)
    steps = np.abs(np.diff(a.reshape(-1, WIDTH).astype(np.int16), axis=1))
    return f"mean={a.mean():.4f};std={a.std():.4f};entropy={float(-(p * np.log2(p)).sum()):.4f};step={steps.mean():.4f};distinct={len(p)}"


def tiff_pages(df: DataFrame, id_col: str, media_col: str) -> DataFrame:
    """One row per page of each file: id, page, width, height, samples, bits, compression, tiled, data, error."""
    names = ["id", "page", "width", "height", "samples", "bits", "compression", "tiled", "data", "error"]
    kinds = [pa.int64(), *[pa.int32()] * 6, pa.bool_(), pa.binary(), pa.string()]

    def run(batches):
        for batch in batches:
            for i, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if data is None:
                    continue
                pages = pages_of(data)
                for k in count():
                    try:
                        p = next(pages, None)
                    except BadTiff as error:
                        row = (i, *[None] * 8, str(error))
                    else:
                        if p is None:
                            break
                        row = (i, k, p.width, p.height, p.samples, p.bits, p.compression, p.tiled, p.data, None)
                    yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds, strict=True)], names=names)
                    if row[-1]:
                        break

    schema = "id bigint, page int, width int, height int, samples int, bits int, compression int, tiled boolean, data binary, error string"
    return df.selectExpr(f"cast(`{id_col}` as bigint) as id", f"`{media_col}` as media").mapInArrow(run, schema)


def text_round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text stored as TIFF, read back page by page, and what was read described."""
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "pages"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32()]

    def run(batches):
        for batch in batches:
            rows = []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data = (text or "").encode("utf-8", "surrogatepass")
                media = write_tiff(padded(data))
                pages = read_pages(media)
                back = b"".join(p.data for p in pages)
                rows.append((i, len(data), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature(back), len(pages)))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names)

    schema = "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, pages int"
    return docs.selectExpr(f"cast(`{id_col}` as bigint) as doc_id", f"cast(`{text_col}` as string) as text").mapInArrow(run, schema)
