"""Finding repeated windows of units (words or bytes) across a corpus without comparing documents pairwise.

Each window of W units has an anchor, the least hash of its K-unit grams, so equal windows have equal anchors wherever
they are. Consecutive windows with one anchor form a *segment* (their units together). Documents are dealt into groups
by a hash of id and text, anchors into buckets, and the two take turns:

1. by group: the distinct anchors of a group go to their buckets, each with the units of its segments;
2. by bucket: anchors that two places have, or one place twice, come back to the groups that have them. One whose
   segments are together longer than ``SPLIT`` units is marked;
3. by group: the units of each segment with such an anchor go to its bucket, equal ones of a group once with their
   number; of a marked anchor every window goes on its own, to the bucket of its own hash, so that no anchor makes a
   large index, however common it is;
4. by bucket: an index over the texts of whole anchors (the operators' own: suffix automaton, suffix array) says which
   windows repeat, and the verdicts come back to the groups;
5. by group: verdicts meet their places, and spans their documents.

Grams of bytes repeat by chance, the more the larger the corpus, so for bytes a round is put between 2 and 3 (``narrow``).
A segment with a repeated anchor is cut in two, windows that have at least half of their other units before the anchor,
and the rest; all windows of a part hold the same units beside the anchor, whose hash is the part's key. Keys go to
their buckets as anchors did, and only parts whose key repeats have their units sent in step 3. A window's part and key
follow from the window alone, so equal windows have equal keys. Short texts of bytes are hashed end to end, long ones in
blocks, and segments are gone through in arrays but for their texts and for anchors that several texts have.

Hashes only say where units meet; whether they are equal is decided by comparing the units themselves. A bucket hears
of an anchor or of a text at most once from a group, however often the group has it, so a passage in a third of all
documents is one short row a group. What travels are columns of numbers packed for each pair of group and bucket.

A group's rows are of equal id and text or differ in their mark, a 64-bit hash of the text; a null id is kept apart
from every number by the mark.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import clean_shuffles, dropped, dropped_part, shuffle_partitions, written

#: Units of an anchor's segments from which it is split into windows; units of text in one index; windows of a segment.
SPLIT, INDEX_UNITS, SEGMENT_WINDOWS = 100_000, 200_000, 512
#: Units that are hashed at once, and bytes: texts end to end; segments of a group, and bytes of their texts, that are held
#: before they are sent.
BLOCK, BYTES, HELD_SEGMENTS, HELD_BYTES = 1 << 20, 1 << 15, 2_000_000, 64 << 20
#: Numbers for which a look into slots costs more than a search.
FEW = 200
#: Buckets for each partition, which a task takes one after the other.
BUCKETS = 4

_U = np.uint64
_GROW = 0x9E3779B97F4A7C15
_SHRINK = pow(_GROW, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    a = np.full(n, base, _U)
    a[0] = 1
    return np.multiply.accumulate(a)


class _Tables:
    """Powers for rolling hashes, made once per worker and doubled when a longer text comes."""

    grow, shrink = _powers(_GROW, 1 << 16), _powers(_SHRINK, 1 << 16)

    @classmethod
    def need(cls, n: int) -> None:
        if n > len(cls.grow):
            size = 1 << (n - 1).bit_length()
            cls.grow, cls.shrink = _powers(_GROW, size), _powers(_SHRINK, size)


def mixed(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: neighbouring values end far apart."""
    h = h ^ (h >> _U(33))
    h *= _U(0xFF51AFD7ED558CCD)
    h ^= h >> _U(33)
    h *= _U(0xC4CEB9FE1A85EC53)
    h ^= h >> _U(33)
    return h


#: A 64-bit value for each byte.
BYTE_VALUES = mixed(np.arange(1, 257, dtype=_U) * _U(0xD6E8FEB86659FD93))


def prefix(values: np.ndarray) -> np.ndarray:
    _Tables.need(len(values) + 1)
    out = np.zeros(len(values) + 1, _U)
    np.cumsum(values * _Tables.grow[: len(values)], out=out[1:])
    return out


def stretches(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the units [start, end) from their prefix sums."""
    return mixed((sums[end] - sums[start]) * _Tables.shrink[start] + (end - start).astype(_U) * _U(0xA0761D6478BD642F))


def grams(sums: np.ndarray, k: int) -> np.ndarray:
    n = len(sums) - k
    return mixed((sums[k:] - sums[:-k]) * _Tables.shrink[:n])


def sliding_least(a: np.ndarray, w: int) -> np.ndarray:
    have = 1
    while have * 2 <= w:
        a = np.minimum(a[:-have], a[have:])
        have *= 2
    return np.minimum(a[: -(w - have)], a[w - have :]) if have < w else a


def word_values(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A 64-bit hash, start and end of each word (bytes between ASCII white space)."""
    a = np.frombuffer(raw, np.uint8)
    white = ((a == 32) | ((a >= 9) & (a <= 13))).view(np.int8)
    steps = np.diff(white, prepend=np.int8(1), append=np.int8(1))
    start, end = np.flatnonzero(steps == -1), np.flatnonzero(steps == 1)
    return stretches(prefix(BYTE_VALUES[a]), start, end), start, end


def byte_values(raw: bytes) -> np.ndarray:
    return BYTE_VALUES[np.frombuffer(raw, np.uint8)]


@dataclass(frozen=True)
class Units:
    """How a text is cut: window and gram lengths, whether units are words, whether a window counts when its own
    document repeats it, from how many units an anchor is split into windows, and whether keys of parts go before texts (of
    bytes, of which only other documents' count)."""

    window: int
    gram: int
    words: bool
    within: bool
    split: int = SPLIT
    narrow: bool = False

    def values(self, raw: bytes) -> np.ndarray:
        return word_values(raw)[0] if self.words else byte_values(raw)

    def segments(self, values: np.ndarray) -> tuple[np.ndarray, ...]:
        """(pos, windows, anchor, multi) of every segment; multi: it may hold a window twice. Anchors are even."""
        parts = [self._segments(values[at : at + BLOCK + self.window - 1], at) for at in range(0, len(values) - self.window + 1, BLOCK)]
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True)) if parts else tuple(np.empty(0, t) for t in (np.int64, np.int64, _U, bool))

    def _segments(self, values: np.ndarray, at: int) -> tuple[np.ndarray, ...]:
        w = self.window - self.gram + 1
        gram = grams(prefix(values), self.gram) & ~_U(1)
        least = sliding_least(gram, w)
        fresh = np.concatenate(([True], least[1:] != least[:-1]))
        start = np.flatnonzero(fresh)
        size = np.diff(np.append(start, len(least)))
        if size.max(initial=0) > SEGMENT_WINDOWS:  # an anchor that goes on and on: cut into pieces
            start = np.concatenate([np.arange(s, s + n, SEGMENT_WINDOWS) for s, n in zip(start.tolist(), size.tolist(), strict=True)])
            size = np.diff(np.append(start, len(least)))
        anchor = least[start]
        multi = np.zeros(len(start), bool)
        if self.within:
            # How often the anchor is among the grams of its segment: places of equal grams, counted between two ends.
            order = np.argsort(gram, kind="stable")
            ranked = gram[order]
            for k in np.flatnonzero(np.searchsorted(ranked, anchor, "right") - np.searchsorted(ranked, anchor, "left") > 1).tolist():
                places = order[np.searchsorted(ranked, anchor[k], "left") : np.searchsorted(ranked, anchor[k], "right")]
                multi[k] = np.searchsorted(places, start[k] + size[k] + w - 1) - np.searchsorted(places, start[k]) > 1
        return start + at, size, anchor, multi

    def block(self, raws: list[bytes]) -> Block:
        """The segments of one text, or where units are narrow of several, together up to BYTES (one: less than a window more)."""
        if not self.narrow:
            (raw,) = raws
            values = self.values(raw)
            pos, n, anchor, multi = self.segments(values)
            return Block(self, raw, lambda: prefix(values), pos, n, anchor, multi, np.zeros(len(pos), np.int64), np.zeros(1, np.int64))
        raw = b"".join(raws)
        ends, sums = np.cumsum([len(x) for x in raws]), prefix(byte_values(raw))
        # An anchor's lowest bits are its place, so that the least is the first of equal ones.
        low = _U((1 << max(16, (BYTES + self.window).bit_length())) - 1)
        gram = grams(sums, self.gram)
        gram &= ~low
        gram |= np.arange(len(gram), dtype=_U)
        least = sliding_least(gram, self.window - self.gram + 1)
        anchor = least & ~low
        fresh = np.concatenate(([True], anchor[1:] != anchor[:-1], [True]))
        # Windows over a text's end are segments of their own, which go.
        fresh[ends[:-1]] = True
        fresh[ends - self.window + 1] = True
        start = np.flatnonzero(fresh)
        start, size = start[:-1], np.diff(start)
        text = np.searchsorted(ends, start, "right")
        whole = start + self.window <= ends[text]
        start, size, text = start[whole], size[whole], text[whole]
        if size.max(initial=0) > SEGMENT_WINDOWS:
            times = -(-size // SEGMENT_WINDOWS)
            each = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            size = np.minimum(np.repeat(size, times) - each * SEGMENT_WINDOWS, SEGMENT_WINDOWS)
            start, text = np.repeat(start, times) + each * SEGMENT_WINDOWS, np.repeat(text, times)
        multi = np.zeros(len(start), bool)
        return Block(self, raw, lambda: sums, start, size, anchor[start], multi, text, np.concatenate(([0], ends[:-1])), (least & low).view(np.int64))


@dataclass(frozen=True)
class Block:
    """Texts end to end, the prefix sums of their units and their segments: position, windows, anchor, whether it may hold a
    window twice, and which text it is of; where each text begins; where units are narrow, the first place of each window's
    anchor."""

    units: Units
    raw: bytes
    sums: Callable[[], np.ndarray]
    pos: np.ndarray
    n: np.ndarray
    anchor: np.ndarray
    multi: np.ndarray
    text: np.ndarray
    first: np.ndarray
    at: np.ndarray | None = None

    def parts(self, hit: np.ndarray) -> tuple[np.ndarray, ...]:
        """(pos, windows, key, segment) of the parts of some segments. Keys are even and have 40 bits."""
        window, gram = self.units.window, self.units.gram
        side, pos, n, owner = (window - gram) // 2, self.pos[hit], self.n[hit], hit
        several = self.at[pos] != self.at[pos + n - 1]  # its later windows hold the anchor at a later place: each window on its own
        if several.any():
            times = np.where(several, n, 1)
            inner = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            pos, n, owner = np.repeat(pos, times) + inner, np.repeat(np.where(several, 1, n), times), np.repeat(owner, times)
        at = self.at[pos]
        left = np.clip(at - side - pos + 1, 0, n)
        # By turns: windows from the units before the anchor, and those that have less before it and so more after it.
        pos, n, owner = _in_turns(pos, pos + left), _in_turns(left, n - left), np.repeat(owner, 2)
        start, end = _in_turns(at - side, at), _in_turns(at + gram, at + window - side + 1)
        some = np.flatnonzero(n)
        return pos[some], n[some], stretches(self.sums(), start[some], end[some]) >> _U(24) & ~_U(1), owner[some]

    def cut(self, start: np.ndarray, end: np.ndarray) -> Iterator[bytes]:
        """The units of each stretch; words by one space."""
        each = zip(start.tolist(), end.tolist(), strict=True)
        if not self.units.words:
            raw = self.raw
            return (raw[a:b] for a, b in each)
        words = self.raw.split()
        return (b" ".join(words[a:b]) for a, b in each)


def _in_turns(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.empty(2 * len(a), np.int64)
    out[::2], out[1::2] = a, b
    return out


class _Known:
    """A table of distinct numbers that are told with a mark, their lowest bit. Numbers are looked up by slots of equal upper bits
    of their hash: a search in a sorted table is some twenty cache misses."""

    def __init__(self, told: np.ndarray):
        keys = mixed(told & ~_U(1))
        order = np.argsort(keys)
        self.keys, self.marks = keys[order], (told & _U(1)).astype(bool)[order]
        bits = max(1, len(keys).bit_length())
        self.shift = _U(64 - bits)
        self.edges = np.zeros((1 << bits) + 1, np.int32 if len(keys) >> 31 == 0 else np.int64)
        np.cumsum(np.bincount((self.keys >> self.shift).astype(np.int64), minlength=1 << bits), out=self.edges[1:])

    def find(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the numbers the table has, and their marks."""
        keys = mixed(numbers)
        if len(keys) < FEW and len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            hit = np.flatnonzero(self.keys[at] == keys)
            return hit, self.marks[at[hit]]
        slot = (keys >> self.shift).astype(np.int64)
        at, end = self.edges[slot], self.edges[slot + 1]
        found = np.full(len(keys), -1)
        rest = np.flatnonzero(at < end)
        at = at[rest]
        while len(rest):
            here = self.keys[at] == keys[rest]
            found[rest[here]] = at[here]
            at += 1
            more = ~here & (at < end[rest])
            rest, at = rest[more], at[more]
        hit = np.flatnonzero(found >= 0)
        return hit, self.marks[found[hit]]


def packed(*columns: np.ndarray | bytes) -> bytes:
    """Columns as one compressed value: their sizes in bytes, then they themselves."""
    parts = [c if isinstance(c, bytes) else c.tobytes() for c in columns]
    raw = struct.pack(f"<{len(parts)}Q", *map(len, parts)) + b"".join(parts)
    return struct.pack("<Q", len(raw)) + pa.compress(raw, codec="zstd", asbytes=True)


def unpacked(blob: bytes, *kinds: str) -> list:
    """The columns of packed(); a kind of "" gives bytes."""
    raw = pa.decompress(blob[8:], struct.unpack_from("<Q", blob)[0], codec="zstd", asbytes=True)
    at, out = 8 * len(kinds), []
    for size, kind in zip(struct.unpack_from(f"<{len(kinds)}Q", raw), kinds, strict=True):
        out.append((np.frombuffer(raw, kind, size // np.dtype(kind).itemsize, at) if size else np.empty(0, kind)) if kind else raw[at : at + size])
        at += size
    return out


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return (mixed(keys) % _U(buckets)).astype(np.int64)


def _by(key: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each value of key with the positions that have it."""
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    edges = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1], [True]))) if len(key) else []
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        yield int(ranked[a]), order[a:b]


def _batch(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=names)


def _batches(rows: Iterable[tuple], schema: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Rows whose last column is bytes, in batches of bounded size."""
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = [{"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary()}[c.split()[1]] for c in schema.split(", ")]
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[-1]) + 100
        if size > most:
            yield _batch(held, names, kinds)
            held, size = [], 0
    if held:
        yield _batch(held, names, kinds)


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _grouped(rows: Iterable[tuple]) -> Iterator[tuple[int, list[tuple]]]:
    """Rows come sorted by their first column: each value with its rows, without it."""
    key, held = None, []
    for first, *rest in rows:
        if held and first != key:
            yield key, held
            held = []
        key = first
        held.append(tuple(rest))
    if held:
        yield key, held


#: A column of documents as groups see them: what comes before them, if anything, has a smaller kind.
DOCS = ("g", "kind", "doc_id", "mark", "text", "blob")


def _documents(docs: DataFrame, id_col: str, text_col: str, n: int, kind: int) -> DataFrame:
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    slim = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text.alias("text"))
    mark = F.xxhash64("text", F.col("doc_id").isNull())
    return slim.select(F.pmod(F.xxhash64("doc_id", mark), F.lit(n)).cast("int").alias("g"), F.lit(kind).alias("kind"), "doc_id", mark.alias("mark"), "text", F.lit(None).cast("binary").alias("blob"))


def _blobs(df: DataFrame, kind: int) -> DataFrame:
    return df.select("g", F.lit(kind).alias("kind"), F.lit(None).cast("bigint").alias("doc_id"), F.lit(None).cast("bigint").alias("mark"), F.lit(None).cast("string").alias("text"), "blob")


#: A text of a block: document id, mark, and where in the document the text begins.
Part = tuple[int | None, int | None, int]


def _in_blocks(units: Units, rows: Iterable[tuple]) -> Iterator[tuple[int, list[bytes], list[Part], Block]]:
    """Rows of DOCS, a group's blobs before its documents: group, its blobs (one list a group), texts, their block."""
    last, blobs = None, []
    texts: list[Part] = []
    raws: list[bytes] = []
    size = 0
    for g, kind, doc_id, mark, text, blob in rows:
        if g != last:
            if raws:
                yield last, blobs, texts, units.block(raws)
            last, blobs, texts, raws, size = g, [], [], [], 0
        if kind == 0:
            blobs.append(blob)
            continue
        raw = text.encode()
        for at in range(0, len(raw) - units.window + 1, BYTES) if units.narrow else (0,):
            piece = raw[at : at + BYTES + units.window - 1] if units.narrow else raw
            if raws and (not units.narrow or size + len(piece) > BYTES):
                yield g, blobs, texts, units.block(raws)
                texts, raws, size = [], [], 0
            texts.append((doc_id, mark, at))
            raws.append(piece)
            size += len(piece)
    if raws:
        yield last, blobs, texts, units.block(raws)


def _anchors(units: Units, buckets: int):
    """Step 1. Rows (g, text) of one group."""

    def sent(g: int, held: list[tuple]) -> Iterator[tuple]:
        anchor, size, multi = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.argsort(anchor, kind="stable")
        anchor, size, multi = anchor[order], size[order], multi[order]
        start = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1]))) if len(anchor) else np.empty(0, np.int64)
        if len(start):
            places = np.diff(np.append(start, len(anchor)))
            twice = (places > 1) | np.logical_or.reduceat(multi, start)
            total = np.minimum(np.add.reduceat(size, start), units.split + 1).astype(np.uint32)
            each = anchor[start] | twice.astype(_U)
            for bucket, at in _by(bucket_of(anchor[start], buckets)):
                yield bucket, g, packed(each[at], total[at])

    def rows(batches):
        held: list[tuple] = []
        size, last = 0, None
        for g, _, _, block in _in_blocks(units, ((g, 1, None, None, text, None) for g, text in _rows(batches))):
            if held and (g != last or size > HELD_SEGMENTS):
                yield from sent(last, held)
                held, size = [], 0
            held.append((block.anchor, block.n + units.window - 1, block.multi))
            size, last = size + len(block.n), g
        if held:
            yield from sent(last, held)

    def run(batches):
        yield from _batches(rows(batches), "bucket int, g int, blob binary")

    return run


def _repeated(units: Units):
    """Step 2. Rows (bucket, g, blob) sorted by bucket; the anchors that repeat, odd if they are to be split."""

    def rows(batches):
        for _, held in _grouped(_rows(batches)):
            parts = [unpacked(blob, "<u8", "<u4") for _, blob in held]
            flat, sizes = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
            anchors, which, places = np.unique(flat & ~_U(1), return_inverse=True, return_counts=True)
            often = (places > 1) | (np.bincount(which, flat & _U(1)) > 0)
            told = anchors | (np.bincount(which, sizes) > units.split).astype(_U)
            at = 0
            for (g, _), (own, _) in zip(held, parts, strict=True):
                here = which[at : at + len(own)]
                at += len(own)
                if len(found := told[here[often[here]]]):
                    yield g, packed(found)

    def run(batches):
        yield from _batches(rows(batches), "g int, blob binary")

    return run


def _halves(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of 40 bits for packed()."""
    return (keys & _U(0xFFFFFFFF)).astype("<u4"), (keys >> _U(32)).astype("u1")


def _joined(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    return low.astype(_U) | high.astype(_U) << _U(32)


def _keys(units: Units, buckets: int):
    """Between 2 and 3. Rows of DOCS, a group's repeated anchors before its documents: the distinct keys of parts, with
    whether the group has one twice (1) and whether its anchor is to be split (2)."""

    def sent(g: int, held: list[tuple]) -> Iterator[tuple]:
        every, split = (np.concatenate(x) for x in zip(*held, strict=True))
        keys, which, places = np.unique(every, return_inverse=True, return_counts=True)
        told = ((places > 1) + 2 * (np.bincount(which, split, len(keys)) > 0)).astype("u1")
        for bucket, at in _by(bucket_of(keys, buckets)):
            yield bucket, g, packed(*_halves(keys[at]), told[at])

    def rows(batches):
        last, repeated = None, None
        held: list[tuple] = []
        size = 0
        for g, blobs, _, block in _in_blocks(units, _rows(batches)):
            if held and (g != last or size > HELD_SEGMENTS):
                yield from sent(last, held)
                held, size = [], 0
            if g != last:
                last, repeated = g, _Known(np.concatenate([np.empty(0, _U), *(unpacked(b, "<u8")[0] for b in blobs)]))
            hit, split = repeated.find(block.anchor)
            if len(hit):
                _, _, keys, owner = block.parts(hit)
                held.append((keys, split[np.searchsorted(hit, owner)].astype(np.int8)))
                size += len(keys)
        if held:
            yield from sent(last, held)

    def run(batches):
        yield from _batches(rows(batches), "bucket int, g int, blob binary")

    return run


def _repeated_keys(batches):
    """Rows (bucket, g, blob) sorted by bucket; the keys that repeat, odd if the anchor of any part is to be split, so that
    all places of a key hear the same."""

    def rows():
        for _, held in _grouped(_rows(batches)):
            parts = [(g, _joined(low, high), told) for g, (low, high, told) in ((g, unpacked(blob, "<u4", "u1", "u1")) for g, blob in held)]
            told = np.concatenate([p[2] for p in parts])
            keys, which, places = np.unique(np.concatenate([p[1] for p in parts]), return_inverse=True, return_counts=True)
            often = (places > 1) | (np.bincount(which, told & 1) > 0)
            keys |= (np.bincount(which, told & 2) > 0).astype(_U)
            at = 0
            for g, own, _ in parts:
                here = which[at : at + len(own)]
                at += len(own)
                if len(found := keys[here[often[here]]]):
                    yield g, packed(*_halves(found))

    yield from _batches(rows(), "g int, blob binary")


class _Texts:
    """Step 3: the distinct texts of a group's segments, and the places that have them."""

    def __init__(self, units: Units, repeated: np.ndarray):
        self.units = units
        self.repeated = _Known(repeated)
        self.base = 0
        self.clear()

    def clear(self) -> None:
        self.refs: dict[bytes, int] = {}
        self.bytes = 0
        self.docs: list[tuple[int, int, int]] = []  # id, mark, places
        self.places: list[tuple[np.ndarray, ...]] = []  # positions, texts, anchors, ids

    def add(self, texts: list[Part], block: Block) -> None:
        units, window, pos, n, anchor, owner = self.units, self.units.window, block.pos, block.n, block.anchor, block.text
        if units.narrow:
            pos, n, key, segment = block.parts(np.arange(len(pos)))
            anchor, owner = anchor[segment], owner[segment]
            hit, apart = self.repeated.find(key)
            segment = segment[hit]
        else:
            hit, apart = self.repeated.find(anchor)
        if not len(hit):
            return
        pos, n, anchor, owner = pos[hit], n[hit], anchor[hit], owner[hit]
        if units.narrow:
            # Parts of one segment that both go are one text.
            first = np.flatnonzero(np.concatenate(([True], (segment[1:] != segment[:-1]) | (pos[1:] != pos[:-1] + n[:-1]) | apart[1:] | apart[:-1])))
            pos, n, anchor, owner, apart = pos[first], np.add.reduceat(n, first), anchor[first], owner[first], apart[first]
        if apart.any():
            times = np.where(apart, n, 1)
            inner = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            pos, n, anchor, owner, apart = np.repeat(pos, times) + inner, np.repeat(np.where(apart, 1, n), times), np.repeat(anchor, times), np.repeat(owner, times), np.repeat(apart, times)
            anchor[apart] = grams(block.sums(), window)[pos[apart]]
        known, put, have = len(self.refs), self.refs.setdefault, self.refs.__len__
        refs = np.array([put(piece, have()) for piece in block.cut(pos, pos + n + window - 1)])
        if len(self.refs) > known:
            self.bytes += sum(map(len, islice(reversed(self.refs), len(self.refs) - known))) + 100 * (len(self.refs) - known)
        ids = np.array([i or 0 for i, _, _ in texts], np.int64)
        counts = np.bincount(owner, minlength=len(texts))
        self.docs += [(i or 0, mark, m) for (i, mark, _), m in zip(texts, counts.tolist(), strict=True) if m]
        begins = np.array([at for _, _, at in texts]) - block.first
        self.places.append((pos + begins[owner], refs, anchor, ids[owner]))

    def sent(self, g: int, buckets: int) -> Iterator[tuple[int, int, bytes]]:
        """(kind 0, bucket, texts) and (kind 1, g, places)."""
        if self.docs:
            pieces = list(self.refs)
            at, refs, every, ids = (np.concatenate(x) for x in zip(*self.places, strict=True))
            anchors, copies, least = np.empty(len(pieces), _U), np.bincount(refs).astype("<u4"), np.full(len(pieces), (1 << 63) - 1)
            anchors[refs] = every
            np.minimum.at(least, refs, ids)
            places, texts = at.astype("<u4"), refs.astype("<u4") + np.uint32(self.base)
            sizes = np.array([len(p) for p in pieces], "<u4")
            for bucket, at in _by(bucket_of(anchors, buckets)):
                refs = (at + self.base).astype("<u4")
                yield 0, bucket, struct.pack("<I", g) + packed(anchors[at], copies[at], least[at], refs, sizes[at], b"".join([pieces[k] for k in at.tolist()]))
            ids, marks, counts = (np.array(x, kind) for x, kind in zip(zip(*self.docs, strict=True), ("<i8", "<i8", "<u4"), strict=True))
            yield 1, g, packed(ids, marks, counts, places, texts)
            self.base += len(pieces)
            self.clear()


def _texts(units: Units, buckets: int):
    """Step 3. Rows of DOCS, a group's repeated anchors before its documents."""

    def rows(batches):
        held, last = None, None
        for g, blobs, texts, block in _in_blocks(units, _rows(batches)):
            if g != last:
                if held is not None:
                    yield from held.sent(last, buckets)
                told = (_joined(*unpacked(b, "<u4", "u1")) if units.narrow else unpacked(b, "<u8")[0] for b in blobs)
                held, last = _Texts(units, np.concatenate([np.empty(0, _U), *told])), g
            held.add(texts, block)
            if held.bytes > HELD_BYTES:
                yield from held.sent(g, buckets)
        if held is not None:
            yield from held.sent(last, buckets)

    def run(batches):
        yield from _batches(rows(batches), "kind int, key int, blob binary")

    return run


#: (anchor, number of the text, its units, copies, least id), and (number of the text, spans of windows to remove).
Segment = tuple[int, int, bytes, int, int]
Resolver = Callable[[Units, list[Segment]], Iterator[tuple[int, list[tuple[int, int, int | None]]]]]
#: Stands for no least id: the window goes wherever it is.
ANY = -(1 << 63)


def _verdicts(units: Units, resolve: Resolver):
    """Step 4. Rows (bucket, blob) sorted by bucket; whole anchors are indexed together up to INDEX_UNITS units."""

    def bucket_rows(held: list[tuple]) -> Iterator[tuple[int, bytes]]:
        parts = [unpacked(blob[4:], "<u8", "<u4", "<i8", "<u4", "<u4", "") for (blob,) in held]
        anchors, copies, least, refs, sizes = (np.concatenate([p[k] for p in parts]) for k in range(5))
        groups = np.repeat([struct.unpack_from("<I", blob)[0] for (blob,) in held], [len(p[0]) for p in parts])
        text = b"".join([p[5] for p in parts])
        del parts
        end = np.cumsum(sizes, dtype=np.int64)
        start = end - sizes
        order = np.argsort(anchors, kind="stable")
        found: list[tuple[np.ndarray, ...]] = []  # group, its number for the text, stretch of windows, least id
        if not units.within:
            # Of anchors with one text there is nothing to sort: all its windows are where the text is.
            ranked = anchors[order]
            lead = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1])))
            times = np.diff(np.append(lead, len(order)))
            model = np.repeat(order[lead], times)
            one = np.fromiter((text[a:b] == text[c:d] for a, b, c, d in zip(start[order].tolist(), end[order].tolist(), start[model].tolist(), end[model].tolist(), strict=True)), bool, len(order))
            one = np.logical_and.reduceat(one, lead)
            goes = np.repeat(one & (np.add.reduceat(copies[order], lead, dtype=np.int64) > 1), times)
            low = np.repeat(np.minimum.reduceat(least[order], lead), times)[goes]
            at = order[goes]
            found.append((groups[at], refs[at], np.zeros(len(at), "<u4"), sizes[at] - units.window + 1, low))
            order = order[np.repeat(~one, times)]
        owners: list[list[int]] = []  # for each text, the rows that have it
        told: list[tuple[int, int, int, int]] = []
        index: list[Segment] = []
        group: dict[bytes, list[int]] = {}
        size, last = 0, None

        def judged() -> None:
            for number, spans in resolve(units, index) if index else ():
                for row in owners[number]:
                    told.extend((row, a, b, ANY if low is None else low) for a, b, low in spans)
            index.clear()
            owners.clear()

        def settled() -> None:
            nonlocal size
            for piece, (number, n, low) in group.items():
                index.append((last, number, piece, n, low))
                size += piece.count(b" ") + 1 if units.words else len(piece)
            group.clear()
            if size >= INDEX_UNITS:
                judged()
                size = 0

        for row, anchor, n, low, a, b in zip(order.tolist(), *(c[order].tolist() for c in (anchors, copies, least, start, end)), strict=True):
            if anchor != last:
                settled()
                last = anchor
            piece = text[a:b]
            if (seen := group.get(piece)) is None:
                group[piece] = [len(owners), n, low]
                owners.append([row])
            else:
                seen[1] += n
                seen[2] = min(seen[2], low)
                owners[seen[0]].append(row)
        settled()
        judged()
        if told:
            rows, *spans = (np.array(c, kind) for c, kind in zip(zip(*told, strict=True), ("<i8", "<u4", "<u4", "<i8"), strict=True))
            found.append((groups[rows], refs[rows], *spans))
        if found:
            group_of, *cols = (np.concatenate(c) for c in zip(*found, strict=True))
            for g, at in _by(group_of):
                yield g, packed(*(c[at].astype(kind) for c, kind in zip(cols, ("<u4", "<u4", "<u4", "<i8"), strict=True)))

    def run(batches):
        yield from _batches((row for _, held in _grouped(_rows(batches)) for row in bucket_rows(held)), "g int, blob binary")

    return run


def _spans(units: Units, places: list[bytes], verdicts: list[bytes]) -> dict[tuple[int, int], list[tuple[int, int]]]:
    """Step 5: the spans of units to remove from each document (id or 0, mark) of a group, sorted and united."""
    told = [unpacked(v, "<u4", "<u4", "<u4", "<i8") for v in verdicts]
    if not told or not places:
        return {}
    ref, a, b, low = (np.concatenate([t[k] for t in told]) for k in range(4))
    order = np.argsort(ref, kind="stable")
    ref, a, b, low = ref[order], a[order].astype(np.int64), b[order].astype(np.int64), low[order]
    out: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for blob in places:
        ids, marks, counts, at, refs = unpacked(blob, "<i8", "<i8", "<u4", "<u4", "<u4")
        first, last = np.searchsorted(ref, refs, "left"), np.searchsorted(ref, refs, "right")
        times = last - first
        place = np.repeat(np.arange(len(refs)), times)
        said = np.arange(len(place)) - np.repeat(np.cumsum(times) - times, times) + first[place]
        doc = np.repeat(np.arange(len(ids)), counts)[place]
        goes = (low[said] == ANY) | (ids[doc] > low[said])
        place, said, doc = place[goes], said[goes], doc[goes]
        start = at[place].astype(np.int64) + a[said]
        end = at[place].astype(np.int64) + b[said] + (units.window - 1)
        for d, held in _by(doc):
            mine = out.setdefault((int(ids[d]), int(marks[d])), [])
            mine += zip(start[held].tolist(), end[held].tolist(), strict=True)
    return {key: united(sorted(spans)) for key, spans in out.items()}


#: Called with (id, text, spans) of some documents; gives a batch of what is returned for them.
Finish = Callable[[list[tuple[int | None, bytes, list[tuple[int, int]]]]], pa.RecordBatch]


def _applied(units: Units, finish: Finish):
    """Step 5. Rows of DOCS: a group's places (kind 0), verdicts (1), documents (2)."""

    def run(batches):
        last, blobs, spans = None, ([], []), None
        held: list[tuple] = []
        size = 0
        for g, kind, doc_id, mark, text, blob in _rows(batches):
            if g != last:
                last, blobs, spans = g, ([], []), None
            if kind < 2:
                blobs[kind].append(blob)
                continue
            if spans is None:
                spans = _spans(units, *blobs)
            raw = text.encode()
            held.append((doc_id, raw, spans.get((doc_id or 0, mark), [])))
            size += len(raw)
            if len(held) == 1000 or size > 8 << 20:
                yield finish(held)
                held, size = [], 0
        if held:
            yield finish(held)

    return run


def without_repeats(docs: DataFrame, id_col: str, text_col: str, units: Units, resolve: Resolver, finish: Finish, schema: str) -> DataFrame:
    """finish over all documents with the spans of units that repeated windows cover."""
    spark = docs.sparkSession
    n = shuffle_partitions(spark)
    buckets = BUCKETS * n
    here = F.pmod("bucket", F.lit(n)).cast("int")
    # Where only documents with a smaller id count, those without an id neither lose nor take.
    grouped = _documents(docs if units.within else docs.where(F.col(f"`{id_col}`").isNotNull()), id_col, text_col, n, 1)
    anchors = grouped.select("g", "text").repartitionById(n, F.col("g")).mapInArrow(_anchors(units, buckets), "bucket int, g int, blob binary")
    repeated = written(anchors.repartitionById(n, here).sortWithinPartitions("bucket").mapInArrow(_repeated(units), "g int, blob binary"), "repeated-anchors")
    clean_shuffles(spark)
    both = _blobs(repeated, 0).unionByName(grouped)
    if units.narrow:
        keys = both.repartitionById(n, F.col("g")).sortWithinPartitions("g", "kind").mapInArrow(_keys(units, buckets), "bucket int, g int, blob binary")
        narrower = written(keys.repartitionById(n, here).sortWithinPartitions("bucket").mapInArrow(_repeated_keys, "g int, blob binary"), "repeated-keys")
        dropped(repeated)
        clean_shuffles(spark)
        repeated = narrower
        both = _blobs(repeated, 0).unionByName(grouped)
    texts = written(both.repartitionById(n, F.col("g")).sortWithinPartitions("g", "kind").mapInArrow(_texts(units, buckets), "kind int, key int, blob binary"), "segment-texts", "kind")
    dropped(repeated)
    clean_shuffles(spark)
    dealt = texts.where("kind = 0").select(F.col("key").alias("bucket"), "blob").repartitionById(n, here).sortWithinPartitions("bucket")
    verdicts = written(dealt.mapInArrow(_verdicts(units, resolve), "g int, blob binary"), "verdicts")
    clean_shuffles(spark)
    dropped_part(texts, "kind=0")
    places = texts.where("kind = 1").select(F.col("key").alias("g"), "blob")
    all_rows = _blobs(places, 0).unionByName(_blobs(verdicts, 1)).unionByName(_documents(docs, id_col, text_col, n, 2))
    return all_rows.repartitionById(n, F.col("g")).sortWithinPartitions("g", "kind").mapInArrow(_applied(units, finish), schema)


def runs(flags: list[int | None] | list[bool], none: object = None) -> Iterator[tuple[int, int, object]]:
    """(start, end, value) of the runs of equal values other than none."""
    start = 0
    for i in range(1, len(flags) + 1):
        if i == len(flags) or flags[i] != flags[start]:
            if flags[start] != none:
                yield start, i, flags[start]
            start = i


def united(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted spans with those that touch or overlap made one."""
    out: list[tuple[int, int]] = []
    for a, b in spans:
        if out and a <= out[-1][1]:
            if b > out[-1][1]:
                out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out
