"""Suffix-array dedup of byte strings, with the arrays made by linear grouping.

``suffix_array`` first puts suffixes into groups by their longest Lyndon prefix: all start in the group of their first
symbol; groups are taken in descending order, and for each suffix of the group taken, its previous smaller suffix
(reached over pointers of suffixes already taken) has its prefix extended by the group's, which moves it to a new
group. Then one pass over the array emits the order: the suffix before each one emitted takes the next place of its
group, and so do the suffixes that its pointers lead to, with no renaming and no recursion.

For the corpus, segments around shared anchors (see ``windows``) are dealt by anchor. Each shard's distinct texts,
trimmed to windows that another one may hold, are laid end to end between separators and sorted; suffixes with a
window in common are neighbours, and the least document id among them decides for whom the window is removed.

Defined results: null text counts as empty; matches never cross documents; what only documents with an equal id share
stays; a null id is smaller than none and greater than none, so such a document neither loses bytes nor makes others
lose them; rows equal in every column give equal rows; an empty table gives an empty result; other columns are not
read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tracelake.llm.windows import SPLIT, Units, byte_values, grams, prefix, runs, without_repeats

WINDOW, GRAM = 50, 20
SCHEMA = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"


def suffix_array(text: str) -> list[int]:
    """Starts of all suffixes in order. text: symbols by code point; its last one is smaller than every other.

    Groups are numbers in a list linked downwards, so a group that grows out of another is put right above it; moves
    are as many as there are suffixes, so time is linear but for ordering the symbols themselves."""
    n = len(text)
    if not n:
        return []
    first = {c: k for k, c in enumerate(sorted(set(text)))}
    group = [first[c] for c in text]
    members: list[list[int]] = [[] for _ in first]
    for i, g in enumerate(group):
        members[g].append(i)
    below, above = list(range(-1, len(members) - 1)), [*range(1, len(members)), -1]
    before, taken, order = [-1] * n, bytearray(n), []
    at = len(members) - 1
    while at >= 0:
        own = [i for i in members[at] if group[i] == at]
        members[at] = own
        for start in own:
            # The nearest suffix before it of a lower group; those of this group are settled on the way.
            if taken[start]:
                continue
            waiting, places = [start], [start - 1]
            while waiting:
                j = places[-1]
                while j >= 0 and taken[j]:
                    j = before[j]
                if j >= 0 and group[j] == at:
                    places[-1] = j
                    waiting.append(j)
                    places.append(j - 1)
                else:
                    i = waiting.pop()
                    places.pop()
                    before[i] = j
                    taken[i] = 1
        # A suffix grows once for each of the group's that has it before: round by round, into the group just above.
        times: dict[int, int] = {}
        for i in own:
            if (j := before[i]) >= 0:
                times[j] = times.get(j, 0) + 1
        growing, done = list(times), 0
        while growing:
            done += 1
            grown: dict[int, int] = {}
            for j in growing:
                old = group[j]
                if (new := grown.get(old)) is None:
                    new = grown[old] = len(members)
                    members.append([])
                    up = above[old]
                    below.append(old)
                    above.append(up)
                    above[old] = new
                    if up >= 0:
                        below[up] = new
                group[j] = new
                members[new].append(j)
            growing = [j for j in growing if times[j] > done]
        if own:
            order.append(own)
        at = below[at]
    place, free, at = [0] * n, [], 0
    for k, own in enumerate(reversed(order)):
        free.append(at)
        at += len(own)
        for i in own:
            place[i] = k
    out, done = [0] * n, bytearray(n)
    out[0] = n - 1
    done[n - 1] = 1
    free[place[n - 1]] += 1
    for k in range(n):
        i = out[k] - 1
        while i >= 0 and not done[i]:
            g = place[i]
            out[free[g]] = i
            free[g] += 1
            done[i] = 1
            i = before[i]
    return out


def _cores(units: Units, segments) -> list[list[tuple[int, int]]]:
    """Windows that two distinct segments may share: per segment, its stretches of such windows (start, end in bytes).
    One sort of all window hashes; a run of equal ones counts if it comes from more than one segment."""
    raws = [raw for _, _, raw, _, _ in segments]
    lengths = np.array([len(raw) for raw in raws])
    sizes = lengths - units.window + 1
    owner = np.repeat(np.arange(len(raws)), sizes)
    first = np.concatenate(([0], np.cumsum(lengths)[:-1])) - np.concatenate(([0], np.cumsum(sizes)[:-1]))
    every = grams(prefix(byte_values(b"".join(raws))), units.window)[np.arange(len(owner)) + first[owner]]
    order = np.argsort(every, kind="stable")
    ranked, from_ = every[order], owner[order]
    start = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1])))
    shared = np.minimum.reduceat(from_, start) != np.maximum.reduceat(from_, start)
    flags = np.empty(len(every), bool)
    flags[order] = np.repeat(shared, np.diff(np.append(start, len(every))))
    edges = np.flatnonzero(np.concatenate(([True], (flags[1:] != flags[:-1]) | (owner[1:] != owner[:-1]), [True])))
    start, end = edges[:-1], edges[1:]
    some = flags[start]
    start, end = start[some], end[some]
    whose = owner[start]
    base = (np.cumsum(sizes) - sizes)[whose]
    out: list[list[tuple[int, int]]] = [[] for _ in raws]
    for k, a, b in zip(whose.tolist(), (start - base).tolist(), (end - base).tolist(), strict=True):
        out[k].append((a, b))
    return out


def _lead_pieces(pieces: list[bytes]) -> tuple[list[bytes], dict[bytes, tuple[bytes, int]]]:
    """Of one anchor's pieces those that no other holds, and for each of the rest one that does and where, if it holds
    it at one place only."""
    lead: list[bytes] = []
    inside: dict[bytes, tuple[bytes, int]] = {}
    for piece in sorted(pieces, key=len, reverse=True):
        for whole in lead:
            if (at := whole.find(piece)) >= 0 and whole.find(piece, at + 1) < 0:
                inside[piece] = (whole, at)
                break
        else:
            lead.append(piece)
    return lead, inside


def _repeats(piece: bytes, window: int) -> bool:
    """Whether a piece holds one of its windows at two places."""
    n = len(piece) - window + 1
    return len({piece[k : k + window] for k in range(n)}) < n


def _sorted_lows(pieces: list[bytes], lows: dict[bytes, list[int | None]], window: int) -> None:
    """Sorts the suffixes of all pieces and gives equal windows the least id among them, in place."""
    starts, start = [], 0
    for piece in pieces:
        starts.append(start)
        start += len(piece) + 1
    joined = "\1".join(p.decode("latin-1").translate(SHIFT) for p in pieces) + "\0"
    owner = np.full(len(joined), -1, np.int64)
    for k, (s, piece) in enumerate(zip(starts, pieces, strict=True)):
        owner[s : s + len(piece) - window + 1] = k
    owner = owner.tolist()
    group: list[tuple[list[int | None], int]] = []
    lead = None

    def settle() -> None:
        low = min((x for own, k in group if (x := own[k]) is not None), default=None)
        for own, k in group:
            own[k] = low

    for i in suffix_array(joined):
        if (k := owner[i]) < 0:
            continue
        here = joined[i : i + window]
        if here != lead:
            if len(group) > 1:
                settle()
            group, lead = [], here
        group.append((lows[pieces[k]], i - starts[k]))
    if len(group) > 1:
        settle()


def resolve(units: Units, segments):
    """Verdicts on segments (anchor, seg, bytes, copies, least id) of whole anchors.

    Equal windows have equal anchors, so an anchor's pieces are matched among themselves. A piece that lies within
    another one is not sorted again: its ids go to the other's windows. Sorted are anchors with several pieces of which
    none holds the rest, and those whose one piece repeats a window, since an id given at one place holds at all."""
    window = units.window
    cores = _cores(units, segments)
    least: dict[int, dict[bytes, int | None]] = {}
    for (anchor, _, raw, _, i), spans in zip(segments, cores, strict=True):
        own = least.setdefault(anchor, {})
        for a, b in spans:
            piece = raw[a : b + window - 1]
            own[piece] = i if own.get(piece) is None else own[piece] if i is None else min(own[piece], i)
    lows: dict[int, dict[bytes, list[int | None]]] = {}
    within: dict[int, dict[bytes, tuple[bytes, int]]] = {}
    for anchor, own in least.items():
        lead, inside = _lead_pieces(list(own))
        found = {p: [own[p]] * (len(p) - window + 1) for p in lead}
        for piece, (whole, at) in inside.items():
            into, low = found[whole], own[piece]
            if low is not None:
                for k in range(at, at + len(piece) - window + 1):
                    if into[k] is None or low < into[k]:
                        into[k] = low
        lows[anchor], within[anchor] = found, inside
        if len(lead) > 1 or inside and _repeats(lead[0], window):
            _sorted_lows(lead, found, window)
    for (anchor, number, raw, copies, i), spans in zip(segments, cores, strict=True):
        if not spans:
            if copies > 1:
                yield number, [(0, len(raw) - window + 1, i)]
            continue
        out_lows: list[int | None] = [i if copies > 1 else None] * (len(raw) - window + 1)
        for a, b in spans:
            piece = raw[a : b + window - 1]
            whole, at = within[anchor].get(piece, (piece, 0))
            out_lows[a:b] = lows[anchor][whole][at : at + b - a]
        out = [(a, b, low) for a, b, low in runs(out_lows)]
        if out:
            yield number, out


#: Bytes move up by two, so that separators are smaller than all of them.
SHIFT = {b: b + 2 for b in range(256)}


def dedup_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM, split: int = SPLIT, with_text: bool = False) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256; with_text adds the bytes that stay."""
    names = [c.split()[0] for c in SCHEMA.split(", ")] + ["kept"] * with_text
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()][: len(names)]

    def finish(documents):
        rows = []
        for i, raw, spans in documents:
            kept, done = [], 0
            for a, b in spans if i is not None else ():
                kept.append(raw[done:a])
                done = b
            out = b"".join([*kept, raw[done:]])
            rows.append((i, len(raw), len(raw) - len(out), len(kept), hashlib.sha256(out).hexdigest(), out))
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names)

    return without_repeats(docs, id_col, text_col, Units(window, min(gram, window), False, False, split, True), resolve, finish, SCHEMA + ", kept binary" * with_text)
