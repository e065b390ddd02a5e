"""Substring dedup by suffix automata of reference shards.

The corpus is cut into segments around shared anchors (see ``windows``). The distinct segments are dealt into shards by
anchor; each shard's texts make one suffix automaton, in which every prefix that ends a window adds its segment's
number of copies. Segments are then streamed through their shard's automaton for matching statistics: where the match
is at least a window long, the state of the match's last ``window`` words holds the number of that window's
occurrences in the corpus, and windows that occur more than once are removed, overlaps united into maximal spans.

A broadcast of automata of the whole corpus would have each document visit each shard, which grows with the square of
the input; dealing both sides by anchor makes a document meet only the shards that can hold its windows.

Defined results: null text counts as empty; a text shorter than a window loses nothing; a window that its own document
repeats counts; rows equal in every column are separate documents, so each loses what it shares with the other; a
null id is a document like any other; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame

from tracelake.llm.automaton import SuffixAutomaton
from tracelake.llm.windows import SPLIT, Units, runs, without_repeats

WINDOW, GRAM = 35, 14
SCHEMA = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string"


def resolve(units: Units, segments):
    """Verdicts on segments (anchor, number, words joined by a space, copies, id) of whole anchors."""
    automaton = SuffixAutomaton()
    parts = [raw.split(b" ") for _, _, raw, _, _ in segments]
    for words, (_, _, _, copies, _) in zip(parts, segments, strict=True):
        automaton.add(words, copies, units.window)
    total = automaton.counted()
    for words, (_, number, _, _, _) in zip(parts, segments, strict=True):
        ends = [state >= 0 and total[state] > 1 for _, state in automaton.states(words, units.window)]
        spans = [(a, b, None) for a, b, _ in runs(ends[units.window - 1 :], False)]
        if spans:
            yield number, spans


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM, split: int = SPLIT, with_text: bool = False) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256; with_text adds the kept words."""
    names = [c.split()[0] for c in SCHEMA.split(", ")] + ["kept"] * with_text
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()][: len(names)]

    def finish(documents):
        rows = []
        for i, raw, spans in documents:
            words = raw.split()
            kept, done = [], 0
            for a, b in spans:
                kept += words[done:a]
                done = b
            kept += words[done:]
            out = b" ".join(kept)
            rows.append((i, len(words), len(words) - len(kept), hashlib.sha256(out).hexdigest(), out.decode() if with_text else None))
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names)

    return without_repeats(docs, id_col, text_col, Units(window, min(gram, window), True, True, split), resolve, finish, SCHEMA + ", kept string" * with_text)
