"""Language ID by cross-parsing entropy.

For each language a suffix automaton holds a bounded sample of labelled text. A text's words, in lower case and joined
by single spaces, are parsed against each automaton into phrases, each the longest match from where the one before
ended, across words as far as it goes. A phrase of a sample of N characters costs about log N, so phrases are
normalised to log N for each; the language whose normalised phrases of the whole text are fewest wins.

The sample: per language, the ``DOCS`` labelled documents with the smallest hash of the id outside the held-out
quarter, of each its first ``DOC_CHARS`` characters, of which the first ``CHARS`` letters together are taken. It is the
classifier's only bound; prediction reads whole texts. One scan picks the documents of all languages, one fetches them.

Defined results: ``und`` with score 0 for a null text or one without a letter; ties go to the language that sorts
first; with no labelled text at all every result is ``und``; rows are independent, so repeated rows repeat their
result; a null id is never a training row and is not held out; an empty table gives an empty result; lang, source and
id are never read for a prediction. The score is one less the phrases per character: 0 if each character is a phrase.
"""

from __future__ import annotations

import re
from heapq import heapify, heapreplace
from math import log2

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelake.llm.automaton import SuffixAutomaton
from tracelake.llm.common import fresh

#: Bounds of the sample: documents of a language, characters of a document, letters of a language.
DOCS, DOC_CHARS, CHARS = 48, 20_000, 80_000
#: Characters that a language is read on for before the cheapest is chosen anew.
STRETCH = 256
UNKNOWN = "und"
HELD_OUT = 2
WORD = re.compile(r"[^\W\d_]+")


def held_out(id_col: str = "doc_id"):
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == HELD_OUT


def training_sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> dict[str, str]:
    """Text per language, at most CHARS letters each: the driver's only copy of corpus text, of bounded size."""
    labelled = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t"), F.col(lang_col).cast("string").alias("l"))
    labelled = labelled.where(F.col("l").isNotNull() & F.col("t").isNotNull() & ~F.coalesce(held_out("i"), F.lit(True)))
    # Ranks are cut to DOCS a language in each task before anything is shuffled, and no text is.
    order = Window.partitionBy("l").orderBy(F.xxhash64("i"), "i", F.xxhash64("t"))
    chosen = labelled.select("l", "i", "t").withColumn("k", F.row_number().over(order)).where(F.col("k") <= DOCS)
    chosen = chosen.select("l", "i", "k", F.substring("t", 1, DOC_CHARS).alias("t")).orderBy("l", "k")
    words: dict[str, list[str]] = {}
    sizes: dict[str, int] = {}
    for r in chosen.toLocalIterator():
        held, size = words.setdefault(r.l, []), sizes.get(r.l, 0)
        for w in WORD.findall(r.t.lower()):
            if size < CHARS:
                held.append(w)
                size += len(w)
        sizes[r.l] = size
    return {lang: spaced(held) for lang, held in words.items() if held}


def spaced(words: list[str]) -> str:
    return f" {' '.join(words)} "


def _nodes(sample: str) -> dict:
    """The root of the sample's suffix automaton, each state a table from a character to the next state's table."""
    automaton = SuffixAutomaton()
    automaton.add(sample)
    tables: list[dict] = [{} for _ in automaton.following]
    for table, following in zip(tables, automaton.following, strict=True):
        table.update((c, tables[to]) for c, to in following.items())
    return tables[0]


class CrossParser:
    def __init__(self, samples: tuple[tuple[str, str], ...]):
        self.langs = [lang for lang, _ in samples]
        self.roots = [_nodes(text) for _, text in samples]
        self.costs = [log2(len(text)) for _, text in samples]

    def advance(self, k: int, state: dict, text: str) -> tuple[int, dict]:
        """Phrases that begin in a stretch of text after its first character, and the state at its end. A character
        that a sample lacks begins a phrase, which goes on with the longest match after it."""
        n, root = 0, self.roots[k]
        for c in text:
            if c in state:
                state = state[c]
            else:
                n += 1
                state = root[c] if c in root else root
        return n, state

    def phrases(self, text: str) -> list[int]:
        """The number of phrases of a text for each language."""
        return [1 + self.advance(k, root, text)[0] for k, root in enumerate(self.roots)]

    def cheapest(self, text: str) -> tuple[int, int]:
        """The language whose normalised phrases of the whole text are fewest, and their number. Languages are read in
        stretches, always the one that is cheapest so far; as costs only grow, the first to reach the end has won, and
        the others need not be read further."""
        heap = [(cost, k, 1, 0, root) for k, (cost, root) in enumerate(zip(self.costs, self.roots, strict=True))]
        heapify(heap)
        while True:
            _, k, n, at, state = heap[0]
            if at >= len(text):
                return k, n
            more, state = self.advance(k, state, text[at : at + STRETCH])
            heapreplace(heap, ((n + more) * self.costs[k], k, n + more, at + STRETCH, state))

    def predict(self, text: str | None) -> tuple[str, float]:
        words = WORD.findall(text.lower()) if text else []
        if not self.langs or not any(c.isalpha() for w in words for c in w):
            return UNKNOWN, 0.0
        text = spaced(words)
        k, n = self.cheapest(text)
        return self.langs[k], round(1 - n / len(text), 6)


_parsers: dict[tuple[tuple[str, str], ...], CrossParser] = {}


def _parser(samples: tuple[tuple[str, str], ...]) -> CrossParser:
    """The worker's one parser; that of another sample goes before a new one is made."""
    if samples not in _parsers:
        _parsers.clear()
        _parsers[samples] = CrossParser(samples)
    return _parsers[samples]


def with_language(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", pred: str = "lang_pred", score: str = "score", samples: dict[str, str] | None = None) -> DataFrame:
    """docs with two more columns, the predicted language and its score."""
    if {pred, score} & set(docs.columns):
        raise ValueError(f"docs already has a column {pred} or {score}: name others")
    sample = training_sample(docs, id_col, text_col, lang_col) if samples is None else samples
    shared = docs.sparkSession.sparkContext.broadcast(tuple(sorted(sample.items())))
    at = docs.columns.index(text_col)

    def run(batches):
        parser = _parser(shared.value)
        for batch in batches:
            got = [parser.predict(t) for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], names=[*batch.schema.names, pred, score])

    from pyspark.sql.types import DoubleType, StringType, StructField, StructType

    schema = StructType([*docs.schema.fields, StructField(pred, StringType()), StructField(score, DoubleType())])
    return docs.mapInArrow(run, schema)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score."""
    sample = training_sample(docs, id_col, text_col, lang_col)
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return with_language(slim, "doc_id", "text", samples=sample).select("doc_id", F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"), "lang_pred", "score")


def accepted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """docs without those whose language can't be told; columns of any name pass."""
    pred, score = fresh(docs, "lang_pred", "score")
    return with_language(docs, id_col, text_col, lang_col, pred, score).where(F.col(pred) != UNKNOWN).drop(pred, score)
