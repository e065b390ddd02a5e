"""Personal data by offset-preserving deobfuscation.

Three small transducers rewrite a text and remember, for each character they write, the source characters it stands
for: (1) homoglyphs one for one, (2) spelled digits ("four two" gives 42, in runs), (3) at/dot disguises ("(at)",
"[dot]", " at ... dot "). The identifier patterns run on the plain text, which gives the base spans, and on the
rewritten text; spans found there are mapped back to source offsets and added unless one base span holds them whole.

Every pattern takes what it has read for good, so time is linear in the text: a run of a million digits, spaces or
spelled digits costs what any other text of that length does.

Defined results: null text counts as empty; offsets are code points of the source, end exclusive; base matches are
leftmost and non-overlapping per kind, and those that fail their check are dropped without a retry; a null id is
returned as null, repeated rows give repeated rows, an empty table gives an empty result; other columns are untouched,
and ``redact`` writes ``[EMAIL]`` and so on over each span, overlapping spans as one.
"""

from __future__ import annotations

import hashlib
import re
import sys
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

# The patterns of the contract, with possessive runs so that no text makes them backtrack.
KINDS = ("email", "ip", "card", "phone")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")

# Letters of other scripts that look like Latin ones, and words for digits and marks.
LOOKALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "һ": "h", "ո": "n", "ɡ": "g", "ⅼ": "l", "ѵ": "v", "ԝ": "w", "к": "k", "м": "m", "т": "t",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "У": "Y", "І": "I", "Ј": "J", "Ѕ": "S",
    "α": "a", "ο": "o", "ν": "v", "ι": "i", "κ": "k", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "․": ".", "。": ".", "｡": ".", "﹫": "@", "‐": "-", "‑": "-", "‒": "-", "–": "-", " ": " ", " ": " ", " ": " ",
}
DIGIT_WORDS = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}
MARKS = {"plus": "+", "dot": ".", "point": ".", "dash": "-", "hyphen": "-"}

_word = "|".join(DIGIT_WORDS)
#: What a run of spelled digits is made of, and a run with its separators, as long as it goes.
ITEM = re.compile(rf"(?i)(?P<digit>{_word}|[0-9]++)|plus|dot|point|dash|hyphen")
CHAIN = re.compile(rf"(?i)(?<![A-Za-z0-9])(?:plus|{_word})(?:[ .,-]*+(?:{_word}|dot|point|dash|hyphen|[0-9]++))*+")
SPELLED_HINT = re.compile(rf"(?i)\b(?:{_word})\b[ .,-]++(?:{_word}|dot|point|dash|hyphen|[0-9])")
#: Disguises of @ and of the dot. Those in brackets are matched without the blanks before them, which are added after.
AT = r"(?:\(\s?at\s?\)|\[\s?at\s?\]|\{\s?at\s?\}|<\s?at\s?>|\(\s?@\s?\)|\[\s?@\s?\]|&#64;)[ \t]*+"
DOT = r"(?:\(\s?(?:dot|\.)\s?\)|\[\s?(?:dot|\.)\s?\]|\{\s?(?:dot|\.)\s?\}|<\s?dot\s?>|&#46;)[ \t]*+"
BARE = r"(?<=[A-Za-z0-9])[ \t]++at[ \t]++(?=[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++|[ \t]++dot[ \t]++[A-Za-z0-9-]++)*?[ \t]++dot[ \t]++[A-Za-z]{2,})"
SPACED = r"(?<=[A-Za-z0-9])[ \t]++@[ \t]++(?=[A-Za-z0-9-]++[ \t]*+\.[ \t]*+[A-Za-z])"
DISGUISE = re.compile(rf"(?i)(?P<at>{AT}|{BARE}|{SPACED})|(?P<dot>{DOT}|(?<=[A-Za-z0-9])[ \t]++dot[ \t]++(?=[A-Za-z0-9]))")
DISGUISE_HINT = re.compile(r"(?i)[(\[{<]\s?(?:at|@|dot|\.)\s?[)\]}>]|&#(?:64|46);|\sdot\s|\s@\s")


def _foreign(c: str) -> str | None:
    if c in LOOKALIKES:
        return LOOKALIKES[c]
    if c >= "٠" and c.isdecimal():
        return str(unicodedata.decimal(c))
    if "！" <= c <= "～":
        return chr(ord(c) - 0xFEE0)
    return None


class _Fold(dict):
    """A table for str.translate that works out each character once."""

    def __missing__(self, code: int) -> int:
        got = _foreign(chr(code)) if code > 127 else None
        self[code] = ord(got) if got else code
        return self[code]


FOLD = _Fold()
#: Every character that FOLD changes.
FOLDABLE = frozenset(c for c in map(chr, range(128, sys.maxunicode + 1)) if _foreign(c))


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = ord(d) - 48
        if i % 2:
            x = x * 2 - 9 if x > 4 else x * 2
        total += x
    return total % 10 == 0


def find(text: str) -> dict[str, list[tuple[int, int]]]:
    """Spans of each kind by the plain patterns."""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    at, end = text.find("@"), 0
    while at >= 0:
        start = at
        while start > end and (text[start - 1].isascii() and text[start - 1].isalnum() or text[start - 1] in "._%+-"):
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            out["email"].append((start, m.end()))
            end = m.end()
        at = text.find("@", max(at + 1, end))
    if DIGIT.search(text):
        out["ip"] = [m.span() for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m[0].split("."))]
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out["card"].append(m.span())
        if "+" in text:
            out["phone"] = [m.span() for m in PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


class Tape:
    """A rewritten text with its map to the source, kept as one entry for each rewritten stretch."""

    def __init__(self, text: str):
        self.text, self.at, self.source, self.stretch = text, [0], [0], [False]

    def rewrite(self, edits: list[tuple[int, int, str, list[int]]]) -> None:
        """edits: start and end in the present text, what is written, and the place within it each character is from."""
        if not edits:
            return
        old = self.offset
        parts: list[str] = []
        marks: list[tuple[int, int, int | None]] = []  # written from, source from, source end if the stretch is an edit
        done = size = 0
        moved = []
        for start, end, new, places in edits:
            parts += [self.text[done:start], new]
            moved.append((size, done, start))
            size += start - done
            moved.append((size, places, end))
            size += len(new)
            done = end
        parts.append(self.text[done:])
        moved.append((size, done, len(self.text)))
        starts = [m[0] for m in moved]
        olds = list(moved)

        def offset(i: int, last: bool) -> int:
            """The source offset of character i, or with last the end of what character i stands for."""
            k = bisect_right(starts, i) - 1
            while k > 0 and starts[k] == starts[k - 1] and isinstance(olds[k][1], int) and olds[k][1] == olds[k][2]:
                k -= 1
            begin, from_, end = olds[k]
            if isinstance(from_, int):
                return old(from_ + i - begin, last)
            j = i - begin
            if last:
                nxt = from_[j + 1] if j + 1 < len(from_) else end
                return old(max(nxt - 1, from_[j]), True)
            return old(from_[j], False)

        self.text = "".join(parts)
        self.offset = offset

    def offset(self, i: int, last: bool) -> int:
        return i + 1 if last else i


def _spelled_runs(text: str) -> Iterator[list[re.Match]]:
    """Runs of two or more items, from a spelled digit or plus to a digit, whole words at both ends."""
    for chain in CHAIN.finditer(text):
        run = list(ITEM.finditer(text, *chain.span()))
        while run and (run[-1].lastgroup != "digit" or _alnum(text, run[-1].end())):
            run.pop()
        if len(run) > 1:
            yield run


def _alnum(text: str, at: int) -> bool:
    return 0 <= at < len(text) and text[at].isascii() and text[at].isalnum()


def _spelled_edits(text: str) -> list[tuple[int, int, str, list[int]]]:
    edits = []
    for run in _spelled_runs(text):
        new: list[str] = []
        places: list[int] = []
        words, end = 0, run[0].start()
        for m in run:
            at, w = m.start(), m[0]
            if w[0] in "0123456789":
                new.append(w)
                places += range(at, m.end())
            else:
                gap = text[end:at]
                if "." in gap or "," in gap:
                    new.append(" ")
                    places.append(end)
                digit = DIGIT_WORDS.get(w.lower())
                words += digit is not None
                new.append(digit or MARKS[w.lower()])
                places.append(at)
            end = m.end()
        if words > 1:
            edits.append((run[0].start(), end, "".join(new), places))
    return edits


def _disguise_edits(text: str) -> list[tuple[int, int, str, list[int]]]:
    edits, done = [], 0
    for m in DISGUISE.finditer(text):
        start = m.start()
        while start > done and text[start - 1] in " \t":
            start -= 1
        edits.append((start, m.end(), "@" if m["at"] else ".", [start]))
        done = m.end()
    return edits


def scan(text: str) -> tuple[dict[str, list[tuple[int, int]]], dict[str, list[tuple[int, int]]]]:
    """Base spans, and the spans that deobfuscating adds."""
    base = find(text)
    added: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    tape, changed = Tape(text), False
    if not text.isascii() and not FOLDABLE.isdisjoint(text):
        tape.text, changed = text.translate(FOLD), True
    if SPELLED_HINT.search(tape.text) and (edits := _spelled_edits(tape.text)):
        tape.rewrite(edits)
        changed = True
    if DISGUISE_HINT.search(tape.text) and (edits := _disguise_edits(tape.text)):
        tape.rewrite(edits)
        changed = True
    if changed:
        for kind, spans in find(tape.text).items():
            for start, end in spans:
                a, b = tape.offset(start, False), tape.offset(end - 1, True)
                # Base spans of a kind don't overlap, so only the last one that begins by a may hold this one.
                k = bisect_right(base[kind], a, key=lambda span: span[0]) - 1
                if not (k >= 0 and b <= base[kind][k][1]) and not _plain(text, a, b, tape.text[start:end]):
                    added[kind].append((a, b))
    return base, added


def _plain(text: str, a: int, b: int, seen: str) -> bool:
    """Whether the source has the very characters seen, so that the plain patterns had their say on them."""
    return text[a:b] == seen


def spell(spans: dict[str, list[tuple[int, int]]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in KINDS for a, b in sorted(spans[k]))


def _merged(base: dict, added: dict) -> dict:
    return {k: sorted(base[k] + added[k]) for k in KINDS}


def redact(text: str | None) -> str | None:
    if not text:
        return text
    spans = _merged(*scan(text))
    flat = sorted((a, b, k) for k in KINDS for a, b in spans[k])
    out, done = [], 0
    for a, b, k in flat:
        if a >= done:
            out += [text[done:a], f"[{k.upper()}]"]
        done = max(done, b)
    return "".join([*out, text[done:]])


SCHEMA = "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, n_added bigint"


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document with its counts of base spans, their digest, and all spans."""

    def run(batches):
        for batch in batches:
            out = []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                base, added = scan(text or "")
                out.append((i, *(len(base[k]) for k in KINDS), hashlib.sha256(spell(base).encode()).hexdigest(), spell(_merged(base, added)), sum(map(len, added.values()))))
            names = [c.split()[0] for c in SCHEMA.split(", ")]
            kinds = [pa.int64(), *[pa.int64()] * 4, pa.string(), pa.string(), pa.int64()]
            yield pa.record_batch([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names=names)

    return docs.selectExpr(f"cast(`{id_col}` as bigint) as doc_id", f"cast(`{text_col}` as string) as text").mapInArrow(run, SCHEMA)


def redact_text(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with each identifier in text_col replaced by its kind; every other column as it was."""
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            column = pa.array([redact(t) for t in batch.column(at).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([column if k == at else c for k, c in enumerate(batch.columns)], names=batch.schema.names)

    return docs.mapInArrow(run, docs.schema)


def redact_documents(docs: DataFrame, text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """redact_text, with the column of the text's length brought up to date where there is one."""
    from pyspark.sql import functions as F

    out = redact_text(docs, text_col)
    if length_col in docs.columns:
        out = out.withColumn(length_col, F.length(text_col).cast(docs.schema[length_col].dataType))
    return out.select(*docs.columns)
