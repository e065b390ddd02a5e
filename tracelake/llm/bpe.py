"""BPE encoding and decoding by tree concatenation, for vocabularies with word ends.

A text is normalised and cut as the tokenizers file says (NFC, white space to one space, lower case; runs of letters, single
digits, runs of other signs). Words are looked up among those already encoded. A piece that no pattern splits and that
is longer than ``LEAF`` symbols is cut in halves, again and again; leaves are encoded on their own, side by side, and two encoded
halves are joined by encoding a window around the join anew, which grows until its first and last pair agree with the
halves on either side. (A list of tokens is the encoding of its text when each pair of neighbours is the encoding of
theirs, so agreement at both edges of a window makes the whole exact.)

Defined results: null text counts as empty and has no tokens; strings of special tokens become their ids, as the
library does by default; decoding joins token strings with spaces, which is what the library does for a file without
a decoder; rows are independent, so repeated rows repeat their result; a null id is returned as null; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import struct
import sys
import unicodedata
from array import array
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from tokenizers import Tokenizer
from tokenizers.models import BPE

LITTLE = sys.byteorder == "little" and array("I").itemsize == 4
#: Symbols of a leaf, words held by a worker at once, and the longest word that is held.
LEAF, HELD_WORDS, HELD_LENGTH = 256, 400_000, 64

# The tokenizers file's split pattern for characters below U+0180 and common punctuation.
LETTERS, NUMBERS = "A-Za-zªµºÀ-ÖØ-öø-ſ", "0-9²³¹¼½¾"
PIECES = re.compile(rf"[{LETTERS}]+|'s|'t|'re|'ve|'m|'ll|'d|[{NUMBERS}]|[^\s{LETTERS}{NUMBERS}]+")
#: Texts with any other character, or with signs that Python alone takes for white space, are cut by the library, whose
#: tables of characters are of another Unicode version than Python's.
UNUSUAL = re.compile("[\x1c-\x1f\u0130\u0180-\u2009\u200b-\u200f\u2028-\u2038\u203a-\u20ab\u20ad-\U0010ffff]")


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable Latin-1 for itself, the others counted up from 256."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


class Bpe:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.end: str = model["end_of_word_suffix"] or ""
        self.ranks = {(a, b): k for k, (a, b) in enumerate(model["merges"])}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.around_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        self.letters = byte_letters()
        self.held: dict[str, tuple[bytes, str]] = {}
        self.library = Tokenizer.from_file(path)
        self.short = self.library.model.tokenize
        #: The same merges without an end of words, for what lies before the last leaf.
        self.leaves = Tokenizer(BPE(vocab=self.vocab, merges=[tuple(m) for m in model["merges"]]))

    def merge(self, symbols: list[str]) -> list[str]:
        """The lowest-ranked pair first, leftmost among equals, until no pair has a rank."""
        n = len(symbols)
        if n < 2:
            return symbols
        ranks, none = self.ranks, len(self.ranks)
        if n <= 24:
            symbols = symbols[:]
            while len(symbols) > 1:
                found = [ranks.get(p, none) for p in zip(symbols, symbols[1:], strict=False)]
                low = min(found)
                if low == none:
                    break
                a, b = symbols[k := found.index(low)], symbols[k + 1]
                out, i, last = symbols[:k], k, len(symbols) - 1
                while i <= last:
                    if i < last and symbols[i] == a and symbols[i + 1] == b:
                        out.append(a + b)
                        i += 2
                    else:
                        out.append(symbols[i])
                        i += 1
                symbols = out
            return symbols
        parts: list[str | None] = list(symbols)
        after, before = [*range(1, n), -1], list(range(-1, n - 1))
        heap = [(ranks[p], i, *p) for i, p in enumerate(zip(symbols, symbols[1:], strict=False)) if p in ranks]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if parts[i] != a or j < 0 or parts[j] != b:
                continue
            parts[i], parts[j], after[i] = a + b, None, after[j]
            if after[j] >= 0:
                before[after[j]] = i
                if (r := ranks.get((a + b, parts[after[j]]))) is not None:
                    heapq.heappush(heap, (r, i, a + b, parts[after[j]]))
            if (h := before[i]) >= 0 and (r := ranks.get((parts[h], a + b))) is not None:
                heapq.heappush(heap, (r, h, parts[h], a + b))
        return [p for p in parts if p is not None]

    def spread(self, tokens: list[str]) -> list[str]:
        """The symbols that merging starts from."""
        out: list[str] = []
        for t in tokens:
            stem = t.removesuffix(self.end) if self.end else t
            out += stem
            if stem != t:
                out[-1] += self.end
        return out

    def joined(self, left: list[str], right: list[str]) -> list[str]:
        """The encoding of left's text followed by right's."""
        agrees = lambda pair: self.merge(self.spread(pair)) == pair
        width = 1
        while True:
            a, b = max(0, len(left) - width), min(len(right), width)
            window = self.merge(self.spread(left[a:] + right[:b]))
            if (a == 0 or agrees([left[a - 1], window[0]])) and (b == len(right) or agrees([window[-1], right[b]])):
                return left[:a] + window + right[b:]
            width *= 2

    def tree(self, piece: str) -> list[str]:
        """Leaves first, all at once in the library's threads, then pairs of neighbours, level by level, so that no depth of
        text nests calls. The last leaf alone has the word's end."""
        cuts = [piece[i : i + LEAF] for i in range(0, len(piece), LEAF)]
        level = [found.tokens for found in self.leaves.encode_batch(cuts[:-1], add_special_tokens=False)]
        level.append([t.value for t in self.short(cuts[-1])])
        while len(level) > 1:
            level = [self.joined(*level[i : i + 2]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
        return level[0]

    def result(self, pieces: list[str]) -> tuple[bytes, str]:
        """Ids as bytes, and the decoded string, of pieces in byte letters; the library merges the short ones."""
        ids: list[int] = []
        tokens: list[str] = []
        for p in pieces:
            if len(p) > LEAF:
                found = self.tree(p)
                tokens += found
                ids += [self.vocab[t] for t in found]
            else:
                for t in self.short(p):
                    ids.append(t.id)
                    tokens.append(t.value)
        return array("I", ids).tobytes() if LITTLE else struct.pack(f"<{len(ids)}I", *ids), " ".join(tokens)

    def chunk(self, chunk: str) -> tuple[bytes, str]:
        """The same for one stretch without white space, which is remembered if it is short."""
        letters = self.letters
        got = self.result(["".join([letters[b] for b in p.encode()]) for p in PIECES.findall(chunk)])
        if len(chunk) <= HELD_LENGTH:
            if len(self.held) >= HELD_WORDS:
                self.held.clear()
            self.held[chunk] = got
        return got

    def encode(self, text: str) -> tuple[int, bytes, str]:
        """Number of tokens, ids as little-endian unsigned 32-bit integers, decoded string."""
        found: list[tuple[bytes, str]] = []
        held, chunk = self.held, self.chunk
        for k, stretch in enumerate(self.around_special.split(text) if "<|" in text else (text,)):
            if k % 2:
                found.append((self.special[stretch].to_bytes(4, "little"), stretch))
            elif UNUSUAL.search(stretch):
                whole = self.library.normalizer.normalize_str(stretch)
                pieces = self.library.pre_tokenizer.pre_tokenize_str(whole)
                found.append(self.result([p for p, _ in pieces if p]))
            else:
                found += [held.get(c) or chunk(c) for c in unicodedata.normalize("NFC", stretch).lower().split()]
        ids = b"".join([f[0] for f in found])
        return len(ids) // 4, ids, " ".join([f[1] for f in found if f[1]])


@cache
def model(path: str) -> Bpe:
    return Bpe(path)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encode_decode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, with_ids: bool = False) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256; with_ids adds ids (little-endian) and decoded."""
    path = vocabulary or default_vocabulary()
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids", "decoded"] * with_ids
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string()] + [pa.binary(), pa.string()] * with_ids

    def run(batches):
        bpe = model(path)
        for batch in batches:
            rows = []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                n, ids, decoded = bpe.encode(text or "")
                rows.append((i, n, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded.encode("utf-8", "surrogatepass")).hexdigest(), *((ids, decoded) if with_ids else ())))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names)

    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids binary, decoded string" * with_ids
    return docs.selectExpr(f"cast(`{id_col}` as bigint) as doc_id", f"cast(`{text_col}` as string) as text").mapInArrow(run, schema)
