"""Packing by power-of-two decomposition.

A document of T tokens (its ids and the end id) is cut into T // 1024 whole sequences and, for the rest, one piece for
each binary digit of T mod 1024, longest first. Each piece is a sequence of its own: no sequence crosses documents,
and no sequence has padding, since every length is a power of two. Sequences of equal length share a bucket, from
which batches of one shape are drawn; ``sequence_id`` holds the bucket in its upper bits.

Ids come from tiktoken with the ranks of the same vocabulary, which gives the ids of the tokenizers file (tested) at
several times its speed; strings of special tokens become their ids, as the library does by default.

Defined results: null text counts as empty and gives the one piece that holds the end id; rows equal in every column
are separate documents with sequences of their own; a null id is returned as null on each of its pieces; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import base64
import zlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEQUENCE = 1024
#: sequence_id = bucket << BUCKET_SHIFT | number of the piece over partitions.
BUCKET_SHIFT = 58
SPECIAL = "<|endoftext|>"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@cache
def _encoder(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={SPECIAL: len(ranks)})


def token_ids(text: str, path: str) -> np.ndarray:
    """Ids of a whole text, then id 0, as little-endian unsigned 32-bit integers."""
    ids = _encoder(path).encode(text, allowed_special="all") if SPECIAL in text else _encoder(path).encode_ordinary(text)
    return np.array([*ids, 0], "<u4")


def cuts(total: int, sequence: int = SEQUENCE) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of total tokens."""
    whole = total - total % sequence
    out, at = [(i, sequence) for i in range(0, whole, sequence)], whole
    size = sequence >> 1
    while size:
        if total & size:
            out.append((at, size))
            at += size
        size >>= 1
    return out


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, sequence: int = SEQUENCE, with_ids: bool = False) -> DataFrame:
    """One row per piece; with_ids adds the ids themselves as an array."""
    if sequence & sequence - 1:
        raise ValueError("sequence must be a power of two")
    path = vocabulary or default_vocabulary()
    schema = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, bucket int" + ", ids array<int>" * with_ids

    def run(batches):
        for batch in batches:
            cols: list[list] = [[] for _ in range(6)]
            held = []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = token_ids(text or "", path)
                raw = memoryview(ids.tobytes())
                for start, length in cuts(len(ids), sequence):
                    for col, x in zip(cols, (i, start, length, zlib.crc32(raw[4 * start : 4 * (start + length)]), len(ids), length.bit_length() - 1), strict=True):
                        col.append(x)
                    if with_ids:
                        held.append(ids[start : start + length].astype("i4"))
            arrays = [pa.array(c, pa.int64()) for c in cols[:5]] + [pa.array(cols[5], pa.int32())]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "bucket"]
            if with_ids:
                arrays.append(pa.array(held, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    pieces = docs.selectExpr(f"cast(`{id_col}` as bigint) as doc_id", f"cast(`{text_col}` as string) as text").mapInArrow(run, schema)
    number = F.shiftleft(F.col("bucket").cast("long"), BUCKET_SHIFT).bitwiseOR(F.monotonically_increasing_id())
    return pieces.withColumns({"sequence_id": number, "offset": F.lit(0).cast("long")})


def write_buckets(pieces: DataFrame, path: str) -> None:
    """Pieces of pack(with_ids=True) as Parquet, a folder for each length, so that a reader draws batches of one shape."""
    pieces.write.partitionBy("bucket").parquet(path)
