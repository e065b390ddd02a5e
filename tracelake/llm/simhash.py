"""SimHash near-dedup with Golay-code fuzzy hashing.

Fingerprints: 64 bits by majority over the XXH64 of all shingles of a text. Two fingerprints link at ``DISTANCE`` (2)
or fewer differing bits. To find the links, a fingerprint is cut into three segments of 22, 21 and 21 bits. By
pigeonhole, two errors leave at least one segment without error, and the segment after it has two errors at most.
That one is padded to 23 bits and decoded with the perfect binary Golay code: its keys are the index of the codeword
it decodes to and those of the codewords its neighbours at one bit decode to, one key or six. Two words that differ
in at most two bits have a key in common (the word half-way between them decodes to it). Fingerprints that share an
exact segment and a codeword meet in a bucket, where each pair is verified bit by bit.

Equal fingerprints are one vertex, so copies never multiply. A bucket gives a star for each of its linked groups
rather than all pairs, and the groups of the whole table are joined by alternating large-star and small-star steps,
each written to the shared folder.

Defined results: null text counts as empty; a text without words has fingerprint zero, linked like any other; fewer
words than a shingle make one shingle; a bit that is set in exactly half the hashes is 0; rows equal in every column
give equal rows; a null id takes part, but is named as a component only if no other id is in it; an empty table gives
an empty result; other columns are not read by ``near_duplicates`` and all are returned by ``kept_rows``.
"""

from __future__ import annotations

from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelake.llm.common import clean_shuffles, dropped, fresh, written

DISTANCE, SEED, SHINGLE = 2, 42, 3
#: (shift, bits) of the segments; buckets up to PAIRS compare all pairs, larger ones look up every possible neighbour.
SEGMENTS, PAIRS = ((42, 22), (21, 21), (0, 21)), 2048
#: The generator polynomial of the (23, 12) Golay code.
GENERATOR = 0b101011100011


def fingerprint(text: bytes, size: int = SHINGLE) -> int:
    """text: lower case, UTF-8."""
    from xxhash import xxh64_intdigest

    words = text.split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]
    hashes = np.fromiter((xxh64_intdigest(s, SEED) for s in shingles), "<u8", len(shingles))
    total = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 4096):
        total += np.unpackbits(hashes[i : i + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(total * 2 > len(hashes), bitorder="little").view("<u8")[0])


@cache
def _syndromes() -> tuple[np.ndarray, np.ndarray]:
    """The syndrome of every 23-bit word's low and high half, and the error pattern of each syndrome."""
    basis = np.zeros(23, np.int64)
    for i in range(23):
        rest = 1 << i
        for k in range(i, 10, -1):
            if rest >> k & 1:
                rest ^= GENERATOR << k - 11
        basis[i] = rest
    errors = np.zeros(2048, np.int64)
    for n in (1, 2, 3):
        for bits in combinations(range(23), n):
            errors[np.bitwise_xor.reduce(basis[list(bits)])] = sum(1 << b for b in bits)
    return basis, errors


def decode(words: np.ndarray) -> np.ndarray:
    """The index (12 bits) of the codeword nearest to each 23-bit word."""
    basis, errors = _syndromes()
    syndrome = np.zeros(len(words), np.int64)
    for i in range(23):
        syndrome ^= np.where(words >> i & 1, basis[i], 0)
    return (words ^ errors[syndrome]) >> 11


def bucket_keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, position of the fingerprint) of every distinct key of every fingerprint."""
    keys, owners = [], []
    prints = prints.astype(np.uint64)
    parts = [(prints >> np.uint64(s) & np.uint64((1 << b) - 1)).astype(np.int64) for s, b in SEGMENTS]
    for k, exact in enumerate(parts):
        fuzzy = parts[(k + 1) % 3]
        near = np.stack([decode(fuzzy), *(decode(fuzzy ^ (1 << i)) for i in range(23))], axis=1)
        near.sort(axis=1)
        fresh = np.concatenate((np.ones((len(near), 1), bool), near[:, 1:] != near[:, :-1]), axis=1)
        rows, cols = np.nonzero(fresh)
        keys.append(((k << 22) + exact[rows] << 12) + near[rows, cols])
        owners.append(rows)
    return np.concatenate(keys), np.concatenate(owners)


def links(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (positions) within DISTANCE that join whatever is joined among distinct prints, fewer than there are prints."""
    n = len(prints)
    parent = list(range(n))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def join(i: int, j: int) -> None:
        i, j = root(i), root(j)
        if i != j:
            parent[max(i, j)] = min(i, j)

    if n <= PAIRS:
        for i in range(n - 1):
            for j in np.flatnonzero(np.bitwise_count(prints[i + 1 :] ^ prints[i]) <= DISTANCE).tolist():
                join(i, i + 1 + j)
    else:
        order = np.argsort(prints)
        ranked = prints[order]
        single = [np.uint64(1 << i) for i in range(64)]
        for flip in [*single, *(a | b for a, b in combinations(single, 2))]:
            want = ranked ^ flip
            at = np.minimum(np.searchsorted(ranked, want), n - 1)
            hit = np.flatnonzero((ranked[at] == want) & (at > np.arange(n)))
            for i, j in zip(order[hit].tolist(), order[at[hit]].tolist(), strict=True):
                join(i, j)
    roots = np.array([root(i) for i in range(n)], np.int64)
    others = np.flatnonzero(roots != np.arange(n))
    return roots[others], others


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, mark_col: str | None = None) -> DataFrame:
    """doc_id, fp (the fingerprint's 64 bits as a signed long), and the column mark_col as mark if it is given."""
    names = ["doc_id", "fp"] + ["mark"] * (mark_col is not None)

    def run(batches):
        for batch in batches:
            prints = [fingerprint((t or "").encode().lower(), size) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(prints, np.uint64).view(np.int64)), *batch.columns[2:]], names=names)

    columns = [f"cast(`{id_col}` as bigint) as doc_id", f"cast(`{text_col}` as string) as text"] + [f"`{mark_col}` as mark"] * (mark_col is not None)
    return docs.selectExpr(*columns).mapInArrow(run, "doc_id bigint, fp bigint" + ", mark string" * (mark_col is not None))


def _keyed(batches):
    for batch in batches:
        prints = batch.column(0).to_numpy()
        keys, owners = bucket_keys(prints.view(np.uint64))
        for i in range(0, len(keys), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(keys[i : i + (1 << 16)]), pa.array(prints[owners[i : i + (1 << 16)]])], names=["key", "fp"])


def _linked(batches):
    """Rows come sorted by key; a bucket that goes on in the next batch is held over."""
    keys, prints = np.empty(0, np.int64), np.empty(0, np.int64)

    def out(keys, prints):
        edges = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1], [True])))
        a, b = [], []
        sizes = np.diff(edges)
        pairs = edges[:-1][sizes == 2]
        pairs = pairs[np.bitwise_count((prints[pairs] ^ prints[pairs + 1]).view(np.uint64)) <= DISTANCE]
        a.append(prints[pairs])
        b.append(prints[pairs + 1])
        for start, size in zip(edges[:-1][sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
            group = prints[start : start + size]
            i, j = links(group.view(np.uint64))
            a.append(group[i])
            b.append(group[j])
        a, b = np.concatenate(a), np.concatenate(b)
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["u", "v"])

    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.concatenate((keys, batch.column(0).to_numpy()))
        prints = np.concatenate((prints, batch.column(1).to_numpy()))
        last = int(np.searchsorted(keys, keys[-1]))
        if last:
            yield out(keys[:last], prints[:last])
            keys, prints = keys[last:], prints[last:]
    if len(keys):
        yield out(keys, prints)


def fingerprint_links(prints: DataFrame) -> DataFrame:
    """prints: distinct fp. Verified links (u < v) that join all groups of linked fingerprints."""
    return (
        prints.select("fp").mapInArrow(_keyed, "key bigint, fp bigint")
        .repartition("key").sortWithinPartitions("key")
        .mapInArrow(_linked, "u bigint, v bigint")
        .distinct()
    )


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step. Neighbours are never gathered: a minimum per vertex (summed before the shuffle), and a join that
    adaptive execution may split where a vertex has very many edges."""
    both = edges.select(F.col("u").alias("a"), F.col("v").alias("b"))
    reverse = edges.select(F.col("v").alias("a"), F.col("u").alias("b"))
    both = both.union(reverse) if large else reverse
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("a2"), F.least("a", "m").alias("m"))
    joined = both.join(least, F.col("a") == F.col("a2"))
    if large:
        out = joined.where(F.col("b") > F.col("a")).select(F.col("m").alias("u"), F.col("b").alias("v"))
    else:
        out = joined.select(F.col("m").alias("u"), F.col("b").alias("v")).union(joined.select(F.col("m").alias("u"), F.col("a").alias("v")))
    return out.where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """v, root of every vertex that isn't the least of its component. edges: u < v, distinct."""
    edges = written(edges, "links")
    seen = None
    while True:
        total = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if total == seen:
            return edges.select("v", F.col("u").alias("root"))
        seen = total
        wide = written(_star(edges, True), "large-star")
        small = written(_star(wide, False), "small-star")
        dropped(edges, wide)
        edges = small


def _labelled(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows: doc_id, fp. (fp, least id) of the distinct fingerprints, and (fp, root) with one root for each component."""
    prints = written(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "prints")
    roots = components(fingerprint_links(prints))
    clean_shuffles(rows.sparkSession)
    return prints, prints.join(roots, prints.fp == roots.v, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE) -> DataFrame:
    """One row per document: doc_id, fingerprint, component_id."""
    rows = written(fingerprints(docs, id_col, text_col, size), "fingerprints")
    _, rooted = _labelled(rows)
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    names = rooted.join(named, "root").select(F.col("fp").alias("fp2"), "component_id")
    return rows.join(names, rows.fp == names.fp2).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def kept_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE) -> DataFrame:
    """One row of each component with all its columns: the smallest id, null ids last; of rows equal in id the one
    whose text has the smallest digest, and of rows equal in both any one."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    ident, mark = fresh(docs, "id", "mark")
    marked = docs.withColumns({ident: F.col(f"`{id_col}`").cast("long"), mark: F.sha2(text, 256)})
    rows = written(fingerprints(marked.select(F.col(ident).alias("doc_id"), text.alias("text"), F.col(mark).alias("mark")), "doc_id", "text", size, "mark"), "fingerprints")
    prints, rooted = _labelled(rows)
    # The best row of each fingerprint before that of each component: both are summed in each task first.
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")).alias("first")
    firsts = rows.groupBy("fp").agg(first).join(rooted.select(F.col("fp").alias("fp2"), "root"), F.col("fp") == F.col("fp2"))
    best = firsts.groupBy("root").agg(F.min("first").alias("first"))
    return first_rows(marked, ident, mark, best).select(*[F.col(f"`{c}`") for c in docs.columns])


def first_rows(marked: DataFrame, ident: str, mark: str, best: DataFrame) -> DataFrame:
    """The rows of marked that best names by their id and mark, ``first`` of each group; of rows equal in both, one."""
    place, two, three = fresh(marked, "place", "id2", "mark2")
    keep = best.select(F.col("first.doc_id").alias(two), F.col("first.mark").alias(three))
    kept = marked.join(keep, F.col(ident).eqNullSafe(F.col(two)) & (F.col(mark) == F.col(three)), "left_semi")
    one = Window.partitionBy(ident, mark).orderBy(ident)
    return kept.withColumn(place, F.row_number().over(one)).where(F.col(place) == 1)
