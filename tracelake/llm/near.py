"""SimHash near-dedup by similarity: the Golay-code fuzzy hashing of ``simhash`` for texts that share most shingles.

Two texts are near copies if the sets of their five-word shingles have a similarity (shared over all) of 0.8 or more.
Such texts' fingerprints differ in up to a sixth of their bits, too many for a guarantee by pigeonhole, so fingerprints
here are longer, 192 bits of the distinct shingles, and errors are spread over more segments: for each of 24 places the
8 bits there must agree, and the 23 bits after them are decoded to nearby codewords of the Golay code, so that up to two
errors in them leave a key in common. Fingerprints that share a place, its bits and a codeword meet in a bucket, in their
order. There each follows the first leader that it is close to, or leads itself. Of all buckets' leaders a text is paired
with the one that the most follow in a bucket, so a group of copies gives stars, and there are fewer pairs than texts
however large a group is. Every pair is verified on the texts' own shingles.

A vertex is a set of shingles, so equal sets never multiply; sets of one fingerprint are paired with the first of them.
Verified pairs are joined to groups by ``simhash.components``.

Fingerprints find near copies by the chances of their bits, so an exact way follows for what they miss, and it decides
beforehand which texts can have a near copy at all. Shingles are put in one order for the whole corpus, rarest first
(by counts made as in ``windows``: groups of documents tell buckets of hashes, buckets answer). Two sets of a similarity
of 0.8 share at least 0.8 of the larger, so the first shingle that they share lies among the first n - 0.8 n + 1 of
each: those of them that more than one text has are the set's keys. A set without keys has no near copy. Of the others,
those that meet by a key and that fingerprints have not put into one group already are verified too, whatever the size
of the bucket, but for pairs whose sizes, places in the order or sketches rule the similarity out. A sketch says for each
of 512 places whether an odd number of a set's shingles fall there; where two sketches differ, a shingle is in one set
only, so they differ in no more places than the sets do in shingles. First each group is joined to another by the one of
its pairs whose sketches are most alike (one pair a group, again while a tenth of them are links), so that two parts of a
large group don't meet by all of their pairs; then all pairs of groups that are still apart are verified. So all pairs of
that similarity are within a group, and only those join a group.

Defined results: null text counts as empty; words are cut at ASCII white space after A-Z are made lower case; a text of
fewer words than a shingle is one shingle, one without words has an empty set, equal to other empty sets; of a group the
row of the smallest id stays, null ids last, then the smallest digest of the text, and of rows equal in both any one; an
empty table gives an empty result; columns of any name come back.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from tracelake.llm.common import clean_shuffles, dropped, fresh, shuffle_partitions, written
from tracelake.llm.simhash import SEED, components, decode, first_rows
from tracelake.llm.windows import BUCKETS, HELD_SEGMENTS, _batches, _by, _grouped, _rows, bucket_of, mixed, packed, unpacked

SHINGLE, SIMILARITY = 5, 0.8
#: 64-bit words of a fingerprint; bits that agree and bits that are decoded at each place; differing bits of the first
#: two words up to which a pair is verified; members of a bucket that are compared for many buckets at once.
WORDS, EXACT, FUZZY, CLOSE, FEW = 3, 8, 23, 31, 16
#: Bits of a sketch; pairs of sketches that are compared at once.
SKETCH, SKETCHES_AT_ONCE = 512, 1 << 15
#: What rounding may add to a product of a similarity and a size; pairs that are looked at, and held, at once.
ROUNDING, AT_ONCE = 1e-6, 1 << 18
#: The part of the pairs, one a group, that must have been links for groups to be joined by such pairs once more.
LINKED = 0.1
_U = np.uint64


def shingle_set(text: bytes, size: int = SHINGLE) -> np.ndarray:
    """Hashes of the distinct shingles of a text in lower case, sorted."""
    words = text.split()
    hashes = {xxh64_intdigest(b" ".join(words[i : i + size]), SEED) for i in range(max(1, len(words) - size + 1))} if words else ()
    return np.sort(np.fromiter(hashes, _U, len(hashes)))


def fingerprint(hashes: np.ndarray) -> list[int]:
    """WORDS signed numbers: each bit by majority over the hashes, and over what mixing makes of them."""
    out = []
    for k in range(WORDS):
        own = hashes if k == 0 else mixed(hashes * _U(2 * k + 1) + _U(k))
        total = np.zeros(64, np.int64)
        for i in range(0, len(own), 4096):
            total += np.unpackbits(own[i : i + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        out.append(int(np.packbits(total * 2 > len(own), bitorder="little").view("<i8")[0]))
    return out


def sketch(hashes: np.ndarray) -> bytes:
    """For each of SKETCH places whether an odd number of the hashes fall there."""
    return np.packbits(np.bincount((hashes % _U(SKETCH)).astype(np.int64), minlength=SKETCH) & 1).tobytes()


def bucket_keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, position of the fingerprint) of every distinct key. prints: rows of WORDS signed numbers."""
    bits = np.unpackbits(np.ascontiguousarray(prints, "<i8").view(np.uint8).reshape(len(prints), -1), axis=1, bitorder="little").astype(np.int64)
    n, keys, owners = bits.shape[1], [], []
    for place, start in enumerate(range(0, n - EXACT + 1, EXACT)):
        exact = bits[:, start : start + EXACT] @ (1 << np.arange(EXACT))
        fuzzy = bits[:, np.arange(start + EXACT, start + EXACT + FUZZY) % n] @ (1 << np.arange(FUZZY))
        near = np.stack([decode(fuzzy), *(decode(fuzzy ^ (1 << i)) for i in range(FUZZY))], axis=1)
        near.sort(axis=1)
        rows, cols = np.nonzero(np.concatenate((np.ones((len(near), 1), bool), near[:, 1:] != near[:, :-1]), axis=1))
        keys.append(((place << EXACT) + exact[rows] << 12) + near[rows, cols])
        owners.append(rows)
    return np.concatenate(keys), np.concatenate(owners)


def _keyed(batches):
    for batch in batches:
        prints = np.stack([batch.column(k).to_numpy() for k in range(WORDS)], axis=1)
        keys, owners = bucket_keys(prints)
        for i in range(0, len(keys), 1 << 17):
            at = owners[i : i + (1 << 17)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (keys[i : i + (1 << 17)], prints[at, 0], prints[at, 1])], names=["key", "f0", "f1"])


def _close(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64) <= CLOSE


def _few(keys: np.ndarray, prints: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Whole buckets of a few: rows are first compared one step apart, two, and so on, for all buckets at once, and only
    what is close to any other goes by leaders."""
    met = np.zeros(len(keys), bool)
    for step in range(1, FEW):
        at = np.flatnonzero(keys[step:] == keys[:-step])
        if not len(at):
            break
        at = at[_close(prints[at], prints[at + step])]
        met[at] = met[at + step] = True
    keys, prints = keys[met], prints[met]
    edges = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1], [True]))) if len(keys) else np.zeros(1, np.int64)
    sizes = np.diff(edges)
    pairs = edges[:-1][sizes == 2]
    yield prints[pairs + 1], prints[pairs], np.ones(len(pairs), np.int64)
    for a, n in zip(edges[:-1][sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
        yield _Leaders().met(prints[a : a + n])


def _from_the_middle(prints: np.ndarray) -> np.ndarray:
    """Those nearest to the majority of all bits first: of a text and its many copies, each changed elsewhere, that is the
    text, which each copy is nearer to than to the other copies."""
    bits = np.unpackbits(np.ascontiguousarray(prints).view(np.uint8).reshape(len(prints), -1), axis=1, bitorder="little")
    middle = np.packbits(bits.sum(0, dtype=np.int64) * 2 > len(prints), bitorder="little").view(_U)
    return prints[np.argsort(np.bitwise_count(prints ^ middle).sum(1, dtype=np.int64), kind="stable")]


class _Leaders:
    """One bucket, as its rows come; what is held are the leaders and how many follow them."""

    def __init__(self) -> None:
        self.held, self.followers, self.n = np.empty((64, 2), _U), np.zeros(64, np.int64), 0

    def met(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Those that follow a leader, the leader, and its followers so far."""
        if not self.n and len(prints) > 2:
            prints = _from_the_middle(prints)
        who, led = [], []
        for k, p in enumerate(prints):
            close = np.flatnonzero(_close(self.held[: self.n], p))
            if len(close):
                who.append(k)
                led.append(close[0])
                self.followers[close[0]] += 1
            else:
                if self.n == len(self.held):
                    self.held = np.concatenate((self.held, np.empty_like(self.held)))
                    self.followers = np.concatenate((self.followers, np.zeros_like(self.followers)))
                self.held[self.n] = p
                self.n += 1
        at = np.array(led, np.int64)
        return prints[np.array(who, np.int64)], self.held[at], self.followers[at]


def _pairs(batches):
    """Rows come sorted by key: whom each follows in a bucket (a: itself, b: its leader). A bucket that goes on in the next
    batch is held over while it is small."""
    keys, prints = np.empty(0, np.int64), np.empty((0, 2), _U)
    many: _Leaders | None = None  # the bucket that is being read, once it is known to be large
    last = None

    def batch_of(found: list) -> pa.RecordBatch:
        a, b = (np.concatenate([np.empty((0, 2), _U), *(f[k] for f in found)]).view(np.int64) for k in (0, 1))
        followers = np.concatenate([np.empty(0, np.int64), *(f[2] for f in found)])
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in (a[:, 0], a[:, 1], b[:, 0], b[:, 1], followers)], names=["a0", "a1", "b0", "b1", "followers"])

    def settled(keys: np.ndarray, prints: np.ndarray, found: list) -> None:
        """Whole buckets."""
        edges = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1], [True]))) if len(keys) else np.zeros(1, np.int64)
        sizes = np.diff(edges)
        small = np.repeat(sizes <= FEW, sizes)
        found += _few(keys[small], prints[small])
        for a, n in zip(edges[:-1][sizes > FEW].tolist(), sizes[sizes > FEW].tolist(), strict=True):
            found.append(_Leaders().met(prints[a : a + n]))

    for batch in batches:
        found: list = []
        new = batch.column(0).to_numpy(), np.stack([batch.column(k).to_numpy() for k in (1, 2)], axis=1).view(_U)
        if many is not None:
            go_on = int(np.searchsorted(new[0], last, "right"))
            found.append(many.met(new[1][:go_on]))
            new = new[0][go_on:], new[1][go_on:]
            many = None if len(new[0]) else many
        keys, prints = np.concatenate((keys, new[0])), np.concatenate((prints, new[1]))
        if len(keys):
            last = keys[-1]
            cut = int(np.searchsorted(keys, last))
            settled(keys[:cut], prints[:cut], found)
            keys, prints = keys[cut:], prints[cut:]
            if len(keys) > FEW:
                many = _Leaders()
                found.append(many.met(prints))
                keys, prints = keys[:0], prints[:0]
        yield batch_of(found)
    found = []
    settled(keys, prints, found)
    yield batch_of(found)


PRINTS = [f"f{k}" for k in range(WORDS)]


def _told(size: int, buckets: int):
    """Rows (g, text) of one group: its distinct shingles by bucket, with the number of texts that have them."""

    def sent(g: int, held: list[np.ndarray]) -> Iterator[tuple]:
        found, times = np.unique(np.concatenate(held), return_counts=True)
        for bucket, at in _by(bucket_of(found, buckets)):
            yield bucket, g, packed(found[at].astype("<u4"), times[at].astype("<u4"))

    def rows(batches):
        held: list[np.ndarray] = []
        total, last = 0, None
        for g, text in _rows(batches):
            if held and (g != last or total > HELD_SEGMENTS):
                yield from sent(last, held)
                held, total = [], 0
            held.append(shingle_set(text.encode().lower(), size))
            total, last = total + len(held[-1]), g
        if held:
            yield from sent(last, held)

    def run(batches):
        yield from _batches(rows(batches), "bucket int, g int, blob binary")

    return run


def _counted(batches):
    """Rows (bucket, g, blob) sorted by bucket: what more than one text has, with its count, to the groups that have it.
    In a bucket the lower half of a hash stands for it: counts may be too great by chance, never too small."""

    def rows():
        for bucket, held in _grouped(_rows(batches)):
            parts = [unpacked(blob, "<u4", "<u4") for _, blob in held]
            found, which = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            total, at = np.bincount(which, np.concatenate([p[1] for p in parts])).astype("<u4"), 0
            for (g, _), (own, _) in zip(held, parts, strict=True):
                here = which[at : at + len(own)]
                at += len(own)
                here = here[total[here] > 1]
                if len(here):
                    yield g, packed(found[here] | np.uint64(bucket) << _U(32), total[here])

    yield from _batches(rows(), "g int, blob binary")


def set_keys(found: np.ndarray, common: np.ndarray, totals: np.ndarray, buckets: int, similarity: float) -> tuple[np.ndarray, int]:
    """The keys of a set of shingles in their order, and the place of the first. common: sorted places (bucket and lower
    half) of shingles that several texts have; totals: their counts."""
    counts = np.ones(len(found), np.int64)
    if len(common) and len(found):
        place = bucket_of(found, buckets).astype(_U) << _U(32) | found & _U(0xFFFFFFFF)
        at = np.minimum(np.searchsorted(common, place), len(common) - 1)
        counts = np.where(common[at] == place, totals[at], 1)
    alone, end = int((counts == 1).sum()), len(found) - int(np.ceil(similarity * len(found) - ROUNDING)) + 1
    return (found[np.lexsort((found, counts))[alone:end]] if alone < end else found[:0]), alone


def _vertices(marked: DataFrame, size: int, similarity: float) -> DataFrame:
    """vid, f0.., sig, n, first (the best row of each set of shingles), keys, alone (the place of the first key), sketch.
    marked: doc_id, text, mark."""
    spark = marked.sparkSession
    n = shuffle_partitions(spark)
    buckets = BUCKETS * n
    names = ["doc_id", "mark", *PRINTS, "sig", "n", "keys", "alone", "sketch"]
    kinds = [pa.int64(), pa.string(), *[pa.int64()] * (WORDS + 2), pa.list_(pa.int64()), pa.int64(), pa.binary()]

    def run(batches):
        last, blobs, common, totals = None, [], None, None
        held: list[tuple] = []
        for g, kind, doc_id, mark, text, blob in _rows(batches):
            if g != last:
                last, blobs, common = g, [], None
            if kind == 0:
                blobs.append(unpacked(blob, "<u8", "<u4"))
                continue
            if common is None:
                common, first = np.unique(np.concatenate([np.empty(0, _U), *(b[0] for b in blobs)]), return_index=True)
                totals, blobs = np.concatenate([np.empty(0, "<u4"), *(b[1] for b in blobs)])[first], []
            found = shingle_set(text.encode().lower(), size)
            keys, alone = set_keys(found, common, totals, buckets, similarity)
            held.append((doc_id, mark, *fingerprint(found), xxh64_intdigest(found.tobytes()) - (1 << 63), len(found), keys.view(np.int64), alone, sketch(found) if len(keys) else b""))
            if len(held) == 1000:
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in held], t) for k, t in enumerate(kinds)], names=names)
                held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in held], t) for k, t in enumerate(kinds)], names=names)

    grouped = marked.select(F.pmod(F.xxhash64("doc_id", "mark"), F.lit(n)).cast("int").alias("g"), F.lit(1).alias("kind"), "doc_id", "mark", "text", F.lit(None).cast("binary").alias("blob"))
    told = grouped.select("g", "text").repartitionById(n, F.col("g")).mapInArrow(_told(size, buckets), "bucket int, g int, blob binary")
    common = written(told.repartitionById(n, F.pmod("bucket", F.lit(n)).cast("int")).sortWithinPartitions("bucket").mapInArrow(_counted, "g int, blob binary"), "common-shingles")
    clean_shuffles(spark)
    answers = common.select("g", F.lit(0).alias("kind"), F.lit(None).cast("bigint").alias("doc_id"), F.lit(None).cast("string").alias("mark"), F.lit(None).cast("string").alias("text"), "blob")
    both = answers.unionByName(grouped).repartitionById(n, F.col("g")).sortWithinPartitions("g", "kind")
    rows = both.mapInArrow(run, "doc_id bigint, mark string, " + ", ".join(f"{c} bigint" for c in [*PRINTS, "sig", "n"]) + ", keys array<bigint>, alone bigint, sketch binary")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")).alias("first")
    # Numbers are given once, to a table that is written: every later reading has the same ones.
    sets = rows.groupBy(*PRINTS, "sig", "n").agg(first, *[F.any_value(c).alias(c) for c in ("keys", "alone", "sketch")])
    out = written(sets.withColumn("vid", F.monotonically_increasing_id()), "shingle-sets")
    dropped(common)
    clean_shuffles(spark)
    return out


def _across(similarity: float, nearest: bool = False):
    """Rows (key, root, vid, n, place, sketch) sorted by key and root: pairs of one key, of different roots, whose sizes,
    places and sketches allow the similarity. A pair's first shingle in common is at most at the lesser place, and what
    comes after a key in either set is all that they can share beyond it. nearest: of each root in a bucket only the pair
    whose sketches differ least for its size, with the root and that difference."""
    names = ["root", "apart", "u", "v"] if nearest else ["u", "v"]

    def differing(i: np.ndarray, j: np.ndarray, sketches: np.ndarray) -> np.ndarray:
        parts = range(0, len(i), SKETCHES_AT_ONCE)
        apart = [np.bitwise_count(sketches[i[k : k + SKETCHES_AT_ONCE]] ^ sketches[j[k : k + SKETCHES_AT_ONCE]]).sum(1, dtype=np.int64) for k in parts]
        return np.concatenate([np.empty(0, np.int64), *apart])

    def least(found: list[np.ndarray]) -> list[np.ndarray]:
        """Of rows (root, apart, u, v) the least of each root."""
        order = np.lexsort(found[::-1])
        root = found[0][order]
        order = order[np.flatnonzero(np.concatenate(([True], root[1:] != root[:-1])))] if len(order) else order
        return [c[order] for c in found]

    def met(rows: np.ndarray, sketches: np.ndarray) -> Iterator[list[np.ndarray]]:
        keys, root, vid, n, place = rows
        edges = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1], [True]))) if len(keys) else np.zeros(1, np.int64)
        apart = root[edges[:-1]] != root[edges[1:] - 1]
        for a, b in zip(edges[:-1][apart].tolist(), edges[1:][apart].tolist(), strict=True):
            step = max(1, AT_ONCE // (b - a))
            for at in range(a, b, step):
                i = np.arange(at, min(at + step, b))[:, None]
                j = np.arange(a, b)
                can = (root[i] < root[j]) & (np.minimum(n[i], n[j]) >= similarity * np.maximum(n[i], n[j]) - ROUNDING)
                most = np.minimum(place[i], place[j]) + np.minimum(n[i] - place[i], n[j] - place[j])
                x, y = np.nonzero(can & (most >= similarity / (1 + similarity) * (n[i] + n[j]) - ROUNDING))
                x, y = at + x, a + y
                differ, both = differing(x, y, sketches), n[x] + n[y]
                can = differ <= (1 - similarity) / (1 + similarity) * both + ROUNDING
                x, y, share = x[can], y[can], differ[can] / both[can]
                u, v = np.minimum(vid[x], vid[y]), np.maximum(vid[x], vid[y])
                yield least([np.concatenate((root[x], root[y])), *(np.tile(c, 2) for c in (share, u, v))]) if nearest else [u, v]

    def batch_of(found: list) -> pa.RecordBatch:
        columns = [np.concatenate([np.empty(0, np.float64 if name == "apart" else np.int64), *(f[k] for f in found)]) for k, name in enumerate(names)]
        columns = least(columns) if nearest else np.unique(np.stack(columns, axis=1), axis=0).T
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], names=names)

    def whole(batches) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        rows, sketches = np.empty((5, 0), np.int64), np.empty((0, SKETCH // 64), _U)
        for batch in batches:
            rows = np.concatenate((rows, np.stack([c.to_numpy() for c in batch.columns[:5]])), axis=1)
            sketches = np.concatenate((sketches, np.frombuffer(b"".join(batch.column(5).to_pylist()), _U).reshape(-1, SKETCH // 64)))
            if rows.shape[1]:
                cut = int(np.searchsorted(rows[0], rows[0, -1]))
                yield rows[:, :cut], sketches[:cut]
                rows, sketches = rows[:, cut:], sketches[cut:]
        yield rows, sketches

    def run(batches):
        found, total = [], 0
        for rows, sketches in whole(batches):
            for pairs in met(rows, sketches):
                found.append(pairs)
                total += len(pairs[0])
                if total > AT_ONCE:
                    yield batch_of(found)
                    found, total = [], 0
        yield batch_of(found)

    return run


def _verified(pairs: DataFrame, vertices: DataFrame, marked: DataFrame, size: int, similarity: float) -> DataFrame:
    """Pairs whose sets are as similar as that, by the shingles of one text of each set."""
    return _similar(pairs, _sets(pairs, vertices, marked, size), similarity)


def _sets(pairs: DataFrame, vertices: DataFrame, marked: DataFrame, size: int) -> DataFrame:
    """vid, shingles of the sets that are in a pair."""
    named = vertices.select("vid", F.col("first.doc_id").alias("id2"), F.col("first.mark").alias("mark2"))
    asked = pairs.select(F.explode(F.array("u", "v")).alias("vid")).distinct().join(named, "vid")

    def run(batches):
        for batch in batches:
            sets = [shingle_set(t.encode().lower(), size).view(np.int64) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["vid", "shingles"])

    texts = marked.join(asked, F.col("doc_id").eqNullSafe(F.col("id2")) & (F.col("mark") == F.col("mark2"))).select("vid", "text")
    return written(texts.mapInArrow(run, "vid bigint, shingles array<bigint>").dropDuplicates(["vid"]), "sets")


def _similar(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    a, b = (sets.select(F.col("vid").alias(end), F.col("shingles").alias(f"of_{end}")) for end in ("u", "v"))
    shared, both = F.size(F.array_intersect("of_u", "of_v")), F.size("of_u") + F.size("of_v")
    return pairs.join(a, "u").join(b, "v").where((both == 0) | (shared >= F.lit(similarity) * (both - shared))).select("u", "v")


def _by_key(vertices: DataFrame, found: DataFrame) -> DataFrame:
    """What _across reads; found: the root of each vertex that is in a group and not its root."""
    keyed = vertices.join(found, vertices.vid == found.v, "left").select(F.coalesce("root", "vid").alias("root"), "vid", "n", "alone", "sketch", F.posexplode("keys").alias("k", "key"))
    keyed = keyed.select("key", "root", "vid", "n", (F.col("alone") + F.col("k")).alias("place"), "sketch")
    return keyed.repartition("key").sortWithinPartitions("key", "root")


def _joined(found: DataFrame, vertices: DataFrame, marked: DataFrame, size: int, similarity: float) -> DataFrame:
    """found after groups have been joined by their nearest pairs."""
    while True:
        near = _by_key(vertices, found).mapInArrow(_across(similarity, True), "root bigint, apart double, u bigint, v bigint")
        near = near.groupBy("root").agg(F.min(F.struct("apart", "u", "v")).alias("least"))
        pairs = written(near.select("least.u", "least.v").distinct(), "nearest")
        clean_shuffles(vertices.sparkSession)
        asked = pairs.count()
        if not asked:
            dropped(pairs)
            return found
        sets = _sets(pairs, vertices, marked, size)
        links = written(_similar(pairs, sets, similarity), "nearest-verified")
        n = links.count()
        if n:
            found = components(found.select(F.col("root").alias("u"), "v").unionByName(links))
        dropped(pairs, sets, links)
        if n < LINKED * asked:
            return found


def kept_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """One row of each group of near copies with all its columns."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    ident, mark = fresh(docs, "id", "mark")
    rows = docs.withColumns({ident: F.col(f"`{id_col}`").cast("long"), mark: F.sha2(text, 256)})
    marked = rows.select(F.col(ident).alias("doc_id"), text.alias("text"), F.col(mark).alias("mark"))
    every = _vertices(marked, size, similarity)
    vertices = every.where(F.size("keys") > 0)
    # Sets whose first two words are the same meet through the first of them.
    one = vertices.groupBy("f0", "f1").agg(F.min("vid").alias("rep"), F.min_by(F.struct(*PRINTS), "vid").alias("f"))
    # A short row gives many keys, so rows are dealt out by number and not by size.
    met = one.select("f.*").repartition(shuffle_partitions(docs.sparkSession), "f0", "f1").mapInArrow(_keyed, "key bigint, f0 bigint, f1 bigint").repartition("key").sortWithinPartitions("key", "f0", "f1").mapInArrow(_pairs, "a0 bigint, a1 bigint, b0 bigint, b1 bigint, followers bigint")
    met = met.groupBy("a0", "a1").agg(F.max(F.struct("followers", "b0", "b1")).alias("best")).select("a0", "a1", "best.b0", "best.b1")
    for end in "ab":
        met = met.join(one.select(F.col("f0").alias(f"{end}0"), F.col("f1").alias(f"{end}1"), F.col("rep").alias(end)), [f"{end}0", f"{end}1"])
    met = met.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"))
    same = vertices.join(one.select("f0", "f1", "rep"), ["f0", "f1"]).where("vid <> rep").select(F.col("rep").alias("u"), F.col("vid").alias("v"))
    pairs = written(met.unionByName(same).where("u <> v").distinct(), "pairs")
    clean_shuffles(docs.sparkSession)
    links = written(_verified(pairs, vertices, marked, size, similarity), "verified")
    dropped(pairs)
    found = _joined(components(links), vertices, marked, size, similarity)
    rest = written(_by_key(vertices, found).mapInArrow(_across(similarity), "u bigint, v bigint").distinct(), "pairs")
    clean_shuffles(docs.sparkSession)
    missed = _verified(rest, vertices, marked, size, similarity)
    roots = components(found.select(F.col("root").alias("u"), "v").unionByName(missed))
    dropped(rest)
    best = every.join(roots, every.vid == roots.v, "left").groupBy(F.coalesce("root", "vid").alias("root")).agg(F.min("first").alias("first"))
    return first_rows(rows, ident, mark, best).select(*[F.col(f"`{c}`") for c in docs.columns])
