"""The pipeline's stages against a brute-force reading of each stage's input."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from tracelake.llm import common, language, near, packing, pii


def similar_groups(texts, size=5, similarity=0.8):
    """The smallest id of each group of texts joined by pairs of that similarity, over all pairs."""
    sets = {}
    for i, t in texts.items():
        words = "".join(c.lower() if "A" <= c <= "Z" else c for c in t).encode().split()
        sets[i] = {tuple(words[k : k + size]) for k in range(max(1, len(words) - size + 1))} if words else set()
    group = {i: i for i in sets}

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b]):
                low, high = sorted((root(a), root(b)))
                group[high] = low
    return {root(i) for i in sets}


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = [r.asDict() for r in docs.collect()]
        docs = spark.createDataFrame(stage(spark, docs, sf).collect(), stage(spark, docs, sf).schema)
        after = [r.asDict() for r in docs.collect()]
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
        if name == "language":
            assert {r["doc_id"] for r in after} == {r["doc_id"] for r in before if any(map(str.isalpha, r["text"] or ""))}
        elif name == "exact_dedup":
            best = {}
            for r in before:
                key = re.sub(r"[\x20\x09-\x0D]", "", r["text"])
                best[key] = min(best.get(key, (0, 0)) or (0, 0), (-len(r["text"]), r["doc_id"])) if key in best else (-len(r["text"]), r["doc_id"])
            assert sorted(r["doc_id"] for r in after) == sorted(i for _, i in best.values())
        elif name == "near_dedup":
            firsts = similar_groups({r["doc_id"]: r["text"] for r in before})
            kept = {r["doc_id"] for r in after}
            # Nothing goes that is near to no smaller id, and of what is near nine in ten go at least.
            assert len(kept) == len(after) and kept >= firsts
            assert len(before) - len(kept) >= 0.9 * (len(before) - len(firsts))
        elif name == "pii":
            texts = {r["doc_id"]: r["text"] for r in before}
            assert all(r["text"] == pii.redact(texts[r["doc_id"]]) and r["n_chars"] == len(r["text"]) for r in after)
        else:
            ids = {r["doc_id"]: packing.token_ids(r["text"], packing.default_vocabulary()) for r in before}
            assert Counter({i: len(x) for i, x in ids.items()}) == Counter({i: sum(r["length"] for r in after if r["doc_id"] == i) for i in ids})
            for r in after:
                piece = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
                assert r["ids"] == piece.tolist() and r["ids_crc32"] == zlib.crc32(np.ascontiguousarray(piece).tobytes())


def test_planted_near_copies(spark):
    """Texts with words replaced, added and left out, at similarities down to 0.8, among texts that only share phrases."""
    r = random.Random(17)
    words = ["".join(r.choices("abcdefghijklmnop", k=r.randrange(2, 9))) for _ in range(4000)]
    phrase, rows, near_ids = r.choices(words, k=12), [], set()
    for k in range(150):
        own = r.choices(words, k=r.randrange(60, 500))
        own[5:5] = phrase
        rows.append((len(rows), " ".join(own)))
        if k % 2:
            copy = own[:]
            for at in r.sample(range(len(own)), max(1, len(own) // r.choice([50, 60, 100]))):
                copy[at] = r.choice(words)
            near_ids.add(len(rows))
            rows.append((len(rows), " ".join(copy)))
    firsts = similar_groups(dict(rows))
    assert len(set(range(len(rows))) - firsts) >= 0.9 * len(near_ids)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("vid", F.lit(1)).withColumn("_id", F.lit(2)).repartition(5)
    got = near.kept_rows(df)
    kept = {x.doc_id for x in got.collect()}
    assert got.columns == df.columns and kept >= firsts and len(kept) <= len(firsts) + 0.1 * (len(rows) - len(firsts))


def test_all_near_copies_go(spark):
    """Pairs of exactly 0.8 and little more, which few bits of a fingerprint have in common, and chains of them; a
    passage that many texts share puts them into one bucket."""
    r = random.Random(19)
    words = ["".join(r.choices("abcdefghijklmnop", k=r.randrange(2, 9))) for _ in range(4000)]
    passage, rows = r.choices(words, k=40), []
    for k in range(120):
        own = passage + r.choices(words, k=r.choice([5, 14, 60, 200, 320]))
        for _ in range(k % 3 + 1):
            rows.append((len(rows), " ".join(own)))
            # One end changes: a word of a shingle in nine gives a similarity of 0.8 where nothing else repeats.
            n = len(own) - 4
            own = own[: len(own) - n // 9] + r.choices(words, k=n // 9)
    firsts = similar_groups(dict(rows))
    assert 60 < len(rows) - len(firsts)
    got = near.kept_rows(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    assert {x.doc_id for x in got.collect()} == firsts


def test_sketches_differ_in_no_more_places_than_sets():
    r = np.random.default_rng(20)
    for n in (0, 1, 5, 100, 3000):
        every = r.integers(0, 1 << 63, n + 200, np.uint64)
        for own in (0, 1, 7, 90):
            a, b = every[own : n + own], every[: n + own // 2]
            a_bits, b_bits = (np.frombuffer(near.sketch(x), np.uint64) for x in (a, b))
            assert len(a_bits) * 64 == near.SKETCH and np.bitwise_count(a_bits ^ b_bits).sum() <= len(np.setxor1d(a, b))
    assert near.sketch(every[:1]) != near.sketch(every[:0]) == near.sketch(every[[0, 0]])


def test_texts_that_share_less_are_no_pairs(spark, monkeypatch):
    """Texts with half to two thirds of their shingles in common, which are one another's keys: verified are the near
    copies among them, and not the square of their number."""
    r = random.Random(21)
    words = ["".join(r.choices("abcdefghij", k=6)) for _ in range(3000)]
    blocks = [[r.choices(words, k=10) for _ in range(3)] for _ in range(15)]
    rows = [(k, " ".join(w for b in blocks for w in b[r.random() > 0.6])) for k in range(250)]
    for k in range(0, 40, 2):
        rows.append((len(rows), rows[k][1].rsplit(" ", 3)[0]))
    firsts = similar_groups(dict(rows))
    asked, verified = [], near._verified

    def counted(pairs, *args):
        asked.append(pairs.count())
        return verified(pairs, *args)

    monkeypatch.setattr(near, "_verified", counted)
    got = near.kept_rows(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    assert {x.doc_id for x in got.collect()} == firsts and len(asked) == 2
    assert asked[1] < 10 * len(rows)


def changed_copies(n, seed=22):
    """Copies of a text that isn't among them: each has one word of 150 changed, somewhere else each time."""
    r = random.Random(seed)
    words = ["".join(r.choices("abcdefghij", k=6)) for _ in range(3000)]
    body, texts = r.choices(words, k=150), []
    for _ in range(n):
        copy = body[:]
        copy[r.randrange(len(body))] = r.choice(words)
        texts.append(" ".join(copy))
    return texts


def test_pairs_of_a_group_are_no_more_than_its_texts(spark, monkeypatch):
    """A group of 300 near copies whose fingerprints are close: none is lost, and the pairs to verify grow with the texts
    and not with the pairs of them that are close."""
    rows = list(enumerate(changed_copies(300)))
    asked, verified = [], near._verified

    def counted(pairs, *args):
        asked.append(pairs.count())
        return verified(pairs, *args)

    monkeypatch.setattr(near, "_verified", counted)
    got = near.kept_rows(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    assert {x.doc_id for x in got.collect()} == similar_groups(dict(rows)) == {0}
    assert asked[0] <= len(rows) and sum(asked) < 2 * len(rows)


def test_a_text_follows_one_leader_of_a_bucket():
    """A bucket in which texts are close to several leaders, read at once and in batches: a pair a text at most, and the
    followers of a leader are counted."""
    r = np.random.default_rng(23)
    for n, rows_a_batch in ((2, 10), (9, 10), (400, 1000), (400, 50)):
        prints = np.zeros((n, 128), np.uint8)
        for row in prints:
            row[r.choice(128, 17, replace=False)] = 1
        prints = np.packbits(prints, axis=1).view("<i8")
        columns = [np.zeros(n, np.int64), prints[:, 0], prints[:, 1]]
        batches = [pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c[i : i + rows_a_batch])) for c in columns], names=["key", "f0", "f1"]) for i in range(0, n, rows_a_batch)]
        a0, a1, b0, b1, followers = (np.concatenate([b.column(k).to_numpy() for b in near._pairs(batches)]) for k in range(5))
        pairs = {(w, x): (y, z) for w, x, y, z in zip(a0, a1, b0, b1)}
        assert len(pairs) == len(a0) < n and not set(pairs) & set(pairs.values())
        assert followers.max(initial=0) == max(Counter(pairs.values()).values(), default=0)


def test_groups_that_are_apart_meet_by_one_pair_each(spark):
    texts = changed_copies(120)
    sets = [near.shingle_set(t.encode()) for t in texts]
    # One bucket: two roots, sixty texts each.
    batch = pa.RecordBatch.from_arrays([pa.array(x) for x in ([7] * 120, [k // 60 * 60 for k in range(120)], list(range(120)), list(map(len, sets)), [0] * 120, list(map(near.sketch, sets)))], names=["key", "root", "vid", "n", "place", "sketch"])
    every = sum(b.num_rows for b in near._across(0.8)([batch]))
    nearest = [r for b in near._across(0.8, True)([batch]) for r in b.to_pylist()]
    assert every > 1000 and [r["root"] for r in nearest] == [0, 60]
    u, v = nearest[0]["u"], nearest[0]["v"]
    assert u < 60 <= v and len(np.intersect1d(sets[u], sets[v])) >= 0.8 * len(np.union1d(sets[u], sets[v]))
    # Groups that fingerprints have not found at all: what is joined are near copies, by no more pairs than groups.
    other = changed_copies(40, seed=24)
    rows = list(enumerate(texts + other))
    marked = spark.createDataFrame(rows, "doc_id long, text string").withColumn("mark", F.sha2("text", 256)).repartition(5)
    vertices = near._vertices(marked, 5, 0.8)
    found = near._joined(spark.createDataFrame([], "v long, root long"), vertices, marked, 5, 0.8)
    roots = {r.id: r.root for r in vertices.join(found, vertices.vid == found.v, "left").select(F.col("first.doc_id").alias("id"), F.coalesce("root", "vid").alias("root")).collect()}
    assert len(roots) == 160 and 2 <= len(set(roots.values())) <= 80
    assert not {roots[i] for i in range(120)} & {roots[i] for i in range(120, 160)}


def test_large_group_of_near_copies(spark):
    """A third of all rows one text but for a number: a star, not all pairs; and sets of one fingerprint apart."""
    r = random.Random(18)
    words = ["".join(r.choices("abcdefghij", k=6)) for _ in range(500)]
    body = " ".join(r.choices(words, k=300))
    rows = [(k, f"{body} number {k}") for k in range(300)] + [(1000 + k, " ".join(r.choices(words, k=80))) for k in range(300)] + [(5000, "x " * 400 + body), (5001, "x " * 400 + "y z"), (5002, None), (5003, "")]
    kept = sorted(x.doc_id for x in near.kept_rows(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).collect())
    assert kept == [0, *range(1000, 1300), 5001, 5002] or kept == [0, *range(1000, 1300), 5000, 5001, 5002]


def test_stages_on_hard_rows(spark, sf):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "word", "en", None, 4), (3, "word", "en", None, 4), (None, "other text here", "en", "s", 15), (4, "Word ", None, "s", 5), (5, "mail a@b.de now", "en", "s", 15)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        docs = spark.createDataFrame(stage(spark, docs, sf).collect(), stage(spark, docs, sf).schema)
    assert {r.doc_id for r in docs.collect()} == {3, None, 5}
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf).count() == 0


def test_run(spark, sf):
    before = common.tables_made()
    assert corpus_pipeline.run(spark, sf).count() > 0
    # Only the last stage's table is left.
    assert common.tables_made() == before + 1 and language.UNKNOWN == "und"
