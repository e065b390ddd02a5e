"""The operators against brute force, on the smallest table and on a table of hard cases."""

import hashlib
import os
import random
import re
import sys
import unicodedata
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from tracelake.llm import bpe, exact_dedup, html, language, media, packing, pii, queries, simhash, substrings, suffix_array
from tracelake.llm import windows as W

WHITE = re.compile(r"[\x20\x09-\x0D]")
PHRASE = " ".join(f"w{i}" for i in range(40))
HARD = [
    (1, None, "en"), (2, "", "en"), (3, " \t\n", None), (4, "One two\tthree", "en"), (5, "Onetwo three", "en"), (6, "Onetwothree", "de"), (6, "Onetwothree", "de"),
    (7, "a " * 500, "en"), (8, "x" * 3000, None), (9, PHRASE + " end", "en"), (10, "start " + PHRASE, "en"), (11, f"pre {PHRASE} mid {PHRASE} post", "en"),
    (12, "é" * 60 + " ü ß\x85z", "fr"), (13, "é" * 60 + " ü ß\x85z", "fr"), (14, "12345 67890 !!!", "en"), (15, "<|endoftext|> and <|startoftext|>", "en"),
    (16, PHRASE.replace("w20", "other"), "en"), (17, "日本語のテキスト " * 30, "ja"), (None, "no id", "en"), (None, PHRASE, "en"), (18, "\x00\x01 nul", "en"), (19, "aab" * 100, "en"), (20, "baa" * 100, "en"),
]


@pytest.fixture(scope="module")
def hard(spark):
    rows = [(i, t, lang, f"src{k % 3}", len(t or ""), "clash", k) for k, (i, t, lang) in enumerate(HARD)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, words string, n long").repartition(3)


@pytest.fixture(scope="module")
def small(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="module", params=["hard", "small"])
def docs(request):
    return request.getfixturevalue(request.param)


@pytest.fixture(scope="module")
def empty(hard):
    return hard.where("false")


def listed(docs):
    return [(r.doc_id, r.text or "") for r in docs.collect()]


def as_rows(df, *cols):
    return Counter(tuple(r[c] for c in cols) for r in df.collect())


def test_exact_dedup(docs):
    groups = defaultdict(list)
    for i, t in listed(docs):
        groups[WHITE.sub("", t)].append((-len(t), i is None, i))
    want = Counter()
    for text, rows in groups.items():
        rows.sort(key=lambda r: (r[0], r[1], r[2] or 0))
        for k, r in enumerate(rows):
            want[(r[2], rows[0][2], len(rows), k == 0, hashlib.sha256(text.encode()).hexdigest())] += 1
    got = exact_dedup.exact_dedup(docs)
    assert as_rows(got, "doc_id", "keep_id", "group_size", "kept", "text_sha256") == want
    kept = exact_dedup.kept_rows(docs)
    assert kept.columns == docs.columns
    assert as_rows(kept, "doc_id") == Counter(k[:1] for k in want.elements() if k[3])


def test_exact_dedup_is_native(docs):
    plan = exact_dedup.exact_dedup(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    plan = exact_dedup.kept_rows(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "rangepartitioning" in plan and "SortAggregate" in plan


def test_exact_dedup_sort_merges_all_but_hot_texts(spark, sf):
    """Equal texts meet in the content sort, however many partitions; hot ones are combined before it."""
    rows = [(i, f"text {i % 300} " + "same beginning of very many texts " * 3, 1) for i in range(900)] + [(1000 + i, "hot  text" if i % 2 else "hot text", 1) for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _norm long").repartition(5)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in (2, 51, 200):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            from pyspark.sql import functions as F

            parts = exact_dedup._fragments(df.drop("_norm"), "doc_id", "text", F.min("_rank").alias("_best")).collect()
            assert Counter(r._n for r in parts if r._salt is None) == Counter({3: 300})
            hot = exact_dedup._hot_texts(df, "text", n).count()
            assert hot == 1
            got = exact_dedup.exact_dedup(df)
            assert Counter((r.group_size, r.kept) for r in got.collect()) == Counter({(3, True): 300, (3, False): 600, (900, True): 1, (900, False): 899})
            assert exact_dedup.kept_rows(df).columns == df.columns and exact_dedup.kept_rows(df).count() == 301
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


PATTERNS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def plain_spans(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in pattern.finditer(text):
            digits = re.sub(r"\D", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (13 <= len(digits) <= 19 and sum(int(d) if k % 2 == 0 else sum(divmod(int(d) * 2, 10)) for k, d in enumerate(digits[::-1])) % 10 == 0):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((kind, *m.span()))
    return out


def test_pii_base(docs):
    want = Counter()
    for i, t in listed(docs):
        spans = plain_spans(t)
        n = Counter(k for k, _, _ in spans)
        want[(i, n["email"], n["ip"], n["card"], n["phone"], hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest())] += 1
    assert as_rows(pii.find_pii(docs), "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256") == want


def test_pii_base_on_random_texts():
    r = random.Random(4)
    for _ in range(3000):
        text = "".join(r.choice("ab@@..--++  (12)34567890155559\n%_é") for _ in range(r.randrange(60)))
        assert [(k, a, b) for k in pii.KINDS for a, b in pii.find(text)[k]] == plain_spans(text), text


@pytest.mark.parametrize(
    "text, want",
    [
        ("mail john (at) mail dot com now", "email:5:27"), ("jоhn@mаil.com", "email:0:13"), ("x bob at example dot org, y", "email:2:24"), ("joe [at] a.de", "email:0:13"),
        ("192 dot 168 dot one dot one", "ip:0:27"), ("call plus one five five five one two three four five six seven eight ok", "phone:5:68"),
        ("card four one one one 1111 1111 one one one one", "card:5:47"), ("ｊｏｅ＠ｍａｉｌ．ｃｏｍ", "email:0:12"), ("look at the dot, he said", ""), ("one two three four five", ""), ("meet at noon (at) home", ""),
    ],
)
def test_pii_disguises(text, want):
    base, added = pii.scan(text)
    assert pii.spell(base) == "" and pii.spell(added) == want


@pytest.mark.parametrize("dash", "\u2010\u2011\u2012\u2013\u00a0\u2009\u202f")
def test_pii_foreign_separators(dash):
    assert pii.spell(pii.scan(f"card {dash.join(['4111', '1111', '1111', '1111'])} ok")[1]) == "card:5:24"
    assert pii.spell(pii.scan(f"call +1{dash}555{dash}123{dash}4567 ok")[1]) == "phone:5:20"


def test_pii_foreign_digits():
    zeros = [c for c in range(128, 0x110000) if chr(c).isdecimal() and unicodedata.decimal(chr(c)) == 0]
    for zero in zeros:
        text = "".join(chr(zero + int(d)) for d in "4111111111111111")
        assert pii.spell(pii.scan(text)[1]) == "card:0:16", hex(zero)
    assert pii.FOLDABLE >= set(pii.LOOKALIKES) and len(zeros) > 60


@pytest.mark.parametrize(
    "text, base, want",
    [
        ("jоhn@mail.com", "email:2:13", "email:0:13"), ("john [dot] smith@mail.com", "email:11:25", "email:0:25"), ("x@mail.example [dot] com", "email:0:14", "email:0:24"),
        ("plain@mail.com кот", "email:0:14", ""), ("x@foo.one.two.com", "email:0:17", ""),
    ],
)
def test_pii_disguises_with_plain_fragments(text, base, want):
    found, added = pii.scan(text)
    assert pii.spell(found) == base and pii.spell(added) == want
    assert pii.redact(text) == ("[EMAIL]" if want else text.replace(text[: int(base.split(":")[2])], "[EMAIL]"))


def test_redact():
    assert pii.redact("a a.b@c.de b 1.2.3.4 c") == "a [EMAIL] b [IP] c"
    assert pii.redact(None) is None


PAGE = (
    "<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t='</p>';</script></head><body><nav><ul><li>menu</ul></nav><div class='ad'>buy</div>"
    "<article><h1>H &amp;amp; one</h1><p><b>First.<br><p>Second\n  line</p><form><p>fill</form><div class='comments'><p>nice!</p></div></article><footer>&copy;</footer></body></html>"
)


def test_html(spark):
    plain = "<body><p>Top line</p><p>{}</p><p>Bottom</p></body>"
    rows = [(1, "http://h/a/1", PAGE), (2, "http://h/a/2", plain.format("second page")), (3, "http://h/a/3", plain.format("third page")), (4, None, None), (5, "x", ""), (6, "http://alone/", plain.format("alone")), (1, "http://h/a/1", PAGE), (7, "http://h/b<", "<p>unclosed <q 'x"), (8, "http://twin/1", plain.format("same")), (9, "http://twin/2", plain.format("same"))]
    got = as_rows(html.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)), "page_id", "url", "text", "n_chars")
    texts = defaultdict(set)
    for i, _, t, n in got:
        assert n == len(t)
        texts[i].add(t)
    assert sum(got.values()) == len(rows)
    assert texts[1] == {"H &amp; one\n\nFirst.\n\nSecond line"} and texts[4] == texts[5] == {""}
    assert texts[6] == {"Top line\n\nalone\n\nBottom"} and texts[8] == {"Top line\n\nsame\n\nBottom"}
    assert html.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string").where("false")).count() == 0


def page(i, path, html_text, host="h"):
    return html.Page(i, "", host, path, *html.parsed(html_text))


def test_html_differencing():
    plain = "<p>Top<p>{}<p>Bottom"
    mine, other = page(2, "/a/2", plain.format("second")), page(3, "/a/3", plain.format("third"))
    assert html._kept(mine, None, other) == ["second"]
    assert html._kept(mine, page(1, "/a/2", plain.format("first"), "g"), None) == ["Top", "second", "Bottom"]
    # In a named article a line goes if both pages also print it as furniture, and stays if one or none does.
    named = "<nav><p>Follow us</nav><article><p>{}<p>Follow us<p>Said twice</article>"
    mine, other = page(2, "/a/2", named.format("second")), page(3, "/a/3", named.format("third"))
    assert html._kept(mine, None, other) == ["second", "Said twice"] and html._kept(other, mine, None) == ["third", "Said twice"]
    other = page(3, "/a/3", "<nav><p>Said twice<p>second</nav><article><p>third<p>Follow us<p>Said twice</article>")
    assert html._kept(mine, None, other) == ["second", "Follow us", "Said twice"]
    # An unnamed page beside a named one loses what is furniture there.
    assert html._kept(page(4, "/a/4", "<p>Said twice<p>fourth"), other, None) == ["fourth"]


@pytest.mark.parametrize(
    "markup, want",
    [
        ('<div class="has-sidebar"><p>Article', ["Article"]), ('<article><div class="article-header"><h1>Title</h1></div><div class="related-work"><p>Work</div></article>', ["Title", "Work"]),
        ("<p title=Bob's>Hello it's me</p>", ["Hello it's me"]), ('<div class="sidebar left">x</div><p>y', ["y"]), ('<div class="site-header">x</div><div class="comment-list">x</div><p>y', ["y"]),
        ('<p data-x="a>b" class=\'ad\'>x</p><p a=b="c d">y', ["y"]), ('<div id="cookie_banner">x</div><div class="Post_Content"><p>y</div><p>z', ["y"]), ('<a href="unclosed>x</a><p>y</p>', ["x", "y"]),
    ],
)
def test_html_names_and_attributes(markup, want):
    assert html.parsed(markup)[2] == want


def test_html_any_partition_count(spark):
    """Every page meets its nearest neighbour, whichever partitions the two are in."""
    r, rows = random.Random(12), []
    for k in range(60):
        host, path = f"h{k // 3 % 7}", r.choice(["/a/", "/b/", "/a/c/"]) + str(k)
        top = [f"{host} top", *r.sample(["one", "two", "three"], 2)]
        rows.append((None if k == 5 else k, None if k == 9 else f"http://{host}{path}", "".join(f"<p>{x}</p>" for x in [*top, f"own {k}", "end"])))
    rows += [rows[0], rows[7], (rows[7][0], rows[7][1], rows[7][2] + "<p>more</p>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    pages = []
    for i, url, text in rows:
        host, path = re.match("http://([^/]*)(.*)", url).groups() if url else ("", "")
        mark = df.where(df.html == text).selectExpr("xxhash64(html) as m").first().m if rows.count((i, url, text)) > 1 or (i, url) == rows[7][:2] else 0
        pages.append(((host, path, i is not None, i or 0, url or "", mark), html.Page(i, url, host, path, *html.parsed(text))))
    pages = [None, *(p for _, p in sorted(pages, key=lambda p: p[0])), None]
    want = Counter((p.page_id, p.url, "\n\n".join(html._kept(p, a, b))) for a, p, b in zip(pages, pages[1:], pages[2:], strict=False))
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in (1, 3, 40):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            assert as_rows(html.extract_main_text(df.repartition(3)), "page_id", "url", "text") == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


@pytest.mark.parametrize("cells", [3, 4_000_000])
def test_lcs(monkeypatch, cells):
    monkeypatch.setattr(html, "TABLE_CELLS", cells)
    r = random.Random(2)
    for _ in range(300):
        a, b = ([r.choice("abcd") for _ in range(r.randrange(12))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        got = html.shared_lines(a, b)
        assert len(got) == best[-1][-1] and all(a[i] == b[j] for i, j in got)
        assert all(x < y for p, q in zip(got, got[1:], strict=False) for x, y in zip(p, q, strict=True))


def test_html_on_pages(spark, sf):
    from html import unescape

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = {r.page_id: r.text for r in queries.op3_html_extraction(spark, sf).collect()}
    assert len(got) == len(pages)
    for i, page in pages.items():
        article = re.search(r"<article>(.*)</article>", page, re.S)[1]
        blocks = [re.sub(r"\s+", " ", unescape(re.sub(r"<[^>]*>", " ", b))).strip() for b in re.split(r"</?(?:p|h1)>", article)]
        assert got[i] == "\n\n".join(b for b in blocks if b)


def test_html_against_differencing_by_brute_force(spark):
    """Whole extraction, with named and unnamed pages of one host, by a plain rule over all pairs of neighbours."""
    from difflib import SequenceMatcher

    r, rows, want = random.Random(41), [], {}
    for k in range(40):
        own = [f"own {k} {j}" for j in range(r.randrange(1, 4))]
        named = k % 3 == 0
        body = "".join(f"<p>{x}</p>" for x in own)
        rows.append((k, f"https://host.example/{k:03d}", f"<nav>menu</nav><p>Banner {k % 2}</p><p>Welcome</p>" + (f"<article>{body}<p>Welcome back</p></article>" if named else body + "<p>Welcome back</p>") + "<footer>f</footer><p>Imprint</p>"))
        want[k] = own
    got = {x.page_id: x.text.split("\n\n") for x in html.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for k in range(40):
        lines = [f"Banner {k % 2}", "Welcome", *want[k], "Welcome back", "Imprint"]
        if k % 3 == 0:
            # Its neighbour has no named article, so "Welcome back" may be text there and stays.
            assert got[k] == [*want[k], "Welcome back"]
        else:
            # Paths have equal common beginnings, or that of the page of the same ten, before comes first.
            near = [j for j in (k - 1, k + 1) if 0 <= j < 40]
            other = max(near, key=lambda j: len(os.path.commonprefix([f"/{j:03d}", f"/{k:03d}"])))
            there = [f"Banner {other % 2}", "Welcome", *want[other], "Welcome back", "Imprint"]
            gone = {x for m in SequenceMatcher(None, lines, there, autojunk=False).get_matching_blocks() for x in lines[m.a : m.a + m.size]}
            assert got[k] == [x for x in lines if x not in gone]


def test_packing(docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for i, t in listed(docs):
        ids = [*library.encode(t, add_special_tokens=False).ids, 0]
        at = 0
        while at < len(ids):
            n = min(1024, 1 << (len(ids) - at).bit_length() - 1)
            want[(i, at, n, zlib.crc32(np.array(ids[at : at + n], "<u4").tobytes()), len(ids), 0)] += 1
            at += n
    rows = packing.pack(docs, with_ids=True)
    assert as_rows(rows, "doc_id", "start", "length", "ids_crc32", "doc_tokens", "offset") == want
    got = rows.collect()
    assert len({r.sequence_id for r in got}) == len(got) and all(r.sequence_id >> packing.BUCKET_SHIFT == r.bucket and 1 << r.bucket == r.length for r in got)


def test_packing_writes_buckets(small, tmp_path):
    packing.write_buckets(packing.pack(small.limit(3), with_ids=True), str(tmp_path / "b"))
    assert all(p.name.startswith("bucket=") for p in (tmp_path / "b").iterdir() if p.is_dir())


def brute_substrings(rows, window):
    docs = [(i, t.encode().split()) for i, t in rows]
    seen = Counter(tuple(w[k : k + window]) for _, w in docs for k in range(len(w) - window + 1))
    out = Counter()
    for i, w in docs:
        gone = {k + j for k in range(len(w) - window + 1) if seen[tuple(w[k : k + window])] > 1 for j in range(window)}
        kept = [x for k, x in enumerate(w) if k not in gone]
        out[(i, len(w), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest())] += 1
    return out


@pytest.mark.parametrize("split", [W.SPLIT, 1])
def test_substrings(docs, split):
    got = substrings.dedup_substrings(docs, split=split)
    assert as_rows(got, "doc_id", "n_words", "n_removed", "kept_sha256") == brute_substrings(listed(docs), 35)


def brute_bytes(rows, window):
    docs = [(i, t.encode()) for i, t in rows]
    least = {}
    for i, raw in docs:
        for k in range(len(raw) - window + 1):
            if i is not None:
                least[raw[k : k + window]] = min(least.get(raw[k : k + window], i), i)
    out = Counter()
    for i, raw in docs:
        gone = set()
        for k in range(len(raw) - window + 1):
            if i is not None and least[raw[k : k + window]] < i:
                gone.update(range(k, k + window))
        spans = sum(1 for k in gone if k - 1 not in gone)
        out[(i, len(raw), len(gone), spans, hashlib.sha256(bytes(b for k, b in enumerate(raw) if k not in gone)).hexdigest())] += 1
    return out


@pytest.mark.parametrize("split", [W.SPLIT, 1])
def test_suffix_array_dedup(docs, split):
    got = suffix_array.dedup_bytes(docs, split=split)
    assert as_rows(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute_bytes(listed(docs), 50)


@pytest.mark.parametrize("words", [True, False])
def test_repeats_on_random_texts(spark, words):
    r = random.Random(9)
    parts = ["".join(r.choice("ab ") for _ in range(r.randrange(4, 30))) for _ in range(12)]
    rows = [(k // 2 if k < 20 else k, "".join(r.choice(parts) for _ in range(r.randrange(8)))) for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    if words:
        assert as_rows(substrings.dedup_substrings(df, window=5, gram=3), "doc_id", "n_words", "n_removed", "kept_sha256") == brute_substrings(rows, 5)
    else:
        assert as_rows(suffix_array.dedup_bytes(df, window=9, gram=4), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute_bytes(rows, 9)


def resolved_bytes(rows, window, gram):
    """brute_bytes' counter by the verdicts of resolve on the segments of all rows."""
    units, held, places = W.Units(window, gram, False, False), {}, []
    for i, raw in rows:
        for pos, n, anchor, _ in zip(*(x.tolist() for x in units.segments(units.values(raw))), strict=True):
            piece = raw[pos : pos + n + window - 1]
            places.append((i, pos, piece))
            _, copies, least = held.get(piece, (anchor, 0, i))
            held[piece] = anchor, copies + 1, min(least, i)
    pieces = sorted(held, key=lambda p: held[p][0])
    verdicts = dict(suffix_array.resolve(units, [(held[p][0], k, p, *held[p][1:]) for k, p in enumerate(pieces)]))
    gone = defaultdict(set)
    for i, pos, piece in places:
        for a, b, low in verdicts.get(pieces.index(piece), ()):
            if low is not None and low < i:
                gone[i].update(range(pos + a, pos + b + window - 1))
    return {i: len(gone[i]) for i, _ in rows}


def test_suffix_array_dedup_of_runs():
    """Two runs of unequal length with a shared tail or head: a window repeats inside the piece that holds the other."""
    r = random.Random(11)
    for k in range(300):
        unit = "".join(r.choices("-= to", k=r.choice([1, 1, 2, 3, 7, 31])))
        shared = "".join(r.choices("abcdefghij ", k=120))
        rows = []
        for i, size in enumerate(r.choice([(60, 80), (80, 60), (200, 90), (55, 300)])):
            run, own = (unit * size)[:size], "".join(r.choices("klmnopqrst ", k=90))
            rows.append((i, (own + run + shared if k % 2 else shared + run + own).encode()))
        want = {i: n for i, _, n, _, _ in brute_bytes([(i, raw.decode()) for i, raw in rows], 50)}
        assert resolved_bytes(rows, 50, 20) == want, rows


def bytes_by_steps(rows, groups, window=50, gram=20, split=W.SPLIT, calls=None):
    """brute_bytes by the steps of op8 without Spark; calls takes how often each of them called a function."""
    caught = {}
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(suffix_array, "without_repeats", lambda *args: caught.update(args=args[3:6]))
        suffix_array.dedup_bytes(None, window=window, gram=gram, split=split)
    (units, resolve, finish), buckets = caught["args"], 2 * groups

    def step(name, make, rows, kinds):
        counted = [0]
        batches = [W._batch(rows[k : k + 1000], [f"c{k}" for k in range(len(kinds))], kinds) for k in range(0, len(rows), 1000)]
        if calls is not None:
            sys.setprofile(lambda frame, event, arg: counted.__setitem__(0, counted[0] + event.endswith("call")))
        try:
            out = list(make(iter(batches)))
        finally:
            if calls is not None:
                sys.setprofile(None)
                calls[name] = counted[0]
        return list(W._rows(out))

    number, blob = [pa.int64()], [pa.binary()]
    kinds = [*number * 4, pa.string(), *blob]
    docs = sorted(((zlib.crc32(f"{i} {t}".encode()) % groups, 1, i, zlib.crc32(t.encode()), t, None) for i, t in rows), key=lambda r: r[0])

    def beside(*blobs):
        told = [(g, kind, None, None, None, b) for kind, of in enumerate(blobs) for g, b in of]
        return sorted(told + [(g, len(blobs), *rest) for g, _, *rest in docs], key=lambda r: r[:2])

    sent = step("anchors", W._anchors(units, buckets), [(r[0], r[4]) for r in docs], [*number, pa.string()])
    repeated = step("repeated", W._repeated(units), sorted(sent), [*number * 2, *blob])
    sent = step("keys", W._keys(units, buckets), beside(repeated), kinds)
    repeated = step("repeated keys", W._repeated_keys, sorted(sent), [*number * 2, *blob])
    texts = step("texts", W._texts(units, buckets), beside(repeated), kinds)
    verdicts = step("verdicts", W._verdicts(units, resolve), sorted(r[1:] for r in texts if r[0] == 0), [*number, *blob])
    return Counter(r[:5] for r in step("applied", W._applied(units, finish), beside([r[1:] for r in texts if r[0] == 1], verdicts), kinds))


def test_bytes_are_gone_through_in_arrays():
    """texts of 3,000 bytes, a third of it passages that two others have. Steps used to call some 170 functions a text
    for the keys and 11 for each repeated stretch of bytes, before and in the verdicts."""
    r = random.Random(13)
    letters = "abcdefghijklmnopqrstuvwxyz"
    passages = ["".join(r.choices(letters, k=1000)) for _ in range(100)]
    rows = [(k, "".join(r.choices(letters, k=1000)) + passages[k % 100] + "".join(r.choices(letters, k=1000))) for k in range(300)]
    calls = {}
    assert bytes_by_steps(rows, 3, calls=calls) == brute_bytes(rows, 50)
    stretches = 300 * 1000 / 16  # about as many segments
    assert calls["anchors"] < 40 * 300 and calls["keys"] < 40 * 300, calls
    assert calls["texts"] < 5 * stretches and calls["verdicts"] < 5 * stretches, calls


def test_bytes_end_to_end(monkeypatch):
    """Texts that are laid end to end or cut into blocks give what they give alone: lengths about a window's and a block's,
    repeats over the edges of both, runs, equal rows, ends of texts that together make another text's window."""
    r = random.Random(14)
    long = "".join(r.choices("abcdef ", k=400))
    for _ in range(12):
        rows = []
        for i in range(r.randrange(2, 15)):
            a, n = r.randrange(300), r.choice([0, 8, 9, 10, 11, 49, 50, 51, 63, 64, 65, 100, 300])
            own = "".join(r.choices("uvwxyzé", k=r.choice([0, 1, 7, 30])))
            rows.append((i, r.choice([own, "a" * n, "ab" * n, long[:9]]) + long[a : a + n] + r.choice([own, "a" * 70, ""])))
        rows += [rows[-1], (100, long[:30]), (101, long[30:60]), (-1, long[5:55])]
        monkeypatch.setattr(W, "BYTES", r.choice([7, 20, 64, 1 << 15]), raising=False)
        for window, gram in ((9, 4), (50, 20)):
            for split in (W.SPLIT, 1):
                for groups in (1, 3):
                    assert bytes_by_steps(rows, groups, window, gram, split) == brute_bytes(rows, window), rows


def test_known_numbers(monkeypatch):
    r = np.random.default_rng(15)
    for n in (0, 1, 2, 3, 1000):
        told = r.integers(0, 1 << 63, n, np.uint64)
        asked = np.concatenate((told[::2], told[:5], r.integers(0, 1 << 63, 50, np.uint64))) & ~np.uint64(1)
        marks = {x & ~1: x & 1 for x in told.tolist()}
        for few in (0, 10_000):
            monkeypatch.setattr(W, "FEW", few)
            hit, mark = W._Known(told).find(asked)
            assert [(k, marks[x]) for k, x in enumerate(asked.tolist()) if x in marks] == list(zip(hit.tolist(), mark.tolist(), strict=True))


def test_short_repeats_send_no_texts(spark, monkeypatch):
    """Passages of 20 to 29 bytes that many documents share give anchors in common and no window: no text is sent. Beside
    them runs and true repeats, whose texts are gone once they are judged."""
    r = random.Random(12)
    letters = "abcdefghijklmnopqrstuvwxyz"
    short = ["".join(r.choices(letters, k=r.randrange(20, 30))) for _ in range(6)]
    rows = [(k, "".join(x for _ in range(12) for x in ("".join(r.choices(letters, k=40)), r.choice(short)))) for k in range(60)]
    sent, tables, written = [], [], W.written

    def counted(df, name, *args):
        out = written(df, name, *args)
        if name == "segment-texts":
            tables.append(out._tracelake_path.removeprefix("file://"))
            sent.append(out.where("kind = 0").count())
        return out

    monkeypatch.setattr(W, "written", counted)
    long = "".join(r.choices(letters, k=70))
    more = [*rows, (60, long + "a" * 300), (61, "a" * 90 + long), (62, "ab" * 80 + long[:49]), (None, long), (63, "x" + "ab" * 200 + long[5:60] + "y")]
    for these, split in ((rows, W.SPLIT), (more, W.SPLIT), (more, 1)):
        df = spark.createDataFrame(these, "doc_id long, text string")
        assert as_rows(suffix_array.dedup_bytes(df, split=split), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute_bytes(these, 50)
    assert sent[0] == 0 and min(sent[1:]) > 0
    assert not any(Path(t, "kind=0").exists() for t in tables)


def test_equal_hashes_of_unequal_words(spark):
    """Words whose polynomial hashes modulo 2**64 collide whatever the odd base: units decide, not hashes."""
    odd = "".join("ab"[k.bit_count() % 2] for k in range(4096))
    even = "".join("ba"[k.bit_count() % 2] for k in range(4096))
    assert len(set(W.word_values(f"{odd} {even}".encode())[0].tolist())) == 1
    same = " ".join(f"w{k}" for k in range(34))
    rows = [(1, f"{same} {odd}"), (2, f"{same} {even}"), (3, f"{odd} " * 40), (4, f"{odd} " * 39 + even), (5, odd + "x" + even), (6, even + "y" + odd)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for split in (W.SPLIT, 1):
        got = as_rows(substrings.dedup_substrings(df, split=split), "doc_id", "n_words", "n_removed", "kept_sha256")
        assert got == brute_substrings(rows, 35) and {r[0]: r[2] for r in got}[1] == 0
        assert as_rows(suffix_array.dedup_bytes(df, split=split), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute_bytes(rows, 50)


def test_repeats_at_any_partition_count(spark, small):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    want = brute_substrings(listed(small), 35), brute_bytes(listed(small), 50)
    try:
        for n in (1, 23):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            assert as_rows(substrings.dedup_substrings(small), "doc_id", "n_words", "n_removed", "kept_sha256") == want[0]
            assert as_rows(suffix_array.dedup_bytes(small), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == want[1]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_suffix_array_takes_linear_time():
    """Increasing, decreasing, equal and random symbols, periods, and Fibonacci words."""
    import time

    a, b = "a", "ab"
    while len(b) < 64_000:
        a, b = b, b + a
    makers = {
        "up": lambda n: "".join(map(chr, range(256, 256 + n))), "down": lambda n: "".join(map(chr, range(256 + n, 256, -1))), "same": lambda n: "a" * n,
        "two": lambda n: "ab" * (n // 2), "saw": lambda n: ("".join(map(chr, range(97, 197))) * n)[:n], "fibonacci": lambda n: b[:n], "random": lambda n: "".join(random.Random(n).choices("abcd", k=n)),
    }
    for name, make in makers.items():
        took = []
        for n in (8_000, 32_000):
            text = make(n) + "\0"
            began = time.perf_counter()
            got = suffix_array.suffix_array(text)
            took.append(time.perf_counter() - began)
            if n == 8_000 and name != "same":
                assert got == sorted(range(len(text)), key=lambda i: text[i:])
        assert took[1] < 12 * took[0] + 0.2, (name, took)


def test_suffix_array():
    r = random.Random(1)
    for _ in range(1500):
        text = "".join(r.choice("\1abc"[: r.randrange(1, 5)]) for _ in range(r.randrange(30))) + "\0"
        assert suffix_array.suffix_array(text) == sorted(range(len(text)), key=lambda i: text[i:])


def slow_fingerprint(text):
    from xxhash import xxh64

    words = [w for w in WHITE.split("".join(c.lower() if "A" <= c <= "Z" else c for c in text)) if w]
    if not words:
        return 0
    hashes = [xxh64(" ".join(words[i : i + 3]).encode(), seed=42).intdigest() for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def test_simhash(docs):
    rows = [(i, slow_fingerprint(t)) for i, t in listed(docs)]
    prints = sorted({f for _, f in rows})
    parent = {f: f for f in prints}

    def root(f):
        while parent[f] != f:
            f = parent[f]
        return f

    for k, a in enumerate(prints):
        for b in prints[k + 1 :]:
            if (a ^ b).bit_count() <= 2:
                parent[root(b)] = root(a)
    least = {}
    for i, f in rows:
        if i is not None:
            least[root(f)] = min(least.get(root(f), i), i)
    want = Counter((i, f"{f:016x}", least.get(root(f))) for i, f in rows)
    assert as_rows(simhash.near_duplicates(docs), "doc_id", "fingerprint", "component_id") == want
    kept = simhash.kept_rows(docs)
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(least.get(f) for f in {root(f) for _, f in rows})


def test_simhash_kept_rows(spark):
    """Rows that share an id stay apart, a component keeps one row, and columns of any name come back."""
    one, two = "alpha beta gamma delta epsilon zeta eta theta iota kappa", "some other text of quite another kind and length than that"
    rows = [(3, one, 1, 1, 1), (5, one, 2, 2, 2), (5, two, 3, 3, 3), (None, two, 4, 4, 4), (None, None, 5, 5, 5), (7, "", 6, 6, 6), (7, "", 7, 7, 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _row long, _keep long, _MARK long").repartition(3)
    got = simhash.kept_rows(df)
    assert got.columns == df.columns
    kept = sorted(tuple(r)[:3] for r in got.collect())
    assert kept[:2] == [(3, one, 1), (5, two, 3)] and kept[2][0] == 7 and len(kept) == 3


def test_golay_keys():
    r = np.random.default_rng(5)
    base = r.integers(0, 1 << 64, 400, dtype=np.uint64)

    def sets(prints):
        out = [set() for _ in prints]
        for key, owner in zip(*(x.tolist() for x in simhash.bucket_keys(prints)), strict=True):
            out[owner].add(key)
        return out

    for errors in range(3):
        other = base.copy()
        for i in range(len(other)):
            for b in r.choice(64, errors, replace=False):
                other[i] ^= np.uint64(1 << int(b))
        assert all(a & b for a, b in zip(sets(base), sets(other), strict=True))


def test_large_buckets(monkeypatch):
    r = np.random.default_rng(6)
    base = r.integers(0, 1 << 64, 40, dtype=np.uint64)
    prints = np.unique(np.concatenate([base, *(base ^ np.uint64(1 << int(i)) for i in r.integers(0, 64, 20))]))
    joined = simhash.links(prints)
    monkeypatch.setattr(simhash, "PAIRS", 5)
    again = simhash.links(prints)
    assert all((a == b).all() for a, b in zip(joined, again, strict=True)) and len(prints) - len(joined[0]) == 40


def test_components(spark):
    r = random.Random(3)
    pairs = {tuple(sorted(r.sample(range(300), 2))) for _ in range(200)} | {(k, k + 1) for k in range(400, 460)}
    got = {x.v: x.root for x in simhash.components(spark.createDataFrame(sorted(pairs), "u long, v long")).collect()}
    parent = {}

    def root(x):
        while parent.get(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    assert got == {x: root(x) for p in pairs for x in p if root(x) != x}


def test_language(small):
    truth = {r.doc_id: r.lang for r in small.collect()}
    got = language.identify(small).collect()
    assert len(got) == len(truth)
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {i for i in truth if zlib.crc32(str(i).encode()) % 4 == 2}
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in got)


def test_language_hard(hard):
    got = {r.doc_id: r.lang_pred for r in language.identify(hard).collect()}
    assert all(got[i] == "und" for i in (1, 2, 3, 14)) and got[17] != "und"
    kept = language.accepted(hard)
    assert kept.columns == hard.columns and not {1, 2, 3, 14} & {r.doc_id for r in kept.collect()}


def brute_phrases(text, sample):
    n = at = 0
    while at < len(text):
        end = at + (text[at] not in sample)
        while end < len(text) and text[(at + (text[at] not in sample)) : end + 1] in sample:
            end += 1
        at, n = end, n + 1
    return n


def test_language_phrases(monkeypatch):
    """Against a parse by plain substring search; phrases go on across words."""
    r = random.Random(31)
    for _ in range(300):
        samples = [language.spaced(["".join(r.choices("abc", k=r.randrange(1, 5))) for _ in range(12)]) for _ in range(2)]
        parser = language.CrossParser(tuple(zip("xy", samples, strict=True)))
        text = language.spaced(["".join(r.choices("abcd", k=r.randrange(1, 5))) for _ in range(8)])
        want = [brute_phrases(text, s) for s in samples]
        assert parser.phrases(text) == want
        monkeypatch.setattr(language, "STRETCH", r.randrange(1, 9))
        k = min((0, 1), key=lambda k: (want[k] * parser.costs[k], k))
        assert parser.cheapest(text) == (k, want[k])
    parser = language.CrossParser((("en", " the old man and the sea "),))
    assert parser.phrases(" old man and the ") == [1] and parser.phrases(" the man ") == [2]


def test_language_by_brute_force(small):
    """Predictions and scores of a whole table by substring search in the same samples."""
    from math import log2

    sample = language.training_sample(small, "doc_id", "text", "lang")
    assert sorted(sample) == ["de", "en", "es", "fr"] and all(len(t.replace(" ", "")) <= language.CHARS + 100 for t in sample.values())
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(small).collect()}
    texts = sorted((len(t), i, t) for i, t in listed(small))[:60]
    for _, i, t in texts:
        words = language.WORD.findall(t.lower())
        if any(c.isalpha() for w in words for c in w):
            text = language.spaced(words)
            counts = {lang: brute_phrases(text, s) for lang, s in sample.items()}
            best = min(sample, key=lambda lang: (counts[lang] * log2(len(sample[lang])), lang))
            assert got[i] == (best, round(1 - counts[best] / len(text), 6))
        else:
            assert got[i] == ("und", 0.0)


def test_language_clashing_names(spark):
    df = spark.createDataFrame([(1, "the house and the garden", "en", 1, 2), (2, "12", "en", 3, 4), (3, "das haus und der garten", "de", 5, 6)], "doc_id long, text string, lang string, _lang_pred long, _LANG_SCORE long")
    assert {tuple(r) for r in language.accepted(df).collect()} == {(1, "the house and the garden", "en", 1, 2), (3, "das haus und der garten", "de", 5, 6)}


def test_language_of_numerals():
    """Signs that are words to the parser and no letters."""
    parser = language.CrossParser((("de", " der die "), ("en", " the of ")))
    for text in ("½ ² ①", "½ ² ① Ⅷ", "½ ² ① Ⅷ " * 9):
        assert parser.predict(text) == ("und", 0.0)
    assert parser.predict("½ ² ① Ⅷ the")[0] == "en"


def test_media(docs):
    want = Counter()
    for i, t in listed(docs):
        raw = t.encode()
        payload = raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw))
        want[(i, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))] += 1
    got = media.text_round_trip(docs)
    assert as_rows(got, "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32") == want


def test_media_codecs():
    r = random.Random(8)
    for data in (b"", b"a", b"aaaa" * 900, r.randbytes(20000), b"the of " * 9000, bytes(300)):
        assert media.lzw_decode(media.lzw_encode(data)) == data
        assert media.packbits_decode(media.packbits_encode(data), len(data)) == data
    for n in (1, 64, 65, 200_000, 300_001):
        payload = media.padded(r.randbytes(n))
        assert b"".join(p.data for p in media.read_pages(media.write_tiff(payload))) == payload


def test_media_foreign_file():
    """A big-endian file of 16-bit samples, LZW, with the predictor."""
    import struct

    grid = np.arange(6 * 5, dtype=">u2").reshape(6, 5) * 1000
    raw = np.diff(grid.astype("u2"), axis=1, prepend=np.zeros((6, 1), "u2")).astype(">u2").tobytes()
    strip = media.lzw_encode(raw)
    tags = [(256, 3, 5), (257, 3, 6), (258, 3, 16), (259, 3, 5), (273, 4, 8), (278, 3, 6), (279, 4, len(strip)), (317, 3, 2)]
    body = b"".join(struct.pack(">HHI", t, k, 1) + (struct.pack(">HH", v, 0) if k == 3 else struct.pack(">I", v)) for t, k, v in tags)
    strip += b"\0" * (len(strip) % 2)
    data = b"MM\0*" + struct.pack(">I", 8 + len(strip)) + strip + struct.pack(">H", len(tags)) + body + b"\0\0\0\0"
    (page,) = media.read_pages(data)
    assert (np.frombuffer(page.data, "u2").reshape(6, 5) == grid).all()


def tiff(tags, body, e="<"):
    """One directory after the bytes of body, which begin at 8."""
    import struct

    code = {1: "B", 3: "H", 4: "I"}
    head = (b"II*\0" if e == "<" else b"MM\0*") + struct.pack(e + "I", 8 + len(body))
    fields = b""
    for tag, kind, value in sorted(tags):
        raw = struct.pack(e + code[kind], value) if isinstance(value, int) else value[0]
        fields += struct.pack(e + "HHI", tag, kind, 1 if isinstance(value, int) else value[1]) + raw.ljust(4, b"\0")
    return head + body + struct.pack(e + "H", len(tags)) + fields + b"\0" * 4


def test_media_small_samples_and_planes():
    r = np.random.default_rng(3)
    for bits in (1, 2, 4):
        grid = r.integers(0, 1 << bits, (5, 11), dtype=np.uint8)
        each = (grid[:, :, None] >> np.arange(bits - 1, -1, -1) & 1).astype(np.uint8).reshape(5, -1)
        body = np.packbits(each, axis=1).tobytes()
        (page,) = media.read_pages(tiff([(256, 3, 11), (257, 3, 5), (258, 3, bits), (259, 3, 1), (273, 4, 8), (278, 3, 5), (279, 4, len(body))], body))
        assert (np.frombuffer(page.data, np.uint8).reshape(5, 11) == grid).all()
    a, b = (r.integers(0, 256, (3, 2), dtype=np.uint8) for _ in range(2))
    import struct

    body = a.tobytes() + b.tobytes() + struct.pack("<2I2I", 8, 14, 6, 6)
    (page,) = media.read_pages(tiff([(256, 3, 2), (257, 3, 3), (258, 3, 8), (259, 3, 1), (273, 4, (struct.pack("<I", 20), 2)), (277, 3, 2), (278, 3, 3), (279, 4, (struct.pack("<I", 28), 2)), (284, 3, 2)], body))
    assert (np.frombuffer(page.data, np.uint8).reshape(3, 2, 2) == np.stack((a, b), axis=2)).all()


def test_media_sizes_are_checked_first():
    """A short file that claims a vast page takes no memory."""
    for compression in (1, 5, 8, 32773, 32946):
        vast = [(256, 4, 2**31), (257, 4, 2**31), (258, 3, 8), (259, 3, compression), (273, 4, 8), (278, 4, 2**31), (279, 4, 4)]
        with pytest.raises(media.BadTiff, match="larger"):
            media.read_pages(tiff(vast, b"abcd"))
        rows = [(256, 4, 2**31), (257, 4, 2**31), (258, 3, 8), (259, 3, compression), (273, 4, 8), (278, 4, 1), (279, 4, 4)]
        with pytest.raises(media.BadTiff, match="number of segments"):
            media.read_pages(tiff(rows, b"abcd"))
    with pytest.raises(media.BadTiff):
        media.read_pages(tiff([(256, 4, 0), (257, 4, 5), (273, 4, 8), (279, 4, 4)], b"abcd"))


def test_media_feature_and_digest():
    from math import log2

    payload = bytes(range(64)) * 2
    counts = Counter(payload)
    entropy = -sum(c / 128 * log2(c / 128) for c in counts.values())
    assert media.feature(payload) == f"mean=31.5000;std={np.std(list(payload)):.4f};entropy={entropy:.4f};step=1.0000;distinct=64"
    big = media.write_tiff(media.padded(random.Random(2).randbytes(330_000)))
    assert [(p.compression, p.tiled) for p in media.read_pages(big)] == [*media.FORMS, media.FORMS[0]]


def test_tiff_pages(spark):
    cut = media.write_tiff(media.padded(random.Random(1).randbytes(100_000)))[:-300]
    rows = [(1, media.write_tiff(media.padded(b"x" * 150_000))), (2, None), (3, b"no tiff"), (4, media.write_tiff(bytes(64))[:40]), (5, cut)]
    got = media.tiff_pages(spark.createDataFrame(rows, "k long, file binary"), "k", "file").collect()
    assert [(r.id, r.page, r.compression, r.tiled) for r in got if r.error is None] == [(1, 0, 8, False), (1, 1, 8, True), (1, 2, 32773, False), (5, 0, 8, False)]
    assert {r.id for r in got if r.error} == {3, 4, 5}


def test_bpe(docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter()
    for i, t in listed(docs):
        ids = library.encode(t, add_special_tokens=False).ids
        want[(i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest())] += 1
    assert as_rows(bpe.encode_decode(docs), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == want


def test_bpe_on_random_texts():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library, mine, r = Tokenizer.from_file(path), bpe.model(path), random.Random(7)
    texts = ["".join(r.choice("abcdeth") for _ in range(n)) for n in (255, 256, 257, 5000, 20001)] + ["'" * 900, "x" * 4000, "日本語" * 400, "a\x1cb\x85c　d"]
    texts += ["".join(chr(r.choice([r.randrange(9, 127), r.randrange(128, 0x3000), r.randrange(0x10000, 0x1FFFF)])) for _ in range(60)) for _ in range(200)]
    for text in texts:
        text = unicodedata.normalize("NFD", text) if r.random() < 0.2 else text
        ids = library.encode(text, add_special_tokens=False).ids
        n, raw, decoded = mine.encode(text)
        assert (n, np.frombuffer(raw, "<u4").tolist(), decoded) == (len(ids), ids, library.decode(ids, skip_special_tokens=False))


def test_empty_tables(empty, spark):
    for f in (exact_dedup.exact_dedup, pii.find_pii, packing.pack, substrings.dedup_substrings, simhash.near_duplicates, language.identify, suffix_array.dedup_bytes, media.text_round_trip, bpe.encode_decode):
        assert f(empty).count() == 0


@pytest.mark.parametrize(
    "text",
    ["one " + "1" * 1_000_000 + "a", "one " * 1_000_000 + "onex", "x (at) y" + " " * 1_000_000, "x at y " + " " * 1_000_000 + "dot", "+1" + "(" * 1_000_000, "x at " + "a." * 500_000, "аa@b.cc " * 50_000, "a at b dot " * 50_000],
    ids=lambda t: t[:12],
)
def test_pii_takes_linear_time(text):
    import time

    began = time.perf_counter()
    pii.scan(text)
    assert time.perf_counter() - began < 4


def test_pii_spelled_runs_against_one_pattern():
    """The run that one backtracking pattern finds in short texts."""
    word = "|".join(pii.DIGIT_WORDS)
    whole = re.compile(rf"(?i)(?<![A-Za-z0-9])(?:(?:plus|{word})[ .,-]*+)(?:(?:{word}|dot|point|dash|hyphen|[0-9]++)[ .,-]*+)*(?:{word}|[0-9]++)(?![A-Za-z0-9])")
    r = random.Random(21)
    items = ["one", "two", "plus", "dot", "dash", "12", "3", " ", " ", " ", ", ", ".", "x", "someone", "oneone", "\n", "ONE"]
    for _ in range(5000):
        text = "".join(r.choice(items) for _ in range(r.randrange(14)))
        assert [(run[0].start(), run[-1].end()) for run in pii._spelled_runs(text)] == [m.span() for m in whole.finditer(text)], text


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_against_sql(spark, sf, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = queries.queries()[name](spark, sf)
    columns = sorted(got.columns)
    want = con.sql(f"SELECT {', '.join(columns)} FROM ({queries.oracle_sql()[name]})").fetchall()
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in got.select(*columns).collect())


def test_packing_ids_on_random_texts():
    """tiktoken's ids are those of the tokenizers library, for characters of every kind."""
    import public_tokenizers
    from tokenizers import Tokenizer

    library, path, r = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), packing.default_vocabulary(), random.Random(51)
    kinds = [lambda: chr(r.randrange(32, 127)), lambda: r.choice(" \t\n\r\x0b\x0c\x85\u00a0\u2003\u3000"), lambda: chr(r.randrange(0xA0, 0x250)), lambda: chr(r.randrange(0x370, 0x3000)), lambda: chr(r.randrange(0x4E00, 0x9FFF)), lambda: chr(r.randrange(0x1F300, 0x1F900)), lambda: r.choice(["'s", "'LL", "<|endoftext|>", "  ", "123", "\u0301", "\u200d"])]
    texts = ["".join(r.choice(kinds)() for _ in range(r.randrange(1, 40))) for _ in range(8000)]
    texts += ["".join(r.choice(kinds[:2])() for _ in range(60)) for _ in range(4000)] + ["a" * 5000, " " * 3000, "\n" * 700, "é" * 900]
    for text, found in zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert packing.token_ids(text, path).tolist() == [*found.ids, 0], repr(text)
