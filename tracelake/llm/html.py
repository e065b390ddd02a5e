"""HTML extraction by nearest-URL page differencing.

A page is read into text lines, one per block, each with the elements around it. Lines inside elements that never hold
an article (menus, headers, footers, sidebars, notices, adverts, forms, comments) are furniture, and where a page names
its article (``article``, ``main`` or the like) so are the lines outside it. Pages are sorted by host and URL path, and
each is paired with the one of its two neighbours there whose path has the longer common beginning. All lines of a pair
are aligned by longest common subsequence. Of a page that names no article, every line that both pages share goes. Of
a page that does, a shared line of its article goes only if both pages print it among their furniture as well: a text
that two pages of a host both print as their article stays whole, and so does one that the other page quotes in an
advert.

Pages are dealt out in sorted runs, and a copy of a run's first and last page goes to the run beside it, so every page
meets its nearest neighbours however many runs there are. The driver holds two keys a run; a worker holds three pages,
so memory is bounded by the longest page. A line is dealt out as its text if it may be kept, and as a hash. Pages equal
in host, path, id and url are in order of a hash of the html.

Defined results: null or empty html gives empty text; a page without a neighbour on its host keeps its lines; a null
url is a host of its own; if differencing would take every line of a page, it takes none (the two are copies);
repeated rows are separate pages; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from tracelake.llm.common import shuffle_partitions

# HTML element names by what they mean here, and words that name furniture in class, id and role.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split())
DROPPED = frozenset("nav header footer aside form menu dialog head title script style noscript template iframe object svg math canvas audio video select textarea button datalist input search".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp".split())
ARTICLE = frozenset(("article", "main"))
FURNITURE = frozenset("ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments cookie cookies consent copyright disclaimer disqus footer gdpr header masthead menu modal nav navbar navigation newsletter notice overlay pager pagination popup promo promos promotion related replies responses share sharing sidebar social sponsor sponsors sponsored subscribe subscription toolbar widget widgets".split())
QUALIFIERS = frozenset("area bar block bottom box buttons column container form global inner item left links list main outer page panel primary right row secondary section site slot small large top unit wrap wrapper".split())
ARTICLE_NAMES = frozenset("article-body articlebody entry-content post-content postcontent post-body postbody article-content articlecontent story-body storybody main-content maincontent".split())
ARTICLE_ROLES, DROPPED_ROLES = frozenset(("main", "article")), frozenset(("navigation", "banner", "contentinfo", "complementary", "search", "form", "menu", "menubar", "dialog", "alert", "alertdialog"))
#: Start tags that end an open p, and elements of which a new one ends an open one.
ENDS_P = BLOCKS - {"body", "html", "option", "optgroup", "title", "tbody", "td", "tfoot", "th", "thead", "tr", "caption", "legend", "summary", "li", "dd", "dt"} | {"li", "dd", "dt"}
SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
HOLDS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "option": ("select", "datalist"), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table")}

#: Attributes as a browser reads them: quotes delimit a value only right after the equals sign.
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>\"'][^\s>]*+)|[^>])*+)(?:>|\Z)|([^<]+|<)", re.S)
ATTRIBUTE = re.compile(r"([^\s=/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"'][^\s>]*)))?")
SPACE = re.compile(r"\s+")
#: Cells of an alignment table that is held whole.
TABLE_CELLS = 4_000_000


@dataclass(slots=True)
class Line:
    text: str
    dropped: bool
    article: bool


def _furniture(names: list[str]) -> bool:
    """Whether one of the class names, as a whole, is a word for furniture, alone or with words that add nothing to it:
    ``site-header`` and ``comment-list`` are, ``article-header`` and ``has-sidebar`` are not."""
    for name in names:
        parts = re.split(r"[-_]+", name)
        if any(p in FURNITURE for p in parts) and all(p in FURNITURE or p in QUALIFIERS or not p for p in parts):
            return True
    return False


def _about(name: str, attributes: str) -> tuple[bool, bool]:
    """Whether an element is furniture, and whether it is named as the article."""
    dropped, article = name in DROPPED, name in ARTICLE
    if attributes and attributes.strip():
        for m in ATTRIBUTE.finditer(attributes):
            key = m[1].lower()
            value = unescape(m[2] or m[3] or m[4] or "").lower()
            if key in ("class", "id"):
                names = value.split()
                if name not in ("html", "body") and not article:
                    article = not ARTICLE_NAMES.isdisjoint(x.replace("_", "-") for x in names)
                    dropped = dropped or not article and _furniture(names)
                elif name == "article" and ("comment" in names or "comments" in names):
                    dropped, article = True, False
            elif key == "role":
                dropped = dropped or value in DROPPED_ROLES
                article = article or value in ARTICLE_ROLES
            elif key == "hidden" or key == "aria-hidden" and value == "true":
                dropped = True
            elif key == "itemprop" and value == "articlebody":
                article = True
    return dropped, article and not dropped


def lines(html: str) -> list[Line]:
    """Every block's text in page order, white space joined, character references decoded."""
    out: list[Line] = []
    held: list[str] = []
    stack: list[tuple[str, bool, bool]] = []  # name, inside furniture, inside article

    def flush() -> None:
        if held:
            text = SPACE.sub(" ", unescape("".join(held))).strip()
            held.clear()
            if text:
                _, dropped, article = stack[-1] if stack else ("", False, False)
                out.append(Line(text, dropped, article))

    def close(k: int) -> None:
        flush()
        del stack[k:]

    at, size = 0, len(html)
    while at < size:
        m = TOKEN.match(html, at)
        if m is None:  # a tag whose quotes never end: its sign is text
            held.append(html[at])
            at += 1
            continue
        at = m.end()
        if m[4] is not None:
            held.append(m[4])
        elif m[2]:
            name = m[2].lower()
            if m[1]:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == name:
                        if name in BLOCKS or name in DROPPED or any(s[0] in BLOCKS for s in stack[k + 1 :]):
                            if name in BLOCKS or name in DROPPED:
                                close(k)
                        else:
                            if stack[k][1:] != (stack[k - 1][1:] if k else (False, False)):
                                flush()
                            del stack[k:]
                        break
                else:
                    if name == "p":
                        flush()
                continue
            if name in ENDS_P:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == "p":
                        close(k)
                        break
                    if stack[k][0] in ("table", "td", "th", "button", "object", "template"):
                        break
            if name in SAME:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] in SAME[name]:
                        close(k)
                        break
                    if stack[k][0] in HOLDS[name]:
                        break
            if name in BLOCKS:
                flush()
            if name in VOID:
                if name == "br":
                    held.append(" ")
                continue
            dropped, article = _about(name, m[3])
            _, outer_dropped, outer_article = stack[-1] if stack else ("", False, False)
            state = (name, dropped or outer_dropped, (article or outer_article) and not (dropped or outer_dropped))
            if state[1:] != (outer_dropped, outer_article):
                flush()
            if name in RAW:
                end = re.compile(rf"(?i)</{re.escape(name)}\b[^>]*>").search(html, at)
                at = end.end() if end else size
                continue
            if not (m[3] or "").rstrip().endswith("/") or name in BLOCKS:
                stack.append(state)
    flush()
    return out


def _code(text: str) -> int:
    return xxh64_intdigest(text) - (1 << 63)


@dataclass(slots=True)
class Page:
    """A page as it is dealt out: all its lines as hashes, which of them may be kept (1) or are furniture (0), the
    texts of the former, and whether the page names its article."""

    page_id: int | None
    url: str | None
    host: str
    path: str
    codes: list[int]
    flags: bytes
    texts: list[str]
    named: bool
    copy: bool = False


def parsed(html: str | None) -> tuple[list[int], bytes, list[str], bool]:
    """The last columns of a Page but one: codes, flags, texts and named."""
    found = lines(html or "")
    named = any(x.article and not x.dropped for x in found)
    flags = bytes(not x.dropped and (x.article or not named) for x in found)
    return [_code(x.text) for x in found], flags, [x.text for x, keep in zip(found, flags, strict=True) if keep], named


def _row(table: np.ndarray, y: np.ndarray, code: int) -> np.ndarray:
    """The next row of the usual table of lengths."""
    hit = np.concatenate(([0], (table[:-1] + 1) * (y == code)))
    return np.maximum.accumulate(np.maximum(table, hit)).astype(np.int32)


def _subsequence(x: np.ndarray, y: np.ndarray, i0: int, j0: int) -> list[tuple[int, int]]:
    """Pairs of positions, counted from i0 and j0, of a longest common subsequence; halves x while the table would be
    large."""
    if not len(x) or not len(y):
        return []
    if len(x) == 1:
        at = np.flatnonzero(y == x[0])
        return [(i0, j0 + int(at[0]))] if len(at) else []
    if len(x) * len(y) > TABLE_CELLS:
        half = len(x) // 2
        front = back = np.zeros(len(y) + 1, np.int32)
        for code in x[:half]:
            front = _row(front, y, code)
        for code in x[:half - 1 : -1] if half else x[::-1]:
            back = _row(back, y[::-1], code)
        cut = int(np.argmax(front + back[::-1]))
        return _subsequence(x[:half], y[:cut], i0, j0) + _subsequence(x[half:], y[cut:], i0 + half, j0 + cut)
    table = [np.zeros(len(y) + 1, np.int32)]
    for code in x:
        table.append(_row(table[-1], y, code))
    out, i, j = [], len(x), len(y)
    while i and j:
        if table[i][j] == table[i - 1][j]:
            i -= 1
        elif table[i][j] == table[i][j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            out.append((i0 + i, j0 + j))
    return out[::-1]


def shared_lines(a: list, b: list) -> list[tuple[int, int]]:
    """Positions in a and b of a longest common subsequence: equal ends first, then what lies between."""
    start = 0
    while start < min(len(a), len(b)) and a[start] == b[start]:
        start += 1
    end = 0
    while end < min(len(a), len(b)) - start and a[-1 - end] == b[-1 - end]:
        end += 1
    names = {v: k for k, v in enumerate(set(a[start : len(a) - end]) & set(b[start : len(b) - end]))}
    x = [i for i in range(start, len(a) - end) if a[i] in names]
    y = [j for j in range(start, len(b) - end) if b[j] in names]
    found = _subsequence(np.array([names[a[i]] for i in x], np.int64), np.array([names[b[j]] for j in y], np.int64), 0, 0)
    return [*((k, k) for k in range(start)), *((x[i], y[j]) for i, j in found), *((len(a) - k, len(b) - k) for k in range(end, 0, -1))]


def _common(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return n


def _kept(here: Page, before: Page | None, after: Page | None) -> list[str]:
    """The lines of a page that stay, given its neighbours."""
    near = [p for p in (before, after) if p is not None and p.host == here.host]
    if not near or not here.texts:
        return here.texts
    other = max(near, key=lambda p: _common(p.path, here.path))
    shared = set(here.codes).intersection(other.codes)
    if here.named:
        shared &= {c for c, flag in zip(here.codes, here.flags, strict=True) if not flag}
        shared &= {c for c, flag in zip(other.codes, other.flags, strict=True) if not flag}
    if shared.isdisjoint(c for c, flag in zip(here.codes, here.flags, strict=True) if flag):
        return here.texts
    gone = {i for i, j in shared_lines(here.codes, other.codes) if here.flags[i] and here.codes[i] in shared and (other.flags[j] or not here.named)}
    places = [i for i, flag in enumerate(here.flags) if flag]
    return here.texts if len(gone) == len(places) else [x for i, x in zip(places, here.texts, strict=True) if i not in gone]


#: What pages are in order of.
KEYS = ("host", "path", "page_id", "url", "mark")


def _ordered(key: tuple) -> tuple:
    """A key that Python orders as Spark does, nulls first."""
    host, path, i, url, mark = key
    return host, path, i is not None, i or 0, url is not None, url or "", mark


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""

    n = shuffle_partitions(pages.sparkSession)
    read = pages.selectExpr(f"cast(`{id_col}` as bigint) as page_id", f"cast(`{url_col}` as string) as url", f"cast(`{html_col}` as string) as html")
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    path = F.regexp_extract(F.coalesce("url", F.lit("")), "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    read = read.select(host.alias("host"), path.alias("path"), "page_id", "url", F.xxhash64("html").alias("mark"), "html")
    ends = read.select(*KEYS).repartitionByRange(n, *KEYS).groupBy(F.spark_partition_id().alias("k")).agg(F.min(F.struct(*KEYS)).alias("a"), F.max(F.struct(*KEYS)).alias("b")).collect()
    ends = sorted((_ordered(r.a), _ordered(r.b)) for r in ends)
    firsts, lasts = [a for a, _ in ends], [b for _, b in ends]

    def runs(key: tuple) -> list[tuple[int, bool]]:
        """The run of a page, and those beside it that get a copy; whether it is a copy."""
        k = bisect_right(firsts, key) - 1
        out = [(k, False)]
        if key == firsts[k] and k and lasts[k - 1][0] == key[0]:
            out.append((k - 1, True))
        if key == lasts[k] and k + 1 < len(firsts) and firsts[k + 1][0] == key[0]:
            out.append((k + 1, True))
        return out

    def parse(batches):
        for batch in batches:
            keys = list(zip(*(batch.column(k).to_pylist() for k in range(len(KEYS))), strict=True))
            dealt = [(row, *run) for row, key in enumerate(keys) for run in runs(_ordered(key))]
            found = [parsed(h) for h in batch.column(len(KEYS)).to_pylist()]
            at = pa.array([d[0] for d in dealt], pa.int32())
            columns = [batch.column(k).take(at) for k in range(len(KEYS))]
            columns += [pa.array([found[d[0]][k] for d in dealt], kind) for k, kind in enumerate((pa.list_(pa.int64()), pa.binary(), pa.list_(pa.string()), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([d[1] for d in dealt], pa.int32()), pa.array([d[2] for d in dealt], pa.bool_())], names=[*KEYS, "codes", "flags", "texts", "named", "run", "copy"])

    def differ(batches):
        before = here = None

        def rows():
            nonlocal before, here
            for batch in batches:
                for host, path, i, url, _, codes, flags, texts, named, _, copy in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    after = Page(i, url, host, path, codes, flags, texts, named, copy)
                    if here is not None and not here.copy:
                        yield here, "\n\n".join(_kept(here, before, after))
                    before, here = here, after
            if here is not None and not here.copy:
                yield here, "\n\n".join(_kept(here, before, None))

        out, size = [], 0
        for page, text in rows():
            out.append((page.page_id, page.url, text, len(text)))
            size += len(text)
            if len(out) == 500 or size > 4 << 20:
                yield _batch(out)
                out, size = [], 0
        if out:
            yield _batch(out)

    def _batch(out):
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.string(), pa.string(), pa.int64()))], names=["page_id", "url", "text", "n_chars"])

    dealt = read.mapInArrow(parse, "host string, path string, page_id bigint, url string, mark bigint, codes array<bigint>, flags binary, texts array<string>, named boolean, run int, copy boolean")
    return (
        dealt.repartitionById(max(1, len(ends)), F.col("run"))
        .sortWithinPartitions(*KEYS)
        .mapInArrow(differ, "page_id bigint, url string, text string, n_chars bigint")
    )
