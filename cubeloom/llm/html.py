"""Main text of web pages by nearest-URL differencing.

A page becomes text lines, one a block. Within each host, pages are sorted by their URL's path, and each is paired with
the ``partners`` pages of other paths around it that share the longest start of the path with its own. The longest common
subsequence of the two pages' lines is what they share. A line goes if at least half of the partners share it, a line within
an ``article`` or ``main`` element if more than half and at least two do: an article published twice, or a paragraph that one
neighbour quotes, is no page furniture. Partners with nothing but the page's own lines, or nearly so, are copies and
don't count. Markup settles what no neighbour can show: lines of menus, headers, footers, sidebars, notices, adverts,
forms, scripts and reader comments go on every page. Of class, id and role, a name rules an element out only if it is such a
word or starts with one (``sidebar-left``, not ``no-sidebar``); never a heading by its id, and inside the article no element
by its id and no paragraph, quote or item by a word that prose uses too (``share``, ``notice``). Nor does a name rule out
what holds ``main``, the first ``article`` or ``h1``, or over half of the page's text: that is a layout's name.

Pages are dealt to ranges of (host, path), so that neither a hot host nor any other has to fit one task; each range is
also sent the nearest paths of the ranges before and after it, so that partners are the same however pages are dealt.

Defined results: null or empty html gives an empty text. A null url counts as a host of its own, ''. A page without a
partner keeps all that markup leaves. Repeated rows are extracted each for itself and, like pages that differ in their
query only, are no partners of each other. Ties: of equally near paths, the earlier in order; a tag that is never closed is text.
Very long pages are read whole, in time that grows with their length (alignment: with the product of two pages' lines,
64 a step). An empty table gives no row. Only id, url and html are read, whatever other columns are named.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cubeloom.llm.common import by_group, map_batches, read, stored

#: Comments and what browsers never show; any other tag. A quoted value with a "<" in it is left to ``_tag_end``.
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|title|textarea|svg|iframe)\b[^<>]*+>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)(?:((?:[^<>\"']|\"[^\"<]*\"|'[^'<]*')*+)>)?|<[!?][^<>]*+>", re.S | re.I)
_NAMED = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_SPACE = re.compile(r"\s+")
_STOP = re.compile("[>\"']")
INLINE = frozenset("a abbr b bdi bdo big br cite code data del dfn em font i img input ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements that hold others and are always closed.
HOLDERS = frozenset("article main nav header footer aside form section div ul ol dl table tbody thead tfoot tr td th figure blockquote fieldset dialog menu select button details body center span".split())
CHROME = frozenset("nav footer aside form menu select button dialog fieldset".split())
#: Words of class, id and role that mark what is not the article, those of them that prose has too, and the words that stand
#: before them in names of a page's parts (fixed values).
CHROME_WORDS = frozenset(
    "ad ads advert adverts advertisement banner promo sponsor sponsored nav navbar navigation menu sidebar breadcrumb breadcrumbs footer masthead cookie cookies "
    "consent popup modal overlay newsletter subscribe signup login comment comments reply replies disqus respond pagination pager skip complementary contentinfo".split()
)
WEAK_WORDS = frozenset("header notice alert share sharing social related recommended copyright widget toolbar search".split())
PART_WORDS = frozenset("site page main top bottom left right global primary secondary post article".split())
#: Elements of running text.
TEXT = frozenset("p h1 h2 h3 h4 h5 h6 blockquote li pre dd dt td figcaption".split())
WEAK, STRONG = 1, 2
OPEN, KEEP, DROP = 0, 1, 2


class _Ends:
    """Where a tag ends: at the next ">" that is not in a quoted value. Once that fails, quotes mean nothing on this page,
    so that each of its characters is looked at a few times only."""

    def __init__(self, page: str):
        self.page, self.quotes, self.last = page, True, page.rfind(">")

    def __call__(self, at: int) -> int:
        start = at
        while self.quotes and (m := _STOP.search(self.page, at)):
            if m[0] == ">":
                return m.end()
            at = self.page.find(m[0], m.end()) + 1
            if not at:
                break
        self.quotes = False
        return self.page.find(">", start) + 1 if start <= self.last else 0


def _tags(page: str) -> Iterator[tuple[int, int, str, str, str]]:
    """Start, end, slash, name and attributes of each tag; comments and the like have no name."""
    at, ends = 0, _Ends(page)
    while m := _TAG.search(page, at):
        name, rest, at = m[3] or "", m[4], m.end()
        if name and rest is None:
            end = ends(at)
            if not end:
                continue  # never closed: text
            rest, at = page[at : end - 1], end
        yield m.start(), at, m[2] or "", name.lower(), rest or ""


def lines(page: str | None) -> list[tuple[int, str]]:
    """The page's blocks in order: what markup says of them (OPEN, KEEP or DROP) and their text."""
    page = page or ""
    out: list[tuple[int, tuple[int, ...], str]] = []
    parts: list[str] = []
    # elements that names rule out: how much text each holds, and whether it holds the article; 0 is one that is always out
    sizes, core = [0], [False]
    stack: list[tuple[str, int, tuple[int, ...]]] = [("", OPEN, ())]
    depth: dict[str, int] = {}
    block = False  # within a block that its own attributes rule out
    at, articles = 0, 0

    def end_block() -> None:
        if parts:
            text = "".join(parts)
            parts.clear()
            text = _SPACE.sub(" ", entities.unescape(text) if "&" in text else text).strip()
            if text:
                _, mark, within = stack[-1]
                for k in within:
                    sizes[k] += len(text)
                out.append((mark, (0,) if block else within, text))

    for start, end, slash, tag, attributes in _tags(page):
        if start > at:
            parts.append(page[at:start])
        at = end
        if not tag:
            continue
        if tag in INLINE and tag != "span":
            if tag == "br":
                parts.append(" ")
            continue
        _, mark, within = stack[-1]
        named = bool(attributes) and not slash and _chrome(attributes, tag, mark == KEEP)
        if tag != "span" or named or (slash and stack[-1][0] == "span" and within):
            end_block()
        elif tag == "span":
            continue
        if not slash and tag in ("article", "main", "h1"):
            articles += tag == "article"
            if tag != "article" or articles == 1:
                for k in within:
                    core[k] = True
        if tag in HOLDERS:
            if slash:
                if depth.get(tag):
                    while True:
                        closed = stack.pop()[0]
                        depth[closed] -= 1
                        if closed == tag:
                            break
            elif not attributes.endswith("/"):
                if tag in CHROME or (tag == "header" and mark != KEEP):
                    within = (0,)
                elif named and tag not in ("body", "main") and 0 not in within:
                    within = (*within, len(sizes))
                    sizes.append(0)
                    core.append(tag == "article" and articles == 1)
                stack.append((tag, KEEP if tag in ("article", "main") else mark, within))
                depth[tag] = depth.get(tag, 0) + 1
            block = False
        else:
            block = bool(named)
    parts.append(page[at:])
    end_block()
    whole = sum(len(t) for _, _, t in out)
    gone = {k for k in range(1, len(sizes)) if not core[k] and 2 * sizes[k] <= whole} | {0}
    return [(DROP if not gone.isdisjoint(within) else mark, t) for mark, within, t in out]


@lru_cache(maxsize=4096)
def _chrome(attributes: str, tag: str, inside: bool) -> bool:
    """Whether names rule an element out; ``inside``: within the article."""
    for kind, *values in _NAMED.findall(attributes):
        if kind.lower() == "id" and (inside or tag in TEXT and tag[0] == "h"):
            continue
        for name in "".join(values).lower().split():
            words = re.split("[_-]+", name)
            strength = max(_strength(words[0]), _strength(words[1]) if len(words) == 2 and words[0] in PART_WORDS else 0)
            if strength == STRONG or strength == WEAK and not (inside and tag in TEXT):
                return True
    return False


def _strength(word: str) -> int:
    return STRONG if word in CHROME_WORDS else WEAK if word in WEAK_WORDS else 0


def common(a: list[int], b: list[int]) -> set[int]:
    """The places in ``a`` of a longest common subsequence with ``b``: common ends first, then bit-parallel rows of the
    table of lengths, a number with a bit for each place of ``b``; long pages are halved at the best place first."""
    out: set[int] = set()
    stack = [(0, len(a), 0, len(b))]
    while stack:
        i, n, j, m = stack.pop()
        while i < n and j < m and a[i] == b[j]:
            out.add(i)
            i, j = i + 1, j + 1
        while i < n and j < m and a[n - 1] == b[m - 1]:
            n, m = n - 1, m - 1
            out.add(n)
        if i == n or j == m:
            continue
        if (n - i) * (m - j) <= 16_000_000 or n - i == 1:
            out.update(i + k for k in _traced(a[i:n], b[j:m]))
            continue
        half = (i + n) // 2
        ahead = _zeros(_lengths(a[i:half], b[j:m])[-1], m - j)
        behind = _zeros(_lengths(a[half:n][::-1], b[j:m][::-1])[-1], m - j)[::-1]
        best = j + int((ahead + behind).argmax())
        stack += [(i, half, j, best), (half, n, best, m)]
    return out


def _lengths(a: list[int], b: list[int], keep: bool = False) -> list[int]:
    """For each start of ``a`` (without ``keep``, the last only): a number whose bit j is 0 where the common length grows at b[j]."""
    places: dict[int, int] = {}
    for j, x in enumerate(b):
        places[x] = places.get(x, 0) | 1 << j
    full = v = (1 << len(b)) - 1
    rows = []
    for x in a:
        u = v & places.get(x, 0)
        v = ((v + u) | (v - u)) & full
        if keep:
            rows.append(v)
    return rows if keep else [v]


def _zeros(v: int, size: int) -> np.ndarray:
    """The common length with the first j of ``b``, for j from 0 to ``size``."""
    bits = np.unpackbits(np.frombuffer(v.to_bytes(-(-size // 8), "little"), np.uint8), count=size, bitorder="little")
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def _traced(a: list[int], b: list[int]) -> list[int]:
    size = -(-len(b) // 8)
    rows = [v.to_bytes(size, "little") for v in _lengths(a, b, True)]
    i, j, out = len(a), len(b), []
    grows = lambda i, j: not rows[i][j >> 3] >> (j & 7) & 1
    while i and j:
        if not grows(i - 1, j - 1):
            j -= 1
        elif i > 1 and grows(i - 2, j - 1):
            i -= 1
        else:
            i, j = i - 1, j - 1
            out.append(i)
    return out


def text_of(found: list[tuple[int, str]], most: set[int], half: set[int]) -> str:
    """The text without the lines that markup drops, those that at least ``half`` of the partners share and, within the
    article, those that ``most`` do."""
    return "\n".join(t for i, (mark, t) in enumerate(found) if mark != DROP and i not in (most if mark == KEEP else half))


def _alike(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return n


class Site:
    """The pages of a range, in order of host and path, and which of their lines their partners share. A page: (host,
    path, hashes of lines, whether it is another range's)."""

    def __init__(self, pages: list[tuple], partners: int):
        self.pages, self.partners = pages, partners
        self.first: list[int] = []  # each path's first page
        self.place: list[int] = []  # each page's path
        for i, p in enumerate(pages):
            if not i or p[:2] != pages[i - 1][:2]:
                self.first.append(i)
            self.place.append(len(self.first) - 1)

    def near(self, i: int) -> list[int]:
        """The page's partners: around it, of other paths of its host, those alike in most of the path."""
        host, path = self.pages[i][:2]
        at, out = self.place[i], []
        for way in (-1, 1):
            k = at + way
            while 0 <= k < len(self.first) and abs(k - at) <= self.partners and self.pages[self.first[k]][0] == host:
                out.append((-_alike(path, self.pages[self.first[k]][1]), abs(k - at), way, self.first[k]))
                k += way
        return [x[-1] for x in sorted(out)[: self.partners]]

    def shared(self, i: int) -> tuple[list[int], list[int]]:
        """The lines that most of the partners share, and those that at least half do."""
        own = self.pages[i][2]
        count, partners = np.zeros(len(own), np.int64), 0
        for k in self.near(i) if len(own) else ():
            other = self.pages[k][2]
            same = common(own, other)
            if 10 * len(same) >= 9 * len(own) or not len(other):
                continue  # a copy
            partners += 1
            count[list(same)] += 1
        if not partners:
            return [], []
        most = count * 2 > partners if partners > 1 else count < 0
        return np.flatnonzero(most).tolist(), np.flatnonzero(count * 2 >= partners).tolist()


def extract(pages: DataFrame, page: str = "html", url: str = "url", key: str = "page_id", range_pages: int = 4000, partners: int = 3) -> DataFrame:
    """``key, url, text, n_chars`` for every row. ``range_pages`` is about how many pages a task pairs; it doesn't change
    results."""
    kind = pages.schema[key].dataType.simpleString()
    rows = pages.select(F.col(key).alias("_k"), F.col(url).alias("_u"), F.col(page).alias("_h"))
    address = F.coalesce(F.col("_u"), F.lit(""))
    rows = rows.withColumn("_x", F.xxhash64(address, F.coalesce(F.col("_h"), F.lit(""))))
    host = F.lower(F.regexp_extract(address, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1))
    path = F.regexp_extract(address, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1)

    def hasher():
        def run(batch: pa.RecordBatch):
            hashed = [[xxhash.xxh3_64_intdigest(t) - (1 << 63) for _, t in lines(h)] for h in batch.column("_h").to_pylist()]
            return [*(batch.column(c) for c in ("_x", "host", "path")), hashed]

        return run

    # what repeats a row, and rows of one path, are neighbours of nothing else: a page a distinct content is enough
    hashed = map_batches(rows.select("_x", host.alias("host"), path.alias("path"), "_h"), hasher, "_x long, host string, path string, l array<long>").dropDuplicates(["_x"])
    ranges = pages.count() // range_pages + 1
    dealt = stored(hashed.repartitionByRange(ranges, "host", "path", "_x").sortWithinPartitions("host", "path", "_x").withColumn("range", F.spark_partition_id().cast("long")))
    if ranges > 1:
        # the outer paths of each range, for the ranges that may look that far; ranges are few next to pages
        numbers = dealt.select("range").distinct().withColumn("at", F.row_number().over(Window.orderBy("range")).cast("long"))
        firsts = dealt.groupBy("range", "host", "path").agg(F.min("_x").alias("_x"))
        up, down = (Window.partitionBy("range").orderBy(F.asc(c) if w else F.desc(c), F.asc("path") if w else F.desc("path")) for c, w in (("host", True), ("host", False)))
        outer = firsts.withColumns({"low": F.row_number().over(up), "high": F.row_number().over(down)}).filter(F.least("low", "high") <= partners)
        outer = outer.join(numbers, "range").select("_x", "at", "low", "high")
        far = F.sequence(F.lit(1), F.lit(partners))
        sent = outer.select("_x", F.explode(F.flatten(F.array(F.when(F.col("high") <= partners, F.transform(far, lambda d: F.col("at") + d)).otherwise(F.array().cast("array<long>")), F.when(F.col("low") <= partners, F.transform(far, lambda d: F.col("at") - d)).otherwise(F.array().cast("array<long>"))))).alias("at"))
        guests = sent.join(numbers, "at").select("_x", "range").join(dealt.drop("range"), "_x").withColumn("guest", F.lit(True))
        dealt = dealt.withColumn("guest", F.lit(False)).unionByName(guests.select("_x", "host", "path", "l", "range", "guest"))
    else:
        dealt = dealt.withColumn("guest", F.lit(False))

    def pairer():
        def run(_, x, hosts, paths, found, guest):
            order = sorted(range(len(x)), key=lambda i: (hosts[i], paths[i], x[i]))
            site = Site([(hosts[i], paths[i], found[i], guest[i]) for i in order], partners)
            out = ([], [], [])
            for at, i in enumerate(order):
                if not guest[i]:
                    most, half = site.shared(at)
                    if half:
                        for column, v in zip(out, (int(x[i]), most, half), strict=True):
                            column.append(v)
            return out if out[0] else None

        return run

    shared = by_group(dealt.select("range", "_x", "host", "path", "l", "guest"), pairer, "_x2 long, most array<int>, half array<int>")
    joined = rows.join(shared, rows["_x"] == shared["_x2"], "left").select("_k", "_u", "_h", "most", "half")

    def extractor():
        def run(batch: pa.RecordBatch):
            columns = (batch.column(c).to_pylist() for c in ("_h", "most", "half"))
            texts = [text_of(lines(h), set(m or ()), set(x or ())) for h, m, x in zip(*columns, strict=True)]
            return [batch.column("_k"), batch.column("_u"), texts, [len(t) for t in texts]]

        return run

    out = map_batches(joined, extractor, f"_k {kind}, _u string, text string, n_chars long")
    return out.withColumnsRenamed({"_k": key, "_u": url})


def op5(spark, sf_dir: str) -> DataFrame:
    return extract(read(spark, sf_dir, "pages"))
