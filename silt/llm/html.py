"""HTML extraction (operator 3): nearest-URL page differencing.

Pages are sorted by host and URL path. Each page meets its NEIGHBOURS nearest on the same host, those that share the
longest start of the path, out of as many before and after it in that order, and is aligned with each by longest common
subsequences, twice: by text lines (a line is its text and its place, the path of elements it lies in) and by places
(runs of lines at one place, so that rotating menus and adverts align although their texts differ). Then

- text lines that align with two thirds of the neighbours are the site's and go, wherever they lie (but a line that
  begins with the page's own title is its headline and stays with the content);
- of the words that no neighbour shares, the page's and its neighbours' at the page's places, the innermost element that
  holds two thirds of its parent's is the content (an article or main element isn't entered further); lines outside it
  go if their place aligns with a neighbour's; headings there that don't align by text stay with the content;
- what the markup names as chrome (menus, headers, footers, sidebars, notices, adverts, forms, reader comments) goes.

Names break ties: where there is no neighbour, or no element holds two thirds of the page's own words, the article element
is the content, else the main element, else all that isn't named as chrome. A neighbour that holds four fifths of the
page's words outside named chrome, line by line, is a copy of it (a mirror, a repost) and isn't a neighbour: its lines
are no evidence of what the site repeats.

Edge cases: null or empty html gives an empty text; a null URL counts as an empty host and path, so such pages are
neighbours of each other; a page alone on its host, or with copies alone, is judged by names; repeated rows are copies;
an empty table gives an empty table; of the input columns only page_id, url and html are read. No page is ever dropped or
cut, and nothing gathers a host in one task: hosts are split over range partitions, and the pages on either side of a
cut are known to both partitions. A page costs time in proportion to its length, unclosed tags and quotes included.
"""

from __future__ import annotations

import re
from collections import Counter, deque
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from silt.llm.common import as_bytes, input_bytes, shuffle_partitions, slices

CHROME, OUTSIDE, MAIN, ARTICLE = 0, 1, 2, 3
#: Partitions of pages, at most: a task streams its pages, so larger ones take time, not memory.
MOST_PARTITIONS = 16_384
#: Pages of a partition, about, at least.
LEAST_PAGES = 64

#: An unclosed tag, quoted value or comment goes on to the end of the page, so no start of one is read twice.
_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)"
    r"((?:[^>=]++|=\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z))?+)*+)(?:>|\Z)|<[!?][^>]*+(?:>|\Z)", re.S
)
_NAMING = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
#: What an element's attributes must have to say anything about its zone.
_TELLING = re.compile("class|id|role|hidden|display", re.I)
_TITLE = re.compile(r"<title\b[^>]*+>([^<]*+)", re.I)
_CLASS = re.compile(r"(?:^|\s)class\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)

RAW = frozenset("script style noscript template svg math iframe object canvas textarea select head title".split())
CHROME_TAGS = frozenset("nav header footer aside form dialog menu button".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table"
    " tbody td tfoot th thead tr ul title button".split()
)
#: Parts of class, id and role values that name chrome.
CHROME_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation"
    " menu menubar breadcrumb breadcrumbs sidebar aside rail footer header masthead topbar cookie cookies consent gdpr"
    " notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social"
    " comment comments commentlist disqus respond reply replies discussion related recommended pagination pager toolbar"
    " search widget complementary contentinfo".split()
)
COMMENT_NAMES = frozenset("comment comments commentlist disqus respond reply replies discussion".split())
HEADER_NAMES = frozenset("header masthead topbar".split())
#: Values, without dashes, that name the main text.
ARTICLE_NAMES = frozenset("article articlebody articlecontent articletext postbody postcontent entrycontent storybody".split())
MAIN_NAMES = frozenset("main maincontent contentmain".split())
_PART = re.compile(r"[A-Za-z]+")


#: Elements that are lines of text themselves: the content is never less than what holds them.
TEXT = frozenset("p h1 h2 h3 h4 h5 h6 li ul ol dl dt dd pre blockquote td th tr tbody table address figcaption hr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
NEIGHBOURS = 6


@dataclass
class Page:
    """Text lines, each with its zone by name and its place; a place's parent comes before it, places[0] is the page."""

    title: str = ""
    lines: list[str] = field(default_factory=list)
    zones: list[int] = field(default_factory=list)
    at: list[int] = field(default_factory=list)
    parents: list[int] = field(default_factory=lambda: [0])
    tags: list[str] = field(default_factory=lambda: [""])
    kinds: list[int] = field(default_factory=lambda: [1])
    hashes: list[int] = field(default_factory=lambda: [0])

    @property
    def wanted(self) -> int:
        """The zone of the main text by names: the article if there is one, else the main element, else all that is no chrome."""
        return max((z for z in self.zones if z > OUTSIDE), default=OUTSIDE)

    def summary(self) -> Summary:
        words = [x.count(" ") + 1 for x in self.lines]
        places = [self.hashes[i] for i in self.at]
        keys = [_hash(f"{p} {x}") for p, x in zip(places, self.lines)]
        return Summary(keys, places, words)


@dataclass
class Summary:
    """What a neighbour needs to know of a page: of each line, a hash of text and place, a hash of the place, and words."""

    keys: list[int]
    places: list[int]
    words: list[int]


def _hash(x: str) -> int:
    h = xxh3_64_intdigest(x.encode("utf-8", "surrogatepass"))
    return h - (1 << 64) if h >> 63 else h


def _kind(tag: str, attributes: str, inside_article: bool) -> int:
    """-1: raw; or the zone that an element opens, OUTSIDE if none."""
    if tag in RAW:
        return -1
    if tag in CHROME_TAGS and not (tag == "header" and inside_article):
        return CHROME
    if not _TELLING.search(attributes):
        return {"article": ARTICLE, "main": MAIN}.get(tag, OUTSIDE)
    values = [v for m in _NAMING.findall(attributes) for v in "".join(m).lower().split()]
    # "has-sidebar" and the like speak of another element.
    parts = {p for v in values if not v.startswith(("has-", "with-", "no-")) for p in _PART.findall(v)}
    if tag == "article":
        return CHROME if parts & COMMENT_NAMES else ARTICLE
    plain = {v.replace("-", "").replace("_", "") for v in values}
    if plain & ARTICLE_NAMES:
        return ARTICLE
    if tag == "main" or plain & MAIN_NAMES:
        return MAIN
    if tag in ("html", "body"):
        return OUTSIDE
    if parts & (CHROME_NAMES - HEADER_NAMES if inside_article else CHROME_NAMES):
        return CHROME
    if re.search(r"(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none", attributes, re.I):
        return CHROME
    return OUTSIDE


def parse(html: str) -> Page:
    """The text lines of a page, one for each block in page order, with the zone and the place each lies in."""
    page, stack, text, at, zone_of_text, place_of_text = Page(), [], [], 0, OUTSIDE, 0
    chrome = article = main = 0
    place, known, opened = 0, {}, Counter()

    def zone() -> int:
        return CHROME if chrome else ARTICLE if article else MAIN if main else OUTSIDE

    def flush() -> None:
        raw = "".join(text)
        text.clear()
        line = " ".join((unescape(raw) if "&" in raw else raw).split())
        if line:
            page.lines.append(line)
            page.zones.append(zone_of_text)
            page.at.append(place_of_text)

    def leave() -> int:
        nonlocal chrome, article, main, place
        tag, kind, place = stack.pop()
        opened[tag] -= 1
        chrome -= kind == CHROME
        article -= kind == ARTICLE
        main -= kind == MAIN
        return kind

    for m in iter(_tokens(html)):
        if m.start() > at:
            if not text:
                zone_of_text, place_of_text = zone(), place
            text.append(html[at : m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            if isinstance(m, _Span) and m.tag in ("head", "title") and (own := _TITLE.search(html, m.start(), m.end())):
                page.title = " ".join(unescape(own[1]).split())
            continue
        if tag in BLOCK:
            flush()
        elif tag == "br":
            text.append(" ")
            continue
        if m[1]:
            while opened[tag]:
                last = stack[-1][0]
                if stack[-1][1] != OUTSIDE:
                    flush()
                leave()
                if last == tag:
                    break
        elif tag not in VOID and not m[3].rstrip().endswith("/"):
            if tag in ("p", "li", "td", "th", "tr", "dt", "dd", "option") and stack and stack[-1][0] == tag:
                leave()
            kind = _kind(tag, m[3], article > 0)
            if kind in (CHROME, MAIN, ARTICLE):
                flush()
            chrome += kind == CHROME
            article += kind == ARTICLE
            main += kind == MAIN
            stack.append((tag, kind, place))
            opened[tag] += 1
            if tag in BLOCK or kind != OUTSIDE:
                place = _place(page, known, place, tag, kind, m[3])
    if at < len(html):
        if not text:
            zone_of_text, place_of_text = zone(), place
        text.append(html[at:])
    flush()
    return page


def _place(page: Page, known: dict, parent: int, tag: str, kind: int, attributes: str) -> int:
    """The place of an element within its parent, told by its tag and class."""
    name = _CLASS.search(attributes) if "class" in attributes else None
    key = (parent, tag, " ".join(sorted("".join(x or "" for x in name.groups()).split())) if name else "")
    if key not in known:
        known[key] = len(page.parents)
        page.parents.append(parent)
        page.tags.append(tag)
        page.kinds.append(kind)
        page.hashes.append(_hash(f"{page.hashes[parent]} {tag} {key[2]}"))
    return known[key]


def _tokens(html: str) -> Iterator[re.Match]:
    """Tags and comments outside raw elements; the content of a raw element is skipped."""
    at, endless = 0, set()
    while m := _TAG.search(html, at):
        at = m.end()
        tag = (m[2] or "").lower()
        if tag in RAW and tag not in endless and not m[1] and not m[3].rstrip().endswith("/"):
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*+(?:>|\Z)", re.I).search(html, at)
            if end or tag != "head":
                at = end.end() if end else len(html)
                yield _Span(tag, m.start(), at)
                continue
            endless.add(tag)
        yield m


class _Span:
    """Stands for a raw element as a whole."""

    def __init__(self, tag: str, start: int, end: int) -> None:
        self.tag, self._at = tag, (start, end)

    def start(self) -> int:
        return self._at[0]

    def end(self) -> int:
        return self._at[1]

    def __getitem__(self, _: int) -> str:
        return ""


def common_lines(a: list, b: list) -> list[int]:
    """Places in a of one longest common subsequence of a and b.

    Equal ends are cut off, lines that the other side lacks too; the rest is aligned with bit vectors, one for each
    line of a, as wide as b.
    """
    n, m, head = len(a), len(b), 0
    while head < min(n, m) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(n, m) - head and a[n - 1 - tail] == b[m - 1 - tail]:
        tail += 1
    in_b = set(b[head : m - tail])
    ia = [i for i in range(head, n - tail) if a[i] in in_b]
    in_a = {a[i] for i in ia}
    jb = [j for j in range(head, m - tail) if b[j] in in_a]
    out = list(range(head)) + list(range(n - tail, n))
    if ia:
        where: dict = {}
        for j, at in enumerate(jb):
            where[b[at]] = where.get(b[at], 0) | 1 << j
        full = (1 << len(jb)) - 1
        rows, v = [], full
        for i in ia:
            u = v & where[a[i]]
            v = (v + u | v - u) & full
            rows.append(v)
        j = len(jb) - 1  # a zero bit at j: the subsequence is one longer than for j - 1
        for k in range(len(ia) - 1, -1, -1):
            row, above = rows[k], rows[k - 1] if k else full
            while j >= 0 and row >> j & 1:
                j -= 1
            if j < 0:
                break
            if above >> j & 1:
                out.append(ia[k])
                j -= 1
    return sorted(out)


def differenced(page: Page, near: list[Summary] = (), own: Summary | None = None, names: bool = True) -> list[str]:
    """The page's main text lines; near: its neighbours; own: its summary; names: whether the markup's names count."""
    own = own or page.summary()
    chrome = [names and z == CHROME for z in page.zones]
    aligned = [common_lines(own.keys, s.keys) for s in near]
    free = sum(w for w, c in zip(own.words, chrome) if not c)
    copy = [5 * sum(own.words[i] for i in x if not chrome[i]) >= 4 * free for x in aligned]
    near, aligned = ([x for x, c in zip(of, copy) if not c] for of in (near, aligned))
    shared = Counter(i for x in aligned for i in x)
    headline = page.title or "\n"
    site = {i for i, n in shared.items() if 3 * n >= 2 * len(near) and not page.lines[i].startswith(headline)}
    content = _content(page, own, near, shared, chrome, names) if near else None
    if content is None:
        wanted = page.wanted if names else None
        return [x for i, x in enumerate(page.lines) if i not in site and (wanted is None or page.zones[i] == wanted)]
    inside = [p == content for p in range(len(page.parents))]
    for p in range(1, len(inside)):
        inside[p] |= inside[page.parents[p]]
    repeated = _aligned_places(own.places, near)
    return [
        x
        for i, (x, p) in enumerate(zip(page.lines, page.at))
        if i not in site and not chrome[i]
        and (inside[p] or own.places[i] not in repeated or (page.tags[p] in HEADINGS and i not in shared))
    ]


def _content(page: Page, own: Summary, near: list[Summary], shared, chrome: list[bool], names: bool) -> int | None:
    """The place of the content: the innermost element with two thirds of its parent's unshared words; None if unclear."""
    words: Counter = Counter()
    for i, (place, n) in enumerate(zip(own.places, own.words)):
        words[place] += 0 if i in shared or chrome[i] else n
    barred, mine = {own.places[i] for i, c in enumerate(chrome) if c}, set(own.keys)
    for s in near:
        for key, place, n in zip(s.keys, s.places, s.words):
            if place in words and place not in barred and key not in mine:
                words[place] += n
    total = [words[h] for h in page.hashes]
    for p in range(len(total) - 1, 0, -1):
        total[page.parents[p]] += total[p]
    children: dict[int, list[int]] = {}
    for p in range(1, len(total)):
        children.setdefault(page.parents[p], []).append(p)
    at = 0
    while not (names and page.kinds[at] in (MAIN, ARTICLE) and page.kinds[at] == page.wanted):
        best = max(children.get(at, ()), key=lambda p: total[p], default=None)
        if best is None or page.tags[best] in TEXT or 3 * total[best] < 2 * total[at]:
            break
        at = best
    if names and page.wanted != OUTSIDE and page.kinds[at] != page.wanted:
        return None  # the markup declares a main text, and the words don't lie in one element that could overrule it
    return at if total[0] else None


def _aligned_places(own: list[int], near: list[Summary]) -> set[int]:
    """The places whose runs of lines align with a neighbour's."""
    runs = [p for p, _ in groupby(own)]
    return {runs[i] for s in near for i in common_lines(runs, [p for p, _ in groupby(s.places)])}


def _shared_start(a: str, b: str) -> int:
    n = min(len(a), len(b))
    return next((i for i in range(n) if a[i] != b[i]), n)


def _rows(batches: Iterator[pa.RecordBatch], uses: list[str]) -> Iterator[tuple]:
    for batch in batches:
        for part in slices(batch, ["html"]):
            cols = [
                [x.decode("utf-8", "replace") for x in as_bytes(part.column(part.schema.names.index(c)))]
                if c == "html"
                else part.column(part.schema.names.index(c)).to_pylist()
                for c in uses
            ]
            yield from zip(*cols)


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Host, path and summary of a partition's first and last pages, for the partitions after and before it."""
    first, last, part = [], deque(maxlen=NEIGHBOURS), 0
    for row in _rows(batches, ["silt_part", "silt_host", "silt_path", "html"]):
        part = row[0]
        if len(first) < NEIGHBOURS:
            first.append(row)
        last.append(row)
    for rows, to, side in ((first, -1, 1), (list(last), 1, 0)):
        for k, row in enumerate(rows):
            s = parse(row[3]).summary()
            kinds = [pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32())]
            values = (part + to, side, k, row[1], row[2], s.keys, s.places, s.words)
            yield pa.RecordBatch.from_arrays(
                [pa.array([v], t) for v, t in zip(values, kinds)],
                names=["to_part", "side", "k", "host", "path", "keys", "places", "words"],
            )


def nearest(path: str, before: list[tuple], after: list[tuple]) -> list[Summary]:
    """Of pages (path, summary) before and after one, each list nearest first, the summaries of the NEIGHBOURS nearest:
    the longest shared start of the path, then the fewer pages between, then the one before."""
    ranked = [(-_shared_start(p, path), k, side, s) for side, of in enumerate((before, after)) for k, (p, s) in enumerate(of)]
    return [s for *_, s in sorted(ranked, key=lambda x: x[:3])[:NEIGHBOURS]]


def _difference(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages in order of host and path, each with its neighbours; 2 * NEIGHBOURS + 1 pages are held at a time."""
    uses = ["page_id", "url", "silt_host", "silt_path", "html", "before", "after"]
    out: list[list] = [[], [], [], []]
    size = 0

    def edge(pages: list[dict] | None) -> list[tuple]:
        return [(None, e["host"], e["path"], None, Summary(e["keys"], e["places"], e["words"])) for e in pages or ()]

    def done(k: int) -> None:
        nonlocal size
        row, host, path, page, own = held[k]
        before = [(x[2], x[4]) for x in reversed(held[max(0, k - NEIGHBOURS) : k]) if x[1] == host]
        after = [(x[2], x[4]) for x in held[k + 1 : k + 1 + NEIGHBOURS] if x[1] == host]
        text = "\n".join(differenced(page, nearest(path, before, after), own))
        for col, x in zip(out, (row[0], row[1], text, len(text))):
            col.append(x)
        size += len(text)
        held[k] = (None, host, path, None, own)

    def batch() -> pa.RecordBatch:
        types = [pa.int64(), pa.string(), pa.string(), pa.int64()]
        cols = [pa.array(c, t) for c, t in zip(out, types)]
        for c in out:
            c.clear()
        return pa.RecordBatch.from_arrays(cols, names=["page_id", "url", "text", "n_chars"])

    held: list[tuple] = []  # pages before, and those that wait for the ones after them
    at, tail = 0, None
    for n, row in enumerate(_rows(batches, uses)):
        if not n:
            held, tail = edge(row[5]), row[6]
            at = len(held)
        page = parse(row[4])
        held.append((row[:2], row[2], row[3], page, page.summary()))
        if len(held) - at > NEIGHBOURS:
            done(at)
            at += 1
            if at > 4 * NEIGHBOURS:
                held = held[at - NEIGHBOURS :]
                at = NEIGHBOURS
        if size > 4 << 20:
            yield batch()
            size = 0
    n = len(held)
    held += edge(tail)
    for k in range(at, n):
        done(k)
    yield batch()


def extract_main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points of text) for every row of pages (page_id, url, html)."""
    spark = pages.sparkSession
    n = max(shuffle_partitions(spark), min(MOST_PARTITIONS, -(-input_bytes(pages) // (16 << 20))))
    # A partition must hold the neighbours of the next one's pages.
    n = max(1, min(n, pages.count() // LEAST_PAGES))
    url = F.coalesce(F.col("url"), F.lit(""))
    ranged = (
        pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), "html")
        .withColumn("silt_host", F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1)))
        .withColumn("silt_path", F.regexp_replace(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*", ""))
        .repartitionByRange(n, "silt_host", "silt_path", "page_id")
        .sortWithinPartitions("silt_host", "silt_path", "page_id", "url", "html")
        .withColumn("silt_part", F.spark_partition_id())
    )
    edges = ranged.select("silt_part", "silt_host", "silt_path", "html").mapInArrow(
        _edges, "to_part int, side int, k int, host string, path string, keys array<bigint>, places array<bigint>, words array<int>"
    )
    # 2 * NEIGHBOURS rows a partition, of hashes: the broadcast is bounded by the number of partitions.
    one = F.struct("k", "host", "path", "keys", "places", "words")
    ends = edges.groupBy("to_part").agg(
        F.array_sort(F.collect_list(F.when(F.col("side") == 0, one))).alias("before"),
        F.array_sort(F.collect_list(F.when(F.col("side") == 1, one))).alias("after"),
    )
    return (
        ranged.join(F.broadcast(ends), F.col("silt_part") == F.col("to_part"), "left")
        .select("page_id", "url", "silt_host", "silt_path", "html", "before", "after")
        .mapInArrow(_difference, "page_id bigint, url string, text string, n_chars bigint")
    )
