"""Main text of web pages by differencing each page with its nearest neighbours by URL.

1. A page becomes text lines, one for each block, each marked by its place: in page furniture by its tag, class, id or
   role, in an article, or neither (:func:`lines_of`).
2. Pages are ordered by host and path, numbers in a path by value. A page is paired with pages of its host near it in
   that order, those first that share more of its path; equal pages next to each other count as one.
3. The lines of two pages are aligned by longest common subsequence (:func:`common_lines`). What the page shares with
   the neighbour that shares least is the host's template; a neighbour that shares most of the rest too is a copy of
   the page and says nothing. The lines that the nearest of the others shares are deleted (:func:`main_text`).
4. The markup is a check on both sides. Page furniture goes although it differs from page to page. A shared line inside
   an article stays, because articles quote each other, unless it is nothing but links, or it stands at the head or the
   end of the article and all of the three or four nearest neighbours have it. Where articles hold most of what is not
   shared, lines outside of them go.

The order is cut into blocks at pages drawn by a hash of their keys, so that the blocks, and with them the result,
depend on the pages alone and not on the number of partitions. A page at which a block begins is also seen, but not
returned, by the block before. Blocks are streamed: a host with most pages is spread over blocks and none is gathered.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate, groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

# pages in a block on average, blocks at most, neighbours looked at on each side, neighbours that decide
BLOCK_PAGES, MOST_BLOCKS, REACH, PARTNERS = 128, 1 << 14, 8, 4
# pages drawn for each block, of which every so many-th begins one: blocks of like size
DRAWN = 8
# share of a page's text from which on another is its copy, and the same where three neighbours share it alike
COPY, MANY = 0.6, 0.8
_CELLS = 1 << 28

# Tags whose content is no text, page furniture, and blocks.
NO_TEXT = "script style noscript template svg math iframe object canvas video audio select option textarea button title".split()
FURNITURE = "nav footer aside form dialog menu head header".split()
BLOCKS = "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
VOID = "area base br col embed hr img input link meta param source track wbr".split()
MODIFIERS = "has hide hides no show shows with without".split()
READERS = "comment comments disqus feedback replies reply respond".split()
MARKS = """ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs byline-ads comment comments consent cookie cookies copyright disqus
feedback footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices overlay pagination pager paywall popup promo promoted
recommended related reply replies respond search share sharing sidebar signup social sponsor sponsored subscribe subscription toolbar widget widgets""".split()
ROLES = "navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split()

ARTICLE, OTHER, CHROME = 2, 1, 0

_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^<>\"']*+(?:(?:\"[^\"<>]*\"|'[^'<>]*')[^<>\"']*+)*+)>")
_OPEN = re.compile(r"<(?=[a-zA-Z/!?])")
_NAME = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
_QUOTE = re.compile(r"[>\"']")
_NAMED = re.compile(r"(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_SPLIT = re.compile(r"[^a-z0-9]+")
_NO_TEXT, _FURNITURE, _BLOCKS, _VOID, _MARKS, _ROLES, _READERS, _MODIFIERS = (frozenset(x) for x in (NO_TEXT, FURNITURE, BLOCKS, VOID, MARKS, ROLES, READERS, MODIFIERS))
_RAW_END = {t: re.compile(rf"</{t}\b[^>]*>", re.I) for t in ("script", "style", "textarea", "title", "iframe", "noscript", "template")}
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPE = frozenset({"ul", "ol", "dl", "table", "div", "article", "section", "main", "body", "td", "th"})


def _marked(attributes: str) -> tuple[bool, frozenset[str]]:
    """(whether a page says that the element is hidden or furniture, the marks in its class and id)."""
    marks: set[str] = set()
    for name, *values in _NAMED.findall(attributes):
        name, value = name.lower(), next((v for v in values if v), "").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "role" and value in _ROLES:
            return True, frozenset()
        if name in ("class", "id"):
            for word in value.split():
                parts = _SPLIT.split(word)
                if _MODIFIERS.isdisjoint(parts[:-1]):  # such as has-sidebar, which says what an element holds
                    marks |= _MARKS.intersection(parts)
    return False, frozenset(marks)


class _Wrap:
    """An element that a name or its being a form makes likely furniture: what it holds decides once the page is read."""

    def __init__(self, reader: bool):
        self.reader, self.chars, self.articles = reader, 0, 0

    def furniture(self, chars: int, articles: int) -> bool:
        """Not if it holds all of the page's articles, or most of the text of a page that has none outside of it."""
        if self.articles < articles:
            return True
        return not self.articles and (self.reader or 2 * self.chars <= chars)


class _Tags:
    """Tags of a page from left to right, in one pass however the page is broken."""

    def __init__(self, page: str):
        self.page, self.quoted = page, True

    def after(self, at: int) -> tuple[int, int, bool, str | None, str]:
        """(start, end, whether it closes, name or None for a comment or declaration, attributes) of the next tag from ``at`` on."""
        page = self.page
        while m := _OPEN.search(page, at):
            start = m.start()
            if tag := _TAG.match(page, start):
                return start, tag.end(), bool(tag[1]), tag[2].lower(), tag[3]
            if page.startswith("<!--", start):
                end = page.find("-->", start + 4)
                return start, end + 3 if end >= 0 else len(page), False, None, ""
            name = _NAME.match(page, start)
            if name is None and page[start + 1] == "/":
                at = start + 1
                continue
            end = self._end(name.end() if name else start + 2, name is not None)
            if end < 0:  # no tag ends any more
                break
            if name is None:
                return start, end, False, None, ""
            return start, end, bool(name[1]), name[2].lower(), page[name.end() : end - 1]
        return len(page), len(page), False, None, ""

    def _end(self, at: int, quotes: bool) -> int:
        """Behind the > that ends a tag, quoted ones skipped; once that fails, quotes aren't heeded any more."""
        place = at
        while quotes and self.quoted and (m := _QUOTE.search(self.page, place)):
            if m[0] == ">":
                return m.end()
            close = self.page.find(m[0], m.end())
            place = close + 1 if close >= 0 else m.end()
        self.quoted = self.quoted and not quotes
        return self.page.find(">", at) + 1 or -1


def lines_of(page: str) -> list[tuple[str, int, bool]]:
    """(text, ARTICLE, OTHER or CHROME, whether all of it is links) of each block with text, in page order."""
    out: list[tuple[str, tuple, bool]] = []
    stack: list[tuple[str, tuple]] = []  # tag, place inside it: what encloses it, from the outside, and decides
    wraps: list[_Wrap] = []
    articles = 0
    opened: Counter[str] = Counter()
    text: list[str] = []
    linked = plain = 0
    in_link = 0
    place: tuple = ()
    tags = _Tags(page)

    def flush() -> None:
        nonlocal linked, plain
        if text:
            line = " ".join(html.unescape("".join(text)).split())
            if line:
                out.append((line, place, linked > 0 and plain == 0))
            text.clear()
        linked = plain = 0

    def close(tag: str) -> bool:
        """Take the innermost such tag and all inside it off the stack; False if none is open."""
        if not opened[tag]:
            return False
        while stack:
            t, _ = stack.pop()
            opened[t] -= 1
            if t == tag:
                break
        return True

    def above(wanted: set[str]) -> str | None:
        """The innermost open tag of those wanted, not beyond one that holds blocks."""
        if not any(opened[t] for t in wanted):
            return None
        for t, _ in reversed(stack):
            if t in wanted:
                return t
            if t in _SCOPE:
                return None
        return None

    at = 0
    while at < len(page):
        start, end, closing, tag, attributes = tags.after(at)
        if start > at:
            piece = page[at:start]
            text.append(piece)
            if not piece.isspace():
                if in_link:
                    linked += 1
                else:
                    plain += 1
        at = end
        if tag is None:  # comment, declaration or the end
            continue
        if closing:
            if tag == "a":
                in_link = max(0, in_link - 1)
            if tag in _BLOCKS:
                flush()
            elif opened[tag]:
                k = len(stack) - 1
                while stack[k][0] != tag:
                    k -= 1
                if (stack[k - 1][1] if k else ()) is not place:
                    flush()
            if close(tag):
                place = stack[-1][1] if stack else ()
            continue
        if tag == "br":
            text.append(" ")
            continue
        if tag in _VOID:
            if tag == "hr":
                flush()
            continue
        if tag in _RAW_END and tag in _NO_TEXT:
            raw = _RAW_END[tag].search(page, at)
            at = raw.end() if raw else len(page)
            continue
        if tag in _BLOCKS:
            flush()
            for wanted in ({"p"}, _CLOSES.get(tag, ())):  # a block ends an open paragraph, an item the one before
                if wanted and (found := above(wanted)):
                    close(found)
            place = stack[-1][1] if stack else ()
        if tag == "a":
            in_link += 1
        inner = place
        hidden, marks = _marked(attributes) if attributes and tag not in ("html", "body") else (False, frozenset())
        inside = ARTICLE in place
        if inside:
            marks -= {"header"}  # the head of an article is its title
        if CHROME in place:
            pass  # nothing in hard furniture is text
        elif hidden or tag in _NO_TEXT or tag in _FURNITURE and tag != "form" and not (tag == "header" and inside):
            inner = (*place, CHROME)
        else:
            if marks or tag == "form":
                wraps.append(_Wrap(not _READERS.isdisjoint(marks)))
                inner = (*place, wraps[-1])
            if tag in ("article", "main"):
                inner = (*inner, ARTICLE)
                if not any(isinstance(w, _Wrap) and w.reader for w in inner):  # a reader's comment is no article of the page
                    articles += 1
                    for w in inner:
                        if isinstance(w, _Wrap):
                            w.articles += 1
        if attributes.endswith("/"):
            continue
        if inner is not place and tag not in _BLOCKS:
            flush()
        stack.append((tag, inner))
        opened[tag] += 1
        place = inner
    flush()
    total = 0
    for line, around, _ in out:
        if CHROME not in around:
            total += len(line)
            for w in around:
                if isinstance(w, _Wrap):
                    w.chars += len(line)
    decided: dict[int, bool] = {id(w): w.furniture(total, articles) for w in wraps}

    def settled(around: tuple) -> int:
        if CHROME in around or any(decided[id(w)] for w in around if isinstance(w, _Wrap)):
            return CHROME
        return ARTICLE if ARTICLE in around else OTHER

    return [(line, settled(around), link) for line, around, link in out]


def _rows(a: list[str], b: list[str]) -> Iterator[int]:
    """A bit vector for each line of a: bit j is 0 where the longest common subsequence grows with line j of b."""
    where: dict[str, int] = {}
    for j, line in enumerate(b):
        where[line] = where.get(line, 0) | 1 << j
    full = row = (1 << len(b)) - 1
    for line in a:
        used = row & where.get(line, 0)
        row = (row + used | row - used) & full
        yield row


def _aligned(a: list[str], b: list[str], i0: int, j0: int, out: list[tuple[int, int]]) -> None:
    if not a or not b:
        return
    if len(a) > 1 and len(a) * len(b) > _CELLS:  # halves, so that memory stays in proportion to the lines
        half = len(a) // 2
        front = back = (1 << len(b)) - 1
        for front in _rows(a[:half], b):
            pass
        for back in _rows(a[:half - 1 : -1], b[::-1]):
            pass
        grown = lambda row: [0, *accumulate("1" != c for c in bin(row | 1 << len(b))[:2:-1])]
        left, right = grown(front), grown(back)
        cut = max(range(len(b) + 1), key=lambda j: left[j] + right[len(b) - j])
        _aligned(a[:half], b[:cut], i0, j0, out)
        _aligned(a[half:], b[cut:], i0 + half, j0 + cut, out)
        return
    rows = list(_rows(a, b))
    i, j = len(a), len(b)
    while i and j:
        if rows[i - 1] >> (j - 1) & 1:
            j -= 1
            continue
        i -= 1
        if not i or rows[i - 1] >> (j - 1) & 1:
            j -= 1
            out.append((i0 + i, j0 + j))


def common_lines(a: list[str], b: list[str]) -> tuple[set[int], set[int]]:
    """Indices of the lines of a longest common subsequence, in a and in b; bit-parallel, so that repeated lines cost no more."""
    both = set(a).intersection(b)
    if not both:
        return set(), set()
    ia, ib = [i for i, x in enumerate(a) if x in both], [j for j, x in enumerate(b) if x in both]
    pairs: list[tuple[int, int]] = []
    _aligned([a[i] for i in ia], [b[j] for j in ib], 0, 0, pairs)
    return {ia[i] for i, _ in pairs}, {ib[j] for _, j in pairs}


def url_key(url: str | None) -> tuple[str, str]:
    """(host, path) for ordering: no scheme, query, fragment or ending; numbers have 20 digits."""
    rest = re.sub(r"^[a-zA-Z][a-zA-Z0-9+.-]*://", "", url or "")
    rest = re.split(r"[?#]", rest, maxsplit=1)[0]
    host, _, path = rest.partition("/")
    path = re.sub(r"\.(?:html?|php|aspx?|jsp)$", "", path.rstrip("/"))
    return host.rpartition("@")[2].lower(), re.sub(r"\d+", lambda m: m[0].zfill(20), path)


def nearness(a: str, b: str) -> int:
    """Characters of path that both begin with."""
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return n


class Page:
    """Lines of a page, and the pages next to it in URL order with the very same lines: (id, url, whether it is returned)."""

    def __init__(self, host: str, path: str, lines: list[str], places: list[int], links: list[bool]):
        self.host, self.path, self.lines, self.places, self.links = host, path, lines, places, links
        self.rows: list[tuple[int | None, str | None, bool]] = []

    def same(self, other: Page) -> bool:
        return (self.host, self.lines, self.places, self.links) == (other.host, other.lines, other.places, other.links)


def shared_lines(page: Page, near: list[Page]) -> tuple[set[int], set[int]]:
    """Lines that the nearest page that is no copy has too, and those that all of three pages or more have."""
    size = lambda found: sum(len(page.lines[i]) for i in found if page.places[i] != CHROME)
    total = size(range(len(page.lines)))
    held: list[set[int]] = []
    strangers = False
    for k, other in enumerate(near):
        found, _ = common_lines(page.lines, other.lines)
        if found:
            held.append(found)
        elif k < PARTNERS:  # a page of another make
            strangers = True
        if len(held) >= PARTNERS and min(map(size, held)) <= COPY * total:
            break
    if not held:
        return set(), set()
    template = min(held, key=size)
    alike = sum(template <= found for found in held)
    if size(template) > (MANY if alike >= 3 else COPY) * total:  # copies are all there is
        return set(), set()
    partners = [f for f in held if size(f - template) <= COPY * (total - size(template))]
    return partners[0], set.intersection(*partners) if len(partners) >= 3 and not strangers else set()


def main_text(page: Page, near: list[Page], difference: bool = True) -> str:
    """The page's lines but for what it shares with pages near it, nearest first, and for page furniture."""
    shared, everywhere = shared_lines(page, near) if difference else (set(), set())
    own = [0, 0, 0]
    for i, (line, place) in enumerate(zip(page.lines, page.places, strict=True)):
        own[place] += len(line) if i not in shared else 0
    article = ARTICLE in page.places and own[ARTICLE] >= own[OTHER]
    alone = [i for i, place in enumerate(page.places) if place == ARTICLE and i not in shared]
    inner = range(alone[0], alone[-1]) if alone else range(len(page.lines))
    kept = []
    for i, (line, place, link) in enumerate(zip(page.lines, page.places, page.links, strict=True)):
        if place == CHROME or article and place != ARTICLE:
            continue
        if i in shared and (place != ARTICLE or link or i in everywhere and i not in inner):
            continue
        kept.append(line)
    return "\n".join(kept)


def _differenced(pages: Iterator[Page], difference: bool) -> Iterator[tuple[Page, str]]:
    """Each of the pages of one block with its text, in their order.

    A page is differenced with up to ``REACH`` pages on either side, and beyond these with the nearest page of its host
    on either side that is no near copy of it. So a page waits while all pages after it are near copies, a run of which
    is held in memory up to its end or that of the block.
    """
    held: list[Page] = []
    alone: list[Page] = []  # the last pages before those held, near copies of each other left out
    done = 0  # of those held
    seen = 0  # pages after the next one that are near copies of it

    def copies(page: Page, other: Page) -> bool:
        found, _ = common_lines(page.lines, other.lines)
        return sum(len(page.lines[i]) for i in found) > COPY * sum(map(len, page.lines))

    def text(k: int) -> tuple[Page, str]:
        page = held[k]
        window = [j for j in range(max(0, k - REACH), min(len(held), k + REACH + 1)) if j != k and held[j].host == page.host]
        near = [held[j] for j in sorted(window, key=lambda j: (-nearness(page.path, held[j].path), abs(k - j), j))]
        if near and difference and all(copies(page, o) for o in near):
            near += [o for o in (*reversed(alone), held[-1]) if o.host == page.host and o not in near and o is not page][:2]
        return page, main_text(page, near, difference)

    def settled(k: int) -> bool:
        """Whether what comes later can't matter: ``REACH`` pages follow, and the last of them or of all is no near copy."""
        nonlocal seen
        if not difference or held[-1].host != held[k].host:
            return len(held) - 1 - k > REACH
        if len(held) - 1 - k <= REACH:
            return False
        later = held[max(k, seen) + 1 :]
        if any(not copies(held[k], o) for o in reversed(later)):
            return True
        seen = len(held) - 1
        return False

    for page in pages:
        if held and held[-1].same(page):
            held[-1].rows += page.rows
            continue
        held.append(page)
        while settled(done):
            yield text(done)
            done, seen = done + 1, 0
            if done > REACH:
                gone = held.pop(0)
                done -= 1
                if not alone or alone[-1].host != gone.host or not copies(gone, alone[-1]):
                    alone = [*[o for o in alone if o.host == gone.host][1 - PARTNERS :], gone]
    for k in range(done, len(held)):
        yield text(k)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", difference: bool = True) -> DataFrame:
    """``page_id, url, text, n_chars`` of each row; null html is empty and gives an empty text.

    Null urls are one host without a path. Pages of equal url stand next to each other in order of id (null first) and
    then of their html, and each of repeated rows has its row. Of neighbours that are equally near the earlier one
    counts first. Pages of any length are taken whole: tags are scanned once whatever is left open, and alignment takes
    memory in proportion to the lines. No pages give no rows; other columns are not read. Without ``difference`` the
    markup alone decides. A host all of whose pages are near copies of each other loses nothing by differencing.
    """
    spark = pages.sparkSession
    pages = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    share = DRAWN * min(1 / BLOCK_PAGES, MOST_BLOCKS / max(1, pages.count()))
    place = F.pmod(F.xxhash64(F.lit("html"), "page_id", "url"), F.lit(1 << 40))
    drawn = pages.where(place < int(share * (1 << 40))).select("page_id", "url").distinct().collect()  # about DRAWN * MOST_BLOCKS rows at most
    key = lambda url, page_id: (*url_key(url), page_id is not None, page_id or 0)
    begins = sorted({key(r["url"], r["page_id"]) for r in drawn})[DRAWN - 1 :: DRAWN]
    sent = spark.sparkContext.broadcast(begins)
    line_type = pa.struct([("line", pa.string()), ("place", pa.int8()), ("link", pa.bool_())])
    names = ["block", "own", "page_id", "url", "host", "path", "lines"]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds = sent.value
        for batch in batches:
            for at in range(0, batch.num_rows, 100):
                rows = []
                for i, u, h in zip(*(c.slice(at, 100).to_pylist() for c in batch.columns), strict=True):
                    where = key(u, i)
                    k = bisect_right(bounds, where)
                    found = [{"line": x, "place": p, "link": a} for x, p, a in lines_of(h or "")]
                    rows.append((k, True, i, u, where[0], where[1], found))
                    if k and bounds[k - 1] == where:
                        rows.append((k - 1, False, *rows[-1][2:]))
                kinds = [pa.int32(), pa.bool_(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.list_(line_type)]
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def read() -> Iterator[tuple[int, Page]]:
            for batch in batches:
                for at in range(0, batch.num_rows, 100):
                    for r in batch.slice(at, 100).to_pylist():
                        lines = r["lines"] or []
                        page = Page(r["host"], r["path"], [x["line"] for x in lines], [x["place"] for x in lines], [x["link"] for x in lines])
                        page.rows.append((r["page_id"], r["url"], r["own"]))
                        yield r["block"], page

        done: list[tuple[int | None, str | None, str, int]] = []
        kinds = (pa.int64(), pa.string(), pa.string(), pa.int64())
        out = lambda: pa.record_batch([pa.array(c, k) for c, k in zip(zip(*done, strict=True), kinds, strict=True)], ["page_id", "url", "text", "n_chars"])
        size = 0
        for _, block in groupby(read(), key=lambda x: x[0]):
            for page, text in _differenced((p for _, p in block), difference):
                for i, u, own in page.rows:
                    if own:
                        done.append((i, u, text, len(text)))
                        size += len(text)
                    if size > 1 << 22 or len(done) >= 1000:
                        yield out()
                        done.clear()
                        size = 0
        if done:
            yield out()

    line = "array<struct<line: string, place: tinyint, link: boolean>>"
    parsed = pages.mapInArrow(parse, f"block int, own boolean, page_id bigint, url string, host string, path string, lines {line}")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [*map(F.col, ("block", "host", "path", "page_id")), F.xxhash64("lines"), F.desc("own")]
    place = F.floor(F.col("block") * parts / (len(begins) + 1)).cast("int")
    ordered = parsed.repartitionById(parts, place).sortWithinPartitions(*order)
    return ordered.mapInArrow(common.released(run), "page_id bigint, url string, text string, n_chars bigint")


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of all ``pages``; odd rows as :func:`extract` says."""
    return extract(common.table(spark, sf_dir, "pages", "page_id", "url", "html"))
