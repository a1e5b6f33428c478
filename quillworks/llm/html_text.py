"""Main text of web pages by nearest-URL page differencing.

A page becomes text lines, one a block, each marked by where it stands: in the article (or main) element, in a part that
is never text (menus, headers, footers, sidebars, notices, adverts, forms, comments of readers), or elsewhere. Pages are
ordered by host and URL path; each is paired with the neighbour on its host that shares the longer path prefix (the one
before, if equal). Pages of its own path, and pages with the same lines, are passed over: they are captures or copies of it.
The two pages' lines are aligned by their longest common subsequence, and shared lines go. Lines inside an article element stay:
copies of an article under two URLs would else delete each other. A page without a neighbour that has an article gives its lines alone.

The order is dealt out by ranges, so a host of any size is spread. Pages at the ends of a range, and those that they can be paired
with, meet the ends of the host's other ranges in a second step: the pairing does not depend on the ranges. Null and empty pages have no
text. Repeated rows are pages of their own; a null URL's pages share the empty host. A page of any length is one row of one task.
Of ``pages`` only page_id, url and html are read. An empty table gives an empty one.
"""

from __future__ import annotations

import html
import json
import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillworks.llm.common import shuffle_width

#: Element names by role.
RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "math", "object", "canvas", "select", "option"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
CHROME = {"nav", "header", "footer", "aside", "form", "button", "dialog", "menu", "head"}
INLINE = {"a", "abbr", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
CONTAINERS = {"article", "main", "div", "section", "nav", "header", "footer", "aside", "form", "ul", "ol", "table", "body", "html", "head", "blockquote", "dialog", "menu", "figure", "td", "li", "p"}
#: Class and id names and roles, whole, of parts that are not the article: one of these words, or made of them and of words for parts alone.
_HEADS = r"banner|header|breadcrumbs?"
_NOISE = r"ads?|advert\w*|comments?|cookies?|consent|footer|menu|nav|navbar|navigation|newsletter|notice|popup|promo|related|replies|share|sharing|sidebar|social|sponsor\w*|subscribe|toolbar|widget"
_PARTS = r"area|bar|box|buttons?|container|icons?|inner|links?|list|posts?|section|slot|unit|wrap|wrapper"
NOISE = re.compile(rf"(?:site[_-])?(?:{_NOISE}|{_HEADS})(?:[_-](?:{_NOISE}|{_HEADS}|{_PARTS}))*", re.I)
#: Inside an article these hold its title.
HEADS = re.compile(rf"(?:{_HEADS})(?:[_-](?:{_HEADS}|{_PARTS}))*", re.I)
#: Names never tell of the whole page or article; only hidden ones are chrome.
WHOLE = {"html", "body", "main", "article"}

TAG = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[/a-zA-Z][^<>]*$", re.S)
MARKS = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?""", re.I)

ARTICLE, CHROMED, OTHER = 2, 0, 1
#: Alignment keeps a row of bits for each line of one side, as many rows at a time as have so many bits.
BITS = 1 << 26


def _noisy(name: str, attributes: str, in_article: bool) -> bool:
    for key, *values in MARKS.findall(attributes):
        key, value = key.lower(), "".join(values)
        if key == "hidden" or key == "aria-hidden" and value == "true":
            return True
        if key in ("class", "id", "role") and name not in WHOLE:
            if any(NOISE.fullmatch(x) and not (in_article and HEADS.fullmatch(x)) for x in value.split()):
                return True
    return False


def page_lines(page: str | None) -> list[tuple[str, int]]:
    """(text, mark) of each block with text, in page order."""
    page = page or ""
    lines: list[tuple[str, int]] = []
    parts: list[str] = []
    #: open containers: name, whether text inside is chrome, whether it is an article's
    stack: list[tuple[str, bool, bool]] = []

    def mark() -> int:
        return (CHROMED if stack[-1][1] else ARTICLE if stack[-1][2] else OTHER) if stack else OTHER

    def close_line() -> None:
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            parts.clear()
            if text:
                lines.append((text, mark()))

    at = 0
    while at < len(page):
        m = TAG.search(page, at)
        if m is None:
            parts.append(page[at:])
            break
        parts.append(page[at : m.start()])
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if name == "br":
            parts.append(" ")
        elif name in INLINE and not (m[3] and not m[1] and _noisy(name, m[3], bool(stack) and stack[-1][2])):
            if m[1] and any(x[0] == name for x in stack):
                _pop(stack, name, close_line)
        elif name in RAW and not m[1]:
            close_line()
            end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
            at = end.end() if end else len(page)
        elif m[1]:
            close_line()
            _pop(stack, name, close_line)
        elif name not in VOID and not m[3].endswith("/"):
            close_line()
            if name == "p" or name == "li":  # these end where the next begins
                if stack and stack[-1][0] == name:
                    stack.pop()
            above = stack[-1] if stack else ("", False, False)
            chrome = above[1] or (name in CHROME and not (name == "header" and above[2])) or _noisy(name, m[3], above[2])
            if name in CONTAINERS or name in CHROME or chrome != above[1]:
                stack.append((name, chrome, above[2] or name in ("article", "main")))
        else:
            close_line()
    close_line()
    return lines


def _pop(stack: list, name: str, close_line) -> None:
    for i in range(len(stack) - 1, -1, -1):
        if stack[i][0] == name:
            close_line()
            del stack[i:]
            return
        if stack[i][0] in ("article", "main", "nav", "footer", "aside") and name in ("p", "li"):
            return


def common_lines(a: list, b: list) -> set[int]:
    """Places in ``a`` of a longest common subsequence with ``b``; equal ends are taken off first."""
    low = 0
    while low < min(len(a), len(b)) and a[low] == b[low]:
        low += 1
    end = 0
    while end < min(len(a), len(b)) - low and a[len(a) - 1 - end] == b[len(b) - 1 - end]:
        end += 1
    found = {*range(low), *range(len(a) - end, len(a))}
    inner = _aligned(a[low : len(a) - end], b[low : len(b) - end])
    return found | {low + i for i in inner}


def _rows(row: int, a: list, places: dict, full: int) -> Iterator[int]:
    """The bit-parallel row after each line of ``a``: bit j is unset where the common length grows at place j of the other side."""
    for x in a:
        u = row & places.get(x, 0)
        row = (row + u | row - u) & full
        yield row


def _aligned(a: list, b: list) -> set[int]:
    """Walks back through the rows. Of long pages one row in ``step`` is kept, and the rows between are made again when the
    walk comes there: the alignment is the same for any BITS."""
    if not a or not b:
        return set()
    places: dict = {}
    for j, x in enumerate(b):
        places[x] = places.get(x, 0) | 1 << j
    full, step = (1 << len(b)) - 1, max(1, BITS // len(b))
    kept = [full, *(row for n, row in enumerate(_rows(full, a, places, full), 1) if n % step == 0)]
    found, i, j, at, rows = set(), len(a), len(b) - 1, -1, []
    while i and j >= 0:
        if (part := (i - 1) // step) != at:
            at, rows = part, [kept[part], *_rows(kept[part], a[part * step : (part + 1) * step], places, full)]
        row, above = rows[i - at * step], rows[i - at * step - 1]
        if row >> j & 1:  # b[j] does not lengthen it
            j -= 1
        elif _length(above, j) == _length(row, j):
            i -= 1
        else:
            found.add(i - 1)
            i, j = i - 1, j - 1
    return found


def _length(row: int, j: int) -> int:
    return j + 1 - (row & (1 << j + 1) - 1).bit_count()


def main_text(lines: list[tuple[str, int]], beside: list[str] | None) -> str:
    """The text of a page's lines, given its neighbour's: of lines outside an article those that the neighbour has not. Without
    a neighbour an article is all of the text, if there is one."""
    if beside:
        shared = common_lines([t for t, _ in lines], beside)
        return " ".join(t for i, (t, m) in enumerate(lines) if m == ARTICLE or m == OTHER and i not in shared)
    wanted = ARTICLE if any(m == ARTICLE for _, m in lines) else OTHER
    return " ".join(t for t, m in lines if m == wanted)


def url_path():
    return F.regexp_replace(F.regexp_extract(F.coalesce("url", F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*([^?#]*)", 1), r"(\.html?|/)$", "")


def url_host():
    return F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1))


def _shared_prefix(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return n


class Page:
    """A page in the order of its host's paths."""

    __slots__ = ("after", "before", "host", "lines", "open", "page_id", "path", "texts", "url")

    def __init__(self, page_id, url, host, path, lines, open=True) -> None:
        self.page_id, self.url, self.host, self.path, self.lines, self.open = page_id, url, host, path, lines, open
        self.texts = [t for t, _ in lines]
        self.before = self.after = None

    def differs(self, other: Page) -> bool:
        return self.path != other.path and self.texts != other.texts


class Latest:
    """The pages of a host that can be the nearest different one of a page to come: of all pages and of those before the present
    path, the latest one and the latest with other lines than that."""

    def __init__(self) -> None:
        self.all: list[Page] = []
        self.past: list[Page] = []

    def add(self, page: Page) -> None:
        if self.all and self.all[0].path != page.path:
            self.past = self.all
        self.all = [page, *[x for x in self.all if x.texts != page.texts][:1]]

    def near(self, page: Page) -> Page | None:
        known = self.past if self.all and self.all[0].path == page.path else self.all
        return next((x for x in known if x.texts != page.texts), None)


def paired(pages: Iterable[Page]) -> Iterator[Page]:
    """``pages``, ordered by host and path, each with the nearest different page of its host before and after it."""
    latest, host = Latest(), None
    #: Pages that wait for the one after them: those of the present path, and those of earlier paths, which all have equal lines.
    here: list[Page] = []
    alike: list[Page] = []
    for page in pages:
        if page.host != host:
            yield from alike
            yield from here
            latest, host, here, alike = Latest(), page.host, [], []
        if here and here[0].path != page.path:
            alike, here = alike + here, []
        if alike:
            waiting = []
            for x in alike:
                if x.differs(page):
                    x.after = page
                    yield x
                else:
                    waiting.append(x)
            alike = waiting
        page.before = latest.near(page)
        latest.add(page)
        here.append(page)
    yield from alike
    yield from here


def _pages(batches: Iterator[pa.RecordBatch]) -> Iterator[Page]:
    for batch in batches:
        for r in zip(*(batch[c] for c in ("page_id", "url", "host", "path", "html")), strict=True):
            *keys, page = (x.as_py() for x in r)
            yield Page(*keys, page_lines(page))


def _text(page: Page) -> str:
    near = [x for x in (page.before, page.after) if x is not None]
    beside = max(near, key=lambda x: _shared_prefix(x.path, page.path), default=None)
    return main_text(page.lines, beside and beside.texts)


def _packed(texts: Iterable[tuple]) -> Iterator[pa.RecordBatch]:
    texts = iter(texts)
    while done := list(islice(texts, 500)):
        yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*done, strict=True), (pa.int64(), pa.string(), pa.string()), strict=True)], ["page_id", "url", "text"])


def _cut_off(pages: Iterable[Page]) -> Iterator[tuple[Page, bool]]:
    """The pages of a range in pairs, each with whether a page of another range can be its nearest: none is known on one side, and
    its host is the range's first or last. The host of the last pages is known only at the end."""
    held, first = [], None
    for page in paired(pages):
        first = page if first is None else first
        if held and held[0].host != page.host:
            for x in held:
                yield x, x.before is None and x.host == first.host
            held = []
        if page.after is None:
            held.append(page)
        else:
            yield page, page.before is None and page.host == first.host
    for x in held:
        yield x, True


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The text of all pages whose neighbours are in their own range."""
    yield from _packed((x.page_id, x.url, _text(x)) for x, open in _cut_off(_pages(batches)) if not open)


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The other pages, with those that they or pages of other ranges can be paired with: the nearest at both ends of the range."""
    opened: list[Page] = []
    ahead: dict = {}  # the first pages of the range that an earlier one can be paired with
    behind, host = Latest(), None
    first: list[Page] = []

    def seen() -> Iterator[Page]:
        nonlocal behind, host
        for x in _pages(batches):
            if x.host != host:
                behind, host = Latest(), x.host
            behind.add(x)
            # the first page, the first with other lines, and the same of the paths after the first
            if not first or x.host == first[0].host:
                for later in (False, True) if not first or x.path != first[0].path else (False,):
                    if later and not first:
                        continue
                    own = ahead.setdefault(later, [])
                    if len(own) < 2 and all(y.texts != x.texts for y in own):
                        own.append(x)
            if not first:
                first.append(x)
            yield x

    for x, open in _cut_off(seen()):
        if open:
            opened.append(x)
    is_open = {id(x) for x in opened}
    rows = {id(x): x for x in [*opened, *(y for x in opened for y in (x.before, x.after) if y is not None), *(y for own in ahead.values() for y in own), *behind.all, *behind.past]}
    for x in rows.values():
        values = (x.page_id, x.url, x.host, x.path, id(x) in is_open, json.dumps(x.lines))
        yield pa.RecordBatch.from_arrays([pa.array([v], kind) for v, kind in zip(values, (pa.int64(), pa.string(), pa.string(), pa.string(), pa.bool_(), pa.string()), strict=True)], ["page_id", "url", "host", "path", "open", "lines"])


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The text of the open pages among the edges of a host's ranges."""

    def pages() -> Iterator[Page]:
        for batch in batches:
            for r in batch.to_pylist():
                yield Page(r["page_id"], r["url"], r["host"], r["path"], [(t, m) for t, m in json.loads(r["lines"])], r["open"])

    yield from _packed((x.page_id, x.url, _text(x)) for x in paired(pages()) if x.open)


def _ranges(keyed: DataFrame, n: int):
    """A column with the range, of ``n``, of host, path and page_id. Its bounds are fixed here, so that it is the same in all uses."""
    keys = keyed.select("host", "path", F.coalesce("page_id", F.lit(-(1 << 63))).alias("page_id"))
    some = sorted(tuple(r) for r in keys.sample(min(1.0, 40 * n / max(1, keyed.count())), seed=7).collect())
    bounds = [some[len(some) * i // n] for i in range(1, n)] if some else []

    @F.arrow_udf(T.IntegerType())
    def place(host: pa.Array, path: pa.Array, page_id: pa.Array) -> pa.Array:
        return pa.array([bisect_right(bounds, k) for k in zip(host.to_pylist(), path.to_pylist(), page_id.to_pylist(), strict=True)], pa.int32())

    return place("host", "path", F.coalesce("page_id", F.lit(-(1 << 63))))


def extract(pages: DataFrame, ranges: int | None = None) -> DataFrame:
    """page_id, url, text and n_chars of each row of ``pages`` (page_id, url, html)."""
    n = shuffle_width(pages.sparkSession)
    keyed = pages.select("page_id", "url", url_host().alias("host"), url_path().alias("path"), "html")
    dealt = keyed.withColumn("range", _ranges(keyed.drop("html"), ranges or n)).repartitionById(ranges or n, "range")
    ordered = dealt.sortWithinPartitions("host", "path", "page_id", "url").drop("range")
    edges = ordered.mapInArrow(_edges, "page_id long, url string, host string, path string, open boolean, lines string")
    joined = edges.repartition(n, "host").sortWithinPartitions("host", "path", "page_id", "url")
    kind = "page_id long, url string, text string"
    return ordered.mapInArrow(_extract, kind).union(joined.mapInArrow(_joined, kind)).withColumn("n_chars", F.length("text").cast("long"))
