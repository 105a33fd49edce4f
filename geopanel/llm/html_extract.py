"""Main text of web pages by differencing pages with the nearest URLs.

Pages are cut into lines, one a block of text, without the markup that HTML or its class names declare to be scripts,
menus, headers, footers, sidebars, notices, adverts, forms or reader comments. The pages are dealt to cells of neighbours
in the order of host and URL path, in which the page whose path shares the longest head with a page's own stands before or
after it; a page at the edge of a cell also goes to the next one. The lines of both are aligned by longest common subsequence,
and those that the two pages share are template and go. Prose inside an <article> or <main>, which
the page itself declares to be the text, is exempt: a sentence two articles share is still part of both. Where a page has
such an element, lines outside it go as well.
"""

from __future__ import annotations

import html as _html
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from os.path import commonprefix

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geopanel.llm.common import partitions

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>script|style|template|noscript|iframe|svg|math|textarea|title|object)\b(?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*(?:>|\Z).*?(?:</(?P=raw)\s*>|\Z)"
    r"|<[!?][^>]*(?:>|\Z)|</(?P<end>[a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)|<(?P<start>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)|(?P<text>[^<]+|<)",
    re.S | re.I,
)
_ATTR = re.compile(r"([a-zA-Z][\w:-]*)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
# Fixed values of HTML: element names by their role.
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = set("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
_DROP = set("nav footer aside form button select option label dialog menu head datalist fieldset".split())
_MAIN = {"article", "main"}
_PROSE = set("p h1 h2 h3 h4 h5 h6 blockquote pre li dd dt td th figcaption article main".split())
_ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
_NAMES = set("ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs header masthead footer sidebar cookie cookies consent notice popup modal overlay newsletter subscribe signup login share sharing social comment comments respond reply disqus related recommended widget toolbar pagination pager copyright disclaimer".split())


@dataclass(frozen=True)
class Line:
    text: str
    main: bool
    prose: bool


def _dropped(tag: str, attrs: str, in_main: bool) -> bool:
    if tag in _DROP or (tag == "header" and not in_main):
        return True
    if tag in _MAIN or tag in ("html", "body") or not attrs:
        return False
    for name, a, b, c in _ATTR.findall(attrs):
        value, name = (a or b or c).lower(), name.lower()
        if name in ("class", "id") and _NAMES.intersection(re.split(r"[^a-z0-9]+", value)):
            return True
        if name == "role" and value in _ROLES or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
            return True
    return bool(re.search(r"(?:^|\s)hidden(?:\s|$|=)", attrs))


def lines(page: str) -> list[Line]:
    """Text blocks of a page in order, white space normalised, without what markup declares to be no text."""
    out: list[Line] = []
    stack: list[str] = []
    open_tags: Counter[str] = Counter()
    blocks: list[str] = []  # the block elements of the stack
    drop = -1  # stack depth of the outermost dropped element
    mains = 0
    words: list[str] = []
    prose = False

    def flush() -> None:
        if words:
            text = " ".join("".join(words).split())
            if text:
                out.append(Line(text, mains > 0, prose and mains > 0))
            words.clear()

    def pop() -> str:
        nonlocal drop, mains
        tag = stack.pop()
        open_tags[tag] -= 1
        mains -= tag in _MAIN
        if tag in _BLOCK:
            blocks.pop()
        if drop >= len(stack):
            drop = -1
        return tag

    def close(tag: str) -> None:
        """Pop up to the innermost element of that name, if there is one."""
        while open_tags[tag] and pop() != tag:
            pass

    for m in _TOKEN.finditer(page):
        kind = m.lastgroup
        if kind == "text":
            if drop < 0:
                if not words:
                    prose = bool(blocks) and blocks[-1] in _PROSE
                words.append(_html.unescape(m["text"]))
        elif m["start"]:
            tag = m["start"].lower()
            if tag == "br":
                words.append(" ")
                continue
            if tag in _BLOCK:
                flush()
                if tag not in ("html", "body"):
                    close("p")
                if tag in ("li", "dd", "dt", "tr", "td", "th", "option") and stack and stack[-1] == tag:
                    pop()
            if tag in _VOID or m["attrs"].endswith("/"):
                continue
            if tag in _MAIN and drop >= 0:  # an unclosed menu does not swallow the article
                drop = -1
            if drop < 0 and _dropped(tag, m["attrs"], mains > 0):
                drop = len(stack)
            stack.append(tag)
            open_tags[tag] += 1
            if tag in _BLOCK:
                blocks.append(tag)
            mains += tag in _MAIN
        elif m["end"]:
            tag = m["end"].lower()
            if tag in _BLOCK:
                flush()
            close(tag)
    flush()
    return out


def _lengths(a: list[str], b: list[str]) -> np.ndarray:
    """Length of a longest common subsequence of a with b[:j], for every j, by one integer of len(b) bits (Hyyro)."""
    where: dict[str, int] = {}
    for j, v in enumerate(b):
        where[v] = where.get(v, 0) | 1 << j
    full = (1 << len(b)) - 1
    row = full
    for v in a:
        hit = where.get(v)
        if hit:
            row = ((row + (row & hit)) | (row & ~hit)) & full
    bits = np.unpackbits(np.frombuffer(row.to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(b)]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def common(a: list[str], b: list[str]) -> set[int]:
    """Places in a of a longest common subsequence with b, in memory linear in both: common heads and tails, then the
    halves of a with the parts of b that give the longest sum (Hirschberg)."""
    out: set[int] = set()
    todo = [([(i, v) for i, v in enumerate(a)], b)]
    while todo:
        x, y = todo.pop()
        both = {v for _, v in x}.intersection(y)
        x, y = [p for p in x if p[1] in both], [v for v in y if v in both]
        lo, n, m = 0, len(x), len(y)
        while lo < n and lo < m and x[lo][1] == y[lo]:
            lo += 1
        while n > lo and m > lo and x[n - 1][1] == y[m - 1]:
            n, m = n - 1, m - 1
        out.update(i for i, _ in x[:lo] + x[n:])
        x, y = x[lo:n], y[lo:m]
        if not x or not y:
            continue
        if len(x) == 1:
            if x[0][1] in y:
                out.add(x[0][0])
            continue
        half = len(x) // 2
        ahead = _lengths([v for _, v in x[:half]], y)
        back = _lengths([v for _, v in reversed(x[half:])], y[::-1])[::-1]
        k = int(np.argmax(ahead + back))
        todo += [(x[:half], y[:k]), (x[half:], y[k:])]
    return out


def main_text(page: list[Line], *others: list[Line] | None) -> str:
    """The page's text given the lines of other pages, the nearest first: it is paired with the first that is no copy. Pages
    that share over nine tenths of all lines are copies, which say nothing of each other's template."""
    shared: set[int] = set()
    for other in others:
        if other is not None:
            shared = common([v.text for v in page], [v.text for v in other])
            if 10 * len(shared) <= 9 * max(len(page), len(other)):
                break
            shared = set()
    declared = any(v.main for v in page)
    return " ".join(v.text for i, v in enumerate(page) if (v.prose if declared else False) or (v.main or not declared) and i not in shared)


def _packed(page: list[Line]) -> str:
    """Lines, which hold no line breaks, as one string: a sign for main and prose before each."""
    return "\n".join(str(v.main + v.prose) + v.text for v in page)


def _unpacked(packed: str) -> list[Line]:
    return [Line(v[1:], v[0] > "0", v[0] > "1") for v in packed.split("\n")] if packed else []


#: Cells of neighbouring pages for each shuffle partition, and keys in the sample for each cell.
CELLS, SAMPLED = 4, 20
#: Pages from which there are further cells, and the cells up to which there are: they bound the driver's keys. Cells beyond
#: that get longer, which takes time but no memory, as pages are read in order.
CELL_PAGES, MOST_CELLS = 5_000, 20_000


def _order(host: str, path: str, key, mark: int) -> tuple:
    """The order of pages, null ids first, as Spark orders a struct of these."""
    return host, path, key is not None, key if key is not None else 0, mark


def _nearness(a: str, b: str) -> int:
    """Characters at the head that two paths share."""
    return len(commonprefix([a, b]))


def _cells(keys: DataFrame, least: int) -> tuple[list[tuple], set[tuple]]:
    """(first keys of all cells but the lowest, last keys of the cells before those): as many keys as cells on the driver.

    keys has host, path, id, mark. Keys with the least hashes are the sample; cells follow the table and least alone.
    """
    total = keys.count()
    cells = max(least, min(total // CELL_PAGES, MOST_CELLS))
    # At most as many sampled keys as the cells ask for, give or take their root.
    some = keys.where(F.pmod(F.xxhash64(*keys.columns, F.lit(3)), F.lit(max(1, total // (cells * SAMPLED)))) == 0).distinct()
    rows = sorted(_order(*r) for r in some.collect())
    bounds = sorted(set(rows[SAMPLED::SAMPLED]))

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple] = {}
        schema = None
        for b in batches:
            schema = b.schema
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                at = _order(*row)
                k = bisect_right(bounds, at)
                if k < len(bounds) and (k not in best or best[k] < (at, row)):
                    best[k] = at, row
        if best:
            cols = list(zip(*(row for _, row in best.values()), strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(list(best), pa.int32()), *[pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)]], names=["cell", *schema.names])

    if not bounds:
        return [], set()
    kinds = ", ".join(f"{n} {t}" for n, t in keys.dtypes)
    ends = keys.mapInArrow(last, f"cell int, {kinds}").groupBy("cell").agg(F.max(F.struct(*keys.columns)).alias("k"))
    return bounds, {_order(*r.k) for r in ends.collect()}


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id, url, text, n_chars of every page.

    A page is paired with the page of its host whose path shares the longest head with its own: in the order of host, path,
    id and content hash that is the page before it or the one after it, the one before if they share as much. Where that one
    is a copy, the other is taken; a host's only page has no pair. This holds however the pages are partitioned: they are dealt
    to cells of neighbours, and a cell also gets the page before and the page after its own. Null html is empty; a null or odd URL is
    a host of its own name; repeated rows are copies; an empty table gives an empty result; further columns are ignored. A
    page's time is linear in its length, but for the alignment, which takes lines times lines / 64.
    """
    id_type = dict(pages.dtypes)[id_col]
    url = F.coalesce(F.col(url_col).cast("string"), F.lit(""))
    host = F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    path = F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*)?([^#]*)", 1)
    page = F.col(html_col).cast("string")
    rows = pages.select(host.alias("host"), path.alias("path"), F.col(id_col).alias("id"), F.xxhash64(page).alias("mark"), F.col(url_col).cast("string").alias("url"), page.alias("html"))
    n = partitions(pages.sparkSession)
    bounds, lasts = _cells(rows.select("host", "path", "id", "mark"), CELLS * n)
    shared = pages.sparkSession.sparkContext.broadcast((bounds, lasts, set(bounds)))  # as many keys as cells

    def cut_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(cell, ghost, host, path, id, mark, url, lines); ghosts are pages of the cells beside."""
        bounds, lasts, firsts = shared.value
        for b in batches:
            pick, cell, ghost, text = [], [], [], []
            for i, (h, p, k, m) in enumerate(zip(*(c.to_pylist() for c in b.columns[:4]), strict=True)):
                at = _order(h, p, k, m)
                c = bisect_right(bounds, at)
                packed = _packed(lines(b.column(5)[i].as_py() or ""))
                for to, is_ghost, ok in ((c, False, True), (c + 1, True, at in lasts), (c - 1, True, at in firsts)):
                    if ok:
                        pick.append(i), cell.append(to), ghost.append(is_ghost), text.append(packed)
            own = [c.take(pa.array(pick, pa.int32())) for c in b.columns[:5]]
            yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), pa.array(ghost, pa.bool_()), *own, pa.array(text, pa.string())], names=["cell", "ghost", "host", "path", "id", "mark", "url", "lines"])

    rows = rows.mapInArrow(cut_lines, f"cell int, ghost boolean, host string, path string, id {id_type}, mark long, url string, lines string")
    rows = rows.repartition(max(n, -(-len(bounds) // CELLS)), "cell").sortWithinPartitions("cell", "host", "path", "id", "mark")
    rows = rows.select("cell", "ghost", "host", "path", "id", "url", "lines")

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before: tuple | None = None  # place (cell, host), ghost, path, id, url and lines of a page
        page: tuple | None = None  # the page after that, which waits for the one after itself
        out: list[tuple] = []
        kind = pa.int64()

        def put(after: tuple | None) -> None:
            if page is None or page[1]:
                return
            beside = [p for p in (before, after) if p is not None and p[0] == page[0]]
            beside.sort(key=lambda p: -_nearness(p[2], page[2]))
            text = main_text(page[5], *(p[5] for p in beside))
            out.append((page[3], page[4], text, len(text)))

        def batch() -> pa.RecordBatch:
            got = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (kind, pa.string(), pa.string(), pa.int64()), strict=True)]
            out.clear()
            return pa.RecordBatch.from_arrays(got, names=["id", "url", "text", "n_chars"])

        for b in batches:
            kind = b.column(4).type
            for cell, ghost, host, path, key, link, packed in zip(*(c.to_pylist() for c in b.columns), strict=True):
                after = ((cell, host), ghost, path, key, link, _unpacked(packed))
                put(after)
                before, page = page, after
                if len(out) >= 500:
                    yield batch()
        put(None)
        if out:
            yield batch()

    return rows.mapInArrow(pair, f"id {id_type}, url string, text string, n_chars long")
