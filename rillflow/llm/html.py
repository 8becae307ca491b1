"""Main text of web pages by nearest-URL page differencing.

Pages of a host, in order of URL path, stand beside the pages most like them in address and so in
template. A page's lines (blocks of text, in page order) are aligned with those of the nearer
neighbour by longest common subsequence, and lines that both share are template, not content.

What makes lines equal: a line in a *slot* of the template (the path of the elements around it that bear a class or id, or
are a menu, header, footer, sidebar or form by name) stands for the slot, as adverts, menus and footers fill one slot with other words on
every page. Any other line stands for its text. The main slot of a page, its article or main element or, without one, the
unmarked slot that holds most text, is never taken as a slot: its lines are compared by text.

The alignment decides first, and three rules bound it. Lines inside the article or main element stay though a neighbour shares
them, as copied articles share all their lines. A neighbour that shares ``COPY`` of a page's texts is a copy of it
and says nothing of texts: the other neighbour is asked, and if that is a copy as well, slots alone are deleted. Names of the markup speak only where
no neighbour can: a line without counterpart (an advert on one page alone) goes if its own element is one by name (a footer, or
of a class that is a whole word of the list); on a page without any neighbour in its host, so do lines further inside such elements.

Neighbours come from a range-partitioned sort by (host, path, page_id); the first and last page of each
partition travel on with their neighbour inside, and the few rows of all partition ends meet in one
short ordered pass. No host is ever gathered in a task. Lines are compared as 63-bit digests.

Defined cases: a null or empty html gives an empty text; a null url is a host of its own; unclosed,
misnested or cut markup is read as far as it goes, in time linear in the page; a page without neighbour in its host keeps all
lines that no name marks; an article inside an element that is furniture by class alone is main text, one inside a nav, aside, header or footer is not; repeated rows are one page in the order, and each gets its text; rows with a null page_id are kept; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import cache
from itertools import groupby
from typing import NamedTuple
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillflow.llm import common

# Element names of the HTML standard, by role.
_SKIPPED = frozenset("script style template noscript head title svg iframe object canvas audio video select textarea button".split())
_FURNITURE = frozenset("nav header footer aside form menu dialog".split())
_CONTENT = frozenset("article main".split())
_BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript iframe".split())
_MARKED = frozenset(
    "ad ads advert advertisement adverts banner sponsor sponsored promo menu nav navbar navigation breadcrumb breadcrumbs sidebar footer header masthead cookie cookies consent notice popup modal newsletter subscribe share social related comment comments reply replies disqus widget toolbar pagination pager".split()
)
_WHOLE = frozenset("html body main article".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
_TAG = re.compile(r"<(?:!--.*?(?:-->|\Z)|[!?][^>]*(?:>|\Z)|(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*+)(?:>|\Z))", re.S)
_ATTR = re.compile(r"\b(class|id|role|aria-hidden|hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_WHITE = re.compile(r"\s+")

#: Elements that a new paragraph closes together with the open one.
_FORMAT = frozenset("b i em strong a span u font".split())
_NAMED = re.compile(r"\b(class|id)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
_NUMBER = re.compile("[0-9]+")

#: Regions: nothing known, in an element named as furniture, main text, and itself an element named so.
UNDECIDED, FURNITURE, CONTENT, NAMED = 0, 1, 2, 3
#: Share of a page's texts that makes a neighbour a copy.
COPY = 0.8
_PAIRS = 1 << 25


class _Open(NamedTuple):
    """An open element: whether its text counts, in which region and slot, the place of the innermost element that is no mere format, and the number of the outermost element around it that is furniture by class alone."""

    name: str
    region: int
    hidden: bool
    slot: int
    base: int
    mark: int


_ROOT = _Open("", UNDECIDED, False, 0, -1, 0)


def lines(page: str | None) -> list[tuple[str, int, int]]:
    """Text, region and slot (0: none) of each block of a page that has text, in page order.

    A class names an element by a whole word only, never the page's body or main elements, and not an element that holds most of the page's text.
    """
    page, out, held, marks = page or "", [], [], 0
    stack: list[_Open] = []
    depth: Counter[str] = Counter()
    now = _ROOT

    def close() -> None:
        if held:
            if text := _WHITE.sub(" ", entities.unescape("".join(held))).strip():
                out.append((text, now.region, now.slot, now.mark))
            held.clear()

    def leave(to: int) -> _Open:
        for x in stack[to:]:
            depth[x.name] -= 1
        del stack[to:]
        return stack[-1] if stack else _ROOT

    at, end = 0, len(page)
    while at < end:
        m = _TAG.search(page, at)
        stop = m.start() if m else end
        if stop > at and not now.hidden:
            held.append(page[at:stop])
        if not m:
            break
        at, name = m.end(), (m[2] or "").lower()
        if not name:
            continue
        block = name in _BLOCKS
        if block:
            close()
        if m[1]:
            if depth[name]:
                to = len(stack) - 1
                while stack[to].name != name:
                    to -= 1
                if any(x.name in _BLOCKS for x in stack[to:]):
                    close()
                now = leave(to)
            continue
        if name in _VOID:
            continue
        if name == "p" and stack and stack[-1].base >= 0 and stack[stack[-1].base].name == "p":  # a paragraph ends where the next begins
            now = leave(stack[-1].base)
        region, hidden, slot, mark = now.region, now.hidden or name in _SKIPPED, now.slot, now.mark
        if block and region == NAMED:
            region = FURNITURE
        if name in _CONTENT and (region == UNDECIDED or mark):
            region, mark = CONTENT, 0
        elif name in _FURNITURE or _role(m[3]):
            region, hidden, mark = (NAMED, hidden, 0) if block else (region, True, mark)
        elif name not in _WHOLE and _classed(m[3]):
            if not block:
                hidden = True
            elif region == FURNITURE:
                region = NAMED
            else:
                marks += region == UNDECIDED
                region, mark = NAMED, marks if region == UNDECIDED else 0
        if block and (name in _FURNITURE or _NAMED.search(m[3])):
            part = name + "".join(_NUMBER.sub("0", f" {x[0].lower()}={x[1] or x[2] or x[3]}") for x in _NAMED.findall(m[3]))
            slot = _digest(f"{slot} {part}")
        if name in _RAW and not m[0].endswith("/>"):
            shut = _shut(name).search(page, at)
            at = shut.end() if shut else end
            continue
        if not m[3].endswith("/") or block:
            base = stack[-1].base if name in _FORMAT and stack else -1 if name in _FORMAT else len(stack)
            stack.append(now := _Open(name, region, hidden, slot, base, mark))
            depth[name] += 1
    close()
    mass: Counter[int] = Counter()
    for text, *_, mark in out:
        mass[mark] += len(text)
    most = {k for k, n in mass.items() if k and 2 * n > sum(mass.values())}
    return [(text, UNDECIDED if mark in most else region, slot) for text, region, slot, mark in out]


@cache
def _shut(name: str) -> re.Pattern:
    return re.compile(rf"</{name}\s*>", re.I)


def _digest(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def keys(found: list[tuple[str, int, int]]) -> list[int]:
    """What each line stands for in an alignment: an odd number for its slot, an even one for its text."""
    mass: Counter[int] = Counter()
    if all(region != CONTENT for _, region, _ in found):
        for text, region, slot in found:
            if region == UNDECIDED:
                mass[slot] += len(text)
    main = max(mass, key=lambda k: mass[k]) if mass else None
    own = lambda region, slot: slot and region != CONTENT and not (region == UNDECIDED and slot == main)
    return [_digest(str(slot)) | 1 if own(region, slot) else _digest(text) & -2 for text, region, slot in found]


def kept(found: list[tuple[str, int, int]], shared: list[bool] | None) -> list[str]:
    """The lines that stay. Outside the article, what a neighbour shares goes. Names only speak where no neighbour can: of a line without
    a counterpart its own element's name, and on a page without any neighbour (``shared`` is None) also those around it."""
    if shared is None:
        return [text for text, region, _ in found if region not in (FURNITURE, NAMED)]
    shared = shared or [False] * len(found)
    return [text for (text, region, _), gone in zip(found, shared) if region == CONTENT or not gone and region != NAMED]


def _role(attributes: str) -> bool:
    for name, *value in _ATTR.findall(attributes) if "role" in attributes or "hidden" in attributes else ():
        name, value = name.lower(), "".join(value).lower()
        if name == "role" and value in _ROLES or name == "hidden" or name == "aria-hidden" and value == "true":
            return True
    return False


def _classed(attributes: str) -> bool:
    return "=" in attributes and any(name.lower() in ("class", "id") and not _MARKED.isdisjoint("".join(value).lower().split()) for name, *value in _ATTR.findall(attributes))


def common_lines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Flags of a's entries in a longest common subsequence of a and b.

    After common ends are set aside, the table of the alignment is kept as bit vectors, one integer of
    len(b) bits for each entry of a; entries that the other side lacks are left out before. Where the
    table would pass ``_PAIRS`` bits, every so many rows are kept and the rows between made again; the result is the same.
    """
    keep = np.zeros(len(a), bool)
    n = min(len(a), len(b))
    same = a[:n] == b[:n]
    head = n if same.all() else int(same.argmin())
    same = a[len(a) - (n - head) :][::-1] == b[len(b) - (n - head) :][::-1]
    tail = n - head if same.all() else int(same.argmin())
    keep[:head] = True
    keep[len(a) - tail :] = True
    rows = np.arange(head, len(a) - tail)
    x, y = a[rows], b[head : len(b) - tail]
    rows, y = rows[np.isin(x, y)], y[np.isin(y, x)]
    keep[rows[_aligned(a[rows].tolist(), y.tolist())]] = True
    return keep


def _aligned(x: list, y: list) -> list[int]:
    """Indices of x in a longest common subsequence with y."""
    if not x or not y:
        return []
    where: dict = {}
    for j, v in enumerate(y):
        where[v] = where.get(v, 0) | 1 << j
    full = (1 << len(y)) - 1

    def below(state: int, part: list) -> Iterator[int]:
        for v in part:
            u = state & where.get(v, 0)
            state = (state + u | state - u) & full
            yield state

    step = len(x) if len(x) * len(y) <= _PAIRS else math.isqrt(len(x)) + 1
    marks, state = [full], full  # the state before each run of rows
    for i in range(0, len(x) - step, step):
        for state in below(state, x[i : i + step]):
            pass
        marks.append(state)
    out, j = [], len(y)
    for k in range(len(marks) - 1, -1, -1):
        table = [marks[k], *below(marks[k], x[k * step : (k + 1) * step])]
        for i in range(len(table) - 1, 0, -1):  # a zero bit is a step of the length at that place
            while j and table[i] >> (j - 1) & 1:
                j -= 1
            if not j:
                return out[::-1]
            if table[i - 1] >> (j - 1) & 1:
                out.append(k * step + i - 1)
                j -= 1
    return out[::-1]


def _address(url: str | None) -> tuple[str, str]:
    try:
        parts = urlsplit(url or "")
        return (parts.hostname or "").lower(), parts.path or "/"
    except ValueError:
        return "", url or "/"


def _nearness(a: str, b: str) -> tuple[int, int]:
    """Common leading segments, then common leading characters of two paths."""
    x, y = a.split("/"), b.split("/")
    segments = next((i for i, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))
    return segments, next((i for i, (p, q) in enumerate(zip(a, b)) if p != q), min(len(a), len(b)))


_PAGE = "row string, host string, path string, page_id long, digests array<long>"


def _addresses(pages: DataFrame) -> DataFrame:
    """One row a page: its place in the order and its lines' digests."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        spots = [_address(u) for u in batch.column(2).to_pylist()]
        digests = [keys(lines(h.as_py())) for h in batch.column(3)]
        yield pa.record_batch([batch.column(0), pa.array([s[0] for s in spots]), pa.array([s[1] for s in spots]), batch.column(1), pa.array(digests, pa.list_(pa.int64()))], names=[x.split()[0] for x in _PAGE.split(", ")])

    return common.map_arrow(pages, run, _PAGE)


def _shared(page: tuple, before: tuple | None, after: tuple | None) -> list[bool] | None:
    """Flags of a page's lines that a neighbour in the same host shares: the nearer one (ties: the one before) that is no copy; None without a neighbour.

    A slot that the neighbour fills too is shared as a whole, however many lines either page has in it.
    """
    near = [(_nearness(page[2], x[2]), -k, x) for k, x in enumerate((before, after)) if x is not None and x[1] == page[1]]
    near = [np.array(x[2][4], np.int64) for x in sorted(near, key=lambda x: x[:2], reverse=True)]
    own = np.array(page[4], np.int64)
    texts = own[own & 1 == 0]
    for other in near:
        if not len(texts) or np.isin(texts, other).mean() < COPY:
            found = common_lines(own, other)
            return (found | np.isin(own, own[found & (own & 1 == 1)])).tolist()
    return np.isin(own, own[common_lines(own, near[0]) & (own & 1 == 1)]).tolist() if near else None


_ENDS = f"shared array<boolean>, part int, place int, {_PAGE}"


def _neighbours(sorted_pages: DataFrame) -> DataFrame:
    """Shared flags of each page within its partition; a partition's ends come with what they lack (part, place)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, window, first = TaskContext.get().partitionId(), [], True
        kind = (pa.list_(pa.bool_()), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.list_(pa.int64()))
        names = [x.split()[0] for x in _ENDS.split(", ")]
        bare = (None, None, None, None, None)

        def batch_of(rows: list) -> pa.RecordBatch:
            return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), kind)], names=names)

        def pages() -> Iterator[tuple]:
            for batch in batches:
                yield from zip(*(c.to_pylist() for c in batch.columns))

        out = []
        for page in pages():
            window.append(page)
            if len(window) == 2:
                if first:  # the first page, and its neighbour inside
                    out += [(None, part, 0, *window[0]), (None, part, 1, *window[1])]
                    first = False
            elif len(window) == 3:
                out.append((_shared(window[1], window[0], window[2]), None, None, window[1][0], *bare[1:]))
                window.pop(0)
            if len(out) >= 256:
                yield batch_of(out)
                out = []
        if len(window) == 1:
            out.append((None, part, 4, *window[0]))
        elif window:
            out += [(None, part, 2, *window[0]), (None, part, 3, *window[1])]
        if out:
            yield batch_of(out)

    return common.in_arrow(sorted_pages, run, _ENDS)


def _join_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shared flags of the pages at the ends of partitions: rows in order of (part, place), a few a partition."""

    def parts() -> Iterator[dict[int, tuple]]:
        rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
        for _, lot in groupby(rows, key=lambda r: r[0]):
            yield {r[1]: r[2:] for r in lot}

    def flagged(row: tuple, before: tuple | None, after: tuple | None) -> tuple:
        return row[0], _shared(row, before, after)

    before, waiting, out = None, None, []  # the last page seen; the last page of the part before and its neighbour inside
    for part in parts():
        first = part.get(4, part.get(0))
        if waiting:
            out.append(flagged(waiting[0], waiting[1], first))
        if 4 in part:
            waiting = (first, before)
        else:
            out.append(flagged(first, before, part[1]))
            waiting = (part[3], part[2])
        before = waiting[0]
    if waiting:
        out.append(flagged(waiting[0], waiting[1], None))
    if out:
        yield pa.record_batch([pa.array([r[0] for r in out]), pa.array([r[1] for r in out], pa.list_(pa.bool_()))], names=["row", "shared"])


def shared_lines(rows: DataFrame) -> DataFrame:
    """row and shared (a flag a line) of pages (row, page_id, url, html)."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["host", "path", "page_id", "row"]
    flat = _addresses(rows).dropDuplicates(["row"]).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    found, _ = common.materialize(_neighbours(flat), "html-lines")
    ends = found.where("part is not null").select("part", "place", *[x.split()[0] for x in _PAGE.split(", ")])
    ends = common.in_arrow(ends.repartition(1).sortWithinPartitions("part", "place"), _join_ends, "row string, shared array<boolean>")
    return found.where("part is null").select("row", "shared").unionByName(ends)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url and text of every page."""
    key = F.concat_ws("-", F.coalesce(F.col("page_id").cast("string"), F.lit("null")), F.hex(F.xxhash64("page_id", "url", "html")))
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    rows = rows.select(key.alias("row"), "page_id", "url", "html")
    flags = shared_lines(rows).withColumnRenamed("row", "_row")

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts = []
        for page, shared in zip(batch.column(2), batch.column(3)):
            texts.append("\n".join(kept(lines(page.as_py()), shared.as_py())))
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    joined = rows.join(flags, rows.row == flags["_row"], "left").select("page_id", "url", "html", "shared")
    return common.map_arrow(joined, run, "page_id long, url string, text string")


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract(common.table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
