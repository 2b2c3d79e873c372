r"""Main text of web pages: nearest-URL page differencing.

Pages of one host are put in the order of their URL paths, and each is paired with its neighbour there: pages near in the order come from
one template. The text lines of both are aligned by their longest common subsequence, and shared lines are deleted: menus, banners and
footers repeat, articles don't. An exact check of each page's own markup follows, for what a pair can't tell: lines that a page marks as its
article stay though its neighbour has them too (copied articles), and lines in menus, forms, notices, adverts or reader comments go though
only this page has them.

Plan: one pass parses pages to lines, and only lines are shuffled, once, by ranges of (host, path, id). A range starts with a page of the sample
that cut the ranges, so that page is also sent, as a neighbour only, to the range before it, and pairs across ranges are not lost.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeweave.llm.common import read, small_batches, text_of

TAG = re.compile(r"<(?:!--(?s:.*?)(?:-->|\Z)|(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']+|\"[^\"]*\"|'[^']*')*+)>|/?[a-zA-Z][^>]*(?:>|\Z)|[!?/][^>]*(?:>|\Z))")
ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
#: Elements whose content is no text of the page.
RAW = frozenset("script style noscript template title textarea iframe svg math object select option button canvas audio video".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
SKIP = frozenset("nav aside footer form head dialog menu fieldset".split())
CONTENT = frozenset("article main".split())
#: Words in a class or id that mark what is no article; whole words, as cut at anything but letters.
NOT_ARTICLE = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe signup login "
    "nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager sidebar sidebars aside widget widgets related recommended share sharing social footer footers masthead topbar toolbar "
    "copyright comment comments respond replies reply disqus discussion search".split()
)
IS_CONTENT = frozenset("article content main post entry story maincontent".split())
SPEAKS_OF = frozenset("has with without no is not".split())
#: Pages in a range, about, and the most ranges, whose starts every worker holds.
RANGE_PAGES, MOST_RANGES = 1000, 20_000
HEADER = re.compile(r"\b(?:class|id)\s*=\s*(?:\"[^\"]*\bheader\b|'[^']*\bheader\b|header\b|\w+-header\b)", re.I)
SPLIT = re.compile(r"[^a-z]+")


def _marks(name: str, attributes: str) -> tuple[bool, bool]:
    """(no article, article) as an element's class, id, role and visibility say.

    A page's outer elements are no part of it that could be left out; a name such as ``has-sidebar`` speaks of what is inside.
    """
    bad = good = False
    for m in ATTRIBUTE.finditer(attributes):
        kind, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if kind in ("class", "id"):
            for one in value.split():
                words = SPLIT.split(one)
                if words[0] not in SPEAKS_OF:
                    bad |= not NOT_ARTICLE.isdisjoint(words)
                    good |= not IS_CONTENT.isdisjoint(words)
        elif kind == "role":
            bad |= value in ("navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "menu")
            good |= value in ("main", "article")
        elif kind == "hidden" or kind == "aria-hidden" and value == "true" or kind == "style" and re.search(r"display\s*:\s*none", value):
            bad = True
    bad = bad and name not in ("html", "body", "main")
    return bad, good and not bad


def blocks(page: str) -> list[tuple[str, bool, int]]:
    """(text, skipped, depth of article) of each non-empty block of a page in order.

    A block ends where an element that isn't inline begins or ends. Character references are decoded, white space is one space. ``depth``: 2 inside an
    article or main element, 1 inside another element that says it is content, else 0.
    """
    out: list[tuple[str, bool, int]] = []
    stack: list[tuple[str, bool, int]] = []  # open elements: name, skipped, depth of article
    skipped, depth, at, parts = False, 0, 0, []

    def end_block() -> None:
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append((text, skipped, depth))
            parts.clear()

    find, n = TAG.search, len(page)
    while True:
        m = find(page, at)
        parts.append(page[at : m.start()] if m else page[at:])
        if not m:
            break
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if m[1]:
            if name in INLINE and not any(s[0] == name for s in stack[-1:]):
                continue
            if name not in INLINE:
                end_block()
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    end_block()
                    del stack[k:]
                    skipped, depth = stack[-1][1:] if stack else (False, 0)
                    break
            continue
        if name in RAW:
            if not m[3].endswith("/"):
                close = re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)", re.I).search(page, at)
                at = n if not close else close.start()
            continue
        bad, good = _marks(name, m[3]) if m[3] and not m[3].isspace() else (False, False)
        if name in INLINE and not bad:
            continue
        end_block()
        if name in VOID or m[3].endswith("/"):
            continue
        # an open paragraph ends where another block begins, a list item where the next one does
        while stack and (stack[-1][0] in ("p", *INLINE) and name not in INLINE or stack[-1][0] == name and name in ("li", "dt", "dd", "tr", "td", "th", "option")):
            stack.pop()
            skipped, depth = stack[-1][1:] if stack else (False, 0)
        # a header of the page, not one inside its article
        skipped = skipped or bad or name in SKIP or (name == "header" and depth < 2) or (depth < 1 and HEADER.search(m[3]) is not None)
        depth = 2 if name in CONTENT and not skipped else max(depth, 1 if good and not skipped else 0)
        stack.append((name, skipped, depth))
    end_block()
    return out


def shared_lines(a: list[str], b: list[str]) -> set[int]:
    """Positions in ``a`` of a longest common subsequence with ``b``, by rows of bits; lines that only one page has are left out first."""
    in_a, in_b = set(a), set(b)
    left, right = [i for i, x in enumerate(a) if x in in_b], [x for x in b if x in in_a]
    where: dict[str, int] = {}
    for j, x in enumerate(right):
        where[x] = where.get(x, 0) | 1 << j
    full = (1 << len(right)) - 1
    v, rows = full, [full]
    for i in left:  # bit j of a row is 0 where the prefix to j gains a match
        u = v & where[a[i]]
        v = ((v + u) | (v - u)) & full
        rows.append(v)
    found, j = set(), len(right) - 1
    for k in range(len(left), 0, -1):
        zero = ~rows[k] & full & ((1 << (j + 1)) - 1)  # the last gain up to j
        if not zero:
            break
        j2 = zero.bit_length() - 1
        if rows[k - 1] >> j2 & 1:  # made by this line
            found.add(left[k - 1])
            j = j2 - 1
    return found


def main_text(page: list[tuple[str, bool, int]], shared: set[int]) -> str:
    """The lines that stay, joined by one space: those that aren't shared; the page's markup restores shared lines of its article and takes out skipped ones."""
    best = max((d for _, s, d in page if not s), default=0)
    return " ".join(t for i, (t, s, d) in enumerate(page) if not s and (i not in shared or best and d == best))


def url_order(url: str | None) -> tuple[str, str]:
    """(host, path with query) of a URL; host in lower case without ``www.``."""
    m = re.match(r"(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)([^#]*)", url or "")
    return (m[1].rpartition("@")[2].lower().removeprefix("www."), m[2]) if m else ("", url or "")


LINES = "range int, neighbour boolean, host string, path string, page_id long, url string, texts array<string>, skipped array<boolean>, depth array<int>"


def range_starts(ranked: list[tuple[str, str, int]], n: int) -> list[tuple[str, str, int]]:
    """Where ranges of pages begin, from a sorted sample of (host, path, id): inside a host only at a page that another page of it follows, or else where the host begins."""
    starts: list[tuple[str, str, int]] = []
    for at in sorted({i * len(ranked) // n for i in range(1, n)}):
        start = ranked[at]
        if at + 1 == len(ranked) or ranked[at + 1][0] != start[0]:
            start = (start[0], "", -(1 << 63))
        if not starts or start > starts[-1]:
            starts.append(start)
    return starts


def extract(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id``, ``url``, ``text``, ``n_chars`` (code points), ``n_lines`` and ``n_shared`` (lines that the neighbour has) of every page.

    Null or empty pages have an empty text. Pages with no URL count as one host. A host's only page shares nothing, and its own markup decides
    alone. Pages that repeat are neighbours of each other: all their lines are shared, so only what is marked as an article stays.
    """
    spark = pages.sparkSession
    p = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), text_of(html_col).alias("html"))
    # starts of ranges: pages of a sample, whose size follows the number of ranges and not that of pages
    keys = p.select("page_id", "url")
    total = keys.count()
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(MOST_RANGES, total // RANGE_PAGES))
    picked = keys.sample(fraction=min(1.0, 20 * n / max(1, total)), seed=7).limit(60 * n).collect()
    order = lambda r: (*url_order(r.url), r.page_id if r.page_id is not None else -(1 << 63))
    ranked = sorted({order(r) for r in picked})
    starts = range_starts(ranked, n) if len(ranked) > n else []

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begins = set(starts)
        for b in batches:
            rows: list[list] = [[] for _ in range(9)]
            for page_id, url, page in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                key = (*url_order(url), page_id if page_id is not None else -(1 << 63))
                found = blocks(page.as_py())
                k = bisect_right(starts, key)
                for at, neighbour in ((k, False), *([(k - 1, True)] if key in begins else [])):
                    for column, x in zip(rows, (at, neighbour, key[0], key[1], page_id, url, *([x[i] for x in found] for i in range(3))), strict=True):
                        column.append(x)
            kinds = (pa.int32(), pa.bool_(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.list_(pa.string()), pa.list_(pa.bool_()), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, kinds, strict=True)], names=[x.split()[0] for x in LINES.split(", ")])

    lines = p.mapInArrow(parse, LINES).repartition(n, "range").sortWithinPartitions("range", "neighbour", "host", "path", F.col("page_id").asc_nulls_first())

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = page = None  # rows in order; each is compared with the next of its host and range, or else with the one before
        done: list[tuple] = []

        def finish(page: dict, other: dict | None) -> None:
            shared = shared_lines(page["texts"], other["texts"]) if other else set()
            text = main_text(list(zip(page["texts"], page["skipped"], page["depth"], strict=True)), shared)
            done.append((page["page_id"], page["url"], text, len(text), len(page["texts"]), len(shared)))

        def near(a: dict | None, b: dict | None) -> dict | None:
            return b if a and b and a["host"] == b["host"] and a["range"] == b["range"] else None

        def out() -> pa.RecordBatch:
            b = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["page_id", "url", "text", "n_chars", "n_lines", "n_shared"])
            done.clear()
            return b

        for b in batches:
            for row in b.to_pylist():
                if page and not page["neighbour"]:
                    finish(page, near(page, row) or near(page, before))
                before, page = page, row
            if done:
                yield out()
        if page and not page["neighbour"]:
            finish(page, near(page, before))
        if done:
            yield out()

    return lines.mapInArrow(compare, "page_id long, url string, text string, n_chars long, n_lines long, n_shared long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return extract(read(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")
