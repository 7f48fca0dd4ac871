"""Main text of web pages by nearest-URL page differencing.

Pages are sorted by host and path; each is paired with the neighbour whose path is nearest. The
text lines of the two are aligned by a longest common subsequence, and shared lines are template,
not content. A neighbour that shares nearly all of a page's text is a copy of it and says nothing
about templates; the neighbour on the other side is taken then. The sort is dealt out by ranges of
its keys, and a range also gets the page before and the page after it, so that results don't depend
on the number of partitions.

Differencing alone is wrong where articles share lines or where menus and adverts change from page
to page, so markup has the last word where it is explicit: text inside <article> or <main> is
content even if shared, and text inside navigation, footers, adverts, forms, comments and the like
never is. Elsewhere the lines that are not shared stay.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections import Counter
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import dropped, only, received, sent, slices, staged
from .url_filter import split_url

# HTML's elements by what they do to text.
_RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "xmp", "noembed", "noframes"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_BLOCK = {
    "address", "article", "aside", "blockquote", "body", "button", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt",
    "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html",
    "legend", "li", "main", "menu", "nav", "ol", "optgroup", "option", "p", "pre", "search", "section", "select", "summary", "svg", "table",
    "tbody", "td", "tfoot", "th", "thead", "tr", "ul", "canvas", "object", "audio", "video", "math",
}
_CLOSES_P = _BLOCK - {"button", "caption", "option", "optgroup", "select", "svg", "object", "canvas", "audio", "video", "math", "body", "html", "head"}
_SIBLING = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPE = {"ul", "ol", "dl", "table", "select", "menu"}
#: Elements whose text is never content; a <header> is, only within an article.
_NEVER = {
    "nav", "footer", "aside", "form", "head", "button", "select", "dialog", "menu", "svg", "canvas", "object", "audio", "video", "search", "fieldset",
}
#: Words of class, id or role that mark a container of such text.
_MARKS = {
    "ad", "ads", "adbox", "adslot", "advert", "adverts", "advertisement", "advertising", "banner", "sponsor", "sponsored", "promo", "promotion",
    "cookie", "cookies", "consent", "gdpr", "notice", "notices", "popup", "modal", "overlay", "newsletter", "subscribe", "subscription", "signup",
    "login", "sidebar", "sidebars", "aside", "rail", "widget", "widgets", "menu", "menus", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs",
    "toolbar", "masthead", "topbar", "footer", "comment", "comments", "disqus", "replies", "respond", "share", "sharing", "social", "related",
    "recommended", "pagination", "pager", "search", "form", "complementary", "contentinfo", "alert", "skip",
}
_MARKS_OUTSIDE = {"header"}
_OPENS = re.compile(r"<(?:!--|[!?]|(/?)([A-Za-z][^\s/>]*))")
_STOP = re.compile(r"""["'>]""")
#: A neighbour that shares so much of both pages' text, outside containers that are never content, is a copy.
COPY = 0.9
#: Largest table of line pairs, in bits, that is aligned at once; larger ones are halved first.
ALIGNED = 1 << 26
_ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_WORD = re.compile(r"[a-z0-9]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


@dataclass
class Line:
    """One block of text; main: inside an article; never: inside a container that isn't content."""

    text: str
    main: bool
    never: bool


def _marked(attributes: str, in_main: bool) -> bool:
    if not attributes or ("=" not in attributes and "hidden" not in attributes.lower()):
        return False
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), a or b or c
        if name == "hidden" or name == "aria-hidden":
            if name == "hidden" or value.lower() == "true":
                return True
            continue
        words = set(_WORD.findall(_CAMEL.sub(" ", value).lower()))
        if words & _MARKS or (not in_main and words & _MARKS_OUTSIDE):
            return True
    return False


@cache
def _closing(name: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I)


def page_lines(source: str) -> list[Line]:
    """The text blocks of a page in order, white space collapsed, character references decoded.

    Markup may be broken: unclosed paragraphs, items and cells end where HTML has them end, a close
    tag closes what it names if that is open, and an unfinished comment, tag or raw element ends the
    page. A quote that nothing closes is read past. Time is linear in the page's length.
    """
    lines: list[Line] = []
    stack: list[tuple[str, bool, bool]] = []
    open_: Counter[str] = Counter()
    main = never = False
    parts: list[str] = []

    def flush():
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            parts.clear()
            if text:
                lines.append(Line(text, main, never))

    def pop(n):
        nonlocal main, never
        for gone, _, _ in stack[n:]:
            open_[gone] -= 1
        del stack[n:]
        main, never = (stack[-1][1], stack[-1][2]) if stack else (False, False)

    at, size, unclosed, last = 0, len(source), set(), source.rfind(">")
    while at < size:
        found = _OPENS.search(source, at)
        if not found:
            parts.append(source[at:])
            break
        if found.start() > at:
            parts.append(source[at : found.start()])
        name, close = (found.group(2) or "").lower(), found.group(1)
        if not name:
            comment = found.group() == "<!--"
            end = source.find("-->" if comment else ">", found.end())
            at = size if end < 0 else end + (3 if comment else 1)
            continue
        at = found.end()
        while at <= last:  # to the > that is in no quoted value; a quote that never closes quotes nothing
            stop = _STOP.search(source, at)
            at = stop.end()
            if stop.group() == ">":
                break
            if stop.group() not in unclosed:
                end = source.find(stop.group(), at)
                if end < 0:
                    unclosed.add(stop.group())
                else:
                    at = end + 1
        else:
            break  # the page ends inside a tag
        attributes = source[found.end() : at - 1]
        if name in _RAW and not close:
            end = _closing(name).search(source, at)
            at = source.find(">", end.end()) + 1 if end and end.end() <= last else size
            flush()
            continue
        if name == "br":
            parts.append(" ")
            continue
        if name not in _BLOCK:
            continue
        flush()
        if close:
            if open_[name]:
                pop(next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name))
            continue
        if name in _VOID:
            continue
        if name in _CLOSES_P and stack and stack[-1][0] == "p":
            pop(len(stack) - 1)
        if any(open_[x] for x in _SIBLING.get(name, ())):
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in _SIBLING[name]:
                    pop(i)
                elif stack[i][0] in _SCOPE:
                    break
        inner_main = main or (name in ("article", "main") and not never)
        bad = name in _NEVER or (name == "header" and not main)
        bad = bad or (name not in ("html", "body", "main") and _marked(attributes, main or name == "article"))
        stack.append((name, inner_main and not bad, never or bad))
        open_[name] += 1
        main, never = stack[-1][1], stack[-1][2]
    flush()
    return lines


def _rows(a: list[str], b: list[str]):
    """The bit-parallel table of longest common subsequences: after each line of a, bit j is unset where b[j] adds one."""
    places: dict[str, int] = {}
    for j, line in enumerate(b):
        places[line] = places.get(line, 0) | 1 << j
    row = full = (1 << len(b)) - 1
    for line in a:
        hit = row & places.get(line, 0)
        row = ((row + hit) | (row - hit)) & full
        yield row


def _lengths(a: list[str], b: list[str]) -> np.ndarray:
    """Length of the longest common subsequence of a with each beginning of b."""
    row = (1 << len(b)) - 1
    for row in _rows(a, b):  # noqa: B007
        pass
    unset = np.unpackbits(np.frombuffer(row.to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(b)] == 0
    return np.concatenate([[0], np.cumsum(unset)])


def shared_lines(a: list[str], b: list[str]) -> list[int]:
    """Indices of lines of a on a longest common subsequence with b, by divide and conquer beyond ALIGNED."""
    known = set(b)
    own = [i for i, line in enumerate(a) if line in known]  # no other line can be shared
    known = set(a)
    return [own[i] for i in _aligned([a[i] for i in own], [line for line in b if line in known])]


def _aligned(a: list[str], b: list[str]) -> list[int]:
    if len(a) > 1 and len(a) * len(b) > ALIGNED:
        half = len(a) // 2
        cut = int((_lengths(a[:half], b) + _lengths(a[half:][::-1], b[::-1])[::-1]).argmax())
        return _aligned(a[:half], b[:cut]) + [half + i for i in _aligned(a[half:], b[cut:])]
    rows, out, i, j = list(_rows(a, b)), [], len(a), len(b)
    while i and j:
        if rows[i - 1] >> (j - 1) & 1:
            j -= 1
        else:
            i -= 1
            if not i or rows[i - 1] >> (j - 1) & 1:
                out.append(i)
                j -= 1
    return out[::-1]


def _common(a: str, b: str) -> int:
    n = min(len(a), len(b))
    return next((i for i in range(n) if a[i] != b[i]), n)


def main_text(lines: list[Line], neighbours: list[list[Line]]) -> tuple[str, int]:
    """The page's main text and how many of its lines a neighbour shares, nearest neighbour first."""
    texts = [x.text for x in lines]
    shared: set[int] = set()
    own = lambda page: sum(len(x.text) for x in page if not x.never)
    size = own(lines)
    for other in neighbours:
        found = shared_lines(texts, [x.text for x in other])
        if sum(len(texts[i]) for i in found if not lines[i].never) < COPY * max(size, own(other)):
            shared = set(found)
            break
    if any(x.main and not x.never for x in lines):
        kept = [x.text for x in lines if x.main and not x.never]
    else:
        kept = [x.text for i, x in enumerate(lines) if not x.never and i not in shared]
    return "\n".join(kept), len(shared)


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_lines, n_shared) of each page.

    n_lines: text blocks of the whole page; n_shared: how many of them its nearest page shares.
    Null and empty pages have an empty text. Pages without a host are neighbours of one another.
    Repeated rows give repeated rows, neighbours of one another; null ids and urls stay null.
    """
    source = only(pages, page_id=(id_col, "bigint"), url=(url_col, "string"), html=(html_col, "string"))
    rest = F.substring_index("url", "://", -1)
    cut = F.when(F.instr("url", "://") > 0, F.regexp_extract(rest, r"^[^?#]*", 0)).otherwise("")
    host, path = F.coalesce(F.lower(F.substring_index(cut, "/", 1)), F.lit("")), F.coalesce(cut, F.lit(""))
    # the sort is one of binary strings, as Python's of bytes is; pages equal in all of it are equal rows
    key = F.concat_ws("\0", host, path, F.lpad(F.hex(F.col("page_id").bitwiseXOR(F.lit(-(2**63)))), 16, "0"), F.lpad(F.hex(F.xxhash64("html")), 16, "0"), F.coalesce("url", F.lit("")))
    keyed = source.withColumn("key", key.cast("binary"))
    parts = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = _ranges(keyed, parts)
    known = sent(pages.sparkSession, ranges)

    def dealt(batches):
        """Pages with their range; the first and last page of a range once more, as context of the one beside it."""
        first, last = received(known)
        before, after = {k: i for i, k in enumerate(first[1:])}, {k: i + 1 for i, k in enumerate(last[:-1])}
        for batch in batches:
            keys = batch.column(3).to_pylist()
            span = np.array([max(0, bisect_right(first, k) - 1) for k in keys], np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(span), pa.array(np.zeros(len(keys), bool))], names)
            for beside in (before, after):
                edge = [i for i, k in enumerate(keys) if k in beside]
                if edge:
                    copies = batch.take(pa.array(edge, pa.int64()))
                    yield pa.RecordBatch.from_arrays([*copies.columns, pa.array([beside[keys[i]] for i in edge], pa.int32()), pa.array(np.ones(len(edge), bool))], names)

    def run(batches):
        def rows():
            for batch in batches:
                for first, last, data, ends in slices(batch.column(2)):
                    data, begin = data.tobytes(), 0
                    ids, urls, span, context = (batch.column(i).slice(first, last - first).to_pylist() for i in (0, 1, 4, 5))
                    for i, url, s, c, end in zip(ids, urls, span, context, ends.tolist(), strict=True):
                        text = data[begin:end].decode("utf-8", "replace")
                        begin = end
                        yield i, url, split_url(url), page_lines(text), s, c

        def done(before, page, after):
            near = [x for x in (before, after) if x and x[4] == page[4] and x[2][0] == page[2][0]]
            near.sort(key=lambda x: -_common(x[2][1], page[2][1]))
            return (*page[:2], *main_text(page[3], [x[3] for x in near]), len(page[3]))

        def results():
            before = page = None
            for after in rows():
                if page and not page[5]:
                    yield done(before, page, after)
                before, page = page, after
            if page and not page[5]:
                yield done(before, page, None)

        held, size = [], 0
        for r in results():
            held.append(r)
            size += len(r[2])
            if len(held) >= 1000 or size >= 4 << 20:
                yield _batch(held)
                held, size = [], 0
        if held:
            yield _batch(held)

    names = ["page_id", "url", "html", "key", "span", "context"]
    ranged = keyed.mapInArrow(dealt, "page_id bigint, url string, html string, key binary, span int, context boolean")
    ranged = ranged.repartitionById(parts, "span").sortWithinPartitions("span", "key", "context").select(*names)
    return ranged.mapInArrow(run, "page_id bigint, url string, text string, n_lines bigint, n_shared bigint")


def _ranges(keyed: DataFrame, parts: int) -> tuple[list[bytes], list[bytes]]:
    """First and last key of each range of the sort, as many as partitions: a sort of the distinct keys alone."""
    keys = staged(keyed.select("key").distinct().repartitionByRange(parts, "key").withColumn("range", F.spark_partition_id()), "page-keys")
    found = sorted((bytes(r["first"]), bytes(r["last"])) for r in keys.groupBy("range").agg(F.min("key").alias("first"), F.max("key").alias("last")).collect())
    dropped(keys)
    return [a for a, _ in found], [b for _, b in found]


def _batch(rows) -> pa.RecordBatch:
    ids, urls, texts, shared, n = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays(
        [pa.array(ids, pa.int64()), pa.array(urls, pa.string()), pa.array(texts, pa.string()), pa.array(np.array(n, np.int64)), pa.array(np.array(shared, np.int64))],
        ["page_id", "url", "text", "n_lines", "n_shared"],
    )
