"""Main text of web pages by line-block distribution.

Markup is stripped to *lines* (the text of one block element each).  Sliding windows over
consecutive lines sum their text lengths, link text left out; the text surges where a window rises
above a threshold and dives where the windows fall below it again; the stretch between surge and
dive with the most text is the article.  Stretches are one where only paragraphs, list items, cells
and headings lie between them, or where both sides lie in the same element.  Short paragraphs of
the same element that follow or precede a stretch belong to it, and so does a heading whose byline
and date are too short to surge; short lines of other elements at its ends do not.

What the markup says outright comes first.  Lines in menus, page headers, footers, sidebars, notices,
adverts, forms, scripts and styles are taken out beforehand, so they do not interrupt an article,
and so are reader comments.  Where only the name of an element says so, the name has to be about
the element (``with-sidebar``, ``no-comments`` and ``share-enabled`` are not), and an element that
also has other names and holds most of the page's text stays, reader comments excepted.  Lines inside
``article`` or ``main`` weigh at least a window's threshold, so a short heading or paragraph there
does not end the stretch, and where such elements hold most of the text that surges the lines
outside them weigh nothing.  Where they hold less (teaser cards) they are lines like any other.

Defined cases: a null or empty page gives an empty text; unclosed, overlapping and unknown tags
are tolerated (a block element ends the line before it); a page of one long line is one block;
equal peaks go to the earlier stretch; names of inline elements, headings and the page itself say
nothing; rows that repeat or have a null id give equal results.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPAN = 3  # lines in a window
SURGE = 80  # code points in a window that count as text

# what the elements and their names mean
RAW = {"script", "style", "textarea", "title", "noscript", "template", "svg", "iframe", "noframes", "xmp"}
DROP = {"nav", "footer", "aside", "form", "button", "select", "menu", "dialog", "fieldset", "head", "object", "embed", "canvas", "map", "label", "input", "option", "datalist"}
MAIN = {"article", "main"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
CLOSED_BY_NEXT = {"p", "li", "dt", "dd", "tr", "td", "th", "option"}
TEXT = {"p", "li", "dt", "dd", "td", "th", "blockquote", "pre", "figcaption", "caption", "summary"} | HEADINGS
FLOW = {"ul", "ol", "dl", "table", "thead", "tbody", "tfoot", "tr", "figure", "details", "hr", "br"}  # between a text element and the element it belongs to
# words of class, id and role
ABOUT_COMMENTS = re.compile(r"comments?|commentlist|respond|repl(?:y|ies)|disqus")
ABOUT_UNWANTED = re.compile(
    r"ads?|advert\w*|banner|sponsor\w*|promo\w*|nav\w*|menus?|breadcrumbs?|sidebar|side|aside|footer|foot|masthead|cookies?|consent|gdpr|notices?|popup|modal|overlay"
    r"|newsletter|subscribe|signup|login|search|searchbox|social|share|sharing|related|recommended|recommendations|widgets?|pagination|pager|copyright|legal|disclaimer|toolbar|skip"
)
ABOUT_HEADER = {"site", "page", "main", "global", "top"}  # what a page's header is called besides
NEGATED = {"no", "with", "has", "without", "is", "non", "not"}
CONTAINERS = {
    "area", "articles", "bar", "block", "body", "bottom", "box", "button", "buttons", "col", "column", "container", "content", "form", "holder", "icons", "inner", "item", "items", "label", "left", "link",
    "links", "list", "main", "menu", "news", "outer", "panel", "posts", "primary", "right", "secondary", "section", "slot", "stories", "text", "title", "top", "topics", "unit", "widget", "wrap", "wrapper",
}
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.DOTALL)
NAMED = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
SPACE = re.compile(r"\s+")


class Line(NamedTuple):
    text: str
    plain: int  # code points that are not link text
    inside: bool  # in the main element
    level: int  # of a heading, else 0
    marked: bool  # in an element made for text
    parent: int  # the element it belongs to
    named: frozenset[int]  # elements around it with names that call them unwanted and others that do not


@lru_cache(1 << 14)
def about(token: str) -> str:
    """What a name says of its element: ``comments``, ``unwanted``, ``header`` or nothing."""
    words = [w.lower() for w in WORD.findall(token.split("--")[0])]
    if not words or words[0] in NEGATED:
        return ""
    if words[-1] == "header" and set(words[:-1]) <= ABOUT_HEADER:
        return "header"
    for kind, pattern in (("comments", ABOUT_COMMENTS), ("unwanted", ABOUT_UNWANTED)):
        if pattern.fullmatch(words[-1]) or (pattern.fullmatch(words[0]) and CONTAINERS.issuperset(words[1:])):
            return kind
    return ""


def said(element: str, attributes: str) -> set[str]:
    if element in INLINE or element in HEADINGS or element in ("html", "body"):
        return set()
    given = ((a.lower(), b or c or d) for a, b, c, d in NAMED.findall(attributes))
    return {about(t) for a, names in given if element not in TEXT or a == "class" for t in names.split()}


def lines_of(page: str) -> list[Line]:
    """The lines of a page in order, but for those that the markup puts into unwanted elements or reader comments."""
    out: list[Line] = []
    held: list[tuple[str, bool]] = []
    stack: list[tuple[str, str, int]] = []  # element, what it is, number
    counts = {"drop": 0, "main": 0, "link": 0, "named": 0, "text": 0}
    level = number = at = 0

    def end_line():
        nonlocal level
        if held and not counts["drop"]:
            text = SPACE.sub(" ", html.unescape("".join(t for t, _ in held))).strip()
            if text:
                links = sum(len(SPACE.sub(" ", html.unescape(t)).strip()) for t, linked in held if linked)
                parent = next((k for e, _, k in reversed(stack) if e not in TEXT and e not in INLINE and e not in FLOW), 0)
                named = frozenset(k for _, what, k in stack if what == "named") if counts["named"] else frozenset()
                out.append(Line(text, max(0, len(text) - links), counts["main"] > 0, level, counts["text"] > 0, parent, named))
                level = 0
        held.clear()

    def pop():
        element, what, _ = stack.pop()
        if what:
            counts[what] -= 1
        counts["text"] -= element in TEXT

    n = len(page)
    while at < n:
        m = TAG.search(page, at)
        end = n if m is None else m.start()
        if end > at:
            held.append((page[at:end], counts["link"] > 0))
        if m is None:
            break
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if name not in INLINE:
            end_line()
        if name in HEADINGS:
            level = 0 if m[1] else int(name[1])
        if m[1]:
            if any(name == x[0] for x in stack):
                while stack[-1][0] != name:
                    pop()
                pop()
            continue
        if name in VOID or m[3].endswith("/"):
            continue
        if name in RAW:
            close = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.IGNORECASE).search(page, at)
            at = close.end() if close else n
            continue
        if stack and name in CLOSED_BY_NEXT and stack[-1][0] == name:
            pop()
        names = said(name, m[3]) if m[3] else set()
        if name in DROP or (name == "header" and not counts["main"]) or "comments" in names:
            what = "drop"
        elif name in MAIN:
            what = "main"
        elif "unwanted" in names or ("header" in names and not counts["main"]):
            what = "named" if "" in names else "drop"
        else:
            what = "link" if name == "a" else ""
        number += 1
        stack.append((name, what, number))
        if what:
            counts[what] += 1
        counts["text"] += name in TEXT
    end_line()
    return out


def without_named(lines: list[Line]) -> list[Line]:
    """The lines outside elements called unwanted, unless such an element holds most of the text and no main element lies elsewhere."""
    held: dict[int, int] = {}
    for line in lines:
        for k in line.named:
            held[k] = held.get(k, 0) + line.plain
    whole = sum(line.plain for line in lines)
    gone = {k for k, size in held.items() if 2 * size <= whole or any(line.inside and k not in line.named for line in lines)}
    return [line for line in lines if gone.isdisjoint(line.named)]


def surging(weights: np.ndarray, span: int = SPAN, surge: int = SURGE) -> np.ndarray:
    """Whether each line lies in a window that rises above the threshold."""
    full = np.convolve(weights, np.ones(span), "full") >= surge  # window k holds the lines from k - span + 1 to k
    return np.convolve(full, np.ones(span), "full")[span - 1 : span - 1 + len(weights)] > 0.5


def stretch(weights: np.ndarray, span: int = SPAN, surge: int = SURGE, joins=lambda i, j: False) -> tuple[int, int]:
    """First and last line (exclusive) of the stretch with the most text between a surge and a dive.

    ``joins(i, j)`` says whether the lines from ``i`` to ``j`` (exclusive) between two stretches belong to both.
    """
    n = len(weights)
    if n == 0 or not weights.any():
        return 0, 0
    loud = surging(weights, span, surge)
    if not loud.any():
        loud = surging(weights, span, 1)
    edges = np.flatnonzero(np.diff(np.concatenate([[0], loud, [0]])))
    found: list[tuple[int, int]] = []
    for i, j in zip(edges[::2], edges[1::2]):
        heard = i + np.flatnonzero(weights[i:j])  # a loud window begins and ends with silent lines
        i, j = int(heard[0]), int(heard[-1]) + 1
        if found and joins(found[-1][1], i):
            i = found.pop()[0]
        found.append((i, j))
    return max(found, key=lambda x: (weights[x[0] : x[1]].sum(), -x[0]))


def with_heading(levels: list[int], start: int, span: int = SPAN) -> int:
    """The last heading of the highest level before the surge's first window ends, if it lies before the surge."""
    at = [i for i in range(min(len(levels), start + span)) if levels[i]]
    return min(start, min(at, key=lambda i: (levels[i], -i), default=start))


def settle(lines: list[Line], start: int, end: int, short: float) -> tuple[int, int]:
    """Move the ends of a stretch: off short lines of other elements, on to text of the same elements."""

    def part(i):
        return lines[i].marked or lines[i].level or lines[i].plain >= short

    kin = {lines[i].parent for i in range(start, end) if part(i)}
    while start < end and not part(start) and lines[start].parent not in kin:
        start += 1
    while end > start and not part(end - 1) and lines[end - 1].parent not in kin:
        end -= 1
    while start > 0 and lines[start - 1].parent in kin and lines[start - 1].marked and lines[start - 1].plain:
        start -= 1
    while end < len(lines) and lines[end].parent in kin and lines[end].marked and lines[end].plain:
        end += 1
    return start, end


def main_text(page: str | None, span: int = SPAN, surge: int = SURGE) -> str:
    lines = without_named(lines_of(page or ""))
    if not lines:
        return ""
    inside = np.array([x.inside for x in lines])
    sizes = np.array([len(x.text) for x in lines], float)
    loud = sizes * surging(sizes, span, surge)
    if inside.any() and loud[inside].sum() >= loud[~inside].sum():
        lines = [x for x in lines if x.inside]
        return "\n".join(x.text for x in lines)
    weights = np.array([x.plain for x in lines], float)

    def joins(i, j):
        between = lines[i:j]
        return lines[i - 1].parent == lines[j].parent or all(x.marked and x.plain for x in between)

    a, b = stretch(weights, span, surge, joins)
    if weights[a:b].max(initial=0) * span >= surge:
        a, b = settle(lines, a, b, surge / span)
    a = with_heading([x.level for x in lines], a, span)
    return "\n".join(x.text for x in lines[a:b])


def extract(pages: DataFrame, keep: list[str | Column] = ("page_id", "url"), span: int = SPAN, surge: int = SURGE) -> DataFrame:
    """``pages(html, …)`` with ``text`` and ``n_chars``; ``keep`` names the columns carried along."""
    chosen = pages.select(*keep, F.col("html").alias("__html"))
    names = chosen.columns[:-1]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(p, span, surge) for p in batch.column(len(names)).to_pylist()]
            columns = [batch.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*names, "text", "n_chars"])

    return chosen.mapInArrow(run, f"{schema}, text string, n_chars long")
