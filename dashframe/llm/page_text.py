"""Main text of web pages by line-block distribution (operator 12).

Markup is stripped and every block becomes a line.  The page is then a row of
line lengths; their sums over sliding windows of ``WINDOW`` lines surge where
running text begins and dive to nothing where it ends.  The text between a
surge and its dive is kept:

* containers of no content (menus, page headers and footers, sidebars, notices,
  adverts, forms, reader comments, hidden parts), known by their element or the
  words of their class, id and role, are stripped with the markup;
* a line weighs the characters of its text outside links, and nothing if it is
  mostly links; lines of no weight are never part of the text;
* a border of a container (``div``, ``section``, table cells ...) is an empty
  line, so that a window reaches zero where several containers end together;
* a window surges when it exceeds ``SURGE`` characters, or the page's largest
  window where that is less; the region reaches back to the last window that
  was zero and ahead to the next one;
* of several regions those that hold at least ``SHARE`` of the largest are kept;
* where the page marks its content with ``article`` (or else ``main``), lines
  outside weigh nothing, no border within is an empty line and links weigh as
  text, so that a region runs from the first to the last line of the content.

Every page is read whole and by itself: pages are not shuffled, and a task
holds one slice of a batch.

Defined cases: NULL or empty html, and pages without any text outside the
containers above, give an empty text and 0 characters; a page without markup is
one block; markup that is cut off or never closed counts as far as it goes, an
element left open ends with its parent; character references are decoded as
HTML5 does, one without a semicolon too; repeated rows and rows without an id
keep a row each; an empty table gives an empty result; other columns are not
read.
"""

from __future__ import annotations

import html as _html
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dashframe.llm.common import ship_package, slices, with_schema

WINDOW = 3
SURGE = 86
SHARE = 0.25
_LINKS = 0.5          # a line with more of its characters in links is a menu line

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|noscript|template|svg|textarea|select|iframe|object|canvas|title|button)"
    r"\b(?:[^\"'<>]++|\"[^\"]*\"|'[^']*')*+>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-z][^\s/<>]*)(?P<attrs>(?:[^\"'<>]++|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(?P<end2>/?)(?P<name2>[a-z][^\s/<>]*)(?P<attrs2>[^<>]*)>"
    r"|<[!?][^>]*(?:>|\Z)",
    re.S | re.I)
_ATTRIBUTE = re.compile(r"\b(class|id|role|style|hidden|aria-hidden)\b(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?",
                        re.I)
_NEVER_SHOWN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

# Elements that stand within a line.
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q "
                    "rp rt ruby s samp small span strike strong sub sup time tt u var wbr label".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BORDERS = frozenset("article aside body blockquote center dialog div fieldset footer form header main menu "
                     "nav section table tbody td tfoot th thead tr ul ol dl".split())
_NO_CONTENT = frozenset("nav aside footer form dialog menu head fieldset".split())
# Words of class, id and role that name such a container, alone or as one part of a hyphenated name.
_NO_CONTENT_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner "
    "nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager toc "
    "header masthead topbar footer contentinfo colophon copyright "
    "sidebar aside complementary widget widgets related recommended trending "
    "notice notices cookie cookies consent gdpr alert popup modal overlay dialog "
    "comment comments reply replies respond discussion disqus "
    "form search login signup subscribe subscription newsletter "
    "share sharing social follow skip".split())
_ALWAYS = frozenset("comment comments reply replies respond discussion disqus ad ads advert adverts "
                    "advertisement sidebar nav navigation menu cookie cookies notice".split())
_CLOSED_BY_NEXT = frozenset("li dt dd option tr td th".split())
_STATES = frozenset("has with without no is not js".split())


def _named(attrs: str) -> tuple[bool, bool]:
    """(the attributes name a container of no content, one that no article mends)"""
    drop = always = False
    for m in _ATTRIBUTE.finditer(attrs):
        name, value = m[1].lower(), (m[2] or "").strip("\"'")
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            drop = always = True
        elif name == "style":
            if _NEVER_SHOWN.search(value):
                drop = always = True
        elif name in ("class", "id", "role"):
            for word in value.lower().split():
                parts = re.split(r"[-_]+", word)
                if parts[0] in _STATES:
                    continue
                if not _NO_CONTENT_WORDS.isdisjoint(parts):
                    drop = True
                    always = always or not _ALWAYS.isdisjoint(parts)
    return drop, always


def lines(page: str) -> list[tuple[str, int, bool, int]]:
    """The page's lines: text, characters in links, of no content, content (0
    outside, 1 in ``main``, 2 in ``article``).  An empty text is a border."""
    out: list[tuple[str, int, bool, int]] = []
    stack: list[tuple[str, bool, bool, int]] = []     # name, of no content, never mended, content
    pieces: list[str] = []
    linked = 0
    in_link = 0
    hidden = ""          # the inline element of no content that the text stands in
    drop = always = False
    content = 0

    def flush():
        nonlocal linked, hidden
        hidden = ""
        text = " ".join(_html.unescape("".join(pieces)).split()) if pieces else ""
        if text:
            out.append((text, min(linked, len(text)), drop, content))
        pieces.clear()
        linked = 0

    def border():
        out.append(("", 0, drop, content))

    def state():
        nonlocal drop, always, content
        _, drop, always, content = stack[-1] if stack else ("", False, False, 0)

    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at and not hidden:
            piece = page[at:m.start()]
            pieces.append(piece)
            if in_link:
                linked += len("".join(_html.unescape(piece).split()))
        at = m.end()
        name = (m["name"] or m["name2"] or "").lower()
        if not name:
            continue
        closes = bool(m["end"] or m["end2"])
        if name == "a":
            in_link = 0 if closes else 1
        attrs = "" if closes else m["attrs"] or m["attrs2"] or ""
        if name in _INLINE:
            if closes:
                hidden = "" if hidden == name else hidden
            elif not hidden and attrs and name not in _VOID and _named(attrs)[1]:
                hidden = name
            continue
        flush()
        if not closes:
            if name not in ("p", "li", "br", "h1", "h2", "h3", "h4", "h5", "h6"):
                in_link = 0
            while stack and (stack[-1][0] == "p" or (stack[-1][0] == name and name in _CLOSED_BY_NEXT)):
                stack.pop()
            state()
            if name in _VOID or attrs.rstrip().endswith("/"):
                continue
            if name == "body":
                while stack and stack[-1][0] != "html":
                    stack.pop()
                stack.append((name, False, False, 0))
                state()
                continue
            named, fixed = _named(attrs) if attrs else (False, False)
            if name in ("article", "main") and not fixed and not always:
                stack.append((name, named and name != "main", False,
                              max(content, 2 if name == "article" else 1)))
            elif name not in ("p", "li", "html", "dd", "dt", "option") or named:
                bad = drop or named or name in _NO_CONTENT or (name == "header" and not content)
                stack.append((name, bad, always or fixed or (name in _NO_CONTENT and name != "form"), content))
            state()
            if name in _BORDERS:
                border()
        else:
            if name in _BORDERS:
                border()
            if any(s[0] == name for s in reversed(stack)):
                while stack.pop()[0] != name:
                    pass
                state()
    rest = page[at:]
    cut = re.search(r"<[a-z/!?][^<>]*\Z", rest, re.I)      # a tag that is cut off
    if rest:
        pieces.append(rest[:cut.start()] if cut else rest)
    flush()
    return out


def weights(page_lines: list[tuple[str, int, bool, int]]) -> np.ndarray:
    """Characters of every line that count, and -1 for lines that are stripped
    with their markup: those of no content, and borders within the content."""
    inside = max((c for text, _, drop, c in page_lines if text and not drop), default=0)
    w = np.empty(len(page_lines), np.int64)
    for i, (text, linked, drop, content) in enumerate(page_lines):
        if inside:
            w[i] = -1 if drop or (not text and content >= inside) else 0 if content < inside else len(text)
        else:
            w[i] = -1 if drop else 0 if linked > _LINKS * len(text) else len(text) - linked
    return w


def regions(w: np.ndarray, window: int = WINDOW, surge: int = SURGE,
            share: float = SHARE) -> list[tuple[int, int]]:
    """(first, end) of the stretches of lines between a surge and its dive."""
    n = len(w)
    if not n or not w.any():
        return []
    upto = np.concatenate([[0], np.cumsum(np.concatenate([w, np.zeros(window, np.int64)]))])
    sums = upto[window:window + n] - upto[:n]          # of line i and those after it
    live = np.concatenate([[False], sums > 0, [False]])
    starts, ends = np.flatnonzero(~live[:-1] & live[1:]), np.flatnonzero(live[:-1] & ~live[1:])
    least = min(surge, int(sums.max()) - 1)
    found = [(a, b, int(w[a:b].sum())) for a, b in zip(starts, ends) if sums[a:b].max() > least]
    most = max(t for _, _, t in found)
    return [(int(a), int(b)) for a, b, t in found if t >= share * most]


def main_text(page: str | None) -> str:
    if not page:
        return ""
    page_lines = lines(page)
    w = weights(page_lines)
    counted = np.flatnonzero(w >= 0)
    kept = [page_lines[i] for i in counted]
    w = w[counted]
    return " ".join(kept[i][0] for a, b in regions(w) for i in range(a, b) if w[i] > 0)


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every row of ``pages``."""
    ship_package(pages.sparkSession)
    schema = "page_id long, url string, text string, n_chars long"
    arrow = pa.schema([("page_id", pa.int64()), ("url", pa.string()),
                       ("text", pa.string()), ("n_chars", pa.int64())])

    def run(batches):
        for b in slices(batches, "html"):
            texts = [main_text(h) for h in b.column("html").to_pylist()]
            yield with_schema({"page_id": b.column("page_id"), "url": b.column("url"), "text": texts,
                               "n_chars": [len(t) for t in texts]}, arrow)

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(run, schema)
