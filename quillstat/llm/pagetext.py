"""Main text of web pages by the distribution of text over line blocks."""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PAGE_TEXTS = "page_id long, url string, text string, n_chars long"

#: Lines of a window; so many empty lines in a row end a run of text.
WINDOW = 3
#: On pages that don't mark their main part, text surges where a window holds this share of the fullest window, or this many characters.
SURGE_SHARE, SURGE_CHARS = 0.15, 120

# Markup, by the rules of the HTML tokenizer: a quote counts only as the start of an attribute's value, and what is never closed runs to the end.
_REST = r"(?:[^>=]|=\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z))?+)*+(?:>|\Z)"
_MARKUP = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))"
    r"|<(?P<raw>script|style|noscript|textarea|iframe|title)(?=[\s/>])" + _REST + r".*?(?:</(?P=raw)(?=[\s/>])[^>]*+(?:>|\Z)|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-z][^\s/>]*+)(?P<rest>" + _REST + r")"
    r"|<(?:[!?]|/(?![a-z]))[^>]*+(?:>|\Z)",
    re.I | re.S,
)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")

#: Elements that hold others; an end tag closes all that were opened inside.
_HOLDERS = frozenset(
    "html head body div section article main nav header footer aside form fieldset dialog menu ul ol dl table thead tbody tfoot figure details blockquote center button"
    " template object svg math canvas audio video select".split())
#: Elements that start a line of their own. ``br`` and table cells are white space inside one.
_LINES = _HOLDERS | frozenset("p h1 h2 h3 h4 h5 h6 li dt dd tr caption figcaption pre address hr summary legend hgroup".split())
_SPACES = frozenset("br td th wbr img input".split())
_ASIDE = frozenset("head nav footer aside form menu dialog button fieldset template object svg math canvas audio video select".split())
_MAIN = frozenset(["article", "main"])
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert status menu menubar toolbar".split())
#: First part of class and id names of what surrounds an article.
_NAMES = re.compile(
    r"(?:ad|ads|adv|advert\w*|adsense|sponsor\w*|promo\w*|banner\w*|cookie\w*|consent|gdpr|notices?|notification\w*|alert\w*|warning|popup|modal|overlay|newsletter|subscribe\w*"
    r"|sign-?up|login|nav|navbar|navigation|menus?|breadcrumbs?|sidebar\w*|side-?bar|widgets?|masthead|top-?bar|site-?header|page-?header|site-?footer|page-?footer|footer|copyright"
    r"|disclaimer|shar(?:e|ing)|social|related|recommend\w*|teasers?|comments?|commentlist|reader-?comments|user-?comments|repl(?:y|ies)|respond|disqus\w*|pagination|pager|toolbar|skip|search\w*)(?:[-_].*)?",
    re.I,
)


def _surrounds(tag: str, rest: str, in_main: bool) -> bool:
    """Whether an element is no part of the main text by its name, role, class or id, or is hidden."""
    if tag in _ASIDE or (tag == "header" and not in_main):
        return True
    if len(rest) < 8:
        return False
    for name, *values in _ATTRIBUTE.findall(rest):
        name, value = name.lower(), next((v for v in values if v), "")
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and re.search(r"display\s*:\s*none", value, re.I)):
            return True
        if name == "role" and value.lower() in _ROLES:
            return True
        if name in ("class", "id") and tag not in ("html", "body", "main") and any(_NAMES.fullmatch(v) for v in value.split()):
            return True
    return False


def text_lines(page: str) -> tuple[list[str], list[int], bool]:
    """Lines of a page without its markup, and the characters of each that speak for main text.

    Every block of text is a line, and each element that opens or closes between two blocks leaves an empty one. Parts that surround the main text by
    their name leave ``WINDOW`` empty lines, their text weighs nothing. Text of links weighs nothing either, but in a part that the page marks as its
    main one (the third value tells whether there is such a part); then all other text weighs nothing.
    """
    lines: list[str] = []
    weights: list[int] = []
    marked: list[bool] = []
    open_: list[tuple[str, bool, bool]] = []  # tag, aside, main
    text: list[str] = []
    linked, links = 0, False
    count: Counter[str] = Counter()
    aside = main = 0  # open elements of either kind

    def close_line() -> None:
        nonlocal linked
        if text:
            line = "" if aside else " ".join("".join(text).split())
            text.clear()
            if line:
                lines.append(line)
                weights.append(len(line) if main else max(0, len(line) - linked))
                marked.append(bool(main))
        linked = 0

    def gap(n: int) -> None:
        lines.extend([""] * n)
        weights.extend([0] * n)
        marked.extend([False] * n)

    def open_element(tag: str, off: bool) -> None:
        nonlocal aside, main
        open_.append((tag, off, tag in _MAIN))
        count[tag] += 1
        aside, main = aside + off, main + (tag in _MAIN)

    def shut() -> None:
        nonlocal aside, main
        tag, off, of_main = open_.pop()
        count[tag] -= 1
        aside, main = aside - off, main - of_main
        if off and not aside:
            gap(WINDOW)

    at = 0
    for m in [*_MARKUP.finditer(page), None]:
        start = len(page) if m is None else m.start()
        if start > at:
            part = page[at:start]
            text.append(entities.unescape(part) if "&" in part else part)
            linked += len(part) if links else 0
        if m is None:
            break
        at = m.end()
        if m["tag"] is None:
            continue
        tag, end = m["tag"].lower(), bool(m["end"])
        if tag == "a":
            links = not end
        elif tag in _SPACES:
            text.append(" ")
        if tag not in _LINES:
            continue
        close_line()
        links = False
        if open_ and open_[-1][0] == "head" and tag not in _ASIDE:
            shut()  # its end tag may be left out
        if open_ and open_[-1][0] not in _HOLDERS and (open_[-1][0] == tag or open_[-1][0] == "p"):
            shut()
        if end:
            if tag in _HOLDERS:
                gap(1)
                if count[tag]:
                    while open_[-1][0] != tag:
                        shut()
                    shut()
            continue
        off = _surrounds(tag, m["rest"], main > 0)
        if tag in _HOLDERS:
            gap(1)
            if m["rest"].endswith("/>") and tag in ("svg", "math"):
                continue
        elif not off:
            continue
        if off and not aside:
            gap(WINDOW)
        open_element(tag, off)
    close_line()
    found = any(w and k for w, k in zip(weights, marked))
    if found:
        weights = [w if k else 0 for w, k in zip(weights, marked)]
    return lines, weights, found


def surges(weights: list[int], least: float) -> list[tuple[int, int]]:
    """``[start, end)`` of the runs of lines from where a window's sum surges to ``least`` up to where it dives to nothing."""
    w = np.asarray(weights, "int64")
    if not len(w):
        return []
    sums = np.convolve(w, np.ones(WINDOW, "int64"))[WINDOW - 1 :]  # of a line and those after it
    full = np.concatenate([[False], sums > 0, [False]])
    starts, ends = np.flatnonzero(full[1:] & ~full[:-1]), np.flatnonzero(full[:-1] & ~full[1:])
    return [(a, b) for a, b in zip(starts.tolist(), ends.tolist()) if sums[a:b].max() >= least]


def main_text(page: str | None) -> str:
    """Main text of one page: its blocks in order, parted by an empty line."""
    if not page:
        return ""
    lines, weights, found = text_lines(page)
    if not any(weights):
        return ""
    window = np.convolve(weights, np.ones(WINDOW, "int64")).max()
    least = 1 if found else min(SURGE_SHARE * window, SURGE_CHARS)
    out = []
    for a, b in surges(weights, least):
        run = [i for i in range(a, b) if weights[i]]
        # Lines of links alone stay between two lines that speak for main text.
        out += [lines[i] for i in range(run[0], run[-1] + 1) if weights[i] or (lines[i] and not found)]
    return "\n\n".join(out)


def extract_main_text(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every row of ``pages`` (``page_id, url, html``).

    Markup is stripped to lines, the lengths of their texts are summed over sliding windows of ``WINDOW`` lines, and the text between the points where
    the sums surge and where they dive is kept. A null or empty page, and one without main text, has the text '' and 0 characters; repeated rows give a row
    each; an empty table gives none; other columns are left aside. The time for a page is proportional to its length, pages of any length are whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [main_text(h.as_py()) for h in part.column(2)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, PAGE_TEXTS)
