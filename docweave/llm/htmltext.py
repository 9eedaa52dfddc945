"""Main text of web pages by their line-block distribution.

Markup is stripped in one linear scan; block elements and line breaks part the page into lines. A line's
length is its text outside links, and 0 where most of it is links. Where a page marks its article, all outside
has length 0 too, and so have elements that are no article by their kind or role (menus, footers, sidebars, forms).
The lengths are summed over windows of ``WINDOW`` lines, on every page. A surge is where the sum leaves 0, a
dive where it returns there; all lines between the first and the last text of such a stretch are kept if its highest
window reaches a quarter of the usual line of the main stretch, the one with the most text.

Blocks whose class or id names a notice, an advert or comments are left out; inside a marked article they only weigh
a quarter, and stay if their windows still reach a quarter of the page's highest. An unnamed block that lies between
lines of text and is no list of links can't be told from them by lengths and stays.

Null and empty pages have an empty text; cut-off and badly nested ones are read as far as they go.
"""

from __future__ import annotations

import html
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from docweave.llm.store import alone

WINDOW = 3
SHARE = 0.25
WEIGHT = 0.25  # of lines in blocks with a telling name, inside the article
_NAMED_SO, _NEVER = 1, -1

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style title textarea xmp iframe noembed noframes noscript template svg math".split())
_BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th "
    "thead title tr ul".split()
)
_BOILERPLATE = frozenset("aside button dialog footer form head header menu nav select".split())
_NAMES = frozenset(
    "ad ads advert advertisement adverts advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disclaimer "
    "footer header menu modal nav navbar navigation newsletter notice notification popup promo promoted related reply share sharing "
    "sidebar social sponsor sponsored subscribe toolbar widget".split()
)
_ROLES = frozenset("banner complementary contentinfo dialog form menu menubar navigation search".split())
_CLOSES_P = _BLOCK - {"br", "body", "html", "head", "title", "option", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "legend", "summary"}
_SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
_LISTS = frozenset("ul ol menu dl table tbody thead tfoot select".split())

_NAME = re.compile(r"[A-Za-z][^\s/>]*")
_REST = re.compile(r"""[^>"']*+(?:"[^"]*+"[^>"']*+|'[^']*+'[^>"']*+)*+>""")
_NAMED = re.compile(r"""(?:^|[\s"'])(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_PARTS = re.compile(r"[A-Za-z]+")


def _boilerplate(name: str, attributes: str, inside: bool) -> int:
    if name in _BOILERPLATE and not (inside and name == "header"):  # an article's own header has its title
        return _NEVER
    if name in ("article", "main", "body", "html") or not attributes:
        return 0
    found = 0
    for key, value in _NAMED.findall(attributes):
        value = value.strip("\"'").lower()
        if key.lower() == "role":
            if value in _ROLES:
                return _NEVER
        elif any(p in _NAMES for p in _PARTS.findall(value)):
            found = _NAMED_SO
    return found


def lines(page: str) -> tuple[list[tuple[str, int, int, bool]], bool]:
    """Each line's text, the number of the named block it is in (0: none, -1: an element that is no article), the part of its length in links, and
    whether it is inside the article; and whether the page marks one."""
    out: list[tuple[str, int, int, bool]] = []
    parts: list[str] = []
    linked = 0
    stack: list[tuple[str, int, bool]] = []  # open elements; the named block that text in them is in, and whether it is a link
    blocks = 0
    inside = marked = False
    at, n = 0, len(page)

    def end_line() -> None:
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append((text, stack[-1][1] if stack else 0, linked, inside))
            parts.clear()
        linked = 0

    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            parts.append(page[at:])
            break
        if lt > at:
            parts.append(page[at:lt])
            if stack and stack[-1][2]:
                linked += lt - at
        if page.startswith("<!--", lt):
            close = page.find("-->", lt + 4)
            at = n if close < 0 else close + 3
            continue
        after = page[lt + 1 : lt + 2]
        if after in ("!", "?"):
            close = page.find(">", lt)
            at = n if close < 0 else close + 1
            continue
        closing = after == "/"
        name_match = _NAME.match(page, lt + 1 + closing)
        if not name_match:
            parts.append("<")  # a bare sign
            at = lt + 1
            continue
        name = name_match[0].lower()
        rest = _REST.match(page, name_match.end())
        close = rest.end() if rest else page.find(">", lt) + 1
        if close <= 0:
            break  # the page ends within a tag
        attributes = page[name_match.end() : close - 1]
        at = close
        if closing:
            if name in _BLOCK:
                end_line()
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    del stack[k:]
                    break
                if name not in _BLOCK and stack[k][0] in _BLOCK:
                    break  # an inline end tag closes nothing beyond its block
            inside = any(x[0] in ("article", "main") for x in stack)
            continue
        if name in _BLOCK:
            end_line()
        if name in _RAW:
            end = re.compile(rf"</{name}(?=[\s/>])", re.I).search(page, at)
            close = page.find(">", end.end()) if end else -1
            at = n if close < 0 else close + 1
            continue
        if name in _VOID or attributes.endswith("/"):
            continue
        if name in _CLOSES_P and stack:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == "p":
                    del stack[k:]
                    break
                if stack[k][0] in _BLOCK:
                    break
        for k in range(len(stack) - 1, -1, -1) if name in _SAME else ():
            if stack[k][0] in _SAME[name]:
                del stack[k:]
                break
            if stack[k][0] in _LISTS:
                break
        skip = stack[-1][1] if stack else 0
        own = _boilerplate(name, attributes, inside) if skip != _NEVER else 0
        if own == _NEVER:
            skip = _NEVER
        elif own and not skip:
            skip = blocks = blocks + 1
        stack.append((name, skip, name == "a" or bool(stack) and stack[-1][2]))
        if name in ("article", "main") and not skip:
            inside = marked = True
    end_line()
    return out, marked


def _sums(lengths: np.ndarray) -> np.ndarray:
    """Of each line and those before it in its window."""
    return np.convolve(lengths, np.ones(WINDOW))[: len(lengths)]


def _runs(mask: np.ndarray) -> list[tuple[int, int]]:
    edge = np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8))
    return list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()))


def between(lengths: np.ndarray) -> np.ndarray:
    """Which lines lie between the first and the last text of stretches from surge to dive that are high enough."""
    keep = np.zeros(len(lengths), bool)
    if not lengths.any():
        return keep
    sums = _sums(lengths)
    stretches = _runs(sums > 0)
    a, b = max(stretches, key=lambda x: lengths[x[0] : x[1]].sum())
    usual = np.median(lengths[a:b][lengths[a:b] > 0])
    for a, b in stretches:
        if sums[a:b].max() >= SHARE * usual:
            keep[a : a + int(np.flatnonzero(lengths[a:b])[-1]) + 1] = True
    return keep


def main_text(page: str | None) -> str:
    found, marked = lines(page or "")
    if not found:
        return ""
    skip = np.array([x[1] for x in found])
    size = np.array([len(x[0]) for x in found])
    linked = np.array([x[2] for x in found])
    inside = np.array([x[3] for x in found]) if marked else np.ones(len(found), bool)
    free = np.where(size > 2 * linked, size - linked, 0)
    plain = inside & (skip == 0)
    if marked and not free[plain].any():
        free = size  # an article of nothing but links
    lengths = np.where(plain, free, 0)
    keep = between(lengths) & plain
    if marked:
        top = SHARE * _sums(lengths).max()
        named = np.flatnonzero(inside & (skip > 0))
        named = named[np.argsort(skip[named], kind="stable")]
        for at in np.split(named, np.flatnonzero(np.diff(skip[named])) + 1) if len(named) else ():
            if (most := (WEIGHT * _sums(free[at])).max()) > 0 and most >= top:
                keep[at] = True
    return "\n".join(f[0] for f, k in zip(found, keep.tolist()) if k)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text (blocks in page order, one to a line), n_chars."""

    def run(batches):
        for batch in batches:
            text = [main_text(x) for x in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    pages = alone(pages, "page_id", "url", "html")
    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
