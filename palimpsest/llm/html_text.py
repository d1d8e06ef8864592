"""Main text of HTML pages by line-block distribution.

A page is read into lines, one a block element; markup, scripts and styles go, character references are decoded.
Lines inside elements that mean menus, headers, footers, sidebars, notices or forms are gone before anything is summed.
Each other line has the length of its text outside links, or none where it is mostly link text. The lengths are summed
over windows of WINDOW lines (after Chen Xin's line-block distribution): where a sum rises to RISE the text surges, where
one falls to nothing it dives, and what stands between a surge and its dive is kept.

The sums are taken twice. The first time over the whole page: they tell whether its text is in the article or main
elements that it marks, or elsewhere. Where it is in these, the second sums are over their lines alone and any length is
a surge, so that short paragraphs stay; lists of links in them dive, a single link between paragraphs doesn't.

Names (class, id) are hints. A block whose name says advert, comment, promotion and the like (MARKS) has no length; where
that is only part of a longer name, or beside the name of a story, it keeps its length unless it is weak, that is, no
window of its lines reaches RISE. An article element is never an advert by its name, though it may be a comment. Where
nothing would be left, names don't count.

Reading takes time in proportion to the page, whatever its markup: a tag ends at the first > outside quoted values, a quote that
is never closed is a character like others, and open elements are found by their names, not by searching.

Edge cases: null, empty and text-less pages give an empty text; elements that are never closed end with the element
around them, and a boilerplate element that is never closed ends where the article begins; a tag that the end of the
page cuts off goes with all after it; broken references stay as written; repeated pages are extracted alike; columns of
the table with the names of results are replaced.
"""

from __future__ import annotations

import re
from collections import defaultdict
from dataclasses import dataclass, field
from html import unescape

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .frames import map_text

WINDOW, RISE = 3, 60
#: Text in article elements weighs so many times that of runs outside them when it is told which is the page's.
ARTICLE_ODDS = 4

# Elements of HTML by their part in a page.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noscript ol optgroup option p pre section select summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea iframe noembed noframes xmp template svg math object audio video canvas".split())
BOILERPLATE = frozenset("head nav aside footer form menu dialog noscript select button fieldset header".split())
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar toolbar".split())
COMMENTS = frozenset("comment comments commentlist disqus replies reply respond".split())
MARKS = COMMENTS | frozenset("""
ad ads advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs consent cookie
cookies donate footer gdpr header masthead menu modal nav navbar navigation newsletter notice notices notification overlay
pager pagination popup promo promotion recommended related share sharing sidebar signup skip social sponsor
sponsored subscribe subscription teaser toolbar topbar widget widgets
""".split())
FILLERS = frozenset("area block body bottom box buttons center col column container content group inner item items label left link links list main module outer panel posts region right section side slot text title top unit wrap wrapper".split())
MODIFIERS = frozenset("has with without no not is".split())
OWN = frozenset("article post entry story content main title text".split())
_SCOPES = frozenset("div section article main td".split())
_BEFORE_MAIN = BOILERPLATE | frozenset("html body ul li a p b span".split())
_ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_STOP = re.compile(r"[>\"']")
_ATTR = re.compile(r"""([a-zA-Z_:][-\w:.]*)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""")
_SPLIT = re.compile(r"[^a-z0-9]+")


@dataclass
class Line:
    parts: list[str] = field(default_factory=list)
    link_chars: int = 0
    dropped: bool = False
    block: int = 0  # number of the named block around it
    inside: bool = False

    @property
    def text(self) -> str:
        return " ".join("".join(self.parts).split())


@dataclass
class Page:
    lines: list[Line]
    title: str
    links: list[str]
    named: list[int]  # of each block: 0 not named, 1 hinted at, 2 named


def _attributes(source: str) -> dict[str, str]:
    return {k.lower(): unescape(v[1:-1] if v[:1] in "\"'" else v) for k, v in _ATTR.findall(source)} if "=" in source else {}


def _is_boilerplate(tag: str, attrs: dict[str, str], inside: bool) -> bool:
    if tag in BOILERPLATE and not (tag == "header" and inside):
        return True
    return bool(attrs) and ("hidden" in attrs or attrs.get("aria-hidden") == "true" or attrs.get("role", "").lower() in ROLES)


def named(tag: str, attrs: dict[str, str], inside: bool) -> tuple[int, bool]:
    """(0, 1 or 2: how surely the names of an element say that it is no article text, whether they say reader comments)."""
    if tag in ("html", "body", "main"):
        return 0, False
    sure, comments, own = 0, False, False
    for token in f"{attrs.get('class', '')} {attrs.get('id', '')}".lower().split():
        parts = [p for p in _SPLIT.split(token) if p]
        hits = [p for p in parts if p in MARKS]
        own |= bool(parts) and all(p in OWN for p in parts)
        if not hits or parts[0] in MODIFIERS or (hits == ["header"] and (inside or any(p in OWN for p in parts))):
            continue
        whole = parts[-1] in MARKS or all(p in MARKS or p in FILLERS or any(c.isdigit() for c in p) for p in parts)
        sure, comments = max(sure, 1 + whole), comments or (whole and any(p in COMMENTS for p in parts))
    if tag == "article" and not comments:
        return 0, False
    return min(sure, 1) if own and not comments else sure, comments


class _Open:
    """The open elements, with the places of what is looked for among them."""

    def __init__(self):
        self.stack: list[tuple[str, bool, bool, int]] = []  # (tag, is boilerplate, is main, block before it)
        self.places: defaultdict[str, list[int]] = defaultdict(list)  # by tag, and of kinds of tags
        self.later = 0  # elements that don't stand before a page's main text

    def _kinds(self, tag: str, boilerplate: bool) -> list[str]:
        kinds = [tag]
        if tag in BLOCKS:
            kinds.append("a block")
        if tag in _SCOPES:
            kinds.append("a scope")
        if boilerplate and tag in BOILERPLATE:
            kinds.append("a boilerplate")
        return kinds

    def push(self, tag: str, boilerplate: bool, is_main: bool, block: int) -> None:
        for kind in self._kinds(tag, boilerplate):
            self.places[kind].append(len(self.stack))
        self.stack.append((tag, boilerplate, is_main, block))
        self.later += tag not in _BEFORE_MAIN

    def pop(self) -> tuple[str, bool, bool, int]:
        out = self.stack.pop()
        for kind in self._kinds(out[0], out[1]):
            self.places[kind].pop()
        self.later -= out[0] not in _BEFORE_MAIN
        return out

    def last(self, kind: str) -> int:
        return self.places[kind][-1] if self.places.get(kind) else -1


def _tag_end(html: str, at: int, unclosed: set[str]) -> int:
    """Where the > of a tag is whose name ends at `at`; -1 if it has none. unclosed: quotes known to have no end."""
    while m := _STOP.search(html, at):
        if m[0] == ">":
            return m.start()
        at = m.end()
        if m[0] not in unclosed and html[max(0, m.start() - 8) : m.start()].rstrip()[-1:] == "=":
            end = html.find(m[0], at)
            if end < 0:
                unclosed.add(m[0])
            else:
                at = end + 1
    return -1


def read(html: str) -> Page:
    lines, links, title, blocks, elements = [Line()], [], [], [0], _Open()
    dropping = main = link = block = 0
    unclosed: set[str] = set()
    at, n = 0, len(html)

    def text(piece: str) -> None:
        if not piece:
            return
        piece = unescape(piece) if "&" in piece else piece
        if elements.stack and elements.stack[-1][0] == "title":
            title.append(piece)
        lines[-1].parts.append(piece)
        if link:
            lines[-1].link_chars += len(piece.strip())

    def begin() -> None:
        lines.append(Line(dropped=dropping > 0, block=block, inside=main > 0))

    def close(k: int) -> None:
        nonlocal dropping, main, link, block
        while len(elements.stack) > k:
            tag, boilerplate, is_main, block = elements.pop()
            dropping -= boilerplate
            main -= is_main
            link -= tag == "a"

    while at < n:
        start = html.find("<", at)
        if start < 0 or start + 1 >= n:
            text(html[at:])
            break
        sign, ends = html[start + 1], html[start + 1] == "/"
        m = _NAME.match(html, start + 1 + ends)
        if not m and sign not in "!?":
            text(html[at : start + 1])  # a < of the text
            at = start + 1
            continue
        text(html[at:start])
        if not m or sign in "!?":
            opening, closing = next((x for x in (("<!--", "-->"), ("<![CDATA[", "]]>")) if html.startswith(x[0], start)), ("<!", ">"))
            end = html.find(closing, start + len(opening))
            if opening == "<![CDATA[":
                text(html[start + 9 : end if end >= 0 else n])
            at = n if end < 0 else end + len(closing)
            continue
        end = _tag_end(html, m.end(), unclosed)
        if end < 0:
            break  # cut off by the end of the page
        at, tag = end + 1, m[0].lower()
        if ends:
            k = elements.last(tag)
            if k >= 0 and (tag in BLOCKS or elements.last("a scope") <= k):
                close(k)
            if tag in BLOCKS:
                begin()
            continue
        if tag in RAW:
            found = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(html, at)
            at = found.end() if found else n
            continue
        if tag == "br":
            text(" ")
            continue
        attrs = _attributes(html[m.end() : end])
        if tag == "a" and attrs.get("href"):
            links.append(attrs["href"])
        if tag in VOID:
            if tag in BLOCKS:
                begin()
            continue
        is_main = tag in ("article", "main") or (bool(attrs) and (attrs.get("role", "").lower() == "main" or attrs.get("itemprop", "").lower() == "articlebody"))
        if tag == "body" or (is_main and not _is_boilerplate(tag, attrs, False) and elements.stack and not elements.later):
            if elements.places.get("a boilerplate"):  # never closed before the body or article
                close(elements.places["a boilerplate"][0])
        if tag in BLOCKS:  # a block ends an open paragraph, a list item or cell the one before
            k = elements.last("a block")
            if k >= 0 and elements.stack[k][0] in _ENDS.get(tag, ()) + ("p", "title"):
                close(k)
        boilerplate = _is_boilerplate(tag, attrs, main > 0)
        sure, comments = named(tag, attrs, main > 0) if attrs else (0, False)
        is_main = is_main and not boilerplate and not dropping and not comments and not (block and blocks[block] > 2)
        elements.push(tag, boilerplate, is_main, block)
        if is_main:
            block = 0  # names around an article don't tell of it
        elif sure and not (block and blocks[block] > 1):
            blocks.append(sure + comments)
            block = len(blocks) - 1
        dropping += boilerplate
        main += is_main
        link += tag == "a"
        if tag in BLOCKS or boilerplate:
            begin()
    return Page(lines, " ".join("".join(title).split()), links, [min(b, 2) for b in blocks])


def window_sums(lengths: np.ndarray) -> np.ndarray:
    """The sum of each window of WINDOW lines, from the one that ends with the first line to the one that starts with the last."""
    return np.convolve(lengths, np.ones(WINDOW, int))


def runs(lengths: np.ndarray, rise: int) -> np.ndarray:
    """Whether each line stands between a surge and its dive: no window over it is empty, and one near it reaches `rise`.

    Windows that stick out at an end don't count as empty unless they hold all lines there are.
    """
    n = len(lengths)
    if not n or not lengths.any():
        return np.zeros(n, bool)
    sums = window_sums(lengths)
    whole = sums[WINDOW - 1 : n] if n >= WINDOW else np.full(1, lengths.sum())
    empty = np.zeros(n + 1, int)  # marks of lines under an empty window
    for i in np.flatnonzero(whole == 0):
        empty[i] += 1
        empty[min(n, i + WINDOW)] -= 1
    on = (np.cumsum(empty)[:n] == 0) | (lengths > 0)
    edge = np.flatnonzero(np.diff(np.concatenate(([0], on.astype(int), [0]))))
    out = np.zeros(n, bool)
    for i, j in zip(edge[::2], edge[1::2]):
        out[i:j] = window_sums(lengths[i:j]).max() >= rise
    return out


def _lengths(texts: list[str], lines: list[Line]) -> np.ndarray:
    return np.array([0 if line.link_chars > 0.6 * len(t) else len(t) - line.link_chars for t, line in zip(texts, lines)], int)


def main_lines(page: Page, names: bool = True) -> list[str]:
    own = [(t, line) for line in page.lines if not line.dropped and (t := line.text)]
    if names and len(page.named) > 1:
        block = np.array([line.block for _, line in own], int)
        lengths = _lengths([t for t, _ in own], [line for _, line in own])
        order = np.argsort(block, kind="stable")
        first = np.searchsorted(block[order], np.arange(len(page.named) + 1))
        gone = {b for b in range(1, len(page.named)) if page.named[b] > 1 or (first[b + 1] > first[b] and window_sums(lengths[order[first[b] : first[b + 1]]]).max() < RISE)}
        own = [x for x in own if x[1].block not in gone]
    texts, lines = [t for t, _ in own], [line for _, line in own]
    lengths, inside = _lengths(texts, lines), np.array([line.inside for line in lines], bool)
    kept = runs(lengths, RISE) & (lengths > 0)
    size = np.array([len(t) for t in texts], int)
    if size[inside].sum() and ARTICLE_ODDS * size[inside].sum() >= lengths[kept & ~inside].sum():
        at = np.flatnonzero(inside)
        kept = np.zeros(len(own), bool)
        kept[at] = runs(lengths[at], 1) if lengths[at].any() else True
    elif not kept.any():
        kept = lengths > 0
    out = [texts[k] for k in np.flatnonzero(kept)]
    return out if out or not names or len(page.named) == 1 else main_lines(page, False)


def extract(html: str) -> str:
    return " ".join(main_lines(read(html)))


def plain_text(page: Page) -> str:
    """All text of the page, boilerplate included, a line a block."""
    return "\n".join(t for line in page.lines if (t := line.text))


def extract_text(pages: DataFrame, html_col: str = "html", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` of pages (default: all), text and n_chars."""

    def make():
        def work(offsets, data):
            raw = data.tobytes()
            texts = [extract(raw[a:b].decode("utf-8", "replace")) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            return {"text": texts, "n_chars": [len(t) for t in texts]}

        return work

    return map_text(pages, html_col, [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())], make, keep=keep)
