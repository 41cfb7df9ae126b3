"""Main text of web pages by tag-path ratios.

A page becomes blocks of text, each with the path of block elements from the root to
it. For each path, text length and punctuation are summed over its blocks and divided
by their number; the two ratios and the share of text outside links are multiplied, the
product is smoothed over neighbouring blocks, and blocks under a multiple of the spread
are set aside. The element that holds the rest is the article; all of it that is no
boilerplate is kept, in page order. On pages without an article tag, blocks of links
whose path is low in the whole page are boilerplate too.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from dataclasses import dataclass
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basewise.llm.common import map_batches

#: Spread of the smoothing, in blocks, and the share of the scores' standard deviation that a block must reach.
SMOOTH, THRESHOLD = 1.0, 0.5

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
#: Elements whose text is never part of an article.
_SKIPPED = frozenset(
    "script style noscript template head title nav footer aside form button select option textarea datalist iframe object embed applet svg canvas audio video map dialog menu math".split()
)
#: Words of class, id or role that mark boilerplate, and those that mark content and outweigh them.
_BOILERPLATE = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments commentlist disqus discussion replies cookie cookies consent gdpr "
    "footer foot menu nav navbar navigation newsletter notice notification alert popup modal overlay promo promotion related recommended recommendations share sharing "
    "sidebar social sponsor sponsored subscribe subscription toolbar pager pagination copyright masthead header login signup search skip widget widgets "
    "banner contentinfo complementary dialog form respond hidden".split()
)
_CONTENT = frozenset("article content main post entry story text body articlebody".split())
_ENDS_ITEM = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
_HOLDERS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}}
#: Elements that hold a part of an article, never the whole beside headings and lists.
_PARTS = frozenset("p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd pre blockquote table figure".split())
_NO_HINT = frozenset(("html", "body", "article", "main"))
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_PUNCTUATION = re.compile(r"[.,;:!?…。，！？、؟।]")


@dataclass
class Block:
    """Text of one block, the element and the path it lies in."""

    text: str
    element: int
    path: int
    linked: int


class _Page(HTMLParser):
    """Splits a page into blocks; closes what HTML lets authors leave open."""

    def __init__(self, hints: bool) -> None:
        super().__init__(convert_charrefs=True)
        self.hints = hints
        self.tags, self.parents, self.paths = ["#root"], [0], [0]
        self.known = {}
        # Open elements: (tag, element number, skipped).
        self.stack = [("#root", 0, False)]
        self.open = Counter()
        self.blocks: list[Block] = []
        self.parts: list[str] = []
        self.linked, self.home = 0, 0

    def _flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            self.blocks.append(Block(text, self.home, self.paths[self.home], min(self.linked, len(text))))
        self.parts, self.linked = [], 0

    def _marked(self, tag: str, attrs: list) -> bool:
        """Whether attributes say that the element is boilerplate or not shown."""
        given = {k: v or "" for k, v in attrs}
        if tag in ("html", "body"):
            return False
        if "hidden" in given or given.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", given.get("style", "")):
            return True
        if not self.hints or tag in _NO_HINT:
            return False
        words = {w.lower() for k in ("class", "id", "role") for w in _WORD.findall(given.get(k, ""))}
        return bool(words & _BOILERPLATE) and not words & _CONTENT

    def updatepos(self, i: int, j: int) -> int:
        """Line numbers are not needed."""
        return j

    def _pop(self, tag: str, holders: frozenset | set = frozenset()) -> None:
        """Closes the innermost open ``tag`` and all in it, if none of ``holders`` lies between."""
        if not self.open[tag]:
            return
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i][0] == tag:
                if any(t not in _INLINE for t, _, _ in self.stack[i:]):
                    self._flush()
                for t, _, _ in self.stack[i:]:
                    self.open[t] -= 1
                del self.stack[i:]
                self.home = next(e for t, e, _ in reversed(self.stack) if t not in _INLINE)
                return
            if self.stack[i][0] in holders:
                return

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "br":
            self._text(" ")
        if tag in _VOID:
            if tag == "hr":
                self._pop("p", {"td", "th", "button"})
                self._flush()
            return
        block = tag not in _INLINE
        if block:
            self._pop("p", {"td", "th", "button"})
            for other in _ENDS_ITEM.get(tag, ()):
                self._pop(other, _HOLDERS[tag] - {other})
            self._flush()
        elif tag == "a":
            self._pop("a", {"td", "th", "table"})
        skipped = self.stack[-1][2] or tag in _SKIPPED or self._marked(tag, attrs) or (tag == "header" and self.hints and not self.open["article"] and not self.open["main"])
        element, up = len(self.tags), self.stack[-1][1]
        path = self.known.setdefault((self.paths[up], tag), len(self.known) + 1) if block else self.paths[up]
        self.tags.append(tag)
        self.parents.append(up)
        self.paths.append(path)
        self.stack.append((tag, element, skipped))
        self.open[tag] += 1
        if block:
            self.home = element

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        # HTML takes <div/> for <div>.
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag == "br":
            self._text(" ")
        elif tag == "p" and not self.open["p"]:
            self._flush()
        else:
            self._pop(tag)

    def handle_data(self, data: str) -> None:
        self._text(data)

    def _text(self, data: str) -> None:
        if not self.stack[-1][2]:
            self.parts.append(data)
            if self.open["a"]:
                self.linked += len(data)

    def finish(self, html: str) -> list[Block]:
        self.feed(html)
        self.close()
        self._flush()
        return self.blocks


def path_ratios(blocks: list[Block]) -> np.ndarray:
    """The fused ratios of each block's path."""
    sums = defaultdict(lambda: np.zeros(4))
    for b in blocks:
        sums[b.path] += (1, len(b.text), len(_PUNCTUATION.findall(b.text)), b.linked)
    fused = {}
    for path, (n, length, marks, linked) in sums.items():
        fused[path] = (length / n) * (1 + marks / n) * (1 - linked / length)
    return np.array([fused[b.path] for b in blocks])


def path_scores(raw: np.ndarray) -> np.ndarray:
    """Each block's score: the ratios smoothed over neighbours."""
    reach = int(3 * SMOOTH)
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / SMOOTH) ** 2)
    weight = np.convolve(np.ones(len(raw)), kernel)[reach:reach + len(raw)]
    smooth = np.convolve(raw, kernel)[reach:reach + len(raw)] / weight
    # A path that is all links stays at nothing, whatever stands beside it.
    return np.where(raw > 0, smooth, 0.0)


def _article(page: _Page, blocks: list[Block], chosen: np.ndarray) -> tuple[int, bool]:
    """The element of the article and whether its tag says so."""
    weight = np.zeros(len(page.tags))
    for b, take in zip(blocks, chosen):
        if take:
            weight[b.element] += len(b.text)
    for e in range(len(weight) - 1, 0, -1):
        weight[page.parents[e]] += weight[e]
    for tag in ("article", "main"):
        named = [e for e, t in enumerate(page.tags) if t == tag]
        if named and max(weight[e] for e in named) >= 0.4 * weight[0]:
            return max(named, key=lambda e: (weight[e], -e)), True
    # The deepest element with nearly all of the chosen text.
    best = 0
    for e in range(1, len(weight)):
        if page.parents[e] == best and page.tags[e] not in _PARTS and weight[e] >= 0.9 * weight[0]:
            best = e
    return best, False


def extract(html: str | None) -> str:
    """The main text of a page: blocks joined by line feeds, white space in a block as one space.

    Null, empty and text-free pages give an empty text. Should boilerplate words mark
    the whole page, they are not used.
    """
    if not html:
        return ""
    for hints in (True, False):
        page = _Page(hints)
        blocks = page.finish(html)
        if blocks:
            break
    else:
        return ""
    ratios = path_ratios(blocks)
    scores = path_scores(ratios)
    chosen = scores >= THRESHOLD * scores.std()
    if scores.max() == 0:
        chosen[:] = True
    element, named = _article(page, blocks, chosen)
    inside = np.zeros(len(page.tags), dtype=bool)
    inside[element] = True
    for e, up in enumerate(page.parents[element + 1:], element + 1):
        inside[e] = inside[up]
    own = np.array([inside[b.element] for b in blocks])
    if not named:
        # Without a tag that says so, links go whose path is low in the page; a low path alone (lists, tables, last words) stays.
        low = ratios < THRESHOLD * scores.std()
        own &= ~(low & np.array([b.linked >= 0.8 * len(b.text) for b in blocks]))
    return "\n".join(b.text for b, keep in zip(blocks, own) if keep)


def extract_table(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``id, url, text, n_chars`` of each page, repeated rows included; null html counts as empty.

    An empty table gives no rows; other columns are never read.
    """
    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{url_col}`").alias("url"), F.col(f"`{html_col}`").cast("string").alias("html"))
    schema = T.StructType([rows.schema["id"], rows.schema["url"], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [extract(h) for h in batch.column("html").to_pylist()]
        return pa.RecordBatch.from_arrays(
            [batch.column("id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["id", "url", "text", "n_chars"]
        )

    return map_batches(rows, run, schema)
