"""Main-content extraction by tag-path ratios.

Every text node of a page has a path, the tags from the root to it. Over the
nodes of one path, the ratio of text is their mean length and the ratio of
punctuation their mean number of punctuation marks: article text is long and
punctuated, navigation and captions are neither. Both ratios, laid out in
document order, are smoothed with a Gaussian so that a short paragraph among
long ones rises with them, and fused by their geometric mean; a path's score is
the mean over its nodes, and paths that reach THRESHOLD standard deviations
of the nodes' fused values are content. If none does, the best path is.

Defined results:
* a null page gives a null text; a page without any text node gives ''; both
  give one row, as every row does, repeated rows and null ids too;
* ill-formed markup never fails: unknown end tags are skipped, open elements are
  closed by their parents, a lone ``<`` is text, so is a tag without any ``>``
  after it, and comments, scripts, styles and templates that don't end run to the
  end of the page; once quotes keep a tag open to the end of the page, quotes
  have no meaning from that tag on;
* nesting of any depth and pages of any length are handled in one pass, whose
  time is proportional to the page whatever the markup;
* equal scores are selected alike.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tabsift.llm.common import col, key_type

THRESHOLD, RADIUS, SIGMA = 0.8, 2, 1.0
_NAME, _STOP = re.compile(r"[a-zA-Z][^\s/>]*"), re.compile("""[>"']""")
_NUMBER = re.compile(r"&#[0-9]{9,};?")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style template noscript iframe svg textarea title".split())
_INLINE = frozenset("b i em strong u s a span font small big sub sup mark code tt abbr cite q br wbr".split())
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_BLOCKS = frozenset("p div ul ol li dl table form h1 h2 h3 h4 h5 h6 section article aside nav header footer main pre blockquote hr figure".split())
_PUNCT = re.compile(r"""[.,;:!?…。，；：！？、'"“”‘’«»()\-]""")
_SPACE = re.compile(r"\s+")


class Tags:
    """The tags of a page, one after the other; no part of a page is looked at more than a few times."""

    def __init__(self, page: str) -> None:
        self.page, self.size = page, len(page)
        self.quoted = True
        self.last = {q: page.rfind(q) for q in "\"'>"}

    def next(self, at: int) -> tuple[int, int, str | None, bool] | None:
        """(begin, end, name or None if it isn't an element's, whether it ends one) of the first tag from ``at`` on."""
        page, size = self.page, self.size
        while True:
            begin = page.find("<", at)
            if begin < 0:
                return None
            if page.startswith("<!--", begin):
                end = page.find("-->", begin + 4)
                return begin, size if end < 0 else end + 3, None, False
            if page.startswith(("<!", "<?"), begin):
                return begin, size if begin > self.last[">"] else page.find(">", begin) + 1, None, False
            if begin > self.last[">"]:
                return None
            closing = page.startswith("</", begin)
            name = _NAME.match(page, begin + 1 + closing)
            if name:
                return begin, self._end(name.end()), name[0].lower(), closing
            at = begin + 1

    def _end(self, start: int) -> int:
        at = start
        while self.quoted:
            stop = _STOP.search(self.page, at)
            if stop and stop[0] == ">":
                return stop.end()
            if stop is None or stop.start() == self.last[stop[0]]:
                self.quoted = False
            else:
                at = self.page.find(stop[0], stop.end()) + 1
        return self.page.find(">", start) + 1


def text_nodes(page: str) -> tuple[list[int], list[str], list[bool]]:
    """(path number, text, whether a block boundary precedes it) of a page's text nodes in order."""
    ids: dict[tuple[int, str], int] = {}
    # of each open element: its name, its path, and the nearest from it on that isn't inline, or neither that nor a paragraph
    stack: list[tuple[str, int, int, int]] = [("", 0, 0, 0)]
    open_count: dict[str, int] = {}
    paths, texts, breaks = [], [], []
    at, size, broken = 0, len(page), True
    tags = Tags(page)

    def pop() -> None:
        open_count[stack.pop()[0]] -= 1

    def add(raw: str) -> None:
        nonlocal broken
        t = _SPACE.sub(" ", html.unescape(_NUMBER.sub("\ufffd", raw)) if "&" in raw else raw).strip()
        if t:
            paths.append(stack[-1][1])
            texts.append(t)
            breaks.append(broken)
            broken = False

    while at < size:
        found = tags.next(at)
        if found is None:
            add(page[at:])
            break
        begin, end, tag, closing = found
        if begin > at:
            add(page[at:begin])
        at = end
        if tag is None:
            continue
        if tag not in _INLINE or tag == "br":
            broken = True
        if closing:
            if open_count.get(tag):
                while stack[-1][0] != tag:
                    pop()
                pop()
            continue
        if tag in _VOID:
            continue
        if tag in _RAW:
            close = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = close.end() if close else size
            continue
        if tag in _BLOCKS and open_count.get("p"):
            k = stack[-1][2]
            if stack[k][0] == "p":
                while len(stack) > k:
                    pop()
        closes = _CLOSES.get(tag)
        if closes:
            k = stack[-1][3]
            if stack[k][0] in closes:
                while len(stack) > k:
                    pop()
        key, k, above = (stack[-1][1], tag), len(stack), stack[-1]
        stack.append((tag, ids.setdefault(key, len(ids) + 1), above[2] if tag in _INLINE else k, above[3] if tag in _INLINE or tag == "p" else k))
        open_count[tag] = open_count.get(tag, 0) + 1
    return paths, texts, breaks


_KERNEL = np.exp(-(np.arange(-RADIUS, RADIUS + 1) ** 2) / (2 * SIGMA**2))
_KERNEL /= _KERNEL.sum()


def _smooth(x: np.ndarray) -> np.ndarray:
    return np.convolve(np.pad(x, RADIUS, mode="edge"), _KERNEL, mode="valid")


def content(paths: list[int], texts: list[str]) -> np.ndarray:
    """Which text nodes are content."""
    _, path = np.unique(np.array(paths, np.int64), return_inverse=True)
    size = np.array([len(t) for t in texts], float)
    marks = np.array([len(_PUNCT.findall(t)) for t in texts], float)
    number = np.bincount(path)
    fused = np.sqrt(_smooth((np.bincount(path, size) / number)[path]) * _smooth((np.bincount(path, marks) / number)[path]))
    score = np.bincount(path, fused) / number
    limit = THRESHOLD * fused.std()
    good = score >= limit if limit > 0 else score >= score.max()
    if not good.any():
        good = score >= score.max()
    return good[path]


def extract(page: str | None) -> tuple[str | None, int, int]:
    """(content text, text nodes, content nodes) of one page; nodes of one block are joined by spaces, blocks by line feeds."""
    if page is None:
        return None, 0, 0
    paths, texts, breaks = text_nodes(page)
    if not texts:
        return "", 0, 0
    keep = content(paths, texts)
    out, pending = [], False
    for t, k, b in zip(texts, keep, breaks):
        pending |= b
        if k:
            if out:
                out.append("\n" if pending else " ")
            out.append(t)
            pending = False
    return "".join(out), len(texts), int(keep.sum())


def extract_pages(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(page_id, text, n_nodes, n_kept) of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [extract(x.as_py()) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.int32()), pa.array([g[2] for g in got], pa.int32())], ["page_id", "text", "n_nodes", "n_kept"])

    picked = pages.select(col(id_col).alias("page_id"), col(html_col).cast("string").alias("html"))
    return picked.mapInArrow(run, f"page_id {key_type(picked, 'page_id')}, text string, n_nodes int, n_kept int")
