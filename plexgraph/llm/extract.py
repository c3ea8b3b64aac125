"""Main text of web pages by tag-path ratios.

A page is cut into blocks at block-level tags, and a block into pieces of text. The path of a piece names all open elements
from the root to it, by tag and classes. Per path, characters outside links and punctuation marks are summed and divided
by the number of pieces (two ratios). Both are smoothed over the pieces in page order, multiplied, and weighed by a prior
(below); the mean of that is the value of the path. A block is chosen if the values of its pieces' paths, weighed by length,
reach the spread (standard deviation) of all pieces of the page. This is so on every page, whatever its elements are called.

Chosen blocks span regions: the elements, again by path, that hold them as paragraphs, items or cells; inside an article
or main element, that element. What else stands in a region belongs to the article too, such as its headings and short
lines, unless it is furniture or mostly links; so do headings right before a region.

Prior knowledge, all of it: text in ``nav``, ``footer``, ``form`` and the like, by tag, role or being hidden, is never read.
A class or id with a word of ``_WORDS`` multiplies the prior by ``_SUSPECT``, an article or main element by ``_ARTICLE``. As
only differences within a page count, a suspect word on an element around everything changes nothing.
"""

from __future__ import annotations

import html
import re
from collections import Counter, defaultdict
from collections.abc import Container, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plexgraph.llm.common import bounded_batches

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|noscript|template|textarea|title|iframe|svg|math|select|object|canvas|video|audio|head)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|</?[a-zA-Z!?][^>]*(?:>|\Z)",
    re.S | re.I,
)
#: Without an end tag, these reach to the end of the page; others of the kind are then empty.
_TO_THE_END = frozenset("script style noscript template textarea title iframe".split())
_ATTR = re.compile(r"([a-zA-Z-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_BLOCK = frozenset(
    "html body main article section div header footer nav aside form fieldset address blockquote p pre h1 h2 h3 h4 h5 h6 ul ol li dl dt dd "
    "table caption thead tbody tfoot tr td th figure figcaption details summary dialog menu hgroup center hr button search".split()
)
_VOID = frozenset("br hr img input meta link area base col embed source track wbr".split())
_FURNITURE = frozenset("nav footer aside form button menu dialog search fieldset".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar status".split())
_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adbox adsense banner sponsor sponsored promo promotion nav navbar navigation menu menus breadcrumb breadcrumbs "
    "sidebar sidebars side rail widget widgets footer header masthead topbar toolbar comment comments commentlist disqus respond reply replies responses cookie cookies consent gdpr "
    "notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations "
    "pagination pager skip hidden copyright legal disclaimer".split()
)
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Tags that end open elements of the second set, up to an element of the third.
_CLOSES = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr", "td", "th"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
}
_PUNCTUATION = re.compile(r"[.,;:!?…、。，！？；：]")


#: Factors of the prior: for each element with a suspect class or id around a text, and for an article or main element.
_SUSPECT, _ARTICLE = 1e-3, 8.0
#: Elements that are parts of what holds them: paragraphs, items, cells. A region is the element around them.
_PARTS = frozenset("p pre h1 h2 h3 h4 h5 h6 blockquote ul ol li dl dt dd table caption thead tbody tfoot tr td th figure figcaption".split())
_KERNEL = np.array([1.0, 2.0, 4.0, 2.0, 1.0])


class Paths:
    """Numbers of root-to-leaf paths; a path is its parent's number and a label, and comes after its parent. 0 is the root."""

    def __init__(self) -> None:
        self.parent, self.tag, self._known = [0], [""], {}

    def below(self, parent: int, tag: str, label: str) -> int:
        at = self._known.setdefault((parent, label), len(self.parent))
        if at == len(self.parent):
            self.parent.append(parent)
            self.tag.append(tag)
        return at


@dataclass
class Open:
    """An open block-level element."""

    tag: str
    path: int
    suspects: int  # elements with a suspect word, itself included
    off: bool  # whether it is in furniture
    article: int  # path of the innermost article, else main, element; 0 if there is none


@dataclass
class Block:
    text: str
    pieces: list[tuple[int, int, int]]  # path, characters outside links, punctuation marks
    path: int  # of the element around it
    tag: str
    suspects: int
    article: int
    linked: int  # characters inside links

    @property
    def prior(self) -> float:
        return _SUSPECT**self.suspects * (_ARTICLE if self.article else 1.0)


def _label(tag: str, attrs: str) -> str:
    """A tag with its classes, without digits, as paragraphs may be numbered by class."""
    if "class" not in attrs.lower():
        return tag
    found = next(((a or b or c) for name, a, b, c in _ATTR.findall(attrs) if name.lower() == "class"), "")
    return ".".join([tag, *sorted(re.sub(r"[0-9/]+", "", found.lower()).split())])


def _judged(tag: str, attrs: str, in_article: bool) -> tuple[bool, bool]:
    """Whether an element is furniture, and whether its class or id is suspect."""
    if tag in _FURNITURE or tag == "header" and not in_article:
        return True, False
    suspect = False
    if not attrs or tag in ("html", "body", "main"):
        return False, False
    for name, a, b, c in _ATTR.findall(attrs):
        name, value = name.lower(), (a or b or c).lower()
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return True, False
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True, False
        if name == "role" and value in _ROLES:
            return True, False
        if name in ("class", "id") and not _WORDS.isdisjoint(re.split(r"[^a-z0-9]+", value)):
            suspect = True
    return False, suspect


def blocks(page: str) -> tuple[list[Block], Paths]:
    """The page's text blocks in order, without furniture, and the paths they name."""
    out, paths = [], Paths()
    stack: list[Open] = [Open("", 0, 0, False, 0)]
    inline: list[str] = []
    parts: list[str] = []
    pieces: list[tuple[int, int, int]] = []
    linked, in_link, at = 0, False, 0

    def flush() -> None:
        nonlocal linked
        if parts:
            top, text = stack[-1], " ".join("".join(parts).split())
            if text and not top.off:
                out.append(Block(text, pieces.copy(), top.path, top.tag, top.suspects, top.article, min(linked, len(text))))
            parts.clear()
            pieces.clear()
        inline.clear()
        linked = 0

    def add(piece: str) -> None:
        nonlocal linked
        if not piece:
            return
        piece = html.unescape(piece)
        parts.append(piece)
        bare = piece.strip()
        if bare and not stack[-1].off:
            path = stack[-1].path
            for t in inline:
                path = paths.below(path, t, t)
            if in_link:
                linked += len(bare)
                pieces.append((path, 0, 0))
            else:
                pieces.append((path, len(bare), len(_PUNCTUATION.findall(bare))))

    while (m := _TOKEN.search(page, at)) is not None:
        add(page[at : m.start()])
        at = m.end()
        if (raw := m["raw"]) is not None:
            if m.group().endswith("/>") and raw.lower() not in _TO_THE_END:
                continue
            close = re.compile(rf"</{raw}\s*>", re.I).search(page, at)
            if raw.lower() == "head":
                # A head without its end tag stops where the body starts.
                close = close or re.compile(r"(?=<body\b)", re.I).search(page, at)
                at = close.end() if close else at
            else:
                at = close.end() if close else len(page) if raw.lower() in _TO_THE_END else at
            parts.append(" ")
            continue
        tag, attrs = (m["tag"] or "").lower(), m["attrs"] or ""
        if not tag:
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag not in _BLOCK:
            if tag == "a":
                in_link = not m["end"]
            if tag in _VOID or attrs.rstrip().endswith("/"):
                continue
            if m["end"]:
                if tag in inline:
                    del inline[len(inline) - 1 - inline[::-1].index(tag) :]
                continue
            if attrs and tag != "a" and any(_judged(tag, attrs, True)):
                # Inline furniture, such as a hidden span: skip to its end if that comes before the next block ends.
                close = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
                if close and not re.search(r"</(?:p|div|article|section|body|li|td)\b", page[at : close.start()], re.I):
                    at = close.end()
                    continue
            inline.append(tag)
            continue
        flush()
        if tag in _VOID:
            continue
        if m["end"]:
            in_link = False
            k = next((k for k in range(len(stack) - 1, 0, -1) if stack[k].tag == tag), None)
            if k is not None:
                del stack[k:]
            continue
        if stack[-1].tag == "p":
            stack.pop()
        elif tag in _CLOSES:
            ends, until = _CLOSES[tag]
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in until:
                    break
                if stack[k].tag in ends:
                    del stack[k:]
                    break
        top = stack[-1]
        off, suspect = _judged(tag, attrs, bool(top.article))
        path = paths.below(top.path, tag, _label(tag, attrs))
        article = path if tag == "article" or tag == "main" and paths.tag[top.article] != "article" else top.article
        stack.append(Open(tag, path, top.suspects + suspect, top.off or off, article))
    add(page[at:])
    flush()
    return out, paths


def _smoothed(x: np.ndarray) -> np.ndarray:
    """Weighted means with two neighbours on each side, as far as there are any."""
    lead = len(_KERNEL) // 2
    return np.convolve(x, _KERNEL)[lead : lead + len(x)] / np.convolve(np.ones(len(x)), _KERNEL)[lead : lead + len(x)]


def fused(text: np.ndarray, punctuation: np.ndarray) -> np.ndarray:
    """One value for each piece, from the two ratios of its path, in page order."""
    return _smoothed(text) * _smoothed(punctuation)


def path_values(found: list[Block]) -> tuple[dict[int, float], float]:
    """Value of each path, and the bound that content reaches."""
    pieces = [(path, chars, marks, b.prior) for b in found for path, chars, marks in b.pieces]
    if not pieces:
        return {}, 0.0
    length, marked, count = defaultdict(int), defaultdict(int), defaultdict(int)
    for path, chars, marks, _ in pieces:
        length[path] += chars
        marked[path] += marks
        count[path] += 1
    text = np.array([length[p] / count[p] for p, *_ in pieces])
    punctuation = np.array([(marked[p] + 0.1) / count[p] for p, *_ in pieces])
    values = fused(text, punctuation) * np.array([w for *_, w in pieces])
    total = defaultdict(float)
    for (path, *_), v in zip(pieces, values):
        total[path] += v
    means = {p: total[p] / count[p] for p in total}
    return means, min(float(np.std(values)), max(means.values()))


def chosen(found: list[Block]) -> list[bool]:
    """For each block, whether the paths of its pieces are content."""
    means, bound = path_values(found)
    out = []
    for b in found:
        weight = sum(chars for _, chars, _ in b.pieces)
        out.append(weight > 0 and sum(means[p] * chars for p, chars, _ in b.pieces) / weight >= bound * (1 - 1e-9))
    return out


def _region(b: Block, paths: Paths, several: Container[int]) -> int:
    """Path of the element that holds a chosen block as one of its parts; ``several`` are paths with more than one block."""
    if b.article:
        return b.article
    path = paths.parent[b.path] if b.path in several else b.path
    while path and paths.tag[path] in _PARTS:
        path = paths.parent[path]
    return path


def article(found: list[Block], paths: Paths) -> list[Block]:
    """The blocks of the article, in page order."""
    content = chosen(found)
    several = {p for p, n in Counter(b.path for b in found).items() if n > 1}
    regions: dict[int, int] = {}  # path -> suspect elements around its chosen blocks
    for b, c in zip(found, content):
        if c:
            r = _region(b, paths, several)
            regions[r] = min(regions.get(r, b.suspects), b.suspects)
    least: list[int] = []  # by path: fewest suspect elements of the regions it stands in, -1 outside
    for at, parent in enumerate(paths.parent):
        above, own = least[parent] if at else -1, regions.get(at, -1)
        least.append(min(above, own) if min(above, own) >= 0 else max(above, own))
    keep = [c or b.suspects <= least[b.path] and 2 * b.linked < len(b.text) for b, c in zip(found, content)]
    for k in range(len(found) - 1, 0, -1):
        before = found[k - 1]
        if keep[k] and before.tag in _HEADINGS and before.suspects <= found[k].suspects and 2 * before.linked < len(before.text):
            keep[k - 1] = True
    return [b for b, k in zip(found, keep) if k]


def main_text(page: str | None) -> str:
    """The article's blocks, one to a line; empty for a null, empty or textless page."""
    return "\n".join(b.text for b in article(*blocks(page or "")))


def _texts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = [main_text(h) for h in b.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row (page_id, url, text, n_chars) for each row of ``pages``.

    A null or empty page has an empty text. White space in a block, no-break spaces among it, becomes one space, character
    references are decoded, blocks are joined by a line feed. Repeated rows give repeated rows, an empty table an empty result; other columns
    are not read.
    """
    bounded_batches(pages.sparkSession)
    slim = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return slim.mapInArrow(_texts, "page_id long, url string, text string, n_chars long")
