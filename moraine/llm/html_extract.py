"""HTML main text by tag-path ratios.

Every block of text has a root-to-leaf tag path (block elements with their classes). Over a page, the length of text, the
punctuation and the linked text are summed by path; from the sums each path gets a ratio of text per node and one of punctuation per
node, which are fused into one weight, damped by the share of links and by marks of boilerplate on the path (``nav``, ``class="comments"``), raised
below ``article`` and ``main``. The weights, in page order, are smoothed by a Gaussian and compared with a threshold from
their own spread; the blocks above it are the content nodes. The lowest element that holds nearly all of their weight is the
article (or the ``article`` or ``main`` around it), and all its blocks count, short and linked ones as well, but
for marked blocks and menus of links whose path is below the threshold, and weakly marked elements all of whose paths are. Only what is never rendered as text, and forms, is left out beforehand.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TOKENS = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>"']*(?:(?:"[^"]*"|'[^']*')[^>"']*)*)(?:>|\Z)""", re.S)
_ATTRIBUTES = re.compile(r"""(?<![\w-])(class|id|role|hidden|style|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_INVISIBLE = re.compile(r"display\s*:\s*none", re.I)
_PUNCTUATION = ".,;:!?。，；：！？、"

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Text up to the end tag is not markup.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
#: Not text of a page, and forms.
DROPPED = frozenset("script style noscript template form button select option textarea iframe svg canvas object embed head title dialog map audio video input label fieldset xmp noembed noframes".split())
#: Elements and roles that mark boilerplate.
MARKED = frozenset("nav footer aside menu".split())
ROLES = frozenset("navigation banner contentinfo complementary dialog alertdialog alert search form menu menubar toolbar".split())
#: Names (whole ones, or beginnings up to a hyphen or underscore) in class and id that say what an element is.
STRONG = re.compile(r"(?:^|\s)(?:ads?|adverts?|advertisement|sponsored|promo|banner|side-?bar|menu|nav|navbar|navigation|footer|notice|cookies?|consent|gdpr|comments?|commentlist|disqus|breadcrumbs?|newsletter|popup|modal|toolbar|skip-?link|masthead|topbar|outbrain|taboola)(?:$|[\s_-])", re.I)
#: Names that may also be an article's own.
WEAK = re.compile(r"(?:^|[\s_-])(?:share|sharing|social|related|recommended|recommendations|pagination|pager|widget|search|subscribe|signup|login|overlay|tag-?cloud|alert|disclaimer|copyright|replies|reply|respond)(?:$|[\s_-])", re.I)
_HEADER = re.compile(r"(?:^|\s)(?:site-|page-|top-?)?header(?:$|[\s_-])", re.I)
#: Factors of a path's weight.
STRONG_MARK, WEAK_MARK, ARTICLE = 0.002, 0.3, 3.0
#: A start tag of the key ends an open element of the values.
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
#: May hold an article; paragraphs and inline elements don't.
CONTAINERS = frozenset("html body article main section div table td center font blockquote".split())
_SCOPE = frozenset("html body article main section div table ul ol dl td th blockquote nav aside footer header form figure".split())


@dataclass(slots=True)
class Node:
    """An open element: what it passes on to those below it is kept here, so that nothing is looked up along the stack."""

    tag: str
    number: int
    parent: int
    path: int
    factor: float
    dropped: bool
    linked: bool
    article: bool
    block: int
    weak: int


@dataclass
class Page:
    """Elements in order (parent and tag of each), paths, and blocks of text: text, block element, path, linked characters, factor, the element with a weak mark above it (0: none), whether a heading."""

    parents: list[int] = field(default_factory=lambda: [-1])
    tags: list[str] = field(default_factory=lambda: [""])
    texts: list[str] = field(default_factory=list)
    blocks: list[int] = field(default_factory=list)
    paths: list[int] = field(default_factory=list)
    linked: list[int] = field(default_factory=list)
    factors: list[float] = field(default_factory=list)
    weak: list[int] = field(default_factory=list)
    headings: list[bool] = field(default_factory=list)


def _attributes(tag: str, attributes: str, in_article: bool) -> tuple[float, bool, bool, str]:
    """Factor of the element's marks, whether it has a weak one, whether it is invisible, and its class."""
    factor, weak, invisible, name = STRONG_MARK if tag in MARKED or (tag == "header" and not in_article) else 1.0, False, False, ""
    if not attributes:
        return factor, weak, invisible, name
    for key, a, b, c in _ATTRIBUTES.findall(attributes):
        key, value = key.lower(), a or b or c
        if key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and _INVISIBLE.search(value)):
            invisible = True
        elif tag in ("html", "body", "main", "article"):
            continue
        elif key == "role" and value.strip().lower() in ROLES:
            factor = STRONG_MARK
        elif key in ("class", "id"):
            if key == "class":
                name = ".".join(value.split())
            if STRONG.search(value) or (not in_article and _HEADER.search(value)):
                factor = STRONG_MARK
            elif WEAK.search(value):
                weak = True
    return factor, weak, invisible, name


def parse(page: str) -> Page:
    """The page's blocks of text, in page order."""
    out = Page()
    known: dict[tuple[int, str], int] = {}
    stack = [Node("", 0, -1, 0, 1.0, False, False, False, 0, 0)]
    open_: Counter = Counter()
    buffer: list[str] = []
    linked, heading = 0, False
    owner = stack[0]

    def flush() -> None:
        nonlocal linked
        if buffer:
            text = " ".join(html.unescape("".join(buffer)).split())
            if text:
                out.texts.append(text)
                out.blocks.append(owner.block)
                out.paths.append(owner.path)
                out.linked.append(min(linked, len(text)))
                out.factors.append(owner.factor)
                out.weak.append(owner.weak)
                out.headings.append(open_["h1"] > 0 and heading)
            buffer.clear()
        linked = 0

    def add(text: str) -> None:
        nonlocal linked, owner, heading
        top = stack[-1]
        if top.dropped:
            return
        if not buffer:
            owner, heading = top, open_["h1"] > 0
        elif top.factor > owner.factor:
            owner = top  # a block is marked if all of its text is
        buffer.append(text)
        if top.linked:
            linked += len(text.strip())

    def close(depth: int) -> None:
        for node in stack[depth:]:
            open_[node.tag] -= 1
        del stack[depth:]

    at, size = 0, len(page)
    while at < size:
        start = page.find("<", at)
        if start < 0:
            add(page[at:])
            break
        if start > at:
            add(page[at:start])
        found = _TOKENS.match(page, start)
        if not found:
            add("<")
            at = start + 1
            continue
        at = found.end()
        tag = found[2]
        if tag is None:
            continue
        tag = tag.lower()
        block = tag not in INLINE
        if block:
            flush()
        if found[1]:
            if open_[tag] > 0:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag == tag:
                        close(i)
                        break
                    if not block and stack[i].tag in _SCOPE:
                        break
            continue
        if tag in VOID:
            continue
        if block:
            ends = _CLOSES.get(tag, ("p",))
            if any(open_[e] > 0 for e in ends):
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag in ends:
                        close(i)
                        break
                    if stack[i].tag in _SCOPE:
                        break
            if tag == "body" and open_["head"] > 0:
                close(next(i for i, e in enumerate(stack) if e.tag == "head"))
        attributes = found[3] or ""
        if attributes.endswith("/") and tag in ("svg", "path"):
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
            at = end.end() if end else size
            continue
        top = stack[-1]
        factor, weak, invisible, name = _attributes(tag, attributes, top.article)
        article = tag in ("article", "main")
        if article and not top.article:
            factor *= ARTICLE
        number, path, parent = top.block, top.path, top.number
        if block:
            number = len(out.tags)
            out.tags.append(tag)
            out.parents.append(top.block)
            path = known.setdefault((top.path, f"{tag}.{name}" if name else tag), len(known) + 1)
        stack.append(Node(tag, number, parent, path, min(top.factor * factor, ARTICLE), top.dropped or invisible or tag in DROPPED, top.linked or tag == "a", top.article or article, number, top.weak or (number if weak else 0)))
        open_[tag] += 1
    flush()
    return out


@dataclass
class Ratios:
    """Of each block, by its path: fused weight, share of links, punctuation per node, nodes."""

    weight: np.ndarray
    links: np.ndarray
    marks: np.ndarray
    nodes: np.ndarray


def path_ratios(page: Page) -> Ratios:
    """Sums by path, and their ratios. A mark belongs to a block, not to the path's sums, so equal paths share all but that."""
    path = np.unique(np.array(page.paths), return_inverse=True)[1]
    length = np.array([len(t) for t in page.texts], float)
    sums = [np.bincount(path, x)[path] for x in (length, np.array([sum(map(t.count, _PUNCTUATION)) for t in page.texts], float), np.array(page.linked, float), np.ones(len(path)))]
    text, marks, links, nodes = sums
    share = links / text
    weight = text / nodes * (1 + np.log1p(marks / nodes)) * (1 - share) ** 2 * np.array(page.factors)
    return Ratios(weight, share, marks / nodes, nodes)


def smooth(values: np.ndarray, radius: int = 1) -> np.ndarray:
    if len(values) < 2 * radius + 1:
        return values
    kernel = np.exp(-np.square(np.arange(-radius, radius + 1)) / (2.0 * radius * radius))
    padded = np.pad(values, radius, mode="edge")
    return np.convolve(padded, kernel / kernel.sum(), mode="valid")


def main_text(page: str | None, cover: float = 0.9, menu_links: float = 0.8) -> str:
    """The article's blocks in page order, joined by one space; empty for null, empty and textless pages."""
    parsed = parse(page) if page else None
    if parsed is None or not parsed.texts:
        return ""
    ratios = path_ratios(parsed)
    weak = np.array(parsed.weak)
    chosen = ratios.weight * np.where(weak > 0, WEAK_MARK, 1.0)
    smoothed = smooth(chosen)
    threshold = min(smoothed.mean(), 0.3 * smoothed.max() + 0.2 * smoothed.std())
    content = smoothed >= threshold
    # Weight of the content below each element; children come after their parents.
    held = np.bincount(parsed.blocks, np.where(content, chosen, 0.0), minlength=len(parsed.tags))
    if not held.sum():
        held = np.bincount(parsed.blocks, [float(len(t)) for t in parsed.texts], minlength=len(parsed.tags))
    for n in range(len(held) - 1, 0, -1):
        held[parsed.parents[n]] += held[n]
    region = max((n for n, w in enumerate(held) if w >= cover * held[0] - 1e-9 and parsed.tags[n] in CONTAINERS), default=0)
    above, at = [], region
    while at > 0:
        above.append(at)
        at = parsed.parents[at]
    region = next((n for tag in ("article", "main") for n in reversed(above) if parsed.tags[n] == tag), region)
    inside = [region == 0] * len(held)
    for n in range(1, len(held)):
        inside[n] = n == region or inside[parsed.parents[n]]
    marked = np.array(parsed.factors)
    around = marked[[i for i, b in enumerate(parsed.blocks) if inside[b]]].max(initial=0.0)
    menu = (ratios.links > menu_links) & (ratios.marks < 0.5) & (ratios.nodes > 1)
    below = ratios.weight < threshold
    # What a weakly marked element holds stays together, if one of its blocks has the weight of content.
    best = np.zeros(len(held))
    np.maximum.at(best, weak, ratios.weight)
    small = (weak > 0) & (best[weak] < threshold)
    kept, begun = [], False
    for i, text in enumerate(parsed.texts):
        here = inside[parsed.blocks[i]]
        begun |= here
        title = not begun and parsed.headings[i] and not parsed.linked[i] and marked[i] >= 1 and not weak[i]
        if title or (here and not (below[i] and (marked[i] < around or menu[i] or small[i]))):
            kept.append(text)
    return " ".join(kept)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every page, from its whole html.

    Null and empty html and pages without text give an empty text. Repeated rows each give a row; null ids and urls are kept; further
    columns are left out; an empty table gives no rows. A page is held in memory at once, pages one after another.
    """
    kind = pages.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return rows.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
