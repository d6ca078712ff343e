"""Main text of web pages by a maximum-scoring subsequence.

A page is a sequence of words and tags. A word scores by the block elements and classes
around it, positive where they are like those of article text; a tag costs a little. The
contiguous run with the highest total, found in one linear scan, is the content region;
blocks in it whose own surroundings score negative (notices, adverts, forms, comments)
are left out.

The weights come from labelled pages: a bounded sample of the pages that mark their text
with an ``article`` or ``main`` element. A logistic regression learns which elements and
classes lie inside. Each labelled word counts twice, once with the marking element hidden,
so that the model also works on pages without it. A few usual names are added as examples,
for names that the sample does not show.

Defined results: null, empty and purely technical pages give an empty text; broken markup
is read as far as it goes; every row gives a row; other columns are not read.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Collection, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)",
    re.S,
)
_NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
_SPLIT = re.compile(r"[^a-z0-9]+")
#: Beginnings of names that tell how a page is laid out and not what an element holds, as in no-sidebar.
_LAYOUT = re.compile(r"(?:no|not|has|with|without|is|show|hide)[-_]")
_RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "template", "svg", "select", "button"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "del", "dfn", "em", "font", "i", "ins", "kbd", "label",
    "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "img", "wbr",
}
#: Elements that end an open one of the same kind.
_ENDS = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_BLOCK_ENDS_P = {
    "address", "article", "aside", "blockquote", "div", "dl", "fieldset", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6",
    "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul", "figure",
}
MARKS = {"article", "main"}
#: Around text of any kind.
_EVERYWHERE = {"html", "body", "div"}
#: What keeps its meaning around and on an element that marks text: a reader's comment may be an article.
_KEPT_AT_MARKS = {
    "nav", "header", "footer", "aside", "form", "dialog", ".comment", ".comments", ".reply", ".replies", ".respond",
    ".discussion", ".disqus", ".ad", ".ads", ".advert", ".advertisement", ".sponsor", ".sponsored",
}
#: Names that are outside of the main text on most pages, and some that are inside, as examples.
_OUTSIDE = (
    "nav", "header", "footer", "aside", "form", "menu", "head", "dialog", "fieldset", ".ad", ".ads", ".advert", ".advertisement",
    ".banner", ".breadcrumb", ".breadcrumbs", ".comment", ".comments", ".cookie", ".cookies", ".consent", ".disqus", ".footer",
    ".header", ".masthead", ".menu", ".nav", ".navbar", ".navigation", ".newsletter", ".notice", ".popup", ".promo", ".related",
    ".replies", ".reply", ".share", ".sharing", ".sidebar", ".social", ".sponsor", ".sponsored", ".subscribe", ".widget",
    ".complementary", ".contentinfo", ".alert", ".respond", ".discussion",
)
_INSIDE = ("p", "h1", "h2", "h3", "li", "ul", "ol", "blockquote", "pre", "table", "tr", "td", "th", "dl", "dd", "dt", "figure", "figcaption", "section", "tbody", ".content", ".post", ".entry", ".story", ".text", ".body")


#: In which surroundings they stay outside.
_AROUND_OUTSIDE = (
    (), ("p",), ("h2",), ("ul", "li"), ("article", "p"), ("article", "section"), ("main",), ("section",), (".content", ".post"),
    (".content", ".article", "p"), (".body", ".entry"), (".story", ".text"),
)


class Word(NamedTuple):
    """Text between two tags: its words joined by single spaces, its block and its surroundings."""

    text: str
    count: int
    block: int
    around: frozenset[str]
    spaced: tuple[bool, bool]


def _names(attributes: str) -> frozenset[str]:
    """The parts of the names that an element has, without those that describe the layout of the page."""
    if not attributes or "=" not in attributes:
        return frozenset()
    names = (n for m in _NAMED.finditer(attributes) for n in m[1].strip("\"'").lower().split())
    return frozenset("." + part for n in names if not _LAYOUT.match(n) for part in _SPLIT.split(n) if part)


class _Open(NamedTuple):
    """An open element: its name, the surroundings within it, and the place of the innermost block element."""

    name: str
    around: frozenset[str]
    base: int


def parse(page: str, known: Collection[str] | None = None) -> list[Word | str]:
    """The page as runs of words and names of tags, in page order. Surroundings hold the ``known`` names, or all.

    Names of the page as a whole (on ``html`` and ``body``) say nothing about a part of it. An
    element that marks text begins anew: of what is around it, and of its own names, only those of
    ``_KEPT_AT_MARKS`` count within it.
    """
    out: list[Word | str] = []
    stack: list[_Open] = []
    opened: Counter = Counter()
    around: frozenset[str] = frozenset()
    block, at = 0, 0

    def text(piece: str) -> None:
        plain = html.unescape(piece) if "&" in piece else piece
        found = plain.split()
        if found:
            out.append(Word(" ".join(found), len(found), block, around, (plain[0].isspace(), plain[-1].isspace())))
        elif plain:
            out.append(Word("", 0, block, around, (True, True)))

    def cut(depth: int) -> None:
        nonlocal around
        for element in stack[depth:]:
            opened[element.name] -= 1
        del stack[depth:]
        around = stack[-1].around if stack else frozenset()

    while at < len(page):
        m = _TAG.search(page, at)
        if not m:
            text(page[at:])
            break
        if m.start() > at:
            text(page[at : m.start()])
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        closing = bool(m[1] or m[4])
        if name not in _INLINE:
            block += 1
        out.append(name)
        if closing:
            if opened[name]:
                depth = len(stack) - 1
                while stack[depth].name != name:
                    depth -= 1
                cut(depth)
            continue
        if name in _RAW:
            end = re.compile(rf"</{name}[^>]*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if name in _VOID:
            continue
        base = stack[-1].base if stack else -1
        if base >= 0:
            open_name = stack[base].name
            if open_name in _ENDS.get(name, ()) or (open_name == "p" and name in _BLOCK_ENDS_P):
                cut(base)
        own = _names(m[3] or m[6] or "") if name not in _EVERYWHERE or name == "div" else frozenset()
        within = around
        if name in MARKS:
            own, within = own & _KEPT_AT_MARKS | {name}, around & (_KEPT_AT_MARKS | MARKS)
        elif name not in _INLINE and name not in _EVERYWHERE:
            own |= {name}
        if known is not None:
            own = frozenset(x for x in own if x in known)
        if not own <= within:
            within = within | own
        around = within
        opened[name] += 1
        base = (stack[-1].base if stack else -1) if name in _INLINE else len(stack)
        stack.append(_Open(name, within, base))
    return out


class PageModel(NamedTuple):
    """Weight of each surrounding name, and cost of each tag."""

    weights: dict[str, float]
    bias: float
    tags: dict[str, float]

    def score(self, around: frozenset[str]) -> float:
        """Between -3 and 3; the outside names of an element win over its marks."""
        return max(-3.0, min(3.0, self.bias + sum(self.weights.get(x, 0.0) for x in around)))


def fit(pages: list[str]) -> PageModel:
    """Logistic regression on sets of surrounding names, weighted by words, and tag costs by density."""
    examples: Counter = Counter()
    tags_in: Counter = Counter()
    tags_out: Counter = Counter()
    for page in pages:
        parts = parse(page)
        marked = {frozenset(MARKS & p.around) for p in parts if isinstance(p, Word)}
        if not any(marked):
            continue
        inside = False
        for part in parts:
            if isinstance(part, Word):
                inside = bool(MARKS & part.around) and not any(x in part.around for x in _OUTSIDE)
                if part.count:
                    examples[part.around, inside] += part.count
                    examples[part.around - MARKS, inside] += part.count
            else:
                (tags_in if inside else tags_out)[part] += 1
    total = sum(examples.values())
    scale = 500 / total if total else 1.0
    data = [(around, 1.0 if inside else 0.0, n * scale) for (around, inside), n in examples.items()]
    for name in _OUTSIDE:
        data += [(frozenset({name, *more}), 0.0, 5.0) for more in _AROUND_OUTSIDE]
    for name in _INSIDE:
        data += [(frozenset({name}), 1.0, 3.0), (frozenset({name, "article"}), 1.0, 6.0), (frozenset({name, "main"}), 1.0, 2.0)]
        data += [(frozenset({name, ".content", ".post"}), 1.0, 3.0), (frozenset({name, ".body", ".entry", ".story", ".text"}), 1.0, 3.0)]
    data += [(frozenset({"p"}), 1.0, 30.0), (frozenset(), 1.0, 10.0)]
    weights: dict[str, float] = {}
    slopes: dict[str, float] = {}
    bias = 0.0
    for _ in range(300):
        slopes.clear()
        slope, mass = 0.0, sum(w for *_, w in data)
        for around, label, weight in data:
            value = bias + sum(weights.get(x, 0.0) for x in around)
            error = weight * (1 / (1 + math.exp(-max(-30.0, min(30.0, value)))) - label)
            slope += error
            for x in around:
                slopes[x] = slopes.get(x, 0.0) + error
        bias -= 0.8 * slope / mass
        for x, g in slopes.items():
            own = weights.get(x, 0.0)
            weights[x] = own - 0.35 * (g / 12 + 0.01 * own) / (1 + abs(g) / 60)
    tags = {t: -0.1 - 0.4 * tags_out[t] / (tags_in[t] + tags_out[t] + 4) for t in tags_in.keys() | tags_out.keys()}
    return PageModel(weights, bias, tags)


def region(scores: list[float]) -> tuple[int, int]:
    """Begin and end of the run with the highest sum; the first and shortest of equal ones; empty if none is positive."""
    best, here = 0.0, 0.0
    begin = found_begin = found_end = 0
    for i, x in enumerate(scores):
        if here <= 0:
            here, begin = 0.0, i
        here += x
        if here > best:
            best, found_begin, found_end = here, begin, i + 1
    return found_begin, found_end


def main_text(model: PageModel, page: str) -> str:
    """Blocks of the best region, one to a line."""
    parts = parse(page, model.weights)
    known: dict[frozenset[str], float] = {}
    scores = []
    for part in parts:
        if isinstance(part, Word):
            if part.around not in known:
                known[part.around] = model.score(part.around)
            scores.append(known[part.around] * part.count)
        else:
            scores.append(model.tags.get(part, -0.25))
    begin, end = region(scores)
    blocks: list[str] = []
    last, held, gap = None, "", False
    for part in parts[begin:end]:
        if not isinstance(part, Word):
            continue
        if known[part.around] < 0:
            continue
        if part.block != last:
            if held:
                blocks.append(held)
            last, held, gap = part.block, "", False
        if not part.count:
            gap = True
            continue
        held += (" " if held and (gap or part.spaced[0]) else "") + part.text
        gap = part.spaced[1]
    if held:
        blocks.append(held)
    return "\n".join(blocks)


def train(pages: DataFrame, sample: int = 400, longest: int = 1 << 18) -> PageModel:
    """Fit on at most ``sample`` different pages that mark their text, of at most ``longest`` bytes each.

    They are chosen by hash, and only then fetched, so the driver gets no other page.
    """
    marked = pages.where(F.col("html").rlike("(?i)<(article|main)[\\s>]") & (F.octet_length("html") <= longest))
    marked = marked.select("html", F.xxhash64("html").alias("key"))
    # A page that was stored many times is one page.
    chosen = [r.key for r in marked.select("key").distinct().orderBy("key").limit(sample).collect()]
    rows = marked.where(F.col("key").isin(chosen)).groupBy("key").agg(F.min("html").alias("html")).orderBy("key").collect()
    return fit([r.html for r in rows])


def extract(pages: DataFrame, sample: int = 400, longest: int = 1 << 18) -> DataFrame:
    """Main text of every page: ``page_id, url, text, n_chars``."""
    model = pages.sparkSession.sparkContext.broadcast(train(pages, sample, longest))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            texts = [main_text(model.value, x.as_py() or "") for x in part.column(2)]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html")
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
