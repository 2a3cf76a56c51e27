"""Main text of web pages: flat text blocks, classified by a decision tree.

A page is cut into flat blocks at block-level tags. Each block has its number of words, its link density (the
share of its characters inside links), the same of the blocks before and after it, how full its container is beside the
page's fullest, whether it is a heading, whether it is inside an article, and how surely an element around it is named as furniture
(0 not, 1 perhaps, 2 surely). A decision tree, fitted on a small table of labelled blocks, which are read from rendered pages of many
layouts (layouts.py), decides which blocks are main text. A page is read once from its
start to its end, whatever is left unclosed in it.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow
from .layouts import LAYOUTS

#: Element names by what they do to the flow of text.
BLOCK = set(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe legend li main menu nav ol option p pre search section select summary table tbody td "
    "tfoot th thead title tr ul".split()
)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = set("annotation script style noscript template svg iframe object canvas select textarea head title button audio video".split())
FURNITURE = set("nav aside menu dialog search footer".split())
#: Furniture of a page, but inside an article perhaps its title, or a form around all of it.
PERHAPS = set("header form".split())
ARTICLE = set("article main".split())
RAW = set("script style textarea title".split())
HEADING = {f"h{i}" for i in range(1, 7)}
#: An element of this kind ends an open one of the same kind, and headings end paragraphs.
SIBLINGS = {"p", "li", "dt", "dd", "tr", "td", "th", "option"}

#: Words in class, id or role that name furniture, that say where or how it is shown, and that name the article.
NAMES_FURNITURE = set(
    "ad ads advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs byline complementary consent contentinfo cookie cookies copyright "
    "footer gdpr header masthead menu menus modal nav navbar navigation newsletter notice notices pager pagination popular popup promo promoted promotion pub rail recommended related "
    "search share sharing sidebar skip social sponsor sponsored subscribe subscription tags teaser teasers toolbar trending widget widgets".split()
)
NAMES_COMMENTS = set("comment comments commentlist discussion disqus feedback replies reply respond talkback".split())
NAMES_PLACE = set(
    "area articles bar block bottom box btn button buttons cloud col column container content elements fixed global group inner icons item items label layout left link links list "
    "main mobile news notification outer page panel posts primary right row section secondary side signup site slot stories sub text top unit wrap wrapper".split()
)
NAMES_ARTICLE = set("article articlebody content entry main post story text".split())
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

_TAG = re.compile(r"</?([a-zA-Z][^\s/<>]*+)")
# Where a tag ends: quotes that hold no tag first, then any quotes.
_PLAIN_END = re.compile(r"(?:[^<>\"']|\"[^\"<>]*\"|'[^'<>]*')*+>")
_END = re.compile(r"(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>")
_ATTRIBUTE = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
_WHITE = re.compile(r"\s+")

#: Pages that the labelled table has of each layout, rows of a leaf, and what the containers of text are.
PAGES, LEAST = 24, 4
CONTAINERS = set("article aside body center dialog div footer form header main nav section td".split())
_STANDS = re.compile(r"\{([mx])(\d+)\}")


def rendered(layout: str, draw: np.random.Generator) -> str:
    """A layout as a page: words of m are main text, words of x are not; numbers of words are about those said."""
    return _STANDS.sub(lambda m: " ".join([m[1] * 5] * max(1, round(int(m[2]) * draw.uniform(0.5, 2)))), layout)


def examples(layouts: list[str] = LAYOUTS, pages: int = PAGES, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """The labelled table: features() of the blocks of rendered pages, and whether each is main text."""
    draw, rows, labels = np.random.default_rng(seed), [], []
    for layout in layouts * pages:
        found = blocks(rendered(layout, draw))
        rows += features(found)
        labels += [x[0].count("m") > x[0].count("x") for x in found]
    return np.array(rows, dtype=float), np.array(labels)


def features(found: list[tuple]) -> list[tuple]:
    """Of each block: words and link density, the same of the block before and of the one after, its container's words that aren't links as a share of
    the fullest container's, how surely it is named as furniture, whether inside an article, a heading, and whether the page has an article."""
    shape = [(0, 0.0), *[(len(text.split()), link) for text, link, *_ in found], (0, 0.0)]
    held: Counter[int] = Counter()
    for (words, link), (_, _, sure, _, _, container) in zip(shape[1:], found, strict=False):
        held[container] += (words * (1 - link)) if sure < 2 else 0
    fullest = max(held.values(), default=0) or 1
    any_article = int(any(x[3] and x[2] < 2 for x in found))
    return [(*shape[i + 1], *shape[i], *shape[i + 2], held[x[5]] / fullest, *map(int, x[2:5]), any_article) for i, x in enumerate(found)]


def grow(rows: np.ndarray, labels: np.ndarray, depth: int = 8):
    """A binary decision tree by Gini impurity: (feature, cut, below or at, above), or a leaf's share of main text, of LEAST rows or more."""
    if depth == 0 or len(set(labels)) < 2:
        return float(labels.mean())
    best = None
    for f in range(rows.shape[1]):
        values = np.unique(rows[:, f])
        for cut in (values[:-1] + values[1:]) / 2:
            low = rows[:, f] <= cut
            if min(low.sum(), (~low).sum()) < LEAST:
                continue
            impurity = sum(m.sum() * labels[m].mean() * (1 - labels[m].mean()) for m in (low, ~low))
            if best is None or impurity < best[0] - 1e-12:
                best = (impurity, f, float(cut), low)
    if best is None:
        return float(labels.mean())
    _, f, cut, low = best
    return f, cut, grow(rows[low], labels[low], depth - 1), grow(rows[~low], labels[~low], depth - 1)


@cache
def tree():
    return grow(*examples())


def is_main(features_: tuple, node=None) -> bool:
    node = tree() if node is None else node
    while isinstance(node, tuple):
        f, cut, low, high = node
        node = low if features_[f] <= cut else high
    return node >= 0.5


def _named(label: str) -> tuple[int, bool]:
    """How surely a class, id or role names furniture, and whether it names an article."""
    sure, article = 0, False
    for name in label.split():
        words = {w.lower() for w in _NAME.findall(name)}
        if words & NAMES_COMMENTS:
            sure = 2
        elif found := words & NAMES_FURNITURE:
            sure = max(sure, 2 if words <= found | NAMES_PLACE else 1)
        elif words & NAMES_ARTICLE:
            article = True
    return sure, article


@lru_cache(4096)
def _marks(tag: str, attributes: str) -> tuple[bool, int, bool]:
    """Whether an element is dropped, how surely it is furniture, and whether it is an article."""
    said = {k.lower(): (v or "").strip("\"'") for k, v in _ATTRIBUTE.findall(attributes)} if attributes else {}
    hidden = "hidden" in said or said.get("aria-hidden", "").lower() == "true" or bool(_HIDDEN.search(said.get("style", "")))
    sure, article = (0, False) if tag in ("body", "html") else _named(" ".join(said.get(k, "") for k in ("class", "id", "role")))
    sure = min(sure, 1) if tag in ARTICLE else max(sure, 2 if tag in FURNITURE else 1 if tag in PERHAPS else 0)
    return tag in DROPPED or hidden, sure, tag in ARTICLE or said.get("itemprop", "").lower() == "articlebody" or (article and not sure)


def _tags(page: str) -> Iterator[tuple[int, int, str, str]]:
    """(start, end, tag, attributes) of each tag in order; the tag begins with / if it closes, and is empty for comments and the like."""
    at, quoted, closed, raw = 0, True, True, ""
    while (start := page.find("<", at)) >= 0 and closed:
        if raw:  # up to the end tag
            m = re.compile(rf"</{raw}(?=[\s/>])", re.I).search(page, start)
            raw, start = "", m.start() if m else len(page)
            if not m:
                return
        if page.startswith(("<!", "<?"), start):
            ends = "-->" if page.startswith("<!--", start) else "]]>" if page.startswith("<![CDATA[", start) else ">"
            end = page.find(ends, start + 2)
            at = end + len(ends) if end >= 0 else len(page)
            yield start, at, "", ""
        elif m := _TAG.match(page, start):
            end = _PLAIN_END.match(page, m.end()) or (_END.match(page, m.end()) if quoted else None)
            if end:
                at = end.end()
            else:  # a quote is open to the end of the page: from here on, tags end at the next >
                quoted, at = False, page.find(">", m.end()) + 1
                closed = at > 0
                at = at or m.end()
            if closed:
                tag, close = m[1].lower(), page[start + 1] == "/"
                raw = tag if tag in RAW and not close else ""
                yield start, at, "/" * close + tag, page[m.end() : at - 1]
        else:  # a sign, not a tag
            at = start + 1


def blocks(page: str) -> list[tuple[str, float, int, bool, bool, int]]:
    """Flat text blocks in page order: text, link density, how surely furniture, inside an article, a heading, number of the container."""
    out: list[tuple[str, float, int, bool, bool, int]] = []
    stack: list[tuple[str, bool, int, bool, bool, int]] = [("", False, 0, False, False, 0)]  # tag, dropped, furniture, article, heading, container: as they hold inside it
    open_: Counter[str] = Counter()
    parts: list[str] = []
    linked, at, containers = 0, 0, 0

    def flush() -> None:
        nonlocal linked
        text = _WHITE.sub(" ", "".join(parts)).strip()
        if text:
            out.append((text, min(1.0, linked / len(text)), *stack[-1][2:]))
        parts.clear()
        linked = 0

    def text_until(end: int) -> None:
        nonlocal linked
        if end > at and not stack[-1][1]:
            text = html.unescape(page[at:end])
            parts.append(text)
            if open_["a"]:
                linked += len(text.strip())

    def close() -> str:
        tag = stack.pop()[0]
        open_[tag] -= 1
        return tag

    for start, end, said, attributes in _tags(page):
        if not (stack[-1][0] in RAW and said != "/" + stack[-1][0]):
            text_until(start)
        at = end
        tag = said.lstrip("/")
        if not tag:
            continue
        if tag == "br":
            parts.append(" ")
        elif tag in BLOCK:
            flush()
        if said[0] == "/":
            if open_[tag]:
                while close() != tag:
                    pass
        elif tag not in VOID and not attributes.endswith("/"):
            if (tag in SIBLINGS and stack[-1][0] == tag) or (tag in BLOCK and stack[-1][0] == "p"):
                close()
            dropped, sure, article = _marks(tag, attributes)
            _, d, s, a, h, c = stack[-1]
            if tag in ARTICLE and (s < 2 or tag == "main"):
                s = 0
            if tag in CONTAINERS and tag != "body":
                containers += 1
                c = containers
            stack.append((tag, d or dropped, max(s, sure), a or article, h or tag in HEADING, c))
            open_[tag] += 1
    if stack[-1][0] not in RAW:
        text_until(len(page))
    flush()
    return out


def main_text(page: str | None, node=None) -> str:
    """The main blocks of a page, one line each."""
    found = blocks(page) if page else []
    return "\n".join(block[0] for block, x in zip(found, features(found), strict=True) if is_main(x, node))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars): one row per row of pages, repeated rows and null ids included.

    A null or empty page, and one without main text, has the empty text. White space inside a block is one
    space; blocks are joined by a line break. Other columns are ignored. An empty table gives an empty one.
    """
    plain = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    fitted = tree()  # once, not in every worker

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py(), fitted) for x in batch.column("html")]
            columns = [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "text", "n_chars"])

    return map_arrow(plain, each, "page_id long, url string, text string, n_chars long")
