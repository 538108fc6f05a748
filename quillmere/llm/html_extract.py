"""Main text of web pages by a minimum cut over their blocks.

A page's blocks of text are nodes. A classifier's costs of calling a block content or boilerplate are its terminal
capacities; neighbours, and blocks near each other in the DOM, are joined by edges whose capacity it costs to part them.
The maximum flow's cut is the cheapest labelling. The classifier is a logistic model of a block's own text and of what the elements around it
say (article, nav, ...), fitted on a bounded sample of the blocks that lie in elements which say what they are. Each of these is learnt from twice, as it is and
with what its elements say hidden, so that the model knows texts by themselves, for pages that have no telling elements. All terms are bounded so that a block's
neighbours can outweigh what its own text and its own class say; blocks whose texts are unlike hold to each other less.
"""

from __future__ import annotations

import html as entities
import re
from collections import deque
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE_PAGES, SAMPLE_BLOCKS = 1_000, 40_000
#: Bounds of a block's costs: what elements around it say, what its own element's class says, and what its text says.
LANDMARK, OWN_CLASS, TEXT = 4.0, 1.5, 2.0
#: Capacities between neighbours in one element (less the farther they are in the DOM), and between the next blocks of one element.
ADJACENT, NEAR = 2.5, 0.5
#: How much of an edge's capacity is left between blocks whose surroundings speak against each other, and between texts that are quite unlike.
OPPOSED, UNLIKE = 0.25, 0.1
#: How strongly weights are held to DEFAULT, for each row that they are fitted on.
RIDGE = 0.01

#: Kinds of HTML elements, and words in class and id that tell what an element is for.
RAW = {"script", "style", "noscript", "template", "iframe", "object", "canvas", "audio", "video", "textarea", "select", "option", "button", "title", "xmp"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q",
    "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "br", "wbr", "img",
    "svg", "g", "text", "tspan", "path", "math", "mi", "mn", "mo", "mrow", "msup", "msub", "mfrac", "msqrt", "mtext", "semantics",
}
BOILERPLATE = {"nav", "footer", "aside", "form", "menu", "dialog", "fieldset"}
CONTENT = {"article", "main"}
BOILERPLATE_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar"}
BOILERPLATE_WORDS = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent", "cookie",
    "cookies", "disqus", "footer", "gdpr", "login", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notification",
    "overlay", "pager", "pagination", "popup", "promo", "promoted", "promotion", "recommended", "related", "replies", "respond", "search", "share",
    "sharing", "sidebar", "signup", "skip", "social", "sponsor", "sponsored", "subscribe", "subscription", "toolbar", "topbar", "trending", "widget",
}
CONTENT_WORDS = {"article", "articlebody", "body", "content", "entry", "main", "post", "story", "text"}

_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S
)
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?", re.I)
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_TOKEN = re.compile(r"[a-z]+")


#: Elements that hold one block, whose class speaks for that block only.
SINGLE = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dt", "dd", "td", "th", "span", "blockquote", "pre", "figcaption", "caption"}
HEADINGS = {"h1", "h2", "h3"}


@dataclass
class Element:
    tag: str
    parent: Element | None
    depth: int
    says: float  # from 1, inside an article or the like, to -1, inside boilerplate; what its own class says counts less; 0: nothing
    aside: bool = False  # in the header of an article, where headings alone belong to it


@dataclass
class Block:
    element: Element
    parts: list[str] = field(default_factory=list)
    linked: int = 0  # letters inside links

    @property
    def text(self) -> str:
        return " ".join("".join(self.parts).split())


def _child(tag: str, attributes: str, parent: Element) -> Element:
    """An element inside parent, with what it and those around it say: the innermost that says something counts, and boilerplate stays boilerplate."""
    before, out = parent.says, Element(tag, parent, parent.depth + 1, parent.says, parent.aside)
    if before <= -1 or tag in ("html", "body"):
        return out
    found: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(attributes) if attributes else ():
        found.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    role = found.get("role", "").lower()
    if tag in BOILERPLATE or role in BOILERPLATE_ROLES or "hidden" in found or found.get("aria-hidden") == "true" or _HIDDEN.search(found.get("style", "")):
        out.says = -1
    elif tag in CONTENT or role in ("main", "article"):
        out.says, out.aside = 1, False
    elif tag == "header":
        out.says, out.aside = (before, True) if before > 0 else (-1, False)
    else:
        words = set(_TOKEN.findall((found.get("class", "") + " " + found.get("id", "")).lower()))
        bad, good = words & BOILERPLATE_WORDS, words & CONTENT_WORDS
        own = OWN_CLASS / LANDMARK if tag in SINGLE else 1
        if bad and not good:
            out.says = -own
        elif good and not bad:
            out.says = max(own, before)
    return out


def blocks_of(page: str) -> list[Block]:
    """A page's blocks of text in order, with the elements that they are in. Forgiving: what isn't closed ends with what it is in."""
    root = Element("", None, 0, 0)
    now, block, out, links = root, Block(root), [], 0
    at, n = 0, len(page)

    def end_block(element: Element) -> None:
        nonlocal block
        if block.parts and block.text:
            out.append(block)
        block = Block(element)

    def add(text: str) -> None:
        if text:
            text = entities.unescape(text)
            block.parts.append(text)
            if links:
                block.linked += len(text.strip())

    while at < n:
        m = _MARKUP.search(page, at)
        if not m:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        closing, tag, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            continue  # a comment or declaration
        tag = tag.lower()
        if tag in RAW:
            if not closing and not attributes.endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}\s*[^>]*>", re.I).search(page, at)
                at = end.end() if end else (n if tag in ("script", "style") else at)
            continue
        if tag == "a":
            links = max(0, links + (-1 if closing else 1))
        if tag in INLINE or tag in ("input", "embed"):
            if tag in ("br", "img", "wbr", "input"):
                block.parts.append(" " if tag != "wbr" else "")
            elif not closing and attributes and tag == "span" and (own := _child(tag, attributes, now)).says != now.says:
                # Rare: an inline element that says what it is. It counts as an element of its own.
                now = own
                end_block(now)
            elif closing and now.tag == tag:
                now = now.parent
                end_block(now)
            continue
        if tag in VOID:
            end_block(now)
            continue
        links = 0 if tag in ("p", "li", "div", "article", "section") else links
        if closing:
            open_ = now
            while open_.parent and open_.tag != tag:
                open_ = open_.parent
            if open_.parent:
                now = open_.parent
            end_block(now)
            continue
        if now.tag == "p" or now.tag == tag and tag in ("li", "dt", "dd", "tr", "td", "th", "option", "p"):
            now = now.parent
        elif tag == "li" and now.tag not in ("ul", "ol"):
            open_ = now
            while open_.parent and open_.tag not in ("li", "ul", "ol"):
                open_ = open_.parent
            now = open_.parent if open_.tag == "li" and open_.parent else now
        now = _child(tag, attributes, now)
        end_block(now)
    end_block(root)
    return out


N_FEATURES = 8


def features(block: Block) -> list[float]:
    """Of the text alone: length, links, sentence marks, letter case, digits, and that it is a heading or a list item."""
    text = block.text
    n, words = len(text), text.count(" ") + 1
    marks = sum(text.count(c) for c in ".!?…,;:")
    return [
        min(1.0, np.log1p(n) / 8), min(1.0, block.linked / max(n, 1)), min(1.0, marks / words * 4), float(text[-1:] in ".!?…\"”»"),
        min(1.0, sum(c.isupper() for c in text) / max(n, 1) * 5), min(1.0, sum(c.isdigit() for c in text) / max(n, 1) * 5),
        float(block.element.tag in ("h1", "h2", "h3", "h4")), float(block.element.tag in ("li", "td", "th", "dt")),
    ]


#: Weights of the features, the bias, and what surrounding elements say, where a table has too few labelled blocks to fit them.
DEFAULT = np.array([4.0, -4.0, 1.0, 1.0, -1.0, -0.5, 0.5, -1.0, -1.5, LANDMARK])


def fit(rows: list[list[float]], says: list[int]) -> np.ndarray:
    """DEFAULT's weights by damped Newton steps of a logistic model, with a ridge towards DEFAULT. Each row counts as it is and with says hidden."""
    y = np.array([s > 0 for s in says], float)
    if len(y) < 50 or y.min() == y.max():
        return DEFAULT
    x = np.column_stack([np.array(rows), np.ones(len(rows))])
    x = np.vstack([np.column_stack([x, np.array(says, float)]), np.column_stack([x, np.zeros(len(x))])])
    y = np.concatenate([y, y])
    w, ridge = DEFAULT.copy(), max(1.0, RIDGE * len(y))
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + ridge * (w - DEFAULT)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), grad)
        w = w - step / max(1.0, np.abs(step).max())
    return w


def _distance(a: Element, b: Element) -> int:
    steps = 0
    while a is not b:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
        steps += 1
    return steps


def cut(surplus: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """The labelling that costs least: surplus is what it costs to call a node boilerplate less what it costs to call it content.

    Nodes whose surplus outweighs all their edges keep their side whatever the others do, so they are settled first and
    hand their edges' capacities to their neighbours' surpluses; the maximum flow runs on what stays open, and True means content.
    """
    n = len(surplus)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, c in edges:
        near[a][b] = near[a].get(b, 0.0) + c
        near[b][a] = near[b].get(a, 0.0) + c
    surplus = list(surplus)
    side: list[bool | None] = [None] * n
    todo = deque(range(n))
    while todo:
        i = todo.popleft()
        if side[i] is None and abs(surplus[i]) >= sum(near[i].values()):
            side[i] = surplus[i] > 0
            for j, c in near[i].items():
                surplus[j] += c if side[i] else -c
                del near[j][i]
                todo.append(j)
            near[i] = {}
    open_ = [i for i in range(n) if side[i] is None]
    if open_:
        for i in _reached(open_, surplus, near):
            side[i] = True
    return [bool(s) for s in side]


def _reached(nodes: list[int], surplus: list[float], near: list[dict[int, float]]) -> set[int]:
    """Nodes on the source's side of a minimum cut: those that residual capacities still reach when no flow can be added.

    The source feeds nodes with a positive surplus, the others drain to the sink. Flow is added along shortest paths, a
    layered network at a time, each of which is searched through with arcs that lead nowhere taken off.
    """
    left = {i: dict(near[i]) for i in nodes}
    supply = {i: surplus[i] for i in nodes if surplus[i] > 0}
    drain = {i: -surplus[i] for i in nodes if surplus[i] < 0}
    tiny = 1e-12
    while True:
        level = {i: 0 for i, c in supply.items() if c > tiny}
        queue = deque(level)
        while queue:
            i = queue.popleft()
            for j, c in left[i].items():
                if c > tiny and j not in level:
                    level[j] = level[i] + 1
                    queue.append(j)
        if not any(c > tiny and i in level for i, c in drain.items()):
            return set(level)
        ahead = {i: [j for j, c in left[i].items() if c > tiny and level.get(j) == level[i] + 1] for i in level}
        for start in [i for i in supply if supply[i] > tiny]:
            path = [start]
            while path and supply[start] > tiny:
                i = path[-1]
                if drain.get(i, 0.0) > tiny:
                    amount = min([supply[start], drain[i], *(left[a][b] for a, b in zip(path, path[1:]))])
                    supply[start] -= amount
                    drain[i] -= amount
                    for a, b in zip(path, path[1:]):
                        left[a][b] -= amount
                        left[b][a] = left[b].get(a, 0.0) + amount
                    cut_at = next((k for k, (a, b) in enumerate(zip(path, path[1:])) if left[a][b] <= tiny), None)
                    path = path if cut_at is None else path[: cut_at + 1]
                    continue
                while ahead[i] and left[i][ahead[i][-1]] <= tiny:
                    ahead[i].pop()
                if ahead[i]:
                    path.append(ahead[i][-1])
                else:
                    path.pop()
                    if path:
                        ahead[path[-1]].pop()


def costs(blocks: list[Block], weights: np.ndarray) -> tuple[list[float], list[tuple[int, int, float]]]:
    """Each block's surplus, and the edges between blocks with their capacities; see cut()."""
    x = np.column_stack([np.array([features(b) for b in blocks]), np.ones(len(blocks))])
    says = [b.element.says if not b.element.aside or b.element.tag in HEADINGS else -1 for b in blocks]
    surplus = np.clip(x @ weights[:-1], -TEXT, TEXT) + min(max(weights[-1], TEXT), LANDMARK) * np.array(says)
    # By length, links and sentence marks: what a menu and a paragraph differ in.
    unlike = lambda i, j: 1 - (1 - UNLIKE) * min(1.0, float(np.abs(x[i, :3] - x[j, :3]).sum()))
    edges = []
    last: dict[int, int] = {}
    for i, b in enumerate(blocks):
        opposed = lambda j: OPPOSED if abs(says[i] - says[j]) > 1.5 else 1  # noqa: B023, E731
        if i:
            edges.append((i - 1, i, ADJACENT / max(1, _distance(blocks[i - 1].element, b.element) - 1) * opposed(i - 1) * unlike(i, i - 1)))
        parent = id(b.element.parent)
        if parent in last and last[parent] != i - 1:
            edges.append((last[parent], i, NEAR * opposed(last[parent]) * unlike(i, last[parent])))
        last[parent] = i
    return surplus.tolist(), edges


def labelled(blocks: list[Block], weights: np.ndarray) -> list[bool]:
    """Which blocks are content."""
    return cut(*costs(blocks, weights)) if blocks else []


def main_text(page: str | None, weights: np.ndarray = DEFAULT) -> str:
    blocks = blocks_of(page or "")
    return "\n".join(b.text for b, kept in zip(blocks, labelled(blocks, weights)) if kept)


def train(pages: DataFrame) -> np.ndarray:
    """Weights from blocks of about SAMPLE_PAGES pages, picked by a hash of page_id, that lie in elements which say what they are.

    At most SAMPLE_BLOCKS of them, those of the smallest hashes of their page and place.
    """
    total = pages.count()
    picked = pages.where(F.pmod(F.xxhash64("page_id"), F.lit(1 << 20)) < min(1 << 20, int(SAMPLE_PAGES / max(total, 1) * (1 << 20)) + 1))

    def described(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for page, html in zip(batch["page_id"], batch["html"]):
                found = [(i, b) for i, b in enumerate(blocks_of(html)) if abs(b.element.says) == 1]
                rows = {"page_id": page, "place": [i for i, _ in found], "x": pd.Series([features(b) for _, b in found], dtype=object), "says": [int(b.element.says) for _, b in found]}
                yield pd.DataFrame(rows).astype({"page_id": "Int64", "place": "int64", "says": "int32"})

    rows = picked.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.mapInPandas(described, "page_id long, place long, x array<double>, says int")
    rows = rows.orderBy(F.xxhash64("page_id", "place"), "page_id", "place", "x", "says").limit(SAMPLE_BLOCKS).select("x", "says").collect()
    return fit([list(r.x) for r in rows], [r.says for r in rows])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row; text has the blocks of the article, one on a line.

    pages: page_id, url and html; more columns are ignored, repeated rows stay. White space inside a block becomes one space, a line break
    included. A null or empty page, and one without content, has an empty text. Nothing is shuffled, dropped or capped.
    """
    weights = pages.sparkSession.sparkContext.broadcast(train(pages))

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [main_text(page, weights.value) for page in batch["html"]]
            yield pd.DataFrame({"page_id": batch["page_id"], "url": batch["url"], "text": texts, "n_chars": [len(t) for t in texts]})

    some = pages.select(F.col("page_id").cast("long"), "url", F.coalesce("html", F.lit("")).alias("html"))
    return some.mapInPandas(run, "page_id long, url string, text string, n_chars long")
