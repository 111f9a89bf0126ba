"""Main text of web pages by minimum-cut labelling.

A page is cut into blocks. Each block's costs are the capacities of its edges to
the two terminals; blocks that follow each other, or that follow each other
under one parent, are joined by smoothness edges whose capacity falls with
their distance in the document tree. The maximum flow separates content from
boilerplate; content blocks are the main text.

A block's cost is what its place speaks for plus the log-odds of a logistic
model over its text, fitted on the blocks of at most `MAX_PAGES` pages whose
place is beyond doubt. Places are graded: inside an article or a menu is strong
evidence, a class name of which only a part speaks of boilerplate is weak, and
some places say nothing. Even strong evidence for boilerplate is less than text
and neighbours can outweigh; weak and absent evidence leaves it to them.

Defined results: a null or empty page has no text; a page without markup is one
block and is kept; where nothing would be left, the block that most speaks for
content stays with what the cut joins to it, unless all are beyond doubt; unclosed and stray tags, cut-off pages, broken
references and repeated rows are read as they stand; an empty table gives an
empty result; further columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import only, prepare, spread

#: Pages that the text model is fitted on at most.
MAX_PAGES = 600
#: What a place speaks for: an article; boilerplate; boilerplate by a part of a name; nothing known; an article in a named boilerplate.
SURE, BOILER_SURE, BOILER_MAYBE, NEUTRAL, NESTED = 6.0, -6.0, -1.0, 0.5, -1.0
#: Never shown.
HIDDEN = -1000.0
#: Bounds of the text's log-odds; capacity between siblings and between others that follow each other.
LOW, HIGH, SIBLINGS, FOLLOW = -3.0, 4.0, 1.2, 0.6

# A closing quote is one that a space, a slash or the tag's end follows; a tag whose quotes don't close ends at its first ">".
PIECE = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)(?:((?:[^>\"']|\"[^\"]*\"(?=[\s/>])|'[^']*'(?=[\s/>]))*)>|([^>]*)(?:>|\Z))", re.S)
ATTR = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {"address", "article", "aside", "blockquote", "body", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "html", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul", "caption", "legend"}
#: Their content is no text of the page.
RAW = {"script", "style", "title", "textarea", "iframe", "noscript", "template", "svg", "canvas", "object", "select", "button", "head"}
#: Of these, the rest of a page that never closes them is their content; of the others it is the page's own.
TO_THE_END = {"script", "style", "title", "textarea", "iframe"}
CLOSED_BY_OWN_KIND = {"p", "li", "dt", "dd", "tr", "td", "th", "option"}
BOILER = {"nav", "footer", "aside", "form", "menu", "dialog"}
BOILER_NAMES = {"ad", "ads", "advert", "advertisement", "sponsor", "sponsored", "promo", "banner", "cookie", "cookies", "consent", "notice", "popup", "modal", "newsletter", "subscribe", "sidebar", "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "footer", "share", "sharing", "social", "related", "pagination", "pager", "login", "signup", "contentinfo", "complementary", "search", "alert", "dialog"}
COMMENT_NAMES = {"comment", "comments", "respond", "disqus", "replies"}
CONTENT = {"article", "main"}
CONTENT_NAMES = {"article", "main", "post", "entry", "story"}
#: Parts of a class name that say where or what kind of box, not what is in it.
BOX_NAMES = {"section", "list", "item", "items", "box", "wrap", "wrapper", "container", "area", "block", "panel", "bar", "inner", "outer", "content", "body", "title", "heading", "text", "form", "link", "links", "button", "buttons", "icons", "group", "row", "col", "column", "top", "bottom", "left", "right", "site", "page", "global", "primary", "secondary", "slot", "unit", "widget", "thread", "count", "right-rail", "news", "posts", "articles", "media", "message"}
#: Parts that make a name speak of a state of the page rather than of its content.
STATE_NAMES = {"no", "not", "non", "without", "with", "has", "off", "on", "closed", "open", "disabled", "enabled", "none", "is"}


@dataclass
class Block:
    text: str
    place: float
    links: int
    heading: bool
    parent: int
    depth: int


def named(tokens: list[str]) -> tuple[float, bool]:
    """What class names, an id or a role speak for (0: nothing), and whether they speak of readers' comments."""
    best, comments = 0.0, False
    for token in tokens:
        parts = [x for x in re.split(r"[^a-z]+", token) if x]
        said = set(parts)
        if not parts or said & STATE_NAMES:
            continue
        if said & COMMENT_NAMES and not said - COMMENT_NAMES - BOILER_NAMES - CONTENT_NAMES - BOX_NAMES:
            comments = True
            best = BOILER_SURE
        elif said & (BOILER_NAMES | COMMENT_NAMES):
            sure = not said - BOILER_NAMES - COMMENT_NAMES - CONTENT_NAMES - BOX_NAMES
            best = min(best, BOILER_SURE if sure else BOILER_MAYBE)
        elif said & CONTENT_NAMES and not said - CONTENT_NAMES - BOX_NAMES and best >= 0:
            best = SURE
    return best, comments


def placed(name: str, raw: str | None, above: tuple[float, str]) -> tuple[float, str]:
    """What an element's place speaks for, and by what: "tag", "name" or, for good, "stay"."""
    attrs: dict[str, str] = {}
    for a in ATTR.finditer(raw) if raw else ():
        attrs.setdefault(a[1].lower(), a[2] or a[3] or a[4] or "")
    place, why = above
    if place == HIDDEN or "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true" or "display:none" in attrs.get("style", "").replace(" ", "").lower():
        return HIDDEN, "stay"
    if why == "stay":
        return above
    if name in BOILER or name == "header" and place < SURE:
        return BOILER_SURE, "form" if name == "form" else "stay" if place < SURE else "tag"
    by_name, comments = named(f"{attrs.get('class', '')} {attrs.get('id', '')} {attrs.get('role', '')}".lower().split()) if attrs and name not in ("body", "html") else (0.0, False)
    if comments:
        return BOILER_SURE, "stay"
    if by_name < 0:
        return (min(by_name, place) if place < 0 else by_name), "name"
    if name in CONTENT or by_name > 0:
        if place >= 0 or why == "form":
            return SURE, "tag"
        return (NESTED, "name") if name in CONTENT and why == "name" else above
    return above


def blocks_of(page: str | None) -> list[Block]:
    out: list[Block] = []
    #: name, place, number; the root is number 0
    stack: list[tuple[str, tuple[float, str], int]] = [("", (NEUTRAL, ""), 0)]
    #: places in the stack of the open elements of a name
    open_at: dict[str, list[int]] = {}
    unclosed: set[str] = set()
    parts: list[str] = []
    links = number = 0
    anchor = 0
    page = page or ""

    def flush() -> None:
        nonlocal links
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                holder = next((e for e in reversed(stack) if e[0] in BLOCK or not e[0]), stack[0])
                up = stack[max(0, stack.index(holder) - 1)]
                out.append(Block(text, min(holder[1][0], stack[-1][1][0]), links, holder[0] in ("h1", "h2", "h3", "h4", "h5", "h6"), up[2], len(stack)))
            parts.clear()
        links = 0

    def close(k: int) -> None:
        for e in stack[k:]:
            open_at[e[0]].pop()
        del stack[k:]

    at = 0
    while at < len(page):
        m = PIECE.search(page, at)
        chunk = page[at : m.start()] if m else page[at:]
        if chunk:
            parts.append(chunk)
            if anchor:
                links += len(chunk)
        if not m:
            break
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if m[1]:
            if name in BLOCK:
                flush()
            if name == "a":
                anchor = max(0, anchor - 1)
            if open_at.get(name):
                close(open_at[name][-1])
            continue
        if name == "br":
            parts.append(" ")
        if name in RAW and name != "head":  # one of the others that is never closed holds nothing back
            end = None if name in unclosed else re.compile(rf"</{name}\b[^>]*>", re.I).search(page, at)
            if not end:  # nor has any later one of the name
                unclosed.add(name)
            if not m[0].endswith("/>") and (end or name in TO_THE_END):
                at = end.end() if end else len(page)
            if name in BLOCK:
                flush()
            continue
        if name in BLOCK:
            flush()
            if name in CLOSED_BY_OWN_KIND:
                k = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == name or stack[i][0] in ("ul", "ol", "dl", "table", "div", "article", "section", "body")), 0)
                if k and stack[k][0] == name:
                    close(k)
            elif open_at.get("p"):
                close(open_at["p"][-1])
        if name in VOID or m[0].endswith("/>"):
            continue
        if name == "a":
            anchor += 1
        place = placed(name, m[3] or m[4], stack[-1][1])
        number += 1
        open_at.setdefault(name, []).append(len(stack))
        stack.append((name, place, number))
    flush()
    return out


def text_features(b: Block) -> list[float]:
    words = b.text.split()
    return [1.0, np.log1p(len(words)), min(1.0, b.links / max(1, len(b.text))), float(b.text[-1] in ".!?:\"'”»"), min(12, len(b.text) / len(words)), float(b.heading), float(sum(b.text.count(c) for c in ",.;") / len(words))]


def fit_weights(blocks: list[tuple[list[float], int]], rounds: int = 200, l2: float = 1.0) -> np.ndarray:
    """Logistic regression by Newton's method on (features, label)."""
    n = len(blocks[0][0]) if blocks else 7
    w = np.zeros(n)
    y = np.array([b[1] for b in blocks], float)
    if not len(y) or y.min() == y.max():
        return w
    x = np.array([b[0] for b in blocks])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + l2 * np.eye(n), x.T @ (y - p) - l2 * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def cut(score: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """The side of the source after a maximum flow: terminal capacities are the scores' positive and negative parts.

    Shortest augmenting paths by levels (Dinic). Only excess that can move along smoothness edges is ever searched."""
    n = len(score)
    near: list[list[int]] = [[] for _ in range(n)]
    to: list[int] = []
    cap: list[float] = []
    for a, b, c in edges:
        near[a].append(len(to))
        near[b].append(len(to) + 1)
        to += [b, a]
        cap += [c, c]
    source = [max(0.0, s) for s in score]
    sink = [max(0.0, -s) for s in score]
    while True:
        level = [-1] * n
        todo = deque(i for i in range(n) if source[i] > 1e-9)
        for i in todo:
            level[i] = 0
        reached = False
        while todo:
            i = todo.popleft()
            reached |= sink[i] > 1e-9
            for e in near[i]:
                if cap[e] > 1e-9 and level[to[e]] < 0:
                    level[to[e]] = level[i] + 1
                    todo.append(to[e])
        if not reached:
            return [x >= 0 for x in level]
        place = [0] * n
        for root in range(n):
            while source[root] > 1e-9:
                path, i = [], root
                while sink[i] <= 1e-9:
                    while place[i] < len(near[i]):
                        e = near[i][place[i]]
                        if cap[e] > 1e-9 and level[to[e]] == level[i] + 1:
                            break
                        place[i] += 1
                    if place[i] < len(near[i]):
                        path.append(e)
                        i = to[e]
                    elif path:
                        level[i] = -2
                        i = to[path.pop() ^ 1]
                    else:
                        break
                if sink[i] <= 1e-9:
                    break
                flow = min([source[root], sink[i], *(cap[e] for e in path)])
                source[root] -= flow
                sink[i] -= flow
                for e in path:
                    cap[e] -= flow
                    cap[e ^ 1] += flow


def main_blocks(blocks: list[Block], weights: np.ndarray) -> list[Block]:
    """The blocks on the content side of the minimum cut."""
    shown = [b for b in blocks if b.place != HIDDEN]
    if not shown:
        return []
    own = np.array([text_features(b) for b in shown]) @ weights
    score = [float(np.clip(s, LOW, HIGH)) + b.place for s, b in zip(own, shown, strict=True)]
    edges, last = [], {}
    for k, b in enumerate(shown):
        before = last.get(b.parent)
        if k and before != k - 1:
            edges.append((k - 1, k, FOLLOW / (2 + abs(b.depth - shown[k - 1].depth))))
        if before is not None:
            edges.append((before, k, SIBLINGS))
        last[b.parent] = k
    side = cut(score, edges)
    if not any(side):
        open_ = [k for k, b in enumerate(shown) if b.place > BOILER_SURE]
        if not open_:
            return []
        score[max(open_, key=lambda k: score[k])] = -HIDDEN
        side = cut(score, edges)
    return [b for b, s in zip(shown, side, strict=True) if s]


def main_text(page: str | None, weights: np.ndarray) -> str:
    return "\n".join(b.text for b in main_blocks(blocks_of(page), weights))


def fit(pages: DataFrame, max_pages: int = MAX_PAGES, seed: int = 3) -> np.ndarray:
    """Weights of the text model, from the pages of the smallest seeded hash of their ids."""
    prepare(pages.sparkSession)
    few = only(pages, "page_id").where("page_id is not null").withColumn("h", F.xxhash64(F.col("page_id"), F.lit(seed))).orderBy("h").limit(max_pages).select("page_id").distinct()
    df = only(pages.join(F.broadcast(few), "page_id", "left_semi"), "html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(text_features(x), int(x.place == SURE)) for page in b.column(0).to_pylist() for x in blocks_of(page) if x.place in (SURE, BOILER_SURE)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.list_(pa.float64())), pa.array([r[1] for r in rows], pa.int32())], ["x", "y"])

    rows = sorted((tuple(r[0]), r[1]) for r in df.mapInArrow(run, "x array<double>, y int").collect())
    return fit_weights([(list(x), y) for x, y in rows])


def extract(pages: DataFrame, max_pages: int = MAX_PAGES) -> DataFrame:
    """page_id, url, text and n_chars for every row of pages."""
    weights = fit(pages, max_pages)
    df = only(spread(pages), "page_id", "url", "html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(page, weights) for page in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return df.mapInArrow(run, f"page_id {df.dtypes[0][1]}, url {df.dtypes[1][1]}, text string, n_chars long")
