"""Main-text extraction by a minimum cut over the blocks of a page.

A page is cut into blocks of text at block-level tags. A classifier of a block's text
(length, links, punctuation, its own tag) gives it a cost of being content and one of
being boilerplate, which are the capacities of its edges to the two terminals. Regions,
the elements whose tag or marks say what they hold, are nodes too, with capacities of
their own. Smoothness edges join each block with its region (DOM proximity), blocks that
follow each other, neighbours under one parent, and regions with those around them. The
minimum cut, found by maximum flow, separates content from boilerplate: a short line goes
with the article around it, a long one in a list of comments with the comments.

The classifier is a logistic regression that is fitted on the pages themselves: blocks in
regions of plain evidence are its labels, of at most FIT_PAGES pages, those of least hash.
What it learns is held near WEIGHTS, which stand where there are no labels.

Cases: null or empty html, or html without text, gives the empty text; tags may be
unclosed, misnested or cut off at the page's end, where an unclosed select, svg, object,
canvas or math ends at its tag; a tag with an open quote ends at its first '>'; character
references are decoded; white space inside a block is one space; repeated rows each get a
result; pages of any length are read whole. Only the id, the url and the html are read
unless `carry` names more columns; a result column replaces a carried one of its name.
"""

from __future__ import annotations

import html as _html
import re
from collections import deque
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.arrowmap import column, map_arrow

#: A quoted value; one in which a '<' follows a '>' that came first is an open quote.
_QUOTED = r"\"(?:[^\"<>]*>[^\"<]*|[^\">]*<[^\"]*|[^\"<>]*)\"|'(?:[^'<>]*>[^'<]*|[^'>]*<[^']*|[^'<>]*)'"
_TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|textarea|iframe)(?=[\s/>])[^>]*>.*?(?:</\1(?=[\s/>])[^>]*>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|{_QUOTED})*+(?=>|\Z)|[^<>]*)(?:>|\Z|(?=<))", re.S | re.I)
#: Elements that go with what they hold; without an end tag only their tag goes.
_DROPPED = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I) for name in ("select", "svg", "object", "canvas", "math")}
_MARKS = re.compile(r"(?:^|\s)(?:class|id|role|aria-label|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)(?:hidden(?:\s|=|$)|aria-hidden\s*=\s*[\"']?true|style\s*=\s*[\"'][^\"']*display\s*:\s*none)", re.I)
_PART = re.compile(r"[A-Z]{2,}(?![a-z])|[A-Za-z][a-z]*")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul option".split())
_ENDS_P = BLOCK - {"option", "legend", "summary", "caption", "body", "html", "head", "title"}
#: Tags that end an open tag of these names.
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_WALLS = frozenset("ul ol dl table div article section body main aside nav".split())

#: Tags that hold the whole page or article, whatever their marks name besides.
_WHOLE = frozenset("html body main article".split())

#: Evidence for content (above 0) or boilerplate, by tag and by word in a class, id or role; of a block and what holds it the strongest of each kind counts.
TAG = {"nav": -12, "footer": -12, "aside": -12, "header": -8, "form": -7, "button": -7, "label": -4, "menu": -8, "dialog": -8, "head": -40, "title": -40, "fieldset": -5, "legend": -4, "option": -8, "address": -2, "article": 4, "main": 3, "blockquote": 1, "figcaption": -1}
MARK = {
    **dict.fromkeys("nav navbar navigation menu breadcrumb breadcrumbs pager pagination footer sidebar aside widget ad ads advert adverts advertisement advertising banner sponsor sponsored promo promoted promotion popup modal overlay cookie cookies consent gdpr notice alert newsletter subscribe subscription signup login share sharing social related recommend recommended recommendations comment comments respond reply replies disqus copyright legal disclaimer toolbar masthead topbar breaking outbrain taboola tags complementary contentinfo search".split(), -12),
    **dict.fromkeys("header meta byline rating toc skip hidden links warning".split(), -3),
    **dict.fromkeys("article articlebody content post entry story main body text prose".split(), 3),
}
#: Last words of compounds that outweigh the words before them.
HEADS = frozenset("article articlebody story".split())
#: Beginnings of longer words that speak against content.
STEMS = ("advert", "banner", "breadcrumb", "comment", "cookie", "copyright", "disclaim", "footer", "menu", "navbar", "navig", "newsletter", "popup", "promo", "recommend", "related", "replies", "respond", "share", "sidebar", "social", "sponsor", "subscri", "widget")
#: What a block's features say before any page is seen, in log-odds of content; fitting keeps near it.
WEIGHTS = {"": -0.6, "words_5": 0.5, "words_10": 0.9, "words_25": 0.9, "sentence": 0.6, "phrases": 0.3, "capital": 0.2, "links_30": -1.0, "links_60": -2.2, "rights": -1.5, "heading": 0.8, "item": -0.3}
FEATURES = tuple(WEIGHTS)
PRIOR = np.array([WEIGHTS[f] for f in FEATURES])
#: Bound on the pages that the classifier is fitted on; its labels weigh as LABELS in all, beside the strength with which it is held near PRIOR.
FIT_PAGES, LABELS, RIDGE = 2000, 1000.0, 5.0
#: Evidence from which on a region's blocks are labels.
CONTENT, BOILER = 3, -5
#: Capacities in log-odds: the most that a block's text can say, that a region can pull with, and of edges between neighbours.
MOST, PULL = 5.0, 6.0
NEXT, SIBLING, FAR, AROUND = 0.5, 0.3, 0.1, 0.5
#: Whole units of capacity to one of log-odds.
UNITS = 100


@dataclass
class Block:
    text: str
    features: tuple[int, ...]  # positions in FEATURES that hold
    own: float  # evidence of its own element beside its region's
    parent: int
    region: int


@dataclass
class Region:
    evidence: float
    around: int  # the region that holds it


def _evidence(tag: str, attributes: str) -> tuple[float, float]:
    """The strongest evidence for and against in a tag and its marks."""
    best = TAG.get(tag, 0)
    worst = min(0, best)
    best = max(0, best)
    if attributes:
        for m in _MARKS.finditer(attributes):
            for mark in (m[1] or m[2] or m[3] or "").split():
                parts = [part.lower() for part in _PART.findall(mark)]
                if parts and parts[-1] in HEADS:  # what a compound is, its last word says
                    parts = parts[-1:]
                for part in parts:
                    w = MARK.get(part)
                    if w is None:
                        w = -12 if part.startswith(STEMS) else 0
                    best, worst = max(best, w), min(worst, w if tag not in _WHOLE else 0)
        if _HIDDEN.search(attributes):
            worst = min(worst, -20)
    return best, worst


def blocks(html: str) -> tuple[list[Block], dict[int, Region]]:
    """The page's blocks and regions."""
    out: list[Block] = []
    regions = {0: Region(0.0, 0)}
    # open tags: name, strongest evidence for and against of it and what holds it, its number, its region
    stack: list[tuple[str, float, float, int, int]] = [("", 0, 0, 0, 0)]
    seen = 0
    words: list[str] = []
    linked = size = in_link = 0

    def close() -> None:
        nonlocal words, linked, size
        text = " ".join(words)
        words = []
        if text:
            name = next((x[0] for x in reversed(stack) if x[0] in BLOCK), "")
            k = next((x for x in reversed(stack) if x[0] in BLOCK), stack[0])
            out.append(Block(text, _features(text, name, linked / max(1, size)), k[1] + k[2] - regions[k[4]].evidence, k[3], k[4]))
        linked = size = 0

    def add(raw: str) -> None:
        nonlocal linked, size
        if "&" in raw:
            raw = _html.unescape(raw)
        got = raw.split()
        if not got:
            if raw and words and words[-1] is not None:
                glue[0] = False
            return
        if glue[0] and words and not raw[0].isspace():
            words[-1] += got[0]
            words.extend(got[1:])
        else:
            words.extend(got)
        glue[0] = not raw[-1].isspace()
        n = sum(map(len, got))
        size += n
        if in_link:
            linked += n

    glue = [False]  # whether the next text belongs to the last word
    at = 0
    unclosed: set[str] = set()  # dropped elements without an end tag from here on
    while m := _TOKEN.search(html, at):
        if m.start() > at:
            add(html[at : m.start()])
        at = m.end()
        tag = m[3]
        if not tag:
            continue
        tag = tag.lower()
        if tag in _DROPPED:
            if not m[2] and tag not in unclosed and not (tag in ("svg", "math") and m[4].endswith("/")):
                end = _DROPPED[tag].search(html, at)
                if end:
                    at = end.end()
                else:
                    unclosed.add(tag)
            continue
        if tag in BLOCK:
            close()
            glue[0] = False
        elif tag == "br":
            glue[0] = False
        if m[2]:
            if tag == "a":
                in_link = max(0, in_link - 1)
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == tag:
                    del stack[i:]
                    break
                if stack[i][0] in BLOCK and tag not in BLOCK:
                    break
            continue
        if tag in VOID:
            continue
        if tag in _ENDS_P:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == "p":
                    del stack[i:]
                    break
                if stack[i][0] in BLOCK:
                    break
        if tag in _ENDS:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] in _ENDS[tag]:
                    del stack[i:]
                    break
                if stack[i][0] in _WALLS and stack[i][0] not in _ENDS[tag]:
                    break
        if tag == "body" and any(x[0] == "head" for x in stack):
            stack = stack[:1]
        seen += 1
        best, worst = _evidence(tag, m[4])
        top = stack[-1]
        if tag == "header" and any(x[0] == "article" for x in stack):
            worst = 0  # the heading of the article
        region = seen if worst <= -3 or tag in ("article", "main", "section", "body") else top[4]
        outer = 0 if worst <= -5 else top[1]  # nearer evidence against outweighs what is around it
        stack.append((tag, max(best, outer), min(worst, top[2]), seen, region))
        if region == seen:
            regions[seen] = Region(stack[-1][1] + stack[-1][2], top[4])
        if tag == "a":
            in_link += 1
        elif tag in BLOCK:
            in_link = 0
    if at < len(html):
        add(html[at:].partition("<")[0] if html[at:].lstrip().startswith("<") else html[at:])
    close()
    return out, regions


_AT = {f: i for i, f in enumerate(FEATURES)}
_TAGS = {"h1": "heading", "h2": "heading", "h3": "heading", "h4": "heading", "li": "item", "td": "item", "th": "item", "dd": "item", "dt": "item"}


def _features(text: str, tag: str, links: float) -> tuple[int, ...]:
    """What holds of a block's text and tag."""
    n = text.count(" ") + 1
    out = [0, *(_AT[f"words_{k}"] for k in (5, 10, 25) if n >= k), *(_AT[f"links_{k}"] for k in (30, 60) if 100 * links > k)]
    if text[-1] in ".!?\"'”»":
        out.append(_AT["sentence"])
    if ", " in text or ". " in text:
        out.append(_AT["phrases"])
    if text[0].isupper():
        out.append(_AT["capital"])
    if text.startswith("©") or "all rights reserved" in text.lower():
        out.append(_AT["rights"])
    if tag in _TAGS:
        out.append(_AT[_TAGS[tag]])
    return tuple(out)


def graph(page: list[Block], regions: dict[int, Region], weights: np.ndarray = PRIOR) -> tuple[list[int], list[tuple[int, int, int]]]:
    """Blocks, then regions, as nodes: each one's capacity from the content terminal less that to the other, and the edges between them."""
    w = weights.tolist()
    costs = [max(-MOST, min(MOST, sum(w[i] for i in b.features))) + b.own for b in page]
    held: dict[int, int] = {}
    for b in page:
        at = b.region
        held[at] = held.get(at, 0) + 1
    for at in list(held):  # regions that hold regions with blocks
        while at:
            at = regions[at].around
            held.setdefault(at, 0)
    place = {r: len(page) + k for k, r in enumerate(held)}
    costs += [regions[r].evidence * (n + 1) if r else 0.0 for r, n in held.items()]
    edges: list[tuple[int, int, float]] = []
    last: dict[int, int] = {}
    for i, b in enumerate(page):
        edges.append((i, place[b.region], min(PULL, abs(regions[b.region].evidence)) + SIBLING))
        if i:
            edges.append((i - 1, i, NEXT if b.region == page[i - 1].region else FAR))
        if b.parent in last:
            edges.append((last[b.parent], i, SIBLING))
        last[b.parent] = i
    edges += [(place[r], place[regions[r].around], AROUND) for r in held if r]
    return [round(UNITS * x) for x in costs], [(i, j, round(UNITS * x)) for i, j, x in edges]


def cut(excess: list[int], joined: list[tuple[int, int, int]]) -> list[bool]:
    """Which nodes are on the content side of the minimum cut; a node that both sides fit is content only if it is reached."""
    excess = list(excess)  # what both terminals carry through a node is flow already
    n = len(excess)
    if not n or min(excess) > 0 or max(excess) <= 0:
        return [x > 0 for x in excess]
    edges: list[dict[int, int]] = [{} for _ in range(n)]
    for i, j, w in joined:
        edges[i][j] = edges[i].get(j, 0) + w
        edges[j][i] = edges[j].get(i, 0) + w
    while True:
        level = [-1] * n
        queue = deque(i for i in range(n) if excess[i] > 0)
        for i in queue:
            level[i] = 0
        met = False
        while queue:
            i = queue.popleft()
            if excess[i] < 0:
                met = True
                continue
            for j, c in edges[i].items():
                if c > 0 and level[j] < 0:
                    level[j] = level[i] + 1
                    queue.append(j)
        if not met:
            return [x >= 0 for x in level]
        ways = [iter(list(e)) for e in edges]
        for s in range(n):
            while excess[s] > 0 and _push(s, level, edges, excess, ways):
                pass


def _push(s: int, level: list[int], edges: list[dict[int, int]], excess: list[int], ways: list) -> bool:
    """One augmenting path along the levels from block s to a block with a deficit; its flow is moved."""
    path = [s]
    while path:
        i = path[-1]
        if excess[i] < 0:
            flow = min(excess[s], -excess[i], *(edges[a][b] for a, b in zip(path, path[1:])))
            for a, b in zip(path, path[1:]):
                edges[a][b] -= flow
                edges[b][a] += flow
            excess[s] -= flow
            excess[i] += flow
            for a in path[:-1]:  # ways that were passed may be open still
                ways[a] = iter(list(edges[a]))
            return True
        for j in ways[i]:
            if edges[i][j] > 0 and level[j] == level[i] + 1:
                path.append(j)
                break
        else:
            level[i] = -2
            path.pop()
    return False


def content(page: list[Block], regions: dict[int, Region], weights: np.ndarray = PRIOR) -> list[bool]:
    """Which blocks are content."""
    return cut(*graph(page, regions, weights))[: len(page)]


def main_text(html: str | None, weights: np.ndarray = PRIOR) -> str:
    if not html:
        return ""
    page, regions = blocks(html)
    return " ".join(b.text for b, kept in zip(page, content(page, regions, weights)) if kept)


def fit(x: np.ndarray, y: np.ndarray, times: np.ndarray) -> np.ndarray:
    """Weights of a logistic regression on rows of features that occur so many times, held near PRIOR."""
    w = PRIOR.copy()
    if not len(y):
        return w
    times = times * min(1.0, LABELS / times.sum())
    for _ in range(25):
        p = 1 / (1 + np.exp(-x @ w))
        gradient = x.T @ (times * (p - y)) + RIDGE * (w - PRIOR)
        step = np.linalg.solve((x * (times * p * (1 - p))[:, None]).T @ x + RIDGE * np.eye(len(w)), gradient)
        w = w - step
        if np.abs(step).max() < 1e-9:
            break
    return w


def learn(pages: DataFrame, page_id: str = "page_id", html: str = "html", most: int = FIT_PAGES) -> np.ndarray:
    """The classifier's weights, fitted on blocks in regions of plain evidence, of at most about `most` pages: those of least hash."""

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        found: dict[tuple, int] = {}
        for x in column(batch, "html").to_pylist():
            page, regions = blocks(x or "")
            for b in page:
                evidence = regions[b.region].evidence + b.own
                if evidence >= CONTENT or evidence <= BOILER:
                    key = (b.features, evidence > 0)
                    found[key] = found.get(key, 0) + 1
        features = pa.array([list(f) for f, _ in found], pa.list_(pa.int32()))
        return pa.RecordBatch.from_arrays([features, pa.array([y for _, y in found], pa.bool_()), pa.array(list(found.values()), pa.int64())], names=["features", "content", "times"])

    rows = pages.select(F.col(page_id).alias("id"), F.col(html).alias("html")).where("html is not null")
    share = min(1.0, most / max(1, pages.count()))
    some = rows.where(F.shiftrightunsigned(F.xxhash64(F.lit(3), "id"), 11) <= int(share * 2**53))
    counts = map_arrow(some, count, "features array<int>, content boolean, times long").groupBy("features", "content").agg(F.sum("times").alias("times"))
    got = counts.collect()  # a row for each set of features: at most a few thousand
    x = np.zeros((len(got), len(FEATURES)))
    for i, r in enumerate(got):
        x[i, r.features] = 1
    return fit(x, np.array([float(r.content) for r in got]), np.array([float(r.times) for r in got]))


def extract(pages: DataFrame, page_id: str = "page_id", html: str = "html", carry: tuple[str, ...] = ("url",), weights: np.ndarray | None = None) -> DataFrame:
    """The main text of each page and its length in code points; weights of the classifier, or None to fit them."""
    weights = learn(pages, page_id, html) if weights is None else weights
    new = ("text", "n_chars")
    names = [c for c in pages.columns if c in {page_id, *carry} and c not in new]
    own = [f"`{c}` {t}" for c, t in pages.dtypes if c in names]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [main_text(x, weights) for x in column(batch, html).to_pylist()]
        return pa.RecordBatch.from_arrays([*(column(batch, c) for c in names), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*names, *new])

    return map_arrow(pages.select(*dict.fromkeys([*names, html])), run, ", ".join([*own, "text string, n_chars long"]))


def op1_extract(spark, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "url", "text", "n_chars")
