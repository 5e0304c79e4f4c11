"""Main text of web pages by minimum-cut labelling of their blocks.

A page is cut into blocks (text between block-level tags).  Every block has a cost for either label: the
page's own statements (``article``, ``nav``, class words and so on, see ``HINTS``) and a classifier of
its shape (words, share of links, closing mark, kind of element).  These costs are terminal capacities;
neighbours in page order, the closer the fewer elements between them, and neighbours under one parent are
joined by smoothness edges.  The minimum cut, by maximum flow, is the labelling of least cost.  Blocks
whose own cost outweighs all their edges are settled before, which changes no minimum.

The classifier is a logistic regression on binned shapes, fitted on blocks that the pages' own statements
label, in about ``SAMPLE`` pages; only counts by bin leave the tasks.  Stated weights ``PRIOR`` are its
prior, so a table without such pages has a defined result too.

Defined results: null html is empty; a page without content has an empty text; repeated rows are repeated;
extra columns are ignored; unclosed and stray tags are taken as browsers do, roughly; a tag that never ends
hides what is behind it.
"""

from __future__ import annotations

import re
from collections import Counter, deque
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map

#: Pages on which the classifier is fitted, about.
SAMPLE = 4096
#: Strength of the prior weights, in blocks, and the largest score of a shape.
RIDGE, CLIP = 50.0, 4.0
#: Capacities: of a statement, of a weak one, of neighbours with no third element between them, of neighbours under one parent.
HINT, WEAK, NEAR, KIN = 12.0, 2.0, 1.0, 0.5
#: Capacities are whole numbers of this size.
GRAIN = 1000

BLOCK_TAGS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
LEAVES = HEADINGS | {"p", "li", "dd", "dt", "td", "th"}
VOID = frozenset(("hr", "br", "img", "input", "meta", "link", "base", "area", "col", "embed", "source", "track", "wbr"))
CLOSED_BY_ITSELF = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("tr", "td", "th")}
RAW = "script|style|title|template|noscript|iframe|svg|object|canvas|video|audio|textarea|select|button"
ATTRIBUTES = r"""(?:[^>"'=]+|=\s*"[^"]*"|=\s*'[^']*'|[="'])*+"""
TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<({RAW})(?=[\s/>]){ATTRIBUTES}>.*?(?:</\1\s*>|\Z)|<(/?)([a-z][^\s/>]*+)({ATTRIBUTES})(?:>|\Z)|<[!?/][^>]*(?:>|\Z)", re.S | re.I)
SAYS = re.compile(r"""\b(class|id|role|style|aria-hidden)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])|[^A-Za-z]+")

#: What a page says of its parts: fixed words.  ``STUCK`` holds whatever is inside; ``OFF`` gives way to an article in it.
STUCK, OFF, NONE, SOFT, ON = -2, -1, 0, 1, 2
HINTS = {
    STUCK: {"tags": "nav aside footer form dialog fieldset menu search", "words": "comment comments disqus replies reply respond", "roles": "navigation banner contentinfo complementary search form alert dialog menu menubar"},
    OFF: {"tags": "", "words": "nav navbar navigation menu breadcrumb breadcrumbs header masthead banner footer sidebar aside widget widgets ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion cookie cookies consent gdpr notice popup modal newsletter subscribe subscription signup login search share sharing social related recommended pagination pager toolbar copyright legal disclaimer", "roles": ""},
    SOFT: {"tags": "", "words": "content post entry story body text prose", "roles": ""},
    ON: {"tags": "article main", "words": "article articlebody", "roles": "main article"},
}
KINDS = {"tags": {w: k for k, h in HINTS.items() for w in h["tags"].split()}, "words": {w: k for k, h in HINTS.items() for w in h["words"].split()}, "roles": {w: k for k, h in HINTS.items() for w in h["roles"].split()}}
SCORE = {STUCK: -HINT, OFF: -HINT, NONE: 0.0, SOFT: WEAK, ON: HINT}


@lru_cache(1 << 14)
def said(tag: str, attributes: str) -> int:
    """What an element says of itself."""
    found = {KINDS["tags"].get(tag, NONE)}
    for name, value in SAYS.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name == "role":
            found.add(KINDS["roles"].get(value.lower(), NONE))
        elif name == "style":
            found.add(STUCK if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I) else NONE)
        elif name == "aria-hidden":
            found.add(STUCK if value.lower() == "true" else NONE)
        elif tag not in ("html", "body"):
            found |= {KINDS["words"].get(w.lower(), NONE) for w in CAMEL.split(value)}
    if re.search(r"(?:^|\s)hidden(?=[\s=/]|$)", attributes, re.I):
        found.add(STUCK)
    least, most = min(found), max(found)
    return least if least < 0 else most


def inherited(above: int, tag: str, own: int) -> int:
    """An element's state, from its parent's and what it says itself."""
    if tag == "header" and own == NONE:
        own = NONE if above == ON else OFF
    if STUCK in (above, own):
        return STUCK
    if own in (ON, OFF):
        return own
    return SOFT if own == SOFT and above == NONE else above


class Block:
    """A run of text: its element's kind, state, parent, the elements between it and the block before."""

    __slots__ = ("text", "words", "linked", "kind", "state", "parent", "far")

    def __init__(self, text, words, linked, kind, state, parent, far):
        self.text, self.words, self.linked, self.kind, self.state, self.parent, self.far = text, words, linked, kind, state, parent, far


def blocks_of(page: str) -> list[Block]:
    """The text blocks of a page in order."""
    out: list[Block] = []
    stack = [("", NONE, 0)]
    opened = Counter()
    parts: list[str] = []
    linked, in_link, made, low, last = 0, False, 0, 0, 0

    def flush():
        nonlocal linked, low, last
        if parts:
            words = "".join(parts).split()
            if words:
                tag, state, number = stack[-1]
                depth = len(stack)
                parent = stack[-2][2] if tag in LEAVES else number
                text = " ".join(words)
                out.append(Block(text, len(words), linked / max(1, len(text)), tag, state, parent, depth + last - 2 * min(low, depth, last)))
                low = last = depth
            parts.clear()
            linked = 0

    def add(text):
        nonlocal linked
        if "&" in text:
            text = unescape(text)
        if in_link:
            linked += len(text.strip())
        parts.append(text)

    def leave(to):
        nonlocal low
        for tag, _, _ in stack[to:]:
            opened[tag] -= 1
        del stack[to:]
        low = min(low, to)

    at = 0
    for m in TOKEN.finditer(page):
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        tag = m[3]
        if tag is None:
            continue
        tag = tag.lower()
        if tag not in BLOCK_TAGS:
            if tag == "a":
                in_link = not m[2]
            elif tag == "br":
                parts.append(" ")
            continue
        flush()
        if m[2]:
            if opened[tag] > 0:
                to = len(stack) - 1
                while stack[to][0] != tag:
                    to -= 1
                leave(to)
            continue
        if stack[-1][0] == "p":
            leave(len(stack) - 1)
        while stack[-1][0] in CLOSED_BY_ITSELF.get(tag, ()):
            leave(len(stack) - 1)
        if tag in VOID:
            continue
        made += 1
        stack.append((tag, inherited(stack[-1][1], tag, said(tag, m[4]) if m[4] or tag in KINDS["tags"] else NONE), made))
        opened[tag] += 1
    if at < len(page):
        add(page[at:])
    flush()
    return out


#: Bins of a shape, and their prior weights: words up to 2, 5, 10, 20, 40, 80, more; share of links up to 0, 1/3, 2/3, 1;
#: no closing mark, one; paragraph, heading, list item, other.
EDGES = (2, 5, 10, 20, 40, 80)
PRIOR = np.array([-1.5, -1.0, -0.3, 0.5, 1.0, 1.5, 2.0, 0.5, 0.0, -1.0, -2.0, -0.5, 0.5, 0.5, 1.0, -0.5, -0.3])
SIZES = (7, 4, 2, 4)
FIRST = (0, 7, 11, 13)
MARKS = frozenset(".!?…。！？:;\"”»")


def shape(block: Block) -> tuple[int, int, int, int]:
    words = sum(block.words > e for e in EDGES)
    links = 0 if not block.linked else min(3, 1 + int(3 * block.linked))
    kind = 0 if block.kind == "p" else 1 if block.kind in HEADINGS else 2 if block.kind in ("li", "dd", "dt") else 3
    return words, links, int(block.text[-1] in MARKS), kind


def fitted(counts: dict[tuple[int, ...], tuple[float, float]]) -> np.ndarray:
    """Weights of the bins from counts of boilerplate and content by shape: Newton steps to the posterior mode."""
    w = PRIOR.copy()
    if not counts:
        return w
    x = np.zeros((len(counts), len(w)))
    for i, s in enumerate(counts):
        x[i, [f + v for f, v in zip(FIRST, s, strict=True)]] = 1
    bad, good = np.array(list(counts.values()), float).T
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (good - (good + bad) * p) - RIDGE * (w - PRIOR)
        bend = (x * ((good + bad) * p * (1 - p))[:, None]).T @ x + RIDGE * np.eye(len(w))
        step = np.linalg.solve(bend, slope)
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return w


def scores(w: np.ndarray) -> dict[tuple[int, ...], float]:
    """The score of every shape."""
    return {s: float(np.clip(sum(w[f + v] for f, v in zip(FIRST, s, strict=True)), -CLIP, CLIP)) for s in np.ndindex(*SIZES)}


def minimum_cut(lean: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """The side of every node in a minimum cut: ``lean`` > 0 is its capacity from the source, < 0 to the sink.

    Nodes that outweigh their edges are settled first and lean on their neighbours from then on; the rest
    goes through Dinic's maximum flow.
    """
    n = len(lean)
    lean, side = list(lean), [None] * n
    near: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    hold = [0] * n
    for u, v, c in edges:
        near[u].append((v, c))
        near[v].append((u, c))
        hold[u] += c
        hold[v] += c
    todo = deque(range(n))
    while todo:
        u = todo.popleft()
        if side[u] is not None or abs(lean[u]) < hold[u]:
            continue
        side[u] = lean[u] >= 0
        for v, c in near[u]:
            if side[v] is None:
                lean[v] += c if side[u] else -c
                hold[v] -= c
                todo.append(v)
    rest = [u for u in range(n) if side[u] is None]
    if rest:
        place = {u: i for i, u in enumerate(rest)}
        reach = flow([lean[u] for u in rest], [(place[u], place[v], c) for u, v, c in edges if side[u] is None and side[v] is None])
        for u, s in zip(rest, reach, strict=True):
            side[u] = s
    return side


def flow(lean: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """Which nodes the source still reaches after a maximum flow (Dinic, without recursion)."""
    n = len(lean)
    source, sink = n, n + 1
    head: list[list[int]] = [[] for _ in range(n + 2)]
    to, left = [], []

    def arc(u, v, there, back):
        head[u].append(len(to))
        head[v].append(len(to) + 1)
        to.extend((v, u))
        left.extend((there, back))

    for u, x in enumerate(lean):
        if x > 0:
            arc(source, u, x, 0)
        elif x < 0:
            arc(u, sink, -x, 0)
    for u, v, c in edges:
        arc(u, v, c, c)
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        todo = deque([source])
        while todo and level[sink] < 0:
            u = todo.popleft()
            for e in head[u]:
                if left[e] and level[to[e]] < 0:
                    level[to[e]] = level[u] + 1
                    todo.append(to[e])
        if level[sink] < 0:
            break
        next_arc = [0] * (n + 2)
        path: list[int] = []
        u = source
        while True:
            if u == sink:
                least = min(left[e] for e in path)
                cut = 0
                for i in range(len(path) - 1, -1, -1):
                    left[path[i]] -= least
                    left[path[i] ^ 1] += least
                    if not left[path[i]]:
                        cut = i
                u = to[path[cut] ^ 1]
                del path[cut:]
                continue
            while next_arc[u] < len(head[u]):
                e = head[u][next_arc[u]]
                if left[e] and level[to[e]] == level[u] + 1:
                    break
                next_arc[u] += 1
            if next_arc[u] < len(head[u]):
                path.append(head[u][next_arc[u]])
                u = to[path[-1]]
            elif path:
                u = to[path.pop() ^ 1]
                next_arc[u] += 1
            else:
                break
    seen = [False] * (n + 2)
    seen[source] = True
    todo = deque([source])
    while todo:
        for e in head[todo.popleft()]:
            if left[e] and not seen[to[e]]:
                seen[to[e]] = True
                todo.append(to[e])
    return seen[:n]


def graph(blocks: list[Block], score: dict[tuple[int, ...], float]) -> tuple[list[int], list[tuple[int, int, int]]]:
    """Terminal capacities and smoothness edges of a page."""
    lean = [round(GRAIN * (SCORE[b.state] + score[shape(b)])) for b in blocks]
    edges = [(i - 1, i, round(GRAIN * NEAR / max(1, b.far - 1))) for i, b in enumerate(blocks) if i]
    kin: dict[int, int] = {}
    for i, b in enumerate(blocks):
        if b.parent in kin:
            edges.append((kin[b.parent], i, round(GRAIN * KIN)))
        kin[b.parent] = i
    return lean, edges


def main_text(page: str | None, score: dict[tuple[int, ...], float]) -> str:
    """Content blocks of a page, joined by line feeds."""
    blocks = blocks_of(page or "")
    return "\n".join(b.text for b, keep in zip(blocks, minimum_cut(*graph(blocks, score)), strict=True) if keep)


def _counting():
    seen: Counter = Counter()

    def step(batch: pa.RecordBatch):
        for page in batch.column("html").to_pylist():
            for b in blocks_of(page or ""):
                if b.state not in (NONE, SOFT):
                    seen[*shape(b), b.state == ON] += 1
        return []

    def finish():
        rows = [(*s[:4], int(s[4]), n) for s, n in seen.items()]
        yield pa.RecordBatch.from_pylist([dict(zip(("a", "b", "c", "d", "good", "n"), r, strict=True)) for r in rows], pa.schema([(c, pa.int32()) for c in ("a", "b", "c", "d", "good")] + [("n", pa.int64())]))

    step.finish = finish
    return step


def classifier(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", sample: int = SAMPLE) -> np.ndarray:
    """Weights of the shape classifier from about ``sample`` pages, picked by a hash of id and text."""
    share = sample / max(1, pages.count())
    some = pages.select(F.col(html_col).alias("html"), F.xxhash64(id_col, html_col).alias("h"))
    if share < 1:
        some = some.where(F.col("h") < int((2 * share - 1) * 2.0**63))
    counted = arrow_map(some.select("html"), _counting, "a int, b int, c int, d int, good int, n long").groupBy("a", "b", "c", "d", "good").agg(F.sum("n").alias("n"))
    counts: dict[tuple[int, ...], list[float]] = {}
    for *s, good, n in counted.collect():  # at most two rows per shape, of which there are 7 * 4 * 2 * 4
        counts.setdefault(tuple(s), [0.0, 0.0])[good] += n
    return fitted(dict(sorted((s, tuple(v)) for s, v in counts.items())))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", weights: np.ndarray | None = None) -> DataFrame:
    """``page_id, url, text, n_chars`` of every row; ``weights`` of the classifier are fitted here unless given."""
    score = scores(classifier(pages, id_col, html_col) if weights is None else weights)
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    kind = dict(rows.dtypes)

    def make():
        def step(batch: pa.RecordBatch):
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [main_text(page, score) for page in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

        return step

    return arrow_map(rows, make, f"page_id {kind['page_id']}, url {kind['url']}, text string, n_chars long")


#: For pages that state their article, as the given ones do.
ORACLE = r"""
WITH a AS (SELECT page_id, url, coalesce(regexp_extract(html, '<article>(.*?)</article>', 1, 's'), '') AS art FROM pages),
b AS (SELECT page_id, url, list_transform(regexp_split_to_array(art, '</?(?:p|h1|h2|h3|ul|ol|li|div|section)(?: [^>]*)?>'), lambda x:
  trim(regexp_replace(regexp_replace(replace(replace(replace(replace(regexp_replace(regexp_replace(x, '<br ?/?>', ' ', 'g'), '<[^>]*>', '', 'g'), '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&#39;', ''''), '&amp;?', '&', 'g'), '\s+', ' ', 'g'))) AS parts FROM a),
t AS (SELECT page_id, url, array_to_string(list_filter(parts, lambda x: x <> ''), chr(10)) AS text FROM b)
SELECT page_id, url, text, length(text)::BIGINT AS n_chars FROM t
"""


def query(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
