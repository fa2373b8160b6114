"""Main text of web pages by minimum-cut labelling (operator 6).

A tolerant parser cuts a page into blocks of text. A classifier gives each block
a cost for either label; the costs become terminal capacities (source side for
content, sink side for boilerplate). Neighbours in page order are tied by
smoothness edges that weaken with their distance in the document tree, and
blocks under one parent are tied too. The maximum flow between the terminals
gives the cut of least cost, and blocks on the source side are the main text.

The classifier adds two parts. Measures of the text (length, links, ends of
sentences, kind of element, place in the page) go through a logistic regression
that is fitted on a bounded sample of the pages themselves: blocks inside an
article or main element are its positives, blocks inside navigation, footers and
the like its negatives, and those elements are no inputs. Without such pages
``WEIGHTS`` are used as they are. The element names around a block add fixed
log-odds: a name outweighs the neighbours only where it is unmistakable
(``nav``, ``sidebar``, ``cookie-banner``); a name that only holds such a word
(``side-by-side``, ``more-content``) is weak evidence that a block's text and its
neighbours can outvote.

Scripts, styles, templates, the head and hidden elements never make blocks.
Character references are decoded, white space inside a block becomes one space,
and blocks are joined in page order by one space.

Defined results: null and empty pages give the empty text; markup that never
closes is read to the end of the page, and elements may nest to any depth; a
page without any content evidence gives the blocks that the text measures
favour, or the empty text; repeated rows are extracted each; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Sequence
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("head title script style noscript template svg math canvas iframe object audio video map datalist textarea select button".split())
ENDS_P = BLOCKS - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "option", "legend", "summary"}
LIKE = {"li": "li", "dt": "dd", "dd": "dd", "option": "option", "tr": "tr", "td": "td", "th": "td"}
BARS = {"li": {"ul", "ol", "menu"}, "dd": {"dl"}, "option": {"select"}, "tr": {"table"}, "td": {"tr", "table"}}
MAIN_TAGS = frozenset(("article", "main"))
BOILER_TAGS = frozenset("nav footer aside form menu dialog".split())
#: Boilerplate around the main element, but not inside it.
SOFT_TAGS = frozenset("header address fieldset".split())
BOILER_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar form".split())
BOILER_WORDS = re.compile(
    r"^(ads?|advert\w*|adverts|adsense|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notices?|notification|alerts?|popup|modal|overlay|side|sidebar\w*|rail|widgets?|related|recommend\w*|recirc|trending|popular|share|sharing|social|comments?|commentlist|disqus|replies|reply|respond|discussion|breadcrumbs?|crumbs|menus?|nav|navbar|navigation|footer\w*|foot|toolbar|subscribe|subscription|newsletter|signup|login|paywall|search\w*|pager|pagination|paging|outbrain|taboola)$"
)
SOFT_WORDS = re.compile(r"^(header\w*|masthead|topbar|copyright|legal|disclaimer|tags?|taglist|skip|print|meta|byline|author\w*|bio|more|toc|hidden)$")
CONTENT_WORDS = re.compile(r"^(article\w*|content|post|entry|story|main|body|text|maintext|articlebody)$")
#: Words that name a place or a shape; the word before them says what it is.
SHAPES = re.compile(r"^(area|articles|bar|block|box|col|column|container|group|holder|inner|item|items|left|link|links|list|outer|news|panel|posts|region|right|row|section|slot|stories|unit|wrap|wrapper|\d+)$")
#: Words that make a name a phrase.
JOINTS = frozenset("and by for from in of on the to with".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre".split())
LISTED = frozenset("li dd dt td th option".split())
#: Tenths of log-odds: names that are unmistakable, that only hold such a word, that stand around the main element; being inside and outside of it; names of content.
STRONG, WEAK, SOFT, INSIDE, OUTSIDE, NAMED = 60, 8, 30, 16, 22, 8
#: Smoothness: neighbours in page order by the steps between their elements, and blocks under one parent.
NEXT, FAR, SIBLING = (8, 7, 6, 4, 3, 2), 1, 4
#: Text measures: bias, length, length again above 25 characters, linked share, end of a sentence, prose element, list or cell, ownership mark, start and end of the page.
WEIGHTS = (-1.2, 0.25, 0.35, -4.0, 0.8, 1.2, -0.6, -2.0, -0.3, -0.3)
#: Pages that the text weights are fitted on, at most; the most that a text may weigh, and from how many characters on.
FIT_PAGES, TEXT_MOST, LONG = 2000, 22, 80


def named(attributes: dict) -> tuple[bool, bool, bool, bool]:
    """(unmistakable boilerplate, boilerplate's word, soft, content) of an element's class names and id."""
    strong = weak = soft = content = False
    for name in f"{attributes.get('class') or ''} {attributes.get('id') or ''}".split():
        words = [w for w in re.split(r"[^a-z0-9]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", name).lower()) if w]
        boiler = [w for w in words if BOILER_WORDS.match(w)]
        soft = soft or any(SOFT_WORDS.match(w) for w in words) and not any(CONTENT_WORDS.match(w) for w in words[-1:])
        if not boiler:
            content = content or any(CONTENT_WORDS.match(w) for w in words)
            continue
        head = [w for w in words if not SHAPES.match(w)][-1]
        if BOILER_WORDS.match(head) and not JOINTS.intersection(words):
            strong = True
        else:
            weak = True
    return strong, weak, soft, content and not strong


class Node:
    __slots__ = ("tag", "parent", "number", "strong", "weak", "soft", "content", "hidden", "main")

    def __init__(self, tag: str, parent: Node | None, attributes: dict, number: int):
        self.tag, self.parent, self.number = tag, parent, number
        self.strong, self.weak, self.soft, self.content = named(attributes) if "class" in attributes or "id" in attributes else (False,) * 4
        role = (attributes.get("role") or "").lower()
        self.strong = self.strong or tag in BOILER_TAGS or role in BOILER_ROLES
        self.soft = self.soft or tag in SOFT_TAGS
        self.main = not self.strong and (tag in MAIN_TAGS or role in ("main", "article") or attributes.get("itemprop") == "articleBody")
        self.content = self.content or self.main
        self.hidden = tag in SILENT or "hidden" in attributes or attributes.get("aria-hidden") == "true" or "display:none" in (attributes.get("style") or "").replace(" ", "").lower()


class Block:
    __slots__ = ("node", "text", "linked")

    def __init__(self, node: Node, text: str, linked: int):
        self.node, self.text, self.linked = node, text, linked


class PageParser(HTMLParser):
    """Blocks of text in page order."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.nodes = [Node("", None, {}, 0)]
        self.stack = [self.nodes[0]]
        self.open: Counter = Counter()
        self.blocks: list[Block] = []
        self.buffer: list[str] = []
        self.linked = self.silent = self.links = 0

    def flush(self) -> None:
        if self.buffer:
            text = " ".join("".join(self.buffer).split())
            if text:
                node = self.stack[-1]
                while node.parent is not None and node.tag not in BLOCKS:
                    node = node.parent
                self.blocks.append(Block(node, text, self.linked))
            self.buffer, self.linked = [], 0

    def pop_to(self, depth: int) -> None:
        for node in self.stack[depth:]:
            self.silent -= node.hidden
            self.links -= node.tag == "a"
            self.open[node.tag] -= 1
        del self.stack[depth:]

    def open_at(self, tags, bars=frozenset()) -> int:
        if not any(self.open[t] for t in tags):
            return 0
        for k in range(len(self.stack) - 1, 0, -1):
            tag = self.stack[k].tag
            if tag in tags:
                return k
            if tag in bars:
                break
        return 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in BLOCKS:
            self.flush()
            if tag in ENDS_P and (k := self.open_at(("p",), BLOCKS - {"p"})):
                self.pop_to(k)
            if tag in LIKE:
                kind = LIKE[tag]
                if k := self.open_at([t for t, v in LIKE.items() if v == kind], BARS[kind]):
                    self.pop_to(k)
            if tag == "body" and self.silent:
                self.pop_to(1)
        elif tag == "br":
            self.buffer.append(" ")
        if tag in VOID:
            return
        if tag == "a" and (k := self.open_at(("a",), BLOCKS)):
            self.pop_to(k)
        node = Node(tag, self.stack[-1], dict(attrs), len(self.nodes))
        self.nodes.append(node)
        self.stack.append(node)
        self.open[tag] += 1
        self.silent += node.hidden
        self.links += tag == "a"

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        block = tag in BLOCKS
        if block:
            self.flush()
        if tag == "br":
            self.buffer.append(" ")
        k = self.open_at((tag,), frozenset() if block or tag in SILENT else BLOCKS)
        if k:
            self.pop_to(k)

    def handle_data(self, data: str) -> None:
        if not self.silent:
            self.buffer.append(data)
            if self.links:
                self.linked += len(data)


def parse(html: str) -> tuple[list[Node], list[Block]]:
    """Elements in page order, each after its parent, and blocks in page order."""
    parser = PageParser()
    parser.feed(html)
    parser.close()
    parser.flush()
    return parser.nodes, parser.blocks


def _upwards(nodes: list[Node], values: list[int], damp: bool) -> list[int]:
    """Sums over what is inside each element; damp: what is inside boilerplate counts a quarter."""
    out = list(values)
    for node in reversed(nodes[1:]):
        out[node.parent.number] += out[node.number] // 4 if damp and node.strong else out[node.number]
    return out


def _main_element(nodes: list[Node], blocks: list[Block]) -> Node | None:
    """The element with most text outside boilerplate inside it: an article or main element, else one named as content."""
    own = [0] * len(nodes)
    for b in blocks:
        own[b.node.number] += len(b.text) - b.linked
    held = _upwards(nodes, own, True)
    for marked in (True, False):
        found = [n for n in nodes if n.content and not n.strong and n.main == marked and (marked or n.tag not in ("", "html", "body")) and held[n.number]]
        if found:
            most = max(held[n.number] for n in found)
            near = [n for n in found if held[n.number] >= 0.9 * most]
            # The innermost article or main; the outermost of elements named as content, which holds the title too.
            return near[-1] if marked else near[0]
    return None


def text_measures(blocks: list[Block]) -> np.ndarray:
    """A row of measures for each block, as ``WEIGHTS`` lists them."""
    n = len(blocks)
    rows = []
    for k, b in enumerate(blocks):
        size = len(b.text)
        rows.append((
            1.0, np.log1p(size), max(0.0, np.log(size / 25)), b.linked / size, b.text[-1] in ".!?…»\"”", b.node.tag in PROSE, b.node.tag in LISTED,
            b.text.startswith(("©", "(c)", "Copyright")), max(0.0, 1 - 10 * k / n), max(0.0, 1 - 10 * (n - 1 - k) / n),
        ))
    return np.array(rows, np.float64).reshape(n, len(WEIGHTS))


def surroundings(nodes: list[Node], blocks: list[Block]) -> list[tuple[bool | None, bool, bool, bool, bool]]:
    """For each block: inside the main element (None without one), and strong, weak, soft and content names around it."""
    main = _main_element(nodes, blocks)
    text = [0] * len(nodes)
    for b in blocks:
        text[b.node.number] += len(b.text)
    held = _upwards(nodes, text, False)
    wraps = [False] * len(nodes)
    node = main
    while node is not None:
        wraps[node.number] = True
        node = node.parent
    if main is None:  # what holds most of a page is no boilerplate
        wraps = [h > 0.6 * held[0] for h in held]
    seen: list = [(False,) * 5] * len(nodes)
    for n in nodes:
        inside, strong, weak, soft, content = seen[n.parent.number] if n.parent else seen[0]
        inside = inside or n is main
        own = not wraps[n.number]
        seen[n.number] = inside, strong or own and n.strong, weak or own and n.weak, soft or own and n.soft and not inside, content or n.content
    return [((None if main is None else seen[b.node.number][0]), *seen[b.node.number][1:]) for b in blocks]


def evidence(nodes: list[Node], blocks: list[Block], weights: Sequence[float] = WEIGHTS) -> list[int]:
    """Capacity of each block in tenths of log-odds: to the source if positive, to the sink if negative."""
    # A short block says less of itself than a long one.
    most = TEXT_MOST * np.minimum(1, 0.4 + 0.6 * np.array([len(b.text) for b in blocks]) / LONG)
    text = np.clip(10 * (text_measures(blocks) @ np.asarray(weights)), -most, most).astype(int).tolist()
    out = []
    for t, (inside, strong, weak, soft, content) in zip(text, surroundings(nodes, blocks)):
        place = 0 if inside is None else INSIDE if inside else -OUTSIDE
        out.append(t + place - STRONG * strong - WEAK * weak - SOFT * soft + NAMED * content)
    return out


def _steps(a: Node, b: Node, most: int) -> int:
    """Elements between two elements by way of the one that holds both, counted up to most."""
    steps = 0
    while a is not b and steps < most:
        if a.number > b.number:
            a = a.parent
        else:
            b = b.parent
        steps += 1
    return steps if a is b else most


def ties(blocks: list[Block]) -> list[tuple[int, int, int]]:
    """Smoothness edges (a, b, weight)."""
    last: dict[int, int] = {}
    edges = []
    for i, b in enumerate(blocks):
        if i:
            k = _steps(blocks[i - 1].node, b.node, len(NEXT))
            edges.append((i - 1, i, NEXT[k] if k < len(NEXT) else FAR))
        parent = id(b.node.parent)
        if parent in last:
            edges.append((last[parent], i, SIBLING))
        last[parent] = i
    return edges


def settle(capacity: list[int], edges: list[tuple[int, int, int]]) -> list[bool | None]:
    """Sides of the nodes that outweigh all their undecided ties, one after the other; None for the rest."""
    near: list[list[tuple[int, int]]] = [[] for _ in capacity]
    for a, b, w in edges:
        near[a].append((b, w))
        near[b].append((a, w))
    pull, free = list(capacity), [sum(w for _, w in x) for x in near]
    side: list[bool | None] = [None] * len(capacity)
    todo = list(range(len(capacity)))
    while todo:
        i = todo.pop()
        if side[i] is not None or -free[i] < pull[i] <= free[i]:
            continue
        side[i] = pull[i] > 0
        for j, w in near[i]:
            if side[j] is None:
                free[j] -= w
                pull[j] += w if side[i] else -w
                todo.append(j)
    return side


def minimum_cut(capacity: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """Nodes on the source side of a minimum cut (Dinic's algorithm).

    capacity: positive from the source, negative to the sink; edges (a, b, weight) both ways.
    """
    n = len(capacity)
    source, sink = n, n + 1
    to, left, graph = [], [], [[] for _ in range(n + 2)]

    def join(a: int, b: int, there: int, back: int) -> None:
        graph[a].append(len(to))
        to.append(b)
        left.append(there)
        graph[b].append(len(to))
        to.append(a)
        left.append(back)

    for i, c in enumerate(capacity):
        if c > 0:
            join(source, i, c, 0)
        elif c < 0:
            join(i, sink, -c, 0)
    for a, b, w in edges:
        join(a, b, w, w)
    while True:
        level = [-1] * (n + 2)
        level[source], queue = 0, [source]
        for v in queue:
            for e in graph[v]:
                if left[e] and level[to[e]] < 0:
                    level[to[e]] = level[v] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [level[i] >= 0 for i in range(n)]
        at, path, v = [0] * (n + 2), [], source
        while True:
            if v == sink:
                flow = min(left[e] for e in path)
                for k, e in enumerate(path):
                    left[e] -= flow
                    left[e ^ 1] += flow
                k = next(k for k, e in enumerate(path) if not left[e])
                v = to[path[k] ^ 1]
                del path[k:]
                continue
            while at[v] < len(graph[v]):
                e = graph[v][at[v]]
                if left[e] and level[to[e]] == level[v] + 1:
                    break
                at[v] += 1
            if at[v] < len(graph[v]):
                path.append(graph[v][at[v]])
                v = to[path[-1]]
            elif v == source:
                break
            else:
                level[v] = -1
                v = to[path.pop() ^ 1]


def cut(capacity: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """Minimum cut: nodes that outweigh their ties first, the maximum flow over the rest."""
    side = settle(capacity, edges)
    rest = [i for i, s in enumerate(side) if s is None]
    if rest:
        number, pull, inner = {i: k for k, i in enumerate(rest)}, [capacity[i] for i in rest], []
        for a, b, w in edges:
            if a in number and b in number:
                inner.append((number[a], number[b], w))
            elif a in number or b in number:
                free, fixed = (a, b) if a in number else (b, a)
                pull[number[free]] += w if side[fixed] else -w
        for i, s in zip(rest, minimum_cut(pull, inner)):
            side[i] = s
    return [bool(s) for s in side]


def labelled(html: str, weights: Sequence[float] = WEIGHTS) -> list[tuple[str, bool]]:
    """Blocks of a page in order, each with whether it is content."""
    nodes, blocks = parse(html)
    if not blocks:
        return []
    return [(b.text, s) for b, s in zip(blocks, cut(evidence(nodes, blocks, weights), ties(blocks)))]


def main_text(html: str, weights: Sequence[float] = WEIGHTS) -> str:
    return " ".join(text for text, content in labelled(html, weights) if content)


def self_labelled(html: str) -> tuple[np.ndarray, np.ndarray]:
    """Text measures and labels of the blocks that a page's article, main and boilerplate elements label."""
    nodes, blocks = parse(html)
    around = surroundings(nodes, blocks) if any(n.main for n in nodes) else []
    told = [k for k, (inside, strong, weak, soft, _) in enumerate(around) if inside is not None and (strong or inside and not weak and not soft)]
    labels = np.array([bool(around[k][0] and not around[k][1]) for k in told], np.float64)
    return text_measures(blocks)[told], labels


def fitted(x: np.ndarray, y: np.ndarray, pull: float = 0.02, rounds: int = 30) -> np.ndarray:
    """Logistic regression by Newton's method, both labels weighing the same, drawn towards ``WEIGHTS``."""
    prior = np.array(WEIGHTS)
    good, bad = y.sum(), len(y) - y.sum()
    if not good or not bad:
        return prior
    share = np.where(y == 1, 0.5 / good, 0.5 / bad) * len(y)
    w = prior.copy()
    for _ in range(rounds):
        p = 0.5 * (1 + np.tanh(0.5 * np.clip(x @ w, -30, 30)))
        slope = x.T @ (share * (p - y)) + pull * len(y) * (w - prior)
        step = np.linalg.solve((x * (share * p * (1 - p))[:, None]).T @ x + pull * len(y) * np.eye(len(w)), slope)
        w = w - step
        if np.abs(step).max() < 1e-9:
            break
    return w


def fit(pages: DataFrame, html_col: str = "html", fit_pages: int = FIT_PAGES) -> np.ndarray:
    """Text weights from at most fit_pages distinct pages, those of the least hashes."""
    html = F.col(html_col).cast("string")
    found = common.least_hashed(pages.where(html.isNotNull()).select(html.alias("text")), fit_pages, lambda t: [x.ravel().tolist() for x in self_labelled(t)], "x array<array<double>>", "x")
    if not found:
        return np.array(WEIGHTS)
    x, y = np.concatenate([np.array(a) for a, _ in found]).reshape(-1, len(WEIGHTS)), np.concatenate([np.array(b) for _, b in found])
    return fitted(x, y)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", weights: Sequence[float] | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) of every page; text weights are fitted on the pages if none are given."""
    kinds = [pages.schema[c].dataType.simpleString() for c in (id_col, url_col)]
    weights = fit(pages, html_col) if weights is None else weights

    def run(batch: pa.RecordBatch) -> dict:
        texts = [main_text(h, weights) for h in common.strings(batch.column(2))]
        return {"page_id": batch.column(0), "url": batch.column(1), "text": texts, "n_chars": [len(t) for t in texts]}

    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("text"))
    return common.arrow_map(rows, run, f"page_id {kinds[0]}, url {kinds[1]}, text string, n_chars long")


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(common.table(spark, sf_dir, "pages"))
