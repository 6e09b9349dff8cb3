"""Operator 10: main-text extraction by a linear-chain conditional random field over DOM leaf blocks.

A page is cut into leaf blocks: stretches of text between block-level tags, each with the tags, classes and ids of its
ancestors. A block's features are its ancestor tags, the words of their classes and ids, its length, the share of it
inside links and its last character; a CRF with the labels boilerplate and main, trained on labelled pages by
stochastic gradient ascent on the likelihood, is decoded by Viterbi, and the main blocks are joined by line feeds.

Labelled pages are those that mark their article themselves (an ``article`` or ``main`` element): blocks in it and in
no navigation, form or the like are main. At most PAGES of them, those with the smallest hash, reach the driver (of
these, pages of over 400 blocks are not learned from). Each
is used as it is and with its parts rewrapped in other ways that pages mark articles, menus, notices, adverts, forms
and comments, so that the model also learns from marks that the sample happens not to show. The weights depend on the
table only through that sample; without labelled pages the rewrapped stock alone is learned from.

Ancestors are shared nodes, each with the features that it adds to those around it, and open elements are found by tag,
so that a page takes time in proportion to its length however deep it nests. An open ``svg`` or ``math`` ends where a
browser leaves it, at the first element of a page's text.

A null html is empty; markup that ends early is closed by the end of the page; ids may be null or repeated, and repeated
rows give equal texts; an empty table gives an empty result; other columns are ignored, whatever their names; long pages
are handled whole, one in memory at a time."""

from __future__ import annotations

import html as entities
import math
import random
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from covary.llm.shared import row_key, slices, table

PAGES = 300
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+|[^>]*)(?:>|\Z)""", re.S)
CLASS = re.compile(r"""\b(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
PART = re.compile(r"[a-z]+")
#: Elements without text of the page. Those of raw text run to their end tag, or without it to the end of the page.
SKIPPED = frozenset("script style template noscript svg math iframe object head title canvas".split())
RAW = frozenset("script style title iframe".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split()
)
#: Which open elements a start tag closes, and where the search for them ends.
CLOSES = {"li": ("li", "ul ol"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "tr": ("tr", "table"), "option": ("option", "select")}
MAIN, OTHER = "article main", "nav footer aside form header menu button select textarea dialog"
NOISE = "ad ads advert banner comment comments cookie menu nav navigation notice promo related share sidebar social sponsored widget footer header breadcrumb newsletter subscribe".split()


#: What ends an open svg or math, but for what their elements for foreign content hold.
LEAVES = frozenset("b big blockquote body br center code dd div dl dt em h1 h2 h3 h4 h5 h6 hr i img li menu ol p pre ruby s small span strong strike sub sup table tt u ul var article section header footer main nav aside form".split())
FOREIGN = "foreignobject desc annotation-xml mtext".split()


class Node:
    """An open block-level element: its tag, its class words and the features that no element around it has."""

    __slots__ = ("fresh", "marks", "parent", "tag")

    def __init__(self, parent: Node | None, tag: str, marks: str, fresh: tuple[str, ...]):
        self.parent, self.tag, self.marks, self.fresh = parent, tag, marks, fresh

    def chain(self) -> Iterator[Node]:
        at: Node | None = self
        while at is not None:
            yield at
            at = at.parent


def own_features(tag: str, marks: str) -> list[str]:
    return [f"a:{tag}", *(f"m:{x}" for x in marks.split())]


def path_of(path: Iterable[tuple[str, str]]) -> Node | None:
    """The innermost node of (tag, class words), outermost first."""
    node, seen = None, set()
    for tag, marks in path:
        fresh = tuple(f for f in own_features(tag, marks) if f not in seen)
        seen.update(fresh)
        node = Node(node, tag, marks, fresh)
    return node


@dataclass
class Block:
    text: str
    node: Node | None  # its innermost ancestor
    linked: int  # characters inside links


class Open:
    """The open elements, by place and by tag."""

    def __init__(self):
        self.tags: list[str] = []
        self.at: dict[str, list[int]] = {}  # places of each tag, ascending
        self.nodes: list[tuple[int, Node]] = []  # block-level ones with their place
        self.held: Counter = Counter()  # features of the block-level ones

    def push(self, tag: str, marks: str = "") -> None:
        place = len(self.tags)
        self.tags.append(tag)
        self.at.setdefault(tag, []).append(place)
        if tag not in INLINE:
            features = own_features(tag, marks)
            self.nodes.append((place, Node(self.node, tag, marks, tuple(f for f in features if not self.held[f]))))
            self.held.update(features)

    @property
    def node(self) -> Node | None:
        return self.nodes[-1][1] if self.nodes else None

    def last(self, *tags: str) -> int:
        """The innermost place of any of these tags, or -1."""
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=-1)

    def close(self, place: int) -> None:
        """Ends the element at a place and all inside it."""
        while len(self.tags) > place:
            self.at[self.tags.pop()].pop()
        while self.nodes and self.nodes[-1][0] >= place:
            node = self.nodes.pop()[1]
            self.held.subtract(own_features(node.tag, node.marks))


def blocks_of(page: str | None) -> list[Block]:
    """The leaf blocks of a page in order; white space is folded and character references decoded."""
    out: list[Block] = []
    stack = Open()
    parts: list[str] = []
    linked = links = 0
    at, page = 0, page or ""

    def flush():
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append(Block(text, stack.node, linked))
            parts.clear()
        linked = 0

    def add(raw: str):
        nonlocal linked
        if raw:
            text = entities.unescape(raw) if "&" in raw else raw
            parts.append(text)
            if links:
                linked += len(text.strip())

    n = len(page)
    while at < n:
        m = TOKEN.search(page, at)
        if not m:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        tag = m[2].lower() if m[2] else ""
        if not tag:
            continue
        if m[1]:
            if tag == "a":
                links = max(0, links - 1)
            if tag not in INLINE:
                flush()
            if (place := stack.last(tag)) >= 0:
                stack.close(place)
            if tag not in INLINE:
                links = len(stack.at.get("a", ()))
            if tag == "br":
                parts.append(" ")
            continue
        if tag in SKIPPED:
            if tag not in INLINE:
                flush()
            if not m[3].rstrip().endswith("/"):
                if tag in RAW:
                    end = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.I).search(page, at)
                    at = end.end() if end else n
                elif tag != "head":
                    at = _passed(page, at, tag, stack)
            continue
        if tag in INLINE or tag in VOID:
            if tag == "br":
                parts.append(" ")
            elif tag in VOID and tag not in INLINE:
                flush()
            if tag == "a":
                links += 1
            if tag not in VOID:
                stack.push(tag)
            continue
        flush()
        if stack.nodes and stack.nodes[-1][1].tag == "p":  # an open paragraph ends where a block begins
            stack.close(stack.nodes[-1][0])
        if tag in CLOSES:
            ended, until = CLOSES[tag]
            if (place := stack.last(*ended.split())) >= 0 and place >= stack.last(*until.split()):
                stack.close(place)
        links = len(stack.at.get("a", ()))
        marks = " ".join(sorted({p for c in CLASS.findall(m[3]) for p in PART.findall(c.lower())})) if m[3] else ""
        if not m[3].endswith("/") or tag not in VOID:
            stack.push(tag, marks)
    flush()
    return out


def _passed(page: str, at: int, tag: str, around: Open) -> int:
    """Where an element that began just before `at` ends: behind its own end tag, or, if that is missing, before the end
    tag of an element around it; svg and math also before what a browser takes for the page's text."""
    opened = Counter({tag: 1})
    for m in TOKEN.finditer(page, at):
        name = m[2].lower() if m[2] else ""
        if not name:
            continue
        if not m[1] and name in LEAVES and tag in ("svg", "math") and not any(opened[f] for f in FOREIGN):
            return m.start()
        if name in VOID:
            continue
        if not m[1]:
            opened[name] += not m[3].rstrip().endswith("/")
        elif opened[name]:
            opened[name] -= 1
            if not opened[tag]:
                return m.end()
        elif around.last(name) >= 0:
            return m.start()
    return len(page)


def path_features(node: Node | None) -> list[str]:
    every = {f for x in node.chain() for f in x.fresh} if node else set()
    return [*sorted(every), f"t:{node.tag if node else ''}"]


def text_features(b: Block) -> list[str]:
    words = b.text.count(" ") + 1
    share = b.linked / max(1, len(b.text))
    return [f"w:{min(6, words.bit_length())}", f"l:{0 if share < 0.05 else 1 if share < 0.5 else 2}", f"e:{b.text[-1] in '.!?…:'}", f"c:{'©' in b.text}"]


@dataclass
class Model:
    weights: dict[str, float]
    turn: list[float] = field(default_factory=lambda: [0.0, 0.0, 0.0, 0.0])  # from*2 + to
    start: list[float] = field(default_factory=lambda: [0.0, 0.0])

    def emission(self, b: Block, known: dict[Node, float] | None = None) -> float:
        """The score of main over boilerplate; known are the sums of a page's nodes, each made of that around it."""
        known = {} if known is None else known
        new = []
        for x in b.node.chain() if b.node else ():
            if x in known:
                break
            new.append(x)
        for x in reversed(new):
            known[x] = (known[x.parent] if x.parent else 0.0) + sum(self.weights.get(f, 0.0) for f in x.fresh)
        last = f"t:{b.node.tag if b.node else ''}"
        return (known[b.node] if b.node else 0.0) + sum(self.weights.get(f, 0.0) for f in (last, *text_features(b)))

    def decode(self, blocks: list[Block]) -> list[int]:
        """Viterbi."""
        if not blocks:
            return []
        t00, t01, t10, t11 = self.turn
        known: dict[Node, float] = {}
        e = self.emission(blocks[0], known)
        s0, s1, back = self.start[0], self.start[1] + e, []
        for b in blocks[1:]:
            e = self.emission(b, known)
            a, c = s0 + t00, s1 + t10
            d, f = s0 + t01, s1 + t11
            back.append((a < c, d <= f))
            s0, s1 = max(a, c), max(d, f) + e
        y = [int(s1 > s0)]
        for step in reversed(back):
            y.append(int(step[y[-1]]))
        return y[::-1]

    def extract(self, page: str | None) -> str:
        blocks = blocks_of(page)
        return "\n".join(b.text for b, y in zip(blocks, self.decode(blocks), strict=True) if y)


def own_label(b: Block) -> int:
    """1 in an element that marks the article and in none, nor under a mark, that is never part of it."""
    chain = list(b.node.chain()) if b.node else []
    tags = {x.tag for x in chain}
    inside = any(t in tags for t in MAIN.split())
    noise = any(t in tags for t in OTHER.split()) or any(w in NOISE for x in chain for w in x.marks.split())
    return int(inside and not noise)


def rewrapped(blocks: list[Block], y: list[int], r: random.Random) -> tuple[list[Block], list[int]]:
    """The same blocks under other marks for the article and for what surrounds or interrupts it."""
    home = r.choice([(), (("article", ""),), (("main", ""),), (("main", ""), ("article", "")), (("div", "article body"),), (("div", "content"),), (("div", "post"), ("div", "entry content")), (("section", "story"),), (("div", "main"), ("div", "text")), (("article", "post"), ("section", ""))])
    top = r.choice([((("html", ""), ("body", ""))), ((("html", ""), ("body", ""), ("div", "page wrapper")))])
    wrap = lambda *x: (*top, *x)
    noise = [
        (("nav", ""), ("ul", ""), ("li", "")), (("header", ""),), (("header", "site header"), ("div", "")), (("div", "menu"), ("ul", ""), ("li", "")), (("aside", ""),), (("aside", "sidebar"), ("p", "")),
        (("div", "sidebar"), ("p", "")), (("div", "ad"),), (("div", "advert banner"),), (("div", "cookie notice"), ("p", "")), (("div", "notice"),), (("form", ""),), (("form", "search"), ("p", "")), (("form", "newsletter subscribe"), ("div", "")),
        (("div", "comments"), ("div", "comment"), ("p", "")), (("section", "comments"), ("p", "")), (("ol", "comment list"), ("li", "comment"), ("p", "")), (("footer", ""),), (("footer", "site footer"), ("p", "")), (("div", "footer"), ("p", "")), (("div", "related"), ("ul", ""), ("li", "")),
        (("div", "share social"),), (("div", "promo sponsored"), ("p", "")), (("div", "breadcrumb"),), (("div", "widget"), ("h3", "")), (("button", ""),), (("dialog", ""), ("p", "")),
    ]
    leaf = lambda: r.choice([("p", ""), ("p", ""), ("p", ""), ("h1", ""), ("h2", ""), ("h3", ""), ("blockquote", ""), ("li", ""), ("div", ""), ("td", ""), ("pre", ""), ("figcaption", "")])
    body = [b.text for b, k in zip(blocks, y, strict=True) if k] or ["Text."]
    rest = [b.text for b, k in zip(blocks, y, strict=True) if not k] or ["Menu"]
    out: list[tuple[Block, int]] = []

    def put_noise(inside: tuple = ()):
        kind = r.choice(noise)
        for _ in range(r.randint(1, 4)):
            text = r.choice(rest if r.random() < 0.6 else body)
            link = len(text) if r.random() < 0.4 else 0
            out.append((Block(text, path_of(wrap(*inside, *kind)), link), 0))

    for _ in range(r.randint(1, 4)):
        put_noise()
    for text in body:
        own = leaf()
        more = (("ul", ""),) if own[0] == "li" else (("table", ""), ("tr", "")) if own[0] == "td" else ()
        out.append((Block(text, path_of(wrap(*home, *more, own)), 0), 1))
        if r.random() < 0.06:
            put_noise(home)
    for _ in range(r.randint(1, 4)):
        put_noise(home if r.random() < 0.2 else ())
    return [b for b, _ in out], [k for _, k in out]


STOCK = ["Home", "About us", "Log in", "Accept all cookies to go on.", "Read more", "Subscribe to our letter", "Terms and privacy", "A reader wrote: I don't agree at all with this.", "© 2020 Example"]
PROSE = ["The town met in the old hall.", "On the first day of the week the council spoke about the new bridge, which many had asked for, and closed the talk late in the evening.", "A short line", "Nobody had an answer."]


def train(pages: list[str], epochs: int = 8, rate: float = 0.5, l2: float = 1e-5) -> Model:
    """Maximum likelihood by AdaGrad, sequence by sequence."""
    r = random.Random(11)
    data: list[tuple[list[Block], list[int]]] = []
    for page in pages:
        blocks = blocks_of(page)
        y = [own_label(b) for b in blocks]
        if any(y):
            data.append((blocks, y))
    stock = [Block(t, None, 0) for t in STOCK + PROSE]
    bases = [d for d in data if len(d[0]) <= 200] or [(stock, [0] * len(STOCK) + [1] * len(PROSE))]
    data = [d for d in data if len(d[0]) <= 400] + [rewrapped(*bases[i % len(bases)], r) for i in range(900)]
    index: dict[str, int] = {}
    rows = []
    for blocks, y in data:
        f = [[index.setdefault(x, len(index)) for x in (*path_features(b.node), *text_features(b))] for b in blocks]
        rows.append((f, y))
    w, g2 = np.zeros(len(index) + 6), np.full(len(index) + 6, 1e-6)
    base = len(index)
    for _ in range(epochs):
        for i in r.sample(range(len(rows)), len(rows)):
            f, y = rows[i]
            n = len(y)
            e = [float(w[x].sum()) for x in f]
            t, s = w[base : base + 4].tolist(), w[base + 4 :].tolist()
            fw = [(s[0], s[1] + e[0])]
            for k in range(1, n):
                a, b = fw[-1]
                fw.append((_log_sum(a + t[0], b + t[2]), _log_sum(a + t[1], b + t[3]) + e[k]))
            bw = [(0.0, 0.0)] * n
            for k in range(n - 2, -1, -1):
                c, d = bw[k + 1]
                d += e[k + 1]
                bw[k] = (_log_sum(t[0] + c, t[1] + d), _log_sum(t[2] + c, t[3] + d))
            z = _log_sum(*fw[-1])
            grad: dict[int, float] = {}
            for k in range(n):
                miss = y[k] - math.exp(fw[k][1] + bw[k][1] - z)
                if abs(miss) > 1e-7:
                    for x in f[k]:
                        grad[x] = grad.get(x, 0.0) + miss
                if k:
                    for a in (0, 1):
                        for b in (0, 1):
                            p = math.exp(fw[k - 1][a] + t[2 * a + b] + (e[k] if b else 0.0) + bw[k][b] - z)
                            at = base + 2 * a + b
                            grad[at] = grad.get(at, 0.0) + (y[k - 1] == a and y[k] == b) - p
            for a in (0, 1):
                grad[base + 4 + a] = (y[0] == a) - math.exp(fw[0][a] + bw[0][a] - z)
            at = np.fromiter(grad, np.int64, len(grad))
            g = np.fromiter(grad.values(), float, len(grad)) - l2 * w[at]
            g2[at] += g * g
            w[at] += rate * g / np.sqrt(g2[at])
    return Model({f: float(w[k]) for f, k in index.items()}, w[base : base + 4].tolist(), w[base + 4 :].tolist())


def _log_sum(a: float, b: float) -> float:
    return a + math.log1p(math.exp(b - a)) if a >= b else b + math.log1p(math.exp(a - b))


def labelled_sample(pages: DataFrame, most: int = PAGES, longest: int = 60_000) -> list[str]:
    """The html of at most `most` pages that mark their article (and are no longer than `longest`), by least hash."""
    marked = pages.where(F.col("html").rlike("(?i)<(article|main)[ >]") & (F.length("html") <= longest))
    keys = marked.select(row_key(F.col("page_id"), F.col("html")).alias("key")).distinct().orderBy("key").limit(most)
    keyed = pages.select(row_key(F.col("page_id"), F.col("html")).alias("key"), "html")
    got = keyed.join(F.broadcast(keys), "key", "left_semi").dropDuplicates(["key"]).orderBy("key")
    return [r["html"] for r in got.limit(most).collect()]


def extract(pages: DataFrame, model: Model) -> DataFrame:
    """(page_id, url, text) of every page."""

    def run(batches):
        for b in slices(batches):
            texts = [model.extract(h.as_py()) for h in b.column(2)]
            yield pa.record_batch([b.column(0), b.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kind}, url string, text string")


def query(spark, sf_dir: str) -> DataFrame:
    """op10: every page's main text."""
    pages = table(spark, sf_dir, "pages")
    return extract(pages, train(labelled_sample(pages))).withColumn("n_chars", F.char_length("text").cast("bigint"))
