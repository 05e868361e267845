"""Main text of web pages by a minimum cut.

A page is cut into blocks: the text between block-level tags. A block's log-odds of being content are a
logistic model of the block by itself (length, links, punctuation, kind of element), bounded by
``TEXT_LIMIT``, and what the nearest element around it that says what it holds adds (an article, a menu, an
advert). Positive odds are the block's capacity to the content terminal, negative ones to the boilerplate
terminal. Blocks that follow each other, and blocks of the same container, are joined by smoothness edges that
halve with each further step between them in the DOM. The minimum cut labels all blocks: a heading or a word or
two among paragraphs goes with them, and so does a paragraph whose class misleads; a menu or an advert keeps its
label, because few edges lead to it or because it is named and its text doesn't speak for it.

The logistic model is fitted on a bounded sample of pages (``SAMPLE_PAGES``), with the elements' evidence
as labels, and drawn towards ``PRIOR``, which is all there is where a sample has one kind of block only.

Defined results: null or empty html, or a page without content blocks, gives an empty text. Character
references are decoded; white space inside a block becomes one space; blocks are joined by one newline in
page order. Tags that are never closed end with their parent; of elements that hold no text of the page (buttons,
pictures, selections) one without an end goes to the next block. ``/>`` closes nothing but void and SVG elements, and a
script that no other tag closes. Formulas are text. Repeated rows give repeated results.
"""

from __future__ import annotations

import html
import math
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.llm.common import pieces, table, texts, tidy, unsigned_share

SAMPLE_PAGES = 400
#: What the nearest element that says what it holds adds to the log-odds: articles, names of boilerplate, tags of it.
CONTENT_EVIDENCE, BOILER_NAMED, BOILER_TAGGED = 2.0, -4.0, -5.0
#: The text's log-odds stay within this.
TEXT_LIMIT = 3.0
#: Capacity of the edge between siblings that follow each other and between other blocks of a container; DOM steps beyond which there is none.
NEXT_TO, SAME_PARENT, FAR = 1.0, 0.5, 8
#: Weights of ``features`` that the fit is drawn to.
PRIOR = np.array([-0.5, 0.8, -4.0, 0.5, 0.0, 0.5, 1.0, 1.0, -0.5])
#: How strongly, as a share of the sample's blocks: no element of a sample that is all of one make decides alone.
RIDGE = 0.005
SCALE = 100

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<[!?][^>]*>""", re.S)
_ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?(?=\s|/|$)""", re.I)
_NAMES = re.compile(r"[a-z]+")
#: Elements whose contents are no markup, and those whose contents are but aren't text of the page; of these some may lie in their like.
RAW = frozenset("script style iframe textarea title noframes noembed xmp".split())
MUTE = frozenset("button select svg video audio object canvas template noscript datalist annotation annotation-xml".split())
NESTING = frozenset("svg object template".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_MUTED = re.compile(rf"<(/?)({'|'.join(sorted(MUTE, key=len, reverse=True))})(?=[\s/>])", re.I)
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html "
    "legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: An opening tag of the first kind ends an open one of the second.
CLOSES = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}}
CLOSES |= {t: {"p"} for t in BLOCK - CLOSES.keys() - {"body", "html"}}
#: Where the search for an open tag to end stops.
HOLDS = frozenset("article aside body div dl fieldset footer form header main menu nav ol section table ul blockquote figure details dialog".split())
BOILER_TAGS = frozenset("nav aside footer form menu dialog header".split())
CONTENT_TAGS = frozenset("article main".split())
BOILER_NAMES = frozenset(
    "ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments consent contentinfo cookie cookies dialog disclaimer disqus footer form gdpr header "
    "hidden login masthead menu modal nav navbar navigation newsletter notice notification pager pagination popup promo promotion recommended related replies reply respond search "
    "share sharing sidebar signup skip social sponsor sponsored subscribe tags toc toolbar widget alert complementary".split()
)
CONTENT_NAMES = frozenset("article body content entry main post story text".split())


class Element:
    """An open or closed element: where it hangs and how deep."""

    __slots__ = ("parent", "depth")

    def __init__(self, parent: Element | None = None):
        self.parent, self.depth = parent, parent.depth + 1 if parent else 0


def steps(a: Element, b: Element, most: int = FAR) -> int:
    """Steps from ``a`` to ``b`` through the DOM; ``most`` + 1 for all that are farther."""
    n = 0
    while a is not b and n <= most:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
        n += 1
    return n


@dataclass
class Block:
    holder: Element
    evidence: float
    tag: str
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    text: str = ""


def _said(name: str) -> set[str]:
    """The words of a class or id that tell what is held. A name that begins with content and doesn't end with boilerplate
    (``article-footer-note``) is about a part of the content: boilerplate within it says nothing, nor does the content then."""
    words = _NAMES.findall(name)
    if len(words) > 1 and words[0] in CONTENT_NAMES and words[-1] not in BOILER_NAMES and BOILER_NAMES.intersection(words):
        return set(words) - BOILER_NAMES - CONTENT_NAMES
    return set(words)


def _closed(page: str) -> set[int]:
    """Where the ``MUTE`` elements begin that have an end of their own."""
    found: set[int] = set()
    waiting: dict[str, list[int]] = {}
    for m in _MUTED.finditer(page):
        tag = m[2].lower()
        begun = waiting.setdefault(tag, [])
        if not m[1]:
            if tag not in NESTING:
                begun.clear()
            begun.append(m.start())
        elif begun:
            found.add(begun.pop())
    return found


def _evidence(tag: str, attributes: str, inside_article: bool) -> float:
    """What an element says about what it holds: above 0 content, below 0 boilerplate, 0 nothing."""
    if tag in BOILER_TAGS and not (inside_article and tag == "header"):
        return BOILER_TAGGED
    names: set[str] = set()
    if attributes:
        for name, a, b, c in _ATTRIBUTE.findall(attributes):
            if name.lower() in ("hidden", "aria-hidden"):
                names |= {"hidden"} if (a or b or c).lower() != "false" else set()
            else:
                for one in (a or b or c).lower().split():
                    names |= _said(one)
    if tag not in ("body", "html") and names & BOILER_NAMES and not (inside_article and names & {"header"} and not names & (BOILER_NAMES - {"header"})):
        return BOILER_NAMED
    if tag in CONTENT_TAGS or (tag not in ("body", "html") and names & CONTENT_NAMES):
        return CONTENT_EVIDENCE
    return 0.0


def blocks_of(page: str) -> list[Block]:
    """The page's blocks that have text, in order."""
    out: list[Block] = []
    stack: list[tuple[str, Element, float, bool, int]] = [("", Element(), 0.0, False, 0)]  # tag, element, nearest evidence, inside an article, mute
    links, mute, at = 0, 0, 0
    closed: set[int] | None = None
    now: Block | None = None

    def end() -> None:
        nonlocal now
        if now is not None:
            now.text = " ".join(html.unescape("".join(now.parts)).split())
            if now.text:
                out.append(now)
        now = None

    def say(text: str) -> None:
        nonlocal now
        if mute:
            return
        if now is None:
            if not text.strip():
                return
            holder = next((s for s in reversed(stack) if s[0] in BLOCK or not s[0]), stack[0])
            now = Block(holder[1], stack[-1][2], holder[0])
        now.parts.append(text)
        if links:
            now.linked += len(text)

    def leave(k: int) -> None:
        """Close all that is open from ``k`` on."""
        nonlocal links, mute
        for gone in stack[k:]:
            links -= gone[0] == "a"
            mute -= gone[4] > 0
        del stack[k:]

    def after_raw(tag: str, attributes: str) -> int:
        """Where the page goes on after an element whose contents are no markup."""
        close = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(page, at)
        if attributes.rstrip().endswith("/") and (close is None or re.compile(rf"<{tag}[\s/>]", re.I).search(page, at, close.start())):
            return at  # written as if it could close itself, and nothing else closes it
        if close:
            return close.end()
        for s in reversed(stack[1:]):  # never closed: it ends with its parent
            if over := re.compile(rf"</{re.escape(s[0])}[\s>]", re.I).search(page, at):
                return over.start()
        return size

    size = len(page)
    while at < size:
        found = _TOKEN.search(page, at)
        if found is None:
            say(page[at:])
            break
        if found.start() > at:
            say(page[at : found.start()])
        at = found.end()
        tag = (found[2] or "").lower()
        if not tag:
            continue
        if mute and tag in BLOCK and tag not in ("option", "optgroup"):  # a mute element without an end ends here
            k = next((k for k, s in enumerate(stack) if s[4]), 0)
            if stack[k][4] == 2:
                leave(k)
        if found[1]:
            if tag in BLOCK:
                end()
            if any(s[0] == tag for s in stack):
                leave(max(k for k, s in enumerate(stack) if s[0] == tag))
            elif tag == "br":
                say(" ")
            continue
        if tag == "body" and any(s[0] == "head" for s in stack):
            leave(1)
        if tag in RAW:
            at = after_raw(tag, found[3])
            continue
        if tag == "head":
            close = re.compile(r"</head\s*>|<body[\s>]", re.I).search(page, at)
            if close:
                at = close.start() if close[0].lower().startswith("<body") else close.end()
            continue
        if tag in MUTE:
            if tag == "svg" and found[3].rstrip().endswith("/"):
                continue
            closed = _closed(page) if closed is None else closed
            stack.append((tag, Element(stack[-1][1]), stack[-1][2], stack[-1][3], 1 if found.start() in closed else 2))
            mute += 1
            continue
        if tag in BLOCK and not mute:
            end()
        elif tag == "br":
            say(" ")
        if tag in VOID:
            continue
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][0] in CLOSES.get(tag, ()):
                leave(k)
            elif stack[k][0] in HOLDS or stack[k][4]:
                break
        _, parent, before, article, _ = stack[-1]
        own = _evidence(tag, found[3], article)
        stack.append((tag, Element(parent), own if own and not (before < 0 < own) else before, article or tag == "article", 0))
        links += tag == "a"
    end()
    return out


def features(block: Block) -> list[float]:
    """What a block by itself tells; its neighbours speak through the cut."""
    text, tag = block.text, block.tag
    n = len(text)
    words = text.count(" ") + 1
    marks = text.count(".") + text.count(",") + text.count("?") + text.count("!")
    return [
        1.0, math.log1p(n) - 4.0, min(1.0, block.linked / n), min(1.0, 10.0 * marks / n), min(3.0, n / words / 6.0) - 1.0, float(text[-1] in ".!?\"”»"),
        float(tag[:1] == "h" and tag[1:].isdigit()), float(tag in ("p", "pre", "blockquote", "dd", "td")), float(tag in ("li", "option", "dt", "th")),
    ]


def fit(x: np.ndarray, y: np.ndarray, share: float = RIDGE, prior: np.ndarray = PRIOR) -> np.ndarray:
    """Logistic regression by Newton steps, classes weighted alike and weights drawn to ``prior`` (by ``share`` of the rows); that itself if one class is missing."""
    w = prior.copy()
    if not len(y) or y.min() == y.max():
        return w
    ridge = share * len(y)
    heft = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (heft * (y - p)) - ridge * (w - prior)
        curve = (x.T * (heft * p * (1 - p))) @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(curve, slope)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


class Network:
    """Maximum flow by Dinic's algorithm; capacities are whole numbers."""

    def __init__(self, n: int):
        self.to: list[int] = []
        self.room: list[int] = []
        self.leaving: list[list[int]] = [[] for _ in range(n)]

    def edge(self, a: int, b: int, there: int, back: int = 0) -> None:
        self.leaving[a].append(len(self.to))
        self.leaving[b].append(len(self.to) + 1)
        self.to += [b, a]
        self.room += [there, back]

    def _levels(self, source: int) -> list[int]:
        level = [-1] * len(self.leaving)
        level[source] = 0
        waiting = deque([source])
        while waiting:
            a = waiting.popleft()
            for e in self.leaving[a]:
                b = self.to[e]
                if self.room[e] and level[b] < 0:
                    level[b] = level[a] + 1
                    waiting.append(b)
        return level

    def source_side(self, source: int, sink: int) -> list[bool]:
        """Which nodes stay with ``source`` in the minimum cut that lies nearest to it."""
        to, room = self.to, self.room
        while True:
            level = self._levels(source)
            if level[sink] < 0:
                return [x >= 0 for x in level]
            turn = [0] * len(self.leaving)
            path: list[int] = []
            at = source
            while True:
                if at == sink:
                    amount = min(room[e] for e in path)
                    for e in path:
                        room[e] -= amount
                        room[e ^ 1] += amount
                    first = next(k for k, e in enumerate(path) if not room[e])
                    at = to[path[first] ^ 1]
                    del path[first:]
                    continue
                edges = self.leaving[at]
                while turn[at] < len(edges):
                    e = edges[turn[at]]
                    if room[e] and level[to[e]] == level[at] + 1:
                        break
                    turn[at] += 1
                if turn[at] < len(edges):
                    path.append(edges[turn[at]])
                    at = to[edges[turn[at]]]
                elif path:
                    level[at] = -1
                    at = to[path.pop() ^ 1]
                else:
                    break


def odds_of(blocks: list[Block], weights: np.ndarray) -> list[int]:
    """Each block's own log-odds, in ``SCALE``."""
    if not blocks:
        return []
    from_text = np.clip(np.array([features(b) for b in blocks]) @ weights, -TEXT_LIMIT, TEXT_LIMIT)
    return np.rint(SCALE * (from_text + [b.evidence for b in blocks])).astype(int).tolist()


def label(blocks: list[Block], weights: np.ndarray) -> list[bool]:
    """Which blocks are content."""
    odds, n = odds_of(blocks, weights), len(blocks)
    if all(o > 0 for o in odds) or all(o <= 0 for o in odds):
        return [o > 0 for o in odds]
    net, source, sink = Network(n + 2), n, n + 1
    last: dict[Element | None, int] = {}  # the last block of each container
    for k, o in enumerate(odds):
        if o > 0:
            net.edge(source, k, o)
        elif o < 0:
            net.edge(k, sink, -o)
        holder = blocks[k].holder
        if k and (far := steps(blocks[k - 1].holder, holder)) <= FAR:
            pull = round(SCALE * NEXT_TO * 0.5 ** max(0, far - 2))
            net.edge(k - 1, k, pull, pull)
        before = last.get(holder.parent)
        if before is not None and before < k - 1:
            net.edge(before, k, int(SCALE * SAME_PARENT), int(SCALE * SAME_PARENT))
        last[holder.parent] = k
    return net.source_side(source, sink)[:n]


def extract(page: str | None, weights: np.ndarray) -> str:
    blocks = blocks_of(page or "")
    return "\n".join(b.text for b, kept in zip(blocks, label(blocks, weights)) if kept)


def learn(pages: DataFrame, sample_pages: int = SAMPLE_PAGES) -> np.ndarray:
    """Weights of the text features, from about ``sample_pages`` pages chosen by hash; each gives sums, never rows of its own."""
    n = pages.count()
    chosen = pages.where(F.col("html").isNotNull() & (unsigned_share(F.xxhash64("html"), 3) < sample_pages / max(n, 1)))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for page in texts(batch, "html"):
                said = [b for b in blocks_of(page) if b.evidence]
                rows += [(features(b), float(b.evidence > 0)) for b in said[:: max(1, len(said) // 50)]]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.list_(pa.float64())), pa.array([r[1] for r in rows], pa.float64())], names=["x", "y"])

    # equal pages have equal hashes: a page that is copied very often is one page of the sample
    rows = chosen.select("html").distinct().mapInArrow(run, "x array<double>, y double").collect()
    return fit(np.array([r.x for r in rows]), np.array([r.y for r in rows]))


def extract_pages(pages: DataFrame, carry: list[str], weights: np.ndarray) -> DataFrame:
    """``carry`` columns with ``text`` for each row's whole ``html``."""
    given = pages.select(*[F.col(f"`{c}`") for c in carry], F.col("html").alias("_html"))
    schema = given.select(*[f"`{c}`" for c in carry]).schema.add("text", "string")

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "_html"):
            found = [extract(h, weights) for h in texts(batch, "_html")]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(carry))), pa.array(found, pa.string())], names=[*carry, "text"])

    return given.mapInArrow(run, schema)


def op10_htmltext(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract_pages(pages, ["page_id", "url"], learn(pages)).withColumn("n_chars", F.length("text").cast("long"))
