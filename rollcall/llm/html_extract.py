"""Main text of web pages: gradient-boosted trees over DOM-node features.

``parse`` builds the element tree of a page (tolerant of unclosed tags).
Every element gets features: its tag, tokens of its class, id and role
attributes by meaning, density of text, links and punctuation in its subtree,
depth, and its standing among its siblings.  Boosted trees, trained here in
numpy, give the probability that an element holds article text if its parent
does.

Decoding is hierarchical: an element can only stay if its parent stays, and
one that goes takes its descendants along.  Of all choices that obey this, the
one with the largest sum of log probabilities is taken, from the leaves up.

The pages carry no labels, so training pages are built from a bounded sample
of the table (``SAMPLE`` pages, in the order of a hash of the html): texts of
the sampled pages are put into pages of varied make, where it is known which
element holds article text.  The sampled pages themselves are added where they
say so with their own tags (article or main).

Text rules: character references are decoded, white space inside a block
becomes one space, blocks are trimmed and joined by one line break in page
order; scripts, styles, forms and the head never hold text.  A line break tag
inside a block is white space.

Defined cases: null, empty or markup-only html gives the empty text; broken
markup never raises; equal pages give equal texts; other columns of the input
are kept; without any sampled text the trees are trained on filler words.
"""

from __future__ import annotations

import functools
import html as entities
import io
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollcall.llm.common import Stored, get_ready, map_text

SAMPLE = 300            # pages whose texts go into training
SAMPLE_CHARS = 8_000_000
MADE = 700              # training pages built from them
TREES, LEVELS, BINS, RATE = 60, 4, 32, 0.2

# Element kinds of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg".split())
NO_TEXT = frozenset("head script style textarea title noscript template iframe svg form button select option input "
                    "label fieldset dialog canvas audio video object map datalist".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i ins kbd mark q s samp small span "
                   "strike strong sub sup time tt u var wbr img".split())
NO_BREAK = INLINE | RAW
P_ENDS = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 "
                   "h5 h6 header hr main nav ol p pre section table ul li dt dd td th tr tbody thead".split())
SAME_ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th"),
             "tr": ("td", "th", "tr"), "option": ("option",)}
SCOPE = frozenset("ul ol dl table div article section main aside nav header footer body blockquote td form".split())
_SELF_CLOSED = re.compile(r"(?:^|[\s\"'])/$")
_STRUCTURE = re.compile(r"<(?:/head|/?body|meta|link|script|style|header|nav|main|article|section|aside|footer|div|p|h[1-6]|ul|ol|table|form)\b", re.I)
RUNNING_TEXT = 60           # characters of a paragraph that is no label of a field
# Meaning of attribute tokens, by the beginning of the token.
MEANINGS = {
    "content": ("article", "content", "entry", "post", "story", "main", "text", "prose", "body"),
    "menu": ("nav", "menu", "breadcrumb", "pagination", "pager", "toc", "tabs", "toolbar", "skip"),
    "header": ("header", "masthead", "topbar", "banner", "logo", "branding", "site"),
    "footer": ("footer", "foot", "copyright", "legal", "colophon", "imprint", "credits"),
    "aside": ("sidebar", "aside", "widget", "related", "recommend", "popular", "trending", "more", "rail", "complementary"),
    "notice": ("notice", "cookie", "consent", "gdpr", "alert", "popup", "modal", "overlay", "paywall", "disclaimer", "warning",
               "announcement"),
    "advert": ("ad", "ads", "advert", "advertisement", "sponsor", "sponsored", "promo", "promotion", "dfp", "teaser", "affiliate"),
    "form": ("form", "login", "signup", "subscribe", "subscription", "newsletter", "search", "register", "contact"),
    "comment": ("comment", "comments", "reply", "replies", "respond", "discussion", "disqus", "review", "reviews", "feedback"),
    "share": ("share", "sharing", "social", "follow", "tweet", "like", "tags", "meta", "byline", "author", "bio"),
}
_WHOLE = frozenset(("ad", "ads", "nav", "more", "like", "foot", "main", "text", "body", "site", "meta", "bio", "post", "form", "toc"))
_KINDS = ["article", "main", "nav", "header", "footer", "aside", "section", "div", "p", "heading", "list", "item", "table",
          "link", "inline", "quote", "other"]
_KIND = {**{k: k for k in ("article", "main", "nav", "header", "footer", "aside", "section", "div", "p")},
         **{f"h{i}": "heading" for i in range(1, 7)}, **dict.fromkeys(("ul", "ol", "dl", "menu"), "list"),
         **dict.fromkeys(("li", "dt", "dd"), "item"), **dict.fromkeys(("table", "tr", "td", "th", "tbody", "thead"), "table"),
         "a": "link", **dict.fromkeys(("blockquote", "pre", "figure", "figcaption"), "quote")}

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*(?:>|$)|</([a-zA-Z][^\s/>]*)[^>]*(?:>|$)"
                    r"|<([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<([a-zA-Z][^\s/>]*)([^>]*)(?:>|$)", re.S)
_ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|aria-label|itemprop)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.I)
_HAS_MEANING = re.compile(r"(?:class|id|role|label|itemprop)\s*=", re.I)
_NONE: frozenset[str] = frozenset()
_PART = re.compile(r"[a-z]+|[A-Z][a-z]*|[A-Z]+")


@functools.lru_cache(maxsize=1 << 14)
def meanings(attributes: str) -> frozenset[str]:
    """What the attribute tokens of a start tag stand for."""
    found = set()
    for _, value in _ATTRIBUTE.findall(attributes):
        for token in _PART.findall(value):
            t = token.lower()
            for name, starts in MEANINGS.items():
                if any(t == s or (s not in _WHOLE and t.startswith(s)) for s in starts):
                    found.add(name)
    return frozenset(found)


class Page:
    """Elements in page order (0 is the root) and text pieces (element, text, number of their block).

    A block goes on until an element opens or closes that is neither inline nor without visible text."""

    def __init__(self) -> None:
        self.tag, self.parent, self.depth = ["root"], [-1], [0]
        self.means: list[frozenset[str]] = [_NONE]
        self.texts: list[tuple[int, str, int]] = []
        self.block = 0

    def open(self, tag: str, parent: int, attributes: str) -> int:
        self.tag.append(tag)
        self.parent.append(parent)
        self.depth.append(self.depth[parent] + 1)
        self.means.append(meanings(attributes) if _HAS_MEANING.search(attributes) else _NONE)
        self.block += tag not in NO_BREAK
        return len(self.tag) - 1


def parse(source: str | None) -> Page:
    page = Page()
    if not source:
        return page
    stack, opened = [0], {}

    def close(depth: int) -> None:
        for n in stack[depth:]:
            opened[page.tag[n]] -= 1
            page.block += page.tag[n] not in NO_BREAK
        del stack[depth:]

    def close_nearest(tags: tuple[str, ...], stop: frozenset[str]) -> None:
        for i in range(len(stack) - 1, 0, -1):
            t = page.tag[stack[i]]
            if t in tags:
                close(i)
                return
            if t in stop:
                return

    at, n = 0, len(source)
    while at < n:
        m = _TOKEN.search(source, at)
        if m is None:
            page.texts.append((stack[-1], source[at:], page.block))
            break
        if m.start() > at:
            page.texts.append((stack[-1], source[at:m.start()], page.block))
        at = m.end()
        end, start, attributes = m[1], m[2] or m[4], (m[3] if m[2] else m[5]) or ""
        if end:
            t = end.lower()
            if opened.get(t):
                for i in range(len(stack) - 1, 0, -1):
                    if page.tag[stack[i]] == t:
                        close(i)
                        break
        elif start:
            t = start.lower()
            if t in P_ENDS and opened.get("p"):
                close_nearest(("p",), SCOPE)
            if t in SAME_ENDS and any(opened.get(x) for x in SAME_ENDS[t]):
                close_nearest(SAME_ENDS[t], SCOPE - {"td"} if t in ("tr", "td", "th") else SCOPE)
            node = page.open(t, stack[-1], attributes)
            if t == "br":
                page.texts.append((stack[-1], " ", page.block))
            if t in RAW:
                # only foreign elements close themselves, and not by a slash that belongs to an attribute's value
                if t != "svg" or not _SELF_CLOSED.search(attributes):
                    shut = re.compile(rf"</{re.escape(t)}\b[^>]*(?:>|$)", re.I).search(source, at)
                    # without an end tag, code and styles go on to the end, others to the next element of the page
                    shut_at = None if shut or t in ("script", "style") else _STRUCTURE.search(source, at)
                    at = shut.end() if shut else shut_at.start() if shut_at else n
            elif t not in VOID:
                stack.append(node)
                opened[t] = opened.get(t, 0) + 1
    _unwrap(page)
    return page


def _unwrap(page: Page) -> None:
    """A form around an article, or around paragraphs of running text, is a frame of the page and no form to fill in: it
    counts as a div, so the trees judge what is in it."""
    forms = [i for i, t in enumerate(page.tag) if t == "form"]
    if not forms:
        return
    size = [0] * len(page.tag)
    for node, text, _ in page.texts:
        size[node] += len(text.strip())
    above = [0] * len(page.tag)             # the nearest form around each element
    prose = dict.fromkeys(forms, 0)
    for i in range(1, len(page.tag)):
        above[i] = page.parent[i] if page.tag[page.parent[i]] == "form" else above[page.parent[i]]
        if above[i] and (page.tag[i] in ("article", "main") or page.tag[i] == "p" and size[i] >= RUNNING_TEXT):
            prose[above[i]] += 2 if page.tag[i] != "p" else 1
    for i in reversed(forms):               # inner forms first: what they hold counts for the outer ones
        if above[i]:
            prose[above[i]] += prose[i]
        if prose[i] >= 2:
            page.tag[i] = "div"


_KIND_AT = {name: i for i, name in enumerate(_KINDS)}
_MEANING_AT = {name: i for i, name in enumerate(MEANINGS)}


def features(page: Page) -> np.ndarray:
    """One row per element."""
    tag, parent, n = page.tag, page.parent, len(page.tag)
    own, links, stops, pieces, hidden = ([0] * n for _ in range(5))
    banned, in_link, inside, article = ([False] * n for _ in range(4))
    kids, index, same, paragraphs, mask = ([0] * n for _ in range(5))
    tags: dict = {}
    for i in range(1, n):
        p, t = parent[i], tag[i]
        banned[i] = banned[p] or t in NO_TEXT
        in_link[i] = in_link[p] or t == "a"
        inside[i] = inside[p] or "content" in page.means[p]
        article[i] = article[p] or tag[p] in ("article", "main")
        index[i] = kids[p]
        kids[p] += 1
        tags[p, t] = tags.get((p, t), 0) + 1
        paragraphs[i] = int(t == "p")
        if page.means[i]:
            mask[i] = sum(1 << _MEANING_AT[m] for m in page.means[i])
    for i in range(1, n):
        same[i] = tags[parent[i], tag[i]]
    for node, text, _ in page.texts:
        size = len(text) - text.count(" ") - text.count("\n")
        if not size:
            continue
        if banned[node]:
            hidden[node] += size
            continue
        own[node] += size
        pieces[node] += 1
        stops[node] += text.count(".") + text.count(",") + text.count("?") + text.count("!")
        if in_link[node]:
            links[node] += size
    alone = own.copy()
    elements = [1] * n
    for i in range(n - 1, 0, -1):           # children come behind their parents
        p = parent[i]
        own[p] += own[i]
        links[p] += links[i]
        stops[p] += stops[i]
        pieces[p] += pieces[i]
        hidden[p] += hidden[i]
        elements[p] += elements[i]
        paragraphs[p] += paragraphs[i]
    table = np.array([own, links, stops, pieces, hidden, elements, paragraphs, alone, page.depth, kids, index, same, inside,
                      article], float)
    chars, link, stop, piece, hide, elements_, paragraphs_, alone_, depth, kids_, index_, same_, inside_, article_ = table
    up = np.maximum(np.array(parent), 0)
    some = np.maximum(chars, 1)
    marked = float(any(t in ("article", "main") for t in tag))
    numbers = np.stack([
        np.log1p(chars), chars / max(chars[0], 1), link / some, 100 * stop / some, chars / elements_,
        chars / np.maximum(piece, 1), paragraphs_, hide / np.maximum(chars + hide, 1), depth, kids_, index_,
        index_ / np.maximum(kids_[up], 1), same_, chars / some[up], link[up] / some[up], alone_ / some, inside_, article_,
        np.full(n, marked)], axis=1)
    kind = np.array([_KIND_AT[_KIND.get(t, "inline" if t in INLINE else "other")] for t in tag])
    bits = (np.array(mask)[:, None] >> np.arange(len(MEANINGS))) & 1
    return np.concatenate([numbers, np.eye(len(_KINDS))[kind], bits], axis=1)


class Trees:
    """Gradient boosting with logistic loss on binned features; full trees of ``LEVELS`` levels."""

    def __init__(self, edges: list[np.ndarray], feature: np.ndarray, split: np.ndarray, value: np.ndarray, start: float):
        self.edges, self.feature, self.split, self.value, self.start = edges, feature, split, value, start

    @staticmethod
    def bins(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, k], "left") for k, e in enumerate(edges)], axis=1).astype(np.int64)

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Trees:
        edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1])) for k in range(x.shape[1])]
        b = cls.bins(x, edges)
        n, f = b.shape
        mean = np.clip((weight * y).sum() / weight.sum(), 1e-3, 1 - 1e-3)
        start = float(np.log(mean / (1 - mean)))
        z = np.full(n, start)
        features_, splits, values = [], [], []
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-z))
            g, h = weight * (p - y), weight * p * (1 - p)
            node = np.zeros(n, np.int64)
            tree_f, tree_s = np.zeros(2 ** LEVELS - 1, np.int64), np.full(2 ** LEVELS - 1, BINS, np.int64)
            for level in range(LEVELS):
                k = 2 ** level
                best_gain, best = np.full(k, 1e-6), [(0, BINS)] * k
                for j in range(f):
                    cell = node * (BINS + 1) + b[:, j]
                    gs = np.cumsum(np.bincount(cell, g, k * (BINS + 1)).reshape(k, -1), axis=1)
                    hs = np.cumsum(np.bincount(cell, h, k * (BINS + 1)).reshape(k, -1), axis=1)
                    gt, ht = gs[:, -1:], hs[:, -1:]
                    gain = gs ** 2 / (hs + 1) + (gt - gs) ** 2 / (ht - hs + 1) - gt ** 2 / (ht + 1)
                    at = gain.argmax(axis=1)
                    for i in np.flatnonzero(gain[np.arange(k), at] > best_gain).tolist():
                        best_gain[i], best[i] = gain[i, at[i]], (j, int(at[i]))
                base = k - 1
                for i, (j, s) in enumerate(best):
                    tree_f[base + i], tree_s[base + i] = j, s
                node = 2 * node + (b[np.arange(n), tree_f[base + node]] > tree_s[base + node])
            leaves = -np.bincount(node, g, 2 ** LEVELS) / (np.bincount(node, h, 2 ** LEVELS) + 1) * RATE
            z += leaves[node]
            features_.append(tree_f)
            splits.append(tree_s)
            values.append(leaves)
        return cls(edges, np.array(features_), np.array(splits), np.array(values), start)

    def logits(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x, self.edges)
        rows, z = np.arange(len(b)), np.full(len(b), self.start)
        for f, s, v in zip(self.feature, self.split, self.value, strict=True):
            node = np.zeros(len(b), np.int64)
            for level in range(LEVELS):
                at = 2 ** level - 1 + node
                node = 2 * node + (b[rows, f[at]] > s[at])
            z += v[node]
        return z

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, feature=self.feature, split=self.split, value=self.value, start=np.array([self.start]),
                 edges=np.concatenate(self.edges), sizes=np.array([len(e) for e in self.edges]))
        return out.getvalue()

    @classmethod
    def from_bytes(cls, data: bytes) -> Trees:
        z = np.load(io.BytesIO(data))
        return cls(np.split(z["edges"], np.cumsum(z["sizes"])[:-1]), z["feature"], z["split"], z["value"], float(z["start"][0]))


def judged(page: Page) -> np.ndarray:
    """Elements with a choice of their own: not the root, html or body, and no bare inline element."""
    return np.array([i > 0 and t not in ("html", "body") and not (t in INLINE and not page.means[i])
                     for i, t in enumerate(page.tag)])


def decode(page: Page, logits: np.ndarray) -> list[bool]:
    """Which elements stay: the most probable choice in which nothing stays below something that goes.

    The trees give the probability that an element stays if its parent does; below one that goes there is no choice.
    """
    n, parent = len(page.tag), page.parent
    own = judged(page).tolist()
    log_stay, log_go = (-np.logaddexp(0, -logits)).tolist(), (-np.logaddexp(0, logits)).tolist()
    below = [0.0] * n                       # best value of all that is below an element that stays
    stays = [True] * n
    for i in range(n - 1, 0, -1):
        if page.tag[i] in NO_TEXT:
            stays[i] = False
        elif own[i]:
            stays[i] = log_stay[i] + below[i] >= log_go[i]
            below[parent[i]] += max(log_stay[i] + below[i], log_go[i])
        else:
            below[parent[i]] += below[i]
    for i in range(1, n):
        stays[i] = stays[i] and stays[parent[i]]
    return stays


def text_of(page: Page, kept: list[bool]) -> str:
    """Blocks of the elements that stay, in page order."""
    blocks: list[list[str]] = []
    last = None
    for node, text, block in page.texts:
        if kept[node]:
            if block != last:
                blocks.append([])
                last = block
            blocks[-1].append(entities.unescape(text))
    clean = (" ".join("".join(b).split()) for b in blocks)
    return "\n".join(b for b in clean if b)


class Maker:
    """Builds training pages: html and, per element in order of its start tag, whether it holds article text."""

    def __init__(self, texts: list[str], rng: np.random.Generator):
        self.rng = rng
        self.texts = texts
        self.html: list[str] = []
        self.labels: list[int] = []

    def pick(self, *choices):
        return choices[int(self.rng.integers(len(choices)))]

    def chance(self, p: float) -> bool:
        return self.rng.random() < p

    def prose(self, low: int, high: int) -> str:
        words = self.texts[int(self.rng.integers(len(self.texts)))].split()
        at, n = int(self.rng.integers(max(1, len(words) - low))), int(self.rng.integers(low, high + 1))
        return entities.escape(" ".join(words[at:at + n]) + ".")

    def element(self, tag: str, label: int, inner, means: str | None = None) -> None:
        attribute = ""
        if means:
            token = self.pick(*MEANINGS[means])
            token += self.pick("", "", "-wrap", "_box", "-area", "Block", " clearfix", "-1")
            attribute = f' {self.pick("class", "class", "id")}="{token}"'
        elif self.chance(0.2):
            attribute = f' class="{self.pick("row", "col", "x1", "grid", "container", "wrapper", "inner", "left", "c-12")}"'
        self.html.append(f"<{tag}{attribute}>")
        self.labels.append(label)
        inner() if callable(inner) else self.html.append(inner)
        self.html.append(f"</{tag}>")

    def link(self, words: int) -> None:
        self.element("a", 0, self.prose(1, words))

    def links(self, label: int = 0) -> None:
        def items():
            for _ in range(int(self.rng.integers(2, 12))):
                self.element("li", label, lambda: self.link(3))
        if self.chance(0.7):
            self.element(self.pick("ul", "ul", "ol"), label, items)
        else:
            for _ in range(int(self.rng.integers(2, 8))):
                self.link(3)

    def aside(self, kind: str) -> None:
        tag = {"menu": "nav", "header": "header", "footer": "footer", "aside": "aside", "form": "form"}.get(kind, "div")
        plain = tag != "div" and self.chance(0.6)
        tag = tag if plain or (tag != "div" and self.chance(0.5)) else self.pick("div", "div", "section", "ul", "p")
        tag = "div" if tag in ("ul", "p") and kind not in ("advert", "notice", "share") else tag
        means = None if plain and self.chance(0.7) else kind

        def inner():
            if kind in ("menu", "share"):
                self.links()
            elif kind in ("advert", "notice") or (kind == "footer" and self.chance(0.6)):
                if self.chance(0.5) or tag in ("ul", "p"):
                    self.html.append(self.prose(2, 30))
                else:
                    self.element("p", 0, self.prose(3, 40))
            elif kind == "comment":
                if self.chance(0.6):
                    self.element(self.pick("h2", "h3"), 0, self.prose(1, 3))
                for _ in range(int(self.rng.integers(1, 7))):
                    self.element(self.pick("div", "li", "article"), 0, lambda: [
                        self.element("p", 0, self.prose(3, 60)) for _ in range(int(self.rng.integers(1, 3)))],
                        self.pick("comment", None))
            elif kind == "form":
                self.html.append(self.prose(1, 6) + "<input name=q><button>Go</button>")
                self.labels += [0, 0]
            else:
                if self.chance(0.5):
                    self.element(self.pick("h2", "h3", "h4", "div"), 0, self.prose(1, 5))
                if self.chance(0.5):
                    self.links()
                if self.chance(0.5):
                    self.element("p", 0, self.prose(3, 30))

        self.element(tag, 0, inner, means)

    def article(self) -> None:
        if self.chance(0.15):               # hardly any text
            self.element(self.pick("h1", "h2", "p"), 1, self.prose(1, 4))
            if self.chance(0.7):
                self.element("p", 1, self.prose(1, 5))
            return
        if self.chance(0.8):
            self.element("h1", 1, self.prose(1, 12))
        for _ in range(int(self.rng.integers(1, 10))):
            r = self.rng.random()
            if r < 0.72:
                def paragraph():
                    self.html.append(self.prose(1, 90))
                    if self.chance(0.2):
                        self.link(6)
                        self.html.append(" " + self.prose(1, 30))
                self.element("p", 1, paragraph)
            elif r < 0.82:
                self.element(self.pick("h2", "h3"), 1, self.prose(1, 8))
            elif r < 0.89:
                self.element(self.pick("ul", "ol"), 1, lambda: [
                    self.element("li", 1, self.prose(1, 20)) for _ in range(int(self.rng.integers(1, 6)))])
            elif r < 0.94:
                self.element("blockquote", 1, lambda: self.element("p", 1, self.prose(3, 40)))
            else:
                self.element("div", 1, self.prose(3, 60))
            if self.chance(0.06):
                self.aside(self.pick("advert", "share", "aside", "notice"))

    def page(self) -> tuple[str, list[int]]:
        self.html, self.labels = [], []
        around = ["menu", "header", "footer", "aside", "notice", "advert", "form", "comment", "share"]

        def some(p: float) -> None:
            for kind in self.rng.permutation(around):
                if self.chance(p):
                    self.aside(str(kind))

        def content():
            some(0.06)
            self.article()
            if self.chance(0.35):
                self.aside("comment")
            some(0.06)

        def wrapped(depth: int):
            if depth:
                self.element(self.pick("div", "div", "section"), 1, lambda: wrapped(depth - 1))
                return
            some(0.3)
            how = self.rng.random()
            if how < 0.35:
                self.element(self.pick("article", "article", "main"), 1, content, self.pick(None, None, "content"))
            elif how < 0.75:
                self.element(self.pick("div", "section", "div"), 1, content, "content")
            else:
                self.element(self.pick("div", "section"), 1, content)
            some(0.35)

        self.element("body", 1, lambda: wrapped(int(self.rng.integers(0, 3))))
        return "".join(self.html), [1, *self.labels]


_OUTSIDE = frozenset(("nav", "header", "footer", "aside", *NO_TEXT))


def by_own_tags(page: Page) -> list[int] | None:
    """Labels of a page that marks its article with article or main; None for other pages."""
    n = len(page.tag)
    inside, label = [False] * n, [0] * n
    for i in range(1, n):
        p = page.parent[i]
        off = page.tag[i] in _OUTSIDE or bool(page.means[i] & {"menu", "footer", "aside", "notice", "advert", "form",
                                                                 "comment", "share"})
        inside[i] = not off and (inside[p] or page.tag[i] in ("article", "main"))
    if not any(inside):
        return None
    for i in range(n - 1, 0, -1):
        if inside[i] or label[i]:
            label[i] = 1
            label[page.parent[i]] = 1
    label[0] = 1
    return label


def train(sources: list[str], seed: int = 11) -> Trees:
    """Trees from sampled pages and from pages made of their texts."""
    rng = np.random.default_rng(seed)
    rows, labels, weights, texts = [], [], [], []

    def add(page: Page, label: list[int], weight: float) -> None:
        y = np.array(label)
        use = judged(page) & (y[np.maximum(np.array(page.parent), 0)] == 1)     # choices below an element that stays
        rows.append(features(page)[use])
        labels.append(y[use])
        weights.append(np.full(int(use.sum()), weight))

    for source in sources:
        page = parse(source)
        label = by_own_tags(page)
        if label:
            add(page, label, 2.0)
        texts += [entities.unescape(t) for node, t, _ in page.texts
                  if page.tag[node] not in NO_TEXT and len(t.split()) >= 5]
    if not texts:
        texts = [" ".join(f"word{i}" for i in rng.integers(0, 999, 60)) for _ in range(40)]
    maker = Maker(texts, rng)
    for _ in range(MADE):
        source, label = maker.page()
        page = parse(source)
        if len(page.tag) == len(label):
            add(page, label, 1.0)
    x, y = np.concatenate(rows), np.concatenate(labels).astype(float)
    return Trees.fit(x, y, np.concatenate(weights))


def main_text(source: str | None, trees: Trees) -> str:
    page = parse(source)
    return text_of(page, decode(page, trees.logits(features(page)))) if page.texts else ""


def fit(pages: DataFrame, html_col: str = "html", sample: int = SAMPLE) -> Trees:
    """Train on a bounded sample of the table, in one task."""
    spark = get_ready(pages.sparkSession)
    chosen = (pages.select(F.col(html_col).alias("html")).filter("html is not null")
              .select("html", F.xxhash64("html").alias("at")).orderBy("at", "html").limit(sample))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sources, size = [], 0
        for b in batches:
            for t in b.column(0).to_pylist():
                if size < SAMPLE_CHARS:
                    sources.append(t)
                    size += len(t)
        yield pa.RecordBatch.from_arrays([pa.array([train(sources).to_bytes()], pa.binary())], names=["model"])

    fitted = chosen.select("html").coalesce(1).mapInArrow(run, "model binary")
    found = Stored(spark, "html-extract").put(fitted, "trees").first()
    return Trees.from_bytes(bytes(found["model"])) if found else train([])      # an empty table has no task


def extract(pages: DataFrame, trees: Trees, html_col: str = "html") -> DataFrame:
    """``row`` (the input row) and ``text`` (main text, empty if none)."""
    sent = get_ready(pages.sparkSession).sparkContext.broadcast(trees.to_bytes())

    def run(batches):
        model = Trees.from_bytes(sent.value)
        for sources in batches:
            out = []
            for at in range(0, len(sources), 64):
                parsed = [parse(s) for s in sources[at:at + 64]]
                logits = model.logits(np.concatenate([features(p) for p in parsed]))
                ends = np.cumsum([len(p.tag) for p in parsed])[:-1]
                out += [text_of(p, decode(p, z)) for p, z in zip(parsed, np.split(logits, ends), strict=True)]
            yield [out]

    return map_text(pages, html_col, [T.StructField("text", T.StringType())], run)
