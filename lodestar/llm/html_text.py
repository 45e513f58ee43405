"""Main text of web pages: gradient-boosted trees over DOM-node features, decoded top-down over the tree."""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_chars, text_udf

# Parsing --------------------------------------------------------------------------------------------------------------

# Tag classes of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: What stands in these is never shown as text of the page, or is a form's control.
RAW = frozenset("script style noscript template textarea title iframe noembed select".split())
BLOCK = frozenset(
    "address article aside blockquote body button center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup html li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul label legend option caption".split()
)
CLOSES_P = BLOCK - {"button", "label", "legend", "option", "td", "th", "tr", "tbody", "thead", "tfoot", "caption"}
#: An open element of the first kind ends at the start of one of the second.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th", "tr", "tbody"}, "th": {"td", "th", "tr", "tbody"}, "tr": {"tr", "tbody"}, "option": {"option"}}

#: Where markup begins; then a tag whose quoted values (after =) may hold >, and one that ends at the next >.
_START = re.compile(r"<(?:!--|!\[CDATA\[|[!?]|/?[A-Za-z])")
_TAG = re.compile(r"""<(/?)([A-Za-z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+)>""")
_PLAIN = re.compile(r"<(/?)([A-Za-z][^\s/>]*+)([^>]*+)>")
_END = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*+>?", re.I) for tag in RAW}
_ATTR = re.compile(r"""\b(class|id|role|itemprop|aria-label|data-main)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)

# Groups of attribute tokens that tell what a part of a page is for.
TOKENS = (
    ("menu", r"nav|navigation|menu|breadcrumb|pagination|pager|toc|tabs|skip"),
    ("ad", r"ads?|advert\w*|adsbygoogle|sponsor\w*|banner|promo\w*|doubleclick"),
    ("foot", r"foot\w*|copyright|colophon|legal|contentinfo"),
    ("head", r"head|header|masthead|topbar|logo|branding|hero"),
    ("side", r"side\w*|widget\w*|aside|rail|complementary"),
    ("comment", r"comment\w*|disqus|respond|replies|reply|discussion|review\w*|feedback"),
    ("notice", r"cookie\w*|consent|gdpr|notice|alert|warning|popup|modal|overlay|toast|paywall|dialog"),
    ("form", r"form|search\w*|login|signup|subscribe\w*|newsletter|contact"),
    ("share", r"share\w*|social|related|recommend\w*|more|tags?|author|byline|meta|follow|trending|popular"),
    ("main", r"article\w*|content|main\w*|post|entry|story|body|text|prose|markdown|maintext"),
)
_GROUPS = re.compile("|".join(rf"(?P<{name}>(?<![a-z])(?:{p})(?![a-z]))" for name, p in TOKENS))
_BIT = {name: 1 << i for i, (name, _) in enumerate(TOKENS)}
# Tags that count as such a token.
TAG_BITS = {"nav": "menu", "menu": "menu", "footer": "foot", "header": "head", "aside": "side", "form": "form", "dialog": "notice", "article": "main", "main": "main", "fieldset": "form", "button": "form", "label": "form", "ins": "ad"}
# Classes of tags as features.
TAG_CLASS = {"html": 0, "body": 0, "div": 1, "section": 2, "article": 3, "main": 3, "p": 4, "h1": 5, "h2": 5, "h3": 5, "h4": 5, "h5": 5, "h6": 5, "ul": 6, "ol": 6, "dl": 6, "li": 7, "dt": 7, "dd": 7, "a": 8, "table": 9, "tr": 9, "td": 9, "th": 9, "tbody": 9, "blockquote": 10, "pre": 10, "figure": 10, "figcaption": 10, "code": 10}
TEXT, OTHER, N_CLASSES = 11, 12, 13


class Page(NamedTuple):
    """Nodes in document order: element or text ("" as tag), parent (-1 for the root), depth, own token bits, text, block number."""

    tags: list[str]
    parents: list[int]
    depths: list[int]
    bits: list[int]
    texts: list[str]
    blocks: list[int]
    marked: list[bool]


def _bits(tag: str, attrs: str) -> tuple[int, bool]:
    """Token bits of an element and whether it is marked. Short attributes recur and are remembered; long ones (inline data) are not, so memory is bounded."""
    return _known_bits(tag, attrs) if len(attrs) <= 256 else _read_bits(tag, attrs)


def _read_bits(tag: str, attrs: str) -> tuple[int, bool]:
    bits, marked = _BIT.get(TAG_BITS.get(tag, ""), 0), False
    if "=" in attrs:
        for name, a, b, c in _ATTR.findall(attrs):
            if name.lower() == "data-main":
                marked = True
                continue
            for m in _GROUPS.finditer(re.sub(r"([a-z])([A-Z])", r"\1 \2", a or b or c).lower().replace("_", "-")):
                bits |= _BIT[m.lastgroup]  # type: ignore[index]
    return bits, marked


_known_bits = lru_cache(20_000)(_read_bits)
_LISTED = frozenset(t for ends in ENDS.values() for t in ends)
_SCOPES = ("ul", "ol", "dl", "table", "div", "section", "article", "nav", "body")


class _Open:
    """The stack of open elements, with the places of each tag in it, so that the nearest one is found without a walk."""

    def __init__(self) -> None:
        self.nodes, self.tags = [0], ["html"]
        self.at: dict[str, list[int]] = {"html": [0]}
        self.blocks: list[int] = []

    def push(self, node: int, tag: str) -> None:
        self.at.setdefault(tag, []).append(len(self.nodes))
        if tag in BLOCK and tag != "p":
            self.blocks.append(len(self.nodes))
        self.nodes.append(node)
        self.tags.append(tag)

    def nearest(self, tags: Iterable[str]) -> int:
        """The place of the innermost open element of these tags; 0, the root, if there is none."""
        return max((p[-1] for t in tags if (p := self.at.get(t))), default=0)

    def close(self, place: int) -> None:
        """Ends the element at a place and all within."""
        while len(self.nodes) > place:
            self.nodes.pop()
            self.at[self.tags.pop()].pop()
            if self.blocks and self.blocks[-1] == len(self.nodes):
                self.blocks.pop()


def parse(source: str) -> Page:
    """A tolerant parse: elements that HTML closes by itself are closed, stray end tags go, open ones end with the page.

    What is in scripts, styles and other raw elements, comments and white space alone are no nodes. Nothing is bounded, and time is
    linear in the page: only once can a tag's quotes lead to the page's end in vain; from there on quotes aren't looked at.
    """
    tags, parents, depths, bits, texts, blocks, marked = ["html"], [-1], [0], [0], [""], [0], [False]
    opened = _Open()
    block = at = pos = 0
    quotes = True
    size = len(source)

    def add_text(t: str) -> None:
        if not t.isspace():
            tags.append("")
            parents.append(opened.nodes[-1])
            depths.append(len(opened.nodes))
            bits.append(0)
            texts.append(html.unescape(t) if "&" in t else t)
            blocks.append(block)
            marked.append(False)
        elif tags[-1] == "" and blocks[-1] == block:
            texts[-1] += " "

    while start := _START.search(source, pos):
        here, kind, m = start.start(), start[0], None
        if kind == "<!--":
            end = source.find("-->", here + 2)
            end = size if end < 0 else end + 3
        elif kind == "<![CDATA[":
            end = source.find("]]>", here)
            end = size if end < 0 else end + 3
        elif kind in ("<!", "<?"):
            end = source.find(">", here) + 1 or size
        else:
            m = _TAG.match(source, here) if quotes else None
            if m is None:
                quotes = False
                m = _PLAIN.match(source, here)
                if m is None:  # no > is left: the rest is no markup
                    break
            end = m.end()
        if here > at:
            add_text(source[at:here])
        at = pos = end
        if m is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if place := opened.nearest((tag,)):
                opened.close(place)
            block += tag in BLOCK
        elif tag in RAW:
            if not m[3].endswith("/"):
                stop = _END[tag].search(source, at)
                at = pos = stop.end() if stop else size
        elif tag in VOID:
            if tag == "hr":
                block += 1
            elif tag == "br" and tags[-1] == "" and blocks[-1] == block:
                texts[-1] += " "
        elif tag in ("html", "body", "head") and len(opened.nodes) > 3:
            continue
        else:
            if tag in CLOSES_P and (place := opened.nearest(("p",))) and place > (opened.blocks[-1] if opened.blocks else 0):
                opened.close(place)
            if tag in _LISTED:
                place = opened.nearest(t for t, ends in ENDS.items() if tag in ends)
                if place and place > opened.nearest(_SCOPES):
                    opened.close(place)
            block += tag in BLOCK
            b, is_main = _bits(tag, m[3])
            tags.append(tag)
            parents.append(opened.nodes[-1])
            depths.append(len(opened.nodes))
            bits.append(b)
            texts.append("")
            blocks.append(block)
            marked.append(is_main)
            if not m[3].endswith("/"):
                opened.push(len(tags) - 1, tag)
    if at < size:
        add_text(source[at:])
    return Page(tags, parents, depths, bits, texts, blocks, marked)


# Features -------------------------------------------------------------------------------------------------------------


def _levels(depth: np.ndarray) -> list[np.ndarray]:
    """The nodes of each depth, from the roots down; every node is in one of them."""
    order = np.argsort(depth, kind="stable")
    return np.split(order, np.cumsum(np.bincount(depth))[:-1]) if len(depth) else []


def _children_sum(parents: np.ndarray, levels: list[np.ndarray], *values: np.ndarray) -> None:
    """Adds every node's values to its ancestors', in place, a level at a time."""
    for at in reversed(levels[1:]):
        for v in values:
            np.add.at(v, parents[at], v[at])


def features(pages: list[Page]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Features of all nodes of the pages in a row; parents (-1 for roots), depths and the pages' first nodes."""
    starts = np.cumsum([0] + [len(p.tags) for p in pages])
    parents = np.concatenate([np.array(p.parents, np.int64) + np.where(np.array(p.parents) >= 0, s, 0) for p, s in zip(pages, starts[:-1], strict=True)])
    n = len(parents)
    tags = [t for p in pages for t in p.tags]
    kind = np.array([TAG_CLASS.get(t, OTHER) if t else TEXT for t in tags], np.int64)
    own = np.array([b for p in pages for b in p.bits], np.int64)
    texts = [t for p in pages for t in p.texts]
    chars = np.array([len(t) for t in texts], np.float64)
    stops = np.array([t.count(".") + t.count(",") if t else 0 for t in texts], np.float64)
    depth, above = np.array([d for p in pages for d in p.depths], np.int64), np.zeros(n, np.int64)
    link = np.array([t == "a" for t in tags])
    levels = _levels(depth)
    for now in levels[1:]:
        above[now] = above[parents[now]] | own[parents[now]]
        link[now] |= link[parents[now]]
    in_link = np.where(link, chars, 0.0)
    n_tags, n_p = (kind != TEXT).astype(np.float64), (kind == 4).astype(np.float64)
    sub_chars, sub_link, sub_tags, sub_p, sub_stops = chars.copy(), in_link, n_tags.copy(), n_p, stops
    _children_sum(parents, levels, sub_chars, sub_link, sub_tags, sub_p, sub_stops)
    up = np.maximum(parents, 0)
    # Brothers and sisters: how many, which place, how many paragraphs among them.
    n_sib = np.bincount(up, minlength=n).astype(np.float64)
    order = np.lexsort((np.arange(n), up))
    first = np.r_[True, up[order][1:] != up[order][:-1]]
    place = np.empty(n)
    place[order] = np.arange(n) - np.maximum.accumulate(np.where(first, np.arange(n), 0))
    page = np.repeat(starts[:-1], np.diff(starts))
    total = np.maximum(sub_chars[page], 1)
    cols = [np.minimum(depth, 30), np.log1p(sub_chars), sub_link / np.maximum(sub_chars, 1), np.log1p(sub_tags), sub_chars / np.maximum(sub_tags, 1), np.log1p(sub_p), sub_stops / np.maximum(sub_chars, 1) * 100, np.log1p(n_sib[up]), place / np.maximum(n_sib[up], 1), sub_chars / np.maximum(sub_chars[up], 1), sub_chars / total, (sub_link / np.maximum(sub_chars, 1))[up], np.log1p(sub_p[up]), np.log1p(sub_chars[up])]
    cols += [kind == k for k in range(N_CLASSES)] + [kind[up] == k for k in (1, 3, 4, 7, 8)]
    for i in range(len(TOKENS)):
        cols += [(own >> i) & 1, (above >> i) & 1]
    return np.stack([np.asarray(c, np.float32) for c in cols], axis=1), parents, depth, starts


# Trees ----------------------------------------------------------------------------------------------------------------


class Trees(NamedTuple):
    """Boosted complete binary trees of one depth: split features and limits by tree and node, and leaf values."""

    feature: np.ndarray
    limit: np.ndarray
    value: np.ndarray
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log odds of each row."""
        depth = int(np.log2(self.value.shape[1]))
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for f, t, v in zip(self.feature, self.limit, self.value, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(depth):
                at = 2 * at + 1 + (x[rows, f[at]] > t[at])
            out += v[at - (len(f))]
        return out


def boost(x: np.ndarray, y: np.ndarray, trees: int = 36, depth: int = 4, rate: float = 0.3, bins: int = 32, ridge: float = 1.0) -> Trees:
    """Second-order gradient boosting of the logistic loss over binned features."""
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) if len(np.unique(c)) > 2 else np.array([c.min()]) for c in x.T]
    xb = np.stack([np.searchsorted(c, col, side="left") for c, col in zip(cuts, x.T, strict=True)], axis=1)
    two = np.array([j for j, c in enumerate(cuts) if len(c) == 1], dtype=np.int64)
    upper = (xb[:, two] > 0).astype(np.float64)  # features with one cut: their sums are one matrix product
    base = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    margin = np.full(len(y), base)
    fs, ts, vs = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)
        at = np.zeros(len(y), np.int64)
        f, t = np.zeros(2**depth - 1, np.int64), np.full(2**depth - 1, np.inf)
        for level in range(depth):
            m = 2**level
            best = np.full(m, 1e-6)
            split = np.full(m, bins)
            which = np.zeros(m, np.int64)
            node_of = np.zeros((len(y), m))
            node_of[np.arange(len(y)), at] = 1
            gt, ht = node_of.T @ g, node_of.T @ h
            gl, hl = (t_[:, None] - (node_of * q[:, None]).T @ upper for t_, q in ((gt, g), (ht, h)))
            gain = gl**2 / (hl + ridge) + (gt[:, None] - gl) ** 2 / (ht[:, None] - hl + ridge) - (gt**2 / (ht + ridge))[:, None]
            if len(two):
                i = gain.argmax(axis=1)
                top = gain[np.arange(m), i]
                better = top > best
                best, split, which = np.where(better, top, best), np.where(better, 0, split), np.where(better, two[i], which)
            for j, c in enumerate(cuts):
                if len(c) == 1:
                    continue
                k = at * (bins + 1) + xb[:, j]
                gs = np.bincount(k, g, m * (bins + 1)).reshape(m, -1).cumsum(axis=1)
                hs = np.bincount(k, h, m * (bins + 1)).reshape(m, -1).cumsum(axis=1)
                gl, hl, gt, ht = gs[:, : len(c)], hs[:, : len(c)], gs[:, -1:], hs[:, -1:]
                gain = gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge)
                i = gain.argmax(axis=1)
                top = gain[np.arange(m), i]
                better = top > best
                best, split, which = np.where(better, top, best), np.where(better, i, split), np.where(better, j, which)
            for node in range(m):
                if split[node] < bins:
                    f[m - 1 + node], t[m - 1 + node] = which[node], cuts[which[node]][split[node]]
            at = 2 * at + (xb[np.arange(len(y)), which[at]] > split[at])
        gs, hs = np.bincount(at, g, 2**depth), np.bincount(at, h, 2**depth)
        v = -rate * gs / (hs + ridge)
        margin += v[at]
        fs.append(f)
        ts.append(t)
        vs.append(v)
    return Trees(np.array(fs), np.array(ts, np.float32), np.array(vs), base)


# Training pages -------------------------------------------------------------------------------------------------------


def sample_page(rng: random.Random) -> str:
    """An invented page whose main text stands below elements with data-main: layouts, names and markup vary."""
    pick, chance = rng.choice, rng.random
    parts = ["an", "the", "ver", "lich", "tion", "eau", "ment", "os", "ci", "ra", "shi", "to", "ka", "ble", "ing", "on"]

    def word() -> str:
        return "".join(pick(parts) for _ in range(rng.randint(1, 4)))

    def words(a: int, b: int) -> str:
        out = " ".join(word() + ("," if chance() < 0.08 else ".") * (chance() < 0.15) for _ in range(rng.randint(a, b)))
        return out.capitalize() + "." * (chance() < 0.8)

    def links(a: int, b: int) -> str:
        items = "".join(f'<li><a href="/{word()}">{words(1, 3)}</a></li>' for _ in range(rng.randint(a, b)))
        return f"<{(t := pick(['ul', 'ul', 'ol']))}>{items}</{t}>" if chance() < 0.8 else items.replace("<li>", "").replace("</li>", " | ")

    def box(names: list[str], inner: str, tags: tuple[str, ...] = ("div", "section")) -> str:
        t = pick(tags)
        name = pick(names)
        attr = pick([f'class="{name}"', f'id="{name}"', f'class="{name} {word()}"', f"class='{word()}-{name}'"]) if name else ""
        return f"<{t} {attr}>{inner}</{t}>"

    def para(a: int, b: int, close: float = 0.9) -> str:
        body = words(a, b)
        if chance() < 0.15:
            body = f'{body} <a href="/{word()}">{words(1, 4)}</a> {words(2, 12)}'
        if chance() < 0.15:
            body = f"<{(t := pick(['b', 'em', 'strong', 'span', 'i']))}>{body}" + (f"</{t}>" if chance() < 0.7 else "<br>")
        return f"<p>{body}" + ("</p>" if chance() < close else "")

    def ad() -> str:
        inner = pick([words(3, 30), para(3, 25), f'<a href="//x.{word()}">{words(2, 10)}</a>'])
        return box(["ad", "ads", "advert", "sponsored", "banner", "promo", "ad-slot", "advertisement"], inner, ("div", "div", "aside", "ins", "section"))

    def noise() -> str:
        """What doesn't belong to the article though it stands within it."""
        said = pick([words(1, 8), words(3, 40), para(3, 40), f"<h3>{words(1, 3)}</h3>{para(3, 30)}", links(1, 5), words(1, 4) + links(1, 4)])
        kind = pick(["ad", "share", "form", "notice", "side", "foot", "menu", "role", "comments"])
        if kind == "ad":
            return ad()
        if kind == "comments":
            return comments()
        if kind == "share":
            return box(["share", "social-share", "related", "related-posts", "tags", "author-box", "recommended", "byline", "share-buttons", "more-stories"], said, ("div", "div", "section", "aside", "ul"))
        if kind == "form":
            return box(["newsletter", "subscribe", "signup", "search"], f"<form><label>{words(1, 4)}</label><input>{said * (chance() < 0.5)}<button>{word()}</button></form>")
        if kind == "notice":
            return box(["cookie-notice", "consent", "notice", "alert", "popup", "warning", "paywall|dialog", "gdpr"], said, ("div", "div", "section", "dialog", "p"))
        if kind == "side":
            return box(["sidebar", "widget", "side", "aside", ""], said, ("aside",)) if chance() < 0.5 else box(["sidebar", "widget", "side-box", "right-rail"], said)
        if kind == "foot":
            return box(["footer", "article-footer", "copyright", ""], said, ("footer",)) if chance() < 0.6 else box(["footer", "article-footer", "copyright"], said)
        if kind == "menu":
            return box(["nav", "toc", "pagination", "menu", ""], links(2, 6), ("nav",)) if chance() < 0.6 else box(["toc", "pagination", "menu", "breadcrumbs"], links(2, 6))
        return f'<{(t := pick(["div", "section", "p"]))} role="{pick(["alert", "complementary", "navigation", "search", "contentinfo", "dialog", "banner"])}">{said}</{t}>'

    def comments() -> str:
        one = lambda: box(["comment", "comment-body", "reply"], f"<span>{words(1, 2)}</span>" * (chance() < 0.6) + para(3, 80) * rng.randint(1, 2), ("div", "li", "article"))
        return box(["comments", "comment-list", "disqus", "comments-area", "discussion"], f"<h3>{words(1, 3)}</h3>" * (chance() < 0.5) + "".join(one() for _ in range(rng.randint(1, 6))), ("div", "section", "ol", "aside"))

    def article() -> str:
        close = pick([1.0, 1.0, 0.5, 0.0])
        out = [f"<h1>{words(2, 14)}</h1>"] if chance() < 0.8 else []
        for _ in range(pick([0, 1, 1, 2, 3, 5, 8, 12, 20])):
            r = chance()
            out.append(para(1, pick([3, 20, 60, 120]), close) if r < 0.75 else f"<h2>{words(1, 6)}</h2>" if r < 0.82 else f"<ul>{''.join(f'<li>{words(3, 20)}</li>' for _ in range(rng.randint(2, 6)))}</ul>" if r < 0.88 else f"<blockquote>{words(5, 40)}</blockquote>" if r < 0.92 else f"<pre>{words(4, 30)}</pre>" if r < 0.94 else f"<table><tr><td>{words(1, 5)}</td><td>{words(1, 5)}</td></tr></table>" if r < 0.96 else f"<div>{words(5, 60)}</div>")
        blocks = [re.sub(r"<(h1|h2|p|ul|blockquote|pre|table|div)(?=[ >])", r"<\1 data-main=1", x) for x in out]
        if chance() < 0.5:
            for _ in range(pick([1, 1, 2, 3])):
                blocks.insert(rng.randint(0, len(blocks)), noise())
        marked = "".join(blocks)
        t, attr = pick([("article", ""), ("article", ""), ("article", 'class="post"'), ("main", ""), ("div", 'class="content"'), ("div", 'id="main-content"'), ("div", 'class="entry-content"'), ("section", 'class="article-body"'), ("div", 'class="story"'), ("div", ""), ("td", "")])
        wrapped = f"<{t} {attr}>{marked}" + ("</p>" if close < 1 and chance() < 0.3 else "") + f"</{t}>"
        return f"<main>{wrapped}</main>" if t == "article" and chance() < 0.2 else f"<table><tr>{wrapped}</tr></table>" if t == "td" else wrapped

    top = []
    if chance() < 0.5:
        top.append(box(["header", "masthead", "site-header", "topbar", ""], f"<h1>{words(1, 3)}</h1>" * (chance() < 0.4) + words(1, 10) + links(0, 4), ("header", "header", "div")))
    if chance() < 0.85:
        top.append(box(["nav", "menu", "navbar", "main-menu", ""], links(3, 10), ("nav", "nav", "nav", "div")))
    if chance() < 0.2:
        top.append(box(["breadcrumb", "breadcrumbs"], links(2, 4), ("div", "nav")))
    if chance() < 0.3:
        top.append(box(["cookie-notice", "consent", "gdpr-banner", "alert", "notice", "cookie-bar", "popup"], para(4, 50) + "<button>OK</button>" * (chance() < 0.6), ("div", "div", "section", "dialog", "aside")))
    if chance() < 0.6:
        top.append(ad())
    rng.shuffle(top)
    bottom = []
    if chance() < 0.4:
        bottom.append(box(["sidebar", "side", "widget", "right-rail", ""], "".join(pick([links(2, 6), para(4, 40), f"<h3>{words(1, 3)}</h3>", ad()]) for _ in range(rng.randint(1, 4))), ("aside", "aside", "div")) if chance() < 0.9 else "")
    if chance() < 0.4:
        bottom.append(comments())
    if chance() < 0.25:
        bottom.append(box(["related", "recommended", "more-stories", "trending"], f"<h3>{words(1, 3)}</h3>" + links(2, 6)))
    if chance() < 0.25:
        bottom.append(f"<form action=/{word()}><label>{words(1, 5)}</label><input name=q><p>{words(3, 25)}</p><button>{word()}</button></form>")
    if chance() < 0.3:
        bottom.append(ad())
    rng.shuffle(bottom)
    if chance() < 0.9:
        bottom.append(box(["footer", "site-footer", "copyright", ""], f"&copy; {word()}.{word()} &middot; " * (chance() < 0.7) + pick([words(2, 30), para(2, 30), links(1, 5)]), ("footer", "footer", "footer", "div")))
    if chance() < 0.1:
        rng.shuffle(bottom)
    middle = article()
    body = "".join(top) + (bottom.pop(0) if bottom and chance() < 0.2 else "") + middle + "".join(bottom)
    if chance() < 0.3:
        body = box(["wrapper", "container", "page", "site", ""], body, ("div",))
    return f"<!DOCTYPE html><html><head><title>{words(2, 8)}</title><style>p{{}}</style></head><body>{body}" + "</body></html>" * (chance() < 0.9)


def labels(page: Page) -> np.ndarray:
    """Whether each node holds main text: text below a marked element, and what stands above such text."""
    n = len(page.tags)
    inside, y = list(page.marked), [False] * n
    for i in range(1, n):
        inside[i] = inside[i] or inside[page.parents[i]]
    for i in range(n - 1, 0, -1):
        y[i] = y[i] or (page.tags[i] == "" and inside[i])
        if y[i]:
            y[page.parents[i]] = True
    return np.array(y, np.float64)


@lru_cache(2)
def trained(n_pages: int = 700, seed: int = 11) -> Trees:
    """The trees, fitted once per process on ``n_pages`` invented pages with known labels; the same on every machine."""
    rng = random.Random(seed)
    pages = [parse(sample_page(rng)) for _ in range(n_pages)]
    x, _, _, _ = features(pages)
    return boost(x, np.concatenate([labels(p) for p in pages]))


# Decoding -------------------------------------------------------------------------------------------------------------


def decide(margin: np.ndarray, parents: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """The most likely choice of kept nodes in which no node is kept below one that isn't.

    Leaving a node out leaves out all below it. From the leaves up, each node's best sum of log likelihoods as kept is
    its own and, for each child, the better of both; from the root down the better choices are then taken.
    """
    yes, no = -np.logaddexp(0, -margin), -np.logaddexp(0, margin)
    levels = _levels(depth)
    for at in reversed(levels[1:]):
        np.add.at(yes, parents[at], np.maximum(yes[at], no[at]))
        np.add.at(no, parents[at], no[at])
    keep = yes > no
    for at in levels[1:]:
        keep[at] &= keep[parents[at]]
    return keep


def block_text(page: Page, keep: np.ndarray) -> str:
    """Kept text: white space in a block becomes one space, blocks are joined by line breaks."""
    out: list[str] = []
    last, parts = -1, ""
    for i in np.flatnonzero(keep).tolist():
        if page.tags[i] == "":
            if page.blocks[i] != last:
                out.append(" ".join(parts.split()))
                parts, last = "", page.blocks[i]
            parts += page.texts[i]
    out.append(" ".join(parts.split()))
    return "\n".join(o for o in out if o)


def extract(sources: list[str], trees: Trees) -> list[str]:
    """The main text of each page."""
    pages = [parse(s) for s in sources]
    if not pages:
        return []
    x, parents, depth, starts = features(pages)
    keep = decide(trees.margin(x), parents, depth)
    return [block_text(p, keep[a:b]) for p, a, b in zip(pages, starts[:-1], starts[1:], strict=True)]


def main_text(pages: DataFrame, chars_at_once: int = 500_000) -> DataFrame:
    """page_id, url, text, n_chars (code points) of each page's main text, from the whole html.

    Null or empty html, and pages without main text: an empty text, 0. Very long pages are read whole. Null ids and repeated rows are kept, an empty table gives no
    rows; other columns are ignored, whatever their names. The trees are a few KB and broadcast; pages are handled some at a time, so memory is bounded.
    """
    trees = pages.sparkSession.sparkContext.broadcast(trained())

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            out: list[str] = []
            for part in by_chars(batch, chars_at_once):
                out += extract(part, trees.value)
            yield pa.StructArray.from_arrays([pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], ["text", "n_chars"])

    found = text_udf(run, "text string, n_chars long")
    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), found(F.col("html").cast("string")).alias("__main")).select("page_id", "url", "__main.*")
