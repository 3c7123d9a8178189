"""Main text of web pages by gradient-boosted trees over DOM nodes and hierarchical decoding.

A page is parsed to its block elements and runs of text. Each node gets features of its tag and
attribute tokens, its subtree (text, links, punctuation, tags, density), depth and siblings, and of
its ancestors. Boosted trees score how likely the node belongs to the article; decoding picks the
best set of nodes in which no kept node has a dropped ancestor, so choices never contradict each
other. The trees are trained here on made pages whose layout is known.

Defined results
- a null or empty page, and one without an article, has the empty text; rows that repeat repeat;
- `br` is white space; unclosed and misnested elements are closed as browsers do for blocks;
- script, style, textarea, iframe and title are read raw and skipped, to the end of the page if never
  closed (an unclosed title holds nothing); all else, math, svg, object, canvas, noscript, template and
  select included, is parsed, and the trees alone judge it;
- very deep or long pages are parsed in full, without recursion and in linear time, whatever quotes,
  tags and comments are left open; a tag that never ends is text;
- an empty table gives an empty result; columns of the input are carried along by place, whatever their
  names; the text comes in one column, named `_main_text` or with underscores before that if the name is taken.
"""

from __future__ import annotations

import html as _html
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import by_place, free_name, table

#: A whole tag without another `<` before its end, which all but a few are.
_PLAIN = re.compile(r"""<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)([^<>"']*+(?:"[^"<]*+"[^<>"']*+|'[^'<]*+'[^<>"']*+)*+)>""")
_NAME = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)")
_MARK = re.compile(r"[>\"']")


class Markup:
    """The tags of a page in order, each place looked at a bounded number of times.

    A tag ends at the first `>` outside quotes. Where none follows, the quotes seen on the way are
    remembered: another search that comes to one of them outside quotes would fail as well.
    """

    def __init__(self, source: str):
        self.source = source
        self.hopeless: set[int] = set()  # quotes from which no tag ends
        self.mark = (0, 0)  # no `>` or quote lies in this stretch before its end
        self.quote = {'"': (0, 0), "'": (0, 0)}

    def tag(self, at: int):
        """(start, end, slash, name, attributes) of the next tag, declaration or comment from at on; name is None for these two."""
        s = self.source
        while (at := s.find("<", at)) >= 0:
            m = _PLAIN.match(s, at)
            if m:
                return at, m.end(), m[1], m[2], m[3]
            if s.startswith("<!--", at):
                end = s.find("-->", at + 4)
                return at, len(s) if end < 0 else end + 3, "", None, ""
            m = _NAME.match(s, at)
            if m:
                end = self._end(m.end())
                if end >= 0:
                    return at, end + 1, m[1], m[2], s[m.end() : end]
            if s[at + 1 : at + 2] in ("!", "?", "/"):
                end = s.find(">", at)
                return at, len(s) if end < 0 else end + 1, "", None, ""
            at += 1
        return None

    def _next_mark(self, at: int) -> int:
        a, z = self.mark
        if not a <= at <= z or (at == z and z < len(self.source)):
            m = _MARK.search(self.source, at)
            z = m.start() if m else len(self.source)
            self.mark = (at, z)
        return z

    def _close(self, quote: str, at: int) -> int:
        a, z = self.quote[quote]
        if not a <= at <= z:
            z = self.source.find(quote, at)
            z = len(self.source) if z < 0 else z
            self.quote[quote] = (at, z)
        return z

    def _end(self, at: int) -> int:
        seen, n = [], len(self.source)
        while (k := self._next_mark(at)) < n:
            c = self.source[k]
            if c == ">":
                return k
            if k in self.hopeless:
                break
            seen.append(k)
            at = self._close(c, k + 1) + 1
            if at > n:
                break
        self.hopeless.update(seen)
        return -1


_ATTR = re.compile(r"""\b(id|class|role|aria-label|data-y)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORD = re.compile(r"[a-z]+")

#: HTML elements by how they are parsed.
RAW = frozenset("script style textarea iframe title".split())
BLOCK = frozenset(
    "html body div p article main section aside header footer nav form fieldset ul ol li dl dt dd table thead tbody tfoot tr td th caption "
    "h1 h2 h3 h4 h5 h6 blockquote pre figure figcaption address details summary hr dialog menu center button label select optgroup option".split()
)
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "optgroup": ("option", "optgroup")}
SCOPE = frozenset("ul ol dl table body html select".split())
LEAFY = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th pre blockquote figcaption caption address summary button label option".split())

#: Attribute tokens by what they announce.
TOKENS = {
    "main": "article content post entry story main body text copy prose page".split(),
    "nav": "nav navbar navigation menu menus breadcrumb breadcrumbs topbar tabs pagination pager toc links".split(),
    "header": "header masthead banner logo branding top hero".split(),
    "footer": "footer bottom copyright colophon legal".split(),
    "side": "sidebar side aside widget widgets related recommended popular trending more rail secondary".split(),
    "ad": "ad ads advert adverts advertisement sponsor sponsored promo promotion adsense dfp".split(),
    "notice": "cookie cookies consent notice alert popup modal gdpr overlay message".split(),
    "comment": "comment comments reply replies discussion disqus respond reader readers".split(),
    "form": "form share sharing social subscribe newsletter login signup search contact".split(),
    "meta": "byline meta author date tags tag time caption".split(),
}
_GROUP = {t: 1 << i for i, ts in enumerate(TOKENS.values()) for t in ts}
TAGS = ("body", "div", "section", "article", "main", "nav", "header", "footer", "aside", "form", "ul", "ol", "li", "p", "h1", "h2", "table", "td", "blockquote", "pre", "figure", "#run")
_TAG_NUM = {t: i for i, t in enumerate(TAGS)}
_NEGATIVE_TAGS = frozenset("nav header footer aside form button label dialog menu".split())
_POSITIVE_TAGS = frozenset(("article", "main"))


class Page:
    """Nodes in page order: tag, parent, attribute groups, label, text runs; node 0 is the body."""

    def __init__(self, source: str, labelled: bool = False):
        """labelled: a data-y attribute is the label of a made page and not one of the page's own."""
        self.tag, self.parent, self.groups, self.label = ["body"], [-1], [0], [None]
        self.runs: list[tuple[int, str]] = []
        self.chars, self.link_chars, self.tags, self.links, self.stops = [0], [0], [0], [0], [0]
        stack, text, links = [0], [], 0
        at, n = 0, len(source)

        def flush():
            nonlocal links
            if text:
                s = " ".join(_html.unescape("".join(text)).split())
                text.clear()
                if s:
                    node = stack[-1]
                    if self.tag[node] not in LEAFY:
                        node = self.add("#run", node, 0, None)
                    self.runs.append((node, s))
                    self.chars[node] += len(s)
                    self.link_chars[node] += min(links, len(s))
                    self.stops[node] += s.count(".") + s.count(",") + s.count("!") + s.count("?")
                links = 0

        in_link, markup, unclosed = 0, Markup(source), set()
        while at < n:
            m = markup.tag(at)
            if m is None:
                text.append(source[at:])
                break
            start, end, slash, name, attrs = m
            if start > at:
                piece = source[at:start]
                text.append(piece)
                if in_link:
                    links += len(piece)
            at = end
            if name is None:
                continue
            name = name.lower()
            if slash:
                if name == "a":
                    in_link = 0
                elif name in BLOCK:
                    flush()
                    for k in range(len(stack) - 1, 0, -1):
                        if self.tag[stack[k]] == name:
                            del stack[k:]
                            break
                continue
            self.tags[stack[-1]] += 1
            if name in RAW:
                if attrs.endswith("/"):
                    continue
                close = re.compile(rf"</{name}(?=[\s/>])[^>]*+>", re.I).search(source, at) if name not in unclosed else None
                if close:
                    at = close.end()
                else:
                    unclosed.add(name)
                    at = at if name == "title" else n
            elif name == "a":
                in_link = 1
                self.links[stack[-1]] += 1
            elif name == "br":
                text.append(" ")
            elif name in BLOCK:
                flush()
                in_link = 0
                groups, label = 0, None
                if "=" in attrs:
                    for a in _ATTR.finditer(attrs):
                        value = a[2] if a[2] is not None else a[3] if a[3] is not None else a[4]
                        if a[1].lower() == "data-y":
                            label = int(value) if labelled else None
                        else:
                            for w in _WORD.findall(value.lower()):
                                groups |= _GROUP.get(w, 0)
                if name in ("html", "body"):
                    self.groups[0] |= groups
                    continue
                if self.tag[stack[-1]] == "p" and name not in ("button", "label", "select") or self.tag[stack[-1]][0] == "h" and self.tag[stack[-1]] in LEAFY and name in LEAFY:
                    stack.pop()
                if name in CLOSES:
                    for k in range(len(stack) - 1, 0, -1):
                        if self.tag[stack[k]] in CLOSES[name]:
                            del stack[k:]
                            break
                        if self.tag[stack[k]] in SCOPE:
                            break
                if name not in VOID:
                    stack.append(self.add(name, stack[-1], groups, label))
        flush()

    def add(self, tag, parent, groups, label) -> int:
        self.tag.append(tag)
        self.parent.append(parent)
        self.groups.append(groups)
        self.label.append(label)
        for x in (self.chars, self.link_chars, self.tags, self.links, self.stops):
            x.append(0)
        return len(self.tag) - 1


N_GROUPS = len(TOKENS)
FEATURES = (
    "tag", *(f"self_{g}" for g in TOKENS), *(f"above_{g}" for g in TOKENS), "below_main", "in_positive", "in_negative", "is_negative", "has_positive", "depth", "chars", "link_share",
    "links", "stops_share", "density", "page_share", "children", "siblings", "place", "same_tag", "sibling_chars", "parent_chars", "heading", "biggest_child", "leaf",
)


def features(page: Page) -> np.ndarray:
    """One row for each node."""
    n = len(page.tag)
    parent = page.parent
    sub = np.array([page.chars, page.link_chars, page.tags, page.links, page.stops], np.float64)
    own = sub.copy()
    kids = [0] * n
    place = [0] * n
    for i in range(1, n):
        place[i] = kids[parent[i]]
        kids[parent[i]] += 1
    depth, above, inside, outside = [0] * n, [0] * n, [0] * n, [0] * n
    same: dict[tuple[int, str], int] = {}
    for i in range(1, n):
        p = parent[i]
        depth[i] = depth[p] + 1
        above[i] = above[p] | page.groups[p]
        inside[i] = inside[p] or page.tag[p] in _POSITIVE_TAGS
        outside[i] = outside[p] or page.tag[p] in _NEGATIVE_TAGS
        same[p, page.tag[i]] = same.get((p, page.tag[i]), 0) + 1
    cols = sub.T.tolist()
    below, holds, biggest = list(page.groups), [0] * n, [0.0] * n
    for i in range(n - 1, 0, -1):
        p, row, up = parent[i], cols[i], cols[parent[i]]
        for k in range(5):
            up[k] += row[k]
        below[p] |= below[i]
        holds[p] |= holds[i] or page.tag[i] in _POSITIVE_TAGS
        biggest[p] = max(biggest[p], row[0])
    total = max(1.0, cols[0][0])
    out = np.empty((n, len(FEATURES)), np.float32)
    group_bits = np.array(page.groups)[:, None] >> np.arange(N_GROUPS) & 1
    above_bits = np.array(above)[:, None] >> np.arange(N_GROUPS) & 1
    s = np.array(cols)
    par = np.array([max(p, 0) for p in parent])
    kids_a, chars = np.array(kids), s[:, 0]
    out[:, 0] = [_TAG_NUM.get(t, len(TAGS)) for t in page.tag]
    out[:, 1 : 1 + N_GROUPS] = group_bits
    out[:, 1 + N_GROUPS : 1 + 2 * N_GROUPS] = above_bits
    rest = [
        np.array(below) & 1, inside, outside, [t in _NEGATIVE_TAGS for t in page.tag], holds, depth, np.log1p(chars), s[:, 1] / np.maximum(chars, 1), s[:, 3], 10 * s[:, 4] / np.maximum(chars / 6, 1),
        chars / (1 + s[:, 2]), chars / total, np.minimum(kids_a, 200), kids_a[par], np.array(place) / np.maximum(kids_a[par], 1), [same.get((parent[i], page.tag[i]), 1) for i in range(n)],
        (chars[par] - chars) / np.maximum(kids_a[par] - 1, 1), np.log1p(chars[par]), [t[0] == "h" and t[1:].isdigit() for t in page.tag], np.array(biggest) / np.maximum(chars, 1), own[0] > 0,
    ]
    for k, col in enumerate(rest):
        out[:, 1 + 2 * N_GROUPS + k] = col
    return out


def decode(score: np.ndarray, parent: list[int]) -> np.ndarray:
    """The set of nodes with the largest sum of scores in which every kept node's parent is kept; the root always is."""
    best = score.astype(float).tolist()
    for i in range(len(parent) - 1, 0, -1):
        if best[i] > 0:
            best[parent[i]] += best[i]
    keep = [True] * len(parent)
    for i in range(1, len(parent)):
        keep[i] = keep[parent[i]] and best[i] > 0
    return np.array(keep)


# --- boosted trees -------------------------------------------------------------------------------


@dataclass
class Trees:
    """Perfect binary trees of one depth: split features and cuts by level, and leaf values."""

    depth: int
    feature: np.ndarray  # trees x (2^depth - 1)
    cut: np.ndarray
    leaf: np.ndarray  # trees x 2^depth
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.prior)
        rows = np.arange(len(x))
        for f, c, v in zip(self.feature, self.cut, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, f[node]] > c[node])
            out += v[node - (len(f))]
        return out


def boost(x: np.ndarray, y: np.ndarray, weight: np.ndarray, trees: int = 40, depth: int = 4, rate: float = 0.25, bins: int = 24) -> Trees:
    """Logistic gradient boosting with histograms and Newton leaves."""
    n, width = x.shape
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(width)]
    binned = np.stack([np.searchsorted(cuts[j], x[:, j], side="left") for j in range(width)], 1)
    prior = float(np.log((weight * y).sum() / (weight * (1 - y)).sum()))
    f = np.full(n, prior)
    feature, cut, leaf = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-f))
        g, h = weight * (y - p), weight * p * (1 - p)
        node = np.zeros(n, np.int64)
        tf, tc = np.zeros(2**depth - 1, np.int64), np.full(2**depth - 1, np.inf)
        for level in range(depth):
            first, count = 2**level - 1, 2**level
            local = node - first
            gain_best = np.full(count, 1e-6)
            for j in range(width):
                if not len(cuts[j]):
                    continue
                b = len(cuts[j]) + 1
                key = local * b + binned[:, j]
                gs = np.bincount(key, g, count * b).reshape(count, b).cumsum(1)
                hs = np.bincount(key, h, count * b).reshape(count, b).cumsum(1)
                gt, ht = gs[:, -1:], hs[:, -1:]
                gl, hl = gs[:, :-1], hs[:, :-1]
                gain = gl**2 / (hl + 1) + (gt - gl) ** 2 / (ht - hl + 1) - gt**2 / (ht + 1)
                at = gain.argmax(1)
                top = gain[np.arange(count), at]
                for q in np.flatnonzero(top > gain_best):
                    gain_best[q], tf[first + q], tc[first + q] = top[q], j, cuts[j][at[q]]
            node = 2 * node + 1 + (x[np.arange(n), tf[node]] > tc[node])
        local = node - (2**depth - 1)
        value = rate * np.bincount(local, g, 2**depth) / (np.bincount(local, h, 2**depth) + 1)
        f += value[local]
        feature.append(tf)
        cut.append(tc)
        leaf.append(value)
    return Trees(depth, np.array(feature), np.array(cut), np.array(leaf), prior)


# --- the labelled pages --------------------------------------------------------------------------


def made_page(r: np.random.Generator) -> str:
    """A page of random layout; data-y marks article (1) and the rest (0), and is no feature."""
    pick = lambda *x: x[int(r.integers(len(x)))]
    chance = lambda p: r.random() < p
    word = lambda: "".join(pick(*"abcdeghilmnoprstu") for _ in range(int(r.integers(2, 9))))

    def words(a, z):
        return " ".join(word() for _ in range(int(r.integers(a, z))))

    def sentence():
        return words(4, 16).capitalize() + pick(".", ".", ".", "?", "!")

    def prose(a=1, z=5):
        s = " ".join(sentence() for _ in range(int(r.integers(a, z))))
        return f'{s} <a href="/x">{word()}</a> {word()}.' if chance(0.1) else s

    def attr(kind, p=0.7):
        if not chance(p):
            return f' class="{word()}"' if chance(0.4) else ""
        t = pick(*TOKENS[kind])
        return f' {pick("class", "class", "id")}="{pick(t, t + "-" + word(), word() + " " + t, t + "_" + pick("box", "wrap", "list"))}"'

    def link_list(n, kind, p=0.5):
        items = "".join(f'<li><a href="/{word()}">{words(1, 4)}</a></li>' for _ in range(n))
        return f"<ul{attr(kind, p)}>{items}</ul>"

    def boiler(kind):
        if kind == "nav":
            inner = pick(link_list(int(r.integers(3, 10)), "nav", 0.4), " ".join(f'<a href="/{word()}">{word()}</a>' for _ in range(6)))
            return pick(f'<nav data-y="0"{attr("nav", 0.3)}>{inner}</nav>', f'<div data-y="0"{attr("nav", 0.9)}>{inner}</div>')
        if kind == "header":
            inner = f"<h1>{words(1, 3)}</h1>" if chance(0.4) else f"<p>{words(1, 5)}</p>"
            return pick(f'<header data-y="0"{attr("header", 0.3)}>{inner}{boiler("nav") if chance(0.5) else ""}</header>', f'<div data-y="0"{attr("header", 0.9)}>{inner}</div>')
        if kind == "footer":
            inner = f"&copy; {words(1, 4)} &middot; {words(1, 3)}" if chance(0.6) else f"<p>{words(3, 12)}</p>" + link_list(4, "footer", 0.2)
            return pick(f'<footer data-y="0"{attr("footer", 0.3)}>{inner}</footer>', f'<footer data-y="0">{inner}</footer>', f'<div data-y="0"{attr("footer", 0.95)}>{inner}</div>')
        if kind == "side":
            inner = f"<h3>{words(1, 3)}</h3>" + pick(link_list(5, "side", 0.3), f"<p>{prose(1, 3)}</p>", "".join(f"<p>{prose(1, 3)}</p>" for _ in range(3)))
            return pick(f'<aside data-y="0"{attr("side", 0.5)}>{inner}</aside>', f'<div data-y="0"{attr("side", 0.95)}>{inner}</div>', f'<section data-y="0"{attr("side", 0.95)}>{inner}</section>')
        if kind == "comment":
            inner = "".join(f'<{t}{attr("comment", 0.6)}><p>{prose(1, 4)}</p></{t}>' for t in [pick("div", "li", "article")] for _ in range(int(r.integers(1, 6))))
            return pick(f'<section data-y="0"{attr("comment", 0.97)}><h3>{words(1, 2)}</h3>{inner}</section>', f'<div data-y="0"{attr("comment", 0.97)}>{inner}</div>')
        if kind == "form":
            inner = f'<label>{words(1, 3)}</label><input name="q"><button>{word()}</button>'
            return pick(f'<form data-y="0"{attr("form", 0.5)}>{inner}</form>', f'<div data-y="0"{attr("form", 0.9)}><p>{words(2, 8)}</p><form>{inner}</form></div>')
        inner = pick(prose(1, 3), f"<p>{prose(1, 3)}</p>", words(2, 8), f'<a href="/x">{words(1, 6)}</a>')
        return f'<{pick("div", "div", "section", "aside")} data-y="0"{attr(kind, 0.95)}>{inner}</div>'.replace("<section", "<div").replace("<aside", "<div")

    def block():
        k = r.random()
        if k < 0.72:
            return f"<p>{prose()}" + pick("</p>", "</p>", "</p>", "") if not chance(0.12) else f"<p><b>{sentence()}<br>"
        if k < 0.82:
            return f"<h{(h := pick(2, 3))}>{words(1, 6)}</h{h}>"
        if k < 0.88:
            return f"<ul>{''.join(f'<li>{pick(sentence(), words(2, 7))}</li>' for _ in range(int(r.integers(2, 6))))}</ul>"
        if k < 0.92:
            return f"<blockquote><p>{prose()}</p></blockquote>"
        if k < 0.95:
            return f"<pre>{words(3, 12)}\n{words(2, 9)}</pre>"
        if k < 0.97:
            return f"<table><tr><td>{word()}</td><td>{words(1, 4)}</td></tr><tr><td>{word()}</td><td>{word()}</td></tr></table>"
        return f"<div>{prose()}</div>"

    inside = []
    n = int(r.integers(1, 26))
    if chance(0.75):
        inside.append(f"<h1>{words(2, 9)}</h1>")
    for _ in range(n):
        inside.append(block())
        if chance(0.05):
            inside.append(boiler(pick("ad", "ad", "notice", "form", "side")))
    if chance(0.15):
        inside.append(boiler("comment"))
    core = "".join(inside)
    shell = pick("article", "article", "main", "div", "section")
    core = f'<{shell} data-y="1"{attr("main", 0.9 if shell == "div" else 0.4)}>{core}</{shell}>'
    if chance(0.3):
        core = f'<div{attr("main", 0.6)}>{core}</div>'
    before = [boiler(k) for k in ("header", "nav", "notice", "ad", "side", "form") if chance(0.4)]
    after = [boiler(k) for k in ("comment", "side", "ad", "form", "nav", "notice") if chance(0.3)]
    r.shuffle(before)
    r.shuffle(after)
    if chance(0.8):
        after.append(boiler("footer"))
    body = "".join(before) + core + "".join(after)
    return f"<!DOCTYPE html><html><head><title>{words(2, 6)}</title><style>p{{}}</style></head><body>{body}</body></html>"


def labels(page: Page) -> np.ndarray:
    """1 for nodes of the article and for what holds them."""
    y = [0] * len(page.tag)
    for i in range(1, len(y)):
        own = page.label[i]
        y[i] = own if own is not None else y[page.parent[i]]
    for i in range(len(y) - 1, 0, -1):
        if y[i]:
            y[page.parent[i]] = 1
    return np.array(y)


def train(pages: int = 260, seed: int = 11, **how) -> Trees:
    r = np.random.default_rng(seed)
    made = [Page(made_page(r), labelled=True) for _ in range(pages)]
    x, y = np.concatenate([features(p) for p in made]), np.concatenate([labels(p) for p in made])
    # A node counts by its text, as what is at stake is text.
    weight = np.concatenate([0.3 + np.log1p(np.array(p.chars)) / 5 for p in made])
    return boost(x, y.astype(float), weight, **how)


_MODEL: dict[str, Trees] = {}


def default_model() -> Trees:
    """The model of the made pages; trained once a process, in some seconds."""
    if "trees" not in _MODEL:
        _MODEL["trees"] = train()
    return _MODEL["trees"]


# --- extraction ----------------------------------------------------------------------------------


def extract_batch(sources: list[str | None], trees: Trees) -> list[str]:
    """The main text of each page: kept runs in page order, one a line."""
    pages = [Page(s or "") for s in sources]
    full = [i for i, p in enumerate(pages) if p.runs]
    out = [""] * len(pages)
    if not full:
        return out
    x = [features(pages[i]) for i in full]
    score = trees.score(np.concatenate(x))
    at = 0
    for i, rows in zip(full, x, strict=True):
        keep = decode(score[at : at + len(rows)], pages[i].parent)
        at += len(rows)
        out[i] = "\n".join(s for node, s in pages[i].runs if keep[node])
    return out


def main_text(pages: DataFrame, *, html: str = "html", out: str = "_main_text", model: Trees | None = None) -> DataFrame:
    """pages with a column (named out, or with underscores before it) of the main text."""
    # A few dozen small trees, whatever the data.
    cast = pages.sparkSession.sparkContext.broadcast(model or default_model())

    @F.pandas_udf(T.StringType())
    def text(col):
        import pandas as pd

        rows: list[str] = []
        for at in range(0, len(col), 256):
            rows += extract_batch(list(col.iloc[at : at + 256]), cast.value)
        return pd.Series(rows, dtype=object)

    flat, at = by_place(pages)
    return flat.select("*", text(F.col(at[html]))).toDF(*pages.columns, free_name(pages, out))


def op7_html_main(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: the main text of every page."""
    out = main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", F.col("_main_text").alias("text"), F.length("_main_text").cast("bigint").alias("n_chars"))
