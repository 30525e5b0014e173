"""Main text of web pages by gradient-boosted trees over DOM nodes, with hierarchical decoding.

A page becomes a tree of block elements and runs (the inline content between block boundaries). Every node has
features of its subtree (text, links, tags, punctuation), its attribute tokens and those above it, its depth and
its siblings. Boosted trees give the probability that a node holds main text. Decoding picks the most likely
labelling in which no node is kept below a dropped one, by one pass up and one pass down the tree.

There are no labelled pages: the model is fitted on a bounded sample of the given pages. Where a page says itself
what its article is (article or main elements), that is its label; and the sample's texts are laid out again in
random templates (other elements, class names, orders; with notices, side bars, adverts, forms and comments),
whose labels are known.
"""

from __future__ import annotations

import html
import math
import random
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointloom.llm.common import thinned

MAX_PAGES = 300
MAX_CHARS = 60_000
TEMPLATES = 900

# A tag's attributes as browsers read them: a quote opens a value only behind "="; one that nothing closes is a plain
# character. Every part is atomic, so no page takes more than one reading.
_MARKUP = re.compile(
    r"<!--|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[\s/]++|[^\s/>][^\s/>=]*+(?>\s*+=\s*+(?>\"[^\"]*+\"|'[^']*+'|[^\s>]++)?+)?+)*+)>|<[!?][^>]*>"
)
_ATTRIBUTES = re.compile(r"(?:^|\s)(?:class|id|role|data-main)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_RAW = {"script", "style", "textarea", "title", "iframe"}
# Elements that nest and whose content is left out as a whole.
_LEFT_OUT = {"noscript", "template", "svg", "select", "object"}
_LEFT_OUT_TAGS = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|textarea|title|iframe)(?=[\s/>]).*?(?:</\1|\Z)|<(/?)(noscript|template|svg|select|object)(?=[\s/>])[^>]*>", re.I | re.A | re.S
)
# case of ASCII letters alone: offsets in a lowered page are not the page's, as some letters grow
_RAW_END = {tag: re.compile("</" + tag, re.I | re.A) for tag in _RAW}
_VOID = {"br", "img", "hr", "input", "meta", "link", "wbr", "area", "base", "col", "embed", "param", "source", "track"}
_GROUPS = (
    ("article", "main"),
    ("nav", "menu", "menuitem", "dialog"),
    ("footer",),
    ("header", "hgroup"),
    ("aside",),
    ("form", "fieldset", "button", "label", "legend"),
    ("p", "blockquote", "pre", "address", "figcaption"),
    ("h1", "h2", "h3", "h4", "h5", "h6"),
    ("ul", "ol", "li", "dl", "dt", "dd"),
    ("table", "tbody", "thead", "tfoot", "tr", "td", "th", "caption"),
    ("html", "body", "head", "div", "section", "center", "figure", "details", "summary"),
)
_GROUP = {tag: k for k, tags in enumerate(_GROUPS) for tag in tags}
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPE = {"ul", "ol", "table", "dl", "body", "html"}
# Words of class, id and role that speak for and against main text.
GOOD = {"article", "content", "post", "entry", "story", "main", "body", "text", "blog", "hentry", "page", "prose", "document"}
BAD = set(
    "nav navbar navigation menu menubar breadcrumb breadcrumbs crumbs ad ads advert advertisement sponsor sponsored promo promotion banner footer foot header masthead head sidebar side aside rail "
    "comment comments reply replies discussion disqus form login signup subscribe newsletter search cookie cookies consent notice alert popup modal overlay share sharing social related recommended "
    "widget tags pagination pager toolbar copyright legal disclaimer meta byline author rating contentinfo complementary".split()
)
N_FEATURES = 40
Nodes = tuple[list[str], list[int], list[str], list[list[str] | None], list[int]]


def _tokens(attributes: str) -> set[str]:
    found = set()
    for m in _ATTRIBUTES.finditer(attributes):
        value = m[1] or m[2] or m[3] or ""
        found.update(t.lower() for t in re.split(r"[^A-Za-z]+", _CAMEL.sub(" ", value)) if t)
    return found


def _left_out_ends(page: str) -> dict[int, int]:
    """For the start tags of elements that are left out and are closed: where their own end tags begin."""
    open_: dict[str, list[int]] = {tag: [] for tag in _LEFT_OUT}
    ends: dict[int, int] = {}
    for m in _LEFT_OUT_TAGS.finditer(page):
        if m[3] is None or not m[2] and m[0].endswith("/>"):
            continue
        same = open_[m[3].lower()]
        if not m[2]:
            same.append(m.start())
        elif same:
            ends[same.pop()] = m.start()
    return ends


def parse(page: str) -> Nodes:
    """Tags, parents, attribute text, pieces of runs, and the link characters of each node, in page order.

    A run has the tag "" and is the child of its block. The first node stands for the page. Scripts, styles and
    comments are no nodes. Unclosed and misplaced end tags are mended as browsers do in the simple cases. Elements that
    are left out, such as svg and noscript, may nest; one that nothing closes ends with the next tag of a block, so that
    it takes no text with it but its own.
    """
    tags, parents, attrs, runs, links = ["html"], [-1], [""], [None], [0]
    open_: list[tuple[str, int]] = [("html", 0)]  # inline elements carry the node of their block
    run, in_link, at, n = -1, 0, 0, len(page)
    muted, left_out = False, None
    end_of_markup = max(page.rfind(">") + 1, page.rfind("<!--") + 4)  # behind it no tag can end

    def text(piece: str) -> None:
        nonlocal run
        if not piece or muted:
            return
        if "&" in piece:
            piece = html.unescape(piece)
        if run < 0:
            if not piece.strip():
                return
            run = len(tags)
            tags.append("")
            parents.append(open_[-1][1])
            attrs.append("")
            runs.append([])
            links.append(0)
        runs[run].append(piece)
        if in_link:
            links[run] += len(piece)

    def control() -> None:
        tags.append("button")
        parents.append(open_[-1][1])
        attrs.append("")
        runs.append(None)
        links.append(0)

    while at < n:
        m = _MARKUP.search(page, at, end_of_markup)
        if m is None:
            text(page[at:])
            break
        text(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            if m[0] == "<!--":
                end = page.find("-->", at)
                at = n if end < 0 else end + 3
            continue
        tag = m[2].lower()
        if m[1]:
            if tag in _VOID:
                continue
            if tag in _LEFT_OUT or tag in _GROUP:
                muted = False
            k = next((k for k in range(len(open_) - 1, 0, -1) if open_[k][0] == tag), 0)
            if k and not (tag not in _GROUP and any(t in _GROUP for t, _ in open_[k + 1 :])):
                if any(t in _GROUP for t, _ in open_[k:]):
                    run = -1
                in_link -= sum(t == "a" for t, _ in open_[k:])
                del open_[k:]
            continue
        if tag in _RAW:
            if not m[3].endswith("/"):
                end = _RAW_END[tag].search(page, at)
                at = n if end is None else end.start()
            if tag == "textarea":
                control()
            continue
        if tag in _LEFT_OUT:
            if not m[3].endswith("/"):
                left_out = _left_out_ends(page) if left_out is None else left_out
                end = left_out.get(m.start())
                muted = muted or end is None
                at = at if end is None else end
            if tag == "select":
                control()
            continue
        if tag in _VOID:
            if tag == "br" or tag == "hr":
                if run >= 0:
                    runs[run].append(" ")
                if tag == "hr":
                    run = -1
            elif tag == "input":
                control()
            continue
        if tag not in _GROUP:
            open_.append((tag, open_[-1][1]))
            in_link += tag == "a"
            continue
        muted = False
        if tag in ("html", "head", "body") and any(t == tag for t, _ in open_):
            if tag != "html":
                continue
            continue
        run = -1
        closed = _CLOSES.get(tag)
        for k in range(len(open_) - 1, 0, -1):
            name = open_[k][0]
            if name == "p" and tag not in ("td", "th", "tr") or closed and name in closed:
                in_link -= sum(t == "a" for t, _ in open_[k:])
                del open_[k:]
                break
            if name in _SCOPE or (name in _GROUP and not closed):
                break
        tags.append(tag)
        parents.append(open_[-1][1])
        attrs.append(m[3])
        runs.append(None)
        links.append(0)
        if not m[3].endswith("/") or tag in ("div", "p"):
            open_.append((tag, len(tags) - 1))
    return tags, parents, attrs, runs, links


_seen_attrs: dict[str, tuple[int, int]] = {}


def _good_bad(attributes: str) -> tuple[int, int]:
    if not attributes or "=" not in attributes:
        return 0, 0
    found = _seen_attrs.get(attributes)
    if found is None:
        if len(_seen_attrs) > 50_000:
            _seen_attrs.clear()
        tokens = _tokens(attributes)
        found = _seen_attrs[attributes] = len(tokens & GOOD), len(tokens & BAD)
    return found


def run_text(pieces: list[str]) -> str:
    """The text of a run: all white space that Unicode knows, as no-break spaces, is one space, and none at the ends."""
    return " ".join("".join(pieces).split())


def features(nodes: Nodes) -> tuple[np.ndarray, list[str]]:
    """One row of features per node, and the text of each run ("" for blocks)."""
    tags, parents, attrs, runs, links = nodes
    n = len(tags)
    texts = [run_text(r) if r is not None else "" for r in runs]
    # per node: characters, link characters, words, signs, nodes, paragraphs, links, items, controls, headings, runs
    s = np.zeros((n, 11))
    for i, t in enumerate(texts):
        tag = tags[i]
        if t:
            s[i, 0], s[i, 1], s[i, 2], s[i, 10] = len(t), min(links[i], len(t)), t.count(" ") + 1, 1
            s[i, 3] = t.count(",") + t.count(".") + t.count(";") + t.count("!") + t.count("?")
            s[i, 6] = links[i] > 0
        elif tag:
            s[i, 4] = 1
            g = _GROUP.get(tag, 10)
            if g == 6:
                s[i, 5] = 1
            elif g == 8:
                s[i, 7] = tag == "li"
            elif g == 5:
                s[i, 8] = 1
            elif g == 7:
                s[i, 9] = 1
    own = s.copy()
    depth, path_good, path_bad, path_main, path_off = [0] * n, [0] * n, [0] * n, [0] * n, [0] * n
    marks = [_good_bad(a) for a in attrs]
    group = [_GROUP.get(t, 10) if t else 11 for t in tags]
    children: list[list[int]] = [[] for _ in range(n)]
    for i in range(1, n):
        p = parents[i]
        children[p].append(i)
        depth[i] = depth[p] + 1
        path_good[i] = path_good[p] + marks[p][0]
        path_bad[i] = path_bad[p] + marks[p][1]
        path_main[i] = path_main[p] or group[p] == 0
        path_off[i] = path_off[p] or 1 <= group[p] <= 5
    for i in range(n - 1, 0, -1):
        s[parents[i]] += s[i]
    index, siblings = np.zeros(n), np.ones(n)
    before, after = np.zeros(n), np.zeros(n)
    for kids in children:
        k = len(kids)
        if k:
            index[kids] = np.arange(k) / k
            siblings[kids] = k
            size = s[kids, 0]
            before[kids[1:]] = size[:-1]
            after[kids[:-1]] = size[1:]
    total = max(s[0, 0], 1.0)
    parent = np.array([max(p, 0) for p in parents])
    x = np.zeros((n, N_FEATURES), np.float32)
    density = s[:, 1] / np.maximum(s[:, 0], 1)
    x[:, 0], x[:, 1], x[:, 2] = np.log1p(s[:, 0]), density, np.log1p(s[:, 2])
    x[:, 3] = np.log1p(s[:, 0] / (s[:, 4] + 1))
    x[:, 4] = s[:, 3] / np.maximum(s[:, 2], 1)
    x[:, 5], x[:, 6], x[:, 7] = depth, np.log1p(siblings), index
    x[:, 8] = (np.cumsum(own[:, 0]) - own[:, 0]) / total
    x[:, 9] = s[:, 0] / total
    for k, c in enumerate((5, 6, 7, 8, 9)):
        x[:, 10 + k] = np.log1p(s[:, c])
    x[np.arange(n), 15 + np.array(group)] = 1
    x[:, 27:29] = marks
    x[:, 29], x[:, 30], x[:, 31], x[:, 32] = path_good, path_bad, path_main, path_off
    x[:, 33], x[:, 34], x[:, 35] = density[parent], np.log1p(before), np.log1p(after)
    x[:, 36] = np.log1p(s[:, 0] / np.maximum(s[:, 10], 1))
    x[:, 37] = x[parent, 0]
    x[:, 38] = s[:, 0] / np.maximum(s[parent, 0], 1)
    x[:, 39] = np.log1p(s[:, 10])
    return x, texts


class BoostedTrees:
    """Gradient-boosted regression trees on binned features with logistic loss; trees are complete, of one depth."""

    def __init__(self, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 32, least: float = 2.0):
        self.trees, self.depth, self.rate, self.bins, self.least = trees, depth, rate, bins, least
        self.fitted: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.base = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        n, f = x.shape
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins)[1:-1])) for j in range(f)]
        binned = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], axis=1)
        share = min(max(float(y.mean()), 1e-4), 1 - 1e-4) if n else 0.5
        self.base = math.log(share / (1 - share))
        z = np.full(n, self.base)
        for _ in range(self.trees if n else 0):
            p = 1 / (1 + np.exp(-z))
            g, h = y - p, np.maximum(p * (1 - p), 1e-6)
            feature = np.zeros(2**self.depth - 1, np.int32)
            cut = np.full(2**self.depth - 1, np.inf)
            leaf = np.zeros(n, np.int64)
            for level in range(self.depth):
                first, count = 2**level - 1, 2**level
                gains = np.full((count, f), -np.inf)
                splits = np.zeros((count, f), np.int32)
                for j in range(f):
                    if not len(cuts[j]):
                        continue
                    key = leaf * self.bins + binned[:, j]
                    gs = np.bincount(key, g, count * self.bins).reshape(count, -1).cumsum(axis=1)
                    hs = np.bincount(key, h, count * self.bins).reshape(count, -1).cumsum(axis=1)
                    gt, ht = gs[:, -1:], hs[:, -1:]
                    gain = gs**2 / (hs + 1) + (gt - gs) ** 2 / (ht - hs + 1) - gt**2 / (ht + 1)
                    gain[(hs < self.least) | (ht - hs < self.least)] = -np.inf
                    gain = gain[:, : len(cuts[j])]
                    splits[:, j] = gain.argmax(axis=1)
                    gains[:, j] = gain.max(axis=1)
                best = gains.argmax(axis=1)
                for k in range(count):
                    if gains[k, best[k]] > 1e-6:
                        feature[first + k] = best[k]
                        cut[first + k] = cuts[best[k]][splits[k, best[k]]]
                leaf = 2 * leaf + (x[np.arange(n), feature[first + leaf]] > cut[first + leaf])
            value = self.rate * np.bincount(leaf, g, 2**self.depth) / (np.bincount(leaf, h, 2**self.depth) + 1)
            z += value[leaf]
            self.fitted.append((feature, cut.astype(np.float32), value))
        return self

    def logits(self, x: np.ndarray) -> np.ndarray:
        z, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, cut, value in self.fitted:
            leaf = np.zeros(len(x), np.int64)
            for level in range(self.depth):
                at = 2**level - 1 + leaf
                leaf = 2 * leaf + (x[rows, feature[at]] > cut[at])
            z += value[leaf]
        return z


def decode(parents: list[int], logits: np.ndarray) -> list[bool]:
    """The most likely labels of which none is kept below a dropped one."""
    keep = (-np.logaddexp(0, -logits)).tolist()
    drop = (-np.logaddexp(0, logits)).tolist()
    n = len(keep)
    for i in range(n - 1, 0, -1):
        p = parents[i]
        keep[p] += max(keep[i], drop[i])
        drop[p] += drop[i]
    out = [keep[0] >= drop[0]] if n else []
    for i in range(1, n):
        out.append(out[parents[i]] and keep[i] >= drop[i])
    return out


def labels(nodes: Nodes) -> np.ndarray | None:
    """Whether each node holds main text, by marks of a template or by article and main elements; None if unknown."""
    tags, parents, attrs, runs, _ = nodes
    marked = any("data-main" in a for a in attrs)
    if not marked and not any(t in ("article", "main") for t in tags):
        return None
    inside = [False] * len(tags)
    for i in range(1, len(tags)):
        inside[i] = inside[parents[i]]
        if marked:
            if "data-main" in attrs[i]:
                inside[i] = "data-main=1" in attrs[i]
        elif tags[i] in ("article", "main"):
            inside[i] = True
        elif tags[i] and (1 <= _GROUP.get(tags[i], 10) <= 5 or _good_bad(attrs[i])[1]):
            inside[i] = False
    y = np.zeros(len(tags))
    for i in range(len(tags) - 1, 0, -1):
        if runs[i] is not None and inside[i]:
            y[i] = 1
        if y[i]:
            y[parents[i]] = 1
    return y


# How the parts of template pages are written, as (element, attributes).
_PARTS = {
    "main": [("article", ""), ("main", ""), ("div", 'class="content"'), ("div", 'class="post-body entry"'), ("section", 'id="story"'), ("div", 'id="main-content"'), ("div", ""), ("div", 'class="entry-content"'), ("div", 'role="main"'), ("td", ""), ("section", "")],
    "nav": [("nav", ""), ("div", 'class="menu"'), ("div", 'id="navigation"'), ("ul", 'class="navbar"'), ("div", 'class="breadcrumbs"'), ("div", 'role="navigation"')],
    "header": [("header", ""), ("div", 'id="header"'), ("div", 'class="masthead"'), ("div", 'class="site-header"')],
    "footer": [("footer", ""), ("div", 'id="footer"'), ("div", 'class="site-footer"'), ("div", 'class="copyright"'), ("div", 'role="contentinfo"')],
    "side": [("aside", ""), ("div", 'class="sidebar"'), ("div", 'id="side-rail"'), ("div", 'class="related widget"'), ("div", 'class="recommended"')],
    "ad": [("div", 'class="ad"'), ("div", 'class="ads banner"'), ("aside", 'class="sponsored"'), ("div", 'id="advertisement"'), ("div", 'class="promo"'), ("p", 'class="ad"')],
    "notice": [("div", 'class="cookie-notice"'), ("div", 'id="consent-banner"'), ("div", 'class="alert"'), ("div", 'class="notice"'), ("div", 'role="alert"'), ("dialog", "")],
    "form": [("form", ""), ("form", 'class="newsletter"'), ("div", 'class="subscribe"'), ("form", 'id="search"'), ("div", 'class="login-form"')],
    "comments": [("section", 'id="comments"'), ("div", 'class="comments"'), ("div", 'class="comment-list"'), ("ol", 'class="commentlist"'), ("div", 'id="disqus_thread" class="discussion"')],
    "share": [("div", 'class="share"'), ("ul", 'class="social"'), ("div", 'class="tags"'), ("p", 'class="byline"'), ("div", 'class="meta"')],
}


def _template(rng: random.Random, pool: list[str]) -> str:
    """A page of random layout with texts of the pool; main blocks are marked with data-main=1, others with 0."""
    esc = lambda t: html.escape(t, quote=False)

    def words(a: int, b: int) -> str:
        w = rng.choice(pool).split()
        k = rng.randrange(max(1, len(w) - a))
        return esc(" ".join(w[k : k + rng.randrange(a, b)]))

    def list_of(n: int) -> str:
        return "<ul>" + "".join(f'<li><a href="#">{words(1, 4)}</a></li>' for _ in range(n)) + "</ul>"

    def paragraphs(n: int, wrap: tuple[str, ...]) -> str:
        out = []
        for _ in range(n):
            tag, body = rng.choice(wrap), esc(rng.choice(pool))
            if rng.random() < 0.2:
                cut = rng.randrange(len(body) + 1)
                cut = body.find(" ", cut) if " " in body[cut:] else len(body)
                body = body[:cut] + (f' <a href="#">{words(1, 5)}</a>' if rng.random() < 0.5 else f" <b>{words(1, 5)}</b>") + body[cut:]
            out.append(body + "<br>" if tag == "br" else f"<{tag}>{body}</{tag}>" if rng.random() < 0.9 or tag != "p" else f"<p>{body}")
        return "".join(out)

    def part(kind: str, body: str, main: bool = False) -> str:
        tag, attributes = rng.choice(_PARTS[kind])
        tag = "div" if tag == "td" and not main else tag
        inner = f"<{tag} {attributes} data-main={int(main)}>{body}</{tag}>"
        return f"<table><tr>{inner}</tr></table>" if tag == "td" else inner

    def other(kind: str) -> str:
        if kind == "nav":
            return part(kind, list_of(rng.randrange(3, 9)))
        if kind in ("side", "share"):
            return part(kind, (f"<h3>{words(1, 5)}</h3>" if rng.random() < 0.5 else "") + (list_of(rng.randrange(2, 8)) if rng.random() < 0.6 else paragraphs(rng.randrange(1, 3), ("p", "div"))))
        if kind == "comments":
            return part(kind, f"<h3>{words(1, 3)}</h3>" + "".join(f'<div class="comment"><b>{words(1, 3)}</b>{paragraphs(1, ("p", "div"))}</div>' for _ in range(rng.randrange(1, 6))))
        if kind == "form":
            return part(kind, f"<label>{words(1, 6)}</label><input name=q><button>{words(1, 3)}</button>")
        if kind == "header":
            return part(kind, f"<h1>{words(1, 5)}</h1><p>{words(3, 10)}</p>" if rng.random() < 0.5 else f"<a href=/>{words(1, 4)}</a>")
        return part(kind, rng.choice([f"<p>{words(3, 30)}</p>", words(3, 30), f"{words(2, 12)} <a href=#>{words(1, 3)}</a>"]))

    wrap = rng.choice([("p",), ("p",), ("p", "p", "blockquote"), ("div",), ("br",), ("p", "h2"), ("p", "li")])
    body = (f"<h1>{words(3, 12)}</h1>" if rng.random() < 0.7 else "") + paragraphs(rng.randrange(1, 12), wrap)
    inside = "".join(other(rng.choice(["share", "ad", "side", "form"])) for _ in range(rng.choice([0, 0, 0, 1, 2])))
    main = part("main", inside + body if rng.random() < 0.5 else body + inside, True)
    head = [other(k) for k in ("header", "nav", "notice", "ad", "form") if rng.random() < 0.5]
    tail = [other(k) for k in ("comments", "side", "ad", "form", "footer", "nav") if rng.random() < 0.5]
    rng.shuffle(head)
    page = "".join(head) + main + "".join(tail)
    if rng.random() < 0.3:
        page = f"<div class={rng.choice(['wrapper', 'container', 'page', 'row'])}>{page}</div>"
    return f"<html><head><title>{words(2, 8)}</title></head><body>{page}</body></html>"


def fit_pages(pages: list[str], templates: int = TEMPLATES, seed: int = 1, **options) -> BoostedTrees:
    """The model of a list of pages and of templates filled with their longer runs."""
    rng, xs, ys, pool = random.Random(seed), [], [], []
    for page in pages:
        nodes = parse(page)
        x, texts = features(nodes)
        pool += [t for t in texts if len(t) >= 60]
        y = labels(nodes)
        if y is not None:
            xs.append(x)
            ys.append(y)
    pool = pool or ["A plain paragraph of some words, with a few more behind it."]
    for _ in range(templates):
        nodes = parse(_template(rng, pool))
        xs.append(features(nodes)[0])
        ys.append(labels(nodes))
    return BoostedTrees(**options).fit(np.concatenate(xs), np.concatenate(ys))


def extract(pages: list[str], model: BoostedTrees) -> list[str]:
    """The main text of each page: the kept runs, with white space as single spaces, joined by spaces."""
    parsed = [parse(p) for p in pages]
    made = [features(nodes) for nodes in parsed]
    if not made:
        return []
    logits = np.split(model.logits(np.concatenate([x for x, _ in made])), np.cumsum([len(x) for x, _ in made])[:-1])
    return [" ".join(t for t, k in zip(texts, decode(nodes[1], z)) if k and t) for nodes, (_, texts), z in zip(parsed, made, logits)]


def fit(pages: DataFrame, max_pages: int = MAX_PAGES, max_chars: int = MAX_CHARS, **options) -> BoostedTrees:
    """Fit on at most ``max_pages`` pages of up to ``max_chars`` code points, in the order of a hash of their html."""
    whole = pages.where(F.col("html").isNotNull() & (F.length("html") <= max_chars))
    some = thinned(whole, max_pages, "page_id").select("html", F.xxhash64("html").alias("h")).orderBy("h", "html").limit(max_pages)
    return fit_pages([r["html"] for r in some.collect()], **options)


def main_text(pages: DataFrame, keep: list[str] | None = None, model: BoostedTrees | None = None, **options) -> DataFrame:
    """The columns ``keep`` (page_id and url if None), text and n_chars (its code points) of every page.

    Null, empty and markup-only pages have the text "". Character references are decoded first, then all Unicode white
    space in a run becomes one space; runs are joined by one. Pages are parsed whole, however long. Repeated pages have
    equal results; an empty table gives an empty result (its model is fitted on templates alone); extra columns of
    ``pages`` are not read. Fitting looks at a bounded sample (:func:`fit`).
    """
    keep = ["page_id", "url"] if keep is None else keep
    shared = pages.sparkSession.sparkContext.broadcast(model or fit(pages, **options))  # of fixed size: the trees

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fitted = shared.value
        for frame in frames:
            whole, texts = list(frame["html"]), []
            for k in range(0, len(whole), 128):
                texts += extract(whole[k : k + 128], fitted)
            yield pd.DataFrame({"row": frame["row"], "text": texts})

    rows = pages.select(F.struct(*keep).alias("row"), F.coalesce("html", F.lit("")).alias("html"))
    out = rows.mapInPandas(run, f"row {rows.schema['row'].dataType.simpleString()}, text string")
    return out.select("row.*", "text", F.length("text").cast("long").alias("n_chars"))
