"""Main text of HTML pages: gradient-boosted trees over DOM nodes, decoded down the tree.

The trees give each element the chance of not being boilerplate, from its subtree's density, the names in its attributes, its depth
and its siblings. Decoding then takes the likeliest labelling of the whole page in which nothing inside a boilerplate element is
kept, so that an element and its descendants never contradict each other. The trees are fitted to made-up pages whose main text is known.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .html_pages import NAMES, Page

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']+|\"[^\"]*\"|'[^']*')*)>?|[^<]+|<", re.S)
_ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
_NAME = re.compile(r"[A-Za-z][a-z]*|[A-Z]+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is no text of the page.
RAW = frozenset("script style textarea title iframe noembed noframes template xmp".split())
SKIPPED = RAW | {"head", "noscript", "select", "svg", "math", "object", "audio", "video", "canvas"}
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: A start tag that closes an open element of these names, up to the nearest of the second set.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}),
}
P_CLOSERS = BLOCKS - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "option", "legend", "summary"}
GROUPS = [*NAMES, "main"]
_TAG_SETS = [{"article", "main"}, {"nav", "menu"}, {"header"}, {"footer"}, {"aside"}, {"form", "button", "label", "fieldset", "dialog"}, {"div", "section"}, {"p", "pre", "blockquote"}, {"h1"}, {"h2", "h3", "h4", "h5", "h6"}, {"ul", "ol", "dl"}, {"li", "dd", "dt"}, {"a"}, {"span", "b", "i", "em", "strong"}]
_STEMS = {
    "nav": ("nav", "menu", "breadcrumb", "pagin", "pager"), "header": ("header", "masthead", "topbar", "branding", "logo"), "footer": ("foot", "colophon", "copyright", "legal", "contentinfo"),
    "side": ("sidebar", "aside", "widget", "related", "recommend", "trending", "complementary", "rail"), "ad": ("advert", "sponsor", "promo", "adsense", "adbox"),
    "notice": ("cookie", "notice", "consent", "gdpr", "popup", "modal", "overlay", "paywall", "announce", "privacy", "toast", "alert"),
    "form": ("newsletter", "subscri", "signup", "search", "login", "form", "share", "social", "rating"), "comments": ("comment", "disqus", "discussion", "respon", "repl"),
    "main": ("article", "content", "post", "entry", "story", "main", "text", "body"),
}


@cache
def _groups_of(name: str) -> tuple[int, ...]:
    exact = {"ad": "ad", "ads": "ad", "adv": "ad", "side": "side", "toc": "nav", "banner": "notice"}
    return tuple(i for i, g in enumerate(GROUPS) if exact.get(name) == g or any(name.startswith(s) for s in _STEMS[g]))


@dataclass
class Node:
    tag: str
    parent: int
    depth: int
    groups: tuple[int, ...] = ()
    hidden: bool = False
    marked: bool = False
    text: int = 0
    linked: int = 0
    marks: int = 0
    tags: int = 0
    paragraphs: int = 0
    start: int = 0
    children: list[int] = field(default_factory=list)


def _attributes(source: str) -> tuple[tuple[int, ...], bool, bool]:
    groups: set[int] = set()
    hidden = marked = False
    for m in _ATTR.finditer(source):
        key, value = m[1].lower(), (m[2] or "").strip("\"'")
        if key in ("class", "id", "role", "itemprop"):
            for n in _NAME.findall(value):
                groups.update(_groups_of(n.lower()))
        elif key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and "display:none" in value.replace(" ", "").lower()):
            hidden = True
        elif key == "data-x":
            marked = True
    return tuple(groups), hidden, marked


def parse(source: str) -> tuple[list[Node], list[tuple[int, str | None]]]:
    """(elements, content): content is, in page order, (element, decoded text), or (element, None) where a block starts or ends.

    Follows how browsers mend markup as far as text depends on it: implied end tags, void and raw elements, stray end tags.
    """
    nodes, content, stack, at = [Node("html", -1, 0)], [], [0], 0
    match, size = _TOKEN.match, len(source)
    skip = 0
    while at < size:
        m = match(source, at)
        at = m.end()
        tag = m[2]
        if tag is None:
            t = m[0]
            if (t[0] != "<" or t == "<") and not skip:
                content.append((stack[-1], html.unescape(t) if "&" in t else t))
            continue
        tag = tag.lower()
        if m[1]:
            if tag not in VOID and any(nodes[i].tag == tag for i in stack[1:]):
                while True:
                    i = stack.pop()
                    skip -= nodes[i].tag in SKIPPED
                    if nodes[i].tag in BLOCKS:
                        content.append((stack[-1], None))
                    if nodes[i].tag == tag:
                        break
            continue
        if tag in ("html", "body") and len(stack) > 1 and any(nodes[i].tag == tag for i in stack):
            continue
        if tag == "html":
            continue
        closing, within = CLOSES.get(tag, ((), ()))
        if tag in P_CLOSERS:
            closing, within = ({"p"} | set(closing)), (set(within) | {"button", "td", "th", "table", "caption", "object"})
        if tag == "body":
            closing, within = {"head"}, set()
        if closing:
            for d in range(len(stack) - 1, 0, -1):
                if nodes[stack[d]].tag in closing:
                    for i in stack[d:]:
                        skip -= nodes[i].tag in SKIPPED
                    del stack[d:]
                    content.append((stack[-1], None))
                    break
                if nodes[stack[d]].tag in within:
                    break
        if tag in BLOCKS:
            content.append((stack[-1], None))
        elif tag == "br":
            content.append((stack[-1], " "))
        if tag in VOID:
            nodes[stack[-1]].tags += 1
            continue
        groups, hidden, marked = _attributes(m[3]) if m[3] and not m[3].isspace() else ((), False, False)
        node = Node(tag, stack[-1], len(stack), groups, hidden, marked)
        nodes[stack[-1]].children.append(len(nodes))
        nodes.append(node)
        if tag in RAW:
            end = re.compile(rf"</{tag}[\s/>]", re.I).search(source, at)
            at = end.start() if end else size
            end = source.find(">", at)
            at = end + 1 if end >= 0 else size
            continue
        skip += tag in SKIPPED
        stack.append(len(nodes) - 1)
    return nodes, content


def features(nodes: list[Node], content: list[tuple[int, str | None]]) -> np.ndarray:
    """A row for each element."""
    seen = 0
    for i, t in content:
        if t:
            n = len(t) - t.count(" ")
            nodes[i].text += n
            nodes[i].marks += t.count(",") + t.count(".")
            seen += n
    total, at = max(1, seen), 0
    first = [-1] * len(nodes)
    for i, t in content:
        if first[i] < 0:
            first[i] = at
        if t:
            at += len(t) - t.count(" ")
    rows = np.zeros((len(nodes), 17 + 2 * len(GROUPS) + len(_TAG_SETS)), np.float32)
    for i in range(len(nodes) - 1, 0, -1):
        n, p = nodes[i], nodes[nodes[i].parent]
        if n.tag == "a":
            n.linked = n.text
        p.text += n.text
        p.linked += n.linked
        p.marks += n.marks
        p.tags += n.tags + 1
        p.paragraphs += n.paragraphs + (n.tag == "p")
        if first[i] >= 0 and (first[n.parent] < 0 or first[i] < first[n.parent]):
            first[n.parent] = first[i]
    above = [np.zeros(len(GROUPS), np.float32)] * len(nodes)
    inside = [(0, 0, 0)] * len(nodes)
    place = [0] * len(nodes)
    for i, n in enumerate(nodes):
        for j, c in enumerate(n.children):
            place[c] = j
        own = np.zeros(len(GROUPS), np.float32)
        own[list(n.groups)] = 1
        up = above[n.parent] if i else own * 0
        above[i] = np.maximum(up, own)
        a = inside[n.parent] if i else (0, 0, 0)
        inside[i] = (a[0] or n.tag in ("article", "main"), a[1] or n.tag in ("nav", "aside", "footer", "form"), a[2] + (n.tag == "article"))
        p = nodes[n.parent] if i else n
        r = rows[i]
        r[:17] = (
            np.log1p(n.text), n.linked / max(1, n.text), n.text / (n.tags + 1), n.depth, np.log1p(n.paragraphs), n.text / total, len(p.children), place[i] / max(1, len(p.children)),
            max(0, first[i]) / total, n.marks * 100 / max(1, n.text), n.text / max(1, p.text), len(n.children), n.hidden, np.log1p(n.tags), a[0], a[1], a[2],
        )
        r[17 : 17 + len(GROUPS)] = own
        r[17 + len(GROUPS) : 17 + 2 * len(GROUPS)] = up
        for k, s in enumerate(_TAG_SETS):
            r[17 + 2 * len(GROUPS) + k] = n.tag in s
    return rows


@dataclass
class Trees:
    """Boosted trees of one depth: feature and bound of each inner node, and the value of each leaf, by tree."""

    feature: np.ndarray
    bound: np.ndarray
    leaf: np.ndarray
    base: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        depth = self.feature.shape[1].bit_length()
        rows, out = np.arange(len(x)), np.full(len(x), self.base)
        for f, b, v in zip(self.feature, self.bound, self.leaf, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(depth):
                at = 2 * at + 1 + (x[rows, f[at]] > b[at])
            out += v[at - len(f)]
        return out


def boost(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.3, bins: int = 24, l2: float = 1.0) -> Trees:
    """Newton boosting of the logistic loss over binned features."""
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
    base = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    f, inner = np.full(len(y), base), 2**depth - 1
    feature, bound, leaf = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1))
    for t in range(trees):
        p = 1 / (1 + np.exp(-f))
        g, h, at = y - p, p * (1 - p), np.zeros(len(y), np.int64)
        for level in range(depth):
            lo, width = 2**level - 1, 2**level
            best = np.full(width, 1e-6)
            where = at - lo
            gs, hs = np.bincount(where, g, width), np.bincount(where, h, width)
            for j, c in enumerate(cuts):
                if not len(c):
                    continue
                key, n = where * (len(c) + 1) + binned[:, j], width * (len(c) + 1)
                left_g = np.bincount(key, g, n).reshape(width, -1).cumsum(axis=1)[:, :-1]
                left_h = np.bincount(key, h, n).reshape(width, -1).cumsum(axis=1)[:, :-1]
                rg, rh = gs[:, None] - left_g, hs[:, None] - left_h
                gain = left_g**2 / (left_h + l2) + rg**2 / (rh + l2) - (gs**2 / (hs + l2))[:, None]
                k = gain.argmax(axis=1)
                top = gain[np.arange(width), k]
                better = top > best
                best[better] = top[better]
                feature[t, lo : lo + width][better] = j
                bound[t, lo : lo + width][better] = c[k[better]]
            at = 2 * at + 1 + (x[np.arange(len(x)), feature[t][at]] > bound[t][at])
        where = at - inner
        leaf[t] = rate * np.bincount(where, g, inner + 1) / (np.bincount(where, h, inner + 1) + l2)
        f += leaf[t][where]
    return Trees(feature, bound, leaf, base)


@cache
def model(pages: int = 1000, seed: int = 1000) -> Trees:
    """Trees fitted to so many made-up pages."""
    xs, ys = [], []
    for i in range(pages):
        nodes, content = parse(Page(seed + i).write())
        xs.append(features(nodes, content))
        bad = [False] * len(nodes)
        for j, n in enumerate(nodes):
            bad[j] = n.marked or (j > 0 and bad[n.parent])
        ys.append(1 - np.array(bad, float))
    return boost(np.concatenate(xs), np.concatenate(ys))


def decode(nodes: list[Node], logits: np.ndarray) -> list[bool]:
    """The likeliest labelling in which no element inside a dropped one is kept."""
    keep = -np.logaddexp(0, -logits)
    drop = -np.logaddexp(0, logits)
    kept, gone = keep.tolist(), drop.tolist()
    for i in range(len(nodes) - 1, 0, -1):
        p = nodes[i].parent
        kept[p] += max(kept[i], gone[i])
        gone[p] += gone[i]
    out = [True] * len(nodes)
    for i in range(1, len(nodes)):
        out[i] = out[nodes[i].parent] and kept[i] >= gone[i] and not nodes[i].hidden
    return out


def assemble(content: list[tuple[int, str | None]], kept: list[bool]) -> str:
    """Blocks of what is kept, white space in each as single spaces, joined by line feeds."""
    blocks, now = [], []
    for i, t in content:
        if t is None:
            if now:
                blocks.append(" ".join("".join(now).split()))
                now = []
        elif kept[i]:
            now.append(t)
    if now:
        blocks.append(" ".join("".join(now).split()))
    return "\n".join(b for b in blocks if b)


def main_texts(sources: list[str | None], trees: Trees) -> list[str]:
    parsed = [parse(s or "") for s in sources]
    rows = [features(*p) for p in parsed]
    logits = trees.logits(np.concatenate(rows)) if rows else np.empty(0)
    out, at = [], 0
    for (nodes, content), r in zip(parsed, rows, strict=True):
        out.append(assemble(content, decode(nodes, logits[at : at + len(r)])))
        at += len(r)
    return out


def extract(pages: DataFrame, trees: Trees | None = None) -> DataFrame:
    """The columns of pages but html, with text and n_chars (its code points); columns of those names are replaced.

    Every row is kept. Null and empty html give an empty text, and so does a page that is all boilerplate. Broken markup is read as
    far as it goes. Pages are taken a few hundred at a time, and a long one as a whole.
    """
    trees = trees or model()
    pages = pages.drop("text", "n_chars")
    kept = [f for f in pages.schema.fields if f.name != "html"]
    names = [f.name for f in kept]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts: list[str] = []
            for at in range(0, len(b), 200):
                texts += main_texts(b["html"].iloc[at : at + 200].tolist(), trees)
            yield b[names].assign(text=texts, n_chars=[len(t) for t in texts])

    return pages.mapInPandas(run, ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + ["text string", "n_chars long"]))


def op3(pages: DataFrame) -> DataFrame:
    return extract(pages.select("page_id", "url", "html"))
