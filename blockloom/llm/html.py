"""Main text of web pages by a linear-chain conditional random field over their leaf blocks.

A page is read once, in order, with a stack of open elements; text between block-level tags is a leaf block.
Features of a block are the tags, roles and name hints of its ancestors and simple properties of its text.
The chain labels each block as main text or not: weights of features and of transitions are fitted by maximum
likelihood (forward-backward, Adam) on labelled pages, and the best labelling is found by Viterbi's algorithm.
The labelled pages are built here, by rule and from a fixed seed, in many page layouts.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks, table

#: Labelled pages that a fit builds, one in so many more without any hints, steps of the fit.
PAGES, BARE, STEPS = 800, 6, 250

_MARKUP = r"<!--.*?(?:--!?>|\Z)|{}|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|<[!?/][^>]*+(?:>|\Z)|<[a-zA-Z][^>]*+\Z"
#: Comments and tags, whose quoted attributes may hold a ">"; nothing is tried twice, so a search is linear.
_TOKEN = re.compile(_MARKUP.format(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>"""), re.S)
#: The same without a look at quotes: for what follows a tag whose quotes never close.
_UNQUOTED = re.compile(_MARKUP.format(r"(?!)()()()"), re.S)
#: Elements whose content HTML reads as raw text; that of xmp is shown.
_RAW = {"script", "style", "title", "textarea", "iframe", "noembed", "noframes", "xmp"}
#: Elements whose text is mostly not shown: a feature of their blocks, by which the chain can reject them.
_FALLBACK = {"noscript", "template", "svg", "select", "datalist", "audio", "video", "canvas"}
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*(?:>|\Z)|\Z", re.I) for t in _RAW}
#: These count only up to an end tag of their own: one that is not closed before the next of its kind holds nothing.
_NEXT = {t: re.compile(rf"<(/?){t}(?=[\s/>])", re.I) for t in (*_FALLBACK, "math", "object")}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_BLOCK = {
    "html", "head", "body", "address", "article", "aside", "blockquote", "button", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form",
    "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "search", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul", "object", *_FALLBACK, *_RAW,
}
#: An opening tag also closes the nearest of these that is open, unless one of the second set is nearer.
_CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
}
_ENDS_P = _BLOCK - {"td", "th", "tr", "tbody", "thead", "tfoot", "caption", "button", "html", "head", "body", "object", *_FALLBACK, *_RAW}
#: Words in class, id, role and similar attributes that hint at what an element is for.
_HINTS = {
    "h:main": "article content entry main post story body text blog page".split(),
    "h:nav": "nav navbar navigation menu breadcrumb breadcrumbs toc pagination pager tabs skip".split(),
    "h:head": "header masthead banner top topbar logo brand".split(),
    "h:foot": "footer bottom copyright colophon legal".split(),
    "h:side": "sidebar side aside related widget recommended recommend more popular trending rail teaser tags".split(),
    "h:ad": "ad ads advert advertisement adverts advertising sponsor sponsored promo promotion banner-ad dfp taboola outbrain".split(),
    "h:comment": "comment comments reply replies respond disqus discussion reviews".split(),
    "h:notice": "cookie cookies consent notice alert popup modal overlay gdpr newsletter subscribe subscription signup paywall announcement privacy".split(),
    "h:form": "form search login contact searchbox".split(),
    "h:share": "share sharing social follow".split(),
    "h:meta": "byline author meta date dateline timestamp published".split(),
}
_HINT = {w: h for h, words in _HINTS.items() for w in words}
_ATTRIBUTE = re.compile(r"""(class|id|role|aria-label|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_NAMES = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.I)
#: Ancestors that are features; of all other tags only the innermost block tag is one.
_TOLD = {"nav", "header", "footer", "aside", "article", "main", "form", "table", "ul", "ol", "figure", "button", "section", "blockquote", "menu", "dialog", "details", "search"}


@dataclass(frozen=True)
class Block:
    text: str
    around: frozenset
    tag: str
    linked: float


_OWN: dict[tuple[str, str], frozenset] = {}


def _own_features(tag: str, attributes: str) -> frozenset:
    """Features of an element by its tag and attributes."""
    key = (tag, attributes)
    if (found := _OWN.get(key)) is None:
        names = {f"in:{tag}"} if tag in _TOLD else {"in:fallback"} if tag in _FALLBACK else set()
        if attributes:
            for m in _ATTRIBUTE.finditer(attributes):
                value = m[2] or m[3] or m[4] or ""
                words = {w.lower() for w in _NAMES.findall(value)}
                names |= {_HINT[w] for w in words if w in _HINT}
            if _HIDDEN.search(attributes):
                names.add("h:hidden")
        found = frozenset(names)
        if len(_OWN) < 20_000:
            _OWN[key] = found
    return found


def blocks(html: str) -> list[Block]:
    """Leaf blocks of a page in order: white space made one space, character references decoded.

    Linear in the page's length: once a tag's quotes do not close, quotes of later tags are not looked at, and
    inline elements that change no feature are not kept track of.
    """
    out: list[Block] = []
    stack: list[tuple[str, frozenset, bool]] = [("", frozenset(), False)]  # tag, features so far, block-level
    held: Counter[str] = Counter()  # open elements by tag
    text: list[str] = []
    linked = 0

    def say(part: str) -> None:
        nonlocal linked
        text.append(unescape(part))  # a reference does not reach over a tag
        if held["a"]:
            linked += len(part)

    def flush() -> None:
        nonlocal linked
        if text:
            whole = " ".join("".join(text).split())
            if whole:
                tag = next((t for t, _, b in reversed(stack) if b), "")
                out.append(Block(whole, stack[-1][1], tag, min(1.0, linked / len(whole))))
            text.clear()
        linked = 0

    def close(tags: set[str], stop: set[str]) -> None:
        if not any(held[t] for t in tags):
            return
        for at in range(len(stack) - 1, 0, -1):
            if stack[at][0] in tags:
                held.subtract(t for t, _, _ in stack[at:])
                del stack[at:]
                return
            if stack[at][0] in stop:
                return

    at, end = 0, len(html)
    for_tag = _TOKEN.search
    while at < end:
        m = for_tag(html, at)
        if m is None:
            say(html[at:])
            break
        if m.start() > at:
            say(html[at : m.start()])
        at = m.end()
        name = m[2] or m[5]
        if not name:
            continue
        if m[5]:
            for_tag = _UNQUOTED.search
        tag, ending, attributes = name.lower(), m[1] or m[4], (m[3] or m[6] or "").strip(" /\n\t")
        if ending:
            if tag == "br":
                text.append(" ")
            elif tag in _BLOCK:
                flush()
                close({tag}, {"table"} if tag in ("p", "li") else set())
            else:
                close({tag}, _BLOCK)
            continue
        closed = (m[3] or m[6] or "").rstrip().endswith("/")
        foreign = (closed or tag in _RAW) and (tag in ("svg", "math") or held["svg"] > 0 or held["math"] > 0)
        if closed and foreign:
            if tag in _BLOCK:
                flush()
            continue
        if tag in _RAW and (not foreign or tag in ("script", "style")):
            flush()
            stop = _RAW_END[tag].search(html, at)
            if tag == "xmp":
                text.append(html[at : stop.start()])
                flush()
            at = stop.end()
            continue
        if tag == "br":
            text.append(" ")
            continue
        block = tag in _BLOCK
        if block:
            flush()
            if tag in _ENDS_P:
                close({"p", "h1", "h2", "h3", "h4", "h5", "h6"} if tag[0] == "h" and tag[1:].isdigit() else {"p"}, _BLOCK - {"p", "h1", "h2", "h3", "h4", "h5", "h6"})
            if tag in _CLOSES:
                close(*_CLOSES[tag])
        if tag not in _VOID and not (tag in _NEXT and ((after := _NEXT[tag].search(html, at)) is None or not after[1])):
            own = _own_features(tag, attributes)
            if block or own or tag == "a" or tag in _NEXT:
                stack.append((tag, stack[-1][1] | own if own else stack[-1][1], block))
                held[tag] += 1
    flush()
    return out


def features(page: list[Block]) -> list[list[str]]:
    """Names of each block's features."""
    out = []
    for b in page:
        words = b.text.count(" ") + 1
        size = "1" if words == 1 else "2-4" if words < 5 else "5-11" if words < 12 else "12-29" if words < 30 else "30+"
        link = "none" if not b.linked else "some" if b.linked < 0.5 else "most"
        own = [*b.around, f"tag:{b.tag}", f"size:{size}", f"link:{link}", f"size:{size},link:{link}", "all"]
        if not any(x in b.around for x in ("in:article", "in:main", "h:main")):
            own.append("outside")
        if b.text[-1] in ".!?:;\"”»…":
            own.append("stop")
        if "©" in b.text:
            own.append("copyright")
        out.append(own)
    return out


# ---- the chain


@dataclass
class Chain:
    """Weights for main text against the rest: of features, of transitions (from, to), of a first and a last block."""

    weights: dict[str, float]
    moves: np.ndarray
    first: float
    last: float

    def __post_init__(self):
        self.sums: dict[tuple, float] = {}

    def decode(self, page: list[Block]) -> list[bool]:
        """The likeliest labels, by Viterbi's algorithm."""
        if not page:
            return []
        weights, sums = self.weights, self.sums
        (oo, om), (mo, mm) = self.moves.tolist()
        back: list[tuple[bool, bool]] = []
        other = main = 0.0
        for i, own in enumerate(features(page)):
            key = tuple(own)
            if (e := sums.get(key)) is None:
                e = sum(weights.get(f, 0.0) for f in own)
                if len(sums) < 50_000:
                    sums[key] = e
            if not i:
                main = e + self.first
                continue
            stay, leave, enter, remain = other + oo, main + mo, other + om, main + mm
            back.append((leave > stay, remain >= enter))
            other, main = max(stay, leave), max(enter, remain) + e
        label = main + self.last > other
        out = [label]
        for o, m in reversed(back):
            label = m if label else o
            out.append(label)
        return out[::-1]


def fit(pages: list[tuple[list[Block], list[bool]]], steps: int = STEPS, rate: float = 0.1, decay: float = 1e-5) -> Chain:
    """Maximum likelihood with a quadratic penalty; pages are padded to one length, so each step is a few array operations."""
    pages = [p for p in pages if p[0]]
    named = [features(p) for p, _ in pages]
    names = sorted({f for page in named for own in page for f in own})
    number = {f: i for i, f in enumerate(names)}
    n, longest = len(pages), max(len(p) for p, _ in pages)
    rows = np.array([i * longest + t for i, page in enumerate(named) for t, own in enumerate(page) for _ in own])
    cols = np.array([number[f] for page in named for own in page for f in own])
    real, truth = np.zeros((n, longest), bool), np.zeros((n, longest))
    for i, (page, labels) in enumerate(pages):
        real[i, : len(page)] = True
        truth[i, : len(page)] = labels
    ends = real.sum(1) - 1
    each = np.arange(n)
    theta = np.zeros(len(names) + 6)  # features, 4 transitions, first, last
    a, b = np.zeros_like(theta), np.zeros_like(theta)
    both = real[:, 1:] & real[:, :-1]
    pairs = (2 * truth[:, :-1] + truth[:, 1:]).astype(int)
    seen = np.concatenate([np.bincount(cols, weights=truth.ravel()[rows], minlength=len(names)), np.bincount(pairs[both], minlength=4), [truth[:, 0].sum(), truth[each, ends].sum()]])
    for step in range(1, steps + 1):
        w, moves = theta[: len(names)], theta[len(names) : -2].reshape(2, 2)
        e = np.zeros((n, longest, 2))
        e[:, :, 1] = np.bincount(rows, weights=w[cols], minlength=n * longest).reshape(n, longest)
        e[:, 0, 1] += theta[-2]
        e[each, ends, 1] += theta[-1]
        ahead, behind = np.zeros_like(e), np.zeros_like(e)
        ahead[:, 0] = e[:, 0]
        for t in range(1, longest):
            ahead[:, t] = np.where(real[:, t, None], np.logaddexp(ahead[:, t - 1, :1] + moves[0], ahead[:, t - 1, 1:] + moves[1]) + e[:, t], ahead[:, t - 1])
        for t in range(longest - 2, -1, -1):
            x = e[:, t + 1] + behind[:, t + 1]
            behind[:, t] = np.where(real[:, t + 1, None], np.logaddexp(moves[:, 0] + x[:, :1], moves[:, 1] + x[:, 1:]), 0)
        whole = np.logaddexp(ahead[:, -1, 0], ahead[:, -1, 1])
        main = np.exp(ahead[:, :, 1] + behind[:, :, 1] - whole[:, None]) * real
        x = e[:, 1:] + behind[:, 1:]
        two = np.exp(ahead[:, :-1, :, None] + moves + x[:, :, None, :] - whole[:, None, None, None]) * both[:, :, None, None]
        expected = np.concatenate([np.bincount(cols, weights=main.ravel()[rows], minlength=len(names)), two.sum((0, 1)).ravel(), [main[:, 0].sum(), main[each, ends].sum()]])
        g = (expected - seen) / n + decay * theta
        a, b = 0.9 * a + 0.1 * g, 0.99 * b + 0.01 * g * g
        theta -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)
    return Chain(dict(zip(names, theta[: len(names)].tolist(), strict=True)), theta[len(names) : -2].reshape(2, 2), float(theta[-2]), float(theta[-1]))


# ---- labelled pages

_MARK = "\ue000"
_SYLLABLES = "an be co de en fi ga ho in jo ka li mo na or pe ri so ta un ve wa".split()


class _Maker:
    """Builds one page: blocks of main text begin with a mark that labels them."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def one(self, *choices):
        return choices[int(self.r.random() * len(choices))]

    def number(self, low: int, high: int) -> int:
        return low + int(self.r.random() * (high - low + 1))

    def chance(self, p: float) -> bool:
        return self.r.random() < p

    def words(self, low: int, high: int) -> str:
        n = self.number(low, high)
        w = ["".join(self.one(*_SYLLABLES) for _ in range(self.number(1, 3))) for _ in range(n)]
        return " ".join(w).capitalize() + self.one(".", ".", "", "!", "?")

    def attr(self, *names: str) -> str:
        if self.chance(0.25):
            return ""
        name = self.one(*names)
        if self.chance(0.3):
            name += self.one("-inner", "-wrap", " clearfix", "_1", " box", "-block")
        return f' {self.one("class", "class", "id")}="{name}"'

    def links(self, n: int) -> str:
        return "".join(f'<li><a href="/{i}">{self.words(1, 3)}</a></li>' for i in range(n))

    def nav(self) -> str:
        inner = f"<ul>{self.links(self.number(3, 8))}</ul>"
        return self.one(f"<nav{self.attr('nav', 'main-nav', 'x')}>{inner}</nav>", f'<div class="{self.one("menu", "navbar", "nav", "breadcrumbs", "navigation")}">{inner}</div>', f'<div role="navigation">{inner}</div>')

    def header(self) -> str:
        inner = f"<{(h := self.one('h1', 'div', 'p', 'span'))}>{self.words(1, 6)}</{h}>" + (f"<p>{self.words(3, 12)}</p>" if self.chance(0.4) else "")
        return self.one(f"<header>{inner}</header>", f"<header>{inner}</header>", f'<div class="{self.one("header", "masthead", "site-header", "topbar", "banner")}">{inner}</div>')

    def footer(self) -> str:
        inner = f"{self.one('&copy; ', '', '© 2020 ')}{self.words(2, 25)}" + (f"<ul>{self.links(3)}</ul>" if self.chance(0.3) else "") + (f"<p>{self.words(3, 20)}</p>" if self.chance(0.3) else "")
        return self.one(f"<footer{self.attr('site-footer', 'x')}>{inner}</footer>", f'<div class="{self.one("footer", "site-footer", "copyright", "legal", "bottom")}">{inner}</div>', f'<div id="footer">{inner}</div>')

    def ad(self) -> str:
        inner = self.words(2, 40)
        inner = self.one(inner, f"<p>{inner}</p>", f'<a href="/buy">{inner}</a>', f"<h3>{self.words(1, 4)}</h3><p>{inner}</p>")
        return f'<{(t := self.one("div", "div", "aside", "section"))} {self.one("class", "id")}="{self.one("ad", "ads", "advert", "ad-slot", "sponsored", "promo", "advertisement", "banner-ad")}">{inner}</{t}>'

    def side(self) -> str:
        inner = f"<h{(h := self.one(2, 3, 4))}>{self.words(1, 4)}</h{h}>" + self.one(f"<ul>{self.links(4)}</ul>", f"<p>{self.words(4, 40)}</p>", f"<p>{self.words(4, 20)}</p><p>{self.words(4, 20)}</p>")
        return self.one(f"<aside{self.attr('sidebar', 'related', 'x')}>{inner}</aside>", f"<aside>{inner}</aside>", f'<div class="{self.one("sidebar", "related", "widget", "side", "recommended", "popular", "tags")}">{inner}</div>')

    def notice(self) -> str:
        inner = self.one(self.words(4, 40), f"<p>{self.words(4, 40)}</p><button>{self.words(1, 2)}</button>")
        return f'<{(t := self.one("div", "section", "aside", "dialog"))} {self.one("class", "id", "class")}="{self.one("cookie", "cookie-notice", "notice", "consent", "popup", "modal", "alert", "newsletter", "subscribe", "gdpr", "announcement", "paywall")}">{inner}</{t}>'

    def form(self) -> str:
        return f"<form{self.attr('search', 'login', 'contact', 'x')}>{self.one('<label>' + self.words(1, 5) + '</label>', '<p>' + self.words(2, 20) + '</p>', self.words(1, 5))}<input type=text><button>{self.words(1, 2)}</button></form>"

    def share(self) -> str:
        return f'<div class="{self.one("share", "social", "share-links", "follow")}"><ul>{self.links(3)}</ul></div>'

    def comments(self) -> str:
        rows = ""
        for _ in range(self.number(1, 5)):
            inner = self.one(f"<p>{self.words(2, 50)}</p>", f"<b>{self.words(1, 2)}</b><p>{self.words(2, 50)}</p><p>{self.words(2, 30)}</p>", self.words(2, 40))
            rows += self.one(f'<div class="comment">{inner}</div>', f"<li>{inner}</li>", f'<article class="comment">{inner}</article>')
        title = f"<h3>{self.words(1, 3)}</h3>" if self.chance(0.6) else ""
        return f'<{(t := self.one("div", "section", "ol", "div"))} {self.one("class", "id")}="{self.one("comments", "comment-list", "replies", "disqus", "discussion", "respond")}">{title}{rows}</{t}>'

    def main_block(self) -> str:
        say = lambda low, high: _MARK + self.words(low, high)
        k = self.r.random()
        if k < 0.62:
            inner = self.one(say(1, 3), say(4, 15), say(20, 80), say(20, 120), say(10, 40))
            if self.chance(0.15):
                inner += f' <a href="/x">{self.words(1, 4)}</a> {self.words(2, 9)}'
            return self.one(f"<p>{inner}</p>", f"<p>{inner}</p>", f"<p>{inner}", f"<p><b>{inner}<br>", f"<div>{inner}</div>")
        if k < 0.74:
            return f"<h{(h := self.one(2, 3, 4))}>{say(1, 8)}</h{h}>"
        if k < 0.84:
            return f"<{(t := self.one('ul', 'ol'))}>" + "".join(f"<li>{say(1, 15)}</li>" for _ in range(self.number(2, 5))) + f"</{t}>"
        if k < 0.90:
            return f"<blockquote>{self.one(f'<p>{say(5, 40)}</p>', say(5, 40))}</blockquote>"
        if k < 0.95:
            return "<table>" + "".join(f"<tr><td>{say(1, 4)}</td><td>{say(1, 4)}</td></tr>" for _ in range(3)) + "</table>"
        return f"<{(t := self.one('pre', 'figure', 'dl'))}>{say(2, 12) if t == 'pre' else f'<figcaption>{say(2, 12)}</figcaption>' if t == 'figure' else f'<dt>{say(1, 3)}</dt><dd>{say(3, 20)}</dd>'}</{t}>"

    def article(self) -> str:
        body = [self.main_block() for _ in range(self.number(1, 15))]
        for make in (self.ad, self.side, self.notice, self.form, self.share):
            if self.chance(0.12):
                body.insert(self.number(0, len(body)), make())
        head = f"<h1>{_MARK}{self.words(1, 12)}</h1>" if self.chance(0.8) else ""
        if head and self.chance(0.2):
            head = f"<header>{head}</header>"
        inner = head + "".join(body) + (self.comments() if self.chance(0.1) else "")
        return self.one(
            f"<article{self.attr('post', 'article', 'x')}>{inner}</article>", f"<article>{inner}</article>", f"<main>{inner}</main>", f"<main><article>{inner}</article></main>",
            f'<div class="{self.one("content", "post", "entry-content", "article-body", "story", "main-content", "post-body")}">{inner}</div>', f'<div id="{self.one("content", "main", "article")}">{inner}</div>',
            f'<section role="main">{inner}</section>', f'<div class="x1"><div class="{self.one("c2", "wrapper", "text")}">{inner}</div></div>',
        )

    def page(self) -> str:
        if self.chance(0.12):  # an article and nothing else
            return f"<html><body>{self.one(self.article, lambda: f'<{(t := self.one("article", "main"))}>{self.main_block()}</{t}>')()}</body></html>"
        above = [m() for m, p in ((self.header, 0.5), (self.nav, 0.8), (self.notice, 0.3), (self.ad, 0.5), (self.form, 0.2), (self.side, 0.15)) if self.chance(p)]
        below = [m() for m, p in ((self.share, 0.2), (self.ad, 0.3), (self.comments, 0.45), (self.side, 0.4), (self.form, 0.2), (self.notice, 0.2), (self.nav, 0.15)) if self.chance(p)]
        above, below = [self.r.sample(x, len(x)) for x in (above, below)]
        main = self.article() if self.chance(0.97) else ""
        return f"<html><head><title>{self.words(1, 5)}</title></head><body>{''.join(above)}{main}{''.join(below)}{self.footer() if self.chance(0.85) else ''}</body></html>"

    def bare_page(self) -> str:
        """A page without names or roles, in half of the cases without elements that tell what they are for."""
        plain = self.chance(0.5)
        above = [m() for m, p in ((self.header, 0.5), (self.nav, 0.9), (self.form, 0.3)) if self.chance(p)]
        below = [m() for m, p in ((self.share, 0.4), (lambda: f"<div><h3>{self.words(1, 4)}</h3><ul>{self.links(self.number(3, 8))}</ul></div>", 0.5), (self.form, 0.2)) if self.chance(p)]
        body = "".join(self.main_block() for _ in range(self.number(3, 15)))
        head = f"<h1>{_MARK}{self.words(2, 12)}</h1>" if self.chance(0.8) else ""
        whole = f"{''.join(above)}<article>{head}{body}</article>{''.join(below)}{self.footer() if self.chance(0.85) else ''}"
        whole = re.sub(r' (?:class|id|role)="[^"]*"', "", whole)
        if plain:
            whole = re.sub(r"<(/?)(?:nav|header|footer|aside|main|article|section|dialog)\b[^>]*>", r"<\1div>", whole)
        return f"<html><head><title>{self.words(1, 5)}</title></head><body>{whole}</body></html>"

    def with_fallback(self, page: str) -> str:
        """The page, in some cases with an element of text that is not shown."""
        if not self.chance(0.25):
            return page
        tag = self.one(*sorted(_FALLBACK))
        inner = self.words(1, 20)
        inner = {"select": f"<option>{inner}</option>", "svg": self.one(f"<title>{inner}</title><path d='M0' />", f"<text>{inner}</text>")}.get(tag) or self.one(inner, f"<p>{inner}</p>")
        at = self.one(*[m.start() for m in re.finditer(r"<(?:p|h[1-6]|ul|div|main|article)[ >]", page)], page.index("</body>"))
        return f"{page[:at]}<{tag}>{inner}</{tag}>{page[at:]}"


def _labelled(page: str) -> tuple[list[Block], list[bool]]:
    found = blocks(page)
    return [Block(b.text.replace(_MARK, ""), b.around, b.tag, b.linked) for b in found], [_MARK in b.text for b in found]


def bare_pages(n: int, seed: int = 1) -> list[tuple[list[Block], list[bool]]]:
    """As labelled_pages(), of layouts that give no hints by names."""
    maker = _Maker(7_000_000 + seed)
    return [_labelled(maker.bare_page()) for _ in range(n)]


def labelled_pages(n: int = PAGES, seed: int = 1) -> list[tuple[list[Block], list[bool]]]:
    """Blocks of made-up pages with their labels, the same for the same seed."""
    maker, other = _Maker(seed), _Maker(-1 - seed)
    return [_labelled(other.with_fallback(maker.page())) for _ in range(n)]


def training_pages(n: int = PAGES) -> list[tuple[list[Block], list[bool]]]:
    """What a fit learns from unless told otherwise."""
    return labelled_pages(n) + bare_pages(n // BARE)


# ---- on a cluster


def main_text(html: str | None, chain: Chain) -> str:
    page = blocks(html or "")
    return "\n".join(b.text for b, main in zip(page, chain.decode(page), strict=True) if main)


def extract(pages: DataFrame, chain: Chain | None = None, keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """Columns ``keep`` of ``pages``, text (main text of the whole html, blocks joined by a line end) and n_chars.

    A null or empty html has an empty text. Nothing of a page is cut off; a page that breaks off amid a tag
    loses only that tag. Rows are independent of each other: nothing is shuffled.
    """
    shared = pages.sparkSession.sparkContext.broadcast(chain or fit(training_pages()))  # a few hundred weights
    names = [c for c in keep if c not in ("text", "n_chars")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "html"):
            found = [main_text(h, shared.value) for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(found, pa.string()), pa.array([len(x) for x in found], pa.int64())], [*names, "text", "n_chars"])

    shape = T.StructType([pages.schema[c] for c in names] + [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    return pages.select(*dict.fromkeys([*names, "html"])).mapInArrow(run, shape)


def op5_html(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).select("page_id", "url", F.coalesce("text", F.lit("")).alias("text"), "n_chars")
