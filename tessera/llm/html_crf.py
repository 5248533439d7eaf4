"""Main text of web pages by a linear-chain conditional random field over DOM leaf blocks.

A page is read into leaf blocks: runs of text that no block element interrupts, each with its chain
of ancestor elements. A button, and an inline element named like an advert or a notice, is a leaf of its own
inside a run, joined without a blank where the page has none. Features of a block are its ancestors' tags, groups of cue words in their
classes, ids and roles, whether it lies outside a main element that the page has, its place in the
page, and properties of its text (length, share of linked text, punctuation). The field labels each
block as main text or not; its weights for features and for neighbouring labels are trained by
maximum likelihood (forward-backward, L2 penalty) on labelled pages and the best labelling is
decoded by Viterbi.

The labelled pages are made here from a grammar of page layouts with a fixed seed; the weights that
fit() finds on them are kept in a file beside this module, which ``python -m tessera.llm.html_crf``
writes anew. fit() takes any other labelled pages as well.
"""

from __future__ import annotations

import html
import json
import re
from collections import Counter
from collections.abc import Iterator
from functools import cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import ship

#: Element names by how they are treated.
MATHS = "math maction menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover semantics"
INLINE = frozenset(f"a abbr acronym b bdi bdo big button cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr {MATHS}".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = frozenset("script style noscript template head title svg annotation annotation-xml iframe object select textarea canvas audio video".split())
#: Those that stand in a run of text and don't end it: pictures, and what formulas carry beside what is shown.
IN_TEXT = frozenset("svg annotation annotation-xml select canvas audio video".split())
CLOSED_BY = {"p": None, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}}
#: Cue words in classes, ids and roles, by group.
CUES = {
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs topbar tabs toc pagination pager skip",
    "head": "header masthead branding logo hero site-title tagline",
    "foot": "footer foot copyright legal colophon imprint contentinfo",
    "side": "sidebar aside side widget related recommend recommended popular trending complementary rail teaser",
    "ad": "ad ads adv advert advertisement advertising sponsor sponsored promo promotion banner",
    "notice": "cookie cookies consent notice alert gdpr popup modal overlay subscribe newsletter signup paywall dialog disclaimer",
    "comment": "comment comments reply replies respond disqus discussion thread feedback",
    "form": "form search login register contact",
    "share": "share sharing social follow like tags meta byline author",
    "main": "article content post entry story main body text page copy",
}
_CUE = {w: g for g, ws in CUES.items() for w in ws.split()}
_QUOTE = re.compile("[>\"']")
_NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
_ATTR = re.compile(r"\b(class|id|role|data-y)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
_WORDS = re.compile(r"[A-Za-z][a-z]*|[A-Z]+")
#: Elements that features name; all others count as one, so that an element has a bounded number of features.
NAMED = frozenset("html body main article section header footer nav aside div p ul ol li dl dt dd table thead tbody tfoot tr td th form fieldset figure figcaption blockquote pre h1 h2 h3 h4 h5 h6 address details summary center legend button".split())
#: Cue groups that make an inline element a leaf of its own.
APART = frozenset({"ad", "notice"})
PENALTY, STEPS, RATE = 0.02, 150, 0.2
WEIGHTS = Path(__file__).with_name("html_crf_weights.json")


def _attributes(raw: str) -> tuple[frozenset, str | None]:
    """(cue groups, label) of a start tag."""
    groups, label = set(), None
    if "=" in raw:
        for name, value in _ATTR.findall(raw):
            value = value.strip("\"'")
            if name.lower() == "data-y":
                label = value
            else:
                groups.update(_CUE[w] for w in map(str.lower, _WORDS.findall(value)) if w in _CUE)
    return frozenset(groups), label


class Element:
    """An open element: what its ancestors say is held in a set that it shares with its parent unless it adds to it."""

    __slots__ = ("tag", "label", "depth", "inside", "main", "own")

    def __init__(self, tag: str, groups: frozenset, label: str | None, parent: Element | None):
        self.tag = tag
        self.label = label if label is not None or parent is None else parent.label
        self.depth = parent.depth + 1 if parent else 1
        self.main = bool(parent and parent.main) or tag in ("article", "main") or "main" in groups and tag not in ("html", "body")
        shown = tag if tag in NAMED else "inline" if tag in INLINE else "other"
        adds = {f"in={shown}", *(f"cue={g}" for g in groups)}
        before = parent.inside if parent else frozenset()
        self.inside: frozenset = before if adds <= before else before | adds
        self.own = (f"tag={shown}", *sorted(f"own={g}" for g in groups))

    def features(self) -> list[str]:
        return [*self.own, *self.inside, f"deep={min(self.depth, 8)}"]


class Block:
    """A leaf block: its text, its element, characters inside links, and whether it goes on where the one before ended, without white space."""

    __slots__ = ("text", "element", "linked", "glued")

    def __init__(self, text: str, element: Element | None, linked: int, glued: bool = False):
        self.text, self.element, self.linked, self.glued = text, element, linked, glued

    @property
    def label(self) -> str | None:
        """The label of a training page."""
        return self.element.label if self.element else None


class Tags:
    """The tags of a page in order: (start, end, closing, name, attributes); name is empty for comments and the like.

    Every character is looked at a bounded number of times. A quote hides ``>``; once a quote is
    found to run to the end of the page, quotes hide nothing in the rest of it.
    """

    def __init__(self, page: str):
        self.page, self.quotes, self.closers = page, True, {}

    def next(self, at: int) -> tuple[int, int, bool, str, str] | None:
        page = self.page
        while True:
            at = page.find("<", at)
            if at < 0:
                return None
            if page.startswith("<!--", at):
                end = page.find("-->", at + 4)
                return at, (end + 3 if end >= 0 else len(page)), False, "", ""
            if page[at + 1 : at + 2] in ("!", "?") and at + 1 < len(page):
                end = page.find(">", at)
                return None if end < 0 else (at, end + 1, False, "", "")
            m = _NAME.match(page, at + 1)
            if m is None:
                at += 1
                continue
            end = self._end(m.end())
            if end < 0:
                return None
            return at, end + 1, bool(m[1]), m[2].lower(), page[m.end() : end]

    def _end(self, at: int) -> int:
        """The place of the ``>`` that ends a tag; -1 if there is none."""
        page, k = self.page, at
        while self.quotes:
            m = _QUOTE.search(page, k)
            if m is None:
                self.quotes = False
            elif m[0] == ">":
                return m.start()
            else:
                k = page.find(m[0], m.end()) + 1
                if not k:
                    self.quotes = False
        return page.find(">", at)

    def closing(self, name: str, at: int) -> int:
        """The place of the next ``</name``; -1 if there is none."""
        seen = self.closers.get(name)
        if seen is None or 0 <= seen < at:
            m = _closing(name).search(self.page, at)
            seen = self.closers[name] = m.start() if m else -1
        return seen


def blocks(page: str) -> list[Block]:
    """The leaf blocks of a page, in order; markup errors are read as browsers roughly do. Time is linear in the page."""
    out: list[Block] = []
    stack: list[Element] = []
    open_now: Counter[str] = Counter()
    parts: list[str] = []
    linked = in_link = 0
    glue = False
    #: Inline elements on the stack: [name, height, open elements of that name inside].
    apart: list[list] = []

    def close(inside_run: bool = False) -> None:
        nonlocal linked, glue
        raw = "".join(parts)
        parts.clear()
        text = " ".join(raw.split())
        if text:
            out.append(Block(text, stack[-1] if stack else None, linked, glue and not raw[0].isspace()))
            glue = inside_run and not raw[-1].isspace()
        else:
            glue = glue and inside_run and not raw
        linked = 0

    def say(raw: str) -> None:
        nonlocal linked
        if "&" in raw:
            raw = html.unescape(raw)
        if in_link:
            linked += len(raw.strip())
        parts.append(raw)

    def pop() -> str:
        gone = stack.pop().tag
        open_now[gone] -= 1
        while apart and apart[-1][1] > len(stack):
            apart.pop()
        return gone

    def push(name: str, groups: frozenset, label: str | None) -> None:
        stack.append(Element(name, groups, label, stack[-1] if stack else None))
        open_now[name] += 1

    at, tags = 0, Tags(page)
    while True:
        tag = tags.next(at)
        if tag is None:
            say(page[at:])
            break
        start, end, closes, name, raw = tag
        if start > at:
            say(page[at:start])
        at = end
        if not name:
            continue
        if closes:
            if name in INLINE:
                in_link = max(0, in_link - (name == "a"))
                if apart and apart[-1][0] == name:
                    apart[-1][2] -= 1
                    if not apart[-1][2]:
                        close(inside_run=True)
                        height = apart[-1][1]
                        while len(stack) >= height:
                            pop()
            elif open_now[name]:
                close()
                while pop() != name:
                    pass
                in_link = 0
            continue
        if name in SKIPPED and not raw.endswith("/"):
            shut = tags.closing(name, at)
            if shut < 0 and name == "head":
                continue
            # Only raw text runs to the end of a page that does not close it.
            stop = page.find(">", shut) + 1 if shut >= 0 else 0
            at = stop or (len(page) if name in ("script", "style", "textarea") else at)
            if name not in IN_TEXT:
                close()
            continue
        if name in INLINE:
            in_link += name == "a"
            if raw.endswith("/"):
                continue
            groups, label = _attributes(raw)
            if name == "button" or groups & APART:
                close(inside_run=True)
                push(name, groups, label)
                apart.append([name, len(stack), 1])
            elif apart and apart[-1][0] == name:
                apart[-1][2] += 1
            continue
        if name == "br":
            parts.append(" ")
            continue
        if name in VOID:
            if name == "hr":
                close()
            continue
        close()
        in_link = 0
        if apart and apart[-1][1] == len(stack) > 1 and stack[-2].tag == "p":
            pop()
        while stack and stack[-1].tag in CLOSED_BY and (CLOSED_BY[stack[-1].tag] is None or name in CLOSED_BY[stack[-1].tag]):
            pop()
        push(name, *_attributes(raw))
    close()
    return out


@cache
def _closing(name: str) -> re.Pattern:
    return re.compile("</" + re.escape(name) + r"(?=[\s/>])", re.I)


def features(page: list[Block]) -> list[list[str]]:
    """Feature names of each block."""
    some = any(b.element and b.element.main for b in page)
    out = []
    for k, b in enumerate(page):
        n = len(b.text.split())
        share = b.linked / len(b.text)
        marks = sum(b.text.count(c) for c in ".,;:!?")
        f = b.element.features() if b.element else ["tag=none"]
        f.append(f"words={0 if n < 3 else 3 if n < 6 else 6 if n < 12 else 12 if n < 30 else 30 if n < 80 else 80}")
        f.append(f"linked={0 if not share else 1 if share < 0.3 else 2 if share < 0.7 else 3}")
        f.append(f"marks={0 if not marks else 1 if marks < n / 20 else 2}")
        f.append("stop" if b.text[-1] in ".!?\"'»)…" else "open")
        if "©" in b.text or "copyright" in b.text.lower():
            f.append("rights")
        if some:
            f.append("inside" if b.element and b.element.main else "outside")
        if len(page) > 1:
            if k == 0:
                f.append("first")
            if k == len(page) - 1:
                f.append("last")
        out.append(f)
    return out


class Field:
    """Weights of a trained field over labels 0 (other) and 1 (main text)."""

    def __init__(self, names: list[str], emit: np.ndarray, step: np.ndarray, start: np.ndarray):
        self.index = {x: i for i, x in enumerate(names)}
        self.emit, self.step, self.start = emit, step, start
        self.gap = emit[:, 1] - emit[:, 0]

    def label(self, page: list[Block]) -> list[int]:
        """The best labels by Viterbi; only differences of scores matter."""
        if not page:
            return []
        get, gap = self.index.get, self.gap
        (s00, s01), (s10, s11) = self.step.tolist()
        back: list[tuple[int, int]] = []
        a = b = 0.0
        for k, fs in enumerate(features(page)):
            e = float(sum(gap[i] for i in map(get, fs) if i is not None))
            if k == 0:
                a, b = float(self.start[0]), float(self.start[1]) + e
                continue
            from0 = 0 if a + s00 >= b + s10 else 1
            from1 = 0 if a + s01 > b + s11 else 1
            a, b = (a + s00 if from0 == 0 else b + s10), (a + s01 if from1 == 0 else b + s11) + e
            back.append((from0, from1))
        y = [1 if b > a else 0]
        for pair in reversed(back):
            y.append(pair[y[-1]])
        return y[::-1]

    def text(self, page: str) -> str:
        found = blocks(page)
        said, tight = [], True
        for b, y in zip(found, self.label(found)):
            tight = tight and b.glued
            if y:
                said.append(b.text if not said or tight else " " + b.text)
                tight = True
        return "".join(said)


def fit(pages: list[tuple[list[Block], list[int]]], steps: int = STEPS) -> Field:
    """Train on labelled pages by full-batch Adam on the penalised log likelihood."""
    names = sorted({f for p, _ in pages for fs in features(p) for f in fs})
    index = {x: i for i, x in enumerate(names)}
    n, longest = len(pages), max(len(p) for p, _ in pages)
    y, mask = np.zeros((n, longest), np.int64), np.zeros((n, longest), bool)
    rows = [fs for p, _ in pages for fs in features(p)]
    flat = np.zeros((len(rows), len(names)), np.float32)
    for k, fs in enumerate(rows):
        flat[k, [index[f] for f in fs]] = 1
    for k, (p, labels) in enumerate(pages):
        y[k, : len(p)], mask[k, : len(p)] = labels, True
    e = np.zeros((n, longest, 2))
    gold = np.eye(2)[y] * mask[:, :, None]
    pair_gold = np.einsum("ktu,ktv->uv", gold[:, :-1], gold[:, 1:])
    w = [np.zeros((len(names), 2)), np.zeros((2, 2)), np.zeros(2)]
    first, second = [np.zeros_like(v) for v in w], [np.zeros_like(v) for v in w]
    for it in range(1, steps + 1):
        e[mask] = flat @ w[0].astype(np.float32)
        alpha, beta = np.zeros((n, longest, 2)), np.zeros((n, longest, 2))
        alpha[:, 0] = e[:, 0] + w[2]
        for t in range(1, longest):
            nxt = np.logaddexp.reduce(alpha[:, t - 1, :, None] + w[1], axis=1) + e[:, t]
            alpha[:, t] = np.where(mask[:, t, None], nxt, alpha[:, t - 1])
        for t in range(longest - 2, -1, -1):
            prev = np.logaddexp.reduce(w[1] + (e[:, t + 1] + beta[:, t + 1])[:, None, :], axis=2)
            beta[:, t] = np.where(mask[:, t + 1, None], prev, 0)
        z = np.logaddexp.reduce(alpha[:, -1], axis=1)
        prob = np.exp(alpha + beta - z[:, None, None]) * mask[:, :, None]
        pair = np.exp(alpha[:, :-1, :, None] + w[1] + (e[:, 1:] + beta[:, 1:])[:, :, None, :] - z[:, None, None, None]) * mask[:, 1:, None, None]
        grads = [
            flat.T @ (gold - prob)[mask].astype(np.float32) / n - PENALTY * w[0] / 10,
            (pair_gold - pair.sum(axis=(0, 1))) / n - PENALTY * w[1],
            (gold[:, 0] - prob[:, 0]).sum(axis=0) / n - PENALTY * w[2],
        ]
        for v, g, a, b in zip(w, grads, first, second):
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            v += RATE * (a / (1 - 0.9**it)) / (np.sqrt(b / (1 - 0.99**it)) + 1e-8)
    return Field(names, *w)


class Layouts:
    """A grammar of page layouts: every page has an article and some of the things around it."""

    SYLLABLES = "ba ce di fo gu la me ni po ru sa te vi zo an en ir or un el ta re mi no su".split()

    def __init__(self, seed: int):
        self.r = np.random.default_rng(seed)

    def one(self, *of):
        return of[int(self.r.integers(len(of)))]

    def chance(self, p: float) -> bool:
        return bool(self.r.random() < p)

    def words(self, low: int, high: int) -> list[str]:
        return ["".join(self.SYLLABLES[i] for i in self.r.integers(0, len(self.SYLLABLES), int(self.r.integers(1, 5)))) for _ in range(int(self.r.integers(low, high + 1)))]

    def sentences(self, low: int, high: int) -> str:
        out = []
        for _ in range(int(self.r.integers(low, high + 1))):
            ws = self.words(1, 18)
            ws = [w + "," if self.chance(0.1) else w for w in ws]
            out.append(" ".join(ws).capitalize() + self.one(".", ".", ".", ".", "!", "?"))
        text = " ".join(out)
        return text.replace(" ", self.one("*** ", "&amp;&amp; ", "!! "), 5) if self.chance(0.1) else text

    def phrase(self, high: int = 5) -> str:
        return " ".join(self.words(1, high)).capitalize() + ("." if self.chance(0.3) else "")

    def links(self, low: int, high: int) -> str:
        item = self.one("li", "li", "div", "a", "td")
        rows = "".join(f"<{item}><a href='/x'>{self.phrase(3)}</a></{item}>" if item != "a" else f"<a href='/x'>{self.phrase(2)}</a> " for _ in range(int(self.r.integers(low, high + 1))))
        return f"<ul>{rows}</ul>" if item == "li" else f"<table><tr>{rows}</tr></table>" if item == "td" else rows

    def wrap(self, inner: str, tag: str, cues: str, y: int) -> str:
        """inside the semantic tag, or inside a div (or section) named by a cue word, or both."""
        name = self.one(*cues.split())
        name = self.one(name, f"site-{name}", f"{name}-box", f"main_{name}" if y == 0 else f"{name}-wrap")
        attr = self.one(f' class="{name}"', f' id="{name}"', f' class="x1 {name} wide"')
        kind = self.r.random()
        box = self.one("div", "div", "section")
        if kind < 0.4:
            return f'<{tag} data-y="{y}">{inner}</{tag}>'
        if kind < 0.85:
            return f'<{box}{attr} data-y="{y}">{inner}</{box}>'
        return f'<{tag}{attr} data-y="{y}">{inner}</{tag}>'

    def inset(self) -> str:
        """Something inside a run of text: a link, a button, a formula, or an advert or notice that is no part of it."""
        kind = self.r.random()
        if kind < 0.4:
            return f"<a href='/y'>{self.phrase(3)}</a>"
        if kind < 0.6:
            return f"<button>{self.phrase(2)}</button>"
        if kind < 0.7:
            return f"<math><mi>{self.phrase(1)}</mi></math>"
        name = self.one(*"ad ads advert sponsored promo banner notice alert".split())
        tag = self.one("span", "span", "a", "small", "b")
        return f'<{tag} class="{self.one(name, f"x1 {name}", f"{name}-inline")}" data-y="0">{self.one(self.phrase(5), self.sentences(1, 1))}</{tag}>'

    def titles(self, low: int, high: int) -> str:
        """A list of linked titles, as articles have for what they cite."""
        rows = "".join(f"<li><a href='/z'>{self.phrase(self.one(2, 4, 9))}</a>{self.one('', '', '. ' + self.phrase(4))}</li>" for _ in range(int(self.r.integers(low, high + 1))))
        return f"<{(t := self.one('ul', 'ol'))}>{rows}</{t}>"

    def article(self) -> str:
        shape = self.r.random()
        body = [f"<h1>{self.phrase(12)}</h1>"] if self.chance(0.85) else []
        for _ in range(int(self.r.integers(1, 12))):
            kind = self.r.random()
            if kind < 0.72:
                body.append(f"<p>{self.sentences(1, 8)}" + ("</p>" if self.chance(0.8) else ""))
            elif kind < 0.78:
                body.append(f"<h2>{self.phrase(7)}</h2>")
            elif kind < 0.83:
                body.append(f"<p>{self.phrase(3)}</p>")
            elif kind < 0.88:
                body.append("<ul>" + "".join(f"<li>{self.sentences(1, 2)}</li>" for _ in range(3)) + "</ul>")
            elif kind < 0.92:
                body.append(f"<blockquote>{self.sentences(1, 3)}</blockquote>")
            elif kind < 0.96:
                body.append(f"<p><b>{self.phrase(9)}<br><p>{self.sentences(1, 5)}</p>")
            else:
                body.append("<table>" + "".join(f"<tr><td>{self.phrase(3)}</td><td>{self.phrase(6)}</td></tr>" for _ in range(3)) + "</table>")
            if self.chance(0.03):
                body.append(self.advert())
            if self.chance(0.08):
                body.append(f"<p>{self.sentences(0, 2)}{self.one(' ', '')}{self.inset()} {self.sentences(1, 3)}</p>")
            if shape < 0.9 and self.chance(0.05):
                body.append(self.titles(1, 6))
        if shape < 0.9 and self.chance(0.12):
            body.append(f"<h2>{self.phrase(2)}</h2>{self.titles(1, 9)}")
        inner = "".join(body)
        if self.chance(0.2):
            inner = f"<div>{inner}</div>"
        if shape < 0.5:
            return f'<article data-y="1">{inner}</article>'
        if shape < 0.65:
            return f'<main data-y="1">{inner}</main>'
        if shape < 0.9:
            name = self.one("content", "article-body", "post", "entry-content", "story", "main-content", "text")
            return f'<div class="{name}" data-y="1">{inner}</div>'
        return f'<div data-y="1">{inner}</div>'

    def advert(self) -> str:
        return self.wrap(self.one(self.sentences(1, 3), f"<p>{self.sentences(1, 2)}</p>", f"<a href='/b'>{self.phrase(5)}</a>"), "aside", "ad ads advert sponsored promo banner", 0)

    def around(self) -> dict[str, str]:
        y = 0
        press = lambda: f"<button>{self.phrase(2)}</button>" if self.chance(0.4) else ""
        comments = "".join(f"<{t}><p>{self.phrase(2)}</p><p>{self.sentences(1, 4)}</p></{t}>" for t in [self.one("div", "li")] for _ in range(int(self.r.integers(1, 6))))
        made = {
            "header": lambda: self.wrap(self.one(f"<p>{self.phrase(4)}</p>", f"<a href='/'>{self.phrase(2)}</a>", f"<h1>{self.phrase(3)}</h1><p>{self.phrase(8)}</p>"), "header", "header masthead branding", y),
            "nav": lambda: self.wrap(self.links(3, 10), "nav", "nav menu navbar breadcrumb navigation", y),
            "notice": lambda: self.wrap(self.one(f"<p>{self.sentences(1, 3)}</p>", self.sentences(1, 2)) + press(), "div", "cookie consent notice alert popup gdpr", y),
            "ad": self.advert,
            "side": lambda: self.wrap(self.one(self.links(2, 8), f"<h3>{self.phrase(3)}</h3>{self.links(2, 6)}", f"<p>{self.sentences(1, 4)}</p>"), "aside", "sidebar widget related popular", y),
            "comments": lambda: self.wrap(f"<h3>{self.phrase(2)}</h3>{comments}{press()}", "section", "comments comment-list replies discussion disqus", y),
            "form": lambda: f'<form data-y="0"><label>{self.phrase(2)}</label><input><p>{self.phrase(8)}</p>{press()}</form>',
            "newsletter": lambda: self.wrap(f"<p>{self.sentences(1, 2)}</p>{press()}", "div", "newsletter subscribe signup", y),
            "share": lambda: self.wrap(self.one(self.links(2, 5), f"<button>{self.phrase(1)}</button> <button>{self.phrase(2)}</button>"), "div", "share social", y),
            "footer": lambda: self.wrap(self.one(f"&copy; {self.phrase(3)} &middot; {self.sentences(1, 1)}", f"<p>Copyright {self.phrase(4)}</p>{self.links(2, 5)}", f"<p>{self.sentences(1, 2)}</p>"), "footer", "footer legal copyright", y),
        }
        return {k: f() for k, f in made.items()}

    def plain(self) -> str:
        """A page of text alone, with few cues or none: paragraphs in the body or in plain boxes, sometimes a heading and a menu of links."""
        ps = [self.sentences(1, 6) for _ in range(int(self.r.integers(1, 7)))]
        kind = self.r.random()
        if kind < 0.4:
            inner = "".join(f'<p data-y="1">{x}</p>' for x in ps)
        elif kind < 0.5:
            inner = f'<div data-y="1">{"<br><br>".join(ps)}</div>'
        elif kind < 0.75:
            inner = "".join(f'<div data-y="1">{x}</div>' for x in ps)
        elif kind < 0.85:
            inner = f'<pre data-y="1">{ps[0]}</pre>'
        else:
            inner = f'<table><tr><td data-y="1">{"".join(f"<p>{x}</p>" for x in ps)}</td></tr></table>'
        if self.chance(0.4):
            inner = f'<h1 data-y="1">{self.phrase(9)}</h1>' + inner
        for _ in range(int(self.r.integers(0, 3))):
            inner = f"<{(t := self.one('div', 'section', 'center'))}>{inner}</{t}>"
        if self.chance(0.3):
            inner = f"<div>{self.links(3, 8)}</div>" + inner
        if self.chance(0.2):
            inner += f"<div>{self.links(3, 8)}</div>"
        return inner if self.chance(0.4) else f"<html><head><title>{self.phrase(6)}</title></head><body>{inner}</body></html>"

    def page(self) -> str:
        if self.chance(0.3):
            return self.plain()
        a, art = self.around(), self.article()
        p = {"header": 0.5, "nav": 0.9, "notice": 0.3, "ad": 0.6, "side": 0.5, "comments": 0.4, "form": 0.3, "newsletter": 0.3, "share": 0.3, "footer": 0.95}
        use = {k: v for k, v in a.items() if self.chance(p[k])}
        before = [use[k] for k in ("notice", "header", "nav", "ad") if k in use]
        after = [use[k] for k in ("share", "comments", "side", "newsletter", "form") if k in use]
        if "side" in use and self.chance(0.3):
            after.remove(use["side"])
            before.append(use["side"])
        if self.chance(0.15) and "comments" in use and art.endswith("</article>"):
            after.remove(use["comments"])
            art = art[: -len("</article>")] + use["comments"] + "</article>"
        last = [use["footer"]] if "footer" in use else []
        return f"<html><head><title>{self.phrase(6)}</title></head><body>{''.join(before)}{art}{''.join(after)}{''.join(last)}</body></html>"


def labelled_pages(count: int, seed: int) -> list[tuple[list[Block], list[int]]]:
    """Pages of the grammar with a label per block."""
    layouts = Layouts(seed)
    out = []
    for _ in range(count):
        found = blocks(layouts.page())
        if found:
            out.append((found, [int(b.label == "1") for b in found]))
    return out


def trained(pages: int = 600, seed: int = 11) -> Field:
    """The field trained on pages of the grammar."""
    return fit(labelled_pages(pages, seed))


@cache
def model() -> Field:
    """trained(), from the file of its weights."""
    w = json.loads(WEIGHTS.read_text(encoding="utf-8"))
    return Field(list(w["emit"]), np.array(list(w["emit"].values())), np.array(w["step"]), np.array(w["start"]))


def save(field: Field, path: Path = WEIGHTS) -> None:
    """Write a field's weights."""
    names = sorted(field.index, key=field.index.__getitem__)
    emit = {x: np.round(v, 5).tolist() for x, v in zip(names, field.emit)}
    rest = {"step": np.round(field.step, 5).tolist(), "start": np.round(field.start, 5).tolist()}
    path.write_text(json.dumps({"emit": emit} | rest, indent=0) + "\n", encoding="utf-8")


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", body: str = "html", field: Field | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of pages.

    text is the page's main text: its blocks in page order, white space inside a block as one blank,
    joined by one blank; empty if there is none. A null html counts as empty. Repeated rows stay.
    """
    spark = pages.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(field or model())
    src = pages.select(F.col(f"`{page_id}`").alias("page_id"), F.col(f"`{url}`").alias("url"), F.col(f"`{body}`").cast("string").alias("_html"))
    schema = src.select("page_id", "url", F.lit("").alias("text"), F.lit(0).cast("long").alias("n_chars")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = shared.value
        for b in batches:
            texts = [f.text(x or "") for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], schema.names)

    return src.mapInArrow(run, schema)


if __name__ == "__main__":
    save(trained())
