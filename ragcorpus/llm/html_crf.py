"""Main text of web pages: a linear-chain conditional random field over the leaf blocks of the DOM.

A page becomes its blocks of text in page order. Each block has features of its ancestors (tags, words of class, id and
role), of its text and of its surroundings; the field has two states, main text and the rest. It is trained by maximum
likelihood on labelled pages and decoded by Viterbi. The labelled pages are written from layouts that sites use
(PAGES of them, seeded), since the tables hold no labels; the words on them are invented, so that only form counts.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Labelled pages that the field is trained on.
PAGES = 450

_TAG = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S
)
_LONG_REFERENCE = re.compile(r"&#(?=[0-9]{4000})0*([0-9]*)")
_MARK = re.compile(r"""\b(class|id|role|aria-label|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_WORD = re.compile(r"[a-z]+|[0-9]+")
#: A slash that closes a tag; one behind an unquoted value belongs to the value.
_CLOSED = re.compile(r"(?:^|[\s\"'])/\Z")
# Element kinds.
RAW = frozenset("script style iframe textarea title".split())  # text up to their end tag, or the page's end
HIDDEN = frozenset("noscript template svg math object canvas audio video select".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "html head body main article section aside nav header footer div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody tfoot tr td th blockquote pre form fieldset legend "
    "label button option figure figcaption address details summary hr center menu dialog".split()
)
CLOSES_P = BLOCK - frozenset("td th tr tbody thead tfoot caption dd dt li option label button".split())
SIBLINGS = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table", "tbody", "thead", "tfoot")), "td": ("td th", ("tr",)), "th": ("td th", ("tr",)), "option": ("option", ("select",))}
_HIDDEN = re.compile(rf"(?i)<(?:{'|'.join(sorted(HIDDEN))})\b")
# Words of class, id and role, by what they tell.
MARKS = {
    "nav": "nav menu navbar navigation breadcrumb breadcrumbs crumbs toc pagination pager tabs skip sitemap topnav mainnav links",
    "header": "header masthead topbar banner logo branding site head",
    "footer": "footer foot colophon copyright legal bottom contentinfo",
    "side": "sidebar aside side rail related recommended more widget widgets complementary trending popular recent see",
    "ad": "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion promoted adsense dfp outbrain taboola",
    "notice": "cookie cookies notice consent gdpr alert popup modal overlay paywall warning announcement privacy toast",
    "comment": "comment comments reply replies respond disqus discussion feedback reader readers responses thread",
    "form": "form newsletter subscribe subscription signup login search searchbox contact register optin mailing",
    "share": "share sharing social follow tweet facebook like rating tags tag byline meta",
    "main": "content article post entry main story body text prose copy page maincontent articlebody postbody",
}
_KIND = {w: k for k, ws in MARKS.items() for w in ws.split()}


@dataclass(slots=True)
class Block:
    text: str
    path: tuple  # features of the ancestors
    tag: str
    linked: int  # characters inside links
    label: int = 0


def _marks(attributes: str) -> tuple[str, ...]:
    found = set()
    for _, a, b, c in _MARK.findall(attributes):
        for word in _WORD.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", a or b or c).lower()):
            if word in _KIND:
                found.add("mark:" + _KIND[word])
    return tuple(sorted(found))


def _behind(tag: str, page: str, at: int) -> int:
    """Where the text of a raw element ends, behind its end tag."""
    end = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(page, at)
    return end.end() if end else len(page)


def _hidden_ends(page: str) -> dict[int, int]:
    """Where each hidden element ends, by where its start tag ends.

    One without an end tag of its own before the end of the block around it, or of the page, is left out: it hides
    nothing. One pass, whose stack holds blocks and hidden elements.
    """
    ends: dict[int, int] = {}
    if not _HIDDEN.search(page):
        return ends
    stack: list[tuple[str, int]] = []
    depth = dict.fromkeys(BLOCK | HIDDEN, 0)
    at = 0
    while m := _TAG.search(page, at):
        at = m.end()
        closing, tag, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        tag = tag.lower() if tag else ""
        if tag in RAW and not closing and not _CLOSED.search(attributes):
            at = _behind(tag, page, at)
        if tag not in depth or tag in VOID:
            continue
        if closing:
            top = "" if depth[tag] else tag
            while top != tag:
                top, start = stack.pop()
                depth[top] -= 1
                if top == tag and tag in HIDDEN:
                    ends[start] = at
        elif not _CLOSED.search(attributes):
            if tag in CLOSES_P and stack and stack[-1][0] == "p":
                stack.pop()
                depth["p"] -= 1
            stack.append((tag, at))
            depth[tag] += 1
    return ends


class _Open:
    """An open element: its place in the order of opening, its neighbour below, and what its marks tell."""

    __slots__ = ("above", "below", "block", "inside", "marks", "seq", "tag")

    def __init__(self, tag: str, marks: tuple[str, ...], seq: int, below: _Open | None, block: _Open | None):
        self.tag, self.marks, self.seq, self.below, self.above, self.block = tag, marks, seq, below, None, block
        self.inside: Counter = Counter()  # marks of the inline elements that stand on a block, up to the next block


class _Stack:
    """The open elements of a page. Each step costs the same however deep they nest: what a block of text asks about its
    ancestors is counted as elements open and close."""

    def __init__(self) -> None:
        self.top = _Open("", (), -1, None, None)
        self.by_tag: dict[str, list[_Open]] = {}
        self.blocks: list[_Open] = [self.top]
        self.features: Counter = Counter()
        self.seq = 0

    def last(self, tag: str) -> _Open | None:
        found = self.by_tag.get(tag)
        return found[-1] if found else None

    def push(self, tag: str, marks: tuple[str, ...]) -> None:
        own = _Open(tag, marks, self.seq, self.top, self.blocks[-1])
        self.seq += 1
        self.top.above = own
        self.top = own
        self.by_tag.setdefault(tag, []).append(own)
        if tag in BLOCK:
            self.features[f"in:{tag}"] += 1
            self.blocks.append(own)
        if marks:
            self.features.update(marks)
            if tag not in BLOCK:
                own.block.inside.update(marks)

    def remove(self, own: _Open) -> None:
        """Take the last element of its tag out, wherever it stands; a block only from the top."""
        self.by_tag[own.tag].pop()
        if own.tag in BLOCK:
            self.features[f"in:{own.tag}"] -= 1
            self.blocks.pop()
        if own.marks:
            self.features.subtract(own.marks)
            if own.tag not in BLOCK:
                own.block.inside.subtract(own.marks)
        own.below.above = own.above
        if own.above:
            own.above.below = own.below
        else:
            self.top = own.below

    def pop_to(self, own: _Open) -> None:
        while self.top.seq >= own.seq:
            self.remove(self.top)

    def path(self) -> tuple[str, tuple[str, ...]]:
        """The tag of the nearest block and the features of all ancestors; those from one below that block on are near."""
        block = self.blocks[-1]
        near = {m for m, n in block.inside.items() if n > 0} | set(block.marks) | set(block.below.marks if block.below else ())
        return block.tag or "body", tuple(sorted({f for f, n in self.features.items() if n > 0} | {f"near:{m}" for m in near}))


def blocks_of(page: str | None) -> list[Block]:
    """The text blocks of a page in order; text outside of any element counts as the body's."""
    page = page or ""
    out: list[Block] = []
    stack = _Stack()
    pieces: list[str] = []
    linked = at = 0

    def flush() -> None:
        nonlocal linked
        if pieces:
            text = " ".join("".join(pieces).split())
            if text and not stack.last("head"):
                tag, path = stack.path()
                out.append(Block(text, path, tag, min(linked, len(text))))
            pieces.clear()
        linked = 0

    def add(raw: str) -> None:
        nonlocal linked
        # a number of thousands of digits stands for what its first ones do: no character, or that behind its zeros
        text = entities.unescape(_LONG_REFERENCE.sub(lambda m: "&#" + (m[1][:20] or "0"), raw)) if "&" in raw else raw
        pieces.append(text)
        if stack.last("a"):
            linked += len(text.strip())

    n, ends = len(page), _hidden_ends(page)
    while at < n:
        m = _TAG.search(page, at)
        if not m:
            add(page[at:])
            break
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        if m[0].startswith("<![CDATA["):
            add(m[0][9:].removesuffix("]]>"))
            continue
        closing, tag, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            continue
        tag = tag.lower()
        if tag in RAW or tag in HIDDEN:
            if not closing and not _CLOSED.search(attributes):
                at = _behind(tag, page, at) if tag in RAW else ends.get(at, at)
            pieces.append(" ")
            continue
        if tag in VOID:
            if tag in ("br", "hr", "img"):
                pieces.append(" ")
            if tag == "hr":
                flush()
            continue
        if closing:
            if tag in BLOCK:
                flush()
            if own := stack.last(tag):
                # the end of an inline element closes no blocks that stand on it
                if tag in BLOCK or stack.blocks[-1].seq < own.seq:
                    stack.pop_to(own)
                else:
                    stack.remove(own)
            continue
        if tag in BLOCK:
            flush()
            if tag in CLOSES_P and (p := stack.last("p")):
                stack.pop_to(p)
            elif tag in SIBLINGS:
                kin, limits = SIBLINGS[tag]
                nearest = lambda tags: max((e for t in tags if (e := stack.last(t))), key=lambda e: e.seq, default=None)
                sibling, limit = nearest(kin.split()), nearest(limits)
                if sibling and (not limit or limit.seq < sibling.seq):
                    stack.pop_to(sibling)
            elif tag == "body" and (heads := stack.by_tag.get("head")):
                stack.pop_to(heads[0])
        marks = _marks(attributes) if attributes else ()
        if not _CLOSED.search(attributes):
            stack.push(tag, marks)
    flush()
    return out


#: Kinds of marks that reject what stands within.
_REJECTING = frozenset(f"mark:{k}" for k in MARKS if k != "main") | {"in:form", "in:nav", "in:aside", "in:footer", "in:header"}


def text_features(page: list[Block]) -> list[list[str]]:
    """Features of each block's own text and place, and of how the page went on from the blocks before."""
    seen: set[tuple] = set()
    before: Block | None = None
    out = []
    for i, block in enumerate(page):
        words = block.text.count(" ") + 1
        share = block.linked / max(1, len(block.text))
        own = [
            "bias",
            f"tag:{block.tag}",
            f"words:{min(6, words.bit_length())}",
            "links:all" if share > 0.8 else "links:some" if share > 0.3 else "links:few" if share > 0 else "links:none",
            f"end:{'stop' if block.text[-1] in '.!?…:;\"”»)' else 'open'}",
            f"commas:{min(3, block.text.count(','))}",
        ]
        if "©" in block.text or "(c)" in block.text.lower():
            own.append("copyright")
        if block.tag == "h1":
            own.append("first:h1" if i < len(page) // 2 else "late:h1")
        here = frozenset(block.path)
        if before is not None:
            there = frozenset(before.path)
            if here == there:
                own.append("stays")
            if (left := (there - here) & _REJECTING) and not here & _REJECTING:
                own += ["leaves", *(f"leaves:{m}" for m in sorted(left))]
            if (entered := (here - there) & _REJECTING):
                own += [f"enters:{m}" for m in sorted(entered)]
            # back beside blocks from before what stood between
            if here != there and (block.tag, block.path) in seen:
                own.append("returns")
                if before.linked > 0.8 * len(before.text):
                    own.append("returns:links")
        seen.add((block.tag, block.path))
        before = block
        out.append(own)
    return out


class Field:
    """Two-state linear chain: weights of features, of transitions and of the start."""

    def __init__(self) -> None:
        self.names: dict[str, int] = {}
        self.paths: dict[tuple, np.ndarray] = {}

    def _ids(self, features: list[str], grow: bool) -> list[int]:
        if grow:
            return [self.names.setdefault(f, len(self.names)) for f in features]
        return [self.names[f] for f in features if f in self.names]

    def fit(self, pages: list[list[Block]], rounds: int = 200, rate: float = 0.1, l2: float = 0.01) -> Field:
        ids = [[self._ids([*b.path, *own], True) for b, own in zip(p, text_features(p), strict=True)] for p in pages]
        most, width = max(map(len, pages)), len(self.names)
        x = np.zeros((len(pages), most, width), np.float32)
        y, mask = np.zeros((len(pages), most), int), np.zeros((len(pages), most), bool)
        for k, page in enumerate(pages):
            for i, b in enumerate(page):
                x[k, i, ids[k][i]] = 1
                y[k, i], mask[k, i] = b.label, True
        flat, rows = x[mask], np.flatnonzero(mask)
        w, t, s = np.zeros((width, 2)), np.zeros((2, 2)), np.zeros(2)
        moments = [(np.zeros_like(p), np.zeros_like(p)) for p in (w, t, s)]
        one = np.zeros((len(pages), most, 2))
        one[mask, y[mask]] = 1
        for step in range(1, rounds + 1):
            e = np.zeros((len(pages), most, 2))
            e[mask] = flat @ w
            forward, backward = np.zeros_like(e), np.zeros_like(e)
            forward[:, 0] = e[:, 0] + s
            for i in range(1, most):
                moved = np.logaddexp(forward[:, i - 1, 0, None] + t[0], forward[:, i - 1, 1, None] + t[1]) + e[:, i]
                forward[:, i] = np.where(mask[:, i, None], moved, forward[:, i - 1])
            for i in range(most - 2, -1, -1):
                ahead = e[:, i + 1] + backward[:, i + 1]
                moved = np.logaddexp(ahead[:, 0, None] + t[:, 0], ahead[:, 1, None] + t[:, 1])
                backward[:, i] = np.where(mask[:, i + 1, None], moved, 0)
            z = np.logaddexp(forward[:, -1, 0], forward[:, -1, 1])
            p = np.exp(forward + backward - z[:, None, None]) * mask[..., None]
            gw = flat.T @ (p - one).reshape(-1, 2)[rows] / len(rows) + l2 * w / len(pages)
            gt = np.zeros((2, 2))
            both = mask[:, 1:]
            for a in (0, 1):
                for b in (0, 1):
                    joint = np.exp(forward[:, :-1, a] + t[a, b] + e[:, 1:, b] + backward[:, 1:, b] - z[:, None])
                    gt[a, b] = ((joint - one[:, :-1, a] * one[:, 1:, b]) * both).sum() / len(rows)
            gs = (p[:, 0] - one[:, 0]).sum(axis=0) / len(rows)
            for param, g, (m, v) in zip((w, t, s), (gw, gt, gs), moments, strict=True):
                m *= 0.9
                m += 0.1 * g
                v *= 0.99
                v += 0.01 * g * g
                param -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        self.w, self.t, self.s = w, t, s
        return self

    def decode(self, page: list[Block]) -> list[int]:
        """The likeliest states of a page's blocks."""
        if not page:
            return []
        t, trail = self.t.tolist(), []
        a, b = self.s.tolist()
        for i, (block, own) in enumerate(zip(page, text_features(page), strict=True)):
            base = self.paths.get(block.path)
            if base is None:
                if len(self.paths) > 20_000:
                    self.paths.clear()
                base = self.paths[block.path] = self.w[self._ids(list(block.path), False)].sum(axis=0)
            e = base + self.w[self._ids(own, False)].sum(axis=0)
            if i:
                from_a, from_b = (a + t[0][0], b + t[1][0]), (a + t[0][1], b + t[1][1])
                trail.append((int(from_a[1] > from_a[0]), int(from_b[1] > from_b[0])))
                a, b = max(from_a), max(from_b)
            a, b = a + float(e[0]), b + float(e[1])
        state, out = int(b > a), []
        for back in [*reversed(trail), None]:
            out.append(state)
            state = back[state] if back else state
        return out[::-1]


def labelled_pages(pages: int = PAGES, seed: int = 3) -> list[list[Block]]:
    """Pages in many layouts whose blocks are labelled: main text is marked in the source by a trailing sign."""
    rng = random.Random(seed)
    pick = lambda *xs: rng.choice(xs)
    yes = lambda p: rng.random() < p
    word = lambda: "".join(pick("ka", "lo", "mi", "ten", "ra", "sul", "ve", "no", "dor", "pi", "ash", "é", "ün") for _ in range(rng.randrange(1, 4)))
    words = lambda a, b: " ".join(word() for _ in range(rng.randrange(a, b)))
    ok = "⁣"  # no reader sees it; it marks what is main text

    def sentence(a: int = 3, b: int = 40) -> str:
        return words(a, b).capitalize() + pick(".", ".", ".", "!", "?", "", ",", " |")

    def text(short: float = 0.25) -> str:
        return sentence(1, 4) if yes(short) else " ".join(sentence() for _ in range(rng.randrange(1, 6)))

    def links(n: int, tag: str = "li") -> str:
        own = "".join(f"<{tag}><a href='/{word()}'>{words(1, 4)}</a></{tag}>" for _ in range(n))
        return f"<ul>{own}</ul>" if tag == "li" else own

    def wrap(kind: str, inner: str, tags: tuple[str, ...] = ("div", "section", "div")) -> str:
        marks = MARKS[kind].split()
        tag = pick(*tags)
        return f'<{tag} {pick("class", "id")}="{pick(word() + " ", "", "")}{pick(*marks)}{pick("", "-" + word(), "_box", " " + pick(*marks))}">{inner}</{tag}>'

    def noise(kind: str) -> str:
        if kind == "nav":
            row = pick(" ", " | ", "").join(f"<a href='/{word()}'>{words(1, 3)}</a>" for _ in range(rng.randrange(1, 7)))
            return pick(f"<nav>{row}</nav>", wrap("nav", row), f"<nav>{links(rng.randrange(3, 10))}</nav>", wrap("nav", links(rng.randrange(3, 10))), wrap("nav", links(rng.randrange(3, 8), "span")))
        if kind == "header":
            return pick(f"<header>{words(1, 5)}</header>", f"<header><a href='/'>{words(1, 4)}</a>{f'<p>{sentence(2, 8)}</p>' if yes(0.5) else ''}</header>", wrap("header", f"<p>{words(1, 5)}</p>"))
        if kind == "footer":
            inner = pick(f"&copy; {words(1, 4)} &middot; {text()}", f"<p>&copy; 2020 {words(1, 5)}</p>{links(3)}", f"<p>{text()}</p>", links(4))
            return pick(f"<footer>{inner}</footer>", f"<footer>{inner}</footer>", wrap("footer", inner))
        if kind == "comment":
            one = lambda: pick(f"<p>{text()}</p>", f"<div><b>{word()}</b> <span>{words(1, 3)}</span><p>{text()}</p></div>", f"<article><p>{text()}</p></article>", f"<li><p>{text()}</p></li>")
            return wrap("comment", f"<h{pick(2, 3, 4)}>{words(1, 3)}</h3>" * yes(0.6) + "".join(one() for _ in range(rng.randrange(1, 6))), ("div", "section", "ul", "ol"))
        if kind == "form":
            inner = f"<p>{text()}</p><label>{words(1, 4)}</label><input type='text'><button>{words(1, 3)}</button>"
            return pick(f"<form action='/x'>{inner}</form>", wrap("form", f"<form>{inner}</form>"), wrap("form", f"<p>{text()}</p>"))
        if kind == "side":
            inner = pick(links(rng.randrange(2, 7)), f"<h3>{words(1, 4)}</h3>{links(4)}", f"<p>{text()}</p>", f"<h3>{words(1, 3)}</h3><p>{text()}</p><p>{text()}</p>")
            return pick(f"<aside>{inner}</aside>", wrap("side", inner, ("div", "aside", "section")))
        if kind == "share":
            return wrap("share", pick(links(4), links(3, "span"), f"<span>{words(1, 3)}</span>"))
        return wrap(kind, pick(text(), f"<p>{text()}</p>", f"<p>{text()}</p><a href='#'>{words(1, 3)}</a>", f"<b>{words(1, 3)}</b> {text()}"), ("div", "div", "aside", "section", "p") if kind == "ad" else ("div", "div", "section"))

    def good(inner: str) -> str:
        return inner + ok

    def paragraph() -> str:
        kind = rng.random()
        if kind < 0.62:
            body = text()
            if yes(0.15):
                body += f" <a href='/{word()}'>{words(1, 4)}</a>{pick('.', ' ' + sentence())}"
            return pick(f"<p>{good(body)}</p>", f"<p>{good(body)}", f"<p><b>{good(body)}<br></p>", f"<p><b>{good(body)}</b></p>", f"<p>{good(body)}</p>")
        if kind < 0.72:
            return f"<h{pick(2, 3, 4)}>{good(words(1, 7))}</h2>"
        if kind < 0.82:
            return pick("<ul>{}</ul>", "<ol>{}</ol>").format("".join(f"<li>{good(text(0.5))}</li>" for _ in range(rng.randrange(2, 6))))
        if kind < 0.88:
            return f"<blockquote>{pick(good(text()), f'<p>{good(text())}</p>')}</blockquote>"
        if kind < 0.92:
            return f"<pre>{good(words(3, 20))}</pre>"
        if kind < 0.96:
            return "<table>" + "".join(f"<tr><td>{good(words(1, 3))}</td><td>{good(words(1, 5))}</td></tr>" for _ in range(rng.randrange(1, 4))) + "</table>"
        return f"<div>{good(text())}</div>"

    def between() -> str:
        """What sites put between the paragraphs of an article."""
        kind = rng.randrange(6)
        if kind == 0:
            return noise(pick("ad", "share", "form", "side", "notice"))
        if kind == 1:
            return pick(links(rng.randrange(1, 5)), f"<p>{pick(words(1, 3), '')} {links(rng.randrange(2, 5), 'span')}</p>", f"<div>{links(rng.randrange(1, 4), 'p')}</div>")
        if kind == 2:
            return wrap(pick("share", "side", "nav"), pick(links(rng.randrange(1, 4), "span"), words(1, 5), f"{words(1, 2)}: <a href='/x'>{words(1, 2)}</a>, <a href='/y'>{words(1, 2)}</a>"), ("p", "div", "span", "p"))
        if kind == 3:
            return pick(f"<form>{words(1, 3)}</form>", f"<form><p>{text()}</p><input></form>", f"<form><label>{words(1, 3)}</label><button>{word()}</button></form>")
        if kind == 4:
            return wrap(pick("form", "ad", "notice", "side"), pick(f"<p>{text(0.6)}</p>", sentence(1, 8), f"<h4>{words(1, 4)}</h4><p>{text(0.5)}</p>"), ("div", "aside", "section", "div"))
        return f"<aside>{pick(text(0.5), f'<p>{text(0.5)}</p>', links(3))}</aside>"

    out = []
    for _ in range(pages):
        bare = yes(0.12)  # nothing but a short article
        body = [f"<h1>{good(words(1, 10))}{pick('', '.')}</h1>"] * yes(0.4 if bare else 0.85)
        terse, broken = yes(0.2), pick(0.0, 0.06, 0.15, 0.3)
        for _ in range(rng.randrange(1, 3 if bare else pick(3, 8, 16, 16))):
            body.append(f"{pick('<p>{}</p>', '<p>{}', '{}<br>').format(good(sentence(1, 5)))}" if terse else paragraph())
            if yes(broken):
                body.append(between())
        if broken and yes(0.7):
            body.append(f"<p>{good(sentence(1, 5) if terse else text())}</p>")
        inner = "".join(body)
        if yes(0.3):
            inner += noise("comment")
        main = pick(
            f"<article>{inner}</article>", f"<article>{inner}</article>", f"<main>{inner}</main>", f"<main><article>{inner}</article></main>", wrap("main", inner), wrap("main", f"<article>{inner}</article>"),
            f"<div><div>{inner}</div></div>", wrap("main", inner, ("div",)), f"<div role='main'>{inner}</div>", f"<section>{inner}</section>", f"<table><tr><td>{inner}</td></tr></table>",
        )
        page = "<html><head><title>x</title></head><body>"
        for kind, p in (("notice", 0.3), ("header", 0.45), ("nav", 0.8), ("notice", 0.15), ("ad", 0.5), ("form", 0.15), ("side", 0.2)):
            page += noise(kind) * yes(0 if bare else p)
        page += main
        for kind, p in (("share", 0.2), ("comment", 0.35), ("form", 0.2), ("side", 0.4), ("ad", 0.3), ("nav", 0.15), ("footer", 0.85), ("notice", 0.15)):
            page += noise(kind) * yes(0 if bare else p)
        page += pick("</body></html>", "")
        blocks = blocks_of(page)
        for b in blocks:
            b.label = int(ok in b.text)
            b.text = b.text.replace(ok, "").strip() or "."
        out.append(blocks)
    return out


@lru_cache(maxsize=1)
def field() -> Field:
    return Field().fit(labelled_pages())


def main_text(page: str | None, model: Field) -> str:
    blocks = blocks_of(page)
    return "\n".join(b.text for b, state in zip(blocks, model.decode(blocks), strict=True) if state)


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) for each row of pages, a map over its rows.

    text is the page's main blocks in order, one a line; white space inside a block is one space and character
    references are decoded. Null and empty pages, and pages without main text, have the empty text and 0 characters.
    A null id or url stays null; repeated rows repeat; other columns are ignored; no rows give none.
    """
    model = field()
    model.paths = {}

    @F.pandas_udf("string")
    def extract(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series([main_text(h, model) for h in part], dtype=object)

    own = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), extract(F.col(html_col)).alias("text"))
    return own.withColumn("n_chars", F.char_length("text").cast("long"))
