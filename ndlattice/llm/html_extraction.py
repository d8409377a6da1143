"""Main-text extraction from HTML by minimum cut.

A page is cut into blocks of text at block-level tags.  A logistic classifier over a block's
elements, class and id words, link share, length and punctuation gives two costs, of calling it
boilerplate and of calling it content; they become the capacities of its edges from the source and
to the sink.  Consecutive blocks, and blocks that follow one another under one parent, are joined
by smoothness edges that grow weaker with their distance in the DOM.  What the source still
reaches after a maximum flow is content.

The classifier is fitted, and the two smoothness weights are chosen, on labelled pages generated
from a seed: with semantic elements, with class names only, and with neither, so that its costs
say how sure it is and short or plain blocks are left to their neighbours.

Defined cases: null html counts as empty and gives an empty text; a page of bare text without
tags is its own content; what is hidden (the hidden attribute, display:none, aria-hidden, controls
and scripts) is left out wherever it stands, and the text around it stays; unclosed tags, comments,
scripts and character references at the page's end are read as browsers do (an unfinished tag or
comment is dropped); no content block -> empty text; repeated rows and null ids are extracted one
by one; other columns are ignored.
"""

from __future__ import annotations

import functools
import html as entities
import itertools
import math
import random
import re
from collections import deque
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, record

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?>[^>"']+|"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z))*+)(>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+)))?""")
_NAME = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")

#: Fixed sets of elements.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style title textarea noscript template iframe xmp noembed noframes".split())
HIDDEN = frozenset("head select option button datalist svg canvas object audio video map dialog".split())
BLOCK = frozenset("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCK - {"br"}

#: Facts of the classifier: elements a block may stand in, elements it may be, words of class names and ids by kind.
INSIDE = ("article", "main", "nav", "footer", "aside", "form", "header", "menu", "fieldset", "search")
OWN = ("p", "blockquote", "pre", "h1", "h2", "h3", "li", "td", "figcaption", "legend", "div", "dd")
WORDS = {
    "advert": "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner outbrain taboola",
    "reader": "comment comments commentlist disqus respond reply replies",
    "notice": "cookie cookies consent gdpr newsletter subscribe subscription signup popup modal overlay paywall notice alert login",
    "around": "sidebar nav navbar navigation menu footer breadcrumb breadcrumbs masthead share sharing social related recommended recommendations trending widget toolbar pagination pager search skip copyright legal disclaimer",
    "beside": "header top bottom meta tags byline author toc",
    "text": "article content main story entry post body text prose",
}
_KIND = {word: kind for kind, words in WORDS.items() for word in words.split()}
FACTS = ("base", *(f"in {x}" for x in INSIDE), "in own header", *(f"is {x}" for x in OWN), *(f"class {x}" for x in WORDS), "links", "length", "stops", "copyright")
_FACT = {name: i for i, name in enumerate(FACTS)}
#: Smoothness of neighbours in the page and under one parent: the choices; each step between their parents divides it further.
SMOOTH = ((0.0, 0.0), (0.5, 0.25), (1.0, 0.5), (1.5, 0.8), (2.0, 1.0))


class Block(NamedTuple):
    text: str
    facts: dict[int, float]
    parent: int  # serial number of the element it stands in
    depth: int


class Element(NamedTuple):
    tag: str
    facts: frozenset[int]  # of the element and all around it
    hidden: bool
    serial: int


def _tell(tag: str, attributes: str, inside: Element) -> tuple[frozenset[int], bool]:
    """Facts of an element within another one, and whether it is hidden."""
    found, hidden = inside.facts, tag in HIDDEN
    if tag in INSIDE:
        name = "in own header" if tag == "header" and (_FACT["in article"] in found or _FACT["in main"] in found) else f"in {tag}"
        found |= {_FACT[name]}
    if attributes and not attributes.isspace():
        for m in _ATTRIBUTE.finditer(attributes):
            name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
            if name in ("class", "id", "role"):
                found |= {_FACT[f"class {_KIND[w]}"] for w in _NAME.findall(value) if w in _KIND}
            hidden |= name == "hidden" or name == "style" and "display:none" in value.replace(" ", "") or name == "aria-hidden" and value == "true"
    return found, hidden


def blocks(page: str) -> list[Block]:
    """Visible blocks of text in page order."""
    out: list[Block] = []
    stack = [Element("", frozenset(), False, 0)]
    parts: list[str] = []
    linked = links = serial = 0
    own = stack[0]  # block element of the text in parts

    def flush() -> None:
        nonlocal linked
        text = _SPACE.sub(" ", entities.unescape("".join(parts))).strip() if parts else ""
        if text:
            out.append(Block(text, _facts(text, linked, own), own.serial, len(stack)))
        parts.clear()
        linked = 0

    at, n = 0, len(page)
    while at < n:
        m = _TAG.search(page, at)
        if m is None:
            break
        if m.start() > at and not stack[-1].hidden:
            parts.append(page[at : m.start()])
            linked += (m.start() - at) if links else 0
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag or not m[4]:  # a comment or declaration, or a tag that the page's end cuts off
            continue
        if tag in BLOCK:
            flush()
        if m[1]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    links -= sum(e.tag == "a" for e in stack[i:])
                    del stack[i:]
                    break
        elif tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(page, at)
            at = n if end is None else end.start()
        elif tag not in VOID and not m[3].endswith("/") or tag in BLOCK and tag not in VOID:
            if tag in CLOSES_P and any(e.tag == "p" for e in stack[-6:]):
                while len(stack) > 1 and any(e.tag == "p" for e in stack[-6:]):
                    links -= stack.pop().tag == "a"
            if stack[-1].tag == tag and tag in ("li", "dt", "dd", "td", "th", "tr", "option"):
                stack.pop()
            if tag == "body":  # whatever the head left open ends here
                stack = [e._replace(hidden=False) for e in stack if e.tag in ("", "html")]
            serial += 1
            told, hidden = _tell(tag, m[3], stack[-1])
            stack.append(Element(tag, told, stack[-1].hidden or hidden, serial))
            links += tag == "a"
        if tag in BLOCK or not parts:
            own = next((e for e in reversed(stack) if e.tag in BLOCK or not e.tag), stack[0])
    if at < n and not stack[-1].hidden:
        parts.append(page[at:])
        linked += (n - at) if links else 0
    flush()
    return out


def _facts(text: str, linked: int, own: Element) -> dict[int, float]:
    """All that the classifier knows of a block."""
    out = dict.fromkeys(own.facts, 1.0)
    out[0] = 1.0
    if own.tag in OWN:
        out[_FACT[f"is {own.tag}"]] = 1.0
    out[_FACT["links"]] = min(1.0, linked / len(text))
    out[_FACT["length"]] = math.log1p(len(text) / 20)
    out[_FACT["stops"]] = min(3, sum(map(text.count, ".!?")))
    out[_FACT["copyright"]] = float("©" in text or "copyright" in text.lower()[:200])
    return out


class Model(NamedTuple):
    weights: list[float]
    following: float
    sibling: float

    def score(self, block: Block) -> float:
        """Log odds that a block is content."""
        return sum(self.weights[i] * x for i, x in block.facts.items())

    def sides(self, found: list[Block]) -> list[bool]:
        """Which blocks are content: those on the source's side of the minimum cut."""
        edges, last = [], {}
        for i, b in enumerate(found):
            if i:
                a = found[i - 1]
                apart = 0 if a.parent == b.parent else 1 + abs(a.depth - b.depth)
                edges.append((i - 1, i, self.following / (1 + apart)))
                if (j := last.get(b.depth)) is not None and j < i - 1:
                    edges.append((j, i, self.sibling / (1 + i - j)))
            last[b.depth] = i
        # log(1 + e^s) to call it boilerplate, log(1 + e^-s) to call it content; their difference is s itself
        return min_cut([self.score(b) for b in found], edges)


def generated(pages: int, seed: int) -> Iterator[str]:
    """Pages whose every text block begins with the word ``yes`` (content) or ``no``."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice(("th", "er", "on", "an", "re", "en", "ment", "ción", "ä", "é", "ung", "st", "le", "que", "ing", "o")) for _ in range(r.choice((1, 1, 2, 2, 3, 4))))

    def say(kind: str, low: int, high: int, stop: float = 0.9) -> str:
        parts, left = [], r.randint(low, high)
        while left > 0:
            n = min(left, r.randint(3, 14))
            parts.append(" ".join(word() for _ in range(n)).capitalize() + ("." if r.random() < stop else ""))
            left -= n
        return f"{kind} {' '.join(parts)}"

    def links(n: int) -> str:
        return "".join(f'<li><a href="/{word()}">{say("no", 1, 3, 0.05)}</a></li>' for _ in range(n))

    for _ in range(pages):
        style = r.choice(("semantic", "semantic", "classes", "plain", "bare"))
        named = lambda kind: f' class="{r.choice(WORDS[kind].split())}"' if r.random() < {"semantic": 0.6, "classes": 1.0}.get(style, 0.1) else ""  # noqa: B023, E731
        part = lambda tag, kind, body: f"<{tag}{named(kind)}>{body}</{tag}>" if style == "semantic" else f"<div{named(kind)}>{body}</div>"  # noqa: B023, E731
        body: list[str] = []
        for _ in range(r.randint(1, 14)):
            x = r.random()
            if x < 0.7:
                body.append(f"<p>{say('yes', 1, 4) if r.random() < 0.25 else say('yes', 8, 90)}</p>" if r.random() < 0.75 else f"<div>{say('yes', 3, 60)}</div>")
            elif x < 0.8:
                body.append(f"<h{r.randint(2, 3)}>{say('yes', 2, 9, 0.3)}</h2>")
            elif x < 0.88:
                body.append("<ul>" + "".join(f"<li>{say('yes', 2, 20, 0.5)}</li>" for _ in range(r.randint(2, 5))) + "</ul>")
            else:
                tag = r.choice(("blockquote", "pre", "td", "dd", "figcaption"))
                body.append(f"<{tag}>{say('yes', 3, 30)}</{tag}>")
            if r.random() < 0.06 and style != "bare":
                body.append(f"<div{named('advert')}>{say('no', 3, 15)}</div>")
        if style == "bare":  # a page that is nothing but its text
            yield "".join(body)
            continue
        if r.random() < 0.4:
            body.insert(0, part("header", "beside", f"<p>{say('no', 2, 6, 0.1)}</p>") if style != "semantic" else f"<p{named('beside')}>{say('no', 2, 5, 0.1)}</p>")
        if r.random() < 0.25:
            body.append(f"<form{named('notice')}><p>{say('no', 3, 12)}</p><fieldset><legend>{say('no', 1, 3, 0)}</legend>{say('no', 1, 6, 0.2)}</fieldset></form>")
        if r.random() < 0.2:
            body.append(part("section", "reader", "".join(f"<p>{say('no', 3, 40)}</p>" for _ in range(r.randint(1, 4)))))
        article = "".join([f"<h1>{say('yes', 3, 12, 0.4)}</h1>", *body])
        article = f"<{r.choice(('article', 'article', 'main'))}>{article}</article></main>" if style == "semantic" else f"<div{named('text')}>{article}</div>"
        if r.random() < 0.3:
            article = part("main", "text", article)
        out = [part("header", "beside", f"<a href='/'>{say('no', 1, 3, 0)}</a>"), part(r.choice(("nav", "nav", "nav", "menu")), "around", f"<ul>{links(r.randint(3, 9))}</ul>")]
        for chance, made in (
            (0.6, lambda: f"<div{named('advert')}>{say('no', 3, 18, 0.6)}</div>"),  # noqa: B023
            (0.2, lambda: f"<search>{say('no', 1, 6, 0.2)}</search>" if style == "semantic" else ""),  # noqa: B023
            (0.3, lambda: f"<div{named('notice')}><p>{say('no', 5, 25, 0.6)}</p></div>"),  # noqa: B023
        ):
            if r.random() < chance:
                out.insert(r.randrange(len(out) + 1), made())
        out.append(article)
        if r.random() < 0.5:
            out.append(part("aside", "around", f"<h3>{say('no', 1, 3, 0)}</h3>" + (f"<ul>{links(r.randint(2, 6))}</ul>" if r.random() < 0.5 else "".join(f"<p><a href='/'>{say('no', 3, 12, 0.4)}</a></p>" for _ in range(r.randint(1, 4))))))
        if r.random() < 0.3:
            out.append(part("section", "reader", "".join(f"<p>{say('no', 3, 40)}</p>" for _ in range(r.randint(1, 5)))))
        out.append(part("footer", "around", r.choice((f"<p>no &copy; 20{r.randint(10, 25)} {say('', 1, 12)}</p>", f"<p>{say('no', 2, 14, 0.5)}</p>", f"no &copy; {word()}.example.com &middot; {say('', 3, 14)}"))))
        yield f"<html><body>{''.join(out)}</body></html>"


def fit(pages: int = 400, seed: int = 11, steps: int = 300) -> Model:
    """Logistic regression on the blocks of half the generated pages; the other half chooses the smoothness of the cut."""
    cut = [blocks(page) for page in generated(pages, seed)]
    truth = [[b.text.startswith("yes") for b in found] for found in cut]
    half = pages // 2
    x = np.zeros((sum(map(len, cut[:half])), len(FACTS)))
    for row, block in enumerate(itertools.chain.from_iterable(cut[:half])):
        for i, v in block.facts.items():
            x[row, i] = v
    y = np.array([*itertools.chain.from_iterable(truth[:half])], float)
    w = np.zeros(len(FACTS))
    for _ in range(steps):  # Newton's method with a ridge, which keeps rare facts modest
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        move = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.eye(len(w)), x.T @ (y - p) - w)
        w += move
        if abs(move).max() < 1e-6:
            break
    models = [Model([round(float(v), 6) for v in w], *smooth) for smooth in SMOOTH]
    wrong = [sum(map(bool.__ne__, itertools.chain.from_iterable(map(m.sides, cut[half:])), itertools.chain.from_iterable(truth[half:]))) for m in models]
    return models[min(range(len(models)), key=lambda i: (wrong[i], i))]


@functools.cache
def fitted() -> Model:
    return fit()


def min_cut(gain: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """For each node whether it is on the source's side of a minimum cut.

    gain: capacity from the source less that to the sink, what both have in common having flowed;
    edges: symmetric capacities between nodes.  Dinic's algorithm.
    """
    n = len(gain)
    if not any(g < 0 for g in gain):
        return [True] * n
    if not any(g > 0 for g in gain):
        return [False] * n
    s, t = n, n + 1
    to: list[int] = []
    room: list[float] = []
    near: list[list[int]] = [[] for _ in range(n + 2)]

    def arc(a: int, b: int, there: float, back: float) -> None:
        near[a].append(len(to))
        near[b].append(len(to) + 1)
        to.extend((b, a))
        room.extend((there, back))

    for v, g in enumerate(gain):
        if g > 0:
            arc(s, v, g, 0.0)
        elif g < 0:
            arc(v, t, -g, 0.0)
    for a, b, w in edges:
        arc(a, b, w, w)
    least = 1e-9
    while True:
        level = [-1] * (n + 2)
        level[s] = 0
        queue = deque([s])
        while queue:
            a = queue.popleft()
            for e in near[a]:
                if room[e] > least and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[t] < 0:
            return [x >= 0 for x in level[:n]]
        tried = [0] * (n + 2)
        path: list[int] = []
        a = s
        while True:
            if a == t:
                flow = min(room[e] for e in path)
                for e in path:
                    room[e] -= flow
                    room[e ^ 1] += flow
                k = next(i for i, e in enumerate(path) if room[e] <= least)
                a = to[path[k] ^ 1]
                del path[k:]
                continue
            while tried[a] < len(near[a]):
                e = near[a][tried[a]]
                if room[e] > least and level[to[e]] == level[a] + 1:
                    path.append(e)
                    a = to[e]
                    break
                tried[a] += 1
            else:
                if a == s:
                    break
                tried[to[path[-1] ^ 1]] += 1
                a = to[path.pop() ^ 1]


def main_text(page: str | None, model: Model | None = None) -> str:
    found = blocks(page or "")
    if found and _TAG.search(page) is None:
        return found[0].text
    side = (model or fitted()).sides(found)
    return " ".join(b.text for b, content in zip(found, side, strict=True) if content)


TEXT = "page_id long, url string, text string, n_chars long"


def extract(pages: DataFrame) -> DataFrame:
    """TEXT for every row of pages."""
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])
    model = fitted()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "html"):
                texts = [main_text(x, model) for x in part["html"]]
                yield record(schema, {"page_id": part["page_id"], "url": part["url"], "text": texts, "n_chars": [len(x) for x in texts]})

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(read, TEXT)
