"""Main text of web pages by minimum-cut labelling.

A page becomes text blocks in a tree of elements.  A logistic classifier,
trained here on generated pages with known labels, gives each block its log
odds of being content; they are the capacities to the source and the sink.
Neighbouring blocks, and blocks and elements that stand close in the tree, are
joined by smoothness edges.  The minimum cut, found by maximum flow, separates
content from boilerplate.

Defined results: a null or empty page has the empty text; unclosed or unknown
elements close where the next block begins or ends, but an unclosed script or
style takes the rest, as in a browser; a head has no text of its own and ends
at the first element or text that cannot stand in it; repeated rows give repeated rows;
other columns are ignored.
"""

from __future__ import annotations

import math
import random
import re
from collections import Counter, deque
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

COMMENT = r"<!--(?:-?>|.*?(?:--!?>|\Z))"
TOKEN = re.compile(COMMENT + r"|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:=\s*+(?:\"[^\"]*+\"|'[^']*+')|[^>])*+)>|[^<]++|<", re.S)
#: Behind the last >, where no tag can end.
REST = re.compile(COMMENT + r"|()()()[^<]++|<", re.S)
ATTRIBUTE = re.compile(r"(?:class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title svg iframe object select button canvas audio video".split())
#: Their content is characters up to the next end tag; the others hold elements.
CHARACTERS = frozenset("script style textarea title".split())
#: A second one ends the first.
ALONE = frozenset("noscript iframe select button".split())
END_OF = {x: re.compile(rf"</{x}(?=[\s/>])[^>]*>?", re.I) for x in CHARACTERS}
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: An opening element ends these open elements, up to the next element of the second list.
ENDS = {
    **{x: ({"p"}, frozenset("article aside body div section td th li main footer header nav form blockquote".split())) for x in BLOCK},
    "li": ({"li", "p"}, frozenset(("ul", "ol", "menu"))),
    "dt": ({"dt", "dd", "p"}, frozenset(("dl",))),
    "dd": ({"dt", "dd", "p"}, frozenset(("dl",))),
    "tr": ({"tr", "td", "th", "p"}, frozenset(("table",))),
    "td": ({"td", "th", "p"}, frozenset(("tr", "table"))),
    "th": ({"td", "th", "p"}, frozenset(("tr", "table"))),
}
APART = frozenset("nav footer aside form menu dialog fieldset".split())
JUNK = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|banner|promo\w*|sponsor\w*|nav\w*|menu\w*|side-?bar|footer|site-?header|masthead|top-?bar|comments?|comment-?\w+|respond|replies|disqus|cookies?|consent|gdpr|notices?|alert|related|recommend\w*|share|sharing|social|bread-?crumbs?|widget\w*|newsletter|subscribe|subscription|sign-?up|popup|pop-up|modal|overlay|login|search\w*|pagination|pager|tags?(?=$|\s)|meta|copyright|legal|disclaimer|skip\w*|toolbar|dialog|complementary|contentinfo|navigation)(?:$|[\s_-])",
    re.I,
)
MAIN = re.compile(r"(?:^|[\s_-])(?:article|content|entry|post|story|main|article-?body|post-?body|text|body|prose|markdown)(?:$|[\s_-])", re.I)


#: Of names that mean boilerplate, those of readers' comments.
TALK = re.compile(r"(?:^|[\s_-])(?:comments?|comment-?\w+|respond|replies|disqus)(?:$|[\s_-])", re.I)
#: Shares of a page's text from which an element with a heading or a name of content, or any form, holds the page itself.
HALF, NEARLY_ALL = 0.5, 0.8


class Element:
    __slots__ = ("apart", "hint", "inside", "junk", "main", "named", "parent", "size", "tag")

    def __init__(self, tag: str, parent: Element | None, attributes: str = ""):
        self.tag, self.parent = tag, parent
        names = " ".join(a or b or c for a, b, c in ATTRIBUTE.findall(attributes)) if "=" in attributes else ""
        self.inside = tag in ("article", "main") or bool(parent and parent.inside)
        self.apart = tag in APART or (tag == "header" and not self.inside)
        self.junk = bool(names and tag not in ("body", "html", "article", "main") and JUNK.search(names))
        self.hint = bool(names and MAIN.search(names))
        self.named = self.hint and not TALK.search(names)
        self.main = tag in ("h1", "article", "main")
        self.size = 0

    def settle(self, whole: int) -> None:
        """Take over what holds for the parent, once the text below is known.  An element that holds the page itself is no
        boilerplate, whatever its name, nor is a form around it."""
        up, share = self.parent, self.size / max(whole, 1)
        holds = share >= HALF and (self.main or self.named)
        self.junk = (self.junk and not holds) or bool(up and up.junk)
        self.apart = (self.apart and not (self.tag == "form" and (holds or share >= NEARLY_ALL))) or bool(up and up.apart)
        self.hint = (self.hint and not self.junk) or bool(up and up.hint and not self.junk)


class Block:
    __slots__ = ("element", "linked", "text")

    def __init__(self, element: Element, text: str, linked: int):
        self.element, self.text, self.linked = element, text, linked


def tokens_of(html: str) -> tuple[list[re.Match], dict[int, int]]:
    """Tokens in page order, and for each element of RAW with an end: its place and that of the first token behind it."""
    tokens: list[re.Match] = []
    ends: dict[int, int] = {}
    open_: list[tuple[str, int]] = []
    names: Counter[str] = Counter()
    unclosed: set[str] = set()
    at = 0

    def last(name):
        return next(i for i in range(len(open_) - 1, -1, -1) if open_[i][0] == name)

    last_end = html.rfind(">")
    while m := (TOKEN if at <= last_end else REST).match(html, at):
        tokens.append(m)
        at, here = m.end(), len(tokens) - 1
        name = m[2].lower() if m[2] else ""
        if name not in RAW:
            continue
        if name in CHARACTERS:
            if not m[1] and not m[3].endswith("/") and name not in unclosed:
                if end := END_OF[name].search(html, at):
                    at, ends[here] = end.end(), here + 1
                else:
                    unclosed.add(name)
                    if name in ("script", "style"):
                        at, ends[here] = len(html), here + 1
        elif m[1]:
            if names[name]:
                k = last(name)
                ends[open_[k][1]] = here + 1
                names.subtract(x for x, _ in open_[k:])
                del open_[k:]
        elif not m[3].endswith("/"):
            if name in ALONE and names[name]:
                del open_[last(name)]
                names[name] -= 1
            open_.append((name, here))
            names[name] += 1
    return tokens, ends


def blocks_of(html: str) -> list[Block]:
    """Text blocks in page order; white space is one space, references are decoded."""
    found: list[Block] = []
    root = Element("html", None)
    stack, parts, linked, in_link = [root], [], 0, 0
    made, depth = [root], Counter()  # elements in page order; how many of a tag are open

    def close_to(i: int) -> None:
        depth.subtract(e.tag for e in stack[i:])
        del stack[i:]

    def close_block():
        nonlocal parts, linked
        if parts:
            if text := " ".join("".join(parts).split()):
                found.append(Block(next(e for e in reversed(stack) if e.tag in BLOCK), text, min(linked, len(text))))
            parts, linked = [], 0

    tokens, ends_at = tokens_of(html)
    ahead, hidden = 0, False
    while ahead < len(tokens):
        m, here = tokens[ahead], ahead
        tag = m[2] and m[2].lower()
        ahead = ends_at.get(here, here + 1)
        if tag in BLOCK:  # ends an unclosed element of RAW
            hidden = False
        if not tag:
            if not hidden and (text := m[0])[:2] not in ("<!", "<?"):
                parts.append(text := unescape(text))
                linked += len(text) if in_link else 0
            continue
        if m[1]:
            if tag == "a":
                in_link = 0
            if tag in BLOCK:
                close_block()
                if depth[tag]:
                    close_to(next(i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag))
            continue
        if tag in RAW:
            if not m[3].endswith("/"):
                hidden = hidden or here not in ends_at
            parts.append(" ")
        elif tag in BLOCK:
            close_block()
            in_link = 0
            ends, stop = ENDS[tag]
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in stop:
                    break
                if stack[i].tag in ends:
                    close_to(i)
            if tag != "html":
                stack.append(Element(tag, stack[-1], m[3]))
                made.append(stack[-1])
                depth[tag] += 1
        elif tag == "a":
            in_link = 1
        elif tag in VOID:
            parts.append(" " if tag in ("br", "hr", "img", "wbr")[:3] else "")
            if tag == "hr":
                close_block()
    close_block()
    for b in found:
        b.element.size += len(b.text) - b.linked
    for e in reversed(made):
        if e.parent:
            e.parent.size += e.size
            e.parent.main |= e.main and not e.junk
    for e in made:
        e.settle(root.size)
    return found


FEATURES = 13


def features(b: Block) -> list[float]:
    e, n = b.element, len(b.text)
    words = b.text.count(" ") + 1
    density = b.linked / max(n, 1)
    return [1.0, e.inside, e.apart, e.junk, e.hint, density, e.tag in ("p", "blockquote", "pre"), e.tag in ("h1", "h2", "h3", "h4"), e.tag in ("li", "td", "th", "dd"), math.log1p(words) / 4, b.text[-1] in ".!?…:;\"”»", e.inside and not e.junk and not e.apart, "©" in b.text or "(c)" in b.text]


def sample_page(rng: random.Random) -> tuple[str, list[int]]:
    """A page of one of several layouts, and the label of each of its blocks."""
    labels: list[int] = []

    def say(lo, hi):
        return " ".join("".join(rng.choice("aeiourstln") for _ in range(rng.randint(2, 9))) for _ in range(rng.randint(lo, hi))) + rng.choice([".", ".", ".", "?", ""])

    def put(tag, text, label, attr=""):
        labels.append(label)
        return f"<{tag}{attr}>{text}" + (f"</{tag}>" if tag != "p" or rng.random() < 0.8 else "")

    def links(n):
        return "<ul>" + "".join(put("li", f"<a href=#>{say(1, 3)}</a>", 0) for _ in range(n)) + "</ul>"

    def junk():
        name = rng.choice(["ad", "sidebar", "comments", "cookie-notice", "related", "newsletter", "banner", "promo", "share", "widget", "breadcrumb", "alert"])
        inner = "".join(put("p", say(3, 40), 0) for _ in range(rng.randint(1, 4)))
        return f'<{(t := rng.choice(["div", "section"]))} class="{name}">{inner}</{t}>'

    def apart():
        tag = rng.choice(["aside", "form", "nav", "footer", "header"])
        return f"<{tag}>" + "".join(put("p", say(2, 25), 0) for _ in range(rng.randint(1, 3))) + f"</{tag}>"

    before = [rng.choice([junk, apart, lambda: f"<nav>{links(rng.randint(2, 7))}</nav>"])() for _ in range(rng.randint(0, 3))]
    body = [put(rng.choice(["h1", "h2"]), say(2, 9), 1)] if rng.random() < 0.9 else []
    for _ in range(rng.randint(1, 9)):
        u = rng.random()
        if u < 0.75:
            body.append(put("p", say(1, 70), 1))
        elif u < 0.83:
            body.append(put("h2", say(1, 6), 1))
        elif u < 0.9:
            body.append("<ul>" + "".join(put("li", say(1, 15), 1) for _ in range(rng.randint(1, 4))) + "</ul>")
        else:
            body.append(rng.choice([junk, apart])())
    shell = rng.choice(["<article>{}</article>", "<article>{}</article>", "<main>{}</main>", '<div class="content">{}</div>', '<div id="main-text">{}</div>', "<div>{}</div>"])
    after = [rng.choice([junk, apart])() for _ in range(rng.randint(0, 3))] + [f"<footer>{put('p', '&copy; ' + say(1, 12), 0)}</footer>"]
    return f"<html><body>{''.join(before)}{shell.format(''.join(body))}{''.join(after)}</body></html>", labels


@lru_cache(1)
def trained(pages: int = 400, steps: int = 400) -> tuple[float, ...]:
    """Weights fitted to `pages` generated pages; the same on every machine."""
    rng = random.Random(17)
    x, y = [], []
    for _ in range(pages):
        html, labels = sample_page(rng)
        found = blocks_of(html)
        if len(found) == len(labels):
            x += map(features, found)
            y += labels
    x, y = np.array(x, float), np.array(y, float)
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-x @ w))
        w -= np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + 0.5 * np.eye(len(w)), x.T @ (p - y) + 0.5 * w) if steps < 40 else 2.0 * (x.T @ (p - y) / len(y) + 1e-4 * w)
    return tuple(np.round(w, 6).tolist())


def minimum_cut(prefer: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """Which nodes stay with the source.

    prefer: capacity to the source if positive, to the sink if negative.
    edges: node, node, capacity in both directions.  A node whose preference is
    no less than all its edges together takes its own side in some minimum cut;
    such nodes are settled first, and the flow runs over the rest.
    """
    n = len(prefer)
    prefer = list(prefer)
    near: list[dict[int, int]] = [{} for _ in range(n)]
    for a, b, c in edges:
        if a != b and c > 0:
            near[a][b] = near[a].get(b, 0) + c
            near[b][a] = near[b].get(a, 0) + c
    side: list[bool | None] = [None] * n
    total = [sum(x.values()) for x in near]
    queue = deque(range(n))
    while queue:
        v = queue.popleft()
        if side[v] is not None or abs(prefer[v]) < total[v]:
            continue
        side[v] = s = prefer[v] > 0
        for u, c in near[v].items():
            if side[u] is None:
                prefer[u] += c if s else -c
                total[u] -= c
                queue.append(u)
    open_ = [v for v in range(n) if side[v] is None]
    if open_:
        for v, s in zip(open_, _flow(open_, prefer, near, side), strict=True):
            side[v] = s
    return [bool(s) for s in side]


def _flow(open_: list[int], prefer: list[int], near: list[dict[int, int]], side: list) -> list[bool]:
    """Maximum flow by layered blocking flows over the unsettled nodes."""
    at = {v: i for i, v in enumerate(open_)}
    n = len(open_)
    source, sink = n, n + 1
    to, cap, head = [], [], [[] for _ in range(n + 2)]

    def arc(a, b, c, back):
        head[a].append(len(to))
        to.append(b)
        cap.append(c)
        head[b].append(len(to))
        to.append(a)
        cap.append(back)

    for v, i in at.items():
        if prefer[v] > 0:
            arc(source, i, prefer[v], 0)
        elif prefer[v] < 0:
            arc(i, sink, -prefer[v], 0)
        for u, c in near[v].items():
            if u > v and side[u] is None:
                arc(i, at[u], c, c)
    while True:
        level = [-1] * (n + 2)
        level[source], queue = 0, deque([source])
        while queue:
            v = queue.popleft()
            for e in head[v]:
                if cap[e] > 0 and level[to[e]] < 0:
                    level[to[e]] = level[v] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [level[i] >= 0 for i in range(n)]
        place, path, v = [0] * (n + 2), [], source
        while True:
            if v == sink:
                least = min(cap[e] for e in path)
                for e in path:
                    cap[e] -= least
                    cap[e ^ 1] += least
                path, v = [], source
            while place[v] < len(head[v]) and not (cap[e := head[v][place[v]]] > 0 and level[to[e]] == level[v] + 1):
                place[v] += 1
            if place[v] < len(head[v]):
                path.append(e)
                v = to[e]
            elif v == source:
                break
            else:
                e = path.pop()
                v = to[e ^ 1]
                place[v] += 1


#: Smoothness: neighbours in one element, neighbours across elements, a block and its element, an element and its parent.
SAME, ACROSS, OWN, UP = 0.5, 0.1, 0.6, 0.3


def content_blocks(html: str, weights: tuple[float, ...]) -> list[Block]:
    found = blocks_of(html)
    prefer = [round(1000 * sum(map(float.__mul__, weights, map(float, features(b))))) for b in found]
    edges: list[tuple[int, int, int]] = []
    hubs: dict[int, int] = {}
    for i, b in enumerate(found):
        parent = b.element.parent or b.element
        if i:
            before = found[i - 1].element
            edges.append((i - 1, i, round(1000 * (SAME if (before.parent or before) is parent else ACROSS))))
        node, child, weight = parent, i, OWN
        for _ in range(3):
            fresh = id(node) not in hubs
            if fresh:
                hubs[id(node)] = len(prefer)
                prefer.append(0)
            edges.append((child, hubs[id(node)], round(1000 * weight)))
            if not fresh or node.parent is None:
                break
            child, node, weight = hubs[id(node)], node.parent, UP
    kept = minimum_cut(prefer, edges)
    return [b for b, k in zip(found, kept, strict=False) if k]


def main_text(html: str | None, weights: tuple[float, ...]) -> str:
    return "\n".join(b.text for b in content_blocks(html, weights)) if html else ""


def extract_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of pages (page_id, url, html)."""
    weights = trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h, weights) for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.selectExpr("cast(page_id as long) page_id", "cast(url as string) url", "cast(html as string) html")
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
