"""Operator 6: main text of web pages by minimum-cut labelling.

A page is cut into blocks: the text between the starts and ends of block-level elements. Nodes of the graph are the
blocks and the regions, the elements whose name, class, id or role says what they hold. A linear classifier gives each
block a log-odds score from its own text alone: length, links, punctuation and element; each region has the classifier's
score of its hint for every block in it. A positive score is the capacity from the content terminal, a negative one that
to the boilerplate terminal. Smoothness edges join a block with its region, a region with the one around it, blocks that
follow each other, and blocks of the same parent. The minimum cut, found by max-flow, separates content from boilerplate:
a short line of an article, which looks like boilerplate by itself, stays with its region, and a long comment goes with
its own, while a block of links is cut off from the article.

A node whose score outweighs all its edges keeps its side in some minimum cut, so such nodes are settled first and leave
their edges to their neighbours' scores; blocking flows in level graphs run over what remains.

Defined results: null and empty pages, and pages without content, give "". Character references are decoded, white
space in a block becomes one space, blocks are joined by one line end in page order, and nothing else is dropped.
Unclosed and unmatched tags are closed or ignored as browsers do, in time linear in the page; what follows a ``<`` and a
letter without any ``>`` after it is dropped, as it is a tag that the page's end cuts off. Repeated rows and other columns
stay as they are.
"""

from __future__ import annotations

import re
from collections import Counter, deque
from collections.abc import Callable
from html import unescape

from pyspark.sql import DataFrame

from .common import fresh_name, struct_udf, with_struct

BLOCK = frozenset("address article aside blockquote body button center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td template tfoot th thead tr ul noscript svg math object audio video canvas map".split())
RAW = frozenset("script style title textarea iframe noembed noframes xmp plaintext".split())
NO_TEXT = frozenset("head template svg math select option optgroup button object audio video canvas map noscript menu".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
CLOSES_P = BLOCK - {"button", "option", "optgroup", "object", "audio", "video", "canvas", "map", "noscript", "svg", "math", "template"}
#: Tags that an opening tag closes, each nearer than an element of SCOPE.
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = {"li": {"ul", "ol", "menu", "dir"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table", "tbody", "thead", "tfoot"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select", "optgroup"}}

#: Words of classes, ids and roles that tell what an element is for.
AWAY = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice alert popup modal overlay sidebar side aside menu nav navbar navigation breadcrumb breadcrumbs pagination pager footer header masthead topbar comment comments disqus discussion reply replies respond reader share sharing social follow related recommended recommendations widget newsletter subscribe subscription signup login search toolbar skip copyright legal disclaimer tags trending contentinfo complementary dialog feedback toc".split())
#: Of these, words that don't weigh against a word for content beside them, as in post-header.
SOFT = frozenset("header side reader follow tags toc search".split())
#: Words that say an element only lies beside, or goes without, what its other words name.
WITHOUT = frozenset("with has no free".split())
TOWARD = frozenset("article content main post entry story text body prose maincontent articlebody".split())
BOILERPLATE = frozenset(("nav", "footer", "aside", "form", "fieldset", "dialog"))

#: Elements behind which an open p is not closed.
P_ENDS = frozenset(("td", "th", "button", "object"))

#: Scores of a region's hint for each block in it (no block's own score is above 2.6), and capacities of the edges to its blocks.
HINTS = {"article": 2.5, "toward": 2.2, "away": -4.0}
TO_BLOCK = {"article": 2.5, "toward": 2.2, "away": 5.0}
START, PER_WORD, MOST_WORDS, PROSE, PROSE_TAG, LINKS = -1.6, 1 / 15, 45, 0.6, 0.6, -6.0
NEXT, SAME_PARENT, NEXT_REGION = 0.5, 0.35, 0.125

name_at = re.compile(r"/?([a-zA-Z][^\s/>]*)").match
plain_part = re.compile(r"[^>=]*").match
quote_at = re.compile(r"=\s*([\"'])").match
attribute = re.compile(r"([a-zA-Z][\w:.-]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?").findall
split_name = re.compile(r"[A-Z]?[a-z]+|[A-Z]+").findall


class Region:
    """An element that says what it holds; ``count`` is its blocks."""

    __slots__ = ("hint", "parent", "count", "node")

    def __init__(self, hint: str, parent: Region | None):
        self.hint, self.parent, self.count, self.node = hint, parent, 0, -1


class Element:
    __slots__ = ("tag", "region", "silent", "parent", "p", "near")

    def __init__(self, tag: str, raw: str, parent: Element | None):
        self.tag, self.parent = tag, parent
        self.silent = tag in NO_TEXT or (parent is not None and parent.silent)
        #: The open p that a new block closes, and for each key of SAME the nearest element that it closes or that stops it.
        self.p = self if tag == "p" else None if parent is None or tag in P_ENDS else parent.p
        self.near: dict[str, Element] = {} if parent is None else parent.near
        if tag in WATCHED:
            self.near = {k: self if tag in SAME[k] or tag in SCOPE[k] else e for k, e in (dict.fromkeys(SAME) | self.near).items()}
        self.region = self.opened(raw, None if parent is None else parent.region)

    def opened(self, raw: str, around: Region | None) -> Region | None:
        """The region that the element is in, a new one if it says what it holds. What lies in boilerplate is boilerplate."""
        tag, names, hidden = self.tag, set(), False
        if raw and "=" in raw or "hidden" in raw:
            for key, a, b, c in attribute(raw):
                key = key.lower()
                if key in ("class", "id", "role"):
                    names.update(w.lower() for w in split_name(unescape(a or b or c)))
                elif key == "hidden" or (key == "style" and "display:none" in (a or b or c).replace(" ", "").lower()):
                    hidden = True
        away = tag not in ("body", "html") and not names & WITHOUT and bool(names & (AWAY - SOFT) or names & AWAY and not names & TOWARD)
        if tag in ("article", "main"):
            away = bool(names & {"comment", "comments", "reply", "ad", "ads", "sponsored", "promo", "related"})
        article = tag in ("article", "main") or "main" in names and "role" in raw
        if around is not None and around.hint == "away":
            framed = article and not away and self.parent is not None and self.parent.tag == "form" and self.parent.region is around and (around.parent is None or around.parent.hint == "toward")
            return Region("article", around.parent) if framed else around  # a form around the article
        within = around is not None and around.hint == "article"
        if away or hidden or tag in BOILERPLATE or tag == "header" and not within:
            return Region("away", around)
        if article and not within:
            return Region("article", around)
        if names & TOWARD and not names & AWAY and around is None:
            return Region("toward", around)
        return around


WATCHED = frozenset().union(*SAME.values(), *SCOPE.values())
Block = tuple[str, Element, float]


class Reader:
    """Cuts a page into blocks in one pass; the open elements are the chain of parents from ``here``."""

    def __init__(self, html: str):
        self.html, self.out, self.parts = html, [], []
        self.here, self.open = Element("html", "", None), Counter()
        self.linked = self.total = self.in_link = 0
        self.last = {c: html.rfind(c) for c in "\"'>"}
        self.cut_off = False

    def flush(self) -> None:
        if self.parts:
            text = " ".join(unescape("".join(self.parts)).split())
            if text and not self.here.silent:
                self.out.append((text, self.here, self.linked / max(1, self.total)))
            self.parts.clear()
        self.linked = self.total = 0

    def add(self, text: str) -> None:
        if text:
            self.parts.append(text)
            n = len(text) - text.count(" ")
            self.total += n
            if self.in_link:
                self.linked += n

    def close_to(self, e: Element) -> None:
        """Closes the open elements up to and with ``e``."""
        while self.here is not e.parent:
            self.open[kind(self.here.tag)] -= 1
            self.here = self.here.parent

    def tag_end(self, at: int) -> int:
        """Where a tag ends whose attributes begin at ``at``, its ``>`` excluded; -1 if it doesn't. Quotes count after ``=``."""
        html, start = self.html, at
        while not self.cut_off:
            at = plain_part(html, at).end()
            if at >= len(html):
                break
            if html[at] == ">":
                return at
            quote = quote_at(html, at)
            if quote is None:
                at += 1
            elif self.last[quote[1]] < quote.end():
                break
            else:
                at = html.index(quote[1], quote.end()) + 1
        self.cut_off = True  # a quote stays open: from here on quotes don't count
        return html.find(">", start) if start <= self.last[">"] else -1

    def opening(self, tag: str, raw: str) -> None:
        if tag == "a":
            self.in_link = 1
        elif tag == "br":
            self.add(" ")
        elif tag in BLOCK:
            self.flush()
            self.in_link = 0
            if tag in CLOSES_P and self.here.p is not None:
                self.close_to(self.here.p)
            if tag == "body":
                while self.here.tag == "head":
                    self.close_to(self.here)
            if tag in SAME and (e := self.here.near.get(tag)) is not None and e.tag in SAME[tag]:
                while e.parent is not None and e.parent.tag in SAME[tag]:
                    e = e.parent
                self.close_to(e)
            if tag not in VOID and tag != "html":
                self.here = Element(tag, raw, self.here)
                self.open[kind(tag)] += 1

    def closing(self, tag: str) -> None:
        if tag == "a":
            self.in_link = 0
        elif tag == "br":
            self.add(" ")
        elif tag == "p" and self.here.tag != "p":
            self.flush()
        elif tag in BLOCK and self.open[kind(tag)] > 0:
            self.flush()
            while kind(self.here.tag) != kind(tag):
                self.close_to(self.here)
            self.close_to(self.here)
            self.in_link = 0

    def read(self) -> list[Block]:
        html, at = self.html, 0
        while (start := html.find("<", at)) >= 0:
            name = name_at(html, start + 1)
            if name is None:
                if html.startswith("<!--", start):
                    end = -1 if html.startswith((">", "->"), start + 4) else comment_end(html, start + 4)
                    end = html.index(">", start) + 1 if end == -1 else end
                elif start + 1 < len(html) and html[start + 1] in "!?/":
                    end = html.find(">", start) + 1 or len(html)
                else:
                    self.add(html[at : start + 1])
                    at = start + 1
                    continue
                self.add(html[at:start])
                at = end
                continue
            self.add(html[at:start])
            end = self.tag_end(name.end())
            if end < 0:
                at = len(html)
                break
            tag, at = name[1].lower(), end + 1
            if html[start + 1] == "/":
                self.closing(tag)
            elif tag in RAW:
                found = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(html, at)
                close = -1 if found is None else html.find(">", found.end())
                at = len(html) if close < 0 else close + 1
            else:
                self.opening(tag, html[name.end() : end])
        self.add(html[at:])
        self.flush()
        return self.out


def kind(tag: str) -> str:
    """Headings close each other."""
    return "h1" if tag in HEADINGS else tag


def comment_end(html: str, at: int) -> int:
    m = comment_mark(html, at)
    return len(html) if m is None else m.end()


comment_mark = re.compile(r"--!?>").search


def blocks(html: str) -> list[Block]:
    """(text, element, share of its characters that are links) of each block, in page order."""
    return Reader(html).read()


def score(text: str, e: Element, links: float) -> float:
    """Of a block by itself."""
    words = text.count(" ") + 1
    s = START + min(words, MOST_WORDS) * PER_WORD * (1 - links)
    if e.tag in ("p", "pre", "blockquote") or e.tag in HEADINGS:
        s += PROSE_TAG
    if words > 3 and text[-1] in ".!?:;\"')»”’…":
        s += PROSE
    if links > 0.3:
        s += LINKS * links
    return s


def min_cut(scores: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Whether each node is on the content side of a minimum cut; a node that could be on either is."""
    n = len(scores)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for i, j, w in edges:
        near[i][j] = near[i].get(j, 0.0) + w
        near[j][i] = near[j].get(i, 0.0) + w
    s, held = list(scores), [sum(x.values()) for x in near]
    side: list[bool | None] = [None] * n
    queue = deque(range(n))
    while queue:
        i = queue.popleft()
        if side[i] is None and abs(s[i]) >= held[i] - 1e-12:
            side[i] = s[i] >= 0
            for j, w in near[i].items():
                del near[j][i]
                held[j] -= w
                s[j] += w if side[i] else -w
                queue.append(j)
            near[i].clear()
    rest = [i for i in range(n) if side[i] is None]
    if rest:
        lost = boilerplate_side(rest, s, near)
        for i in rest:
            side[i] = i not in lost
    return [bool(x) for x in side]


def boilerplate_side(rest: list[int], s: list[float], near: list[dict[int, float]]) -> set[int]:
    """Nodes from which the boilerplate terminal can be reached after a maximum flow (level graphs and blocking flows)."""
    source, sink = -1, -2
    flow: dict[int, dict[int, float]] = {i: dict(near[i]) for i in rest}
    flow[source], flow[sink] = {i: s[i] for i in rest if s[i] > 0}, {}
    for i in rest:
        if s[i] < 0:
            flow[i][sink] = -s[i]
            flow[sink][i] = 0.0
        flow[i][source] = 0.0
    while True:
        level, queue = {source: 0}, deque([source])
        while queue:
            i = queue.popleft()
            for j, c in flow[i].items():
                if c > 1e-9 and j not in level:
                    level[j] = level[i] + 1
                    queue.append(j)
        if sink not in level:
            break
        onward = {i: [j for j in flow[i] if level.get(j) == level[i] + 1] for i in level}
        dead: set[int] = set()
        path = [source]
        while path:
            i = path[-1]
            if i == sink:
                steps = list(zip(path, path[1:]))
                least = min(flow[a][b] for a, b in steps)
                for a, b in steps:
                    flow[a][b] -= least
                    flow[b][a] = flow[b].get(a, 0.0) + least
                path = path[: next(k for k, (a, b) in enumerate(steps) if flow[a][b] <= 1e-9) + 1]
                continue
            arcs = onward[i]
            while arcs and (flow[i][arcs[-1]] <= 1e-9 or arcs[-1] in dead):
                arcs.pop()
            if arcs:
                path.append(arcs[-1])
            else:
                dead.add(i)
                path.pop()
    back: dict[int, list[int]] = {}
    for i, to in flow.items():
        for j, c in to.items():
            if c > 1e-9:
                back.setdefault(j, []).append(i)
    lost, queue = {sink}, deque([sink])
    while queue:
        for i in back.get(queue.popleft(), ()):
            if i not in lost:
                lost.add(i)
                queue.append(i)
    return lost


def graph(found: list[Block]) -> tuple[list[float], list[tuple[int, int, float]]]:
    """Scores and edges: the blocks first, then the regions."""
    scores, edges, last = [score(*b) for b in found], [], {}
    regions: list[Region] = []
    for i, (_, e, _) in enumerate(found):
        r = e.region
        if r is not None:
            if not r.count:
                regions.append(r)
            r.count += 1
        if i:
            edges.append((i - 1, i, NEXT if found[i - 1][1].region is r else NEXT_REGION))
        if id(e.parent) in last:
            edges.append((last[id(e.parent)], i, SAME_PARENT))
        last[id(e.parent)] = i
    for k, r in enumerate(regions):
        r.node = len(found) + k
        scores.append(HINTS[r.hint] * r.count)
    edges += [(i, b[1].region.node, TO_BLOCK[b[1].region.hint]) for i, b in enumerate(found) if b[1].region is not None]
    edges += [(r.node, r.parent.node, NEXT_REGION) for r in regions if r.parent is not None and r.parent.node >= 0]
    return scores, edges


def main_text(html: str | None) -> str:
    found = blocks(html or "")
    keep = min_cut(*graph(found))
    return "\n".join([text for (text, _, _), k in zip(found, keep) if k])


def with_main_text(pages: DataFrame, html: str = "html") -> tuple[DataFrame, str]:
    """``pages`` with a struct of text and n_chars; also the struct's name. Other columns stay as they are."""

    def setup() -> Callable:
        def one(page: str | None) -> tuple[str, int]:
            text = main_text(page)
            return text, len(text)

        return one

    name = fresh_name(pages, "main")
    return with_struct(pages, struct_udf(setup, [("text", "string"), ("n_chars", "long")]), html, name), name
