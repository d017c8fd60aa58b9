"""Main text of HTML pages by a minimum cut over their blocks.

A block is a run of text between block-level tags.  What a classifier says about a block becomes its
capacities to the two terminals (content, boilerplate); neighbours in page order and blocks under one
parent are tied by smoothness edges.  The minimum cut is the labelling of least total cost.
"""

from __future__ import annotations

import html as entities
import re
from collections import deque
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)"
    r"(?:(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*?)(?:>|\Z)|(?P<broken>[^>]*)(?:>|\Z))|</[^>]*(?:>|\Z)", re.S)
MARKS = re.compile(r"""(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
RAW = frozenset("script style template noscript svg iframe textarea title object math canvas audio video".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small "
                   "span strike strong sub sup time tt u var wbr".split())
#: An opening tag that ends an open element of these kinds.
CLOSES = {t: frozenset(["p"]) for t in ("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 "
                                        "header hr main nav ol p pre section table ul").split()}
CLOSES |= {"li": frozenset(["li", "p"]), "dt": frozenset(["dt", "dd", "p"]), "dd": frozenset(["dt", "dd", "p"]),
           "tr": frozenset(["tr", "td", "th", "p"]), "td": frozenset(["td", "th", "p"]), "th": frozenset(["td", "th", "p"]),
           "option": frozenset(["option"])}
#: An element that a tag doesn't look past when it closes others.
FENCES = frozenset("article aside body div fieldset footer form header main nav ol section table ul".split())

BOILERPLATE_TAGS = frozenset("nav header footer aside form button select dialog menu fieldset".split())
CONTENT_TAGS = frozenset(["article", "main"])
BOILERPLATE_MARKS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies "
    "copyright disqus footer header login masthead menu menubar modal nav navbar navigation newsletter notice notices notification "
    "overlay pager pagination popup promo promoted promotion recommended related reply replies respond share sharing "
    "sidebar signup sitemap skip social sponsor sponsored subscribe toolbar widget widgets alert complementary "
    "contentinfo search hidden discussion reader".split())
CONTENT_MARKS = frozenset("article content entry main post story body text".split())

#: Costs of the classifier and of the smoothness edges.
STRUCTURE, CONTAINER, PROSE, LINKS, SHORT = 8.0, 4.0, 1.5, 2.5, 0.4
NEXT, SIBLING, FAR = 0.8, 0.6, 0.1


@dataclass
class Block:
    text: str
    depth: int  # open elements that aren't inline
    shared: int  # of them, those that the block before was in too
    parent: int  # the element around the innermost of them
    boilerplate: int  # open elements that speak against it
    content: int  # open elements that speak for it
    heading: bool
    linked: int  # characters inside links


@dataclass(frozen=True)
class Open:
    """An open element, with what it and those around it say about a block in it."""
    tag: str
    element: int = 0  # the innermost that isn't inline
    parent: int = 0
    depth: int = 0
    against: int = 0
    firm: int = 0  # as far as it also speaks against an article inside
    content: int = 0
    article: bool = False
    heading: bool = False


def _marks(attrs: str) -> tuple[set[str], set[str], bool]:
    """Words of classes, ids and roles; those that begin one (``sidebar-left``, not ``with-sidebar``); hidden."""
    words: set[str] = set()
    first: set[str] = set()
    hidden = False
    for m in MARKS.finditer(attrs):
        name, value = m[1].lower(), next((v for v in m.groups()[1:] if v is not None), "")
        if name in ("class", "id", "role"):
            for one in value.lower().split():
                parts = re.split(r"[^a-z]+", one)
                words.update(parts)
                first.add(parts[0])
        elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (
                name == "style" and re.search(r"display\s*:\s*none", value, re.I)):
            hidden = True
    return words, first, hidden


def _inside(outer: Open, tag: str, attrs: str, number: int) -> Open:
    """The element that opens within ``outer``.

    A mark inside a longer class name on a wrapper (``with-sidebar``) says nothing about an article or main element in it.
    """
    words, first, hidden = _marks(attrs) if attrs else (set(), set(), False)
    structure = tag in BOILERPLATE_TAGS and not (tag == "header" and outer.article)
    own = bool(words & BOILERPLATE_MARKS) or hidden or structure
    firm = bool(first & BOILERPLATE_MARKS) or hidden or structure
    if tag in ("html", "body", *CONTENT_TAGS):
        own = firm = hidden or bool(words & {"comment", "comments", "reply", "related", "ad", "sponsored", "promo"})
    speaks_for = not own and (tag in CONTENT_TAGS or bool(words & CONTENT_MARKS) and tag in ("div", "section", "td"))
    line = tag in INLINE
    return Open(tag, outer.element if line else number, outer.parent if line else outer.element, outer.depth + (not line),
                (outer.firm if tag in CONTENT_TAGS else outer.against) + own, outer.firm + firm,
                0 if own else outer.content + speaks_for,  # containers outside it say nothing
                outer.article or tag in CONTENT_TAGS, outer.heading or tag in ("h1", "h2", "h3", "h4", "h5", "h6"))


def blocks(page: str) -> list[Block]:
    """Blocks with text, in page order; raw elements, comments and what is in the head are left out."""
    out: list[Block] = []
    stack = [Open("")]
    opened: dict[str, int] = {}
    parts: list[str] = []
    linked, links, number, at, head, low = 0, 0, 0, 0, False, 0

    def flush() -> None:
        nonlocal linked, low
        text = " ".join("".join(parts).split())
        if text and not head:
            top = stack[-1]
            out.append(Block(text, top.depth, min(low, top.depth), top.parent, top.against, top.content, top.heading, linked))
            low = top.depth
        parts.clear()
        linked = 0

    def leave(k: int) -> None:
        """End the open elements from the ``k``-th on."""
        nonlocal links, low
        for s in stack[k:]:
            opened[s.tag] -= 1
            links -= s.tag == "a"
        del stack[k:]
        low = min(low, stack[-1].depth)

    def add(text: str) -> None:
        nonlocal linked
        text = entities.unescape(text)
        parts.append(text)
        if links:
            linked += len(text.strip())

    while at < len(page):
        m = TOKEN.search(page, at)
        if m is None:
            add(page[at:])
            break
        if m.start() > at:
            add(page[at:m.start()])
        at = m.end()
        tag, attrs = (m["tag"] or "").lower(), m["attrs"] or m["broken"] or ""
        if not tag:
            continue
        if m["end"]:
            if tag == "head":
                flush()
                parts.clear()
                head = False
            if tag not in INLINE:
                flush()
            for k in range(len(stack) - 1, 0, -1) if opened.get(tag) else ():
                if stack[k].tag == tag:
                    leave(k)
                    break
                if stack[k].tag in FENCES and tag in INLINE:
                    break
            continue
        if tag in RAW:
            if not attrs.rstrip().endswith("/") or tag in ("script", "style", "title", "textarea"):
                end = re.compile(rf"</{tag}[\s/>]", re.I).search(page, at)
                close = page.find(">", end.end() - 1) if end else -1
                at = close + 1 if close >= 0 else len(page)
            continue
        if tag == "head":
            head = True
        elif tag == "body" or (head and tag not in ("meta", "link", "base")):
            head = False
            parts.clear()
        if tag == "br":
            parts.append(" ")
            continue
        if tag not in INLINE:
            flush()
            closes = CLOSES.get(tag, ())
            for k in range(len(stack) - 1, 0, -1) if any(opened.get(t) for t in closes) else ():
                if stack[k].tag in closes:
                    leave(k)
                    break
                if stack[k].tag in FENCES:
                    break
        if tag in VOID or attrs.rstrip().endswith("/"):
            continue
        number += 1
        stack.append(_inside(stack[-1], tag, attrs, number))
        opened[tag] = opened.get(tag, 0) + 1
        links += tag == "a"
    flush()
    return out


def costs(b: Block) -> tuple[float, float]:
    """What it costs to call the block content, and to call it boilerplate."""
    n = len(b.text)
    as_content = STRUCTURE * b.boilerplate
    as_boilerplate = CONTAINER * min(b.content, 2)
    if b.linked > 0.5 * n:
        as_content += LINKS
    if n >= 80 or (n >= 25 and b.text[-1] in ".!?:;…»\"'”)"):
        as_boilerplate += PROSE
    elif b.heading:
        as_boilerplate += SHORT
    else:
        as_content += SHORT
    return as_content, as_boilerplate


def edges(rows: list[Block]) -> list[tuple[int, int, float]]:
    """Smoothness: neighbours, the more the deeper they share their ancestors; and the last block under the same parent."""
    out: list[tuple[int, int, float]] = []
    last: dict[int, int] = {}
    for i, b in enumerate(rows):
        if i:
            a = rows[i - 1]
            near = b.shared / max(a.depth, b.depth, 1)
            same = a.boilerplate == b.boilerplate and a.content == b.content
            out.append((i - 1, i, (NEXT if same else FAR) * near))
        if last.get(b.parent, i - 1) != i - 1:
            out.append((last[b.parent], i, SIBLING))
        last[b.parent] = i
    return out


def minimum_cut(terminal: list[tuple[float, float]], ties: list[tuple[int, int, float]]) -> list[bool]:
    """Labels of least cost: ``terminal[i]`` is the cost of true and of false, a tie costs if its ends differ.

    What a block can pay to both terminals at once is taken off first; the rest flows by shortest
    augmenting paths in layers.  Ties fall to true only where the flow reaches from the source.
    """
    n = len(terminal)
    source, sink = n, n + 1
    to: list[int] = []
    room: list[float] = []
    at: list[list[int]] = [[] for _ in range(n + 2)]

    def edge(a: int, b: int, forth: float, back: float) -> None:
        at[a].append(len(to))
        to.append(b)
        room.append(forth)
        at[b].append(len(to))
        to.append(a)
        room.append(back)

    for i, (yes, no) in enumerate(terminal):
        both = min(yes, no)
        if no > both:
            edge(source, i, no - both, 0.0)
        elif yes > both:
            edge(i, sink, yes - both, 0.0)
    for a, b, w in ties:
        if w > 0:
            edge(a, b, w, w)
    tiny = 1e-9
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            v = queue.popleft()
            for e in at[v]:
                if room[e] > tiny and level[to[e]] < 0:
                    level[to[e]] = level[v] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [level[i] >= 0 for i in range(n)]
        done = [0] * (n + 2)
        path: list[int] = []
        v = source
        while True:  # a blocking flow without recursion
            if v == sink:
                push = min(room[e] for e in path)
                for e in path:
                    room[e] -= push
                    room[e ^ 1] += push
                k = next(k for k, e in enumerate(path) if room[e] <= tiny)
                v = to[path[k] ^ 1]
                del path[k:]
                continue
            while done[v] < len(at[v]):
                e = at[v][done[v]]
                if room[e] > tiny and level[to[e]] == level[v] + 1:
                    break
                done[v] += 1
            if done[v] < len(at[v]):
                path.append(at[v][done[v]])
                v = to[path[-1]]
            elif v == source:
                break
            else:
                level[v] = -1
                v = to[path.pop() ^ 1]


def main_text(page: str | None) -> str:
    """The blocks that the cut leaves with the content, joined by spaces."""
    rows = blocks(page or "")
    keep = minimum_cut([costs(b) for b in rows], edges(rows))
    return " ".join(b.text for b, k in zip(rows, keep) if k)


def _extract(pages: pd.Series) -> pd.Series:
    return pages.map(main_text)


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` per row of ``pages``.

    Null or empty html, and pages without content, give an empty text; broken markup is read as far as it
    goes (what an unclosed tag or comment swallows is markup); repeated rows are extracted each; an empty
    table gives an empty result.
    """
    text = F.pandas_udf(_extract, "string")(F.coalesce(F.col(html), F.lit("")))
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), text.alias("text"))
    return rows.withColumn("n_chars", F.length("text").cast("long"))
