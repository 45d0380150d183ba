"""HTML extraction by minimum cut.

A page becomes blocks of text in page order, and the containers (body, div, section, list, table cell ...) that they stand in. Two logistic classifiers, trained on
generated pages, give terminal capacities: one sees a block's text only (length, link share, punctuation, heading, list item), the other a container's markup
(element names, whole names of classes, what stands above it) and the texture of its text. Smoothness edges join a block to its container, neighbouring blocks (weaker
with each step between them in the tree), a container to the one around it, and like siblings. The minimum cut, found by maximum flow, separates content
from boilerplate: blocks are labelled by the cut alone.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrygraph.llm.common import parts

# Fixed values of HTML: elements whose text is no page text, elements without an end tag, elements that begin and end a block.
RAW = frozenset("script style noscript template textarea title iframe xmp noembed noframes select datalist".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu "
    "nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul label".split()
)
# Elements that end an open one of the same group, within the nearest of the fences.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
FENCES = frozenset("ul ol dl table menu select body html article section div td".split())
ITEM_FENCES = {name: FENCES - set(same) for name, same in CLOSES.items()}
P_FENCES = frozenset("table td th button body html object".split())
# Blocks that hold others, and those that are controls of a form.
CONTAINERS = frozenset("html body div section article main aside nav header footer form fieldset ul ol dl menu table td th figure details dialog center search address".split())
CONTROLS = frozenset("button label legend option optgroup".split())
# Elements, and words of class, id and role, that speak against what is inside or for it; words that say nothing beside another; first words of a state or a topic.
BAD_TAGS = frozenset("nav footer aside menu dialog search fieldset".split()) | CONTROLS
GOOD_TAGS = frozenset(("article", "main"))
BAD_WORDS = frozenset(
    "nav navbar navigation menu menubar breadcrumb breadcrumbs footer foot header masthead banner sidebar side aside widget widgets ad ads advert adverts advertisement advertisements advertising sponsor sponsored promo promotion popup modal overlay cookie cookies consent gdpr notice "
    "notices alert alerts notification notifications newsletter subscribe subscription signup login form search share sharing social related recommended recommendations comment comments reply replies respond disqus discussion "
    "copyright legal disclaimer toolbar pagination pager tags toc skip print hidden contentinfo complementary".split()
)
GOOD_WORDS = frozenset("article content post entry main story body text articlebody maincontent postcontent entrycontent".split())
EMPTY_WORDS = frozenset("site page main box list lists item items wrapper wrap container section block area inner outer top bottom left right global primary secondary user users reader readers post posts entry article articles panel bar module group slot unit link links the".split())
FIRST_WORDS = frozenset("has is no not with without category tag topic type format status overflow text font layout theme lang".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

_WORDS = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"([a-z])([A-Z])")
_NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
_SPECIAL = re.compile(r"[\"'>]")
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]++)(?:\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']++)))?")
_UNSEEN = re.compile(r"display\s*+:\s*+none|visibility\s*+:\s*+hidden")
_SENTENCE = re.compile(r"[.!?:;…][\"')\]]*(?:\s|$)")


def name_evidence(value: str) -> tuple[float, float]:
    """What the names in a class, id or role say against an element and for it, from 0 to 1: 1 if all words of a name that mean anything do.

    A name that begins with a word of a state or a topic (has-sidebar, category-legal) says nothing.
    """
    bad = good = 0.0
    for token in value.split():
        words = _WORDS.findall(_CAMEL.sub(r"\1 \2", token).lower())
        if not words or len(words) > 1 and words[0] in FIRST_WORDS:
            continue
        against = sum(w in BAD_WORDS for w in words)
        if against:
            rest = sum(w not in BAD_WORDS and w not in EMPTY_WORDS for w in words)
            bad = max(bad, against / (against + rest))
        else:
            good = max(good, sum(w in GOOD_WORDS for w in words) / len(words))
    return bad, good


class Element:
    """An open element. Where it is a container, also what is known of it once the page is read."""

    __slots__ = (
        "against", "bad", "beside", "box", "chars", "direct", "favour", "good", "hidden", "holds_main", "in_largest", "key", "largest", "link", "linked", "number", "over_largest", "parent", "part", "prose", "sentences", "tag", "up",
    )


    def __init__(self, tag: str, parent: Element | None, attributes: str = ""):
        self.tag = tag
        self.hidden = bool(parent and parent.hidden)
        self.link = bool(parent and parent.link) or tag == "a"
        names = ""
        if attributes and not attributes.isspace():
            for m in _ATTRIBUTE.finditer(attributes):
                name = m[1].lower()
                if name in ("class", "id", "role"):
                    names += f" {m[2] or m[3] or m[4] or ''}"
                elif name == "hidden" or name == "aria-hidden" and (m[2] or m[3] or m[4]) == "true" or name == "style" and _UNSEEN.search(m[2] or m[3] or m[4] or ""):
                    self.hidden = True
        bad, good = name_evidence(names) if names and tag not in ("body", "html") else (0.0, 0.0)
        self.parent = parent.box if parent else None
        self.box = self.parent
        if self.parent is None or tag in CONTAINERS or tag in CONTROLS or tag in BLOCKS and (bad == 1 or good == 1):
            self.box = self
            self.bad, self.good, self.key = bad, good, (tag, names)
            self.direct = self.chars = self.linked = self.sentences = self.prose = 0
            self.holds_main = self.largest = self.in_largest = self.over_largest = self.beside = False
            self.part = 0.0


class Block:
    __slots__ = ("box", "linked", "steps", "tag", "text")

    def __init__(self, box: Element, tag: str, text: str, linked: int, steps: int):
        self.box, self.tag, self.text, self.linked, self.steps = box, tag, text, linked, steps


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """Texts ("", text, ""), start tags (name, attributes, "") and end tags (name, "", "/") of a page, in order.

    Quotes in a tag are heeded where that lets it end. Every place is passed a bounded number of times, however broken the page is.
    """
    at, n = 0, len(page)
    failed: set[int] = set()  # places from which no tag's end is found
    lone: set[str] = set()  # quotes that have no other one further on
    known = (-1, -1)  # from, to: no special character between
    last_end = page.rfind(">")

    def tag_end(i: int) -> int:
        nonlocal known
        seen = []
        while True:
            if not known[0] <= i <= known[1]:
                m = _SPECIAL.search(page, i)
                known = (i, m.start() if m else n)
            p = known[1]
            if p >= n or p in failed:
                failed.update(seen)
                return -1
            seen.append(p)
            c = page[p]
            if c == ">":
                return p
            j = -1 if c in lone else page.find(c, p + 1)
            if j < 0:
                lone.add(c)
            i = p + 1 if j < 0 else j + 1

    while at < n:
        p = page.find("<", at)
        if p < 0:
            break
        if p > at:
            yield "", page[at:p], ""
        at = p
        if page.startswith("<!--", p):
            end = page.find("-->", p + 4)
            at = n if end < 0 else end + 3
        elif page.startswith("<![CDATA[", p):
            end = page.find("]]>", p + 9)
            yield "", page[p + 9 : n if end < 0 else end], ""
            at = n if end < 0 else end + 3
        elif page.startswith(("<!", "<?"), p):
            end = page.find(">", p)
            at = n if end < 0 else end + 1
        elif m := _NAME.match(page, p + 1):
            end = tag_end(m.end())
            if end < 0:
                if last_end < m.end():
                    return  # a tag that the page's end cuts
                end = page.find(">", m.end())
            name = m[2].lower()
            yield name, "" if m[1] else page[m.end() : end], m[1]
            at = end + 1
            if name in RAW and not m[1]:
                stop = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.IGNORECASE).search(page, at)
                at = stop.start() if stop else n
        else:
            yield "", "<", ""
            at = p + 1
    if at < n:
        yield "", page[at:], ""


def parse(page: str | None) -> tuple[list[Block], list[Element]]:
    """Blocks of text of a whole page in page order (character references decoded, white space runs as one space, trimmed, empty ones left out), and its containers in
    the order in which they begin."""
    out: list[Block] = []
    root = Element("html", None)
    boxes = [root]
    if not page:
        return out, boxes
    stack = [root]
    where: dict[str, list[int]] = {"html": [0]}  # places of the open elements in the stack, by name
    opened: list[int] = [0]  # those of blocks
    held: list[tuple[str, bool]] = []
    low = 1  # least height of the stack since the last block
    height = 1  # height at the last block

    def end() -> None:
        nonlocal low, height
        if held:
            node = stack[-1]
            text = " ".join(html.unescape("".join([x for x, _ in held])).split())
            if text and not node.hidden:
                linked = min(len(text), sum(len(x) for x, link in held if link))
                out.append(Block(node.box, stack[opened[-1]].tag, text, linked, height + len(stack) - 2 * low))
                height = low = len(stack)
            held.clear()

    def cut_back(to: int) -> None:
        """Close the elements from that place on."""
        nonlocal low
        while len(stack) > max(1, to):
            where[stack.pop().tag].pop()
            if opened[-1] == len(stack):
                opened.pop()
        low = min(low, len(stack))

    def last(names) -> int:
        return max((where[x][-1] for x in names if where.get(x)), default=-1)

    for name, attributes, slash in tokens(page):
        if not name:
            held.append((attributes, stack[-1].link))
            continue
        if slash:
            if name in BLOCKS:
                end()
            at = last((name,))
            if at > 0 and (name in BLOCKS or opened[-1] < at):
                cut_back(at)
            elif name == "br":
                held.append((" ", stack[-1].link))
            continue
        if name in RAW:
            continue
        if name in BLOCKS:
            end()
            p = last(("p",))
            if name not in CONTROLS and p > 0 and p > last(P_FENCES):
                cut_back(p)
        if name in CLOSES:
            inner = last(CLOSES[name])
            if inner > 0 and (inner > last(("table",)) if name in ("tr", "td", "th") else inner > last(ITEM_FENCES[name])):
                if name == "tr":
                    row = last(("tr",))
                    inner = row if row > last(("table",)) else inner
                cut_back(inner)
        if name in VOID:
            if name == "br":
                held.append((" ", stack[-1].link))
            continue
        new = Element(name, stack[-1], attributes)
        if new.box is new:
            boxes.append(new)
        stack.append(new)
        where.setdefault(name, []).append(len(stack) - 1)
        if name in BLOCKS:
            opened.append(len(stack) - 1)
    end()
    return out, boxes


def blocks(page: str | None) -> list[Block]:
    return parse(page)[0]


TEXT_FEATURES, BOX_FEATURES = 8, 16
#: Text between tags of a page of one kind: above this share of the page's text, names say nothing about a container.
MOST_SHARE = 0.9


def text_features(found: list[Block]) -> np.ndarray:
    """What a block's text says, whatever the markup around it."""
    x = np.zeros((len(found), TEXT_FEATURES))
    for i, b in enumerate(found):
        t = b.text
        x[i] = 1.0, math.log1p(len(t)) / 4, b.linked / len(t), t[-1] in ".!?:;\"')…", len(_SENTENCE.findall(t)) > 1, b.tag in HEADINGS, b.tag in ("li", "td", "dt"), len(t) < 25
    return x


def read_boxes(found: list[Block], boxes: list[Element]) -> None:
    """Fill in what the containers hold, and what names and elements above and at them say."""
    for i, e in enumerate(boxes):
        e.number = i
    for b in found:
        e = b.box
        e.direct += 1
        e.chars += len(b.text)
        e.linked += b.linked
        ends = len(_SENTENCE.findall(b.text))
        e.sentences += ends
        if ends:
            e.prose += len(b.text) - b.linked
    for e in reversed(boxes[1:]):
        p = e.parent
        p.chars += e.chars
        p.linked += e.linked
        p.sentences += e.sentences
    total = max(1, boxes[0].chars)
    for e in boxes:
        if e.tag in GOOD_TAGS and e.bad < 1:
            p = e.parent
            while p is not None and not p.holds_main:
                p.holds_main = True
                p = p.parent
    for e in boxes:
        bad_up, good_up = e.parent.up if e.parent else (False, False)
        whole = e.holds_main or e.chars > MOST_SHARE * total
        good = e.tag in GOOD_TAGS or e.good == 1
        inside = good_up or good
        named = e.bad == 1 and not whole and not (inside and set(_WORDS.findall(e.key[1].lower())) & BAD_WORDS == {"header"})  # an article's own heading
        e.against = e.tag in BAD_TAGS or e.tag == "form" and not whole or e.tag == "header" and not inside or named
        e.favour = good and not e.against and not bad_up
        e.up = (bad_up or e.against, good_up or e.favour)
    # the container in favour with most text, else the one with most prose of its own; and what stands in it, beside it and above it
    favoured = [e for e in boxes if e.favour and not e.up[0]]
    largest = max(favoured, key=lambda e: e.chars) if favoured else max(boxes, key=lambda e: (not e.up[0], e.prose, e.chars * (e.direct > 0)))
    most = 1
    for e in boxes:
        e.largest = e is largest
        e.in_largest = e.parent is not None and (e.parent.largest or e.parent.in_largest)
        e.beside = e.parent is largest.parent and e is not largest
        if e.largest or e.in_largest:
            most = max(most, e.prose)
    for e in boxes:
        e.part = min(1.0, e.prose / most)
    p = largest.parent
    while p is not None:
        p.over_largest = True
        p = p.parent


def box_features(boxes: list[Element]) -> np.ndarray:
    """What a container's markup and the texture of all its text say."""
    x = np.zeros((len(boxes), BOX_FEATURES))
    marked = any(e.favour for e in boxes)
    for i, e in enumerate(boxes):
        bad_up, good_up = e.parent.up if e.parent else (False, False)
        x[i] = (
            1.0, e.against, bad_up, e.bad if e.bad < 1 else 0.0, e.favour, good_up, marked and not e.up[1], 0.0 if e.up[1] else e.linked / max(1, e.chars), math.log1p(e.chars / max(1, e.direct)) / 4, min(1.0, 60 * e.sentences / max(60, e.chars)),
            e.largest, e.in_largest, e.over_largest, e.beside, e.part, math.log1p(e.prose) / 8,
        )
    return x


def fit(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of a logistic model, by gradient descent."""
    w = np.zeros(x.shape[1])
    for _ in range(1500):
        w -= 1.0 * (x.T @ (1 / (1 + np.exp(-x @ w)) - y) / len(y) + 1e-4 * w)
    return w


@lru_cache(maxsize=1)
def classifier() -> tuple[np.ndarray, np.ndarray]:
    """Weights for blocks and for containers, fitted to generated pages."""
    tx, ty, bx, by = [], [], [], []
    made = generated_pages()
    # half of what is learned has no telling name, so that texts and structure have to tell
    for page, wanted in made + [(nameless(page), wanted) for page, wanted in made]:
        found, boxes = parse(page)
        read_boxes(found, boxes)
        tx.append(text_features(found))
        inside: dict[int, list[bool]] = {}
        for b in found:
            ty.append(b.text in wanted)
            inside.setdefault(b.box.number, []).append(ty[-1])
        held = sorted(inside)
        bx.append(box_features(boxes)[held])
        by += [sum(inside[k]) * 2 > len(inside[k]) for k in held]
    return fit(np.concatenate(tx), np.array(ty, float)), fit(np.concatenate(bx), np.array(by, float))


_NAMES_OF = re.compile(r"""\s(?:class|id|role)=(?:"[^"]*"|'[^']*')""")
_NAMED_TAG = re.compile(r"<(/?)(?:nav|footer|aside|header|article|main|section)\b")


def nameless(page: str) -> str:
    """A page without class, id and role, whose elements with a meaning are plain ones."""
    return _NAMED_TAG.sub(r"<\1div", _NAMES_OF.sub("", page))


def generated_pages(n: int = 160, seed: int = 9) -> list[tuple[str, set[str]]]:
    """Pages of several layouts with the blocks that are content."""
    rng = np.random.default_rng(seed)
    syllables = "an er in on re ti th at es or en al le de ar st se ne ra ta".split()

    def word() -> str:
        return "".join(syllables[i] for i in rng.integers(0, len(syllables), rng.integers(1, 5)))

    def words(low: int, high: int) -> str:
        return " ".join(word() for _ in range(rng.integers(low, high)))

    def sentence() -> str:
        return words(2, 18).capitalize() + "."

    def links(k: int) -> str:
        return "".join(f'<li><a href="/{word()}">{words(1, 4)}</a></li>' for _ in range(k))

    pages = []
    for i in range(n):
        good: set[str] = set()

        def keep(tag: str, text: str, good: set[str] = good) -> str:
            good.add(text)
            return f"<{tag}>{text}</{tag}>"

        def keep_text(text: str, good: set[str] = good) -> str:
            good.add(text)
            return text

        body = keep("h1", words(2, 10).capitalize() + ("" if rng.random() < 0.7 else "."))
        for _ in range(rng.integers(1, 9)):
            body += keep("p", " ".join(sentence() for _ in range(rng.integers(1, 7))))
            if rng.random() < 0.15:
                body += keep("h2", words(1, 6).capitalize())
            if rng.random() < 0.15:
                body += "<ul>" + "".join(keep("li", words(2, 9)) for _ in range(3)) + "</ul>"
            if rng.random() < 0.1:
                body += keep("blockquote", sentence())
            if rng.random() < 0.1:
                body += "<p><a href='#'>" + keep_text(words(2, 12).capitalize()) + "</a></p>"
            if rng.random() < 0.1:
                body += "<ul>" + "".join(f"<li><a href='/{word()}'>{keep_text(words(2, 6))}</a></li>" for _ in range(3)) + "</ul>"
            if rng.random() < 0.05:
                body += "<table><tr>" + "".join(keep("td", words(1, 4)) for _ in range(3)) + "</tr></table>"
            if rng.random() < 0.08:
                body += f'<div class="{["ad-container", "share", "newsletter-signup", "related-posts"][rng.integers(4)]}"><p>{sentence()}</p></div>'
        box = ["article", 'div class="content"', "main", 'div id="post-body"', 'section class="entry"', "div", 'article class="post category-legal tag-search"', 'div class="overflow-hidden"'][i % 8]
        comments = "".join(f"<p>{sentence()}</p>" for _ in range(rng.integers(0, 4)))
        page = f"<nav><ul>{links(rng.integers(2, 8))}</ul></nav>" if rng.random() < 0.7 else f'<div class="menu"><ul>{links(5)}</ul></div>'
        page = (f"<header><p>{words(1, 5)}</p></header>" if rng.random() < 0.5 else "") + page
        page += f'<div class="{["ad", "advert", "sponsored"][i % 3]}"><p>{sentence()}</p></div>' if rng.random() < 0.6 else ""
        page += f'<div class="cookie-notice">{sentence()}</div>' if rng.random() < 0.3 else ""
        page += f"<div>{links(6)}</div>" if rng.random() < 0.1 else ""
        inner = f"<{box}>{body}</{box.split()[0]}>"
        page += f'<div class="{words(1, 2)}"><div>{inner}</div></div>' if rng.random() < 0.3 else inner
        page += f'<div class="comments">{comments}</div>' if comments and rng.random() < 0.5 else ""
        page += f"<aside><h3>{words(1, 3)}</h3><p>{sentence()}</p><ul>{links(4)}</ul></aside>" if rng.random() < 0.5 else ""
        page += f"<form><label>{words(1, 3)}</label><input><button>{word()}</button></form>" if rng.random() < 0.4 else ""
        page += f"<footer>&copy; {words(1, 4)} &middot; {sentence()}</footer>" if rng.random() < 0.8 else f'<div id="footer"><p>{sentence()}</p></div>'
        if rng.random() < 0.1:
            page = f'<form id="page">{page}</form>'
        if rng.random() < 0.15:
            page = f'<div class="has-sidebar">{page}</div>'
        pages.append((f"<html><head><title>t</title></head><body>{page}</body></html>", good))
    return pages


#: Bounds of a block's and a container's log odds (a container's are for each block that stands directly in it). Capacities of the smoothness edges: block and container,
#: neighbours at two steps in the tree (half of it for each step more), container and the one around it, like siblings.
TEXT_ODDS, BOX_ODDS = 2.0, 6.0
TIE, ADJACENT, AROUND, ALIKE = 2.5, 0.4, 0.3, 0.3


def minimum_cut(content: np.ndarray, edges: list[tuple[int, int, float]]) -> np.ndarray:
    """Blocks on the content side of a minimum cut. content: log odds of each block; edges (i, j, capacity) cost that much when cut.

    Augmenting paths over the residual graph, shortest first (Dinic's levels). A tie leaves a block on the side that the source can still reach.
    """
    n = len(content)
    source, sink = n, n + 1
    to: list[int] = []
    room: list[float] = []
    out: list[list[int]] = [[] for _ in range(n + 2)]

    def join(a: int, b: int, forth: float, back: float) -> None:
        out[a].append(len(to))
        to.append(b)
        room.append(forth)
        out[b].append(len(to))
        to.append(a)
        room.append(back)

    for i, c in enumerate(content):
        if c > 0:
            join(source, i, float(c), 0.0)
        elif c < 0:
            join(i, sink, float(-c), 0.0)
    for i, j, c in edges:
        join(i, j, c, c)
    tiny = 1e-9
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = [source]
        for a in queue:
            for e in out[a]:
                if room[e] > tiny and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return np.array([level[i] >= 0 for i in range(n)], bool)
        used = [0] * (n + 2)
        path: list[int] = []
        a = source
        while True:
            if a == sink:
                flow = min(room[e] for e in path)
                for e in path:
                    room[e] -= flow
                    room[e ^ 1] += flow
                cut = next(k for k, e in enumerate(path) if room[e] <= tiny)
                a = to[path[cut] ^ 1]
                del path[cut:]
                continue
            while used[a] < len(out[a]):
                e = out[a][used[a]]
                if room[e] > tiny and level[to[e]] == level[a] + 1:
                    break
                used[a] += 1
            if used[a] < len(out[a]):
                path.append(out[a][used[a]])
                a = to[path[-1]]
            elif a == source:
                break
            else:
                level[a] = -1
                a = to[path.pop() ^ 1]


def network(found: list[Block], boxes: list[Element], weights: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, list[tuple[int, int, float]]]:
    """Log odds of the blocks and, after them, of the containers; and the smoothness edges between them."""
    read_boxes(found, boxes)
    n = len(found)
    odds = np.zeros(n + len(boxes))
    odds[:n] = np.clip(text_features(found) @ weights[0], -TEXT_ODDS, TEXT_ODDS)
    odds[n:] = np.clip(box_features(boxes) @ weights[1], -BOX_ODDS, BOX_ODDS) * [e.direct for e in boxes]
    edges = []
    for i, b in enumerate(found):
        edges.append((i, n + b.box.number, TIE))
        if i and b.steps < 12:
            edges.append((i - 1, i, ADJACENT * 0.5 ** max(0, b.steps - 2)))
    before: dict[tuple, int] = {}
    for e in boxes[1:]:
        if e.chars:
            edges.append((n + e.parent.number, n + e.number, AROUND))
            like = (e.parent.number, e.key)
            if like in before:
                edges.append((n + before[like], n + e.number, ALIKE))
            before[like] = e.number
    return odds, edges


def label(found: list[Block], boxes: list[Element], weights: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """Whether each block is on the content side of the minimum cut."""
    if not found:
        return np.zeros(0, bool)
    return minimum_cut(*network(found, boxes, weights or classifier()))[: len(found)]


def extract(page: str | None, weights: tuple[np.ndarray, np.ndarray] | None = None) -> str:
    """Main text of a page: its content blocks in page order, joined by two newlines."""
    found, boxes = parse(page)
    return "\n\n".join(b.text for b, ok in zip(found, label(found, boxes, weights), strict=True) if ok)


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars: one row for each row of pages.

    Null and empty html, and pages without content, have the empty text; n_chars counts code points. Repeated rows give equal rows, an empty table
    none; other columns are not read.
    """
    weights = classifier()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches):
            texts = [extract(page, weights) for page in b.column(2).to_pylist()]
            yield pa.record_batch([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(run, "page_id long, url string, text string, n_chars long")
