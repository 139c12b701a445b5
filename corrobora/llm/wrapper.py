"""Main text of web pages by wrapper induction.

Every page is read once to a folded tree: its elements' labels (name and class
tokens without digits), a key of each element's own text and counts of its text
inside and outside links. Runs of equal paragraphs, items and links, and long
runs of equal containers, are one repeated slot. Of each host the most common
``REFERENCES`` folded shapes (a page of each) are the references, so that one odd
page does not decide. Every page of the host is aligned with all of them by
simple tree matching (Yang 1991): the largest set of matched nodes that keeps
labels, ancestors and order. From the alignments' sums over all pages

* a singular slot whose own text is the same on nearly all pages becomes
  template: its text goes, its children are judged by themselves. Pages with the
  reference's title or first heading are copies and prove nothing;
* a container whose aligned text stands in links nearly everywhere is a menu;
* the content slot is found by going down from the root as long as one child
  holds nearly all varying text outside links and no varying heading is left
  behind: the template's slot that is filled with long text.

A page's text is that of the node aligned with its host's content slot, less
template and menus. Elements whose name says that they are no content (``nav``,
``footer``, ``form`` and so on), hidden ones, and ones whose class or id
consists of nothing but telling words (``share-buttons``, never ``share-price``) go
too; class words never outweigh the text: an element with half of it or more
stays, unless it holds reader comments. Where no slot is aligned, the articles,
else the main element, else the body are taken.

Folded trees go to the shared folder; the counts are sums, combined before they
are shuffled. Pages meet their host's row by a broadcast while all hosts' rows
take at most ``BROADCAST_BYTES``, else by a join on the host and a salt, so a
host with a third of all pages is no group that one task must hold. Nothing
here recurses, so pages of any depth are read. Child lists of any length get the
largest matching; with more than ``MOST_CELLS`` pairs its table is held in part,
row by row, which changes memory and time but no result.

Defined results: null html is empty; an empty page has an empty text and 0
characters; a null url is a host of its own; a null page_id never is the
reference; repeated rows get equal results; an empty table gives no rows;
other columns are not read.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache, partial
from hashlib import blake2b
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corrobora.llm.arrowtext import gives_back
from corrobora.llm.dom import DROPPED, Node, parse
from corrobora.llm.durable import materialize

#: A node is template when this share of at least so many aligned pages repeats the reference's text.
TEMPLATE_SHARE, TEMPLATE_PAGES = 0.9, 5
#: A container with this share of its text in links is a menu; a child with this share of the varying text is gone into.
LINK_SHARE, CONTENT_SHARE = 0.8, 0.7
#: Folded shapes of a host that serve as references.
REFERENCES = 4
#: Containers of one shape in a row, beyond so many, are one slot.
LIST = 8
#: The table of child lists with more pairs than this is not held whole.
MOST_CELLS = 250_000

#: Hosts' rows of more bytes are joined by host and salt instead of being broadcast.
BROADCAST_BYTES, SALTS = 32 << 20, 64

#: Words of a class or id that mark what is not the article.
MARKS = frozenset(
    "ad ads adsense advert adverts advertisement advertising sponsor sponsored promo promotion banner breadcrumb breadcrumbs nav navbar navigation menu menubar sidebar aside footer masthead topbar header cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe subscription signup signin login share sharing social related recommended recommendations comment comments commentlist respond reply replies disqus discussion pagination pager widget toolbar search searchform hidden".split()
)
#: Words that say nothing about what an element holds.
NEUTRAL = frozenset("area bar block box button buttons byuser center col column container cta depth even form group holder icon icons inner item items layer left list middle odd outer panel parent region right row section site slot space the thread top bottom unit wide wrap wrapper zone".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
COMMENTS = frozenset("comment comments commentlist respond reply replies disqus discussion".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
#: Elements of running text, whose inline elements are part of it; a run of those in PARTS is one slot.
PARAGRAPHS = frozenset("p pre li dt dd td th h1 h2 h3 h4 h5 h6 caption summary legend figcaption address blockquote".split())
PARTS = frozenset("p pre li dt dd tr td th".split())
_WORDS = re.compile(r"[A-Za-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|/|$)|aria-hidden\s*=\s*["']?true|style\s*=\s*["'][^"']*(?:display\s*:\s*none|visibility\s*:\s*hidden)""", re.I)


@lru_cache(maxsize=50_000)
def _marks(attrs: str) -> frozenset[str]:
    """Telling words of an element whose class, or id, consists of nothing but telling and neutral words; 'role' for its role."""
    if not attrs or attrs.isspace():
        return frozenset()
    node, out = Node("", attrs, None), set()
    for name in ("class", "id"):
        words = {w.lower() for w in _WORDS.findall(_CAMEL.sub(" ", node.get(name)))}
        if words <= MARKS | NEUTRAL:
            out |= words & MARKS
    if node.get("role").lower() in ROLES:
        out.add("role")
    return frozenset(out)


@lru_cache(maxsize=50_000)
def _hidden(attrs: str) -> bool:
    return bool(attrs) and bool(_HIDDEN.search(attrs))


def _never(node: Node, in_article: bool) -> bool:
    """Whether the element's name, or its being hidden, says that it is no content."""
    if node.tag in DROPPED:
        return True
    if node.tag == "header":
        return not in_article or not any(isinstance(k, Node) and k.tag in _HEADINGS for k in node.kids)
    if node.tag in ("article", "main", "body", "html", "#root"):
        return bool(_marks(node.attrs) & COMMENTS)
    return _hidden(node.attrs) or bool(_marks(node.attrs) & COMMENTS)


# --- folded trees --------------------------------------------------------------


class Slot:
    """A node of a folded tree; ``nodes`` are the page's nodes that it stands for, ``kind`` a number of its shape."""

    __slots__ = ("label", "kids", "nodes", "kind", "size")

    def __init__(self, label: str, kids: list["Slot"], nodes: list[Node]):
        self.label, self.kids, self.nodes = label, kids, nodes
        self.kind, self.size = _kind(label, kids), 1 + sum(k.size for k in kids)


_KINDS: dict[tuple, int] = {}
_SCORES: dict[tuple[int, int], int] = {}


def _kind(label: str, kids: list[Slot]) -> int:
    return _KINDS.setdefault((label, *(k.kind for k in kids)), len(_KINDS))


def _forget_kinds(most: int = 500_000) -> None:
    """Between pages: numbers of shapes and scores of pairs are kept up to a bound."""
    if len(_KINDS) > most or len(_SCORES) > 4 * most:
        _KINDS.clear()
        _SCORES.clear()
        _unshape.cache_clear()


@lru_cache(maxsize=50_000)
def _label(tag: str, attrs: str) -> str:
    own = Node(tag, attrs, None).get("class") if attrs else ""
    tokens = sorted({t for x in own.lower().split() if (t := re.sub(r"[^a-z_-]", "", x))})
    return ".".join([re.sub(r"[(),\s]", "", tag), *tokens])


def _tag(label: str) -> str:
    return label.partition(".")[0]


def _slots_of(node: Node) -> list[Node]:
    """The children that are nodes of the tree: all, but inline ones in running text."""
    text = node.tag in PARAGRAPHS or not node.block
    return [k for k in node.kids if isinstance(k, Node) and (k.block or not text)]


def fold(node: Node) -> Slot:
    """The folded tree. A run of paragraphs, items or inline elements with one label is one slot with the first one's inside; so is a long run of equal containers."""
    done: dict[int, Slot] = {}
    stack = [(node, _slots_of(node), False)]
    while stack:
        own, below, ready = stack.pop()
        if not ready:
            stack.append((own, below, True))
            stack += [(k, _slots_of(k), False) for k in below]
            continue
        kids: list[Slot] = []
        items = [done.pop(id(k)) for k in below]
        i = 0
        while i < len(items):
            first, j = items[i], i + 1
            part = _tag(first.label) in PARTS or not first.nodes[0].block
            while j < len(items) and items[j].label == first.label and (part or items[j].kind == first.kind):
                j += 1
            if j - i > (1 if part else LIST):
                first.nodes = [x.nodes[0] for x in items[i:j]]
                kids.append(first)
            else:
                kids += items[i:j]
            i = j
        done[id(own)] = Slot(_label(own.tag, "" if own.parent is None else own.attrs), kids, [own])
    return done[id(node)]


def preorder(slot: Slot) -> list[Slot]:
    out, stack = [], [slot]
    while stack:
        out.append(own := stack.pop())
        stack += reversed(own.kids)
    return out


def shape(slot: Slot) -> str:
    out, stack = [], [slot]
    while stack:
        own = stack.pop()
        if isinstance(own, str):
            out.append(own)
            continue
        out.append(own.label + "(")
        stack.append(")")
        stack += reversed(own.kids)
    return "".join(out)


@lru_cache(maxsize=2_000)
def _unshape(text: str) -> Slot:
    stack: list[tuple[str, list[Slot]]] = [("", [])]
    for label, mark in re.findall(r"([^()]*)([()])", text):
        if mark == "(":
            stack.append((label, []))
        else:
            own, kids = stack.pop()
            stack[-1][1].append(Slot(own, kids, []))
    return stack[0][1][0]


# --- alignment -----------------------------------------------------------------


def _needed(x: Slot, y: Slot) -> Iterator[tuple[Slot, Slot]]:
    """Pairs of children that a pair's score is made of, each pair of shapes once."""
    theirs: dict[str, dict[int, Slot]] = {}
    for b in y.kids:
        theirs.setdefault(b.label, {}).setdefault(b.kind, b)
    for a in {a.kind: a for a in x.kids}.values():
        for b in theirs.get(a.label, {}).values():
            yield a, b


def _known(x: Slot, y: Slot) -> int | None:
    return 0 if x.label != y.label else x.size if x.kind == y.kind else 1 if not x.kids or not y.kids else _SCORES.get((x.kind, y.kind))


def _table(x: Slot, y: Slot) -> list[list[int]]:
    best = [[0] * (len(y.kids) + 1) for _ in range(len(x.kids) + 1)]
    for i, a in enumerate(x.kids):
        row, above = best[i + 1], best[i]
        for j, b in enumerate(y.kids):
            w = _known(a, b)
            row[j + 1] = max(row[j], above[j + 1], above[j] + w if w else 0)
    return best


class _Rows:
    """The same table for long child lists: rows in numpy, every n-th one kept and those between made again when they are asked for."""

    def __init__(self, x: Slot, y: Slot):
        self.x, self.step = x, isqrt(len(x.kids)) + 1
        numbers: dict[int, int] = {}
        self.places = np.array([numbers.setdefault(b.kind, len(numbers)) for b in y.kids], np.int64)
        shapes = {b.kind: b for b in y.kids}
        self.shapes = [shapes[k] for k in numbers]
        self.weights: tuple[int, np.ndarray] | None = None
        self.kept, self.block = [row := np.zeros(len(y.kids) + 1, np.int64)], (0, [row])
        for i in range(len(x.kids)):
            row = self._next(i, row)
            if (i + 1) % self.step == 0:
                self.kept.append(row)
        self.last = int(row[-1])

    def _next(self, i: int, above: np.ndarray) -> np.ndarray:
        a = self.x.kids[i]
        if self.weights is None or self.weights[0] != a.kind:
            self.weights = a.kind, np.array([_known(a, b) for b in self.shapes], np.int64)[self.places]
        row = np.maximum(above[1:], above[:-1] + self.weights[1])
        return np.concatenate([above[:1], np.maximum.accumulate(row)])

    def __getitem__(self, i: int) -> np.ndarray:
        first = i // self.step
        if self.block[0] != first or len(self.block[1]) == 1:
            rows = [self.kept[first]]
            for k in range(first * self.step, min((first + 1) * self.step, len(self.x.kids) + 1) - 1):
                rows.append(self._next(k, rows[-1]))
            self.block = first, rows
        return self.block[1][i - first * self.step]


def _score(x: Slot, y: Slot) -> int:
    """Nodes in the largest matching of two trees."""
    stack = [(x, y, _needed(x, y))]
    while stack:
        a, b, rest = stack[-1]
        if _known(a, b) is not None:
            stack.pop()
        elif missing := next(((c, d) for c, d in rest if _known(c, d) is None), None):
            stack.append((*missing, _needed(*missing)))
        else:
            _SCORES[a.kind, b.kind] = 1 + (_Rows(a, b).last if len(a.kids) * len(b.kids) > MOST_CELLS else _table(a, b)[-1][-1])
            stack.pop()
    return _known(x, y)


def _children(x: Slot, y: Slot) -> list[tuple[Slot, Slot]]:
    """The children matched in a largest matching."""
    if x.kind == y.kind:
        return list(zip(x.kids, y.kids, strict=True))
    i, j = len(x.kids), len(y.kids)
    best, pairs = _Rows(x, y) if i * j > MOST_CELLS else _table(x, y), []
    own, above = best[i], best[i - 1] if i else None
    while i and j:
        w = _known(x.kids[i - 1], y.kids[j - 1])
        if w and own[j] == above[j - 1] + w:
            pairs.append((x.kids[i - 1], y.kids[j - 1]))
            i, j = i - 1, j - 1
        elif own[j] == above[j]:
            i -= 1
        else:
            j -= 1
            continue
        own, above = above, best[i - 1] if i else None
    return pairs


def _align_trees(left: Slot, right: Slot) -> tuple[tuple[int, int], ...]:
    if not _score(left, right):
        return ()
    out: list[tuple[int, int]] = []
    todo = [(left, right, 0, 0)]
    while todo:
        x, y, i, j = todo.pop()
        out.append((i, j))
        if not x.kids or not y.kids:
            continue
        at, before = i + 1, {}
        for k in x.kids:
            before[id(k)] = at
            at += k.size
        other, at = {}, j + 1
        for k in y.kids:
            other[id(k)] = at
            at += k.size
        todo += [(a, b, before[id(a)], other[id(b)]) for a, b in _children(x, y)]
    return tuple(sorted(out))


@lru_cache(maxsize=20_000)
def tree_match(a: str, b: str) -> tuple[tuple[int, int], ...]:
    """Simple tree matching of two shapes: matched pairs of preorder numbers."""
    return _align_trees(_unshape(a), _unshape(b))


def text_key(text: str) -> str:
    return blake2b(text.encode("utf-8", "replace"), digest_size=8).hexdigest() if text else ""


def _texts(tree: Node) -> dict[int, tuple[str, int, int, int, int]]:
    """For each tree node: its own text (in running text with that of inline elements), and characters outside and inside links, its own and with all below."""
    out: dict[int, tuple[str, int, int, int, int]] = {}
    stack = [(tree, False, False)]
    while stack:
        node, linked, ready = stack.pop()
        linked = linked or node.tag == "a"
        if not ready:
            stack.append((node, linked, True))
            stack += [(k, linked, False) for k in _slots_of(node)]
            continue
        slots = {id(k) for k in _slots_of(node)}
        plain: list[str] = []
        parts: list[str] = []
        inside: list[tuple[list, bool]] = [(node.kids[::-1], linked)]
        while inside:  # texts in order, inline elements opened
            rest, link = inside[-1]
            if not rest:
                inside.pop()
                continue
            k = rest.pop()
            if isinstance(k, str):
                parts.append(k)
                if not link:
                    plain.append(k)
            elif id(k) not in slots and k.tag not in DROPPED and not _hidden(k.attrs):
                inside.append((k.kids[::-1], link or k.tag == "a"))
        own = " ".join("".join(parts).split())
        chars = len(" ".join("".join(plain).split())) if plain else 0
        links = max(0, len(own) - chars)
        below = [out[x] for x in slots]
        out[id(node)] = (own, chars, links, chars + sum(x[3] for x in below), links + sum(x[4] for x in below))
    return out


def page_tree(html: str) -> tuple[str, int, list[int], list[int]]:
    """A page's folded tree as text, a hash of its name (title, else first heading), and each slot's characters outside and inside links."""
    _forget_kinds()
    tree = parse(html)
    slots, texts = preorder(top := fold(tree)), _texts(tree)
    keys, chars, links = [], [], []
    for s in slots:
        first, more = texts[id(s.nodes[0])], [texts[id(x)] for x in s.nodes[1:]]
        keys.append("*" if more else text_key(first[0]))
        chars.append(first[1] + sum(x[3] for x in more))
        links.append(first[2] + sum(x[4] for x in more))
    name = tree.attrs or next((texts[id(s.nodes[0])][0] for s in slots if _tag(s.label) == "h1"), "")
    return shape(top) + "\n" + ",".join(keys), int.from_bytes(blake2b(name.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True) if name else 0, chars, links


def reference_tree(html: str) -> str:
    """The folded tree of a page: its shape and the key of each slot's text ('*' for repeated slots)."""
    return page_tree(html)[0]


# --- induction -----------------------------------------------------------------


def induce_wrapper(tree: str, sums: dict[int, tuple[int, int, int, int]], share: float, least: int) -> dict:
    """A reference's wrapper from its slots' sums (pages that tell, those that repeat its text, characters outside and inside links)."""
    shaped, _, keys = tree.partition("\n")
    slots, keys = preorder(_unshape(shaped)), keys.split(",")
    ends, parents = [0] * len(slots), [-1] * len(slots)
    number = 0
    stack = [(slots[0], -1)]
    while stack:
        slot, parent = stack.pop()
        parents[number], ends[number] = parent, number + slot.size
        stack += [(k, number) for k in reversed(slot.kids)]
        number += 1
    constant = {j for j, (told, same, _, _) in sums.items() if keys[j] not in ("", "*") and told >= least and same >= share * told}
    never = [False] * len(slots)
    for j, s in enumerate(slots):
        never[j] = (parents[j] >= 0 and never[parents[j]]) or _tag(s.label) in DROPPED or (_tag(s.label) == "header" and not any(_tag(slots[p].label) == "article" for p in _above(j, parents)))
    plain = [0 if never[j] or j in constant else sums.get(j, (0, 0, 0, 0))[2] for j in range(len(slots))]
    every = [sums.get(j, (0, 0, 0, 0)) for j in range(len(slots))]
    text = [x[2] for x in every]
    links = [x[3] for x in every]
    for j in range(len(slots) - 1, 0, -1):
        text[parents[j]] += text[j]
        links[parents[j]] += links[j]
    menus = {j for j, s in enumerate(slots) if j and links[j] and links[j] >= LINK_SHARE * (text[j] + links[j]) and _tag(s.label) not in PARAGRAPHS and _tag(s.label) not in ("article", "main", "body") and every[j][0] >= least}
    for j in sorted(menus):
        plain[j : ends[j]] = [0] * (ends[j] - j)
    mass = list(plain)
    for j in range(len(slots) - 1, 0, -1):
        mass[parents[j]] += mass[j]
    heads = [0]
    for j, s in enumerate(slots):
        heads.append(heads[-1] + (_tag(s.label) in _HEADINGS and plain[j] > 0))
    root, at = 0, 0
    while mass[at]:
        kids, k = [], at + 1
        while k < ends[at]:
            kids.append(k)
            k = ends[k]
        best = max((k for k in kids if _tag(slots[k].label) not in PARAGRAPHS and keys[k] != "*"), key=lambda k: mass[k], default=-1)
        if best < 0 or mass[best] < CONTENT_SHARE * mass[at] or heads[best] > heads[at]:
            break
        root = at = best
    return {"tree": tree, "constant": sorted(constant), "menus": sorted(menus), "root": root}


def _above(j: int, parents: list[int]) -> Iterator[int]:
    while parents[j] >= 0:
        j = parents[j]
        yield j


# --- the page ------------------------------------------------------------------


def _roots(tree: Node) -> list[Node]:
    """Outermost articles that are no comments; else main elements; else the body or all."""

    def find(wanted: str) -> list[Node]:
        out, stack = [], [tree]
        while stack:
            node = stack.pop()
            if node is not tree and (node.tag == wanted or (wanted == "main" and node.get("role") == "main")):
                out.append(node)
            else:
                stack += [k for k in reversed(node.kids) if isinstance(k, Node) and not _marks(k.attrs) & COMMENTS]
        return out

    if tree.tag in ("article", "main"):
        return [tree]
    return find("article") or find("main") or find("body")[:1] or [tree]


def main_text(tree: Node, template: set[int], menus: frozenset[int] | set[int] = frozenset(), root: Node | None = None) -> str:
    """Blocks of the content joined by line feeds.

    ``template`` has ids of nodes whose own text, not their children's, is left
    out, ``menus`` ids of nodes left out whole; ``root`` is the content slot's node.
    """
    blocks: list[str] = []
    run: list[str] = []
    sizes: dict[int, tuple[str, int, int, int, int]] = {}

    def flush() -> None:
        if run:
            if text := " ".join("".join(run).split()):
                blocks.append(text)
            run.clear()

    def outweighs(node: Node, top: Node) -> bool:
        if not sizes:
            sizes.update(_texts(tree))
        own = sizes.get(id(node))
        return own is not None and 2 * (own[3] + own[4]) >= sizes[id(top)][3] + sizes[id(top)][4]

    for top in _roots(root or tree):
        in_article = top.tag in ("article", "main") or root is not None
        stack: list[tuple[Node | None, list, bool]] = [(top, top.kids[::-1], id(top) in template)]
        while stack:
            node, rest, mute = stack[-1]
            if not rest:
                stack.pop()
                if node.block:
                    flush()
                continue
            k = rest.pop()
            if isinstance(k, str):
                if not mute:
                    run.append(k)
                continue
            if k.block:
                flush()
            if id(k) in menus or _never(k, in_article) or (k.tag not in ("article", "main", "body", "html") and _marks(k.attrs) and not outweighs(k, top)):
                continue
            inherited = mute and not k.block and (node.tag in PARAGRAPHS or not node.block)
            stack.append((k, k.kids[::-1], inherited or id(k) in template))
        flush()
    return "\n".join(blocks)


@lru_cache(maxsize=512)
def _wrappers(text: str | None) -> list[dict]:
    return [{**w, "constant": set(w["constant"]), "menus": set(w["menus"])} for w in json.loads(text)] if text else []


def apply_wrapper(html: str, wrapper: str | None) -> str:
    """The main text of a page under its host's wrappers."""
    _forget_kinds()
    tree = parse(html)
    wrappers = _wrappers(wrapper)
    if not wrappers:
        return main_text(tree, set())
    slots = preorder(own := fold(tree))
    mine, texts = shape(own), None
    template: set[int] = set()
    menus: set[int] = set()
    chosen: tuple[int, Node] | None = None
    for w in wrappers:
        shaped, _, keys = w["tree"].partition("\n")
        keys = keys.split(",")
        pairs = tree_match(mine, shaped)
        for i, j in pairs:
            if j in w["menus"]:
                menus.update(id(x) for x in slots[i].nodes)
            if j in w["constant"] and len(slots[i].nodes) == 1:
                texts = texts or _texts(tree)
                if text_key(texts[id(slots[i].nodes[0])][0]) == keys[j]:
                    template.add(id(slots[i].nodes[0]))
            if j == w["root"] and j and len(slots[i].nodes) == 1 and (chosen is None or len(pairs) > chosen[0]):
                chosen = len(pairs), slots[i].nodes[0]
    root = chosen[1] if chosen else None
    while root is not None and (root.tag in DROPPED or _marks(root.attrs) & COMMENTS):
        root = None
    return main_text(tree, template, menus, root)


def host_of(url: Column) -> Column:
    """The lower-case host of a URL, without user and port; null or no URL is ''."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.lower(host)


@gives_back
def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [page_tree(x or "") for x in batch.column("html").to_pylist()]
        columns = [pa.array([x[k] for x in found], t) for k, t in enumerate((pa.string(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())))]
        shapes = pa.array([int.from_bytes(blake2b(x[0].partition("\n")[0].encode(), digest_size=8).digest(), "little", signed=True) for x in found], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("host"), batch.column("page_id"), shapes, *columns], ["host", "page_id", "shape", "tree", "name", "chars", "links"])


def align_page(tree: str, name: int, chars: list[int], links: list[int], wrapper: str, seen: dict) -> None:
    """Adds to ``seen`` ((reference, slot) -> [pages that tell, those that repeat its text, characters outside and inside links]) what one page says."""
    shaped, _, keys = tree.partition("\n")
    keys = keys.split(",")
    for r, w in enumerate(_references(wrapper)):
        _forget_kinds()
        other, _, theirs = w["tree"].partition("\n")
        theirs = theirs.split(",")
        pairs = tree_match(shaped, other)
        same = [keys[i] == theirs[j] for i, j in pairs if theirs[j] not in ("", "*")]
        tells = not all(same) and not (name and name == w["name"])
        for i, j in pairs:
            count = seen.setdefault((r, j), [0, 0, 0, 0])
            count[0] += tells
            count[1] += tells and keys[i] == theirs[j]
            count[2] += chars[i]
            count[3] += links[i]


@lru_cache(maxsize=512)
def _references(wrapper: str) -> list[dict]:
    return json.loads(wrapper)


@gives_back
def _align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["host", "reference", "node", "told", "same", "chars", "links"]
    for batch in batches:
        hosts: dict[str, dict] = {}
        for host, tree, name, chars, links, wrapper in zip(*(batch.column(n).to_pylist() for n in ("host", "tree", "name", "chars", "links", "wrapper")), strict=True):
            if wrapper:
                align_page(tree, name, chars, links, wrapper, hosts.setdefault(host, {}))
        rows = [(h, r, j, *count) for h, seen in hosts.items() for (r, j), count in seen.items()]
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in rows], pa.int64() if k > 2 else pa.int32() if k else pa.string()) for k in range(len(names))], names)


def _induced(batches: Iterator[pa.RecordBatch], share: float, least: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for wrapper, sums in zip(batch.column("wrapper").to_pylist(), batch.column("sums").to_pylist(), strict=True):
            by: dict[int, dict] = {}
            for x in sums or []:
                by.setdefault(x["reference"], {})[x["node"]] = (x["told"], x["same"], x["chars"], x["links"])
            out.append(json.dumps([induce_wrapper(w["tree"], by.get(r, {}), share, least) for r, w in enumerate(_references(wrapper))]))
        yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array(out, pa.string())], ["host", "wrapper"])


@gives_back
def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [apply_wrapper(html or "", wrapper) for html, wrapper in zip(batch.column("html").to_pylist(), batch.column("wrapper").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def with_host_rows(pages: DataFrame, hosts: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """Pages (with host and page_id) and their host's row of a written table, where it has one."""
    size = hosts.agg(F.sum(F.length("host") + F.length("wrapper") + 64)).first()[0] or 0
    if size <= most:
        return pages.join(F.broadcast(hosts), "host", "left")
    salted = hosts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return pages.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int")).join(salted, ["host", "salt"], "left").drop("salt")


def references(trees: DataFrame, most: int = REFERENCES) -> DataFrame:
    """host and, as text, the references: the smallest page of each of its ``most`` most common shapes."""
    named = trees.where("page_id IS NOT NULL")
    shapes = named.groupBy("host", "shape").agg(F.count("*").alias("n"), F.min("page_id").alias("page_id"))
    order = [F.desc("n"), F.col("shape")]
    salted = shapes.withColumn("salt", F.pmod("shape", F.lit(SALTS)))  # a host of very many shapes is ranked in parts first
    ranked = salted.withColumn("rank", F.row_number().over(Window.partitionBy("host", "salt").orderBy(*order))).where(F.col("rank") <= most)
    ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("host").orderBy(*order))).where(F.col("rank") <= most)
    first = materialize(ranked.select("host", "shape", "page_id", "rank"), "first-pages")
    size = first.agg(F.sum(F.length("host") + 64)).first()[0] or 0
    chosen = trees.select("host", "shape", "page_id", "tree", "name").join(F.broadcast(first) if size <= BROADCAST_BYTES else first, ["host", "shape", "page_id"])  # one page of each: no key is hot
    one = chosen.groupBy("host", "rank").agg(F.min(F.struct("tree", "name")).alias("own"))
    made = F.transform(F.array_sort(F.collect_list(F.struct("rank", "own"))), lambda x: F.struct(x["own"]["tree"].alias("tree"), x["own"]["name"].alias("name")))
    return one.groupBy("host").agg(F.to_json(made).alias("wrapper"))  # at most `most` references


def induce(pages: DataFrame, share: float = TEMPLATE_SHARE, least: int = TEMPLATE_PAGES) -> DataFrame:
    """host and its wrappers: references with their template nodes, menus and content slot."""
    rows = pages.select(host_of(F.col("url")).alias("host"), "page_id", "html").where("length(html) > 0")
    trees = materialize(rows.mapInArrow(_trees, "host string, page_id long, shape long, tree string, name long, chars array<long>, links array<long>"), "trees")
    wrappers = materialize(references(trees), "references")
    aligned = with_host_rows(trees, wrappers).select("host", "tree", "name", "chars", "links", "wrapper").mapInArrow(_align, "host string, reference int, node int, told long, same long, chars long, links long")
    sums = aligned.groupBy("host", "reference", "node").agg(*(F.sum(c).alias(c) for c in ("told", "same", "chars", "links")))
    slots = sums.groupBy("host").agg(F.collect_list(F.struct("reference", "node", "told", "same", "chars", "links")).alias("sums"))  # at most the references' nodes
    return materialize(wrappers.join(slots, "host", "left").mapInArrow(partial(_induced, share=share, least=least), "host string, wrapper string"), "wrappers")


def extract(pages: DataFrame, share: float = TEMPLATE_SHARE, least: int = TEMPLATE_PAGES, induction: bool = True) -> DataFrame:
    """page_id, url, the main text and its length in code points, of every page; without ``induction`` each page is read by itself."""
    rows = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"))
    rows = with_host_rows(rows, induce(pages, share, least)) if induction else rows.withColumn("wrapper", F.lit(None).cast("string"))
    return rows.select("page_id", "url", "html", "wrapper").mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
