"""A small tolerant HTML reader, without recursion: elements that structure a page become a tree, all else is text.

Block elements are nodes; so are links and inline elements that bear a class,
an id, a role, a style or are hidden. Other inline elements leave only their
text. Opening and closing are looked up by counts of open elements, so a page
of any size or depth is read in time proportional to its length.
"""

from __future__ import annotations

import re
from collections import Counter
from html import unescape

#: Elements that make blocks of text or structure.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements whose text is never content; they are read as nodes so that they can be dropped.
DROPPED = frozenset("head nav footer aside form button select textarea datalist menu dialog search iframe object canvas svg math video audio noscript template fieldset".split())
#: Elements whose inside is not markup.
RAW = ("script", "style", "title", "textarea", "xmp", "noframes", "noembed", "iframe")
#: What an opening element closes without an end tag.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}}
_SCOPES = {"li": {"ul", "ol", "menu", "dir"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "tbody": {"table"}, "tfoot": {"table"}}
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_TELLING = re.compile(r"class|id\s*=|role|hidden|style", re.I)

_TAG = re.compile(r"""<!--.*?(?:-->|--!>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""", re.S)
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*(?:>|\Z)", re.I) for tag in RAW}
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")


class Node:
    """An element; ``kids`` are texts and nodes in order, ``block`` says whether it parts text."""

    __slots__ = ("tag", "attrs", "kids", "parent", "block")

    def __init__(self, tag: str, attrs: str, parent: "Node | None", block: bool = True):
        self.tag, self.attrs, self.parent, self.kids, self.block = tag, attrs, parent, [], block

    def get(self, name: str) -> str:
        if name not in self.attrs.lower():
            return ""
        for m in _ATTRIBUTE.finditer(self.attrs):
            if m[1].lower() == name:
                return unescape(m[2] or m[3] or m[4] or "")
        return ""

    def own_text(self) -> str:
        return " ".join("".join(x for x in self.kids if isinstance(x, str)).split())


def parse(html: str) -> Node:
    """The tree; strings between nodes hold decoded text, ``br`` is white space. A title is the root's ``attrs``."""
    root = Node("#root", "", None)
    node, at, n = root, 0, len(html)
    opened: Counter[str] = Counter()

    def close(up: Node) -> Node:
        """Closes everything down to ``up``, itself included."""
        nonlocal node
        while node is not up:
            opened[node.tag] -= 1
            node = node.parent
        opened[up.tag] -= 1
        return up.parent

    while at < n:
        m = _TAG.search(html, at)
        if m is None:
            node.kids.append(unescape(html[at:]))
            break
        if m.start() > at:
            node.kids.append(unescape(html[at : m.start()]))
        at = m.end()
        tag = m[2] or m[5]
        if not tag:
            continue
        tag, closing, attrs = tag.lower(), m[1] or m[4], m[3] or m[6] or ""
        if closing:
            if opened[tag] > 0:
                up = node
                while up.tag != tag:
                    up = up.parent
                node = close(up)
            continue
        if tag in RAW:
            end = _RAW_END[tag].search(html, at)
            if tag == "title" and not root.attrs:
                root.attrs = " ".join(unescape(html[at : end.start() if end else n]).split())
            at = end.end() if end else n
            continue
        if tag == "br" or tag == "hr":
            node.kids.append(" ")
        if tag in _VOID:
            continue
        block = tag in BLOCKS
        if block and opened["p"] > 0:
            up = node
            while not up.block:
                up = up.parent
            if up.tag == "p":
                node = close(up)
        if tag in CLOSES and any(opened[x] > 0 for x in CLOSES[tag]):
            up = node
            while up is not None and up.tag not in CLOSES[tag] and up.tag not in _SCOPES[tag]:
                up = up.parent
            if up is not None and up.tag in CLOSES[tag]:
                node = close(up)
        if tag == "a" and node.tag == "a":
            node = close(node)
        dropped = tag in DROPPED
        if not block and (attrs.endswith("/") or not (dropped or tag == "a" or (attrs and _TELLING.search(attrs)))):
            continue
        child = Node(tag, attrs, node, block)
        node.kids.append(child)
        opened[tag] += 1
        node = child
    return root
