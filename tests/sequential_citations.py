"""A sequential reader of citations, for comparison with the joins."""

from __future__ import annotations

import re
from html.parser import HTMLParser

from corrobora.functions.quotes import _SPACE, _trim
from corrobora.functions.text import MARKERS

LEAST_CLAIM = 10
_MARKERS = re.compile(MARKERS)
_PAGE = re.compile(r"(?i)(?<![A-Za-z0-9_])p(?:p|ages?)?\.?\s*([0-9]+)")
_ARCHIVE = re.compile(r"web\.archive\.org|archive\.today|archive\.is|archive\.ph|webcitation\.org", re.I)
_INTERNAL = re.compile(r"^https?://[a-z0-9-]+\.(?:wikipedia|wikimedia|wiktionary|wikidata|wikisource|wikiquote|wikibooks|wikinews|wikiversity|wikivoyage)\.org/wiki/", re.I)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_CONTAINERS = frozenset(("p", "li", "td", "div", "section"))
_BLOCKS = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())


class Element:
    __slots__ = ("tag", "attrs", "parent", "start", "end", "order")

    def __init__(self, tag: str, attrs: dict[str, str], parent: "Element | None", start: int, order: int):
        self.tag, self.attrs, self.parent, self.start, self.end, self.order = tag, attrs, parent, start, start, order

    def has_class(self, name: str) -> bool:
        return name in self.attrs.get("class", "").split()

    def closest(self, test) -> "Element | None":
        node: Element | None = self
        while node is not None and not test(node):
            node = node.parent
        return node

    def inside(self, other: "Element") -> bool:
        return self.closest(lambda x: x is other) is not None


class Article(HTMLParser):
    """Elements with their places in the text."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.length = 0
        self.elements: list[Element] = []
        self.ids: dict[str, Element] = {}
        self.stack: list[Element] = []
        self.feed(html)
        self.close()
        while self.stack:
            self._leave()
        self.text = "".join(self.parts)

    def handle_data(self, data: str) -> None:
        self.parts.append(data)
        self.length += len(data)

    def _leave(self) -> None:
        self.stack.pop().end = self.length

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        closes = {"li": ("li", ("ul", "ol")), "td": ("td", ("table", "tr")), "th": ("th", ("table", "tr")), "tr": ("tr", ("table",))}.get(tag)
        if tag in _BLOCKS and any(x.tag == "p" for x in self.stack):
            self.handle_endtag("p")
        if closes:
            for x in reversed(self.stack):
                if x.tag in closes[1]:
                    break
                if x.tag == closes[0]:
                    self.handle_endtag(closes[0])
                    break
        element = Element(tag, {k: v or "" for k, v in attrs}, self.stack[-1] if self.stack else None, self.length, len(self.elements))
        self.elements.append(element)
        if "id" in element.attrs:
            self.ids.setdefault(element.attrs["id"], element)
        if tag not in _VOID:
            self.stack.append(element)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if self.stack and self.stack[-1] is self.elements[-1]:
            self._leave()

    def handle_endtag(self, tag: str) -> None:
        if any(x.tag == tag for x in self.stack):
            while self.stack[-1].tag != tag:
                self._leave()
            self._leave()

    def of(self, element: Element) -> str:
        return self.text[element.start : element.end]

    def within(self, element: Element, test) -> list[Element]:
        return [x for x in self.elements[element.order + 1 :] if test(x) and x.inside(element)]


def _collapse(text: str) -> str:
    return _trim(re.sub(f"{_SPACE}+", " ", text))


def clean_claim(text: str) -> str:
    return _collapse(_MARKERS.sub("", re.sub(f"{_SPACE}+", " ", re.sub(r"\[[0-9]+\]", "", text))))


def note_url(links: list[str]) -> str | None:
    usable = [x for x in links if x.startswith("http") and not _INTERNAL.search(x) and not re.search("Special:BookSources", x, re.I)]
    return next((x for x in usable if "web.archive.org" in x), None) or next((x for x in usable if not _ARCHIVE.search(x)), None) or next(iter(usable), None)


def collect(html: str, least: int = LEAST_CLAIM) -> list[dict]:
    """All citations of an article, in order."""
    page = Article(html)
    anchors = [(a, w) for a in page.elements if a.tag == "a" and (w := a.parent.closest(lambda x: x.has_class("reference")) if a.parent else None)]
    wrappers = [e for e in page.elements if e.has_class("reference")]
    headings = [e.start for e in page.elements if re.fullmatch("h[2-6]", e.tag)]
    islands: dict[int, list[Element]] = {}
    starts: dict[int, int] = {}

    def links(e: Element) -> list[str]:
        return [x.attrs["href"] for x in page.within(e, lambda x: x.tag == "a" and "href" in x.attrs)]

    def place(wrapper: Element) -> Element | None:
        """Sets the island of references around a wrapper and where its claim starts; returns its container."""
        box = wrapper.closest(lambda x: x.tag in _CONTAINERS)
        if box is None:
            islands[wrapper.order], starts[wrapper.order] = [wrapper], -1
            return None
        if wrapper.order not in islands:
            run: list[Element] = []
            begin = box.start
            for ref in [r for r in wrappers if r.inside(box)]:
                if run and _trim(page.text[run[-1].end : ref.start]):
                    begin, run = run[-1].end, []
                run.append(ref)
                islands[ref.order], starts[ref.order] = run, begin
        return box

    def url_and_page(ref_id: str) -> tuple[str | None, int | None]:
        note = page.ids.get(ref_id)
        if note is None:
            return None, None
        number = _PAGE.search(page.of(note))
        found = note_url(links(note))
        if not found and (cite := next((x for x in links(note) if x.startswith("#CITEREF")), None)) and (full := page.ids.get(cite[1:])):
            item = full.closest(lambda x: x.tag == "li")
            found = note_url(links(full)) or (note_url(links(item)) if item is not None and item is not full else None)
        return found, int(number[1]) if number else None

    out: list[dict] = []
    by_wrapper: dict[int, dict] = {}
    for a, wrapper in anchors:
        ref_id = a.attrs.get("href", "").partition("#")[2]
        if not ref_id:
            continue
        box = place(wrapper)
        claim = clean_claim(page.text[starts[wrapper.order] : wrapper.start]) if box is not None else ""
        if box is not None and len(claim) < least:
            claim = clean_claim(page.of(box))
        if len(claim) < least:
            continue
        url, number = url_and_page(ref_id)
        row = {
            "pos": len(out), "ref_id": ref_id, "citation_number": _trim(re.sub(r"[\[\]]", "", page.of(a))), "claim_text": claim, "url": url, "page_num": number,
            "section": sum(h <= wrapper.start for h in headings), "wrapper": wrapper,
        }
        out.append(row)
        by_wrapper[wrapper.order] = row
    for run in {id(r): r for r in islands.values()}.values():
        members = [by_wrapper[w.order] for w in run if w.order in by_wrapper]
        for i, row in enumerate(members):
            first = members[0]
            row |= {"group_id": first["wrapper"].attrs.get("id") or first["ref_id"], "group_size": len(members), "group_index": i, "group_citation_numbers": [m["citation_number"] for m in members]}
    totals: dict[str, int] = {}
    for row in out:
        totals[row["citation_number"]] = row["occurrence"] = totals.get(row["citation_number"], 0) + 1
    for row in out:
        row["total_occurrences"] = totals[row["citation_number"]]
        row.pop("wrapper")
    return out


