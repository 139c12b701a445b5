"""Citations read from article html: one parser pass to a table of tokens, the rest as windows and joins.

``tokens`` reads each article once into a row, linear in the article's length
(nested elements are ranges of one numbering):

* ``pieces``: the article's text, cut wherever a range that is asked for begins
  or ends, so that a text is a slice of them;
* ``anchors``: the links inside references of a container, with number, address
  and section; ``first`` to ``last`` are the pieces from the beginning of the
  reference's run to it, ``opens`` to ``closes`` those of its container, and
  ``shows`` to ``hides`` those that a dataset's review shows;
* ``places``: references once more for each further container around them;
* ``notes``: elements that a reference or a short cite points to, their text,
  their links and those of the list item around them.

Runs of adjacent references are islands of one container with white space at
most between them, and a claim is what stands in its island up to its reference.
A citation belongs to the run in its own container; where containers with
references of their own nest, the outermost such run counts.

Texts stay where they were read: thresholds are tested beside the pieces, numbers,
groups and addresses are found on rows without texts, and the pieces meet these
once, at the end.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corrobora.functions.text import JS_SPACE, cleaned, collapse, js_trim
from corrobora.functions.urls import footnote_url, fragment, page_number
from corrobora.sources.shared import materialize

LEAST_CLAIM = 10
#: Elements that hold claims; those whose text a dataset's review shows; void elements; elements that end a paragraph.
CONTAINERS = frozenset(("p", "li", "td", "div", "section"))
REVIEWED = frozenset(("p", "li", "td", "th", "dd"))
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCKS = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
_CLOSES = {"li": ("ul", "ol"), "td": ("table", "tr"), "th": ("table", "tr"), "tr": ("table",), "dd": ("dl",), "dt": ("dl",)}

_BLANK = re.compile(f"[{JS_SPACE}]*")

#: The lists of an article's row, by the kind of token.
_LISTS = {
    "places": "wrapper int, box int, island int",
    "anchors": "at int, wrapper int, box int, island int, first int, last int, opens int, closes int, shows int, hides int, name string, text string, href string, section int",
    "notes": "name string, text string, links array<string>, item array<string>",
}
TOKENS = "art long, doc_id string, pieces array<string>, " + ", ".join(f"{k} array<struct<{v.replace(' ', ':').replace(',:', ', ')}>>" for k, v in _LISTS.items())
_TYPES = {"int": pa.int32(), "string": pa.string(), "array<string>": pa.list_(pa.string())}
_ARROW = pa.schema([("art", pa.int64()), ("doc_id", pa.string()), ("pieces", _TYPES["array<string>"]), *((k, pa.list_(pa.struct([(c.split()[0], _TYPES[c.split()[1]]) for c in v.split(", ")]))) for k, v in _LISTS.items())])


class Element:
    """An element: its range of text, its range of element numbers, and the nearest containers around it, itself included."""

    __slots__ = ("tag", "attrs", "start", "end", "order", "last", "box", "wrap", "item", "shown", "over")

    def __init__(self, tag: str, attrs: dict[str, str], parent: "Element | None", start: int, order: int):
        self.tag, self.attrs, self.start, self.end, self.order, self.last, self.over = tag, attrs, start, start, order, order, parent
        up = lambda name, own: self if own else getattr(parent, name, None)
        self.box, self.shown, self.item = up("box", tag in CONTAINERS), up("shown", tag in REVIEWED), up("item", tag == "li")
        self.wrap = up("wrap", "reference" in attrs.get("class", "").split())


class Article(HTMLParser):
    """Elements in document order, numbered, over one string of text."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.length = 0
        self.elements: list[Element] = []
        self.stack: list[Element] = []
        self.open: Counter[str] = Counter()
        self.feed(html)
        self.close()
        while self.stack:
            self._leave()
        self.text = "".join(self.parts)

    def handle_data(self, data: str) -> None:
        self.parts.append(data)
        self.length += len(data)

    def _leave(self) -> None:
        gone = self.stack.pop()
        self.open[gone.tag] -= 1
        gone.end, gone.last = self.length, len(self.elements) - 1

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in _BLOCKS and self.open["p"]:
            self.handle_endtag("p")
        if self.open[tag] and tag in _CLOSES:
            for x in reversed(self.stack):
                if x.tag in _CLOSES[tag]:
                    break
                if x.tag == tag:
                    self.handle_endtag(tag)
                    break
        element = Element(tag, {k: v or "" for k, v in attrs}, self.stack[-1] if self.stack else None, self.length, len(self.elements))
        self.elements.append(element)
        if tag not in _VOID:
            self.stack.append(element)
            self.open[tag] += 1

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if self.stack and self.stack[-1] is self.elements[-1]:
            self._leave()

    def handle_endtag(self, tag: str) -> None:
        if self.open[tag]:
            while self.stack[-1].tag != tag:
                self._leave()
            self._leave()


def article_tokens(html: str) -> Iterator[dict]:
    """The tokens of one article, without its name; the pieces of its text come last."""
    page = Article(html)
    wrappers = [e for e in page.elements if e.wrap is e]
    anchors = [e for e in page.elements if e.tag == "a" and e.over is not None and e.over.wrap is not None]
    headings = [e.start for e in page.elements if e.tag in ("h2", "h3", "h4", "h5", "h6")]
    orders = [w.order for w in wrappers]
    boxes = {w.box.order: w.box for w in wrappers if w.box is not None}
    runs: dict[int, tuple[int, int]] = {}
    for box in boxes.values():
        before, island, begin = None, 0, box.start
        for w in wrappers[bisect_right(orders, box.order) : bisect_right(orders, box.last)]:
            if before is not None and not _BLANK.fullmatch(page.text, before.end, max(before.end, w.start)):
                island, begin = island + 1, before.end
            yield {"kind": "place", "wrapper": w.order, "box": box.order, "own": w.box is box, "island": island}
            if w.box is box:
                runs[w.order] = (island, begin)
            before = w
    wanted, found = set(), []
    for a in anchors:
        w, href = a.over.wrap, a.attrs.get("href", "")
        wanted.add(href.partition("#")[2])
        if w.box is not None:
            island, begin = runs[w.order]
            shown = (w.shown.start, w.shown.end) if w.shown else (0, 0)
            found.append((a, w, href, island, (begin, w.start, w.box.start, w.box.end, *shown)))
    cuts = sorted({0, len(page.text)}.union(*(x[-1] for x in found)))
    piece = {c: i for i, c in enumerate(cuts)}
    for a, w, href, island, ends in found:
        first, last, opens, closes, shows, hides = (piece[c] for c in ends)
        yield {
            "kind": "anchor", "at": a.order, "wrapper": w.order, "box": w.box.order, "island": island, "first": first, "last": last, "opens": opens, "closes": closes, "shows": shows, "hides": hides,
            "name": w.attrs.get("id"), "text": page.text[a.start : a.end], "href": href, "section": bisect_right(headings, w.start),
        }
    links = [e for e in page.elements if e.tag == "a" and "href" in e.attrs]
    places = [e.order for e in links]
    ids: dict[str, Element] = {}
    for e in page.elements:
        if "id" in e.attrs:
            ids.setdefault(e.attrs["id"], e)

    def within(e: Element) -> list[str]:
        return [x.attrs["href"] for x in links[bisect_left(places, e.order + 1) : bisect_right(places, e.last)]]

    wanted |= {x.attrs["href"][1:] for x in links if x.attrs["href"].startswith("#CITEREF")}
    for name in sorted(wanted & ids.keys()):
        e = ids[name]
        yield {"kind": "note", "name": name, "text": page.text[e.start : e.end], "links": within(e), "item": within(e.item) if e.item is not None and e.item is not e else []}
    yield {"kind": "text", "pieces": [page.text[i:j] for i, j in zip(cuts, cuts[1:])]}


def _read(batches: Iterator[pa.RecordBatch], rows: int = 20_000, chars: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    """Articles as rows, in batches of about so many tokens or characters of html."""
    out: list[dict] = []
    size = length = 0
    for batch in batches:
        for art, doc_id, html in zip(*(batch.column(c) for c in ("art", "doc_id", "html")), strict=True):
            row = {"art": art.as_py(), "doc_id": doc_id.as_py(), "places": [], "anchors": [], "notes": []}
            whole = html.as_py() or ""
            for token in article_tokens(whole):
                size += 1
                if token["kind"] == "text":
                    row["pieces"] = token["pieces"]
                elif token["kind"] != "place" or not token["own"]:  # an own place is told by its anchors
                    row[token["kind"] + "s"].append(token)
            out.append(row)
            length += len(whole)
            if size >= rows or length >= chars:
                yield pa.RecordBatch.from_pylist(out, _ARROW)
                out, size, length = [], 0, 0
    if out:
        yield pa.RecordBatch.from_pylist(out, _ARROW)


def tokens(articles: DataFrame) -> DataFrame:
    """The tokens of the articles' html (columns doc_id, html), a row an article, written once; ``art`` numbers the articles."""
    named = articles.select(F.monotonically_increasing_id().alias("art"), F.col("doc_id").cast("string").alias("doc_id"), "html")
    return materialize(named.mapInArrow(_read, TOKENS), "tokens")


def _text(first: str, last: str) -> Column:
    """The text of a range of pieces."""
    return F.array_join(F.slice("pieces", F.col(first) + 1, F.col(last) - F.col(first)), "")


def cited(table: DataFrame, least: int = LEAST_CLAIM) -> DataFrame:
    """Citations with a claim of at least ``least`` characters, as ranges of pieces.

    What is cleaned away is white space or begins with a bracket, so that enough other characters before any bracket settle most claims.
    """
    anchors = table.select("art", "pieces", F.inline("anchors")).withColumn("ref_id", fragment("href")).where("ref_id IS NOT NULL")
    enough, own, box = max(10, least), _text("first", "last"), _text("opens", "closes")
    said, whole = F.char_length(cleaned(own)), F.char_length(cleaned(box))
    kept = anchors.where(own.rlike(rf"^(?:[{JS_SPACE}]*[^{JS_SPACE}\[]){{{enough}}}") | (said >= enough) | ((said < 10) & (whole >= least)))
    return kept.withColumn("citation_number", js_trim(F.regexp_replace("text", r"[\[\]]", ""))).drop("pieces", "text", "href")


def numbered(citations: DataFrame, table: DataFrame) -> DataFrame:
    """Adds position, occurrences and group: the outermost run that holds the reference and a citation of the run's own container. Of several links in one reference the last is a member.

    All windows are of one article or less, so that its rows meet once.
    """
    further = table.select("art", F.inline("places")).withColumn("own", F.lit(False))
    rows = citations.withColumn("own", F.lit(True)).unionByName(further, allowMissingColumns=True).repartition("art")
    run, reference = Window.partitionBy("art", "box", "island"), Window.partitionBy("art", "wrapper")
    rows = rows.withColumns({"last_at": F.max("at").over(reference), "holds": F.max("own").over(run)})
    rows = rows.withColumn("home", F.min(F.when(F.col("holds"), F.struct("box", "island"))).over(reference)).where("own").drop("box", "island", "own", "holds")
    rows = rows.withColumns({"box": F.col("home.box"), "island": F.col("home.island"), "member": F.col("at") == F.col("last_at")}).drop("home", "last_at")
    group = Window.partitionBy("art", "box", "island", "member").orderBy("wrapper")
    whole = group.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    of_group = {
        "group_id": F.first(F.coalesce(F.nullif("name", F.lit("")), "ref_id")).over(whole), "group_size": F.count("*").over(whole).cast("int"),
        "group_index": F.row_number().over(group) - 1, "group_citation_numbers": F.collect_list("citation_number").over(whole),
    }
    rows = rows.withColumns({k: F.when(F.col("member"), v) for k, v in of_group.items()}).drop("box", "island", "member", "name", "wrapper")
    same = Window.partitionBy("art", "citation_number")
    return rows.withColumns({"pos": F.row_number().over(Window.partitionBy("art").orderBy("at")) - 1, "occurrence": F.row_number().over(same.orderBy("at")), "total_occurrences": F.count("*").over(same).cast("int")})


def resolved(citations: DataFrame, table: DataFrame) -> DataFrame:
    """Adds url and page_num: the footnote's own link, else the full citation's that a short cite names, else that of the list item around it."""
    notes = table.select("art", F.inline("notes"))
    foot = notes.select("art", F.col("name").alias("ref_id"), footnote_url("links").alias("direct"), page_number(collapse("text")).alias("page_num"), F.substring(F.get(F.filter("links", lambda x: x.startswith("#CITEREF")), F.lit(0)), 2, 1 << 30).alias("cite"))
    full = notes.where(F.col("name").startswith("CITEREF")).select("art", F.col("name").alias("cite"), F.coalesce(footnote_url("links"), footnote_url("item")).alias("second"))
    found = foot.join(full, ["art", "cite"], "left").select("art", "ref_id", F.coalesce("direct", "second").alias("url"), "page_num")
    return citations.join(found, ["art", "ref_id"], "left")


def extract_citations(articles: DataFrame, least: int = LEAST_CLAIM, containers: bool = True) -> DataFrame:
    """One row a citation of the articles' html (columns doc_id, html). ``container_text`` is what a dataset's review shows, left out without ``containers``."""
    table = tokens(articles)
    found = numbered(resolved(cited(table, least), table), table)
    texts = {"claim_text": F.when(F.char_length("said") < 10, cleaned(_text("opens", "closes"))).otherwise(F.col("said"))}
    if containers:
        texts["container_text"] = collapse(_text("shows", "hides"))
    names = ["doc_id", "pos", "ref_id", "citation_number", "claim_text", "url", "page_num", "group_id", "group_size", "group_index", "group_citation_numbers", "section", "occurrence", "total_occurrences"]
    whole = found.join(table.select("art", "doc_id", "pieces"), "art").withColumn("said", cleaned(_text("first", "last")))
    return whole.select(*(texts[n].alias(n) if n in texts else n for n in (*names, *(["container_text"] if containers else []))))


def by_number(citations: DataFrame, number: str, occurrence: int = 1) -> DataFrame:
    """Of each article, the given occurrence of a citation number; its first where there are fewer."""
    wanted = F.when(F.col("total_occurrences") >= occurrence, F.col("occurrence") == occurrence).otherwise(F.col("occurrence") == 1)
    return citations.where((F.col("citation_number") == number) & wanted)
