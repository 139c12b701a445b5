"""URL functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Hosts of archives and of internal links.
ARCHIVE = r"(?i)web\.archive\.org|archive\.today|archive\.is|archive\.ph|webcitation\.org"
INTERNAL = r"(?i)^https?://[a-z0-9-]+\.(?:wikipedia|wikimedia|wiktionary|wikidata|wikisource|wikiquote|wikibooks|wikinews|wikiversity|wikivoyage)\.org/wiki/"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_archive(c: Column | str) -> Column:
    return F.coalesce(_col(c).rlike(ARCHIVE), F.lit(False))


def is_internal(c: Column | str) -> Column:
    own = _col(c)
    return F.coalesce(own.rlike("(?i)Special:BookSources") | own.rlike(INTERNAL), F.lit(False))


def is_google_books(c: Column | str) -> Column:
    return F.coalesce(_col(c).rlike(r"books\.google\."), F.lit(False))


def archive_parts(c: Column | str) -> Column:
    """(timestamp, original_url) of a web.archive.org snapshot, else null."""
    own, pattern = _col(c), r"^https?://web\.archive\.org/web/(\d+)(?:id_)?/(https?://.+)$"
    return F.when(own.rlike(pattern), F.struct(F.regexp_extract(own, pattern, 1).alias("timestamp"), F.regexp_extract(own, pattern, 2).alias("original_url")))


def raw_archive(c: Column | str) -> Column:
    """The address of a snapshot's raw content, else null."""
    parts = archive_parts(c)
    return F.when(parts.isNotNull(), F.concat(F.lit("https://web.archive.org/web/"), parts["timestamp"], F.lit("id_/"), parts["original_url"]))


def footnote_url(links: Column | str) -> Column:
    """Of a footnote's links in order: the first web.archive.org one, else the first live one, else the first; internal ones never."""
    usable = F.filter(_col(links), lambda x: F.coalesce(x.rlike("^http"), F.lit(False)) & ~is_internal(x))
    first = lambda keep: F.get(F.filter(usable, keep), F.lit(0))
    return F.coalesce(first(lambda x: x.rlike(r"web\.archive\.org")), first(lambda x: ~is_archive(x)), F.get(usable, F.lit(0)))


def dataset_url(links: Column | str) -> Column:
    """The dataset's rule: any archive first, then a link outside the wikis, then the first http link."""
    own = _col(links)
    http = F.filter(own, lambda x: F.coalesce(x.rlike("^http"), F.lit(False)))
    first = lambda a, keep: F.get(F.filter(a, keep), F.lit(0))
    outside = lambda x: ~x.contains("wikipedia.org") & ~x.contains("wikimedia.org")
    return F.coalesce(first(own, lambda x: x.rlike(ARCHIVE.removeprefix("(?i)"))), first(http, outside), F.get(http, F.lit(0)))


def page_number(c: Column | str) -> Column:
    """The page that a footnote names; word borders are ASCII ones."""
    found = F.regexp_extract(_col(c), r"(?i)(?<![A-Za-z0-9_])p(?:p|ages?)?\.?\s*([0-9]+)", 1)
    return F.when(found != "", found.try_cast("int"))


def fragment(c: Column | str) -> Column:
    """What follows the first #, null if nothing does."""
    own = _col(c)
    return F.when(F.instr(own, "#") > 0, F.nullif(F.substr(own, F.instr(own, "#") + 1), F.lit("")))


def source_key(url: Column | str, page: Column | str) -> Column:
    """The key under which a fetched source is kept."""
    number = _col(page)
    return F.when(F.coalesce(number, F.lit(0)) != 0, F.concat(_col(url), F.lit("|page="), number.cast("string"))).otherwise(_col(url))


def host(c: Column | str) -> Column:
    """Lower-case host name, '' where there is none."""
    return F.lower(F.regexp_extract(F.coalesce(_col(c), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def encode_component(c: Column | str) -> Column:
    """Percent-encoding that leaves A-Z a-z 0-9 - _ . ! ~ * ' ( ) bare."""
    out = F.replace(F.url_encode(_col(c)), F.lit("+"), F.lit("%20"))
    for code, char in (("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.replace(out, F.lit(code), F.lit(char))
    return out


def wiki_title(url: Column | str) -> Column:
    """The article named by a ``title=`` parameter or a /wiki/ path, with spaces."""
    own = _col(url)
    raw = F.when(own.contains("title="), F.regexp_extract(own, "title=([^&#]*)", 1)).otherwise(F.regexp_extract(own, r"/wiki/([^?#]*)", 1))
    return F.nullif(F.replace(F.try_url_decode(raw), F.lit("_"), F.lit(" ")), F.lit(""))


def rest_url(title: Column | str, revision: Column | str, wiki: str = "en.wikipedia.org") -> Column:
    """The address of an article's rendered html."""
    name = encode_component(F.replace(_col(title), F.lit(" "), F.lit("_")))
    base = F.concat(F.lit(f"https://{wiki}/api/rest_v1/page/html/"), name)
    number = _col(revision)
    return F.when(number.isNotNull(), F.concat(base, F.lit("/"), number.cast("string"))).otherwise(base)


def query_url(base: str, fields: list[tuple[str, Column | str]]) -> Column:
    """``base`` with form-encoded parameters in order; null and empty values are left out."""
    parts = [F.when(F.coalesce(_col(c).cast("string"), F.lit("")) != "", F.concat(F.url_encode(F.lit(name)), F.lit("="), F.url_encode(_col(c).cast("string")))) for name, c in fields]
    return F.concat(F.lit(base + "?"), F.concat_ws("&", *parts))
