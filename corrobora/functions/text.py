"""String functions with JavaScript's idea of white space, as column expressions.

Lengths are code points throughout.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: What JavaScript's \s and trim() treat as white space, as a Java character class body.
JS_SPACE = r"\t\n\u000B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"
#: The same for RE2 (DuckDB).
JS_SPACE_RE2 = r"\t\n\x{0B}\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
#: Runs of white space in Java's syntax; visible ASCII is ruled out by one comparison.
_SPACES = f"[[^!-~]&&[{JS_SPACE}]]+"
#: Maintenance markers in claims.
MARKERS = (
    r"(?i)\[(failed verification|verification needed|citation needed|better source[^\]]*|dubious[^\]]*|unreliable source[^\]]*|clarification needed|disputed[^\]]*|page needed"
    r"|when\??|where\??|who\??|why\??|by whom\??|according to whom\??|original research[^\]]*|specify[^\]]*|vague|opinion|fact)\]"
)
MAX_LOGGED = 2000
#: Texts of a batch that are Python objects at the same time.
SLICE = 64


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def js_trim(c: Column | str) -> Column:
    return F.regexp_replace(_col(c), f"^[{JS_SPACE}]+|[{JS_SPACE}]+$", "")


def collapse(c: Column | str) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(_col(c), f"[{JS_SPACE}]+", " "))


def cleaned(c: Column | str) -> Column:
    """A text without citation numbers and maintenance markers; null is empty."""
    spaced = F.regexp_replace(F.regexp_replace(F.coalesce(_col(c), F.lit("")), r"\[[0-9]+\]", ""), _SPACES, " ")
    return F.trim(F.regexp_replace(F.regexp_replace(spaced, MARKERS, ""), " {2,}", " "))


def clean_claim(text: Column | str, container: Column | str) -> Column:
    """A claim without citation numbers and maintenance markers; the container's text where under 10 characters are left."""
    own = cleaned(text)
    return F.when(F.char_length(own) < 10, cleaned(container)).otherwise(own)


def truncate_for_log(c: Column | str, most: int = MAX_LOGGED) -> Column:
    """Trimmed; blank is null; longer than ``most`` ends in an ellipsis."""
    own = js_trim(_col(c).cast("string"))
    return F.when(F.char_length(own) == 0, None).when(F.char_length(own) > most, F.concat(F.substring(own, 1, most - 1), F.lit("…"))).otherwise(own)


def excerpt(c: Column | str, most: int, mark: str = "…") -> Column:
    own = _col(c)
    return F.when(F.char_length(own) > most, F.concat(F.substring(own, 1, most), F.lit(mark))).otherwise(own)


def revision_id(c: Column | str) -> Column:
    """A positive integer that a double holds exactly, else null."""
    own = js_trim(_col(c).cast("string"))
    number = own.try_cast("decimal(38,0)")
    return F.when(own.rlike("^[0-9]+$") & (number > 0) & (number <= 9007199254740991), number.cast("long"))


def check_id() -> Column:
    """Eight random hexadecimal digits; write them before they are used twice."""
    return F.substring(F.replace(F.uuid(), F.lit("-"), F.lit("")), 1, 8)


@F.arrow_udf(StringType())
def _composed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Texts are Python objects a few at a time, whatever the batch holds, and nothing of a batch is kept."""
    for texts in batches:
        made = [pa.array((x and unicodedata.normalize("NFC", x) for x in texts[i : i + SLICE].to_pylist()), pa.string()) for i in range(0, len(texts), SLICE)]
        yield pa.concat_arrays(made) if made else pa.array([], pa.string())
        del texts, made
        pa.default_memory_pool().release_unused()


def nfc(c: Column | str) -> Column:
    """Canonical composition, which Spark has no function for; texts of characters below U+0300 are composed already and stay in the JVM."""
    own = _col(c)
    open_ = own.rlike(r"[^\x00-\u02FF]")
    return F.coalesce(_composed(F.when(open_, own)), own)


def normal_claim(c: Column | str) -> Column:
    """A claim as it is compared: composed, white space collapsed, trimmed."""
    return collapse(nfc(F.coalesce(_col(c), F.lit(""))))


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def claim_hash(c: Column | str) -> Column:
    """SHA-256 of the normal form of a claim, as 32 bytes; null hashes as the empty text."""
    return _digest(normal_claim(c))


def source_url_hash(c: Column | str) -> Column:
    """SHA-256 of the trimmed address."""
    return _digest(js_trim(F.coalesce(_col(c), F.lit(""))))


MOST_MANUAL = 80_000


def manual_source(c: Column | str, most: int = MOST_MANUAL) -> Column:
    """A struct of a source text that a person entered, framed, and whether it was cut at ``most`` characters; blank is null."""
    own = js_trim(F.coalesce(_col(c), F.lit("")))
    framed = F.concat(F.lit("Manual source text:\n\n"), F.substring(own, 1, most))
    return F.when(own != "", F.struct(framed.alias("content"), (F.char_length(own) > most).alias("truncated")))


def source_text(c: Column | str) -> Column:
    """The source's body without the framing that a fetcher or an editor put before it."""
    own = _col(c)
    manual = own.startswith("Manual source text:")
    framed = own.contains("Source Content:\n")
    return (
        F.when(manual, F.regexp_replace(own, rf"^Manual source text:[{JS_SPACE}]*\n[{JS_SPACE}]*", ""))
        .when(framed, F.regexp_extract(own, r"(?s)Source Content:\n(.*)", 1))
        .otherwise(own)
    )


def html_text(c: Column | str, least: int = 100, most: int = 50_000) -> Column:
    """The text of the first article, main or body element by tags alone; null when it has ``least`` characters or fewer."""
    own = F.coalesce(_col(c), F.lit(""))

    def inside(tag: str) -> Column:
        return F.regexp_extract(own, rf"(?is)<{tag}[^>]*>(.*?)</{tag}>", 1)

    def has(tag: str) -> Column:
        return own.rlike(rf"(?is)<{tag}[^>]*>.*?</{tag}>")

    body = F.when(has("article"), inside("article")).when(has("main"), inside("main")).when(has("body"), inside("body"))
    text = F.regexp_replace(F.regexp_replace(body, r"(?is)<script[^>]*>.*?</script>", ""), r"(?is)<style[^>]*>.*?</style>", "")
    text = collapse(F.regexp_replace(text, "<[^>]+>", " "))
    return F.when(F.char_length(text) > least, F.substring(text, 1, most))


def extraction_status(claim: Column | str, url: Column | str, source: Column | str) -> Column:
    """The first thing that is missing, or ``complete``."""

    def missing(c: Column | str) -> Column:
        return F.coalesce(_col(c), F.lit("")) == ""

    return F.when(missing(claim), "claim_extraction_failed").when(missing(url), "no_source_url").when(missing(source), "source_fetch_failed").otherwise("complete")


def escape_html(c: Column | str) -> Column:
    own = F.coalesce(_col(c).cast("string"), F.lit(""))
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        own = F.replace(own, F.lit(a), F.lit(b))
    return own


def nowiki(c: Column | str) -> Column:
    """Wikitext that shows the text as it is; blank stays blank."""
    own = collapse(F.regexp_replace(F.coalesce(_col(c), F.lit("")), rf"(?i)<[{JS_SPACE}]*/?[{JS_SPACE}]*nowiki[{JS_SPACE}]*/?[{JS_SPACE}]*>", ""))
    return F.when(own == "", "").otherwise(F.concat(F.lit("<nowiki>"), own, F.lit("</nowiki>")))


def wikitable_cell(c: Column | str) -> Column:
    return F.replace(collapse(F.coalesce(_col(c), F.lit(""))), F.lit("|"), F.lit("{{!}}"))


def user_prompt(claim: Column | str, source: Column | str) -> Column:
    return F.concat(F.lit('Claim: "'), _col(claim), F.lit('"\n\nSource text:\n'), source_text(source))


def group_prompt(claim: Column | str, sources: Column | str) -> Column:
    return F.concat(F.lit('Claim: "'), _col(claim), F.lit('"\n\nThe following sources are all cited for this claim. Evaluate whether they support it together.\n\n'), _col(sources))


def minutes_left(citations: Column, groups: Column) -> Column:
    """Whole minutes a batch is expected to take: 7 s a citation, 8 s a group."""
    return F.ceil((citations * 7 + groups * 8) / 60)


def percent(part: Column, whole: Column) -> Column:
    """100 * part / whole, 0 where there is nothing."""
    return F.coalesce(F.try_divide(part, whole), F.lit(0.0)) * 100


def share(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part, whole), F.lit(0.0))
