"""Quotes held against their sources.

``check`` works in native expressions as far as they reach: blank and verbatim
quotes, which is where most rows end. Only the rest needs Unicode
normalisation and a moving cursor, and goes to Python in Arrow batches.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corrobora.functions.text import JS_SPACE

LEAST = 12
_SEGMENT = T.StructType([T.StructField("text", T.StringType()), T.StructField("found", T.BooleanType()), T.StructField("located", T.BooleanType())])
SCHEMA = T.StructType([T.StructField("status", T.StringType()), T.StructField("verified", T.BooleanType()), T.StructField("verified_text", T.StringType()), T.StructField("segments", T.ArrayType(_SEGMENT))])

#: Named entities that are decoded.
NAMED = {
    "quot": '"', "apos": "'", "amp": "&", "lt": "<", "gt": ">", "nbsp": "\u00a0",
    "lsquo": "\u2018", "rsquo": "\u2019", "sbquo": "\u201a", "ldquo": "\u201c", "rdquo": "\u201d", "bdquo": "\u201e",
    "ndash": "\u2013", "mdash": "\u2014", "minus": "\u2212", "shy": "\u00ad", "hellip": "\u2026",
    "prime": "\u2032", "Prime": "\u2033", "laquo": "\u00ab", "raquo": "\u00bb",
    "ensp": "\u2002", "emsp": "\u2003", "thinsp": "\u2009", "middot": "\u00b7", "bull": "\u2022", "deg": "\u00b0",
}
#: Entities of U+00C0 to U+00FF in order.
LATIN1 = (
    "Agrave Aacute Acirc Atilde Auml Aring AElig Ccedil Egrave Eacute Ecirc Euml Igrave Iacute Icirc Iuml ETH Ntilde Ograve Oacute Ocirc Otilde Ouml times "
    "Oslash Ugrave Uacute Ucirc Uuml Yacute THORN szlig agrave aacute acirc atilde auml aring aelig ccedil egrave eacute ecirc euml igrave iacute icirc iuml "
    "eth ntilde ograve oacute ocirc otilde ouml divide oslash ugrave uacute ucirc uuml yacute thorn yuml"
)
_ENTITIES = NAMED | {name: chr(0xC0 + i) for i, name in enumerate(LATIN1.split())}
_SPACE = "[" + JS_SPACE + "]"
_ENTITY = re.compile(r"&(?:#([0-9]+)|#[xX]([0-9a-fA-F]+)|([a-zA-Z][a-zA-Z0-9]{1,10}));")
#: Characters folded before texts are compared.
_FOLD = str.maketrans(
    dict.fromkeys("\u2018\u2019\u201a\u201b\u2032\u00b4`'\u02bb\u02bc\u201c\u201d\u201e\u201f\u2033\u00ab\u00bb\"", '"')
    | dict.fromkeys("\u2010\u2011\u2012\u2013\u2014\u2015\u2212", "-")
    | dict.fromkeys("\u00ad\u200b\u200c\u200d\ufeff", None)
    | dict.fromkeys([chr(c) for c in (0xA0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000)], " ")
)
_ELLIPSIS = re.compile(rf"\[{_SPACE}*(?:\.\.\.|\u2026){_SPACE}*\]|\.\.\.\.?|\u2026")
_PAIRS = [('"', '"'), ("'", "'"), ("\u201c", "\u201d"), ("\u2018", "\u2019"), ("\u00ab", "\u00bb")]
#: JavaScript's white space, and each folded character with what takes its place.
_SPACES = "\t\n\v\f\r \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
_REPLACED = {c: "" if x is None else x for c, x in ((chr(k), v) for k, v in ({ord(c): " " for c in _SPACES} | _FOLD).items()) if c != x}
_REPLACED_ASCII = [c for c in _REPLACED if c.isascii()]


def _trim(text: str) -> str:
    return text.strip(_SPACES)


def _entity(m: re.Match) -> str:
    if m[3]:
        return _ENTITIES.get(m[3], m[0])
    code = int(m[1]) if m[1] else int(m[2], 16)
    return m[0] if code > 0x10FFFF or 0xD800 <= code <= 0xDFFF else chr(code)


def decode_entities(text: str) -> str:
    """One pass; unknown names, surrogates and numbers out of range stay."""
    return _ENTITY.sub(_entity, text)


def normalize(text: str | None) -> str:
    """The form in which quotes and sources are compared."""
    out = unicodedata.normalize("NFKC", text or "")
    if "&" in out:
        out = decode_entities(out)
    for c in _REPLACED_ASCII if out.isascii() else _REPLACED.keys() & set(out):
        out = out.replace(c, _REPLACED[c])
    while "  " in out:
        out = out.replace("  ", " ")
    return out.replace("- ", "-").strip(" ").lower()


@lru_cache(maxsize=1)
def _source_form(source: str) -> str:
    """A source is normalised once for the quotes that follow each other."""
    return normalize(source)


def unwrap(quote: str) -> str:
    """Without balanced quotation marks around the whole."""
    text, changed = _trim(quote), True
    while changed:
        changed = False
        for a, b in _PAIRS:
            if len(text) > 2 and text.startswith(a) and text.endswith(b):
                text, changed = _trim(text[1:-1]), True
    return text


def verify(source: str | None, quote: str | None) -> dict:
    """Status, verdict, located text and segments of one quote."""

    def result(status: str, verified: bool = False, text: str = "", segments: list | tuple = ()) -> dict:
        return {"status": status, "verified": verified, "verified_text": text, "segments": list(segments)}

    raw, source = _trim(quote or ""), source or ""
    if not raw:
        return result("empty")
    if not _trim(source):
        return result("no-source")
    quote = unwrap(raw)
    if len(normalize(quote)) < LEAST:
        return result("too-short")
    if quote in source:
        return result("exact", True, quote, [{"text": quote, "found": True, "located": True}])
    parts = [p for p in map(_trim, _ELLIPSIS.split(quote) if "..." in quote or "\u2026" in quote else [quote]) if p]
    hay, cursor, segments = _source_form(source), 0, []
    for part in parts:
        needle = normalize(part)
        at = hay.find(needle, cursor) if needle else -1
        if len(needle) < LEAST and len(parts) > 1:  # too short to tell: forgiven, and the cursor stays
            segments.append({"text": part, "found": True, "located": at >= 0})
            continue
        if at < 0:
            bare = part.rstrip(".,;:")
            shorter = normalize(bare)
            if shorter and shorter != needle and (at := hay.find(shorter, cursor)) >= 0:
                part, needle = bare, shorter
        segments.append({"text": part, "found": at >= 0, "located": at >= 0})
        cursor = at + len(needle) if at >= 0 else cursor
    found = sum(s["found"] for s in segments)
    if not found:
        return result("not-found", segments=segments)
    text = " \u2026 ".join(s["text"] for s in segments if s["located"])
    whole = found == len(segments)
    return result("normalized" if whole else "partial", whole, text, segments)


_ARROW = pa.struct([
    ("status", pa.string()), ("verified", pa.bool_()), ("verified_text", pa.string()), ("segments", pa.list_(pa.struct([("text", pa.string()), ("found", pa.bool_()), ("located", pa.bool_())]))),
])
#: Rows of a batch that are Python objects at the same time.
SLICE = 64


@F.arrow_udf(SCHEMA)
def _verify(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Of structs of source and quote; null stays null."""
    for pairs in batches:
        made = [pa.array((x and verify(x["source"], x["quote"]) for x in pairs[i : i + SLICE].to_pylist()), _ARROW) for i in range(0, len(pairs), SLICE)]
        _source_form.cache_clear()
        yield pa.concat_arrays(made) if made else pa.array([], _ARROW)


@F.arrow_udf(T.StringType())
def normalized(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for texts in batches:
        made = [pa.array(map(normalize, texts[i : i + SLICE].to_pylist()), pa.string()) for i in range(0, len(texts), SLICE)]
        yield pa.concat_arrays(made) if made else pa.array([], pa.string())


def comparable(c: Column | str) -> Column:
    """The form in which quotes and sources are compared; only texts with an entity or a character outside ASCII go to Python."""
    own = F.col(c) if isinstance(c, str) else c
    plain = ~(own.rlike(r"[^\x00-\x7F]") | own.contains("&"))
    folded = F.regexp_replace(F.regexp_replace(F.translate(own, "`'", '""'), f"-{_SPACE}+", "-"), f"{_SPACE}+", " ")
    return F.when(F.coalesce(plain, F.lit(False)), F.lower(F.trim(folded))).otherwise(normalized(F.when(~plain, own)))


def check(source: Column | str, quote: Column | str) -> Column:
    """The struct of ``SCHEMA`` for each row.

    Blank quotes and sources, and quotes that stand in their source as they are,
    are settled by built-in functions, and their texts never leave the JVM. A
    quote is long enough for that if it has ``LEAST`` ASCII letters and digits
    outside entities, whatever normalisation does to the rest.
    """
    source, quote = (F.col(c) if isinstance(c, str) else c for c in (source, quote))
    own = F.btrim(F.coalesce(quote, F.lit("")), F.lit(_SPACES))
    once = F.array(F.struct(source.alias("source"), own.alias("quote")))  # a lambda's variable is evaluated once, however often it is used

    def known(x: Column) -> Column:
        wrapped = F.substring(x["quote"], 1, 1).isin([a for a, _ in _PAIRS])
        long = ~x["quote"].contains("&") & x["quote"].rlike(f"(?:[A-Za-z0-9][^A-Za-z0-9]*){{{LEAST}}}")
        return F.when(x["quote"] == "", "empty").when(is_blank(x["source"]), "no-source").when(~wrapped & long & F.contains(x["source"], x["quote"]), "exact")

    def settled(x: Column) -> Column:
        def result(status: str, text: Column) -> Column:
            hit = F.lit(status == "exact")
            segments = F.array(F.struct(text.alias("text"), hit.alias("found"), hit.alias("located"))) if status == "exact" else F.array().cast(SCHEMA["segments"].dataType)
            return F.struct(F.lit(status).alias("status"), hit.alias("verified"), text.alias("verified_text"), segments.alias("segments"))

        status = known(x)
        return F.when(status == "empty", result("empty", F.lit(""))).when(status == "no-source", result("no-source", F.lit(""))).otherwise(result("exact", x["quote"]))

    rest = _verify(F.get(F.transform(once, lambda x: F.when(known(x).isNull(), x)), F.lit(0)))
    return F.coalesce(rest, F.get(F.transform(once, settled), F.lit(0)))


def is_blank(c: Column | str) -> Column:
    own = F.col(c) if isinstance(c, str) else c
    return F.coalesce(~own.rlike(f"[^{JS_SPACE}]"), F.lit(True))
