"""Personal data replaced by keyed surrogates of the same type and format.

Detected are e-mail addresses, telephone numbers, IPv4 and IPv6 addresses,
payment cards, social security numbers, IBANs, access keys and other secrets,
birth dates, passport numbers, and names of persons: after a form of address, or a
listed given name with a surname, and then each of their names wherever it stands
alone in the same text (unless the text also has it in lower case). A surrogate
keeps the type and the format: digits stay digits, cases and scripts stay, a card
keeps its first digit and a valid check digit, an IBAN its country and valid check
digits, an address stays a public or private one, a date a date, a listed given name becomes another of its
gender and script; other names keep their vowels' and consonants' places, hence
whether they end in a vowel, by which most of these languages tell gender.

The key is the session's ``spark.corrobora.surrogate.key``. Without it a random
key is drawn for the driver's process: equal entities then agree within one run
only, and no key is left behind. Runs that must agree need a key.

Each type's map is a keyed permutation of the strings of one pattern
(:mod:`corrobora.llm.fpe`), so equal entities get equal surrogates in all
documents (coreference) and different ones different surrogates
(distinctness) in one pass, with no table of entities that grows with the
corpus. A candidate that is not valid for its type is walked on along the
permutation, which keeps it one-to-one. ``collisions`` checks the outcome over
a whole corpus by counting, in Spark functions.

Defined results: a null text stays null, an empty one empty; texts without
entities stay as they are, byte for byte; a null doc_id is kept; repeated rows
get equal results; an empty table gives no rows; extra columns are kept by
``replace_pii`` and not read by ``pii_report``.
"""

from __future__ import annotations

import bisect
import datetime
import hashlib
import ipaddress
import re
import secrets
import unicodedata
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corrobora.llm import fpe
from corrobora.llm.arrowtext import blocks, buffers, gives_back

_OWN_KEY = secrets.token_bytes(32)


def session_key(spark: SparkSession | None = None) -> bytes:
    """The session's key, else the random one of this process."""
    named = spark.conf.get("spark.corrobora.surrogate.key", None) if spark is not None else None
    return hashlib.blake2b(named.encode(), digest_size=32).digest() if named else _OWN_KEY


#: Given names by gender and script, of equal standing within a list.
GIVEN: dict[tuple[str, str], list[str]] = {
    ("female", "latin"): "Alice Anna Barbara Carmen Charlotte Claire Elena Emma Eva Florence Hannah Helen Ines Irene Jane Julia Karen Laura Linda Lucia Maria Marie Mary Nina Olivia Paula Rosa Sarah Sofia Susan".split(),
    ("male", "latin"): "Adam Alan Andre Bruno Carlos Charles Daniel David Edward Felix Frank George Henry Hugo Ivan Jack James Jean John Jorge Karl Louis Luis Martin Michael Paul Peter Robert Thomas William".split(),
    ("female", "cyrillic"): "Анна Вера Дарья Елена Ирина Мария Надежда Ольга Светлана Татьяна".split(),
    ("male", "cyrillic"): "Алексей Борис Виктор Дмитрий Иван Михаил Николай Павел Сергей Юрий".split(),
}
#: Forms of address and their gender.
ADDRESS = {
    "Mr": "male", "Mrs": "female", "Ms": "female", "Miss": "female", "Dr": "", "Prof": "", "Herr": "male", "Herrn": "male", "Frau": "female", "Monsieur": "male", "Madame": "female", "Mme": "female", "Mlle": "female",
    "Señor": "male", "Señora": "female", "Sr": "male", "Sra": "female", "Don": "male", "Doña": "female", "господин": "male", "Господин": "male", "госпожа": "female", "Госпожа": "female",
}

#: Combining marks, which are parts of words in many scripts but no word characters to ``re``.
_MARK = "".join(re.escape(chr(c)) for c in range(0x300, 0x20000) if unicodedata.category(chr(c)) in ("Mn", "Mc"))
_LETTERS = rf"(?:[^\W\d_][{_MARK}]*)+"
_WORD = rf"{_LETTERS}(?:[-'’]{_LETTERS})*"
_TITLES = "|".join(sorted(ADDRESS, key=len, reverse=True))
_LISTED = {name: (kind, i) for kind, names in GIVEN.items() for i, name in enumerate(names)}
_GIVEN = "|".join(sorted(_LISTED, key=len, reverse=True))
_NAMED = rf"(?=[^\W\d_a-z]){_WORD}"
_HEXTET = "[0-9A-Fa-f]{1,4}"
#: Words before a secret, a birth date or a passport's number, which is the entity.
_SECRET = "password|passwd|secret|token|api_?key"
_BORN = "born(?: on)?|date of birth|dob|birth ?date|geboren(?: am)?|née? le|nacid[oa] el|fecha de nacimiento|родил(?:ся|ась)|дата рождения"
_PASSPORT = "passport|passeport|pasaporte|reisepass(?:nummer)?|паспорт"
_PATTERNS: list[tuple[str, str]] = [
    ("email", r"(?<![\w.%+-])[^\W_][\w.%+-]*+@[^\W_](?:[\w-]*[^\W_])?(?:\.[^\W_](?:[\w-]*[^\W_])?)+"),
    ("aws_key", r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])"),
    ("secret", rf"(?i:{_SECRET})[\"']?(?:=| ?= | ?: |:)[\"']?(?P<value>[^\s\"',;&]{{6,}})"),
    ("hex_key", r"(?<![A-Za-z0-9])(?:[0-9a-f]{32}|[0-9A-F]{32}|[0-9a-f]{40}|[0-9A-F]{40}|[0-9a-f]{64}|[0-9A-F]{64})(?![A-Za-z0-9])"),
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    ("ipv6", rf"(?<![\w:.])(?:(?:{_HEXTET}:){{7}}{_HEXTET}|{_HEXTET}(?::{_HEXTET}){{0,5}}::{_HEXTET}(?::{_HEXTET}){{0,5}})(?![\w:])"),
    ("ipv4", r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\w]|\.\d)"),
    ("card", r"(?<![\w+])[3-6]\d{3}(?:[ -]?\d{4}){2}[ -]?\d{1,7}(?!\w)"),
    ("ssn", r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"),
    ("birth_date", rf"(?<!\w)(?i:{_BORN}):? (?P<born>\d{{4}}-\d\d-\d\d|\d{{1,2}}\.\d{{1,2}}\.\d{{4}}|\d{{1,2}}/\d{{1,2}}/\d{{4}})(?!\w)"),
    ("passport", rf"(?<!\w)(?i:{_PASSPORT})(?i: no\.?| number| nr\.?)?:? (?P<number>(?=[A-Z]*\d)[A-Z0-9]{{6,9}})(?!\w)"),
    ("phone", r"(?<![\w+])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{3}\) ?\d{3}[-. ]\d{4}|\d{3}[-.]\d{3}[-.]\d{4})(?!\w)"),
    ("person", rf"(?<!\w)(?:(?:{_TITLES})\.?[  ]{_NAMED}(?:[  ]{_NAMED}){{0,2}}|(?:{_GIVEN})[  ](?:[^\W\d_a-z]\.[  ])?{_NAMED})"),
]
_ALONE = re.compile(rf"(?<!\w){_WORD}(?!\w)")
_INSIDE = {"secret": "value", "birth_date": "born", "passport": "number"}
TYPES = [name for name, _ in _PATTERNS]
#: All but secrets begin after what is no ASCII letter or digit: told once for all of them, which ends the search at most places.
_ALL = re.compile("(?<![A-Za-z0-9])(?:" + "|".join(f"(?P<{name}>{pattern})" for name, pattern in _PATTERNS if name != "secret") + ")|(?=[pstaPSTA])(?P<secret>" + dict(_PATTERNS)["secret"] + ")")
#: Bytes one of which is in each entity but a person or a key made of letters: ASCII digits, marks, and the first bytes of all other decimal digits.
_HINT = np.zeros(256, dtype=bool)
_HINT[[*b"0123456789@=:"]] = True
_HINT[[chr(c).encode()[0] for c in range(128, 0x110000) if chr(c).isdecimal()]] = True
#: Keys made of letters are runs of so many of these bytes; persons stand after a form of address.
_RUNS = [(32, b"0123456789abcdefABCDEF"), (20, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")]
_ADDRESSED = re.compile(b"|".join(sorted((re.escape(x.encode()) for x in [*ADDRESS, *_LISTED]), key=len, reverse=True)))


def luhn_ok(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _check_digit(body: str) -> str:
    return next(c for c in fpe.DIGITS if luhn_ok(body + c))


def _card(text: str, key: bytes) -> str:
    digits = re.sub(r"\D", "", text)
    new = digits[0] + fpe.permute_text(digits[1:-1], [fpe.DIGITS], key, "card" + digits[0])
    new += _check_digit(new)
    spare = iter(new)
    return "".join(next(spare) if c.isdigit() else c for c in text)


def _private(parts: list[int]) -> bool:
    return parts[0] in (0, 10, 127) or parts[0] >= 224 or parts[:2] == [192, 168] or parts[:2] == [169, 254] or (parts[0] == 172 and 16 <= parts[1] < 32)


def _ipv4(text: str, key: bytes) -> str:
    own = [int(x) for x in text.split(".")]
    digits = fpe.permute(own, [256] * 4, key, b"ipv4")
    while _private(digits) != _private(own):  # one cycle, which comes back to the address at the latest
        digits = fpe.permute(digits, [256] * 4, key, b"ipv4")
    return ".".join(map(str, digits))


def _ipv6(text: str, key: bytes) -> str:
    """The first group and zero groups stay, the others become other groups that are not zero."""
    groups = [int(x, 16) for x in text.split(":")]
    places = [i for i, x in enumerate(groups) if i and x]
    tweak = f"ipv6|{groups[0]}|{places}".encode()
    for i, x in zip(places, fpe.permute([groups[i] - 1 for i in places], [65535] * len(places), key, tweak), strict=True):
        groups[i] = x + 1
    return ":".join(f"{x:04x}" for x in groups)


def iban_ok(text: str) -> bool:
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97 == 1


def _iban(text: str, key: bytes) -> str:
    """The country stays; the account varies with check digits that are right, or wrong as before."""
    if not iban_ok(text):
        return text[:2] + fpe.permute_text(text[2:], [fpe.DIGITS, fpe.UPPER], key, "iban?" + text[:2], lambda x: not iban_ok(text[:2] + x))
    body = fpe.permute_text(text[4:], [fpe.DIGITS, fpe.UPPER], key, "iban" + text[:2])
    return f"{text[:2]}{98 - int(''.join(str(int(c, 36)) for c in body + text[:2] + '00')) % 97:02d}{body}"


_FIRST_DAY, _DAYS = datetime.date(1900, 1, 1).toordinal(), 50_000


def _day(text: str) -> datetime.date | None:
    """A written date: ISO, day.month.year, day/month/year or else month/day/year; None outside 1900 to 2036."""
    parts = [int(x) for x in re.split(r"[-./]", text)]
    for y, m, d in [parts] if "-" in text else [parts[::-1], (parts[2], parts[0], parts[1])][: 1 + ("/" in text)]:
        try:
            day = datetime.date(y, m, d)
        except ValueError:
            continue
        if 0 <= day.toordinal() - _FIRST_DAY < _DAYS:
            return day
    return None


def _date(text: str, key: bytes) -> str:
    """Another day; a text that is no day becomes another that is none."""
    if (day := _day(text)) is None:
        return fpe.permute_text(text, [fpe.DIGITS], key, "date?", lambda x: _day(x) is None)
    return datetime.date.fromordinal(_FIRST_DAY + fpe.permute([day.toordinal() - _FIRST_DAY], [_DAYS], key, b"date")[0]).isoformat()


def _spelt(kind: str, new: str, mention: str) -> str:
    """A surrogate in the way its mention is written."""
    if kind in ("phone", "iban"):  # into the mention's own spaces and marks
        spare = iter(new)
        return "".join(next(spare) if c.isalnum() or c == "+" else c for c in mention)
    if kind == "ipv6":
        groups = ipaddress.ip_address(new)
        new = groups.exploded if len(mention) == 39 else groups.compressed
        return new.upper() if mention.upper() == mention and mention.lower() != mention else new
    if kind == "birth_date" and "-" not in mention and "-" in new:
        y, m, d = new.split("-")
        parts = [d, m] if _day(mention) == _day(".".join(re.split(r"[./]", mention))) else [m, d]
        if any(len(x) == 1 for x in re.split(r"[./]", mention)):
            parts = [x.lstrip("0") for x in parts]
        return re.sub(r"\d+", lambda _: next(spare), mention) if (spare := iter([*parts, y])) else new
    if kind in ("email", "hex_key") and mention.isupper():
        return new.upper()
    return new


def _person(text: str, key: bytes) -> str:
    """Each name by itself, a form of address stays: a listed given name to one of its list, other words letter by letter in their script."""
    title = re.match(rf"(?:{_TITLES})\.?[  ]", text)
    start = title.end() if title else 0
    return text[:start] + "".join(_name(w, key) for w in re.split(r"([  ])", text[start:]))


@lru_cache(maxsize=100_000)
def _name(word: str, key: bytes) -> str:
    if word in _LISTED:
        kind, i = _LISTED[word]
        return GIVEN[kind][fpe.permute([i], [len(GIVEN[kind])], key, "/".join(kind).encode())[0]]
    return fpe.permute_text(word, fpe.NAMES, key, "name", lambda x: x not in _LISTED)


def canonical(kind: str, text: str) -> str:
    """The form by which two mentions are one entity."""
    if kind in ("phone", "iban"):
        return "".join(c for c in text if c.isalnum() or c == "+")
    if kind == "ipv6":
        return ipaddress.ip_address(text).exploded
    if kind == "birth_date":
        return day.isoformat() if (day := _day(text)) else text
    return text.lower() if kind in ("email", "hex_key") else text


#: Country codes of two digits; 1 and 7 have one, all others three.
_TWO = re.compile(r"2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]")


def _country(phone: str) -> str:
    return phone[: 2 if phone[1] in "17" else 3 if _TWO.match(phone, 1) else 4]


@lru_cache(maxsize=100_000)
def surrogate(kind: str, text: str, key: bytes = _OWN_KEY) -> str:
    """The surrogate of an entity in canonical form."""
    if kind == "email":
        local, _, domain = text.rpartition("@")
        host, _, top = domain.rpartition(".")
        return f"{fpe.permute_text(local, [fpe.LOWER, fpe.DIGITS], key, 'local')}@{fpe.permute_text(host, [fpe.LOWER, fpe.DIGITS], key, 'host')}.{top}"
    if kind == "aws_key":
        return text[:4] + fpe.permute_text(text[4:], [fpe.UPPER + fpe.DIGITS], key, kind)
    if kind == "hex_key" or (kind == "secret" and not text.strip(fpe.HEX)):
        return fpe.permute_text(text, [fpe.HEX], key, "hex")
    if kind == "secret":
        return fpe.permute_text(text, [fpe.LOWER, fpe.UPPER, fpe.DIGITS], key, kind, lambda x: bool(x.strip(fpe.HEX)))
    if kind == "iban":
        return _iban(text, key)
    if kind == "ipv4":
        return _ipv4(text, key)
    if kind == "ipv6":
        return _ipv6(text, key)
    if kind == "birth_date":
        return _date(text, key)
    if kind == "passport":
        return fpe.permute_text(text, [fpe.DIGITS, fpe.UPPER], key, kind)
    if kind == "card":
        return _card(text, key)
    if kind == "person":
        return _person(text, key)
    if kind == "phone" and text[0] == "+":
        country = _country(text)
        return country + fpe.permute_text(text[len(country) :], [fpe.DIGITS], key, kind + country)
    return fpe.permute_text(text, [fpe.DIGITS], key, kind)


def _is_entity(kind: str, mention: str) -> bool:
    """What patterns can't tell: a card's check digit, an IPv6 address, a name without a form of address."""
    if kind == "card":
        return luhn_ok(re.sub(r"\D", "", mention))
    if kind == "ipv6":
        try:
            groups = ipaddress.ip_address(mention).exploded.split(":")
        except ValueError:
            return False
        return any(int(x, 16) for x in groups[1:]) and len([x for x in mention.split(":") if x]) > 2
    if kind == "person" and mention.partition(" ")[0].partition("\u00a0")[0].rstrip(".") not in ADDRESS:
        return re.split(r"[  ]", mention)[-1][0].isupper()
    return True


def _names_of(mention: str) -> list[str]:
    words = re.split(r"[  ]", mention)
    return [w for w in words[words[0].rstrip(".") in ADDRESS :] if len(w) > 1 and not w.endswith(".")]


def entities(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, type, mention) of each entity, left to right, not overlapping; then later and earlier mentions of the persons' names alone."""
    found, at = [], 0
    while m := _ALL.search(text, at):
        kind = m.lastgroup
        start, end = m.span(_INSIDE.get(kind, kind))
        if kind == "secret" and (own := _ALL.match(text, start)) and own.end() == end and own.lastgroup in ("aws_key", "hex_key", "email"):
            kind = own.lastgroup
        if kind == "person" and text[end - 2 : end] in ("'s", "’s"):
            end -= 2
        if _is_entity(kind, text[start:end]):
            found.append((start, end, kind, text[start:end]))
            at = end
        else:  # the rest of what was taken may hold another
            at = m.end() if kind == "card" else m.start() + 1
    names = {w for _, _, kind, mention in found if kind == "person" for w in _names_of(mention)}
    if not names:
        return found
    words = [(m.start(), m[0] if m[0] in names else re.split("['’]", m[0])[0]) for m in _ALONE.finditer(text)]
    small = {w for _, w in words if w.lower() == w}
    names = {w for w in names if w.lower() == w or w.lower() not in small}
    starts, more = [x[0] for x in found], []
    for at, word in words:
        if word in names:
            k = bisect.bisect_right(starts, at) - 1
            if (k < 0 or found[k][1] <= at) and (k + 1 == len(found) or starts[k + 1] >= at + len(word)):
                more.append((at, at + len(word), "person", word))
    return sorted(found + more)


def replace_in(text: str, key: bytes = _OWN_KEY) -> tuple[str, list[tuple[str, str, str]]]:
    """The text with surrogates, and (type, canonical form, surrogate) of each mention."""
    out, done, found = [], 0, []
    for start, end, kind, mention in entities(text):
        own = canonical(kind, mention)
        new = surrogate(kind, own, key)
        if kind in ("email", "hex_key"):
            new = _spelt(kind, new, mention)
        found.append((kind, own, new))
        out += [text[done:start], _spelt(kind, new, mention)]
        done = end
    return ("".join([*out, text[done:]]) if found else text), found


def _suspects(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows in which an entity may stand."""
    total = np.concatenate([[0], np.cumsum(_HINT[data])])
    hint = total[offsets[1:]] > total[offsets[:-1]]
    at = np.fromiter((m.start() for m in _ADDRESSED.finditer(data.tobytes())), np.int64)
    hint[np.searchsorted(offsets, at, "right") - 1] = True
    for length, members in _RUNS:
        table = np.zeros(256, dtype=bool)
        table[[*members]] = True
        total = np.concatenate([[0], np.cumsum(table[data], dtype=np.int32)])
        at = np.flatnonzero(total[length:] - total[:-length] == length)
        hint[np.searchsorted(offsets, at, "right") - 1] = True
    return np.flatnonzero(hint)


@gives_back
def _replace(batches: Iterator[pa.RecordBatch], key: bytes, report: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names = batch.schema.names
        column = batch.column("text")
        data, offsets = buffers(column)
        changed: dict[int, str] = {}
        counts = np.zeros((len(column), len(TYPES)), np.int32)
        for i, j in blocks(offsets):
            part = data[offsets[i] : offsets[j]]
            for k in _suspects(part, offsets[i : j + 1] - offsets[i]).tolist():
                text = data[offsets[i + k] : offsets[i + k + 1]].tobytes().decode("utf-8", "replace")
                new, found = replace_in(text, key)
                if found:
                    changed[i + k] = new
                    for kind, _, _ in found:
                        counts[i + k, TYPES.index(kind)] += 1
        if changed:
            rows = sorted(changed)
            mask = np.zeros(len(column), dtype=bool)
            mask[rows] = True
            kind = column.type
            column = pa.compute.replace_with_mask(column, pa.array(mask), pa.array([changed[x] for x in rows], kind))
        columns = [column if n == "text" else batch.column(n) for n in names]
        if report:
            columns += [pa.array(counts.sum(axis=1).astype(np.int64)), *(pa.array(counts[:, t].astype(np.int64)) for t in range(len(TYPES)))]
            names = [*names, "n_entities", *(f"n_{t}" for t in TYPES)]
        yield pa.RecordBatch.from_arrays(columns, names)


def pii_report(docs: DataFrame, key: bytes | None = None) -> DataFrame:
    """doc_id, the text with surrogates, and how many entities of each type were replaced."""
    schema = "doc_id long, text string, n_entities long, " + ", ".join(f"n_{t} long" for t in TYPES)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(partial(_replace, key=key or session_key(docs.sparkSession), report=True), schema)


def replace_pii(docs: DataFrame, key: bytes | None = None) -> DataFrame:
    """The documents, with all their columns, their texts with surrogates."""
    names = docs.columns
    own = [n if n == "text" else f"c{i}" for i, n in enumerate(names)]
    docs = docs.toDF(*own)
    return docs.mapInArrow(partial(_replace, key=key or session_key(docs.sparkSession), report=False), docs.schema).toDF(*names)


def checked_report(docs: DataFrame, key: bytes | None = None) -> DataFrame:
    """``pii_report`` with ``corpus_collisions``, the number of rows of ``collisions`` over all documents, in every row."""
    return pii_report(docs, key).crossJoin(F.broadcast(collisions(docs, key).agg(F.count("*").alias("corpus_collisions"))))  # one row


@gives_back
def _mentions(batches: Iterator[pa.RecordBatch], key: bytes) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = buffers(batch.column("text"))
        found = set()
        for i, j in blocks(offsets):
            part = data[offsets[i] : offsets[j]]
            for k in _suspects(part, offsets[i : j + 1] - offsets[i]).tolist():
                found.update((t, own, new.lower() if t in ("email", "hex_key") else new) for t, own, new in replace_in(data[offsets[i + k] : offsets[i + k + 1]].tobytes().decode("utf-8", "replace"), key)[1])
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in sorted(found)], pa.string()) for k in range(3)], ["type", "entity", "surrogate"])


def collisions(docs: DataFrame, key: bytes | None = None) -> DataFrame:
    """Surrogates given to more than one entity of a type, or entities left as they are; no rows where all is well."""
    pairs = docs.select("text").mapInArrow(partial(_mentions, key=key or session_key(docs.sparkSession)), "type string, entity string, surrogate string").distinct()
    shared = pairs.groupBy("type", "surrogate").agg(F.count("*").alias("entities"), F.min("entity").alias("entity"))
    return shared.where((F.col("entities") > 1) | (F.col("entity") == F.col("surrogate")))
