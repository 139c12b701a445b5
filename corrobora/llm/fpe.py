"""A keyed permutation of strings that keeps each character's class.

A string is split into its varying symbols, each a digit in the base of its
class (lower-case letters, upper-case letters, decimal or hexadecimal digits,
letters of another script). Few strings are shuffled in a keyed cycle; else the
digits pass an eight-round Feistel network of modular additions keyed by BLAKE2b,
a keyed step prime to the size of its domain, and the network backwards. Both are
one cycle through all strings, which leaves none as it was. Characters of no
class stay. The map is one-to-one on all strings of one pattern, so different
strings get different results with no table of what was given before.
"""

from __future__ import annotations

import hashlib
import math
import unicodedata
from collections.abc import Callable, Sequence
from functools import lru_cache

ROUNDS, SMALL = 8, 1024
DIGITS = "0123456789"
LOWER = "abcdefghijklmnopqrstuvwxyz"
UPPER = LOWER.upper()
HEX = "0123456789abcdef"
#: Alphabets by script; other letters vary among those of their block and category.
SCRIPTS = [LOWER, UPPER, "абвгдежзийклмнопрстуфхцчшщъыьэюя", "АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯ", "αβγδεζηθικλμνξοπρστυφχψω", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ"]
#: The same with vowels and consonants apart, for names.
_VOWELS = set("aeiouyаеёиоуыэюяAEIOUYАЕЁИОУЫЭЮЯ")
NAMES = [x for a in SCRIPTS[:4] for x in ("".join(c for c in a if c in _VOWELS), "".join(c for c in a if c not in _VOWELS))] + SCRIPTS[4:]


def _number(digits: Sequence[int], bases: Sequence[int]) -> tuple[int, int]:
    value, size = 0, 1
    for d, b in zip(digits, bases, strict=True):
        value, size = value * b + d, size * b
    return value, size


def _digits(value: int, bases: Sequence[int]) -> list[int]:
    out = []
    for b in reversed(bases):
        value, d = divmod(value, b)
        out.append(d)
    return out[::-1]


def _draw(key: bytes, tweak: bytes, r: int, modulus: int, value: int) -> int:
    return int.from_bytes(hashlib.blake2b(tweak + b"|%d|%d|%d" % (r, modulus, value), key=key, digest_size=32).digest(), "little") % modulus


@lru_cache(maxsize=512)
def _cycle(key: bytes, tweak: bytes, size: int) -> tuple[int, ...]:
    """A keyed cycle through 0 to size - 1 (Sattolo's shuffle): the image of each number."""
    out = list(range(size))
    for i in range(size - 1, 0, -1):
        j = _draw(key, tweak, i, i, size)
        out[i], out[j] = out[j], out[i]
    return tuple(out)


def permute(digits: Sequence[int], bases: Sequence[int], key: bytes, tweak: bytes) -> list[int]:
    """A permutation of all digit strings in these bases: a single cycle, so only a string without choice stays.

    Up to ``SMALL`` strings are shuffled in a keyed cycle. More are numbers of two
    halves in the next square; a number beyond the last string is walked on, which
    leaves one cycle through the strings.
    """
    value, size = _number(digits, bases)
    if size <= SMALL:
        return _digits(_cycle(key, tweak, size)[value], bases)
    half = math.isqrt(size - 1) + 1
    step = _draw(key, tweak, ROUNDS, half * half, 0) or 1
    while math.gcd(step, half) != 1:
        step += 1
    while True:
        left, right = divmod(value, half)
        for r in range(ROUNDS):
            if r % 2:
                right = (right + _draw(key, tweak, r, half, left)) % half
            else:
                left = (left + _draw(key, tweak, r, half, right)) % half
        left, right = divmod((left * half + right + step) % (half * half), half)
        for r in reversed(range(ROUNDS)):
            if r % 2:
                right = (right - _draw(key, tweak, r, half, left)) % half
            else:
                left = (left - _draw(key, tweak, r, half, right)) % half
        value = left * half + right
        if value < size:
            return _digits(value, bases)


@lru_cache(maxsize=10_000)
def alphabet_of(c: str) -> str:
    """Letters or decimal digits of a character's category in its block of 256 (ten digits of its script), or '' for other characters."""
    if c.isdecimal():
        zero = ord(c) - unicodedata.decimal(c)
        return "".join(map(chr, range(zero, zero + 10)))
    if not c.isalpha():
        return ""
    first, kind = ord(c) & ~255, unicodedata.category(c)
    return "".join(x for x in map(chr, range(first, first + 256)) if unicodedata.category(x) == kind and not (x.isascii() and x.isalpha()))


def permute_text(text: str, alphabets: Sequence[str], key: bytes, tweak: str, allowed: Callable[[str], bool] = lambda x: True) -> str:
    """The surrogate of ``text``: characters of ``alphabets``, other letters and other digits vary, the rest stays.

    Results that are not ``allowed`` are permuted again until one is, or the text
    comes back; where the text itself is allowed this keeps the map one-to-one on
    allowed strings. As ``permute`` is a single cycle, the text comes back only if
    no other is allowed.
    """
    where = {c: (i, k) for i, a in enumerate(alphabets) for k, c in enumerate(a)}
    alphabets, given = list(alphabets), len(alphabets)
    for c in sorted({c for c in text if not c.isascii() and c not in where}):
        if c not in where and (own := "".join(x for x in alphabet_of(c) if x not in where)):
            alphabets.append(own)
            where |= {x: (len(alphabets) - 1, k) for k, x in enumerate(own)}
    places = [(p, where[c]) for p, c in enumerate(text) if c in where]
    if not places:
        return text
    bases = [len(alphabets[i]) for _, (i, _) in places]
    digits = [k for _, (_, k) in places]
    pattern = "".join((f"{i}." if (i := where[c][0]) < given else f"{ord(alphabets[i][0]):x}.") if c in where else c for c in text)
    chars, own = list(text), digits
    while True:
        digits = permute(digits, bases, key, f"{tweak}|{pattern}".encode())
        for (p, (i, _)), d in zip(places, digits, strict=True):
            chars[p] = alphabets[i][d]
        if allowed(out := "".join(chars)) or digits == own:
            return out
