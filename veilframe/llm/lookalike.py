"""Fixed tables about characters that look alike, shared by the operators on text."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

# Letters of other scripts that look like a Latin letter, and the letter.
LETTERS = {
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "ν": "v", "ο": "o", "ρ": "p", "υ": "u", "ι": "i", "α": "a", "ϲ": "c", "ϳ": "j",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "Ѕ": "S", "І": "I", "Ј": "J",
    "Ԛ": "Q", "Ԝ": "W", "Ү": "Y", "Ғ": "F", "Һ": "h",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ӏ": "l", "ո": "n", "ս": "u", "օ": "o",
}
# Marks that look like a hyphen-minus, a middle dot, an apostrophe or a double quote.
HYPHENS = "‐‑‒−﹣－⁃˗𐆑"
MIDDLE_DOTS = "‧∙⋅・･ㆍ•·᛫"
APOSTROPHES = "‘’‛ʼʹ′＇"
QUOTES = "“”‟″＂"
#: Signs whose compatibility form is the same sign in another width, position or joining shape.
SAME_LOOK = ("<wide>", "<narrow>", "<noBreak>", "<font>", "<initial>", "<medial>", "<final>", "<isolated>", "<small>", "<vertical>")


def spelt_out(ch: str) -> bool:
    """A sign that is drawn as its letters side by side: ligatures, Roman numerals, letter pairs of the Latin blocks."""
    name = unicodedata.name(ch, "")
    return "LIGATURE" in name or "ROMAN NUMERAL" in name or ord(ch) in (*range(0x01C4, 0x01CD), *range(0x01F1, 0x01F4), 0x0132, 0x0133)


def invisible(ch: str) -> bool:
    """No mark on the page: formatting characters, soft hyphen, joiners, fillers and variation selectors."""
    cp = ord(ch)
    return unicodedata.category(ch) == "Cf" or cp in (0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0) or 0xFE00 <= cp <= 0xFE0F or 0x180B <= cp <= 0x180D or 0xE0100 <= cp <= 0xE01EF


@lru_cache(maxsize=1 << 16)
def decomposed(ch: str) -> str:
    """What one code point looks like, fully decomposed: canonical parts, the same sign in its plain width, its look-alike."""
    if invisible(ch):
        return ""
    if unicodedata.category(ch) == "Zs":
        return " "
    if ch in LETTERS:
        return LETTERS[ch]
    for many, one in ((HYPHENS, "-"), (MIDDLE_DOTS, "·"), (APOSTROPHES, "'"), (QUOTES, '"')):
        if ch in many:
            return one
    how = unicodedata.decomposition(ch)
    if not how:
        return ch
    parts = how.split()
    if parts[0][0] == "<":
        if parts[0] not in SAME_LOOK and not (parts[0] == "<compat>" and spelt_out(ch)):
            return ch
        parts = parts[1:]
    return "".join(decomposed(chr(int(p, 16))) for p in parts)


@lru_cache(maxsize=1)
def mapping() -> dict[str, str]:
    """Every code point but Hangul syllables whose :func:`decomposed` form differs from it. A few thousand entries, by rule."""
    out = {}
    for cp in range(0x80, 0x110000):
        if 0xAC00 <= cp <= 0xD7A3 or 0xD800 <= cp <= 0xDFFF:
            continue
        ch = chr(cp)
        if (to := decomposed(ch)) != ch:
            out[ch] = to
    return out


@lru_cache(maxsize=1)
def combining() -> dict[str, int]:
    """Every code point with a combining class other than 0, and the class."""
    return {chr(cp): c for cp in range(0x80, 0x110000) if not 0xD800 <= cp <= 0xDFFF and (c := unicodedata.combining(chr(cp)))}
