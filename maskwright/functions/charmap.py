"""Character classes and folding tables.

Small tables that define the data format are written out; everything larger is
derived from Unicode properties, so that it follows the interpreter's version.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

# The two Arabic digit scripts and what they fold to.
ARABIC_INDIC = "٠١٢٣٤٥٦٧٨٩"
EXT_ARABIC_INDIC = "۰۱۲۳۴۵۶۷۸۹"
WESTERN = "0123456789"

# Cyrillic and Greek letters drawn like Latin ones, and the Latin letter of each.
CONFUSABLE_FROM = "АВЕКМНОРСТХІЈЅаеорсухіјѕһԁΑΒΕΖΗΙΚΜΝΟΡΤΥΧονιρυ"
CONFUSABLE_TO = "ABEKMHOPCTXIJSaeopcyxijshdABEZHIKMNOPTYXovipu"

# More letters drawn alike, which the redaction pipeline does not fold but scoring and matching do.
MORE_CONFUSABLE_FROM = "ᎪᏴᏟᎬᏚᎻɑօɡıոսǀԁƽУ"
MORE_CONFUSABLE_TO = "ABCESHaoginuldsY"

# The letters beyond CONFUSABLE_FROM that the leak scorers fold.
SCORED_CONFUSABLE_FROM = "ᎪᏴᏟᎬᏚᎻɑօɡıոսǀƽ"
SCORED_CONFUSABLE_TO = "ABCESHaoginuls"

# Letters of other Arabic-script alphabets and the Arabic letter of each.
ARABIC_KIN_FROM = "کیےەہھۀٱڪڬ"
ARABIC_KIN_TO = "كييههههاكك"

TATWEEL = "ـ"
MARKS_CLASS = "̀-ًͯ-ٰٟۖ-ۜ۟-۪ۨ-ۭ"
SPACES = "               　"

# Directional controls, and characters beyond category Cf that draw nothing.
BIDI_CLASS = "‪-‮⁦-⁩"
_EXTRA_INVISIBLE = [(0x034F, 0x034F), (0x115F, 0x1160), (0x3164, 0x3164), (0xFFA0, 0xFFA0), (0x180B, 0x180E), (0xFE00, 0xFE0F), (0xE0100, 0xE01EF)]


@lru_cache(None)
def invisible_ranges() -> tuple[tuple[int, int], ...]:
    """Code point ranges of category Cf and of the extra characters, merged and in order."""
    points = {c for c in range(0x110000) if unicodedata.category(chr(c)) == "Cf"}
    for a, b in _EXTRA_INVISIBLE:
        points.update(range(a, b + 1))
    return ranges_of(points)


def ranges_of(points) -> tuple[tuple[int, int], ...]:
    """Code points as merged ranges: a class of a few ranges is matched much faster than one of many single characters."""
    out: list[list[int]] = []
    for c in sorted(points):
        if out and out[-1][1] == c - 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return tuple((a, b) for a, b in out)


def java_class(ranges) -> str:
    """The inside of a Java character class for code point ranges."""
    return "".join(f"\\x{{{a:X}}}" + (f"-\\x{{{b:X}}}" if b > a else "") for a, b in ranges)


@lru_cache(None)
def invisible_java() -> str:
    return f"[{java_class(invisible_ranges())}]"


@lru_cache(None)
def invisible_py() -> str:
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in invisible_ranges())


@lru_cache(None)
def fullwidth_pairs() -> tuple[str, str]:
    """Full-width ASCII and plain ASCII."""
    src = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
    return src, "".join(unicodedata.normalize("NFKC", c) for c in src)


@lru_cache(None)
def presentation_pairs() -> tuple[str, str, dict[str, str]]:
    """Arabic contextual forms: one-letter ones as two aligned strings, ligatures as a map."""
    src, dst, many = [], [], {}
    for c in (*range(0xFB50, 0xFDFE), *range(0xFE70, 0xFEFD)):
        n = unicodedata.normalize("NFKC", chr(c))
        if n == chr(c) or not n.strip():
            continue
        if len(n) == 1:
            src.append(chr(c))
            dst.append(n)
        elif " " not in n:
            many[chr(c)] = n
    return "".join(src), "".join(dst), many


@lru_cache(None)
def lookalike_pairs() -> tuple[str, str]:
    """Aligned strings: every character that one other character stands for visually (contextual ligatures aside)."""
    a, b, _ = presentation_pairs()
    f, g = fullwidth_pairs()
    kin = str.maketrans(ARABIC_KIN_FROM, ARABIC_KIN_TO)
    src = f + a + CONFUSABLE_FROM + MORE_CONFUSABLE_FROM + ARABIC_KIN_FROM + SPACES
    dst = g + b.translate(kin) + CONFUSABLE_TO + MORE_CONFUSABLE_TO + ARABIC_KIN_TO + " " * len(SPACES)
    return src, dst


@lru_cache(None)
def _loose_table() -> dict[int, str | None]:
    """For matching: look-alikes, digits of any script, no marks, no invisible characters, plain Arabic letters."""
    src, dst = lookalike_pairs()
    t: dict[int, str | None] = {ord(x): y for x, y in zip(src, dst)}
    for k, v in presentation_pairs()[2].items():
        t[ord(k)] = v
    for table in (ARABIC_INDIC, EXT_ARABIC_INDIC):
        t |= {ord(x): y for x, y in zip(table, WESTERN)}
    for a, b in invisible_ranges():
        t |= dict.fromkeys(range(a, b + 1))
    for c in (*range(0x0300, 0x0370), *range(0x064B, 0x0660), 0x0670, *range(0x06D6, 0x06DD), *range(0x06DF, 0x06E9), *range(0x06EA, 0x06EE), ord(TATWEEL)):
        t[c] = None
    for c in (*range(0x00C0, 0x0250), *range(0x1E00, 0x1F00), *range(0x0622, 0x0627)):
        d = unicodedata.normalize("NFD", chr(c))
        if len(d) > 1 and not unicodedata.combining(d[0]):
            t[c] = d[0]
    t[ord("ى")] = "ي"
    for k, v in list(t.items()):  # a folded form may itself fold
        if v is not None:
            w = "".join(("" if t[ord(ch)] is None else t[ord(ch)]) if ord(ch) in t else ch for ch in v)
            t[k] = w
    return t


def loose(text: str) -> str:
    """The form in which two spellings of one text agree: lower case, no marks, one alphabet."""
    return text.translate(_loose_table()).lower() if not text.isascii() else text.lower()


@lru_cache(None)
def word_pattern() -> re.Pattern:
    """A word with the marks and invisible characters inside it."""
    return re.compile(f"[\\w{MARKS_CLASS}{TATWEEL}{invisible_py()}]+")
