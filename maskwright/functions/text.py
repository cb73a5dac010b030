"""Column builders for text: Unicode folding, finding matches with offsets, canonical forms.

Everything is a native expression except NFKC, which Spark lacks. Its Arrow UDF gets
null for text of plain letters, on which it would change nothing, so such rows cross
to Python as nulls only.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskwright.functions import charmap as cm

#: A character beyond plain Latin and Arabic letters and digits, or two Arabic marks together: without either, NFKC changes nothing.
NEEDS_NFKC = r"[^\x00-\x7F\x{C0}-\x{FF}\x{60C}\x{61B}\x{61F}\x{621}-\x{652}\x{660}-\x{669}\x{6F0}-\x{6F9}]|[\x{64B}-\x{652}]{2}"
#: White space as Python's str methods know it; Java's \s is ASCII only.
SPACE = r"\t-\r\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
#: Word boundaries in the ASCII sense, which Java's \b is not.
LEFT, RIGHT = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"


@F.pandas_udf(T.StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def nfkc(c: Column) -> Column:
    """Compatibility composition; null stays null."""
    return F.coalesce(_nfkc(F.when(c.rlike(NEEDS_NFKC), c)), c)


def let(value: Column, body) -> Column:
    """body(value) with value computed once: an expression used several times would otherwise be repeated in the plan."""
    return F.element_at(F.transform(F.array(value), lambda v: body(v)), 1)


def chars(c: Column) -> Column:
    """The code points of a text as an array."""
    return F.regexp_extract_all(c, F.lit("(?s)."), 0)


def contains_any(c: Column, words) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(c, F.lit(w))
    return out


def strip_bidi(c: Column) -> Column:
    return F.regexp_replace(c, f"[{cm.BIDI_CLASS}]", "")


def strip_invisible(c: Column) -> Column:
    return F.regexp_replace(c, cm.invisible_java(), "")


def fold_digits(c: Column) -> Column:
    return F.translate(c, cm.ARABIC_INDIC + cm.EXT_ARABIC_INDIC, cm.WESTERN * 2)


def cap_tatweel(c: Column, longest: int = 1) -> Column:
    return F.regexp_replace(c, cm.TATWEEL + "{" + str(longest + 1) + ",}", cm.TATWEEL * longest)


def _fold_tokens(c: Column) -> Column:
    token = f"[^{SPACE}]+"
    words = F.regexp_extract_all(c, F.lit(token), 0)
    gaps = F.split(c, token, -1)
    fold = lambda w: F.when(w.rlike("[A-Za-z0-9]"), F.translate(w, cm.CONFUSABLE_FROM, cm.CONFUSABLE_TO)).otherwise(w)
    return F.array_join(F.zip_with(gaps, F.transform(words, fold), lambda g, w: F.concat(g, F.coalesce(w, F.lit("")))), "")


def fold_confusables(c: Column) -> Column:
    """Cyrillic and Greek look-alikes to Latin, in tokens that also hold an ASCII letter or digit."""
    return F.when(c.rlike(f"[{cm.java_class(cm.ranges_of(map(ord, cm.CONFUSABLE_FROM)))}]"), _fold_tokens(c)).otherwise(c)


def changed_chars(before: Column, after: Column) -> Column:
    """At how many positions two texts of one length differ."""
    n = F.size(F.filter(F.zip_with(chars(before), chars(after), lambda a, b: a != b), lambda x: x))
    return F.when(before == after, 0).otherwise(n)


def canon(c: Column) -> Column:
    """For scoring only: letters and digits as a lenient reader sees them - compatibility forms, digits and all look-alikes folded,
    format characters and everything else dropped, lower case."""
    t = F.regexp_replace(nfkc(c), cm.invisible_java(), "")
    t = F.translate(fold_digits(t), cm.CONFUSABLE_FROM + cm.SCORED_CONFUSABLE_FROM, cm.CONFUSABLE_TO + cm.SCORED_CONFUSABLE_TO)
    return F.lower(F.regexp_replace(t, r"[^\p{L}\p{N}]", ""))


def find_spans(c: Column, pattern: str, entity_type: str, origin: str = "regex") -> Column:
    """All matches of a pattern as spans, with offsets in code points. The pattern must not match the empty text.

    The matches and the gaps between them are two arrays; a running sum of their lengths gives the offsets. Texts without a
    match skip the fold.
    """
    return let(
        F.regexp_extract_all(c, F.lit(pattern), 0),
        lambda found: F.when(F.size(found) > 0, _offsets(found, F.split(c, pattern, -1), entity_type, origin)).otherwise(no_spans()),
    )


def no_spans() -> Column:
    from maskwright.schema import SPANS_DDL

    return F.array().cast(SPANS_DDL)


def span(start: Column, end: Column, entity_type: Column | str, origin: str = "regex", score: float = 1.0) -> Column:
    t = F.lit(entity_type) if isinstance(entity_type, str) else entity_type
    return F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"), t.alias("entity_type"), F.lit(origin).alias("origin"), F.lit(float(score)).alias("score"), F.lit(False).alias("expanded"))


def _offsets(found: Column, gaps: Column, entity_type: str, origin: str) -> Column:
    pairs = F.zip_with(found, F.slice(gaps, 1, F.size(found)), lambda m, g: F.struct(F.length(g).alias("g"), F.length(m).alias("m")))
    start = F.struct(F.lit(0).alias("at"), no_spans().alias("out"))

    def step(acc: Column, x: Column) -> Column:
        s = acc["at"] + x["g"]
        return F.struct((s + x["m"]).alias("at"), F.concat(acc["out"], F.array(span(s, s + x["m"], entity_type, origin))).alias("out"))

    return F.aggregate(pairs, start, step, lambda acc: acc["out"])


def digit_script(c: Column) -> Column:
    """none, western, arabic_indic, ext_arabic_indic, fullwidth, other, or mixed."""
    kinds = [("western", "[0-9]"), ("arabic_indic", f"[{cm.ARABIC_INDIC}]"), ("ext_arabic_indic", f"[{cm.EXT_ARABIC_INDIC}]"), ("fullwidth", r"[\x{FF10}-\x{FF19}]")]
    other = r"[\p{Nd}&&[^0-9" + cm.ARABIC_INDIC + cm.EXT_ARABIC_INDIC + r"\x{FF10}-\x{FF19}]]"
    n = sum((c.rlike(p).cast("int") for _, p in [*kinds, ("other", other)]), F.lit(0))
    out = F.when(n == 0, "none").when(n > 1, "mixed")
    for name, p in kinds:
        out = out.when(c.rlike(p), name)
    return F.when(c.isNotNull(), out.otherwise("other"))


def context_language(c: Column) -> Column:
    """arabic, english, or code_mixed where the rarer script has more than 15 % of the letters."""
    ar, la = F.regexp_count(c, F.lit(r"[\x{0600}-\x{06FF}]")), F.regexp_count(c, F.lit("[A-Za-z]"))
    return F.when((ar > 0) & (la > 0) & (F.least(ar, la) / (ar + la) > 0.15), "code_mixed").when(ar > la, "arabic").otherwise("english")
