"""Whether an identifier can still be read in redacted text: fragment counts over canonical forms."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from maskwright.functions import charmap as cm
from maskwright.functions.text import canon, let

FRAGMENT = 6


def occurrences(hay: Column, needle: Column) -> Column:
    """Overlapping occurrences of needle in hay; 0 for an empty needle."""
    last = F.length(hay) - F.length(needle) + 1
    at = F.when((last >= 1) & (F.length(needle) > 0), F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
    return F.when(F.contains(hay, needle), F.size(F.filter(at, lambda i: F.substring(hay, i, F.length(needle)) == needle))).otherwise(0)


def fragments(ident: Column, k: int = FRAGMENT) -> Column:
    """All k-character pieces of an identifier once each; a shorter one whole."""
    pieces = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(ident) - k + 1)), lambda i: F.substring(ident, i, F.lit(k))))
    return F.when(F.length(ident) < k, F.array(ident)).otherwise(pieces)


def leaks_v1(ident: Column, out: Column, k: int = FRAGMENT) -> Column:
    """Any fragment occurs in the output. Over-counts where the text around shares fragments."""
    return let(F.struct(canon(ident).alias("i"), canon(out).alias("o")), lambda x: F.exists(fragments(x["i"], k), lambda f: F.contains(x["o"], f)))


def _more(i: Column, o: Column, c: Column, k: int) -> Column:
    return F.exists(fragments(i, k), lambda f: F.contains(o, f) & (occurrences(o, f) > occurrences(c, f)))


def leaks_v2a(ident: Column, out: Column, context: Column, k: int = FRAGMENT) -> Column:
    """A fragment occurs more often in the output than in the context (the input without the identifier)."""
    x = F.struct(canon(ident).alias("i"), canon(out).alias("o"), canon(F.coalesce(context, F.lit(""))).alias("c"))
    return let(x, lambda x: _more(x["i"], x["o"], x["c"], k))


def leaks(ident: Column, out: Column, context: Column, k: int = FRAGMENT) -> Column:
    """As v2a, with other copies of the whole identifier taken out of the context first, so that a repeated identifier of which a
    copy survives counts. A k beyond any length is the rule for whole identifiers. Null identifier or output gives null."""
    x = F.struct(canon(ident).alias("i"), canon(out).alias("o"), canon(F.coalesce(context, F.lit(""))).alias("c"))
    bare = lambda x: F.when(x["i"] != "", F.replace(x["c"], x["i"], F.lit(""))).otherwise(x["c"])
    return F.when(ident.isNotNull() & out.isNotNull(), let(x, lambda x: let(bare(x), lambda c: _more(x["i"], x["o"], c, k))))


@lru_cache(1)
def _canon_tables() -> tuple[dict, re.Pattern, re.Pattern]:
    fold = str.maketrans(
        cm.ARABIC_INDIC + cm.EXT_ARABIC_INDIC + cm.CONFUSABLE_FROM + cm.SCORED_CONFUSABLE_FROM, cm.WESTERN * 2 + cm.CONFUSABLE_TO + cm.SCORED_CONFUSABLE_TO
    )
    return fold, re.compile(f"[{cm.invisible_py()}]"), re.compile(r"[\W_]+")


_LOWER = bytes(range(256)).lower()
_OTHER = bytes(b for b in range(128) if not chr(b).isalnum())


def _canon(t: str) -> str:
    """What functions.text.canon gives, for one text."""
    if t.isascii():
        return t.encode().translate(_LOWER, _OTHER).decode()
    fold, invisible, other = _canon_tables()
    return other.sub("", invisible.sub("", unicodedata.normalize("NFKC", t)).translate(fold)).lower()


def _copies(hay: str, needle: str) -> int:
    n, at = 0, hay.find(needle)
    while at >= 0:
        n, at = n + 1, hay.find(needle, at + 1)
    return n


def _leak(i: str, o: str, c: str, k: int) -> bool:
    pieces = {i[j : j + k] for j in range(len(i) - k + 1)} if len(i) >= k else {i}
    return any(f in o and _copies(o, f) > _copies(c, f) for f in pieces if f)


def leaks_of(ident: Column, out: Column, context: Column, ks: tuple[int, ...] = (FRAGMENT,)) -> Column:
    """leaks for several fragment lengths at once, as an array: one Arrow function, for tables of many attacked texts."""

    @F.arrow_udf("array<boolean>")
    def judge(ident: pa.Array, out: pa.Array, context: pa.Array) -> pa.Array:
        rows = []
        for x, y, z in zip(ident.to_pylist(), out.to_pylist(), context.to_pylist()):
            if x is None or y is None:
                rows.append(None)
                continue
            i, o, c = _canon(x), _canon(y), _canon(z or "")
            c = c.replace(i, "") if i else c
            rows.append([_leak(i, o, c, k) for k in ks])
        return pa.array(rows, pa.list_(pa.bool_()))

    return judge(ident, out, context)


#: Bits of verdicts.
SCORERS = {"v1": 1, "v2a": 2, "v2": 4}


def verdicts(ident: Column, out: Column, context: Column, k: int = FRAGMENT) -> Column:
    """leaks_v1, leaks_v2a and leaks at once, as the bits of SCORERS in one number: one Arrow function, for tables of many cases. Null
    where the identifier or the output is. Cases of one identifier or context that follow each other share its canonical form."""

    @F.arrow_udf("int")
    def judge(ident: pa.Array, out: pa.Array, context: pa.Array) -> pa.Array:
        codes, last, i, pieces, canons = [], None, "", (), {}
        for x, y, z in zip(ident.to_pylist(), out.to_pylist(), context.to_pylist()):
            if x is None or y is None:
                codes.append(None)
                continue
            if x != last:
                last, i = x, _canon(x)
                pieces = tuple({i[j : j + k] for j in range(len(i) - k + 1)}) if len(i) >= k else (i,)
                canons = {}
            o = _canon(y)
            there = [f for f in pieces if f in o]
            code = 0
            if there:
                z = z or ""
                c = canons.get(z)
                if c is None:
                    canons[z] = c = _canon(z)
                code = 1
                if i:
                    bare = c.replace(i, "")
                    of = [(f, _copies(o, f)) for f in there]
                    code |= 2 * any(n > _copies(c, f) for f, n in of) | 4 * any(n > _copies(bare, f) for f, n in of)
            codes.append(code)
        return pa.array(codes, pa.int32())

    return judge(ident, out, context)


def trigram_jaccard(a: Column, b: Column, n: int = 3) -> Column:
    """Jaccard similarity of character n-gram sets; 0 if either is empty."""
    grams = lambda t: F.when(F.length(t) >= n, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(t) - n + 1), lambda i: F.substring(t, i, F.lit(n))))).otherwise(F.array().cast("array<string>"))
    both = F.struct(grams(a).alias("a"), grams(b).alias("b"))

    def ratio(x: Column) -> Column:
        inter = F.size(F.array_intersect(x["a"], x["b"]))
        return F.when((F.size(x["a"]) > 0) & (F.size(x["b"]) > 0), inter / (F.size(x["a"]) + F.size(x["b"]) - inter)).otherwise(0.0)

    return let(both, ratio)
