"""Stage 3: six detectors, each a column of spans over normalised text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from maskwright.functions import charmap as cm
from maskwright.functions import lexicon as lx
from maskwright.functions import text as tx
from maskwright.schema import ENTITY_TYPES

URL = rf"{tx.LEFT}(?:https?://[^\s<>\"]+|www\.[^\s<>\"]+)"
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
IP = rf"{tx.LEFT}(?:{_OCTET}\.){{3}}{_OCTET}{tx.RIGHT}"
_CC = "|".join(sorted(lx.CALLING_CODES, key=len, reverse=True))
_SEP = r"[\s.\-]?"
PHONE = (
    rf"(?<![0-9+])(?:\+|00)(?:{_CC}){_SEP}"
    rf"(?:\([0-9]{{2,3}}\){_SEP}[0-9](?:{_SEP}[0-9]){{4,8}}|[0-9](?:{_SEP}[0-9]){{6,9}})(?![0-9])"
)
NATIONAL_ID = rf"(?<![+0-9]){tx.LEFT}[0-9]{{10}}{tx.RIGHT}(?![0-9])"


def _any_case(letters: str) -> str:
    return "".join(f"[{x.upper()}{x.lower()}]" for x in letters)


def _iban_bodies() -> list[str]:
    out = [rf"{_any_case(k)}[0-9](?: ?[0-9]){{{n - 1}}}" for k, n in lx.IBAN_DIGITS.items()]
    out += [rf"{_any_case(k)}[0-9] ?[0-9](?: ?[A-Za-z]){{4}}(?: ?[A-Za-z0-9]){{{n}}}" for k, n in lx.IBAN_AFTER_BANK.items()]
    return out


IBAN = rf"(?<![A-Za-z0-9])(?:{'|'.join(_iban_bodies())})(?![A-Za-z0-9])"


def emails(c: Column) -> Column:
    """A candidate for every @: up to 64 local characters to its left from the first letter, digit or underscore on, and a
    domain in the 255 characters to its right. Neither side holds an @, so both lie in the pieces between the signs."""
    pieces = F.split(c, "@", -1)
    start = F.struct(F.lit(0).alias("at"), F.lit(None).cast("string").alias("left"), tx.no_spans().alias("out"))

    def step(acc: Column, piece: Column) -> Column:
        local = F.regexp_replace(F.regexp_extract(F.right(acc["left"], F.lit(64)), r"[A-Za-z0-9._%+\-]*$", 0), "^[^A-Za-z0-9_]+", "")
        domain = F.regexp_extract(F.substring(piece, 1, 255), rf"^[A-Za-z0-9.\-]+\.[A-Za-z]{{2,}}{tx.RIGHT}", 0)
        hit = lambda x: acc["left"].isNotNull() & (x["l"] > 0) & (x["d"] > 0)
        found = lambda x: F.array(tx.span(acc["at"] - 1 - x["l"], acc["at"] + x["d"], "EMAIL"))
        both = F.struct(F.length(local).alias("l"), F.length(domain).alias("d"))
        out = tx.let(both, lambda x: F.when(hit(x), F.concat(acc["out"], found(x))).otherwise(acc["out"]))
        return F.struct((acc["at"] + F.length(piece) + 1).alias("at"), piece.alias("left"), out.alias("out"))

    return F.when(F.contains(c, F.lit("@")), F.aggregate(pieces, start, step, lambda a: a["out"])).otherwise(tx.no_spans())


def urls(c: Column) -> Column:
    return F.when(F.contains(c, F.lit("://")) | F.contains(c, F.lit("www.")), tx.find_spans(c, URL, "URL")).otherwise(tx.no_spans())


def _with_digits(c: Column, spans: Column) -> Column:
    return F.when(c.rlike("[0-9]{2}|[0-9]\\."), spans).otherwise(tx.no_spans())


def ip_addresses(c: Column) -> Column:
    return _with_digits(c, tx.find_spans(c, IP, "IP_ADDRESS"))


def phones(c: Column) -> Column:
    return _with_digits(c, tx.find_spans(c, PHONE, "PHONE"))


def ibans(c: Column) -> Column:
    return _with_digits(c, tx.find_spans(c, IBAN, "IBAN"))


def has_id_context(c: Column, start: Column, end: Column) -> Column:
    """An identity keyword in the ID_BEFORE characters before, or in the ID_AFTER after if these open a bracket."""
    plain = lambda w: F.lower(F.regexp_replace(w, r"[\x{064B}-\x{065F}\x{0670}\x{06D6}-\x{06ED}\x{0640}]", ""))
    lo = F.greatest(F.lit(0), start - lx.ID_BEFORE)
    before = plain(F.substring(c, lo + 1, start - lo))
    after = F.ltrim(plain(F.substring(c, end + 1, F.lit(lx.ID_AFTER))))
    return tx.contains_any(before, lx.ID_KEYWORDS) | (F.startswith(after, F.lit("(")) & tx.contains_any(after, lx.ID_KEYWORDS))


def national_ids(c: Column) -> Column:
    found = tx.find_spans(c, NATIONAL_ID, "NATIONAL_ID")
    return F.when(c.rlike("[0-9]{10}"), F.filter(found, lambda s: has_id_context(c, s["start"], s["end"]))).otherwise(tx.no_spans())


DETECTORS = {"EMAIL": emails, "URL": urls, "IP_ADDRESS": ip_addresses, "PHONE": phones, "IBAN": ibans, "NATIONAL_ID": national_ids}


def detect(c: Column, types=ENTITY_TYPES) -> Column:
    """All spans of the detectors, by start; equal starts in the order of the detectors. Null text has null spans."""
    return F.when(c.isNotNull(), tx.let(F.concat(*[DETECTORS[t](c) for t in DETECTORS if t in types]), by_start))


def by_start(spans: Column) -> Column:
    """Spans by start; equal starts keep their order."""
    keyed = F.transform(spans, lambda s, i: F.struct(s["start"].alias("a"), i.alias("b"), s.alias("s")))
    return F.when(F.size(spans) > 1, F.transform(F.array_sort(keyed), lambda k: k["s"])).otherwise(spans)


def entity_counts(spans: Column, types=ENTITY_TYPES) -> Column:
    """A map of type to number of spans, zeros included; meant for spans before fusion."""
    count = lambda t: F.size(F.filter(spans, lambda s: s["entity_type"] == t))
    return F.map_from_arrays(F.array(*[F.lit(t) for t in types]), F.array(*[count(t) for t in types]))


__all__ = ["DETECTORS", "detect", "entity_counts", "has_id_context", "cm"]
