"""What the operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LABELS = ("EMAIL", "PHONE", "IBAN", "NATIONAL_ID", "PERSON", "ADDRESS")


def squash(c: Column | str) -> Column:
    """A category name without case, spaces and separators: the key under which uneven spellings agree."""
    return F.regexp_replace(F.lower(F.col(c) if isinstance(c, str) else c), "[^\\p{L}\\p{N}]+", "")


def squash_py(s: str | None) -> str | None:
    return None if s is None else "".join(ch for ch in s.lower() if ch.isalnum())


def canonical_label(c: Column | str) -> Column:
    """An identifier label in canonical form; labels outside LABELS keep their squashed upper-case form."""
    key = squash(c)
    out = F.upper(key)
    for name in LABELS:
        out = F.when(key == squash_py(name), F.lit(name)).otherwise(out)
    return out


def canonical_split(c: Column | str) -> Column:
    return squash(c)


def draw_key(c: Column | str, seed: int) -> Column:
    """A repeatable random number below 2^60 for a key: the leading digits of a digest, which SQL engines share."""
    text = (F.col(c) if isinstance(c, str) else c).cast("string")
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), text).cast("binary")), 1, 15), 16, 10).cast("long")


def draw_key_sql(c: str, seed: int) -> str:
    return f"CAST(concat('0x', substr(md5(concat('{seed}|', {c})), 1, 15)) AS BIGINT)"
