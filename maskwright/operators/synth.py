"""Generators: a corpus with exact entity offsets, check digits, formats, scaling inputs.

All draws are hashes of a row number, so a corpus of any size is made in parallel and
the same on any cluster.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.functions import charmap as cm
from maskwright.functions import lexicon as lx
from maskwright.functions.text import let
from maskwright.operators import attacks as at

GIVEN_AR = ("سلمى", "ماجد", "هدى", "رامي", "ليان", "سامر", "نوال", "طلال")
GIVEN_EN = ("Salma", "Majed", "Huda", "Rami", "Layan", "Samer", "Nawal", "Talal")
PLACES_AR, PLACES_EN = ("الميناء", "الواحة", "المرسى"), ("Harbour", "Oasis", "Marina")
DOMAINS = ("example.com", "example.org", "mail.test")
CONNECTORS = ("by the way", "for example", "you know", "anyway")
#: Text around one or two slots; the entity types of the slots.
TEMPLATES = (
    ("يرجى الاتصال بـ {PERSON} على {PHONE} غدا.", ("PERSON", "PHONE")),
    ("أرسلوا الملف إلى {EMAIL} من فضلكم.", ("EMAIL",)),
    ("حوّل {PERSON} الدفعة إلى {IBAN} أمس.", ("PERSON", "IBAN")),
    ("انتقل {PERSON} إلى {LOCATION} الشهر الماضي.", ("PERSON", "LOCATION")),
    ("رقم الهوية الوطنية لـ {PERSON} هو {NATIONAL_ID} حسب السجل.", ("PERSON", "NATIONAL_ID")),
)


def digits_of(draw: at.Draw, name: str, n: int) -> Column:
    return F.array_join(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.floor(draw(name, i) * 10).cast("string")), "")


def pick(options, u: Column) -> Column:
    return F.element_at(F.array(*[F.lit(o) for o in options]), (F.floor(u * len(options)) + 1).cast("int"))


def phone(draw: at.Draw) -> Column:
    return F.concat(F.lit("+"), pick(tuple(lx.CALLING_CODES), draw("cc")), digits_of(draw, "phone", 9))


def email(name: Column, draw: at.Draw) -> Column:
    return F.concat(F.lower(name), (F.floor(draw("mail") * 999) + 1).cast("string"), F.lit("@"), pick(DOMAINS, draw("dom")))


def national_id(draw: at.Draw) -> Column:
    return F.concat(pick(("1", "2"), draw("nid")), digits_of(draw, "nid", 9))


def mod97(s: Column) -> Column:
    """A long number in text modulo 97, letters standing for 10 to 35."""
    numeric = F.array_join(F.transform(F.regexp_extract_all(s, F.lit("."), 0), lambda c: F.when(c.rlike("[0-9]"), c).otherwise((F.ascii(F.upper(c)) - 55).cast("string"))), "")
    return F.aggregate(F.regexp_extract_all(numeric, F.lit("[0-9]"), 0), F.lit(0), lambda acc, d: (acc * 10 + d.cast("int")) % 97)


def iban_check_digits(country: Column, body: Column) -> Column:
    return F.lpad((98 - mod97(F.concat(body, country, F.lit("00")))).cast("string"), 2, "0")


def iban_is_valid(c: Column) -> Column:
    s = F.regexp_replace(c, " ", "")
    return mod97(F.concat(F.substring(s, 5, 100), F.substring(s, 1, 4))) == 1


def iban(draw: at.Draw) -> Column:
    """An account number of one of the seven countries with right check digits."""
    out = None
    u = F.floor(draw("iban") * 7)
    for i, k in enumerate((*lx.IBAN_DIGITS, *lx.IBAN_AFTER_BANK)):
        body = digits_of(draw, "bban", lx.IBAN_DIGITS[k] - 2) if k in lx.IBAN_DIGITS else F.concat(pick(("MNKB", "QSRB", "WHTB"), draw("bank")), digits_of(draw, "bban", lx.IBAN_AFTER_BANK[k]))
        one = let(body, lambda b, k=k: F.concat(F.lit(k), iban_check_digits(F.lit(k), b), b))
        out = F.when(u == i, one) if out is None else out.when(u == i, one)
    return out


def grouped(c: Column, form: str) -> Column:
    """compact, spaced (groups of four), lower."""
    if form == "spaced":
        return F.trim(F.regexp_replace(c, "(.{4})", "$1 "))
    return F.lower(c) if form == "lower" else c


def format_phone(c: Column, form: str) -> Column:
    """A +CC number as compact, double_zero, spaced, dashed, dotted or paren."""
    code = F.regexp_extract(c, rf"^\+({'|'.join(sorted(lx.CALLING_CODES, key=len, reverse=True))})", 1)
    rest = F.substring(c, F.length(code) + 2, F.lit(20))
    a, b, d = F.substring(rest, 1, 2), F.substring(rest, 3, 3), F.substring(rest, 6, 10)
    return {
        "compact": c, "double_zero": F.concat(F.lit("00"), code, rest), "spaced": F.concat_ws(" ", F.concat(F.lit("+"), code), a, b, d), "dashed": F.concat_ws("-", F.concat(F.lit("+"), code), a, b, d),
        "dotted": F.concat_ws(".", F.concat(F.lit("+"), code), a, b, d), "paren": F.concat(F.lit("+"), code, F.lit(" ("), a, F.lit(") "), b, F.lit("-"), d),
    }[form]


def in_script(c: Column, script: str) -> Column:
    to = {"western": cm.WESTERN, "arabic_indic": cm.ARABIC_INDIC, "ext_arabic_indic": cm.EXT_ARABIC_INDIC, "fullwidth": "".join(chr(0xFF10 + i) for i in range(10))}[script]
    return F.translate(c, cm.WESTERN, to)


def corpus(spark: SparkSession, n: int, seed: int = 42, arabizi_rate: float = 0.3, partitions: int | None = None) -> DataFrame:
    """(record_id, split, text, entities): n sentences from templates; 40 % with English entities, part of the Arabic names in chat
    Latin, a quarter of the Arabic sentences with an English connector at their end; split 80/10/10 by position."""
    df = spark.range(0, n, 1, partitions) if partitions else spark.range(n)
    draw = at.drawing(seed, F.col("id"))
    arabic = draw("lang") > 0.4
    ar = F.concat(F.when(draw("kunya") < 0.3, F.concat(pick(lx.KUNYA, draw("k2")), F.lit(" "))).otherwise(""), pick(GIVEN_AR, draw("given")), F.when(draw("nisbah") < 0.3, F.concat(F.lit(" "), pick(lx.NISBAH, draw("n2")))).otherwise(""))
    name = F.when(arabic, F.when(draw("chat") < arabizi_rate, at.arabizi(ar, draw)).otherwise(ar)).otherwise(pick(GIVEN_EN, draw("given")))
    values = {
        "PERSON": name, "PHONE": phone(draw), "EMAIL": email(pick(GIVEN_EN, draw("given")), draw), "IBAN": iban(draw), "NATIONAL_ID": national_id(draw),
        "LOCATION": F.when(arabic, pick(PLACES_AR, draw("place"))).otherwise(pick(PLACES_EN, draw("place"))),
    }
    df = df.select("id", *[v.alias(k) for k, v in values.items()], F.floor(draw("template") * len(TEMPLATES)).alias("t"), (arabic & (draw("marker") < 0.25)).alias("marked"), pick(CONNECTORS, draw("m2")).alias("connector"))
    text, ents = None, None
    for i, (template, types) in enumerate(TEMPLATES):
        out, spans, rest = F.lit(""), [], template
        for ty in types:
            lead, rest = rest.split("{" + ty + "}", 1)
            out = F.concat(out, F.lit(lead))
            spans.append(F.struct(F.length(out).alias("start"), (F.length(out) + F.length(ty)).alias("end"), F.lit(ty).alias("entity_type")))
            out = F.concat(out, F.col(ty))
        out = F.concat(out, F.lit(rest))
        text = F.when(F.col("t") == i, out) if text is None else text.when(F.col("t") == i, out)
        ents = F.when(F.col("t") == i, F.array(*spans)) if ents is None else ents.when(F.col("t") == i, F.array(*spans))
    split = F.when(F.col("id") < F.lit(n * 8 // 10), "train").when(F.col("id") < F.lit(n * 9 // 10), "dev").otherwise("test")
    return df.select(F.col("id").alias("record_id"), split.alias("split"), F.when(F.col("marked"), F.concat(text, F.lit(" "), F.col("connector"), F.lit("."))).otherwise(text).alias("text"), ents.alias("entities"))


# The published inputs of growing length on which matching must stay linear - what comes before, the unit that is
# repeated, the characters that count as one unit, and what comes after.
SCALING_INPUTS = {
    "digit_run": ("", "1", 1, ""),
    "phone_prefix_repeat": ("", "+966 ", 5, ""),
    "plus966_digits_no_boundary": ("+966", "5 ", 2, ""),
    "iban_prefix_repeat": ("", "SA79 ", 5, ""),
    "iban_near_miss": ("", "SA791234 1234 1234 1234 1234 ", 29, ""),
    "email_local_part": ("", "a", 1, "@"),
    "email_dots": ("", "a.", 2, "@b"),
    "tatweel_run": ("م", cm.TATWEEL, 1, ""),
    "invisible_run": ("", "1\u200b", 2, ""),
    "id_keyword_then_digits": ("national id ", "1234567890 ", 11, ""),
    "url_repeat": ("http://", "a", 1, ""),
    "www_repeat": ("", "www.", 4, ""),
    "ip_dots": ("", "1.", 2, ""),
    "mixed_script_tokens": ("", "СA79", 5, ""),
}
SCALING_SIZES = (2000, 8000, 32000, 128000)


def scaling_text(name: str, n: int) -> str:
    before, unit, size, after = SCALING_INPUTS[name]
    return before + unit * (n // size) + after


def scaling_inputs(spark: SparkSession, sizes=SCALING_SIZES) -> DataFrame:
    """(name, n, text): every input at every size."""
    rows = [(name, n, *SCALING_INPUTS[name]) for name in SCALING_INPUTS for n in sizes]
    df = spark.createDataFrame(rows, "name string, n int, before string, unit string, size int, after string")
    return df.select("name", "n", F.concat("before", F.expr("repeat(unit, n div size)"), "after").alias("text"))


# Domains of the scorer's e-mail addresses, and the letters in which a fragment is left as look-alikes.
SCORER_DOMAINS = ("example.com", "corp-demo.net", "mailhost.org", "bankofdemo.com", "contoso.co")
_PLAIN, _ALIKE = "0123456789oae", "٠١٢٣٤٥٦٧٨٩оае"


def scorer_identifiers(keys: DataFrame, key: str, seed: int = 7) -> DataFrame:
    """(id_type, identifier, shared): for every key one identifier of each type; shared is a name that the text around shares with it."""
    draw = at.drawing(seed, F.col(key))
    domain = pick(SCORER_DOMAINS, draw("domain"))
    mail = F.concat(F.lit("user"), (F.floor(draw("user") * 900) + 100).cast("string"), F.lit("@"), domain)
    ids = [
        ("EMAIL", mail, F.concat(F.initcap(F.substring_index(domain, ".", 1)), F.lit(" company"))), ("PHONE", F.concat(F.lit("+966"), digits_of(draw, "p", 9)), None),
        ("IBAN", F.concat(F.lit("SA"), digits_of(draw, "i", 22)), None), ("NATIONAL_ID", digits_of(draw, "n", 10), None),
    ]
    each = F.array(*[F.struct(F.lit(t).alias("id_type"), v.alias("identifier"), (F.lit("the customer") if s is None else s).alias("shared")) for t, v, s in ids])
    return keys.select(key, F.explode(each).alias("x")).select(key, "x.*")


def scorer_cases(identifiers: DataFrame) -> DataFrame:
    """identifiers: id_type, identifier, shared. Eleven kinds of constructed cases (one of them for e-mail addresses only):
    (case_kind, id_type, identifier, context, output, is_leak). context is the input without the scored occurrence."""
    i, name = F.col("identifier"), F.col("shared")
    half = F.greatest(F.lit(8), F.floor(F.length(i) / 2)).cast("int")
    keep, tail = F.substring(i, F.lit(1), half), F.right(i, half)
    left, right = F.concat(F.lit("Please contact "), name, F.lit(" at ")), F.concat(F.lit(". Thanks, "), name, F.lit("."))
    tag, ctx, text = F.concat(F.lit("["), F.col("id_type"), F.lit("]")), F.concat(left, right), F.lit
    alike = F.when(F.col("id_type") == "EMAIL", F.translate(keep, "ea", "еа")).otherwise(F.translate(keep, _PLAIN, _ALIKE))
    kinds = [
        ("fully_redacted_plain", ctx, F.concat(left, tag, right), False),
        ("fully_redacted_shared", ctx, F.concat(left, tag, right), False),
        ("repeated_context", F.concat(ctx, text(" Again: "), i, text(".")), F.concat(left, tag, right, text(" Again: "), tag, text(".")), False),
        ("partial_prefix", ctx, F.concat(left, keep, tag, right), True),
        ("partial_suffix", ctx, F.concat(left, tag, tail, right), True),
        ("partial_lookalike", ctx, F.concat(left, alike, tag, right), True),
        ("second_copy_unredacted", ctx, F.concat(left, tag, right, text(" (cc: "), i, text(")")), True),
        ("repeat_second_survives", F.concat(text("ID "), i, text("; repeat .")), F.concat(text("ID "), tag, text("; repeat "), i, text(".")), True),
        ("repeat_first_survives", F.concat(text("ID ; repeat "), i, text(".")), F.concat(text("ID "), i, text("; repeat "), tag, text(".")), True),
        ("repeat_both_redacted", F.concat(text("ID "), i, text("; repeat .")), F.concat(text("ID "), tag, text("; repeat "), tag, text(".")), False),
        ("short_fragment", ctx, F.concat(left, tag, F.right(i, F.lit(4)), right), False),
    ]
    parts = F.array(*[F.struct(F.lit(k).alias("case_kind"), c.alias("context"), o.alias("output"), F.lit(leak).alias("is_leak")) for k, c, o, leak in kinds])
    out = identifiers.select("id_type", "identifier", F.explode(parts).alias("p")).where("p.case_kind <> 'fully_redacted_shared' OR id_type = 'EMAIL'")
    return out.select("p.case_kind", "id_type", "identifier", "p.context", "p.output", "p.is_leak")
