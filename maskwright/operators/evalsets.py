"""Evaluation sets made from rules: validity, stratified and challenge sets, their hold-outs, and annotation sets.

Every case is a row number: what varies is taken from it in rotation or from hashes of it, so sets are made in parallel and are
the same on any cluster. Numbers are plausible by their plans, not looked up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from maskwright.functions import lexicon as lx
from maskwright.functions.text import let
from maskwright.operators import attacks as at
from maskwright.operators import synth

CASE = "set_name string, case_id long, text string, gold array<struct<start:int,end:int,entity_type:string>>"
COUNTRIES = tuple(lx.MOBILE_PREFIXES)
LANGUAGES = ("english", "arabic", "code_mixed")
PHONE_FORMS = ("compact", "spaced", "dashed", "dotted", "double_zero", "paren")
IBAN_FORMS = ("compact", "lower", "spaced")
SCRIPTS = ("arabic_indic", "ext_arabic_indic", "fullwidth")
#: A sentence per type and language; {v} is the identifier.
TEMPLATES = {
    "PHONE": {"english": "You can ring the front desk at {v} until five.", "arabic": "يمكن الاتصال بالمكتب على {v} حتى المساء.", "code_mixed": "الرجاء call us على {v} اليوم."},
    "IBAN": {"english": "The refund went to {v} this morning.", "arabic": "وصل المبلغ إلى الحساب {v} صباحا.", "code_mixed": "حوّل الـ refund إلى {v} اليوم."},
    "EMAIL": {"english": "Forward the scan to {v} please.", "arabic": "أرسل النسخة إلى {v} من فضلك.", "code_mixed": "ابعث الـ file إلى {v} الآن."},
    "NATIONAL_ID": {"english": "The form lists national ID {v} as valid.", "arabic": "رقم الهوية {v} مسجل في الملف.", "code_mixed": "تم فحص national ID {v} اليوم."},
}
#: Sentences that hold numbers but no identifier; # stands for a digit.
NEGATIVES = (
    "Parcel ########## is on its way.", "The meter read ########## on Sunday.", "Invoice #,###.## was paid.", "Room ### is free from 09:30.", "Build ######## passed all tests.", "The ISBN 978-#-##-######-# is out of print.",
    "رقم الشحنة ########## في الطريق.", "بلغ المجموع #### ريال.", "الاجتماع يوم ##/##/2031 مساء.", "Batch ########### holds # pallets.", "Use code SAVE#### at the till.", "Page ### of ### was scanned.",
)


def mobile(country: Column, draw: at.Draw) -> Column:
    """A mobile number of a country as +CC and digits, by the plan's prefixes and lengths."""
    out = None
    for c in COUNTRIES:
        prefix = synth.pick(lx.MOBILE_PREFIXES[c], draw("mobile"))
        code = next(k for k, v in lx.CALLING_CODES.items() if v == c)
        digits = synth.digits_of(draw, "rest", 10)
        one = let(prefix, lambda p, c=c, code=code, digits=digits: F.concat(F.lit("+" + code), p, F.substring(digits, F.lit(1), F.lit(lx.NATIONAL_LENGTH[c]) - F.length(p))))
        out = F.when(country == c, one) if out is None else out.when(country == c, one)
    return out


def account(country: Column, draw: at.Draw) -> Column:
    """An account number of a country with right check digits."""
    out = None
    for c in COUNTRIES:
        if c in lx.IBAN_DIGITS:
            body = synth.digits_of(draw, "bban", lx.IBAN_DIGITS[c] - 2)
        else:
            body = F.concat(synth.pick(lx.BANKS, draw("bank")), synth.digits_of(draw, "bban", lx.IBAN_AFTER_BANK[c]))
        one = let(body, lambda b, c=c: F.concat(F.lit(c), synth.iban_check_digits(F.lit(c), b), b))
        out = F.when(country == c, one) if out is None else out.when(country == c, one)
    return out


def _rotate(options, i: Column) -> Column:
    return F.element_at(F.array(*[F.lit(o) for o in options]), (F.pmod(i, F.lit(len(options))) + 1).cast("int"))


def _choose(form: Column, values: dict[str, Column]) -> Column:
    out = None
    for k, v in values.items():
        out = F.when(form == k, v) if out is None else out.when(form == k, v)
    return out


def _cased(df: DataFrame, text: Column, value: Column, etype: Column) -> DataFrame:
    """df with text and gold of the value in it, at its first occurrence; a null value is a case without gold."""
    where = F.struct((F.instr(F.col("__t"), F.col("__v")) - 1).alias("start"), (F.instr(F.col("__t"), F.col("__v")) - 1 + F.length("__v")).alias("end"), etype.alias("entity_type"))
    df = df.withColumn("__t", text).withColumn("__v", value)
    gold = F.when(F.col("__v").isNotNull(), F.array(where)).otherwise(F.array()).cast("array<struct<start:int,end:int,entity_type:string>>")
    return df.withColumn("text", F.col("__t")).withColumn("gold", gold).drop("__t", "__v")


def stratified_set(spark: SparkSession, name: str, counts: dict[str, int], negatives: int, seed: int, every: int = 5) -> DataFrame:
    """(set_name, case_id, text, gold, type, country, format, digit_script, language): so many cases of each type, with country,
    format and language in rotation, each `every`-th with digits of another script; and sentences without identifier."""
    rows = [(t, i) for t, n in (*counts.items(), ("NEGATIVE", negatives)) for i in range(n)]
    df = spark.createDataFrame([(n, *r) for n, r in enumerate(rows)], "case_id long, type string, i long")
    i, draw = F.col("i"), at.drawing(seed, F.col("case_id"))
    country, language = _rotate(COUNTRIES, i), _rotate(LANGUAGES, i)
    numeric = F.col("type").isin("PHONE", "NATIONAL_ID")
    script = F.when(numeric & (F.pmod(i, F.lit(every)) == 0), _rotate(SCRIPTS, F.floor(i / every))).otherwise("western")
    form = F.when(F.col("type") == "PHONE", _rotate(PHONE_FORMS, i)).when(F.col("type") == "IBAN", _rotate(IBAN_FORMS, i)).when(F.col("type") == "EMAIL", F.when(F.pmod(i, F.lit(4)) == 1, "tagged").otherwise("plain")).otherwise("compact")
    df = df.withColumn("country", country).withColumn("language", language).withColumn("digit_script", script).withColumn("format", form)
    c, f = F.col("country"), F.col("format")
    phone, iban = mobile(c, draw), account(c, draw)
    name_part = F.lower(F.concat(synth.pick(synth.GIVEN_EN, draw("g1")), F.lit("."), synth.pick(synth.GIVEN_EN, draw("g2")), (F.floor(draw("n") * 98) + 1).cast("string")))
    mail = F.concat(name_part, F.when(f == "tagged", "+tag").otherwise(""), F.lit("@"), synth.pick(synth.DOMAINS, draw("dom")))
    df = df.withColumn("__p", phone).withColumn("__i", iban)
    printed = F.when(F.col("type") == "PHONE", _choose(f, {k: synth.format_phone(F.col("__p"), k) for k in PHONE_FORMS})).when(F.col("type") == "IBAN", _choose(f, {k: synth.grouped(F.col("__i"), k) for k in IBAN_FORMS}))
    printed = printed.when(F.col("type") == "EMAIL", mail).when(F.col("type") == "NATIONAL_ID", synth.national_id(draw))
    df = df.withColumn("__v", printed)
    value = _choose(F.col("digit_script"), {s: synth.in_script(F.col("__v"), s) for s in ("western", *SCRIPTS)})
    df = df.withColumn("__w", value)
    shape = None
    for t, by in TEMPLATES.items():
        for lang, template in by.items():
            here = (F.col("type") == t) & (F.col("language") == lang)
            shape = F.when(here, F.lit(template)) if shape is None else shape.when(here, F.lit(template))
    blank = F.array_join(F.transform(F.split(_rotate(NEGATIVES, i), ""), lambda ch, k: F.when(ch == "#", F.floor(draw("neg", k) * 10).cast("string")).otherwise(ch)), "")
    text = F.when(F.col("type") == "NEGATIVE", blank).otherwise(F.replace(shape, F.lit("{v}"), F.col("__w")))
    df = _cased(df.withColumn("set_name", F.lit(name)), text, F.when(F.col("type") != "NEGATIVE", F.col("__w")), F.col("type"))
    none = lambda col: F.when(F.col("type") != "NEGATIVE", F.col(col)).alias(col)
    return df.select("set_name", "case_id", "text", "gold", "type", none("country"), none("format"), none("digit_script"), none("language"))


#: Name, cases per type, cases without identifier, seed, and how often digits are of another script.
SETS = {
    "validity": ({"PHONE": 28, "IBAN": 28, "EMAIL": 28, "NATIONAL_ID": 28}, 0, 2026, 10**6),
    "stratified": ({"PHONE": 70, "IBAN": 56, "EMAIL": 42, "NATIONAL_ID": 70}, 110, 31, 5),
    "stratified_holdout": ({"PHONE": 60, "IBAN": 42, "EMAIL": 36, "NATIONAL_ID": 60}, 100, 41, 4),
}


def built_set(spark: SparkSession, name: str) -> DataFrame:
    counts, negatives, seed, every = SETS[name]
    return stratified_set(spark, name, counts, negatives, seed, every)


#: Kinds of challenge cases, for each country: what is printed, in which sentence, and the type it counts as (none: it must stay).
#: {p} is a phone number, {i} an account number, {n} ten digits; rules in `_challenge_value` say how each is printed.
CHALLENGES = (
    ("compact_phone", "Ring {v} for details.", "PHONE"), ("spaced_phone", "Ring {v} for details.", "PHONE"), ("dashed_phone", "Ring {v} for details.", "PHONE"), ("double_zero_phone", "Ring {v} instead.", "PHONE"),
    ("paren_phone", "Ring {v} at noon.", "PHONE"), ("local_phone", "Local number {v} only.", None), ("phone_with_extension", "Ring {v} x204 for the desk.", "PHONE"),
    ("compact_iban", "Wire it to {v} today.", "IBAN"), ("lower_iban", "Wire it to {v} today.", "IBAN"), ("spaced_iban", "Account {v} is active.", "IBAN"), ("short_iban", "Code {v} is too short.", None),
    ("id_english", "National ID: {v} on file.", "NATIONAL_ID"), ("id_arabic", "رقم الهوية {v} مسجل.", "NATIONAL_ID"), ("id_arabic_digits", "رقم الهوية {v} مسجل.", "NATIONAL_ID"), ("id_after", "{v} (civil ID) was checked.", "NATIONAL_ID"),
    ("order_number", "Order {v} was shipped.", None), ("nine_digits", "Reference {v} was noted.", None), ("eleven_digits", "Tracking code {v} is valid.", None),
    ("mail_tagged", "Write to {v} for billing.", "EMAIL"), ("mail_subdomain", "Write to {v} please.", "EMAIL"),
)


def challenge_set(spark: SparkSession, name: str = "challenge", rounds: int = 1, seed: int = 5) -> DataFrame:
    """(set_name, case_id, text, gold, kind, country): every kind of CHALLENGES for every country, `rounds` times."""
    rows = [(r * 1000 + k * 10 + c, k, COUNTRIES[c]) for r in range(rounds) for k in range(len(CHALLENGES)) for c in range(len(COUNTRIES))]
    df = spark.createDataFrame(rows, "case_id long, k int, country string")
    draw = at.drawing(seed, F.col("case_id"))
    df = df.withColumn("__p", mobile(F.col("country"), draw)).withColumn("__i", account(F.col("country"), draw)).withColumn("__n", synth.national_id(draw)).withColumn("__x", synth.digits_of(draw, "x", 11))
    p, i, n, x = (F.col(f"__{c}") for c in "pinx")
    who = F.lower(synth.pick(synth.GIVEN_EN, draw("who")))
    values = {
        "compact_phone": p, "spaced_phone": synth.format_phone(p, "spaced"), "dashed_phone": synth.format_phone(p, "dashed"), "double_zero_phone": synth.format_phone(p, "double_zero"), "paren_phone": synth.format_phone(p, "paren"),
        "local_phone": F.concat(F.lit("0"), F.right(p, F.lit(7))), "phone_with_extension": p, "compact_iban": i, "lower_iban": F.lower(i), "spaced_iban": synth.grouped(i, "spaced"), "short_iban": F.substring(i, 1, 15),
        "id_english": n, "id_arabic": n, "id_arabic_digits": synth.in_script(n, "arabic_indic"), "id_after": n, "order_number": n, "nine_digits": F.substring(x, 1, 9), "eleven_digits": F.regexp_replace(x, "^0", "9"),
        "mail_tagged": F.concat(who, F.lit("+bills@sub.example.co")), "mail_subdomain": F.concat(who, F.lit("_7@post-office.mail.test")),
    }
    kind, shape, etype, value = _rotate([c[0] for c in CHALLENGES], F.col("k")), _rotate([c[1] for c in CHALLENGES], F.col("k")), _rotate([c[2] or "" for c in CHALLENGES], F.col("k")), None
    df = df.withColumn("kind", kind).withColumn("__s", shape).withColumn("__e", etype).withColumn("__val", _choose(F.col("kind"), values))
    df = _cased(df.withColumn("set_name", F.lit(name)), F.replace(F.col("__s"), F.lit("{v}"), F.col("__val")), F.when(F.col("__e") != "", F.col("__val")), F.col("__e"))
    return df.select("set_name", "case_id", "text", "gold", "kind", "country")


def capped(cases: DataFrame, by: str, cap: int, *keys: str, seed: int = 0) -> DataFrame:
    """At most cap rows of each set, those with the smallest draws. The cap is the sample's size: this is for evaluation sets."""
    w = Window.partitionBy(by).orderBy(F.xxhash64(F.lit(seed), *keys), *keys)
    return cases.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= cap).drop("__n")


def annotation_set(positives: DataFrame, negatives: DataFrame, leads: DataFrame, *, sizes: tuple[int, int, int] = (130, 80, 120), seed: int = 9) -> tuple[DataFrame, DataFrame]:
    """(items: item_id, text - in an order that no one chose, without a hint of where it is from; key: item_id, origin, subtype).

    positives, negatives: text, subtype. leads: text, subtype - running text, of which sentences of 25 to 260 characters are taken.
    Texts that occur in several places are taken once.
    """
    sentences = leads.select(F.explode(F.split("text", r"(?<=[.؟!])\s+")).alias("text"), "subtype").where("length(text) BETWEEN 25 AND 260")
    parts = None
    for origin, df, n in (("synthetic_positive", positives, sizes[0]), ("synthetic_negative", negatives, sizes[1]), ("running_text", sentences, sizes[2])):
        one = df.where("text IS NOT NULL").groupBy("text").agg(F.min("subtype").alias("subtype")).withColumn("u", F.xxhash64(F.lit(seed), "text")).orderBy("u", "text").limit(n).withColumn("origin", F.lit(origin))
        parts = one if parts is None else parts.unionByName(one)
    n = F.row_number().over(Window.orderBy(F.xxhash64(F.lit(seed + 1), "text"), "text"))  # as many rows as the set has
    whole = parts.withColumn("item_id", F.concat(F.lit("item"), F.lpad(n.cast("string"), 4, "0")))
    return whole.select("item_id", "text"), whole.select("item_id", "origin", "subtype")


SHEET = ("item_id", "text", "no_identifier", "identifier_1", "type_1", "identifier_2", "type_2", "identifier_3", "type_3", "notes")


def annotation_sheet(items: DataFrame) -> DataFrame:
    """What an annotator fills in: the items with empty columns for up to three identifiers. Written as CSV."""
    return items.select("item_id", "text", *[F.lit(None).cast("string").alias(c) for c in SHEET[2:]])


def collect_sheet(sheet: DataFrame, items: DataFrame, types=("PHONE", "EMAIL", "IBAN", "NATIONAL_ID", "OTHER_PII")) -> tuple[DataFrame, DataFrame]:
    """(spans: sentence_id, start, end, label; problems: item_id, problem) of a filled sheet. Rows of unknown items are left out;
    edited texts, empty rows, unknown types and identifiers that are not in the text are problems."""
    from maskwright.operators.annotate import place_marks

    j = sheet.join(items.select("item_id", F.col("text").alias("__own")), "item_id")
    pair = lambda n: F.struct(F.lit(n).alias("ord"), F.trim(f"identifier_{n}").alias("value"), F.trim(f"type_{n}").alias("label"))
    marks = j.select("item_id", F.explode(F.filter(F.array(pair(1), pair(2), pair(3)), lambda m: F.coalesce(m["value"], F.lit("")) != "")).alias("m")).select("item_id", "m.*")
    known = marks.where(F.col("label").isin(*types))
    placed = place_marks(known.withColumnRenamed("item_id", "sentence_id"), items.select(F.col("item_id").alias("sentence_id"), "text"))
    some = F.coalesce(F.trim("identifier_1"), F.trim("identifier_2"), F.trim("identifier_3"), F.lit("")) != ""
    problems = [
        j.where(~F.col("text").eqNullSafe(F.col("__own"))).select("item_id", F.lit("the text was edited").alias("problem")),
        j.where(~some & (F.coalesce(F.lower(F.trim("no_identifier")), F.lit("")) != "yes")).select("item_id", F.lit("the row is not filled").alias("problem")),
        marks.where(~F.coalesce(F.col("label"), F.lit("")).isin(*types)).select("item_id", F.concat(F.lit("unknown type: "), F.coalesce("label", F.lit(""))).alias("problem")),
        placed.where("start IS NULL").select(F.col("sentence_id").alias("item_id"), F.lit("an identifier is not in the text").alias("problem")),
    ]
    out = problems[0]
    for p in problems[1:]:
        out = out.unionByName(p)
    return placed.where("start IS NOT NULL"), out
