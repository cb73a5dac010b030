"""Attack operators: identifiers rewritten so that readers still read them.

Draws come from a hash of seed, row key and character position, so a run is
repeatable on any partitioning. What may change, at which rate, and where the gold
offsets then lie is fixed; the exact outcome of a draw is not.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from maskwright.functions import charmap as cm
from maskwright.functions import lexicon as lx
from maskwright.functions.text import chars, let

# Inventories of the operators, for development and held out.
INVISIBLE = {False: "​‌‍⁠﻿­", True: "⁢⁣᠎͏️‎‏\U000e0020"}
BIDI = "‪‫‬‭‮⁦⁧⁨⁩؜"
SEPARATORS = {False: "-.    ", True: "/_·•,;"}
LOOKALIKES = {
    False: dict(zip("ABEKMHOPCTXSaeopcxiy", "АВЕКМНОРСТХЅаеорсхіу")),
    True: dict(zip("ABCESHaoginulvds", "ᎪᏴᏟᎬᏚᎻɑօɡıոսǀνԁƽ")),
}
TASHKEEL = "ًٌٍَُِّْ"
HOMOGLYPHS = {**dict(zip(cm.WESTERN, cm.ARABIC_INDIC)), "ا": "l"}
ID_WORDS = ("national id", "id number", "iqama", "identity", "civil id", "الهوية", "هوية", "إقامة", "قومي", "بطاقة")
ID_SYNONYMS = ("civil number", "citizen number", "الرقم المدني", "رقم المواطن", "personal no.", "resident file")
ARABIC_LETTER = r"^[\x{0621}-\x{064A}]$"

Draw = Callable[..., Column]


def drawing(seed: int, *key: Column) -> Draw:
    """draw(name, position): a uniform number in [0, 1) for this row."""
    return lambda name, *at: F.pmod(F.xxhash64(F.lit(seed), F.lit(name), *key, *at), F.lit(1 << 53)) / F.lit(float(1 << 53))


def _pick(options, u: Column) -> Column:
    options = list(options)
    return F.element_at(F.array(*[F.lit(o) for o in options]), (F.floor(u * len(options)) + 1).cast("int"))


def _table(t: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in t.items() for x in kv])


def _each(c: Column, f) -> Column:
    """c with f(character, position) in place of each character."""
    return F.array_join(F.transform(chars(c), f), "")


def _gaps(c: Column, rate: float, draw: Draw, options, name: str, only_inside_words: bool = False) -> Column:
    n = F.length(c)

    def f(ch: Column, i: Column) -> Column:
        ok = (i < n - 1) & (draw(name, i) < rate)
        if only_inside_words:
            ok = ok & ch.rlike(r"^[\p{L}\p{N}]$") & F.substring(c, i + 2, F.lit(1)).rlike(r"^[\p{L}\p{N}]$")
        return F.when(ok, F.concat(ch, _pick(options, draw(name + "2", i)))).otherwise(ch)

    return _each(c, f)


def inv(c: Column, draw: Draw, held: bool = False, rate: float = 0.35) -> Column:
    return _gaps(c, rate, draw, INVISIBLE[held], "inv")


def bidi(c: Column, draw: Draw, held: bool = False, rate: float = 0.35) -> Column:
    return _gaps(c, rate, draw, BIDI, "bidi")


def sep(c: Column, draw: Draw, held: bool = False, rate: float = 0.3) -> Column:
    return _gaps(c, rate, draw, SEPARATORS[held], "sep", only_inside_words=True)


def fullwidth(c: Column, draw: Draw, held: bool = False, rate: float = 0.6) -> Column:
    """Digits to full-width or mathematical ones, letters to full-width ones."""
    digits = {d: [chr(0xFF10 + i), chr(0x1D7CE + i), chr(0x1D7D8 + i)] for i, d in enumerate(cm.WESTERN)}
    wide = {chr(x): chr(x - 0x20 + 0xFF00) for x in (*range(0x41, 0x5B), *range(0x61, 0x7B))}
    maps = [_table({**wide, **{d: v[k] for d, v in digits.items()}}) for k in range(3)]

    def f(ch: Column, i: Column) -> Column:
        k = F.floor(draw("fw2", i) * 3)
        new = F.when(k == 0, F.element_at(maps[0], ch)).when(k == 1, F.element_at(maps[1], ch)).otherwise(F.element_at(maps[2], ch))
        return F.when(draw("fw", i) < rate, F.coalesce(new, ch)).otherwise(ch)

    return _each(c, f)


def digits(c: Column, draw: Draw, held: bool = False, rate: float = 0.6) -> Column:
    """Western digits to one of the two Arabic scripts, the same for the whole identifier."""
    a, b = _table(dict(zip(cm.WESTERN, cm.ARABIC_INDIC))), _table(dict(zip(cm.WESTERN, cm.EXT_ARABIC_INDIC)))
    return _each(c, lambda ch, i: F.when(draw("dig", i) < rate, F.coalesce(F.when(draw("script") < 0.5, F.element_at(a, ch)).otherwise(F.element_at(b, ch)), ch)).otherwise(ch))


def conf(c: Column, draw: Draw, held: bool = False, rate: float = 0.5) -> Column:
    """Letters to look-alikes; one at least, if there is an eligible one."""
    t = LOOKALIKES[held]
    m, eligible = _table(t), f"[{''.join(t)}]"
    first = F.when(c.rlike(eligible), F.length(F.regexp_extract(c, f"^[^{''.join(t)}]*", 0))).otherwise(-1)
    new = _each(c, lambda ch, i: F.when(draw("conf", i) < rate, F.coalesce(F.element_at(m, ch), ch)).otherwise(ch))
    forced = _each(c, lambda ch, i: F.when(i == first, F.coalesce(F.element_at(m, ch), ch)).otherwise(ch))
    return let(new, lambda x: F.when(x == c, forced).otherwise(x))


IDENTIFIER_OPS = {"INV": inv, "BIDI": bidi, "FW": fullwidth, "DIG": digits, "SEP": sep, "CONF": conf}
CLOSED_OPS = ("INV", "BIDI", "FW", "DIG", "CONF")


def _budget(c: Column, table: dict[str, str], budget: float, draw: Draw, name: str) -> Column:
    """Replaces round(n x budget) of the n eligible characters, those with the smallest draws."""
    m = _table(table)
    places = F.filter(F.transform(chars(c), lambda ch, i: F.struct(draw(name, i).alias("u"), i.alias("i"), F.element_at(m, ch).isNotNull().alias("ok"))), lambda x: x["ok"])
    chosen = let(F.array_sort(places), lambda p: F.transform(F.slice(p, F.lit(1), F.rint(F.size(p) * F.lit(budget)).cast("int")), lambda x: x["i"]))
    return let(chosen, lambda s: _each(c, lambda ch, i: F.when(F.array_contains(s, i), F.element_at(m, ch)).otherwise(ch)))


def arabizi(c: Column, draw: Draw, budget: float = 1.0) -> Column:
    return _budget(c, lx.ARABIZI, budget, draw, "arz")


def homoglyphs(c: Column, draw: Draw, budget: float = 0.2) -> Column:
    return _budget(c, HOMOGLYPHS, budget, draw, "hgl")


def tatweel(c: Column, draw: Draw | None = None, every: int = 2) -> Column:
    return _each(c, lambda ch, i: F.when(ch.rlike(ARABIC_LETTER) & ((i + 1) % every == 0), F.concat(ch, F.lit(cm.TATWEEL))).otherwise(ch))


def diacritics(c: Column, draw: Draw) -> Column:
    return _each(c, lambda ch, i: F.when(ch.rlike(ARABIC_LETTER), F.concat(ch, _pick(TASHKEEL, draw("dia", i)))).otherwise(ch))


def combined(c: Column, draw: Draw, p: float = 0.25) -> Column:
    """Each of four operators with probability p, in order."""
    for name, op in (("arz", arabizi), ("tat", tatweel), ("dia", diacritics), ("hgl", lambda x, d: homoglyphs(x, d, 0.2))):
        c = let(c, lambda x, name=name, op=op: F.when(draw("cmb-" + name) < p, op(x, draw)).otherwise(x))
    return c


TEXT_OPS = {"ARZ": arabizi, "TAT": tatweel, "DIA": diacritics, "HGL": homoglyphs, "CMB": combined}


def eligible(op: str, etype: Column, ident: Column) -> Column:
    if op == "CONF":
        return etype.isin("IBAN", "EMAIL") & ident.rlike("[A-Za-z]")
    if op == "CTX":
        return etype == "NATIONAL_ID"
    return F.lit(True)


def context(text: Column, id_start: Column, draw: Draw, mode: str) -> Column:
    """Alters the first listed identity word in the 60 characters before an identifier: zw (zero width between its letters),
    tashkeel, conf (look-alikes) or synonym (a phrase that is not listed)."""
    lo = F.greatest(F.lit(0), id_start - lx.ID_BEFORE)
    window = F.lower(F.substring(text, lo + 1, id_start - lo))
    at = F.coalesce(*[F.when(F.contains(window, F.lit(w)), F.struct((lo + F.locate(w, window)).alias("p"), F.lit(len(w)).alias("n"))) for w in ID_WORDS])

    def alter(w: Column) -> Column:
        if mode == "zw":
            return F.array_join(chars(w), "​")
        if mode == "tashkeel":
            return _each(w, lambda ch, i: F.when(ch.rlike(r"^[\x{0600}-\x{06FF}]$") & (draw("ctx", i) < 0.7), F.concat(ch, _pick(TASHKEEL[3:], draw("ctx2", i)))).otherwise(ch))
        if mode == "conf":
            m = _table(LOOKALIKES[False])
            return _each(w, lambda ch, i: F.when(draw("ctx", i) < 0.6, F.coalesce(F.element_at(m, ch), ch)).otherwise(ch))
        return _pick(ID_SYNONYMS, draw("ctx"))

    new = lambda x: F.concat(F.substring(text, F.lit(1), x["p"] - 1), alter(F.substring(text, x["p"], x["n"])), F.substring(text, x["p"] + x["n"], F.length(text)))
    return let(at, lambda x: F.when(x.isNotNull(), new(x)).otherwise(text))


def apply_context(text: Column, spans: Column, draw: Draw, mode: str) -> Column:
    """As apply_to_spans, for context: the word before each NATIONAL_ID is altered, from the last identifier to the first, and the
    gold spans move with the text. The identifiers stay; those of type NATIONAL_ID count as altered if the text was."""
    gold_t = "array<struct<start:int,end:int,entity_type:string>>"
    sorted_ = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["entity_type"].alias("entity_type")))).cast(gold_t)

    def step(acc: Column, k: Column) -> Column:
        s = F.get(acc["gold"], k)

        def put(v: Column) -> Column:
            grown, at = F.length(v) - F.length(acc["text"]), s["start"]
            # the first changed character: spans from there on move, the identifier is after it
            same = F.length(acc["text"]) - 1
            first = F.coalesce(F.get(F.filter(F.sequence(F.greatest(F.lit(0), at - lx.ID_BEFORE), F.greatest(F.lit(0), same)), lambda i: F.substring(v, i + 1, F.lit(1)) != F.substring(acc["text"], i + 1, F.lit(1))), 0), at)
            move = lambda x: F.when(x > first, x + grown).otherwise(x).cast("int")
            return F.struct(v.alias("text"), F.transform(acc["gold"], lambda g: F.struct(move(g["start"]).alias("start"), move(g["end"]).alias("end"), g["entity_type"].alias("entity_type"))).alias("gold"))

        return F.when(s["entity_type"] == "NATIONAL_ID", let(context(acc["text"], s["start"], lambda name, *a: draw(name, k, *a), mode), put)).otherwise(acc)

    start = F.struct(text.alias("text"), sorted_.alias("gold"))
    order = F.when(F.size(sorted_) > 0, F.reverse(F.sequence(F.lit(0), F.size(sorted_) - 1))).otherwise(F.array().cast("array<int>"))
    done = lambda acc: F.struct(acc["text"].alias("text"), F.transform(acc["gold"], lambda g: F.struct(g["start"].alias("start"), g["end"].alias("end"), g["entity_type"].alias("entity_type"), ((g["entity_type"] == "NATIONAL_ID") & (acc["text"] != text)).alias("altered"))).alias("gold"))
    return F.aggregate(order, start, step, done)


def apply_to_spans(text: Column, spans: Column, f: Callable[[Column, Column, Column], Column]) -> Column:
    """Rewrites each span's text with f(identifier, type, number of the span): a struct of the new text, the gold spans in its
    offsets, and whether each was altered. Spans must not overlap; they are taken by start."""
    numbered = F.transform(F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["entity_type"].alias("entity_type")))), lambda s, i: F.struct(s.alias("s"), i.alias("i")))
    gold_t = "array<struct<start:int,end:int,entity_type:string,altered:boolean>>"
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"), F.array().cast(gold_t).alias("gold"))

    def step(acc: Column, x: Column) -> Column:
        s = x["s"]
        old = F.substring(text, s["start"] + 1, s["end"] - s["start"])
        lead = F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]))

        def put(v: Column) -> Column:
            a = F.length(v["lead"])
            g = F.struct(a.alias("start"), (a + F.length(v["new"])).alias("end"), s["entity_type"].alias("entity_type"), (v["new"] != v["old"]).alias("altered"))
            return F.struct(F.concat(v["lead"], v["new"]).alias("out"), s["end"].alias("at"), F.concat(acc["gold"], F.array(g)).alias("gold"))

        return let(F.struct(lead.alias("lead"), old.alias("old"), f(old, s["entity_type"], x["i"]).alias("new")), put)

    done = lambda acc: F.struct(F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))).alias("text"), acc["gold"].alias("gold"))
    return F.aggregate(numbered, start, step, done)


def with_op(op: str, draw: Draw, held: bool = False):
    """A rewriting function for apply_to_spans: an operator where it is eligible."""
    return lambda ident, etype, i: F.when(eligible(op, etype, ident), IDENTIFIER_OPS[op](ident, lambda name, *at: draw(name, i, *at), held)).otherwise(ident)


def random_combo(ident: Column, etype: Column, draw: Draw, k: Column, ops=tuple(IDENTIFIER_OPS), held_p: float = 0.5) -> Column:
    """k operators drawn without replacement, applied in the order of the list."""
    rank = F.transform(F.array_sort(F.array(*[F.struct(draw("order-" + o).alias("u"), F.lit(o).alias("o")) for o in ops])), lambda x: x["o"])
    chosen = F.slice(rank, F.lit(1), k)

    def one(c: Column, o: str) -> Column:
        both = lambda x: F.when((draw("held-" + o) < held_p) & F.lit(True), IDENTIFIER_OPS[o](x, draw, True)).otherwise(IDENTIFIER_OPS[o](x, draw, False))
        return let(c, lambda x: F.when(F.array_contains(chosen, o) & eligible(o, etype, x), both(x)).otherwise(x))

    return reduce(one, ops, ident)


def adaptive_query(ident: Column, etype: Column, draw: Draw, mode: str = "open") -> Column:
    """One query of an adaptive attacker. open: any operator and inventory; closed: only families that normalisation covers."""
    k = (F.floor(draw("k") * 3) + 1).cast("int")
    if mode == "open":
        return random_combo(ident, etype, draw, k)
    return random_combo(ident, etype, draw, k, CLOSED_OPS, 0.0)


#: Name, operator and setting of the fixed attack configurations.
FIXED = (
    ("HGL 20%", "HGL", 0.2), ("HGL 100%", "HGL", 1.0), ("INV (dev chars)", "INV", False), ("INV (held-out chars)", "INV", True),
    ("BIDI controls", "BIDI", False), ("Fullwidth/math forms", "FW", False), ("Arabic-Indic digits", "DIG", False),
    ("SEP (dev separators)", "SEP", False), ("SEP (held-out separators)", "SEP", True), ("CONF (folded set)", "CONF", False), ("CONF (held-out set)", "CONF", True),
    ("CTX zero-width", "CTX", "zw"), ("CTX diacritics", "CTX", "tashkeel"), ("CTX look-alike", "CTX", "conf"), ("CTX synonym", "CTX", "synonym"),
    ("COMBO-2", "COMBO", 2), ("COMBO-3", "COMBO", 3),
)


def apply_fixed(text: Column, spans: Column, config: tuple, draw: Draw) -> Column:
    """A fixed configuration on a text: what apply_to_spans gives."""
    _, op, setting = config
    return apply_context(text, spans, draw, setting) if op == "CTX" else apply_to_spans(text, spans, rewriting(config, draw))


def rewriting(config: tuple, draw: Draw):
    """The rewriting function of a fixed configuration other than CTX."""
    _, op, setting = config
    own = lambda i: (lambda name, *at: draw(name, i, *at))
    if op == "HGL":
        return lambda ident, etype, i: homoglyphs(ident, own(i), setting)
    if op == "COMBO":
        return lambda ident, etype, i: random_combo(ident, etype, own(i), F.lit(setting))
    return with_op(op, draw, setting)
