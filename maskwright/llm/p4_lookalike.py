"""Problem 4: texts that look the same but differ in their characters.

Look-alike characters are mapped one to one (full-width forms, Arabic contextual
forms, letters of other alphabets, kinds of space); what then differs only in the
composition of accents or in invisible characters is grouped by the collation
UNICODE, which is sensitive to case and accents and ignores what draws nothing.
That collation also takes digits of all scripts as equal and drops the tatweel,
both of which are seen by a reader, so these stand for private characters while
grouping. The canonical member of a class is the text that needs the fewest of
these changes, the least in binary order among equals.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwright.functions import charmap
from maskwright.functions.session import cut, table
from maskwright.llm.common import squash

_KEPT_APART = charmap.ARABIC_INDIC + charmap.EXT_ARABIC_INDIC + charmap.TATWEEL
_PRIVATE = "".join(chr(0xE010 + i) for i in range(len(_KEPT_APART)))


def mapped(c: Column) -> Column:
    """Text after the look-alike map; ligatures of contextual forms are spelled out."""
    src, dst = charmap.lookalike_pairs()
    many = charmap.presentation_pairs()[2]
    kin = str.maketrans(charmap.ARABIC_KIN_FROM, charmap.ARABIC_KIN_TO)
    pairs = F.create_map(*[F.lit(x) for k, v in many.items() for x in (k, v.translate(kin))])
    spelled = F.array_join(F.transform(F.split(c, ""), lambda ch: F.coalesce(F.element_at(pairs, ch), ch)), "")
    c = F.when(c.rlike(f"[{charmap.java_class(charmap.ranges_of(map(ord, many)))}]"), spelled).otherwise(c)
    invisible = "".join(chr(x) for a, b in charmap.invisible_ranges() for x in range(a, b + 1))  # deleted, as they have no counterpart
    return F.translate(c, src + _KEPT_APART + invisible, dst + _PRIVATE)


@lru_cache(None)
def _base_pairs() -> tuple[str, str]:
    """Characters with a canonical decomposition onto one plain letter or sign, and that letter."""
    src, dst = [], []
    for c in range(0x80, 0x20000):
        d = unicodedata.normalize("NFD", chr(c))
        base = [ch for ch in d if not unicodedata.combining(ch)]
        if d != chr(c) and len(base) == 1 and (base[0] < "\x7f" or "\u0620" <= base[0] <= "\u064a"):
            src.append(chr(c))
            dst.append(base[0])
    return "".join(src), "".join(dst)


def outline(seen: Column) -> Column:
    """A hash that is equal for all texts that the collation holds equal: what no accent, mark or invisible character alters.

    Comparing under a collation is slow, so only texts that share their outline with another are compared that way.
    """
    plain = F.regexp_replace(F.translate(seen, *_base_pairs()), "[^ -~\\x{620}-\\x{63F}\\x{641}-\\x{64A}\\x{E010}-\\x{E0FF}]", "")
    return F.xxhash64(plain)


def strangeness(c: Column) -> Column:
    """How many characters of a text are look-alikes, invisible or decomposed."""
    src, _ = charmap.lookalike_pairs()
    invisible = {x for a, b in charmap.invisible_ranges() for x in range(a, b + 1)}
    odd = charmap.ranges_of({*map(ord, src), *invisible, *range(0x300, 0x370), *range(0x653, 0x656)})
    return F.regexp_count(c, F.lit(f"[{charmap.java_class(odd)}]"))


def equivalence_classes(texts: DataFrame) -> DataFrame:
    """(src, text, canonical, n_texts): every distinct text, the canonical member of its class and the number of texts in it.

    Null texts are in no class; the empty text and texts of invisible characters only form one class. Repeated texts count
    once. An empty table gives an empty result.
    """
    spark = texts.sparkSession
    ascii_only = ~F.col("text").rlike(r"[^\x00-\x7F]")
    distinct = texts.where("text IS NOT NULL").select("src", "text").distinct()
    shown = distinct.select("src", "text", F.when(ascii_only, F.col("text")).otherwise(mapped(F.col("text"))).alias("seen"))
    # seen is kept only where it is not the text itself
    shown = cut(shown.select("src", "text", F.nullif("seen", "text").alias("altered"), outline(F.col("seen")).alias("outline")))
    shared = shown.groupBy("src", "outline").agg(F.count("*").alias("n")).where("n > 1").select("src", "outline")
    several = shown.join(shared, ["src", "outline"], "left_semi")
    several = cut(several.select("src", "text", F.coalesce("altered", "text").alias("seen"), strangeness(F.col("text")).alias("odd")))
    return spark.sql(
        """
        WITH class AS (
          SELECT src, collate(seen, 'UNICODE') AS shape, min_by(text, struct(odd, text)) AS canonical, count(*) AS n_texts
          FROM {several} GROUP BY src, collate(seen, 'UNICODE')),
        member AS (
          SELECT s.src, s.text, c.canonical, c.n_texts
          FROM {several} s JOIN class c ON s.src = c.src AND collate(s.seen, 'UNICODE') = c.shape)
        SELECT src, text, canonical, n_texts FROM member
        UNION ALL
        SELECT s.src, s.text, s.text, 1 FROM {shown} s LEFT ANTI JOIN {shared} o ON s.src = o.src AND s.outline = o.outline""",
        several=several, shown=shown, shared=shared,
    )


def _rows(spark, d) -> DataFrame:
    items = table(spark, d, "items").select(F.lit("items").alias("src"), F.col("sentence_id").alias("key"), "text")
    return items.unionByName(table(spark, d, "generated_record").select(F.lit("generated_record").alias("src"), F.col("record_id").alias("key"), "text"))


def pairs(rows: DataFrame) -> DataFrame:
    """(src, key_a, key_b): keys of one table whose texts differ but are of one class, key_a < key_b.

    Rows with a null key or text are in no pair. Distinct texts of a class are paired first and then meet their keys, so copies
    of one text never meet each other; what remains is the result, which is pairs, as its users ask for them.
    """
    name = lambda c: F.unhex(F.md5(F.col(c).cast("binary")))  # noqa: E731  128 bits stand for a text where it is only compared
    several = equivalence_classes(rows).where("n_texts > 1").select("src", name("text").alias("name"), name("canonical").alias("class"))
    several = cut(several.withColumn("t", F.monotonically_increasing_id()))
    named = rows.where("key IS NOT NULL AND text IS NOT NULL").select("src", "key", name("text").alias("name"))
    keyed = cut(named.join(several.select("src", "name", "t"), ["src", "name"]).select("t", "key").distinct())
    a, b = several.alias("a"), several.alias("b")
    unlike = a.join(b, (F.col("a.src") == F.col("b.src")) & (F.col("a.class") == F.col("b.class")) & (F.col("a.t") < F.col("b.t"))).select("a.src", F.col("a.t").alias("t"), F.col("b.t").alias("u"))
    met = unlike.join(keyed.withColumnRenamed("key", "x"), "t").join(keyed.select(F.col("t").alias("u"), F.col("key").alias("y")), "u").where("x <> y")
    return met.select("src", F.least("x", "y").alias("key_a"), F.greatest("x", "y").alias("key_b")).distinct()


def p4_found(spark, d):
    return pairs(_rows(spark, d))


def p4_consistent(spark, d):
    """Every row with its text in one consistent form, and the digit form that its script column names."""
    rows = _rows(spark, d)
    script = table(spark, d, "items").select(F.col("sentence_id").alias("key"), squash("script").alias("digit_form")).groupBy("key").agg(F.min("digit_form").alias("digit_form"))
    out = rows.join(equivalence_classes(rows), ["src", "text"], "left").select("src", "key", F.col("canonical").alias("text"), F.coalesce("n_texts", F.lit(0)).alias("n_texts"))
    return out.join(script, "key", "left")


def p4_class_sizes(spark, d):
    return equivalence_classes(_rows(spark, d)).groupBy("src", "n_texts").agg(F.count("*").alias("texts"))


QUERIES = {"p4_found": p4_found, "p4_consistent": p4_consistent, "p4_class_sizes": p4_class_sizes}


def _shown_sql() -> str:
    """The same forms by tables and composition, where an engine lacks this collation: a text without what draws nothing, composed."""
    src, dst = charmap.lookalike_pairs()
    kin = str.maketrans(charmap.ARABIC_KIN_FROM, charmap.ARABIC_KIN_TO)
    spelled = ", ".join(f"'{k}': '{v.translate(kin)}'" for k, v in charmap.presentation_pairs()[2].items())
    quoted = lambda x: x.replace("'", "''")
    one = f"array_to_string(list_transform(string_split(text, ''), lambda c: coalesce(MAP {{{spelled}}}[c], c)), '')"
    invisible = charmap.java_class(charmap.invisible_ranges())
    return f"nfc_normalize(regexp_replace(translate({one}, '{quoted(src)}', '{quoted(dst)}'), '[{invisible}]', '', 'g'))"


_ROWS = f"""
WITH r AS (SELECT 'items' AS src, sentence_id AS key, text FROM items UNION ALL SELECT 'generated_record', record_id, text FROM generated_record),
c AS (SELECT src, text, {_shown_sql()} AS seen FROM (SELECT DISTINCT src, text FROM r WHERE text IS NOT NULL))"""
ORACLE = {
    "p4_found": f"""{_ROWS}, k AS (SELECT DISTINCT src, key, text, seen FROM r JOIN c USING (src, text) WHERE key IS NOT NULL)
SELECT DISTINCT a.src, a.key AS key_a, b.key AS key_b FROM k a JOIN k b ON a.src = b.src AND a.seen = b.seen AND a.text <> b.text AND a.key < b.key""",
    "p4_class_sizes": f"""{_ROWS}, n AS (SELECT src, seen, count(*) AS n_texts FROM c GROUP BY 1, 2)
SELECT src, n_texts, CAST(sum(n_texts) AS BIGINT) AS texts FROM n GROUP BY 1, 2""",
}
