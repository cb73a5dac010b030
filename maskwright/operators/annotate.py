"""Annotation data: marks to spans, corrections, slots, agreement, error categories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LABELS = ("O", "PHONE", "EMAIL", "IBAN", "NATIONAL_ID", "OTHER_PII")


def to_bio(df: DataFrame, text: str = "text", entities: str = "entities") -> DataFrame:
    """df with tokens: an array of (start, end, token, tag) over space-separated tokens; a token belongs to an entity that covers its
    start, and begins it if it is the first to."""
    toks = F.regexp_extract_all(F.col(text), F.lit(r"\S+"), 0)
    gaps = F.split(F.col(text), r"\S+", -1)
    pairs = F.zip_with(toks, F.slice(gaps, 1, F.size(toks)), lambda t, g: F.struct(t.alias("t"), F.length(g).alias("g")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,token:string>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        s = acc["at"] + x["g"]
        one = F.struct(s.alias("start"), (s + F.length(x["t"])).alias("end"), x["t"].alias("token"))
        return F.struct((s + F.length(x["t"])).alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

    placed = df.withColumn("__tok", F.aggregate(pairs, start, step, lambda a: a["out"]))
    ents = F.coalesce(F.col(entities), F.array().cast("array<struct<start:int,end:int,entity_type:string>>"))

    def tag(t: Column, i: Column) -> Column:
        e = F.get(F.filter(ents, lambda e: (e["start"] <= t["start"]) & (t["start"] < e["end"])), 0)
        prev = F.when(i > 0, F.get("__tok", i - 1)["start"])
        kind = F.when(prev >= e["start"], F.concat(F.lit("I-"), e["entity_type"])).otherwise(F.concat(F.lit("B-"), e["entity_type"]))
        return F.struct(t["start"], t["end"], t["token"], F.when(e.isNull(), "O").otherwise(kind).alias("tag"))

    return placed.withColumn("tokens", F.when(F.col(text).isNotNull(), F.transform("__tok", tag))).drop("__tok")


def place_marks(marks: DataFrame, texts: DataFrame, key: str = "sentence_id") -> DataFrame:
    """marks: key, ord, value, label - strings an annotator copied out. Each gets the first occurrence in its text that meets none
    taken before; values that do not occur come back with null offsets, for the caller to reject."""
    per = marks.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("ord", "value", "label"))).alias("m")).join(texts.select(key, "text"), key)
    span_t = "array<struct<start:int,end:int,label:string>>"

    def step(acc: Column, m: Column) -> Column:
        n = F.length(m["value"])
        at = F.filter(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("text") - n + 1)), lambda i: (F.substring(F.col("text"), i, n) == m["value"]) & ~F.exists(acc, lambda s: (s["start"] < i - 1 + n) & (i - 1 < s["end"])))
        first = F.get(at, 0)
        return F.concat(acc, F.array(F.struct((first - 1).cast("int").alias("start"), (first - 1 + n).cast("int").alias("end"), m["label"].alias("label"))))

    return per.select(key, F.explode(F.aggregate("m", F.array().cast(span_t), step)).alias("s")).select(key, "s.start", "s.end", "s.label")


def apply_corrections(gold: DataFrame, corrected: DataFrame, reviewed: DataFrame, key: str = "sentence_id") -> DataFrame:
    """Gold with the spans of reviewed items replaced by the corrected ones (of which there may be none)."""
    cols = [key, "start", "end", "label"]
    ids = reviewed.select(key).distinct()
    return gold.select(*cols).join(ids, key, "left_anti").unionByName(corrected.select(*cols).join(ids, key, "left_semi")).orderBy(*cols)


def fill_slots(templates: DataFrame, values: DataFrame, key: str = "sentence_id") -> DataFrame:
    """templates: key, template with exactly one {ID} or {NUM}; values: key, value. (key, text, start, end). Templates with another
    number of slots, and repeated keys, raise ValueError."""
    bad = templates.withColumn("n", F.regexp_count("template", F.lit(r"\{(?:ID|NUM)\}"))).where(F.coalesce("n", F.lit(0)) != 1)
    if bad.limit(1).count() or templates.groupBy(key).count().where("count > 1").limit(1).count():
        raise ValueError("every template needs exactly one slot, and its own key")
    j = templates.join(values.select(key, "value"), key)
    at = F.length(F.regexp_extract("template", r"(?s)^(.*?)\{(?:ID|NUM)\}", 1))
    text = F.concat(F.substring(F.col("template"), F.lit(1), at), F.col("value"), F.regexp_extract("template", r"(?s)\{(?:ID|NUM)\}(.*)$", 1))
    return j.select(key, text.alias("text"), at.alias("start"), (at + F.length("value")).alias("end"))


def span_f1(a: DataFrame, b: DataFrame, key: str = "sentence_id") -> DataFrame:
    """(label, tp, fp, fn, f1) of B's spans against A's, exact; f1 is null where neither has any."""
    cols = [key, "start", "end", "label"]
    x, y = a.select(*cols).dropna().distinct().withColumn("a", F.lit(1)), b.select(*cols).dropna().distinct().withColumn("b", F.lit(1))
    j = x.join(y, cols, "full_outer")
    n = lambda c: F.sum(c.cast("long"))
    got = j.groupBy("label").agg(n(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("tp"), n(F.col("a").isNull()).alias("fp"), n(F.col("b").isNull()).alias("fn"))
    d = 2 * F.col("tp") + F.col("fp") + F.col("fn")
    return got.withColumn("f1", F.when(d > 0, 2 * F.col("tp") / d))


def disagreements(a: DataFrame, b: DataFrame, key: str = "sentence_id") -> DataFrame:
    """Keys whose sets of spans differ."""
    cols = [key, "start", "end", "label"]
    x, y = a.select(*cols).dropna().distinct(), b.select(*cols).dropna().distinct()
    return x.join(y, cols, "left_anti").select(key).union(y.join(x, cols, "left_anti").select(key)).distinct()


def error_categories(gold: DataFrame, pred: DataFrame, texts: DataFrame, phrases: dict[str, str], key: str = "sentence_id") -> DataFrame:
    """(kind, category, n): missed and extra spans by the first pattern that their sentence matches, else other."""
    cols = [key, "start", "end", "label"]
    g, p = gold.select(*cols).distinct(), pred.select(*cols).distinct()
    both = g.join(p, cols, "left_anti").withColumn("kind", F.lit("missed")).unionByName(p.join(g, cols, "left_anti").withColumn("kind", F.lit("extra")))
    cat = F.coalesce(*[F.when(F.col("text").rlike(rx), name) for name, rx in phrases.items()], F.lit("other"))
    return both.join(texts.select(key, "text"), key).groupBy("kind", cat.alias("category")).agg(F.count("*").alias("n"))


def review_agreement(df: DataFrame, human: str, scorer: str) -> DataFrame:
    """One row: n, agreements, unclamped score interval, kappa and confusion of two binary verdicts."""
    from maskwright.operators.score import wilson

    h, s = F.col(human).cast("int"), F.col(scorer).cast("int")
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    t = df.select(h.alias("h"), s.alias("s")).dropna().agg(F.count("*").alias("n"), n((F.col("h") == 1) & (F.col("s") == 1)).alias("both"), n((F.col("h") == 1) & (F.col("s") == 0)).alias("human_only"), n((F.col("h") == 0) & (F.col("s") == 1)).alias("scorer_only"))
    t = t.withColumn("neither", F.col("n") - F.col("both") - F.col("human_only") - F.col("scorer_only")).withColumn("agree", F.col("both") + F.col("neither"))
    po = F.col("agree") / F.col("n")
    pe = ((F.col("both") + F.col("human_only")) * (F.col("both") + F.col("scorer_only")) + (F.col("neither") + F.col("scorer_only")) * (F.col("neither") + F.col("human_only"))) / (F.col("n") * F.col("n"))
    lo, hi = wilson(F.col("agree"), F.col("n"), clamp=False)
    return t.withColumn("kappa", F.when(F.col("n") > 0, F.when(pe == 1, 1.0).otherwise((po - pe) / (1 - pe)))).withColumn("lower", lo).withColumn("upper", hi)


def relabel(cases: DataFrame, key: str = "case_id") -> DataFrame:
    """cases: key, text, gold (array of start, end, type). Adds verdict: scored, or ambiguous for gold-less texts with a bare local
    number; gold-less texts with an identifier in a printed form get it as gold."""
    from maskwright.functions.text import find_spans
    from maskwright.operators.detect import IBAN

    t = F.col("text")
    p00, paren = r"(?<![0-9])00(?:966|971|964|962|965|973|20)[0-9 .\-]{7,14}[0-9]", r"\+(?:966|971|964|962|965|973|20) ?\([0-9]{2,3}\)[0-9 .\-]{5,12}[0-9]"
    local = t.rlike(r"(?<![0-9+])0?5[0-9][ \-]?[0-9]{3}[ \-]?[0-9]{4}(?![0-9])")
    found = F.concat(F.slice(find_spans(t, p00, "PHONE"), 1, 1), F.slice(find_spans(t, paren, "PHONE"), 1, 1), find_spans(t, IBAN, "IBAN"))
    slim = F.transform(found, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["entity_type"].alias("type")))
    bare = F.size("gold") == 0
    ambiguous = bare & local & ~t.rlike(p00) & ~t.rlike(paren)
    return cases.withColumn("verdict", F.when(ambiguous, "ambiguous").otherwise("scored")).withColumn("gold", F.when(bare & ~ambiguous, slim).otherwise(F.col("gold")))


def cluster_key(text: Column, spans: Column) -> Column:
    """A sentence's template: spans to a sign, runs of digits to 0."""
    from maskwright.operators.fuse import mask

    return F.regexp_replace(mask(text, spans, constant="§"), r"\p{Nd}+", "0")
