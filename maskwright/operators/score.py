"""Matching predictions with gold, and what is computed from the matches."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskwright.functions import lexicon as lx
from maskwright.functions import text as tx
from maskwright.functions.session import cut

KEY = ["case_id", "start", "end", "type"]


def explode_spans(df: DataFrame, case_id: str, spans: str) -> DataFrame:
    """(case_id, start, end, type) from a column of spans."""
    return df.select(F.col(case_id).alias("case_id"), F.explode(spans).alias("s")).select("case_id", "s.start", "s.end", F.col("s.entity_type").alias("type"))


def iou(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    inter = F.greatest(F.lit(0), F.least(a_end, b_end) - F.greatest(a_start, b_start))
    union = (a_end - a_start) + (b_end - b_start) - inter
    return F.when(union != 0, inter / union).otherwise(0.0)


def match_exact(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """KEY with outcome tp, fp or fn. Both sides are sets: repeated rows count once; rows with a null are dropped."""
    g = gold.select(*KEY).dropna().distinct().withColumn("g", F.lit(1))
    p = pred.select(*KEY).dropna().distinct().withColumn("p", F.lit(1))
    outcome = F.when(F.col("g").isNull(), "fp").when(F.col("p").isNull(), "fn").otherwise("tp")
    return g.join(p, KEY, "full_outer").select(*KEY, outcome.alias("outcome"))


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _greedy(candidates: pd.Series) -> pd.Series:
    """Of candidates in order of preference the numbers of those that stand: each takes its gold and its predicted span away."""

    def one(c) -> list[int] | None:
        if c is None:
            return None
        used_g, used_p, out = set(), set(), []
        for i, x in enumerate(c):
            g, p = (x["gs"], x["ge"]), (x["ps"], x["pe"])
            if g not in used_g and p not in used_p:
                used_g.add(g)
                used_p.add(p)
                out.append(i)
        return out

    return candidates.map(one)


def match_iou(gold: DataFrame, pred: DataFrame, threshold: float = 0.5) -> DataFrame:
    """KEY with outcome, one to one: pairs of one case and type with IoU of at least the threshold, best first, ties by position;
    a pair stands if neither of its spans has been taken by a better one.

    The equi key is case and type, overlap is the residual, so that cases are joined in parallel. Only pairs that reach the
    threshold are brought together, per case and type - spans of one text. Nearly always there is one, which stands; where there
    are several, the order is gone through once.
    """
    g, p = gold.select(*KEY).dropna().distinct(), pred.select(*KEY).dropna().distinct()
    cand = g.select("case_id", "type", F.col("start").alias("gs"), F.col("end").alias("ge")).join(p.select("case_id", "type", F.col("start").alias("ps"), F.col("end").alias("pe")), ["case_id", "type"])
    cand = cand.withColumn("iou", iou(F.col("gs"), F.col("ge"), F.col("ps"), F.col("pe"))).where(F.col("iou") >= threshold)
    packed = cand.groupBy("case_id", "type").agg(F.sort_array(F.collect_list(F.struct((-F.col("iou")).alias("d"), "gs", "ge", "ps", "pe"))).alias("c"))
    several = F.size("c") > 1
    taken = F.when(several, F.transform(_greedy(F.when(several, F.col("c"))), lambda i: F.get("c", i))).otherwise(F.col("c"))
    stands = cut(packed.select("case_id", "type", F.explode(taken).alias("x")).select("case_id", "type", "x.gs", "x.ge", "x.ps", "x.pe"))
    hit_g = stands.select("case_id", "type", F.col("gs").alias("start"), F.col("ge").alias("end"))
    hit_p = stands.select("case_id", "type", F.col("ps").alias("start"), F.col("pe").alias("end"))
    out = hit_g.select(*KEY).withColumn("outcome", F.lit("tp"))
    out = out.unionByName(g.join(hit_g, KEY, "left_anti").withColumn("outcome", F.lit("fn")))
    return out.unionByName(p.join(hit_p, KEY, "left_anti").withColumn("outcome", F.lit("fp")))


def counts(matched: DataFrame, *by: str) -> DataFrame:
    n = lambda k: F.sum((F.col("outcome") == k).cast("long")).alias(k)
    return matched.groupBy(*by).agg(n("tp"), n("fp"), n("fn"))


def counts_with_total(matched: DataFrame, *by: str) -> DataFrame:
    """counts by type within `by`, and one row of type ALL for each, in one pass."""
    n = lambda k: F.coalesce(F.sum((F.col("outcome") == k).cast("long")), F.lit(0)).alias(k)
    cube = matched.withColumn("__t", F.col("type")).rollup(*by, "__t").agg(n("tp"), n("fp"), n("fn"), F.grouping_id().alias("__g"))
    return cube.where("__g <= 1").select(*by, F.when(F.col("__g") == 1, "ALL").otherwise(F.col("__t")).alias("type"), "tp", "fp", "fn")


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b)


def prf(tp: Column, fp: Column, fn: Column, undefined: float | None = 0.0) -> list[Column]:
    """precision, recall, f1. An undefined ratio is `undefined`: 0.0 in one convention, null in the other, in which f1 is 0 when
    something was wrong and null only when there was nothing at all."""
    p, r = _ratio(tp, tp + fp), _ratio(tp, tp + fn)
    if undefined is None:
        f = F.when((p > 0) & (r > 0), 2 * p * r / (p + r)).when(tp + fp + fn > 0, 0.0)
        return [p.alias("precision"), r.alias("recall"), f.alias("f1")]
    p, r = F.coalesce(p, F.lit(undefined)), F.coalesce(r, F.lit(undefined))
    return [p.alias("precision"), r.alias("recall"), F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0).alias("f1")]


def wilson(k: Column, n: Column, z: float = 1.96, clamp: bool = True) -> tuple[Column, Column]:
    """Score interval of a proportion; null for n = 0."""
    p = k / n
    d = 1 + z * z / n
    mid = (p + z * z / (2 * n)) / d
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / d
    lo, hi = (F.greatest(F.lit(0.0), mid - half), F.least(F.lit(1.0), mid + half)) if clamp else (mid - half, mid + half)
    return F.when(n > 0, lo), F.when(n > 0, hi)


def upper_if_zero(n: Column, alpha: float = 0.05) -> Column:
    """Exact upper bound of a proportion of which none was seen in n."""
    return F.when(n > 0, 1 - F.pow(F.lit(alpha), 1 / n))


def attack_success_rate(clean: Column, attacked: Column) -> Column:
    return F.when(clean == 0, 0.0).otherwise(F.greatest(F.lit(0.0), (clean - attacked) / clean))


def privacy_utility(recall: Column, prir: Column) -> Column:
    priv = 1 - prir
    return F.when(recall + priv == 0, 0.0).otherwise(2 * recall * priv / (recall + priv))


def stratum(text: Column, value: Column, etype: Column) -> Column:
    """country, digit script, context language and format of one identifier in its sentence."""
    compact = F.replace(tx.nfkc(value), F.lit(" "), F.lit(""))
    plus = F.when(compact.startswith("00"), F.concat(F.lit("+"), F.substring(compact, 3, 1000))).otherwise(compact)
    country = F.lit("other")
    for code in lx.CALLING_CODES:
        country = F.when(plus.startswith("+" + code), lx.CALLING_CODES[code]).otherwise(country)
    country = F.when(etype == "PHONE", country).when(etype == "IBAN", F.upper(F.substring(compact, 1, 2))).otherwise("n/a")
    form = F.when((etype == "IBAN") & F.substring(value, 1, 2).rlike("^[a-z]{2}$"), "lowercase").when(value.rlike(r"[ \-.()]"), "spaced/grouped").otherwise("compact")
    return F.struct(country.alias("country"), tx.digit_script(value).alias("digit_script"), tx.context_language(text).alias("context_language"), form.alias("format"))


def false_positives_on_negatives(cases: DataFrame, gold: DataFrame, pred: DataFrame) -> DataFrame:
    """One row: cases without gold, those flagged, spans flagged in them."""
    negatives = cases.select("case_id").distinct().join(gold.select("case_id"), "case_id", "left_anti")
    hits = negatives.join(pred.select(*KEY).distinct(), "case_id", "left")
    return hits.agg(F.countDistinct("case_id").alias("negatives"), F.countDistinct(F.when(F.col("start").isNotNull(), F.col("case_id"))).alias("flagged"), F.count("start").alias("spans"))


def flagged_context(df: DataFrame, key: str, text: str, spans: str, around: int = 25) -> DataFrame:
    """Each span with the characters around it, for reading false positives."""
    s = df.select(key, F.col(text).alias("t"), F.explode(spans).alias("s"))
    lo = F.greatest(F.lit(0), F.col("s.start") - around)
    return s.select(key, F.col("s.entity_type").alias("type"), F.substring(F.col("t"), lo + 1, F.col("s.end") + around - lo).alias("context"))
