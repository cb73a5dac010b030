"""Evaluations as whole tables: systems on sets in both modes and by groups, levels of leakage, older attack audits, shadow models."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.operators import attacks, score, stats
from maskwright.schema import SCORED_TYPES

SHARED_TYPES = ("PHONE", "EMAIL", "IBAN")
KEY = ["start", "end", "type"]


def _groups(t: Column) -> Column:
    """The groups of types that a type counts in: all, those that other systems know as well, national ids, and itself."""
    some = [F.when(t.isin(*SCORED_TYPES), "all_types"), F.when(t.isin(*SHARED_TYPES), "shared_types"), F.when(t == "NATIONAL_ID", "national_id"), F.when(t.isin(*SCORED_TYPES), t)]
    return F.filter(F.array(*some), lambda x: x.isNotNull())


def score_all(gold: DataFrame, pred: DataFrame, systems) -> DataFrame:
    """(set_name, system, mode, types, tp, fp, fn, precision, recall, f1 and intervals of recall and precision).

    gold: set_name, case_id, start, end, type. pred: the same with system. Every system is scored on every set, also where it found
    nothing; mode is strict (equal spans) or lenient (IoU of one half, one to one). Undefined ratios are null. A case may be in
    several sets: that is how subsets of one set are scored together.
    """
    case = F.struct("system", "set_name", "case_id").alias("case_id")
    g = gold.where(F.col("type").isin(*SCORED_TYPES)).withColumn("system", F.explode(F.array(*[F.lit(s) for s in systems]))).select(case, *KEY)
    p = pred.where(F.col("type").isin(*SCORED_TYPES) & F.col("system").isin(*systems)).select(case, *KEY)
    both = score.match_exact(g, p).withColumn("mode", F.lit("strict")).unionByName(score.match_iou(g, p).withColumn("mode", F.lit("lenient")))
    long = both.select(F.col("case_id.set_name").alias("set_name"), F.col("case_id.system").alias("system"), "mode", "outcome", F.explode(_groups(F.col("type"))).alias("types"))
    c = score.counts(long, "set_name", "system", "mode", "types")
    p_, r_, f_ = score.prf(F.col("tp"), F.col("fp"), F.col("fn"), undefined=None)
    r_lo, r_hi = score.wilson(F.col("tp"), F.col("tp") + F.col("fn"))
    p_lo, p_hi = score.wilson(F.col("tp"), F.col("tp") + F.col("fp"))
    return c.select("*", p_, r_, f_, r_lo.alias("recall_lower"), r_hi.alias("recall_upper"), p_lo.alias("precision_lower"), p_hi.alias("precision_upper"))


def in_subsets(cases: DataFrame, subsets: dict[str, Column]) -> DataFrame:
    """cases once for each subset that it is in, named by set_name."""
    names = F.filter(F.array(*[F.when(c, F.lit(k)) for k, c in subsets.items()]), lambda x: x.isNotNull())
    return cases.withColumn("set_name", F.explode(names))


def shifted_sentences(df: DataFrame, text: str = "text", normalized: str = "normalized") -> Column:
    """How many texts changed their length in normalising, so that offsets moved."""
    return F.sum((F.length(text) != F.length(normalized)).cast("long"))


def leakage_levels(records: DataFrame, common: tuple[str, ...]) -> DataFrame:
    """Partial and full exposure, over protected and over all altered identifiers, per system and configuration.

    records: system, config, key, altered, protected (in the clean text), hit (its span was found), leak_partial (a fragment can be
    read), leak_full (all of it). common_*: over the identifiers that all systems of `common` protect, for those systems.
    """
    n = lambda c: F.sum(c.cast("long"))
    alt, prot, lp, lf, hit = (F.col(c) for c in ("altered", "protected", "leak_partial", "leak_full", "hit"))
    shared = records.where(alt & prot & F.col("system").isin(*common)).groupBy("config", "key").agg(F.count_distinct("system").alias("n")).where(F.col("n") == len(set(common)))
    r = records.join(shared.select("config", "key", F.lit(True).alias("c")), ["config", "key"], "left")
    r = r.withColumn("common", F.coalesce("c", F.lit(False)) & F.col("system").isin(*common))
    t = r.groupBy("system", "config").agg(
        F.count("*").alias("n_applicable"), n(alt).alias("n_altered"), n(alt & ~prot).alias("n_clean_missed_altered"), n(alt & prot).alias("n_protected_alt"),
        n(alt & prot & lp).alias("k_partial"), n(alt & prot & lf).alias("k_full"), n(alt & lp).alias("k_total_partial"), n(alt & lf).alias("k_total_full"),
        n(alt & prot & hit).alias("span_hit"), n(alt & prot & hit & lp).alias("span_hit_but_partial_leak"), n(alt & prot & hit & lf).alias("span_hit_but_full_leak"), n(alt & prot & ~hit & ~lp).alias("span_miss_no_leak"),
        n(F.col("common") & alt & prot).alias("common_n"), n(F.col("common") & alt & prot & lp).alias("common_partial"), n(F.col("common") & alt & prot & lf).alias("common_full"),
    )
    rate = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b))
    return t.select(
        "*", rate("k_partial", "n_protected_alt").alias("asr_alt_partial"), rate("k_full", "n_protected_alt").alias("asr_alt_full"),
        rate("k_total_partial", "n_altered").alias("total_leak_partial"), rate("k_total_full", "n_altered").alias("total_leak_full"),
    )


#: The older audit's operators with their budgets.
PERTURBATIONS = (("ARZ", "ARZ", None), ("TAT", "TAT", None), ("DIA", "DIA", None), ("HGL 20%", "HGL", 0.2), ("HGL 100%", "HGL", 1.0), ("CMB", "CMB", None))


def perturb(text: Column, spans: Column, op: str, budget: float | None, draw: attacks.Draw) -> Column:
    """An operator with its budget on every span of a text: what apply_to_spans gives."""
    own = lambda i: (lambda name, *at: draw(name, i, *at))
    if op == "HGL":
        return attacks.apply_to_spans(text, spans, lambda ident, etype, i: attacks.homoglyphs(ident, own(i), budget))
    return attacks.apply_to_spans(text, spans, lambda ident, etype, i: attacks.TEXT_OPS[op](ident, own(i)))


def perturbed(cases: DataFrame, seed: int, key: str) -> DataFrame:
    """cases (key, text, gold) once for each of PERTURBATIONS: operator, clean_text, text, gold, new_gold, same_length."""
    out = None
    draw = attacks.drawing(seed, F.col(key))
    for name, op, budget in PERTURBATIONS:
        one = cases.withColumn("a", perturb(F.col("text"), F.col("gold"), op, budget, draw))
        one = one.select(key, F.lit(name).alias("operator"), F.col("text").alias("clean_text"), F.col("a.text").alias("text"), "gold", F.col("a.gold").alias("new_gold"))
        out = one if out is None else out.unionByName(one)
    return out.withColumn("same_length", F.length("text") == F.length("clean_text"))


def legacy_audit(judged: DataFrame) -> DataFrame:
    """The older audit, by equal spans: sentences whose length changed are left out and counted.

    judged: operator, system, same_length, changed, clean_ok, attacked_ok - a row per identifier.
    """
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    s, ch, c, a = (F.col(x) for x in ("same_length", "changed", "clean_ok", "attacked_ok"))
    t = judged.groupBy("operator", "system").agg(
        n(~s).alias("identifiers_of_changed_length"), n(s).alias("n_in_scope"), n(s & ch).alias("n_changed"), n(s & c).alias("clean_tp"), n(s & c & a).alias("adv_tp_all"),
        n(s & ch & c).alias("changed_clean_tp"), n(s & ch & c & a).alias("changed_adv_tp"),
    )
    missed = F.col("changed_clean_tp") - F.col("changed_adv_tp")
    lo, hi = score.wilson(missed, F.col("changed_clean_tp"))
    rate = lambda x, y: F.when(y > 0, x / y)
    return t.select(
        "*", rate(F.col("clean_tp") - F.col("adv_tp_all"), F.col("clean_tp")).alias("asr_over_all_clean_tp"), rate(missed, F.col("changed_clean_tp")).alias("asr_over_changed"), lo.alias("lower"), hi.alias("upper"),
        F.when(missed == 0, score.upper_if_zero(F.col("changed_clean_tp"))).alias("upper_if_zero"),
    )


def sentence_f1(gold: Column, pred: Column) -> Column:
    """F1 of one sentence by equal spans: 0 where nothing is found or expected wrongly, as the first convention has it."""
    g, p = F.array_distinct(gold), F.array_distinct(pred)
    tp = F.size(F.array_intersect(g, p))
    return F.when(F.size(g) + F.size(p) > 0, 2 * tp / (F.size(g) + F.size(p))).otherwise(0.0)


class Shadow(Protocol):
    """Trains a shadow model on a random half of the data and tells the loss of every example, in the half and out of it."""

    def train_and_score(self, seed: int) -> tuple[dict[str, float], dict[str, float]]: ...


def shadow_losses(spark: SparkSession, trainer: Shadow, seeds) -> DataFrame:
    """(model_id, example_id, membership, loss) of one shadow model per seed."""
    out = None
    for s in seeds:
        inside, outside = trainer.train_and_score(s)
        rows = [(f"shadow{s}", str(k), m, float(v)) for m, side in (("in", inside), ("out", outside)) for k, v in side.items()]
        one = spark.createDataFrame(rows, "model_id string, example_id string, membership string, loss double")
        out = one if out is None else out.unionByName(one)
    return out


def lira_evaluation(target: DataFrame, shadow: DataFrame, members: DataFrame, digits: int | None = None) -> DataFrame:
    """One row: examples, area under the curve and true positive rate at one percent of the likelihood-ratio attack.

    members: example_id, member. Examples without shadow losses on both sides are left out. digits: scores are rounded to so many,
    for comparing engines.
    """
    s = stats.lira(target, shadow).join(members, "example_id")
    s = s.withColumn("score", F.round("score", digits)) if digits is not None else s
    a = stats.auc(s, "member", "score")
    return a.crossJoin(F.broadcast(stats.tpr_at_fpr(s, "member", "score", "example_id"))).select((F.col("positives") + F.col("negatives")).alias("examples"), "auc", F.col("tpr").alias("tpr_at_one_percent"))  # one row each
