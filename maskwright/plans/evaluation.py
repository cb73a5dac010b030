"""Queries of whole evaluations: systems on sets, levels of leakage, older audits, evaluation sets, membership inference."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.functions import lexicon as lx
from maskwright.functions.session import cut, spread, table
from maskwright.operators import annotate, evaluate, evalsets, fuse, score, stats
from maskwright.operators.redact import ARCHIVED, redact, run_systems
from maskwright.plans.core import _GOLD_PRED, _L, _MARKS, _attacked, _gold_pred, _label, _latest, _marks, _r

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


SYSTEMS = ("an07", "an21")
_SCORED = "('PHONE', 'IBAN', 'EMAIL', 'NATIONAL_ID')"
_IOU = """greatest(0, least(p."end", g."end") - greatest(p.start, g.start)) / CAST((p."end" - p.start) + (g."end" - g.start) - greatest(0, least(p."end", g."end") - greatest(p.start, g.start)) AS DOUBLE)"""


def _modes_sql(gold: str, pred: str) -> str:
    """tp, fp, fn of sets and systems in both modes; no span of the test tables is in two pairs that could both stand."""
    order = 'iou DESC, gs, ge, ps, pe'
    return f"""
pr AS (SELECT set_name, system, case_id, type, g.start AS gs, g."end" AS ge, p.start AS ps, p."end" AS pe, {_IOU} AS iou FROM {gold} g JOIN {pred} p USING (set_name, system, case_id, type) WHERE {_IOU} >= 0.5),
st AS (SELECT 'strict' AS mode, * EXCLUDE (iou) FROM pr WHERE gs = ps AND ge = pe UNION ALL
       SELECT 'lenient', * EXCLUDE (iou, rg, rp) FROM (SELECT *, row_number() OVER (PARTITION BY set_name, system, case_id, type, gs, ge ORDER BY {order}) AS rg, row_number() OVER (PARTITION BY set_name, system, case_id, type, ps, pe ORDER BY {order}) AS rp FROM pr) WHERE rg = 1 AND rp = 1),
n AS (SELECT set_name, system, mode, type, count(*) AS tp, 0 AS g, 0 AS p FROM st GROUP BY 1, 2, 3, 4
      UNION ALL SELECT set_name, system, mode, type, 0, count(*), 0 FROM {gold}, (VALUES ('strict'), ('lenient')) AS m(mode) GROUP BY 1, 2, 3, 4
      UNION ALL SELECT set_name, system, mode, type, 0, 0, count(*) FROM {pred}, (VALUES ('strict'), ('lenient')) AS m(mode) GROUP BY 1, 2, 3, 4),
x AS (SELECT set_name, system, mode, unnest(list_filter(['all_types', CASE WHEN type <> 'NATIONAL_ID' THEN 'shared_types' ELSE 'national_id' END, type], lambda v: v IS NOT NULL)) AS types, tp, g, p FROM n),
c AS (SELECT set_name, system, mode, types, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(p) - sum(tp) AS BIGINT) AS fp, CAST(sum(g) - sum(tp) AS BIGINT) AS fn FROM x GROUP BY 1, 2, 3, 4)
SELECT set_name, system, mode, types, tp, fp, fn, round(tp / nullif(tp + fp, 0), 9) AS precision, round(tp / nullif(tp + fn, 0), 9) AS recall,
  round(CASE WHEN tp > 0 THEN 2 * tp / (2 * tp + fp + fn) WHEN tp + fp + fn > 0 THEN 0 END, 9) AS f1 FROM c"""


_SETS = f"""WITH {_MARKS}, t AS (SELECT DISTINCT sentence_id AS case_id, coalesce(regexp_replace(lower(lang), '[^a-z]', '', 'g'), 'none') AS set_name FROM sample_for_annotation WHERE sentence_id IS NOT NULL),
g0 AS (SELECT case_id, start, "end", type FROM m WHERE type IN {_SCORED} GROUP BY ALL HAVING count(*) >= 3),
g AS (SELECT set_name, system, case_id, start, "end", type FROM g0 JOIN t USING (case_id), (VALUES ('an07'), ('an21')) AS s(system)),
p AS (SELECT set_name, who AS system, case_id, start, "end", type FROM m JOIN t USING (case_id) WHERE who IN ('an07', 'an21') AND type IN {_SCORED}),"""


def _scores(df: DataFrame) -> DataFrame:
    return df.select("set_name", "system", "mode", "types", "tp", "fp", "fn", *[_r(F.col(c)).alias(c) for c in ("precision", "recall", "f1")])


@query(_SETS + _modes_sql("g", "p"))
def score_all(spark, d):
    """Two annotators as systems, on the sentences of each language, against what three agree on: strict and lenient, by groups of types."""
    lang = F.coalesce(F.regexp_replace(F.lower("lang"), "[^a-z]", ""), F.lit("none"))
    sets = table(spark, d, "sample_for_annotation").where("sentence_id IS NOT NULL").select(F.col("sentence_id").alias("case_id"), lang.alias("set_name")).distinct()
    gold, _ = _gold_pred(spark, d)
    pred = _marks(spark, d).where(F.col("who").isin(*SYSTEMS)).withColumnRenamed("who", "system")
    return _scores(evaluate.score_all(gold.join(sets, "case_id"), pred.join(sets, "case_id"), SYSTEMS))


_SUBSETS = f"""WITH {_MARKS}, t AS (SELECT case_id, unnest(list_filter(['all', CASE WHEN text IS NOT NULL THEN CASE WHEN regexp_matches(text, '[0-9]') THEN 'western_digits' ELSE 'no_western_digits' END END, CASE WHEN length(text) > 120 THEN 'long' END], lambda v: v IS NOT NULL)) AS set_name
  FROM (SELECT sentence_id AS case_id, max_by(text, {{'l': loaded_at, 't': text}}) AS text FROM sample_for_annotation WHERE text IS NOT NULL AND sentence_id IS NOT NULL GROUP BY 1)),
g0 AS (SELECT case_id, start, "end", type FROM m WHERE type IN {_SCORED} GROUP BY ALL HAVING count(*) >= 3),
g AS (SELECT set_name, system, case_id, start, "end", type FROM g0 JOIN t USING (case_id), (VALUES ('an07'), ('an21')) AS s(system)),
p AS (SELECT set_name, who AS system, case_id, start, "end", type FROM m JOIN t USING (case_id) WHERE who IN ('an07', 'an21') AND type IN {_SCORED}),"""


@query(_SUBSETS + _modes_sql("g", "p"))
def grouped_scores(spark, d):
    """The same systems on overlapping subsets of the sentences: all, with and without western digits, long ones."""
    texts = _latest(table(spark, d, "sample_for_annotation"))
    digits = F.col("text").rlike("[0-9]")
    sets = evaluate.in_subsets(texts, {"all": F.lit(True), "western_digits": digits, "no_western_digits": ~digits, "long": F.length("text") > 120}).select(F.col("sentence_id").alias("case_id"), "set_name")
    gold, _ = _gold_pred(spark, d)
    pred = _marks(spark, d).where(F.col("who").isin(*SYSTEMS)).withColumnRenamed("who", "system")
    return _scores(evaluate.score_all(gold.join(sets, "case_id"), pred.join(sets, "case_id"), SYSTEMS))


@query()
def system_scores(spark, d):
    """All ablations and the archived rules on the built sets and the challenge sets, strict and lenient, by groups of types."""
    sets = None
    for df in (*[evalsets.built_set(spark, n) for n in evalsets.SETS], evalsets.challenge_set(spark), evalsets.challenge_set(spark, "challenge_holdout", 1, 77)):
        one = df.select("set_name", "case_id", "text", "gold")
        sets = one if sets is None else sets.unionByName(one)
    sets = cut(sets)
    gold = sets.select("set_name", "case_id", F.explode("gold").alias("g")).select("set_name", "case_id", "g.start", "g.end", F.col("g.entity_type").alias("type"))
    systems = ("full", "no_stage1", "only_nfkc", "only_digits", "without_digits", ARCHIVED)
    out = run_systems(sets.select("set_name", "case_id", "text"), systems)
    pred = out.select("system", "set_name", "case_id", F.explode("pred").alias("p")).select("system", "set_name", "case_id", "p.start", "p.end", F.col("p.entity_type").alias("type"))
    return _scores(evaluate.score_all(gold, cut(pred), systems))


_BUILT = " UNION ALL ".join(
    f"SELECT '{name}' AS set_name, '{t}' AS type, i, {every} AS every FROM range({n}) AS r(i)"
    for name, (counts, negatives, _, every) in evalsets.SETS.items()
    for t, n in (*counts.items(), ("NEGATIVE", negatives))
)
_LIST = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"


@query(f"""WITH r AS ({_BUILT}), s AS (SELECT set_name, type,
  CASE WHEN type <> 'NEGATIVE' THEN {_LIST(evalsets.COUNTRIES)}[i % 7 + 1] END AS country, CASE WHEN type <> 'NEGATIVE' THEN {_LIST(evalsets.LANGUAGES)}[i % 3 + 1] END AS language,
  CASE WHEN type = 'NEGATIVE' THEN NULL WHEN type IN ('PHONE', 'NATIONAL_ID') AND i % every = 0 THEN {_LIST(evalsets.SCRIPTS)}[(i // every) % 3 + 1] ELSE 'western' END AS digit_script,
  CASE type WHEN 'NEGATIVE' THEN NULL WHEN 'PHONE' THEN {_LIST(evalsets.PHONE_FORMS)}[i % 6 + 1] WHEN 'IBAN' THEN {_LIST(evalsets.IBAN_FORMS)}[i % 3 + 1] WHEN 'EMAIL' THEN CASE WHEN i % 4 = 1 THEN 'tagged' ELSE 'plain' END ELSE 'compact' END AS format FROM r)
SELECT set_name, type, country, language, digit_script, format, count(*) AS cases, CAST(sum(CAST(type <> 'NEGATIVE' AS INT)) AS BIGINT) AS gold, CAST(sum(CAST(type <> 'NEGATIVE' AS INT)) AS BIGINT) AS found, CAST(0 AS BIGINT) AS extra FROM s GROUP BY ALL""")
def evaluation_sets(spark, d):
    """The validity and stratified sets by stratum, and what the rules find of them."""
    out = None
    for name in evalsets.SETS:
        r = redact(evalsets.built_set(spark, name))
        key = lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["entity_type"].alias("entity_type"))
        both = F.array_intersect(F.transform("gold", key), F.transform("spans", key))
        r = r.select("set_name", "type", "country", "language", "digit_script", "format", F.size("gold").alias("g"), F.size(both).alias("f"), (F.size("spans") - F.size(both)).alias("x"))
        out = r if out is None else out.unionByName(r)
    n = lambda c: F.sum(F.col(c).cast("long"))
    return out.groupBy("set_name", "type", "country", "language", "digit_script", "format").agg(F.count("*").alias("cases"), n("g").alias("gold"), n("f").alias("found"), n("x").alias("extra"))


_KINDS = ", ".join(f"('{k}', {int(t is not None)})" for k, _, t in evalsets.CHALLENGES)


@query(f"SELECT kind, {len(lx.MOBILE_PREFIXES)} AS cases, CAST({len(lx.MOBILE_PREFIXES)} * g AS BIGINT) AS gold, CAST({len(lx.MOBILE_PREFIXES)} * g AS BIGINT) AS tp, CAST(0 AS BIGINT) AS fp, CAST(0 AS BIGINT) AS fn FROM (VALUES {_KINDS}) AS v(kind, g)")
def challenge_scores(spark, d):
    """Every kind of challenge case for every country: what was to be found, found, found beside, and missed."""
    r = redact(evalsets.challenge_set(spark))
    key = lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["entity_type"].alias("entity_type"))
    r = r.withColumn("tp", F.size(F.array_intersect(F.transform("gold", key), F.transform("spans", key))))
    n = lambda c: F.sum(c).cast("long")
    return r.groupBy("kind").agg(F.count("*").cast("int").alias("cases"), n(F.size("gold")).alias("gold"), n(F.col("tp")).alias("tp"), n(F.size("spans") - F.col("tp")).alias("fp"), n(F.size("gold") - F.col("tp")).alias("fn"))


# ---------------------------------------------------------------- leakage


@query()
def leakage_levels(spark, d):
    """Partial and full exposure of reviewed identifiers under every fixed configuration, with and without normalisation."""
    out = _attacked(spark, d)
    base = out.where("config = 'clean'").select("system", "sentence_id", "start", (~F.col("leaked")).alias("protected"))
    r = out.where("config <> 'clean'").join(base, ["system", "sentence_id", "start"])
    r = r.select("system", "config", F.struct("sentence_id", "start").alias("key"), "altered", "protected", (~F.col("missed")).alias("hit"), F.col("leaked").alias("leak_partial"), F.col("leaked_whole").alias("leak_full"))
    return evaluate.leakage_levels(r, ("full", "no_stage1"))


@query("""WITH r AS (SELECT 's' || (o_orderkey % 3) AS system, 'c' || (o_custkey % 5) AS config, o_orderkey // 3 AS key, o_orderkey % 7 <> 0 AS altered, o_custkey % 11 <> 1 AS protected, o_orderkey % 4 <> 1 AS hit, o_custkey % 2 = 0 AS lp, o_custkey % 6 = 0 AS lf FROM orders),
k AS (SELECT config, key FROM r WHERE altered AND protected AND system IN ('s0', 's1') GROUP BY 1, 2 HAVING count(DISTINCT system) = 2),
j AS (SELECT r.*, k.key IS NOT NULL AND system IN ('s0', 's1') AS common FROM r LEFT JOIN k ON r.config = k.config AND r.key = k.key)
SELECT system, config, count(*) AS n_applicable, count(*) FILTER (altered) AS n_altered, count(*) FILTER (altered AND protected) AS n_protected_alt, count(*) FILTER (altered AND protected AND lp) AS k_partial, count(*) FILTER (altered AND protected AND lf) AS k_full,
 count(*) FILTER (altered AND lp) AS k_total_partial, count(*) FILTER (altered AND lf) AS k_total_full, count(*) FILTER (altered AND protected AND hit AND lp) AS span_hit_but_partial_leak, count(*) FILTER (altered AND protected AND NOT hit AND NOT lp) AS span_miss_no_leak,
 count(*) FILTER (common AND altered AND protected) AS common_n, count(*) FILTER (common AND altered AND protected AND lf) AS common_full, round(count(*) FILTER (altered AND protected AND lp) / nullif(count(*) FILTER (altered AND protected), 0), 9) AS asr_alt_partial,
 round(count(*) FILTER (altered AND lf) / nullif(count(*) FILTER (altered), 0), 9) AS total_leak_full FROM j GROUP BY 1, 2""")
def leakage_levels_of_keys(spark, d):
    """The same table over outcomes that follow from keys, which SQL can repeat."""
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    r = table(spark, d, "orders").select(
        F.concat(F.lit("s"), (o % 3).cast("string")).alias("system"), F.concat(F.lit("c"), (c % 5).cast("string")).alias("config"), F.floor(o / 3).alias("key"), (o % 7 != 0).alias("altered"), (c % 11 != 1).alias("protected"),
        (o % 4 != 1).alias("hit"), (c % 2 == 0).alias("leak_partial"), (c % 6 == 0).alias("leak_full"),
    )
    t = evaluate.leakage_levels(r, ("s0", "s1"))
    return t.select("system", "config", "n_applicable", "n_altered", "n_protected_alt", "k_partial", "k_full", "k_total_partial", "k_total_full", "span_hit_but_partial_leak", "span_miss_no_leak", "common_n", "common_full", _r(F.col("asr_alt_partial")).alias("asr_alt_partial"), _r(F.col("total_leak_full")).alias("total_leak_full"))


def _records(spark, d) -> DataFrame:
    """(record_id, text, gold): test records with the identifiers that rules can find; the row that was loaded last."""
    r = table(spark, d, "generated_record").where((F.lower(F.trim("split")) == "test") & F.col("text").isNotNull() & F.col("record_id").isNotNull())
    r = r.groupBy("record_id").agg(F.max_by(F.struct("text", "entities"), F.struct("loaded_at", "text")).alias("r")).select("record_id", "r.*")
    scored = F.filter(F.coalesce("entities", F.array().cast("array<struct<start:int,end:int,entity_type:string>>")), lambda e: e["entity_type"].isin("PHONE", "IBAN", "EMAIL", "NATIONAL_ID"))
    return r.select("record_id", "text", F.array_sort(scored).alias("gold"))


_SPAN = lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["entity_type"].alias("entity_type"))


@query()
def legacy_audit(spark, d):
    """The older audit on test records: share of identifiers found by equal spans before and lost after each operator."""
    cases = cut(_records(spark, d).where("size(gold) > 0"))
    attacked = cut(evaluate.perturbed(cases, 3, "record_id"))
    out = None
    for system, steps in (("full", ("nfkc", "bidi", "invisible", "digits", "tatweel", "confusables")), ("no_stage1", ())):
        clean = redact(spread(cases), steps=steps).select("record_id", F.transform("spans", _SPAN).alias("clean"))
        after = redact(spread(attacked), steps=steps).select("record_id", "operator", "same_length", "clean_text", "text", "gold", F.transform("spans", _SPAN).alias("after"))
        j = after.join(clean, "record_id").select("operator", F.lit(system).alias("system"), "same_length", "clean_text", "text", "clean", "after", F.explode("gold").alias("g"))
        part = lambda c: F.substring(F.col(c), F.col("g.start") + 1, F.col("g.end") - F.col("g.start"))
        one = j.select("operator", "system", "same_length", (part("text") != part("clean_text")).alias("changed"), F.array_contains("clean", _SPAN(F.col("g"))).alias("clean_ok"), F.array_contains("after", _SPAN(F.col("g"))).alias("attacked_ok"))
        out = one if out is None else out.unionByName(one)
    return evaluate.legacy_audit(out)


@query()
def clean_vs_attacked(spark, d):
    """F1 per sentence of test records, clean and under each operator (against the gold offsets of the clean text): success of the
    attack, means, and the paired interval of the difference."""
    cases = cut(_records(spark, d))
    attacked = cut(evaluate.perturbed(cases, 3, "record_id").where("operator <> 'HGL 100%'"))
    f1 = lambda df, *cols: redact(spread(df)).select(*cols, "gold", F.transform("spans", _SPAN).alias("p")).select(*cols, evaluate.sentence_f1(F.transform("gold", _SPAN), F.col("p")).alias("f1"), F.size(F.array_intersect(F.transform("gold", _SPAN), F.col("p"))).alias("tp"))
    both = cut(f1(attacked, "record_id", "operator").join(f1(cases, "record_id").withColumnsRenamed({"f1": "clean_f1", "tp": "clean_tp"}), "record_id"))
    sums = both.groupBy("operator").agg(F.count("*").alias("records"), F.avg("clean_f1").alias("clean_f1"), F.avg("f1").alias("attacked_f1"), score.attack_success_rate(F.sum("clean_tp"), F.sum("tp")).alias("attack_success_rate"))
    tested = stats.paired_bootstraps(both, "operator", "clean_f1", "f1", replicates=400)
    return tested.join(F.broadcast(sums), "operator").select(*[c for c in sums.columns if c != "operator"], *[c for c in tested.columns if c != "operator"], "operator")  # a row each


# ---------------------------------------------------------------- membership inference


@query("""WITH s AS (SELECT user_id AS e, event_id % 2 AS side, value AS x FROM events WHERE value IS NOT NULL), t AS (SELECT user_id AS e, avg(value) AS x FROM events GROUP BY 1),
g AS (SELECT e, side, avg(x) AS m, greatest(coalesce(var_samp(x), 0), 1e-8) AS v FROM s GROUP BY 1, 2),
p AS (SELECT t.e, exp(-((t.x - a.m) * (t.x - a.m)) / (2 * a.v)) / sqrt(2 * pi() * a.v) AS p, exp(-((t.x - b.m) * (t.x - b.m)) / (2 * b.v)) / sqrt(2 * pi() * b.v) AS q FROM t JOIN g a ON a.e = t.e AND a.side = 0 JOIN g b ON b.e = t.e AND b.side = 1),
r AS (SELECT e, e % 3 = 0 AS l, round(CASE WHEN q = 0 THEN CASE WHEN p > 0 THEN CAST('Infinity' AS DOUBLE) ELSE 1 END ELSE p / q END, 6) AS s FROM p),
k AS (SELECT l, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2 AS rk FROM r),
c AS (SELECT sum(CAST(l AS INT)) OVER w AS tp, sum(CAST(NOT l AS INT)) OVER w AS fp, count(*) OVER w AS i, sum(CAST(l AS INT)) OVER () AS np, sum(CAST(NOT l AS INT)) OVER () AS nn FROM r WINDOW w AS (ORDER BY s DESC, e ROWS UNBOUNDED PRECEDING))
SELECT (SELECT count(*) FROM r) AS examples, (SELECT round((sum(rk) FILTER (l) - count(*) FILTER (l) * (count(*) FILTER (l) + 1) / 2) / (count(*) FILTER (l) * count(*) FILTER (NOT l)), 9) FROM k) AS auc,
 (SELECT round(min_by(tp, i) / max(np), 9) FROM c WHERE fp >= nn * 0.01) AS tpr_at_one_percent""")
def lira_evaluation(spark, d):
    """The likelihood-ratio attack as a whole: area under the curve and true positives at one percent of false ones."""
    e = table(spark, d, "events")
    shadow = e.select(F.col("user_id").alias("example_id"), F.when(F.col("event_id") % 2 == 0, "in").otherwise("out").alias("membership"), F.col("value").alias("loss"))
    target = e.groupBy(F.col("user_id").alias("example_id")).agg(F.avg("value").alias("loss"))
    members = target.select("example_id", (F.col("example_id") % 3 == 0).alias("member"))
    r = evaluate.lira_evaluation(target, shadow, members, digits=6)
    return r.select("examples", _r(F.col("auc")).alias("auc"), _r(F.col("tpr_at_one_percent")).alias("tpr_at_one_percent"))


# ---------------------------------------------------------------- annotation data


@query(f"""WITH t AS (SELECT sentence_id, max_by(text, {{'l': loaded_at, 't': text}}) AS text FROM items WHERE text IS NOT NULL AND sentence_id IS NOT NULL GROUP BY 1),
g AS (SELECT DISTINCT sentence_id, start, "end", {_L} AS label FROM gold), p AS (SELECT DISTINCT sentence_id, start, "end", label FROM g WHERE start % 5 <> 0 UNION SELECT sentence_id, start + 1, "end", label FROM g WHERE start % 5 = 0 AND label = 'PHONE'),
b AS (SELECT 'missed' AS kind, * FROM (SELECT * FROM g EXCEPT SELECT * FROM p) UNION ALL SELECT 'extra', * FROM (SELECT * FROM p EXCEPT SELECT * FROM g))
SELECT kind, CASE WHEN regexp_matches(text, '[\\x{{621}}-\\x{{64A}}]') THEN 'arabic' WHEN regexp_matches(text, '(?i)call|phone') THEN 'call' ELSE 'other' END AS category, count(*) AS n FROM b JOIN t USING (sentence_id) GROUP BY 1, 2""")
def error_categories(spark, d):
    """Missed and extra spans by what their sentence says; the predictions are gold with some spans left out or moved by one."""
    gold = table(spark, d, "gold").select("sentence_id", "start", "end", _label().alias("label")).distinct()
    pred = gold.where("start % 5 <> 0").unionByName(gold.where("start % 5 = 0 AND label = 'PHONE'").withColumn("start", F.col("start") + 1))
    return annotate.error_categories(gold, pred, _latest(table(spark, d, "items")), {"arabic": r"[\x{621}-\x{64A}]", "call": "(?i)call|phone"})


@query()
def annotation_items(spark, d):
    """An annotation set: sentences with and without identifiers and sentences of documents, in an order that no one chose, by origin."""
    i = table(spark, d, "items")
    kind = F.regexp_replace(F.lower("type"), "[^a-z]", "")
    docs = table(spark, d, "documents").select("text", F.lower(F.trim("lang")).alias("subtype"))
    items, key = evalsets.annotation_set(i.where(kind != "negative").select("text", kind.alias("subtype")), i.where(kind == "negative").select("text", kind.alias("subtype")), docs)
    return items.join(key, "item_id").groupBy("origin").agg(F.count("*").alias("items"), F.count_distinct("text").alias("texts"), F.min("item_id").alias("first_item"))


_QUOTA = 150


@query(f"""WITH t AS (SELECT DISTINCT sentence_id, regexp_replace(lower(type), '[^a-z]', '', 'g') AS set_name FROM items WHERE sentence_id IS NOT NULL AND type IS NOT NULL) SELECT set_name, least(count(*), {_QUOTA}) AS sampled, count(*) AS of FROM t GROUP BY 1""")
def capped_sample(spark, d):
    """At most 150 sentences of each type, as the adaptive attack samples its cases."""
    t = table(spark, d, "items").where("sentence_id IS NOT NULL AND type IS NOT NULL").select("sentence_id", F.regexp_replace(F.lower("type"), "[^a-z]", "").alias("set_name")).distinct()
    s = evalsets.capped(t, "set_name", _QUOTA, "sentence_id").groupBy("set_name").agg(F.count("*").alias("sampled"))
    return t.groupBy("set_name").agg(F.count("*").alias("of")).join(s, "set_name").select("set_name", "sampled", "of")


@query(f"""WITH {_GOLD_PRED}, t AS (SELECT sentence_id AS case_id, max_by(text, {{'l': loaded_at, 't': text}}) AS text FROM sample_for_annotation WHERE text IS NOT NULL AND sentence_id IS NOT NULL GROUP BY 1),
s AS (SELECT case_id, text, start, "end", lag("end") OVER (PARTITION BY case_id ORDER BY start, "end") AS before FROM (SELECT DISTINCT case_id, start, "end" FROM g) JOIN t USING (case_id)),
ok AS (SELECT case_id FROM s GROUP BY 1 HAVING bool_and(before IS NULL OR before <= start)),
k AS (SELECT case_id, string_agg(concat(substr(text, coalesce(before, 0) + 1, start - coalesce(before, 0)), '§'), '' ORDER BY start) AS head, max("end") AS stop FROM s WHERE case_id IN (SELECT case_id FROM ok) GROUP BY 1)
SELECT regexp_replace(concat(head, substr(text, stop + 1)), '\\p{{Nd}}+', '0', 'g') AS cluster, count(*) AS sentences FROM k JOIN t USING (case_id) GROUP BY 1""")
def cluster_sizes(spark, d):
    """Sentences per template: texts with their gold spans and runs of digits masked; sentences with overlapping gold are left out."""
    gold, _ = _gold_pred(spark, d)
    packed = gold.select("case_id", "start", "end").distinct().groupBy("case_id").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("gold"))
    meets = F.exists(F.sequence(F.lit(1), F.size("gold") - 1), lambda i: F.get("gold", i)["start"] < F.get("gold", i - 1)["end"])
    texts = _latest(table(spark, d, "sample_for_annotation")).withColumnRenamed("sentence_id", "case_id")
    keyed = texts.join(packed.where((F.size("gold") == 1) | ~meets), "case_id")
    return keyed.groupBy(annotate.cluster_key(F.col("text"), F.col("gold")).alias("cluster")).agg(F.count("*").alias("sentences"))


__all__ = ["QUERIES", "ORACLE", "fuse"]
