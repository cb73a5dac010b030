"""Metrics, leaks, attacks, statistics, annotation: closed forms and brute force."""

import math
import random

import pytest
from pyspark.sql import functions as F

from maskwright.operators import annotate, attacks, leaks, score, stats, synth

KEYS = "case_id int, start int, end int, type string"


def test_match_and_prf(spark):
    g = spark.createDataFrame([(1, 0, 5, "A"), (1, 10, 20, "B"), (2, 0, 3, "A"), (2, 0, 3, "A"), (3, None, 3, "A")], KEYS)
    p = spark.createDataFrame([(1, 0, 5, "A"), (1, 11, 20, "B"), (3, 0, 3, "A")], KEYS)
    c = {r.type: (r.tp, r.fp, r.fn) for r in score.counts_with_total(score.match_exact(g, p)).collect()}
    assert c == {"A": (1, 1, 1), "B": (0, 1, 1), "ALL": (1, 2, 2)}
    c = {r.type: (r.tp, r.fp, r.fn) for r in score.counts_with_total(score.match_iou(g, p)).collect()}
    assert c["B"] == (1, 0, 0)
    one = spark.createDataFrame([(0, 0, 0), (1, 0, 0), (0, 1, 0)], "tp int, fp int, fn int")
    zero = one.select(*score.prf(F.col("tp"), F.col("fp"), F.col("fn"))).collect()
    none = one.select(*score.prf(F.col("tp"), F.col("fp"), F.col("fn"), undefined=None)).collect()
    assert tuple(zero[0]) == (0.0, 0.0, 0.0) and tuple(none[0]) == (None, None, None) and none[2].f1 == 0.0 and zero[1].f1 == 1.0


def test_match_iou_takes_the_best_first(spark):
    """A chain of spans in which each overlaps the next is settled to its end."""
    g = [("c", 10 * i, 10 * i + 20, "T") for i in range(9)]
    p = [("c", 10 * i + 5, 10 * i + 25 - (i % 3), "T") for i in range(9)]
    cols = "case_id string, start int, end int, type string"
    got = {(r.start, r.end, r.outcome) for r in score.match_iou(spark.createDataFrame(g + g[:2], cols), spark.createDataFrame(p, cols)).collect()}

    def iou(a, b):
        i = max(0, min(a[2], b[2]) - max(a[1], b[1]))
        return i / (a[2] - a[1] + b[2] - b[1] - i)

    used, hit = set(), set()
    for _, a, b in sorted((-iou(a, b), a, b) for a in g for b in p if iou(a, b) >= 0.5):
        if ("g", a) not in used and ("p", b) not in used:
            used |= {("g", a), ("p", b)}
            hit.add(a)
    want = {(a[1], a[2], "tp" if a in hit else "fn") for a in g} | {(b[1], b[2], "fp") for b in p if ("p", b) not in used}
    assert got == want and len(hit) > 4


def test_running_sums_in_ranges(spark):
    rows = [(i, (i * 7919) % 101, i % 3) for i in range(500)]
    df = spark.createDataFrame(rows, "k int, s int, v int")
    from maskwright.functions.session import running_sums

    got = {r.k: (r.n, r.t) for r in running_sums(df, [F.col("s").desc(), F.col("k")], {"n": F.lit(1), "t": F.col("v")}).collect()}
    n = t = 0
    for k, _, v in sorted(rows, key=lambda r: (-r[1], r[0])):
        n, t = n + 1, t + v
        assert got[k] == (n, t)
    assert running_sums(df.where("false"), [F.col("s")], {"n": F.lit(1)}).count() == 0


def test_intervals(spark):
    df = spark.createDataFrame([(8, 10), (0, 10), (0, 0)], "k int, n int")
    lo, hi = score.wilson(F.col("k"), F.col("n"))
    r = df.select(lo.alias("lo"), hi.alias("hi"), score.upper_if_zero(F.col("n")).alias("u"), stats.clopper_pearson_upper("k", "n").alias("cp")).collect()
    assert abs(r[0].lo - 0.49016) < 1e-4 and abs(r[0].hi - 0.94332) < 1e-4 and r[2].lo is None
    assert abs(r[1].u - (1 - 0.05 ** 0.1)) < 1e-12 and abs(r[1].cp - (1 - 0.05 ** 0.1)) < 1e-6 and r[2].u is None


def test_auc_and_tpr(spark):
    def run(labels, scores, target=0.5):
        df = spark.createDataFrame([(i, a, float(b)) for i, (a, b) in enumerate(zip(labels, scores))], "k int, l int, s double")
        return stats.auc(df, "l", "s").first().auc, stats.tpr_at_fpr(df, "l", "s", "k", target).first().tpr

    assert run([1, 1, 1, 0, 0, 0], [0.9, 0.8, 0.7, 0.3, 0.2, 0.1])[0] == 1.0
    assert run([1, 1, 0, 0], [0.5] * 4)[0] == 0.5 and run([0, 0, 1, 1], [0.9, 0.8, 0.2, 0.1])[0] == 0.0 and run([1, 1], [0.1, 0.2])[0] == 0.5
    assert run([1, 1, 0, 0], [0.9, 0.8, 0.2, 0.1])[1] == 1.0


def test_lira(spark):
    target = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("c", 1.0)], "example_id string, loss double")
    shadow = spark.createDataFrame([("a", "in", 1.0), ("a", "in", 1.2), ("a", "out", 3.0), ("a", "out", 3.2), ("b", "in", 1.0), ("c", "in", 1.0), ("c", "out", 9.0)], "example_id string, membership string, loss double")
    r = {x.example_id: x.score for x in stats.lira(target, shadow).collect()}
    assert set(r) == {"a", "c"} and r["a"] > 1e6 and r["c"] == math.inf


def test_bootstrap(spark):
    same = spark.createDataFrame([(float(i % 5), float(i % 5)) for i in range(40)], "a double, b double")
    r = stats.paired_bootstrap(same, "a", "b", replicates=100).first()
    assert (r.observed_diff, r.ci_lower, r.ci_upper) == (0.0, 0.0, 0.0)
    better = spark.createDataFrame([(0.95 + (i % 3) / 100, 0.6 + (i % 7) / 50) for i in range(60)], "a double, b double")
    r = stats.paired_bootstrap(better, "a", "b", replicates=200).first()
    assert r.ci_lower > 0 and r.p_value < 0.05
    with pytest.raises(ValueError):
        stats.paired_bootstrap(spark.createDataFrame([(1.0, None)], "a double, b double"), "a", "b")
    per = spark.createDataFrame([(c, s, 8 if s == "x" else 5, 1, 2 if s == "x" else 6) for c in range(20) for s in "xy"], "cluster int, system string, tp int, fp int, fn int")
    r = stats.cluster_bootstrap(per, "cluster", ("x", "y"), replicates=50).first()
    assert r.clusters == 20 and r.excludes_zero and abs(r.f1_x - 16 / 19) < 1e-12


def test_kappa(spark):
    texts = spark.createDataFrame([("s", "abcdefghij")], "sentence_id string, text string")
    spans = lambda rows: spark.createDataFrame(rows, "sentence_id string, start int, end int, label string")
    a = spans([("s", 0, 4, "PHONE")])
    assert stats.kappa_of_characters(texts, a, a).first().kappa == 1.0
    r = stats.kappa_of_characters(texts, a, spans([("s", 0, 2, "PHONE")])).first()
    po, pe = 0.8, (6 * 8 + 4 * 2) / 100
    assert r.units == 10 and abs(r.kappa - (po - pe) / (1 - pe)) < 1e-12
    assert stats.kappa_of_characters(texts, spans([]), spans([])).first().kappa == 1.0


def test_leaks(spark):
    rows = [("user123@example.com", "Contact [EMAIL]. Example company.", "Contact . Example company."), ("+966501234567", "call +٩٦٦ ٥٠١ ٢٣٤ ٥٦٧", "call "), ("ab1", "x ab1", "x "), ("a1b2c3d4", "a1b2c3d4 [ID]", "a1b2c3d4 "), (None, "x", "x")]
    df = spark.createDataFrame(rows, "i string, o string, c string")
    r = df.select(leaks.leaks_v1(F.col("i"), F.col("o")).alias("a"), leaks.leaks_v2a(F.col("i"), F.col("o"), F.col("c")).alias("b"), leaks.leaks(F.col("i"), F.col("o"), F.col("c")).alias("d")).collect()
    assert [x.a for x in r[:4]] == [True, True, True, True]
    assert [x.b for x in r[:4]] == [False, True, True, False]
    assert [x.d for x in r[:4]] == [False, True, True, True]


def test_leaks_by_arrow_equal_columns(spark):
    rng = __import__("random").Random(4)
    keys = synth.scorer_cases(synth.scorer_identifiers(spark.range(20), "id")).select("identifier", "output", "context")
    parts = ["+966501234567", "٠٥٠١", "Сa", "ab\u200bcd", "ﻻ", "É", "ᎪᏴ", "user7@x.co", " ", "-", "7", "aaaa", "\U0001d7d9"]
    say = lambda n: "".join(rng.choice(parts) for _ in range(n))
    odd = [(say(rng.randint(0, 4)), say(rng.randint(0, 8)), say(rng.randint(0, 8))) for _ in range(300)] + [(None, "x", "y"), ("x", None, "y"), ("abcdefg", "abcdefg", None), ("", "x", "")]
    df = keys.unionByName(spark.createDataFrame(odd, "identifier string, output string, context string"))
    i, o, c = F.col("identifier"), F.col("output"), F.col("context")
    got = df.select("*", leaks.leaks_of(i, o, c, (6, 10**6)).alias("l"), leaks.leaks(i, o, c).alias("a"), leaks.leaks(i, o, c, 10**6).alias("b")).collect()
    for r in got:
        assert (r.l or [None, None]) == [r.a, r.b], r


def test_occurrences_and_jaccard(spark):
    df = spark.createDataFrame([("aaaa", "aa"), ("abc", ""), ("abc", "d")], "h string, n string")
    assert [r[0] for r in df.select(leaks.occurrences(F.col("h"), F.col("n"))).collect()] == [3, 0, 0]
    rng = random.Random(2)
    pairs = [("".join(rng.choice("ab c") for _ in range(rng.randint(0, 12))), "".join(rng.choice("ab c") for _ in range(rng.randint(0, 12)))) for _ in range(60)]
    g = lambda s: {s[i : i + 3] for i in range(len(s) - 2)}
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", leaks.trigram_jaccard(F.col("a"), F.col("b")).alias("j")).collect()
    for r in got:
        x, y = g(r.a), g(r.b)
        assert abs(r.j - (len(x & y) / len(x | y) if x and y else 0)) < 1e-12


def test_attacks(spark):
    df = spark.createDataFrame([(i, f"user{i}@mail.test") for i in range(30)], "id int, t string")
    draw = attacks.drawing(1, F.col("id"))
    for name, op in attacks.IDENTIFIER_OPS.items():
        a, b = (df.select("id", op(F.col("t"), draw).alias("x")).orderBy("id").collect() for _ in range(2))
        assert a == b, name
        changed = sum(r.x != f"user{r.id}@mail.test" for r in a)
        assert changed > 20, name
    ar = spark.createDataFrame([("شقة", "abc")], "a string, b string")
    r = ar.select(attacks.arabizi(F.col("a"), draw=attacks.drawing(1)).alias("z"), attacks.arabizi(F.col("b"), attacks.drawing(1)).alias("n"), attacks.tatweel(F.col("a")).alias("t"), attacks.diacritics(F.col("a"), attacks.drawing(1)).alias("d"), attacks.combined(F.col("a"), attacks.drawing(1)).alias("c"), attacks.homoglyphs(F.lit("0123456789"), attacks.drawing(1), 0.2).alias("h")).first()
    assert r.z == "sh8a" and r.n == "abc" and r.t == "شقـة" and len(r.d) == 6 and r.c and sum(x != y for x, y in zip(r.h, "0123456789")) == 2


def test_attack_offsets(spark):
    t = "call +966501234567 or a@b.com now"
    df = spark.createDataFrame([(t, [(5, 18, "PHONE"), (22, 29, "EMAIL")])], "t string, s array<struct<start:int,end:int,entity_type:string>>")
    r = df.select(attacks.apply_to_spans(F.col("t"), F.col("s"), attacks.with_op("INV", attacks.drawing(3))).alias("a")).first().a
    for g, old in zip(r.gold, ("+966501234567", "a@b.com")):
        piece = r.text[g.start : g.end]
        assert "".join(c for c in piece if c not in attacks.INVISIBLE[False]) == old and g.altered == (piece != old)
    c = df.select(attacks.context(F.lit("my national id 1234567890"), F.lit(15), attacks.drawing(1), "zw").alias("z"), attacks.context(F.lit("nothing 1234567890"), F.lit(8), attacks.drawing(1), "synonym").alias("n")).first()
    assert "​" in c.z and c.n == "nothing 1234567890"


def test_prir(spark):
    schema = "record_id string, redacted string, original string, spans array<struct<start:int,end:int,entity_type:string>>"
    back = spark.createDataFrame([(0, "please write to the desk of the manager", "Huda"), (1, "zzz", "other")], "ord int, context string, entity_value string")
    rec = spark.createDataFrame([("r", "please write to [PERSON] the desk", "please write to Huda the desk", [(16, 20, "PERSON")]), ("s", "none", "none", [])], schema)
    r = stats.prir(rec, back).first()
    assert (r.n_records, r.n_reidentified, r.prir) == (2, 1, 0.5)
    assert stats.prir(rec.where("false"), back).first().prir == 0.0


def test_annotation(spark):
    r = annotate.to_bio(spark.createDataFrame([("call Huda Ali now", [(5, 13, "PERSON")]), (None, None)], "text string, entities array<struct<start:int,end:int,entity_type:string>>")).collect()
    assert [t.tag for t in r[0].tokens] == ["O", "B-PERSON", "I-PERSON", "O"] and r[1].tokens is None
    marks = spark.createDataFrame([("s", 0, "ab", "X"), ("s", 1, "ab", "X"), ("s", 2, "zz", "X")], "sentence_id string, ord int, value string, label string")
    got = annotate.place_marks(marks, spark.createDataFrame([("s", "ab ab")], "sentence_id string, text string")).collect()
    assert sorted((x.start, x.end) for x in got if x.start is not None) == [(0, 2), (3, 5)] and sum(x.start is None for x in got) == 1
    t = spark.createDataFrame([("a", "id {ID} ok"), ("b", "none")], "sentence_id string, template string")
    v = spark.createDataFrame([("a", "77")], "sentence_id string, value string")
    assert tuple(annotate.fill_slots(t.where("sentence_id = 'a'"), v).first())[1:] == ("id 77 ok", 3, 5)
    with pytest.raises(ValueError):
        annotate.fill_slots(t, v)


def test_generators(spark):
    c = synth.corpus(spark, 200)
    rows = c.collect()
    assert rows == synth.corpus(spark, 200, partitions=7).orderBy("record_id").collect() or sorted(rows) == sorted(synth.corpus(spark, 200, partitions=7).collect())
    for r in rows:
        for e in r.entities:
            assert 0 <= e.start < e.end <= len(r.text)
    ok = c.select(F.explode("entities").alias("e"), "text").where("e.entity_type = 'IBAN'").select(synth.iban_is_valid(F.substring(F.col("text"), F.col("e.start") + 1, F.col("e.end") - F.col("e.start"))).alias("v"))
    assert all(x.v for x in ok.collect())
    assert spark.range(1).select(synth.iban_is_valid(F.lit("SA03 8000 0000 6080 1016 7519")).alias("v")).first().v
    s = synth.scaling_inputs(spark, (2000, 8000)).collect()
    assert len(s) == 28 and all(x.text == synth.scaling_text(x.name, x.n) for x in s) and all(0.7 < len(x.text) / x.n < 1.1 for x in s)
