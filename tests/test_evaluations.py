"""Evaluation sets and whole evaluations: sizes, gold that fits, systems, levels, annotation sheets, the pipeline object."""

import pytest
from pyspark.sql import functions as F

from maskwright.operators import attacks, audit, evaluate, evalsets, stats
from maskwright.operators.redact import ARCHIVED, Pipeline, redact, run_system, run_systems


def test_sets_have_their_sizes_and_gold(spark):
    sizes = {"validity": (112, 0), "stratified": (238, 110), "stratified_holdout": (198, 100)}
    for name, (positive, negative) in sizes.items():
        rows = evalsets.built_set(spark, name).collect()
        assert (sum(r.type != "NEGATIVE" for r in rows), sum(r.type == "NEGATIVE" for r in rows)) == (positive, negative)
        assert all((len(r.gold) == 1) == (r.type != "NEGATIVE") for r in rows) and len({r.text for r in rows}) > 0.9 * positive
        for r in rows:
            for g in r.gold:
                assert g.entity_type == r.type and r.text[g.start : g.end].strip() == r.text[g.start : g.end] != ""
    c = evalsets.challenge_set(spark).collect()
    assert len(c) == 140 and sum(bool(r.gold) for r in c) == 7 * sum(t is not None for _, _, t in evalsets.CHALLENGES)
    again = evalsets.built_set(spark, "stratified").repartition(5).collect()
    assert sorted(map(str, again)) == sorted(map(str, evalsets.built_set(spark, "stratified").collect()))


def test_score_all_modes_and_groups(spark):
    gold = spark.createDataFrame([("a", "c1", 0, 10, "PHONE"), ("a", "c1", 20, 30, "NATIONAL_ID"), ("b", "c1", 0, 10, "EMAIL"), ("a", "c2", 0, 4, "PERSON")], "set_name string, case_id string, start int, end int, type string")
    pred = spark.createDataFrame([("x", "a", "c1", 0, 8, "PHONE"), ("x", "a", "c1", 20, 30, "NATIONAL_ID"), ("x", "a", "c9", 1, 2, "IBAN"), ("zz", "a", "c1", 0, 10, "PHONE")], "system string, set_name string, case_id string, start int, end int, type string")
    got = {(r.set_name, r.system, r["mode"], r.types): (r.tp, r.fp, r.fn) for r in evaluate.score_all(gold, pred, ("x", "y")).collect()}
    assert got["a", "x", "strict", "all_types"] == (1, 2, 1) and got["a", "x", "lenient", "all_types"] == (2, 1, 0)
    assert got["a", "x", "strict", "shared_types"] == (0, 2, 1) and got["a", "x", "strict", "national_id"] == (1, 0, 0)
    assert got["b", "x", "strict", "EMAIL"] == (0, 0, 1) and got["a", "y", "lenient", "all_types"] == (0, 0, 2)
    assert not any(k[1] == "zz" for k in got) and evaluate.score_all(gold.where("false"), pred.where("false"), ("x",)).count() == 0


def test_leakage_levels(spark):
    rows = [("s", "c", 1, True, True, True, True, False), ("s", "c", 2, True, True, False, False, False), ("s", "c", 3, True, False, False, True, True), ("s", "c", 4, False, True, True, False, False), ("t", "c", 1, True, True, False, True, True), ("t", "c", 2, True, False, False, True, True)]
    r = spark.createDataFrame(rows, "system string, config string, key int, altered boolean, protected boolean, hit boolean, leak_partial boolean, leak_full boolean")
    got = {x.system: x for x in evaluate.leakage_levels(r, ("s", "t")).collect()}
    s, t = got["s"], got["t"]
    assert (s.n_applicable, s.n_altered, s.n_clean_missed_altered, s.n_protected_alt) == (4, 3, 1, 2)
    assert (s.k_partial, s.k_full, s.k_total_partial, s.k_total_full, s.span_hit_but_partial_leak, s.span_miss_no_leak) == (1, 0, 2, 1, 1, 1)
    assert (s.common_n, s.common_partial, s.common_full) == (1, 1, 0) and (t.common_n, t.common_full) == (1, 1)
    assert s.asr_alt_partial == 0.5 and abs(s.total_leak_full - 1 / 3) < 1e-12


def test_perturbations_and_legacy_audit(spark):
    text = "call +966501234567 or اتصل بهدى"
    cases = spark.createDataFrame([("r", text, [(5, 18, "PHONE"), (27, 31, "PERSON")])], "record_id string, text string, gold array<struct<start:int,end:int,entity_type:string>>")
    got = {r.operator: r for r in evaluate.perturbed(cases, 1, "record_id").collect()}
    assert set(got) == {n for n, _, _ in evaluate.PERTURBATIONS}
    assert got["HGL 100%"].text[5:18] == "+٩٦٦٥٠١٢٣٤٥٦٧" and got["HGL 100%"].same_length
    assert got["TAT"].text != text and not got["TAT"].same_length and got["TAT"].text.replace("ـ", "") == text
    j = spark.createDataFrame([("o", "s", True, True, True, False), ("o", "s", True, False, True, True), ("o", "s", False, True, True, False), ("o", "s", True, True, False, False)], "operator string, system string, same_length boolean, changed boolean, clean_ok boolean, attacked_ok boolean")
    r = evaluate.legacy_audit(j).first()
    assert (r.identifiers_of_changed_length, r.n_in_scope, r.n_changed, r.clean_tp, r.adv_tp_all, r.changed_clean_tp, r.changed_adv_tp) == (1, 3, 2, 2, 1, 1, 0)
    assert r.asr_over_all_clean_tp == 0.5 and r.asr_over_changed == 1.0 and r.upper_if_zero is None


def test_archived_rules_know_less(spark):
    texts = ["+966501234567", "00966501234567", "+966 (50) 123-4567", "SA7912345678901234567890", "sa7912345678901234567890", "SA79 1234 5678 9012 3456 7890", "iqama 1234567890", "1234567890 (civil ID)", "a.b@mail.test", "رقم الهوية ١٢٣٤٥٦٧٨٩٠", "اقامة 1234567890"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    n = lambda name: {r.i: len(r.pred) for r in run_system(df, name).collect()}
    assert n("full") == dict.fromkeys(range(11), 1)
    assert n(ARCHIVED) == {0: 1, 1: 0, 2: 0, 3: 1, 4: 0, 5: 0, 6: 1, 7: 0, 8: 1, 9: 1, 10: 0}
    assert {r.system for r in run_systems(df, ("full", ARCHIVED)).select("system").collect()} == {"full", ARCHIVED}


def test_sentence_f1_and_shadows(spark):
    span = "array<struct<start:int,end:int,entity_type:string>>"
    df = spark.createDataFrame([([(0, 1, "A")], [(0, 1, "A"), (2, 3, "A")]), ([], []), ([(0, 1, "A")], [(0, 1, "B")])], f"g {span}, p {span}")
    assert [round(r.f, 6) for r in df.select(evaluate.sentence_f1(F.col("g"), F.col("p")).alias("f")).collect()] == [0.666667, 0.0, 0.0]

    class Trainer:
        def train_and_score(self, seed):
            side = lambda m: {f"e{i}": 1.0 + 0.05 * seed - m for i in range(6) if (i + seed) % 2 == m}
            return side(1), side(0)

    losses = evaluate.shadow_losses(spark, Trainer(), range(1, 7))
    assert losses.count() == 36 and losses.select("model_id").distinct().count() == 6
    target = spark.createDataFrame([(f"e{i}", 0.1 if i < 3 else 1.1) for i in range(6)], "example_id string, loss double")
    members = target.select("example_id", (F.col("loss") < 0.5).alias("member"))
    r = evaluate.lira_evaluation(target, losses, members).first()
    assert (r.examples, r.auc, r.tpr_at_one_percent) == (6, 1.0, 1.0)
    assert stats.prir(spark.createDataFrame([], f"record_id int, redacted string, original string, spans {span}"), spark.createDataFrame([], "ord long, context string, entity_value string"), stats.guess_nothing).first().prir == 0.0


def test_annotation_set_and_sheet(spark, tmp_path):
    pos = spark.createDataFrame([(f"call +96650123456{i} now", "phone") for i in range(9)] * 2, "text string, subtype string")
    neg = spark.createDataFrame([(f"order {i}", "number") for i in range(9)] + [(None, "x")], "text string, subtype string")
    leads = spark.createDataFrame([("A first sentence that is long enough. Short. And then a second one that is long enough.", "en")], "text string, subtype string")
    items, key = evalsets.annotation_set(pos, neg, leads, sizes=(5, 4, 3))
    rows = {r.item_id: r.text for r in items.collect()}
    assert len(rows) == 11 and {(r.origin, r["count"]) for r in key.groupBy("origin").count().collect()} == {("synthetic_positive", 5), ("synthetic_negative", 4), ("running_text", 2)}
    assert items.columns == ["item_id", "text"]
    evalsets.annotation_sheet(items).write.option("header", True).csv(str(tmp_path / "sheet"))
    back = spark.read.option("header", True).csv(str(tmp_path / "sheet"))
    assert tuple(back.columns) == evalsets.SHEET and back.count() == 11
    own = spark.createDataFrame([("i1", "call 12 or 12"), ("i2", "none"), ("i3", "x 7"), ("i4", "edit me")], "item_id string, text string")
    filled = spark.createDataFrame([("i1", "call 12 or 12", None, "12", "PHONE", "12", "PHONE"), ("i2", "none", "YES", None, None, None, None), ("i3", "x 7", None, "9", "PHONE", "7", "WHAT"), ("i4", "edited", None, None, None, None, None), ("zz", "?", None, None, None, None, None)], "item_id string, text string, no_identifier string, identifier_1 string, type_1 string, identifier_2 string, type_2 string")
    spans, problems = evalsets.collect_sheet(filled.withColumn("identifier_3", F.lit(None).cast("string")).withColumn("type_3", F.lit(None).cast("string")), own)
    assert {(r.sentence_id, r.start, r.end) for r in spans.collect()} == {("i1", 5, 7), ("i1", 11, 13)}
    assert {(r.item_id, r.problem) for r in problems.collect()} == {("i3", "an identifier is not in the text"), ("i3", "unknown type: WHAT"), ("i4", "the text was edited"), ("i4", "the row is not filled")}


def test_capped(spark):
    df = spark.range(100).selectExpr("id", "if(id < 90, 'a', 'b') AS s")
    got = evalsets.capped(df, "s", 20, "id")
    assert {r.s: r["count"] for r in got.groupBy("s").count().collect()} == {"a": 20, "b": 10}
    assert got.exceptAll(evalsets.capped(df.repartition(3), "s", 20, "id")).count() == 0


def test_pipeline_object(spark, tmp_path):
    (tmp_path / "weights").write_text("x")
    person = lambda path: lambda c: F.when(F.contains(c, F.lit("Huda")), F.array(F.struct((F.instr(c, "Huda") - 1).cast("int").alias("start"), (F.instr(c, "Huda") + 3).cast("int").alias("end"), F.lit("PERSON").alias("entity_type"), F.lit("neural").alias("origin"), F.lit(0.9).alias("score"), F.lit(False).alias("expanded")))).otherwise(F.array().cast("array<struct<start:int,end:int,entity_type:string,origin:string,score:double,expanded:boolean>>"))
    p = Pipeline.from_checkpoint(str(tmp_path), person, hash_key=b"k", seed=b"\x05" * 32)
    df = spark.createDataFrame([("l", 1, "t1", 1.0, "ask Huda on +966501234567")], "log_id string, seq long, transaction_id string, timestamp double, text string")
    out = p.redact(df)
    assert out.first().redacted == "ask [PERSON] on [PHONE]" and p.model_hash != "rules" and "hash_key" not in repr(p)
    log = p.audit(out)
    assert log.first().model_version_hash == p.model_hash and audit.verify_chain(log, audit.public_key(b"\x05" * 32)).first().valid
    with pytest.raises(ValueError):
        Pipeline().audit(redact(df))


def test_attack_cases_leave_overlaps_out(spark, tmp_path):
    from maskwright.plans import core

    t = __import__("datetime").datetime(2031, 1, 1)
    spark.createDataFrame([("a", "old +966501234567", t), ("a", "new +966501234567", t.replace(year=2032)), ("b", "x 1 2 3 4", t), (None, "y", t)], "sentence_id string, text string, loaded_at timestamp").write.parquet(str(tmp_path / "items.parquet"))
    spark.createDataFrame([("a", 4, 17, "Phone"), ("b", 0, 5, "EMAIL"), ("b", 3, 7, "IBAN")], "sentence_id string, start int, end int, label string").write.parquet(str(tmp_path / "gold.parquet"))
    got = core._attack_cases(spark, str(tmp_path)).collect()
    assert [(r.sentence_id, r.text) for r in got] == [("a", "new +966501234567")]
    assert attacks.FIXED
