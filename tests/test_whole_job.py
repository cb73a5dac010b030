"""Queries do the whole of their job: every split, configuration, query and replicate that their descriptions name."""

import random

from pyspark.sql import functions as F

from maskwright.operators import attacks, stats
from maskwright.plans import core


def test_guess_masks_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(stats, "SHARD", 40)
    monkeypatch.setattr(stats, "BLOCK", 15)
    rng = random.Random(5)
    words = [f"{a}{b}" for a in ("pay", "سدد", "the", "zz") for b in ("ment", "هم", "a", "or")]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    back = [(i, c, f"v{i}") for i, c in enumerate([say(rng.randint(1, 9)) for _ in range(150)] + ["aa", ""])]
    back += [(200 + i, c, f"w{i}") for i, (_, c, _) in enumerate(back[:30])]  # later copies lose
    masks = [(f"m{i}", c) for i, c in enumerate([say(rng.randint(1, 9)) for _ in range(60)] + [back[3][1], "ab", "", "QQQQ"])]
    monkeypatch.setattr(stats, "FEW", 6)
    got = {r.mask_id: (r.guess, r.score) for r in stats.guess_masks(spark.createDataFrame(masks, "mask_id string, context string"), spark.createDataFrame(back, "ord int, context string, entity_value string")).collect()}
    grams = lambda s: {s[i : i + 3] for i in range(len(s) - 2)}
    for m, c in masks:
        best, top = "", 0.0
        for _, b, v in back:
            x, y = grams(c), grams(b)
            s = len(x & y) / len(x | y) if x and y else 0.0
            if s > top:
                best, top = v, s
        assert got[m] == (best, top), m


def test_reidentification_attacks_dev_and_test_with_all_of_train(spark, tmp_path):
    say = lambda name: (f"please write to {name} at the desk", 16, 16 + len(name))
    far = "x" * 100 + " and the second is "
    rows = []
    for i, (split, name) in enumerate((("train", "Huda"), ("dev", "Huda"), ("test", "Rami"), (" Test", "Huda"))):
        t, a, b = say(name)
        rows.append((f"r{i}", split, t, [(a, b, "PERSON")]))
    # the second identifier of a training record, beyond its first 90 characters
    rows.append(("r8", "train", "Ali: " + far + "Samir", [(0, 3, "PERSON"), (5 + len(far), 10 + len(far), "PERSON")]))
    rows.append(("r9", "dev", far + "Samir", [(len(far), len(far) + 5, "PERSON")]))
    spark.createDataFrame(rows, "record_id string, split string, text string, entities array<struct<start:int,end:int,entity_type:string>>").write.parquet(f"{tmp_path}/generated_record.parquet")
    r = core.reidentification(spark, str(tmp_path)).first()
    assert (r.n_records, r.n_reidentified) == (4, 3)


def test_attack_matrix_runs_every_fixed_configuration(spark, tmp_path):
    rows = [(f"s{i}", f"my national id 10{i}4567890 and mail user{i}@mail.test, iban SA0380000000608010167519", [(15, 26, "NATIONAL_ID"), (36, 51, "EMAIL")]) for i in range(2)]
    spark.createDataFrame([r[:2] for r in rows], "sentence_id string, text string").write.parquet(f"{tmp_path}/items.parquet")
    spark.createDataFrame([(k, a, b, t) for k, _, g in rows for a, b, t in g], "sentence_id string, start int, end int, label string").write.parquet(f"{tmp_path}/gold.parquet")
    got = {(r.system, r.config): r for r in core.attack_matrix(spark, str(tmp_path)).collect()}
    assert {c for _, c in got} == {c[0] for c in attacks.FIXED} and len(got) == 2 * len(attacks.FIXED)
    assert all(got["full", c].n_altered == 2 for c in ("CTX zero-width", "CTX synonym"))


def test_context_attack_moves_the_gold(spark):
    t = "call 0501234567, national id 1234567890 or iqama 2234567890 then a@b.com"
    spans = [(t.index(v), t.index(v) + len(v), k) for v, k in (("0501234567", "PHONE"), ("1234567890", "NATIONAL_ID"), ("2234567890", "NATIONAL_ID"), ("a@b.com", "EMAIL"))]
    df = spark.createDataFrame([(t, spans)], "t string, s array<struct<start:int,end:int,entity_type:string>>")
    for mode in ("zw", "tashkeel", "conf", "synonym"):
        a = df.select(attacks.apply_context(F.col("t"), F.col("s"), attacks.drawing(3), mode).alias("a")).first().a
        assert [a.text[g.start : g.end] for g in a.gold] == [t[x:y] for x, y, _ in spans], mode
        assert [g.altered for g in a.gold] == [a.text != t and k == "NATIONAL_ID" for _, _, k in spans], mode


def test_adaptive_attack_has_fifty_queries_in_both_modes(spark, tmp_path):
    assert core.ADAPTIVE_ROUNDS[-1][1] == 50 and [q for a, b in core.ADAPTIVE_ROUNDS for q in range(a, b + 1)] == list(range(1, 51))
    rows = [(f"s{i}", f"mail user{i}@mail.test now", 5, 20, "EMAIL") for i in range(4)]
    spark.createDataFrame([r[:2] for r in rows], "sentence_id string, text string").write.parquet(f"{tmp_path}/items.parquet")
    spark.createDataFrame([(r[0], *r[2:]) for r in rows], "sentence_id string, start int, end int, label string").write.parquet(f"{tmp_path}/gold.parquet")
    got = {r["mode"]: r for r in core.adaptive_attack(spark, str(tmp_path)).collect()}
    assert set(got) == {"open", "closed"} and got["open"].identifiers == got["closed"].identifiers == 4
    assert got["open"].evaded > got["closed"].evaded and 1 <= got["open"].median_queries <= 50


def test_bootstrap_clusters_are_whole_templates(spark, tmp_path):
    start = "The same first words of every sentence go on "
    texts = [(f"s{i}", f"{start}{'abcdefgh'[i % 8]} until {i % 3}{i} by Huda") for i in range(24)]  # eight templates
    spans = [(k, t.index("Huda"), len(t), "PERSON", who) for i, (k, t) in enumerate(texts) for who in ("an07", "an21", "an33")]
    spark.createDataFrame(texts, "sentence_id string, text string").write.parquet(f"{tmp_path}/sample_for_annotation.parquet")
    spark.createDataFrame(spans, "sentence_id string, start int, end int, label string, annotator_id string").write.parquet(f"{tmp_path}/spans_b.parquet")
    r = core.bootstrap_clusters(spark, str(tmp_path)).first()
    assert (r.clusters, r.f1_x, r.x_lower, r.excludes_zero) == (8, 1.0, 1.0, False)
