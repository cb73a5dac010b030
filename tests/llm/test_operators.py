"""Training-data operators on small fixtures: brute force, nulls, ties, repeats, empty tables, extra columns."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from maskwright.functions import charmap
from maskwright.llm import p1_consensus as p1
from maskwright.llm import p2_overlap as p2
from maskwright.llm import p3_sample as p3
from maskwright.llm import p4_lookalike as p4
from maskwright.llm import p5_pii as p5
from maskwright.llm import p6_leak as p6
from maskwright.llm import p7_mix as p7
from maskwright.llm import p8_level as p8

MARKS = "sentence_id string, start int, end int, label string, annotator_id string, note string"
TASKS = "sentence_id string, annotator_id string, status string"


def test_p1(spark):
    rng = random.Random(1)
    good, bad = [f"g{i}" for i in range(4)], [f"b{i}" for i in range(3)]
    marks, tasks, truth = [], [], set()
    for i in range(120):
        s = f"s{i}"
        truth.add((s, 5, 10, "PHONE"))
        for a in good + bad:
            tasks.append((s, a, "done"))
            ok = rng.random() < (0.95 if a in good else 0.3)
            if ok:
                marks.append((s, 5, 10, rng.choice(["phone", "PHONE "]), a, None))
            elif rng.random() < 0.7:
                marks.append((s, 5, 10, "IBAN", a, None))
    marks += marks[:20] + [("s0", None, None, None, "g0", "remark"), ("s1", 20, 30, "OTHER_PII", "g0", None), ("s2", 40, 44, "EMAIL", "zz", None)]
    tasks += [("s3", "late", "open")]
    spans, people, agree = p1.consensus(spark.createDataFrame(marks, MARKS), spark.createDataFrame(tasks, TASKS))
    got = {tuple(r)[:4] for r in spans.collect()}
    assert len(got & truth) >= 118 and got <= truth
    rel = {r.annotator_id: r.reliability for r in people.collect()}
    assert min(rel[a] for a in good) > max(rel[a] for a in bad)
    report = p1.fit(p1.build_items(spark.createDataFrame(marks, MARKS), spark.createDataFrame(tasks, TASKS)))[2]
    assert report[-1]["converged"] and not any(r["converged"] for r in report[:-1])
    assert {r.label for r in agree.collect()} >= {"ALL", "PHONE"} and all(-1 <= r.kappa <= 1 for r in agree.collect())
    empty = p1.consensus(spark.createDataFrame([], MARKS), spark.createDataFrame([], TASKS))
    assert empty[0].count() == 0 and empty[1].count() == 0 and empty[2].count() == 0


RECORDS = "record_id string, split string, source string, text string, token int"


def test_p2(spark):
    base = "The receptionist for the updated branch was verified at the second counter, call +966 50 123 4567 or mail huda@mail.test."
    rows = [
        ("a1", "train", "x", base, 1), ("a1", "train", "x", base, 1), ("b1", "dev", "x", base.replace("updated", "updaated"), 1), ("b2", "TEST ", "x", "Note: " + base.replace("+966 50", "00966-50").replace("@", " (at) "), 2),
        ("b3", "test", None, base.replace("4567", "4568"), 1), ("b4", "test", "x", base.replace("huda@", "rami@"), 1), ("b5", None, "x", base, 1), ("b6", "dev", "x", "", 1), ("a2", "train", "x", "", 1), ("b7", "dev", "x", None, 1), ("b8", "dev", "x", "short 1", 1), ("a8", "train", "x", "short 1", 1),
        ("a9", "train", "x", "w " * 20000 + "7", 1), ("b9", "dev", "x", "w " * 20000 + "7", 1),
    ]
    df = spark.createDataFrame(rows, RECORDS)
    got = {(r.train, r.evaluation) for r in p2.overlaps(df).collect()}
    assert got == {("a1", "b1"), ("a1", "b2"), ("a8", "b8"), ("a9", "b9")}
    assert p2.overlaps(df.where("false")).count() == 0


def test_p2_against_brute_force(spark):
    rng = random.Random(4)
    words = [f"word{i}" for i in range(40)]
    texts = [" ".join(rng.choice(words) for _ in range(14)) for _ in range(60)]
    rows = []
    for i, t in enumerate(texts):
        rows.append((f"t{i}", "train", "s", t, 0))
        w = t.split()
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(14)] = rng.choice(words)
        rows.append((f"e{i}", "dev", "s", " ".join(w), 0))
    got = {(r.train, r.evaluation) for r in p2.overlaps(spark.createDataFrame(rows, RECORDS)).collect()}
    red = {r[0]: (p2.reduce_text(r[3])[1], set(p2.shingles(p2.reduce_text(r[3])[0]).tolist())) for r in rows}
    want = set()
    for a in red:
        for b in red:
            if a[0] == "t" and b[0] == "e" and red[a][0] == red[b][0]:
                x, y = red[a][1], red[b][1]
                o = len(x & y)
                if o / len(x | y) >= p2.SIMILARITY:
                    want.add((a, b))
    assert got == want and want


def test_p2_long_texts_lose_nothing(spark):
    """Records of 25, 60 and 200 words with 1 to 12 changed letters: all pairs of at least the similarity, whatever the length."""
    rng = random.Random(9)
    rows = []
    for n in (25, 60, 200):
        for edits in (1, 3, 5, 8, 12):
            t = " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 8))) for _ in range(n))
            u = list(t)
            for i in rng.sample([i for i, c in enumerate(t) if c != " "], edits):
                u[i] = rng.choice("abcdefghijklmnopqrstuvwxyz".replace(u[i], ""))
            rows += [(f"t{n}.{edits}", "train", "s", t, 0), (f"e{n}.{edits}", "test", "s", "".join(u), 0)]
    got = {(r.train, r.evaluation) for r in p2.overlaps(spark.createDataFrame(rows, RECORDS)).collect()}
    sets = {r[0]: set(p2.shingles(p2.reduce_text(r[3])[0]).tolist()) for r in rows}
    want = {(a, b) for a in sets for b in sets if a[0] == "t" and b[0] == "e" and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= p2.SIMILARITY}
    assert got == want and {("t200.8", "e200.8"), ("t200.12", "e200.12"), ("t60.5", "e60.5")} <= got


def test_p2_long_records_against_brute_force(spark):
    rng = random.Random(8)
    say = lambda n: ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(4, 8))) for _ in range(n)]
    rows, many = [], 0
    for i in range(60):
        w = say(rng.choice((15, 60, 300)))
        rows.append((f"t{i}", "train", "s", " ".join(w)))
        for j in rng.sample(range(len(w)), max(1, int(len(w) * rng.choice((0.02, 0.07, 0.15, 0.3))))):
            w[j] = say(1)[0]
        rows.append((f"e{i}", "dev", "s", " ".join(w)))
    got = {(r.train, r.evaluation) for r in p2.overlaps(spark.createDataFrame(rows, "record_id string, split string, source string, text string")).collect()}
    sets = {r[0]: set(p2.shingles(p2.reduce_text(r[3])[0]).tolist()) for r in rows}
    want = set()
    for a in sets:
        for b in sets:
            o = len(sets[a] & sets[b])
            if a[0] == "t" and b[0] == "e" and o / len(sets[a] | sets[b]) >= p2.SIMILARITY:
                want.add((a, b))
                many += max(len(sets[a]), len(sets[b])) - o > 30
    assert got == want and many > 10


def test_p2_any_number_of_matches_gives_the_same(spark):
    rng = random.Random(11)
    words = [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(6) for j in range(6)]
    rows = []
    for i in range(80):
        w = [rng.choice(words) for _ in range(rng.randint(1, 12))]
        rows += [(0, len(rows), 1, "", "".join(w))]
        w[rng.randrange(len(w))] = rng.choice(words)
        rows += [(1, len(rows), 1, "", "".join(w))]
    texts = spark.createDataFrame(rows, "side int, h long, k long, identity string, reduced string")
    sets = [set(p2.shingles(r[4]).tolist()) for r in rows]
    want = {(x[1], y[1]) for x in rows for y in rows if x[0] == 0 and y[0] == 1 and len(sets[x[1]] & sets[y[1]]) / len(sets[x[1]] | sets[y[1]]) >= p2.SIMILARITY}
    for shared in (1, 4, 12, 40):
        assert {(r.h_a, r.h_b) for r in p2.similar_classes(texts, shared=shared).collect()} == want
    assert len(want) > 40


def test_p2_many_texts_at_once(monkeypatch):
    """Table lookups over a batch give what one text after the other gives, in groups of any size."""
    rng = random.Random(5)
    pool = "abcXYZ 01٣٤۵ ＡＢ é é Сер ﷺ ﻻ ​ ـ َ @.,()-+ ΟΔΟΣ İ ² 𝟛 \U0002F800"
    texts = ["".join(rng.choice(pool) for _ in range(rng.randint(0, 60))) for _ in range(300)]
    texts += ["call 00966 50 1 or huda (at) mail dot test", "rami@mail.test at 00 97", "a" * 500, "", "abc"]
    for limit in (1, 97, 10**6):
        monkeypatch.setattr(p2, "AT_ONCE", limit)
        a, b = p2.reduce_texts(texts)
        assert list(zip(a, b)) == [p2.reduce_text(t) for t in texts]
        assert [x.tolist() for x in p2.shingle_sets(a)] == [p2.shingles(x).tolist() for x in a]
    assert p2.reduce_texts([]) == ([], [])


def test_p2_counts_by_class(spark):
    """Counts from class sizes are those of the pairs, also with hot copies and records sent twice with different texts."""
    a, b, c = (f"Please {w} the schedule at the second counter before the office closes today" for w in ("review", "reviewed", "send back"))
    rows = [(f"t{i}", "train", "s", a, 0) for i in range(30)] + [("t0", "train", "s", b, 0), ("x", "train", "s", a, 0), ("x", "dev", "s", b, 0)]
    rows += [(f"e{i}", "dev", "s", b if i % 2 else a, 0) for i in range(20)] + [("e0", "dev", "s", b, 0), ("e99", "test", "s", c, 0)]
    df = spark.createDataFrame(rows, RECORDS)
    want = {r.evaluation: r["count"] for r in p2.overlaps(df).groupBy("evaluation").count().collect()}
    assert {r.evaluation: r.pairs for r in p2.partners(df).collect()} == want and len(want) >= 21


def test_p3(spark):
    rows = [(f"s{i}", "E-mail" if i % 2 else "email ", "English", "western") for i in range(40)] + [("s1", "EMAIL", "english", "Western"), ("n", None, "English", "western"), (None, "email", "English", "western")] + [(f"p{i}", "PHONE", "Arabic", "western") for i in range(3)]
    items = spark.createDataFrame(rows, "sentence_id string, type string, language string, script string").withColumn("quota", F.lit(1))
    targets = spark.createDataFrame([(1, "EMAIL", "English", "western", 0.75, 1, 20), (2, "PHONE", "Arabic", "western", 0.25, 4, 20)], "target_id long, type string, language string, script string, target_share double, min_rows int, sample_size long")
    sample, report = p3.proportional_sample(items, targets)
    r = {x.target_id: x for x in report.collect()}
    assert (r[1].available, r[1].wanted) == (40, 15) and (r[2].available, r[2].wanted) == (3, 5)
    short = {x.target_id: (x.filled, x.shortfall) for x in p3.shortfalls(items, targets).collect()}
    assert short == {1: (15, 0), 2: (3, 2)}
    n = {x.target_id: x["count"] for x in sample.groupBy("target_id").count().collect()}
    assert n == {1: 17, 2: 3} and sample.select("sentence_id").distinct().count() == 20
    assert sorted(map(tuple, sample.collect())) == sorted(map(tuple, p3.proportional_sample(items.repartition(7), targets)[0].collect()))
    e, rep = p3.proportional_sample(items.where("false"), targets)
    assert e.count() == 0 and all(x.shortfall == x.wanted for x in p3.shortfalls(items.where("false"), targets).collect())


def test_p3_draws_the_smallest_keys(spark, monkeypatch):
    """Buckets of keys give the same draw as sorting the whole category, with many rows a bucket and with few."""
    rows = spark.createDataFrame([(f"k{i}", "a" if i % 3 else "b") for i in range(900)], "key string, c_type string")
    keyed = [(r.key, r.c_type, r.r) for r in rows.withColumn("r", p3.draw_key("key", 5)).collect()]
    for bucket in (1 << 58, 1 << 52, 1 << 44):
        monkeypatch.setattr(p3, "BUCKET", bucket)
        for n in (0, 1, 37, 299, 300, 600, 5000):
            report = spark.createDataFrame([(1, n, "a"), (2, n, "b"), (3, n, "none")], "target_id long, quota long, c_type string")
            got = {(r.target_id, r.key) for r in p3.draw(rows, report, "quota", ["type"], 5).collect()}
            want = {(i, k) for i, c in ((1, "a"), (2, "b")) for k, _, _ in sorted((x for x in keyed if x[1] == c), key=lambda x: (x[2], x[0]))[:n]}
            assert got == want


def test_p3_allocation():
    q = p3.allocate([{"id": 1, "share": 0.5, "floor": 3, "available": 100}, {"id": 2, "share": 0.49, "floor": 3, "available": 10}, {"id": 3, "share": 0.01, "floor": 3, "available": 100}], 60)
    assert sum(q.values()) == 60 and q[2] == 10 and q[3] == 3
    assert p3.allocate([], 10) == {} and p3.allocate([{"id": 1, "share": 0.0, "floor": 0, "available": 5}], 10) == {1: 0}


def test_p4(spark):
    same = ["Café Ａ 1", "Café A 1", "Сaf​é A 1", "Cafe​́ A 1"]
    other = ["cafe A 1", "Café A 1.", "Café A  1", "Café A ١", "Cafَé A 1"]
    rows = [("items", f"k{i}", t) for i, t in enumerate(same + other)] + [("items", "k0", same[0]), ("items", "z", same[0]), ("items", None, same[1]), ("items", "n", None), ("items", "e", ""), ("items", "f", "​"), ("items", "ar1", "ﻻ ﺏ ک"), ("items", "ar2", "لا ب ك"), ("items", "t1", "بـ"), ("items", "t2", "ب")]
    df = spark.createDataFrame(rows, "src string, key string, text string")
    got = {(r.key_a, r.key_b) for r in p4.pairs(df).collect()}
    want = {(f"k{i}", f"k{j}") for i in range(4) for j in range(i + 1, 4)} | {(f"k{i}", "z") for i in range(1, 4)} | {("ar1", "ar2"), ("e", "f")}
    assert got == want
    c = {r.text: r.canonical for r in p4.equivalence_classes(df).collect()}
    assert len({c[t] for t in same}) == 1 and c["ﻻ ﺏ ک"] == "لا ب ك" and c[other[0]] == other[0]
    assert p4.pairs(df.where("false")).count() == 0


def test_p4_copies_of_one_text(spark):
    """One text sent 100,000 times and two spellings of it: copies do not meet, so the work is that of the result."""
    df = spark.range(100_000).selectExpr("'items' AS src", "concat('k', id) AS key", "'Caf\u00e9 A 1' AS text")
    df = df.unionByName(spark.createDataFrame([("items", "x", "Cafe\u0301 A 1"), ("items", "y", "Café Ａ 1"), ("items", "k7", "Café Ａ 1")], "src string, key string, text string"))
    got = p4.pairs(df)
    # copies with x, copies with y and k7 (but k7 with itself), x with y; x with k7 is there already
    assert got.count() == 100_000 + 199_999 + 1 and got.where("key_a >= key_b").count() == 0


def test_p5_tokens_and_model(spark, tmp_path):
    t = "اتصل على +966 (50) 123-4567, mail huda.k [at] mail dot test or SA79 1234 5678 9012 3456 7890 ok."
    toks = [t[a:b] for a, b, _ in p5.tokens(t)]
    assert "+966 (50) 123-4567" in toks and "huda.k [at] mail dot test" in toks and "SA79 1234 5678 9012 3456 7890" in toks
    rng = random.Random(2)
    rows = []
    for i in range(120):
        n = f"{rng.choice(['Huda', 'Rami', 'Omar', 'Lina'])} {rng.choice(['Kest', 'Velm', 'Corv'])}"
        num = "".join(rng.choice("0123456789") for _ in range(9))
        text = f"Please ask {n} about it. Call +966{num} today. Order 1{num} shipped."
        a = text.index("+")
        rows.append({"text": text, "spans": [(11, 11 + len(n), "PERSON"), (a, a + 4 + 9, "PHONE")]})
    model = p5.fit(rows, iterations=40)
    probe = "Please ask Huda Corv about it. Call +966123456789 today. Order 1123456789 shipped."
    df = spark.createDataFrame([("a", probe), ("a", probe), ("b", None), ("c", ""), (None, "x"), ("d", "Please ask Rami Kest about it. " * 3000)], "sentence_id string, text string").withColumn("label", F.lit(1))
    got = p5.detect(df, model)
    a = sorted((r.start, r.end, r.label) for r in got.where("sentence_id = 'a'").collect())
    assert a == [(11, 20, "PERSON"), (36, 49, "PHONE")]
    assert got.where("sentence_id = 'd'").count() == 3000 and got.where("sentence_id IN ('b', 'c')").count() == 0
    m = {r.sentence_id: r for r in p5.mask(df.where("sentence_id <> 'd'"), got).collect()}
    assert m["a"].masked.startswith("Please ask [PERSON] about it. Call [PHONE] today.") and m["b"].masked is None and m["c"].masked == ""
    assert p5.detect(df.where("false"), model).count() == 0
    two = spark.createDataFrame([("a", probe), ("a", "Order 5 shipped. " + probe)], "sentence_id string, text string")
    both = {r.text: r.masked for r in p5.mask(two, p5.detect(two, model)).collect()}
    assert both["Order 5 shipped. " + probe] == "Order 5 shipped. " + both[probe] and both[probe] == m["a"].masked  # each by its own spans
    path = str(tmp_path / "model")
    assert p5.load(spark, path) is None
    p5.save(model, spark, path)
    again = p5.load(spark, path)
    assert sorted(map(tuple, p5.detect(df, again).collect())) == sorted(map(tuple, got.collect()))


def test_p5_alignment_of_many():
    texts = ["", "Ｃall ٣ é", "\U0001f600 x", "ﻻ ​", "plain"]
    assert p5.align_many(texts) == [p5.align(t) for t in texts] and p5.align_many([]) == []
    assert p5.align_many([*texts, "\U0002f800"]) == [p5.align(t) for t in [*texts, "\U0002f800"]]
    assert all(len(a) == len(t) for a, t in zip(p5.align_many(texts), texts))


def test_p5_tokens_of_any_text():
    """Texts without addresses or without invisible characters take shorter patterns, which give the same tokens."""
    rng = random.Random(13)
    parts = ["Call", "huda.k", " at ", " AT ", "@", "[at]", "mail", " dot ", ".", "test", "+966", " ", "-", "(50)", "123", "SA79", "1234", "5678", "عبد", "الله", "A.", "B", "x_1", ",", "’s", p5.Z, "٣", "É"]
    for _ in range(3000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(1, 12)))
        full = [(m.start(), m.end(), m.lastgroup) for m in p5._TOKEN[True][0].finditer(p5.align(t))]
        assert [(a, b) for a, b, _ in p5.tokens(t)] == [(a, b) for a, b, _ in full]


def test_p5_viterbi_is_exact():
    rng = np.random.default_rng(1)
    e, tr, st = rng.normal(size=(1, 4, p5.N)).astype(np.float32), rng.normal(size=(p5.N, p5.N)).astype(np.float32), rng.normal(size=p5.N).astype(np.float32)
    from itertools import product

    def total(y):
        return st[y[0]] + e[0, 0, y[0]] + sum(tr[y[i - 1], y[i]] + e[0, i, y[i]] for i in range(1, 4))

    best = max(product(range(p5.N), repeat=4), key=total)
    assert tuple(p5.viterbi(e, np.array([4]), tr, st)[0]) == best


def test_p6_index():
    rng = np.random.default_rng(1)
    for n, v in ((300, 3), (800, 6), (5, 2), (200, 1)):
        s = rng.integers(1, v + 1, n)
        s[rng.integers(0, n, 4)] = 0
        assert list(p6.suffix_array(s)) == sorted(range(n), key=lambda i: list(s[i:]))
        f = p6.FMIndex(s)
        for k in (1, 2, 4):
            pats = np.array([s[i : i + k] for i in range(min(40, n - k))])
            pats = pats[(pats > 0).all(1)]
            lo, hi = f.search(pats)
            for p, a, b in zip(pats, lo, hi):
                assert sorted(f.locate(np.arange(a, b))) == [i for i in range(n - k + 1) if list(s[i : i + k]) == list(p)]


def test_p6(spark, monkeypatch):
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(400)]
    say = lambda n: [rng.choice(vocab) for _ in range(n)]
    passage = say(60)
    half, quote = passage[:36], passage[:12]
    edited = [("zz" if i % 9 == 4 else w) for i, w in enumerate(passage)]
    docs = [(1, " ".join(say(50) + passage + say(20))), (2, " ".join(say(30) + half + say(30))), (3, " ".join(say(80) + quote)), (4, " ".join(edited).upper()), (5, " ".join(say(200))), (6, None), (7, ""), (8, " ".join(say(50))), (9, " ".join(edited).upper()), (10, " ".join(say(900) + passage + say(900)))]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("passage_id", F.lit(0))
    p = spark.createDataFrame([(7, " ".join(passage)), (8, "too short"), (9, None)], "passage_id long, text string")
    got = {(r.doc_id, r.passage_id): r for r in p6.leaks(d, p).collect()}
    assert set(got) == {(1, 7), (2, 7), (4, 7), (9, 7), (10, 7)} and got[1, 7].start == 50 and got[1, 7].end == 110
    spans = p6.removal_spans(p6.leaks(d, p)).collect()
    assert len(spans) == 5
    assert p6.leaks(d.where("false"), p).count() == 0 and p6.leaks(d, p.where("false").unionByName(p.where("passage_id = 8"))).count() == 0


def test_p7(spark):
    docs = [(i, "big" if i % 2 else "BIG ", "a b c d e " * 4) for i in range(300)] + [(1000 + i, "small", "a b c d e " * 4) for i in range(10)] + [(2000, None, "x y"), (2001, "big", None), (2002, "big", "")]
    d = spark.createDataFrame(docs, "doc_id long, source string, text string").withColumn("copies", F.lit(0))
    t = spark.createDataFrame([("big", 0.5, 1), ("small", 0.4, 3), ("none", 0.1, 2)], "source string, target_weight double, max_repeat int")
    drawn, report = p7.mix(d, t)
    r = {x.source: x for x in report.collect()}
    assert r["none"].shortfall > 0 and r["small"].shortfall > 0 and r["big"].shortfall == 0
    assert r["small"].drawn == 3 * r["small"].available and r["small"].most_copies == 3 and r["big"].most_copies == 1
    assert abs(r["big"].drawn - r["big"].wanted) / r["big"].wanted < 0.03
    assert drawn.where("doc_id >= 2000").count() == 0
    assert p7.mix(d.where("false"), t)[0].count() == 0


def test_p7_blocks_and_large_sums(spark, monkeypatch):
    """Any division into blocks emits a document once per integer crossed; sums far beyond 64 bits of units do not overflow."""
    d = spark.createDataFrame([(i, "a", "x" * (1 + i % 7)) for i in range(500)], "doc_id long, source string, text string")
    t = spark.createDataFrame([("a", 0.9, 5)], "source string, target_weight double, max_repeat int")
    for n in (1, 7, 60, 1000):
        drawn, report = p7.mix(d, t, fraction=2.0, size="length(text)", block_docs=n)
        r, copies = report.first(), [x.copies for x in drawn.collect()]
        assert set(copies) == {1, 2} and abs(sum(copies) - 500 * r.rate) <= 1
    monkeypatch.setattr(p7, "UNIT", 10**15)  # 500 documents at 1.8 copies are 9 x 10^17 units, those of 5 copies 2.5 x 10^18; ten times as many pass 2^63
    many = spark.range(20000).selectExpr("id AS doc_id", "'a' AS source", "'xx' AS text")
    drawn, report = p7.mix(many, t, fraction=4.0, size="length(text)", block_docs=100)
    r = report.first()
    assert abs(drawn.agg(F.sum("copies")).first()[0] - 20000 * r.rate) <= 1 and r.shortfall == 0 and 20000 * r.rate * 10**15 > 2**63

def test_p8_ranks_and_ways_agree(spark):
    rng = random.Random(6)
    easy, hard = [f"ab{chr(97 + i)}" for i in range(12)], [f"compli{chr(97 + i)}cation" for i in range(12)]
    say = lambda ws, n, k: " ".join(" ".join(rng.choice(ws) for _ in range(k)) + "." for _ in range(n))
    graded = [(i, 1 + i % 2, say(easy, 8, 4) if i % 2 == 0 else say(hard, 4, 12)) for i in range(24)]
    docs = [(1, say(easy, 10, 4)), (2, say(hard, 6, 12)), (3, None), (4, "  ​"), (5, "123 !!"), (6, say(easy, 10, 4) + say(hard, 1, 5)), (7, say(hard, 30, 11).replace(".", ""))]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("level", F.lit(9))
    g = spark.createDataFrame(graded, "excerpt_id int, level int, text string")
    one = {r.doc_id: r.level for r in p8.reading_levels(d, g).collect()}
    assert one == {1: 1, 2: 2, 5: 1, 6: 1, 7: 2}
    full = sorted(map(tuple, p8.reading_levels(d, g).collect()))
    for head in (0, 3, 9):  # all words, or some, take the other way
        assert sorted(map(tuple, p8.reading_levels(d, g, head_words=head).collect())) == full
    c = spark.createDataFrame([("a", 5), ("b", 5), ("c", 1), ("ب", 2)], "word string, n long")
    assert {r.word: r["rank"] for r in p8.ranks(c).collect()} == {"a": 1, "b": 1, "c": 3, "ب": 1}


def test_p8_measures_many_texts_at_once_by_the_definition(spark):
    rng = random.Random(8)
    words = ["The", "cat's", "well-known", "Aé̃b", "كتاب", "كِتَاب", "كـــتاب", "المدير", "x\u200by", "12", "a1b", "_", "—", "日本", "ß", "İz", "-end", "don’t", "!", "؟", "...", "?!", "．", "Cat"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 60))) for _ in range(60)] + ["", "  ", "123 !!", "!", "the. the! cat", "قال the. كتاب", "w " * 40, "w " * 35 + ".", "end.", "a.b.c"]
    word = f"[^\\W\\d_{charmap.TATWEEL}][{charmap.MARKS_CLASS}{charmap.TATWEEL}{charmap.invisible_py()}]*"
    find = re.compile(f"(?:{word})+(?:['’-](?:{word})+)*").findall
    rank = {"the": 1, "cat": 4, "w": 2, "كتاب": 1, "a": 9, "b": 10}
    want, found = [], Counter()
    for i, t in enumerate(texts):
        sents = [[p for w in find(s) if (p := charmap.loose(w))] for s in re.split(r"[.!?؟۔．！？]+", t)]
        found.update(w for s in sents for w in s)
        for arabic in (False, True):
            own = [s for s in ([w for w in s if ("؀" <= w[0] <= "ۿ") is arabic] for s in sents) if s]
            ws = [w for s in own for w in s]
            if ws:
                r = sorted(rank.get(w, 0) for w in ws)
                cover = [None] * 7 if not r[0] else [math.log(r[max(1, math.ceil(s * len(r))) - 1]) for s in p8.SHARES] + [sum(map(math.log, r)) / len(r)]
                c = Counter(ws) if not r[0] else {}
                known, rest = sorted((rank[w], k) for w, k in c.items() if w in rank), sorted((w, k) for w, k in c.items() if w not in rank)
                want.append((i, arabic, len(ws), [*cover, sum(map(len, ws)) / len(ws), math.log(len(ws) / len(own)) if len(ws) / len(own) <= 35 else None], known, rest))
    tokens = p8.Tokens(rank.get)
    for step in (len(texts), 7, 1):  # together, in pieces, one at a time; words met before keep their numbers
        at = 0
        for k in range(0, len(texts), step):
            which, arabic, n, values, (a, b, c, d) = p8.measured(texts[k : k + step], tokens)
            for j in range(len(which)):
                i, ar, m, feats, known, rest = want[at]
                assert (which[j] + k, arabic[j], n[j]) == (i, ar, m)
                assert [None if v.mask[j] else pytest.approx(v.data[j], abs=1e-12) for v in values] == feats
                assert sorted(zip(a[j].as_py(), b[j].as_py())) == known and sorted(zip(c[j].as_py(), d[j].as_py())) == rest
                at += 1
        assert at == len(want)
    df = spark.createDataFrame([(t,) for t in [*texts, None]], "text string")
    assert {r.word: r.n for r in p8.word_counts(df).collect()} == dict(found)


def test_queries_have_sql_only_for_themselves():
    from maskwright.llm import queries as q

    assert set(q.ORACLE) <= set(q.QUERIES) and {f"p{i}_found" for i in range(1, 9)} <= set(q.QUERIES)


if __name__ == "__main__":
    pytest.main([__file__, "-q"])
