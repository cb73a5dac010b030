"""Normalisation, detectors, fusion, masking: fixed probes and brute force."""

import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from maskwright.functions import charmap as cm
from maskwright.functions import text as tx
from maskwright.operators import detect, fuse
from maskwright.operators.normalize import any_adversarial_signal, normalize
from maskwright.operators.redact import redact, run_systems

SPAN = "array<struct<start:int,end:int,entity_type:string,origin:string,score:double,expanded:boolean>>"


def texts(spark, values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id int, text string")


def test_normalize_probes(spark):
    probes = [
        ("hello‮world⁦test", "helloworldtest"), ("٠١٢٣٤٥٦٧٨٩", "0123456789"), ("۰۱۲۳", "0123"), ("مـــرحبا", "مـرحبا"), ("مـرحبا", "مـرحبا"),
        ("ﺏ", "ب"), ("+966​50‍123⁡4567", "+966501234567"), ("СА79 1234", "CA79 1234"), ("привет", "привет"), ("", ""), (None, None),
    ]
    got = normalize(texts(spark, [p[0] for p in probes])).orderBy("id").collect()
    assert [r.normalized for r in got] == [p[1] for p in probes]
    assert got[0].report.bidi_controls_stripped == 2 and got[1].report.digits_folded == 10 and got[3].report.tatweel_runs_capped == 1 and got[4].report.tatweel_runs_capped == 0
    assert got[7].report.confusables_folded == 2 and got[8].report.confusables_folded == 0 and got[5].report.nfkc_changed and got[10].report is None
    sig = normalize(texts(spark, ["plain", "٣"])).orderBy("id").select(any_adversarial_signal().alias("s")).collect()
    assert [r.s for r in sig] == [False, True]


def test_normalize_steps(spark):
    df = texts(spark, ["٣", "５"])
    assert [r.normalized for r in normalize(df, steps=["nfkc"]).orderBy("id").collect()] == ["٣", "5"]
    assert [r.normalized for r in normalize(df, steps=["digits"]).orderBy("id").collect()] == ["3", "５"]
    with pytest.raises(ValueError):
        normalize(df, steps=["nope"])


def test_normalize_against_python(spark):
    rng = random.Random(3)
    alphabet = "aZ9 ٣۵ـ​‮﻿اﻻفﷺＡ５éе́СKО\t "
    values = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30))) for _ in range(300)]
    inv = {c for a, b in cm.invisible_ranges() for c in range(a, b + 1)}

    def plain(s):
        s = unicodedata.normalize("NFKC", s)
        s = "".join(c for c in s if ord(c) not in inv)
        s = s.translate(str.maketrans(cm.ARABIC_INDIC + cm.EXT_ARABIC_INDIC, cm.WESTERN * 2))
        s = re.sub("ـ{2,}", "ـ", s)
        fold = str.maketrans(cm.CONFUSABLE_FROM, cm.CONFUSABLE_TO)
        return re.sub(r"\S+", lambda m: m.group().translate(fold) if re.search("[A-Za-z0-9]", m.group()) else m.group(), s)

    got = normalize(texts(spark, values)).orderBy("id").collect()
    assert [r.normalized for r in got] == [plain(v) for v in values]


POSITIVE = [
    ("Call 00966501234567 now", "PHONE"), ("Dial +966 (50) 123-4567 today", "PHONE"), ("Call +973 (37) 237 956 ASAP", "PHONE"), ("Reach +966.50.123.4567 please", "PHONE"),
    ("wire to sa7912345678901234567890ab".replace("ab", ""), None), ("wire to sa7912345678901234567890 x".replace("7890 x", "78901234 x"), None), ("IBAN SA79 1234 5678 9012 3456 7890", "IBAN"),
    ("BH14 BMAG 3844 6095505822", "IBAN"), ("1234567890 (civil ID) was matched", "NATIONAL_ID"), ("رقم الهُوِيّة 1234567890", "NATIONAL_ID"), ("We did not ship 1234567890", "NATIONAL_ID"),
]
NEGATIVE = ["Order 1234567890 shipped", "Reference 123456789 is nine digits", "SA1234 is not an IBAN", "SA79 1234 5678 9012 is too short", "2024-05-12 at 3pm", "+1234567890", "", None]


def test_detector_probes(spark):
    rows = [p for p in POSITIVE if p[1]]
    got = texts(spark, [p[0] for p in rows] + NEGATIVE).select("id", F.transform(detect.detect(F.col("text")), lambda s: s["entity_type"]).alias("t")).orderBy("id").collect()
    for p, r in zip(rows, got):
        assert p[1] in r.t, p
    assert all(not r.t for r in got[len(rows) :])


def test_overlapping_emails_and_masking(spark):
    r = redact(texts(spark, ["a@b.co@c.org", "1.2.3.4.5", "😀 mail x@y.com", "قالwww.x.com"])).orderBy("id").collect()
    assert [(s.start, s.end) for s in texts(spark, ["a@b.co@c.org"]).select(detect.emails(F.col("text")).alias("s")).first().s] == [(0, 6), (2, 12)]
    assert [x.redacted for x in r] == ["a@[EMAIL]", "[IP_ADDRESS].5", "😀 mail [EMAIL]", "قال[URL]"]


def test_find_spans_equals_finditer(spark):
    rng = random.Random(5)
    values = ["".join(rng.choice("a1. 😀ب@") for _ in range(rng.randint(0, 25))) for _ in range(200)]
    got = texts(spark, values).select("id", tx.find_spans(F.col("text"), "[0-9]+(?:[.][0-9]+)*", "N").alias("s")).orderBy("id").collect()
    for v, r in zip(values, got):
        assert [(s.start, s.end) for s in r.s] == [m.span() for m in re.finditer(r"[0-9]+(?:[.][0-9]+)*", v)]


def sp(a, b, t, o="regex", s=1.0):
    return (a, b, t, o, s, False)


def fused(spark, text, neural, rules):
    df = spark.createDataFrame([(text, neural, rules)], f"t string, n {SPAN}, r {SPAN}")
    return df.select(fuse.fuse(F.col("t"), F.col("n"), F.col("r")).alias("s")).first().s


def test_fusion_probes(spark):
    x = fused(spark, "123456789012345", [sp(0, 15, "PHONE", "neural", 0.9)], [sp(0, 15, "NATIONAL_ID")])
    assert [(s.entity_type, s.origin) for s in x] == [("NATIONAL_ID", "regex")]
    x = fused(spark, "محمد أحمد", [sp(0, 4, "LOCATION", "neural", 0.7), sp(0, 6, "LOCATION", "neural", 0.99)], [])
    assert [(s.start, s.end) for s in x] == [(0, 6)]
    x = fused(spark, "أبو محمد قال ذلك", [sp(4, 8, "PERSON", "neural", 0.9)], [])
    assert [(s.start, s.end, s.expanded) for s in x] == [(0, 8, True)]
    x = fused(spark, "محمد الدوسري وصل", [sp(0, 4, "PERSON", "neural", 0.9)], [])
    assert [(s.start, s.end) for s in x] == [(0, 12)]
    assert len(fused(spark, "a" * 20, [], [sp(0, 10, "URL"), sp(10, 20, "EMAIL")])) == 2
    assert fused(spark, "x", [], []) == []


def test_decode_bio_and_contained(spark):
    toks = [(0, 3, "B-PERSON", 0.9), (4, 7, "I-PERSON", 0.8), (8, 9, "O", 1.0), (10, 12, "I-PHONE", 0.9), (13, 15, "B-PHONE", 0.2)]
    df = spark.createDataFrame([(toks,)], "t array<struct<start:int,end:int,label:string,score:double>>")
    s = df.select(fuse.decode_bio(F.col("t")).alias("s")).first().s
    assert [(x.start, x.end, x.entity_type, x.score) for x in s] == [(0, 7, "PERSON", 0.8), (10, 12, "PHONE", 0.9)]
    df = spark.createDataFrame([([sp(0, 10, "A"), sp(2, 5, "B"), sp(10, 12, "C")],)], f"s {SPAN}")
    assert [x.entity_type for x in df.select(fuse.drop_contained(F.col("s")).alias("s")).first().s] == ["A", "C"]


def test_systems_and_extra_columns(spark):
    df = texts(spark, ["+٩٦٦٥٠١٢٣٤٥٦٧"]).withColumn("spans", F.lit("mine"))
    r = {x.system: x for x in run_systems(df, ("full", "no_stage1")).collect()}
    assert len(r["full"].pred) == 1 and len(r["no_stage1"].pred) == 0


def test_empty_table(spark):
    assert redact(texts(spark, []).where("id < 0")).count() == 0
