"""The Arrow function against the column expressions, which say the same thing in another way."""

import random
import time

import pytest
from pyspark.sql import functions as F

from maskwright.functions import charmap as cm
from maskwright.functions.scan import Scanner, scanned_counts
from maskwright.operators.detect import detect
from maskwright.operators.normalize import STEPS, normalize
from maskwright.operators.redact import ABLATIONS, redact
from maskwright.operators.synth import SCALING_INPUTS, scaling_text

PROBES = [
    None, "", "a@b.co@c.org", "mail .x@y.com, -z+1@q-r.example.museum!", "see https://x.example/?to=c@mail.test or www.a.b", "1.2.3.4.5 and 256.1.1.1", "+966 50 123 4567 00971-50-987-6543 +973 (37) 123456",
    "iban sa79 1234 5678 9012 3456 7890, BH14BMAG00001299123456, KW81 CBKU 0000 0000 0000 1234 5601 01", "national id 1234567890 and order 1234567890", "1234567890 (civil ID) was matched", "رقم الهُوِيّة ١٢٣٤٥٦٧٨٩٠",
    "Ｃall ＋９６６５０１２３４５６７", "С​A79 СА79 привет мир", "م" + cm.TATWEEL * 5 + "حمد", "‮hello‬ ⁧x⁩", "a" * 70 + "@b.co", "@@@ @a.b", "x@" + "a." * 200 + "com", "\U0001f600 +966501234567 \U0001f600",
]


def _texts(n: int) -> list:
    rng = random.Random(3)
    parts = [p for p in PROBES if p] + [" ", " ", "@", ".", "00", "+", "٣", "۴", "А", "ο", cm.TATWEEL, "​", "️", "é", "ﻻ", "id: ", "identity ", "(", "SA", "9" * 10]
    return PROBES + ["".join(rng.choice(parts) if rng.random() < 0.8 else rng.choice(parts)[: rng.randint(1, 12)] for _ in range(rng.randint(1, 5))) for _ in range(n)]


@pytest.mark.parametrize("name", ["full", "no_stage1", "without_nfkc", "only_confusables", "without_invisible"])
def test_arrow_equals_columns(spark, name):
    df = spark.createDataFrame(list(enumerate(_texts(250))), "i int, text string")
    a, b = redact(df, steps=ABLATIONS[name]), redact(df, steps=ABLATIONS[name], columns=True)
    assert a.columns == b.columns and a.schema.simpleString() == b.schema.simpleString()
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_counts_before_fusion(spark):
    df = spark.createDataFrame(list(enumerate(_texts(100))), "i int, text string")
    by_columns = normalize(df, report=None).select("i", F.expr("transform(array('EMAIL', 'URL', 'IP_ADDRESS', 'PHONE', 'IBAN', 'NATIONAL_ID'), t -> t)").alias("t"), detect(F.col("normalized")).alias("s"))
    want = {r.i: None if r.s is None else [sum(x.entity_type == t for x in r.s) for t in r.t] for r in by_columns.collect()}
    assert {r.i: r.n for r in df.select("i", scanned_counts(F.col("text"), STEPS).alias("n")).collect()} == want


def test_extra_columns_and_other_masks(spark):
    df = spark.createDataFrame([(1, "mail a1@b.co", "x"), (2, None, "y")], "id int, body string, spans string").withColumn("redacted", F.lit(0))
    got = {r.id: r for r in redact(df, "body", mask_format=("<", ">")).collect()}
    assert got[1].redacted == "mail <EMAIL>" and got[2].redacted is None and got[2].spans is None and got[2].report is None
    assert redact(df.where("false"), "body").count() == 0
    with pytest.raises(ValueError):
        redact(df, "body", steps=("nfkc", "magic"))


@pytest.mark.parametrize("shape", SCALING_INPUTS)
def test_time_grows_in_proportion(shape):
    """64 times the text takes nowhere near 64 squared times as long."""
    scan = Scanner(frozenset(STEPS))
    took = []
    for n in (4000, 256_000):
        text, best = scaling_text(shape, n), 9e9
        for _ in range(3):
            t0 = time.perf_counter()
            t = scan.normalize(text)[0]
            scan.mask(t, scan.resolve(scan.detect(t)))
            best = min(best, time.perf_counter() - t0)
        took.append(best)
    assert took[1] < 64 * 6 * max(took[0], 2e-5)
