"""Audit chains, sources and sinks, streaming, the driver contract."""

import json
import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from maskwright.operators import audit
from maskwright.operators.redact import redact
from maskwright.sources import io
from maskwright.streaming.redact_stream import audited_sink, redact_stream

SEED, KEY = b"\x07" * 32, b"secret"


@pytest.fixture(scope="module")
def log(spark, tmp_path_factory):
    rows = [("a" if i % 2 else "b", i, f"t{i}", float(i), f"mail x{i}@y.com") for i in range(10)]
    df = redact(spark.createDataFrame(rows, "log_id string, seq long, transaction_id string, timestamp double, text string"))
    path = str(tmp_path_factory.mktemp("log") / "log")
    audit.append(df, hash_key=KEY, seed=SEED).write.parquet(path)
    return spark.read.parquet(path)


def valid(log):
    return all(r.valid for r in audit.verify_chain(log, audit.public_key(SEED)).collect())


def test_rfc8032_vector():
    seed = bytes.fromhex("9d61b19deffd5a60ba844af492ec2cc44449c5697b326919703bac031cae7f60")
    assert audit.public_key(seed).hex() == "d75a980182b10ab7d54bfed3c964073a0ee172f3daa62325af021a68f707511a"
    sig = audit.sign(seed, b"")
    assert sig.hex().startswith("e5564300c360ac729086e2cc806e828a") and audit.verify(audit.public_key(seed), b"", sig)
    assert not audit.verify(audit.public_key(seed), b"x", sig)


def test_chain_and_tampering(log):
    assert valid(log)
    assert not valid(log.withColumn("output_hash", F.when(F.col("seq") == 3, "0" * 64).otherwise(F.col("output_hash"))))
    assert not valid(log.withColumn("signature", F.when(F.col("seq") == 3, "00" * 64).otherwise(F.col("signature"))))
    assert not valid(log.where("seq <> 4"))
    assert "x3@y.com" not in json.dumps([r.asDict(True) for r in log.collect()], default=str)


def test_checkpoint(spark, log):
    pub, c = audit.public_key(SEED), audit.checkpoint(log, SEED)
    ok = lambda l, s: all(r.valid for r in audit.verify_checkpoint(l, s, pub).collect())
    assert ok(log, c)
    assert not ok(log.where("seq < 8"), c)
    assert not ok(log, c.withColumn("count", F.lit(2).cast("long")))
    assert audit.keyed_digest(KEY, "x") != __import__("hashlib").sha256(b"x").hexdigest()


def test_sources(spark, tmp_path):
    p = tmp_path / "in.txt"
    p.write_text("one +966501234567\n\n  \ntwo\r\n", encoding="utf-8")
    assert sorted(r.text for r in io.read_lines(spark, str(p)).collect()) == ["one +966501234567", "two"]
    io.write_lines(redact(io.read_lines(spark, str(p))), str(tmp_path / "out"))
    assert "one [PHONE]" in [r.value for r in spark.read.text(str(tmp_path / "out")).collect()]
    rec = spark.createDataFrame([("hi Huda", [(3, 7, "PERSON")])], "text string, entities array<struct<start:int,end:int,entity_type:string>>")
    io.write_records(rec, str(tmp_path / "rec"))
    assert io.differences(io.read_records(spark, str(tmp_path / "rec")), rec) == 0
    (tmp_path / "s.csv").write_text("sentence_id,start,end,label,note\na,0,3,PHONE,\nb,1,2,NOISE,x\n")
    s = io.read_spans(spark, str(tmp_path / "s.csv"), ["PHONE"])
    assert [(r.sentence_id, r.start, r.end) for r in s.collect()] == [("a", 0, 3)]
    items = spark.createDataFrame([("a", "abc"), ("b", "x")], "sentence_id string, text string")
    assert {r.sentence_id: len(r.gold) for r in io.read_cases(items, s).collect()} == {"a": 1, "b": 0}
    (tmp_path / "l.json").write_text('{"e1": 0.5, "e2": 1.5}')
    assert sorted((r.example_id, r.loss) for r in io.read_losses(spark, str(tmp_path / "l.json"), "m", "in").collect()) == [("e1", 0.5), ("e2", 1.5)]
    (tmp_path / "c.yaml").write_text("a: 1\nb:\n  c: true  # note\n  d: x\n")
    assert io.read_config(str(tmp_path / "c.yaml")) == {"a": 1, "b": {"c": True, "d": "x"}}


def test_write_once(spark, tmp_path):
    root = os.path.dirname(io.__file__)
    io.write_once(spark.range(1), str(tmp_path / "r"), root, io.source_hash(root))
    with pytest.raises(Exception):
        io.write_once(spark.range(1), str(tmp_path / "r"), root)
    with pytest.raises(RuntimeError):
        io.write_once(spark.range(1), str(tmp_path / "q"), root, "0")


def test_stream_equals_batch_and_audits(spark, tmp_path):
    src, out, log = (str(tmp_path / x) for x in ("src", "out", "log"))
    rows = [(f"l{i % 2}", i, f"mail x{i}@y.com") for i in range(20)]
    df = spark.createDataFrame(rows, "log_id string, seq long, text string")
    df.repartition(2).write.parquet(src)
    stream = redact_stream(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(src))
    q = stream.writeStream.foreachBatch(audited_sink(out, log, hash_key=KEY, seed=SEED)).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = spark.read.parquet(out).select("log_id", "seq", "redacted")
    assert io.differences(got, redact(df).select("log_id", "seq", "redacted")) == 0
    entries = spark.read.parquet(log)
    assert entries.count() == 20 and all(r.intact for r in audit.verify_links(entries).collect())


def test_stream_chain_goes_on_whatever_the_order(spark, tmp_path):
    """Batches with falling seq, a batch without rows of a log, and a batch that is run again: one chain per log, as written."""
    out, log = str(tmp_path / "out"), str(tmp_path / "log")
    sink = audited_sink(out, log, hash_key=KEY, seed=SEED)
    batches = [[("l", 10), ("l", 11), ("m", 1)], [("l", 5), ("l", 6)], [("l", 7), ("l", 8), ("m", 0)]]
    for i, rows in enumerate(batches):
        df = redact(spark.createDataFrame([(a, b, f"mail x{b}@y.com") for a, b in rows], "log_id string, seq long, text string"))
        for _ in range(1 + (i == 1)):
            sink(df, i)
    entries = spark.read.parquet(log)
    assert valid(entries) and {r.log_id: r.entries for r in audit.verify_links(entries).collect()} == {"l": 6, "m": 2}
    order = [r.seq for r in entries.where("log_id = 'l'").orderBy("position").collect()]
    assert order == [10, 11, 5, 6, 7, 8]
    assert {r.log_id: r["count"] for r in spark.read.parquet(log + "_heads/batch=2").collect()} == {"l": 6, "m": 2}
    assert not valid(entries.where("position <> 3"))


def test_entry_without_llm():
    """The rest stands without the optional subpackage."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = "import sys; sys.modules['maskwright.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert len(q) > 40 and not any(k.startswith('p1_') for k in q); assert set(e.oracle_sql()) <= set(q)"
    r = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True)
    assert r.returncode == 0, r.stderr


def test_queries_build(spark):
    import __spark_entry__ as e

    d = "/root/testdata/sf0.001"
    if not os.path.isdir(d):
        pytest.skip("no test tables")
    for name in ("prf_exact", "phone_detect", "kappa_char", "corpus_breakdown"):
        assert e.queries()[name](spark, d).count() > 0
    assert e.entry(spark).count() > 0
