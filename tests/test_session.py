"""Cutting, spreading, shipping, and what the driver's entry leaves out."""

import os
import subprocess
import sys
import time

import pytest

from maskwright.functions import session


def test_spread_moves_only_small_tables(spark, tmp_path, monkeypatch):
    cores = spark.sparkContext.defaultParallelism
    spark.range(1000).coalesce(1).write.parquet(str(tmp_path / "one"))
    small = spark.read.parquet(str(tmp_path / "one"))
    assert session.spread(small).rdd.getNumPartitions() == cores
    many = spark.range(1000).repartition(2 * cores)
    assert session.spread(many).rdd.getNumPartitions() >= 2 * cores  # never fewer than before
    monkeypatch.setattr(session, "SPREAD_BELOW", 1)
    assert session.spread(small) is small and session.spread(many) is many


def test_cut_keeps_rows_and_goes_in_the_end(spark):
    df = session.cut(spark.range(10).withColumnRenamed("id", "x"))
    assert df.count() == 10 and df.columns == ["x"]
    assert all(os.path.exists(f.removeprefix("file://")) for f in df.inputFiles())
    empty = session.cut(df.where("false"))
    assert empty.count() == 0 and empty.columns == ["x"]


def test_cuts_go_with_the_application(tmp_path):
    """A process of its own: its cuts are there while it runs and gone after it."""
    code = f"""
import sys
sys.path.insert(0, {os.path.dirname(os.path.dirname(os.path.abspath(session.__file__)))!r} + "/..")
from pyspark.sql import SparkSession
from maskwright.functions.session import cut
s = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", {str(tmp_path)!r}).getOrCreate()
print("rows", cut(s.range(5)).count(), len(__import__("os").listdir({str(tmp_path)!r})) > 0)
s.stop()
"""
    r = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=120)
    assert "rows 5 True" in r.stdout, r.stderr[-2000:]
    for _ in range(50):
        if not any(f.startswith("cut-") for f in os.listdir(tmp_path)):
            break
        time.sleep(0.2)
    assert not any(f.startswith("cut-") for f in os.listdir(tmp_path))


def test_entry_hides_no_broken_import(monkeypatch):
    import __spark_entry__ as entry

    assert "ip_spans" in entry.queries() and set(entry.oracle_sql()) <= set(entry.queries())
    monkeypatch.setitem(sys.modules, "maskwright.plans.core", None)
    with pytest.raises(ModuleNotFoundError):
        entry.queries()
