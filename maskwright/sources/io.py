"""Readers and writers: text lines, JSON lines, annotation CSV, loss files, provenance, guarded results."""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright import schema as sc


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(text): one row per line that is not blank, without the line's end."""
    return spark.read.text(path).select(F.regexp_replace("value", r"[\r\n]+$", "").alias("text")).where(F.trim("text") != "")


def write_lines(df: DataFrame, path: str, column: str = "redacted") -> None:
    df.select(F.col(column).alias("value")).write.text(path)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of text and entities, by schema; malformed lines fail."""
    return spark.read.schema(sc.RECORD_DDL).json(path, mode="FAILFAST")


def write_records(df: DataFrame, path: str) -> None:
    df.select("text", "entities").write.json(path)


def read_spans(spark: SparkSession, path: str, labels: Iterable[str] | None = None) -> DataFrame:
    """Annotation spans from CSV with a header; rows of unknown labels are left out."""
    df = spark.read.schema(sc.ANNOTATION_DDL).csv(path, header=True, enforceSchema=False) if _columns(spark, path) == 5 else spark.read.schema("sentence_id string, start int, end int, label string").csv(path, header=True)
    return df.where(F.col("label").isin(*labels)) if labels else df


def _columns(spark: SparkSession, path: str) -> int:
    head = spark.read.text(path).limit(1).collect()
    return len(head[0][0].split(",")) if head else 0


def read_items(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(sc.ITEMS_DDL).csv(path, header=True, multiLine=True, escape='"')


def read_cases(items: DataFrame, gold: DataFrame, key: str = "sentence_id") -> DataFrame:
    """(key, text, gold): each item with the array of its gold spans; items without gold keep an empty one."""
    g = gold.groupBy(key).agg(F.sort_array(F.collect_set(F.struct("start", "end", "label"))).alias("gold"))
    empty = F.array().cast("array<struct<start:int,end:int,label:string>>")
    return items.select(key, "text").join(g, key, "left").withColumn("gold", F.coalesce("gold", empty))


def read_losses(spark: SparkSession, path: str, model_id: str, membership: str | None = None) -> DataFrame:
    """A JSON object of example -> loss as rows (model_id, example_id, membership, loss)."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,double>").alias("m"))
    return raw.select(F.lit(model_id).alias("model_id"), F.explode("m").alias("example_id", "loss")).withColumn("membership", F.lit(membership)).select("model_id", "example_id", "membership", "loss")


def read_config(path: str) -> dict:
    """Parameters from a JSON or flat YAML file (key: value, indented sections)."""
    with open(path, encoding="utf-8") as f:
        raw = f.read()
    if raw.lstrip().startswith("{"):
        return json.loads(raw)
    out: dict = {}
    stack: list[tuple[int, dict]] = [(-1, out)]
    for line in raw.splitlines():
        body = line.split(" #")[0].rstrip()
        if not body.strip() or body.lstrip().startswith("#"):
            continue
        depth = len(body) - len(body.lstrip())
        key, _, value = body.strip().partition(":")
        while stack[-1][0] >= depth:
            stack.pop()
        if value.strip():
            try:
                stack[-1][1][key] = json.loads(value)
            except ValueError:
                stack[-1][1][key] = {"true": True, "false": False, "null": None}.get(value.strip().lower(), value.strip().strip("'\""))
        else:
            stack[-1][1][key] = child = {}
            stack.append((depth, child))
    return out


def source_hash(root: str, pattern: str = ".py") -> str:
    """SHA-256 over the names and contents of source files, sorted."""
    h = hashlib.sha256()
    files = sorted(os.path.join(d, f) for d, _, fs in os.walk(root) for f in fs if f.endswith(pattern))
    for f in files:
        h.update(os.path.relpath(f, root).encode())
        with open(f, "rb") as g:
            h.update(g.read())
    return h.hexdigest()


def provenance(root: str) -> dict:
    import platform

    import pyspark

    return {"code_sha256": source_hash(root), "python": platform.python_version(), "pyspark": pyspark.__version__}


def write_once(df: DataFrame, path: str, root: str, expected: str | None = None) -> None:
    """Write a result that may be made once: fails if it is there, or if the code is not what was agreed on."""
    if expected is not None and source_hash(root) != expected:
        raise RuntimeError("the code differs from the frozen one")
    df.write.mode("errorifexists").json(path)


def differences(a: DataFrame, b: DataFrame) -> int:
    """Rows by which two results differ, both ways; 0 means that the result was reproduced."""
    return a.exceptAll(b).count() + b.exceptAll(a).count()
