"""Session helpers: reading tables, cutting lineage, shipping the package."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Only where none is set (as in local tests) a temporary one is made and set."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="maskwright-")
        spark.sparkContext.setCheckpointDir(found)
        atexit.register(shutil.rmtree, found.removeprefix("file://"), True)
    return found


def cut(df: DataFrame, *, partition_by: list[str] | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: a columnar, compressed cut of the lineage that outlives any executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/cut-{uuid.uuid4().hex}"
    w = df.write
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    # Results are lazy, so they may read a cut long after the query returned it: it goes when the application ends. (Only a path
    # that exists can be marked so.)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


#: Bytes of a partition from which moving rows to more tasks is not worth it.
SPREAD_BELOW = 32 << 20


def spread(df: DataFrame) -> DataFrame:
    """df over all cores, if it is a small table: a small file is one row group, so one task reads all of it, however many splits it
    has. That is decided by bytes: only a table with less than SPREAD_BELOW for each core is moved, which is a bounded amount,
    and never into fewer partitions than it has. A larger table, or a stream, stays as it is."""
    sc = df.sparkSession.sparkContext
    if df.isStreaming or int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) >= SPREAD_BELOW * sc.defaultParallelism:
        return df
    n = df.rdd.getNumPartitions()
    return df.repartition(max(n, sc.defaultParallelism)) if n < 4 * sc.defaultParallelism else df


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the Python workers of this application the package, wherever they run."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    folder = tempfile.mkdtemp(prefix="maskwright-")  # on the driver, which serves the file to the workers while it lives
    atexit.register(shutil.rmtree, folder, True)
    path = os.path.join(folder, "maskwright.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for at, _, files in os.walk(root):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(at, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(path)
    _SHIPPED.add(sc.applicationId)


def running_sums(df: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """df with running sums in an order over all rows, this row included. No task gets more than a range of the order: rows are
    range-partitioned and summed up inside each range, after the totals of the ranges before it - a row per partition."""
    ranged = cut(df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()))
    upto = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    totals = ranged.groupBy("__range").agg(*[F.sum(c).alias(f"__s_{k}") for k, c in sums.items()])
    before = totals.select("__range", *[F.coalesce(F.sum(f"__s_{k}").over(upto), F.lit(0)).alias(f"__b_{k}") for k in sums])
    inside = Window.partitionBy("__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = ranged.join(F.broadcast(before), "__range")
    return out.select(*df.columns, *[(F.col(f"__b_{k}") + F.sum(c).over(inside)).alias(k) for k, c in sums.items()])
