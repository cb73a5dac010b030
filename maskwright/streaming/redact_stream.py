"""Redaction of streams: the same projection as in batch, and audit entries per micro-batch."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.operators import audit
from maskwright.operators.redact import redact


def redact_stream(stream: DataFrame, text: str = "text", **options) -> DataFrame:
    """Stateless: runs as it is on readStream."""
    return redact(stream, text, **options)


def audited_sink(path: str, log_path: str, *, hash_key: bytes, seed: bytes, log_id: str = "log_id", seq: str = "seq"):
    """A foreachBatch function: writes the redacted rows of a batch and appends to the chains of its logs.

    Output goes to a folder named by the batch, so a batch that is run again replaces what it wrote and a log gets each entry
    once. A batch goes on from where each log ends, whatever the seq of its rows: the heads of all logs are a small table beside
    the log, written anew by each batch; a batch reads the one before it, never the log.
    """
    heads_path = f"{log_path.rstrip('/')}_heads"

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = batch.withColumn("log_id", F.col(log_id).cast("string")).withColumn("seq", F.col(seq).cast("long"))
        rows = rows.withColumn("transaction_id", F.sha2(F.concat_ws("|", "log_id", F.col("seq").cast("string")), 256)).withColumn("timestamp", F.unix_timestamp().cast("double"))
        rows.drop("timestamp").write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        before = _heads_before(spark, heads_path, batch_id)
        own = f"{log_path}/batch={batch_id}"
        audit.append(rows, hash_key=hash_key, seed=seed, heads=before).write.mode("overwrite").parquet(own)
        audit.moved_heads(before, spark.read.parquet(own)).write.mode("overwrite").parquet(f"{heads_path}/batch={batch_id}")

    return run


def _heads_before(spark: SparkSession, path: str, batch_id: int) -> DataFrame:
    """The heads after the last batch before this one."""
    try:
        all_heads = spark.read.schema("log_id string, count long, head_hash string, batch long").parquet(path)
        last = all_heads.where(F.col("batch") < batch_id).agg(F.max("batch")).first()[0]
    except AnalysisException as e:  # no batch yet
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        last = None
    if last is None:
        return spark.createDataFrame([], "log_id string, count long, head_hash string")
    return spark.read.parquet(f"{path}/batch={last}")
