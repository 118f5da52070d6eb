"""Streams: the current projection kept by micro-batches, and a changefeed that resumes from its checkpoint."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.temporal import current_projection


def _latest(spark: SparkSession, path: str, schema) -> tuple[DataFrame, int]:
    """The newest generation that was finished, and its number (-1 if there is none)."""
    jvm = spark._jvm.org.apache.hadoop.fs
    root = jvm.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [int(s.getPath().getName().removeprefix("gen=")) for s in (fs.listStatus(root) if fs.exists(root) else []) if s.getPath().getName().startswith("gen=") and fs.exists(jvm.Path(s.getPath(), "_SUCCESS"))]
    n = max(found, default=-1)
    return (spark.read.schema(schema).parquet(f"{path}/gen={n}") if n >= 0 else spark.createDataFrame([], schema)), n


def project_stream(claims: DataFrame, path: str, checkpoint: str, once: bool = True):
    """Fold a stream of claims into generations at path. A batch that is tried again writes its generation anew, from the
    one before it, so the fold happens once."""
    schema = claims.schema

    def fold(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if number == 0:
            before = spark.createDataFrame([], schema)
        else:
            before = spark.read.schema(schema).parquet(f"{path}/gen={number - 1}")
        current_projection(before.unionByName(batch)).write.mode("overwrite").parquet(f"{path}/gen={number}")

    writer = claims.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def read_projection(spark: SparkSession, path: str, schema) -> DataFrame:
    return _latest(spark, path, schema)[0]


def follow(log: DataFrame, checkpoint: str, deliver: Callable[[DataFrame, int], None], scope: str | None = None):
    """Deliver a log's changes batch by batch; the checkpoint holds how far it came."""
    rows = log.where(F.col("scope") == scope) if scope is not None else log
    return rows.writeStream.foreachBatch(deliver).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def idempotent_sink(path: str, key: str = "commit_id") -> Callable[[DataFrame, int], None]:
    """Append only what has a key that the table at path hasn't."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        root = spark._jvm.org.apache.hadoop.fs.Path(path)
        if root.getFileSystem(spark._jsc.hadoopConfiguration()).exists(root):
            known = spark.read.schema(batch.schema).parquet(path).select(key).distinct()
            batch = batch.join(known, key, "left_anti").select(*batch.columns)
        batch.write.mode("append").parquet(path)

    return write
