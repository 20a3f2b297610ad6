"""Incremental scoring: confusion counts of a stream of labelled rows.

Counts are sums, so each micro-batch is counted by itself and appended; the total
is a sum over the appended table. Batches are written under their id, so a batch
that runs again after a failure replaces its own rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.metrics import confusion
from ..plans.flagship import shared_folder


def stream_confusion(spark: SparkSession, path: str, gt: Column, pred: Column) -> DataFrame:
    """Run a file stream to its end and return (gt, pred, n)."""
    top = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    folder, _, name = path.rpartition("/")
    rows = spark.readStream.schema(spark.read.parquet(path).schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").parquet(path) if _is_dir(spark, path) else spark.readStream.schema(spark.read.parquet(path).schema).option("pathGlobFilter", name).parquet(folder)

    def count(batch: DataFrame, number: int) -> None:
        confusion(batch.select(gt.alias("gt"), pred.alias("pred")), []).write.mode("overwrite").parquet(f"{top}/counts/batch={number}")

    query = rows.writeStream.foreachBatch(count).option("checkpointLocation", f"{top}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(f"{top}/counts").groupBy("gt", "pred").agg(F.sum("n").alias("n"))


def _is_dir(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


def windowed_counts(rows: DataFrame, time: str, key: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Rows by key and tumbling window, dropping what comes later than ``late``."""
    return rows.withWatermark(time, late).groupBy(F.window(time, width), key).agg(F.count("*").alias("n"))
