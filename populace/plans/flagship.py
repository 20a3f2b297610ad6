"""Predictions to metrics in one plan: parent filter, gates, confusion, roll-up."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.predicates import compile_predicate, reference_label
from ..operators import metrics as M
from ..operators.gates import assign


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local one only on one machine (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="populace-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write to the shared folder and read back, so that plans stay short and lost
    executors cost no earlier step."""
    path = f"{shared_folder(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete tables of :func:`cut_lineage` that no later plan reads."""
    for df in frames:
        if path := getattr(df, "_cut_path", None):
            p = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def evaluate_gates(cells: DataFrame, task: list[str], parent: str, label: str, gates, categories: list[str], rule: str = "smallest") -> DataFrame:
    """Task metrics of gate labels against the reference label inside the parent."""
    inside = cells.where(compile_predicate(parent, cells.columns))
    gt, pred = M.scored(reference_label(label), assign(F.col("x"), F.col("y"), gates, categories, rule))
    counts = M.confusion(inside.select(*task, gt.alias("gt"), pred.alias("pred")), task)
    listed = counts.select(*task).distinct().select(*task, F.explode(F.array(*(F.lit(c) for c in categories))).alias("label"))
    return M.task_metrics(counts, listed, task)
