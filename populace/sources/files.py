"""Files: sample tables, metadata, predictions, and their sinks.

All paths go through Spark's readers and writers, so any store that Spark reads
will do. Sinks of a query go to the shared folder.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.predicates import normalized, quoted
from ..plans.flagship import shared_folder


def scan_samples(spark: SparkSession, path: str | list[str], labels: Sequence[str] | None = None, channels: Sequence[str] | None = None, renames: Mapping[str, str] | None = None) -> DataFrame:
    """A cohort's sample tables with ``sample`` (file name) and ``row_id`` (place in the file).

    labels default to the columns named Step*; empty labels become NULL. With
    channels only those and the labels are read."""
    df = spark.read.option("mergeSchema", "false").parquet(*([path] if isinstance(path, str) else path))
    labels = [c for c in df.columns if c.startswith("Step")] if labels is None else list(labels)
    kept = [c for c in df.columns if c not in labels and (channels is None or c in channels)]
    name = F.regexp_replace("_metadata.file_name", r"\.parquet$", "")
    return df.select(name.alias("sample"), F.col("_metadata.row_index").alias("row_id"), *(quoted(c) for c in kept), *(normalized(c, dict(renames or {})).alias(c) for c in labels))


def scan_wide_floats(spark: SparkSession, path: str) -> DataFrame:
    """Tables with half-precision columns, which the Parquet reader refuses: files are
    listed and read as bytes by Spark, decoded by Arrow and widened."""
    import io

    import pyarrow as pa
    import pyarrow.parquet as pq

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path)
    first = files.select("content").limit(1).collect()[0][0]
    schema = pq.read_schema(io.BytesIO(first))
    wide = pa.schema([pa.field(f.name, pa.float32() if f.type == pa.float16() else f.type) for f in schema])
    from pyspark.sql.pandas.types import from_arrow_schema

    def read(batches):
        for b in batches:
            for data in b.column(0):
                yield from pq.read_table(io.BytesIO(data.as_py())).cast(wide).to_batches()

    return files.select("content").mapInArrow(read, from_arrow_schema(wide))


def channels(spark: SparkSession, meta: Mapping) -> DataFrame:
    """(channel, marker, kind, ord) of a metadata document."""
    rows = [(c, v[0], v[1] if len(v) > 1 else "unknown", i) for i, (c, v) in enumerate(meta["channels"].items())]
    return spark.createDataFrame(rows, "channel string, marker string, kind string, ord int")


def read_channels(spark: SparkSession, path: str) -> DataFrame:
    """The same from JSON files."""
    doc = spark.read.option("multiLine", "true").schema("cohort string, cofactor double, channels map<string, array<string>>").json(path)
    return doc.select("cohort", "cofactor", F.posexplode(F.map_entries("channels")).alias("ord", "e")).select("cohort", "cofactor", F.col("e.key").alias("channel"), F.get("e.value", 0).alias("marker"), F.coalesce(F.get("e.value", 1), F.lit("unknown")).alias("kind"), "ord")


TASK = "task_id string, dataset string, sample string, step int, parent string, x_marker string, y_marker string, annotation_column string, categories array<string>, gt_summary struct<n_parent_cells: long, n_cells_per_category: map<string, long>, population_proportions: map<string, double>>"


def read_tasks(spark: SparkSession, path: str, datasets: Sequence[str] = (), steps: Sequence[int] = (), min_cells: int = 0, pattern: str = "task.json") -> DataFrame:
    """Task documents under a folder, by dataset, step and parent size."""
    t = spark.read.schema(TASK).option("multiLine", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).json(path)
    t = t.where(F.col("dataset").isin(*datasets)) if datasets else t
    t = t.where(F.col("step").isin(*steps)) if steps else t
    return t.where(F.coalesce("gt_summary.n_parent_cells", F.lit(0)) >= min_cells)


def thresholds(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("x_thresholds array<double>, y_thresholds array<double>").option("multiLine", "true").json(path)


def notes(spark: SparkSession, rows: Sequence[tuple[str, int, str, str | None]], wanted: DataFrame) -> DataFrame:
    """Definitions for (dataset, step); one that is missing is an error when read."""
    n = spark.createDataFrame(list(rows), "dataset string, step int, definition string, oracle string")
    j = wanted.join(n, ["dataset", "step"], "left")
    return j.withColumn("definition", F.coalesce("definition", F.raise_error(F.concat(F.lit("no note for "), "dataset"))))


def path_parts(df: DataFrame, path: str) -> DataFrame:
    """scenario, dataset, step, magnitude, sample and task_step of result paths."""
    p = F.col(path)
    at = r"/([^/]+)/([^/]+)_step(\d+)/[a-z]+_([^/]+)/[^/]+/([^/]+)/step_(\d+)/[^/]+$"
    part = lambda i: F.regexp_extract(p, at, i)
    return df.where(p.rlike(at)).select(part(1).alias("scenario"), part(2).alias("dataset"), part(3).cast("int").alias("step"), part(4).alias("magnitude"), part(5).alias("sample"), part(6).cast("int").alias("task_step"))


def _place(df: DataFrame, name: str) -> str:
    return f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"


def write_predictions(rows: DataFrame, task: Sequence[str]) -> tuple[SparkSession, str, list[str]]:
    """One JSON line for each task, labels in order of pos, compressed."""
    path = _place(rows, "predictions")
    labels = F.transform(F.array_sort(F.collect_list(F.struct("pos", "label"))), lambda s: s["label"])
    rows.groupBy(*task).agg(labels.alias("predicted_labels")).write.option("compression", "gzip").option("ignoreNullFields", "false").json(path)
    return rows.sparkSession, path, list(task)


def read_predictions(at: tuple[SparkSession, str, list[str]]) -> DataFrame:
    """(task, pos, label) rows of prediction files, compressed or not."""
    spark, path, task = at
    schema = ", ".join([*(f"{t} string" for t in task), "predicted_labels array<string>"])
    return spark.read.schema(schema).json(path).select(*task, F.posexplode("predicted_labels").alias("pos", "label"))


def round_trip(rows: DataFrame, partition: Sequence[str] = ()) -> DataFrame:
    """Written as partitioned Parquet and read again."""
    path = _place(rows, "table")
    rows.write.partitionBy(*partition).option("compression", "zstd").parquet(path)
    return rows.sparkSession.read.parquet(path)


def csv_round_trip(rows: DataFrame) -> DataFrame:
    path = _place(rows, "csv")
    rows.write.option("header", "true").option("compression", "gzip").csv(path)
    return rows.sparkSession.read.schema(rows.schema).option("header", "true").csv(path)
