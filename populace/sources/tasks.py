"""Task documents, registries, notes, result trees and cohort folders, through Spark's
readers and writers.

Documents are few beside the rows they come from: they are made by one aggregate and
written by the executors. A folder may lie wherever Spark reads and writes. What a driver
reads whole is a registry or another list that a person wrote.
"""

from __future__ import annotations

import json
import warnings
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.predicates import UNASSIGNED, compile_predicate, quoted, reference_label, resolve_channel
from ..operators.perturb import sample_exact

#: Names of a magnitude folder's prefix, and the mode that each stands for.
MODES = {"frac": "depletion", "scale": "shift"}
# a folder's name, plain or as Spark's writer gives it
_K = r"(?:[^/=]+=)?"


def write_document(spark: SparkSession, path: str, doc) -> None:
    """One JSON document as a folder of one file."""
    spark.createDataFrame([(json.dumps(doc),)], "value string").coalesce(1).write.text(path)


def documents(spark: SparkSession, path: str) -> list:
    """The parsed documents (YAML, of which JSON is a part) of a file or folder written by hand."""
    texts = [r[0] for r in spark.read.option("wholetext", "true").text(path).collect()]
    try:
        import yaml
    except ImportError:
        return [json.loads(t) for t in texts]
    return [yaml.safe_load(t) for t in texts]


@dataclass(frozen=True)
class TaskStep:
    """A step of a plan: its label column, the parent predicate, two markers, the categories."""

    number: int
    column: str
    parent: str
    x: str
    y: str
    categories: tuple[str, ...]


def step_counts(cells: DataFrame, sample: Sequence[str], steps: Sequence[TaskStep]) -> DataFrame:
    """(sample, step, label, n): reference labels inside each step's parent, all steps in one pass."""
    item = lambda s: F.struct(F.lit(s.number).alias("step"), reference_label(s.column).alias("label"))
    inside = [F.when(compile_predicate(s.parent, cells.columns), item(s)) for s in steps]
    long = cells.select(*sample, F.explode(F.filter(F.array(*inside), lambda v: v.isNotNull())).alias("s"))
    return long.groupBy(*sample, F.col("s.step").alias("step"), F.col("s.label").alias("label")).agg(F.count("*").alias("n"))


def tasks(cells: DataFrame, steps: Sequence[TaskStep], dataset: str = "dataset", sample: str = "sample", channels: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """A task document for every sample and step with rows in its parent. Steps without their
    label column, or with a marker that names no column, are left out."""
    found = lambda m: resolve_channel(m, cells.columns, channels) is not None
    steps = [s for s in steps if s.column in cells.columns and found(s.x) and found(s.y)]
    spark = cells.sparkSession
    plan = spark.createDataFrame([(s.number, s.column, s.parent, s.x, s.y, list(s.categories)) for s in steps], "step int, annotation_column string, parent string, x_marker string, y_marker string, categories array<string>")
    counts = step_counts(cells, [dataset, sample], steps) if steps else None
    if counts is None:
        counts = cells.limit(0).select(dataset, sample, F.lit(0).alias("step"), F.lit("").alias("label"), F.lit(0).cast("long").alias("n"))
    by = counts.groupBy(dataset, sample, "step").agg(F.sum("n").alias("n_parent_cells"), F.map_from_entries(F.collect_list(F.struct("label", "n"))).alias("_n"))
    listed = F.array_union("categories", F.array(F.lit(UNASSIGNED)))
    n = lambda c: F.coalesce(F.try_element_at("_n", c), F.lit(0).cast("long"))
    per = F.map_from_entries(F.transform(listed, lambda c: F.struct(c.alias("k"), n(c).alias("v"))))
    share = F.map_from_entries(F.transform(listed, lambda c: F.struct(c.alias("k"), F.round(n(c) / F.col("n_parent_cells"), 4).alias("v"))))
    out = by.join(plan, "step")
    name = F.format_string("%s/%s/step_%02d", F.col(dataset).cast("string"), F.col(sample).cast("string"), F.col("step"))
    summary = F.struct("n_parent_cells", per.alias("n_cells_per_category"), share.alias("population_proportions"))
    return out.select(name.alias("task_id"), F.col(dataset).cast("string").alias("dataset"), F.col(sample).cast("string").alias("sample"), "step", "parent", "x_marker", "y_marker", "annotation_column", "categories", summary.alias("gt_summary"))


def write_tasks(docs: DataFrame, path: str, panel: Mapping) -> None:
    """Task documents by dataset, sample and step under ``tasks``, and the panel's own document."""
    at = docs.withColumns({f"in_{c}": F.col(c) for c in ("dataset", "sample", "step")})
    at.write.partitionBy("in_dataset", "in_sample", "in_step").json(f"{path}/tasks")
    write_document(docs.sparkSession, f"{path}/panel", dict(panel))


def registry(spark: SparkSession, path: str, datasets: Sequence[str] = (), scenarios: Sequence[str] = ()) -> DataFrame:
    """(hard_id, scenario, dataset, step, step_column, deplete) of registry files. An id that
    is given twice, or a scenario that isn't described, is an error."""
    docs = documents(spark, path)
    known = {k for d in docs for k in d.get("scenarios", {})}
    rows: dict[str, tuple] = {}
    for t in (t for d in docs for t in d["tasks"]):
        if t["hard_id"] in rows:
            raise ValueError(f"id given twice: {t['hard_id']!r}")
        if t["scenario"] not in known:
            raise ValueError(f"{t['hard_id']!r} is of unknown scenario {t['scenario']!r}; known: {sorted(known)}")
        rows[t["hard_id"]] = t["hard_id"], t["scenario"], t["dataset"], int(t["step"]), t["step_column"], list(t["deplete"])
    out = spark.createDataFrame(list(rows.values()), "hard_id string, scenario string, dataset string, step int, step_column string, deplete array<string>")
    out = out.where(F.col("dataset").isin(*datasets)) if datasets else out
    return out.where(F.col("scenario").isin(*scenarios)) if scenarios else out


def notes_of(spark: SparkSession, path: str, wanted: DataFrame, mode: str = "definition") -> DataFrame:
    """``wanted`` (dataset, step, ...) with its note from files (dataset -> step -> definition,
    oracle). mode: definition, or definition_oracle for both. A missing one is an error when read."""
    fields = {"definition": ("definition",), "definition_oracle": ("definition", "oracle")}[mode]
    rows = []
    for d in documents(spark, path):
        for cohort, steps in d.items():
            for step, entry in (steps or {}).items():
                parts = [str(entry.get(f) or "").strip() for f in fields]
                rows.append((cohort, int(step), "\n".join(parts) if all(parts) else None))
    n = spark.createDataFrame(rows, "dataset string, step int, note string")
    lost = F.raise_error(F.concat(F.lit(f"no {' and '.join(fields)} for "), "dataset", F.lit(", step "), F.col("step").cast("string")))
    return wanted.join(n, ["dataset", "step"], "left").withColumn("note", F.coalesce("note", lost))


def write_results(rows: DataFrame, root: str) -> None:
    """Result documents in folders scenario / dataset_stepNN / magnitude / dataset / sample / step_NN.
    rows: scenario, dataset, step, mode, magnitude, sample, task_step and the document's columns."""
    prefix = F.create_map(*(F.lit(x) for k, v in MODES.items() for x in (v, k)))[F.col("mode")]
    at = {
        "in_scenario": F.col("scenario"),
        "in_step": F.format_string("%s_step%02d", "dataset", "step"),
        "in_magnitude": F.concat(prefix, F.round(F.col("magnitude") * 100).cast("int").cast("string")),
        "in_dataset": F.col("dataset"),
        "in_sample": F.col("sample"),
        "in_task": F.format_string("step_%02d", "task_step"),
    }
    rows.withColumns(at).write.partitionBy(*at).json(root)


def result_tree(spark: SparkSession, root: str, pattern: str = "*.json") -> DataFrame:
    """(scenario, dataset, step, mode, magnitude, sample, task_step, path) of the result files
    under a root; files elsewhere are passed over."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root).select("path")
    at = rf"/{_K}([^/]+)/{_K}([^/]+)_step(\d+)/{_K}({'|'.join(MODES)})(\d+)/{_K}([^/]+)/{_K}([^/]+)/{_K}step_(\d+)/[^/]+$"
    part = lambda i: F.regexp_extract("path", at, i)
    mode = F.create_map(*(F.lit(x) for kv in MODES.items() for x in kv))[part(4)]
    return files.where(F.col("path").rlike(at)).select(part(1).alias("scenario"), part(6).alias("dataset"), part(3).cast("int").alias("step"), mode.alias("mode"), (part(5).cast("int") / 100).alias("magnitude"), part(7).alias("sample"), part(8).cast("int").alias("task_step"), "path")


def one_mode(tree: DataFrame) -> str:
    """The mode of a result tree; a tree of none or of several is an error."""
    modes = sorted(r[0] for r in tree.select("mode").distinct().collect())  # at most a row a mode
    if len(modes) != 1:
        raise ValueError(f"a tree has one mode, found: {modes}")
    return modes[0]


def outputs(tree: DataFrame, datasets: Sequence[str] = (), samples: Sequence[str] = ()) -> DataFrame:
    """(dataset, sample) that have results."""
    out = tree.select("dataset", "sample").distinct()
    out = out.where(F.col("dataset").isin(*datasets)) if datasets else out
    return out.where(F.col("sample").isin(*samples)) if samples else out


def threshold_files(spark: SparkSession, root: str) -> DataFrame:
    """(dataset, sample, step, x_thresholds, y_thresholds) of threshold files in folders
    dataset/sample/step_NN."""
    doc = spark.read.schema("x_thresholds array<double>, y_thresholds array<double>").option("recursiveFileLookup", "true").json(root)
    at = rf"/{_K}([^/]+)/{_K}([^/]+)/{_K}step_(\d+)/[^/]+$"
    part = lambda i: F.regexp_extract("_metadata.file_path", at, i)
    return doc.select(part(1).alias("dataset"), part(2).alias("sample"), part(3).cast("int").alias("step"), "x_thresholds", "y_thresholds")


def scan_capped(spark: SparkSession, paths: Iterable[str], columns: Sequence[str], key: str, cap: int | None = None, seed: int = 0) -> DataFrame:
    """Some columns of several sample tables, at most ``cap`` rows of each in seeded order, with
    ``source`` (the table's number). A table that isn't there is warned of and left out; no
    table at all is an error."""
    jvm, conf, out = spark._jvm, spark._jsc.hadoopConfiguration(), None
    for i, path in enumerate(paths):
        p = jvm.org.apache.hadoop.fs.Path(path)
        if not p.getFileSystem(conf).exists(p):
            warnings.warn(f"no sample table at {path}", stacklevel=2)
            continue
        rows = spark.read.parquet(path).select(*dict.fromkeys([key, *columns]))
        rows = (sample_exact(rows, cap, seed, key) if cap else rows).withColumn("source", F.lit(i))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    if out is None:
        raise ValueError("no sample table found")
    return out


def write_cohort(rows: DataFrame, sample: str, path: str, meta: Mapping) -> None:
    """A cohort folder: compressed CSV by sample, marker map, manifest and the metadata document.
    meta["channels"]: channel -> [marker, kind]."""
    spark = rows.sparkSession
    rows.write.partitionBy(sample).option("header", "true").option("compression", "gzip").csv(f"{path}/samples")
    markers = spark.createDataFrame([(c, v[0], v[1]) for c, v in meta["channels"].items()], "channel string, marker string, kind string")
    markers.coalesce(1).write.option("header", "true").csv(f"{path}/markers")
    manifest = rows.groupBy(sample).agg(F.count("*").alias("n_cells"))
    manifest.coalesce(1).write.option("header", "true").csv(f"{path}/manifest")
    write_document(spark, f"{path}/meta", dict(meta))


def read_cohort(spark: SparkSession, path: str, sample: str, head: int | None = None, others: Mapping[str, str] | None = None) -> DataFrame:
    """A cohort's rows with its channels as numbers, ``others`` by their types; of the first
    ``head`` samples in order, if given. The manifest names the samples."""
    channels = [r[0] for r in spark.read.option("header", "true").csv(f"{path}/markers").select("channel").collect()]
    files = spark.read.option("header", "true").option("inferSchema", "false").csv(f"{path}/samples")
    kinds = {c: "double" for c in channels} | dict(others or {})
    data = files.select(F.col(sample).cast("string").alias(sample), *(quoted(c).cast(kinds.get(c, "string")).alias(c) for c in files.columns if c != sample))
    manifest = spark.read.schema(f"`{sample}` string, n_cells long").option("header", "true").csv(f"{path}/manifest")
    manifest = manifest.orderBy(sample).limit(head) if head else manifest
    return data.join(manifest.select(sample), sample, "left_semi")


def write_parquet_cohort(rows: DataFrame, sample: str, path: str, meta: Mapping) -> None:
    """A cohort as zstd Parquet by sample, its channels as floats (half precision has no type
    here), label columns as they are, and the metadata document with what was stored how."""
    channels = set(meta["channels"])
    stored = rows.select(*(quoted(c).cast("float").alias(c) if c in channels else quoted(c) for c in rows.columns))
    stored.write.mode("overwrite").partitionBy(sample).option("compression", "zstd").parquet(f"{path}/cells")
    write_document(rows.sparkSession, f"{path}/meta", {**meta, "transform": {"dtype": "float32", "compression": "zstd", "sample": sample}})


def read_parquet_cohort(spark: SparkSession, path: str, channels: Sequence[str] | None = None) -> DataFrame:
    """The cells of such a cohort: sample (as text), then channels as doubles (those asked for), then labels."""
    meta = json.loads(spark.read.text(f"{path}/meta", wholetext=True).first()[0])
    sample, known = meta["transform"]["sample"], set(meta["channels"])
    cells = spark.read.parquet(f"{path}/cells")
    wanted = [c for c in cells.columns if c != sample and (c not in known or channels is None or c in channels)]
    return cells.select(quoted(sample).cast("string").alias(sample), *(quoted(c).cast("double").alias(c) if c in known else quoted(c) for c in wanted))


def append(rows: DataFrame, path: str) -> None:
    """Attempts added to a log; a reader sees whole appends only."""
    rows.write.mode("append").parquet(path)


def paired(gt: DataFrame, predictions: DataFrame, wanted: DataFrame, task: Sequence[str]) -> DataFrame:
    """gt (task, pos, ...) with ``pred`` at its place, for tasks whose prediction counts.

    predictions: (task, slug, predicted_labels); wanted: (task, slug), the perturbation that a
    task file was made with. A prediction of another perturbation, or of another number
    of rows than the task has, is passed over; see :func:`passed_over`."""
    ok = _guarded(gt, predictions, wanted, task).where("why is null")
    return gt.join(ok.select(*task, F.posexplode("predicted_labels").alias("pos", "pred")), [*task, "pos"])


def passed_over(gt: DataFrame, predictions: DataFrame, wanted: DataFrame, task: Sequence[str]) -> DataFrame:
    """(task, why) of the wanted tasks that have no prediction that counts."""
    return _guarded(gt, predictions, wanted, task).where("why is not null").select(*task, "why")


def _guarded(gt: DataFrame, predictions: DataFrame, wanted: DataFrame, task: Sequence[str]) -> DataFrame:
    size = gt.groupBy(*task).agg(F.count("*").alias("_n"))
    got = predictions.select(*task, F.col("slug").alias("_slug"), "predicted_labels")
    both = wanted.join(size, list(task), "left").join(got, list(task), "left")
    why: Column = F.when(F.col("predicted_labels").isNull(), "no prediction")
    why = why.when(~F.col("slug").eqNullSafe(F.col("_slug")), "other perturbation").when(F.size("predicted_labels") != F.coalesce("_n", F.lit(0)), "other length")
    return both.withColumn("why", why)
