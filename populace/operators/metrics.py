"""Confusion counts and what follows from them.

Everything starts from one map-side combined count by (task, reference, predicted);
later levels work on that small table. Task metrics are rounded to 4 places before
they are averaged; spreads over tasks are population deviations.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import UNASSIGNED

# fixed value: the label of a missing prediction
NOISE = "__noise__"


def scored(reference: Column, predicted: Column) -> tuple[Column, Column]:
    """Missing reference labels are a class of their own; missing predictions are always wrong."""
    return F.coalesce(F.nullif(reference, F.lit("")), F.lit(UNASSIGNED)), F.coalesce(predicted, F.lit(NOISE))


def confusion(rows: DataFrame, task: Sequence[str], gt: str = "gt", pred: str = "pred") -> DataFrame:
    return rows.groupBy(*task, F.col(gt).alias("gt"), F.col(pred).alias("pred")).agg(F.count("*").alias("n"))


def _safe(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def class_metrics(counts: DataFrame, task: Sequence[str]) -> DataFrame:
    """One row for each class seen as reference or prediction."""
    hit = F.when(F.col("gt") == F.col("pred"), F.col("n")).otherwise(0)
    sides = counts.select(*task, F.explode(F.array(F.struct(F.col("gt").alias("label"), F.col("n").alias("g"), F.lit(0).cast("long").alias("p"), hit.alias("h")), F.struct(F.col("pred").alias("label"), F.lit(0).cast("long").alias("g"), F.col("n").alias("p"), F.lit(0).cast("long").alias("h")))).alias("s"))
    by = sides.groupBy(*task, F.col("s.label").alias("label")).agg(F.sum("s.h").alias("tp"), F.sum("s.g").alias("n_gt"), F.sum("s.p").alias("n_pred"))
    precision, recall = _safe(F.col("tp"), F.col("n_pred")), _safe(F.col("tp"), F.col("n_gt"))
    f1 = _safe(2 * F.col("tp"), F.col("n_gt") + F.col("n_pred"))
    return by.select("*", precision.alias("precision"), recall.alias("recall"), f1.alias("f1"))


def task_metrics(counts: DataFrame, categories: DataFrame, task: Sequence[str]) -> DataFrame:
    """accuracy, balanced accuracy, macro and weighted F1, population-proportion error.

    categories: (task..., label), the listed classes; macro F1 and the proportion
    error are over them (a class that never occurs counts 0), balanced accuracy and
    weighted F1 over all reference labels with support."""
    per = class_metrics(counts, task)
    total = counts.groupBy(*task).agg(F.sum("n").alias("n_cells"), F.sum(F.when(F.col("gt") == F.col("pred"), F.col("n")).otherwise(0)).alias("n_right"))
    listed = categories.join(per, [*task, "label"], "left").join(total, list(task))
    gap = F.abs(F.coalesce("n_gt", F.lit(0)) / F.col("n_cells") - F.coalesce("n_pred", F.lit(0)) / F.col("n_cells"))
    macro = listed.groupBy(*task).agg(F.avg(F.coalesce("f1", F.lit(0.0))).alias("f1_macro"), F.avg(gap).alias("proportion_error"))
    seen = per.where("n_gt > 0").groupBy(*task).agg(F.avg("recall").alias("balanced_accuracy"), (F.sum(F.col("f1") * F.col("n_gt")) / F.sum("n_gt")).alias("f1_weighted"))
    out = total.join(seen, list(task)).join(macro, list(task))
    r4 = lambda c: F.round(c, 4)
    return out.select(*task, "n_cells", r4(F.col("n_right") / F.col("n_cells")).alias("accuracy"), r4("balanced_accuracy").alias("balanced_accuracy"), r4("f1_macro").alias("f1_macro"), r4("f1_weighted").alias("f1_weighted"), r4("proportion_error").alias("proportion_error"))


def observed_metrics(counts: DataFrame, task: Sequence[str]) -> DataFrame:
    """Task metrics over the labels that occur on either side."""
    seen = class_metrics(counts, task).select(*task, "label")
    return task_metrics(counts, seen, task).drop("proportion_error")


def depleted_split(per: DataFrame, task: Sequence[str], depleted: DataFrame) -> DataFrame:
    """Mean recall and hull overlap of a task's depleted categories and of their siblings.

    per: (task, label, recall, n_gt, iou), depleted: (task key..., label), joined on the columns
    that both have. Unassigned is neither; a category without reference rows has no recall,
    one without a hull no overlap. A task without a depleted category is left out."""
    key = [c for c in depleted.columns if c in task]
    marked = per.where(F.col("label") != UNASSIGNED).join(depleted.select(*key).distinct(), key, "left_semi")
    marked = marked.join(depleted.select(*key, "label", F.lit(True).alias("_d")), [*key, "label"], "left").withColumn("_d", F.coalesce("_d", F.lit(False)))
    recall = F.when(F.col("n_gt") > 0, F.col("recall"))
    means = [F.avg(F.when(F.col("_d") == side, v)).alias(f"{name}_{what}") for what, side in (("depleted", True), ("siblings", False)) for name, v in (("recall", recall), ("iou", F.col("iou")))]
    return marked.groupBy(*task).agg(F.count_if("_d").alias("n_depleted"), F.count_if(~F.col("_d")).alias("n_siblings"), *means)


METRICS = ("accuracy", "balanced_accuracy", "f1_macro", "f1_weighted", "proportion_error")


def rollup(tasks: DataFrame, grains: Sequence[Sequence[str]], metrics: Sequence[str] = METRICS, places: int = 4) -> DataFrame:
    """Means and deviations at several grains at once, by grouping sets."""
    columns = list(dict.fromkeys(c for g in grains for c in g))
    sets = [[F.col(c) for c in g] for g in grains]
    aggs = [F.count("*").alias("n_tasks"), F.sum("n_cells").alias("n_cells")]
    aggs += [x for m in metrics for x in (F.round(F.avg(m), places).alias(f"{m}_mean"), F.round(F.stddev_pop(m), places).alias(f"{m}_std"))]
    return tasks.groupingSets(sets, *(F.col(c) for c in columns)).agg(*aggs)


def pooled_f1(tp: Column, fp: Column, fn: Column) -> Column:
    """2tp / (2tp + fp + fn); undefined (NULL) where nothing occurs."""
    return F.try_divide(2 * tp, 2 * tp + fp + fn)


def majority(rows: DataFrame, cluster: Sequence[str], label: str, categories: Sequence[str]) -> DataFrame:
    """Each cluster's most frequent category, the first listed of equal ones; NULL
    where it holds none of them."""
    place = F.array_position(F.array(*(F.lit(c) for c in categories)), F.col(label))
    by = rows.groupBy(*cluster, F.col(label).alias("_label"), place.alias("_place")).agg(F.count("*").alias("_n"))
    best = F.max_by("_label", F.when(F.col("_place") > 0, F.struct(F.col("_n"), -F.col("_place"))))
    return by.groupBy(*cluster).agg(best.alias("category"))


def mode_of(rows: DataFrame, group: Sequence[str], column: str) -> DataFrame:
    """Most frequent value that isn't null, the lexically least of equal ones."""
    by = rows.where(F.col(column).isNotNull()).groupBy(*group, column).agg(F.count("*").alias("_n"))
    return by.groupBy(*group).agg(F.min_by(column, F.struct(-F.col("_n"), F.col(column))).alias("mode"))


def class_weights(rows: DataFrame, label: str) -> DataFrame:
    """n / (classes * count) for each class."""
    by = rows.groupBy(label).agg(F.count("*").alias("n_rows"))
    total, k = by.agg(F.sum("n_rows"), F.count("*")).first()
    return by.select(label, "n_rows", (F.lit(float(total or 0)) / (F.lit(max(k, 1)) * F.col("n_rows"))).alias("weight"))
