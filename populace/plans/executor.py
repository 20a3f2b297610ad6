"""A cascade whose gates come step by step from an executor that sees the predicted parent.

For each step and sample the rows that earlier labels put into the step's parent are
summarised by Spark, the summary goes to a function (a model, a service, a rule) on the
executors, and its gates label the rows before the next step begins. All samples of a
cohort take a step at once.

What has been done lies in a shared folder: the answers of each step, committed call by call
batch, and its labels. A run that was killed or aborted is called again with the same
arguments: finished steps are read, a step that was under way is asked only for the samples
without an answer. A failing call aborts the run, and no later step begins.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import UNASSIGNED, compile_predicate, quoted
from ..operators.polygons import area, edges, in_ring
from ..operators.remote import call_in_batches, exists
from .cascade import Step
from .flagship import cut_lineage, discard

#: Bins of a channel in a summary.
BINS = 16
GATES = "array<struct<category string, x_min double, x_max double, y_min double, y_max double, vertices array<array<double>>>>"


def summaries(inside: DataFrame, sample: str, step: Step, number: int) -> DataFrame:
    """(key, prompt): for each sample with rows in the parent a JSON document of the step, its
    categories, and of each channel the range and the counts of BINS equal bins. Rows that miss
    a channel's value are counted in n alone."""
    rows = inside.select(quoted(sample).cast("string").alias("key"), quoted(step.x).cast("double").alias("x"), quoted(step.y).cast("double").alias("y"))
    box = rows.groupBy("key").agg(F.count("*").alias("n"), *(f(c).alias(f"{c}_{n}") for c in "xy" for n, f in (("min", F.min), ("max", F.max))))
    low = lambda c: F.col(f"{c}_min")
    width = lambda c: F.col(f"{c}_max") - low(c)
    place = lambda c: F.coalesce(F.least(F.floor(F.try_divide(F.col(c) - low(c), width(c)) * BINS), F.lit(BINS - 1)), F.lit(0))
    # rows are counted by both bins at once, BINS^2 rows a sample at most, and then by each
    both = rows.join(box, "key").groupBy("key", *(F.when(F.col(c).isNotNull(), place(c)).alias(f"b{c}") for c in "xy")).agg(F.count("*").alias("k"))
    each = both.select("key", "k", F.explode(F.array(*(F.struct(F.lit(c).alias("c"), F.col(f"b{c}").alias("b")) for c in "xy"))).alias("e"))
    count = each.where("e.b is not null").groupBy("key", "e.c", "e.b").agg(F.sum("k").alias("k"))
    full = lambda c: F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda i: F.coalesce(F.element_at(F.col(f"m{c}"), i.cast("long")), F.lit(0)))
    maps = count.groupBy("key").agg(*(F.map_from_entries(F.collect_list(F.when(F.col("c") == c, F.struct("b", "k")))).alias(f"m{c}") for c in "xy"))
    shown = box.join(maps, "key", "left").select("key", F.struct(F.lit(number).alias("step"), F.lit(step.x).alias("x"), F.lit(step.y).alias("y"), F.array(*map(F.lit, step.options)).alias("options"), "n", "x_min", "x_max", "y_min", "y_max", full("x").alias("x_counts"), full("y").alias("y_counts")).alias("s"))
    return shown.select("key", F.to_json("s").alias("prompt"))


def winner(x: Column, y: Column, gates: Column) -> Column:
    """The category of the smallest gate of an array (see GATES; with area, o and ring) that holds
    the point, the later given of equal ones."""
    hit = F.filter(gates, lambda g: F.when(g["ring"].isNotNull(), in_ring(x, y, g["ring"])).otherwise(x.between(g["x_min"], g["x_max"]) & y.between(g["y_min"], g["y_max"])))
    return F.array_min(F.transform(hit, lambda g: F.struct(g["area"].alias("area"), g["o"].alias("o"), g["category"].alias("category"))))["category"]


def gates_of(answers: DataFrame, options: Sequence[str]) -> DataFrame:
    """(_key, _gates) from answers (key, answer); categories that aren't offered are left out.
    An answer that isn't a list of gates is an error."""
    parsed = answers.select(F.col("key").alias("_key"), F.from_json("answer", GATES).alias("g"))
    if bad := parsed.where("g is null").select("_key").limit(1).collect():
        raise ValueError(f"the answer for {bad[0][0]!r} is no list of gates")
    ring = lambda g: F.when(F.size(g["vertices"]) >= 3, edges(g["vertices"]))
    known = F.filter("g", lambda g: g["category"].isin(*options)) if options else F.col("g")
    sized = F.transform(known, lambda g, i: F.struct(g["category"].alias("category"), g["x_min"].alias("x_min"), g["x_max"].alias("x_max"), g["y_min"].alias("y_min"), g["y_max"].alias("y_max"), ring(g).alias("ring"), F.coalesce(area(ring(g)), (g["x_max"] - g["x_min"]) * (g["y_max"] - g["y_min"])).alias("area"), (-i).alias("o")))
    return parsed.select("_key", sized.alias("_gates"))


def run_cascade(cells: DataFrame, key: str, sample: str, steps: Sequence[Step], ask: Callable[[str], str], folder: str, cut_every: int = 5, **how) -> DataFrame:
    """``cells`` with every step's column.

    ask: from a summary (JSON, see :func:`summaries`) to a JSON list of gates: rectangles
    (category, x_min, x_max, y_min, y_max) or polygons (category, vertices). how: attempts, wait
    and in_flight of the calls. Labels are also written step by step to ``folder``/labels/step=N
    (key, sample, label) for the rows of the parent. A sample without rows in a parent isn't
    asked; a row without a sample, outside the parent or outside all gates is Unassigned. The cells
    are saved with the labels of each new step but the last, and every ``cut_every`` finished ones."""
    spark, held = cells.sparkSession, []
    for number, s in enumerate(steps, 1):
        plan = {"number": number, "column": s.column, "parent": s.parent, "x": s.x, "y": s.y, "options": list(s.options)}
        inside = compile_predicate(s.parent, cells.columns)
        at = f"{folder}/calls/step={number}"
        if exists(spark, f"{at}/result/_SUCCESS"):
            asked = None  # finished: its summary isn't needed again
        else:
            asked = cut_lineage(summaries(cells.where(inside & quoted(sample).isNotNull()), sample, s, number))
        try:
            answers = call_in_batches(asked, ask, at, plan, spark=spark, **how)
        except Exception:
            discard(*held)
            raise
        gates = gates_of(answers, s.options)
        # a row for each sample with gates: sent where Spark finds it small
        cells = cells.join(gates, quoted(sample).cast("string") == F.col("_key"), "left")
        label = F.when(compile_predicate(s.parent, cells.columns), F.coalesce(winner(quoted(s.x).cast("double"), quoted(s.y).cast("double"), F.col("_gates")), F.lit(UNASSIGNED)))
        cells = cells.withColumn(s.column, F.coalesce(label, F.lit(UNASSIGNED))).drop("_key", "_gates")
        done = f"{folder}/labels/step={number}"
        fresh = not exists(spark, f"{done}/_SUCCESS")
        if number < len(steps) and (fresh or (cut_every and number % cut_every == 0)):
            # a new step's labels are found once: all that follows reads them with the cells
            cells = cut_lineage(cells)
            discard(*held)
            held = [cells]
        if fresh:
            cells.where(compile_predicate(s.parent, cells.columns)).select(quoted(key).alias("key"), quoted(sample).cast("string").alias("sample"), quoted(s.column).alias("label")).write.mode("overwrite").parquet(done)
        if asked is not None:
            discard(asked)
    return cells


def step_report(spark, folder: str) -> DataFrame:
    """(step, sample, n_parent, n_labelled) of the steps that are done."""
    t = spark.read.schema("key string, sample string, label string, step int").parquet(f"{folder}/labels")
    return t.groupBy("step", "sample").agg(F.count("*").alias("n_parent"), F.count_if(F.col("label") != UNASSIGNED).alias("n_labelled"))


def rule_of_thirds(prompt: str) -> str:
    """An executor for tests and trials: the middle third of the parent's extent on the first
    axis for the first category, the rest for the others in order."""
    s = json.loads(prompt)
    if not s["options"] or s.get("x_min") is None or s.get("y_min") is None:
        return "[]"
    third = (s["x_max"] - s["x_min"]) / 3
    cuts = [(s["x_min"] + third, s["x_max"] - third), (s["x_min"], s["x_min"] + third), (s["x_max"] - third, s["x_max"])]
    return json.dumps([{"category": c, "x_min": a, "x_max": b, "y_min": s["y_min"], "y_max": s["y_max"]} for c, (a, b) in zip(s["options"], cuts)])
