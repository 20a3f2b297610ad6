"""Robustness report: metrics of gates on a cohort as it is and under each perturbation.

    PYTHONPATH=. spark-submit jobs/robustness.py --cells CELLS --config jobs/robustness.json --output OUT

The config names the columns of the cells (SQL expressions: the unique ``row_id`` that seeded
choices go by, ``dataset``, ``sample``, channels and reference labels), the steps of the gating
plan (parent predicate, reference column, axes, categories, gates) and the variants, each a list
of perturbations. A task is a step of a sample. Its rows, one for each variant, hold the metrics
and how far macro F1 falls from the variant named by ``base``. OUT is partitioned by variant and
dataset; a run replaces the partitions it has rows of, so runs of the same input and config
leave the same rows, and so does a run after one that was killed.

Cells without a dataset or a sample make tasks of their own; a task without a cell in a
variant has no row there; an empty table of cells writes nothing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from jobs.common import columns_of, gates_of, log, main, read_config, write_partitions
from populace.functions.predicates import compile_predicate, quoted, reference_label
from populace.operators import metrics as M
from populace.operators.gates import assign
from populace.operators.perturb import parse_specs

TASK = ["variant", "dataset", "sample", "step"]
#: Steps whose outcomes are counted together.
TOGETHER = 4
SCHEMA = "sample string, step int, n_cells long, accuracy double, balanced_accuracy double, f1_macro double, f1_weighted double, proportion_error double, f1_macro_base double, f1_macro_drop double, variant string, dataset string"


def outcomes(cells: DataFrame, variant: str, steps: list[dict], rule: str) -> DataFrame:
    """(variant, dataset, sample, part, gt0, pred0, gt1...): each cell once for every part of the
    plan (TOGETHER steps), with null labels for the steps whose parent it isn't in."""
    each = []
    for s in steps:
        gt, pred = M.scored(reference_label(s["label"]), assign(quoted(s["x"]), quoted(s["y"]), gates_of(s["gates"]), s["categories"], rule))
        inside = compile_predicate(s["parent"], cells.columns)
        each.append((F.when(inside, gt), F.when(inside, pred)))
    none = (F.lit(None).cast("string"),) * 2
    parts = []
    for i in range(0, len(each), TOGETHER):
        own = each[i : i + TOGETHER]
        own += [none] * (min(TOGETHER, len(each)) - len(own))
        parts.append(F.struct(F.lit(i).alias("part"), *(c.alias(f"{name}{j}") for j, pair in enumerate(own) for c, name in zip(pair, ("gt", "pred")))))
    found = cells.select(F.lit(variant).alias("variant"), "dataset", "sample", F.explode(F.array(*parts)).alias("o") if len(parts) > 1 else parts[0].alias("o"))
    return found.select("variant", "dataset", "sample", "o.*")


def counted(cells: DataFrame, config: dict) -> DataFrame:
    """(task..., gt, pred, n): all variants are counted by one shuffle. Cells with equal outcomes
    in all steps of a part are counted first, then step by step."""
    steps, rule = config["steps"], config.get("rule", "smallest")
    rows = []
    for name, specs in config["variants"].items():
        _, change = parse_specs(specs)
        rows.append(outcomes(cells.transform(change) if change else cells, name, steps, rule))
    null = F.lit("\0")  # joins of the report take missing names as equal
    every = reduce(DataFrame.union, rows).withColumns({c: F.coalesce(F.col(c).cast("string"), null) for c in ("dataset", "sample")})
    alike = every.groupBy(*every.columns).agg(F.count("*").alias("n"))
    number = F.array(*(F.lit(s["step"]) for s in steps))
    each = F.array(*(F.struct(F.get(number, F.col("part") + j).alias("step"), F.col(f"gt{j}").alias("gt"), F.col(f"pred{j}").alias("pred")) for j in range(min(TOGETHER, len(steps)))))
    by_step = alike.select("variant", "dataset", "sample", "n", F.explode(each).alias("o")).where("o.gt is not null").select("variant", "dataset", "sample", "o.*", "n")
    return by_step.groupBy(*TASK, "gt", "pred").agg(F.sum("n").alias("n"))


def report(counts: DataFrame, config: dict) -> DataFrame:
    """The rows of the report. ``counts`` is read many times, so it should be kept."""
    steps, null = config["steps"], F.lit("\0")
    lists = F.create_map(*(x for s in steps for x in (F.lit(s["step"]), F.array(*map(F.lit, s["categories"])))))
    listed = counts.select(*TASK).distinct().select(*TASK, F.explode(F.element_at(lists, F.col("step"))).alias("label"))
    tasks = M.task_metrics(counts, listed, TASK)
    base = tasks.where(F.col("variant") == config["base"]).select(*TASK[1:], F.col("f1_macro").alias("f1_macro_base"))
    out = tasks.join(base, TASK[1:], "left").withColumn("f1_macro_drop", F.round(F.col("f1_macro_base") - F.col("f1_macro"), 4))
    return out.withColumns({c: F.nullif(F.col(c), null) for c in ("dataset", "sample")})


def run(spark: SparkSession, cells: str, config: str, output: str) -> DataFrame:
    settings = read_config(spark, config)
    table = spark.read.parquet(cells).select(*columns_of(settings["columns"]))
    written = Observation()
    counts = counted(table, settings).coalesce(8).persist()  # a few rows a task, read by every part of the report
    rows = report(counts, settings).observe(written, F.count("*").alias("rows"), F.count_if(F.col("variant") == settings["base"]).alias("base"), F.sum(F.when(F.col("variant") == settings["base"], F.col("n_cells"))).alias("cells"))
    write_partitions(rows.select(*(c.split()[0] for c in SCHEMA.split(", "))), output, ["variant", "dataset"])
    counts.unpersist()
    log.info("read %s: %s outcomes of %s tasks without a change", cells, written.get["cells"] or 0, written.get["base"])
    log.info("wrote %s: %s rows of %s variants", output, written.get["rows"], len(settings["variants"]))
    return spark.read.schema(SCHEMA).parquet(output)


if __name__ == "__main__":
    main(__doc__, run, cells="Parquet table of cells", config="JSON file", output="folder of the report")
