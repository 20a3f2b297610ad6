"""Incremental gating of documents: new files are measured, gated step by step and scored.

    PYTHONPATH=. spark-submit jobs/gate_texts.py --documents DOCS --labels LABELS --config jobs/gate_texts.json --output OUT

DOCS is a folder (or a glob pattern) of Parquet files that grows. A file stream takes what its
checkpoint (OUT/checkpoint) has not seen, and ends when that is read. Each document is a point
of a few channels (words, characters a word, symbols, repeated lines) that built-in functions
measure on its whole text; the config's steps gate it inside the parent that earlier steps gave.

OUT/labelled (partitioned by batch and dataset) holds channels and labels of every document,
OUT/counts (by batch) how often each step gave which label to which reference label, and
OUT/metrics (by dataset) the metrics of all documents so far. A batch writes its own partitions
only, so a batch that runs again after a crash replaces what it left; metrics are made of the
counts, a few rows a batch. A run without new files changes no row.

A null text is an empty one; a null dataset is one of its own. Documents without a reference
label count as Unassigned. Rows that repeat a document are documents each; of the rows that
LABELS has of a document the least values count. LABELS is read anew by each batch: a label
that comes later than its document is not seen.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from jobs.common import columns_of, gates_of, log, main, read_config, write_partitions
from populace.functions.predicates import compile_predicate, quoted, reference_label
from populace.operators import metrics as M
from populace.plans.cascade import Step, cascade

SPACE = r"[\x20\x09-\x0D]+"
COUNTS = "step string, gt string, pred string, n long, dataset string, batch long"
METRICS = "step string, n_cells long, accuracy double, balanced_accuracy double, f1_macro double, f1_weighted double, proportion_error double, dataset string"


def channels(docs: DataFrame) -> DataFrame:
    """``docs`` (text) with its channels: n_words, word_length (characters a word),
    symbols (of ``#*$%&|<>`` in 1,000 characters) and repeated (share of lines equal to an earlier one)."""
    text = F.coalesce("text", F.lit(""))
    word_chars = F.length(F.regexp_replace(text, SPACE, "")).cast("double")
    n_words = F.size(F.array_remove(F.split(text, SPACE), "")).cast("long")
    n_symbols = F.length(text) - F.length(F.regexp_replace(text, r"[#*$%&|<>]", ""))
    lines = F.filter(F.split(text, "\n", -1), lambda s: s.rlike(r"[^\x20\x09-\x0D]"))
    part = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    measured = docs.withColumns({"n_words": n_words, "symbols": part(1000.0 * n_symbols, F.length(text)), "_lines": lines, "_chars": word_chars})
    measured = measured.withColumns({"word_length": part(F.col("_chars"), F.col("n_words")), "repeated": part((F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("double"), F.size("_lines"))})
    return measured.drop("_lines", "_chars")


def plan(config: dict) -> list[Step]:
    return [Step(s["column"], s["parent"], s["x"], s["y"], gates_of(s["gates"]), s["categories"]) for s in config["steps"]]


def label(docs: DataFrame, labels: DataFrame, config: dict) -> DataFrame:
    """Documents with channels, the labels of each step and their reference labels."""
    names = [s["column"] for s in config["steps"]]
    truth = {f"truth_{s['column']}": s["reference"] for s in config["steps"] if "reference" in s}
    known = labels.select("doc_id", *columns_of(truth)).groupBy("doc_id").agg(*(F.min(quoted(c)).alias(c) for c in truth))
    measured = channels(docs.select("doc_id", "text", *columns_of({"dataset": config["dataset"]})))
    gated = cascade(measured.drop("text"), plan(config), config.get("rule", "smallest"))
    return gated.join(known, "doc_id", "left").select("doc_id", "n_words", "word_length", "symbols", "repeated", *map(quoted, names), *map(quoted, truth), "dataset")


def counted(labelled: DataFrame, config: dict) -> DataFrame:
    """(step, gt, pred, n, batch, dataset) of the steps that have a reference."""
    each = []
    for s in config["steps"]:
        if "reference" in s:
            gt, pred = M.scored(reference_label(f"truth_{s['column']}"), quoted(s["column"]))
            inside = compile_predicate(s["parent"], labelled.columns)
            each.append(F.when(inside, F.struct(F.lit(s["column"]).alias("step"), gt.alias("gt"), pred.alias("pred"))))
    rows = labelled.select("batch", "dataset", F.explode(F.filter(F.array(*each), lambda o: o.isNotNull())).alias("o")).select("batch", "dataset", "o.*")
    return M.confusion(rows, ["batch", "dataset", "step"]).select("step", "gt", "pred", "n", "dataset", "batch")


def scored(counts: DataFrame, config: dict) -> DataFrame:
    """Metrics of all batches, by dataset and step."""
    null = F.lit("\0")
    task = ["dataset", "step"]
    sums = counts.withColumn("dataset", F.coalesce("dataset", null)).groupBy(*task, "gt", "pred").agg(F.sum("n").alias("n"))
    lists = F.create_map(*(x for s in config["steps"] for x in (F.lit(s["column"]), F.array(*map(F.lit, s["categories"])))))
    listed = sums.select(*task).distinct().select(*task, F.explode(F.element_at(lists, F.col("step"))).alias("label"))
    out = M.task_metrics(sums, listed, task).withColumn("dataset", F.nullif(F.col("dataset"), null))
    return out.select(*(c.split()[0] for c in METRICS.split(", ")))


def labelled_schema(config: dict) -> str:
    names = [s["column"] for s in config["steps"]] + [f"truth_{s['column']}" for s in config["steps"] if "reference" in s]
    return ", ".join(["doc_id long, n_words long, word_length double, symbols double, repeated double", *(f"`{n}` string" for n in names), "batch long, dataset string"])


def run(spark: SparkSession, documents: str, labels: str, config: str, output: str) -> tuple[DataFrame, DataFrame]:
    """Takes what is new to its end; gives all labelled documents and metrics so far."""
    settings = read_config(spark, config)
    known = spark.read.parquet(labels)
    stored = f"{output}/labelled"
    for name, schema, by in (("labelled", labelled_schema(settings), ["batch", "dataset"]), ("counts", COUNTS, ["batch"]), ("metrics", METRICS, ["dataset"])):
        write_partitions(spark.createDataFrame([], schema), f"{output}/{name}", by)  # adds no file; the folder is there from now on

    def take(batch: DataFrame, number: int) -> None:
        seen = Observation()
        rows = label(batch, known, settings).withColumn("batch", F.lit(number).cast("long")).observe(seen, F.count("*").alias("rows"))
        write_partitions(rows, stored, ["batch", "dataset"])
        # what was written is counted, not computed again
        again = spark.read.schema(labelled_schema(settings)).parquet(stored).where(F.col("batch") == number)
        write_partitions(counted(again, settings), f"{output}/counts", ["batch"])
        log.info("batch %s: wrote %s documents", number, seen.get["rows"])

    source = spark.readStream.schema("doc_id long, text string, lang string, source string").parquet(documents)
    query = source.writeStream.foreachBatch(take).option("checkpointLocation", f"{output}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    read = sum(p["numInputRows"] for p in query.recentProgress)
    log.info("read %s: %s new documents", documents, read)
    labelled = spark.read.schema(labelled_schema(settings)).parquet(stored)
    totals = Observation()
    metrics = scored(spark.read.schema(COUNTS).parquet(f"{output}/counts"), settings).observe(totals, F.count("*").alias("rows"))
    write_partitions(metrics, f"{output}/metrics", ["dataset"])
    log.info("wrote %s/metrics: %s rows", output, totals.get["rows"])
    return labelled, spark.read.schema(METRICS).parquet(f"{output}/metrics")


if __name__ == "__main__":
    main(__doc__, run, documents="folder or pattern of Parquet files", labels="Parquet table of reference labels", config="JSON file", output="folder of tables and checkpoint")
