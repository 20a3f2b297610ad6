"""The jobs: reruns, growing input, odd rows, a batch that runs again."""

import json
import os
import subprocess
import sys

from pyspark.sql import functions as F

from jobs import gate_texts, robustness

HERE = os.path.dirname(os.path.abspath(robustness.__file__))
DOCS = "doc_id long, text string, lang string, source string"


def rows(df):
    return sorted(map(str, df.collect()))


def files(folder):
    return sorted(os.path.relpath(os.path.join(d, f), folder) for d, _, fs in os.walk(folder) for f in fs if f.endswith(".parquet"))


def test_robustness_reruns_to_the_same_rows(spark, sf, tmp_path):
    out, config = str(tmp_path / "out"), f"{HERE}/robustness.json"
    once = rows(robustness.run(spark, f"{sf}/lineitem.parquet", config, out))
    written = files(out)
    assert rows(robustness.run(spark, f"{sf}/lineitem.parquet", config, out)) == once and len(files(out)) == len(written)
    assert {f.split("/")[0] for f in written} == {f"variant={v}" for v in ("as_is", "without_a", "half_r", "shifted")}


def test_robustness_odd_cells(spark, tmp_path):
    cells = [("1", None, "s", 1.0, 1.0, "a", None), ("2", "d", None, 2.0, None, "", "b"), ("2", "d", None, 2.0, None, "", "b"), ("3", "d", "s", 9.0, 9.0, "a", "b"), ("4", "d", "s", None, 1.0, None, None)]
    table, config = str(tmp_path / "cells"), tmp_path / "c.json"
    spark.createDataFrame(cells, "row_id string, dataset string, sample string, x double, y double, one string, gt string").write.parquet(table)
    config.write_text(json.dumps({
        "columns": {c: c for c in ("row_id", "dataset", "sample", "x", "y", "one", "gt")}, "base": "whole",
        "steps": [{"step": 1, "parent": "ALL", "label": "one", "x": "x", "y": "y", "categories": ["a"], "gates": {"a": [[0, 0], [5, 0], [5, 5], [0, 5]]}}, {"step": 2, "parent": "one == a", "label": "gt", "x": "x", "y": "y", "categories": ["b"], "gates": {}}],
        "variants": {"whole": [], "none": ["deplete one a"]},
    }))
    got = {(r["variant"], r["dataset"], r["sample"], r["step"]): r for r in robustness.run(spark, table, str(config), str(tmp_path / "out")).collect()}
    assert set(got) == {("whole", None, "s", 1), ("whole", None, "s", 2), ("whole", "d", None, 1), ("whole", "d", "s", 1), ("whole", "d", "s", 2), ("none", "d", None, 1), ("none", "d", "s", 1)}
    assert got["whole", None, "s", 1]["f1_macro"] == 1.0 and got["whole", "d", None, 1]["n_cells"] == 2
    drop = got["none", "d", "s", 1]
    assert (drop["n_cells"], drop["f1_macro"], drop["f1_macro_base"], drop["f1_macro_drop"]) == (1, 0.0, 0.0, 0.0)
    empty = str(tmp_path / "empty")
    spark.read.parquet(table).limit(0).write.parquet(empty)
    assert robustness.run(spark, empty, str(config), str(tmp_path / "none")).count() == 0


def test_texts_come_in_two_runs(spark, sf, tmp_path):
    """The second run takes the new files alone; both together are one run over all."""
    docs, config = spark.read.parquet(f"{sf}/documents.parquet"), f"{HERE}/gate_texts.json"
    grown, out, labels = str(tmp_path / "docs"), str(tmp_path / "out"), f"{sf}/labels.parquet"
    docs.where("doc_id < 120").repartition(2).write.parquet(grown)
    labelled, metrics = gate_texts.run(spark, grown, labels, config, out)
    first, files_first = rows(labelled), files(f"{out}/labelled")
    assert len(first) == docs.where("doc_id < 120").count() and metrics.count() > 0
    docs.where("doc_id >= 120").repartition(2).write.mode("append").parquet(grown)
    labelled, metrics = gate_texts.run(spark, grown, labels, config, out)
    assert set(first) < set(rows(labelled)) and labelled.count() == docs.count()
    assert set(files_first) < set(files(f"{out}/labelled"))  # what was there is as it was
    whole, whole_metrics = gate_texts.run(spark, f"{sf}/documents.parque[t]", labels, config, str(tmp_path / "whole"))
    assert rows(labelled.drop("batch")) == rows(whole.drop("batch")) and rows(metrics) == rows(whole_metrics)
    before = rows(labelled), rows(metrics), files(f"{out}/labelled")
    gate_texts.run(spark, grown, labels, config, out)  # nothing new
    again = [spark.read.schema(s).parquet(f"{out}/{n}") for n, s in (("labelled", labelled.schema), ("metrics", metrics.schema))]
    assert (rows(again[0]), rows(again[1]), files(f"{out}/labelled")) == before


def test_a_batch_that_runs_again_replaces_its_rows(spark, sf, tmp_path):
    """Without its commit a batch is taken again: the folder of commits is lost here."""
    grown, out, config = str(tmp_path / "docs"), str(tmp_path / "out"), f"{HERE}/gate_texts.json"
    spark.read.parquet(f"{sf}/documents.parquet").limit(50).write.parquet(grown)
    labelled, metrics = gate_texts.run(spark, grown, f"{sf}/labels.parquet", config, out)
    before = rows(labelled), rows(metrics)
    os.rename(f"{out}/checkpoint/commits", str(tmp_path / "lost"))
    labelled, metrics = gate_texts.run(spark, grown, f"{sf}/labels.parquet", config, out)
    assert (rows(labelled), rows(metrics)) == before


def test_odd_texts(spark, tmp_path):
    docs = [(1, None, "en", "s"), (2, "", None, "s"), (None, "a b\na b\n#", "en", None), (3, "word " * 50_000, "en", "s"), (3, "x", "en", "s")]
    spark.createDataFrame(docs, DOCS).withColumn("n_words", F.lit("clash")).write.parquet(str(tmp_path / "docs"))
    spark.createDataFrame([(3, 1, 0), (3, 0, 1), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels"))
    labelled, metrics = gate_texts.run(spark, str(tmp_path / "docs"), str(tmp_path / "labels"), f"{HERE}/gate_texts.json", str(tmp_path / "out"))
    got = sorted((str(r["doc_id"]), r["n_words"], r["word_length"], round(r["symbols"], 3), r["repeated"], r["dataset"], r["truth_Step02_symbol|repeat"]) for r in labelled.collect())
    assert got == [("1", 0, 0.0, 0.0, 0.0, "en", None), ("2", 0, 0.0, 0.0, 0.0, None, None), ("3", 1, 1.0, 0.0, 0.0, "en", "bad"), ("3", 50_000, 4.0, 0.0, 0.0, "en", "bad"), ("None", 5, 1.0, 111.111, 1 / 3, "en", None)]
    assert [r["step"] for r in metrics.collect()] == ["Step02_symbol|repeat", "Step03_word|symbol"]
    empty = str(tmp_path / "empty")
    spark.createDataFrame([], DOCS).write.parquet(empty)
    labelled, metrics = gate_texts.run(spark, empty, str(tmp_path / "labels"), f"{HERE}/gate_texts.json", str(tmp_path / "out2"))
    assert labelled.count() == metrics.count() == 0


def test_command_line(sf, tmp_path):
    """As a program of its own: makes a session, logs what it read and wrote, needs its paths."""
    call = [sys.executable, "-m", "jobs.robustness", "--cells", f"{sf}/lineitem.parquet", "--config", f"{HERE}/robustness.json"]
    root = os.path.dirname(HERE)
    assert subprocess.run(call, cwd=root, capture_output=True).returncode == 2
    done = subprocess.run([*call, "--output", str(tmp_path / "out")], cwd=root, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
    assert "read /" in done.stderr and "rows of 4 variants" in done.stderr and len(files(tmp_path / "out")) >= 12


def test_settings_are_left_as_they_were(spark, sf, tmp_path):
    before = dict(spark.conf.getAll)
    robustness.run(spark, f"{sf}/lineitem.parquet", f"{HERE}/robustness.json", str(tmp_path / "o"))
    assert dict(spark.conf.getAll) == before


def test_a_report_counts_the_cells_once(spark, sf, tmp_path):
    """Every part of the report reads the kept counts: cells are scanned when they are counted, and
    no more (before, each part of the report scanned them again). Plans of more steps than are
    counted together give the same rows."""
    settings = robustness.read_config(spark, f"{HERE}/robustness.json")
    cells = spark.read.parquet(f"{sf}/lineitem.parquet").select(*robustness.columns_of(settings["columns"]))
    counts = robustness.counted(cells, settings).persist()
    leaves = robustness.report(counts, settings)._jdf.queryExecution().optimizedPlan().collectLeaves()
    assert {leaves.apply(i).nodeName().split(" ")[0] for i in range(leaves.size())} == {"InMemoryRelation"}
    whole = sorted(map(str, counts.collect()))
    counts.unpersist()
    held, robustness.TOGETHER = robustness.TOGETHER, 1
    try:
        assert sorted(map(str, robustness.counted(cells, settings).collect())) == whole
    finally:
        robustness.TOGETHER = held
