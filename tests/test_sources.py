"""Sources, streaming and rendering on small files."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from populace.functions import render as R
from populace.operators import density as D
from populace.sources import dims
from populace.sources import files as S
from populace.streaming.incremental import windowed_counts


def test_scan_gives_place_and_labels(spark, tmp_path):
    for name, rows in (("s1", [(1.0, "a", "")]), ("s2", [(2.0, "b", "x"), (3.0, None, "nan|")])):
        spark.createDataFrame(rows, "`FSC-A` double, `Step01_a|b` string, `Step02 c` string").coalesce(1).write.parquet(str(tmp_path / name))
    c = S.scan_samples(spark, [str(tmp_path / "s1"), str(tmp_path / "s2")], renames={"x": "y"})
    assert c.columns == ["sample", "row_id", "FSC-A", "Step01_a|b", "Step02 c"]
    assert sorted((r["FSC-A"], r["row_id"], r["Step02 c"]) for r in c.collect()) == [(1.0, 0, None), (2.0, 0, "y"), (3.0, 1, "nan|")]
    plan = S.scan_samples(spark, str(tmp_path / "s1"), labels=["Step01_a|b"], channels=[])._jdf.queryExecution().executedPlan().toString()
    assert "FSC-A" not in plan and "Step02" not in plan


def test_tasks_and_channels_from_json(spark, tmp_path):
    for step, n in ((1, 10), (2, 3)):
        d = tmp_path / "ds" / "p" / f"step_{step:02d}"
        d.mkdir(parents=True)
        (d / "task.json").write_text(json.dumps({"task_id": f"t{step}", "dataset": "ds", "sample": "p", "step": step, "categories": ["a"], "gt_summary": {"n_parent_cells": n, "n_cells_per_category": {"a": n}}}))
    assert [r["task_id"] for r in S.read_tasks(spark, str(tmp_path / "ds"), ["ds"], [1, 2], 5).collect()] == ["t1"]
    (tmp_path / "meta.json").write_text(json.dumps({"cohort": "c", "cofactor": 5, "channels": {"x": ["CD3", "protein"], "y": ["FSC"]}}))
    assert {r["channel"]: r["kind"] for r in S.read_channels(spark, str(tmp_path / "meta.json")).collect()} == {"x": "protein", "y": "unknown"}
    (tmp_path / "th.json").write_text(json.dumps({"x_thresholds": [1.5], "y_thresholds": []}))
    assert S.thresholds(spark, str(tmp_path / "th.json")).first()["x_thresholds"] == [1.5]


def test_missing_notes_are_errors(spark):
    want = spark.createDataFrame([("d", 1)], "dataset string, step int")
    assert S.notes(spark, [("d", 1, "text", None)], want).first()["definition"] == "text"
    with pytest.raises(Exception, match="no note for d"):
        S.notes(spark, [("e", 1, "text", None)], want).collect()


def test_blacklist_wins(spark):
    s = dims.splits(spark, {"g": {"d": {"train": ["a", "b"], "dev": ["c"], "blacklist": ["b"]}}})
    assert {r["sample"] for r in dims.allowed_samples(s).collect()} == {"a", "c"}


def test_late_rows_are_dropped(spark, tmp_path):
    at = lambda h, m: dt.datetime(2024, 1, 1, h, m)
    for i, rows in enumerate(([(at(0, 10), "a"), (at(0, 50), "a")], [(at(9, 0), "b")], [(at(9, 1), "b")], [(at(0, 20), "late")], [(at(20, 0), "c")])):
        spark.createDataFrame(rows, "ts timestamp, k string").coalesce(1).write.parquet(str(tmp_path / "in" / str(i)))
    stream = spark.readStream.schema("ts timestamp, k string").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    q = windowed_counts(stream, "ts", "k").writeStream.format("memory").queryName("late_rows").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = {r["k"]: r["n"] for r in spark.table("late_rows").collect()}
    assert got.get("a") == 2 and "late" not in got


def test_bars_and_variants(spark):
    d = spark.createDataFrame([([0, 1, 8, 4],), ([0, 0],)], "c array<long>")
    assert [r[0] for r in d.select(R.density_bar(F.col("c"))).collect()] == [" .@=", "  "]
    one = spark.range(1)
    parts = {"context": F.lit("about"), "histogram": F.lit("bars"), "peaks": F.lit("CD4 and CD45")}
    text = lambda v, **k: one.select(R.prompt(parts, v, **k)).first()[0]
    assert "about" in text("full") and "about" not in text("no_desc") and "bars" not in text("no_hist") and "CD4" not in text("no_pv")
    assert text("anon", names={"CD4": "M1", "CD45": "M2"}).endswith("M1 and M2")


def test_degenerate_planes(spark):
    assert not D.usable(19, 9, 9) and not D.usable(50, 2, 9) and D.usable(20, 3, 3)
    d = spark.createDataFrame([("a", 1.0, float(i)) for i in range(30)] + [("b", float(i % 5), float(i)) for i in range(30)], "g string, x double, y double")
    assert dict(D.with_usable(d, ["g"], "x", "y").collect()) == {"a": False, "b": True}
    h = {(r["g"], r["bin"]): r["n"] for r in D.histogram(d, ["g"], "x", 4).collect()}
    assert h["a", 0] == 30 and h["a", 3] == 0 and sum(v for k, v in h.items() if k[0] == "b") == 30
    assert D.kde(d.where("g = 'a'"), "x").count() == 0
