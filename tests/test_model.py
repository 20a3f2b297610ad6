"""Scores of a model kept as a table."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from populace.operators import model as N


def fixed(seed=0, dim=5):
    rng = np.random.default_rng(seed)
    return {"layer0.weight": rng.normal(size=(7, dim)), "layer0.bias": rng.normal(size=7), "layer1.weight": rng.normal(size=(4, 7)), "layer1.bias": rng.normal(size=4), "head.s.weight": rng.normal(size=(3, 4)), "head.s.bias": rng.normal(size=3), "head.t.weight": np.zeros((2, 4)), "head.t.bias": np.zeros(2)}


def test_equals_a_direct_pass(spark, tmp_path):
    model, path = fixed(), str(tmp_path / "m")
    N.save_model(spark, model, path)
    loaded = N.load_model(spark, path)
    assert all((loaded[k] == v).all() for k, v in model.items()) and set(loaded) == set(model)
    x = np.random.default_rng(1).normal(size=(300, 5))
    odd = [None, [1.0], [None] * 5, [float("nan")] * 5, [float("inf")] * 5, []]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(300 + i, v) for i, v in enumerate(odd)]
    df = spark.createDataFrame(rows, "id long, f array<double>").withColumn("step", F.lit("clash")).repartition(3)
    got = {(r["key"], r["step"]): (r["label"], r["probability"]) for r in N.score(df, "id", "f", loaded, {"s": "abc", "t": "xy"}).collect()}
    assert len(got) == 2 * len(rows)
    for i, v in enumerate(x):
        h = np.maximum(model["layer1.weight"] @ np.maximum(model["layer0.weight"] @ v + model["layer0.bias"], 0) + model["layer1.bias"], 0)
        z = model["head.s.weight"] @ h + model["head.s.bias"]
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        assert got[i, "s"][0] == "abc"[p.argmax()] and abs(got[i, "s"][1] - p.max()) < 1e-12
        assert got[i, "t"] == ("x", 0.5)  # the first of equal ones
    assert all(got[300 + i, s] == (None, None) for i in range(len(odd)) for s in "st")
    assert N.score(df.limit(0), "id", "f", loaded, {"s": "abc", "t": "xy"}).count() == 0


def test_one_scan_for_all_steps(spark, tmp_path):
    path = str(tmp_path / "x")
    spark.range(10).select("id", F.array(*[F.col("id") / (k + 1) for k in range(5)]).alias("f")).write.parquet(path)
    plan = N.score(spark.read.parquet(path), "id", "f", fixed(), {"s": "abc", "t": "xy"})._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1


def test_models_that_do_not_fit(spark, tmp_path):
    N.save_model(spark, fixed(), str(tmp_path / "m"))
    with pytest.raises(ValueError, match="more than"):
        N.load_model(spark, str(tmp_path / "m"), most=100)
    for name, shape in (("layer1.weight", (4, 6)), ("head.s.weight", (3, 9))):
        N.save_model(spark, {**fixed(), name: np.zeros(shape)}, str(tmp_path / "bad"))
        with pytest.raises(ValueError, match="fit"):
            N.load_model(spark, str(tmp_path / "bad"))
    with pytest.raises(ValueError, match="classes"):
        N.score(spark.range(1), "id", "id", fixed(), {"s": "ab", "t": "xy"})
