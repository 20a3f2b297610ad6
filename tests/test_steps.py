"""Executor-driven cascades, bounded fan-out and polygons as rows."""

import json
import threading
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from populace.operators import polygons as P
from populace.operators import remote as R
from populace.operators.gates import Polygon, winner_order
from populace.plans import executor as X
from populace.plans.cascade import Step

STEPS = [Step("one", "ALL", "x", "y", options=("mid", "low")), Step("two", "one == mid", "y", "x", options=("mid", "low", "high")), Step("three", "two == nothing", "x", "y", options=("mid",))]
HOW = {"attempts": 1, "wait": 0}


def cells(spark):
    rng = np.random.default_rng(0)
    rows = [(i, "abc"[i % 3], float(a), float(b)) for i, (a, b) in enumerate(rng.normal(size=(300, 2)))]
    rows += [(300, "a", None, 1.0), (301, None, 0.0, 0.0), (302, "lonely", 5.0, None)]
    return spark.createDataFrame(rows, "id long, sample string, x double, y double").withColumn("key", F.lit("clash")).repartition(3)


def labels(df):
    return {r["id"]: (r["one"], r["two"], r["three"]) for r in df.collect()}


def thirds(spark, df):
    """The same cascade by hand."""
    rows = [r.asDict() for r in df.select("id", "sample", "x", "y").collect()]
    out = {r["id"]: ["Unassigned"] * 3 for r in rows}
    inside = rows
    for k, (v, options) in enumerate((("x", ("mid", "low")), ("y", ("mid", "low", "high")))):
        for s in {r["sample"] for r in inside} - {None}:
            own = [r for r in inside if r["sample"] == s]
            x, w = ([r[c] for r in own if r[c] is not None] for c in (v, "xy"[1 - k]))
            if not x or not w:
                continue
            a, third = min(x), (max(x) - min(x)) / 3
            b = max(x)
            spans = dict(zip(options, ((a + third, b - third), (a, a + third), (b - third, b))))
            for r in own:
                if r[v] is not None and r["xy"[1 - k]] is not None:
                    out[r["id"]][k] = next((c for c in reversed([*options]) if c != "mid" and spans[c][0] <= r[v] <= spans[c][1]), "mid" if spans["mid"][0] <= r[v] <= spans["mid"][1] else "Unassigned")
        inside = [r for r in rows if out[r["id"]][0] == "mid"]
    return {k: tuple(v) for k, v in out.items()}


def test_cascade_equals_steps_by_hand(spark, tmp_path):
    df = cells(spark)
    got = X.run_cascade(df, "id", "sample", STEPS, X.rule_of_thirds, str(tmp_path / "f"), cut_every=1, **HOW)
    assert got.columns == [*df.columns, "one", "two", "three"]
    assert labels(got) == thirds(spark, df)
    report = {(r["step"], r["sample"]): (r["n_parent"], r["n_labelled"]) for r in X.step_report(spark, str(tmp_path / "f")).collect()}
    assert report[1, "a"][0] == 101 and report[1, "lonely"] == (1, 0) and not any(s == 3 for s, _ in report)


def test_labels_of_a_step_are_found_once(spark, tmp_path):
    """The last step reads the cells with the labels before it; the given cells aren't gated again."""
    got = X.run_cascade(cells(spark), "id", "sample", STEPS, X.rule_of_thirds, str(tmp_path / "f"), **HOW)
    leaves = got._jdf.queryExecution().analyzed().collectLeaves()
    assert not any("RDD" in leaves.apply(i).nodeName() for i in range(leaves.size()))
    assert labels(got) == thirds(spark, cells(spark))


class Counting:
    """Writes down what it is asked, and stops at a step for a sample."""

    def __init__(self, log, stop=None):
        self.log, self.stop = str(log), stop

    def __call__(self, prompt):
        s = json.loads(prompt)
        if self.stop == s["step"]:
            raise RuntimeError("stopped")
        with open(self.log, "a") as f:
            f.write(f"{s['step']} {s['n']}\n")
        return X.rule_of_thirds(prompt)


def test_an_aborted_run_resumes_to_the_same_labels(spark, tmp_path):
    df, folder, log = cells(spark), str(tmp_path / "f"), tmp_path / "log"
    with pytest.raises(RuntimeError, match="calls failed"):
        X.run_cascade(df, "id", "sample", STEPS, Counting(log, stop=2), folder, **HOW)
    asked = log.read_text().split("\n")[:-1]
    assert len(asked) == 4 and X.step_report(spark, folder).where("step > 1").count() == 0
    got = labels(X.run_cascade(df, "id", "sample", STEPS, Counting(log), folder, **HOW))
    assert got == labels(X.run_cascade(df, "id", "sample", STEPS, X.rule_of_thirds, str(tmp_path / "whole"), **HOW))
    again = log.read_text().split("\n")[:-1]
    assert again[:4] == asked and all(a.startswith("2 ") for a in again[4:])  # the first step isn't asked again
    X.run_cascade(df, "id", "sample", STEPS, Counting(log, stop=1), folder, **HOW).count()
    assert log.read_text().split("\n")[:-1] == again  # a finished run asks nothing
    with pytest.raises(ValueError, match="another configuration"):
        X.run_cascade(df, "id", "sample", [Step("one", "ALL", "y", "x", options=("mid",))], X.rule_of_thirds, folder, **HOW)


def test_odd_answers(spark, tmp_path):
    df = cells(spark)
    ring = json.dumps([{"category": "poly", "vertices": [[-1, -1], [1, -1], [0, 1]]}, {"category": "unknown", "x_min": -9, "x_max": 9, "y_min": -9, "y_max": 9}, {"category": "flat", "vertices": [[0, 0], [1, 1]]}])
    one = [Step("one", "ALL", "x", "y", options=("poly", "flat"))]
    got = {r["id"]: r["one"] for r in X.run_cascade(df, "id", "sample", one, lambda p: ring, str(tmp_path / "a"), **HOW).collect()}
    inside = df.select("id", Polygon(((-1.0, -1.0), (1.0, -1.0), (0.0, 1.0))).contains(F.col("x"), F.col("y")).alias("hit")).collect()
    assert got == {r["id"]: "poly" if r["hit"] and r["id"] != 301 else "Unassigned" for r in inside}
    with pytest.raises(ValueError, match="no list of gates"):
        X.run_cascade(df, "id", "sample", one, lambda p: "sorry", str(tmp_path / "b"), **HOW)
    assert X.run_cascade(df.limit(0), "id", "sample", STEPS, X.rule_of_thirds, str(tmp_path / "c"), **HOW).count() == 0


def test_calls_in_flight(spark):
    """20 slow calls, 8 at once: three waits, not twenty; answers in the order of the rows."""
    rows = spark.createDataFrame([(str(i), None if i == 7 else f"p{i}") for i in range(20)], "key string, prompt string").coalesce(1)
    began = time.monotonic()
    got = R.calls(rows, lambda p: (time.sleep(0.8), p)[1], in_flight=8).collect()
    took = time.monotonic() - began
    assert [r["key"] for r in got] == [str(i) for i in range(20)] and got[7]["answer"] is None and took < 20 * 0.8 * 0.6
    peak = R.calls(rows, Peak(), in_flight=5).agg(F.max(F.col("answer").cast("int"))).first()[0]
    assert 1 < peak <= 5


class Peak:
    """Answers with the number of its calls that are open."""

    def __init__(self):
        self.open, self.lock = 0, None

    def __getstate__(self):
        return {}

    def __setstate__(self, _):
        self.open, self.lock = 0, threading.Lock()

    def __call__(self, prompt):
        with self.lock:
            self.open += 1
        time.sleep(0.05)
        with self.lock:
            now, self.open = self.open, self.open - 1
        return str(now)


def test_failures_and_cost_are_counted(spark):
    def service(prompt):
        if prompt == "bad":
            raise ValueError
        return prompt.upper(), 10, 3

    rows = spark.createDataFrame([("1", "a"), ("2", "bad"), ("3", "b")], "key string, prompt string")
    records = R.calls(rows, service, attempts=2, wait=0, in_flight=3)
    r = R.call_report(records, [], (1.0, 100.0)).first()
    assert (r["n_calls"], r["n_failed"], r["n_retries"], r["input_tokens"], r["output_tokens"]) == (3, 1, 1, 20, 6) and abs(r["cost"] - 620e-6) < 1e-12
    assert {x["status"] for x in records.collect()} == {"ok", "failed: ValueError"} and R.calls(rows.limit(0), service).count() == 0


def shapes(n, seed):
    """Stars, slivers and squares of many sizes, some alike, one across everything."""
    rng = np.random.default_rng(seed)
    out = [("all", 0, [[-50.0, -50.0], [50.0, -50.0], [50.0, 50.0], [-50.0, 50.0]])]
    for i in range(1, n):
        k, c, size = int(rng.integers(3, 9)), rng.uniform(-10, 10, 2), float(rng.choice([0.05, 0.4, 3.0]))
        a = np.sort(rng.uniform(0, 2 * np.pi, k))
        r = size * rng.uniform(0.2, 1, k)
        out.append((f"c{i % 40}", i, np.stack([c[0] + r * np.cos(a), c[1] + r * np.sin(a)], 1).tolist()))
    out += [("twin", n, out[1][2]), ("line", n + 1, [[0.0, 0.0], [1.0, 1.0]]), ("grid", n + 2, [[0.0, 0.0], [2.0, 0.0], [2.0, 2.0], [0.0, 2.0]])]
    return out


@pytest.mark.parametrize("n,block,size", [(60, 64, (1.0, 1.0)), (60, 3, (0.3, 2.0)), (1000, 64, (0.5, 0.5))])
def test_table_equals_compiled_polygons(spark, n, block, size):
    gates = shapes(n, n)
    rng = np.random.default_rng(1)
    pts = [(i, float(a), float(b)) for i, (a, b) in enumerate(rng.uniform(-11, 11, (400, 2)))] + [(400, 0.0, 0.0), (401, 2.0, 1.0), (402, 1.0, 2.0 + 1e-10), (403, None, 1.0), (404, 0.5, 2.0 + 1e-3)]
    points = spark.createDataFrame(pts, "id long, x double, y double")
    table = spark.createDataFrame(gates, "category string, ord long, vertices array<array<double>>")
    got = {r["id"]: r["label"] for r in P.assign_polygons(points, table, "id", *size, block=block).collect()}
    if n > 100:  # compiled expressions of a thousand polygons are too large: each by itself, in Python
        want = {i: by_hand(x, y, gates) for i, x, y in pts}
    else:
        whole = points
        label = F.lit("Unassigned")
        for c, g in reversed(winner_order({f"{c}#{o}": Polygon(tuple(map(tuple, v))) for c, o, v in gates if len(v) > 2})):
            label = F.when(g.contains(F.col("x"), F.col("y")), c.split("#")[0]).otherwise(label)
        want = {r["id"]: r["label"] for r in whole.select("id", label.alias("label")).collect()}
    assert got == want and got[403] == "Unassigned"


def by_hand(x, y, gates):
    best = None
    for c, o, v in gates:
        if x is None or len(v) < 3:
            continue
        ring = list(zip(v, v[1:] + v[:1]))
        odd = sum((y < a[1]) != (y < b[1]) and x < a[0] + (y - a[1]) * ((b[0] - a[0]) / (b[1] - a[1])) for a, b in ring) % 2
        near = min(distance(x, y, a, b) for a, b in ring) <= 1e-9
        area = abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in ring)) / 2
        if odd or near:
            best = min(filter(None, (best, (area, -o, c))))
    return best[2] if best else "Unassigned"


def distance(x, y, a, b):
    dx, dy = b[0] - a[0], b[1] - a[1]
    t = max(0.0, min(1.0, ((x - a[0]) * dx + (y - a[1]) * dy) / (dx * dx + dy * dy or 1.0)))
    return ((x - a[0] - t * dx) ** 2 + (y - a[1] - t * dy) ** 2) ** 0.5


def test_only_border_cells_test_edges(spark):
    table = spark.createDataFrame(shapes(2, 0)[:1], "category string, ord long, vertices array<array<double>>")
    cells = P.cover(table, 1.0, 1.0).groupBy("border").count().collect()
    n = {r["border"]: r["count"] for r in cells}
    assert n[False] > 9000 and n[True] < 900
    plan = P.assign_polygons(spark.range(5).select(F.col("id"), F.col("id").cast("double").alias("x"), F.lit(1.0).alias("y")), table, "id", 1.0, 1.0)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_a_point_meets_few_of_many_polygons(spark):
    """600 overlapping squares of 12 sizes: a cell keeps those that can win in it, not all that hold
    it, crowded cells are quartered, and the labels stay those of all polygons."""
    rng = np.random.default_rng(3)
    gates = []
    for i in range(600):
        (a, b), r = rng.integers(0, 256, 2) / 64, 0.5 + i % 12 / 4  # areas are exact, so equal ones tie
        gates.append((f"c{i}", i, [[float(x), float(y)] for x, y in ((a - r, b - r), (a + r, b - r), (a + r, b + r), (a - r, b + r))]))
    table = spark.createDataFrame(gates, "category string, ord long, vertices array<array<double>>")
    most = {name: t.groupBy(*(c for c in ("level", "gx", "gy") if c in t.columns)).count().agg(F.max("count")).first()[0] for name, t in (("all", P.cover(table, 1.0, 1.0)), ("left", P.nested_cover(table, 1.0, 1.0)))}
    assert most["all"] > 100 and most["left"] <= 30
    pts = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.uniform(-4, 8, (150, 2)))] + [(150, 1.0, 1.0), (151, 0.5, 0.25), (152, None, 0.0)]
    points = spark.createDataFrame(pts, "id long, x double, y double")
    want = {i: by_hand(x, y, gates) for i, x, y in pts}
    for levels, crowded in ((4, 4), (0, 4), (2, 0)):
        assert {r["id"]: r["label"] for r in P.assign_polygons(points, table, "id", 1.0, 1.0, levels=levels, crowded=crowded).collect()} == want
