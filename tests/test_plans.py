"""Plans for many rows against plain ones, rectangles, checkpointed calls, small files."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from populace.functions import predicates as P
from populace.functions import render as R
from populace.operators import assign as A
from populace.operators import density as D
from populace.operators import gates as G
from populace.operators import geometry as H
from populace.operators import remote
from populace.operators import windows as W
from populace.sources import tasks as K


@pytest.fixture(scope="module")
def values(spark):
    rng = np.random.default_rng(3)
    rows = [("a", float(v)) for v in rng.normal(size=700)] + [("b", 2.0)] * 300 + [("b", float(v)) for v in rng.integers(0, 5, 200)] + [("c", 1e6), ("c", None), ("c", float("nan"))] + [("c", float(v)) for v in rng.exponential(size=400)]
    return spark.createDataFrame(rows, "g string, v double")


def test_quantiles_by_narrowing(values):
    qs = (0.0, 0.01, 0.25, 0.5, 0.77, 0.99, 1.0)
    plain, narrowed = ({r["g"]: r["q"] for r in W.quantiles(values, ["g"], "v", qs, most).collect()} for most in (10_000, 20))
    by = values.toPandas().dropna().groupby("g")["v"]
    for g, v in by:
        assert np.allclose(plain[g], np.quantile(v, qs)) and np.allclose(narrowed[g], np.quantile(v, qs))


def test_rows_of_a_trim_stay_in_their_tasks(values):
    """A few boxes are sent to the rows; dealt by group, a group's rows would meet in one task."""
    got = H.trimmed(values, ["g"], "v", "v", 0.1, 0.9)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "Exchange hashpartitioning" not in plan
    by = values.toPandas().dropna().groupby("g")["v"]
    assert {g: n for g, n in got.groupBy("g").count().collect()} == {g: int(v.between(*np.quantile(v, (0.1, 0.9))).sum()) for g, v in by}


def test_running_counts_over_ranges(spark, values):
    got = W.running_counts(values.withColumn("label", F.lit("x")).dropna(), ["g"], "v", "label").toPandas()
    for _, d in got.groupby("g"):
        d = d.sort_values("v")
        assert (d["below"].to_numpy() == d["n"].cumsum().to_numpy()).all()
        assert (d["above"].to_numpy() == d["n"][::-1].cumsum()[::-1].to_numpy()).all()


def test_density_on_bins_is_close(values):
    d = values.where("g = 'a'")
    exact, binned = (np.array([r["density"] for r in D.kde(d, "v", 64, most=most).orderBy("i").collect()]) for most in (10_000, 10))
    assert np.abs(exact - binned).max() < 1e-6 * exact.max()


@pytest.mark.parametrize("sent", [0, 200_000])
def test_gate_table_sent_or_shuffled(spark, monkeypatch, sent):
    monkeypatch.setattr(G, "SENT_MAX", sent)
    rng = np.random.default_rng(0)
    g = [(f"g{i}", i, *map(float, (x, x + w, y, y + h))) for i, (x, y, w, h) in enumerate(rng.uniform(0, 4, (30, 4)))]
    pts = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.uniform(0, 8, (200, 2)))] + [(999, None, 1.0)]
    got = dict(G.assign_by_table(spark.createDataFrame(pts, "id int, x double, y double"), spark.createDataFrame(g, "category string, ord int, x_min double, x_max double, y_min double, y_max double"), "id", 1.0, 1.0).select("id", "label").collect())
    for i, x, y in pts:
        inside = [((b - a) * (d - c), -o, n) for n, o, a, b, c, d in g if x is not None and a <= x <= b and c <= y <= d]
        assert got[i] == (min(inside)[2] if inside else "Unassigned")


def test_nearest_votes_without_a_radius(spark):
    rng = np.random.default_rng(1)
    pts = [(i, float(x), float(y), "pq"[int(x > 3)]) for i, (x, y) in enumerate(rng.uniform(0, 6, (60, 2)))] + [(100 + i, 2.0, 2.0, "r") for i in range(5)]
    grid = [(i, float(x), float(y)) for i, (x, y) in enumerate([(0, 0), (2, 2), (50, 50), (5.5, 1)])]
    p = spark.createDataFrame(pts, "pid int, x double, y double, label string")
    got = dict(A.knn_vote(spark.createDataFrame(grid, "gid int, x double, y double"), p, 7, 0.1).collect())
    for gid, gx, gy in grid:
        near = sorted((np.sqrt((x - gx) ** 2 + (y - gy) ** 2), pid, lab) for pid, x, y, lab in pts)[:7]
        votes = {}
        for d, _, lab in near:
            votes[lab] = votes.get(lab, 0) + 1 / max(d, 1e-12)
        assert got[gid] == min(votes, key=lambda v: (-votes[v], v))
    few = dict(A.knn_vote(spark.createDataFrame(grid, "gid int, x double, y double"), p.where("pid < 3"), 7, 0.1).collect())
    assert len(few) == 4


def macro(grids, rest, boxes):
    """Macro-F1 by labelling every bin."""
    label = np.full(grids.shape[1:], rest)
    for k, (a, b, c, d) in boxes.items():
        assert (label[a:b, c:d] == rest).all(), "boxes overlap"
        label[a:b, c:d] = k
    f1 = []
    for k, g in enumerate(grids):
        tp, said, true = g[label == k].sum(), grids[:, label == k].sum(), g.sum()
        f1.append(2 * tp / (said + true) if said + true else 0.0)
    return float(np.mean(f1))


@pytest.mark.parametrize("seed", range(6))
def test_rectangles_score_and_never_overlap(seed):
    rng = np.random.default_rng(seed)
    grids = np.zeros((4, 12, 12))
    for k in range(3):
        x, y = rng.normal(rng.uniform(2, 10, 2), 1.2, (300, 2)).clip(0, 11.99).astype(int).T
        np.add.at(grids[k], (x, y), 1)
    grids[3] = rng.poisson(0.6, (12, 12))
    for joint in (False, True):
        score, boxes = H.fit_rectangles(grids, 3, joint=joint)
        assert abs(score - macro(grids, 3, boxes)) < 1e-12
    assert score >= H.fit_rectangles(grids, 3)[0] - 1e-12
    fine, boxes = H.fit_rectangles(grids, 3, 2)
    assert abs(fine - macro(grids, 3, boxes)) < 1e-12


def test_one_rectangle_is_the_best_of_all():
    rng = np.random.default_rng(5)
    grids = np.stack([rng.poisson(0.3, (6, 6)), rng.poisson(0.5, (6, 6))]).astype(float)
    grids[0, 1:4, 2:5] += 4
    best = max(macro(grids, 1, {0: (a, b, c, d)}) for a in range(6) for b in range(a + 1, 7) for c in range(6) for d in range(c + 1, 7))
    assert abs(H.fit_rectangles(grids, 1, joint=True)[0] - best) < 1e-12


def test_checkpointed_calls_resume(spark, tmp_path):
    rows = spark.createDataFrame([(str(i), f"p{i}") for i in range(40)], "key string, prompt string")

    def broken(p):
        if p.endswith("7"):
            raise OSError
        return "first " + p

    run = lambda fn, config={"model": "m"}, r=rows: remote.call_in_batches(r, fn, str(tmp_path / "c"), config, attempts=1)  # noqa: E731, B006
    with pytest.raises(RuntimeError, match="calls failed"):
        run(broken)
    with pytest.raises(ValueError, match="another configuration"):
        run(broken, {"model": "n"})
    with pytest.raises(ValueError, match="aren't asked for"):
        run(broken, r=rows.where("key > '5'"))
    with pytest.raises(ValueError, match="twice"):
        run(broken, r=rows.union(rows))
    got = dict(run(lambda p: "then " + p).select("key", "answer").collect())
    assert len(got) == 40 and got["7"] == "then p7" and "first " in " ".join(got.values())
    assert dict(run(broken).select("key", "answer").collect()) == got and not (tmp_path / "c" / "records").exists()


def test_registry_and_notes_errors(spark, tmp_path):
    task = {"hard_id": "a", "scenario": "s", "dataset": "d", "step": 1, "step_column": "c", "deplete": ["x"]}
    for name, doc, error in (("twice", {"scenarios": {"s": {}}, "tasks": [task, task]}, "twice"), ("unknown", {"scenarios": {}, "tasks": [task]}, "unknown scenario")):
        (tmp_path / f"{name}.yaml").write_text(json.dumps(doc))
        with pytest.raises(ValueError, match=error):
            K.registry(spark, str(tmp_path / f"{name}.yaml"))
    (tmp_path / "n.json").write_text(json.dumps({"d": {"1": {"definition": "what", "oracle": " "}}}))
    want = spark.createDataFrame([("d", 1)], "dataset string, step int")
    assert K.notes_of(spark, str(tmp_path / "n.json"), want).first()["note"] == "what"
    with pytest.raises(Exception, match="no definition and oracle for d, step 1"):
        K.notes_of(spark, str(tmp_path / "n.json"), want, "definition_oracle").collect()


def test_a_tree_has_one_mode(spark, tmp_path):
    for mag in ("frac50", "scale10"):
        d = tmp_path / mag / "s" / "ds_step03" / mag / "ds" / "p1" / "step_02"
        d.mkdir(parents=True)
        (d / "prediction.json").write_text("{}")
        (d.parent / "other.json").write_text("{}")
    tree = K.result_tree(spark, str(tmp_path / "frac50"), "prediction.json")
    assert [tuple(r)[:7] for r in tree.collect()] == [("s", "ds", 3, "depletion", 0.5, "p1", 2)] and K.one_mode(tree) == "depletion"
    with pytest.raises(ValueError, match="one mode"):
        K.one_mode(K.result_tree(spark, str(tmp_path)))


def test_scan_warns_of_missing_tables(spark, tmp_path):
    spark.range(30).withColumns({"x": F.col("id") * 2, "y": F.lit(0)}).write.parquet(str(tmp_path / "a"))
    with pytest.warns(UserWarning, match="no sample table"):
        out = K.scan_capped(spark, [str(tmp_path / "gone"), str(tmp_path / "a")], ["x"], "id", 7)
    assert out.columns == ["id", "x", "source"] and out.count() == 7 and {r["source"] for r in out.collect()} == {1}
    with pytest.raises(ValueError), pytest.warns(UserWarning):
        K.scan_capped(spark, [str(tmp_path / "gone")], ["x"], "id")


def test_gate_columns_and_bars(spark):
    cols = ["r__A", "r__A__n", "r__B__n", "plain"]
    assert [P.gate_column(cols, *a) for a in (("A",), ("n",), ("n", "__B__"), ("plain",), ("zz",))] == ["r__A", "r__A__n", "r__B__n", "plain", None]
    d = spark.createDataFrame([([0, 1, 8, 4],), ([0, 0],)], "c array<long>")
    assert [tuple(r) for r in d.select(R.block_bar(F.col("c")), R.block_bar(F.col("c"), "log")).collect()] == [(" ▂█▅", " ▃█▆"), ("▁▁", "▁▁")]


def test_clusters_need_a_shared_folder():
    from populace.plans.flagship import shared_folder

    class Far:
        class conf:
            get = staticmethod(lambda *a: None)

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_folder(Far)
