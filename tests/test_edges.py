"""Rectangles on data values, and the joint fit on bins."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from populace.operators import edges as E
from populace.operators.geometry import Rectangles, fit_rectangles

NAMES = ["x_min", "x_max", "y_min", "y_max"]


def macro_f1(x, y, label, boxes, rest="rest"):
    said = np.full(len(x), rest, object)
    for k, (a, b, c, d) in boxes.items():
        said[(x >= a) & (x <= b) & (y >= c) & (y <= d)] = k
    f = []
    for k in sorted(set(label)):
        hit, true, pred = ((said == k) & (label == k)).sum(), (label == k).sum(), (said == k).sum()
        f.append(2 * hit / (true + pred) if true + pred else 0.0)
    return sum(f) / len(f)


def apart(boxes):
    return all(a[1] < b[0] or b[1] < a[0] or a[3] < b[2] or b[3] < a[2] for a, b in itertools.combinations(boxes.values(), 2))


def sample(seed, n=160, grid=True):
    rng = np.random.default_rng(seed)
    x, y = (rng.integers(0, 9, n).astype(float) if grid else rng.normal(4, 2, n) for _ in range(2))
    label = np.where(x + rng.normal(0, 1, n) > 5, "a", np.where(y + rng.normal(0, 1, n) > 5, "b", "rest")).astype(object)
    return x, y, label


START = {"a": (6.0, 7.0, 1.0, 6.0), "b": (1.0, 3.0, 6.0, 7.0)}


@pytest.fixture(scope="module")
def fitted(spark):
    """Three groups fitted at once: ties on a grid, real values, and one without a good start."""
    made = {"g": sample(0), "h": sample(1, grid=False), "i": sample(2)}
    rows = [(g, float(a), float(b), str(c)) for g, v in made.items() for a, b, c in zip(*v)]
    df = spark.createDataFrame([*rows, ("g", None, 1.0, "a"), (None, 1.0, 1.0, "a"), ("lonely", 1.0, 1.0, "a")], "grp string, x double, y double, label string").withColumn("hit", F.lit("clash"))
    boxes = {"g": START, "h": START, "i": {"a": (0.0, 2.0, 0.0, 2.0), "b": (5.0, 8.0, 0.0, 3.0)}}
    start = spark.createDataFrame([(g, k, *b) for g, v in boxes.items() for k, b in v.items()], "grp string, label string, x_min double, x_max double, y_min double, y_max double")
    out = {}
    for r in E.ascend(df, ["grp"], start, "rest").collect():
        out.setdefault(r["grp"], ({}, r["f1_macro"]))[0][r["label"]] = tuple(r[c] for c in NAMES)
    return made, boxes, out, df, start


def test_no_move_is_left(fitted):
    """Every position of every edge, tried one by one: none scores higher than where it ends."""
    made, boxes, out, *_ = fitted
    for g, (x, y, label) in made.items():
        ends, score = out[g]
        assert abs(score - macro_f1(x, y, label, ends)) < 1e-12 and apart(ends)
        assert score >= macro_f1(x, y, label, boxes[g]) - 1e-12
        for k, box in ends.items():
            tries = [{j: b for j, b in ends.items() if j != k}]
            for e in range(4):
                for v in np.unique(x if e < 2 else y):
                    new = [*box[:e], v, *box[e + 1 :]]
                    if new[0] <= new[1] and new[2] <= new[3]:
                        tries.append({**ends, k: tuple(new)})
            assert max(macro_f1(x, y, label, t) for t in tries if apart(t)) <= score + 1e-12
    assert "lonely" not in out


def test_all_positions_equal_brute_force(fitted):
    made, boxes, _, df, start = fitted
    points = E.counted_points(df, ["grp"])
    got = E.edge_scores(points, ["grp"], start, "rest", E.box_counts(points, ["grp"], start, "rest"), E._sums(points, ["grp"], "rest")).collect()
    seen = set()
    for r in got:
        x, y, label = made[r["grp"]]
        new = dict(boxes[r["grp"]])
        if r["edge"] == "gone":
            new.pop(r["label"])
        else:
            new[r["label"]] = tuple(r["value"] if c == r["edge"] else v for c, v in zip(NAMES, new[r["label"]]))
            seen.add((r["grp"], r["label"], r["edge"], r["value"]))
        assert apart(new) and abs(r["score"] - macro_f1(x, y, label, new)) < 1e-12
    for g, (x, y, _) in made.items():  # and none is missing that changes what is inside
        for k, box in boxes[g].items():
            other = next(b for j, b in boxes[g].items() if j != k)
            for v in np.unique(x[(y >= box[2]) & (y <= box[3]) & (x >= box[0])]):
                if apart({"a": (box[0], v, *box[2:]), "b": other}):
                    assert (g, k, "x_max", v) in seen


def test_bins_to_values(spark):
    rows = spark.createDataFrame([("g", 0.5, 3.0, 0, 3), ("g", 1.5, 2.0, 1, 2), ("g", 2.5, 9.0, 2, 9)], "grp string, x double, y double, xb int, yb int")
    boxes = spark.createDataFrame([("g", "a", 0, 2, 2, 4), ("g", "b", 5, 7, 0, 9)], "grp string, label string, x0 int, x1 int, y0 int, y1 int")
    assert [tuple(r) for r in E.binned_bounds(rows, ["grp"], boxes).collect()] == [("g", "a", 0.5, 1.5, 2.0, 3.0)]
    empty = E.ascend(rows.withColumn("label", F.lit("a")).limit(0), ["grp"], E.binned_bounds(rows, ["grp"], boxes), "rest")
    assert empty.count() == 0


def test_values_score_no_lower_than_bins(spark, sf):
    from populace.queries import analysis as A

    bins = {r["event_type"]: r["f1_macro"] for r in A.rect_oracle(spark, sf).collect()}
    exact = {r["event_type"]: r["f1_macro"] for r in A.rect_exact(spark, sf).collect()}
    assert set(bins) == set(exact) and all(exact[g] >= bins[g] - 1e-6 for g in bins) and any(exact[g] > bins[g] + 1e-6 for g in bins)


def best_of_all(grids, rest):
    """Two classes: every pair of boxes that don't meet, or fewer."""
    r = Rectangles(grids, rest)
    boxes = r.every_box()
    a, b = r.named
    best = max(float(r.scores({})[0]), float(r.scores({}, a, boxes).max()), float(r.scores({}, b, boxes).max()))
    for box in boxes:
        free = r.free(boxes, {a: tuple(box)}, b)
        if len(free):
            best = max(best, float(r.scores({a: tuple(box)}, b, free).max()))
    return best


@pytest.mark.parametrize("seed", range(8))
def test_beam_finds_the_best_pair(seed):
    grids = np.random.default_rng(seed).integers(0, 6, (3, 4, 4)) * (np.random.default_rng(seed + 50).random((3, 4, 4)) < 0.5)
    if (grids.sum((1, 2)) > 0).all():
        score, boxes = Rectangles(grids, 2).beam()
        assert abs(score - best_of_all(grids, 2)) < 1e-12
        assert abs(score - float(Rectangles(grids, 2).scores(boxes)[0])) < 1e-12


def test_joint_fit_is_never_below_the_plain_one():
    for seed in range(4):
        grids = np.random.default_rng(seed).poisson(2, (4, 24, 24))
        assert fit_rectangles(grids, 3, 4, joint=True)[0] >= fit_rectangles(grids, 3, 4)[0] - 1e-12
