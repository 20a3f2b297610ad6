"""Exact nearest fitted points and Ward's clusters of all of them."""

import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from populace.operators import cluster as C
from populace.operators.nearest import LEAF, NearestIndex, nearest_point, spread_labels


def every_pair(rows, points):
    d = np.zeros((len(rows), len(points)))
    for c in range(points.shape[1]):
        d += (rows[:, c][:, None] - points[:, c]) ** 2
    return d.argmin(1), d.min(1)


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 400), st.integers(1, 4), st.booleans())
def test_equals_every_pair(seed, n, dim, grid):
    """On a grid of few values most distances tie and most points repeat."""
    rng = np.random.default_rng(seed)
    draw = (lambda m: rng.integers(0, 6, (m, dim)).astype(float)) if grid else (lambda m: rng.normal(size=(m, dim)))
    points, rows = draw(n), draw(200)
    at, d = NearestIndex(points).find(rows)
    want, least = every_pair(rows, points)
    assert (at == want).all() and (d == least).all()


def test_crowds_far_rows_and_missing_values():
    points = np.concatenate([np.zeros((5 * LEAF, 2)), np.random.default_rng(0).normal(5, 1e-9, (500, 2)), [[1e6, -1e6]]])
    rows = np.array([[0.1, 0], [5, 5], [1e9, -1e9], [np.nan, 0], [np.inf, 1]])
    at, _ = NearestIndex(points).find(rows)
    assert at[0] == 0 and at[2] == len(points) - 1 and at[3] == at[4] == -1 and at[1] == every_pair(rows[1:2], points)[0][0]
    assert NearestIndex(points).find(np.empty((0, 2)))[0].size == 0
    for bad in (np.empty((0, 2)), np.array([[np.nan, 1.0]])):
        with pytest.raises(ValueError):
            NearestIndex(bad)


def test_few_points_of_the_tree_are_met():
    rng = np.random.default_rng(1)
    points, rows = rng.normal(size=(10_000, 2)), rng.normal(size=(20_000, 2))
    index, met = NearestIndex(points), []
    leaf = index._leaf
    index._leaf = lambda r, own, members, *a: (met.append(own.size * len(members)), leaf(r, own, members, *a))
    index.find(rows)
    assert sum(met) < 0.02 * points.size / 2 * len(rows)


def test_labels_spread_to_all_rows(spark):
    rng = np.random.default_rng(2)
    points, rows = rng.normal(size=(300, 3)), rng.normal(size=(1000, 3))
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(rows)] + [(1000, None, 1.0, 2.0)], "id long, a double, b double, c double").repartition(3)
    labels = rng.integers(0, 5, 300)
    got = {r["id"]: r["slot"] for r in spread_labels(df, ["a", "b", "c"], points, labels).collect()}
    want, _ = every_pair(rows, points)
    assert got == {**{i: int(labels[w]) for i, w in enumerate(want)}, 1000: None}
    assert df.limit(0).select(nearest_point(spark, [F.col("a"), F.col("b"), F.col("c")], points)).count() == 0


@pytest.mark.parametrize("seed,n,k", [(0, 500, 6), (1, 300, 2), (2, 40, 1), (3, 5, 9), (4, 200, 60)])
def test_ward_chain_equals_the_greedy_method(seed, n, k):
    x = np.random.default_rng(seed).normal(size=(n, 2)) * [1, 4] + np.random.default_rng(seed + 9).integers(0, 4, (n, 1)) * 3
    assert (C.ward(x, k) == C.agglomerate(x, k, "ward")).all()


def test_ward_of_repeated_points_and_of_many():
    x = np.repeat([[0.0, 0], [10, 0], [0, 10]], 30, axis=0)
    assert C.ward(x, 3).tolist() == [0] * 30 + [1] * 30 + [2] * 30
    many = np.random.default_rng(5).normal(size=(10_000, 2)) + np.random.default_rng(6).integers(0, 3, (10_000, 1)) * 20
    began = time.monotonic()
    assert sorted(np.bincount(C.ward(many, 3)).tolist()) == sorted(np.bincount(np.round(many.mean(1) / 20).clip(0, 2).astype(int)).tolist())
    assert time.monotonic() - began < 60


def test_ward_query_takes_labels_from_fitted_points(spark):
    rng = np.random.default_rng(7)
    rows = [(i, *map(float, rng.normal(10 * (i % 3), 1, 2))) for i in range(900)]
    df = spark.createDataFrame(rows, "event_id long, x double, y double")
    got = {r["event_id"]: r["slot"] for r in C.cluster_plane(df, ["x", "y"], "event_id", "ward", 3, limit=200).collect()}
    assert len({got[i] for i in range(3)}) == 3 and all(got[i] == got[i % 3] for i in range(900))


def test_plane_ward_whole_query(spark, sf):
    """The registered query against the greedy method on all fitted points and every pair."""
    from populace.queries import analysis
    from populace.queries.base import ev

    rows = np.array([[r["x"], r["y"]] for r in ev(spark, sf).orderBy("event_id").collect()])
    fitted = C.fit_sample(ev(spark, sf), ["x", "y"], "event_id")
    labels = C.agglomerate(fitted, 6, "ward")
    near, _ = every_pair(rows, fitted)
    want = np.bincount(labels[near], minlength=6).tolist()
    got = {r["slot"]: r["n"] for r in analysis.plane_ward(spark, sf).collect()}
    assert [got[i] for i in range(6)] == want
