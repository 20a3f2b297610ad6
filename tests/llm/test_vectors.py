"""Vectors that share a direction: pivots, prefixes, pairs and recall."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from populace.llm import vectors


def shared_direction(n, common, seed=1, dim=64, topics=0):
    """Unit vectors of mean cosine ``common``, and partners of every 20th at cosine 0.9 to 0.97."""
    rng = np.random.default_rng(seed)
    u = rng.normal(size=(n, dim - 1)) + (rng.normal(size=(topics, dim - 1))[rng.integers(0, topics, n)] if topics else 0)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    k = n // 20
    c = (rng.uniform(0.9, 0.97, k) - common) / (1 - common)
    w = rng.normal(size=(k, dim - 1))
    w -= (w * u[:k]).sum(1, keepdims=True) * u[:k]
    w /= np.linalg.norm(w, axis=1, keepdims=True)
    rest = np.concatenate([u, u[:k] * c[:, None] + w * np.sqrt(1 - c**2)[:, None]])
    return np.hstack([np.full((len(rest), 1), math.sqrt(common)), rest * math.sqrt(1 - common)]), k


@pytest.mark.parametrize("topics", [0, 30])
@pytest.mark.parametrize("common", [0.0, 0.3, 0.6, 0.8])
def test_pairs_grow_slowly_and_links_are_found(common, topics):
    made = {}
    for n in (4_000, 32_000):
        x, k = shared_direction(n, common, topics=topics)
        wanted = vectors.pivot_count(len(x), 64)
        drawn = x[np.random.default_rng(0).permutation(len(x))[: vectors.DRAWN * wanted]]
        pivots, prefix = vectors.choose_pivots(drawn, wanted, 0.9, vectors.PREFIX)
        assert len(pivots) > 0.6 * wanted
        near = vectors.nearest_pivots(x, pivots, prefix)
        found = [np.intersect1d(near[i], near[n + i]).size >= vectors.SHARED for i in range(k)]
        assert np.mean(found) >= 0.9
        made[n] = (np.bincount(near.ravel()).astype(float) ** 2).sum() / 2
    assert made[32_000] < (1.7 if topics else 1.1) * made[4_000] * 8**1.5


@pytest.mark.parametrize("common", [0.6, 0.8])
def test_links_equal_brute_force_where_found(spark, common):
    x, _ = shared_direction(1_500, common, dim=32)
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>").withColumn("near", F.lit(0))
    got = np.array([r["n_links"] for r in vectors.link(df).orderBy("vec_id").collect()])
    alike = (x @ x.T >= 0.9) & ~np.eye(len(x), dtype=bool)
    assert (got <= alike.sum(1)).all() and got.sum() >= 0.9 * alike.sum() > 0


def test_one_direction_and_no_vectors():
    x = np.tile([[1.0, 0.0]], (20, 1))
    pivots, prefix = vectors.choose_pivots(x, 16, 0.9, 8)
    assert len(pivots) == prefix == 1 and vectors.choose_pivots(x[:0], 16, 0.9, 8)[0].size == 0
