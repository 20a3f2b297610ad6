"""Clusterings fitted on a bounded seeded sample and applied to every row.

Fitting takes at most ``limit`` rows (seeded, exact); the model is a codebook of a
few rows that becomes one column expression (for flowsom a pandas function), or the
fitted points themselves in a tree (ward), so assignment is a projection.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .assign import nearest
from .nearest import spread_labels
from .perturb import sample_exact

LIMIT = 10_000


def fit_sample(rows: DataFrame, columns: Sequence[str], key: str, limit: int = LIMIT, seed: int = 42) -> np.ndarray:
    got = sample_exact(rows.select(key, *columns).dropna(subset=list(columns)), limit, seed, key).collect()
    return np.array([[r[c] for c in columns] for r in sorted(got, key=lambda r: r[key])], float).reshape(-1, len(columns))


def kmeans(x: np.ndarray, k: int, rounds: int = 50) -> np.ndarray:
    """Lloyd's iterations from farthest-point starts: deterministic."""
    centers = [x[np.argmin(((x - x.mean(0)) ** 2).sum(1))]]
    while len(centers) < min(k, len(np.unique(x, axis=0))):
        d = np.min([((x - c) ** 2).sum(1) for c in centers], axis=0)
        centers.append(x[np.argmax(d)])
    c = np.array(centers)
    for _ in range(rounds):
        near = np.argmin(((x[:, None] - c) ** 2).sum(2), 1)
        new = np.array([x[near == i].mean(0) if (near == i).any() else c[i] for i in range(len(c))])
        if np.allclose(new, c):
            break
        c = new
    return c


def som(x: np.ndarray, side: int = 10, rounds: int = 10_000, sigma: float = 1.0, rate: float = 0.5, seed: int = 42) -> np.ndarray:
    """Self-organising map: side * side nodes, Gaussian neighbourhood, both the rate
    and the width falling as 1 / (1 + t / (rounds / 2))."""
    rng = np.random.default_rng(seed)
    w = x[rng.integers(0, len(x), side * side)].copy()
    at = np.stack(np.meshgrid(np.arange(side), np.arange(side), indexing="ij"), -1).reshape(-1, 2)
    for t in range(rounds):
        v = x[rng.integers(len(x))]
        best = np.argmin(((w - v) ** 2).sum(1))
        fall = 1 / (1 + t / (rounds / 2))
        near = np.exp(-((at - at[best]) ** 2).sum(1) / (2 * (sigma * fall) ** 2))
        w += (rate * fall * near)[:, None] * (v - w)
    return w


def agglomerate(points: np.ndarray, k: int, linkage: str = "average", sizes: np.ndarray | None = None) -> np.ndarray:
    """Labels 0..k-1 (by first member) of bottom-up clusters; identity where k reaches the
    number of points. linkage: average, or ward. sizes: the rows that each point stands for."""
    n = len(points)
    if k >= n:
        return np.arange(n)
    groups = {i: [i] for i in range(n)}
    size = np.ones(n) if sizes is None else np.asarray(sizes, float).copy()
    d = ((points[:, None] - points) ** 2).sum(2)
    if linkage == "ward":  # the rise of the sum of squares, twice
        d = 2 * d * size[:, None] * size / (size[:, None] + size)
    else:
        d = np.sqrt(d)
    np.fill_diagonal(d, np.inf)
    while len(groups) > k:
        i, j = sorted(np.unravel_index(np.argmin(d), d.shape))
        a, b = size[i], size[j]
        if linkage == "ward":
            new = ((a + size) * d[i] + (b + size) * d[j] - size * d[i, j]) / (a + b + size)
        else:
            new = (a * d[i] + b * d[j]) / (a + b)
        new[[i, j]] = np.inf
        new[~np.isfinite(d[i]) | ~np.isfinite(d[j])] = np.inf
        groups[i] += groups.pop(j)
        size[i] = a + b
        d[i], d[:, i] = new, new
        d[j], d[:, j] = np.inf, np.inf
    out = np.empty(n, int)
    for label, members in enumerate(sorted(groups.values(), key=min)):
        out[members] = label
    return out


def ward(points: np.ndarray, k: int) -> np.ndarray:
    """Labels 0..k-1 (by first member) of Ward's clusters of all points, in memory linear in them.

    A chain goes from a cluster to its nearest one until two are each other's nearest, which are
    joined; distances come from centres and sizes, so no matrix is kept. Ward's distances are
    reducible: the joins of the chain, put in order of height, are those of the greedy method."""
    x = np.asarray(points, float)
    n = len(x)
    if k >= n:
        return np.arange(n)
    centre, size, alive, name = x.copy(), np.ones(n), np.ones(n, bool), np.arange(n)
    joins: list[tuple[float, int, int]] = []
    chain: list[int] = []
    while len(joins) < n - 1:
        if not chain:
            chain = [int(np.flatnonzero(alive)[0])]
        i = chain[-1]
        d = ((centre - centre[i]) ** 2).sum(1) * (2 * size * size[i] / (size + size[i]))
        d[~alive] = np.inf
        d[i] = np.inf
        j = int(d.argmin())
        if len(chain) > 1 and d[chain[-2]] <= d[j]:
            j = chain[-2]  # each other's nearest
            chain = chain[:-2]
            joins.append((float(d[j]), int(name[i]), int(name[j])))
            low, high = sorted((i, j))
            total = size[i] + size[j]
            centre[low] = (size[i] * centre[i] + size[j] * centre[j]) / total
            size[low], alive[high] = total, False
            name[low] = min(name[i], name[j])
        else:
            chain.append(j)
    up = np.arange(n)

    def root(i):
        while up[i] != i:
            up[i] = i = up[up[i]]
        return i

    for _, a, b in sorted(joins, key=lambda j: j[0])[: n - k]:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    _, out = np.unique([root(i) for i in range(n)], return_inverse=True)
    return out


def gaussian_mixture(x: np.ndarray, k: int, rounds: int = 100) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(weights, means, variances) of diagonal components by expectation maximisation."""
    mean = kmeans(x, k)
    var = np.tile(x.var(0) + 1e-6, (len(mean), 1))
    weight = np.full(len(mean), 1 / len(mean))
    for _ in range(rounds):
        log = np.log(weight) - 0.5 * (((x[:, None] - mean) ** 2) / var + np.log(2 * np.pi * var)).sum(2)
        p = np.exp(log - log.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        n = p.sum(0) + 1e-12
        new = (p.T @ x) / n[:, None]
        var = np.maximum((p.T @ x**2) / n[:, None] - new**2, 1e-6)
        weight = n / n.sum()
        if np.allclose(new, mean):
            break
        mean = new
    return weight, mean, var


def assign_mixture(columns: Sequence[str], weight: np.ndarray, mean: np.ndarray, var: np.ndarray):
    """Number of the likeliest component, as a column."""
    options = []
    for i, (w, m, v) in enumerate(zip(weight, mean, var)):
        cost = sum(((F.col(c) - float(a)) * (F.col(c) - float(a)) / float(b) for c, a, b in zip(columns, m, v)), F.lit(float(np.log(v).sum() - 2 * np.log(w))))
        options.append(F.struct(cost.alias("d"), F.lit(i).alias("node")))
    return F.array_min(F.array(*options))["node"]


def cluster_plane(rows: DataFrame, columns: Sequence[str], key: str, method: str = "kmeans", k: int = 8, limit: int = LIMIT, seed: int = 42) -> DataFrame:
    """rows with ``slot``. method: kmeans, ward, gmm or som. ward joins the fitted points
    themselves; a row's cluster is that of the fitted point nearest to it."""
    x = fit_sample(rows, columns, key, limit, seed)
    if not len(x):
        return rows.withColumn("slot", F.lit(None).cast("int"))
    if method == "gmm":
        return rows.withColumn("slot", assign_mixture(columns, *gaussian_mixture(x, k)))
    if method == "ward":
        return spread_labels(rows, columns, x, ward(x, k))
    fine = kmeans(x, k) if method == "kmeans" else som(x, max(2, round(k**0.5)))
    groups = np.arange(len(fine))
    book = [(int(g), tuple(map(float, w))) for g, w in zip(groups, fine)]
    return rows.withColumn("slot", nearest([F.col(c) for c in columns], book))


def flowsom(rows: DataFrame, columns: Sequence[str], key: str, k: int, side: int = 10, rounds: int = 30_000, limit: int = LIMIT, seed: int = 42) -> DataFrame:
    """A map of side * side nodes, its nodes joined to k clusters by average linkage,
    and each row in its nearest node's cluster (dense ids)."""
    x = fit_sample(rows, columns, key, limit, seed)
    w = som(x, side, rounds, seed=seed)
    groups = agglomerate(w, k)

    @F.pandas_udf("int")
    def slot(points: pd.Series) -> pd.Series:
        # node by node, the same order of sums and the first of equal ones as in nearest()
        p = np.array([np.asarray(v, float) for v in points]).reshape(-1, w.shape[1])
        return pd.Series(groups[np.argmin(np.stack([((p - v) ** 2).sum(1) for v in w], 1), axis=1)].astype("int32"))

    return rows.withColumn("slot", slot(F.array(*(F.col(c) for c in columns))))
