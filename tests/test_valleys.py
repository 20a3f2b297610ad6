"""Cuts from bin densities and their statuses."""

import math

import numpy as np
import pytest

from populace.operators import valleys as V

BINS = 60


def hist(spark, groups):
    rows = []
    for g, parts in groups.items():
        x = np.concatenate([np.random.default_rng(i).normal(m, s, n) for i, (m, s, n) in enumerate(parts)]) if parts else np.array([])
        n = np.histogram(x, BINS, (0, BINS))[0]
        rows += [(g, b, int(c)) for b, c in enumerate(n)]
    return spark.createDataFrame(rows, "g string, bin int, n long")


GROUPS = {
    "two_valleys": [(10, 2, 3000), (30, 2, 3000), (50, 2, 3000)],
    "three_valleys": [(6, 1.5, 3000), (20, 1.5, 3000), (35, 1.5, 1500), (52, 1.5, 3000)],
    "hidden": [(12, 3.0, 20000), (34, 1.5, 1600), (49, 1.5, 600)],
    "smooth": [(12, 4.0, 9000), (38, 1.6, 5000), (44, 1.6, 5000)],
    "one_valley": [(15, 4, 4000), (45, 4, 4000)],
    "flat": [(30, 6, 5000)],
    "single": [(20.5, 0.0, 40)],
}


@pytest.fixture(scope="module")
def cuts(spark):
    h = hist(spark, GROUPS)
    return {k: {r["g"]: (list(r["cuts"]), r["status"]) for r in V.rescued_cuts(h, ["g"], k, factor=f).collect()} for k, f in ((1, 4.0), (2, 1.0))}


def plain(n, factor, keep=0.1):
    """Densities and valleys by numpy."""
    n, b = np.asarray(n, float), np.arange(len(n))
    total = n.sum()
    if total < 2 or (v := ((n * b * b).sum() - (n * b).sum() ** 2 / total) / (total - 1)) <= 1e-9:
        return None, []
    h = max(math.sqrt(v) * (4 / (3 * total)) ** 0.2 * factor, 0.5)
    d = np.round([(n * np.exp(-0.5 * ((i - b) / h) ** 2)).sum() / (total * h * math.sqrt(2 * math.pi)) for i in b], 10)
    peaks = []
    for i in range(1, len(d)):
        after = next((x for x in d[i + 1 :] if x != d[i]), None)
        if d[i] > d[i - 1] and after is not None and after < d[i] and d[i] >= keep * d.max():
            peaks.append(i)
    return d, [int(a + 1 + np.argmin(d[a + 1 : c])) for a, c in zip(peaks, peaks[1:])]


def test_statuses_by_hand(spark, cuts):
    rows = {g: [r["n"] for r in hist(spark, {g: p}).orderBy("bin").collect()] for g, p in GROUPS.items()}
    for k, f in ((1, 4.0), (2, 1.0)):
        for g, n in rows.items():
            d, found = plain(n, f)
            got, status = cuts[k][g]
            depth = lambda c, all_: min(max(d[(max([x for x in all_ if x < c], default=-1)) + 1 : c], default=0), max(d[c + 1 : min([x for x in all_ if x > c], default=len(d))], default=0)) - d[c]  # noqa: B023,E731
            if not found:
                assert status == "median" and got == [int(np.argmax(2 * np.cumsum(n) >= sum(n)))]
            elif len(found) >= k:
                assert status == ("all" if len(found) == k else "top_depth")
                assert got == sorted(sorted(found, key=lambda c: (-round(depth(c, found), 10), c))[:k])
            else:
                c0 = found[0]
                left, right = plain(n[:c0], f)[1], [c0 + 1 + c for c in plain(n[c0 + 1 :], f)[1]]
                tried = [(-round(depth(c, [c, c0]), 10), c) for c in left + right]
                good = sorted(t for t in tried if t[0] < 0)
                assert (got, status) == ((sorted([c0, good[0][1]]), "split_rescue") if good else ([c0], "middle_dropped"))


def test_every_status_occurs(cuts):
    seen = {s for by in cuts.values() for _, s in by.values()}
    assert seen == {"all", "top_depth", "median", "split_rescue", "middle_dropped"}


def test_a_hidden_valley_is_found_on_its_side(cuts):
    (low, high), status = cuts[2]["hidden"]
    assert status == "split_rescue" and 18 < low < 32 and 37 < high < 47


def test_empty_and_tiny(spark):
    h = hist(spark, {"none": [], "one": [(5.5, 0, 1)]})
    assert [(r["g"], list(r["cuts"]), r["status"]) for r in V.rescued_cuts(h, ["g"], 2).collect()] == [("one", [5], "median")]
    assert V.rescued_cuts(h.limit(0), ["g"], 1).count() == 0
