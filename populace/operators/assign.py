"""Labels from clusters, grids, threshold regions and codebooks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.predicates import UNASSIGNED


def bin_of(v: Column, low: float | Column, high: float | Column, n: int) -> Column:
    """0-based equal-width bin, the last one closed on the right."""
    low, high = (F.lit(b) if not isinstance(b, Column) else b for b in (low, high))
    return F.least(F.greatest(F.floor((v - low) / (high - low) * n), F.lit(0)), F.lit(n - 1)).cast("int")


def region_at_or_above(v: Column, cuts: Sequence[float]) -> Column:
    """Number of cuts at or below v: a value on a cut belongs to the upper region."""
    return F.size(F.filter(F.array(*(F.lit(float(c)) for c in cuts)), lambda c: v >= c)) if cuts else F.lit(0)


def region_above(v: Column, cuts: Sequence[float]) -> Column:
    """Number of cuts below v: a value on a cut stays in the lower region."""
    return F.size(F.filter(F.array(*(F.lit(float(c)) for c in cuts)), lambda c: v > c)) if cuts else F.lit(0)


def threshold_cell(x: Column, y: Column, x_cuts: Sequence[float], y_cuts: Sequence[float]) -> Column:
    """Column-major id of the region of the cuts."""
    return region_at_or_above(x, x_cuts) * (len(y_cuts) + 1) + region_at_or_above(y, y_cuts)


def remap_middle(region: Column, status: str) -> Column:
    """With the middle of three regions dropped, the top one takes its place."""
    return F.when(region >= 1, region + 1).otherwise(region) if status == "middle_dropped" else region


def rule_label(xb: Column, yb: Column, table: Sequence[Sequence[str]]) -> Column:
    """table[y][x], Unassigned outside it."""
    rows = F.array(*(F.array(*(F.lit(v) for v in row)) for row in table))
    return F.coalesce(F.get(F.get(rows, yb), xb), F.lit(UNASSIGNED))


def check_rules(rules: DataFrame) -> DataFrame:
    """(rule, ok, why): tables must be rectangular, their labels known, and each axis
    has one valley fewer than regions."""
    width = F.size(F.get("regions", 0))
    ragged = F.exists("regions", lambda r: F.size(r) != width)
    unknown = F.exists(F.flatten("regions"), lambda v: ~F.array_contains("categories", v) & (v != UNASSIGNED))
    valleys = (F.col("x_valleys") != width - 1) | (F.col("y_valleys") != F.size("regions") - 1)
    why = F.when(~F.col("supported"), "unsupported").when(ragged, "ragged").when(unknown, "unknown label").when(valleys, "valleys").otherwise("")
    return rules.select("rule", why.alias("why")).withColumn("ok", F.col("why") == "")


def nearest(v: Sequence[Column], codebook: Sequence[tuple[int, Sequence[float]]]) -> Column:
    """Number of the nearest codebook row (a bounded list), the first of equal ones."""
    options = []
    for node, w in codebook:
        d = sum(((c - float(u)) * (c - float(u)) for c, u in zip(v, w)), F.lit(0.0))
        options.append(F.struct(d.alias("d"), F.lit(node).alias("node")))
    return F.array_min(F.array(*options))["node"]


def by_cluster(rows: DataFrame, labels: DataFrame, key: Sequence[str]) -> DataFrame:
    """rows with the label of their cluster; none where the cluster has none. labels may
    hold plain text or a JSON object with an annotation."""
    text = F.coalesce(F.get_json_object("label", "$.annotation"), F.col("label"))
    return rows.join(labels.select(*key, text.alias("label")), list(key), "left")


def largest_region(rows: DataFrame, region: str, label: str, categories: Sequence[str]) -> DataFrame:
    from .metrics import majority

    return majority(rows, [region], label, categories)


def knn_vote(grid: DataFrame, points: DataFrame, k: int, radius: float) -> DataFrame:
    """Distance-weighted vote of the k nearest labelled points (all, if there are fewer) for
    each grid point; nearest first, then by pid.

    grid: (gid, x, y), a bounded raster; points: (pid, x, y, label). Both sides are keyed by
    square cells of ``radius``, so only points of the 9 cells around a grid point are met; grid
    points with fewer than k points within the radius are met again with one twice as wide,
    until all have theirs. A grid point's points are ranked in 64 parts by hash before the
    best of each part are, so no task holds all points of a crowded cell."""
    from ..plans.flagship import cut_lineage

    total = points.count()
    k, left, found, span = min(k, total), grid, None, None
    if not k:
        return grid.select("gid", F.lit(None).cast("string").alias("label")).limit(0)
    while True:
        near = cut_lineage(_nearest_within(left, points, k, radius))
        full = near.groupBy("gid").agg(F.count("*").alias("n")).where(F.col("n") == k).select("gid")
        found = near.join(full, "gid", "left_semi") if found is None else found.union(near.join(full, "gid", "left_semi"))
        left = cut_lineage(left.join(full, "gid", "left_anti"))
        if left.isEmpty():
            break
        if span is None:
            box = points.select("x", "y").union(grid.select("x", "y")).agg(F.max("x") - F.min("x"), F.max("y") - F.min("y")).first()
            span = 2 * (box[0] + box[1]) + radius
        radius = min(2 * radius, span)
    votes = found.groupBy("gid", "label").agg(F.sum(1 / F.greatest("d", F.lit(1e-12))).alias("v"))
    return votes.groupBy("gid").agg(F.min_by("label", F.struct(-F.col("v"), F.col("label"))).alias("label"))


def _nearest_within(grid: DataFrame, points: DataFrame, k: int, radius: float) -> DataFrame:
    """(gid, pid, label, d) of the k nearest points within ``radius`` of each grid point."""
    cell = lambda c: F.floor(F.col(c) / radius)
    around = F.explode(F.array(*(F.struct((cell("x") + i).alias("cx"), (cell("y") + j).alias("cy")) for i in (-1, 0, 1) for j in (-1, 0, 1))))
    g = grid.select("gid", F.col("x").alias("gx"), F.col("y").alias("gy"), around.alias("c")).select("gid", "gx", "gy", "c.cx", "c.cy")
    p = points.select("pid", "x", "y", "label", cell("x").alias("cx"), cell("y").alias("cy"))
    d = F.sqrt((F.col("x") - F.col("gx")) * (F.col("x") - F.col("gx")) + (F.col("y") - F.col("gy")) * (F.col("y") - F.col("gy")))
    met = g.join(p, ["cx", "cy"]).select("gid", "pid", "label", d.alias("d")).where(F.col("d") <= radius)
    # the best k of each part first: what is then ranked for a grid point is at most 64 k
    cells = met.withColumn("_c", F.pmod(F.xxhash64("pid"), F.lit(64)))
    first = Window.partitionBy("gid", "_c").orderBy("d", "pid")
    few = cells.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= k).drop("_r", "_c")
    return few.withColumn("_r", F.row_number().over(Window.partitionBy("gid").orderBy("d", "pid"))).where(F.col("_r") <= k).drop("_r")
