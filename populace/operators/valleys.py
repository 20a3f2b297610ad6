"""Cuts between populations from densities of bins, with a rescue where too few are found.

A group's rows are counted by bins once; densities, peaks, valleys and sides are then made of
its bins, a bounded number, for all groups at once. A density is the kernel estimate of the
bins' counts, its bandwidth by the normal rule from their spread, rounded to PLACES so that
flat stretches are flat. A valley is the lowest bin between two neighbouring peaks that reach
``keep`` of the highest one.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PLACES = 10
#: Least bandwidth, in bins.
NARROW = 0.5


def bin_densities(hist: DataFrame, group: Sequence[str], factor: float = 1.0) -> DataFrame:
    """(group, bin, d) over the bins listed in ``hist`` (group, bin, n). Groups of fewer than two
    rows, or of one bin, have none."""
    n, b = F.col("n").cast("double"), F.col("bin").cast("double")
    by = hist.groupBy(*group).agg(F.sum(n).alias("N"), F.sum(n * b).alias("s"), F.sum(n * b * b).alias("q"), F.array_sort(F.collect_list(F.struct("bin", n.alias("n")))).alias("a"))
    by = by.withColumn("v", (F.col("q") - F.col("s") * F.col("s") / F.col("N")) / (F.col("N") - 1)).where("N >= 2 and v > 1e-9")
    by = by.withColumn("h", F.greatest(F.sqrt("v") * F.pow(4 / (3 * F.col("N")), F.lit(0.2)) * factor, F.lit(NARROW)))
    z = lambda s, t: (s["bin"] - t["bin"]) / F.col("h")
    total = lambda s: F.aggregate("a", F.lit(0.0), lambda acc, t: acc + t["n"] * F.exp(-0.5 * z(s, t) * z(s, t)))
    d = F.transform("a", lambda s: F.struct(s["bin"].alias("bin"), F.round(total(s) / (F.col("N") * F.col("h") * math.sqrt(2 * math.pi)), PLACES).alias("d")))
    return by.select(*group, F.explode(d).alias("e")).select(*group, "e.bin", "e.d")


def bin_valleys(density: DataFrame, group: Sequence[str], keep: float = 0.1) -> DataFrame:
    """(group, bin, d): the lowest bin, the first of equal ones, between neighbouring peaks. A
    peak is higher than the bin before it and than the next bin of another height."""
    w = Window.partitionBy(*group).orderBy("bin")
    whole = Window.partitionBy(*group)
    g = density.withColumn("rise", F.signum(F.col("d") - F.lag("d").over(w)))
    after = F.first(F.when(F.col("rise") != 0, F.col("rise")), ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    g = g.withColumn("peak", F.coalesce((F.col("rise") > 0) & (after < 0), F.lit(False)) & (F.col("d") >= keep * F.max("d").over(whole)))
    g = g.withColumn("gap", F.sum(F.col("peak").cast("int")).over(w))
    g = g.withColumn("last", F.max("gap").over(whole))
    between = g.where("gap > 0 and gap < last and not peak")
    return between.groupBy(*group, "gap").agg(F.min(F.struct("d", "bin")).alias("v")).select(*group, "v.bin", "v.d")


def cut_depths(cuts: DataFrame, density: DataFrame, group: Sequence[str]) -> DataFrame:
    """``cuts`` (group, bin, lo, hi) with depth: how far the density at the cut lies under the
    lower of the highest ones between it and ``lo``, and it and ``hi`` (bins, or null for the end)."""
    d = density.select(*group, F.col("bin").alias("_b"), F.col("d").alias("_d"))
    top = lambda c: F.coalesce(F.max(F.when(c, F.col("_d"))), F.lit(0.0))
    left = (F.col("_b") < F.col("bin")) & (F.col("lo").isNull() | (F.col("_b") > F.col("lo")))
    right = (F.col("_b") > F.col("bin")) & (F.col("hi").isNull() | (F.col("_b") < F.col("hi")))
    by = cuts.join(d, list(group)).groupBy(*group, "bin", "lo", "hi").agg(top(left).alias("l"), top(right).alias("r"), F.max(F.when(F.col("_b") == F.col("bin"), F.col("_d"))).alias("at"))
    return by.select(*group, "bin", F.round(F.least("l", "r") - F.col("at"), PLACES).alias("depth"))


def rescued_cuts(hist: DataFrame, group: Sequence[str], needed: int, keep: float = 0.1, factor: float = 1.0) -> DataFrame:
    """(group, cuts, status): ``needed`` (1 or 2) cuts of each group, bins in order.

    all: as many valleys as needed; top_depth: the deepest of more, each against its
    neighbours. Where two are needed and one is found, the density of the rows on each side of
    it is estimated anew, and the deepest valley of a side that lies under the whole density
    joins it (split_rescue), else the middle region is left out (middle_dropped). median: without
    a valley, the bin that half of the rows are up to. hist: (group, bin, n), empty bins listed."""
    group = list(group)
    density = bin_densities(hist, group, factor)
    found = bin_valleys(density, group, keep).select(*group, "bin")
    w = Window.partitionBy(*group).orderBy("bin")
    listed = found.select(*group, "bin", F.lag("bin").over(w).alias("lo"), F.lead("bin").over(w).alias("hi"))
    deep = F.array_sort(F.collect_list(F.struct((-F.col("depth")).alias("p"), "bin")))
    by = cut_depths(listed, density, group).groupBy(*group).agg(deep.alias("v"))
    first = F.array_sort(F.transform(F.slice("v", 1, needed), lambda s: s["bin"]))
    by = by.select(*group, F.size("v").alias("m"), first.alias("cuts"))
    running = Window.partitionBy(*group).orderBy("bin")
    half = hist.withColumn("_c", F.sum("n").over(running)).withColumn("_n", F.sum("n").over(Window.partitionBy(*group)))
    median = half.where("_n > 0 and 2 * _c >= _n").groupBy(*group).agg(F.min("bin").alias("median"))
    out = median.join(by, group, "left")
    if needed == 2:
        lone = by.where("m = 1").select(*group, F.col("cuts")[0].alias("cut"))
        side = F.when(F.col("bin") < F.col("cut"), 0).when(F.col("bin") > F.col("cut"), 1)
        halves = hist.join(lone, group).withColumn("side", side).where("side is not null")
        again = bin_valleys(bin_densities(halves, [*group, "side"], factor), [*group, "side"], keep).select(*group, "side", "bin").join(lone, group)
        tried = again.select(*group, "bin", F.when(F.col("side") == 1, F.col("cut")).alias("lo"), F.when(F.col("side") == 0, F.col("cut")).alias("hi"))
        best = cut_depths(tried, density, group).where("depth > 0").groupBy(*group).agg(F.min(F.struct((-F.col("depth")).alias("p"), "bin")).alias("b")).select(*group, F.col("b.bin").alias("more"))
        out = out.join(best, group, "left")
    else:
        out = out.withColumn("more", F.lit(None).cast("int"))
    m = F.coalesce("m", F.lit(0))
    status = F.when(m == 0, "median").when(m > needed, "top_depth").when(m == needed, "all").when(F.col("more").isNotNull(), "split_rescue").otherwise("middle_dropped")
    cuts = F.when(m == 0, F.array("median")).when((m < needed) & F.col("more").isNotNull(), F.array_sort(F.concat("cuts", F.array("more")))).otherwise(F.col("cuts"))
    return out.select(*group, cuts.alias("cuts"), status.alias("status"))
