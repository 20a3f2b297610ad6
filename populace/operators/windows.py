"""Ranking and running computations over clusters, axes and bins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def centroids(rows: DataFrame, group: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Mean vector, rows and share of all rows of each group."""
    by = rows.groupBy(*group).agg(F.count("*").alias("n"), *(F.avg(c).alias(c) for c in columns))
    total = rows.count()
    return by.withColumn("share", F.col("n") / total)


def representatives(rows: DataFrame, group: Sequence[str], key: str, columns: Sequence[str]) -> DataFrame:
    """The row of each group nearest its mean, the least key of equal ones: means are
    joined back and the minimum is a map-side combined aggregate."""
    mean = rows.groupBy(*group).agg(*(F.avg(c).alias(f"_m_{c}") for c in columns))
    d2 = sum(((F.col(c) - F.col(f"_m_{c}")) * (F.col(c) - F.col(f"_m_{c}")) for c in columns), F.lit(0.0))
    return rows.join(mean, list(group)).groupBy(*group).agg(F.min_by(key, F.struct(F.round(d2, 9), F.col(key))).alias(key))


def slot_order(points: DataFrame, x: str, y: str) -> DataFrame:
    """Canonical order of a bounded list of points: by x - y, then x, then -y, on [0, 1]."""
    a, b, c, d = points.agg(F.min(x), F.max(x), F.min(y), F.max(y)).first()
    xn, yn = (F.col(x) - a) / ((b - a) or 1.0), (F.col(y) - c) / ((d - c) or 1.0)
    w = Window.orderBy(F.round(xn - yn, 9), F.round(xn, 9), F.round(-yn, 9))
    return points.withColumn("slot", F.row_number().over(w) - 1)


def dense_ids(rows: DataFrame, column: str) -> DataFrame:
    """Ids 0.. in the order of distinct values, which are few."""
    ids = rows.select(column).distinct().withColumn("id", F.row_number().over(Window.orderBy(column)) - 1)
    return rows.join(ids, column)


def sentence(values: Sequence[tuple[str, Column]], top: int | None = None) -> Column:
    """``marker(0.00) > marker(0.00)`` in falling order of value, first given of equal ones."""
    items = F.array_sort(F.array(*(F.struct((-v).alias("v"), F.lit(i).alias("i"), F.lit(m).alias("m")) for i, (m, v) in enumerate(values))))
    if top:
        items = F.slice(items, 1, top)
    return F.array_join(F.transform(items, lambda s: F.format_string("%s(%.2f)", s["m"], -s["v"])), " > ")


def running_counts(rows: DataFrame, group: Sequence[str], order: str, label: str) -> DataFrame:
    """(group, order, label, n, below, above): rows of a label at or under, and at or
    over, each value; equal values are counted once before the running sums.

    The counts are written in ranges of (group, label, order); sums run inside a range and
    are raised by those of the ranges before, so one label's values may fill many tasks."""
    from ..plans.flagship import cut_lineage

    key, of = [*group, label], Window.partitionBy("_part", *group, label)
    n = rows.groupBy(*group, order, label).agg(F.count("*").alias("n"))
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # written once: a second sampling of the ranges could cut them elsewhere
    ranged = cut_lineage(n.repartitionByRange(parts, *key, order).withColumn("_part", F.spark_partition_id()))
    size = ranged.groupBy("_part", *key).agg(F.sum("n").alias("_s"))
    by = Window.partitionBy(*key)  # a row for each range that holds the label
    ahead = size.select("_part", *(F.col(k).alias(f"_{k}") for k in key), (F.sum("_s").over(by.orderBy("_part")) - F.col("_s")).alias("_ahead"), F.sum("_s").over(by).alias("_all"))
    same = F.col("_part") == F.col("_at")
    for k in key:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    out = ranged.withColumn("_run", F.sum("n").over(of.orderBy(order))).join(ahead.withColumnRenamed("_part", "_at"), same)
    below = F.col("_run") + F.col("_ahead")
    return out.select(*group, order, label, "n", below.alias("below"), (F.col("_all") - below + F.col("n")).alias("above"))


#: Rows of a group that one task sorts at most for a quantile.
SORT_ROWS, SUB_BINS = 1_000_000, 1024


def quantiles(rows: DataFrame, group: Sequence[str], column: str, qs: Sequence[float], most: int = SORT_ROWS) -> DataFrame:
    """(group, q): the exact quantiles of a column as an array, interpolated between ranks.

    Groups of up to ``most`` rows are sorted by the engine's own aggregate. Beyond it each rank is
    narrowed down: the values of its interval are counted by sub-bins, the sub-bin that holds
    the rank becomes the interval, until at most ``most`` rows or one value are left to sort."""
    v = rows.select(*group, F.col(column).cast("double").alias("_v")).where("_v is not null and not isnan(_v)")
    box = v.groupBy(*group).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.count("*").alias("_n"))
    largest = box.agg(F.max("_n")).first()[0] or 0
    if largest <= most:
        return v.groupBy(*group).agg(F.percentile("_v", F.array(*(F.lit(float(q)) for q in qs))).alias("q"))
    from ..plans.flagship import cut_lineage

    place = [(F.col("_n") - 1) * F.lit(float(q)) for q in qs]
    ranks = F.array_distinct(F.array(*(r.cast("long") for p in place for r in (F.floor(p), F.ceil(p)))))
    key = [*group, "_rank"]
    at = cut_lineage(box.select(*group, "_lo", "_hi", F.lit(0).cast("long").alias("_before"), F.col("_n").alias("_in"), F.explode(ranks).alias("_rank")))
    for _ in range(64):
        if (at.where("_lo < _hi").agg(F.max("_in")).first()[0] or 0) <= most:
            break
        inside = v.join(at.drop("_in"), list(group)).where("_v between _lo and _hi")
        b = F.when(F.col("_hi") > F.col("_lo"), F.least(F.floor((F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * SUB_BINS), F.lit(SUB_BINS - 1))).otherwise(0)
        counted = inside.groupBy(*key, "_before", b.alias("_b")).agg(F.count("*").alias("_in"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        start = F.col("_before") + F.sum("_in").over(Window.partitionBy(*key).orderBy("_b")) - F.col("_in")
        at = cut_lineage(counted.withColumn("_start", start).where("_start <= _rank and _rank < _start + _in").select(*group, "_lo", "_hi", F.col("_start").alias("_before"), "_in", "_rank"))
    inside = v.join(at, list(group)).where("_v between _lo and _hi").groupBy(*key, "_before", "_v").agg(F.count("*").alias("_k"))
    start = F.col("_before") + F.sum("_k").over(Window.partitionBy(*key).orderBy("_v")) - F.col("_k")
    picked = inside.withColumn("_start", start).where("_start <= _rank and _rank < _start + _k")
    by = picked.groupBy(*group).agg(F.map_from_entries(F.collect_list(F.struct("_rank", "_v"))).alias("_m")).join(box.select(*group, "_n"), list(group))
    value = lambda r: F.element_at("_m", r.cast("long"))
    return by.select(*group, F.array(*(value(F.floor(p)) + (value(F.ceil(p)) - value(F.floor(p))) * (p - F.floor(p)) for p in place)).alias("q"))


def summed_area(bins: DataFrame, group: Sequence[str], nx: int, ny: int) -> DataFrame:
    """(group, xb, yb, s): rows in bins up to (xb, yb), over the full grid of bins."""
    grid = bins.select(*group).distinct().select(*group, F.explode(F.sequence(F.lit(0), F.lit(nx - 1))).alias("xb")).select(*group, "xb", F.explode(F.sequence(F.lit(0), F.lit(ny - 1))).alias("yb"))
    full = grid.join(bins, [*group, "xb", "yb"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    col = full.withColumn("c", F.sum("n").over(Window.partitionBy(*group, "xb").orderBy("yb")))
    return col.select(*group, "xb", "yb", F.sum("c").over(Window.partitionBy(*group, "yb").orderBy("xb")).alias("s"))


def bin_density(rows: DataFrame, group: Sequence[str], xb: str, yb: str) -> DataFrame:
    """Each row's bin count, by an aggregate joined back."""
    n = rows.groupBy(*group, xb, yb).agg(F.count("*").alias("density"))
    return rows.join(n, [*group, xb, yb])


def modal_bins(bins: DataFrame, group: Sequence[str], label: str) -> DataFrame:
    """Each label's fullest bin, the first of equal ones."""
    return bins.groupBy(*group, label).agg(F.min_by(F.struct("xb", "yb"), F.struct(-F.col("n"), F.col("xb"), F.col("yb"))).alias("b"), F.max("n").alias("n")).select(*group, label, "b.*", "n")


def seed_boxes(rows: DataFrame, group: Sequence[str], low: float = 0.05, high: float = 0.95) -> DataFrame:
    qx, qy = (quantiles(rows, group, c, (low, high)).withColumnRenamed("q", f"q{c}") for c in ("x", "y"))
    by = qx.join(qy, list(group))
    return by.select(*group, F.get("qx", 0).alias("x_min"), F.get("qx", 1).alias("x_max"), F.get("qy", 0).alias("y_min"), F.get("qy", 1).alias("y_max"))


def variance_rank(rows: DataFrame, columns: Sequence[str], skip: Sequence[str] = (), top: int | None = None) -> DataFrame:
    """(marker, variance, rank) by population variance, in one pass over the wide table."""
    kept = [c for c in columns if c not in skip]
    wide = rows.agg(*(F.var_pop(c).alias(c) for c in kept))
    long = wide.select(F.explode(F.array(*(F.struct(F.lit(c).alias("marker"), F.col(c).alias("variance")) for c in kept))).alias("r")).select("r.*")
    ranked = long.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("variance"), "marker")))
    return ranked.where(F.col("rank") <= top) if top else ranked


def axis_summary(rows: DataFrame, group: Sequence[str], column: str) -> DataFrame:
    qs = (0.05, 0.25, 0.5, 0.75, 0.95)
    box = rows.groupBy(*group).agg(F.min(column).alias("min"), F.max(column).alias("max"))
    by = box.join(quantiles(rows, group, column, qs), list(group))
    return by.select(*group, "min", "max", *(F.get("q", i).alias(f"q{int(q * 100):02d}") for i, q in enumerate(qs)))


def shoelace(polygons: DataFrame, key: Sequence[str]) -> DataFrame:
    """Area of polygons given as vertex rows (key, ord, x, y), closed by their first vertex."""
    w = Window.partitionBy(*key).orderBy("ord")
    all_of = Window.partitionBy(*key).orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    nx, ny = (F.coalesce(F.lead(c).over(w), F.first(c).over(all_of)) for c in ("x", "y"))
    cross = polygons.withColumn("_c", F.col("x") * ny - nx * F.col("y"))
    return cross.groupBy(*key).agg((F.abs(F.sum("_c")) / 2).alias("area"))
