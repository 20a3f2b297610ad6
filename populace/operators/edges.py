"""Rectangles whose edges lie on data values: exact coordinate ascent as Spark window sums.

Each class of a group has one closed rectangle at most, none overlapping; the score is the
macro-F1 of all classes, of which ``rest`` is the one outside all rectangles. A move puts one
edge of a rectangle on another value of the data, or takes the rectangle away. For every edge
the rows between the other three are counted by value, and running sums of the counts give
the score of every position at once. The best move of each group is made, until none gains.

Values are dealt to buckets between percentiles: sums run inside a bucket and are raised by
those of the buckets before, so no task holds a group, and none is larger for a crowded value.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.flagship import cut_lineage, discard

#: Buckets of values on each axis of a group.
BUCKETS = 128
GAIN = 1e-12
_SIDES = (("x", "x_min", "x_max"), ("y", "y_min", "y_max"))


def binned_bounds(rows: DataFrame, group: Sequence[str], boxes: DataFrame) -> DataFrame:
    """(group, label, x_min, x_max, y_min, y_max) of rectangles of bins (x0, x1, y0, y1, half
    open): the extreme values of the rows whose bins (xb, yb) are theirs on an axis, so that the
    same rows are inside. A rectangle without a value on an axis is left out."""
    held = rows.select(*group, "x", "y", "xb", "yb").join(boxes.select(*group, "label", "x0", "x1", "y0", "y1"), list(group))
    on = lambda v, lo, hi: F.when((F.col(f"{v}b") >= F.col(lo)) & (F.col(f"{v}b") < F.col(hi)), F.col(v))
    x, y = on("x", "x0", "x1"), on("y", "y0", "y1")
    return held.groupBy(*group, "label").agg(F.min(x).alias("x_min"), F.max(x).alias("x_max"), F.min(y).alias("y_min"), F.max(y).alias("y_max")).dropna(subset=["x_min", "y_min"])


def counted_points(rows: DataFrame, group: Sequence[str], label: str = "label") -> DataFrame:
    """(group, x, y, label, n, bx, by): equal points of a class counted once, with the buckets of
    their values. Rows without a value or a label are left out."""
    n = rows.select(*group, "x", "y", F.col(label).alias("label")).dropna(subset=["x", "y", "label"]).groupBy(*group, "x", "y", "label").agg(F.count("*").alias("n"))
    at = [i / BUCKETS for i in range(1, BUCKETS)]
    cuts = n.groupBy(*group).agg(*(F.percentile_approx(v, at, 10 * BUCKETS).alias(f"_c{v}") for v in "xy"))
    place = lambda v: F.size(F.filter(f"_c{v}", lambda c: c <= F.col(v)))
    return n.join(cuts, list(group)).select(*group, "x", "y", "label", "n", place("x").alias("bx"), place("y").alias("by"))


def _f1(hit: Column, said: Column, true: Column) -> Column:
    return F.coalesce(F.try_divide(2.0 * hit, said + true), F.lit(0.0))


def _sums(points: DataFrame, group: Sequence[str], rest: str) -> DataFrame:
    """(group, n_classes, n_all, n_rest): what the score needs of a group without its rectangles."""
    return points.groupBy(*group).agg(F.count_distinct("label").alias("n_classes"), F.sum("n").alias("n_all"), F.sum(F.when(F.col("label") == rest, F.col("n")).otherwise(0)).alias("n_rest"))


def box_counts(points: DataFrame, group: Sequence[str], boxes: DataFrame, rest: str) -> DataFrame:
    """boxes with hit (rows of their class inside), said (all rows inside), lost (rows of ``rest``
    inside) and true (rows of their class)."""
    b = boxes.withColumnRenamed("label", "k")
    inside = F.col("x").between(F.col("x_min"), F.col("x_max")) & F.col("y").between(F.col("y_min"), F.col("y_max"))
    n = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    own = F.col("label") == F.col("k")
    out = points.join(b, list(group)).groupBy(*group, "k", "x_min", "x_max", "y_min", "y_max").agg(n(inside & own).alias("hit"), n(inside).alias("said"), n(inside & (F.col("label") == rest)).alias("lost"), n(own).alias("true"))
    return out.withColumnRenamed("k", "label")


def scores(counted: DataFrame, group: Sequence[str], sums: DataFrame) -> DataFrame:
    """(group, f1_macro, and what its parts are) of the rectangles that box_counts counted."""
    by = counted.groupBy(*group).agg(F.sum(_f1(F.col("hit"), F.col("said"), F.col("true"))).alias("s"), F.sum("said").alias("all_said"), F.sum("lost").alias("all_lost"))
    out = sums.join(by, list(group), "left").fillna(0, ["s", "all_said", "all_lost"])
    others = _f1(F.col("n_rest") - F.col("all_lost"), F.col("n_all") - F.col("all_said"), F.col("n_rest"))
    return out.withColumn("f1_macro", (F.col("s") + others) / F.col("n_classes"))


def edge_scores(points: DataFrame, group: Sequence[str], boxes: DataFrame, rest: str, counted: DataFrame, sums: DataFrame) -> DataFrame:
    """(group, label, edge, value, score) of every position of every edge that keeps the
    rectangles apart. edge: x_min, x_max, y_min or y_max, or gone (without the rectangle)."""
    names = ["x_min", "x_max", "y_min", "y_max"]
    # how far each edge may go: to the next rectangle that faces it
    a, b = boxes.alias("a"), boxes.alias("b")
    same = F.lit(True)
    for g in group:
        same = same & F.col(f"a.{g}").eqNullSafe(F.col(f"b.{g}"))
    pairs = a.join(b, same & (F.col("a.label") != F.col("b.label")), "left")
    limits = []
    for v, lo, hi in _SIDES:
        _, olo, ohi = next(s for s in _SIDES if s[0] != v)
        facing = (F.col(f"a.{olo}") <= F.col(f"b.{ohi}")) & (F.col(f"b.{olo}") <= F.col(f"a.{ohi}"))
        limits += [F.max(F.when(facing & (F.col(f"b.{hi}") < F.col(f"a.{lo}")), F.col(f"b.{hi}"))).alias(f"past_{lo}"), F.min(F.when(facing & (F.col(f"b.{lo}") > F.col(f"a.{hi}")), F.col(f"b.{lo}"))).alias(f"past_{hi}")]
    free = pairs.groupBy(*(F.col(f"a.{c}") for c in [*group, "label", *names])).agg(*limits).toDF(*group, "k", *names, *(f"past_{c}" for v, *e in _SIDES for c in e))
    moves = []
    for v, lo, hi in _SIDES:
        o, olo, ohi = next(s for s in _SIDES if s[0] != v)
        across = F.col(o).between(F.col(olo), F.col(ohi))
        low = across & (F.col(v) <= F.col(hi)) & (F.col(f"past_{lo}").isNull() | (F.col(v) > F.col(f"past_{lo}")))
        high = across & (F.col(v) >= F.col(lo)) & (F.col(f"past_{hi}").isNull() | (F.col(v) < F.col(f"past_{hi}")))
        # sums run from the edge that stays: downward for a lower edge
        moves += [F.when(low, F.struct(F.lit(lo).alias("edge"), F.col(v).alias("value"), (-F.col(v)).alias("o"), (-F.col(f"b{v}")).alias("bucket")))]
        moves += [F.when(high, F.struct(F.lit(hi).alias("edge"), F.col(v).alias("value"), F.col(v).alias("o"), F.col(f"b{v}").alias("bucket")))]
    met = points.join(free, list(group)).select(*group, "k", "label", "n", F.explode(F.filter(F.array(*moves), lambda m: m.isNotNull())).alias("m"))
    key = [*group, "k", "edge", "bucket"]
    n = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    at = met.groupBy(*group, "k", F.col("m.edge").alias("edge"), F.col("m.bucket").alias("bucket"), F.col("m.o").alias("o"), F.col("m.value").alias("value")).agg(n(F.col("label") == F.col("k")).alias("hit"), F.sum("n").alias("said"), n(F.col("label") == rest).alias("lost"))
    size = at.groupBy(*key).agg(*(F.sum(c).alias(f"_{c}") for c in ("hit", "said", "lost")))
    ahead = Window.partitionBy(*key[:-1]).orderBy("bucket")  # BUCKETS rows at most
    size = size.select(*key, *((F.sum(f"_{c}").over(ahead) - F.col(f"_{c}")).alias(f"_{c}") for c in ("hit", "said", "lost")))
    run = Window.partitionBy(*key).orderBy("o")
    moved = at.join(size, key).select(*group, "k", "edge", "value", *((F.sum(c).over(run) + F.col(f"_{c}")).alias(f"new_{c}") for c in ("hit", "said", "lost")))
    gone = boxes.select(*group, F.col("label").alias("k"), F.lit("gone").alias("edge"), F.lit(None).cast("double").alias("value"), *(F.lit(0).cast("long").alias(f"new_{c}") for c in ("hit", "said", "lost")))
    was = counted.select(*group, F.col("label").alias("k"), "hit", "said", "lost", "true").join(scores(counted, group, sums), list(group))
    out = moved.unionByName(gone).join(was, [*group, "k"])
    own = F.col("s") - _f1(F.col("hit"), F.col("said"), F.col("true")) + _f1(F.col("new_hit"), F.col("new_said"), F.col("true"))
    others = _f1(F.col("n_rest") - F.col("all_lost") + F.col("lost") - F.col("new_lost"), F.col("n_all") - F.col("all_said") + F.col("said") - F.col("new_said"), F.col("n_rest"))
    return out.select(*group, F.col("k").alias("label"), "edge", "value", ((own + others) / F.col("n_classes")).alias("score"), "f1_macro")


def ascend(rows: DataFrame, group: Sequence[str], boxes: DataFrame, rest: str) -> DataFrame:
    """(group, label, x_min, x_max, y_min, y_max, f1_macro): the rectangles after the last move
    that gains. rows: (group, x, y, label); boxes: the rectangles to begin with, in values.

    Rows that miss a value or a label are left out, and so is a group without rows or without
    a rectangle. Of moves that score alike (to 12 places) the first by label, edge and value is made."""
    group = list(group)
    cols = [*group, "label", "x_min", "x_max", "y_min", "y_max"]
    points = cut_lineage(counted_points(rows, group))
    sums = cut_lineage(_sums(points, group, rest))
    now = cut_lineage(boxes.select(*cols))
    while True:
        counted = cut_lineage(box_counts(points, group, now, rest))
        moves = edge_scores(points, group, now, rest, counted, sums).where(F.col("score") > F.col("f1_macro") + GAIN)
        best = moves.groupBy(*group).agg(F.min_by(F.struct("label", "edge", "value"), F.struct(-F.round("score", 12), F.col("label"), F.col("edge"), F.col("value"))).alias("m"))
        best = cut_lineage(best.select(*group, "m.*").withColumnRenamed("label", "_k"))
        if best.isEmpty():
            out = cut_lineage(now.join(scores(counted, group, sums).select(*group, "f1_macro"), group))
            discard(points, sums, now, counted, best)
            return out
        after = now.join(best, group, "left").withColumn("_own", F.coalesce(F.col("label") == F.col("_k"), F.lit(False))).where(~(F.col("_own") & (F.col("edge") == "gone")) | F.col("edge").isNull())
        moved = [F.when(F.col("_own") & (F.col("edge") == c), F.col("value")).otherwise(F.col(c)).alias(c) for c in cols[-4:]]
        after = cut_lineage(after.select(*group, "label", *moved))
        discard(now, counted, best)
        now = after
