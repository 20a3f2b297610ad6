"""Gates: closed rectangles and polygons that give rows a category.

Few gates compile to one CASE expression in winner order, which stays inside
code generation. Many gates are a table: points and gates meet on grid cells that
a gate's box covers, so the join is an equi-join whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import UNASSIGNED


@dataclass(frozen=True)
class Rect:
    x_min: float
    x_max: float
    y_min: float
    y_max: float

    @property
    def area(self) -> float:
        return (self.x_max - self.x_min) * (self.y_max - self.y_min)

    def contains(self, x: Column, y: Column) -> Column:
        return x.between(self.x_min, self.x_max) & y.between(self.y_min, self.y_max)


@dataclass(frozen=True)
class Polygon:
    vertices: tuple[tuple[float, float], ...]

    @property
    def area(self) -> float:
        v = self.vertices
        return abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(v, v[1:] + v[:1]))) / 2

    def contains(self, x: Column, y: Column, near: float = 1e-9) -> Column:
        """Even-odd ray casting, or within ``near`` of an edge."""
        v = self.vertices
        crossings, on_edge = F.lit(0), F.lit(False)
        for (x1, y1), (x2, y2) in zip(v, v[1:] + v[:1]):
            if y1 != y2:
                at = F.lit(x1) + (y - y1) * ((x2 - x1) / (y2 - y1))
                crossings = crossings + (((y < y1) != (y < y2)) & (x < at)).cast("int")
            dx, dy = x2 - x1, y2 - y1
            length = dx * dx + dy * dy or 1.0
            t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((x - x1) * dx + (y - y1) * dy) / length))
            px, py = x - (F.lit(x1) + t * dx), y - (F.lit(y1) + t * dy)
            on_edge = on_edge | (px * px + py * py <= near * near)
        return on_edge | (crossings % 2 == 1)


Gate = Rect | Polygon


def winner_order(gates: Mapping[str, Gate | Sequence[Gate] | None], options: Sequence[str] = (), rule: str = "smallest") -> list[tuple[str, Gate]]:
    """Single gates, the winner of an overlap first. ``smallest``: least area, the
    later given of equal ones. ``priority``: first in options, then as before.
    Categories without a gate and Unassigned are left out."""
    flat = [(c, g) for c, many in gates.items() if many is not None and c != UNASSIGNED for g in (many if isinstance(many, (list, tuple)) else [many])]
    place = {c: i for i, c in enumerate(o for o in options if o != UNASSIGNED)}
    if rule not in ("smallest", "priority"):
        raise ValueError(rule)
    ranked = sorted(enumerate(flat), key=lambda e: ((place.get(e[1][0], len(place)) if rule == "priority" else 0), e[1][1].area, -e[0]))
    return [g for _, g in ranked]


def assign(x: Column, y: Column, gates: Mapping, options: Sequence[str] = (), rule: str = "smallest") -> Column:
    """The winning category of each point; Unassigned outside all gates and for NULL points."""
    out = None
    for category, gate in winner_order(gates, options, rule):
        hit = gate.contains(x, y)
        out = F.when(hit, category) if out is None else out.when(hit, category)
    return F.lit(UNASSIGNED) if out is None else out.otherwise(UNASSIGNED)


def grid_cells(low: Column, high: Column, size: float) -> Column:
    return F.sequence(F.floor(low / size), F.floor(high / size))


#: Gates, counted once for each grid cell that they cover, that are sent to every task at most.
SENT_MAX = 200_000


def assign_by_table(points: DataFrame, gates: DataFrame, key: str, size_x: float, size_y: float) -> DataFrame:
    """``points`` (key, x, y) with ``label`` from rectangle rows (category, ord, x_min,
    x_max, y_min, y_max); the smallest area wins, the larger ord of equal ones.

    A grid cell's gates are one array, so a point meets its cell's gates in its own row and is
    never moved, while the cells are few enough to be sent; beyond SENT_MAX both are shuffled."""
    cells = gates.select("*", F.explode(grid_cells(F.col("x_min"), F.col("x_max"), size_x)).alias("_gx"))
    cells = cells.select("*", F.explode(grid_cells(F.col("y_min"), F.col("y_max"), size_y)).alias("_gy"))
    area = (F.col("x_max") - F.col("x_min")) * (F.col("y_max") - F.col("y_min"))
    gate = F.struct(area.alias("a"), (-F.col("ord")).alias("o"), "category", "x_min", "x_max", "y_min", "y_max")
    by_cell = cells.groupBy("_gx", "_gy").agg(F.collect_list(gate).alias("_g"))
    if cells.count() <= SENT_MAX:
        by_cell = F.broadcast(by_cell)
    keyed = points.withColumns({"_gx": F.floor(F.col("x") / size_x), "_gy": F.floor(F.col("y") / size_y)})
    hit = F.filter("_g", lambda g: F.col("x").between(g["x_min"], g["x_max"]) & F.col("y").between(g["y_min"], g["y_max"]))
    out = keyed.join(by_cell, ["_gx", "_gy"], "left").withColumn("label", F.coalesce(F.array_min(hit)["category"], F.lit(UNASSIGNED)))
    return out.drop("_gx", "_gy", "_g")


def range_warnings(gates: DataFrame, extent: tuple[float, float, float, float]) -> DataFrame:
    """(category, axis, low, high) of the rectangles that reach beyond the data on an axis.
    extent: x_min, x_max, y_min, y_max of the data."""
    a, b, c, d = extent
    one = lambda axis, lo, hi, low, high: F.when((F.col(lo) < low - 1e-9) | (F.col(hi) > high + 1e-9), F.struct(F.lit(axis).alias("axis"), F.col(lo).alias("low"), F.col(hi).alias("high")))
    found = F.filter(F.array(one("x", "x_min", "x_max", a, b), one("y", "y_min", "y_max", c, d)), lambda w: w.isNotNull())
    return gates.select("category", F.explode(found).alias("w")).select("category", "w.*")


def overlaps(gates: DataFrame, group: Sequence[str]) -> DataFrame:
    """Pairs of rectangles of a group with a positive overlap area."""
    a, b = gates.alias("a"), gates.alias("b")
    width = F.least("a.x_max", "b.x_max") - F.greatest("a.x_min", "b.x_min")
    height = F.least("a.y_max", "b.y_max") - F.greatest("a.y_min", "b.y_min")
    same = F.col("a.ord") < F.col("b.ord")
    for g in group:
        same = same & (F.col(f"a.{g}") == F.col(f"b.{g}"))
    return a.join(b, same).where((width > 0) & (height > 0)).select(*(F.col(f"a.{g}") for g in group), F.col("a.category").alias("first"), F.col("b.category").alias("second"), (width * height).alias("overlap_area"))
