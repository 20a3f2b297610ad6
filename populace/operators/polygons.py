"""Polygons as rows: which of many contains a point, and which of those wins.

A polygon is a column of vertices, so tables of any number of them take part in joins. Each is
covered by grid cells: a cell that no edge meets lies inside as a whole or outside; only points
of cells that an edge meets are tested against edges. The smallest polygon wins, so of a cell's
polygons only those that come before the first one that holds the whole cell can win there; the
others are dropped and crowded cells are quartered, which keeps a point's tests few however many
polygons there are. Points and polygons meet on cells, an equi-join; points of a cell meet its
polygons in blocks of both, so a crowded cell is many tasks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.predicates import UNASSIGNED
from ..plans.flagship import cut_lineage, discard

#: Distance from an edge that still counts as inside (as for gates that are compiled).
NEAR = 1e-9
#: Places to which areas are compared, so that equal shapes in other places are equal.
AREA_PLACES = 9
#: Polygons of a cell that a point meets in one row.
CELL_BLOCK = 64
#: Polygons of a cell from which it is quartered, and how often at most.
CROWDED, QUARTERED = 4, 4


def edges(vertices: Column) -> Column:
    """Edges (x1, y1, x2, y2) of a closed ring of vertices, each an array of two numbers."""
    n = F.size(vertices)
    at = F.sequence(F.lit(0), n - 1)
    return F.transform(at, lambda i: F.struct(*(F.get(F.get(vertices, j), F.lit(k)).alias(name) for j, k, name in ((i, 0, "x1"), (i, 1, "y1"), ((i + 1) % n, 0, "x2"), ((i + 1) % n, 1, "y2")))))


def in_ring(x: Column, y: Column, ring: Column, near: float = NEAR) -> Column:
    """Even-odd ray casting over edges (x1, y1, x2, y2), or within ``near`` of one."""

    def crosses(e):
        at = e["x1"] + (y - e["y1"]) * ((e["x2"] - e["x1"]) / F.nullif(e["y2"] - e["y1"], F.lit(0.0)))
        return ((y < e["y1"]) != (y < e["y2"])) & (x < at)

    def touches(e):
        dx, dy = e["x2"] - e["x1"], e["y2"] - e["y1"]
        length = F.coalesce(F.nullif(dx * dx + dy * dy, F.lit(0.0)), F.lit(1.0))
        t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((x - e["x1"]) * dx + (y - e["y1"]) * dy) / length))
        px, py = x - (e["x1"] + t * dx), y - (e["y1"] + t * dy)
        # most edges are told to be far by their extents; the slack is above any rounding
        slack = 2 * near + 1e-12 * (F.abs(x) + F.abs(y))
        beside = (F.greatest(e["x1"], e["x2"]) >= x - slack) & (F.least(e["x1"], e["x2"]) <= x + slack) & (F.greatest(e["y1"], e["y2"]) >= y - slack) & (F.least(e["y1"], e["y2"]) <= y + slack)
        return beside & (px * px + py * py <= near * near)

    odd = F.aggregate(ring, F.lit(False), lambda acc, e: acc != F.coalesce(crosses(e), F.lit(False)))
    return F.coalesce(F.exists(ring, touches) | odd, F.lit(False))


def area(ring: Column) -> Column:
    return F.abs(F.aggregate(ring, F.lit(0.0), lambda acc, e: acc + e["x1"] * e["y2"] - e["x2"] * e["y1"])) / 2


def _meets(e: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Whether an edge may meet a box: their extents do, and the box's corners aren't all strictly
    on one side of the edge's line."""
    extents = (F.least(e["x1"], e["x2"]) <= x1) & (F.greatest(e["x1"], e["x2"]) >= x0) & (F.least(e["y1"], e["y2"]) <= y1) & (F.greatest(e["y1"], e["y2"]) >= y0)
    sides = [(e["x2"] - e["x1"]) * (y - e["y1"]) - (e["y2"] - e["y1"]) * (x - e["x1"]) for x in (x0, x1) for y in (y0, y1)]
    return extents & (F.least(*sides) <= 0) & (F.greatest(*sides) >= 0)


def _of_cells(p: DataFrame, size_x: float, size_y: float) -> DataFrame:
    """Of rows (category, ord, area, ring, gx, gy) those whose polygon meets the cell, with
    border: whether an edge may meet it. Cells are widened by NEAR and a hair for rounding."""
    margin_x, margin_y = NEAR + 1e-9 * size_x, NEAR + 1e-9 * size_y
    x0, x1 = F.col("gx") * size_x - margin_x, (F.col("gx") + 1) * size_x + margin_x
    y0, y1 = F.col("gy") * size_y - margin_y, (F.col("gy") + 1) * size_y + margin_y
    cells = p.withColumn("border", F.exists("ring", lambda e: _meets(e, x0, y0, x1, y1)))
    inside = in_ring((F.col("gx") + 0.5) * size_x, (F.col("gy") + 0.5) * size_y, F.col("ring"))
    return cells.where(F.col("border") | inside)


def _over_grid(polygons: DataFrame, size_x: float, size_y: float) -> DataFrame:
    """(category, ord, area, ring, gx, gy, border) of the cells of a grid that polygons meet."""
    p = polygons.where(F.size("vertices") >= 3).select("category", "ord", edges(F.col("vertices")).alias("ring"))
    # a small file is many cells: polygons are dealt before they meet the grid
    n = int(polygons.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    p = p.withColumn("area", F.round(area(F.col("ring")), AREA_PLACES)).repartition(n, "category", "ord")
    span = lambda lo, hi, size: F.sequence(F.floor((lo - NEAR) / size) - 1, F.floor((hi + NEAR) / size) + 1)
    of = lambda c: F.transform("ring", lambda e: e[c])
    ends = {f"{name}_{c}": f(of(c)) for name, f in (("min", F.array_min), ("max", F.array_max)) for c in ("x1", "y1")}
    cells = p.withColumns(ends).select("*", F.explode(span(F.col("min_x1"), F.col("max_x1"), size_x)).alias("gx"))
    cells = cells.select("*", F.explode(span(F.col("min_y1"), F.col("max_y1"), size_y)).alias("gy"))
    return _of_cells(cells.select("category", "ord", "area", "ring", "gx", "gy"), size_x, size_y)


def cover(polygons: DataFrame, size_x: float, size_y: float) -> DataFrame:
    """(category, ord, area, ring, gx, gy, border): the cells of each polygon (category, ord,
    vertices) that are inside it or that an edge meets; a point near an edge is in a border cell.
    Fewer than three vertices hold nothing."""
    return _over_grid(polygons, size_x, size_y).withColumn("ring", F.when(F.col("border"), F.col("ring")))


def _contenders(cells: DataFrame) -> DataFrame:
    """Rows of a table of cells that can win in their cell, with n, their number there: those up to
    the first that holds the cell as a whole. ``cells`` is read twice, so it should be saved."""
    order = F.struct("area", (-F.col("ord")).alias("o"), "category")
    whole = cells.where(~F.col("border")).groupBy("level", "gx", "gy").agg(F.min(order).alias("whole"))
    left = cells.join(whole, ["level", "gx", "gy"], "left").where(F.col("whole").isNull() | (order <= F.col("whole")))
    return left.drop("whole")


def nested_cover(polygons: DataFrame, size_x: float, size_y: float, crowded: int = CROWDED, levels: int = QUARTERED) -> DataFrame:
    """(level, gx, gy, n, category, ord, area, ring, border): of each cell the polygons that can win
    in it. A cell of ``level`` k is 2^-k of the sizes wide and high; where over ``crowded`` of its
    polygons have an edge in it, its four quarters take its place, down to level ``levels``."""
    rows = _over_grid(polygons, size_x, size_y)
    done, held = [], []
    for level in range(levels + 1):
        met = cut_lineage(rows.withColumn("level", F.lit(level)))
        kept = cut_lineage(_contenders(met))
        n = kept.groupBy("level", "gx", "gy").agg(F.count("*").alias("n"), F.count_if("border").alias("edged"))
        left = cut_lineage(kept.join(n, ["level", "gx", "gy"]))
        discard(met, kept)
        more = level < levels and not left.where(F.col("edged") > crowded).isEmpty()
        done.append(left.where(F.col("edged") <= crowded) if more else left)
        if not more:
            break
        x, y = size_x / 2 ** (level + 1), size_y / 2 ** (level + 1)
        quarters = F.explode(F.array(*(F.struct((F.col("gx") * 2 + i).alias("gx"), (F.col("gy") * 2 + j).alias("gy")) for i in (0, 1) for j in (0, 1)))).alias("q")
        rows = _of_cells(left.where(F.col("edged") > crowded).select("category", "ord", "area", "ring", quarters).select("category", "ord", "area", "ring", "q.*"), x, y)
    return reduce(DataFrame.union, done).drop("edged")


def assign_polygons(points: DataFrame, polygons: DataFrame, key: str, size_x: float, size_y: float, block: int = CELL_BLOCK, crowded: int = CROWDED, levels: int = QUARTERED) -> DataFrame:
    """``points`` (key, x, y) with ``label``: of the polygons (category, ord, vertices) that hold
    a point the smallest, the larger ord of equal ones; Unassigned outside all.

    A cell's polygons come in blocks of ``block``, each an array in winning order; a point meets
    each block of its cell in one row, and the winners of its blocks are compared by key. A point
    without an x or y, or with a null key, is Unassigned; rows of a key are points each only if the
    key is unique."""
    gate = F.struct("area", (-F.col("ord")).alias("o"), "category", "border", F.when(F.col("border"), F.col("ring")).alias("ring"))
    cells = nested_cover(polygons, size_x, size_y, crowded, levels)
    place = ["level", "gx", "gy"]
    parts = cells.withColumn("part", F.pmod(F.xxhash64("category", "ord"), F.greatest(F.lit(1), F.ceil(F.col("n") / block)))).groupBy(*place, "part").agg(F.array_sort(F.collect_list(gate)).alias("gates"))
    # a point's cell of each level, of which one at most holds polygons
    at = lambda v, size, k: F.floor(F.col(v) / (size / 2**k))
    own = F.explode(F.array(*(F.struct(F.lit(k).alias("level"), at("x", size_x, k).alias("gx"), at("y", size_y, k).alias("gy")) for k in range(levels + 1)))).alias("c")
    # few bytes are many tests: points are dealt by key, as they are again below
    n = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = points.select(key, "x", "y").where(F.col(key).isNotNull()).repartition(n, key).select(key, "x", "y", own).select(key, "x", "y", "c.*")
    wins = lambda g: ~g["border"] | in_ring(F.col("x"), F.col("y"), g["ring"])
    named = lambda g: F.struct(g["area"].alias("area"), g["o"].alias("o"), g["category"].alias("category"))
    none = F.lit(None).cast("struct<area:double,o:bigint,category:string>")
    best = F.aggregate("gates", none, lambda b, g: F.when(b.isNotNull(), b).when(wins(g), named(g)))
    found = keyed.join(parts, place).select(key, best.alias("b")).where("b is not null")
    winners = found.groupBy(key).agg(F.min("b")["category"].alias("label"))
    return points.join(winners, key, "left").withColumn("label", F.coalesce("label", F.lit(UNASSIGNED)))
