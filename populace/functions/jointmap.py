"""A joint distribution as text: a character map of shades, marks on both axes, a legend.

Everything is an array expression over rows that hold one group's bins: counts as an
array of columns (x) of arrays (y), marks as arrays of structs. Nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Shades, the marks of an axis, and what stands for a map without one.
SHADES = 9
BAR, CORNER, LINE = "│", "└", "─"
OMITTED = "(degenerate input — 2D heatmap omitted)"


def shade_cuts(counts: Column) -> Column:
    """The quantiles, interpolated, of log1p of the filled bins that part SHADES shades."""
    logs = F.array_sort(F.transform(F.filter(F.flatten(counts), lambda n: n > 0), lambda n: F.log1p(n.cast("double"))))
    n = F.size(logs)

    def at(k):
        place = k / F.lit(float(SHADES)) * (n - 1)
        low = F.floor(place).cast("int")
        a, b = F.get(logs, low), F.get(logs, F.least(low + 1, n - 1))
        return a + (b - a) * (place - low)

    return F.when(n > 0, F.transform(F.sequence(F.lit(1), F.lit(SHADES - 1)), at))


def shade(n: Column, cuts: Column) -> Column:
    """A blank for an empty bin, else 1 and the number of cuts at or below its log1p."""
    v = F.log1p(n.cast("double"))
    return F.when(n > 0, F.least(F.size(F.filter(cuts, lambda c: c <= v)) + 1, F.lit(SHADES)).cast("string")).otherwise(" ")


def stacked_rows(marks: Column, width: int) -> Column:
    """Axis rows of ``width`` characters: marks (at, name), by place and name, each in the first
    row where its characters are free; a mark beyond the end is cut."""
    item = F.array_sort(F.transform(marks, lambda m: F.struct(m["at"].cast("int").alias("at"), m["name"].alias("name"))))
    free = lambda row, m: F.trim(F.substring(row, m["at"] + 1, F.length(m["name"]))) == ""

    def put(row, m):
        return F.substring(F.concat(F.substring(row, F.lit(1), m["at"]), m["name"], F.substring(row, m["at"] + 1 + F.length(m["name"]), F.lit(width))), 1, width)

    def add(rows, m):
        first = F.array_position(F.transform(rows, lambda r: free(r, m)), F.lit(True))
        return F.when(first > 0, F.transform(rows, lambda r, i: F.when(i + 1 == first, put(r, m)).otherwise(r))).otherwise(F.concat(rows, F.array(put(F.lit(" " * width), m))))

    return F.aggregate(item, F.array().cast("array<string>"), add)


def joint_map(rows: DataFrame, nx: int, ny: int, x_name: str, y_name: str) -> Column:
    """The text of a row's map, as a column of ``rows``.

    counts: nx arrays of ny counts; n: rows of the group; x_min, x_max, y_min, y_max: ends of the
    scale; x_data_max, y_data_max: of the data; peaks: array of (xb, yb, x, y, share), valleys:
    array of (xb, yb, x, y, left, right) with the numbers of the peaks (from 0) on either side.
    A group without rows has a header and OMITTED."""
    # numbers halfway between two places (multiples of an eighth) go to the even one
    even = lambda c: F.when(c * 8 == F.floor(c * 8), F.bround(c, 2)).otherwise(c)
    two = lambda c: F.format_string("%.2f", even(c))
    col = F.col
    named = lambda arr, p: F.transform(col(arr), lambda s, i: F.struct(s["xb"].alias("xb"), s["yb"].alias("yb"), F.concat(F.lit(p), (i + 1).cast("string")).alias("name")))
    place = lambda v, lo, hi, n: F.greatest(F.lit(0), F.least(F.floor((v - lo) / (hi - lo) * n), F.lit(n - 1))).cast("int")
    short_x, short_y = col("x_data_max") < col("x_max"), col("y_data_max") < col("y_max")
    marks = F.concat(named("peaks", "P"), named("valleys", "V"))
    y_marks = F.concat(F.transform(marks, lambda m: F.struct(m["yb"].cast("int").alias("at"), m["name"].alias("name"))), F.when(short_y, F.array(F.struct(place(col("y_data_max"), col("y_min"), col("y_max"), ny).alias("at"), F.lit("My").alias("name")))).otherwise(F.array().cast("array<struct<at:int,name:string>>")))
    x_marks = F.concat(F.transform(marks, lambda m: F.struct(m["xb"].cast("int").alias("at"), m["name"].alias("name"))), F.when(short_x, F.array(F.struct(place(col("x_data_max"), col("x_min"), col("x_max"), nx).alias("at"), F.lit("Mx").alias("name")))).otherwise(F.array().cast("array<struct<at:int,name:string>>")))
    joined = lambda y: F.array_join(F.transform(F.filter(y_marks, lambda m: m["at"] == y), lambda m: m["name"]), "/")
    ticks = F.array_max(F.transform(F.sequence(F.lit(0), F.lit(ny - 1)), lambda y: F.length(joined(y))))
    width = F.greatest(F.length(two(col("y_min"))), F.length(two(col("y_max"))), F.lit(4), ticks)
    edge = lambda y: F.array_compact(F.array(F.when(y == 0, two(col("y_min"))), F.when(y == ny - 1, two(col("y_max")))))
    both = lambda y: F.array_join(F.concat(edge(y), F.filter(F.array(joined(y)), lambda s: s != "")), "/")
    padded = lambda s: F.concat(F.repeat(F.lit(" "), F.greatest(F.lit(0), width - F.length(s))), s)
    cuts = shade_cuts(col("counts"))
    line = lambda y: F.array_join(F.transform(col("counts"), lambda c: shade(F.get(c, y), cuts)), "")
    grid = F.transform(F.sequence(F.lit(ny - 1), F.lit(0), F.lit(-1)), lambda y: F.concat(F.lit(" "), padded(both(y)), F.lit(" " + BAR), line(y)))
    indent = F.repeat(F.lit(" "), width + 2)
    x_low, x_high = two(col("x_min")), two(col("x_max"))
    start = F.greatest(F.lit(0), nx - F.length(x_high))
    tick = F.concat(F.substring(F.rpad(x_low, nx, " "), F.lit(1), start), F.substring(x_high, 1, nx))
    header = F.concat(F.lit(f"[Joint distribution: {x_name} (x) × {y_name} (y)]   n="), F.format_number(F.coalesce(col("n"), F.lit(0)), 0))
    extra = F.when(short_x | short_y, "   Mx=data x_max, My=data y_max").otherwise("")
    legend_p = F.transform(col("peaks"), lambda p, i: F.format_string("P%d: x=%.2f, y=%.2f, frac=%.2f", i + 1, even(p["x"]), even(p["y"]), even(p["share"])))
    legend_v = F.transform(col("valleys"), lambda v, i: F.format_string("V%d: x=%.2f, y=%.2f (between P%d↔P%d)", i + 1, even(v["x"]), even(v["y"]), v["left"] + 1, v["right"] + 1))
    or_none = lambda a, what: F.when(F.size(a) > 0, a).otherwise(F.array(F.lit(f"{what}: none")))
    lines = F.concat(
        F.array(
            header,
            F.concat(F.lit("data:  x ∈ ["), x_low, F.lit(", "), two(col("x_data_max")), F.lit("]   y ∈ ["), two(col("y_min")), F.lit(", "), two(col("y_data_max")), F.lit("]")),
            F.concat(F.lit("scale: x ∈ ["), x_low, F.lit(", "), x_high, F.lit("]   y ∈ ["), two(col("y_min")), F.lit(", "), two(col("y_max")), F.lit("]")),
            F.concat(F.lit("density (' '=empty, 1..9 = log-quantile)"), extra),
            F.lit(""),
            F.concat(F.repeat(F.lit(" "), width + 1), F.lit(y_name)),
        ),
        grid,
        F.array(F.concat(F.repeat(F.lit(" "), width + 1), F.lit(CORNER + LINE * nx)), F.concat(indent, tick)),
        F.transform(stacked_rows(x_marks, nx), lambda r: F.concat(indent, r)),
        F.array(F.concat(indent, F.lit(" " * nx + "  " + x_name))),
        or_none(legend_p, "peaks"),
        or_none(legend_v, "valleys"),
    )
    return F.when(F.coalesce(col("n"), F.lit(0)) > 0, F.array_join(lines, "\n")).otherwise(F.concat(header, F.lit("\n" + OMITTED)))


def count_arrays(bins: DataFrame, group: list[str], nx: int, ny: int) -> DataFrame:
    """(group, n, counts) from filled bins (group, xb, yb, n)."""
    by = bins.groupBy(*group).agg(F.sum("n").alias("n"), F.map_from_entries(F.collect_list(F.struct((F.col("xb") * ny + F.col("yb")).cast("int").alias("k"), F.col("n").alias("v")))).alias("m"))
    cell = lambda x, y: F.coalesce(F.element_at("m", x * ny + y), F.lit(0)).cast("long")
    return by.select(*group, "n", F.transform(F.sequence(F.lit(0), F.lit(nx - 1)), lambda x: F.transform(F.sequence(F.lit(0), F.lit(ny - 1)), lambda y: cell(x, y))).alias("counts"))


def near_shares(bins: DataFrame, group: list[str], points: DataFrame, window: int = 5) -> DataFrame:
    """``points`` (group, xb, yb, ...) with share: the part of the group's rows in the bins of a
    ``window`` x ``window`` square around the point. Each bin meets the points whose square
    holds it by its own number, so this is an equi-join."""
    half = range(-(window // 2), window // 2 + 1)
    total = bins.groupBy(*group).agg(F.sum("n").alias("_t"))
    spread = points.withColumn("_id", F.monotonically_increasing_id()).select("*", F.explode(F.array(*(F.struct((F.col("xb") + i).alias("x"), (F.col("yb") + j).alias("y")) for i in half for j in half))).alias("_o"))
    near = spread.join(bins.select(*(F.col(g).alias(f"_g{i}") for i, g in enumerate(group)), F.col("xb").alias("_x"), F.col("yb").alias("_y"), F.col("n").alias("_n")), [*(F.col(g) == F.col(f"_g{i}") for i, g in enumerate(group)), F.col("_o.x") == F.col("_x"), F.col("_o.y") == F.col("_y")], "left")
    summed = near.groupBy("_id", *points.columns).agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("_near"))
    return summed.join(total, group, "left").select(*points.columns, F.coalesce(F.col("_near") / F.col("_t"), F.lit(0.0)).alias("share"))
