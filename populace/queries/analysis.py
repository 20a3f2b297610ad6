"""Windows (W), axis statistics (A19-A21), densities (D), geometry (G), clusters."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..operators import cluster as C
from ..operators import density as D
from ..operators import edges as E
from ..operators import geometry as G
from ..operators import windows as W
from ..operators.assign import bin_of
from ..operators.nearest import nearest_point
from ..operators.perturb import sample_exact
from .base import cells, ev, query, table

_BIN = "least(greatest(floor((x - a) / (b - a) * {n}), 0), {m})::INT"


@query("A21 D13", "SELECT event_type, count(*) AS n, round(avg(x), 6) AS x, round(avg(y), 6) AS y, round(count(*) / (SELECT count(*) FROM ev), 6) AS share FROM ev GROUP BY 1")
def centroids(spark, sf):
    out = W.centroids(ev(spark, sf), ["event_type"], ["x", "y"])
    return out.select("event_type", "n", *(F.round(c, 6).alias(c) for c in ("x", "y", "share")))


@query("W1", """SELECT event_type, event_id FROM (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY round((x - mx) * (x - mx) + (y - my) * (y - my), 9), event_id) AS rk
FROM ev JOIN (SELECT event_type, avg(x) AS mx, avg(y) AS my FROM ev GROUP BY 1) USING (event_type)) WHERE rk = 1""")
def representatives(spark, sf):
    return W.representatives(ev(spark, sf), ["event_type"], "event_id", ["x", "y"])


@query("W2 W3", """WITH p AS (SELECT user_id % 13 AS g, avg(x) AS x, avg(y) AS y FROM ev GROUP BY 1), b AS (SELECT min(x) AS a, max(x) AS b, min(y) AS c, max(y) AS d FROM p)
SELECT g, row_number() OVER (ORDER BY round((x - a) / (b - a) - (y - c) / (d - c), 9), round((x - a) / (b - a), 9), round(-(y - c) / (d - c), 9))::INT - 1 AS slot FROM p, b""")
def slot_order(spark, sf):
    p = ev(spark, sf).groupBy((F.col("user_id") % 13).alias("g")).agg(F.avg("x").alias("x"), F.avg("y").alias("y"))
    return W.slot_order(p, "x", "y").select("g", "slot")


@query("W3", "SELECT event_type, dense_rank() OVER (ORDER BY event_type)::INT - 1 AS id, n FROM (SELECT event_type, count(*) AS n FROM ev GROUP BY 1)")
def dense_ids(spark, sf):
    return W.dense_ids(ev(spark, sf).select("event_type"), "event_type").groupBy("event_type", "id").agg(F.count("*").alias("n"))


@query("W4", """SELECT event_type, array_to_string(list_transform(list_sort([(-v1, 0, 'x'), (-v2, 1, 'y'), (-v3, 2, 'value')]), lambda s: printf('%s(%.2f)', s[3], -s[1])), ' > ') AS sentence
FROM (SELECT event_type, round(avg(x), 3) + 0.0001 AS v1, round(avg(y), 3) + 0.0001 AS v2, round(avg(value), 3) + 0.0001 AS v3 FROM ev GROUP BY 1)""")
def cell_sentence(spark, sf):
    m = ev(spark, sf).groupBy("event_type").agg(*((F.round(F.avg(c), 3) + 0.0001).alias(c) for c in ("x", "y", "value")))
    return m.select("event_type", W.sentence([(c, F.col(c)) for c in ("x", "y", "value")]).alias("sentence"))


@query("A19", "SELECT marker, round(v, 4) AS variance, row_number() OVER (ORDER BY v DESC, marker)::INT AS rank FROM (SELECT 'l_discount' AS marker, var_pop(l_discount) AS v FROM cells UNION ALL SELECT 'l_tax', var_pop(l_tax) FROM cells UNION ALL SELECT 'y', var_pop(y) FROM cells)")
def hvp_rank(spark, sf):
    return W.variance_rank(cells(spark, sf), ["x", "y", "l_discount", "l_tax"], skip=["x"]).withColumn("variance", F.round("variance", 4))


@query("A20 N11", "SELECT dataset, min(x) AS min, max(x) AS max, quantile_cont(x, 0.05) AS q05, quantile_cont(x, 0.25) AS q25, quantile_cont(x, 0.5) AS q50, quantile_cont(x, 0.75) AS q75, quantile_cont(x, 0.95) AS q95 FROM cells GROUP BY 1")
def axis_summary(spark, sf):
    return W.axis_summary(cells(spark, sf), ["dataset"], "x")


@query("W5", """SELECT dataset, x, label, n, sum(n) OVER w::BIGINT AS below, sum(n) OVER (PARTITION BY dataset, label ORDER BY x ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::BIGINT AS above
FROM (SELECT dataset, x, coalesce("Step01_a|b", 'none') AS label, count(*) AS n FROM cells GROUP BY ALL) WINDOW w AS (PARTITION BY dataset, label ORDER BY x ROWS UNBOUNDED PRECEDING)""")
def cum_counts(spark, sf):
    c = cells(spark, sf).withColumn("label", F.coalesce("`Step01_a|b`", F.lit("none")))
    return W.running_counts(c, ["dataset"], "x", "label")


_H2 = f"h2 AS (SELECT {_BIN.format(n=8, m=7)} AS xb, least(greatest(floor((y - c) / (d - c) * 6), 0), 5)::INT AS yb, count(*) AS n FROM ev, (SELECT min(x) AS a, max(x) AS b, min(y) AS c, max(y) AS d FROM ev) GROUP BY ALL)"


@query("W6", f"WITH {_H2} SELECT g.xb, g.yb, coalesce((SELECT sum(n) FROM h2 WHERE h2.xb <= g.xb AND h2.yb <= g.yb), 0)::BIGINT AS s FROM (SELECT a.i::INT AS xb, b.i::INT AS yb FROM range(8) a(i), range(6) b(i)) g")
def sat2d(spark, sf):
    h = D.histogram_2d(ev(spark, sf).withColumn("g", F.lit(1)), ["g"], "x", "y", 8, 6)
    return W.summed_area(h, ["g"], 8, 6).drop("g")


@query("D1 N14", f"SELECT e.event_type, bin, count(v.event_id) AS n FROM (SELECT DISTINCT event_type FROM ev) e CROSS JOIN (SELECT i::INT AS bin FROM range(48) AS r(i)) LEFT JOIN (SELECT event_type, event_id, {_BIN.format(n=48, m=47)} AS bin FROM ev JOIN (SELECT event_type, min(x) AS a, max(x) AS b FROM ev GROUP BY 1) USING (event_type)) v USING (event_type, bin) GROUP BY ALL")
def hist1d(spark, sf):
    return D.histogram(ev(spark, sf), ["event_type"], "x", 48)


@query("D2", "SELECT event_type, least(greatest(floor((x - a) / (b - a) * 48), 0), 47)::INT AS xb, least(greatest(floor((y - c) / (d - c) * 24), 0), 23)::INT AS yb, count(*) AS n FROM ev JOIN (SELECT event_type, min(x) AS a, greatest(max(x), 8) AS b, min(y) AS c, greatest(max(y), 8) AS d FROM ev GROUP BY 1) USING (event_type) GROUP BY ALL")
def hist2d(spark, sf):
    return D.histogram_2d(ev(spark, sf), ["event_type"], "x", "y", 48, 24, 8.0)


@query("D3 N17", """WITH s AS (SELECT count(*) AS n, min(x) AS lo, max(x) AS hi, stddev_samp(x) * power(3 * count(*) / 4, -0.2) * 1.5 AS h FROM ev), k AS (SELECT round(x, 6) AS v, count(*) AS k FROM ev GROUP BY 1)
SELECT i::INT AS i, round(sum(k * exp(-0.5 * power((lo + i * ((hi - lo) / 127) - v) / h, 2))) / (any_value(n) * any_value(h) * sqrt(2 * pi())), 5) AS density FROM range(128) r(i), k, s GROUP BY i""")
def kde_grid(spark, sf):
    return D.kde(ev(spark, sf), "x", 128).select("i", F.round("density", 5).alias("density"))


@query("D3 W7", """WITH s AS (SELECT count(*) AS n, min(x) AS lo, max(x) AS hi, stddev_samp(x) * power(3 * count(*) / 4, -0.2) * 0.5 AS h FROM ev), k AS (SELECT round(x, 6) AS v, count(*) AS k FROM ev GROUP BY 1),
g AS (SELECT i::INT AS i, ln(1 + any_value(n) * sum(k * exp(-0.5 * power((lo + i * ((hi - lo) / 255) - v) / h, 2))) / (any_value(n) * any_value(h) * sqrt(2 * pi()))) AS s FROM range(256) r(i), k, s GROUP BY i),
t AS (SELECT i, s, coalesce(s > lag(s) OVER w AND s > lead(s) OVER w, false) AS top FROM g WINDOW w AS (ORDER BY i)),
p AS (SELECT i, s, top AND s >= 0.5 * (SELECT max(s) FROM t WHERE top) AS pk FROM t), q AS (SELECT *, sum(pk::INT) OVER (ORDER BY i) AS gap FROM p)
SELECT 'peak' AS kind, i, round(s, 4) AS height FROM q WHERE pk UNION ALL SELECT 'valley', arg_min(i, s), round(min(s), 4) FROM q WHERE gap > 0 AND gap < (SELECT max(gap) FROM q) AND NOT pk GROUP BY gap""")
def kde_peaks(spark, sf):
    e = ev(spark, sf)
    n = e.count()
    return D.peaks_and_valleys(D.kde(e, "x", 256, 0.5), n).select("kind", "i", F.round("height", 4).alias("height"))


@query("D6", f"WITH {_H2}, q AS (SELECT quantile_cont(ln(1 + n), [0.2, 0.4, 0.6, 0.8]) AS q FROM h2) SELECT xb, yb, n, 1 + len(list_filter(q, lambda c: c <= ln(1 + n)))::INT AS level FROM h2, q")
def levels(spark, sf):
    h = D.histogram_2d(ev(spark, sf).withColumn("g", F.lit(1)), ["g"], "x", "y", 8, 6)
    return D.density_levels(h, ["g"], 5).drop("g")


_OT = f"h AS (SELECT {_BIN.format(n=48, m=47)} AS bin, count(*) AS n FROM ev, (SELECT min(x) AS a, max(x) AS b FROM ev) GROUP BY 1), pre AS (SELECT i::INT AS bin, coalesce((SELECT sum(n) FROM h WHERE bin <= i), 0) AS c, coalesce((SELECT sum(n * bin) FROM h WHERE bin <= i), 0) AS m FROM range(48) r(i)), t AS (SELECT sum(n) AS tc, sum(n * bin) AS tm FROM h)"


@query("D12", f"WITH {_OT} SELECT bin AS cut1, round(m * m / c + (tm - m) * (tm - m) / (tc - c), 4) AS score FROM pre, t WHERE c > 0 AND tc > c AND bin < 47 ORDER BY score DESC, cut1 LIMIT 1")
def otsu(spark, sf):
    return D.otsu(D.histogram(ev(spark, sf).withColumn("g", F.lit(1)), ["g"], "x", 48), 1)


@query("D12", f"WITH {_OT} SELECT p.bin AS cut1, q.bin AS cut2, round(p.m * p.m / p.c + (q.m - p.m) * (q.m - p.m) / (q.c - p.c) + (tm - q.m) * (tm - q.m) / (tc - q.c), 4) AS score FROM pre p JOIN pre q ON p.bin < q.bin, t WHERE p.c > 0 AND q.c > p.c AND tc > q.c AND q.bin < 47 ORDER BY score DESC, cut1, cut2 LIMIT 1")
def otsu_two_cuts(spark, sf):
    return D.otsu(D.histogram(ev(spark, sf).withColumn("g", F.lit(1)), ["g"], "x", 48), 2)


_VALLEYS = """v AS (SELECT user_id % 4 AS g, event_id % (1 + user_id % 4) AS i, round(avg(x), 4) AS x, round(avg(value), 4) AS depth, round(max(value), 4) AS "left", round(max(value) - avg(x), 4) AS "right" FROM ev GROUP BY ALL)"""


def _valleys(spark, sf):
    e = ev(spark, sf).withColumn("g", F.col("user_id") % 4).withColumn("i", F.col("event_id") % (1 + F.col("g")))
    return e.groupBy("g", "i").agg(F.round(F.avg("x"), 4).alias("x"), F.round(F.avg("value"), 4).alias("depth"), F.round(F.max("value"), 4).alias("left"), F.round(F.max("value") - F.avg("x"), 4).alias("right"))


@query("W8", f"""WITH {_VALLEYS}, r AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY least("left", "right") - depth DESC, i) AS place FROM v)
SELECT g, k AS needed, coalesce(array_to_string(list(printf('%.4f', x) ORDER BY x) FILTER (place <= k), ' '), '') AS cuts,
       CASE WHEN k = 0 THEN 'none' WHEN count(*) > k THEN 'selected' WHEN count(*) = k THEN 'all' WHEN k = 2 AND count(*) = 1 THEN 'middle_dropped' ELSE 'insufficient' END AS status
FROM r, (VALUES (0), (1), (2), (3)) AS t(k) GROUP BY g, k""")
def topk_prominence(spark, sf):
    v, out = _valleys(spark, sf), None
    for k in range(4):
        one = D.chosen_valleys(v, ["g"], k).select("g", F.lit(k).alias("needed"), F.array_join(F.transform("cuts", lambda c: F.format_string("%.4f", c)), " ").alias("cuts"), "status")
        out = one if out is None else out.union(one)
    return out


@query("W8 D12", f"""WITH {_VALLEYS}, r AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY least("left", "right") - depth DESC, i) AS place, count(*) OVER (PARTITION BY g) AS m FROM v),
h AS (SELECT user_id % 4 AS g, least(floor(y / 10), 9)::INT AS bin, count(*) AS n FROM ev GROUP BY ALL),
pre AS (SELECT g, b::INT AS b, coalesce((SELECT sum(n) FROM h WHERE h.g = t.g AND bin < b), 0) AS c, coalesce((SELECT sum(n * (bin * 10.0 + 5)) FROM h WHERE h.g = t.g AND bin < b), 0) AS m FROM (SELECT DISTINCT g FROM h) t, range(1, 10) r(b)),
tot AS (SELECT g, sum(n) AS tc, sum(n * (bin * 10.0 + 5)) AS tm FROM h GROUP BY g),
o AS (SELECT g, p.b AS b1, q.b AS b2 FROM pre p JOIN pre q USING (g) JOIN tot USING (g) WHERE p.b < q.b AND p.c > 0 AND q.c > p.c AND tc > q.c
      QUALIFY row_number() OVER (PARTITION BY g ORDER BY p.m * p.m / p.c + (q.m - p.m) * (q.m - p.m) / (q.c - p.c) + (tm - q.m) * (tm - q.m) / (tc - q.c) DESC, p.b, q.b) = 1)
SELECT g, CASE WHEN any_value(m) >= 2 THEN array_to_string(list(printf('%.4f', x) ORDER BY x) FILTER (place <= 2), ' ') WHEN any_value(b1) IS NOT NULL THEN printf('%.4f %.4f', any_value(b1) * 10.0, any_value(b2) * 10.0) END AS cuts,
       CASE WHEN any_value(m) > 2 THEN 'selected' WHEN any_value(m) = 2 THEN 'all' WHEN any_value(b1) IS NULL THEN 'failed' ELSE 'otsu' END AS status
FROM r LEFT JOIN o USING (g) GROUP BY g""")
def valleys_or_otsu(spark, sf):
    h = ev(spark, sf).groupBy((F.col("user_id") % 4).alias("g"), F.least(F.floor(F.col("y") / 10), F.lit(9)).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    every = h.select("g").distinct().select("g", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("bin"))
    hist = every.join(h, ["g", "bin"], "left").select("g", "bin", (F.col("bin") * 10.0 + 5).alias("centre"), F.coalesce("n", F.lit(0)).alias("n"))
    out = D.valleys_or_otsu(_valleys(spark, sf), hist, ["g"], 2)
    return out.select("g", F.array_join(F.transform("cuts", lambda c: F.format_string("%.4f", c)), " ").alias("cuts"), "status")


@query("W10 G2", "SELECT s_suppkey AS g, round(3.0 * (0.2 + (s_suppkey % 5) * 0.15) * (2.0 + (s_suppkey % 7)), 6) AS area FROM supplier")
def polygon_area(spark, sf):
    """A hexagon around each supplier's place."""
    k = F.col("s_suppkey")
    cx, cy, rx, ry = k * 37 % 601 / 100.0, k * 53 % 1009 / 10.0, 0.2 + k % 5 * 0.15, 2.0 + k % 7
    corners = [(1.0, 0.0), (0.5, 1.0), (-0.5, 1.0), (-1.0, 0.0), (-0.5, -1.0), (0.5, -1.0)]
    rows = table(spark, sf, "supplier").select(k.alias("g"), F.explode(F.array(*(F.struct(F.lit(i).alias("ord"), (cx + rx * a).alias("x"), (cy + ry * b).alias("y")) for i, (a, b) in enumerate(corners)))).alias("v")).select("g", "v.*")
    return W.shoelace(rows, ["g"]).withColumn("area", F.round("area", 6))


@query("W11", "SELECT density, count(*) AS n FROM (SELECT count(*) OVER (PARTITION BY floor(x * 4), floor(y / 5)) AS density FROM ev) GROUP BY 1")
def point_density(spark, sf):
    e = ev(spark, sf).withColumns({"xb": F.floor(F.col("x") * 4), "yb": F.floor(F.col("y") / 5)})
    return W.bin_density(e, [], "xb", "yb").groupBy("density").agg(F.count("*").alias("n"))


@query("W12", """SELECT event_type, xb, yb, n FROM (SELECT event_type, floor(x)::BIGINT AS xb, floor(y / 10)::BIGINT AS yb, count(*) AS n FROM ev GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY n DESC, xb, yb) = 1""")
def modal_bins(spark, sf):
    bins = ev(spark, sf).groupBy("event_type", F.floor("x").alias("xb"), F.floor(F.col("y") / 10).alias("yb")).agg(F.count("*").alias("n"))
    return W.modal_bins(bins, [], "event_type")


@query("W12", "SELECT event_type, quantile_cont(x, 0.05) AS x_min, quantile_cont(x, 0.95) AS x_max, quantile_cont(y, 0.05) AS y_min, quantile_cont(y, 0.95) AS y_max FROM ev GROUP BY 1")
def seed_boxes(spark, sf):
    return W.seed_boxes(ev(spark, sf), ["event_type"])


@query("D13", """SELECT xb, yb, n, event_id AS rep, printf('%s', CASE WHEN mx >= my / 20 THEN 'x' ELSE 'y' END) AS top FROM (
  SELECT xb, yb, count(*) OVER p AS n, event_id, mx, my, row_number() OVER (PARTITION BY xb, yb ORDER BY round((x - mx) * (x - mx) + (y - my) * (y - my), 9), event_id) AS rk
  FROM (SELECT *, avg(x) OVER p AS mx, avg(y) OVER p AS my FROM (SELECT *, floor(x)::BIGINT AS xb, floor(y / 25)::BIGINT AS yb FROM ev) WINDOW p AS (PARTITION BY xb, yb)) WINDOW p AS (PARTITION BY xb, yb)) WHERE rk = 1""")
def grid_cells(spark, sf):
    e = ev(spark, sf).withColumns({"xb": F.floor("x"), "yb": F.floor(F.col("y") / 25)})
    rep = W.representatives(e, ["xb", "yb"], "event_id", ["x", "y"]).withColumnRenamed("event_id", "rep")
    mean = e.groupBy("xb", "yb").agg(F.count("*").alias("n"), F.avg("x").alias("mx"), F.avg("y").alias("my"))
    return mean.join(rep, ["xb", "yb"]).select("xb", "yb", "n", "rep", F.when(F.col("mx") >= F.col("my") / 20, "x").otherwise("y").alias("top"))


def _bins(spark, sf):
    return D.histogram_2d(ev(spark, sf), ["event_type"], "x", "y", 48, 24)


#: Log counts of a 48 x 24 grid, smoothed along one axis and then the other, mirrored at the edges.
_SMOOTH = f"""b AS (SELECT event_type, {_BIN.format(n=48, m=47)} AS i, least(greatest(floor((y - c) / (d - c) * 24), 0), 23)::INT AS j, count(*) AS n
  FROM ev JOIN (SELECT event_type, min(x) AS a, max(x) AS b, min(y) AS c, max(y) AS d FROM ev GROUP BY 1) USING (event_type) GROUP BY ALL),
k AS (SELECT o::INT AS o, exp(-0.5 * power(o / 1.5, 2)) / sum(exp(-0.5 * power(o / 1.5, 2))) OVER () AS w FROM range(-6, 7) AS r(o)),
s0 AS (SELECT event_type, i, j, ln(1 + n) AS s FROM b),
s1 AS (SELECT event_type, g.i::INT AS i, j, sum(w * s) AS s FROM range(48) AS g(i), k JOIN s0 ON s0.i = CASE WHEN g.i + o < 0 THEN -1 - g.i - o WHEN g.i + o > 47 THEN 95 - g.i - o ELSE g.i + o END GROUP BY ALL),
s2 AS (SELECT event_type, i, g.j::INT AS j, sum(w * s) AS s FROM range(24) AS g(j), k JOIN s1 ON s1.j = CASE WHEN g.j + o < 0 THEN -1 - g.j - o WHEN g.j + o > 23 THEN 47 - g.j - o ELSE g.j + o END GROUP BY ALL)"""


@query("D4", f"""WITH {_SMOOTH}, top AS (SELECT event_type, max(s) AS m FROM s2 GROUP BY 1)
SELECT event_type, i AS xb, j AS yb, round(s, 6) AS height FROM s2 p JOIN top USING (event_type)
WHERE s >= m / 25 AND s >= (SELECT max(q.s) FROM s2 q WHERE q.event_type = p.event_type AND abs(q.i - p.i) <= 3 AND abs(q.j - p.j) <= 3)""")
def joint_peaks(spark, sf):
    out = D.on_bins(_bins(spark, sf), ["event_type"], 48, 24, "xb int, yb int, height double", D.joint_peaks)
    return out.withColumn("height", F.round("height", 6))


@query("D5")
def joint_valleys(spark, sf):
    return D.on_bins(_bins(spark, sf), ["event_type"], 48, 24, "a int, b int, xb int, yb int, height double", lambda c: D.spanning_valleys(c, D.joint_peaks(c)))


@query("D7")
def clouds(spark, sf):
    def rows(c):
        return [(i, m.xb, m.yb, m.birth, m.death or 1, m.birth - (m.death or 1) + 1, m.alone) for i, m in enumerate(D.level_clouds(c))]

    return D.on_bins(_bins(spark, sf), ["event_type"], 48, 24, "cloud int, xb int, yb int, birth int, death int, persistence int, alone long", rows)


def _basins(spark, sf):
    """Rows with the basin of their bin: bins are labelled, rows join them."""

    def rows(c):
        basin = D.watershed(c, [(m.xb, m.yb) for m in D.level_clouds(c)])
        return [(int(i), int(j), int(basin[i, j])) for i, j in zip(*(c > 0).nonzero())]

    e = ev(spark, sf)
    labelled = D.on_bins(_bins(spark, sf), ["event_type"], 48, 24, "xb int, yb int, basin int", rows)
    boxes = e.groupBy("event_type").agg(F.min("x").alias("a"), F.max("x").alias("b"), F.min("y").alias("c"), F.max("y").alias("d"))
    placed = e.join(boxes, "event_type").withColumns({"xb": bin_of(F.col("x"), F.col("a"), F.col("b"), 48), "yb": bin_of(F.col("y"), F.col("c"), F.col("d"), 24)})
    return placed.join(labelled, ["event_type", "xb", "yb"])


@query("D8")
def watershed_stats(spark, sf):
    return D.basin_stats(_basins(spark, sf), ["event_type", "basin"], "x", "y")


@query("D8 D1")
def basin_bars(spark, sf):
    b = _basins(spark, sf)
    return D.basin_histograms(b, ["event_type"], ["event_type", "basin"], ["x", "y"])


def _labelled(spark, sf):
    e = ev(spark, sf)
    return e.select("event_type", "x", "y", F.when(F.col("y") > 50, "up").otherwise("down").alias("gt"), F.when(F.col("y") > 45, "up").otherwise("down").alias("pred"))


@query("A5 G1 G3 G4")
def hull_iou(spark, sf):
    out = G.class_overlap(_labelled(spark, sf), ["event_type"], "gt", "pred", "x", "y")
    return out.groupBy("event_type").agg(F.round(F.avg("iou"), 4).alias("iou_macro"), F.count("*").alias("n"))


def _class_grids(pdf, n=48):
    import numpy as np

    labels = sorted(pdf["label"].unique())
    grids = np.zeros((len(labels), n, n))
    np.add.at(grids, ([labels.index(v) for v in pdf["label"]], pdf["xb"], pdf["yb"]), pdf["n"])
    return labels, grids


def _class_bins(spark, sf, n=48):
    r = ev(spark, sf)
    a, b = r.agg(F.min("x"), F.max("x")).first()
    label = F.when(F.col("y") + F.col("x") * 8 > 65, "up").when(F.col("y") + F.col("x") * 8 < 35, "down").otherwise("Unassigned")
    return r.groupBy("event_type", label.alias("label"), bin_of(F.col("x"), a, b, n).alias("xb"), bin_of(F.col("y"), 0.0, 100.0, n).alias("yb")).agg(F.count("*").alias("n"))


def _fitted(spark, sf, joint):
    import pandas as pd

    def fit(key, pdf):
        labels, grids = _class_grids(pdf)
        rest = labels.index("Unassigned") if "Unassigned" in labels else len(labels) - 1
        score, boxes = G.fit_rectangles(grids, rest, 4, joint)
        return pd.DataFrame([(key[0], labels[k], round(score, 6), *b) for k, b in boxes.items()], columns=["event_type", "label", "f1_macro", "x0", "x1", "y0", "y1"])

    return _class_bins(spark, sf).groupBy("event_type").applyInPandas(fit, "event_type string, label string, f1_macro double, x0 int, x1 int, y0 int, y1 int")


@query("G5")
def rect_oracle(spark, sf):
    return _fitted(spark, sf, False)


def _class_points(spark, sf):
    r = ev(spark, sf)
    a, b = r.agg(F.min("x"), F.max("x")).first()
    turned = F.col("y") + F.col("x") * 8
    label = F.when(turned > 65, "up").when(turned < 35, "down").otherwise("Unassigned")
    return r.select("event_type", "x", "y", label.alias("label"), bin_of(F.col("x"), a, b, 48).alias("xb"), bin_of(F.col("y"), 0.0, 100.0, 48).alias("yb"))


@query("G5 W5")
def rect_exact(spark, sf):
    """The rectangles of bins, their edges then moved over the data's own values."""
    points = _class_points(spark, sf)
    boxes = E.binned_bounds(points, ["event_type"], _fitted(spark, sf, False))
    return E.ascend(points, ["event_type"], boxes, "Unassigned").withColumn("f1_macro", F.round("f1_macro", 9))


BOXES = [("down", 0.1, 2.0, 2.0, 20.0), ("up", 1.0, 4.0, 45.0, 90.0)]


@query("W5 G5", """WITH pts AS (
  SELECT event_type, x, y, CASE WHEN y + x * 8 > 65 THEN 'up' WHEN y + x * 8 < 35 THEN 'down' ELSE 'Unassigned' END AS label FROM ev
), box AS (
  SELECT event_type, b.* FROM (SELECT DISTINCT event_type FROM pts) CROSS JOIN (VALUES ('down', 0.1::DOUBLE, 2.0::DOUBLE, 2.0::DOUBLE, 20.0::DOUBLE), ('up', 1.0, 4.0, 45.0, 90.0)) AS b(k, x_min, x_max, y_min, y_max)
), inside AS (
  SELECT event_type, k, x_min, x_max, y_min, y_max, count(*) FILTER (label = k) AS tru,
         count(*) FILTER (label = k AND x BETWEEN x_min AND x_max AND y BETWEEN y_min AND y_max) AS hit, count(*) FILTER (x BETWEEN x_min AND x_max AND y BETWEEN y_min AND y_max) AS said,
         count(*) FILTER (label = 'Unassigned' AND x BETWEEN x_min AND x_max AND y BETWEEN y_min AND y_max) AS lost
  FROM box JOIN pts USING (event_type) GROUP BY ALL
), g AS (
  SELECT event_type, count(DISTINCT label) AS c, count(*) AS n_all, count(*) FILTER (label = 'Unassigned') AS n_rest FROM pts GROUP BY 1
), slab AS (
  SELECT event_type, k, label, 'x_min' AS edge, x AS value, -x AS o FROM pts JOIN box USING (event_type) WHERE y BETWEEN y_min AND y_max AND x <= x_max
  UNION ALL SELECT event_type, k, label, 'x_max', x, x FROM pts JOIN box USING (event_type) WHERE y BETWEEN y_min AND y_max AND x >= x_min
  UNION ALL SELECT event_type, k, label, 'y_min', y, -y FROM pts JOIN box USING (event_type) WHERE x BETWEEN x_min AND x_max AND y <= y_max AND NOT (k = 'up' AND y <= 20)
  UNION ALL SELECT event_type, k, label, 'y_max', y, y FROM pts JOIN box USING (event_type) WHERE x BETWEEN x_min AND x_max AND y >= y_min AND NOT (k = 'down' AND y >= 45)
), run AS (
  SELECT event_type, k, edge, value, count(*) FILTER (label = k) OVER w AS h, count(*) OVER w AS s, count(*) FILTER (label = 'Unassigned') OVER w AS l FROM slab WINDOW w AS (PARTITION BY event_type, k, edge ORDER BY o)
), scored AS (
  SELECT DISTINCT r.event_type, r.k, edge, value, (CASE WHEN s + i.tru > 0 THEN 2.0 * h / (s + i.tru) ELSE 0 END + CASE WHEN other.said + other.tru > 0 THEN 2.0 * other.hit / (other.said + other.tru) ELSE 0 END
         + CASE WHEN n_all - s - other.said + n_rest > 0 THEN 2.0 * (n_rest - l - other.lost) / (n_all - s - other.said + n_rest) ELSE 0 END) / c AS score
  FROM run r JOIN inside i ON r.event_type = i.event_type AND r.k = i.k JOIN inside other ON r.event_type = other.event_type AND r.k <> other.k JOIN g ON g.event_type = r.event_type
)
SELECT event_type, k AS label, edge, count(*) AS n_positions, max(round(score, 8)) AS score, arg_min(value, (-round(score, 8), value)) AS value FROM scored GROUP BY 1, 2, 3""")
def best_edges(spark, sf):
    """The best position of each edge of two rectangles, every value of the data tried."""
    points = _class_points(spark, sf)
    boxes = points.select("event_type").distinct().crossJoin(F.broadcast(spark.createDataFrame(BOXES, "label string, x_min double, x_max double, y_min double, y_max double")))
    counted = E.counted_points(points, ["event_type"])
    sums = E._sums(counted, ["event_type"], "Unassigned")
    tried = E.edge_scores(counted, ["event_type"], boxes, "Unassigned", E.box_counts(counted, ["event_type"], boxes, "Unassigned"), sums).where("edge <> 'gone'")
    best = F.min_by("value", F.struct(-F.round("score", 8), F.col("value")))
    return tried.groupBy("event_type", "label", "edge").agg(F.count("*").alias("n_positions"), F.max(F.round("score", 8)).alias("score"), best.alias("value"))


@query("G6")
def rect_oracle_joint(spark, sf):
    return _fitted(spark, sf, True)


def _sizes(df):
    return df.groupBy("slot").agg(F.count("*").alias("n"))


@query("D14")
def plane_kmeans(spark, sf):
    return _sizes(C.cluster_plane(ev(spark, sf), ["x", "y"], "event_id", "kmeans", 6))


@query("D14")
def plane_ward(spark, sf):
    return _sizes(C.cluster_plane(ev(spark, sf), ["x", "y"], "event_id", "ward", 6))


FIT = """fit AS (
  SELECT event_id AS fid, x AS fx, y AS fy, event_type AS ftype, row_number() OVER (ORDER BY event_id) - 1 AS pos
  FROM (SELECT * FROM ev ORDER BY md5('42:' || event_id), event_id LIMIT 2000)
)"""


@query("J4 D14", f"""WITH {FIT}, near AS (
  SELECT event_id, min({{'d': (x - fx) * (x - fx) + (y - fy) * (y - fy), 'pos': pos}}) AS m FROM ev, fit GROUP BY 1
)
SELECT event_id, m.pos AS point, fid AS fit_event, ftype AS label FROM near JOIN fit ON fit.pos = m.pos""")
def nearest_fit_point(spark, sf):
    """Labels of a seeded sample, spread to every row from its nearest sampled one."""
    rows = ev(spark, sf)
    got = sorted(sample_exact(rows.select("event_id", "x", "y", "event_type"), 2000, 42, "event_id").collect())
    at = nearest_point(spark, [F.col("x"), F.col("y")], np.array([[r["x"], r["y"]] for r in got], float))
    fit = spark.createDataFrame([(i, r["event_id"], r["event_type"]) for i, r in enumerate(got)], "point long, fit_event long, label string")
    return rows.select("event_id", at.alias("point")).join(F.broadcast(fit), "point")


@query("D14")
def plane_gmm(spark, sf):
    return _sizes(C.cluster_plane(ev(spark, sf), ["x", "y"], "event_id", "gmm", 4))


@query("D15 J4")
def flowsom(spark, sf):
    e = table(spark, sf, "embeddings")
    dim = e.agg(F.max(F.size("embedding"))).first()[0] or 0
    e = e.select("vec_id", *(F.get("embedding", i).cast("double").alias(f"c{i}") for i in range(dim)))
    return _sizes(C.flowsom(e, e.columns[1:], "vec_id", 10))
