"""Gates, joins and labels (J, D9-D11)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import predicates as P
from ..operators import assign as A
from ..operators import gates as G
from .base import cells, ev, query, table

GATES = {"low": G.Rect(0.0, 2.5, 0.0, 70.0), "mid": [G.Rect(2.0, 3.5, 20.0, 60.0), G.Rect(2.2, 3.0, 30.0, 50.0)], "high": G.Rect(3.0, 9.0, 0.0, 99.0), "none": None}
OPTIONS = ["high", "mid", "low", "Unassigned"]
_IN = {k: f"x BETWEEN {a} AND {b} AND y BETWEEN {c} AND {d}" for k, (a, b, c, d) in {"low": (0.0, 2.5, 0.0, 70.0), "mid1": (2.0, 3.5, 20.0, 60.0), "mid2": (2.2, 3.0, 30.0, 50.0), "high": (3.0, 9.0, 0.0, 99.0)}.items()}
SMALLEST = f"CASE WHEN {_IN['mid2']} THEN 'mid' WHEN {_IN['mid1']} THEN 'mid' WHEN {_IN['low']} THEN 'low' WHEN {_IN['high']} THEN 'high' ELSE 'Unassigned' END"
PRIORITY = f"CASE WHEN {_IN['high']} THEN 'high' WHEN {_IN['mid1']} THEN 'mid' WHEN {_IN['low']} THEN 'low' ELSE 'Unassigned' END"


@query("J2 P7 N13", f"SELECT event_type, {SMALLEST} AS label, count(*) AS n, sum(event_id)::BIGINT AS ids FROM ev GROUP BY ALL")
def gate_assign_smallest(spark, sf):
    label = G.assign(F.col("x"), F.col("y"), GATES, OPTIONS, "smallest")
    return ev(spark, sf).groupBy("event_type", label.alias("label")).agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


@query("J2 N13", f"SELECT event_type, {PRIORITY} AS label, count(*) AS n, sum(event_id)::BIGINT AS ids FROM ev GROUP BY ALL")
def gate_assign_priority(spark, sf):
    label = G.assign(F.col("x"), F.col("y"), GATES, OPTIONS, "priority")
    return ev(spark, sf).groupBy("event_type", label.alias("label")).agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


GRID = "SELECT 'g' || i AS category, i AS ord, (i % 10) * 0.5::DOUBLE AS x_min, (i % 10) * 0.5::DOUBLE + 0.4::DOUBLE + (i % 3) * 0.2::DOUBLE AS x_max, (i // 10) * 20.0::DOUBLE AS y_min, (i // 10) * 20.0::DOUBLE + 25.0::DOUBLE AS y_max FROM range(50) AS r(i)"


@query("J2", f"""SELECT label, count(*) AS n, sum(event_id)::BIGINT AS ids FROM (
  SELECT event_id, coalesce(category, 'Unassigned') AS label FROM (
    SELECT event_id, category, row_number() OVER (PARTITION BY event_id ORDER BY (x_max - x_min) * (y_max - y_min), ord DESC) AS rk
    FROM ev LEFT JOIN ({GRID}) g ON x BETWEEN x_min AND x_max AND y BETWEEN y_min AND y_max) WHERE rk = 1
) GROUP BY 1""")
def gate_assign_table(spark, sf):
    i = F.col("id")
    g = spark.range(50).select(F.concat(F.lit("g"), i).alias("category"), i.alias("ord"), (i % 10 * 0.5).alias("x_min"), (i % 10 * 0.5 + 0.4 + i % 3 * 0.2).alias("x_max"), (F.floor(i / 10) * 20.0).alias("y_min"), (F.floor(i / 10) * 20.0 + 25.0).alias("y_max"))
    out = G.assign_by_table(ev(spark, sf).select("event_id", "x", "y"), g, "event_id", 0.5, 20.0)
    return out.groupBy("label").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


NATION_BOXES = "SELECT n_regionkey AS task, n_name AS category, n_nationkey AS ord, n_nationkey % 10 * 0.5 AS x_min, n_nationkey % 10 * 0.5 + 1.4 + n_nationkey % 3 * 0.2 AS x_max, (n_nationkey // 10) * 20.0 AS y_min, (n_nationkey // 10) * 20.0 + 25.0 AS y_max FROM nation"


@query("J11", f"""WITH g AS ({NATION_BOXES}) SELECT a.category AS first, b.category AS second, round((least(a.x_max, b.x_max) - greatest(a.x_min, b.x_min)) * (least(a.y_max, b.y_max) - greatest(a.y_min, b.y_min)), 6) AS overlap_area
FROM g a JOIN g b ON a.task = b.task AND a.ord < b.ord WHERE least(a.x_max, b.x_max) > greatest(a.x_min, b.x_min) AND least(a.y_max, b.y_max) > greatest(a.y_min, b.y_min)""")
def overlap_pairs(spark, sf):
    """A rectangle for each nation; those of a region may overlap."""
    i = F.col("n_nationkey")
    row = F.floor(i / 10) * 20.0
    g = table(spark, sf, "nation").select(F.col("n_regionkey").alias("task"), F.col("n_name").alias("category"), i.alias("ord"), (i % 10 * 0.5).alias("x_min"), (i % 10 * 0.5 + 1.4 + i % 3 * 0.2).alias("x_max"), row.alias("y_min"), (row + 25.0).alias("y_max"))
    return G.overlaps(g, ["task"]).select("first", "second", F.round("overlap_area", 6).alias("overlap_area"))


@query("J1 J6", f"""SELECT event_type AS gt, label, count(*) AS n FROM (SELECT event_id, event_type FROM ev) JOIN (SELECT event_id, {SMALLEST} AS label FROM ev WHERE value > 20) USING (event_id) GROUP BY ALL""")
def gt_prediction_join(spark, sf):
    """Only the rows of a parent population have predictions."""
    e = ev(spark, sf)
    pred = e.where("value > 20").select("event_id", G.assign(F.col("x"), F.col("y"), GATES, OPTIONS).alias("label"))
    return e.select("event_id", F.col("event_type").alias("gt")).join(pred, "event_id").groupBy("gt", "label").agg(F.count("*").alias("n"))


@query("J13", f"SELECT alt AS gt, label AS pred, count(*) AS n FROM (SELECT {PRIORITY} AS alt, {SMALLEST} AS label FROM ev) GROUP BY ALL")
def alternative_reference(spark, sf):
    e = ev(spark, sf)
    return e.groupBy(G.assign(F.col("x"), F.col("y"), GATES, OPTIONS, "priority").alias("gt"), G.assign(F.col("x"), F.col("y"), GATES, OPTIONS).alias("pred")).agg(F.count("*").alias("n"))


@query("J3 C3", """SELECT event_id % 7 AS slot, CASE event_id % 7 WHEN 0 THEN 'a' WHEN 1 THEN 'b' WHEN 2 THEN 'c' END AS label, count(*) AS n FROM ev GROUP BY ALL""")
def cluster_lookup(spark, sf):
    labels = spark.createDataFrame([(0, "a"), (1, '{"annotation": "b"}'), (2, "c")], "slot long, label string")
    rows = ev(spark, sf).select("event_id", (F.col("event_id") % 7).alias("slot"))
    return A.by_cluster(rows, labels, ["slot"]).groupBy("slot", "label").agg(F.count("*").alias("n"))


BOOK = [(0, (0.5, 20.0)), (1, (2.0, 50.0)), (2, (3.5, 80.0)), (3, (2.0, 10.0))]
_BOOK_SQL = ", ".join(f"({n}, {a}, {b})" for n, (a, b) in BOOK)


@query("J4", f"""SELECT node, count(*) AS n, sum(event_id)::BIGINT AS ids FROM (
  SELECT event_id, node, row_number() OVER (PARTITION BY event_id ORDER BY (x - a) * (x - a) + (y - b) * (y - b), node) AS rk FROM ev, (VALUES {_BOOK_SQL}) AS c(node, a, b)
) WHERE rk = 1 GROUP BY 1""")
def nearest_codebook(spark, sf):
    node = A.nearest([F.col("x"), F.col("y")], BOOK)
    return ev(spark, sf).groupBy(node.alias("node")).agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


@query("J5 A17", """SELECT region, event_type AS category FROM (
  SELECT region, event_type, row_number() OVER (PARTITION BY region ORDER BY k DESC, list_position(['view', 'click', 'purchase'], event_type)) AS rk
  FROM (SELECT ((x >= 1)::INT + (x >= 2.5)::INT) * 2 + (y >= 50)::INT AS region, event_type, count(*) AS k FROM ev WHERE event_type IN ('view', 'click', 'purchase') GROUP BY ALL)
) WHERE rk = 1""")
def majority_map(spark, sf):
    rows = ev(spark, sf).select(A.threshold_cell(F.col("x"), F.col("y"), [1, 2.5], [50]).alias("region"), "event_type")
    return A.largest_region(rows, "region", "event_type", ["view", "click", "purchase"])


@query("D10 N15", "SELECT ((x >= 1)::INT + (x >= 2.5)::INT) * 3 + ((y >= 30)::INT + (y >= 60)::INT) AS region, count(*) AS n FROM ev GROUP BY 1")
def threshold_regions(spark, sf):
    return ev(spark, sf).groupBy(A.threshold_cell(F.col("x"), F.col("y"), [1, 2.5], [30, 60]).alias("region")).agg(F.count("*").alias("n"))


@query("D11 N15", """SELECT CASE WHEN yb = 0 AND xb = 0 THEN 'nn' WHEN yb = 0 AND xb = 1 THEN 'pn' WHEN yb = 0 THEN 'Unassigned' WHEN xb = 0 THEN 'np' WHEN xb = 1 THEN 'pp' ELSE 'top' END AS label, count(*) AS n
FROM (SELECT (y > 40)::INT AS yb, CASE WHEN (x > 1.5) THEN 2 ELSE 0 END AS xb FROM ev) GROUP BY 1""")
def rule_regions(spark, sf):
    e = ev(spark, sf)
    xb = A.remap_middle(A.region_above(F.col("x"), [1.5]), "middle_dropped")
    label = A.rule_label(xb, A.region_above(F.col("y"), [40]), [["nn", "pn", "Unassigned"], ["np", "pp", "top"]])
    return e.groupBy(label.alias("label")).agg(F.count("*").alias("n"))


@query("D9 N14", "SELECT dataset, least(greatest(floor((x - a) / (b - a) * 8), 0), 7)::INT AS xb, floor(y / 10000)::INT AS yb, count(*) AS n FROM cells, (SELECT min(x) AS a, max(x) AS b FROM cells) GROUP BY ALL")
def grid_uniform(spark, sf):
    c = cells(spark, sf)
    a, b = c.agg(F.min("x"), F.max("x")).first()
    return c.groupBy("dataset", A.bin_of(F.col("x"), a, b, 8).alias("xb"), F.floor(F.col("y") / 10000).cast("int").alias("yb")).agg(F.count("*").alias("n"))


@query("J7 S9", """SELECT scenario, event_type, count(*) AS n FROM ev JOIN (VALUES ('rare', 'click'), ('rare', 'view'), ('drift', 'view')) AS h(scenario, event_type) USING (event_type) GROUP BY ALL""")
def registry_join(spark, sf):
    h = spark.createDataFrame([("rare", "click"), ("rare", "view"), ("drift", "view")], "scenario string, event_type string")
    return ev(spark, sf).join(h, "event_type").groupBy("scenario", "event_type").agg(F.count("*").alias("n"))


@query("J12 C6 K7", """SELECT n.n_nationkey AS key, s.seg FROM nation n, (VALUES ('BUILDING'), ('AUTOMOBILE'), ('NONE')) AS s(seg)
WHERE NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_nationkey = n.n_nationkey AND c.c_mktsegment = s.seg)""")
def expected_missing(spark, sf):
    from ..operators.pool import missing

    want = table(spark, sf, "nation").select(F.col("n_nationkey").alias("key"), F.explode(F.array(F.lit("BUILDING"), F.lit("AUTOMOBILE"), F.lit("NONE"))).alias("seg"))
    have = table(spark, sf, "customer").select(F.col("c_nationkey").alias("key"), F.col("c_mktsegment").alias("seg"))
    return missing(want, have, ["key", "seg"])


@query("J14 N19", "SELECT r_name AS leaf FROM region WHERE r_regionkey >= 3 UNION ALL SELECT n_name FROM nation WHERE n_regionkey < 3")
def leaf_set(spark, sf):
    """A plan that parts the first three regions into their nations."""
    from ..plans.cascade import leaf_categories

    regions = [r["r_name"] for r in table(spark, sf, "region").orderBy("r_regionkey").collect()]
    nations = table(spark, sf, "nation").orderBy("n_nationkey").collect()
    steps = [("ALL", regions), *((f"region == {r}", [n["n_name"] for n in nations if n["n_regionkey"] == k]) for k, r in enumerate(regions[:3]))]
    return spark.createDataFrame([(x,) for x in leaf_categories(steps)], "leaf string")


@query("J16", "SELECT c_nationkey AS task, min_by(c_name, c_custkey * 7 % 101 * 1000000 + c_custkey) AS path FROM customer WHERE c_acctbal > 0 GROUP BY 1")
def candidate_paths(spark, sf):
    """Customers as the candidates of their nation: the first one in order that is valid."""
    from ..operators.pool import first_candidate

    k = F.col("c_custkey")
    rows = table(spark, sf, "customer").select(F.col("c_nationkey").alias("task"), F.col("c_name").alias("path"), (k * 7 % 101 * 1000000 + k).alias("prio"), (F.col("c_acctbal") > 0).alias("valid"))
    return first_candidate(rows, ["task"], "prio", F.col("valid")).select("task", "path")


@query("J15", """SELECT gid, label FROM (
  SELECT gid, label, row_number() OVER (PARTITION BY gid ORDER BY sum(1 / greatest(d, 1e-12)) DESC, label) AS rk FROM (
    SELECT gid, event_type AS label, d, row_number() OVER (PARTITION BY gid ORDER BY d, event_id) AS nn FROM (
      SELECT g.i * 10 + g.j AS gid, event_type, event_id, sqrt((x - g.i * 0.5) * (x - g.i * 0.5) + (y / 20 - g.j * 0.5) * (y / 20 - g.j * 0.5)) AS d
      FROM ev, (SELECT a.i, b.i AS j FROM range(8) a(i), range(8) b(i)) g)
  ) WHERE nn <= 7 GROUP BY gid, label
) WHERE rk = 1""")
def knn_raster(spark, sf):
    g = spark.range(64).select((F.floor(F.col("id") / 8) * 10 + F.col("id") % 8).alias("gid"), (F.floor(F.col("id") / 8) * 0.5).alias("x"), (F.col("id") % 8 * 0.5).alias("y"))
    points = ev(spark, sf).select(F.col("event_id").alias("pid"), "x", (F.col("y") / 20).alias("y"), F.col("event_type").alias("label"))
    return A.knn_vote(g, points, 7, 0.5)


@query("G7", "SELECT dataset, sample, CASE WHEN max(x) > min(x) THEN min(x) ELSE min(x) - 0.5 END AS lo, CASE WHEN max(x) > min(x) THEN max(x) ELSE max(x) + 0.5 END AS hi FROM cells GROUP BY ALL")
def data_extent(spark, sf):
    from ..operators.density import extent

    return extent(cells(spark, sf), ["dataset", "sample"], "x")
