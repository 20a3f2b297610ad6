"""Predicates, labels, projections (P), label unions (U)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import predicates as P
from ..operators.gates import Polygon, Rect
from .base import cells, ev, query, table


def _where(spark, sf, text):
    c = cells(spark, sf)
    return c.where(P.compile_predicate(text, c.columns)).groupBy("dataset", "sample").agg(F.count("*").alias("n"), F.sum("x").alias("sum_x"))


@query("P1 N4", "SELECT dataset, sample, count(*) AS n, sum(x) AS sum_x FROM cells WHERE \"Step01_a|b\" = 'O' GROUP BY ALL")
def parent_eq(spark, sf):
    return _where(spark, sf, "Step01_a|b == O")


@query("P1 N1", "SELECT dataset, sample, count(*) AS n, sum(x) AS sum_x FROM cells WHERE \"Step02_c|d\" IN ('A', 'R') AND \"Step01_a|b\" IS DISTINCT FROM 'O' GROUP BY ALL")
def parent_in_and_neq(spark, sf):
    return _where(spark, sf, "Step02_c|d in A,R & Step01_a|b != O")


@query("P1 N2", "SELECT dataset, sample, count(*) AS n, sum(x) AS sum_x FROM cells WHERE false GROUP BY ALL")
def missing_column_false(spark, sf):
    return _where(spark, sf, "Step99 == O & Step02_c|d == A")


@query("P1 N3", "SELECT dataset, sample, count(*) AS n, sum(x) AS sum_x FROM cells WHERE \"Step02_c|d\" = 'A' GROUP BY ALL")
def parent_unknown_part(spark, sf):
    return _where(spark, sf, "whatever & Step02_c|d == A")


@query("P2", """SELECT 'ALL' AS parent, 'Root' AS breadcrumb
UNION ALL SELECT 'region == ' || r_name || ' & nation != ' || n_name, 'Root -> region(' || r_name || ') -> nation(not ' || n_name || ')' FROM nation JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT 'nation in ' || string_agg(n_name, ',' ORDER BY n_nationkey), 'Root -> nation(' || string_agg(n_name, ',' ORDER BY n_nationkey) || ')' FROM nation GROUP BY n_regionkey""")
def parent_breadcrumb(spark, sf):
    """The parents of a plan over nations, one for each of them and of their regions."""
    n = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = n.select("r_name", "n_name").orderBy("n_nationkey").collect()
    texts = ["ALL", *(f"region == {r} & nation != {c}" for r, c in rows), *("nation in " + ",".join(c for x, c in rows if x == r) for r in dict.fromkeys(r for r, _ in rows))]
    return spark.createDataFrame([(t, P.breadcrumb(t)) for t in texts], "parent string, breadcrumb string")


CHANNELS = [("l_quantity", "qty", "protein"), ("l_extendedprice", "price", "scatter"), ("l_discount", "rate", "protein"), ("l_tax", "rate", "livedead")]


@query("P3 N22", """SELECT r_name AS name, CASE r_regionkey WHEN 0 THEN 'l_quantity' WHEN 1 THEN 'l_discount' WHEN 2 THEN 'l_tax' END AS channel FROM region
UNION ALL SELECT 'l_tax', 'l_tax'""")
def channel_resolution(spark, sf):
    """Markers named as regions: of some a channel, of one two, of one a channel that isn't there, of one none."""
    columns = table(spark, sf, "lineitem").columns
    names = [r["r_name"] for r in table(spark, sf, "region").orderBy("r_regionkey").collect()]
    pairs = list(zip(("l_quantity", "l_discount", "gone", "gone"), names)) + [("l_tax", names[1]), ("l_tax", names[2])]
    return spark.createDataFrame([(n, P.resolve_channel(n, columns, pairs)) for n in [*names, "l_tax"]], "name string, channel string")


@query("P4", "SELECT coalesce(CASE \"Step02_c|d\" WHEN 'A' THEN 'Alpha' ELSE \"Step02_c|d\" END, '(missing)') AS label, count(*) AS n FROM cells GROUP BY 1")
def label_normalise(spark, sf):
    c = cells(spark, sf)
    return c.groupBy(F.coalesce(P.normalized("Step02_c|d", {"A": "Alpha"}), F.lit("(missing)")).alias("label")).agg(F.count("*").alias("n"))


@query("P5 N5", "SELECT sample, coalesce(\"Step02_c|d\", 'Unassigned') AS gt, 'Unassigned' AS absent_gt, count(*) AS n FROM cells WHERE \"Step01_a|b\" = 'O' GROUP BY ALL")
def reference_labels(spark, sf):
    c = cells(spark, sf)
    p = c.where(P.compile_predicate("Step01_a|b == O", c.columns))
    return p.groupBy("sample", P.reference_label("Step02_c|d", c.columns).alias("gt"), P.reference_label("Step77", c.columns).alias("absent_gt")).agg(F.count("*").alias("n"))


@query("P6 P7", "SELECT dataset, count(*) AS n, sum(x::FLOAT::DOUBLE) AS sum_x FROM cells WHERE x::FLOAT BETWEEN 10 AND 20 AND y::FLOAT BETWEEN 1000 AND 30000 GROUP BY 1")
def rectangle_predicate(spark, sf):
    c = cells(spark, sf).select("dataset", F.col("x").cast("float").alias("x"), F.col("y").cast("float").alias("y"))
    return c.where(Rect(10, 20, 1000, 30000).contains(F.col("x"), F.col("y"))).groupBy("dataset").agg(F.count("*").alias("n"), F.sum(F.col("x").cast("double")).alias("sum_x"))


@query("P8 N12", "SELECT event_type, count(*) AS n FROM ev WHERE y >= 10 AND y <= 60 AND x >= 1 AND x <= 1 + (y - 10) / 25 GROUP BY 1")
def polygon_predicate(spark, sf):
    e = ev(spark, sf)
    triangle = Polygon(((1.0, 10.0), (3.0, 60.0), (1.0, 60.0)))
    return e.where(triangle.contains(F.col("x"), F.col("y"))).groupBy("event_type").agg(F.count("*").alias("n"))


KINDS = ["scatter", "protein", "dna", "livedead", "tech"]


@query("P9", """SELECT row_number() OVER (ORDER BY tier, n_name)::INT AS ord, n_name AS channel FROM (
  SELECT n_name, CASE n_regionkey WHEN 1 THEN 1 WHEN 3 THEN 2 WHEN 0 THEN 3 WHEN 2 THEN 4 END AS tier FROM nation WHERE n_regionkey < 4)""")
def channels_by_kind(spark, sf):
    """Nations as channels, whose kind goes by their region; those of the last kind aren't used."""
    rows = table(spark, sf, "nation").select("n_name", "n_regionkey").collect()
    names = P.channels_by_kind([(n, "", KINDS[r]) for n, r in rows])
    return spark.createDataFrame(list(enumerate(names, 1)), "ord int, channel string")


@query("P10", """SELECT n_name AS channel, CASE WHEN marker <> '' AND count(*) OVER (PARTITION BY marker) = 1 THEN marker ELSE n_name END AS shown
FROM (SELECT n_name, CASE n_nationkey % 3 WHEN 0 THEN 'M' || n_nationkey WHEN 1 THEN 'R' || n_regionkey ELSE '' END AS marker FROM nation)""")
def display_names(spark, sf):
    """Nations as channels: some have a marker of their own, some share it, some have none."""
    rows = table(spark, sf, "nation").orderBy("n_nationkey").collect()
    marker = lambda r: (f"M{r['n_nationkey']}", f"R{r['n_regionkey']}", "")[r["n_nationkey"] % 3]
    return spark.createDataFrame(list(P.display_names([(r["n_name"], marker(r)) for r in rows]).items()), "channel string, shown string")


@query("P11", """SELECT sample, step1, step2, count(*) AS n FROM (
  SELECT sample, step1, CASE WHEN step1 = 'big' AND y > 50000 THEN 'rich' WHEN step1 = 'big' AND l_discount > 0.05 THEN 'cheap' END AS step2
  FROM (SELECT *, CASE WHEN x <= 10 THEN 'small' WHEN x > 10 THEN 'big' END AS step1 FROM cells)
) GROUP BY ALL""")
def boolean_gates_to_labels(spark, sf):
    from ..plans.cascade import labels_from_booleans

    c = cells(spark, sf).withColumns({"big": F.col("x") > 10, "small": F.col("x") <= 10, "big__cheap": F.col("l_discount") > 0.05, "big__rich": F.col("y") > 50000})
    steps = [("step1", "ALL", {"big": "big", "small": "small"}), ("step2", "step1 == big", {"cheap": "big__cheap", "rich": "big__rich"})]
    return labels_from_booleans(c, steps).groupBy("sample", "step1", "step2").agg(F.count("*").alias("n"))


@query("P12 J8 S8", """SELECT sample, count(*) AS n FROM cells WHERE sample IN (0, 1, 2, 3) AND sample NOT IN (2) GROUP BY 1 HAVING count(*) >= 50""")
def splits_semi_anti(spark, sf):
    from ..sources.dims import allowed_samples, splits

    s = splits(spark, {"g": {"d": {"train": ["0", "1"], "val": ["2"], "test": ["3"], "blacklist": ["2"]}}})
    c = cells(spark, sf).withColumn("dataset", F.lit("d")).withColumn("s", F.col("sample").cast("string"))
    ok = allowed_samples(s).withColumnRenamed("sample", "s")
    return c.join(ok, ["dataset", "s"], "left_semi").groupBy("sample").agg(F.count("*").alias("n")).where("n >= 50")


@query("P13 N11", """SELECT dataset, count(*) AS n FROM cells JOIN (
  SELECT dataset, quantile_cont(x, 0.01) AS x0, quantile_cont(x, 0.99) AS x1, quantile_cont(y, 0.01) AS y0, quantile_cont(y, 0.99) AS y1 FROM cells GROUP BY 1
) USING (dataset) WHERE x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1 GROUP BY 1""")
def quantile_trim(spark, sf):
    from ..operators.geometry import trimmed

    return trimmed(cells(spark, sf), ["dataset"], "x", "y").groupBy("dataset").agg(F.count("*").alias("n"))


@query("P14", "SELECT sample, CASE WHEN sample * 30 >= 100 THEN 'flow' ELSE 'cytof' END AS modality, count(*) AS n FROM cells GROUP BY ALL")
def modality(spark, sf):
    return cells(spark, sf).groupBy("sample", P.modality(F.col("sample") * 30).alias("modality")).agg(F.count("*").alias("n"))


@query("P15 U5", """SELECT c_mktsegment || ',' || CASE WHEN c_nationkey % 2 = 0 THEN 'Unassigned' ELSE 'a,Unassigned' END AS options,
  CASE WHEN c_nationkey % 2 = 0 THEN 'Unassigned,' ELSE '' END || CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment ELSE '' END AS kept, count(*) AS n FROM customer GROUP BY ALL""")
def option_completion(spark, sf):
    even, third = F.col("c_nationkey") % 2 == 0, F.col("c_custkey") % 3 == 0
    seg, none = F.col("c_mktsegment"), F.lit("Unassigned")
    d = table(spark, sf, "customer").select(F.array(seg, F.when(even, none).otherwise("a")).alias("cats"), F.array(F.when(even, none).otherwise("zz"), F.when(third, seg).otherwise("x"), F.when(even, none).otherwise("zz")).alias("given"))
    valid = F.array_distinct(F.filter("given", lambda v: F.array_contains("cats", v)))
    kept = F.when(F.col("given")[0] == none, F.concat(none, F.lit(","), F.array_join(F.array_remove(valid, "Unassigned"), ","))).otherwise(F.array_join(valid, ","))
    return d.groupBy(F.array_join(P.with_unassigned(F.col("cats")), ",").alias("options"), kept.alias("kept")).agg(F.count("*").alias("n"))


@query("P16", """SELECT n_nationkey AS rule, n_nationkey % 5 = 0 AS ok, CASE n_nationkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'ragged' WHEN 2 THEN 'unknown label' WHEN 3 THEN 'unsupported' ELSE 'valleys' END AS why FROM nation""")
def rule_validation(spark, sf):
    """A rule for each nation over its own name and its region's: right, ragged, with an unknown label, unsupported, of other valleys."""
    from ..operators.assign import check_rules

    n = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    p, q, kind = F.col("n_name"), F.col("r_name"), F.col("n_nationkey") % 5
    regions = F.when(kind == 1, F.array(F.array(p), F.array(q, q))).when(kind == 2, F.array(F.array(F.lit("?"), q), F.array(q, q))).when(kind != 3, F.array(F.array(p, q), F.array(q, q)))
    return check_rules(n.select(F.col("n_nationkey").alias("rule"), regions.alias("regions"), F.array(p, q).alias("categories"), F.when(kind == 4, 2).otherwise(1).alias("x_valleys"), F.lit(1).alias("y_valleys"), (kind != 3).alias("supported")))


@query("P17", "SELECT event_type, array_to_string(list_filter(['click>a', 'view>b'], lambda t: split_part(t, '>', 1) = event_type), ' ') AS kept, count(*) AS n FROM ev GROUP BY ALL")
def token_filter(spark, sf):
    tokens = F.array(F.lit("click>a"), F.lit("view>b"))
    return ev(spark, sf).groupBy("event_type", F.array_join(F.filter(tokens, lambda t: F.split_part(t, F.lit(">"), F.lit(1)) == F.col("event_type")), " ").alias("kept")).agg(F.count("*").alias("n"))


@query("U1 N18", """SELECT label, min(ord) AS ord FROM (
  SELECT * FROM (VALUES ('A', 0), ('Z', 1)) AS t(label, ord) UNION ALL SELECT DISTINCT coalesce("Step02_c|d", 'Unassigned'), 1000 FROM cells UNION ALL SELECT DISTINCT CASE WHEN x > 25 THEN 'H' ELSE 'L' END, 2000 FROM cells
) GROUP BY 1""")
def label_union(spark, sf):
    c = cells(spark, sf)
    listed = spark.createDataFrame([("A", 0), ("Z", 1)], "label string, ord int")
    gt = c.select(P.reference_label("Step02_c|d").alias("label"), F.lit(1000).alias("ord")).distinct()
    pred = c.select(F.when(F.col("x") > 25, "H").otherwise("L").alias("label"), F.lit(2000).alias("ord")).distinct()
    return listed.union(gt).union(pred).groupBy("label").agg(F.min("ord").alias("ord"))


@query("U2 U3", """SELECT 'missing' AS side, o_custkey AS id FROM (SELECT DISTINCT o_custkey FROM orders EXCEPT SELECT user_id FROM events)
UNION ALL SELECT 'extra', user_id FROM (SELECT DISTINCT user_id FROM events EXCEPT SELECT o_custkey FROM orders)""")
def set_differences(spark, sf):
    a = table(spark, sf, "orders").select(F.col("o_custkey").alias("id")).distinct()
    b = table(spark, sf, "events").select(F.col("user_id").alias("id")).distinct()
    return a.join(b, "id", "left_anti").select(F.lit("missing").alias("side"), "id").union(b.join(a, "id", "left_anti").select(F.lit("extra"), "id"))


@query("U4 L7", "SELECT src, count(*) AS n, sum(v) AS total FROM (SELECT 'events' AS src, value AS v FROM events UNION ALL SELECT 'orders', o_totalprice FROM orders) GROUP BY 1")
def pool_union(spark, sf):
    a = table(spark, sf, "events").select(F.lit("events").alias("src"), F.col("value").alias("v"))
    b = table(spark, sf, "orders").select(F.lit("orders").alias("src"), F.col("o_totalprice").alias("v"))
    return a.unionByName(b, allowMissingColumns=True).groupBy("src").agg(F.count("*").alias("n"), F.sum("v").alias("total"))


@query("U6", "SELECT user_id FROM events GROUP BY 1 HAVING count(DISTINCT event_type) = 5")
def complete_sets(spark, sf):
    return table(spark, sf, "events").groupBy("user_id").agg(F.countDistinct("event_type").alias("k")).where("k = 5").select("user_id")


@query("T15", "SELECT coalesce(list_position(['A', 'R', 'Unassigned'], \"Step02_c|d\") - 1, 2)::INT AS code, count(*) AS n FROM cells GROUP BY 1")
def label_codes(spark, sf):
    from ..operators.perturb import label_codes as codes

    return cells(spark, sf).groupBy(codes(P.quoted("Step02_c|d"), ["A", "R"]).alias("code")).agg(F.count("*").alias("n"))
