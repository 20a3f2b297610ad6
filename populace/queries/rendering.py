"""Prompt rendering over aggregated rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import render as R
from ..operators import density as D
from ..operators import windows as W
from .base import cells, ev, query, table

_H8 = "h AS (SELECT e.event_type, bin, count(v.event_id) AS n FROM (SELECT DISTINCT event_type FROM ev) e CROSS JOIN (SELECT i::INT AS bin FROM range(8) AS r(i)) LEFT JOIN (SELECT event_type, event_id, least(greatest(floor((x - a) / (b - a) * 8), 0), 7)::INT AS bin FROM ev JOIN (SELECT event_type, min(x) AS a, max(x) AS b FROM ev GROUP BY 1) USING (event_type)) v USING (event_type, bin) GROUP BY ALL)"


@query("D1 R1", f"WITH {_H8} SELECT event_type, string_agg(substr(' .:-=+*#@', ceil(n * 8 / m)::INT + 1, 1), '' ORDER BY bin) AS bar FROM h JOIN (SELECT event_type, max(n) AS m FROM h GROUP BY 1) USING (event_type) GROUP BY 1")
def density_bars(spark, sf):
    h = D.histogram(ev(spark, sf), ["event_type"], "x", 8)
    counts = F.transform(F.array_sort(F.collect_list(F.struct("bin", "n"))), lambda s: s["n"])
    return h.groupBy("event_type").agg(counts.alias("counts")).select("event_type", R.density_bar(F.col("counts")).alias("bar"))


@query("A20 R2", """SELECT dataset, '## context' || chr(10) || 'qty of ' || dataset || chr(10) || chr(10) || '## summary' || chr(10)
  || printf('qty: n=%d, %.2f to %.2f, quartiles %.2f / %.2f / %.2f', count(*), min(x), max(x), quantile_cont(x, 0.25), quantile_cont(x, 0.5), quantile_cont(x, 0.75)) || chr(10) || chr(10)
  || '## options' || chr(10) || 'options: A | B | Unassigned' AS prompt FROM cells GROUP BY 1""")
def gate_prompt(spark, sf):
    s = W.axis_summary(cells(spark, sf), ["dataset"], "x").join(cells(spark, sf).groupBy("dataset").agg(F.count("*").alias("n")), "dataset")
    parts = {
        "context": F.concat(F.lit("qty of "), "dataset"),
        "summary": R.axis_line(F.lit("qty"), F.col("n"), F.col("min"), F.col("max"), [F.col(c) for c in ("q25", "q50", "q75")]),
        "options": R.options_line(F.array(F.lit("A"), F.lit("B"))),
    }
    return s.select("dataset", R.prompt(parts).alias("prompt"))


@query("T14 R3", "SELECT dataset, '## summary' || chr(10) || 'M1 in ' || dataset AS prompt FROM cells GROUP BY 1")
def anonymous_prompt(spark, sf):
    s = cells(spark, sf).select("dataset").distinct()
    return s.select("dataset", R.prompt({"summary": F.concat(F.lit("qty in "), "dataset")}, "anon", {"qty": "M1"}).alias("prompt"))


@query("W4 S14 R4", """SELECT string_agg('## cell_' || slot || chr(10) || s, chr(10) || chr(10) ORDER BY slot) AS prompt FROM (
  SELECT row_number() OVER (ORDER BY event_type) - 1 AS slot, event_type || ' x' || count(*) AS s FROM ev GROUP BY event_type)""")
def cells_prompt(spark, sf):
    n = W.dense_ids(ev(spark, sf).groupBy("event_type").agg(F.count("*").alias("n")), "event_type")
    rows = n.select(F.lit(1).alias("g"), F.col("id").cast("int").alias("slot"), F.concat("event_type", F.lit(" x"), "n").alias("s"))
    return R.cells_prompt(rows, ["g"], "slot", "s").select("prompt")


@query("D3 R5", """SELECT n_nationkey AS id, 'peaks: ' || CASE n_nationkey % 3 WHEN 0 THEN 'none' WHEN 1 THEN printf('%.2f', n_nationkey / 4.0) ELSE printf('%.2f, %.2f', n_nationkey / 4.0, n_regionkey / 2.0) END AS text FROM nation""")
def points_text(spark, sf):
    """No, one or two points for each nation."""
    both = F.array(F.col("n_nationkey") / 4.0, F.col("n_regionkey") / 2.0)
    d = table(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), F.slice(both, F.lit(1), F.col("n_nationkey") % 3).alias("at"))
    return d.select("id", R.points_line("peaks", F.col("at")).alias("text"))


@query("D3", "SELECT i, round(avg((abs(x - (a + (b - a) * i / 4)) <= 0.05 * (b - a))::INT), 6) AS near FROM ev, (SELECT min(x) AS a, max(x) AS b FROM ev), (SELECT i::INT AS i FROM range(5) AS r(i)) GROUP BY 1")
def fraction_near(spark, sf):
    e = ev(spark, sf)
    a, b = e.agg(F.min("x"), F.max("x")).first()
    return D.fraction_near(e, "x", [a + (b - a) * i / 4 for i in range(5)]).select("i", F.round("near", 6).alias("near"))


@query("D8", """SELECT floor(x)::BIGINT AS basin, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share, round(avg(x), 6) AS x_mean, round(stddev_pop(x), 6) AS x_std, min(x) AS x_min, max(x) AS x_max, round(avg(y), 6) AS y_mean, round(stddev_pop(y), 6) AS y_std, min(y) AS y_min, max(y) AS y_max FROM ev GROUP BY 1""")
def basin_stats(spark, sf):
    out = D.basin_stats(ev(spark, sf).withColumn("basin", F.floor("x")), ["basin"], "x", "y")
    return out.select("basin", "n", *(F.round(c, 6).alias(c) for c in ("share", "x_mean", "x_std")), "x_min", "x_max", *(F.round(c, 6).alias(c) for c in ("y_mean", "y_std")), "y_min", "y_max")
