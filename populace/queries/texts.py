"""Model answers (E), work lists (L, K7, C4-C7), sources and sinks (S, K)."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..functions import responses as R
from ..operators import pool as P
from ..sources import files as S
from .base import ev, query, table

ANSWERS = [
    '<think>{"a": 1}</think>Sure:\n```json\n{"pos": {"x_min": %d, "x_max": %d, "y_min": 1, "y_max": 3}, "neg": {"absent": true}}\n```',
    'text {"pos": [{"x_min": %d, "x_max": %d, "y_min": 0, "y_max": 1}, {"vertices": [[0, 0], [1, 0], [1, 1]]}], "neg": {"x_min": 5, "x_max": 4, "y_min": 0, "y_max": 1}} end',
]


@query("E1", """SELECT s_suppkey AS id, category, kind, lo + s_suppkey AS x_min, hi + s_suppkey AS x_max FROM supplier
JOIN (VALUES (0, 'pos', 'rect', 0.0::DOUBLE, 2.0::DOUBLE), (0, 'neg', 'absent', NULL, NULL), (1, 'pos', 'rect', 0.0, 1.0), (1, 'pos', 'polygon', NULL, NULL), (1, 'neg', 'missing', NULL, NULL), (2, 'pos', 'missing', NULL, NULL), (2, 'neg', 'missing', NULL, NULL)) AS t(k, category, kind, lo, hi) ON s_suppkey % 3 = k""")
def parse_gates(spark, sf):
    """An answer for each supplier: fenced after thoughts, in a sentence with several gates, or none."""
    k = F.col("s_suppkey")
    text = F.when(k % 3 == 0, F.format_string(ANSWERS[0], k, k + 2)).when(k % 3 == 1, F.format_string(ANSWERS[1], k, k + 1)).otherwise(F.concat(F.lit("no json here: "), "s_name"))
    return R.parse_gates(table(spark, sf, "supplier").select(k.alias("id"), text.alias("text")), "text", ["pos", "neg"], ["id"]).select("id", "category", "kind", "x_min", "x_max")


@query("E2", """SELECT c_custkey AS id, 'cell_' || i AS cell, CASE WHEN i = 1 THEN c_mktsegment WHEN c_custkey % 2 = 1 THEN 'NK' END AS annotation FROM customer, (VALUES (1), (2)) AS t(i)""")
def parse_cells(spark, sf):
    """An answer for each customer: after other JSON, or begun twice."""
    seg = F.col("c_mktsegment")
    one = F.concat(F.lit('noise {"z": 1} {"cell_1": {"annotation": "'), seg, F.lit('", "rationale": "r"}}'))
    two = F.concat(F.lit('cut { "cell_1": "'), seg, F.lit('" ... {"cell_1": {"annotation": "'), seg, F.lit('"}, "cell_2": "NK"}'))
    a = table(spark, sf, "customer").select(F.col("c_custkey").alias("answer"), F.when(F.col("c_custkey") % 2 == 0, one).otherwise(two).alias("text"), F.array(F.lit("cell_1"), F.lit("cell_2")).alias("ids"))
    return R.parse_cells(a, "text", "ids", ["answer"]).select(F.col("answer").alias("id"), F.col("id").alias("cell"), "annotation")


@query("E3", """SELECT n_nationkey AS id, 'c' || i AS cluster, CASE i WHEN 1 THEN 'a,b' WHEN 2 THEN '' ELSE CASE WHEN n_regionkey < 2 THEN 'b' ELSE '' END END AS leaves,
  CASE i WHEN 1 THEN 1 WHEN 2 THEN 0 ELSE CASE WHEN n_regionkey < 2 THEN 0 ELSE 1 END END AS n_invalid FROM nation, (VALUES (1), (2), (3)) AS t(i)""")
def leaf_parse(spark, sf):
    """An answer for each nation, whose name is no leaf."""
    name = F.col("n_name")
    text = F.concat(F.lit('{"c1": {"leaves": ["a", "'), name, F.lit('", "b", "a"]}, "c2": {"leaves": null}, "c3": {"leaves": ["'), F.when(F.col("n_regionkey") < 2, "b").otherwise(name), F.lit('"], "rationale": "r"}}'))
    a = table(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), text.alias("text"))
    return R.parse_leaves(a, "text", ["a", "b"], ["id"]).select("id", "cluster", F.array_join("leaves", ",").alias("leaves"), "n_invalid")


@query("E4", "SELECT user_id % 3 AS sample, event_type AS key, count(*)::VARCHAR AS value FROM ev GROUP BY ALL")
def assemble_flatten(spark, sf):
    n = ev(spark, sf).groupBy((F.col("user_id") % 3).alias("sample"), "event_type").agg(F.count("*").cast("string").alias("n"))
    return R.flatten(R.assemble(n, ["sample"], "event_type", "n"), ["sample"], "doc")


@query("E5", "SELECT c_custkey AS id, c_name AS text FROM customer")
def think_strip(spark, sf):
    """An answer for each customer: thoughts closed, closed but not opened, or not closed."""
    k, name = F.col("c_custkey"), F.col("c_name")
    text = F.when(k % 3 == 0, F.concat(F.lit("<think>a</think>"), name)).when(k % 3 == 1, F.concat(F.lit("lost </think> "), name)).otherwise(F.concat(name, F.lit(" <think> open")))
    return table(spark, sf, "customer").select(k.alias("id"), R.without_thinking(text).alias("text"))


@query("S14", "SELECT c_custkey AS prompt, (CASE i WHEN 1 THEN c_custkey ELSE c_nationkey END)::INT AS cell FROM customer, (VALUES (1), (2)) AS t(i)")
def prompt_cells(spark, sf):
    text = F.format_string("intro\n## cell_%d\nx\n## cell_%d\n ## cell_9", F.col("c_custkey"), F.col("c_nationkey"))
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("prompt"), F.explode(R.prompt_cells(text)).alias("cell"))


@query("E3 S11", "SELECT json_extract(props, '$.k')::BIGINT AS k, count(*) AS n FROM events GROUP BY 1")
def json_props(spark, sf):
    return table(spark, sf, "events").groupBy(F.get_json_object("props", "$.k").cast("long").alias("k")).agg(F.count("*").alias("n"))


@query("L4", "SELECT shard, count(*) AS n, sum(event_id)::BIGINT AS ids FROM (SELECT event_id, ((row_number() OVER (ORDER BY value, event_id) - 1) % 4)::INT AS shard FROM ev) GROUP BY 1")
def shard_rr(spark, sf):
    return P.round_robin(ev(spark, sf), ["value", "event_id"], 4).groupBy("shard").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


@query("L3", """SELECT name, shard FROM (WITH RECURSIVE it AS (SELECT n_name AS name, length(n_name)::BIGINT AS size, row_number() OVER (ORDER BY length(n_name) DESC, n_name) AS k FROM nation),
s AS (SELECT 0::BIGINT AS k, '' AS name, 0 AS shard, [0, 0, 0, 0]::BIGINT[] AS load
      UNION ALL SELECT it.k, it.name, list_position(load, list_min(load))::INT - 1, list_transform(load, lambda v, i: CASE WHEN i = list_position(load, list_min(load)) THEN v + it.size ELSE v END)
      FROM s JOIN it ON it.k = s.k + 1)
SELECT name, shard FROM s WHERE k > 0)""")
def pool_lpt(spark, sf):
    sizes = table(spark, sf, "nation").select("n_name", F.length("n_name").alias("n")).collect()  # a fixed list
    return spark.createDataFrame(sorted(P.longest_first([(r[0], r[1]) for r in sizes], 4).items()), "name string, shard int")


@query("L5 L1", "SELECT event_type, event_id FROM ev QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) <= 5")
def top_n_per_group(spark, sf):
    return P.top_per_group(ev(spark, sf), ["event_type"], [F.desc("value"), F.col("event_id")], 5).select("event_type", "event_id")


@query("L2", "SELECT event_type, count(*) AS n, max(event_id) AS last FROM ev GROUP BY 1")
def locality(spark, sf):
    return P.by_locality(ev(spark, sf), ["event_type"], ["event_id"]).groupBy("event_type").agg(F.count("*").alias("n"), F.max("event_id").alias("last"))


@query("K7 U3", "SELECT event_id, event_type FROM ev")
def merged_shards(spark, sf):
    parts = ev(spark, sf).select("event_id", "event_type", F.pmod("event_id", F.lit(3)).cast("int").alias("shard"), F.lit(3).alias("n_shards"))
    return P.merge_shards(parts, ["event_id"], 3)


@query("C6", "SELECT event_id FROM ev WHERE event_id % 4 <> 0")
def remaining_work(spark, sf):
    e = ev(spark, sf)
    return P.missing(e, e.where("event_id % 4 = 0"), ["event_id"])


@query("S1 S2 M1 M2", "SELECT count(*) AS n, count(DISTINCT row_id) AS ids, count(*) FILTER (label IS NULL) AS missing FROM (SELECT l_orderkey, row_number() OVER () AS row_id, nullif(nullif(l_linestatus, ''), 'zz') AS label FROM lineitem)")
def sample_scan(spark, sf):
    c = S.scan_samples(spark, f"{sf}/lineitem.parquet", labels=["l_linestatus"])
    return c.agg(F.count("*").alias("n"), F.countDistinct("sample", "row_id").alias("ids"), F.count_if(F.col("l_linestatus").isNull()).alias("missing"))


@query("S5 S8 M3 M4", """SELECT 'c' || n_nationkey AS channel, n_name AS marker, CASE WHEN n_regionkey < 2 THEN 'protein' ELSE 'scatter' END AS kind, (row_number() OVER (ORDER BY n_nationkey) - 1)::INT AS ord FROM nation""")
def channel_metadata(spark, sf):
    """Nations as the channels of a panel."""
    rows = table(spark, sf, "nation").orderBy("n_nationkey").collect()
    return S.channels(spark, {"channels": {f"c{r['n_nationkey']}": [r["n_name"], "protein" if r["n_regionkey"] < 2 else "scatter"] for r in rows}})


@query("S12 S13", """SELECT 's' || (s_suppkey % 4) AS scenario, 'ds' || s_nationkey AS dataset, (s_suppkey % 9 + 1)::INT AS step, '0.5' AS magnitude, 'p' || s_suppkey AS sample, (s_suppkey % 7 + 1)::INT AS task_step FROM supplier""")
def result_paths(spark, sf):
    k, n = F.col("s_suppkey"), F.col("s_nationkey")
    path = F.format_string("/out/s%d/ds%d_step%02d/frac_0.5/ds%d/p%d/step_%02d/prediction.json", k % 4, n, k % 9 + 1, n, k, k % 7 + 1)
    return S.path_parts(table(spark, sf, "supplier").select(path.alias("path")), "path")


@query("S11 K1 M7", "SELECT event_type AS label, count(*) AS n FROM ev GROUP BY 1")
def prediction_round_trip(spark, sf):
    e = ev(spark, sf).select((F.col("event_id") % 3).alias("sample"), F.col("event_id").alias("pos"), F.col("event_type").alias("label"))
    return S.read_predictions(S.write_predictions(e, ["sample"])).groupBy("label").agg(F.count("*").alias("n"))


@query("S15 K4", "SELECT n_nationkey, n_name FROM nation")
def csv_round_trip(spark, sf):
    n = table(spark, sf, "nation").select("n_nationkey", "n_name")
    return S.csv_round_trip(n)


@query("K3 K8 K9 S16", "SELECT (user_id % 5)::INT AS slot, count(*) AS n FROM ev GROUP BY 1")
def cluster_map_round_trip(spark, sf):
    m = ev(spark, sf).select("event_id", (F.col("user_id") % 5).alias("slot"))
    return S.round_trip(m, ["slot"]).groupBy("slot").agg(F.count("*").alias("n"))


@query("C5 C4", "SELECT event_id::VARCHAR AS key, upper(event_type) AS answer, 1 AS attempts, 'ok' AS status FROM ev")
def remote_calls(spark, sf):
    from ..operators.remote import call

    e = ev(spark, sf).select(F.col("event_id").cast("string").alias("key"), F.col("event_type").alias("prompt"))
    out = call(e, lambda p: p.upper(), attempts=3)
    return out.select("key", "answer", "attempts", "status")


@query("K6 S7", "SELECT event_type AS gt, CASE WHEN value > 60 THEN 'hi' ELSE 'lo' END AS pred, count(*) AS n FROM ev GROUP BY ALL")
def streaming_confusion(spark, sf):
    from ..streaming.incremental import stream_confusion

    return stream_confusion(spark, f"{sf}/events.parquet", F.col("event_type"), F.when(F.col("value") > 60, "hi").otherwise("lo"))
