"""Perturbations, scaling and sampling (T)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import perturb as T
from .base import cells, ev, query, table


def _counts(df):
    return df.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


@query("T1", "SELECT event_type, count(*) AS n, sum(event_id)::BIGINT AS ids FROM ev WHERE event_type NOT IN ('click', 'view') GROUP BY 1")
def deplete_full(spark, sf):
    return _counts(T.Deplete("event_type", ("click", "view"), key="event_id")(ev(spark, sf)))


@query("T1 N16", """SELECT event_type, count(*) AS n, sum(event_id)::BIGINT AS ids FROM (
  SELECT *, event_type IN ('click', 'view') AS hit, row_number() OVER (PARTITION BY event_type IN ('click', 'view') ORDER BY md5('42:' || event_id), event_id) AS rk,
         count(*) OVER (PARTITION BY event_type IN ('click', 'view')) AS k FROM ev
) WHERE NOT (hit AND rk <= round_even(k * 0.3, 0)) GROUP BY 1""")
def deplete_frac(spark, sf):
    return _counts(T.parse_spec("deplete event_type click view frac=0.3", key="event_id")(ev(spark, sf)))


@query("T2", """SELECT event_type, count(*) AS n, sum(event_id)::BIGINT AS ids FROM (
  SELECT e.*, row_number() OVER (PARTITION BY event_type ORDER BY md5('7:' || event_id), event_id) AS rk,
         CASE event_type WHEN 'click' THEN 4 WHEN 'view' THEN 1 END AS w,
         (SELECT min(k / w) FROM (SELECT event_type, count(*) AS k, CASE event_type WHEN 'click' THEN 4 WHEN 'view' THEN 1 END AS w FROM ev WHERE event_type IN ('click', 'view') GROUP BY 1)) AS unit
  FROM ev e
) WHERE w IS NULL OR rk <= round_even(unit * w, 0) GROUP BY 1""")
def ratio_shift(spark, sf):
    return _counts(T.parse_spec("ratio_shift event_type click=4 view=1 seed=7", key="event_id")(ev(spark, sf)))


@query("T3 N23", "SELECT dataset, round(sum(x + 0.5), 4) AS sx, round(sum(l_discount - 0.25), 4) AS sd, round(sum(l_tax - 0.25), 4) AS st FROM cells GROUP BY 1")
def channel_shift(spark, sf):
    p = T.parse_spec("channel_shift x=0.5 rate=-0.25 none=3", channels=[("l_discount", "rate"), ("l_tax", "rate")])
    return p(cells(spark, sf)).groupBy("dataset").agg(F.round(F.sum("x"), 4).alias("sx"), F.round(F.sum("l_discount"), 4).alias("sd"), F.round(F.sum("l_tax"), 4).alias("st"))


@query("T4", "SELECT event_type, round(sum(asinh(sinh(x) * 1.5)), 4) AS sx FROM ev GROUP BY 1")
def channel_scale(spark, sf):
    return T.parse_spec("channel_scale x=1.5 y=1")(ev(spark, sf)).groupBy("event_type").agg(F.round(F.sum("x"), 4).alias("sx"))


@query("T5", "SELECT event_type, count(*) AS n, round(sum(asinh(sinh(x + 0.25) * 0.5)), 4) AS sx FROM ev WHERE event_type <> 'click' GROUP BY 1")
def compose(spark, sf):
    _, p = T.parse_specs(["deplete event_type click", "channel_shift x=0.25", "channel_scale x=0.5"], key="event_id")
    return p(ev(spark, sf)).groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("x"), 4).alias("sx"))


@query("T6 T7", """SELECT n_nationkey AS ord, CASE n_nationkey % 5
  WHEN 0 THEN 'deplete-' || regexp_replace(n_name, '[^A-Za-z0-9._+-]', '_', 'g') || '_SSC-A-pos' WHEN 1 THEN 'deplete-c-' || regexp_replace(n_name, '[^A-Za-z0-9._+-]', '_', 'g') || '-frac50-seed' || n_nationkey
  WHEN 2 THEN 'ratio_shift-c-a' || (n_nationkey + 1) || '.0-b1.0' WHEN 3 THEN 'channel_shift-m+0.5-n-' || n_nationkey ELSE 'deplete-c-v+channel_scale-mx' || n_nationkey END AS slug FROM nation""")
def perturbation_slugs(spark, sf):
    """A specification for each nation, of each kind in turn."""
    def specs(name, k):
        return [[f"deplete '{name}|SSC-A' pos"], [f"deplete c '{name}' frac=0.5 seed={k}"], [f"ratio_shift c a={k + 1} b=1"], [f"channel_shift m=0.5 n=-{k}"], ["deplete c v", f"channel_scale m={k}"]][k % 5]

    rows = table(spark, sf, "nation").select("n_nationkey", "n_name").collect()
    return spark.createDataFrame([(k, T.parse_specs(specs(n, k))[0]) for k, n in rows], "ord int, slug string")


TASKS = [
    T.HardTask("d1", "rare", "ds", 1, "event_type", deplete=("click",)),
    T.HardTask("s1", "drift", "ds", 1, "event_type", scales=(("x", 1.6), ("y", 0.8))),
    T.HardTask("s2", "drift", "ds", 1, "event_type", scales=((T.ALL_PROTEINS, 2.0),)),
]


@query("T8 T9 T10 S9", """SELECT n_nationkey AS task, CASE n_nationkey % 4 WHEN 0 THEN 1.0::DOUBLE ELSE 0.5 END AS magnitude,
  'h' || n_nationkey || CASE n_nationkey % 4 WHEN 1 THEN '_frac50' WHEN 2 THEN '_scale50' WHEN 3 THEN '_scale50' ELSE '' END AS name,
  CASE n_nationkey % 4 WHEN 0 THEN 'deplete-nation-' || replace(n_name, ' ', '_') WHEN 1 THEN 'deplete-nation-' || replace(n_name, ' ', '_') || '-frac50'
    WHEN 2 THEN 'channel_scale-xx1.3-yx0.9' ELSE 'channel_scale-' || (SELECT string_agg(r_name || 'x1.5', '-' ORDER BY r_regionkey) FROM region WHERE r_regionkey < 2) END AS slug FROM nation""")
def hard_tasks(spark, sf):
    """A registered task for each nation: it is depleted in whole or in part, or channels are scaled; regions name the markers."""
    nations = table(spark, sf, "nation").orderBy("n_nationkey").collect()
    regions = [r["r_name"] for r in table(spark, sf, "region").orderBy("r_regionkey").collect()]
    kinds = lambda r: {"deplete": (r["n_name"],)} if r["n_nationkey"] % 4 < 2 else {"scales": (("x", 1.6), ("y", 0.8)) if r["n_nationkey"] % 4 == 2 else ((T.ALL_PROTEINS, 2.0),)}
    reg = T.registry([T.HardTask(f"h{r['n_nationkey']}", "rare", "ds", 1, "nation", **kinds(r)) for r in nations], ("rare",))
    channels = [(f"c{i}", name, "protein" if i < 2 else "scatter") for i, name in enumerate(regions)]
    rows = []
    for r in nations:
        k = r["n_nationkey"]
        m = 0.5 if k % 4 else 1.0
        name, p = T.task_perturbation(f"h{k}", [], reg, magnitude=m, channels=channels if k % 4 == 3 else ())
        rows.append((k, m, name, p.slug))
    return spark.createDataFrame(rows, "task int, magnitude double, name string, slug string")


@query("T9", "SELECT event_type, round(sum(asinh(sinh(x) * 1.3)), 4) AS sx, round(sum(asinh(sinh(y / 50) * 0.9)), 4) AS sy FROM ev GROUP BY 1")
def hard_shift_applied(spark, sf):
    _, p = T.registry(TASKS, ("rare", "drift"))["s1"].at(0.5)
    e = ev(spark, sf).withColumn("y", F.col("y") / 50)
    return p(e).groupBy("event_type").agg(F.round(F.sum("x"), 4).alias("sx"), F.round(F.sum("y"), 4).alias("sy"))


@query("T11", """SELECT event_type, round(sum((least(greatest(value, a), b) - a) / (b - a) * 10), 4) AS scaled, round(sum(asinh(value / 5)), 4) AS transformed
FROM ev, (SELECT quantile_cont(value, 0.01) AS a, quantile_cont(value, 0.99) AS b FROM ev) GROUP BY 1""")
def minmax_clip(spark, sf):
    e = ev(spark, sf)
    return T.clip_scale(e, "value").groupBy("event_type").agg(F.round(F.sum("value"), 4).alias("scaled"), F.round(F.sum("x"), 4).alias("transformed"))


@query("T12", "SELECT event_type, round(avg((x - m) / s), 4) AS mean_z, round(max((x - m) / s), 4) AS max_z FROM ev, (SELECT avg(x) AS m, stddev_pop(x) AS s FROM ev) GROUP BY 1")
def zscore(spark, sf):
    e = ev(spark, sf)
    return T.standardize(e, T.fit_standard(e, ["x"])).groupBy("event_type").agg(F.round(F.avg("x"), 4).alias("mean_z"), F.round(F.max("x"), 4).alias("max_z"))


@query("T13 S3 L6", "SELECT event_id, value FROM ev ORDER BY md5('3:' || event_id), event_id LIMIT 250")
def seed_sample(spark, sf):
    return T.sample_exact(ev(spark, sf), 250, 3, "event_id").select("event_id", "value")


@query("T13 S4", "SELECT event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY md5('3:' || event_id), event_id) AS rk FROM ev) WHERE rk <= 40")
def seed_sample_by_group(spark, sf):
    return T.sample_exact_by(ev(spark, sf), ["event_type"], 40, 3, "event_id").select("event_type", "event_id")


@query("T14", "SELECT DISTINCT replace(replace(replace(replace(event_type || ' CD45RA CD45 CD4', 'CD45RA', chr(1)), 'CD45', 'M1'), 'CD4', 'M2'), chr(1), 'CD45RA') AS text FROM ev")
def anonymise(spark, sf):
    t = T.replace_names(F.concat(F.col("event_type"), F.lit(" CD45RA CD45 CD4")), {"CD4": "M2", "CD45": "M1"}, ["CD45RA"])
    return ev(spark, sf).select(t.alias("text")).distinct()
