"""Files and folders that queries write and read again (S, K), guards on predictions (J1, J6),
checkpointed calls (C7) and the reports that go with them."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions import render as R
from ..functions import responses as A
from ..operators import gates as G
from ..operators import metrics as M
from ..operators import multilabel as ML
from ..operators import perturb as T
from ..operators import remote
from ..plans import cascade
from ..plans.flagship import shared_folder
from ..sources import files as S
from ..sources import tasks as K
from .base import cells, ev, query, table
from .scoring import CONF, LEAVES, PER, SETS, _pairs, _raters, _sets


def _folder(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


STEPS = [
    K.TaskStep(1, "Step01_a|b", "ALL", "x", "y", ("O",)),
    K.TaskStep(2, "Step02_c|d", "Step01_a|b == O", "x", "y", ("A", "R", "X")),
    K.TaskStep(3, "Step02_c|d", "Step01_a|b == nothing", "x", "y", ("A",)),
    K.TaskStep(4, "Step02_c|d", "ALL", "x", "no marker", ("A",)),
]


@query("K2 S6 A1", """WITH s AS (SELECT dataset, sample, 1 AS step, 'ALL' AS parent, coalesce("Step01_a|b", 'Unassigned') AS label FROM cells
  UNION ALL SELECT dataset, sample, 2, 'Step01_a|b == O', coalesce("Step02_c|d", 'Unassigned') FROM cells WHERE "Step01_a|b" = 'O'),
 t AS (SELECT dataset, sample, step, parent, count(*) AS n_parent FROM s GROUP BY ALL HAVING count(*) >= 100)
SELECT t.dataset, t.sample::VARCHAR AS sample, t.step, t.parent, c.category, t.n_parent, count(s.label) AS n, round(count(s.label) / t.n_parent, 4) AS share
FROM t JOIN (VALUES (1, 'O'), (1, 'Unassigned'), (2, 'A'), (2, 'R'), (2, 'X'), (2, 'Unassigned')) AS c(step, category) USING (step)
LEFT JOIN s ON s.dataset = t.dataset AND s.sample = t.sample AND s.step = t.step AND s.label = c.category GROUP BY t.dataset, t.sample, t.step, t.parent, c.category, t.n_parent""")
def task_documents(spark, sf):
    path = _folder(spark, "tasks")
    K.write_tasks(K.tasks(cells(spark, sf), STEPS), path, {"name": "cells", "n_steps": len(STEPS)})
    t = S.read_tasks(spark, f"{path}/tasks", steps=(1, 2, 3), min_cells=100, pattern="*.json")
    g = "gt_summary"
    t = t.select("dataset", "sample", "step", "parent", F.col(f"{g}.n_parent_cells").alias("n_parent"), F.col(f"{g}.population_proportions").alias("p"), F.explode(f"{g}.n_cells_per_category").alias("category", "n"))
    return t.select("dataset", "sample", "step", "parent", "category", "n_parent", "n", F.element_at("p", F.col("category")).alias("share"))


@query("S9 J7", "SELECT 'rare' AS scenario, event_type, count(*) AS n FROM ev WHERE event_type IN ('click', 'view') GROUP BY ALL")
def registry_files(spark, sf):
    e, path = ev(spark, sf), _folder(spark, "registry")
    kinds = sorted(r[0] for r in e.select("event_type").distinct().collect())  # a row a kind
    scenario = lambda k: "rare" if k in ("click", "view") else "drift"
    K.write_document(spark, path, {"scenarios": {"rare": {"description": "few"}, "drift": {"description": "moved"}}, "tasks": [{"hard_id": f"t_{k}", "scenario": scenario(k), "dataset": k, "step": 1, "step_column": "s1", "deplete": ["a"]} for k in kinds]})
    reg = K.registry(spark, path, scenarios=["rare"])
    return e.join(reg.select("scenario", F.col("dataset").alias("event_type")), "event_type").groupBy("scenario", "event_type").agg(F.count("*").alias("n"))


@query("S10", "SELECT DISTINCT event_type AS dataset, 1 AS step, 'about ' || event_type || chr(10) || 'seen by ' || event_type AS note FROM ev")
def notes_files(spark, sf):
    want, path = ev(spark, sf).select(F.col("event_type").alias("dataset"), F.lit(1).alias("step")).distinct(), _folder(spark, "notes")
    K.write_document(spark, path, {r["dataset"]: {1: {"definition": f"about {r['dataset']} ", "oracle": f"seen by {r['dataset']}"}} for r in want.collect()})
    return K.notes_of(spark, path, want, "definition_oracle")


@query("S5 P10", "SELECT 5.0::DOUBLE AS cofactor, r_name AS channel, lower(r_name) AS marker, CASE WHEN r_regionkey % 2 = 0 THEN 'protein' ELSE 'unknown' END AS kind, r_regionkey::INT AS ord FROM region")
def metadata_files(spark, sf):
    path = _folder(spark, "meta")
    r = table(spark, sf, "region").orderBy("r_regionkey").collect()  # a fixed list
    K.write_document(spark, path, {"cohort": "c", "cofactor": 5, "channels": {x["r_name"]: [x["r_name"].lower(), "protein"][: 2 - x["r_regionkey"] % 2] for x in r}})
    return S.read_channels(spark, path).select("cofactor", "channel", "marker", "kind", "ord")


@query("S17", "SELECT event_type AS dataset, (user_id % 3)::VARCHAR AS sample, 1 AS step, round(avg(x), 4) AS x_threshold, 2 AS n_y FROM ev GROUP BY ALL")
def threshold_documents(spark, sf):
    path = _folder(spark, "thresholds")
    by = ev(spark, sf).groupBy(F.col("event_type").alias("dataset"), (F.col("user_id") % 3).alias("sample")).agg(F.array(F.round(F.avg("x"), 4)).alias("x_thresholds"), F.array(F.min("y"), F.max("y")).alias("y_thresholds"))
    by.withColumn("step", F.lit("step_01")).write.partitionBy("dataset", "sample", "step").json(path)
    t = K.threshold_files(spark, path)
    return t.select("dataset", "sample", "step", F.get("x_thresholds", 0).alias("x_threshold"), F.size("y_thresholds").alias("n_y"))


@query("S12 S13 K1", "SELECT DISTINCT event_type AS scenario, 'ds' AS dataset, 3 AS step, 'depletion' AS mode, (user_id % 2 + 1) / 2 AS magnitude, (user_id % 3)::VARCHAR AS sample, 2 AS task_step FROM ev")
def result_tree_walk(spark, sf):
    path = _folder(spark, "results")
    e = ev(spark, sf).select(F.col("event_type").alias("scenario"), F.lit("ds").alias("dataset"), F.lit(3).alias("step"), F.lit("depletion").alias("mode"), ((F.col("user_id") % 2 + 1) / 2).alias("magnitude"), (F.col("user_id") % 3).cast("string").alias("sample"), F.lit(2).alias("task_step"), "event_id")
    at = [c for c in e.columns if c != "event_id"]
    K.write_results(e.groupBy(*at).agg(F.count("*").alias("n_cells")), path)
    tree = K.result_tree(spark, path)
    K.one_mode(tree)
    return tree.join(K.outputs(tree, datasets=["ds"]), ["dataset", "sample"], "left_semi").select(*at).distinct()


_GUARD = "p AS (SELECT user_id % 6 AS sample, event_type AS gt, CASE WHEN value > 60 THEN 'view' ELSE event_type END AS pred FROM ev)"


def _predicted(spark, sf):
    """Reference rows, predictions read from files (one cut short, one of another perturbation), and tasks."""
    from pyspark.sql import Window

    # a task's rows are numbered as they stand in its file
    e = ev(spark, sf).select((F.col("user_id") % 6).cast("string").alias("sample"), "event_id", F.col("event_type").alias("gt"), F.when(F.col("value") > 60, "view").otherwise(F.col("event_type")).alias("pred"))
    gt = e.withColumn("pos", F.row_number().over(Window.partitionBy("sample").orderBy("event_id")) - 1)
    docs = gt.groupBy("sample").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "pred"))), lambda s: s["pred"]).alias("labels"))
    cut = F.when(F.col("sample") == "2", F.slice("labels", 1, F.size("labels") - 1)).otherwise(F.col("labels"))
    path = _folder(spark, "predictions")
    docs.where("sample <> '5'").select("sample", F.when(F.col("sample") == "4", "frac50").otherwise("none").alias("slug"), cut.alias("predicted_labels")).write.json(path)
    got = spark.read.schema("sample string, slug string, predicted_labels array<string>").json(path)
    return gt.select("sample", "pos", "gt"), got, docs.select("sample", F.lit("none").alias("slug"))


@query("J1 J6 K1", f"WITH {_GUARD} SELECT sample::VARCHAR AS sample, gt, pred, count(*) AS n FROM p WHERE sample NOT IN (2, 4, 5) GROUP BY ALL")
def guarded_predictions(spark, sf):
    return M.confusion(K.paired(*_predicted(spark, sf), ["sample"]), ["sample"])


@query("J1 J6", f"WITH {_GUARD} SELECT DISTINCT sample::VARCHAR AS sample, CASE sample WHEN 2 THEN 'other length' WHEN 4 THEN 'other perturbation' ELSE 'no prediction' END AS why FROM p WHERE sample IN (2, 4, 5)")
def passed_over_predictions(spark, sf):
    return K.passed_over(*_predicted(spark, sf), ["sample"])


@query("A8 A9", f"""WITH {CONF}, {PER}, j AS (SELECT *, CASE WHEN n_gt >= 20 THEN tp / (n_gt + n_pred - tp) END AS iou, label = 'A' AS d FROM cls WHERE label <> 'Unassigned' AND sample < 6)
SELECT sample, count(*) FILTER (d) AS n_depleted, count(*) FILTER (NOT d) AS n_siblings, round(avg(r) FILTER (d AND n_gt > 0), 4) AS recall_depleted, round(avg(iou) FILTER (d), 4) AS iou_depleted,
  round(avg(r) FILTER (NOT d AND n_gt > 0), 4) AS recall_siblings, round(avg(iou) FILTER (NOT d), 4) AS iou_siblings FROM j GROUP BY 1""")
def depleted_and_siblings(spark, sf):
    per = M.class_metrics(M.confusion(_pairs(spark, sf), ["sample"]), ["sample"])
    per = per.withColumn("iou", F.when(F.col("n_gt") >= 20, F.col("tp") / (F.col("n_gt") + F.col("n_pred") - F.col("tp"))))
    depleted = per.where("sample < 6").select("sample").distinct().withColumn("label", F.lit("A"))
    out = M.depleted_split(per, ["sample"], depleted)
    return out.select("sample", "n_depleted", "n_siblings", *(F.round(c, 4).alias(c) for c in ("recall_depleted", "iou_depleted", "recall_siblings", "iou_siblings")))


@query("A8 A5")
def depleted_hulls(spark, sf):
    """The same with the overlap of hulls."""
    from ..operators import geometry

    e = ev(spark, sf).select("event_type", "x", "y", F.when(F.col("y") > 50, "up").otherwise("down").alias("gt"), F.when(F.col("y") > 45, "up").otherwise("down").alias("pred"))
    per = M.class_metrics(M.confusion(e, ["event_type"]), ["event_type"])
    per = per.join(geometry.class_overlap(e, ["event_type"], "gt", "pred", "x", "y"), ["event_type", "label"], "left")
    return M.depleted_split(per, ["event_type"], per.select("event_type").distinct().withColumn("label", F.lit("up")))


@query("A10", f"""WITH {SETS}, m AS (SELECT sample, leaf, list_contains(g, leaf) AS ig, list_contains(p, leaf) AS ip FROM sets, (VALUES ('hi'), ('view'), ('late'), ('Discard')) AS v(leaf))
SELECT sample, leaf, round(CASE WHEN count(*) FILTER (ip) > 0 THEN count(*) FILTER (ig AND ip) / count(*) FILTER (ip) ELSE 0 END, 4) AS "precision", round(CASE WHEN count(*) FILTER (ig) > 0 THEN count(*) FILTER (ig AND ip) / count(*) FILTER (ig) ELSE 0 END, 4) AS recall,
  round(CASE WHEN count(*) FILTER (ig) + count(*) FILTER (ip) > 0 THEN 2 * count(*) FILTER (ig AND ip) / (count(*) FILTER (ig) + count(*) FILTER (ip)) ELSE 0 END, 4) AS f1, count(*) FILTER (ig) AS gt_support, count(*) FILTER (ip) AS pred_support FROM m GROUP BY ALL""")
def multilabel_report(spark, sf):
    return ML.report(_sets(spark, sf), ["sample"], "g", "p", [*LEAVES, "Discard"])


@query("A10", f"WITH {SETS} SELECT sample, count(*) AS n, count(*) FILTER (g = ['Discard']) AS n_gt_discard, count(*) FILTER (len(g) > 1) AS n_gt_multi, count(*) FILTER (p = ['Discard']) AS n_pred_discard, count(*) FILTER (len(p) > 1) AS n_pred_multi FROM sets GROUP BY 1")
def set_sizes(spark, sf):
    return ML.set_sizes(_sets(spark, sf), ["sample"], "g", "p")


@query("A11", """WITH c AS (SELECT user_id % 4 AS sample, CASE WHEN event_id % 5 = 0 THEN 'late' WHEN event_type = 'view' THEN 'view' WHEN value > 60 THEN 'hi' ELSE 'Discard' END AS gt,
  CASE WHEN event_type = 'view' AND event_id % 11 <> 0 THEN 'view' WHEN value > 50 THEN 'hi' ELSE 'Discard' END AS pred, count(*) AS n FROM ev GROUP BY ALL),
 l AS (SELECT sample, gt AS label FROM c UNION SELECT sample, pred FROM c),
 k AS (SELECT l.sample, l.label, coalesce(sum(n) FILTER (gt = label AND pred = label), 0) AS tp, coalesce(sum(n) FILTER (gt = label), 0) AS g, coalesce(sum(n) FILTER (pred = label), 0) AS p FROM l JOIN c USING (sample) GROUP BY ALL),
 t AS (SELECT sample, sum(n)::BIGINT AS n_cells, sum(n) FILTER (gt = pred) AS hit FROM c GROUP BY 1)
SELECT sample, any_value(n_cells) AS n_cells, round(any_value(hit) / any_value(n_cells), 4) AS accuracy, round(avg(tp / g) FILTER (g > 0), 4) AS balanced_accuracy, round(avg(2 * tp / (g + p)), 4) AS f1_macro, round(sum(2 * tp / (g + p) * g) / sum(g), 4) AS f1_weighted
FROM t JOIN k USING (sample) GROUP BY 1""")
def primary_metrics(spark, sf):
    return M.observed_metrics(M.confusion(_sets(spark, sf), ["sample"]), ["sample"])


@query("A13", """WITH a AS (SELECT user_id % 3 AS sample, event_id % 2 AS step, event_type AS gt, CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 5 = 0 THEN ' ' || upper(event_type) || ' ' WHEN event_id % 3 = 0 THEN 'other' ELSE event_type END AS pred FROM ev),
 r AS (SELECT sample, step, count(*) FILTER (lower(trim(pred)) = lower(trim(gt))) / count(*) AS acc FROM a GROUP BY ALL)
SELECT sample, round(max(acc) FILTER (step = 0), 4) AS step_0, round(max(acc) FILTER (step = 1), 4) AS step_1 FROM r GROUP BY 1""")
def anchor_matrix(spark, sf):
    i = F.col("event_id")
    pred = F.when(i % 7 == 0, None).when(i % 5 == 0, F.concat(F.lit(" "), F.upper("event_type"), F.lit(" "))).when(i % 3 == 0, "other").otherwise(F.col("event_type"))
    right = F.coalesce(F.lower(F.trim(pred)) == F.lower(F.trim(F.col("event_type"))), F.lit(False))
    a = ev(spark, sf).select((F.col("user_id") % 3).alias("sample"), (i % 2).alias("step"), right.cast("int").alias("right"))
    return a.groupBy("sample").pivot("step", [0, 1]).agg(F.round(F.avg("right"), 4)).toDF("sample", "step_0", "step_1")


@query("K6 A23", """SELECT event_type AS model, count(*) AS attempts, count(*) FILTER (user_id % 10 = 0) AS failures, round(sum(value), 2) AS tokens, round(sum(y), 2) AS seconds,
  round(sum(value * CASE event_type WHEN 'click' THEN 2.0 WHEN 'view' THEN 0.5 ELSE 0 END / 1e6), 8) AS usd FROM ev GROUP BY 1""")
def attempt_log(spark, sf):
    """Attempts appended to a log in two runs, then rolled up with the prices."""
    path = _folder(spark, "attempts")
    e = ev(spark, sf).select(F.col("event_type").alias("model"), (F.col("user_id") % 10 != 0).alias("ok"), F.col("value").alias("tokens"), F.col("y").alias("seconds"), (F.col("event_id") % 2).alias("run"))
    for run in (0, 1):
        K.append(e.where(F.col("run") == run).drop("run"), path)
    prices = spark.createDataFrame([("click", 2.0), ("view", 0.5)], "model string, price double")
    j = spark.read.parquet(path).join(prices, "model", "left")
    usd = F.sum(F.col("tokens") * F.coalesce("price", F.lit(0.0)) / 1e6)
    return j.groupBy("model").agg(F.count("*").alias("attempts"), F.count_if(~F.col("ok")).alias("failures"), F.round(F.sum("tokens"), 2).alias("tokens"), F.round(F.sum("seconds"), 2).alias("seconds"), F.round(usd, 8).alias("usd"))


@query("A24 E1", """WITH a AS (SELECT DISTINCT user_id % 21 AS g FROM ev)
SELECT g AS answer, 3 AS n_total, CASE WHEN g % 3 = 2 THEN 2 ELSE 1 END AS n_valid, CASE WHEN g % 3 = 0 THEN 1 ELSE 0 END AS n_absent, CASE WHEN g % 3 = 1 THEN 2 ELSE 1 END AS n_lost, CASE WHEN g % 3 = 2 THEN 3 ELSE 1 END AS n_gates, CASE WHEN g % 3 = 2 THEN 'neg,pos' ELSE 'pos' END AS categories FROM a""")
def gate_propagation(spark, sf):
    g = F.col("answer").cast("string")
    box = lambda x1: F.concat(F.lit('{"x_min": 0, "x_max": '), x1, F.lit(', "y_min": 0, "y_max": 1}'))
    one = box(F.concat(g, F.lit(".5")))
    neg = F.when(F.col("answer") % 3 == 0, F.lit('{"absent": true}')).when(F.col("answer") % 3 == 1, box(F.lit("-1"))).otherwise(F.concat(F.lit("["), one, F.lit(", "), box(F.lit("9")), F.lit("]")))
    text = F.concat(F.lit('<think>{"pos": 1}</think> so: {"pos": '), one, F.lit(', "neg": '), neg, F.lit("} done"))
    a = ev(spark, sf).select((F.col("user_id") % 21).alias("answer")).distinct().select("answer", text.alias("text"))
    out = A.propagation(A.parse_gates(a, "text", ["pos", "neg", "none"], ["answer"]), ["answer"])
    return out.withColumns({c: F.col(c).cast("int") for c in ("n_total", "n_valid", "n_absent", "n_lost", "n_gates")}).withColumn("categories", F.array_join("categories", ","))


@query("C3", """SELECT n_nationkey AS cluster, CASE WHEN n_nationkey = 24 THEN 'not expected' WHEN k = 5 THEN 'no prediction' WHEN k = 4 THEN 'empty' WHEN k = 3 THEN 'unknown leaf' WHEN k = 2 THEN 'Discard mixed with leaves' ELSE '' END AS why, k = 1 AS collides
FROM (SELECT n_nationkey, n_nationkey % 6 AS k FROM nation)""")
def cluster_checks(spark, sf):
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("cluster"), (F.col("n_nationkey") % 6).alias("k"))
    sets = [["a"], ["a", "b", "c"], ["Discard", "a"], ["zz"], []]
    leaves = F.lit(None).cast("array<string>")
    for i, s in enumerate(sets):
        leaves = F.when(F.col("k") == i, F.array(*(F.lit(v) for v in s)).cast("array<string>")).otherwise(leaves)
    return ML.cluster_problems(n.where("k < 5").select("cluster", leaves.alias("leaves")), n.where("cluster <> 24").select("cluster"), ["a", "b", "c"], {"a": "s1", "b": "s1", "c": "s2"})


@query("C7 C6 K7", "SELECT event_id::VARCHAR AS key, upper(event_type) AS answer FROM ev")
def checkpointed_calls(spark, sf):
    """A run that fails on some prompts, and its resumption from what it committed."""

    def flaky(prompt):
        if prompt == "error":
            raise OSError("no answer")
        return prompt.upper()

    rows, path = ev(spark, sf).select(F.col("event_id").cast("string").alias("key"), F.col("event_type").alias("prompt")), _folder(spark, "calls")
    try:
        remote.call_in_batches(rows, flaky, path, {"model": "m"}, attempts=1)
    except RuntimeError:
        pass
    return remote.call_in_batches(rows, str.upper, path, {"model": "m"}).select("key", "answer")


@query("S3 S4 T13", "SELECT source, event_id, x FROM (SELECT user_id % 3 AS source, event_id, x, row_number() OVER (PARTITION BY user_id % 3 ORDER BY md5('3:' || event_id), event_id) AS rk FROM ev) WHERE rk <= 100")
def capped_scan(spark, sf):
    e, path = ev(spark, sf), _folder(spark, "samples")
    for i in range(3):
        e.where(F.col("user_id") % 3 == i).write.parquet(f"{path}/{i}")
    out = K.scan_capped(spark, [f"{path}/{i}" for i in range(4)], ["x"], "event_id", 100, 3)
    return out.select(F.col("source").cast("long").alias("source"), "event_id", "x")


@query("S15 K4", "SELECT n_regionkey::VARCHAR AS sample, n_nationkey::DOUBLE AS c1, length(n_name)::DOUBLE AS c2, n_name AS name FROM nation WHERE n_regionkey < 3")
def cohort_folder(spark, sf):
    n, path = table(spark, sf, "nation"), _folder(spark, "cohort")
    rows = n.select(F.col("n_regionkey").cast("string").alias("sample"), F.col("n_nationkey").cast("double").alias("c1"), F.length("n_name").cast("double").alias("c2"), F.col("n_name").alias("name"))
    K.write_cohort(rows, "sample", path, {"cohort": "n", "cofactor": 150, "channels": {"c1": ["key", "protein"], "c2": ["size", "scatter"]}})
    return K.read_cohort(spark, path, "sample", head=3)


@query("K5 A9", """WITH g AS (SELECT event_type AS scenario, user_id % 3 AS mag, avg(value) AS v FROM ev GROUP BY ALL)
SELECT scenario, round(max(v) FILTER (mag = 0), 4) AS m0, round(max(v) FILTER (mag = 1), 4) AS m1, round(max(v) FILTER (mag = 2), 4) AS m2 FROM g GROUP BY 1
UNION ALL SELECT 'MEAN', round(avg(v) FILTER (mag = 0), 4), round(avg(v) FILTER (mag = 1), 4), round(avg(v) FILTER (mag = 2), 4) FROM g""")
def metric_csv(spark, sf):
    from .scoring import mean_of_means

    return S.csv_round_trip(mean_of_means(spark, sf))


@query("K8 T12", "SELECT event_type, round(avg(((x - mx) / sx) ** 2), 4) AS x, round(avg(((value - mv) / sv) ** 2), 4) AS value FROM ev, (SELECT avg(x) AS mx, stddev_pop(x) AS sx, avg(value) AS mv, stddev_pop(value) AS sv FROM ev) GROUP BY 1")
def channel_artifacts(spark, sf):
    """Channel order and statistics saved when fitted, loaded and applied."""
    e, path = ev(spark, sf), _folder(spark, "artifacts")
    fitted = T.fit_standard(e, ["x", "value"])
    spark.createDataFrame([(i, c, float(m), float(s)) for i, (c, (m, s)) in enumerate(fitted.items())], "ord int, channel string, mean double, std double").coalesce(1).write.parquet(path)
    loaded = {r["channel"]: (r["mean"], r["std"]) for r in spark.read.parquet(path).orderBy("ord").collect()}
    return T.standardize(e, loaded).groupBy("event_type").agg(F.round(F.avg(F.col("x") * F.col("x")), 4).alias("x"), F.round(F.avg(F.col("value") * F.col("value")), 4).alias("value"))


@query("K9 K3", """SELECT o_orderstatus AS step, CASE WHEN o_totalprice > 200000 THEN 'p' WHEN o_totalprice > 90000 THEN 'q' ELSE 'Unassigned' END AS a, CASE WHEN o_totalprice > 150000 THEN 'p' ELSE 'Unassigned' END AS c, count(*) AS n FROM orders GROUP BY ALL""")
def rater_labels(spark, sf):
    """Label tables by step, with their counts in a document beside them; both are read again."""
    path = _folder(spark, "rater-labels")
    labels = S.round_trip(_raters(spark, sf).select("event", "step", "a", "c"), ["step"])
    n = labels.groupBy("step", "a", "c").agg(F.count("*").alias("n"))
    K.write_document(spark, path, [r.asDict() for r in n.collect()])
    return spark.createDataFrame(K.documents(spark, path)[0], "step string, a string, c string, n long")


@query("P11", """SELECT s1, s2, s3, count(*) AS n FROM (SELECT s1, CASE WHEN s1 = 'big' AND y < 50 THEN 'left' END AS s2, CASE WHEN s1 = 'small' AND y < 30 THEN 'R_left' END AS s3
  FROM (SELECT y, CASE WHEN x <= 2 THEN 'small' WHEN x > 2 THEN 'big' END AS s1 FROM ev)) GROUP BY ALL""")
def gates_by_lookup(spark, sf):
    x, y = F.col("x"), F.col("y")
    gates = {"root__big": x > 2, "root__small": x <= 2, "root__big__left": y < 50, "root__small__left": y < 30}
    steps = [("s1", "ALL", ["big", "small"]), ("s2", "s1 == big", ["left", "nowhere"]), ("s3", "s1 == small", ["R_left"])]
    out = cascade.labels_by_lookup(ev(spark, sf).withColumns(gates), steps, list(gates), {"R_left": "left"}, {"R_": "__small__"})
    return out.groupBy("s1", "s2", "s3").agg(F.count("*").alias("n"))


@query("P14", "SELECT CASE WHEN event_type IN ('click', 'view') THEN 'cytof' ELSE 'flow' END AS by_cohort, CASE WHEN y * 2 >= 100 THEN 'flow' ELSE 'cytof' END AS by_cofactor, count(*) AS n FROM ev GROUP BY ALL")
def modality_by_cohort(spark, sf):
    by = P.modality(F.col("y"), cohort=F.col("event_type"), cytof=["click", "view"])
    return ev(spark, sf).groupBy(by.alias("by_cohort"), P.modality(F.col("y") * 2).alias("by_cofactor")).agg(F.count("*").alias("n"))


@query("T11", """SELECT event_type, round(sum((least(greatest(value, a), b) - a) / (b - a) * 10), 4) AS value, round(sum(asinh(y / 5)), 4) AS y, round(sum(one), 4) AS one
FROM (SELECT *, 0.0::DOUBLE AS one FROM ev), (SELECT quantile_cont(value, 0.01) AS a, quantile_cont(value, 0.99) AS b FROM ev) GROUP BY 1""")
def ingest_by_kind(spark, sf):
    e = ev(spark, sf).withColumn("one", F.lit(7.0))
    out = T.ingest(e, {"value": "scatter", "y": "protein", "one": "tech"}, 5.0)
    return out.groupBy("event_type").agg(*(F.round(F.sum(c), 4).alias(c) for c in ("value", "y", "one")))


@query("J11", """WITH g AS (SELECT event_type AS category, avg(x) - 3 AS x_min, avg(x) + 1 AS x_max, min(y) AS y_min, avg(y) * 3 AS y_max FROM ev GROUP BY 1), e AS (SELECT min(x) AS a, max(x) AS b, min(y) AS c, max(y) AS d FROM ev)
SELECT category, 'x' AS axis, round(x_min, 4) AS low, round(x_max, 4) AS high FROM g, e WHERE x_min < a - 1e-9 OR x_max > b + 1e-9 UNION ALL SELECT category, 'y', round(y_min, 4), round(y_max, 4) FROM g, e WHERE y_min < c - 1e-9 OR y_max > d + 1e-9""")
def gate_range_warnings(spark, sf):
    e = ev(spark, sf)
    g = e.groupBy(F.col("event_type").alias("category")).agg((F.avg("x") - 3).alias("x_min"), (F.avg("x") + 1).alias("x_max"), F.min("y").alias("y_min"), (F.avg("y") * 3).alias("y_max"))
    w = G.range_warnings(g, tuple(e.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()))
    return w.select("category", "axis", F.round("low", 4).alias("low"), F.round("high", 4).alias("high"))


_PLAN = "plan AS (SELECT r_name AS parent, n_name AS category FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT DISTINCT n_name, c_mktsegment FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_nationkey < 12)"


@query("J14 N19", f"WITH {_PLAN} SELECT DISTINCT category AS leaf FROM plan WHERE category NOT IN (SELECT parent FROM plan)")
def leaf_rows(spark, sf):
    n, c = table(spark, sf, "nation"), table(spark, sf, "customer")
    top = n.join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("parent"), F.col("n_name").alias("category"))
    low = c.join(n.where("n_nationkey < 12"), F.col("c_nationkey") == F.col("n_nationkey")).select("n_name", "c_mktsegment").distinct()
    plan = top.union(low)
    return plan.select(F.col("category").alias("leaf")).distinct().join(plan.select(F.col("parent").alias("leaf")), "leaf", "left_anti")


@query("N14", """WITH h AS (SELECT event_type, least(floor(y / 10), 9)::INT AS bin, count(*) AS n FROM ev GROUP BY ALL), m AS (SELECT event_type, max(ln(1 + n)) AS top FROM h GROUP BY 1)
SELECT event_type, string_agg(coalesce(substr('▁▂▃▄▅▆▇█', round_even(ln(1 + n) / top * 7, 0)::INT + 1, 1), ' '), '' ORDER BY i) AS bar FROM m CROSS JOIN range(10) r(i) LEFT JOIN h ON h.event_type = m.event_type AND bin = i GROUP BY event_type""".replace("SELECT event_type, string_agg", "SELECT m.event_type, string_agg").replace("GROUP BY event_type", "GROUP BY m.event_type"))
def block_bars(spark, sf):
    h = ev(spark, sf).groupBy("event_type").agg(*(F.count_if(F.least(F.floor(F.col("y") / 10), F.lit(9)) == i).alias(f"b{i}") for i in range(10)))
    return h.select("event_type", R.block_bar(F.array(*(f"b{i}" for i in range(10))), "log").alias("bar"))
