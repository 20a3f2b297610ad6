"""Metrics and roll-ups (A), rater comparisons, multi-label scores, cascades (C)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.predicates import compile_predicate, quoted, reference_label
from ..operators import metrics as M
from ..operators import multilabel as ML
from ..operators.gates import Rect, assign
from ..plans.cascade import Step, cascade, step_status
from ..plans.flagship import evaluate_gates
from .base import cells, ev, query, table

BOXES = {"A": Rect(0, 15, 0, 30000), "R": Rect(10, 30, 20000, 60000)}
CATS = ["A", "R", "X"]
PAIRS = """SELECT sample, coalesce("Step02_c|d", 'Unassigned') AS gt,
  CASE WHEN x BETWEEN 0 AND 15 AND y BETWEEN 0 AND 30000 THEN 'A' WHEN x BETWEEN 10 AND 30 AND y BETWEEN 20000 AND 60000 THEN 'R' ELSE 'Unassigned' END AS pred
  FROM cells WHERE "Step01_a|b" = 'O'"""
CONF = f"pairs AS ({PAIRS}), conf AS (SELECT sample, gt, pred, count(*) AS n FROM pairs GROUP BY ALL)"
PER = """labels AS (SELECT sample, gt AS label FROM conf UNION SELECT sample, pred FROM conf),
per AS (SELECT l.sample, l.label, coalesce(sum(n) FILTER (gt = label AND pred = label), 0)::BIGINT AS tp, coalesce(sum(n) FILTER (gt = label), 0)::BIGINT AS n_gt, coalesce(sum(n) FILTER (pred = label), 0)::BIGINT AS n_pred
  FROM labels l JOIN conf c USING (sample) GROUP BY ALL),
cls AS (SELECT *, CASE WHEN n_pred > 0 THEN tp / n_pred ELSE 0 END AS p, CASE WHEN n_gt > 0 THEN tp / n_gt ELSE 0 END AS r, CASE WHEN n_gt + n_pred > 0 THEN 2 * tp / (n_gt + n_pred) ELSE 0 END AS f1 FROM per)"""
TASK = """tot AS (SELECT sample, sum(n)::BIGINT AS n_cells, sum(n) FILTER (gt = pred) AS hit FROM conf GROUP BY 1),
mac AS (SELECT t.sample, avg(coalesce(f1, 0)) AS f1_macro, avg(abs(coalesce(n_gt, 0) / n_cells - coalesce(n_pred, 0) / n_cells)) AS pe
  FROM tot t CROSS JOIN (VALUES ('A'), ('R'), ('X')) AS c(label) LEFT JOIN cls ON cls.sample = t.sample AND cls.label = c.label GROUP BY 1),
sup AS (SELECT sample, avg(r) AS ba, sum(f1 * n_gt) / sum(n_gt) AS fw FROM cls WHERE n_gt > 0 GROUP BY 1),
task AS (SELECT sample, n_cells, round(hit / n_cells, 4) AS accuracy, round(ba, 4) AS balanced_accuracy, round(f1_macro, 4) AS f1_macro, round(fw, 4) AS f1_weighted, round(pe, 4) AS proportion_error
  FROM tot JOIN mac USING (sample) JOIN sup USING (sample))"""


def _pairs(spark, sf):
    c = cells(spark, sf)
    inside = c.where(compile_predicate("Step01_a|b == O", c.columns))
    gt, pred = M.scored(reference_label("Step02_c|d"), assign(F.col("x"), F.col("y"), BOXES, CATS))
    return inside.select("dataset", "sample", gt.alias("gt"), pred.alias("pred"))


def _tasks(spark, sf):
    return evaluate_gates(cells(spark, sf), ["sample"], "Step01_a|b == O", "Step02_c|d", BOXES, CATS)


@query("A2", f"WITH {CONF} SELECT * FROM conf")
def confusion(spark, sf):
    return M.confusion(_pairs(spark, sf), ["sample"])


@query("A3 N8", f"WITH {CONF}, {PER} SELECT sample, label, tp, n_gt, n_pred, round(p, 6) AS \"precision\", round(r, 6) AS recall, round(f1, 6) AS f1 FROM cls")
def class_metrics(spark, sf):
    out = M.class_metrics(M.confusion(_pairs(spark, sf), ["sample"]), ["sample"])
    return out.select("sample", "label", "tp", "n_gt", "n_pred", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")))


@query("A4 N7 N9 S7", f"WITH {CONF}, {PER}, {TASK} SELECT * FROM task")
def task_metrics(spark, sf):
    return _tasks(spark, sf)


@query("A6 A7", f"""WITH {CONF}, {PER}, {TASK} SELECT sample % 2 AS parity, sample, count(*) AS n_tasks, sum(n_cells)::BIGINT AS n_cells,
  round(avg(f1_macro), 4) AS f1_macro_mean, round(stddev_pop(f1_macro), 4) AS f1_macro_std, round(avg(accuracy), 4) AS accuracy_mean, round(stddev_pop(accuracy), 4) AS accuracy_std
FROM task GROUP BY GROUPING SETS ((), (parity), (sample))""")
def rollup_sets(spark, sf):
    t = _tasks(spark, sf).withColumn("parity", F.col("sample") % 2)
    return M.rollup(t, [[], ["parity"], ["sample"]], ["f1_macro", "accuracy"])


@query("A1 N21", """SELECT sample, sum(n) OVER (PARTITION BY sample)::BIGINT AS n_parent, label, n, round(n / sum(n) OVER (PARTITION BY sample), 4) AS proportion FROM (
  SELECT s.sample, c.label, count(v.gt) AS n FROM (SELECT DISTINCT sample FROM cells) s CROSS JOIN (VALUES ('A'), ('R'), ('Unassigned'), ('Z')) AS c(label)
  LEFT JOIN (SELECT sample, coalesce("Step02_c|d", 'Unassigned') AS gt FROM cells WHERE "Step01_a|b" = 'O') v ON v.sample = s.sample AND v.gt = c.label GROUP BY ALL)""")
def gt_summary(spark, sf):
    p = _pairs(spark, sf)
    n = p.groupBy("sample", F.col("gt").alias("label")).agg(F.count("*").alias("n"))
    total = n.groupBy("sample").agg(F.sum("n").alias("n_parent"))
    listed = total.select("sample", "n_parent", F.explode(F.array(*(F.lit(c) for c in ("A", "R", "Unassigned", "Z")))).alias("label"))
    out = listed.join(n, ["sample", "label"], "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))
    return out.select("sample", "n_parent", "label", "n", F.round(F.col("n") / F.col("n_parent"), 4).alias("proportion"))


@query("N6", f"WITH {CONF} SELECT gt, CASE WHEN pred = 'R' THEN '__noise__' ELSE pred END AS pred, sum(n)::BIGINT AS n FROM conf GROUP BY ALL")
def noise_predictions(spark, sf):
    p = _pairs(spark, sf)
    gt, pred = M.scored(F.col("gt"), F.when(F.col("pred") != "R", F.col("pred")))
    return M.confusion(p.select(gt.alias("gt"), pred.alias("pred")), [])


@query("A8 A9", f"""WITH {CONF}, {PER}, d AS (SELECT sample % 3 AS scenario, sample, avg(r) FILTER (label = 'A') AS dep, avg(r) FILTER (label <> 'A' AND label <> 'Unassigned') AS sib FROM cls WHERE n_gt > 0 GROUP BY ALL),
  s AS (SELECT scenario, avg(dep) AS dep, avg(sib) AS sib FROM d GROUP BY 1)
SELECT scenario::VARCHAR AS scenario, round(dep, 4) AS depleted, round(sib, 4) AS sibling FROM s UNION ALL SELECT 'MEAN', round(avg(dep), 4), round(avg(sib), 4) FROM s""")
def dep_vs_sib(spark, sf):
    per = M.class_metrics(M.confusion(_pairs(spark, sf), ["sample"]), ["sample"]).where("n_gt > 0")
    split = per.groupBy((F.col("sample") % 3).alias("scenario"), "sample").agg(F.avg(F.when(F.col("label") == "A", F.col("recall"))).alias("dep"), F.avg(F.when(~F.col("label").isin("A", "Unassigned"), F.col("recall"))).alias("sib"))
    s = split.groupBy("scenario").agg(F.avg("dep").alias("dep"), F.avg("sib").alias("sib"))
    out = s.select(F.col("scenario").cast("string").alias("scenario"), "dep", "sib").union(s.agg(F.avg("dep"), F.avg("sib")).select(F.lit("MEAN"), "*"))
    return out.select("scenario", F.round("dep", 4).alias("depleted"), F.round("sib", 4).alias("sibling"))


@query("K5 A9", """WITH g AS (SELECT event_type AS scenario, user_id % 3 AS mag, avg(value) AS v FROM ev GROUP BY ALL)
SELECT scenario, round(max(v) FILTER (mag = 0), 4) AS m0, round(max(v) FILTER (mag = 1), 4) AS m1, round(max(v) FILTER (mag = 2), 4) AS m2 FROM g GROUP BY 1
UNION ALL SELECT 'MEAN', round(avg(v) FILTER (mag = 0), 4), round(avg(v) FILTER (mag = 1), 4), round(avg(v) FILTER (mag = 2), 4) FROM g""")
def mean_of_means(spark, sf):
    g = ev(spark, sf).groupBy(F.col("event_type").alias("scenario"), (F.col("user_id") % 3).alias("mag")).agg(F.avg("value").alias("v"))
    wide = g.groupBy("scenario").pivot("mag", [0, 1, 2]).agg(F.first("v")).toDF("scenario", "m0", "m1", "m2")
    out = wide.union(wide.agg(F.avg("m0"), F.avg("m1"), F.avg("m2")).select(F.lit("MEAN"), "*"))
    return out.select("scenario", *(F.round(c, 4).alias(c) for c in ("m0", "m1", "m2")))


LEAVES = ["hi", "view", "late"]
_SETS = "SELECT event_id, user_id % 4 AS sample, list_distinct(list_filter([CASE WHEN value > 60 THEN 'hi' ELSE 'lo' END, event_type, CASE WHEN event_id % 5 = 0 THEN 'late' END], lambda v: v IN ('hi', 'view', 'late'))) AS g0, list_distinct(list_filter([CASE WHEN value > 50 THEN 'hi' ELSE 'lo' END, CASE WHEN event_id % 11 = 0 THEN 'lo' ELSE event_type END], lambda v: v IN ('hi', 'view', 'late'))) AS p0 FROM ev"
SETS = f"sets AS (SELECT event_id, sample, CASE WHEN len(g0) = 0 THEN ['Discard'] ELSE g0 END AS g, CASE WHEN len(p0) = 0 THEN ['Discard'] ELSE p0 END AS p FROM ({_SETS}))"


def _sets(spark, sf):
    e = ev(spark, sf)
    gt = [F.when(F.col("value") > 60, "hi").otherwise("lo"), F.col("event_type"), F.when(F.col("event_id") % 5 == 0, "late")]
    pred = [F.when(F.col("value") > 50, "hi").otherwise("lo"), F.when(F.col("event_id") % 11 == 0, "lo").otherwise(F.col("event_type"))]
    return e.select("event_id", (F.col("user_id") % 4).alias("sample"), ML.leaf_set(gt, LEAVES).alias("g"), ML.leaf_set(pred, LEAVES).alias("p"), ML.primary_leaf(gt, LEAVES).alias("gt"), ML.primary_leaf(pred, LEAVES).alias("pred"))


@query("C2 M10", f"WITH {SETS} SELECT array_to_string(list_sort(g), '+') AS leaves, count(*) AS n FROM sets GROUP BY 1")
def leaf_sets(spark, sf):
    return _sets(spark, sf).groupBy(F.array_join(F.array_sort("g"), "+").alias("leaves")).agg(F.count("*").alias("n"))


@query("A10", f"""WITH {SETS}, m AS (
  SELECT sample, leaf, count(*) FILTER (ig AND ip) AS tp, count(*) FILTER (NOT ig AND ip) AS fp, count(*) FILTER (ig AND NOT ip) AS fn FROM (
    SELECT sample, leaf, list_contains(g, leaf) AS ig, list_contains(p, leaf) AS ip FROM sets, (VALUES ('hi'), ('view'), ('late'), ('Discard')) AS v(leaf)) GROUP BY ALL),
 s AS (SELECT sample, count(*) AS n, avg((list_sort(g) = list_sort(p))::INT) AS subset FROM sets GROUP BY 1)
SELECT sample, n, round(any_value(subset), 4) AS subset_accuracy, round(sum(fp + fn) / (any_value(n) * 4), 4) AS hamming, round(2 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)), 4) AS f1_micro,
  round(avg(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END), 4) AS f1_macro, round(sum(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END * (tp + fn)) / sum(tp + fn), 4) AS f1_weighted,
  round(sum(tp) / (sum(tp) + sum(fp) + sum(fn)), 4) AS jaccard_micro, round(avg(CASE WHEN tp + fp + fn > 0 THEN tp / (tp + fp + fn) ELSE 0 END), 4) AS jaccard_macro
FROM m JOIN s USING (sample) GROUP BY ALL""")
def multilabel_metrics(spark, sf):
    return ML.metrics(_sets(spark, sf), ["sample"], "g", "p", [*LEAVES, "Discard"])


@query("W9 A11 N20", """SELECT user_id % 4 AS sample, CASE WHEN event_id % 5 = 0 THEN 'late' WHEN event_type = 'view' THEN 'view' WHEN value > 60 THEN 'hi' ELSE 'Discard' END AS gt,
  CASE WHEN event_type = 'view' AND event_id % 11 <> 0 THEN 'view' WHEN value > 50 THEN 'hi' ELSE 'Discard' END AS pred, count(*) AS n FROM ev GROUP BY ALL""")
def primary_leaf(spark, sf):
    return M.confusion(_sets(spark, sf), ["sample"])


@query("A12", f"WITH {SETS} SELECT round(avg(a), 4) AS mean_subset, max(collisions) AS most FROM (SELECT sample, avg((list_sort(g) = list_sort(p))::INT) AS a, count(*) FILTER (len(g) > 1) AS collisions FROM sets GROUP BY 1)")
def flat_rollup(spark, sf):
    same = (F.array_sort("g") == F.array_sort("p")).cast("int")
    by = _sets(spark, sf).groupBy("sample").agg(F.avg(same).alias("a"), F.count_if(F.size("g") > 1).alias("c"))
    return by.agg(F.round(F.avg("a"), 4).alias("mean_subset"), F.max("c").alias("most"))


PLAN = [
    Step("s1", "ALL", "x", "y", {"big": Rect(2.5, 9, 0, 99), "small": Rect(0, 2.5, 0, 99)}),
    Step("s2", "s1 == big", "x", "y", {"left": Rect(2.5, 3.5, 0, 50), "right": Rect(3.5, 9, 0, 99)}),
    Step("s3", "s2 == none", "x", "y", {"deep": Rect(0, 9, 0, 99)}),
    Step("s4", "s1 in big,small & s2 != right", "x", "y", {"end": Rect(1, 3, 10, 90)}),
]
_CASC = """c1 AS (SELECT event_id, x, y, CASE WHEN x BETWEEN 0 AND 2.5 THEN 'small' WHEN x BETWEEN 2.5 AND 9 THEN 'big' ELSE 'Unassigned' END AS s1 FROM ev),
c2 AS (SELECT *, CASE WHEN s1 = 'big' AND x BETWEEN 2.5 AND 3.5 AND y BETWEEN 0 AND 50 THEN 'left' WHEN s1 = 'big' AND x BETWEEN 3.5 AND 9 THEN 'right' ELSE 'Unassigned' END AS s2, 'Unassigned' AS s3 FROM c1),
c4 AS (SELECT *, CASE WHEN s1 IN ('big', 'small') AND s2 <> 'right' AND x BETWEEN 1 AND 3 AND y BETWEEN 10 AND 90 THEN 'end' ELSE 'Unassigned' END AS s4 FROM c2)"""


@query("C1 K3", f"WITH {_CASC} SELECT s1, s2, s3, s4, count(*) AS n FROM c4 GROUP BY ALL")
def cascade_labels(spark, sf):
    return cascade(ev(spark, sf), PLAN).groupBy("s1", "s2", "s3", "s4").agg(F.count("*").alias("n"))


@query("C1 A26", f"""WITH {_CASC} SELECT step, n_parent, n_labelled, CASE WHEN n_parent = 0 THEN 'empty_parent' ELSE 'ok' END AS status FROM (
  SELECT 's1' AS step, count(*) AS n_parent, count(*) FILTER (s1 <> 'Unassigned') AS n_labelled FROM c4
  UNION ALL SELECT 's2', count(*) FILTER (s1 = 'big'), count(*) FILTER (s2 <> 'Unassigned') FROM c4 UNION ALL SELECT 's3', 0, 0
  UNION ALL SELECT 's4', count(*) FILTER (s1 IN ('big', 'small') AND s2 <> 'right'), count(*) FILTER (s4 <> 'Unassigned') FROM c4)""")
def cascade_status(spark, sf):
    return step_status(cascade(ev(spark, sf), PLAN), PLAN)


RATERS = "SELECT o_orderkey AS event, o_orderstatus AS step, unnest([{'rater': 'a', 'label': CASE WHEN o_totalprice > 200000 THEN 'p' WHEN o_totalprice > 90000 THEN 'q' ELSE 'Unassigned' END, 'inside': o_totalprice > 60000}, {'rater': 'b', 'label': CASE WHEN o_totalprice > 210000 THEN 'p' WHEN o_totalprice > 80000 THEN 'q' ELSE 'Unassigned' END, 'inside': o_totalprice > 95000}, {'rater': 'c', 'label': CASE WHEN o_totalprice > 150000 THEN 'p' ELSE 'Unassigned' END, 'inside': o_totalprice > 30000}], recursive := true) FROM orders"


def _raters(spark, sf):
    o = table(spark, sf, "orders")
    t = F.col("o_totalprice")
    label = {"a": F.when(t > 200000, "p").when(t > 90000, "q").otherwise("Unassigned"), "b": F.when(t > 210000, "p").when(t > 80000, "q").otherwise("Unassigned"), "c": F.when(t > 150000, "p").otherwise("Unassigned")}
    return o.select(F.col("o_orderkey").alias("event"), F.col("o_orderstatus").alias("step"), *(c.alias(k) for k, c in label.items()), *((t > v).alias(f"in_{k}") for k, v in {"a": 60000, "b": 95000, "c": 30000}.items()))


_AGREE = "SELECT x.rater AS first, y.rater AS second, x.step, l.label, count(*) FILTER (x.label = l.label AND y.label = l.label) AS tp, count(*) FILTER (x.label <> l.label AND y.label = l.label) AS fp, count(*) FILTER (x.label = l.label AND y.label <> l.label) AS fn FROM r x JOIN r y USING (event) CROSS JOIN (VALUES ('p'), ('q')) AS l(label) WHERE {cond} GROUP BY ALL"


@query("J9 A14", f"WITH r AS ({RATERS}), k AS ({_AGREE.format(cond='x.rater <> y.rater AND x.inside AND y.inside')}) SELECT first, second, round(2 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)), 4) AS f1_pooled, round(avg(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) END), 4) AS f1_macro FROM k GROUP BY ALL")
def pair_shared_f1(spark, sf):
    return ML.rater_agreement(_raters(spark, sf), ["a", "b", "c"], ["step"], ["p", "q"], ordered=True, inside={r: f"in_{r}" for r in "abc"})


@query("J10 A14", f"WITH r AS ({RATERS}), k AS ({_AGREE.format(cond='x.rater < y.rater')}) SELECT first, second, round(2 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)), 4) AS f1_pooled, round(avg(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) END), 4) AS f1_macro FROM k GROUP BY ALL")
def pair_all_events(spark, sf):
    return ML.rater_agreement(_raters(spark, sf), ["a", "b", "c"], ["step"], ["p", "q"], ordered=False)


@query("A29", f"WITH r AS ({RATERS}) SELECT step, count(*) AS any_rater, count(*) FILTER (k = 3) AS all_raters, round(count(*) FILTER (k = 3) / count(*), 4) AS overlap FROM (SELECT event, step, count(*) FILTER (label <> 'Unassigned') AS k FROM r GROUP BY ALL) WHERE k > 0 GROUP BY 1")
def rater_overlap(spark, sf):
    return ML.rater_overlap(_raters(spark, sf), ["a", "b", "c"], ["step"])


@query("W13", f"""WITH r AS ({RATERS}), s AS (SELECT event % 20 AS grp, count(*)::DOUBLE AS n, avg((label = 'p')::INT) AS share FROM r GROUP BY 1),
 q AS (SELECT quantile_cont(n, 0.5) AS nm, quantile_cont(n, 0.75) - quantile_cont(n, 0.25) AS ni, quantile_cont(share, 0.5) AS sm, quantile_cont(share, 0.75) - quantile_cont(share, 0.25) AS si FROM s WHERE n >= 30)
SELECT grp, round(abs(n - nm) / greatest(ni, 0.01) + abs(share - sm) / greatest(si, 0.01), 4) AS score FROM s, q WHERE n >= 30 ORDER BY round(abs(n - nm) / greatest(ni, 0.01) + abs(share - sm) / greatest(si, 0.01), 4), grp LIMIT 5""")
def typical_groups(spark, sf):
    r = _raters(spark, sf).select("event", F.explode(F.array("a", "b", "c")).alias("label"))
    s = r.groupBy((F.col("event") % 20).alias("grp")).agg(F.count("*").cast("double").alias("n"), F.avg((F.col("label") == "p").cast("int")).alias("share"))
    return ML.typical(s, "grp", {"n": 1.0, "share": 1.0}, F.col("n") >= 30, 5)


@query("A15", """WITH t AS (SELECT user_id % 4 AS step, event_id % 50 AS task, event_type AS gt, CASE WHEN value > 40 THEN 'view' ELSE event_type END AS pred FROM ev),
 k AS (SELECT step, task, c.label, count(*) FILTER (gt = label AND pred = label) AS tp, count(*) FILTER (gt = label) AS g, count(*) FILTER (pred = label) AS p FROM t, (VALUES ('click'), ('view'), ('purchase')) AS c(label) GROUP BY ALL),
 f AS (SELECT step, task, round(avg(CASE WHEN g + p > 0 THEN 2 * tp / (g + p) ELSE 0 END), 4) AS f1 FROM k GROUP BY ALL)
SELECT step, round(avg(f1), 4) AS f1, count(*) AS n FROM f GROUP BY 1""")
def step_balanced(spark, sf):
    t = ev(spark, sf).select((F.col("user_id") % 4).alias("step"), (F.col("event_id") % 50).alias("task"), F.col("event_type").alias("gt"), F.when(F.col("value") > 40, "view").otherwise(F.col("event_type")).alias("pred"))
    counts = M.confusion(t, ["step", "task"])
    per = M.class_metrics(counts, ["step", "task"])
    listed = counts.select("step", "task").distinct().select("step", "task", F.explode(F.array(*(F.lit(c) for c in ("click", "view", "purchase")))).alias("label"))
    f = listed.join(per, ["step", "task", "label"], "left").groupBy("step", "task").agg(F.round(F.avg(F.coalesce("f1", F.lit(0.0))), 4).alias("f1"))
    return f.groupBy("step").agg(F.round(F.avg("f1"), 4).alias("f1"), F.count("*").alias("n"))


@query("A16 N10 U6", """WITH s AS (SELECT user_id % 6 AS seed, event_type AS cohort, avg(value) AS m FROM ev WHERE NOT (user_id % 6 = 5 AND event_type = 'click') GROUP BY ALL),
 c AS (SELECT seed, avg(m) AS m FROM s GROUP BY 1 HAVING count(DISTINCT cohort) = 5) SELECT count(*) AS seeds, round(avg(m), 4) AS mean, round(coalesce(stddev_samp(m), 0), 4) AS std FROM c""")
def seed_sweep(spark, sf):
    s = ev(spark, sf).withColumn("seed", F.col("user_id") % 6).where("not (seed = 5 and event_type = 'click')").groupBy("seed", "event_type").agg(F.avg("value").alias("m"))
    full = s.groupBy("seed").agg(F.avg("m").alias("m"), F.countDistinct("event_type").alias("k")).where("k = 5")
    return full.agg(F.count("*").alias("seeds"), F.round(F.avg("m"), 4).alias("mean"), F.round(F.coalesce(F.stddev_samp("m"), F.lit(0.0)), 4).alias("std"))


@query("A13 A27", """WITH a AS (SELECT user_id % 3 AS sample, event_id % 2 AS step, event_type AS gt, CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 5 = 0 THEN ' ' || upper(event_type) || ' ' WHEN event_id % 3 = 0 THEN 'other' ELSE event_type END AS pred FROM ev)
SELECT sample, step, count(*) AS n, count(*) FILTER (pred IS NULL) AS parse_failed, count(*) FILTER (lower(trim(pred)) IS DISTINCT FROM lower(trim(gt))) AS n_wrong, round(count(*) FILTER (lower(trim(pred)) = lower(trim(gt))) / count(*), 4) AS accuracy
FROM a GROUP BY CUBE (sample, step)""")
def anchor_accuracy(spark, sf):
    i = F.col("event_id")
    pred = F.when(i % 7 == 0, None).when(i % 5 == 0, F.concat(F.lit(" "), F.upper("event_type"), F.lit(" "))).when(i % 3 == 0, "other").otherwise(F.col("event_type"))
    a = ev(spark, sf).select((F.col("user_id") % 3).alias("sample"), (i % 2).alias("step"), F.col("event_type").alias("gt"), pred.alias("pred"))
    right = F.coalesce(F.lower(F.trim("pred")) == F.lower(F.trim("gt")), F.lit(False))
    return a.cube("sample", "step").agg(F.count("*").alias("n"), F.count_if(F.col("pred").isNull()).alias("parse_failed"), F.count_if(~right).alias("n_wrong"), F.round(F.count_if(right) / F.count("*"), 4).alias("accuracy"))


@query("A18", """SELECT user_id % 9 AS slot, min_by(event_type, (-k, event_type)) AS mode FROM (SELECT user_id % 9 AS u, user_id, event_type, count(*) OVER (PARTITION BY user_id % 9, event_type) AS k FROM ev WHERE event_type <> 'click') GROUP BY 1""")
def group_mode(spark, sf):
    rows = ev(spark, sf).select((F.col("user_id") % 9).alias("slot"), F.nullif("event_type", F.lit("click")).alias("label"))
    return M.mode_of(rows, ["slot"], "label")


@query("A22", "SELECT event_type, count(*) AS n_rows, round((SELECT count(*) FROM ev) / (5 * count(*)), 6) AS weight FROM ev GROUP BY 1")
def class_weights(spark, sf):
    return M.class_weights(ev(spark, sf), "event_type").withColumn("weight", F.round("weight", 6))


@query("A23 K6", """SELECT event_type AS model, count(*) AS attempts, count(*) FILTER (user_id % 10 = 0) AS failures, round(sum(value), 2) AS tokens, round(sum(value * CASE event_type WHEN 'click' THEN 2.0 WHEN 'view' THEN 0.5 ELSE 0 END / 1e6), 8) AS usd FROM ev GROUP BY 1""")
def api_cost(spark, sf):
    prices = spark.createDataFrame([("click", 2.0), ("view", 0.5)], "event_type string, price double")
    j = ev(spark, sf).join(prices, "event_type", "left")
    return j.groupBy(F.col("event_type").alias("model")).agg(F.count("*").alias("attempts"), F.count_if(F.col("user_id") % 10 == 0).alias("failures"), F.round(F.sum("value"), 2).alias("tokens"), F.round(F.sum(F.col("value") * F.coalesce("price", F.lit(0.0)) / 1e6), 8).alias("usd"))


@query("A24 A25", "SELECT user_id % 5 AS shard, count(*) AS n_groups, sum(length(event_type))::BIGINT AS n_chars, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS categories FROM ev GROUP BY 1")
def shard_summary(spark, sf):
    return ev(spark, sf).groupBy((F.col("user_id") % 5).alias("shard")).agg(F.count("*").alias("n_groups"), F.sum(F.length("event_type")).alias("n_chars"), F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("categories"))


@query("A28", "SELECT event_type AS label, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, event_type)::INT AS ord FROM ev GROUP BY 1")
def frequent_labels(spark, sf):
    from pyspark.sql import Window

    n = ev(spark, sf).groupBy(F.col("event_type").alias("label")).agg(F.count("*").alias("n"))  # a row a label
    return n.withColumn("ord", F.row_number().over(Window.orderBy(F.desc("n"), "label")))
