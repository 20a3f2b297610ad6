"""Leaf sets of rows, multi-label scores, and agreement between raters."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import combinations, permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import UNASSIGNED

# fixed value: the leaf of rows that reach none
DISCARD = "Discard"


def _hits(labels: Sequence[Column], leaves: Sequence[str]) -> Column:
    return F.filter(F.array(*labels), lambda v: F.coalesce(v.isin(*leaves), F.lit(False)))


def leaf_set(labels: Sequence[Column], leaves: Sequence[str]) -> Column:
    """Distinct leaves among a row's labels in plan order; Discard if there is none."""
    hit = F.array_distinct(_hits(labels, leaves))
    return F.when(F.size(hit) == 0, F.array(F.lit(DISCARD))).otherwise(hit)


def primary_leaf(labels: Sequence[Column], leaves: Sequence[str]) -> Column:
    """The last leaf in plan order, or Discard."""
    return F.coalesce(F.try_element_at(_hits(labels, leaves), F.lit(-1)), F.lit(DISCARD))


def metrics(rows: DataFrame, group: Sequence[str], gt: str, pred: str, leaves: Sequence[str]) -> DataFrame:
    """Subset accuracy, Hamming loss, F1 and Jaccard scores of label sets: one
    aggregate row a group, from three sums for each leaf."""
    has = lambda c, leaf: F.array_contains(c, leaf)
    sums = []
    for i, leaf in enumerate(leaves):
        g, p = has(gt, leaf), has(pred, leaf)
        sums += [F.count_if(g & p).alias(f"tp{i}"), F.count_if(~g & p).alias(f"fp{i}"), F.count_if(g & ~p).alias(f"fn{i}")]
    same = (F.array_sort(gt) == F.array_sort(pred)).cast("int")
    by = rows.groupBy(*group).agg(F.count("*").alias("n"), F.avg(same).alias("subset"), *sums)
    k = range(len(leaves))
    tp, fp, fn = ([F.col(f"{c}{i}") for i in k] for c in ("tp", "fp", "fn"))
    total = lambda cols: sum(cols[1:], cols[0])
    safe = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    f1 = [safe(2 * tp[i], 2 * tp[i] + fp[i] + fn[i]) for i in k]
    jac = [safe(tp[i], tp[i] + fp[i] + fn[i]) for i in k]
    support = [tp[i] + fn[i] for i in k]
    out = {
        "subset_accuracy": F.col("subset"),
        "hamming": (total(fp) + total(fn)) / (F.col("n") * len(leaves)),
        "f1_micro": safe(2 * total(tp), 2 * total(tp) + total(fp) + total(fn)),
        "f1_macro": total(f1) / len(leaves),
        "f1_weighted": safe(total([f1[i] * support[i] for i in k]), total(support)),
        "jaccard_micro": safe(total(tp), total(tp) + total(fp) + total(fn)),
        "jaccard_macro": total(jac) / len(leaves),
    }
    return by.select(*group, "n", *(F.round(v, 4).alias(c) for c, v in out.items()))


def report(rows: DataFrame, group: Sequence[str], gt: str, pred: str, leaves: Sequence[str]) -> DataFrame:
    """(group, leaf, precision, recall, f1, gt_support, pred_support): a row a leaf, 0 where
    a ratio is undefined."""
    one = lambda leaf: F.struct(F.lit(leaf).alias("leaf"), F.array_contains(gt, leaf).alias("g"), F.array_contains(pred, leaf).alias("p"))
    long = rows.select(*group, F.explode(F.array(*(one(x) for x in leaves))).alias("r")).select(*group, "r.*")
    by = long.groupBy(*group, "leaf").agg(F.count_if(F.col("g") & F.col("p")).alias("tp"), F.count_if("g").alias("gt_support"), F.count_if("p").alias("pred_support"))
    safe = lambda a, b: F.round(F.coalesce(F.try_divide(a, b), F.lit(0.0)), 4)
    tp, g, p = F.col("tp"), F.col("gt_support"), F.col("pred_support")
    return by.select(*group, "leaf", safe(tp, p).alias("precision"), safe(tp, g).alias("recall"), safe(2 * tp, g + p).alias("f1"), "gt_support", "pred_support")


def set_sizes(rows: DataFrame, group: Sequence[str], gt: str, pred: str) -> DataFrame:
    """Rows of a group whose set is Discard alone, and of more than one leaf, on either side."""
    aggs = []
    for name, c in (("gt", gt), ("pred", pred)):
        aggs += [F.count_if(F.array_contains(c, DISCARD) & (F.size(c) == 1)).alias(f"n_{name}_discard"), F.count_if(F.size(c) > 1).alias(f"n_{name}_multi")]
    return rows.groupBy(*group).agg(F.count("*").alias("n"), *aggs)


def cluster_problems(clusters: DataFrame, expected: DataFrame, leaves: Sequence[str], step_of: Mapping[str, str]) -> DataFrame:
    """(cluster, why, collides) of each predicted or expected cluster.

    clusters: (cluster, leaves array); expected: (cluster). why: not expected, no prediction,
    empty, unknown leaf, Discard mixed with leaves, or nothing. collides: two leaves of one
    step, which is counted and not an error. step_of: leaf -> its step's column."""
    known = F.array(*(F.lit(v) for v in [*leaves, DISCARD]))
    got = clusters.select("cluster", "leaves", F.lit(True).alias("_p"))
    both = got.join(expected.select("cluster", F.lit(True).alias("_e")), "cluster", "full")
    why = F.when(F.col("_e").isNull(), "not expected").when(F.col("_p").isNull(), "no prediction")
    why = why.when(F.coalesce(F.size("leaves"), F.lit(0)) <= 0, "empty").when(F.size(F.array_except("leaves", known)) > 0, "unknown leaf")
    why = why.when(F.array_contains("leaves", DISCARD) & (F.size("leaves") > 1), "Discard mixed with leaves").otherwise("")
    steps = F.create_map(*(F.lit(x) for kv in step_of.items() for x in kv)) if step_of else F.create_map().cast("map<string,string>")
    named = F.transform(F.filter("leaves", lambda v: v != DISCARD), lambda v: F.try_element_at(steps, v))
    collides = F.coalesce(F.size(named) > F.size(F.array_distinct(named)), F.lit(False))
    return both.select("cluster", why.alias("why"), collides.alias("collides"))


def rater_agreement(rows: DataFrame, raters: Sequence[str], step: Sequence[str], labels: Sequence[str], ordered: bool, inside: Mapping[str, str] | None = None) -> DataFrame:
    """Pooled and macro F1 of each pair of raters over events, from one pass over the
    wide table: raters are columns. Macro leaves out (step, label) that never occur.

    inside: each rater's column that says whether the event is in the step's parent by their
    own labels; a pair is compared where both say so."""
    pairs = (permutations if ordered else combinations)(raters, 2)
    both = lambda a, b: F.col(inside[a]) & F.col(inside[b]) if inside else F.lit(True)
    rows_of = [F.struct(F.lit(a).alias("first"), F.lit(b).alias("second"), F.lit(c).alias("label"), (F.col(a) == c).alias("g"), (F.col(b) == c).alias("p"), both(a, b).alias("in")) for a, b in pairs for c in labels]
    long = rows.select(*step, F.explode(F.array(*rows_of)).alias("r")).select(*step, "r.*").where("in")
    k = long.groupBy("first", "second", *step, "label").agg(F.count_if(F.col("g") & F.col("p")).alias("tp"), F.count_if(~F.col("g") & F.col("p")).alias("fp"), F.count_if(F.col("g") & ~F.col("p")).alias("fn"))
    f1 = lambda a, b, c: F.try_divide(2 * a, 2 * a + b + c)
    pooled = f1(F.sum("tp"), F.sum("fp"), F.sum("fn"))
    return k.groupBy("first", "second").agg(F.round(pooled, 4).alias("f1_pooled"), F.round(F.avg(f1(F.col("tp"), F.col("fp"), F.col("fn"))), 4).alias("f1_macro"))


def rater_overlap(rows: DataFrame, raters: Sequence[str], group: Sequence[str]) -> DataFrame:
    """Events that any and that all raters put inside, and their ratio."""
    inside = sum((F.col(r) != UNASSIGNED).cast("int") for r in raters)
    by = rows.withColumn("_k", inside).where("_k > 0").groupBy(*group).agg(F.count("*").alias("any_rater"), F.count_if(F.col("_k") == len(raters)).alias("all_raters"))
    return by.withColumn("overlap", F.round(F.col("all_raters") / F.col("any_rater"), 4))


def typical(groups: DataFrame, key: str, weights: Mapping[str, float], eligible: Column, n: int) -> DataFrame:
    """The n eligible groups nearest the medians, in units of interquartile ranges."""
    g = groups.where(eligible)
    q = g.agg(*(F.percentile(c, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias(c) for c in weights)).first()
    if q is None or any(q[c] is None for c in weights):
        return g.select(key, F.lit(0.0).alias("score")).limit(0)
    score = sum((F.abs(F.col(c) - q[c][1]) / max(q[c][2] - q[c][0], 0.01) * w for c, w in weights.items()), F.lit(0.0))
    return g.select(key, F.round(score, 4).alias("score")).orderBy("score", key).limit(n)
