"""The runnable jobs on the given tables, each run twice into one new folder."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from jobs import gate_texts, robustness

from ..plans.flagship import shared_folder
from .base import query
from .scoring import PER, TASK

HERE = os.path.dirname(os.path.abspath(robustness.__file__))


def _folder(spark, name):
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


# the config's text, so that executors on other machines need no file of it
def _config(spark, name, folder):
    with open(f"{HERE}/{name}.json") as f:
        text = " ".join(f.read().split("\n"))
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/config")
    return f"{folder}/config"


ROBUST = """base AS (
  SELECT 'd' || ((l_linenumber) % 3) AS dataset, 's' || (l_suppkey % 7) AS sample, l_quantity AS x, l_extendedprice AS y, nullif(l_linestatus, 'F') AS s1, nullif(l_returnflag, 'N') AS s2,
         md5(concat_ws(':', l_orderkey, l_linenumber, l_partkey, l_suppkey, strftime(l_shipdate, '%Y-%m-%d'), l_returnflag, l_linestatus, l_quantity::INT, round(l_extendedprice * 100)::BIGINT)) AS id
  FROM lineitem
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY s2 ORDER BY md5('7:' || id), id) AS place, count(*) OVER (PARTITION BY s2) AS total FROM base
), cohort AS (
  SELECT 'as_is' AS variant, dataset, sample, x, y, s1, s2 FROM base
  UNION ALL SELECT 'without_a', dataset, sample, x, y, s1, s2 FROM base WHERE s2 IS DISTINCT FROM 'A'
  UNION ALL SELECT 'half_r', dataset, sample, x, y, s1, s2 FROM ranked WHERE s2 IS DISTINCT FROM 'R' OR place > round_even(total * 0.5, 0)
  UNION ALL SELECT 'shifted', dataset, sample, x + 4, y - 3000, s1, s2 FROM base
), pairs AS (
  SELECT variant, dataset, sample, 1 AS step, coalesce(s1, 'Unassigned') AS gt, CASE WHEN x BETWEEN 10 AND 50 AND y BETWEEN 0 AND 60000 THEN 'O' ELSE 'Unassigned' END AS pred FROM cohort
  UNION ALL
  SELECT variant, dataset, sample, 2, coalesce(s2, 'Unassigned'), CASE WHEN x BETWEEN 0 AND 15 AND y BETWEEN 0 AND 30000 THEN 'A' WHEN x BETWEEN 10 AND 30 AND y BETWEEN 20000 AND 60000 THEN 'R' ELSE 'Unassigned' END FROM cohort WHERE s1 = 'O'
), conf AS (
  SELECT variant || ':' || dataset || ':' || sample || ':' || step AS task, gt, pred, count(*) AS n FROM pairs GROUP BY ALL
), listed AS (
  SELECT DISTINCT variant || ':' || dataset || ':' || sample || ':' || step AS task, variant, dataset, sample, step, unnest(CASE step WHEN 1 THEN ['O'] ELSE ['A', 'R', 'X'] END) AS label FROM pairs
)"""
#: Metrics of ``conf`` (task, gt, pred, n) over the categories in ``listed`` (task, label).
MEASURES = f"""{PER.replace("sample", "task")},
tot AS (SELECT task, sum(n)::BIGINT AS n_cells, sum(n) FILTER (gt = pred) AS hit FROM conf GROUP BY 1),
mac AS (SELECT t.task, avg(coalesce(f1, 0)) AS f1_macro, avg(abs(coalesce(n_gt, 0) / n_cells - coalesce(n_pred, 0) / n_cells)) AS pe
  FROM tot t JOIN (SELECT DISTINCT task, label FROM listed) AS c USING (task) LEFT JOIN cls ON cls.task = t.task AND cls.label = c.label GROUP BY 1),
sup AS (SELECT task, avg(r) AS ba, sum(f1 * n_gt) / sum(n_gt) AS fw FROM cls WHERE n_gt > 0 GROUP BY 1),
measured AS (SELECT task, n_cells, round(coalesce(hit, 0) / n_cells, 4) AS accuracy, round(ba, 4) AS balanced_accuracy, round(f1_macro, 4) AS f1_macro, round(fw, 4) AS f1_weighted, round(pe, 4) AS proportion_error
  FROM tot JOIN mac USING (task) JOIN sup USING (task))"""


@query("T1 T3 A4 A6 K5", f"""WITH {ROBUST}, {MEASURES}, named AS (
  SELECT m.*, variant, dataset, sample, step FROM measured m JOIN (SELECT DISTINCT task, variant, dataset, sample, step FROM listed) USING (task)
)
SELECT a.variant, a.dataset, a.sample, a.step, a.n_cells, a.accuracy, a.balanced_accuracy, a.f1_macro, a.f1_weighted, a.proportion_error,
       b.f1_macro AS f1_macro_base, round(b.f1_macro - a.f1_macro, 4) AS f1_macro_drop
FROM named a LEFT JOIN named b ON b.variant = 'as_is' AND a.dataset = b.dataset AND a.sample = b.sample AND a.step = b.step""")
def job1_robustness(spark, sf_dir):
    folder = _folder(spark, "robustness")
    for _ in range(2):
        out = robustness.run(spark, f"{sf_dir}/lineitem.parquet", _config(spark, "robustness", folder), f"{folder}/report")
    return out


GATED = """docs AS (
  SELECT doc_id, lang AS dataset, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda s: regexp_matches(s, '[^\\x20\\x09-\\x0D]')) AS l FROM documents
), measured_docs AS (
  SELECT doc_id, dataset, len(w)::BIGINT AS n_words,
         CASE WHEN length(t) > 0 THEN 1000.0::DOUBLE * (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g'))) / length(t) ELSE 0 END AS symbols,
         CASE WHEN len(w) > 0 THEN length(regexp_replace(t, '[\\x20\\x09-\\x0D]+', '', 'g'))::DOUBLE / len(w) ELSE 0 END AS word_length,
         CASE WHEN len(l) > 0 THEN (len(l) - len(list_distinct(l)))::DOUBLE / len(l) ELSE 0 END AS repeated FROM docs
), one AS (
  SELECT *, CASE WHEN n_words BETWEEN 100 AND 1999 AND word_length BETWEEN 2 AND 12 THEN 'body' WHEN n_words BETWEEN 0 AND 99 AND word_length BETWEEN 0 AND 1000 THEN 'short'
                 WHEN n_words BETWEEN 2000 AND 100000000 AND word_length BETWEEN 2 AND 12 THEN 'long' ELSE 'Unassigned' END AS s1 FROM measured_docs
), two AS (
  SELECT *, CASE WHEN s1 NOT IN ('body', 'long') THEN 'Unassigned' WHEN symbols BETWEEN 0 AND 0.5 AND repeated BETWEEN 0 AND 0.05 THEN 'good' ELSE 'bad' END AS s2 FROM one
), three AS (
  SELECT *, CASE WHEN s2 <> 'good' THEN 'Unassigned' WHEN word_length BETWEEN 0 AND 4.3 AND symbols BETWEEN 0 AND 0.5 THEN 'toxic' WHEN word_length BETWEEN 4 AND 12 AND symbols BETWEEN 0 AND 0.5 THEN 'clean' ELSE 'Unassigned' END AS s3 FROM two
), truth AS (
  SELECT doc_id, min(CASE WHEN quality = 1 THEN 'good' ELSE 'bad' END) AS t2, min(CASE WHEN toxic = 1 THEN 'toxic' ELSE 'clean' END) AS t3 FROM labels GROUP BY 1
), gated AS (
  SELECT * FROM three LEFT JOIN truth USING (doc_id)
), pairs AS (
  SELECT coalesce(dataset, '?') AS dataset, 'Step02_symbol|repeat' AS step, coalesce(t2, 'Unassigned') AS gt, s2 AS pred FROM gated WHERE s1 IN ('body', 'long')
  UNION ALL SELECT coalesce(dataset, '?'), 'Step03_word|symbol', coalesce(t3, 'Unassigned'), s3 FROM gated WHERE s2 = 'good'
), conf AS (
  SELECT dataset || ':' || step AS task, gt, pred, count(*) AS n FROM pairs GROUP BY ALL
), listed AS (
  SELECT DISTINCT dataset || ':' || step AS task, dataset, step, unnest(CASE WHEN step LIKE 'Step02%' THEN ['good', 'bad'] ELSE ['toxic', 'clean'] END) AS label FROM pairs
)"""


@query("K6 C1 A4 S7", f"""WITH {GATED}, {MEASURES}, named AS (SELECT m.*, dataset, step FROM measured m JOIN (SELECT DISTINCT task, dataset, step FROM listed) USING (task))
SELECT 'document' AS row_kind, dataset, doc_id, n_words, word_length, symbols, repeated, s1 AS step1, s2 AS step2, s3 AS step3, t2 AS truth2, t3 AS truth3,
       NULL AS step, NULL::BIGINT AS n_cells, NULL::DOUBLE AS accuracy, NULL::DOUBLE AS balanced_accuracy, NULL::DOUBLE AS f1_macro, NULL::DOUBLE AS f1_weighted, NULL::DOUBLE AS proportion_error FROM gated
UNION ALL
SELECT 'metrics', nullif(dataset, '?'), NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, step, n_cells, accuracy, balanced_accuracy, f1_macro, f1_weighted, proportion_error FROM named""")
def job2_gate_texts(spark, sf_dir):
    folder = _folder(spark, "gate-texts")
    # a pattern that one name fits: a stream takes a folder's files or a pattern's, never a single file
    new = f"{sf_dir}/documents.parque[t]"
    for _ in range(2):
        labelled, metrics = gate_texts.run(spark, new, f"{sf_dir}/labels.parquet", _config(spark, "gate_texts", folder), f"{folder}/out")
    steps = [c for c in labelled.columns if c.startswith("Step")]
    named = {f"step{i}": c for i, c in enumerate(steps, 1)} | {"truth2": f"truth_{steps[1]}", "truth3": f"truth_{steps[2]}"}
    rows = labelled.select(F.lit("document").alias("row_kind"), "dataset", "doc_id", "n_words", "word_length", "symbols", "repeated", *(F.col(f"`{c}`").alias(n) for n, c in named.items()))
    return rows.unionByName(metrics.select(F.lit("metrics").alias("row_kind"), "*"), allowMissingColumns=True)
