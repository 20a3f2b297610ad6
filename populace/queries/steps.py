"""Cascades with an executor (C1), bounded fan-out (C5), polygons as a table (J2)."""

from __future__ import annotations

import hashlib
import threading
import uuid

from pyspark.sql import functions as F

from ..operators import polygons as P
from ..operators import remote as R
from ..plans import agent as A
from ..plans import executor as X
from ..plans.cascade import Step
from ..plans.flagship import shared_folder
from .base import ev, query, table

PLAN = [
    Step("Step01_x|y", "ALL", "x", "y", options=("mid", "low", "high")),
    Step("Step02_y|x", "Step01_x|y == mid", "y", "x", options=("mid", "low")),
    Step("Step03_x|y", "Step01_x|y in low,high & Step02_y|x != mid", "x", "y", options=("mid", "low", "high")),
    Step("Step04_x|y", "Step03_x|y == nowhere", "x", "y", options=("mid",)),
]


class Stops:
    """Answers as the rule of thirds, and fails from a step on: the run that is cut short."""

    def __init__(self, step: int):
        self.step = step

    def __call__(self, prompt: str) -> str:
        if f'"step":{self.step}' in prompt:
            raise RuntimeError("stopped")
        return X.rule_of_thirds(prompt)


def _thirds(name, parent, before, v, w, options):
    """SQL of a step: the thirds of v among the rows of the parent."""
    mid, *rest = options
    when = f"WHEN {v} BETWEEN lo + (hi - lo) / 3 AND hi - (hi - lo) / 3 THEN '{mid}'"
    ends = {"low": f"WHEN {v} BETWEEN lo AND lo + (hi - lo) / 3 THEN 'low'", "high": f"WHEN {v} BETWEEN hi - (hi - lo) / 3 AND hi THEN 'high'"}
    # of equal areas the later given wins
    order = [ends[r] for r in reversed(rest)] + [when]
    return f"""{name} AS (SELECT b.*, CASE WHEN NOT coalesce({parent}, false) THEN 'Unassigned' {" ".join(order)} ELSE 'Unassigned' END AS {name}
  FROM {before} b LEFT JOIN (SELECT event_type, min({v}) AS lo, max({v}) AS hi FROM {before} WHERE {parent} GROUP BY 1) t USING (event_type))"""


@query("C1 C7", f"""WITH {_thirds("s1", "true", "ev", "x", "y", ["mid", "low", "high"])},
{_thirds("s2", "s1 = 'mid'", "s1", "y", "x", ["mid", "low"])},
{_thirds("s3", "s1 IN ('low', 'high') AND s2 <> 'mid'", "s2", "x", "y", ["mid", "low", "high"])}
SELECT event_type, s1, s2, s3, 'Unassigned' AS s4, count(*) AS n FROM s3 GROUP BY ALL""")
def executor_cascade(spark, sf):
    """Gates come from an executor, step by step; the first run stops before the third step."""
    folder = f"{shared_folder(spark)}/executor-{uuid.uuid4().hex}"
    cells = ev(spark, sf).select("event_id", "event_type", "x", "y")
    how = {"attempts": 1, "wait": 0, "in_flight": 4}
    try:
        X.run_cascade(cells, "event_id", "event_type", PLAN, Stops(3), folder, **how)
    except RuntimeError:
        pass
    out = X.run_cascade(cells, "event_id", "event_type", PLAN, X.rule_of_thirds, folder, **how)
    return out.groupBy("event_type", *(F.col(f"`{s.column}`").alias(f"s{i}") for i, s in enumerate(PLAN, 1))).agg(F.count("*").alias("n"))


class Service:
    """A service for trials: some prompts fail once, some always; tokens are counted."""

    def __init__(self):
        self.failed, self.lock = set(), None

    def __getstate__(self):
        return {}

    def __setstate__(self, _):
        self.failed, self.lock = set(), threading.Lock()

    def __call__(self, prompt: str):
        h = hashlib.md5(prompt.encode()).hexdigest()
        if h < "08":
            raise ConnectionError
        if h < "30":
            with self.lock:
                first = prompt not in self.failed
                self.failed ^= {prompt}
            if first:
                raise TimeoutError
        return h[:6], len(prompt), len(prompt) % 7 + 1


@query("C5 A23", """, c AS (
  SELECT c_mktsegment AS segment, c_mktsegment || ' ' || c_name || ' ' || c_custkey AS prompt FROM customer
), d AS (SELECT *, md5(prompt) AS h FROM c)
SELECT segment, count(*) AS n_calls, count(*) FILTER (h < '08') AS n_failed, sum(CASE WHEN h < '08' THEN 2 WHEN h < '30' THEN 1 ELSE 0 END)::BIGINT AS n_retries,
       sum(CASE WHEN h < '08' THEN 0 ELSE length(prompt) END)::BIGINT AS input_tokens, sum(CASE WHEN h < '08' THEN 0 ELSE length(prompt) % 7 + 1 END)::BIGINT AS output_tokens,
       (sum(CASE WHEN h < '08' THEN 0 ELSE length(prompt) END) * 1.25 + sum(CASE WHEN h < '08' THEN 0 ELSE length(prompt) % 7 + 1 END) * 10.0) / 1e6 AS cost
FROM d GROUP BY 1""".replace(", c AS (", "WITH c AS (", 1))
def bounded_calls(spark, sf):
    """Calls with 8 in flight in each task, retried, with their tokens and cost."""
    c = table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("key"), "c_mktsegment", F.concat_ws(" ", "c_mktsegment", "c_name", F.col("c_custkey").cast("string")).alias("prompt"))
    records = R.calls(c, Service(), attempts=3, wait=0, in_flight=8)
    of = c.select("key", F.col("c_mktsegment").alias("segment"))
    return R.call_report(records.join(of, "key"), ["segment"], (1.25, 10.0))


# a hexagon around a supplier's place on the plane of events, and a slimmer one for some
HEXAGONS = """, hex AS (
  SELECT 's' || s_suppkey AS category, s_suppkey AS ord, (s_suppkey * 37 % 601) / 100.0 AS cx, (s_suppkey * 53 % 1009) / 10.0 AS cy, 0.2 + (s_suppkey % 5) * 0.15 AS rx, 2.0 + (s_suppkey % 7) AS ry FROM supplier
), ring AS (
  SELECT category, ord, cx, cy, rx, ry, unnest([{'i': 0, 'a': 1.0, 'b': 0.0}, {'i': 1, 'a': 0.5, 'b': 1.0}, {'i': 2, 'a': -0.5, 'b': 1.0}, {'i': 3, 'a': -1.0, 'b': 0.0}, {'i': 4, 'a': -0.5, 'b': -1.0}, {'i': 5, 'a': 0.5, 'b': -1.0}]) AS v FROM hex
), edge AS (
  SELECT category, ord, 3.0 * rx * ry AS area, cx + rx * v.a AS x1, cy + ry * v.b AS y1,
         cx + rx * CASE v.i WHEN 0 THEN 0.5 WHEN 1 THEN -0.5 WHEN 2 THEN -1.0 WHEN 3 THEN -0.5 WHEN 4 THEN 0.5 ELSE 1.0 END AS x2,
         cy + ry * CASE v.i WHEN 0 THEN 1.0 WHEN 1 THEN 1.0 WHEN 2 THEN 0.0 WHEN 3 THEN -1.0 WHEN 4 THEN -1.0 ELSE 0.0 END AS y2 FROM ring
), held AS (
  SELECT event_id, category, ord, round(area, 9) AS area FROM ev, edge
  GROUP BY event_id, x, y, category, ord, area
  HAVING count(*) FILTER ((y < y1) <> (y < y2) AND x < x1 + (y - y1) * ((x2 - x1) / (y2 - y1))) % 2 = 1
      OR min(pow(x - x1 - greatest(0, least(1, ((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / (pow(x2 - x1, 2) + pow(y2 - y1, 2)))) * (x2 - x1), 2)
           + pow(y - y1 - greatest(0, least(1, ((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / (pow(x2 - x1, 2) + pow(y2 - y1, 2)))) * (y2 - y1), 2)) <= 1e-18
), won AS (
  SELECT event_id, arg_min(category, (area, -ord)) AS label FROM held GROUP BY 1
)
SELECT coalesce(label, 'Unassigned') AS label, count(*) AS n, sum(event_id)::BIGINT AS ids FROM ev LEFT JOIN won USING (event_id) GROUP BY 1"""


@query("J2 P8", HEXAGONS.replace(", hex AS (", "WITH hex AS (", 1))
def polygon_table(spark, sf):
    """Points in a table of polygons, the smallest of several wins."""
    s, k = table(spark, sf, "supplier"), F.col("s_suppkey")
    cx, cy, rx, ry = k * 37 % 601 / 100.0, k * 53 % 1009 / 10.0, 0.2 + k % 5 * 0.15, 2.0 + k % 7
    corners = [(1.0, 0.0), (0.5, 1.0), (-0.5, 1.0), (-1.0, 0.0), (-0.5, -1.0), (0.5, -1.0)]
    ring = F.array(*(F.array(cx + rx * a, cy + ry * b) for a, b in corners))
    gates = s.select(F.concat(F.lit("s"), k.cast("string")).alias("category"), k.alias("ord"), ring.alias("vertices"))
    out = P.assign_polygons(ev(spark, sf).select("event_id", "x", "y"), gates, "event_id", 0.25, 2.5)
    return out.groupBy("label").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


@query("C4 J11", """WITH box AS (
  SELECT event_type, min(x) AS a, max(x) AS b, min(y) AS c, max(y) AS d, count(*) AS n FROM ev GROUP BY 1
), tried AS (
  SELECT event_type, k, round(count(*) FILTER (x BETWEEN a AND a + (b - a) / pow(2, k - 1)) / any_value(n), 4) AS share FROM ev JOIN box USING (event_type), (SELECT unnest(range(1, 6)) AS k) GROUP BY ALL
), first AS (SELECT event_type, min(k) FILTER (share <= 0.25) AS k FROM tried GROUP BY 1)
SELECT event_type AS task, 'ok' AS status, CASE WHEN k IS NULL THEN 'gave up after 5' ELSE 'ok after ' || k END AS answer, (coalesce(k, 5) + 1)::INT AS n_turns, coalesce(k, 5)::INT AS n_tools FROM first""")
def agent_runs(spark, sf):
    """A task for each event type; its gate is halved until it holds a quarter of the rows."""
    e = ev(spark, sf)
    tasks = e.groupBy(F.col("event_type").alias("task")).agg(F.min("x").alias("a"), F.max("x").alias("b"), F.min("y").alias("c"), F.max("y").alias("d"))
    tasks = tasks.select("task", F.concat_ws(" ", *(F.col(c).cast("string") for c in "abcd")).alias("prompt"))
    out = A.run_agent(e.select(F.col("event_type").alias("task"), "x", "y"), tasks, A.narrowing_rule, turns=6, attempts=1, wait=0, in_flight=4)
    return out.select("task", "status", "answer", "n_turns", "n_tools")
