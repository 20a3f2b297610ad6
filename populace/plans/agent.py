"""Agent runs over many tasks at once: turns of a model, tools whose read-backs Spark computes.

A turn asks the model about every open task (bounded fan-out on the executors); what it
says is a tool call with gates, or its answer. The gates of all tasks then meet all cells
in one join, and each task reads back what its own gates would do: rows and share of every
category, gates beyond the data, gates that overlap. The first turn must call the tool (else the
task is told so, and goes on), the last one must answer. State is written between turns.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import UNASSIGNED
from ..operators.gates import overlaps
from ..operators.remote import calls
from .executor import GATES, winner
from .flagship import cut_lineage, discard

#: What a model says: the tool it calls with what gates, or a text.
SAID = f"struct<tool: string, gates: {GATES}, text: string>"
TOOL, FIRST, NO_GATES = "check_gates", "call the tool first", "no gates given: call again with gates, or answer"
_TALK = "array<struct<role: string, text: string>>"


def _turn(role: str, text: Column) -> Column:
    return F.array(F.struct(F.lit(role).alias("role"), text.alias("text")))


def proposals(said: DataFrame) -> DataFrame:
    """(task, ord, category, x_min, x_max, y_min, y_max) from the rectangles in ``said`` (task, gates)."""
    g = said.select("task", F.posexplode("gates").alias("ord", "g")).select("task", "ord", "g.*").drop("vertices")
    return g.dropna(subset=["category", "x_min", "x_max", "y_min", "y_max"])


def read_backs(cells: DataFrame, gates: DataFrame) -> DataFrame:
    """(task, text): for each task with gates, a line for every category by name (rows, share of
    the task's rows) and Unassigned, then those of gates beyond the data, then of overlaps.

    cells: (task, x, y). A gate's task may be without cells: its categories have none."""
    sized = gates.select("task", F.struct("category", "x_min", "x_max", "y_min", "y_max", F.lit(None).cast("array<struct<x1: double, y1: double, x2: double, y2: double>>").alias("ring"), ((F.col("x_max") - F.col("x_min")) * (F.col("y_max") - F.col("y_min"))).alias("area"), (-F.col("ord")).alias("o"), "ord").alias("g"))
    by = sized.groupBy("task").agg(F.array_sort(F.collect_list("g")).alias("_g"))
    placed = cells.join(by, "task").select("task", "x", "y", F.coalesce(winner(F.col("x"), F.col("y"), F.col("_g")), F.lit(UNASSIGNED)).alias("category"))
    n = placed.groupBy("task", "category").agg(F.count("*").alias("n"))
    box = placed.groupBy("task").agg(F.count("*").alias("total"), *(f(c).alias(f"d{c}{k}") for c in "xy" for k, f in ((0, F.min), (1, F.max))))
    every = gates.select("task", "category").union(gates.select("task", F.lit(UNASSIGNED))).distinct()
    shares = every.join(n, ["task", "category"], "left").join(box, "task", "left").fillna(0, ["n", "total"])
    share = F.coalesce(F.try_divide(F.col("n"), F.col("total")), F.lit(0.0))
    lines = shares.select("task", F.lit(0).alias("kind"), F.col("category").alias("a"), F.lit("").alias("b"), F.format_string("%s: %d rows, %.4f", "category", "n", share).alias("line"))
    beyond = (F.col("x_min") < F.col("dx0")) | (F.col("x_max") > F.col("dx1")) | (F.col("y_min") < F.col("dy0")) | (F.col("y_max") > F.col("dy1"))
    lines = lines.union(gates.join(box, "task").where(beyond).select("task", F.lit(1), "category", F.col("ord").cast("string"), F.format_string("%s reaches beyond the data", "category")))
    pairs = overlaps(gates, ["task"]).where("first <> second")
    lines = lines.union(pairs.select("task", F.lit(2), "first", "second", F.format_string("%s overlaps %s", "first", "second")))
    return lines.groupBy("task").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("kind", "a", "b", "line"))), lambda s: s["line"]), "\n").alias("text"))


def run_agent(cells: DataFrame, tasks: DataFrame, ask: Callable[[str], str], turns: int = 4, **how) -> DataFrame:
    """(task, status, answer, n_turns, n_tools, talk) of tasks (task, prompt).

    ask: from JSON (turn, last, talk: roles and texts so far) to JSON (tool, gates) or (text). how:
    attempts, wait and in_flight of the calls. status: ok, no answer (its last turn called the tool
    again), or failed (a call failed, or what it said is no such JSON). A null prompt is an empty one;
    tasks without cells are asked too; repeated tasks are an error."""
    if tasks.groupBy("task").count().where("count > 1").limit(1).count():
        raise ValueError("a task is given twice")
    start = tasks.select(F.col("task").cast("string").alias("task"), F.lit("open").alias("status"), F.lit(None).cast("string").alias("answer"), F.lit(0).alias("n_turns"), F.lit(0).alias("n_tools"), _turn("user", F.coalesce("prompt", F.lit(""))).cast(_TALK).alias("talk"))
    cells = cells.withColumn("task", F.col("task").cast("string"))
    now = cut_lineage(start)
    for turn in range(turns):
        last = turn == turns - 1
        open_ = now.where("status = 'open'")
        if open_.isEmpty():
            break
        asked = open_.select(F.col("task").alias("key"), F.to_json(F.struct(F.lit(turn).alias("turn"), F.lit(last).alias("last"), "talk")).alias("prompt"))
        got = calls(asked, ask, **how)
        said = cut_lineage(got.select(F.col("key").alias("task"), "answer", "status").withColumnRenamed("status", "call"))
        parsed = cut_lineage(said.select("task", "call", F.col("answer").alias("raw"), F.from_json("answer", SAID).alias("s")).select("task", "call", "raw", "s.tool", "s.gates", "s.text"))
        calling = parsed.where(F.col("tool").isNotNull())
        back = cut_lineage(read_backs(cells, proposals(calling.where(F.col("tool") == TOOL))))
        joined = open_.drop("answer").join(parsed, "task").join(back.withColumnRenamed("text", "back"), "task", "left")
        broken = (F.col("call") != "ok") | (F.col("tool").isNull() & F.col("text").isNull())
        called = F.col("tool").isNotNull()
        forced = ~called & F.lit(turn == 0 and turns > 1)
        result = F.when(F.col("tool") != TOOL, F.concat(F.lit("no such tool: "), F.col("tool"))).otherwise(F.coalesce("back", F.lit(NO_GATES)))
        status = F.when(broken, "failed").when(called, "no answer" if last else "open").when(forced, "open").otherwise("ok")
        said_now = F.concat("talk", _turn("assistant", F.coalesce("raw", F.lit(""))))
        talk = F.when(broken, F.col("talk")).when(called & F.lit(not last), F.concat(said_now, _turn("tool", result))).when(forced, F.concat(said_now, _turn("user", F.lit(FIRST)))).otherwise(said_now)
        stepped = joined.select("task", status.alias("status"), F.when(status == "ok", F.col("text")).alias("answer"), (F.col("n_turns") + 1).alias("n_turns"), (F.col("n_tools") + (called & ~broken).cast("int")).alias("n_tools"), talk.cast(_TALK).alias("talk"))
        after = cut_lineage(now.where("status <> 'open'").union(stepped))
        discard(now, said, parsed, back)
        now = after
    return now


def narrowing_rule(prompt: str) -> str:
    """A model for tests and trials: a first gate over the lower half of the data that it is told of
    (x_min x_max y_min y_max in the prompt), halved until it holds a quarter of the rows or less."""
    p = json.loads(prompt)
    talk = p["talk"]
    a, b, c, d = map(float, talk[0]["text"].split())
    tried = [json.loads(t["text"]) for t in talk if t["role"] == "assistant"]
    high = tried[-1]["gates"][0]["x_max"] if tried else a + 2 * (b - a)
    share = None
    if talk[-1]["role"] == "tool":
        share = next(float(line.rsplit(" ", 1)[1]) for line in talk[-1]["text"].split("\n") if line.startswith("low: "))
    if share is not None and share <= 0.25 or p["last"]:
        return json.dumps({"text": f"{'ok' if share is not None and share <= 0.25 else 'gave up'} after {len(tried)}"})
    return json.dumps({"tool": TOOL, "gates": [{"category": "low", "x_min": a, "x_max": a + (high - a) / 2, "y_min": c, "y_max": d}]})
