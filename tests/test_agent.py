"""Agent runs over many tasks: forced first call, read-backs, last text, failures."""

import json

import pytest
from pyspark.sql import functions as F

from populace.plans import agent as A


def cells(spark):
    return spark.createDataFrame([("t1", float(i), float(i % 5)) for i in range(20)] + [("t2", float(i), 1.0) for i in range(4)] + [("t3", None, 1.0)], "task string, x double, y double")


def gate(category, a, b, c=0, d=4):
    return {"category": category, "x_min": a, "x_max": b, "y_min": c, "y_max": d}


class Script:
    """Says what it was given for each task, turn by turn; the prompt is the task's name."""

    def __init__(self, by_task):
        self.by_task = by_task

    def __call__(self, prompt):
        p = json.loads(prompt)
        said = self.by_task[p["talk"][0]["text"]][p["turn"]]
        if said == "fail":
            raise RuntimeError
        return said if isinstance(said, str) else json.dumps(said)


def test_talks(spark):
    call = {"tool": A.TOOL, "gates": [gate("a", 0, 9), gate("b", 5, 30), gate("a", 18, 19)]}
    script = {
        "t1": [call, {"text": "done"}],
        "t2": [{"text": "at once"}, {"tool": "other"}, {"tool": A.TOOL, "gates": []}, {"text": "late"}],
        "t3": [call, call, call, call],
        "t4": ["no json", {"text": "x"}],
        "t5": ["fail", {"text": "x"}],
    }
    tasks = spark.createDataFrame([(t, t) for t in script], "task string, prompt string").withColumn("status", F.lit("clash"))
    got = {r["task"]: r for r in A.run_agent(cells(spark), tasks, Script(script), turns=4, attempts=1, wait=0, in_flight=3).collect()}
    assert {t: (r["status"], r["answer"], r["n_turns"], r["n_tools"]) for t, r in got.items()} == {"t1": ("ok", "done", 2, 1), "t2": ("ok", "late", 4, 2), "t3": ("no answer", None, 4, 4), "t4": ("failed", None, 1, 0), "t5": ("failed", None, 1, 0)}
    back = got["t1"]["talk"][2]
    # x 5 to 9 is in both: the first gate is smaller; 18 and 19 in the least one
    assert back["role"] == "tool" and back["text"].split("\n") == ["Unassigned: 0 rows, 0.0000", "a: 12 rows, 0.6000", "b: 8 rows, 0.4000", "b reaches beyond the data", "a overlaps b", "b overlaps a"]
    assert [m["text"] for m in got["t2"]["talk"] if m["role"] in ("user", "tool")] == ["t2", A.FIRST, "no such tool: other", A.NO_GATES]
    assert "a: 0 rows, 0.0000" in got["t3"]["talk"][2]["text"] and "Unassigned: 1 rows, 1.0000" in got["t3"]["talk"][2]["text"]
    assert got["t1"]["talk"][-1]["role"] == "assistant"


def test_odd_tasks(spark):
    script = Script({"": [{"text": "a"}]})
    one = A.run_agent(cells(spark), spark.createDataFrame([("t9", None)], "task string, prompt string"), script, turns=1, attempts=1, wait=0).first()
    assert (one["status"], one["answer"]) == ("ok", "a")  # with one turn there is no forced call
    none = spark.createDataFrame([], "task string, prompt string")
    assert A.run_agent(cells(spark), none, script).count() == 0
    with pytest.raises(ValueError, match="twice"):
        A.run_agent(cells(spark), spark.createDataFrame([("t", "p"), ("t", "p")], none.schema), script)
