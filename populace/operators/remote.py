"""External calls over rows: an injected function, retries, bounded fan-out and accounting.

The function runs on the executors, inside Arrow batches, because a remote service sets
the pace: each task keeps a bounded number of calls in flight. Resume by anti-joining the
work list with the sink.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator, Mapping
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RECORD = "key string, answer string, attempts int, seconds double, status string, input_tokens long, output_tokens long"
_SHORT = "key string, answer string, attempts int, seconds double, status string"


def _asked(fn: Callable, key: str, prompt: str, attempts: int, wait: float) -> tuple:
    """One row's record: fn gives an answer, or an answer and the tokens it took in and gave."""
    began, answer, status, n, tokens = time.monotonic(), None, "failed", 0, (0, 0)
    while n < attempts and status != "ok":
        n += 1
        try:
            answer, status = fn(prompt), "ok"
            if isinstance(answer, tuple):
                answer, *tokens = answer
        except Exception as e:  # noqa: BLE001  any failure of the service is retried
            status = f"failed: {type(e).__name__}"
            if n < attempts:
                time.sleep(wait * 2 ** (n - 1))
    return (key, answer, n, time.monotonic() - began, status, *tokens)


def calls(rows: DataFrame, fn: Callable, attempts: int = 3, wait: float = 1.0, in_flight: int = 1) -> DataFrame:
    """RECORDs of fn(prompt) for rows (key, prompt), in the order of the rows.

    in_flight: the calls that a task has open at once; a session's are at most that times its
    task slots. A slow call holds up no other one, only the order of what comes out; what waits
    is bounded by the batch. fn must bear being called from several threads. A null prompt is
    passed on as it is; a call that fails ``attempts`` times is a row with its failure as status."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in RECORD.split(", ")]
        with ThreadPoolExecutor(max(1, in_flight)) as pool:
            for b in batches:
                got = pool.map(lambda r: _asked(fn, r[0], r[1], attempts, wait), zip(b["key"], b["prompt"]))
                yield pd.DataFrame(list(got), columns=names)

    return rows.select(F.col("key").cast("string").alias("key"), "prompt").mapInPandas(run, RECORD)


def call(rows: DataFrame, fn: Callable, attempts: int = 3, wait: float = 1.0, in_flight: int = 1) -> DataFrame:
    """(key, answer, attempts, seconds, status) of :func:`calls`."""
    return calls(rows, fn, attempts, wait, in_flight).select(*(c.split()[0] for c in _SHORT.split(", ")))


def cost(input_tokens: Column, output_tokens: Column, prices: tuple[float, float]) -> Column:
    """Of tokens, at prices for a million of each kind."""
    return (input_tokens * prices[0] + output_tokens * prices[1]) / 1e6


def call_report(records: DataFrame, by: list[str], prices: tuple[float, float]) -> DataFrame:
    """Calls, failures, retries, tokens and cost of RECORDs by some of their columns."""
    tokens = [F.sum(c).alias(c) for c in ("input_tokens", "output_tokens")]
    out = records.groupBy(*by).agg(F.count("*").alias("n_calls"), F.count_if(F.col("status") != "ok").alias("n_failed"), F.sum(F.col("attempts") - 1).alias("n_retries"), *tokens)
    return out.withColumn("cost", cost(F.col("input_tokens"), F.col("output_tokens"), prices))


def exists(spark, path: str) -> bool:
    return not _gone(spark, path)


def _gone(spark, path: str, delete: bool = False) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if delete:
        fs.delete(p, True)
    return not fs.exists(p)


def call_in_batches(rows: DataFrame | None, fn: Callable[[str], str], folder: str, config: Mapping, batches: int = 4, spark=None, **how) -> DataFrame:
    """The answers (key, answer, attempts, seconds, status) to rows (key, prompt), by batches
    that are checkpointed in ``folder``, a shared one.

    A folder of another configuration, or with answers to keys that aren't asked for, is an
    error, and so are repeated keys. Only keys without an answer are asked. A batch is committed
    whole; where calls of it failed, the answers it got stay and the run ends with an error, to
    be resumed. When every key has its answer the checkpoint is replaced by the result, for
    which no rows are needed (rows: None, with the session).
    """
    spark, want = spark or rows.sparkSession, json.dumps(dict(config), sort_keys=True)
    meta, done, result = f"{folder}/meta", f"{folder}/records", f"{folder}/result"
    schema = _SHORT
    if rows is not None and rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").limit(1).count():
        raise ValueError("a key is asked for twice")
    if _gone(spark, meta):
        spark.createDataFrame([(want,)], "value string").coalesce(1).write.text(meta)
        spark.createDataFrame([], schema).write.parquet(done)
    elif spark.read.text(meta).first()[0] != want:
        raise ValueError(f"the checkpoint in {folder} is of another configuration")
    if exists(spark, f"{result}/_SUCCESS"):
        return spark.read.schema(schema).parquet(result)
    records = lambda: spark.read.schema(schema).parquet(done)
    if records().join(rows, "key", "left_anti").limit(1).count():
        raise ValueError(f"the checkpoint in {folder} has keys that aren't asked for")
    for b in range(batches):
        todo = rows.where(F.pmod(F.xxhash64("key"), F.lit(batches)) == b).join(records().select("key"), "key", "left_anti")
        trial = f"{folder}/batch"
        call(todo, fn, **how).write.mode("overwrite").parquet(trial)
        got = spark.read.schema(schema).parquet(trial)
        got.where("status = 'ok'").write.mode("append").parquet(done)
        failed = got.where("status <> 'ok'")
        if n := failed.count():
            raise RuntimeError(f"{n} calls failed; first: {failed.orderBy('key').first()}")
    if rows.join(records(), "key", "left_anti").limit(1).count():
        raise RuntimeError(f"the checkpoint in {folder} lacks answers")
    records().write.mode("overwrite").parquet(result)
    for path in (done, f"{folder}/batch"):
        _gone(spark, path, delete=True)
    return spark.read.schema(schema).parquet(result)


def dialogue(prompt: str, ask: Callable[[list, bool], dict], tools: dict[str, Callable[[dict], str]], turns: int = 4) -> dict:
    """A bounded agent loop: the first turn must call a tool, the last one must answer."""
    history: list = [{"role": "user", "text": prompt}]
    used = []
    for turn in range(turns):
        said = ask(history, turn < turns - 1)
        history.append({"role": "assistant", **said})
        name = said.get("tool")
        if name is None or turn == turns - 1:
            if turn == 0 and turns > 1:
                history.append({"role": "user", "text": "call a tool first"})
                continue
            break
        used.append(name)
        result = tools[name](said.get("args", {})) if name in tools else f"no such tool: {name}"
        history.append({"role": "tool", "name": name, "text": result})
    return {"answer": history[-1].get("text"), "tools": used, "turns": len([h for h in history if h["role"] == "assistant"])}
