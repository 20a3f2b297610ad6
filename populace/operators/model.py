"""Scores of a trained encoder: weights as a Parquet table, a forward pass over Arrow batches.

A model is rows (name, shape, values): dense layers ``layer0.weight`` (out, in) and
``layer0.bias`` and so on, with a rectifier after each, and for each step of a plan a head
``head.<step>.weight``, ``head.<step>.bias`` over the last layer. It is read once, its size
is checked, and it is sent to every executor once; one scan of the rows scores all steps.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of weights (double precision) that are sent at most, and rows of a matrix product.
MODEL_BYTES, ROWS = 256 << 20, 4096


def save_model(spark: SparkSession, arrays: Mapping[str, np.ndarray], path: str) -> None:
    rows = [(name, list(a.shape), np.asarray(a, float).ravel().tolist()) for name, a in arrays.items()]
    spark.createDataFrame(rows, "name string, shape array<int>, values array<double>").write.mode("overwrite").parquet(path)


def load_model(spark: SparkSession, path: str, most: int = MODEL_BYTES) -> dict[str, np.ndarray]:
    """The arrays of a model; one that exceeds ``most`` bytes, or whose shapes don't fit, is an error."""
    t = spark.read.parquet(path)
    size = (t.agg(F.sum(F.size("values"))).first()[0] or 0) * 8
    if size > most:
        raise ValueError(f"the model takes {size} bytes, more than {most}")
    model = {r["name"]: np.array(r["values"], float).reshape(r["shape"]) for r in t.collect()}
    width, k = None, 0
    while f"layer{k}.weight" in model:
        w, b = model[f"layer{k}.weight"], model[f"layer{k}.bias"]
        if w.shape[0] != b.size or width not in (None, w.shape[1]):
            raise ValueError(f"layer {k} doesn't fit")
        width, k = w.shape[0], k + 1
    for name, w in model.items():
        if name.startswith("head.") and name.endswith(".weight") and (width not in (None, w.shape[1]) or model[name[:-6] + "bias"].size != w.shape[0]):
            raise ValueError(f"{name} doesn't fit")
    return model


def steps_of(model: Mapping[str, np.ndarray]) -> list[str]:
    return sorted(n[5:-7] for n in model if n.startswith("head.") and n.endswith(".weight"))


def forward(model: Mapping[str, np.ndarray], x: np.ndarray) -> dict[str, np.ndarray]:
    """Each step's class probabilities for rows of x."""
    k = 0
    while f"layer{k}.weight" in model:
        x = np.maximum(x @ model[f"layer{k}.weight"].T + model[f"layer{k}.bias"], 0)
        k += 1
    out = {}
    for step in steps_of(model):
        z = x @ model[f"head.{step}.weight"].T + model[f"head.{step}.bias"]
        e = np.exp(z - z.max(axis=1, keepdims=True))
        out[step] = e / e.sum(axis=1, keepdims=True)
    return out


def score(rows: DataFrame, key: str, features: str, model: Mapping[str, np.ndarray], classes: Mapping[str, Sequence[str]]) -> DataFrame:
    """(key, step, label, probability) for every row and step: the likeliest of the step's
    classes, the first of equal ones. features: an array column; where it is null, has another
    length than the first layer or holds a null or non-finite number, label and probability are null."""
    steps = steps_of(model)
    if any(len(classes[s]) != model[f"head.{s}.bias"].size for s in steps):
        raise ValueError("a step has other classes than its head")
    first = model.get("layer0.weight", model[f"head.{steps[0]}.weight"] if steps else np.empty((0, 0)))
    dim, held = first.shape[1], rows.sparkSession.sparkContext.broadcast((dict(model), {s: list(classes[s]) for s in steps}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, names = held.value
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                b = whole.slice(at, ROWS)
                lists = [v if v is not None and len(v) == dim and None not in v else None for v in b.column(1).to_pylist()]
                x = np.array([v if v is not None else [0.0] * dim for v in lists], float).reshape(len(lists), dim)
                ok = np.array([v is not None for v in lists], bool) & np.isfinite(x).all(axis=1)
                made = forward(weights, np.where(ok[:, None], x, 0.0))
                for s in steps:
                    best = made[s].argmax(axis=1)
                    label = pa.array(np.array(names[s], object)[best], pa.string(), mask=~ok)
                    yield pa.RecordBatch.from_arrays([b.column(0), pa.array([s] * len(lists)), label, pa.array(made[s].max(axis=1), pa.float64(), mask=~ok)], ["key", "step", "label", "probability"])

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(F.col(key).alias("key"), F.col(features).cast("array<double>").alias("features")).mapInArrow(run, f"key {kind}, step string, label string, probability double")
