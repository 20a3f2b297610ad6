"""Character n-gram classifier with naive-Bayes-scaled features.

A text is lower-cased, its white space runs become one space, and its distinct
character n-grams (several n) are hashed to ``2**bits`` features. Features are
scaled by their naive Bayes log-count ratio; a logistic regression is fitted on
the scaled features of a bounded sample of labelled rows (at most
``per_class`` of each label, in the order of a hash of doc_id). Every text is
scored whole: weights of its distinct features are summed.

Nulls: a null text is empty and gets the model's score without features. Without
labels of both kinds the score is the share of label 1 (0 where there is none).
Repeated rows score alike; an empty table gives an empty result; extra columns are
ignored. A long text is scored whole, and may exceed the sample's bound of characters:
it is then no part of the sample. A doc_id that labels repeat counts once, as toxic if
any of its rows says so. Where documents repeat a doc_id with other texts, the least text
that isn't null is learned from.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, trim

ORDERS = (4, 5, 6)
BITS = 20
#: Labelled rows of each class that the model is fitted on at most.
PER_CLASS = 2000
#: Characters of the sample's texts together.
MAX_CHARS = 40_000_000


def features(text: str | None, orders=ORDERS, bits: int = BITS) -> np.ndarray:
    """Sorted distinct feature numbers of a whole text."""
    t = " ".join((text or "").lower().split())
    if not t:
        return np.empty(0, np.uint32)
    x = np.frombuffer(f" {t} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    found = []
    h = np.zeros(x.size, np.uint32)
    for n in range(1, max(orders) + 1):
        if x.size < n:
            break
        h = h[: x.size - n + 1] * np.uint32(0x01000193) + (x[n - 1 :] + np.uint32(1)) * np.uint32(0x9E3779B1)
        if n in orders:
            found.append((h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B) >> np.uint32(32 - bits))
    if not found:
        return np.empty(0, np.uint32)
    out = np.sort(np.concatenate(found))
    return out[np.concatenate([[True], out[1:] != out[:-1]])]


@dataclass
class Model:
    """Log odds: bias + the sum of weights of a text's distinct features."""

    bias: float
    weights: np.ndarray

    def score(self, text: str | None) -> float:
        z = self.bias + float(self.weights[features(text)].sum(dtype=np.float64))
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def fit(texts: list[str | None], labels: np.ndarray, prior: float, min_docs: int = 5, rounds: int = 300, l2: float = 1e-3, keep: int = 20_000, least: float = 12.0, bits: int = BITS) -> Model:
    """Deterministic full-batch fit. prior: share of label 1 among all labelled rows."""
    size = 1 << bits
    if not len(texts) or labels.min() == labels.max():
        p = float(np.clip(prior, 1e-9, 1 - 1e-9)) if len(texts) else 1e-9
        return Model(float(np.log(p / (1 - p))), np.zeros(size, np.float32))
    y = labels.astype(np.float64)
    counts = np.zeros((2, size))
    for t, k in zip(texts, labels):  # features aren't held: they are many times the texts
        counts[int(k), features(t, bits=bits)] += 1
    neg, pos = counts
    n1, n0 = y.sum(), (1 - y).sum()
    ratio = np.log((pos + 1) / (n1 + 2)) - np.log((neg + 1) / (n0 + 2))
    # likelihood-ratio statistic of each feature against the label's share; features of
    # too few texts or without enough evidence would only fit noise
    n = pos + neg
    share = n1 / (n1 + n0)
    with np.errstate(divide="ignore", invalid="ignore"):
        evidence = 2 * (np.where(pos > 0, pos * np.log(pos / (n * share)), 0) + np.where(neg > 0, neg * np.log(neg / (n * (1 - share))), 0))
    evidence[(n < min_docs) | (evidence < least)] = 0
    chosen = np.argsort(-evidence, kind="stable")[:keep]
    chosen = chosen[evidence[chosen] > 0]
    place = np.full(size, -1)
    place[chosen] = np.arange(chosen.size)
    found = [place[f][place[f] >= 0].astype(np.int32) for f in (features(t, bits=bits) for t in texts)]
    owner, col = np.repeat(np.arange(len(found), dtype=np.int32), [f.size for f in found]), np.concatenate(found)
    value = ratio[chosen][col]
    each = np.where(y == 1, prior / n1, (1 - prior) / n0)  # as frequent as among all labelled rows
    w, b = np.zeros(chosen.size), float(np.log(prior / (1 - prior)))
    gw, gb, step = np.full(chosen.size, 1e-8), 1e-8, 0.3
    for _ in range(rounds):  # AdaGrad
        z = b + np.bincount(owner, value * w[col], y.size)
        g = each * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
        dw = np.bincount(col, value * g[owner], chosen.size) + l2 * w / y.size
        db = g.sum()
        gw += dw * dw
        gb += db * db
        w -= step * dw / np.sqrt(gw)
        b -= step * db / np.sqrt(gb)
    weights = np.zeros(size, np.float32)
    weights[chosen] = w * ratio[chosen]
    return Model(b, weights)


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", id_col: str = "doc_id", text: str = "text", per_class: int = PER_CLASS, max_chars: int = MAX_CHARS) -> Model:
    """Fit on whole texts of at most 2 * per_class labelled rows, max_chars in all (a text that
    would exceed them is left out); the label's share is of all labelled rows."""
    known = labels.where(F.col(label).isin(0, 1)).groupBy(F.col(id_col).alias("_id")).agg(F.max(label).alias("_y")).where("_id is not null")
    n, ones = known.agg(F.count("*"), F.coalesce(F.sum("_y"), F.lit(0))).first()
    order = F.xxhash64("_id"), F.col("_id")
    sample = known.where("_y = 1").orderBy(*order).limit(per_class).union(known.where("_y = 0").orderBy(*order).limit(per_class))
    # the sample's size is bounded by a parameter, so it can be broadcast
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text).alias("_t"))
    sized = texts.join(F.broadcast(sample), "_id").groupBy("_id", "_y").agg(F.max(F.length("_t")).alias("n")).collect()
    left, chosen = max_chars, []
    for r in sorted(sized, key=lambda r: zlib.crc32(str(r["_id"]).encode())):
        if (r["n"] or 0) <= left:  # a text that doesn't fit is left out, not those after it
            left -= r["n"] or 0
            chosen.append((r["_id"], r["_y"]))
    wanted = docs.sparkSession.createDataFrame(chosen, sample.schema)
    # of the texts of a repeated id the least one
    rows = texts.join(F.broadcast(wanted), "_id").groupBy("_id", "_y").agg(F.min("_t").alias("_t")).collect()
    rows.sort(key=lambda r: r["_id"])
    return fit([r["_t"] for r in rows], np.array([r["_y"] for r in rows], np.int64), float(np.clip(ones / n, 1e-6, 1 - 1e-6)) if n else 0.0)


def scorer(spark, model: Model):
    """A column function: score (0 to 1) of a text column."""
    bounded_batches(spark)
    held = spark.sparkContext.broadcast((model.bias, np.flatnonzero(model.weights).astype(np.int32), model.weights[model.weights != 0], model.weights.size))

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bias, at, w, size = held.value
        weights = np.zeros(size, np.float32)
        weights[at] = w
        m = Model(bias, weights)
        try:
            for texts in batches:
                yield texts.map(m.score, na_action=None).astype("float64")
        finally:
            trim()

    return lambda column: score(column)


def held_out(id_col: str = "doc_id", folds: int = 5) -> Column:
    """Rows that labels are never learned from: crc32 of the id as text, modulo folds, is 0."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == 0, F.lit(True))


def score_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted; fitted on rows that aren't held out."""
    model = train(docs, labels.where(~held_out(id_col)), id_col=id_col, text=text)
    s = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), scorer(docs.sparkSession, model)(F.col(text)).alias("score"))
    return s.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
