"""Rows that a hash or a repeated id could confuse."""

import random

import numpy as np
from pyspark.sql import functions as F

from populace.llm import suffix, toxicity

from .test_texts import as_rows, brute_repeats

SCHEMA = "doc_id long, text string"


def test_op6_windows_with_an_equal_first_hash_stay_apart(spark):
    """Hot anchors tell windows apart by both hashes: with the first one forced to be equal
    nothing but repeats goes, and neither hash is a function of the other."""
    rng = random.Random(3)
    gram = "".join(rng.choices("abcdefgh", k=40))
    rows = [(i, "".join(rng.choices("ijklmnop", k=90)) + gram + "".join(rng.choices("ijklmnop", k=90))) for i in range(12)]
    rows += [(50, rows[3][1][20:190]), (51, rows[3][1]), (52, "x" + rows[7][1])]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    want = brute_repeats(rows, 100)
    assert as_rows(suffix.remove(df, 100, hot=1)) == want
    forced = lambda w: (F.lit(7).cast("long"), suffix.two_hashes(w)[1])
    assert as_rows(suffix.remove(df, 100, hot=1, two_hashes=forced)) == want
    h1, h2 = suffix.two_hashes(F.col("w"))
    got = spark.range(200).select(F.md5(F.col("id").cast("string").cast("binary")).alias("w")).select(h1.alias("a"), h2.alias("b"), F.xxhash64(F.col("w"), F.lit(1)).alias("chained"))
    assert all(r["b"] != r["chained"] for r in got.collect())


def test_op8_repeated_ids_with_other_texts(spark):
    rng = random.Random(5)
    word = lambda bad: " ".join(rng.choices(["awful", "vile", "stupid"] if bad else ["kind", "fine", "lovely"], k=30))
    rows = [(i, word(i % 2)) for i in range(60)] + [(i, word(1 - i % 2)) for i in range(60)] + [(3, None)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    models = [toxicity.train(spark.createDataFrame(r, SCHEMA).repartition(n), labels) for r, n in ((rows, 1), (rows[::-1], 7))]
    least = {d: min(t for e, t in rows if e == d and t is not None) for d, _ in rows}
    one = toxicity.train(spark.createDataFrame(sorted(least.items()), SCHEMA), labels)
    for m in models:
        assert m.bias == one.bias and np.array_equal(m.weights, one.weights)


def test_op9_ranges_that_share_words_are_one():
    from populace.llm.substring import overlapping, without, word_spans

    rng = random.Random(6)
    text = "\n".join(" ".join(f"w{rng.randrange(99)}" for _ in range(rng.randint(1, 30))) for _ in range(12))
    n = len(text.split())
    for _ in range(200):
        ranges = sorted((a, a + rng.randint(1, 12)) for a in (rng.randrange(n) for _ in range(rng.randint(1, 9))))
        got = overlapping(np.array([a << 32 | b for a, b in reversed(ranges)], np.int64))
        assert all(b <= c for (_, b), (c, _) in zip(got, got[1:])) and without(text, word_spans(text, got)) == without(text, word_spans(text, ranges))
