"""Near-duplicate vectors through a pivot-permutation index.

Each vector is described by its ``prefix`` nearest pivots, nearest first. Pivots
are vectors of a sample (all vectors are indexed), each, without the sample's mean, less
than APART alike to those before it: a dense group holds few pivots, which all its members
have in common, and the other pivots of their prefixes tell them apart as little as the
links need. The more the vectors have in common, the longer their prefixes. Where few vectors
are that far apart, few pivots are left, lists grow, and at ``prefix`` pivots or fewer all
pairs are compared. A vector enters the inverted list of each pivot
of its prefix; in a list, pairs that share at least ``shared`` pivots are candidates,
and a candidate is a link if its cosine in double precision reaches ``limit``. A pair
is counted only in the list of its lowest shared pivot.

Pivots grow as twice the root of the distinct vectors, within PIVOT_BYTES, which bounds
the broadcast. A list is cut into blocks of ``block`` rows and each pair of blocks is one
group, so no task holds a whole list. A list of over SPLIT blocks is dealt by its rows' other
pivots instead (candidates share a second pivot): lists of two pivots hold some 14 rows
whatever the number of vectors, while single ones grow as its root; long ones, of dense
groups, are cut into blocks again. So a vector is copied SPLIT times a list at most, but for
dense groups. A group returns link counts and a spanning set of links for each vector,
never its pairs.

Equal vectors are folded into one first, with their number; they are told apart by 128 bits.
Vectors that are null, zero, of another length than most, or that hold null or
non-finite components link with nothing. A null id is the smallest. Repeated ids are
separate vectors whose counts are given for each row. Pivots equally near are ordered by
number. An empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .buckets import spanning
from .common import components, discard, save, tidy

PREFIX, SHARED, BLOCK, SPLIT = 8, 2, 2000, 7
#: Cosine that two pivots stay under, vectors drawn for each pivot wanted, and bytes of all pivots.
APART, DRAWN, PIVOT_BYTES = 0.5, 4, 64 << 20


def pivot_count(n: int, dim: int) -> int:
    """Pivots for n distinct vectors: 2 sqrt(n), 16 at least, PIVOT_BYTES in all."""
    return max(16, min(PIVOT_BYTES // (8 * max(dim, 1)), round(2 * math.sqrt(n))))


def unit(rows: list, dim: int) -> np.ndarray:
    x = np.array([r if r is not None else [0.0] * dim for r in rows], np.float64).reshape(len(rows), dim)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def apart(x: np.ndarray, most: int) -> np.ndarray:
    """Numbers of the first rows of x that are less than APART alike to each one taken before."""
    kept, at = np.empty((most, x.shape[1])), []
    for i, r in enumerate(x):
        if len(at) < most and not (kept[: len(at)] @ r >= APART).any():
            kept[len(at)] = r
            at.append(i)
    return np.array(at, np.int64)


def choose_pivots(x: np.ndarray, most: int, limit: float, prefix: int) -> tuple[np.ndarray, int]:
    """Pivots among unit vectors x, and the length of prefixes.

    Embeddings often share a direction. It says nothing of which pivots are near, so pivots are
    chosen apart in what is left without the mean; and of the cosine ``limit`` of a link it
    makes up a part, so links are less alike in the rest, and their prefixes are longer by as much."""
    if not len(x):
        return x, prefix
    mean = x.mean(axis=0)
    rest = x - mean
    norm = np.sqrt((rest * rest).sum(axis=1, keepdims=True))
    pivots = x[apart(np.divide(rest, norm, out=x.copy(), where=norm > 1e-9), most)]
    common = float(mean @ mean)
    alike = (limit - common) / (1 - common) if common < 1 else 0.0
    return pivots, min(len(pivots), round(prefix * limit / alike)) if alike > prefix * limit / len(pivots) else len(pivots)


def nearest_pivots(x: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """Numbers of the nearest pivots of each row, nearest first."""
    k, step, out = min(prefix, len(pivots)), max(1, (32 << 20) // (8 * len(pivots))), []
    for at in range(0, len(x), step):
        near = -(x[at : at + step] @ pivots.T)
        top = np.sort(np.argpartition(near, k - 1, axis=1)[:, :k], axis=1)
        out.append(np.take_along_axis(top, np.argsort(np.take_along_axis(near, top, 1), axis=1, kind="stable"), 1))
    return np.concatenate(out)


def match(pivot: int, second: int, x: np.ndarray, px: np.ndarray, y: np.ndarray, py: np.ndarray, limit: float, shared: int, same: bool) -> np.ndarray:
    """Links between the rows of x and y that this list is to count: the list of the pair's
    lowest shared pivot or, with ``second`` >= 0, of its two lowest."""
    used = np.intersect1d(px, py)
    lower = int(np.searchsorted(used, pivot))

    def sets(p):
        m = np.zeros((len(p), used.size + 1), np.float32)
        at = np.searchsorted(used, p)
        np.put_along_axis(m, np.where(np.append(used, -1)[at] == p, at, used.size), 1, 1)
        return m[:, :-1]

    a, b = sets(px), sets(py)
    cand = (a @ b.T >= shared) & (a[:, :lower] @ b[:, :lower].T == 0)
    if second >= 0:
        upto = int(np.searchsorted(used, second))
        cand &= a[:, :upto] @ b[:, :upto].T == 1
    if same:
        cand &= np.tri(len(x), k=-1, dtype=bool)
    at = np.flatnonzero(cand.any(axis=1))
    out = np.zeros(cand.shape, bool)
    if at.size:
        out[at] = cand[at] & (x[at] @ y.T >= limit)
    return out


def link(vectors: DataFrame, limit: float = 0.9, id_col: str = "vec_id", vector: str = "embedding", prefix: int = PREFIX, shared: int = SHARED, block: int = BLOCK, split: int = SPLIT) -> DataFrame:
    """id, n_links, component_id, kept for every row."""
    spark = vectors.sparkSession
    v = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    dims = v.where("v is not null").groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    dim = dims["d"] if dims else 0
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = F.coalesce((F.size("v") == dim) & finite & F.exists("v", lambda x: x != 0), F.lit(False))
    v = v.withColumn("good", good)
    h1, h2 = F.xxhash64("v"), F.xxhash64(F.lit(1), "v")
    reps = v.where("good").groupBy("v").agg(F.min(F.struct("vec_id")).alias("low"), F.count("*").alias("n"))
    reps = save(reps.select(F.monotonically_increasing_id().alias("cid"), h1.alias("h1"), h2.alias("h2"), "v", F.col("low.vec_id").alias("low"), "n"), "vectors")
    total = reps.count()
    wanted = pivot_count(total, dim)
    drawn = reps.orderBy("h1", "h2").limit(DRAWN * wanted).select("v").toArrow().column("v").combine_chunks()
    flat = drawn.flatten().to_numpy().reshape(-1, max(dim, 1))
    pivots, prefix = choose_pivots(flat / np.sqrt((flat * flat).sum(axis=1, keepdims=True)), wanted, limit, prefix)
    held, p = spark.sparkContext.broadcast(pivots), len(pivots)
    shared = shared if p > prefix else min(shared, p)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = unit(b.column(1).to_pylist(), dim)
                near = nearest_pivots(x, held.value, prefix).astype(np.int32)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(list(near)), pa.array([r.tobytes() for r in x], pa.binary())], ["cid", "n", "near", "x"])

    described = save(reps.select("cid", "v", "n").mapInArrow(tidy(describe), "cid long, n long, near array<int>, x binary"), "vectors-described")
    lists = described.select("*", F.explode("near").alias("pivot"))
    sizes = save(lists.groupBy("pivot").agg(F.count("*").alias("rows")), "lists")
    lists = lists.join(sizes, "pivot")
    long_list = (F.col("rows") > split * block) & F.lit(shared >= 2)
    short = lists.where(~long_list).withColumn("second", F.lit(-1))
    dealt = short
    if not sizes.where(long_list).isEmpty():
        pairs = lists.where(long_list).drop("rows").withColumn("second", F.explode(F.filter("near", lambda q: q > F.col("pivot"))))
        by_two = save(pairs.groupBy("pivot", "second").agg(F.count("*").alias("rows")), "lists-of-two")
        dealt = short.unionByName(pairs.join(by_two.where("rows > 1"), ["pivot", "second"]))
    dealt = dealt.withColumn("cuts", F.ceil(F.col("rows") / block).cast("int")).withColumn("own", F.pmod(F.xxhash64("cid", "pivot"), F.col("cuts")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
    dealt = dealt.select("pivot", "second", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "cid", "n", "near", "x")

    def compare(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pivot, second, i, j = (int(k) for k in key)
        x = np.frombuffer(b"".join(pdf["x"]), np.float64).reshape(len(pdf), dim)
        near = np.stack(pdf["near"].to_numpy())
        ids, n, own = pdf["cid"].to_numpy(), pdf["n"].to_numpy(), pdf["own"].to_numpy()
        s, t = np.flatnonzero(own == i), np.flatnonzero(own == j)
        links = match(pivot, second, x[s], near[s], x[t], near[t], limit, shared, i == j)
        count = np.zeros(len(pdf), np.int64)
        np.add.at(count, s, links @ n[t])
        np.add.at(count, t, n[s] @ links)
        a, r = spanning(links, ids[s], ids[t])
        lit = count > 0
        return pd.DataFrame({"cid": np.concatenate([ids[lit], a]), "n_links": np.concatenate([count[lit], np.zeros(a.size, np.int64)]), "root": np.concatenate([ids[lit], r])})

    found = save(dealt.groupBy("pivot", "second", "i", "j").applyInPandas(compare, "cid long, n_links long, root long"), "vectors-links")
    counts = found.groupBy("cid").agg(F.sum("n_links").alias("n_links"))
    roots = components(found.select(F.col("cid").alias("a"), F.col("root").alias("b")).where("a <> b"))
    named = reps.join(counts, "cid", "left").join(roots.withColumnRenamed("node", "cid"), "cid", "left")
    named = save(named.select("cid", "h1", "h2", "low", "n", F.coalesce("n_links", F.lit(0)).alias("m"), F.coalesce("root", "cid").alias("root")), "vectors-named")
    least = named.groupBy("root").agg(F.min(F.struct("low")).alias("least"))
    by_cid = named.join(least, "root").select("h1", "h2", (F.col("n") - 1 + F.col("m")).alias("n_links"), F.col("least.low").alias("component_id"), F.lit(True).alias("met"))
    keyed = v.select("vec_id", F.when(F.col("good"), h1).alias("h1"), F.when(F.col("good"), h2).alias("h2"))
    discard(described, found, roots, sizes)
    out = keyed.join(by_cid, ["h1", "h2"], "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.when(F.col("met"), F.col("component_id")).otherwise(F.col("vec_id")).alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
