"""Links inside index buckets without all pairs of a bucket as rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, discard, save, tidy

#: Ids before an id in its key that it is tried against; rows of a key from which it is
#: refined, and rows of a block; rows that a task looks at together.
LAGS, REFINE, BLOCK, CHUNK = 8, 512, 256, 500_000
INDEX = "k long, id long, x long, w long"


@dataclass
class Source:
    """An index (k, id, x, w) without repeats: key, id, what orders a key, weight.

    distance: x is a fingerprint, and only ids that differ in at most so many bits are
    candidates. refine: further keys of a row (k, x) of which two candidates of a key
    share one again; used where a key holds more than REFINE rows.
    """

    index: DataFrame
    distance: int | None = None
    refine: Callable[[Column, Column], Column] | None = None


@dataclass
class Verify:
    """How candidates are verified: ``pairs`` keeps the links of (a, b); ``fetch`` gives
    (id, load) of wanted ids, load being sorted 64-bit numbers; ``block`` tests two lists of
    loads, all against all, and returns a truth matrix."""

    pairs: Callable[[DataFrame], DataFrame]
    fetch: Callable[[DataFrame], DataFrame]
    block: Callable[[list, list], np.ndarray]
    #: saved tables of loads, discarded when the links are found
    kept: list[DataFrame] = field(default_factory=list)


def spanning(links: np.ndarray, ids_x: np.ndarray, ids_y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(id, smallest id reachable) by the links of a block pair; unlinked ids are left out."""
    ids, at = np.unique(np.concatenate([ids_x, ids_y]), return_inverse=True)
    i, j = np.nonzero(links)
    i, j = at[: ids_x.size][i], at[ids_x.size :][j]
    low = np.arange(ids.size)
    while i.size:
        new = low.copy()
        least = np.minimum(low[i], low[j])
        np.minimum.at(new, i, least)
        np.minimum.at(new, j, least)
        new = new[new]
        if (new == low).all():
            break
        low = new
    own = np.flatnonzero(low != np.arange(ids.size))
    return ids[own], ids[low[own]]


def _merge(low: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The first place of each place's component, once a and b are linked too."""
    while a.size:
        p, q = low[a], low[b]
        np.minimum.at(low, np.maximum(p, q), np.minimum(p, q))
        while (low[low] != low).any():
            low = low[low]
        apart = low[a] != low[b]
        a, b = a[apart], b[apart]
    return low


def _joined(run: np.ndarray, x: np.ndarray, distance: int, block: int) -> tuple[np.ndarray, np.ndarray]:
    """For rows of whole keys, ordered by ``run``: the first place of each one's component inside
    its key, and whether its key may hold links that aren't known.

    A row is tried against the ``block`` rows before it, which are all of a smaller key. In a
    larger one the rows outside the largest component are tried against the key, if they are
    no more than ``block``. Both are linear in the rows."""
    low, unknown = np.arange(run.size), np.zeros(run.size, bool)
    start = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))
    size = np.diff(np.append(start, run.size))
    for j in range(1, min(block, int(size.max()) - 1) + 1):
        i = np.flatnonzero((run[j:] == run[:-j]) & (low[j:] != low[:-j]))
        i = i[np.bitwise_count((x[i] ^ x[i + j]).view(np.uint64)) <= distance]
        low = _merge(low, i, i + j)
    for at, n in zip(start[size > block + 1].tolist(), size[size > block + 1].tolist()):
        own, v = low[at : at + n] - at, x[at : at + n]
        roots, counts = np.unique(own, return_counts=True)
        rest = np.flatnonzero(own != roots[counts.argmax()])
        if rest.size > block:
            unknown[at : at + n] = True
            continue
        for p in rest.tolist():
            i = np.flatnonzero((np.bitwise_count((v ^ v[p]).view(np.uint64)) <= distance) & (own != own[p]))
            own = _merge(own, i, np.full(i.size, p))
        low[at : at + n] = own + at
    return low, unknown


def _tries(k: np.ndarray, ids: np.ndarray, x: np.ndarray, w: np.ndarray, lags: int, edges: list[int], distance: int | None, block: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b) places of candidate pairs in rows ordered by (k, x, id), and the places held back.

    All pairs of a key of up to lags + 1 rows; in a larger one each row with the one before
    it and with the key's weightiest. Held: rows of larger keys and of ``edges``, keys of
    which other tasks may have rows. With ``block`` the distance alone makes a link: a larger
    key gives links that span its components instead, and is held if some may be missing."""
    start = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    size = np.diff(np.append(start, k.size))
    run = np.repeat(np.arange(start.size), size)
    large = (size > lags + 1)[run]
    left, right = [], []
    for j in range(1, min(lags, k.size - 1) + 1):
        same = run[j:] == run[:-j]
        if j > 1 or block:
            same &= ~large[j:]
        i = np.flatnonzero(same)
        left.append(i)
        right.append(i + j)
    i = np.flatnonzero(large)
    pivot = i[:0] if block else np.lexsort((ids, -w, run))[start][run][i]
    a, b = np.concatenate([*left, i[: pivot.size]]), np.concatenate([*right, pivot])
    ok = ids[a] != ids[b]
    if distance is not None:
        ok &= np.bitwise_count((x[a] ^ x[b]).view(np.uint64)) <= distance
    a, b = a[ok], b[ok]
    if block and i.size:
        low, large[i] = _joined(run[i], x[i], distance, block)
        new = low != np.arange(i.size)
        a, b = np.concatenate([a, i[new]]), np.concatenate([b, i[low[new]]])
    return a, b, np.flatnonzero(large | np.isin(k, edges))


def _sweep(source: Source, lags: int, chunk: int, block: int = 0) -> DataFrame:
    """(a, b, null, null, null) of candidate pairs, (null, null, k, id, x) of rows held back.

    Rows are dealt by ranges of (k, x, id), so that a large key is spread over tasks."""
    schema = pa.schema([(c, pa.int64()) for c in ("a", "b", "k", "id", "x")])
    distance = source.distance

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty(0, np.int64)] * 4
        edges: list[int] = []

        def tell(rows, keys):
            k, ids, x, w = rows
            if not k.size:
                return
            a, b, kept = _tries(k, ids, x, w, lags, keys, distance, block)
            low, high = np.minimum(ids[a], ids[b]), np.maximum(ids[a], ids[b])
            n, m = pa.nulls(low.size, pa.int64()), pa.nulls(kept.size, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(low), pa.array(high), n, n, n], schema=schema)
            yield pa.RecordBatch.from_arrays([m, m, pa.array(k[kept]), pa.array(ids[kept]), pa.array(x[kept])], schema=schema)

        for b in batches:
            if not b.num_rows:
                continue
            held = [np.concatenate([h, c.to_numpy()]) for h, c in zip(held, b.columns)]
            if not edges:
                edges = [int(held[0][0])]
            if held[0].size >= chunk:
                cut = int(np.searchsorted(held[0], held[0][-1]))
                if cut == 0:  # one key fills the chunk
                    edges.append(int(held[0][0]))
                    cut = held[0].size
                yield from tell([h[:cut] for h in held], edges)
                held = [h[cut:] for h in held]
        if held[0].size:
            yield from tell(held, [*edges, int(held[0][-1])])

    n = int(source.index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = source.index.select("k", "id", "x", "w").repartitionByRange(n, "k", "x", "id").sortWithinPartitions("k", "x", "id")
    return dealt.mapInArrow(tidy(run), "a long, b long, k long, id long, x long")


def _mixed(held: DataFrame, first: DataFrame) -> DataFrame:
    """(k, id, x, c, n) of the held rows whose key has several components."""
    named = held.join(first.withColumnRenamed("node", "id"), "id", "left").select("k", "id", "x", F.coalesce("root", "id").alias("c"))
    keys = named.groupBy("k").agg(F.count("*").alias("n"), F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("k", "n")
    return named.join(keys, "k").select("k", "id", "x", "c", "n")


def _across(mixed: DataFrame, distance: int | None, verify: Verify | None, block: int) -> DataFrame:
    """(a, b): a spanning set of the links between components that share a key.

    A key of n rows is cut into ceil(n / block) blocks, and each pair of blocks is one group."""
    rows = mixed.withColumn("cuts", F.ceil(F.col("n") / block).cast("int"))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("id", "k"), F.col("cuts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
    rows = rows.select("k", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "id", "x", "c")
    test = verify.block if verify else None
    if verify:
        loads = verify.fetch(mixed.select("id").distinct())
        rows = rows.join(loads, "id").select("k", "i", "j", "own", "id", "x", "c", "load")

    def compare(t: pa.Table) -> pa.Table:
        own, x, c = (t.column(n).to_numpy() for n in ("own", "x", "c"))
        i, j = t.column("i")[0].as_py(), t.column("j")[0].as_py()
        s, u = np.flatnonzero(own == i), np.flatnonzero(own == j)
        links = c[s][:, None] != c[u][None, :]
        if distance is not None:
            links &= np.bitwise_count((x[s][:, None] ^ x[u][None, :]).view(np.uint64)) <= distance
        if test is not None and links.any():
            p, q = np.flatnonzero(links.any(axis=1)), np.flatnonzero(links.any(axis=0))
            load = [np.frombuffer(v.as_py(), np.uint64) for v in t.column("load").combine_chunks()]
            links[np.ix_(p, q)] &= test([load[z] for z in s[p]], [load[z] for z in u[q]])
        a, b = spanning(links, c[s], c[u])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return rows.groupBy("k", "i", "j").applyInArrow(compare, "a long, b long")


def linked(sources: list[Source], verify: Verify | None = None, lags: int = LAGS, refine: int = REFINE, block: int = BLOCK, chunk: int = CHUNK, name: str = "bucket") -> DataFrame:
    """Components of all links between ids that share a key: (node, root).

    Without ``verify`` a source's distance alone makes a link, and the task that has all rows of
    a key settles it unless over ``block`` of them lie outside its largest component. Small keys are tried in full,
    larger ones by neighbours and their weightiest id (linear in the rows). Those links are
    contracted to components; only larger keys that still hold several components are compared
    in full, large ones after refining, in blocks that return spanning links: the rows made
    for a key are its rows times its blocks, never its pairs.
    """
    check = (lambda pairs: verify.pairs(save(pairs.distinct(), f"{name}-pairs"))) if verify else (lambda pairs: save(pairs.distinct(), f"{name}-pairs"))
    within = [0 if verify or s.distance is None else block for s in sources]
    met = [save(_sweep(s, lags, chunk, n), f"{name}-met") for s, n in zip(sources, within)]
    pairs = met[0].where("a is not null").select("a", "b")
    for m in met[1:]:
        pairs = pairs.union(m.where("a is not null").select("a", "b"))
    links = check(pairs)
    first = components(links)
    across, trash = [], [*met]
    for s, m, own in zip(sources, met, within):
        mixed = save(_mixed(m.where("k is not null").select("k", "id", "x"), first), f"{name}-mixed")
        trash.append(mixed)
        if s.refine is not None and not mixed.where(F.col("n") > refine).isEmpty():
            finer = mixed.where(F.col("n") > refine).select(F.explode(s.refine(F.col("k"), F.col("x"))).alias("k"), "id", "x", F.lit(0).cast("long").alias("w")).distinct()
            again = save(_sweep(Source(finer, s.distance), lags, chunk, own), f"{name}-finer")
            more = check(again.where("a is not null").select("a", "b"))
            # a finer link joins the components of its ends
            ends = more.join(first.select(F.col("node").alias("a"), F.col("root").alias("ca")), "a", "left").join(first.select(F.col("node").alias("b"), F.col("root").alias("cb")), "b", "left")
            across.append(ends.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")))
            left = save(_mixed(again.where("k is not null").select("k", "id", "x"), first), f"{name}-finer-mixed")
            trash += [again, more, left]
            mixed = mixed.where(F.col("n") <= refine).union(left)
        if not mixed.isEmpty():
            across.append(_across(mixed, s.distance, verify, block))
    if not across:
        discard(*trash, links, *(verify.kept if verify else []))
        return first
    both = across[0]
    for e in across[1:]:
        both = both.union(e)
    both = save(both.distinct(), f"{name}-across")
    second = components(both)
    out = first.join(second.select(F.col("node").alias("root"), F.col("root").alias("upper")), "root", "left").select("node", F.coalesce("upper", "root").alias("root"))
    lone = second.join(first.select("node"), "node", "left_anti").select("node", "root")
    out = save(out.union(lone), f"{name}-roots")
    discard(*trash, links, both, first, second, *(verify.kept if verify else []))
    return out
