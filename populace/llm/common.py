"""Shared pieces: table access, the shared scratch folder, linked components."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of a batch that goes to Python, where the session leaves Spark's default.
BATCH_BYTES = 8 << 20
_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded_batches(spark: SparkSession) -> None:
    """Texts can be long: a batch for Python holds BATCH_BYTES at most."""
    if spark.conf.get(_BYTES).rstrip("bB") == str(64 << 20):
        spark.conf.set(_BYTES, str(BATCH_BYTES))


def trim() -> None:
    """Give free memory of a Python worker back: workers outlive their tasks, and the
    next stage shares the executor with them."""
    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def tidy(run, after=lambda: None):
    """``run`` (batches -> batches), trimming when a partition is done."""

    def tidied(batches):
        try:
            yield from run(batches)
        finally:
            after()
            trim()

    return tidied


def scratch(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Only a session on one machine that names none (tests) gets a local folder.
    """
    bounded_batches(spark)
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="populace-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


_saved: list[list] = []


@contextlib.contextmanager
def collecting() -> Iterator[list]:
    """The tables that :func:`save` makes inside, so that the caller can discard them."""
    _saved.append([])
    try:
        yield _saved[-1]
    finally:
        _saved.pop()


#: Whether a query's shuffle files go when it ends; else they wait for the driver's garbage collection.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def save(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut, a lost executor
    costs only the tasks it ran, and the shuffles that led to the table are deleted."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._populace_path = path
    if _saved:
        _saved[-1].append(out)
    return out


def discard(*frames: DataFrame) -> None:
    """Delete tables made by :func:`save` that no later plan reads."""
    for df in frames:
        path = getattr(df, "_populace_path", None)
        if path:
            jvm = df.sparkSession._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


#: Bits of a filter of ids, which is sent to all tasks (some 10 MB where it is full).
FILTER_BITS = 1 << 24


def perhaps(rows: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """``rows`` with a column ``listed``: true where ``key`` is one of the ``ids`` (one long
    column), and where it shares a bit of the filter with one; else false.

    Wide rows that a join would drop, or leave as they are, needn't be shuffled to meet a list
    that is too long to be sent: the filter is of a fixed size, and an exact join of the rows
    that are listed follows. The more ids, the more rows are listed for nothing: 2% for
    300,000 ids, a sixth for 3 million."""
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(FILTER_BITS))
    bit = lambda p: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(p, F.lit(64)).cast("int"))
    word = lambda p: F.shiftright(p, 6)
    held = place(F.col(ids.columns[0]))
    words = ids.groupBy(word(held).alias("_word")).agg(F.bit_or(bit(held)).alias("_bits"))
    at = rows.select("*", place(F.col(key)).alias("_at"))
    met = at.join(F.broadcast(words), word(F.col("_at")) == F.col("_word"), "left")
    return met.select(*rows.columns, F.coalesce(F.col("_bits").bitwiseAND(bit(F.col("_at"))) != 0, F.lit(False)).alias("listed"))


#: Texts that share a 64-bit hash with another one: a handful at any size (about n^2 / 2^65).
COLLIDED_MAX = 100_000


def named_texts(docs: DataFrame, hash_of: Callable[[Column], Column] = F.xxhash64) -> tuple[DataFrame, DataFrame]:
    """Gives equal texts one long ``uid`` and different texts different ones.

    docs: (doc_id, text, ...). Returns docs with uid, and a saved table (uid, low, n): the
    smallest doc_id and the rows of each text. A uid is a text's 64-bit hash; texts are told
    apart by their MD5 (128 bits), and the few whose hash another text has are renamed.
    A null text is an empty one.
    """
    words = F.coalesce(F.col("text"), F.lit(""))
    key = F.unhex(F.md5(words))
    named = docs.withColumn("uid", hash_of(words))
    texts = save(named.groupBy("uid", key.alias("key")).agg(F.min(F.struct("doc_id")).alias("low"), F.count("*").alias("n")).select("uid", "key", "low.doc_id", "n").withColumnRenamed("doc_id", "low"), "texts")
    twice = texts.groupBy("uid").agg(F.count("*").alias("m"), F.min("key").alias("keeps")).where("m > 1")
    if not twice.isEmpty():
        other = F.xxhash64("key", "uid")
        other = save(texts.join(twice, "uid").where("key <> keeps").select("uid", "key", other.alias("other")), "texts-renamed")
        many = other.count()
        again = texts.select("uid").union(other.select("other")).groupBy("uid").count().where("count > 1")
        if many > COLLIDED_MAX or again.join(other, again["uid"] == other["other"], "left_semi").count():
            raise RuntimeError("two texts can't be told apart")
        named = named.join(F.broadcast(other), (named["uid"] == other["uid"]) & (key == other["key"]), "left").select(*(named[c] for c in docs.columns), F.coalesce("other", named["uid"]).alias("uid"))
        texts = texts.join(F.broadcast(other), ["uid", "key"], "left").select(F.coalesce("other", "uid").alias("uid"), "low", "n")
    path = texts if hasattr(texts, "_populace_path") else None
    out = texts.select("uid", "low", "n")
    if path is not None:
        out._populace_path = path._populace_path
    return named, out


def _shape(df: DataFrame) -> tuple:
    r = df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(r)


#: Edges from which a hot node would make one task long.
SPLIT_EDGES = 2_000_000


#: Edges that one task joins by itself (a few MB).
FEW_EDGES = 200_000


def _union(batches):
    """(node, root) of all edges of a task."""
    import numpy as np
    import pyarrow as pa

    cols = [[c.to_numpy() for c in b.columns] for b in batches]
    a, b = (np.concatenate([np.empty(0, np.int64), *(c[i] for c in cols)]) for i in (0, 1))
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    up = list(range(nodes.size))
    for x, y in zip(at[: a.size].tolist(), at[a.size :].tolist()):
        while up[x] != x:
            up[x] = x = up[up[x]]
        while up[y] != y:
            up[y] = y = up[up[y]]
        up[max(x, y)] = min(x, y)
    for i in range(nodes.size):  # parents come before their children
        up[i] = up[up[i]]
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(nodes[up], pa.int64())], ["node", "root"])


def components(edges: DataFrame, max_rounds: int = 60, few: int = FEW_EDGES) -> DataFrame:
    """Smallest node reachable: ``edges(a long, b long)`` -> ``(node, root)``.

    Up to ``few`` edges are joined in one task, which bounds its memory; beyond it:
    Alternating large-star and small-star steps. The minimum of a node's
    neighbours is a map-side combined aggregate, so a hub costs one partial row
    for each task. It is joined back on the node; from SPLIT_EDGES edges on it is
    written first, so that the join reads two plain shuffles, of which adaptive
    execution splits a hot node. Every round is written to the shared folder.
    Nodes without an edge are absent from the result.
    """
    cur = save(
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct(),
        "cc",
    )
    before = _shape(cur)
    if 0 < before[0] <= few:
        out = save(cur.coalesce(1).mapInArrow(tidy(_union), "node long, root long"), "cc-few")
        discard(cur)
        return out
    for _ in range(max_rounds):
        if not before[0]:
            break
        hold = (lambda df: save(df, "cc-low")) if before[0] >= SPLIT_EDGES else (lambda df: df)
        both = cur.union(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        low = hold(low)
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = save(large.distinct(), "cc")
        lower = hold(large.groupBy("a").agg(F.min("b").alias("m")))
        small = (
            large.join(lower, "a")
            .select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
            .select("e.a", "e.b")
            .where("a <> b")
            .distinct()
        )
        nxt = save(small, "cc")
        discard(cur, large, low, lower)
        cur, after = nxt, _shape(nxt)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components: no fixed point in {max_rounds} rounds")
    roots = cur.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    out = cur.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
    out._populace_path = cur._populace_path
    return out
