"""Vector best-fit packing of tokenized documents into sequences.

A document's ids and its end id form pieces of at most ``capacity`` tokens; where
a document is longer, its first piece takes the remainder. A piece demands tokens, one
document and attention: a kernel that attends inside documents computes whole tiles, so
a piece costs the square of its tiles. A sequence offers capacities for all three.
Pieces are placed longest first; of the open sequences that hold a piece under every
constraint, the one with the least weighted residual norm (or the largest weighted dot
product of demand and residual) takes it.

Pieces are dealt by hash to shards of about ``shard_pieces`` and each shard is
packed by itself, so a run holds at most one lightly filled sequence a shard.
Nulls: a null text is empty (its end id remains); a null doc_id is an id as any other.
Repeated rows are packed each, equal ones in any order. An empty table gives an empty
result; extra columns are ignored; a long text becomes many pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, save, tidy
from .tokens import PieceEncoder, encoder

SHARD_PIECES = 16384
#: Tokens of an attention tile; documents of a sequence, and tiles beyond those of one full piece.
TILE, MAX_DOCS, SPARE_TILES = 64, 12, 2
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of each piece of n tokens, the remainder first."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))] if n else []


def pieces(docs: DataFrame, vocab_path: str, end_id: int = 2, capacity: int = 1024, id_col: str = "doc_id", text: str = "text", cache: int | None = None) -> DataFrame:
    """Rows of PIECES. cache: words whose ids a task remembers; by default a worker
    remembers CACHE words from task to task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = PieceEncoder(vocab_path, "byte", cache) if cache else encoder(vocab_path, "byte")
        for b in batches:
            out: list[list] = [[] for _ in range(5)]
            for doc_id, ids in zip(b.column(0).to_pylist(), enc.encode_many(b.column(1))):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4", copy=False)
                for k, (s, n) in enumerate(cut(ids.size, capacity)):
                    for col, v in zip(out, (doc_id, k, s, n, zlib.crc32(ids[s : s + n]))):
                        col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    bounded_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long"), text).mapInArrow(tidy(run) if cache else run, PIECES)


def best_fit(lengths: np.ndarray, capacity: int, max_docs: int, max_attention: float, weights=(1.0, 0.02, 0.02), rule: str = "norm", tile: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of each piece; sequences are numbered from 0. Attention is
    counted in squares of tiles of so many tokens."""
    n = lengths.size
    cost = np.ceil(lengths / tile) ** 2
    where, offset = np.zeros(n, np.int64), np.zeros(n, np.int64)
    if not n:
        return where, offset
    if lengths.max() > capacity or cost.max() > max_attention or max_docs < 1:
        raise ValueError("a piece exceeds a capacity by itself")
    wt, wd, wa = (w / c for w, c in zip(weights, (capacity, max_docs, max_attention)))
    order = np.argsort(-lengths, kind="stable")
    least = int(lengths.min())
    opened = 0
    rt, rd, ra = np.empty(n), np.empty(n), np.empty(n)
    name = np.empty(n, np.int64)
    live = 0
    for i in order:
        x, c = float(lengths[i]), float(cost[i])
        t, d, a = rt[:live], rd[:live], ra[:live]
        ok = (t >= x) & (d >= 1) & (a >= c)
        if ok.any():
            at = np.flatnonzero(ok)
            if rule == "dot":
                k = at[np.argmax(wt * wt * x * t[at] + wd * wd * d[at] + wa * wa * c * a[at])]
            else:
                k = at[np.argmin(((t[at] - x) * wt) ** 2 + ((d[at] - 1) * wd) ** 2 + ((a[at] - c) * wa) ** 2)]
        else:
            k = live
            rt[k], rd[k], ra[k], name[k] = capacity, max_docs, max_attention, opened
            opened, live = opened + 1, live + 1
        where[i], offset[i] = name[k], capacity - rt[k]
        rt[k] -= x
        rd[k] -= 1
        ra[k] -= c
        if rt[k] < least or rd[k] < 1:  # full: the last open one takes its place
            live -= 1
            rt[k], rd[k], ra[k], name[k] = rt[live], rd[live], ra[live], name[live]
    return where, offset


def pack(parts: DataFrame, capacity: int = 1024, max_docs: int = MAX_DOCS, max_attention: float | None = None, tile: int = TILE, shard_pieces: int = SHARD_PIECES, **how) -> DataFrame:
    """``parts`` (as of :func:`pieces`) with sequence_id and offset. max_attention: in squared
    tiles, by default those of one full piece and SPARE_TILES more."""
    if max_attention is None:
        max_attention = float(-(-capacity // tile)) ** 2 + SPARE_TILES
    parts = save(parts, "pieces")
    shards = max(1, round(parts.count() / shard_pieces))

    def run(shard: pa.Table) -> pa.Table:
        number = shard.column("shard")[0].as_py()
        t = shard.drop_columns("shard").sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
        where, offset = best_fit(t.column("length").to_numpy(), capacity, max_docs, max_attention, tile=tile, **how)
        return t.append_column("sequence_id", pa.array(where + (number << 32))).append_column("offset", pa.array(offset))

    dealt = parts.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(shards)))
    return dealt.groupBy("shard").applyInArrow(run, PIECES + ", sequence_id long, offset long")
