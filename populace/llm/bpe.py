"""Byte-level BPE with a hierarchical-bitmap rank queue.

Each pre-token is a linked list of byte spans. A bucket for each merge rank holds
the places where a pair of that rank starts; a two-level bitmap of non-empty
buckets gives the lowest rank by find-first-set; places whose pair has changed
are skipped. A pre-token of n bytes takes O(n log n) steps however long it is.

Nulls: a null text is empty; a null doc_id stays. Texts are encoded whole; repeated rows each.
An empty table gives no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from heapq import heappop, heappush
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, tidy

#: Pre-tokens in each generation of a worker's cache, and their largest size in characters.
CACHE, CACHED_CHARS = 400_000, 48


def merge(piece: bytes, ranks: dict[bytes, int], width: int = 8) -> list[int]:
    """Token ids of one pre-token. width: bits of a rank that the lower bitmap level indexes."""
    if (whole := ranks.get(piece)) is not None:
        return [whole]
    n, get = len(piece), ranks.get
    after, before, rank_at = list(range(1, n + 1)), list(range(-1, n - 1)), [-1] * n
    buckets: dict[int, list[int]] = {}
    low: dict[int, int] = {}
    top, mask = 0, (1 << width) - 1
    for i in range(n - 1):
        r = get(piece[i : i + 2])
        if r is not None:
            rank_at[i] = r
            if b := buckets.get(r):
                b.append(i)
            else:
                buckets[r] = [i]
                low[r >> width] = low.get(r >> width, 0) | 1 << (r & mask)
                top |= 1 << (r >> width)
    while top:
        hi = (top & -top).bit_length() - 1
        word = low[hi]
        bit = word & -word
        r = hi << width | bit.bit_length() - 1
        b = buckets[r]
        i = heappop(b)
        if not b:
            low[hi] = word = word ^ bit
            if not word:
                top ^= 1 << hi
        if rank_at[i] != r:
            continue
        j = after[i]
        k = after[i] = after[j]
        rank_at[j] = -1
        if k < n:
            before[k] = i
            r = get(piece[i : after[k]], -1)
            rank_at[i] = r
            if r >= 0:
                if b := buckets.get(r):
                    heappush(b, i)
                else:
                    buckets[r] = [i]
                    low[r >> width] = low.get(r >> width, 0) | 1 << (r & mask)
                    top |= 1 << (r >> width)
        else:
            rank_at[i] = -1
        h = before[i]
        if h >= 0:
            r = get(piece[h:k], -1)
            rank_at[h] = r
            if r >= 0:
                if b := buckets.get(r):
                    heappush(b, h)
                else:
                    buckets[r] = [h]
                    low[r >> width] = low.get(r >> width, 0) | 1 << (r & mask)
                    top |= 1 << (r >> width)
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : after[i]]])
        i = after[i]
    return out


class BytePairEncoder:
    def __init__(self, path: str, pattern: str, cache: int = CACHE):
        import regex

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bytes_of = {v: k for k, v in self.ranks.items()}
        self.find = regex.compile(pattern).findall
        self.limit, self.new, self.old = cache, {}, {}

    def encode(self, text: str | None) -> list[int]:
        pieces = self.find(text or "")
        new, long = self.new, {}
        for p in set(pieces):
            if p not in new:
                ids = self.old.get(p) or tuple(merge(p.encode(), self.ranks))
                (new if len(p) <= CACHED_CHARS else long)[p] = ids
        get = (lambda p: new.get(p) or long[p]) if long else new.__getitem__
        ids = list(chain.from_iterable(map(get, pieces)))
        if len(new) > self.limit:
            self.old, self.new = new, {}
        return ids

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


_made: dict = {}


def encoder(path: str, pattern: str) -> BytePairEncoder:
    if (path, pattern) not in _made:
        _made[path, pattern] = BytePairEncoder(path, pattern)
    return _made[path, pattern]


def encode_documents(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 (of the decoded ids); the ids too if asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, pattern)
        digits = list(map(str, range(max(enc.bytes_of, default=0) + 1)))
        for b in batches:
            n, ids_sha, text_sha, kept = [], [], [], []
            for t in b.column(1):
                ids = enc.encode(t.as_py())
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(" ".join(map(digits.__getitem__, ids)).encode()).hexdigest())
                text_sha.append(hashlib.sha256(enc.decode(ids)).hexdigest())
                if with_ids:
                    kept.append(ids)
            cols, names = [b.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                cols, names = [*cols, pa.array(kept, pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(cols, names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    bounded_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text).mapInArrow(tidy(run), schema)
