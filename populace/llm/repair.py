"""Token-ID output with Re-Pair grammar compression.

Texts are encoded, closed with an end id and written in ascending doc_id order.
Each block of about ``block_tokens`` ids is compressed by itself: frequent id
pairs inside documents are replaced by nonterminals, round after round, until no
pair pays for a rule. A block stores the rules, each nonterminal's expansion length,
the remaining symbols and the documents' symbol offsets, so a document or any span
of ids is decoded by following its own rules only; the table keeps each block's range
of doc_ids.

Blocks are rows of a Parquet table in the shared folder (any file system that
Spark writes to). Nulls: a null text is empty (its end id remains); rows with a
null doc_id come first; repeated rows are separate documents; an empty table
writes no block; extra columns are ignored. A text longer than a block is a block of
its own.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import save
from .tokens import encoder

MAGIC = b"RPG1"
BLOCK_TOKENS = 1 << 20


def _choose(place: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of places of pairs (i, i + 1) in order, with their ranks, those that don't overlap, better
    ranks first; in no order."""
    at, won_rank = [], []
    while place.size:
        # of neighbouring places the better one is taken, the left one of equals
        beside = place[1:] == place[:-1] + 1
        left = beside & (rank[1:] < rank[:-1])
        won = np.ones(place.size, bool)
        won[:-1] &= ~left
        won[1:] &= ~(beside & ~left)
        at.append(place[won])
        won_rank.append(rank[won])
        gone = won.copy()
        gone[1:] |= won[:-1] & beside
        gone[:-1] |= won[1:] & beside
        place, rank = place[~gone], rank[~gone]
    if not at:
        return np.empty(0, np.int64), np.empty(0, np.int16)
    return np.concatenate(at), np.concatenate(won_rank)


#: Bytes of a rule with its expansion length.
RULE_BYTES = 12


def compress(ids: np.ndarray, ends: np.ndarray, vocab: int, rounds: int | None = None, per_round: int = 4000, min_count: int = 8):
    """Re-Pair in rounds. ends: True at each document's last id; no pair spans it.

    A round counts all adjacent pairs, takes up to per_round of the most frequent
    ones and replaces them, the more frequent first where two overlap. A pair that
    is left with under min_count places by then waits, so every rule pays for its
    RULE_BYTES; rounds go on until no pair does (or for ``rounds``). From the second
    round on, the pairs that can be frequent are those that were, and those beside a
    new symbol; only they are counted. Returns symbols, ends of the symbols, rules (n, 2).
    """
    if per_round >= 1 << 15:
        raise ValueError("per_round must be under 32768")
    seq, last, rules, nxt = ids.astype(np.uint32), ends.copy(), [], vocab
    none, fresh, left = np.int16(per_round), None, np.empty((0, 2), np.uint32)
    while (rounds is None or rounds > 0) and seq.size > 1:
        rounds = None if rounds is None else rounds - 1
        # two symbols in 32 bits while they fit
        bits = 16 if nxt <= 65535 else 32
        kind, spread = (np.uint32, np.uint32(0x9E3779B1)) if bits == 16 else (np.uint64, np.uint64(0x9E3779B97F4A7C15))
        shift, never, down = kind(bits), kind(-1 % (1 << 2 * bits)), kind(2 * bits - 18)
        key = seq.astype(kind)
        key = (key[:-1] << shift) | key[1:]
        key[last[:-1]] = never
        slots = (key * spread) >> down
        value, count = _frequent(key if fresh is None else key[fresh], min_count)
        if len(left):  # pairs without a new symbol, counted anew
            old = np.sort((left[:, 0].astype(kind) << shift) | left[:, 1])
            some = np.zeros(1 << 18, bool)
            some[(old * spread) >> down] = True
            at = key[some[slots]]
            held = np.searchsorted(old, at)
            held[held == old.size] = 0
            n = np.bincount(held[old[held] == at], minlength=old.size)
            value, count = np.concatenate([value, old[n >= min_count]]), np.concatenate([count, n[n >= min_count]])
        value, count = value[value != never], count[value != never]
        if not value.size:
            break
        keys = value[np.lexsort((value, -count))]
        keys, wait = keys[:per_round], keys[per_round:]
        # a hashed table of ranks; of pairs that meet in a slot the most frequent one stays
        slot = (keys * spread) >> down
        table = np.full(1 << 18, none)
        table[slot[::-1]] = np.arange(keys.size - 1, -1, -1, dtype=np.int16)
        rank = table[slots]
        place = np.flatnonzero(rank < none)
        rank = rank[place]
        same = keys[rank] == key[place]
        at, rank = _choose(place[same], rank[same])
        met = np.bincount(rank, minlength=keys.size)
        used = np.flatnonzero(met >= min_count)
        unseen = table[slot] != np.arange(keys.size)
        split = lambda v: np.stack([(v >> shift).astype(np.uint32), (v & kind((1 << bits) - 1)).astype(np.uint32)], 1)
        if not used.size:
            # the pairs in hand overlap each other; those that had no turn get one
            left, fresh = split(np.concatenate([wait, keys[unseen]])), np.empty(0, np.int64)
            if not len(left):
                break
            continue
        pays = met[rank] >= min_count
        at, rank = at[pays], rank[pays]
        order = np.argsort(at)
        at, rank = at[order], rank[order]
        rules.append(split(keys[used]))
        as_new = np.zeros(keys.size, np.uint32)
        as_new[used] = nxt + np.arange(used.size, dtype=np.uint32)
        seq[at] = as_new[rank]
        last[at] = last[at + 1]
        keep = np.ones(seq.size, bool)
        keep[at + 1] = False
        seq, last = seq[keep], last[keep]
        here = at - np.arange(at.size)  # where the new symbols are now
        beside = np.zeros(seq.size + 1, bool)
        beside[here] = beside[here - 1] = True
        fresh = np.flatnonzero(beside[: seq.size - 1])
        left = split(np.concatenate([wait, np.delete(keys, used)]))
        nxt += used.size
    return seq, last, np.concatenate(rules) if rules else np.empty((0, 2), np.uint32)


def _frequent(key: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(key, count) of the keys that occur ``least`` times or more."""
    ordered = np.sort(key)
    start = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if key.size else np.empty(0, np.int64)
    count = np.diff(np.append(start, ordered.size))
    often = count >= least
    return ordered[start[often]], count[often]


def expansion_lengths(rules: np.ndarray, vocab: int) -> np.ndarray:
    out = np.ones(vocab + len(rules), np.int64)
    for i, (a, b) in enumerate(rules.tolist()):
        out[vocab + i] = out[a] + out[b]
    return out


def pack_block(doc_ids: list, docs: list[np.ndarray], vocab: int, **how) -> bytes:
    """The block's bytes: header, doc ids, null marks, symbol offsets, rules, lengths, symbols."""
    sizes = np.array([d.size for d in docs], np.int64)
    ids = np.concatenate(docs) if docs else np.empty(0, np.uint32)
    ends = np.zeros(ids.size, bool)
    ends[np.cumsum(sizes) - 1] = True
    seq, last, rules = compress(ids, ends, vocab, **how)
    offsets = np.concatenate([[0], np.flatnonzero(last) + 1]).astype("<u4")
    wide = vocab + len(rules) > 65536
    lengths = expansion_lengths(rules, vocab)[vocab:].astype("<u4")
    head = struct.pack("<4sIIIIB", MAGIC, vocab, len(docs), len(rules), seq.size, wide)
    names = np.array([0 if x is None else x for x in doc_ids], "<i8")
    nulls = np.array([x is None for x in doc_ids], np.uint8)
    return b"".join([head, names.tobytes(), nulls.tobytes(), offsets.tobytes(), rules.astype("<u4").tobytes(), lengths.tobytes(), seq.astype("<u4" if wide else "<u2").tobytes()])


class Block:
    """Random access to a block's documents and id spans."""

    def __init__(self, data: bytes):
        magic, self.vocab, n, r, s, wide = struct.unpack_from("<4sIIIIB", data)
        if magic != MAGIC:
            raise ValueError("not a grammar block")
        at = struct.calcsize("<4sIIIIB")

        def take(kind, k):
            nonlocal at
            out = np.frombuffer(data, kind, k, at)
            at += out.nbytes
            return out

        ids, nulls = take("<i8", n), take(np.uint8, n)
        self.doc_ids = [None if z else int(x) for x, z in zip(ids, nulls)]
        self.offsets = take("<u4", n + 1).astype(np.int64)
        self.rules = take("<u4", 2 * r).reshape(r, 2)
        self.lengths = np.concatenate([np.ones(self.vocab, np.int64), take("<u4", r).astype(np.int64)])
        self.symbols = take("<u4" if wide else "<u2", s).astype(np.int64)
        self._starts = self.pool = self.where = None

    def prepare(self) -> Block:
        """Expand every rule once, for reading the whole block."""
        self.pool, self.where = np.arange(self.vocab, dtype=np.uint32), np.arange(self.vocab, dtype=np.int64)
        r, done, newest = len(self.rules), 0, self.rules.max(axis=1, initial=0).astype(np.int64)
        while done < r:  # rules whose parts are known: a round's at once
            later = np.flatnonzero(newest[done:] >= self.vocab + done)
            upto = done + int(later[0]) if later.size else r
            ids = self.expand(self.rules[done:upto].ravel().astype(np.int64))
            n = self.lengths[self.vocab + done : self.vocab + upto]
            self.where = np.concatenate([self.where, self.pool.size + np.cumsum(n) - n])
            self.pool = np.concatenate([self.pool, ids])
            done = upto
        return self

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        """The ids of some symbols; only their own rules are followed, unless all are known."""
        if self.pool is None:
            while (rule := symbols >= self.vocab).any():
                n = 1 + rule
                at, out = np.cumsum(n) - n, np.repeat(symbols, n)
                pair = self.rules[symbols[rule] - self.vocab]
                out[at[rule]], out[at[rule] + 1] = pair[:, 0], pair[:, 1]
                symbols = out
            return symbols.astype(np.uint32)
        n = self.lengths[symbols]
        begin = np.cumsum(n) - n
        return self.pool[np.repeat(self.where[symbols] - begin, n) + np.arange(int(n.sum()))]

    def document(self, k: int) -> np.ndarray:
        return self.expand(self.symbols[self.offsets[k] : self.offsets[k + 1]])

    def span(self, start: int, stop: int) -> np.ndarray:
        """ids start..stop of the block: only the symbols that cover them are expanded."""
        if self._starts is None:
            self._starts = np.concatenate([[0], np.cumsum(self.lengths[self.symbols])])
        start, stop = max(0, start), min(stop, int(self._starts[-1]))
        if start >= stop:
            return np.empty(0, np.uint32)
        a = int(np.searchsorted(self._starts, start, "right")) - 1
        b = int(np.searchsorted(self._starts, stop, "left"))
        return self.expand(self.symbols[a:b])[start - self._starts[a] : stop - self._starts[a]]


BLOCKS = "part int, block int, part_start long, n_docs long, n_tokens long, first_id long, last_id long, payload binary"


def write_blocks(docs: DataFrame, vocab_path: str, end_id: int = 1, block_tokens: int = BLOCK_TOKENS, id_col: str = "doc_id", text: str = "text", partitions: int | None = None) -> DataFrame:
    """Encode ``docs`` into grammar blocks, one row each, in the shared folder.

    The table is dealt by ranges of doc_id; ``part`` numbers the ranges and
    ``part_start`` counts the ids of a range before the block. ``first_id`` and ``last_id``
    are the index by doc_id: a lookup reads the payloads of the blocks around an id only.
    """
    spark = docs.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, part = encoder(vocab_path, "word"), TaskContext.get().partitionId()
        vocab = enc.t.get_vocab_size(with_added_tokens=True)
        names, held, size, done, block = [], [], 0, 0, 0

        def flush():
            nonlocal names, held, size, done, block
            known = [n for n in names if n is not None]
            row = [[part], [block], [done], [len(names)], [size], [min(known, default=None)], [max(known, default=None)], [pack_block(names, held, vocab)]]
            done, block, names, held, size = done + size, block + 1, [], [], 0
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, (pa.int32(), pa.int32(), *[pa.int64()] * 5, pa.binary()))], [f.split()[0] for f in BLOCKS.split(", ")])

        for b in batches:
            for doc_id, ids in zip(b.column(0).to_pylist(), enc.encode_many(b.column(1))):
                ids = np.append(ids, np.uint32(end_id))
                names.append(doc_id)
                held.append(ids)
                size += ids.size
                if size >= block_tokens:
                    yield flush()
        if names:
            yield flush()

    dealt = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text")).repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    return save(dealt.mapInArrow(run, BLOCKS), "grammar")


def read_documents(blocks: DataFrame) -> DataFrame:
    """Decode blocks: doc_id, start, n_tokens and ids_crc32 of each document."""
    base = blocks.groupBy("part").agg(F.sum("n_tokens").alias("n"))

    # a row for each range partition of the writer, so a few thousand at most
    base = base.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    rows = blocks.join(F.broadcast(base), "part").select((F.col("base") + F.col("part_start")).alias("start"), "payload")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start, data in zip(b.column(0).to_pylist(), b.column(1)):
                block = Block(data.as_py()).prepare()
                bounds = np.concatenate([[0], np.cumsum(block.lengths[block.symbols])])[block.offsets]
                ids = np.ascontiguousarray(block.expand(block.symbols), "<u4")
                crc = [zlib.crc32(ids[a:z]) for a, z in zip(bounds[:-1], bounds[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(block.doc_ids, pa.int64()), pa.array(bounds[:-1] + start, pa.int64()), pa.array(np.diff(bounds), pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("doc_id", "start", "n_tokens", "ids_crc32")])
    return rows.mapInArrow(run, schema)


def find_documents(blocks: DataFrame, doc_ids: list[int]) -> DataFrame:
    """doc_id and ids of some documents: the scan is pruned to blocks whose range of doc_ids
    holds one, and in a block only the documents asked for are expanded."""
    wanted = sorted(set(doc_ids))
    hit = F.lit(False)
    for i in wanted:
        hit = hit | ((F.col("first_id") <= i) & (F.col("last_id") >= i))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column(0):
                block, asked = Block(data.as_py()), set(wanted)
                found = [(d, block.document(k).tolist()) for k, d in enumerate(block.doc_ids) if d in asked]
                yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in found], pa.int64()), pa.array([v for _, v in found], pa.list_(pa.int64()))], ["doc_id", "ids"])

    return blocks.where(hit).select("payload").mapInArrow(run, "doc_id long, ids array<long>")
