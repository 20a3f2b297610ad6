"""Exact substring dedup: difference-cover suffix arrays over content-dealt shards.

A ``length``-byte string (window) that also starts earlier, in a smaller doc_id
or before it in the same document, is a repeat; every byte of a repeat goes.

1. Whole copies of a text (told apart by 128 bits) are folded; a later copy of
   ``length`` bytes or more goes whole.
2. Every window has an anchor: the leftmost 32-byte gram of least hash in it.
   Equal windows have equal anchors at equal places, so a window whose anchor
   occurs once is no repeat. This drops no repeat.
3. The windows of an anchor's occurrence form one context (their union). Equal
   contexts (by 128 bits) are folded to the first; a later one goes whole.
4. Contexts that remain are dealt to shards by anchor, so that all equal windows
   are in one shard. Of each context a shard keeps the windows that can have an equal one:
   those with the anchor in the same quarter share at least 83 bytes (of 100), whose hash
   another context's quarter must have too. It sorts what is left by a difference cover modulo 3:
   triples at sampled places are sorted and named, names are sorted by recursion,
   the other suffixes follow from the sampled ranks, and both are merged.
   Neighbours in suffix order whose common prefix reaches ``length`` hold the
   same window; all but the first start go.
   An anchor with more than ``hot`` distinct contexts would fill a shard; its
   windows are aggregated one by one by their bytes' 128-bit hash instead.

Nulls: a null text is empty; a null doc_id sorts first. Rows that repeat doc_id
and text are one document; among equal doc_ids a hash of the text orders.
An empty table gives an empty result; extra columns are ignored. A long text is cut
into contexts like any other, so no shard holds more of it than its repeats' surroundings.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, named_texts, perhaps, save, tidy

GRAM = 32
SHARD_BYTES = 1 << 19
HOT = 20_000
#: Bytes of the shards that one task sorts.
TASK_BYTES = 8 << 20
#: Bytes that are hashed at once; a longer text is cut into pieces, its windows dealt among them.
PIECE = 1 << 18


def _named(*keys: np.ndarray) -> tuple[np.ndarray, int]:
    """Dense ranks from 1 of rows ordered by keys (each under 2**32), and their number."""
    key = keys[0].astype(np.uint64)
    for k in keys[1:]:
        wide = (key << np.uint64(32)) | k.astype(np.uint64)
        order = np.argsort(wide)
        step = np.empty(wide.size, np.uint32)
        ordered = wide[order]
        step[order] = np.concatenate([[1], 1 + np.cumsum(ordered[1:] != ordered[:-1], dtype=np.uint32)]) if wide.size else []
        key = step.astype(np.uint64)
    return key.astype(np.uint32), int(key.max()) if key.size else 0


def _sorted_places(key: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys under 2**bits in order, and their places (equal keys by place)."""
    low = int(key.size).bit_length()
    if bits + low > 64:
        order = np.argsort(key, kind="stable")
        return key[order], order
    both = np.sort((key << np.uint64(low)) | np.arange(key.size, dtype=np.uint64))
    return both >> np.uint64(low), (both & np.uint64((1 << low) - 1)).astype(np.int64)


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Suffix array of positive integers by the difference cover {1, 2} modulo 3."""
    n = s.size
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), np.int64)
    t = np.concatenate([s, np.zeros(3, s.dtype)]).astype(np.uint64)
    extra = n % 3 == 1  # an empty suffix keeps the two halves apart
    sample = np.concatenate([np.arange(1, n + extra, 3), np.arange(2, n, 3)])
    bits, rank_bits = int(t.max()).bit_length(), int(sample.size).bit_length()
    bit, rank_bit = np.uint64(bits), np.uint64(rank_bits)
    if 3 * bits <= 64:
        ordered, order = _sorted_places((((t[sample] << bit) | t[sample + 1]) << bit) | t[sample + 2], 3 * bits)
        names = np.empty(sample.size, np.uint32)
        names[order] = np.concatenate([[1], 1 + np.cumsum(ordered[1:] != ordered[:-1], dtype=np.uint32)])
        top = int(names[order[-1]])
    else:
        names, top = _named(t[sample], t[sample + 1], t[sample + 2])
    if top == sample.size:
        ordered = np.empty(sample.size, np.int64)
        ordered[names - 1] = np.arange(sample.size)
    else:
        ordered = suffix_array(names)
    sampled = sample[ordered]
    rank = np.zeros(n + 3, np.uint64)
    rank[sampled] = np.arange(1, sampled.size + 1, dtype=np.uint64)
    sampled = sampled[sampled < n]
    rest = np.arange(0, n, 3)
    rest_key, by = _sorted_places((t[rest] << rank_bit) | rank[rest + 1], bits + rank_bits)
    rest = rest[by]
    # how many of the rest come before each sampled suffix
    before = np.empty(sampled.size, np.int64)
    is_one = sampled % 3 == 1
    p = sampled[is_one]
    before[is_one] = np.searchsorted(rest_key, (t[p] << rank_bit) | rank[p + 1])
    q = sampled[~is_one]
    if 2 * bits + rank_bits <= 64:
        key = lambda i: (((t[i] << bit) | t[i + 1]) << rank_bit) | rank[i + 2]
        before[~is_one] = np.searchsorted(key(rest), key(q))
    else:
        pair, _ = _named(np.concatenate([t[rest], t[q]]), np.concatenate([t[rest + 1], t[q + 1]]))
        key = (pair.astype(np.uint64) << np.uint64(32)) | np.concatenate([rank[rest + 2], rank[q + 2]])
        before[~is_one] = np.searchsorted(key[: rest.size], key[rest.size :])
    out = np.empty(n, np.int64)
    at = np.arange(sampled.size) + before
    taken = np.zeros(n, bool)
    taken[at] = True
    out[at] = sampled
    out[~taken] = rest
    return out


def common_prefix(s: np.ndarray, order: np.ndarray, cap: int) -> np.ndarray:
    """Whether each suffix shares ``cap`` symbols with the one before it in order."""
    out = np.zeros(order.size, bool)
    a, b = order[:-1], order[1:]
    live = np.flatnonzero(np.maximum(a, b) + cap <= s.size)
    packed = np.lib.stride_tricks.sliding_window_view(s, 8).copy().view(np.uint64).ravel() if s.size >= 8 else None
    k = 0
    while live.size and k < cap:
        if cap - k >= 8:
            same = packed[a[live] + k] == packed[b[live] + k]
            k += 8
        else:
            same = s[a[live] + k] == s[b[live] + k]
            k += 1
        live = live[same]
    out[live + 1] = True
    return out


_RANDOM = np.random.default_rng(32)
#: A random number for each byte, and odd factors for the halves of 2, 4, 8 ... bytes.
_BYTE = _RANDOM.integers(0, 1 << 64, 256, np.uint64)
_FACTORS = _RANDOM.integers(0, 1 << 62, 5, np.uint64) * np.uint64(4) + np.uint64(3)


def gram_hashes(x: np.ndarray) -> np.ndarray:
    h, n = _BYTE[x], 1
    for f in _FACTORS:
        wide = h[:-n] * f
        wide += h[n:]
        h, n = wide, n * 2
    h ^= h >> np.uint64(32)
    h *= np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    return h


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    have = 1
    while have * 2 <= w:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: x.size - (w - have)], x[w - have :]) if w > have else x


def anchors(parts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(part, hash, place, first window, windows) of each anchor occurrence, in order.
    The parts have under 2**20 bytes together."""
    data = np.frombuffer(b"".join(parts), np.uint8)
    if data.size < length:
        none = np.empty(0, np.int64)
        return none, none.astype(np.uint64), none, none, none
    ends = np.cumsum([len(p) for p in parts])
    g = gram_hashes(data)
    low_bits = np.uint64((1 << 20) - 1)
    # the leftmost place that holds the window's least hash (of its upper 44 bits)
    chosen = (_sliding_min((g & ~low_bits) | np.arange(g.size, dtype=np.uint64), length - GRAM + 1) & low_bits).astype(np.int64)
    outside = np.zeros(chosen.size, bool)
    for p, end in zip(parts, ends.tolist()):
        outside[max(end - len(p), end - length + 1) : end] = True
    new = np.concatenate([[True], (chosen[1:] != chosen[:-1]) | outside[:-1]])
    first = np.flatnonzero(new & ~outside)
    stops = np.append(np.flatnonzero(new | outside), chosen.size)
    windows = stops[np.searchsorted(stops, first, "right")] - first
    part = np.searchsorted(ends, first, "right")
    begin = ends[part] - np.array([len(p) for p in parts])[part]
    at = chosen[first]
    return part, g[at], at - begin, first - begin, windows


def pieces(texts: list[tuple[int, bytes]], length: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """(uid, first byte, bytes) of texts in lists of some PIECE bytes; a longer text is cut so that
    each of its windows is in one piece."""
    held, size = [], 0
    for uid, data in texts:
        for k in range(0, len(data) - length + 1, PIECE):
            held.append((uid, k, data[k : k + PIECE + length - 1]))
            size += len(held[-1][2])
            if size >= PIECE:
                yield held
                held, size = [], 0
    if held:
        yield held


#: Parts of an anchor's offsets in a window that are tried apart.
QUARTERS = 4


def perhaps_repeated(contexts: list[bytes], anchor: np.ndarray, lead: np.ndarray, windows: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, first window, windows) of the runs of windows that another context may hold.

    lead: the anchor's place in each context. Windows whose anchor is in the same quarter of its
    possible offsets have the bytes around it in common; equal windows have equal ones. No window
    equals another one of its context: their anchor's offsets differ."""
    offsets = length - GRAM + 1
    step = -(-offsets // QUARTERS)
    sizes = np.array([len(c) for c in contexts], np.int64)
    begin = np.cumsum(sizes) - sizes
    x = _BYTE[np.frombuffer(b"".join(contexts), np.uint8)]
    power = np.full(x.size + 1, _FACTORS[0])
    power[0] = 1
    power = np.cumprod(power, dtype=np.uint64)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(x * power[:-1], dtype=np.uint64)])
    kept, starts, stops = [], [], []
    for k in range(0, offsets, step):
        last = min(k + step, offsets) - 1
        start, stop = np.maximum(lead - last, 0), np.minimum(lead - k + 1, windows)
        some = np.flatnonzero(start < stop)
        a = begin[some] + lead[some] - k
        z = begin[some] + lead[some] - last + length
        # the hash of the bytes a to z, moved to one power for all
        h = (sums[z] - sums[a]) * power[x.size - a]
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15) + anchor[some].view(np.uint64)
        order = np.argsort(h)
        same = h[order[1:]] == h[order[:-1]]
        again = np.zeros(lead.size, bool)
        again[some[order[np.concatenate([same, [False]]) | np.concatenate([[False], same])]]] = True
        kept.append(again)
        starts.append(start)
        stops.append(stop)
    # higher quarters come first in a context: their windows start further left
    kept = np.stack(kept[::-1], 1)
    starts, stops = np.stack(starts[::-1], 1), np.stack(stops[::-1], 1)
    wide = np.pad(kept, ((0, 0), (1, 1)))
    opens, closes = np.nonzero(wide[:, 1:-1] & ~wide[:, :-2]), np.nonzero(wide[:, 1:-1] & ~wide[:, 2:])
    first = starts[opens]
    return opens[0], first, stops[closes] - first


def shard_repeats(contexts: list[bytes], order: np.ndarray, windows: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(context, window) of every window that an earlier start repeats. order: (n, 3)
    of doc order, text order and the first window's place; contexts of one shard."""
    if not contexts:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    by = np.lexsort((order[:, 2], order[:, 1], order[:, 0]))  # so places are in order too
    contexts, windows = [contexts[i] for i in by.tolist()], windows[by]
    sizes = np.array([len(c) + 1 for c in contexts], np.int64)
    begin = np.cumsum(sizes) - sizes
    small = np.frombuffer(b"\x00".join(contexts) + b"\x00", np.uint8)
    s = small.astype(np.uint16) + np.uint16(2)
    s[begin + sizes - 1] = 1  # separators
    sa = suffix_array(s)
    # a window never reaches a separator: only window starts count, and they end before it
    owner = np.repeat(np.arange(len(contexts)), sizes)
    is_window = np.arange(s.size) - begin[owner] < windows[owner]
    sa = sa[is_window[sa]]
    same = common_prefix(small, sa, length)
    many = same | np.append(same[1:], False)
    sa, same = sa[many], same[many]
    if not sa.size:
        return sa, sa
    group = np.flatnonzero(~same)
    least = np.repeat(np.minimum.reduceat(sa, group), np.diff(np.append(group, sa.size)))
    later = sa[sa != least]
    return by[owner[later]], later - begin[owner[later]]


def _ranges(uid: np.ndarray, start: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows at starts of documents -> (uid, first byte, end), neighbours joined."""
    by = np.lexsort((start, uid))
    uid, start = uid[by], start[by]
    if not uid.size:
        return uid, start, start
    new = np.concatenate([[True], (uid[1:] != uid[:-1]) | (start[1:] > start[:-1] + 1)])
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:] - 1, [uid.size - 1]])
    return uid[first], start[first], start[last] + length


def two_hashes(window: Column) -> tuple[Column, Column]:
    """64 bits each under two seeds (the second is the hash of a constant): 128 bits together."""
    return F.xxhash64(window), F.xxhash64(F.lit(1), window)


def repeats(units: DataFrame, length: int = 100, shard_bytes: int = SHARD_BYTES, hot: int = HOT, two_hashes=two_hashes) -> DataFrame:
    """(uid, b0, b1): byte ranges to remove. units: distinct texts (uid, doc_id, text)."""
    spark = units.sparkSession
    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist())
            for some in pieces([(u, t or b"") for u, t in texts], length):
                part, g, at, first, windows = anchors([p[2] for p in some], length)
                uid, begin = np.array([p[0] for p in some], np.int64), np.array([p[1] for p in some], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), pa.array(uid[part]), pa.array((first + begin[part]).astype(np.int32)), pa.array(windows.astype(np.int32)), pa.array((at - first).astype(np.int32))], ["anchor", "uid", "at", "windows", "lead"])

    found = save(units.select("uid", "text").mapInArrow(tidy(find), "anchor long, uid long, at int, windows int, lead int"), "anchors")

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows whose anchor the row before or after has too. A partition's first and
        last row are kept unseen: a partition's edge may part an anchor's rows."""
        held = None
        last = None
        for b in batches:
            if not b.num_rows:
                continue
            a = b.column(0).to_numpy()
            if held is not None:
                if last or held.column(0)[0].as_py() == a[0]:
                    yield held
                prior = held.column(0)[0].as_py()
            else:
                prior = a[0]  # the partition's first row
            same_before = np.concatenate([[prior == a[0]], a[1:] == a[:-1]])
            same_after = np.concatenate([a[1:] == a[:-1], [False]])
            keep = same_before | same_after
            yield b.slice(0, b.num_rows - 1).filter(pa.array(keep[:-1]))
            held, last = b.slice(b.num_rows - 1), bool(keep[-1])
        if held is not None:
            yield held

    ranged = found.repartitionByRange(n_parts, "anchor", "uid").sortWithinPartitions("anchor", "uid")
    shared = save(ranged.mapInArrow(tidy(met), found.schema), "anchors-met")
    by_unit = shared.groupBy("uid").agg(F.collect_list(F.struct("anchor", "at", "windows", "lead")).alias("met"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, m = b.column(2).cast(pa.binary()).to_pylist(), b.column(3).flatten()
            owner = np.repeat(np.arange(b.num_rows), b.column(3).value_lengths().to_numpy())
            at, size = m.field("at").to_numpy(), m.field("windows").to_numpy() + (length - 1)
            for k in range(0, at.size, 10_000):
                part = slice(k, k + 10_000)
                ctx = [texts[i][s : s + n] for i, s, n in zip(owner[part].tolist(), at[part].tolist(), size[part].tolist())]
                of = pa.array(owner[part])
                yield pa.RecordBatch.from_arrays([m.field("anchor")[part], b.column(1).take(of), b.column(0).take(of), m.field("at")[part], m.field("windows")[part], m.field("lead")[part], pa.array(ctx, pa.binary())], ["anchor", "doc_id", "uid", "at", "windows", "lead", "bytes"])

    contexts = units.join(by_unit, "uid").select("uid", "doc_id", "text", "met").mapInArrow(tidy(cut), "anchor long, doc_id long, uid long, at int, windows int, lead int, bytes binary")
    # equal contexts have equal anchors at equal places
    contexts = save(contexts.withColumn("ctx", F.unhex(F.md5("bytes"))), "contexts")
    discard(found, shared)
    place = F.struct("doc_id", "uid", "at", "windows", "lead", "bytes")
    firsts = save(contexts.groupBy("anchor", "ctx").agg(F.min(place).alias("f"), F.count("*").alias("n")), "contexts-first")
    again = firsts.where("n > 1").select("ctx", F.col("f.uid").alias("f_uid"), F.col("f.at").alias("f_at"))
    whole = contexts.select("ctx", "uid", "at", "windows").join(again, "ctx").where("uid <> f_uid or at <> f_at")
    whole = whole.select("uid", F.col("at").cast("long").alias("b0"), (F.col("at").cast("long") + F.col("windows") + (length - 1)).alias("b1"))
    mixed = save(firsts.groupBy("anchor").agg(F.count("*").alias("m")).where("m > 1"), "anchors-mixed")
    kept = save(firsts.join(mixed, "anchor").select("anchor", "m", "f.*"), "contexts-kept")
    total = kept.where(F.col("m") <= hot).agg(F.coalesce(F.sum(F.length("bytes")), F.lit(0))).first()[0]
    shards = max(1, -(-total // shard_bytes))

    def sort_shard(shard: pa.Table) -> pa.Table:
        doc = shard.column("doc_id").fill_null(np.iinfo(np.int64).min).to_numpy()
        ctx, (uid, at, anchor, lead, windows) = shard.column("bytes").to_pylist(), (shard.column(c).to_numpy().astype(np.int64) for c in ("uid", "at", "anchor", "lead", "windows"))
        own, first, windows = perhaps_repeated(ctx, anchor, lead, windows, length)
        ctx = [ctx[i][a : a + w] for i, a, w in zip(own.tolist(), first.tolist(), (windows + (length - 1)).tolist())]
        doc, uid, at = doc[own], uid[own], at[own] + first
        c, w = shard_repeats(ctx, np.stack([doc, uid, at], 1), windows, length)
        u, a, z = _ranges(uid[c], at[c] + w, length)
        return pa.table({"uid": u, "b0": a, "b1": z})

    dealt = kept.where(F.col("m") <= hot).withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(shards)))
    # the number of tasks grows with the bytes
    dealt = dealt.repartition(max(min(shards, n_parts), -(-total // TASK_BYTES)), "shard")
    sorted_out = dealt.groupBy("shard").applyInArrow(sort_shard, "uid long, b0 long, b1 long")
    single = kept.where(F.col("m") > hot).select("anchor", "doc_id", "uid", "at", "bytes", F.explode(F.sequence(F.lit(0), F.col("windows") - 1)).alias("w"))
    window = F.substring("bytes", F.col("w") + 1, F.lit(length))
    h1, h2 = two_hashes(window)
    single = single.select(h1.alias("h1"), h2.alias("h2"), "doc_id", "uid", (F.col("at") + F.col("w")).cast("long").alias("b0"))
    low = single.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "uid", "b0")).alias("f"), F.count("*").alias("n")).where("n > 1")
    by_hash = single.join(low, ["h1", "h2"]).where("uid <> f.uid or b0 <> f.b0").select("uid", "b0", (F.col("b0") + length).alias("b1"))
    out = save(whole.union(sorted_out).union(by_hash), "repeats")
    discard(contexts, firsts, mixed, kept)
    return out


def remove(docs: DataFrame, length: int = 100, id_col: str = "doc_id", text: str = "text", keep_bytes: bool = False, hash_of=F.xxhash64, **how) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256; the bytes kept too if asked for."""
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    named, lows = named_texts(base, hash_of)
    # the first of equal texts stands for all; the only row of a text needn't be joined to know it
    twice = lows.where("n > 1").select("uid")
    rows = perhaps(named.select("uid", "doc_id", "text"), "uid", twice)
    of_many = rows.where("listed").join(lows, "uid").where(F.col("doc_id").eqNullSafe(F.col("low")))
    firsts = rows.where("not listed").drop("listed").union(of_many.select("uid", "doc_id", "text"))
    found = repeats(firsts, length, **how)
    spans = save(found.groupBy("uid").agg(F.collect_list(F.struct("b0", "b1")).alias("spans")), "repeat-spans")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[] for _ in range(6)]
            for d, t, first, s in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), b.column(3)):
                data = t.as_py().encode()
                if not first and len(data) >= length:
                    runs = [(0, len(data))]
                elif s.is_valid and first:
                    v = s.values
                    a, z = v.field("b0").to_numpy(), v.field("b1").to_numpy()
                    by = np.argsort(a, kind="stable")
                    a, z = a[by], np.maximum.accumulate(z[by])
                    new = np.concatenate([[True], a[1:] > z[:-1]])
                    runs = list(zip(a[new].tolist(), z[np.concatenate([np.flatnonzero(new)[1:] - 1, [a.size - 1]])].tolist()))
                else:
                    runs = []
                edges = [0, *(e for r in runs for e in r), len(data)]
                left = b"".join(data[x:y] for x, y in zip(edges[::2], edges[1::2]))
                for c, x in zip(out, (d, len(data), len(data) - len(left), len(runs), hashlib.sha256(left).hexdigest(), left)):
                    c.append(x)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)][: 5 + keep_bytes], names[: 5 + keep_bytes])

    rows = perhaps(named, "uid", twice.union(spans.select("uid")))
    ranked = rows.where("listed").join(lows, "uid").withColumn("first", F.col("doc_id").eqNullSafe(F.col("low")))
    changed = ranked.join(spans, "uid", "left").select("doc_id", "text", "first", "spans")
    whole = rows.where("not listed").select("doc_id", "text", F.lit(True).alias("first"), F.lit(None).cast(spans.schema["spans"].dataType).alias("spans"))
    out = whole.union(changed)
    return out.mapInArrow(tidy(cut), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_bytes)
