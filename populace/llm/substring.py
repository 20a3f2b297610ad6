"""Substring dedup: repeated passages, then near-copies of paragraphs.

Passages. 8-word seeds are chosen by winnowing (of any 24 neighbouring seeds the
one with the least hash), so every two equal runs of 31 words share a seed. Each
seed's later occurrences are compared word by word with its first one, up to 24
words either way; equal runs of ``MIN_SPAN`` words or more go. Where a seed occurs
more than twice, later occurrences can repeat each other and not the first one: of their
31-word windows those that hold a word that is still left are grouped by a hash, and all
but the earliest of a group go. A window belongs to the first of its least seeds alone, and
equal windows to equal seeds. No pairs of a group are made, however many texts share a
passage. A later copy of a whole text of that size goes whole, and so
does a paragraph that loses 0.8 of its words, be it to repeats of itself.

Paragraphs (lines of ``MIN_PARAGRAPH`` words or more) of what is left get MinHash
signatures over 5-word shingles. With 12 bands of 4 rows, a pair of Jaccard
similarity 0.8 shares a band with probability 0.998. Colliding paragraphs are
verified by their exact Jaccard similarity and linked into components; the first
occurrence of each component stays, the others go.

Nulls: a null text is empty; a null doc_id sorts first. Rows that repeat both
doc_id and text are one document. Order is by doc_id, then a hash of the text.
An empty table gives an empty result; extra columns are kept. A long text is cut like any
other, its seeds and paragraphs being rows of their own.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .buckets import Source, Verify, linked
from .common import discard, named_texts, perhaps, save, tidy

BANDS, ROWS, SHINGLE = 12, 4, 5
SEED_WORDS, WINDOW, CONTEXT = 8, 24, 24
MIN_PARAGRAPH, MIN_SPAN, SIMILARITY = 20, 31, 0.8
CUT = T.StructType([T.StructField("text", T.StringType()), T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType())])
WORD = re.compile(r"[^\x20\x09-\x0D]+")


#: Bytes whose words are hashed at once, and the base of the words' polynomials (odd, so it has an inverse).
CHUNK_BYTES, BASE = 1 << 18, 0x9E3779B97F4A7C15
_GAP, _LOW = np.zeros(256, bool), np.arange(256, dtype=np.uint8)
_GAP[[9, 10, 11, 12, 13, 32]] = True
_LOW[65:91] += 32
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** i and BASE ** -i modulo 2 ** 64 for i up to n."""
    if not _powers or _powers[0].size <= n:
        size = max(n, 2 * CHUNK_BYTES) + 1
        _powers[:] = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size, v, np.uint64)])) for v in (BASE, pow(BASE, -1, 2**64))]
    return _powers[0], _powers[1]


def forget() -> None:
    _powers.clear()


def hashed_words(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of several texts, ASCII letters as lower-case ones, and
    where each begins. data: the texts' bytes on end; starts: where each text begins.

    A word's hash is the polynomial of its bytes, from differences of running sums, mixed."""
    if not data.size:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    gap, (up, down) = _GAP[data], powers(data.size)
    edge = np.zeros(data.size + 1, bool)
    edge[1:-1] = gap[1:] != gap[:-1]
    edge[starts] = edge[0] = edge[-1] = True
    at = np.flatnonzero(edge)
    word = ~gap[at[:-1]]
    a, b = at[:-1][word], at[1:][word]
    total = np.zeros(data.size + 1, np.uint64)
    np.cumsum((_LOW[data].astype(np.uint64) + np.uint64(1)) * up[: data.size], out=total[1:])
    h = (total[b] - total[a]) * down[a]
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32)), a


def word_hashes(text: str) -> np.ndarray:
    return hashed_words(np.frombuffer(text.encode(), np.uint8), np.zeros(1, np.int64))[0]


def gram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of every n neighbouring words, along the last axis."""
    m = max(0, h.shape[-1] - n + 1)
    g = np.zeros((*h.shape[:-1], m), np.uint64)
    for j in range(n):
        g = g * np.uint64(0x9E3779B97F4A7C15) + h[..., j : j + m]
        g ^= g >> np.uint64(29)
    return g * np.uint64(0xBF58476D1CE4E5B9)


def _sliding(x: np.ndarray, w: int, op) -> np.ndarray:
    """op over x[i : i + w] for each i that has a full window."""
    have = 1
    while have * 2 <= w:
        x = op(x[:-have], x[have:])
        have *= 2
    return op(x[: x.size - (w - have)], x[w - have :]) if w > have else x


def seeds(h: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text, first word) of the winnowed seeds of several texts at once.

    h: the word hashes of all texts; sizes: the words of each. Windows that reach
    into the next text may add seeds; each text's own windows all have theirs."""
    ends = np.cumsum(sizes)
    g = gram_hashes(narrow(h), SEED_WORDS)
    owner = np.repeat(np.arange(sizes.size), sizes)[: g.size]
    at = np.arange(g.size) - (ends - sizes)[owner]
    whole = at + SEED_WORDS <= sizes[owner]
    g[~whole] = 2**64 - 1
    if g.size > WINDOW:
        low = _sliding(g, WINDOW, np.minimum)
        pad = np.concatenate([np.zeros(WINDOW - 1, np.uint64), low, np.zeros(WINDOW - 1, np.uint64)])
        whole &= _sliding(pad, WINDOW, np.maximum) == g
    k = np.flatnonzero(whole)
    return g[k], owner[k], at[k]


def in_chunks(texts: pa.Array | list[str | None]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(number of the first text, word hashes, words of each) for runs of texts of some
    CHUNK_BYTES, or of one longer text; a null text has no words."""
    col = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
    if not len(col):
        return
    col = col.fill_null("") if col.null_count else col
    _, offsets, data = col.buffers()
    at = np.frombuffer(offsets, np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    k = 0
    while k < len(col):
        end = max(k + 1, int(np.searchsorted(at, at[k] + CHUNK_BYTES, "right")) - 1)
        h, starts = hashed_words(data[at[k] : at[end]], at[k:end] - at[k])
        yield k, h, np.diff(np.searchsorted(starts, at[k : end + 1] - at[k]))
        k = end


_PERM = np.random.default_rng(7).integers(1, 2**32, (2, BANDS * ROWS), dtype=np.uint32) | np.uint32(1)


def shingles(h: np.ndarray) -> np.ndarray:
    """Distinct shingle hashes of a paragraph; a shorter one is its own shingle."""
    return np.unique(gram_hashes(h, min(SHINGLE, h.size)))


def band_keys(h: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """(texts, BANDS) keys from the minima of permuted shingle hashes.

    h: the word hashes of texts of SHINGLE words or more each; sizes: the words of each."""
    g = gram_hashes(h, SHINGLE)
    ends = np.cumsum(sizes)
    inside = np.ones(g.size, bool)
    for j in range(1, SHINGLE):  # shingles that reach into the next text
        inside[ends[:-1] - j] = False
    x = (g[inside] >> np.uint64(32)).astype(np.uint32)
    starts = np.cumsum(sizes - SHINGLE + 1) - (sizes - SHINGLE + 1)
    key = np.repeat(np.arange(BANDS, dtype=np.uint64)[None, :], sizes.size, axis=0)
    for k in range(BANDS * ROWS):
        low = np.minimum.reduceat(x * _PERM[0, k] + _PERM[1, k], starts)
        col = (key[:, k // ROWS] ^ low) * np.uint64(0x9E3779B97F4A7C15)
        key[:, k // ROWS] = col ^ (col >> np.uint64(32))
    return key.view(np.int64)


def text_bands(texts: pa.Array | list[str | None]) -> pa.Array:
    """The band keys of each text, none for one of fewer than SHINGLE words."""
    keys, ok = [np.empty(0, np.int64)], [np.zeros(1, bool)]
    for _, h, sizes in in_chunks(texts):
        ok.append(sizes >= SHINGLE)
        if ok[-1].any():
            keys.append(band_keys(h[np.repeat(ok[-1], sizes)], sizes[ok[-1]]).ravel())
    ends = np.cumsum(np.concatenate(ok) * BANDS).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(keys)))


def _batch(cols: list, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)


def paragraphs(units: DataFrame) -> DataFrame:
    """(uid, doc_id, line, key, words) of each paragraph; key: the MD5 of its words.

    units: (uid, doc_id, text)."""
    schema = pa.schema([("uid", pa.int64()), ("doc_id", pa.int64()), ("line", pa.int32()), ("key", pa.binary()), ("words", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list] = [[] for _ in schema]
            for uid, doc_id, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                for k, line in enumerate((t.as_py() or "").split("\n")):
                    words = line.encode().lower().split()
                    if len(words) >= MIN_PARAGRAPH:
                        joined = b" ".join(words)
                        for c, v in zip(cols, (uid, doc_id, k, hashlib.md5(joined).digest(), joined.decode())):
                            c.append(v)
                if len(cols[0]) > 1_000:
                    yield _batch(cols, schema)
                    cols = [[] for _ in schema]
            yield _batch(cols, schema)

    return units.mapInArrow(tidy(run, forget), "uid long, doc_id long, line int, key binary, words string")


def banded(texts: DataFrame) -> DataFrame:
    """An index of texts (id, bands, n): a row for each band, ordered inside a key by the
    next band, so that neighbours share two bands where any do; weighted by n."""
    at = texts.select("id", "n", "bands", F.posexplode("bands").alias("i", "k"))
    return at.select("k", "id", F.element_at("bands", ((F.col("i") + 1) % BANDS + 1).cast("int")).alias("x"), F.col("n").cast("long").alias("w"))


def with_bands(texts: DataFrame) -> DataFrame:
    """(id, n, bands) of texts (id, words, n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), text_bands(b.column(1))], ["id", "n", "bands"])

    return texts.select("id", "words", "n").mapInArrow(tidy(run, forget), "id long, n long, bands array<long>")


def paragraph_roots(texts: DataFrame) -> DataFrame:
    """(node, root) over the pids of near-equal paragraphs; texts: distinct (pid, words, n)."""
    named = texts.select(F.col("pid").alias("id"), "words", F.col("n").cast("long").alias("n"))
    index = banded(with_bands(named))
    return linked([Source(index)], jaccard(lambda wanted: perhaps(named, "id", wanted).where("listed").join(wanted, "id", "left_semi").select("id", "words")), name="paragraph")


def similar_block(left: list[np.ndarray], right: list[np.ndarray], similarity: float = SIMILARITY) -> np.ndarray:
    """Whether the Jaccard similarity of two sets reaches ``similarity``, all of left against
    all of right. Only numbers that two of the sets hold count; they are counted by products
    of 0/1 matrices, so many columns at a time as hold a few MB."""
    sizes = np.array([v.size for v in [*left, *right]])
    owner = np.repeat(np.arange(sizes.size), sizes)
    _, at, n = np.unique(np.concatenate([*left, *right]), return_inverse=True, return_counts=True)
    col = np.cumsum(n > 1) - 1
    keep = n[at] > 1
    owner, at = owner[keep], col[at[keep]]
    width = max(1, (2 << 20) // max(1, sizes.size))
    both = np.zeros((len(left), len(right)), np.float32)
    order = np.argsort(at, kind="stable")
    owner, at = owner[order], at[order]
    for c in range(0, int(at[-1]) + 1 if at.size else 0, width):
        s = slice(*np.searchsorted(at, [c, c + width]))
        m = np.zeros((sizes.size, width), np.float32)
        m[owner[s], at[s] - c] = 1
        both += m[: len(left)] @ m[len(left) :].T
    a, b = sizes[: len(left), None], sizes[None, len(left) :]
    return both >= similarity * (a + b - both)


def jaccard(fetch: Callable[[DataFrame], DataFrame], similarity: float = SIMILARITY) -> Verify:
    """Verifies candidates by the exact Jaccard similarity of their shingles.
    fetch: the (id, words) of wanted ids, so only texts of a candidate move."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            loads = [shingles(h[e - n : e]).tobytes() for _, h, sizes in in_chunks(b.column(1)) for e, n in zip(np.cumsum(sizes).tolist(), sizes.tolist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(loads, pa.binary())], ["id", "load"])

    kept: list[DataFrame] = []

    def loaded(wanted: DataFrame) -> DataFrame:
        """The loads of some ids; those that were fetched before aren't fetched again."""
        for held in kept:
            wanted = wanted.join(held.select("id"), "id", "left_anti")
        wanted = save(wanted, "wanted")
        if not kept or not wanted.isEmpty():
            kept.append(save(fetch(wanted).select("id", "words").mapInArrow(tidy(hashed, forget), "id long, load binary"), "shingles"))
        discard(wanted)
        out = kept[0]
        for more in kept[1:]:
            out = out.union(more)
        return out

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            ok = []
            for p, q in zip(x.column(2), x.column(3)):
                s, t = np.frombuffer(p.as_py(), np.uint64), np.frombuffer(q.as_py(), np.uint64)
                few, many = sorted((s.size, t.size))
                both = np.intersect1d(s, t, assume_unique=True).size if few >= similarity * many else 0
                ok.append(both >= similarity * (s.size + t.size - both))
            yield pa.RecordBatch.from_arrays([x.column(0), x.column(1)], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    def pairs(found: DataFrame) -> DataFrame:
        held = loaded(found.select(F.col("a").alias("id")).union(found.select("b")).distinct())
        both = found.join(held.select(F.col("id").alias("a"), F.col("load").alias("la")), "a").join(held.select(F.col("id").alias("b"), F.col("load").alias("lb")), "b")
        return save(both.select("a", "b", "la", "lb").mapInArrow(tidy(score), "a long, b long"), "links")

    return Verify(pairs, loaded, lambda left, right: similar_block(left, right, similarity), kept)


def repeated_paragraphs(units: DataFrame) -> DataFrame:
    """(uid, doc_id, line) of the paragraphs that go."""
    every = save(paragraphs(units), "paragraphs")
    texts = save(every.groupBy("key").agg(F.min("words").alias("words"), F.count("*").alias("n")).select("key", F.monotonically_increasing_id().alias("pid"), "words", "n"), "paragraph-texts")
    roots = paragraph_roots(texts)
    named = texts.join(roots.withColumnRenamed("node", "pid"), "pid", "left").where("n > 1 or root is not null").select("key", F.coalesce("root", "pid").alias("root"))
    at = every.select("uid", "doc_id", "line", "key").join(named, "key").select("uid", "doc_id", "line", "root")
    # written, so that the next join reads two plain shuffles and a hot root can be split
    firsts = save(at.groupBy("root").agg(F.min(F.struct("doc_id", "uid", "line")).alias("first"), F.count("*").alias("n")).where("n > 1"), "paragraph-firsts")
    out = save(at.join(firsts, "root").where(~F.struct("doc_id", "uid", "line").eqNullSafe(F.col("first"))).select("uid", "doc_id", "line"), "paragraph-removals")
    discard(every, texts, roots, firsts)
    return out


def narrow(h: np.ndarray) -> np.ndarray:
    """32 bits of each word's hash; 0 is left for what lies beyond a text's ends."""
    return (h >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def uncovered(at: np.ndarray, size: int, ranges: np.ndarray) -> np.ndarray:
    """For each seed a mask of the words of its view that lie in none of the (start, end) ranges."""
    edge = np.zeros(size + 1, np.int64)
    np.add.at(edge, ranges[:, 0], 1)
    np.add.at(edge, ranges[:, 1], -1)
    free = np.zeros(size + 2 * CONTEXT + SEED_WORDS, np.uint64)
    free[CONTEXT : CONTEXT + size] = np.cumsum(edge[:-1]) == 0
    place = np.arange(2 * CONTEXT + SEED_WORDS)
    return (free[at[:, None] + place] << place.astype(np.uint64)).sum(axis=1, dtype=np.uint64)


def seed_windows(words: np.ndarray, free: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first word, hash) of the windows of MIN_SPAN words that hold a free word and of
    whose seeds the view's own is the first of the least. free: masks of words."""
    n = words.shape[1] - MIN_SPAN + 1
    up, down = powers(words.shape[1])
    total = np.zeros((len(words), words.shape[1] + 1), np.uint64)
    np.cumsum(words * up[: words.shape[1]], axis=1, out=total[:, 1:])
    g = (total[:, MIN_SPAN:] - total[:, :n]) * down[:n]
    g = (g ^ (g >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    beyond = np.cumsum(np.pad(words == 0, ((0, 0), (1, 0))), axis=1, dtype=np.int8)
    inside = beyond[:, MIN_SPAN:] == beyond[:, :n]  # no word beyond the text's ends
    grams = gram_hashes(words, SEED_WORDS)
    own = grams[:, CONTEXT, None]
    before = np.cumprod((grams[:, CONTEXT - 1 :: -1] > own), axis=1)[:, : WINDOW - 1].sum(axis=1)[:, None]
    after = np.cumprod((grams[:, CONTEXT + 1 :] >= own), axis=1)[:, : WINDOW - 1].sum(axis=1)[:, None]
    col = np.arange(n)
    inside &= (col >= CONTEXT - before) & (col + WINDOW - 1 <= CONTEXT + after) & (col <= CONTEXT)
    span = np.uint64((1 << MIN_SPAN) - 1) << col.astype(np.uint64)
    inside &= (free[:, None] & span) != 0
    row, col = np.nonzero(inside)
    return row, col, (g ^ (g >> np.uint64(32)))[row, col].view(np.int64)


def repeated_passages(units: DataFrame, lows: DataFrame) -> DataFrame:
    """(uid, w0, w1): word ranges that repeat an earlier passage of another text or place.

    units: (uid, doc_id, text), where equal texts have equal uids; lows: the first
    doc_id of each uid, (uid, low)."""
    seed_schema = pa.schema([("seed", pa.int64()), ("uid", pa.int64()), ("doc_id", pa.int64()), ("at", pa.int32())])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            uid, doc = b.column(0).to_numpy(), b.column(1)
            for first, h, sizes in in_chunks(b.column(2)):
                g, owner, at = seeds(h, sizes)
                yield pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), pa.array(uid[first + owner]), doc.take(pa.array(first + owner)), pa.array(at.astype(np.int32))], schema=seed_schema)

    found = save(units.mapInArrow(tidy(find, forget), "seed long, uid long, doc_id long, at int"), "seeds")
    spot_of = lambda c: F.xxhash64("uid", c)
    spot = spot_of("at")
    # written, so that the joins read two plain shuffles and a hot seed can be split
    twice = save(found.groupBy("seed").agg(F.min(spot).alias("p"), F.max(spot).alias("q")).where("p <> q").select("seed"), "seeds-twice")
    again = save(found.join(twice, "seed"), "seeds-again")
    discard(found, twice)
    spots = save(again.groupBy("seed", "uid", "at").agg(F.min("doc_id").alias("doc_id")), "seeds-spots")
    discard(again)
    firsts = save(spots.groupBy("seed").agg(F.min(F.struct("doc_id", "uid", "at")).alias("f"), F.count("*").alias("n")), "seeds-first")
    met = spots.join(firsts, "seed").select("seed", "uid", "at", ((F.col("uid") == F.col("f.uid")) & (F.col("at") == F.col("f.at"))).alias("is_first"), (F.col("n") > 2).alias("many"))
    by_doc = met.groupBy("uid").agg(F.collect_list(F.struct("seed", "at", "is_first", "many")).alias("met")).join(lows, "uid")
    view_schema = pa.schema([("seed", pa.int64()), ("uid", pa.int64()), ("doc_id", pa.int64()), ("at", pa.int32()), ("is_first", pa.bool_()), ("many", pa.bool_()), ("size", pa.int32()), ("words", pa.binary())])
    wide = SEED_WORDS + 2 * CONTEXT

    def views(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            uids, docs, found = b.column(0).to_numpy(), b.column(1), b.column(3)
            for first, hashes, sizes in in_chunks(b.column(2)):
                ends = np.cumsum(sizes)
                for i, (end, size) in enumerate(zip(ends.tolist(), sizes.tolist()), first):
                    m = found[i].values
                    at = m.field("at").to_numpy()
                    h = np.concatenate([np.zeros(CONTEXT, np.uint32), narrow(hashes[end - size : end]), np.zeros(CONTEXT + SEED_WORDS, np.uint32)])
                    for k in range(0, at.size, 20_000):
                        part = at[k : k + 20_000]
                        rows = h[part[:, None] + np.arange(wide)]
                        words = pa.Array.from_buffers(pa.binary(wide * 4), part.size, [None, pa.py_buffer(rows.tobytes())]).cast(pa.binary())
                        s = slice(k, k + part.size)
                        yield pa.RecordBatch.from_arrays([m.field("seed")[s], pa.array(np.full(part.size, uids[i], np.int64)), pa.repeat(docs[i], part.size), m.field("at")[s], m.field("is_first")[s], m.field("many")[s], pa.array(np.full(part.size, size, np.int32)), words], schema=view_schema)

    seen = perhaps(units, "uid", spots.select("uid")).where("listed").join(by_doc, "uid").where(F.col("doc_id").eqNullSafe(F.col("low"))).select("uid", "doc_id", "text", "met")
    seen = save(seen.mapInArrow(tidy(views, forget), "seed long, uid long, doc_id long, at int, is_first boolean, many boolean, size int, words binary"), "seeds-seen")
    discard(spots, firsts)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a, f = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint32).reshape(-1, wide) for c in (2, 3))
            same = (a == f) & (a != 0)
            left = np.cumprod(same[:, CONTEXT - 1 :: -1], axis=1).sum(axis=1)
            right = np.cumprod(same[:, CONTEXT + SEED_WORDS :], axis=1).sum(axis=1)
            ok = same[:, CONTEXT : CONTEXT + SEED_WORDS].all(axis=1) & (left + right + SEED_WORDS >= MIN_SPAN)
            uid, at = b.column(0).to_numpy(), b.column(1).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(uid[ok]), pa.array((at - left)[ok], pa.int32()), pa.array((at + SEED_WORDS + right)[ok], pa.int32())], ["uid", "w0", "w1"])

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The seeds around which words are left, with their masks."""
        for b in batches:
            for uid, met, ranges in zip(b.column(0).to_pylist(), b.column(1), b.column(2)):
                m, r = met.values, ranges.values
                spans = np.stack([r.field(0).to_numpy(), r.field(1).to_numpy()], axis=1) if r is not None else np.empty((0, 2), np.int32)
                free = uncovered(m.field("at").to_numpy(), m.field("size")[0].as_py(), spans)
                some = np.flatnonzero(free)
                yield pa.RecordBatch.from_arrays([m.field("seed").take(pa.array(some)), pa.array(np.full(some.size, uid, np.int64)), m.field("at").take(pa.array(some)), pa.array(free[some].view(np.int64))], ["seed", "uid", "at", "free"])

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a, free, at = np.frombuffer(b"".join(b.column(3).to_pylist()), np.uint32).reshape(-1, wide), b.column(4).to_numpy().view(np.uint64), b.column(2).to_numpy()
            for k in range(0, len(a), 2_000):
                row, col, window = seed_windows(a[k : k + 2_000], free[k : k + 2_000])
                row = row + k
                yield pa.RecordBatch.from_arrays([b.column(5).take(pa.array(row)), b.column(0).take(pa.array(row)), b.column(1).take(pa.array(row)), pa.array((at[row] + col - CONTEXT).astype(np.int32)), pa.array(window)], ["seed", "uid", "doc_id", "w0", "window"])

    first = seen.where("is_first").select("seed", F.col("words").alias("first_words"))
    later = seen.where("not is_first")
    pairs = later.select("seed", "uid", "at", "words").join(first, "seed").select("uid", "at", "words", "first_words")
    alike = save(pairs.mapInArrow(tidy(compare, forget), "uid long, w0 int, w1 int"), "passages-alike")
    # words that the first occurrences leave: the windows around them
    others = later.where("many").groupBy("uid").agg(F.collect_list(F.struct("seed", "at", "size")).alias("met"))
    by_uid = others.join(alike.groupBy("uid").agg(F.collect_list(F.struct("w0", "w1")).alias("ranges")), "uid", "left")
    left = save(by_uid.mapInArrow(tidy(opened, forget), "seed long, uid long, at int, free long"), "seeds-left")
    again = later.where("many").select("seed", "uid", "at", "doc_id", "words").join(left, ["seed", "uid", "at"]).select("uid", "doc_id", "at", "words", "free", "seed")
    each = save(again.mapInArrow(tidy(windows, forget), "seed long, uid long, doc_id long, w0 int, window long"), "windows")
    discard(seen, left)
    twice = save(each.groupBy("seed", "window").agg(F.min(spot_of("w0")).alias("p"), F.max(spot_of("w0")).alias("q")).where("p <> q").select("seed", "window"), "windows-twice")
    common = each.join(twice, ["seed", "window"])
    place = F.struct("doc_id", "uid", "w0")
    firsts_of = save(common.groupBy("seed", "window").agg(F.min(place).alias("f")), "windows-common")
    repeats = common.join(firsts_of, ["seed", "window"]).where("uid <> f.uid or w0 <> f.w0").select("uid", "w0", (F.col("w0") + MIN_SPAN).alias("w1"))
    out = save(alike.union(repeats), "passage-removals")
    discard(alike, each, twice, firsts_of)
    return out


def line_spans(text: str, lines: list[int]) -> list[tuple[int, int]]:
    """Character spans of whole lines with their line ends."""
    spans, start, wanted = [], 0, set(lines)
    for k, line in enumerate(text.split("\n")):
        if k in wanted:
            spans.append((start, min(start + len(line) + 1, len(text))))
        start += len(line) + 1
    return spans


def word_spans(text: str, ranges: list[tuple[int, int]], share: float = SIMILARITY) -> list[tuple[int, int]]:
    """Character spans of word ranges, and of lines that lose ``share`` of their words to them."""
    at = [m.span() for m in WORD.finditer(text)]
    ranges = [(a, min(b, len(at))) for a, b in ranges if a < len(at)]
    gone = np.zeros(len(at) + 1, np.int64)
    for a, b in ranges:
        gone[a] += 1
        gone[b] -= 1
    lost = np.concatenate([[0], np.cumsum(np.cumsum(gone[:-1]) > 0)])
    starts = np.array([a for a, _ in at])
    spans, start = [(at[a][0], at[b - 1][1]) for a, b in ranges], 0
    for line in text.split("\n"):
        a, b = np.searchsorted(starts, [start, start + len(line)])
        if b - a >= MIN_PARAGRAPH and lost[b] - lost[a] >= share * (b - a):
            spans.append((start, min(start + len(line) + 1, len(text))))
        start += len(line) + 1
    return spans


def without(text: str, spans: list[tuple[int, int]]) -> tuple[str, int, int]:
    """The text without the spans, the characters that went, and the maximal runs of them."""
    runs: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if runs and a <= runs[-1][1]:
            runs[-1] = runs[-1][0], max(b, runs[-1][1])
        else:
            runs.append((a, b))
    edges = [0, *(e for r in runs for e in r), len(text)]
    return "".join(text[a:b] for a, b in zip(edges[::2], edges[1::2])), sum(b - a for a, b in runs), len(runs)


def packed(a: str, b: str):
    """Two word numbers as one long: arrays of them stay numbers on the way to Python."""
    return F.shiftleft(F.col(a).cast("long"), 32).bitwiseOR(F.col(b).cast("long"))


def overlapping(ranges: np.ndarray) -> list[tuple[int, int]]:
    """Packed word ranges, those that share words made one."""
    a, b = np.sort(ranges) >> 32, np.sort(ranges) & 0xFFFFFFFF
    reach = np.maximum.accumulate(b)
    first = np.append(True, a[1:] >= reach[:-1])
    return list(zip(a[first].tolist(), reach[np.append(first[1:], True)].tolist()))


@F.pandas_udf(CUT)
def _cut_passages(texts: pd.Series, ranges: pd.Series, copies: pd.Series) -> pd.DataFrame:
    out = []
    for t, g, is_copy in zip(texts, ranges, copies):
        if t and is_copy and len(t.encode().split()) >= MIN_SPAN:
            out.append(("", len(t), 1))
        elif t and not is_copy and g is not None:
            out.append(without(t, word_spans(t, overlapping(np.asarray(g, np.int64)))))
        else:
            out.append((t, 0, 0))
    return pd.DataFrame(out, columns=["text", "n_removed", "n_spans"])


@F.pandas_udf(CUT)
def _cut_paragraphs(texts: pd.Series, lines: pd.Series) -> pd.DataFrame:
    out = [(t, 0, 0) if t is None or g is None else without(t, line_spans(t, g)) for t, g in zip(texts, lines)]
    return pd.DataFrame(out, columns=["text", "n_removed", "n_spans"])


def cut(docs: DataFrame, id_col: str = "doc_id", text: str = "text", hash_of=F.xxhash64) -> DataFrame:
    """doc (a struct of the other columns), text (what is left), n_removed (characters), n_spans."""
    key = F.col(id_col).cast("long")
    others = F.struct(*(F.col(c) for c in docs.columns if c != text))
    named, lows = named_texts(docs.select(others.alias("doc"), key.alias("doc_id"), F.col(text).alias("text")), hash_of)
    found = repeated_passages(named.select("uid", "doc_id", "text"), lows)
    ranges = found.groupBy("uid").agg(F.collect_set(packed("w0", "w1")).alias("goes"))
    # a text's only row that holds no repeat stays as it is, where it is
    rows = perhaps(named, "uid", found.select("uid").union(lows.where("n > 1").select("uid")))
    known = rows.where("listed").join(lows.join(ranges, "uid", "left"), "uid").withColumn("cut", _cut_passages("text", "goes", ~F.col("doc_id").eqNullSafe(F.col("low"))))
    changed = known.select("doc", "doc_id", "uid", F.col("cut.text").alias("text"), F.col("cut.n_removed").alias("n0"), F.col("cut.n_spans").alias("s0"))
    whole = rows.where("not listed").select("doc", "doc_id", "uid", "text", F.lit(0).cast("long").alias("n0"), F.lit(0).cast("long").alias("s0"))
    left = save(whole.union(changed), "passages-cut")
    discard(found)
    lines = repeated_paragraphs(left.select("uid", "doc_id", "text")).groupBy(F.col("uid").alias("of"), F.col("doc_id").alias("at")).agg(F.collect_set("line").alias("goes"))
    by_line = left.join(lines, (F.col("uid") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("at")), "left").withColumn("cut", _cut_paragraphs("text", "goes"))
    return by_line.select("doc", "cut.text", (F.col("n0") + F.col("cut.n_removed")).alias("n_removed"), (F.col("s0") + F.col("cut.n_spans")).alias("n_spans"))


def cut_documents(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with ``text`` cut, and n_removed and n_spans (in place of columns of those names)."""
    own = [c for c in docs.columns if c not in ("n_removed", "n_spans")]
    return cut(docs, id_col, text).select(*(F.col("text").alias(c) if c == text else F.col("doc")[c].alias(c) for c in own), "n_removed", "n_spans")
