"""SimHash near-duplicates through deletion-variant signatures.

A 64-bit fingerprint is cut into fewer segments than differing bits would need:
with 3 segments, two fingerprints that differ in at most 4 bits have a segment
in which they differ in at most one. Every fingerprint is indexed under each of
its segments with one bit masked (64 keys), so such pairs share a key; pairs with
a common key are verified on all 64 bits.

Copies are folded into one fingerprint first. A key of over ``buckets.REFINE``
fingerprints is refined: the bits outside its segment are cut into three parts, of
which one differs by at most one bit again, so two fingerprints of a key meet in a
key of some 14 bits more; large tables make few pairs that aren't links. No pairs are
made of fingerprints that are linked already (see buckets). The components are those
of all links.

Nulls: a null or wordless text has fingerprint zero. Repeated rows link at
distance 0; an empty table gives an empty result; extra columns are ignored. Long
texts are hashed whole; a batch holds texts up to a bound of bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .buckets import Source, linked
from .common import discard, named_texts, perhaps, save, tidy

#: Near-copies by similarity: fingerprints up to so many bits apart are candidates. Two
#: texts at Jaccard similarity 0.8 are some 10 bits apart, and keys that hold all pairs up
#: to 14 bits would be too short for large tables, so MinHash bands are a second source.
CANDIDATE_BITS = 4


def fingerprint(text: str | None, width: int, seed: int = 42) -> int:
    """Unsigned 64-bit majority over the hashes of all shingles of ``width`` words."""
    from xxhash import xxh64_intdigest

    words = text.encode().lower().split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        return xxh64_intdigest(joined, seed)
    sizes = list(map(len, words))
    ends = list(accumulate(sizes, lambda a, b: a + b + 1))
    starts = [0, *(e + 1 for e in ends[: len(words) - width])]
    spans = map(joined.__getitem__, map(slice, starts, ends[width - 1 :]))
    h = np.fromiter(map(xxh64_intdigest, spans, repeat(seed)), np.uint64, len(starts))
    ones = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > h.size, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 5, text: str = "text", bands: bool = False) -> DataFrame:
    """The other columns of ``docs`` (longs), and fp: the fingerprint's bits as a signed
    long; with ``bands`` also the text's MinHash band keys."""
    from .substring import forget, text_bands

    keep = [c for c in docs.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t.as_py(), width) for t in b.column(len(keep))], np.uint64).view(np.int64)
            more = [text_bands(b.column(len(keep)))] if bands else []
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(fp, pa.int64()), *more], [*keep, "fp", *["bands"] * bands])

    schema = ", ".join([*(f"{c} long" for c in [*keep, "fp"]), *["bands array<long>"] * bands])
    return docs.select(*keep, text).mapInArrow(tidy(run, forget), schema)


def segments(distance: int) -> list[tuple[int, int]]:
    """(low bit, bits) of the fewest segments of which one differs by at most one bit."""
    k = distance // 2 + 1
    edges = [round(64 * i / k) for i in range(k + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def masked(value: Column, bits: int) -> list[Column]:
    """The value without each of its bits."""
    return [value.bitwiseAND(F.lit(((1 << bits) - 1) & ~(1 << j))) for j in range(bits)]


def variant_keys(fp: Column, distance: int) -> Column:
    """An array of one key for each bit: the segment without that bit, and the bit's number."""
    keys = []
    for low, bits in segments(distance):
        seg = F.shiftrightunsigned(fp, low).bitwiseAND(F.lit((1 << bits) - 1))
        keys += [v * 64 + (low + j) for j, v in enumerate(masked(seg, bits))]
    return F.array(*keys)


def finer_keys(distance: int):
    """Further keys of a row (k, fp): the parts of the bits outside k's segment, one bit
    masked. As many parts as ``distance`` bits need for one that differs by at most one."""

    def keys(k: Column, fp: Column) -> Column:
        bit, out = F.pmod(k, F.lit(64)), F.array().cast("array<long>")
        for low, bits in segments(distance):
            rest = fp.bitwiseAND(F.lit(((1 << low) - 1))).bitwiseOR(F.shiftleft(F.shiftrightunsigned(fp, low + bits), low)) if low + bits < 64 else fp.bitwiseAND(F.lit((1 << low) - 1))
            size, n = 64 - bits, distance // 2 + 1
            edges = [round(size * i / n) for i in range(n + 1)]
            parts = []
            for a, b in zip(edges, edges[1:]):
                part = F.shiftrightunsigned(rest, a).bitwiseAND(F.lit((1 << (b - a)) - 1))
                parts += [F.xxhash64(k, F.lit(a + j), v) for j, v in enumerate(masked(part, b - a))]
            out = F.when((bit >= low) & (bit < low + bits), F.array(*parts)).otherwise(out)
        return out

    return keys


def fingerprint_source(fps: DataFrame, distance: int, id_col: str = "fp") -> Source:
    """fps: distinct (id_col, fp)."""
    index = fps.select(F.explode(variant_keys(F.col("fp"), distance)).alias("k"), F.col(id_col).alias("id"), F.col("fp").alias("x"), F.lit(0).cast("long").alias("w"))
    return Source(index, distance, finer_keys(distance))


def fingerprint_components(fps: DataFrame, distance: int, **how) -> DataFrame:
    """(node, root) for the fingerprints that have a link; ``fps``: distinct (fp)."""
    return linked([fingerprint_source(fps, distance)], name="simhash", **how)


def link(docs: DataFrame, distance: int = 4, width: int = 5, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fp, component_id (smallest doc_id reachable) for every document."""
    each = save(fingerprints(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text")), width), "simhash")
    reps = save(each.groupBy("fp").agg(F.min("doc_id").alias("low")), "simhash-reps")
    roots = fingerprint_components(reps.select("fp"), distance)
    named = save(reps.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "low", F.coalesce("root", "fp").alias("root")), "simhash-named")
    least = named.groupBy("root").agg(F.min("low").alias("component_id"))
    by_fp = named.join(least, "root").select("fp", "component_id")
    discard(reps, roots)
    return each.join(by_fp, "fp").select("doc_id", "fp", "component_id")


def near_components(named: DataFrame, lows: DataFrame, similarity: float = 0.8, width: int = 5) -> DataFrame:
    """(uid, component_id, leads, n) of every text. named, lows: as of ``named_texts``.

    Texts are linked where the exact Jaccard similarity of their ``width``-word shingles
    reaches ``similarity``; each text is compared once, whatever its copies. Candidates
    are fingerprints up to CANDIDATE_BITS apart, from the deletion-variant index, and
    texts that share a MinHash band (0.998 of the pairs at similarity 0.8). component_id
    is the smallest doc_id of the component, leads marks its first text, n is its rows. Texts of under
    ``width`` words are copies only of equal words; empty and null texts are one text.
    """
    from .substring import banded, jaccard

    every = save(fingerprints(named.select("uid", "text"), width, bands=True), "near-fps")
    each = save(every.groupBy(F.col("uid").alias("id")).agg(F.first("fp").alias("fp"), F.first("bands").alias("bands"), F.count("*").alias("n")), "near-texts")
    discard(every)

    def fetch(wanted: DataFrame) -> DataFrame:
        """The texts of some uids, each from its first document: the one place where texts move,
        and only those that are wanted."""
        # joined on plain columns, by which repeated rows then lie together
        at = lambda c: F.coalesce(c, F.lit(-(2**63)))
        first = wanted.join(lows.select(F.col("uid").alias("id"), at("low").alias("at")), "id")
        rows = perhaps(named.select("uid", at("doc_id").alias("place"), "text"), "uid", wanted).where("listed")
        found = rows.join(first, (F.col("uid") == F.col("id")) & (F.col("place") == F.col("at")))
        return found.select("id", "at", F.col("text").alias("words")).dropDuplicates(["id", "at"])

    sources = [fingerprint_source(each.where("fp <> 0").select("id", "fp"), CANDIDATE_BITS, "id"), Source(banded(each))]
    roots = linked(sources, jaccard(fetch, similarity), name="near")
    by_uid = save(lows.join(roots.withColumnRenamed("node", "uid"), "uid", "left").select("uid", "low", "n", F.coalesce("root", "uid").alias("root")), "near-named")
    least = save(by_uid.groupBy("root").agg(F.min(F.struct("low", "uid")).alias("first")), "near-first")
    discard(each, roots)
    return by_uid.join(least, "root").select("uid", F.col("first.low").alias("component_id"), (F.col("uid") == F.col("first.uid")).alias("leads"), "n")


def near_copies(docs: DataFrame, similarity: float = 0.8, width: int = 5, id_col: str = "doc_id", text: str = "text", hash_of=F.xxhash64) -> DataFrame:
    """doc_id, component_id for every row."""
    whole = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    named, lows = named_texts(whole, hash_of)
    return named.select("doc_id", "uid").join(near_components(named, lows, similarity, width), "uid").select("doc_id", "component_id")


def without_near_copies(docs: DataFrame, similarity: float = 0.8, width: int = 5, id_col: str = "doc_id", text: str = "text", hash_of=F.xxhash64) -> DataFrame:
    """The rows of ``docs``, with their columns, that hold the first text of their component
    under its smallest doc_id (a null one is the smallest). Rows that repeat doc_id and
    text are one document and stay together; an empty table stays empty. The only row of a
    first text stays where it is: rows of other texts alone are joined."""
    whole = docs.select(F.struct(*(F.col(c) for c in docs.columns)).alias("doc"), F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    named, lows = named_texts(whole, hash_of)
    found = save(near_components(named.select("doc_id", "text", "uid"), lows, similarity, width), "near-components")
    first = found.where("leads").select(F.col("uid").alias("of"), "component_id")
    rows = perhaps(named.select("doc", "doc_id", "uid"), "uid", found.where("not leads or n > 1").select("uid"))
    kept = rows.where("listed").join(first, (F.col("uid") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("component_id")), "left_semi")
    return rows.where("not listed").union(kept).select(*(F.col("doc")[c].alias(c) for c in docs.columns))
