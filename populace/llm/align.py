"""Two tokenizers' tokens of the same texts, aligned by the bytes they cover.

The tokens of B are a static interval index: their starts and ends, in order. A token of A
is stabbed into it by bisection: the first B token that ends after it begins, and the first
that begins at or after its end; what lies between overlaps it. A place between two bytes
that no token of either side spans is a gap, and gaps cut a text's tokens into groups.

How many documents hold a pair of ids linked is counted over the whole corpus. Texts come
in Arrow batches; each becomes one row that holds its distinct linked pairs once, with the
number of its documents that hold them, and each document's distinct pairs as places in that
list, with the number of its links of each. So what is shuffled by pair is a batch's vocabulary
of pairs, not its links, no pair has more than one row for each batch, however frequent it is,
and a document's part of a row is bounded by its pairs, however long it is. The counts go back
to the batches, where each document's pairs look theirs up: as a table sent to every task where
they are few (ids that overlap are bounded by the vocabularies, not by the corpus), else by a
join on the batch. These rows are wide: a task reads FEW_ROWS of them at a time, however many
its files hold.

Nulls: a null text is an empty one; texts that are empty, or that either side's tokens don't
give back, have no tokens. A null doc_id stays. Repeated rows are documents each; texts are
taken whole (the longest one is a batch); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import contextlib
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, discard, save, tidy
from .pieces import SentencePieces
from .tokens import PieceEncoder, byte_letters

#: Words in each generation of a worker's caches of A and of B; tokens written at once; bytes of texts in a row.
CACHE, BLOCK, ROW_BYTES = (150_000, 300_000), 1 << 17, 2 << 20
#: Distinct linked pairs whose counts are sent to every task at most (16 bytes each).
SENT_PAIRS = 1 << 20
#: Batches' rows (some 1.5 MB each) that a task decodes at once: Spark's reader takes 4,096, that is all rows of
#: a file, and its hash aggregate gathers the lists of 128 batches beside each other; sorted, there is one.
FEW_ROWS = {"spark.sql.parquet.columnarReaderBatchSize": "4", "spark.sql.execution.useObjectHashAggregateExec": "false"}
_EMPTY = np.empty(0, np.int64)


class Strings:
    """Byte strings by number, joined by gathering."""

    def __init__(self, strings: list[bytes]):
        self.flat = np.frombuffer(b"".join(strings), np.uint8)
        self.size = np.array(list(map(len, strings)), np.int32)
        self.start = np.cumsum(self.size, dtype=np.int32) - self.size

    def joined(self, codes: np.ndarray) -> Iterator[np.ndarray]:
        """The strings of ``codes``, one after the other, in blocks of bytes."""
        for k in range(0, codes.size, BLOCK):
            c = codes[k : k + BLOCK]
            n = self.size[c]
            at = np.repeat(self.start[c] - (np.cumsum(n, dtype=np.int32) - n), n)
            at += np.arange(at.size, dtype=np.int32)
            yield self.flat[at]

    def give(self, codes: np.ndarray, text: bytes) -> bool:
        """Whether the strings of ``codes`` make up ``text``."""
        i, want = 0, np.frombuffer(text, np.uint8)
        for block in self.joined(codes):
            if not np.array_equal(block, want[i : i + block.size]):
                return False
            i += block.size
        return i == want.size


def overlaps(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each A token, the first B token that overlaps it and the first after it that
    doesn't. The ends ascend, and tokens follow each other without holes from byte 0 on."""
    a_starts, b_starts = np.append(0, a_ends[:-1]), np.append(0, b_ends[:-1])
    return np.searchsorted(b_ends, a_starts, "right"), np.searchsorted(b_starts, a_ends, "left")


def gaps(a_ends: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Whether a group ends with an A token: no B token overlaps both it and the next one."""
    return np.append(hi[:-1] <= lo[1:], True) if a_ends.size else np.empty(0, bool)


class Aligner:
    """Encodes by both vocabularies and aligns the tokens of one text at a time."""

    def __init__(self, a_path: str, b_path: str):
        self.a, self.b = PieceEncoder(a_path, "byte", CACHE[0]), SentencePieces(b_path, CACHE[1])
        letters = {c: b for b, c in byte_letters().items()}
        vocabulary = self.a.t.get_vocab()
        a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for name, i in vocabulary.items():
            if all(c in letters for c in name):
                a_bytes[i] = bytes(map(letters.__getitem__, name))
        self.a_strings, self.b_strings = Strings(a_bytes), Strings(self.b.bytes_of)
        # a token as written in groups, by what follows it: one of its side, the other side or a group
        self.n_a, self.n_b = len(a_bytes), len(self.b.bytes_of)
        self.shown = Strings([b"%d%c" % (i, s) for n, ends in ((self.n_a, b",|"), (self.n_b, b",;")) for s in ends for i in range(n)])

    def tokens(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(A ids of a space and the text, B ids of the text); none where either differs in bytes."""
        for text, a in zip(texts, self.a.encode_many(texts, spaced=True)):
            text = text.as_py()
            if text:
                b, want = self.b.ids(text), b" " + text.encode()
                if self.a_strings.give(a, want) and self.b_strings.give(b, want):
                    yield a.astype(np.int64), b.astype(np.int64)
                    continue
            yield _EMPTY, _EMPTY

    def align(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places (in a, in b) of all linked tokens, and whether a group ends with each A token."""
        if not a.size:
            return _EMPTY, _EMPTY, np.empty(0, bool)
        a_ends = np.cumsum(self.a_strings.size[a])
        lo, hi = overlaps(a_ends, np.cumsum(self.b_strings.size[b]))
        n = hi - lo
        left = np.repeat(np.arange(a.size), n)
        return left, np.arange(left.size) - np.repeat(np.cumsum(n) - n - lo, n), gaps(a_ends, lo, hi)

    def digest(self, a: np.ndarray, b: np.ndarray, ends: np.ndarray, b_of_group: np.ndarray) -> str:
        """SHA-256 of the groups as ``a1,a2|b1;a3|b2,b3``. ends: see align; b_of_group: B tokens
        up to each group's end."""
        if not a.size:
            return ""
        group = np.cumsum(ends) - ends  # of each A token
        before = np.append(0, b_of_group[:-1])
        a_of_group = np.flatnonzero(ends) + 1
        code = np.empty(a.size + b.size, np.int64)
        code[np.arange(a.size) + before[group]] = a + self.n_a * ends
        last = np.zeros(b.size, bool)
        last[b_of_group - 1] = True
        code[np.arange(b.size) + np.repeat(a_of_group, np.diff(np.append(0, b_of_group)))] = 2 * self.n_a + b + self.n_b * last
        made, end = hashlib.sha256(), code[-1:]
        for block in self.shown.joined(code[:-1]):
            made.update(block)
        made.update(next(self.shown.joined(end))[:-1])  # no mark after the last token
        return made.hexdigest()


_made: dict = {}


def aligner(a_path: str, b_path: str) -> Aligner:
    """One for each worker process and pair of files."""
    if (a_path, b_path) not in _made:
        _made[a_path, b_path] = Aligner(a_path, b_path)
    return _made[a_path, b_path]


_BATCH = "batch long, doc_ids array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, groups_sha256 array<string>, stops array<long>, places array<int>, times array<int>, pairs array<long>, held array<int>"
_ROWS = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of about ROW_BYTES of text, a document at least."""
    for b in batches:
        size, a = np.cumsum(pc.fill_null(pc.binary_length(b.column(1)), 0).to_numpy(zero_copy_only=False)), 0
        while a < b.num_rows:
            z = max(a + 1, int(np.searchsorted(size, (size[a - 1] if a else 0) + ROW_BYTES, "right")))
            yield b.slice(a, z - a)
            a = z


def link_batches(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each batch of documents: their token, group and link counts, the batch's
    distinct linked pairs (A id * 2^32 + B id) with the number of its documents that hold
    them, and the distinct pairs of all its documents as places in that list, with the number
    of the document's links of each; stops: where each document's end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = aligner(a_path, b_path)
        part = TaskContext.get().partitionId()
        for number, batch in enumerate(_parts(batches)):
            n_a, n_b, n_groups, n_links, shas, owns, times, size = [], [], [], [], [], [_EMPTY], [_EMPTY], []
            for a, b in both.tokens(batch.column(1)):
                left, right, ends = both.align(a, b)
                last = np.append(left[1:] != left[:-1], True)[: left.size]
                stops = right[last][ends] + 1 if a.size else _EMPTY
                n_a.append(a.size)
                n_b.append(b.size)
                n_groups.append(int(ends.sum()))
                n_links.append(left.size)
                shas.append(both.digest(a, b, ends, stops))
                own, many = np.unique(a[left] << 32 | b[right], return_counts=True)
                owns.append(own)
                times.append(many)
                size.append(own.size)
            # a document has a pair once, so a pair is there as often as documents hold it
            pairs, places, held = np.unique(np.concatenate(owns), return_inverse=True, return_counts=True)
            lists = dict(doc_ids=batch.column(0).cast(pa.int64()), n_a=n_a, n_b=n_b, n_groups=n_groups, n_links=n_links, groups_sha256=shas, stops=np.cumsum(np.array(size, np.int64)), places=places.astype(np.int32), times=np.concatenate(times).astype(np.int32), pairs=pairs, held=held.astype(np.int32))
            kinds = {"groups_sha256": pa.string(), "places": pa.int32(), "times": pa.int32(), "held": pa.int32()}
            row = {"batch": pa.array([part << 32 | number], pa.int64())}
            for name, values in lists.items():
                col = values if isinstance(values, pa.Array) else pa.array(values, kinds.get(name, pa.int64()))
                row[name] = pa.ListArray.from_arrays(pa.array([0, len(col)], pa.int32()), col)
            yield pa.RecordBatch.from_arrays(list(row.values()), list(row))

    bounded_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(tidy(run), _BATCH)


def _documents(batch: pa.RecordBatch, r: int, coded: np.ndarray) -> pa.RecordBatch:
    """Documents' rows of one batch; coded: for each of its pairs twice its count, and one more
    where that is its A id's highest."""
    cell = lambda name: batch.column(batch.schema.get_field_index(name))[r].values
    stops, places, times = (cell(x).to_numpy() for x in ("stops", "places", "times"))
    sums, best = (np.append(0, np.cumsum(x[places] * times)) for x in (coded >> 1, coded & 1))
    starts = np.append(0, stops[:-1])
    made = (best[stops] - best[starts], sums[stops] - sums[starts])
    out = [cell("doc_ids"), cell("n_a"), cell("n_b"), cell("n_groups"), cell("n_links"), *(pa.array(x, pa.int64()) for x in made), cell("groups_sha256")]
    return pa.RecordBatch.from_arrays(out, [c.split()[0] for c in _ROWS.split(", ")])


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in range(batch.num_rows):
            coded = batch.column(batch.schema.get_field_index("coded"))[r].values
            yield _documents(batch, r, _EMPTY if coded is None else coded.to_numpy())


def _sent(held):
    """The same with the counts of all pairs sent along."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, coded = held.value
        for batch in batches:
            for r in range(batch.num_rows):
                own = batch.column(batch.schema.get_field_index("pairs"))[r].values.to_numpy()
                yield _documents(batch, r, coded[np.searchsorted(pairs, own)])

    return run


@contextlib.contextmanager
def _few_rows(spark: SparkSession) -> Iterator[None]:
    """FEW_ROWS holds for the plans that run inside."""
    before = {k: spark.conf.get(k, None) for k in FEW_ROWS}
    try:
        for k, v in FEW_ROWS.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def align_documents(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text: str = "text", sent: int = SENT_PAIRS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best (links whose pair is in as many documents as
    any of their A id), count_sum (of the links' document counts) and groups_sha256."""
    spark = docs.sparkSession
    rows = save(link_batches(docs, a_path, b_path, id_col, text), "aligned")
    each = rows.select("batch", F.posexplode(F.arrays_zip("pairs", "held")).alias("at", "p")).select("batch", "at", F.col("p.pairs").alias("pair"), F.col("p.held").alias("held"))
    counts = each.groupBy("pair").agg(F.sum("held").alias("n"))
    with _few_rows(spark):
        counts = save(counts, "aligned-counts")
    # one row for each id of A's vocabulary
    most = counts.groupBy(F.shiftright("pair", 32).alias("a")).agg(F.max("n").alias("most"))
    counted = counts.join(F.broadcast(most), F.shiftright("pair", 32) == F.col("a")).select("pair", (2 * F.col("n") + (F.col("n") == F.col("most")).cast("long")).alias("coded"))
    if counts.count() <= sent:
        table = counted.toArrow().sort_by("pair")
        held = spark.sparkContext.broadcast(tuple(table.column(c).to_numpy() for c in ("pair", "coded")))
        scored = rows.drop("held").mapInArrow(tidy(_sent(held)), _ROWS)
    else:
        back = each.select("batch", "at", "pair").join(counted, "pair").groupBy("batch").agg(F.array_sort(F.collect_list(F.struct("at", "coded"))).alias("c")).select("batch", F.col("c.coded").alias("coded"))
        scored = rows.drop("pairs", "held").join(back, "batch", "left").mapInArrow(tidy(_joined), _ROWS)
    with _few_rows(spark):
        out = save(scored, "aligned-documents")
    discard(rows, counts)
    return out
