"""Each row's exact nearest one among a bounded list of fitted points.

The points (10,000 by default) become a k-d tree of flat arrays, sent once to every
executor. A batch of rows goes down the tree together: each node splits it by side, and the
far side is met only by the rows whose best distance reaches the cut. Distances are sums of
squares in column order, and of equally near points the first wins, so the result is that of
comparing every row with every point.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Points that a leaf holds, and that a tree may hold at most: what is sent is bounded by it.
LEAF, POINTS_MAX = 24, 1_000_000


class NearestIndex:
    """A k-d tree. ``points`` (n, d) are finite; ``find`` gives the number of the nearest one."""

    def __init__(self, points: np.ndarray):
        self.points = np.ascontiguousarray(points, float)
        if not self.points.size or len(self.points) > POINTS_MAX or not np.isfinite(self.points).all():
            raise ValueError(f"1 to {POINTS_MAX} finite points expected")
        self.order = np.arange(len(self.points))
        self.nodes: list[tuple[int, int, int, float, int, int]] = []  # low, high, axis, cut, left, right
        self._build(0, len(self.points))

    def _build(self, low: int, high: int) -> int:
        """The node of order[low:high]: cut at the median of its widest axis. Equal points
        aren't parted, and make one leaf however many they are."""
        me, own = len(self.nodes), self.points[self.order[low:high]]
        self.nodes.append((low, high, -1, 0.0, -1, -1))
        spread = np.ptp(own, axis=0)
        axis = int(spread.argmax())
        if high - low <= LEAF or not spread[axis] > 0:
            self.order[low:high].sort()
            return me
        v = own[:, axis]
        cut = np.partition(v, len(v) // 2)[len(v) // 2]
        if cut == v.min():  # the right side begins above the cut
            cut = v[v > cut].min()
        by = np.argsort(v >= cut, kind="stable")
        self.order[low:high] = self.order[low:high][by]
        middle = low + int((v < cut).sum())
        self.nodes[me] = low, high, axis, float(cut), self._build(low, middle), self._build(middle, high)
        return me

    def find(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number, squared distance) of each row's nearest point; -1 where a row isn't finite."""
        rows = np.ascontiguousarray(rows, float)
        best, at = np.full(len(rows), np.inf), np.full(len(rows), -1)
        todo = [(0, np.flatnonzero(np.isfinite(rows).all(1)), None)]
        while todo:
            node, own, gap = todo.pop()
            if gap is not None:  # rows of the other side that may still have a nearer point here
                near = gap <= best[own]
                own = own[near]
            if not own.size:
                continue
            low, high, axis, cut, left, right = self.nodes[node]
            if axis < 0:
                self._leaf(rows, own, self.order[low:high], best, at)
                continue
            off = rows[own, axis] - cut
            up = off >= 0
            gap = off * off
            # the last one put down is taken first: each side's own rows before its visitors
            todo += [(left, own[up], gap[up]), (right, own[~up], gap[~up]), (right, own[up], None), (left, own[~up], None)]
        return at, best

    def _leaf(self, rows, own, members, best, at, block: int = 1 << 16) -> None:
        for k in range(0, len(members), LEAF):
            some = members[k : k + LEAF]
            p = self.points[some]
            for j in range(0, own.size, block):
                r = own[j : j + block]
                d = np.zeros((r.size, len(p)))
                for c in range(p.shape[1]):
                    step = rows[r, c][:, None] - p[:, c]
                    d += step * step
                n = d.argmin(1)
                d, n = d[np.arange(r.size), n], some[n]
                won = (d < best[r]) | (d == best[r]) & (n < at[r])
                best[r[won]], at[r[won]] = d[won], n[won]


def nearest_point(spark, columns: Sequence[Column], points: np.ndarray, values: Sequence[int] | None = None) -> Column:
    """The number of the nearest of ``points`` (or its value); NULL where a column is missing.

    The tree is built once for each worker process from the points that are sent."""
    held = spark.sparkContext.broadcast((np.asarray(points, float), None if values is None else np.asarray(values, np.int64)))

    @F.pandas_udf("long")
    def number(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        own, of = held.value
        index = NearestIndex(own)
        for rows in batches:
            at, _ = index.find(rows.to_numpy(float, na_value=np.nan))
            found = at if of is None else of[at]
            yield pd.Series(found, dtype="Int64").mask(at < 0)

    return number(F.struct(*(c.cast("double").alias(f"c{i}") for i, c in enumerate(columns))))


def spread_labels(rows: DataFrame, columns: Sequence[str], points: np.ndarray, labels: Sequence[int], name: str = "slot") -> DataFrame:
    """``rows`` with the label of their nearest fitted point."""
    return rows.withColumn(name, nearest_point(rows.sparkSession, [F.col(c) for c in columns], points, labels).cast("int"))
