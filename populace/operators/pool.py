"""Work lists: sharding, completeness, resumption, merging."""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def missing(expected: DataFrame, present: DataFrame, key: Sequence[str]) -> DataFrame:
    """Expected keys that aren't present (also: work that is left when resuming)."""
    return expected.select(*key).distinct().join(present.select(*key), list(key), "left_anti")


def duplicates(rows: DataFrame, key: Sequence[str]) -> DataFrame:
    return rows.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def first_candidate(rows: DataFrame, group: Sequence[str], priority: str, valid: Column) -> DataFrame:
    """The valid row of the least priority in each group."""
    rest = [c for c in rows.columns if c not in group]
    return rows.where(valid).groupBy(*group).agg(F.min_by(F.struct(*rest), priority).alias("_r")).select(*group, "_r.*")


def round_robin(rows: DataFrame, order: Sequence[str], shards: int) -> DataFrame:
    """Shard = place in the order modulo shards. The place is a global one: rows are
    written in range partitions, whose sizes are added to the places inside them."""
    from ..plans.flagship import cut_lineage

    n = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # written once: a second sampling of the ranges could cut them elsewhere
    ranged = cut_lineage(rows.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()))
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_size"))
    before = sizes.select("_part", (F.sum("_size").over(Window.orderBy("_part")) - F.col("_size")).alias("_before"))  # a row a partition
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return ranged.withColumn("_place", place).join(F.broadcast(before), "_part").withColumn("shard", F.pmod(F.col("_place") + F.col("_before"), F.lit(shards)).cast("int")).drop("_part", "_place", "_before")


def longest_first(sizes: Iterable[tuple[str, int]], shards: int) -> dict[str, int]:
    """Longest item into the least loaded shard, ties by index; for work lists of a
    bounded number of items, on the driver."""
    load = [(0, i) for i in range(shards)]
    heapq.heapify(load)
    out = {}
    for name, size in sorted(sizes, key=lambda kv: (-kv[1], kv[0])):
        used, i = heapq.heappop(load)
        out[name] = i
        heapq.heappush(load, (used + size, i))
    return out


def merge_shards(parts: DataFrame, key: Sequence[str], shards: int) -> DataFrame:
    """Rows of all shards; a missing shard, another shard count or a duplicate key is an error."""
    seen = parts.select("shard", "n_shards").distinct().collect()  # a row a shard
    lost = sorted(set(range(shards)) - {r["shard"] for r in seen})
    if lost or any(r["n_shards"] != shards for r in seen):
        raise ValueError(f"shards missing or miscounted: {lost}")
    if twice := duplicates(parts, key).limit(3).collect():
        raise ValueError(f"duplicate keys: {twice}")
    return parts.drop("shard", "n_shards")


def top_per_group(rows: DataFrame, group: Sequence[str], order: Sequence[str], n: int) -> DataFrame:
    w = Window.partitionBy(*group).orderBy(*order)
    return rows.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= n).drop("_rank")


def by_locality(rows: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows of a key together and in order, so that whatever is loaded for the key is loaded once."""
    return rows.repartition(*key).sortWithinPartitions(*key, *order)
